import gzip
import hashlib

import pytest

from marketsense.llm import queries, warc


def test_archives_round_trip_and_assemble(spark, tmp_path):
    big = "<p>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n</p>"
    rows = [(5, "http://a/1", big), (3, "http://a/2\r\nX: y", big), (9, None, big), (9, None, big), (1, "u", "small"), (2, "u", "small"), (4, "u", None), (None, "u", big), (7, "ü", "é" * 50)]
    pages = spark.createDataFrame([(i, u, h, "d", 3) for i, u, h in rows], "page_id long, url string, html string, Digest string, row int")
    captures = warc.plan_captures(pages)
    warc.write_archives(captures, str(tmp_path / "w"))
    records = warc.read_archives(spark, str(tmp_path / "w"))
    assert records.count() == 3 * len(rows)
    nested = warc.assemble(records).collect()
    assert len(nested) == len(rows) and all(r.request is not None and len(r.metadata) == 1 for r in nested)
    held = [r.response for r in nested if r.response.type == "response"]
    assert len(held) == 5 and {bytes(r.block).partition(b"\r\n\r\n")[2].decode() for r in held} == {big, "small", "", "é" * 50}
    for r in nested:
        payload = bytes(r.response.block).partition(b"\r\n\r\n")[2]
        if r.response.type == "response":
            assert r.response.digest == f"sha256:{hashlib.sha256(payload).hexdigest()}" and r.response.payload_length == len(payload)
        else:
            assert payload == b"" and r.response.payload_length == len(big) and r.response.profile == warc.REVISIT_PROFILE
    leader = [r for r in nested if r.response.type == "response" and len(r.response.block) > 200 and b"xxx" in bytes(r.response.block)]
    assert len(leader) == 1 and {r.response.refers_to for r in nested if r.response.type == "revisit"} == {leader[0].response.record_id}
    assert b"pageId: 3\r\n" in bytes(leader[0].metadata[0].block)


def test_query_on_clashing_and_repeated_rows(spark, tmp_path):
    rows = [(2, "u", "p" * 100), (2, "u", "p" * 100), (1, "u", "p" * 100), (5, "u", "q" * 99), (6, "u", "q" * 99)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, queries.op8_warc_transactions(spark, str(tmp_path)).collect()))
    digest = lambda c, n: hashlib.sha256(c * n).hexdigest()
    p, q = digest(b"p", 100), digest(b"q", 99)
    assert got == [(1, 100, p, "response", None), (2, 100, p, "revisit", 1), (2, 100, p, "revisit", 1), (5, 99, q, "response", None), (6, 99, q, "response", None)]


def test_empty_and_broken_archives(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(warc.plan_captures(pages), str(tmp_path / "none"))
    assert warc.assemble(warc.read_archives(spark, str(tmp_path / "none"))).collect() == []
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort"))
    with pytest.raises(ValueError):
        list(warc.parse_records(b"junk"))


def test_damaged_payload_shows(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a" * 120), (2, "u", "a" * 120)], "page_id long, url string, html string")
    warc.write_archives(warc.plan_captures(pages), str(tmp_path / "w"))
    content = b"".join(gzip.decompress(file.read_bytes()) for file in sorted((tmp_path / "w").glob("part-*")))
    records = {r["type"]: r for r in warc.parse_records(content.replace(b"a" * 120, b"a" * 60 + b"b" * 60))}
    damaged, meant = hashlib.sha256(b"a" * 60 + b"b" * 60).hexdigest(), hashlib.sha256(b"a" * 120).hexdigest()
    assert (records["response"]["digest"], records["response"]["payload_length"]) == (f"sha256:{damaged}", 120)
    assert (records["revisit"]["digest"], records["revisit"]["payload_length"]) == (f"sha256:{meant}", 120)


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_CLASSES", [(1000, 10), (100_000, 3), (None, 1)])
    rows = [(i, "u", f"{i} " + "s" * 300) for i in range(25)] + [(100 + i, "u", f"{i} " + "m" * 50_000) for i in range(7)] + [(200 + i, "u", f"{i} " + "l" * 500_000) for i in range(2)]
    captures = warc.plan_captures(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    warc.write_archives(captures, str(tmp_path / "w"))
    sizes = sorted(len(gzip.decompress(file.read_bytes())) for file in (tmp_path / "w").glob("part-*"))
    assert len(sizes) == 3 + 3 + 2 and sizes[2] < 10 * 2_000 and sizes[5] < 3 * 60_000 and sizes[-1] < 520_000
    nested = warc.assemble(warc.read_archives(spark, str(tmp_path / "w")), payloads=False)
    assert nested.count() == len(rows) and "block" not in nested.schema["response"].dataType.names


def test_the_query_reads_the_archives_once_and_moves_no_payload(spark):
    plan = queries.op8_warc_transactions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "binaryFile" not in plan and "block" not in plan  # what is left works on the small staged rows
