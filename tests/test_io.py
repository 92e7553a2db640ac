import io
import json
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from conftest import bars_frame
from marketsense import sinks
from marketsense.operators import align
from marketsense.operators import mentions as m
from marketsense.session import stage
from marketsense.sources import bars, ndjson, pages, quoted, zstframes
from marketsense.sources.tables import read_texts

LINES = [json.dumps({"id": str(i), "created_utc": 1600000000 + i, "body": f"MSFT é {i}", "score": i}) for i in range(500)]


def write_zst(path, text, frames=1, long_window=False):
    data = text.encode()
    cut = len(data) // frames + 1
    with open(path, "wb") as out:
        for k in range(frames):
            part = data[k * cut : (k + 1) * cut]
            if long_window:
                params = zstandard.ZstdCompressionParameters.from_level(3, window_log=31, enable_ldm=True)
                packer = zstandard.ZstdCompressor(compression_params=params)
                sink = io.BytesIO()
                with packer.stream_writer(sink, closefd=False) as writer:
                    writer.write(part)
                out.write(sink.getvalue())
            else:
                out.write(zstandard.ZstdCompressor().compress(part))


def test_scan_keeps_every_line(spark, tmp_path):
    write_zst(tmp_path / "a.zst", "\n".join(LINES))  # no line break at the end
    write_zst(tmp_path / "b.zst", "\n".join(LINES[:100]) + "\n", frames=3)
    (tmp_path / "c.txt").write_text("ignored")
    df = ndjson.scan_ndjson(spark, str(tmp_path), spread=4)
    assert {r.source_file: r["count"] for r in df.groupBy("source_file").count().collect()} == {"a.zst": 500, "b.zst": 100}
    assert m.extract_mentions(df, "msft", "2020-01-01", "2021-01-01").count() == 600


def test_scan_of_long_window_files(spark, tmp_path):
    write_zst(tmp_path / "a.zst", "\n".join(LINES), long_window=True)
    write_zst(tmp_path / "b.zst", "\n".join(LINES[:7]), frames=2, long_window=True)
    df = ndjson.scan_ndjson(spark, str(tmp_path))
    assert {r.source_file: r["count"] for r in df.groupBy("source_file").count().collect()} == {"a.zst": 500, "b.zst": 7}
    assert sorted(r.value for r in df.where("source_file = 'b.zst'").collect()) == sorted(LINES[:7])


TEXTS = {
    "lines": "\n".join(LINES),
    "closed": "\n".join(LINES[:40]) + "\n",
    "blank lines": "\n\n" + "\n\n\n".join(LINES[:30]) + "\n\n",
    "one long line": "x" * 20_000,
    "long and short": "y" * 9_000 + "\n" + "\n".join(LINES[:20]) + "\n" + "z" * 9_000,
    "one line feed": "\n",
    "empty": "",
}


@pytest.mark.parametrize("name", TEXTS)
@pytest.mark.parametrize("frames", [1, 2, 9, 60])
def test_ranges_of_frames_give_each_line_once(tmp_path, name, frames):
    """Every way to cut a file into byte ranges gives the lines of the text in order."""
    path, text = str(tmp_path / "a.zst"), TEXTS[name]
    write_zst(path, text, frames)
    wanted = text.encode().split(b"\n")
    wanted = wanted[:-1] if wanted[-1] == b"" else wanted
    data = open(path, "rb").read()
    store, name = zstframes.open_store(path)
    with store.open_input_file(name) as handle:
        for split in {1, 7, 50, 333, len(data) // 3 + 1, len(data) + 1} if frames < 60 else {211, 10**6}:
            if len(data) // split > 3000:
                continue
            got = [line for start in range(0, len(data), split) for line in zstframes.lines_of(handle, len(data), start, min(start + split, len(data)))]
            assert got == wanted, split


def test_skippable_frames_and_magic_numbers_inside_data(tmp_path):
    import os

    lines = [os.urandom(8).hex().encode() + zstframes.MAGIC * 3 + b"%d" % i for i in range(400)]
    raw = b"\n".join(lines)
    cut = len(raw) // 5
    with open(tmp_path / "a.zst", "wb") as out:
        for k in range(6):
            out.write(zstandard.ZstdCompressor(level=1, write_checksum=bool(k % 2), write_content_size=k > 2).compress(raw[k * cut : (k + 1) * cut]))
            out.write(b"\x53\x2a\x4d\x18\x05\x00\x00\x00hello")
    size = os.path.getsize(tmp_path / "a.zst")
    store, name = zstframes.open_store(str(tmp_path / "a.zst"))
    with store.open_input_file(name) as handle:
        for split in (97, 1000, size):
            got = [line for start in range(0, size, split) for line in zstframes.lines_of(handle, size, start, min(start + split, size))]
            assert got == lines


def test_one_file_of_many_frames_is_read_by_many_tasks(spark, tmp_path):
    write_zst(tmp_path / "a.zst", "\n".join(LINES), frames=50)
    size = (tmp_path / "a.zst").stat().st_size
    df = ndjson.scan_ndjson(spark, str(tmp_path / "a.zst"), split_bytes=size // 10)
    assert df.rdd.getNumPartitions() >= 10
    assert sum(1 for part in df.rdd.glom().collect() if part) >= 8
    assert [r.value for r in df.collect()] == LINES


def test_broken_dumps_fail(spark, tmp_path):
    (tmp_path / "text.zst").write_text("no zst at all")
    with pytest.raises(Exception, match="no zstd frame"):
        ndjson.scan_ndjson(spark, str(tmp_path)).collect()
    write_zst(tmp_path / "whole.zst", "\n".join(LINES), frames=4)
    whole = (tmp_path / "whole.zst").read_bytes()
    store, name = zstframes.open_store(str(tmp_path / "cut.zst"))
    (tmp_path / "cut.zst").write_bytes(whole[:-100])
    with store.open_input_file(name) as handle, pytest.raises(zstframes.Truncated):
        for start in range(0, len(whole) - 100, 500):
            list(zstframes.lines_of(handle, len(whole) - 100, start, min(start + 500, len(whole) - 100)))
    with pytest.raises(Exception, match="missing"):
        ndjson.scan_ndjson(spark, str(tmp_path / "missing")).collect()


def test_dumps_are_written_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(line,) for line in [*LINES, "", "ß" * 5000]], "value string").repartition(3)
    zstframes.write_zst(df, str(tmp_path / "out"), frame_bytes=700)
    back = ndjson.scan_ndjson(spark, str(tmp_path / "out"), split_bytes=900)
    assert sorted(r.value for r in back.collect()) == sorted([*LINES, "", "ß" * 5000])
    assert len({r.source_file for r in back.collect()}) == 3
    none = df.where("value = 'nothing'")
    zstframes.write_zst(none, str(tmp_path / "none"))
    assert ndjson.scan_ndjson(spark, str(tmp_path / "none")).collect() == []


def test_ohlcv_files(spark, tmp_path):
    head = "Price,Adj Close,Close,High,Low,Open,Volume\nTicker,AA,AA,AA,AA,AA,AA\nDate,,,,,,\n"
    (tmp_path / "AA_1d.csv").write_text(head + "2024-01-02 00:00:00+00:00,1,2,3,4,5,6\n2024-01-03,,nan,3,4,5,6\n")
    (tmp_path / "BRK-B_1d.csv").write_text(head + "2024-01-02,1,2,3,4,5,6\n")
    rows = bars.scan_ohlcv(spark, str(tmp_path)).orderBy("ticker", "date").collect()
    assert [(r.ticker, str(r.date), r.adj_close, r.close, r.volume) for r in rows] == [
        ("AA", "2024-01-02", 1.0, 2.0, 6.0), ("AA", "2024-01-03", None, None, 6.0), ("BRK-B", "2024-01-02", 1.0, 2.0, 6.0),
    ]


def test_mentions_csv_round_trip(spark, tmp_path):
    rows = [("2024-01-02 00:00:00", "a", 'say "hi",\nthere', "1", "2"), ("2024-01-01 00:00:00", None, "plain", "-3", "1")]
    df = spark.createDataFrame(rows, "created_date string, author string, body string, score string, id string")
    path = str(tmp_path / "mentions")
    sinks.write_mentions(df, path)
    back = [tuple(r) for r in sinks.scan_mentions_csv(spark, path).collect()]
    assert sorted(back, key=str) == sorted(rows, key=str)
    text = "".join(p.read_text() for p in sorted((tmp_path / "mentions").glob("part-*")))
    assert '"say ""hi"",\nthere"' in text and text.index("plain") < text.index("say")


def random_csv(seed, rows, end="\n"):
    rng = random.Random(seed)
    stock = ["a", "bc ", '""', "\n", "\r\n", ",", "é", "\n\n", " "]
    table = [["".join(rng.choice(stock) for _ in range(rng.randrange(0, 12))) for _ in range(5)] for _ in range(rows)]
    header = '"created_date","author","body","score","id"' + end
    return header + "".join(",".join(f'"{field}"' for field in row) + end for row in table), [tuple(field.replace('""', '"') for field in row) for row in table]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ranges_of_quoted_csv_give_each_record_once(spark, tmp_path, end, monkeypatch):
    text, table = random_csv(4, 300, end)
    data = text.encode()
    (tmp_path / "a.csv").write_bytes(data)
    store, name = zstframes.open_store(str(tmp_path / "a.csv"))
    with store.open_input_file(name) as handle:
        for split, window in ((1, 50), (7, 3), (100, 64), (1000, 1 << 20), (len(data) + 5, 10)):
            monkeypatch.setattr(quoted, "WINDOW", window)
            got = []
            for start in range(0, len(data), split):
                inside = data[:start].count(b'"') % 2 == 1
                got += quoted.record_bytes(handle, len(data), start, min(start + split, len(data)), inside)
            assert b"".join(got) == data
    monkeypatch.undo()
    columns = ["created_date", "author", "body", "score", "id"]
    many = sinks.scan_mentions_csv(spark, str(tmp_path), split_bytes=500)
    as_text = lambda df: sorted(tuple(v or "" for v in r) for r in df.collect())
    assert as_text(many.select(columns)) == sorted(table)
    assert many.rdd.getNumPartitions() > 10
    whole = spark.read.schema(many.select(columns).schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(str(tmp_path))
    if end == "\n":
        assert as_text(many.select(columns)) == as_text(whole)


def test_records_of_odd_lengths_and_empty_fields(spark, tmp_path):
    long = "x" * 200_000
    (tmp_path / "T_mentions.csv").write_text(f'"created_date","author","body","score","id"\n"1","","b",,"2"\n\n"short"\n"1","2","3","4","5","6"\n"1","a","{long}","3","9"')
    (tmp_path / "U.csv").write_text("")
    got = sinks.scan_mentions_csv(spark, str(tmp_path), ticker_of_file=True).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(
        [("1", None, "b", None, "2", "T"), ("short", None, None, None, None, "T"), ("1", "2", "3", "4", "5", "T"), ("1", "a", long, "3", "9", "T")], key=str
    )


def test_missing_mention_files_are_reported(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-02 00:00:00", "a", "text", "1", "2")], "created_date string, author string, body string, score string, id string")
    sinks.write_mentions(df, str(tmp_path / "A"))
    (tmp_path / "B.csv").write_bytes(b'"created_date"\n"\xff\xfe\xff"')
    rows, report = sinks.load_mentions(spark, [str(tmp_path / "A"), str(tmp_path / "B.csv"), str(tmp_path / "C.csv")])
    assert [r.body for r in rows.collect()] == ["text"]
    assert sorted((r.path[-5:], r.status) for r in report.collect()) == sorted([(str(tmp_path / "A")[-5:], "read"), ("B.csv", "broken"), ("C.csv", "missing")])
    with pytest.raises(FileNotFoundError):
        sinks.scan_mentions_csv(spark, str(tmp_path / "C.csv"))


def test_nothing_is_written_for_no_mentions(spark, tmp_path):
    empty = spark.createDataFrame([], "created_date string, author string, body string, score string, id string")
    sinks.write_mentions(empty, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_stage_rewrites_only_its_tickers(spark, tmp_path):
    path = str(tmp_path / "stage")
    sinks.write_stage(bars_frame(spark, [1.0, 2.0], "A").union(bars_frame(spark, [1.0], "B")), path)
    sinks.write_stage(bars_frame(spark, [5.0], "A"), path)
    got = sorted((r.ticker, r.close) for r in sinks.read_stage(spark, path).collect())
    assert got == [("A", 5.0), ("B", 1.0)]


def test_union_of_files_skips_missing_ones(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    bars_frame(spark, [1.0, 2.0], "A").write.parquet(one)
    bars_frame(spark, [3.0], "B").write.parquet(two)
    broken = tmp_path / "two" / "part-broken.parquet"
    broken.write_text("no parquet")
    schema = bars_frame(spark, [1.0]).schema
    (tmp_path / "four").mkdir()
    (tmp_path / "two" / "part-none.parquet").write_text("")
    df, report = bars.load_merged(spark, [one, two, str(tmp_path / "three"), str(tmp_path / "four")], schema=schema)
    assert df.count() == 3
    found = {(r.path.rsplit("/", 1)[-1], (r.file or "").rsplit("/", 1)[-1][:11], r.status) for r in report.collect()}
    assert {("two", "part-broken", "broken"), ("two", "part-none.p", "empty"), ("three", "", "missing"), ("four", "", "empty")} < found
    assert {status for path, _, status in found if path == "one"} == {"read"}
    assert all(r.reason for r in report.where("status <> 'read'").collect())
    stacked = bars.stack_tickers(df, ["B", "A"])
    assert {(r.ticker, r.ticker_ord) for r in stacked.collect()} == {("B", 0), ("A", 1)}
    with pytest.raises(ValueError):
        bars.load_merged(spark, [str(tmp_path / "three")])


def test_load_range_is_end_exclusive_and_reports_failures(spark):
    df = bars_frame(spark, [1.0, 2.0, 3.0], "A")
    assert bars.load_range(df, ["A"], "2024-01-02", "2024-01-03").count() == 1
    assert [r.ticker for r in bars.failed_tickers(df, ["A", "X"]).collect()] == ["X"]


def test_small_writers(spark, tmp_path):
    universe = pages.ticker_universe(spark.createDataFrame([("BRK.B",), ("A",), ("A",)], "symbol string"))
    sinks.write_tickers(universe, str(tmp_path / "tickers"))
    back = spark.read.option("header", True).csv(str(tmp_path / "tickers"))
    assert back.columns == ["Symbol"] and sorted(r.Symbol for r in back.collect()) == ["A", "BRK-B"]
    sinks.write_current_mentions(spark.createDataFrame([('a "b"', 1)], "body string, score int"), str(tmp_path / "now"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "now"))
    assert back.first().body == 'a "b"'


def test_zones(spark):
    df = spark.createDataFrame([("2024-01-02 00:00:00",)], "t string")
    row = df.select(align.to_utc("t").cast("string").alias("a"), align.to_utc("t", "America/New_York").cast("string").alias("b")).first()
    assert (row.a, row.b) == ("2024-01-02 00:00:00", "2024-01-02 05:00:00")


def test_stage_and_text_reader(spark, tmp_path):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    assert stage(df).orderBy("id").collect() == df.orderBy("id").collect()
    # Whether texts move is the caller's choice and does not depend on the number of files.
    for name, frame in (("one", df.coalesce(1)), ("many", df.repartition(16))):
        frame.write.parquet(str(tmp_path / name))
        for key in (None, "id"):
            plan = read_texts(spark, str(tmp_path / name), key)._jdf.queryExecution().executedPlan().toString()
            assert ("Exchange" in plan) == (key is not None)


def test_folder_report_names_missing_files(spark, tmp_path):
    from marketsense.operators import quality

    head = '"created_date","author","body","score","id"\n'
    (tmp_path / "AAPL_mentions.csv").write_text(head + '"2020-01-01 00:00:00","u","text","1","a"\n')
    (tmp_path / "MSFT_mentions.csv").write_text(head + '"never","u","two\nlines","1.5","a"\n')
    rows = quality.validate_folder(spark, str(tmp_path), "2020-01-01", "2020-01-02", ["AAPL", "MSFT", "F"]).collect()
    found = {(r.ticker, r.check_name): r.value for r in rows}
    assert found["AAPL", "records"] == found["MSFT", "invalid_dates"] == found["F", "missing_file"] == found["F", "failed"] == 1
    assert ("AAPL", "missing_file") not in found and found["AAPL", "failed"] == 0
