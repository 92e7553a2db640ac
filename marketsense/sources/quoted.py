"""Quoted CSV whose fields hold line breaks, read by many tasks per file.

A line break ends a record only outside quotes, and a reader that begins in the middle
of a file does not know whether it is inside.  The number of quotes before it tells: all
byte ranges count theirs, a prefix sum of the counts gives each range its state, and
then every range reads the records that begin in it, the last one beyond its end.
A doubled quote inside a field counts twice and changes nothing.  Quotes must only stand
around fields and doubled inside them, as writers that quote all fields leave them.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from marketsense.session import stage
from marketsense.sources.files import listed, open_store

SPLIT_BYTES = 64 << 20
WINDOW = 4 << 20  # bytes handled at a time
QUOTE, BREAK = 34, 10
RANGE = "path string, size bigint, start bigint, stop bigint"


def byte_ranges(spark: SparkSession, files: list[tuple[str, int]], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, size, start, stop): every file cut into ranges."""
    named = spark.createDataFrame(files, "path string, size bigint").where("size > 0")
    ranges = named.withColumn("start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(split_bytes).cast("bigint"))))
    return ranges.withColumn("stop", F.least(F.col("start") + split_bytes, "size"))


def count_quotes(ranges: DataFrame) -> DataFrame:
    """The ranges with ``inside``: whether a quoted field is open where the range begins."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                store, path = open_store(row["path"])
                with store.open_input_file(path) as handle:
                    row["quotes"] = sum(handle.read_at(min(WINDOW, row["stop"] - place), place).count(b'"') for place in range(row["start"], row["stop"], WINDOW))
            yield pa.RecordBatch.from_pylist(rows, pa.schema([*batch.schema, pa.field("quotes", pa.int64())]))

    counted = stage(ranges.mapInArrow(count, f"{RANGE}, quotes bigint"), "quotes")
    # One row per range of a file.
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1).drop("quotes")


def record_bytes(handle, size: int, start: int, stop: int, inside: bool) -> Iterator[bytes]:
    """The records that belong to a range, some whole ones at a time.

    A range leaves the record it begins in to the one before it, even if it begins
    where a record does, and reads the one that begins, or is open, at its end.
    """
    state, skipping, rest = int(inside), start > 0, []
    place = start
    while place < size:
        some = handle.read_at(min(WINDOW, (stop if place < stop else size) - place), place)
        signs = np.frombuffer(some, np.uint8)
        quotes = np.bitwise_xor.accumulate((signs == QUOTE).view(np.uint8)) ^ np.uint8(state)
        ends = np.flatnonzero((signs == BREAK) & (quotes == 0)) + 1
        state = int(quotes[-1])
        after = place >= stop
        place += len(some)
        low = 0
        if skipping and len(ends):
            low, ends, skipping = int(ends[0]), ends[1:], False
        if skipping:
            if place >= stop:
                return  # the whole range lies inside one record
            continue
        if after and len(ends):
            yield b"".join([*rest, some[: ends[0]]])
            return
        high = int(ends[-1]) if len(ends) else low
        if high > low:
            yield b"".join([*rest, some[low:high]])
            rest, low = [], high
        rest.append(some[low:])
    if any(rest):
        yield b"".join(rest)


def scan_quoted(spark: SparkSession, files: list[tuple[str, int]], schema: T.StructType, split_bytes: int = SPLIT_BYTES, header: bool = True) -> DataFrame:
    """Records of the files as text columns of ``schema``, with ``source_path``; the first record of a file is its header.

    Records that are too short get nulls, further fields are left out, blank lines are
    skipped; an empty field is null, quoted or not, as Spark's own reader has it.
    """
    names = [field.name for field in schema]
    # Rows are few and small, and each is much work: a task apiece.
    tasks = max(1, min(sum(-(-size // split_bytes) for _, size in files), 100_000))
    ranges = count_quotes(byte_ranges(spark, files, split_bytes).repartition(tasks, "path", "start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_store(row["path"])
                heading = header and row["start"] == 0
                with store.open_input_file(path) as handle:
                    for records in record_bytes(handle, row["size"], row["start"], row["stop"], row["inside"]):
                        text = io.StringIO(records.decode("utf-8", "replace"), newline="")
                        found = [record for record in csv.reader(text) if record]
                        found, heading = found[1:] if heading else found, False
                        columns = [[record[place] or None if place < len(record) else None for record in found] for place in range(len(names))]
                        yield pa.RecordBatch.from_arrays([pa.array(column, pa.string()) for column in [*columns, [row["path"]] * len(found)]], [*names, "source_path"])

    return ranges.repartition(tasks, "path", "start").mapInArrow(read, T.StructType([*[T.StructField(name, T.StringType()) for name in names], T.StructField("source_path", T.StringType())]))


def all_files(paths: list[str]) -> list[tuple[str, int]]:
    """Files with sizes of the paths that exist."""
    return [file for path in paths for file in listed(path) or ()]
