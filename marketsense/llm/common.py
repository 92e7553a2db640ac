"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketsense.session import staged_path

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text, split at the six ASCII blanks only; null counts as 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text (crc32 0, fold 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def spare_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have in any letter case."""
    taken = {name.lower() for name in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def row_bits(rows: DataFrame, row: str) -> DataFrame:
    """(bucket, bits): the numbers in column ``row`` as bit maps of 32,768 numbers each.

    For numbers that lie close together, as those of ``monotonically_increasing_id`` do in
    each partition: about a bit a row, and up to 4 KB more a partition.
    """
    place = F.col(row) + 1  # Spark's maps begin at 1
    return rows.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))


def rows_in(df: DataFrame, row: str, bits: DataFrame) -> DataFrame:
    """The rows of ``df`` whose number is in the bit maps (see ``row_bits``); the maps travel, ``df`` stays where it is."""
    place = F.col(row) + 1
    position = F.bitmap_bit_position(place)
    held = F.conv(F.hex(F.substring("_bits", (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    bit = F.floor(held / F.pow(F.lit(2), position % 8)) % 2 == 1
    return df.join(F.broadcast(bits), F.bitmap_bucket_number(place) == F.col("_bucket")).filter(bit).select(*df.columns)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder with a column ``row`` that tells all rows apart, repeated ones too.

    The numbers are part of the files, so every later plan, and every task that is
    run again, sees the same ones.  Long texts are packed tightly.
    """
    spark, rows = df.sparkSession, df.withColumn("row", F.monotonically_increasing_id())
    path = staged_path(spark, name)
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def text_chunks(texts: Sequence[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with at most ``most`` characters together (a longer text is alone in its range)."""
    start, held = 0, 0
    for place, text in enumerate(texts):
        size = len(text) if text is not None else 0
        if place > start and held + size > most:
            yield start, place
            start, held = place, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def joined_bytes(texts: Sequence[str | None], before: bytes = b"", after: bytes = b"", lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts in one array, each between ``before`` and ``after``, and the n+1 bounds of the texts."""
    parts = []
    for text in texts:
        text = text or ""
        parts.append(before + (text.lower() if lower else text).encode("utf-8", "surrogatepass") + after)
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(part) for part in parts], out=bounds[1:])
    return np.frombuffer(b"".join(parts), np.uint8), bounds


def mix64(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply, twice), element by element."""
    values = values.astype(np.uint64, copy=True)
    values ^= values >> np.uint64(30)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def sample_classes(labelled: DataFrame, key: Column, per_class: int, most_classes: int = 500) -> DataFrame:
    """About ``per_class`` rows (label, ...) of each class, chosen by a hash of ``key``; classes that have no more stay whole.

    At most twice ``per_class`` rows a class are returned, so what a model is fitted on is
    bounded however large the table is.  The classes themselves must be few.
    """
    counts = labelled.groupBy("label").count().limit(most_classes).collect()
    rate = F.lit(0.0)
    for found in counts:
        rate = F.when(F.col("label") == F.lit(found["label"]), F.lit(per_class / found["count"])).otherwise(rate)
    share = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return labelled.filter(share < rate).limit(2 * per_class * max(1, len(counts)))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, per_class: int) -> DataFrame:
    """(doc_id, text, label) of a bounded sample of labelled documents outside the held-out fold.

    Labels are sampled before they meet the texts, so the side that is broadcast is as
    bounded as the sample.  A document with several labels counts as the larger one;
    null ids and null labels take no part.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold_of(F.col("doc_id"), folds) != held))
    known = known.groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("label"))
    chosen = sample_classes(known, F.col("doc_id"), per_class)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")
