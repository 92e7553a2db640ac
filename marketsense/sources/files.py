"""Files behind input paths, and what became of each: read, missing, empty or broken."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

REPORT = "path string, file string, size bigint, status string, reason string"


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem(), path.removeprefix("file:").replace("//", "/", 1) if path.startswith("file:///") else path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path)


def listed(path: str) -> list[tuple[str, int]] | None:
    """(file, size) of a file, or of all files of a folder and below, hidden ones aside, in order; None if there is no such path."""
    store, inside = open_store(path)
    found = store.get_file_info(inside)
    if found.type == pafs.FileType.NotFound:
        return None
    if found.type == pafs.FileType.File:
        return [(path, found.size)]
    prefix = path[: len(path) - len(inside)] if path.endswith(inside) else ""
    files = store.get_file_info(pafs.FileSelector(inside, recursive=True))

    def hidden(name: str) -> bool:
        return any(part.startswith(("_", ".")) for part in name.removeprefix(inside).strip("/").split("/"))

    return sorted((prefix + file.path, file.size) for file in files if file.type == pafs.FileType.File and not hidden(file.path))


def _fault(path: str, fmt: str) -> str | None:
    """Why a file cannot be read, judged by its first bytes, or a parquet file by its footer."""
    store, inside = open_store(path)
    try:
        with store.open_input_file(inside) as handle:
            if fmt == "parquet":
                import pyarrow.parquet as pq

                meta = pq.ParquetFile(handle).metadata
                ends = [column.data_page_offset + column.total_compressed_size for group in range(meta.num_row_groups) for column in [meta.row_group(group).column(0)]]
                if any(end > handle.size() for end in ends):
                    return "a row group lies beyond the end of the file"
            else:
                handle.read(1 << 16).decode("utf-8", "ignore" if handle.size() > 1 << 16 else "strict")
    except (OSError, ValueError, pa.ArrowException) as error:
        return f"{type(error).__name__}: {error}"[:500]
    return None


def file_report(spark: SparkSession, paths: list[str], fmt: str = "parquet") -> DataFrame:
    """One row per file of the paths, and per path that does not exist or has no file.

    Names are listed by the driver; the files are looked into by tasks, each on its own, so
    one broken file says nothing about another.
    """
    rows: list[tuple] = []
    for path in paths:
        files = listed(path)
        if not files:
            rows.append((path, None, None, "missing" if files is None else "empty", "no such path" if files is None else "a folder without files"))
        rows += [(path, file, size, None, None) for file, size in files or ()]
    named = spark.createDataFrame(rows, REPORT).repartition(max(1, min(len(rows), 10_000)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.to_pylist()
            for row in found:
                if row["status"] is None and row["size"] == 0:
                    row["status"], row["reason"] = "empty", "no bytes"
                elif row["status"] is None:
                    row["reason"] = _fault(row["file"], fmt)
                    row["status"] = "broken" if row["reason"] else "read"
            yield pa.RecordBatch.from_pylist(found, batch.schema)

    return named.mapInArrow(look, REPORT)
