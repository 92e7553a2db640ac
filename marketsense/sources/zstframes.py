"""Lines of zstd-compressed dumps, read by many tasks per file, as a Spark data source.

A dump is a row of independent frames.  A partition is a range of the compressed bytes of
a file and owns the frames that begin in it.  It finds the first one by its magic number
and by following the frame's block headers to its end, where the next frame must begin, so
nothing of the file has to be read beforehand.  Lines do not stop at frame borders: a
partition leaves the line it begins in to the one before, and reads on into the next
frames until its own last line ends.  A file of one frame is one task's work, as the
format demands.

Every frame is decompressed as a stream, with windows up to 2 GB, which dumps made with
``--long=31`` need.
"""

from __future__ import annotations

import fnmatch
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from marketsense.sources.files import listed, open_store

NAME = "zst_lines"
SPLIT_BYTES = 64 << 20  # compressed bytes of a partition
FRAME_BYTES = 4 << 20  # text of a frame that is written
BATCH_BYTES = 4 << 20  # of lines handed on together
WINDOW = 1 << 20  # bytes read at a time

# Fixed values of the published format (RFC 8878).
MAGIC = bytes.fromhex("28b52ffd")
SKIPPABLE = {bytes([0x50 + n, 0x2A, 0x4D, 0x18]) for n in range(16)}
DICTIONARY_BYTES, SIZE_BYTES = (0, 1, 2, 4), (0, 2, 4, 8)
LARGEST_BLOCK = 128 << 10


class Truncated(ValueError):
    """A frame runs beyond the end of its file."""


class Compressed:
    """Random access to a compressed file, a window at a time."""

    def __init__(self, handle, size: int):
        self.handle, self.size = handle, size
        self.start, self.held = 0, b""

    def at(self, offset: int, count: int) -> bytes:
        """``count`` bytes, fewer at the end of the file."""
        if not self.start <= offset <= offset + count <= self.start + len(self.held):
            self.start, self.held = offset, self.handle.read_at(min(max(count, WINDOW), max(self.size - offset, 0)), offset)
        return self.held[offset - self.start : offset - self.start + count]

    def frame_end(self, offset: int) -> int | None:
        """Where the frame (or skippable frame) that begins at ``offset`` ends; None if no frame begins there."""
        head = self.at(offset, 18)
        if head[:4] in SKIPPABLE:
            end = offset + 8 + int.from_bytes(head[4:8], "little")
            if len(head) < 8 or end > self.size:
                raise Truncated
            return end
        if head[:4] != MAGIC:
            return None
        if len(head) < 6:
            raise Truncated
        flags = head[4]
        single = flags >> 5 & 1
        if flags & 8:  # reserved
            return None
        place = offset + 5 + (1 - single) + DICTIONARY_BYTES[flags & 3] + (SIZE_BYTES[flags >> 6] or single)
        while True:
            block = self.at(place, 3)
            if len(block) < 3:
                raise Truncated
            word = int.from_bytes(block, "little")
            last, kind, size = word & 1, word >> 1 & 3, word >> 3
            if kind == 3 or size > LARGEST_BLOCK:
                return None
            place += 3 + (1 if kind == 1 else size)
            if last:
                break
        end = place + (4 if flags & 4 else 0)
        if end > self.size:
            raise Truncated
        return end

    def begins(self, offset: int) -> bool:
        """Whether the file ends or a frame seems to begin at ``offset``."""
        return offset == self.size or (head := self.at(offset, 4)) == MAGIC or head in SKIPPABLE

    def first_frame(self, start: int, stop: int) -> int | None:
        """The first frame that begins in a range; a chance magic number is not followed by blocks and another frame."""
        place = start
        while place < stop:
            some = self.at(place, min(WINDOW, stop + 3 - place))
            found = some.find(MAGIC)
            if found < 0:
                place += max(len(some) - 3, 1)
                continue
            place += found
            if place < stop and (end := self.frame_end(place)) is not None and self.begins(end):
                return place
            place += 1
        return None


class _Span(io.RawIOBase):
    """A range of a file as a stream."""

    def __init__(self, handle, start: int, stop: int):
        self.handle, self.place, self.stop = handle, start, stop

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        some = self.handle.read_at(min(len(buffer), self.stop - self.place), self.place)
        buffer[: len(some)] = some
        self.place += len(some)
        return len(some)


def unpacked(handle, start: int, stop: int) -> Iterator[bytes]:
    """The text of the frames between two borders, in pieces of bounded size."""
    import zstandard

    packed = io.BufferedReader(_Span(handle, start, stop), WINDOW)
    with zstandard.ZstdDecompressor(max_window_size=2**31).stream_reader(packed, read_across_frames=True) as reader:
        while piece := reader.read(WINDOW):
            yield piece


def lines_of(handle, size: int, start: int, stop: int) -> Iterator[bytes]:
    """The lines that belong to the byte range: those that begin in its frames, the first one of a later range aside."""
    file = Compressed(handle, size)
    first = start if start == 0 else file.first_frame(start, stop)
    if first is None or size == 0:
        return
    end = first
    while end < min(stop, size):
        following = file.frame_end(end)
        if following is None:
            raise ValueError(f"no zstd frame at byte {end}")
        end = following
    rest, skipping = b"", start > 0
    for piece in unpacked(handle, first, end):
        parts = (rest + piece).split(b"\n")
        rest = parts.pop()
        if skipping and parts:
            parts, skipping = parts[1:], False
        elif skipping:
            rest = b""  # still inside the line of an earlier range
        yield from parts
    if skipping:
        return
    # The line that is open, or begins, where the own frames end.
    held = [rest]
    for piece in unpacked(handle, end, size) if end < size else ():
        ended = piece.find(b"\n")
        held.append(piece if ended < 0 else piece[:ended])
        if ended >= 0:
            yield b"".join(held)
            return
    if any(held):
        yield b"".join(held)


@dataclass
class FileRange(InputPartition):
    path: str
    size: int
    start: int
    stop: int


class ZstReader(DataSourceReader):
    def __init__(self, path: str, pattern: str, split: int):
        self.path, self.pattern, self.split = path, pattern, split

    def partitions(self) -> list[FileRange]:
        files = listed(self.path)
        if files is None:
            raise FileNotFoundError(self.path)
        chosen = [(path, size) for path, size in files if fnmatch.fnmatchcase(path.rsplit("/", 1)[-1], self.pattern)]
        return [FileRange(path, size, start, min(start + self.split, size)) for path, size in chosen for start in range(0, size, self.split)]

    def read(self, partition: FileRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file at all
            return
        store, path = open_store(partition.path)
        name, lines, held = path.rsplit("/", 1)[-1], [], 0

        def batch() -> pa.RecordBatch:
            text = [line.decode("utf-8", "replace") for line in lines]
            return pa.RecordBatch.from_pydict({"source_file": [name] * len(text), "value": text})

        with store.open_input_file(path) as handle:
            for line in lines_of(handle, partition.size, partition.start, partition.stop):
                lines.append(line)
                held += len(line)
                if held > BATCH_BYTES or len(lines) == 10_000:
                    yield batch()
                    lines, held = [], 0
        if lines:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class ZstWriter(DataSourceArrowWriter):
    """One file per task, frames of about ``frame_bytes`` of text, cut wherever they are full.

    Files carry a hidden name until the job commits, so those of failed or repeated tasks never count.
    """

    def __init__(self, path: str, frame_bytes: int):
        self.path, self.frame_bytes = path, frame_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import zstandard

        store, folder = open_store(self.path)
        name, packer, held = f"part-{uuid.uuid4().hex}.zst", zstandard.ZstdCompressor(), bytearray()
        store.create_dir(folder, recursive=True)
        some = False
        with store.open_output_stream(f"{folder}/_{name}", compression=None) as out:
            for batch in iterator:
                for line in batch.column(0).to_pylist():
                    held += (line or "").encode() + b"\n"
                    while len(held) >= self.frame_bytes:
                        out.write(packer.compress(bytes(held[: self.frame_bytes])))
                        del held[: self.frame_bytes]
                        some = True
            if held:
                out.write(packer.compress(bytes(held)))
        if some or held:
            return Written(name)
        store.delete_file(f"{folder}/_{name}")
        return Written(None)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = open_store(self.path)
        for message in messages:
            if message is not None and message.name:
                store.move(f"{folder}/_{message.name}", f"{folder}/{message.name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = open_store(self.path)
        for message in messages:
            if message is not None and message.name:
                store.delete_file(f"{folder}/_{message.name}")


class ZstLines(DataSource):
    """Options: ``path`` (a file or folder), ``pattern`` of file names, ``splitBytes``, ``frameBytes`` for writing."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "source_file string, value string"

    def reader(self, schema) -> ZstReader:
        return ZstReader(self.options["path"], self.options.get("pattern", "*.zst"), int(self.options.get("splitbytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> ZstWriter:
        return ZstWriter(self.options["path"], int(self.options.get("framebytes", FRAME_BYTES)))


def scan_zst(spark: SparkSession, path: str, pattern: str = "*.zst", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Lines (source_file, value) of all matching files of a folder, below it, or of one file.

    Every line counts, the last one included; an empty file has none.  A file that is
    no zstd file, or is cut short, fails its task.
    """
    spark.dataSource.register(ZstLines)
    return spark.read.format(NAME).option("pattern", pattern).option("splitBytes", split_bytes).load(path)


def write_zst(lines: DataFrame, path: str, frame_bytes: int = FRAME_BYTES) -> None:
    """Write the only column of ``lines`` as a folder of zst files of many frames."""
    lines.sparkSession.dataSource.register(ZstLines)
    lines.write.format(NAME).mode("append").option("frameBytes", frame_bytes).save(path)
