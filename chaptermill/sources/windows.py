"""Files read in byte windows, so that no file has to fit in a row, and their hashes.

A file is cut at multiples of a stride; each cut moves back to the last line end within ``lookBehind``
bytes, or to the last character boundary where there is none. What a window holds depends on the bytes
around its two cuts only, so runs of windows are read apart, one a partition, and may be read again at any time.
A SHA-256 is a chain over the whole file: its bytes stream through one task in small buffers, one
task a file, beside the windows.

Files are read in Python by pyarrow's file systems (local, hdfs, s3, gs), from the executors.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chaptermill.sources.text_files import is_text_name

WINDOW_BYTES = 16 << 20
LOOK_BEHIND = 1 << 20
BUFFER_BYTES = 1 << 20
#: Bytes of a file that one task reads, window by window, where more than one window fits in them.
TASK_BYTES = 16 << 20


@dataclass
class _Piece(InputPartition):
    path: str
    size: int
    mtime: int | None
    window: int = 0
    windows: int = 1


def _system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[_Piece]:
    """The regular files below a folder, or the file itself. Hidden files and those of writers under way are left out."""
    from pyarrow import fs

    system, inner = _system(path)
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    found = system.get_file_info(inner)
    infos = system.get_file_info(fs.FileSelector(inner, recursive=True)) if found.type == fs.FileType.Directory else [found]
    shown = lambda p: not any(x.startswith((".", "_")) for x in p.removeprefix(inner).split("/"))
    return [_Piece(scheme + i.path, i.size, i.mtime_ns) for i in sorted(infos, key=lambda i: i.path) if i.type == fs.FileType.File and shown(i.path)]


def _unit(encoding: str) -> int:
    """Bytes of a code unit."""
    name = encoding.lower().replace("_", "-")
    return 2 if name.startswith("utf-16") else 4 if name.startswith("utf-32") else 1


def _line_end(data: bytes, at: int, encoding: str) -> int | None:
    """The last place up to ``at``, after the first unit, that follows a line end: \\n, or \\r without \\n."""
    unit = _unit(encoding)
    order = "big" if encoding.lower().endswith("be") else "little"
    feed, back = ((10).to_bytes(unit, order), (13).to_bytes(unit, order))
    last = 0
    for end in (feed, back):
        place = data.rfind(end, 0, at)
        while place >= 0 and (place % unit or end == back and data[place + unit : place + 2 * unit] == feed):
            place = data.rfind(end, 0, place + unit - 1)
        last = max(last, place + unit if place >= 0 else 0)
    return last or None


def _character(data: bytes, at: int, encoding: str) -> int:
    """The last character boundary up to ``at``; of multibyte encodings other than Unicode's any byte is taken for one."""
    unit = _unit(encoding)
    at -= at % unit
    if unit == 2 and 2 <= at < len(data):
        high = data[at if encoding.lower().endswith("be") else at + 1]
        return at - 2 if 0xDC <= high < 0xE0 else at
    if encoding.lower().replace("_", "-") in ("utf-8", "utf8"):
        while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
            at -= 1
    return at


class _Windows(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.encoding = options.get("encoding", "utf-8")
        self.behind = int(options.get("lookBehind", LOOK_BEHIND))
        unit = 4 * _unit(self.encoding)
        self.stride = (int(options.get("windowBytes", WINDOW_BYTES)) - self.behind) // unit * unit
        if self.behind < 4 or self.stride < unit:
            raise ValueError("lookBehind has at least 4 bytes, and windowBytes some more")

    def partitions(self):
        run = max(1, TASK_BYTES // self.stride)
        counted = ((p, max(1, -(-p.size // self.stride))) for p in _files(self.path))
        return [_Piece(p.path, p.size, p.mtime, i, min(run, n - i)) for p, n in counted for i in range(0, n, run)]

    def _cut(self, file, at: int, size: int) -> tuple[int, bool]:
        """Where the cut of a multiple of the stride lies, and whether a line ends there."""
        if at <= 0 or at >= size:
            return max(0, min(at, size)), True
        first = max(0, at - self.behind)
        first -= first % _unit(self.encoding)
        file.seek(first)
        data = file.read(at - first + 4)
        found = _line_end(data, at - first, self.encoding)
        return (first + found, True) if found is not None else (first + _character(data, at - first, self.encoding), False)

    def read(self, partition):
        system, inner = _system(partition.path)
        with system.open_input_file(inner) as file:
            start, _ = self._cut(file, partition.window * self.stride, partition.size)
            for window in range(partition.window, partition.window + partition.windows):
                end, closed = self._cut(file, (window + 1) * self.stride, partition.size)
                file.seek(start)
                yield partition.path, window, start, end, partition.size, closed, file.read(end - start)
                start = end


class TextWindows(DataSource):
    """Format ``text_windows``: path, window (from 0), start_byte, end_byte, byte_length of the file, whether a line
    (or the file) ends with the window, and its bytes: at most windowBytes. Options: path, windowBytes, lookBehind,
    encoding. An empty file gives one empty window. A line longer than lookBehind may be cut between characters."""

    @classmethod
    def name(cls):
        return "text_windows"

    def schema(self):
        return "path string, window long, start_byte long, end_byte long, byte_length long, closed boolean, bytes binary"

    def reader(self, schema):
        return _Windows(self.options)


class _Hashes(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        return _files(self.path)

    def read(self, partition):
        system, inner = _system(partition.path)
        digest, n = hashlib.sha256(), 0
        with system.open_input_stream(inner) as file:
            while data := file.read(BUFFER_BYTES):
                digest.update(data)
                n += len(data)
        now = system.get_file_info(inner)
        stable = n == partition.size == now.size and now.mtime_ns == partition.mtime
        yield partition.path, n, digest.hexdigest(), stable


class FileHashes(DataSource):
    """Format ``file_hashes``: path, byte_length, sha256, and whether the file stayed the same meanwhile."""

    @classmethod
    def name(cls):
        return "file_hashes"

    def schema(self):
        return "path string, byte_length long, sha256 string, stable boolean"

    def reader(self, schema):
        return _Hashes(self.options)


def windows(spark: SparkSession, path: str, window_bytes: int = WINDOW_BYTES, look_behind: int = LOOK_BEHIND, encoding: str = "utf-8") -> DataFrame:
    spark.dataSource.register(TextWindows)
    read = spark.read.format("text_windows").option("path", path).option("windowBytes", window_bytes).option("lookBehind", look_behind)
    return read.option("encoding", encoding).load().filter(is_text_name(F.regexp_extract("path", r"[^/]*$", 0)))


def hashes(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(FileHashes)
    return spark.read.format("file_hashes").option("path", path).load().filter(is_text_name(F.regexp_extract("path", r"[^/]*$", 0)))


def read_range(windowed: DataFrame, start: Column, size: Column, behind: Column) -> DataFrame:
    """path, start_byte and bytes: of every file the bytes from ``behind`` before ``start`` to ``size`` after it, as far as
    there are any. Columns may use the file's byte_length. Only windows that the range meets are put together."""
    first, last = F.greatest(F.lit(0), start - behind), F.least(F.col("byte_length"), start + size)
    met = windowed.withColumns({"_first": first, "_last": last}).filter((F.col("start_byte") < F.col("_last")) & (F.col("end_byte") > F.col("_first")))
    low = F.greatest(F.col("_first"), F.col("start_byte"))
    part = F.substring(F.col("bytes"), (low - F.col("start_byte") + 1).cast("int"), (F.least(F.col("_last"), F.col("end_byte")) - low).cast("int"))
    pieces = F.sort_array(F.collect_list(F.struct(F.col("window"), part.alias("part"))))
    joined = F.aggregate(pieces, F.lit(b""), lambda a, x: F.concat(a, x["part"]))
    return met.groupBy("path", F.col("_first").alias("start_byte")).agg(joined.alias("bytes"))


def faults(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """path and fault of the files of ``manifest`` (path, byte_length, sha256) against :func:`hashes`: missing, changing,
    length or hash; files without a fault are left out."""
    m = manifest.select("path", F.col("byte_length").alias("_length"), F.col("sha256").alias("_hash"))
    fault = (
        F.when(F.col("sha256").isNull(), "missing").when(~F.col("stable"), "changing")
        .when(~F.col("byte_length").eqNullSafe(F.col("_length")), "length").when(~F.col("sha256").eqNullSafe(F.col("_hash")), "hash")
    )
    return m.join(found, "path", "left").select("path", fault.alias("fault")).filter("fault IS NOT NULL")


def parts(windowed: DataFrame, book_id: Column | None = None, encoding: str = "utf-8") -> DataFrame:
    """Windows as the parts of books (book_id, part, text, valid): a file is a book unless ``book_id`` says otherwise. Text that
    its encoding doesn't allow has replacement characters, and isn't valid."""
    data = F.col("bytes")
    name = encoding.upper().replace("_", "-")
    text = F.decode(data, name) if name != "UTF-8" else F.make_valid_utf8(data.cast("string"))
    valid = F.is_valid_utf8(data.cast("string")) if name == "UTF-8" else F.encode(F.decode(data, name), name) == data
    return windowed.select((F.col("path") if book_id is None else book_id).alias("book_id"), F.col("window").alias("part"), text.alias("text"), valid.alias("valid"))
