"""Files in byte windows against whole files."""

import hashlib
import random

import pytest
from chaptermill.operators import structure
from chaptermill.sources import windows
from pyspark.sql import functions as F


def read(spark, path, size, behind, encoding="utf-8"):
    return sorted(windows.windows(spark, str(path), size, behind, encoding).collect(), key=lambda r: (r.path, r.window))


@pytest.fixture
def book(tmp_path):
    rng = random.Random(5)
    lines = ["第一章 开始"] + ["".join(rng.choices("甲乙丙丁abc 😀é", k=rng.randrange(0, 60))) for _ in range(90)] + ["Chapter 2", "the end"]
    ends = [rng.choice(["\n", "\r\n", "\r"]) for _ in lines]
    text = "".join(a + b for a, b in zip(lines, ends, strict=True))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "book.txt").write_bytes(text.encode())
    (tmp_path / "empty.TXT").write_bytes(b"")
    (tmp_path / "other.md").write_bytes(b"no text file")
    (tmp_path / "_temporary").mkdir()
    (tmp_path / "_temporary" / "half.txt").write_bytes(b"not yet written")
    return tmp_path, text


@pytest.mark.parametrize("size, behind", [(700, 300), (1500, 1000), (10_000, 1000)])
def test_windows_tile_files_at_line_ends(spark, book, size, behind):
    folder, text = book
    data = text.encode()
    empty, *rows = read(spark, folder, size, behind)
    assert empty.path.endswith("empty.TXT") and empty.bytes == b"" and empty.byte_length == 0
    assert len(rows) == -(-len(data) // ((size - behind) // 4 * 4)) and len({r.path for r in rows}) == 1
    assert b"".join(bytes(r.bytes) for r in rows) == data and all(len(r.bytes) <= size and r.byte_length == len(data) for r in rows)
    assert [r.start_byte for r in rows] == [0, *[r.end_byte for r in rows[:-1]]] and rows[-1].end_byte == len(data)
    assert all(r.closed and (bytes(r.bytes).endswith((b"\n", b"\r")) or r.end_byte == len(data)) for r in rows)
    assert not any(bytes(a.bytes).endswith(b"\r") and bytes(b.bytes).startswith(b"\n") for a, b in zip(rows, rows[1:], strict=False))


def test_parts_of_windows_equal_the_whole_file(spark, book):
    folder, text = book
    parts = windows.parts(windows.windows(spark, str(folder / "sub"), 700, 300), F.lit("b"))
    whole = spark.createDataFrame([("b", 0, text)], "book_id string, part long, text string")
    columns = ["start_byte", "body_end_byte", "end_byte"]
    got, want = (sorted(tuple(r[c] for c in columns) for r in structure.lines(p).collect()) for p in (parts, whole))
    assert got == want and len(got) > 90
    assert sorted(map(tuple, structure.chapters(parts).collect())) == sorted(map(tuple, structure.chapters(whole).collect()))
    assert parts.count() > 3 and parts.filter("NOT valid").count() == 0


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16le", "utf-16be", "utf-32le"])
def test_lines_longer_than_a_window_are_cut_between_characters(spark, tmp_path, encoding):
    text = "é漢😀x" * 200
    (tmp_path / "long.txt").write_bytes(text.encode(encoding))
    rows = read(spark, tmp_path, 90, 30, encoding)
    assert "".join(bytes(r.bytes).decode(encoding) for r in rows) == text and len(rows) > 20
    assert [r.closed for r in rows] == [False] * (len(rows) - 1) + [True]


@pytest.mark.parametrize("encoding", ["utf-16le", "utf-16be"])
def test_windows_of_two_byte_units(spark, tmp_path, encoding):
    text = "ਊ਍abc\r\nĊ\rx\n" * 60  # U+0A0A and U+010A hold the byte of a line feed
    (tmp_path / "u.txt").write_bytes(text.encode(encoding))
    rows = read(spark, tmp_path, 160, 60, encoding)
    assert all(r.closed for r in rows) and "".join(bytes(r.bytes).decode(encoding) for r in rows) == text
    assert all(bytes(r.bytes).decode(encoding)[-1] in "\r\n" and not bytes(r.bytes).decode(encoding).startswith("\n") for r in rows)
    parts = windows.parts(windows.windows(spark, str(tmp_path), 160, 60, encoding), encoding=encoding).orderBy("part").collect()
    assert "".join(r.text for r in parts) == text and all(r.valid for r in parts)


def test_hashes_and_faults(spark, book):
    folder, text = book
    found = windows.hashes(spark, str(folder))
    rows = {r.path.rsplit("/", 1)[1]: r for r in found.collect()}
    assert set(rows) == {"book.txt", "empty.TXT"} and all(r.stable for r in rows.values())
    assert rows["book.txt"].sha256 == hashlib.sha256(text.encode()).hexdigest() and rows["book.txt"].byte_length == len(text.encode())
    good = rows["book.txt"]
    manifest = [(good.path, good.byte_length, good.sha256), (rows["empty.TXT"].path, 1, "x"), ("nowhere.txt", 1, "x")]
    wrong = spark.createDataFrame([*manifest, (good.path, good.byte_length, "0" * 64)], "path string, byte_length long, sha256 string")
    assert sorted(r.fault for r in windows.faults(wrong, found).collect()) == ["hash", "length", "missing"]


@pytest.mark.parametrize("start, size, behind", [(0, 10, 4), (650, 100, 200), (1000, 900, 1), (10**6, 5, 10**6), (5, 10**6, 0)])
def test_ranges_over_windows(spark, book, start, size, behind):
    folder, text = book
    data = text.encode()
    found = windows.read_range(windows.windows(spark, str(folder / "sub"), 700, 300), F.lit(start), F.lit(size), F.lit(behind)).collect()
    want = data[max(0, start - behind) : start + size]
    assert [bytes(r.bytes) for r in found] == ([want] if want else [])


def test_window_options_are_checked(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x")
    with pytest.raises(Exception, match="lookBehind"):
        windows.windows(spark, str(tmp_path), 100, 100).collect()


def test_a_task_reads_a_run_of_windows(spark, book):
    read_by = windows.windows(spark, str(book[0] / "sub"), 700, 300)
    assert read_by.count() > 3 and read_by.rdd.getNumPartitions() == 1


def test_lines_and_headings_are_found_once(spark, book):
    """What is derived of texts is stored, so its users don't read the texts again."""
    parts = spark.createDataFrame([("b", 0, book[1])], "book_id string, part long, text string")
    assert structure.line_index(parts).inputFiles() and structure.layout(parts).inputFiles()
