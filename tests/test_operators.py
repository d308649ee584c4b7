"""Operators on the golden inputs and against brute force."""

import random

import pytest
from chaptermill.functions import encoding, hashing
from chaptermill.functions import text as T
from chaptermill.operators import catalog, commands, intervals, lengths, lineage, ordered, review, structure, tasks
from chaptermill.sources import text_files as files
from pyspark.sql import functions as F


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


HEADINGS = [
    ("\t\u3000第一章\u3000启程  ", "第一章 启程"),
    ("第一章 山边小村", "第一章 山边小村"),
    ("序章", "序章"),
    ("番外 三：归途", "番外 三：归途"),
    ("Chapter XIV - Return", "Chapter XIV - Return"),
    ("这不是章节标题", None),
    ("第一章这是无分隔正文", None),
    ("第一章 " + "甲" * 120, None),
    ("番外 三丑", None),
    ("", None),
    ("第一章\u0085", None),
]


def test_headings(spark):
    rows = frame(spark, HEADINGS, "line string, title string")
    got = rows.select("line", "title", F.when(T.is_heading(F.col("line")), T.heading_title(F.col("line"))).alias("found")).collect()
    assert all(r.title == r.found for r in got), [r for r in got if r.title != r.found]


IMPORT = "书名\r\n作者\u00a0甲\r\n\r\n\u3000第一章\u3000启程  \r\n内容甲😀\r\nChapter II - Return\n内容乙\n"


def test_chapters_of_an_import(spark):
    parts = frame(spark, [("b", 0, IMPORT)], "book_id string, part long, text string")
    text = IMPORT.replace("\r\n", "\n").replace("\u00a0", " ").encode()
    got = structure.chapters(parts).orderBy("ord").collect()
    assert [r.title for r in got] == ["第一章 启程", "Chapter II - Return"]
    assert text[got[0].heading_start : got[0].heading_end].decode() == "第一章\u3000启程"
    assert text[got[0].content_start : got[0].content_end].decode() == "内容甲😀\n"
    books = structure.book_sizes(parts)
    segments = intervals.implicit_coverage(structure.chapters(parts).withColumn("chapter_id", F.col("title")), books).orderBy("start_byte").collect()
    assert [s.reason for s in segments] == ["uncovered-to-next", None, None]
    assert segments[0].start_byte == 0 and segments[-1].end_byte == len(text)


def brute_chapters(parts):
    import re

    out = []
    for book in sorted({b for b, _, _ in parts}):
        at, found = 0, []
        for _, _, t in sorted(p for p in parts if p[0] == book):
            t = re.sub("\r\n?", "\n", t or "").replace("\u00a0", " ")
            lines = t.split("\n")
            for line in lines[:-1] if lines[-1] == "" else lines:
                size = len(line.encode())
                if re.match(r"(?i)chapter\s+\d+(\s|$)", line.strip()):
                    lead = len(line.encode()) - len(line.lstrip().encode())
                    found.append((at, at + lead, at + lead + len(line.strip().encode()), at + size + 1))
                at += size + 1
        for i, (_, s, e, body) in enumerate(found):
            out.append((book, i + 1, s, e, body, found[i + 1][0] if i + 1 < len(found) else at))
    return sorted(out)


def test_chapters_across_parts(spark):
    rng = random.Random(5)
    parts = []
    for book in "xyz":
        for part in rng.sample(range(40_000), 60):
            lines = [rng.choice(["", "plain é text", "  Chapter 3 a", "chapter 12", "no chapter", "中文"]) for _ in range(rng.randint(0, 5))]
            parts.append((book, part, rng.choice(["\n", "\r\n", "\r"]).join(lines)))
    df = frame(spark, parts, "book_id string, part long, text string")
    got = structure.chapters(df).select("book_id", "ord", "heading_start", "heading_end", "content_start", "content_end").collect()
    assert sorted(tuple(r) for r in got) == brute_chapters(parts)


CHAPTERS = "book_id string, ord int, chapter_id string, heading_start long, heading_end long, content_start long, content_end long"
COVERAGE = [
    (100, [(10, 20, 20, 40), (50, 60, 60, 80)], None, [(0, 10, "c1", "uncovered-to-next"), (10, 40, "c1", None), (40, 50, "c2", "uncovered-to-next"), (50, 80, "c2", None), (80, 100, "c2", "uncovered-to-last")]),
    (12, [(None, None, 5, 5), (5, 8, 8, 12)], None, [(0, 5, "c1", "uncovered-to-next"), (5, 12, "c2", None)]),
    (12, [(0, 2, 2, 5), (None, None, 8, 12)], [(5, 8)], [(0, 5, "c1", None), (5, 8, None, None), (8, 12, "c2", None)]),
    (5, [(None, None, 0, 0), (0, 2, 2, 5)], [], [(0, 5, "c2", None)]),
    (7, [], None, [(0, 7, None, None)]),
]


@pytest.mark.parametrize("total, chaps, holes, want", COVERAGE)
def test_coverage(spark, total, chaps, holes, want):
    chapters = frame(spark, [("b", i + 1, f"c{i + 1}", *c) for i, c in enumerate(chaps)], CHAPTERS)
    books = frame(spark, [("b", total)], "book_id string, total long")
    if holes is None:
        got = intervals.implicit_coverage(chapters, books)
    else:
        got = intervals.explicit_coverage(chapters, books, frame(spark, [("b", *h) for h in holes], "book_id string, start_byte long, end_byte long"))
        report = intervals.coverage_report(got, books).first()
        assert report.unclassified == sum(e - s for s, e in holes) and report.complete == (not holes)
    assert sorted((r.start_byte, r.end_byte, r.chapter_id, r.reason) for r in got.collect()) == want
    assert intervals.tiling_faults(got, books).count() == 0


def test_subtract_and_islands_against_a_mask(spark):
    rng = random.Random(1)
    ranges = [(b, s, s + rng.randint(0, 40), i) for i, b in enumerate("ab" * 60) for s in [rng.randint(0, 300)]]
    holes = [(b, s, s + rng.randint(0, 9)) for b in "ab" for s in rng.sample(range(340), 30)]
    r = frame(spark, ranges, "book_id string, start_byte long, end_byte long, id int")
    h = frame(spark, holes, "book_id string, start_byte long, end_byte long")
    masked = {b: {x for k, s, e in holes if k == b for x in range(s, e)} for b in "ab"}
    got = intervals.subtract(r, h, ["book_id"], bin_size=16).collect()
    for b, s, e, i in ranges:
        mine = sorted((g.start_byte, g.end_byte) for g in got if g.id == i)
        assert {x for p, q in mine for x in range(p, q)} == set(range(s, e)) - masked[b]
        assert all(q < p2 for (_, q), (p2, _) in zip(mine, mine[1:], strict=False))
    for b in "ab":
        merged = sorted((x.start_byte, x.end_byte) for x in intervals.islands(h, ["book_id"], width=32).filter(F.col("book_id") == b).collect())
        assert {x for p, q in merged for x in range(p, q)} == masked[b] and all(q < p for (_, q), (p, _) in zip(merged, merged[1:], strict=False))
    pairs = {(x.l_id, x.r_start_byte, x.r_end_byte) for x in intervals.overlap_join(r, h, ["book_id"], 16).collect()}
    assert pairs == {(i, p, q) for b, s, e, i in ranges for k, p, q in holes if k == b and s < q and p < e and s < e and p < q}


def test_overlap_join_of_wide_ranges(spark):
    """One range over 2^40 bytes, others of every width and on both sides of zero, against 100,000 short ones; a range makes
    rows by the logarithm of its bins, whatever it covers."""
    rng = random.Random(4)
    wide = [("a", 0, 1 << 40, 0), ("a", 7, 1 << 30, 1), ("a", -900, 900, 2), ("b", 5, 5, 3), ("b", 1 << 20, (1 << 20) + 1, 4), *[("b", s, s + (1 << k) + rng.randint(-1, 1), 5 + k) for k in range(1, 38) for s in [rng.randint(-(1 << k), 1 << 38)]]]
    short = [("ab"[i % 2], s, s + rng.randint(0, 300), i) for i in range(100_000) for s in [rng.randint(-5000, (1 << 40) - 1) if i % 3 else rng.randint(-2000, 2000)]]
    schema = "book_id string, start_byte long, end_byte long, id int"
    w, n = frame(spark, wide, schema), frame(spark, short, schema)
    for first, second, l, r in ((w, n, wide, short), (n, w, short, wide)):
        got = [(x.l_id, x.r_id) for x in intervals.overlap_join(first, second, ["book_id"], 256).collect()]
        assert sorted(got) == sorted((x[3], y[3]) for x in l for y in r if x[0] == y[0] and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2])
    bins = [(0, 0), (0, (1 << 32) - 1), (1, (1 << 32) - 2), (-5, 4), (-3, 1 << 50), (-(1 << 40), -7)]
    cut = frame(spark, bins, "f long, l long").select("f", "l", F.expr(intervals.nodes("f", "l")).alias("n")).collect()
    for c in cut:
        blocks = sorted((x.node << x.level, (x.node + 1) << x.level) for x in c.n)
        assert blocks[0][0] == c.f and blocks[-1][1] == c.l + 1 and all(p[1] == q[0] for p, q in zip(blocks, blocks[1:], strict=False))
        assert len(blocks) <= 2 * (c.l - c.f + 1).bit_length()
    assert intervals.overlap_join(w.limit(0), n, ["book_id"], 256).count() == intervals.overlap_join(n, w.limit(0), ["book_id"], 256).count() == 0


def test_impact_tells_sets_apart(spark):
    """Equal sets in any order and with repeats give equal impacts, others don't; a revision nobody depends on has none."""
    edges = [(1, "a"), (1, "b"), (1, "b"), (2, "b"), (2, "a"), (3, "a"), (4, "c"), (4, "a"), *[(5, f"r{i}") for i in range(3000)], *[(6, f"r{i}") for i in range(2999, -1, -1)]]
    hit = frame(spark, edges, "producer_revision_id long, consumer_revision_id string")
    asked = frame(spark, [(k, k) for k in range(1, 8)], "key long, revision_id long")
    got = {r.key: (r.affected, r.requires_confirmation) for r in commands.previews(asked, hit).collect()}
    assert got[1] == got[2] and got[5] == got[6] and len({got[k][0] for k in (1, 3, 4, 5, 7)}) == 5
    assert [got[k][0].n for k in (1, 3, 5, 7)] == [2, 1, 3000, 0] and [got[k][1] for k in (1, 7)] == [True, False]
    assert spark.range(1).select(commands.no_impact().alias("x")).first().x == got[7][0]


def test_latest_limits_before_it_shuffles(spark):
    rows = frame(spark, [(i % 3, i // 9, i % 9) for i in range(900)], "k long, t long, n long")
    first = catalog.latest(rows.repartition(5), ["k"], [F.desc("t"), F.asc("n")])
    assert sorted((r.k, r.t, r.n) for r in first.collect()) == [(0, 99, 0), (1, 99, 1), (2, 99, 2)]
    assert "WindowGroupLimit" in first._jdf.queryExecution().toString()


def test_along_equals_plain_windows(spark):
    rng = random.Random(2)
    rows = [(g, o, rng.randint(0, 9)) for g in "pq" for o in rng.sample(range(-500, 5000), 200)]
    got = ordered.along(frame(spark, rows, "g string, o long, v int"), ["g"], "o", 64, totals={"sum": F.col("v")}, before={"last": "v"}, after={"next": "v"}).collect()
    for g in "pq":
        mine = sorted((o, v) for k, o, v in rows if k == g)
        for i, (o, _) in enumerate(mine):
            r = next(x for x in got if x.g == g and x.o == o)
            assert (r.sum, r.last, r.next) == (sum(v for _, v in mine[:i]), mine[i - 1][1] if i else None, mine[i + 1][1] if i + 1 < len(mine) else None)


ANOMALIES = [
    ([1, *[10] * 6, 100], {1: "short", 8: "long"}),
    ([*[1000] * 3, 400, *[1000] * 5, 2500, *[1000] * 3], {4: "short", 10: "long"}),
    ([*[1000] * 5, 2500, 2500, *[1000] * 5], {6: "long", 7: "long"}),
    ([*[10] * 32, *[24] * 8], {}),
    ([25 if i == 5 else 10 if i < 12 else 30 for i in range(24)], {}),
    ([1000 + 100 * i for i in range(16)], {}),
    ([*[1000] * 6, *[2400] * 6], {}),
    ([0, 2, 5], {1: "empty"}),
]


def test_length_anomalies(spark):
    rows = [(str(k), i + 1, n, False) for k, (ns, _) in enumerate(ANOMALIES) for i, n in enumerate(ns)] + [("accepted", i + 1, n, i == 0) for i, n in enumerate([1, 1, 1, 1, 1, 2])]
    got = lengths.anomalies(frame(spark, rows, "book string, ord int, length long, accepted boolean"), "book", "ord").collect()
    for k, (_, want) in enumerate(ANOMALIES):
        assert {r.ord: r.kind for r in got if r.book == str(k)} == want
    assert {r.ord: r.kind for r in got if r.book == "accepted"} == {6: "long"}


def test_local_spread_in_stretches(spark, monkeypatch):
    rng = random.Random(7)
    rows = [("b", i * 3, rng.randint(0, 40)) for i in range(60)]
    df = frame(spark, rows, "book string, ord int, length long")
    whole = {r.ord: (r.n_near, r.center, r.spread) for r in lengths.local_spread(df, "book", "ord").collect()}
    monkeypatch.setattr(lengths, "WIDTH", 16)
    assert {r.ord: (r.n_near, r.center, r.spread) for r in lengths.local_spread(df, "book", "ord").collect()} == whole
    assert len(whole) == 60 and max(n for n, _, _ in whole.values()) <= 11


def test_counting_and_offsets(spark):
    text = "甲😀\u3000e\u0301\u0085\n"
    row = frame(spark, [(text,)], "t string").select(
        T.visible_length(F.col("t")).alias("n"), *[T.utf16_to_byte(F.col("t"), F.lit(i)).alias(f"u{i}") for i in (0, 1, 2, 3)], T.byte_to_utf16(F.col("t"), F.lit(4)).alias("b4"), T.byte_to_utf16(F.col("t"), F.lit(7)).alias("b7")
    ).first()
    assert tuple(row) == (4, 0, 3, None, 7, None, 3)


def test_slices(spark):
    data = F.lit("a甲😀b").cast("binary")
    one = spark.range(1)
    cut = lambda s, e, cap=100: tuple(one.select(T.slice_bytes(data, F.lit(s), F.lit(e), cap).alias("s")).first().s)
    assert cut(0, 4) == (True, "a甲", 4, True)
    assert cut(0, 9, 6) == (True, "a甲", 4, False)
    assert cut(2, 4)[0] is False and cut(4, 1)[0] is False and cut(0, 10)[0] is False
    assert cut(9, 9) == (True, "", 9, True)


def ends_of_units(old, new):
    """(prefix, suffix) by lists of UTF-16 units."""
    units = lambda t: [int.from_bytes(t.encode("utf-16-be")[i : i + 2]) for i in range(0, 2 * (len(t.encode("utf-16-be")) // 2), 2)]
    p, q = units(old), units(new)
    split = lambda at: 0 < at < len(p) and 0xD800 <= p[at - 1] < 0xDC00 <= p[at] < 0xE000
    n = min(len(p), len(q))
    prefix = next((i for i in range(n) if p[i] != q[i]), n)
    suffix = next((i for i in range(n - prefix) if p[-1 - i] != q[-1 - i]), n - prefix)
    return prefix - split(prefix), suffix - (suffix > 0 and split(len(p) - suffix))


def test_common_ends(spark):
    rng = random.Random(3)
    pairs = [("abcXdef", "abcYYdef"), ("same", "same"), ("😀", "😁"), ("", "x"), (None, "x"), ("😀", "😁😀"), ("a🀀", "a😀"), ("x" * 5000 + "a" + "y" * 7000, "x" * 5000 + "b" + "y" * 7000)]
    pairs += [tuple("".join(rng.choices("ab😀😁🀀é", k=rng.randrange(0, 7))) for _ in "ab") for _ in range(400)]
    rows = frame(spark, [(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", T.common_ends(F.col("a"), F.col("b")).alias("c"), T.minimal_change(F.col("a"), F.col("b")).alias("m"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    for r in rows.collect():
        old, new = (x or "" for x in pairs[r.i])
        assert tuple(r.c) == ends_of_units(old, new), pairs[r.i]
        raw = old.encode("utf-16-be")
        assert (raw[: 2 * r.m.start] + r.m.insert.encode("utf-16-be") + raw[2 * r.m.end :]).decode("utf-16-be") == new


def test_positions_through_a_change(spark):
    change = F.struct(F.lit(3).alias("start"), F.lit(6).alias("end"), F.lit("x😀").alias("insert"))
    insertion = F.struct(F.lit(3).alias("start"), F.lit(3).alias("end"), F.lit("xy").alias("insert"))
    places = spark.range(8).select("id", *[T.map_position(F.col("id"), c, after) for c in (change, insertion) for after in (False, True)]).orderBy("id").collect()
    assert [tuple(r)[1:] for r in places] == [(0, 0, 0, 0), (1, 1, 1, 1), (2, 2, 2, 2), (3, 3, 3, 5), (3, 6, 6, 6), (3, 6, 7, 7), (6, 6, 8, 8), (7, 7, 9, 9)]


def test_search(spark):
    rows = frame(spark, [("The theme. the; 1+1=2 one",)], "t string")
    n = lambda p: rows.select(T.match_count(F.col("t"), p)[0]).first()[0]
    assert n(T.match_pattern("the")) == 3 and n(T.match_pattern("the", case=True)) == 2
    assert n(T.match_pattern("the", whole_word=True)) == 2 and n(T.match_pattern("1+1")) == 1 and n(T.match_pattern("o.e", regexp=True)) == 1


def test_encodings(spark):
    cases = [("第一章 开始\n简体正文", "gb2312"), ("第一章 开始\n简体正文", "gbk"), ("第一章 开始\n扩展字符\U00020000", "gb18030"), ("第一章 開始\n繁體正文", "big5"), ("第一章 开始\n正文", "utf-16le"), ("第一章 开始\n正文", "utf-16be")]
    codec = {"utf-16le": "utf-16-le", "utf-16be": "utf-16-be"}
    rows = [(bytearray(t.encode(codec.get(e, e))), e, t) for t, e in cases]
    df = frame(spark, rows, "data binary, choice string, want string").withColumn("hash", F.sha2("data", 256))
    got = df.select("want", encoding.decode_choice(F.col("data"), F.col("choice"), F.col("hash")).alias("d")).collect()
    assert all(r.d.text == r.want and r.d.method == "user" for r in got)
    bad = frame(spark, [(bytearray(b"\x81"), "gbk"), (bytearray(b"\xff\x61\x00"), "utf-16le"), (bytearray("a\0b".encode("utf-16-le")), "utf-16le")], "data binary, choice string").withColumn("hash", F.sha2("data", 256))
    assert [r.d.error for r in bad.select(encoding.decode_choice(F.col("data"), F.col("choice"), F.col("hash")).alias("d")).collect()] == ["decode-failed", "decode-failed", "binary-nul"]
    probes = frame(spark, [(bytearray(b),) for b in (b"", b"\xff\xfe\0\0a", b"\xef\xbb\xbfok", b"ok", b"\xff\xfeo\0", b"\xff\xfeo", b"\xa1", b"a\0", b"a\0\0")], "data binary")
    got = [(r.p.status, r.p.encoding, r.p.reason) for r in probes.select(encoding.probe(F.col("data")).alias("p")).collect()]
    assert got == [
        ("rejected", None, "empty"), ("rejected", None, "utf-32"), ("confirmed", "utf-8", None), ("confirmed", "utf-8", None), ("confirmed", "utf-16le", None),
        ("rejected", None, "decode-failed"), ("selection-required", None, None), ("selection-required", None, None), ("rejected", None, "binary-nul"),
    ]


def test_json_and_ids(spark):
    import hashlib
    import json

    value = 'q"\\\n\x0b\x1f\x7f甲'
    want = json.dumps({"namespace": "chapter", "sourceHash": "h", "startByte": 1, "endByte": 2, "content": value}, ensure_ascii=False, separators=(",", ":"))
    got = spark.range(1).select(hashing.stable_id("chapter", F.lit("h"), F.lit(1), F.lit(2), F.lit(value))).first()[0]
    assert got == "chapter-" + hashlib.sha256(want.encode()).hexdigest()[:32]
    assert spark.range(1).select(hashing.command_hash(b=F.lit(1), a=F.lit("x"), c=F.lit(None).cast("string"))).first()[0] == hashlib.sha256(b'{"a":"x","b":1}').hexdigest()


def test_insertions(spark):
    row = spark.range(1).select(review.with_breaks(F.lit("甲乙ab").cast("binary"), F.array(F.lit(6), F.lit(3), F.lit(3))).alias("t"), *[review.before_insertions(F.lit(i), F.array(F.lit(6), F.lit(3))).alias(f"b{i}") for i in (0, 3, 4, 7, 8, 9)]).first()
    assert tuple(row) == ("甲\n乙\nab", 0, 3, 3, 6, 6, 7)


def test_boundary_edits_clamp_and_release(spark):
    chapters = frame(spark, [("b", 1, "c1", 0, 2, 2, 10), ("b", 2, "c2", 10, 12, 12, 20), ("b", 3, "c3", 20, 22, 22, 30)], CHAPTERS)
    run = lambda edits: {r.ord: (r.heading_start, r.content_end) for r in review.boundary_edits(chapters, frame(spark, edits, "book_id string, seq int, ord int, side string, at long")).collect()}
    assert run([("b", 1, 1, "end", 11)]) == {1: (0, 11), 2: (11, 20), 3: (20, 30)}
    assert run([("b", 1, 1, "end", 11), ("b", 2, 2, "start", 9)]) == {1: (0, 9), 2: (9, 20), 3: (20, 30)}
    assert run([("b", 1, 1, "end", 11), ("b", 2, 2, "start", 9), ("b", 3, 2, "start", 11)]) == {1: (0, 11), 2: (11, 20), 3: (20, 30)}


def test_draft_ids(spark):
    ids = frame(spark, [("a", "draft-chapter-1"), ("a", "draft-chapter-3"), ("b", "chapter-9"), ("c", "draft-chapter-2")], "book_id string, chapter_id string")
    assert {r.book_id: r.k for r in review.unused_draft_id(ids).collect()} == {"a": 2, "b": 1, "c": 1}


def test_stale_propagation_is_one_hop(spark):
    revisions = frame(spark, [("r1", "a1", "structure", "current"), ("r2", "a2", "structure", "current"), ("r3", "a3", "x", "superseded")], "revision_id string, artifact_id string, artifact_type string, validity_status string")
    edges = frame(spark, [("r1", "p"), ("r2", "r1"), ("r3", "p")], "consumer_revision_id string, producer_revision_id string").withColumn("dependency_type", F.lit("chapter-selection"))
    stale, causes = lineage.propagate(edges, revisions, frame(spark, [("p", "p2")], "producer_revision_id string, current_revision_id string"))
    assert {r.revision_id: r.validity_status for r in stale.collect()} == {"r1": "stale", "r2": "current", "r3": "superseded"}
    assert [(c.consumer_revision_id, c.status) for c in causes.collect()] == [("r1", "active")]


def test_catalog_order_and_upsert(spark):
    schema = "project_id string, directory_path string, last_opened_at string"
    held = frame(spark, [("b", "/1", "2024-01-02"), ("a", "/2", "2024-01-02"), ("c", "/3", "2024-01-03")], schema)
    assert [r.project_id for r in catalog.recent(held).collect()] == ["c", "a", "b"]
    got = catalog.upsert_project(held, frame(spark, [("d", "/1", "2024-02-01"), ("c", "/4", "2024-02-02")], schema))
    assert {r.project_id: r.directory_path for r in got.collect()} == {"a": "/2", "c": "/4", "d": "/1"}


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from chaptermill.plans.queries import _task_events
    from chaptermill.streaming import tasks as streaming

    events = _task_events(spark, sf_dir).withColumn("occurred_at", F.timestamp_seconds("occurred_at")).withColumn("updated_at", F.col("occurred_at"))
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = streaming.event_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    streaming.to_table(streaming.latest_states(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = catalog.latest(spark.read.parquet(str(tmp_path / "out")).drop("batch"), ["task_id"], [F.desc("sequence"), F.desc("attempt")])
    want = tasks.latest_state(events)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_sources(spark, tmp_path):
    import json

    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.TXT").write_bytes(b"hello")
    (tmp_path / "t" / "b.md").write_bytes(b"no")
    rows = files.assets(spark, str(tmp_path / "t"))
    row = rows.withColumn("w", files.window(F.col("content"), F.lit(2), F.lit(2), F.lit(1))).withColumn("x", files.exact(F.col("content"), F.lit(3), F.lit(5))).collect()
    assert len(row) == 1 and row[0].name == "a.TXT" and bytes(row[0].w) == b"ell" and row[0].x is None and row[0].byte_length == 5
    uuid = "123e4567-e89b-42d3-a456-426614174000"
    good = {"schemaVersion": 2, "projectId": uuid, "createdAt": "2024-01-01T00:00:00.000Z", "sourceAsset": {"id": uuid, "originalName": "a.txt", "relativePath": f"inputs/source-assets/{uuid}/a.txt", "byteLength": 5, "sha256": "0" * 64}}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "1.json").write_text(json.dumps(good))
    (tmp_path / "m" / "2.json").write_text(json.dumps(good | {"projectId": "x", "sourceAsset": good["sourceAsset"] | {"relativePath": "elsewhere"}}))
    assert sorted(tuple(r.faults) for r in files.manifests(spark, str(tmp_path / "m")).collect()) == [(), ("project-id", "path")]


def test_preview_pages():
    from chaptermill.functions.preview import page_of

    text = "第一行\r\n第二行\r第三行\n第四行"
    for encoding, codec in (("utf-8", "utf-8"), ("utf-16le", "utf-16-le"), ("utf-16be", "utf-16-be"), ("gb18030", "gb18030")):
        data = text.encode(codec)
        for cap in (8, 9, 11, 14, 1000):
            at, read, done = 0, "", False
            while not done:
                page, end, done, error = page_of(data, encoding, at, 2, cap)
                assert error is None and end > at and not (page.endswith("\r") and text[len(read + page) :].startswith("\n"))
                at, read = end, read + page
            assert read == text
        assert page_of(data, encoding, 0, 2)[0] == "第一行\r\n第二行\r"
    assert page_of(b"ab", "utf-16le", 1, 1)[3] == "invalid-request" and page_of(b"\xff\xff\xff\xff\xff\xff", "utf-8", 0, 1)[3] == "decode-failed"
    assert page_of("\ufeffa".encode(), "utf-8", 0, 1) == ("a", 4, True, None)


def test_preview_sizes_and_joined_pages(spark):
    from chaptermill.functions import preview

    row = spark.range(1).select(
        preview.visible_lines(F.lit(0), F.lit(20)), preview.visible_lines(F.lit(101), F.lit(20)), preview.first_lines(F.lit(700)), preview.next_lines(F.lit(50), F.lit(10), F.lit(20)),
        preview.next_lines(F.lit(50), F.lit(-4000), F.lit(20)), preview.next_lines(F.lit(50), F.lit(40000), F.lit(20)), preview.should_fetch(F.lit(1000), F.lit(500), F.lit(400)),
    ).first()
    assert tuple(row) == (50, 6, 1000, 100, 400, 400, True)
    pages = frame(spark, [("a", 0, 3, "x", False), ("a", 3, 5, "y", True), ("b", 0, 3, "x", False), ("b", 4, 5, "y", True)], "k string, start_byte long, end_byte long, text string, done boolean")
    assert {r.k: (r.text, r.end_byte, r.complete) for r in preview.joined_pages(pages, ["k"]).collect()} == {"a": ("xy", 5, True), "b": ("xy", 5, False)}


def test_add_recognition(spark):
    chapters = frame(spark, [("b", 1, "c1", 0, 2, 2, 10), ("b", 2, "c2", 12, 14, 14, 20)], CHAPTERS).withColumn("title", F.lit("t")).withColumn("heading_kind", F.lit("source")).withColumn("accepted", F.lit(False))
    books = frame(spark, [("b", 25)], "book_id string, total long")
    holes = frame(spark, [("b", 10, 12)], "book_id string, start_byte long, end_byte long")
    schema = "book_id string, at long, line_start long, line_body_end long, line_end long, title string"
    run = lambda *click: review.add_recognition(chapters, holes, books, frame(spark, [("b", *click)], schema))
    spans = lambda df: [(r.ord, r.heading_start, r.heading_end, r.content_start, r.content_end) for r in df.orderBy("ord").collect()]
    done, left = run(5, 4, 6, 7, "New")
    assert spans(done) == [(1, 0, 2, 2, 4), (2, 4, 6, 7, 10), (3, 12, 14, 14, 20)] and left.count() == 1
    done, left = run(11, None, None, None, None)
    assert spans(done)[1] == (2, None, None, 11, 12) and [(r.start_byte, r.end_byte) for r in left.collect()] == [(10, 11)]
    done, _ = run(22, None, None, None, None)
    assert spans(done) == [(1, 0, 2, 2, 10), (2, 12, 14, 14, 22), (3, None, None, 22, 25)]
    assert spans(run(12, 12, 14, 15, "Again")[0]) == spans(chapters)


def test_range_faults_make_no_pairs(spark):
    rng = random.Random(5)
    chapters = [(b, i + 1, f"{b}{i}", *([None, None] if rng.random() < 0.3 else [rng.randint(0, 90), rng.randint(0, 90)]), rng.randint(0, 90), rng.randint(0, 90)) for b in "ab" for i in range(60)]
    chapters += [("c", 1, "c1", None, None, 5, 5), ("c", 2, "c2", None, None, 9, 9), ("c", 3, "c3", None, None, 20, 30), ("c", 4, "c4", None, None, 31, 40)]
    holes = [(b, rng.randint(0, 90), rng.randint(0, 90)) for b in "ab" for _ in range(3)] + [("c", 3, 9), ("c", 25, 25), ("c", 40, 41), ("c", 10, 20)]
    met = lambda s, e, u, v: None not in (s, e) and u < e and s < v
    want = {(c[0], c[1]) for c in chapters for b, u, v in holes if b == c[0] and (met(c[5], c[6], u, v) or met(c[3], c[4], u, v))}
    assert {("c", 1), ("c", 3)} <= want and not {("c", 2), ("c", 4)} & want
    ranges = frame(spark, holes, "book_id string, start_byte long, end_byte long")
    found = review.range_faults(frame(spark, chapters, CHAPTERS), ranges, frame(spark, [(b, 100) for b in "abc"], "book_id string, total long"))
    assert sorted((r.book_id, r.ord) for r in found.filter("fault = 'unassigned'").collect()) == sorted(want)
    # No join may compare ranges: within one book it would make every pair.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "start_byte" in line and " < " in line]
    content = frame(spark, [(c[0], c[1], c[5], c[6]) for c in chapters], "book_id string, ord int, start_byte long, end_byte long")
    got = intervals.any_overlap(content, ranges, ["book_id"], 16).collect()
    assert sorted((r.book_id, r.ord) for r in got) == sorted({(c[0], c[1]) for c in chapters for b, u, v in holes if b == c[0] and met(c[5], c[6], u, v)})


def _edited_one_by_one(chapters, edits):
    """What boundary_edits gives, edit by edit on lists."""
    out = {}
    for book in {c[0] for c in chapters}:
        rows = sorted((c for c in chapters if c[0] == book), key=lambda c: c[1])
        at, wins = {c[1]: i for i, c in enumerate(rows)}, {}
        start, end = [c[5] if c[3] is None else c[3] for c in rows], [c[6] for c in rows]
        for _, _, o, side, to in sorted((e for e in edits if e[0] == book and e[2] in at), key=lambda e: e[1]):
            i = at[o]
            if side == "start":
                start[i], wins[i - 1] = to, "after"
            else:
                end[i], wins[i] = to, "before"
        for i in range(len(rows) - 1):
            if end[i] > start[i + 1]:
                if wins.get(i) == "before":
                    start[i + 1] = end[i]
                else:
                    end[i] = start[i + 1]
        for i, c in enumerate(rows):
            s, e = start[i], max(start[i], end[i])
            he = None if c[3] is None else max(c[4], s)
            out[book, c[1]] = (None, None, s, e) if he is None else (s, he, max(c[5], he), max(e, he))
    return out


def test_boundary_edits_on_spark_like_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(ordered.along, "__defaults__", (8, None, None, None))
    rng = random.Random(11)
    chapters, edits = [], []
    for book in ("a", "b", "c", None):
        for i in range(40):
            chapters.append((book, 3 * i + 1, f"{book}{i}", *([10 * i, 10 * i + 2] if rng.random() < 0.7 else [None, None]), 10 * i + 2, 10 * i + rng.randint(4, 10)))
    for seq in range(150):
        i = rng.randint(0, 41)
        edits.append((rng.choice(["a", "b", "d", None]), seq, 3 * i + 1, rng.choice(["start", "end"]), 10 * i + rng.randint(-12, 20)))
    rng.shuffle(edits)
    found = review.boundary_edits(frame(spark, chapters, CHAPTERS), frame(spark, edits, "book_id string, seq int, ord int, side string, at long"))
    got = {(r.book_id, r.ord): (r.heading_start, r.heading_end, r.content_start, r.content_end) for r in found.collect()}
    assert got == _edited_one_by_one(chapters, edits)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan


def test_catalog_inserts_and_defaults(spark):
    held = frame(spark, [(1, "a")], "id long, name string")
    both = catalog.insert_missing(held, frame(spark, [(1, "b"), (2, "c")], "id long, name string"), ["id"])
    assert sorted((r.id, r.name) for r in both.collect()) == [(1, "a"), (2, "c")]
    assert [r.kind for r in catalog.with_default(held, "kind", "txt").collect()] == ["txt"]
    assert sorted(r.kind for r in catalog.with_default(frame(spark, [(1, None), (2, "md")], "id long, kind string"), "kind", "txt").collect()) == ["md", "txt"]


def test_routing_and_assets(spark):
    events = frame(spark, [(1, "s1", 7), (1, "s2", 8), (2, "s1", 9)], "project_id long, session_id string, sequence long")
    windows = frame(spark, [(1, "s1", "w")], "project_id long, session_id string, window string")
    assert [(r.sequence, r.window) for r in tasks.routed(events, windows).collect()] == [(7, "w")]
    manifest = frame(spark, [(str(i), (str(i), 5, "h")) for i in range(4)], "projectId string, sourceAsset struct<id:string,byteLength:long,sha256:string>")
    stored = frame(spark, [("0", 5, "h"), ("1", 6, "h"), ("2", 5, "x")], "id string, byte_length long, sha256 string")
    assert {r.id: r.fault for r in files.unmatched_assets(manifest, stored).collect()} == {"1": "length", "2": "hash", "3": "missing"}
    names = frame(spark, [("　 a b ﻿",), ("a\x07",), ("  ",), (None,)], "n string")
    assert [r.d for r in names.select(files.display_name(F.col("n")).alias("d")).collect()] == ["a b", None, None, None]


def test_first_starts_in_a_stream(spark, tmp_path):
    from chaptermill.streaming import tasks as streaming

    schema = "project_id long, input_fingerprint string, occurred_at timestamp"
    rows = frame(spark, [(1, "f", "2024-01-01 00:00:00"), (1, "f", "2024-01-01 01:00:00"), (1, "g", "2024-01-01 02:00:00"), (2, "f", "2024-01-01 03:00:00")], "project_id long, input_fingerprint string, at string")
    rows.select("project_id", "input_fingerprint", F.to_timestamp("at").alias("occurred_at")).write.parquet(str(tmp_path / "in"))
    firsts = streaming.first_starts(streaming.event_stream(spark, str(tmp_path / "in"), schema))
    firsts.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.project_id, r.input_fingerprint) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "f"), (1, "g"), (2, "f")]


def test_editor_positions_against_lists(spark):
    text = "a\r\nb😀\r\r\n\nc\r\n"
    units = text.encode("utf-16-be")
    low = [i for i in range(len(units) // 2) if 0xDC <= units[2 * i] <= 0xDF]
    rows = frame(spark, [(i, text) for i in range(-1, len(units) // 2 + 2)], "i int, t string")
    got = {r.i: (r.e, r.b) for r in rows.select("i", T.to_editor(F.col("t"), F.col("i")).alias("e"), T.from_editor(F.col("t"), T.to_editor(F.col("t"), F.col("i"))).alias("b")).collect()}
    for i in range(-1, len(units) // 2 + 2):
        if i < 0 or i > len(units) // 2 or i in low:
            assert got[i][0] is None
        else:
            assert got[i][0] == i - units[: 2 * i].decode("utf-16-be").count("\r\n")
            inside = units[2 * i - 2 : 2 * i + 2] == "\r\n".encode("utf-16-be")
            assert got[i][1] == i + inside


def test_running_starts(spark):
    for n in (0, 1, 2, 127, 128, 129, 400):
        values = [(7 * i) % 11 for i in range(n)]
        row = frame(spark, [(values,)], "v array<bigint>").select(T.running_starts(F.col("v")).alias("s")).first()
        assert row.s == [sum(values[:i]) for i in range(n)]


def test_headings_cut_like_lines(spark):
    """Cutting at headings finds the lines that the line rules call headings."""
    lines = [a for a, _ in HEADINGS] * 2 + ["番外", "三 x", "chapter", "12 y", "  序章", "x 序章", "第一章\x0b", "终章：z", "第" + "甲" * 30 + "章"]
    random.Random(3).shuffle(lines)
    for text in ("\n".join(lines), "\n".join(lines) + "\n", "\n\n".join(lines)):
        row = frame(spark, [(text,)], "t string").select(T.around_headings(T.normalize(F.col("t"))).alias("p")).first()
        assert "".join((p.piece or "") + (p.line or "") for p in row.p) == text.replace(" ", " ")
        found = frame(spark, [(p.line.rstrip("\n"),) for p in row.p if p.line], "l string").filter(T.is_heading(F.col("l"))).collect()
        want = frame(spark, [(x,) for x in text.split("\n")], "l string").filter(T.is_heading(F.col("l"))).collect()
        assert [r.l for r in found] == [r.l for r in want]


def test_neighbours_keep_rows_without_an_order(spark):
    rows = frame(spark, [("a", None), ("a", 1), ("a", 5000)], "g string, o long")
    assert sorted(((r.o, r.next_value, r.previous_value) for r in ordered.cyclic(rows, ["g"], "o", "o").collect()), key=str) == sorted([(None, 1, 5000), (1, 5000, 5000), (5000, 1, 1)], key=str)
