"""Alignment of two tokenizers against whole texts encoded by the libraries, and on odd inputs."""

import hashlib
import random
from collections import Counter

import pytest

from chaptermill.llm import alignment

SCHEMA = "doc_id long, text string"
TRICKY = [
    "plain words, it's 1984  two   spaces ",
    " leading", "   ", " ", "\n", "\n\n a\n b \n", "a\t b  c　 d", "x \x1c y\x1c z", "tail\n ", "tail  ",
    "<|endoftext|> and <s> or </s> <unk> <0x41>", "naïve café ŒŽ ß ﬁ ①②", "漢字かな交じり文と記号、 そして 空白", "👩‍👩‍👧‍👦 family 👍🏽", "zero​width ᠎ mongolian ﻿ bom",
    "NUL \x00 and \x7f del", "é combining", "a" * 5000 + " " + "b" * 3000, "ab " * 3000, " " * 700 + "z", "\r\n crlf\r\n", "under▁score", "▁", "",
]


@pytest.fixture(scope="module")
def tokenizers():
    pytest.importorskip("public_tokenizers")
    data = []
    for path in alignment.default_vocabularies():
        with open(path, "rb") as f:
            data.append(f.read())
    return alignment.Tokenizers(*data)


def measured_plainly(tokenizers, texts):
    """Whole texts encoded at once; groups and links from byte ranges."""
    aligned = []
    for text in texts:
        a = tokenizers.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tokenizers.b.encode(text) if text else []
        if text and not (" " + text).encode() == tokenizers.joined(a, b)[0] == tokenizers.joined(a, b)[1]:
            a, b = [], []
        spans = []
        for ids, size in ((a, tokenizers.a_size), (b, tokenizers.b_size)):
            at, side = 0, []
            for i in ids:
                side.append((at, at + size[i], i))
                at += size[i]
            spans.append(side)
        links = []
        j = 0
        for start, end, i in spans[0]:
            while j and spans[1][j - 1][1] > start:
                j -= 1
            while j < len(spans[1]) and spans[1][j][0] < end:
                if spans[1][j][1] > start:
                    links.append((i, spans[1][j][2]))
                j += 1
        shared = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = ["|".join(",".join(str(i) for s, e, i in side if low <= s and e <= high) for side in spans) for low, high in zip([0, *shared], shared, strict=False)] if len(a) < 4000 else None
        aligned.append((a, b, len(shared), links, groups))
    count = Counter(pair for *_, links, _ in aligned for pair in links)
    highest = {}
    for (_, b), n in count.items():
        highest[b] = max(highest.get(b, 0), n)
    rows = []
    for a, b, n, links, groups in aligned:
        digest = None if groups is None else hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        rows.append((len(a), len(b), n, len(links), sum(count[p] == highest[p[1]] for p in links), sum(count[p] for p in links), digest))
    return rows


def assert_aligned(spark, tokenizers, texts, partitions=3):
    frame = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(partitions)
    rows = {r.doc_id: r for r in alignment.alignments(frame).collect()}
    assert len(rows) == len(texts)
    for i, want in enumerate(measured_plainly(tokenizers, texts)):
        got = tuple(rows[i][c] for c in alignment.MEASURES)
        assert got[:6] == want[:6] and want[6] in (None, got[6]), (texts[i], got, want)


def test_alignment_of_documents(spark, tokenizers, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    assert_aligned(spark, tokenizers, texts)


def test_alignment_of_tricky_texts(spark, tokenizers):
    assert_aligned(spark, tokenizers, [*TRICKY, None, *TRICKY])


def test_stretches_encode_as_whole_texts(tokenizers):
    rng = random.Random(7)
    pieces = [" ", "  ", "\n", " \n", "\n ", "\t", " ", "\x1c", "᠎", "​", "a", "Word", "é", "漢", "12", "'s", "!?", "👍", "\x00", "_"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 25))) for _ in range(3000)]
    for text in texts:
        cut = alignment.stretches(text)
        assert " ".join(cut) == text
        a, b = tokenizers.a.encode(" " + text, add_special_tokens=False).ids, tokenizers.b.encode(text)
        parts = list(tokenizers.encode(cut))
        assert [i for x, _ in parts for i in x] == a and [i for _, y in parts for i in y] == b, text


def test_no_piece_holds_a_space_inside(tokenizers):
    assert not [p for p in tokenizers.b_bytes.values() if b" " in p.lstrip(b" ")]


def test_alignment_in_small_blocks(spark, tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 40)
    monkeypatch.setattr(alignment, "KNOWN", 5)
    rng = random.Random(3)
    assert_aligned(spark, tokenizers, [" ".join(rng.choices(["unbelievable", "straße", "tokenization", "x", "漢字"], k=9)) for _ in range(60)], 2)


def test_alignment_odd(spark, tokenizers):
    frame = spark.createDataFrame([(1, "same text", 5, "x"), (1, "same text", 5, "x"), (None, None, None, None), (2, "", 1, "")], "doc_id long, text string, n_links int, block string")
    rows = alignment.align(frame, *alignment.default_vocabularies())
    assert sorted(rows.columns) == sorted(["doc_id", "block", *alignment.MEASURES])
    got = sorted([(r.doc_id or 0, r.block, r.n_links, r.count_sum, r.groups_sha256 == "") for r in rows.collect()], key=str)
    assert got == sorted([(0, None, 0, 0, True), (1, "x", 2, 4, False), (1, "x", 2, 4, False), (2, "", 0, 0, True)], key=str)
    assert alignment.alignments(frame.limit(0)).collect() == []
