"""UTF-16 by built-in functions against Python's codecs."""

import random

import pytest
from chaptermill.functions import encoding
from pyspark.sql import functions as F

UNITS = ["a", "\n", "漢", "\x00", "é", "﻿", "퟿", "", "￿", "😀", "\U0010ffff", "Ā", "ÿ"]
BROKEN = [b"\xd8", b"\x00\xd8", b"\xd8\x00", b"\x00\xdc", b"\xdc\x00\xd8\x00", b"\x00\xd8\x00\xd8\x00\xdc", b"\x41", b"\x00"]


def strictly(data, codec):
    try:
        text = data.decode(codec, "strict")
    except UnicodeDecodeError:
        return None
    return text[1:] if text[:1] == "﻿" else text


def is_plausible(data):
    even, odd = b"\0" in data[::2], b"\0" in data[1::2]
    if not data or len(data) % 2 or even == odd:
        return False
    try:
        text = data.decode("utf-16-le" if odd else "utf-16-be", "strict")
    except UnicodeDecodeError:
        return False
    return "\0" not in text and text not in ("", "﻿")


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(6)
    found = [b"", b"\xff\xfe", b"\xfe\xff", ("long text 漢字 " * 3000).encode("utf-16-le"), ("😀" * 4000).encode("utf-16-be"), ("x" * 5000).encode("utf-16-be") + b"\xd8\x00", "ASCII only".encode("utf-16-le"), "ASCII only".encode("utf-16-be")]
    for _ in range(400):
        text = "".join(rng.choices(UNITS, k=rng.randrange(1, 9)))
        data = text.encode(rng.choice(["utf-16-le", "utf-16-be", "utf-8"]))
        found.append(data + rng.choice(BROKEN) if rng.random() < 0.4 else data)
        found.append(bytes(rng.choices([0, 0x41, 0xD8, 0xDC, 0xDF, 0xDB, 0x4E], k=rng.randrange(1, 9))))
    return found


def test_utf16_as_the_codecs(spark, samples):
    rows = spark.createDataFrame(list(enumerate(samples)), "i int, data binary")
    data = F.col("data")
    found = rows.select(
        "i", *[encoding.decode_unicode(data, F.lit(n)).alias(n.replace("-", "")) for n in ("utf-8", "utf-16le", "utf-16be")], encoding.plausible_utf16(data).alias("plausible")
    )
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        raw = samples[r.i]
        assert (r.utf8, r.utf16le, r.utf16be, r.plausible) == (strictly(raw, "utf-8"), strictly(raw, "utf-16-le"), strictly(raw, "utf-16-be"), is_plausible(raw)), raw[:40]


def test_probe_needs_no_python(spark, samples):
    probed = spark.createDataFrame([(d,) for d in samples], "data binary").select(encoding.probe(F.col("data")).alias("p"))
    assert "Python" not in probed._jdf.queryExecution().executedPlan().toString() and probed.filter("p.status IS NULL").count() == 0
