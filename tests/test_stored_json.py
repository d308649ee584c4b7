"""Canonical JSON against a plain writer with JavaScript's rules, and faults of stored previews and snapshots."""

import json
import random
import struct

import pytest
from chaptermill.functions import stored_json as S
from pyspark.sql import functions as F


def number(x):
    """As JavaScript writes a double."""
    x = float(x)
    if x == 0:
        return "0"
    mantissa, _, power = repr(abs(x)).partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    n = len(whole) + int(power or 0) - (len(whole + part) - len(digits))
    digits = digits.rstrip("0")
    k = len(digits)
    if k <= n <= 21:
        out = digits + "0" * (n - k)
    elif 0 < n <= 21:
        out = digits[:n] + "." + digits[n:]
    elif -6 < n <= 0:
        out = "0." + "0" * -n + digits
    else:
        out = digits[0] + ("." + digits[1:] if k > 1 else "") + f"e{'-' if n < 1 else '+'}{abs(n - 1)}"
    return ("-" if x < 0 else "") + out


def plainly(value):
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + plainly(value[k]) for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(plainly, value)) + "]"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return number(value)
    return json.dumps(value, ensure_ascii=False)


def canonical(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.canonical(F.col("t")).alias("c"), S.canonical_hash(F.col("t")).alias("h"))
    found = {r.i: r for r in rows.collect()}
    return [found[i].c for i in range(len(texts))], [found[i].h for i in range(len(texts))]


def made_up(rng, depth=0):
    roll = rng.random()
    if depth < 4 and roll < 0.3:
        return {rng.choice(["a", "b", "é", "10", "9", "Z", "😀", "￿", "x y", "q\"\\", "\x1f"]) + str(rng.randrange(3)): made_up(rng, depth + 1) for _ in range(rng.randrange(5))}
    if depth < 4 and roll < 0.5:
        return [made_up(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, False, rng.randrange(-(10**6), 10**20), rng.random() * 10 ** rng.randrange(-9, 25), "".join(rng.choices("ab\n\t\b\f\"\\/\x0b\x0e\x1a\x1f\x7f漢😀  1", k=rng.randrange(9)))])


def shuffled(rng, value):
    if isinstance(value, dict):
        keys = list(value)
        rng.shuffle(keys)
        return {k: shuffled(rng, value[k]) for k in keys}
    return [shuffled(rng, v) for v in value] if isinstance(value, list) else value


def test_canonical_at_any_depth(spark):
    rng = random.Random(12)
    values = [made_up(rng) for _ in range(300)]
    first, hashes = canonical(spark, [json.dumps(v) for v in values])
    second, again = canonical(spark, [json.dumps(shuffled(rng, v), ensure_ascii=False, indent=1) for v in values])
    assert first == [plainly(v) for v in values] == second and hashes == again


def test_numbers(spark):
    rng = random.Random(2)
    doubles = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(500)]
    doubles = [d for d in doubles if d == d and abs(d) < 1e300] + [1e23, 9.5e-7, 1e-6, 1e21, 123456789012345680000.0, 2e-3, 5e-324, 0.1, 1 / 3, 2**53 + 2.0, 4.35, 100.0, -0.0]
    rows = spark.createDataFrame(list(enumerate(doubles)), "i int, d double").select("i", S.number_text(F.col("d")).alias("t")).collect()
    wrong = {doubles[r.i]: (r.t, number(doubles[r.i])) for r in rows if r.t != number(doubles[r.i])}
    assert not wrong
    assert canonical(spark, ["[1.50, 1e3, -0.0, 12345678901234567890123, 1E-7]"])[0] == ["[1.5,1000,0,1.2345678901234568e+22,1e-7]"]


def test_what_is_no_json(spark):
    texts = [None, "", "nul", "[1,]", "{'a':1}", '{"a":1}x', "1 2", "1,2", "1],[2", '{"a":1,"a":2}', "01", '{"a":1}]', ' {"b" : [ ] , "a" : { } } ', '"x"', "null"]
    assert canonical(spark, texts)[0] == [None] * 12 + ['{"a":{},"b":[]}', '"x"', "null"]


PREVIEW = {"baselineRevision": 3, "commandType": "confirm-review", "affected": [{"b": 1, "a": "x"}], "requiresConfirmation": True}


def test_stored_previews(spark):
    cases = [
        (json.dumps(PREVIEW), None), (json.dumps(dict(reversed(PREVIEW.items()))), None), (json.dumps(PREVIEW | {"baselineRevision": 3.0}), None), ("{", "broken"), (None, "broken"), ("[]", "no-object"),
        (json.dumps(PREVIEW | {"baselineRevision": 3.5}), "baselineRevision"), (json.dumps(PREVIEW | {"baselineRevision": 2**53}), "baselineRevision"), (json.dumps(PREVIEW | {"baselineRevision": "3"}), "baselineRevision"),
        (json.dumps(PREVIEW | {"affected": {}}), "affected"), (json.dumps(PREVIEW | {"requiresConfirmation": None}), "requiresConfirmation"), (json.dumps({k: v for k, v in PREVIEW.items() if k != "commandType"}), "commandType"),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    t = F.col("t")
    found = rows.select("i", S.preview_fault(t).alias("fault"), S.same_preview(t, F.lit(json.dumps(PREVIEW))).alias("same"), S.unknown_keys(t, {k: 0 for k in PREVIEW if k != "affected"}).alias("unknown")).orderBy("i").collect()
    assert [r.fault for r in found] == [f for _, f in cases]
    assert [r.same for r in found] == [True, True, True] + [False] * (len(cases) - 3)
    assert [r.unknown for r in found][:6] == [["affected"]] * 3 + [[]] * 3


def snapshot(**changes):
    unit = {"offsetUnit": "utf8-byte"}
    chapter = {"chapterId": "c1", "order": 1, "title": "t", "reviewStatus": "pending", "headingRange": {"startByte": 0, "endByte": 3} | unit, "contentRange": {"startByte": 3, "endByte": 9} | unit}
    whole = {"revisionId": "r", "baselineRevision": 1, "source": {}, "encoding": "utf-8", "encodingMethod": "bom", "textByteLength": 9, "coverage": {}, "revisionHistory": [], "reviewStatus": "pending", "createdAt": "2024"}
    first = {k: v for k, v in (chapter | changes.pop("chapter", {})).items() if v != "gone"}
    return json.dumps({k: v for k, v in (whole | {"chapters": [chapter, first]} | changes).items() if v != "gone"})


@pytest.mark.parametrize("changes, fault", [
    ({}, None), ({"extra": 1}, None), ({"reviewStatus": "rejected"}, "reviewStatus"), ({"chapters": {}}, "chapters"), ({"chapters": []}, None), ({"source": "gone"}, "source"), ({"textByteLength": 8}, "chapter-0"),
    ({"chapter": {"headingRange": "gone"}}, None), ({"chapter": {"headingKind": "missing"}}, None), ({"chapter": {"headingKind": "none"}}, "chapter-1"), ({"chapter": {"title": " "}}, "chapter-1"),
    ({"chapter": {"contentRange": {"offsetUnit": "utf8-byte", "startByte": 9, "endByte": 9}}}, None), ({"chapter": {"headingRange": {"offsetUnit": "utf8-byte", "startByte": 3, "endByte": 3}}}, "chapter-1"),
    ({"chapter": {"contentRange": {"offsetUnit": "utf16", "startByte": 3, "endByte": 9}}}, "chapter-1"), ({"chapter": {"order": 1.5}}, "chapter-1"), ({"chapter": {"lengthAnomalyAccepted": 1}}, "chapter-1"), ({"chapters": [1]}, "chapter-0"),
])
def test_stored_snapshots(spark, changes, fault):
    assert spark.createDataFrame([(snapshot(**changes),)], "t string").select(S.snapshot_fault(F.col("t")).alias("f")).first().f == fault


def test_texts_are_parsed_once(spark):
    frame = spark.createDataFrame([("{}",)], "t string")
    for made in (S.canonical(F.col("t")), S.snapshot_fault(F.col("t"))):
        assert frame.select(made.alias("x"))._jdf.queryExecution().analyzed().toString().count("try_parse_json(") == 1


def test_numbers_beside_each_other_and_in_strings(spark):
    texts = ['[1.0,-1.0,0.0,0.000001,0.0000001,12345678901234.5,123456789012345.6,"1.0, \\u000b 2.50",10.50,-0.25]', '{"a\\\\u000B":"\\u000B","b":[-7,1e2]}', "[" + ",".join(["1,2.50"] * 900) + "]"]
    assert canonical(spark, texts)[0] == [plainly(json.loads(t)) for t in texts]
