"""Personal data: format-preserving Feistel pseudonyms.

E-mail addresses, IP addresses, dates, phone numbers, social security numbers, payment cards, bank account
numbers, access keys and hexadecimal secrets are found by pattern, validated (octets, calendar, Luhn and
97 sums, number ranges) and keyed-permuted within their format by an eight-round Feistel network whose
round function is SHA-512. The permutation depends on the key alone, so equal values get equal pseudonyms
in all documents and different values different ones. What doesn't validate is left as it is.

* e-mail: in the local part letters of each alphabet and digits each among their own; marks, ß, ς, case and
  the domain stay; a local part with letters of other scripts becomes ``xn--`` and its UTF-8 bytes, in
  hexadecimal digits that are permuted
* IPv4: the two halves of the address; the result is an address. IPv6: the 32 hexadecimal digits of the address,
  so short and long spellings stay linked; zeros in front of groups are written where the value had all of them
* date: within its century, days 1-28 among each other, 29-31 among each other, 29 February among
  leap years; ``yyyy-mm-dd``, ``dd/mm/yyyy`` or ``dd.mm.yyyy``; an unpadded day may gain a digit
* phone: the digits after the country code, whatever their grouping and with or without a trunk 0 in brackets; of
  ten digits those in the valid range (area and exchange from 200) among each other, and the others among each other
* social security number: valid ones (area neither 000, 666 nor 9xx) among each other
* card: all digits but the last, which becomes the new Luhn digit; separators stay
* bank account: letters and digits after the check digits, which become those of the new number; country and spaces stay
* access key: letters and digits after the issuer's mark (20 characters and more), each among their own; case stays
* secret: 32 or more hexadecimal digits, at least one of them 0-9, within its case

Letters and digits of values of more than ``SLICE`` characters are permuted slice by slice. Null texts stay null, empty ones empty; texts and values of any length are taken whole. Repeated rows each
get the same result. Other columns are carried along, but for one named pii.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chaptermill.llm.common import let

KEY = "chaptermill-demo-key"
ROUNDS = 8
#: Characters of a local part or an access key that are permuted together; no valid address has more than 64.
SLICE = 256

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_NAME = r"\p{L}\p{M}\p{N}"
EMAIL = rf"(?<![{_NAME}._%+\-])[{_NAME}._%+\-]++@[{_NAME}\-]++(?:\.[{_NAME}\-]++)++"
TOKEN = r"(?<![0-9A-Za-z])(?:(?:AKIA|ASIA)(?=[A-Z]*+[0-9])[0-9A-Z]{16}|(?:gh[pousr]_|glpat-|xox[abprs]-|AIza|[sr]k[-_](?:live_|test_|proj-)?)(?=[A-Za-z_\-]*+[0-9])[0-9A-Za-z_\-]{20,}+)(?![0-9A-Za-z_\-])"
SECRET = r"(?<![0-9A-Za-z])(?=[A-Fa-f]*+[0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?|[0-9A-Z]{11,30})(?![0-9A-Za-z])"
IPV6 = r"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*+[0-9])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?=[0-9A-Fa-f:]*?::)(?![0-9A-Fa-f:]*?::[0-9A-Fa-f:]*?::)[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])"
IPV4 = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
ISO_DATE = r"(?<![0-9\-])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9\-])"
DMY_DATE = r"(?<![0-9/.])(?:0?[1-9]|[12][0-9]|3[01])(?<mark>[/.])(?:0?[1-9]|1[0-2])\k<mark>(?:19|20)[0-9]{2}(?![0-9/])"
SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
PHONE = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])"
ABROAD = r"(?<![0-9A-Za-z+])\+[1-9](?:[ .\-/()]{0,2}[0-9]){8,14}(?![0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9])"
FOUND = "|".join([EMAIL, TOKEN, SECRET, IBAN, IPV6, IPV4, ISO_DATE, DMY_DATE, SSN, PHONE, ABROAD, CARD])

DIGITS = "0123456789"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
HEX = "0123456789abcdef"


def _small(*ranges: tuple[int, int]) -> str:
    """The small letters of code point ranges that have one capital each."""
    letters = [chr(c) for first, last in ranges for c in range(first, last + 1)]
    return "".join(c for c in letters if c.islower() and len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c)


#: Permuted each among its own: digits, Latin, Latin-1 and Latin Extended-A, Greek, Cyrillic.
ALPHABETS = {"digits": DIGITS, "letters": LETTERS, "accented": _small((0xE0, 0xFE), (0x101, 0x17F)), "greek": _small((0x3AC, 0x3CE)), "cyrillic": _small((0x430, 0x45F), (0x48B, 0x4BF))}


def _draw(key: str, kind: str, number: Column, seen: Column) -> Column:
    """The round function: 128 hexadecimal digits."""
    return F.sha2(F.concat(F.lit(f"{key}|{kind}|"), number.cast("string"), F.lit("|"), seen).cast("binary"), 512)


def _number(drawn: Column, at: Column | int) -> Column:
    """The ``at``-th of 32 numbers below 65,536 in a draw."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(drawn, at % 32 * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _rotated(s: Column, drawn: Column, alphabet: str) -> Column:
    """Each symbol moved along the alphabet by its number in the draw."""
    symbols = F.filter(F.split(s, ""), lambda c: c != "")
    moved = F.transform(symbols, lambda c, i: F.substring(F.lit(alphabet), F.pmod(F.instr(F.lit(alphabet), c) - 1 + _number(drawn, i), F.lit(len(alphabet))) + 1, F.lit(1)))
    return F.array_join(moved, "")


def feistel(s: Column, alphabet: str, kind: str, key: str) -> Column:
    """A keyed permutation of the strings over ``alphabet`` of one length."""

    def of(s: Column) -> Column:
        n = F.length(s)
        half = F.floor(n / 2).cast("int")
        start = F.struct(F.substring(s, F.lit(1), half).alias("l"), F.substring(s, half + 1, n).alias("r"))
        done = F.aggregate(
            F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
            start,
            lambda a, i: F.struct(a["r"].alias("l"), _rotated(a["l"], _draw(key, kind, i, a["r"]), alphabet).alias("r")),
            lambda a: F.concat(a["l"], a["r"]),
        )
        return F.when(n < 2, _rotated(s, _draw(key, kind, F.lit(ROUNDS), F.lit("")), alphabet)).otherwise(done)

    return let(s, of)


def _pair(left: Column, right: Column, m: int | Column, n: int | Column, kind: str, key: str) -> Column:
    """A keyed permutation of the pairs of a number below m and one below n, as a struct (l, r)."""
    m, n = (F.lit(x) if isinstance(x, int) else x for x in (m, n))

    def step(a: Column, i: Column) -> Column:
        left = F.pmod(a["l"] + _number(_draw(key, kind, i, a["r"].cast("string")), 0), m)
        return let(left, lambda x: F.struct(x.alias("l"), F.pmod(a["r"] + _number(_draw(key, kind, i + 100, x.cast("string")), 0), n).alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), F.struct(left.alias("l"), right.alias("r")), step)


def _put_back(s: Column, symbols: Column, alphabet: str) -> Column:
    """``s`` with its characters of the alphabet, in either case, replaced by ``symbols`` in order."""

    def step(a: Column, c: Column) -> Column:
        new = F.substring(symbols, a["n"] + 1, F.lit(1))
        cased = F.when(F.lower(c) != c, F.upper(new)).otherwise(new)
        inside = F.instr(F.lit(alphabet), F.lower(c)) > 0
        return F.struct(F.concat(a["s"], F.when(inside, cased).otherwise(c)).alias("s"), (a["n"] + F.when(inside, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.struct(F.lit("").alias("s"), F.lit(0).alias("n")), step, lambda a: a["s"])


def _permuted(s: Column, alphabet: str, kind: str, key: str) -> Column:
    """``s`` with its characters of the alphabet permuted and all others in place."""

    def of(s: Column) -> Column:
        inside = F.array_join(F.filter(F.split(F.lower(s), ""), lambda c: (c != "") & (F.instr(F.lit(alphabet), c) > 0)), "")
        return let(feistel(inside, alphabet, kind, key), lambda p: _put_back(s, p, alphabet))

    return let(s, of)


def _sliced(s: Column, permuted) -> Column:
    """``permuted`` of each slice of ``s``: a permutation of the strings of any length."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)), F.lit(SLICE))
    return F.array_join(F.transform(starts, lambda at: let(F.substring(s, at, F.lit(SLICE)), permuted)), "")


def luhn_sum(digits: Column) -> Column:
    def step(a: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step)


def _card(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")

    def new(d: Column) -> Column:
        payload = feistel(F.substring(d, F.lit(1), F.length(d) - 1), DIGITS, "card", key)
        return let(payload, lambda p: F.concat(p, F.pmod(-luhn_sum(F.concat(p, F.lit("0"))), F.lit(10)).cast("string")))

    return F.when(F.pmod(luhn_sum(digits), F.lit(10)) == 0, let(let(digits, new), lambda p: _put_back(m, p, DIGITS))).otherwise(m)


def _ipv4(m: Column, key: str) -> Column:
    part = lambda i: F.split(m, r"\.")[i].cast("int")
    moved = _pair(part(0) * 256 + part(1), part(2) * 256 + part(3), 65536, 65536, "ipv4", key)
    text = lambda p: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(p[h] / 256), p[h] % 256)])
    return let(moved, text)


def _within(m: Column, valid, once) -> Column:
    """``once`` repeated until the result is valid again: a permutation of the valid values."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(60)), once(m), lambda a, i: F.when(valid(a), a).otherwise(once(a)))


def _ssn(m: Column, key: str) -> Column:
    valid = lambda s: ~s.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.when(valid(m), _within(m, valid, lambda s: _permuted(s, DIGITS, "ssn", key))).otherwise(m)


#: Country codes of one and two digits; all others have three.
COUNTRY = r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})"


def _phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, rf"^(?:{COUNTRY}(?:[ .\-/]{{0,2}}\(0\))?)?", 0)
    valid = lambda s: s.rlike(r"^[^0-9]*[2-9](?:[^0-9]*[0-9]){2}[^0-9]*[2-9]")
    once = lambda s: _permuted(s, DIGITS, "phone", key)

    def moved(c: Column) -> Column:
        rest = F.substring(m, F.length(c) + 1, F.length(m))
        ten = lambda r: F.when(valid(r), _within(r, valid, once)).otherwise(_within(r, lambda s: ~valid(s), once))
        return let(rest, lambda r: F.concat(c, F.when(F.regexp_count(r, F.lit("[0-9]")) == 10, ten(r)).otherwise(_permuted(r, DIGITS, "abroad", key))))

    return let(country, moved)


def _sum97(s: Column) -> Column:
    """The remainder by 97 of digits and capitals, A standing for 10."""

    def step(a: Column, c: Column) -> Column:
        at = F.instr(F.lit(DIGITS + LETTERS.upper()), c) - 1
        return F.pmod(F.when(at < 10, a * 10 + at).otherwise(a * 100 + at), F.lit(97))

    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0), step)


def _iban(m: Column, key: str) -> Column:
    def checked(s: Column) -> Column:
        digits = F.lpad((98 - _sum97(F.concat(F.substring(s, 5, 40), F.substring(s, 1, 2), F.lit("00")))).cast("string"), 2, "0")
        return F.concat(F.substring(s, 1, 2), digits, F.substring(s, 5, 40))

    plain = F.replace(m, F.lit(" "), F.lit(""))
    own = lambda p: F.lower(F.substring(p, 5, 40))
    moved = lambda p: _permuted(_permuted(own(p), DIGITS, "iban", key), LETTERS, "iban letters", key)
    new = let(plain, lambda p: let(F.concat(F.substring(p, 1, 4), F.upper(moved(p))), checked))
    valid = let(plain, lambda p: F.length(p).between(15, 34) & (_sum97(F.concat(F.substring(p, 5, 40), F.substring(p, 1, 4))) == 1))
    spaced = let(new, lambda n: F.when(F.instr(m, " ") > 0, F.rtrim(F.regexp_replace(n, "(.{4})", F.lit("$1 ")))).otherwise(n))
    return F.when(valid, spaced).otherwise(m)


def _ipv6(m: Column, key: str) -> Column:
    groups = lambda t: F.filter(F.split(t, ":"), lambda g: g != "")
    left, right = groups(F.substring_index(m, "::", 1)), groups(F.when(F.instr(m, "::") > 0, F.substring_index(m, "::", -1)).otherwise(""))
    whole = let(F.struct(left.alias("l"), right.alias("r")), lambda x: F.concat(x["l"], F.array_repeat(F.lit("0"), 8 - F.size(x["l"]) - F.size(x["r"])), x["r"]))
    digits = F.lower(F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))
    padded, capitals = m.rlike("^[0-9A-Fa-f]{4}(?::[0-9A-Fa-f]{4}){7}$"), m.rlike("[A-F]")

    def text(d: Column) -> Column:
        new = F.transform(F.sequence(F.lit(1), F.lit(29), F.lit(4)), lambda at: F.substring(d, at, F.lit(4)))
        short = F.transform(new, lambda g: F.regexp_replace(g, "^0{1,3}", ""))
        spelled = F.array_join(F.when(padded, new).otherwise(short), ":")
        return F.when(capitals, F.upper(spelled)).otherwise(spelled)

    return let(feistel(digits, HEX, "ipv6", key), text)


def _token(m: Column, key: str) -> Column:
    mark = F.regexp_extract(m, r"^(?:AKIA|ASIA|gh[pousr]_|glpat-|xox[abprs]-|AIza|[sr]k[-_](?:live_|test_|proj-)?)", 0)
    moved = lambda s: _permuted(_permuted(s, DIGITS, "token", key), LETTERS, "token letters", key)
    return let(mark, lambda k: F.concat(k, _sliced(F.substring(m, F.length(k) + 1, F.length(m)), moved)))


#: Month and day of the days after the 28th that every year has.
_LATE = [f"{m:02d}{d}" for m in range(1, 13) if m != 2 for d in range(29, 32) if d < 31 or m in (1, 3, 5, 7, 8, 10, 12)]


def _date(m: Column, key: str) -> Column:
    iso = m.rlike("^[0-9]{4}-")
    part = F.split(m, r"[\-/.]")
    fields = F.struct(
        F.when(iso, part[0]).otherwise(part[2]).cast("int").alias("y"),
        part[1].cast("int").alias("m"),
        F.when(iso, part[2]).otherwise(part[0]).cast("int").alias("d"),
    )
    late = F.array(*[F.lit(x) for x in _LATE])

    def moved(f: Column) -> Column:
        year, century = f["y"] % 100, f["y"] - f["y"] % 100
        leap = (f["y"] % 4 == 0) & ((f["y"] % 100 != 0) | (f["y"] % 400 == 0))
        at = F.array_position(late, F.concat(F.lpad(f["m"].cast("string"), 2, "0"), F.lpad(f["d"].cast("string"), 2, "0"))).cast("int")
        early = let(
            _pair(year, (f["m"] - 1) * 28 + f["d"] - 1, 100, 336, "date", key),
            lambda p: F.struct((century + p["l"]).alias("y"), (F.floor(p["r"] / 28) + 1).cast("int").alias("m"), (p["r"] % 28 + 1).cast("int").alias("d")),
        )
        tail = let(
            _pair(year, at - 1, 100, len(_LATE), "late", key),
            lambda p: F.struct((century + p["l"]).alias("y"), F.substring(F.get(late, p["r"]), 1, 2).cast("int").alias("m"), F.substring(F.get(late, p["r"]), 3, 2).cast("int").alias("d")),
        )
        first = F.when(century % 400 == 0, 0).otherwise(1)
        turn = _number(_draw(key, "leap", century, F.lit("")), 0)
        leaps = F.struct((century + (F.pmod((year / 4).cast("int") - first + turn, 25 - first) + first) * 4).cast("int").alias("y"), F.lit(2).alias("m"), F.lit(29).alias("d"))
        return F.when(f["d"] <= 28, early).when(at > 0, tail).when((f["m"] == 2) & (f["d"] == 29) & leap, leaps)

    def text(f: Column) -> Column:
        pad = lambda x, like: F.lpad(x.cast("string"), F.greatest(F.length(like), F.length(x.cast("string"))), F.lit("0"))
        sep = F.regexp_extract(m, r"[\-/.]", 0)
        return F.when(f.isNull(), m).when(iso, F.concat_ws("-", f["y"].cast("string"), pad(f["m"], part[1]), pad(f["d"], part[2]))).otherwise(F.concat(pad(f["d"], part[0]), sep, pad(f["m"], part[1]), sep, f["y"].cast("string")))

    return let(let(fields, moved), text)


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)

    def moved(s: Column) -> Column:
        for kind, alphabet in ALPHABETS.items():
            s = _permuted(s, alphabet, kind, key)
        return s

    told = "".join(ALPHABETS.values())
    other = F.exists(F.split(F.lower(local), ""), lambda c: c.rlike(r"[\p{L}\p{N}]") & ~c.isin("ß", "ς") & (F.instr(F.lit(told), c) == 0))
    whole = F.concat(F.lit("xn--"), _sliced(F.lower(F.hex(F.encode(local, "UTF-8"))), lambda s: feistel(s, HEX, "address", key)))
    return F.concat(F.when(other, whole).otherwise(_sliced(local, moved)), F.substring(m, F.length(local) + 1, F.length(m)))


def kind_of(m: Column) -> Column:
    return (
        F.when(F.instr(m, "@") > 0, "email")
        .when(m.rlike(f"^{TOKEN}$"), "token")
        .when(m.rlike("^[0-9A-Fa-f]{32,}$"), "secret")
        .when(m.rlike("^[A-Z]{2}[0-9]{2}[0-9A-Z ]+$"), "iban")
        .when(F.instr(m, ":") > 0, "ipv6")
        .when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ipv4")
        .when(m.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{1,2}([/.])[0-9]{1,2}\1[0-9]{4}$"), "date")
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(m.rlike(f"^{PHONE}$"), "phone")
        .when(m.rlike(r"^\+"), "abroad")
        .otherwise("card")
    )


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one found value; the value itself where it doesn't validate."""

    def of_kind(k: Column) -> Column:
        secret = F.when(F.lower(m) == m, feistel(m, HEX, "secret", key)).otherwise(F.upper(feistel(F.lower(m), HEX, "secret", key)))
        kinds = {"email": _email, "token": _token, "iban": _iban, "ipv6": _ipv6, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone, "abroad": _phone}
        found = F.when(k == "secret", secret)
        for kind, of in kinds.items():
            found = found.when(k == kind, of(m, key))
        return found

    return let(kind_of(m), of_kind)


def key_of(spark: SparkSession) -> str:
    """The secret that the session names in spark.chaptermill.piiKey; the demonstration key where it names none."""
    return spark.conf.get("spark.chaptermill.piiKey", KEY)


def pseudonymize(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """``docs`` with the values in ``text`` replaced and column pii: (kind, n) of what was, by kind."""
    own = [c for c in docs.columns if c != "pii"]
    empty = F.array().cast("array<struct<kind:string,was:string,now:string>>")
    found = F.transform(
        F.regexp_extract_all(F.col(text), F.lit(FOUND), F.lit(0)),
        lambda m: F.struct(kind_of(m).alias("kind"), m.alias("was"), pseudonym(m, key).alias("now")),
    )
    # Nothing that is looked for lacks both @ and a digit.
    marked = docs.select(F.struct(*own).alias("__pii_document"), F.when(F.col(text).rlike("[@0-9]"), found).otherwise(empty).alias("__pii_values"))
    was = F.col("__pii_document")[text]
    between = F.split(was, FOUND)
    replaced = let(between, lambda b: F.array_join(F.transform(b, lambda x, i: F.concat(x, F.coalesce(F.get(F.col("__pii_values"), i)["now"], F.lit("")))), ""))
    changed = F.filter("__pii_values", lambda v: v["was"] != v["now"])
    kinds = F.array_sort(F.array_distinct(F.transform(changed, lambda v: v["kind"])))
    counts = let(changed, lambda c: F.transform(kinds, lambda k: F.struct(k.alias("kind"), F.size(F.filter(c, lambda v: v["kind"] == k)).alias("n"))))
    return marked.select(
        *[F.when(F.size("__pii_values") > 0, replaced).otherwise(was).alias(text) if c == text else F.col("__pii_document")[c].alias(c) for c in own],
        counts.alias("pii"),
    )


def pseudonyms(docs: DataFrame) -> DataFrame:
    """Every document with its pseudonymized text and how many values were replaced, in all and by kind."""
    done = pseudonymize(docs.select("doc_id", "text"), key_of(docs.sparkSession))
    return done.select("doc_id", "text", F.aggregate("pii", F.lit(0), lambda a, x: a + x["n"]).cast("long").alias("n_replaced"), "pii")
