"""Alignment of two tokenizers' ids over the bytes of texts, by a group dictionary.

Both tokenizers encode space + text: A is byte-level BPE (its entries are decoded byte by byte), B is
a piece model with byte fallback that adds the space itself. Where tokens of both end at one byte, the
text is cut into groups; the tokens of a group whose byte ranges overlap are linked, and a pair of ids
counts as often as it is linked in the whole corpus.

1. A task cuts its texts before spaces that follow other characters than white space. There both
   tokenizers always begin a token (no piece of B holds such a space inside), so a stretch is encoded
   once however often it occurs. Texts are taken in blocks of bounded bytes; a block gives a row for
   each document with the numbers of its groups, and one with the block's own dictionary: number,
   group and how often it occurs. Both are written once, so no text is encoded twice.
2. The blocks' dictionaries are added up to the corpus's: a row for each distinct group. Each is
   expanded into its links once; its frequency multiplies them into the counts of the pairs.
3. Counts go back to the pairs of each distinct group (dealt by salt, as one pair may stand in many
   groups), summed by group, to the dictionary of each block by group, and to the block's documents.

A frequent group meets in one row a block instead of one an occurrence. Null and empty texts, and such
as either tokenizer's bytes don't give back (U+2581 in them, for one), have no tokens: zeros and ''.
Texts of any length are taken whole. Every row counts, repeated ids and texts too; an empty table gives
no rows. A column of the documents that bears the name of an output is replaced by it.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chaptermill.llm.common import Scratch, written

#: Bytes of text whose groups share a dictionary.
BLOCK_BYTES = 8_000_000
#: Distinct stretches a task remembers before it starts afresh.
KNOWN = 300_000
#: Stretches that are encoded at once.
ENCODED = 20_000
#: Shares a pair of ids is dealt into when its count goes back to the groups that hold it.
SALTS = 16
MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

_BEHIND_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) (?! *\Z)")


def stretches(text: str) -> list[str]:
    """The stretches of space + text, each without its first space: cut before every run of spaces that follows a
    character other than white space, but for one at the end."""
    odd = text[:1] == " " or text[-1:] == " " or _BEHIND_SPACE.search(text)
    return _CUT.split(text) if odd else text.split(" ")


class Tokenizers:
    """Both tokenizers in a task, and the bytes of their tokens."""

    def __init__(self, a_data: bytes, b_data: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_buffer(a_data)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_data)
        # Byte-level entries write printable bytes as themselves, the others in order from U+0100.
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = [x for x in range(256) if x not in printable]
        byte_of = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(rest)}
        self.a_bytes: dict[int, bytes] = {}
        for entry, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.a_size = {i: len(x) for i, x in self.a_bytes.items()}
        self.b_size = {i: len(x) for i, x in self.b_bytes.items()}

    def encode(self, texts: list[str]):
        """Ids of A and of B of space + text, for each text."""
        a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return zip([x.ids for x in a], self.b.encode(texts, num_threads=1), strict=True)

    def joined(self, a: list[int], b: list[int]) -> tuple[bytes, bytes]:
        """The bytes of the tokens of A and of B."""
        return b"".join(map(self.a_bytes.__getitem__, a)), b"".join(map(self.b_bytes.__getitem__, b))

    def links(self, group: str) -> dict[tuple[int, int], int]:
        """How often each pair of ids is linked in a group."""
        a, b = ([int(x) for x in side.split(",")] for side in group.split("|"))
        found: dict[tuple[int, int], int] = {}
        i = j = 0
        a_end, b_end = self.a_size[a[0]], self.b_size[b[0]]
        while True:
            pair = a[i], b[j]
            found[pair] = found.get(pair, 0) + 1
            if a_end == b_end:
                return found  # a group ends where both sides do first
            if a_end < b_end:
                i += 1
                a_end += self.a_size[a[i]]
            else:
                j += 1
                b_end += self.b_size[b[j]]


class _Interned:
    """Stretches and groups that a task has met, each with a number."""

    def __init__(self, tokenizers: Tokenizers):
        import numpy as np

        self.tokenizers = tokenizers
        self.a_size, self.b_size = (np.array([size.get(i, 0) for i in range(max(size) + 1)], np.int64) for size in (tokenizers.a_size, tokenizers.b_size))
        self.clear()

    def clear(self) -> None:
        import numpy as np

        self.stretch: dict[str, int] = {}
        self.sizes = np.zeros((0, 3), np.int64)  # of a stretch: tokens of A, of B, groups; no groups where bytes differ
        self.starts = np.zeros(1, np.int64)  # where its groups start in
        self.members = np.zeros(0, np.int32)  # the numbers of all groups
        self.group: dict[bytes, int] = {}
        self.names: list[str] = []

    def _flat(self, encoded: list):
        """For A and for B: how many tokens each text has, all tokens end to end, and the bytes up to each one's end."""
        import numpy as np

        for side, size in ((0, self.a_size), (1, self.b_size)):
            n = np.array([len(e[side]) for e in encoded], np.int64)
            tokens = np.fromiter(chain.from_iterable([e[side] for e in encoded]), np.int32, int(n.sum()))
            yield n, tokens, np.cumsum(size[tokens])

    def _exact(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of A and B, none for a text that the tokens of either side don't give back."""
        import numpy as np

        encoded = list(self.tokenizers.encode(texts))
        want = [(" " + t).encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum([len(w) for w in want])
        sides = self._flat(encoded)
        if all(len(up_to) and (np.concatenate([[0], up_to])[np.cumsum(n)] == ends).all() for n, _, up_to in sides):
            if set(self.tokenizers.joined(chain.from_iterable(a for a, _ in encoded), chain.from_iterable(b for _, b in encoded))) == {b"".join(want)}:
                return encoded
        return [e if set(self.tokenizers.joined(*e)) == {w} else ([], []) for e, w in zip(encoded, want, strict=True)]

    def learn(self, new: list[str]) -> None:
        """Encode stretches and cut them into groups: token ends of both sides laid end to end, where they agree."""
        import numpy as np

        (n_a, a, a_ends), (n_b, b, b_ends) = self._flat(self._exact(new))
        both = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_cuts, b_cuts = ([0, *(4 * (np.searchsorted(ends, both) + 1)).tolist()] for ends in (a_ends, b_ends))
        a_raw, b_raw, number = a.tobytes(), b.tobytes(), self.group
        members = np.empty(len(both), np.int32)
        for k in range(len(both)):
            i, j, m, n = a_cuts[k], a_cuts[k + 1], b_cuts[k], b_cuts[k + 1]
            key = b"%d:" % (j - i) + a_raw[i:j] + b_raw[m:n]
            found = number.get(key)
            if found is None:
                found = number[key] = len(number)
                self.names.append(f"{','.join(map(str, a[i // 4 : j // 4].tolist()))}|{','.join(map(str, b[m // 4 : n // 4].tolist()))}")
            members[k] = found
        groups_to = np.searchsorted(both, np.concatenate([[0], a_ends])[np.cumsum(n_a)], side="right")
        self.stretch.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
        self.sizes = np.concatenate([self.sizes, np.stack([n_a, n_b, np.diff(groups_to, prepend=0)], axis=1)])
        self.starts = np.concatenate([self.starts, len(self.members) + groups_to])
        self.members = np.concatenate([self.members, members])

    def block(self, texts: list[str | None]):
        """For the documents of a block: tokens of A, of B and groups (a matrix), hexadecimal digests, and the numbers
        of their groups with how often each occurs, laid end to end with the ends of each document."""
        import hashlib

        import numpy as np

        if len(self.stretch) > KNOWN:
            self.clear()
        cut = [stretches(t) if t else [] for t in texts]
        new = list(set(chain.from_iterable(cut)).difference(self.stretch))
        for i in range(0, len(new), ENCODED):
            self.learn(new[i : i + ENCODED])
        lengths = np.array([len(doc) for doc in cut], np.int64)
        at = np.fromiter(map(self.stretch.__getitem__, chain.from_iterable(cut)), np.int64, int(lengths.sum()))
        del cut
        doc = np.repeat(np.arange(len(texts)), lengths)
        bad = np.zeros(len(texts), bool)
        bad[doc[self.sizes[at, 2] == 0]] = True
        at, doc = at[~bad[doc]], doc[~bad[doc]]
        sizes = np.zeros((len(texts), 3), np.int64)
        for side in range(3):
            sizes[:, side] = np.bincount(doc, weights=self.sizes[at, side], minlength=len(texts))
        n = self.sizes[at, 2]
        into = np.repeat(self.starts[at] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n) + np.arange(int(n.sum()))
        codes = self.members[into]
        ends = np.concatenate([[0], np.cumsum(sizes[:, 2])]).tolist()
        names = self.names
        digests = [hashlib.sha256(";".join([names[g] for g in codes[i:j].tolist()]).encode()).hexdigest() if j > i else "" for i, j in zip(ends, ends[1:], strict=False)]
        keyed, times = np.unique(np.repeat(np.arange(len(texts)), sizes[:, 2]) * len(names) + codes, return_counts=True)
        of = keyed // max(len(names), 1)
        return sizes, digests, (keyed - of * len(names)).astype(np.int32), times.astype(np.int32), np.searchsorted(of, np.arange(len(texts) + 1))


def _blocks(batch, column: str):
    """Slices of a record batch of about BLOCK_BYTES bytes in ``column``, of one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        held += size
        if held > BLOCK_BYTES:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < len(sizes):
        yield batch.slice(start)


def _sent(spark, *paths: str):
    """Vocabulary files of the driver, a few MB whatever the data, for the tasks."""
    data = []
    for path in paths:
        with open(path, "rb") as f:
            data.append(f.read())
    return spark.sparkContext.broadcast(data)


def _interned(docs: DataFrame, vocabularies) -> DataFrame:
    """``docs`` (row, text) as rows of blocks: for a document its row, measures, and the numbers (``codes``) and
    frequencies (``times``) of its groups; for the block's dictionary also their ``keys``, and no row."""
    fields = [
        T.StructField("row", docs.schema["row"].dataType),
        *[T.StructField(c, T.LongType()) for c in ("block", "n_a", "n_b", "n_groups")],
        T.StructField("groups_sha256", T.StringType()),
        *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("codes", "times")],
        T.StructField("keys", T.ArrayType(T.StringType())),
    ]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        known = _Interned(Tokenizers(*vocabularies.value))
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in _blocks(batch, "text"):
                rows, texts = part.column(part.schema.get_field_index("row")), part.column(part.schema.get_field_index("text"))
                sizes, digests, codes, times, ends = known.block(texts.to_pylist())
                n = len(digests)
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (codes, times)]
                columns = [rows, pa.array([block] * n), *[pa.array(sizes[:, i]) for i in range(3)], pa.array(digests), *lists, pa.nulls(n, pa.list_(pa.string()))]
                names = ["row", "block", "n_a", "n_b", "n_groups", "groups_sha256", "codes", "times", "keys"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                some, place = np.unique(codes, return_inverse=True)
                total = np.bincount(place, weights=times, minlength=len(some)).astype(np.int32)
                own = [pa.nulls(1, rows.type), pa.array([block]), *[pa.nulls(1, pa.int64())] * 3, pa.nulls(1, pa.string())]
                own += [pa.array([some.tolist()], pa.list_(pa.int32())), pa.array([total.tolist()], pa.list_(pa.int32())), pa.array([[known.names[i] for i in some.tolist()]])]
                yield pa.RecordBatch.from_arrays([c.cast(pa.list_(pa.string())) if i == 8 else c for i, c in enumerate(own)], names=names)
                block += 1

    return docs.mapInArrow(run, T.StructType(fields))


def expanded(groups: DataFrame, vocabularies) -> DataFrame:
    """``groups`` (key, frequency) as one row for each pair of ids that a group links: key, frequency, a, b, times."""

    def run(batches):
        import pyarrow as pa

        tokenizers = Tokenizers(*vocabularies.value)
        for batch in batches:
            rows = [(k, n, a, b, t) for k, n in zip(*[c.to_pylist() for c in batch.columns], strict=True) for (a, b), t in tokenizers.links(k).items()]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "frequency", "a", "b", "times"])

    return groups.select("key", "frequency").mapInArrow(run, "key string, frequency long, a int, b int, times long")


def pair_counts(links: DataFrame) -> DataFrame:
    """a, b, count: how many links of the corpus hold the pair; best: whether that is its B id's highest count."""
    counts = links.groupBy("a", "b").agg(F.sum(F.col("times") * F.col("frequency")).alias("count"))
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    # One row for an id of B: no more than its vocabulary has.
    return counts.join(F.broadcast(highest), "b").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


def group_measures(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """key, n_links, n_best and count_sum of every distinct group."""
    salted = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = links.withColumn("salt", F.pmod(F.hash("key"), F.lit(SALTS))).join(salted, ["a", "b", "salt"])
    return met.groupBy("key").agg(
        F.sum("times").alias("n_links"),
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("count")).alias("count_sum"),
    )


def _summed(docs, measured):
    """A block's documents with the sums of its groups' measures over their groups."""
    import numpy as np
    import pyarrow as pa

    order = np.argsort(measured["code"].to_numpy())
    known = measured["code"].to_numpy()[order]
    codes = docs["codes"].combine_chunks()
    ends = codes.offsets.to_numpy() - codes.offsets[0].as_py()
    at = np.searchsorted(known, codes.flatten().to_numpy())
    times = docs["times"].combine_chunks().flatten().to_numpy().astype(np.int64)
    out = {c: docs[c] for c in ("row", "n_a", "n_b", "n_groups", "groups_sha256")}
    for c in ("n_links", "n_best", "count_sum"):
        running = np.concatenate([[0], np.cumsum(measured[c].to_numpy()[order][at] * times)]).astype(np.int64)
        out[c] = pa.array(running[ends[1:]] - running[ends[:-1]])
    return pa.table(out)


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but its text, and n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.
    ``a_path`` is a byte-level BPE file, ``b_path`` a piece model, both on the driver."""
    rest = [c for c in docs.columns if c != text and c not in MEASURES]
    vocabularies = _sent(docs.sparkSession, a_path, b_path)
    with Scratch(docs.sparkSession) as scratch:
        blocks = scratch.stored(_interned(docs.select(F.struct(*rest).alias("row"), F.col(text).alias("text")), vocabularies), "align-blocks")
        zipped = F.arrays_zip(F.col("codes").alias("code"), F.col("keys").alias("key"), F.col("times").alias("times"))
        entries = blocks.filter(F.col("keys").isNotNull()).select("block", F.inline(zipped))
        groups = entries.groupBy("key").agg(F.sum("times").alias("frequency"))
        links = scratch.stored(expanded(groups, vocabularies), "align-links")
        measures = group_measures(links, pair_counts(links))
        measured = entries.join(measures, "key").select(F.col("block").alias("of"), "code", "n_links", "n_best", "count_sum")
        schema = T.StructType([blocks.schema["row"], *[T.StructField(c, T.StringType() if c == "groups_sha256" else T.LongType()) for c in ("n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum")]])
        own = blocks.filter(F.col("keys").isNull()).drop("keys")
        done = own.groupBy("block").cogroup(measured.groupBy("of")).applyInArrow(_summed, schema)
        return written(done.select("row.*", *MEASURES), "aligned")


def default_vocabularies() -> tuple[str, str]:
    """Paths of the public byte-level entries and the public piece model."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def alignments(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of every document."""
    return align(docs.select("doc_id", "text"), *default_vocabularies())
