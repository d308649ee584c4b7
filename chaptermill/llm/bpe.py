"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task takes its documents in blocks. The pretokens of a block that it hasn't met yet are laid
end to end as one array of byte tokens, and an inverted index maps each mergeable pair (named
by the rank of what it makes) to the positions where it stands. The merges are then replayed
over the whole block in rank order; each merge touches only the two neighbours of its position
and files the new pairs they form. A document's ids are its pretokens' ids, joined.

Null texts count as empty and give no ids. Texts of any length are taken whole.
"""

from __future__ import annotations

import base64
import bisect
import heapq
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text whose pretokens are held in memory at once.
BLOCK_BYTES = 1_000_000
#: Known pretokens a task keeps before it starts afresh.
KNOWN_PRETOKENS = 400_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: base64 of a token's bytes, a space, its rank, one a line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class MergeReplay:
    """Encodes sets of pretokens by replaying all merges over them in rank order."""

    def __init__(self, ranks: dict[bytes, int]):
        import numpy as np

        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.shift = max(ranks.values()).bit_length()
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.pairs = np.full(65536, -1, np.int64)  # of two bytes
        for b, r in ranks.items():
            if len(b) == 2:
                self.pairs[b[0] << 8 | b[1]] = r
        self.start = {ranks[b[:1]] << self.shift | ranks[b[1:]]: r for b, r in ranks.items() if len(b) == 2}
        self.made = dict(self.start)  # by pair of tokens, what it makes or -1; started afresh when too large

    def rank_of(self, left: int, right: int) -> int:
        """The token a pair makes, or -1."""
        found = self.made[left << self.shift | right] = self.ranks.get(self.bytes_of[left] + self.bytes_of[right], -1)
        return found

    def _index(self, raw: list[bytes]):
        """Tokens of the pretokens end to end, each followed by -1; the start of each; and the positions of all
        mergeable pairs of bytes by the rank of what they make."""
        import numpy as np

        data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
        ends = np.cumsum(np.array([len(b) + 1 for b in raw], np.int64))
        tokens = self.single[data]
        tokens[ends - 1] = -1
        found = self.pairs[data[:-1].astype(np.int64) << 8 | data[1:]]
        found[ends[:-1] - 1] = -1  # the pair that starts at an end
        found[ends - 2] = -1  # and the one that runs into it
        at = np.flatnonzero(found >= 0)
        rank = found[at]
        order = np.argsort(rank, kind="stable")
        rank, at = rank[order], at[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        index = dict(zip(rank[np.concatenate([[0], cuts])].tolist(), (x.tolist() for x in np.split(at, cuts)), strict=True)) if len(rank) else {}
        return tokens.tolist(), [0, *ends[:-1].tolist()], index

    def encode(self, pretokens: list[str]) -> list[bytes]:
        """For each pretoken its ids as little-endian unsigned 32-bit integers."""
        if len(self.made) > KNOWN_PRETOKENS:
            self.made = dict(self.start)
        encoded = [p.encode("utf-8", "surrogatepass") for p in pretokens]
        whole = [self.ranks.get(b) for b in encoded]
        done = [r.to_bytes(4, "little") if r is not None else b"" for r in whole]
        rest = [i for i, r in enumerate(whole) if r is None and encoded[i]]
        if not rest:
            return done
        raw = [encoded[i] for i in rest]
        tokens, starts, index = self._index(raw)
        made, rank_of, shift = self.made, self.rank_of, self.shift
        n = len(tokens)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = list(index)
        heapq.heapify(heap)
        early: list[int] = []  # positions where a pair appeared that should have gone first
        while heap:
            rank = heapq.heappop(heap)
            at_rank = index.pop(rank, None)
            if at_rank is None:
                continue
            at_rank.sort()
            for at in at_rank:
                left = tokens[at]
                next_at = after[at]
                if left < 0 or (right := tokens[next_at]) < 0 or made.get(left << shift | right, -1) != rank:
                    continue
                tokens[at] = rank
                tokens[next_at] = -2
                after[at] = far = after[next_at]
                before[far] = at
                if (right := tokens[far]) >= 0:
                    r = made.get(rank << shift | right)
                    if r is None:
                        r = rank_of(rank, right)
                    if r >= 0:
                        if r < rank:
                            early.append(at)
                        if r in index:
                            index[r].append(at)
                        else:
                            index[r] = [at]
                            heapq.heappush(heap, r)
                if (near := before[at]) >= 0 and (left := tokens[near]) >= 0:
                    r = made.get(left << shift | rank)
                    if r is None:
                        r = rank_of(left, rank)
                    if r >= 0:
                        if r < rank:
                            early.append(at)
                        if r in index:
                            index[r].append(near)
                        else:
                            index[r] = [near]
                            heapq.heappush(heap, r)
        self._collect(tokens, starts, rest, done)
        for k in {bisect.bisect_right(starts, at) - 1 for at in early}:
            done[rest[k]] = self.encode_alone(raw[k])
        return done

    @staticmethod
    def _collect(tokens: list[int], starts: list[int], rest: list[int], done: list[bytes]) -> None:
        """The tokens that are left of each pretoken, packed."""
        import numpy as np

        final = np.array(tokens, np.int64)
        kept = final >= 0
        packed = final[kept].astype("<u4").tobytes()
        bounds = np.concatenate([np.cumsum(kept)[np.array(starts) - 1], [int(kept.sum())]]) * 4
        bounds[0] = 0
        edges = bounds.tolist()
        for k, i in enumerate(rest):
            done[i] = packed[edges[k] : edges[k + 1]]

    def encode_alone(self, raw: bytes) -> bytes:
        """One pretoken, the lowest rank first and leftmost among equals; for the rare pretokens where
        a merge makes a pair of lower rank than its own."""
        parts = [bytes([b]) for b in raw]
        while len(parts) > 1:
            found = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if found[0] == 1 << 60:
                break
            i = found[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return array("I", [self.ranks[p] for p in parts]).tobytes()


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


class _Encoder:
    """Encodes the texts of one task block by block."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.cut = regex.compile(pattern).findall
        self.replay = MergeReplay(ranks)
        self.known: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        pretokens = [self.cut(t) for t in texts]
        new = list({p for doc in pretokens for p in doc} - self.known.keys())
        if len(self.known) + len(new) > KNOWN_PRETOKENS:
            self.known.clear()
            new = list({p for doc in pretokens for p in doc})
        self.known.update(zip(new, self.replay.encode(new), strict=True))
        known = self.known
        return [b"".join([known[p] for p in doc]) for doc in pretokens]


class _Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.piece = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.piece[r] = b

    def text(self, packed: bytes) -> bytes:
        import numpy as np

        piece = self.piece
        return b"".join([piece[t] for t in np.frombuffer(packed, "<u4").tolist()])


def _mapped(docs: DataFrame, ranks_path: str, source: str, into: list[str], made) -> DataFrame:
    """``docs`` with binary columns ``into`` that ``made(ranks)`` makes from the values of a block of ``source``.

    ``ranks_path`` is a rank file on the driver; its size is that of a vocabulary, about 1 MB, and doesn't
    grow with the data.
    """
    with open(ranks_path, "rb") as f:
        ranks_data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        import pyarrow as pa

        make = made(read_ranks(ranks_data.value))
        for batch in batches:
            for block in _blocks(batch, source):
                columns = make(block.column(block.schema.get_field_index(source)).to_pylist())
                yield pa.RecordBatch.from_arrays([*block.columns, *[pa.array(c, pa.binary()) for c in columns]], names=[*block.schema.names, *into])
        pa.default_memory_pool().release_unused()

    kept = docs.drop(*into)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *[T.StructField(c, T.BinaryType()) for c in into]]))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with column ``into``: the ids of ``text`` as little-endian unsigned 32-bit integers (binary).
    ``pattern`` cuts a text into pretokens."""

    def made(ranks):
        encoder = _Encoder(ranks, pattern)
        return lambda texts: [encoder.ids([t or "" for t in texts])]

    return _mapped(docs, ranks_path, text, [into], made)


def decode_documents(docs: DataFrame, ranks_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``docs`` with column ``into``: the bytes that the ids in ``ids`` stand for (null ids: none)."""

    def made(ranks):
        decoder = _Decoder(ranks)
        return lambda packed: [[decoder.text(p or b"") for p in packed]]

    return _mapped(docs, ranks_path, ids, [into], made)


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Both in one pass over the documents: the ids, and the bytes these ids stand for."""

    def made(ranks):
        encoder, decoder = _Encoder(ranks, pattern), _Decoder(ranks)

        def both(texts):
            packed = encoder.ids([t or "" for t in texts])
            return [packed, [decoder.text(p) for p in packed]]

        return both

    return _mapped(docs, ranks_path, text, [ids, decoded], made)


def default_vocabulary() -> tuple[str, str]:
    """Path of the public byte-level ranks and the pattern of its pretokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    path, pattern = default_vocabulary()
    done = encode_and_decode(docs.select("doc_id", "text"), path, pattern)
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
