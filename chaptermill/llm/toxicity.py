"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the average of the vectors of its parts, the word itself and its character
n-grams of 3 to 5 between boundary marks, hashed; a window of eight words averages its words, in
which a word that one of the seven before it repeats counts as nothing. A linear softmax on the average tells whether the window's document is toxic. Embeddings and
softmax are trained together, so a misspelling that was never seen shares most parts with words
that were. A document is as toxic as its worst window, over the whole text; a last step on
training rows that the embeddings have not seen places the threshold.

Training uses at most ``rows_per_class`` labelled rows of each class, those of smallest hash, of
texts up to ``train_chars`` characters; scoring takes every whole text. Null and empty texts, and
texts without words, get the score of an empty window. Repeated rows are scored alike.
"""

from __future__ import annotations

import string
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chaptermill.llm.common import written

BUCKETS, DIM, WINDOW = 1 << 17, 8, 8
ROWS_PER_CLASS, TRAIN_CHARS = 1_500, 20_000
EPOCHS, BATCH, RATE, SEED = 4, 2_048, 0.5, 5
KNOWN_WORDS = 500_000
_MARKS = string.punctuation + "«»“”„‘’…–—"


def plain(word: str) -> str:
    return word.strip(_MARKS) or word


def parts(word: str) -> list[int]:
    """Buckets of a word's parts."""
    w = f"<{plain(word)}>"
    found = [zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS]
    for n in (3, 4, 5):
        found += [zlib.crc32(w[i : i + n].encode("utf-8", "surrogatepass")) % BUCKETS for i in range(len(w) - n + 1)]
    return found


class Vocabulary:
    """The parts of distinct words as one flat array."""

    def __init__(self, words: list[str]):
        import numpy as np

        each = [parts(w) for w in words]
        self.sizes = np.array([len(p) for p in each], np.int64)
        self.flat = np.fromiter((x for p in each for x in p), np.int64, int(self.sizes.sum()))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])


def _gather(vocabulary: Vocabulary, chosen):
    """Flat parts of the chosen words, the place of each among the chosen and its share of the word."""
    import numpy as np

    sizes = vocabulary.sizes[chosen]
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(vocabulary.starts[chosen], sizes)
    return vocabulary.flat[at], np.repeat(np.arange(len(chosen)), sizes), np.repeat(1.0 / sizes, sizes)


def train(texts: list[str], toxic: list[int], prior: float) -> dict:
    """The model: a number for every bucket (its embedding times the softmax's direction), the bias, and
    the threshold. ``prior`` is the share of toxic rows among all labelled rows."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    y = np.array(toxic, np.int64)
    tuned = rng.random(len(y)) < 0.2
    words: dict[str, int] = {}
    docs = [np.array([words.setdefault(w, len(words)) for w in t.lower().split()], np.int64) for t in texts]
    if not words or len(set(toxic)) < 2:
        return {"g": np.zeros(BUCKETS, np.float32), "bias": 0.0, "cut": 1.0, "scale": 1.0}
    vocabulary = Vocabulary(list(words))
    distinct_spans: dict[tuple, None] = {}
    for d, label, held in zip(docs, y, tuned, strict=True):
        if not held:
            again = repeats(d)
            for i in range(0, len(d), WINDOW):
                if len(span := d[i : i + WINDOW][~again[i : i + WINDOW]]):
                    distinct_spans[(int(label), *sorted(span.tolist()))] = None
    spans = [np.array(x[1:], np.int64) for x in distinct_spans]
    labels = np.array([x[0] for x in distinct_spans])
    embeddings = rng.normal(0, 0.1, (BUCKETS, DIM))
    softmax = rng.normal(0, 0.1, (DIM, 2))
    bias = np.zeros(2)
    seen_e, seen_s = np.full((BUCKETS, DIM), 1e-3), np.full((DIM, 2), 1e-3)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(spans))
        for i in range(0, len(order), BATCH):
            batch = order[i : i + BATCH]
            sizes = np.array([len(spans[j]) for j in batch])
            tokens = np.concatenate([spans[j] for j in batch])
            distinct, where = np.unique(tokens, return_inverse=True)
            flat, of_word, share = _gather(vocabulary, distinct)
            vectors = np.stack([np.bincount(of_word, embeddings[flat, k] * share, len(distinct)) for k in range(DIM)], 1)
            window_of = np.repeat(np.arange(len(batch)), sizes)
            weight = np.full(len(window_of), 1.0 / WINDOW)
            mean = np.stack([np.bincount(window_of, vectors[where, k] * weight, len(batch)) for k in range(DIM)], 1)
            logits = mean @ softmax + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), labels[batch]] -= 1
            grad_s = mean.T @ p
            grad_mean = p @ softmax.T
            grad_word = np.stack([np.bincount(where, grad_mean[window_of, k] * weight, len(distinct)) for k in range(DIM)], 1)
            touched, slot = np.unique(flat, return_inverse=True)
            grad_e = np.stack([np.bincount(slot, grad_word[of_word, k] * share, len(touched)) for k in range(DIM)], 1)
            seen_e[touched] += grad_e**2
            embeddings[touched] -= RATE * grad_e / np.sqrt(seen_e[touched])
            seen_s += grad_s**2
            softmax -= RATE * grad_s / np.sqrt(seen_s)
            bias -= RATE * p.sum(0) / len(batch)
    model = {"g": (embeddings @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), "bias": float(bias[1] - bias[0]), "cut": 0.0, "scale": 1.0}
    by_word = word_scores(model, vocabulary)
    held = np.array([worst_window(by_word[d], repeats(d), model["bias"]) for d, t in zip(docs, tuned, strict=True) if t])
    model["cut"] = _threshold(held, y[tuned], prior)
    return model


def _threshold(scores, y, prior: float) -> float:
    """The middle of the range of cuts with the fewest errors at the labels' own proportions."""
    import numpy as np

    if not len(scores) or y.min() == y.max():
        return 0.0
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    order = np.argsort(-scores)
    s = scores[order]
    errors = np.cumsum(np.where(y[order] == 1, -weight[order], weight[order]))
    errors[:-1][s[1:] == s[:-1]] = np.inf
    best = int(np.argmin(np.round(errors, 9)))
    if errors[best] >= 0:
        return float(s[0] + 1)
    return float((s[best] + s[best + 1]) / 2) if best + 1 < len(s) else float(s[best] - 1)


def word_scores(model: dict, vocabulary: Vocabulary):
    """What each word adds to the softmax, averaged over its parts."""
    import numpy as np

    if not len(vocabulary.sizes):
        return np.zeros(0)
    return np.add.reduceat(model["g"][vocabulary.flat].astype(np.float64), vocabulary.starts[:-1]) / vocabulary.sizes


def repeats(ids):
    """Whether each word equals one of the WINDOW - 1 words before it."""
    import numpy as np

    again = np.zeros(len(ids), bool)
    for k in range(1, min(WINDOW, len(ids))):
        again[k:] |= ids[k:] == ids[:-k]
    return again


def worst_window(scores, again, bias: float) -> float:
    """The largest logit of any window of WINDOW words; a shorter text is filled up with nothing."""
    import numpy as np

    scores = np.where(again, 0.0, scores)
    if len(scores) <= WINDOW:
        return float(scores.sum()) / WINDOW + bias
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    return float((sums[WINDOW:] - sums[:-WINDOW]).max()) / WINDOW + bias


def score_documents(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """``docs`` without the text, with toxic_score from 0 to 1. ``model`` is a broadcast of a trained model
    (half a megabyte, whatever the data)."""

    docs = docs.drop("toxic_score")

    def run(batches):
        import math

        import numpy as np
        import pyarrow as pa

        known: dict[str, int] = {}
        added = np.zeros(0)
        m = model.value
        for batch in batches:
            column = batch.schema.get_field_index(text)
            out, held, size = [], [], 0

            def flush():
                nonlocal added
                new = list({w for ws in held for w in ws} - known.keys())
                if len(known) + len(new) > KNOWN_WORDS:
                    known.clear()
                    added = np.zeros(0)
                    new = list({w for ws in held for w in ws})
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                added = np.concatenate([added, word_scores(m, Vocabulary(new))])
                for ws in held:
                    ids = np.fromiter((known[w] for w in ws), np.int64, len(ws))
                    x = m["scale"] * (worst_window(added[ids], repeats(ids), m["bias"]) - m["cut"])
                    out.append(1 / (1 + math.exp(-x)) if x >= 0 else math.exp(max(x, -700)) / (1 + math.exp(max(x, -700))))
                held.clear()

            for value in batch.column(column):
                s = value.as_py() or ""
                held.append(s.lower().split())
                size += len(s)
                if size > 2_000_000:
                    flush()
                    size = 0
            flush()
            rest = [i for i in range(batch.num_columns) if i != column]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], pa.array(out, pa.float64())], names=[*[batch.schema.names[i] for i in rest], "toxic_score"])

    fields = [f for f in docs.schema.fields if f.name != text]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("toxic_score", T.DoubleType())]))


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, train_chars: int = TRAIN_CHARS) -> dict:
    """A model from labelled rows outside the held-out fold: of each class ``rows_per_class`` documents of at most
    ``train_chars`` characters. Of a doc_id with several such texts one is taken."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    # One place a labelled document of fitting length; texts are fetched for the chosen only.
    fitting = docs.filter(F.length("text") <= train_chars).select("doc_id", F.xxhash64("text").alias("place")).join(known, "doc_id").groupBy("doc_id", "toxic").agg(F.min("place").alias("place"))
    fitting = written(fitting, "toxicity-labelled")
    few = [fitting.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class) for c in (0, 1)]
    # At most twice rows_per_class ids are broadcast, and as many texts of train_chars fetched.
    chosen = F.broadcast(few[0].unionByName(few[1])).alias("c")
    met = (F.col("d.doc_id") == F.col("c.doc_id")) & (F.xxhash64("d.text") == F.col("place"))
    rows = docs.select("doc_id", "text").alias("d").join(chosen, met).select("d.doc_id", "text", "toxic").distinct().collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"] for r in rows], [r["toxic"] for r in rows], prior)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))
