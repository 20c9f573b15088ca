"""Toxicity scores from subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word's character n-grams share hashed embedding vectors, so misspellings that were never seen still meet
known vectors. The vectors of a few neighbouring words are averaged and go through a linear softmax; a
document scores as its most toxic window, because a few words decide the label of a long text. Training
follows the same rule: each document teaches through its highest window, and toxic ones with a random part of their windows hidden, so
that more than their plainest words are learnt.

The model is linear after averaging, so executors need just one number per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_BITS = 17
DIMENSIONS = 16
SIZES = (3, 4, 5)
WINDOW = 5
FOLDS = 5

#: Bounds of the training sample: documents of each label, and bytes of text in all.
SAMPLE_ROWS = 2500
SAMPLE_BYTES = 16 << 20
EPOCHS = 12
BATCH = 50
RATE = 0.15
HIDDEN = 0.7
TOXIC_SHARE = 0.2
SEED = 11

#: Bytes that one round of arrays covers; longer texts go in stretches that overlap by a window.
STRETCH = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Grams:
    """Hashed n-grams of a run of bytes that begins and ends with white space, by the place they begin at.

    An n-gram stays within a word and the blanks around it. ``codes`` has a row for each size, -1 where there is none.
    """

    def __init__(self, raw: bytes):
        data = np.frombuffer(raw, dtype=np.uint8)
        space = _SPACE[data]
        data = np.where(space, np.uint8(32), data)
        n = len(data)
        spaces = np.cumsum(space, dtype=np.int32)
        self.codes = np.full((len(SIZES), n), -1, dtype=np.int32)
        hashed = data.astype(np.uint32)
        for size in range(2, max(SIZES) + 1):
            if n < size:
                break
            hashed = hashed[: n - size + 1] * np.uint32(0x01000193) + data[size - 1 :]
            if size in SIZES:
                inner = spaces[size - 2 : n - 1] == spaces[: n - size + 1]
                mixed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x9E3779B1)
                self.codes[SIZES.index(size), : n - size + 1] = np.where(inner, (mixed >> np.uint32(32 - BUCKET_BITS)).astype(np.int32), -1)
        #: Places of the blanks before each word, and of the last blank.
        starts = np.flatnonzero(space[:-1] & ~space[1:])
        self.begins = starts
        self.ends = np.append(starts[1:], n - 1)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end, as places, of each window of ``WINDOW`` words, or of all words if there are fewer."""
        words = len(self.begins)
        if words == 0:
            return self.begins, self.ends[:0]
        last = max(1, words - WINDOW + 1)
        return self.begins[:last], self.ends[min(WINDOW, words) - 1 :][:last]

    def logits(self, values: np.ndarray, bias: float) -> np.ndarray:
        """Logit of each window; ``values`` has a number for each bucket and 0 after them."""
        total = values[self.codes].sum(axis=0, dtype=np.float64)
        count = (self.codes >= 0).sum(axis=0)
        total, count = np.concatenate(([0], np.cumsum(total))), np.concatenate(([0], np.cumsum(count)))
        begin, end = self.windows()
        return (total[end] - total[begin]) / np.maximum(1, count[end] - count[begin]) + bias


def stretches(text: str) -> Iterator[bytes]:
    """The text's bytes, lower case, between blanks; long ones in stretches that share a window's words."""
    raw = text.lower().encode("utf-8", "replace")
    if len(raw) <= STRETCH:
        yield b" " + raw + b" "
        return
    at = 0
    while at < len(raw):
        piece = raw[at : at + STRETCH]
        if at + STRETCH >= len(raw):
            yield b" " + piece + b" "
            return
        words = piece.rsplit(maxsplit=WINDOW)
        keep = len(words[0]) if len(words) > 1 else 0
        cut = len(piece) - len(words[-1]) if keep and not piece[-1:].isspace() else len(piece)
        yield b" " + piece[:cut] + b" "
        at += max(1, keep if keep > STRETCH // 2 else cut)


class Model:
    """values: what each bucket adds to the difference of the two logits; bias: the rest of it."""

    def __init__(self, values: np.ndarray, bias: float):
        self.values, self.bias = np.append(values, np.float32(0)).astype(np.float32), float(bias)

    def score(self, text: str | None) -> float:
        best = -np.inf
        for raw in stretches(text or ""):
            logits = Grams(raw).logits(self.values, self.bias)
            if len(logits):
                best = max(best, float(logits.max()))
        return float(1 / (1 + np.exp(-np.clip(best, -40, 40)))) if best > -np.inf else 0.0


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Embeddings and softmax weights by AdaGrad, toxic documents having ``TOXIC_SHARE`` of the weight. With one label only, a constant model."""
    labels = np.array(labels, dtype=np.float64)
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(np.zeros(1 << BUCKET_BITS), 10.0 if len(labels) and labels[0] else -10.0)
    rng = np.random.default_rng(seed)
    embeddings = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2)
    squares, weight_squares, bias_squares = np.full(1 << BUCKET_BITS, 1e-6, dtype=np.float32), np.full(weights.shape, 1e-6), np.full(2, 1e-6)
    grams = [[Grams(raw) for raw in stretches(text)] for text in texts]
    share = np.where(labels == 1, TOXIC_SHARE / labels.mean(), (1 - TOXIC_SHARE) / (1 - labels.mean()))
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            values = np.append(embeddings @ (weights[:, 1] - weights[:, 0]), np.float32(0))
            codes, sizes, kept = [], [], []
            for i in order[at : at + BATCH]:
                seen = [(g, x) for g in grams[i] if len(x := g.logits(values, 0.0))]
                if labels[i]:  # hidden windows make the others teach, too
                    seen = [(g, np.where(rng.random(len(x)) < HIDDEN, -np.inf, x)) for g, x in seen]
                best = max(((g, k, x[k]) for g, x in seen for k in [int(x.argmax())]), key=lambda y: y[2], default=None)
                if best is None:
                    continue
                begin, end = (x[best[1]] for x in best[0].windows())
                own = best[0].codes[:, begin:end].ravel()
                own = own[own >= 0]
                if len(own):
                    codes.append(own)
                    sizes.append(len(own))
                    kept.append(i)
            if not kept:
                continue
            flat, sizes = np.concatenate(codes), np.array(sizes)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            means = np.add.reduceat(embeddings[flat], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0) / sizes[:, None]
            logits = means @ weights + bias
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            odds /= odds.sum(axis=1, keepdims=True)
            wrong = odds - np.stack([1 - labels[kept], labels[kept]], axis=1)
            wrong *= (share[kept] / len(kept))[:, None]
            to_means = (wrong @ weights.T) / sizes[:, None]
            to_weights, to_bias = means.T @ wrong, wrong.sum(axis=0)
            used, where = np.unique(flat, return_inverse=True)
            steps = np.zeros((len(used), DIMENSIONS))
            np.add.at(steps, where, to_means[owner])
            squares[used] += (steps**2).mean(axis=1)
            embeddings[used] -= (RATE * steps / np.sqrt(squares[used])[:, None]).astype(np.float32)
            weight_squares += to_weights**2
            weights -= (RATE * to_weights / np.sqrt(weight_squares)).astype(np.float32)
            bias_squares += to_bias**2
            bias -= RATE * to_bias / np.sqrt(bias_squares)
    return Model(embeddings @ (weights[:, 1] - weights[:, 0]), bias[1] - bias[0])


def fold(doc_id):
    """Fold of a document: crc32 of its id as text, modulo ``FOLDS``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def training_sample(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES, seed: int = SEED) -> tuple[list[str], list[int]]:
    """Texts and labels to learn from: at most ``rows`` documents of each label and ``size`` bytes, by hashed id.

    Held-out documents (fold 0), null labels and null texts are left out. A few ids are fetched first, then their texts.
    """
    known = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(fold(F.col("doc_id")) != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(seed))
    chosen = {}
    for label in (0, 1):
        chosen |= {r.doc_id: label for r in known.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(rows).collect()}
    if not chosen:
        return [], []
    spark = documents.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in chosen], f"doc_id {dict(documents.dtypes)['doc_id']}"))
    found = documents.select("doc_id", "text").where("text IS NOT NULL").join(wanted, "doc_id", "left_semi")
    sizes = found.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("n")).collect()
    # A digest of its own, as Python's hash of a text differs from process to process.
    rank = {i: k for k, i in enumerate(sorted(chosen, key=lambda i: xxhash.xxh64_intdigest(str(i), seed)))}
    held, kept = 0, set()
    for r in sorted(sizes, key=lambda r: rank[r.doc_id]):
        if held + r.n <= size:
            held += r.n
            kept.add(r.doc_id)
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in kept], f"doc_id {dict(documents.dtypes)['doc_id']}"))
    texts = {r.doc_id: r.text for r in found.join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text")).collect()} if kept else {}
    ids = sorted(texts)
    return [texts[i] for i in ids], [chosen[i] for i in ids]


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    A null, empty or blank text has no window and scores 0. Whole texts are read. Repeated rows each give a row;
    an empty table gives an empty result; other columns of the input are ignored. A null doc_id is not held out.
    """
    rows = documents.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
