"""Quality scores from a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its words and the shapes of its words (hashed, weighted by the logarithm of their counts, unit
length each), its structure (shares, each cut into steps, one feature a step) and what the table says of its length.
Every feature has a weight and a short vector; each pair of features interacts by the product of their vectors. By
sum of all pairs = ((sum v x)^2 - sum (v x)^2) / 2 a score takes time in proportion to the features.

Trained in numpy on a bounded sample; executors get the weights and vectors, a fixed 4 MB.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allometra.llm.tokens import Vocabulary, byte_table, raw_texts, stretches, tally
from allometra.llm.toxicity import SAMPLE_BYTES, SAMPLE_ROWS, fold, training_sample

WORD_BITS, SHAPE_BITS = 16, 12
FACTORS = 8
EPOCHS, BATCH, RATE, DECAY, SEED = 30, 50, 0.1, 1e-4, 23
CHANCE = 0.3

#: Shares of the words of a document, or of its lines, that lie in these steps are told apart.
SHARE_STEPS = np.array([0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.98])
LENGTH_STEPS = np.array([1.5, 2, 2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6, 6.5, 7, 8, 9, 11, 15])
COUNT_STEPS = 2.0 ** np.arange(1, 17)
STEPS = 17
#: Of words: with no letter or digit, all upper case, with marks besides letters and digits, with digits, as the one before,
#: ended by a stop. Of lines: repeated. Then distinct words a word, length of words, words, words a line, recorded length.
STATISTICS = ("blank", "upper", "marks", "digits", "again", "stops", "lines", "distinct", "length", "words", "line_words", "metadata")
WORDS_AT, SHAPES_AT = 0, 1 << WORD_BITS
STATISTICS_AT = SHAPES_AT + (1 << SHAPE_BITS)
FEATURES = STATISTICS_AT + len(STATISTICS) * STEPS

_TABLE = byte_table({b"\t\x0b\x0c\r": b" "}, lower=False)
_MARKS = re.compile(r"[^\w.,;:!?'\"()-]|_")


def _shape(word: str) -> str:
    """The word with runs of upper case, lower case and digits as one sign each, at most eight signs."""
    signs, last = [], ""
    for c in word[:64]:
        sign = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if sign != last:
            signs.append(sign)
            last = sign
    return "".join(signs[:8])


def _facts(word: bytes) -> tuple[int, int, int, bool, bool, bool, bool, bool]:
    """Bucket of the word and of its shape, characters; whether it has no letter or digit, is upper case, has marks, digits, ends in a stop."""
    text = word.decode("utf-8")
    bare = any(c.isalnum() for c in text)
    upper = sum(c.isupper() for c in text) > 1 and not any(c.islower() for c in text)
    bucket = xxhash.xxh3_64_intdigest(text.lower()) & ((1 << WORD_BITS) - 1)
    shape = xxhash.xxh3_64_intdigest(_shape(text)) & ((1 << SHAPE_BITS) - 1)
    return bucket, shape, len(text), not bare, upper, bool(_MARKS.search(text)), any(c.isdigit() for c in text), text[-1] in ".!?"


def _line_counts(raw: bytes) -> tuple[int, int]:
    """Lines with a character other than a blank, and how many of them are distinct."""
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(lines), len(set(lines))


class Features:
    """Features of many texts: ``at`` and ``x`` one text after the other, which begin at ``begins``."""

    def __init__(self, texts: list[bytes], recorded: list[int | None]):
        n = len(texts)
        vocabulary, ids, sizes, lines = Vocabulary(), [], np.zeros(n, dtype=np.int64), np.zeros((n, 2))
        for k, raw in enumerate(texts):
            clean = raw.translate(_TABLE)
            lines[k] = _line_counts(clean)
            for piece in stretches(clean.replace(b"\n", b" ")):
                ids.append(vocabulary.ids(piece.split()))
                sizes[k] += len(ids[-1])
        ids = np.concatenate([np.zeros(0, dtype=np.int32), *ids])
        facts = np.array([_facts(w) for w in vocabulary], dtype=np.int64).reshape(-1, 8)
        owner = np.repeat(np.arange(n), sizes)
        again = np.append(False, (ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1]))[: len(ids)]
        code, counts = tally(owner << 32 | ids)
        text, word = code >> 32, code & 0xFFFFFFFF
        total = np.maximum(1, sizes)

        def share(column: int) -> np.ndarray:
            return np.bincount(text, weights=facts[word, column] * counts, minlength=n) / total

        line_total = np.maximum(1, lines[:, 0])
        shares = [share(3), share(4), share(5), share(6), np.bincount(owner, weights=again, minlength=n) / total, share(7)]
        shares += [(lines[:, 0] - lines[:, 1]) / line_total, np.bincount(text, minlength=n) / total]
        known = np.array([0 if r is None or r < 0 else r + 1 for r in recorded], dtype=np.float64)
        steps = [np.searchsorted(SHARE_STEPS, s, side="left") for s in shares]
        steps += [np.searchsorted(LENGTH_STEPS, share(2)), *(np.searchsorted(COUNT_STEPS, c) for c in (sizes, sizes / line_total, known))]
        statistics = np.stack(steps) + (STATISTICS_AT + np.arange(len(steps)) * STEPS)[:, None]

        sets = [self._hashed(text, facts[word, column], counts, at) for column, at in ((0, WORDS_AT), (1, SHAPES_AT))]
        sets.append((np.tile(np.arange(n), len(steps)), statistics.ravel(), np.full(n * len(steps), len(steps) ** -0.5)))
        of, at, x = (np.concatenate(c) for c in zip(*sets))
        order = np.argsort(of, kind="stable")
        self.at, self.x, self.begins = at[order].astype(np.int64), x[order].astype(np.float32), np.searchsorted(of[order], np.arange(n))

    @staticmethod
    def _hashed(text: np.ndarray, buckets: np.ndarray, counts: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code, n = tally(text << 32 | buckets, counts)
        of, x = code >> 32, np.log1p(n)
        norm = np.sqrt(np.bincount(of, weights=x**2, minlength=int(of[-1]) + 1 if len(of) else 0))
        return of, (code & 0xFFFFFFFF) + offset, x / norm[of]

    def __len__(self) -> int:
        return len(self.begins)

    def rows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """at, x and begins of some texts."""
        ends = np.append(self.begins[1:], len(self.at))
        sizes = ends[chosen] - self.begins[chosen]
        begins = np.cumsum(sizes) - sizes
        where = np.arange(sizes.sum()) + np.repeat(self.begins[chosen] - begins, sizes)
        return self.at[where], self.x[where], begins


class Machine:
    """bias, a weight and a vector for each feature."""

    def __init__(self, bias: float, weights: np.ndarray, vectors: np.ndarray):
        self.bias, self.weights, self.vectors = float(bias), weights, vectors

    def logits(self, at: np.ndarray, x: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logit of each text and its sums of vectors, in time linear in the features; every text has features."""
        parts = self.vectors[at] * x[:, None]
        sums = np.add.reduceat(parts, begins, axis=0)
        pairs = 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((parts**2).sum(axis=1), begins))
        return self.bias + np.add.reduceat(self.weights[at] * x, begins) + pairs, sums

    def score(self, features: Features) -> np.ndarray:
        if len(features) == 0:
            return np.zeros(0)
        logits, _ = self.logits(features.at, features.x, features.begins)
        return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -40, 40)))


def train(texts: list[str], labels: list[int], recorded: list[int | None] | None = None, epochs: int = EPOCHS, seed: int = SEED) -> Machine:
    """Logistic loss by AdaGrad over shuffled batches. Without labels every score is 0.5, with one label only all are near it."""
    y = np.array(labels, dtype=np.float32)
    rng = np.random.default_rng(seed)
    weights, vectors = np.zeros(FEATURES, dtype=np.float32), rng.normal(0, 0.05, (FEATURES, FACTORS)).astype(np.float32)
    if len(y) == 0 or y.min() == y.max():
        return Machine(0.0 if len(y) == 0 else 10.0 if y[0] else -10.0, weights, np.zeros_like(vectors))
    features = Features([t.encode("utf-8", "replace") for t in texts], recorded or [None] * len(texts))
    machine = Machine(float(np.log(y.mean() / (1 - y.mean()))), weights, vectors)
    weight_squares, vector_squares, bias_squares = np.full(FEATURES, 1e-3, dtype=np.float32), np.full(vectors.shape, 1e-3, dtype=np.float32), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), BATCH):
            chosen = order[k : k + BATCH]
            at, x, begins = features.rows(chosen)
            logits, sums = machine.logits(at, x, begins)
            wrong = (1 / (1 + np.exp(-np.clip(logits, -40, 40))) - y[chosen]) / len(chosen)
            of = np.repeat(np.arange(len(chosen)), np.diff(np.append(begins, len(at))))
            pull = (wrong[of] * x).astype(np.float32)
            used, where = np.unique(at, return_inverse=True)
            to_weights = np.bincount(where, weights=pull, minlength=len(used)) + DECAY * machine.weights[used]
            to_vectors = np.zeros((len(used), FACTORS), dtype=np.float32)
            np.add.at(to_vectors, where, pull[:, None] * (sums[of] - machine.vectors[at] * x[:, None]))
            to_vectors += DECAY * machine.vectors[used]
            weight_squares[used] += to_weights**2
            machine.weights[used] -= (RATE * to_weights / np.sqrt(weight_squares[used])).astype(np.float32)
            vector_squares[used] += to_vectors**2
            machine.vectors[used] -= RATE * to_vectors / np.sqrt(vector_squares[used])
            bias_squares += wrong.sum() ** 2
            machine.bias -= float(RATE * wrong.sum() / np.sqrt(bias_squares))
    return machine


def fit(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Machine:
    """A machine from at most ``rows`` documents of each quality label and ``size`` bytes of text, none of them held out."""
    marked = labels.select("doc_id", F.col("quality").alias("toxic"))  # the sample is drawn by a column of that name
    texts, marks = training_sample(documents, marked, rows, size)
    return train(texts, marks, [len(t) for t in texts])


def score_documents(documents: DataFrame, machine: Machine, chance: float = CHANCE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; n_chars is read as metadata where the table has it as a whole number.

    Null, empty and blank texts have no words and are scored by their structure alone. Whole texts are read. Repeated rows
    each give a row; an empty table gives an empty result; other columns are ignored. A null doc_id is not held out.
    """
    types = dict(documents.dtypes)
    recorded = F.col("n_chars").cast("long") if types.get("n_chars") in ("tinyint", "smallint", "int", "bigint") else F.lit(None).cast("long")
    rows = documents.select("doc_id", "text", recorded.alias("recorded"))
    shared = documents.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score(Features(list(raw_texts(batch.column("text"))), batch.column("recorded").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = rows.mapInArrow(run, f"doc_id {types['doc_id']}, score double")
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", F.when(F.col("score") >= chance, 1).otherwise(0).alias("predicted"))
