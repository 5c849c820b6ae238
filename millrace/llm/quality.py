"""Text quality from weak labels: expectation-maximisation over heuristics, then a hashed linear scorer.

Labellers. Each heuristic looks at some measures of the whole text and votes good, bad, or nothing; they overlap. Votes of all
documents are counted by pattern (at most 3^labellers patterns, summed in tasks and then by Spark), and the counts are
all that the driver sees.

Label model. Given the hidden class, votes are taken as independent. EM finds the share of good texts and, for each
labeller and class, how often it is right; it starts from labellers that are right more often than not, so the classes
cannot swap. A pattern's posterior is the soft label of its texts.

Scorer. Features are word hashes, hashes of word shapes (letters, capitals, digits and other signs, runs collapsed),
pairs of shapes, and repeats of the word before; a feature's value is its share of the text's words. Logistic regression
is fitted to the soft labels of at most ``sample_docs`` different texts, chosen by a hash of the text (a documented
bound: the only place where rows are left out), and scores every document. Texts and their features stay in the tasks:
each round of the fit sums the gradient there, and the driver sees ``PARTS`` vectors of fixed length.

Nulls and edge cases: a null or empty text has score and posterior 0 and is not kept; if no document has words, nothing
is fitted and all scores are the posteriors; repeated rows get equal results; an empty table gives an empty result; only
the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, table
from .wordhash import SPACE, U, Words, mix, slices, texts_of

BITS = 18
PARTS = 8
ABSTAIN, BAD, GOOD = 0, 1, 2

_KIND = np.full(256, 3, np.uint8)  # 0 space, 1 small letter or non-ASCII, 2 capital, 3 other sign, 4 digit, 5 ends of clauses
_KIND[SPACE] = 0
_KIND[np.arange(ord("a"), ord("z") + 1)] = 1
_KIND[128:] = 1
_KIND[np.arange(ord("A"), ord("Z") + 1)] = 2
_KIND[np.arange(ord("0"), ord("9") + 1)] = 4
_KIND[[ord(c) for c in ".,;:'\"-?()"]] = 5

#: measure: bad below, good from, good up to, bad above
LIMITS = {
    "signs": (-1, -1, 0.03, 0.08),
    "capitals": (-1, -1, 0.15, 0.40),
    "distinct": (0.30, 0.45, 9, 9),
    "stutter": (-1, -1, 0.05, 0.30),
    "letterless": (-1, -1, 0.05, 0.15),
    "odd_ends": (-1, -1, 0.15, 0.40),
    "word_length": (2.5, 3.5, 7.0, 12.0),
    "words": (5, 30, 1e18, 1e18),
}
#: Labellers: one votes bad if a measure of its is bad, good if all are good. They overlap, so that each kind of bad
#: text is seen by most of them; a labeller of one measure would call all other kinds good.
LABELLERS = (
    ("characters", ("signs", "capitals")),
    ("endings", ("odd_ends", "capitals")),
    ("vocabulary", ("letterless", "distinct", "word_length")),
    ("repetition", ("stutter", "distinct")),
    ("tokens", ("letterless", "signs", "stutter")),
    ("form", ("odd_ends", "letterless", "distinct")),
    ("flow", ("odd_ends", "stutter", "word_length")),
    ("length", ("words",)),
)


@dataclass
class Batch:
    """Measures of a slice of rows, and what the features are made of."""

    n: np.ndarray
    measures: dict[str, np.ndarray]
    first: np.ndarray
    word: np.ndarray
    shape: np.ndarray
    repeat: np.ndarray


def measure(data: np.ndarray, bounds: np.ndarray) -> Batch:
    words = Words(data, bounds)
    kind = _KIND[data]
    n = np.diff(words.first)

    def per_row(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(flags, dtype=np.int64)]
        return sums[first[1:]] - sums[first[:-1]]

    small, capital, sign, digit = (per_row(kind == k, bounds) for k in (1, 2, 3, 4))
    row = np.repeat(np.arange(len(n)), n)
    own = mix(words.hash ^ mix(row.astype(U)))  # tells rows apart
    repeat = np.zeros(len(own), bool)
    repeat[1:] = own[1:] == own[:-1]
    order = np.argsort(own, kind="stable")
    fresh = np.ones(len(own), bool)
    fresh[order[1:]] = own[order[1:]] != own[order[:-1]]
    letters = np.r_[0, np.cumsum((kind == 1) | (kind == 2), dtype=np.int64)]
    end = kind[words.stop - 1]
    total = np.maximum(n, 1)
    distinct = per_row(fresh, words.first) / total
    measures = {
        "signs": sign / np.maximum(small + capital + sign + digit, 1),
        "capitals": capital / np.maximum(small + capital, 1),
        # long texts repeat common words: the share expected at 200 words
        "distinct": np.minimum(1.0, distinct * np.maximum(total / 200.0, 1.0) ** 0.15),
        "stutter": per_row(repeat, words.first) / total,
        "letterless": per_row(letters[words.stop] == letters[words.start], words.first) / total,
        "odd_ends": per_row(end == 3, words.first) / total,
        "word_length": per_row(words.stop - words.start, words.first) / total,
        "words": n.astype(float),
    }
    return Batch(n, measures, words.first, words.hash, _shapes(kind, words), repeat)


def _shapes(kind: np.ndarray, words: Words) -> np.ndarray:
    """A hash of each word's kinds of bytes, runs collapsed."""
    if not len(words.start):
        return words.hash
    change = np.ones(len(kind), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[words.start] = True
    change &= kind != 0
    at = np.flatnonzero(change)
    head = np.searchsorted(at, words.start)
    place = np.arange(len(at)) - np.repeat(head, np.diff(np.r_[head, len(at)]))
    return mix(np.add.reduceat(mix(place.astype(U) * U(8) + kind[at].astype(U)), head))


def votes(batch: Batch) -> np.ndarray:
    """One vote for each row and labeller; a text without words gets none."""
    out = np.zeros((len(batch.n), len(LABELLERS)), np.int64)
    bad, good = {}, {}
    for name, (bad_below, good_from, good_to, bad_above) in LIMITS.items():
        x = batch.measures[name]
        bad[name], good[name] = (x < bad_below) | (x > bad_above), (x >= good_from) & (x <= good_to)
    for k, (_, names) in enumerate(LABELLERS):
        any_bad, all_good = np.logical_or.reduce([bad[n] for n in names]), np.logical_and.reduce([good[n] for n in names])
        out[:, k] = np.where(any_bad, BAD, np.where(all_good, GOOD, ABSTAIN))
    out[batch.n == 0] = ABSTAIN
    return out


def pattern(vote: np.ndarray) -> np.ndarray:
    """Votes as one number; 0 has no vote at all."""
    return vote @ (3 ** np.arange(vote.shape[1]))


@dataclass
class LabelModel:
    good: float
    right: np.ndarray  # [class bad, good][labeller]: how often a vote is right

    def posterior(self, vote: np.ndarray) -> np.ndarray:
        """Chance that each row of votes belongs to a good text."""
        score = np.log(self.good) - np.log(1 - self.good) + np.zeros(len(vote))
        for k in range(vote.shape[1]):
            bad, good = self.right[:, k]
            score += np.where(vote[:, k] == GOOD, np.log(good / (1 - bad)), 0) + np.where(vote[:, k] == BAD, np.log((1 - good) / bad), 0)
        return 1 / (1 + np.exp(-np.clip(score, -500, 500)))


def fit_labels(vote: np.ndarray, count: np.ndarray, rounds: int = 200, smooth: float = 1.0) -> LabelModel:
    model = LabelModel(0.7, np.full((2, vote.shape[1]), 0.8))
    for _ in range(rounds):
        p = model.posterior(vote)
        w = np.stack([(1 - p) * count, p * count])
        right = np.empty_like(model.right)
        for c, own in ((0, BAD), (1, GOOD)):
            hit = w[c] @ (vote == own)
            right[c] = (hit + 4 * smooth) / (hit + w[c] @ ((vote != own) & (vote != ABSTAIN)) + 5 * smooth)
        new = LabelModel(float((w[1].sum() + smooth) / (w.sum() + 2 * smooth)), np.clip(right, 0.02, 0.995))
        done = abs(new.good - model.good) < 1e-9 and np.abs(new.right - model.right).max() < 1e-9
        model = new
        if done:
            break
    return model


def features(batch: Batch) -> list[np.ndarray]:
    """Buckets of each word's features."""
    pair = batch.shape.copy()
    pair[1:] = mix(batch.shape[1:] ^ (batch.shape[:-1] << U(1)))
    pair[np.minimum(batch.first[:-1], max(len(pair) - 1, 0))[batch.n > 0]] = 1
    kinds = (batch.word, batch.shape, pair, np.where(batch.repeat, U(11), U(12)))
    return [(mix(x ^ U(101 + k)) >> U(64 - BITS)).astype(np.int64) for k, x in enumerate(kinds)]


def score(weights: np.ndarray, bias: float, batch: Batch) -> np.ndarray:
    x = np.zeros(len(batch.word))
    for f in features(batch):
        x += weights[f]
    sums = np.r_[0, np.cumsum(x)]
    margin = bias + (sums[batch.first[1:]] - sums[batch.first[:-1]]) / np.maximum(batch.n, 1)
    return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def step(weights: np.ndarray, bias: float, seen: np.ndarray, gradient: np.ndarray, n: float, rate: float = 0.5, decay: float = 1e-5) -> tuple[np.ndarray, float, np.ndarray]:
    """One round of AdaGrad over all rows; the last place of the vectors is the bias."""
    g = gradient / n
    g[:-1] += decay * weights
    seen = seen + g * g
    move = rate * g / np.sqrt(seen)
    return weights - move[:-1], bias - float(move[-1]), seen


def _gradient(shared):
    """Each task's sum of the rows' gradients, one row of fixed length, and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        out, n = np.zeros(len(weights) + 1), 0
        for batch in batches:
            for at, share, label in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                at, share = np.frombuffer(at.as_buffer(), np.int32), np.frombuffer(share.as_buffer(), np.float32)
                p = 1 / (1 + np.exp(-np.clip(bias + weights[at] @ share, -50, 50)))
                out[at] += (p - label) * share
                out[-1] += p - label
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary()), pa.array([n])], names=["gradient", "n"])

    return run


def fit_scorer(rows: DataFrame, rounds: int) -> tuple[np.ndarray, float] | None:
    """Weights and bias for ``at, share, label`` rows; None if there are none."""
    context = rows.sparkSession.sparkContext
    weights, bias, seen = np.zeros(1 << BITS), 0.0, np.full((1 << BITS) + 1, 1e-12)
    for _ in range(rounds):
        shared = context.broadcast((weights, bias))
        parts = rows.mapInArrow(_gradient(shared), "gradient binary, n long").collect()
        n = sum(r["n"] for r in parts)
        if not n:
            return None
        weights, bias, seen = step(weights, bias, seen, sum(np.frombuffer(r["gradient"], np.float64) for r in parts), n)
        shared.unpersist()
    return weights, bias


def _batches(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, Batch]]:
    data, offsets = texts_of(batch.column(column))
    for i, j in slices(offsets):
        yield i, j, measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(3 ** len(LABELLERS), np.int64)
    for batch in batches:
        for _, _, part in _batches(batch, 0):
            counts += np.bincount(pattern(votes(part)), minlength=len(counts))
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["pattern", "n"])


def _sampled(model: LabelModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, part in _batches(batch, 0):
                label, all_features = model.posterior(votes(part)), features(part)
                rows = []
                for k, (a, b) in enumerate(zip(part.first[:-1], part.first[1:], strict=True)):
                    at, n = np.unique(np.concatenate([f[a:b] for f in all_features]), return_counts=True)
                    if b > a:
                        rows.append({"at": at.astype(np.int32).tobytes(), "share": (n / (b - a)).astype(np.float32).tobytes(), "label": float(label[k])})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("at", pa.binary()), ("share", pa.binary()), ("label", pa.float64())]))

    return run


def _scores(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights, bias = shared.value
        for batch in batches:
            for i, j, part in _batches(batch, 1):
                soft = np.where(part.n > 0, model.posterior(votes(part)), 0.0)
                hard = soft if weights is None else np.where(part.n > 0, score(weights, bias, part), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(hard), pa.array(soft), pa.array(hard >= threshold)], names=["doc_id", "quality", "weak_label", "keep"])

    return run


def sample(rows: DataFrame, sample_docs: int) -> DataFrame:
    """At most ``sample_docs`` different texts, those of the least hashes; copies of a text count once."""
    hashed = rows.filter(F.col("text").isNotNull()).select("text", F.xxhash64("text").alias("h"))
    chosen = settle(hashed.select("h").distinct().orderBy("h").limit(sample_docs))
    return hashed.join(F.broadcast(chosen), "h").dropDuplicates(["h"]).select("text").coalesce(PARTS)  # at most sample_docs


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_docs: int = 4000, threshold: float = 0.5, rounds: int = 40) -> DataFrame:
    """``doc_id, quality, weak_label, keep`` for every document."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    found = rows.select("text").mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    known = np.array([r[0] for r in found], np.int64)
    vote = known[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    count = np.array([r[1] for r in found], float)
    model = fit_labels(vote, count) if len(found) else LabelModel(0.5, np.full((2, len(LABELLERS)), 0.8))
    fitted = settle(sample(rows, sample_docs).mapInArrow(_sampled(model), "at binary, share binary, label double"))
    weights, bias = fit_scorer(fitted, rounds) or (None, 0.0)
    return rows.mapInArrow(_scores(sc.broadcast((model, weights, bias)), threshold), "doc_id long, quality double, weak_label double, keep boolean")


def op9(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
