"""Language identification by prediction by partial matching (PPM).

Training. Per language a tree of byte contexts up to ``max_order`` bytes is counted on a bounded sample of rows and
frozen: the ``max_contexts`` contexts seen most often stay (the size of the model). Contexts are counted in tasks and
summed by Spark; the driver sees only those that stay. A byte unseen in a context escapes to the next shorter one (method
C: the escape has as many counts as the context has different bytes); below order 0 stand 256 equal chances. So each
language gives every byte after every context an exact code length.

Scoring. The contexts of all languages form one automaton whose state is the longest known context. It steps through
many texts at once, a byte each; code lengths of all languages for (state, byte) are precomputed. A state depends on
the last ``max_order`` bytes only, so texts are cut into pieces that are warmed up on the bytes before them, with no
effect on the sums; no text is shortened. The language of the least total code length wins, ties to the smaller name.

``score`` is the winner's share when each language weighs ``2^-(bits per byte)``-fold to the power ``sharpness``, a
number from 0 to 1. ``bits`` is the winner's code length per byte.

Learning uses at most ``sample_docs`` different texts of each language, chosen by a hash of the text, each as a whole;
this bound is the only place where rows are left out. Every language is learned, ``GROUP`` of them in one automaton, so
that tables grow with the languages and not with their square. Texts are lower-cased, digits become 0 and other white
space a space.

Nulls and edge cases: a text that is null or has no letter is ``und`` with score 0; rows without language are not
learned from; if nothing can be learned everything is ``und``; repeated rows get equal results; an empty table gives an
empty result; only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle, table

GROUP = 8
_LETTER = re.compile(r"[^\W\d_]")
_TIDY = {i: "0" for i in range(0x30, 0x3A)} | {i: " " for i in (9, 10, 11, 12, 13)}


def tidy(text: str) -> bytes:
    return text.lower().translate(_TIDY).encode("utf-8", "replace")


def context_tree(texts: list[bytes], max_order: int, max_contexts: int) -> dict[bytes, Counter]:
    """Counts of the next byte after each kept context; every suffix of a kept context is kept."""
    tree: dict[bytes, Counter] = {b"": Counter()}
    for text in texts:
        text = b" " + text
        for k in range(max_order + 1):
            for i in range(k, len(text)):
                tree.setdefault(text[i - k : i], Counter())[text[i]] += 1
    order = sorted(tree, key=lambda c: (-tree[c].total(), len(c), c))
    kept: dict[bytes, Counter] = {}
    for c in order:  # a suffix is seen at least as often, and is shorter, so it comes first
        if len(kept) >= max_contexts or tree[c].total() < 2 and c:
            break
        if not c or c[1:] in kept:
            kept[c] = tree[c]
    return kept


def refined(below: np.ndarray, seen: Counter) -> np.ndarray:
    """Chances of the 256 bytes after a context, from those after the next shorter one and its own counts."""
    n, d = seen.total(), len(seen)
    if not n:
        return below
    at = np.fromiter(seen, np.int64, d)
    escape, rest = d / (n + d), below.copy()
    rest[at] = 0  # bytes already refused here cannot follow the escape
    total = rest.sum()
    chance = rest * (escape / total) if total else rest
    chance[at] = np.fromiter(seen.values(), np.float64, d) / (n + d)
    return chance if total else chance / chance.sum()


@dataclass
class Model:
    languages: list[str]
    next: np.ndarray  # state * classes + class -> state * classes
    bits: np.ndarray  # state * classes + class -> bits by language
    classes: np.ndarray  # byte -> class
    n_classes: int
    max_order: int


def frozen(trees: dict[str, dict[bytes, Counter]], max_order: int) -> Model | None:
    """The automaton of some languages' trees. Shorter contexts come first, so each state builds on its suffix."""
    if not trees:
        return None
    used = sorted({b for t in trees.values() for b in t[b""]})
    classes = np.full(256, len(used), np.int32)  # bytes never learned share one class: their code lengths are equal
    classes[used] = np.arange(len(used))
    n = len(used) + 1
    unused = next((b for b in range(256) if b not in set(used)), None)
    alphabet = [*used, unused if unused is not None else used[-1]]
    states = sorted({c for t in trees.values() for c in t}, key=lambda c: (len(c), c))
    number = {c: i for i, c in enumerate(states)}
    children: dict[bytes, list[bytes]] = {}
    for c in states[1:]:
        children.setdefault(c[:-1], []).append(c)
    step, bits = np.zeros((len(states), n), np.int32), np.zeros((len(states), n, len(trees)), np.float32)
    chance = np.zeros((len(states), 256))
    for k, tree in enumerate(trees.values()):
        for i, c in enumerate(states):
            below = chance[number[c[1:]]] if c else np.full(256, 1 / 256)
            chance[i] = refined(below, tree[c]) if c in tree else below
        bits[:, :, k] = -np.log2(chance[:, alphabet])
    for i, c in enumerate(states):
        if c:
            step[i] = step[number[c[1:]]]
        for longer in children.get(c, ()):
            step[i, classes[longer[-1]]] = number[longer] * n
    return Model(list(trees), step.ravel(), bits.reshape(-1, len(trees)), classes, n, max_order)


def train(samples: dict[str, list[bytes]], max_order: int = 4, max_contexts: int = 4000) -> Model | None:
    return frozen({lang: context_tree(samples[lang], max_order, max_contexts) for lang in sorted(samples)}, max_order)


def frozen_all(trees: dict[str, dict[bytes, Counter]], max_order: int = 4) -> list[Model]:
    """Models of ``GROUP`` languages each. A language's code lengths do not depend on those it is grouped with."""
    names = sorted(trees)
    return [frozen({k: trees[k] for k in names[i : i + GROUP]}, max_order) for i in range(0, len(names), GROUP)]


def totals(model: Model, texts: list[bytes], piece: int = 512) -> np.ndarray:
    """Code lengths in bits of each text (rows) under each language (columns)."""
    out = np.zeros((len(texts), len(model.languages)))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = model.classes[np.frombuffer(b"".join(texts) + b" ", np.uint8)]
    base = np.cumsum(sizes) - sizes
    n = -(-sizes // piece)
    row = np.repeat(np.arange(len(texts)), n)
    begin = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * piece
    length = np.minimum(piece, sizes[row] - begin)
    order = np.argsort(-length, kind="stable")
    row, begin, length = row[order], begin[order], length[order]
    at = base[row] + begin
    start = model.next[model.classes[32]]  # the state after a space
    state = np.full(len(row), start, np.int32)
    for k in range(model.max_order, 0, -1):  # warm up; a text's first piece begins after a space
        back = begin >= k
        state[back] = model.next[state[back] + data[at[back] - k]]
    state[begin == 0] = start
    bits = np.zeros((len(row), len(model.languages)), np.float64)
    going = np.searchsorted(-length, -np.arange(piece), "left")  # pieces longer than k
    for k in range(piece):
        m = going[k]
        if not m:
            break
        cell = state[:m] + data[at[:m] + k]
        bits[:m] += model.bits[cell]
        state[:m] = model.next[cell]
    for k in range(len(model.languages)):
        out[:, k] = np.bincount(row, bits[:, k], minlength=len(texts))
    return out


def sample(docs: DataFrame, text: str, lang: str, sample_docs: int, broadcast_rows: int = 100_000) -> DataFrame:
    """``lang, text`` of the bounded training sample. Copies of a text count once; texts are read again when hashes are chosen."""
    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    chosen = rows.select("lang", "h").distinct().withColumn("part", F.pmod("h", F.lit(64)))
    for dealt in (["lang", "part"], ["lang"]):  # so that a very common language is not one task's
        place = F.row_number().over(Window.partitionBy(*dealt).orderBy("h"))
        chosen = chosen.withColumn("place", place).filter(F.col("place") <= sample_docs)
    chosen = settle(chosen.select("lang", "h"))
    n = chosen.count()
    found = rows.join(F.broadcast(chosen) if n <= broadcast_rows else chosen, ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")
    return found.coalesce(max(1, n // 100))


def _contexts(max_order: int):
    """Counts of (context, next byte) by language. A code holds the order, the context's bytes and the byte after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py().decode("utf-8", "replace")
                if _LETTER.search(text):
                    held.setdefault(lang, []).append(b" " + tidy(text))
                    size += len(held[lang][-1])
                if size > 4_000_000:
                    yield from counted(held)
                    held, size = {}, 0
        yield from counted(held)

    def counted(held: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        for lang, texts in held.items():
            data = np.frombuffer(b"".join(texts), np.uint8)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            code = data.astype(np.int64)
            for k in range(max_order + 1):
                if k:
                    code[k:] += data[:-k].astype(np.int64) << 8 * k
                got, n = np.unique(code[place >= k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(got), pa.string()), pa.array(got | k << 56), pa.array(n)], names=["lang", "code", "n"])

    return run


def learn(rows: DataFrame, max_order: int, max_contexts: int) -> dict[str, dict[bytes, Counter]]:
    """``context_tree`` of each language of ``rows`` (``lang, text``), counted by Spark."""
    if not 0 <= max_order <= 6:
        raise ValueError("max_order must be from 0 to 6")
    counts = rows.select("lang", F.col("text").cast("binary")).mapInArrow(_contexts(max_order), "lang string, code long, n long")
    counts = settle(counts.groupBy("lang", "code").agg(F.sum("n").alias("n")).withColumn("context", F.shiftright("code", 8)))
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("total"), "context"))
    kept = counts.groupBy("lang", "context").agg(F.sum("n").alias("total")).filter("total >= 2 OR context = 0")
    kept = kept.withColumn("place", best).filter(F.col("place") <= max_contexts).select("lang", "context")
    trees: dict[str, dict[bytes, Counter]] = {}
    for lang, code, n in counts.join(kept, ["lang", "context"]).select("lang", "code", "n").collect():
        k = code >> 56
        data = (code & ((1 << 56) - 1)).to_bytes(7, "big")[6 - k :]
        trees.setdefault(lang, {}).setdefault(data[:-1], Counter())[data[-1]] = n
    return trees


def _predict(shared, sharpness: float, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: list[Model] = shared.value
        for batch in batches:
            lang, score, bits, i = [], [], [], 0
            texts = batch.column(1)
            while i < batch.num_rows:
                held, j, size = [], i, 0
                while j < batch.num_rows and (j == i or size < 2_000_000):
                    raw = texts[j].as_py()
                    raw = raw.decode("utf-8", "replace") if raw is not None else ""
                    held.append(tidy(raw) if models and _LETTER.search(raw) else None)
                    size += len(held[-1] or b"")
                    j += 1
                got = _choose(models, held, sharpness)
                lang += got[0]
                score += got[1]
                bits += got[2]
                i = j
            columns = [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), texts]
            columns = columns if keep_text else columns[:-1]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "lang_pred", "score", "bits", "text"][: len(columns)])

    return run


def _choose(models: list[Model], texts: list[bytes | None], sharpness: float) -> tuple[list, list, list]:
    lang, score, bits = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
    real = [k for k, t in enumerate(texts) if t]
    if real:
        languages = [x for m in models for x in m.languages]
        per = np.hstack([totals(m, [texts[k] for k in real]) for m in models]) / np.array([[len(texts[k])] for k in real])
        best = per.argmin(axis=1)
        share = 1 / np.exp2((per.min(axis=1, keepdims=True) - per) * sharpness).sum(axis=1)
        for k, b, s, x in zip(real, best, share, per.min(axis=1), strict=True):
            lang[k], score[k], bits[k] = languages[b], float(min(1.0, s)), float(x)
    return lang, score, bits


def identify(docs: DataFrame, learn_from: Column | None = None, text: str = "text", lang: str = "lang", max_order: int = 4, max_contexts: int = 4000, sample_docs: int = 150, sharpness: float = 8.0, keep_text: bool = False) -> DataFrame:
    """``row`` (a struct of all columns but the text, as c0, c1 ...), ``lang_pred, score, bits`` for every document, and its ``text`` if asked for."""
    learned = docs.filter(learn_from) if learn_from is not None else docs
    trees = learn(sample(learned, text, lang, sample_docs), max_order, max_contexts)
    shared = docs.sparkSession.sparkContext.broadcast(frozen_all(trees, max_order))
    rest = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text]
    rows = docs.select(F.struct(*rest).alias("row"), F.col(text).cast("string").cast("binary").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_predict(shared, sharpness, keep_text), f"row {kind}, lang_pred string, score double, bits double" + ", text binary" * keep_text)


def in_known_language(docs: DataFrame, text: str = "text", lang: str = "lang", languages: Sequence[str] | None = None, min_score: float = 0.0, max_bits: float = 8.0, **params) -> DataFrame:
    """The rows of ``docs`` that are in one of ``languages`` (any learned one, if not given). Columns stay as they are.

    A row goes if it is ``und``, if its language is another, if the language's ``score`` is below ``min_score``, or if
    its code length is over ``max_bits`` a byte: eight are what a byte costs without any model, so a text over that is
    not in the language named, only nearest to it.
    """
    found = identify(docs, None, text, lang, keep_text=True, **params).filter("lang_pred <> 'und'")
    found = found.filter((F.col("score") >= min_score) & (F.col("bits") <= max_bits))
    if languages is not None:
        found = found.filter(F.col("lang_pred").isin(list(languages)))
    return found.select(*[F.col("text").cast("string").alias(c) if c == text else F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, ~held_out(F.col("doc_id")))
    return found.select(F.col("row.c0").alias("doc_id"), held_out(F.col("row.c0")).alias("held_out"), "lang_pred", "score")
