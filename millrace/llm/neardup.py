"""Near-duplicates by the similarity of their shingle sets: Jaccard of at least 0.8 over shingles of five words.

Shingles. A-Z are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``; a text of fewer than five words is one shingle, a text
without words, or null, has none. Shingles are compared by 64-bit hashes. Texts of equal sets form a class, which is one
row from there on, so groups of exact copies of any size cost one row.

Candidates of the trie. Each class has its text's SimHash over the same shingles (``simhash.fingerprint``). Classes of equal
fingerprints are candidates of the least of them, and the trie self-join (``simhash.hamming_forest``) gives a spanning
forest of those that differ in at most ``DISTANCE`` bits. A pair of similarity 0.8 differs in about 10 bits, more than
a trie can prune by, so it cannot give all candidates.

Candidates for the rest. ``BANDS`` keys of ``ROWS`` minima each are taken over a class's set; classes that share a key are candidates.
A pair of similarity 0.8 shares no key with a chance of (1 - 0.8^4)^32 < 5e-8, a more similar one with less. Texts that
merely share a passage are candidates too, so two sketches go along with a class and leave most of them: four bits of
each of ``SKETCH`` minima, of which a pair of similarity 0.8 has 52 of 64 equal on average and fewer than ``AGREE`` with
a chance below 1e-7; and the parities of ``PARITIES`` buckets of shingles, of which a pair can differ in no more than
its sets do, a ninth of both sizes at similarity 0.8.

Links. Every link is verified on the whole sets, which only classes of such pairs have made. First the trie's
candidates are, and each class is held against the least and the greatest class of its keys, which joins most. Then rounds hold each class against the most
promising class of another component in each of its keys, until no round joins any; and last all candidates that are
still in different components and were not compared are. So every candidate pair of similarity 0.8 ends in one
component, and a tight group costs no square. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, settle
from .components import connected_components, joined_components
from .simhash import fingerprint, hamming_forest, keep_first
from .wordhash import Sequences, U, Words, mix, slices, texts_of

SHINGLE = 5
DISTANCE = 3
BANDS, ROWS = 32, 4
SKETCH, AGREE, PARITIES = 64, 34, 512
SIGNS = [f"s{k}" for k in range(SKETCH // 16 + PARITIES // 64)]
_BASE = 0xD1342543DE82EF95
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = mix(np.arange(1, BANDS * ROWS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_FLIP = mix(np.arange(1, BANDS * ROWS + 1, dtype=U) * U(0xA0761D6478BD642F))


def shingles(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct shingles of each row, one after the other, and where each row's begin; some rows at a time."""
    data, offsets = texts_of(column)
    for i, j in slices(offsets):
        part = _LOWER[data[offsets[i] : offsets[j]]]
        words = Words(part, offsets[i : j + 1] - offsets[i])
        n = np.diff(words.first)
        k = np.minimum(n, SHINGLE)
        m = np.where(n > 0, n - k + 1, 0)
        row = np.repeat(np.arange(j - i), m)
        start = np.repeat(words.first[:-1], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        value = Sequences(words.hash, _BASE)(start, start + k[row])
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        row, value = row[new], value[new]
        yield value, np.searchsorted(row, np.arange(j - i + 1))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The class of each row, the size of its set, its fingerprint, its sketch and its keys; the empty set has no keys."""
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        fp = np.fromiter((fingerprint(t.as_py() or b"", SHINGLE) for t in texts), U, len(texts))
        classes, sizes, keys, sketches = [], [], [], []
        for value, head in shingles(batch.column(1)):
            n = np.diff(head)
            full, total = np.flatnonzero(n), np.zeros(len(n), U)
            got, sketch = np.zeros((len(n), BANDS), U), np.zeros((len(SIGNS), len(n)), U)
            if len(full):
                total[full] = np.add.reduceat(mix(value ^ U(0x2545F4914F6CDD1D)), head[full])
                for band in range(BANDS):
                    key = np.full(len(full), band + 1, U)
                    for f in range(band * ROWS, (band + 1) * ROWS):
                        least = np.minimum.reduceat((value ^ _FLIP[f]) * _ODD[f], head[full])
                        key = mix(key * U(_BASE) + least)
                        if f < SKETCH:
                            sketch[f // 16, full] |= (mix(least) & U(15)) << U(4 * (f % 16))
                    got[full, band] = key
                word, bit = (value >> U(32)) % U(PARITIES // 64), U(1) << (value % U(64))
                for w in range(PARITIES // 64):
                    sketch[SKETCH // 16 + w, full] = np.bitwise_xor.reduceat(np.where(word == U(w), bit, U(0)), head[full])
            sketches.append(sketch)
            classes.append(mix(total + n.astype(U)))
            sizes.append(n)
            keys.append(got)
        n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        ends = np.cumsum(np.where(n > 0, BANDS, 0))
        flat = np.concatenate(keys)[n > 0].ravel() if keys else np.zeros(0, U)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat.view(np.int64)))
        cls = np.concatenate(classes).view(np.int64) if classes else np.zeros(0, np.int64)
        sketch = np.concatenate(sketches, axis=1).view(np.int64) if sketches else np.zeros((len(SIGNS), 0), np.int64)
        columns = [batch.column(0), batch.column(2), pa.array(cls), pa.array(n.astype(np.int64)), pa.array(fp.view(np.int64)), *map(pa.array, sketch), lists]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "cls", "n", "fp", *SIGNS, "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [value[a:b].tobytes() for value, head in shingles(batch.column(1)) for a, b in zip(head[:-1], head[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["cls", "shingles"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
            if min(len(x), len(y)) * 5 >= max(len(x), len(y)) * 4:
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = both * 5 >= (len(x) + len(y) - both) * 4
        yield batch.select([0, 1]).filter(pa.array(good))


_NIBBLES = U(0x1111111111111111)


def _alike(n: np.ndarray, sketch: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether sizes and sketches of each pair allow the similarity, and how far apart the sketches are (0 to 2)."""
    fit = np.minimum(n[left], n[right]) * 5 >= np.maximum(n[left], n[right]) * 4
    differ, odd = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    for k, s in enumerate(sketch):
        t = s[left] ^ s[right]
        if k < SKETCH // 16:
            t |= t >> U(1)
            t |= t >> U(2)
            differ += np.bitwise_count(t & _NIBBLES)
        else:
            odd += np.bitwise_count(t)
    both = n[left] + n[right]
    return fit & (differ <= SKETCH - AGREE) & (odd * 9 <= both), differ / SKETCH + odd / np.maximum(both, 1)


def _near_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs ``a, b`` whose sizes and sketches allow the similarity."""
    for batch in batches:
        n, k = batch.num_rows, len(SIGNS)
        sizes = np.concatenate([batch.column(c).to_numpy() for c in (2, 3)])
        sketch = [np.concatenate([batch.column(c).to_numpy() for c in (4 + i, 4 + k + i)]).view(U) for i in range(k)]
        good, _ = _alike(sizes, sketch, np.arange(n), np.arange(n, 2 * n))
        yield batch.select([0, 1]).filter(pa.array(good))


def _nearest(side: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The places of the least ``far`` of each value of ``side``."""
    order = np.lexsort((far, side))
    return order[np.r_[True, side[order][1:] != side[order][:-1]]] if len(order) else order


def _apart(batches: Iterator[pa.RecordBatch], every: bool, rows: int = 1 << 17, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Pairs of one key and different components, of sizes and sketches that allow the similarity. Rows come by key and component.

    Unless ``every`` is set, only each class's nearest in a key.
    """

    def pairs(key, root, cls, n, *sketch):
        sketch = [s.view(U) for s in sketch]
        at = np.arange(len(key))
        new = np.r_[True, key[1:] != key[:-1]]
        end = np.r_[np.flatnonzero(new)[1:], len(key)][np.cumsum(new) - 1]
        new |= np.r_[True, root[1:] != root[:-1]]
        after = np.r_[np.flatnonzero(new)[1:], len(key)][np.cumsum(new) - 1]
        count = end - after
        total = np.cumsum(count)
        i = 0
        while i < len(key):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
            c = count[i:j]
            left = np.repeat(at[i:j], c)
            right = np.repeat(after[i:j], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            fit, far = _alike(n, sketch, left, right)
            left, right, far = left[fit], right[fit], far[fit]
            if not every:
                chosen = np.union1d(_nearest(left, far), _nearest(right, far))
                left, right = left[chosen], right[chosen]
            a, b = cls[left], cls[right]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
            i = j

    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(k).to_numpy() for k in range(4 + len(SIGNS))])
        size += batch.num_rows
        if size < rows:
            continue
        now = [np.concatenate(x) for x in zip(*held, strict=True)]
        cut = int(np.searchsorted(now[0], now[0][-1]))  # the last key may go on in the next batch
        if cut:
            yield from pairs(*[x[:cut] for x in now])
        held, size = [[x[cut:] for x in now]], len(now[0]) - cut
    if size:
        yield from pairs(*[np.concatenate(x) for x in zip(*held, strict=True)])


def trie_pairs(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs ``a, b`` of classes (``cls, fp``); their components are those of all pairs within ``DISTANCE`` bits."""
    first = scratch.keep(classes.groupBy("fp").agg(F.min("cls").alias("first")))
    equal = classes.join(first, "fp").select(F.col("first").alias("a"), F.col("cls").alias("b")).filter("a <> b")
    near = hamming_forest(first, "fp", DISTANCE)
    for end in ("a", "b"):
        near = near.join(first.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_")), end)
    near = near.select("a_", "b_").toDF("a", "b")
    return scratch.keep(equal.union(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, h, component_id`` for every row, ``h`` being its text's ``xxhash64``; ids must not be null."""
    with Scratch(docs.sparkSession) as scratch:
        return settle(_near_duplicates(docs, scratch, doc_id, text))


def _near_duplicates(docs: DataFrame, scratch: Scratch, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    prints = scratch.keep(rows.mapInArrow(_signatures, f"doc_id long, h long, cls long, n long, fp long, {', '.join(f'{c} long' for c in SIGNS)}, keys array<long>"))
    first = prints.groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    # a class is one row: copies bring the same set, so any of its smallest document's rows will do
    classes = prints.join(first, ["cls", "doc_id"]).dropDuplicates(["cls"])
    classes = scratch.keep(classes.select("cls", "doc_id", "h", "n", "fp", *SIGNS, "keys"))
    signs = classes.select("cls", "n", *SIGNS)
    placed = classes.select("cls", F.explode("keys").alias("key"))
    shared = placed.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low <> high")
    placed = scratch.keep(placed.join(shared, "key"))

    def with_signs(pairs, side, mark):
        return pairs.join(signs.select(F.col("cls").alias(side), *[F.col(c).alias(f"{mark}{c}") for c in ("n", *SIGNS)]), side)

    star = placed.select("cls", F.explode(F.array("low", "high")).alias("to")).filter("cls <> to")
    star = star.select(F.least("cls", "to").alias("a"), F.greatest("cls", "to").alias("b")).union(trie_pairs(classes.select("cls", "fp"), scratch)).distinct()
    star = with_signs(with_signs(star, "a", "x"), "b", "y").select("a", "b", "xn", "yn", *[f"{m}{c}" for m in "xy" for c in SIGNS])
    star = scratch.keep(star.mapInArrow(_near_ends, "a long, b long"))

    def links(pairs):
        """The pairs whose whole sets are similar. Only their classes' texts are read again."""
        named = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes, "cls").select("cls", "doc_id", "h")
        texts = rows.join(named, ["doc_id", "h"]).dropDuplicates(["cls"]).select("cls", F.col("text").cast("binary").alias("text"))
        sets = scratch.keep(texts.mapInArrow(_sets, "cls long, shingles binary"))
        both = pairs.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
        both = both.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a").select("a", "b", "x", "y")
        return scratch.keep(both.mapInArrow(_similar, "a long, b long"))

    def open_pairs(roots, every):
        rows = placed.select("key", "cls").join(roots, "cls", "left").select("key", F.coalesce("root", "cls").alias("root"), "cls")
        several = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
        rows = scratch.keep(rows.join(several, "key", "left_semi")).join(signs, "cls").select("key", "root", "cls", "n", *SIGNS)
        rows = rows.repartition("key").sortWithinPartitions("key", "root")
        return rows.mapInArrow(partial(_apart, every=every), "a long, b long").distinct()

    def joined(roots, more):
        return scratch.keep(joined_components(roots, more, "cls", "a", "b"))

    roots, compared = scratch.keep(connected_components(links(star), "a", "b").withColumnRenamed("node", "cls")), star
    while True:
        rest = scratch.keep(open_pairs(roots, False).join(compared, ["a", "b"], "left_anti"))
        if rest.isEmpty() or (more := links(rest)).isEmpty():
            break
        compared, roots = compared.union(rest), joined(roots, more)
    rest = scratch.keep(open_pairs(roots, True).join(compared, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        roots = joined(roots, links(rest))
    named = scratch.keep(classes.select("cls", "doc_id").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return prints.select("doc_id", "h", "cls").join(named.join(least, "root").select("cls", "component_id"), "cls").select("doc_id", "h", "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id, as in ``simhash``."""
    return keep_first(docs, near_duplicates(docs.filter(F.col(doc_id).isNotNull()), doc_id, text), doc_id, text)
