"""Benchmark decontamination by q-gram lemma filtering.

Texts are lower-cased and white space becomes single spaces; they are compared as code points. Each benchmark item is
cut into overlapping segments of ``length`` characters (one from each character on; a shorter item is one segment). A
document is contaminated by an item if some part of it is within ``edits`` edits of a segment (proportionally fewer for
a shorter one). So any ``length`` characters of an item are found, wherever in the item they begin. An item of fewer
than ``least`` characters is too short for the lemma; it contaminates documents that hold it exactly, as whole words.

A part within the budget shares at least ``length + 1 - q (edits + 1)`` q-grams with the segment, on diagonals (place
in the document minus place in the segment) that differ by at most ``edits``. So

1. a bit table tells which places of a document begin any q-gram of the benchmark, and stretches with too few are left;
2. in the others q-grams shared with each item are gathered in overlapping bands of diagonals, each twice as wide as
   the lemma needs, so that every match lies within one of them; a window over a band's q-grams gives the segments that
   hold enough of them;
3. these segments are verified by alignment within the band. Segments that begin alike at one place share the work up
   to where they part, and are left once they are over budget.

Equal segments of several items (a common instruction line, a template) are one segment with several owners. They are
looked for first, and q-grams of exactly these items are not looked up again where all owners are found already.

The filter loses nothing: any part within the edit budget meets both bounds. The benchmark is indexed on the driver in
blocks of about ``block_chars`` characters and each block is broadcast; a larger benchmark takes more passes over the
documents, not more memory. Documents are never shuffled: what is found goes along with its row, and texts are set
apart by more separators than the budget, so the result of a row depends on that row alone. Long texts are searched in
overlapping pieces.

Nulls and edge cases: null or empty texts are clean; items that are null, empty or without id are ignored; items of
equal text are all named; repeated rows get equal results; an empty benchmark leaves all clean; an empty table gives an
empty result; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .wordhash import Sequences, U, mix

Q = 8
SEPARATOR = 0x110000  # above all code points
_BASE = 0x9E3779B97F4A7C15
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_ENTRIES = 1 << 21
_PIECE = 2_000_000


def tidy(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit name of the q characters that begin at each place."""
    if len(data) < Q:
        return np.zeros(0, U)
    x = mix(data.astype(U) + U(1))
    for k in (1, 2, 4):
        x = x[:-k] * U(pow(_BASE, k, 1 << 64)) + x[k:]
    return mix(x)


def _runs(head: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``head, head + 1 ...`` for each head, ``n`` values each."""
    return np.repeat(head, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


@dataclass
class Places:
    """Where each q-gram of the index occurs in the segments of one kind."""

    head: np.ndarray
    body: np.ndarray
    place: np.ndarray


@dataclass
class Index:
    owners: list[list[int]]  # item ids of each distinct text, long ones first
    flat: np.ndarray  # code points of the long texts, one after the other
    begin: np.ndarray  # of each long text in ``flat``
    size: np.ndarray  # of each long text's segments
    budget: np.ndarray  # edits allowed for each segment of a text
    need: np.ndarray  # q-grams that a match shares at least
    final: np.ndarray  # each long text's last segment
    first: np.ndarray  # each long text's first segment among all
    group: np.ndarray  # of each segment: the text, or the set of texts that own it, or -1 if an equal one stands for it
    sets: list[np.ndarray] = field(default_factory=list)
    gram: np.ndarray = None  # sorted distinct q-grams
    gram_set: np.ndarray = None  # the group whose texts are exactly those with the q-gram, or -1
    bits: np.ndarray = None
    shift: int = 0
    shared: Places = None
    single: Places = None
    short: dict[int, list[tuple[np.ndarray, int]]] = field(default_factory=dict)

    def slot(self, g: np.ndarray) -> np.ndarray:
        return g >> U(self.shift)

    def texts(self, group: int) -> np.ndarray:
        n = len(self.size)
        return self.sets[group - n] if group >= n else np.array([group])


def build(items: list[tuple[int, str | None]], length: int = 64, edits: int = 4, least: int = 24) -> Index:
    owners: dict[str, list[int]] = {}
    for item, text in sorted(items, key=lambda x: (x[0] is None, x[0], x[1] or "")):
        body = tidy(text)
        if item is None or not body:
            continue
        own = owners.setdefault(body, [])
        if not own or own[-1] != item:
            own.append(item)
    bodies = sorted(owners, key=lambda b: (len(b) < least, b))
    long = [codes(b) for b in bodies if len(b) >= least]
    sizes = np.array([len(b) for b in long], np.int64)
    size = np.minimum(length, sizes)
    budget = np.minimum(edits, size * edits // length)
    need = size + 1 - Q * (budget + 1)
    if len(need) and need.min() < 1:
        raise ValueError("the edit budget leaves no shared q-gram; allow fewer edits or longer items")
    n, count = len(long), sizes - size + 1
    flat = np.concatenate(long) if long else np.zeros(0, np.uint32)
    index = Index([owners[b] for b in bodies], flat, np.cumsum(sizes) - sizes, size, budget, need, sizes - size, np.cumsum(count) - count, np.zeros(0, np.int64))
    for k in range(n, len(bodies)):
        index.short.setdefault(len(bodies[k]), []).append((codes(bodies[k]), k))
    if not n:
        return index
    # equal segments: one stands for all, with the set of texts that own it
    body, start = np.repeat(np.arange(n), count), _runs(np.zeros(n, np.int64), count)
    names = [Sequences(mix(flat.astype(U) + U(1)), base)(index.begin[body] + start, index.begin[body] + start + size[body]) for base in _BASES]
    order = np.lexsort((start, body, names[1], names[0]))
    head = np.r_[True, (names[0][order][1:] != names[0][order][:-1]) | (names[1][order][1:] != names[1][order][:-1])]
    of = np.cumsum(head) - 1
    own = head | np.r_[True, body[order][1:] != body[order][:-1]]
    many = np.bincount(of[own]) > 1
    index.group = np.full(len(body), -1, np.int64)
    index.group[order[head]] = body[order[head]]
    marks = np.zeros(len(many), U)
    np.add.at(marks, of[own], mix(body[order][own].astype(U) + U(1)))
    known, at = np.unique(marks[many], return_index=True)
    if len(known):
        index.group[order[head][many]] = n + np.searchsorted(known, marks[many])
        edge = np.searchsorted(of[own], np.arange(len(many) + 1))
        members = body[order][own]
        index.sets = [members[edge[c] : edge[c + 1]] for c in np.flatnonzero(many)[at]]
    # q-grams, in the texts where they are part of a segment that stands for itself
    places = sizes - Q + 1
    body, place = np.repeat(np.arange(n), places), _runs(np.zeros(n, np.int64), places)
    g = grams(flat)[index.begin[body] + place]
    index.gram, at = np.unique(g, return_inverse=True)
    width = int(np.clip(np.ceil(np.log2(len(index.gram))) + 4, 12, 25))
    index.shift, index.bits = 64 - width, np.zeros(1 << width, bool)
    index.bits[index.slot(index.gram)] = True
    order = np.lexsort((place, body, at))
    body, place, at = body[order], place[order], at[order]
    fresh = np.r_[True, (at[1:] != at[:-1]) | (body[1:] != body[:-1])]
    marks = np.zeros(len(index.gram), U)
    np.add.at(marks, at[fresh], mix(body[fresh].astype(U) + U(1)))
    spot = np.minimum(np.searchsorted(known, marks), max(len(known) - 1, 0))
    index.gram_set = np.where(known[spot] == marks, n + spot, -1) if len(known) else np.full(len(marks), -1)
    low = index.first[body] + np.maximum(place - size[body] + Q, 0)
    high = index.first[body] + np.minimum(place, index.final[body]) + 1

    def occurrences(kind: np.ndarray) -> Places:
        sums = np.r_[0, np.cumsum(kind, dtype=np.int64)]
        on = sums[high] > sums[low]
        return Places(np.searchsorted(at[on], np.arange(len(index.gram) + 1)), body[on].astype(np.int32), place[on].astype(np.int32))

    index.shared, index.single = occurrences(index.group >= n), occurrences((index.group >= 0) & (index.group < n))
    return index


def search(index: Index, texts: list[str]) -> list[list[int]]:
    """Sorted ids of the items that contaminate each text."""
    found: list[set[int]] = [set() for _ in texts]
    if not index.owners or not texts:
        return [[] for _ in texts]
    pad = int(index.budget.max(initial=0)) + 1
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(sizes + pad)
    data = codes(("\0" * pad).join(texts) + "\0" * (pad + Q)).copy()
    for k in range(pad):
        data[end - 1 - k] = SEPARATOR
    data[end[-1] :] = SEPARATOR
    if index.short:
        _exact(index, data, end, found)
    if len(index.size):
        _near(index, data, end, found)
    return [sorted({i for b in bodies for i in index.owners[b]}) for bodies in found]


def _exact(index: Index, data: np.ndarray, end: np.ndarray, found: list[set[int]]) -> None:
    """Short items that a text holds as whole words."""
    edge = (data == 32) | (data == SEPARATOR)
    start = np.flatnonzero(~edge & np.r_[True, edge[:-1]])
    name = Sequences(mix(data.astype(U) + U(1)), _BASES[0])
    for size, items in index.short.items():
        at = start[start + size < len(data)]
        at = at[edge[at + size]]
        own = np.array([int(Sequences(mix(x.astype(U) + U(1)), _BASES[0])(np.array([0]), np.array([size]))[0]) for x, _ in items], U)
        order = np.argsort(own)
        names = name(at, at + size)
        spot = np.searchsorted(own[order], names)
        spot = np.minimum(spot, len(own) - 1)
        for i in np.flatnonzero(own[order][spot] == names):
            x, body = items[order[spot[i]]]
            if np.array_equal(data[at[i] : at[i] + size], x):
                found[int(np.searchsorted(end, at[i], "right"))].add(body)


def _near(index: Index, data: np.ndarray, end: np.ndarray, found: list[set[int]]) -> None:
    """Segments within their budget of a part of a text."""
    g = grams(data)
    maybe = index.bits[index.slot(g)]
    # a match of a segment of m characters covers at most m + e of the text
    span = int((index.size + index.budget).max()) - Q + 1
    count = np.r_[0, np.cumsum(maybe, dtype=np.int64)]
    full = np.flatnonzero(count[np.minimum(np.arange(len(g)) + span, len(g))] - count[:-1] >= index.need.min())
    if not len(full):
        return
    mark = np.zeros(len(g) + 1, np.int64)
    np.add.at(mark, full, 1)
    np.add.at(mark, np.minimum(full + span, len(g)), -1)
    at = np.flatnonzero((np.cumsum(mark[:-1]) > 0) & maybe)
    k = np.searchsorted(index.gram, g[at])
    real = (k < len(index.gram)) & (index.gram[np.minimum(k, len(index.gram) - 1)] == g[at])
    at, k = at[real], k[real]
    groups = len(index.size) + len(index.sets)
    if index.sets:
        pairs = _pieces(index, index.shared, data, end, at, k, span, found)
        known = {(int(p) // groups, int(p) % groups) for p in pairs}
        for text, group in known:
            found[text].update(index.texts(group).tolist())
        if known:
            own = np.searchsorted(end, at, "right") * groups + index.gram_set[k]
            left = ~((index.gram_set[k] >= 0) & np.isin(own, pairs))
            at, k = at[left], k[left]
    for p in _pieces(index, index.single, data, end, at, k, span, found):
        found[int(p) // groups].add(int(p) % groups)


def _pieces(index: Index, places: Places, data, end, at, k, span: int, found: list[set[int]]) -> np.ndarray:
    """Pairs (text, group) found. Pieces of bounded work overlap, so that no match is cut."""
    work = np.cumsum(places.head[k + 1] - places.head[k])
    out, i = [np.zeros(0, np.int64)], 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(work, (work[i - 1] if i else 0) + _ENTRIES, "right")))
        stop = int(np.searchsorted(at, at[j - 1] + 2 * span, "right"))
        out.append(_verified(index, places, data, end, at[i:stop], k[i:stop], found))
        i = j
    return np.unique(np.concatenate(out))


def _verified(index: Index, places: Places, data: np.ndarray, end: np.ndarray, at: np.ndarray, k: np.ndarray, found: list[set[int]]) -> np.ndarray:
    n = places.head[k + 1] - places.head[k]
    entry = _runs(places.head[k], n)
    body, place = places.body[entry].astype(np.int64), places.place[entry].astype(np.int64)
    diagonal = np.repeat(at, n) - place
    wide = int(index.budget.max()) + 1
    low = int(diagonal.min(initial=0))
    band = (diagonal - low) // wide  # and the band before: each band is two of these wide
    body, band, place = np.r_[body, body], np.r_[band, band - 1], np.r_[place, place]
    order = np.lexsort((place, band, body))
    body, band, place = body[order], band[order], place[order]
    # of each band, the segments that hold enough of its q-grams: ``need`` neighbours within a segment's reach
    need = index.need[body]
    first = np.flatnonzero(np.arange(len(body)) + need <= len(body))
    last = first + need[first] - 1
    reach = index.size[body[first]] - Q
    good = (body[last] == body[first]) & (band[last] == band[first]) & (place[last] - place[first] <= reach)
    first, last, reach = first[good], last[good], reach[good]
    lo, hi = np.maximum(place[last] - reach, 0), np.minimum(place[first], index.final[body[first]])
    if len(first):  # ranges of one band overlap; each begins and ends no sooner than the one before
        same = (body[first[1:]] == body[first[:-1]]) & (band[first[1:]] == band[first[:-1]])
        lo[1:] = np.where(same, np.maximum(lo[1:], hi[:-1] + 1), lo[1:])
    m = np.maximum(hi - lo + 1, 0)
    start = _runs(lo, m)
    body, begin = np.repeat(body[first], m), np.repeat(band[first], m) * wide + low
    group = index.group[index.first[body] + start]
    on = (group >= len(index.size)) if places is index.shared else (group >= 0) & (group < len(index.size))
    body, start, group, begin = body[on], start[on], group[on], begin[on] + start[on]
    middle = np.clip(begin + wide + index.size[body] // 2, 0, end[-1] - 1)
    text = np.searchsorted(end, middle, "right")
    if places is index.single and len(body):  # what a shared segment has shown already
        fresh = np.fromiter((b not in found[t] for t, b in zip(text.tolist(), body.tolist(), strict=True)), bool, len(body))
        body, start, group, begin, text = body[fresh], start[fresh], group[fresh], begin[fresh], text[fresh]
    pair = text * (len(index.size) + len(index.sets)) + group
    out = np.zeros(0, np.int64)
    order = np.lexsort((start, pair))
    size = np.bincount(np.unique(pair, return_inverse=True)[1]) if len(pair) else np.zeros(0, np.int64)
    rank = _runs(np.zeros(len(size), np.int64), size)
    turn = np.empty(len(pair), np.int64)
    turn[order] = np.where(rank == np.repeat(size // 2, size), 0, 1 + (rank % 16 != 8))
    # the middle segment of a pair settles most; then every sixteenth, then the others
    for t in range(3):
        left = np.flatnonzero((turn == t) & ~np.isin(pair, out))
        for i in range(0, len(left), 1 << 14):
            part = left[i : i + (1 << 14)]
            part = part[~np.isin(pair[part], out)]
            for length in np.unique(index.size[body[part]]):
                own = part[index.size[body[part]] == length]
                segments = index.flat[(index.begin[body[own]] + start[own])[:, None] + np.arange(length)]
                good = aligned(segments, data, begin[own], 2 * wide, index.budget[body[own]])
                out = np.union1d(out, pair[own[good]])
    return out


_MIX = mix(np.arange(1, Q + 1, dtype=U)) | U(1)


def aligned(segments: np.ndarray, data: np.ndarray, begin: np.ndarray, width: int, budget: np.ndarray) -> np.ndarray:
    """Whether each segment is within its budget of a part of ``data`` on the diagonals ``begin`` to ``begin + width``.

    Edit distance with free ends in the text, over a band widened by the budget on both sides. Rows of the table are
    kept once for all segments of one place that are equal so far, and not beyond the budget.
    """
    extra = int(budget.max())
    offset = np.arange(width + 2 * extra)
    ramp = offset.astype(np.int32)
    alive, good = np.arange(len(segments)), np.zeros(len(segments), bool)
    _, state = np.unique(mix(begin.astype(U)) + budget.astype(U), return_inverse=True)
    cost = np.zeros((int(state.max(initial=-1)) + 1, len(offset)), np.int32)
    for i in range(0, segments.shape[1], Q):
        piece = segments[alive, i : i + Q]
        key = (piece.astype(U) * _MIX[: piece.shape[1]]).sum(axis=1, dtype=U)
        _, own, now = np.unique(mix(key) + mix(state.astype(U)), return_index=True, return_inverse=True)
        cost, piece, first = cost[state[own]], piece[own], begin[alive[own]] - extra
        for j in range(piece.shape[1]):
            place = first[:, None] + (i + j) + offset
            text = np.where((place >= 0) & (place < len(data)), data[np.clip(place, 0, len(data) - 1)], SEPARATOR)
            new = cost + (text != piece[:, j : j + 1])
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(new - ramp, axis=1) + ramp
        stay = cost.min(axis=1) <= budget[alive[own]]
        on = stay[now]
        alive, state = alive[on], (np.cumsum(stay) - 1)[now[on]]
        cost = cost[stay]
        if not len(alive):
            return good
    good[alive] = True
    return good


def _cuts(text: str, reach: int) -> Iterator[str]:
    """A long text in pieces that begin and end at spaces and overlap by ``reach``."""
    at = 0
    while len(text) - at > _PIECE + reach:
        stop = text.find(" ", at + _PIECE)
        back = text.rfind(" ", at, stop - reach)
        if stop < 0 or back < at:
            break
        yield text[at:stop]
        at = back + 1
    yield text[at:]


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        reach = int((index.size + index.budget).max(initial=0)) + 2 * max(index.short, default=0) + 2
        for batch in batches:
            found: list[set[int]] = [set(x) for x in batch.column(2).to_pylist()]
            held, rows, size = [], [], 0
            for i, raw in enumerate(batch.column(1)):
                text = tidy(raw.as_buffer().to_pybytes().decode("utf-8", "replace")) if raw.is_valid else ""
                for piece in _cuts(text, reach):
                    held.append(piece)
                    rows.append(i)
                    size += len(piece)
                    if size >= _PIECE:
                        _add(index, held, rows, found)
                        held, rows, size = [], [], 0
            _add(index, held, rows, found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sorted(x) for x in found], pa.list_(pa.int64()))], names=["row", "text", "items"])

    return run


def _add(index: Index, held: list[str], rows: list[int], found: list[set[int]]) -> None:
    for i, items in zip(rows, search(index, held), strict=True):
        found[i].update(items)


def _indexes(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", block_chars: int = 4_000_000, **params) -> list:
    """A broadcast index for each block of the benchmark."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).cast("string").alias("text"))
    blocks = int((items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars + 1)
    parts = (items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) for k in range(blocks))
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast(build([tuple(r) for r in part.collect()], **params)) for part in parts]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", only_clean: bool = False, **params) -> DataFrame:
    """``row`` (all columns but the text, as c0, c1 ...), ``text`` in UTF-8 and ``items``, the items found. One scan, chained over blocks."""
    rest = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text]
    rows = docs.select(F.struct(*rest).alias("row"), F.col(text).cast("string").cast("binary").alias("text"), F.array().cast("array<long>").alias("items"))
    kind = f"row {rows.schema['row'].dataType.simpleString()}, text binary, items array<long>"
    for shared in _indexes(benchmark, **params):
        rows = rows.mapInArrow(_scan(shared), kind)
        rows = rows.filter(F.size("items") == 0) if only_clean else rows
    return rows


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates, with all their columns."""
    clean = contamination(docs, benchmark, text, only_clean=True, **params)
    return clean.select(*[F.col("text").cast("string").alias(c) if c == text else F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op5(spark, sf_dir: str, block_chars: int = 4_000_000) -> DataFrame:
    """Per document its id, whether it is contaminated, and the items found in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"), block_chars=block_chars)
    return found.select(F.col("row.c0").alias("doc_id"), (F.size("items") > 0).alias("contaminated"), "items")
