"""Removing passages that also start in an earlier document, by recompression.

A window is ``width`` (50) consecutive words of one document. A word goes if a window that covers it has a word
sequence that also starts in a document with a smaller id. Windows are judged on the input.

1. *Recompression.* Each text is parsed by rounds that merge runs of equal symbols and pairs of a left and a right
   symbol, where a bit of the symbol's name and the round says which it is. A name is a hash of the words it stands
   for, so naming is global: equal blocks have equal names in every document, without a dictionary to shuffle. Only
   symbols of at most ``cap`` words merge in a round, so whether two neighbours merge depends on ``cap`` words on
   either side: equal windows have the same block boundaries in their interior, ``margin`` words (the sum of the
   caps) from their ends. (Spark rounds that hand out names through a shuffle would move all word positions in every
   round; names taken from the content need none.)
2. *Interior symbols.* Of the whole blocks in a window's interior the one with the least name stands for the window,
   extended by ``margin`` words on both sides, which the window contains too. So equal windows have equal symbols.
   Consecutive windows with one symbol are a unit, some 20 of them; a unit's span is all words of its windows. A window
   whose interior is part of one long run stands for itself.
3. *Shared symbols.* A Spark aggregate finds the symbols of two documents or more, about a tenth. Units of equal symbol
   and span go in all documents but the smallest. Where a symbol has several spans, as at the ends of a shared passage,
   the smallest document of each span has its windows verified one by one: their 128-bit hashes are reduced to the
   smallest document, and windows of others go. (A window of any other document is in one of these too.)

Copies of a whole word sequence are found first by 128-bit hashes; only their smallest document goes on, so groups of
copies of any size cost one row each. Aggregates are partial before each shuffle, and the joins back to documents are
split by adaptive execution where one key is hot. Nothing is capped or sampled.

Nulls and edge cases: null text has no words; rows with a null id neither lose words nor make others lose them; rows
that share an id don't affect each other; documents of fewer than ``width`` words keep everything; an empty table gives
an empty result; other columns may have any name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, settle, table
from .wordhash import Sequences, U, Words, mix, slices, texts_of

WIDTH = 50
CAPS = (1, 1, 2)
SALTS = 32
#: Places of marks that stand for all windows of a unit and for a whole document.
UNIT, WHOLE = -1, -2
_BASES = (0xD6E8FEB86659FD93 & ~7 | 5, 0xA0761D6478BD642F & ~7 | 5)


def blocks(words: np.ndarray, first: np.ndarray, caps: tuple[int, ...] = CAPS) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the blocks of all rows (with the end as the last), and the blocks' names."""
    n, name = len(words), Sequences(words, _BASES[0])
    start = np.arange(n)
    fixed = np.zeros(n + 1, bool)
    fixed[first] = True
    for k, cap in enumerate(caps):
        stop = np.r_[start[1:], n]
        names, active = name(start, stop), stop - start <= cap
        left = mix(names ^ U(k + 1)) & U(1) == 1
        merge = active[1:] & active[:-1] & ~fixed[start[1:]] & ((names[1:] == names[:-1]) | (left[:-1] & ~left[1:]))
        start = start[np.r_[True, ~merge]] if n else start
    return np.r_[start, n], name(start, np.r_[start[1:], n])


class Parsed:
    """The windows of rows and the interior symbols that stand for them."""

    def __init__(self, words: np.ndarray, first: np.ndarray, width: int = WIDTH, caps: tuple[int, ...] = CAPS):
        margin, n = sum(caps), len(words)
        if width < 2 * margin + 2:
            raise ValueError("windows are too short for these caps")
        starts, names = blocks(words, first, caps)
        self.one, self.two = Sequences(words, _BASES[0]), Sequences(words, _BASES[1])
        count = np.maximum(np.diff(first) - width + 1, 0)
        self.row = np.repeat(np.arange(len(count)), count)
        self.place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.window = window = first[:-1][self.row] + self.place
        seen = np.zeros(n + 2, np.int64)
        seen[starts + 1] = 1
        np.cumsum(seen, out=seen)  # block starts before a place
        low, high = seen[window + margin], seen[window + width - margin + 1] - 1
        chosen = np.where(high > low, _least(names, low, high), -1 - window)
        self.width = width
        change = np.ones(len(window), bool)
        change[1:] = (chosen[1:] != chosen[:-1]) | (self.row[1:] != self.row[:-1])
        self.unit = np.cumsum(change) - 1
        of, head = chosen[change], window[change]
        block = np.maximum(of, 0)
        begin = np.where(of >= 0, starts[block] - margin, head) if len(of) else of
        end = np.where(of >= 0, starts[block + 1] + margin, head + width) if len(of) else of
        self.symbol = self.one(begin, end)
        self.symbol_row = self.row[change]
        last = np.r_[np.flatnonzero(change)[1:], len(window)][: len(head)] - 1
        self.span = self.two(head, window[last] + width)
        self.in_unit = window - head[self.unit] if len(window) else window

    def keys(self) -> np.ndarray:
        """One number for each unit's symbol and span."""
        return self.symbol ^ self.span

    def distinct_units(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, symbol and span of units, each once in a row: a text that repeats itself has many equal ones."""
        order = np.lexsort((self.span, self.symbol, self.symbol_row))
        row, symbol, span = self.symbol_row[order], self.symbol[order], self.span[order]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (symbol[1:] != symbol[:-1]) | (span[1:] != span[:-1])
        return row[first], symbol[first], span[first]

    def hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = self.window[at]
        return self.one(begin, begin + self.width), self.two(begin, begin + self.width)


def _least(names: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The place of the least name in each range, the leftmost of equals; for an empty range anything."""
    span = np.maximum(high - low, 1)
    table = [np.arange(len(names))]
    for k in range(int(span.max(initial=1)).bit_length() - 1):
        a, b = table[-1], np.r_[table[-1][1 << k :], table[-1][-1:].repeat(min(1 << k, len(names)))]
        table.append(np.where(names[b] < names[a], b, a))
    if not len(low):
        return low
    level = np.frexp(span)[1] - 1
    out = np.zeros(len(low), np.int64)
    low = np.minimum(low, len(names) - 1)
    for k, places in enumerate(table):
        at = np.flatnonzero(level == k)
        a, b = places[low[at]], places[np.maximum(high[at] - (1 << k), low[at])]
        out[at] = np.where(names[b] < names[a], b, a)
    return out


def _whole(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row's word sequence."""
    return tuple(Sequences(words, base)(first[:-1], first[1:]) for base in _BASES)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sliced(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, Words]]:
    data, offsets = texts_of(batch.column(column))
    for i, j in slices(offsets):
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _symbols(width: int, caps: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in _sliced(batch, 1):
                parsed = Parsed(words.hash, words.first, width, caps)
                h1, h2 = _whole(words.hash, words.first)
                row, symbol, span = parsed.distinct_units()
                cuts = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                symbols, spans = (pa.ListArray.from_arrays(pa.array(cuts), _signed(x)) for x in (symbol, span))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(np.diff(words.first)), _signed(h1), _signed(h2), symbols, spans], names=["doc", "n", "h1", "h2", "symbols", "spans"])

    return run


def _salted(lists: pa.ListArray, rows: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """A salt for each row; the items of all rows' lists, and their rows."""
    owner = np.repeat(np.arange(rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return mix(np.arange(1, rows + 1, dtype=U)), lists.flatten(), owner


def _windows(width: int, caps: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in _sliced(batch, 1):
                parsed = Parsed(words.hash, words.first, width, caps)
                salt, wanted, owner = _salted(batch.column(2)[i:j], j - i)
                key = parsed.keys()
                hit = np.isin(key ^ salt[parsed.symbol_row], wanted.to_numpy(zero_copy_only=False).view(U) ^ salt[owner])
                at = np.flatnonzero(hit[parsed.unit]) if len(hit) else np.zeros(0, np.int64)
                a, b = parsed.hashes(at)
                doc = batch.column(0)[i:j].to_numpy(zero_copy_only=False)[parsed.row[at]]
                yield pa.RecordBatch.from_arrays([_signed(a), _signed(b), pa.array(doc, pa.int64()), _signed(key[parsed.unit[at]]), pa.array(parsed.in_unit[at].astype(np.int32))], names=["w1", "w2", "doc", "key", "place"])

    return run


def _keep(width: int, caps: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            for i, j in slices(offsets):
                texts = [bytes(data[offsets[k] : offsets[k + 1]]) for k in range(i, j)]
                total, gone, kept = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64), []
                marks = batch.column(2)[i:j]
                marked = np.flatnonzero(marks.is_valid().to_numpy(zero_copy_only=False))
                stay = dict(zip(marked.tolist(), _stay([texts[k] for k in marked], marks.take(pa.array(marked)), width, caps), strict=True))
                for k, text in enumerate(texts):
                    words = text.split()
                    total[k] = len(words)
                    if k in stay:
                        gone[k] = len(words) - stay[k].sum()
                        words = compress(words, stay[k].tolist())
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(total), pa.array(gone), pa.array(kept, pa.binary())], names=["row", "n_words", "n_removed", "kept"])

    return run


def _stay(texts: list[bytes], marks: pa.ListArray, width: int, caps: tuple[int, ...]) -> list[np.ndarray]:
    """Which words of each text stay. Marks name content, so those of another row with the same id do no harm."""
    if not texts:
        return []
    bounds = np.cumsum([0, *map(len, texts)])
    words = Words(np.frombuffer(b"".join(texts), np.uint8), bounds)
    parsed, whole = Parsed(words.hash, words.first, width, caps), _whole(words.hash, words.first)[0]
    salt, items, owner = _salted(marks, len(texts))
    key, place = (items.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    key = key.view(U) ^ salt[owner]
    unit = parsed.keys() ^ salt[parsed.symbol_row]
    out = np.isin(unit, key[place == UNIT])[parsed.unit] if len(unit) else np.zeros(0, bool)
    single = place >= 0
    out |= np.isin(mix(unit[parsed.unit] + parsed.in_unit.astype(U)), mix(key[single] + place[single].astype(U)))
    depth = np.zeros(len(words.hash) + 1, np.int64)
    at = parsed.window[out]
    np.add.at(depth, at, 1)
    np.add.at(depth, at + width, -1)
    stay = np.cumsum(depth[:-1]) == 0
    copies = np.isin(whole ^ salt, key[place == WHOLE])
    return [np.zeros(b - a, bool) if copy else stay[a:b] for a, b, copy in zip(words.first[:-1], words.first[1:], copies, strict=True)]


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, caps: tuple[int, ...] = CAPS) -> DataFrame:
    """``doc, marks``: per id what repeats an earlier document, as structs ``key, place``.

    A place from 0 is a window of the unit that the key names, -1 the whole unit, and -2 the whole text, the key then
    being its hash.
    """
    with Scratch(docs.sparkSession) as scratch:
        return settle(_repeats(docs, scratch, doc_id, text, width, caps))


def _repeats(docs: DataFrame, scratch: Scratch, doc_id: str, text: str, width: int, caps: tuple[int, ...]) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("binary").alias("text")).filter("doc IS NOT NULL")
    parsed = scratch.keep(rows.mapInArrow(_symbols(width, caps), "doc long, n long, h1 long, h2 long, symbols array<long>, spans array<long>"))
    plain = parsed.select("doc", "n", "h1", "h2")
    first = plain.groupBy("h1", "h2", "n").agg(F.min("doc").alias("first"))
    copies = scratch.keep(plain.join(first, ["h1", "h2", "n"]).filter((F.col("first") < F.col("doc")) & (F.col("n") >= width)).select("doc", "h1").distinct())
    symbols = parsed.select("doc", "h1", F.explode("symbols").alias("symbol"))
    shared = symbols.groupBy("symbol").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("symbol")
    shared = scratch.keep(shared)  # a table of its own: joins with it can be split where one symbol is hot
    units = parsed.select("doc", "h1", F.explode(F.arrays_zip("symbols", "spans")).alias("unit")).select("doc", "h1", F.col("unit.symbols").alias("symbol"), F.col("unit.spans").alias("span"))
    units = units.join(shared, "symbol").join(copies, ["doc", "h1"], "left_anti").select("doc", "symbol", "span")
    units = scratch.keep(units)
    least = units.groupBy("symbol", "span").agg(F.min("doc").alias("first"))
    least = scratch.keep(least)
    several = least.groupBy("symbol").agg(F.min("span").alias("low"), F.max("span").alias("high")).filter("low < high")
    key = F.col("symbol").bitwiseXOR(F.col("span")).alias("key")
    later = units.join(least, ["symbol", "span"]).filter("first < doc").select("doc", key, F.lit(UNIT).alias("place"))
    # a very common symbol has many spans: its rows are dealt by span too, and the symbol is named to all of them
    salt = F.pmod("span", F.lit(SALTS)).cast("int").alias("salt")
    everywhere = several.select("symbol", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    ends = least.select("*", salt).join(everywhere, ["symbol", "salt"], "left_semi").select(F.col("first").alias("doc"), key)
    wanted = rows.join(ends.groupBy("doc").agg(F.collect_set("key").alias("keys")), "doc").select("doc", "text", "keys")
    windows = scratch.keep(wanted.mapInArrow(_windows(width, caps), "w1 long, w2 long, doc long, key long, place int"))
    lowest = windows.groupBy("w1", "w2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").drop("last")
    lowest = scratch.keep(lowest)
    single = windows.join(lowest, ["w1", "w2"]).filter("first < doc").select("doc", "key", "place")
    marks = later.union(single).union(copies.select("doc", "h1", F.lit(WHOLE)))
    return marks.groupBy("doc").agg(F.collect_set(F.struct("key", "place")).alias("marks"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, caps: tuple[int, ...] = CAPS) -> DataFrame:
    """``row`` (a struct of all columns but the text), ``n_words, n_removed, kept`` (kept words joined by a space)."""
    marks = repeats(docs, doc_id, text, width, caps)
    rest = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text]
    rows = docs.select(F.struct(*rest).alias("row"), F.col(text).cast("binary").alias("text"), F.col(doc_id).cast("long").alias("doc"))
    joined = rows.join(marks, "doc", "left").select("row", "text", "marks")
    kind = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(_keep(width, caps), f"row {kind}, n_words long, n_removed long, kept binary").withColumn("kept", F.col("kept").cast("string"))


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = None, **params) -> DataFrame:
    """``docs`` with repeated passages cut out of the text. A text that loses nothing stays as it is, white space included.

    ``n_chars`` names a column that is set to the new length in characters where a text changes.
    """
    rest = {c: f"row.c{i}" for i, c in enumerate(docs.columns)}
    (own,) = fresh(docs.columns, "_text")
    found = without_repeats(docs.withColumn(own, F.col(text)), doc_id, own, **params)
    cut = F.col("n_removed") > 0

    def column(c):
        if c == text:
            return F.when(cut, F.col("kept")).otherwise(F.col(rest[c]))
        if c == n_chars:
            return F.when(cut, F.length("kept").cast(docs.schema[c].dataType)).otherwise(F.col(rest[c]))
        return F.col(rest[c])

    return found.select(*[column(c).alias(c) for c in docs.columns])


def op6(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.c0").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), starts AS (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 49, 0)::BIGINT + 1)) AS p FROM d
), windows AS (
  SELECT doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS h FROM starts
), hits AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS f FROM windows) WHERE f < doc_id
), gone AS (
  SELECT DISTINCT doc_id, p + i AS q FROM hits, range(0, 50) o(i)
), words AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS q FROM d
), kept AS (
  SELECT words.doc_id, count(*) AS k, string_agg(w, ' ' ORDER BY words.q) AS t FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.q = gone.q GROUP BY words.doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
