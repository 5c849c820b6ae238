"""Token counts by a linear longest-match automaton.

A word is split greedily: always the longest vocabulary piece that the rest begins with. The automaton counts those
pieces in one walk over the word's bytes, without building them. It is the trie of the vocabulary, in which each node
has a failure link and the number of pieces that are popped when it is taken: if the node's string is itself a piece,
one piece is popped and the walk goes on where words continue; otherwise the popped pieces are those of the greedy split
of that string as far as it is settled. All words of a batch are walked at once, a byte each.

Two kinds of vocabularies are read: byte pieces with an end-of-word mark (``</w>``, a ``tokenizers`` file; a word's last
byte carries the mark)
and lists of pieces that continue a word with a prefix (``##``). A word that cannot be split is one unknown token.
Words are ``[^\\x20\\x09-\\x0D]+`` of the lower-cased text.

Nulls and edge cases: null and empty texts have no tokens; an empty vocabulary makes every word one unknown token; very
long words are walked in full; repeated rows get equal results; an empty table gives an empty result; only the named
columns are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .wordhash import Words, slices, texts_of

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
END = 256  # added to a word's last byte, if the vocabulary marks ends
_SYMBOLS = 512
_NONE = -1


def byte_names() -> dict[str, int]:
    """The public byte-level naming: printable Latin-1 bytes name themselves, the others 256, 257 ... in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Vocabulary:
    """Pieces as symbol sequences: those that begin a word and those that go on in it (the same if there is no prefix)."""

    first: list[tuple[int, ...]]
    later: list[tuple[int, ...]] | None = None

    @classmethod
    def marked_end(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        special = {t["content"] for t in data.get("added_tokens", [])}
        names, out = byte_names(), []
        for piece in data["model"]["vocab"]:
            if piece in special:
                continue
            body = piece.removesuffix("</w>")
            symbols = [names[c] for c in body]
            if symbols and body != piece:
                symbols[-1] += END
            out.append(tuple(symbols))
        return cls(sorted(x for x in out if x))

    @classmethod
    def prefixed(cls, pieces: Iterable[str], prefix: str = "##") -> Vocabulary:
        pieces = {p for p in pieces if p}
        first = sorted(tuple(p.encode()) for p in pieces if not p.startswith(prefix))
        return cls(first, sorted(tuple(p[len(prefix) :].encode()) for p in pieces if p.startswith(prefix) and p != prefix))


@dataclass
class Automaton:
    keys: np.ndarray  # open-addressing table of node * 512 + symbol
    child: np.ndarray
    fail: np.ndarray
    pops: np.ndarray
    roots: tuple[int, int]
    ends: bool  # whether the vocabulary marks the ends of words

    def step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = node.astype(np.int64) * _SYMBOLS + symbol
        mask = len(self.keys) - 1
        slot = _slot(key, mask)
        out = np.full(len(key), _NONE, np.int32)
        open_ = np.arange(len(key))
        while len(open_):
            at = slot[open_]
            seen = self.keys[at]
            hit = seen == key[open_]
            out[open_[hit]] = self.child[at[hit]]
            open_ = open_[~hit & (seen != _NONE)]
            slot[open_] = (slot[open_] + 1) & mask
        return out


def _slot(key: np.ndarray, mask: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)).astype(np.int64) & mask


def build(vocabulary: Vocabulary) -> Automaton:
    children: list[dict[int, int]] = [{}]
    parent, symbol = [_NONE], [_NONE]
    piece = [False]

    def add(root: int, word: tuple[int, ...]) -> None:
        at = root
        for s in word:
            if s not in children[at]:
                children[at][s] = len(children)
                children.append({})
                parent.append(at)
                symbol.append(s)
                piece.append(False)
            at = children[at][s]
        piece[at] = True

    for word in vocabulary.first:
        add(0, word)
    later = 0
    if vocabulary.later is not None:
        later = len(children)
        children.append({})
        parent.append(_NONE)
        symbol.append(_NONE)
        piece.append(False)
        for word in vocabulary.later:
            add(later, word)
    fail, pops = [_NONE] * len(children), [0] * len(children)
    layer = [c for r in {0, later} for c in children[r].values()]
    while layer:  # breadth first: links of shorter strings are known
        for v in layer:
            if piece[v]:
                fail[v], pops[v] = later, 1
                continue
            z, n = fail[parent[v]], pops[parent[v]]
            while z != _NONE and symbol[v] not in children[z]:
                n += pops[z]
                z = fail[z]
            if z != _NONE:
                fail[v], pops[v] = children[z][symbol[v]], n
        layer = [c for v in layer for c in children[v].values()]
    edges = [(v * _SYMBOLS + s, c) for v, own in enumerate(children) for s, c in own.items()]
    size = 1 << max(4, (2 * len(edges)).bit_length())
    keys, child = np.full(size, _NONE, np.int64), np.full(size, _NONE, np.int32)
    key, to = (np.array([e[i] for e in edges], np.int64) for i in (0, 1))
    slot = _slot(key, size - 1)
    left = np.arange(len(key))
    while len(left):  # one of those that want a free slot gets it, the others move on
        free = left[keys[slot[left]] == _NONE]
        at, who = np.unique(slot[free], return_index=True)
        keys[at], child[at] = key[free[who]], to[free[who]]
        left = left[keys[slot[left]] != key[left]]
        slot[left] = (slot[left] + 1) & (size - 1)
    ends = any(w[-1] >= END for w in vocabulary.first)
    return Automaton(keys, child, np.array(fail, np.int32), np.array(pops, np.int32), (0, later), ends)


def count(automaton: Automaton, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Tokens of each word ``data[start:stop]``."""
    order = np.argsort(start - stop, kind="stable")
    start, size = start[order], (stop - start)[order]
    node = np.full(len(start), automaton.roots[0], np.int32)
    tokens = np.zeros(len(start), np.int32)
    dead = np.zeros(len(start), bool)
    padded = data.astype(np.int64)
    walking = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")
    for k, m in enumerate(walking):
        symbol = padded[start[:m] + k] + (END if automaton.ends else 0) * (size[:m] == k + 1)
        todo = np.flatnonzero(~dead[:m])
        while len(todo):
            to = automaton.step(node[todo], symbol[todo])
            moved = to != _NONE
            node[todo[moved]] = to[moved]
            todo = _fall(automaton, todo[~moved], node, tokens, dead)
    todo = np.flatnonzero(~dead & (size > 0))
    while len(todo):  # what is left is popped until a word could go on from the root
        todo = _fall(automaton, todo, node, tokens, dead)
        todo = todo[node[todo] != automaton.roots[1]]
    tokens[dead] = 1
    out = np.empty_like(tokens)
    out[order] = tokens
    return out


def _fall(automaton: Automaton, who: np.ndarray, node: np.ndarray, tokens: np.ndarray, dead: np.ndarray) -> np.ndarray:
    at = node[who]
    to = automaton.fail[at]
    stuck = to == _NONE
    dead[who[stuck]] = True
    who, at, to = who[~stuck], at[~stuck], to[~stuck]
    tokens[who] += automaton.pops[at]
    node[who] = to
    return who


def _counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: Automaton = shared.value
        for batch in batches:
            _, offsets = texts_of(batch.column(1))
            for i, j in slices(offsets):
                texts = [(t.as_py() or b"").decode("utf-8", "replace").lower().encode() for t in batch.column(1)[i:j]]
                data = np.frombuffer(b"".join(texts), np.uint8)
                words = Words(data, np.cumsum([0, *map(len, texts)]), hashes=False)
                sums = np.r_[0, np.cumsum(count(automaton, data, words.start, words.stop), dtype=np.int64)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(np.diff(words.first)), pa.array(np.diff(sums[words.first]))], names=["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: Vocabulary | str = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens`` for every document. The vocabulary is a fixed file, read once on the driver."""
    automaton = build(Vocabulary.marked_end(vocabulary) if isinstance(vocabulary, str) else vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_counts(shared), "doc_id long, n_words long, n_tokens long")


def op7(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
