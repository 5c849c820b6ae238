"""Main text of web pages: host suffix arrays over every page's tokens, and containers that protect declared articles.

A page is cut into blocks of text. Elements that declare what they are never are text: menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments go, by element, role, or a word of class or id;
inside a container a class or id counts only if it names comments, adverts, forms or consent, and the container's own
header stays. The container of a page is ``article``, else ``main``. All other blocks of all pages meet their host.

The token streams of a host's pages are concatenated, and a suffix array sorted to ``length`` tokens (by prefix
doubling) finds every string of ``length`` tokens that two distinct pages share. Each host has two arrays: one of what
containers hold and one of what is outside of them, so a page without container is held against the surroundings of
other pages' articles, and an article that one page declares and another does not is lost on neither. Tokens that a
shared string covers are boilerplate and go; unique runs stay. Then containers are checked: a shared run inside one is a
mirrored article and stays, and of blocks outside only those of ``main`` around an article can be text, or all blocks of
a page that declares neither.

A host is dealt over shards of a bounded size of html, each page to one shard. Shards of hosts with several first
exchange short names of their strings; each shard's suffix array then reports the 128-bit name of a string that two of
its pages or, by its short name, another shard may have, and a string that two shards report is shared. So the outcome
is that of one suffix array over the whole host, whatever its size.

Pages are parsed once, in time linear in their length whatever their markup. The blocks of a task's pages are packed and
compressed by shard, moved to their shard once and kept there; after that only names move. Character references are
decoded, white space inside a block becomes one space, blocks are trimmed and joined in page order by a blank line.
Nothing else is dropped or capped.

Nulls and edge cases: null or empty html gives an empty text; a page without container whose tokens are all shared
gives an empty text; a quote that is never closed is an ordinary character, a tag that is never closed is text; null
urls and urls without host share one host of empty name; rows with equal id and url are one page to the suffix array,
so repeated rows get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bz2
import hashlib
import html as entities
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, settle, table
from .wordhash import Sequences, U, Words, mix

LENGTH = 8
#: What a block is to its page: in its container, left to its host, or beside a container that is the text.
INSIDE, OPEN, AROUND = 0, 1, 2

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?<![a-zA-Z_:-])([a-zA-Z_:-]++)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++)")
_BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_RAW = set("script style textarea title noscript iframe xmp noembed noframes template".split())
_DROP = set("nav footer aside form button select dialog svg object audio video canvas menu datalist input map applet".split())
_VOID = set("area base br col embed hr img input link meta source track wbr param".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
_WORDS = set("nav navbar navigation menu submenu header masthead footer sidebar aside ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay breadcrumb breadcrumbs pagination pager share sharing social related recommended comment comments disqus respond reply replies newsletter subscribe subscription signup login search skip toolbar widget".split())
#: Inside a container only these words of a class or id drop a block: a paragraph on notices or a post's header is text.
_CLEAR = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr comment comments disqus respond reply replies newsletter subscribe subscription signup login".split())


class _Tags:
    """Finds where tags end. A search that has failed once is not made again, so the work is linear in the page."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.open_quotes, self.quotes = set(), True

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag, or -1."""
        place = at
        while at <= place <= self.last and self.quotes:
            m = _STOP.search(self.page, place)
            if m is None:
                break
            if m.group() == ">":
                return m.start()
            place = m.end()
            if m.group() not in self.open_quotes:
                close = self.page.find(m.group(), place)
                if close < 0:
                    self.open_quotes.add(m.group())
                else:
                    place = close + 1
        if at > self.last:
            return -1
        self.quotes = False  # every later > lies in quotes that never match the tags: the first one ends a tag
        return self.page.find(">", at)


def _tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """``name, text, closing, attributes`` of tags, and text with an empty name. Content of raw elements is left out."""
    tags, at, missing = _Tags(page), 0, set()
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            start = len(page)
        if start > at:
            yield "", entities.unescape(page[at:start]), False, ""
            at = start
            continue
        found = next(((o, c) for o, c in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">")) if page.startswith(o, at)), None)
        if found:
            opened, closed = found
            end = page.find(closed, at + len(opened))
            if opened == "<![CDATA[":
                yield "", page[at + len(opened) : end if end >= 0 else len(page)], False, ""
            at = end + len(closed) if end >= 0 else len(page)
            continue
        m = _NAME.match(page, at + 1)
        end = tags.end(m.end()) if m else -1
        if end < 0:
            yield "", "<", False, ""
            at += 1
            continue
        name, closing, attributes = m.group(2).lower(), bool(m.group(1)), page[m.end() : end]
        at = end + 1
        yield name, "", closing, attributes
        if not closing and name in _RAW:  # its content is no markup
            close = None if name in missing else re.compile(rf"</{name}(?![a-zA-Z0-9:-])", re.I).search(page, at)
            end = page.find(">", close.end()) if close else -1
            if close is None:
                missing.add(name)
            at = end + 1 if end >= 0 else len(page)


def marked(page: str) -> list[tuple[int, str]]:
    """The blocks of a page that do not declare themselves as something else than text, with their marks."""
    out: list[tuple[int, int, str]] = []
    text: list[str] = []
    skipped, depth = "", 0  # the element that is dropped now, and how deep in elements of its name
    articles = mains = 0

    def flush() -> None:
        body = " ".join("".join(text).split())
        text.clear()
        if body:
            out.append((articles, mains, body))

    for name, piece, closing, attributes in _tokens(page):
        if not name:
            if not skipped:
                text.append(piece)
            continue
        if not closing and name in _RAW:
            if name in _BLOCK and not skipped:
                flush()
            continue
        if skipped:
            if name == skipped:
                depth += -1 if closing else not attributes.rstrip().endswith("/")
                if not depth:
                    skipped = ""
            elif closing and name in ("body", "html"):
                skipped = ""
            continue
        if name in _BLOCK:
            flush()
        elif name == "br":
            text.append(" ")
        inside = articles or mains
        if name == "article":
            articles = max(0, articles + (-1 if closing else 1))
        elif name == "main":
            mains = max(0, mains + (-1 if closing else 1))
        if not closing and name not in _VOID and _dropped(name, attributes, inside):
            if name == "article":
                articles -= 1
            elif name == "main":
                mains -= 1
            if not attributes.rstrip().endswith("/") or name in _BLOCK:
                skipped, depth = name, 1
    flush()
    if any(a for a, _, _ in out):
        return [(INSIDE if a else OPEN if m else AROUND, body) for a, m, body in out]
    if any(m for _, m, _ in out):
        return [(INSIDE if m else AROUND, body) for _, m, body in out]
    return [(OPEN, body) for _, _, body in out]


def blocks(page: str) -> list[tuple[bool, str]]:
    """The blocks of a page that can be its text, with whether a container declares them as content."""
    return [(mark == INSIDE, body) for mark, body in marked(page) if mark != AROUND]


def _dropped(name: str, attributes: str, inside: int) -> bool:
    if name in _DROP or name == "header" and not inside:
        return True
    if not attributes or name in ("html", "body"):
        return False
    words = _CLEAR if inside or name in ("article", "main") else _WORDS
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role" and value in _ROLES:
            return True
        if key in ("class", "id") and not words.isdisjoint(re.split(r"[^a-z]+", value)):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes)) or "display:none" in attributes.replace(" ", "")


#: Pages of one shard, packed: ``sizes`` has the bytes of each page's parts in ``text``, -1 for null.
_PACKED = "host string, shard long, shards long, page_id array<long>, key array<long>, sizes array<int>, text binary"
_PARTS = ("url", "marks", "inside", "outside")
#: A task packs its pages when their parts have so many bytes.
_HELD = 1 << 25
#: HTML that counts as one token of a shard, in bytes.
_TOKEN = 8


def _compressed(text: bytes) -> bytes:
    """By bzip2, in blocks no larger than needed: of prose it leaves an eighth less than zstd or zlib do."""
    return bz2.compress(text, min(9, len(text) // 100_000 + 1))


def _joined(parts: list[str]) -> bytes:
    """Blocks by line; no block has a line break."""
    return "\n".join(parts).encode("utf-8", "replace")


def _lines(text: bytes) -> list[str]:
    return text.decode("utf-8").split("\n") if text else []


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as blocks, those of a shard packed together. Rows have host, shard, shards, key, page_id, url, html."""
    held, weight = {}, 0
    for batch in batches:
        for *group, key, page_id, url, page in zip(*(batch.column(k).to_pylist() for k in range(6)), batch.column(6), strict=True):
            found = marked((page.as_py() or b"").decode("utf-8", "replace"))
            parts = (None if url is None else url.encode(), bytes(m for m, _ in found), _joined([b for m, b in found if m == INSIDE]), _joined([b for m, b in found if m != INSIDE]))
            held.setdefault(tuple(group), []).append((page_id, key, parts))
            weight += sum(len(x or b"") for x in parts) + 64
            if weight > _HELD:
                yield _pack(held)
                held, weight = {}, 0
    if held:
        yield _pack(held)


def _pack(held: dict[tuple, list[tuple]]) -> pa.RecordBatch:
    """One row per shard. Parts of a kind stand together: all urls, all marks, all text."""
    rows = []
    for group, pages in held.items():
        parts = [[x[k] for _, _, x in pages] for k in range(len(_PARTS))]
        sizes = [-1 if x is None else len(x) for kind in parts for x in kind]
        rows.append((*group, [i for i, _, _ in pages], [k for _, k, _ in pages], sizes, _compressed(b"".join(x or b"" for kind in parts for x in kind))))
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
    names = [x.split()[0] for x in _PACKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds, strict=True)], names=names)


def _unpack(row: dict) -> list[dict]:
    text, at, parts = bz2.decompress(row["text"]), 0, []
    for size in row["sizes"]:
        parts.append(None if size < 0 else text[at : at + size])
        at += max(size, 0)
    n = len(row["key"])
    return [{"page_id": row["page_id"][i], "key": row["key"][i]} | {kind: parts[k * n + i] for k, kind in enumerate(_PARTS)} for i in range(n)]


def suffix_array(tokens: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all strings of ``length`` tokens in the order of their first ``length`` tokens, and each one's rank.

    Prefix doubling: ranks of 1, 2, 4 ... tokens, the last step overlapping. A string does not leave its page.
    """
    n = len(tokens)
    page = np.repeat(np.arange(len(first) - 1), np.diff(first))
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    known = 1
    while known < length:
        step = min(known, length - known)
        follow = np.full(n, -1, np.int64)
        follow[: n - step] = np.where(page[: n - step] == page[step:], rank[step:], -1) if n > step else follow[: n - step]
        rank = np.unique(rank * (n + 1) + follow + 1, return_inverse=True)[1].astype(np.int64)
        known += step
    whole = np.flatnonzero(np.arange(n) + length <= first[1:][page]) if n else np.zeros(0, np.int64)
    order = whole[np.argsort(rank[whole], kind="stable")]
    return order, rank[order]


class _Side:
    """The tokens of some pages of a host, inside their containers or outside, and the names of their strings."""

    def __init__(self, host: str, pages: list[dict], side: str, length: int):
        self.texts = [x[side] for x in pages]
        words = Words(np.frombuffer(b"".join(self.texts), np.uint8), np.cumsum([0, *map(len, self.texts)]))
        self.tokens, self.first, self.length = words.hash, words.first, length
        self.salt = U(int.from_bytes(hashlib.blake2b(f"{side} {host}".encode("utf-8", "replace"), digest_size=8).digest()))

    def places(self) -> np.ndarray:
        """Where strings begin. A string does not leave its page."""
        at = np.arange(len(self.tokens))
        return at[at + self.length <= np.repeat(self.first[1:], np.diff(self.first))]

    def name(self, at: np.ndarray, base: int = 0x2545F4914F6CDD1D) -> np.ndarray:
        """64 bits of each string, also of its host and side."""
        return mix(Sequences(self.tokens, base)(at, at + self.length) ^ self.salt)

    def other(self, at: np.ndarray) -> np.ndarray:
        """64 more."""
        return self.name(at, 0xD1342543DE82EF95)


SIDES = ("inside", "outside")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[dict]]]:
    """Host, shard and its pages. Rows come by host and shard."""
    now, pages = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["host"], row["shard"]) != now:
                if pages:
                    yield *now, pages
                now, pages = (row["host"], row["shard"]), []
            pages += _unpack(row)
    if pages:
        yield *now, pages


def _slices(shards: int) -> tuple[int, int]:
    """How many slices the names of so many shards are dealt over, and how many more bits of a name make it short.

    A slice has the names of about eight shards' strings. By chance, one short name in a hundred meets one of another
    shard (at 500,000 tokens a shard), however many shards there are.
    """
    n = max(1, min(shards, max(16, shards // 8)))
    return n, 26 + (-(-shards // n) - 1).bit_length()


def _short(a: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Of a name: its slice of ``n``, and ``bits`` more."""
    return (a % U(n)) << U(32) | (a // U(n)) & U((1 << bits) - 1)


def _coded(values: np.ndarray) -> bytes:
    """Ascending numbers below 2^32 as a Rice code of their steps: the low bits as they are, the others in unary."""
    if not len(values):
        return b""
    steps = np.diff(values.astype(np.int64), prepend=0)
    k = max(0, int(steps.mean() * 0.7).bit_length() - 1)
    ends = np.cumsum((steps >> k) + 1)
    unary = np.zeros(int(ends[-1]), bool)
    unary[ends - 1] = True
    low = (steps[:, None] >> np.arange(k) & 1).astype(bool)
    return len(values).to_bytes(4, "little") + bytes([k]) + np.packbits(low).tobytes() + np.packbits(unary).tobytes()


def _decoded(code: bytes) -> np.ndarray:
    if not code:
        return np.zeros(0, U)
    n, k = int.from_bytes(code[:4], "little"), code[4]
    split = 5 + (n * k + 7) // 8
    low = np.unpackbits(np.frombuffer(code[5:split], np.uint8), count=n * k).reshape(n, k)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(code[split:], np.uint8)))[:n]
    steps = np.diff(ends, prepend=-1) - 1 << k
    for bit in range(k):
        steps += low[:, bit].astype(np.int64) << bit
    return np.cumsum(steps).astype(U)


def _by_slice(slices: np.ndarray) -> tuple[np.ndarray, list[slice]]:
    """The slices that occur in an ascending array, and where each is."""
    cut = np.flatnonzero(slices[1:] != slices[:-1]) + 1
    ends = [0, *cut.tolist(), len(slices)] if len(slices) else [0]
    return slices[ends[:-1]].astype(np.int64), [slice(i, j) for i, j in zip(ends, ends[1:])]


_HASHES = "slice long, host string, shard long, hashes binary"
_NAMES = "slice long, host string, shard long, names binary, sure binary"


def _table(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[kind]) for x, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def _values(length: int, n: int, bits: int):
    """Of each shard: the short names of its strings, by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for host, shard, pages in _shards(batches):
            sides = [_Side(host, pages, side, length) for side in SIDES]
            short = np.sort(_short(np.concatenate([s.name(s.places()) for s in sides]), n, bits))
            short = short[np.r_[True, short[1:] != short[:-1]]] if len(short) else short
            names, parts = _by_slice(short >> U(32))
            yield _table(_HASHES, names, [host] * len(names), [shard] * len(names), [_coded(short[x] & U(0xFFFFFFFF)) for x in parts])

    return run


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each slice. They come by slice."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["slice"] != now and held:
                yield now, held
                held = []
            now = row["slice"]
            held.append(row)
    if held:
        yield now, held


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each slice: which of its short names several shards have, told to each of these shards."""
    for part, held in _held(batches):
        values = [_decoded(x["hashes"]).astype(np.uint32) for x in held]
        flat = np.concatenate(values)
        order = np.argsort(flat, kind="stable")
        same, several = flat[order][1:] == flat[order][:-1], np.zeros(len(flat), bool)
        several[order[1:][same]] = several[order[:-1][same]] = True
        flags = np.split(several, np.cumsum([len(v) for v in values])[:-1])
        yield _table(_HASHES, [part] * len(held), [x["host"] for x in held], [x["shard"] for x in held], [_coded(v[f]) for v, f in zip(values, flags, strict=True)])


def _strings(side: _Side, pages: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By suffix array: a place of each string, and the smallest and largest page that have it."""
    order, rank = suffix_array(side.tokens, side.first, side.length)
    if not len(order):
        return order, order, order
    page = np.array([x["key"] for x in pages], np.int64)[np.repeat(np.arange(len(pages)), np.diff(side.first))[order]]
    head = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
    return order[head], np.minimum.reduceat(page, head), np.maximum.reduceat(page, head)


def _pairs(names: list[bytes]) -> np.ndarray:
    """Both halves of strings' 128 bits, in two columns."""
    return np.frombuffer(b"".join(names), U).reshape(-1, 2)


def _report(length: int, n: int, bits: int):
    """Of a shard: the names of the strings that two of its pages have, which is sure, or that another shard may have."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        host, shard = (x.as_py() for x in key)
        pages = [page for row in left.to_pylist() for page in _unpack(row)]
        known = np.concatenate([np.zeros(0, U), *(U(x["slice"] << 32) | _decoded(x["hashes"]) for x in right.to_pylist())])
        names, sure = [], []
        for name in SIDES:
            side = _Side(host, pages, name, length)
            at, low, high = _strings(side, pages)
            a = side.name(at)
            told = (low < high) | np.isin(_short(a, n, bits), known)
            names.append(np.stack([a[told], side.other(at[told])], 1))
            sure.append((low < high)[told])
        names, sure = np.concatenate(names), np.concatenate(sure)
        order = np.argsort(names[:, 0] % U(n), kind="stable")
        names, sure = names[order], sure[order]
        slices, parts = _by_slice(names[:, 0] % U(n))
        return pa.Table.from_batches([_table(_NAMES, slices, [host] * len(slices), [shard] * len(slices), [names[x].tobytes() for x in parts], [np.packbits(sure[x]).tobytes() for x in parts])])

    return run


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each slice: the names that two pages have, told to each shard that has them. A page is in one shard only."""
    for part, held in _held(batches):
        sizes = [len(x["names"]) // 16 for x in held]
        names = _pairs([x["names"] for x in held])
        sure = np.concatenate([np.unpackbits(np.frombuffer(x["sure"], np.uint8), count=k) for x, k in zip(held, sizes, strict=True)])
        order = np.lexsort((names[:, 1], names[:, 0]))
        head = np.r_[True, (names[order][1:] != names[order][:-1]).any(axis=1)]
        first = np.flatnonzero(head)
        shared = (np.diff(first, append=len(names)) > 1) | (np.maximum.reduceat(sure[order], first) > 0)
        keep = np.zeros(len(names), bool)
        keep[order] = shared[np.cumsum(head) - 1]
        cut = np.cumsum(sizes)[:-1]
        told = [x[k] for x, k in zip(np.split(names, cut), np.split(keep, cut), strict=True)]
        yield _table(_NAMES, [part] * len(held), [x["host"] for x in held], [x["shard"] for x in held], [x.tobytes() for x in told], [None] * len(held))


_TEXTS = "page_id long, url string, text string, n_shared long"


def _alone(length: int):
    """The texts of hosts that are one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for host, _, pages in _shards(batches):
            yield from _texts(host, pages, None, length)

    return run


def _together(length: int):
    """The texts of a shard of several, by the names that it was told."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        pages = [page for row in left.to_pylist() for page in _unpack(row)]
        told = _pairs([x["names"] for x in right.to_pylist()])
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_shared", pa.int64())])
        return pa.Table.from_batches(_texts(key[0].as_py(), pages, told, length), schema)

    return run


def _texts(host: str, pages: list[dict], told: np.ndarray | None, length: int) -> Iterator[pa.RecordBatch]:
    """Of each page: its text without shared runs, those in containers excepted, and the number of its tokens that are shared."""
    shared, texts, gone = np.zeros(len(pages), np.int64), {}, []
    for name in SIDES:
        side = _Side(host, pages, name, length)
        if told is None:  # the whole host
            at, low, high = _strings(side, pages)
            at = at[low < high]
            names = np.stack([side.name(at), side.other(at)], 1)
        else:
            names = told
        known = set(map(tuple, names.tolist()))
        cover = np.zeros(len(side.tokens) + 1, np.int64)
        at = side.places()
        x = side.name(at)
        maybe = np.isin(x, names[:, 0])
        at, x = at[maybe], x[maybe]
        at = at[[k in known for k in zip(x.tolist(), side.other(at).tolist(), strict=True)]] if len(at) else at
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
        cover = np.cumsum(cover)[:-1] > 0
        total = np.r_[0, np.cumsum(cover)]
        shared += total[side.first[1:]] - total[side.first[:-1]]
        texts[name], gone = side.texts, [cover[i:j] for i, j in zip(side.first[:-1], side.first[1:], strict=True)]
    for i in range(0, len(pages), 256):
        some = slice(i, i + 256)
        found = [_checked(*x) for x in zip(texts["inside"][some], texts["outside"][some], (x["marks"] for x in pages[some]), gone[some], strict=True)]
        urls = pa.array([x["url"] for x in pages[some]], pa.binary()).cast(pa.string())
        columns = [pa.array([x["page_id"] for x in pages[some]], pa.int64()), urls, pa.array(found, pa.binary()).cast(pa.string()), pa.array(shared[some])]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_shared"])


def _checked(inside: bytes, outside: bytes, marks: bytes, gone: np.ndarray) -> bytes:
    """The text. Containers keep what their host shares; blocks beside them are no text."""
    if OPEN not in marks:
        return inside.replace(b"\n", b"\n\n")
    sure, left = iter(_lines(inside)), iter(_without(_lines(outside), gone))
    kept = [next(sure) if m == INSIDE else next(left) for m in marks]
    return "\n\n".join(p for p, m in zip(kept, marks, strict=True) if p and m != AROUND).encode()


def _without(parts: list[str], gone: np.ndarray) -> list[str]:
    out, at = [], 0
    for part in parts:
        words = part.split(" ")
        out.append(" ".join(w for k, w in enumerate(words) if not gone[at + k]))
        at += len(words)
    return out


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", length: int = LENGTH, shard_tokens: int = 500_000) -> DataFrame:
    """``page_id, url, text`` of every page, and ``n_shared``, how many of its tokens its host's suffix arrays found on another page."""
    spark = pages.sparkSession
    rows = _keyed(pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").cast("binary").alias("html")))
    sizes = rows.groupBy("host").agg(F.ceil(F.sum(F.octet_length("html")) / (shard_tokens * _TOKEN)).alias("shards"))
    with _set(spark, _CLEANUP, "true"), Scratch(spark) as scratch:
        large = settle(sizes.filter("shards > 1"))  # no more hosts than the pages fill shards
        n = int(large.agg(F.sum("shards")).first()[0] or 0)
        dealt = rows.join(F.broadcast(large), "host", "left").withColumn("shard", F.pmod("key", F.coalesce("shards", F.lit(1))))
        packed = dealt.select("host", "shard", "shards", "key", "page_id", "url", "html").mapInArrow(_parse, _PACKED)
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 8)
        with _set(spark, "spark.sql.adaptive.enabled", "false"):  # a plan that may yet adapt does not say how rows are dealt
            held = settle(packed.repartition(tasks, "host", "shard"))  # stays dealt: what follows reads a shard where it lies
        told = settle(_shared_strings(held.filter("shards IS NOT NULL"), scratch, length, n)) if n else None
    texts = held.filter("shards IS NULL").sortWithinPartitions("host", "shard").mapInArrow(_alone(length), _TEXTS)
    return texts if told is None else texts.unionByName(_met(held.filter("shards IS NOT NULL"), told, _together(length), _TEXTS))


#: Shuffle files of a step go when the step is over, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session, for steps that run now."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _met(several: DataFrame, told: DataFrame, run, schema: str) -> DataFrame:
    """``run`` on each shard's pages and what the shard was told; only the latter moves."""
    return several.groupBy("host", "shard").cogroup(told.groupBy("host", "shard")).applyInArrow(run, schema)


def _shared_strings(several: DataFrame, scratch: Scratch, length: int, shards: int) -> DataFrame:
    """By shard: the names of its strings that two pages of its host have."""
    n, bits = _slices(shards)
    hashes = several.sortWithinPartitions("host", "shard").mapInArrow(_values(length, n, bits), _HASHES)
    told = scratch.keep(hashes.repartition("slice").sortWithinPartitions("slice").mapInArrow(_repeated, _HASHES))
    reports = _met(several, told, _report(length, n, bits), _NAMES)
    return reports.repartition("slice").sortWithinPartitions("slice").mapInArrow(_confirmed, _NAMES).drop("sure")


def _keyed(parsed: DataFrame) -> DataFrame:
    host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return parsed.withColumn("host", F.lower(F.coalesce(host, F.lit("")))).withColumn("key", F.xxhash64("page_id", "url"))


def op8(spark, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")
