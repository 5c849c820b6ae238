import random

import numpy as np
import pytest

from millrace.llm import webtext

PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T &amp; x</title><style>p{margin:0}</style>
<script>var t="</p><article>no";track(1);</script></head><body><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad <p>1</p> -->
<div class="ad">Buy</div><article><header><h1>Head &lt;line&gt;</h1></header><p><b>One&nbsp;  two<br>three<p>four <i>fi</i>ve
six</p><aside>side</aside><section id="comments"><p>I like it</p></section><form><p>mail</p></form><div hidden>gone</div><p></p>
<p>caf&eacute; &#x2014; a &lt; b < c</p></article><footer>&copy; x</footer>"""


def test_structure():
    assert webtext.blocks(PAGE) == [(True, "Head <line>"), (True, "One two three"), (True, "four five six"), (True, "café — a < b < c")]
    # text of main around an article is left to the host's other pages
    assert webtext.blocks("<p>x</p><main><p>a</p><article><p>b</p></article></main>") == [(False, "a"), (True, "b")]
    assert webtext.blocks("<p>x</p><main><p>a</p></main>") == [(True, "a")]
    assert webtext.blocks("<article></article><p>x</p>y") == [(False, "x"), (False, "y")]
    assert webtext.blocks("<nav>never closed") == []
    assert webtext.blocks("plain & text") == [(False, "plain & text")]
    assert webtext.blocks('<div title="a > b" class="main-text">x</div>') == [(False, "x")]
    assert webtext.blocks("") == webtext.blocks("<") [:0] == []


def test_a_container_keeps_what_its_classes_seem_to_drop():
    page = '<article><div class="post-header"><h1>Head</h1></div><p class="notice-period">Three weeks</p><p>E = <math><mi>m</mi></math> <label>c</label></p><div class="comments">me too</div><p id="ad-1">buy</p></article>'
    assert webtext.blocks(page) == [(True, "Head"), (True, "Three weeks"), (True, "E = m c")]
    assert webtext.blocks('<div class="page header">Head</div><p>x</p>') == [(False, "x")]


@pytest.mark.parametrize("piece", ["<a ", "<a href='x ", '<a href="x> ', "<a '>' ", "<script ", "<script>", "</script", "<!-- ", "<![CDATA[", "<p a=" + "b", "& ", "<textarea></textareaX ", "a='", "<", "<p hidden "])
def test_malformed_pages_take_linear_time(piece):
    import time

    page = "<p>before</p>" + piece * (1_000_000 // len(piece)) + "</p>"
    began = time.time()
    out = webtext.blocks(page)
    assert time.time() - began < 4 and out[0] == (False, "before")
    assert webtext.blocks("<p " + "a" * 1_000_000 + ">x") == [(False, "x")] and time.time() - began < 8


def test_text_around_an_article_is_judged_by_the_host(spark):
    shell = "one two three four five six seven eight nine"
    rows = [(k, f"http://h.example/{k}", f"<main><p>{shell}</p><article><p>{shell}</p></article><p>{k} only here</p></main>") for k in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in webtext.extract(df).collect()} == {k: f"{shell}\n\n{k} only here" for k in range(3)}


@pytest.mark.parametrize("shard_tokens", [500_000, 12])
def test_every_page_meets_its_host(spark, shard_tokens):
    shell, story = "one two three four five six seven eight nine", "a story of eleven words that two pages of it have"
    pages = [
        (1, f"<div>{shell}</div><article><p>{story}</p><p>own</p></article>"),
        (2, f"<p>{story}</p><main><p>{story}</p></main><div>{shell}</div>"),
        (3, f"<div>{shell}</div><p>no container but text</p>"),
        (4, f"<p>{story[2:]} too</p>"),  # shares its text with what stands beside the container of page 2
        (5, "<article>of its own</article>"),
    ]
    df = spark.createDataFrame([(k, f"http://h.example/{k}", p) for k, p in pages] + [(6, "http://other.example/", f"<div>{shell}</div>")], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_shared) for r in webtext.extract(df, shard_tokens=shard_tokens).collect()}
    assert got == {1: (f"{story}\n\nown", 20), 2: (story, 30), 3: ("no container but text", 9), 4: ("too", 10), 5: ("of its own", 0), 6: (shell, 0)}


@pytest.mark.parametrize(("shard_tokens", "moved"), [(500_000, 0), (2_000, 1)])
def test_texts_move_to_their_shard_once(spark, shard_tokens, moved):
    import re
    from pathlib import Path

    def kept():
        return sum(p.stat().st_size for p in Path(spark.conf.get("spark.checkpoint.dir")).rglob("part-*"))

    before, table = kept(), "/root/testdata/sf0.01/pages.parquet"
    found = webtext.extract(spark.read.parquet(table), shard_tokens=shard_tokens)
    texts = Path(table).stat().st_size
    assert (kept() - before) / texts < 0.6
    # the result reads the kept texts where they lie, and moves the names of shared strings at most
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange ", plan)) == moved
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_packed_pages_come_back():
    pages = [(1, -5, (b"http://a/", b"\0\1", "caf\u00e9\nx".encode(), b"y")), (None, 7, (None, b"", b"", b"")), (3, 7, (b"", b"\2", b"", b"z" * 300_000))]
    for some in (pages, pages[1:2]):
        row = webtext._pack({("h", 2, 9): some}).to_pylist()[0]
        assert [row[x] for x in ("host", "shard", "shards")] == ["h", 2, 9]
        assert [(x["page_id"], x["key"], (x["url"], x["marks"], x["inside"], x["outside"])) for x in webtext._unpack(row)] == some


def test_codes_of_short_names():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (1, 2**32), (5, 6), (1000, 1000), (3000, 2**20), (3000, 2**32)):
        values = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        assert webtext._decoded(webtext._coded(values)).tolist() == values.tolist()
    edges = np.array([0, 2**32 - 1], np.uint64)
    assert webtext._decoded(webtext._coded(edges)).tolist() == edges.tolist()
    for shards in (2, 15, 45, 1000, 10**6):
        n, bits = webtext._slices(shards)
        assert 0 < n <= shards and 26 <= bits <= 32
    assert len(webtext._coded(np.unique(rng.integers(0, 2**28, 30_000, dtype=np.uint64)))) < 30_000 * 15.2 / 8


def test_suffix_array_groups_equal_strings():
    rng = random.Random(3)
    for length in (1, 2, 3, 5, 8):
        pages = [[rng.randrange(3) for _ in range(rng.randint(0, 30))] for _ in range(6)]
        tokens = np.array([t for p in pages for t in p], np.uint64)
        first = np.cumsum([0, *map(len, pages)])
        order, rank = webtext.suffix_array(tokens, first, length)
        strings = [tuple(tokens[i : i + length].tolist()) for i in order]
        assert strings == sorted(strings)
        assert [a == b for a, b in zip(strings, strings[1:])] == [bool(a == b) for a, b in zip(rank, rank[1:])]
        assert len(order) == sum(max(0, len(p) - length + 1) for p in pages)


def brute(pages, length):
    """Text of open pages: tokens covered by a string that another page of the host has are dropped."""
    seen = {}
    for key, host, parts in pages:
        words = " ".join(parts).split(" ")
        for i in range(len(words) - length + 1):
            seen.setdefault((host, tuple(words[i : i + length])), set()).add(key)
    out = {}
    for key, host, parts in pages:
        words = " ".join(parts).split(" ")
        gone = set()
        for i in range(len(words) - length + 1):
            if len(seen[host, tuple(words[i : i + length])]) > 1:
                gone.update(range(i, i + length))
        text, at = [], 0
        for p in parts:
            own = p.split(" ")
            text.append(" ".join(w for k, w in enumerate(own) if at + k not in gone))
            at += len(own)
        out[key] = "\n\n".join(t for t in text if t)
    return out


@pytest.mark.parametrize("shard_tokens", [500_000, 60])
def test_open_pages_match_brute_force(spark, shard_tokens):
    rng = random.Random(8)
    shell = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 20))) for _ in range(4)]
    pages = []
    for i in range(40):
        parts = [rng.choice(shell) if rng.random() < 0.4 else " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 6))]
        pages.append((i, rng.choice(["a.example", "b.example"]), parts))
    rows = [(i, f"http://u@{h.upper()}:80/{i}?x", "".join(f"<p>{p}</p>" for p in parts), "k") for i, h, parts in pages]
    rows += [rows[3], (90, None, None, "k"), (91, "", "", "k"), (92, "http://a.example/", PAGE, "k"), (None, "http://a.example/n", "<article>z</article>", "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in webtext.extract(df, shard_tokens=shard_tokens).collect()]
    want = brute(pages, webtext.LENGTH)
    assert len(got) == len(rows)
    assert dict(got) == want | {90: "", 91: "", 92: "Head <line>\n\nOne two three\n\nfour five six\n\ncafé — a < b < c", None: "z"}
    assert webtext.extract(df.limit(0)).count() == 0


def test_pages_keep_their_article(spark):
    rows = webtext.op8(spark, "/root/testdata/sf0.001").collect()
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert len(rows) == len(pages)
    import html as h
    import re

    for r in rows:
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S).group(1)
        cut = [" ".join(h.unescape(re.sub(r"<(?:br|/?b)>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(x for x in cut if x) and r.n_chars == len(r.text)
