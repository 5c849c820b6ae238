import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import langid

SAMPLES = {"x": [b"abra cadabra abracadabra " * 8], "y": ["été à côté de la forêt ".encode() * 8]}


def brute_bits(samples, lang, text, max_order, max_contexts):
    """Byte by byte with exclusion, from the context trees alone."""
    tree = langid.context_tree(samples[lang], max_order, max_contexts)
    total, past = 0.0, b" "
    for b in text:
        context, refused, p = past[-max_order:] if max_order else b"", set(), None
        while context not in tree:
            context = context[1:]
        escapes = []
        while True:
            seen = tree[context]
            n, d = seen.total(), len(seen)
            escapes.append((seen, n, d))
            if not context:
                break
            context = context[1:]
        base = np.full(256, 1 / 256)
        for seen, n, d in reversed(escapes):
            if not n:
                continue
            own = np.array([seen.get(k, 0) / (n + d) for k in range(256)])
            free = np.array([k not in seen for k in range(256)])
            own[free] = d / (n + d) * base[free] / base[free].sum()
            base = own
        total += -math.log2(base[b])
        past += bytes([b])
    return total


@pytest.mark.parametrize("max_order", [0, 1, 3])
def test_automaton_gives_exact_code_lengths(max_order):
    model = langid.train(SAMPLES, max_order, 200)
    rng = random.Random(1)
    texts = [b"abra", b"z", "forêt été".encode(), bytes(rng.choice(b"abrcd zq\xc3\xa9") for _ in range(1500))]
    got = langid.totals(model, texts, piece=64)
    for t, row in zip(texts, got):
        for k, lang in enumerate(model.languages):
            assert row[k] == pytest.approx(brute_bits(SAMPLES, lang, t, max_order, 200), rel=1e-5)


def test_pieces_do_not_change_sums():
    model = langid.train(SAMPLES, 4, 500)
    texts = [b"abra cadabra forest " * 90, b"", b"x"]
    assert np.allclose(langid.totals(model, texts, 16), langid.totals(model, texts, 4096), rtol=1e-6)


def test_edge_cases(spark):
    docs = [(1, "abra cadabra abra cadabra", "x", 1), (2, "été à côté de la forêt", "y", 2), (3, None, "x", 3), (4, "", None, 4), (5, "12 - 34 !!", "y", 5), (None, "abra cadabra", None, 6), (7, "ABRA cadabra " * 5000, None, 7), (7, "ABRA cadabra " * 5000, None, 8)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, score long")
    got = {r["row"].c3: (r.lang_pred, r.score) for r in langid.identify(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "x", 2: "y", 3: "und", 4: "und", 5: "und", 6: "x", 7: "x", 8: "x"}
    assert all(0 <= s <= 1 for _, s in got.values())
    none = langid.identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    found = langid.op4(spark, "/root/testdata/sf0.01").filter("held_out").select("doc_id", "lang_pred")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    row = found.join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert row[1] > 150 and row[0] >= 0.97


def test_copies_count_once_in_the_sample(spark):
    docs = [(f"text {'abcdefghij'[i]}", "x") for i in range(10) for _ in range(200)]
    df = spark.createDataFrame(docs, "text string, lang string")
    got = [r.text for r in langid.sample(df, "text", "lang", sample_docs=8).collect()]
    assert len(got) == len(set(got)) == 8


@pytest.mark.parametrize("max_order,max_contexts", [(0, 10), (3, 40), (4, 4000)])
def test_counts_are_those_of_the_definition(spark, max_order, max_contexts):
    docs = [("Abra cadabra 12", "x"), ("abra", "x"), ("été à\tcôté", "y"), ("12 - !", "y"), ("a", "y"), ("long " * 3000, "x")]
    got = langid.learn(spark.createDataFrame(docs, "text string, lang string").repartition(3), max_order, max_contexts)
    for lang in "xy":
        assert got[lang] == langid.context_tree([langid.tidy(t) for t, k in docs if k == lang and langid._LETTER.search(t)], max_order, max_contexts)


def test_the_stage_rejects_by_language_score_and_code_length(spark):
    rng = random.Random(9)
    words = {"x": ["abra", "cadabra", "simsala", "bim"], "y": ["été", "côté", "forêt", "où"]}
    docs = [(k, " ".join(rng.choice(words["xy"[k % 2]]) for _ in range(30)), "xy"[k % 2]) for k in range(40)]
    docs += [(50, "это написано на другом языке", None), (51, "12 !", "x"), (52, None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    kept = lambda **how: sorted(r.doc_id for r in langid.in_known_language(df, **how).collect())
    assert kept() == list(range(40))
    assert kept(languages=["y"]) == list(range(1, 40, 2))
    assert kept(max_bits=99.0) == [*range(40), 50]
    assert kept(min_score=1.1) == []


def test_every_language_is_learned(spark):
    rng = random.Random(4)
    docs = []
    for k in range(70):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 6))) for _ in range(6)]
        docs += [(" ".join(rng.choice(words) for _ in range(60)), f"l{k:02}") for _ in range(3 if k else 2)]
    df = spark.createDataFrame(docs, "text string, lang string")
    got = langid.identify(df, max_contexts=300).select("row.c1", "lang_pred").collect()
    assert len(got) == len(docs) and all(r[0] == r[1] for r in got)
