import random
from collections import Counter

import corpus_pipeline
from millrace.llm import decontam, langid, mixing

from .test_decontam import brute as brute_contaminated
from .test_mixing import brute as brute_mix
from .test_neardup import brute as brute_similar
from .test_substrings import brute as brute_repeats


def corpus(rng):
    """Two languages of made-up words, with copies, near copies, shared passages, leaks, junk and a hot source."""
    kinds = {"aa": ["the", "of", "and", "thing", "other", "water", "earth", "stone", "light", "north"], "bb": ["été", "où", "jusqu", "forêt", "rêve", "bientôt", "déjà", "près", "côté", "île"]}
    words = lambda lang, n: [rng.choice(kinds[lang]) + rng.choice(["", "", str(rng.randrange(300))]) for _ in range(n)]
    bench = [(k, " ".join(words("aa", 30))) for k in range(4)]
    passage = words("aa", 70)
    docs = []
    for i in range(120):
        lang = rng.choice(["aa", "bb"])
        body = words(lang, rng.choice([20, 120, 300]))
        if rng.random() < 0.2 and lang == "aa":
            body[10:10] = passage
        if rng.random() < 0.1:
            body[5:5] = rng.choice(bench)[1].split()
        docs.append([i, " ".join(body), lang if rng.random() < 0.9 else None, "hot" if i % 3 else rng.choice(["s1", "s2", None]), 0])
    for i in range(120, 170):
        old = rng.choice(docs[:120])
        body = old[1].split(" ")
        if rng.random() < 0.4:
            body[rng.randrange(len(body))] = "changed"
        docs.append([i, " ".join(body), old[2], "hot", 0])
    docs += [[200, None, "aa", "hot", None], [201, "", None, "s1", 0], [202, "12 34 --", "bb", "s2", 8], [203, "  spaced   text of the water  ", "aa", None, 5]]
    for d in docs:
        d[4] = len(d[1]) if d[1] is not None and d[4] == 0 else d[4]
    rng.shuffle(docs)
    return [tuple(d) for d in docs], bench


def brute(docs, bench):
    docs = [d for d in docs if d[1] and langid._LETTER.search(d[1])]
    root = brute_similar(sorted((d[0], d[1]) for d in docs))
    docs = [d for d in docs if root[d[0]] == d[0]]
    cut = {r[0]: r for r in brute_repeats([(d[0], d[1]) for d in docs])}
    docs = [d if not cut[d[0]][2] else (d[0], cut[d[0]][3], d[2], d[3], len(cut[d[0]][3])) for d in docs]
    docs = [d for d in docs if not brute_contaminated(bench, d[1])]
    mixed = brute_mix([(d[0], d[1], d[3]) for d in docs])
    return Counter({(*d, k): 1 for d, m in zip(docs, mixed, strict=True) for k in range(1, m[5] + 1)})


def test_run_matches_brute_force(spark, tmp_path):
    docs, bench = corpus(random.Random(6))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = brute(docs, bench)
    assert got == want and 30 < len({d[0] for d in want}) < 170


def test_stages(spark, tmp_path):
    docs, bench = corpus(random.Random(7))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, df.limit(0), str(tmp_path))
        assert none.count() == 0
        if name != "mix_sources":
            assert none.columns == df.columns and none.schema.simpleString() == df.schema.simpleString()
    assert decontam.op5 and mixing.op3
