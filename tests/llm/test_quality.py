import numpy as np
from pyspark.sql import functions as F

from millrace.llm import quality as q


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    n, right = 40_000, np.array([[0.9, 0.7, 0.85, 0.6], [0.8, 0.95, 0.75, 0.6]])
    truth = (rng.random(n) < 0.65).astype(int)
    correct = rng.random((n, 4)) < right[truth]
    vote = np.where(correct, truth[:, None], 1 - truth[:, None]) + 1
    vote[rng.random((n, 4)) < 0.2] = q.ABSTAIN
    model = q.fit_labels(vote, np.ones(n))
    assert abs(model.good - 0.65) < 0.03
    assert np.abs(model.right - right).max() < 0.06
    patterns, counts = np.unique(vote, axis=0, return_counts=True)
    again = q.fit_labels(patterns, counts.astype(float))
    assert abs(again.good - model.good) < 1e-6 and np.abs(again.right - model.right).max() < 1e-6


def _batch(texts):
    blob = [t.encode() for t in texts]
    return q.measure(np.frombuffer(b"".join(blob), np.uint8), np.cumsum([0, *map(len, blob)]))


def test_measures():
    b = _batch(["ab ab CD .. 12", "", "é x!! x!!"])
    assert b.n.tolist() == [5, 0, 3]
    assert np.allclose(b.measures["distinct"], [4 / 5, 0, 2 / 3])
    assert np.allclose(b.measures["stutter"], [1 / 5, 0, 1 / 3])
    assert np.allclose(b.measures["letterless"], [2 / 5, 0, 0])
    assert np.allclose(b.measures["odd_ends"], [0, 0, 2 / 3])
    assert np.allclose(b.measures["capitals"], [2 / 6, 0, 0])
    one, two = _batch(["abc Abc1 x!!"]), _batch(["zz zz", "qq Qqqqq22 y!"])
    assert one.shape.tolist() == two.shape[2:].tolist()


def test_rows_do_not_influence_each_other():
    texts = ["a b c. D", "D e! e!", "", "x"]
    whole = _batch(texts)
    parts = [_batch([t]) for t in texts]
    for name in q.LIMITS:
        assert np.allclose(whole.measures[name], np.concatenate([p.measures[name] for p in parts]))
    w = np.random.default_rng(1).normal(size=1 << q.BITS)
    assert np.allclose(q.score(w, 0.1, whole), np.concatenate([q.score(w, 0.1, p) for p in parts]))


def test_accuracy_on_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    found = q.op9(spark, sf).withColumnRenamed("quality", "q")
    row = found.join(labels, "doc_id").agg(F.avg((F.col("keep") == (F.col("quality") == 1)).cast("int")), F.avg(F.when(F.col("quality") == 1, F.col("keep").cast("int"))), F.count("*")).first()
    assert row[2] > 3000 and row[0] >= 0.9 and row[1] >= 0.95


def test_edge_cases(spark):
    docs = [(1, None, 1), (2, "", 2), (3, " ", 3), (4, "some plain words. " * 30, 4), (4, "some plain words. " * 30, 5), (None, "### $$$ %%% " * 30, 6), (5, "word " * 40_000, 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, quality long")
    rows = q.classify(df).collect()
    assert len(rows) == 7
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.quality, r.weak_label, r.keep))
    assert all(by[i] == {(0.0, 0.0, False)} for i in (1, 2, 3)) and len(by[4]) == 1
    assert all(0 <= r.quality <= 1 for r in rows)
    assert q.classify(df.limit(0)).count() == 0
    assert {r.keep for r in q.classify(df.limit(3)).collect()} == {False}


def test_shapes_tell_late_changes_apart():
    a, b = _batch(["a1b2c3d4e5f6 "]), _batch(["a1b2c3d4e5.6 "])
    assert a.shape[0] != b.shape[0]


def test_the_sample_is_bounded_and_counts_copies_once(spark):
    docs = [("same text here",)] * 500 + [(f"text {i}",) for i in range(40)] + [(None,)]
    rows = spark.createDataFrame(docs, "text string").select(F.col("text").cast("binary"))
    got = [bytes(r.text) for r in q.sample(rows, 10).collect()]
    assert len(got) == len(set(got)) == 10
    assert q.sample(rows, 1000).count() == 41


def test_scores_match_a_plain_fit(spark):
    """Labels, fit and scores again, a text at a time and with dense features."""
    rng = np.random.default_rng(4)
    good = ["the stone was on a quiet hill,", "and then they went home.", "water runs slowly by the old mill"]
    bad = ["### !!! $$", "BUY BUY BUY", "x1 x1 x1 x1", "7 7 8 %%"]
    texts = [" ".join(rng.choice(good if k % 3 else bad) for _ in range(rng.integers(1, 12))) for k in range(90)] + ["", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.quality, r.weak_label, r.keep) for r in q.classify(df, rounds=15).collect()}
    one = [_batch([t or ""]) for t in texts]
    votes = np.concatenate([q.votes(b) for b in one])
    soft = q.fit_labels(votes, np.ones(len(votes))).posterior(votes)
    x = np.zeros((len(texts), 1 << q.BITS), np.float32)
    for k, b in enumerate(one):
        for f in q.features(b):
            for i in f:
                x[k, i] += 1 / b.n[0]
    fit = sorted({t: k for k, t in enumerate(texts) if t}.values())
    weights, bias, seen = np.zeros(1 << q.BITS), 0.0, np.full((1 << q.BITS) + 1, 1e-12)
    for _ in range(15):
        p = 1 / (1 + np.exp(-(x[fit] @ weights + bias)))
        gradient = np.r_[x[fit].T @ (p - soft[fit]), (p - soft[fit]).sum()]
        g = gradient / len(fit)
        g[:-1] += 1e-5 * weights
        seen += g * g
        weights, bias = weights - 0.5 * g[:-1] / np.sqrt(seen[:-1]), bias - 0.5 * g[-1] / np.sqrt(seen[-1])
    want = 1 / (1 + np.exp(-(x @ weights + bias)))
    for k, t in enumerate(texts):
        if not t:
            assert got[k] == (0.0, 0.0, False)
        else:
            assert abs(got[k][0] - want[k]) < 1e-3 and abs(got[k][1] - soft[k]) < 1e-9
    assert 20 < sum(v[2] for v in got.values()) < 80
