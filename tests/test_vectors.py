import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.columns import centre_fit, pad_mean
from tessera.operators import models, vectors


def blobs(centres, n=30, sd=0.3, seed=0):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(c, sd, (n, len(c))) for c in centres])
    return x, np.repeat(np.arange(len(centres)), n)


def frame(spark, x, y):
    return spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, v array<double>, label int")


def test_silhouettes_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    x, y = blobs([(0, 0), (5, 5), (9, 0)], 14)
    x, y = np.vstack([x, [[50, 50]]]), np.r_[y, 3]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for r in vectors.silhouettes(frame(spark, x, y)).collect():
        i, own = r["id"], y == y[r["id"]]
        if own.sum() == 1:
            assert r["s"] == 0
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][y == k].mean() for k in set(y) - {y[i]})
        assert r["s"] == pytest.approx((b - a) / max(a, b))
    assert vectors.silhouettes(frame(spark, x, np.full(len(x), -1))).count() == 0


def test_neighbours_and_noise(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    x, y = blobs([(0, 0), (10, 0)], 20)
    y[3] = -1
    got = {r["id"]: r["label"] for r in models.reassigned_noise(frame(spark, x, y), 5, "label").collect()}
    assert got[3] == 0 and len(got) == 40


def test_refine_merges_and_prunes(spark):
    x, y = blobs([(0, 0), (0.5, 0), (10, 0)], 50)
    log = [k for _, k, *_ in models.refine(frame(spark, x, y), rounds=2).log]
    assert "merge" in log
    x, y = blobs([(0, 0), (10, 0)], 100)
    x, y = np.vstack([x, np.random.default_rng(1).normal((5, 8), 0.3, (5, 2))]), np.r_[y, [2] * 5]
    r = models.refine(frame(spark, x, y), rounds=1)
    assert "prune" in [k for _, k, *_ in r.log] and r.labels.select("token").distinct().count() == 2


def test_density_clusters_find_blobs():
    x, y = blobs([(0, 0), (10, 0), (5, 8), (15, 8)], 60, 0.4)
    label = models.density_labels(x, 10, 5)
    assert len(set(label) - {-1}) == 4 and (label >= 0).mean() > 0.8
    for k in set(label) - {-1}:
        assert len(set(y[label == k])) == 1


@pytest.mark.parametrize("kind", ["em", "dp"])
def test_mixtures(kind):
    x, _ = blobs([(0, 0), (8, 8)], 200, 0.5)
    w, m, _ = models.fit_mixture(x, 6 if kind == "dp" else 2, kind)
    big = np.sort(w)[::-1]
    assert big[:2].sum() > 0.7 if kind == "dp" else np.allclose(big, 0.5, atol=0.02)


def test_linkage_and_warping():
    x, y = blobs([(0, 0), (10, 0), (0, 10)], 10)
    for method in ("ward", "single", "complete", "average"):
        label = models.linkage_cut(x, 3, method=method)
        assert all(len(set(label[y == k])) == 1 for k in range(3)) and len(set(label)) == 3
    a = np.array([0.0, 1, 2, 3])
    assert models.dtw(a, a) == 0 and models.dtw(a, np.array([0.0, 0, 1, 2, 3])) == 0 and models.dtw(a, a + 1) > 0


def test_hidden_markov_tells_orders_apart():
    rng = np.random.default_rng(0)
    one = [np.tile([0, 1], 20) for _ in range(5)]
    two = [rng.integers(0, 2, 40) for _ in range(5)]
    a, b = models.fit_hmm(one, 2, 2, 40), models.fit_hmm(two, 2, 2, 40)
    assert models.hmm_log(one[0], a) > models.hmm_log(one[0], b) and models.hmm_log(two[0], b) > models.hmm_log(two[0], a)


def test_family_and_classifiers(spark):
    x, y = blobs([(0, 0), (6, 0)], 60, 0.5)
    rows = frame(spark, x, y).withColumn("seq_id", (F.col("id") / 20).cast("long"))
    pred = {r["seq_id"]: r["pred"] for r in models.family_predict(rows, models.mixture_family(rows, "label", 3), "label").collect()}
    assert pred == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}
    got = models.classify(frame(spark, x, y), "lr").collect()
    assert np.mean([r["label"] == r["pred"] for r in got]) > 0.9


def test_pca_keeps_distances(spark):
    x, y = blobs([(0, 0, 0), (4, 1, 0)], 20)
    p = np.stack([r["v"] for r in models.pca(frame(spark, x, y), 3).orderBy("id").collect()])
    assert np.allclose(((p[0] - p[1]) ** 2).sum(), ((x[0] - x[1]) ** 2).sum())


def test_padding(spark):
    df = spark.createDataFrame([([1.0, 3.0],), ([1.0, 2.0, 3.0, 4.0, 5.0, 6.0],), ([],)], "a array<double>")
    got = [r[0] for r in df.select(pad_mean(F.col("a"), 4)).collect()]
    assert got == [[1, 3, 2, 2], [1, 2, 3, 4], [0, 0, 0, 0]]
    got = [r[0] for r in df.select(centre_fit(F.col("a"), 4)).collect()]
    assert got == [[2, 1, 3, 2], [2, 3, 4, 5], [0, 0, 0, 0]]


def test_refine_labels_all_rows(spark):
    x, y = blobs([(0, 0), (10, 0), (0, 10)], 700)
    got = models.refine(frame(spark, x, y), rounds=1).labels
    assert got.count() == len(x) == 2100 and got.where("token IS NULL OR token < 0").count() == 0
    # a cluster that is two: all its rows are dealt to the halves
    x, y = blobs([(0, 0), (6, 0), (3, 0.2)], 800)
    r = models.refine(frame(spark, x, np.where(y == 1, 0, y)), rounds=1, split_below=0.9)
    assert "split" in [k for _, k, *_ in r.log] and r.labels.count() == 2400


def test_dtw_ward_labels_400_of_a_group_in_order(spark):
    x, y = blobs([(0, 0, 0, 0), (9, 9, 9, 9)], 210)
    got = models.dtw_ward(frame(spark, x, np.zeros(len(y), int)), "label", 0.05).orderBy("id").collect()
    assert len(got) == 420 and [r["proxy"] >= 0 for r in got] == [True] * 400 + [False] * 20


def test_distances_keep_digits():
    """Far from the origin, near each other, equal: as by differences."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((40, 16)), 1e7 + rng.standard_normal((20, 16)), 3 + 1e-7 * rng.standard_normal((20, 16))])
    y = np.concatenate([x[::3], rng.standard_normal((30, 16))])
    want = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
    assert np.allclose(vectors._distances(x, y), want, rtol=1e-12, atol=0)


def test_silhouettes_of_several_labels_take_distances_once(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 5))
    rows = [(i, x[i].tolist(), i % 3, i % 4 - 1 if i else None) for i in range(60)]
    got = {(r["nth"], r["id"]): (r["l"], r["s"]) for r in vectors.silhouettes_by(spark.createDataFrame(rows, "id long, v array<double>, one int, two int"), ("one", "two")).collect()}
    want = {}
    for nth in (0, 1):
        own = [(i, r[2 + nth]) for i, r in enumerate(rows) if r[2 + nth] is not None and r[2 + nth] >= 0]
        for i, l in own:
            d = {}
            for j, k in own:
                if i != j:
                    d.setdefault(k, []).append(np.linalg.norm(x[i] - x[j]))
            a, b = np.mean(d[l]), min(np.mean(d[k]) for k in d if k != l)
            want[nth, i] = l, (b - a) / max(a, b)
    assert got.keys() == want.keys() and all(got[q][0] == want[q][0] and abs(got[q][1] - want[q][1]) < 1e-12 for q in want)
