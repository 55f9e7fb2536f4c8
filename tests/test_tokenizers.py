import random

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import signal
from tessera.operators import tabular, tokenizers
from tessera.sources import readers


def blobs(spark, centres, n=40, tokens=None, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i * n + j, (np.array(c) + rng.standard_normal(len(c)) * 0.1).tolist(), i if tokens is None else tokens[i]) for i, c in enumerate(centres) for j in range(n)]
    return spark.createDataFrame(rows, "id long, v array<double>, token int")


def test_split_merge_add(spark):
    two = blobs(spark, [(0, 0), (10, 10), (5, -5)], tokens=[0, 0, 1])
    halves = tokenizers.split_types(two, below=0.95)
    assert sorted(r["count"] for r in halves.groupBy("token").count().collect()) == [40, 40, 40]
    near = blobs(spark, [(0, 0), (0.05, 0), (9, 9)])
    assert {r["token"] for r in tokenizers.merged_types(near, 1.0).select("token").distinct().collect()} == {0, 2}
    noise = blobs(spark, [(0, 0), (9, 9), (20, -5)], tokens=[0, -1, -1])
    assert tokenizers.added_types(noise).where("token > 0").count() >= 60
    rows, log = tokenizers.refined_types(two, rounds=2)
    assert rows.count() == 120 and log[-1][1] >= 2


def test_co_moments_equal_numpy(spark):
    df = blobs(spark, [(0, 0, 1), (3, 4, 5)])
    x = np.array([r["v"] for r in df.where("token = 1").collect()])
    got = {(r["i"], r["j"]): r["cov"] for r in tabular.co_moments(df, ["token"]).where("token = 1").collect()}
    want = np.cov(x.T)
    assert all(abs(got[i, j] - want[i, j]) < 1e-9 for i in range(3) for j in range(i, 3))


def test_families_fall_back(spark):
    df = blobs(spark, [(0, 0), (9, 9)]).withColumn("g", F.when(F.col("token") == 0, 1).otherwise(2))
    sparse = df.withColumn("token", F.when(F.col("g") == 2, F.lit(-1)).otherwise(F.col("id") % 2).cast("int"))
    fam = tokenizers.moments_family(sparse, "g", "token")
    assert {(r["g"], r["component"]) for r in fam.collect()} == {(1, 0), (1, 1), (2, 0)}
    whole = tokenizers.moments_family(df.withColumn("g", F.lit(0)), "g", "token")
    more = tokenizers.with_fallback(fam, whole, df.withColumn("g", F.col("g") + 1), "g")
    assert {r["g"] for r in more.collect()} == {1, 2, 3}


def test_order_tells_nothing_of_shuffled_sequences(spark):
    rng = random.Random(1)
    rows = [(s, p, rng.choice("ab") if s % 2 else rng.choice("cd"), str(s % 2)) for s in range(120) for p in range(12)]
    seqs = spark.createDataFrame(rows, "seq_id long, pos int, token string, context string")
    got = {r["features"]: r for r in tokenizers.hp1_evaluate(seqs, list("abcd")).collect()}
    assert got["bag"]["accuracy"] == 1.0 and abs(got["both"]["gain"]) <= 0.05
    vectors = tokenizers.sequence_vectors(seqs, list("abcd")).select("id", F.col("context").cast("int").alias("label"), F.col("bag").alias("v"))
    told = {}
    for r in tokenizers.classify_context(vectors, "label", k=2).collect():
        told.setdefault(r["labels"], []).append(r["accuracy"])
    assert min(told["real"]) == 1.0 and max(told["drawn"]) < 0.8


def test_adaptive_loop_keeps_sequences_and_vocabulary_in_step(spark):
    df = blobs(spark, [(0, 0), (5, 5), (9, 0)]).select("id", "v", "token", (F.col("id") % 40).alias("seq_id"), F.floor(F.col("id") / 40).alias("pos"))
    out = tokenizers.adapted(df, outers=2, merges=1)
    assert out.labels.count() == 120 and out.merges and all(line[-1] == 0 for line in out.log)


def test_arrays_and_segments(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6.0).reshape(2, 3))
    np.savez(tmp_path / "b.npz", x=np.ones(2), y=np.array(5))
    (tmp_path / "bad.npy").write_bytes(b"nothing")
    got = {(r["path"].rsplit("/", 1)[-1], r["name"], r["row"]): r["values"] for r in readers.arrays(spark, str(tmp_path)).collect()}
    assert got["a.npy", "", 1] == [3.0, 4.0, 5.0] and got["b.npz", "y", 0] == [5.0] and got["bad.npy", "", 0] is None and len(got) == 6
    t = np.arange(4000) / 8000
    y = np.where((t > 0.1) & (t < 0.2), np.sin(2 * np.pi * 900 * t), 0).tolist()
    df = spark.createDataFrame([(1, "a", y), (2, "b", y), (3, None, y)], "id long, ctx string, y array<double>")
    assert {r["id"] for r in signal.segmented_by(df, "y", 8000, "ctx", {"b": {}}).collect()} == {1, 2, 3}
