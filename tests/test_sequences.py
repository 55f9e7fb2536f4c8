import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation, features, language, sequences, vocabulary


def seqs(spark, *lists):
    return spark.createDataFrame([(i, p, t) for i, s in enumerate(lists) for p, t in enumerate(s)], "seq_id long, pos int, token string")


def said(df):
    return {r["seq_id"]: list(r["seq"]) for r in sequences.assembled(df, 1).collect()}


def test_two_types(spark):
    s = seqs(spark, "ABAB")
    r = features.eighteen(s, 2).first()
    assert (r["a_length"], r["b_richness"], r["d_entropy"], r["f_unique_transitions"]) == (4, 2, 1.0, 2)
    assert {(x["t1"], x["t2"]): x["n"] for x in sequences.ngram_counts(s, 2).collect()} == {("A", "B"): 2, ("B", "A"): 1}


def test_one_type_and_short_sequences(spark):
    rows = {r["seq_id"]: r for r in features.eighteen(seqs(spark, "AAAA", "B"), 2).collect()}
    assert rows[0]["d_entropy"] == 0 and rows[0]["k_self_loop"] == 1
    assert rows[1]["a_length"] == 1 and rows[1]["f_unique_transitions"] == 0
    assert sequences.assembled(seqs(spark, "A", "AB"), 2).count() == 1


def test_modes_on_ties(spark):
    s = seqs(spark, "yx")
    assert sequences.mode(s, ["seq_id"], "token", "m").first()["m"] == "x"
    assert sequences.first_mode(s, ["seq_id"], "token", "pos", "m").first()["m"] == "y"


def test_shuffle_keeps_the_multiset(spark):
    s = seqs(spark, "ABCDEFGHABCD", "AAB")
    a, b = said(s), said(sequences.shuffled(s, 1))
    assert a != b and {k: sorted(v) for k, v in a.items()} == {k: sorted(v) for k, v in b.items()}


@pytest.mark.parametrize("text,pair,want", [("AAAAA", "AA", ["A+A", "A+A", "A"]), ("ABAB", "AB", ["A+B", "A+B"]), ("AABAAB", "AB", ["A", "A+B", "A", "A+B"]), ("BAAAB", "AA", ["B", "A+A", "A", "B"])])
def test_rewrite_is_greedy(spark, text, pair, want):
    assert said(vocabulary.rewritten(seqs(spark, text), *pair, "+".join(pair)))[0] == want


def test_merges_expand_to_what_was(spark):
    s = seqs(spark, *["ABABAB"] * 10, "CCAB")
    m = vocabulary.Merger()
    out = m.fit(s, 3)
    assert m.merges[0][:2] == ("A", "B") and said(vocabulary.expanded(out)) == said(s)
    assert said(m.encode(s)) == said(out)
    v = vocabulary.vocabulary(out)
    assert v.where("is_composite and size(children) >= 2").count() >= 1
    assert vocabulary.invalid(out, v).count() == 0
    assert {r["token"] for r in s.select("token").distinct().where(vocabulary.locked(F.col("token"), m.merges)).collect()} >= {"A", "B"}


def test_information_beats_frequency(spark):
    s = seqs(spark, *["01232222"] * 5, *["01232222"] * 5)
    m = vocabulary.MutualMerger(least_count=5)
    m.step(s)
    assert m.merges[0][:2] in {("0", "1"), ("1", "2"), ("1", "3")} and m.merges[0][:2] != ("2", "2")


def test_transition_rows_sum_to_one(spark):
    rows = features.transitions(seqs(spark, "ABCABDAAB")).groupBy("t1").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in rows)


def test_repeats_are_token_exact(spark):
    s = spark.createDataFrame([(i, p, t) for i in range(3) for p, t in enumerate(["1", "11", "12", "1", "11"])], "seq_id long, pos int, token string")
    got = {r["gram"]: r["count"] for r in language.repeats(s, 3, 2).collect()}
    assert got["1 11"] == 6 and "1 1" not in got


def test_agreement(spark):
    rows = spark.createDataFrame([(0, 5), (0, 5), (1, 6), (1, 6), (2, 7), (2, 7)], "a int, b int")
    r = evaluation.agreement(evaluation.contingency(rows, "a", "b")).first()
    assert r["ari"] == r["nmi"] == r["v_measure"] == 1.0
    x = spark.createDataFrame([(i % 2, i // 2 % 2) for i in range(8)], "a int, b int")
    t = evaluation.contingency(x, "a", "b")
    assert abs(evaluation.agreement(t).first()["ari"]) < 0.2 and evaluation.ami(evaluation.contingency(rows, "a", "b")) == pytest.approx(1.0)
    flip = evaluation.contingency(x, "b", "a")
    assert evaluation.agreement(t).first()["ari"] == evaluation.agreement(flip).first()["ari"]


def test_intervals(spark):
    r = evaluation.interval(spark.createDataFrame([(float(i),) for i in range(5)], "x double"), "x").first()
    assert r["mean"] == 2 and r["high"] - r["mean"] == pytest.approx(2.776 * (2.5**0.5) / 5**0.5, abs=1e-6)
