"""Each stage against a brute-force version of its decision, and the whole against planted documents."""

import random

import corpus_pipeline
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_jaccard import brute as components
from tests.llm.test_lines import brute as without_lines


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    vocab = [f"{a}{b}{c}" for a in ("ta", "re", "mi", "so") for b in ("lo", "ne", "vu", "ki") for c in ("r", "s", "n", "m")]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, bench = text(60), text(30)
    docs = [(i, "\n".join(text(rng.randint(20, 60)) for _ in range(rng.randint(1, 4))), "en", f"s{i % 3}") for i in range(120)]
    near = docs[3][1].split(" ")
    near[5] = "zzz"
    docs += [(200, docs[3][1], "en", "s0"), (201, " ".join(near), "en", "s1"), (202, f"{text(40)}\n{passage}", "en", "s0"), (203, f"{text(40)}\n{passage}", "en", "s2"), (204, f"{text(10)} {bench} {text(10)}", "en", "s0")]
    docs += [(300 + i, " ".join(f"{w.upper()}!!" for w in text(60).split()), "en", "s0") for i in range(40)] + [(400, None, None, None), (401, "", "en", "s0")]
    df = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d[0], int(d[0] < 300), 0) for d in docs if d[0] % 2], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = df
    for name, stage in corpus_pipeline.STAGES:
        before = sorted((r["doc_id"], r["text"]) for r in now.collect())
        now = stage(spark, now, str(tmp_path))
        assert now.columns == df.columns
        rows = [(r["doc_id"], r["text"]) for r in now.collect()]
        if name == "quality":
            assert {d for d, _ in rows} == {d[0] for d in docs if d[0] < 300}
        elif name == "lines":
            want = without_lines(before)
            assert dict(rows) == {d: t for d, t in want.items() if t.strip()}
            assert all(r["n_chars"] == len(r["text"]) for r in now.collect())
        elif name == "near_duplicates":
            assert {d for d, _ in rows} == {d for d, _, c in components(before) if d == c}
        elif name == "decontamination":
            assert sorted(d for d, _ in rows) == sorted(r[0] for r in contaminated(before, [(1, bench)]) if not r[-1])
        else:
            assert sorted(rows) == before and rows != before
    left = {d for d, _ in rows}
    assert not left & {200, 204} and {202, 203} <= left and set(range(120)) <= left
    assert sum(passage in t for _, t in rows) == 1
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["text"]) for r in whole.collect()) == sorted(rows)
