from tessera.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part string, who string"


def views(spark, rows, **how):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    return {(r["conv_id"], r["perspective"], r["part"]): r for r in chat.perspectives(df, **how).collect()}


def test_every_participant_is_assistant_once(spark):
    got = views(spark, [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hé"), (1, 3, "ann", "Bye")])
    assert set(got) == {(1, "ann", 0), (1, "bob", 0)}
    r = got[1, "ann", 0]
    assert r["rendered"] == "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi<|im_end|>\n<|im_start|>user name=bob\nHé<|im_end|>\n<|im_start|>assistant\nBye<|im_end|>\n"
    cut = [r["rendered"][int(a) : int(b)] for a, b in (m.split(":") for m in r["mask"].split(","))]
    assert cut == ["Hi<|im_end|>\n", "Bye<|im_end|>\n"] and (r["n_turns"], r["n_own"], r["n_chars"]) == (4, 2, len(r["rendered"]))


def test_parts_nulls_and_repeats(spark):
    rows = [(2, t, "u" if t % 2 else "v", f"t{t}") for t in range(130)] + [(3, None, None, None), (3, 0, "x", "y"), (3, 0, "x", "y"), (4, 0, "system", "alone"), (None, 5, "z", "q")]
    got = views(spark, rows)
    assert [got[2, "u", p]["n_turns"] for p in range(3)] == [64, 64, 2]
    assert got[2, "u", 2]["mask"].count(":") == 1
    assert got[3, "unknown", 0]["n_turns"] == 3 and got[3, "x", 0]["n_own"] == 2
    assert (None, "z", 0) in got and not any(c == 4 for c, *_ in got)
    long = views(spark, [(1, 0, "a", "x" * 200_000), (1, 1, "b", "")])
    assert long[1, "b", 0]["n_chars"] > 200_000
    assert views(spark, []) == {}
