import random

from pyspark.sql import functions as F

from voxtally.llm import preference as P


def brute(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    show = lambda t: (f"<|{t[0].replace('<|', '< |')}|>\n", t[1].replace("<|", "< |") + "<|end|>\n")

    def side(turns):
        text, spans = "", []
        for t in turns:
            head, body = show(t)
            if t[0] == "assistant":
                spans.append((len(text) + len(head), len(text) + len(head) + len(body)))
            text += head + body
        return text, spans

    c, r = side(chosen[n:]), side(rejected[n:])
    return n, side(chosen[:n])[0], *c, *r, bool(c[1] and r[1])


def test_same_as_turn_by_turn(spark):
    rng = random.Random(1)
    turn = lambda: (rng.choice(["user", "assistant", "", "a<|b"]), rng.choice(["", "hi", "<|end|>", "日本 x", "a\nb"]))
    rows = []
    for i in range(120):
        base = [turn() for _ in range(rng.randint(0, 5))]
        rows.append((i, base + [turn() for _ in range(rng.randint(0, 2))], base + [turn() for _ in range(rng.randint(0, 2))]))
    kind = f"array<{P.TURN}>"
    df = spark.createDataFrame(rows, f"pair_id long, chosen {kind}, rejected {kind}").withColumn("n", F.lit(1)).withColumn("prompt", F.lit("x"))
    for r in P.format_pairs(df).collect():
        n, prompt, c, cs, j, js, usable = brute(rows[r.pair_id][1], rows[r.pair_id][2])
        assert (r.n_prompt_turns, r.prompt, r.chosen, r.rejected, r.usable) == (n, prompt, c, j, usable)
        assert [tuple(s) for s in r.chosen_spans] == cs and [tuple(s) for s in r.rejected_spans] == js


def test_nulls_and_equal_sides(spark):
    kind = f"array<{P.TURN}>"
    talk = [("user", "q"), ("assistant", "a")]
    rows = [(1, None, talk), (2, talk, talk), (None, talk, None), (2, talk, talk), (3, [(None, None)], [])]
    out = P.format_pairs(spark.createDataFrame(rows, f"pair_id long, chosen {kind}, rejected {kind}")).collect()
    assert len(out) == 5 and not any(r.usable for r in out)
    assert [r.prompt for r in out if r.pair_id == 2] == ["<|user|>\nq<|end|>\n<|assistant|>\na<|end|>\n"] * 2


def test_conversations_and_swapped_replies(spark):
    rows = [(0, 1, "assistant", "a0"), (0, 0, "user", "q0"), (0, 0, "user", "q0"), (1, 0, "user", "q1"),
            (1, 1, "assistant", "a1"), (2, None, "assistant", "last"), (2, 0, "user", None), (2, 0, "user", "x"),
            (None, 0, "user", "none")]
    talks = P.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in talks.collect()}
    assert got == {0: [("user", "q0"), ("assistant", "a0")], 1: [("user", "q1"), ("assistant", "a1")],
                   2: [("user", ""), ("user", "x"), ("assistant", "last")]}
    pairs = {r.pair_id: r for r in P.swapped_replies(talks).collect()}
    assert [r[1] for r in pairs[0].rejected] == ["q0", "a1"] and [r[1] for r in pairs[2].rejected] == ["", "x", ""]
    assert P.format_pairs(P.swapped_replies(talks.limit(0))).collect() == []
