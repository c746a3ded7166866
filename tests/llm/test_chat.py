import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from sparkwarden.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string"


def made(n, seed, marked=0.0):
    rng = random.Random(seed)
    say = lambda k: " ".join("".join(rng.choices("aeinorst", k=5)) for _ in range(k))
    head = {"user": "User: ", "assistant": "### Assistant: ", "system": "System: "}
    rows = []
    for c in range(n):
        roles = (["system"] if rng.random() < 0.3 else []) + ["user", "assistant"] * rng.randint(1, 4)
        for t, r in enumerate(roles):
            text = say(6) + "?" if r == "user" else "\n".join(say(9).capitalize() + "." for _ in range(3)) if r == "assistant" else "You are " + say(3) + "."
            rows.append((c, t, r, head[r] + text if rng.random() < marked else text))
    return rows


def test_roles_of_held_out_conversations(spark):
    m = C.learn(spark.createDataFrame(made(300, 1), SCHEMA), C.Fit())
    for marked, least in ((0.0, 0.93), (0.7, 0.97)):
        rows = made(120, 2, marked)
        got = {(r.conv_id, r.turn): r for r in C.format_turns(spark.createDataFrame(rows, SCHEMA).withColumn("role", F.lit(None).cast("string")), m).where("segment = 0").collect()}
        assert len(got) == len(rows) and sum(got[c, t].role == r for c, t, r, _ in rows) / len(rows) >= least
        assert all("User:" not in r.rendered and "Assistant:" not in r.rendered for r in got.values() if r.begins)


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(0)
    move = rng.normal(size=(7, 6))
    for n in (1, 2, 4):
        e = rng.normal(size=(n, 6))
        every = {p: move[6, p[0]] + e[0, p[0]] + sum(move[a, b] + x[b] for a, b, x in zip(p, p[1:], e[1:])) for p in itertools.product(range(6), repeat=n)}
        best = max(every, key=every.get)
        assert tuple(C.path(e, move, 6, best[-1])) == best
        assert np.isclose(C.transfer(e, move)[6].max(), every[best])


def test_blocks_do_not_change_the_path(spark):
    rows = [(1, t, None, x) for t, (_, _, _, x) in enumerate(made(30, 5, 0.2))]
    df = spark.createDataFrame(rows, SCHEMA)
    m = C.learn(spark.createDataFrame(made(100, 1), SCHEMA), C.Fit())
    key = lambda r: (r.turn, r.segment)
    assert sorted(C.format_turns(df, m, C.Fit(block=7)).collect(), key=key) == sorted(C.format_turns(df, m).collect(), key=key)


def test_one_text_with_several_turns(spark):
    m = C.learn(spark.createDataFrame([], SCHEMA), C.Fit())
    text = "System: be kind\nUser: hi\nthere\n**Assistant:** hello\n<|im_start|>user\nbye"
    got = sorted(C.format_turns(spark.createDataFrame([(1, 0, None, text)], SCHEMA), m).collect(), key=lambda r: r.segment)
    assert [r.rendered for r in got] == ["<|system|>\nbe kind", "<|user|>\nhi\nthere", "<|assistant|>\nhello", "<|user|>\n\nbye"]


def test_edge_cases(spark):
    m = C.learn(spark.createDataFrame([], SCHEMA), C.Fit())
    rows = [(1, 0, "user", None), (1, 0, "user", None), (None, None, None, "x"), (2, 5, "user", ""), (3, 0, "odd", "y\n" * 20_000)]
    got = C.format_turns(spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit("clash")), m).collect()
    assert sorted(str(r.conv_id) for r in got if r.segment == 0) == ["1", "1", "2", "3", "None"] and sum(r.n_lines for r in got if r.conv_id == 3) == 20_001
    assert C.format_turns(spark.createDataFrame([], SCHEMA), m).collect() == []


def test_equal_rows_and_rows_without_conversation_or_turn_are_all_kept(spark):
    m = C.learn(spark.createDataFrame([], SCHEMA), C.Fit())
    rows = [(1, None, None, "ok")] * 40 + [(None, None, None, "ok")] * 300 + [(None, None, None, f"User: line {i % 9}\nmore") for i in range(200)] + [(None, 3, None, None)] * 20
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    whole = C.format_turns(df, m).collect()
    cut = C.format_turns(df, m, C.Fit(block=16, chars=200)).collect()
    assert sum(r.n_lines for r in whole) == 40 + 300 + 400 + 20
    key = lambda r: (str(r.conv_id), str(r.turn), r.segment, r.n_lines, r.rendered.split("\n", 1)[-1])  # noqa: E731  roles of equal lines are a tie
    assert sorted(map(key, whole)) == sorted(map(key, cut))
    assert len(C.in_blocks(df, C.Fit(block=16, chars=200)).select("conv_id", "block").distinct().collect()) > 30
