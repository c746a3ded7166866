import random
import re
from collections import Counter

from pyspark.sql import functions as F

from sparkwarden.llm import quality as Q

SCHEMA = "doc_id long, text string, lang string"


def brute_repeats(words, k=5):
    seen = {}
    for i in range(len(words) - k + 1):
        seen.setdefault(tuple(words[i : i + k]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + k)})


def test_repeated_words_against_brute_force():
    rng = random.Random(3)
    for size in (1, 3, 40, 9000):
        for n in (0, 4, 5, 6, 30, 300, 9500):
            words = [str(rng.randrange(size)) for _ in range(n)] * (2 if size > 100 else 1)
            assert Q.repeated_words(words) == brute_repeats(words)


def test_base_counts():
    text = "a #b\n\n \t\n a #b\na #b\x1fc d"
    n, chars, symbols, dup, rep = Q.base_counts(text)
    words = re.findall("[^\x20\x09-\x0d]+", text)
    assert [w.decode() for w in Q.words_of(text)] == words and n == 6 and chars == sum(map(len, words))
    assert (symbols, dup, rep) == (3, 0, 0)
    assert Q.base_counts("x\nx\n y\n\n\n")[3] == 1
    assert Q.base_counts(None) == (0, 0, 0, 0, 0)


def test_divergence_rejects_odd_documents_and_keeps_clean_ones(spark):
    rng = random.Random(5)
    common = "the of and to in is was that for with on by".split()
    prose = lambda: " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choices("abcdefghij", k=6)) for _ in range(120)) + "."
    rows = [(i, prose(), "en") for i in range(200)]
    rows += [(900, " ".join(f"{w}###" for w in prose().split()), "en"), (901, prose().upper().replace(" ", "!! "), "en"), (902, None, "en"), (903, prose(), None), (904, "", "en"), (905, "x " * 40000, "zz"), (0, rows[0][1], "en")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit(1))
    got = {}
    for r in Q.judge(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert all(r.kept for i in range(200) for r in got[i]) and len(got[0]) == 2
    assert not any(got[i][0].kept for i in (900, 901, 902, 904, 905))
    assert not got[900][0].base_failed and got[902][0].base_failed and got[905][0].n_repeat_words == 40000
    assert got[903][0].kept


def test_empty_table(spark):
    assert Q.judge(spark.createDataFrame([], SCHEMA)).collect() == []
    assert Q.stage(spark, spark.createDataFrame([], SCHEMA), "").columns == ["doc_id", "text", "lang"]


def test_distance_bounds():
    import numpy as np

    assert Q.js_distance(np.array([1.0, 0]), np.array([0, 3.0])) == 1.0
    assert Q.js_distance(np.array([1.0, 2]), np.array([2, 4.0])) == 0.0


def test_references_are_exact_however_the_rows_are_dealt(spark):
    texts = [f"the of Word{i % 7} rare{i}" for i in range(40)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(99, "une fois chaque mot", "fr")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(20)
    want = {("en", w): n for w, n in Counter(" ".join(texts).lower().split()).items()} | {("fr", w): 1 for w in "une fois chaque mot".split()}
    for most in (1, 200_000):
        got = {(r.lang, r.word): r.n for r in Q.count_references(df, most).collect()}
        assert {k: n for k, n in got.items() if k[1][0] != " "} == want
        assert got["en", " total"] == 160 and got["fr", " total"] == 4
    ref = Q.references(df)
    assert ref["fr"][1] == sorted("une fois chaque mot".split()) and ref["fr"][2][-1] == 0
    assert dict(zip(ref["en"][1], ref["en"][2]))["the"] == 40 and len(ref["en"][1]) == 48


def brute_distance(p, q):
    import math

    total = lambda x: [v / sum(x) for v in x]
    p, q = total(p), total(q)
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    return math.sqrt((kl(p) + kl(q)) / 2)


def brute_judge(rows, p=Q.Divergence()):
    """Distances of each row from references counted over all rows, by plain dictionaries."""
    pattern = "[^\x20\x09-\x0d]+"
    kinds = lambda t: [sum("a" <= c <= "z" or ord(c) > 127 for c in t), sum("A" <= c <= "Z" for c in t), sum("0" <= c <= "9" for c in t), sum(c in " \t\n\v\f\r" for c in t), sum(c in ".,;:!?'\"-()" for c in t), sum(c in Q.SYMBOLS for c in t)]
    every = lambda t: (k := kinds(t)) + [len(t) - sum(k)]
    words, classes = {}, {}
    for _, t, lang in rows:
        words.setdefault(lang or "", Counter()).update(re.findall(pattern, (t or "").lower()))
        classes[lang or ""] = [a + b for a, b in zip(classes.get(lang or "", [0] * 7), every(t or ""))]
    out = {}
    for i, t, lang in rows:
        t, c = t or "", words[lang or ""]
        common = sorted(c, key=lambda w: (-c[w], w))[: p.common_words]
        own = Counter(re.findall(pattern, t.lower()))
        a = brute_distance(every(t), classes[lang or ""]) if len(t) >= p.min_chars else 0
        both = [[x[w] for w in common] for x in (own, c)]
        b = brute_distance(*([*v, x.total() - sum(v)] for v, x in zip(both, (own, c)))) if own.total() >= p.min_words else 0
        out[i] = (round(a, 9), round(b, 9))
    return out


def test_distances_against_brute_force_in_one_partition_and_in_many(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choices("abcdefghijé", k=rng.randint(1, 7))) for _ in range(150)] + ["x\x1fy", "Zürich", "a#b", "1.5"]
    langs = ["en", "fr", None, "xx"]
    rows = [(i, rng.choice(("", "\n")).join(rng.choice(vocab).title() + rng.choice((" ", "  ", "\t", ", ")) for _ in range(rng.choice((5, 80, 200)))), rng.choice(langs)) for i in range(120)]
    rows += [(500, None, "en"), (501, "", "de"), (502, "\u2028 \xa0 word" * 80, "en")]
    want = brute_judge(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    for parts in (1, 60):
        got = {r.doc_id: (round(r.class_distance, 9), round(r.word_distance, 9)) for r in Q.judge(df.repartition(parts)).collect()}
        assert got == want
