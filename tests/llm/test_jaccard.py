import random
import re

from pyspark.sql import functions as F

from sparkwarden.llm import jaccard as J

SCHEMA = "doc_id long, text string"


def brute(rows):
    sets = {}
    for d, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[d] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (len(sets[d]), find(d)) for d in ids}


def run(spark, rows, p=J.Join()):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in J.components(spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("x")).withColumn("hashes", F.lit(1)), p).collect()}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        i = rng.randrange(len(words))
        words[i : i + 1] = rng.choice(([], [rng.choice(words)], [f"w{rng.randrange(10**6)}"], [words[i], "x"]))
    return words


def test_random_families_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for size in (6, 7, 8, 12, 30, 60, 120):
        for _ in range(3):
            base = [f"w{rng.randrange(60 if size < 20 else 500)}" for _ in range(size)]
            rows += [" ".join(edited(rng, base, rng.choice((0, 0, 1, 1, 2, 3, 6)))) for _ in range(14)]
    rows += ["", None, " \n ", "one", "ONE", "one two three", "a b c d"] + ["same " * 50] * 4
    rng.shuffle(rows)
    rows = list(enumerate(rows, 1))
    want = brute(rows)
    assert sum(v[1] != d for d, v in want.items()) > 60
    assert run(spark, rows) == want


def test_family_without_its_original_and_large_groups(spark):
    """Near copies of a text that is not there, and many sets with one prefix and size."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    rows = [" ".join(edited(rng, base, rng.choice((1, 2, 3, 4)))) for _ in range(80)]
    shared = [[f"s{k}.{i}" for i in range(12)] for k in range(12)]
    rows += [" ".join(w for k in rng.sample(range(12), 6) for w in shared[k]) for _ in range(60)]
    rows = list(enumerate(rows))
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, J.Join(slice=40, piece=3, least_blocks=3)) == brute(rows)  # counted in slices, lists in pieces


def test_boilerplate_in_many_small_families(spark):
    """One shingle list holds them all, and most of its pairs do not link."""
    rng = random.Random(15)
    line = "all rights reserved by the owner of this text and its heirs"
    bases = [[f"u{i}.{j}" for j in range(rng.choice((12, 13, 14, 40)))] for i in range(30)]
    rows = list(enumerate(line + " " + " ".join(edited(rng, b, rng.choice((0, 1)))) for b in bases for _ in range(3)))
    assert run(spark, rows, J.Join(slice=25, piece=4, least_blocks=2)) == brute(rows)


def test_chain_reaches_the_smallest_id(spark):
    words = [f"c{i}" for i in range(60)]
    chain = [" ".join(f"x{j}" if j < i else w for j, w in enumerate(words)) for i in range(20)]
    rows = list(enumerate(chain, 5))
    want = brute(rows)
    assert {v[1] for v in want.values()} == {5} and run(spark, rows) == want


def test_empty_nulls_and_repeats(spark):
    assert run(spark, []) == {}
    rows = [(7, "a b c d e f g h"), (7, "a b c d e f g h"), (3, "a b c d e f g h"), (None, "a b c d e"), (9, "z" * 200_000)]
    got = sorted(((r.doc_id, r.component_id) for r in J.components(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == [(3, 3), (7, 3), (7, 3), (9, 9), (None, None)]


def test_stage_keeps_one_of_each(spark):
    text = " ".join(f"k{i}" for i in range(40))
    df = spark.createDataFrame([(5, text, "s"), (2, text, "t"), (2, text, "t"), (8, "other words are here", "u"), (9, None, None)], SCHEMA + ", source string")
    got = J.stage(spark, df, "")
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [2, 8, 9]
