import random
import re

import numpy as np
from pyspark.sql import functions as F

from sparkwarden.llm import decontaminate as D


def distance(pattern, text):
    """Smallest edit distance to any part of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(600):
        a, b = (bytes(rng.choices(b"abc", k=rng.randint(lo, 14))) for lo in (1, 0))
        d, end = D.best_match(a, b)
        assert d == distance(a, b)
        assert min(distance_whole(a, b[s:end]) for s in range(end + 1)) == d


def distance_whole(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def vocabulary(rng, n=3000):
    return ["".join(rng.choices("aeionrstlhd", k=rng.randint(2, 9))) for _ in range(n)]


def edit(rng, words, vocab, rate):
    out = []
    for w in words:
        x = rng.random()
        if x < rate / 3:
            continue
        out.append(rng.choice(vocab) if x < 2 * rate / 3 else w)
        if 2 * rate / 3 <= x < rate:
            out.append(rng.choice(vocab))
    return out


def plain(text):
    """As the operator reads a text: lower case, runs of blanks and punctuation as one blank."""
    return " ".join(re.sub(r"[\s\0.,;:!?\"'()\[\]{}<>|*#$%&-]+", " ", text.lower()).split()).encode()


def letters(rng, text, rate):
    out = []
    for c in text:
        x = rng.random()
        if x >= rate / 3:
            out.append(rng.choice("aeionrst ") if x < 2 * rate / 3 else c)
            if 2 * rate / 3 <= x < rate:
                out.append(rng.choice("aeionrst "))
    return "".join(out)


def test_recall_against_brute_force():
    rng = random.Random(5)
    vocab = vocabulary(rng)
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice((12, 25, 60))))) for i in range(40)]
    index = D.Index(items, D.Search())
    for kind, rates in ((lambda t, r: " ".join(edit(rng, t.split(), vocab, r)), (0, 0.05, 0.1, 0.15)), (lambda t, r: letters(rng, t, r), (0.03, 0.06, 0.1, 0.15, 0.18))):
        for rate in rates:
            texts = [" ".join(rng.choices(vocab, k=40)) + " " + kind(t, rate).upper() + ".\n" + " ".join(rng.choices(vocab, k=40)) for _, t in items]
            near = [100 * distance(t.encode(), plain(x)) <= 20 * len(t) for (_, t), x in zip(items, texts)]
            found = D.search(texts, index)
            want = [k for k, close in enumerate(near) if close]
            assert len(want) > 10
            assert sum(k in {h[0] for h in found[k]} for k in want) / len(want) >= 0.95
            for k, hits in enumerate(found):
                assert {h[0] for h in hits} <= ({k} if near[k] else set())


def test_filters_lose_no_window(monkeypatch):
    """With every word start of the text as a candidate of every item, all passages within the distance are found."""
    rng = random.Random(11)
    vocab = vocabulary(rng, 300)
    items = [(i, " ".join(rng.choices(vocab, k=k))) for i, k in enumerate((1, 2, 4, 9, 20, 40, 80))]
    index = D.Index(items, D.Search())

    def every(f):
        s = np.repeat(f.words.astype(np.int64), len(index.ids))
        return s, np.tile(np.arange(len(index.ids)), len(f.words)), s

    monkeypatch.setattr(index, "candidates", every)
    for rate in (0, 0.05, 0.1, 0.2):
        for _, t in items:
            text = " ".join(rng.choices(vocab, k=15)) + " " + letters(rng, t, rate) + " " + " ".join(rng.choices(vocab, k=15))
            want = {i for i, u in items if 100 * distance(u.encode(), plain(text)) <= 20 * len(u)}
            assert {h[0] for h in D.search([text], index)[0]} == want


def test_walks_grow_with_the_item_and_shrink_with_the_distance():
    p = D.Search()
    sizes = [p.coordinates(n, 7 * n) for n in (1, 3, 10, 30, 100, 1000)]
    assert sizes == sorted(sizes) and sizes[0] < sizes[2] < sizes[4]
    assert D.Search(percent=5).coordinates(30, 210) > D.Search(percent=20).coordinates(30, 210)


def test_spans_and_clean_documents():
    rng = random.Random(9)
    vocab = vocabulary(rng)
    item = " ".join(rng.choices(vocab, k=30))
    before = "é " + " ".join(rng.choices(vocab, k=10)) + "  "
    index = D.Index([(4, item), (5, "!?"), (6, "")], D.Search())
    found = D.search([before + item + "!\nmore", " ".join(rng.choices(vocab, k=5000)), None, "", item.split()[0]], index)
    assert found[0] == [(4, len(before), len(before) + len(item) + 1, 0, len(item))] and found[1:] == [[], [], [], []]
    assert D.search([], index) == [] and D.search(["a"], D.Index([], D.Search())) == [[]]


def test_long_texts_are_searched_whole():
    rng = random.Random(4)
    vocab = vocabulary(rng)
    item = " ".join(rng.choices(vocab, k=25))
    prose = " ".join(rng.choices(vocab, k=4000))
    p = D.Search(stretch=3000)
    at = [0, len(prose) // 3, len(prose) // 2, len(prose)]
    for cut in range(2900, 3100, 7):
        text = "é" * 5 + prose[:cut] + " " + item + " " + prose[cut:]
        assert [h[1:4] for h in D.search(["short", text, "x"], D.Index([(1, item)], p))[1]] == [(cut + 6, cut + 6 + len(item), 0)]
    text = " ".join(prose[a:b] + " " + item for a, b in zip([0, *at], at))
    assert len(D.search([text], D.Index([(1, item)], p))[0]) == 4
    assert D.search(["x" * 10_000], D.Index([(1, item)], p)) == [[]]


def test_table_and_stage(spark, tmp_path):
    rng = random.Random(2)
    vocab = vocabulary(rng)
    items = [(i, " ".join(rng.choices(vocab, k=20))) for i in range(5)] + [(9, None), (10, "")]
    rows = [(1, "x " + items[0][1], "a"), (1, "x " + items[0][1], "a"), (2, items[1][1] + " " + items[2][1], "a"), (3, None, None), (4, " ".join(rng.choices(vocab, k=30_000)), "b"), (None, items[3][1], "b"), (None, "clean", "b"), (1, "clean too", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    for size in (300, 10_000):
        p = D.Search(block_chars=size)
        got = sorted(((r.doc_id, r.item_id, r.distance) for r in D.hits(docs, bench, p).collect()), key=str)
        assert got == sorted([(1, 0, 0), (1, 0, 0), (2, 1, 0), (2, 2, 0), (None, 3, 0)], key=str)
        out = D.clean(docs, bench, p)
        assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "4", "None"]
    assert D.hits(docs, bench.limit(0)).collect() == [] and D.hits(docs.limit(0), bench).collect() == []
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = D.stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "4", "None"]


def test_distances_of_many_windows():
    rng = random.Random(3)
    patterns = [bytes(rng.choices(b"abc d", k=k)) for k in (1, 5, 63, 64, 65, 128, 129, 200)]
    of = np.array([rng.randrange(len(patterns)) for _ in range(200)])
    texts = [bytes(rng.choices(b"abc d", k=rng.randint(0, 150))) + patterns[o][: rng.randint(0, 200)] for o in of.tolist()]
    ends = np.cumsum([len(t) for t in texts])
    joined = np.frombuffer(b"".join(texts), np.uint8)
    got = D.least_distances(patterns, of, joined, ends - [len(t) for t in texts], ends, chunk=30)
    assert got.tolist() == [D.best_match(patterns[o], t)[0] for o, t in zip(of.tolist(), texts)]


def test_texts_are_searched_in_small_groups_and_one_text_whole():
    """Arrays take a multiple of a group's bytes in each Python process, so groups are small; a word is not cut by that."""
    p = D.Search()
    texts = [b"ab " * 1_000_000, b"c" * 5_000_000, b"d", b"ef " * 900_000, b"gh " * 900_000]
    got = [(at, len(f.starts) - 1, len(f.raw)) for at, f in D.stretches(texts, p, 100)]
    assert [g[:2] for g in got] == [(0, 1), (1, 1), (2, 2), (4, 1)]
    assert max(n for _, k, n in got if k > 1) <= p.together + 10
