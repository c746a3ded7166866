import random
import zlib

from pyspark.sql import functions as F

from sparkwarden.llm import toxicity as T

G = T.Grammar({w: 3.0 for w in T.WORDS["insult"].split()}, {"glorp": 3.0}, (1.25, 0.5, 0.2, -3.5))


def weights(text):
    return T.clause_weights(text, G.lexicon())[0]


def test_clauses():
    plain = weights("the idiot left")[0]
    assert weights("you are an idiot")[0] > plain > weights("he said that the idiot left")[0] > 0
    assert plain > weights("that is not an idiot")[0] > 0
    assert weights('"idiot" is a word')[0] < plain and weights("all is well, really.") == []
    assert weights("I will kill you")[0] > 0 and weights("kill the process") == [] and weights("kill the lights, you") == []
    assert len(weights("idiot. moron! fine, scum")) == 3 and weights("he is not. idiot") == [3.0]
    assert weights("glorpish thing") == [3.0] and weights("glorp thing") == []


def brute(text):
    """Runs the four machines one after the other over each clause."""
    out, lex = [], G.lexicon()
    clause = []
    for s, w in [*(lex[t] for t in T.TOKEN.findall(text.lower())), ("break", 0.0)]:
        if s != "break":
            clause.append((s, w))
            continue
        stream = [c[0] for c in clause]
        for m in (T.NEGATION, T.REPORT, T.TARGET, T.THREAT):
            state, after = m.states[0], []
            for x in stream:
                state, y = m.step(state, x)
                after.append(y)
            stream = after
        last, total = 0.0, 0.0
        for (s0, w0), y in zip(clause, stream):
            last = w0 if s0 == "threat" else last
            factor = T.FACTOR.get(y, 0.0)
            total += factor * (w0 or (last if factor and s0 == "target" else 0.0))
        if total:
            out.append(total)
        clause = []
    return out


def test_composition_equals_the_machines_in_a_row():
    rng = random.Random(3)
    words = ["idiot", "kill", "you", "not", "said", '"', "word", "here", ",", "moron", "they"]
    for _ in range(3000):
        text = " ".join(rng.choices(words, k=rng.randint(0, 14)))
        got, want = weights(text), brute(text)
        assert len(got) == len(want) and all(abs(a - b) < 1e-9 for a, b in zip(got, want)), text


def corpus(n):
    rng = random.Random(6)
    plain = ["".join(rng.choices("aeinorst", k=5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        words = rng.choices(plain, k=60)
        if toxic:
            words[5:5] = [rng.choice(("blarg", "zonker")) + rng.choice(("", "s", "ed", "ing")) for _ in range(4)]
        docs.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    return docs, labels


def test_learns_unknown_words_and_holds_out_a_fold(spark):
    docs, labels = corpus(900)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    y = dict(labels)
    lab = spark.createDataFrame([(k, 1, v) for k, v in labels], "doc_id long, quality int, toxic int")
    g = T.fit(d, lab)
    assert {"blarg", "zonker"} & set(g.words)
    got = T.score(d, g).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(y[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in y]
    assert len(held) > 60 and sum(a == b for a, b in held) / len(held) > 0.97
    # labels of the held-out fold change nothing
    turned = spark.createDataFrame([(k, 1, 1 - v if zlib.crc32(str(k).encode()) % 4 == 2 else v) for k, v in labels], "doc_id long, quality int, toxic int")
    assert T.fit(d, turned) == g


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "idiot " * 50_000), (None, "you moron")], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    g = T.fit(docs, none)
    got = T.score(docs, g).collect()
    assert len(got) == 5 and {r.doc_id: r.predicted for r in got} == {1: 0, 2: 0, 3: 1, None: 1}
    assert T.score(docs.limit(0), g).collect() == []
