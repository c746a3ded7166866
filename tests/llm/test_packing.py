import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkwarden.llm import packing as P

SCHEMA = "doc_id long, text string"
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def test_encoder_equals_the_tokenizer():
    rng = random.Random(2)
    enc = P.Encoder(P.Packing())
    parts = ["The", "don't", "'s", "''s", "'", "_", "Été", "ÀÉ", "ß", "×", "÷", "12", "3.5", " ", "\n", "  ", "<|endoftext|>", "ñ", "œ", "²", "ª", "é", " ", "\x1c", "\x00", "日本", "!?", "###", "http://x.y", "İ", "Σς", "'LL", "I'M"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 10)))
        assert np.frombuffer(enc.encode(text), "<u2").tolist() == ids(text), repr(text)


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_visits_every_cell_by_steps_of_one(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(2**bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = P.hilbert(cells, bits)
    path = cells[np.argsort(key)]
    assert sorted(key) == list(range(2 ** (bits * dims))) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def check(rows, pieces, p=P.Packing()):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    left = defaultdict(list)
    for d, t in rows:
        left[d].append(ids(t))
    for d, texts in left.items():
        if len(texts) == 1:  # a round trip
            at = 0
            for r in sorted(by_doc[d], key=lambda r: r.start):
                part = texts[0][r.start : r.start + r.length]
                assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(texts[0]), zlib.crc32(np.array(part, "<u4").tobytes()))
                at += r.length
            assert at == len(texts[0])
        assert sum(r.length for r in by_doc[d]) == sum(map(len, texts))
    assert sorted(by_doc, key=str) == sorted(left, key=str)
    padding = 0
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        padding += 0 if at & (at - 1) == 0 else p.size - at
        assert at <= p.size
    assert padding == 0 and sorted(by_seq) == list(range(len(by_seq)))


def test_round_trip(spark):
    rng = random.Random(7)
    vocab = ["".join(rng.choices("abcdeéñ", k=rng.randint(1, 7))) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.choice((0, 1, 30, 300))))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "x y " * 20_000), (None, "no id"), (503, "twice"), (503, "twice")] + [(600 + i, "a copy of one text") for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("clash")).withColumn("key", F.lit(0))
    check(rows, P.pack(df).collect())


def test_like_documents_are_neighbours():
    enc = P.Encoder(P.Packing())
    a, b = "the cat sat on the mat and ran " * 20, "der hund lief durch das haus und bellte " * 20
    k = P.hilbert(P.points([np.frombuffer(enc.encode(t), "<u2") for t in (a, b, a + " today", b + " heute")], P.Packing()), 8)
    assert abs(k[0] - k[2]) < abs(k[0] - k[1]) and abs(k[1] - k[3]) < abs(k[0] - k[1])


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], SCHEMA)).collect() == []
