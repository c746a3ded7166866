import random

import public_tokenizers
from tokenizers import Tokenizer

from sparkwarden.llm import token_counts as T

OTHER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))  # the same vocabulary in another library


def brute(text, rule):
    """One token at a time, byte by byte, over the other library's ids."""
    parts = text.splitlines(keepends=True) if "\r" not in text else None
    raw = text.encode()
    section = []
    for k, x in enumerate(parts or [""]):
        section += [k] * len(x.encode())
    n = [0.0] * max(1, len(parts))
    at = crossing = 0
    enc = T.Encoder(T.Attribution())
    for i in OTHER.encode(text, add_special_tokens=False).ids:
        size = len(enc.encoding.decode_single_token_bytes(i))
        inside = section[at : at + size]
        if rule == "first":
            n[inside[0]] += 1
        elif rule == "last":
            n[inside[-1]] += 1
        else:
            for k in inside:
                n[k] += 1 / size
        crossing += inside[0] != inside[-1]
        at += size
    assert at == len(raw)
    return n, crossing


def test_against_brute_force(spark):
    rng = random.Random(3)
    parts = ["The cat", " sat", "\n", "\n\n", "  \n", "  ", "é", "日本語", "don't", "12,345", "🙂", "\t", " \n \n x"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(1, 14)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rule in ("first", "last", "share"):
        got = {}
        for r in T.count(T.lines(df), T.Attribution(rule=rule)).collect():
            got.setdefault(r.doc_id, []).append(r)
        for d, text in rows:
            mine = sorted(got[d], key=lambda r: r.section)
            want, crossing = brute(text, rule)
            assert all(abs(a.n_tokens - b) < 1e-9 for a, b in zip(mine, want, strict=True)), (rule, text)
            assert sum(r.n_crossing for r in mine) == crossing
            assert "".join(text[r.start : r.end] for r in mine) == text and abs(sum(r.n_tokens for r in mine) - mine[0].doc_tokens) < 1e-9


def test_fields(spark):
    df = spark.createDataFrame([(1, "a title", None, 5)], "id long, title string, body string, section int")
    got = sorted(T.count(T.fields(df, "id", ("title", "body", "section"))).collect(), key=lambda r: r.section)
    assert [(r.section, r.start, r.end) for r in got] == [(0, 0, 9), (1, 9, 11), (2, 11, 12)] and sum(r.n_tokens for r in got) == got[0].doc_tokens


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "word " * 60_000, "x"), (3, "word " * 60_000, "x"), (None, "a\nb", "x")], "doc_id long, text string, section string")
    got = T.count(T.lines(df)).collect()
    assert sorted((str(r.doc_id), r.section, r.n_tokens) for r in got) == [("1", 0, 0.0), ("2", 0, 0.0), ("3", 0, 60_001.0), ("3", 0, 60_001.0), ("None", 0, 2.0), ("None", 1, 1.0)]
    assert T.count(T.lines(df.limit(0))).collect() == []
