import hashlib
import random
import re

from pyspark.sql import functions as F

from sparkwarden.llm import secrets as S

SCHEMA = "doc_id long, text string, n_chars long"


def brute(text):
    out = []
    for kind, rx, good in (
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(rx, text) if good(m)]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_base_against_brute_force():
    rng = random.Random(1)
    parts = ["token", "API_KEY", "apikey", "toKen", "ſecret", "secret", "passwd", " ", "=", ":", '"', "'", "abc123DEF", "0" * 32, "deadbeef" * 5, "AKIA", "ABCDEFGH12345678", "é", "\n", ".", "-"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert S.base_spans(text) == brute(text), text


def test_learned_formats_on_held_out_strings():
    p = S.Formats()
    known = S.automata(p)
    fresh = S.labelled_credentials(200, seed=99)
    for kind, strings in fresh.items():
        found = sum(S.format_of(s, known, p) is not None for s in strings if len(s) >= 20)
        total = sum(len(s) >= 20 for s in strings)
        assert found <= 0.02 * total if kind.startswith("ordinary") else found >= 0.95 * total, (kind, found, total)
    assert all(len(a.step) < 60 for a in known.values()) and len(known["slack"].step) > 3


def test_merging_recovers_a_loop():
    rng = random.Random(2)
    lengths = [next(k for k in range(1, 99) if rng.random() < 0.4) for _ in range(500)]
    a = S.learn(["ab" * k for k in lengths])
    assert len(a.step) <= 8 and a.score("abab") > a.score("aabb") + 3


def test_rows_and_edge_cases(spark):
    key = "ghp_" + "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1dF3hJ5"
    text = f"é {key} token = deadbeef{'0' * 32}."
    rows = [(1, text, 9), (2, None, None), (3, "", 0), (1, text, 9), (4, "z" * 300_000 + " 1" * 10, 5)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("spans", F.lit("clash"))
    got = S.scan(df).collect()
    assert len(got) == 5
    r = next(r for r in got if r.doc_id == 1)
    base = brute(text)
    assert r.base_sha256 == hashlib.sha256(S.joined(base).encode()).hexdigest() and (r.n_assign, r.n_hex, r.n_format) == (1, 1, 1)
    assert r.spans.split(",")[0] == f"format:2:{2 + len(key)}" and S.joined(base) in r.spans
    for r in got:
        if r.doc_id in (2, 3, 4):
            assert r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest()
    out = {r.doc_id: r for r in S.stage(spark, df, "").collect()}
    assert out[1].text == "é [SECRET] [SECRET]" and out[1].n_chars == len(out[1].text) and out[2].text is None and out[4].n_chars == 5
    assert S.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_and_digitless_candidates_are_scored():
    rng = random.Random(6)
    p = S.Formats()
    known = S.automata(p)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    r = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    b64 = letters + "0123456789"
    jwt = ".".join(("eyJ" + r(b64, 33), "eyJ" + r(b64 + "_-", 9000), r(b64 + "_-", 43)))
    for key in (jwt, r(b64 + "+/", 5000)):
        assert S.format_spans(f"x {key} y", known, p) == [("format", 2, 2 + len(key))]
        assert S.redacted(f"x {key} y", S.all_spans(f"x {key} y", known, p)[1]) == "x [SECRET] y"
    keys = ["sk_live_" + r(letters, 24) for _ in range(200)] + [r(letters, 40) for _ in range(200)]
    assert sum(S.format_spans(k, known, p) != [] for k in keys) >= 0.9 * len(keys)
    assert not any(S.format_spans(t, known, p) for t in ("z" * 50_000, "1234567890" * 8, "-" * 5000, "=" * 40, "https://example.org/some/long/path/of/plain/words", "an-ordinary-hyphenated-name-of-words"))


def test_formats_that_the_generator_does_not_make():
    rng = random.Random(8)
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    r = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    b = low + up + num
    p = S.Formats()
    known = S.automata(p)
    secret = {"npm_": (lambda: "npm_" + r(b, 36), 0.9), "SG.": (lambda: f"SG.{r(b + '-_', 22)}.{r(b + '-_', 43)}", 0.9), "sq0atp-": (lambda: "sq0atp-" + r(b + "-_", 22), 0.7), "hf_": (lambda: "hf_" + r(b, 34), 0.9), "pypi-": (lambda: "pypi-" + r(b + "-_", 60), 0.9), "glpat-": (lambda: "glpat-" + r(b + "-_", 20), 0.4)}
    for name, (make, least) in secret.items():
        assert sum(bool(S.format_of(make(), known, p)) for _ in range(150)) >= 150 * least, name
    plain = (
        lambda: "".join(r(low, rng.randint(3, 9)).title() for _ in range(4)), lambda: "/".join(r(low, rng.randint(3, 9)) for _ in range(4)), lambda: "_".join(r(up, rng.randint(3, 8)) for _ in range(4)),
        lambda: f"www.{r(low, 9)}.com/{r(low, 8)}/{r(num, 6)}.html", lambda: r(low, 22), lambda: r(up, 18), lambda: r(num, 24), lambda: "-".join(r(num + "abcdef", n) for n in (8, 4, 4, 4, 12)),
    )
    for make in plain:
        assert sum(bool(S.format_of(make(), known, p)) for _ in range(150)) <= 150 * 0.1, make()
