import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from sparkwarden.llm import pii as P

SCHEMA = "doc_id long, text string"


def brute(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and P.luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_against_brute_force():
    rng = random.Random(1)
    parts = ["a", "b.c", "@", ".", "-", "1", "255", "256", "0007", "4111 1111 1111 1111", "4111111111111111", "+", "(", ")", " ", "555-0100", "é", "\n", "x@y.z", "1.2.3.4", "%"]
    for _ in range(6000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 16)))
        assert P.base_spans(text) == brute(text), text


def test_luhn():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")


def test_crf_gradients():
    g = np.random.default_rng(0)
    e, A, y = g.normal(size=(5, 3, 4)), g.normal(size=(4, 4)), g.integers(0, 4, (5, 3))
    loss, de, dA = P.crf_loss(e, y, A)
    for got, x in ((de, e), (dA, A)):
        for i in list(np.ndindex(x.shape))[:20]:
            was = x[i]
            x[i] = was + 1e-5
            up = P.crf_loss(e, y, A)[0]
            x[i] = was - 1e-5
            down = P.crf_loss(e, y, A)[0]
            x[i] = was
            assert abs((up - down) / 2e-5 - got[i]) < 1e-4


def test_held_out_accuracy():
    m = P.Model()
    p = P.trained(m)
    rng = random.Random(12345)
    made = [P.labelled_window(rng, m.width) for _ in range(300)]
    found = P.decode([t for t, _ in made], p, m)
    gold = {(i, *s) for i, (_, spans) in enumerate(made) for s in spans}
    got = {(i, *s[:3]) for i, spans in enumerate(found) for s in spans}
    assert len(gold & got) / len(gold) > 0.8 and len(gold & got) / len(got) > 0.8, (len(gold), len(got), len(gold & got))


def held_out(rng, kind):
    """Forms that the generator does not make, or not in this way."""
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    w = lambda: rng.choice("maria keller hansen lopez martin weber rossi novak silva berg".split())
    if kind == "card":
        x = "5" + d(14)
        x += next(c for c in "0123456789" if P.luhn(x + c))
        return rng.choice((".", " / ", "/", "_")).join((x[:4], x[4:8], x[8:12], x[12:]))
    if kind == "email":
        return rng.choice((f"{w()}.{w()}[at]{w()}-{w()}.com", f"{w()}{d(2)} (at) {w()} (dot) net", f"{w()}(at){w()}.org"))
    return rng.choice((f"1.{d(3)}.{d(3)}.{d(4)}", f"({d(3)}){d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(3)} {d(3)} {d(4)}"))


NUMBERS = ("order 48213377", "12.345.678,90 EUR", "10:20:30.123", "52.5200, 13.4050", "2024-05-06T07:08", "pp. 112-118", "$12,300.50", "a[3] (at 5 pm)", "1.2.10", "(see 1998)", "x = 0.00012", "3 000 000")


def test_recall_and_precision_on_forms_that_the_generator_does_not_make():
    m = P.Model()
    p = P.trained(m)
    rng = random.Random(77)
    prose = lambda k: " ".join("".join(rng.choices("aeinorstdlhu", k=rng.randint(3, 8))) for _ in range(k))
    for kind, least in (("card", 0.7), ("email", 0.7), ("phone", 0.7)):
        caught = 0
        for _ in range(120):
            s = held_out(rng, kind)
            lead = prose(rng.randint(0, 20)).capitalize() + rng.choice((": ", " ", " at ", ", "))
            text = f"{lead}{s} {prose(12)}."
            caught += any(k == kind and a < len(lead) + len(s) and len(lead) < b for k, a, b in P.added(text, P.decode([text], p, m)[0], [], m))
        assert caught >= least * 120, (kind, caught)
    wrong = sum(bool(P.added(text, P.decode([text], p, m)[0], [], m)) for x in NUMBERS for text in [f"{prose(rng.randint(0, 15))} {x} {prose(8)}" for _ in range(25)])
    assert wrong <= 0.08 * 25 * len(NUMBERS), wrong


def test_the_gate_drops_no_labelled_kind():
    """Every window that holds a whole span of any kind is decoded: all kinds have a sign or four digits."""
    m, rng = P.Model(), random.Random(5)
    for _ in range(2000):
        text, spans = P.labelled_window(rng, m.width)
        for _, a, b in spans:
            s = text[a:b]
            assert any(c in "@[({" for c in s) or sum(c.isdigit() for c in s) >= m.min_digits, s
    p = P.trained(m)
    text = "tin " * 50 + "10.20.30.4" + " tin" * 50
    assert P.decode([text], p, m)[0] and P.decode(["tin " * 500], p, m) == [[]]


def test_marginals_against_enumeration():
    import itertools

    g = np.random.default_rng(2)
    e, A = g.normal(size=(4, 1, 3)), g.normal(size=(3, 3))
    weight = {y: np.exp(sum(e[t, 0, k] for t, k in enumerate(y)) + sum(A[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product(range(3), repeat=4)}
    total = sum(weight.values())
    for y in weight:
        got = P.marginals(e, A, np.array(y)[:, None])[:, 0]
        assert np.allclose(got, [sum(v for z, v in weight.items() if z[t] == y[t]) / total for t in range(4)])


def test_windows_are_reconciled():
    m = P.Model()
    p = P.trained(m)
    for shift in range(0, 140, 9):
        text = ("tin ored " * 40)[:shift] + " (555) 123-4567 " + "hale rost " * 30
        a = text.index("(")
        assert ("phone", a, a + 14) in P.added(text, P.decode([text], p, m)[0], []), shift


def test_weights_are_kept_in_the_shared_folder(spark):
    m = P.Model(windows=160, epochs=1)
    first, again = P.fitted(spark, m), P.fitted(spark, m)
    assert all(np.array_equal(first[k], again[k]) and first[k].shape == again[k].shape for k in first) and not again["E"].flags.writeable


def test_rows_and_edge_cases(spark):
    text = "é a.b@c.org 10.0.0.1 4539-1488-0343-6467 +1 (555) 123-4567 call (555) 987-6543 soon"
    rows = [(1, text), (2, None), (3, ""), (1, text), (4, "1" * 100_000), (5, "a" * 100_000 + "@")]
    got = P.scan(spark.createDataFrame(rows, SCHEMA).withColumn("spans", F.lit("clash"))).collect()
    assert len(got) == 6
    base = hashlib.sha256(P.joined(brute(text)).encode()).hexdigest()
    for r in got:
        if r.doc_id == 1:
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == (1, 1, 0, 1, base)
            assert r.n_added == 2 and r.spans.count(",") == 4  # the card after "1 " and the number without '+'
        else:
            assert r.spans == ""
    assert P.scan(spark.createDataFrame([], SCHEMA)).collect() == []
