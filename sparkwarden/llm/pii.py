"""Personal data: fixed patterns, then a character BiLSTM with CRF transitions.

The network is trained in numpy, at the driver, from made-up text with labelled
spans (``Model.windows`` of them, the bound on what is fitted) and sent to the
executors (a few hundred KB).  A text is decoded in overlapping windows; each
character takes its label from the window in whose middle it lies best, so that
one labelling of the whole text results.  A decoded span is taken if the CRF's own
marginal probability of its labels is at least ``min_marginal`` at each character
on average; what is asked of it beyond that is little: digits of a card pass Luhn,
an address has four numbers of at most 255, a telephone number has 7 to 15 digits,
a mail address has a sign for "at" and one for the dot.

A window is decoded if it, or the one before or after it, holds '@', a bracket or
``min_digits`` digits.  No labelled kind is without: a mail address has the one or
the other, and four is the least number of digits in any other kind.  A span of at
most ``width - stride`` characters lies whole in one of the windows, so none is
missed for being cut.  Spans of the patterns always stay; the network adds spans
that overlap none of them.

Nulls and odd input: a null text is empty and has no spans; very long texts are
read whole in linear time; of labels or windows that are equally likely the first
is taken; repeated rows give repeated rows; a null doc_id is kept; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, scratch_root, table

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # matches start where a run of digits starts
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
KINDS = ("email", "ip", "card", "phone")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Each '@' is looked at once, so long runs of name characters cost no more than their length."""
    out: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        last = m.end() if m else at + 1
        if m:
            out.append(("email", start, last))
        at = text.find("@", last)
    return out


def digits_of(s: str) -> str:
    return "".join(DIGIT.findall(s))


def base_spans(text: str) -> list[Span]:
    out = emails(text)
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split("."))]
        out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if m.end() - m.start() <= 40 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


# ---- the network ---------------------------------------------------------

TAGS = ("O", *(f"{x}-{k}" for k in KINDS for x in "BI"))


@dataclass(frozen=True)
class Model:
    width: int = 96
    stride: int = 64
    embed: int = 12
    hidden: int = 28
    windows: int = 4800
    epochs: int = 8
    batch: int = 80
    rate: float = 0.015
    seed: int = 7
    min_digits: int = 4
    min_marginal: float = 0.7
    block: int = 512  # windows decoded at once


def char_ids(text: str) -> np.ndarray:
    """Code points to 0 (padding), 1 (other), 2 (letter beyond ASCII), 3.. (printable ASCII and newline)."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c == 10, 3, np.where((c >= 32) & (c < 127), c.astype(np.int64) - 28, np.where(c >= 192, 2, 1)))


SYMBOLS = 99


def labelled_window(rng: random.Random, width: int) -> tuple[str, list[Span]]:
    """Made-up text with known spans, among them forms that the patterns miss, and numbers that are nothing."""
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    w = lambda: "".join(rng.choices("aeinorstdlhucmpgbéñü", (9, 12, 7, 7, 7, 6, 6, 9, 4, 5, 3, 4, 3, 3, 2, 2, 2, 1, 1, 1), k=rng.randint(2, 9)))
    plain = lambda: "".join(rng.choices("aeinorstdlhucmpgb", k=rng.randint(2, 9)))

    def card() -> str:
        x = rng.choice("3456") + d(14)
        x += next(c for c in "0123456789" if luhn(x + c))
        return rng.choice(("", "-", " ", ".", "/", " - ", "_")).join((x[:4], x[4:8], x[8:12], x[12:]))

    def email() -> str:
        name = rng.choice((plain() + d(2), plain() + "." + plain(), plain() + "_" + plain(), plain()))
        x = rng.random()
        if x < 0.35:
            at, dot = "@", "."
        else:
            left, right = rng.choice(("[]", "()", "{}"))
            gap = rng.choice(("", " ", " "))
            at = gap + left + rng.choice(("at", "AT")) + right + gap
            dot = rng.choice((".", gap + left + "dot" + right + gap, "."))
        return name + at + dot.join([plain(), *([plain()] if rng.random() < 0.3 else []), rng.choice(("com", "org", "net", "de", "io", "co" + dot + "uk"))])

    def phone() -> str:
        s = rng.choice((" ", "-", ".", "-", " ", "/"))
        head = rng.choice(("", "", "", f"+{d(rng.randint(1, 2))}{rng.choice((s, ''))}", f"1{s}", "0", f"00{d(2)}{s}"))
        first = rng.choice((f"({d(3)}){rng.choice((' ', '', s))}", d(3) + s, d(3) + s, d(4) + s, f"({d(2)}) "))
        return head + first + s.join(rng.choice(((d(3), d(4)), (d(3), d(4)), (d(3), d(3)), (d(4), d(4)), (d(2), d(2), d(2)))))

    made = {"email": email, "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), "card": card, "phone": phone}
    other = (
        lambda: d(rng.randint(1, 8)), lambda: d(rng.randint(1, 3)), lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: f"{rng.randint(1, 28):02}.{rng.randint(1, 12):02}.{rng.randint(1900, 2030)}",
        lambda: f"{d(2)}.{d(2)}", lambda: "".join(rng.choices("0123456789abcdef", k=rng.choice((8, 32, 40)))), lambda: f"v{d(1)}.{d(1)}.{d(2)}", lambda: f"@{plain()}", lambda: d(rng.choice((10, 12, 24))), lambda: f"{d(2)}:{d(2)}:{d(2)}",
        lambda: f"{d(1)},{d(3)},{d(3)}", lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}", lambda: f"({plain()})", lambda: f"[{d(1)}]", lambda: f"{d(2)} {d(3)}", lambda: f"{d(2)}-{d(2)}", lambda: f"({d(4)})", lambda: "".join(rng.choices("abcdefABCDEF0123456789", k=16)), lambda: f"{d(1)}.{d(3)}.{d(3)}", lambda: f"{plain()}{d(3)}",
        lambda: f"{rng.randint(1900, 2030)}/{rng.randint(1, 12):02}/{rng.randint(1, 28):02}", lambda: f"97{rng.choice('89')}-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: f"97{rng.choice('89')}-{d(1)}-{d(3)}-{d(5)}-{d(1)}",
    )
    text, spans = "", []
    lead = rng.randint(0, 12)  # so that windows open in the middle of a word or number too
    while len(text) < width + lead:
        x = rng.random()
        if x < 0.14:
            k = rng.choice(KINDS)
            open_, close = rng.choice((("", ""), ("", ""), ("", ""), ("(", ")"), ("", "."), ("", ","), ("<", ">"), (":", ""), ('"', '"')))
            s = made[k]()
            text += open_
            spans.append((k, len(text), len(text) + len(s)))
            text += s + close
        elif x < 0.27:
            text += rng.choice(other)() + rng.choice(("", "", ".", ",", "%"))
        else:
            x = w()
            text += rng.choice((x, x, x.title(), x + ",", x + ".", x + ":", x.upper()))
        text += rng.choice((" ", " ", " ", " ", "\n", " | ", "  "))
    return text[lead : lead + width], [(k, a - lead, b - lead) for k, a, b in spans if a >= lead and b <= lead + width]


def tags_of(spans: list[Span], n: int) -> np.ndarray:
    y = np.zeros(n, np.int64)
    for k, a, b in spans:
        y[a:b] = TAGS.index(f"I-{k}")
        y[a] = TAGS.index(f"B-{k}")
    return y


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, W: np.ndarray, U: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states over ``x[t, batch, in]`` and what the backward pass needs."""
    T, B, _ = x.shape
    H = U.shape[0]
    h = c = np.zeros((B, H), np.float32)
    xs = x @ W + b
    hs, kept = np.empty((T, B, H), np.float32), []
    for t in range(T):
        g = xs[t] + h @ U
        s = _sigmoid(g[:, : 3 * H])
        i, f, o, u = s[:, :H], s[:, H : 2 * H], s[:, 2 * H :], np.tanh(g[:, 3 * H :])
        was_c, was_h = c, h
        c = f * c + i * u
        tc = np.tanh(c)
        h = o * tc
        hs[t] = h
        kept.append((i, f, o, u, was_c, was_h, tc))
    return hs, kept


def lstm_back(dh_out: np.ndarray, x: np.ndarray, W: np.ndarray, U: np.ndarray, kept: list) -> tuple[np.ndarray, ...]:
    T, B, H = dh_out.shape
    dU, dg_all = np.zeros_like(U), np.empty((T, B, 4 * H), np.float32)
    dh = dc = np.zeros((B, H), np.float32)
    for t in reversed(range(T)):
        i, f, o, u, was_c, was_h, tc = kept[t]
        dh = dh + dh_out[t]
        dc = dc + dh * o * (1 - tc**2)
        dg = np.concatenate((dc * u * i * (1 - i), dc * was_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u**2)), 1)
        dU += was_h.T @ dg
        dh, dc = dg @ U.T, dc * f
        dg_all[t] = dg
    flat = dg_all.reshape(-1, 4 * H)
    return dg_all @ W.T, x.reshape(-1, x.shape[2]).T @ flat, dU, flat.sum(0)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def crf_loss(e: np.ndarray, y: np.ndarray, A: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of ``y[t, batch]`` under emissions ``e``, and its gradients."""
    T, B, K = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, T):
        alpha[t] = e[t] + _lse(alpha[t - 1][:, :, None] + A, 1)
    for t in reversed(range(T - 1)):
        beta[t] = _lse(A + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _lse(alpha[-1], 1)
    de = np.exp(alpha + beta - z[None, :, None])
    pair = np.exp(alpha[:-1, :, :, None] + A + (e[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None])
    dA = pair.sum((0, 1))
    rows = np.arange(B)
    gold = e[np.arange(T)[:, None], rows, y].sum(0) + A[y[:-1], y[1:]].sum(0)
    de[np.arange(T)[:, None], rows, y] -= 1
    np.add.at(dA, (y[:-1], y[1:]), -1)
    return float((z - gold).mean()), (de / B).astype(np.float32), (dA / B).astype(np.float32)


def emissions(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, tuple]:
    v = p["E"][x]
    f, kf = lstm(v, p["Wf"], p["Uf"], p["bf"])
    b, kb = lstm(v[::-1], p["Wb"], p["Ub"], p["bb"])
    h = np.concatenate((f, b[::-1]), 2)
    return h @ p["V"] + p["c"], (v, h, kf, kb)


def training_data(m: Model, seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = random.Random(seed)
    made = [labelled_window(rng, m.width) for _ in range(n)]
    return np.stack([char_ids(t) for t, _ in made], 1), np.stack([tags_of(s, m.width) for _, s in made], 1)


@lru_cache(2)
def trained(m: Model = Model()) -> dict[str, np.ndarray]:
    """Fitted with Adam; the same numbers for the same seed."""
    g = np.random.default_rng(m.seed)
    H, D, K = m.hidden, m.embed, len(TAGS)
    shape = {"E": (SYMBOLS, D), "Wf": (D, 4 * H), "Uf": (H, 4 * H), "bf": (4 * H,), "Wb": (D, 4 * H), "Ub": (H, 4 * H), "bb": (4 * H,), "V": (2 * H, K), "c": (K,), "A": (K, K)}
    p = {k: (g.normal(0, 0.5 if k == "E" else 0.25, s) if len(s) == 2 and k != "A" else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
    p["bf"][H : 2 * H] = p["bb"][H : 2 * H] = 1
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in "12")
    X, Y = training_data(m, m.seed, m.windows)
    step, total = 0, m.epochs * (m.windows // m.batch)
    for _ in range(m.epochs):
        order = g.permutation(m.windows)
        for at in range(0, m.windows - m.batch + 1, m.batch):
            pick = order[at : at + m.batch]
            x, y = X[:, pick], Y[:, pick]
            e, (v, h, kf, kb) = emissions(p, x)
            _, de, dA = crf_loss(e, y, p["A"])
            d = {"A": dA, "V": h.reshape(-1, 2 * H).T @ de.reshape(-1, K), "c": de.sum((0, 1))}
            dh = de @ p["V"].T
            dv, d["Wf"], d["Uf"], d["bf"] = lstm_back(dh[:, :, :H], v, p["Wf"], p["Uf"], kf)
            dv2, d["Wb"], d["Ub"], d["bb"] = lstm_back(np.ascontiguousarray(dh[::-1, :, H:]), v[::-1], p["Wb"], p["Ub"], kb)
            d["E"] = np.zeros_like(p["E"])
            np.add.at(d["E"], x, dv + dv2[::-1])
            norm = max(1.0, float(np.sqrt(sum((x**2).sum() for x in d.values()))) / 5)
            step += 1
            rate = m.rate * (1 - 0.9 * step / total)
            for k in p:
                m1[k] = 0.9 * m1[k] + 0.1 * d[k] / norm
                m2[k] = 0.999 * m2[k] + 0.001 * (d[k] / norm) ** 2
                p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return p


def fitted(spark: SparkSession, m: Model = Model()) -> dict[str, np.ndarray]:
    """``trained(m)``, from the table that an earlier session left in the shared folder if there is one.

    The table's name is a hash of the options and of this module's text, so none is used
    that other code has written."""
    with open(__file__, "rb") as f:
        name = hashlib.sha256(f.read() + repr(m).encode()).hexdigest()[:24]
    path = f"{scratch_root(spark).rstrip('/')}/pii-weights-{name}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return {r.name: np.frombuffer(bytes(r.data), np.float32).reshape(r.shape) for r in spark.read.parquet(path).collect()}
    p = trained(m)
    rows = [(k, list(v.shape), bytearray(v.astype(np.float32).tobytes())) for k, v in p.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(path)
    return p


def viterbi(e: np.ndarray, A: np.ndarray) -> np.ndarray:
    T, B, K = e.shape
    best, back = e[0], np.empty((T, B, K), np.int8)
    for t in range(1, T):
        s = best[:, :, None] + A
        back[t] = s.argmax(1)
        best = s.max(1) + e[t]
    y = np.empty((T, B), np.int64)
    y[-1] = best.argmax(1)
    for t in reversed(range(1, T)):
        y[t - 1] = back[t, np.arange(B), y[t]]
    return y


def marginals(e: np.ndarray, A: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Probability of each label ``y[t, batch]`` given the whole window."""
    T, B, K = e.shape
    top = A.max()
    move = np.exp(A - top)
    e = np.exp(e - e.max(2, keepdims=True))
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[0] = e[0] / e[0].sum(1, keepdims=True)
    for t in range(1, T):
        x = (alpha[t - 1] @ move) * e[t]
        alpha[t] = x / x.sum(1, keepdims=True)
    for t in reversed(range(T - 1)):
        x = (e[t + 1] * beta[t + 1]) @ move.T
        beta[t] = x / x.sum(1, keepdims=True)
    p = alpha * beta
    return np.take_along_axis(p / p.sum(2, keepdims=True), y[:, :, None], 2)[:, :, 0]


def window_starts(n: int, m: Model) -> list[int]:
    return [0] if n <= m.width else [*range(0, n - m.width, m.stride), n - m.width]


def decode(texts: list[str], p: dict[str, np.ndarray], m: Model) -> list[list[tuple[str, int, int, float]]]:
    """Labelled spans of each text, with the mean marginal of their labels."""
    ids = [char_ids(t) for t in texts]
    jobs: list[tuple[int, int]] = []
    for i, x in enumerate(ids):
        sign = (x == 36) | (x == 63) | (x == 12) | (x == 95)  # '@', '[', '(' and '{'
        digit = (x >= 20) & (x <= 29)
        if not sign.any() and digit.sum() < m.min_digits:
            continue
        starts = np.array(window_starts(len(x), m))
        ends = np.minimum(len(x), starts + m.width)
        signs, digits = (np.concatenate(([0], np.cumsum(v))) for v in (sign, digit))
        on = (signs[ends] > signs[starts]) | (digits[ends] - digits[starts] >= m.min_digits)
        on[1:] |= on[:-1].copy()
        on[:-1] |= on[1:].copy()
        jobs += [(i, s) for s in starts[on].tolist()]
    tag = {i: np.zeros(len(ids[i]), np.int64) for i, _ in jobs}
    sure = {i: np.zeros(len(ids[i]), np.float32) for i, _ in jobs}
    edge = {i: np.full(len(ids[i]), -1, np.int64) for i, _ in jobs}  # how far from an edge the label was read
    middle = np.minimum(np.arange(m.width), np.arange(m.width)[::-1])
    for at in range(0, len(jobs), m.block):
        some = jobs[at : at + m.block]
        x = np.zeros((m.width, len(some)), np.int64)
        for j, (i, s) in enumerate(some):
            part = ids[i][s : s + m.width]
            x[: len(part), j] = part
        e = emissions(p, x)[0]
        y = viterbi(e, p["A"])
        found = np.flatnonzero(y.any(0))
        chance = np.zeros(y.shape, np.float32)
        if len(found):
            chance[:, found] = marginals(e[:, found], p["A"], y[:, found])
        for j, (i, s) in enumerate(some):
            n = min(m.width, len(ids[i]) - s)
            better = middle[:n] > edge[i][s : s + n]
            tag[i][s : s + n][better] = y[:n, j][better]
            sure[i][s : s + n][better] = chance[:n, j][better]
            edge[i][s : s + n][better] = middle[:n][better]
    out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    for i, y in tag.items():
        start = None
        for k in (*np.flatnonzero(y), len(y)):
            if start is not None and (k == len(y) or k > last + 1 or y[k] % 2 == 1 or (y[k] - 1) // 2 != (y[start] - 1) // 2):
                out[i].append((KINDS[(y[start] - 1) // 2], int(start), int(last) + 1, float(sure[i][start : last + 1].mean())))
                start = None
            if k < len(y):
                start = k if start is None else start
                last = k
    return out


AT, DOT = re.compile(r"@|[\[({] ?at ?[\])}]", re.I), re.compile(r"\.|[\[({] ?dot ?[\])}]", re.I)


def fits(kind: str, s: str) -> bool:
    """What a span must have besides the network's word."""
    n = len(digits_of(s))
    if kind == "email":
        m = AT.search(s)
        return bool(m and m.start() and DOT.search(s, m.end()))
    if kind == "ip":
        parts = s.split(".")
        return len(parts) == 4 and all(x.isascii() and x.isdigit() and int(x) <= 255 for x in parts)
    if any(c.isalpha() for c in s):
        return False
    return 13 <= n <= 19 and luhn(digits_of(s)) if kind == "card" else 7 <= n <= 15


def added(text: str, found: list[tuple[str, int, int, float]], base: list[Span], m: Model = Model()) -> list[Span]:
    """Decoded spans that are likely enough, whole words at both ends, fit their kind and touch no pattern span."""
    out = []
    for kind, a, b, chance in found:
        if chance < m.min_marginal:
            continue
        while a < b and not (text[a].isalnum() or text[a] in "(+"):
            a += 1
        while a < b and not (text[b - 1].isalnum() or text[b - 1] in ")]}" and kind == "email"):
            b -= 1
        low, high = a, b
        while low and a - low < 24 and text[low - 1].isalnum() and text[low].isalnum():
            low -= 1
        while high < len(text) and high - b < 24 and text[high - 1].isalnum() and text[high].isalnum():
            high += 1
        if fits(kind, text[low:high]) and not any(x[1] < high and low < x[2] for x in (*base, *out)):
            out.append((kind, low, high))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


OUT = pa.schema([("doc_id", pa.int64())] + [(f"n_{k}", pa.int64()) for k in KINDS] + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


def scan(docs: DataFrame, m: Model = Model()) -> DataFrame:
    params = fitted(docs.sparkSession, m)

    def rows(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {f.name: [] for f in OUT}
        texts = [t or "" for t in b["text"]]
        for doc_id, text, found in zip(b["doc_id"], texts, decode(texts, params, m)):
            base = base_spans(text)
            more = added(text, found, base, m)
            n = [sum(s[0] == k for s in base) for k in KINDS]
            for k, v in zip(out, (doc_id, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more))):
                out[k].append(v)
        return out

    return arrow_map(docs.select("doc_id", "text"), rows, OUT)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op10_pii": op10_pii}
ORACLE_SQL: dict[str, str] = {}
