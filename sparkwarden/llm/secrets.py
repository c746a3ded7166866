"""Secret scans: fixed patterns, then automata learned from labelled credentials.

Grammar inference: the strings of each labelled kind form a prefix tree over
character classes; states whose continuations are statistically compatible
(Hoeffding bound, checked recursively) are merged into a probabilistic
automaton.  Every candidate string is scored by its log likelihood under each
automaton against a background of ordinary text; the best one above the
thresholds adds a span.  Spans of the patterns always stay.

A candidate is a run of 16 or more letters, digits and ``+/_=.-``, of any length.

Nulls and odd input: a null text is empty and has no spans; very long texts are
scanned whole in linear time; of formats with equal likelihood the first by name of
the kinds is taken, and spans that start together are ordered by kind; a null
doc_id is kept; repeated rows give repeated rows; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so shorter ones need no match
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}+")
KINDS = ("assign", "access", "hex", "format")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def symbol(c: str) -> str:
    """Character class: digit, hex letter, other letter (either case), or the mark itself."""
    if c.isdigit():
        return "d"
    if "a" <= c <= "f":
        return "h"
    if "g" <= c <= "z":
        return "l"
    if "A" <= c <= "F":
        return "H"
    if "G" <= c <= "Z":
        return "L"
    return c


@dataclass
class Automaton:
    """``step[state][symbol] = (next, log p)``; an unseen symbol stays put at ``unseen``."""

    step: list[dict[str, tuple[int, float]]]
    stop: list[float]
    unseen: float = math.log(1e-4)

    def score(self, symbols: str) -> float:
        state, total = 0, 0.0
        for s in symbols:
            if (go := self.step[state].get(s)) is None:
                total += self.unseen
            else:
                state, p = go
                total += p
        return total + self.stop[state]


@dataclass
class _Node:
    n: int = 0
    ends: int = 0
    next: dict[str, int] = field(default_factory=dict)


def learn(strings: list[str], alpha: float = 0.01, least: int = 12) -> Automaton:
    """Merge compatible states of the prefix tree of ``strings``, breadth first."""
    nodes = [_Node()]
    for s in strings:
        at = 0
        nodes[0].n += 1
        for c in s:
            if c not in nodes[at].next:
                nodes.append(_Node())
                nodes[at].next[c] = len(nodes) - 1
            at = nodes[at].next[c]
            nodes[at].n += 1
        nodes[at].ends += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def count(i: int, c: str) -> int:
        return nodes[nodes[i].next[c]].n if c in nodes[i].next else 0

    flow: dict[tuple[int, str], int] = {}  # what passed an edge, once its target is shared

    def passed(i: int, c: str) -> int:
        return flow.get((i, c), count(i, c))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            x, y = nodes[a], nodes[b]
            if min(x.n, y.n) < least:
                continue
            if differ(x.ends, x.n, y.ends, y.n):
                return False
            for c in x.next.keys() | y.next.keys():
                if differ(passed(a, c), x.n, passed(b, c), y.n):
                    return False
                if c in x.next and c in y.next:
                    todo.append((x.next[c], y.next[c]))
        return True

    def fold(a: int, b: int) -> None:
        """Add tree ``b`` to state ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            x, y = nodes[a], nodes[b]
            x.n += y.n
            x.ends += y.ends
            for c, t in y.next.items():
                if c in x.next:
                    flow[a, c] = passed(a, c) + nodes[t].n
                    todo.append((x.next[c], t))
                else:
                    x.next[c] = t
                    flow[a, c] = nodes[t].n

    red, seen = [0], {0}
    while True:
        blue = [(i, c, t) for i in red for c, t in sorted(nodes[i].next.items()) if t not in seen]
        if not blue:
            break
        i, c, t = blue[0]
        for r in red:
            if compatible(r, t):
                flow[i, c] = passed(i, c)
                nodes[i].next[c] = r
                fold(r, t)
                break
        else:
            red.append(t)
            seen.add(t)
    number = {r: k for k, r in enumerate(red)}
    step, stop = [], []
    for r in red:
        total = nodes[r].ends + sum(passed(r, c) for c in nodes[r].next) + 0.5
        step.append({c: (number[t], math.log((passed(r, c) + 1e-3) / total)) for c, t in nodes[r].next.items()})
        stop.append(math.log((nodes[r].ends + 1e-3) / total))
    return Automaton(step, stop)


def labelled_credentials(per_kind: int, seed: int = 11) -> dict[str, list[str]]:
    """Made-up credentials of widely documented formats, and ordinary long strings under names that begin with ``ordinary``."""
    rng = random.Random(seed)
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    r = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    b64 = low + up + num
    word = lambda: r(low, rng.randint(2, 9))

    def ordinary() -> str:
        """Names, paths and long words in lower, upper or title case."""
        case = rng.choice((str.lower, str.upper, str.title, lambda x: rng.choice((x, x.title()))))
        number = lambda: r(num, rng.randint(1, 4))
        parts = [case(rng.choice((word, word, word, word, number))()) for _ in range(rng.randint(3, 9))]
        x = rng.choice(("-", "_", ".", "/", "", "")).join(parts)
        return x if len(x) > 12 else x + case(word() + word())

    makers = {
        "github": lambda: rng.choice(("ghp_", "gho_", "ghs_")) + r(b64, 36),
        "slack": lambda: rng.choice(("xoxb-", "xoxp-")) + r(num, 12) + "-" + r(num, 12) + "-" + r(b64, 24),
        "stripe": lambda: rng.choice(("sk_live_", "rk_live_", "sk_test_")) + r(b64, 24),
        "google": lambda: "AIza" + r(b64 + "_-", 35),
        "jwt": lambda: ".".join(("eyJ" + r(b64, 33), "eyJ" + r(b64 + "_-", 60), r(b64 + "_-", 43))),
        "base64": lambda: r(b64 + "+/", 40),
        "uppercase": lambda: r(up + num, 32),
        "ordinary words": ordinary,
        "ordinary identifiers": lambda: "-".join(r(num + "abcdef", n) for n in (8, 4, 4, 4, 12)),
    }
    return {k: [m() for _ in range(per_kind)] for k, m in makers.items()}


@dataclass(frozen=True)
class Formats:
    per_kind: int = 120  # labelled strings of each kind, the bound on what is fitted
    alpha: float = 0.01
    min_ratio: float = 14.0  # log likelihood over that of ordinary strings
    min_per_char: float = -2.4  # mean log likelihood of a character in the format


@lru_cache(4)
def automata(p: Formats) -> dict[str, Automaton]:
    return {k: learn(["".join(map(symbol, s)) for s in v], p.alpha) for k, v in labelled_credentials(p.per_kind).items()}


def format_of(candidate: str, known: dict[str, Automaton], p: Formats) -> str | None:
    """Name of the likeliest format, or None."""
    symbols = "".join(map(symbol, candidate))
    scores = {k: a.score(symbols) for k, a in known.items()}
    kind, best = max(((k, x) for k, x in scores.items() if not k.startswith("ordinary")), key=lambda x: x[1])
    plain = max(x for k, x in scores.items() if k.startswith("ordinary"))
    return kind if best >= p.min_per_char * len(symbols) and best - plain >= p.min_ratio else None


def format_spans(text: str, known: dict[str, Automaton], p: Formats) -> list[Span]:
    out: list[Span] = []
    for m in CANDIDATE.finditer(text):
        s = m[0].rstrip(".=-")
        if format_of(s, known, p):
            out.append(("format", m.start(), m.start() + len(s)))
    return out


def all_spans(text: str | None, known: dict[str, Automaton], p: Formats) -> tuple[list[Span], list[Span]]:
    """Pattern spans, and these with the added ones that overlap none of them."""
    base = base_spans(text or "")
    added = [s for s in format_spans(text or "", known, p) if not any(b[1] < s[2] and s[1] < b[2] for b in base)]
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


OUT = pa.schema([("doc_id", pa.int64())] + [(f"n_{k}", pa.int64()) for k in KINDS[:3]] + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_format", pa.int64())])


def scan(docs: DataFrame, p: Formats = Formats()) -> DataFrame:
    known = automata(p)

    def rows(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {f.name: [] for f in OUT}
        for doc_id, text in zip(b["doc_id"], b["text"]):
            base, both = all_spans(text, known, p)
            n = [sum(s[0] == k for s in both) for k in KINDS]
            for k, v in zip(out, (doc_id, *n[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(both), n[3])):
                out[k].append(v)
        return out

    return arrow_map(docs.select("doc_id", "text"), rows, OUT)


def redacted(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """Overlapping spans become one mark."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, p: Formats = Formats()) -> DataFrame:
    """The same rows and columns with secrets replaced in ``text``; ``n_chars``, if there, follows."""
    known = automata(p)
    schema = docs.schema

    def run(batches):
        for b in batches:
            texts = b.column(schema.names.index("text")).to_pylist()
            new = [t and redacted(t, all_spans(t, known, p)[1]) for t in texts]
            for name, values in (("text", new), ("n_chars", [n if t == o else len(t) for n, t, o in zip(b.column(schema.names.index("n_chars")).to_pylist(), new, texts)] if "n_chars" in schema.names else None)):
                if values is not None:
                    i = schema.names.index(name)
                    b = b.set_column(i, b.schema.field(i), pa.array(values, b.schema.field(i).type))
            yield b

    return docs.mapInArrow(run, schema)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return redact(docs)


QUERIES = {"op1_secret_scans": op1_secret_scans}
ORACLE_SQL: dict[str, str] = {}
