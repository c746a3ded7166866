"""Toxicity: a weighted finite-state grammar over clauses.

Words become symbols (insult, threat, target, negation, report, other).  Four
transducers - negation, reported speech, target, threat - rewrite the symbol
stream one after the other; their composition is built once as a single machine.
It runs over each clause and gives the weight of its matches: an insult counts
more next to a target, less after a negation or inside reported speech; threats
count with a target.  A document's score is a logistic function of its heaviest
clause, its number of matching clauses and their share.

Insult words, stems and the logistic function are learned from labelled rows:
at most ``Fit.rows`` of them, those with the smallest hash of doc_id, equal
texts once.  Only doc_ids choose rows; they are no input of a score.  All words of
these rows that tell toxic texts apart are learned, so their number is bounded by
the rows.  The other symbols are those of four languages, looked up alike in every
text, as lang is no input.

Nulls and odd input: a null text is empty and gets the score of a text without
matches; very long texts are read whole; of equal words in two lists the learned
one counts; a score equal to the threshold is predicted toxic; repeated rows give
repeated rows;
labels without document or with a null label are left out; without any labels
of one kind, scores fall back on the built-in words; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table

TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.,;:!?\n\"]")
BREAKS = frozenset(".,;:!?\n")

# Built-in symbols in English, German, French and Spanish; learned words are added as insults.
WORDS = {
    "insult": (
        "idiot moron stupid pathetic worthless disgusting scum loser trash clown "
        "idioten dumm dumme dummkopf wertlos abschaum widerlich versager "
        "idiote stupide minable déchet dégoûtant ordure "
        "idiota estúpido estúpida inútil basura asqueroso escoria"
    ),
    "threat": (
        "kill hurt destroy punch burn stab shoot beat strangle "
        "töte töten umbringen schlage schlagen verletzen vernichten verbrennen "
        "tuer tuerai frapper blesser détruire brûler "
        "matar mataré golpear herir destruir quemar"
    ),
    "target": (
        "you your yours he she they him her them his their we these those people "
        "du dich dir dein deine ihr euch euer sie ihnen "
        "tu toi vous votre vos ils elles eux "
        "tú ti usted ustedes vosotros ellos ellas"
    ),
    "negation": (
        "not never no isn't aren't wasn't weren't don't doesn't didn't without neither nor "
        "nicht kein keine keinen keiner nie niemals ohne weder noch "
        "pas jamais sans aucun aucune "
        "nunca ningún ninguna tampoco jamás"
    ),
    "report": (
        "said says say wrote writes called calls claimed claims quoted quotes reported reports "
        "sagte sagt schrieb schreibt nannte nennt behauptet behauptete zitiert "
        "disait écrit écrivait appelle appelait prétend affirme "
        "dijo dice escribió escribe llamó llama afirma afirmó"
    ),
}


class Transducer:
    """``arcs[state, symbol] = (state, symbol out)``; other pairs keep the state given by ``stay`` and the symbol."""

    def __init__(self, states: tuple[str, ...], arcs: dict[tuple[str, str], tuple[str, str]], stay: dict[str, str] | None = None):
        self.states, self.arcs, self.stay = states, arcs, stay or {}

    def step(self, state: str, s: str) -> tuple[str, str]:
        return self.arcs.get((state, s)) or (self.stay.get(state, state), s)


NEGATION = Transducer(  # three words after a negation
    ("start", "n1", "n2", "n3"),
    {(s, "negation"): ("n1", "other") for s in ("start", "n1", "n2", "n3")} | {(s, k): ("start", f"denied {k}") for s in ("n1", "n2", "n3") for k in ("insult", "threat")},
    {"n1": "n2", "n2": "n3", "n3": "start"},
)
REPORT = Transducer(  # from a verb of speech to the end of the clause, and inside quotation marks
    ("start", "said"),
    {("start", "report"): ("said", "other"), ("start", "quote"): ("said", "other"), ("said", "quote"): ("start", "other")} | {("said", k): ("said", f"reported {k}") for k in ("insult", "threat")},
)
TARGET = Transducer(  # a target up to four words before
    ("start", "t1", "t2", "t3", "t4"),
    {(s, "target"): ("t1", "target") for s in ("start", "t1", "t2", "t3", "t4")} | {(s, k): ("t1", f"aimed {k}") for s in ("t1", "t2", "t3", "t4") for k in ("insult", "threat")},
    {"t1": "t2", "t2": "t3", "t3": "t4", "t4": "start"},
)
THREAT = Transducer(("start", "open"), {("start", "threat"): ("open", "other"), ("open", "target"): ("start", "aimed threat")})  # a target after the threat
SYMBOLS = ("insult", "threat", "target", "negation", "report", "quote", "other")
FACTOR = {"insult": 1.0, "aimed insult": 1.3, "denied insult": 0.3, "reported insult": 0.4, "aimed threat": 1.5, "denied threat": 0.2, "reported threat": 0.3, "threat": 0.0}


def compose(machines: tuple[Transducer, ...] = (NEGATION, REPORT, TARGET, THREAT)) -> list[dict[str, tuple[int, float]]]:
    """One machine: ``table[state][symbol] = (state, factor)``, state 0 first, reachable states only."""
    number: dict[tuple[str, ...], int] = {tuple(m.states[0] for m in machines): 0}
    todo, out = [next(iter(number))], []
    for states in todo:
        row = {}
        for s in SYMBOLS:
            after, symbol = [], s
            for m, state in zip(machines, states):
                state, symbol = m.step(state, symbol)
                after.append(state)
            key = tuple(after)
            if key not in number:
                number[key] = len(number)
                todo.append(key)
            row[s] = (number[key], FACTOR.get(symbol, 0.0))
        out.append(row)
    return out


MACHINE = compose()


@dataclass(frozen=True)
class Fit:
    rows: int = 12_000
    least: int = 5  # labelled texts that hold a learned word
    ratio: float = 20.0  # its rate among toxic texts over that among others
    stems: tuple[int, ...] = (4, 5, 6)
    stem_least: int = 12
    threshold: float = 0.3


@dataclass(frozen=True)
class Grammar:
    words: dict[str, float]  # insults and their weights
    stems: dict[str, float]
    weights: tuple[float, ...]  # of the logistic function

    def lexicon(self) -> Lexicon:
        return Lexicon(self)


class Lexicon(dict):
    """Word -> (symbol, weight), remembered for up to ``most`` words."""

    most = 400_000

    def __init__(self, g: Grammar):
        self.fixed = {w: (k, 2.0 if k == "threat" else 0.0) for k, v in WORDS.items() if k != "insult" for w in v.split()}
        self.fixed |= {b: ("break", 0.0) for b in BREAKS} | {'"': ("quote", 0.0)} | {w: ("insult", x) for w, x in g.words.items()}
        self.stems, self.lengths = g.stems, sorted({len(s) for s in g.stems})

    def __missing__(self, w: str) -> tuple[str, float]:
        if (found := self.fixed.get(w)) is None:
            found = next((("insult", self.stems[w[:n]]) for n in self.lengths if len(w) > n and w[:n] in self.stems), ("other", 0.0))
        if len(self) < self.most:
            self[w] = found
        return found


def clause_weights(text: str | None, words: Lexicon) -> tuple[list[float], int]:
    """Weight of each matching clause, and the number of words."""
    symbols = [words[t] for t in TOKEN.findall((text or "").lower())]
    if not any(w for _, w in symbols):
        return [], len(symbols)
    out, state, total = [], 0, 0.0
    for s, w in (*symbols, ("break", 0.0)):
        if s == "break":
            if total:
                out.append(total)
            state, total, pending = 0, 0.0, 0.0
            continue
        if s == "threat":
            pending = w
        state, factor = MACHINE[state][s]
        total += factor * (w or (pending if factor and s == "target" else 0.0))
    return out, len(symbols)


def features(text: str | None, words: Lexicon) -> tuple[float, float, float]:
    w, n = clause_weights(text, words)
    return (0.0, 0.0, 0.0) if not w else (math.log1p(max(w)), math.log1p(len(w)), math.log1p(100 * sum(w) / (n + 20)))


def logistic(X: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps; the constant last."""
    X = np.column_stack((X, np.ones(len(X))))
    b = np.zeros(X.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(X @ b, -30, 30)))
        g = X.T @ (y - p) - 0.1 * b
        b = b + np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X + 0.1 * np.eye(len(b)), g)
    return b


def fold(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(4))


def labelled_sample(docs: DataFrame, labels: DataFrame, f: Fit) -> DataFrame:
    """``text, toxic`` of at most ``f.rows`` rows outside the held-out fold, equal texts once."""
    picked = labels.where("doc_id is not null and toxic is not null").where(fold() != 2).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(f.rows)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").groupBy(F.md5("text").alias("_k")).agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).drop("_k")


def fit(docs: DataFrame, labels: DataFrame, f: Fit = Fit()) -> Grammar:
    sample = labelled_sample(docs, labels, f).persist()
    base = {w: 3.0 for w in WORDS["insult"].split()}
    try:
        n = sample.agg(F.sum("toxic").alias("pos"), F.count("*").alias("all")).first()
        pos, neg = n["pos"] or 0.0, n["all"] - (n["pos"] or 0.0)
        if not pos or not neg:
            return Grammar(base, {}, (1.25, 0.5, 0.2, -3.5))
        words = sample.select("toxic", F.monotonically_increasing_id().alias("_i"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), 0))).alias("w"))

        def lifted(unit: DataFrame, least: int):
            c = unit.groupBy("w").agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).withColumn("q", F.col("n") - F.col("p"))
            ratio = (F.col("p") / pos) / ((F.col("q") + 0.5) / neg)
            return c.where((F.col("p") >= least) & (ratio >= f.ratio) & (F.col("q") <= 0.1 * F.col("p"))).withColumn("x", F.log(ratio)).collect()

        learned = {r.w: min(5.0, r.x) for r in lifted(words, f.least)}
        cut = words.withColumn("k", F.explode(F.array(*map(F.lit, f.stems)))).where(F.length("w") > F.col("k"))
        stems = {r.w: min(5.0, r.x) for r in lifted(cut.select("toxic", "_i", F.expr("substring(w, 1, k)").alias("w")).distinct(), f.stem_least)}
        draft = Grammar(base | learned, stems, ())
        schema = pa.schema([(c, pa.float64()) for c in ("a", "b", "c", "y")])

        lex = draft.lexicon()

        def rows(b: dict[str, list]) -> dict[str, list]:
            x = [features(t, lex) for t in b["text"]]
            return {"a": [v[0] for v in x], "b": [v[1] for v in x], "c": [v[2] for v in x], "y": b["toxic"]}

        got = np.array([tuple(r) for r in arrow_map(sample, rows, schema).collect()], float)
        return Grammar(draft.words, draft.stems, tuple(logistic(got[:, :3], got[:, 3]).tolist()))
    finally:
        sample.unpersist()


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_clauses", pa.int64())])


def score(docs: DataFrame, g: Grammar, threshold: float = Fit.threshold) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_clauses`` for every row."""

    lex = g.lexicon()

    def rows(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {f.name: [] for f in OUT}
        for doc_id, held, text in zip(b["doc_id"], b["held_out"], b["text"]):
            x = features(text, lex)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w * v for w, v in zip(g.weights, (*x, 1.0)))))))
            for k, v in zip(out, (doc_id, held, p, int(p >= threshold), round(math.expm1(x[1])))):
                out[k].append(v)
        return out

    return arrow_map(docs.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "text"), rows, OUT)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE_SQL: dict[str, str] = {}
