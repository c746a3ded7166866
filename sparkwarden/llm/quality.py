"""Quality rules: base counts, then divergence from language references.

Each text's character-class histogram and common-word histogram are compared
with its language's references by Jensen-Shannon distance (base 2, square root
of the divergence).  References are counted over all documents.  Short texts
are not judged by divergence: below ``min_chars`` code points the class test,
below ``min_words`` words the word test is left out.

Nulls and odd input: a null text has no words (n_words 0, so base_failed); a
null lang is a language of its own, the empty one; repeated rows are judged alike,
each by its own text and lang, with or without doc_id; words of equal count are
taken in the order of their letters; very long texts are read whole, in memory of
their own size; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table, tidy

BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other")  # the byte classes of class_histogram


def _byte_classes() -> np.ndarray:
    """Class of each UTF-8 byte; continuation bytes count nothing, lead bytes as lower-case letters."""
    of = np.full(256, 6)
    for b in range(256):
        c = chr(b)
        if 0x80 <= b < 0xC0:
            of[b] = 7
        elif b >= 0xC0 or "a" <= c <= "z":
            of[b] = 0
        elif "A" <= c <= "Z":
            of[b] = 1
        elif "0" <= c <= "9":
            of[b] = 2
        elif c in " \t\n\v\f\r":
            of[b] = 3
        elif c in ".,;:!?'\"-()":
            of[b] = 4
        elif c in SYMBOLS:
            of[b] = 5
    return of


BYTE_CLASS = _byte_classes()


@dataclass(frozen=True)
class Divergence:
    max_class_distance: float = 0.30
    max_word_distance: float = 0.48
    min_chars: int = 300
    min_words: int = 60
    common_words: int = 48  # of each language


def class_histogram(text: str) -> np.ndarray:
    seen = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    return np.bincount(BYTE_CLASS, weights=seen, minlength=8)[:7]


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits; 0 where one side is empty."""
    if p.sum() == 0 or q.sum() == 0:
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(d, 0.0) / 2))


def repeated_words(words: list[bytes], k: int = 5) -> int:
    """Words inside any window of ``k`` words that occurs at least twice."""
    if len(words) <= k:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    d = len(number)
    if d == len(words):
        return 0
    n = len(ids) - k + 1
    key = ids[:n].copy()
    if d**k < 2**62:
        for j in range(1, k):
            key = key * d + ids[j : j + n]
    else:  # windows are renumbered after each word, so that keys stay exact
        for j in range(1, k):
            _, key = np.unique(key * d + ids[j : j + n], return_inverse=True)
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(key, twice))
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes are split at these six characters only."""
    return text.encode("utf-8", "surrogatepass").split()


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = words_of(text)
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


REFERENCE = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.float64())])


def count_references(docs: DataFrame, most: int = 200_000) -> DataFrame:
    """``lang, word, n`` over all documents; class counts and totals have words that start with a space.

    A task adds up its batches and sends its counts on when it holds ``most`` words, so the sums are exact."""
    from pyspark.sql.pandas.types import from_arrow_schema

    def rows(words: dict[str, Counter[bytes]], classes: dict[str, np.ndarray]) -> pa.RecordBatch:
        out: list[tuple[str, str, float]] = []
        for lang, c in words.items():
            out += [(lang, w.decode("utf-8", "replace"), float(n)) for w, n in c.items()]
            out.append((lang, " total", float(c.total())))
            out += [(lang, f" {x}", float(n)) for x, n in zip(CLASSES, classes[lang])]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else ([], [], []), REFERENCE.types)], schema=REFERENCE)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter[bytes]] = {}
        classes: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                text, lang = text or "", lang or ""
                words.setdefault(lang, Counter()).update(words_of(text.lower()))
                classes[lang] = classes.get(lang, 0) + class_histogram(text)
            if sum(map(len, words.values())) >= most:
                yield rows(words, classes)
                words, classes = {}, {}
        yield rows(words, classes)

    return docs.select("lang", "text").mapInArrow(run, from_arrow_schema(REFERENCE)).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def references(docs: DataFrame, p: Divergence = Divergence()) -> dict[str, tuple[np.ndarray, list[str], np.ndarray]]:
    """Per language: class counts, common words, and their counts with those of all other words last.

    The driver receives ``common_words`` + 8 rows a language.  The most frequent words are
    picked in each task, then in each of ``pieces`` hash pieces of a language, then in all
    of it, so that no task ranks the words of a hot language alone."""
    from pyspark.sql import Window as W

    special, most, pieces = F.col("word").startswith(" "), max(p.common_words, len(CLASSES) + 1), 32

    def first(rows: DataFrame, *keys: Column) -> DataFrame:
        order = W.partitionBy("lang", special, *keys).orderBy(F.desc("n"), "word")
        return rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most)

    top = first(first(count_references(docs), F.pmod(F.xxhash64("word"), F.lit(pieces))).drop("_k"))
    out: dict[str, tuple[np.ndarray, list[str], np.ndarray]] = {}
    rows: dict[str, dict[str, float]] = {}
    top = top.where(F.col("_k") <= max(p.common_words, len(CLASSES) + 1))  # tasks cut to this before the shuffle
    for r in top.where(special | (F.col("_k") <= p.common_words)).collect():
        rows.setdefault(r.lang, {})[r.word] = r.n
    for lang, n in rows.items():
        words = sorted(w for w in n if w[:1] != " ")
        counts = [n[w] for w in words]
        out[lang] = np.array([n[f" {c}"] for c in CLASSES]), words, np.array([*counts, max(0.0, n[" total"] - sum(counts))])
    return out


OUT = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("class_distance", pa.float64()), ("word_distance", pa.float64())])


def verdict(text: str | None, lang: str | None, ref: dict, p: Divergence) -> tuple[tuple[int, ...], bool, bool, float, float]:
    """Counts, base_failed, kept and both distances of one row."""
    counts = base_counts(text)
    failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
    near_class = near_word = 0.0
    if of := ref.get(lang or ""):
        if len(text or "") >= p.min_chars:
            near_class = js_distance(class_histogram(text), of[0])
        if counts[0] >= p.min_words and of[1]:
            seen = Counter(words_of(text.lower()))
            hits = [seen[w.encode()] for w in of[1]]
            near_word = js_distance(np.array([*hits, max(0, counts[0] - sum(hits))]), of[2])
    kept = not failed and near_class <= p.max_class_distance and near_word <= p.max_word_distance
    return counts, failed, kept, near_class, near_word


def judge(docs: DataFrame, p: Divergence = Divergence()) -> DataFrame:
    """Counts, distances and verdict of every row."""
    ref = references(docs, p)

    def rows(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {f.name: [] for f in OUT}
        for doc_id, text, lang in zip(b["doc_id"], b["text"], b["lang"]):
            counts, *rest = verdict(text, lang, ref, p)
            for k, v in zip(out, (doc_id, *counts, *rest)):
                out[k].append(v)
        return out

    return arrow_map(docs.select("doc_id", "text", "lang"), rows, OUT)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules keep, in their own columns; each row has its own verdict, whatever its doc_id."""
    p = Divergence()
    ref = references(docs, p)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, lang = (b.column(b.schema.names.index(c)).to_pylist() for c in ("text", "lang"))
            yield b.filter(pa.array([verdict(t, x, ref, p)[2] for t, x in zip(text, lang)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLE_SQL: dict[str, str] = {}
