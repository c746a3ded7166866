"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit distance.

Texts are read as bytes: A-Z lower-cased, each run of blanks and punctuation one
blank.  The CGK walk reads a text with a pointer that a random function of (step,
byte) moves on or leaves, writing the byte under it at every step: texts at a
small edit distance get embeddings at a small Hamming distance while their walks
stay in step.  At the distance that is searched, an edit comes every few letters
and two walks part for good after the first ones, so one walk over a whole item
finds nothing beyond a few percent (README has figures).  The embedding of an
item-sized window is therefore restarted at every word: the walks of all its
words, as long as the item's words allow: the more words, the more walks, and the
less likely need each of them be to meet no edit that parts it from the item's for
one of them to reach ``target`` at the distance (``Search.coordinates``).

Each repetition has its own random function and samples one coordinate of every
few steps, of every second one at first, so that most walks are given up early.
Equal samples align an item-sized window of the document with the item.  A window
whose 4-grams and 3-grams are too few of the item's to be within the distance is
dropped (an edit changes at most four or three of them, so none is lost); the rest
is compared exactly, by bit-parallel edit distance with free ends.

The index of a block of ``block_chars`` characters of items is sent to the
executors and kept once a process.  A benchmark of several blocks takes a pass
over the documents for each, one block in memory at a time.

Nulls and odd input: null or blank texts and items match nothing; short items
get shorter walks; very long texts are searched whole, in stretches; equal items
and ties between passages are all reported, of windows that overlap the best;
repeated rows give repeated rows; rows without doc_id are searched and their
hits have none; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import from_arrow_schema

from .common import materialise, table, tidy

BLANK = 32
PUNCTUATION = b".,;:!?\"'()[]{}<>|*#$%&-"


def _letters() -> np.ndarray:
    """Each byte as it is compared: lower case, blanks and punctuation as a blank."""
    of = np.arange(256, dtype=np.uint8)
    of[65:91] += 32
    of[[0, 9, 10, 11, 12, 13, *PUNCTUATION]] = BLANK
    return of


LETTER = _letters()


@dataclass(frozen=True)
class Search:
    percent: int = 20  # largest edit distance, of the item's bytes
    target: float = 0.85  # chance that some walk of a passage at that distance agrees with the item's
    repetitions: int = 6
    gap: int = 8  # steps of a walk to one sampled coordinate
    fewest: int = 9  # coordinates of a walk, unless the item is too short
    longest: int = 24
    block_chars: int = 1_000_000
    stretch: int = 6_000_000  # bytes of one document searched at once
    together: int = 4_000_000  # bytes of several documents searched at once: arrays take about 20 times as much
    seed: int = 17

    def coordinates(self, words: int, size: int) -> int:
        """Sampled coordinates of the walks over an item of ``words`` words and ``size`` bytes.

        One coordinate agrees if its letter is unedited and none of the letters skipped before it
        parts the walks, which an edit does about every third time."""
        edits = min(99, max(1, self.percent)) / 100
        agrees = (1 - edits) * (1 - edits / 3) ** (self.gap / 2 - 1)
        found = 1 - (1 - self.target) ** (1 / (max(1, words) * self.repetitions))  # needed of a single walk
        reach = math.log(found) / math.log(agrees)
        return max(1, min(self.longest, 1 + (size - 1) // self.gap, max(self.fewest, int(reach))))


STEP = np.uint64(0x9E3779B97F4A7C15)


class Walks:
    """Sampled coordinates and moves of each repetition."""

    def __init__(self, p: Search):
        g = np.random.default_rng(p.seed)
        gaps = np.minimum(p.gap, np.arange(p.longest - 1) // 3 * 3 + 2)  # short ones first, so that most walks are given up after a few steps
        self.coords = [np.concatenate(([0], np.cumsum(gaps) - g.integers(0, gaps))) for _ in range(p.repetitions)]
        self.moves = g.integers(0, 2, (p.repetitions, p.gap * p.longest, 256))

    def on(self, r: int, i: int, text: np.ndarray, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pointers at coordinate ``i`` and keys of the coordinates up to it, from those at ``i - 1``."""
        for j in range(self.coords[r][i - 1] if i else 0, self.coords[r][i]):
            at = at + self.moves[r][j].take(text.take(at))
        return at, (key ^ text.take(at)) * STEP


@dataclass
class Flat:
    """Texts in one array, a zero before, between and after them."""

    letters: np.ndarray
    raw: np.ndarray  # where each letter stands in the joined texts
    starts: np.ndarray  # where each text starts in the joined texts
    words: np.ndarray  # where words start


def flat(texts: list[bytes], pad: int) -> Flat:
    raw = np.frombuffer(b"\0" + b"\0".join(texts) + b"\0", np.uint8)
    starts = np.cumsum([1] + [len(t) + 1 for t in texts])
    letters = LETTER[raw]
    blank = letters == BLANK
    keep = np.flatnonzero(~(blank & np.concatenate(([False], blank[:-1]))))
    letters = letters[keep]
    letters[np.searchsorted(keep, starts - 1, "right") - 1] = 0
    return Flat(np.concatenate((letters, np.zeros(pad, np.uint8))), keep, starts, word_starts(letters))


def word_starts(letters: np.ndarray) -> np.ndarray:
    apart = (letters == BLANK) | (letters == 0)
    return np.flatnonzero(apart[:-1] & ~apart[1:]) + 1


def stretches(texts: list[bytes], p: Search, overlap: int) -> Iterator[tuple[int, Flat]]:
    """Number of the first text in it and letters of each stretch; a longer text is cut at blanks into stretches that share ``overlap`` letters."""
    pad, at = p.gap * p.longest, 0
    while at < len(texts):
        if len(texts[at]) > p.stretch:
            letters, raw, begin, text = np.zeros(0, np.uint8), np.zeros(0, np.int64), 0, texts[at]
            while begin < len(text):
                end = min(len(text), begin + p.stretch)
                if end < len(text):
                    end = max(text.rfind(b" ", begin, end), text.rfind(b"\n", begin, end)) + 1 or end
                f = flat([text[begin:end]], 0)
                letters = np.concatenate((letters[-overlap:], [BLANK], f.letters[1:-1])).astype(np.uint8)
                raw = np.concatenate((raw[-overlap:], [begin], f.raw[1:-1] + begin))
                whole = np.concatenate(([0], letters, np.zeros(pad + 1, np.uint8))).astype(np.uint8)
                yield at, Flat(whole, np.concatenate(([0], raw, [len(text) + 1])), np.array([1, len(text) + 2]), word_starts(whole[: len(letters) + 2]))
                begin = end
            at += 1
            continue
        size, upto = len(texts[at]), at + 1
        while upto < len(texts) and size + len(texts[upto]) <= p.together:
            size += len(texts[upto])
            upto += 1
        yield at, flat(texts[at:upto], pad)
        at = upto


def grams(letters: np.ndarray, n: int) -> np.ndarray:
    """12-bit hash of the ``n`` letters from each position; the last ``n - 1`` positions are left out."""
    h = np.zeros(max(0, len(letters) - n + 1), np.uint32)
    for j in range(n):
        shifted = letters[j : j + len(h)].astype(np.uint32)
        shifted <<= np.uint32(8 * j)
        h |= shifted
    h *= np.uint32(2654435761)
    h >>= np.uint32(20)
    return h.view(np.int32)


class Members:
    """Bitmap of a set of keys; a few percent of other keys pass too."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - min(22, max(14, int(len(keys)).bit_length() + 4)))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[(keys >> self.shift).astype(np.int64)] = True

    def has(self, keys: np.ndarray) -> np.ndarray:
        return self.bits.take((keys >> self.shift).view(np.int64))


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...`` for ``n[i]`` numbers each."""
    return np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class Index:
    """The walks of a block of items, by repetition and number of coordinates."""

    def __init__(self, items: list[tuple[int, str]], p: Search = Search()):
        self.p, self.walks = p, Walks(p)
        data = [(i, (t or "").encode("utf-8", "surrogatepass")) for i, t in items]
        f = flat([t for _, t in data], p.gap * p.longest)
        of = np.searchsorted(f.starts, f.raw, "right") - 1  # the item of each letter
        inside = f.letters[: len(f.raw)] != 0
        self.ids, self.texts = [], []
        item_of_word = of[f.words]
        origin = np.zeros(len(data), np.int64)
        number = np.full(len(data), -1)
        coordinates = np.zeros(len(data), np.int64)
        for k, (i, _) in enumerate(data):
            at = np.flatnonzero(inside & (of == k)) if len(data) < 50 else np.arange(*np.searchsorted(of, [k, k + 1]))
            text = f.letters[at][f.letters[at] != 0].tobytes()
            mine = np.searchsorted(item_of_word, [k, k + 1])
            if mine[0] < mine[1]:
                origin[k], number[k] = f.words[mine[0]], len(self.ids)
                self.ids.append(i)
                self.texts.append(text.strip())
                coordinates[k] = p.coordinates(mine[1] - mine[0], len(self.texts[-1]))
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.most = p.percent * self.size // 100
        need = coordinates[item_of_word]
        left = origin[item_of_word] + self.size[number[item_of_word]] - f.words if len(f.words) else need
        need = np.where(2 * left > p.gap * need, need, 0)  # a walk reads about half as many letters as it has steps
        self.levels: list[list[tuple]] = []
        for r in range(p.repetitions):
            at, key, out = f.words[need > 0], np.zeros(int((need > 0).sum()), np.uint64), []
            live, item, offset = need[need > 0], number[item_of_word[need > 0]], (f.words - origin[item_of_word])[need > 0]
            for i in range(int(live.max()) if len(live) else 0):
                at, key = self.walks.on(r, i, f.letters, at, key)
                done, on = live == i + 1, live > i + 1
                ends = None
                if done.any():
                    order = np.argsort(key[done], kind="stable")
                    ends = (Members(key[done]), key[done][order], item[done][order].astype(np.int32), offset[done][order].astype(np.int32))
                out.append((Members(key[on]) if on.any() and i >= 1 else None, ends, bool(on.any())))
                at, key, live, item, offset = at[on], key[on], live[on], item[on], offset[on]
            self.levels.append(out)
        self.grams = {n: self.gram_bits(n) for n in (4, 3)}

    def gram_bits(self, n: int) -> np.ndarray:
        bits = np.zeros((len(self.texts), 512), np.uint8)
        for k, t in enumerate(self.texts):
            g = grams(np.frombuffer(t, np.uint8), n)
            np.bitwise_or.at(bits[k], g >> 3, np.left_shift(1, g & 7).astype(np.uint8))
        return bits

    def candidates(self, f: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``start, item, at``: the item's first letter would stand at ``start``; the walks met at ``at``."""
        found = [(np.zeros(0, np.int64),) * 3]
        some = 20_000  # words at a time, so that all arrays stay in the processor's cache
        for words, (r, levels) in product((f.words[i : i + some] for i in range(0, len(f.words), some)), enumerate(self.levels)):
            start = at = words
            key = np.zeros(len(at), np.uint64)
            for i, (members, ends, more) in enumerate(levels):
                at, key = self.walks.on(r, i, f.letters, at, key)
                if ends is not None:
                    has, keys, item, offset = ends
                    hit = np.flatnonzero(has.has(key))
                    lo, hi = np.searchsorted(keys, key[hit], "left"), np.searchsorted(keys, key[hit], "right")
                    pick, s = spread(lo, hi - lo), np.repeat(start[hit], hi - lo).astype(np.int64)
                    found.append((s - offset[pick], item[pick].astype(np.int64), s))
                if not more:
                    break
                if members is not None:
                    on = np.flatnonzero(members.has(key))
                    start, at, key = start[on], at[on], key[on]
        return tuple(np.concatenate(x) for x in zip(*found))

    def within(self, f: Flat) -> list[tuple[int, int, int, int]]:
        """``item, first letter, letter after the last, distance`` of passages within the distance."""
        start, item, at = self.candidates(f)
        if not len(start):
            return []
        border = np.flatnonzero(f.letters[: len(f.raw)] == 0)
        low = border[np.searchsorted(border, at, "right") - 1] + 1
        high = border[np.searchsorted(border, at, "right")]
        order = np.lexsort((start, low, item))
        start, item, low, high = start[order], item[order], low[order], high[order]
        slack = self.most[item]
        joins = np.concatenate(([False], (item[1:] == item[:-1]) & (low[1:] == low[:-1]) & (start[1:] - start[:-1] <= slack[1:])))
        group = np.flatnonzero(~joins)
        last = np.append(group[1:], len(start)) - 1
        item, slack, low, high = item[group], slack[group], low[group], high[group]
        a = np.maximum(low, start[group] - slack)
        b = np.minimum(high, start[last] + self.size[item] + slack)
        # long stretches are cut where no passage is lost: pieces overlap by the longest one
        longest = self.size[item] + slack
        n = np.maximum(1, -(-(b - a - longest) // longest))
        owner = np.repeat(np.arange(len(a)), n)
        piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, a, b = item[owner], a[owner] + piece * longest[owner], np.minimum(b[owner], a[owner] + (piece + 2) * longest[owner])
        for size in (4, 3):
            need = self.size[item] - size + 1 - size * self.most[item]
            h, bits = grams(f.letters, size), self.grams[size]
            keep = np.ones(len(a), bool)
            for cut in range(0, len(a), 4096):
                part = slice(cut, cut + 4096)
                n = np.maximum(0, b[part] - a[part] - size + 1)
                g = h[spread(a[part], n)]
                has = (bits[np.repeat(item[part], n), g >> 3] >> (g & 7).astype(np.uint8)) & 1
                count = np.concatenate(([0], np.cumsum(has, dtype=np.int64)))
                ends = np.cumsum(n)
                keep[part] = count[ends] - count[ends - n] >= need[part]
            item, a, b = item[keep], a[keep], b[keep]
        near = np.flatnonzero(least_distances(self.texts, item, f.letters, a, b) <= self.most[item])
        out = []
        for k, lo, hi in zip(item[near].tolist(), a[near].tolist(), b[near].tolist()):
            text = f.letters[lo:hi].tobytes()
            d, end = best_match(self.texts[k], text)
            _, back = best_match(self.texts[k][::-1], text[:end][::-1])
            out.append((k, lo + end - back, lo + end, d))
        return out


def best_match(pattern: bytes, text: bytes) -> tuple[int, int]:
    """Smallest edit distance of ``pattern`` to a part of ``text`` and the first end of such a part."""
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += (ph & top > 0) - (mh & top > 0)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j
    return best, end


def least_distances(patterns: list[bytes], of: np.ndarray, letters: np.ndarray, a: np.ndarray, b: np.ndarray, chunk: int = 4000) -> np.ndarray:
    """``best_match(patterns[of[i]], letters[a[i]:b[i]])[0]`` for all i: the same bit vectors in 64-bit blocks, many at a time."""
    one, top = np.uint64(1), np.uint64(63)
    sizes = np.fromiter(map(len, patterns), np.int64, len(patterns))
    blocks_of, out = (sizes[of] + 63) // 64, np.zeros(len(of), np.int64)
    order = np.lexsort((b - a, blocks_of))
    for w in np.unique(blocks_of).tolist():
        same = order[blocks_of[order] == w]
        for cut in range(0, len(same), chunk):
            at = same[cut : cut + chunk]
            used, item = np.unique(of[at], return_inverse=True)
            masks = np.zeros((w, len(used) * 256), np.uint64)
            for k, x in enumerate(used.tolist()):
                i = np.arange(sizes[x])
                np.bitwise_or.at(masks, (i >> 6, k * 256 + np.frombuffer(patterns[x], np.uint8).astype(np.int64)), one << (i & 63).astype(np.uint64))
            item = item * 256
            pv, mv = [np.full(len(at), ~np.uint64(0)) for _ in range(w)], [np.zeros(len(at), np.uint64) for _ in range(w)]
            score = sizes[of[at]]
            last, best = ((score - 1) & 63).astype(np.uint64), score.copy()
            start, stop = a[at], b[at]
            for j in range(int((stop - start).max())):
                here = start + j
                letter = item + np.where(here < stop, letters[np.minimum(here, len(letters) - 1)], 0)  # no pattern has a zero
                p_in = m_in = np.zeros(len(at), np.uint64)
                for n in range(w):
                    eq = masks[n][letter]
                    xv = eq | mv[n]
                    eq = eq | m_in
                    xh = (((eq & pv[n]) + pv[n]) ^ pv[n]) | eq
                    ph, mh = mv[n] | ~(xh | pv[n]), pv[n] & xh
                    if n == w - 1:
                        score = score + ((ph >> last) & one).astype(np.int64) - ((mh >> last) & one).astype(np.int64)
                    p_out, m_out = ph >> top, mh >> top
                    ph, mh = ph << one | p_in, mh << one | m_in
                    pv[n], mv[n] = mh | ~(xv | ph), ph & xv
                    p_in, m_in = p_out, m_out
                best = np.minimum(best, score)
            out[at] = best
    return out


HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("distance", pa.int64()), ("item_chars", pa.int64())])
ROWS = 1000  # decoded at once
BLANKS = b" \t\n\v\f\r"
AFTER = re.compile(rb"[^\x20\x09-\x0d]*")


def search(texts: list[str | None], index: Index) -> list[list[tuple]]:
    """Per text: ``(item_id, start, end, distance, item length)`` of the whole words, in code points, of each passage within the distance."""
    out: list[list[tuple]] = [[] for _ in texts]
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for at, f in stretches(data, index.p, 2 * int((index.size + index.most).max(initial=0)) + 8):
        for k, a, b, d in index.within(f):
            first, last = int(f.raw[a]), int(f.raw[b - 1])
            doc = int(np.searchsorted(f.starts, first, "right")) - 1
            raw, first, last = data[at + doc], first - int(f.starts[doc]), last - int(f.starts[doc])
            while first and raw[first - 1] not in BLANKS:
                first -= 1
            last = AFTER.match(raw, last).end()
            begin = len(raw[:first].decode("utf-8", "surrogatepass"))
            out[at + doc].append((index.ids[k], begin, begin + len(raw[first:last].decode("utf-8", "surrogatepass").rstrip()), d, int(index.size[k])))
    for d, hits in enumerate(out):
        if hits:
            best: dict[tuple, tuple] = {}
            for h in sorted(hits, key=lambda h: (h[3], h[1], h[2], str(h[0]))):  # the nearest first; what it overlaps of the same item is the same passage
                if not any(h[0] == g[0] and h[1] < g[2] and g[1] < h[2] for g in best.values()):
                    best[h[0], h[1]] = h
            out[d] = sorted(best.values(), key=lambda h: (h[1], h[2], str(h[0])))
    return out


def blocks(benchmark: DataFrame, p: Search) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in benchmark.where("text is not null").select("item_id", "text").toLocalIterator():
        if block and size + len(r.text) > p.block_chars:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += len(r.text)
    if block:
        yield block


_kept: dict[str, Index] = {}


def kept(key: str, send, p: Search) -> Index:
    """The index of a sent block, once a process."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = Index(send.value, p)
    return _kept[key]


def finders(docs: DataFrame, benchmark: DataFrame, p: Search):
    """Per block, its broadcast and a function from texts to their hits."""
    for block in blocks(benchmark, p):
        send, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex
        yield send, lambda texts, send=send, key=key: search(texts, kept(key, send, p))


def hits(docs: DataFrame, benchmark: DataFrame, p: Search = Search()) -> DataFrame:
    """Every passage of a document within the edit distance of an item."""

    def one(find) -> DataFrame:
        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, len(whole), ROWS):
                    b = whole.slice(at, ROWS)
                    rows = [(d, *h) for d, found in zip(b.column("doc_id").to_pylist(), find(b.column("text").to_pylist())) for h in found]
                    cols = list(zip(*rows)) or [[] for _ in HITS]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, HITS)], schema=HITS)

        return docs.select("doc_id", "text").mapInArrow(run, from_arrow_schema(HITS))

    last, found = None, []
    for send, find in finders(docs, benchmark, p):
        if last is not None:  # one block in memory at a time: the passes before the last one are written
            found.append(materialise(one(last[1]), "decontaminate-hits"))
            last[0].destroy()
        last = send, find
    if last is not None:
        found.append(one(last[1]))
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], from_arrow_schema(HITS))


def clean(docs: DataFrame, benchmark: DataFrame, p: Search = Search()) -> DataFrame:
    """The rows of ``docs`` without a passage of the benchmark; each row is judged by its own text."""

    def one(rows: DataFrame, find) -> DataFrame:
        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, len(whole), ROWS):
                    b = whole.slice(at, ROWS)
                    yield b.filter(pa.array([not found for found in find(b.column(b.schema.names.index("text")).to_pylist())], pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    last = None
    for send, find in finders(docs, benchmark, p):
        if last is not None:
            docs = materialise(one(docs, last[1]), "decontaminate-clean")
            last[0].destroy()
        last = send, find
    return one(docs, last[1]) if last is not None else docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_decontamination": op2_decontamination}
ORACLE_SQL: dict[str, str] = {}
