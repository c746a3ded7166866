"""Packing: documents in space-filling-curve order, cut into full sequences.

Token ids of a document are hashed to a sparse vector, projected to a few
dimensions and given a Hilbert key, so that like documents lie near each other;
rows are range-sorted by that key (ties, such as copies, by a hash of doc_id, so
that no key is too big for a partition).  The documents of the whole order form
one stream of ids that is cut every ``size`` ids.  The last, shorter stretch is
cut at falling powers of two, which need no padding.

Positions come from per-partition totals: one row a partition is broadcast, and
there are at most ``most_parts`` of them.  Beyond ``most_parts * part`` ids the
partitions grow: they are sorted on disk and read in batches, so memory stays
bounded, and no row is left out.

Nulls and odd input: a null or empty text is the end id alone; very long texts
span many sequences; documents of equal key are ordered by a hash of doc_id and ids,
then doc_id; repeated rows are packed each; a null doc_id is kept; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import materialise, table


@dataclass(frozen=True)
class Packing:
    tokenizer: str | None = None  # a file; None: the public word_bpe_49k.json of each machine
    size: int = 2048  # a power of two
    end: int = 1
    dims: int = 4
    bits: int = 8  # of each dimension
    buckets: int = 512
    part: int = 3_000_000  # ids in a partition
    most_parts: int = 20_000
    remembered: int = 600_000  # pieces of text whose ids a process keeps


PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xa9\xab-\xb1\xb4-\xb8\xbb\xbf-\xff]*")  # Latin-1 without letters or digits that classes disagree about
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zµß-öø-ÿ]+|[0-9]|[^\s0-9a-zµß-öø-ÿ]+")  # fixed value: the tokenizer's own pattern, for lower-case Latin-1


class Encoder(dict):
    """Ids of whole texts, as little-endian bytes.

    The tokenizer encodes each piece of its own split alone, so its model is
    asked piece by piece and pieces are remembered; texts beyond plain Latin-1,
    and all texts if the tokenizer splits otherwise, go through it whole."""

    probe = "It's an Été, don't: 3.50_x #ñ\xdf!?  'LL (we've)\n--\xb5\xd7\xf7"

    def __init__(self, p: Packing):
        import public_tokenizers
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(p.tokenizer or public_tokenizers.path("word_bpe_49k.json"))
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 65536 else "<u4")
        self.most, self.end = p.remembered, np.array([p.end], self.dtype).tobytes()
        self.model, level = self.tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x100)}
        self.split = True
        self.split = self.encode(self.probe) == self.whole(self.probe) + self.end

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def __missing__(self, piece: str) -> bytes:
        found = self.model.tokenize(piece if piece.isascii() else piece.translate(self.bytes))
        ids = b"".join([t.id.to_bytes(self.dtype.itemsize, "little") for t in found])
        if len(self) < self.most:
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if not self.split or "<|" in text or not PLAIN.fullmatch(text):
            return self.whole(text) + self.end
        return b"".join(map(self.__getitem__, PIECE.findall(text.lower()))) + self.end


@lru_cache(2)
def encoder(p: Packing) -> Encoder:
    """One of a process: what it remembers serves all its tasks."""
    return Encoder(p)


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points ``x[n, dims]`` below ``2**bits``."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of the coarser levels
        p = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def points(ids: list[np.ndarray], p: Packing) -> np.ndarray:
    """Each document's hashed vector, projected and scaled to the grid."""
    g = np.random.default_rng(5)
    project = g.normal(size=(p.buckets, p.dims))
    v = np.zeros((len(ids), p.buckets))
    for i, x in enumerate(ids):
        h = x.astype(np.uint32) * np.uint32(2654435761)
        v[i] = np.bincount(h >> np.uint32(23) if p.buckets == 512 else h % np.uint32(p.buckets), minlength=p.buckets)
    v = np.log1p(v)
    v /= np.maximum(np.sqrt((v**2).sum(1, keepdims=True)), 1e-9)
    at = 1 / (1 + np.exp(-3 * (v @ project)))
    return np.minimum((at * 2**p.bits).astype(np.int64), 2**p.bits - 1)


CODED = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
PLACED = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "hilbert_key")])


def coded(docs: DataFrame, p: Packing) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(p)
        for whole in batches:
            for at in range(0, len(whole), 2000):
                b = whole.slice(at, 2000)
                data = [enc.encode(t) for t in b.column("text").to_pylist()]
                ids = [np.frombuffer(x, enc.dtype) for x in data]
                key = hilbert(points(ids, p), p.bits) if ids else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(key, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(data, pa.binary())], schema=CODED)

    return docs.select("doc_id", "text").mapInArrow(run, from_arrow_schema(CODED))


def placed(rows: DataFrame) -> DataFrame:
    """Where each document of a sorted partition starts in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for b in batches:
            n = b.column("n").to_numpy()
            at = done + np.cumsum(n) - n
            done += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("doc_id"), b.column("key"), pa.array(at, pa.int64()), b.column("n"), b.column("ids")], schema=PLACED)

    return rows.withColumn("part", F.spark_partition_id()).select("part", "doc_id", "key", "n", "ids").mapInArrow(run, from_arrow_schema(PLACED))


def tail_cuts(total: int, size: int) -> list[int]:
    """Ends of the sequences of the last stretch: falling powers of two."""
    at, out = total - total % size, []
    while at < total:
        at += 1 << ((total - at).bit_length() - 1)
        out.append(at)
    return out


def cut(rows: DataFrame, total: int, p: Packing) -> DataFrame:
    """Pieces of documents that start at ``begin`` in the stream of ``total`` ids."""
    full, tail = total - total % p.size, tail_cuts(total, p.size)

    def sequence(pos: int) -> tuple[int, int, int]:
        """Number, first position and end of the sequence at ``pos``."""
        if pos < full:
            return pos // p.size, pos - pos % p.size, pos - pos % p.size + p.size
        i = next(i for i, e in enumerate(tail) if pos < e)
        return full // p.size + i, tail[i - 1] if i else full, tail[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, key, begin, n, data in zip(*(b.column(c).to_pylist() for c in ("doc_id", "key", "begin", "n", "ids"))):
                ids = np.frombuffer(data, f"<u{len(data) // n}").astype("<u4")
                start = 0
                while start < n:
                    number, first, end = sequence(begin + start)
                    length = min(n - start, end - begin - start)
                    out.append((doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes()), n, number, begin + start - first, key))
                    start += length
            cols = list(zip(*out)) or [[] for _ in PIECES]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=PIECES)

    return rows.mapInArrow(run, from_arrow_schema(PIECES))


def pack(docs: DataFrame, p: Packing = Packing()) -> DataFrame:
    """The pieces of all documents; see PIECES."""
    rows = materialise(coded(docs, p), "packing-coded")
    total = rows.agg(F.sum("n").alias("n")).first().n or 0
    parts = min(p.most_parts, max(8, -(-total // p.part)))
    tie = F.xxhash64("doc_id", "n", F.crc32("ids"))
    order = rows.withColumn("tie", tie).repartitionByRange(parts, "key", "tie").sortWithinPartitions("key", "tie", "doc_id")
    order = materialise(placed(order), "packing-placed")
    sums = order.groupBy("part").agg(F.sum("n").alias("ids_in"))
    before = F.coalesce(F.sum("ids_in").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begin = F.broadcast(sums.select("part", before.alias("before")))
    return cut(order.join(begin, "part").select("doc_id", "key", (F.col("before") + F.col("at")).alias("begin"), "n", "ids"), total, p)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


QUERIES = {"op9_packing": op9_packing}
ORACLE_SQL: dict[str, str] = {}
