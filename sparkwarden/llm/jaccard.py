"""N-gram Jaccard join: grouped prefix join over word shingles, exact at its threshold.

1. One pass makes each document's distinct shingles (64-bit hashes); documents
   with equal sets are one class, stood for by the smallest doc_id.
2. Shingles are counted over all classes.  Rows shuffled are compact blocks of
   32-bit remainders by hash partition, a task for each; only shingles of two or
   more classes come back.  Beyond ``slice`` classes a partition's blocks are dealt
   in slices of the classes, counted apart and then together, so that a shingle of
   every document takes a bounded part of any task.  A class whose shingles of its own fill its prefix can link with
   nothing and ends here; the others take their rarest shared shingles.
3. Classes with the same prefix and size form a group.  Group pairs that share a
   prefix shingle pass the size and position filters and expand to members, whose
   sets are compared in full.
4. In each shingle's list all members are first compared with one hub, the group
   in which the shingle stands earliest.  Then only pairs of members whose
   components still differ are compared, so that no link between components is
   lost and large families of near copies are never paired off in full.  These
   pairs are joined by shingle and range of size, long lists in pieces.

Remainders may collide: that adds candidates, never a link, as sets are compared
by their 64-bit hashes.  Nothing is broadcast but a filter of fixed size.

Nulls and odd input: a null or blank text has no shingles and links with
nothing; very long texts are read whole, their sets held one at a time; of rows
that tie for a component's id the smallest doc_id names it; a text of fewer words than a shingle is one shingle; a row without
doc_id has a null component; repeated rows link with each other; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import connected_components, materialise, table, tidy


@dataclass(frozen=True)
class Join:
    words: int = 4  # of a shingle
    percent: int = 85  # least 100 * intersection / union
    block: int = 6_000_000  # shingles counted in one task
    least_blocks: int = 24
    slice: int = 5_000_000  # classes whose shingles are counted together
    piece: int = 4096  # groups of a shingle's list that are joined in one task
    filter_bits: int = 24  # log2 of the size of the filter of candidate ids

    @property
    def smallest(self) -> int:
        """Smallest set that can link with another one: n / (n + 1) >= percent."""
        return next(n for n in range(1, 10_000) if 100 * n >= self.percent * (n + 1)) if self.percent < 100 else 2**31

    def prefix(self, n: int) -> int:
        return n - (self.percent * n + 99) // 100 + 1


M1, M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * M1
    h = (h ^ (h >> np.uint64(27))) * M2
    return h ^ (h >> np.uint64(31))


class WordHash(dict):
    """Hash of a word, remembered for up to ``most`` words."""

    most = 400_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = h
        return h


def shingles(text: str | None, k: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the text's ``k``-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII blanks only
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(w):
        return w
    n = max(1, len(w) - k + 1)
    h = np.full(n, min(k, len(w)), np.uint64)
    for j in range(min(k, len(w))):
        h = h * M3 + w[j : j + n]
    return np.unique(mix(h))


def set_key(h: np.ndarray) -> tuple[int, int]:
    a, b = mix(h + M3), mix(h ^ M2)
    return int(a.sum().astype(np.int64)) if len(h) else 0, int(np.bitwise_xor.reduce(b).astype(np.int64)) if len(h) else 0


SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("c", pa.int64()), ("c2", pa.int64())])
BLOCK = pa.schema([("p", pa.int32()), ("s", pa.int32()), ("classes", pa.binary()), ("sizes", pa.binary()), ("tokens", pa.binary())])
SHARED = pa.schema([("c", pa.int64()), ("shared", pa.binary())])
PAIR = np.dtype([("count", "<u4"), ("token", "<u8")])
PREFIX = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("at", pa.int32()), ("tokens", pa.list_(pa.int64()))])


def document_sets(docs: DataFrame, p: Join) -> DataFrame:
    """``doc_id, n, c, c2``: set size and 128-bit key of the set, per row."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                h = shingles(text, p.words, hashes)
                out.append((len(h), *set_key(h)))
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols)], schema=SETS)

    return docs.select("doc_id", "text").mapInArrow(run, from_arrow_schema(SETS))


def shingle_blocks(docs: DataFrame, p: Join, parts: int, slices: int) -> DataFrame:
    """Remainders of all shingles, by hash partition, slice of the classes and batch; a class once a batch."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            seen: set[int] = set()
            keys, sets = [[] for _ in range(slices)], [[] for _ in range(slices)]
            for text in b.column("text").to_pylist():
                h = shingles(text, p.words, hashes)
                if len(h) >= p.smallest and (c := set_key(h)[0]) not in seen:
                    seen.add(c)
                    keys[c % slices].append(c)
                    sets[c % slices].append(h)
            rows = []
            for s in range(slices):
                if not keys[s]:
                    continue
                h = np.concatenate(sets[s])
                cls = np.repeat(np.arange(len(keys[s]), dtype=np.int32), [len(x) for x in sets[s]])
                part = (h % np.uint64(parts)).astype(np.int32)
                rest = (h // np.uint64(parts)).astype(np.uint32)
                order = np.argsort(part, kind="stable")
                ends = np.searchsorted(part[order], np.arange(parts + 1))
                all_keys = np.array(keys[s], np.int64)
                for i in range(parts):
                    at = order[ends[i] : ends[i + 1]]
                    if len(at):
                        own, size = np.unique(cls[at], return_counts=True)  # cls ascends within a part
                        rows.append((i, s, all_keys[own].tobytes(), size.astype(np.uint32).tobytes(), rest[at].tobytes()))
            if not rows:
                continue
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), BLOCK.types)], schema=BLOCK)

    return docs.select("text").mapInArrow(run, from_arrow_schema(BLOCK))


def gathered(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of some blocks, the class number of each shingle and the shingles; a class met in several batches counts once."""
    cls, size, tok = (np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()]) for c, kind in (("classes", np.int64), ("sizes", np.uint32), ("tokens", np.uint32)))
    names, first, number = np.unique(cls, return_index=True, return_inverse=True)
    keep = np.zeros(len(cls), bool)
    keep[first] = True
    own, keep = np.repeat(number.astype(np.int32), size), np.repeat(keep, size)
    return names, own[keep], tok[keep]


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values starts, and its length."""
    start = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(ordered)))


def by_class(names: np.ndarray, own: np.ndarray, tok: np.ndarray, count: np.ndarray, p: int, parts: int) -> pa.Table:
    """A row a class: its shared shingles with their counts."""
    out = np.empty(len(tok), PAIR)
    order = np.argsort(own, kind="stable")
    out["count"], out["token"] = count[order], tok[order].astype(np.uint64) * np.uint64(parts) + np.uint64(p)
    own = own[order]
    start, size = runs(own)
    data, w = out.tobytes(), PAIR.itemsize
    return pa.Table.from_arrays([pa.array(names[own[start]], pa.int64()), pa.array([data[a * w : (a + n) * w] for a, n in zip(start.tolist(), size.tolist())], pa.binary())], schema=SHARED)


def count_shared(key: tuple, t: pa.Table, parts: int) -> pa.Table:
    """Of one hash partition: each class's shingles that another class has too, with their counts."""
    names, own, tok = gathered(t)
    order = np.argsort(tok, kind="stable")
    tok, own = tok[order], own[order]
    count = runs(tok)[1]
    count = np.repeat(count, count)
    several = count > 1
    return by_class(names, own[several], tok[several], count[several], key[0].as_py(), parts)


COUNTED = pa.schema([("p", pa.int32()), ("tokens", pa.binary()), ("counts", pa.binary())])


def count_slice(key: tuple, t: pa.Table) -> pa.Table:
    """Distinct shingles of one slice and how many of its classes have each."""
    tok = np.sort(gathered(t)[2])
    start, count = runs(tok)
    return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([tok[start].tobytes()], pa.binary()), pa.array([count.astype(np.uint32).tobytes()], pa.binary())], schema=COUNTED)


def add_slices(key: tuple, t: pa.Table) -> pa.Table:
    """Shingles of two or more classes over all slices, ascending, and their counts."""
    tok, n = (np.concatenate([np.frombuffer(x, np.uint32) for x in t.column(c).to_pylist()]) for c in ("tokens", "counts"))
    order = np.argsort(tok, kind="stable")
    tok, n = tok[order], n[order].astype(np.int64)
    start, _ = runs(tok)
    total = np.add.reduceat(n, start) if len(start) else n
    several = total > 1
    return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([tok[start][several].tobytes()], pa.binary()), pa.array([np.minimum(total[several], 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], schema=COUNTED)


def shared_of_slice(key: tuple, t: pa.Table, counted: pa.Table, parts: int) -> pa.Table:
    """As ``count_shared``, for one slice and the counts over all of them."""
    if not len(t):
        return SHARED.empty_table()
    names, own, tok = gathered(t)
    every, n = (np.frombuffer(counted.column(c)[0].as_py(), np.uint32) for c in ("tokens", "counts"))
    at = np.minimum(np.searchsorted(every, tok), max(0, len(every) - 1))
    several = every[at] == tok if len(every) else np.zeros(len(tok), bool)
    return by_class(names, own[several], tok[several], n[at[several]], key[0].as_py(), parts)


SPARE = 4  # tasks a block: more than there are blocks, so that few blocks meet in one task by their hash


def shared_shingles(docs: DataFrame, p: Join, total: int, classes: int) -> DataFrame:
    """``c, shared``: the shingles of each class that another class has too; a class has a row a hash partition."""
    parts, slices = max(p.least_blocks, -(-total // p.block)), max(1, -(-classes // p.slice))
    blocks = shingle_blocks(docs, p, parts, slices)
    if slices == 1:
        return blocks.repartition(SPARE * parts, "p").groupBy("p").applyInArrow(lambda key, t: count_shared(key, t, parts), from_arrow_schema(SHARED))
    blocks = materialise(blocks, "jaccard-blocks").repartition(SPARE * parts * slices, "p", "s")
    counted = blocks.groupBy("p", "s").applyInArrow(count_slice, from_arrow_schema(COUNTED)).repartition(parts, "p").groupBy("p").applyInArrow(add_slices, from_arrow_schema(COUNTED))
    counted = materialise(counted, "jaccard-counted").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<int>"))).repartition(SPARE * parts * slices, "p", "s")
    return blocks.groupBy("p", "s").cogroup(counted.groupBy("p", "s")).applyInArrow(lambda key, a, b: shared_of_slice(key, a, b, parts), from_arrow_schema(SHARED))


def prefixes(classes: DataFrame, shared: DataFrame, p: Join) -> DataFrame:
    """``rep, n, key, at, tokens``: shared shingles in a class's prefix, the first of them at position ``at``."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for rep, n, blobs in zip(*(b.column(c).to_pylist() for c in ("rep", "n", "blobs"))):
                s = np.frombuffer(b"".join(blobs), PAIR)
                alone, length = n - len(s), p.prefix(n)
                if alone < length:
                    t = s["token"][np.lexsort((s["token"], s["count"]))][: length - alone].astype(np.int64)
                    key = set_key(t.astype(np.uint64))[0] if alone == 0 else rep  # a shingle of its own sets a class apart
                    rows.append((rep, n, key, alone, t))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(PREFIX)], schema=PREFIX)

    every = shared.groupBy("c").agg(F.collect_list("shared").alias("blobs"))
    return classes.select("c", "rep", "n").join(every, "c").select("rep", "n", "blobs").mapInArrow(run, from_arrow_schema(PREFIX))


def id_filter(ids: DataFrame, bits: int) -> bytes:
    """Bits of the ids' hashes: ``2**bits / 8`` bytes however many ids there are."""
    col = ids.columns[0]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(2**bits, bool)
        for b in batches:
            seen[slot(b.column(0).to_numpy(zero_copy_only=False), bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(seen).tobytes(), 1)], pa.binary())], names=["bits"])

    total = np.zeros(2**bits // 8, np.uint8)
    for r in ids.select(col).coalesce(8).mapInArrow(run, "bits binary").collect():
        total |= np.frombuffer(zlib.decompress(bytes(r.bits)), np.uint8)
    return total.tobytes()


def slot(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def candidate_sets(docs: DataFrame, wanted: DataFrame, p: Join) -> DataFrame:
    """``rep, n, hashes`` of the classes ``wanted(rep, c)``; other texts are left out before they are cut up."""
    send = docs.sparkSession.sparkContext.broadcast(id_filter(wanted.select("rep"), p.filter_bits))
    schema = pa.schema([("doc_id", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = WordHash(), np.unpackbits(np.frombuffer(send.value, np.uint8))
        for b in batches:
            b = b.filter(b.column("doc_id").is_valid())
            ids = b.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
            b = b.filter(pa.array(bits[slot(ids, p.filter_bits)].astype(bool), pa.bool_()))
            sets = [shingles(t, p.words, hashes) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([set_key(h)[0] for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int64()), pa.array([h.view(np.int64) for h in sets], schema.field("hashes").type)], schema=schema)

    found = docs.select("doc_id", "text").mapInArrow(run, from_arrow_schema(schema))
    return found.join(wanted.select(F.col("rep").alias("doc_id"), "c"), ["doc_id", "c"], "left_semi").select(F.col("doc_id").alias("rep"), "n", "hashes").dropDuplicates(["rep"])


def may_link(p: Join, a: str, b: str) -> Column:
    """Size and position filters on ``n`` and ``pos`` of the sides: what can still be common must suffice."""
    left = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return ((100 + p.percent) * left >= p.percent * (F.col(f"{a}.n") + F.col(f"{b}.n"))) & (100 * small >= p.percent * large)


def verified(pairs: DataFrame, sets: DataFrame, p: Join) -> DataFrame:
    """Those of ``pairs(a, b)`` that link."""
    x = pairs.join(sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha")), "a")
    x = x.join(sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb")), "b")
    x = x.where(100 * F.least("na", "nb") >= p.percent * F.greatest("na", "nb")).withColumn("common", F.size(F.array_intersect("ha", "hb")))
    return x.where(100 * F.col("common") >= p.percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def link_classes(docs: DataFrame, classes: DataFrame, p: Join, total: int, number: int) -> DataFrame | None:
    """``node, root`` of the classes that link with another one."""
    shared = shared_shingles(docs, p, total, number)
    found = materialise(prefixes(classes.where(F.col("n") >= p.smallest), shared, p), "jaccard-prefixes")

    groups = found.groupBy("n", "key").agg(F.min("rep").alias("g"), F.count("*").alias("members"))
    members = found.select("rep", "n", "key").join(groups, ["n", "key"]).select("rep", "n", "g", "members")
    heads = found.join(groups.select(F.col("g").alias("rep")).distinct(), "rep", "left_semi")
    lists = heads.select(F.col("rep").alias("g"), "n", "at", F.posexplode("tokens").alias("i", "token")).select("token", "g", "n", (F.col("at") + F.col("i")).alias("pos"))
    hubs = lists.groupBy("token").agg(F.min(F.struct("pos", "n", "g")).alias("hub"), F.count("*").alias("m")).where("m > 1").drop("m")
    lists = materialise(lists.join(hubs, "token"), "jaccard-lists")
    members = materialise(members, "jaccard-members")
    open_groups = lists.select("g").union(members.where("members > 1").select("g")).distinct()
    wanted = members.join(open_groups, "g", "left_semi").select("rep").join(classes.select("rep", "c"), "rep")
    sets = materialise(candidate_sets(docs, materialise(wanted, "jaccard-wanted"), p), "jaccard-sets")

    # members against the head of their group, groups against the hub of each list
    inside = members.where("members > 1 and rep <> g").select(F.col("g").alias("a"), F.col("rep").alias("b"))
    to_hub = lists.alias("x").where("x.g <> x.hub.g").where(may_link(p, "x", "x.hub")).select(F.col("x.hub.g").alias("a"), F.col("x.g").alias("b"))
    edges = materialise(verified(to_hub.union(inside).distinct(), sets, p), "jaccard-links")
    roots = materialise(connected_components(edges, "jaccard"), "jaccard-roots")

    # what remains: pairs of members in different components
    placed = members.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    placed = materialise(placed.select("rep", "n", "g", "members", "root"), "jaccard-placed")
    whole = placed.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).select("g", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("side"))  # null: several
    lists = lists.select("token", "g", "n", "pos").join(whole, "g")
    per_side = lists.groupBy("token", "side").agg(F.count("*").alias("m"))
    main = per_side.groupBy("token").agg(F.max(F.struct(F.when(F.col("side").isNull(), 0).otherwise(F.col("m")).alias("k"), "side")).alias("top"), F.count("*").alias("sides"), F.count_if(F.col("side").isNull()).alias("mixed"), F.sum("m").alias("all"))
    pieces = F.greatest(F.ceil(F.col("all") / p.piece), F.lit(1)).cast("int")
    live = main.where("sides > 1 or mixed > 0").select("token", F.col("top.side").alias("top"), pieces.alias("pieces"))
    band = F.floor(F.log("n") / (-1.001 * math.log(min(p.percent, 99) / 100))).cast("int")  # sets of sizes two bands apart cannot link
    lists = materialise(lists.join(live, "token").withColumn("band", band).withColumn("piece", F.pmod(F.xxhash64("g"), F.col("pieces")).cast("int")), "jaccard-open")
    few = lists.where("side is null or top is null or side <> top")  # all but the largest component of the list
    few = few.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    x, y = few.alias("x"), lists.alias("y")
    differ = F.col("x.side").isNull() | F.col("y.side").isNull() | (F.col("x.side") != F.col("y.side"))
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("token", "band", "piece")]
    pairs = x.join(y, same[0] & same[1] & same[2] & (F.col("x.g") != F.col("y.g")) & differ & may_link(p, "x", "y"))
    pairs = pairs.select(F.least("x.g", "y.g").alias("a"), F.greatest("x.g", "y.g").alias("b")).union(placed.join(whole.where("side is null"), "g", "left_semi").where("members > 1").select(F.col("g").alias("a"), F.col("g").alias("b"))).distinct()
    one, two = placed.select(F.col("g").alias("a"), F.col("rep").alias("ra"), F.col("root").alias("oa")), placed.select(F.col("g").alias("b"), F.col("rep").alias("rb"), F.col("root").alias("ob"))
    apart = (F.col("oa") != F.col("ob")) & ((F.col("a") != F.col("b")) | (F.col("ra") < F.col("rb")))
    rest = pairs.join(one, "a").join(two, "b").where(apart).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    more = materialise(verified(rest, sets, p), "jaccard-more")
    if not more.limit(1).count():
        return roots
    return connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "jaccard-last")


def components(docs: DataFrame, p: Join = Join()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row."""
    each = materialise(document_sets(docs, p), "jaccard-documents")
    some = each.where("n > 0 and doc_id is not null")
    classes = materialise(some.groupBy("c", "c2", "n").agg(F.min("doc_id").alias("rep")), "jaccard-classes")
    size = classes.agg(F.sum("n").alias("n"), F.count("*").alias("classes")).first()
    roots = link_classes(docs, classes, p, size.n or 0, size.classes)
    classes = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("c", "c2", "n", F.coalesce("root", "rep").alias("component_id"))
    linked = some.join(classes, ["c", "c2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.union(each.where("n = 0 or doc_id is null").select("doc_id", "n", "doc_id"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component, once; rows without doc_id all stay.

    Where rows of one doc_id differ in text, each (doc_id, text) is a document of its own."""
    names = docs.columns
    keys = [F.xxhash64("text").alias("_h"), F.xxhash64(F.lit(1), F.col("text")).alias("_h2")]
    texts = materialise(docs.where("doc_id is not null").select("doc_id", *keys).distinct(), "jaccard-texts")
    if texts.groupBy("doc_id").count().where("count > 1").limit(1).count():
        # ids in the order of doc_id: the smallest node of a component has its smallest doc_id
        texts = materialise(texts.orderBy("doc_id", "_h", "_h2").withColumn("_node", F.monotonically_increasing_id()), "jaccard-nodes")
        marked = docs.select("*", *keys).join(texts, ["doc_id", "_h", "_h2"], "left")
        docs = materialise(marked.select(*names, "_node"), "jaccard-marked")
    else:
        docs = docs.withColumn("_node", F.col("doc_id"))
    lost = components(docs.select(F.col("_node").alias("doc_id"), "text")).where("component_id <> doc_id").select(F.col("doc_id").alias("_node")).distinct()
    left = docs.join(lost, "_node", "left_anti").withColumn("_row", F.when(F.col("_node").isNull(), F.monotonically_increasing_id()))
    return left.dropDuplicates(["_node", "_row"]).select(*names)


QUERIES = {"op8_ngram_jaccard": op8_ngram_jaccard}
ORACLE_SQL = {
    "op8_ngram_jaccard": """
    with recursive words as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
    sets as materialized (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) end as s from words),
    tok as materialized (select doc_id, len(s) as n, unnest(s) as t from sets),
    edges as materialized (select a.doc_id as a, b.doc_id as b from tok a join tok b on a.t = b.t and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    reach(doc_id, r) as (select doc_id, doc_id from sets union select reach.doc_id, edges.b from reach join edges on edges.a = reach.r)
    select sets.doc_id, len(s) as n_shingles, c.component_id from sets join (select doc_id, min(r) as component_id from reach group by doc_id) c on c.doc_id = sets.doc_id"""
}
