"""Token counts: offset-mapped attribution of a document's tokens to its sections.

The whole document is encoded once.  Byte lengths of the tokens give their
spans; an interval join of the sorted token starts with the section starts counts
the tokens of each section.  A token that crosses a section's end is allocated by
rule: ``first`` to the section of its first byte, ``last`` to that of its last
byte, ``share`` to each by bytes.

Sections are the lines of a text, each with its line end, or the fields of a row
joined by a blank line.

Nulls and odd input: a null or empty text is one empty section without tokens;
very long texts are encoded whole, in memory of their own size; a token that ends
just where a section ends does not cross; a null doc_id is kept; repeated rows give
repeated rows; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import table


@dataclass(frozen=True)
class Attribution:
    ranks: str | None = None  # a .tiktoken file; None: the public byte_bpe_50k.tiktoken of each machine
    rule: str = "first"


class Encoder:
    def __init__(self, p: Attribution):
        import public_tokenizers
        import tiktoken

        with open(p.ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("sections", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First byte and byte after the last of each token."""
        ends = np.cumsum(self.lengths[np.array(self.encoding.encode_ordinary(text), np.int64)])
        return np.concatenate((np.zeros(1, np.int64), ends))[:-1], ends


@lru_cache(2)
def encoder(p: Attribution) -> Encoder:
    """One of a process."""
    return Encoder(p)


def allocate(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section ``bounds[k]..bounds[k + 1]`` and how many of those that start there cross its end."""
    n = len(bounds) - 1
    at = np.searchsorted(starts, bounds, "left")
    at[-1] = len(starts)
    first = np.diff(at).astype(float)
    owner = np.repeat(np.arange(n), first.astype(np.int64))
    over = np.flatnonzero(ends > bounds[1:][owner]) if len(owner) else np.zeros(0, np.int64)
    crossing = np.bincount(owner[over], minlength=n) if n else np.zeros(0, np.int64)
    if rule != "first":
        for i in over:
            first[owner[i]] -= 1
            if rule == "last":
                first[np.searchsorted(bounds, ends[i], "left") - 1] += 1
            else:
                for k in range(owner[i], n):
                    part = min(ends[i], bounds[k + 1]) - max(starts[i], bounds[k])
                    if part <= 0 and bounds[k] >= ends[i]:
                        break
                    first[k] += max(part, 0) / (ends[i] - starts[i])
    return first, crossing


OUT = pa.schema([(c, pa.int64()) for c in ("doc_id", "section", "start", "end")] + [("n_tokens", pa.float64()), ("n_crossing", pa.int64()), ("doc_tokens", pa.int64())])


def count(docs: DataFrame, p: Attribution = Attribution()) -> DataFrame:
    """``doc_id, section, start, end, n_tokens, n_crossing, doc_tokens`` from ``doc_id, parts``; code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(p)
        for whole in batches:
            for at in range(0, len(whole), 1000):
                b = whole.slice(at, 1000)
                cols: list[list[np.ndarray]] = [[] for _ in OUT]
                ids: list[int | None] = []
                for doc_id, parts in zip(b.column("doc_id").to_pylist(), b.column("parts").to_pylist()):
                    parts = [x or "" for x in parts]
                    starts, ends = enc.spans("".join(parts))
                    size = np.array([len(x) for x in parts])
                    bounds = np.cumsum([0] + [len(x.encode("utf-8", "surrogatepass")) for x in parts])
                    tokens, crossing = allocate(starts, ends, bounds, p.rule)
                    end = np.cumsum(size)
                    ids += [doc_id] * len(parts)
                    for c, v in zip(cols[1:], (np.arange(len(parts)), end - size, end, tokens, crossing, np.full(len(parts), len(starts)))):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(cols[1:], list(OUT)[1:]))], schema=OUT)

    return docs.select("doc_id", "parts").mapInArrow(run, from_arrow_schema(OUT))


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id, parts``: lines with their ends; a text that ends with a line end has no line after it."""
    text = F.coalesce("text", F.lit(""))
    parts = F.split(text, "(?<=\n)")
    kept = F.filter(parts, lambda x: x != "")
    return docs.select("doc_id", F.when(F.size(kept) == 0, F.array(F.lit(""))).otherwise(kept).alias("parts"))


def fields(rows: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    """``doc_id, parts``: the named columns in order, a blank line after all but the last."""
    parts = [F.concat(F.coalesce(F.col(n).cast("string"), F.lit("")), F.lit("\n\n" if i < len(names) - 1 else "")) for i, n in enumerate(names)]
    return rows.select(F.col(key).alias("doc_id"), F.array(*parts).alias("parts"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(lines(table(spark, sf_dir, "documents"))).withColumn("n_tokens", F.col("n_tokens").cast("long"))


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLE_SQL: dict[str, str] = {}
