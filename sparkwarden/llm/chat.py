"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

States are (role, first line of a turn or a later one).  A line is seen through
its speaker marker, whether it opens a row of the transcript, its length, its
last character and its shape.  Emission and transition probabilities come from
prior counts plus counts over the conversations with the smallest hash of
conv_id, ``Fit.conversations`` at most and their rows with turn below
``Fit.turns``.  Viterbi decoding then recovers the states; lines of one turn are
rendered with a role header and without their marker.

Rows are sorted by conversation, turn and text over the whole table and cut into
blocks of at most ``Fit.block`` rows and about ``Fit.chars`` characters, so that a
hot conv_id, or rows without conv_id and turn, spread over tasks.  Each block gives
the best score from any state before it to any state at its end, a scan over these
small tables (one row a block) fixes the states at the borders, and each block is
decoded between its two.  That is the Viterbi path of the whole conversation.

Nulls and odd input: a null text is one empty line; rows without turn come first;
rows of one turn are ordered by their first 64 characters, then by a hash of the
text; equal rows each give their lines; of paths with equal scores one is taken; a null conv_id is a conversation of its
own; the role column is read for training only and null roles are left out; very
long texts are read whole, each in one block; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import arrow_map, materialise, table

ROLES = ("system", "user", "assistant")
STATES = tuple((r, part) for r in ROLES for part in ("first", "later"))
MARKERS = {"system": "system instruction instructions sys", "user": "user human you q question customer person prompt", "assistant": "assistant ai bot a answer agent model response gpt"}
MARKER = re.compile(r"\s*(?:[#>*\[<|]{0,4}\s*(?:im_start\|>\s*|start_header_id\|>\s*)?)(" + "|".join(sorted((w for v in MARKERS.values() for w in v.split()), key=len, reverse=True)) + r")\s*(?:[:>|\]*]{1,6}(?:end_header_id\|>)?|$)\s*", re.I)
WHO = {w: r for r, v in MARKERS.items() for w in v.split()}


@dataclass(frozen=True)
class Fit:
    conversations: int = 4000
    turns: int = 64
    block: int = 4096  # rows decoded at once
    chars: int = 4_000_000  # beyond so many characters a block ends
    prior: float = 50.0  # weight of the prior counts


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


def marker(line: str) -> str:
    m = MARKER.match(line)
    return WHO[m[1].lower()] if m else "none"


def features(line: str, opens: bool) -> tuple[str, ...]:
    s = line.strip()
    shape = "empty" if not s else "list" if s[0] in "-*" or s[:1].isdigit() else "code" if line[:4] == "    " or s[:3] == "```" else "upper" if s[:1].isupper() else "plain"
    return f"m:{marker(line)}", f"o:{int(opens)}", f"l:{min(5, len(s).bit_length() // 2)}", f"e:{s[-1:] if s[-1:] in ('?', '.', ':') else ''}", f"s:{shape}"


VALUES = ("m:none", "m:system", "m:user", "m:assistant", "o:0", "o:1", *(f"l:{i}" for i in range(6)), "e:", "e:?", "e:.", "e::", "s:empty", "s:list", "s:code", "s:upper", "s:plain")


def prior(state: tuple[str, str], value: str) -> float:
    """Share of a feature value that is believed before any count."""
    role, part = state
    if value[:2] == "m:":
        if part == "later":
            return 0.997 if value == "m:none" else 0.001
        return 0.5 if value == f"m:{role}" else 0.495 if value == "m:none" else 0.0025
    if value[:2] == "o:":
        return {"first": {"o:1": 0.6, "o:0": 0.4}, "later": {"o:1": 0.05, "o:0": 0.95}}[part][value]
    return 1 / sum(v[:2] == value[:2] for v in VALUES)


TURN_AFTER = {"start": (0.3, 0.6, 0.1), "system": (0.02, 0.9, 0.08), "user": (0.02, 0.06, 0.92), "assistant": (0.02, 0.93, 0.05)}


@dataclass(frozen=True)
class Model:
    emit: dict[str, tuple[float, ...]]  # feature value -> log probability by state
    move: tuple[tuple[float, ...], ...]  # by state before; the last row is the start

    def scores(self, lines: list[tuple[str, bool]]) -> np.ndarray:
        table = {k: np.array(v) for k, v in self.emit.items()}
        return np.array([sum(table[v] for v in features(x, o)) for x, o in lines])


def learn(conversations: DataFrame, f: Fit) -> Model:
    labelled = conversations.where("conv_id is not null").where(F.col("turn").isNull() | (F.col("turn") < f.turns)).where(F.col("role").isin(*ROLES))
    picked = labelled.select("conv_id").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(f.conversations)
    sample = labelled.join(F.broadcast(picked), "conv_id").select("conv_id", "turn", "role", "text")
    schema = pa.schema([("state", pa.int32()), ("value", pa.string()), ("n", pa.int64())])

    def rows(b: dict[str, list]) -> dict[str, list]:
        n: dict[tuple[int, str], int] = {}
        for role, text in zip(b["role"], b["text"]):
            for i, line in enumerate(lines_of(text)):
                k = STATES.index((role, "later" if i else "first"))
                for v in (*features(line, i == 0), "lines"):
                    n[k, v] = n.get((k, v), 0) + 1
        return {"state": [k for k, _ in n], "value": [v for _, v in n], "n": list(n.values())}

    seen = {(r.state, r.value): r.n for r in arrow_map(sample, rows, schema).groupBy("state", "value").agg(F.sum("n").alias("n")).collect()}
    emit = {}
    for v in VALUES:
        emit[v] = tuple(float(np.log((f.prior * prior(s, v) + seen.get((k, v), 0)) / (f.prior + seen.get((k, "lines"), 0)))) for k, s in enumerate(STATES))
    # markers keep their prior share: transcripts may have them where the labelled sample has none
    emit |= {v: tuple(float(np.log(prior(s, v))) for s in STATES) for v in VALUES if v[:2] == "m:"}
    nxt = sample.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("after")).distinct()
    pairs = {(r.role, r.after): r.n for r in sample.select("conv_id", "turn", "role").distinct().join(nxt, ["conv_id", "turn"]).groupBy("role", "after").agg(F.count("*").alias("n")).collect()}
    pairs |= {("start", r.role): r.n for r in sample.where("turn = 0").groupBy("role").agg(F.count("*").alias("n")).collect()}
    move = np.full((len(STATES) + 1, len(STATES)), -1e9)
    for before in ("start", *ROLES):
        share = np.array([f.prior * p + pairs.get((before, r), 0) for p, r in zip(TURN_AFTER[before], ROLES)])
        share = np.log(share / share.sum())
        for k, (r, part) in enumerate(STATES):
            for i, (b, _) in enumerate((*STATES, ("start", ""))):
                if b == before and part == "first":
                    move[i, k] = share[ROLES.index(r)] + (0.0 if b == "start" else np.log(0.2))
                elif b == before == r and part == "later":
                    move[i, k] = np.log(0.8)
    return Model(emit, tuple(map(tuple, move.tolist())))


def transfer(e: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best score from each state before (and the start) to each state at the last line."""
    best = move + e[0]
    for x in e[1:]:
        best = (best[:, :, None] + move[None, :-1, :]).max(1) + x
    return best


def path(e: np.ndarray, move: np.ndarray, before: int, last: int) -> list[int]:
    """States of the lines between the state ``before`` and the state ``last`` at the end."""
    best, back = move[before] + e[0], []
    for x in e[1:]:
        s = best[:, None] + move[:-1]
        back.append(s.argmax(0))
        best = s.max(0) + x
    out = [last]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def lines_in_order(t: pa.Table) -> list[tuple[int | None, int, str, bool]]:
    """``turn, line number in its row, line, opens`` in transcript order."""
    t = t.sort_by("seq")
    return [(turn, i, x, i == 0) for turn, text in zip(t.column("turn").to_pylist(), t.column("text").to_pylist()) for i, x in enumerate(lines_of(text))]


ROWS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("text", pa.string()), ("block", pa.int64()), ("seq", pa.int64())])


def in_blocks(conversations: DataFrame, f: Fit) -> DataFrame:
    """Rows in transcript order, numbered, with blocks that follow each other in that order."""
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("text", F.lit("")).alias("text"))
    keys = [F.col("conv_id"), F.col("turn"), F.substring("text", 1, 64), F.xxhash64("text")]
    rows = rows.repartitionByRange(*keys, F.monotonically_increasing_id()).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows_in, chars, seq = 0, 0, 0, 0
        for b in batches:
            blocks = []
            for n in pc.utf8_length(b.column("text")).to_pylist():
                if rows_in and (rows_in >= f.block or chars + n > f.chars):
                    block, rows_in, chars = block + 1, 0, 0
                rows_in, chars = rows_in + 1, chars + n
                blocks.append(block)
            part = b.column("part").to_numpy().astype(np.int64) << 33
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ROWS.names[:3]), pa.array(part + blocks, pa.int64()), pa.array(part + np.arange(seq, seq + len(b)), pa.int64())], schema=ROWS)
            seq += len(b)

    return materialise(rows.withColumn("part", F.spark_partition_id()).mapInArrow(run, from_arrow_schema(ROWS)), "chat-rows")


def render(role: str, lines: list[str], begins: bool) -> str:
    """A turn, or the rest of one: header, body without marker, end mark left to the next header."""
    if begins:
        m = MARKER.match(lines[0])
        lines = [lines[0][m.end() :] if m else lines[0], *lines[1:]]
    return (f"<|{role}|>\n" if begins else "") + "\n".join(lines)


BORDER = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("best", pa.list_(pa.float64()))])
ENDS = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("before", pa.int32()), ("last", pa.int32())])
TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("segment", pa.int64()), ("role", pa.string()), ("begins", pa.bool_()), ("n_lines", pa.int64()), ("rendered", pa.string())])


def format_turns(conversations: DataFrame, model: Model, f: Fit = Fit()) -> DataFrame:
    """``conv_id, turn, segment, role, begins, n_lines, rendered``: runs of lines of one recovered turn in each row."""
    S = len(STATES)
    rows = in_blocks(conversations, f)

    def border(key: tuple, t: pa.Table) -> pa.Table:
        e = model.scores([(x, o) for _, _, x, o in lines_in_order(t)])
        best = transfer(e, np.array(model.move))
        return pa.Table.from_arrays([pa.array([k.as_py()], pa.int64()) for k in key] + [pa.array([best.ravel()], BORDER.field("best").type)], schema=BORDER)

    def scan(key: tuple, t: pa.Table) -> pa.Table:
        got = sorted(zip(t.column("block").to_pylist(), t.column("best").to_pylist()))
        score, back = None, []
        for _, m in got:
            m = np.array(m).reshape(S + 1, S)
            if score is None:
                score = m[S]
            else:
                s = score[:, None] + m[:S]
                back.append(s.argmax(0))
                score = s.max(0)
        last = [int(score.argmax())]
        for b in reversed(back):
            last.append(int(b[last[-1]]))
        last = last[::-1]
        n = len(got)
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * n, pa.int64()), pa.array([b for b, _ in got], pa.int64()), pa.array([S, *last[:-1]], pa.int32()), pa.array(last, pa.int32())], schema=ENDS)

    def decode(key: tuple, t: pa.Table) -> pa.Table:
        lines = lines_in_order(t)
        move = np.array(model.move)
        states = path(model.scores([(x, o) for _, _, x, o in lines]), move, t.column("before")[0].as_py(), t.column("last")[0].as_py())
        out: list[list] = []
        for (turn, i, x, _), k in zip(lines, states):
            role, part = STATES[k]
            if i and part == "later":
                out[-1][5].append(x)
            else:
                segment = out[-1][2] + 1 if i else 0
                out.append([key[0].as_py(), turn, segment, role, part == "first", [x]])
        cols = list(zip(*((c, t, s, r, b, len(x), render(r, x, b)) for c, t, s, r, b, x in out)))
        return pa.Table.from_arrays([pa.array(c, g.type) for c, g in zip(cols, TURNS)], schema=TURNS)

    ends = rows.groupBy("conv_id", "block").applyInArrow(border, from_arrow_schema(BORDER)).groupBy("conv_id").applyInArrow(scan, from_arrow_schema(ENDS))
    ends = materialise(ends, "chat-ends").select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "before", "last")
    both = rows.join(ends, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))).drop("_c", "_b")
    return both.groupBy("conv_id", "block").applyInArrow(decode, from_arrow_schema(TURNS))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return format_turns(rows, learn(rows, Fit()))


QUERIES = {"op6_chat_formatting": op6_chat_formatting}
ORACLE_SQL: dict[str, str] = {}
