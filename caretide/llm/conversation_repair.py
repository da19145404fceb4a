"""Repair of the turn structure of conversations: faults are marked by Spark, cells of the repair grammar are filled along
globally sorted rows, so that a conversation of any length is spread over tasks.

Rows are sorted by conversation and turn over all partitions. A task walks its rows once and makes a segment of every
conversation in it, or several where a conversation is long; a segment holds its counts and the chart cells of its span.
A conversation that is one segment, and neither the first nor the last one of its task, is settled there. For the others the
cells of all segments are combined, without texts; the audit is cut at the segments again, each repairs its own turns, and
the digest runs over them in order, one segment in memory at a time.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from caretide.llm import repair_grammar as grammar
from caretide.llm.common import stored

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: Rows and bytes of text after which a long conversation gets its next segment.
ROWS, BYTES = 4096, 1 << 20
#: Characters of a text that take part in dealing rows to tasks; within a task the whole text decides.
PREFIX = 32
#: Pairs of role initials that may follow each other.
LEGAL = ("su", "ua", "au")
SEPARATOR = "\n"
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def marked(turns: DataFrame, conv_id: str, turn: str, role: str, text: str, copies: Column | None = None, gone: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text, copies, gone and fault: of a row that is repeated ``copies`` times, the first one's fault.

    ``gone`` rows only keep their conversation in the result. A duplicate has the role and text of an earlier turn; among
    rows of one turn, what follows an equal row is marked later, where rows are sorted.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        (F.lit(1) if copies is None else copies).cast("int").alias("copies"),
        F.coalesce(F.lit(False) if gone is None else gone, F.lit(False)).alias("gone"),
    )
    h = [F.xxhash64("text").alias("h1"), F.hash("text").alias("h2")]
    spoken = rows.filter(~F.col("gone") & ~is_blank(F.col("text"))).select("conv_id", "turn", "role", *h)
    # a null turn comes first; a group of one turn alone has no earlier one
    first = spoken.groupBy("conv_id", "role", "h1", "h2").agg(F.min("turn").alias("least"), F.max("turn").alias("most"), (F.count("*") > F.count("turn")).alias("unnumbered"))
    first = first.filter((F.col("least") < F.col("most")) | F.col("unnumbered") & F.col("least").isNotNull())
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), "h1", "h2", "least", "unnumbered")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("t1") == F.col("h1")) & (F.col("t2") == F.col("h2"))
    hashed = rows.withColumns({"t1": F.xxhash64("text"), "t2": F.hash("text")})
    earlier = F.when(F.col("unnumbered"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("least"))
    fault = (
        F.when(is_blank(F.col("text")), BLANK)
        .when(F.coalesce(earlier, F.lit(False)), DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED)
        .otherwise(0)
    )
    return hashed.join(first, same, "left").select(*rows.columns, fault.alias("fault"))


def _summary(conv_type: str, turn_type: str) -> str:
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return f"conv_id {conv_type}, n long, first string, last string, least {turn_type}, most {turn_type}, turns long, {counts}"


class _Segment:
    """Counts, span and rows of consecutive turns of one conversation."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id, self.rows, self.symbols, self.bytes = conv_id, [], [], 0
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.least = self.most = None
        self.turns = 0

    def add(self, turn: object, role: str, text: str, fault: int, copies: int) -> None:
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        for k in range(copies):
            own = DUPLICATE if k and fault != BLANK else fault
            if own:
                self.counts[_COUNTS[own - 1]] += 1
            if self.rows and self.rows[-1][0][:1] + role[:1] not in LEGAL:
                self.counts["illegal"] += 1
            kind = grammar.GONE if own in (BLANK, DUPLICATE) else grammar.CUT if own == TRUNCATED else grammar.FINE
            self.rows.append((role, text))
            self.symbols.append(grammar.symbol(role[:1], kind))
            self.bytes += len(text) + 1

    def cells(self) -> grammar.Cells:
        chart = grammar.Chart()
        chart.add_turns("".join(self.symbols))
        return chart.cells()

    def summary(self) -> dict:
        ends = {"first": self.rows[0][0][:1], "last": self.rows[-1][0][:1]} if self.rows else {"first": None, "last": None}
        return {"conv_id": self.conv_id, "n": len(self.rows), **ends, "least": self.least, "most": self.most, "turns": self.turns, **self.counts}


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Segment, int, bool]]:
    """(segment, its number in this task, whether its conversation cannot go on elsewhere) along sorted rows."""
    current, number, first, cut = None, 0, True, False
    before = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "gone", "fault")]
        for conv, turn, role, text, copies, gone, fault in zip(*columns, strict=True):
            if current is None or conv != current.conv_id:
                if current is not None:
                    yield current, number, not (first or cut)
                    number, first, cut = number + 1, False, False
                current, before = _Segment(conv), None
            elif len(current.rows) >= ROWS or current.bytes >= BYTES:
                yield current, number, False
                current, number, cut = _Segment(conv), number + 1, True
            if gone:
                continue
            key = (turn, role, text)
            # equal rows of one turn stand side by side: all but the first one repeat it
            current.add(turn, role, text, DUPLICATE if key == before and fault != BLANK else fault, copies)
            before = key
    if current is not None:
        yield current, number, False


def _digest(rows: list[tuple[str, str]]) -> str:
    return hashlib.sha256(SEPARATOR.join(f"{role}:{text}" for role, text in rows).encode()).hexdigest()


def _gaps(s: dict) -> int:
    return 0 if s["most"] is None else s["most"] - s["least"] + 1 - s["turns"]


def segments(rows: DataFrame) -> DataFrame:
    """The segments of sorted rows; ``audit`` and ``sha`` are set where the conversation is settled."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = _summary(types["conv_id"], types["turn"]) + (
        ", part int, number long, cost long, audit string, sha string, initials string, cells array<struct<cost: long, audit: string>>, rows array<struct<role: string, text: string>>"
    )
    # rows alike in these columns stay in one partition, and partitions follow each other in order
    dealt = rows.withColumn("prefix", F.substring("text", 1, PREFIX))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartitionByRange(n, "conv_id", "turn", "role", "prefix").drop("prefix")
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), []
        held = 0
        for segment, number, whole in _segments(batches):
            row = segment.summary() | {"part": part, "number": number, "cost": None, "audit": None, "sha": None, "initials": None, "cells": None, "rows": None}
            cells = segment.cells()
            if whole:
                row["cost"], row["audit"] = grammar.best(cells)
                row["sha"] = _digest(grammar.replayed(row["audit"], segment.rows, grammar.FIRST)[0])
            else:
                row["cells"] = [None if c is None else {"cost": c[0], "audit": c[1]} for c in cells]
                row["initials"] = "".join(r[:1] if r[:1] in ("s", "u", "a") else "-" for r, _ in segment.rows)
                row["rows"] = [{"role": r, "text": t} for r, t in segment.rows]
                held += segment.bytes
            out.append(row)
            if len(out) >= 5000 or held >= 8 * BYTES:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return dealt.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(walk, schema)


def combined(spans: DataFrame) -> DataFrame:
    """One row per segment of conversations of several segments: its part of the audit and the state before it, and on the
    first one what holds for the whole conversation. Texts take no part; a group is the cells of one conversation, so it
    grows with the audit, which is one value of the result anyway."""
    conv_type = spans.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv_type}, part int, number long, slice string, state int, head boolean, gaps long, cost long, audit string, " + ", ".join(
        f"{c} long" for c in _COUNTS
    )
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def combine(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["part"], r["number"]))
        chart, whole, last = grammar.Chart(), dict.fromkeys(_COUNTS, 0) | {"least": None, "most": None, "turns": 0}, None
        for r in rows:
            chart.add(tuple(None if c is None else (c["cost"], c["audit"]) for c in r["cells"]))
            for c in _COUNTS:
                whole[c] += r[c]
            if r["most"] is not None:
                # a turn may go on in the next segment
                whole["turns"] += r["turns"] - (r["least"] == whole["most"])
                whole["least"], whole["most"] = r["least"] if whole["least"] is None else whole["least"], r["most"]
            if r["n"]:
                whole["illegal"] += last is not None and last + r["first"] not in LEGAL
                last = r["last"]
        cost, audit = grammar.best(chart.cells())
        out, at, state = [], 0, grammar.FIRST
        for k, r in enumerate(rows):
            start, left = at, r["n"]
            while at < len(audit) and (left or k == len(rows) - 1):
                left -= audit[at] != "I"
                at += 1
            head = {"gaps": _gaps(whole), "cost": cost, "audit": audit} | {c: whole[c] for c in _COUNTS} if k == 0 else {}
            out.append({"conv_id": r["conv_id"], "part": r["part"], "number": r["number"], "slice": audit[start:at], "state": state, "head": k == 0} | head)
            state = grammar.replayed(audit[start:at], [(i, "") for i in r["initials"]], state)[1]
        return pa.Table.from_pylist(out, schema=arrow)

    return spans.groupBy("conv_id").applyInArrow(combine, schema)


def digested(slices: DataFrame) -> DataFrame:
    """The result rows of conversations of several segments. A digest runs over its conversation in order, so the segments
    of one follow each other in a task, one in memory at a time."""
    result = _result(slices.schema["conv_id"].dataType.simpleString())
    arrow = to_arrow_schema(StructType.fromDDL(result))
    fields = ["gaps", "cost", "audit", *_COUNTS]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, digest, empty = None, None, True
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                r = {name: batch.column(name)[k].as_py() for name in ("head", "slice", "state", "rows")}
                if r["head"]:
                    if row is not None:
                        out.append(row | {"repaired_sha256": digest.hexdigest()})
                    row = {c: batch.column(c)[k].as_py() for c in ("conv_id", *fields)}
                    digest, empty = hashlib.sha256(), True
                for role, text in grammar.replayed(r["slice"], [(x["role"], x["text"]) for x in r["rows"]], r["state"])[0]:
                    digest.update((("" if empty else SEPARATOR) + f"{role}:{text}").encode())
                    empty = False
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if row is not None:
            yield pa.RecordBatch.from_pylist([row | {"repaired_sha256": digest.hexdigest()}], schema=arrow)

    return slices.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number").mapInArrow(fold, result)


def _result(conv_type: str) -> str:
    return f"conv_id {conv_type}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None, gone: Column | None = None
) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    ``copies`` and ``gone`` say how often a row stands in its conversation, side by side, and whether it stands there at all.
    Rows are taken by turn, null ones first; rows of one turn by role and text. Null role or text: one space. Null
    conv_id: a conversation of its own. A conversation without rows: zeros, an empty audit and the digest of nothing.
    Roles other than system, user and assistant keep their first letter as initial; one that fits no place is rerolled or
    deleted. Repeated rows are duplicates. Equality of texts in different turns rests on 96 bits of hashes. Empty table:
    no rows. Other columns are not read.
    """
    found = stored(segments(marked(turns, conv_id, turn, role, text, copies, gone)), "repair-segments")
    settled = found.filter("sha is not null")
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0)).cast("long")
    settled = settled.select("conv_id", gaps.alias("gaps"), *_COUNTS, "cost", "audit", F.col("sha").alias("repaired_sha256"))
    rest = found.filter("sha is null")
    slices = stored(combined(rest.drop("rows")), "repair-slices")
    parts = rest.select("part", "number", "rows").join(slices, ["part", "number"])
    return settled.unionByName(digested(parts))
