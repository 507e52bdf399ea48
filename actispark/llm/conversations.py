"""Conversations whose turns don't alternate, are blank, repeated or cut off: the cheapest repair of each.

A repaired conversation is empty, or an optional system turn and then pairs of a user's and an assistant's turn. Edits of
the rows in order: Keep (0), Rerole to user or assistant (2), Delete (3; a must for blank and repeated rows), Insert an empty
turn of user or assistant anywhere (2); a truncated row that isn't deleted adds 1. Of the cheapest edits the ones whose
initials come first in ASCII are taken; these fix the roles, as each initial leads to one state of the automaton.

One exchange deals rows by conversation. Inside a partition Spark sorts three times, spilling as it must: by text, where a
window finds repeats; by turn downwards, where mapInPandas carries the cost of finishing from each of the four states across
Arrow batches and writes the best choice of each state as two bits, a byte a row (the backpointers, which travel with their
rows through Spark's external sort, so a giant conversation spills); by turn upwards, where the choices are followed. No
step holds a conversation: state is four costs, or one automaton state, running counts, a hash and the audit's letters. One
conversation is one stream since the hash of its repaired rows is sequential.

Defined results: null roles and texts, and null parts of the damage's key, read as one space; rows of a null conv_id are one
conversation; null turns come first; rows of one turn go by role, then text; a repeated row is found wherever its like stands
earlier; further columns are ignored; gaps beyond a long are its maximum; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from actispark.llm.common import small_batches

SPACE = r"\x20\x09-\x0D"

#: States: nothing yet, after s, after u, after a (the end of a pair).
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: What an inserted or reroled turn of the needed role leads to; u except after u.
TURN = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
#: What a kept row leads to by its role's initial.
KEPT = {("s", START): AFTER_S, ("u", START): AFTER_U, ("u", AFTER_S): AFTER_U, ("u", AFTER_A): AFTER_U, ("a", AFTER_U): AFTER_A}
DELETE, INSERT, KEEP, REROLE = range(4)  # in ASCII order of D, I, K, R
LETTERS = "DIKR"
LAST = (0, 4, 2, 0)  # cost of finishing after the last row: from s a pair, from u an assistant's turn
MOST = 2**63 - 1


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: a twentieth of the rows each dropped (kept here as a mark of its conversation),
    emptied, stripped of its sentence ends, doubled, or set to user, by the crc32 of conv_id:turn."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fate = (F.crc32(F.concat_ws(":", named[0], named[1]).cast("binary")) % 20).alias("fate")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), named[2].alias("role"), named[3].alias("text"), fate)
    text = F.when(F.col("fate").isin(0, 1), "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fate") == 0).alias("dropped"), times.alias("_time")).drop("_time")


def with_faults(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text, dropped), partitioned by conversation, with copy (how many alike stand before it) and
    fault: blank, duplicate, truncated or null, the first that holds."""
    alike = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    has = F.col("text").rlike(f"[^{SPACE}]")
    cut = ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    fault = F.when(F.col("dropped"), None).when(~has, "blank").when(F.col("copy") > 1, "duplicate").when(cut, "truncated")
    return rows.repartition("conv_id").withColumn("copy", F.row_number().over(alike)).withColumn("fault", fault)


def choices(initial: str, fault: str | None, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Costs of finishing from each state at a row, and the choices packed in a byte, from the costs after the row."""
    stays = fault not in ("blank", "duplicate")
    extra = int(fault == "truncated")
    options = []
    for q in range(4):
        keep = KEPT.get((initial, q)) if stays else None
        options.append([3 + after[q], None, None if keep is None else extra + after[keep], 2 + extra + after[TURN[q]] if stays else None])
    cost = [min(c for c in o if c is not None) for o in options]
    for _ in range(2):  # two insertions at most, as a third comes back to a state seen
        cost = [min(c, 2 + cost[TURN[q]]) for q, c in enumerate(cost)]
    byte = 0
    for q in range(4):
        options[q][INSERT] = 2 + cost[TURN[q]]
        byte |= next(k for k in range(4) if options[q][k] == cost[q]) << 2 * q
    return tuple(cost), byte


def backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows from the last turn to the first, with choice and from_end."""
    now, after, at, known = object(), LAST, 0, {}
    for part in batches:
        byte, place = np.empty(len(part), np.int16), np.empty(len(part), np.int64)
        for i, (conv, role, fault, gone) in enumerate(zip(part["conv_id"], part["role"], part["fault"], part["dropped"], strict=True)):
            if conv != now:
                now, after, at = conv, LAST, 0
            byte[i] = 0
            if not gone:
                # costs are kept relative to their least, so that few cases occur and each is worked out once
                key = (role[:1], fault, after)
                if key not in known:
                    cost, b = choices(*key)
                    known[key] = tuple(c - min(cost) for c in cost), b
                after, byte[i] = known[key]
            place[i] = at
            at += 1
        yield part.assign(choice=byte, from_end=place)


def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edits in order, a row each: conv_id, edit (D, I, K, R; null for a mark of a conversation), turn, role and text as
    repaired (of a deleted row as they were), was (the row's role before), fault."""
    now, q, columns = object(), START, ["conv_id", "edit", "turn", "role", "text", "was", "fault"]

    def end(out: list) -> None:
        state = q
        while state in (AFTER_S, AFTER_U):
            out.append((now, "I", None, "assistant" if state == AFTER_U else "user", "", None, None))
            state = TURN[state]

    for part in batches:
        out: list[tuple] = []
        for conv, turn, role, text, fault, gone, byte in zip(*(part[c] for c in ("conv_id", "turn", "role", "text", "fault", "dropped", "choice")), strict=True):
            if conv != now:
                end(out)
                now, q = conv, START
            if gone:
                out.append((conv, None, None, None, None, None, None))
                continue
            while True:
                edit, needed = byte >> 2 * q & 3, "assistant" if q == AFTER_U else "user"
                if edit == DELETE:
                    out.append((conv, "D", turn, role, text, role, fault))
                elif edit == KEEP:
                    out.append((conv, "K", turn, role, text, role, fault))
                    q = KEPT[role[:1], q]
                else:
                    out.append((conv, LETTERS[edit], turn if edit == REROLE else None, needed, text if edit == REROLE else "", role if edit == REROLE else None, fault if edit == REROLE else None))
                    q = TURN[q]
                if edit != INSERT:
                    break
        yield pd.DataFrame(out, columns=columns, dtype=object)
    out = []
    end(out)
    yield pd.DataFrame(out, columns=columns, dtype=object)


class Report:
    """Running figures of one conversation."""

    def __init__(self, conv: object) -> None:
        self.conv, self.audit, self.sha, self.first = conv, bytearray(), hashlib.sha256(), True
        self.counts, self.illegal, self.cost, self.initial = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, 0, None
        self.low = self.high = None
        self.turns = 0

    def add(self, edit: str, turn: str | None, role: str, text: str, was: str | None, fault: str | None) -> None:
        self.audit += edit.encode()
        self.cost += {"D": 3, "I": 2, "K": 0, "R": 2}[edit] + (fault == "truncated" and edit != "D")
        if edit != "I":
            if fault:
                self.counts[fault] += 1
            if self.initial is not None and self.initial + was[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = was[:1]
            if turn is not None and int(turn) != self.high:  # turns rise
                self.high, self.turns = int(turn), self.turns + 1
                self.low = self.high if self.low is None else self.low
        if edit != "D":
            self.sha.update(b"" if self.first else b"\n")
            self.sha.update(f"{role}:{text}".encode())
            self.first = False

    def row(self) -> tuple:
        gaps = 0 if self.low is None else min(MOST, self.high - self.low + 1 - self.turns)
        return self.conv, gaps, self.counts["blank"], self.counts["duplicate"], self.counts["truncated"], self.illegal, self.cost, self.audit.decode(), self.sha.hexdigest()


def reports(edits: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row a conversation from its edits in order."""
    one = None
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    for part in edits:
        out = []
        for conv, edit, *rest in part.itertuples(index=False, name=None):
            if one is None or conv != one.conv:
                if one is not None:
                    out.append(one.row())
                one = Report(conv)
            if edit is not None:
                one.add(edit, *rest)
        yield pd.DataFrame(out, columns=names)
    if one is not None:
        yield pd.DataFrame([one.row()], columns=names)


def _chosen(rows: DataFrame) -> DataFrame:
    """rows with faults and choices, each partition's in order of conversation and turn. Ids and turns go to Python as texts,
    as pandas would make floats of numbers among nulls."""
    down = ["conv_id", F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc(), F.col("copy").desc()]
    texts = [F.col(c).cast("string").alias(c) for c in ("conv_id", "turn")]
    sent = with_faults(rows).sortWithinPartitions(*down).select(*texts, "role", "text", "dropped", "copy", "fault")
    schema = "conv_id string, turn string, role string, text string, dropped boolean, copy int, fault string, choice short, from_end long"
    return sent.mapInPandas(backward, schema).sortWithinPartitions("conv_id", F.col("from_end").desc())


def _undamaged(conversations: DataFrame) -> DataFrame:
    text = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *text, F.lit(False).alias("dropped"))


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """The cheapest edits of conversations(conv_id, turn, role, text), a row each: conv_id, seq (gapless from 0), edit, turn,
    role and text as repaired, was, fault. Rows whose edit isn't D are the repaired conversation."""
    small_batches(conversations.sparkSession)
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, at = object(), 0
        for part in forward(batches):
            seq = []
            for conv in part["conv_id"]:
                if conv != now:
                    now, at = conv, 0
                seq.append(at)
                at += 1
            yield part.assign(seq=np.array(seq, np.int64))

    edits = _chosen(_undamaged(conversations)).mapInPandas(run, "conv_id string, edit string, turn string, role string, text string, was string, fault string, seq long")
    return edits.select(F.col("conv_id").cast(kind).alias("conv_id"), "seq", "edit", F.col("turn").cast("long").alias("turn"), "role", "text", "was", "fault")


def repair_reports(rows: DataFrame) -> DataFrame:
    """A row a conversation of rows(conv_id, turn, role, text, dropped): counts of faults, cost, audit and hash of its repair.
    Dropped rows only name their conversation."""
    small_batches(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    found = _chosen(rows).mapInPandas(lambda b: reports(forward(b)), "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return found.withColumn("conv_id", F.col("conv_id").cast(kind))


def op11_streamed_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_reports(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
