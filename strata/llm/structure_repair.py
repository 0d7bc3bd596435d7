"""Repair of conversations by the cheapest edits that give them a legal order of turns.

The grammar is ``(s?(ua)+)?`` over the initials of roles. Costs to go are found from the last turn back to the first, for each
state of the grammar; with them each turn knows, for every state, the least edit among those that cost no more than they
must. A walk from the first turn on follows these choices and rebuilds the turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import WORD


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    #: Of each truncated turn that stays.
    truncated: int = 5


#: Of each state (0 nothing yet, 1 after the system's turn, 2 after a user's, 3 after an assistant's) the one that follows each initial.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that an inserted or renamed turn has in each state, and the state after it.
FORCED = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
LEGAL = {"su", "ua", "au"}


def ending(costs: Costs) -> list[int]:
    """Costs to go after the last turn."""
    return [0, 2 * costs.insert, costs.insert, 0]


def choices(after: list[int], initial: str, fault: str, costs: Costs) -> tuple[list[int], list[str]]:
    """(costs to go, choices) before a turn, given those after it. A choice is a state's edits up to and with this turn, and the
    state after them as a digit."""
    stays = fault not in ("blank", "duplicate")
    extra = costs.truncated if fault == "truncated" else 0
    moves = []
    for q in range(4):
        ways = {"D": (costs.delete + after[q], q)}
        if stays and initial in NEXT[q]:
            ways["K"] = (extra + after[NEXT[q][initial]], NEXT[q][initial])
        if stays:
            ways["R"] = (costs.rerole + extra + after[FORCED[q][1]], FORCED[q][1])
        moves.append(ways)
    least = [min(c for c, _ in ways.values()) for ways in moves]
    # an insertion leads from 0 and 1 to 2, and between 2 and 3; no two of them come back to where they began
    least[2], least[3] = min(least[2], costs.insert + least[3]), min(least[3], costs.insert + least[2])
    least[0], least[1] = (min(least[q], costs.insert + least[2]) for q in (0, 1))
    found = []
    for q in range(4):
        edits, at = "", q
        while True:
            ways = moves[at]
            if ways["D"][0] == least[at]:
                pick = "D"
            elif costs.insert + least[FORCED[at][1]] == least[at]:
                edits, at = edits + "I", FORCED[at][1]
                continue
            else:
                pick = next(k for k in "KR" if k in ways and ways[k][0] == least[at])
            found.append(f"{edits}{pick}{ways[pick][1]}")
            break
    return least, found


def _backward(costs: Costs):
    """Turns of whole conversations, the last first, with the choices of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, after = object(), ending(costs)
        for batch in batches:
            found = []
            columns = (batch[c].to_pylist() for c in ("conv_id", "dropped", "role", "fault"))
            for conv, dropped, role, fault in zip(*columns):
                if conv != current:
                    current, after = conv, ending(costs)
                if dropped:
                    found.append("")
                    continue
                after, picked = choices(after, role[:1], fault, costs)
                found.append(" ".join(picked))
            yield batch.append_column("picked", pa.array(found, pa.string()))

    return run


class _Walk:
    """The forward walk over one conversation's turns."""

    def __init__(self, conv, costs: Costs):
        self.conv, self.costs, self.state, self.cost = conv, costs, 0, 0
        self.audit: list[str] = []
        self.hash, self.first, self.before = hashlib.sha256(), True, None
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal = self.turns = 0
        self.low = self.high = self.last_turn = None

    def put(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def insert(self) -> None:
        role, self.state = FORCED[self.state]
        self.put(role, "")
        self.audit.append("I")
        self.cost += self.costs.insert

    def turn(self, turn, role: str, text: str, fault: str, picked: str) -> None:
        if turn is not None:
            # turns come in ascending order, so a new one differs from the last
            self.turns += turn != self.last_turn
            self.low, self.high, self.last_turn = turn if self.low is None else self.low, turn, turn
        if fault:
            self.counts[fault] += 1
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        edits = picked.split(" ")[self.state]
        for _ in edits[:-2]:
            self.insert()
        edit = edits[-2]
        self.audit.append(edit)
        if edit == "D":
            self.cost += self.costs.delete
            return
        if edit == "R":
            role = FORCED[self.state][0]
            self.cost += self.costs.rerole
        self.cost += self.costs.truncated if fault == "truncated" else 0
        self.state = int(edits[-1])
        self.put(role, text)

    def result(self) -> tuple:
        while self.state in (1, 2):
            self.insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


RESULT = pa.schema(
    [("conv_id", pa.int64())] + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)


def _forward(costs: Costs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for batch in batches:
            done = []
            columns = (batch[c].to_pylist() for c in ("conv_id", "dropped", "turn", "role", "text", "fault", "picked"))
            for conv, dropped, *rest in zip(*columns):
                if walk is None or walk.conv != conv:
                    done += [walk.result()] if walk else []
                    walk = _Walk(conv, costs)
                if not dropped:
                    walk.turn(*rest)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(RESULT.names, r)) for r in done], RESULT)
        if walk:
            yield pa.RecordBatch.from_pylist([dict(zip(RESULT.names, walk.result()))], RESULT)

    return run


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text``, ``dropped``: turns damaged by the CRC-32 of ``conv_id:turn`` mod 20: 0 drops it (it stays
    as a marked row, so that its conversation is known), 1 empties the text, 2 takes away its ``[.!?]``, 3 doubles it, 4 makes it the user's."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))), F.lit(20))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), copies.alias("_copy")).drop("_copy")


def fault_of(text: Column, place: Column) -> Column:
    """The first fault of a turn, empty without one; ``place`` counts turns of the conversation with its role and text."""
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(~F.regexp_like(text, F.lit(WORD)), "blank").when(place > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")


def repair(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row a conversation of ``turns`` (``conv_id``, ``turn``, ``role``, ``text`` and optionally ``dropped``; others are not read, so
    their names can't clash): ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.

    Turns are taken by ``turn``, nulls first; equal ones (ties) by role, then text. Null roles and texts are one space each here. Rows
    that repeat are duplicates. Rows with ``dropped`` only say that the conversation exists: without others it has zeros, an empty
    audit and the hash of nothing. A role without letters has no initial and cannot stay. Rows without ``conv_id`` are one conversation, without an id. Texts of any length are taken whole. An
    empty table gives no rows.

    All turns of a conversation meet in one task, which reads them as a stream, in an order that Spark sorted and spills: it
    holds four costs and the audit. One pass over them back, one forth; only the first needs a shuffle.
    """
    if "dropped" not in turns.columns:
        turns = turns.withColumn("dropped", F.lit(False))
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), filled("role"), filled("text"), "dropped").repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", F.sha2("text", 256), "dropped").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("place", F.row_number().over(same))
    rows = rows.withColumn("fault", fault_of(F.col("text"), F.col("place")))
    order = ["turn", "role", "text", "place"]
    last_first = rows.sortWithinPartitions("conv_id", *[F.col(c).desc_nulls_last() for c in order])
    schema = "conv_id long, turn long, role string, text string, dropped boolean, place int, fault string, picked string"
    picked = last_first.mapInArrow(_backward(costs), schema)
    first_first = picked.sortWithinPartitions("conv_id", *[F.col(c).asc_nulls_first() for c in order])
    types = ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'long'}" for c in RESULT.names)
    return first_first.mapInArrow(_forward(costs), types)
