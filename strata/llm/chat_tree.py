"""Conversations formatted as packed sequences in which turns that conversations share from the beginning stand once.

All conversations form a tree of turns. A shard holds a run of conversations in depth-first order: the segment of a turn is
written where the first conversation comes to it, with the position that its first token has in its own conversation and the
intervals of the sequence that it attends to, which are its ancestors. Shards stand alone: what comes before the first
conversation of one is written there again.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import hot_keys, spread_join, stored
from strata.llm.files import opened
from strata.sources.scratch import scratch_path, spread
from strata.streaming.replay import numbered

# fixed values: the marks of the template, and what is escaped in roles and texts
BEGIN, MIDDLE, END = "[INST]", "[/INST]", "</s>"
CONTROL = re.compile(r"\\|<(?=/?s>)|\[(?=/?INST\])")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)


@dataclass(frozen=True)
class Format:
    #: The role whose texts are under the loss mask.
    learned: str = "assistant"
    #: A tokenizer's file that all executors can read; without one, a token is a code point.
    tokenizer: str | None = None
    #: Up to so many conversations with shared turns are known to all tasks; beyond that they are joined.
    broadcast_rows: int = 200_000


def escape(text: str) -> str:
    """A backslash after each backslash, and after the first character of each control string."""
    return CONTROL.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    role, _, text = segment.removeprefix(BEGIN).partition(MIDDLE)
    return unescape(role), unescape(text.removesuffix(END))


def _keyed(turns: DataFrame) -> DataFrame:
    """Turns with ``_conv`` (a key that is never null) and ``_said`` (a hash of role and text)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("_conv"),
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role").alias("role"), text("text").alias("text"),
    )
    framed = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.withColumn("_said", F.unhex(F.sha2(framed, 256)))


def _step(before: bytes, said: bytes) -> bytes:
    """The node of a turn: a hash of all turns up to it."""
    return hashlib.blake2b(before + said, digest_size=16).digest()


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, node, depth = None, b"", 0
    for batch in batches:
        convs, nodes, depths = batch["_conv"], [], []
        for c, said in zip(convs.to_pylist(), batch["_said"].to_pylist()):
            conv, node, depth = (conv, node, depth + 1) if c == conv else (c, b"", 1)
            node = _step(node, said)
            nodes.append(node)
            depths.append(depth)
        yield pa.RecordBatch.from_arrays([convs, pa.array(depths, pa.int64()), pa.array(nodes, pa.binary())], ["_conv", "depth", "node"])


def _in_order(rows: DataFrame, *first: str | Column) -> DataFrame:
    """By conversation and turn, nulls first; equal turns by role, then by a hash of what is said."""
    return rows.sortWithinPartitions(*first, F.col("turn").asc_nulls_first(), "role", "_said")


def branches(turns: DataFrame) -> DataFrame:
    """``_conv``, ``steps``, ``deepest``, ``key`` of conversations that share turns with others from the beginning, down to ``deepest``.
    ``steps`` has the nodes of the path at which the number of conversations changes (``depth``, ``n``, ``node``); their hashes, one after
    the other, are the key: conversations below one node stand together when sorted by it.

    Only nodes' hashes are shuffled, no texts. A node that very many conversations pass is joined by broadcast.
    """
    narrow = turns.select("_conv", "turn", "role", "_said").repartition("_conv")
    nodes = stored(_in_order(narrow, "_conv").mapInArrow(_nodes, "_conv string, depth long, node binary"), "nodes")
    shared = stored(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    path = spread_join(nodes, shared, ["node"], hot_keys(shared, "node"))
    before = F.lag("n").over(Window.partitionBy("_conv").orderBy("depth"))
    changed = F.when(before.isNull() | (before != F.col("n")), F.struct("depth", "n", "node"))
    steps = path.withColumn("_changed", changed).groupBy("_conv")
    steps = steps.agg(F.sort_array(F.collect_list("_changed")).alias("steps"), F.max("depth").alias("deepest"))
    return steps.withColumn("key", F.array_join(F.transform("steps", lambda s: F.hex(s["node"])), ""))


ROWS = pa.schema([
    ("shard", pa.int32()), ("place", pa.int64()), ("conv_id", pa.int64()), ("start", pa.int64()), ("position", pa.int64()),
    ("attends", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("learned", pa.list_(pa.int64())),
    ("n_conversations", pa.int64()), ("text", pa.string()), ("ids", pa.list_(pa.int32())),
])
ROWS_DDL = (
    "shard int, place long, conv_id long, start long, position long, attends array<struct<from: long, to: long>>, learned array<long>, "
    "n_conversations long, text string, ids array<int>"
)


class _Path:
    """The path of the segment written last: per depth its node, its end in the sequence, the end of its positions, and the beginning
    and first depth of the run of segments without a gap that it belongs to. Some 50 bytes a turn of one conversation."""

    def __init__(self):
        self.nodes, self.ends, self.positions, self.starts, self.since = bytearray(), array("q"), array("q"), array("q"), array("q")

    def __len__(self) -> int:
        return len(self.ends)

    def has(self, depth: int, node: bytes) -> bool:
        return depth <= len(self) and self.nodes[16 * depth - 16 : 16 * depth] == node

    def cut(self, depth: int) -> None:
        del self.nodes[16 * depth :], self.ends[depth:], self.positions[depth:], self.starts[depth:], self.since[depth:]

    def put(self, node: bytes, start: int, length: int) -> int:
        """Adds a segment; the position of its first token."""
        position = self.positions[-1] if len(self) else 0
        follows = len(self) and self.ends[-1] == start
        self.starts.append(self.starts[-1] if follows else start)
        self.since.append(self.since[-1] if follows else len(self) + 1)
        self.nodes += node
        self.ends.append(start + length)
        self.positions.append(position + length)
        return position

    def intervals(self, depth: int) -> list[dict]:
        """What a segment below ``depth`` attends to, in ascending order: the path's runs."""
        found = []
        while depth:
            found.append({"from": self.starts[depth - 1], "to": self.ends[depth - 1]})
            depth = self.since[depth - 1] - 1
        return found[::-1]


def _encoder(tokenizer: str | None):
    """A function from a text to its ids, or None."""
    if not tokenizer:
        return None
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer)
    return lambda s: model.encode(s, add_special_tokens=False).ids


def _pack(form: Format):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encode = TaskContext.get().partitionId(), _encoder(form.tokenizer)
        path, rows, place, cursor = _Path(), [], 0, 0
        conv, conv_id, node, depth, along, passing, steps, deepest = None, None, b"", 0, True, 1, [], 0

        def end():
            nonlocal place
            rows.append((shard, place, conv_id, None, path.positions[depth - 1], path.intervals(depth), None, None, None, None))
            place += 1

        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("_conv", "_head", "conv_id", "role", "text", "_said", "steps", "deepest"))
            for c, head, i, role, text, said, changes, shared in zip(*columns):
                if c != conv:
                    if conv is not None:
                        end()
                    conv, node, depth, along, steps, deepest = c, b"", 0, True, [], 0
                if head:
                    steps, deepest = changes[::-1], shared
                    continue
                conv_id, node, depth = i, _step(node, said), depth + 1
                if steps and steps[-1]["depth"] == depth:
                    passing = steps.pop()["n"]
                if along and path.has(depth, node):
                    continue
                if along:
                    path.cut(depth - 1)
                    along = False
                parts = [f"{BEGIN}{escape(role)}{MIDDLE}", escape(text), END]
                ids = [encode(p) for p in parts] if encode else None
                before, body, after = map(len, ids or parts)
                length = before + body + after
                attends = path.intervals(depth - 1)
                position = path.put(node, cursor, length)
                learned = [cursor + before, cursor + before + body] if role == form.learned else None
                n = passing if depth <= deepest else 1
                rows.append((shard, place, None, cursor, position, attends, learned, n, "".join(parts), sum(ids, []) if ids else None))
                cursor, place = cursor + length, place + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), ROWS.types)], schema=ROWS)
                rows.clear()
        if conv is not None:
            end()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), ROWS.types)], schema=ROWS)

    return run


def write_chats(turns: DataFrame, path: str, form: Format = Format()) -> DataFrame:
    """Writes the packed sequences as Parquet files below ``path``, one a shard, and returns their names (``file``).

    Rows of a file are in the order of ``place``. A segment has ``start`` (its first token in the shard's sequence), ``position`` (that
    token's position id; the next ones count on), ``attends`` (the intervals of its ancestors), ``learned`` (the interval under the loss
    mask, null outside), ``n_conversations`` (that pass it, in all shards), ``text`` and, with a tokenizer, ``ids``. The end of a
    conversation has ``conv_id`` and no ``start``: ``attends`` is all of it, ``position`` its length.

    ``turns`` has ``conv_id``, ``turn``, ``role``, ``text``; others are not read, so their names can't clash. Turns come by ``turn``, nulls
    first; equal ones (ties) by role, then by the SHA-256 of role and text. A null role or text is an empty one. Rows without ``conv_id``
    are one conversation, without an id. Rows that repeat are turns. Control strings in roles and texts of any length are escaped.
    An empty table has no files.

    A conversation is the stream of one task, in an order that Spark sorts and spills; what it holds in memory is the path's
    numbers. Copies of a conversation may lie in many shards.
    """
    rows = _keyed(turns)
    spots = numbered(branches(rows), ["key", "_conv"]).select("_conv", "place", "steps", "deepest")
    spots = stored(spots, "branches")
    places = spots.select(F.col("_conv").alias("_c"), "place")
    few = spots.count() <= form.broadcast_rows
    rows = rows.join(F.broadcast(places) if few else places, F.col("_conv") == F.col("_c"), "left").drop("_c")
    rows = rows.withColumn("place", F.coalesce("place", F.lit(0))).withColumn("_head", F.lit(False))
    rows = rows.unionByName(spots.withColumn("_head", F.lit(True)), allowMissingColumns=True)
    ordered = _in_order(rows.repartitionByRange("place", "_conv"), "place", "_conv", F.col("_head").desc())
    ordered.mapInArrow(_pack(form), ROWS_DDL).write.option("compression", "zstd").parquet(path)
    spark = turns.sparkSession
    files = spark.read.schema(ROWS_DDL).parquet(path).inputFiles()
    return spark.createDataFrame([(f,) for f in files], "file string")


def _reader(form: Format):
    decode = None
    if form.tokenizer:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(form.tokenizer)
        decode = lambda ids: model.decode(ids, skip_special_tokens=False)

    def read(file: str) -> Iterator[dict]:
        system, path = opened(file)
        with system.open_input_file(path) as source:
            for batch in pq.ParquetFile(source).iter_batches(2048):
                for row in batch.to_pylist():
                    if decode and row["start"] is not None:
                        row["text"] = decode(row["ids"])
                    yield row

    return read


@dataclass
class _State:
    """What has been read of the conversation up to a segment."""

    end: int
    n: int
    turns: object
    loss: object
    n_turns: int = 0
    loss_chars: int = 0
    chars: int = 0

    def follow(self) -> _State:
        return _State(self.end, self.n, self.turns.copy(), self.loss.copy(), self.n_turns, self.loss_chars, self.chars)


CHATS = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
    ("formatted_chars", pa.int64()),
])


def _chats(rows: Iterator[dict], by_id: bool) -> Iterator[tuple]:
    stack: list[_State] = []
    for row in rows:
        last = row["attends"][-1]["to"] if row["attends"] else 0
        while stack and stack[-1].end > last:
            stack.pop()
        if (stack[-1].end if stack else 0) != last:
            raise ValueError(f"shard {row['shard']}, row {row['place']}: no segment ends at {last}")
        if row["start"] is None:
            s = stack[-1]
            yield row["conv_id"], s.n_turns, s.turns.hexdigest(), s.loss_chars, s.loss.hexdigest(), s.chars
            continue
        if not stack:
            stack.append(_State(0, -1, hashlib.sha256(), hashlib.sha256()))
        # a segment that all conversations of the one before it pass takes over its state: nothing else will follow that one
        if stack[-1].n != row["n_conversations"] or stack[-1].end == 0:
            stack.append(stack[-1].follow())
        s, (role, text) = stack[-1], parse(row["text"])
        s.turns.update(f"{role}\n{text}\n".encode())
        if row["learned"]:
            # under a mask of code points, what it covers; under one of ids, the text between the marks
            masked = text if by_id else unescape(row["text"][row["learned"][0] - row["start"] : row["learned"][1] - row["start"]])
            s.loss.update(masked.encode())
            s.loss_chars += len(masked)
        s.n_turns, s.chars, s.n = s.n_turns + 1, s.chars + len(row["text"]), row["n_conversations"]
        s.end = row["start"] + len(row["ids"] if by_id else row["text"])


def read_chats(files: DataFrame, form: Format = Format()) -> DataFrame:
    """One row a conversation of the files of ``write_chats``, from one pass over each file: ``n_turns``, ``turns_sha256`` (of role and text,
    each with a line feed), ``loss_chars`` and ``loss_sha256`` (of the texts under the loss mask, unescaped), ``formatted_chars``.

    A segment goes on from the state in which the last of the intervals it attends to ends, so shared turns are hashed once a shard. No
    files give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(form)
        for batch in batches:
            for file in batch["file"].to_pylist():
                done = []
                for chat in _chats(read(file), bool(form.tokenizer)):
                    done.append(chat)
                    if len(done) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), CHATS.types)], schema=CHATS)
                        done = []
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), CHATS.types)], schema=CHATS)

    types = ", ".join(f"{c} {'string' if c.endswith('sha256') else 'long'}" for c in CHATS.names)
    return spread(files).mapInArrow(run, types)


def format_chats(turns: DataFrame, form: Format = Format()) -> DataFrame:
    """Writes the conversations to a new folder and reads them back; see ``write_chats`` and ``read_chats``."""
    return read_chats(write_chats(turns, scratch_path(turns.sparkSession, "chats"), form), form)
