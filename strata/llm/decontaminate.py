"""Benchmark decontamination by generalised suffix automata of the test items.

Items are normalised to words and dealt to blocks of a bounded number of words, so that any benchmark
fits: each block has one automaton, in a file in the shared folder. Tasks stream the words of whole
documents through it. At each word the automaton gives the longest run up to there that some
item holds; where that reaches the window, or ends a shorter item, the words are hit. Runs without a pair of
words that an item has are passed over by numpy.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.common import let, packed, scratch_path, stored, text_of
from strata.llm.files import opened, whole_file
from strata.llm.tokens import LOWER_ALNUM, coded_words, slices, split_words


@dataclass(frozen=True)
class Limits:
    """A document is contaminated if ``share`` times its hit words reach its words, or a run of hit words
    is longer than ``max_run`` (0: no such limit)."""

    window: int = 13
    share: int = 20
    max_run: int = 0
    #: Words of items in one automaton (a few hundred bytes each in memory).
    block_words: int = 200_000
    #: Bytes of texts that a task holds while it goes through the blocks.
    held_bytes: int = 16_000_000


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, items: dict[str, list[str]], window: int):
        words = sorted({w for item in items.values() for w in item})
        self.window, self.words = window, words
        code = {w: i for i, w in enumerate(words)}
        self.next, self.link, self.length = [{}], [-1], [0]
        self.least = window
        pairs, states = set(), {}
        for name in sorted(items):
            sequence = [code[w] for w in items[name]]
            self.least = min(self.least, len(sequence))
            pairs.update(a * len(words) + b for a, b in zip(sequence, sequence[1:]))
            states[name] = sequence
            last = 0
            for c in sequence:
                last = self._extend(last, c)
        self.pairs = np.array(sorted(pairs), np.int64)
        # which items hold a run of a full window, by the state of the run; which short items end in a state
        self.holders: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for name, sequence in states.items():
            state, seen = 0, set()
            for c in sequence:
                state = self.next[state][c]
                up = state
                while up > 0 and self.length[up] >= window and up not in seen:
                    seen.add(up)
                    self.holders.setdefault(up, set()).add(name)
                    up = self.link[up]
            if 0 < len(sequence) < window:
                self.short.setdefault(state, []).append((len(sequence), name))
        # the nearest state up the links at which a short item ends
        self.ends = [0] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[state]
            self.ends[state] = up if up in self.short else self.ends[max(up, 0)]

    def _extend(self, last: int, c: int) -> int:
        known = self.next[last].get(c)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self._split(last, known, c)
        new = self._state(self.length[last] + 1, {})
        while last >= 0 and c not in self.next[last]:
            self.next[last][c] = new
            last = self.link[last]
        if last < 0:
            self.link[new] = 0
        else:
            to = self.next[last][c]
            self.link[new] = to if self.length[to] == self.length[last] + 1 else self._split(last, to, c)
        return new

    def _state(self, length: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, last: int, to: int, c: int) -> int:
        """A state for the shorter runs of ``to``, which ``last`` and the states above it lead to."""
        part = self._state(self.length[last] + 1, dict(self.next[to]))
        self.link[part], self.link[to] = self.link[to], part
        while last >= 0 and self.next[last].get(c) == to:
            self.next[last][c] = part
            last = self.link[last]
        return part

    def matches(self, codes: list[int]) -> Iterator[tuple[int, int, int]]:
        """(start, end, state) of each window found in a run of known words; end is exclusive."""
        nexts, link, length, window = self.next, self.link, self.length, self.window
        state, long = 0, 0
        for i, c in enumerate(codes):
            while state and c not in nexts[state]:
                state = link[state]
                long = length[state]
            to = nexts[state].get(c)
            if to is None:
                long = 0
                continue
            state, long = to, long + 1
            if long >= window:
                up = state
                while length[link[up]] >= window:
                    up = link[up]
                yield i + 1 - window, i + 1, up
            at = state if state in self.short else self.ends[state]
            while at:
                for n, _ in self.short[at]:
                    if n <= long:
                        yield i + 1 - n, i + 1, -at
                at = self.ends[at]

    def items_of(self, state: int) -> set[str]:
        return self.holders[state] if state > 0 else {name for _, name in self.short[-state]}

    def scan(self, offsets: np.ndarray, codes: np.ndarray, words: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
        """(text, hit spans of words, items) for each text of a batch with a hit."""
        own = pc.index_in(words, pa.array(self.words, words.type)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
        n = len(own)
        if not n:
            return
        # linked[i]: words i - 1 and i stand together in an item, in one text
        linked = np.zeros(n + 1, bool)
        key = own[:-1] * len(self.words) + own[1:]
        at = np.searchsorted(self.pairs, key)
        if len(self.pairs):
            linked[1:n] = (self.pairs[np.minimum(at, len(self.pairs) - 1)] == key) & (own[:-1] >= 0) & (own[1:] >= 0)
        linked[offsets] = False
        starts = np.flatnonzero(~linked[:n])
        ends = np.append(starts[1:], n)
        long = (ends - starts >= self.least) & (own[starts] >= 0)
        found: dict[int, tuple[list, set]] = {}
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            for s, e, state in self.matches(own[a:b].tolist()):
                text = int(np.searchsorted(offsets, a, side="right")) - 1
                spans, items = found.setdefault(text, ([], set()))
                s, e = s + a - int(offsets[text]), e + a - int(offsets[text])
                if spans and s <= spans[-1][1] and s >= spans[-1][0]:
                    spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
                else:
                    spans.append((s, e))
                items |= self.items_of(state)
        for text, (spans, items) in found.items():
            yield text, spans, items


def _pieces(rows: DataFrame, limits: Limits) -> DataFrame:
    """``key``, ``piece``, ``n``: the words of items. A very long item is cut into pieces that overlap by a window less a word, so
    that each of its windows is whole in one of them."""
    most = max(limits.block_words // 4, 2 * limits.window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                offsets, words = split_words(part.column(1), LOWER_ALNUM)
                keys, texts, sizes = [], [], []
                for i, key in enumerate(part.column(0).to_pylist()):
                    own = words[offsets[i] : offsets[i + 1]].to_pylist()
                    for s in range(0, max(1, len(own) - limits.window + 1), most - limits.window + 1) if own else ():
                        piece = own[s : s + most]
                        keys.append(key)
                        texts.append(" ".join(piece))
                        sizes.append(len(piece))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], ["key", "piece", "n"])

    return rows.mapInArrow(run, "key string, piece string, n long")


def build_blocks(items: DataFrame, limits: Limits = Limits(), key: str = "item_id", text: str = "text") -> list[str]:
    """Files with one automaton each, made in tasks; the driver gets their names alone.

    Null and wordless items have no window. Items of one id count as one item with all their windows; items that repeat a text are one
    sequence with all their ids, so a block holds about ``block_words`` words however often a text is there.
    """
    rows = items.select(F.col(key).cast("string").alias("key"), text_of(text).alias("text"))
    pieces = _pieces(rows, limits).groupBy("piece").agg(F.first("n").alias("n"), F.sort_array(F.collect_set("key")).alias("keys"))
    pieces = stored(pieces, "items")
    n_blocks = -(-(pieces.agg(F.sum("n")).first()[0] or 0) // limits.block_words)
    if not n_blocks:
        return []
    folder = scratch_path(items.sparkSession, "automata")

    def build(group: pa.Table) -> pa.Table:
        order = pc.sort_indices(group["piece"])
        held = {f"{i:09d}": piece.split(" ") for i, piece in enumerate(group["piece"].take(order).to_pylist())}
        names = {f"{i:09d}": keys for i, keys in enumerate(group["keys"].take(order).to_pylist())}
        path = f"{folder}/block-{group['block'][0].as_py():07d}"
        with whole_file(path) as out:
            out.write(pickle.dumps((Automaton(held, limits.window), names)))
        return pa.table({"path": [path]})

    blocks = pieces.withColumn("block", F.pmod(F.xxhash64("piece"), F.lit(n_blocks)))
    return sorted(r["path"] for r in stored(blocks.groupBy("block").applyInArrow(build, "path string"), "blocks").collect())


_loaded: dict[str, tuple[Automaton, dict[str, list[str]]]] = {}


def _load(path: str) -> tuple[Automaton, dict[str, list[str]]]:
    """One block at a time is kept in a worker."""
    if path not in _loaded:
        _loaded.clear()
        system, name = opened(path)
        with system.open_input_file(name) as f:
            _loaded[path] = pickle.loads(f.read())
    return _loaded[path]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FOUND = [T.StructField(n, T.LongType()) for n in ("n_words", "n_hit", "n_items")] + [T.StructField("items_sha256", T.StringType()), T.StructField("spans", T.ArrayType(SPAN))]


def find(docs: DataFrame, items: DataFrame, limits: Limits = Limits(), carry: list[str] | None = None, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``row`` (the columns of ``docs`` named in ``carry``, or all) and, of its text, ``n_words``, ``n_hit``, ``n_items`` (items found),
    ``items_sha256`` (of their sorted ids), ``spans`` (hit words) and ``contaminated``.

    A null text has no words. Repeated rows are judged alike. With no items nothing is hit. Very long texts are scanned whole; a
    task holds ``held_bytes`` of texts, or one text, at a time, and takes the blocks one after the other over all that it holds.
    """
    paths = build_blocks(items, limits, item_key, item_text)

    def texts_of(b: pa.RecordBatch) -> pa.Array:
        return pc.struct_field(b.column(0), [at]) if carry is None else b.column(1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            for part in slices(b, texts=texts_of(b), most_bytes=limits.held_bytes // 4):
                parts.append(part)
                held += pc.sum(pc.binary_length(texts_of(part))).as_py() or 0
                if held >= limits.held_bytes:
                    yield from judged(parts)
                    parts, held = [], 0
        yield from judged(parts)

    def judged(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = [coded_words(texts_of(p), LOWER_ALNUM) for p in parts]
        spans: list[list[list[tuple[int, int]]]] = [[[] for _ in range(p.num_rows)] for p in parts]
        names: list[list[set[str]]] = [[set() for _ in range(p.num_rows)] for p in parts]
        for path in paths:
            automaton, ids = _load(path)
            for k, words in enumerate(coded):
                for i, s, held in automaton.scan(*words):
                    spans[k][i] += s
                    for name in held:
                        names[k][i].update(ids[name])
        for part, (offsets, *_), found, items in zip(parts, coded, spans, names):
            found = [merged(s) for s in found]
            columns = [
                part.column(0), pa.array(np.diff(offsets)), pa.array([sum(e - s for s, e in x) for x in found], pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items], pa.string()),
                pa.array([[{"start": s, "end": e} for s, e in x] for x in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "n_words", "n_hit", "n_items", "items_sha256", "spans"])

    at = docs.columns.index(text)
    rows = docs.select(packed(docs).alias("row")) if carry is None else docs.select(packed(docs.select(*carry)).alias("row"), text_of(text).alias("text"))
    found = rows.mapInArrow(scan, T.StructType([rows.schema["row"], *FOUND]))
    longest = F.array_max(F.transform("spans", lambda s: s["end"] - s["start"]))
    bad = (F.col("n_hit") > 0) & (limits.share * F.col("n_hit") >= F.col("n_words"))
    if limits.max_run:
        bad = bad | F.coalesce(longest > limits.max_run, F.lit(False))
    return found.withColumn("contaminated", bad)


def drop_contaminated(docs: DataFrame, items: DataFrame, limits: Limits = Limits(), text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, as they were."""
    return find(docs, items, limits, text=text).where(~F.col("contaminated")).select("row.*")


def cut_spans(docs: DataFrame, items: DataFrame, limits: Limits = Limits(), text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``clean_text``: the text without the words of hit spans and what stands between
    these words; a contaminated document's is null, as is a null text's."""
    found = find(docs, items, limits, text=text)
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    body = F.col(f"row.{text}")

    def without(words_and_gaps):
        words, gaps = words_and_gaps["words"], words_and_gaps["gaps"]
        hit = lambda i: F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"]))
        inner = lambda i: hit(i) & hit(i - 1)
        parts = F.transform(words, lambda w, i: F.when(inner(i), F.lit("")).otherwise(F.concat(F.get(gaps, i), F.when(hit(i), F.lit("")).otherwise(w))))
        return F.concat(F.array_join(parts, ""), F.element_at(gaps, -1))

    split = F.struct(F.regexp_extract_all(body, F.lit(word), F.lit(0)).alias("words"), F.split(body, word, -1).alias("gaps"))
    clean = F.when(F.size("spans") == 0, body).otherwise(let(split, without))
    return found.select("row.*", F.when(~F.col("contaminated"), clean).alias("clean_text"))
