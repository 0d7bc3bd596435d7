"""Substring dedup: passages of a minimum length that an earlier document has too are cut from later ones.

Seeds are winnowed anchors: of every window of ``window`` words, the run of ``anchor`` words with the least hash, so
a window that two documents share has the same anchor in both. Anchors of one document only are dropped. Each other
occurrence of an anchor is joined with the anchor's first one, both with the words around them as far as its own
windows reach. The match is extended from the anchor to the left and to the right, word by word, and where it
is long enough it is one interval of the later document. Windows at an anchor that its first occurrence's match doesn't
cover may be in another earlier document: these few are joined twice more, by all words around the anchor and by those
of the window alone, where a hash tells that there are others like it. Intervals are merged into maximal ones, and these are cut.

No pair of documents but one with the first is ever made, so a passage that very many documents share costs a row for each of
them; anchors that hold a part of all rows are joined by broadcast where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import hot_keys, spread_join, stored, text_of
from strata.llm.files import opened
from strata.llm.tokens import PLAIN, coded_words, hash_each, run_hashes, slices


#: Ids from here on stand for null keys: such rows are later than all others.
NULLS = 2**62


@dataclass(frozen=True)
class Repeats:
    window: int = 13
    anchor: int = 5
    #: Shared anchors of at most so many are looked up in the tasks that scan the texts; more are joined by shuffle.
    lookup: int = 4_000_000
    #: Tables of ids of at most so many rows are broadcast; larger ones are joined by shuffle.
    broadcast_ids: int = 500_000


class Anchors:
    """The anchors of a batch of texts, each place once: ``place`` (in the words of the batch), ``text`` (the row), ``hash``, and
    ``first`` and ``last``, the starts of the windows that it is the anchor of."""

    def __init__(self, texts: pa.Array, how: Repeats):
        self.offsets, self.codes, self.words = coded_words(texts, PLAIN)
        hashes = hash_each(self.words)[self.codes]
        n, size = len(hashes), how.window
        text = np.repeat(np.arange(len(texts)), np.diff(self.offsets))
        start = np.flatnonzero(text[: max(0, n - size + 1)] == text[size - 1 :]) if n >= size else np.empty(0, np.int64)
        runs = run_hashes(hashes, how.anchor)
        place = start.copy()
        for k in range(1, size - how.anchor + 1):
            place = np.where(runs[start + k] < runs[place], start + k, place)
        # of equal hashes the leftmost counts, so the windows of one anchor follow each other
        self.place, at, n_windows = np.unique(place, return_index=True, return_counts=True)
        self.text, self.hash = text[self.place], runs[self.place].view(np.int64)
        self.first = start[at]
        self.last = self.first + n_windows - 1

    def passage(self, start: np.ndarray, end: np.ndarray) -> pa.Array:
        """The words from each start to each end with one space between."""
        lengths = end - start
        ends = np.cumsum(lengths)
        at = np.repeat(start - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        words = self.words.take(pa.array(self.codes[at])).cast(pa.string())
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), words), " ")


def _seeds(rows: DataFrame, how: Repeats) -> DataFrame:
    """``hash``, ``id``, ``pos``: the anchors of each document, each place once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, most_bytes=1_000_000):
                a = Anchors(part.column(1), how)
                ids = part.column(0).take(pa.array(a.text))
                yield pa.RecordBatch.from_arrays([pa.array(a.hash), ids, pa.array((a.place - a.offsets[a.text]).astype(np.int32))], ["hash", "id", "pos"])

    return rows.mapInArrow(run, "hash long, id long, pos int")


_tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _read_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The sorted anchors of a table and the first document of each; one table is kept in a worker."""
    if path not in _tables:
        _tables.clear()
        system, top = opened(path)
        files = [f.path for f in system.get_file_info(pafs.FileSelector(top)) if f.path.endswith(".parquet")]
        parts = [pq.read_table(f, filesystem=system, columns=["hash", "lo"]) for f in files]
        hashes = np.concatenate([p["hash"].to_numpy() for p in parts]) if parts else np.empty(0, np.int64)
        order = np.argsort(hashes)
        firsts = np.concatenate([p["lo"].to_numpy() for p in parts]) if parts else hashes
        _tables[path] = hashes[order], firsts[order]
    return _tables[path]


#: Roles of an occurrence: it is in a later document, or in the anchor's first one as the first or a further place there.
LATER, OPENS, AGAIN = 0, 1, 2
OCCURRENCES = "hash long, id long, pos int, first int, last int, role byte, left string, right string"


def _roles(text: np.ndarray, hashes: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """The role of each occurrence. They come by place, and ``opens`` tells those in the anchor's first document."""
    out, at = np.full(len(text), LATER, np.int8), np.flatnonzero(opens)
    at = at[np.lexsort((hashes[at], text[at]))]
    known = (text[at][1:] == text[at][:-1]) & (hashes[at][1:] == hashes[at][:-1])
    out[at[:1]] = OPENS
    out[at[1:]] = np.where(known, AGAIN, OPENS)
    return out


def _occurrences(rows: DataFrame, how: Repeats, path: str | None) -> DataFrame:
    """The places of shared anchors: ``hash``, ``id``, ``pos``, the windows they are the anchor of (``first`` and ``last`` start),
    ``role``, ``left`` (the words of these windows up to the anchor's end) and ``right`` (those behind it).
    Anchors are looked up in the table at ``path``, or come in the columns ``places`` and ``firsts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, most_bytes=1_000_000):
                a = Anchors(part.column(1), how)
                ids = part.column(0).to_numpy()
                if path is not None:
                    known, firsts = _read_table(path)
                    at = np.minimum(np.searchsorted(known, a.hash), max(0, len(known) - 1))
                    chosen = np.flatnonzero(known[at] == a.hash) if len(known) else np.empty(0, np.int64)
                    lo = firsts[at[chosen]]
                else:
                    places = part.column(2)
                    counts = np.diff(places.offsets.to_numpy())
                    shared = places.flatten().to_numpy() + np.repeat(a.offsets[:-1], counts)
                    order = np.argsort(shared)
                    shared, firsts = shared[order], part.column(3).flatten().to_numpy()[order]
                    at = np.minimum(np.searchsorted(shared, a.place), max(0, len(shared) - 1))
                    chosen = np.flatnonzero(shared[at] == a.place) if len(shared) else np.empty(0, np.int64)
                    lo = firsts[at[chosen]]
                text, place = a.text[chosen], a.place[chosen]
                begin, after = a.offsets[text], place + how.anchor
                small = lambda x: pa.array((x - begin).astype(np.int32))
                columns = [
                    pa.array(a.hash[chosen]), pa.array(ids[text]), small(place), small(a.first[chosen]), small(a.last[chosen]), pa.array(_roles(text, a.hash[chosen], ids[text] == lo)),
                    a.passage(a.first[chosen], after), a.passage(after, a.last[chosen] + how.window),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["hash", "id", "pos", "first", "last", "role", "left", "right"])

    return rows.mapInArrow(run, OCCURRENCES)


def _only(rows: DataFrame, ids: DataFrame, how: Repeats, kind: str) -> DataFrame:
    ids = ids.select(F.col("id").alias("_id"))
    if ids.count() <= how.broadcast_ids:
        ids = F.broadcast(ids)
    return rows.join(ids, F.col("id") == F.col("_id"), kind)


def _alike_only(rows: DataFrame, how: Repeats, *columns: str) -> DataFrame:
    """``rows`` whose ``columns`` have a hash that rows of other documents have too: no others can be equal in them."""
    rows = rows.withColumn("_print", F.xxhash64(*columns))
    prints = rows.groupBy("_print").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    prints = stored(prints.select("_print", "n"), "prints")
    if prints.count() <= how.broadcast_ids:
        return rows.join(F.broadcast(prints.select("_print")), "_print").drop("_print")
    return spread_join(rows, prints.select("_print"), ["_print"], hot_keys(prints, "_print")).drop("_print")


def copies(rows: DataFrame) -> DataFrame:
    """``id`` of the documents whose whole text an earlier one has."""
    texts = rows.select("id", F.md5("text").alias("t"))
    first = stored(texts.groupBy("t").agg(F.min("id").alias("lo"), F.count(F.lit(1)).alias("n")).where("n > 1"), "same")
    return spread_join(texts, first.select("t", "lo"), ["t"], hot_keys(first, "t")).where("id > lo").select("id").distinct()


def _words(text: str) -> Column:
    return F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def _alike(mine: Column, other: Column) -> Column:
    """How many words two lists have in common from their beginning on."""
    differs = F.array_position(F.zip_with(mine, other, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(mine)).cast("int")


def extended(pairs: DataFrame, how: Repeats) -> DataFrame:
    """``start`` and ``end`` of the match of each occurrence with the first one (whose words are ``first_left``, ``first_right``):
    from the anchor outwards as long as words are the same. Without the anchor's own words in common, the match is empty."""
    words = lambda x: F.size(_words(x))
    left = F.when(F.col("left") == F.col("first_left"), words("left")).otherwise(_alike(F.reverse(_words("left")), F.reverse(_words("first_left"))))
    right = F.when(F.col("right") == F.col("first_right"), words("right")).otherwise(_alike(_words("right"), _words("first_right")))
    out = pairs.withColumns({"_l": left, "_r": right}).withColumn("start", F.col("pos") + how.anchor - F.col("_l"))
    end = F.when(F.col("_l") < how.anchor, F.col("start")).otherwise(F.col("pos") + how.anchor + F.col("_r"))
    return out.withColumn("end", end).drop("_l", "_r")


def _rest_windows(pairs: DataFrame, how: Repeats) -> DataFrame:
    """``id``, ``start``, ``words`` of the windows at an anchor that its match (``start`` to ``end``) doesn't cover."""
    every = F.filter(F.sequence("first", "last"), lambda s: (s < F.col("start")) | (s + how.window > F.col("end")))
    rows = pairs.withColumn("_s", F.explode(every)).withColumn("_w", F.concat(_words("left"), _words("right")))
    words = F.array_join(F.slice("_w", F.col("_s") - F.col("first") + 1, F.lit(how.window)), " ")
    return rows.select("id", F.col("_s").alias("start"), words.alias("words"))


def repeated_passages(rows: DataFrame, gone: DataFrame, how: Repeats) -> DataFrame:
    """``id``, ``spans`` (``start``, ``end``): what each document, but for those in ``gone``, shares with an earlier one."""
    seeds = _seeds(rows, how)
    shared = seeds.groupBy("hash").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    shared = stored(shared.select("hash", "lo", "n"), "anchors")
    hot = hot_keys(shared, "hash")
    rows = _only(rows, gone, how, "left_anti")
    if shared.count() <= how.lookup:
        found = _occurrences(rows, how, shared.inputFiles()[0].rpartition("/")[0])
    else:
        places = spread_join(seeds, shared.select("hash", "lo"), ["hash"], hot).groupBy("id").agg(F.collect_set(F.struct("pos", "lo")).alias("p"))
        found = _occurrences(rows.join(places.select("id", F.col("p.pos").alias("places"), F.col("p.lo").alias("firsts")), "id").select("id", "text", "places", "firsts"), how, None)
    found = stored(found, "occurrences")
    # a key that repeats has its first places more than once
    at_first = found.where(F.col("role") == OPENS).groupBy("hash").agg(F.min(F.struct("left", "right")).alias("f"))
    at_first = at_first.select("hash", F.col("f.left").alias("first_left"), F.col("f.right").alias("first_right"))

    later = spread_join(found.where(F.col("role") == LATER).drop("role"), at_first, ["hash"], hot)
    matches = extended(later, how).withColumn("long", F.col("end") - F.col("start") >= how.window)
    # an occurrence goes on if its match is an interval, or leaves a window
    open_ = (~F.col("long")) | (F.col("start") > F.col("first")) | (F.col("end") < F.col("last") + how.window)
    kept = F.when(open_, F.col("left")), F.when(open_, F.col("right"))
    matches = stored(matches.select("id", "pos", "first", "last", "start", "end", "long", open_.alias("open"), kept[0].alias("left"), kept[1].alias("right")), "matches")

    # other places of an anchor in its first document: there is none before them to match, but others may match them
    again = found.where(F.col("role") == AGAIN).withColumns({"start": F.lit(0), "end": F.lit(0)})
    columns = ["id", "pos", "first", "last", "start", "end", "left", "right"]
    none = F.when(F.col("long"), F.col("start")).otherwise(0), F.when(F.col("long"), F.col("end")).otherwise(0)
    left = matches.where("open").withColumns({"start": none[0], "end": none[1]}).select(*columns).unionByName(again.select(*columns))
    # of those with the same words around the anchor, only the first goes on: the others match it as far as they reach
    around = stored(left.groupBy("left", "right").agg(F.min("id").alias("lo"), F.count(F.lit(1)).alias("n")), "around")
    left = stored(spread_join(left, around.select("left", "right", "lo"), ["left", "right"], hot_keys(around, "left", "right")), "left")
    reach = left.where("id > lo").select("id", F.col("first").alias("start"), (F.col("last") + how.window).alias("end"))
    rest = _alike_only(_rest_windows(left.where("id = lo"), how), how, "words")
    rest = stored(rest, "rest")
    first = rest.groupBy("words").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    first = stored(first.select("words", "lo", "n"), "rest-firsts")
    more = spread_join(rest, first.select("words", "lo"), ["words"], hot_keys(first, "words")).where("id > lo")
    spans = matches.where("long").select("id", "start", "end").union(reach).union(more.select("id", "start", (F.col("start") + how.window).alias("end")))
    return spans.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


def _rest(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, list[bytes]]:
    """(words, words cut, words kept) of a text with the given spans."""
    words = text.split()
    cut = np.zeros(len(words) + 1, np.int64)
    np.add.at(cut, starts, 1)
    np.add.at(cut, ends, -1)
    keep = np.cumsum(cut[:-1]) == 0
    return len(words), len(words) - int(keep.sum()), [w for w, k in zip(words, keep.tolist()) if k]


def cut_repeats(docs: DataFrame, how: Repeats = Repeats(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept_text`` (its words that stay, one space
    between them; null where nothing is cut).

    Matches are judged on the input. Null texts have no words. Keys name documents: a row that repeats a key repeats
    its text, and neither is earlier. Rows with a null key come after all others, in an order of their texts' hashes;
    a key of NULLS or more is an error. Very long texts are one row each, and cut as they are.
    """
    body = text_of(text)
    own = F.col(key).cast("long")
    unnamed = F.lit(NULLS) + F.pmod(F.xxhash64(body), F.lit(NULLS))
    own = F.when(own >= NULLS, F.raise_error(F.lit(f"keys must be below {NULLS}")).cast("long")).otherwise(F.coalesce(own, unnamed))
    rows = docs.select(own.alias("id"), body.alias("text"))
    gone = stored(copies(rows), "copies")
    spans = stored(repeated_passages(rows, gone, how), "spans")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, most_bytes=2_000_000):
                words = [t.encode().translate(PLAIN).split() for t in part.column(1).to_pylist()]
                out = [(len(w), hashlib.sha256(b" ".join(w)).hexdigest()) for w in words]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in out], pa.int64()), pa.array([s for _, s in out], pa.string())], ["id", "n_words", "sha"])

    def less(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, most_bytes=2_000_000):
                out = []
                for t, s in zip(part.column(1).to_pylist(), part.column(2)):
                    n, removed, kept = _rest(t.encode().translate(PLAIN), s.values.field(0).to_numpy(), s.values.field(1).to_numpy())
                    body = b" ".join(kept)
                    out.append((n, removed, hashlib.sha256(body).hexdigest(), body.decode()))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))]], ["id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    none = F.sha2(F.lit(""), 256)
    nothing = F.lit(None).cast("string")
    # untouched documents, copies (all words go if they make a window), and those with something cut
    some = _only(rows, spans.select("id"), how, "left_semi").join(spans, "id").select("id", "text", "spans")
    cut = some.mapInArrow(less, "id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    touched = spans.select(F.col("id").alias("i"), F.lit(1).alias("kind")).union(gone.select("id", F.lit(2)))
    plain = rows.mapInArrow(whole, "id long, n_words long, sha string").join(touched, F.col("id") == F.col("i"), "left").where("kind is null or kind = 2")
    all_gone = F.col("kind").isNotNull() & (F.col("n_words") >= how.window)
    plain = plain.select("id", "n_words", F.when(all_gone, F.col("n_words")).otherwise(F.lit(0)).alias("n_removed"), F.when(all_gone, none).otherwise(F.col("sha")).alias("kept_sha256"), F.when(all_gone, F.lit("")).otherwise(nothing).alias("kept_text"))
    out = cut.unionByName(plain)
    return out.select(F.when(F.col("id") < NULLS, F.col("id")).alias(key), "n_words", "n_removed", "kept_sha256", "kept_text")
