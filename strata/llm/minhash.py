"""Near-duplicates by an inverted join of the coordinates of MinHash signatures.

Documents with the same words are one class, and only one of a class goes on. Each class posts its
signature's coordinates; values that only one class has are dropped, as they can match nothing. A pair
above the similarity agrees in ``least`` of the ``size`` coordinates (but for a chance of ``miss``), so if
each class orders its coordinates from the rarest value to the most frequent, one of the first
``size - least + 1`` is common to both: only these prefixes are joined, and the long lists of frequent
values are skipped. A pair's collisions are counted over the lists that join it; where these are too few to tell, the
lists that were skipped are merged too. Pairs below ``least`` go, and the rest are confirmed on their full sets of shingles.

A value that very many classes share is not joined with itself. Its classes are first compared with the
one whose values are the most common of all, the centre of the group if there is one. Lists that this leaves in
more than one component give the classes that are left to compare. Of these, only pairs from different components
can add anything, and only those whose full sets agree early: tokens are ordered from the rarest to the most
frequent, and a pair must have its first common token so early in both sets that the overlap can still be
reached. Sizes are joined in buckets, so a set meets only those of a size that its place leaves possible.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import hot_keys, packed, spread_join, stored, text_of
from strata.llm.graph import components
from strata.llm.tokens import LOWER, coded_words, hash_each, mix, run_hashes, slices
from strata.streaming.replay import numbered


@dataclass(frozen=True)
class Near:
    """Links join sets of word shingles with ``100 * intersection >= percent * union``."""

    shingle: int = 5
    percent: int = 80
    size: int = 48
    miss: float = 1e-7
    #: Tables of ids of at most so many rows are broadcast; larger ones are joined by shuffle.
    broadcast_ids: int = 500_000

    @property
    def least(self) -> int:
        """The most matches that a pair just at the similarity reaches but for a chance of ``miss``."""
        p, below = self.percent / 100, 0.0
        for t in range(self.size + 1):
            below += math.comb(self.size, t) * p**t * (1 - p) ** (self.size - t)
            if below > self.miss:
                return max(1, t)
        return self.size


def shingle_sets(texts: pa.Array, n: int) -> tuple[list[np.ndarray], np.ndarray, list[bytes]]:
    """(sorted distinct shingle hashes of each text, their number, a 128-bit hash of the words)."""
    offsets, codes, words = coded_words(texts, LOWER)
    hashes = hash_each(words)[codes]
    runs = run_hashes(hashes, n)
    sets, keys = [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        own = hashes[a:b]
        keys.append(xxhash.xxh3_128_digest(own.tobytes()))
        if b - a >= n:
            sets.append(np.unique(runs[a : b - n + 1]))
        else:  # fewer words than a shingle has: all of them are one, which equals no longer one
            sets.append(mix(run_hashes(own, b - a)[:1] + np.uint64(b - a)) if b > a else own)
    return sets, np.array([len(s) for s in sets], np.int64), keys


def signatures(sets: list[np.ndarray], sizes: np.ndarray, k: int) -> np.ndarray:
    """The signature of each set that isn't empty; a value tells its coordinate too."""
    full = sizes > 0
    if not full.any():
        return np.empty((0, k), np.int64)
    values, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    seeds = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.empty((int(full.sum()), k), np.uint64)
    for j in range(k):
        least = np.minimum.reduceat((values ^ seeds[j]) * (seeds[k + j] | np.uint64(1)), starts)
        out[:, j] = mix(least + seeds[j])
    return out.view(np.int64)


def sign(docs: DataFrame, near: Near, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``words`` (hash of the word sequence), ``n`` (size of the set) and ``sig`` (null without words)."""
    n, k = near.shingle, near.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, most_bytes=1_500_000):
                sets, sizes, keys = shingle_sets(part.column(1), n)
                sig = signatures(sets, sizes, k)
                ends = np.concatenate([[0], np.cumsum((sizes > 0) * k)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(sig.ravel()), mask=pa.array(sizes == 0))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(sizes), lists], ["id", "words", "n", "sig"])

    rows = docs.select(F.col(key).cast("long").alias("id"), text_of(text).alias("text"))
    return rows.mapInArrow(run, "id long, words binary, n long, sig array<long>")


def _only(docs: DataFrame, ids: DataFrame, near: Near, how: str = "left_semi", key: str = "id") -> DataFrame:
    ids = ids.select(F.col("id").alias("_id"))
    if ids.count() <= near.broadcast_ids:
        ids = F.broadcast(ids)
    return docs.join(ids, F.col(key) == F.col("_id"), how)


def full_sets(docs: DataFrame, ids: DataFrame, near: Near, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``set`` (shingle hashes) of the documents with the given ids."""
    n = near.shingle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, most_bytes=1_500_000):
                sets, sizes, _ = shingle_sets(part.column(1), n)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                values = np.concatenate(sets).view(np.int64) if len(sets) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["id", "set"])

    rows = docs.select(F.col(key).cast("long").alias("id"), text_of(text).alias("text"))
    return _only(rows, ids, near).mapInArrow(run, "id long, set array<long>")


def _confirm(pairs: DataFrame, own: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """The pairs (``a``, ``b``, ``seen``: collisions counted so far) that collide in enough coordinates and whose full sets are similar
    enough. ``own`` has the posting lists of each class, those that its prefix skips too."""
    lists = own.select("id", F.col("values.value").alias("lists"))
    pairs = pairs.join(lists.toDF("a", "la"), "a").join(lists.toDF("b", "lb"), "b")
    agree = F.when(F.col("seen") >= near.least, F.col("seen")).otherwise(F.size(F.array_intersect("la", "lb")))
    pairs = pairs.where(agree >= near.least).select("a", "b")
    pairs = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    both = F.size(F.array_intersect("x", "y")).cast("long")
    pairs = pairs.select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), both.alias("both"))
    return pairs.where(100 * F.col("both") >= near.percent * (F.col("nx") + F.col("ny") - F.col("both"))).select("a", "b")


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def links(docs: DataFrame, classes: DataFrame, near: Near, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``a``, ``b``: links between classes; enough of them to join all that any links join."""
    t = near.least
    posted = classes.select("id", F.explode("sig").alias("value"))
    shared = posted.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(shared, "shared")
    own = spread_join(posted, shared, ["value"], hot_keys(shared, "value")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("values"))
    own = own.where(F.size("values") >= t).withColumn("weight", F.aggregate("values", F.lit(0).cast("long"), lambda s, v: s + v["n"]))
    own = stored(own, "prefixes")

    # a list is the classes that have a value in their prefixes
    lists = own.select("id", "weight", F.explode(F.slice(F.col("values.value"), F.lit(1), F.size("values") - (t - 1))).alias("list"))
    centres = lists.groupBy("list").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    centres = stored(centres.select("list", (-F.col("top.id")).alias("centre"), "n"), "centres")
    lists = stored(spread_join(lists, centres.drop("n"), ["list"], hot_keys(centres, "list")).select("id", "list", "centre"), "lists")
    sets = stored(full_sets(docs, stored(lists.select("id").distinct(), "ids"), near, key, text), "sets")
    pairs = lists.where("id <> centre").select(*_ordered("id", "centre")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("seen"))
    found = stored(_confirm(pairs, own, sets, near), "centre-links")

    rows = lists.select("list", "id").join(components(found), "id", "left").withColumn("component", F.coalesce("component", "id"))
    rows = stored(rows, "components")
    mixed = rows.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    mixed = stored(mixed.select("list", "n"), "mixed-lists")
    left = stored(spread_join(rows, mixed.select("list"), ["list"], hot_keys(mixed, "list")).select("id", "component").distinct(), "left")
    more = stored(_early_pairs(sets.join(left, "id"), near), "early-pairs").withColumn("seen", F.lit(0))
    more = _confirm(more, own, sets, near)
    return stored(found.union(more), "links")


def _early_pairs(sets: DataFrame, near: Near) -> DataFrame:
    """``a``, ``b``: pairs of ``id``, ``component``, ``set`` from different components whose sets may be similar enough,
    as far as their sizes and the places of a common token among their rarest tokens tell."""
    p, q = near.percent, 100 + near.percent
    tokens = stored(sets.select("id", F.explode("set").alias("token")), "tokens")
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranked = tokens.join(often, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("tokens"))
    # tokens of one set only come first: they have places, but can match nothing
    rows = sets.select("id", "component", F.size("set").alias("size")).join(ranked, "id")
    reach = F.col("size") - F.ceil(F.col("size") * p / 100) + 1
    alone = F.col("size") - F.size("tokens")
    rows = rows.select("id", "component", "size", alone.alias("alone"), F.posexplode(F.slice("tokens", F.lit(1), F.greatest(F.lit(0), (reach - alone).cast("int")))).alias("i", "t"))
    rows = stored(rows.select("id", "component", "size", (F.col("alone") + F.col("i")).alias("place"), F.col("t.token").alias("token")), "places")

    bucket = lambda n: F.floor(F.log(n) / F.log(F.lit(1.02))).cast("int")
    shorter = rows.where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * 2 * p / q)).withColumn("bucket", bucket(F.col("size")))
    # with its first common token here, the other set has at most so many tokens, and at least the share of these
    most = F.least(F.col("size"), F.floor((F.col("size") - F.col("place")) * q / p - F.col("size")))
    longer = rows.withColumns({"most": most, "least": F.ceil(F.col("size") * p / 100)}).where("least <= most")
    longer = longer.withColumn("bucket", F.explode(F.sequence(bucket(F.col("least")), bucket(F.col("most")))))
    # of a list, nearly all may be of one component: its rows only meet those of others
    each = shorter.select("token", "bucket", "component").union(longer.select("token", "bucket", "component")).groupBy("token", "bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    main = each.groupBy("token", "bucket").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").drop("kinds")
    main = stored(main, "mixed")
    x, y = (df.join(main, ["token", "bucket"]) for df in (shorter, longer))
    same = ["token", "bucket"]
    enough = (1 + F.least(F.col("x.size") - F.col("x.place") - 1, F.col("y.size") - F.col("y.place") - 1)) * q >= (F.col("x.size") + F.col("y.size")) * p
    fits = (F.col("x.size") <= F.col("y.size")) & (F.col("x.component") != F.col("y.component")) & enough
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in same]
    one = x.where("component = main").alias("x").join(y.where("component <> main").alias("y"), [*on, fits])
    two = x.where("component <> main").alias("x").join(y.alias("y"), [*on, fits])
    return one.select(*_ordered("x.id", "y.id")).union(two.select(*_ordered("x.id", "y.id"))).distinct()


def near_duplicates(docs: DataFrame, near: Near = Near(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, ``n_shingles``, ``component_id`` (the least key reachable) and ``kept``.

    A text with fewer words than a shingle is one shingle; a null text or one without words has none and is
    linked with nothing. Repeated rows get the same component. A row with a null key is never dropped. Keys name documents: if a key repeats with
    another text, both texts count as one document, compared by one of them.
    """
    signed = stored(sign(docs, near, key, text), "signed")
    classes = signed.where("n > 0").groupBy("words").agg(F.min("id").alias("id"), F.first("sig").alias("sig"))
    classes = stored(classes, "classes")
    groups = components(links(docs, classes.select("id", "sig").dropDuplicates(["id"]), near, key, text))
    named = classes.select("words", F.col("id").alias("first")).join(groups, F.col("first") == F.col("id"), "left")
    named = named.select("words", F.coalesce("component", "first").alias("component"))
    # rows without words keep their own key; the others of a class look up its component
    out = signed.drop("sig").join(named, (signed["words"] == named["words"]) & (signed["n"] > 0), "left")
    out = out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, near: Near = Near(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each component, the one with the least key, as they were.

    Where keys are null or repeat, rows are documents of their own: they are numbered by key (nulls last, ties by text), and the
    first row of a component stays. So a row goes only if its own text is like that of a row that stays; texts without words all
    stay. An empty table has no rows; further columns are carried, whatever their names.
    """
    n = docs.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    if n.where(F.col(key).isNull() | (F.col("n") > 1)).isEmpty():
        gone = near_duplicates(docs, near, key, text).where("not kept").select(F.col(key).alias("id"))
        return _only(docs, stored(gone, "near"), near, "left_anti", key)
    rows = docs.select(packed(docs).alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    rows = numbered(rows.withColumn("unknown", F.col("key").isNull()), ["unknown", "key", "text"])
    rows = stored(rows.select("place", "text", "row"), "numbered")
    gone = near_duplicates(rows, near, "place").where("not kept").select(F.col("place").alias("id"))
    return _only(rows, stored(gone, "near"), near, "left_anti", "place").select("row.*")
