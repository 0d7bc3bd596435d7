"""Mixing sources to target weights by a splitting tree over blocks of documents.

Documents fall into blocks of their source by a hash of their id. A source's target is met by whole
passes over its blocks and, for the rest, by its blocks in a permuted order; in the block where the rest
ends, documents are drawn in hash order, and one document that fits best what is then missing. Every drawn block is one unit,
and the number of a source's units is its quota. The tree splits the quotas among the output shards: each node
draws how many units of each source its left half gets of all that the half holds, from the multivariate hypergeometric
distribution, one source after the other; so the quotas stay exact. Each shard then takes its quota of
the source's permuted units, no two shards the same ones, and its documents are put in a hashed order. Everything is DataFrame
expressions over the sums of blocks; documents themselves are only joined to the short table of drawn blocks.

Nulls: a null source is one of its own, after all others; a null text has no words, and such documents are drawn like
others but add nothing; a null id is an id like any other. Documents of one id and source are drawn together or not at all, so
repeated rows are drawn alike. Where hashes are equal, the blocks' names decide. A source without words gives nothing; an empty
table gives an empty mix. Very long texts are one row each.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import WORD, let, packed, stored, text_of


@dataclass(frozen=True)
class Mix:
    """Sources in code-point order, null last, take the weights in turn, over and over."""

    weights: tuple[int, ...] = (5, 2, 1)
    #: What all sources give together, in percent of what there is; and the passes one source gives at most.
    percent: int = 150
    max_passes: int = 2
    #: The least number of output shards, a power of two, and the words of the mix above which a shard is halved.
    shards: int = 8
    shard_words: int = 1 << 28
    #: Blocks of a source: 16 to the power of ``block_digits``, or more digits if a block would have more words than this.
    block_digits: int = 2
    block_words: int = 1 << 22
    seed: str = "mix"

    #: Tables of drawn blocks of at most so many rows are broadcast; larger ones are joined by shuffle.
    broadcast_rows: int = 50_000


def _hash(mix: Mix, *parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", F.lit(mix.seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 16)


def sized(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``row``, and of each document ``size`` (words; null text: 0), ``source`` and ``h`` (hash)."""
    return docs.select(packed(docs).alias("row"), F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("size"), F.col(source).cast("string").alias("source"), _hash(mix, F.col(key)).alias("h"))


def fitted(sizes: DataFrame, mix: Mix = Mix()) -> Mix:
    """``mix`` with as many blocks and shards as the words of ``sizes`` (of ``sized``) ask for."""
    most, every = sizes.groupBy("source").agg(F.sum("size").alias("n")).agg(F.max("n"), F.sum("n")).first()
    digits, shards = mix.block_digits, mix.shards
    while 16**digits * mix.block_words < (most or 0):
        digits += 1
    while shards * mix.shard_words < (every or 0) * mix.percent / 100:
        shards *= 2
    return replace(mix, block_digits=digits, shards=shards)


def blocked(sizes: DataFrame, mix: Mix) -> DataFrame:
    return sizes.withColumn("block", F.substring("h", 1, mix.block_digits))


def targets(blocks: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``source``, ``source_size`` and ``target``: the share by weight of what all give, at most
    ``max_passes`` times the source, with what exceeds that shared anew by weight among the others.

    The least level at which the sources that it doesn't fill take up the rest: sources in order of
    the level that fills them, each with the level that the ones before it leave. One row a source, so
    the windows over all rows are over a short table.
    """
    sums = blocks.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(mix.weights)))
    sums = sums.withColumn("weight", F.get(F.array(*map(F.lit, mix.weights)), turn).cast("double"))
    sums = sums.withColumn("most", (mix.max_passes * F.col("source_size")).cast("double"))
    before = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    gives = F.sum("source_size").over(every) * mix.percent / 100.0
    level = (gives - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    sums = sums.withColumn("level", level)
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(every)["level"]
    return sums.select("source", "source_size", F.least(F.col("most"), F.coalesce(level * F.col("weight"), F.col("most"))).alias("target"))


def drawn(rows: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row for each source and block: ``source_size``, ``target``, ``passes`` (whole ones), ``cut``
    (documents with a hash up to it are drawn once more; null: none), ``last`` (so is the one with this
    hash) and ``shards`` (one for each draw)."""
    blocks = stored(rows.groupBy("source", "block").agg(F.sum("size").alias("size")), "blocks")
    goals = targets(blocks, mix)
    same = Window.partitionBy("source")
    plan = blocks.alias("b").join(goals.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select("b.*", "g.source_size", "g.target")
    plan = plan.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
    plan = plan.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    upto = F.sum("size").over(same.orderBy(_hash(mix, F.col("source"), F.col("block")), "block").rowsBetween(Window.unboundedPreceding, 0))
    plan = plan.withColumn("left", F.col("rest") - (upto - F.col("size")))
    plan = plan.withColumn("part", F.when((F.col("left") >= F.col("size")) & (F.col("rest") > 0), "all").when(F.col("left") > 0, "cut"))
    plan = stored(plan, "plan")

    # at most one block of a source is cut: its documents in hash order, those of one hash together
    cut = plan.where("part = 'cut'").select(F.col("source").alias("s"), F.col("block").alias("b"), "left")
    docs = rows.join(cut, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    docs = docs.groupBy("s", "b", "left", "h").agg(F.sum("size").alias("size"))
    until = F.sum("size").over(Window.partitionBy("s", "b").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    cuts = docs.withColumn("upto", until).where(F.col("upto") - F.col("size") / 2 <= F.col("left")).groupBy("s", "b").agg(F.max("h").alias("cut"), F.max("upto").alias("got"))
    plan = plan.join(cuts, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left").drop("s", "b")
    plan = plan.withColumn("cut", F.when(F.col("part") == "all", F.lit("g")).when(F.col("part") == "cut", F.col("cut")))  # "g" is beyond all hex digits
    got = F.when(F.col("part") == "all", F.col("size")).when(F.col("part") == "cut", F.coalesce("got", F.lit(0))).otherwise(F.lit(0))
    plan = stored(plan.withColumn("short", F.col("rest") - F.sum(got).over(same)).drop("got"), "cut")
    plan = plan.join(_last(rows, plan), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left").drop("s", "b")
    units = plan.withColumn("draw", F.explode(F.sequence(F.lit(0), F.col("passes")))).where((F.col("draw") < F.col("passes")) | F.col("cut").isNotNull() | F.col("last").isNotNull())
    units = stored(units.select("source", "block", "draw"), "units")
    dealt = dealt_units(units, deal(units, mix), mix).groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("draw", "shard"))).alias("dealt"))
    plan = plan.alias("p").join(dealt.alias("d"), F.col("p.source").eqNullSafe(F.col("d.source")) & (F.col("p.block") == F.col("d.block")), "left")
    return plan.select("p.source", "p.block", "source_size", "target", "passes", "cut", "last", F.coalesce(F.col("dealt.shard"), F.array().cast("array<int>")).alias("shards"))


def _last(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``s``, ``b``, ``last``: of each source the one document not drawn that brings the rest nearest to its quota."""
    plan = plan.where("rest > 0").select(F.col("source").alias("s"), F.col("block").alias("b"), "cut", "short")
    left = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")) & (F.col("cut").isNull() | (F.col("h") > F.col("cut"))))
    best = left.groupBy("s", "short").agg(F.min(F.struct(F.abs(F.col("short") - F.col("size")).alias("off"), "h", "b")).alias("best"))
    best = best.select(F.col("s").alias("ls"), F.col("best.b").alias("lb"), F.col("best.h").alias("last"))
    # rows that repeat an id are drawn together or not at all
    same = left.join(best, F.col("s").eqNullSafe(F.col("ls")) & (F.col("b") == F.col("lb")) & (F.col("h") == F.col("last")))
    same = same.groupBy("s", "b", "last", "short").agg(F.sum("size").alias("adds"))
    return same.where(F.abs(F.col("short") - F.col("adds")) < F.abs("short")).select("s", "b", "last")


def hypergeometric(total: Column, n: Column, left: Column, u: Column) -> Column:
    """The ``u``-quantile of how many of ``n`` marked units are among ``left`` drawn of ``total``. Weights are built up from one
    number to the next, over twelve deviations to both sides of the mean, beyond which nothing is left in double precision."""
    mean = left * n / total
    spread = F.ceil(12 * F.sqrt(mean * (1 - n / total) * (total - left) / F.greatest(total - 1, F.lit(1)))) + 12
    low = F.greatest(F.lit(0), left - (total - n), F.floor(mean) - spread)
    high = F.least(n, left, F.floor(mean) + spread)

    def next_weight(w: Column, k: Column) -> Column:
        up, down = (n - k).cast("double") * (left - k), (k + 1).cast("double") * (total - n - left + k + 1)
        return w * up / down

    def drawn_from(range_: Column) -> Column:
        zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        every = F.aggregate(range_, zero, lambda a, k: F.struct(next_weight(a["w"], k).alias("w"), (a["sum"] + a["w"]).alias("sum")), lambda a: a["sum"])

        def find(goal: Column) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("k"))
            step = lambda a, k: F.struct(
                next_weight(a["w"], k).alias("w"), (a["sum"] + a["w"]).alias("sum"), F.when((a["k"] < 0) & (a["sum"] + a["w"] >= goal), k).otherwise(a["k"]).alias("k"))
            return F.aggregate(range_, start, step, lambda a: F.when(a["k"] < 0, F.element_at(range_, -1)).otherwise(a["k"]))

        return let(u * every, find)

    return F.when(total == 0, F.lit(0).cast("long")).otherwise(let(F.sequence(low.cast("long"), high.cast("long")), drawn_from))


def _uniform(hashed: Column) -> Column:
    """A number in (0, 1) of the first twelve hex digits of a hash."""
    return (F.conv(F.substring(hashed, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


QUOTAS = "array<struct<last:boolean,source:string,n:bigint>>"


def deal(units: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``shard``, ``source``, ``n``: how many of each source's units each shard gets; quotas of no units are left out.

    The tree has a row a node with the quotas of all sources: sources and shards, not units. At each node the left half has half of
    all units (of an odd number, the node's hash decides which half gets one more).
    """
    quotas = units.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    tree = quotas.agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "n"))).cast(QUOTAS).alias("q")).select(F.lit(0).alias("shard"), "q")
    width = mix.shards
    while width > 1:
        width //= 2
        tree = tree.withColumn("total", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
        odd = F.conv(F.substring(_hash(mix, F.lit(width), F.col("shard")), 1, 1), 16, 10).cast("long") % 2
        tree = tree.withColumn("half", F.floor((F.col("total") + odd) / 2))
        start = F.struct(F.col("total").alias("total"), F.col("half").alias("left"), F.array().cast("array<bigint>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            u = _uniform(_hash(mix, F.lit("split"), F.lit(width), F.col("shard"), x["source"]))
            k = hypergeometric(acc["total"], x["n"], acc["left"], u)
            return let(k, lambda k: F.struct((acc["total"] - x["n"]).alias("total"), (acc["left"] - k).alias("left"), F.concat(acc["out"], F.array(k)).alias("out")))

        tree = tree.withColumn("got", F.aggregate("q", start, step, lambda a: a["out"]))
        own = lambda n: F.zip_with("q", "got", lambda x, k: F.struct(x["last"].alias("last"), x["source"].alias("source"), n(x, k).alias("n"))).cast(QUOTAS)
        halves = F.array(F.struct(F.col("shard").alias("shard"), own(lambda x, k: k).alias("q")), F.struct((F.col("shard") + width).alias("shard"), own(lambda x, k: x["n"] - k).alias("q")))
        tree = stored(tree.select(F.inline(halves)), "tree")
    return tree.select("shard", F.inline("q")).where("n > 0").select("shard", "source", "n")


def dealt_units(units: DataFrame, quotas: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``units`` (``source``, ``block``, ``draw``) with their ``shard``: each shard takes its quota from where the one before it ended, in
    the source's permuted order."""
    cumulated = quotas.groupBy(F.col("source").alias("qs")).agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("q"))
    ends = F.aggregate("q", F.array().cast("array<struct<shard:int,end:bigint>>"), lambda a, x: F.concat(a, F.array(F.struct(x["shard"].cast("int").alias("shard"), (F.coalesce(F.try_element_at(a, F.lit(-1))["end"], F.lit(0)) + x["n"]).alias("end")))))
    cumulated = cumulated.select("qs", ends.alias("ends"))
    order = Window.partitionBy("source").orderBy(_hash(mix, F.lit("unit"), F.col("source"), F.col("block"), F.col("draw")), "block", "draw")
    out = units.withColumn("place", F.row_number().over(order)).join(cumulated, F.col("source").eqNullSafe(F.col("qs")))
    shard = F.get(F.filter("ends", lambda e: e["end"] >= F.col("place")), F.lit(0))["shard"]
    return out.withColumn("shard", shard).drop("place", "qs", "ends")


def placed(rows: DataFrame, plan: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``rows`` (of ``sized``) with ``source_size``, ``target`` and ``shards``: one for each time it is drawn.

    A document of a source with no words is never drawn. Repeated rows are drawn alike. Reruns agree.
    """
    plan = plan.withColumnRenamed("source", "s").withColumnRenamed("block", "b")
    if plan.count() <= mix.broadcast_rows:
        plan = F.broadcast(plan)
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    more = F.coalesce(F.col("h") <= F.col("cut"), F.lit(False)) | F.coalesce(F.col("h") == F.col("last"), F.lit(False))
    n = F.col("passes") + more.cast("int")
    return out.select(*rows.columns, "source_size", "target", F.slice("shards", F.lit(1), n).alias("shards"))


def emitted(rows: DataFrame, plan: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The columns of ``rows`` (of ``sized``) and ``shard``: each row as often as it is drawn, by shard and in a hashed order there."""
    out = placed(rows, plan, mix).select(*rows.columns, F.posexplode("shards").alias("draw", "shard"))
    order = _hash(mix, F.lit("order"), F.col("h"), F.col("draw"))
    # a shard can be larger than a task should be: its hashed order is cut into ranges
    return out.withColumn("order", order).repartitionByRange("shard", "order").sortWithinPartitions("shard", "order").select(*rows.columns, "shard")


def mix_documents(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of the mix: those of ``docs``, each as often as it is drawn, by shard and in a hashed order there.

    A null source is a source like others, the last in order. A text that is null or has no word has size 0; a source of
    such alone is never drawn. Rows that repeat an id are drawn together or not at all, and of documents with one hash all
    are. Very long texts are drawn whole: they are only counted here. An empty table gives an empty mix; all columns of
    ``docs`` are kept as they are, whatever their names.
    """
    rows = sized(docs, mix, key, text, source)
    sizes = stored(rows.drop("row"), "sized")
    mix = fitted(sizes, mix)
    plan = stored(drawn(blocked(sizes, mix), mix), "drawn")
    return emitted(blocked(rows, mix), plan, mix).select("row.*")


def accounted(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per document: key, ``size``, ``source_size``, ``target``, ``taken`` (words that the mix has of it), ``shards`` (where they are, a
    shard for each time the document is there, joined by commas) and ``source``.

    The mix is made, texts and all; of each row that it emits, the key, the shard and the words of its text are written, by shard in
    their order, and ``taken`` and ``shards`` are gathered from what was written. Rows of one key, source and size share ``taken``
    evenly and have the shards of all of them.
    """
    rows = sized(docs, mix, key, text, source)
    sizes = stored(rows.select(F.col(f"row.`{key}`").alias("key"), "size", "source", "h"), "sized")
    mix = fitted(sizes, mix)
    sizes = blocked(sizes, mix)
    plan = stored(drawn(sizes, mix), "drawn")
    words = F.regexp_count(F.coalesce(F.col(f"row.`{text}`").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    mixed = stored(emitted(blocked(rows, mix), plan, mix).select("shard", F.col(f"row.`{key}`").alias("k"), F.col("source").alias("s"), words.alias("n")), "mix")
    # counted by shard first, so rows that repeat a key very often are few numbers
    by_shard = mixed.groupBy("k", "s", "n", "shard").agg(F.count(F.lit(1)).alias("times"))
    found = by_shard.groupBy("k", "s", "n").agg(F.sum(F.col("n") * F.col("times")).alias("words"), F.sort_array(F.collect_list(F.struct("shard", "times"))).alias("in"))
    same = sizes.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    alike = F.col("key").eqNullSafe(F.col("k")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("n"))
    each = F.flatten(F.transform("in", lambda x: F.array_repeat(x["shard"].cast("string"), F.ceil(x["times"] / F.col("rows")).cast("int"))))
    got = found.join(same, alike).select("k", "s", "n", F.expr("words div rows").alias("taken"), F.array_join(each, ",").alias("shards"))
    goals = plan.select(F.col("source").alias("gs"), "source_size", "target").distinct()
    out = sizes.join(got, alike, "left").join(goals, F.col("source").eqNullSafe(F.col("gs")))
    return out.select(F.col("key").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", F.lit("")).alias("shards"), "source")
