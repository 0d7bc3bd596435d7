import math

import pytest
from pyspark.sql import functions as F

from strata.llm import mixing
from tests.llm.common import empty_documents, odd_documents, prose


def corpus(spark, n=400):
    rows = [(i, prose(10 + i * 7 % 90, i), ["a", "b", "c", "d", None, "é"][min(i % 11, 5)]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def water(sizes, percent=150, most=2, weights=(5, 2, 1)):
    """Targets by sharing and resharing until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = sum(sizes.values()) * percent / 100, set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] >= most * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free -= full
    return out


def test_targets_and_taken(spark):
    docs = corpus(spark)
    rows = mixing.blocked(mixing.sized(docs), mixing.Mix()).select("row.doc_id", "size", "source", "h", "block")
    out = mixing.placed(rows, mixing.drawn(rows)).collect()
    assert len(out) == docs.count()
    sizes, taken, largest, target = {}, {}, {}, {}
    for r in out:
        s = r["source"]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["size"] * len(r["shards"])
        largest[s] = max(largest.get(s, 0), r["size"])
        target[s] = r["target"]
        assert len(r["shards"]) <= 2
    want = water(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6
        assert abs(taken[s] - target[s]) <= largest[s]


def test_reruns_agree_and_rows_come_as_often_as_drawn(spark):
    docs = corpus(spark)
    a, b = mixing.mix_documents(docs), mixing.mix_documents(docs.repartition(7))
    assert a.schema == docs.schema
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    rows = mixing.blocked(mixing.sized(docs), mixing.Mix()).drop("row")
    drawn = sum(len(r["shards"]) for r in mixing.placed(rows, mixing.drawn(rows)).collect())
    assert a.count() == drawn


def test_tree_splits_quotas_exactly(spark):
    units = spark.range(1001).selectExpr("nullif(cast(id % 4 as string), '3') as source", "lpad(hex(id), 4, '0') as block", "0 as draw")
    mix = mixing.Mix(shards=8)
    quotas = mixing.deal(units, mix).collect()
    by_shard, by_source = {}, {}
    for r in quotas:
        by_shard[r["shard"]] = by_shard.get(r["shard"], 0) + r["n"]
        by_source[r["source"]] = by_source.get(r["source"], 0) + r["n"]
    assert sorted(by_shard) == list(range(8)) and sum(by_shard.values()) == 1001 and max(by_shard.values()) - min(by_shard.values()) <= 2
    assert by_source == {r["source"]: r["count"] for r in units.groupBy("source").count().collect()}
    # disjoint blocks, each shard's as many of a source as its quota
    dealt = mixing.dealt_units(units, mixing.deal(units, mix), mix).collect()
    assert len({r["block"] for r in dealt}) == len(dealt) == 1001
    got = {}
    for r in dealt:
        got[r["shard"], r["source"]] = got.get((r["shard"], r["source"]), 0) + 1
    assert got == {(r["shard"], r["source"]): r["n"] for r in quotas}


@pytest.mark.parametrize("total, n, left", [(20, 7, 10), (50, 45, 25), (9, 9, 4), (30, 1, 15), (400, 200, 200)])
def test_draws_follow_the_hypergeometric_distribution(spark, total, n, left):
    """The quantiles of evenly spread shares are those of the exact distribution."""
    shares = [(i + 0.5) / 500 for i in range(500)]
    rows = spark.createDataFrame([(u,) for u in shares], "u double")
    args = [F.lit(x).cast("long") for x in (total, n, left)]
    got = [r["k"] for r in rows.select("u", mixing.hypergeometric(*args, F.col("u")).alias("k")).orderBy("u").collect()]
    exact, cumulated = math.comb(total, left), {}
    for k in range(max(0, left - total + n), min(n, left) + 1):
        cumulated[k] = sum(math.comb(n, j) * math.comb(total - n, left - j) for j in range(k + 1)) / exact
    want = [next(k for k, c in cumulated.items() if c >= u - 1e-12) for u in shares]
    assert sum(a != b for a, b in zip(got, want)) <= 1


def test_blocks_and_shards_grow_with_the_words(spark):
    rows = spark.createDataFrame([(10**9, "a"), (10**6, "b")], "size long, source string")
    mix = mixing.fitted(rows, mixing.Mix(shard_words=10**7, block_words=10**5))
    assert mix.shards == 256 and 16 ** (mix.block_digits - 1) < 10**4 <= 16**mix.block_digits
    assert mixing.fitted(rows.limit(0)) == mixing.Mix()


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = mixing.blocked(mixing.sized(docs), mixing.Mix())
    out = mixing.placed(rows, mixing.drawn(rows.drop("row")))
    assert out.count() == docs.count()
    assert mixing.mix_documents(docs).schema == docs.schema
    assert mixing.mix_documents(empty_documents(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert mixing.mix_documents(nothing).count() == 0


def test_taken_is_what_the_mix_emits(spark, monkeypatch):
    docs = corpus(spark, 100).union(corpus(spark, 100).where("doc_id < 5"))
    rows = mixing.blocked(mixing.sized(docs), mixing.Mix()).select("row.doc_id", "size", "source", "h", "block")
    want = mixing.placed(rows, mixing.drawn(rows)).selectExpr("doc_id", "size", "source_size", "target", "size * size(shards) as taken", "array_join(array_sort(shards), ',') as shards", "source").collect()
    assert sorted(map(str, mixing.accounted(docs).collect())) == sorted(map(str, want))
    real = mixing.emitted
    # a mix that lacks a shard differs from its plan, and that shows
    monkeypatch.setattr(mixing, "emitted", lambda *a: real(*a).where("shard > 0"))
    assert sorted(map(str, mixing.accounted(docs).collect())) != sorted(map(str, want))


def test_taken_of_odd_documents(spark):
    docs = odd_documents(spark)
    out = mixing.accounted(docs).collect()
    assert len(out) == docs.count() and all(r["taken"] % max(r["size"], 1) == 0 for r in out)
    assert mixing.accounted(empty_documents(spark)).count() == 0
