"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over the characters of words: runs of three (``ORDER``) within a word with marks around it, so a
document's runs are those of its distinct words. Trusted text and all other text are counted in one pass, each
run with its trusted count, which may be none. All statistics of the model (discounts, continuation counts,
history weights) are joins and sums over the counts, sharded by history or by suffix. They end in a
table with the probability of every run that the corpus has. Documents are scored by it, and rejected where
their perplexity is beyond a quantile of their language's trusted documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import stored, text_of
from strata.llm.files import opened
from strata.llm.tokens import PLAIN, coded_words, slices

ORDER = 3
#: Bits of a character in a run: any code point fits, so a run is exact in one number.
BITS = 21
#: Logarithms are whole numbers of millionths, so that sums don't depend on their order.
PARTS = 1_000_000


@dataclass(frozen=True)
class Judge:
    #: A document stays if its perplexity is at most this quantile of its language's trusted ones, times the slack.
    quantile: float = 0.99
    slack: float = 1.10
    #: A table of at most so many runs is looked up in the tasks that scan the texts; a larger one is joined.
    lookup: int = 3_000_000
    #: Tables of trusted ids of at most so many rows are broadcast; larger ones are joined by shuffle.
    broadcast_ids: int = 500_000


def word_runs(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(runs of all words, where each word's begin and the last's end). A run is three characters, the last in the lowest
    bits: one for each character of a word and one for its end, with marks before its start."""
    text = "".join(f"\x02\x02{w}\x03" for w in words.to_pylist())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    runs = points[:-2] << 2 * BITS | points[1:-1] << BITS | points[2:]
    first = np.append(0, np.flatnonzero(points == 3) + 1)
    keep = np.ones(len(runs), bool)
    for k in (1, 2):
        keep[first[1:-1] - k] = False
    return runs[keep], np.append(0, np.cumsum(np.diff(first) - 2))


def _clean(texts: pa.Array) -> pa.Array:
    """The marks' characters in a text become another that is as rare."""
    return pc.replace_substring_regex(texts, "[\x02\x03]", "\x1f")


def _counted(docs: DataFrame) -> DataFrame:
    """``lang``, ``gram``, ``n`` (times in trusted text) of each batch of ``lang``, ``text``, ``trusted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                offsets, codes, words = coded_words(_clean(part.column(1)), PLAIN)
                if not len(words):
                    continue
                runs, begins = word_runs(words)
                length = np.diff(offsets)
                langs = part.column(0).dictionary_encode()
                names = [*langs.dictionary.to_pylist(), None]
                of_text, trusted = langs.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False)
                for k, name in enumerate(names):
                    own = codes[np.repeat(of_text == k, length)]
                    good = codes[np.repeat((of_text == k) & trusted, length)]
                    n = np.bincount(good, minlength=len(words))
                    here = np.flatnonzero(np.bincount(own, minlength=len(words)))
                    counts = begins[here + 1] - begins[here]
                    at = np.repeat(begins[here] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                    grams, which = np.unique(runs[at], return_inverse=True)
                    times = np.bincount(which, np.repeat(n[here], counts)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(times)], ["lang", "gram", "n"])

    rows = docs.select("lang", "text", "trusted").mapInArrow(run, "lang string, gram long, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _low(gram: Column, order: int) -> Column:
    """The last ``order`` characters."""
    return gram if order == ORDER else gram.bitwiseAND(F.lit((1 << BITS * order) - 1))


def _discounts(counts: DataFrame) -> DataFrame:
    """``lang``, ``d1``, ``d2``, ``d3``: the three discounts, from how many runs occur one to four times."""
    n = [F.sum(F.when(F.col("c") == k, 1).otherwise(0)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5))
    d = [F.lit(k) - (k + 1) * y * F.col(f"n{k + 1}") / F.greatest(F.col(f"n{k}"), F.lit(1.0)) for k in (1, 2, 3)]
    return counts.groupBy(F.col("lang").alias("dl")).agg(*n).select("dl", *[F.least(F.greatest(x, F.lit(0.1)), F.lit(k - 0.05)).alias(f"d{k}") for k, x in zip((1, 2, 3), d)])


def probabilities(grams: DataFrame) -> DataFrame:
    """``lang``, ``gram``, ``logp`` (natural logarithm, in millionths) of each run in ``grams`` (``lang``, ``gram``, trusted count ``n``)."""
    seen = grams.where("n > 0")
    wanted = grams.select("lang", "gram")
    # the lowest order: each character evenly, of the characters that the language's trusted text has and one more
    alphabet = seen.groupBy("lang").agg((F.countDistinct(_low(F.col("gram"), 1)) + 1).alias("size"))
    scored = wanted.join(alphabet.withColumnRenamed("lang", "al"), F.col("lang").eqNullSafe(F.col("al")), "left").select("lang", "gram", (F.lit(1.0) / F.coalesce("size", F.lit(256))).alias("p"))
    for order in range(1, ORDER + 1):
        # below the highest order, a run counts once for each character that is found before it
        if order == ORDER:
            counts = seen.select("lang", F.col("gram").alias("g"), F.col("n").alias("c"))
        else:
            more = seen.select("lang", _low(F.col("gram"), order + 1).alias("more")).distinct()
            counts = more.groupBy("lang", _low(F.col("more"), order).alias("g")).agg(F.count(F.lit(1)).alias("c"))
        counts = counts.withColumn("h", F.shiftright("g", BITS)) if order > 1 else counts.withColumn("h", F.lit(0).cast("long"))
        counts = counts.join(_discounts(counts), F.col("lang").eqNullSafe(F.col("dl"))).drop("dl")
        counts = counts.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        histories = counts.groupBy(F.col("lang").alias("hl"), F.col("h").alias("hh")).agg(F.sum("c").alias("total"), F.sum(F.least("d", "c")).alias("freed"))
        counts = counts.select(F.col("lang").alias("cl"), "g", F.greatest(F.col("c") - F.col("d"), F.lit(0.0)).alias("less"))
        g = _low(F.col("gram"), order)
        scored = scored.withColumn("g0", g).withColumn("h0", F.shiftright("g0", BITS) if order > 1 else F.lit(0).cast("long"))
        scored = scored.join(counts, F.col("lang").eqNullSafe(F.col("cl")) & (F.col("g0") == F.col("g")), "left")
        scored = scored.join(histories, F.col("lang").eqNullSafe(F.col("hl")) & (F.col("h0") == F.col("hh")), "left")
        p = F.when(F.col("total").isNull(), F.col("p")).otherwise((F.coalesce("less", F.lit(0.0)) + F.col("freed") * F.col("p")) / F.col("total"))
        scored = stored(scored.select("lang", "gram", p.alias("p")), f"order-{order}")
    return scored.select("lang", "gram", F.round(F.log(F.greatest("p", F.lit(1e-12))) * PARTS).cast("long").alias("logp"))


_tables: dict[str, dict[str | None, tuple[np.ndarray, np.ndarray]]] = {}


def _table(path: str) -> dict[str | None, tuple[np.ndarray, np.ndarray]]:
    """Sorted runs and their scores, by language; one table is kept in a worker."""
    if path not in _tables:
        _tables.clear()
        system, top = opened(path)
        files = [f.path for f in system.get_file_info(pafs.FileSelector(top)) if f.path.endswith(".parquet")]
        t = pa.concat_tables([pq.read_table(f, filesystem=system) for f in files])
        langs = t["lang"].combine_chunks().dictionary_encode()
        which = langs.indices.fill_null(len(langs.dictionary)).to_numpy(zero_copy_only=False)
        grams, logp, out = t["gram"].to_numpy(), t["logp"].to_numpy(), {}
        for k, name in enumerate([*langs.dictionary.to_pylist(), None]):
            own = np.flatnonzero(which == k)
            own = own[np.argsort(grams[own])]
            out[name] = grams[own], logp[own]
        _tables[path] = out
    return _tables[path]


def _score_here(docs: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, text=2):
                offsets, codes, words = coded_words(_clean(part.column(2)), PLAIN)
                length, sums, n = np.diff(offsets), np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                if len(words):
                    runs, begins = word_runs(words)
                    langs = part.column(1).to_pylist()
                    for name in set(langs):
                        rows = np.array([x == name for x in langs]) & (length > 0)
                        here = np.repeat(rows, length)
                        if not here.any():
                            continue
                        own = np.flatnonzero(np.bincount(codes[here], minlength=len(words)))
                        counts = begins[own + 1] - begins[own]
                        at = np.repeat(begins[own] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                        grams, logp = _table(path)[name]
                        score = np.zeros(len(words), np.int64)
                        score[own] = np.add.reduceat(logp[np.searchsorted(grams, runs[at])], np.cumsum(counts) - counts)
                        starts = np.cumsum(length[rows]) - length[rows]
                        sums[rows] = np.add.reduceat(score[codes[here]], starts)
                        n[rows] = np.add.reduceat((begins[1:] - begins[:-1])[codes[here]], starts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sums), pa.array(n), part.column(3)], ["key", "lang", "sum", "n", "trusted"])

    return docs.select("key", "lang", "text", "trusted").mapInArrow(run, "key long, lang string, sum long, n long, trusted boolean")


def _score_joined(docs: DataFrame, table: DataFrame) -> DataFrame:
    """The same by a shuffle of each row's runs and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, text=2):
                offsets, codes, words = coded_words(_clean(part.column(2)), PLAIN)
                if not len(words):
                    continue
                runs, begins = word_runs(words)
                counts = np.diff(begins)[codes]
                at = np.repeat(begins[codes] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                grams, row = runs[at], np.repeat(np.repeat(np.arange(part.num_rows), np.diff(offsets)), counts)
                order = np.lexsort((grams, row))
                grams, row = grams[order], row[order]
                new = np.flatnonzero(np.append(True, (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])))
                own = part.take(pa.array(row[new]))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(3), own.column(4), pa.array(grams[new]), pa.array(np.diff(np.append(new, len(grams))))], ["key", "lang", "trusted", "row", "gram", "times"])

    rows = docs.select("key", "lang", "text", "trusted", F.monotonically_increasing_id().alias("row"))
    rows = stored(rows.mapInArrow(run, "key long, lang string, trusted boolean, row long, gram long, times long"), "runs")
    # a document's runs are counted before the join, so the key of a run is at most once a document
    rows = rows.join(table.withColumnRenamed("lang", "tl").withColumnRenamed("gram", "tg"), F.col("lang").eqNullSafe(F.col("tl")) & (F.col("gram") == F.col("tg")))
    return rows.groupBy("row", "key", "lang", "trusted").agg(F.sum(F.col("times") * F.col("logp")).alias("sum"), F.sum("times").alias("n")).drop("row")


def judge(docs: DataFrame, trusted: DataFrame, how: Judge = Judge(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per document: key, ``lang``, ``perplexity``, ``threshold`` and ``kept``. ``trusted`` has the trusted keys.

    A null language is one of its own. A text without words has no perplexity and is not kept; one whose language
    has no trusted text is. Repeated rows are judged alike, and a trusted one counts as often as it is there.
    """
    ids = stored(trusted.select(F.col(key).cast("long").alias("k")).where("k is not null").distinct().withColumn("good", F.lit(True)), "trusted")
    small = ids.count() <= how.broadcast_ids
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(lang).cast("string").alias("lang"), text_of(text).alias("text"))
    rows = rows.join(F.broadcast(ids) if small else ids, F.col("key") == F.col("k"), "left").select("key", "lang", "text", F.coalesce("good", F.lit(False)).alias("trusted"))
    table = stored(probabilities(stored(_counted(rows), "counts")), "probabilities")
    if 0 < table.count() <= how.lookup:
        scored = _score_here(rows, table.inputFiles()[0].rpartition("/")[0])
    else:
        bare = rows.where(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]")) == 0).select("key", "lang", F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("n"), "trusted")
        scored = _score_joined(rows, table).select("key", "lang", "sum", "n", "trusted").union(bare)
    scored = stored(scored, "scores").withColumn("perplexity", F.when(F.col("n") > 0, F.exp(-F.col("sum") / F.col("n") / PARTS)))
    limits = scored.where("trusted and perplexity is not null").groupBy(F.col("lang").alias("ll")).agg((F.percentile_approx("perplexity", how.quantile, 10_000) * how.slack).alias("threshold"))
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("ll")), "left")
    kept = F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return out.select(F.col("key").alias(key), "lang", "perplexity", "threshold", kept.alias("kept"))
