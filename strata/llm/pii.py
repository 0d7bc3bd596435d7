"""Personal data: base patterns, and identifiers found by bootstrapped contexts.

The base patterns give spans of four kinds. They seed a bootstrap. Words with an @, and neighbouring words with digits
together, are candidates. Each has lexical patterns: the two words before it, the two words behind it, and the word
on either side, with the candidate's shape (an @, digits with dots, many digits, few, or letters too). Patterns and candidates
are a bipartite graph. In each round a pattern's confidence in a kind is the share of its distinct instances that are
known to be of it, smoothed (those of no known kind count half), and an instance's score the complement of the product of its patterns' doubts; instances that
pass the limit are known in the next round, until no round finds any. Candidates known in the end are spans too, unless a
base span overlaps them. All of it is DataFrame expressions. Only candidates, with few words of context, are ever shuffled.

An instance that seeds of two kinds overlap is of the first in the order of kinds; of kinds with one score, the first
counts too. Words are taken whole, however long they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import let, stored, text_of, total

KINDS = ("email", "ip", "card", "phone")

# The four base patterns. A match can only start where a run of the characters that may begin it does, or
# where the match before it ended, so the others are told to look no further; no part gives back what it took.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+\-])|\G)[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20\-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9\-]+[0-9]",
}


WS = r"\x20\x09-\x0D"
#: A word with an @, or words with digits and single spaces between them.
CANDIDATE = rf"(?:(?<=[{WS}])|^)(?:[^{WS}@]*+@[^{WS}]*+|[^{WS}0-9@]*+[0-9][^{WS}@]*+(?![^{WS}])(?:\x20[^{WS}0-9@]*+[0-9][^{WS}@]*+(?![^{WS}]))*+)"
#: Stands for another candidate, or the end of the text, in a context.
OTHER, EDGE = "\x02", "\x03"
MILLIONTHS = 1_000_000


@dataclass(frozen=True)
class Bootstrap:
    #: A pattern needs so many distinct known instances of a kind, and this confidence; an instance this score.
    least_known: int = 5
    least_confidence: float = 0.8
    least_score: float = 0.8


def _luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's check."""

    def summed(values: Column) -> Column:
        n = F.size(values)
        doubled = F.transform(values, lambda v, i: F.when((n - i) % 2 == 0, F.when(v > 4, 2 * v - 9).otherwise(2 * v)).otherwise(v))
        return total(doubled) % 10 == 0

    return let(F.transform(F.split(digits, "(?<=.)(?=.)"), lambda c: c.cast("int")), summed)


def _valid(kind: str, found: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        significant = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(significant, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15)


def matches(text: Column, pattern: str) -> Column:
    """Array of (``start``, ``end``, ``found``, ``gap``) of the leftmost matches that don't overlap; code points, end exclusive.
    ``gap`` is the text between the match before and this one. Splitting by the pattern gives the gaps, so the places are sums of
    lengths."""
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, F.array().cast(PLACED)).otherwise(_placed(found, F.split(text, pattern, -1))))


PLACED = "array<struct<start:int,end:int,found:string,gap:string>>"


def _placed(found: Column, gaps: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.array().cast(PLACED).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["found"])
        span = F.struct(begin.alias("start"), end.alias("end"), x["found"].alias("found"), x["gap"].alias("gap"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda f, g: F.struct(f.alias("found"), g.alias("gap")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def base_spans(text: Column) -> Column:
    """Array of (``start``, ``rank``, ``kind``, ``end``, ``found``) of all base spans, by start, then kind."""

    def of_kind(rank: int, kind: str) -> Column:
        valid = F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["found"]))
        return F.transform(valid, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["found"].alias("found")))

    return F.sort_array(F.concat(*[of_kind(i, k) for i, k in enumerate(KINDS)]))


def candidates(text: Column) -> Column:
    """Array of (``start``, ``end``, ``found``, ``before``, ``after``): the candidates with the two words on either side of each, in lower
    case and with 0 for digits; another candidate or the end of the text is a word there."""

    def words(gap: Column, first: Column, last: Column) -> Column:
        plain = F.filter(F.split(F.regexp_replace(F.lower(gap), "[0-9]", "0"), f"[{WS}]+"), lambda w: w != "")
        return F.concat(F.array(F.when(first, EDGE).otherwise(OTHER)), plain, F.array(F.when(last, EDGE).otherwise(OTHER)))

    def with_context(found: Column, gaps: Column) -> Column:
        n = F.size(found)
        sides = F.transform(gaps, lambda g, i: words(g, i == 0, i == n))
        # of each gap only its ends are kept: the last two words before a candidate, the first two behind one
        return let(F.transform(sides, lambda w: let(w, lambda v: F.struct(F.slice(v, F.greatest(F.size(v) - 2, F.lit(1)), F.least(F.size(v) - 1, F.lit(2))).alias("last"), F.slice(v, 2, 2).alias("first")))), lambda e: F.transform(
            _placed(found, gaps), lambda m, i: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["found"].alias("found"), F.get(e, i)["last"].alias("before"), F.get(e, i + 1)["first"].alias("after"))
        ))

    none = F.array().cast("array<struct<start:int,end:int,found:string,before:array<string>,after:array<string>>>")
    return let(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(let(F.split(text, CANDIDATE, -1), lambda gaps: with_context(found, gaps))))


def shape(core: Column) -> Column:
    digits = F.length(F.regexp_replace(core, "[^0-9]", ""))
    return (
        F.when(F.contains(core, F.lit("@")), "@").when(F.regexp_like(core, F.lit("[A-Za-z]")), "a")
        .when(F.regexp_count(core, F.lit(r"[0-9]\.(?=[0-9])")) >= 3, ".").when(digits >= 7, "9").otherwise("0")
    )


def pattern_edges(found: DataFrame) -> DataFrame:
    """``row``, ``start``, ``end``, ``instance``, ``seed`` (kind of a base span that overlaps it; null: none) and ``patterns`` of each
    candidate. ``found`` has ``row``, ``base`` and ``cands``."""
    edges = found.select("row", "base", F.explode("cands").alias("m"))
    # without punctuation around it
    edges = edges.withColumn("core", F.regexp_extract("m.found", r"([A-Za-z0-9+@%._\-()\x20]*[A-Za-z0-9])", 1)).where("core <> ''")
    edges = edges.withColumn("start", F.col("m.start") + F.instr("m.found", F.col("core")) - 1)
    edges = edges.withColumn("end", F.col("start") + F.length("core"))
    hits = F.filter("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))
    before, after = F.col("m.before"), F.col("m.after")
    contexts = [("b", F.array_join(before, " ")), ("a", F.array_join(after, " ")), ("m", F.concat_ws(" ", F.element_at(before, -1), F.get(after, F.lit(0))))]
    # a context without a word is none
    lexical = [F.when(F.regexp_like(words, F.lit(f"[^{OTHER}{EDGE} ]")), F.md5(F.concat_ws("\x01", F.lit(side), words, shape(F.col("core"))))) for side, words in contexts]
    patterns = F.array_compact(F.array(*lexical))
    seed = F.array_min(F.transform(hits, lambda b: b["rank"]))
    return edges.select("row", "start", "end", F.md5("core").alias("instance"), seed.alias("seed"), patterns.alias("patterns"))


def bootstrap_spans(found: DataFrame, bootstrap: Bootstrap) -> DataFrame:
    """``row``, ``start``, ``end``, ``rank`` (place among the kinds) of what the contexts add."""
    edges = stored(pattern_edges(found), "edges")
    pairs = edges.select("instance", "seed", F.explode("patterns").alias("pattern"))
    graph = stored(pairs.groupBy("pattern", "instance").agg(F.min("seed").alias("seed")), "graph")
    known = stored(graph.where("seed is not null").groupBy("instance").agg(F.min("seed").alias("rank")), "known")
    seeds, size = known.select("instance"), stored(graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "sizes")
    while True:
        of_kind = graph.join(known, "instance").groupBy("pattern", "rank").agg(F.count(F.lit(1)).alias("k"))
        # instances not known yet count half against it; one is added, so that few instances give little confidence
        any_kind = of_kind.groupBy("pattern").agg(F.sum("k").alias("known"))
        sure = of_kind.where(F.col("k") >= bootstrap.least_known).join(size, "pattern").join(any_kind, "pattern")
        sure = sure.withColumn("confidence", F.col("k") / ((F.col("n") + F.col("known")) / 2 + 1))
        # doubts as whole numbers, so that their sum doesn't depend on its order
        sure = sure.where(F.col("confidence") >= bootstrap.least_confidence).withColumn("doubt", F.round(F.log1p(-F.col("confidence")) * MILLIONTHS).cast("long"))
        score = graph.join(sure.select("pattern", "rank", "doubt"), "pattern").groupBy("instance", "rank").agg(F.sum("doubt").alias("doubt"))
        # the least doubt wins, then the first kind
        enough = score.where(1 - F.exp(F.col("doubt") / MILLIONTHS) >= bootstrap.least_score)
        more = enough.groupBy("instance").agg(F.min(F.struct("doubt", "rank"))["rank"].alias("rank"))
        more = stored(more.join(known, "instance", "left_anti"), "more")
        if more.isEmpty():
            break
        known = stored(known.union(more), "known")
    learned = known.join(seeds, "instance", "left_anti")
    return edges.where("seed is null").join(learned, "instance").select("row", "start", "end", "rank")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, bootstrap: Bootstrap = Bootstrap(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, counts of base spans by kind, ``base_sha256`` and ``spans`` (all of them).

    A null text is an empty one. Spans are kind:start:end by start, then kind. Repeated rows have the same
    spans; keys need not be unique or given. Very long texts and words are read whole.
    """
    body = text_of(text)
    rows = docs.select(F.col(key).alias("key"), body.alias("text"))
    found = rows.select("key", base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("cands"))
    # the row's number is given once, with what was found, and stored
    found = stored(found.select(F.monotonically_increasing_id().alias("row"), "*"), "found")
    added = bootstrap_spans(found, bootstrap).groupBy("row").agg(F.collect_set(F.struct("start", "end", "rank")).alias("added"))
    out = found.join(added, "row", "left")
    kinds = F.array(*map(F.lit, KINDS))
    none = F.array().cast("array<struct<start:int,end:int,rank:int>>")
    more = F.transform(F.coalesce("added", none), lambda a: F.struct(a["start"].alias("start"), a["rank"].alias("rank"), F.get(kinds, a["rank"]).alias("kind"), a["end"].alias("end"), F.lit(None).cast("string").alias("found")))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    spans = F.sort_array(F.concat("base", more))
    return out.select(F.col("key").alias(key), *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def _is(kind: str):
    return lambda s: s["kind"] == kind
