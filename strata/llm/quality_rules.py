"""Quality rules: counts over whole texts, and the divergence of a text's histograms from its language's.

Each document has a histogram of character classes and one of its language's most common words, which are learned from
all documents of the language. The references are the mean histograms of all documents of a language that are long enough. A document
that is long enough is rejected when the Jensen-Shannon distance of either histogram from its
reference exceeds a limit. A text without common words is never far from its reference, most words of which
are other words too; so for lack of common words the limit follows from the reference. All of it is
DataFrame expressions: no row is shuffled but the few sums of each task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import let, packed, text_of, total, words_of

# The classes of characters.
CLASSES = [r"\p{Ll}", r"\p{Lu}", r"[0-9]", r"[\x09-\x0D\x20]", r"[.,;:!?'\"()\-]", r"[#*$%&|<>]"]

#: The common words of each language, by their place.
Common = dict[str, list[str]]

PPM = 1_000_000


@dataclass(frozen=True)
class Limits:
    """What a document may show. Distances are Jensen-Shannon distances to base 2, from 0 to 1."""

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    #: Below so many words a histogram says too little: no verdict on it, and no part in the references.
    min_judged: int = 50
    max_char_distance: float = 0.30
    max_word_distance: float = 0.60
    #: A text with fewer common words than its reference may be as far as one with this part of the reference's,
    #: if so many would be expected in it: of fewer, chance alone may leave none. None: no such limit.
    least_common: float | None = 0.10
    min_expected: int = 10
    #: Common words of a language; and the part of the documents with a language, one in so many, that it needs to have a list: so there
    #: are at most so many lists.
    common: int = 12
    most_languages: int = 1000


def repeated_words(words: Column, window: int) -> Column:
    """Words in windows of ``window`` words that occur twice or more in the text, compared by 64-bit hash."""

    def covered(starts: Column) -> Column:
        return total(F.transform(starts, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(starts, i + 1) - p, F.lit(window)))))

    def twice(ordered: Column) -> Column:
        same = F.filter(ordered, lambda e, i: (e["h"] == F.get(ordered, i - 1)["h"]) | (e["h"] == F.get(ordered, i + 1)["h"]))
        return let(F.sort_array(F.transform(same, lambda e: e["p"])), covered)

    def of_hashes(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed, twice)).cast("long")

    def joined(hashes: Column, have: int) -> Column:
        """Hashes of longer runs from those of ``have`` words, each run being two that overlap or touch."""
        if have == window:
            return let(F.slice(hashes, F.lit(1), F.size(hashes) - (window - 1)), of_hashes)
        step = min(have, window - have)
        nexts = F.slice(hashes, F.lit(1 + step), F.size(hashes))
        return let(F.zip_with(hashes, nexts, lambda a, b: F.xxhash64(a, b)), lambda h: joined(h, have + step))

    singles = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= window, F.lit(0).cast("long")).otherwise(let(singles, lambda h: joined(h, 1)))


def _letters(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\P{L}+"), lambda w: w != "")


def common_words(docs: DataFrame, limits: Limits = Limits(), text: str = "text", lang: str = "lang") -> Common:
    """The words that most documents of a language have, of each language that is not too rare; of equals the first by code point.

    All documents with a language count. Words are counted in each task first. The result is bounded by ``Limits``: at most
    ``most_languages`` times ``common`` words come to the driver.
    """
    rows = docs.select(F.col(lang).cast("string").alias("l"), text_of(text).alias("t")).where("l is not null")
    sizes = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    # one row a language
    every = F.sum("n").over(Window.partitionBy())
    large = sizes.withColumn("every", every).where(F.col("n") * limits.most_languages >= F.col("every")).select("l")
    words = rows.select("l", F.explode(F.array_distinct(_letters(F.col("t")))).alias("w")).groupBy("l", "w").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.col("n").desc(), "w"))
    best = words.withColumn("place", place).where(F.col("place") <= limits.common).join(F.broadcast(large), "l", "left_semi")
    found = best.groupBy("l").agg(F.sort_array(F.collect_list(F.struct("place", "w")))["w"].alias("words"))
    return {r["l"]: list(r["words"]) for r in found.orderBy("l").collect()}


def _language(lang: Column, letters: Column, common: Common) -> Column:
    """The given language if there is a word list for it, none without a list: a document isn't judged by another language than its
    own. If none is given, the one with most of its words in the text."""
    if not common:
        return F.lit(None).cast("string")

    def hits_of(words: list[str]) -> Column:
        return F.size(F.filter(letters, lambda w: w.isin(words)))

    hits = [F.struct(hits_of(words).alias("n"), F.lit(k).alias("k")) for k, words in common.items()]
    best = F.array_max(F.array(*hits))
    return F.when(lang.isin(list(common)), lang).when(lang.isNull() & (best["n"] > 0), best["k"])


def _word_histogram(language: Column, letters: Column, common: Common, bins: int) -> Column:
    if not common:
        return F.lit(None).cast("array<int>")
    padded = {k: v + [""] * (bins - len(v)) for k, v in common.items()}
    lists = F.create_map(*[x for k, v in padded.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def counted(found: Column) -> Column:
        return let(F.transform(lists[language], lambda k: F.size(F.filter(found, lambda w: w == k))), lambda n: F.concat(n, F.array((F.size(letters) - total(n)).cast("int"))))

    every = sorted({w for v in common.values() for w in v})
    return let(F.filter(letters, lambda w: w.isin(every)), counted)


def _char_histogram(text: Column) -> Column:
    """Counts of the classes, each taken from what the classes before it leave of the text, and of the rest."""

    def counted(rest: Column, classes: list[str], have: list[Column]) -> Column:
        if not classes:
            return F.array(*have, F.length(rest))
        return let(F.regexp_replace(rest, f"{classes[0]}+", ""), lambda less: counted(less, classes[1:], [*have, F.length(rest) - F.length(less)]))

    return counted(text, CLASSES, [])


def histograms(text: Column, lang: Column, common: Common, bins: int) -> Column:
    """Struct of ``language`` and the two histograms (``chars``, ``common``: arrays of counts)."""

    def of_letters(ws: Column) -> Column:
        return let(_language(lang, ws, common), lambda k: F.struct(k.alias("language"), _char_histogram(text).alias("chars"), _word_histogram(k, ws, common, bins).alias("common")))

    return let(_letters(text), of_letters)


def _shares(counts: Column) -> Column:
    """Whole parts in a million, so that sums over documents don't depend on their order."""
    return let(total(counts), lambda n: F.transform(counts, lambda c: F.floor(c.cast("bigint") * PPM / F.greatest(n, F.lit(1)))))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (root of the divergence to base 2) of two arrays of weights."""

    def normed(v: Column) -> Column:
        return let(total(F.transform(v, lambda x: x.cast("double")), "double"), lambda n: F.transform(v, lambda x: x / F.greatest(n, F.lit(1.0))))

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(normed(p), normed(q), lambda x, y: let((x + y) / 2, lambda m: (part(x, m) + part(y, m)) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), total(terms, "double")))


def _word_limit(ref: Column, part: float) -> Column:
    """The distance from ``ref`` of the same histogram with only ``part`` of its common words, the rest being other words."""

    def less(common: Column) -> Column:
        kept = F.transform(common, lambda x: x * part)
        return F.concat(kept, F.array(total(ref, "double") - total(kept, "double")))

    return let(F.transform(F.slice(ref, 1, F.size(ref) - 1), lambda x: x.cast("double")), lambda common: _distance(less(common), ref))


def _common_share(common: Column) -> Column:
    return let(total(common), lambda n: (n - F.element_at(common, -1)) / F.greatest(n, F.lit(1)))


def measure(docs: DataFrame, limits: Limits = Limits(), text: str = "text", lang: str = "lang") -> DataFrame:
    """``row`` (all columns of ``docs``), ``m`` (the counts) and ``h`` (the histograms) of each row. The words of the histograms are
    learned from ``docs``."""
    body, common = text_of(text), common_words(docs, limits, text, lang)
    return docs.select(packed(docs).alias("row"), counts(body, limits).alias("m"), histograms(body, F.col(lang).cast("string"), common, limits.common).alias("h"))


def language_references(measured: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Mean histograms (in parts a million, summed) of the languages: at most one row for each word list, and one with a
    null language."""
    # the words of the histogram itself are counted, so that this pass needs none of the counts; what is too short has
    # nulls, as a filter would be pushed below the histograms and make them again
    h = measured.select("h").select("h.*", (total(F.col("h.common")) >= limits.min_judged).alias("long"))
    h = h.select("language", F.when(F.col("long"), _shares(F.col("chars"))).alias("chars"), F.when(F.col("long"), _shares(F.col("common"))).alias("common"))
    n_chars, n_common = len(CLASSES) + 1, limits.common + 1
    sums = [F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(n_chars)] + [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(n_common)]
    return h.groupBy("language").agg(*sums).select(
        F.col("language").alias("ref_language"),
        F.array(*[F.col(f"c{i}") for i in range(n_chars)]).alias("ref_chars"),
        F.array(*[F.col(f"w{i}") for i in range(n_common)]).alias("ref_common"),
    )


def counts(text: Column, limits: Limits = Limits()) -> Column:
    """Struct of the counts of the base rules."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            total(F.transform(words, lambda w: F.length(w))).alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(words, limits.window).alias("n_repeat_words"),
        )

    return let(words_of(text), of_words)


def judge(measured: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """What ``measure`` gave, with ``base_failed``, ``char_distance``, ``word_distance``, ``word_limit`` and ``kept``.

    A null text counts as an empty one: no words, so it fails. A null or very rare language is taken from
    the common words; with none of them there, or no reference of the language, the distances are null and
    reject nothing. Repeated rows are judged alike. An empty table gives an empty one. Very long texts are counted whole.
    """
    # at most a row a word list, and one more, of fixed width: a bound that no input moves
    refs = language_references(measured, limits)
    limit = F.lit(limits.max_word_distance) if limits.least_common is None else _word_limit(F.col("ref_common"), limits.least_common)
    refs = F.broadcast(refs.withColumns({"word_limit": limit, "ref_share": _common_share(F.col("ref_common"))}))
    failed = (F.col("m.n_words") < limits.min_words) | (100 * F.col("m.n_repeat_words") > limits.max_repeat_percent * F.col("m.n_words"))
    judged = (F.col("m.n_words") >= limits.min_judged) & F.col("h.language").isNotNull() & F.get("ref_chars", F.lit(0)).isNotNull()
    lacks = (F.col("ref_share") * total(F.col("h.common")) >= limits.min_expected) & (_common_share(F.col("h.common")) < F.col("ref_share"))
    # null-safe, or a filter for nulls would be pushed below the references' histograms
    rows = measured.join(refs, F.col("h.language").eqNullSafe(F.col("ref_language")), "left").select(
        *measured.columns, failed.alias("base_failed"),
        F.when(judged, _distance(F.col("h.chars"), F.col("ref_chars"))).alias("char_distance"),
        F.when(judged, _distance(F.col("h.common"), F.col("ref_common"))).alias("word_distance"),
        F.when(judged & lacks, F.least(F.col("word_limit"), F.lit(limits.max_word_distance))).otherwise(F.lit(limits.max_word_distance)).alias("word_limit"),
    )
    far = (F.coalesce("char_distance", F.lit(0.0)) > limits.max_char_distance) | (F.coalesce("word_distance", F.lit(0.0)) > F.col("word_limit"))
    # one condition on both sides of the join: apart, the first would be pushed below it and count the words again
    return rows.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(~far))


def keep_good(docs: DataFrame, limits: Limits = Limits(), text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, as they were. The histograms are made once for the references and once for the
    verdicts: storing them beside the texts would take as much disk as the documents."""
    return judge(measure(docs, limits, text, lang), limits).where("kept").select("row.*")
