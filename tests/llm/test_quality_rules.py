import re

from pyspark.sql import functions as F

from strata.llm import quality_rules
from tests.llm.common import empty_documents, odd_documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k + j for places in seen.values() if len(places) > 1 for k in places for j in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_counts_match_brute_force(spark):
    docs = odd_documents(spark)
    rows = quality_rules.judge(quality_rules.measure(docs)).select("row.text", "m.*", "base_failed", "kept").collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = brute(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_kept_rows_are_as_they_were(spark):
    docs = odd_documents(spark)
    kept = quality_rules.keep_good(docs)
    assert kept.schema == docs.schema
    assert kept.exceptAll(docs).count() == 0


def test_divergent_text_goes_and_prose_stays(spark):
    rows = [(i, prose(200, i), "en") for i in range(40)] + [(100, " ".join(w + "%%%###" for w in prose(200, 99).split()), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r[0] for r in quality_rules.keep_good(docs).select("doc_id").collect()}
    assert kept == set(range(40))


def test_text_without_common_words_goes_by_the_word_distance_alone(spark):
    letters = str.maketrans("0123456789", "abcdefghij")

    # words of letters alone: each is in one document only, so none is learned as a common one
    def text(i, common):
        return " ".join(["the", "of", "and", "to", "in"][k // 5 % 5] if common and k % 5 == 0 else f"w{i}{k}".translate(letters) for k in range(200))

    rows = [(i, text(i, True), "en") for i in range(40)] + [(100, text(100, False), "en"), (101, text(101, False), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in quality_rules.judge(quality_rules.measure(docs)).select("row.doc_id", "base_failed", "char_distance", "word_distance", "word_limit", "kept").collect()}
    assert {i for i, r in out.items() if r["kept"]} == {*range(40), 101}
    r = out[100]
    assert not r["base_failed"] and r["char_distance"] < 0.30 and r["word_limit"] < r["word_distance"] < 0.60


def test_common_words_are_learned_of_every_language(spark):
    rows = [(i, f"ba na na ba {i} ga", "qx") for i in range(9)] + [(20 + i, "le chat", "fr") for i in range(3)] + [(50, "le ba", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert quality_rules.common_words(docs) == {"fr": ["chat", "le"], "qx": ["ba", "ga", "na"]}
    assert quality_rules.common_words(docs, quality_rules.Limits(most_languages=2)) == {"qx": ["ba", "ga", "na"]}
    assert quality_rules.common_words(empty_documents(spark)) == {}


def test_where_common_words_are_rare_their_lack_rejects_nothing(spark):
    rows = [(i, " ".join(["the" if i % 2 and k == 7 else f"w{i}{k}" for k in range(60)]), "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert quality_rules.keep_good(docs).count() == 40


def test_empty_table(spark):
    assert quality_rules.keep_good(empty_documents(spark)).count() == 0


def test_distance_is_that_of_the_formula(spark):
    row = spark.range(1).select(quality_rules._distance(F.array(F.lit(1), F.lit(0)), F.array(F.lit(0), F.lit(5))), quality_rules._distance(F.array(F.lit(2), F.lit(2)), F.array(F.lit(1), F.lit(1)))).first()
    assert abs(row[0] - 1) < 1e-9 and row[1] == 0


def test_a_rare_language_is_not_judged_by_another(spark):
    text = "的 " + " ".join("語言文字" for _ in range(70)) + " the"
    for n in (500, 6000):
        docs = spark.createDataFrame([(i, prose(80, i), "en") for i in range(n)] + [(10**6, text + " 一 二 三 四 五 六", "xx")], "doc_id long, text string, lang string")
        measured = {r["doc_id"]: r for r in quality_rules.keep_good(docs).where("doc_id = 1000000").collect()}
        alone = quality_rules.keep_good(docs.where("doc_id = 1000000")).count()
        assert len(measured) == alone, n
