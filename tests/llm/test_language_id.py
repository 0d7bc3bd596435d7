import random

from strata.llm import language_id
from tests.llm.common import empty_documents, odd_documents

PARTS = {"en": ["th", "ing", "er", "ou", "ly", "and"], "de": ["sch", "ung", "ein", "keit", "ß", "ä"], "fr": ["eau", "eux", "ou", "é", "tre", "que"]}


def text(lang, seed, n=60):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choices(PARTS[lang], k=3)) for _ in range(n))


def test_held_out_accuracy_and_rejection(spark):
    rows = [(i, text(k, i), k) for i in range(240) for k in [["en", "de", "fr"][i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs.where("doc_id < 160"), language_id.Training(rows=150))
    assert model.languages == ["de", "en", "fr"]
    found = {r["doc_id"]: r for r in language_id.predict(docs.where("doc_id >= 160").drop("lang"), model).collect()}
    right = sum(found[i]["lang_pred"] == k for i, _, k in rows[160:])
    assert right >= 0.97 * 80
    assert all(0 <= r["score"] <= 1 for r in found.values())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !?"), (4, text("de", 1))], "doc_id long, text string")
    names = {r["doc_id"]: (r["lang_pred"], r["score"] > 0) for r in language_id.predict(odd, model).collect()}
    assert names == {1: ("und", False), 2: ("und", False), 3: ("und", False), 4: ("de", True)}


def test_training_is_the_same_however_rows_lie(spark):
    docs = spark.createDataFrame([(i, text(k, i), k) for i in range(60) for k in [["en", "de"][i % 2]]], "doc_id long, text string, lang string")
    a, b = language_id.train(docs), language_id.train(docs.repartition(5))
    assert (a.scores == b.scores).all() and a.temperature == b.temperature


def test_odd_documents(spark):
    docs = odd_documents(spark)
    model = language_id.train(docs)
    assert language_id.predict(docs, model).count() == docs.count()
    assert language_id.train(empty_documents(spark)) is None
    none = language_id.predict(docs, None).collect()
    assert all(r["lang_pred"] == "und" for r in none)
    assert language_id.predict(empty_documents(spark), model).count() == 0


def test_sample_is_bounded_by_rows_and_has_rare_languages(spark):
    rows = spark.range(5000).selectExpr("7L as doc_id", "concat('thing and ', id) as text", "'en' as lang")
    rows = rows.union(spark.createDataFrame([(i, text("de", i), "de") for i in range(100, 400)] + [(9, text("fr", 1), "fr")], "doc_id long, text string, lang string"))
    found = language_id.sample(rows, language_id.Training(rows=60), "doc_id", "text", "lang").collect()
    counts = {k: sum(r["lang"] == k for r in found) for k in ("de", "en", "fr")}
    assert counts == {"de": 20, "en": 1, "fr": 1}
    assert language_id.train(rows, language_id.Training(rows=60)).languages == ["de", "en", "fr"]


def test_scores_are_those_of_the_model_by_hand(spark):
    """Brute force: every word's hashed subwords looked up one by one, averaged, and put through the softmax."""
    import numpy as np
    import pyarrow as pa

    from strata.llm.tokens import LOWER_ALNUM, coded_words

    rows = [(i, text(k, i, 1 + i % 9), k) for i in range(90) for k in [["en", "de", "fr"][i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    found = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    for i, body, _ in rows:
        total, n = np.zeros(3), 0
        for word in body.split():
            _, _, words = coded_words(pa.array([word]), LOWER_ALNUM)
            buckets, begins = language_id.word_features(words, model.bits)
            for b in buckets[begins[0] : begins[1]]:
                total += model.scores[b]
                n += 1
        logits = (total / n + model.scores[-1]) / model.temperature
        p = np.exp(logits) / np.exp(logits).sum()
        assert found[i]["lang_pred"] == model.languages[int(p.argmax())] and abs(found[i]["score"] - p.max()) < 1e-6


def test_ties_go_to_the_first_language(spark):
    import numpy as np

    model = language_id.Model(["aa", "bb"], np.zeros(((1 << 4) + 1, 2), np.float32), 4)
    docs = spark.createDataFrame([(1, "word"), (1, "word"), (2, "word " * 50_000)], "doc_id long, text string")
    assert [(r["lang_pred"], r["score"]) for r in language_id.predict(docs, model).collect()] == [("aa", 0.5)] * 3
