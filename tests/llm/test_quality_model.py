import math
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from strata.llm import quality_model
from tests.llm.common import empty_documents, odd_documents, prose


def kneser_ney(texts):
    """log p(run of three) of an interpolated modified Kneser-Ney model of the words of texts, by plain counting."""
    top = Counter()
    for t in texts:
        for w in t.split():
            p = "\x02\x02" + w + "\x03"
            top.update(p[i : i + 3] for i in range(len(p) - 2))
    counts = {3: top}
    for n in (2, 1):
        counts[n] = Counter(g[-n:] for g in {g[-n - 1 :] for g in top})
    discounts, totals, freed = {}, {}, {}
    for n, c in counts.items():
        k = Counter(c.values())
        y = k[1] / (k[1] + 2 * k[2]) if k[1] else 0.5
        discounts[n] = [min(max(j - (j + 1) * y * k[j + 1] / max(k[j], 1), 0.1), j - 0.05) for j in (1, 2, 3)]
        totals[n], freed[n] = defaultdict(int), defaultdict(float)
        for g, v in c.items():
            totals[n][g[:-1]] += v
            freed[n][g[:-1]] += min(discounts[n][min(v, 3) - 1], v)
    base = 1 / (len({g[-1] for g in top}) + 1)

    def p(gram, n):
        lower = p(gram, n - 1) if n > 1 else base
        g = gram[-n:]
        if g[:-1] not in totals[n]:
            return lower
        v = counts[n].get(g, 0)
        return (max(v - discounts[n][min(v, 3) - 1], 0) if v else 0) / totals[n][g[:-1]] + freed[n][g[:-1]] / totals[n][g[:-1]] * lower

    return lambda gram: math.log(max(p(gram, 3), 1e-12))


def test_runs_of_words():
    runs, begins = quality_model.word_runs(pa.array(["ab", "é", "日本語", "\U0001f600\U0001f601"]))
    texts = ["".join(chr((int(r) >> 21 * k) & 0x1FFFFF) for k in (2, 1, 0)) for r in runs]
    assert texts == ["\x02\x02a", "\x02ab", "ab\x03", "\x02\x02é", "\x02é\x03", "\x02\x02日", "\x02日本", "日本語", "本語\x03", "\x02\x02\U0001f600", "\x02\U0001f600\U0001f601", "\U0001f600\U0001f601\x03"]
    assert begins.tolist() == [0, 3, 5, 9, 12]


def test_both_ways_to_score_agree(spark):
    docs = odd_documents(spark).unionByName(spark.createDataFrame([(100 + i, prose(40, i, 60) + " \U0001f600\U00020000", "en") for i in range(40)], "doc_id long, text string, lang string"), allowMissingColumns=True)
    trusted = spark.range(0, 120, 2).withColumnRenamed("id", "doc_id")
    here, joined = (sorted(map(str, quality_model.judge(docs, trusted, how).collect())) for how in (quality_model.Judge(), quality_model.Judge(lookup=0)))
    assert here == joined


@pytest.mark.parametrize("how", [quality_model.Judge(), quality_model.Judge(lookup=0, broadcast_ids=0)])
def test_perplexity_is_that_of_the_model(spark, how):
    rows = [(i, prose(60, i, 30), "en") for i in range(30)] + [(50, "zz%% qq## ab", "en"), (51, "日本 語", "en"), (52, prose(20, 1), "de"), (53, None, "en"), (54, prose(9, 2), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(20)] + [(None,)], "doc_id long")
    found = {r["doc_id"]: r for r in quality_model.judge(docs, trusted, how).collect()}
    assert len(found) == len(rows)
    score = kneser_ney([t for i, t, _ in rows if i < 20])
    for i, text, lang in rows:
        if lang != "en" or not text:
            continue
        grams = [p[k : k + 3] for w in text.split() for p in ["\x02\x02" + w + "\x03"] for k in range(len(p) - 2)]
        want = math.exp(-sum(map(score, grams)) / len(grams))
        assert found[i]["perplexity"] == pytest.approx(want, rel=1e-4)
    assert found[0]["kept"] and not found[50]["kept"] and not found[53]["kept"]
    assert found[52]["kept"] and found[52]["threshold"] is None and found[53]["perplexity"] is None


def test_odd_documents(spark):
    docs = odd_documents(spark)
    trusted = spark.createDataFrame([(6,), (9,)], "doc_id long")
    out = quality_model.judge(docs, trusted)
    assert out.count() == docs.count()
    assert quality_model.judge(docs, trusted.limit(0)).count() == docs.count()
    assert quality_model.judge(empty_documents(spark), trusted).count() == 0
