import random
import re

import pytest

from strata.llm import minhash
from tests.llm.common import empty_documents, odd_documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def components(sets, percent):
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in keys}


def corpus():
    """Copies, near copies at all similarities around the limit, chains, and a passage that many share."""
    rng = random.Random(5)
    texts, passage = [], prose(30, 77)
    for family in range(8):
        base = prose(rng.choice([8, 40, 120]), family).split()
        texts.append(" ".join(base))
        for _ in range(14):
            other = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 12))):
                other[rng.randrange(len(other))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                other = other[: rng.randrange(len(other) * 3 // 4, len(other))]
            texts.append(" ".join(other))
            if rng.random() < 0.3:
                base = other
    texts += [passage + " " + prose(rng.randrange(3, 60), 1000 + i) for i in range(40)]
    texts += [texts[3].upper(), texts[3], "tiny text", "tiny  text", "", None]
    return texts


@pytest.mark.parametrize("shingle, percent", [(3, 85), (5, 80)])
def test_components_match_brute_force(spark, shingle, percent):
    texts = corpus()
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    sets = {i * 3: shingles(t, shingle) for i, t in enumerate(texts)}
    want = components(sets, percent)
    rows = minhash.near_duplicates(docs, minhash.Near(shingle=shingle, percent=percent)).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == {k: len(s) for k, s in sets.items()}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_joins_by_shuffle_give_the_same(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus())], "doc_id long, text string")
    a = minhash.near_duplicates(docs, minhash.Near(3, 85))
    b = minhash.near_duplicates(docs, minhash.Near(3, 85, broadcast_ids=0))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    kept = minhash.keep_one(docs)
    assert kept.schema == docs.schema
    assert kept.where("doc_id = 6").count() == 1 and kept.where("doc_id in (7, 8)").count() == 0
    assert minhash.keep_one(empty_documents(spark)).count() == 0


def test_least_matches_miss_rarely():
    near = minhash.Near(3, 85)
    assert 0 < near.least < near.size


def test_null_and_repeated_keys_lose_no_other_text(spark):
    texts = [prose(60, 100 + i) for i in range(8)]
    near = texts[1].replace(texts[1].split()[7], "changed")
    rows = [(None, texts[0]), (None, texts[2]), (None, texts[0]), (5, texts[1]), (5, texts[3]), (6, texts[4]), (3, near), (None, ""), (7, None), (7, None)]
    docs = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, unknown int").repartition(3)
    kept = sorted(r["unknown"] for r in minhash.keep_one(docs).collect())
    # of the two null rows with one text one stays; key 5's first text goes for key 3's, its other one stays
    assert kept in ([0, 1, 4, 5, 6, 7, 8, 9], [1, 2, 4, 5, 6, 7, 8, 9])
    assert minhash.keep_one(docs).columns == docs.columns
