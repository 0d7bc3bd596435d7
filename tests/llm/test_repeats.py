import hashlib
import random
import re

import pytest

from strata.llm import repeats
from tests.llm.common import empty_documents, odd_documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, n=13):
    first, out = {}, []
    for key, text in sorted(docs):
        w = WORD.findall(text or "")
        own = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        gone = set()
        for i, x in enumerate(own):
            if first.get(x, key) < key:
                gone.update(range(i, i + n))
        for x in own:
            first.setdefault(x, key)
        out.append((key, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def corpus():
    rng = random.Random(9)
    passages = [prose(n, 700 + n, 50) for n in (12, 13, 14, 30, 80)]
    docs = []
    for i in range(80):
        parts = [prose(rng.randrange(0, 60), i, 60)]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), prose(rng.randrange(0, 20), 90 + i, 60)]
        docs.append((i, "\n".join(parts)))
    return docs + [(80, docs[3][1]), (81, docs[3][1]), (82, "a b a b " * 30), (83, "a b a b " * 20), (84, None), (85, prose(5, 3)), (86, prose(5, 3))]


@pytest.mark.parametrize("how", [repeats.Repeats(), repeats.Repeats(lookup=0, broadcast_ids=0)])
def test_matches_brute_force(spark, how):
    docs = corpus()
    out = repeats.cut_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), how)
    rows = sorted(tuple(r)[:4] for r in out.collect())
    assert rows == brute(docs)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    out = repeats.cut_repeats(docs).collect()
    assert len(out) == docs.count()
    by = {r["doc_id"]: r for r in out if r["doc_id"] in (0, 1, 7)}
    assert by[0]["n_words"] == by[1]["n_words"] == 0 and by[7]["n_removed"] == by[7]["n_words"] == 300
    two = spark.createDataFrame([(None, prose(40, 1)), (None, prose(40, 2)), (5, prose(40, 2) + " end")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in repeats.cut_repeats(two).collect()) == [(0, 0), (0, 40), (5, 0)]
    assert repeats.cut_repeats(empty_documents(spark)).count() == 0
    far = spark.createDataFrame([(repeats.NULLS, prose(40, 1))], "doc_id long, text string")
    with pytest.raises(Exception, match="keys must be below"):
        repeats.cut_repeats(far).collect()


def test_matches_are_one_interval_to_both_sides(spark):
    shared, other = " ".join(f"s{i}" for i in range(60)), prose(20, 6)
    docs = [(1, prose(30, 1) + " " + shared + " " + prose(9, 2)), (2, other + " x " + shared.replace("s40", "y") + " z " + other)]
    docs = spark.createDataFrame([(i, t) for i, t in docs], "id long, text string")
    spans = repeats.repeated_passages(docs, docs.select("id").limit(0), repeats.Repeats()).first()
    merged = []
    for s, e in sorted((x["start"], x["end"]) for x in spans["spans"]):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    words = docs.collect()[1]["text"].split()
    changed = [i for i, w in enumerate(words) if w == "y"]
    assert spans["id"] == 2 and merged[0][0] == 21 and merged[-1][1] == 81 and not any(s <= i < e for s, e in merged for i in changed)
