import itertools
import random
import re

from strata.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(rows):
    """The letters of the filters that each row fails; rows are (doc_id, text, ...)."""
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(r[0], first.get(r[1] or "", r[0]))
    found = []
    for r in rows:
        text = r[1] or ""
        words = WORD.findall(text)
        bad = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": r[0] is not None and r[0] > first[text]}
        found.append({k for k, v in bad.items() if v})
    return found


def brute(rows, labels):
    found, out, total = fails(rows), {}, {}
    good, toxic = ({d for d, *v in labels if d is not None and v[i] == 1} for i in (0, 1))
    for part in {r[2] or "" for r in rows}:
        of = [(r[0], f) for r, f in zip(rows, found) if (r[2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = of
            for step, x in enumerate(order, 1):
                gone = [d for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                redundant = sum(x in f for _, f in of) - len(gone)
                unique = sum(f == {x} for _, f in of)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, unique, sum(d in good for d in gone), sum(d in toxic for d in gone)]
                total[part, x] = total.get((part, x), 0) + len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_every_order_by_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "one", "A B C", "# x", " ".join(f"w{i}" for i in range(120)), "UP " * 130, "é" * 50_000, " ".join(["word"] * 200) + " |", " ".join(f"W{i}" for i in range(100))]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, "", "xx"]), 7, "x") for i in range(300)]
    rows += [(None, texts[5], "en", 7, "x"), (4, rows[4][1], "en", 7, "x"), (4, rows[4][1], "en", 7, "x"), (None, None, None, 7, "x")]
    labels = [(rng.randrange(300), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(200)] + [(None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, mask int, part string").repartition(4)
    got = filter_audit.audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in got} == brute(rows, labels)
    assert len(got) == 600 * 4


def test_empty_tables_and_no_failures(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(100)), "en")], "doc_id long, text string, lang string")
    assert filter_audit.audit_filters(docs.limit(0), labels).count() == 0
    rows = filter_audit.audit_filters(docs, labels).collect()
    assert len(rows) == 600 and all(r["kept"] == 1 and r["removed"] == r["redundant"] == r["shapley"] == 0 for r in rows)


def test_other_filters(spark):
    found = spark.createDataFrame([("p", 1, 5, 1, 0), ("p", 3, 2, 0, 1), ("p", 0, 4, 0, 0)], "part string, mask int, n long, n_good long, n_toxic long")
    rows = {(r["filter_order"], r["step"]): r for r in filter_audit.audit(found, "XY").collect()}
    assert rows["XY", 1]["removed"] == 7 and rows["XY", 2]["removed"] == 0 and rows["XY", 2]["redundant"] == 2
    assert rows["YX", 1]["removed"] == 2 and rows["YX", 2]["removed"] == 5 and rows["YX", 2]["kept"] == 4 and rows["XY", 1]["shapley"] == 12
