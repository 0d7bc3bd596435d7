import hashlib
import random
import re

from strata.llm import decontaminate
from tests.llm.common import empty_documents, odd_documents, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=13):
    windows = {}
    for key, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(key))
    sizes, out = {len(k) for k in windows}, []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if held := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= held
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def corpus():
    rng = random.Random(3)
    items = [(i, prose(n, i + 50, 60)) for i, n in enumerate([40, 13, 12, 5, 1, 25, 14, 0, 90])] + [(9, None), (10, "A-b, c! D"), (11, prose(40, 50, 60)), (12, prose(40, 50, 60)[30:])]
    docs = []
    for i in range(60):
        text = prose(rng.randrange(0, 400), 500 + i, 60).split()
        for _ in range(rng.randrange(3)):
            w = words(items[rng.randrange(len(items))][1])
            a = rng.randrange(len(w) + 1)
            at = rng.randrange(len(text) + 1)
            text[at:at] = [x.upper() for x in w[a : a + rng.randrange(30)]]
        docs.append((i, " ".join(text)))
    return docs + [(60, None), (61, "a b, c.D")], items


def test_matches_brute_force_in_one_block_and_in_many(spark):
    docs, items = corpus()
    want = brute(docs, items)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limits in (decontaminate.Limits(), decontaminate.Limits(block_words=30)):
        found = decontaminate.find(d, i, limits).select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert sorted(map(tuple, found.collect())) == want


def test_spans_are_cut(spark):
    docs = spark.createDataFrame([(1, "keep, this! " + prose(400, 8) + "\none two three four. end"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "One two THREE four")], "item_id long, text string")
    rows = {r["doc_id"]: r["clean_text"] for r in decontaminate.cut_spans(docs, items).collect()}
    assert rows[1] == "keep, this! " + prose(400, 8) + "\n. end"
    assert rows[2] is None


def test_length_limit(spark):
    item = prose(19, 9)
    docs = spark.createDataFrame([(1, f"{prose(400, 8)} {item}"), (2, prose(400, 7))], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    for max_run, bad in ((0, False), (19, False), (18, True)):
        found = {r["doc_id"]: r["contaminated"] for r in decontaminate.find(docs, items, decontaminate.Limits(max_run=max_run)).select("row.doc_id", "contaminated").collect()}
        assert found == {1: bad, 2: False}


def test_odd_documents(spark):
    docs, items = odd_documents(spark), spark.createDataFrame([(1, "one two")], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.schema == docs.schema
    assert kept.count() == docs.count() - 2
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == docs.count()
    assert decontaminate.drop_contaminated(empty_documents(spark), items).count() == 0


def test_long_items_and_repeated_ones_make_blocks_of_bounded_size(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(900))
    items = spark.createDataFrame([(f"r{i}", "the same short item of words") for i in range(300)] + [("long", long), ("null", None), (None, long)], "item_id string, text string")
    limits = decontaminate.Limits(block_words=200, held_bytes=2000)
    paths = decontaminate.build_blocks(items, limits)
    assert len(paths) >= 4
    docs = [(1, "x " + " ".join(f"w{i}" for i in range(30, 60)) + " y"), (2, "the same short item of words"), (3, " ".join(f"w{i}" for i in range(888, 905))), (4, " ".join(f"w{i}" for i in range(850, 860)))] + [(10 + i, prose(50, i)) for i in range(50)]
    found = {r["row"]["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), items, limits).collect()}
    assert found[1] == (30, 1) and found[2] == (6, 300) and found[3] == (0, 0) and found[4] == (0, 0) and found[12] == (0, 0)
