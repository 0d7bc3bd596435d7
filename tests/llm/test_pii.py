import hashlib
import math
import random
import re

from strata.llm import pii
from tests.llm.common import empty_documents, odd_documents

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in found.split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def brute(text):
    spans = [(m.start(), i, k, m.end()) for i, k in enumerate(PLAIN) for m in re.finditer(PLAIN[k], text or "") if valid(k, m[0])]
    return sorted(spans)


def texts():
    rng = random.Random(2)
    parts = ["a@b.c", "a@b.c_d@e.f", "x.y+z%1@sub.ex-ample.org", "@", "a@b", "a@b@c.d", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0255.001.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "+1 (269) 555-3296", "+1 2", "+123456789012345678", "é日", " ", ",", "\n", "9", "-", ".", "+", "word"]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 14))) for _ in range(500)]


def test_base_spans_match_brute_force(spark):
    docs = [(i, t) for i, t in enumerate([*texts(), None, "", "1" * 5000, "a" * 20000, "a@" + "b." * 3000 + "c", "+" + "(" * 3000])]
    rows = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        spans = brute(t)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        assert [rows[i][f"n_{k}"] for k in PLAIN] == [sum(s[2] == k for s in spans) for k in PLAIN]
        assert rows[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(rows[i]["spans"].split(","))


def test_sure_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"Hello, you can reach me at user{i}@mail.example.com any time") for i in range(30)]
    rows += [(100, "you can reach me at boss@intranet please"), (101, "I counted 12 sheep, then room 7"), (102, "look at 42@x")]
    found = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[100] == "email:20:33" and found[101] == "" and found[102] == ""
    assert found[3] == brute(rows[3][1])[0][2] + ":27:49"


def test_long_words_around_are_read_whole(spark):
    long = "z" * 300
    rows = [(i, f"contact {long} user{i}@mail.example.com") for i in range(30)] + [(100, f"contact {long} boss@intranet"), (101, f"contact {long}z boss2@intranet")]
    found = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[100] == "email:309:322" and found[101] == ""


SF = "/root/testdata/sf0.001"
FRAMES = ["please write to {} for an answer", "my number is {} after five", "the host at {} was slow", "charge it to {} this time"]


def known_and_unseen(i):
    """Identifiers that the base patterns know, and such that they don't, of each kind."""
    return [
        (f"n{i}.x@mail{i % 9}.example.com", f"n{i}@intranet"), (f"+1 ({200 + i}) 555-{4000 + 7 * i}", f"({300 + i}) 555-{2000 + 7 * i}"),
        (f"10.{i}.7.{i + 1}", f"10.{i}.7.{300 + i}"), (next(str(n) for n in range(4111111111110000 + 100 * i, 10**17) if luhn(str(n))), next(str(n) for n in range(5111111111110000 + 100 * i, 10**17) if not luhn(str(n)))),
    ]


def test_recall_of_planted_unseen_identifiers(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    planted, at = [], {}
    for i in range(40):
        for k, (frame, (seen, unseen)) in enumerate(zip(FRAMES, known_and_unseen(i))):
            planted.append((10**6 + 10 * i + k, f"Well then, {frame.format(seen)} and so on"))
            if i < 10:
                text = f"Well then, {frame.format(unseen)} and so on"
                at[2 * 10**6 + 10 * i + k] = f"{['email', 'phone', 'ip', 'card'][k]}:{text.index(unseen)}:{text.index(unseen) + len(unseen)}"
                planted.append((2 * 10**6 + 10 * i + k, text))
    every = docs.union(spark.createDataFrame(planted, docs.schema))
    found = {r["doc_id"]: r["spans"].split(",") for r in pii.find(every).collect()}
    assert sum(span in found[k] for k, span in at.items()) >= 0.9 * len(at)
    # all other rows have their base spans only
    for r in docs.collect():
        assert [x for x in found[r["doc_id"]] if x] == [f"{k}:{a}:{b}" for a, _, k, b in brute(r["text"])]


def test_graph_is_scored_as_by_brute_force(spark):
    rng = random.Random(5)
    frames = ["write to {} now please", "call me {} or else", "it is {} they say"]
    texts = [(i, " . ".join(rng.choice(frames).format(rng.choice([f"u{rng.randrange(60)}@m.org"] * 4 + [f"u{rng.randrange(5)}@host", f"55500{rng.randrange(4)}0000", "x 12 y"] + [f"+1 {rng.randrange(10**8, 10**9)}"] * 4)) for _ in range(rng.randrange(1, 5)))) for i in range(150)]
    rows = spark.createDataFrame(texts, "key long, text string").selectExpr("key as row", "text")
    found = rows.select("row", pii.base_spans(rows["text"]).alias("base"), pii.candidates(rows["text"]).alias("cands"))
    edges = [r.asDict() for r in pii.pattern_edges(found).collect()]
    graph = {(p, e["instance"]) for e in edges for p in e["patterns"]}
    known = {}
    for e in edges:
        if e["seed"] is not None:
            known[e["instance"]] = min(e["seed"], known.get(e["instance"], 9))
    seeds, size, how = set(known), {}, pii.Bootstrap()
    for p, _ in graph:
        size[p] = size.get(p, 0) + 1
    while True:
        k = {}
        for p, i in graph:
            if i in known:
                k[p, known[i]] = k.get((p, known[i]), 0) + 1
        doubt = {}
        for (p, rank), n in k.items():
            c = n / ((size[p] + sum(m for (q, _), m in k.items() if q == p)) / 2 + 1)
            if n >= how.least_known and c >= how.least_confidence:
                for q, i in graph:
                    if q == p:
                        doubt[i, rank] = doubt.get((i, rank), 0) + round(math.log1p(-c) * 1e6)
        more = {}
        for (i, rank), x in doubt.items():
            if i not in known and 1 - math.exp(x / 1e6) >= how.least_score:
                more[i] = min(more.get(i, (0, 9)), (x, rank))
        if not more:
            break
        known |= {i: rank for i, (_, rank) in more.items()}
    want = sorted((e["row"], e["start"], e["end"], known[e["instance"]]) for e in edges if e["seed"] is None and e["instance"] in known and e["instance"] not in seeds)
    got = sorted(tuple(r) for r in pii.bootstrap_spans(found, how).collect())
    assert got == want and want


def test_odd_documents(spark):
    docs = odd_documents(spark)
    assert pii.find(docs).count() == docs.count()
    assert pii.find(empty_documents(spark)).count() == 0


def test_runs_without_python(spark):
    rows = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    assert "Python" not in pii.find(rows)._jdf.queryExecution().executedPlan().toString()
