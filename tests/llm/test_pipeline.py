import re

import corpus_pipeline
from strata.llm import queries
from tests.llm import test_decontaminate, test_minhash, test_mixing, test_quality_rules

SF = "/root/testdata/sf0.001"


def test_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert set(rows) <= set(before)
        if name == "quality":
            kept = {r["doc_id"] for r in rows}
            for r in before:
                n, _, _, _, repeated = test_quality_rules.brute(r["text"])
                if n < 20 or 100 * repeated > 30 * n:
                    assert r["doc_id"] not in kept
            assert len(rows) > 0.7 * len(before)
        elif name == "near_dedup":
            groups = test_minhash.components({r["doc_id"]: test_minhash.shingles(r["text"], 5) for r in before}, 80)
            assert {r["doc_id"] for r in rows} == set(groups.values()) and len(rows) == len(set(groups.values()))
        elif name == "decontamination":
            bad = {x[0] for x in test_decontaminate.brute([(r["doc_id"], r["text"]) for r in before], benchmark) if x[5]}
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before} - bad
        elif name == "mix":
            words, taken, most = {}, {}, {}
            for r in before:
                n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
                words[r["source"]] = words.get(r["source"], 0) + n
                most[r["source"]] = max(most.get(r["source"], 0), n)
            for r in rows:
                taken[r["source"]] = taken.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
            for s, t in test_mixing.water(words).items():
                assert abs(taken.get(s, 0) - t) <= most[s]
        else:
            assert len(rows) == len(before) and sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in before)


def test_every_operator_has_its_query():
    names = set(queries.QUERIES)
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    from tests.llm.common import empty_documents, odd_documents

    items = spark.createDataFrame([("a", None), ("b", ""), (None, "one two three")], "item_id string, text string")
    for name, docs in (("odd", odd_documents(spark)), ("empty", empty_documents(spark))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r["doc_id"] for r in out} <= {r["doc_id"] for r in odd_documents(spark).collect()}
    assert all(r["n_tokens"] >= 1 for r in out)
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
