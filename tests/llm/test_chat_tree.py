import hashlib
import random

import pytest

from strata.llm import chat_tree
from strata.llm.common import scratch_path

SCHEMA = "conv_id long, turn long, role string, text string, start long, attends string, _conv int"
MARKS = ["</s>[INST] ok [/INST]", "\\", "<\\/s>", "<", "[", "[/INST", "\\\\</s>", "s>", "<s>\\n", "é\U0001f600", ""]


def chats():
    """(conv_id, [(turn, role, text)]): trees with shared beginnings, copies, prefixes of others, logs of one growing chat."""
    rng = random.Random(3)
    out, nodes = {}, [[]]
    for i in range(60):
        path = list(rng.choice(nodes))
        for _ in range(rng.randrange(1, 4)):
            path.append((rng.choice(["user", "assistant", "system"]), rng.choice(MARKS) + rng.choice("abc")))
            nodes.append(list(path))
        out[i] = path
    out[60], out[61], out[62] = out[5], out[5][:1], out[7] + [("assistant", "x")]
    long = [("user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(30)]
    out |= {100 + i: long[: i + 1] for i in range(30)} | {200 + i: long[:10] for i in range(40)}
    return out


def table(spark, found):
    rows = [(k, t, role, text, 1, "x", 2) for k, turns in found.items() for t, (role, text) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute(turns):
    said = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in said if r == "assistant")
    size = sum(len(f"[INST]{chat_tree.escape(r)}[/INST]{chat_tree.escape(t)}</s>") for r, t in said)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(said), digest("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), digest(loss), size


def test_escapes_are_reversible_and_hide_control_strings():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(["\\", "<", "/", "s", ">", "[", "INST", "]", "</s>", "[/INST]", "n"]) for _ in range(rng.randrange(9)))
        safe = chat_tree.escape(text)
        assert chat_tree.unescape(safe) == text and not any(c in safe for c in ("</s>", "<s>", "[INST]", "[/INST]"))
        assert chat_tree.parse(f"[INST]{safe}[/INST]{safe}</s>") == (text, text)


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_round_trip(spark, broadcast_rows):
    found = chats()
    form = chat_tree.Format(broadcast_rows=broadcast_rows)
    rows = chat_tree.format_chats(table(spark, found), form).collect()
    assert {r[0]: tuple(r)[1:] for r in rows} == {k: brute(t) for k, t in found.items()} and len(rows) == len(found)


def test_shared_turns_once_a_shard_with_positions_and_intervals(spark):
    found = chats()
    path = scratch_path(spark, "chats")
    chat_tree.write_chats(table(spark, found), path)
    rows = sorted(spark.read.schema(chat_tree.ROWS_DDL).parquet(path).collect(), key=lambda r: (r["shard"], r["place"]))
    through = {}
    for turns in found.values():
        for d in range(len(turns)):
            through[tuple(turns[: d + 1])] = through.get(tuple(turns[: d + 1]), 0) + 1
    for shard in {r["shard"] for r in rows}:
        of = [r for r in rows if r["shard"] == shard]
        sequence = "".join(r["text"] for r in of if r["start"] is not None)
        seen = set()
        for r in of:
            before = "".join(sequence[i["from"] : i["to"]] for i in r["attends"])
            assert all(a["to"] < b["from"] for a, b in zip(r["attends"], r["attends"][1:]))
            if r["start"] is None:
                assert before == "".join(f"[INST]{chat_tree.escape(a)}[/INST]{chat_tree.escape(b)}</s>" for a, b in found[r["conv_id"]])
                assert r["position"] == len(before)
                continue
            assert r["position"] == len(before) and sequence[r["start"] : r["start"] + len(r["text"])] == r["text"]
            assert before + r["text"] not in seen
            seen.add(before + r["text"])
            turns = tuple(chat_tree.parse(s + "</s>") for s in (before + r["text"]).split("</s>")[:-1])
            assert r["n_conversations"] == through[turns]
            assert (r["learned"] is not None) == (turns[-1][0] == "assistant")


def test_one_shard_holds_every_turn_of_the_tree_once(spark):
    found = chats()
    path = scratch_path(spark, "chats")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        chat_tree.write_chats(table(spark, found), path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    segments = spark.read.schema(chat_tree.ROWS_DDL).parquet(path).where("start is not null")
    assert segments.count() == len({tuple(t[: d + 1]) for t in found.values() for d in range(len(t))})


def test_ids_of_a_tokenizer(spark):
    import public_tokenizers

    found = chats()
    form = chat_tree.Format(tokenizer=public_tokenizers.path("byte_bpe_50k.json"))
    rows = chat_tree.format_chats(table(spark, found), form).collect()
    assert {r[0]: tuple(r)[1:] for r in rows} == {k: brute(t) for k, t in found.items()}


def test_odd_turns(spark):
    rows = [(1, 1, None, None), (1, None, "assistant", "first"), (None, 0, "user", "a"), (None, 1, "assistant", "b" * 300_000), (2, 0, "user", "x"), (2, 0, "assistant", "y"), (2, 0, "assistant", "y"), (-1, 5, "user", "z")]
    got = {r["conv_id"]: tuple(r)[1:] for r in chat_tree.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1] == brute([("assistant", "first"), (None, None)]) and got[None] == brute([("user", "a"), ("assistant", "b" * 300_000)])
    assert got[2] == brute([("assistant", "y"), ("assistant", "y"), ("user", "x")]) and got[-1][0] == 1
    assert chat_tree.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
