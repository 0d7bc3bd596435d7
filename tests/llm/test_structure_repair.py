import hashlib
import heapq
import random
import re
import zlib

from strata.llm import structure_repair as sr

SCHEMA = "conv_id long, turn long, role string, text string, dropped boolean, place string, fault int"
GOOD = re.compile(r"(s?(ua)+)?\Z")
WORD = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    found, seen = [], set()
    for role, text in rows:
        said = WORD.findall(text)
        found.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(rows):
    """(cost, audit, repaired): a search over all edits by cost, then audit, that knows nothing of states or costs to go."""
    marks = faults(rows)
    queue, best, done = [(0, "", 0, "", ())], None, set()
    while queue:
        cost, audit, i, initials, out = heapq.heappop(queue)
        if i == len(rows) and GOOD.match(initials):
            return cost, audit, "\n".join(out)
        if (i, initials) in done or len(initials) > 2 * len(rows) + 4 or not re.match(r"s?(ua)*u?\Z", initials):
            continue
        done.add((i, initials))
        for role in ("user", "assistant"):
            heapq.heappush(queue, (cost + 5, audit + "I", i, initials + role[0], (*out, f"{role}:")))
        if i < len(rows):
            (role, text), extra = rows[i], 5 if marks[i] == "truncated" else 0
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, initials, out))
            if marks[i] not in ("blank", "duplicate"):
                heapq.heappush(queue, (cost + extra, audit + "K", i + 1, initials + (role[:1] or "?"), (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    heapq.heappush(queue, (cost + 1 + extra, audit + "R", i + 1, initials + new[0], (*out, f"{new}:{text}")))
    return best


def brute(rows):
    """``rows``: (turn, role, text) in order."""
    said = [r[1:] for r in rows]
    marks, (cost, audit, repaired) = faults(said), cheapest(said)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
    return gaps, *(marks.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(repaired.encode()).hexdigest()


def results(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_cheapest_edits(spark):
    rng, found = random.Random(2), {}
    for k in range(300):
        n = rng.randrange(0, 7)
        found[k] = [(t, rng.choice(["user", "assistant", "system", "tool", "", "user", "assistant"]), rng.choice(["a.", "b!", "c", " ", "", "d?  \n", "é."])) for t in range(n)]
    rows = [(k, *r, False, "x", 1) for k, v in found.items() for r in v] + [(k, 0, "user", "gone.", True, "x", 1) for k in found]
    rng.shuffle(rows)
    got = results(sr.repair(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert got == {k: brute(v) for k, v in found.items()}


def test_damage(spark):
    rng = random.Random(4)
    rows = [(k, t, rng.choice(["user", "assistant"]), rng.choice(["One. Two!", "x", "?"])) for k in range(60) for t in range(5)]
    rows += [(None, 1, None, None), (70, None, "user", "a."), (70, 3, "assistant", "b."), (70, None, "assistant", "c.")]
    want = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text if text is not None else " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    for v in want.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert results(sr.repair(sr.damaged(df))) == {k: brute(v) for k, v in want.items()}


def test_odd_tables(spark):
    assert sr.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert results(sr.repair(spark.createDataFrame([(9, 1, "user", "x.", True, "x", 1)], SCHEMA))) == {9: nothing}
    # a conversation of many turns, each with a long text, repeated rows and null turns
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "w" * 2000 + f"{t}.") for t in range(3000)] + [(1, None, "system", "s."), (1, None, "system", "s.")]
    got = results(sr.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)))[1]
    assert got[:6] == (0, 0, 1, 0, 1, 2) and got[6] == "DK" + "K" * 3000 or got[6] == "KD" + "K" * 3000
