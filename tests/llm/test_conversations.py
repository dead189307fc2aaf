import hashlib
import random
import re
import zlib
from functools import cache

from chainframe.llm.conversations import conversation_repair, damaged, repaired

SCHEMA = "conv_id long, turn long, role string, text string, extra string, gone string"
KEEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def brute(rows):
    found, text = {}, lambda x: " " if x is None else str(x)
    for conv, turn, role, words, *_ in rows:
        kept = found.setdefault(conv, [])
        hit = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        role, words = text(role), text(words)
        words = "" if hit == 1 else re.sub("[.!?]", "", words) if hit == 2 else words
        kept += [(turn, "user" if hit == 4 else role, words)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    out = []
    for conv, kept in found.items():
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        faults, seen = [], set()
        for _, role, words in kept:
            bare = re.sub(r"[\x20\x09-\x0D]+$", "", words)
            faults.append("b" if not bare else "d" if (role, words) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, words))
        turns = [x[0] for x in kept if x[0] is not None]
        initials = [x[1][:1] for x in kept]

        @cache
        def best(k, g, added):
            tries = [(0, "", None)] if k == len(kept) and g in (0, 3) else []
            if added < 3:
                cost, letters, rest = best(k, NEXT[g], added + 1)
                tries.append((cost + 2, "I" + letters, ("user" if NEXT[g] == 2 else "assistant", "", rest)))
            if k < len(kept):
                cost, letters, rest = best(k + 1, g, 0)
                tries.append((cost + 3, "D" + letters, rest))
                if faults[k] in ("", "t"):
                    more = faults[k] == "t"
                    cost, letters, rest = best(k + 1, NEXT[g], 0)
                    tries.append((cost + 2 + more, "R" + letters, ("user" if NEXT[g] == 2 else "assistant", kept[k][2], rest)))
                    if (initials[k], g) in KEEP:
                        cost, letters, rest = best(k + 1, KEEP[initials[k], g], 0)
                        tries.append((cost + more, "K" + letters, (kept[k][1], kept[k][2], rest)))
            return min(tries, key=lambda x: x[:2]) if tries else (10**9, "~", None)

        for k in range(len(kept), 0, -50):  # shallow recursion
            for g in range(4):
                best(k, g, 0)
        cost, letters, rest = best(0, 0, 0)
        lines = []
        while rest:
            lines.append(f"{rest[0]}:{rest[1]}")
            rest = rest[2]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def some_rows(n=60):
    rng = random.Random(7)
    texts = ["Yes.", "no", "  \n", "", None, "What?", "go on!\t ", "Well. so", "é日。", "Yes. "]
    roles = ["user", "assistant", "system", "tool", None, "", "Umpire", "DELETE", "rerole"]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn * 2, None, -turn]), rng.choices(roles, [9, 9, 3, 1, 1, 1, 1, 1, 1])[0], rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}.", "x", "y"))
    rows += [(None, k, "user", "a.", None, None) for k in range(3)] + [rows[0], rows[0]]
    rows += [(1000 + k, None, None, None, None, None) for k in range(3)]
    return rows


def test_repairs_equal_brute_force(spark):
    rows = some_rows()
    found = conversation_repair(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert found.columns[0] == "conv_id" and sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_long_conversations_go_on_in_stretches(spark):
    rng = random.Random(3)
    rows = some_rows(20)
    for conv, n in ((5, 130), (77, 64), (78, 300), (79, 1)):
        rows += [(conv, k, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Same.", f"{k}.", f"{k}", "", "ok!"]), None, None) for k in range(n)]
    want = brute(rows)
    for size in (4, 16, 50):
        found = repaired(damaged(spark.createDataFrame(rows, SCHEMA)), size)
        assert sorted(map(tuple, found.collect()), key=str) == want
    assert sorted(map(tuple, repaired(damaged(spark.createDataFrame(rows, SCHEMA)), 4_096, 200).collect()), key=str) == want


def test_no_rows_and_lost_conversations(spark):
    assert not conversation_repair(spark.createDataFrame([], SCHEMA)).collect()
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert tuple(conversation_repair(spark.createDataFrame([(gone, 0, "user", "Hi.", "", "")], SCHEMA)).first()) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
