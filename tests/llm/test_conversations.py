"""Conversation repair and the prefix trie against plain versions."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from jobsignal.llm import conv_repair, ordered, prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, ghost_ string, part int"
#: Nulls in any column, ties, repeated rows, blank texts, roles of other kinds, clashing names; a very long text.
ODD = [
    (1, 0, "user", "Hi there.", "x", 1), (1, 1, "assistant", "Hello", None, 2), (1, 1, "assistant", "Hello", None, 2), (1, None, "system", "Be kind.", "x", 1),
    (2, None, None, None, None, None), (2, 3, "user", None, None, 1), (2, 9, None, "No role.", None, 1), (3, 0, "", "", "x", 1),
    (4, 0, "tool", "Made.", "x", 1), (4, 1, "system", "S.", "x", 1), (4, 2, "system", "S2.", "x", 1), (4, 3, "assistant", "A \t\n", "x", 1),
    (None, 0, "user", "Nobody?", "x", 1), (None, None, "assistant", "Somebody!", "x", 1), (-7, 5, "user", "Minus.", "x", 1), (-7, 5, "user", "Minus", "x", 1), (-7, 5, "assistant", "Tie.", "x", 1),
    (8, 0, "user", "word " * 300_000, "x", 1), (8, 1, "assistant", "word " * 300_000 + ".", "x", 1), (9, 0, "user", " \t\r\n", "x", 1),
]


def crc(text):
    return zlib.crc32(text.encode())


def say(x):
    return " " if x is None else str(x)


def brute_repair(rows):
    """conv_id -> result by uniform-cost search over (cost, audit)."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        kind = crc(f"{say(c)}:{say(turn)}") % 20
        role, text = say(role), say(text)
        by[c] += []
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        by[c] += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: brute_one(sorted(v)) for c, v in by.items()}


def brute_one(rows):
    turns = [t for known, t, _, _ in rows if known]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, roles, out = heapq.heappop(heap)
        state = roles[-1:] if roles[:1] != "s" or len(roles) > 1 else "s"
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            break
        may = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        put = lambda c, e, j, r, line: heapq.heappush(heap, (cost + c, audit + e, j, roles + r, (*out, line) if line is not None else out))  # noqa: E731, B023
        for r in ("user", "assistant"):
            if r[0] in may:
                put(3, "I", i, r[0], r + ":")
        if i < len(rows):
            _, _, role, text = rows[i]
            put(4, "D", i + 1, "", None)
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] else 0
                if role[:1] and role[:1] in may:
                    put(more, "K", i + 1, role[0], f"{role}:{text}")
                for r in ("user", "assistant"):
                    if r[0] in may:
                        put(3 + more, "R", i + 1, r[0], f"{r}:{text}")
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def repairs(df):
    rows = df.collect()
    assert df.dtypes == [tuple(f.split(" ")) for f in conv_repair._DONE.replace("long", "bigint").split(", ")]
    got = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def test_repair_odd_rows(spark):
    got = repairs(conv_repair.repair(conv_repair.damaged(odd(spark))))
    assert got == brute_repair([r[:4] for r in ODD])


def test_repair_empty(spark):
    assert conv_repair.repair(conv_repair.damaged(odd(spark).limit(0))).collect() == []


def test_repair_query(spark, sf01):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf01}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert repairs(queries.op11_conversation_repair(spark, sf01)) == brute_repair(rows)


def random_rows(n, seed, roles=("user", "assistant", "system", "tool")):
    rng = random.Random(seed)
    return [(rng.randint(0, 1) if rng.random() < 0.8 else rng.randint(2, 40), rng.choice([None, *range(60)]), rng.choice(roles), rng.choice(["", "a.", "b!", "c", f"d{rng.random()}.", "é?"])) for _ in range(n)]


@pytest.mark.parametrize("segment", [1, 3, 512])
def test_repair_across_partitions(spark, monkeypatch, segment):
    # most rows in two conversations, over many partitions and segments of few rows
    monkeypatch.setattr(conv_repair, "SEGMENT", segment)
    monkeypatch.setattr(conv_repair, "SEGMENT_BYTES", 40 if segment == 512 else 1 << 24)
    rows = random_rows(160, segment)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert repairs(conv_repair.repair(conv_repair.damaged(df))) == brute_repair(rows)


def test_cheapest_searches_all_ends():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(0, 6)
        rows = [(True, k, rng.choice(["s", "u", "a", "x", ""]), rng.choice([f"t{k}.", f"t{k}", ""])) for k in range(n)]
        faults = bytes(conv_repair.fault(t) for _, _, _, t in rows)
        assert conv_repair.cheapest([r[2] for r in rows], faults) == brute_one(rows)[-3:-1]


def test_long_conversations():
    n = 3000
    assert conv_repair.cheapest(["u"] * n, bytes(n)) == (n // 2 * 3, "KR" * (n // 2))
    assert conv_repair.cheapest(["s"] * n, bytes(n)) == (4 + 3 * (n - 2), "DK" + "R" * (n - 2))


# prefix trie


def brute_trie(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    by = {c: [r[2:] for r in sorted(v)] for c, v in by.items()}
    built = {}
    for c, own in by.items():
        h = crc(str(c)) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = tuple(by.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(node))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def tries(df):
    assert [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"]
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def test_trie_odd_rows(spark):
    rows = [r for r in ODD if not (r[0] == -7 and r[2] == "user" and r[3] == "Minus")]  # ties of one role go by hash
    assert tries(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute_trie([r[:4] for r in rows])


def test_trie_empty(spark):
    assert prefix_trie.prefix_trie(odd(spark).limit(0)).collect() == []


def test_trie_query(spark, sf01):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf01}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert tries(queries.op13_prefix_trie(spark, sf01)) == brute_trie(rows)


def test_trie_of_copies_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SPAN", 2)
    monkeypatch.setattr(ordered, "CHUNK", 16)
    rng = random.Random(3)
    long = [(t, rng.choice(["user", "assistant"]), f"turn {rng.randint(0, 3)} é") for t in range(90)]
    rows = [(c, *t) for c in range(0, 40, 5) for t in long[: 90 - c % 3 * 25]]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 180) for t in range(c % 4)]
    rows += [(c, t, "user", f"same {t}") for c in range(200, 260) for t in range(12)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert tries(prefix_trie.prefix_trie(df)) == brute_trie(rows)


def test_joined_digest(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK", 10)
    df = spark.range(500).select(F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("k"), "id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    got = {r.k: r.sha256 for r in ordered.joined_sha256(df.repartition(5), ["k"], ["id"], "v", "|").collect()}
    want = {k or None: hashlib.sha256("|".join(f"v{i}" for i in range(500) if i % 7 == k).encode()).hexdigest() for k in range(7)}
    assert got == want
