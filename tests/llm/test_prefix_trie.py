"""The trie of conversations against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from millrace.llm import prefix_trie, queries, scans

SCHEMA = "conv_id long, turn long, role string, text string, a int, k string, bytes string"


def brute(rows):
    """rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node, ms in members.items():
        if node:
            children[node[:-1]] += 1
            for d in range(len(node) + 1):
                saved[node[:d]] += (len(ms) - 1) * len(node[-1][1].encode())
    for node in members:
        if not children[node]:
            for d in range(len(node) + 1):
                leaves[node[:d]] += 1
    out = []
    for node, ms in members.items():
        ends = ",".join(map(str, sorted(c for c in ms if len(built[c]) == len(node))))
        out.append((min(ms), len(node), min(members[node[:-1]]) if node else None, len(ms), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(df):
    return sorted(map(tuple, prefix_trie.prefix_trie(df).collect()), key=repr)


def rows(n=120, seed=2):
    rng = random.Random(seed)
    out = []
    for c in range(-7, n):
        if c % 17 == 3:
            continue
        for turn in range(rng.choice([1, 2, 3, 5, 8, 9, 13, 21])):
            out.append((c, turn, ["user", "assistant", None][turn % 3], rng.choice(["hi", "é日本", "", None, "x" * 70 + str(turn % 2)])))
    out += [(500, None, "user", "first"), (500, None, None, None), (500, 2, "user", "b"), (500, 2, "user", "a"), (500, 2, "user", "a"), (None, 1, "user", "lost")]
    out += [(c, t, "u", "same") for c in (1000, 1001, 1002, 2000, 3001) for t in range(40)]
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_trie(spark, parts):
    df = spark.createDataFrame([(*r, 1, "k", "b") for r in rows()], SCHEMA).repartition(parts)
    assert trie(df) == brute(rows())


def test_one_long_conversation_and_copies(spark):
    long = [(5, t, "u", f"turn {t % 50}") for t in range(3000)]
    copies = [(c, t, "u", f"turn {t}") for c in range(5, 400, 5) for t in range(9)]
    df = spark.createDataFrame([(*r, 1, "k", "b") for r in long + copies[9:]], SCHEMA)
    assert trie(df) == brute(long + copies[9:])


def test_no_conversation(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert trie(df) == []
    only_null = spark.createDataFrame([(None, 1, "u", "x", 1, "k", "b")], SCHEMA)
    assert trie(only_null) == []
    one = spark.createDataFrame([(3, None, None, None, 1, "k", "b")], SCHEMA)  # its one turn is cut away
    assert trie(one) == brute([(3, None, None, None)]) and len(trie(one)) == 1


def test_registered_query(spark, sf_dir):
    table = queries.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    got = sorted(map(tuple, queries.op13_conversation_trie(spark, sf_dir).collect()), key=repr)
    assert got == brute([tuple(r) for r in table.collect()])


def test_running_over_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 1, 2, 9]), i, rng.randrange(1 << 50), rng.randrange(1000)) for i in range(5000)]
    df = spark.createDataFrame(rows, "key long, i long, x long, s long").repartition(5)
    got = {r.i: (r.at, r.x_to, r.s_to) for r in scans.running(df, "key", [df.i], ["x"], ["s"], "t").collect()}
    state = defaultdict(lambda: [0, 0, 0])
    for k, i, x, s in rows:
        now = state[k]
        now[1] ^= x
        now[2] += s
        assert got[i] == tuple(now)
        now[0] += 1


def test_look_up_by_a_hot_key(spark):
    rows = spark.range(6000).selectExpr("id", "case when id % 3 > 0 then 0 else id end as k")
    facts = rows.groupBy("k").count().withColumnRenamed("count", "w")
    got = scans.looked_up(rows, facts, ["k"], "w", 6000).collect()
    assert sorted(r.id for r in got) == list(range(6000)) and {r.w for r in got if r.k == 0} == {4001}
