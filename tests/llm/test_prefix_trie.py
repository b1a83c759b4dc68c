import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from signalmill.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key int"


def brute(rows):
    """Nodes of the trie of all rebuilt conversations, from their prefixes."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ends[s].append(c)
    children = defaultdict(set)
    for k in members:
        if k:
            children[k[:-1]].add(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(children[k]), leaves[k], saved[k], sha(k)) for k, m in members.items())


def trie(spark, rows, n=3, **how):
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(n)
    got = T.prefix_trie(d, **how).withColumn("parent_conv_id", F.coalesce("parent_conv_id", F.lit(-1))).collect()
    return sorted(tuple(r) for r in got)


def test_random_conversations_against_prefixes(spark):
    rng = random.Random(4)
    rows = []
    for c in rng.sample(range(420), 160):
        for t in range(rng.choice([1, 2, 3, 6, 11])):
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", "user", None]), rng.choice(["", "a", "bé", None, "a"])))
    rows += [(c, t, "user", f"same {t}") for c in range(500, 560) for t in range(10)] + [(c, t, "user", f"same {t}") for c in range(600, 603) for t in range(19 + c % 2)]
    rng.shuffle(rows)
    want = brute(rows)
    # Spans of seven ids are streamed, and conversations of more than eight turns are numbered in parts.
    assert trie(spark, rows, n=5, long=8, span=7) == want
    assert max(r[3] for r in want if r[1] > 5) > 40


def test_one_conversation_turnless_ones_and_a_long_text(spark):
    lone = [(7, t, "user", "x" * 300_000 if t == 1 else "y") for t in range(9)]
    assert trie(spark, lone) == brute(lone)
    # Without a leader and with fewer turns than are replaced nothing is left.
    none = [(c, 0, "user", "hello") for c in range(101, 140)]
    want = brute(none)
    assert trie(spark, none) == want and want[0][1] == 0 and want[0][7] != hashlib.sha256(b"").hexdigest()


def test_repeated_rows_null_ids_and_nothing(spark):
    rows = [(0, 1, "user", "b"), (0, 1, "user", "a"), (0, None, None, None), (0, None, None, None), (None, 0, "user", "zzz"), (5, 0, "user", "b"), (5, 1, "user", "c")] * 2
    assert trie(spark, rows) == brute(rows)
    assert trie(spark, rows, leader=F.lit(-1), head=F.lit(0))[0][:4] == (0, 0, -1, 2)
    empty = spark.createDataFrame([], SCHEMA)
    assert T.prefix_trie(empty).collect() == [] and T.prefix_trie(empty.unionByName(spark.createDataFrame([(None, 1, "u", "t", "x", 1)], SCHEMA))).collect() == []
