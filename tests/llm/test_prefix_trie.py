"""op12 against a plain trie of dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The nodes of rows (conv_id, turn, role, text) as tuples, in order."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((t is not None, t or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()), (role, text)))
    own = {c: [turn for _, turn in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, m in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += kids[path] == 0
            saved[path[:d]] += (len(m) - 1) * (len(path[-1][1].encode()) if path else 0)
    text = lambda path: ",".join(map(str, sorted(c for c in members[path] if len(whole[c]) == len(path))))
    out = [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(text(p).encode()).hexdigest()) for p, m in members.items()]
    return sorted(out, key=str)


def ours(frame, **options):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, prefix_trie.trie(frame, **options).select(*columns).collect()), key=str)


def made(seed, convs=60):
    """Copies, prefixes of one another, a comb that leaves one trunk at every depth, and conversations of one turn or many."""
    rng = random.Random(seed)
    trunk = [("user", f"t{i} é") for i in range(30)]
    rows = []
    for c in range(-7, convs):
        kind = rng.randrange(5)
        if kind == 0:
            seq = trunk[: rng.randrange(1, 31)] + [("bot", str(rng.randrange(3)))] * rng.randrange(3)
        elif kind == 1:
            seq = trunk[:20]
        elif kind == 2:
            seq = [("user", rng.choice("ab")) for _ in range(rng.randrange(1, 12))]
        elif kind == 3:
            seq = trunk[:1]
        else:
            seq = [("user", f"own {c}")] * rng.randrange(1, 25)
        rows += [(c, i, *turn) for i, turn in enumerate(seq) if c % 15 or c == 0]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "local"), [(0, 50_000), (1, 40), (2, 5), (3, 1)])
def test_nodes_are_those_of_a_plain_trie(spark, monkeypatch, seed, local):
    """From one bucket in one task to buckets of a row."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "COMMON", 20)
    rows = made(seed)
    assert ours(spark.createDataFrame(rows, SCHEMA).repartition(3), local=local) == brute(rows)


@pytest.mark.parametrize("local", [50_000, 6])
def test_odd_rows(spark, local):
    rows = [(5, None, None, None), (5, 0, "user", "x" * 70_000), (5, 0, "user", "b"), (5, 0, "user", "b"), (6, 3, "", ""), (6, None, "user", None), (None, 0, "user", "lost"), (8, 1, "a", "b"), (9, 1, "ab", "")]
    rows += [(7, i, "user", "") for i in range(40)] + [(12, i, "user", "") for i in range(40)] + [(2**62, 0, "user", "b"), (-(2**63), 0, "user", "b")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("pos", F.lit(1)).withColumn("bucket", F.lit("b")).withColumn("a.b", F.lit("b"))
    assert ours(frame, local=local) == brute(rows)
    assert ours(frame.limit(0), local=local) == []
    assert ours(frame.where("conv_id is null"), local=local) == []


def test_few_rounds_for_long_and_branching_conversations(spark, monkeypatch):
    """A trunk of 300 turns that members leave at every depth takes a few rounds, not one a depth."""
    rounds = []
    one = prefix_trie._partition
    monkeypatch.setattr(prefix_trie, "_partition", lambda *a: rounds.append(1) or one(*a))
    rows = [(5 * c, i, "user", f"t{i}") for c in range(60) for i in range(5 * c + 1)] + [(5 * c, 5 * c + 1, "bot", str(c)) for c in range(60)]
    got = ours(spark.createDataFrame(rows, SCHEMA), local=400)
    assert got == brute(rows) and 1 <= len(rounds) <= 12
