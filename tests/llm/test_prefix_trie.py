"""The tree of beginnings against a plain version, over shards of every size."""

import hashlib
import random
import zlib

import pytest

from hoplens.llm import prefix_trie as trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def remainder(a, b):
    return a - int(a / b) * b


def plain_sequences(rows):
    turns = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            said = (role or "", text or "")
            digest = hashlib.sha256(f"{len(said[0].encode())}:{said[0]}{said[1]}".encode()).hexdigest()[:32]
            turns.setdefault(conv_id, []).append(((turn is not None, turn or 0), digest, said))
    own = {conv_id: [said for *_, said in sorted(found)] for conv_id, found in turns.items()}
    built = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - remainder(c, 5), [])[:h] + said[h:]
    return built


def plain_nodes(built):
    members, ended = {}, {}
    for c, said in built.items():
        for d in range(len(said) + 1):
            members.setdefault(tuple(said[:d]), []).append(c)
        ended.setdefault(tuple(said), []).append(c)
    children = {}
    for prefix in members:
        if prefix:
            children.setdefault(prefix[:-1], []).append(prefix)
    rows, leaves, saved = [], {}, {}
    for prefix in sorted(members, key=len, reverse=True):
        under = children.get(prefix, [])
        leaves[prefix] = sum(leaves[x] for x in under) if under else 1
        size = len(prefix[-1][1].encode()) if prefix else 0
        saved[prefix] = (len(members[prefix]) - 1) * size + sum(saved[x] for x in under)
        ends = ",".join(map(str, sorted(ended.get(prefix, []))))
        rows.append(
            (min(members[prefix]), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(members[prefix]), len(under),
             leaves[prefix], saved[prefix], hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(rows, key=str)


def check(spark, rows, parts=4):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)
    frame = frame.selectExpr("*", *(f"'x' AS `{name}`" for name in "path sizes base said own key kind shard depth ends above".split()))
    got = trie.prefix_nodes(trie.rebuilt_paths(frame))
    assert got.columns == COLUMNS
    assert sorted((tuple(row) for row in got.collect()), key=str) == plain_nodes(plain_sequences(rows))


@pytest.mark.parametrize("shard", [1, 7, 60, 100_000])
def test_shared_beginnings(spark, monkeypatch, shard):
    monkeypatch.setattr(trie, "SHARD_TURNS", shard)
    rng = random.Random(shard)
    rows = []
    for c in range(-20, 120):
        for turn in range(rng.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["hi", "é", "", "long " * 4])))
    check(spark, rows)


def test_a_group_of_copies_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARD_TURNS", 20)
    monkeypatch.setattr(trie, "FEW_NODES", 3)
    rows = [(c, turn, "user", f"turn {turn}") for c in range(300) for turn in range(9 + (c % 100 == 7))]
    rows += [(c, 0, "user", f"turn {c % 3}") for c in range(300, 340)]
    check(spark, rows)


def test_a_sequence_that_begins_the_next_shards_first(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARD_TURNS", 1)
    rows = [(5 * c, turn, "user", f"t{turn}") for c in range(12) for turn in range(c + 1)]
    check(spark, rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "nobody's"), (0, None, None, None), (0, 1, "user", None), (0, 1, None, "user"), (0, 2, "user", "x" * 100_000),
        (1, 1, "user", "same turn"), (1, 1, "user", "same turn"), (1, 1, "user", "other"), (7, 3, "a", "b"), (7, 3, "ab", ""),
        (9, None, "z", "only"), (-3, 1, "user", "\U0001f600"), (2**62, 1, "user", "far"),
    ]
    check(spark, rows)


def test_a_conversation_without_turns_is_at_the_root(spark):
    alone = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    check(spark, [(alone, 1, "user", "gone")])


def test_a_very_long_conversation(spark):
    check(spark, [(5, turn, "user", f"{turn % 50}") for turn in range(3000)] + [(10, turn, "user", f"{turn % 50}") for turn in range(2999)])


def test_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_nodes(trie.rebuilt_paths(frame)).collect() == []


def test_medians_come_first_and_keep_the_tree_flat():
    assert list(trie.medians_first(7))[:3] == [3, 1, 5]
    assert sorted(trie.medians_first(1000)) == list(range(1000))
    tree = trie.TernaryTree()
    for i in trie.medians_first(1000):
        tree.insert([i], [1])
    deepest, open_nodes = 0, [(tree.down[0], 1)]
    while open_nodes:
        at, depth = open_nodes.pop()
        if at >= 0:
            deepest = max(deepest, depth)
            open_nodes += [(tree.low[at], depth + 1), (tree.high[at], depth + 1)]
    assert deepest <= 10


def test_partial_nodes_are_few(spark, monkeypatch):
    """Only nodes above a shard's first and last sequence are handed on."""
    monkeypatch.setattr(trie, "SHARD_TURNS", 500)
    rows = [(5 * c, turn, "user", f"{c} {turn}" if turn else "hello") for c in range(500) for turn in range(4)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    counted = {}
    real = trie.scratch_path
    monkeypatch.setattr(trie, "scratch_path", lambda session, name: counted.setdefault("at", real(session, name)))
    trie.prefix_nodes(trie.rebuilt_paths(frame)).count()
    assert spark.read.parquet(f"{counted['at']}/partial").count() <= 5 * 8
