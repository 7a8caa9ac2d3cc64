"""The tree of all beginnings that conversations share.

Conversations become sequences of turns, a turn being a 128-bit digest of its role and text. Sequences are sorted and cut by range
into shards, so a shard holds whole subtrees but for the nodes above its first and last sequence. A task numbers its turns by a
dictionary and puts its sequences, medians first, into a ternary search tree, whose nodes it adds up from below. Nodes on the way
to a shard's first or last sequence are partial; they meet by a digest of their path.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from hoplens.llm import words
from hoplens.llm.common import measured, whole_text
from hoplens.session import scratch_path

#: Turns in a shard, about. A task holds one shard.
SHARD_TURNS = 50_000
#: Up to so many partial nodes are sent to every task; beyond, they are joined by a shuffle.
FEW_NODES = 100_000
#: Bytes of a turn's digest.
DIGEST = 16

NODE, PARTIAL, EDGE = range(3)
SCHEMA = (
    "kind int, shard int, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends string, first binary, last binary, last_sizes array<int>"
)
COUNTS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
NOBODY = hashlib.sha256(b"").hexdigest()


# Sequences


def rebuilt_paths(conversations: DataFrame, family: int = 5, cycle: int = 9) -> DataFrame:
    """``conv_id``, its turns' digests in a row (``path``) and their texts' bytes (``sizes``) after rebuilding.

    Turns are in the order of ``turn``, nulls first, and of their digest where that is equal. Conversation c begins with the first h
    turns of conversation c - c % family, h being crc32 of c's decimal text modulo ``cycle``, and goes on with its own turns
    after its first h. Null roles and texts are empty. Turns without a ``conv_id`` belong to no conversation and are left out.

    Texts are left behind before the only shuffle. A conversation is one row of 24 bytes a turn.
    """
    conv, role = F.col("conv_id"), F.coalesce(F.col("role"), F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, whole_text())
    turns = conversations.select("conv_id", "turn", "role", "text").where(conv.isNotNull()).select(
        conv.cast("long").alias("conv_id"),
        (conv - conv % family).cast("long").alias("base"),
        F.struct(
            "turn",
            F.substring(F.sha2(said, 256), 1, 2 * DIGEST).alias("digest"),
            F.octet_length(whole_text()).alias("bytes"),
        ).alias("said"),
    )
    gathered = turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("said")).alias("own"))
    begun = F.max(F.when(conv == F.col("base"), F.slice("own", 1, cycle - 1))).over(Window.partitionBy("base"))
    h = (F.crc32(conv.cast("string").cast("binary")) % cycle).cast("int")
    with_base = gathered.select("conv_id", "own", h.alias("h"), begun.alias("begun"))
    own = F.slice("own", F.col("h") + 1, F.size("own"))
    whole = F.when(F.col("begun").isNull(), own).otherwise(F.concat(F.slice("begun", F.lit(1), F.col("h")), own))
    return with_base.select("conv_id", whole.alias("turns")).select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda turn: turn["digest"]), "")).alias("path"),
        F.transform("turns", lambda turn: turn["bytes"]).alias("sizes"),
    )


# One shard


class TernaryTree:
    """Sequences of numbers. A node's children are a binary search tree, linked by ``low`` and ``high``; ``down`` is its root."""

    def __init__(self):
        self.key, self.low, self.high, self.down, self.up, self.size, self.depth = [-1], [-1], [-1], [-1], [-1], [0], [0]

    def _new(self, key: int, up: int, size: int) -> int:
        self.key.append(key)
        for links in (self.low, self.high, self.down):
            links.append(-1)
        self.up.append(up)
        self.size.append(size)
        self.depth.append(self.depth[up] + 1)
        return len(self.key) - 1

    def insert(self, sequence: list[int], sizes: list[int]) -> int:
        """The node of a sequence."""
        key, low, high, down, node = self.key, self.low, self.high, self.down, 0
        for number, size in zip(sequence, sizes):
            at, before, side = down[node], node, down
            while at >= 0 and key[at] != number:
                before, side = at, low if number < key[at] else high
                at = side[at]
            if at < 0:
                at = side[before] = self._new(number, node, size)
            node = at
        return node

    def order(self) -> list[int]:
        """All nodes but the root, each behind the one above it."""
        found, open_nodes = [], [self.down[0]]
        while open_nodes:
            at = open_nodes.pop()
            if at >= 0:
                found.append(at)
                open_nodes += (self.low[at], self.high[at], self.down[at])
        return found


def medians_first(count: int) -> Iterator[int]:
    """The places of a sorted list: the middle one, then the middles of both halves, and so on."""
    spans = [(0, count)]
    for first, last in spans:
        if first < last:
            middle = (first + last) // 2
            yield middle
            spans += [(first, middle), (middle + 1, last)]


def prefix_keys(path: bytes) -> list[bytes]:
    """A digest of every beginning of a path, the empty one first."""
    sha = hashlib.sha256()
    keys = [sha.digest()[:DIGEST]]
    for at in range(0, len(path), DIGEST):
        sha.update(path[at : at + DIGEST])
        keys.append(sha.copy().digest()[:DIGEST])
    return keys


def shard_rows(shard: int, paths: list[bytes], sizes: list[list[int]], members: list[list[int]]) -> dict[str, list]:
    """Nodes of a shard. ``paths`` are sorted and distinct, ``members`` of each ascend."""
    lengths = [len(path) // DIGEST for path in paths]
    codes = np.unique(np.frombuffer(b"".join(paths), f"S{DIGEST}"), return_inverse=True)[1].tolist()
    starts = np.concatenate([[0], np.cumsum(lengths)]).tolist()
    tree, ends = TernaryTree(), {}
    for i in medians_first(len(paths)):
        ends[tree.insert(codes[starts[i] : starts[i + 1]], sizes[i])] = members[i]

    total = len(tree.key)
    n, least, children, leaves, saved = [0] * total, [None] * total, [0] * total, [0] * total, [0] * total
    order = tree.order()
    for at in [*reversed(order), 0]:
        own = ends.get(at)
        if own:
            n[at] += len(own)
            least[at] = own[0] if least[at] is None else min(least[at], own[0])
        leaves[at] += not children[at]
        saved[at] += (n[at] - 1) * tree.size[at]
        up = tree.up[at]
        if up >= 0:
            n[up] += n[at]
            least[up] = least[at] if least[up] is None else min(least[up], least[at])
            children[up] += 1
            leaves[up] += leaves[at]
            saved[up] += saved[at]

    partial: dict[int, bytes] = {}
    for i in {0, len(paths) - 1}:
        at = tree.insert(codes[starts[i] : starts[i + 1]], sizes[i])
        for key in reversed(prefix_keys(paths[i])):
            partial[at] = key
            at = tree.up[at]

    rows: dict[str, list] = {name.split()[0]: [] for name in SCHEMA.split(", ")}
    for at in (0, *order):
        up, key = tree.up[at], partial.get(at)
        named = ",".join(map(str, ends.get(at, ())))
        rows["kind"].append(NODE if key is None else PARTIAL)
        rows["shard"].append(shard)
        rows["key"].append(key)
        rows["parent_key"].append(partial.get(up))
        rows["depth"].append(tree.depth[at])
        rows["conv_id"].append(least[at])
        rows["parent_conv_id"].append(least[up] if up >= 0 and up not in partial else None)
        for name, values in zip(COUNTS, (n, children, leaves, saved)):
            rows[name].append(values[at])
        rows["ends"].append(named if key is not None else hashlib.sha256(named.encode()).hexdigest() if named else NOBODY)
    nodes = len(rows["kind"])
    for name in rows:
        rows[name] += [None] * (nodes + 1 - len(rows[name]))
    rows["kind"][-1], rows["shard"][-1] = EDGE, shard
    rows["first"][-1], rows["last"][-1], rows["last_sizes"][-1] = paths[0], paths[-1], sizes[-1]
    return rows


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths, sizes, members = [], [], []
    for batch in batches:
        for path, size, conv_id in zip(*(batch.column(name).to_pylist() for name in ("path", "sizes", "conv_id"))):
            if paths and paths[-1] == path:
                members[-1].append(conv_id)
            else:
                paths.append(path)
                sizes.append(size)
                members.append([conv_id])
    if paths:
        rows = shard_rows(TaskContext.get().partitionId(), paths, sizes, members)
        table = pa.Table.from_pydict(rows, schema=_ARROW)
        yield from table.to_batches(max_chunksize=10_000)


_ARROW = pa.schema(
    [
        ("kind", pa.int32()), ("shard", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()), ("depth", pa.int64()),
        ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
        ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()), ("first", pa.binary()), ("last", pa.binary()),
        ("last_sizes", pa.list_(pa.int32())),
    ]
)


# Between shards


def shared_beginning(last: bytes, sizes: list[int], following: bytes) -> list[tuple[bytes, int, int, int, int]]:
    """What was counted twice of the nodes that a shard's last sequence shares with the next shard's first.

    Of each, ``key, depth`` and what is to be added: children, leaves and savings. A node in both shards saves its text once more; as a
    child it counts once; and where the last sequence ends at it, it looked like a leaf, which only the next shard can tell.
    """
    most = min(len(last), len(following)) // DIGEST
    depth = 0
    while depth < most and last[depth * DIGEST : (depth + 1) * DIGEST] == following[depth * DIGEST : (depth + 1) * DIGEST]:
        depth += 1
    ended = depth * DIGEST == len(last)
    rows, below = [], 0
    for at, key in reversed(list(enumerate(prefix_keys(last[: depth * DIGEST])))):
        below += sizes[at - 1] if at else 0
        rows.append((key, at, -1 if at < depth else 0, -1 if ended else 0, below))
    return rows


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            found = shared_beginning(row["last"], row["last_sizes"], row["following"])
            key, depth, children, leaves, saved = zip(*found)
            yield pa.RecordBatch.from_pydict(
                {"key": key, "depth": depth, "n_children": children, "n_leaves": leaves, "saved_tokens": saved}
            )


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's members, whose parts follow each other. No more than one part is held."""
    key, sha, some = None, None, False
    for batch in batches:
        done = []
        for own, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if own != key:
                if key is not None:
                    done.append((key, sha.hexdigest()))
                key, sha, some = own, hashlib.sha256(), False
            if ends:
                sha.update((("," if some else "") + ends).encode())
                some = True
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["key", "ends"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sha.hexdigest()])], names=["key", "ends"])


def prefix_nodes(paths: DataFrame) -> DataFrame:
    """All nodes of the tree of ``paths`` (``conv_id, path, sizes``), as ``rebuilt_paths`` gives them.

    Columns: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens`` and
    ``ends_sha256``, the digest of the ids of members that end there. Without conversations there is no node; conversations
    without turns are members of the root. A ``conv_id`` occurs once.

    Sequences are sorted together with their ``conv_id``, so equal ones fill as many shards as they need. Members' ids are
    digested as a stream, in the order of shards.
    """
    spark, table = paths.sparkSession, scratch_path(paths.sparkSession, "trie")
    # Counted, sampled for the ranges and dealt out: three uses of what took a shuffle to gather.
    paths.select("conv_id", "path", "sizes").write.parquet(f"{table}/paths")
    paths = spark.read.parquet(f"{table}/paths")
    turns = paths.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    order = ["path", "conv_id"]
    dealt = paths.repartitionByRange(max(1, -(-turns // SHARD_TURNS)), *order)
    dealt.sortWithinPartitions(*order).mapInArrow(words.frugal(_shard), SCHEMA).write.parquet(f"{table}/shards")
    found = spark.read.schema(SCHEMA).parquet(f"{table}/shards")

    edges = found.where(F.col("kind") == EDGE).select("shard", "first", "last", "last_sizes")
    next_first = F.lead("first").over(Window.orderBy("shard"))
    meeting = edges.select("last", "last_sizes", next_first.alias("following")).where(F.col("following").isNotNull())
    twice = meeting.mapInArrow(_corrections, "key binary, depth long, n_children long, n_leaves long, saved_tokens long")
    partial = found.where(F.col("kind") == PARTIAL)
    summed = (
        partial.unionByName(twice, allowMissingColumns=True)
        .groupBy("key", "depth")
        .agg(F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), *(F.sum(name).alias(name) for name in COUNTS))
    )
    ends = partial.select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard")
    summed.join(ends.mapInArrow(_ends, "key binary, ends string"), "key").write.parquet(f"{table}/partial")
    merged = spark.read.parquet(f"{table}/partial")

    columns = ["conv_id", "depth", "parent_conv_id", *COUNTS, F.col("ends").alias("ends_sha256")]
    above = measured(merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above")), FEW_NODES)
    nodes = found.where(F.col("kind") == NODE).select("parent_key", "parent_conv_id", "conv_id", "depth", *COUNTS, "ends")
    whole = nodes.unionByName(merged.drop("key").withColumn("parent_conv_id", F.lit(None).cast("long")))
    linked = whole.join(above, "parent_key", "left")
    return linked.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(*columns)
