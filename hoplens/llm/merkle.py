"""A manifest of a table as Merkle trees, and proofs that climb it.

Every row is a leaf. The leaves of one language are a tree, in the order of ``doc_id``; the roots of these trees are the leaves of the
top tree. Digests of all nodes are SHA-256 over the lowercase hex text of what they cover: two nodes, or one at the end of a level.

Trees are built ``STRIDE`` levels at a time in blocks of positions. What is stored are links: a node, its parent ``STRIDE`` levels
higher (lower down only at a tree's root), and the siblings on the way, null where a run has one node. A recursive query takes every leaf from link
to link, appends the siblings to its proof and folds its digest with them.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from hoplens.llm.common import measured
from hoplens.operators.keys import join_keys
from hoplens.session import scratch_path

#: Levels between a stored node and its parent.
STRIDE = 8
#: Leaves that are numbered by one task, about.
PART_ROWS = 200_000
#: A node that more leaves climb through than 2**STRIDE is stored in copies, at most so many, and they deal themselves out to these.
MOST_COPIES = 4096
#: Up to so many rows of a small side are sent to every task; beyond, it is joined by a shuffle.
FEW_ROWS = 10_000
#: The tree of the languages' roots.
TOP = -1


class Manifest(NamedTuple):
    leaves: DataFrame  # row, doc_id, leaf, claimed, tree, next_tree, next_level, next_pos, next_copies, pos, path
    links: DataFrame  # tree, level, pos, copy, path, next_tree, next_level, next_pos, next_copies
    roots: DataFrame  # tree, lang, n, subroot
    root: str | None  # hex; None for an empty table
    height: int  # of the top tree


# Digests


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(n_chars: Column | None = None) -> Column:
    """The digest of a row of documents, as 32 bytes."""
    n_chars = F.col("n_chars") if n_chars is None else n_chars
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]
    return F.unhex(F.sha2(F.concat(*map(_field, fields)).cast("binary"), 256))


def hit_by_tampering(every: int = 7) -> Column:
    """Rows that the query tampers with; a row without a ``doc_id`` is none."""
    digits = F.col("doc_id").cast("string").cast("binary")
    return F.coalesce(F.crc32(digits) % every == 0, F.lit(False))


def leaf_rows(docs: DataFrame, tampered: Column) -> DataFrame:
    """``lang, doc_id, leaf`` and the digest ``claimed`` by the row as it is now: with one more in ``n_chars`` where ``tampered``."""
    more = leaf_digest(F.col("n_chars").cast("decimal(20,0)") + 1)
    rows = docs.select("doc_id", "source", "lang", "n_chars", "text")
    return rows.select("lang", "doc_id", leaf_digest().alias("leaf"), F.when(tampered, more).alias("claimed")).withColumn(
        "claimed", F.coalesce("claimed", "leaf")
    )


# Building


def _stored(frame: DataFrame, path: str) -> DataFrame:
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _height(n: Column) -> Column:
    """Halvings, rounded up, until one node is left."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))


def _numbered(leaves: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Leaves with their tree and position, and the trees.

    Rows are cut by range of the whole order, with a row number last; a row's position is its place in its range and the number of
    its tree's rows in earlier ranges.
    """
    parts = max(1, -(-leaves.count() // PART_ROWS))
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf", "row"]
    rows = leaves.withColumn("row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = dealt.select(
        "lang", "doc_id", "leaf", "claimed", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")
    )
    placed = _stored(placed, f"{folder}/placed")

    of_lang, earlier = Window.partitionBy("lang"), Window.unboundedPreceding
    runs = placed.groupBy("lang", "part").agg(F.count("*").alias("own"), F.min("row").alias("first_row")).select(
        "*",
        F.sum("own").over(of_lang).alias("n"),
        (F.sum("own").over(of_lang.orderBy("part").rowsBetween(earlier, 0)) - F.col("own")).alias("start"),
        (F.col("part") == F.min("part").over(of_lang)).alias("begins"),
    )
    runs = _stored(runs, f"{folder}/runs")
    # Trees are numbered in the order of their languages: by range, then by the languages that begin in it.
    begun = runs.where("begins")
    in_part = F.row_number().over(Window.partitionBy("part").orderBy(F.col("lang").asc_nulls_first())) - 1
    per_part = begun.groupBy("part").agg(F.count("*").alias("trees"))
    before = per_part.select("part", (F.sum("trees").over(Window.orderBy("part").rowsBetween(earlier, 0)) - F.col("trees")).alias("before"))
    trees = begun.select("lang", "n", "part", in_part.alias("in_part")).join(before, "part")
    trees = trees.select("lang", "n", (F.col("before") + F.col("in_part")).alias("tree"), _height(F.col("n")).alias("height"))
    trees = _stored(trees, f"{folder}/trees")

    known = join_keys(runs.select("lang", "part", "first_row", "start"), measured(trees, FEW_ROWS), ["lang"])
    found = join_keys(placed, measured(known, FEW_ROWS), ["lang", "part"])
    pos = F.col("row") - F.col("first_row") + F.col("start")
    return found.select("row", "doc_id", "leaf", "claimed", "tree", "n", "height", pos.alias("pos")), trees


def _covering(below: Column) -> Column:
    """The digests over every two of the digests below; the last may cover one."""

    def cover(k: Column) -> Column:
        pair = F.concat(F.get(below, 2 * k), F.coalesce(F.get(below, 2 * k + 1), F.lit("")))
        return F.sha2(pair.cast("binary"), 256)

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(below) - 1) / 2).cast("int")), cover)


def _climbed(nodes: DataFrame, level: int, stride: int, kept: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes ``tree, n, height, pos, digest`` of one level with the ``path`` to the next stored level, and the nodes of that.

    A block of 2**stride positions is a row: its digests, then those of each level above it, which stay as they are once the tree's
    root is reached. ``kept`` columns stay with the nodes.
    """
    width = 1 << stride
    own = F.struct("pos", *kept, _hex(F.col("digest")).alias("hex"))
    blocks = nodes.groupBy("tree", "n", "height", F.shiftright("pos", stride).alias("block")).agg(F.sort_array(F.collect_list(own)).alias("own"))
    blocks = blocks.withColumn("steps", F.least(F.lit(stride), F.col("height") - level)).withColumn(
        "at0", F.transform("own", lambda node: node["hex"])
    )
    for i in range(stride):
        below = F.col(f"at{i}")
        blocks = blocks.withColumn(f"at{i + 1}", F.when(F.col("steps") > i, _covering(below)).otherwise(below))

    def link(node: Column) -> Column:
        place = (node["pos"] % width).cast("int")
        siblings = [F.unhex(F.get(F.col(f"at{i}"), F.shiftright(place, i).bitwiseXOR(F.lit(1)))) for i in range(stride)]
        return F.struct(
            node["pos"].alias("pos"),
            *(node[name].alias(name) for name in kept),
            F.unhex(node["hex"]).alias("digest"),
            F.slice(F.array(*siblings), F.lit(1), F.greatest(F.col("steps"), F.lit(0))).alias("path"),
        )

    linked = blocks.select("tree", "n", "height", F.inline(F.transform("own", link)))
    parents = blocks.select("tree", "n", "height", F.col("block").alias("pos"), F.unhex(F.get(F.col(f"at{stride}"), F.lit(0))).alias("digest"))
    return linked, parents


def _copies(climbing: Column, stride: int) -> Column:
    """Copies of a node that so many leaves climb through."""
    return F.greatest(F.lit(1), F.least(F.lit(MOST_COPIES), F.shiftright(climbing, stride))).cast("int")


def _next(level: int, stride: int, top: bool) -> list[Column]:
    """The key of a link's upper end, and its number of copies. The root of a language's tree is a leaf of the top tree."""
    up = F.least(F.col("height"), F.lit(level + stride))
    pos = F.shiftright("pos", stride)
    if top:
        return [F.lit(TOP).cast("long").alias("next_tree"), up.alias("next_level"), pos.alias("next_pos"), F.lit(1).alias("next_copies")]
    ends = F.col("height") <= level + stride
    climbing = F.least(F.col("n"), F.lit(1 << min(62, level + stride)).cast("long"))
    return [
        F.when(ends, F.lit(TOP)).otherwise(F.col("tree")).cast("long").alias("next_tree"),
        F.when(ends, F.lit(0)).otherwise(up).alias("next_level"),
        F.when(ends, F.col("tree")).otherwise(pos).alias("next_pos"),
        F.when(ends, _copies(F.col("n"), stride)).otherwise(_copies(climbing, stride)).alias("next_copies"),
    ]


def build(leaves: DataFrame, stride: int = STRIDE, folder: str | None = None) -> Manifest:
    """The trees of ``lang, doc_id, leaf, claimed``, stored under ``folder`` (by default in the shared one).

    Leaves of a language are in the order of ``doc_id``, nulls first, then of their digests; equal leaves are interchangeable. Null is
    a language like any other, before all. A tree of one leaf is that leaf. An empty table has no root.
    """
    folder = folder or scratch_path(leaves.sparkSession, "merkle")
    leaves = _stored(leaves, f"{folder}/rows")
    numbered, trees = _numbered(leaves, folder)
    height = trees.agg(F.max("height")).first()[0]
    if height is None:
        height = 0
    linked, parents = _climbed(numbered.withColumnRenamed("leaf", "digest"), 0, stride, ["row", "doc_id", "claimed"])
    columns = ["row", "doc_id", F.col("digest").alias("leaf"), "claimed", "tree", "pos", "path", *_next(0, stride, top=False)]
    _stored(parents, f"{folder}/nodes-{stride}")
    rows = _stored(linked.select(*columns), f"{folder}/leaves")

    spark = leaves.sparkSession
    level, done, links = stride, [], []
    while level < height:
        nodes = spark.read.parquet(f"{folder}/nodes-{level}")
        done.append(nodes.where(F.col("height") <= level))
        linked, parents = _climbed(nodes.where(F.col("height") > level), level, stride, [])
        copies = _copies(F.least(F.col("n"), F.lit(1 << min(62, level)).cast("long")), stride)
        links.append(linked.select("tree", F.lit(level).alias("level"), "pos", "path", copies.alias("copies"), *_next(level, stride, top=False)))
        _stored(parents, f"{folder}/nodes-{level + stride}")
        level += stride
    done.append(spark.read.parquet(f"{folder}/nodes-{level}"))
    subroots = done[0]
    for more in done[1:]:
        subroots = subroots.unionByName(more)
    subroots = _stored(subroots.select("tree", "n", "digest"), f"{folder}/subroots")

    counted = subroots.count()
    top_height = max(0, counted - 1).bit_length()
    top = subroots.select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(counted).cast("long").alias("n"), F.lit(top_height).alias("height"),
        F.col("tree").alias("pos"), "digest", F.col("n").alias("climbing"),
    )
    level, root = 0, None
    while level < top_height:
        linked, parents = _climbed(top, level, stride, ["climbing"])
        # Of the leaves below a node only the first level's numbers are known; above, a node has all copies.
        copies = _copies(F.col("climbing"), stride)
        up = [x if i < 3 else F.lit(MOST_COPIES).alias("next_copies") for i, x in enumerate(_next(level, stride, top=True))]
        links.append(linked.select("tree", F.lit(level).alias("level"), "pos", "path", copies.alias("copies"), *up))
        top = _stored(parents, f"{folder}/top-{level + stride}").withColumn("climbing", F.lit(MOST_COPIES << stride).cast("long"))
        level += stride
    last = top.select(_hex(F.col("digest"))).first()
    if last is not None:
        root = last[0]
    table = None
    for more in links:
        table = more if table is None else table.unionByName(more)
    if table is None:
        table = rows.limit(0).select(
            "tree", F.lit(0).alias("level"), "pos", "path", F.lit(1).alias("copies"), "next_tree", "next_level", "next_pos", "next_copies"
        )
    dealt = table.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    dealt = _stored(dealt, f"{folder}/links")
    roots = join_keys(trees.select("tree", "lang", "n"), measured(subroots.select("tree", _hex(F.col("digest")).alias("subroot")), FEW_ROWS), ["tree"])
    return Manifest(rows, dealt, roots, root, top_height)


# Proofs

#: Folds a digest with the siblings on a link; bits of the position tell the side.
FOLD = """
    aggregate(sequence(0, size({path}) - 1), lower(hex({digest})), (below, i) -> sha2(CAST(CASE
        WHEN {path}[i] IS NULL THEN below
        WHEN shiftright({pos}, i) & 1 = 0 THEN concat(below, lower(hex({path}[i])))
        ELSE concat(lower(hex({path}[i])), below) END AS BINARY), 256), top -> unhex(top))
"""
APPEND = "aggregate({path}, {proof}, (before, sibling) -> concat(before, coalesce(sibling, X'')))"


def _folded(path: str, digest: str, pos: str) -> str:
    return f"CASE WHEN size({path}) = 0 THEN {digest} ELSE {FOLD.format(path=path, digest=digest, pos=pos)} END"


#: A leaf's state is its place in the trees, the copy of that node that it reads, its proof so far and its folded digest.
CLIMB = f"""
    WITH RECURSIVE climb(row, doc_id, leaf, home, tree, level, pos, copy, proof, folded) AS (
        SELECT row, doc_id, leaf, tree, next_tree, next_level, next_pos, CAST(pmod(row, next_copies) AS INT),
            {APPEND.format(path='path', proof="X''")}, {_folded('path', 'claimed', 'pos')}
        FROM {{leaves}}
        UNION ALL
        SELECT c.row, c.doc_id, c.leaf, c.home, n.next_tree, n.next_level, n.next_pos, CAST(pmod(c.row, n.next_copies) AS INT),
            {APPEND.format(path='n.path', proof='c.proof')}, {_folded('n.path', 'c.folded', 'n.pos')}
        FROM climb c JOIN {{links}} n ON c.tree = n.tree AND c.level = n.level AND c.pos = n.pos AND c.copy = n.copy
    )
    SELECT row, doc_id, leaf, home, proof, folded FROM climb WHERE tree = {TOP} AND level = {{height}} AND pos = 0
"""


def prove(manifest: Manifest) -> DataFrame:
    """Every row's ``doc_id, leaf, subroot, root, proof_sha256, folded_root`` and whether its claimed digest is ``verified``.

    Digests are lowercase hex. ``proof_sha256`` digests the siblings from the leaf's level to the root, ``folded_root`` is what the row's
    claimed digest gives with them.

    Each step of the recursion shuffles the leaves by node; nodes that many leaves climb through lie in copies. Its rows are as many as
    leaves and steps, so Spark's limit on them is lifted while it runs.
    """
    spark = manifest.leaves.sparkSession
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        climbed = spark.sql(CLIMB, leaves=manifest.leaves, links=manifest.links, height=manifest.height)
        climbed = _stored(climbed, scratch_path(spark, "merkle-proofs"))
    finally:
        spark.conf.set(limit, before)
    roots = measured(manifest.roots.select(F.col("tree").alias("home"), "subroot"), FEW_ROWS)
    root = F.lit(manifest.root).cast("string")
    return climbed.join(roots, "home").select(
        "doc_id",
        _hex(F.col("leaf")).alias("leaf"),
        "subroot",
        root.alias("root"),
        F.sha2(_hex(F.col("proof")).cast("binary"), 256).alias("proof_sha256"),
        _hex(F.col("folded")).alias("folded_root"),
        (_hex(F.col("folded")) == root).alias("verified"),
    )
