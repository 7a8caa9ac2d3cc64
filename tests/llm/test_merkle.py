"""Manifests and proofs against a plain version."""

import hashlib
import zlib

import pytest

from hoplens.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row
    values = [doc_id, source, lang, None if n_chars is None else n_chars + more, text]
    return digest(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in values))


def plain_levels(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        levels.append(nodes)
    return levels


def siblings(levels, pos):
    """Side and sibling by level; (side, None) where a run has one node."""
    for nodes in levels[:-1]:
        other = pos ^ 1
        yield pos & 1, nodes[other] if other < len(nodes) else None
        pos >>= 1


def plain_proofs(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(((row[0] is not None, row[0] or 0), plain_leaf(row), row))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {lang: plain_levels([leaf for _, leaf, _ in sorted(trees[lang], key=lambda x: x[:2])]) for lang in langs}
    top = plain_levels([levels[lang][-1][0] for lang in langs])
    found = []
    for place, lang in enumerate(langs):
        for pos, (_, leaf, row) in enumerate(sorted(trees[lang], key=lambda x: x[:2])):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            folded, proof = plain_leaf(row, 1) if hit else leaf, []
            for right, sibling in [*siblings(levels[lang], pos), *siblings(top, place)]:
                if sibling is None:
                    folded = digest(folded)
                else:
                    proof.append(sibling)
                    folded = digest(sibling, folded) if right else digest(folded, sibling)
            root = top[-1][0]
            found.append((row[0], leaf, levels[lang][-1][0], root, digest(*proof), folded, folded == root))
    return found


def check(spark, rows, stride=8, parts=4):
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(parts)
    clashing = "leaf claimed row part pos tree level copy path proof folded home n height digest".split()
    frame = frame.selectExpr("*", *(f"'x' AS `{name}`" for name in clashing))
    proofs = merkle.prove(merkle.build(merkle.leaf_rows(frame, merkle.hit_by_tampering()), stride))
    assert proofs.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(row) for row in proofs.collect()), key=str) == sorted(plain_proofs(rows), key=str)


def documents(sizes):
    return [
        (1000 * k + 3 * i, f"s{i % 3}", None if k == 0 else f"l{k}", 10 * i, f"text é {i}") for k, size in enumerate(sizes) for i in range(size)
    ]


@pytest.mark.parametrize("sizes", [[1], [2], [1, 1], [3, 1, 2], [0, 256], [257, 5], [1] * 9, [300, 1, 64]])
def test_proofs(spark, sizes):
    check(spark, documents(sizes))


@pytest.mark.parametrize("stride", [1, 2, 3])
def test_any_stride_gives_the_same(spark, stride):
    """With a stride of one every node is a row linked to its own parent."""
    check(spark, documents([37, 1, 8]), stride)


def test_nodes_with_many_leaves_lie_in_copies(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PART_ROWS", 20)
    monkeypatch.setattr(merkle, "FEW_ROWS", 0)
    monkeypatch.setattr(merkle, "MOST_COPIES", 4)
    rows = documents([150, 3])
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    manifest = merkle.build(merkle.leaf_rows(frame, merkle.hit_by_tampering()), 2)
    copies = manifest.links.groupBy("tree", "level", "pos").count().where("tree >= 0 AND level >= 4").select("count").distinct().collect()
    assert {row[0] for row in copies} == {4}
    check(spark, rows, stride=2)


def test_many_languages(spark):
    check(spark, [(i, "s", f"{chr(65 + i % 300)}", i, "x") for i in range(700)], stride=3)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, None), (None, None, None, None, None), (1, "", "", 0, ""), (1, "", "", 0, ""), (7, "s", "é", None, "x"),
        (2**63 - 1, "s", "z", 2**63 - 1, "x" * 100_000), (-5, "s", "\U0001f600", -1, "5:null"), (4, None, "￿", 3, "-"),
    ] + [(5, "same", "en", 1, "same")] * 50
    hit = next(i for i in range(100, 1000) if zlib.crc32(str(i).encode()) % 7 == 0)
    check(spark, rows + [(hit, "s", "en", 2**63 - 1, "at the end of its type"), (hit, "s", "en", None, "null stays")])


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    manifest = merkle.build(merkle.leaf_rows(frame, merkle.hit_by_tampering()))
    assert manifest.root is None and merkle.prove(manifest).collect() == []


def test_any_change_is_found(spark):
    """Proofs of another table's rows fail where rows differ, and only there."""
    frame = spark.createDataFrame(documents([40]), "doc_id long, source string, lang string, n_chars long, text string")
    leaves = merkle.leaf_rows(frame, merkle.F.col("doc_id") == 9)
    wrong = [row.doc_id for row in merkle.prove(merkle.build(leaves)).where("NOT verified").collect()]
    assert wrong == [9]


def test_the_limit_on_recursion_is_put_back(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    check(spark, documents([3]))
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
