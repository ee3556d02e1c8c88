"""The Merkle manifest against a plain tree in Python."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidewire.llm import manifest

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row: tuple) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(hashes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and for each leaf what stands left and right of it on every level."""
    ways, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for i, p in enumerate(at):
            low = p - p % 16
            ways[i].append(("".join(level[low:p]), "".join(level[p + 1 : low + 16])))
        level = [sha("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
        at = [p // 16 for p in at]
    return level[0], ways


def expected(trees: dict[str, list[tuple[int, str, str | None]]]) -> dict[tuple, tuple]:
    names = sorted(trees)
    inner = {t: climb([leaf for _, leaf, _ in trees[t]]) for t in names}
    root, above = climb([inner[t][0] for t in names])
    out = []
    for t, over in zip(names, above, strict=True):
        for (doc, leaf, found), way in zip(trees[t], inner[t][1], strict=True):
            value = found or leaf
            for left, right in way + over:
                value = sha(left + value + right)
            out.append((doc, leaf, inner[t][0], root, sha("".join(left + right for left, right in way + over)), value, value == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{"1a": 1}, {"1a": 16, "1b": 17, "-": 1}, {"1hot": 70_001, "1b": 4096, "1c": 4097, "1d": 256} | {f"1s{i:03}": 1 + i % 3 for i in range(300)}])
def test_trees_of_many_sizes(spark, sizes):
    trees = {t: [(i, sha(f"{t}{i}"), sha(f"x{i}") if i % 7 == 3 else None) for i in range(n)] for t, n in sizes.items()}
    rows = [(t, *r) for t, members in trees.items() for r in members]
    df = spark.createDataFrame(rows, "tree string, doc_id bigint, leaf string, found string").orderBy(F.xxhash64("leaf")).repartition(7)
    got = manifest.checked(manifest.manifest(df)).collect()
    assert sorted(map(tuple, got), key=repr) == expected(trees)


@pytest.mark.parametrize("cuts", [[0, 5, 40, 41, 300, 1000], [0, 1000], list(range(0, 1001, 10))])
def test_partition_bounds_change_nothing(cuts):
    """Completed nodes and merged edges together are the tree, wherever a range begins."""
    leaves = [sha(str(i)) for i in range(1000)]
    nodes, edges = {}, {}
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        m = manifest.Mountains(1000)
        for i in range(low, high):
            m.push(i, leaves[i])
        m.close()
        nodes |= {x[:2]: x[2] for x in m.nodes}
        edges |= {x[:2]: x[2] for x in m.edges}
    for level in range(3):
        parents = {i // 16 for k, i in edges if k == level}
        for p in parents:
            run = [edges[level, i] for i in range(16 * p, 16 * p + 16) if (level, i) in edges]
            nodes[level + 1, p] = edges[level + 1, p] = sha("".join(run))
    assert nodes[3, 0] == climb(leaves)[0]
    assert len(nodes) == 63 + 4 + 1


def test_query_on_hard_rows(spark, tmp_path):
    texts = [None, "", "ABC def", "abc", "É" * 10, "long Words " * 50_000, "same", "same"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 3}", i, "clash") for i, t in enumerate(texts)]
    rows += [(7, "same", "en", "s1", 7, "clash")] * 2 + [(None, "No Id", None, "s1", None, "clash")] + [(100 + i, f"Text {i}", "de", "s2", None, "x") for i in range(40)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string").write.parquet(f"{tmp_path}/documents.parquet")
    trees: dict = {}
    for doc, text, lang, source, n, _ in rows:
        told = (doc, source, lang, n, text)
        bad = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0
        found = leaf_of((*told[:4], text.translate(SMALL) if text is not None else None)) if bad else None
        trees.setdefault("-" if source is None else "1" + source, []).append((doc, leaf_of(told), found))
    for members in trees.values():
        members.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    got = sorted(map(tuple, manifest.query(spark, str(tmp_path)).collect()), key=repr)
    assert got == expected(trees)
    assert any(not r[6] for r in got) and any(r[6] for r in got)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    assert manifest.query(spark, str(tmp_path)).collect() == []
