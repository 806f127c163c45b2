from __future__ import annotations

import hashlib
import random
import zlib

from lettermill.llm import merkle, queries
from lettermill.llm.common import running_total
from tests.llm.helpers import DOCS, LONG, ODD, documents, rows_of


def plain_digest(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def plain_leaf(row: dict, more: int = 0) -> str:
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"]]
    if values[3] is not None:
        values[3] += more
    return plain_digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([plain_digest(*below[k : k + 2]) for k in range(0, len(below), 2)])
    return levels


def plain_path(levels: list[list[str]], place: int) -> list[tuple[int, str | None]]:
    return [
        (place >> k & 1, nodes[place >> k ^ 1] if (place >> k ^ 1) < len(nodes) else None)
        for k, nodes in enumerate(levels[:-1])
    ]


def plain_manifest(rows: list[dict]) -> list[tuple]:
    groups: dict = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        trees[lang] = plain_tree([plain_leaf(r) for r in groups[lang]])
    over = plain_tree([trees[lang][-1][0] for lang in langs])
    out = []
    for at, lang in enumerate(langs):
        for place, row in enumerate(groups[lang]):
            path = plain_path(trees[lang], place) + plain_path(over, at)
            chosen = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            node = plain_leaf(row, int(chosen))
            for left, sibling in path:
                node = plain_digest(*([node] if sibling is None else [sibling, node] if left else [node, sibling]))
            proof = plain_digest(*[s for _, s in path if s])
            root = over[-1][0]
            out.append((row["doc_id"], plain_leaf(row), trees[lang][-1][0], root, proof, node, node == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest_rows(docs, levels: int = merkle.LEVELS) -> list[tuple]:
    found = merkle.manifest(docs, levels=levels, other_leaf=merkle.tampered_leaf(docs))
    return rows_of(merkle.verify(found).select(*COLUMNS))


def test_query_equals_brute_force(spark, sf_dir):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = rows_of(queries.op11_merkle_manifest(spark, sf_dir))
    assert found == plain_manifest(rows) and {r[-1] for r in found} == {True, False}


def test_odd_rows_at_any_array_size(spark):
    """Nulls, negative and repeated ids, words that share a bit, many equal rows, a very long text."""
    draw = random.Random(3)
    ids = [None, 5, -1, -64, -65, 63, 64, 127, 2**62, -(2**62), 7]
    docs = documents(spark, [*ODD, *((draw.choice(ids), draw.choice("xy")) for _ in range(60))], "leaf")
    expected = plain_manifest([r.asDict() for r in docs.collect()])
    for levels in (1, 3, merkle.LEVELS):
        assert manifest_rows(docs, levels) == expected
    assert any(LONG == r["text"] for r in docs.collect())


def test_repeats_cut_into_runs(spark, monkeypatch):
    monkeypatch.setattr(merkle, "_REPEATS", 4)
    docs = spark.createDataFrame([(1, "same", "en", "s", 4)] * 23 + [(2, "other", "en", "s", 5), (0, "o", None, "s", 1)], DOCS)
    assert manifest_rows(docs) == plain_manifest([r.asDict() for r in docs.collect()])


def test_empty_and_single(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    lone = spark.createDataFrame([(9, "a", "en", None, 1)], DOCS)
    ((_, leaf, subroot, root, proof, folded, good),) = manifest_rows(lone)
    assert leaf == subroot == root and proof == plain_digest() and good == (folded == root)


def test_long_sums_are_not_lost_between_ranges(spark):
    rows = spark.range(1000).selectExpr("999 - id AS k", "id % 7 AS w")
    found = {r["k"]: r["before"] for r in running_total(rows, ["k"], "w", "before").collect()}
    total = 0
    for k in range(1000):
        assert found[k] == total
        total += (999 - k) % 7
