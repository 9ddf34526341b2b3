"""Manifests against SQL and against a tree built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from grainflow.llm.merkle import manifest
from grainflow.llm.oracles import MANIFEST
from grainflow.llm.queries import op12_merkle_manifest
from tests.llm.helpers import SF, docs_frame, spark_rows, sql_rows


def test_against_sql(spark):
    assert spark_rows(op12_merkle_manifest(spark, SF)) == sql_rows(MANIFEST)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fan):
    """The levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[k : k + fan])) for k in range(0, len(last), fan)])
    return levels


def siblings(levels, at, fan):
    out = []
    for level in levels[:-1]:
        lo = at // fan * fan
        out.append(("".join(level[lo:at]), "".join(level[at + 1 : lo + fan])))
        at //= fan
    return out


def plain(rows, fan):
    groups = {}
    for row in rows:
        groups.setdefault("" if row[2] is None else "=" + row[2], []).append(row)
    names = sorted(groups, key=lambda g: g.encode())
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = climb([leaf(r) for r in groups[g]], fan)
    top = climb([trees[g][-1][0] for g in names], fan)
    out = []
    for k, g in enumerate(names):
        for at, row in enumerate(groups[g]):
            steps = siblings(trees[g], at, fan) + siblings(top, k, fan)
            tampered = row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = leaf((*row[:3], row[3] + 1, row[4])) if tampered else leaf(row)
            for before, after in steps:
                node = digest(before + node + after)
            out.append((row[0], node, leaf(row), digest("".join(b + a for b, a in steps)), top[-1][0], trees[g][-1][0], node == top[-1][0]))
    return sorted(out, key=repr)


def documents(n, langs):
    rows = [(k, f"src{k % 3}" if k % 5 else None, langs[k * k % len(langs)], None if k % 11 == 0 else k, None if k % 13 == 0 else f"texte é {k}") for k in range(n)]
    return rows + [(None, None, langs[0], None, None), (3, "a", langs[0], 1, "again"), (3, "a", langs[0], 1, "again")]


@pytest.mark.parametrize("n,langs,fan,depth", [(70, ["en", None, "", "zz", "é"], 2, 2), (40, ["en"], 2, 10), (61, ["a", "b"], 3, 1), (64 - 3, ["x"], 2, 3), (0, ["only", "one"], 2, 4)])
def test_against_plain_tree(spark, n, langs, fan, depth):
    """Groups of one leaf and of full and partly filled blocks; nulls in all columns and repeated rows."""
    rows = documents(n, langs)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    docs = docs.withColumn("node", F.lit(1)).withColumn("path", F.lit("p")).withColumn("pos", F.lit(0))
    seven = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    assert spark_rows(manifest(docs, tampered=seven, changed={"n_chars": F.col("n_chars") + 1}, fan=fan, depth=depth))[1] == plain(rows, fan)


def test_edges(spark):
    """An empty table; one row whose long text is its own root; without tampering all rows verify."""
    assert manifest(docs_frame(spark, [])).collect() == []
    row = manifest(docs_frame(spark, [(1, "long " * 300_000)])).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == digest("") and row.verified
    assert all(r.verified for r in manifest(docs_frame(spark, [(k, "t") for k in range(9)]), depth=2).collect())
