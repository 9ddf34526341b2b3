import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from grainflow.llm import queries
from grainflow.llm.exact_dedup import exact_dedup
from tests.llm.helpers import SF, docs_frame, spark_rows, sql_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for n, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        done = False
        for i in ids:
            out.append((i, len(ids), keep, i == keep and not done, hashlib.sha256(n.encode()).hexdigest()))
            done = done or i == keep
    return sorted(out, key=repr)


ROWS = [
    (1, "Abc " * 9), (2, "abc " * 9), (3, "ABC " * 9 + "x"), (4, ""), (5, None), (6, "É"), (7, "é"), (8, "z" * 500), (9, "Z" * 500),
    (10, "z" * 499 + "y"), (10, "z" * 499 + "y"), (None, "lost"), (None, "alone"), (11, "lost"), (12, "z" * 501), (13, "zzzz"), (14, "zz" * 16),
]


def test_edges(spark):
    for hashed in (F.xxhash64, lambda *c: F.pmod(F.xxhash64(*c), F.lit(3))):
        got = exact_dedup(docs_frame(spark, ROWS).withColumn("bucket", F.lit(1)).withColumn("rank", F.lit("x")), block_bytes=16, hashed=hashed)
        assert spark_rows(got)[1] == brute(ROWS)


def test_empty(spark):
    assert exact_dedup(docs_frame(spark, [])).count() == 0


def test_sql(spark):
    assert spark_rows(queries.op5_exact_dedup(spark, SF)) == sql_rows(queries.ORACLE_SQL["op5_exact_dedup"])
