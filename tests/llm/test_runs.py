"""op8's runs: sorted, merged over batches and rounds, against plain grouping."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sensorium.llm import exact_dedup


def entries(spark, rows):
    return spark.createDataFrame([(r, bytearray(d), n, i is None, i, u, c) for r, d, n, i, u, c in rows], "run int, digest binary, n_bytes int, none boolean, id long, uid long, n long")


def test_runs_are_merged_over_batches(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(3), bytes([rnd.randrange(4)]) * 32, rnd.randrange(2), rnd.choice([None, rnd.randrange(50)]), u, rnd.randrange(1, 4)) for u in range(400)]
    want = defaultdict(list)
    for r, d, n, i, u, c in rows:
        want[r, d, n].append(((i is None, i or 0, u), c))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = exact_dedup.keep_least(entries(spark, rows).coalesce(1).sortWithinPartitions(*exact_dedup.ORDER)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.run, bytes(r.digest), r.n_bytes) for r in got] == sorted(want)
    for r in got:
        some = want[r.run, bytes(r.digest), r.n_bytes]
        assert ((r.none, r.id or 0, r.uid), r.n) == (min(k for k, _ in some), sum(c for _, c in some))
    assert exact_dedup.keep_least(entries(spark, [])).count() == 0


@pytest.mark.parametrize("fan_in", [2, 3, 16])
def test_rounds(spark, fan_in):
    rnd = random.Random(fan_in)
    docs = spark.createDataFrame([(k if k % 9 else None, "hot" if k % 3 == 0 else f"text {rnd.randrange(60)}") for k in range(600)], "doc_id long, text string").repartition(11)
    rows = exact_dedup.digests(docs, "doc_id", "text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        root = exact_dedup.merged_runs(rows, fan_in)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = rows.groupBy("digest", "n_bytes").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), "uid")).alias("first"), F.count("*").alias("n"))
    key = lambda r: (bytes(r.digest), r.n_bytes, tuple(r["first"]), r.n)
    assert sorted(map(key, root.collect())) == sorted(map(key, want.select(*root.columns).collect()))
    with pytest.raises(ValueError):
        exact_dedup.merged_runs(rows, 1)
