"""The corpus pipeline: STAGES in order, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared
folder and reads it again. The last stage returns, for each document kept, what op1 returns.

Cases: null and empty texts are scored like any others, are copies of each other (exact dedup keeps one of all), have
no words that a benchmark could hit, and encode to the end id. Null ids come after all others, so that of copies a row
with an id stays. Of rows that are equal in id and text one stays. Further columns are carried, whatever their names,
up to the last stage. Empty tables give empty results. Texts are whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sensorium.llm import decontaminate, exact_dedup, pieces, queries, simhash, toxicity
from sensorium.llm.common import stash, table
from sensorium.session import recorded, unstash


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, ~queries.held_out(labels["doc_id"]))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.digests(docs, queries.piece_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]
#: Learned scores, fingerprints by XXH64 and merge-type encoding aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; when one is written, its input and the tables it made on the way are deleted."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with recorded() as made:
            docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        unstash(*before, *made[:-1])
        before = [docs]
    return docs
