"""A corpus pipeline of five stages, each one of the corpus operators with production parameters.

Each stage takes (spark, docs, sf_dir) and returns a table: all but the last return the columns of ``documents``. A stage
works on all that the one before kept. Stages are written as Parquet and read again in between.
"""

from __future__ import annotations

from contextlib import ExitStack

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.llm import bpe, mixing, pii, shingles, toxicity
from scribelake.llm.common import documents, durable, fresh, spilled
from scribelake.llm.queries import public_bpe


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Labels outside the held-out fold teach the model, on this stage's input."""
    return toxicity.drop_toxic(docs, documents(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by sharing 80 % or more of the five-word shingles."""
    return shingles.keep_one_similar(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private values in the text become pseudonyms; ``n_chars`` is the new text's."""
    out = pii.pseudonymise(docs, key=pii.session_key(spark), out=fresh(docs.columns, "pii_values")[0])
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, none or up to three times."""
    return mixing.repeat_by_mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, one row for each copy of a document in the mix."""
    return bpe.round_trip(docs, *public_bpe())


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("pii", pseudonymise), ("mixing", mix), ("bpe", tokenise)]

#: SQL can express neither the classifier nor the fingerprints; the tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last through Parquet in the shared folder. What they wrote there goes when
    the last one's rows, which have no texts, are written down."""
    docs = documents(spark, sf_dir)
    with ExitStack() as written:
        for name, stage in STAGES[:-1]:
            docs = written.enter_context(spilled(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        return durable(STAGES[-1][1](spark, docs, sf_dir))
