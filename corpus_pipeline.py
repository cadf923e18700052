"""From raw documents to shards of training data: five stages over the operators in ``clipmart.llm``.

Each stage takes (spark, docs, sf_dir) and returns rows with the columns of ``documents`` (the last adds ``shard``).
Columns travel as they are, whatever their names. An empty table passes every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipmart.llm import decontaminate, jaccard_join, mixing, sharding, toxicity
from clipmart.llm.common import kept
from clipmart.llm.queries import as_transcripts, toxic_labels


def _carried(docs: DataFrame) -> DataFrame:
    """Whole rows as ``_doc`` beside their text as ``transcript``: no operator column can clash with theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text").alias("transcript"))


def _row_key() -> list[Column]:
    """Id and text of a row as keys that are never null."""
    return [F.coalesce(F.col("_doc.doc_id").cast("string"), F.lit("")).alias("_id"), F.xxhash64(F.col("transcript").cast("string")).alias("_text")]


def _decided(found: DataFrame, *more: Column) -> DataFrame:
    """An operator's rows under the same keys."""
    return found.select(F.coalesce(F.col("video_id").cast("string"), F.lit("")).alias("_id"), F.col("text_hash").alias("_text"), *more)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the threshold; learned from the labels that are not held out."""
    model = toxicity.train_toxicity(as_transcripts(docs), toxic_labels(spark, sf_dir))
    scored = toxicity.with_toxicity(_carried(docs), model)
    return scored.filter(F.col("_score") < toxicity.THRESHOLD).select("_doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; documents without words all stay."""
    found = jaccard_join.near_duplicates(as_transcripts(docs))
    stay = _decided(found.filter("stays"), F.col("n_shingles")).groupBy("_id", "_text").agg(F.max("n_shingles").alias("_n"))
    own = _carried(docs).select("_doc", *_row_key()).join(stay, ["_id", "_text"])
    # Rows equal in id and text are one group as well.
    first = F.row_number().over(Window.partitionBy("_id", "_text").orderBy("_text"))
    return own.withColumn("_i", first).filter("_i = 1 or _n = 0").select("_doc.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which under 5 % of the words lie in windows of benchmark items."""
    found = decontaminate.with_contamination(_carried(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(~F.col("_found.contaminated")).select("_doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them, the last reading of a source to the nearest whole document.

    A document without words costs the mix nothing and stays once.
    """
    taken = mixing.mix_sources(as_transcripts(docs))
    times = F.when(F.col("n_words") == 0, 1).otherwise(F.round(F.col("taken_words") / F.col("n_words"))).cast("int")
    times = _decided(taken, times.alias("_times")).groupBy("_id", "_text").agg(F.sum("_times").alias("_times")).filter("_times > 0")
    own = _carried(docs).select("_doc", *_row_key()).join(times, ["_id", "_text"])
    first = F.row_number().over(Window.partitionBy("_id", "_text").orderBy("_text"))
    own = own.withColumn("_i", first).filter("_i = 1")
    return own.select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select("_doc.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ``shard``: nearly equal bytes, equal texts together."""
    dealt = sharding.with_shard(_carried(docs), name="_shard")
    return dealt.select(*[F.col(f"_doc.`{c}`") for c in docs.columns if c != "shard"], F.col("_shard").alias("shard"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]

#: A learned model decides the first stage, which SQL does not express; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared checkpoint folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
