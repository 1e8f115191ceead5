"""A training corpus from documents: clean, deduplicate, redact, mix, tokenise.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns a
DataFrame; all but the last return the columns that docs has, whatever their
types. Between stages, run() writes Parquet into the shared folder and reads it
again. Null, empty, very long and repeated texts are treated as the operators'
docstrings say; no stage but these takes rows out, the first two only for what
they find in the text:

- a toxic text goes, unless no label tells toxic texts from others, when all stay;
- of rows whose texts are near duplicates one stays, the one with the least id
  (rows without one last), then the least text. An id that has two different texts keeps both;
- mixing takes a row as often as its source's target asks, which may be not at all (see mixing.mix()).

Columns of docs may have any names that the operators use themselves; names that begin with
"_row" or "_copies" are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimspark.llm import bpe, minhash, mixing, secrets_crf, toxicity
from palimspark.llm.common import BATCH_ROWS, cut
from palimspark.llm.queries import tokenizer_path


def small_batches(spark: SparkSession) -> None:
    """The pipeline's session, for good: Arrow batches of at most BATCH_ROWS rows, as whole texts are in memory on both sides of a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The scorer learns from labels of rows that aren't held out; where these don't tell, all stay."""
    small_batches(spark)
    scorer = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, scorer)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate rows, one stays: that with the least id, nulls last, then the least text."""
    small_batches(spark)
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1 or doc_id is null")
    if again.isEmpty():
        gone = minhash.near_duplicates(docs).where("not kept").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    # rows get ids of their own, in the order of theirs
    first = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_last(), F.monotonically_increasing_id()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.repartitionByRange(parts, *first).sortWithinPartitions(*first[:2])
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    gone = minhash.near_duplicates(rows, id_col="_row").where("not kept").select(F.col("doc_id").alias("_row"))
    return rows.join(gone, "_row", "left_anti").select(docs.columns)


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's place in the text says [SECRET]; n_chars is that of the new text."""
    small_batches(spark)
    out = secrets_crf.redact(docs)
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars"))).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    small_batches(spark)
    whole = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("row"))
    taken = mixing.mix(whole, carry=("row",)).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copies")).select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text, ids."""
    small_batches(spark)
    return bpe.encode(docs, tokenizer_path()).drop("decoded")


STAGES = [
    ("toxicity", toxic_out),
    ("near_dedup", near_duplicates_out),
    ("secrets", secrets_out),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: Scorers and a random field aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
