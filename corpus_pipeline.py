"""A training-data pipeline over ``documents``, of the corpus operators.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs,
sf_dir)`` and returns what it keeps, with the columns of ``documents`` (further
columns end here).  Only the last returns other rows, the packed pieces.

1. toxicity: documents predicted toxic go.
2. near_duplicates: of each component of near copies the document with the
   smallest id stays; repeated rows of one id are one document; rows without an
   id stay.
3. substrings: words of windows that begin in a document with a smaller id go
   (the words left are joined by one blank, ``n_chars`` is counted again); a
   document of which nothing is left goes; texts without such windows stay as
   they are.
4. mixing: a document stays once for each pass over its source in which the mix
   takes words of it, at most twice; one that the schedule reaches in part stays
   whole.
5. packing: pieces of token sequences.

Null and empty texts pass the first three stages; they hold no words, so the mix
takes none of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajframe.llm import mixing, near_minhash, packing, substring, toxicity
from trajframe.llm.common import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("_score < 0.5").select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    kept = near_minhash.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))


def without_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    changed = (substring.substring_dedup(docs).where("n_removed > 0").dropDuplicates(["doc_id"])
               .select("doc_id", F.col("kept_text").alias("_left"), (F.col("n_removed") == F.col("n_words")).alias("_gone")))
    return (docs.join(changed, "doc_id", "left").where("_gone is null or not _gone")
            .withColumn("n_chars", F.when(F.col("_left").isNull(), F.col("n_chars")).otherwise(F.length("_left")).cast("long"))
            .withColumn("text", F.coalesce("_left", "text")).select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows of one id and text are interchangeable; a null id is a name like any other
    docs = docs.select(*COLUMNS).withColumn("_mark", F.xxhash64("text"))
    taken = (mixing.mix(docs, keep=("_mark",)).where("taken > 0").groupBy(F.col("doc_id").alias("_id"), F.col("_mark").alias("_of"))
             .agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size")))
    passes = F.explode(F.sequence(F.lit(1), F.ceil(F.col("_taken") / F.col("_size"))))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_of"))
    return docs.join(taken, same).withColumn("_pass", passes).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, with_ids=False).drop("ids")


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", one_of_near_copies),
    ("substrings", without_repeated_spans),
    ("mixing", mixed),
    ("packing", packed),
]

#: The first and last stages have no SQL form; the tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
