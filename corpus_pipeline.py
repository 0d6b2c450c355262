"""The corpus pipeline: documents whose language can be told, one of each group of near copies,
without live secrets, mixed to target weights, as tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a DataFrame;
all but the last return the columns of documents, further ones too, whatever their names.

Defined cases: doc_ids may be null or repeat, so stages that join go by a fixed number of each row; a null or empty
text has no language and goes in the first stage, alone it links with nothing, holds no secret, has nothing to be mixed and no
tokens; texts of any length are read whole; of rows with equal doc_id and text one stays, since they are copies; ties
are settled as each operator says; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import bpe, jaccard, langid, mixing, secrets
from tidewire.llm.common import checked, numbered, removed, shipped, table, written

#: A document is rejected if no language has this share of its text.
LEAST_SHARE = 0.5
#: Up to this many rows of ids or spans are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000

#: The columns that a stage adds inside: a number for each row, and what was found of it.
ROW, FOUND = "_row_number", "_found"

#: No SQL: language ID learns a model and the tokens come from merges.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that holds half of them go; lang becomes the language found."""
    found = docs.withColumn(FOUND, langid.predicted(F.col("text"), spark, langid.train(docs)))
    kept = found.filter((F.col(FOUND)["lang_pred"] != "und") & (F.col(FOUND)["score"] >= LEAST_SHARE))
    return kept.withColumn("lang", F.col(FOUND)["lang_pred"]).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest doc_id stays (null comes last, then the first row)."""
    shipped(spark)
    rows = numbered(docs, ROW)
    joined = written(jaccard.join(rows.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(ROW), "component_id"), "joined")
    many = written(joined.groupBy("component_id").count().filter("count > 1").select("component_id"), "many")
    linked = written(joined.join(checked(many, BROADCAST_ROWS), "component_id").join(rows.select(ROW, "doc_id"), ROW), "linked")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", ROW)
    best = linked.groupBy("component_id").agg(F.min(rank)[ROW].alias(ROW)).select(ROW)
    gone = written(linked.select(ROW).join(best, ROW, "left_anti"), "gone")
    for done in (joined, many, linked):
        removed(done)
    return rows.join(checked(gone, BROADCAST_ROWS), ROW, "left_anti").select(*docs.columns)


def live_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that look live are replaced in the texts; widely copied examples stay."""
    rows = numbered(docs, ROW)
    spans = secrets.scan(rows.select(F.col(ROW).alias("doc_id"), "text", "source")).filter(F.exists("spans", lambda s: s["live"]))
    spans = written(spans.select(F.col("doc_id").alias(ROW), F.col("spans").alias(FOUND)), "spans")
    out = rows.join(checked(spans, BROADCAST_ROWS), ROW, "left")
    clean, some = F.col(FOUND).isNull(), secrets.redacted(F.col("text"), F.col(FOUND))
    out = out.withColumn("text", F.when(clean, F.col("text")).otherwise(some)).withColumn("n_chars", F.when(clean, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, not at all, in part, once or twice, dealt to shards and shuffled there."""
    rows = numbered(docs, ROW)
    mixed = mixing.mixed_texts(rows, mixing.mix(rows, keep=(ROW,)), ROW)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether the ids decode to the text again."""
    made = docs.select("doc_id", "lang", "source", bpe.round_trip(F.col("text"), spark, bpe.default_path(spark)).alias(FOUND))
    return made.select("doc_id", "lang", "source", F.size(F.col(FOUND)["ids"]).cast("long").alias("n_tokens"), F.col(FOUND)["ids"].alias("ids"), F.col(FOUND)["restored"].alias("restored"))


STAGES = [
    ("language id", language_id),
    ("n-gram jaccard join", near_copies),
    ("secret scans", live_secrets),
    ("mixing to target weights", target_weights),
    ("bpe encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
