"""Corpus pipeline: five stages from raw documents to tokens.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes it as
Parquet to the shared folder and reads it again as the next stage's docs. All
but the last stage return the columns of ``documents``.

1. toxicity: documents predicted toxic go; the rest stay as they are.
2. near-duplicates: of each component of the Jaccard join (five words, 0.8),
   the document with the least id stays, and every document without words.
3. substring dedup: repeated passages are cut; a text becomes its kept words
   joined by one space if any were cut and stays as it is otherwise; n_chars
   follows the text.
4. mixing: a document is repeated as often as the mix takes it (0 to 3 times).
5. tokens: doc_id, n_tokens and digests of ids and decoded text per row.

Rows with a null id pass each stage by the rules of its operator, and rows that
repeat an id with another text are told apart by it; extra
columns of the input are dropped; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from growthcast.llm import bpe, jaccard, mixing, substrings, toxicity
from growthcast.llm.common import table
from growthcast.llm.queries import token_digests
from growthcast.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _told_apart(docs: DataFrame) -> DataFrame:
    """Rows with a hash of their text, which tells rows of one id, or of none, apart."""
    return docs.select(*COLUMNS, F.xxhash64("text").alias("_row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = _told_apart(docs)
    # the texts themselves are not carried through the scoring
    scored = toxicity.classify(told, table(spark, sf_dir, "labels"), keep=["doc_id", "_row"])
    drop = scored.where("predicted = 1").select(F.col("doc_id").alias("_id"), F.col("_row").alias("_same")).distinct()
    return told.join(drop, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_same")), "left_anti").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    parts = jaccard.jaccard_components(_told_apart(docs), carry=["_row"])
    # rows that aren't the least of their component; rows of no id are never dropped
    drop = parts.where("doc_id IS NOT NULL AND component_id < doc_id").select("doc_id", "_row").distinct()
    return _told_apart(docs).join(drop, ["doc_id", "_row"], "left_anti").select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(docs, carry=["text", "lang", "source", "n_chars"])
    changed = F.col("n_removed") > 0
    return cut.select("doc_id", F.when(changed, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source",
                      F.when(changed, F.char_length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_told_apart(docs), carry=["_row"]).where("taken > 0").withColumn("_times", (F.col("taken") / F.col("size")).cast("long"))
    keys = [F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "_row"]
    # rows that are equal in all of this share their times; a remainder is taken from one of them
    times = (mixed.groupBy(*keys).agg(F.sum("_times").alias("_sum"), F.count("*").alias("_n"))
             .select("_id", "_source", F.col("_row").alias("_same"), F.floor(F.col("_sum") / F.col("_n")).alias("_each"), (F.col("_sum") % F.col("_n")).alias("_more")))
    kept = _told_apart(docs).where(mixing.word_count(F.col("text")) > 0).join(
        times, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & F.col("_row").eqNullSafe(F.col("_same")))
    more = kept.where("_more > 0").dropDuplicates(["doc_id", "source", "_row"])
    return _repeated(kept, F.col("_each")).union(_repeated(more, F.col("_more")))


def _repeated(docs: DataFrame, times: Column) -> DataFrame:
    """Each row so many times; in two steps, so that no list of numbers is long."""
    def upto(n: Column) -> Column:
        return F.explode(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)))

    lots = docs.select(*COLUMNS, times.alias("_t")).select(*COLUMNS, "_t", upto(F.ceil(F.col("_t") / 1000)).alias("_k"))
    return lots.select(*COLUMNS, upto(F.least(F.lit(1000).cast("long"), F.col("_t") - 1000 * (F.col("_k") - 1))).alias("_n")).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_digests(bpe.encode(docs))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_duplicates), ("substring_dedup", cut_repeats),
          ("source_mixing", mix_sources), ("bpe_round_trip", tokens)]

#: SQL has no nearest neighbours by a fitted model and no byte-pair merges; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
