"""From documents to token ids: language ID, line dedup, near-dedup, decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written before the next one reads
it. All but the last return the columns of ``docs``. Rows with null ids pass where only their id could
decide; see the stages. An empty table goes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bpe import bpe_encode_decode
from quern.llm.decontaminate import contamination
from quern.llm.language_id import UNKNOWN, held_out, identify_language, learn_profiles
from quern.llm.line_dedup import line_dedup
from quern.llm.queries import documents, tokenizer_file
from quern.llm.near_copies import near_classes
from quern.llm.shared import written

#: Score under which a text is near no language's profile; ordinary texts score over twice that.
LEAST_SCORE = 0.15
#: Near copies share this part of their distinct shingles of five words, or more.
NEAR = {"words": 5, "least": 0.8}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or near no language, go. A missing ``lang`` takes the predicted language; no other one changes."""
    profiles = learn_profiles(docs.where(~held_out(F.col("doc_id"))))
    out = identify_language(docs, profiles, names=("__lang", "__score"))
    kept = out.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= LEAST_SCORE)) if profiles.languages else out
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines are cut out of the texts, and n_chars follows; no document goes."""
    out = line_dedup(docs, names=("__lines", "__removed"))
    return out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate class stays, once; rows with null ids stay."""
    kept = near_classes(docs, **NEAR).groupBy("class").agg(F.min(F.struct("doc_id", "h")).alias("s")).select(F.col("s.doc_id").alias("__d"), F.col("s.h").alias("__h"))
    keyed = docs.where("doc_id is not null").withColumn("__t", F.xxhash64("text"))
    named = keyed.join(kept, (F.col("doc_id") == F.col("__d")) & (F.col("__t") == F.col("__h")), "left_semi").dropDuplicates(["doc_id", "__t"])
    return named.select(docs.columns).unionAll(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of 10 words of a benchmark item go."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias("__d"), F.col("h").alias("__h")).distinct()
    return docs.join(hit, docs.doc_id.eqNullSafe(F.col("__d")) & (F.xxhash64(docs.text) == F.col("__h")), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, with a digest of the decoded text."""
    out = bpe_encode_decode(docs, tokenizer_file(), keep=("doc_id", "lang", "source"))
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("bpe", encode)]
#: SQL can express neither the profiles nor the fingerprints; the tests hold run() against the same stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
