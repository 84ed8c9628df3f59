"""The registered queries of this subpackage: thin wrappers that apply an operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_output import read_token_files, write_to_scratch
from .bpe import bpe_encode_decode
from .decontaminate import contamination
from .digest import edited_digests, exact_classes
from .language_id import held_out, identify_language, learn_profiles
from .line_dedup import line_dedup
from .pii import KINDS, pseudonymise
from .secrets import joined_spans, secret_spans
from .shared import written
from .simhash import simhash_classes
from .toxicity import fit_toxicity, score_toxicity


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Key of the registered query; a real corpus takes one from its key store.
DEMO_KEY = "demonstration key"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal numbers, dates and addresses as pseudonyms."""
    out = pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), DEMO_KEY)
    return out.select("doc_id", *(F.coalesce(F.try_element_at("pii", F.lit(k)), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS), "text")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    out = bpe_encode_decode(documents(spark, sf_dir), tokenizer_file())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and its class of equal documents."""
    docs = documents(spark, sf_dir)
    prints = written(edited_digests(docs))
    return exact_classes(docs, prints).drop("tie")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document: shingles of 4 words, 4 differing bits."""
    out = simhash_classes(documents(spark, sf_dir), words=4, threshold=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong and linked secrets of every document."""
    out = secret_spans(documents(spark, sf_dir))
    strong = F.filter("spans", lambda s: s["kind"] <= 2)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined_spans(strong), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    docs = documents(spark, sf_dir)
    profiles = learn_profiles(docs.where(~held_out(F.col("doc_id"))))
    return identify_language(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), profiles).select("doc_id", "held_out", "lang_pred", "score")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of 10 benchmark words."""
    out = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.col("items").cast("array<string>"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of lines that stand earlier in the corpus."""
    return line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "text")


def op9_arrow_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all token ids as Arrow stream files and reads them back."""
    files = write_to_scratch(documents(spark, sf_dir), tokenizer_file(), end_id=2)
    return read_token_files(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, learned from the labelled ones."""
    docs = documents(spark, sf_dir)
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs.select("doc_id", "text"), model).select("doc_id", "severity", "grade", "toxic")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_pii": op1_pii, "op2_bpe": op2_bpe, "op3_digest": op3_digest, "op4_simhash": op4_simhash, "op5_secrets": op5_secrets, "op6_language_id": op6_language_id, "op7_decontaminate": op7_decontaminate, "op8_line_dedup": op8_line_dedup, "op9_arrow_output": op9_arrow_output, "op10_toxicity": op10_toxicity}


#: Windows of 10 words of both tables as strings, joined on equality.
OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (SELECT item_id, ws, least(len(ws), 10) AS n FROM b WHERE len(ws) > 0),
wi AS (SELECT DISTINCT item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS g FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM i)),
wd AS (SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM w, (SELECT DISTINCT n FROM i) WHERE len(ws) >= n)),
h AS (SELECT doc_id, item_id, k, wd.n FROM wd JOIN wi USING (n, g)),
p AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """The other operators need normal forms, hashes or models that SQL lacks; tests hold them against brute force."""
    return {"op7_decontaminate": OP7_SQL}
