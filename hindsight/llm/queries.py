"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from collections.abc import Sequence

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    collocations,
    fingerprints,
    lm_scoring,
    manifest,
    mixing,
    near_dedup,
    nearest,
    oracles,
    packing,
    page_text,
    pii,
    toxicity,
    url_filters,
    warc,
)
from .common import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2

RULES = [
    url_filters.Rule("allow", "com", "/"),
    url_filters.Rule("block", "example.com", "/en/"),
    url_filters.Rule("allow", "www.example.com", "/en/"),
    url_filters.Rule("block", "net", "/es/"),
    url_filters.Rule("block", "net", "/fr/"),
]


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


#: Target proportions of the packing query, by source in order; sources run out one after the other.
PROPORTIONS = (1, 2, 3)


def packed_pieces(documents: DataFrame, weights: Sequence[float] | None = None) -> DataFrame:
    pieces = packing.pack(documents, TOKENIZER, END_ID, weights)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids", "window", "source")


def op2_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(table(spark, sf_dir, "documents"), PROPORTIONS)


def op3_attention_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"), TOKENIZER)


def op4_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op5_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_flow_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def archived_pages(pages: DataFrame) -> DataFrame:
    return warc.read_archive(warc.write_archive(pages)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op7_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


def op8_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op10_url_template_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are those of the document with the page's number: bad if toxic or of low quality."""
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), labels, RULES).drop("purity")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def tampered_manifest(documents: DataFrame, levels: int = manifest.LEVELS) -> DataFrame:
    """The manifest, folded from rows of which every seventh has a wrong ``n_chars``."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    n_chars = F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = [n_chars if name == "n_chars" else F.col(name) for name in fields]
    return manifest.manifest(documents, "doc_id", "lang", fields, changed, levels)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tampered_manifest(table(spark, sf_dir, "documents"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_text(table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {
        query.__name__: query
        for query in (
            op1_minhash_near_dedup,
            op2_mixture_packing,
            op3_attention_lm_scoring,
            op4_weak_supervision_pii,
            op5_ordinal_toxicity,
            op6_flow_mixing,
            op7_seekable_warc,
            op8_hilbert_neighbours,
            op9_prefix_fingerprints,
            op10_url_template_filter,
            op11_phrase_collocations,
            op12_merkle_manifest,
            op13_html_extraction,
        )
    }


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that SQL can express; the others are tested against brute force."""
    return oracles.sql(RULES)
