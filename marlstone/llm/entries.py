"""The corpus operators as queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clusters, decontaminate, language_id, licenses, lm, merkle, near_dup, oracle, packing, pii, spotsigs, substrings, url_filter, warc
from .common import table
from .packing import public_vocabulary


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's place is source/lang/doc_id."""
    docs = table(spark, sf_dir, "documents")
    return licenses.scan_licenses(docs.withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), public_vocabulary("piece_bpe_32k.model"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_documents(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages")).drop("target_uri", "intact")


def op13_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_near_dup": op2_near_dup,
    "op3_fingerprint": op3_fingerprint,
    "op4_license_scan": op4_license_scan,
    "op5_language_id": op5_language_id,
    "op6_pii": op6_pii,
    "op7_url_filter": op7_url_filter,
    "op8_decontaminate": op8_decontaminate,
    "op9_pack": op9_pack,
    "op10_substrings": op10_substrings,
    "op11_merkle": op11_merkle,
    "op12_warc": op12_warc,
    "op13_cluster": op13_cluster,
}
ORACLE_SQL: dict[str, str] = {"op2_near_dup": oracle.NEAR_DUP, "op11_merkle": oracle.MERKLE, "op12_warc": oracle.WARC, "op13_cluster": oracle.CLUSTERS}
