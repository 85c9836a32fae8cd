"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm import best_fit, collocations, decontaminate, fingerprints, language, licenses, merkle, near_dups, oracle, packing, secrets, token_files, toxicity, warc
from lakewarden.llm.common import held_out, shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path, min_bytes=0)
    return warc.page_records(spark, path)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.findings(table(spark, sf_dir, "documents")))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs, ~held_out(F.col("doc_id"))))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Learned from the rows of ``docs`` whose label is not held out."""
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.predictions(docs, toxicity_model(spark, docs, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered=merkle.tampered_rows())


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_whole(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES |= {
    "op1_licenses": op1_licenses, "op2_token_files": op2_token_files, "op3_warc": op3_warc, "op4_decontamination": op4_decontamination, "op5_near_dups": op5_near_dups,
    "op6_fingerprints": op6_fingerprints,
    "op7_secrets": op7_secrets,
    "op8_language": op8_language, "op9_toxicity": op9_toxicity, "op10_packing": op10_packing,
    "op11_collocations": op11_collocations, "op12_merkle": op12_merkle,
    "op13_best_fit": op13_best_fit,
}
ORACLE |= {"op11_collocations": oracle.COLLOCATIONS, "op12_merkle": oracle.MERKLE}
