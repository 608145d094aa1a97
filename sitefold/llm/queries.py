"""Queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .extract import extract_text
from .forest import nearest_of_fiftieths
from .minhash import near_duplicates
from .mixing import SQL as MIX_SQL
from .mixing import mix_digests
from .packing import pack_documents
from .quality import quality_verdicts
from .repeats import repeat_digests
from .runs import run_digests
from .secrets import secret_digests
from .toxicity import toxicity_scores
from .vectors import link_vectors
from .warc import archive_round_trip
from .whitening import whitened_vectors


def _on(table: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _with_labels(operator) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_repeats": _on("documents", repeat_digests),
        "op2_extract": _on("pages", extract_text),
        "op3_vectors": _on("embeddings", link_vectors),
        "op4_mix": _on("documents", mix_digests),
        "op5_toxicity": _with_labels(toxicity_scores),
        "op6_warc": _on("pages", archive_round_trip),
        "op7_minhash": _on("documents", near_duplicates),
        "op8_pack": _on("documents", lambda docs: pack_documents(docs, ids=False)),
        "op9_secrets": _on("documents", secret_digests),
        "op10_quality": _with_labels(quality_verdicts),
        "op11_forest": _on("embeddings", nearest_of_fiftieths),
        "op12_runs": _on("documents", run_digests),
        "op13_whitening": _on("embeddings", whitened_vectors),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mix": MIX_SQL}
