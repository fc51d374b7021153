"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sensorloom.llm import collocations, hnsw, html, licenses, media, merkle, mixing, packing, quality, simhash, tokencount, tokenfiles, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_nearest_neighbours": hnsw.op2_nearest_neighbours,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_token_files": tokenfiles.op4_token_files,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_token_counts": tokencount.op6_token_counts,
    "op7_simhash_dedup": simhash.op7_simhash_dedup,
    "op8_media_columns": media.op8_media_columns,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_html_extraction": html.op10_html_extraction,
    "op11_collocations": collocations.op11_collocations,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
ORACLES: dict[str, str] = {"op5_mix_sources": mixing.SQL, "op11_collocations": collocations.SQL, "op13_merkle_manifest": merkle.SQL}
