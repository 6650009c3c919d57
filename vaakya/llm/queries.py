"""The queries of this subpackage, by name, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from . import decontaminate, embeddings, html_extract, lattice_lm, minhash, packing, quality, suffix_dedup, token_files, warc

_OPS: list[Callable] = [
    suffix_dedup.op1_suffix_array_dedup,
    html_extract.op2_html_extraction,
    embeddings.op3_embedding_near_dedup,
    packing.op4_best_fit_packing,
    decontaminate.op5_benchmark_decontamination,
    token_files.op6_token_files,
    minhash.op7_minhash_near_dedup,
    lattice_lm.op8_lm_scoring,
    quality.op9_quality_classifier,
    warc.op10_warc_fixity,
]


def queries() -> dict[str, Callable]:
    """opN_<name> -> f(spark, sf_dir)."""
    return {f.__name__: f for f in _OPS}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL with the same rows."""
    return {"op5_benchmark_decontamination": decontaminate.OP5_SQL}
