"""Registered queries of the operators and their DuckDB equivalents, where SQL has one."""

from __future__ import annotations

import corpus_pipeline
from tallymark.llm import decontaminate, language_id, mixing, neighbours, pii, secret_scan, simhash, suffix_dedup, token_count, url_filter


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_pii": pii.op2_pii,
        "op3_nearest_neighbours": neighbours.op3_nearest_neighbours,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_language_id": language_id.op5_language_id,
        "op6_token_count": token_count.op6_token_count,
        "op7_secret_scan": secret_scan.op7_secret_scan,
        "op8_simhash_dedup": simhash.op8_simhash_dedup,
        "op9_source_mix": mixing.op9_source_mix,
        "op10_url_filter": url_filter.op10_url_filter,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {"op9_source_mix": mixing.OP9_SQL, "op10_url_filter": url_filter.OP10_SQL}
