"""Registered queries of the operators and the pipeline, and their check SQL."""

from __future__ import annotations

import corpus_pipeline
from outlay.llm import (
    decontaminate, exact_dedup, hard_negatives, language_model, line_dedup, periodic_runs, pieces, private_data, quality_rules, secrets, simhash,
    toxicity, url_filters,
)

QUERIES = {
    "op1_quality_rules": quality_rules.op1,
    "op2_simhash_near_dedup": simhash.op2,
    "op3_language_model": language_model.op3,
    "op4_private_data": private_data.op4,
    "op5_line_dedup": line_dedup.op5,
    "op6_toxicity": toxicity.op6,
    "op7_sentencepiece": pieces.op7,
    "op8_url_filters": url_filters.op8,
    "op9_secrets": secrets.op9,
    "op10_decontaminate": decontaminate.op10,
    "op11_periodic_runs": periodic_runs.op11,
    "op12_exact_dedup": exact_dedup.op12,
    "op13_hard_negatives": hard_negatives.op13,
    "pipeline": corpus_pipeline.run,
}
SQL = {"op1_quality_rules": quality_rules.OP1_SQL, "op8_url_filters": url_filters.OP8_SQL, "op12_exact_dedup": exact_dedup.OP12_SQL,
       "op13_hard_negatives": hard_negatives.OP13_SQL}
