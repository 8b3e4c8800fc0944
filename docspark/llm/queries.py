"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from docspark.llm import bloom_lm, decontaminate, exact_dedup, factor_machine, near_dedup, packing, periodic_runs, pii, resampling, substring_dedup, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_warc": warc.op3_warc,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_lm_scoring": bloom_lm.op7_lm_scoring,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_pii": pii.op9_pii,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_quality": factor_machine.op11_quality,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_resampling": resampling.op13_resampling,
}

SQL = {
    "op4_near_dedup": near_dedup.OP4_SQL,
    "op5_decontamination": decontaminate.OP5_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op10_substring_dedup": substring_dedup.OP10_SQL,
}
