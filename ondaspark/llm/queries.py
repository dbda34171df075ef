"""The subpackage's registered queries and, where SQL can express one, its DuckDB equivalent."""

from __future__ import annotations

from . import byte_bpe, decontaminate, jaccard_join, kd_sharding, language_id, language_model, pii, quality_rules, suffix_dedup, token_files


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_pii_boosting": pii.query,
    "op2_quality_rules": quality_rules.query,
    "op3_token_files": token_files.query,
    "op4_kd_sharding": kd_sharding.query,
    "op5_jaccard_join": jaccard_join.query,
    "op6_byte_bpe": byte_bpe.query,
    "op7_decontaminate": decontaminate.query,
    "op8_suffix_dedup": suffix_dedup.query,
    "op9_language_id": language_id.query,
    "op10_language_model": language_model.query,
    "pipeline": pipeline,
}
#: op1, op2, op9 and op10 return what trained models decide, op3 and op6 need a tokenizer, op4 a learned tree, and op8
#: compares all windows in SQL, which whole tables don't allow. Those are tested by brute force.
ORACLES = {"op5_jaccard_join": jaccard_join.ORACLE, "op7_decontaminate": decontaminate.ORACLE}
