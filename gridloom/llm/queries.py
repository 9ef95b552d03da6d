"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from . import decontaminate, fixity, forest, langid, licenses, lmscore, minhash, packing, quality, suffix

QUERIES = {
    "op1_best_two_fit_packing": packing.op1_best_two_fit_packing,
    "op2_warc_fixity": fixity.op2_warc_fixity,
    "op3_language_mixture": langid.op3_language_mixture,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_lm_scoring": lmscore.op5_lm_scoring,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_suffix_array_dedup": suffix.op7_suffix_array_dedup,
    "op8_minhash_near_dedup": minhash.op8_minhash_near_dedup,
    "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
    "op10_hash_prefix_forest": forest.op10_hash_prefix_forest,
}

ORACLES: dict[str, str] = {
    "op2_warc_fixity": fixity.SQL,
    "op6_license_scan": licenses.SQL,
    "op9_benchmark_decontamination": decontaminate.SQL,
}
