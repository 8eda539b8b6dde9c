"""The subpackage's queries and their DuckDB oracles."""

from tessera.llm import digest, exact, licenses, mixing, packing, passages, quality, secrets, sharding, simhash

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_mixing_sources": mixing.op3_mixing_sources,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_document_fingerprints": digest.op5_document_fingerprints,
    "op6_sharding": sharding.op6_sharding,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_exact_dedup": exact.op8_exact_dedup,
    "op9_substring_dedup": passages.op9_substring_dedup,
    "op10_quality_classifier": quality.op10_quality_classifier,
}

ORACLES = {
    "op3_mixing_sources": mixing.oracle(),
    "op8_exact_dedup": exact.OP8_SQL,
}
