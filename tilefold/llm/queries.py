"""All queries of this subpackage and their SQL, by name."""

from tilefold.llm import (
    op1_url_model,
    op2_decontamination,
    op3_simhash,
    op4_suffix_dedup,
    op5_content_store,
    op6_secrets,
    op7_compression_bands,
    op8_quality,
    op9_packing,
    op10_token_counts,
    op11_fill_middle,
    op12_vector_codes,
    op13_syncmers,
)

MODULES = [op1_url_model, op2_decontamination, op3_simhash, op4_suffix_dedup, op5_content_store, op6_secrets, op7_compression_bands, op8_quality, op9_packing, op10_token_counts, op11_fill_middle, op12_vector_codes, op13_syncmers]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
