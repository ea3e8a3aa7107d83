"""The training-data queries and their DuckDB statements, by name."""

from __future__ import annotations

from dossierlake.llm import bpe, collocations, embedding_dedup, exact_dedup, line_dedup, mixing, packing, periodic_runs, pipeline, quality, quotes, secret_scan, simhash, toxicity

LLM_QUERIES = {
    "op1_bpe_codec": bpe.query,
    "op2_quote_linking": quotes.query,
    "op3_line_dedup": line_dedup.query,
    "op4_quality_rank": quality.query,
    "op5_secret_scan": secret_scan.query,
    "op6_source_mix": mixing.query,
    "op7_simhash_dedup": simhash.query,
    "op8_toxicity": toxicity.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_embedding_dedup": embedding_dedup.query,
    "op11_best_fit_packing": packing.query,
    "op12_phrase_collocations": collocations.query,
    "op13_periodic_runs": periodic_runs.query,
    "pipeline": pipeline.run,
}

LLM_ORACLE = {
    "op2_quote_linking": quotes.ORACLE_SQL,
    "op3_line_dedup": line_dedup.ORACLE_SQL,
    "op6_source_mix": mixing.ORACLE_SQL,
    "op9_exact_dedup": exact_dedup.ORACLE_SQL,
    "op12_phrase_collocations": collocations.ORACLE_SQL,
}
