"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from beaconlake.llm import ann, embed_dedup, fim, genetic, mixing, packing, pii, runs, secrets, simhash, tokens, toxicity, urls

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_embedding_dedup": embed_dedup.op2_embedding_dedup,
    "op3_packing": packing.op3_packing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_url_filter": urls.op5_url_filter,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_simhash": simhash.op8_simhash,
    "op9_pii": pii.op9_pii,
    "op10_nearest": ann.op10_nearest,
    "op11_fim": fim.op11_fim,
    "op12_genetic": genetic.op12_genetic,
    "op13_runs": runs.op13_runs,
}
ORACLES = {
    "op1_mix": mixing.OP1_SQL,
    "op5_url_filter": urls.OP5_SQL,
    "op9_pii": pii.OP9_SQL,
    "op10_nearest": ann.OP10_SQL,
    "op2_embedding_dedup": embed_dedup.OP2_SQL,
    "op11_fim": fim.OP11_SQL,
}
