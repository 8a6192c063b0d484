"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import arrow_output, embedding_dedup, fingerprints, html_extract, mixing, ngram_join, packing, quality, quality_rules, secrets, sharding, token_alignment, vector_codes

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_quality": quality.op3_quality,
    "op4_sharding": sharding.op4_sharding,
    "op5_packing": packing.op5_packing,
    "op6_mixing": mixing.op6_mixing,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_html_extract": html_extract.op8_html_extract,
    "op9_arrow_output": arrow_output.op9_arrow_output,
    "op10_secrets": secrets.op10_secrets,
    "op11_quality_rules": quality_rules.op11_quality_rules,
    "op12_alignment": token_alignment.op12_alignment,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
SQL = {"op1_embedding_dedup": embedding_dedup.OP1_SQL, "op2_ngram_join": ngram_join.OP2_SQL, "op6_mixing": mixing.OP6_SQL, "op10_secrets": secrets.OP10_SQL, "op11_quality_rules": quality_rules.OP11_SQL, "op13_vector_codes": vector_codes.OP13_SQL}
