"""Queries of the text operators and their SQL twins."""

from __future__ import annotations

from cellweave.llm import sql
from cellweave.llm.chunk_codec import codec_query
from cellweave.llm.decontaminate import decontamination_query
from cellweave.llm.fingerprints import fingerprint_query
from cellweave.llm.html_text import html_query
from cellweave.llm.near_dedup import near_dedup_query
from cellweave.llm.ordinal_quality import quality_query
from cellweave.llm.privacy import privacy_query
from cellweave.llm.source_divergence import divergence_query
from cellweave.llm.spelling_variants import variants_query
from cellweave.llm.substring_dedup import substring_query
from cellweave.llm.token_counts import token_count_query
from cellweave.llm.token_files import token_file_query
from cellweave.llm.warc_files import warc_query

QUERIES = {
    "op1_ordinal_quality": quality_query,
    "op2_token_files": token_file_query,
    "op3_substring_dedup": substring_query,
    "op4_token_counts": token_count_query,
    "op5_decontaminate": decontamination_query,
    "op6_chunk_codec": codec_query,
    "op7_html_text": html_query,
    "op8_privacy": privacy_query,
    "op9_fingerprints": fingerprint_query,
    "op10_near_dedup": near_dedup_query,
    "op11_warc": warc_query,
    "op12_source_divergence": divergence_query,
    "op13_spelling_variants": variants_query,
}

#: The others hold a tokenizer, a fitted model, page markup or a hash that SQL lacks; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": sql.OP3,
    "op5_decontaminate": sql.OP5,
    "op10_near_dedup": sql.OP10,
    "op11_warc": sql.OP11,
    "op12_source_divergence": sql.OP12,
    "op13_spelling_variants": sql.OP13,
}
