"""The thirteen training-data queries, by name, and their SQL."""

from __future__ import annotations

from citeloom.llm.bpe import op2_bpe_codec
from citeloom.llm.cdc_dedup import op7_substring_dedup
from citeloom.llm.chat_format import ORACLE_OP10, op10_chat_format
from citeloom.llm.decontam import ORACLE_OP6, op6_decontaminate
from citeloom.llm.embed_dedup import ORACLE_OP4, op4_embedding_near_dedup
from citeloom.llm.exact_index import ORACLE_OP12, op12_exact_dedup
from citeloom.llm.hard_negatives import ORACLE_OP11, op11_hard_negatives
from citeloom.llm.html_template import op9_html_main_text
from citeloom.llm.kdtree_codes import ORACLE_OP13, op13_vector_codes
from citeloom.llm.license_scan import ORACLE_OP3, op3_license_scan
from citeloom.llm.ngram_join import ORACLE_OP1, op1_ngram_jaccard_join
from citeloom.llm.quality_cnn import op5_quality_cnn
from citeloom.llm.url_tree import ORACLE_OP8, op8_url_verdicts

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_bpe_codec": op2_bpe_codec,
    "op3_license_scan": op3_license_scan,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_quality_cnn": op5_quality_cnn,
    "op6_decontaminate": op6_decontaminate,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_url_verdicts": op8_url_verdicts,
    "op9_html_main_text": op9_html_main_text,
    "op10_chat_format": op10_chat_format,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_vector_codes": op13_vector_codes,
}

#: Equivalent DuckDB SQL, where SQL can express the whole query in reasonable time.
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": ORACLE_OP1,
    "op3_license_scan": ORACLE_OP3,
    "op4_embedding_near_dedup": ORACLE_OP4,
    "op6_decontaminate": ORACLE_OP6,
    "op8_url_verdicts": ORACLE_OP8,
    "op10_chat_format": ORACLE_OP10,
    "op11_hard_negatives": ORACLE_OP11,
    "op12_exact_dedup": ORACLE_OP12,
    "op13_vector_codes": ORACLE_OP13,
}
