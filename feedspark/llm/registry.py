"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from feedspark.llm.decontam import OP3_SQL, op3_decontamination
from feedspark.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from feedspark.llm.html_text import op9_main_text
from feedspark.llm.lang_id import op5_language_id
from feedspark.llm.near_dup import OP4_SQL, op4_near_duplicates
from feedspark.llm.ngram_join import OP12_SQL, op12_ngram_join
from feedspark.llm.packing import op7_packing
from feedspark.llm.quality import op6_quality_rules
from feedspark.llm.sharding import OP2_SQL, op2_sharding
from feedspark.llm.token_records import op8_token_records
from feedspark.llm.toxicity import op1_toxicity
from feedspark.llm.warc import OP10_SQL, op10_warc_audit
from feedspark.llm.whitening import op13_whitening

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_sharding": op2_sharding,
    "op3_decontamination": op3_decontamination,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_language_id": op5_language_id,
    "op6_quality_rules": op6_quality_rules,
    "op7_packing": op7_packing,
    "op8_token_records": op8_token_records,
    "op9_main_text": op9_main_text,
    "op10_warc_audit": op10_warc_audit,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_ngram_join": op12_ngram_join,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op2_sharding": OP2_SQL,
    "op3_decontamination": OP3_SQL,
    "op4_near_duplicates": OP4_SQL,
    "op10_warc_audit": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_ngram_join": OP12_SQL,
}
