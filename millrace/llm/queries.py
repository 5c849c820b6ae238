"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import ann, decontam, langid, mixing, quality, simhash, substrings, warc, webtext, wordpiece

QUERIES = {
    "op1_nearest": ann.op1,
    "op2_simhash": simhash.op2,
    "op3_mix_sources": mixing.op3,
    "op4_langid": langid.op4,
    "op5_decontaminate": decontam.op5,
    "op6_substrings": substrings.op6,
    "op7_token_counts": wordpiece.op7,
    "op8_main_text": webtext.op8,
    "op9_quality": quality.op9,
    "op10_warc": warc.op10,
}

ORACLE_SQL = {
    "op3_mix_sources": mixing.OP3_SQL,
    "op6_substrings": substrings.OP6_SQL,
    "op10_warc": warc.OP10_SQL,
}
