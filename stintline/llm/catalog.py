"""Registered queries of the corpus operators, and SQL where SQL can express one."""

from __future__ import annotations

from stintline.llm import ann, audit, bpe, html_extract, langid, line_dedup, mixing, quality, runs, sharding, simhash, substrings, url_filter


def queries():
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_langid": langid.op2_langid,
        "op3_quality": quality.op3_quality,
        "op4_sharding": sharding.op4_sharding,
        "op5_simhash": simhash.op5_simhash,
        "op6_bpe": bpe.op6_bpe,
        "op7_html": html_extract.op7_html,
        "op8_ann": ann.op8_ann,
        "op9_mixing": mixing.op9_mixing,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_runs": runs.op11_runs,
        "op12_audit": audit.op12_audit,
        "op13_substrings": substrings.op13_substrings,
    }


def oracle_sql():
    return {
        "op1_line_dedup": line_dedup.OP1_SQL,
        "op4_sharding": sharding.OP4_SQL,
        "op9_mixing": mixing.OP9_SQL,
        "op12_audit": audit.OP12_SQL,
        "op13_substrings": substrings.OP13_SQL,
    }
