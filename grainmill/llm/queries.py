"""Queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from . import decontaminate, filter_audit, jaccard, licenses, line_dedup, media, packing, periodic, quality, substring_dedup, suffix_dedup, url_filter, warc


def queries() -> dict:
    return {
        "op1_decontamination": decontaminate.op1_decontamination,
        "op2_warc": warc.op2_warc,
        "op3_quality": quality.op3_quality,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_jaccard": jaccard.op5_jaccard,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_media": media.op8_media,
        "op9_packing": packing.op9_packing,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_licenses": licenses.op12_licenses,
        "op13_periodic_runs": periodic.op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontaminate.OP1_SQL,
        "op2_warc": warc.OP2_SQL,
        "op5_jaccard": jaccard.OP5_SQL,
        "op6_substring_dedup": substring_dedup.OP6_SQL,
        "op10_line_dedup": line_dedup.OP10_SQL,
        "op11_filter_audit": filter_audit.OP11_SQL,
        "op12_licenses": licenses.OP12_SQL,
        "op13_periodic_runs": periodic.OP13_SQL,
    }
