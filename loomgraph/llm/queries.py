"""The corpus operators' registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import OP7_SQL, op7_decontamination
from .jaccard import op4_jaccard_groups
from .katz import op1_katz_scores
from .language import op6_language_id
from .licenses import op9_license_scan
from .lines import OP2_SQL, op2_line_dedup
from .mixing import op10_source_mix
from .pages import op3_html_text
from .spots import op8_spot_signatures
from .urls import OP5_SQL, op5_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_katz_scores": op1_katz_scores,
    "op2_line_dedup": op2_line_dedup,
    "op3_html_text": op3_html_text,
    "op4_jaccard_groups": op4_jaccard_groups,
    "op5_url_filter": op5_url_filter,
    "op6_language_id": op6_language_id,
    "op7_decontamination": op7_decontamination,
    "op8_spot_signatures": op8_spot_signatures,
    "op9_license_scan": op9_license_scan,
    "op10_source_mix": op10_source_mix,
}
ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": OP2_SQL,
    "op5_url_filter": OP5_SQL,
    "op7_decontamination": OP7_SQL,
}
