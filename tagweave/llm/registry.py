"""The queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagweave.llm.hash_forest import op12_hash_forest
from tagweave.llm.html_text import op6_html_text
from tagweave.llm.lm import op5_lm_scoring
from tagweave.llm.media import op7_media_columns
from tagweave.llm.mixing import op9_mixing
from tagweave.llm.neardup import OP2_SQL, op2_near_duplicates
from tagweave.llm.packing import op4_packing
from tagweave.llm.pii import op1_pii
from tagweave.llm.quality import op10_quality
from tagweave.llm.resampling import OP11_SQL, op11_resampling
from tagweave.llm.spelling import OP13_SQL, op13_spelling_variants
from tagweave.llm.token_counts import op3_token_counts
from tagweave.llm.topk import OP8_SQL, op8_topk_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_token_counts": op3_token_counts,
    "op4_packing": op4_packing,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_html_text": op6_html_text,
    "op7_media_columns": op7_media_columns,
    "op8_topk_search": op8_topk_search,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
    "op11_resampling": op11_resampling,
    "op12_hash_forest": op12_hash_forest,
    "op13_spelling_variants": op13_spelling_variants,
}
SQL: dict[str, str] = {
    "op2_near_duplicates": OP2_SQL,
    "op8_topk_search": OP8_SQL,
    "op11_resampling": OP11_SQL,
    "op13_spelling_variants": OP13_SQL,
}
