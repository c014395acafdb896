"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import op4_chat
from .decontaminate import op3_decontaminate
from .jaccard import op1_jaccard
from .language import op10_language
from .mixing import op2_mixing
from .periodic import op12_runs
from .quality import op7_quality
from .secrets import op8_secrets
from .substrings import op9_substrings
from .tiff import op5_tiff
from .tokens import op6_tokens
from .urls import ORACLE as URLS_SQL
from .urls import op11_urls
from .vectors import ORACLE as VECTORS_SQL
from .vectors import op13_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard": op1_jaccard, "op2_mixing": op2_mixing, "op3_decontaminate": op3_decontaminate, "op4_chat": op4_chat, "op5_tiff": op5_tiff,
    "op6_tokens": op6_tokens, "op7_quality": op7_quality, "op8_secrets": op8_secrets, "op9_substrings": op9_substrings, "op10_language": op10_language,
    "op11_urls": op11_urls, "op12_runs": op12_runs, "op13_vectors": op13_vectors,
}
ORACLES: dict[str, str] = {"op11_urls": URLS_SQL, "op13_vectors": VECTORS_SQL}
