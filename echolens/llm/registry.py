"""The training-data queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import OP7_SQL, op7_decontamination
from .language_id import op2_language_id
from .line_dedup import OP6_SQL, op6_line_dedup
from .lm_scoring import op3_lm_scoring
from .nearest import op10_nearest_neighbours
from .pieces import op9_sentencepiece
from .secrets import op8_secret_scan
from .simhash import op1_simhash_near_dedup
from .substring_dedup import OP4_SQL, op4_substring_dedup
from .toxicity import op5_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash_near_dedup, op2_language_id, op3_lm_scoring, op4_substring_dedup, op5_toxicity, op6_line_dedup, op7_decontamination, op8_secret_scan, op9_sentencepiece, op10_nearest_neighbours)}
ORACLE_SQL: dict[str, str] = {"op4_substring_dedup": OP4_SQL, "op6_line_dedup": OP6_SQL, "op7_decontamination": OP7_SQL}
