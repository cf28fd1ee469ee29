"""The queries of this folder's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op8_bpe
from .chat import OP7_SQL, op7_chat_rotation
from .decontamination import op10_decontamination
from .divergence import OP13_SQL, op13_source_divergence
from .exact_dedup import OP12_SQL, op12_exact_dedup
from .importance import OP11_SQL, op11_importance_resampling
from .line_dedup import op9_line_dedup
from .lm_score import op3_lm_score
from .ngram_join import OP6_SQL, op6_ngram_join
from .quality import OP2_SQL, op2_quality_rules
from .sharding import op5_sharding
from .token_counts import op4_token_counts
from .token_output import op1_token_output


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_output, op2_quality_rules, op3_lm_score, op4_token_counts, op5_sharding, op6_ngram_join, op7_chat_rotation, op8_bpe, op9_line_dedup, op10_decontamination, op11_importance_resampling, op12_exact_dedup, op13_source_divergence)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2_SQL, "op6_ngram_join": OP6_SQL, "op7_chat_rotation": OP7_SQL, "op11_importance_resampling": OP11_SQL, "op12_exact_dedup": OP12_SQL, "op13_source_divergence": OP13_SQL}
