"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op9_decontamination
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .language_id import op7_language_id
from .line_dedup import op6_line_dedup
from .packing import op3_best_fit_packing
from .periodic_runs import op13_periodic_runs
from .ppm import op4_ppm_scores
from .quality import op10_quality
from .simhash_dedup import op1_simhash_dedup
from .spelling import op12_spelling_variants
from .suffix_dedup import op5_suffix_dedup
from .token_counts import op11_token_counts
from .warc import OP2_SQL, op2_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_dedup": op1_simhash_dedup,
        "op2_warc": op2_warc,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_ppm_scores": op4_ppm_scores,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_line_dedup": op6_line_dedup,
        "op7_language_id": op7_language_id,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_decontamination": op9_decontamination,
        "op10_quality": op10_quality,
        "op11_token_counts": op11_token_counts,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op8_exact_dedup": OP8_SQL}
