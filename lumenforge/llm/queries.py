"""The training-data queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenforge.llm.decontamination import op10_template_decontamination
from lumenforge.llm.language_model import op7_kneser_ney
from lumenforge.llm.ngram_join import op1_ngram_jaccard
from lumenforge.llm.packing import op9_best_fit_packing
from lumenforge.llm.quality_rules import op5_mcd_outliers, op5_sql
from lumenforge.llm.secret_scan import op6_randomness_secrets
from lumenforge.llm.sharding import op2_interleaved_shards
from lumenforge.llm.suffix_dedup import op8_maximal_repeats
from lumenforge.llm.toxicity import op4_lexicon_toxicity
from lumenforge.llm.warc_fixity import op3_merkle_fixity, op3_sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_ngram_jaccard, op2_interleaved_shards, op3_merkle_fixity, op4_lexicon_toxicity, op5_mcd_outliers,
            op6_randomness_secrets, op7_kneser_ney, op8_maximal_repeats, op9_best_fit_packing, op10_template_decontamination,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_merkle_fixity": op3_sql(), "op5_mcd_outliers": op5_sql()}
