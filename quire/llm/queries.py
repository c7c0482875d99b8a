"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .crf import op6_toxicity
from .decontaminate import OP9_SQL, op9_decontamination
from .jaccard import OP3_SQL, op3_ngram_jaccard_join
from .lm import op4_lm_scoring
from .media import op5_media_columns
from .pieces import op7_sentencepiece
from .quality import op8_quality_classifier
from .secrets import OP10_SQL, op10_secret_scans
from .token_counts import op2_token_counts
from .warc import OP1_SQL, op1_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_token_counts": op2_token_counts,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_media_columns": op5_media_columns,
    "op6_toxicity": op6_toxicity,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_decontamination": op9_decontamination,
    "op10_secret_scans": op10_secret_scans,
}
ORACLES: dict[str, str] = {"op1_warc": OP1_SQL, "op3_ngram_jaccard_join": OP3_SQL, "op9_decontamination": OP9_SQL, "op10_secret_scans": OP10_SQL}
