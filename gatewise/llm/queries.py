"""Queries of the training-data operators over whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, licenses, quality, secrets
from .decontamination import op1_decontamination
from .language_model import op8_language_model
from .languages import op4_languages
from .licenses import op6_licenses
from .pieces import op9_pieces
from .quality import op10_quality
from .secrets import op5_secrets
from .simhash import op2_simhash
from .token_counts import op7_token_counts
from .toxicity import op3_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_simhash, op3_toxicity, op4_languages, op5_secrets,
        op6_licenses, op7_token_counts, op8_language_model, op9_pieces, op10_quality,
    )
}
#: The others depend on XXH64, learned models or vocabularies that SQL has not.
ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": decontamination.ORACLE,
    "op5_secrets": secrets.ORACLE,
    "op6_licenses": licenses.ORACLE,
    "op10_quality": quality.ORACLE,
}
