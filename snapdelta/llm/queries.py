"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import OP5_SQL, op5_decontamination
from .embedding_dedup import OP8_SQL, op8_embedding_dedup
from .language_id import op6_language_id
from .minhash import op7_minhash
from .mixing import op4_mixing
from .pii import op3_pii
from .sharding import op9_sharding
from .token_counts import op1_token_counts
from .toxicity import op2_toxicity
from .url_filter import op10_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_pii": op3_pii,
    "op4_mixing": op4_mixing,
    "op5_decontamination": op5_decontamination,
    "op6_language_id": op6_language_id,
    "op7_minhash": op7_minhash,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_sharding": op9_sharding,
    "op10_url_filter": op10_url_filter,
}

#: DuckDB SQL, for those that SQL can express.
ORACLE: dict[str, str] = {"op5_decontamination": OP5_SQL, "op8_embedding_dedup": OP8_SQL}
