"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dossier.llm.bpe import op13_bpe
from dossier.llm.chat import OP8_SQL, op8_chat_formatting
from dossier.llm.collocations import OP11_SQL, op11_collocations
from dossier.llm.decontamination import op9_decontamination
from dossier.llm.embedding_dedup import OP6_SQL, op6_embedding_dedup
from dossier.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from dossier.llm.language_id import op2_language_id
from dossier.llm.mixing import OP5_SQL, op5_mixing
from dossier.llm.near_dedup import op4_near_dedup
from dossier.llm.sharding import op10_sharding
from dossier.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from dossier.llm.suffix_tree_lm import op3_lm_scoring
from dossier.llm.warc import OP7_SQL, op7_warc


OPERATORS = (
    op1_substring_dedup, op2_language_id, op3_lm_scoring, op4_near_dedup, op5_mixing, op6_embedding_dedup, op7_warc, op8_chat_formatting, op9_decontamination, op10_sharding,
    op11_collocations, op12_hard_negatives, op13_bpe,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": OP1_SQL, "op5_mixing": OP5_SQL, "op6_embedding_dedup": OP6_SQL, "op7_warc": OP7_SQL, "op8_chat_formatting": OP8_SQL,
        "op11_collocations": OP11_SQL, "op12_hard_negatives": OP12_SQL,
    }
