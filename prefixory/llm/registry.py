"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .audit import OP12_SQL, op12_filter_audit
from .automaton import op13_word_pieces
from .fim import OP11_SQL, op11_fill_in_middle
from .language_model import op2_language_model
from .lines import OP8_SQL, op8_lines
from .minhash import op10_near_duplicates
from .neighbours import op4_neighbours
from .packing import op1_packing
from .pii import op7_personal_data
from .pieces import op5_pieces
from .quality import op3_quality
from .sharding import op6_sharding
from .spots import op9_spots


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_language_model": op2_language_model,
        "op3_quality": op3_quality,
        "op4_neighbours": op4_neighbours,
        "op5_pieces": op5_pieces,
        "op6_sharding": op6_sharding,
        "op7_personal_data": op7_personal_data,
        "op8_lines": op8_lines,
        "op9_spots": op9_spots,
        "op10_near_duplicates": op10_near_duplicates,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_filter_audit": op12_filter_audit,
        "op13_word_pieces": op13_word_pieces,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_lines": OP8_SQL, "op11_fill_in_middle": OP11_SQL, "op12_filter_audit": OP12_SQL}
