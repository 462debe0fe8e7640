"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.llm.fingerprints import op10_closed_syncmers
from orrery.llm.langid import op4_language_bitmask_filters
from orrery.llm.neardup import op5_signature_coordinate_join
from orrery.llm.packing import op9_grouping_genetic_packing
from orrery.llm.secrets import op1_secret_scan
from orrery.llm.sharding import op2_balanced_label_propagation
from orrery.llm.substrings import op6_repeated_phrase_automata
from orrery.llm.tokens import op7_forced_boundary_bpe
from orrery.llm.topk import OP3_SQL, op3_no_random_access_topk
from orrery.llm.toxicity import op8_weighted_clause_grammar


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_balanced_label_propagation": op2_balanced_label_propagation,
        "op3_no_random_access_topk": op3_no_random_access_topk,
        "op4_language_bitmask_filters": op4_language_bitmask_filters,
        "op5_signature_coordinate_join": op5_signature_coordinate_join,
        "op6_repeated_phrase_automata": op6_repeated_phrase_automata,
        "op7_forced_boundary_bpe": op7_forced_boundary_bpe,
        "op8_weighted_clause_grammar": op8_weighted_clause_grammar,
        "op9_grouping_genetic_packing": op9_grouping_genetic_packing,
        "op10_closed_syncmers": op10_closed_syncmers,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_no_random_access_topk": OP3_SQL}
