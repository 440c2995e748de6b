"""Queries and SQL of the operators in this package."""

from __future__ import annotations

from .chat_snapshots import OP7_SQL, op7_chat_snapshots
from .decontaminate import op1_decontaminate
from .jaccard_join import OP9_SQL, op9_jaccard_join
from .language_id import op10_language_id
from .packing import op8_harmonic_packing
from .quality_rules import OP4_SQL, op4_line_frequency_rules
from .repeats import op5_repeats
from .token_counts import op6_token_counts
from .toxicity import op3_toxicity
from .url_filter import op2_url_filter

QUERIES = {
    f.__name__: f
    for f in (op1_decontaminate, op2_url_filter, op3_toxicity, op4_line_frequency_rules, op5_repeats, op6_token_counts, op7_chat_snapshots, op8_harmonic_packing, op9_jaccard_join, op10_language_id)
}
ORACLES = {"op4_line_frequency_rules": OP4_SQL, "op7_chat_snapshots": OP7_SQL, "op9_jaccard_join": OP9_SQL}
