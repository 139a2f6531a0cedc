"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import (block_names, chat_fsm, jaccard_orders, lang_rank, line_windows, lm_ctw, mix_budget, piece_prefix, spelling_chunks,
               toxic_channel, turn_repair, url_rules, winnow)

MODULES = (lm_ctw, url_rules, line_windows, lang_rank, chat_fsm, winnow, toxic_channel, mix_budget, jaccard_orders, block_names,
           spelling_chunks, piece_prefix, turn_repair)

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
