"""Queries of the operators, one op<N>_<name> for each, and their SQL where SQL can express them."""

from __future__ import annotations

from .chat import OP8_SQL, op8_chat_format
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .extract import op2_extract
from .filter_audit import OP11_SQL, op11_filter_audit
from .mixing import OP9_SQL, op9_mixing
from .near_dedup import OP1_SQL, op1_near_dedup
from .packing import op6_packing
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .quality import op7_quality
from .token_counts import op5_token_counts
from .topk import OP3_SQL, op3_topk_search
from .toxicity import op4_toxicity
from .warc import OP12_SQL, op12_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_near_dedup,
        op2_extract,
        op3_topk_search,
        op4_toxicity,
        op5_token_counts,
        op6_packing,
        op7_quality,
        op8_chat_format,
        op9_mixing,
        op10_exact_dedup,
        op11_filter_audit,
        op12_warc,
        op13_prefix_trie,
    )
}
ORACLE = {
    "op1_near_dedup": OP1_SQL,
    "op3_topk_search": OP3_SQL,
    "op8_chat_format": OP8_SQL,
    "op9_mixing": OP9_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_warc": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
