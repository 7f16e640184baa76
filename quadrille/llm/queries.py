"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .ann import op7_cross_polytope
from .bpe import op8_merge_replay
from .chat import op2_chat_windows
from .codes import op11_kd_codes, op11_sql
from .langid import op4_string_kernel
from .link_filter import op5_link_graph, op5_sql
from .mixing import op12_fair_queueing, op12_sql
from .packing import op9_differencing
from .quality import op1_pu_quality
from .resampling import op13_sql, op13_suffix_resampling
from .simhash import op6_simhash
from .sketch import op10_scaled_sketch
from .suffix_dedup import op3_deep_shallow


def queries():
    return {
        "op1_pu_quality": op1_pu_quality,
        "op2_chat_windows": op2_chat_windows,
        "op3_deep_shallow": op3_deep_shallow,
        "op4_string_kernel": op4_string_kernel,
        "op5_link_graph": op5_link_graph,
        "op6_simhash": op6_simhash,
        "op7_cross_polytope": op7_cross_polytope,
        "op8_merge_replay": op8_merge_replay,
        "op9_differencing": op9_differencing,
        "op10_scaled_sketch": op10_scaled_sketch,
        "op11_kd_codes": op11_kd_codes,
        "op12_fair_queueing": op12_fair_queueing,
        "op13_suffix_resampling": op13_suffix_resampling,
    }


def oracle_sql():
    return {"op5_link_graph": op5_sql(), "op11_kd_codes": op11_sql(), "op12_fair_queueing": op12_sql(), "op13_suffix_resampling": op13_sql()}
