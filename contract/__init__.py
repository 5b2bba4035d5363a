"""Queries over the supplied tables, one module per operator group."""

from importlib import import_module

GROUPS = [
    "a_sources",
    "b_expressions",
    "c_joins",
    "d_aggregates",
    "e_windows",
    "f_sets",
    "g_quality",
    "h_recode",
    "i_features",
    "j_master",
    "k_models",
    "l_layout",
]


def load_all() -> None:
    for group in GROUPS:
        import_module(f"contract.{group}")
