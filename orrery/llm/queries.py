"""Named queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

import importlib

_OPERATORS = {
    "op1_hidden_markov": "hmm",
    "op2_lattice": "lattice",
    "op3_mixing": "mixing",
    "op4_licences": "licences",
    "op5_token_counts": "token_counts",
    "op6_cover_tree": "cover_tree",
    "op7_jaccard": "jaccard",
    "op8_quality": "quality",
    "op9_sentencepiece": "sentencepiece_codec",
    "op10_language_id": "language_id",
    "op11_elkan": "elkan",
    "op12_suffix_array": "suffix_array",
    "op13_fill_middle": "fill_middle",
}


NAMES = list(_OPERATORS)


def query(name: str):
    """(callable, SQL or None) of a name; imports the operator's module."""
    module = importlib.import_module(f"{__package__}.{_OPERATORS[name]}")
    return getattr(module, name), getattr(module, "ORACLE_SQL", {}).get(name)


def queries() -> dict:
    return {name: query(name)[0] for name in NAMES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in NAMES if (sql := query(name)[1])}
