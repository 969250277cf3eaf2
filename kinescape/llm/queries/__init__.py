"""One module for each operator's query; ``queries()`` and ``oracle_sql()`` collect them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Module of each query.
MODULES = (
    "op1_byte_bpe",
    "op2_harmonic_packing",
    "op3_quartile_digest",
    "op4_license_scan",
    "op5_secret_scan",
    "op6_string_kernel",
    "op7_attention_lm",
    "op8_line_winnowing",
    "op9_pivot_permutation",
    "op10_bbit_minhash",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: import_module(f"{__name__}.{name}").query for name in MODULES}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__name__}.{name}"), "ORACLE", None) for name in MODULES}
    return {name: sql for name, sql in found.items() if sql}
