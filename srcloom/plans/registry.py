"""All registered queries of the code-corpus operators and their SQL.

Operators return arrays where a list is the result; registered queries show
those columns as text joined by |, so that results compare as plain values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import accounting, analysing, calling, contracting, looking, reporting, resolving, scanning, solidity

MODULES = (scanning, calling, accounting, resolving, contracting, analysing, looking, reporting, solidity)

#: Array columns of each query.
ARRAYS = {
    "e14_split_top_level": ["items"],
    "e15_account_flags": ["seeds"],
    "e16_account_attrs_regex": ["seeds", "validations"],
    "e17_account_validations": ["validations"],
    "e23_accounts_without_validation": ["items"],
    "a3_entry_flow": ["program_accounts", "init_accounts", "mut_accounts", "close_accounts"],
    "a4_account_lifecycle": ["init_program", "init_other", "close_program", "close_other", "mut_program", "mut_other", "program_accounts"],
    "a10_sol_entries": ["access_control"],
    "a14_sorted_unique": ["callee_name"],
    "j19_interface_impls": ["implemented_by", "functions"],
    "e11_contracts": ["bases"],
    "e11_contract_functions": ["modifiers"],
}


def _as_text(f: Callable[[SparkSession, str], DataFrame], cols: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(spark, sf_dir).withColumns({c: F.array_join(F.col(c).cast("array<string>"), "|") for c in cols})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _m in MODULES:
    for _name, _f in _m.QUERIES.items():
        _cols = ARRAYS.get(_name, []) + getattr(_m, "ARRAYS", {}).get(_name, [])
        QUERIES[_name] = _as_text(_f, _cols) if _cols else _f
        if _name in _m.ORACLES:
            _sql = _m.ORACLES[_name]
            ORACLES[_name] = f"SELECT * REPLACE ({', '.join(f'array_to_string({c}, chr(124)) AS {c}' for c in _cols)}) FROM ({_sql})" if _cols else _sql
