"""The corpus operators' queries and their oracle SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name -> module; the function has the query's name.
MODULES = {
    "op1_html": "html",
    "op2_quality": "quality",
    "op3_zip_archive": "zip_archive",
    "op4_secrets": "secrets",
    "op5_mix": "mixing",
    "op6_scoring": "scoring",
    "op7_language": "language",
    "op8_decontaminate": "decontaminate",
    "op9_token_files": "token_files",
    "op10_simhash": "simhash",
}
#: Query name -> module whose ORACLE_SQL is the query's oracle.
ORACLES: dict[str, str] = {"op1_html": "html", "op2_quality": "quality", "op3_zip_archive": "zip_archive", "op8_decontaminate": "decontaminate"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"gneiss.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: import_module(f"gneiss.llm.{module}").ORACLE_SQL for name, module in ORACLES.items()}
