"""The corpus pipeline: stages applied one after another, each written as Parquet and read again."""

from __future__ import annotations

from tickloom.llm.stages import ORACLE_SQL, STAGES, run  # noqa: F401
