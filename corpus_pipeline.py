"""A corpus pipeline; driftwell.llm.pipeline has its stages."""

from driftwell.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]
