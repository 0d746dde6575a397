"""Named queries over the test tables and their DuckDB oracles."""

from rivulet.plans import q_etl, q_factors, q_io, q_lists, q_models  # noqa: F401  (registers queries)
from rivulet.plans import oracles_io, oracles_models  # noqa: F401  (fill ORACLES)
from rivulet.plans.oracles import ORACLES
from rivulet.plans.registry import QUERIES

__all__ = ["QUERIES", "ORACLES"]
