"""driftscope: compare two recorded runs of one workload, on Spark."""

from driftscope.params import CompareParams, ParameterError
from driftscope.plans.comparison import Comparison
from driftscope.sources.runs import Run, load_run, union_runs
from driftscope.sources.sides import Sides, resolve_sides

__all__ = [
    "CompareParams", "Comparison", "ParameterError", "Run", "Sides",
    "load_run", "resolve_sides", "union_runs",
]
