"""A whole comparison: every intermediate and result set, built lazily."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame

from driftscope.operators.compare import IS_MULTI_PLAN, compare, group_names, regressed
from driftscope.operators.dominant import dominant_pairs, multi_plan_dominant
from driftscope.operators.drilldown import multi_plan_detail, multi_plan_rows
from driftscope.operators.groups import group_stats, identify
from driftscope.operators.preagg import plan_stats
from driftscope.operators.shape import pair_members, plan_indicators, shape_diff
from driftscope.params import CompareParams
from driftscope.plans import reports
from driftscope.plans.steps import Steps
from driftscope.sources.runs import Run
from driftscope.sources.sides import Sides


class Comparison:
    """The four result sets of one run under one set of parameters.

    Each attribute is a DataFrame that computes nothing until it is used.  All
    result sets start from the group statistics, which are small beside the run
    statistics, so these are stored on first use (memory, then disk; what an
    executor loses is computed again), and so are the rows of multi-plan groups,
    which several steps share.  ``store`` says how much: "groups", "plans" to
    store plan statistics too, which a drill-down also starts from, or None.
    Use it as a context manager or call :meth:`release`.
    """

    def __init__(self, run: Run, params: CompareParams, sides: Sides, engine: str = "xpath",
                 store: str | None = "groups"):
        if store not in ("groups", "plans", None):
            raise ValueError(f"store must be groups, plans or None, not {store!r}")
        self.run, self.params, self.sides, self.engine, self.store = run, params, sides, engine, store
        self._stored: list[DataFrame] = []

    def __enter__(self) -> Comparison:
        return self

    def __exit__(self, *_) -> None:
        self.release()

    def release(self) -> None:
        for frame in self._stored:
            frame.unpersist()
        self._stored.clear()

    def _keep(self, frame: DataFrame, wanted: bool) -> DataFrame:
        if wanted:
            self._stored.append(frame.persist())
        return frame

    @cached_property
    def plan_stats(self) -> DataFrame:
        return self._keep(plan_stats(self.run, self.params), self.store == "plans")

    @cached_property
    def plans(self) -> DataFrame:
        return identify(self.plan_stats, self.run, self.params)

    @cached_property
    def groups(self) -> DataFrame:
        return self._keep(group_stats(self.plans, self.params), self.store is not None)

    @cached_property
    def compared(self) -> DataFrame:
        """All groups of both sides, regressed or not."""
        return compare(self.groups, self.params, self.run.end_fallback)

    @cached_property
    def regressions(self) -> DataFrame:
        return regressed(self.compared, self.params)

    @cached_property
    def multi_plan_regressions(self) -> DataFrame:
        return self._keep(self.regressions.where(IS_MULTI_PLAN), self.store is not None)

    @cached_property
    def regressed_groups(self) -> DataFrame:
        return group_names(self.regressions)

    @cached_property
    def pairs(self) -> DataFrame:
        """Dominant plans of all groups; group rows carry their best plan."""
        return dominant_pairs(self.groups)

    @cached_property
    def multi_plan_pairs(self) -> DataFrame:
        keys = group_names(self.multi_plan_regressions)
        return self._keep(multi_plan_dominant(self.groups, keys), self.store is not None)

    @cached_property
    def multi_plan_rows(self) -> DataFrame:
        keys = group_names(self.multi_plan_regressions)
        return self._keep(multi_plan_rows(self.plans, keys), self.store is not None)

    @cached_property
    def indicators(self) -> DataFrame:
        return plan_indicators(pair_members(self.multi_plan_pairs), self.run.plan, self.params, self.engine)

    def overview(self) -> DataFrame:
        """Result set 1."""
        return reports.overview(self.regressions, self.pairs, self.params)

    def summary(self) -> DataFrame:
        """Result set 2."""
        return reports.summary(self.regressions, self.params, self.sides)

    def drilldown(self) -> DataFrame:
        """Result set 3."""
        return reports.drilldown(multi_plan_detail(self.multi_plan_rows, self.run.plan, self.params), self.sides)

    def shape_report(self) -> DataFrame:
        """Result set 4."""
        found = shape_diff(self.multi_plan_regressions, self.multi_plan_pairs, self.indicators)
        return reports.shape_report(found, self.sides)

    def result_rows(self) -> DataFrame:
        """Rows for :mod:`driftscope.plans.persist`."""
        return reports.result_rows(self.regressions, self.pairs, self.params, self.sides)

    def timed(self, steps: Steps) -> Comparison:
        """Compute and store the intermediates one after another, timing each."""
        start = dt.datetime.now()
        _ = self.sides
        steps.note("resolve sides", start)
        start = dt.datetime.now()
        _ = self.run.end_fallback
        steps.note("detect interval end", start)
        for name, attribute in (
            ("plan statistics", "plan_stats"),
            ("plans with text and names", "plans"),
            ("group statistics", "groups"),
            ("comparison", "compared"),
            ("regressed groups", "regressed_groups"),
            ("dominant pairs", "pairs"),
            ("plans of multi-plan groups", "multi_plan_rows"),
        ):
            setattr(self, attribute, steps.run(name, getattr(self, attribute)))
        return self
