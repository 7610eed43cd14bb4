"""The layers most queries start from.

``*_plan`` are lazy all the way from the source tables. ``bronze``, ``silver``
and the scores are written once per application and folder, as layer tables are
meant to be, because many queries and several branches of one query read them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame

from stayscope.operators import extract, quality
from stayscope.plans import sofa
from stayscope.session import written_table
from stayscope.sources.driver_views import ClinicalViews


class Layers:
    def __init__(self, views: ClinicalViews):
        self.views = views
        self.spark = views.spark
        self._tables: dict[str, DataFrame] = {}
        self.models: dict = {}

    @cached_property
    def bronze_chart(self) -> DataFrame:
        v = self.views
        return extract.bronze_chart(v.chartevents, v.d_items, v.catalog)

    @cached_property
    def bronze_lab(self) -> DataFrame:
        v = self.views
        return extract.bronze_lab(v.labevents, v.d_labitems, v.stays, v.catalog)

    @cached_property
    def bronze_output(self) -> DataFrame:
        v = self.views
        return extract.bronze_output(v.outputevents, v.d_items, v.catalog)

    @cached_property
    def bronze_input(self) -> DataFrame:
        v = self.views
        return extract.bronze_input(v.inputevents, v.d_items, v.catalog)

    @cached_property
    def bronze_unflagged(self) -> DataFrame:
        return extract.build_bronze([self.bronze_chart, self.bronze_lab, self.bronze_output, self.bronze_input])

    @cached_property
    def rules(self) -> DataFrame:
        return quality.unit_rules(self.spark)

    @property
    def bronze_plan(self) -> DataFrame:
        return quality.finish_bronze(self.bronze_unflagged, self.views.concept_map)

    @property
    def silver_plan(self) -> DataFrame:
        return quality.build_silver(self.bronze_plan, self.views.concept_map, self.rules)

    @property
    def sofa_plan(self) -> DataFrame:
        return sofa.sofa_scores(self.silver, "enhanced")

    def written(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The layer as a table, written on first use and shared by all its readers."""
        if name not in self._tables:
            self._tables[name] = written_table(build(), name)
        return self._tables[name]

    def plan_of(self, layer: str) -> DataFrame:
        """One layer's step, reading the written layer before it."""
        if layer == "bronze":
            return self.bronze_plan
        if layer == "silver":
            return quality.build_silver(self.bronze, self.views.concept_map, self.rules)
        return self.sofa_plan

    @property
    def bronze(self) -> DataFrame:
        return self.written("bronze", lambda: self.plan_of("bronze"))

    @property
    def silver(self) -> DataFrame:
        return self.written("silver", lambda: self.plan_of("silver"))

    @property
    def sofa(self) -> DataFrame:
        return self.written("sofa_enhanced", lambda: self.plan_of("sofa"))

    @property
    def sofa_by_table(self) -> DataFrame:
        return self.written("sofa_table", lambda: sofa.sofa_scores(self.silver, "table"))
