"""Tools over a domain: named functions from arguments to DataFrames, with generic ones for any domain."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestock.model import Domain
from lodestock.operators import explore, search
from lodestock.operators.predicates import lookup
from lodestock.operators.resolve import coerce, resolve_constraints

#: JSON type of each declared value type.
JSON_TYPES = {"float": "number", "int": "integer", "bool": "boolean", "list[str]": "array", "str": "string"}


@dataclass
class Tool:
    name: str
    description: str
    run: Callable[..., DataFrame]
    schema: dict = field(default_factory=dict)


class ToolBox:
    """Tools of a domain by name; a plug-in of the same name replaces a generic tool."""

    def __init__(self, domain: Domain, catalog: DataFrame, plugins: list[Tool] = ()):
        self.domain, self.catalog = domain, catalog
        self.tools = {t.name: t for t in [*self._generic(), *plugins]}

    def __call__(self, tool: str, /, **arguments) -> DataFrame:
        if tool not in self.tools:
            raise KeyError(f"no tool {tool!r}; there are {sorted(self.tools)}")
        return self.tools[tool].run(**arguments)

    def _generic(self) -> list[Tool]:
        d, df = self.domain, self.catalog
        words = {c.name: d.attribute(c.attribute).vocabulary for c in d.constraints if d.attribute(c.attribute) and d.attribute(c.attribute).vocabulary}

        def filter_items(sort_by: str | None = None, descending: bool = False, limit: int = 30, **constraints) -> DataFrame:
            known = {k: coerce(v, d.constraint(k).value_type) for k, v in constraints.items() if d.constraint(k) and v is not None}
            resolved, _ = resolve_constraints(known, words)
            return explore.filter_sort_limit(df, resolved, d.constraints, d.id_column, sort_by, descending, limit)

        def search_items(query: str, top_k: int = 10) -> DataFrame:
            texts = [a.name for a in d.attributes if a.attr_type in ("text", "categorical", "set_valued")]
            return search.top(search.keyword_by_token(df, query, texts), d.id_column, min(max(1, top_k), 30))

        def get_item(item_id) -> DataFrame:
            return explore.details(lookup(df, d.id_column, item_id), d.id_column, [c for c in df.columns if not c.startswith("_")])

        def list_filter_values(name: str, limit: int = 30) -> DataFrame:
            spec = d.constraint(name)
            return explore.list_values(df, spec.attribute if spec else name, limit)

        def recommend(item_ids: list) -> DataFrame:
            return df.sparkSession.createDataFrame([(i, str(x)) for i, x in enumerate(item_ids, 1)], "pos long, pid string")

        def declare_infeasible(reason: str = "") -> DataFrame:
            return df.sparkSession.createDataFrame([(reason,)], "reason string")

        properties = {c.name: {"type": JSON_TYPES.get(c.value_type, "string")} for c in d.constraints if not c.desc_constraint}
        return [
            Tool("filter_items", "Items that satisfy constraints", filter_items, {"type": "object", "properties": properties}),
            Tool("search_items", "Items by keywords", search_items, {"type": "object", "properties": {"query": {"type": "string"}}, "required": ["query"]}),
            Tool("get_item", "Details of an item", get_item, {"type": "object", "properties": {"item_id": {"type": "string"}}, "required": ["item_id"]}),
            Tool("list_filter_values", "Values of a filter with counts", list_filter_values, {"type": "object", "properties": {"name": {"type": "string"}}}),
            Tool("recommend", "Ends with recommended items", recommend, {"type": "object", "properties": {"item_ids": {"type": "array"}}}),
            Tool("declare_infeasible", "Ends by saying nothing fits", declare_infeasible, {"type": "object", "properties": {"reason": {"type": "string"}}}),
        ]

    def filters(self) -> DataFrame:
        """(name, attribute, operator, value_type) of the registered constraints."""
        rows = [(c.name, c.attribute, c.operator, c.value_type) for c in self.domain.constraints]
        return self.catalog.sparkSession.createDataFrame(rows, "name string, attribute string, operator string, value_type string").orderBy(F.col("name"))
