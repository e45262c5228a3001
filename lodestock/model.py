"""Plan-time description of a catalogue: attributes, constraints, preferences, difficulty brackets."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

OPERATORS = (
    "lte", "gte", "eq", "eq_any", "neq", "in_set", "contains", "contains_all", "contains_any",
    "not_contains", "not_contains_any", "not_contains_all", "substring", "boolean", "range",
)
ATTRIBUTE_TYPES = ("numeric", "categorical", "set_valued", "boolean", "ordinal", "text")


# The fields of attributes and constraints are those of the configuration files and tables they are read from.


@dataclass
class AttributeSpec:
    name: str
    display_name: str = ""
    attr_type: str = "categorical"
    unit: str | None = None
    filterable: bool = True
    required: bool = False
    coverage_threshold: float = 0.0
    vocabulary: list[str] | None = None
    embedding_field: bool = False
    preference_eligible: bool = False
    preference_direction: str | None = None
    popularity_proxy: bool = False


@dataclass
class ConstraintSpec:
    name: str
    attribute: str
    operator: str
    display_template: str = "{value}"
    value_type: str = "str"
    sampling_values: list[Any] = field(default_factory=list)
    sampling_probability: float = 0.5
    always_include: bool = False
    desc_constraint: bool = False
    demotable: bool = False
    soft_direction: str | None = None

    def __post_init__(self):
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator {self.operator!r} of constraint {self.name!r}")

    def label(self, value: Any) -> str:
        return self.display_template.format(value=value)


@dataclass
class Preference:
    attribute: str
    direction: str = "maximize"
    target: str | None = None
    priority: int = 99
    revelation_mode: str = "responsive"
    trigger: str | None = None


@dataclass
class Bracket:
    tier: str
    lo: int
    hi: int
    min_constraints: int = 0
    desc_probability: float = 0.0
    target: int = 0


@dataclass
class Trigger:
    name: str
    keys: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)


@dataclass
class Domain:
    """A catalogue with its registry. ``is_coherent`` judges a set of constraints before anything is scanned."""

    name: str
    id_column: str
    attributes: list[AttributeSpec] = field(default_factory=list)
    constraints: list[ConstraintSpec] = field(default_factory=list)
    triggers: list[Trigger] = field(default_factory=list)
    brackets: list[Bracket] = field(default_factory=list)
    is_coherent: Callable[[dict], bool] | None = None

    def constraint(self, name: str) -> ConstraintSpec | None:
        return next((c for c in self.constraints if c.name == name), None)

    def attribute(self, name: str) -> AttributeSpec | None:
        return next((a for a in self.attributes if a.name == name), None)

    def popularity(self) -> str | None:
        """The attribute that stands for popularity, the first so marked."""
        return next((a.name for a in self.attributes if a.popularity_proxy), None)

    def embedding_columns(self) -> list[str]:
        """Attributes whose text goes into a product's embedding."""
        return [a.name for a in self.attributes if a.embedding_field]

    def demoted(self, constraints: dict[str, Any]) -> tuple[dict[str, Any], list[Preference]]:
        """(constraints that stay, preferences made of those that may be softened), priorities in the registry's order."""
        soft = [c for c in self.constraints if c.demotable and c.name in constraints]
        made = [Preference(c.attribute, c.soft_direction or "match", None if c.soft_direction else str(constraints[c.name]), i) for i, c in enumerate(soft, 1)]
        return {k: v for k, v in constraints.items() if k not in {c.name for c in soft}}, made

    def check(self, catalog: DataFrame) -> list[str]:
        """Columns the registry names that the catalogue lacks."""
        named = {self.id_column, *(a.name for a in self.attributes), *(c.attribute for c in self.constraints if not c.desc_constraint)}
        return sorted(named - set(catalog.columns))

    def save(self, path: str | Path) -> None:
        data = {k: v for k, v in asdict(self).items() if k != "is_coherent"}
        Path(path).write_text(json.dumps(data, indent=2, ensure_ascii=False))

    @classmethod
    def load(cls, path: str | Path) -> Domain:
        data = json.loads(Path(path).read_text())
        kinds = {"attributes": AttributeSpec, "constraints": ConstraintSpec, "triggers": Trigger, "brackets": Bracket}
        return cls(**{k: [kinds[k](**x) for x in v] if k in kinds else v for k, v in data.items()})
