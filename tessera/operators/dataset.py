"""A feature dataset: formulas and a label over a panel, periods, membership, and chains of processors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import nan
from tessera.operators.relational import in_range, member_filter
from tessera.plans.formula import evaluate

Processor = Callable[[DataFrame], DataFrame]


class Segment(Enum):
    TRAIN = "train"
    VALID = "valid"
    TEST = "test"


@dataclass
class Dataset:
    """``periods`` gives each segment's first and last day, both included. With ``process_type`` append, the learning chain
    starts from what the inference chain made, else from the raw features."""

    panel: DataFrame
    periods: dict[Segment, tuple[str, str]]
    process_type: str = "append"
    formulas: dict[str, str | Column] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    label: str | None = None
    chains: dict[str, list[Processor]] = field(default_factory=lambda: {"infer": [], "learn": []})
    raw: DataFrame | None = None

    def add_feature(self, name: str, formula: str | Column | None = None, table: DataFrame | None = None) -> Dataset:
        """A feature by formula, or ready-made as ``table(datetime, vt_symbol, <name>)``."""
        if (formula is None) == (table is None):
            raise ValueError("give a formula or a table")
        if table is not None:
            self.tables[name] = table
        else:
            self.formulas[name] = formula
        return self

    def set_label(self, formula: str) -> Dataset:
        self.label = formula
        return self

    def add_processor(self, chain: str, processor: Processor) -> Dataset:
        self.chains["infer" if chain == "infer" else "learn"].append(processor)
        return self

    @property
    def features(self) -> list[str]:
        return [*self.formulas, *self.tables]

    def prepare(self, members: DataFrame | None = None) -> DataFrame:
        """``(datetime, vt_symbol, features…, label)``, missing values as NaN, only rows of members if given."""
        wanted = dict(self.formulas) | ({"label": self.label} if self.label else {})
        out = evaluate(self.panel, wanted, keep=("datetime", "vt_symbol"))
        for name, table in self.tables.items():
            out = out.join(table.select("datetime", "vt_symbol", name), ["datetime", "vt_symbol"], "left")
        columns = self.features + (["label"] if self.label else [])
        out = out.select("datetime", "vt_symbol", *(F.coalesce(F.col(c), nan()).alias(c) for c in columns))
        self.raw = member_filter(out, members) if members is not None else out
        return self.raw

    def _chain(self, chain: str) -> DataFrame:
        out = self.raw if self.raw is not None else self.prepare()
        chains = ["infer"] if chain == "infer" else ["infer", "learn"] if self.process_type == "append" else ["learn"]
        for name in chains:
            for processor in self.chains[name]:
                out = processor(out)
        return out

    def fetch_raw(self, segment: Segment) -> DataFrame:
        return in_range(self.raw if self.raw is not None else self.prepare(), *self.periods[segment])

    def fetch_infer(self, segment: Segment) -> DataFrame:
        return in_range(self._chain("infer"), *self.periods[segment])

    def fetch_learn(self, segment: Segment) -> DataFrame:
        return in_range(self._chain("learn"), *self.periods[segment])
