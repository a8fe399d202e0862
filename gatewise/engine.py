"""The engine: queries over uncertain facts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .operators import certain, circuit, explain, probability, strings
from .plans import algebra, sparql
from .plans.planner import FACTORED, FLAT, Planner
from .sources import formats, reification


@dataclass(frozen=True)
class Config:
    """``mode``: factored or flat blocks.  ``compile_mode``: per-root or shared."""

    mode: str = FACTORED
    compile_mode: str = "per-root"
    unbound_paths: bool = False
    restrict: bool = True
    node_limit: int = 2_000_000
    worlds: int = 8
    settle: bool = True

    def __post_init__(self) -> None:
        if self.mode not in (FLAT, FACTORED):
            raise ValueError(f"mode {self.mode!r}")


class Engine:
    """Over ``facts(token, s, p, o)``; see ``sources`` for ways to get them.  Facts with blank nodes are refused."""

    def __init__(self, facts: DataFrame, config: Config = Config()):
        self.facts, self.config, self._checked = facts, config, False

    @classmethod
    def open(cls, spark: SparkSession, path: str, scheme: str, config: Config = Config()) -> Engine:
        return cls(reification.facts(formats.load(spark, path), scheme), config)

    def planner(self) -> Planner:
        if not self._checked:
            formats.refuse_blank_nodes(self.facts.select("s", "p", "o"))
            self._checked = True
        c = self.config
        return Planner(self.facts, c.mode, c.unbound_paths, c.restrict, c.settle)

    def circuit(self, query: str) -> circuit.Circuit:
        """The circuit of all possible answers, lazily."""
        return self.planner().circuit(sparql.parse(query))

    def probabilities(self, query: str, probs: DataFrame) -> DataFrame:
        """Each possible answer with its exact probability."""
        return probability.probabilities(self.circuit(query), probs, self.config.compile_mode, self.config.node_limit, self.config.worlds)

    def shapley(self, query: str) -> DataFrame:
        return explain.shapley(self.circuit(query).settle(), self.config.node_limit)

    def why_not(self, query: str) -> DataFrame:
        return explain.why_not(self.circuit(query).settle())

    def provenance_strings(self, query: str) -> DataFrame:
        return strings.provenance_strings(self.planner(), sparql.parse(query))

    def certain(self, query: str) -> DataFrame:
        """Answers if every fact holds."""
        return certain.answers(self.planner(), sparql.parse(query))

    @staticmethod
    def parses(query: str) -> bool:
        return sparql.parses(query)


UnsupportedFeature = algebra.UnsupportedFeature
