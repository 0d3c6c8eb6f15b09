"""Matches as a table function: ``SELECT ... FROM lines, LATERAL multi_grep(line, 'int,word')``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from logweave.functions.patterns import PatternSet
from logweave.functions.text import STRATEGIES


class MultiGrep:
    """A row (name, j, k) for each match of a line: ``line[j:k]`` is matched by ``name``.

    ``patterns`` are names of known patterns between commas, or a JSON object of names and
    regexes; ``strategy`` is one of ``STRATEGIES``. A null line or null patterns have no matches.
    """

    def __init__(self):
        self.known: dict[str, dict] = {}

    def eval(self, line: str, patterns: str, strategy: str = "largest") -> Iterator[tuple[str, int, int]]:
        if line is None or patterns is None:
            return
        if patterns not in self.known:
            own = PatternSet.from_json(patterns) if patterns.lstrip().startswith("{") else PatternSet.named(x.strip() for x in patterns.split(","))
            self.known[patterns] = own.dfas()
        for name, dfa in self.known[patterns].items():
            yield from STRATEGIES[strategy](line, name, dfa)


def register(spark: SparkSession) -> None:
    """Makes ``multi_grep(line, patterns[, strategy])`` known to the session's SQL."""
    spark.udtf.register("multi_grep", udtf(MultiGrep, returnType="name string, j int, k int", useArrow=True))


def grep(lines: DataFrame, patterns: PatternSet, strategy: str = "largest") -> DataFrame:
    """``(line_id, name, j, k)`` by the table function."""
    spark = lines.sparkSession
    register(spark)
    query = "SELECT l.line_id, m.name, m.j, m.k FROM {lines} l, LATERAL multi_grep(l.line, {patterns}, {strategy}) m"
    return spark.sql(query, lines=lines, patterns=patterns.to_json(), strategy=strategy)
