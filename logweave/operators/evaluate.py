"""Evaluation of clusters against templates or known classes."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of all parts of the templates that go to every task as one automaton; characters of the grams that more are found by.
AUTOMATON, GRAM = 1 << 25, 4


def _candidates(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """``(line_id, template_id, parts, size)`` of the pairs that share the template's rarest gram, and so all pairs that fit.

    A gram is ``GRAM`` characters of a part, or the part if it is shorter; rare is what few
    templates have. A template without characters fits every line, and of several of these
    the first stands for all.
    """
    grams = F.flatten(F.transform("parts", lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - GRAM + 1, F.lit(1))), lambda i: F.substring(p, i, GRAM))))
    own = templates.where("size > 0").select("template_id", "parts", "size", F.explode(F.array_distinct(grams)).alias("gram")).where("gram != ''")
    rare = own.groupBy("gram").agg(F.count("*").alias("n"))
    keys = own.join(rare, "gram").groupBy("template_id").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    keyed = templates.join(keys, "template_id").select("gram", "template_id", "parts", "size")
    pieces = F.concat(*[F.transform(F.filter(F.sequence(F.lit(1), F.length("line")), _fits(q)), _gram_at(q)) for q in range(1, GRAM + 1)])
    met = lines.where(F.length("line") > 0).select("line_id", F.explode(F.array_distinct(pieces)).alias("gram")).join(keyed, "gram").drop("gram")
    free = templates.where("size = 0").agg(F.min_by(F.struct("template_id", "parts", "size"), "template_id").alias("t")).where("t IS NOT NULL").select("t.*")
    return met.unionByName(lines.select("line_id").crossJoin(F.broadcast(free)))


def _fits(q: int) -> Callable[[Column], Column]:
    return lambda i: i <= F.length("line") - (q - 1)


def _gram_at(q: int) -> Callable[[Column], Column]:
    return lambda i: F.substring("line", i, F.lit(q))


class Templates:
    """Templates behind one automaton over all their parts, which a line passes once.

    A template is looked at where its rarest part is found, rare being what few templates
    have; it fits if all its other parts are found too.
    """

    def __init__(self, rows: list[tuple[int, list[str]]]):
        self.rows = sorted((i, frozenset(p for p in parts if p), sum(map(len, parts))) for i, parts in rows)
        self.common = Counter(p for _, parts, _ in self.rows for p in parts)
        self.free = [n for n, (_, parts, _) in enumerate(self.rows) if not parts]
        self.of: dict[str, list[int]] = {}
        for n, (_, parts, _) in enumerate(self.rows):
            if parts:
                self.of.setdefault(min(parts, key=lambda p: (self.common[p], p)), []).append(n)

    @functools.cached_property
    def automaton(self) -> ahocorasick.Automaton | None:
        out = ahocorasick.Automaton()
        for p in self.common:
            out.add_word(p, p)
        out.make_automaton()
        return out if self.common else None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}  # each task builds it once

    def best(self, line: str | None) -> int | None:
        """Of the templates that fit the first one if its parts include all parts of the others, else the one with the most characters, of equals the first."""
        if line is None:
            return None
        found = {p for _, p in self.automaton.iter(line)} if self.automaton else set()
        fits = sorted([*self.free, *(n for p in found for n in self.of.get(p, ()) if self.rows[n][1] <= found)])
        if not fits:
            return None
        own = [self.rows[n] for n in fits]
        if all(parts <= own[0][1] for _, parts, _ in own):
            return own[0][0]
        return min(own, key=lambda t: (-t[2], t[0]))[0]


def template_match(lines: DataFrame, templates: DataFrame, strict: bool = True, most: int = AUTOMATON) -> DataFrame:
    """``(line_id, template_id)``: the template of each line among ``templates(template_id, parts)``.

    A template fits if all its parts stand in the line. Of several that fit, the first one
    is taken if its parts include all parts of the others, else the one with the most
    characters, of equals the first. A line that none fits raises an error if ``strict``,
    else it gets null; a null line fits none.

    Templates of up to ``most`` characters go to the tasks as one automaton, and lines are
    read once, where they are. More templates are found by the grams of their rarest ones, in a join.
    """
    templates = templates.withColumn("size", F.aggregate("parts", F.lit(0), lambda a, p: a + F.length(p)))
    if (templates.agg(F.sum(F.col("size") + 1)).first()[0] or 0) <= most:
        known = Templates([(r["template_id"], r["parts"]) for r in templates.select("template_id", "parts").collect()])
        kind = templates.schema["template_id"].dataType

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                best = [known.best(line) for line in b["line"]]
                unknown = [line if n is None else None for n, line in zip(best, b["line"])]
                yield pd.DataFrame({"line_id": b["line_id"], "template_id": pd.array(best, "Int64"), "line": unknown})

        found = lines.select("line_id", "line").mapInPandas(run, "line_id long, template_id long, line string")
        best = F.col("template_id").cast(kind)
    else:
        fit = F.forall("parts", lambda p: F.contains("line", p))
        near = _candidates(lines.select("line_id", "line"), templates).join(lines.select("line_id", "line"), "line_id").where(fit).drop("line")
        found = lines.join(near, "line_id", "left").groupBy("line_id").agg(
            F.min_by(F.struct("template_id", "parts"), "template_id").alias("first"),
            F.min_by("template_id", F.struct(-F.col("size"), "template_id")).alias("longest"),
            F.array_distinct(F.flatten(F.collect_set("parts"))).alias("all"),
            F.min("line").alias("line"),
        )
        best = F.when(F.size(F.array_except("all", "first.parts")) == 0, F.col("first.template_id")).otherwise(F.col("longest"))
    if strict:
        best = F.coalesce(best, F.raise_error(F.concat(F.lit("no template for line: "), F.coalesce("line", F.lit("null")))).cast("int"))
    return found.select("line_id", best.alias("template_id"))


def unmatched(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """Lines without a template; an integrity check expects none."""
    return lines.join(template_match(lines, templates, strict=False).where("template_id IS NOT NULL"), "line_id", "left_anti")


def groups(assigned: DataFrame, by: str) -> DataFrame:
    """``(by, line_ids)``: the rows of each class, sorted."""
    return assigned.groupBy(by).agg(F.array_sort(F.collect_list("line_id")).alias("line_ids"))


def line_indices(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """``(line, line_id)``: where the wanted lines stand among the lines."""
    return wanted.select("line").distinct().join(lines, "line").select("line", "line_id")


def contingency(rows: DataFrame, truth: str, found: str) -> DataFrame:
    """``(truth, found, n)``; rows that were not assigned form a class of their own."""
    found = F.struct(F.col(found).isNull().alias("unassigned"), F.coalesce(F.col(found).cast("string"), F.lit("")).alias("name"))
    return rows.groupBy(F.col(truth).alias("truth"), found.alias("found")).agg(F.count("*").alias("n"))


def parsing_accuracy(rows: DataFrame, truth: str = "truth", found: str = "found") -> DataFrame:
    """``(parsing_accuracy)``: the share of rows in found classes that are, as sets, classes of the truth."""
    n = contingency(rows.where(F.col(found).isNotNull()), truth, found)
    whole = rows.groupBy(F.col(truth).alias("truth")).agg(F.count("*").alias("n_truth"))
    of_found = n.groupBy("found").agg(F.sum("n").alias("n_found"))
    same = n.join(whole, "truth").join(of_found, "found").where((F.col("n") == F.col("n_truth")) & (F.col("n") == F.col("n_found")))
    total = rows.agg(F.count("*").alias("total"))
    return same.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hit")).crossJoin(total).select((F.col("hit") / F.col("total")).alias("parsing_accuracy"))


def _pairs(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("double")


def adjusted_rand_index(rows: DataFrame, truth: str = "truth", found: str = "found") -> DataFrame:
    """``(adjusted_rand_index)`` from the contingency counts; 1 where both sides have no pairs to tell apart."""
    n = contingency(rows, truth, found)
    total = n.agg(F.sum(_pairs(F.col("n"))).alias("both"), _pairs(F.sum("n")).alias("all"))
    a = n.groupBy("truth").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("a"))
    b = n.groupBy("found").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("b"))
    row = total.crossJoin(a).crossJoin(b)
    expected, most = F.col("a") * F.col("b") / F.col("all"), (F.col("a") + F.col("b")) / 2
    return row.select(F.when((F.col("all") == 0) | (most == expected), F.lit(1.0)).otherwise((F.col("both") - expected) / (most - expected)).alias("adjusted_rand_index"))


def best_with_time(results: DataFrame, metric: str) -> DataFrame:
    """``(algo, log, value, time)``: the best value of a metric over an algorithm's parameters and its time, of equals the first run.

    ``results(algo, log, run, metric, value)`` has a row for each metric of each run, its time under "time".
    """
    times = results.where("metric = 'time'").select("algo", "log", "run", F.col("value").alias("time"))
    rows = results.where(F.col("metric") == metric).join(times, ["algo", "log", "run"], "left")
    best = rows.groupBy("algo", "log").agg(F.max_by(F.struct("value", "time"), F.struct("value", -F.col("run"))).alias("b"))
    return best.select("algo", "log", F.when(F.col("b.value") > -1, F.col("b.value")).otherwise(-1.0).alias("value"), F.when(F.col("b.value") > -1, F.col("b.time")).alias("time"))


def project_metric(results: DataFrame, metric: str) -> DataFrame:
    """``(algo, log, value)``: the best value of a metric, or for "time" the time of the best adjusted rand index."""
    best = best_with_time(results, "adjusted rand index" if metric == "time" else metric)
    return best.select("algo", "log", F.col("time" if metric == "time" else "value").alias("value"))


def log_order(results: DataFrame, algo: str, metric: str) -> DataFrame:
    """``(place, log, value)``: logs by their value; of logs with one value the last by name stays."""
    rows = project_metric(results, metric).where(F.col("algo") == algo).groupBy("value").agg(F.max("log").alias("log"))
    return rows.select((F.row_number().over(Window.orderBy("value")) - 1).alias("place"), "log", "value")
