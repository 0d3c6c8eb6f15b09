"""Pattern matches of lines as a relation ``(line_id, name, j, k)``: ``line[j:k]`` is matched by ``name``."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.patterns import REGEXES, PatternSet
from logweave.functions.regex_dfa import Dfa
from logweave.functions.scan import Found, scan, scan_delimited

MATCH = "line_id long, name string, j int, k int"
#: Lines and characters of an Arrow batch that are taken together; what is made of a line can be many times its size.
LINES, CHARACTERS = 1000, 1 << 16
#: Matches that are handed over together.
ROWS = 1 << 17


def pieces(batches: Iterator[pd.DataFrame], lines: int = LINES, characters: int = CHARACTERS) -> Iterator[pd.DataFrame]:
    """Batches of lines cut into pieces of so many lines, and of so many characters or one line."""
    for b in batches:
        size = np.cumsum([len(x) if x else 0 for x in b["line"]])
        begin = 0
        while begin < len(b):
            before = size[begin - 1] if begin else 0
            end = min(begin + lines, max(begin + 1, int(np.searchsorted(size, before + characters, "right"))))
            yield b.iloc[begin:end]
            begin = end


def _rows(b: pd.DataFrame, found: dict[str, Found]) -> Iterator[pd.DataFrame]:
    ids = b["line_id"].to_numpy()
    for name, (at, j, k) in found.items():
        for own in range(0, len(at), ROWS):
            part = slice(own, own + ROWS)
            yield pd.DataFrame({"line_id": ids[at[part]], "name": name, "j": j[part].astype(np.int32), "k": k[part].astype(np.int32)})


def _scanned(batches: Iterator[pd.DataFrame], dfas: dict[str, Dfa], strategy: str) -> Iterator[pd.DataFrame]:
    for b in pieces(batches):
        yield from _rows(b, scan(b["line"].tolist(), dfas, strategy))


def _emit(find: Callable[[str], list], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(i, *m) for i, line in zip(b["line_id"], b["line"]) if line for m in find(line)]
        yield pd.DataFrame(rows, columns=["line_id", "name", "j", "k"])


def matches(lines: DataFrame, patterns: PatternSet, strategy: str | Callable = "largest") -> DataFrame:
    """Matches of ``lines(line_id, line)`` by a strategy: all, largest, greedy, or a callable of (line, name, automaton).

    Lines are scanned in Arrow batches where they are read, all lines of a batch at a time;
    nothing is shuffled. Null and empty lines have no matches.
    """
    dfas = patterns.dfas()
    if isinstance(strategy, str):
        return lines.select("line_id", "line").mapInPandas(lambda batches: _scanned(batches, dfas, strategy), MATCH)
    search = lambda line: [m for name, dfa in dfas.items() for m in strategy(line, name, dfa)]
    return lines.select("line_id", "line").mapInPandas(lambda batches: _emit(search, batches), MATCH)


def delimited_matches(lines: DataFrame, patterns: PatternSet, separators: Iterable[str] = ("spaces",), free_left: Iterable[str] = (), free_right: Iterable[str] = (), strategy: str = "largest") -> DataFrame:
    """Matches that lie between matches of separator patterns or the ends of the line."""
    dfas, args = patterns.dfas(), (frozenset(separators), frozenset(free_left), frozenset(free_right), strategy)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches):
            yield from _rows(b, scan_delimited(b["line"].tolist(), dfas, *args))

    return lines.select("line_id", "line").mapInPandas(run, MATCH)


def reduced(found: DataFrame, strategy: str = "largest") -> DataFrame:
    """The largest or greedy reduction of all matches, as hash aggregations that combine before they shuffle."""
    if strategy == "greedy":
        found = found.groupBy("line_id", "name", "k").agg(F.min("j").alias("j"))
    ends = found.groupBy("line_id", "name", "j").agg(F.max("k").alias("k"))
    return ends.groupBy("line_id", "name", "k").agg(F.min("j").alias("j")).select("line_id", "name", "j", "k")


def with_text(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Matches with the matched text."""
    return found.join(lines.select("line_id", "line"), "line_id").select("line_id", "name", "j", "k", F.expr("substr(line, j + 1, k - j)").alias("text"))


def matched_texts(lines: DataFrame, patterns: PatternSet, strategy: str = "largest") -> DataFrame:
    """``(line_id, name, texts)`` as ``as_map`` has it for the matches of these lines, made where they are read; nothing is shuffled. Ids are to be distinct."""
    dfas = patterns.dfas()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches):
            ids, own = b["line_id"].to_numpy(), b["line"].tolist()
            for name, (at, j, k) in scan(own, dfas, strategy).items():
                if not len(at):
                    continue
                texts = [own[i][x:y] for i, x, y in zip(at.tolist(), j.tolist(), k.tolist())]
                there, first = np.unique(at, return_index=True)
                ends = [*first[1:].tolist(), len(at)]
                yield pd.DataFrame({"line_id": ids[there], "name": name, "texts": [texts[x:y] for x, y in zip(first.tolist(), ends)]})

    return lines.select("line_id", "line").mapInPandas(run, "line_id long, name string, texts array<string>")


def reports(lines: DataFrame, patterns: PatternSet, strategy: str = "largest") -> DataFrame:
    """``(line_id, report)`` as ``as_string`` has it for the matches of these lines, made where they are read; nothing is shuffled. Ids are to be distinct."""
    dfas = {name: dfa for name, dfa in sorted(patterns.dfas().items())}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches):
            own = b["line"].tolist()
            rows: list[list[str]] = [[] for _ in own]
            for name, (at, j, k) in scan(own, dfas, strategy).items():
                texts = [own[i][x:y] for i, x, y in zip(at.tolist(), j.tolist(), k.tolist())]
                there, first = np.unique(at, return_index=True)
                for i, x, y in zip(there.tolist(), first.tolist(), [*first[1:].tolist(), len(at)]):
                    rows[i].append(f"{name:<5}: ['" + "', '".join(texts[x:y]) + "']")
            kept = [i for i, r in enumerate(rows) if r]
            if kept:
                yield pd.DataFrame({"line_id": b["line_id"].to_numpy()[kept], "report": ["\n".join(rows[i]) for i in kept]})

    return lines.select("line_id", "line").mapInPandas(run, "line_id long, report string")


def as_map(lines: DataFrame, found: DataFrame) -> DataFrame:
    """``(line_id, name, texts)``: the matched texts of a pattern in a line, in order."""
    rows = with_text(lines, found).groupBy("line_id", "name").agg(F.array_sort(F.collect_list(F.struct("j", "k", "text"))).alias("m"))
    return rows.select("line_id", "name", F.transform("m", lambda x: x["text"]).alias("texts"))


def as_string(lines: DataFrame, found: DataFrame) -> DataFrame:
    """``(line_id, report)``: a line for each pattern, names padded to five characters."""
    rows = as_map(lines, found)
    row = F.concat(F.rpad("name", 5, " "), F.lit(": ['"), F.array_join("texts", "', '"), F.lit("']"))
    row = F.when(F.length("name") > 5, F.concat("name", F.substring(row, 6, 1 << 30))).otherwise(row)
    rows = rows.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("name", row.alias("row")))).alias("rows"))
    return rows.select("line_id", F.array_join(F.transform("rows", lambda x: x["row"]), "\n").alias("report"))


def java_regex(regex: str) -> str:
    """A regex of the dialect for Java: blanks are space and tab, all other printable characters are ``\\S``."""
    return regex.replace("\\S", "[!-~\\n\\r\\x0B\\f]").replace("\\s", "[ \\t]")


def accepted(words: DataFrame, patterns: PatternSet, word_col: str = "word") -> DataFrame:
    """``words`` with the names of the patterns that match the whole word; a null word has null.

    The known patterns are matched by built-in functions, others by their automata.
    """
    dfas = patterns.dfas()
    if not patterns.handmade_any and all(REGEXES.get(n) == r for n, r in patterns.regexes):
        word = F.col(word_col)
        names = F.array_compact(F.array(*[F.when(word.rlike(f"\\A(?:{java_regex(r)})\\z"), F.lit(n)) for n, r in patterns.regexes]))
        return words.withColumn("accepted", F.when(word.isNotNull(), names))

    @F.pandas_udf("array<string>")
    def run(own: pd.Series) -> pd.Series:
        return pd.Series([None if w is None else [n for n, d in dfas.items() if d.accepts(w)] for w in own], dtype=object)

    return words.withColumn("accepted", run(F.col(word_col)))
