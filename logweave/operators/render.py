"""HTML of lines and clusters, in DataFrame operations; a document as one string is for what one file is to hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.storage import settled
from logweave.sources.documents import Section
from logweave.sources.lines import dense

#: Rows of a legend of colours that may be broadcast.
COLOURS = 100_000
#: How a line is shown, as a column of its number and its text.
Show = Callable[[Column, Column], Column]


def escaped(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def hue(i: Column, n: Column, saturation: str = "80%", lightness: str = "40%") -> Column:
    """The i-th of n colours around the wheel."""
    return F.format_string(f"hsl(%d, {saturation.replace('%', '%%')}, {lightness.replace('%', '%%')})", F.floor(360 * (i / n)))


def html_colors(numbers: DataFrame, n: str = "n") -> DataFrame:
    """``numbers`` with a row for each of their first ``n`` colours: ``(i, color)``; ``n`` is to be positive."""
    rows = numbers.where(F.col(n) > 0).withColumn("i", F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1)))
    return rows.withColumn("color", hue(F.col("i"), F.col(n)))


def values_to_colors(rows: DataFrame, value: str) -> DataFrame:
    """``(value, i, color)``: a colour for each distinct value, in the order of the values.

    Distinct values are sorted by ranges; a value's rank is its place in its range plus the
    sizes of the ranges before, so no task has all of them.
    """
    distinct = settled(rows.select(value).where(F.col(value).isNotNull()).distinct().orderBy(value))
    return dense(distinct, "i").select(value, F.col("i").cast("int").alias("i"), hue(F.col("i"), F.lit(distinct.count())).alias("color"))


def font(color: Column, label: Column) -> Column:
    return F.concat(F.lit("<font style='color:"), color, F.lit("'>"), label, F.lit("</font>"))


def row_html(clusters: DataFrame, fmt: str = "%3d") -> DataFrame:
    """``(line_id, row_html)``: each row's number in the colour of its cluster, plain where it has none."""
    colors = values_to_colors(clusters, "cluster_id")
    label = F.format_string(fmt, "line_id")
    colors = settled(colors)
    joined = clusters.join(F.broadcast(colors) if colors.limit(COLOURS + 1).count() <= COLOURS else colors, "cluster_id", "left")
    return joined.select("line_id", F.when(F.col("color").isNotNull(), font(F.col("color"), label)).otherwise(label).alias("row_html"))


def document(rows: DataFrame, text: str, by: str = "line_id", join: str = "<br/>") -> DataFrame:
    """``(html)``: the texts in the order of their ids as one preformatted block."""
    found = rows.agg(F.array_sort(F.collect_list(F.struct(by, text))).alias("rows"))
    return found.select(F.concat(F.lit("<pre>"), F.array_join(F.transform("rows", lambda r: r[text]), join), F.lit("</pre>")).alias("html"))


def _text(line: Column, escape: bool) -> Column:
    return F.coalesce(escaped(line) if escape else line, F.lit(""))


def lines_html(lines: DataFrame, skip: Column | None = None, escape: bool = True, line_to_html: Show | None = None) -> DataFrame:
    """``(html)`` of lines; lines for which ``skip`` holds are left out.

    ``line_to_html`` makes a line's HTML of its number and text; by default it is the number and the text.
    """
    rows = lines if skip is None else lines.where(~skip)
    show = line_to_html or (lambda i, line: F.concat(F.format_string("%3d", i), F.lit(": "), _text(line, escape)))
    return document(rows.select("line_id", show(F.col("line_id"), F.col("line")).alias("row")), "row")


def _legend(clusters: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``(i, label)``: the clusters' names in their colours."""
    colors = values_to_colors(clusters, "cluster_id")
    label = F.concat(F.lit("Cluster "), F.col("i"))
    if names is not None:
        colors = colors.join(names.select("cluster_id", "name"), "cluster_id", "left")
        label = F.coalesce("name", label)
    return colors.select("i", font(F.col("color"), label).alias("label"))


def caption(clusters: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``(caption)``: the clusters' names in their colours, in the order of their ids; ``names(cluster_id, name)`` replaces the numbered ones."""
    rows = _legend(clusters, names).agg(F.array_sort(F.collect_list(F.struct("i", "label"))).alias("rows"))
    return rows.select(F.array_join(F.transform("rows", lambda r: r["label"]), "&nbsp;").alias("caption"))


def clustered_rows(lines: DataFrame, clusters: DataFrame, skip: Column | None = None, escape: bool = True, row_to_html: Show | None = None, line_to_html: Show | None = None) -> DataFrame:
    """``(line_id, row)``: the HTML of each line with its number in its cluster's colour; a table of any size.

    ``row_to_html`` makes what stands for the number, ``line_to_html`` what stands for the text.
    """
    rows = lines if skip is None else lines.where(~skip)
    text = line_to_html(F.col("line_id"), F.col("line")) if line_to_html else _text(F.col("line"), escape)
    if row_to_html:
        return rows.select("line_id", F.concat(row_to_html(F.col("line_id"), F.col("line")), F.lit(": "), text).alias("row"))
    marked = rows.join(row_html(clusters), "line_id", "left")
    return marked.select("line_id", F.concat(F.coalesce("row_html", F.format_string("%3d", "line_id")), F.lit(": "), text).alias("row"))


def clustered_html(
    lines: DataFrame,
    clusters: DataFrame,
    skip: Column | None = None,
    show_caption: bool = True,
    escape: bool = True,
    row_to_html: Show | None = None,
    line_to_html: Show | None = None,
    names: DataFrame | None = None,
) -> DataFrame:
    """``(html)``: a caption of clusters, then ``clustered_rows`` as one document."""
    body = document(clustered_rows(lines, clusters, skip, escape, row_to_html, line_to_html), "row")
    if not show_caption:
        return body
    return caption(clusters, names).crossJoin(body).select(F.concat("caption", "html").alias("html"))


def html_of(lines: DataFrame, clusters: DataFrame, show_caption: bool = True, head: str = "", tail: str = "", **hooks) -> list[Section]:
    """``clustered_html`` as sections of a document of any size; ``hooks`` are those of ``clustered_rows``, and ``names``."""
    names = hooks.pop("names", None)
    body = clustered_rows(lines, clusters, **hooks).select(F.col("line_id").alias("place"), F.col("row").alias("piece"))
    legend = [Section(_legend(clusters, names).select(F.col("i").alias("place"), F.col("label").alias("piece")), head, "&nbsp;")] if show_caption else []
    return [*legend, Section(body, "<pre>" if show_caption else head + "<pre>", "<br/>", "</pre>" + tail)]
