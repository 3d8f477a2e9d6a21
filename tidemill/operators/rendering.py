"""Text forms of small tables: an escaped HTML digest and Markdown reports, rendered by Spark a line per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escaped(text: Column) -> Column:
    """text for HTML."""
    for sign, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(reference))
    return text


def section_html(rows: DataFrame, section: str, order: list[Column], title: Column, link: Column) -> DataFrame:
    """section, html of rows: one list per section, items in order, texts escaped; a link that is not http(s) is left out."""
    ranked = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], title.alias("title"), link.alias("link"))
    item = lambda x: F.when(x["link"].rlike(r"(?i)^https?://[^/]+"), F.concat(F.lit('<li><a href="'), escaped(x["link"]), F.lit('">'), escaped(x["title"]), F.lit("</a></li>"))).otherwise(F.concat(F.lit("<li>"), escaped(x["title"]), F.lit("</li>")))
    lists = rows.groupBy(section).agg(F.sort_array(F.collect_list(ranked)).alias("items"))
    return lists.select(section, F.concat(F.lit("<h2>"), escaped(F.col(section)), F.lit("</h2><ul>"), F.array_join(F.transform("items", item), ""), F.lit("</ul>")).alias("html"))


def markdown_row(*cells: Column) -> Column:
    """A row of a Markdown table; bars and line ends in cells are escaped."""
    clean = [F.regexp_replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ") for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *clean), F.lit(" |"))


def evidence_lines(told: Column, most: int = 3) -> Column:
    """told (field, said) as lines of a sentence and its fields: sentences in the order of their first field, most at most; what was not said is left out."""
    known = F.filter(told, lambda x: x["said"].isNotNull())
    sentences = F.slice(F.array_distinct(F.transform(known, lambda x: x["said"])), 1, most)
    return F.transform(sentences, lambda s: F.concat(s, F.lit(": "), F.array_join(F.transform(F.filter(known, lambda x: x["said"] == s), lambda x: x["field"]), ", ")))
