"""Checks of dated spans: their order, overlaps, gaps, and the tense in which they are told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import wording as W


def chronology(spans: DataFrame, today: Column) -> DataFrame:
    """spans (owner, id, start, stop, place) with errors, covered_days and gap_days.

    stop is null for a span that goes on; place is its place in the telling, newest first.
    errors: reversed (it stops before it starts), future (it starts after today), order (one
    told before it starts earlier), overlap (it starts before another of its owner, which
    starts no later, has stopped).  A sweep over the spans of an owner in order of start keeps
    the latest stop so far: gap_days is how long nothing had gone on before the span, and
    covered_days what it shares with earlier ones.  The spans of one owner are sorted in one
    task, which holds one row at a time.
    """
    ends = F.coalesce("stop", F.greatest(today, F.col("start")))
    sweep = Window.partitionBy("owner").orderBy("start", ends, "id").rowsBetween(Window.unboundedPreceding, -1)
    told = Window.partitionBy("owner").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.withColumn("_ends", ends).withColumn("_latest", F.max("_ends").over(sweep)).withColumn("_oldest", F.min("start").over(told))
    tests = {"reversed": F.col("stop") < F.col("start"), "future": F.col("start") > today, "order": F.col("start") > F.col("_oldest"), "overlap": F.col("start") < F.col("_latest")}
    errors = F.filter(F.array(*[F.when(test, name) for name, test in tests.items()]), lambda x: x.isNotNull())
    shared = F.when(F.col("_latest").isNotNull(), F.greatest(F.lit(0), F.datediff(F.least("_latest", "_ends"), F.col("start"))))
    return rows.select(*spans.columns, errors.alias("errors"), F.coalesce(shared, F.lit(0)).alias("covered_days"), F.greatest(F.lit(0), F.coalesce(F.datediff("start", "_latest"), F.lit(0))).alias("gap_days"))


def wrong_tense(text: Column, over: Column, present: list[str], past: list[str]) -> Column:
    """present where what is over is told in the present, past where what goes on is told in the past alone; null else.

    present and past are forms in lower case, with their accents: those tell the tenses apart.
    """
    now, then = F.lower(text).rlike(W.any_of(present)), F.lower(text).rlike(W.any_of(past))
    return F.when(over & now, "present").when(~over & then & ~now, "past")
