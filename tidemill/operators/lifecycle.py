"""Stateful rules as batch steps: closures, outages, archives, queues, inbox events, leads, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(closed_at: Column, published: Column, collected: Column, now: Column, days: int) -> Column:
    """Whether a posting is open and no older than days by its publication, else its collection."""
    return closed_at.isNull() & (F.coalesce(published, collected) >= now - F.make_dt_interval(F.lit(days)))


def to_check(rows: DataFrame, now: Column, hours: int) -> DataFrame:
    """The open rows (closed_at, checked_at) that were not checked within hours."""
    return rows.where(F.col("closed_at").isNull() & (F.col("checked_at").isNull() | (F.col("checked_at") <= now - F.make_dt_interval(F.lit(0), F.lit(hours)))))


def closures(answers: DataFrame, outages: DataFrame, least_checked: int, most_ratio: float) -> DataFrame:
    """answers (source, id, answer: open, closed, unknown, not_asked) with mark: closed, open or null.

    Rows that an outage (source, board; a null board is the whole source) covers are suspended;
    a source of whose answers too many say closed writes no mark at all.
    """
    known = answers.join(outages.select(F.col("source").alias("_s"), F.col("board").alias("_b")), (F.col("source") == F.col("_s")) & (F.col("_b").isNull() | F.col("id").startswith(F.concat("_b", F.lit(":")))), "left_semi").select("source", "id").distinct()
    asked = answers.join(known.withColumn("_covered", F.lit(True)), ["source", "id"], "left").withColumn("suspended", F.coalesce("_covered", F.lit(False))).drop("_covered")
    counts = asked.where(~F.col("suspended") & (F.col("answer") != "not_asked")).groupBy("source").agg(F.count("*").alias("checked"), F.count_if(F.col("answer") == "closed").alias("closed"))
    down = counts.where((F.col("checked") >= least_checked) & (F.col("closed") / F.col("checked") > most_ratio)).select("source", F.lit(True).alias("down"))
    marked = asked.join(F.broadcast(down), "source", "left")  # a row per source
    mark = F.when(~F.col("suspended") & F.col("down").isNull() & F.col("answer").isin("open", "closed"), F.col("answer"))
    return marked.select("source", "id", "answer", (F.col("suspended") | (F.coalesce("down", F.lit(False)) & (F.col("answer") == "closed"))).alias("suspended"), mark.alias("mark"))


def set_marks(rows: DataFrame, ids: DataFrame, **values: Column) -> DataFrame:
    """rows with the given columns set where id is among ids (id, each once)."""
    hit = ids.select("id", F.lit(True).alias("_hit"))
    return rows.join(hit, "id", "left").select(*[F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])


def outages(runs: DataFrame, n_runs: int, least_mean: float, most_failed: float, least_board: int) -> DataFrame:
    """source, run, kind, mean of runs (run, source, fetched, attempted, failed, board_now, board_before maps).

    Per source and run the first rule that fires: nothing fetched against a mean of the last
    runs, too many failed requests, boards that were alive and are empty.
    """
    before = Window.partitionBy("source").orderBy("run").rowsBetween(-n_runs, -1)
    rated = runs.withColumn("mean", F.avg("fetched").over(before)).withColumn("boards_before", F.lag("boards").over(Window.partitionBy("source").orderBy("run")))
    down = F.array_sort(F.map_keys(F.map_filter("boards", lambda b, n: (n == 0) & (F.coalesce(F.try_element_at(F.col("boards_before"), b), F.lit(0)) >= least_board))))
    rated = rated.withColumn("down", F.coalesce(down, F.array().cast("array<string>")))
    kind = F.when((F.col("fetched") == 0) & (F.col("mean") >= least_mean), "no_results").when(F.try_divide("failed", "attempted") > most_failed, "requests_failed").when(F.size("down") > 0, "board_empty")
    return rated.withColumn("kind", kind).where("kind IS NOT NULL").select("source", "run", "kind", F.round("mean", 4).alias("mean"), F.when(F.col("kind") == "board_empty", F.col("down")).otherwise(F.array().cast("array<string>")).alias("boards"))


def reopened(closed: DataFrame, windows: DataFrame) -> DataFrame:
    """The rows of closed (id, source, closed_at) that were closed in a suspect window (source, start, stop; a null stop is six hours later)."""
    w = windows.select(F.col("source").alias("_s"), F.col("start").alias("_a"), F.coalesce("stop", F.col("start") + F.expr("INTERVAL 6 HOURS")).alias("_z"))
    return closed.join(w, (F.col("source") == F.col("_s")) & F.col("closed_at").between(F.col("_a"), F.col("_z")), "left_semi")


def archive_state(status: Column, closed: Column, kept: Column, published: Column, reactivated: Column, today: Column, keep_days: int = 15, post_days: int = 20) -> Column:
    """expired, kept, published or null: an application to send goes to the archive when it was kept, or posted, too long ago; reactivation counts anew."""
    since = F.datediff(today, F.coalesce(reactivated, kept))
    posted = F.when(reactivated.isNull(), F.datediff(today, published))
    return F.when(status == "to_apply", F.when(closed, "expired").when(since > keep_days, "kept").when(posted > post_days, "published"))


def queue_step(rows: DataFrame, now: Column, stuck_minutes: int, tries: int) -> DataFrame:
    """rows (state, started_at, attempts, error) one step on: a run that hangs and a first failure go back to pending, a second failure stays."""
    hangs = (F.col("state") == "running") & (F.col("started_at") <= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(stuck_minutes)))
    again = (F.col("state") == "failed") & (F.col("attempts") < tries)
    return rows.withColumn("next", F.when(hangs | again, "pending").otherwise(F.col("state")))


def within_budget(rows: DataFrame, keys: list[str], order: list[str], cost: str, cap: int) -> DataFrame:
    """The rows that a running sum of cost admits within cap per key, in order."""
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_spent", F.sum(cost).over(so_far)).where(F.col("_spent") <= cap).drop("_spent")


def apply_events(events: DataFrame, stored: DataFrame, least: float, kinds: list[str]) -> DataFrame:
    """events (message, at, kind, key, confidence) with action: applied or pending; one row per message, those stored already left out."""
    first = events.groupBy("message").agg(F.min_by(F.struct("at", "kind", "key", "confidence"), F.struct("at", "kind", "key")).alias("e")).select("message", "e.*")
    new = first.join(stored.select("message"), "message", "left_anti")
    sure = (F.col("confidence") >= least) & F.col("kind").isin(kinds) & F.col("key").isNotNull()
    return new.withColumn("action", F.when(F.coalesce(sure, F.lit(False)), "applied").otherwise("pending"))


def spaced(rows: DataFrame, key: str, at: str, days: int) -> DataFrame:
    """The rows of each key that come days or more after the one accepted before: a fold over the key's rows in order of at, then id.

    The rows of one key are a company's leads, few by nature; the fold keeps only (at, id) of each.
    """
    folded = F.aggregate(
        F.array_sort("_all"),
        F.struct(F.lit(None).cast("date").alias("last"), F.array().cast("array<bigint>").alias("kept")),
        lambda acc, x: F.when(acc["last"].isNull() | (F.datediff(x["at"], acc["last"]) >= days), F.struct(x["at"].alias("last"), F.concat(acc["kept"], F.array(x["id"])).alias("kept"))).otherwise(acc),
    )
    kept = rows.groupBy(key).agg(F.collect_list(F.struct(F.col(at).cast("date").alias("at"), F.col("id").cast("bigint").alias("id"))).alias("_all")).select(F.explode(folded["kept"]).alias("id"))
    return rows.join(kept, "id", "left_semi")


def synced(old: DataFrame, new: DataFrame) -> DataFrame:
    """canonical, duplicate, change of two tables of links: added, removed or kept; links of a row to itself are removed."""
    a = old.select("canonical", "duplicate", F.lit(True).alias("_old"))
    b = new.where("canonical <> duplicate").select("canonical", "duplicate", F.lit(True).alias("_new"))
    return a.join(b, ["canonical", "duplicate"], "full_outer").select("canonical", "duplicate", F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("kept").alias("change"))


def due_in_days(day: Column, index: Column, every: int) -> Column:
    """Days until a board's turn in a stateless rotation."""
    return F.pmod(index - F.datediff(day, F.lit("1970-01-01").cast("date")), F.lit(every))


def latest_labels(log: DataFrame, deleted: DataFrame) -> DataFrame:
    """The last label of each key of log (id, key, label) after the deleted ids (id) are gone."""
    return log.join(deleted.select("id"), "id", "left_anti").groupBy("key").agg(F.max_by("label", "id").alias("label"))


def setters(at: Column) -> dict[str, dict[str, Column]]:
    """What each setter of a posting's life writes."""
    none = F.lit(None).cast("timestamp")
    return {
        "mark_checked": {"checked_at": at}, "mark_closed": {"closed_at": at, "checked_at": at}, "mark_open": {"closed_at": none, "checked_at": at},
        "mark_notified": {"notified_at": at}, "reopen": {"closed_at": none, "checked_at": none},
    }


def set_life(rows: DataFrame, name: str, ids: DataFrame, at: Column) -> DataFrame:
    """rows (id, closed_at, checked_at, notified_at and others) after a setter was given ids (id)."""
    return set_marks(rows, ids.select("id").distinct(), **setters(at)[name])


def reset_notified(rows: DataFrame, since: Column, duplicates: DataFrame) -> DataFrame:
    """rows (id, tier, notified_at and others): those kept, no duplicates (id), and notified from since on count as not notified."""
    known = rows.join(duplicates.select("id", F.lit(True).alias("_duplicate")).distinct(), "id", "left")
    again = F.col("tier").isin("ELIGIBLE", "STRETCH") & (F.col("notified_at") >= since) & F.col("_duplicate").isNull()
    return known.select(*[F.when(~F.coalesce(again, F.lit(False)), F.col(c)).alias(c) if c == "notified_at" else F.col(c) for c in rows.columns])
