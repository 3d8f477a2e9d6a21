"""The daily run on a few seeded postings."""

from pyspark.sql import functions as F
from tidemill.plans import daily


def test_daily_run(spark):
    stored, known = daily.postings(spark, 60, 1)
    old = daily.normalised(stored).withColumn("tier", F.lit("ELIGIBLE"))
    new, everything = daily.postings(spark, 40, 2, 60, 1, known)
    rows = {r.id: r for r in daily.run(old, new).collect()}
    assert len(rows) == 100
    fresh = [r for i, r in rows.items() if i >= 60]
    assert all(r.tier in ("ELIGIBLE", "STRETCH", "REJECTED") and 0 <= r.score <= 100 for r in fresh)
    texts = {row[0]: row[7].removesuffix(" Bis.") for row in everything}
    linked = [r for r in fresh if r.parent is not None]
    assert linked and all(texts[r.id] == texts[r.parent] and r.parent < r.id for r in linked)
