"""The daily run over seeded postings: new ones are normalised, gated, linked to stored ones, scored and merged."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R
from ..operators import scoring, similarity
from ..operators.storage import cut
from .extraction import _CORE, _NAMES

_WORDS = "kubernetes docker linux python terraform ansible cloud aws azure reseau securite ci cd deploiement equipe projet client agile production supervision incident astreinte documentation architecture".split()
_TITLES = ["Ingénieur DevOps", "SRE", "Administrateur systèmes", "Développeur Java", "Data engineer", "Technicien logistique", "Ingénieur cloud DevOps", "Chef de projet"]
SCHEMA = "id bigint, source string, source_job_id string, title string, company string, location string, contract string, description string, at bigint"
PROFILE = scoring.Profile(preferred=[("kubernetes", 3, ["k8s"]), ("docker", 2, []), ("terraform", 2, []), ("ci/cd", 2, ["cicd"]), ("python", 1, [])], negative=[("sap", -10, [])], vocabulary=["ansible", "azure"], base=50, multiplier=1.5, titles=_CORE)
GATE = scoring.Gate(profile=PROFILE, target_titles=["devops", "sre", "systeme", "cloud"], dev_titles=["developpeur"], role_titles=["devops"], have=3.0, band=2.0, contracts=["CDI"], reserved=True, recruiters=_NAMES)


def postings(spark: SparkSession, n: int, seed: int, first: int = 0, days: int = 30, earlier: list[tuple] | None = None) -> tuple[DataFrame, list[tuple]]:
    """n seeded postings over days after those of earlier, 15 % of them reposts of an earlier one under another id."""
    rng, rows, known = random.Random(seed), [], list(earlier or [])
    start = max((row[-1] for row in known), default=-1) + 1
    for i in range(n):
        at = start + i * days // n
        if known and rng.random() < 0.15:
            old = rng.choice(known)
            row = (first + i, old[1], f"r{first + i}", old[3], *old[4:7], old[7] + (" Bis." if rng.random() < 0.5 else ""), at)
        else:
            text = ". ".join(" ".join(rng.choice(_WORDS) for _ in range(12)).capitalize() for _ in range(12)) + f". Au moins {rng.randrange(1, 9)} ans d'expérience."
            row = (first + i, "s", f"p{first + i}", rng.choice(_TITLES), f"Société {rng.randrange(400)} SAS", rng.choice(["75 - Paris", "69 - Lyon", "France"]), rng.choice(["CDI", "CDD", "UNKNOWN"]), text, at)
        rows.append(row)
        known.append(row)
    return spark.createDataFrame(rows, SCHEMA), known


def normalised(rows: DataFrame) -> DataFrame:
    """rows with what deduplication compares: company, title, place, fingerprint and folded text."""
    place = F.coalesce(T.department(F.col("location")), T.fold(F.col("location")))
    return rows.select(
        "*", T.company_name(F.col("company")).alias("company_normalized"), T.title_name(F.col("title")).alias("title_normalized"), place.alias("place"), T.fold(F.col("description")).alias("text"),
        T.fingerprint(F.col("company"), F.col("title"), F.col("location"), F.col("contract"), F.substring("description", 1, 500)).alias("fp"),
    )


def run(stored: DataFrame, new: DataFrame, window: int = 30) -> DataFrame:
    """stored (normalised, with tier) and new merged: every new posting with its tier, reasons, parent and score."""
    # gated once: both the links and the scores read the gated postings
    judged = cut(scoring.evaluate(normalised(new), GATE, title=F.col("title"), company=F.col("company"), contract=F.col("contract"), text=F.col("description"), location_ok=F.lit(True)))
    every = stored.select(*[c for c in judged.columns if c in stored.columns]).unionByName(judged, allowMissingColumns=True)
    posts = every.select("id", "at", F.col("company_normalized").alias("company"), F.col("title_normalized").alias("title"), "place", "fp", "text", (F.col("tier") == "REJECTED").alias("rejected"))
    links = similarity.links(posts, window).select(F.col("child").alias("id"), "parent", "reason", "similarity")
    scored = scoring.score(judged, F.col("title"), F.col("description"), PROFILE).join(links, "id", "left")
    fields = ["source", "source_job_id", "id", "tier", "score", "parent"]
    old = stored.select("source", "source_job_id", "id", "tier", F.lit(None).cast("int").alias("score"), F.lit(None).cast("bigint").alias("parent"))
    return R.upsert(old, scored.select(*fields), ["source", "source_job_id"], {})
