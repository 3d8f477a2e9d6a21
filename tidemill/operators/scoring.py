"""Title families, the gate and the explainable score, all from rules given as data."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import text as T
from . import relational as R

Skill = tuple[str, list[str]]  # name, aliases


@dataclass(frozen=True)
class TitleRules:
    """Words of titles: prefixes of words, but whole words for the overrides."""

    core: list[str]
    overrides: list[str]
    off_domain: list[str]
    near: list[str]
    sectors: list[str]
    points: dict[str, int]


@dataclass(frozen=True)
class Profile:
    preferred: list[tuple[str, int, list[str]]]  # name, weight, aliases
    negative: list[tuple[str, int, list[str]]]
    vocabulary: list[str]
    base: int
    multiplier: float
    titles: TitleRules


@dataclass(frozen=True)
class Gate:
    profile: Profile
    target_titles: list[str]
    dev_titles: list[str]
    role_titles: list[str]
    have: float
    band: float
    contracts: list[str] = field(default_factory=list)
    reserved: bool = False
    recruiters: list[str] = field(default_factory=list)


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def title_family(title: Column, rules: TitleRules) -> Column:
    """struct(family, points): core unless another role overrides it, then off_domain, near, a sector (off_domain), other."""

    def read(t: Column) -> Column:
        starts = lambda words: _any([T.starts_term(t, T.fold_plain(w)) for w in words])
        core = F.when(_any([T.names_term(t, T.fold_plain(w)) for w in rules.overrides]), "other").otherwise("core")
        return F.when(starts(rules.core), core).when(starts(rules.off_domain), "off_domain").when(starts(rules.near), "near").when(starts(rules.sectors), "off_domain").otherwise("other")

    points = lambda f: F.struct(f.alias("family"), F.when(f == "core", rules.points["core"]).when(f == "near", rules.points["near"]).when(f == "other", rules.points["other"]).otherwise(0).alias("points"))
    return T.let(T.let(T.fold(F.coalesce(title, F.lit(""))), read), points)


def relevant(title: Column, text: Column, keywords: list[str], skills: list[Skill]) -> Column:
    """Whether a word of the title starts with a keyword, or title or text name a skill; without keywords everything is."""
    if not keywords:
        return F.lit(True)
    starts = T.let(T.fold(title), lambda t: _any([T.starts_term(t, T.fold_plain(k)) for k in keywords]))
    both = F.concat_ws(" ", title, text)
    return starts | T.contains_any(both, [f for name, aliases in skills for f in (name, *aliases)])


def dev_role(title: Column, dev: list[str], roles: list[str]) -> Column:
    """Whether a title names a developer and none of the wanted roles, as whole words."""
    names = lambda t, words: _any([T.names_term(t, T.fold_plain(w)) for w in words])
    return T.let(T.fold(title), lambda t: names(t, dev) & ~names(t, roles))


def contract_rejects(contract: Column, allowed: list[str]) -> Column:
    """Whether a known contract is none of the allowed ones; an empty list allows all."""
    return F.lit(bool(allowed)) & (contract != "UNKNOWN") & ~contract.isin(allowed)


def evaluate(rows: DataFrame, gate: Gate, *, title: Column, company: Column, contract: Column, text: Column, location_ok: Column) -> DataFrame:
    """rows with required, recruiter, client, reasons, stretch, tier: every gate is read, the reasons stand in the gates' order."""
    skills = [(n, a) for n, _, a in gate.profile.preferred]
    whole = F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(text, F.lit("")))
    read = rows.withColumns(
        {
            "_years_read": X.years_read(title, text),
            "family": title_family(title, gate.profile.titles)["family"],
            "reserved_by": X.reserved_sentence(whole),
            "recruiter": X.specialised_recruiter(company, whole, gate.recruiters) if gate.recruiters else F.lit(None).cast("string"),
            "client": X.end_client(text),
        }
    )
    read = read.withColumns({"_years": X.years_of(F.col("_years_read")), "_basis": X.basis_of(F.col("_years_read"))})
    years = F.col("_years")
    gates = [
        ("NOT_RELEVANT", dev_role(title, gate.dev_titles, gate.role_titles) | ~relevant(title, text, gate.target_titles, skills)),
        ("TITLE", F.col("family") == "off_domain"),
        ("RESERVED_RQTH", F.lit(gate.reserved) & (F.col("recruiter").isNotNull() | F.col("reserved_by").isNotNull())),
        ("EXPERIENCE", years > gate.have + gate.band),
        ("CONTRACT", contract_rejects(contract, gate.contracts)),
        ("LOCATION", ~location_ok),
    ]
    decided = read.withColumn("reasons", R.reasons(gates))
    stretch = (F.size("reasons") == 0) & F.coalesce((years > gate.have) & (years <= gate.have + gate.band), F.lit(False))
    told = decided.withColumn("stretch", stretch).withColumn("tier", F.when(F.size("reasons") > 0, "REJECTED").when(F.col("stretch"), "STRETCH").otherwise("ELIGIBLE"))
    # over columns the struct is cheap to take apart, so that a plan without the sentence, its dearest part, does not make it
    required = F.struct(years.alias("years"), F.col("_basis").alias("basis"), X.sentence_of(F.col("_years_read"), title, text).alias("sentence"))
    out = told.withColumn("required", required).drop("family", "reserved_by", "_years_read", "_years", "_basis")
    others = [c for c in out.columns if c != "required"]
    at = others.index("recruiter")
    return out.select(*[F.col(f"`{c}`") for c in (*others[:at], "required", *others[at:])])


def score(rows: DataFrame, title: Column, description: Column, profile: Profile) -> DataFrame:
    """rows with score (0 to 100), explanations, positive, negative, missing, evidence, weights, unlisted.

    A preferred skill adds its weight, times the multiplier and rounded half up where the
    profile section names it too; a negative one takes its weight; the title's family adds its
    points.  Words of the vocabulary that the profile does not list are noted, never scored.
    """
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(description, F.lit("")))
    read = rows.withColumns({"_text": text, "_part": T.profile_text(description) if profile.multiplier != 1 else F.lit(""), "_family": title_family(title, profile.titles)})

    listed = {n.lower() for n, _, _ in (*profile.preferred, *profile.negative)}
    terms = [("preferred", *x) for x in profile.preferred] + [("negative", *x) for x in profile.negative] + [("unlisted", v, 0, []) for v in profile.vocabulary if v.lower() not in listed]
    # one constant list and one expression for all terms: the plan does not grow with them
    told = [{"kind": kind, "name": name, "weight": weight, "more": math.floor(weight * profile.multiplier + 0.5) if kind == "preferred" else weight, "forms": [{"form": f, "whole": T.whole_term(f)} for f in (name, *aliases)]} for kind, name, weight, aliases in terms]
    known = F.from_json(F.lit(json.dumps(told)), "array<struct<kind:string,name:string,weight:int,more:int,forms:array<struct<form:string,whole:string>>>>")

    def found(x: Column) -> Column:
        starts = F.filter(F.transform(x["forms"], lambda f: F.struct((F.regexp_instr(F.col("_text"), f["whole"]) - 1).alias("start"), F.length(f["form"]).alias("size"))), lambda h: h["start"] >= 0)
        raised = (x["kind"] == "preferred") & F.exists(x["forms"], lambda f: F.regexp_instr(F.col("_part"), f["whole"]) > 0)

        def one(h: Column) -> Column:
            hit = h["at"].isNotNull()
            said = T.snippet(F.col("_text"), h["at"]["start"], h["at"]["start"] + h["at"]["size"])
            return F.struct(x["kind"].alias("kind"), x["name"].alias("name"), hit.alias("hit"), (h["raised"] & hit).alias("raised"), F.when(hit & h["raised"], x["more"]).when(hit, x["weight"]).otherwise(0).alias("weight"), F.when(hit, said).alias("said"))

        return T.let(F.struct(F.array_min(starts).alias("at"), raised.alias("raised")), one)

    read = read.withColumn("_skills", F.transform(known, found))
    s = F.col("_skills")
    of = lambda kind, hit=True: F.filter(s, lambda x: (x["kind"] == kind) & (x["hit"] == hit))
    names = lambda own: F.transform(own, lambda x: x["name"])
    lines = F.flatten(
        F.transform(
            F.filter(s, lambda x: (x["kind"] == "preferred") | ((x["kind"] == "negative") & x["hit"])),
            lambda x: F.filter(
                F.array(
                    F.when(x["raised"], F.concat(F.lit("Profile section: "), x["name"], F.lit(f" (x{profile.multiplier:g})"))),
                    F.when(~x["hit"], F.concat(F.lit("Missed preferred: "), x["name"])).when(x["kind"] == "preferred", F.format_string("Matched preferred: %s (+%d)", x["name"], x["weight"])).otherwise(F.format_string("Matched negative: %s (%d)", x["name"], x["weight"])),
                ),
                lambda line: line.isNotNull(),
            ),
        )
    )
    total = F.aggregate(s, F.lit(profile.base) + F.col("_family.points"), lambda acc, x: acc + x["weight"])
    counted = F.filter(s, lambda x: x["hit"] & (x["kind"] != "unlisted"))
    pairs = lambda own, value: F.map_from_entries(F.transform(own, lambda x: F.struct(x["name"].alias("key"), x[value].alias("value"))))
    return read.withColumns(
        {
            "score": F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int"),
            "explanations": F.concat(lines, F.array(F.format_string("Title relevance: %s (%+d)", F.col("_family.family"), F.col("_family.points")))),
            "positive": names(of("preferred")), "negative": names(of("negative")), "missing": names(of("preferred", False)),
            "evidence": pairs(counted, "said"), "weights": pairs(counted, "weight"), "unlisted": pairs(of("unlisted"), "said"),
        }
    ).drop("_text", "_part", "_family", "_skills")


def top_reasons(weights: Column, k: int) -> Column:
    """The k entries (name, weight) of a map of weights that moved the score most; of equal ones the first name."""
    ranked = F.array_sort(F.transform(F.map_entries(weights), lambda e: F.struct((-F.abs(e["value"])).alias("rank"), e["key"].alias("name"), e["value"].alias("weight"))))
    return F.transform(F.slice(ranked, 1, k), lambda r: F.struct(r["name"].alias("name"), r["weight"].alias("weight")))


def skills_named(text: Column, skills: list[Skill]) -> Column:
    """The skills that a text names by their name or an alias, sorted."""
    return F.array_sort(F.filter(F.array(*[F.when(T.contains_any(text, [n, *a]), F.lit(n)) for n, a in skills]), lambda x: x.isNotNull()))


def combined_score(scores: dict[str, Column], review_from: int) -> Column:
    """struct(score, divergence, needs_review) of several scorers: the first available one counts; the spread of two or more asks for review."""
    known = F.filter(F.array(*scores.values()), lambda x: x.isNotNull())
    spread = F.when(F.size(known) >= 2, F.array_max(known) - F.array_min(known))
    return F.struct(F.coalesce(*scores.values()).alias("score"), spread.alias("divergence"), F.coalesce(spread >= review_from, F.lit(False)).alias("needs_review"))


def with_overrides(rules: DataFrame, overrides: DataFrame, weight: int) -> DataFrame:
    """rules (skill, weight) with the overrides (skill) that they lack, each once, at weight."""
    new = overrides.select(F.lower(F.trim("skill")).alias("skill")).distinct().join(rules.select(F.lower("skill").alias("skill")), "skill", "left_anti")
    return rules.select("skill", "weight").unionByName(new.select("skill", F.lit(weight).alias("weight")))


def section_of(tier: Column, score_: Column, strong: int) -> Column:
    return F.when(tier == "STRETCH", "stretch").when(score_ >= strong, "strong").otherwise("eligible")


def stored_years(detail: Column, parsed: Column, tier: Column, note: Column) -> Column:
    """The years a posting asks for: those stored with its score, those parsed, those that a stretch note tells."""
    told = F.regexp_extract(note, r"requires (\d+(?:\.\d+)?)y", 1).try_cast("double")
    return F.coalesce(detail, parsed, F.when(tier == "STRETCH", told))


def rank_score(ai: Column, own: Column) -> Column:
    return F.coalesce(ai, own, F.lit(-1))


def sides_with(kind: Column, decision: Column, ai: Column, own: Column) -> Column:
    """Whom a human verdict backs: a keep the higher score, a drop the lower one; a place says nothing."""
    higher, drops = ai > own, decision.isin("off_topic", "too_senior", "missing_skill")
    return F.when(kind == "off_topic_strong", F.when(decision == "good_fit", "python").when(decision.isNotNull(), "ia")).when(decision == "good_fit", F.when(higher, "ia").otherwise("python")).when(drops, F.when(higher, "python").otherwise("ia"))


def weight_band(weight: Column, bands: list[tuple[float, str]], last: str) -> Column:
    """The first band (least weight, name) that a weight reaches."""
    case = F.when(weight >= bands[0][0], bands[0][1])
    for least, name in bands[1:]:
        case = case.when(weight >= least, name)
    return case.otherwise(last)


def lead_exclusion(country: Column, amount: Column, currency: Column, said: Column, *, countries: list[str], least: float, rates: dict[str, float], sectors: list[str]) -> Column:
    """country, amount, sector or null: why a lead is left out; what is unknown passes."""
    wrong = F.coalesce(~T.fold(country).isin(countries), F.lit(False)) if countries else F.lit(False)
    rate = F.when(currency.isNull() | (currency == "EUR"), 1.0)
    for name, value in rates.items():
        rate = rate.when(currency == name, value)
    sector = T.let(T.fold(said), lambda t: _any([T.starts_term(t, T.fold_plain(s)) for s in sectors]))
    return F.when(wrong, "country").when(amount * rate < least, "amount").when(sector, "sector")


def question_category(label: Column, kind: Column, tag: Column, words: dict[str, list[str]]) -> Column:
    """What a form field asks, by ordered word lists; a box is never more than consent, a letter needs a text area."""

    def read(text: Column) -> Column:
        hit = lambda c: _any([T.names_term(text, T.fold_plain(w)) for w in words.get(c, [])])
        case = F.when(kind == "password", "password").when(hit("sensitive"), "sensitive").when(kind == "checkbox", F.when(hit("consent"), "consent").otherwise("unknown")).when(hit("salary"), "salary")
        for c in words:
            if c not in ("sensitive", "consent", "salary"):
                case = case.when(hit(c) & (F.lit(c != "cover_letter") | (tag == "textarea")), c)
        return case.otherwise("unknown")

    return T.let(T.fold(F.coalesce(label, F.lit(""))), read)
