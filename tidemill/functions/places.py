"""Places: departments named in a location, by a greedy longest-match scan over a table of names.

A table of places has name (folded), departments and abroad; the regions are built in, towns
and department names are the caller's (any official list).  The scan is a fold over the
tokens against a map, so it stays a column program; distinct locations are resolved once and
joined back by ``resolve()``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T

#: Regions and their departments.
REGIONS = {
    "Île-de-France": "75 77 78 91 92 93 94 95", "Centre-Val de Loire": "18 28 36 37 41 45", "Bourgogne-Franche-Comté": "21 25 39 58 70 71 89 90", "Normandie": "14 27 50 61 76",
    "Hauts-de-France": "02 59 60 62 80", "Grand Est": "08 10 51 52 54 55 57 67 68 88", "Pays de la Loire": "44 49 53 72 85", "Bretagne": "22 29 35 56",
    "Nouvelle-Aquitaine": "16 17 19 23 24 33 40 47 64 79 86 87", "Occitanie": "09 11 12 30 31 32 34 46 48 65 66 81 82", "Auvergne-Rhône-Alpes": "01 03 07 15 26 38 42 43 63 69 73 74",
    "Provence-Alpes-Côte d'Azur": "04 05 06 13 83 84", "Corse": "2A 2B", "Guadeloupe": "971", "Martinique": "972", "Guyane": "973", "La Réunion": "974", "Mayotte": "976",
}
#: The departments are those of the regions.
DEPARTMENTS = sorted({d for own in REGIONS.values() for d in own.split()})
#: Codes of states and provinces that end an American address.
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC AB BC MB NB NL NS ON PE QC SK".split()
SCHEMA = "name string, departments array<string>, abroad boolean"


def table(spark: SparkSession, *lists: DataFrame) -> DataFrame:
    """One table of places: the regions first, then lists (name, departments, abroad) in order of priority; of a name the first writer stays."""
    regions = spark.createDataFrame([(name, codes.split(), False) for name, codes in REGIONS.items()], SCHEMA)
    everything = None
    for k, own in enumerate((regions, *lists)):
        own = own.select(T.fold(F.col("name")).alias("name"), "departments", "abroad", F.lit(k).alias("order"))
        everything = own if everything is None else everything.unionByName(own)
    first = everything.groupBy("name", "order").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("departments")))).alias("departments"), F.bool_or("abroad").alias("abroad"))
    return first.groupBy("name").agg(F.min_by(F.struct("departments", "abroad"), "order").alias("p")).select("name", "p.*")


def is_department(code: Column) -> Column:
    return F.upper(F.trim(code)).isin(DEPARTMENTS)


def foreign_style(location: Column) -> Column:
    """Whether a location ends like ``City, ST``, in capitals."""
    return F.regexp_extract(location, r",\s*([A-Z]{2})(?:\s*,?\s*(?:USA|U\.S\.A\.|US|United States))?\s*\.?\s*$", 1).isin(STATES)


def candidates(locations: DataFrame, places: DataFrame) -> DataFrame:
    """location, names of each row of locations (location): the places (start, width, departments, abroad) whose name stands among its words.

    Every run of words up to the longest name is looked up by a join, so the table of places
    may be of any size; a name of fewer than three letters counts only as the whole location.
    """
    longest = places.agg(F.max(F.size(F.split("name", " ")))).first()[0] or 1
    words = F.split(T.fold(F.col("location")), " ")
    runs = F.flatten(F.transform(words, lambda _, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words) - i)), lambda n: F.struct(i.alias("start"), n.alias("width"), F.array_join(F.slice(words, i + 1, n), " ").alias("name")))))
    each = locations.where(F.coalesce(T.fold(F.col("location")), F.lit("")) != "").select("location", F.size(words).alias("size"), F.explode(runs).alias("r")).select("location", "size", "r.*").where("length(name) >= 3 OR size = 1")
    return each.join(places, "name").groupBy("location").agg(F.collect_list(F.struct("start", "width", "departments", "abroad")).alias("names"))


def resolve(rows: DataFrame, places: DataFrame) -> DataFrame:
    """rows (location and others) with departments, department, french, block_key.

    departments: a code in front of the location, else the names found left to right, the
    longest at each word, and postal codes; empty for a foreign place or an unreadable one.
    department is the only one, or null.  french is true, false or null (cannot tell).
    block_key is what duplicates are compared by: the department, else the folded text.
    Distinct locations are resolved once.
    """
    distinct = rows.select("location").distinct()
    found = distinct.join(candidates(distinct, places), "location", "left").withColumn("words", F.split(T.fold(F.col("location")), " "))
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<string>").alias("departments"), F.lit(False).alias("abroad"))

    def step(acc: Column, i: Column) -> Column:
        here = F.filter(F.coalesce("names", F.array().cast("array<struct<start:int,width:int,departments:array<string>,abroad:boolean>>")), lambda x: x["start"] == i)
        best = F.array_max(F.transform(here, lambda x: F.struct(x["width"].alias("width"), x["departments"].alias("departments"), x["abroad"].alias("abroad"))))
        postal = T.postal_department(F.get("words", i))
        code = F.when(is_department(postal), F.array(postal)).otherwise(F.array().cast("array<string>"))
        taken = F.struct((i + best["width"]).alias("free"), F.array_union(acc["departments"], F.coalesce(best["departments"], F.array().cast("array<string>"))).alias("departments"), (acc["abroad"] | F.coalesce(best["abroad"], F.lit(False))).alias("abroad"))
        missed = F.struct((i + 1).alias("free"), F.array_union(acc["departments"], code).alias("departments"), acc["abroad"].alias("abroad"))
        return F.when(i < acc["free"], acc).when(best.isNotNull(), taken).otherwise(missed)

    scan = F.aggregate(F.sequence(F.lit(0), F.size("words") - 1), start, step)
    found = found.withColumn("scan", scan).withColumn("code", T.department(F.col("location")))
    folded, none = T.fold(F.coalesce("location", F.lit(""))), F.array().cast("array<string>")
    blank = folded == ""
    departments = F.when(F.col("code").isNotNull(), F.array("code")).when(blank | foreign_style(F.col("location")) | F.col("scan.abroad"), none).otherwise(F.array_sort("scan.departments"))
    french = (
        F.when(blank, F.lit(None).cast("boolean")).when(foreign_style(F.col("location")), False).when(F.col("code").isNotNull(), is_department(F.col("code"))).when(F.col("scan.abroad"), False).when((F.size("scan.departments") > 0) | T.names_term(folded, "france"), True)
    )
    resolved = found.select(F.col("location").alias("_at"), F.coalesce(departments, none).alias("departments"), french.alias("french"), folded.alias("_folded"))
    resolved = resolved.withColumn("department", F.when(F.size("departments") == 1, F.element_at("departments", 1))).withColumn("block_key", F.coalesce("department", "_folded")).drop("_folded")
    return rows.join(resolved, F.col("location").eqNullSafe(F.col("_at")), "left").drop("_at")


def same_place(one: Column, other: Column) -> Column:
    """Whether two block keys may name one place: equal, or not both a department."""
    return (one == other) | ~(is_department(one) & is_department(other))


def allowed(location: Column, departments: Column, french: Column, source: Column, cities: list[str], scope: list[str], home_source: str) -> Column:
    """The location gate: remote or a configured city passes; without a scope the place must be French (for home_source: not foreign);
    with one it must share a department with it, an unreadable place passes and a foreign one never does."""
    folded = T.fold(F.coalesce(location, F.lit("")))
    free = F.contains(folded, F.lit("remote")) | F.contains(folded, F.lit("teletravail"))
    for city in cities:
        free = free | F.contains(folded, F.lit(T.fold_plain(city)))
    home, code = F.coalesce(source == home_source, F.lit(False)), T.department(location)
    filed_abroad = home & code.isNotNull() & ~is_department(code)
    if not scope:
        inside = F.when(home, F.coalesce(french, F.lit(True))).otherwise(F.coalesce(french, F.lit(False)))
    else:
        inside = F.when(F.coalesce(~french, F.lit(False)), False).when(F.size(departments) == 0, True).otherwise(F.arrays_overlap(departments, F.array(*[F.lit(d.upper()) for d in scope])))
    return F.when(free, True).when(filed_abroad, False).otherwise(inside)
