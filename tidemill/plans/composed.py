"""Queries of the extractors, names, gate and scorer over phrases composed from orders, and the SQL that computes each answer from the same columns.

A row's phrase is one of several templates, filled with numbers and names of the row, so the
inputs are as many as the rows.  Both sides write templates as SQL expressions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import funding as U
from ..functions import text as T
from ..functions import wording as W
from ..operators import lifecycle, scoring, validation
from ..operators.storage import shared_dir
from ..sources import boards
from .extraction import _ALIASES, _COUNTRIES, _GATE, _NAMES, _PROFILE, _WORDS
from .registry import query, table

#: Numbers and names of an order that templates use: n 1 to 9, m above n by 1 to 5, k 10 to 99, c its customer, x a letter from A to H.
_FROM = "SELECT o_orderkey, o_custkey AS c, o_orderkey % 9 + 1 AS n, o_orderkey % 9 + 2 + o_custkey % 5 AS m, o_orderkey % 90 + 10 AS k, substr('ABCDEFGH', CAST(o_orderkey % 8 + 1 AS INT), 1) AS x, o_orderpriority AS p, o_totalprice AS price FROM orders"


def composed(given: dict[str, list[str]], told: dict[str, tuple[str, list[str]]]) -> Callable[[Callable[[DataFrame], DataFrame]], object]:
    """Registers a query over orders: given are the templates of each input, told the type and the expected value of each result, template by template."""
    many = len(next(iter(given.values())))
    case = lambda options: f"CASE o_orderkey % {many} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(options)) + " END"

    def add(f: Callable[[DataFrame], DataFrame]) -> object:
        def run(spark: SparkSession, d: str) -> DataFrame:
            table(spark, d, "orders").createOrReplaceTempView("_orders")
            # a row costs far more than its bytes tell: rows are dealt over all tasks, as a file may be a single one
            rows = spark.sql(_FROM.replace("FROM orders", "FROM _orders")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
            return f(rows.select("o_orderkey", *[F.expr(case(options)).alias(name) for name, options in given.items()]))

        run.__name__ = f.__name__
        assert all(len(options) == many for options in [*given.values(), *[x for _, x in told.values()]]), f.__name__
        return query(f"SELECT o_orderkey, {', '.join(f'CAST({case(options)} AS {kind}) AS {name}' for name, (kind, options) in told.items())} FROM ({_FROM})")(run)

    return add


@composed(
    {"s": ["'Au moins ' || n || ' ans d’expérience, hors stage et alternance.'", "n || ' à ' || m || ' ans'", "n || ' ans d’expérience, minimum ' || m || ' ans'", "'Fondée en 20' || k || '. Jusqu’à ' || n || ' ans'", "'Profil junior, bureau ' || k", "n || ' années consécutives'", "n || '+ years, ' || m || '+ years'", "'moins de ' || n || ' ans, up to ' || m || ' years'"]},
    {
        "status": ("VARCHAR", ["'EXPLICIT'", "'EXPLICIT'", "'EXPLICIT'", "'EXPLICIT'", "'UNKNOWN'", "'NOT_MENTIONED'", "'EXPLICIT'", "'EXPLICIT'"]), "min_years": ("DOUBLE", ["n", "n", "m", "NULL", "NULL", "NULL", "m", "NULL"]), "max_years": ("DOUBLE", ["NULL", "m", "NULL", "n", "NULL", "NULL", "NULL", "n"]),
        "evidence": ("VARCHAR", ["'Au moins ' || n || ' ans'", "n || ' à ' || m || ' ans'", "'minimum ' || m || ' ans'", "'Jusqu’à ' || n || ' ans'", "'junior'", "NULL", "m || '+ years'", "'moins de ' || n || ' ans'"]),
        "without": ("BOOLEAN", ["true", *["false"] * 7]),
    },
)
def experience_rows(rows: DataFrame) -> DataFrame:
    x = rows.select("o_orderkey", X.experience(F.col("s")).alias("x"))
    return x.select("o_orderkey", "x.status", "x.min_years", "x.max_years", "x.evidence", F.col("x.excludes_apprenticeship").alias("without"))


@composed(
    {"title": ["'Senior dev ' || c", "'Lead dev ' || c", "'Dev ' || c", "'Dev ' || c", "'Leader ' || c", "'Dev'"], "s": ["'au moins ' || n || ' ans'", "'Rien. Un expert ' || c || ' est attendu.'", "'jusqu’à ' || n || ' ans'", "'premier emploi, bureau ' || c", "'bureau ' || c", "'Un profil confirmé ' || k"]},
    {"years": ("DOUBLE", ["n", "7", "NULL", "NULL", "NULL", "3"]), "basis": ("VARCHAR", ["'explicit'", "'seniority'", "'explicit'", "'unknown'", "'not_mentioned'", "'seniority'"]), "sentence": ("VARCHAR", ["'au moins ' || n || ' ans'", "'Un expert ' || c || ' est attendu'", "'jusqu’à ' || n || ' ans'", "'premier emploi, bureau ' || c", "NULL", "'Un profil confirmé ' || k"])},
)
def seniority_rows(rows: DataFrame) -> DataFrame:
    return rows.select("o_orderkey", X.required_years(F.col("title"), F.col("s")).alias("x")).select("o_orderkey", "x.years", "x.basis", "x.sentence")


@composed(
    {
        "company": ["'Acme ' || c", "'Acme ' || c", "'Acme'", "'Forum Talents Handicap ' || c", "'X'", "'X'", "'X'"],
        "s": ["'Bureau ' || k || '. Poste réservé aux travailleurs handicapés, lot ' || k || '. Fin.'", "'Le poste ' || k || ' n’est pas réservé aux personnes handicapées.'", "'Offre ' || k || ', uniquement aux bénéficiaires de l’obligation d’emploi'", "'L’entreprise Zed ' || k || ' recherche un dev'", "'Hanploi accompagne ' || k || ' sociétés dans leurs recrutements de salariés en situation de handicap'", "'Offre ' || k || ', uniquement aux bénéficiaires du RSA'", "'Pour le compte de notre client Delta ' || k || ', nous cherchons'"],
    },
    {
        "reserved": ("VARCHAR", ["'Poste réservé aux travailleurs handicapés, lot ' || k", "NULL", "'Offre ' || k || ', uniquement aux bénéficiaires de l’obligation d’emploi'", "NULL", "NULL", "NULL", "NULL"]),
        "recruiter": ("VARCHAR", ["NULL", "NULL", "NULL", "'Talents Handicap'", "'Hanploi'", "NULL", "NULL"]), "client": ("VARCHAR", ["NULL", "NULL", "NULL", "'Zed ' || k", "NULL", "NULL", "'Delta ' || k"]),
        "note": ("VARCHAR", ["NULL", "NULL", "NULL", "'publié par Talents Handicap (recruteur spécialisé RQTH) — le poste peut exister en direct chez Zed ' || k", "'publié par Hanploi (recruteur spécialisé RQTH)'", "NULL", "NULL"]),
    },
)
def reserved_rows(rows: DataFrame) -> DataFrame:
    found = rows.select("o_orderkey", X.reserved_sentence(F.col("s")).alias("reserved"), X.specialised_recruiter(F.col("company"), F.col("s"), _NAMES).alias("recruiter"), X.end_client(F.col("s")).alias("client"))
    return found.select("*", X.recruiter_note(F.col("recruiter"), F.col("client")).alias("note"))


@composed(
    {"s": ["'Zed lève ' || k || ' M€ en série ' || x", "'Sur un marché de ' || k || ' milliards d’euros, Zed lève ' || m || ' millions d’euros'", "'Zed raises $' || n || '.5bn from its investors'", "'Il lève le voile sur ' || k || ' M€'", "'Zed avait levé ' || k || ' M€ en 2020'", "'Zed boucle un tour de table de ' || k || ' 000 euros en pré-amorçage'", "'Zed secures £' || n || '.25m in seed funding'", "'Zed lève ' || k || ' euros'", "'Zed lève ' || k || ' M€ et vise ' || m || ' M€ de chiffre d’affaires'"]},
    {
        "amount": ("DOUBLE", ["k * 1000000", "m * 1000000", "(n + 0.5) * 1000000000", "NULL", "NULL", "k * 1000", "(n + 0.25) * 1000000", "NULL", "k * 1000000"]), "currency": ("VARCHAR", ["'EUR'", "'EUR'", "'USD'", "NULL", "NULL", "'EUR'", "'GBP'", "NULL", "'EUR'"]),
        "round": ("VARCHAR", ["'series ' || lower(x)", "NULL", "NULL", "NULL", "NULL", "'pre-seed'", "'seed'", "NULL", "NULL"]), "shown": ("VARCHAR", ["k || ' M€'", "m || ' M€'", "'$' || n || '.5B'", "NULL", "NULL", "k || ' k€'", "n || ',25 M£'", "NULL", "k || ' M€'"]),
    },
)
def funding_rows(rows: DataFrame) -> DataFrame:
    x = rows.select("o_orderkey", U.funding_amount(F.col("s")).alias("x"), U.funding_round(F.col("s")).alias("round"))
    return x.select("o_orderkey", F.col("x.value").alias("amount"), "x.currency", F.when(F.col("x").isNotNull(), F.col("round")).alias("round"), U.format_amount(F.col("x.value"), F.col("x.currency")).alias("shown"))


_STORIES = [
    "'Zed' || c || ' lève ' || k || ' M€ auprès de Fonds' || x || ', Capital' || k || ' et ses business angels pour recruter ' || k || ' ingénieurs'", "'London-based Zed' || c || ' has raised $' || k || 'M from Fund' || x || ' and Index Ventures, and is hiring'",
    "'Zed' || c || ', basée à Lyon, boucle un tour de table de ' || k || ' M€ et va doubler ses effectifs'", "'La startup suisse Bolt Zed' || c || ' boucle un tour de table mené par le fonds Accel' || k", "'Elle lève ' || k || ' M€'", "'Zed' || c || ' lève ' || k || ' M€ ; un plan social et ' || k || ' embauches'",
]


@composed(
    {"s": _STORIES},
    {
        "named": ("VARCHAR", ["'Zed' || c", "'Zed' || c", "'Zed' || c", "'Bolt Zed' || c", "NULL", "'Zed' || c"]), "investors": ("VARCHAR", ["'Fonds' || x || '|Capital' || k || '|business angels'", "'Fund' || x || '|Index Ventures'", "NULL", "'Accel' || k", "NULL", "NULL"]),
        "hiring": ("VARCHAR", ["'recruter ' || k || ' ingénieurs'", "'is hiring'", "'doubler ses effectifs'", "NULL", "NULL", "NULL"]), "place": ("VARCHAR", ["NULL", "NULL", "'Lyon'", "NULL", "NULL", "NULL"]), "country": ("VARCHAR", ["NULL", "'United Kingdom'", "'France'", "'Switzerland'", "NULL", "NULL"]),
    },
)
def funding_story_rows(rows: DataFrame) -> DataFrame:
    s, plain = F.col("s"), F.col("plain")
    found = rows.withColumn("plain", W.flat(s)).withColumn("f", U.funding_sentence(s, plain)).withColumn("named", U.company_before(s, F.col("f.anchor")))
    return found.select("o_orderkey", "named", F.array_join(U.investors(s, F.col("named"), plain), "|").alias("investors"), U.hiring(s, plain).alias("hiring"), U.location(s, plain).alias("place"), U.country(s, _COUNTRIES, plain).alias("country"))


@composed(
    {
        "title": ["'Zed' || c || ' lève ' || k || ' M€'", "'Rien de neuf au bureau ' || k", "'Foo' || c || ' lève ' || m || ' M€ / Bar rachète Baz'", "'Zed' || c || ' raises $' || k || 'M'"],
        "text": ["'Zed' || c || ', basée à Lyon, annonce une levée de fonds de ' || k || ' M€ en seed, menée par Fonds' || x || '.\n' || 'Un autre sujet.\n' || 'Les fonds serviront à recruter ' || k || ' personnes.'", "'Un texte sans argent, ' || k || ' mots.'", "'Foo' || c || ', startup parisienne, lève ' || m || ' M€.\n' || 'Bar va recruter ' || k || ' personnes.'", "'Zed' || c || ' closes a Series ' || x || ' round of $' || k || 'M led by Index Ventures. The company plans to hire ' || k || ' engineers.'"],
    },
    {
        "is_funding": ("BOOLEAN", ["true", "false", "true", "true"]), "company": ("VARCHAR", ["'Zed' || c", "NULL", "'Foo' || c", "'Zed' || c"]), "amount": ("DOUBLE", ["k * 1000000", "NULL", "m * 1000000", "k * 1000000"]), "round": ("VARCHAR", ["'seed'", "NULL", "NULL", "'series ' || lower(x)"]),
        "investors": ("VARCHAR", ["'Fonds' || x", "NULL", "NULL", "'Index Ventures'"]), "hiring": ("VARCHAR", ["'recruter ' || k || ' personnes'", "NULL", "NULL", "'plans to hire'"]), "country": ("VARCHAR", ["'France'", "NULL", "'France'", "NULL"]), "priority": ("VARCHAR", ["'high'", "'normal'", "'normal'", "'high'"]),
        "reason": ("VARCHAR", ["'funding ' || k || ' M€ seed; hiring: recruter ' || k || ' personnes'", "'funding amount unknown'", "'funding ' || m || ' M€'", "'funding $' || k || 'M series ' || lower(x) || '; hiring: plans to hire'"]),
    },
)
def funding_article_rows(rows: DataFrame) -> DataFrame:
    a = U.articles(rows.select(F.col("o_orderkey").alias("id"), "title", "text"), _COUNTRIES)
    return a.select(
        F.col("id").alias("o_orderkey"), "is_funding", "company", "amount", "round", F.array_join("investors", "|").alias("investors"), "hiring", "country",
        U.lead_priority(F.col("hiring")).alias("priority"), U.lead_reason(F.col("amount"), F.col("currency"), F.col("round"), F.col("hiring")).alias("reason"),
    )


@composed(
    {"a": ["'CDD ou CDI, lot ' || k", "'Contrat à durée indéterminée ' || k", "'Mission d’intérim ' || c", "'Bureau ' || c", "'Temps plein ' || c", "'International ' || c", "NULL"], "b": ["''", "'cdd'", "'cdi'", "'Alternance ' || k || ' mois, CDI ensuite'", "'Fixed-term contract ' || k", "'bureau ' || k", "'Portage salarial ' || k"]},
    {"contract": ("VARCHAR", ["'CDD'", "'CDI'", "'INTERIM'", "'ALTERNANCE'", "'CDD'", "'UNKNOWN'", "'FREELANCE'"])},
)
def contract_rows(rows: DataFrame) -> DataFrame:
    return rows.select("o_orderkey", T.contract_type(F.col("a"), F.col("b")).alias("contract"))


@composed(
    {"company": ["'A.C.M.E. ' || c || ' SAS'", "'Dassault Systèmes ' || c || ' SE'", "'Groupe Éclair ' || c || ' (France)'", "'Sasha' || c || ' GmbH'"], "title": ["'Ingénieur DevOps ' || c || ' (H/F) - CDI'", "'Développeur ' || c || ' f/h stage'", "'Data engineer M/W/D ' || c", "'Hôtesse hf ' || c"]},
    {
        "company_name": ("VARCHAR", ["'acme ' || c", "'dassault systemes ' || c || ' se'", "'groupe eclair ' || c || ' france'", "'sasha' || c"]), "title_name": ("VARCHAR", ["'ingenieur devops ' || c", "'developpeur ' || c", "'data engineer ' || c", "'hotesse ' || c"]),
        "slugs": ("VARCHAR", ["'acme' || c || ',a-c-m-e-' || c", "'dassaultsystemes' || c || ',dassault-systemes-' || c", "'eclair' || c || ',eclair-' || c", "'sasha' || c || 'gmbh,sasha' || c || '-gmbh'"]),
    },
)
def name_rows(rows: DataFrame) -> DataFrame:
    return rows.select("o_orderkey", T.company_name(F.col("company")).alias("company_name"), T.title_name(F.col("title")).alias("title_name"), F.array_join(T.slugs(F.col("company")), ",").alias("slugs"))


@composed(
    {"html": ["'<p>d&eacute;j&#224; ' || k || ' &lt;vu&gt;</p><ul><li>un ' || c || '<li>deux</ul>'", "'&lt;p&gt;Encoded ' || k || ' &amp;amp; markup&lt;/p&gt;'", "'<div>  one\t' || k || ' </div>'", "'A &bogus' || c || '; B &#x41; &apos;'"]},
    {"text": ("VARCHAR", ["'déjà ' || k || '\n' || 'un ' || c || '\n' || 'deux'", "'Encoded ' || k || ' & markup'", "'one ' || k", "'A &bogus' || c || '; B A '''"])},
)
def html_rows(rows: DataFrame) -> DataFrame:
    return rows.select("o_orderkey", T.html_text(F.col("html")).alias("text"))


@composed(
    {"s": ["'M. Dupont lève ' || k || ' M€ en mai.L’entreprise ' || c || ' grandit. Elle recrute.'", "'Acme Inc. raised ' || k || '. It grew ' || n || '.5 times! Why?'", "'un ' || k || '; deux\n\n' || 'trois ' || c"]},
    {"sentences": ("VARCHAR", ["'M. Dupont lève ' || k || ' M€ en mai.|L’entreprise ' || c || ' grandit.|Elle recrute.'", "'Acme Inc. raised ' || k || '.|It grew ' || n || '.5 times!|Why?'", "'un ' || k || '; deux|trois ' || c"]), "lines": ("VARCHAR", ["'M|Dupont lève ' || k || ' M€ en mai.L’entreprise ' || c || ' grandit|Elle recrute'", "'Acme Inc|raised ' || k || '|It grew ' || n || '.5 times|Why'", "'un ' || k || '|deux|trois ' || c"])},
)
def sentence_rows(rows: DataFrame) -> DataFrame:
    return rows.select("o_orderkey", F.array_join(T.prose_sentences(F.col("s")), "|").alias("sentences"), F.array_join(T.word_sentences(F.col("s")), "|").alias("lines"))


@composed(
    {"s": ["'Mission\n' || 'faire ' || k || '\n' || 'Profil recherché :\n' || 'Python ' || c || '\n' || 'Avantages\n' || 'rien'", "'Compétences : Ansible ' || k || ', Go\n' || '- et SQL\n' || 'Poste\n' || 'ici'", "'Rien de tel ' || k", "'Savoir-être\n' || 'rigueur ' || k || '\n' || 'Description du poste : tout\n' || 'fin'"]},
    {"profile": ("VARCHAR", ["'Python ' || c", "'Ansible ' || k || ', Go\n' || '- et SQL'", "''", "'rigueur ' || k"])},
)
def profile_rows(rows: DataFrame) -> DataFrame:
    return rows.select("o_orderkey", T.profile_text(F.col("s")).alias("profile"))


@composed(
    {"name": ["'K8S'", "'  CI/CD '", "'js' || k", "'python'", "'kube'", "'cobol ' || k"], "s": ["'java ' || k || ' et javascript'", "k || ' javascript'", "'du CI/CD ' || k", "'Bureau ' || k || '; en Java, ' || c", "'un .NET ' || k", "'rien ' || c"]},
    {"skill": ("VARCHAR", ["'kubernetes'", "'ci/cd'", "NULL", "'python'", "'kubernetes'", "NULL"]), "java": ("INT", ["0", "NULL", "NULL", "14", "NULL", "NULL"]), "snippet": ("VARCHAR", ["'java ' || k || ' et javascript'", "NULL", "NULL", "'en Java, ' || c", "NULL", "NULL"])},
)
def skill_rows(rows: DataFrame) -> DataFrame:
    found = rows.withColumn("at", T.find_term(F.col("s"), ["java"]))
    said = F.when(F.col("at").isNotNull(), T.snippet(F.col("s"), F.col("at.start"), F.col("at.stop")))
    return found.select("o_orderkey", T.canonical_skill(F.col("name"), _ALIASES, ["Kubernetes", "CI/CD", "python"]).alias("skill"), F.col("at.start").alias("java"), said.alias("snippet"))


@composed(
    {
        "url": ["'https://boards.greenhouse.io/acme' || c || '/jobs/1'", "'https://jobs.lever.co/x' || c", "'https://notlever.co/' || c", "'https://JOBS.ASHBYHQ.com/' || c"], "hay": ["'Ingénieur DevOps ' || c || ' Paris'", "'Ingénieur ' || c", "'C# (.NET) ' || c", "'abc ' || c"],
        "q": ["'paris ' || c || ' ingenieur'", "'devops ' || c", "'c# .net'", "'  '"], "place": ["'75 - Paris ' || k", "'Lyon ' || n || 'e'", "'Brest ' || k", "''"],
    },
    {"form": ("VARCHAR", ["'greenhouse'", "'lever'", "NULL", "'ashby'"]), "hit": ("BOOLEAN", ["true", "false", "true", "true"]), "salary": ("VARCHAR", ["'55-60'", "'48-52'", "'42-46'", "'42-46'"])},
)
def search_rows(rows: DataFrame) -> DataFrame:
    zones = [(["paris", "ile de france"], "55-60"), (["lyon"], "48-52")]
    return rows.select("o_orderkey", T.form_host(F.col("url")).alias("form"), T.matches_words(F.col("hay"), F.col("q")).alias("hit"), T.salary_benchmark(F.col("place"), zones, "42-46").alias("salary"))


@composed(
    {"label": ["'Votre e-mail ' || k", "'Mot de passe ' || k", "'J’accepte la politique ' || k", "'Disponible ' || k", "'Prétentions : salaire ' || k", "'Situation de handicap ' || k"], "kind": ["'text'", "'password'", "'checkbox'", "'checkbox'", "'text'", "'text'"]},
    {"category": ("VARCHAR", ["'email'", "'password'", "'consent'", "'unknown'", "'salary'", "'sensitive'"])},
)
def question_rows(rows: DataFrame) -> DataFrame:
    return rows.select("o_orderkey", scoring.question_category(F.col("label"), F.col("kind"), F.lit("input"), _WORDS).alias("category"))


@composed(
    {
        "title": ["'DevOps ' || c", "'DevOps ' || c", "'DevOps ' || c", "'Boulanger ' || c", "'Développeur Java ' || c", "'Technicien logistique ' || c", "'DevOps senior ' || c"], "company": [*["'Acme ' || k"] * 6, "'Hanploi'"], "contract": ["'CDI'", "'CDI'", "'CDD'", "'UNKNOWN'", "'CDI'", "'CDI'", "'CDI'"],
        "text": ["n || ' ans d’expérience'", "'au moins ' || (4 + n % 2) || ' ans'", "'au moins ' || (5 + n) || ' ans'", "'du pain, ' || k", "'du kubernetes, ' || k", "'du python. RQTH obligatoire, ' || k", "'bureau ' || k"], "allowed": ["true", "true", "false", "true", "true", "true", "true"],
    },
    {
        "reasons": ("VARCHAR", ["CASE WHEN n > 5 THEN 'EXPERIENCE' ELSE '' END", "''", "'EXPERIENCE, CONTRACT, LOCATION'", "'NOT_RELEVANT'", "'NOT_RELEVANT'", "'TITLE, RESERVED_RQTH'", "'RESERVED_RQTH'"]),
        "tier": ("VARCHAR", ["CASE WHEN n > 5 THEN 'REJECTED' WHEN n > 3 THEN 'STRETCH' ELSE 'ELIGIBLE' END", "'STRETCH'", *["'REJECTED'"] * 5]), "years": ("DOUBLE", ["n", "4 + n % 2", "5 + n", "NULL", "NULL", "NULL", "5"]),
        "basis": ("VARCHAR", ["'explicit'", "'explicit'", "'explicit'", "'not_mentioned'", "'not_mentioned'", "'not_mentioned'", "'seniority'"]),
    },
)
def gate_rows(rows: DataFrame) -> DataFrame:
    """The gate over composed postings: all reasons, the tier, and the years that it read."""
    g = scoring.evaluate(rows, _GATE, title=F.col("title"), company=F.col("company"), contract=F.col("contract"), text=F.col("text"), location_ok=F.col("allowed"))
    return g.select("o_orderkey", F.array_join("reasons", ", ").alias("reasons"), "tier", F.col("required.years").alias("years"), F.col("required.basis").alias("basis"))


@composed(
    {"title": ["'DevOps ' || c", "'Boulanger ' || c", "'SRE ' || c"], "text": ["'Outils ' || k || ' : CI/CD.\n' || 'Profil\n' || 'Bon niveau en CI/CD'", "'du K8s ' || k || '; du SAP et du Terraform'", "'Compétences : Kubernetes, Python\n' || 'fin ' || k"]},
    {
        "score": ("INT", ["73", "28", "77"]), "missing": ("VARCHAR", ["'kubernetes,python'", "'ci/cd,python'", "'ci/cd'"]), "unlisted": ("VARCHAR", ["''", "'terraform'", "''"]), "evidence": ("VARCHAR", ["'Outils ' || k || ' : CI/CD'", "'du K8s ' || k", "'Compétences : Kubernetes, Python'"]),
        "reasons": ("VARCHAR", ["'ci/cd +3'", "'sap -10;kubernetes +3'", "'kubernetes +5;python +2'"]),
    },
)
def score_rows(rows: DataFrame) -> DataFrame:
    """The scorer over composed postings: score, missing and unlisted skills, the first evidence and the top reasons."""
    s = scoring.score(rows, F.col("title"), F.col("text"), _PROFILE)
    reasons = F.transform(scoring.top_reasons(F.col("weights"), 3), lambda r: F.format_string("%s %+d", r["name"], r["weight"]))
    return s.select("o_orderkey", "score", F.array_join("missing", ",").alias("missing"), F.array_join(F.array_sort(F.map_keys("unlisted")), ",").alias("unlisted"), F.element_at(F.map_values("evidence"), 1).alias("evidence"), F.array_join(reasons, ";").alias("reasons"))


@composed(
    {"page": ["'<a href=\"https://boards.greenhouse.io/acme' || c || '/jobs/1\">'", "'see jobs.lever.co/zed' || c || '.'", "'https://acme' || c || '.taleo.net/x'", "'nothing ' || c", "'https://jobs.lever.co/api'", "'https://Acme' || c || '.wd3.myworkdayjobs.com/fr-FR/Careers' || k", "'https://wd5.myworkdaysite.com/recruiting/T' || c || '/S' || k"]},
    {"status": ("VARCHAR", ["'verified'", "'verified'", "'custom'", "'not_found'", "'not_found'", "'verified'", "'verified'"]), "board": ("VARCHAR", ["'greenhouse'", "'lever'", "NULL", "NULL", "NULL", "'workday'", "'workday'"]), "identifier": ("VARCHAR", ["'acme' || c", "'zed' || c", "NULL", "NULL", "NULL", "'acme' || c || '.wd3.myworkdayjobs.com/acme' || c || '/Careers' || k", "'wd5.myworkdaysite.com/t' || c || '/S' || k"]), "platform": ("VARCHAR", ["NULL", "NULL", "'taleo'", "NULL", "NULL", "NULL", "NULL"])},
)
def board_rows(rows: DataFrame) -> DataFrame:
    return rows.select("o_orderkey", boards.detected(F.col("page")).alias("x")).select("o_orderkey", "x.*")


def _answers(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select(F.from_json("j", boards.SCHEMAS[kind]).alias("r")).select("r.*")


def _postings(kind: str, mapping: Callable[[DataFrame], DataFrame], answer: str, told: dict[str, tuple[str, list[str]]]) -> None:
    """A query that reads one answer per order and shows the posting that it holds; its id is the order's key."""

    def show(rows: DataFrame) -> DataFrame:
        said = {"o_orderkey": F.col("source_job_id").cast("bigint"), "day": F.date_format("published_at", "yyyy-MM-dd")}
        return mapping(_answers(rows, kind)).select(*[said.get(c, F.col(c)).alias(c) for c in ("o_orderkey", *told)])

    show.__name__ = f"read_{kind}_rows"
    composed({"j": [answer]}, told)(show)


_postings("search", boards.search, """'{"resultats":[{"id":"' || o_orderkey || '","intitule":"Dev ' || k || '","typeContrat":"ALT","lieuTravail":{"libelle":"75 - Paris ' || n || '"},"dateCreation":"2024-01-02T03:04:' || (k % 50 + 10) || 'Z"}]}'""", {"title": ("VARCHAR", ["'Dev ' || k"]), "location": ("VARCHAR", ["'75 - Paris ' || n"]), "contract": ("VARCHAR", ["'ALTERNANCE'"]), "day": ("VARCHAR", ["'2024-01-02'"])})
_postings("region", boards.region, """'{"jobs":[{"id":null,"title":"x"},{"id":"' || o_orderkey || '","title":"Stage dev ' || k || '","location":"Lyon ' || n || '","snippet":"<p>a ' || c || '</p>","link":"https://x/' || c || '"}]}'""", {"title": ("VARCHAR", ["'Stage dev ' || k"]), "contract": ("VARCHAR", ["'STAGE'"]), "description": ("VARCHAR", ["'a ' || c"]), "url": ("VARCHAR", ["'https://x/' || c"])})
_postings("keyword", boards.keyword, """'{"results":[{"id":"' || o_orderkey || '","title":"Ops ' || k || '","company":{"display_name":"Z' || c || '"},"contract_type":"permanent","created":"2024-03-04T05:06:07Z"}]}'""", {"company": ("VARCHAR", ["'Z' || c"]), "contract": ("VARCHAR", ["'CDI'"]), "day": ("VARCHAR", ["'2024-03-04'"])})
_postings("html_board", lambda a: boards.html_board(a, "Acme"), """'{"jobs":[{"id":' || o_orderkey || ',"title":"CDD dev ' || k || '","content":"&lt;p&gt;x ' || c || '&lt;/p&gt;","first_published":"2024-05-06T07:08:09Z"}]}'""", {"company": ("VARCHAR", ["'Acme'"]), "contract": ("VARCHAR", ["'CDD'"]), "description": ("VARCHAR", ["'x ' || c"]), "day": ("VARCHAR", ["'2024-05-06'"])})
_postings("multi_board", lambda a: boards.multi_board(a, "Acme"), """'{"postings":[{"id":"' || o_orderkey || '","text":"T ' || k || '","categories":{"location":"Paris ' || n || '","allLocations":["paris ' || n || '","Lyon"],"commitment":"CDI"},"createdAt":1700000000000}]}'""", {"title": ("VARCHAR", ["'T ' || k"]), "location": ("VARCHAR", ["'Paris ' || n || ', Lyon'"]), "contract": ("VARCHAR", ["'CDI'"]), "day": ("VARCHAR", ["'2023-11-14'"])})
_postings("listed_board", lambda a: boards.listed_board(a, "Acme"), """'{"jobs":[{"id":"u","title":"hidden","isListed":false},{"id":"' || o_orderkey || '","title":"SRE ' || k || '","location":"Paris","employmentType":"Contractor","publishedAt":"2024-06-07T00:00:00+02:00","secondaryLocations":[{"location":"Lille ' || n || '"}]}]}'""", {"title": ("VARCHAR", ["'SRE ' || k"]), "location": ("VARCHAR", ["'Paris, Lille ' || n"]), "contract": ("VARCHAR", ["'FREELANCE'"]), "day": ("VARCHAR", ["'2024-06-06'"])})


_STATUSES, _LABELS = ["to_review", "to_apply", "applied", "interview", "rejected", "ignored"], ["good_fit", "off_topic", "too_senior"]


def _entries(**fields: Column) -> Column:
    return F.create_map(*[x for name, value in fields.items() for x in (F.lit(name), value.cast("string"))])


@composed(
    {"job_key": ["'jobs:' || o_orderkey", "'no key ' || c", "'jobs:' || c", "'jobs:' || c", "'jobs:' || c"], "status": ["'applied'", "'applied'", "'lost'", "'applied'", "'to_apply'"], "day": ["'2024-02-' || (n + 10)", "NULL", "NULL", "'2024-02-' || (n + 25)", "'2023-13-0' || n"], "score": ["k", "k", "k + 50", "k", "-n"]},
    {
        "application": ("BOOLEAN", ["true", "false", "false", "n <= 4", "false"]), "decision": ("BOOLEAN", ["true", "false", "k <= 50", "true", "false"]),
        "verdict": ("BOOLEAN", ["true", "true", "k <= 50", "true", "false"]),
    },
)
def validity_rows(rows: DataFrame) -> DataFrame:
    """Validators of applications, decisions and verdicts: key forms, enumerations, real dates, ranges."""
    at, none = F.lit("2024-01-01T00:00:00"), F.lit(None).cast("string")
    application = _entries(job_key=F.col("job_key"), status=F.col("status"), applied_at=F.col("day"), follow_up_at=none, note=F.lit("x"), cv_url=F.lit("https://x/y"), updated_at=at)
    decision = _entries(id=F.col("o_orderkey"), job_key=F.col("job_key"), label=F.lit("good_fit"), score_at_decision=F.col("score"), created_at=at)
    verdict = _entries(score=F.col("score"), level=F.lit("bon"), reasons=F.lit('["a"]'), red_flags=F.lit("[]"))
    return rows.select("o_orderkey", validation.application(application, _STATUSES).alias("application"), validation.decision(decision, _LABELS).alias("decision"), validation.verdict(verdict, ["bon", "moyen"]).alias("verdict"))


@composed(
    {"text": ["'I led ' || n || ' people with Docker'", "'I led ' || m || ' people with Docker at Acme'", "'In ' || k || ' years'", "''"], "source": ["'I led ' || n || ' people with docker'", "'I led ' || n || ' people'", "'In ' || k || ' years'", "'' || k"]},
    {"errors": ("VARCHAR", ["''", "'name Acme|number ' || m || '|tool Docker'", "''", "''"])},
)
def document_rows(rows: DataFrame) -> DataFrame:
    return rows.select("o_orderkey", F.array_join(validation.document_errors(F.col("text"), F.col("source"), ["Docker", "Kubernetes"], ["Acme"]), "|").alias("errors"))


@composed(
    {"kind": ["'gap'", "'gap'", "'off_topic_strong'"], "decision": ["CASE n % 3 WHEN 0 THEN 'good_fit' WHEN 1 THEN 'off_topic' ELSE 'location' END", "'too_senior'", "CASE WHEN n % 2 = 0 THEN 'good_fit' ELSE 'location' END"], "ai": ["k", "k", "n"], "own": ["100 - k + 1", "k + 1", "k"]},
    {"side": ("VARCHAR", ["CASE WHEN n % 3 = 2 THEN NULL WHEN (n % 3 = 0) = (k > 101 - k) THEN 'ia' ELSE 'python' END", "'ia'", "CASE WHEN n % 2 = 0 THEN 'python' ELSE 'ia' END"])},
)
def side_rows(rows: DataFrame) -> DataFrame:
    return rows.select("o_orderkey", scoring.sides_with(F.col("kind"), F.col("decision"), F.col("ai"), F.col("own")).alias("side"))


@composed(
    {"state": ["'pending'", "'pending'", "'pending'", "'applied'", "'ignored'", "'pending'"], "act": ["'confirm'", "'correct'", "'ignore'", "CASE WHEN n % 2 = 0 THEN 'confirm' ELSE 'ignore' END", "'correct'", "'other' || n"]},
    {"next": ("VARCHAR", ["'applied'", "'applied'", "'ignored'", "'applied'", "'ignored'", "'pending'"]), "ok": ("BOOLEAN", ["true", "true", "true", "false", "false", "false"])},
)
def inbox_action_rows(rows: DataFrame) -> DataFrame:
    to = F.when(F.col("act").isin("confirm", "correct"), "applied").when(F.col("act") == "ignore", "ignored")
    ok = F.coalesce((F.col("state") == "pending") & to.isNotNull(), F.lit(False))
    return rows.select("o_orderkey", F.when(ok, to).otherwise(F.col("state")).alias("next"), ok.alias("ok"))


# --- feeds and outages over tables -------------------------------------------------------------------

_ITEMS = "SELECT o_orderkey, '<item><title> Dev ' || o_custkey || ' </title><link>https://x/offer.aspx?' || CASE WHEN o_orderkey % 3 = 0 THEN 'r=1' ELSE 'idOffre=' || o_orderkey || '&amp;r=1' END || '</link><category>IT</category><category>CDI</category><category> Lyon ' || o_custkey % 9 || ' </category><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate></item>' AS value FROM orders"


@query("SELECT o_orderkey AS id, 'Dev ' || o_custkey AS title, 'Lyon ' || o_custkey % 9 AS location, 'CDI' AS contract, '2024-01-02' AS day FROM orders WHERE o_orderkey % 3 <> 0")
def feed_board_rows(spark: SparkSession, d: str) -> DataFrame:
    """RSS files of a board, up to 500 orders each, written to the shared folder and read by Spark's XML reader; items without an id are none."""
    where = f"{shared_dir(spark)}/feed-board-{uuid.uuid4().hex}"
    table(spark, d, "orders").createOrReplaceTempView("_orders")
    items = spark.sql(_ITEMS.replace("FROM orders", "FROM _orders")).groupBy(F.floor(F.col("o_orderkey") / 500).alias("file")).agg(F.array_join(F.collect_list("value"), "").alias("items"))
    items.select("file", F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>")).alias("value")).repartition("file").write.partitionBy("file").text(where)
    postings = boards.feed_board(boards.rss(spark, where, boards.FEED_BOARD), "Acme")
    return postings.select(F.col("source_job_id").cast("bigint").alias("id"), "title", "location", "contract", F.date_format("published_at", "yyyy-MM-dd").alias("day"))


@query("SELECT 'https://ex.org/a' || doc_id // 3 AS url, min_by('T' || doc_id, CASE WHEN doc_id % 3 = 2 THEN -1 ELSE doc_id END) AS title, min_by('x ' || doc_id, CASE WHEN doc_id % 3 = 2 THEN -1 ELSE doc_id END) AS extract FROM documents WHERE doc_id % 5 <> 0 GROUP BY doc_id // 3")
def feed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Three feed items name a link in different forms; one stays, the earliest; those without a link or too old are none."""
    k = F.col("doc_id")
    link = F.when(k % 10 == 0, F.lit("")).otherwise(F.concat(F.when(k % 3 == 0, "HTTPS://Ex.org/a").otherwise("https://ex.org/a"), F.floor(k / 3), F.when(k % 3 == 1, "?utm_source=f").when(k % 3 == 2, "/#top").otherwise("")))
    day = F.when(k % 10 == 5, "Mon, 01 Jan 2018 00:00:00 +0000").otherwise(F.concat(F.lit("Tue, 02 Jan 2024 03:"), F.lpad(((k % 3 + 1) % 3).cast("string"), 2, "0"), F.lit(":05 +0000")))
    items = table(spark, d, "documents").select(link.alias("link"), F.concat(F.lit("T"), k).alias("title"), F.concat(F.lit("<p>x "), k, F.lit("</p>")).alias("description"), day.alias("pubDate"))
    return boards.feed(items, F.lit("2020-01-01").cast("timestamp")).select("url", "title", "extract")


_RUNS = "SELECT event_type AS source, CAST(day(ts) AS INT) AS run, count(*) FILTER (WHERE value > 150) AS fetched, count(*) AS attempted, count(*) FILTER (WHERE event_id % 4 = 0) AS failed, " + ", ".join(f"count(*) FILTER (WHERE user_id % 3 = {b} AND value > 100) AS b{b}" for b in range(3)) + " FROM events GROUP BY ALL"


@query(
    f"""WITH r AS ({_RUNS}), m AS (SELECT *, avg(fetched) OVER (PARTITION BY source ORDER BY run ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS mean, {', '.join(f'b{b} = 0 AND coalesce(lag(b{b}) OVER (PARTITION BY source ORDER BY run), 0) >= 3 AS d{b}' for b in range(3))} FROM r),
k AS (SELECT *, CASE WHEN fetched = 0 AND mean >= 1 THEN 'no_results' WHEN failed / attempted > 0.3 THEN 'requests_failed' WHEN d0 OR d1 OR d2 THEN 'board_empty' END AS kind FROM m)
SELECT source, run, kind, round(mean, 4) AS mean, CASE WHEN kind = 'board_empty' THEN array_to_string(list_filter([CASE WHEN d0 THEN 'b0' END, CASE WHEN d1 THEN 'b1' END, CASE WHEN d2 THEN 'b2' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS down FROM k WHERE kind IS NOT NULL"""
)
def outage_ladder(spark: SparkSession, d: str) -> DataFrame:
    """The outage rules over daily runs of each event type: nothing against the mean, too many failures, boards that fell silent."""
    value, of = F.col("value"), F.col("user_id") % 3
    board = lambda b: F.count_if((of == b) & (value > 100))
    runs = table(spark, d, "events").groupBy(F.col("event_type").alias("source"), F.dayofmonth("ts").alias("run")).agg(
        F.count_if(value > 150).alias("fetched"), F.count("*").alias("attempted"), F.count_if(F.col("event_id") % 4 == 0).alias("failed"), F.create_map(*[x for b in range(3) for x in (F.lit(f"b{b}"), board(b))]).alias("boards")
    )
    return lifecycle.outages(runs, 3, 1, 0.3, 3).select("source", "run", "kind", "mean", F.array_join("boards", ",").alias("down"))


_HASH = "repeat('ab', 32)"


@composed(
    {"skill": ["'ansible'", "'go' || k", "'azure'", "'ansible'"], "score": ["k", "k + 20", "-n", "n"], "day": ["'2024-03-' || (10 + n)", "'2024-02-' || (25 + n)", "NULL", "'2024-03-1'"], "status": ["'200'", "NULL", "CAST(n AS STRING)", "'429'"], "counters": ["'{\"calls\":' || k || '}'", "'{\"calls\":-' || k || '}'", "'[]'", "'{}'"]},
    {"skill_ok": ("BOOLEAN", ["true", "false", "true", "true"]), "usage_ok": ("BOOLEAN", ["true", "n <= 4", "false", "false"]), "disagreement_ok": ("BOOLEAN", ["true", "k <= 80", "false", "true"]), "run_ok": ("BOOLEAN", ["true", "false", "false", "true"])},
)
def mirror_rows(rows: DataFrame) -> DataFrame:
    """Validators of the other mirrored rows: skill choices, usage, disagreements and runs."""
    at, number = F.lit("2024-01-01T00:00:00"), F.abs("score").cast("string")
    skill = _entries(skill=F.col("skill"), created_at=at)
    usage = _entries(day=F.col("day"), provider=F.lit("p"), model=F.lit("m"), calls=number, tokens_in=number, tokens_out=number)
    differ = _entries(id=F.col("o_orderkey") + 1, job_key=F.lit("jobs:1"), hash=F.expr(_HASH), python_score=F.col("score"), python_section=F.lit("strong"), ai_score=F.lit("5"), ai_level=F.lit("bon"), kind=F.lit("gap"), created_at=at)
    ran = _entries(id=F.col("o_orderkey") + 1, started_at=at, finished_at=at, outcome=F.lit("ok"), http_status=F.col("status"), provider=F.lit(None), counters=F.col("counters"))
    return rows.select("o_orderkey", validation.skill_override(skill, ["ansible", "azure"]).alias("skill_ok"), validation.usage(usage, ["p"]).alias("usage_ok"), validation.disagreement(differ, ["bon"], ["gap"]).alias("disagreement_ok"), validation.run(ran, ["ok"], ["p"]).alias("run_ok"))


@composed(
    {
        "application": ["'{\"status\":\"applied\",\"applied_at\":\"2024-02-' || (20 + n) || '\",\"note\":\"\"}'", "'{\"status\":\"lost' || k || '\"}'", "'{\"status\":\"applied\",\"more\":' || k || '}'", "'[' || k || ']'", "'{\"status\":\"applied\",\"note\":' || k || '}'", "'{\"status\":\"applied\",\"cv_url\":\"http://x/' || k || '\"}'"],
        "decision": ["'{\"job_key\":\"jobs:' || c || '\",\"label\":\"good_fit\",\"score_at_decision\":' || k || '}'", "'{\"job_key\":\"no key\",\"label\":\"good_fit\"}'", "'{\"job_key\":\"jobs:' || c || '\",\"label\":\"nice\"}'", "'{\"job_key\":\"jobs:' || c || '\",\"label\":\"good_fit\",\"score_at_decision\":\"' || k || '\"}'", "'{\"job_key\":\"jobs:' || c || '\",\"label\":\"good_fit\",\"score_at_decision\":' || (k + 50) || '}'", "'no json ' || k"],
        "message": ["'{\"message_id\":\"m' || k || '\",\"text\":\"\",\"date\":\"2024-01-02T03:04:05Z\"}'", "'{\"message_id\":\"m ' || k || '\",\"text\":\"x\"}'", "'{\"message_id\":\"m' || k || '\",\"subject\":' || n || ',\"text\":\"x\"}'", "'{\"message_id\":\"m' || k || '\",\"date\":\"soon\",\"text\":\"x\"}'", "'{\"message_id\":\"m' || k || '\"}'", "'{\"message_id\":\"m' || k || '\",\"from\":\"\",\"text\":\"x\"}'"],
        "action": ["'{\"action\":\"correct\",\"application_key\":\"jobs:' || c || '\",\"kind\":\"refus\"}'", "'{\"action\":\"correct\",\"kind\":\"refus\"}'", "'{\"action\":\"x' || k || '\"}'", "'{\"action\":\"confirm\",\"kind\":\"x' || k || '\"}'", "'{\"action\":\"ignore\",\"application_key\":\"\"}'", "'{\"action\":\"confirm\",\"interview_at\":\"1999-01-0' || n || '\"}'"],
    },
    {
        "application_error": ("VARCHAR", ["NULL", "'status: not an allowed value'", "'body: unknown field'", "'body: must be a JSON object'", "'note: must be text of at most 2000 characters'", "'cv_url: must be an https URL'"]),
        "decision_error": ("VARCHAR", ["NULL", "'job_key: invalid'", "'label: not an allowed value'", "'score_at_decision: must be an integer 0-100 or null'", "CASE WHEN k > 50 THEN 'score_at_decision: must be an integer 0-100 or null' END", "'body: must be a JSON object'"]),
        "message_error": ("VARCHAR", ["NULL", "'message_id: invalid'", "'subject: must be text'", "'date: must be an ISO date'", "'text: must be text'", "NULL"]),
        "action_error": ("VARCHAR", ["NULL", "'correct: needs application_key and kind'", "'action: not an allowed value'", "'kind: not an allowed value'", "NULL", "'interview_at: must be YYYY-MM-DD'"]),
    },
)
def body_rows(rows: DataFrame) -> DataFrame:
    """The first rule that a call's body breaks, for the four kinds of bodies."""
    return rows.select(
        "o_orderkey", validation.application_body(F.col("application"), _STATUSES).alias("application_error"), validation.decision_body(F.col("decision"), _LABELS).alias("decision_error"),
        validation.message_body(F.col("message")).alias("message_error"), validation.action_body(F.col("action"), ["confirm", "correct", "ignore"], ["refus", "entretien"]).alias("action_error"),
    )


_AT = "2024-05-01 00:00:00"
_LIFE = f"""s0 AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'REJECTED' ELSE 'ELIGIBLE' END AS tier, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate END AS closed_at, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS checked_at, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS notified_at FROM orders)"""


@query(
    f"""WITH {_LIFE} SELECT id, CASE WHEN id % 11 IN (2, 4) THEN NULL WHEN id % 11 = 1 THEN TIMESTAMP '{_AT}' ELSE closed_at END AS closed_at, CASE WHEN id % 11 = 4 THEN NULL WHEN id % 11 IN (0, 1, 2) THEN TIMESTAMP '{_AT}' ELSE checked_at END AS checked_at,
  CASE WHEN id % 11 = 3 AND NOT (tier = 'ELIGIBLE' AND id % 7 <> 0) THEN TIMESTAMP '{_AT}' WHEN id % 11 = 3 THEN NULL WHEN tier = 'ELIGIBLE' AND notified_at >= TIMESTAMP '1996-01-01' AND id % 7 <> 0 THEN NULL ELSE notified_at END AS notified_at FROM s0"""
)
def life_setters(spark: SparkSession, d: str) -> DataFrame:
    """All six setters one after the other: checked, closed, open, notified, reopened, and notices reset since a day."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    rows = table(spark, d, "orders").select(k.alias("id"), F.when(F.col("o_orderstatus") == "F", "REJECTED").otherwise("ELIGIBLE").alias("tier"), F.when(k % 4 == 0, day).alias("closed_at"), F.when(k % 2 == 0, day).alias("checked_at"), F.when(k % 5 != 0, day).alias("notified_at"))
    ids = rows.select("id")  # those of the table; taken from the rows of the step before, they carry its joins along
    for i, name in enumerate(("mark_checked", "mark_closed", "mark_open", "mark_notified", "reopen")):
        rows = lifecycle.set_life(rows, name, ids.where(F.col("id") % 11 == i), F.lit(_AT).cast("timestamp"))
    reset = lifecycle.reset_notified(rows, F.lit("1996-01-01").cast("timestamp"), ids.where("id % 7 = 0"))
    return reset.select("id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("closed_at", "checked_at", "notified_at")])


@query(
    """SELECT 'source' AS grouping, o_orderpriority AS key, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'company', CAST(o_custkey AS VARCHAR), count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'board', o_orderstatus, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'department', coalesce(CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey % 6 AS VARCHAR) END, '?'), count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'area', CASE WHEN o_orderkey % 6 IN (1, 2) THEN 'north' ELSE 'other' END, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'keyword', w, count(*) FROM (SELECT unnest(CASE WHEN o_orderkey % 2 = 0 THEN ['devops', 'sre'] ELSE ['sre'] END) AS w FROM orders) GROUP BY 2"""
)
def grouped_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts by source, company, board, department (? where unknown), area and keyword, in one pass over the rows."""
    k = F.col("o_orderkey")
    keyed = {"source": F.col("o_orderpriority"), "company": F.col("o_custkey").cast("string"), "board": F.col("o_orderstatus"), "department": F.coalesce(F.when(k % 6 != 0, (k % 6).cast("string")), F.lit("?")), "area": F.when((k % 6).isin(1, 2), "north").otherwise("other")}
    words = F.when(k % 2 == 0, F.array(F.lit("devops"), F.lit("sre"))).otherwise(F.array(F.lit("sre")))
    one = lambda name, key: F.struct(F.lit(name).alias("grouping"), key.alias("key"))
    each = F.concat(F.array(*[one(name, key) for name, key in keyed.items()]), F.transform(words, lambda w: one("keyword", w)))
    return table(spark, d, "orders").select(F.explode(each).alias("g")).groupBy("g.grouping", "g.key").agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT o_custkey % 5 AS source, o_orderkey % 8 AS k, o_orderdate AS kept, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 20 AS INTEGER)) END AS sent FROM orders)
SELECT source, count(*) AS seen, count(*) FILTER (WHERE k > 0) AS kept, count(*) FILTER (WHERE k > 2) AS sent, count(*) FILTER (WHERE k > 4) AS replies, count(*) FILTER (WHERE k = 7) AS interviews, count(*) FILTER (WHERE k IN (5, 6)) AS refusals,
  round(count(*) FILTER (WHERE k > 4) / nullif(count(*) FILTER (WHERE k > 2), 0), 4) AS reply_rate, round(count(*) FILTER (WHERE k = 7) / nullif(count(*) FILTER (WHERE k > 4), 0), 4) AS interview_rate,
  round(avg(date_diff('day', CAST(kept AS DATE), CAST(sent AS DATE))) FILTER (WHERE k > 2), 4) AS mean_days, count(*) FILTER (WHERE k > 2 AND sent IS NULL) AS undated FROM s GROUP BY source"""
)
def funnel_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Per source: seen, kept, sent, replies, interviews and refusals, their rates, the mean delay, and what has no date."""
    order, sent_at = F.col("o_orderkey"), F.when(F.col("o_orderkey") % 3 != 0, F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 20).cast("int")))
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 5).alias("source"), (order % 8).alias("k"), F.to_date("o_orderdate").alias("kept_at"), sent_at.alias("sent_at"))
    k = F.col("k")
    return rows.groupBy("source").agg(
        F.count("*").alias("seen"), F.count_if(k > 0).alias("kept"), F.count_if(k > 2).alias("sent"), F.count_if(k > 4).alias("replies"), F.count_if(k == 7).alias("interviews"), F.count_if(k.isin(5, 6)).alias("refusals"),
        F.round(F.try_divide(F.count_if(k > 4), F.count_if(k > 2)), 4).alias("reply_rate"), F.round(F.try_divide(F.count_if(k == 7), F.count_if(k > 4)), 4).alias("interview_rate"),
        F.round(F.avg(F.when(k > 2, F.datediff("sent_at", "kept_at"))), 4).alias("mean_days"), F.count_if((k > 2) & F.col("sent_at").isNull()).alias("undated"),
    )
