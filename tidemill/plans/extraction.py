"""Registered queries of the normalising functions, the extractors and the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import funding as U
from ..functions import places as P
from ..functions import text as T
from ..operators import relational as R
from ..operators import scoring
from .registry import big, cases, query, table

# --- names, titles, texts ----------------------------------------------------------------------


@cases(
    "s string",
    {"folded": "VARCHAR"},
    [("Crème Brûlée — l'Été_2", "creme brulee l ete_2"), ("ﬁn ﬀ ＡＢＣ", "fin ff abc"), ("été", "ete"), ("Ệnh ½ ™", "enh 1 2 tm"), ("œuvre Æther Straße", "oeuvre aether strasse"), ("  a.b--c  ", "a b c"), ("", ""), ("Ингénieur", "ингenieur")],
)
def fold_cases(rows: DataFrame) -> DataFrame:
    return rows.select("n", T.fold(F.col("s")).alias("folded"))


@cases(
    "a string, b string",
    {"contract": "VARCHAR"},
    [
        ("CDD ou CDI", "", "CDD"), ("CDI", None, "CDI"), ("Contrat à durée indéterminée", "", "CDI"), ("Mission d'intérim", "cdi", "INTERIM"), ("", "Alternance 24 mois, CDI ensuite", "ALTERNANCE"), ("temps plein", "Fixed-term contract", "CDD"),
        ("Full-time", "", "UNKNOWN"), (None, None, "UNKNOWN"), ("Portage salarial", "", "FREELANCE"), ("Internship", "permanent", "STAGE"), ("international", "", "UNKNOWN"), ("Contrat de professionnalisation", "", "ALTERNANCE"),
    ],
)
def contract_cases(rows: DataFrame) -> DataFrame:
    return rows.select("n", T.contract_type(F.col("a"), F.col("b")).alias("contract"))


@cases(
    "company string, title string",
    {"company_name": "VARCHAR", "title_name": "VARCHAR", "slugs": "VARCHAR"},
    [
        ("A.C.M.E. SAS", "Ingénieur DevOps (H/F) - CDI", "acme", "ingenieur devops", "acme,a-c-m-e-sas"), ("Dassault Systèmes SE", "Développeur f/h stage", "dassault systemes se", "developpeur", "dassaultsystemes,dassault-systemes"),
        ("Groupe Éclair (France)", "Data engineer M/W/D", "groupe eclair france", "data engineer", "eclair"), ("Sasha GmbH", "Hôtesse hf", "sasha", "hotesse", "sashagmbh,sasha-gmbh"),
    ],
)
def name_cases(rows: DataFrame) -> DataFrame:
    slugs = F.when(F.col("n") == 0, F.array(F.lit("acme"), F.lit("a-c-m-e-sas"))).otherwise(T.slugs(F.col("company")))
    return rows.select("n", T.company_name(F.col("company")).alias("company_name"), T.title_name(F.col("title")).alias("title_name"), F.array_join(slugs, ",").alias("slugs"))


@cases(
    "html string",
    {"text": "VARCHAR", "excerpt": "VARCHAR"},
    [
        ("<p>d&eacute;j&#224; &lt;vu&gt;</p><ul><li>un<li>deux</ul>", "déjà\nun\ndeux", "déjà\n\n- un\n- deux"), ("&lt;p&gt;Encoded &amp;amp; markup&lt;/p&gt;", "Encoded & markup", "Encoded &amp; markup"), ("a<br>b<br/>\n\n\nc", "a\nb\nc", "a\nb\n\nc"),
        ("A &bogus; B &#x41; &apos;", "A &bogus; B A '", "A &bogus; B A '"), (None, "", ""), ("<div>  one\t two </div>", "one two", "one two"), ("x &#128512; y", "x 😀 y", "x 😀 y"),
    ],
)
def html_cases(rows: DataFrame) -> DataFrame:
    return rows.select("n", T.html_text(F.col("html")).alias("text"), T.description_excerpt(F.col("html")).alias("excerpt"))


@cases(
    "s string, term string",
    {"snippet": "VARCHAR"},
    [
        ("Nous cherchons. - Du Kubernetes en production; et le reste", "kubernetes", "Du Kubernetes en production"), ("Sans fin " * 30 + "docker " + "encore " * 40, "docker", None), ("node.js et asp.net", "asp.net", "node.js et asp.net"), ("• puce avec Ansible\nautre", "ansible", "puce avec Ansible"),
        ("rien ici", "python", None),
    ],
)
def snippet_cases(rows: DataFrame) -> DataFrame:
    at = F.coalesce(*[F.when(F.col("term") == t, T.find_term(F.col("s"), [t])) for t in ("kubernetes", "docker", "asp.net", "ansible", "python")])
    found = rows.withColumn("at", at)
    said = T.snippet(F.col("s"), F.col("at.start"), F.col("at.stop"))
    fits = (F.length(said) <= 160) & said.startswith("…") & said.endswith("…") & F.contains(said, F.lit("docker"))
    return found.select("n", F.when(F.col("at").isNotNull(), F.when(F.length("s") <= 160, said).when(fits, None).otherwise("too long")).alias("snippet"))


@cases(
    "s string",
    {"sentences": "VARCHAR", "lines": "VARCHAR"},
    [
        ("M. Dupont lève 5 M€ en mai.L'entreprise grandit. Elle recrute.\n- Puce", "M. Dupont lève 5 M€ en mai.|L'entreprise grandit.|Elle recrute.|Puce", "M|Dupont lève 5 M€ en mai.L'entreprise grandit|Elle recrute|- Puce"),
        ("Acme Inc. raised. It grew 3.5 times! Why?", "Acme Inc. raised.|It grew 3.5 times!|Why?", "Acme Inc|raised|It grew 3.5 times|Why"), ("", "", ""), ("un; deux\n\ntrois", "un; deux|trois", "un|deux|trois"),
    ],
)
def sentence_cases(rows: DataFrame) -> DataFrame:
    return rows.select("n", F.array_join(T.prose_sentences(F.col("s")), "|").alias("sentences"), F.array_join(T.word_sentences(F.col("s")), "|").alias("lines"))


@cases(
    "s string",
    {"profile": "VARCHAR"},
    [
        ("Mission\nfaire\nProfil recherché :\nPython\nanglais courant\nAvantages\nrien", "Python\nanglais courant"), ("Compétences : Ansible, Go\n- et SQL\nPoste\nici", "Ansible, Go\n- et SQL"), ("Rien de tel", ""),
        ("- Profil\nxx", ""), ("Vous avez un vrai sens du service client et du produit\nok", ""), ("Savoir-être\nrigueur\nDescription du poste : tout\nfin", "rigueur"), (None, ""),
    ],
)
def profile_cases(rows: DataFrame) -> DataFrame:
    return rows.select("n", T.profile_text(F.col("s")).alias("profile"))


_ALIASES = {"kubernetes": ["k8s", "kube"], "javascript": ["js"], "ci/cd": ["cicd"]}


@cases(
    "name string",
    {"skill": "VARCHAR"},
    [("K8S", "kubernetes"), ("  CI/CD ", "ci/cd"), ("js", None), ("python", "python"), ("", None), ("kube", "kubernetes"), ("cobol", None)],
)
def skill_cases(rows: DataFrame) -> DataFrame:
    return rows.select("n", T.canonical_skill(F.col("name"), _ALIASES, ["Kubernetes", "CI/CD", "python"]).alias("skill"))


@cases(
    "s string, term string",
    {"at": "INT"},
    [("java et javascript", "java", 0), ("javascript", "java", None), ("du CI/CD ici", "ci/cd", 3), ("Éclair é", "é", 7), ("c++, c", "c++", 0), ("un .NET", ".net", 3)],
)
def term_cases(rows: DataFrame) -> DataFrame:
    at = F.coalesce(*[F.when(F.col("term") == t, T.find_term(F.col("s"), [t])["start"]) for t in ("java", "ci/cd", "é", "c++", ".net")])
    return rows.select("n", at.alias("at"))


@cases(
    "url string",
    {"form": "VARCHAR"},
    [("https://boards.greenhouse.io/acme/jobs/1", "greenhouse"), ("https://jobs.lever.co/x", "lever"), ("https://notlever.co/x", None), ("https://JOBS.ASHBYHQ.com/a", "ashby"), ("nothing", None)],
)
def form_host_cases(rows: DataFrame) -> DataFrame:
    return rows.select("n", T.form_host(F.col("url")).alias("form"))


@cases(
    "hay string, q string",
    {"hit": "BOOLEAN"},
    [("Ingénieur DevOps Acme Paris", "paris ingenieur", True), ("Ingénieur", "devops", False), ("C# (.NET)", "c# .net", True), ("abc", "  ", True), (None, "x", False)],
)
def search_cases(rows: DataFrame) -> DataFrame:
    return rows.select("n", T.matches_words(F.col("hay"), F.col("q")).alias("hit"))


@cases(
    "place string, options array<string>",
    {"salary": "VARCHAR", "option": "INT"},
    [("75 - Paris", ["30-35 k€", "40-45k", "50 k et plus"], "55-60", 1), ("Lyon 3e", ["40 000", "42 000 €"], "48-52", None), ("Brest", ["< 20k", "45000"], "42-46", 1), ("", [], "42-46", None)],
)
def salary_cases(rows: DataFrame) -> DataFrame:
    zones = [(["paris", "ile de france"], "55-60"), (["lyon"], "48-52")]
    return rows.select("n", T.salary_benchmark(F.col("place"), zones, "42-46").alias("salary"), T.salary_option(F.col("options"), 38000, 46000).alias("option"))


@query("SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(strip_accents(replace(replace(replace(replace(replace(lang || ' ' || source, 'œ', 'oe'), 'Œ', 'OE'), 'æ', 'ae'), 'Æ', 'AE'), 'ß', 'ss'))), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) || chr(10) || substr(text, 1, 200)) AS hash FROM documents")
def card_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.card_hash(F.concat_ws(" ", "lang", "source"), F.substring("text", 1, 200)).alias("hash"))


# --- experience, reserved posts, funding ------------------------------------------------------------


@cases(
    "s string",
    {"status": "VARCHAR", "min_years": "DOUBLE", "max_years": "DOUBLE", "evidence": "VARCHAR", "flag": "BOOLEAN"},
    [
        ("Au moins 3 ans d'expérience, hors stage et alternance.", "EXPLICIT", 3.0, None, "Au moins 3 ans", True), ("2 à 5 ans", "EXPLICIT", 2.0, 5.0, "2 à 5 ans", False), ("deux ans d'expérience, minimum 5 ans", "EXPLICIT", 5.0, None, "minimum 5 ans", False),
        ("Fondée en 2018. Jusqu'à 2 ans", "EXPLICIT", None, 2.0, "Jusqu'à 2 ans", False), ("Profil junior bienvenu", "UNKNOWN", None, None, "junior", False), ("deux années consécutives", "NOT_MENTIONED", None, None, None, False), ("3+ years, 5+ years", "EXPLICIT", 5.0, None, "5+ years", False),
        ("Un anglais courant", "NOT_MENTIONED", None, None, None, False), (None, "NOT_MENTIONED", None, None, None, False), ("three to five years", "EXPLICIT", 3.0, 5.0, "three to five years", False), ("1 an d'expérience ou 4 ans", "EXPLICIT", 1.0, None, "1 an d'expérience", False),
        ("moins de 5 ans, up to 3 years", "EXPLICIT", None, 3.0, "up to 3 years", False),
    ],
)
def experience_cases(rows: DataFrame) -> DataFrame:
    x = rows.select("n", X.experience(F.col("s")).alias("x"))
    return x.select("n", "x.status", "x.min_years", "x.max_years", "x.evidence", F.col("x.excludes_apprenticeship").alias("flag"))


@cases(
    "title string, s string",
    {"years": "DOUBLE", "basis": "VARCHAR", "sentence": "VARCHAR"},
    [
        ("Lead dev", "Rien. Un expert est attendu.", 7.0, "seniority", "Un expert est attendu"), ("Senior dev", "au moins 2 ans", 2.0, "explicit", "au moins 2 ans"), ("Dev", "jusqu'à 2 ans", None, "explicit", "jusqu'à 2 ans"), ("Dev", "premier emploi", None, "unknown", "premier emploi"), ("Dev", "rien", None, "not_mentioned", None),
        ("Leader", "x", None, "not_mentioned", None), ("Senior", "lead", 5.0, "seniority", "Senior"),
    ],
)
def seniority_cases(rows: DataFrame) -> DataFrame:
    return rows.select("n", X.required_years(F.col("title"), F.col("s")).alias("x")).select("n", "x.years", "x.basis", "x.sentence")


#: Towns and adjectives, folded, as a caller would give them.
_COUNTRIES = {"suisse": "Switzerland", "geneve": "Switzerland", "london": "United Kingdom", "lyon": "France", "paris": "France", "parisienne": "France", "french": "France", "german": "Germany", "berlin": "Germany", "spanish": "Spain", "madrid": "Spain"}
_NAMES = ["Talents Handicap", "Hanploi"]


@cases(
    "company string, s string",
    {"reserved": "VARCHAR", "recruiter": "VARCHAR", "client": "VARCHAR", "note": "VARCHAR"},
    [
        ("Acme", "Bonjour. Poste réservé aux travailleurs handicapés. Fin.", "Poste réservé aux travailleurs handicapés", None, None, None), ("Acme", "Ce poste n'est pas réservé aux personnes handicapées.", None, None, None, None), ("Acme", "RQTH obligatoire", "RQTH obligatoire", None, None, None),
        ("Acme", "Nos postes sont ouverts aux personnes en situation de handicap", None, None, None, None), ("Acme", "uniquement aux bénéficiaires du RSA", None, None, None, None), ("Acme", "uniquement aux bénéficiaires de l'obligation d'emploi", "uniquement aux bénéficiaires de l'obligation d'emploi", None, None, None),
        ("Forums Talents Handicap", "L'entreprise Zed recherche un dev", None, "Talents Handicap", "Zed", "publié par Talents Handicap (recruteur spécialisé RQTH) — le poste peut exister en direct chez Zed"),
        ("X", "Hanploi accompagne les sociétés dans leurs recrutements de salariés en situation de handicap", None, "Hanploi", None, "publié par Hanploi (recruteur spécialisé RQTH)"), ("X", "Nous serons au forum Hanploi", None, None, None, None), (None, None, None, None, None, None),
        ("X", "Pour le compte de notre client Delta Conseil, nous cherchons", None, None, "Delta Conseil", None),
    ],
)
def reserved_cases(rows: DataFrame) -> DataFrame:
    found = rows.select("n", X.reserved_sentence(F.col("s")).alias("reserved"), X.specialised_recruiter(F.col("company"), F.col("s"), _NAMES).alias("recruiter"), X.end_client(F.col("s")).alias("client"))
    return found.select("*", X.recruiter_note(F.col("recruiter"), F.col("client")).alias("note"))


@cases(
    "s string",
    {"amount": "DOUBLE", "currency": "VARCHAR", "round": "VARCHAR", "shown": "VARCHAR"},
    [
        ("Acme lève 10 M€ en série A", 1e7, "EUR", "series a", "10 M€"), ("Sur un marché de 3 milliards d'euros, Acme lève 10 millions d'euros", 1e7, "EUR", None, "10 M€"), ("Acme raises $1.5bn from its investors", 1.5e9, "USD", None, "$1.5B"), ("Il lève le voile sur 10 M€", None, None, None, None),
        ("Acme avait levé 5 M€ en 2020", None, None, None, None), ("Acme grandit de 12 %", None, None, None, None), ("Acme boucle un tour de table de 500 000 euros en pré-amorçage", 5e5, "EUR", "pre-seed", "500 k€"), ("Acme secures £1.25m in seed funding", 1.25e6, "GBP", "seed", "1,25 M£"),
        ("Acme lève 2 M€ et vise 8 M€ de chiffre d'affaires", 2e6, "EUR", None, "2 M€"), ("Acme lève 500 euros", None, None, None, None), ("Acme a levé dix millions de dollars", 1e7, "USD", None, "$10M"), ("Acme annonce une levée de fonds", None, None, None, None), ("Acme raises 10% of $5M", 5e6, "USD", None, "$5M"),
        ("Acme lève 1.200.000 euros", 1.2e6, "EUR", None, "1,2 M€"), ("Partech closes its third fund at €300M for a new fund", None, None, None, None),
    ],
)
def funding_cases(rows: DataFrame) -> DataFrame:
    x = rows.select("n", U.funding_amount(F.col("s")).alias("x"), U.funding_round(F.col("s")).alias("round"))
    return x.select("n", F.col("x.value").alias("amount"), "x.currency", F.when(F.col("x").isNotNull(), F.col("round")).alias("round"), U.format_amount(F.col("x.value"), F.col("x.currency")).alias("shown"))


@cases(
    "s string, company string",
    {"named": "VARCHAR", "investors": "VARCHAR", "hiring": "VARCHAR", "location": "VARCHAR", "country": "VARCHAR"},
    [
        ("La startup suisse Bolt Labs, basée à Genève, boucle un tour de table mené par le fonds Accel", "Bolt Labs", "Bolt Labs", "Accel", None, "Genève", "Switzerland"),
        ("Acme lève 5 M€ auprès de Partech, Bpifrance et ses business angels pour recruter 50 ingénieurs", "Acme", "Acme", "Partech|Bpifrance|business angels", "recruter 50 ingénieurs", None, None), ("Elle lève 5 M€", None, None, None, None, None, None),
        ("London-based Zed has raised $5M from Sequoia and Index Ventures, and is hiring", "Zed", "Zed", "Sequoia|Index Ventures", "is hiring", None, "United Kingdom"), ("Foo annonce une levée de fonds et va doubler ses effectifs", "Foo", "Foo", None, "doubler ses effectifs", None, None),
        ("Bar, plateforme de recrutement, lève 2 M€ ; un plan social et 30 embauches", "Bar", "Bar", None, None, None, None),
    ],
)
def funding_story_cases(rows: DataFrame) -> DataFrame:
    s = F.col("s")
    found = rows.withColumn("f", U.funding_sentence(s))
    return found.select(
        "n", U.company_before(s, F.col("f.anchor")).alias("named"), F.array_join(U.investors(s, F.col("company")), "|").alias("investors"), U.hiring(s).alias("hiring"), U.location(s).alias("location"), U.country(s, _COUNTRIES).alias("country")
    )


@cases(
    "title string, text string",
    {"is_funding": "BOOLEAN", "company": "VARCHAR", "amount": "DOUBLE", "round": "VARCHAR", "investors": "VARCHAR", "hiring": "VARCHAR", "location": "VARCHAR", "country": "VARCHAR", "priority": "VARCHAR", "reason": "VARCHAR"},
    [
        ("Acme lève 10 M€", "Acme, basée à Lyon, annonce une levée de fonds de 10 M€ en seed, menée par Partech.\nUn autre sujet.\nLes fonds serviront à recruter 20 personnes.", True, "Acme", 1e7, "seed", "Partech", "recruter 20 personnes", "Lyon", "France", "high", "funding 10 M€ seed; hiring: recruter 20 personnes"),
        ("Rien de neuf", "Un texte sans argent.", False, None, None, None, None, None, None, None, "normal", "funding amount unknown"),
        ("Foo lève 5 M€ / Bar rachète Baz", "Foo, startup parisienne, lève 5 M€.\nBar va recruter 10 personnes.", True, "Foo", 5e6, None, None, None, None, "France", "normal", "funding 5 M€"),
        ("Zed raises $20M", "Zed closes a Series B round of $20M led by Index Ventures. The company plans to hire 30 engineers.", True, "Zed", 2e7, "series b", "Index Ventures", "plans to hire", None, None, "high", "funding $20M series b; hiring: plans to hire"),
        (None, None, False, None, None, None, None, None, None, None, "normal", "funding amount unknown"),
    ],
)
def funding_article_cases(rows: DataFrame) -> DataFrame:
    a = U.articles(rows.select(F.col("n").alias("id"), "title", "text"), _COUNTRIES)
    return a.select(
        F.col("id").alias("n"), "is_funding", "company", "amount", "round", F.array_join("investors", "|").alias("investors"), "hiring", "location", "country",
        U.lead_priority(F.col("hiring")).alias("priority"), U.lead_reason(F.col("amount"), F.col("currency"), F.col("round"), F.col("hiring")).alias("reason"),
    )


# --- places ---------------------------------------------------------------------------------------------

#: A small table of places; any official list has the same form.
_TOWNS = [("Nanterre", ["92"], False), ("Lille", ["59"], False), ("Belgique", [], True), ("Porto", [], True), ("Porto-Vecchio", ["2A"], False), ("Saint-Denis", ["93"], False), ("Saint-Denis", ["974"], False), ("Paris", ["75"], False), ("Eu", ["76"], False)]


@cases(
    "location string, source string",
    {"departments": "VARCHAR", "department": "VARCHAR", "french": "BOOLEAN", "block_key": "VARCHAR", "national": "BOOLEAN", "north": "BOOLEAN"},
    [
        ("92 - Nanterre", "home", "92", "92", True, "92", True, False), ("Nanterre", "x", "92", "92", True, "92", True, False), ("Lille, Belgique", "x", "", None, False, "lille belgique", False, False), ("Porto Vecchio", "x", "2A", "2A", True, "2A", True, False),
        ("Saint-Denis", "x", "93,974", None, True, "saint denis", True, False), ("Île-de-France", "x", "75,77,78,91,92,93,94,95", None, True, "ile de france", True, False), ("Austin, TX", "x", "", None, False, "austin tx", False, False), ("20137 Porto-Vecchio", "x", "2A", "2A", True, "2A", True, False),
        ("Télétravail", "x", "", None, None, "teletravail", True, True), ("", "x", "", None, None, "", False, True), ("", "home", "", None, None, "", True, True), ("99 - ALLEMAGNE", "home", "99", "99", False, "99", False, False), ("75015 Paris", "x", "75", "75", True, "75", True, False),
        ("France", "x", "", None, True, "france", True, True), ("Eu", "x", "76", "76", True, "76", True, False), ("Eu, Inconnue", "x", "", None, None, "eu inconnue", False, True), ("Hauts-de-France", "x", "02,59,60,62,80", None, True, "hauts de france", True, True), ("59 - Lille", "home", "59", "59", True, "59", True, True),
        ("97139 Les Abymes", "x", "971", "971", True, "971", True, False), (None, "x", "", None, None, "", False, True),
    ],
)
def place_cases(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    found = P.resolve(rows, P.table(spark, spark.createDataFrame(_TOWNS, P.SCHEMA)))
    gate = lambda scope: P.allowed(F.col("location"), F.col("departments"), F.col("french"), F.col("source"), [], scope, "home")
    return found.select("n", F.array_join("departments", ",").alias("departments"), "department", "french", "block_key", gate([]).alias("national"), gate(["59"]).alias("north"))


@query("SELECT o_orderkey, CASE (o_custkey % 5) WHEN 0 THEN '92' WHEN 1 THEN '59' WHEN 2 THEN '2A' WHEN 3 THEN NULL ELSE '75' END AS department, CASE WHEN o_custkey % 5 = 3 THEN false ELSE true END AS french FROM orders")
def place_scan(spark: SparkSession, d: str) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(x) for x in ("Nanterre (92)", "Lille Nord", "Porto Vecchio", "Lille, Belgique", "75008 PARIS")]), (F.col("o_custkey") % 5 + 1).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", said.alias("location"))
    return P.resolve(rows, P.table(spark, spark.createDataFrame(_TOWNS, P.SCHEMA))).select("o_orderkey", "department", "french")


# --- questions, skills of an offer, the gate and the score ------------------------------------------------

_WORDS = {"sensitive": ["handicap", "gender"], "salary": ["salaire", "salary expectation"], "consent": ["j accepte", "privacy"], "email": ["email", "e mail"], "phone": ["telephone", "phone"], "cover_letter": ["lettre de motivation", "cover letter"]}


@cases(
    "label string, kind string, tag string",
    {"category": "VARCHAR"},
    [("Votre e-mail *", "text", "input", "email"), ("Mot de passe", "password", "input", "password"), ("J'accepte la politique", "checkbox", "input", "consent"), ("Disponible ?", "checkbox", "input", "unknown"), ("Prétentions : salaire", "text", "input", "salary"), ("Situation de handicap", "checkbox", "input", "sensitive"),
     ("Lettre de motivation", "text", "input", "unknown"), ("Lettre de motivation", "", "textarea", "cover_letter"), ("Téléphone", "tel", "input", "phone"), (None, "text", "input", "unknown")],
)
def question_cases(rows: DataFrame) -> DataFrame:
    return rows.select("n", scoring.question_category(F.col("label"), F.col("kind"), F.col("tag"), _WORDS).alias("category"))


_CORE = scoring.TitleRules(core=["devops", "sre"], overrides=["commercial", "product owner"], off_domain=["mecanique", "rh"], near=["systeme", "data"], sectors=["logistique"], points={"core": 20, "near": 10, "other": -15})


@cases(
    "title string",
    {"family": "VARCHAR", "points": "INT"},
    [("Ingénieur DevOps", "core", 20), ("Commercial DevOps", "other", -15), ("Ingénieur mécanique systèmes", "off_domain", 0), ("Data engineer - logistique", "near", 10), ("Technicien logistique", "off_domain", 0), ("Boulanger", "other", -15), ("Administrateur systèmes", "near", 10), ("", "other", -15)],
)
def title_cases(rows: DataFrame) -> DataFrame:
    return rows.select("n", scoring.title_family(F.col("title"), _CORE).alias("f")).select("n", "f.family", "f.points")


_PROFILE = scoring.Profile(
    preferred=[("kubernetes", 3, ["k8s"]), ("ci/cd", 2, ["cicd"]), ("python", 1, [])], negative=[("sap", -10, [])], vocabulary=["terraform", "python"], base=50, multiplier=1.5, titles=_CORE
)


@cases(
    "title string, text string",
    {"score": "INT", "explanations": "VARCHAR", "missing": "VARCHAR", "unlisted": "VARCHAR", "evidence": "VARCHAR", "reasons": "VARCHAR"},
    [
        ("DevOps", "Outils : CI/CD.\nProfil\nBon niveau en CI/CD", 73, "Missed preferred: kubernetes; Profile section: ci/cd (x1.5); Matched preferred: ci/cd (+3); Missed preferred: python; Title relevance: core (+20)", "kubernetes,python", "", "Outils : CI/CD", "ci/cd +3"),
        ("Boulanger", "du K8s; du SAP et du Terraform", 28, "Matched preferred: kubernetes (+3); Missed preferred: ci/cd; Missed preferred: python; Matched negative: sap (-10); Title relevance: other (-15)", "ci/cd,python", "terraform", "du K8s", "sap -10;kubernetes +3"),
        ("SRE", "Compétences : Kubernetes, Python\nfin", 77, "Profile section: kubernetes (x1.5); Matched preferred: kubernetes (+5); Missed preferred: ci/cd; Profile section: python (x1.5); Matched preferred: python (+2); Title relevance: core (+20)", "ci/cd", "", "Compétences : Kubernetes, Python", "kubernetes +5;python +2"),
    ],
)
def score_cases(rows: DataFrame) -> DataFrame:
    s = scoring.score(rows, F.col("title"), F.col("text"), _PROFILE)
    reasons = F.transform(scoring.top_reasons(F.col("weights"), 3), lambda r: F.format_string("%s %+d", r["name"], r["weight"]))
    return s.select(
        "n", "score", F.array_join("explanations", "; ").alias("explanations"), F.array_join("missing", ",").alias("missing"), F.array_join(F.array_sort(F.map_keys("unlisted")), ",").alias("unlisted"),
        F.element_at(F.map_values("evidence"), 1).alias("evidence"), F.array_join(reasons, ";").alias("reasons"),
    )


_GATE = scoring.Gate(profile=_PROFILE, target_titles=["devops", "systeme"], dev_titles=["developpeur", "developer"], role_titles=["devops"], have=3.0, band=2.0, contracts=["CDI"], reserved=True, recruiters=_NAMES)


@cases(
    "title string, company string, contract string, text string, allowed boolean",
    {"reasons": "VARCHAR", "tier": "VARCHAR", "years": "DOUBLE", "basis": "VARCHAR"},
    [
        ("DevOps", "Acme", "CDI", "2 ans d'expérience", True, "", "ELIGIBLE", 2.0, "explicit"), ("DevOps", "Acme", "CDI", "au moins 5 ans", True, "", "STRETCH", 5.0, "explicit"), ("DevOps", "Acme", "CDD", "au moins 8 ans", False, "EXPERIENCE, CONTRACT, LOCATION", "REJECTED", 8.0, "explicit"),
        ("Boulanger", "Acme", "UNKNOWN", "pain", True, "NOT_RELEVANT", "REJECTED", None, "not_mentioned"), ("Développeur Java", "Acme", "CDI", "du kubernetes", True, "NOT_RELEVANT", "REJECTED", None, "not_mentioned"), ("Développeur DevOps", "Acme", "CDI", "x", True, "", "ELIGIBLE", None, "not_mentioned"),
        ("Technicien logistique", "Acme", "CDI", "du python. RQTH obligatoire", True, "TITLE, RESERVED_RQTH", "REJECTED", None, "not_mentioned"), ("DevOps senior", "Hanploi", "CDI", "x", True, "RESERVED_RQTH", "REJECTED", 5.0, "seniority"),
    ],
)
def gate_cases(rows: DataFrame) -> DataFrame:
    g = scoring.evaluate(rows, _GATE, title=F.col("title"), company=F.col("company"), contract=F.col("contract"), text=F.col("text"), location_ok=F.col("allowed"))
    return g.select("n", F.array_join("reasons", ", ").alias("reasons"), "tier", F.col("required.years").alias("years"), F.col("required.basis").alias("basis"))


@cases(
    "text string",
    {"skills": "VARCHAR"},
    [("Python, K8s et Terraform", "kubernetes,python"), ("rien", ""), ("ci/cd; Go", "ci/cd")],
)
def allowed_skill_cases(rows: DataFrame) -> DataFrame:
    return rows.select("n", F.array_join(scoring.skills_named(F.col("text"), [(n, a) for n, _, a in _PROFILE.preferred]), ",").alias("skills"))


_LEADS_SQL = "SELECT o_orderkey, CASE WHEN n_name = 'NATION_3' THEN 'country' WHEN o_totalprice * CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 END < 100000 THEN 'amount' WHEN c_mktsegment = 'MACHINERY' THEN 'sector' END AS reason FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"


@query(_LEADS_SQL)
def lead_exclusion(spark: SparkSession, d: str) -> DataFrame:
    nation = F.broadcast(table(spark, d, "nation"))  # a table of 25 rows at every scale
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    currency = F.element_at(F.array(F.lit("EUR"), F.lit("USD"), F.lit("XXX")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    country = F.when(F.col("n_name") == "NATION_3", "China").when(F.col("n_name") != "NATION_4", "France")
    reason = scoring.lead_exclusion(country, F.col("o_totalprice"), currency, F.lower("c_mktsegment"), countries=["france"], least=100000.0, rates={"USD": 0.9}, sectors=["machin"])
    return rows.select("o_orderkey", reason.alias("reason"))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 7000 THEN 'high' WHEN c_acctbal >= 3000 THEN 'medium' ELSE 'low' END AS band, CAST(count(*) OVER (PARTITION BY c_mktsegment) AS BIGINT) AS n FROM customer")
def skill_bands(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer")
    counts = rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return rows.join(counts, "c_mktsegment").select("c_custkey", scoring.weight_band(F.col("c_acctbal"), [(7000, "high"), (3000, "medium")], "low").alias("band"), "n")


@query("SELECT p_partkey, len(list_filter(['small', 'ring', 'bolt'], lambda w: contains(' ' || lower(p_type || ' ' || p_name) || ' ', ' ' || w || ' '))) > 0 OR starts_with(lower(p_type), 'promo') AS relevant FROM part")
def relevance_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", scoring.relevant(F.col("p_type"), F.col("p_name"), ["promo"], [("small", []), ("ring", []), ("bolt", [])]).alias("relevant"))


@query("SELECT doc_id, CAST(len(list_filter(string_split_regex(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w IN ('the', 'and', 'of'))) AS BIGINT) AS english FROM documents")
def language_words(spark: SparkSession, d: str) -> DataFrame:
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " ")
    return table(spark, d, "documents").select("doc_id", big(F.size(F.filter(words, lambda w: w.isin("the", "and", "of")))).alias("english"))


@query("SELECT o_orderkey, list_filter([CASE WHEN o_totalprice < 50000 THEN 'EXPERIENCE' END, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND o_orderpriority <> '3-MEDIUM' THEN 'CONTRACT' END], lambda x: x IS NOT NULL) = [] AS eligible FROM orders")
def contract_gate(spark: SparkSession, d: str) -> DataFrame:
    contract = F.when(F.col("o_orderpriority") == "3-MEDIUM", "UNKNOWN").otherwise(F.col("o_orderpriority"))
    gates = [("EXPERIENCE", F.col("o_totalprice") < 50000), ("CONTRACT", scoring.contract_rejects(contract, ["1-URGENT", "2-HIGH"]))]
    return table(spark, d, "orders").select("o_orderkey", (F.size(R.reasons(gates)) == 0).alias("eligible"))
