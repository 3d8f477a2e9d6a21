"""Column functions, extractors, sources and links on small tables."""

import random

from pyspark.sql import functions as F
from tidemill.functions import extract as X
from tidemill.functions import text as T
from tidemill.operators import relational as R
from tidemill.operators import similarity
from tidemill.sources import boards


def each(spark, make, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.out for r in rows.select("k", make(F.col("v")).alias("out")).orderBy("k").collect()]


def test_names(spark):
    assert each(spark, T.fold, ["Œuvre d'Été -- N°1_x", "Straße", None]) == ["oeuvre d ete n 1_x", "strasse", None]
    assert each(spark, T.company_name, ["S.N.C.F. S.A.", "Acme GmbH", "Inc"]) == ["sncf", "acme", ""]
    assert each(spark, T.title_name, ["Développeur H/F - CDI", "Stage data"]) == ["developpeur", "data"]
    assert each(spark, T.contract_type, ["Contrat en alternance, CDI ensuite", "CDD de 6 mois", "nothing"]) == ["ALTERNANCE", "CDD", "UNKNOWN"]
    assert each(spark, T.department, ["75 - Paris", "2a - Ajaccio", "Paris"]) == ["75", "2A", None]
    assert each(spark, T.postal_department, ["75011", "20100", "20200", "97400", "x"]) == ["75", "2A", "2B", "974", None]


def test_urls(spark):
    assert each(spark, T.article_url, ["HTTPS://Ex.org/A/?utm_source=x&b=1#t", "https://ex.org", "http://ex.org/?ref=1"]) == ["https://ex.org/A?b=1", "https://ex.org/", "http://ex.org/"]
    assert each(spark, T.safe_url, ["javascript:x", "http://a", "https://"]) == [None, "http://a", None]


def test_texts(spark):
    assert each(spark, lambda c: T.excerpt(c, 10), ["short", "words that are long"]) == ["short", "words that…"]
    assert each(spark, T.sentences, ["One. Two!\nThree; four"]) == [["One.", "Two!", "Three;", "four"]]
    assert each(spark, T.html_text, ["<p>A &amp; <b>b</b></p><script>x</script><li>c</li>"]) == ["A & b\nx\nc"]
    assert each(spark, lambda c: T.language(c, ["the", "and"], ["le", "et"]), ["the cat and", "le chat et", ""]) == ["en", "fr", "fr"]


def test_experience(spark):
    texts = ["3 à 5 ans d'expérience", "au moins deux ans, idéalement 5 ans", "5+ years", "moins de 3 ans", "première expérience", "", "minimum 4 ans, 2 ans de CDD"]
    got = [(r.status, r.min_years, r.max_years) for r in each(spark, X.experience, texts)]
    assert got == [("EXPLICIT", 3, 5), ("EXPLICIT", 2, None), ("EXPLICIT", 5, None), ("EXPLICIT", None, 3), ("UNKNOWN", None, None), ("NOT_MENTIONED", None, None), ("EXPLICIT", 4, None)]
    assert each(spark, lambda c: X.seniority(F.lit("x"), c)["years"], ["junior or senior dev", "dev"]) == [5.0, None]


def test_token_set():
    assert similarity.token_set("a b c", "c b a") == 100
    assert similarity.token_set("a b", "a b c d") == 100
    assert similarity.token_set("", "a") == 0
    assert similarity.common_length("kitten", "sitting") == 4


def brute_links(posts, window):
    """The links by comparing each post with all before it."""
    kept = sorted((p for p in posts if not p["rejected"]), key=lambda p: (p["at"], p["id"]))
    out = []
    for k, b in enumerate(kept):
        before, found = kept[:k], None
        exact = [a for a in before if a["fp"] == b["fp"]]
        if exact:
            found = (exact[0]["id"], b["id"], "exact_fingerprint", 1.0)
        for titles in (False, True):
            for a in before if found is None else []:
                blocked = (a["title"] == b["title"] and (not b["company"] or not a["company"])) if titles else (a["company"] and a["company"] == b["company"])
                if not blocked or a["at"] < b["at"] - window or a["fp"] == b["fp"] or not (a["place"] == b["place"] or not (a["place"] in ("75", "59") and b["place"] in ("75", "59"))):
                    continue
                t, d = similarity.token_set(a["title"], b["title"]), similarity.token_set(a["text"][:1000], b["text"][:1000])
                if t >= 85 and d >= 80:
                    found = (a["id"], b["id"], "fuzzy", round((t + d) / 200 + 1e-9, 3))
                    break
        if found:
            out.append(found)
    return sorted(out)


def test_links_against_all_pairs(spark):
    rng = random.Random(5)
    titles = ["data engineer", "engineer data", "data engineer senior", "cook", "chef cook", "ops"]
    posts = []
    for i in range(300):
        words = [rng.choice("build run cloud pipelines soup team with us you and code".split()) for _ in range(rng.randrange(4, 14))]
        if posts and rng.random() < 0.3:
            words = rng.choice(posts)["text"].split()
            words[rng.randrange(len(words))] = "changed"
        text = " ".join(words)
        posts.append({"id": i, "at": rng.randrange(100), "company": rng.choice(["acme", "zed", "", None]), "title": rng.choice(titles), "place": rng.choice(["75", "59", "france"]), "fp": " ".join(sorted(words)) if rng.random() < 0.5 else text, "text": text, "rejected": rng.random() < 0.1})
    frame = spark.createDataFrame(posts, "id long, at long, company string, title string, place string, fp string, text string, rejected boolean")
    got = sorted((r.parent, r.child, r.reason, round(r.similarity, 3)) for r in similarity.links(frame, 30).collect())
    assert got == brute_links(posts, 30)


def test_common_lengths_of_many_pairs():
    """Lanes of 64 places with carries between them, against the table of all beginnings; any alphabet, empty texts, many sizes."""
    rng = random.Random(6)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            out = [0]
            for j, y in enumerate(b):
                out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
            row = out
        return row[-1]

    texts = ["", "a", "é" * 70, "ab" * 64, "😀b" * 40] + ["".join(rng.choice(letters) for _ in range(rng.choice([1, 5, 63, 64, 65, 128, 130, 200]))) for letters in ("ab", "abcdefgh ", "é😀xyz") for _ in range(25)]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(400)]
    want = [plain(a, b) for a, b in pairs]
    assert similarity.common_lengths(*map(list, zip(*pairs, strict=True))).tolist() == want
    assert [similarity.common_length(a, b) for a, b in pairs] == want
    assert (similarity._letters(*map(list, zip(*pairs, strict=True))) >= want).all()
    assert similarity.common_lengths([], []).tolist() == []


def test_token_set_ratio_agrees_with_the_plain_form(spark):
    rng = random.Random(7)
    pairs = [tuple(" ".join(rng.choice(["a", "bc", "data", "dat", "ops", "x", "ingénieur"]) for _ in range(rng.randrange(6))) for _ in "ab") for _ in range(1500)] + [(None, "a"), ("a", None), ("long " + "word" * 60, "word" * 50 + " long")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    for least in (0, 50, 85):
        for r in rows.select("i", similarity.token_set_ratio(F.col("a"), F.col("b"), least).alias("t")).collect():
            want = similarity.token_set(*pairs[r.i])
            assert abs(r.t - want) < 1e-9 if want >= least else r.t < least


def test_roots_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i - 1 if i else None) for i in range(700)], "id long, parent long")
    assert {r.root for r in R.roots(links).collect()} == {0}


def test_bound_is_never_too_small(spark):
    words = ["a b c", "a b d e", "x", "data engineer senior", "senior data engineer paris", "data", "a", "e d b"]
    rows = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in rows.select("a", "b", similarity.bound(F.col("a"), F.col("b")).alias("most")).collect():
        assert similarity.token_set(r.a, r.b) <= r.most + 1e-9


def test_fold_tests_no_class_of_hundreds_of_ranges_on_a_text(spark):
    """Characters that stand for several are looked up; a class of ranges or of exclusions, tried at every place, took two thirds of the time."""
    plan = spark.range(1).select(T.fold(F.concat(F.lit("x"), "id")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "translate(" in plan
    several = [c for c in T._OTHER][::7]
    rows = spark.createDataFrame([(c, f"A{c}é") for c in several], "c string, s string")
    assert all(r.f == T.fold_plain(r.s) for r in rows.select("s", T.fold(F.col("s")).alias("f")).collect() if "_" not in r.f)


def test_setters_read_the_table_once_a_step(spark, sf_dir):
    """Six setters: the rows, and the ids of each; not the rows of all steps before, twice a step."""
    from tidemill.plans.queries import QUERIES

    plan = QUERIES["life_setters"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("Relation parquet") <= 7, plan.count("Relation")


def test_title_marks_never_rule_out_a_link(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    pairs = [("", ""), ("", "a"), ("a a a", "a"), ("b a", "a  b")]
    for _ in range(1500):
        words = [word() for _ in range(rng.randrange(1, 12))]
        other = [w if rng.random() < 0.8 else (w + "x" if rng.random() < 0.5 else word()) for w in words]
        rng.shuffle(other)
        pairs.append((" ".join(words), " ".join(other[: rng.randrange(1, 14)])))
    rows = spark.createDataFrame([(*p, similarity.title_marks(p[0]), similarity.title_marks(p[1])) for p in pairs], "a string, b string, x array<long>, y array<long>")
    got = rows.select("a", "b", *[similarity.may_reach(*([F.col(c)[i] for i in range(len(similarity.MARKS))] for c in "xy"), r).alias(f"r{r}") for r in (70, 85)]).collect()
    for r in got:
        assert all(r[f"r{least}"] or similarity.token_set(r.a, r.b) < least for least in (70, 85)), r
    assert sum(similarity.token_set(r.a, r.b) >= 85 for r in got) > 100 and sum(not r.r85 for r in got) > 50


def test_few_titles_of_a_block_are_compared_in_full(spark, monkeypatch):
    """Titles of one language and length are told apart by their marks; the exact comparison gets few of the pairs."""
    rng, asked = random.Random(6), []
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    posts = [(i, i // 20, "x", " ".join(rng.choice(words) for _ in range(12)), "lyon", str(i), "t", False) for i in range(200)]
    frame = spark.createDataFrame(posts, "id long, at long, company string, title string, place string, fp string, text string, rejected boolean")
    real = similarity.scored
    monkeypatch.setattr(similarity, "scored", lambda pairs, *rest: asked.append(pairs.count()) or real(pairs, *rest))
    similarity.links(frame, 30).collect()
    assert asked[0] < 200 * 199 / 2 / 5


def test_a_text_cut_behind_a_word_keeps_its_link(spark):
    """The space at the cut is no word; the bound that counted it lost links of a similarity of 80."""
    text = "a ab b c"
    pairs = [(text + " ", other) for other in ("a ab b d", "ab b cc", "a b c e")] + [("aaaaaaaa bbb ", "aaaaaaaa " + 40 * "c")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    for r in rows.select("a", "b", similarity.bound(F.col("a"), F.col("b")).alias("most")).collect():
        assert similarity.token_set(r.a, r.b) <= r.most + 1e-9
    words = [f"w{i:03}" for i in range(250)]
    posts = [(i, i, "x", "data engineer", "lyon", str(i), " ".join(t) + " z", False) for i, t in enumerate((words[:200], words[:160] + words[210:250]))]
    frame = spark.createDataFrame(posts, "id long, at long, company string, title string, place string, fp string, text string, rejected boolean")
    got = [(r.parent, r.child, r.similarity) for r in similarity.links(frame, 30).collect()]
    assert [x[:2] for x in got] == ([(0, 1)] if similarity.token_set(posts[0][6][:1000], posts[1][6][:1000]) >= 80 else [])


def test_full_buckets_are_dealt_over_tasks(spark, monkeypatch):
    """Links do not depend on how a full bucket is dealt out."""
    posts = [(i, i // 9, "x" if i % 4 else None, f"data engineer {i % 5}", "lyon", str(i % 50), f"some words of text {i % 7}", False) for i in range(120)]
    frame = spark.createDataFrame(posts, "id long, at long, company string, title string, place string, fp string, text string, rejected boolean")
    want = sorted(map(tuple, similarity.links(frame, 4).collect()))
    monkeypatch.setattr(similarity, "FULL", 5)
    assert sorted(map(tuple, similarity.links(frame, 4).collect())) == want and len(want) > 50


def test_roots_and_upsert(spark):
    links = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (9, None)], "id long, parent long")
    assert {r.id: r.root for r in R.roots(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9}
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, None, "z"), (3, "c", "q")], "k int, v string, w string")
    got = sorted(tuple(r) for r in R.upsert(old, new, ["k"], {"v": R.NEW_UNLESS_NULL, "w": R.KEEP_OLD}).collect())
    assert got == [(1, "a", "x"), (2, "b", "y"), (3, "c", "q")]


def test_sources(spark):
    def answer(kind, text):
        return spark.createDataFrame([(text,)], "j string").select(F.from_json("j", boards.SCHEMAS[kind]).alias("r")).select("r.*")

    a = boards.search(answer("search", '{"resultats":[{"id":"1","intitule":"Dev","typeContrat":"MIS","lieuTravail":{"libelle":"75 - Paris"},"dateCreation":"2024-01-02T03:04:05Z"}]}'))
    b = boards.region(answer("region", '{"jobs":[{"id":null,"title":"x"},{"id":"7","title":"Stage dev","snippet":"<p>a</p>"}]}'))
    c = boards.multi_board(answer("multi_board", '{"postings":[{"id":"z","text":"T","categories":{"location":"Paris","allLocations":["paris","Lyon"],"commitment":"CDI"},"createdAt":1700000000000}]}'), "Acme")
    rows = {r.source: r for r in boards.union_of(a, b, c, a).collect()}
    assert len(rows) == 3 and rows["search"].contract == "INTERIM" and rows["search"].published_at.hour == 3
    assert rows["region"].contract == "STAGE" and rows["region"].description == "a"
    assert rows["multi_board"].location == "Paris, Lyon" and rows["multi_board"].contract == "CDI"
    assert boards.unknown_only(a, a).count() == 0
    feed = spark.createDataFrame([("https://Ex.org/a?utm_source=f", "T", "<p>x</p>", "Tue, 02 Jan 2024 03:04:05 +0000"), ("https://ex.org/a", "U", "y", None), ("", "V", "z", None)], boards.SCHEMAS["feed"])
    items = boards.feed(feed).collect()
    assert [(i.url, i.title, i.extract) for i in items] == [("https://ex.org/a", "T", "x")] and items[0].published_at.day == 2
