"""Patterns of phrases against plain lists of them, places in a text, and how many tasks share the rows of a composed query."""

import random
import re

from pyspark.sql import functions as F
from tidemill.functions import extract as X
from tidemill.functions import funding as U
from tidemill.functions import text as T
from tidemill.functions import wording as W
from tidemill.operators import scoring as S
from tidemill.plans.extraction import _GATE
from tidemill.plans.queries import QUERIES


def listed(phrases):
    """Each phrase by itself, longer ones first."""
    one = lambda p: r" +".join(re.escape(w.rstrip("*")) + (r"\p{L}*" if w.endswith("*") else "") for w in p.split(" "))
    edge = lambda p: (r"(?<![\p{L}\p{N}])" if p[0].isalnum() else "") + one(p) + (r"(?![\p{L}\p{N}])" if p[-1].isalnum() or p[-1] == "*" else "")
    return "(?:" + "|".join(edge(p) for p in sorted(phrases, key=lambda p: (-len(p), p))) + ")"


def local(pattern):
    return re.compile(pattern.replace(r"[\p{L}\p{N}]", r"[^\W_]").replace(r"\p{L}", r"[^\W\d_]"))


def test_shared_beginnings_match_what_the_list_matches():
    rng = random.Random(3)
    lists = [U.RAISES, U.ROUND_NOUNS, U.BEFORE, U.OWN_FUND, U.NOT_RAISED, U.CUES, U.LIST_ENDS, U.HIRED, U.INTENDS, U.PAYS, U.OWNED, U.PLANS, U.NO_HIRING, U.SEATS, U.CALLED, list(T.NUMBERS), ["ab* c d", "abc c", "abc", "ab*", "€", "€ a"]]
    for phrases in lists:
        words = [w.replace("*", rng.choice(["", "er", "s"])) for p in phrases for w in p.split(" ")] + ["x", ",", "5", "é", "_"]
        plain, shared = local(listed(phrases)), local(W.any_of(phrases))
        for _ in range(300):
            text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "", "."]) for _ in range(8))
            for follow in ("", r" +[a-z]+"):
                a, b = re.compile(plain.pattern + follow), re.compile(shared.pattern + follow)
                assert [m.span() for m in a.finditer(text)] == [m.span() for m in b.finditer(text)], text


def test_an_edge_is_tested_once_for_all_phrases():
    assert W.any_of(U.RAISES).count("(?<!") == 1


def test_places_of_texts_with_any_sign(spark):
    texts = ["a1b22￿c333", "a1b22", "￿", "", "none", None, "1", "😀1😀22"]
    got = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", T.places(F.col("t"), "[0-9]+").alias("p")).orderBy("n").collect()
    for r, t in zip(got, texts, strict=True):
        want = None if t is None else [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", t)]
        assert (None if r.p is None else [tuple(x) for x in r.p]) == want


def test_rows_of_one_file_are_dealt_over_all_tasks(spark, sf_dir):
    for name in ("funding_rows", "funding_story_rows", "reserved_rows", "gate_rows"):
        assert QUERIES[name](spark, sf_dir).rdd.getNumPartitions() == 4, name


def test_years_are_looked_for_at_edges_only_and_found_as_before():
    rng = random.Random(5)
    plain, guarded = local("|".join([X._RANGE, X._QUALIFIED, X._OPEN, X._PLAIN])), local(X._YEARS)
    words = [*T.NUMBERS, *X.AT_LEAST, *X.AT_MOST, *X.UNITS, *X.BETWEEN, *X.OF_EXPERIENCE, "5", "12", "345", "+", "x", "d", ",", "é", "_"]
    for _ in range(3000):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "", "."]) for _ in range(8))
        assert [m.span() for m in plain.finditer(text)] == [m.span() for m in guarded.finditer(text)], text


def test_every_phrase_holds_its_gist():
    lists = [X.RESERVED, X.STATUS, X.BENEFICIARIES, X.PLACES, [X.THE_COMPANY, X.ON_BEHALF], X.VAGUE]
    for phrases in [*lists, [p for x in lists for p in x]]:
        gist = re.compile(W.gist(phrases))
        assert all(gist.search(p.replace("*", "x").replace(" ", "  ")) for p in phrases)
    assert W.gist(["ab cde*", "xcdey", "f"]) == "cde|f"


def test_the_first_place_is_the_first_of_all_places(spark):
    texts = ["a1b22￿c333", "a1b22", "￿", "", "none", None, "1", "😀1😀22"]
    got = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select(T.first_place(F.col("t"), "[0-9]+").alias("one"), F.get(T.places(F.col("t"), "[0-9]+"), 0).alias("all")).collect()
    assert all(r["one"] == r["all"] for r in got) and sum(r["one"] is not None for r in got) == 4


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_gate_without_the_sentence_makes_none_and_sentences_are_cut_where_the_gist_is(spark):
    rows = spark.createDataFrame([("DevOps", "Acme", "CDI", "au moins 4 ans. Rien", True), ("Dev confirmé", None, "CDI", None, True), (None, "X", "CDI", "Poste réservé aux\ttravailleurs handicapés. Fin", True)], "title string, company string, contract string, text string, allowed boolean")
    g = S.evaluate(rows, _GATE, title=F.col("title"), company=F.col("company"), contract=F.col("contract"), text=F.col("text"), location_ok=F.col("allowed"))
    assert g.columns == [*rows.columns, "required", "recruiter", "client", "reasons", "stretch", "tier"]
    edges = r"(?:[.!?;](?=\s|$)|[•\n\r])"  # the cuts around a place
    assert edges in _plan(g) and edges not in _plan(g.select("required.years", "required.basis", "reasons"))
    got = g.select("required.*", F.array_join("reasons", ",").alias("reasons")).collect()
    assert [tuple(r)[:3] for r in got] == [(4.0, "explicit", "au moins 4 ans"), (3.0, "seniority", "Dev confirmé"), (None, "not_mentioned", None)]
    assert "RESERVED_RQTH" in got[2]["reasons"]


def test_a_place_is_written_once_however_often_it_is_used(spark):
    rows = spark.createDataFrame([("a",)], "s string")  # 36 times, when each use of a place looked for it again
    assert _plan(rows.select(X.end_client(F.col("s")))).count("son +client") <= 8
