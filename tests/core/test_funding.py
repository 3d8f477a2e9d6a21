"""Funding articles: read within their row, hints before the wording, and what a sentence is cut by."""

import random
import re

import pytest
from pyspark.sql import functions as F
from tidemill.functions import funding as U
from tidemill.functions import text as T
from tidemill.functions import wording as W

SCHEMA = "id long, title string, text string"


def test_an_article_is_read_within_its_row(spark):
    rows = spark.createDataFrame([(1, "Acme lève 10 M€", "Acme va recruter 20 personnes."), (1, "Rien de neuf", "Un texte."), (None, "Zed raises $20M", None), (2, None, None)], SCHEMA)
    read = U.articles(rows, {})
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Sort|Window|Join|Aggregate", plan)
    got = sorted([(r.id, r.is_funding, r.company, r.amount, r.hiring) for r in read.collect()], key=repr)  # rows of one id were read as one article, one without an id as none
    assert got == [(1, False, None, None, None), (1, True, "Acme", 1e7, "recruter 20 personnes"), (2, False, None, None, None), (None, True, "Zed", 2e7, None)]


@pytest.mark.parametrize("name", ["RAISES", "ROUND_NOUNS", "BEFORE", "OWN_FUND", "NOT_RAISED", "CUES", "SEATS", "CALLED", "RECRUITING_AS_A_TRADE"])
def test_a_hint_is_in_every_phrase(name):
    hint = re.compile(W.hint(getattr(U, name)))
    for p in getattr(U, name):
        assert hint.search("x " + p.replace("*", "").replace(" ", "  ")), p


def test_a_hint_is_the_fewest_words():
    assert W.hint(["a leve", "ont leve", "levee de fonds"]) == "(?=[l])leve"
    assert W.hint(["ab c", "xy"]) == "(?=[ax])(?:ab|xy)"


def test_every_hiring_grammar_needs_its_hint(spark):
    said = ["recruter 3 talents", "va embaucher", "12 postes", "financer le recrutement", "embauche de 5 experts", "doubler ses equipes", "atteindre 50 salaries", "plans to hire", "hire over 20", "is hiring", "40 new roles"]
    assert len(said) == len(U.HIRING)
    got = spark.createDataFrame(list(enumerate(said)), "n int, s string").select("n", "s", U.hiring(F.col("s")).alias("h"), *[F.col("s").rlike(p).alias(f"p{i}") for i, (_, p) in enumerate(U.HIRING)], *[F.col("s").rlike(W.hint(h)).alias(f"h{i}") for i, (h, _) in enumerate(U.HIRING)]).collect()
    for r in got:
        assert r[f"p{r.n}"] and all(r[f"h{i}"] for i in range(len(said)) if r[f"p{i}"]) and r.h is not None, r


def test_amounts_are_those_of_the_three_forms_side_by_side():
    number = rf"(?:(?<![0-9.,])[0-9]{{1,3}}(?:[ .][0-9]{{3}})+(?![.,]?[0-9])|(?<![0-9.,])[0-9]+(?:[.,][0-9]+)?|{W.any_of(T.NUMBERS)})"
    plain = rf"(?:{number} *(?:{U._SCALE} *)?(?:de +|d')?{U._UNIT}|{U._SIGN} ?{number} ?(?:{U._SCALE})?|{number} ?(?:{U._SCALE})? ?{U._SIGN})(?! ?%)"
    local = lambda p: re.compile(p.replace(r"[\p{L}\p{N}]", r"[^\W_]").replace(r"\p{L}", r"[^\W\d_]"))
    one, other, rng = local(plain), local(U.AMOUNT), random.Random(7)
    words = [*U.SCALES, *U.CURRENCIES, *T.NUMBERS, "1", "20", "300", "000", "000", ".", ",", " ", "%", "d'", "de ", "x"]
    for _ in range(20000):
        text = "".join(rng.choice(words) + rng.choice([" ", "", ""]) for _ in range(8))
        assert [m.span() for m in one.finditer(text)] == [m.span() for m in other.finditer(text)], text


def test_prose_is_cut_as_before(spark):
    rng, parts = random.Random(9), ["Fin", "fin", ".", "!", "…", " ", "  ", "\t", "\n", "\u00a0", "- ", "•", "M.", "etc.", "n°.", "inc.", "É", "é", "«", "“", "(", "7", "\u0000", "\r"]
    texts = ["".join(rng.choice(parts) for _ in range(12)) for _ in range(2000)]

    def before(text):
        held = F.regexp_replace(F.regexp_replace(text, "[\u00a0\u202f]", " "), rf"(?i)\b({T.ABBREVIATIONS})\.", "$1\u0000")
        cut = r"(?<=[.!?…])\s+(?=[«\"“(A-ZÀ-Ý0-9])|(?<=[a-zà-ÿ0-9][.!?…])(?=[«\"“A-ZÀ-Ý])"
        lines = F.transform(F.split(held, "\n"), lambda x: F.regexp_replace(x, r"^\s*[-•*–—]\s*", ""))
        pieces = F.flatten(F.transform(lines, lambda x: F.split(F.trim(x), cut)))
        return F.filter(F.transform(pieces, lambda p: F.trim(F.regexp_replace(F.replace(p, F.lit("\u0000"), F.lit(".")), r"\s+", " "))), lambda p: p != "")

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", before(F.col("t")).alias("old"), T.prose_sentences(F.col("t")).alias("new"), F.flatten(T.prose_lines(F.col("t"))).alias("lines"))
    assert all(r.old == r.new == r.lines for r in rows.collect())
