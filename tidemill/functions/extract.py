"""Extractors of years of experience, seniority and reserved posts: lists of wording over text columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from . import wording as W

#: Units, what stands between two numbers, and wording that qualifies a number.
UNITS = ["an", "ans", "annee", "annees", "year", "years"]
BETWEEN = ["a", "to", "-"]
AT_LEAST = ["au moins", "minimum", "au minimum", "at least"]
AT_MOST = ["jusqu'a", "up to", "moins de", "less than"]
OF_EXPERIENCE = ["d'experience", "d' experience", "experience", "of experience"]
#: Wording about experience without a number of years.
VAGUE = ["premiere experience", "premier experience", "premier emploi", "debutant", "junior", "entry level", "entry-level", "solid experience", "significant experience", "proven experience", "extensive experience"]
#: Periods that don't count as experience.
WITHOUT = W.each("hors", ["stage", "stages", "alternance", "alternances"])

_N = r"(?:(?<![\p{L}\p{N}])[0-9]{1,2}|" + W.any_of(T.NUMBERS) + ")"
_UNIT = W.any_of(UNITS)
#: One grammar for all: a range, a qualified number, a number with a plus, a plain one (which needs its topic if the unit could be any period).
_RANGE = rf"{_N} *(?:{'|'.join(BETWEEN)}) *{_N} *{_UNIT}"
_QUALIFIED = rf"{W.any_of(AT_LEAST + AT_MOST)} +{_N} *{_UNIT}"
_OPEN = rf"{_N} *[+] *{_UNIT}"
_PLAIN = rf"(?:{_N} *{W.any_of(['an', 'ans', 'year', 'years'])}(?: +{W.any_of(OF_EXPERIENCE)})?|{_N} *{W.any_of(['annee', 'annees'])} +{W.any_of(OF_EXPERIENCE)})"
#: All of it begins at the edge of a word, with a digit or with one of a few letters; other places are left at once.
_FIRST = "".join(sorted({p[0] for p in (*T.NUMBERS, *AT_LEAST, *AT_MOST)}))
_YEARS = rf"(?<![\p{{L}}\p{{N}}])(?=[0-9{_FIRST}])(?:{'|'.join([_RANGE, _QUALIFIED, _OPEN, _PLAIN])})"
#: Seniority words and the years they stand for.
SENIORITY = [("junior", 0), ("débutant", 0), ("confirmé", 3), ("confirmée", 3), ("expérimenté", 3), ("senior", 5), ("lead", 5), ("expert", 7), ("principal", 7)]
SENTENCE_CHARS = 240


def _read(m: Column) -> Column:
    """A match as (least, most, start, stop, explicit): years that are asked for, at most allowed, and whether the least is said to be one."""

    def told(x: Column) -> Column:
        numbers, at_most = x["numbers"], x["at_most"]
        both = F.size(numbers) > 1
        low, high = F.when(~at_most, F.get(numbers, 0)), F.when(at_most, F.get(numbers, 0)).when(both, F.get(numbers, 1))
        explicit = ~both & (m["found"].rlike(f"^{W.any_of(AT_LEAST)}") | F.contains(m["found"], F.lit("+")))
        return F.struct(low.alias("least"), high.alias("most"), m["start"].alias("start"), m["stop"].alias("stop"), explicit.alias("explicit"))

    numbers = F.transform(F.regexp_extract_all(m["found"], F.lit(f"({_N})"), F.lit(1)), T.word_number)
    return T.let(F.struct(numbers.alias("numbers"), m["found"].rlike(f"^{W.any_of(AT_MOST)}").alias("at_most")), told)


def _years_place(text: Column) -> Column:
    """struct(status, min_years, max_years, start, stop) of experience(), for a text that is not null."""

    def chosen(found: Column) -> Column:
        where = lambda c: [c["start"].alias("start"), c["stop"].alias("stop")]
        least = F.array_min(F.transform(F.filter(found, lambda c: c["least"].isNotNull()), lambda c: F.struct(c["least"].alias("k"), *where(c), c["most"].alias("most"))))
        top = F.array_max(F.transform(F.filter(found, lambda c: c["explicit"]), lambda c: F.struct(c["least"].alias("k"), (-c["start"]).alias("order"), *where(c))))
        most = F.array_min(F.transform(F.filter(found, lambda c: c["least"].isNull()), lambda c: F.struct(c["most"].alias("k"), *where(c))))
        return F.struct(F.size(found).alias("n"), least.alias("least"), top.alias("top"), most.alias("most"))

    def decided(x: Column, plain: Column) -> Column:
        least, top, most = x["least"], x["top"], x["most"]
        raised = F.coalesce(top["k"] > least["k"], F.lit(False))

        def told(vague: Column) -> Column:
            at = lambda c: F.when(raised, top[c]).otherwise(F.coalesce(least[c], most[c], vague[c]))
            return F.struct(
                F.when(x["n"] > 0, "EXPLICIT").when(vague.isNotNull(), "UNKNOWN").otherwise("NOT_MENTIONED").alias("status"), F.when(raised, top["k"]).otherwise(least["k"]).alias("min_years"),
                F.when(least.isNull(), most["k"]).when(~raised, least["most"]).alias("max_years"), at("start").alias("start"), at("stop").alias("stop"),
            )

        return T.let(F.when(x["n"] == 0, W.first_place(plain, W.any_of(VAGUE), plain)), told)

    def read(plain: Column) -> Column:
        return T.let(T.let(F.transform(T.places(plain, _YEARS), _read), chosen), lambda x: decided(x, plain))

    return T.let(W.flat(text), read)


def _around(text: Column, x: Column) -> Column:
    """The sentence around a place that was found; null without one."""
    return F.when(x["start"].isNotNull(), T.snippet(text, x["start"], x["stop"], SENTENCE_CHARS))


def experience(text: Column) -> Column:
    """struct(status, min_years, max_years, evidence, sentence, excludes_apprenticeship) of a text; null is empty.

    The smallest minimum counts, or the largest explicit one when that is larger; without a
    minimum the smallest maximum; of equal ones the first in the text.
    """

    def told(x: Column, given: Column) -> Column:
        return F.struct(x["status"].alias("status"), x["min_years"].alias("min_years"), x["max_years"].alias("max_years"), W.cut_out(given, x).alias("evidence"), _around(given, x).alias("sentence"), W.says(given, WITHOUT).alias("excludes_apprenticeship"))

    return T.let(F.coalesce(text, F.lit("")), lambda given: T.let(_years_place(given), lambda x: told(x, given)))


def snippet_of(text: Column, start: Column, said: Column) -> Column:
    return T.snippet(text, start, start + F.length(said), SENTENCE_CHARS)


def _titled(title: Column, description: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(description, F.lit("")))


def _senior_word(text: Column) -> Column:
    """struct(years, order, word) of the highest seniority word as a whole word, the first listed of equal ones; null without one."""
    found = F.array(*[F.when(T.contains_term(text, w), F.struct(F.lit(float(n)).alias("years"), F.lit(-i).alias("order"), F.lit(w).alias("word"))) for i, (w, n) in enumerate(SENIORITY)])
    return F.when(T.contains_any(text, [w for w, _ in SENIORITY]), F.array_max(F.filter(found, lambda x: x.isNotNull())))


def _word_sentence(text: Column, best: Column) -> Column:
    return snippet_of(text, F.instr(F.lower(text), best["word"]) - 1, best["word"])


def seniority(title: Column, description: Column) -> Column:
    """struct(years, sentence) of the highest seniority word as a whole word, the first listed of equal ones; null without one."""

    def read(text: Column) -> Column:
        return T.let(_senior_word(text), lambda best: F.when(best.isNotNull(), F.struct(best["years"].alias("years"), _word_sentence(text, best).alias("sentence"))))

    return T.let(_titled(title, description), read)


def years_read(title: Column, description: Column) -> Column:
    """What the years, the basis and the sentence of required_years() are told from: the place of a number of years, and the seniority word."""
    return F.struct(_years_place(F.coalesce(description, F.lit(""))).alias("found"), T.let(_titled(title, description), _senior_word).alias("word"))


def years_of(read: Column) -> Column:
    return F.coalesce(read["found"]["min_years"], read["word"]["years"])


def basis_of(read: Column) -> Column:
    found = read["found"]
    return F.when(found["min_years"].isNotNull(), "explicit").when(read["word"].isNotNull(), "seniority").when(found["status"] == "EXPLICIT", "explicit").when(found["status"] == "UNKNOWN", "unknown").otherwise("not_mentioned")


def sentence_of(read: Column, title: Column, description: Column) -> Column:
    found, word = read["found"], read["word"]
    return F.when(found["min_years"].isNull() & word.isNotNull(), _word_sentence(_titled(title, description), word)).otherwise(_around(F.coalesce(description, F.lit("")), found))


def required_years(title: Column, description: Column) -> Column:
    """struct(years, basis, sentence): the explicit minimum, else that of a seniority word; a maximum alone is explicit too."""
    return T.let(years_read(title, description), lambda x: F.struct(years_of(x).alias("years"), basis_of(x).alias("basis"), sentence_of(x, title, description).alias("sentence")))


# --- posts reserved for disabled workers --------------------------------------------------------

#: Whom a post may be reserved for, and wording that asks for the status itself.
PEOPLE = W.each("aux", ["personnes", "travailleurs", "travailleuses"], ["handicape", "handicapee", "handicapes", "handicapees", "en situation de handicap"])
STATUS = [*W.each("rqth", ["", "est"], ["obligatoire", "exige", "exigee", "requise"]), *W.each(["titulaire", "titulaires"], ["de la rqth", "d'une rqth"])]
RESERVED = ["reserve", "reserves", "reservee", "reservees"]
#: Wording that reserves a post only where the sentence is about disability, and wording that shows so.
BENEFICIARIES = W.each("uniquement", ["aux", "pour les"], "beneficiaires")
DISABILITY = ["rqth", "oeth", "boeth", "obligation d'emploi"]
#: What a recruiter says that it does for those whom it places.
PLACES = ["accompagn*"]


def _reserves(plain: Column) -> Column:
    """Whether a flat sentence reserves a post."""
    about = plain.rlike(W.any_of(DISABILITY)) | F.contains(plain, F.lit("handicap"))
    some = plain.rlike(W.any_of(BENEFICIARIES)) & about

    def said(left: Column) -> Column:
        whom = left.rlike(W.any_of(W.each(RESERVED, PEOPLE))) | left.rlike(W.any_of(STATUS))
        post = left.rlike(W.any_of(W.each(["poste", "postes"], RESERVED)) + ".*(?:" + W.any_of(["rqth"]) + "|handicap)")
        return whom | post | some

    # what is said not to be reserved is taken out first
    return T.let(F.regexp_replace(plain, W.any_of([f"{no}{r}" for no in ("pas ", "non ", "non-") for r in RESERVED]), " "), said)


def _telling(text: Column, gist: str, read: Callable[[Column, Column], Column]) -> Column:
    """read(sentence, flat sentence) of each sentence in which gist is found; null for a text in which it is not."""
    given = F.coalesce(text, F.lit(""))
    return F.when(W.flat(given).rlike(gist), F.transform(T.word_sentences(given), lambda s: T.let(W.flat(s), lambda plain: F.when(plain.rlike(gist), read(s, plain)))))


def _first_told(told: Column) -> Column:
    return F.get(F.filter(told, lambda x: x.isNotNull()), 0)


def reserved_sentence(text: Column) -> Column:
    """The first sentence that reserves a post for disabled workers; null without one."""
    return _first_told(_telling(text, W.gist(RESERVED, STATUS, BENEFICIARIES), lambda s, plain: F.when(_reserves(plain), s)))


def specialised_recruiter(company: Column, text: Column, names: list[str]) -> Column:
    """The listed recruiter that a post comes from: by the company's name, else by a sentence in which it says whom it places; null otherwise."""
    own = T.let(T.fold(F.coalesce(company, F.lit(""))), lambda folded: F.coalesce(*[F.when(T.names_term(folded, T.fold_plain(n)), n) for n in names], F.lit(None).cast("string")))
    placed = lambda s: F.coalesce(*[F.when(T.contains_term(s, n), n) for n in names], F.lit(None).cast("string"))
    said = _telling(text, W.gist(PLACES), lambda s, plain: F.when(W.in_order(plain, PLACES, ["recrut*"], ["handicap*", "rqth"]), placed(s)))
    return F.coalesce(own, _first_told(said))


#: What stands before and after the name of the company that a recruiter works for.
ON_BEHALF, THE_COMPANY, SEEKS = "pour le compte de", "l'entreprise", ["recherche", "recrute"]


def end_client(text: Column) -> Column:
    """The company that a recruiter says the post is at; null if none is named."""

    def named(s: Column, plain: Column) -> Column:
        # the name runs to a sign or to the verb; the verb must follow "l'entreprise" without a sign between
        subject = W.first_place(s, rf"{W.any_of([THE_COMPANY])} +[^,;:]{{2,60}}? +{W.any_of(SEEKS)}", plain)
        behalf = W.first_place(s, rf"{W.any_of([ON_BEHALF])} +(?:{W.any_of(['notre client', 'son client'])} +)?[^,;:]{{2,60}}?(?= +{W.any_of(SEEKS)}|[,;:]|$)", plain)
        bare = lambda place, drop: T.let(place, lambda p: F.trim(F.regexp_replace(W.cut_out(s, p), drop, "")))
        one = bare(subject, r"(?i)^l['’]entreprise|(?:recherche|recrute)$")
        two = T.let(bare(behalf, r"(?i)^pour le compte de +(?:(?:notre|son) client +)?"), lambda x: F.when(x.rlike(r"^\p{Lu}"), x))
        return F.coalesce(one, two)

    return _first_told(_telling(text, W.gist([THE_COMPANY, ON_BEHALF]), named))


def recruiter_note(recruiter: Column, client: Column) -> Column:
    """The note that stands beside a recruiter's post; it goes on with the client where one is named."""
    note = F.concat(F.lit("publié par "), recruiter, F.lit(" (recruteur spécialisé RQTH)"))
    return F.concat(note, F.coalesce(F.concat(F.lit(" — le poste peut exister en direct chez "), client), F.lit("")))
