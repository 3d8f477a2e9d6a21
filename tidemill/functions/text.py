"""Normalising column functions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

import html.entities
import json
import re
import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

LIGATURES = {"œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE", "ß": "ss"}


def _decomposed() -> tuple[dict[str, str], dict[str, str]]:
    """What compatibility decomposition without marks makes of a character: one other, or none or several.

    Hangul syllables stay whole: their parts are no marks, and equal texts stay equal.
    """
    one, other = {}, {}
    for code in [*range(0xA0, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)]:
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain != c and not unicodedata.combining(c):
            (one if len(plain) == 1 else other)[c] = plain
    return one, other


def ranges(chars: Iterable[str]) -> str:
    """A character class as few ranges; a class that lists each character is tested one by one."""
    codes, out = sorted(map(ord, chars)), []
    for code in codes:
        if out and out[-1][1] == code - 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in out) + "]"


_ONE, _OTHER = _decomposed()
#: Those that become several characters; a text that holds one is shorter without them.
_SEVERAL = "".join(_OTHER)
#: Marks that combine; those of class 0 are signs like any other.
_MARKS = r"(?:(?=\p{M})" + ranges(chr(c) for c in range(0x300, 0x1E94B) if unicodedata.combining(chr(c))) + ")+"
#: Legal forms that a company name loses.
LEGAL_FORMS = "sas sa sarl sasu srl gmbh inc ltd llc corp bv nv ag plc oy ab spa".split()
#: Gender marks and contract words that a title loses.
TITLE_NOISE = ["h f", "f h", "hf", "fh", "m f", "f m", "m w d", "w m d", "cdi", "cdd", "stage", "alternance", "interim"]
#: Contract types in order of priority, with the folded words that name them.
CONTRACTS = [
    ("ALTERNANCE", ["alternance", "apprentissage", "apprenticeship", "contrat de professionnalisation", "alternant"]),
    ("STAGE", ["stage", "stagiaire", "internship", "intern"]),
    ("INTERIM", ["interim", "temporary", "mission d interim", "vacataire"]),
    ("FREELANCE", ["freelance", "independant", "auto entrepreneur", "portage salarial", "contractor", "self employed"]),
    ("CDD", ["cdd", "contrat a duree determinee", "fixed term"]),
    ("CDI", ["cdi", "contrat a duree indeterminee", "permanent"]),
]
#: Written numbers.
NUMBERS = {w: n for n, ws in enumerate([("un", "une", "one"), ("deux", "two"), ("trois", "three"), ("quatre", "four"), ("cinq", "five"), ("six",), ("sept", "seven"), ("huit", "eight"), ("neuf", "nine"), ("dix", "ten")], 1) for w in ws}
#: A character that no text should hold.
_SIGN = "\uffff"
#: Query parameters that only track.
TRACKING = r"^(utm_(source|medium|campaign|term|content)|ref|source|fbclid|gclid|msclkid)(=|$)"


def constant_map(pairs: dict[str, str]) -> Column:
    """A map as one literal, which the optimizer makes once, in place of an expression per entry."""
    return F.from_json(F.lit(json.dumps(pairs, ensure_ascii=False)), "map<string,string>")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once and written once in the plan, however often use refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def fold(text: Column) -> Column:
    """Ligatures spelled out, compatibility forms and accents dropped, lower case, signs to spaces, spaces collapsed.

    Texts of ASCII alone take a short way; the few characters that stand for several are
    spelled out first, and only in texts that hold one.
    """
    several = constant_map(_OTHER)
    spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(several, c), c)), "")
    wide = F.when(F.translate(text, _SEVERAL, "") != text, spelled).otherwise(text)
    for sign, letters in LIGATURES.items():
        wide = F.replace(wide, F.lit(sign), F.lit(letters))
    wide = F.translate(wide, "".join(_ONE), "".join(_ONE.values()))
    wide = F.regexp_replace(wide, _MARKS, "")
    plain = F.lower(F.when(F.octet_length(text) == F.char_length(text), text).otherwise(wide))
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}_]+", " "))


def fold_plain(text: str) -> str:
    """fold() of a constant."""
    for sign, letters in LIGATURES.items():
        text = text.replace(sign, letters)
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return " ".join(re.sub(r"[^\w\s]", " ", text).split())


def drop_words(folded: Column, words: Iterable[str]) -> Column:
    pattern = r"(?<!\S)(?:" + "|".join(sorted(words, key=len, reverse=True)) + r")(?!\S)"
    return F.trim(F.regexp_replace(F.regexp_replace(folded, pattern, " "), " +", " "))


def company_name(name: Column) -> Column:
    return drop_words(fold(F.regexp_replace(name, r"\.(?<=[A-Za-z]\.)(?=[A-Za-z])", "")), LEGAL_FORMS)


def title_name(title: Column) -> Column:
    return drop_words(fold(title), TITLE_NOISE)


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def names_term(text: Column, term: str) -> Column:
    """Whether a folded text holds a term as whole words."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(f" {term} "))


def starts_term(text: Column, prefix: str) -> Column:
    """Whether a word of a folded text starts with prefix."""
    return F.contains(F.concat(F.lit(" "), text), F.lit(f" {prefix}"))


def contract_type(*texts: Column) -> Column:
    """The contract that the first text names that names one; UNKNOWN if none does."""
    found = []
    for text in texts:
        folded, case = fold(text), None
        for kind, words in CONTRACTS:
            test = F.lit(False)
            for word in words:
                test = test | names_term(folded, word)
            case = F.when(test, kind) if case is None else case.when(test, kind)
        found.append(case)
    return F.coalesce(*found, F.lit("UNKNOWN"))


def department(location: Column) -> Column:
    """The code of ``NN - City``, upper case; null for other places."""
    return F.nullif(F.upper(F.regexp_extract(location, r"(?i)^\s*(\d{2,3}|2[ab])\s*-\s*\S", 1)), F.lit(""))


def postal_department(code: Column) -> Column:
    """The department of a five-digit postal code, with the island and overseas rules."""
    digits = F.when(code.rlike(r"^\d{5}$"), code)
    return (
        F.when(F.substring(digits, 1, 2) == "20", F.when(digits < "20200", "2A").otherwise("2B"))
        .when(F.substring(digits, 1, 2).isin("97", "98"), F.substring(digits, 1, 3))
        .otherwise(F.substring(digits, 1, 2))
    )


def strip_tracking(url: Column) -> Column:
    """url without tracking parameters; the order of the others and the fragment stay."""
    base, query, fragment = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike(TRACKING) & (p != "")), "&")
    return F.concat(base, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)), fragment)


def article_url(url: Column) -> Column:
    """strip_tracking(), scheme and host in lower case, no fragment, no slash at the end but the root's."""
    plain = F.regexp_replace(strip_tracking(url), r"#.*$", "")
    origin, rest = F.lower(F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)), F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    path, query = F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"(\?.*)$", 1)
    return F.concat(origin, F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/+$", "")), query)


def safe_url(url: Column) -> Column:
    return F.when(url.rlike(r"(?i)^https?://[^/]+"), url)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def word_number(word: Column) -> Column:
    numbers = F.create_map(*[F.lit(x) for w, n in NUMBERS.items() for x in (w, float(n))])
    return F.coalesce(word.try_cast("double"), F.element_at(numbers, F.lower(word)))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the folded parts, null as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(fold(p), F.lit("")) for p in parts]), 256)


def excerpt(text: Column, size: int) -> Column:
    """text with single spaces, cut before a word that passes size, with an ellipsis."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.regexp_replace(F.substring(plain, 1, size + 1), r"\s+\S*$", "")
    return F.when(F.length(plain) <= size, plain).otherwise(F.concat(F.substring(cut, 1, size), F.lit("…")))


def sentences(text: Column) -> Column:
    """Sentences: cuts after .!?; before a space, and at line ends and bullets."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?;])\s+|\n+|[•▪]"), lambda s: F.trim(s)), lambda s: s != "")


#: Tags that end a line.
BLOCKS = "p|div|br|li|ul|ol|h[1-6]|tr|table|section"


def unescape(text: Column) -> Column:
    """Character references, numeric and named, decoded; unknown ones stay as they are."""
    names = constant_map({name: chr(code) for name, code in html.entities.name2codepoint.items()} | {"apos": "'"})
    parts = F.split(text, "&")

    def decoded(part: Column) -> Column:
        return let(F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1), lambda name: named(part, name))

    def named(part: Column, name: Column) -> Column:
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 8)).try_cast("int")
        code = F.when(number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        sign = F.coalesce(code, F.try_element_at(names, name))
        return F.when(sign.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(sign, F.substr(part, F.length(name) + 2)))

    rest = F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), decoded), "")
    return F.when(F.contains(text, F.lit("&")), F.concat(F.element_at(parts, 1), rest)).otherwise(text)


def html_text(page: Column) -> Column:
    """Markup to text: references decoded before and after the tags go, block tags to line ends, other tags to spaces, blank lines dropped; null is empty."""
    text = F.regexp_replace(unescape(F.coalesce(page, F.lit(""))), rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    text = let(F.regexp_replace(text, r"<[^>]+>", " "), unescape)
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def description_excerpt(text: Column, most: int = 5000) -> Column:
    """Markup to text that keeps single blank lines and list items; cut at a word past most characters, with an ellipsis."""
    raw = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    raw = F.regexp_replace(F.regexp_replace(raw, r"(?i)<\s*(?:br|/p|/div|/h[1-6]|/tr|/ul|/ol)\b[^>]*>", "\n"), r"(?i)<\s*li\b[^>]*>", "\n- ")
    plain = F.regexp_replace(let(F.regexp_replace(raw, "<[^>]*>", " "), unescape), "<[^>]*>", " ")
    lines = F.array_join(F.transform(F.split(plain, "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), "\n")
    plain = F.regexp_replace(F.regexp_replace(lines, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")

    def shortened(cut: Column) -> Column:
        last = F.length(F.regexp_extract(cut, r"(?s)^(.*)[ \n]", 1))
        at_word = F.when((last > most * 0.6), F.substr(cut, F.lit(1), last)).otherwise(cut)
        return F.concat(F.regexp_replace(at_word, r"[ ,;:.\n]+$", ""), F.lit("…"))

    return let(plain, lambda p: F.when(F.length(p) <= most, p).otherwise(let(F.substring(p, 1, most - 1), shortened)))


def places(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, found>> of all matches of pattern, from left to right, characters from 0.

    pattern has no groups of its own and matches no empty text.  One pass puts a sign around
    each match; the few texts that hold the sign themselves are searched match by match.
    """
    whole = rf"(?s)\G(.*?)({pattern})"  # \G: without it a text without a match is searched anew from each place
    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,stop:int,found:string>>").alias("all"))

    def step(acc: Column, s: Column) -> Column:
        start = acc["end"] + F.length(s["gap"])
        stop = start + F.length(s["hit"])
        return F.struct(stop.alias("end"), F.concat(acc["all"], F.array(F.struct(start.alias("start"), stop.alias("stop"), s["hit"].alias("found")))).alias("all"))

    def told(parts: Column) -> Column:
        """From gap, match, gap, match and so on, with a gap at the end."""
        pairs = F.transform(F.sequence(F.lit(0), F.size(parts) - 3, F.lit(2)), lambda i: F.struct(F.get(parts, i).alias("gap"), F.get(parts, i + 1).alias("hit")))
        start, hit = F.length(F.get(parts, 0)), F.get(parts, 1)
        one = F.array(F.struct(start.alias("start"), (start + F.length(hit)).alias("stop"), hit.alias("found")))  # most texts have one match, if any
        return F.when(F.size(parts) < 3, none["all"]).when(F.size(parts) == 3, one).otherwise(F.aggregate(pairs, none, step)["all"])

    def matches(t: Column) -> Column:
        slow = F.arrays_zip(F.regexp_extract_all(t, F.lit(whole), F.lit(1)).alias("gap"), F.regexp_extract_all(t, F.lit(whole), F.lit(2)).alias("hit"))
        # a match adds signs, so a text that stays as it was has none
        marked = let(_marked(t, pattern), lambda m: F.when(m == t, none["all"]).otherwise(let(F.split(m, _SIGN), told)))
        return F.when(F.contains(t, F.lit(_SIGN)), F.aggregate(slow, none, step)["all"]).when(t.isNotNull(), marked)

    return let(text, matches)


def _marked(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, f"(?:{pattern})", f"{_SIGN}$0{_SIGN}")


def first_place(text: Column, pattern: str) -> Column:
    """The first of places(), null without one, without the others."""

    def told(parts: Column) -> Column:
        start, hit = F.length(F.get(parts, 0)), F.get(parts, 1)
        return F.when(F.size(parts) > 2, F.struct(start.alias("start"), (start + F.length(hit)).alias("stop"), hit.alias("found")))

    def match(t: Column) -> Column:
        return F.when(F.contains(t, F.lit(_SIGN)), F.get(places(t, pattern), 0)).otherwise(let(F.split(_marked(t, pattern), _SIGN, 3), told))

    return let(text, match)


def snippet(text: Column, start: Column, stop: Column, most: int = 160) -> Column:
    """The sentence around text[start:stop]: at most most characters, a longer one cut to a window with an ellipsis on each cut side."""

    def cut(x: Column) -> Column:
        room, long = most - 2, x["right"] - x["left"] > most
        half = F.greatest(F.lit(0), F.floor((room - (x["stop"] - x["start"])) / 2))
        high = F.least(x["right"], F.greatest(x["left"], x["start"] - half) + room)
        return F.struct(x["text"].alias("text"), long.alias("long"), x["left"].alias("left"), x["right"].alias("right"), F.when(long, F.greatest(x["left"], high - room)).otherwise(x["left"]).cast("int").alias("low"), F.when(long, high).otherwise(x["right"]).cast("int").alias("high"))

    def show(x: Column) -> Column:
        body = F.regexp_replace(F.trim(F.regexp_replace(F.substr(x["text"], x["low"] + 1, x["high"] - x["low"]), r"(?U)\s+", " ")), "^[-*·–— ]+", "")
        before, after = F.when(x["long"] & (x["low"] > x["left"]), "…").otherwise(""), F.when(x["long"] & (x["high"] < x["right"]), "…").otherwise("")
        return F.when(F.coalesce(body, F.lit("")) == "", "").otherwise(F.concat(before, body, after))

    def bounds(x: Column) -> Column:
        left = F.coalesce(F.array_max(F.transform(F.filter(x["edges"], lambda e: e["stop"] <= x["start"]), lambda e: e["stop"])), F.lit(0))
        right = F.coalesce(F.array_min(F.transform(F.filter(x["edges"], lambda e: e["start"] >= x["stop"]), lambda e: e["start"])), F.length(x["text"]))
        return F.struct(x["text"].alias("text"), x["start"].alias("start"), x["stop"].alias("stop"), left.alias("left"), right.alias("right"))

    given = let(text, lambda t: F.struct(t.alias("text"), start.cast("int").alias("start"), stop.cast("int").alias("stop"), places(t, r"[.!?;](?=\s|$)|[•\n\r]").alias("edges")))
    return let(let(let(given, bounds), cut), show)


def find_term(text: Column, forms: Iterable[str]) -> Column:
    """struct(start, stop, found) of the earliest whole-term match of one of the forms, whatever the case; null without one."""
    found = [F.get(places(text, rf"(?iU)(?<!\w){re.escape(f)}(?!\w)"), 0) for f in forms]
    return F.array_min(F.filter(F.array(*found), lambda x: x.isNotNull()))


def whole_term(term: str) -> str:
    """The pattern of a term as whole words, whatever the case; what it finds is as long as the term."""
    return rf"(?iU)(?<!\w){re.escape(term)}(?!\w)"


def contains_term(text: Column, term: str) -> Column:
    return text.rlike(whole_term(term))


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """Whether text holds one of the terms as whole words, by one pattern; false for none."""
    forms = [re.escape(t) for t in terms]
    return text.rlike(rf"(?iU)(?<!\w)(?:{'|'.join(forms)})(?!\w)") if forms else F.lit(False)


def word_sentences(text: Column) -> Column:
    """Sentences of a description: cuts after .!?; before white space or the end, at bullets and line ends; spaces collapsed."""
    parts = F.split(text, r"[.!?;](?=\s|$)|[•\n\r]")
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"(?U)\s+", " "))), lambda p: p != "")


#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = "M|Mme|Mlle|Dr|St|Inc|Ltd|Co|Corp|etc|env|cf|vs|n°"


def prose_lines(text: Column) -> Column:
    """The sentences of each line of French or English prose: lines and bullets are cuts, abbreviations are none, a missing space after a full stop is tolerated."""
    # each pattern begins with what is rare at a place, and matches only what it changes
    spaced = F.when(F.contains(text, F.lit("\u00a0")) | F.contains(text, F.lit("\u202f")), F.regexp_replace(text, "[\u00a0\u202f]", " ")).otherwise(text)
    held = F.regexp_replace(F.regexp_replace(spaced, rf"(?i)\.(?<=\b(?:{ABBREVIATIONS})\.)", "\u0000"), r"(?=\s)(?:[^\S\n]{2,}|[^\S\n ])", " ")
    cut = r"\s(?<=[.!?…]\s)\s*(?=[«\"“(A-ZÀ-Ý0-9])|(?=[«\"“A-ZÀ-Ý])(?<=[a-zà-ÿ0-9][.!?…])"

    def sentences_of(line: Column) -> Column:
        # a line has no line end, so its cuts may be told by one
        parts = F.split(F.regexp_replace(F.trim(F.regexp_replace(line, r"^\s*[-•*–—]\s*", "")), cut, "\n"), "\n")
        return F.filter(F.transform(parts, lambda p: F.trim(F.replace(p, F.lit("\u0000"), F.lit(".")))), lambda p: p != "")

    return F.transform(F.split(held, "\n"), sentences_of)


def prose_sentences(text: Column) -> Column:
    """Sentences of prose_lines(), in order."""
    return F.flatten(prose_lines(text))


def slugs(name: Column) -> Column:
    """[compact slug, hyphen slug] of a company name; one where they are equal, none without a word."""
    words = F.split(F.regexp_replace(F.regexp_replace(F.regexp_replace(fold(F.regexp_replace(name, r"\(.*?\)", " ")), "_", " "), "[^a-z0-9 ]", ""), r"(?<!\S)(?:groupe?|sas?|se|the)(?!\S)", " "), " +")
    both = lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(F.array_join(w, ""), F.array_join(w, "-"))))
    return let(F.filter(words, lambda w: w != ""), both)


def form_host(url: Column) -> Column:
    """The application form behind a URL's host: greenhouse, lever or ashby; null for others."""
    at = host(url)
    case = None
    for name, suffix in (("greenhouse", "greenhouse.io"), ("lever", "lever.co"), ("ashby", "ashbyhq.com")):
        test = (at == suffix) | at.endswith("." + suffix)
        case = F.when(test, name) if case is None else case.when(test, name)
    return case


def search_fold(text: Column) -> Column:
    """The folding of the search box: accents and case dropped, signs kept."""
    accents = {a: b for a, b in _ONE.items() if len(unicodedata.normalize("NFD", a)) > 1}
    return F.lower(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "".join(accents), "".join(accents.values())), r"\p{Mn}+", ""))


def matches_words(haystack: Column, query: Column) -> Column:
    """Whether each word of query stands anywhere in haystack, both folded for search; a query without words matches."""
    words = F.filter(F.split(search_fold(query), r"\s+"), lambda w: w != "")
    return let(search_fold(haystack), lambda hay: F.forall(words, lambda w: F.contains(hay, w)))


def card_hash(title: Column, excerpt: Column) -> Column:
    """SHA-256 of the folded title, a line end and the excerpt."""
    return F.sha2(F.concat(F.coalesce(fold(title), F.lit("")), F.lit("\n"), F.coalesce(excerpt, F.lit(""))), 256)


#: Folded beginnings of headings that open the candidate's part of a posting, whole headings of it, and beginnings of those that close it.
PROFILE_HEADINGS = [
    "profil", "votre profil", "ton profil", "le profil", "du profil", "competences", "les competences", "vos competences", "tes competences", "savoir faire", "savoir etre", "qualites", "prerequis", "pre requis",
    "exigences", "les exigences", "ce que nous recherchons", "ce que l on attend de vous", "ce que l on attend de toi", "vous etes", "vous avez", "vous possedez", "vous maitrisez", "experience et competences", "experiences et competences",
]
PROFILE_WHOLE = ["formation", "formation et experience"]
OTHER_HEADINGS = [
    "mission", "vos mission", "les mission", "tes mission", "poste", "le poste", "votre poste", "description", "descriptif", "responsabilites", "vos responsabilites", "tes responsabilites", "avantages", "les avantages",
    "nous offrons", "nous proposons", "nous vous offrons", "nous vous proposons", "ce que nous offrons", "ce que nous proposons", "ce que nous vous offrons", "ce que nous vous proposons", "pourquoi", "l entreprise",
    "entreprise", "notre entreprise", "la entreprise", "societe", "notre societe", "la societe", "qui sommes nous", "a propos", "conditions", "informations complementaires", "process de recrutement", "processus de recrutement",
    "le process de recrutement", "le processus de recrutement", "remuneration", "salaire", "contexte", "environnement technique",
]


def heading(line: Column) -> Column:
    """profile, other or null for one line, its colon optional."""

    def kind(folded: Column) -> Column:
        fits = F.size(F.split(folded, " ")) <= 6
        opens = lambda words: folded.rlike("^(?:" + "|".join(words) + ")")
        return F.when(fits & (opens(PROFILE_HEADINGS) | folded.isin(PROFILE_WHOLE)), "profile").when(fits & opens(OTHER_HEADINGS), "other")

    bare = F.trim(F.regexp_replace(F.trim(line), r":+$", ""))
    return let(bare, lambda b: F.when((F.length(b) <= 60) & ~b.rlike("^[-•·*–—✓▪►]"), let(fold(b), kind)))


def profile_text(description: Column) -> Column:
    """The lines of the profile sections of a posting, joined by line ends; empty without such a heading.

    A section starts at a heading line or at ``Heading : text`` and runs to the next heading of any kind.
    """
    inline = r"^([^:]{3,40}?)\s*:\s+(\S.*)$"

    def read(raw: Column) -> Column:
        return let(F.trim(F.regexp_replace(raw, "\r", "")), one_line)

    def one_line(line: Column) -> Column:
        # a heading alone has no text after a colon, so the two forms exclude each other
        opened = line.rlike(r":\s*\S")
        kind = heading(F.when(~opened, line).when(line.rlike(inline), F.regexp_extract(line, inline, 1)))
        told = lambda k: F.struct(k.alias("kind"), F.when(k.isNull(), line).when(opened, F.regexp_extract(line, inline, 2)).alias("text"))
        return let(kind, told)

    lines = F.transform(F.filter(F.split(F.coalesce(description, F.lit("")), "\n"), lambda x: F.trim(x) != ""), read)
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        inside = F.coalesce(x["kind"] == "profile", acc["inside"])
        return F.struct(inside.alias("inside"), F.when(inside & x["text"].isNotNull(), F.concat(acc["kept"], F.array(x["text"]))).otherwise(acc["kept"]).alias("kept"))

    return F.array_join(F.aggregate(lines, start, step)["kept"], "\n")


def canonical_skill(name: Column, aliases: dict[str, list[str]], allowed: Iterable[str]) -> Column:
    """The canonical name behind name, itself or an alias, if it is allowed; null otherwise.  The first alias group wins."""
    key, listed = F.trim(F.regexp_replace(F.lower(name), r"\s+", " ")), sorted(a.lower() for a in allowed)
    case = F.when(key.isin(listed), key)
    for canonical, forms in aliases.items():
        if canonical.lower() in listed:
            case = case.when(key.isin([f.lower() for f in forms]), canonical.lower())
    return case


def salary_benchmark(location: Column, zones: list[tuple[list[str], str]], default: str) -> Column:
    """The text of the first zone one of whose words the folded location holds, else default."""
    case, where = None, fold(location)
    for words, value in zones:
        test = F.lit(False)
        for w in words:
            test = test | F.contains(where, F.lit(w))
        case = F.when(test, value) if case is None else case.when(test, value)
    return F.coalesce(case, F.lit(default)) if case is not None else F.lit(default)


def option_numbers(option: Column) -> Column:
    """The amounts in an option label; those below 1,000 count thousands where a k stands in the label."""
    low = F.replace(F.replace(F.lower(option), F.lit("\u202f"), F.lit(" ")), F.lit("\u00a0"), F.lit(" "))
    values = F.transform(F.regexp_extract_all(low, F.lit(r"(\d[\d ]*(?:[.,]\d+)?)"), F.lit(1)), lambda x: F.replace(F.replace(x, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).cast("double"))
    return F.transform(values, lambda v: F.when(F.contains(low, F.lit("k")) & (v < 1000), v * 1000).otherwise(v).cast("int"))


def salary_option(options: Column, low: int, high: int) -> Column:
    """The place of the one option all of whose amounts lie in low..high; null for none or several."""
    fits = lambda n: (F.size(n) > 0) & (F.array_min(n) >= low) & (F.array_max(n) <= high)
    hits = F.filter(F.transform(options, lambda o, i: F.when(let(option_numbers(o), fits), i)), lambda i: i.isNotNull())
    return let(hits, lambda h: F.when(F.size(h) == 1, F.element_at(h, 1)))


def language(text: Column, english: list[str], french: list[str]) -> Column:
    """en if a folded text has strictly more English than French function words."""
    words = F.split(fold(text), " ")
    return F.when(F.size(F.filter(words, lambda w: w.isin(english))) > F.size(F.filter(words, lambda w: w.isin(french))), "en").otherwise("fr")
