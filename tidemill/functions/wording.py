"""Wording as data: lists of plain phrases, matched on a text whose letters are plain and whose places are the given text's."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


def _plain_letters() -> dict[str, str]:
    out = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | {"’": "'", " ": " ", " ": " ", "–": "-"}
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))[0].lower()
        if base.isascii():
            out[chr(code)] = base
    return out


_PLAIN = _plain_letters()


def flat(text: Column) -> Column:
    """Lower case without accents, letter for letter, so that a place in it is a place in text."""
    return F.translate(text, "".join(_PLAIN), "".join(_PLAIN.values()))


def fold(text: Column, plain: Column) -> Column:
    """T.fold() of a text by its flat form, where that is ASCII: the same letters then, so only signs are left to drop."""
    return F.when(F.octet_length(plain) == F.char_length(plain), F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}_]+", " "))).otherwise(T.fold(text))


def any_of(phrases: Iterable[str]) -> str:
    """A pattern of whole phrases of flat text, longer ones first; a star at the end of a word stands for any more letters.

    What phrases begin with alike is written once, behind one test of the word's edge, so that a
    place costs a step or two however many phrases there are.
    """
    listed = sorted(dict.fromkeys(phrases), key=lambda p: (-len(p), p))
    words, signs = [p for p in listed if p[0].isalnum()], [p for p in listed if not p[0].isalnum()]
    # phrases of different first letters never match at one place, so their order is free
    return "(?:" + "|".join(([f"(?=[{_firsts(words)}])" + r"(?<![\p{L}\p{N}])" + _branches(words, 0)] if words else []) + ([_branches(signs, 0)] if signs else [])) + ")"


def _rest(phrase: str, at: int) -> str:
    """The pattern of a phrase from a place on, with its end."""
    return "".join(_letter(c) for c in phrase[at:]) + (r"(?![\p{L}\p{N}])" if phrase[-1].isalnum() or phrase[-1] == "*" else "")


def _letter(c: str) -> str:
    return " +" if c == " " else r"\p{L}*" if c == "*" else re.escape(c)


def _branches(phrases: list[str], at: int) -> str:
    """Phrases that are equal up to a place, in order, from there on; where a star stands next, the order decides, and they are listed."""
    if len(phrases) == 1:
        return _rest(phrases[0], at)
    if any(p[at : at + 1] == "*" for p in phrases):
        return "(?:" + "|".join(_rest(p, at) for p in phrases) + ")"
    groups: dict[str, list[str]] = {}
    for p in phrases:
        groups.setdefault(p[at : at + 1], []).append(p)
    ended = groups.pop("", None)  # the shortest, so the last
    parts = [_letter(c) + _branches(own, at + 1) for c, own in groups.items()] + ([_rest(ended[0], at)] if ended else [])
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def each(*parts: str | Iterable[str]) -> list[str]:
    """All phrases made of one choice of each part; an empty choice leaves its part out."""
    out = [""]
    for part in parts:
        choices = [part] if isinstance(part, str) else list(part)
        out = [f"{a} {b}".strip() for a in out for b in choices]
    return out


def says(text: Column, phrases: Iterable[str]) -> Column:
    return flat(text).rlike(any_of(phrases))


def gist(*lists: Iterable[str]) -> str:
    """A pattern that finds something in every flat text that says one of the phrases: the longest word of each, whatever its edges.

    A word stands whole in a sentence and in the text that it was cut from, so what a text
    without one lacks need not be looked for in its sentences.
    """
    words = {max((w.rstrip("*") for w in p.split(" ")), key=len) for phrases in lists for p in phrases}
    return "|".join(re.escape(w) for w in sorted(words) if not any(v != w and v in w for v in words))


def _needed(lists: Iterable[Iterable[str]]) -> list[str]:
    """Words of which every flat text that says one of the phrases holds one, in whatever edges: one word of each, the fewest that do."""
    left = [{w.rstrip("*") for w in p.split(" ")} for phrases in lists for p in phrases]
    left = [{w for w in words if len(w) > 2} or {max(words, key=len)} for words in left]
    chosen: set[str] = set()
    while left:
        counts: dict[str, int] = {}
        for words in left:
            for w in words:
                counts[w] = counts.get(w, 0) + 1
        best = max(sorted(counts), key=lambda w: (counts[w], len(w)))
        chosen.add(best)
        left = [words for words in left if not any(best in w for w in words)]
    return sorted(w for w in chosen if not any(v != w and v in w for v in chosen))


def hint(*lists: Iterable[str]) -> str:
    """A pattern that finds something in every flat text that says one of the phrases.

    It is a fraction of the work of the phrases, so it goes before them where most texts say none.
    """
    words = _needed(lists)
    return f"(?=[{_firsts(words)}]){_plain_branches(words, 0)}"


def hinted(text: Column, *lists: Iterable[str]) -> Column:
    """Whether a flat text holds a hint of the phrases; a few words are looked for one by one, which is quicker than a pattern."""
    words = _needed(lists)
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]) if len(words) <= 8 else text.rlike(hint(*lists))


def _firsts(words: list[str]) -> str:
    """The letters that words begin with; to test one is quicker than to test an edge."""
    return "".join(re.escape(c) for c in sorted({w[0] for w in words}))


def _plain_branches(words: list[str], at: int) -> str:
    """Words, of which none begins another, that are equal up to a place, from there on."""
    if len(words) == 1:
        return re.escape(words[0][at:])
    groups: dict[str, list[str]] = {}
    for w in words:
        groups.setdefault(w[at], []).append(w)
    parts = [re.escape(c) + _plain_branches(own, at + 1) for c, own in groups.items()]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def in_order(plain: Column, *steps: Iterable[str]) -> Column:
    """Whether a flat text says one phrase of each step, one after the other."""
    return plain.rlike("(?s)" + ".*".join(any_of(s) for s in steps))


def first_place(text: Column, pattern: str, plain: Column | None = None) -> Column:
    """struct(start, stop, found) of the first match in flat text; null without one.  plain is flat(text), where it is at hand."""
    return T.first_place(flat(text) if plain is None else plain, pattern)


def cut_out(text: Column, place: Column) -> Column:
    """What stands in text at a place."""
    return F.substr(text, place["start"] + 1, place["stop"] - place["start"])
