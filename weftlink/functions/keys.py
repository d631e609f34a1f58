"""Blocking keys: short strings that records of one organisation are likely to share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftlink.functions.text import filled, strip, tokens

#: Openings of a name that are ignored, in order of trial.
HONORIFICS = ("the ", "a ", "an ", "shri ", "smt ", "dr ", "m/s ", "ms ")
#: Legal forms that the distinctive part of a name lacks.
LEGAL_WORDS = (
    "incorporated", "corporation", "private limited", "pvt ltd", "limited", "ltd", "inc", "corp", "llc", "llp", "co",
    "gmbh", "sa", "sarl", "sas", "bhd", "plc", "trust", "society", "foundation",
)
#: Name words that make no key.
NAME_STOP = (
    "and the for ltd inc corp llc llp pvt co gmbh sa sarl sas plc company services enterprises solutions "
    "international group holdings global india usa united states france de du des le la les en et"
).split()
#: Address words that make no key.
ADDRESS_STOP = (
    "street road avenue boulevard lane drive suite floor building block near opp opposite behind cross main "
    "north south east west rue chemin route allee place nagar colony sector marg bhavan tower house city post office"
).split()


@dataclass(frozen=True)
class KeyRules:
    """What makes a key. The defaults are the standard rules; the rest are experiments."""

    name_words: int = 4
    address_words: int = 4
    address_word_chars: int = 4
    numbers: int = 2
    name_stop: tuple[str, ...] = tuple(NAME_STOP)
    address_stop: tuple[str, ...] = tuple(ADDRESS_STOP)
    #: Cut name-word keys to so many characters (0: not at all).
    name_word_cut: int = 0
    #: Also a key of the postal code alone.
    postal_alone: bool = False
    #: Compact names by dropping blanks only, so names in any script have prefix keys.
    any_script: bool = False
    #: A blank country makes no keys.
    need_country: bool = False


STANDARD = KeyRules()


def without_honorific(c: Column) -> Column:
    """The name without its first honorific."""
    return strip(F.regexp_replace(c, "^(?:" + "|".join(HONORIFICS) + ")", ""))


def without_legal_words(c: Column) -> Column:
    """The distinctive part of a name."""
    boundary = (r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])")
    return strip(F.regexp_replace(c, boundary[0] + "(?:" + "|".join(LEGAL_WORDS) + ")" + boundary[1], ""))


def _first(words: Column, most: int) -> Column:
    return F.slice(words, 1, most)


def blocking_keys(name: Column, address: Column, city: Column, postal: Column, country: Column, rules: KeyRules = STANDARD) -> Column:
    """Distinct keys of a normalised record, each ``type:country:value``."""
    name, address, city, postal, country = (strip(filled(c)) for c in (name, address, city, postal, country))
    compact = (lambda c: F.regexp_replace(c, r"(?U)\s+", "")) if rules.any_script else (lambda c: F.regexp_replace(c, "[^a-z0-9]", ""))
    short, whole = compact(without_honorific(name)), compact(name)
    key = lambda kind, *values: F.concat_ws(":", F.lit(kind), country, *values)
    one = lambda test, k: F.when(test, F.array(k)).otherwise(F.array().cast("array<string>"))
    parts = [one(F.length(c) >= n, key(f"cn_p{n}", F.substring(c, 1, n))) for c in (short, whole) for n in (3, 4)]
    cut = (lambda t: F.substring(t, 1, rules.name_word_cut)) if rules.name_word_cut else (lambda t: t)
    for text in (name, without_legal_words(name)):
        good = F.filter(tokens(text), lambda t: (F.length(t) >= 3) & ~t.isin(list(rules.name_stop)))
        parts.append(F.transform(_first(good, rules.name_words), lambda t: key("tok", cut(t))))
    digits = lambda t: t.rlike(r"^\p{Nd}+$")
    good = F.filter(tokens(address), lambda t: (F.length(t) >= rules.address_word_chars) & ~digits(t) & ~t.isin(list(rules.address_stop)))
    parts.append(F.transform(_first(good, rules.address_words), lambda t: key("addr_tok", t)))
    has = lambda c: (F.length(c) >= 3) & (c != "None")
    opening = F.substring(short, 1, 2)
    parts.append(one(has(postal) & (F.length(short) >= 2), key("post_p2", postal, opening)))
    if rules.postal_alone:
        parts.append(one(has(postal), key("post", postal)))
    parts.append(one(has(city) & (F.length(short) >= 2), key("city_p2", city, opening)))
    numbers = _first(F.filter(tokens(address), lambda t: digits(t) & F.length(t).between(2, 4)), rules.numbers)
    parts.append(F.when(has(city), F.transform(numbers, lambda t: key("city_num", city, t))).otherwise(F.array().cast("array<string>")))
    keys = F.array_distinct(F.concat(*parts))
    return F.when(country != "", keys).otherwise(F.array().cast("array<string>")) if rules.need_country else keys
