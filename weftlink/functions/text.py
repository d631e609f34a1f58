"""Normalisation of countries, names and addresses as plain columns.

Everything here is built from JVM expressions, so it stays in generated code and can be
pushed below joins. Java's ``\\w`` and ``\\b`` differ from the Unicode rules wanted here:
a word character is a letter, a number or ``_`` (combining marks are not), which the
patterns spell out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NOT_BEFORE, _NOT_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

#: Endings of host names that are cut out of names.
NAME_DOMAINS = "co.in com org net in co io fr biz info gov edu ai me".split()
#: Legal forms with another canonical spelling.
LEGAL_FORMS = {"corp": "corporation", "inc": "incorporated", "ltd": "limited", "pvt": "private", "co": "company"}
#: Street words.
STREET_WORDS = {
    "rd": "road", "st": "street", "str": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "dr": "drive",
    "ln": "lane", "ct": "court", "pl": "place", "pkwy": "parkway", "hwy": "highway", "bldg": "building", "fl": "floor",
    "flr": "floor", "ste": "suite", "apt": "apartment", "no": "number", "ext": "extension", "cir": "circle",
    "sq": "square", "tr": "trail", "bd": "boulevard", "bvd": "boulevard", "r": "rue", "rte": "route", "all": "allee",
    "imp": "impasse",
}
#: Two-letter codes that mark a state.
STATE_CODES = (
    "al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj "
    "nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy dc pr vi gu"
).split()
#: Openings of a landmark phrase, and Hindi endings of one.
LANDMARK = r"(?iU)" + _NOT_BEFORE + r"(?:near|opp(?:osite)?|behind|beside|next\s+to|in\s+front\s+of|close\s+to)\s+[^,]+"
LANDMARK_HINDI = r"(?iU)([^,]+?\s+(?:ke\s+pas|ke\s+samne|ke\s+piche|ke\s+najdeek))" + _NOT_AFTER
POSTAL = _NOT_BEFORE + r"([1-9][0-9]{5}|[0-9]{5}(?:-[0-9]{4})?)" + _NOT_AFTER


def filled(c: Column) -> Column:
    """Missing text is empty text."""
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Words between white space; none for blank text."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")


def country(c: Column) -> Column:
    """Any label, stripped and in lower case."""
    return F.lower(strip(filled(c)))


def name(c: Column) -> Column:
    """Canonical business name: no addresses of web pages, no punctuation, legal forms spelled out."""
    s = F.regexp_replace(strip(filled(c)), r"[\u00a0\u200b\ufeff]", " ")
    s = F.regexp_replace(s, r"(?U)^[\s\-<>=*|#_~]+|[\s\-<>=*|#_~]+$", " ")
    s = F.regexp_replace(s, r"(?iU)https?://\S+|www\.\S+", " ")
    endings = "|".join(d.replace(".", r"\.") for d in NAME_DOMAINS)
    s = F.regexp_replace(s, rf"(?iu)\.(?:{endings}){_NOT_AFTER}", " ")
    s = F.lower(F.regexp_replace(s, r"[&+]", " and "))
    s = F.regexp_replace(s, r"(?U)[^\p{L}\p{N}\p{M}\s]", " ")
    for short, long in LEGAL_FORMS.items():
        s = F.regexp_replace(s, _NOT_BEFORE + short + _NOT_AFTER, long)
    return squeeze(s)


def address_words(c: Column) -> Column:
    """Lower-case words of an address with street words spelled out."""
    plain = F.lower(F.regexp_replace(c, r"(?U)[^\p{L}\p{N}\s]", " "))
    pairs = F.create_map(*(F.lit(x) for kv in STREET_WORDS.items() for x in kv))
    return F.transform(tokens(plain), lambda t: F.coalesce(F.try_element_at(pairs, t), t))


def address_text(c: Column) -> Column:
    return F.array_join(address_words(c), " ")


def _none(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def address_parts(c: Column) -> dict[str, Column]:
    """clean_address, street_tokens, city, state, postal_code and raw_landmark of an address.

    The comma-separated segments decide: a state code opening the last one, else a state code
    as the first one, else the last one is the state; the city is next to it.
    """
    raw = strip(filled(c))
    seg = F.filter(F.transform(F.split(raw, ","), strip), lambda x: x != "")
    n = F.size(seg)
    last, second_last = (F.lower(F.try_element_at(seg, F.lit(-i))) for i in (1, 2))
    first, second = (F.try_element_at(seg, F.lit(i)) for i in (1, 2))
    code = F.try_element_at(tokens(last), F.lit(1))
    ends, opens = code.isin(STATE_CODES), F.lower(first).isin(STATE_CODES)
    front = F.when(n > 2, F.array_join(F.slice(seg, 1, F.greatest(n - 2, F.lit(0))), ", ")).otherwise(first)
    rear = F.when(n > 2, F.array_join(F.slice(seg, 3, F.greatest(n - 2, F.lit(0))), ", "))
    state = F.when(n < 2, None).when(ends, code).when(opens, F.lower(first)).otherwise(last)
    city = F.when(n < 2, None).when(ends, second_last).when(opens, F.lower(second)).otherwise(second_last)
    street = F.when(n == 1, first).when(n < 1, None).when(ends, front).when(opens, rear).otherwise(front)
    landmark = F.coalesce(_none(F.regexp_extract(raw, LANDMARK, 0)), _none(F.regexp_extract(raw, LANDMARK_HINDI, 1)))
    return {
        "clean_address": address_text(raw),
        "street_tokens": F.coalesce(address_words(street), F.array().cast("array<string>")),
        "city": _none(address_text(city)),
        "state": _none(address_text(state)),
        "postal_code": _none(F.regexp_extract(raw, POSTAL, 1)),
        "raw_landmark": F.lower(strip(landmark)),
    }


def address(c: Column) -> Column:
    """The address as one struct, with the stripped original first."""
    return F.struct(strip(filled(c)).alias("raw_address"), *(v.alias(k) for k, v in address_parts(c).items()))
