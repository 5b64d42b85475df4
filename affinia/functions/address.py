"""Address functions: numbers, anchor words, and sets of parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from affinia.functions.text import tokens

#: Words that name what follows them, numbers of floors, and words too common to tell addresses apart; fixed values.
LABELS = ("door", "house", "flat", "plot", "unit", "suite", "apt", "apartment", "room")
FLOORS = ("ground", "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth")
GENERIC = (
    "road", "rd", "street", "st", "lane", "ln", "drive", "dr", "avenue", "ave", "boulevard", "blvd", "highway", "hwy",
    "way", "place", "pl", "parkway", "pkwy", "circle", "cir", "court", "ct", "terrace", "ter", "square", "sq", "building",
    "bldg", "complex", "floor", "level", "block", "sector", "phase", "wing", "unit", "suite", "flat", "house", "door",
    "room", "apt", "apartment", "no", "near", "opp", "opposite", "city", "county", "district", "state", "village", "town",
    "township", "area",
)
ORDINAL = r"\p{Nd}+(?:st|nd|rd|th)"


def first_number(address: Column) -> Column:
    """The first run of digits, or an empty text."""
    return F.regexp_extract(F.coalesce(address, F.lit("")), r"(\p{Nd}+)", 1)


def house_number(address: Column) -> Column:
    """The first number of a normalized address with a letter right after it, without leading zeros."""
    return F.lower(F.regexp_replace(F.regexp_extract(address, r"(\p{Nd}+[A-Za-z]?)", 1), r"^0+(?=\p{Nd})", ""))


def first_word(address: Column) -> Column:
    """The first word of a normalized address."""
    return F.split_part(address, F.lit(" "), F.lit(1))


def first_unlabelled_word(address: Column) -> Column:
    """The first word after labels ('flat no 3', 'h no 9', 'no 7') and floors ('2nd floor') that begin a normalized address."""
    label = rf"(?:{'|'.join(LABELS)})(?: no(?: \S+)?)?"
    begins = rf"^(?:(?:{label}|h(?: no)?(?: \S+)?|no(?: \S+)?|(?:{'|'.join(FLOORS)}|{ORDINAL}) floor)(?: |$))+"
    return F.split_part(F.regexp_replace(address, begins, ""), F.lit(" "), F.lit(1))


def _numeric(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9A-Za-z]", "").rlike("^[0-9]+[A-Za-z]?$")


def _words(address: Column, keep) -> Column:
    """Words for which keep(word, next) holds, floors ('first floor', '3rd floor') left out."""

    def kept(words: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            following = F.coalesce(F.get(words, i + 1), F.lit(""))
            before = F.coalesce(F.get(words, i - 1), F.lit(""))
            storey = t.isin(*FLOORS) | t.rlike(f"^{ORDINAL}$")
            of_floor = (storey & (following == "floor")) | ((t == "floor") & (before.isin(*FLOORS) | before.rlike(f"^{ORDINAL}$")))
            return ~of_floor & keep(t)

        return F.filter(words, one)

    return F.transform(F.array(tokens(address)), kept)[0]


def first_alphabetic_word(address: Column) -> Column:
    """The first word with a letter that is neither numeric nor a label nor part of a floor."""
    words = _words(address, lambda t: ~_numeric(t) & t.rlike(r"\p{L}") & ~t.isin(*LABELS, "h", "no"))
    return F.coalesce(F.get(words, 0), F.lit(""))


def anchor_words(address: Column) -> Column:
    """Distinctive words of a normalized address, their ASCII letters alone: four or more, not generic, no floors or numbers."""
    words = _words(address, lambda t: ~_numeric(t) & ~t.isin(*GENERIC, *LABELS))
    return F.filter(F.transform(words, lambda t: F.regexp_replace(t, "[^A-Za-z]", "")), lambda t: (F.length(t) >= 4) & ~t.isin(*GENERIC))


def anchor_word(address: Column) -> Column:
    """The longest distinctive word, the first among equals, or an empty text."""
    ranked = F.transform(anchor_words(address), lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("at"), t.alias("t")))
    return F.coalesce(F.array_max(ranked)["t"], F.lit(""))


def cleaned(address: Column) -> Column:
    """Upper case, trimmed, dashes as '-', slashes and commas as spaces."""
    return F.translate(F.upper(F.trim(F.coalesce(address, F.lit("")))), "–—/,", "--  ")


def _unpadded(number: Column) -> Column:
    return F.regexp_replace(number, r"^0+(?=\p{Nd})", "")


def numbers(address: Column) -> Column:
    """Distinct numbers without leading zeros."""
    return F.array_distinct(F.transform(F.regexp_extract_all(cleaned(address), F.lit(r"(\p{Nd}+)"), F.lit(1)), _unpadded))


def compound_numbers(address: Column) -> Column:
    """Distinct numbers like 61-38D."""
    return F.array_distinct(F.regexp_extract_all(cleaned(address), F.lit(r"(?U)(\b\p{Nd}+[A-Z]?-\p{Nd}+[A-Z]?\b)"), F.lit(1)))


def parts(address: Column) -> Column:
    """Distinct words of ASCII letters and digits, joined by dashes."""
    return F.array_distinct(F.regexp_extract_all(cleaned(address), F.lit("([A-Z0-9]+(?:-[A-Z0-9]+)*)"), F.lit(1)))


def postal_codes(address: Column) -> Column:
    """Distinct numbers of four to six digits, without leading zeros."""
    return F.array_distinct(F.transform(F.regexp_extract_all(cleaned(address), F.lit(r"(?U)(\b\p{Nd}{4,6}\b)"), F.lit(1)), _unpadded))


def first_plain_number(address: Column) -> Column:
    """The first number without leading zeros, or an empty text."""
    return _unpadded(first_number(cleaned(address)))
