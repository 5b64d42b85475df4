"""Text normalization as column expressions.

Everything here runs in the JVM but ``nfkc_casefold``, which SQL users can register. Spark has no function
for Unicode normal forms; ICU, which it ships, is called for texts beyond ASCII.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from affinia.functions.scripts import script

#: Legal forms at the end of names, longest first; fixed values.
LEGAL_SUFFIXES = (
    "limited liability partnership", "limited liability company", "private limited", "public limited", "incorporated",
    "pvt limited", "private ltd", "corporation", "public ltd", "pvt ltd", "limited", "company", "corp", "pllc", "ltd",
    "llc", "llp", "inc", "plc", "p c", "co", "pc",
)
#: Single words that the alternative profile takes as a legal form; fixed values.
LEGAL_WORDS = (
    "llc", "ltd", "limited", "inc", "incorporated", "corp", "corporation", "co", "company", "plc", "lp", "llp", "pvt",
    "private", "gmbh", "sarl", "sas", "sa", "ag", "bv", "oy", "ab",
)
#: Forms of address that begin names; fixed values.
TITLES = ("the", "dr", "mr", "mrs", "ms", "miss", "prof", "smt", "shri", "sri")
#: Digits read for letters by character recognition; a fixed value.
MISREAD, MEANT = "01568", "olsgb"


@F.pandas_udf(StringType())
def nfkc_casefold(texts: pd.Series) -> pd.Series:
    """NFKC and full case folding; a null is an empty text."""
    return texts.map(lambda t: "" if t is None else t.lower() if t.isascii() else unicodedata.normalize("NFKC", t).casefold())


def folded(text: Column) -> Column:
    """Case folding that needs no Python: exact for text in NFKC but for a few rare letters."""
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))


def nfkc_folded(text: Column) -> Column:
    """NFKC, then full case folding; null is empty. Texts in ASCII are lower-cased alone.

    A call by reflection is never merged with or moved past a filter, so filter first.
    """
    text = F.coalesce(text, F.lit(""))
    composed = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    folded_text = F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(folded_text)


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalized(text: Column, unicode: bool = True) -> Column:
    """Names and addresses: NFKC (unless unicode is False), folded; letters, digits and marks kept, all else a space."""
    text = nfkc_folded(text) if unicode else folded(text)
    return F.trim(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}\p{M}]+", " "))


def loosely_normalized(text: Column) -> Column:
    """Lower case, runs of other than word characters as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\p{L}\p{N}_]+", " "))


def stripped(text: Column, blank_nan: bool = False) -> Column:
    """Without white space at the ends; null is empty, as is 'nan' if asked for."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(F.lower(bare) == "nan", "").otherwise(bare) if blank_nan else bare


def tokens(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def first_token(text: Column) -> Column:
    return F.coalesce(F.try_element_at(tokens(text), F.lit(1)), F.lit(""))


def last_token(text: Column) -> Column:
    return F.coalesce(F.try_element_at(tokens(text), F.lit(-1)), F.lit(""))


def legal_suffix(name: Column) -> Column:
    """The longest legal form that ends a normalized name, or an empty text."""
    return F.regexp_extract(name, f"(?:^|\\s)({'|'.join(LEGAL_SUFFIXES)})$", 1)


def without_legal_suffix(name: Column) -> Column:
    """A normalized name without its legal forms: each is taken off once, the longer ones first."""
    return reduce(lambda n, suffix: F.regexp_replace(n, f"\\s+{suffix}$", ""), LEGAL_SUFFIXES, name)


def without_legal_word(name: Column) -> Column:
    """A normalized name without its last word if that is a legal form; else the name."""
    words = tokens(name)
    return F.when(F.array_contains(F.array(*map(F.lit, LEGAL_WORDS)), last_token(name)), F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")).otherwise(name)


def without_titles(name: Column) -> Column:
    """A normalized name without the forms of address that begin it, 'm s' among them."""
    return F.regexp_replace(name, f"^(?:(?:{'|'.join(TITLES)})(?: |$)|m s(?: |$))+", "")


def name_first(name: Column) -> Column:
    """Blocking value: the first word."""
    return F.split_part(name, F.lit(" "), F.lit(1))


def name_prefix2(name: Column) -> Column:
    """Blocking value: the first two characters, spaces left out."""
    return F.substring(F.replace(name, F.lit(" "), F.lit("")), 1, 2)


def without_misreadings(name: Column) -> Column:
    """Digits in words that also have letters become the letters they are misread from; ordinals stay."""
    fixed = F.transform(F.split(name, " "), lambda t: F.when(t.rlike(r"\p{L}") & ~t.rlike(r"^\p{Nd}+(?:st|nd|rd|th)$"), F.translate(t, MISREAD, MEANT)).otherwise(t))
    return F.array_join(fixed, " ")


def normalized_record(name: Column, address: Column, country: Column, unicode: bool = True) -> dict[str, Column]:
    """The 14 columns of a normalized record."""
    n, a = normalized(name, unicode), normalized(address, unicode)
    return {
        "business_name_raw": F.coalesce(name, F.lit("")),
        "business_address_raw": F.coalesce(address, F.lit("")),
        "country_raw": F.coalesce(country, F.lit("")),
        "business_name_normalized": n,
        "business_address_normalized": a,
        "business_name_without_suffix": without_legal_suffix(n),
        "legal_suffix": legal_suffix(n),
        "name_token_count": F.size(tokens(n)),
        "address_token_count": F.size(tokens(a)),
        "name_length": F.length(n),
        "address_length": F.length(a),
        "name_first_token": first_token(n),
        "name_last_token": last_token(n),
        "name_script": script(n),
        "address_script": script(a),
    }
