"""Cleaning and normalisation as column expressions: all stay on the JVM side and inside code generation where it exists."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of an empty cell, of an empty input, Turkish letters and their plain forms,
# endings of neighbourhood names in the order in which one is dropped, words that say nothing in them.
EMPTY_WORDS = ["", "nan", "none", "null"]
EMPTY_INPUTS = ["", "nan", "none", "null", "n/a", "na", "-", "—"]
TURKISH, PLAIN = "ıİIşŞçÇğĞöÖüÜ", "iiissccggoouu"
NEIGHBOURHOOD_ENDINGS = [" mahallesi", " mahalle", " mh.", " mah.", " mh", " mah"]
NEIGHBOURHOOD_NOISE = ["mahallesi", "mahalle", "mah", "mh"]
GENERIC_STOPWORDS = ["ve", "and", "the", "of", "ltd", "sti", "san", "tic", "as", "prof", "dr", "doc", "op", "av"]


def _accents() -> tuple[str, str]:
    """Latin letters with marks and their bases, by canonical decomposition."""
    pairs = [(chr(c), base) for c in range(0xC0, 0x250) if len(base := "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) == 1 and base != chr(c)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, UNACCENTED = _accents()


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col(c).cast("string"), r"^\s+|\s+$", "")


def normalize_value(c: Column | str) -> Column:
    """Stripped and lower-cased; null and the spellings of nothing become the empty text."""
    low = F.lower(F.coalesce(strip(c), F.lit("")))
    return F.when(low.isin(EMPTY_WORDS), "").otherwise(low)


def is_filled(c: Column | str) -> Column:
    return col(c).isNotNull() & ~F.coalesce(F.lower(strip(c)), F.lit("")).isin(EMPTY_WORDS)


def is_empty_input(c: Column | str) -> Column:
    return F.coalesce(F.lower(strip(c)), F.lit("")).isin(EMPTY_INPUTS)


def normalize_name(c: Column | str) -> Column:
    """Turkish letters folded, accents dropped, lower-cased, punctuation to spaces, spaces collapsed."""
    folded = F.translate(F.coalesce(col(c).cast("string"), F.lit("")), TURKISH, PLAIN)
    bare = F.regexp_replace(F.translate(folded, ACCENTED, UNACCENTED), r"\p{M}+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(bare), r"(?U)[^\w\s]+", " "), r"(?U)\s+", " "))


def normalize_neighbourhood(c: Column | str) -> Column:
    """Folded like a name, but punctuation stays, and one ending goes: the first in order that fits."""
    folded = F.trim(F.lower(F.translate(F.coalesce(col(c).cast("string"), F.lit("")), TURKISH, PLAIN)))
    cut = reduce(lambda rest, end: F.when(folded.endswith(end), F.substring(folded, F.lit(1), F.length(folded) - len(end))).otherwise(rest), reversed(NEIGHBOURHOOD_ENDINGS), folded)
    return F.trim(F.regexp_replace(cut, r"\s+", " "))


def tokens(c: Column | str, stopwords: list[str] | None = None, least: int = 2) -> Column:
    """Words of a normalised name in order, without short ones and stopwords."""
    stop = GENERIC_STOPWORDS if stopwords is None else stopwords
    good = F.filter(F.split(normalize_name(c), " "), lambda t: F.length(t) >= least)
    return F.filter(good, lambda t: ~t.isin(stop)) if stop else good


def canonical(words: Column) -> Column:
    return F.array_join(words, " ")


def sorted_canonical(words: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def neighbourhood_tokens(c: Column | str) -> Column:
    return F.array_distinct(tokens(c, NEIGHBOURHOOD_NOISE))


def strip_place(words: Column, place: Column) -> Column:
    """Words without the place's, unless nothing would be left."""
    rest = F.array_except(words, place)
    return F.when(F.size(rest) > 0, rest).otherwise(F.array_distinct(words))


def neighbourhood_agrees(hint: Column, candidate: Column) -> Column:
    """Token sets: no hint agrees with all, a hint never with nothing."""
    return F.when(F.size(hint) == 0, True).when(F.size(candidate) == 0, False).otherwise(F.arrays_overlap(hint, candidate))


def pattern_matches(pattern: Column, name: Column, extra: int = 4) -> Column:
    """Several words: as a part of the name. One word: a word of it, with an ending of up to `extra` letters."""
    one = F.exists(F.split(name, " "), lambda t: t.startswith(pattern) & (F.length(t) - F.length(pattern) <= extra))
    return F.when(F.contains(pattern, F.lit(" ")), F.contains(name, pattern)).otherwise(one)


def slug(c: Column | str) -> Column:
    """File-name form of a place; empty becomes null."""
    low = F.lower(F.translate(F.translate(F.coalesce(strip(c), F.lit("")), TURKISH, PLAIN), ACCENTED, UNACCENTED))
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, "[^a-z0-9_]+", "_"), "_+", "_"), "^_+|_+$", "")
    return F.when(out != "", out)


def coerce_capacity(c: Column | str) -> Column:
    """Positive number from text with a point or a comma, else null."""
    value = F.replace(strip(c), F.lit(","), F.lit(".")).try_cast("double")
    return F.when((value > 0) & ~F.isnan(value), value)


def lookup(c: Column | str, table: dict[str, str]) -> Column:
    """Value of a small table, else the stripped, lower-cased key itself; null reads as the text "nan"."""
    key = F.lower(F.coalesce(strip(c), F.lit("nan")))
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), key)


def lookup_or_same(c: Column | str, table: dict[str, str]) -> Column:
    """Value of a small table; what isn't in it, nulls included, stays as it is."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, col(c)), col(c))


def bands(value: Column | str, edges: list[tuple[float, str]], rest: str, inclusive: bool = True, down: bool = False) -> Column:
    """Name of the first band that a value falls in; edges in order, `down` for bands from above."""
    v, out = col(value), F.lit(rest)
    for edge, name in reversed(edges):
        at = v >= edge if down else (v <= edge if inclusive else v < edge)
        out = F.when(at, name).otherwise(out)
    return out


def time_band(minutes: Column | str) -> Column:
    return bands(minutes, [(5, "Excellent"), (10, "Good"), (15, "Acceptable"), (30, "Far")], "Very far")


def confidence_label(score: Column | str) -> Column:
    return bands(score, [(4, "high"), (2, "medium"), (1, "low")], "none", down=True)


def percent_band(percent: Column | str) -> Column:
    return bands(percent, [(80, "good"), (50, "fair")], "poor", down=True)


def contains_text(columns: list[str], needle: str) -> Column:
    """Whether any column holds the text, whatever the case; an empty text is held by all."""
    low = needle.strip().lower()
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(low)) for c in columns]) if low else F.lit(True)


def name_variants(primary: Column, others: list[Column]) -> Column:
    """Primary name and alternates, each normalised form once, in order; the primary stays even if its form is empty."""
    every = F.filter(F.array(primary, *others), lambda x: is_filled(x))
    return F.aggregate(every, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: normalize_name(y) == normalize_name(x)), acc).otherwise(F.concat(acc, F.array(x))))


def content_hash(columns: list[str]) -> Column:
    """An aggregate that doesn't depend on the order of rows."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))
