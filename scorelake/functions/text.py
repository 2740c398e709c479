"""Names and titles as keys. Column in, Column out; null gives null unless said otherwise."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(1)
def _accents() -> tuple[str, str]:
    """Characters whose decomposition begins with a Latin letter, and that letter; then the combining marks, which go."""
    plain = {}
    for c in map(chr, range(0x80, min(sys.maxunicode, 0x2FFF) + 1)):
        whole = unicodedata.normalize("NFD", c)
        if len(whole) > 1 and whole[0].isascii() and all("̀" <= m <= "ͯ" for m in whole[1:]):
            plain[c] = whole[0]
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(plain) + marks, "".join(plain.values())


def fold(text: Column) -> Column:
    """Without accents, in lower case, every run of other characters than letters a-z and digits one blank; null is empty."""
    text = F.coalesce(text, F.lit(""))
    # Looking each character up is dear: only where one isn't ASCII.
    plain = F.lower(F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, *_accents())).otherwise(text))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def slug(text: Column) -> Column:
    return F.replace(fold(text), F.lit(" "), F.lit("-"))


def sort_form(name: Column) -> Column:
    """"Anna Maria Bach" as "Bach, Anna Maria"; a single word stays as it is."""
    parts = F.split(F.trim(name), r"\s+")
    others = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " ")
    return F.when(F.size(parts) > 1, F.concat(F.element_at(parts, -1), F.lit(", "), others)).otherwise(name)


def display_name(sorted_name: Column) -> Column:
    """"Bach, Anna Maria" as "Anna Maria Bach", "Bach, Johann, Jr" as "Johann, Jr Bach"; what has no comma stays as it is."""
    parts = F.transform(F.split(sorted_name, ","), lambda p: F.trim(p))
    behind = F.array_join(F.slice(parts, F.lit(2), F.size(parts)), ", ")
    return F.when(F.size(parts) > 1, F.trim(F.concat(behind, F.lit(" "), F.element_at(parts, 1)))).otherwise(sorted_name)


#: Single names that stand for a composer.
COLLECTIVE = ("Various", "Anonymous", "Traditional")


def title_composer(page: Column) -> Column:
    """Struct of title and composer from "Work (Surname, Forename)"; without a comma only a collective name is a composer."""
    head, inside = F.regexp_extract(page, r"^(.*)\(([^()]*)\)\s*$", 1), F.regexp_extract(page, r"^(.*)\(([^()]*)\)\s*$", 2)
    names = inside.contains(",") | F.trim(inside).isin(*COLLECTIVE)
    return F.struct(F.when(names, F.trim(head)).otherwise(F.trim(page)).alias("title"), F.when(names, F.trim(inside)).alias("composer"))


def without_disambiguator(title: Column) -> Column:
    """Without a closing "(…)"; the whole title if nothing else is in it."""
    rest = F.trim(F.regexp_replace(title, r"\s*\([^()]*\)\s*$", ""))
    return F.coalesce(F.nullif(rest, F.lit("")), title)


def natural_key(text: Column) -> Column:
    """A string that sorts as the folded text with its numbers compared as numbers: each has its count of digits before it."""
    parts = F.regexp_extract_all(fold(text), F.lit(r"(\d+|\D+)"))
    digits = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    counted = lambda p: F.concat(F.lpad(F.length(digits(p)).cast("string"), 6, "0"), digits(p))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), counted(p)).otherwise(p)), "")
