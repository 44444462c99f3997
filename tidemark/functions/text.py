"""Normalization of names and titles, and small parsers, as column expressions."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.stats import let

# Variant markers in the order in which they are tried, a deluxe album's, and marks of guests and tails.
VARIANTS = (
    ("remaster", r"\b(?:\d{4}\s*)?remaster(?:ed)?(?:\s*\d{4})?\b|\banniversary\b"),
    ("live", r"\blive\b|\bunplugged\b|\bconcert\b|\bmtv\b"),
    ("radio_edit", r"\bradio\s*(?:edit|mix|version)\b|\bsingle\s*(?:edit|version)\b|\bshort\s*(?:edit|version)\b"),
    ("extended", r"\bextended\b|\bclub\s*mix\b|\b12[\"']?\s*(?:mix|version)\b"),
    ("remix", r"\bremix\b|\bre-?work\b|\bflip\b|\bedit\b(?!\w)"),
    ("acoustic", r"\bacoustic\b|\bstripped\b|\bpiano\s*version\b"),
    ("demo", r"\bdemo\b|\brough\s*mix\b|\bouttake\b"),
    ("clean", r"\bclean\b|\bcensored\b|\bedited\s*version\b"),
    ("explicit", r"\bexplicit\b|\buncensored\b"),
    ("instrumental", r"\binstrumental\b"),
    ("sped_up", r"\bsped\s*up\b|\bslowed\b(?:\s*\+?\s*reverb)?|\bnightcore\b"),
    ("version", r"\b(?:mono|stereo|album|original|deluxe|bonus(?:\s*track)?|tv|japanese|uk|us)\s*(?:version|mix|edition)?\b"),
)
ALBUM_DELUXE = r"\b(?:deluxe|expanded|special|anniversary|super|platinum|tour|collector'?s?)\s*(?:edition|version)?\b|\(.*bonus.*\)"
CHUNK = r"[(\[]([^)\]]*)[)\]]"
DASH_TAIL = r"\s[-–—]\s(.+)$"
GUESTS = r"\b(?:feat\.?|featuring|ft\.?|with|w/)\s+.*$"
ARTIST_SPLIT = r",|&|\bfeat\.?\b|\bft\.?\b"
BARE = ("remaster", "live")


@F.pandas_udf(StringType())
def fold_ascii(s: pd.Series) -> pd.Series:
    """Compatibility decomposition with everything beyond ASCII left out; exact for any script."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


@lru_cache
def _folds() -> tuple[str, str]:
    """Characters that decompose to a single ASCII character, and these."""
    pairs = [(chr(c), f) for c in range(128, min(sys.maxunicode, 0x2FFFF)) if not 0xD800 <= c <= 0xDFFF and len(f := unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) == 1]
    return "".join(a for a, _ in pairs if len(a.encode("utf-16-le")) == 2), "".join(b for a, b in pairs if len(a.encode("utf-16-le")) == 2)


def fold_ascii_native(c: Column) -> Column:
    """``fold_ascii`` without Python, for characters that decompose to one ASCII character; others are left out."""
    a, b = _folds()
    return F.regexp_replace(F.translate(c, a, b), r"[^\x00-\x7F]", "")


def squeeze(c: Column) -> Column:
    """Lower case, punctuation to spaces, runs of white space to one, none at the ends; for folded text."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\w\s]", " "), r"\s+", " "))


def normalize(c: Column, native: bool = False) -> Column:
    return squeeze(fold_ascii_native(c) if native else fold_ascii(c))


def tags_of(c: Column, names=None) -> Column:
    """Names of the variant markers found in a text, in the order tried."""
    return F.array_compact(F.array(*[F.when(c.rlike(f"(?iU){p}"), F.lit(n)) for n, p in VARIANTS if names is None or n in names]))


def parse_title(title: Column, album: Column) -> Column:
    """Struct of base_title, variant_type and variant_tags (sorted).

    Chunks in brackets and after a dash that have a marker are cut off. Without any, the bare title is looked at
    for remasters and concerts only. Guests are cut off, the word "with" counting as their mark.
    """
    tail = F.regexp_extract(title, DASH_TAIL, 1)
    chunks = F.concat(F.regexp_extract_all(title, F.lit(CHUNK), F.lit(1)), F.when(tail != "", F.array(tail)).otherwise(F.array().cast("array<string>")))
    tagged = F.filter(F.transform(chunks, lambda c: F.struct(c.alias("chunk"), tags_of(c).alias("tags"))), lambda x: F.size(x["tags"]) > 0)

    def of_marked(marked: Column) -> Column:
        found = F.when(F.size(marked) > 0, F.flatten(F.transform(marked, lambda x: x["tags"]))).otherwise(tags_of(title, BARE))
        deluxe = F.coalesce(album.rlike(f"(?iU){ALBUM_DELUXE}"), F.lit(False))
        found = F.concat(found, F.when(deluxe, F.array(F.lit("deluxe"))).otherwise(F.array().cast("array<string>")))
        cut = F.aggregate(marked, title, lambda acc, x: F.replace(F.replace(acc, F.concat(F.lit("("), x["chunk"], F.lit(")")), F.lit(" ")), F.concat(F.lit("["), x["chunk"], F.lit("]")), F.lit(" ")))
        cut = F.when(F.exists(marked, lambda x: x["chunk"] == tail), F.regexp_replace(cut, DASH_TAIL, " ")).otherwise(cut)
        base = F.btrim(F.regexp_replace(cut, f"(?iU){GUESTS}", ""), F.lit(" -–—"))
        return let(F.struct(found.alias("found"), base.alias("base")), named)

    def named(x: Column) -> Column:
        primary = F.get(F.filter(x["found"], lambda t: ~t.isin("version", "deluxe")), F.lit(0))
        kind = F.coalesce(primary, F.when(F.array_contains(x["found"], "deluxe"), F.lit("deluxe")), F.lit("original"))
        return F.struct(F.when(x["base"] != "", x["base"]).otherwise(title).alias("base_title"), kind.alias("variant_type"), F.array_sort(F.array_distinct(x["found"])).alias("variant_tags"))

    return let(tagged, of_marked)


def primary_artist(artist: Column) -> Column:
    return F.split(artist, f"(?iU){ARTIST_SPLIT}", 2)[0]


def words(c: Column) -> Column:
    """Distinct words of a normalized text."""
    return F.array_remove(F.array_distinct(F.split(c, " ")), "")


def overlap(x: Column, y: Column) -> Column:
    """Share of words that two arrays of distinct words have in common; 0 if one has none."""
    shared = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(shared / (F.size(x) + F.size(y) - shared).cast("double"))


def jaccard(a: Column, b: Column) -> Column:
    """Share of words that two normalized texts have in common; 0 if one has none."""
    return overlap(words(a), words(b))


def occurrences(text: Column, *patterns: str) -> Column:
    """How often plain strings occur in the lower-cased text, none overlapping itself."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [F.size(F.split(low, re.sub(r"([\[\]\\^$.|?*+(){}])", r"\\\1", p), -1)) - 1 for p in patterns]).cast("long")


def uri_id(uri: Column, kind: str = "track") -> Column:
    """Id of a three-part URI of the kind; null for others."""
    parts = F.split(uri, ":")
    return F.when((F.size(parts) == 3) & (parts[1] == kind), F.element_at(parts, -1))


def last_segment(href: Column) -> Column:
    """Last part of a path, whatever slashes follow."""
    found = F.regexp_extract(href, r"([^/]+)/*$", 1)
    return F.when(found != "", found)


def leading_year(date: Column) -> Column:
    return F.when(date.rlike(r"^\d{4}"), F.substring(date, 1, 4).cast("int"))


def decade(year: Column) -> Column:
    return F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s"))


def eta(hours: Column) -> Column:
    """Time left in minutes, hours or days; a dash without one."""
    return (
        F.when(hours.isNull() | F.isnan(hours) | (hours <= 0), "—")
        .when(hours < 1, F.concat(F.lit("~"), F.floor(hours * 60).cast("string"), F.lit(" min")))
        .when(hours < 48, F.format_string("~%.1f h", hours))
        .otherwise(F.format_string("~%.1f days", hours / 24))
    )


def first_artist(artists: Column) -> Column:
    """First name of a JSON list of names, of a list of objects with a name, or of an object; else the text itself."""
    got = lambda path: F.get_json_object(artists, path)
    return F.coalesce(got("$[0].name"), got("$[0]"), got("$.name"), F.nullif(artists, F.lit("")))
