"""Text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations after whose full stop no sentence ends.
ABBREVIATIONS = ("e.g", "i.e", "etc", "vs", "dr", "mr", "mrs", "ms", "prof", "inc", "ltd", "jr", "sr", "st", "ave", "dept", "est", "approx", "fig", "vol", "no")
# Link and macro schemes whose targets are not prose.
SCHEMES = ("https?://", "ftp://", "mailto:", "link:", "xref:", "image:", "video:", "audio:")

ALNUM = r"[\p{IsAlphabetic}\p{N}]"
_NOT_IN_WORD = rf"(?<!{ALNUM})"
_SENTENCE_END = (
    r"(?U)(?<=[.!?])(?<!" + _NOT_IN_WORD + "(?i:" + "|".join(re.escape(a) for a in ABBREVIATIONS) + r")\.)\s+(?=\p{IsUppercase})"
)
_EDGES = r"(?U)^\s+|\s+$"
#: Stands for a masked stretch; no text is expected to hold it.
MASK = ""
_VERBATIM = r"(?s)(?U)(`+)(?!`).*?(?<!`)\1(?!`)|\]\([^)]*\)|(?<![\p{IsAlphabetic}\p{N}_])(?:" + "|".join(SCHEMES) + r")[^\s\[]*"


def trim(text: Column) -> Column:
    """text without white space, of any kind, at its ends."""
    return F.regexp_replace(text, _EDGES, "")


def split_sentences(text: Column) -> Column:
    """Array of the sentences: cut after ``. ! ?`` where white space and an upper-case letter follow, not after an abbreviation; trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, _SENTENCE_END), trim), lambda x: x != "")


def normalize_inline(text: Column) -> Column:
    """One line of a multi-line inline text: later lines lose leading quote marks and spaces; blank ones go; one space joins them."""
    right = lambda x: F.regexp_replace(x, r"(?U)\s+$", "")
    lines = F.split(text, "\n")
    rest = F.filter(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: right(F.regexp_replace(x, r"(?U)^[>\s]+", ""))), lambda x: x != "")
    return F.array_join(F.concat(F.array(right(F.get(lines, F.lit(0)))), rest), " ")


def segment_id(section: Column, block: Column, segment: Column) -> Column:
    return F.format_string("section:%d/block:%d/seg:%d", section, block, segment)


_ID = r"^section:(\d+)/block:(\d+)/seg:(\d+)$"


def segment_position(ident: Column) -> Column:
    """struct(section, block, segment) of an id; null where it is malformed."""
    part = lambda k: F.split_part(F.split_part(ident, F.lit("/"), F.lit(k)), F.lit(":"), F.lit(2)).try_cast("bigint")
    return F.when(ident.rlike(_ID), F.struct(part(1).alias("section"), part(2).alias("block"), part(3).alias("segment")))


def flat_index(ident: Column) -> Column:
    """section * 10**6 + block * 10**3 + segment, and 0 for a malformed id."""
    at = segment_position(ident)
    return F.coalesce(at["section"] * 1_000_000 + at["block"] * 1_000 + at["segment"], F.lit(0).cast("bigint"))


def mask_verbatim(text: Column) -> Column:
    """text with back-quoted spans and link or macro targets each replaced by one MASK."""
    return F.regexp_replace(text, _VERBATIM, MASK)


def term_pattern(term: Column) -> Column:
    r"""Regular expression of a lower-cased term between word boundaries; the term is taken letter by letter."""
    quoted = F.regexp_replace(F.lower(term), r"\\E", r"\\E\\\\E\\Q")
    return F.concat(F.lit(r"(?<![\p{IsAlphabetic}\p{N}_])\Q"), quoted, F.lit(r"\E(?![\p{IsAlphabetic}\p{N}_])"))


def has_term(text: Column, term: Column) -> Column:
    """Whether the prose of text holds the term, whatever the case; an empty term is in no text."""
    return (term != "") & F.rlike(mask_verbatim(F.lower(text)), term_pattern(term))


def extract_urls(text: Column) -> Column:
    """http and https addresses in order, up to white space, ``< > "`` or a closing parenthesis without its opening one; trailing ``. , ;`` dropped."""
    found = F.regexp_extract_all(text, F.lit(r"""(https?://(?:\([^\s<>"()]*\)|[^\s<>"()]|\((?=[^()]*(?:[\s<>"]|$)))*)"""), F.lit(1))
    return F.transform(found, lambda u: F.regexp_replace(u, r"[.,;]+$", ""))


def preview(text: Column, most: int) -> Column:
    cut = trim(text)
    return F.when(F.length(cut) > most, F.concat(F.substring(cut, 1, most), F.lit("…"))).otherwise(cut)


def strip_role_headers(text: Column) -> Column:
    """text without ``{role arguments}`` that begin with a letter."""
    return F.regexp_replace(text, r"\{[A-Za-z][^}]*\}", "")


def heading_slug(text: Column) -> Column:
    """ASCII slug: lower-case letters and digits, every other run one hyphen; marks ``*_`` and back quotes vanish, as do brace groups, an open one to the end."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\{[^}]*(\}|$)", ""), "[`*_]", "")
    return F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def file_slug(name: Column) -> Column:
    """As heading_slug, with a hyphen also where a camel-case word or a run of capitals ends."""
    cut = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1-$2"), "([A-Z]+)([A-Z][a-z])", "$1-$2")
    return F.regexp_replace(F.regexp_replace(F.lower(cut), "[^a-z0-9]+", "-"), "^-+|-+$", "")


# The East Asian wide ranges, as first and last code point.
WIDE = (
    (0x1100, 0x115F),
    (0x2E80, 0x303E),
    (0x3041, 0x33FF),
    (0x3400, 0x4DBF),
    (0x4E00, 0x9FFF),
    (0xA000, 0xA4CF),
    (0xAC00, 0xD7A3),
    (0xF900, 0xFAFF),
    (0xFE30, 0xFE4F),
    (0xFF00, 0xFF60),
    (0xFFE0, 0xFFE6),
    (0x20000, 0x2FFFD),
    (0x30000, 0x3FFFD),
)


def display_width(text: Column) -> Column:
    """Columns that text takes: two for a wide character, one for any other."""
    other = "[^" + "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in WIDE) + "]"
    return F.length(text) + F.length(F.regexp_replace(text, other, ""))


def has_word(text: Column) -> Column:
    return text.rlike(ALNUM)
