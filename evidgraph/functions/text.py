"""Text expressions: search terms, stems, searchable text."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no search meaning.
STOP_WORDS = (
    "affected", "are", "change", "does", "explain", "exists", "from", "how", "into", "the", "that", "this", "used", "using",
    "what", "when", "where", "which", "why", "without",
)
# Suffixes in the order in which they are tried.
SUFFIXES = ("ization", "izations", "ations", "ation", "ing", "ed", "es", "s", "ly", "ence", "ance", "ment")

#: A word in any script.
WORD = r"[\p{L}\p{N}]+"


def _marked_letters() -> tuple[str, str]:
    """Letters that Unicode composes of a base letter and marks, and their base letters."""
    pairs = {}
    for point in (*range(0xC0, 0x250), *range(0x386, 0x460), *range(0x1E00, 0x2000)):
        parts = unicodedata.normalize("NFD", chr(point))
        if len(parts) > 1 and all(unicodedata.category(x) == "Mn" for x in parts[1:]):
            pairs[chr(point)] = parts[0]
    return "".join(pairs), "".join(pairs.values())


_MARKED, _BARE = _marked_letters()


def fold(text: Column) -> Column:
    """Lower case without diacritics; plain ASCII takes the short way."""
    bare = F.regexp_replace(F.translate(F.lower(text), _MARKED, _BARE), "\\p{Mn}+", "")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.lower(bare))


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits of any script. The one tokeniser of
    every index here."""
    return F.regexp_extract_all(fold(text), F.lit(f"({WORD})"), F.lit(1))


def camel_split(text: Column) -> Column:
    return F.regexp_replace(text, "(?<=[a-z0-9])(?=[A-Z])", " ")


def searchable_text(value: Column) -> Column:
    """The value, its pieces between . _ - / : and at case changes, and the
    lower-cased pieces; exact repeats go, order stays."""
    pieces = F.filter(F.split(F.regexp_replace(camel_split(value), "[._\\-/:]+", " "), " +"), lambda p: p != "")
    return F.array_join(F.array_distinct(F.concat(F.array(value), pieces, F.transform(pieces, F.lower))), " ")


def query_terms(query: Column) -> Column:
    """Distinct terms of two or more characters that are no stop words, in order."""
    split = F.regexp_replace(camel_split(query), "_", "-")
    return F.array_distinct(F.filter(tokens(split), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS)))


def stem(term: Column) -> Column:
    """The first listed suffix that leaves three or more characters goes."""
    chain = None
    for s in SUFFIXES:
        fits = F.endswith(term, F.lit(s)) & (F.length(term) - len(s) >= 3)
        cut = F.substring(term, F.lit(1), F.length(term) - len(s))
        chain = F.when(fits, cut) if chain is None else chain.when(fits, cut)
    return chain.otherwise(term)


def match_forms(term: Column) -> Column:
    """(form, is_prefix) for a term: itself and, if different, its stem as
    a prefix."""
    literal = F.struct(term.alias("form"), F.lit(False).alias("is_prefix"))
    prefix = F.struct(stem(term).alias("form"), F.lit(True).alias("is_prefix"))
    return F.when(stem(term) == term, F.array(literal)).otherwise(F.array(literal, prefix))


def one_line(value: Column, limit: int = 240) -> Column:
    return F.substring(F.trim(F.regexp_replace(value, "\\s+", " ")), 1, limit)


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-|-$", "")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def signature(paths: Column) -> Column:
    """First 16 hex digits of the digest of the sorted, NUL-joined members."""
    return F.substring(F.sha2(F.array_join(F.array_sort(paths), "\0").cast("binary"), 256), 1, 16)


def xml_escape(value: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value
