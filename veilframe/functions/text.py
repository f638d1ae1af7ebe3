"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data format.
PRONOUNS = ("i", "you", "he", "she", "it", "we", "they", "the", "a", "an")
TYPE_ALIASES = {"PER": "PERSON", "ORGANIZATION": "ORG", "COMPANY": "ORG", "LOCATION": "LOC", "GPE": "LOC", "PLACE": "LOC"}
TYPES = ("PERSON", "ORG", "LOC", "EMAIL", "PHONE", "MISC")
NAME_TYPES = ("PERSON", "ORG", "LOC")
NON_NAME = r"@|https?://|www\.|^[0-9]{1,3}(\.[0-9]{1,3}){3}|^[0-9]+$|\.\.\."
PREVIEW = 400
#: Characters between tokens.
BLANK = " \\t\\n\\r\\f"
TOKEN = f"[^{BLANK}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def strip_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def without_exempt(body: Column) -> Column:
    """Drops {{...}}, which is exempt from the leak check."""
    return F.regexp_replace(body, r"(?s)\{\{.*?\}\}", "")


def type_alias(kind: Column, allowed: tuple[str, ...] = TYPES) -> Column:
    """The canonical type, null when it is none of ``allowed``."""
    up = F.upper(kind)
    mapped = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in TYPE_ALIASES.items() for x in pair)), up), up)
    return F.when(mapped.isin(*allowed), mapped)


def is_name_like(text: Column, placeholders: bool = False) -> Column:
    """Not an address, URL, number or ellipsis; with ``placeholders``, nor something in brackets."""
    return ~text.rlike(NON_NAME + (r"|^\[" if placeholders else ""))


def is_pronoun_or_short(text: Column) -> Column:
    return F.lower(text).isin(*PRONOUNS) | (F.length(text) <= 2)


def preview(text: Column, most: int = PREVIEW) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def identifiers(words: Column, least: int = 6, most: int = 40) -> Column:
    """Identifier tokens, at most ``most``; null when there are fewer than ``least``."""
    kept = F.filter(words, lambda w: w.rlike("^[A-Za-z_][A-Za-z0-9_]{1,}$"))
    return F.when(F.size(kept) >= least, F.slice(kept, 1, most))


#: Long strings, strings, comments to the end of the line, and comments between marks.
STRIPPED = r"""(?s)\"{3}.*?\"{3}|'{3}.*?'{3}|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|(?:#|//)[^\n]*|/\*.*?\*/"""


def strip_code(text: Column) -> Column:
    """Drops comments and string literals of C-like and Python-like code, triple-quoted ones before plain ones."""
    return F.regexp_replace(text, STRIPPED.replace(")*", ")*+"), " ")
