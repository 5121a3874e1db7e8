"""Text cleaning and formatting as column expressions."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EDGES = r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$"

# The ordered rewrites that undo the spacing of tokenised news text. "s" replaces a string, "r" a
# regular expression; $1 is the first group.
DETOKENISE = (
    ("s", "http : / / ", "http://"), ("s", "https : / / ", "https://"),
    ("r", r" '(\w+)", "'$1"), ("r", r" (\w+) \. ", " $1. "), ("r", r" (\w+) \.$", " $1."),
    ("s", " ? ", "? "), ("r", r" \?$", "?"), ("s", " ! ", "! "), ("r", r" !$", "!"),
    ("s", " , ", ", "), ("s", " : ", ": "), ("s", " ; ", "; "), ("s", " / ", "/"),
    ("r", r'" ([^"]+) "', '"$1"'), ("r", r"' ([^']+) '", "'$1'"), ("r", r"\( ([^()]+) \)", "($1)"), ("r", r"\[ ([^\[\]]+) \]", "[$1]"),
    ("s", "$ ", "$"), ("s", "£ ", "£"),
)

# Artefacts of encyclopaedia text.
ARTEFACTS = (("s", " @-@ ", "-"), ("s", " @,@ ", ","), ("s", " @.@ ", "."), ("r", r"\s+([,.:;?!%)])", "$1"), ("r", r"([(])\s+", "$1"), ("s", " ' ", "'"))

# Fixed value: the 27 symbols of the character vocabulary, ids in order.
CHARACTERS = "_abcdefghijklmnopqrstuvwxyz"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, _EDGES, "")


def rewrite(x: Column, rules: tuple[tuple[str, str, str], ...], unicode_words: bool = False) -> Column:
    """Apply ordered rewrites. ``unicode_words`` lets ``\\w`` mean letters of all scripts."""
    for kind, old, new in rules:
        x = F.replace(x, F.lit(old), F.lit(new)) if kind == "s" else F.regexp_replace(x, ("(?U)" if unicode_words else "") + old, new)
    return x


def detokenise(x: Column, unicode_words: bool = False) -> Column:
    return strip(rewrite(strip(F.coalesce(x, F.lit(""))), DETOKENISE, unicode_words))


def normalise_newlines(x: Column) -> Column:
    """Line ends to ``\\n``, ends stripped, null to the empty text."""
    return strip(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))


def clean_artefacts(x: Column) -> Column:
    return strip(rewrite(x, ARTEFACTS))


def letters_only(x: Column) -> Column:
    """Lower case, underscores to spaces, every other character than a-z to a space; runs are kept."""
    return F.regexp_replace(F.lower(F.replace(x, F.lit("_"), F.lit(" "))), "[^a-z ]", " ")


def character_ids(x: Column) -> Column:
    """Ids of the lower-cased characters; a space and what is unknown are the underscore, id 0."""
    return F.transform(F.filter(F.split(F.lower(x), ""), lambda c: c != ""), lambda c: F.greatest(F.instr(F.lit(CHARACTERS), c) - 1, F.lit(0)))


def from_character_ids(ids: Column) -> Column:
    return F.replace(F.array_join(F.transform(ids, lambda i: F.when((i >= 0) & (i < len(CHARACTERS)), F.substring(F.lit(CHARACTERS), i + 1, F.lit(1))).otherwise(F.lit("_"))), ""), F.lit("_"), F.lit(" "))


def words(x: Column) -> Column:
    """Lower-cased runs of non-space characters; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"(\S+)"), F.lit(1))


def sanitise(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9_.=-]+", "_")


def safe_name(x: Column) -> Column:
    return F.translate(x, "/-:", "___")


@F.pandas_udf(T.StringType())
def _blake2b(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else hashlib.blake2b(s.encode(), digest_size=16).hexdigest())


def short_folder(key: Column, hashed: Column | None = None) -> Column:
    """At most 64 sanitised characters without ends of ``._-`` (``cache`` if none is left), and a 128-bit hash.

    ``hashed`` replaces the BLAKE2b hash, for which Spark has no function, for instance by ``sha2``.
    """
    head = F.regexp_replace(F.substring(sanitise(key), 1, 64), "^[._-]+|[._-]+$", "")
    return F.concat(F.when(head == "", F.lit("cache")).otherwise(head), F.lit("__h="), hashed if hashed is not None else _blake2b(key))


@F.pandas_udf(T.StringType())
def general_format(x: pd.Series) -> pd.Series:
    """Eight significant digits in the shortest form, as C's ``%.8g``; null is ``none``."""
    values = x.to_numpy(np.float64)
    return pd.Series(np.where(np.isnan(values), "none", np.char.mod("%.8g", np.nan_to_num(values, posinf=np.inf, neginf=-np.inf))), dtype=object)


def count_literal(x: Column, what: str) -> Column:
    """Non-overlapping occurrences of a string."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(what), F.lit("")))) / len(what)).cast("long")


def split_prompt(full: Column, prompt: Column, rest: Column) -> Column:
    """The text after the prompt where the full text begins with it, else the separately decoded rest."""
    return F.when(F.length(prompt) == 0, full).when(F.startswith(full, prompt), F.substring(full, F.length(prompt) + 1, F.length(full))).otherwise(rest)


def html_escape(x: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def clock(seconds: Column) -> Column:
    """Seconds as ``1h 02m 03s``, ``2m 03s`` or ``3s``."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, r)).when(m > 0, F.format_string("%dm %02ds", m, r)).otherwise(F.format_string("%ds", r))


def bit_preview(bits: Column, most: int) -> Column:
    """Leading bits as text, with a mark where some are left out."""
    return F.concat(F.array_join(F.slice(bits.cast("array<string>"), 1, most), ""), F.when(F.size(bits) > most, F.lit("...")).otherwise(F.lit("")))


def bit_chunks(bits: Column, width: int, most: int) -> Column:
    """Leading groups of ``width`` bits, parted by bars."""
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.least(F.ceil(F.size(bits) / width).cast("int"), F.lit(most)) - 1, F.lit(0))), lambda k: F.array_join(F.slice(bits.cast("array<string>"), k * width + 1, F.lit(width)), ""))
    return F.concat(F.array_join(groups, " | "), F.when(F.size(bits) > width * most, F.lit(" ...")).otherwise(F.lit("")))
