"""Text expressions: token folding, white space, digests, URL-safe base64."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that keep their marks, and letters that fold outside decomposition; fixed values of the tokenizer.
UNFOLDED = "ǡǣǯǽǿ"
FOLDED = {"ſ": "s", "ẛ": "s"}
#: Latin blocks with precomposed letters.
LATIN = (range(0xC0, 0x250), range(0x1E00, 0x1F00))
SEPARATORS = r"[^\p{L}\p{N}\p{Co}]+"


@cache
def folding() -> tuple[str, str]:
    """Lower-case precomposed Latin letters and the base letters that they fold to."""
    found = dict(FOLDED)
    for block in LATIN:
        for c in map(chr, block):
            base = unicodedata.normalize("NFD", c)[0]
            if c == c.lower() and c not in UNFOLDED and base != c and base.isascii():
                found[c] = base
    return "".join(found), "".join(found.values())


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{M}", ""), *folding())


def tokens(text: Column) -> Column:
    """Folded tokens of a text, in order; null has none."""
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), SEPARATORS), lambda t: t != "")


def plain_tokens(text: str) -> list[str]:
    """The same tokens for a query text on the driver."""
    lower = "".join(c for c in text.lower() if not unicodedata.category(c).startswith("M"))
    folded = lower.translate(str.maketrans(*folding()))
    runs = re.split(r"\s+", "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in folded))
    return [t for t in runs if t]


def collapse(text: Column) -> Column:
    """Runs of white space, Unicode's included, as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def stable_id(*parts: Column) -> Column:
    """The first 32 hex digits of SHA-256 over parts joined by the unit separator."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)


def heading_key(text: Column) -> Column:
    """Upper case, letters and digits only."""
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]+", "")


def base64url(raw: Column) -> Column:
    """URL-safe base64 without padding."""
    return F.rtrim(F.translate(F.translate(F.base64(raw), "\r\n", ""), "+/", "-_"), F.lit("="))
