"""Text cleaning as Column expressions.

Entities and compatibility forms have no built-in function in Spark; they go
through one Arrow UDF that leaves other texts untouched. All other steps stay
in the JVM.
"""

from __future__ import annotations

import html
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F

# What is removed from a text, in order.
INVISIBLE = r"[\x{00AD}\x{200B}-\x{200F}\x{2028}-\x{202F}\x{2060}-\x{206F}\x{FEFF}]"
LINK = r"(?i)(?:https?|ftp)://\S+|\bwww\.\S+"
MAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+"
HTML_TAGS = (
    "a img div p br span b i u s em strong code pre kbd sub sup hr h[1-6] table thead tbody tr td th ul ol li dl dt dd details summary "
    "picture source video audio center font small blockquote figure figcaption svg path"
).split()
TAG = rf"(?i)</?(?:{'|'.join(HTML_TAGS)})\b[^<>]{{0,500}}>"


def decode(text: Column) -> Column:
    """HTML entities decoded, then NFKC."""

    @F.pandas_udf("string")
    def decoded(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            if "&" in t:
                t = html.unescape(t)
            return t if t.isascii() else unicodedata.normalize("NFKC", t)

        return texts.map(one)

    return decoded(text)


def strip_noise(text: Column) -> Column:
    """Invisible characters vanish; links, mail addresses and known tags become
    a blank."""
    steps = [(INVISIBLE, ""), (LINK, " "), (MAIL, " "), (TAG, " ")]
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, text)


def clean_text(text: Column, *, decoded: bool = True) -> Column:
    """The whole cleaning; a null text is empty. ``decoded=False`` leaves the
    entities and compatibility forms as they are."""
    known = F.coalesce(text, F.lit(""))
    return strip_noise(decode(known) if decoded else known)


def squeeze(text: Column) -> Column:
    """White space collapsed and trimmed; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def to_int(text: Column) -> Column:
    """'54,368', '11.5k' and '1.2m' as integers; separators are dropped unless
    a suffix makes the point a decimal one."""
    raw = F.lower(F.regexp_replace(F.regexp_extract(text, r"[0-9.,]+\s*[kKmM]?", 0), r"\s", ""))
    body = F.regexp_replace(F.regexp_replace(raw, r"[km]$", ""), ",", "")
    factor = F.when(raw.endswith("k"), 1_000).when(raw.endswith("m"), 1_000_000)
    plain = F.regexp_replace(body, r"\.", "").try_cast("bigint")
    return F.when(factor.isNull(), plain).otherwise(F.floor(body.try_cast("double") * factor).cast("bigint"))


def content_hash(*parts: Column) -> Column:
    """SHA-1 of the lower-cased joined texts; null under 200 characters."""
    whole = F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])
    return F.when(F.length(whole) >= 200, F.sha1(F.lower(whole).cast("binary")))
