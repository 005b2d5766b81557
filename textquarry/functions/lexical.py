"""Lexical analysis: from a text column to an array of index terms.

Everything is a Column expression. Stemming works on the distinct vocabulary
(``functions.stemmer``) and is joined by the index and the ranking.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column, functions as F

from textquarry.functions.cleaning import clean_text
from textquarry.functions.stopwords import STOPWORDS

# Technical terms and what they become, in order.
SPECIAL_TERMS = [
    (r"(?i)(?<![\p{L}\p{N}_+])c\+\+(?![a-z_+])", " cpp "),
    (r"(?i)(?<![\p{L}\p{N}_#])c#(?![\p{L}\p{N}_#])", " csharp "),
    (r"(?i)(?<![\p{L}\p{N}_#])f#(?![\p{L}\p{N}_#])", " fsharp "),
    (r"(?i)\basp\.net\b", " aspnet "),
    (r"(?i)(?<![\p{L}\p{N}_.])\.net\b", " dotnet "),
    (r"(?i)\bobjective-c\b", " objectivec "),
    (r"(?i)\b([a-z0-9]+)\.js\b", " $1js "),
]
TOKEN = r"[\p{L}\p{N}]+(?:['._-][\p{L}\p{N}]+)*"
SEPARATOR = r"['._-]"
CAMEL = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\p{Nd}+|\p{L}+"
IDEOGRAPHS = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}]"
SHORT_KEPT = ("c", "r")

FIELDS = ("nome", "descricao", "rotulos", "readme")


def special_terms(text: Column) -> Column:
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), SPECIAL_TERMS, text)


def scan_tokens(text: Column) -> Column:
    """Tokens as they stand, compounds unsplit."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def split_compounds(tokens: Column) -> Column:
    return F.flatten(F.transform(tokens, lambda t: F.split(t, SEPARATOR)))


def camel_pieces(token: Column) -> Column:
    """Pieces of a camelCase token, preceded by the joined form where there is
    more than one."""
    pieces = F.flatten(F.transform(F.split(token, SEPARATOR), lambda p: F.regexp_extract_all(p, F.lit(CAMEL), F.lit(0))))
    return F.when(F.size(pieces) > 1, F.concat(F.array(F.array_join(pieces, "")), pieces)).otherwise(pieces)


def ideograph_bigrams(tokens: Column) -> Column:
    """Runs of ideographs become their bigrams, a single one stays, other
    characters of the token are kept as they are."""
    runs = rf"{IDEOGRAPHS}+|[^\x{{3040}}-\x{{30FF}}\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{AC00}}-\x{{D7AF}}\x{{F900}}-\x{{FAFF}}]+"

    def pieces(run: Column) -> Column:
        bigrams = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(IDEOGRAPHS) & (F.length(run) > 1), bigrams).otherwise(F.array(run))

    def each(token: Column) -> Column:
        return F.when(token.rlike(IDEOGRAPHS), F.flatten(F.transform(F.regexp_extract_all(token, F.lit(runs), F.lit(0)), pieces))).otherwise(F.array(token))

    return F.flatten(F.transform(tokens, each))


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Letters of the Latin, Greek, Cyrillic and kana blocks whose base, without
    its accents, is another single letter."""
    blocks = [(0x00C0, 0x024F), (0x0370, 0x03FF), (0x0400, 0x04FF), (0x1E00, 0x1EFF), (0x1F00, 0x1FFF), (0x3040, 0x30FF)]
    source, target = [], []
    for low, high in blocks:
        for code in range(low, high + 1):
            letter = chr(code)
            base = "".join(c for c in unicodedata.normalize("NFKD", letter.casefold()) if not unicodedata.combining(c))
            if len(base) == 1 and base != letter:
                source.append(letter)
                target.append(base)
    return "".join(source), "".join(target)


@lru_cache(maxsize=1)
def _marks() -> str:
    """A pattern of all combining marks of the Unicode data, as ranges."""
    ranges: list[list[int]] = []
    for code in (c for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c))):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(rf"\x{{{x:X}}}-\x{{{y:X}}}" for x, y in ranges) + "]"


def fold(token: Column) -> Column:
    """Case folded and without accents or other combining marks."""
    source, target = _fold_table()
    plain = F.lower(token)
    folded = F.regexp_replace(F.replace(F.translate(plain, source, target), F.lit("ß"), F.lit("ss")), _marks(), "")
    return F.when(F.octet_length(token) == F.length(token), plain).otherwise(folded)  # ASCII has none


@dataclass(frozen=True)
class Analyzer:
    """The analysis chain and its options; aliases in brackets are the names
    of the command line."""

    remove_stopwords: bool = True  # remover_stopwords
    stemming: bool = True
    min_length: int = 2  # tamanho_min_token
    max_length: int = 25  # tamanho_max_token
    max_digits: int = 4  # max_digitos
    decoded: bool = True  # entities and NFKC

    def tokens(self, text: Column, field: str | None = None) -> Column:
        """Cleaned text to tokens in their original case."""
        scanned = scan_tokens(special_terms(clean_text(text, decoded=self.decoded)))
        parts = F.flatten(F.transform(scanned, camel_pieces)) if field == "nome" else split_compounds(scanned)
        return ideograph_bigrams(parts)

    def keep(self, token: Column) -> Column:
        """The filter on folded tokens."""
        size = F.length(token)
        short = (size < self.min_length) & token.rlike(r"^[\x00-\x7F]*$") & ~token.isin(*SHORT_KEPT)
        return (size > 0) & (size <= self.max_length) & ~short & ~(token.rlike(r"^\p{Nd}+$") & (size > self.max_digits))

    def normalized(self, text: Column, field: str | None = None) -> Column:
        return F.filter(F.transform(self.tokens(text, field), fold), self.keep)

    def terms(self, text: Column, field: str | None = None) -> Column:
        """Index terms before stemming, in text order."""
        tokens = self.normalized(text, field)
        return F.filter(tokens, lambda t: ~t.isin(*STOPWORDS)) if self.remove_stopwords else tokens
