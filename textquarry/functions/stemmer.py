"""Porter2 (English) over a column of distinct words.

The steps are SQL expressions over the columns w (the word), r1 and r2 (where
its regions begin), one projection a step, so Catalyst keeps each step once.
The same expressions run in DuckDB. It is the published algorithm; words
that are not plain ASCII letters, technical terms and names ending in "js" are
left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Fixed values of the published algorithm.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
INVARIANT_AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
UNSTEMMED = ("cpp", "csharp", "fsharp", "dotnet", "aspnet", "objectivec", "ios", "macos", "ipados", "tvos", "watchos", "visionos")
STEP_2 = [
    ("ization", "ize"), ("ational", "ate"), ("ousness", "ous"), ("iveness", "ive"), ("fulness", "ful"),
    ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
]
STEP_3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize"]
STEP_4_SHORT = ["al", "er", "ic"]

_V, _NV = "[aeiouy]", "[^aeiouy]"
_SHORT = "(?:[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$)"


def _cut(n: int | str) -> str:
    return f"left(w, greatest(length(w) - {n}, 0))"


def _ends(suffix: str) -> str:
    return f"right(w, {len(suffix)}) = '{suffix}'"


def _in(region: str, suffix: str) -> str:
    return f"length(w) - {len(suffix)} >= {region}"


def _matches(text: str, pattern: str) -> str:
    return f"regexp_extract({text}, '{pattern}', 0) <> ''"


def _replaced(pairs, region: str) -> str:
    return " ".join(f"WHEN {_ends(a)} THEN CASE WHEN {_in(region, a)} THEN {_cut(len(a))} || '{b}' ELSE w END" for a, b in pairs)


def steps() -> list[dict[str, str]]:
    """Projections in order; each maps new columns to SQL over the old ones.
    The input has the column ``token``, the result is the column ``stem``."""
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    plain = f"{_matches('token', '^[a-z]+$')} AND token NOT IN ({quoted(UNSTEMMED)}) AND right(token, 2) <> 'js'"
    fixed = " ".join(f"WHEN token = '{a}' THEN '{b}'" for a, b in IRREGULAR.items())
    marked = "CASE WHEN left(token, 1) = 'y' THEN 'Y' || substring(token, 2) ELSE token END"
    for v in "aeiouy":
        marked = f"replace({marked}, '{v}y', '{v}Y')"
    region = f"{_NV}*{_V}+{_NV}"
    after = "substring(w, r1 + 1)"
    stem_b = "left(w, length(w) - length(sb))"
    doubles = quoted(["bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"])
    return [
        {"fixed": f"CASE WHEN NOT ({plain}) OR length(token) <= 2 THEN token {fixed} END", "w": marked},
        {"r1": f"CASE WHEN {_matches('w', '^(?:gener|arsen)')} THEN 5 WHEN {_matches('w', '^commun')} THEN 6 WHEN {_matches('w', '^' + region)} THEN length(regexp_extract(w, '^{region}', 0)) ELSE length(w) END"},
        {"r2": f"CASE WHEN {_matches(after, '^' + region)} THEN r1 + length(regexp_extract({after}, '^{region}', 0)) ELSE length(w) END"},
        {
            "w": f"CASE WHEN {_ends('sses')} THEN {_cut(2)} WHEN right(w, 3) IN ('ied', 'ies') THEN CASE WHEN length(w) > 4 THEN {_cut(2)} ELSE {_cut(1)} END "
            f"WHEN right(w, 2) IN ('us', 'ss') THEN w WHEN {_ends('s')} AND {_matches(_cut(2), _V)} THEN {_cut(1)} ELSE w END"
        },
        {"fixed": f"CASE WHEN fixed IS NOT NULL THEN fixed WHEN w IN ({quoted(INVARIANT_AFTER_1A)}) THEN w END", "sb": " ".join(["CASE", *[f"WHEN {_ends(s)} THEN '{s}'" for s in ("eedly", "ingly", "edly", "eed", "ing", "ed")], "ELSE '' END"])},
        {"sw": stem_b},
        {
            "w": f"CASE WHEN sb = '' THEN w WHEN sb IN ('eedly', 'eed') THEN CASE WHEN length(sw) >= r1 THEN sw || 'ee' ELSE w END WHEN NOT ({_matches('sw', _V)}) THEN w "
            f"WHEN right(sw, 2) IN ('at', 'bl', 'iz') THEN sw || 'e' WHEN right(sw, 2) IN ({doubles}) THEN left(sw, length(sw) - 1) "
            f"WHEN r1 >= length(sw) AND {_matches('sw', _SHORT)} THEN sw || 'e' ELSE sw END"
        },
        {"w": f"CASE WHEN length(w) > 2 AND right(w, 1) IN ('y', 'Y') AND {_matches('left(right(w, 2), 1)', _NV)} THEN {_cut(1)} || 'i' ELSE w END"},
        {
            "w": f"CASE {_replaced(STEP_2, 'r1')} WHEN {_ends('ogi')} THEN CASE WHEN {_in('r1', 'ogi')} AND {_ends('logi')} THEN {_cut(1)} ELSE w END "
            f"WHEN {_ends('li')} THEN CASE WHEN {_in('r1', 'li')} AND left(right(w, 3), 1) IN ({quoted('cdeghkmnrt')}) THEN {_cut(2)} ELSE w END ELSE w END"
        },
        {"w": f"CASE {_replaced(STEP_3, 'r1')} WHEN {_ends('ative')} THEN CASE WHEN {_in('r2', 'ative')} THEN {_cut(5)} ELSE w END ELSE w END"},
        {
            "w": "CASE " + _replaced([(s, "") for s in STEP_4], "r2") + f" WHEN {_ends('ion')} THEN CASE WHEN {_in('r2', 'ion')} AND left(right(w, 4), 1) IN ('s', 't') THEN {_cut(3)} ELSE w END "
            + _replaced([(s, "") for s in STEP_4_SHORT], "r2") + " ELSE w END"
        },
        {
            "w": f"CASE WHEN {_ends('e')} AND ({_in('r2', 'e')} OR ({_in('r1', 'e')} AND NOT ({_matches(_cut(1), _SHORT)}))) THEN {_cut(1)} "
            f"WHEN {_ends('ll')} AND {_in('r2', 'l')} THEN {_cut(1)} ELSE w END"
        },
        {"stem": "coalesce(fixed, replace(w, 'Y', 'y'))"},
    ]


def stem_vocabulary(words: DataFrame, token: str = "token") -> DataFrame:
    """(token) to (token, stem), one row a distinct token.

    The last aggregate keeps the partitioning of the distinct below and costs no
    shuffle. It is there because the optimizer would otherwise push conditions
    on the stem down through all steps, substituting each into the next."""
    out = words.select(F.col(token).alias("token")).distinct()
    for step in steps():
        out = out.withColumns({k: F.expr(v) for k, v in step.items()})
    return out.groupBy("token").agg(F.max("stem").alias("stem"))


def duckdb_ctes(source: str, name: str = "stems") -> str:
    """The same steps as DuckDB common table expressions; ``source`` has the
    column token, the last one is called ``name`` with token and stem."""
    parts, last, columns = [], source, ["token"]
    for i, step in enumerate(steps()):
        kept = [c for c in columns if c not in step]
        made = ", ".join(f"{v} AS {k}" for k, v in step.items())
        parts.append(f"{name}_{i} AS (SELECT {', '.join(kept)}, {made} FROM {last})")
        last, columns = f"{name}_{i}", kept + list(step)
    return ",\n".join([*parts, f"{name} AS (SELECT token, stem FROM {last})"])
