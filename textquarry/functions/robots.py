"""robots.txt rules as a table, matched by the longest pattern."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

RULE_SCHEMA = "host string, allow boolean, pattern string, regex string, weight int"


def pattern_regex(pattern: str) -> str:
    """A path pattern with ``*`` and a final ``$`` as a regex."""
    ends = pattern.endswith("$")
    body = "".join(".*" if c == "*" else re.escape(c) for c in (pattern[:-1] if ends else pattern))
    return f"^{body}{'$' if ends else ''}"


def parse_robots(text: str, agent: str = "*") -> dict:
    """Rules, crawl delay and sitemaps that a robots.txt gives an agent: the
    group naming the agent, else the group of all."""
    groups: dict[str, dict] = {}
    sitemaps, current, open_group = [], [], False
    for line in text.splitlines():
        name, _, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            current = current if open_group else []
            open_group = True
            current.append(groups.setdefault(value.lower(), {"rules": [], "delay": None}))
        elif name == "sitemap":
            sitemaps.append(value)
        elif name in ("allow", "disallow", "crawl-delay"):
            open_group = False
            for group in current:
                if name == "crawl-delay":
                    try:
                        group["delay"] = float(value)
                    except ValueError:
                        pass
                elif value:
                    group["rules"].append((name == "allow", value))
    own = next((g for a, g in groups.items() if a != "*" and a in agent.lower()), groups.get("*", {"rules": [], "delay": None}))
    return {"rules": own["rules"], "delay": own["delay"], "sitemaps": sitemaps}


def rule_rows(host: str, status: int | None, text: str, agent: str = "*") -> list[tuple]:
    """Rows of RULE_SCHEMA for one host. 4xx: everything is allowed; 5xx or no
    answer: nothing is."""
    if status is None or status >= 500:
        return [(host, False, "/", "^/", 1)]
    rules = parse_robots(text, agent)["rules"] if status == 200 else []
    return [(host, True, "", "^", 0)] + [(host, allow, p, pattern_regex(p), len(p)) for allow, p in rules]


def allowed(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with the column allowed: the longest matching rule decides, allow
    wins at equal length. Rules are joined by host, not crossed; a host has few
    of them, so they are collected into one row a host first."""
    by_host = rules.groupBy("host").agg(F.collect_list(F.struct("weight", "allow", "regex")).alias("rules"))
    host = F.regexp_extract(url, r"^https?://([^/?#]*)", 1)
    path = F.regexp_replace(F.col(url), r"^https?://[^/?#]*", "")
    best: Column = F.array_max(F.transform(F.filter("rules", lambda r: F.rlike(F.when(path == "", "/").otherwise(path), r["regex"])), lambda r: F.struct(r["weight"], r["allow"])))
    return urls.withColumn("host", host).join(by_host, "host", "left").withColumn("allowed", F.coalesce(best["allow"], F.lit(False))).drop("rules", "host")
