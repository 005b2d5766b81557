"""URLs: canonical form, site, kind of page, pagination.

The canonical form is exact through ``urllib`` in an Arrow UDF
(``canonical``) or, for absolute http(s) URLs without user, escapes or port
tricks, native (``canonical_native``). Hosts and their rules are parameters, so
the same functions serve other hosts than the default two.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, functions as F

# Parameters that only track clicks, and owner names that are
# pages of the code host itself.
TRACKING = ("ref", "ref_cta", "ref_loc", "ref_page", "ref_type", "source", "referrer", "fbclid", "gclid", "mc_cid", "mc_eid", "_ga")
TRACKING_PREFIX = "utm_"
RESERVED_OWNERS = (
    "about account accelerator advisories apps auth blog business codespaces collections contact contact-sales copilot customer-stories "
    "dashboard discussions education enterprise enterprises events explore features gist git-guides github-copilot home issues join login "
    "logout maintenance marketplace mcp models new newsroom nonprofit notifications open-source organizations orgs packages partners "
    "password_reset premium-support pricing pulls readme redeem resources search security sessions settings shop signup site solutions "
    "spark sponsors stars status support team teams topics trending trust-center users watching why-github"
).split()
MAX_TOPIC_PAGE = 50


@dataclass(frozen=True)
class Sites:
    """Hosts of the two sites a crawl covers."""

    hosts: dict = field(default_factory=lambda: {"github.com": "github", "sourceforge.net": "sourceforge", "gh.example": "github", "sf.example": "sourceforge"})


SITES = Sites()


def canonical_url(url: str | None, base: str | None = None, sites: Sites = SITES) -> str | None:
    """The canonical form of one URL, None where it is not http(s)."""
    if not url or not url.strip():
        return None
    try:
        parts = urlsplit(urljoin(base, url.strip()) if base else url.strip())
        host = (parts.hostname or "").lower().removeprefix("www.")
    except ValueError:
        return None
    if parts.scheme not in ("http", "https") or not host:
        return None
    wanted = {k: v for k, v in parse_qsl(parts.query, keep_blank_values=True) if k not in TRACKING and not k.startswith(TRACKING_PREFIX)}
    if wanted.get("page") == "1":
        wanted.pop("page")
    path = "/" + "/".join(p for i, p in enumerate(parts.path.split("/")) if p) + ("/" if parts.path.endswith("/") else "")
    path = "/" if path == "//" else path
    site = sites.hosts.get(host)
    if site == "github":
        path = path.lower().rstrip("/") or "/"
    elif site == "sourceforge" and not path.endswith("/") and "." not in path.rsplit("/", 1)[-1]:
        path += "/"
    return urlunsplit(("https", host, path, urlencode(sorted(wanted.items())), ""))


def canonical(url: Column, base: Column | None = None, sites: Sites = SITES) -> Column:
    """Exact canonical form, vectorized over Arrow batches."""

    def alone(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: canonical_url(u, None, sites))

    def resolved(urls: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([canonical_url(u, b, sites) for u, b in zip(urls, bases)], dtype=object)

    return F.pandas_udf(alone, "string")(url) if base is None else F.pandas_udf(resolved, "string")(url, base)


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://([^/?#]*)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def site_of(url: Column, sites: Sites = SITES) -> Column:
    """Site of a canonical URL, null for other hosts."""
    host = host_of(url)
    out = F.lit(None).cast("string")
    for name, site in sites.hosts.items():
        out = F.when(host == name, site).otherwise(out)
    return out


def canonical_native(url: Column, sites: Sites = SITES) -> Column:
    """The canonical form in the JVM, for absolute URLs whose query has no
    escapes. Repeated parameters: the last one counts."""
    trimmed = F.trim(url)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(trimmed, r"^(?i:https?)://([^/?#]*)", 1)), r":\d+$", ""), r"^www\.", "")
    raw_path = F.regexp_replace(F.regexp_extract(trimmed, r"^(?i:https?)://[^/?#]*([^?#]*)", 1), r"/{2,}", "/")
    path = F.when(raw_path == "", "/").otherwise(raw_path)
    items = F.filter(F.split(F.regexp_extract(trimmed, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")
    pairs = F.transform(items, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("").alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["k"] == p["k"]))
    kept = F.filter(last, lambda p: ~p["k"].isin(*TRACKING) & ~p["k"].startswith(TRACKING_PREFIX) & ~((p["k"] == "page") & (p["v"] == "1")))
    query = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat_ws("=", p["k"], p["v"])), "&")
    code = [h for h, s in sites.hosts.items() if s == "github"]
    forge = [h for h, s in sites.hosts.items() if s == "sourceforge"]
    shaped = (
        F.when(host.isin(*code), F.when(F.lower(path) == "/", "/").otherwise(F.regexp_replace(F.lower(path), "/+$", "")))
        .when(host.isin(*forge) & ~path.endswith("/") & ~F.contains(F.substring_index(path, "/", -1), F.lit(".")), F.concat(path, F.lit("/")))
        .otherwise(path)
    )
    return F.when(trimmed.rlike(r"^(?i:https?)://") & (host != ""), F.concat(F.lit("https://"), host, shaped, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def classify(url: Column, sites: Sites = SITES) -> Column:
    """project, listing, sitemap or null, for a canonical URL."""
    site, path, query = site_of(url, sites), path_of(url), query_of(url)
    page = F.regexp_extract(query, r"^page=(\d+)$", 1).try_cast("bigint")
    paged = (query == "") | (page >= 2)
    owner, repo = F.regexp_extract(path, r"^/([^/]+)/", 1), F.regexp_extract(path, r"^/[^/]+/([^/]+)$", 1)
    code = (
        F.when(path.rlike(r"^/topics(?:/[a-z0-9][a-z0-9-]*)?$"), F.when(paged & ((query == "") | (page <= MAX_TOPIC_PAGE)), "listing"))
        .when(path.rlike(r"^/[a-z0-9][a-z0-9-]*/[a-z0-9._-]+$") & (query == "") & ~owner.isin(*RESERVED_OWNERS) & ~repo.endswith(".git") & ~repo.isin(".", ".."), "project")
    )
    forge = (
        F.when(path.rlike(r"^/projects/[a-z0-9][a-z0-9._-]*/$"), F.when(query == "", "project"))
        .when(path.rlike(r"^/directory/(?:[a-z0-9][a-z0-9._:+-]*/)*$"), F.when(paged, "listing"))
        .when(path.rlike(r"^/(?:sitemap|directory_sitemap)(?:-\d+)?\.xml$"), F.when(query == "", "sitemap"))
    )
    return F.when(site == "github", code).when(site == "sourceforge", forge)


def is_pagination(source: Column, target: Column) -> Column:
    """The two URLs differ in the page parameter only."""

    def rest(url: Column) -> Column:
        return F.array_sort(F.filter(F.split(query_of(url), "&"), lambda p: (p != "") & ~p.startswith("page=")))

    return (host_of(source) == host_of(target)) & (path_of(source) == path_of(target)) & (rest(source) == rest(target))
