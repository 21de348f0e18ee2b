"""URL and folder predicates, priorities and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.fixed_values import CATEGORY_PATTERNS, DOWNLOADS, URL_EXCLUDED, URL_IMPORTANT, URL_WEIGHTS, URL_YEAR_BONUS, URL_YEARS


def _any(patterns: list[str]) -> str:
    return "(?i)" + "|".join(patterns)


def is_important(url: Column, important: list[str] = URL_IMPORTANT, excluded: list[str] = URL_EXCLUDED, years: list[str] = URL_YEARS) -> Column:
    """Not excluded, important, and of an accepted year if it names one."""
    year_ok = ~url.rlike(r"\d{4}") | url.rlike("|".join(years))
    return F.when(url.rlike(_any(excluded)), False).when(url.rlike(_any(important)), year_ok).otherwise(False)


def priority(url: Column, weights: list[tuple[str, int]] = URL_WEIGHTS, bonus: list[tuple[str, int]] = URL_YEAR_BONUS, long: int = 150) -> Column:
    """Weight of the first fitting pattern and bonus of the first year found, less 20 if long; 0 to 100."""
    base, extra = F.lit(0), F.lit(0)
    for pattern, w in reversed(weights):
        base = F.when(url.rlike("(?i)" + pattern), w).otherwise(base)
    for year, b in reversed(bonus):
        extra = F.when(F.contains(url, F.lit(year)), b).otherwise(extra)
    return F.greatest(F.lit(0), F.least(F.lit(100), base + extra - F.when(F.length(url) > long, 20).otherwise(0)))


def crawl_score(url: Column, weights: list[tuple[str, int]] = URL_WEIGHTS, bonus: list[tuple[str, int]] = URL_YEAR_BONUS, **rules) -> Column:
    """The priority as a share of one; none for what isn't important by ``rules``."""
    return F.when(is_important(url, **rules), priority(url, weights, bonus) / 100).otherwise(0.0)


def is_node(url: Column) -> Column:
    return url.rlike(r"/node/\d+")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def folder_name(url: Column) -> Column:
    """The path with ``-`` for ``/``; ``root`` if it is empty."""
    inner = F.regexp_replace(path(url), "^/+|/+$", "")
    return F.when(inner == "", "root").otherwise(F.replace(inner, F.lit("/"), F.lit("-")))


def same_domain(a: Column, b: Column) -> Column:
    return netloc(a) == netloc(b)


def absolute(href: Column, domain: Column) -> Column:
    return (
        F.when(F.startswith(href, F.lit("http")), href)
        .when(F.startswith(href, F.lit("/")), F.concat(F.lit("https://"), domain, href))
        .otherwise(F.concat(F.lit("https://"), domain, F.lit("/"), href))
    )


def is_download(href: Column) -> Column:
    return href.rlike(DOWNLOADS)


def category(name: Column) -> Column:
    """Category of a folder name, the first of the table that fits."""
    low, out = F.lower(name), F.lit("other")
    for label, patterns in reversed(CATEGORY_PATTERNS):
        out = F.when(low.rlike("|".join(patterns)), label).otherwise(out)
    return out
