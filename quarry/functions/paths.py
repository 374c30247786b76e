"""Paths, routes, links and package names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    """With its dot; empty where there is none."""
    return F.regexp_extract(basename(path), r".(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(.)\.[^.]*$", "$1")


def package_name(specifier: Column) -> Column:
    """The first segment of an import, or the first two of a scoped one."""
    parts = F.split(specifier, "/")
    return F.when(specifier.startswith("@"), F.concat_ws("/", F.slice(parts, 1, 2))).otherwise(F.get(parts, F.lit(0)))


def is_internal(specifier: Column) -> Column:
    """Relative, absolute and aliased imports."""
    return specifier.rlike(r"^(\.|/|@/|~/|#|src/|app/|components/|lib/|utils/|pages/)")


def url_path(url: Column) -> Column:
    """The path of an address, / where it has none; without query and fragment."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def route_of_file(path: Column) -> Column:
    """The route that a page file under app/ or pages/ serves: groups and slots go, [x] becomes :x, [...x] becomes *."""
    inside = F.regexp_extract(path, r"(?:^|/)(?:app|pages)/(.*)$", 1)
    inside = F.regexp_replace(inside, r"(^|/)(page|index|route)\.[jt]sx?$", "")
    inside = F.regexp_replace(inside, r"\.[jt]sx?$", "")
    parts = F.filter(segments(inside), lambda s: ~s.rlike(r"^\(.*\)$") & ~s.startswith("@"))
    named = F.transform(parts, lambda s: F.when(s.rlike(r"^\[\[?\.\.\.[^\]]*\]\]?$"), F.lit("*")).otherwise(F.regexp_replace(s, r"^\[([^\]]*)\]$", ":$1")))
    return F.concat(F.lit("/"), F.array_join(named, "/"))


def normal_link(href: Column) -> Column:
    """An internal link without query, fragment, extension, /index and a slash at its end."""
    x = F.regexp_replace(href, r"[?#].*$", "")
    x = F.regexp_replace(x, r"\.(html?|jsx?|tsx?)$", "")
    x = F.regexp_replace(x, r"/index$", "")
    x = F.regexp_replace(x, r"(.)/+$", "$1")
    return F.when(x == "", "/").otherwise(x)
