"""Items `category:level:...` from attributes, and matching of item patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _path(*parts: Column | str) -> Column:
    return F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def location_items(continent: Column, country: Column, region: Column, isp: Column) -> Column:
    """Continent, country and region under each other, and the provider within its country."""
    return F.array(_path("location", continent), _path("location", continent, country), _path("location", continent, country, region), _path("isp", country, isp))


def ua_items(platform: Column, browser: Column, major: Column, minor: Column, is_mobile: Column) -> Column:
    major, minor = major.cast("string"), minor.cast("string")
    steps = [_path("ua", platform), _path("ua", platform, browser), _path("ua", platform, browser, major), _path("ua", platform, browser, major, minor)]
    return F.array_compact(F.array(*steps, F.when(is_mobile, F.lit("ua:isMobile"))))


def status_items(status: Column) -> Column:
    """One item, or none for the usual status 200."""
    return F.array_compact(F.array(F.when(status != 200, _path("status", status.cast("string")))))


def url_item(url: Column) -> Column:
    return _path("url", url)


def speed(value: Column, bounds: list[tuple[str, float]], rest: str) -> Column:
    """Name of the first inclusive upper bound that a value does not exceed."""
    out = F
    for name, most in bounds:
        out = out.when(value <= F.lit(most), F.lit(name))
    return out.otherwise(F.lit(rest))


def is_pattern(text: str) -> bool:
    """Only an asterisk makes a pattern; without it the text is an exact name."""
    return "*" in text


def glob_regex(pattern: str) -> str:
    """Regular expression of a whole-string wildcard with *, ? and [sets]."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inside = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return out


def matches(item: Column, pattern: str) -> Column:
    return item.rlike(f"^(?s:{glob_regex(pattern)})$") if is_pattern(pattern) else item == F.lit(pattern)
