"""A filter specification as a query string and back."""

from __future__ import annotations

from urllib.parse import parse_qsl, quote

from ..operators.explore import FilterSpec


def parse(address: str) -> FilterSpec:
    """The specification after the question mark of an address; lists come repeated, or parted by | or commas (years, series)."""
    values: dict[str, list[str]] = {}
    for key, value in parse_qsl(address.partition("?")[2], keep_blank_values=False):
        parts = value.split("|") if key in ("unit", "subtopic") else value.split(",") if key in ("year", "series") else [value]
        values.setdefault(key, []).extend(p.strip() for p in parts if p.strip())

    def one(key: str, allowed: tuple[str, ...] = ()) -> str:
        found = (values.get(key) or [""])[0]
        return found if not allowed or found in allowed else ""

    return FilterSpec(
        units=values.get("unit", []),
        subtopics=values.get("subtopic", []),
        years=[int(y) for y in values.get("year", []) if y.isdigit()],
        series=values.get("series", []),
        search=one("search"),
        kind=one("type", ("mcq", "theory")),
        primary_only=one("primary") in ("1", "true"),
        status=one("status", ("unattempted", "review", "mastered")),
        bookmarked=one("bookmarked") in ("1", "true"),
    )


def render(spec: FilterSpec) -> str:
    """The query string of a specification; what is not asked for leaves no trace."""
    pairs = [("unit", "|".join(spec.units)), ("subtopic", "|".join(spec.subtopics)), ("type", spec.kind), ("year", ",".join(map(str, spec.years))), ("series", ",".join(spec.series))]
    pairs += [("search", spec.search), ("status", spec.status), ("bookmarked", "1" if spec.bookmarked else ""), ("primary", "1" if spec.primary_only else "")]
    return "&".join(f"{k}={quote(v, safe='|,')}" for k, v in pairs if v)
