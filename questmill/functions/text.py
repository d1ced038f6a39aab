"""Text rules: cleaning, scoring, answer keys, search, addresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Command verbs that mark a question's own text.
VERBS = "calculate explain describe state determine identify give write suggest deduce show draw plot outline complete predict name compare justify comment".split()


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_text(c: Column, longest: int = 550) -> Column:
    """Boilerplate, bar codes and dot leaders removed, white space collapsed, cut to ``longest`` characters with dots after."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)do not write in this area", " ")
    c = F.regexp_replace(c, r"\*P\d+[A-Z0-9]+\*", " ")
    c = collapse(F.regexp_replace(c, r"[._]{4,}", " "))
    return F.when(F.length(c) > longest, F.concat(F.rtrim(F.substring(c, 1, longest)), F.lit("..."))).otherwise(c)


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))


def content_score(c: Column, marks: Column, number: Column | None = None) -> Column:
    """How much a candidate reads like a question: two points a word of letters, 25 a command verb, 20 for a bracketed number, five
    a mark, 30 for its own sub-part marker; 100 off without words, 50 off below three."""
    words = F.regexp_extract_all(F.regexp_replace(c, r"[._\-\s]+", " "), F.lit("[A-Za-z]{2,}"), F.lit(0))
    n = F.size(words)
    verbs = F.size(F.filter(words, lambda w: F.lower(w).isin(VERBS)))
    score = 2 * n + 25 * verbs + F.when(c.rlike(r"\(\d+\)"), 20).otherwise(0) + 5 * F.greatest(marks, F.lit(0)) - F.when(n == 0, 100).when(n < 3, 50).otherwise(0)
    if number is not None:
        marker = F.try_element_at(F.regexp_extract_all(F.lower(number), F.lit(r"\(([a-z0-9]+)\)"), F.lit(1)), F.lit(-1))
        score = score + F.when(F.contains(F.lower(c), F.concat(F.lit("("), marker, F.lit(")"))), 30).otherwise(0)
    return score.cast("double")


def answer_key(c: Column) -> Column:
    """The key named by the first line that names one: "D is the correct answer", "Answer: D", or a line that is one letter A-D."""
    lines = F.transform(F.split(c, r"\r\n|\n|\r"), lambda x: F.trim(x))

    def one(x: Column) -> Column:
        named = F.nullif(F.regexp_extract(x, r"(?i)\b([A-D])\s+is\s+(?:the\s+)?(?:only\s+)?correct\s+answer\b", 1), F.lit(""))
        after = F.nullif(F.regexp_extract(x, r"(?i)(?:the\s+(?:only\s+)?correct\s+answer\s+is|answer\s*[:\s])\s*([A-D])\b", 1), F.lit(""))
        alone = F.nullif(F.regexp_extract(x, r"^([A-D])$", 1), F.lit(""))
        return F.upper(F.coalesce(named, after, alone))

    return F.get(F.filter(F.transform(lines, one), lambda k: k.isNotNull()), F.lit(0))


def matches_all(haystack: Column, needle: str) -> Column:
    """Every term of at least two letters is somewhere in the text, whatever its case; no terms: true."""
    terms = [t for t in needle.lower().split() if len(t) >= 2]
    out = F.lit(True)
    for t in terms:
        out = out & F.lower(haystack).contains(t)
    return out


def matches_any(needle: str, *fields: Column) -> Column:
    """One of the fields holds the needle, whatever its case; an empty needle: true."""
    if not needle:
        return F.lit(True)
    out = F.lit(False)
    for f in fields:
        out = out | F.coalesce(F.lower(f).contains(needle.lower()), F.lit(False))
    return out


def shift_glyphs(c: Column, by: int = 29) -> Column:
    """Repair of text whose code points are all ``by`` too low, recognised by control characters."""
    moved = F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x == "", "").otherwise(F.chr(F.ascii(x) + by))), "")
    return F.when(c.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), moved).otherwise(c)


def strip_latex(c: Column) -> Column:
    return collapse(F.regexp_replace(F.regexp_replace(c, r"\\[a-zA-Z]+", " "), r"[{}$^_\\]", ""))


def encode_path(c: Column) -> Column:
    """Percent-encode each segment of a path; a query is cut off."""
    path = F.split(c, r"\?")[0]
    return F.array_join(F.transform(F.split(path, "/"), lambda x: F.regexp_replace(F.url_encode(x), r"\+", "%20")), "/")


def mime_type(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.endswith(".png"), "image/png").when(low.endswith(".jpg") | low.endswith(".jpeg"), "image/jpeg").when(low.endswith(".webp"), "image/webp").when(low.endswith(".json"), "application/json").when(low.endswith(".pdf"), "application/pdf").otherwise("application/octet-stream")


def join_context(*parts: Column) -> Column:
    """Optional parts with bars between; nulls and empties leave no bar."""
    return F.concat_ws(" | ", *(F.nullif(p, F.lit("")) for p in parts))


def encode_segment(c: Column) -> Column:
    """One segment of a path percent-encoded as browsers do, after it was decoded where it can be."""
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(c, r"\+", "%2B")), c)
    out = F.regexp_replace(F.url_encode(decoded), r"\+", "%20")
    for code, sign in (("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is computed once a row, however often it stands there: a column named twice is computed twice,
    and nested steps double each other's work."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def versioned(path: Column, key: Column, versions: Column) -> Column:
    """A path with ``v=`` of its version, which the map ``versions`` knows by the key, else by path, file name or file name without its
    ending; a path that has a version, or none in the map, stays. Null is empty."""
    known = F.map_filter(versions, lambda _, v: v != "")
    of = lambda k: F.try_element_at(known, F.coalesce(k, F.lit("")))

    def of_bare(bare: Column) -> Column:
        return F.coalesce(of(key), of(bare), once(F.regexp_replace(bare, "^.*/", ""), lambda name: F.coalesce(of(name), of(F.regexp_replace(name, r"\.[^/.]+$", "")))))

    def with_version(path: Column) -> Column:
        sep = F.when(path.contains("?"), "&").otherwise("?")
        asked = path.contains("?v=") | path.contains("&v=") | (path == "")
        return F.when(asked, path).otherwise(once(once(F.split(path, r"\?")[0], of_bare), lambda version: F.coalesce(F.concat(path, sep, F.lit("v="), version), path)))

    return once(F.coalesce(path, F.lit("")), with_version)


def image_url(paths: list[Column], key: Column, versions: Column, base: str, prefixes: list[str]) -> Column:
    """The address of an image: the first of its paths that is not empty, with its version; full addresses stay, others begin with a slash,
    are encoded by segment, and stand behind ``base`` where one of ``prefixes`` begins them. No path: empty."""

    def behind_base(encoded: Column) -> Column:
        hosted = F.lit(False)
        for prefix in prefixes:
            hosted = hosted | encoded.startswith(prefix)
        return F.when(hosted & F.lit(base != ""), F.concat(F.lit(base), encoded)).otherwise(encoded)

    def local(parts: Column) -> Column:
        query = F.get(parts, F.lit(1))
        encoded = once(F.array_join(F.transform(F.split(parts[0], "/"), encode_segment), "/"), behind_base)
        return F.concat(encoded, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))

    def address(full: Column) -> Column:
        rooted = F.when(full.startswith("/"), full).otherwise(F.concat(F.lit("/"), full))
        return F.when(full.rlike("^https?://"), full).otherwise(once(F.split(rooted, r"\?"), local))

    path = F.coalesce(*(F.nullif(F.trim(p), F.lit("")) for p in paths), F.lit(""))
    return once(path, lambda path: F.when(path == "", "").otherwise(once(versioned(path, key, versions), address)))
