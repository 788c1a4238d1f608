"""Text, size, hash, version and age functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as a Java character class.
SPACE = r"[\t-\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NO_SPACE = SPACE.replace("[", "[^", 1)
FENCE = "(?s)```.*?```"
#: How markdown is stripped, (pattern, replacement) in order. (?d): only \n ends a line.
RULES = (
    (r"(?d)\*\*(.+?)\*\*", "$1"),
    (r"(?d)__(.+?)__", "$1"),
    (r"\*([^\s*\n][^*\n]*?)\*", "$1"),
    (r"_([^_\n]+?)_", "$1"),
    (r"!\[[^\]]*\]\([^)]*\)", ""),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"(?md)^#{1,6}[\t\n\f\r ]+(.+)$", "$1"),
    (r"`([^`]+)`", "$1"),
)


def utrim(text: Column) -> Column:
    """Trims Unicode white space."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def word_count(text: Column) -> Column:
    """Runs of anything but Unicode white space; a text of ASCII alone is asked for ASCII spaces, which costs a fraction."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.regexp_count(text, F.lit(r"[^\t-\r ]+"))).otherwise(F.regexp_count(text, F.lit(f"{NO_SPACE}+")))


def normalize_whitespace(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(f"({NO_SPACE}+)"), F.lit(1)), " ")


def _unmarked(text: Column) -> Column:
    for pattern, new in RULES:
        text = F.regexp_replace(text, pattern, new)
    return text


def strip_markdown(text: Column) -> Column:
    """Markdown to plain text. Fenced blocks stay; the rules run on what lies before, between and after them, part by part."""
    fences = F.regexp_extract_all(text, F.lit(FENCE), F.lit(0))
    parts = F.zip_with(F.split(text, FENCE, -1), fences, lambda p, f: F.concat(_unmarked(p), F.coalesce(f, F.lit(""))))
    return F.when(F.contains(text, F.lit("```")), F.array_join(parts, "")).otherwise(_unmarked(text))


def truncate_content(text: Column, n: int) -> Column:
    """At most ``n`` code points and a marker; 0 or less: no limit."""
    if n <= 0:
        return text
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("\n\n[truncated]"))).otherwise(text)


def post_process(text: Column, trim: bool, n: int) -> Column:
    return truncate_content(strip_markdown(text) if trim else text, n)


def first_line(text: Column) -> Column:
    """The first line that isn't blank, trimmed; else empty."""
    line = F.regexp_extract(text, rf"({NO_SPACE}[^\n]*)", 1)
    return utrim(line)


def matched_line(fragment: Column, offset: Column) -> Column:
    """The line that holds the character at ``offset`` (from 0), trimmed; without one, the first line that isn't blank."""
    before = F.substring_index(F.substring(fragment, F.lit(1), offset), "\n", -1)
    after = F.substring_index(F.substring(fragment, offset + 1, F.length(fragment)), "\n", 1)
    inside = (offset >= 0) & (offset < F.length(fragment))
    return F.when(inside, utrim(F.concat(before, after))).otherwise(first_line(fragment))


def format_bytes(n: Column) -> Column:
    """Bytes, KB or MB with one digit; exact halves go to the even digit."""
    big = lambda unit, name: F.format_string(f"%.1f {name}", F.bround(n.cast("double") / F.lit(float(unit)), 1))
    return F.when(n >= 1 << 20, big(1 << 20, "MB")).when(n >= 1 << 10, big(1 << 10, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


#: A cache key is the same digest of the url.
cache_key = content_hash


def _version(v: Column) -> Column:
    """Three numbers, or null."""
    bare = F.regexp_replace(F.regexp_replace(utrim(v), "^v", ""), "[+-].*$", "")
    parts = F.transform(F.split(bare, r"\.", -1), lambda p: F.when(p.rlike(r"^[0-9]+$"), p.try_cast("bigint")))
    return F.when((F.size(parts) == 3) & ~F.exists(parts, lambda p: p.isNull()), parts)


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1; versions that don't parse compare equal."""
    x, y = _version(a), _version(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def expired(now: Column, stored: Column, ttl_seconds: int) -> Column:
    """Strictly older than the ttl; both in seconds."""
    return (now - stored) > F.lit(ttl_seconds)


def check_is_due(now: Column, checked: Column, failed: Column) -> Column:
    """A release check: the last one is a day old and the last failure six hours; seconds."""
    return F.coalesce(now - checked >= 86_400, F.lit(True)) & F.coalesce(now - failed >= 21_600, F.lit(True))


def install_type(path: Column, binary: str = "webloom", forced: Column | None = None) -> Column:
    """How a binary was installed: as ``forced`` says if that is a known way, else by its path; what isn't the tool's own binary is unknown."""
    low = F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))
    own = lambda folder: F.endswith(low, F.lit(f"{folder}/{binary}")) | F.endswith(low, F.lit(f"{folder}/{binary}.exe"))
    found = F.when(low.contains("/cellar/") | low.contains("/homebrew/"), "homebrew").when(own("/go/bin"), "go").when(own(""), "manual").otherwise("unknown")
    if forced is None:
        return found
    said = F.lower(F.trim(forced))
    return F.when(said.isin("homebrew", "go", "manual"), said).otherwise(found)


def rate_limit_message(reset: Column, now: Column) -> Column:
    """When a rate limit ends; seconds since the epoch."""
    return F.concat(F.lit("rate limited; resets in "), (reset - now).cast("string"), F.lit("s at "), F.date_format(F.timestamp_seconds(reset), "HH:mm:ss"))


def mark_default(names: Column, default: Column) -> Column:
    """``a, b (default), c``."""
    return F.array_join(F.transform(names, lambda n: F.when(n == default, F.concat(n, F.lit(" (default)"))).otherwise(n)), ", ")
