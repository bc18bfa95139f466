"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import SITE


def normalize_subreddit(c: Column) -> Column:
    """Trimmed of all white space, without one leading r/ then /r/, without slashes at the ends, lower-cased; the prefix is case-sensitive."""
    c = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "^r/", ""), "^/r/", ""), "^/+|/+$", ""))


def canonical_subreddit(c: Column) -> Column:
    """Trimmed, without a leading r/ or /r/ in either case, without slashes at its ends, lower-cased."""
    c = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "^/?r/", ""), "^/+|/+$", ""), r"^\s+|\s+$", "")


def py_normalize_subreddit(s: str) -> str:
    s = s.strip()
    for p in ("r/", "/r/"):
        s = s[len(p) :] if s.startswith(p) else s
    return s.strip("/").lower()


def absolute_permalink(c: Column) -> Column:
    """As stored: a link that doesn't begin with http gets the site in front; null stays empty."""
    c = F.coalesce(c, F.lit(""))
    return F.when((c == "") | c.startswith("http"), c).otherwise(F.concat(F.lit(SITE), c))


def evidence_url(c: Column) -> Column:
    """As shown: also a missing slash is added."""
    c = F.coalesce(c, F.lit(""))
    return F.when((c == "") | c.startswith("http"), c).when(c.startswith("/"), F.concat(F.lit(SITE), c)).otherwise(F.concat(F.lit(SITE + "/"), c))


def search_tokens(c: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits of two or more, without the operators of the search language, distinct in order."""
    parts = F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= 2) & ~t.isin("and", "or", "not", "near")))


def or_query(tokens: Column) -> Column:
    return F.array_join(tokens, " OR ")


def normalize_quote(c: Column) -> Column:
    """Typographic quotes, dashes and blanks to plain ones, emphasis marks out, white space collapsed, lower-cased, trimmed."""
    c = F.translate(c, "‘’“”–— ", "''\"\"-- ")
    c = F.regexp_replace(F.regexp_replace(c, "[*_`]", ""), r"\s+", " ")
    return F.trim(F.lower(c))


def special_tokens(c: Column) -> Column:
    """Amounts, dates, numbers, percentages and capitalised words: what a repaired quote must not change."""
    return F.regexp_extract_all(c, F.lit(r"([$€£][0-9][0-9,.]*|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]+(?:[.,][0-9]+)*%?|\b[A-Z][a-zA-Z]+\b)"), 1)


def token_estimate(*texts: Column) -> Column:
    n = F.lit(0)
    for t in texts:
        n = n + F.length(F.coalesce(t, F.lit("")))
    return F.greatest(F.lit(1), F.floor(n / 4)).cast("long")


def compact(c: Column, n: int = 120, mark: str = "...") -> Column:
    c = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - len(mark)), F.lit(mark))).otherwise(c)


def slug(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", "_"))


def anchor_text(name: Column, description: Column) -> Column:
    t = F.trim(F.concat_ws(" ", F.trim(F.coalesce(name, F.lit(""))), F.trim(F.coalesce(description, F.lit("")))))
    return F.when(t == "", F.lit("__empty__")).otherwise(t)


def csv_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")))


def iso_time(c: Column) -> Column:
    return F.to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))


def epoch_minute(c: Column) -> Column:
    return F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm")


def retry_after(c: Column) -> Column:
    """Seconds of a hint such as ``try again in 200ms``; null without one."""
    pattern = r"try again in ([0-9.]+)\s*(ms|s)"
    n, unit = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
    return F.when(n != "", F.try_to_number(n, F.lit("999999999.999")).cast("double") / F.when(unit == "ms", 1000.0).otherwise(1.0))


def delta_text(a: Column, b: Column) -> Column:
    """``+d (+p%)``; without a base no percentage."""
    d = b - a
    sign = lambda x: F.when(x >= 0, "+").otherwise("-")
    pct = F.when(a != 0, F.concat(F.lit(" ("), sign(d / a), F.format_string("%.1f", F.abs(d / a) * 100), F.lit("%)"))).otherwise("")
    return F.concat(sign(d), F.abs(d).cast("string"), pct)


def parent_name(c: Column) -> Column:
    """The last part of a path such as ``A > B``."""
    return F.trim(F.element_at(F.split(c, ">"), -1))


def relevance(score: Column, n_comments: Column, created: Column, now: Column | float, half_life: float, comment_id: Column | None = None, comment_score: Column | None = None, comment_created: Column | None = None) -> Column:
    """Traction times a half-life decay. A source in a post has the post's, ln(1 + score) / 2 + 0.8 ln(1 + comments); a source in
    a comment (comment_id not null) has the comment's alone, ln(1 + score) / 2, and the comment's time if it has one. No time
    means no decay; a time to come counts as now."""
    ln = lambda c: F.log1p(F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0)).cast("double")))
    traction, at = ln(score) * 0.5 + ln(n_comments) * 0.8, created
    if comment_id is not None:
        traction = F.when(comment_id.isNotNull(), ln(comment_score) * 0.5).otherwise(traction)
        at = F.coalesce(F.when(comment_id.isNotNull() & (comment_created != 0), comment_created), created)
    now = now if isinstance(now, Column) else F.lit(now)
    age = F.greatest(F.lit(0.0), (now - at) / 86400.0)
    return traction * F.when(at.isNull(), 1.0).otherwise(F.pow(F.lit(0.5), age / half_life))
