"""Display texts, notes and redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what is redacted, in this order, and what stands in its place
REDACTIONS = (
    (r"ghp_[a-zA-Z0-9]{20,}", "[REDACTED_GH_TOKEN]"),
    (r"gho_[a-zA-Z0-9]{20,}", "[REDACTED_GH_TOKEN]"),
    (r"ghu_[a-zA-Z0-9]{20,}", "[REDACTED_GH_TOKEN]"),
    (r"ghs_[a-zA-Z0-9]{20,}", "[REDACTED_GH_TOKEN]"),
    (r"github_pat_[a-zA-Z0-9_]+", "[REDACTED_GH_PAT]"),
    (r"Bearer\s+[a-zA-Z0-9_\-\.]+", "Bearer [REDACTED]"),
    (r"(?i)(Authorization:\s*)[^\s,\]]+", "$1[REDACTED]"),
    (r"(?i)(token[=:]\s*)[^\s,\]]+", "$1[REDACTED]"),
    (r"(?i)(api[_-]?key[=:]\s*)[^\s,\]]+", "$1[REDACTED]"),
)


def duration_short(hours: Column) -> Column:
    """Nm (whole minutes, cut off), N.Nh, N.Nd, or N/A."""
    return (
        F.when(hours.isNull(), "N/A")
        .when(hours < 1, F.format_string("%dm", (hours * 60).cast("long")))
        .when(hours < 24, F.format_string("%.1fh", hours.cast("double")))
        .otherwise(F.format_string("%.1fd", hours.cast("double") / 24))
    )


def duration_long(hours: Column) -> Column:
    """N minutes, N.N hours or N.N days; null stays null."""
    return (
        F.when(hours.isNull(), F.lit(None).cast("string"))
        .when(hours < 1, F.format_string("%.0f minutes", hours.cast("double") * 60))
        .when(hours < 24, F.format_string("%.1f hours", hours.cast("double")))
        .otherwise(F.format_string("%.1f days", hours.cast("double") / 24))
    )


def number_text(value: Column, decimals: int = 0) -> Column:
    """Thousands separators; null as 0."""
    return F.coalesce(F.format_number(value, decimals), F.lit("0"))


def short_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def count_label(value: Column, unit: str) -> Column:
    return F.format_string(f"%d {unit}", value.cast("long"))


def percent_label(value: Column, what: str) -> Column:
    return F.format_string(f"%.0f%%%% {what}".replace("%%%%", "%%"), value.cast("double"))


def missing_notes(flags: dict[str, Column], prefix: str = "Missing: ") -> Column:
    """A note that names the practices whose flag is not true; empty if none is missing."""
    names = F.concat_ws(", ", *[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in flags.items()])
    return F.when(names == "", F.lit("")).otherwise(F.concat(F.lit(prefix), names))


def redact(text: Column) -> Column:
    for pattern, shown in REDACTIONS:
        text = F.regexp_replace(text, pattern, shown)
    return text


def redaction_count(text: Column) -> Column:
    """How many replacements `redact` makes, each counted on the text that its pattern sees."""
    total = F.lit(0)
    for pattern, shown in REDACTIONS:
        total = total + F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))
        text = F.regexp_replace(text, pattern, shown)
    return total


def stats_map(text: Column) -> Column:
    """JSON text of numbers by name."""
    return F.from_json(text, "map<string,bigint>")
