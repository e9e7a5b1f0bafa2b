"""Telling bots from people."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: parts of a lower-cased login that mark a bot
BOT_PARTS = (
    "[bot]", "-bot-", "github-actions", "dependabot", "renovate", "greenkeeper", "snyk-bot", "codecov", "mergify", "imgbot",
    "allcontributors", "semantic-release-bot", "stale",
)
# fixed values: the default configurable patterns
BOT_PATTERNS = (r".*\[bot\]$", r"^dependabot$", r"^renovate\[bot\]$")


def is_bot(login: Column, kind: Column) -> Column:
    """True for type Bot, for a login with a bot part, and for no user at all. One search for all parts: the login is read once."""
    parts = F.lower(login).rlike("|".join(re.escape(p) for p in BOT_PARTS))
    return F.coalesce(parts, F.lit(True)) | F.coalesce(kind == "Bot", F.lit(False))


def bot_reason(login: Column, kind: Column, patterns: tuple[str, ...] = BOT_PATTERNS, people: tuple[str, ...] = (), bots: tuple[str, ...] = ()) -> Column:
    """Why a login counts as a bot or a person: an override wins over the type, that over the patterns (matched from the start)."""
    out = F.when(login.isin(*people), "override: human") if people else F.when(F.lit(False), "")
    if bots:
        out = out.when(login.isin(*bots), "override: bot")
    out = out.when(F.coalesce(kind == "Bot", F.lit(False)), "type")
    for p in patterns:
        out = out.when(login.rlike(f"^(?:{p})"), f"pattern: {p}")
    return out.otherwise("human")


def is_bot_by_reason(reason: Column) -> Column:
    return ~reason.isin("human", "override: human")
