"""Who is a bot, by a table of rules.

A rule has rule_id, kind, value and rank. Kinds: `human` and `bot` name a login, `type` an account type, `pattern` a regular expression that a
login matches from its start. The rule of smallest (rank, rule_id) among those that fit decides; without any a login is a person.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of this many rows or fewer are sent to all tasks; more are joined by whatever way the planner takes.
SMALL = 10_000
BLOCK = 100


def _best(rules: DataFrame, kinds: tuple[str, ...], on: str) -> DataFrame:
    """The first rule of each value: (on, rule)."""
    rule = F.struct("rank", "rule_id", "kind", "value")
    best = rules.where(F.col("kind").isin(*kinds) & F.col("value").isNotNull()).groupBy(F.col("value").alias(on)).agg(F.min(rule).alias(f"_by{on}"))
    return F.broadcast(best) if best.limit(SMALL + 1).count() <= SMALL else best


def _of_patterns(rules: DataFrame, login: Column, most: int) -> Column:
    """The first pattern that a login matches. A block's patterns are tried one by one only where the block as one pattern matches."""
    found = rules.where("kind = 'pattern' AND value IS NOT NULL").orderBy("rank", "rule_id").select("rank", "rule_id", "kind", "value").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} patterns: raise most_patterns, or give exact logins as rules of kind bot")
    out = F.lit(None)
    for i in reversed(range(0, len(found), BLOCK)):
        block = found[i : i + BLOCK]
        first = F.lit(None)
        for r in reversed(block):
            first = F.when(login.rlike(f"^(?:{r['value']})"), F.struct(*[F.lit(x) for x in r])).otherwise(first)
        out = F.when(login.rlike("|".join(f"^(?:{r['value']})" for r in block)), first).otherwise(out)
    return out.cast("struct<rank: int, rule_id: bigint, kind: string, value: string>")


def classify(people: DataFrame, rules: DataFrame, login: str = "login", kind: str = "user_type", most_patterns: int = 2_000) -> DataFrame:
    """people with rule_id, reason and is_bot. reason: `override: human`, `override: bot`, `type`, `pattern: ...` or `human`.

    Null logins fit no rule of a login. An account type fits its `type` rule; without one it says nothing. One pass over people: exact values are equi-joined,
    patterns are one expression. Repeated rules count once, the first rank wins.
    """
    shaped = rules.select(F.col("rule_id").cast("long").alias("rule_id"), "kind", "value", F.col("rank").cast("int").alias("rank"))
    rows = people.withColumns({"_login": F.col(login), "_type": F.col(kind)})
    rows = rows.join(_best(shaped, ("human", "bot"), "_login"), "_login", "left").join(_best(shaped, ("type",), "_type"), "_type", "left")
    rule = F.least("_by_login", "_by_type", _of_patterns(shaped, F.col("_login"), most_patterns))  # nulls are passed over
    of = rule["kind"]
    reason = F.when(of.isNull(), "human").when(of == "type", "type").when(of == "pattern", F.concat(F.lit("pattern: "), rule["value"])).otherwise(F.concat(F.lit("override: "), of))
    return rows.select(*people.columns, rule["rule_id"].alias("rule_id"), reason.alias("reason"), F.coalesce(of != "human", F.lit(False)).alias("is_bot"))
