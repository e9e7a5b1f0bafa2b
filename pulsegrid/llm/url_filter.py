"""URL filters: rules by host and path, and link-graph propagation for what no rule decides.

Hosts are nodes. Edges are absolute links between hosts, weighted by the number of pages, and a host's own
subdomain chain (m.site.example.org hangs on site.example.org). Three scores walk the graph together:

- trust starts at trusted hosts and follows links (personalised PageRank), but neither out of nor into blocked hosts: what those
  took would be lost there;
- distrust starts at blocked hosts and follows links backwards, to those who link there;
- risk is the damped chance that a walk along a host's own links meets a blocked host.

Blocked seeds are blocked. Another host is blocked when its distrust exceeds `block_at` times its trust and its risk is `risk_at` at
least: one bad link among many does not block a host that no trust reaches. Trust and distrust are masses that start with one unit at
every seed, risk depends on what a host leads to: the number of hosts or seeds is in none of them, so rows that have
no path to a host cannot change its verdict.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: (verdict, host and path); a rule fits its host and all subdomains if the path starts with the rule's.
Rule = tuple[str, str]


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    raw = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, text in reversed(ordered):
        of_host, _, of_path = text.partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith("/" + of_path)
        name, verdict = F.when(fits, F.lit(text)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, weight) between different hosts."""
    host = url_host(F.col(url_col))
    links = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"""(?i)(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""), 1)
    linked = pages.select(host.alias("src"), F.explode(F.array_distinct(links)).alias("dst")).select("src", F.lower("dst").alias("dst"))
    linked = linked.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.select(host.alias("src")).distinct()
    parent = F.regexp_extract("src", r"^[^.]+\.([^.]+\.[^.]+\..+)$", 1)  # keeps three labels at least
    family = hosts.select("src", parent.alias("dst"))
    both = family.unionByName(family.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1.0))
    edges = linked.unionByName(both).where("src <> '' and dst <> '' and src <> dst")
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def seeds_of_rules(host: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Predicates (trusted, blocked) on hosts that a rule allows or blocks with all their paths."""
    whole = lambda wanted: [text.removesuffix("/") for verdict, text in rules if verdict == wanted and text.endswith("/") and text.count("/") == 1]
    fits = lambda hosts: reduce(lambda a, b: a | b, [(host == h) | host.endswith("." + h) for h in hosts], F.lit(False))
    return fits(whole("allow")), fits(whole("block"))


def propagate(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """nodes (host, good, bad as booleans), edges (src, dst, weight) -> host, good, bad, trust, distrust, risk.

    The three scores are columns of one state and their shares columns of one table of arcs, so a round is one join and one
    grouping. The number of rounds is fixed: the error left is below damping**rounds. A node with many links meets
    them in map-side sums. What reaches a node without links is lost there.
    """
    bad = nodes.where("bad").select(F.col("host").alias("_bad"))
    marked = edges.join(bad, F.col("src") == F.col("_bad"), "left").withColumn("_from", F.col("_bad").isNotNull()).drop("_bad")
    marked = marked.join(bad, F.col("dst") == F.col("_bad"), "left").withColumn("keeps", ~F.col("_from") & F.col("_bad").isNull()).drop("_bad", "_from")
    marked = materialize(marked, "url-marked")
    kept = F.when(F.col("keeps"), F.col("weight"))
    out = marked.groupBy("src").agg(F.sum("weight").alias("out"), F.sum(kept).alias("out_kept"))
    into = marked.groupBy("dst").agg(F.sum("weight").alias("into"))
    shared = marked.join(out, "src").join(into, "dst")
    none = F.lit(0.0)
    forth = shared.where("keeps").select(F.col("src").alias("at"), F.col("dst").alias("to"), (F.col("weight") / F.col("out_kept")).alias("t"), none.alias("d"), none.alias("r"))
    back = shared.select(F.col("dst").alias("at"), F.col("src").alias("to"), none.alias("t"), (F.col("weight") / F.col("into")).alias("d"), (F.col("weight") / F.col("out")).alias("r"))
    arcs = materialize(forth.unionByName(back).groupBy("at", "to").agg(*[F.sum(c).alias(c) for c in "tdr"]), "url-arcs")
    discard(marked)

    unit = lambda flag: F.col(flag).cast("double")
    state = nodes.select("host", "good", "bad", unit("good").alias("trust"), unit("bad").alias("distrust"), unit("bad").alias("risk"))
    before = None
    for k in range(rounds):
        sums = [F.sum(F.col(score) * F.col(share)).alias(f"_{share}") for score, share in (("trust", "t"), ("distrust", "d"), ("risk", "r"))]
        came = state.join(arcs, state["host"] == arcs["at"]).groupBy("to").agg(*sums)
        moved = lambda share: damping * F.coalesce(F.col(f"_{share}"), none)
        state = state.join(came, state["host"] == came["to"], "left").select(
            "host", "good", "bad", (moved("t") + (1 - damping) * unit("good")).alias("trust"), (moved("d") + (1 - damping) * unit("bad")).alias("distrust"),
            F.when(F.col("bad"), 1.0).otherwise(moved("r")).alias("risk"),
        )
        if k % 4 == 3 or k == rounds - 1:
            state, old = materialize(state, "url-state"), before
            before = state
            if old:
                discard(old)
    discard(arcs)
    return state


def judge_hosts(
    pages: DataFrame, trusted: Column, blocked: Column, url_col: str = "url", html_col: str = "html", block_at: float = 1.0, risk_at: float = 0.2, rounds: int = 20
) -> DataFrame:
    """(host, trust, distrust, risk, verdict) of every host that has a page or a link. trusted, blocked: predicates on host."""
    edges = materialize(host_edges(pages, url_col, html_col), "url-edges")
    hosts = pages.select(url_host(F.col(url_col)).alias("host")).unionByName(edges.select(F.col("src").alias("host"))).unionByName(edges.select(F.col("dst").alias("host"))).where("host <> ''").distinct()
    marked = materialize(hosts.select("host", blocked.alias("bad"), (trusted & ~blocked).alias("good")), "url-hosts")
    scored = propagate(marked, edges, rounds=rounds)
    discard(edges, marked)
    blocks = F.col("bad") | ((F.col("distrust") > block_at * F.col("trust")) & (F.col("risk") >= risk_at))
    return scored.select("host", "trust", "distrust", "risk", F.when(blocks, "block").otherwise("allow").alias("verdict"))


def filter_urls(
    pages: DataFrame, rules: list[Rule], trusted: Column, blocked: Column, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", block_at: float = 1.0, risk_at: float = 0.2, rounds: int = 20
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    The longest fitting rule decides; otherwise the host's propagated scores do, with the hosts of whole-host rules among the seeds. Null urls and urls without ://
    have an empty host and path and are allowed. Null html has no links. Repeated rows are judged each; an empty
    table gives no rows. Other columns are not read.
    """
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    rule, verdict = rule_columns(host, path, rules)
    allowed, barred = seeds_of_rules(F.col("host"), rules)
    judged = materialize(judge_hosts(pages, trusted | allowed, blocked | barred, url_col, html_col, block_at, risk_at, rounds).select("host", F.col("verdict").alias("host_verdict")), "url-verdicts")
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("rule_verdict"))
    return rows.join(judged, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "host_verdict", F.lit("allow")).alias("verdict"))


def any_label(host: Column, labels: tuple[str, ...]) -> Column:
    """Whether one of the dot-separated parts of a host is among the labels."""
    parts = F.split(host, r"\.")
    return reduce(lambda a, b: a | b, [F.array_contains(parts, x) for x in labels])
