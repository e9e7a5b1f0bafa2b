"""Tool-call linking for chat data, in DataFrame operations only.

Calls and results are messages with an identifier. The operator
- hash-joins results to calls by conversation and identifier;
- orders the messages of a conversation topologically: a result follows its call, and a message follows
  the message that it answers. Depths come from pointer doubling over the links, so a conversation of a
  million turns takes twenty joins on unique keys and no task ever holds a whole conversation;
- validates arguments against a schema per tool (types, required keys, lengths, ranges, allowed values);
- serialises each message as canonical JSON: sorted keys, no white space (Spark's variant keeps
  object keys sorted at every level).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


@dataclass(frozen=True)
class Argument:
    """What a tool's argument must be. kind: string, integer, number, boolean, object or array."""

    name: str
    kind: str
    required: bool = True
    at_least: float | None = None  # a number's value, a string's length
    at_most: float | None = None
    one_of: tuple[str, ...] = ()


#: tool name -> arguments
Schemas = dict[str, tuple[Argument, ...]]
_VARIANT_KINDS = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|DECIMAL.*|FLOAT)", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Error texts of a call's JSON arguments as a sorted array; empty if they are valid."""
    parsed = F.try_parse_json(arguments)
    errors = [F.when(parsed.isNull(), F.lit("arguments: not JSON")), F.when(~F.coalesce(name.isin(*schemas), F.lit(False)), F.lit("tool: unknown"))]
    for tool, fields in schemas.items():
        for a in fields:
            value = F.try_variant_get(parsed, f"$.{a.name}", "variant")
            kind = F.schema_of_variant(value)
            text = F.try_variant_get(parsed, f"$.{a.name}", "string")
            missing = value.isNull() | (kind == "VOID")
            wrong = ~kind.rlike(f"^{_VARIANT_KINDS[a.kind]}$")
            measure = F.length(text).cast("double") if a.kind == "string" else F.expr("cast(null as double)") if a.kind in ("object", "array", "boolean") else F.try_variant_get(parsed, f"$.{a.name}", "double")
            rule = F.when(missing, F.lit(f"{a.name}: missing") if a.required else F.lit(None).cast("string")).when(wrong, F.lit(f"{a.name}: not {a.kind}"))
            if a.at_least is not None:
                rule = rule.when(measure < a.at_least, F.lit(f"{a.name}: below {a.at_least:g}"))
            if a.at_most is not None:
                rule = rule.when(measure > a.at_most, F.lit(f"{a.name}: above {a.at_most:g}"))
            if a.one_of:
                rule = rule.when(~text.isin(*a.one_of), F.lit(f"{a.name}: not allowed"))
            errors.append(F.when((name == tool) & parsed.isNotNull(), rule))
    return F.array_sort(F.array_compact(F.array(*errors)))


def chain_depths(nodes: DataFrame, node: str = "node", parent: str = "parent", max_rounds: int = 40) -> DataFrame:
    """(node, depth): the number of ancestors of each node, its parent's first, by pointer doubling.

    nodes must be unique; a parent that is no node counts as none. A cycle never runs out of ancestors and stops
    the job.
    """
    known = nodes.select(F.col(node).alias("up"))
    state = nodes.select(F.col(node).alias("node"), F.col(parent).alias("up")).join(known, "up", "left_semi")
    roots = nodes.select(F.col(node).alias("node")).join(state.select("node"), "node", "left_anti").select("node", F.lit(None).cast(nodes.schema[node].dataType).alias("up"), F.lit(0).cast("long").alias("depth"))
    roots = materialize(roots, "chat-roots")
    running = materialize(state.select("node", "up", F.lit(1).cast("long").alias("depth")), "chat-depth")
    done = roots
    for _ in range(max_rounds):
        if not running.limit(1).count():
            return done.select("node", "depth")
        # only nodes that still have ancestors to count move; they land on any node
        far = done.unionByName(running).select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        moved = materialize(running.join(far, "up").select("node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth")), "chat-depth")
        running, done = moved.where("up is not null"), done.unionByName(moved.where("up is null"))
    raise ValueError("messages answer each other in a circle")


def link_tool_calls(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """Link, order, validate and serialise.

    messages: conv_id, message_id (unique in its conversation), answers (the message_id that it follows, or
    null), kind (`call` or `result`), call_id, tool, payload (JSON: a call's arguments, a result's
    content), copies. A result follows the call with its identifier (of several, the one with the smallest message_id); a result
    without a call follows what it answers. One row per message: conv_id, message_id, kind, call_id, position (topological depth), status
    (`linked`, `unanswered` for a call, `orphan` for a result), valid (calls; null for results), errors, canonical.
    """
    name = F.to_json(F.array(F.col("conv_id"), F.col("message_id")))
    link = F.to_json(F.array(F.col("conv_id"), F.col("call_id")))
    base = materialize(
        messages.select("*", name.alias("node"), link.alias("link"), F.when(F.col("answers").isNotNull(), F.to_json(F.array(F.col("conv_id"), F.col("answers")))).alias("parent")), "chat-messages"
    )
    calls = base.where("kind = 'call'").select("link", F.col("node").alias("call_node"), F.col("tool").alias("call_tool"))
    # of several calls with one identifier the one with the smallest message_id is meant; hash joins on unique identifiers
    calls = calls.groupBy("link").agg(F.min(F.struct("call_node", "call_tool")).alias("c")).select("link", "c.*").hint("shuffle_hash")
    results = base.where("kind = 'result'").select("link").distinct().withColumn("answered", F.lit(True)).hint("shuffle_hash")
    bones = base.select("node", "link", "kind", "parent")  # payloads stay where they are until all is known of a message
    linked = bones.join(calls, "link", "left").join(results, "link", "left").select("node", "kind", "parent", "call_node", "call_tool", "answered")
    linked = materialize(linked, "chat-linked")
    depths = chain_depths(linked.select("node", F.when(F.col("kind") == "result", F.coalesce("call_node", "parent")).otherwise(F.col("parent")).alias("parent")))
    is_call = F.col("kind") == "call"
    errors = F.when(is_call, F.array_join(argument_errors(F.col("tool"), F.col("payload"), schemas), "; "))
    content = F.coalesce(F.to_json(F.try_parse_json("payload")), F.lit("null"))
    quoted = lambda c: F.coalesce(F.to_json(F.to_variant_object(F.array(c.cast("string")))), F.lit("[null]"))
    bare = lambda c: F.regexp_replace(quoted(c), r"^\[|\]$", "")
    canonical = F.concat(
        F.lit('{"'), F.when(is_call, F.lit("arguments")).otherwise(F.lit("content")), F.lit('":'), content,
        F.lit(',"id":'), bare(F.col("call_id")), F.lit(',"name":'), bare(F.coalesce("tool", "call_tool")), F.lit(',"type":'), bare(F.col("kind")), F.lit("}"),
    )
    status = F.when(is_call, F.when(F.col("answered"), "linked").otherwise("unanswered")).otherwise(F.when(F.col("call_node").isNotNull(), "linked").otherwise("orphan"))
    known = linked.select("node", "call_node", "call_tool", "answered").join(depths, "node")
    return base.join(known, "node").select(
        "conv_id", "message_id", "kind", "call_id", F.col("depth").alias("position"), status.alias("status"), (errors == "").alias("valid"), errors.alias("errors"), canonical.alias("canonical"), "copies"
    )


def messages_of_turns(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) as messages: user and system turns call, assistant and tool turns answer.

    A call's identifier is its turn; an answer carries the identifier of the turn before it. Rows that repeat all of
    conversation, turn, role and text are one message with a count of copies; different rows of one turn are told apart
    by the digest of role and text, and a message of the next turn answers the one with the smallest message_id. All of them
    have the same position, as all follow the turn before. Null roles count as user, null texts as JSON null (a missing
    argument). Rows without conversation are conversations of their own (one per distinct row), named by a digest; rows
    without a turn answer nothing.
    """
    text, role = F.col("text").cast("string"), F.coalesce(F.lower(F.col("role").cast("string")), F.lit("user"))
    turn_no = F.col("turn").cast("long")
    lone = F.concat(F.lit("none#"), F.sha2(F.to_json(F.struct(turn_no.alias("turn"), role.alias("role"), text.alias("text"))), 256))
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), lone).alias("conv"), turn_no.alias("turn"), role.alias("role"), text.alias("text")
    ).groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    turn = F.col("at")
    rows = rows.withColumn("at", F.coalesce(F.col("turn").cast("string"), F.lit("none")))
    rows = rows.withColumn("variant", F.concat(turn, F.lit("#"), F.sha2(F.to_json(F.struct("role", "text")), 256)))
    # what a turn is called and what it answers, without texts; then texts move once
    one = rows.groupBy("conv", "at", "turn").agg(F.count("*").alias("variants"), F.min("variant").alias("head"))
    before = one.where("turn is not null").select("conv", (F.col("turn") + 1).cast("string").alias("at"), F.when(F.col("variants") > 1, F.col("head")).otherwise(turn).alias("before"))
    rows = rows.join(one.select("conv", "at", "variants").join(before, ["conv", "at"], "left"), ["conv", "at"])
    is_call = ~F.col("role").isin("assistant", "tool")
    return rows.select(
        F.col("conv").alias("conv_id"),
        F.when(F.col("variants") > 1, F.col("variant")).otherwise(turn).alias("message_id"),
        F.col("before").alias("answers"),
        F.when(is_call, "call").otherwise("result").alias("kind"),
        F.when(is_call, turn).otherwise(F.coalesce((F.col("turn") - 1).cast("string"), F.lit("none"))).alias("call_id"),
        F.when(F.col("role") == "system", "configure").when(is_call, "reply").alias("tool"),
        F.when(is_call, F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))).otherwise(F.to_json(F.struct("text"))).alias("payload"),
        "copies",
        "turn",
    )
