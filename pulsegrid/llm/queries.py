"""The registered queries of this subpackage: thin bindings of operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


@query(
    "op1_exact_dedup",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
    FROM d JOIN g ON d.t = g.t
    """,
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op5_shard_by_bytes")
def op5_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"), 24)


@query(
    "shards_by_bytes",
    """
    WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) + 8 AS BIGINT) AS size FROM documents),
    p AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM d),
    s AS (SELECT doc_id, size, CAST(least((24 * (2 * before + size)) // (2 * total), 23) AS INTEGER) AS shard FROM p)
    SELECT doc_id, size, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot FROM s
    """,
)
def shards_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op5: everything but the checksum."""
    return op5_shard_by_bytes(spark, sf_dir).select("doc_id", "size", "shard", "slot")


@query(
    "base_secrets",
    r"""
    SELECT doc_id,
        len(list_filter(regexp_extract_all(t, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS n_assign,
        len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS n_access,
        len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 32)) AS n_hex
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    """,
)
def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op10: the counts of the base kinds."""
    return op10_secret_battery(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


@query("op7_bpe_pair_index")
def op7_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import bpe_digests

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(
    "op4_hyperminhash_near_dedup",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    s AS (
        SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
            ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w),
    n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
    e AS (SELECT doc_id, unnest(sh) AS g FROM s),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
    b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r(doc_id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, b.y FROM r JOIN b ON r.reach = b.x)
    SELECT doc_id, n AS n_shingles, min(reach) AS component_id, doc_id = min(reach) AS kept
    FROM r JOIN n USING (doc_id) GROUP BY doc_id, n
    """,
)
def op4_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_dup_classes

    return near_dup_classes(table(spark, sf_dir, "documents"), width=4, threshold=80)


@query("op8_language_spans")
def op8_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify_held_out

    return identify_held_out(table(spark, sf_dir, "documents"))


@query("op10_secret_battery")
def op10_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


@query("op9_toxicity_weak_supervision")
def op9_toxicity_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_held_out

    return score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_decontaminate")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op2_chat_tool_calls",
    """
    WITH m AS (
        SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn, lower(role) AS role, text, count(*) AS copies
        FROM conversations GROUP BY ALL),
    o AS (
        SELECT *, role NOT IN ('assistant', 'tool') AS is_call,
               turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS island
        FROM m),
    p AS (
        SELECT *, turn - min(turn) OVER (PARTITION BY conv_id, island) AS position,
               CASE WHEN role = 'system' THEN 'configure' WHEN is_call THEN 'reply' END AS tool,
               CASE WHEN is_call THEN turn ELSE turn - 1 END AS call_turn
        FROM o),
    l AS (
        SELECT p.*, c.tool AS call_tool, c.turn IS NOT NULL AS has_call,
               EXISTS (SELECT 1 FROM p r WHERE NOT r.is_call AND r.conv_id = p.conv_id AND r.call_turn = p.call_turn) AS answered
        FROM p LEFT JOIN p c ON c.is_call AND c.conv_id = p.conv_id AND c.turn = p.call_turn)
    SELECT conv_id, CAST(turn AS VARCHAR) AS message_id, CASE WHEN is_call THEN 'call' ELSE 'result' END AS kind,
           CAST(call_turn AS VARCHAR) AS call_id, position,
           CASE WHEN is_call THEN CASE WHEN answered THEN 'linked' ELSE 'unanswered' END
                ELSE CASE WHEN has_call THEN 'linked' ELSE 'orphan' END END AS status,
           CASE WHEN is_call THEN length(text) BETWEEN 1 AND CASE WHEN role = 'system' THEN 4000 ELSE 1000 END END AS valid,
           CASE WHEN is_call THEN CASE WHEN length(text) < 1 THEN 'prompt: below 1'
                WHEN length(text) > CASE WHEN role = 'system' THEN 4000 ELSE 1000 END
                THEN 'prompt: above ' || CASE WHEN role = 'system' THEN '4000' ELSE '1000' END ELSE '' END END AS errors,
           CAST(CASE WHEN is_call
                THEN json_object('arguments', json_object('prompt', text, 'turn', turn), 'id', CAST(call_turn AS VARCHAR), 'name', coalesce(tool, call_tool), 'type', 'call')
                ELSE json_object('content', json_object('text', text), 'id', CAST(call_turn AS VARCHAR), 'name', coalesce(tool, call_tool), 'type', 'result')
                END AS VARCHAR) AS canonical,
           copies
    FROM l
    """,
)
def op2_chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_tools import Argument, link_tool_calls, messages_of_turns

    turn = Argument("turn", "integer", at_least=0)
    schemas = {
        "reply": (Argument("prompt", "string", at_least=1, at_most=1000), turn),
        "configure": (Argument("prompt", "string", at_least=1, at_most=4000), turn),
    }
    return link_tool_calls(messages_of_turns(table(spark, sf_dir, "conversations")), schemas)


#: Fixed values of the contract.
URL_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
#: Seeds of the propagation: hosts with such a label.
BLOCKED_LABELS = ("spam-farm", "casino-win", "adult-x", "ads-track", "free-bets")
TRUSTED_LABELS = ("www",)


def _url_oracle(rounds: int = 20) -> str:
    """The same rules and propagation with one materialised step per round."""
    az, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    has = lambda labels: f"list_has_any(string_split(host, '.'), [{', '.join(repr(x) for x in labels)}])"
    cases = {"rule": "", "verdict": ""}
    for verdict, rule in sorted(URL_RULES, key=lambda r: -len(r[1])):
        h, _, p = rule.partition("/")
        fits = f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN"
        cases["rule"] += f" {fits} '{rule}'"
        cases["verdict"] += f" {fits} '{verdict}'"
    start = {"t": "CAST(good AS DOUBLE)", "d": "CAST(bad AS DOUBLE)", "r": "CAST(bad AS DOUBLE)"}
    steps = []
    for name, first in start.items():
        steps.append(f"{name}0 AS MATERIALIZED (SELECT host, {first} AS seed, {first} AS score FROM mk)")
        for k in range(rounds):
            new = "CASE WHEN seed = 1 THEN 1 ELSE 0.85 * coalesce(came, 0) END" if name == "r" else "0.85 * coalesce(came, 0) + 0.15 * seed"
            steps.append(
                f"{name}{k + 1} AS MATERIALIZED (SELECT host, seed, {new} AS score FROM {name}{k} "
                f"LEFT JOIN (SELECT dst AS host, sum(score * share) AS came FROM {name}{k} JOIN walk_{name} ON host = src GROUP BY 1) USING (host))"
            )
    return rf"""
    WITH pg AS (
        SELECT page_id, coalesce(html, '') AS html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{az}', '{low}') AS host,
               regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    lk AS (SELECT host AS src, lower(unnest(list_distinct(regexp_extract_all(html, '(?i)(?:href|src)\s*=\s*["'']?(?:https?:)?//([^/?#"''\s<>]+)', 1)))) AS dst FROM pg),
    fam AS (SELECT DISTINCT host AS src, regexp_extract(host, '^[^.]+\.([^.]+\.[^.]+\..+)$', 1) AS dst FROM pg),
    ed AS MATERIALIZED (
        SELECT src, dst, count(*)::DOUBLE AS weight FROM (SELECT * FROM lk UNION ALL SELECT src, dst FROM fam UNION ALL SELECT dst, src FROM fam)
        WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
    hs AS (SELECT host FROM pg WHERE host <> '' UNION SELECT src FROM ed UNION SELECT dst FROM ed),
    mk AS MATERIALIZED (SELECT host, {has(BLOCKED_LABELS)} AS bad, NOT {has(BLOCKED_LABELS)} AND {has(TRUSTED_LABELS)} AS good FROM hs),
    et AS (SELECT ed.* FROM ed JOIN mk a ON a.host = src JOIN mk b ON b.host = dst WHERE NOT a.bad AND NOT b.bad),
    walk_t AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM et),
    walk_d AS MATERIALIZED (SELECT dst AS src, src AS dst, weight / sum(weight) OVER (PARTITION BY dst) AS share FROM ed),
    walk_r AS MATERIALIZED (SELECT dst AS src, src AS dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM ed),
    {", ".join(steps)},
    v AS (
        SELECT host, CASE WHEN r{rounds}.seed = 1 OR d{rounds}.score > t{rounds}.score AND r{rounds}.score >= 0.2 THEN 'block' ELSE 'allow' END AS host_verdict
        FROM t{rounds} JOIN d{rounds} USING (host) JOIN r{rounds} USING (host)),
    j AS (SELECT page_id, host, path, CASE {cases["rule"]} END AS rule, CASE {cases["verdict"]} END AS rule_verdict FROM pg)
    SELECT page_id, host, path, rule, coalesce(rule_verdict, host_verdict, 'allow') AS verdict FROM j LEFT JOIN v USING (host)
    """


@query("op6_url_link_graph", _url_oracle())
def op6_url_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .url_filter import any_label, filter_urls

    host = F.col("host")
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES, any_label(host, TRUSTED_LABELS), any_label(host, BLOCKED_LABELS))


@query(
    "op13_importance_resampling",
    r"""
    WITH byte AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda r, k: xor(r >> 1, (r & 1) * 3988292384))) AS of_byte),
    w AS (
        SELECT 'd' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
        UNION ALL SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
    f AS (
        SELECT side, doc_id, unnest(list_concat(ws,
            list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
            list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS feature FROM w),
    g AS (SELECT side, doc_id, feature, count(*) AS n FROM f GROUP BY ALL),
    u AS (SELECT feature, hex(encode(feature)) AS bytes FROM (SELECT DISTINCT feature FROM g)),
    h AS (
        SELECT feature, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(bytes), 2), lambda i: CAST('0x' || substr(bytes, i, 2) AS BIGINT))),
            lambda r, x: xor(r >> 8, of_byte[(xor(r, x) & 255) + 1]))) % 10000 AS bucket FROM u, byte),
    c AS (SELECT side, doc_id, bucket, sum(n) AS n FROM g JOIN h USING (feature) GROUP BY ALL),
    k AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM c GROUP BY bucket),
    a AS (SELECT sum(s)::DOUBLE AS ss, sum(t)::DOUBLE AS tt FROM k),
    v AS (SELECT bucket, floor(1000 * ln((t::DOUBLE + 1) * (ss + 10000) / ((s::DOUBLE + 1) * (tt + 10000)))) AS gain FROM k, a),
    e AS (SELECT doc_id, sum(n * gain) AS weight, sum(n) AS n_features FROM c JOIN v USING (bucket) WHERE side = 'd' GROUP BY doc_id),
    p AS (
        SELECT w.doc_id, len(ws) >= 20 AS able, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
               CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || w.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS draw
        FROM w LEFT JOIN e USING (doc_id) WHERE w.side = 'd'),
    r AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY weight + draw DESC, doc_id) AS place, count(*) FILTER (able) OVER () AS n_able FROM p)
    SELECT doc_id, n_features, weight, weight + draw AS score, CASE WHEN able AND place <= 5 * n_able // 100 THEN place END AS rank FROM r
    """,
)
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op12_hard_negatives_rtree",
    """
    WITH e AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
    s AS (
        SELECT a.vec_id AS anchor_id, e.vec_id AS other_id, a.label = e.label AS same, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score
        FROM e a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 50 = 0),
    p AS (
        SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
    SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
           other_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) <= 3
    """,
)
def op12_hard_negatives_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .hard_negatives import hard_negatives

    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))


@query("op11_balanced_postings")
def op11_balanced_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))
