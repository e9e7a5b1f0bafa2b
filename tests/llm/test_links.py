import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import chat_tools, decontaminate, url_filter
from pulsegrid.llm.chat_tools import Argument
from pulsegrid.llm.queries import BLOCKED_LABELS, ORACLES, QUERIES, TRUSTED_LABELS, URL_RULES

from .conftest import MESSY, documents


def items(spark, rows):
    return spark.createDataFrame([(i, t, 0.1, "x") for i, t in rows], "item_id long, text string, score double, doc_id string")


def test_alignment_against_the_plain_recurrence():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 14))] for _ in range(2))
        h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0.0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -0.5), h[i - 1][j] - 0.5, h[i][j - 1] - 0.5)
        assert decontaminate.align(np.array(a), np.array(b))[0] == pytest.approx(max(max(r) for r in h))


def test_copies_and_edited_copies_are_found(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(("the", "of", "and")) if rng.random() < 0.3 else f"k{rng.randrange(3000)}"
    text = lambda n: [word() for _ in range(n)]
    tests = [text(rng.randrange(15, 50)) for _ in range(30)]
    rows, planted = [], set()
    for d in range(400):
        body = text(120)
        if d % 4 == 0:
            k = d % 30
            copy = list(tests[k])
            if d % 8 == 0:  # every sixth word changed, one dropped
                copy = [f"z{i}" if i % 6 == 3 else w for i, w in enumerate(copy)][:-1]
            body[60:60] = [w.upper() + "," for w in copy]
            planted.add((d, k))
        rows.append((d, " ".join(body)))
    test_items = items(spark, [(i, " ".join(t)) for i, t in enumerate(tests)] + [(90, None), (91, "two words"), (92, "")])
    for block_words in (10**6, 300):  # one block of items, and several
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(documents(spark, rows), test_items, block_words=block_words).collect()}
        assert got == planted


def test_a_passage_that_a_third_of_documents_copy_keeps_its_seeds(spark):
    passage = "rare words alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(i, f"some lead in number {i} " + (passage if i % 3 == 0 else "nothing to see")) for i in range(300)]
    got = {r["doc_id"] for r in decontaminate.find_leaks(documents(spark, rows), items(spark, [(1, passage)])).collect()}
    assert got == {i for i in range(300) if i % 3 == 0}


def plain_leaks(rows, test_items):
    """Every document against every item, over the whole text, with the plain recurrence: (doc, item) -> share of a perfect score."""
    words = lambda t: "".join(" " if c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in (t or "").lower()).split()
    out = {}
    for i, t in test_items:
        item = words(t)
        for d, text in rows:
            body = words(text)
            h, best = [0.0] * (len(body) + 1), 0.0
            for w in item:
                new = [0.0]
                for j, v in enumerate(body, 1):
                    new.append(max(0.0, h[j - 1] + (1 if w == v else -0.5), h[j] - 0.5, new[j - 1] - 0.5))
                h, best = new, max(best, max(new))
            out[d, i] = best / max(len(item), 1)
    return out


def test_leaks_against_every_pair(spark):
    rng = random.Random(21)
    text = lambda n: [f"k{rng.randrange(60)}" for _ in range(n)]
    tests = [(i, " ".join(text(rng.randrange(8, 25)))) for i in range(6)]
    rows = []
    for d in range(60):
        body = text(rng.randrange(5, 70))
        if d % 2:
            copy = rng.choice(tests)[1].split()
            for _ in range(rng.randrange(0, 7)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(9)}"
            body[len(body) // 2 : len(body) // 2] = copy
        rows.append((d, " ".join(body)))
    every = plain_leaks(rows, tests)
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.find_leaks(documents(spark, rows), items(spark, tests)).collect()}
    assert got and all(every[k] == pytest.approx(v) for k, v in got.items())
    assert set(got) == {k for k, v in every.items() if v >= decontaminate.THRESHOLD}


def test_leaks_edited_at_every_second_and_third_word(spark):
    rng = random.Random(22)
    text = lambda n: [f"k{rng.randrange(2000)}" for _ in range(n)]
    tests = [(i, " ".join(text(n))) for i, n in enumerate([30, 31, 12, 7, 4, 24])]
    edits = {
        "third changed": lambda x: [f"z{k}" if k % 3 == 2 else w for k, w in enumerate(x)], "third dropped": lambda x: [w for k, w in enumerate(x) if k % 3 != 2],
        "one inserted everywhere": lambda x: [y for w in x for y in (w, f"z{rng.randrange(99)}")], "second changed": lambda x: [f"z{k}" if k % 2 else w for k, w in enumerate(x)],
        "two inserted at thirds": lambda x: [y for k, w in enumerate(x) for y in ((w, "z1", "z2") if k % 3 == 2 else (w,))], "pairs swapped": lambda x: [x[k ^ 1] if k ^ 1 < len(x) else w for k, w in enumerate(x)],
    }
    rows, kind = [], {}
    for name, edit in edits.items():
        for i, t in tests:
            rows.append((len(rows), " ".join(text(40) + edit(t.split()) + text(40))))
            kind[rows[-1][0], i] = name
    every = plain_leaks(rows, tests)
    want = {k for k, v in every.items() if v >= decontaminate.THRESHOLD}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(documents(spark, rows), items(spark, tests)).collect()}
    assert got == want  # recall 1 of every kind of edit that stays over the threshold
    assert {"third changed", "third dropped", "one inserted everywhere"} <= {kind[k] for k in want if k in kind}


def test_leaks_on_messy_rows(spark, messy, empty):
    test_items = items(spark, [(1, "Same text here, five words"), (2, None)])
    got = decontaminate.find_leaks(messy, test_items)
    assert {r["doc_id"] for r in got.collect()} == {1, 4}
    kept = decontaminate.drop_leaked(messy, got)
    assert kept.count() == len(MESSY) - 3 and kept.columns == messy.columns
    assert decontaminate.find_leaks(empty, test_items).count() == 0 and decontaminate.find_leaks(messy, test_items.where("false")).count() == 0


TURNS = "conv_id long, turn long, role string, text string, position long, status string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows], TURNS)


SCHEMAS = {"reply": (Argument("prompt", "string", at_least=1, at_most=20), Argument("turn", "integer", at_least=0)), "configure": (Argument("prompt", "string"),)}


def test_chat_links_orders_and_validates(spark):
    rows = [(1, 0, "system", "be good"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", "x" * 30), (2, 5, "assistant", "alone"), (3, 0, "user", None), (3, 0, "user", None), (4, 0, None, ""), (None, 1, "user", "q")]
    got = {(r["conv_id"], r["message_id"]): r for r in chat_tools.link_tool_calls(chat_tools.messages_of_turns(turns(spark, rows)), SCHEMAS).collect()}
    assert [got["1", str(i)]["position"] for i in range(4)] == [0, 1, 2, 3]
    assert [got["1", str(i)]["status"] for i in range(4)] == ["unanswered", "linked", "linked", "unanswered"]
    assert got["1", "1"]["canonical"] == '{"arguments":{"prompt":"hi","turn":1},"id":"1","name":"reply","type":"call"}'
    assert got["1", "2"]["canonical"] == '{"content":{"text":"hello"},"id":"1","name":"reply","type":"result"}'
    assert got["1", "3"]["errors"] == "prompt: above 20" and got["1", "3"]["valid"] is False and got["1", "2"]["valid"] is None
    assert got["2", "5"]["status"] == "orphan" and got["2", "5"]["position"] == 0
    assert got["3", "0"]["copies"] == 2 and got["3", "0"]["errors"] == "prompt: missing"
    assert got["4", "0"]["errors"] == "prompt: below 1" 
    assert [r["valid"] for (conv, m), r in got.items() if conv.startswith("none#") and m == "1"] == [True]
    assert chat_tools.link_tool_calls(chat_tools.messages_of_turns(turns(spark, [])), SCHEMAS).count() == 0


def test_a_long_conversation_and_parallel_messages(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(500)] + [(9, 0, "user", "a"), (9, 0, "user", "b")]
    got = chat_tools.link_tool_calls(chat_tools.messages_of_turns(turns(spark, rows)), SCHEMAS).collect()
    assert {int(r["message_id"]): r["position"] for r in got if r["conv_id"] == "1"} == {i: i for i in range(500)}
    assert len([r for r in got if r["conv_id"] == "9"]) == 2


def plain_positions(rows):
    """Turn by turn: a turn's messages come one after those of the turn before, if there are any."""
    out = {}
    for conv, turn, role, text in sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], r[1])):
        out[conv, turn, role, text] = 1 + max((p for (c, t, _, _), p in out.items() if c == conv and t == turn - 1), default=-1)
    return out


def test_several_messages_of_one_turn_keep_the_order(spark):
    rng = random.Random(4)
    rows = [(8, 0, "user", "a"), (8, 0, "user", "b"), (8, 1, "user", "c"), (8, 2, "assistant", "d"), (8, 2, "assistant", "e"), (8, 3, "user", "f")]
    for conv in range(20, 40):
        for turn in range(12):
            for _ in range(rng.choice([0, 1, 1, 1, 2, 3])):
                rows.append((conv, turn, rng.choice(["user", "assistant", "system"]), f"m{rng.randrange(6)}"))
    rows += [(None, 3, "user", "x"), (None, 4, "user", "y"), (None, 4, "user", "y")]
    messages = chat_tools.messages_of_turns(turns(spark, rows))
    named = {(r["conv_id"], r["message_id"]): r for r in messages.collect()}
    got = chat_tools.link_tool_calls(messages, SCHEMAS).collect()
    want = plain_positions(rows)
    by_turn = {(c, t): p for (c, t, _, _), p in want.items()}
    assert len(got) == len(want) + 2
    for r in got:
        m = named[r["conv_id"], r["message_id"]]
        assert r["position"] == (0 if r["conv_id"].startswith("none#") else by_turn[int(r["conv_id"]), m["turn"]])
    calls = {}
    for m in named.values():
        if m["kind"] == "call":
            calls.setdefault((m["conv_id"], m["call_id"]), []).append((m["message_id"], m["tool"]))
    for r in got:
        if r["kind"] == "result":
            found = calls.get((r["conv_id"], r["call_id"]))
            assert r["status"] == ("linked" if found else "orphan")
            assert f'"name":{chr(34) + min(found)[1] + chr(34) if found else "null"}' in r["canonical"]
    assert chat_tools.link_tool_calls(messages, SCHEMAS).exceptAll(chat_tools.link_tool_calls(messages, SCHEMAS)).count() == 0


def test_a_very_long_payload(spark):
    long = "word " * 400_000
    got = chat_tools.link_tool_calls(chat_tools.messages_of_turns(turns(spark, [(1, 0, "user", long), (1, 1, "assistant", long)])), SCHEMAS).collect()
    assert {r["errors"] for r in got} == {"prompt: above 20", None} and all(len(r["canonical"]) > 2_000_000 for r in got)


def test_a_circle_of_messages_stops_the_job(spark):
    nodes = spark.createDataFrame([("a", "b"), ("b", "a")], "node string, parent string")
    with pytest.raises(ValueError):
        chat_tools.chain_depths(nodes, max_rounds=4)


def test_argument_rules(spark):
    schema = {"t": (Argument("n", "number", at_least=1), Argument("o", "object", required=False), Argument("c", "string", one_of=("x", "y")))}
    rows = [("t", '{"n": 2, "c": "x"}', ""), ("t", '{"n": "2", "c": "z"}', "c: not allowed; n: not number"), ("t", '{"n": 0.5, "o": [1], "c": "y"}', "n: below 1; o: not object"), ("u", "{}", "tool: unknown"), ("t", "oops", "arguments: not JSON"), ("t", None, "arguments: not JSON")]
    df = spark.createDataFrame([r[:2] for r in rows], "name string, args string")
    got = [r[0] for r in df.select(F.array_join(chat_tools.argument_errors(F.col("name"), F.col("args"), schema), "; ")).collect()]
    assert got == [r[2] for r in rows]


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    end = min([path.index(c) for c in "?#" if c in path] + [len(path)])
    return host, path[:end]


def plain_rule(host, path):
    best = None
    for verdict, rule in URL_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


def plain_scores(nodes, good, bad, edges, rounds=20, damping=0.85):
    """trust, distrust and risk of every node, one edge at a time."""

    def shares(pairs, by):
        total = {}
        for e, w in pairs.items():
            total[e[by]] = total.get(e[by], 0) + w
        return {e: w / total[e[by]] for e, w in pairs.items()}

    along = shares({e: w for e, w in edges.items() if not {*e} & bad}, 0)
    back = {(b, a): x for (a, b), x in shares(edges, 1).items()}
    leads = {(b, a): x for (a, b), x in shares(edges, 0).items()}

    def walk(seeds, share, fixed=False):
        score = {n: float(n in seeds) for n in nodes}
        for _ in range(rounds):
            came = dict.fromkeys(nodes, 0.0)
            for (a, b), x in share.items():
                came[b] += score[a] * x
            score = {n: 1.0 if fixed and n in seeds else damping * came[n] + (0 if fixed else (1 - damping) * (n in seeds)) for n in nodes}
        return score

    return walk(good, along), walk(bad, back), walk(bad, leads, fixed=True)


def test_url_rules_and_propagation(spark):
    link = lambda *hosts: " ".join(f'<a href="https://{h}/x">' for h in hosts)
    pages = [
        (1, "https://WWW.Good.example.org/en/1?x#y", link("site.example.org", "spam-farm.example.org")),
        (2, "http://site.example.org", link("www.good.example.org")),
        (3, "https://spam-farm.example.org/es/2", link("ring.example.org")),
        (4, "https://ring.example.org/a", link("spam-farm.example.org", "spam-farm.example.org")),
        (5, "https://m.site.example.com/en/71", None), (6, "https://x.example.net/de/81", ""), (7, "https://x.net/de/", ""),
        (8, None, link("ring.example.org")), (9, "nothing", None), (9, "nothing", None), (10, "a://b://C/d?e", None), (11, "http://?q", None), (12, "https://notcom/en/", None),
    ]
    df = spark.createDataFrame([(*p, "h", 1) for p in pages], "page_id long, url string, html string, host string, verdict int")
    host = F.col("host")
    got = url_filter.filter_urls(df, URL_RULES, url_filter.any_label(host, TRUSTED_LABELS), url_filter.any_label(host, BLOCKED_LABELS)).collect()
    assert len(got) == len(pages)
    by = {r["page_id"]: r for r in got}
    for i, u, _ in pages:
        h, p = plain_host_path(u)
        rule = plain_rule(h, p)
        assert (by[i]["host"], by[i]["path"], by[i]["rule"]) == (h, p, rule and rule[1])
        if rule:
            assert by[i]["verdict"] == rule[0]
    assert by[4]["verdict"] == "block" and by[1]["verdict"] == "allow" and by[9]["verdict"] == "allow" and by[7]["rule"] == "net/de/"

    edges = {(r["src"], r["dst"]): r["weight"] for r in url_filter.host_edges(df).collect()}
    nodes = {plain_host_path(u)[0] for _, u, _ in pages} - {""} | {x for e in edges for x in e}
    bad = {n for n in nodes if set(n.split(".")) & set(BLOCKED_LABELS)}
    good = {n for n in nodes if "www" in n.split(".")} - bad
    trust, distrust, risk = plain_scores(nodes, good, bad, edges)
    scored = {r["host"]: r for r in url_filter.judge_hosts(df.drop("host"), url_filter.any_label(host, TRUSTED_LABELS), url_filter.any_label(host, BLOCKED_LABELS)).collect()}
    assert set(scored) == nodes
    for n in nodes:
        assert (scored[n]["trust"], scored[n]["distrust"], scored[n]["risk"]) == pytest.approx((trust[n], distrust[n], risk[n]))
        assert scored[n]["verdict"] == ("block" if n in bad or (distrust[n] > trust[n] and risk[n] >= 0.2) else "allow")
    assert url_filter.filter_urls(df.where("false"), URL_RULES, F.lit(False), F.lit(False)).count() == 0


def test_a_farm_of_a_third_of_all_hosts_changes_no_other_verdict(spark):
    link = lambda *hosts: " ".join(f'<a href="https://{h}/x">' for h in hosts)
    farm = [f"s{i}.spam-farm.example.com" for i in range(60)]
    ring = [f"ring{i}.example.net" for i in range(12)]  # no seeds, but all link to one
    small = [("free-bets.example.com", None), *((h, link("casino-win.example.net")) for h in ring), ("casino-win.example.net", link(*ring))]
    small += [("www.good.example.org", link("friend.example.org")), ("friend.example.org", link("www.good.example.org", "casino-win.example.net")), ("plain.example.org", None)]
    large = small + [(h, link("spam-farm.example.com")) for h in farm] + [(f"www.other{i}.example.org", None) for i in range(100)]
    host = F.col("host")

    def judge(rows):
        pages = spark.createDataFrame([(i, f"https://{h}/a", html) for i, (h, html) in enumerate(rows)], "page_id long, url string, html string")
        return {r["host"]: r["verdict"] for r in url_filter.judge_hosts(pages, url_filter.any_label(host, TRUSTED_LABELS), url_filter.any_label(host, BLOCKED_LABELS)).collect()}

    a, b = judge(small), judge(large)
    assert {h: b[h] for h in a} == a
    assert all(b[h] == "block" for h in [*farm, *ring, "free-bets.example.com", "casino-win.example.net", "spam-farm.example.com"])
    assert b["www.good.example.org"] == b["friend.example.org"] == b["plain.example.org"] == "allow"


LINKS = "https://{}/a"


def linked(spark, rows):
    html = lambda hosts: " ".join(f'<a href="https://{h}/x">' for h in hosts)
    return spark.createDataFrame([(i, LINKS.format(h), html(to)) for i, (h, *to) in enumerate(rows)], "page_id long, url string, html string")


def test_one_bad_link_of_many_blocks_no_host(spark, tmp_path):
    others = [f"h{i}.example.org" for i in range(20)]
    rows = [("news.example.org", "casino-win.example.net", *others), ("reader.example.org", "news.example.org"), ("fan.example.org", "casino-win.example.net"), ("fan2.example.org", "fan.example.org")]
    rows += [("casino-win.example.net",), ("www.good.example.org", "friend.example.org"), ("friend.example.org", "www.good.example.org", "casino-win.example.net"), ("x.spam-farm.example.com", "news.example.org")]
    pages = linked(spark, rows)
    host = F.col("host")
    got = {r["host"]: r["verdict"] for r in url_filter.judge_hosts(pages, url_filter.any_label(host, TRUSTED_LABELS), url_filter.any_label(host, BLOCKED_LABELS)).collect()}
    blocked = {"casino-win.example.net", "x.spam-farm.example.com", "spam-farm.example.com", "fan.example.org", "fan2.example.org"}
    assert {h for h, v in got.items() if v == "block"} == blocked & got.keys()
    assert got["news.example.org"] == got["reader.example.org"] == got["friend.example.org"] == "allow"
    # the registered SQL has the same rule
    import duckdb

    pages.toPandas().to_parquet(tmp_path / "pages.parquet")
    want = duckdb.sql(ORACLES["op6_url_link_graph"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet'")).fetchall()
    have = QUERIES["op6_url_link_graph"](spark, str(tmp_path)).collect()
    assert sorted((r["page_id"], r["verdict"]) for r in have) == sorted((r[0], r[4]) for r in want)


def test_rules_over_whole_hosts_are_seeds(spark):
    pages = linked(spark, [("a.bad.example.org", "b.example.org"), ("b.example.org", "bad.example.org"), ("c.example.org", "fine.example.org"), ("fine.example.org", "c.example.org")])
    rules = [("block", "bad.example.org/"), ("allow", "fine.example.org/"), ("block", "c.example.org/only")]
    got = {r["host"]: r["verdict"] for r in url_filter.filter_urls(pages, rules, F.lit(False), F.lit(False)).collect()}
    assert got == {"a.bad.example.org": "block", "b.example.org": "block", "c.example.org": "allow", "fine.example.org": "allow"}


def test_very_long_urls_and_null_ids(spark):
    rows = [(None, "https://x.example.org/" + "a" * 300_000, 'href="https://y.example.org"' * 20_000), (None, "https://" + "z" * 5_000 + "/q", None), (3, "", "")]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES, F.lit(False), F.lit(False)).collect()
    assert sorted((len(r["host"]), len(r["path"]), r["verdict"]) for r in got) == [(0, 0, "allow"), (13, 300_001, "allow"), (5_000, 2, "allow")]


def test_url_query_over_all_pages(spark, sf):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op6_url_link_graph"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        h, p = plain_host_path(pages[r["page_id"]])
        rule = plain_rule(h, p)
        assert (r["host"], r["path"], r["rule"]) == (h, p, rule and rule[1]) and r["verdict"] in ("allow", "block")
