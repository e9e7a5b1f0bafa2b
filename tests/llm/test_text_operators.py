import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulsegrid.llm import language_id, secret_scan, toxicity
from pulsegrid.llm.bpe import bpe_digests, bpe_tokens, encode_texts
from pulsegrid.llm.secret_scan import scan_secrets
from pulsegrid.llm.sharding import shard_by_bytes

from .conftest import MESSY, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


TEXTS = [t or "" for _, t in MESSY] + ["don't WE'LL \x1c\x85 x", "aaaa aaaaaaa", "<|endoftext|>Hi <|ENDOFTEXT|> a<|startoftext|>b", "ΑΣ ΣΑΣ İstanbul ﬁ ǅ ẞ ſ", "x²½ 123 ª1º ×÷", "ha" * 600]


def test_bpe_equals_the_library():
    t = library()
    for text, (n, ids, decoded) in zip(TEXTS, encode_texts(TEXTS, PATH), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and n == len(want) and decoded == t.decode(want, skip_special_tokens=False)


def test_bpe_query_on_whole_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    t = library()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe_digests(docs, PATH).collect()}
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert got[r["doc_id"]] == (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))


def test_bpe_on_messy_rows(messy, empty):
    assert bpe_digests(messy, PATH).count() == len(MESSY) and bpe_digests(empty, PATH).count() == 0
    got = {r["doc_id"]: r["ids"] for r in bpe_tokens(messy, PATH).collect()}
    assert got[2] == [] and got[3] == [] and got[7] == library().encode("one", add_special_tokens=False).ids


def test_shards_are_contiguous_and_even(spark, sf, messy, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = shard_by_bytes(docs, 24, partitions=5).toPandas().sort_values("doc_id").reset_index(drop=True)
    text = docs.toPandas().sort_values("doc_id").reset_index(drop=True)
    sizes = [len((t or "").encode()) + 8 for t in text["text"]]
    assert got["size"].tolist() == sizes and got["text_crc32"].tolist() == [zlib.crc32((t or "").encode()) for t in text["text"]]
    before, total, want = 0, sum(sizes), []
    for s in sizes:
        want.append(min(23, 24 * (2 * before + s) // (2 * total)))
        before += s
    assert got["shard"].tolist() == want
    assert got["slot"].tolist() == got.groupby("shard").cumcount().tolist()
    load = got.groupby("shard")["size"].sum()
    assert load.max() - load.min() <= 2 * max(sizes) and got["grown_shard"].isna().all() and set(got["law"]) == {"bytes"}
    rows = shard_by_bytes(messy, 3).toPandas()
    assert len(rows) == len(MESSY) and sorted(rows["size"]) == sorted(len((t or "").encode()) + 8 for _, t in MESSY)
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in rows.groupby("shard"))
    assert shard_by_bytes(empty, 3).count() == 0


ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_secrets(spark, sf):
    rows = [(1, 'é PASSWORD="abc" Token: 12345678'), (2, "AKIA" + "A1" * 6 + " AKIA1"), (3, "x" + "0af" * 11 + "g"), (4, "\u017fecret=12345678 secret = '" + "a" * 9), (5, None), (5, None), (6, "apikey:ABCDEFGH api_key=short")]
    got = {r["doc_id"]: r for r in scan_secrets(documents(spark, rows)).collect()}
    for i, t in rows:
        assert got[i]["base_sha256"] == hashlib.sha256(base(t or "").encode()).hexdigest()
    assert (got[1]["n_assign"], got[2]["n_access"], got[3]["n_hex"], got[4]["n_assign"], got[5]["spans"]) == (1, 1, 1, 1, "")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["base_sha256"] == hashlib.sha256(base(texts[r["doc_id"]] or "").encode()).hexdigest() for r in scan_secrets(docs).collect())


def test_random_strings_are_told_from_structured_ones(spark, messy, empty):
    import random

    rng = random.Random(11)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choices(alphabet, k=48)) for _ in range(40)]
    plain = [("Ab1" * 16) for _ in range(40)] + ["thisisaverylongwordofletters", "UPPERCASELETTERSONLYHERE"]
    rows = [(i, f"see {k} there") for i, k in enumerate(keys)] + [(100 + i, f"see {k} there") for i, k in enumerate(plain)]
    got = {r["doc_id"]: r["spans"] for r in scan_secrets(documents(spark, rows)).collect()}
    assert sum(got[i] == "random:4:52" for i in range(40)) >= 36
    assert all(got[100 + i] == "" for i in range(len(plain)))
    assert scan_secrets(messy).count() == len(MESSY) and scan_secrets(empty).count() == 0


def test_keys_survive_a_mostly_structured_corpus(spark):
    import random

    rng = random.Random(3)
    lower = "abcdefghijklmnopqrstuvwxyz"
    alphabet = lower + lower.upper() + "0123456789"
    keys = ["".join(rng.choices(alphabet, k=n)) for n in (22, 32, 40, 60) for _ in range(100)] + ["".join(rng.choices(lower, k=24)) for _ in range(100)]
    words = "account settings report invoice handler session default profile network production request order".split()
    slugs = ["-".join(rng.choices(words, k=4)) + f"-{i}" for i in range(9 * len(keys))]
    rows = list(enumerate(keys + slugs))
    got = {r["doc_id"]: r["spans"] for r in scan_secrets(documents(spark, rows)).collect()}
    found = [got[i] == f"random:0:{len(k)}" for i, k in enumerate(keys)]
    assert all(sum(found[i : i + 100]) >= 96 for i in range(0, 500, 100))  # of every length and case
    assert sum(got[len(keys) + i] != "" for i in range(len(slugs))) <= 0.01 * len(slugs)
    alone = {r["doc_id"]: r["spans"] for r in scan_secrets(documents(spark, rows[: len(keys)])).collect()}
    assert all(alone[i] == got[i] for i in alone)  # other rows do not change a verdict


SHAPES = ("{}", "key={}", "https://x.y/z?sig={}&a=1", "svc-prod/{}", "s3://bucket-name/{}/part", "id_{}", "v1.{}", "{}==")


def test_keys_are_found_by_whatever_stands_next_to_them():
    rng = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for alphabet in (letters, letters + "+/", letters + "-_"):
        for n in (24, 40):
            for shape in SHAPES:
                hits = 0
                for _ in range(100):
                    key = "".join(rng.choice(alphabet) for _ in range(n))
                    text = f"see {shape.format(key)} end"
                    at = text.index(key)
                    hits += any(min(b, at + n) - max(a, at) >= 0.8 * n for a, b, _ in secret_scan.random_spans(text, secret_scan.base_spans(text)))
                assert hits >= 95, (alphabet[-2:], n, shape, hits)
    short = lambda n: "".join(rng.choice(letters) for _ in range(n))
    assert sum(bool(secret_scan.random_spans(short(18), [])) for _ in range(100)) >= 95
    assert not any(secret_scan.random_spans(short(17), []) for _ in range(100)) and any(secret_scan.random_spans(short(16), [], 16) for _ in range(9))


def test_joined_words_are_no_keys():
    rng = random.Random(12)
    words = "time year people world school state family student group country problem company system program question government number point water history result change morning reason research teacher force education handler default manager factory builder request response async".split()
    some = lambda n: [rng.choice(words) for _ in range(n)]
    for make in ("-".join, "_".join, "/".join, lambda w: "_".join(w).upper(), lambda w: "".join(x.capitalize() for x in w), lambda w: "/".join(f"{x}={x}" for x in w)):
        assert sum(bool(secret_scan.random_spans(make(some(4)), [])) for _ in range(300)) <= 3


def plain_candidates(run, least):
    """All spans between signs whose neighbours are signs or ends, kept by the rules one after another."""
    body = run.rstrip("=")
    ends = [-1, *[i for i, c in enumerate(body) if c in "=+/-_"], len(body)]
    pieces = [(a + 1, b) for a, b in zip(ends, ends[1:], strict=False) if b > a + 1]
    word = lambda x: bool(secret_scan.WORD.fullmatch(body[x[0] : x[1]]))
    out = set(pieces)
    for signs in ("+/", "-_"):
        for i, first in enumerate(pieces):
            for last in pieces[i:]:
                inside = body[first[0] : last[1]]
                if any(c in inside for c in "=+/-_" if c not in signs):
                    continue
                if word(first) or word(last):
                    continue
                # nothing but words of the same part may be left out on either side
                before = [x for x in pieces if x[1] <= first[0] and not set(body[x[1] : first[0]]) & (set("=+/-_") - set(signs))]
                after = [x for x in pieces if x[0] >= last[1] and not set(body[last[1] : x[0]]) & (set("=+/-_") - set(signs))]
                if all(map(word, before)) and all(map(word, after)):
                    out.add((first[0], last[1]))
    return {(a, len(run) if b == len(body) else b) for a, b in out if b - a >= least}  # padding does not count


def test_candidates_against_a_plain_version():
    rng = random.Random(13)
    for _ in range(2000):
        run = "".join(rng.choice(["ab", "Cd", "x9", "K7q", "EF", "=", "/", "-", "_", "+", "=", "42"]) for _ in range(rng.randrange(1, 9))) + "=" * rng.randrange(3)
        assert set(secret_scan.candidates(run, 3)) == plain_candidates(run, 3), run


def test_cuts_against_a_plain_step_up():
    rng = np.random.default_rng(12)
    classes = len(secret_scan.NULL_REJECTION)
    drawn = []
    counts = np.zeros((classes, secret_scan.BINS))
    for k in range(classes):
        genuine = rng.random(3000)
        structured = rng.beta(0.15, 1 + 3 * k, (0, 500, 3000, 30_000, 200_000, 5000, 800)[k])
        p = np.concatenate([genuine, structured])
        drawn.append(p[p > secret_scan.NULL_REJECTION[k]])
        np.add.at(counts[k], (drawn[k] * secret_scan.BINS).astype(int), 1)
    cuts = secret_scan.cuts_of(counts)
    for k, cut in enumerate(cuts):
        low, p = secret_scan.NULL_REJECTION[k], drawn[k]
        genuine = 2 * (p >= 0.5).sum()
        share = lambda c: 1 - genuine * (1 - c) / max((p >= c).sum(), 1)  # noqa: B023, E731
        steps = [i / 1000 for i in range(round(low * 1000), 51)]
        assert cut == next((c for c in steps if share(c) <= secret_scan.FALSE_SHARE), 0.05)
        assert low <= cut <= secret_scan.MOST_REJECTION
    assert cuts[0] == secret_scan.NULL_REJECTION[0] and cuts[4] == secret_scan.MOST_REJECTION
    assert secret_scan.cuts_of(np.zeros((classes, secret_scan.BINS))) == list(secret_scan.NULL_REJECTION)


def test_p_values_of_genuine_keys_are_about_uniform():
    import random

    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for alphabet, n in ((letters + letters.upper() + "0123456789", 40), (letters + "0123456789", 32), ("0123456789abcdef", 30)):
        p = np.array([secret_scan.battery("".join(rng.choices(alphabet, k=n))) for _ in range(800)])
        assert (p <= 0.01).mean() <= 0.025 and (p <= 0.05).mean() <= 0.08 and 0.4 <= (p > 0.5).mean() <= 0.75


def test_encodings_are_inferred():
    name = lambda s: (secret_scan.infer_encoding(s) or [None])[0]
    assert [name(x * 10) for x in ("12", "1a", "1A", "A2Z", "1z", "aB1", "aB+", "aB_", "ab")] == ["dec", "hex", "HEX", "base32", "base36", "base62", "base64", "base64url", None]


def test_language_held_out_accuracy_and_edges(spark, sf, messy, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert got["held_out"].tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.98 and got["score"].between(0, 1).all()
    model = language_id.train(docs)
    out = {r["doc_id"]: r for r in language_id.identify(messy, model).collect()}
    assert out[2]["lang_pred"] == out[3]["lang_pred"] == out[5]["lang_pred"] == "und" and out[6]["lang_pred"] != "und"
    assert language_id.identify(empty, model).count() == 0
    nothing = language_id.train(docs.where("false"))
    assert {r["lang_pred"] for r in language_id.identify(messy, nothing, with_spans=True).collect()} == {"und"}


SCRIPT_SAMPLES = {
    "ru": "\u0441\u0435\u0433\u043e\u0434\u043d\u044f \u0445\u043e\u0440\u043e\u0448\u0430\u044f \u043f\u043e\u0433\u043e\u0434\u0430 \u0438 \u043c\u044b \u0438\u0434\u0451\u043c \u0434\u043e\u043c\u043e\u0439",
    "bg": "\u0434\u043d\u0435\u0441 \u0432\u0440\u0435\u043c\u0435\u0442\u043e \u0435 \u0445\u0443\u0431\u0430\u0432\u043e \u0438 \u043d\u0438\u0435 \u0441\u0435 \u043f\u0440\u0438\u0431\u0438\u0440\u0430\u043c\u0435 \u0432\u043a\u044a\u0449\u0438",
    "el": "\u03c3\u03ae\u03bc\u03b5\u03c1\u03b1 \u03bf \u03ba\u03b1\u03b9\u03c1\u03cc\u03c2 \u03b5\u03af\u03bd\u03b1\u03b9 \u03ba\u03b1\u03bb\u03cc\u03c2",
    "zh": "\u4eca\u5929\u5929\u6c14\u5f88\u597d \u6211\u4eec\u56de\u5bb6",
    "en": "today the weather is fine and we are walking home",
}


def test_scripts_narrow_the_languages(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(SCRIPT_SAMPLES.items())], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.langs == ["bg", "el", "en", "ru", "zh"]
    masks = {lang: {model.langs[k] for k in np.flatnonzero(model.mask[language_id.word_scripts([t.split()[0]])[0]] == 0)} for lang, t in SCRIPT_SAMPLES.items()}
    assert masks == {"ru": {"ru", "bg"}, "bg": {"ru", "bg"}, "el": {"el"}, "zh": {"zh"}, "en": {"en"}}
    mixed = " ".join(SCRIPT_SAMPLES[x] for x in ("en", "el", "ru", "zh"))
    row = language_id.identify(documents(spark, [(1, mixed)]), model, with_spans=True).first()
    assert [s["lang"] for s in row["spans"]] == ["en", "el", "ru", "zh"]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, model).collect()}
    assert got == {i: lang for i, lang in enumerate(SCRIPT_SAMPLES)}


def test_only_letters_make_a_language(spark):
    model = language_id.train(spark.createDataFrame([(1, "some words", "en"), (2, "otras palabras", "es")], "doc_id long, text string, lang string"))
    rows = [(1, "\u00bd \u00b2 \u2460 \u2167 12 _"), (2, "\u00bdword\u00b2s"), (3, "\u2460some\u2460words")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(documents(spark, rows), model).collect()}
    assert got[1] == ("und", 0.0) and got[2][0] == "en" and got[3][0] == "en"
    assert language_id.words_of("\u00bdWord\u00b2s") == ["word", "s"]


def test_many_languages_and_bounded_samples(spark):
    rng = np.random.default_rng(6)
    langs = [f"x{i:03d}" for i in range(600)]
    stems = {lang: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for lang in langs}
    rows = [(i * 3 + k, f"{stems[lang]}{stems[lang][::-1]} {stems[lang]}ing", lang) for i, lang in enumerate(langs) for k in range(3)]
    docs = spark.createDataFrame(rows + rows[:50], "doc_id long, text string, lang string")
    model = language_id.train(docs, rows=2)
    assert model.langs == langs
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) > 0.95 * len(rows)
    from pulsegrid.llm.sampling import bounded_sample, sample_per_group

    per = sample_per_group(docs, "lang", "doc_id", 2).groupBy("lang").count().collect()
    assert len(per) == 600 and all(r["count"] == 2 for r in per)
    some = bounded_sample(docs.select("doc_id"), "doc_id", 100)
    assert some.count() == 100 and some.exceptAll(bounded_sample(docs.select("doc_id"), "doc_id", 100)).count() == 0


def test_spans_of_mixed_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    take = lambda lang: " ".join(docs.where(f"lang = '{lang}' and length(text) > 600").orderBy("doc_id").first()["text"].split()[:80])
    row = language_id.identify(documents(spark, [(1, take("de") + " " + take("es"))]), model, with_spans=True).first()
    assert {s["lang"] for s in row["spans"]} >= {"de", "es"} and len(row["spans"]) <= 6
    assert all(a["last_word"] == b["first_word"] for a, b in zip(row["spans"][:-1], row["spans"][1:], strict=True))


def test_viterbi_against_all_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    scores, begin, switch = rng.normal(size=(13, 3)), np.array([0, 5, 5, 6, 13]), 0.7
    got = language_id.viterbi(scores, begin, switch)
    value = lambda path, a: sum(scores[a + i, p] for i, p in enumerate(path)) - switch * sum(x != y for x, y in zip(path[:-1], path[1:], strict=True))
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        if b > a:
            best = max(value(p, a) for p in itertools.product(range(3), repeat=b - a))
            assert value(got[a:b].tolist(), a) == pytest.approx(best)


def test_toxicity_held_out_and_edges(spark, messy, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_held_out(docs, labels).join(labels, "doc_id").toPandas()
    assert got["held_out"].tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]
    held = got[got["held_out"]]
    hit, false = ((held["predicted"] == 1) & (held["toxic"] == t) for t in (1, 0))
    assert hit.sum() >= 0.8 * (held["toxic"] == 1).sum() and false.sum() <= 0.02 * (held["toxic"] == 0).sum()
    none = labels.where("false")
    out = toxicity.score_toxicity(messy, none).toPandas()
    assert len(out) == len(MESSY) and out["score"].between(0, 1).all()
    assert toxicity.score_toxicity(empty, labels).count() == 0
    doubled = labels.unionByName(labels).withColumn("toxic", F.when(F.col("doc_id") % 50 == 0, None).otherwise(F.col("toxic")))
    assert toxicity.score_toxicity(documents(spark, [(1, "a"), (2, None)]), doubled).count() == 2


def test_label_model_learns_who_can_be_trusted(spark):
    good, bad = 1, 2  # votes of the first voter follow the label, those of the second do not
    rows = [(good, 1, 90), (0, 1, 10), (good, 0, 2), (0, 0, 400), (bad, 0, 100), (bad, 1, 10), (good, -1, 50), (0, -1, 500)]
    model = toxicity.fit_label_model(spark.createDataFrame(rows, "votes long, toxic int, n long"))
    posterior = model.posterior(np.array([0, good, bad]))
    assert posterior[1] > 0.8 > 0.3 > posterior[2] and posterior[0] < 0.1


def test_label_model_counts_correlated_voters_once(spark):
    # voters 0 and 1 always agree; given the label, 2 is independent of them. All have the same accuracy
    rows = []
    for y in (0, 1):
        p = 0.6 if y else 0.1
        for a in (0, 1):
            for c in (0, 1):
                rows.append((3 * a + 4 * c, y, round(20_000 * (p if a else 1 - p) * (p if c else 1 - p))))
    model = toxicity.fit_label_model(spark.createDataFrame(rows, "votes long, toxic int, n long"))
    both = model.posterior(np.array([3]))[0]
    odds = lambda p: np.log(p / (1 - p))
    one = np.log(0.6 / 0.1)
    off = np.log(0.4 / 0.9)
    assert odds(both) == pytest.approx(one + off, abs=0.15)  # agreement of 0 and 1 adds nothing
    assert odds(model.posterior(np.array([7]))[0]) == pytest.approx(2 * one, abs=0.15)


def test_spanning_tree_and_posterior_against_plain_versions():
    import itertools

    rng = np.random.default_rng(5)
    weight = rng.random((6, 6))
    weight = weight + weight.T
    parent = toxicity._spanning_tree(weight)
    value = sum(weight[i, parent[i]] for i in range(1, 6))

    def is_tree(edges):
        seen, grow = {0}, True
        while grow:
            grow = False
            for a, b in edges:
                if (a in seen) != (b in seen):
                    seen |= {a, b}
                    grow = True
        return len(seen) == 6

    every = list(itertools.combinations(range(6), 2))
    assert value == pytest.approx(max(sum(weight[a, b] for a, b in e) for e in itertools.combinations(every, 5) if is_tree(e)))
    n = toxicity.N_VOTERS
    parents = np.array([[max(i - 1, 0) for i in range(n)], [i // 2 for i in range(n)]])
    rate = rng.uniform(0.05, 0.95, (2, n, 2))
    rate[:, 0, 0] = rate[:, 0, 1]
    votes = rng.integers(0, 1 << n, 20)
    model = toxicity.LabelModel(0.3, parents, rate)
    for v, got in zip(votes.tolist(), model.posterior(votes), strict=True):
        p = [0.7, 0.3]
        for y in (0, 1):
            for i in range(n):
                r = rate[y, i, v >> int(parents[y, i]) & 1]
                p[y] *= r if v >> i & 1 else 1 - r
        assert got == pytest.approx(p[1] / (p[0] + p[1]))


def test_linear_model_against_a_plain_gradient():
    rng = np.random.default_rng(8)
    rows = [np.flatnonzero(rng.random(5) < 0.4) for _ in range(80)]
    style, target = rng.random((80, 2)), rng.random(80)
    w = toxicity.fit_linear(rows, style, target, 5, rounds=3000)
    x = np.zeros((80, 8))
    for i, r in enumerate(rows):
        x[i, r] = 1
    x[:, 5:7], x[:, 7] = style, 1
    gradient = x.T @ (1 / (1 + np.exp(-x @ w)) - target) / 80 + 2e-4 * w
    assert np.abs(gradient).max() < 1e-3
