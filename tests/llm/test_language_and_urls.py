"""Operators 6 and 8: held-out accuracy, exact paths, scripts, rules, calibration."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import language_id as lid
from tessera.llm import url_filter as uf

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return lid.learn(spark.read.parquet(f"{SF}/documents.parquet").where(~lid.held_out()))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lid.op6_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(held) > 20
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def best_path(scores, penalty):
    n, k = scores.shape
    return max(itertools.product(range(k), repeat=n), key=lambda p: sum(scores[t, x] for t, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:])))


def value(scores, path, penalty):
    return sum(scores[t, x] for t, x in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


def test_viterbi_and_constant_paths():
    rng = np.random.default_rng(4)
    constant = 0
    for _ in range(200):
        scores, penalty = rng.normal(size=(rng.integers(1, 7), 3)) * 2, 6.0
        want = value(scores, best_path(scores, penalty), penalty)
        assert value(scores, lid.viterbi(scores, penalty)[0], penalty) == pytest.approx(want)
        best, margin, sure = lid.constant_paths(scores, np.array([0, len(scores)]), penalty)
        if sure[0]:
            constant += 1
            assert value(scores, [best[0]] * len(scores), penalty) == pytest.approx(want)
        assert margin[0] >= 0
    assert constant > 20


def test_best_paths_of_several_texts():
    rng = np.random.default_rng(7)
    sizes = [5, 0, 1, 30, 7, 30, 0, 2]
    first, scores = np.cumsum([0, *sizes]), rng.normal(size=(sum(sizes), 4)) * 3
    texts = np.array([0, 2, 3, 5, 7])
    path = lid.best_paths(scores, first, texts, 4.0)
    for n in texts:
        assert (path[first[n] : first[n + 1]] == lid.viterbi(scores[first[n] : first[n + 1]], 4.0)[0]).all()
    assert len(lid.best_paths(scores, first, np.zeros(0, np.int64), 4.0)) == len(scores)


def test_constant_paths_keep_texts_apart():
    rng = np.random.default_rng(6)
    parts = [rng.normal(size=(n, 3)) for n in (4, 0, 1, 9, 0)]
    first = np.cumsum([0, *map(len, parts)])
    best, margin, sure = lid.constant_paths(np.concatenate(parts), first, 3.0)
    for k, p in enumerate(parts):
        if len(p):
            b, m, s = lid.constant_paths(p, np.array([0, len(p)]), 3.0)
            assert (b[0], s[0]) == (best[k], sure[k]) and m[0] == pytest.approx(margin[k])


def slow_model(docs):
    """Trigram scores and scripts of each language, counted one by one."""
    grams, scripts = {}, {}
    for text, lang in docs:
        for word, keys, script in slow_words(text):
            grams.setdefault(lang, Counter()).update(keys)
            scripts.setdefault(lang, Counter())[script] += len(word)
    size = 1 << lid.BUCKET_BITS
    scores = {k: (lambda c, n: lambda key: math.log((c[key] + 0.1) / (n + 0.1 * size)))(c, sum(c.values())) for k, c in grams.items()}
    return scores, {k: {s for s, n in c.items() if n >= lid.SCRIPT_SHARE * max(1, sum(c.values()))} for k, c in scripts.items()}


def slow_words(text):
    """(bytes, trigram buckets, script) of each word."""
    raw = text.encode()
    for m in re.finditer(rb"[A-Za-z\x80-\xff]+", raw):
        low = bytearray(raw[: m.end()].lower()[m.start() :])
        for k in range(1, len(low)):
            if low[k - 1] == 0xC3 and 0x80 <= low[k] <= 0x9E and low[k] != 0x97:
                low[k] += 0x20
        padded = b" " + bytes(low) + b" "
        keys = [(int.from_bytes(padded[k : k + 3]) * 0x9E3779B1 % (1 << 32)) >> 16 for k in range(len(low))]
        kinds = [lid.NAMES.index(lid.SCRIPTS[max(n for n, s in enumerate(lid.SCRIPT_STARTS) if s <= ord(c))]) for c in m.group().decode() if ord(c) >= 0x340]
        yield m.group(), keys, max(kinds, default=0)


def slow_label(text, scores, allowed, penalty):
    """(language, score, evidence) by a table over all words and languages."""
    names, rows, sizes = sorted(scores), [], []
    for word, keys, script in slow_words(text):
        row = {k: sum(map(scores[k], keys)) for k in names}
        fits = [k for k in names if script in allowed[k]]
        if fits:
            row = {k: row[k] if k in fits else min(row.values()) - lid.SWITCH_PENALTY for k in names}
        rows.append(row)
        sizes.append(len(word))
    if not rows:
        return "und", 0.0, None
    best = {k: (rows[0][k], [k]) for k in names}
    for row in rows[1:]:
        best = {k: max(((v - penalty * (j != k) + row[k], [*p, k]) for j, (v, p) in best.items()), key=lambda x: x[0]) for k in names}
    path = max(best.values(), key=lambda x: x[0])[1]
    letters = Counter()
    for k, n in zip(path, sizes):
        letters[k] += n
    total = sorted(sum(r[k] for r in rows) for k in names)
    lang, n = max(letters.items(), key=lambda x: x[1])
    return lang, n / sum(sizes) * (1 - math.exp(total[-2] - total[-1])), sum(r[k] for r, k in zip(rows, path)) / sum(sizes) + math.log(65536)


def test_query_by_brute_force(spark):
    """Every row of the query on the small table, from counts to labels."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    scores, allowed = slow_model([(r.text, r.lang) for r in docs.values() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None])
    got = lid.op6_language_id(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        lang, score, evidence = slow_label(docs[r.doc_id].text[:4000], scores, allowed, lid.SWITCH_PENALTY) if len(docs[r.doc_id].text) <= 4000 else (None, None, None)
        assert lang is None or (r.lang_pred, pytest.approx(r.score, abs=1e-4), pytest.approx(r.evidence, abs=1e-4)) == (lang, score, evidence)


def test_long_texts_are_labelled_in_pieces(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 300").collect()
    text = " ".join(r.text for r in docs[:25]) + "日本語" * 400
    whole, cut = (list(lid.label(model, pa.array([text]), lid.SWITCH_PENALTY, limit)) for limit in (1 << 22, 3000))
    assert len(whole) == len(cut) == 1 and len(whole[0][1].spans) > 3
    a, b = whole[0][1], cut[0][1]
    assert a.spans[:-2] == b.spans[:-2] and abs(a.letters - b.letters).sum() < 5000 and a.evidence == pytest.approx(b.evidence, rel=0.05)
    plain = text[: text.index("日")]
    x, y = (next(lid.label(model, pa.array([plain]), lid.SWITCH_PENALTY, limit))[1] for limit in (1 << 22, 3000))
    assert x.spans == y.spans and (x.letters == y.letters).all() and x.margin == pytest.approx(y.margin) and x.evidence == pytest.approx(y.evidence)
    blank = next(iter(lid.label(model, pa.array(["1 2 3 " * 2000]), lid.SWITCH_PENALTY, 3000)), None)
    assert blank is None


def test_what_no_language_explains_goes(spark, frame, model):
    """A letter test would keep these."""
    rng = random.Random(3)
    noise = [" ".join("".join(rng.choice("bcdfgjkqvwxz") for _ in range(7)) for _ in range(40)) for _ in range(20)] + ["鼈麤龘 " * 30, "Ѭѩ Ѯѱ ѳѵ " * 20]
    clean = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(k, t) for k, t in enumerate(noise)] + [(100 + r.doc_id, r.text) for r in clean]
    kept = {r.doc_id for r in lid.keep_identified(frame(rows), model).collect()}
    assert kept == {100 + r.doc_id for r in clean}


def test_mixed_text_has_spans(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 600")
    own = {r.lang: r.text[:500] for r in docs.collect() if r.lang in ("en", "de")}
    text = own["en"] + " " + own["de"]
    row = lid.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [s.lang for s in row.spans] == ["en", "de"]
    assert abs(row.spans[0].end - len(own["en"].encode())) < 40 and row.score < 0.75


def test_language_edges(spark, frame, model):
    rows = [(1, None), (2, ""), (3, "123 !? …"), (4, "the and of with"), (None, "the and"), (4, "the and of with"), (5, "日本")]
    got = lid.identify(frame(rows), model).collect()
    assert [r.lang_pred for r in got][:3] == ["und"] * 3 and len(got) == 7 and got[3].lang_pred == got[5].lang_pred == "en"
    assert got[6].lang_pred in model.languages
    assert {r.lang_pred for r in lid.identify(frame(rows), None).collect()} == {"und"}
    kept = lid.keep_identified(frame(rows), model)
    assert kept.columns == frame(rows).columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 4]
    assert lid.keep_identified(frame([]), model).count() == 0 and lid.identify(frame([]), model).count() == 0
    assert lid.learn(frame([])) is None


def test_scripts_narrow_candidates(spark):
    texts = {"ru": "привет мир это текст", "el": "καλημέρα κόσμε αυτό", "en": "hello world this text"}
    docs = spark.createDataFrame([(k, texts[lang], lang) for k, lang in enumerate(list(texts) * 5)], "doc_id long, text string, lang string")
    made = lid.learn(docs)
    got = lid.identify(spark.createDataFrame([(1, "слово"), (2, "λέξη"), (3, "word")], "doc_id long, text string"), made).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)] == ["ru", "el", "en"]


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def parts_of(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[n:]
    m = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n]), path[:m]


def test_rules(spark):
    rng = random.Random(8)
    hosts, paths = ["a.example.com", "EXAMPLE.com", "example.net", "net", "xnet", "b.org", "com", "É.com", ""], ["", "/", "/en/", "/en/71", "/en", "/de/8", "/de/x", "/es/1", "/fr/en/"]
    urls = [None, "", "no scheme", "://", "http://a.com", "x?u=https://example.com/en/7"] + [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#/es/', '?a#b'])}" for _ in range(300)]
    df = spark.createDataFrame([(k, u, "h", "p", "r", 1.0) for k, u in enumerate(urls)], "page_id long, url string, host string, path string, rule string, score double")
    got = {r.page_id: r for r in uf.url_filter(df, None).collect()}
    for k, u in enumerate(urls):
        host, path = parts_of(u)
        rule, verdict = rule_of(host, path)
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, rule, verdict or "allow"), u
    assert uf.url_filter(df.limit(0), None).count() == 0


def test_verdicts_of_the_contract(spark):
    """The contract's own words, not the code's list: each rule, its subdomains, and its longer exception."""
    assert set(uf.RULES) == {("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")}
    want = {
        "http://a.com/en/6": ("com/en/", "block"),
        "http://b.example.com/en/6": ("com/en/", "block"),
        "http://b.example.com/en/71": ("example.com/en/7", "allow"),
        "http://a.net/de/8": ("net/de/", "allow"),
        "http://b.example.net/de/7": ("net/de/", "allow"),
        "http://b.example.net/de/81": ("example.net/de/8", "block"),
        "http://a.org/es/1": ("org/es/", "block"),
    }
    pages = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    assert {list(want)[r.page_id]: (r.rule, r.verdict) for r in uf.url_filter(pages, None).collect()} == want


def test_models_tell_urls_apart(spark):
    rng = random.Random(5)
    good = [f"https://docs{rng.randint(1, 99)}.site.org/guide/{rng.randint(1, 999)}" for _ in range(300)]
    bad = [f"https://win-cash{rng.randint(1, 99)}.site.org/promo/{rng.randint(1, 999)}" for _ in range(1500)]
    labelled = spark.createDataFrame([(u, "allow") for u in good] + [(u, "block") for u in bad] + [(None, "allow"), ("x", None)], "url string, verdict string")
    model = uf.learn(labelled)
    seen = spark.createDataFrame([(1, "https://docs7.site.org/guide/1000", "x"), (2, "https://win-cash8.site.org/promo/1000", "x"), (3, None, "x")], "page_id long, url string, score string")
    got = {r.page_id: r for r in uf.url_filter(seen, model, ()).collect()}
    assert (got[1].verdict, got[2].verdict) == ("allow", "block") and got[1].score > 0.05 > -0.05 > got[2].score
    slots = list(uf.contexts(b"abc"))
    below = model.common.probabilities(slots, 1 / 256)
    assert len(below) == 4 and ((below > 0) & (below <= 1)).all() and math.isfinite(model.score(""))
    assert uf.learn(labelled.where("verdict = 'allow'")) is None


def test_counts_are_exact_at_any_size(spark):
    rng = random.Random(9)
    rows = [("".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789é") for _ in range(60)), rng.choice(["allow", "block"])) for _ in range(3000)]
    model = uf.fitted(spark.createDataFrame(rows, "url string, verdict string"), uf.MOST_GRAMS)
    models = {"allow": model.allow, "block": model.block, "all": model.common}
    counts = {v: [Counter() for _ in range(uf.ORDER + 1)] for v in ("allow", "block", "all")}
    for url, verdict in rows:
        data = b"\x02" * uf.ORDER + url.encode() + b"\x03"
        for at in range(uf.ORDER, len(data)):
            for k in range(uf.ORDER + 1):
                counts[verdict][k][data[at - k : at + 1]] += 1
                counts["all"][k][data[at - k : at + 1]] += 1
    assert len(counts["all"][5]) > 2 * 65536
    for verdict, want in counts.items():
        for k, (full, context) in enumerate(zip(models[verdict].full, models[verdict].context, strict=True)):
            assert dict(zip(*map(list, full), strict=True)) == {int.from_bytes(g): n for g, n in want[k].items()}
            kinds, total = Counter(g[:-1] for g in want[k]), Counter()
            for g, n in want[k].items():
                total[g[:-1]] += n
            assert {c: (n, m) for c, n, m in zip(*map(list, context), strict=True)} == {int.from_bytes(c): (total[c], m) for c, m in kinds.items()}
    assert model.scores([rows[0][0], "", rows[1][0]]) == pytest.approx([model.score(rows[0][0]), model.score(""), model.score(rows[1][0])]) and model.scores([]) == []


def slow_scores(labelled):
    """A function that scores a URL, from (url, verdict) pairs, context by context."""
    counts = {v: {} for v in ("allow", "block", "all")}
    for url, verdict in labelled:
        data = b"\x02" * uf.ORDER + url.encode() + b"\x03"
        for at in range(uf.ORDER, len(data)):
            for k in range(uf.ORDER + 1):
                for v in (verdict, "all"):
                    counts[v].setdefault(data[at - k : at], Counter())[data[at]] += 1

    def probability(data, at, verdict):
        p = 1 / 256
        for v, k in [("all", k) for k in range(uf.ORDER + 1)] + [(verdict, k) for k in range(uf.OWN_ORDER, uf.ORDER + 1)]:
            seen = counts[v].get(data[at - k : at])
            if seen:
                p = (seen[data[at]] + len(seen) * p) / (sum(seen.values()) + len(seen))
        return p

    def score(url):
        data = b"\x02" * uf.ORDER + (url or "").encode() + b"\x03"
        logs = [math.log(probability(data, at, "allow")) - math.log(probability(data, at, "block")) for at in range(uf.ORDER, len(data))]
        return sum(logs) / len(logs)

    return score


def slow_threshold(scored):
    """The threshold of (score, verdict) pairs: the best mean share judged right, nearest to 0."""
    best = []
    for t in range(-1000, 1002):
        right = [[(math.floor(s / uf.STEPS) >= t) == (v == "allow") for s, v in scored if v == verdict] for verdict in ("allow", "block")]
        best.append((-round(sum(sum(r) / len(r) for r in right), 12), abs(t), t))
    return min(best)[2] * uf.STEPS


@pytest.mark.parametrize("most_grams", [uf.MOST_GRAMS, 0])
def test_url_query_by_brute_force(spark, most_grams):
    """Every row of the query: rules, probabilities, threshold and verdicts, of a gathered model and of one that stays a table."""
    sf = "/root/testdata/sf0.01"
    got = uf.op8_url_filter(spark, sf, most_grams).collect()
    pages = spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id", "url", f"pmod(xxhash64(url), 1000) < {int(1000 * uf.CALIBRATION_SHARE)} as held").collect()
    urls = {r.page_id: r.url for r in pages}
    labelled = [(r.url, rule_of(*parts_of(r.url))[1], r.held) for r in pages if rule_of(*parts_of(r.url))[1]]
    score = slow_scores([(u, v) for u, v, held in labelled if not held])
    threshold = slow_threshold([(score(u), v) for u, v, held in labelled if held])
    assert len(got) == len(urls) and {v for _, v, held in labelled if held} == {"allow", "block"}
    for r in got:
        rule, verdict = rule_of(*parts_of(urls[r.page_id]))
        assert (r.host, r.path) == parts_of(urls[r.page_id]) and r.rule == rule and r.score == pytest.approx(score(urls[r.page_id]))
        assert r.verdict == (verdict or ("allow" if r.score >= threshold else "block"))


def test_held_out_urls_are_judged_right(spark):
    """A model of half of the URLs that rules judge, asked for the other half without rules."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    host, path = uf.host_and_path(F.col("url"))
    labelled = pages.select("page_id", "url", host.alias("host"), path.alias("path")).select("page_id", "url", uf.rule_and_verdict(F.col("host"), F.col("path"))[1].alias("label")).where("label is not null")
    model = uf.learn(labelled.where("page_id % 2 = 0").withColumnRenamed("label", "verdict"))
    judged = uf.url_filter(labelled.where("page_id % 2 = 1"), model, ()).join(labelled.select("page_id", "label"), "page_id").collect()
    shares = [sum(r.verdict == r.label for r in judged if r.label == v) / sum(r.label == v for r in judged) for v in ("allow", "block")]
    assert sum(shares) / 2 > 0.8


def test_long_and_repeated_urls(spark):
    urls = ["http://a.com/" + "x/é" * 300_000, "http://a.com/y", "http://a.com/y", "http://", ""]
    labelled = spark.createDataFrame([(f"http://{v}{k}.org/{k}", v) for k in range(40) for v in ("allow", "block")], "url string, verdict string")
    df = spark.createDataFrame([(k // 2, u, "z") for k, u in enumerate(urls)], "page_id long, url string, gram string")
    got = uf.url_filter(df, uf.learn(labelled)).collect()
    assert len(got) == 5 and len({(r.verdict, r.score) for r in got if r.path == "/y"}) == 1
    assert [len(r.path) for r in got if r.page_id == 0 and len(r.path) > 9] == [900_001]
