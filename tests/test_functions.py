"""Tables of cases for the column functions, and loops that do the same thing step by step."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import answers, match, merge, normalize, similarity, text


def values(spark, rows, **columns):
    """Evaluate column expressions over rows of strings a, b, ..."""
    width = max(len(r) for r in rows)
    names = "abcdef"[:width]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + ", ".join(f"{n} string" for n in names))
    return df.orderBy("k").select(*[c.alias(n) for n, c in columns.items()]).collect()


def test_tokenisers(spark):
    a = F.col("a")
    rows = values(spark, [("  one  two\t3 ",), ("",), (None,), ("x=<*>, user (root): <*> <*> a.b",)], t=text.tokens(a), s=text.space_tokens(a), n=text.template_tokens(a), m=text.message_tokens(a))
    assert rows[0].t == ["one", "two", "3"]
    assert rows[0].n == ["one", "two\t3"]
    assert rows[0].s == ["", "", "one", "", "two\t3", ""]
    assert rows[1].t == rows[2].t == [] and rows[1].s == [""]
    assert rows[3].m == ["x", "=", "<*>", "user", "(", "root", ")", "<*>", "a", "b"]


def test_unicode_white_space(spark):
    row = values(spark, [("a b",)], plain=text.tokens(F.col("a")), wide=text.tokens(F.col("a"), True))[0]
    assert row.plain == ["a b"] and row.wide == ["a", "b"]


def test_masks_and_predicates(spark):
    a = F.col("a")
    cases = ["https://a.example.com/x", "10.1.2.3", "11:05 PM", "+4930123", "2024-02-30", "2024-13-01", "plain", "at 0x1Fz", "<*> - !", "<*>" * 51, "a b c", "a b 7"]
    rows = values(spark, [(c,) for c in cases], c=text.mask_common_parameters(a), h=text.mask_hex(a), g=text.is_too_general(a), v=text.is_valid_template(a), n=text.adaptive_sample_size(a), x=text.looks_variable(a))
    assert [r.c == "<*>" for r in rows] == [True] * 5 + [False] * 7
    assert rows[7].h == "at <*>z"
    assert [r.g for r in rows][8:11] == [True, True, False]
    assert [r.v for r in rows][9] is False and rows[8].v
    assert [r.n for r in rows][-2:] == [1, 3] and [r.x for r in rows][-2:] == [False, True]


def test_rich_words_and_retry_budget(spark):
    row = values(spark, [("a1-", "abc", "a b c d e", "a b c d e f")], rich=text.is_rich_word(F.col("a")), poor=text.is_rich_word(F.col("b")), one=text.retry_budget(F.array("c"), 3), two=text.retry_budget(F.array("d"), 3), short=text.retry_budget(F.array("a", "b"), 3))[0]
    assert (row.rich, row.poor, row.one, row.two, row.short) == (True, False, 1, 3, 1)


def test_markdown_table(spark):
    t = "see\n| a | b |\n|---|---|\n| 1 | x y |\n| 2 | |\nend"
    row = values(spark, [(t,)], n=F.size(text.markdown_tables(F.col("a"))), r=text.markdown_rows(text.markdown_tables(F.col("a"))[0]))[0]
    assert row.n == 1 and row.r == [["a", "b"], ["1", "x y"], ["2", ""]]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next_row(row, i, x, b)
    return row[-1]


def _next_row(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
    return out


def subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            best[i][j] = best[i - 1][j - 1] + 1 if x == y else max(best[i - 1][j], best[i][j - 1])
    return best[-1][-1]


def test_distances_against_loops(spark):
    rng = random.Random(3)
    rows = [(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 7))), " ".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))) for _ in range(60)]
    a, b = text.tokens(F.col("a")), text.tokens(F.col("b"))
    got = values(spark, rows, e=similarity.edit_distance(a, b), n=similarity.common_subsequence_length(a, b), s=similarity.common_subsequence(a, b), r=similarity.common_run(a, b), p=similarity.common_prefix(F.col("a"), F.col("b")), j=similarity.jaccard(a, b))
    for (x, y), g in zip(rows, got, strict=True):
        u, v = x.split(), y.split()
        assert g.e == levenshtein(u, v) and g.n == subsequence(u, v) == len(g.s)
        runs = [u[i:j] for i in range(len(u)) for j in range(i + 1, len(u) + 1) if any(v[k : k + j - i] == u[i:j] for k in range(len(v)))]
        assert len(g.r) == max(map(len, runs), default=0)
        n = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        assert g.p == x[:n]
        assert g.j == (len({*u} & {*v}) / len({*u} | {*v}) if u or v else 0.0)


def test_contrast_scores(spark):
    lines = F.array(*[text.tokens(F.lit(x)) for x in ("a b c", "a b d", "a x y")])
    row = values(spark, [("",)], p=similarity.pairwise(lines), s=similarity.contrast_score(lines, 0.6), f=similarity.contrast_score_anchor(lines, 0.6), m=similarity.contrast_score_mixed(lines, 0.6))[0]
    j = [0.5, 0.2, 0.2]
    assert row.p == pytest.approx(j)
    assert row.s == pytest.approx(0.6 * sum(j) / 3 + 0.4 * (0.3 + 0.3 + 0) / 3)
    assert row.f == pytest.approx(0.6 * 0.35 + 0.4 * 0.3) and row.m == pytest.approx(0.6 * 0.35 + 0.4 * 0.2)


def loop_chains(t):
    """The chain rules one replacement at a time."""
    v = "<*>"

    def until(old, new):
        nonlocal t
        while old in t:
            t = t.replace(old, new)

    until("<*>.<*>", v)
    until("<*><*>", v)
    for old, new in ((" #<*># ", " <*> "), (" #<*> ", " <*> "), ("<*>:<*>", v), ("<*>#<*>", v), ("<*>/<*>", v), ("<*>@<*>", v), ("<*>.<*>", v), (' "<*>" ', " <*> "), (" '<*>' ", " <*> "), ("<*><*>", v), (" <*>. ", " <*> "), (" <*>, ", " <*> "), ("<*>+<*>", v)):
        until(old, new)
    until("<*>##<*>", v)
    until("#<*>#", v)
    until("<*>-<*>", v)
    until(" <*> <*> ", " <*> ")
    while t.endswith(" <*> <*>"):
        t = t[:-4]
    while t.startswith("<*> <*> "):
        t = t[4:]
    until("<*>,<*>", v)
    until("(<*> <*>)", "(<*>)")
    until(" /<*> ", " <*> ")
    if t.endswith(" /<*>"):
        t = t[:-5] + " <*>"
    return t


def test_chains_against_loop(spark):
    rng = random.Random(5)
    parts = ["<*>", "<*>", " ", ".", ":", "#", "/", "@", '"', "'", "+", "-", ",", "(", ")", "a"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(1, 12))),) for _ in range(3000)]
    got = values(spark, rows, t=normalize.normalize_chains(F.col("a")))
    assert [g.t for g in got] == [loop_chains(r[0]) for r in rows]


def test_normalisation(spark):
    cases = {
        "User {name} at {{host}}": "User <*> at <*>", "took 15 ms": "took <*> ms", "addr 0x1fz": "addr <*>", "ip 10.0.0.1:80 up": "ip <*> up", "  a   b ": "a b", "a=<*> b=<*> c=<*> d= x": "a=<*> b=<*> c=<*> d=<*> x", "{x} {y}": "", "pre<*>post now": "<*> now",
    }
    got = values(spark, [(k,) for k in cases], t=normalize.from_answer(F.col("a")), again=normalize.from_answer(normalize.from_answer(F.col("a"))))
    assert [g.t for g in got] == list(cases.values())
    assert [g.again for g in got] == [g.t for g in got]


def test_legacy_normalisation(spark):
    got = values(spark, [("path /a/b/c ok True",), ("user Root 0x1f 12",)], t=normalize.normalize_legacy(F.col("a")))
    assert [g.t for g in got] == ["path <*> ok <*>", "user <*> 0x1f <*>"]


def test_matching(spark):
    a, b = F.col("a"), F.col("b")
    cases = [
        ("User 7 in", "User <*> in", True), ("User 7 out", "User <*> in", False), ("same", "same", True), ("a.b", "a?b", False), ("x  y 1", "x y <*>", True), ("q <abc> r", "q <abc> r", True), ("q zz r <*>", "q <abc> r <*>", True),
        ("", "<*>", False), ("a", "", False), ("k=1", "<*>", True), ("line x\nbreak 5", "line <*> 5", False), ("a b", "a  <*>", False), ("a  b", "a  <*>", True),
    ]
    got = values(spark, [c[:2] for c in cases], g=match.matches_guarded(a, b))
    assert [g.g for g in got] == [c[2] for c in cases]
    rows = values(spark, [("move a to b", "move <*> to <*>"), ("move a", "move a"), ("move a", "go <*>")], p=match.parameters(a, b), c=match.matches_with_constants(a, b), ab=match.is_abstract(a, b))
    assert [r.p for r in rows] == [["a", "b"], [], []] and [r.c for r in rows] == [True, True, False] and [r.ab for r in rows] == [True, True, False]


def test_merging(spark):
    a, b = F.col("a"), F.col("b")
    cases = [
        ("open /a/b1 now", "open /a/c2 now", "open /a/<*> now"), ("open file x now", "open file y now", None), ("same text", "same text", "same text"), ("one two", "one two three", None), ("call f() ok", "call g() ok", None), ("v A ok", "v B ok", "v <*> ok"), ("n a.b ok", "n c.d ok", None),
    ]
    got = values(spark, [c[:2] for c in cases], m=merge.merge_templates(a, b))
    assert [g.m for g in got] == [c[2] for c in cases]
    long = " ".join("abcdefghi")
    gates = values(spark, [("a x1 c", "a x2 c"), ("a x1 y1", "a x2 y2"), (f"{long} x1 y1", f"{long} x2 y2"), (f"{long} x y z", f"{long} p q r")], one=merge.may_merge(a, b), share=merge.may_merge_by_share(a, b), edits=merge.may_merge_by_distance(a, b))
    assert [g.one for g in gates] == [True, False, True, False] and [g.share for g in gates] == [False, False, True, False] and gates[0].edits
    tokens = values(spark, [("ab12cd", "ab9cd"), ("<*>", "x"), ("abc", "abd")], both=merge.merge_tokens(a, b), chars=merge.merge_tokens_by_character(a, b))
    assert [t.both for t in tokens] == ["ab<*>cd", "<*>", None] and tokens[0].chars == "ab<*>d"
    lists = values(spark, [("a <*> b <*> c", "a x b <*> c"), ("a b", "a c")], m=merge.merge_lists(text.tokens(a), text.tokens(b)))
    assert lists[0].m == ["a", "<*>", "c"] and lists[1].m is None


def test_answers(spark):
    answer = "LogTemplate[1]: `User {x} in`\nnoise\nLogTemplate: plain\nLog template[3]: `c`"
    row = values(spark, [(answer,)], p=answers.parse_answer(F.col("a")), f=answers.fill_in(answers.parse_answer(F.col("a")), F.array(*map(F.lit, "xyz"))), none=answers.fill_in(answers.parse_answer(F.lit("?")), F.array(F.lit("x"))))[0]
    assert [(p.idx, p.template) for p in row.p] == [(1, "User {x} in"), (-1, "plain"), (3, "c")]
    assert row.f == ["User {x} in", "User {x} in", "c"] and row.none == ["x"]
    lists = F.split(F.col("a"), ",")
    rows = values(spark, [("b,a,a",), ("a,b",), ("",)], m=answers.majority(lists), d=answers.is_diverse(lists), f=answers.first_template(lists))
    assert [r.m for r in rows] == ["a", "a", ""] and [r.d for r in rows] == [False, True, False] and rows[0].f == "b"


def test_request(spark):
    row = values(spark, [("one", "two")], r=answers.request(F.array("a", "b"), "no_advice", (("q", "t"),)))[0]
    assert [m.role for m in row.r] == ["system", "user", "assistant", "user"] and row.r[-1].content == "Log[1]: `one`\nLog[2]: `two`"
    with pytest.raises(ValueError):
        answers.request(F.array("a"), "other")


def test_stop_words_are_plain():
    assert len(set(text.STOP_WORDS)) == len(text.STOP_WORDS) and all(re.fullmatch("[A-Za-z]+", w) for w in text.STOP_WORDS)
