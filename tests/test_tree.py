"""The prefix tree against one regular expression for each template."""

import random
import re

from tessera.functions.text import space_tokens, tokens
from tessera.operators import tree

SPLIT = r"[ ,!;:=|\"'\[\](){}.\-+@#$%&]"


def message(line):
    bare = ["<*>" if "<*>" in t else re.sub(r"[!-'*-/:;<>?@\[-`{}~]", "", t.strip()) for t in re.split(f"(?<={SPLIT})|(?={SPLIT})", line)]
    kept = [t for t in bare if t]
    return [t for i, t in enumerate(kept) if t != "<*>" or i == 0 or kept[i - 1] != "<*>"]


def expected(lines, templates, split):
    """For each line its best template and parameters, or the relevant templates."""
    known = {}
    for t in templates:
        words = split(t)
        if words:
            parts = ["".join(f"{re.escape(w)}\x01" for w in p.split("\x01") if w) for p in re.sub("<[*]>(?:\x01<[*]>)+", "<*>", "\x01".join(words)).split("<*>")]
            known[t] = (parts, -sum(w != "<*>" for w in words), words.count("<*>"))
    out = set()
    for i, line in lines:
        words = split(line or "")
        text = "".join(f"{w}\x01" for w in words)
        if not words:
            continue
        hits, nodes = [], {}
        for t, (parts, c, w) in known.items():
            m = re.fullmatch("((?:[^\x01]+\x01)*?)".join(parts), text)
            if m:
                hits.append((c, w, t, tuple(g.replace("\x01", "") for g in m.groups())))
            for k in range(1, len(parts)):
                if re.match("(?:[^\x01]+\x01)*?".join(parts[:k]), text):
                    nodes.setdefault(tuple(parts[:k]), set())
        for t, (parts, _, _) in known.items():
            for k in range(1, len(parts)):
                if tuple(parts[:k]) in nodes:
                    nodes[tuple(parts[:k])].add(t)
        if hits:
            _, _, t, params = min(hits)
            out.add((i, t, True, params))
        else:
            ended = [n for n in nodes if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in nodes)]
            out |= {(i, t, False, None) for n in ended for t in nodes[n]}
    return out


def rows_of(found):
    return {(r.line_id, r.template, r.matched, None if r.params is None else tuple(r.params)) for r in found.collect()}


def test_tree_against_patterns(spark):
    rng = random.Random(12)
    for tokenise, split in ((tokens, str.split), (None, message)):
        words = ["a", "b", "c", "a.b"] if tokenise is None else ["a", "b", "c", "a*"]
        templates = list({" ".join(rng.choice([*words, "<*>"]) for _ in range(rng.randint(1, 7))) for _ in range(90)})
        templates = [t for t in templates if len([w for w in t.split() if w != "<*>"]) > 1] + ["", None, "a"]
        lines = [(k, " ".join(rng.choice([*words, "d"]) for _ in range(rng.randint(0, 9)))) for k in range(250)] + [(-1, None), (-2, "a"), (-3, "a  b")]
        options = {} if tokenise is None else {"tokenise": tokenise}
        found = rows_of(tree.match_tree(spark.createDataFrame(lines, "line_id long, content string"), spark.createDataFrame([(t,) for t in templates], "template string"), **options))
        assert found == expected(lines, [t for t in templates if t], split)
        assert len({m for _, _, m, _ in found}) == 2


def test_words_under_a_wildcard(spark):
    lines = spark.createDataFrame([(1, "user bob smith logged in"), (2, "user logged in"), (3, "user bob logged out"), (4, "nothing"), (5, "x x x end")], "line_id long, content string")
    known = spark.createDataFrame([("user <*> logged in",), ("user <*> left",), ("x <*> x end",), ("x <*> x <*>",)], "template string")
    assert rows_of(tree.match_tree(lines, known)) == {(1, "user <*> logged in", True, ("bobsmith",)), (2, "user <*> logged in", True, ("",)), (3, "user <*> logged in", False, None), (3, "user <*> left", False, None), (5, "x <*> x end", True, ("x",))}
    empty = known.limit(0)
    assert tree.match_tree(lines, empty).count() == 0 and tree.match_tree(lines.limit(0), known).count() == 0
    single = tree.template_tree(spark.createDataFrame([("a b",), ("a <*> b <*> c",)], "template string"), space_tokens)
    assert single.depth == 2 and single.longest == 1
