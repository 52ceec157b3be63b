"""Operators 1, 2, 3 and 7 against step-by-step versions."""

import base64
import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe, fingerprints, license_scan, packing
from tessera.llm.kernels import FOLDED_VALUE, PLAIN, Words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
BYTE_JSON, MULTI = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


def notices_in(words, threshold=license_scan.THRESHOLD):
    """{label: largest containment}, by all windows of all notices."""
    best = {}
    for notice, label in license_scan.NOTICES.items():
        own, reach = set(notice.split()), math.floor(len(notice.split()) / threshold + 1e-9)
        if len(own & set(words)) >= threshold * len(own) - 1e-9:
            share = max(len(own & set(words[k : k + reach])) for k in range(len(words))) / len(own)
            if share >= threshold - 1e-9:
                best[label] = max(share, best.get(label, 0))
    return best


def altered(rng, words):
    """A notice with words dropped, put in, repeated and moved."""
    words = list(words)
    for _ in range(rng.randint(0, max(1, len(words) // 6))):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice([[], [words[k], "filler"], [words[k]] * 2, [rng.choice(words)]])
        words = words or ["x"]
    return words


def test_license_scan(documents, frame):
    rng = random.Random(4)
    lines = ["Licensed under the Apache License, Version 2.0.", "under MIT\nLicense mit license MIT-License", "GNU General\n\nPublic   License", "ccby cc by CC-BY", "mit licenses", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "xmit license é", "cc", "by", "all rights reserved " * 3]
    for notice in license_scan.NOTICES:
        for _ in range(12):
            words = [w.upper() if rng.random() < 0.2 else w for w in altered(rng, notice.split())]
            around = [rng.choice(["the", "license", "of", "z1", "software"]) for _ in range(30)]
            lines.append("".join(w + rng.choice([" ", "\n", ", ", " * "]) for w in around + words + around))
    rows = documents + [(20_000 + k, t) for k, t in enumerate(lines)]
    got = {r.doc_id: r for r in license_scan.license_scan(frame(rows)).collect()}
    assert len(got) == len(rows)
    seen = Counter()
    for i, t in rows:
        words = WORD.findall((t or "").translate(LOWER))
        places = sorted((k, label) for phrase, label in license_scan.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
        blocks, r = notices_in(words), got[i]
        seen.update(blocks)
        assert (r.n_words, r.n_base, r.base_labels, r.labels) == (len(words), len(places), ",".join(sorted({x for _, x in places})), ",".join(sorted({x for _, x in places} | set(blocks)))), t
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.score == pytest.approx(1 if places else max(blocks.values(), default=0))
        assert all(n.containment == pytest.approx(len(set(WORD.findall(t.encode()[n.start : n.end].decode().translate(LOWER))) & own) / len(own)) for n in r.notices for own in [max((set(x.split()) for x, label in license_scan.NOTICES.items() if label == n.label), key=lambda s: len(s & set(WORD.findall(t.encode()[n.start : n.end].decode().translate(LOWER)))) / len(s))])
    assert set(seen) == set(license_scan.NOTICES.values()) and 0.3 < seen["mit-full"] / 12 <= 1
    assert license_scan.license_scan(frame([])).count() == 0


def test_license_notices_do_not_depend_on_line_breaks(frame):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that"
    filler = " ".join(f"w{k}" for k in range(100))
    scattered = f"all {filler} rights {filler} reserved {filler} licensed under cc by {filler} sa 4 0"
    texts = [mit, bsd, scattered, f"{filler} All Rights Reserved {filler}", f"{filler} licensed under the Apache License, Version 2.0 {filler}", f"all rights\n{filler}\nreserved"]
    got = [r for r in sorted(license_scan.license_scan(frame(enumerate(texts))).collect(), key=lambda r: r.doc_id)]
    assert [r.labels for r in got] == ["mit-notice", "bsd-notice", "cc-by", "reserved-notice", "apache,apache-notice", ""]
    assert [(n.containment, mit[n.start : n.end]) for n in got[0].notices] == [(1.0, mit[: mit.index(" and associated")])]


def test_license_scan_of_long_lines_is_linear():
    plain = license_scan.templates()
    vocabulary = license_scan.Vocabulary({w for t in plain for w in t.words})
    index = license_scan.Index([t.prepared({}, 0.9) for t in plain], vocabulary)
    full = next(n for n, label in license_scan.NOTICES.items() if label == "mit-full")
    for text in ("apache " * 3_000_000, "mit license the of software " * 700_000, full + " "):
        data = np.frombuffer((text + full).encode(), np.uint8)
        began = time.perf_counter()
        found = index.scan(data, Words(data, np.array([0, len(data)]), PLAIN, FOLDED_VALUE))
        assert "mit-full" in {f.template.label for f in found} and time.perf_counter() - began < 60


def test_license_prefix_filter_is_exact():
    rng = random.Random(1)
    for t in [t.prepared({}, 0.6) for t in license_scan.templates()]:
        for _ in range(50):
            block = set(rng.sample(t.rare, rng.randint(0, len(t.rare))))
            if len(block) >= t.needed:
                assert block & set(t.rare[: t.prefix])


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(BYTE_JSON)
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_tokens_are_the_librarys(tokenizer):
    encode, rng = packing.tokens(BYTE_JSON), random.Random(2)
    texts = ["", "  \n\n x", "don't 12345  　x", "a" * 3000, "<|endoftext|> a", "a <|endoftext|> b", "<|endoftext|><|endoftext|>x <|endoftext", "a \x1c b", "\x00"] + ["".join(rng.choice("ab 'sdmtl\n\té日1２!?　_-  ") for _ in range(30)) for _ in range(2000)]
    texts += [x * 2_000_000 for x in (" ", "\n", "a")] + ["\n" * 1_500_000 + "a", "<|endoftext|>" + " " * 49_999 + "x"]
    ranks, added = packing.ranks_of(BYTE_JSON)
    assert added == {"<|endoftext|>": 50256}
    for token in ranks:
        try:
            texts.append(token.decode())
        except UnicodeDecodeError:
            continue
    assert all(encode(x) == struct.pack(f"<{len(i)}I", *i) for x in texts for i in [tokenizer(x)])
    assert packing.ranks_of(P.path("word_bpe_49k.json")) is None


def test_white_space_costs_one_pass(tokenizer):
    """Many runs just too short for the other library: the search for longer ones looks at each character once."""
    encode = packing.tokens(BYTE_JSON)
    for run, times in ((" " * 49_999, 40), ("\n" * 40_000, 50), ("\t" * 100, 20_000), (" \n" * 12_000, 80)):
        text = "x".join([run] * times)
        began = time.perf_counter()
        assert not packing.LONG_RUN.search(text)
        assert time.perf_counter() - began < 1
        assert encode(text[: 2 * len(run) + 1]) == struct.pack(f"<{len(i := tokenizer(text[: 2 * len(run) + 1]))}I", *i)
    assert packing.LONG_RUN.search("x" + " " * 50_000) and packing.LONG_RUN.search("\n" * 60_000)


def test_packing(spark, documents, frame, tokenizer):
    rows = documents + [(30_000, "again"), (30_000, "again"), (30_001, "a <|endoftext|> b"), (30_002, " " * 1_200_000)]
    got = packing.best_fit_packing(frame(rows), BYTE_JSON, 256).toPandas()
    want = Counter()
    for i, t in rows:
        ids = [*tokenizer(t or ""), 2]
        first = len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids) + 1, 256)] if len(ids) > 256 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += 1
    assert Counter(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, s in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert list(s.offset) == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 256
    assert got.sequence_id.nunique() <= 1.02 * got.length.sum() / 256 + 2
    assert packing.best_fit_packing(frame([]), BYTE_JSON).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=12))
def test_plan(histogram):
    used, ranks = {}, {}
    for length, first, end, sequence, offset in packing.plan_slots(histogram, 32):
        assert ranks.get(length, 0) == first < end
        ranks[length] = end
        for k in range(end - first):
            used.setdefault(sequence + k, []).append((offset, length))
    assert ranks == histogram
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 32
    free = []  # best fit, item by item
    for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        room = min((r for r in free if r >= length), default=None)
        if room is None:
            free.append(32 - length)
        else:
            free[free.index(room)] -= length
    assert len(used) == len(free)


@pytest.mark.parametrize("limits", [(400_000, 16 << 20, 256), (50, 1 << 20, 4), (1000, 300, 256)])
def test_byte_bpe(spark, documents, frame, monkeypatch, limits):
    for name, value in zip(("CACHE_ENTRIES", "CACHE_BYTES", "CACHE_LONGEST"), limits):
        monkeypatch.setattr(bpe, name, value)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    plain = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    rows = documents + [(40_000 + k, "".join(rng.choice("ab 'sdmtl\n\té日1２!?　▁<unk>") for _ in range(60))) for k in range(300)] + [(41_000, "ab" * 20_000), (41_001, " " * 30_000 + "x"), (41_002, None)]
    digests = {r.doc_id: r for r in bpe.encode_digests(frame(rows), MULTI).collect()}
    ids = {r.doc_id: r for r in bpe.encode_decode(frame(rows), MULTI).collect()}
    for i, t in rows:
        want = plain.encode_ordinary(t or "")
        assert ids[i].ids == want and bytes(ids[i].decoded).decode() == (t or "")
        assert digests[i].n_tokens == len(want)
        assert digests[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_digests(frame([]), MULTI).count() == 0


def test_byte_bpe_merges_every_token():
    c = bpe.codec(MULTI, P.PATTERN)
    tokens = [t for t in bpe.load_ranks(MULTI) if b"\xef\xbf\xbd" not in t]
    pieces = []
    for t in tokens:
        try:
            pieces.append(t.decode())
        except UnicodeDecodeError:
            continue
    assert all(c.decode(i).decode() == x for x, i in zip(pieces, c.encode_pieces(pieces), strict=True))
    with pytest.raises(ValueError):
        bpe.serialise_model({b"a": 0, b"b": 2})


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_fingerprints(documents, frame, parts):
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(frame(documents), parts=parts).collect()}
    order = sorted(documents, reverse=True, key=lambda r: r[0])
    seen = {}
    for k, (i, t) in enumerate(order):
        t, (j, u) = t or "", order[(k + 1) % len(order)]
        cut = len(t) // 3
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256((t[: len(t) - cut] + (u or "")[:cut]).encode()).hexdigest())
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint
        values = [[f[x : x + 8] for x in range(0, len(f), 8)] for f in (r.fingerprint, got[j].fingerprint, r.edited_fingerprint)]
        assert r.near_next == pytest.approx(sum(a == b for a, b in zip(values[0], values[1])) / 128) and r.near_edited == pytest.approx(sum(a == b for a, b in zip(values[0], values[2])) / 128)
    assert len(got) == len(documents)


def test_fingerprint_edges(frame):
    one = fingerprints.edited_fingerprints(frame([(5, "abcdefghi")])).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdefabc").hexdigest()
    assert fingerprints.edited_fingerprints(frame([])).count() == 0
    same = fingerprints.edited_fingerprints(frame([(1, "a b c d e f"), (1, "a b c d e f"), (None, None)])).collect()
    assert len(same) == 3
    lone = fingerprints.edited_fingerprints(frame([(k if k % 3 else None, f"text {k} " * 9) for k in range(60)] + [(-(1 << 63), "least"), (None, None), (None, "")]), parts=5).collect()
    texts, edited = [f"text {k} " * 9 for k in range(60)] + ["least", "", ""], {r.edited_sha256 for r in lone}
    ids = [k for k in reversed(range(60)) if k % 3]
    assert len(lone) == 63 and all(hashlib.sha256((texts[a][: len(texts[a]) - len(texts[a]) // 3] + texts[b][: len(texts[a]) // 3]).encode()).hexdigest() in edited for a, b in zip(ids, [*ids[1:], 60]))


def test_signatures_are_minima_of_permutations(documents, frame):
    """Every value by a loop over all permutations and shingles, with the parameters and shingle hashes of the operator."""
    from tessera.llm.minhash import MinHash, shingle_runs

    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(frame(documents)).collect()}
    a, b = (x.tolist() for x in MinHash(fingerprints.SIZE, seed=7).parameters())
    for i, t in documents[:12] + documents[-10:]:
        hashes = [int(h) >> 32 for _, _, shingles, _ in shingle_runs(pa.array([t]), 5) for h in shingles]
        want = [min(((h * x + y) % (1 << 32) for h in hashes), default=(1 << 32) - 1) for x, y in zip(a, b)] if len(hashes) < 5000 else None
        assert want is None or got[i] == "".join(f"{v:08x}" for v in want)


def test_fingerprint_links(documents, frame):
    got = {r.doc_id: r for r in fingerprints.fingerprint_links(frame(documents)).collect()}
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in documents if (w := WORD.findall((t or "").translate(LOWER)))}
    for i, a in shingles.items():
        near = [j for j, b in shingles.items() if i != j and len(a & b) / len(a | b) >= 0.8]
        assert got[i].n_links == len(near) and got[i].component_id <= min([i, *near])
        assert got[i].class_id == min(j for j, b in shingles.items() if b == a)
    assert len(got) == len(documents)
