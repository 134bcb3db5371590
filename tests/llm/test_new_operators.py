"""Licence scans, vector codes and the conversation trie: brute force, ties, nulls, empty tables, clashing names, hot groups."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromalith.llm import conversation_trie, license_rules, licenses, vector_codes

# ---- licences ----
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LINES = [
    "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3 or later",
    "Released under the MIT License.",
    "Licensed under CC BY-NC 4.0.",
    "SPDX-License-Identifier: BSD-3-Clause",
    "GNU Lesser General Public License v2.1",
    "gnu general public license gnu general public license",
    "mit, license; MIT\nlicense mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
]


def brute_scan(text):
    """All matches of all rules at every word, without anchors, keywords or windows; survivors by comparing all pairs."""
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    found = []
    for k in range(len(words)):
        rest = " " + " ".join(words[k:]) + " "
        for r in license_rules.RULES:
            if m := re.match(f" (?:{r.regex}) ", rest):
                found.append((k, k + m[0].count(" ") - 2, r.priority, r.number, r.label, r.base))
    kept = [x for x in found if x[5] or not any(y[0] <= x[0] and y[1] >= x[1] and y[2] >= x[2] and (y[:2] != x[:2] or y[2] > x[2] or y[3] < x[3]) for y in found)]
    return len(words), sorted(found), sorted(kept)


def test_licenses_brute_force(spark):
    r = random.Random(1)
    filler = "the of İstanbul license licensed under gnu mit apache version 2 0 cc by sa K and é ß".split()
    texts = [None, "", " \n\t", "?!", "MİT license", *LINES, " ".join(LINES), ("MIT License. " * 700) + "GPL v2"]
    texts += [" ".join(r.choice([r.choice(filler), r.choice(LINES)]) for _ in range(r.randrange(60))) for _ in range(40)]
    rows = [(None if i == 3 else i, t, "x", 1) for i, t in enumerate(texts)] + [(5, LINES[0], "x", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string, words int")
    key = lambda x: (x is None, x)
    got = sorted(licenses.scan(docs).collect(), key=lambda x: (key(x.doc_id), x.n_words))
    want = sorted(((i, *brute_scan(t)) for i, t, *_ in rows), key=lambda x: (key(x[0]), x[1]))
    assert len(got) == len(rows)
    for g, (i, n, found, kept) in zip(got, want, strict=True):
        flat = lambda ms: sorted((m.first_word, m.last_word, m.priority, m.rule, m.label, m.base) for m in ms)
        assert (g.doc_id, g.n_words, flat(g.found), flat(g.detections)) == (i, n, found, kept)
    shown = {x.doc_id: x for x in licenses.labels(docs).collect()}
    assert shown[0].n_words == shown[0].n_base == 0 and shown[0].labels == shown[0].base_labels == "" and shown[0].score == 0 and shown[0].first_word is None
    assert shown[4].base_labels == ""  # only A-Z are lower-cased
    apache = shown[5]
    assert (apache.base_labels, apache.labels, apache.n_base, apache.first_word, apache.last_word) == ("apache", "apache,apache-2.0", 1, 3, 3)
    assert licenses.labels(docs.filter("false")).count() == 0


def test_license_rules_fit_the_window_and_the_keyword():
    """No signature can match more words than a window has; there are hundreds of rules, and keywords are in what they match."""
    import re._parser as parser

    def spaces(tree):
        n = 0
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                n += arg == 32
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                inside = spaces(arg[2])
                assert arg[1] < 50 or not inside
                n += inside and arg[1] * inside
            elif name == "SUBPATTERN":
                n += spaces(arg[-1])
            elif name == "BRANCH":
                n += max(spaces(b) for b in arg[1])
        return n

    assert len(license_rules.RULES) > 200
    assert max(spaces(parser.parse(r.regex)) + 1 for r in license_rules.RULES) <= license_rules.WINDOW
    with pytest.raises(ValueError, match="plain words"):
        license_rules.make_rule(0, "x", 1, "[a-z]+ license")


# ---- vector codes ----
def brute_codes(rows, parts=8, entries=16, rounds=6):
    """Plain iteration in Python numbers over rows (vec_id, vector)."""
    ok = [(i, [int(np.floor(4096 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ok.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    w = len(ok[0][1]) // parts
    ok = [x for x in ok if len(x[1]) == w * parts]
    books = [[v[p * w : p * w + w] for _, v in ok[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))

    for n in range(rounds + 1):
        at = [[nearest(v[p * w : p * w + w], books[p]) for p in range(parts)] for _, v in ok]
        if n == rounds:
            break
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p * w : p * w + w] for (_, v), a in zip(ok, at, strict=True) if a[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((str(i), "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a)) for (i, _), a in zip(ok, at, strict=True)), digest


@pytest.mark.parametrize("n", [5, 150])
def test_vector_codes_brute_force(spark, n):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(12, 16))
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 12] + rng.normal(size=16) * 0.05]) for i in range(n)]
    rows += [(1000, None), (1001, [1.0] * 15 + [None]), (1002, [float("nan")] * 16), (1003, [float("inf")] * 16), (1004, [-float("inf")] * 16), (1005, [1.0] * 8), (1006, []), (None, [0.5] * 16)]
    rows += [(2000, [0.25] * 16)] * 40  # one vector has a fifth of all rows
    rows += [(3, rows[3][1])] * 2
    rng.shuffle(rows := list(rows))
    data = [(i, v, None if (i or 0) % 3 == 0 else (i or 0) % 3, "x", 0) for i, v in rows]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, code string, x int").repartition(3)
    got = vector_codes.code_table(df).collect()
    want, digest = brute_codes(rows)
    assert sorted((str(x.vec_id), x.code, x.error) for x in got) == want
    assert {x.codebooks_sha256 for x in got} == {digest}
    by = defaultdict(int)
    for x in got:
        by[None if (x.vec_id or 0) % 3 == 0 else (x.vec_id or 0) % 3] += x.error
    assert all(x.label_error == by[None if (x.vec_id or 0) % 3 == 0 else (x.vec_id or 0) % 3] for x in got)


def test_vector_codes_prune_and_edges(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(16, 16)) * 4
    rows = [(i, (centres[i % 16] + rng.normal(size=16) * 0.01).tolist(), 0) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = vector_codes.encode(df)
    assert found.rows.agg(F.sum("tried")).first()[0] < 400 * 8 * 16 * 7 / 4  # of all distances of seven passes
    assert vector_codes.code_table(df.filter("false")).count() == 0
    assert vector_codes.code_table(df.withColumn("embedding", F.slice("embedding", 1, 13))).count() == 400  # filled up with zeros
    with pytest.raises(Exception, match="exceeds"):
        vector_codes.code_table(df.withColumn("embedding", F.transform("embedding", lambda x: x * 1e12))).count()


def test_integer_roots():
    d = np.array([0, 1, 2, 3, 4, 8, 9, 2**52 - 1, 2**60 - 1, (2**30 - 1) ** 2, (2**30 - 1) ** 2 - 1], np.int64)
    import math

    assert vector_codes.root(d).tolist() == [math.isqrt(int(x)) for x in d]
    assert vector_codes.root_up(d).tolist() == [math.isqrt(int(x) - 1) + 1 if x else 0 for x in d]


# ---- the trie ----
def brute_trie(rows, shared=True):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in by.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if shared else 0
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + ts[h:])
    nodes = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes[ts[:d]].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    out = []
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in nodes:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(nodes[p]) - 1) * words
    for p, cs in nodes.items():
        ends = ",".join(map(str, sorted(c for c in cs if built[c] == p)))
        out.append((min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string, digest string, part int"


def trie_rows(seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(-25, 90), 10**12, None]:
        for t in range(r.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, r.choice([t, t, t, None, 0]), r.choice(["user", "assistant", None, ""]), r.choice([None, "", "a", "a b", "Hi there", " x  y "])))
    rows += [(c, t, "user", f"turn {t}") for c in range(200, 260) for t in range(4)]  # alike
    rows += [(300, t, "user", "same" if t % 2 else f"t{t}") for t in range(400)]  # a third of all rows
    rows += rows[:5]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("piece", [4096, 3])
def test_trie_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(conversation_trie, "PIECE", piece)
    rows = trie_rows(piece)
    df = spark.createDataFrame([(*x, "d", 1) for x in rows], SCHEMA).repartition(5)
    got = sorted((tuple(x) for x in conversation_trie.shared_heads(df).collect()), key=str)
    assert got == brute_trie(rows)


def test_trie_as_it_is_and_empty(spark):
    rows = trie_rows(7)
    df = spark.createDataFrame([(*x, "d", 1) for x in rows], SCHEMA)
    assert sorted((tuple(x) for x in conversation_trie.prefix_trie(df).collect()), key=str) == brute_trie(rows, shared=False)
    assert conversation_trie.shared_heads(df.filter("false")).count() == 0
    assert conversation_trie.shared_heads(df.filter("conv_id is null")).count() == 0


def test_turnless_conversations_end_at_the_root(spark):
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "hello")]  # conversation 20 is absent
    df = spark.createDataFrame([(*x, "d", 1) for x in rows], SCHEMA)
    assert [tuple(x) for x in conversation_trie.shared_heads(df).collect()] == brute_trie(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
