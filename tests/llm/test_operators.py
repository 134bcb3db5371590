"""The training-data operators: edge cases, brute force, exact round trips, held-out accuracy."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromalith.llm import bpe, chat, exact_dedup, line_dedup, mixing, ngram_join, quality, spotsigs, token_counts, toxicity
from chromalith.llm.components import connected_components

try:
    import public_tokenizers

    WORD, BYTE = map(public_tokenizers.path, ("word_bpe_49k.json", "byte_bpe_50k.json"))
except ImportError:
    WORD = BYTE = None
needs_vocab = pytest.mark.skipif(not WORD, reason="no vocabulary files")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, size int"
BLANK = re.compile(r"[\x20\x09-\x0D]+")


def corpus(spark, texts, sources=None):
    """Documents with columns whose names clash with those that operators use inside."""
    rows = [(i, t, "en", (sources or ["a"] * len(texts))[i], 0, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(n, seed=0, vocab=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocab)}" for _ in range(n)]


EDGE = [None, "", " \t\n", "a", "a b", "the", "x" * 5000, "Hé llo", "same text here today", "same text here today", " ".join(words(300))]


def test_merges_equal_a_plain_loop():
    """Lowest rank first, leftmost of equal ones, pairs looked up anew after each merge; few symbols, so many are equal and go stale."""
    rng = np.random.default_rng(7)
    for _ in range(300):
        pairs, made, plain = bpe.Ranks(), [], {}
        for rank in range(int(rng.integers(1, 30))):
            left, right = (int(x) for x in rng.integers(0, 4 + rank, 2))
            if (left, right) not in plain:
                pairs.add(left, right, len(made))
                plain[left, right] = len(made)
                made.append(4 + len(made))
        word = [int(x) for x in rng.integers(0, 4, int(rng.integers(1, 60)))]
        want = list(word)
        while ranked := [(plain[p], i) for i, p in enumerate(zip(want, want[1:], strict=False)) if p in plain]:
            rank, i = min(ranked)
            want[i : i + 2] = [made[rank]]
        assert bpe.merge_word(list(word), pairs, made) == want


@needs_vocab
def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    t.no_truncation()
    t.no_padding()
    r = random.Random(0)
    bits = ["a", "B", "Σ", "İ", "ß", " ", "\n", "'s", "9", "²", "é", "한", "😀", "<|endoftext|>", "\x00", "the", "\x1c"]
    texts = [*EDGE, *("".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(300))]
    got = {x.doc_id: x for x in bpe.encode_table(corpus(spark, texts), WORD, ids=True, decoded=True).collect()}
    for i, x in enumerate(texts):
        e = t.encode(x or "", add_special_tokens=False).ids
        d = t.decode(e, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids, got[i].decoded) == (len(e), e, d)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest() and got[i].decoded_sha256 == hashlib.sha256(d.encode()).hexdigest()


@pytest.mark.parametrize("batch_bytes", [1, 1 << 28])
def test_exact_dedup(spark, batch_bytes):
    texts = [*EDGE, "a ", "  a", "b", " b", "sametexthere today", *["hot text"] * 40]
    out = exact_dedup.exact_dedup(corpus(spark, texts).repartition(3), batch_bytes=batch_bytes).collect()
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[BLANK.sub("", t or "")].append(i)
    assert len(out) == len(texts)
    for r in out:
        norm = BLANK.sub("", texts[r.doc_id] or "")
        g = groups[norm]
        keep = min(g, key=lambda i: (-len(texts[i] or ""), i))
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(g), r.doc_id == keep, hashlib.sha256(norm.encode()).hexdigest())


def test_exact_dedup_checks_bytes_on_hits(spark):
    """A digest of one hex digit makes unequal texts collide; they are told apart by their bytes."""
    texts = [f"text {i % 30}" for i in range(90)]
    out = exact_dedup.exact_dedup(corpus(spark, texts), digest=lambda c: F.substring(F.md5(c), 1, 1)).collect()
    assert len(out) == 90 and all(r.group_size == 3 and r.keep_id == r.doc_id % 30 for r in out)


def test_exact_dedup_ties_and_empty(spark):
    rows = [(None, "x", "", "", 0, "", 0), (1, "x", "", "", 0, "", 0), (1, "x", "", "", 0, "", 0)]
    out = exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    assert len(out) == 3 and sum(r.kept for r in out) == 1 and all(r.keep_id is None for r in out)
    kept = exact_dedup.keep_first(corpus(spark, EDGE))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")] and kept.count() == 8
    assert exact_dedup.exact_dedup(corpus(spark, EDGE).limit(0)).count() == 0


def test_exact_dedup_state_is_small_on_disk(spark, monkeypatch):
    """Every state partition used to allocate about 4 MB ahead; after the query only what it returns and needs is left."""
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    left = []
    delete = exact_dedup.delete
    size = lambda path: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)
    monkeypatch.setattr(exact_dedup, "delete", lambda s, path: left.append(size(path.removeprefix("file://"))) or delete(s, path))
    try:
        assert exact_dedup.exact_dedup(corpus(spark, [f"text {i % 500}" for i in range(2000)])).filter("kept").count() == 500
        assert len(left) == 2 and sum(left) < 5_000_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", None) is None


@pytest.mark.parametrize("clash", ["_metadata", "_file", "_row", "file", "row", "doc", "key", "digest", "id", "text_sha256"])
def test_clashing_names_stay(spark, clash):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "ab", "y"), (3, "c", None)], f"doc_id long, text string, `{clash}` string")
    assert sorted(map(tuple, exact_dedup.keep_first(docs).collect())) == [(1, "a b", "x"), (3, "c", None)]
    if clash in ("_metadata", "_file", "doc", "key", "id"):
        both = mixing.mixed_documents(docs.withColumn("source", F.lit("s")).withColumn("size", F.lit(0)))
        assert both.columns == ["doc_id", "text", clash, "source", "size"] and both.count() == 3
        assert sorted(map(tuple, line_dedup.without_lines(docs).collect())) == [(1, "a b", "x"), (2, "ab", "y"), (3, "c", None)]
        assert len(ngram_join.keep_one(docs).collect()) == 3


def test_training_sample_is_bounded_and_labels_agree(spark):
    """Whole texts in hash order within both bounds; identifiers labelled both ways aren't learnt from, in any layout."""
    from chromalith.llm._train import training_sample

    docs = corpus(spark, ["x" * (10 + i) for i in range(60)] + ["y" * 900])
    labels = spark.createDataFrame([(i, i % 2) for i in range(61)] + [(5, 0), (6, 0), (6, 0), (7, None)], "doc_id long, toxic int")
    every = training_sample(docs, labels, "toxic", F.lit(True), 1000, 10_000, "doc_id", "text").collect()
    assert {r.text for r in every} == {"x" * (10 + i) for i in range(60) if i != 5} | {"y" * 900}
    for n, size in ((20, 10_000), (1000, 700), (1000, 300)):
        took = [sorted(map(tuple, training_sample(d, x, "toxic", F.lit(True), n, size, "doc_id", "text").collect())) for d, x in ((docs, labels), (docs.repartition(5), labels.orderBy(F.desc("toxic"))))]
        assert took[0] == took[1] and 0 < len(took[0]) <= n and sum(len(t) for _, t, _ in took[0]) <= size
        assert all(len(t) <= size / 10 for _, t, _ in took[0])
    assert training_sample(docs, labels.limit(0), "toxic", F.lit(True), 5, 500, "doc_id", "text").count() == 0


def test_quality_held_out(spark):
    r = random.Random(1)
    texts, y = [], []
    for i in range(400):
        w = words(60, i)
        bad = i % 4 == 0
        if bad:
            w = [w[0]] * 60 if r.random() < 0.5 else [x.upper() + "!!" for x in w]
        texts.append(" ".join(w))
        y.append(int(not bad))
    docs = corpus(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y)] + [(400, None), (999, 1)], "doc_id long, quality int")
    out = {x.doc_id: x for x in quality.classify(docs, labels).collect()}
    held = [i for i in range(400) if out[i].held_out]
    assert len(out) == 402 and 40 < len(held) < 120 and all(0 <= x.score <= 1 for x in out.values())
    assert sum(out[i].predicted == y[i] for i in held) / len(held) > 0.97
    assert out[400].score == out[401].score and quality.classify(docs.limit(0), labels).count() == 0
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {x.score for x in none} == {0.5}


def test_toxicity_held_out_and_spans(spark):
    texts, y = [], []
    for i in range(600):
        s = [" ".join(words(8, 10 * i + k)) for k in range(6)]
        bad = i % 5 == 0
        if bad:
            s[i % 6] = "é " + s[i % 6] + " vilefoo"
        texts.append(". ".join(s) + ".")
        y.append(int(bad))
    docs = corpus(spark, [*texts, None, "", "..."])
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    out = {x.doc_id: x for x in toxicity.classify(docs, labels).collect()}
    held = [i for i in range(600) if out[i].held_out]
    assert sum(out[i].predicted == y[i] for i in held) / len(held) > 0.97
    assert [out[i].score for i in (600, 601, 602)] == [0.0, 0.0, 0.0]
    for i in held:
        if y[i] and out[i].predicted:
            assert any("vilefoo" in texts[i][o.start : o.end] and texts[i][o.start : o.end].count(".") == 1 for o in out[i].offending)


def brute_lines(texts, percent=80):
    seen, gone = [], defaultdict(list)
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            w = {x for x in BLANK.split(line) if x}
            if w:
                if any(100 * len(w & v) >= percent * len(w | v) for v in seen):
                    gone[i].append(k)
                seen.append(w)
    return gone


def test_line_dedup(spark):
    r = random.Random(2)
    base = [words(r.randrange(1, 25), s, 60) for s in range(25)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(4):
            w = list(r.choice(base))
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = f"w{r.randrange(60)}"
            lines.append(" ".join(w))
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", " \n"]
    out = {x.doc_id: x for x in line_dedup.line_report(corpus(spark, texts)).collect()}
    want = brute_lines(texts)
    assert {i: x.removed for i, x in out.items() if x.removed} == dict(want) and len(out) == len(texts)
    clean = {x.doc_id: x.text for x in line_dedup.without_lines(corpus(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert clean[i] == (t if not want[i] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]))
    assert line_dedup.line_report(corpus(spark, texts).limit(0)).count() == 0


def test_line_dedup_long_texts_and_any_identifiers(spark):
    """The old keys held 2**20 lines and identifiers below 2**43, and none for null."""
    long = "\n" * (2**20 + 1) + "one two three four five"  # line 2**20 + 1, which was line 1 of the next document
    rows = [(5, long), (6, "own line here\nanother clean line\none two three four five"), (2**43 + 5, "own line here\nkept"), (None, "nulls come first\nagain"), (None, "nulls come first\nmore"), (9, "again\nnine"), (9, "more\nnine\nten")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(((x.doc_id, x.n_lines, list(x.removed)) for x in line_dedup.line_report(docs).collect()), key=str)
    assert got == sorted([(5, 2**20 + 2, []), (6, 3, [2]), (2**43 + 5, 2, [0]), (None, 2, []), (None, 2, [0]), (9, 2, [0]), (9, 3, [0, 1])], key=str)
    texts = {(x.doc_id, x.text) for x in line_dedup.without_lines(docs).collect()}
    assert texts == {(5, long), (6, "own line here\nanother clean line"), (2**43 + 5, "kept"), (None, "nulls come first\nagain"), (None, "more"), (9, "nine"), (9, "ten")}


def test_line_dedup_makes_few_pairs(spark, monkeypatch):
    """Lines over few words share prefix words with many others; only pairs that may match are made, and no link is lost.
    Equal sets of words are one class in any order."""
    base = [words(30 + 3 * (i % 20), i, 500) for i in range(600)]
    near = [[*w[:-1], "x"] for w in base[:40]]
    texts = [" ".join(w) for w in [*base, *near]] + ["\n".join(" ".join(w[::-1]) for w in base[50:60])]
    made, meet = [], line_dedup._meet

    def counted(*args):
        pairs = meet(*args)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(line_dedup, "_meet", counted)
    out = {x.doc_id: x.removed for x in line_dedup.line_report(corpus(spark, texts)).collect() if x.removed}
    assert out == dict(brute_lines(texts)) and len(out) == 41 and len(out[640]) == 10
    assert 40 <= sum(made) < 1000


def test_line_dedup_hashes_texts_once_and_meets_by_one_shuffle(spark, monkeypatch):
    """Words are counted from the stored hashes, so texts are split once for counts and sets; the constant of levels is 131,072 numbers; all
    but the first meeting is of a table with itself. Identifiers are whole numbers out of order, negative ones among them, or strings."""
    base = [words(20 + i % 9, i, 300) for i in range(80)]
    texts = [" ".join(w) for w in base] + ["\n".join(" ".join([*w[:-1], "x"]) for w in base[:30]), None, "a a b\na b"]
    seen, met, split = [], [], []
    levels, meet, count = line_dedup.rarity_levels, line_dedup._meet, line_dedup.words_of
    monkeypatch.setattr(line_dedup, "rarity_levels", lambda words: seen.append((words.columns, levels(words))) or seen[-1][1])
    monkeypatch.setattr(line_dedup, "_meet", lambda later, earlier, percent: met.append(later is earlier) or meet(later, earlier, percent))
    monkeypatch.setattr(line_dedup, "words_of", lambda text: split.append(1) or count(text))
    docs = corpus(spark, texts).withColumn("doc_id", (F.col("doc_id") - 40).cast("int")).orderBy(F.desc("doc_id"))
    out = {x.doc_id + 40: x.removed for x in line_dedup.line_report(docs).collect() if x.removed}
    assert out == dict(brute_lines(texts)) and len(out) == 2
    assert len(split) == 3 and met == [False] + [True] * line_dedup.SLICES  # hashes, and words for the two verifications
    assert seen[0][0] == ["at", "h"] and spark.range(1).select(F.size(seen[0][1])).first()[0] == 1 << 17
    named = corpus(spark, texts).withColumn("doc_id", F.format_string("%04d", "doc_id"))
    assert {int(x.doc_id): x.removed for x in line_dedup.line_report(named).collect() if x.removed} == out


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = [x for x in BLANK.split(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def near_corpus(families=12, copies=8):
    r = random.Random(3)
    texts = list(EDGE)
    for f in range(families):
        w = words(r.randrange(40, 160), 100 + f, 3000)
        for _ in range(copies):
            w = list(w) if r.random() < 0.6 else w
            c = list(w)
            for _ in range(r.randrange(4)):
                c[r.randrange(len(c))] = f"n{r.randrange(10**6)}"
            if r.random() < 0.5:
                w = c  # chains: links that only lead on by way of others
            texts.append(" ".join(c))
    return texts


@pytest.mark.parametrize(("k", "percent", "lists"), [(4, 85, 64), (5, 80, 64), (4, 85, 3)])
def test_ngram_components(spark, monkeypatch, k, percent, lists):
    texts = near_corpus()
    monkeypatch.setattr(ngram_join, "LIST_PAIRS", lists)
    out = ngram_join.ngram_components(corpus(spark, texts), k, percent).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in out} == brute_components(texts, k, percent)


def test_ngram_null_and_repeated_identifiers(spark):
    a, b, c = (words(60, i, 5000) for i in range(3))
    near = lambda w: " ".join([*w[:-1], "changed"])
    rows = [("x", " ".join(a)), ("x", " ".join(b)), ("m", near(b)), (None, near(a)), (None, " ".join(c)), (None, near(c)), ("z", None), (None, "")]
    got = sorted(map(tuple, ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id string, text string")).collect()), key=str)
    assert got == sorted([("x", 57, "x"), ("x", 57, "m"), ("m", 57, "m"), (None, 57, "x"), (None, 57, None), (None, 57, None), ("z", 0, "z"), (None, 0, None)], key=str)


def test_ngram_large_component_is_cut(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_POSTINGS", 400)
    texts = near_corpus(3, 30)
    out = ngram_join.ngram_components(corpus(spark, texts)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in out} == brute_components(texts, 4, 85)
    assert ngram_join.ngram_components(corpus(spark, texts).limit(0)).count() == 0


def test_keep_one_null_and_repeated_identifiers(spark, tmp_path):
    a, b, c, d, e = (words(60, i, 5000) for i in range(5))
    near = lambda w: " ".join([*w[:-1], "changed"])
    rows = [
        (None, " ".join(a)), (None, " ".join(b)), (4, near(b)), (None, None),  # null identifiers: unique, linked, empty
        (7, " ".join(c)), (7, " ".join(d)), (2, near(d)), (9, near(c)), (7, " ".join(e)), (7, " ".join(e)),  # one identifier, three texts
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([rows[0], rows[1], rows[3], rows[4], rows[6], rows[8]], key=str)
    assert sorted(map(tuple, ngram_join.keep_one(docs.coalesce(1)).collect()), key=str) == want
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    assert sorted(map(tuple, ngram_join.keep_one(spark.read.parquet(str(tmp_path / "docs"))).collect()), key=str) == want


def test_metadata_as_a_column_of_a_stored_table(spark, tmp_path):
    """A column named _metadata, also one with the fields of Spark's own, in rows read from files."""
    docs = spark.createDataFrame([(i, t, "s", (f"f{i}", 7)) for i, t in enumerate(["a b", "ab", None, "c d e f g h", "c d e f g h"])], "doc_id long, text string, source string, _metadata struct<file_path: string, row_index: long>")
    docs.coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    assert sorted(x.doc_id for x in exact_dedup.keep_first(docs).collect()) == [0, 2, 3]
    assert sorted(x.doc_id for x in ngram_join.keep_one(docs).collect()) == [0, 1, 2, 3]
    assert sorted(x.doc_id for x in line_dedup.without_lines(docs).collect()) == [0, 1, 2, 3, 4]
    assert {x.doc_id: x["_metadata"]["file_path"] for x in mixing.mixed_documents(docs).collect()} == {i: f"f{i}" for i in (0, 1, 3, 4)}


def test_postings_of_a_task_are_bounded(spark):
    """20,000 sets with common shingles in one task give at most LIST_PAIRS rows of a key, and a star beside them."""
    rows = spark.range(20_000, numPartitions=1).select("id", F.lit(10).cast("long").alias("n"), F.array(F.lit(5).cast("long"), F.col("id") % 300 + 10, F.col("id") + 1000).alias("prefix"))
    got = ngram_join.postings(rows).collect()
    by = Counter(x.key for x in got if x.key is not None)
    assert max(by.values()) <= ngram_join.LIST_PAIRS and by[5] == 1 and by[10] == 1  # of key 10 there are 67
    assert len([k for k in by if k >= 1000]) == 20_000
    stars = defaultdict(set)
    for x in got:
        if x.key is None:
            stars[x.id].add(x.other)
    assert stars[0] >= set(range(1, 20_000)) and {x.last for x in got if x.key in (5, 10)} == {-1}
    edges, lists = ngram_join.candidate_edges(ngram_join.postings(rows.repartition(7)), 85)
    assert lists.agg(F.max(F.size("ms"))).first()[0] <= ngram_join.LIST_PAIRS
    assert {x.component for x in connected_components(edges).collect()} == {0}


def test_row_keys_are_their_own(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).repartition(37).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    keys = ngram_join.row_keys(docs)
    assert keys.select("key").distinct().count() == 1000 and keys.agg(F.min("key")).first()[0] >= 0
    assert "Exchange" not in keys._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, keys.select("doc.doc_id", "key").collect())) == sorted(map(tuple, ngram_join.row_keys(docs).select("doc.doc_id", "key").collect()))


def test_divide_skip_brute_force():
    r = random.Random(4)
    for _ in range(300):
        lists = [sorted(r.sample(range(60), r.choice([1, 2, 3, 20, 40]))) for _ in range(r.randrange(1, 15))]
        least = r.randrange(1, len(lists) + 1)
        c = Counter(x for a in lists for x in a)
        assert ngram_join.divide_skip(lists, least) == {x: n for x, n in c.items() if n >= least}


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x.id: x.component for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_spotsigs(spark):
    a = "the cat of the house sat on the mat and a dog barked at the moon"
    texts = [*EDGE, a, a.upper(), a + " while birds", "the of " * 3000 + "cat dog"]
    out = {x.doc_id: x for x in spotsigs.edited_pairs(corpus(spark, texts), per_block=4).collect()}
    order = sorted(out, reverse=True)
    for i, d in enumerate(order):
        t, n = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        assert out[d].n_chars == len(t) and out[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert 0 <= out[d].near_edited <= 1 and 0 <= out[d].near_next <= 1
    assert out[8].fingerprint == out[9].fingerprint and out[len(EDGE)].fingerprint == out[len(EDGE) + 1].fingerprint
    assert out[9].near_next == 1.0
    pairs = {(x.a, x.b) for x in spotsigs.near_duplicates(corpus(spark, texts), 0.5).collect()}
    sets = {i: set(x.fingerprint.split()) for i, x in out.items()}
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    reps = sorted(first.values())
    assert pairs == {(i, j) for i in reps for j in reps if i < j and len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])}
    assert spotsigs.edited_pairs(corpus(spark, ["one"])).first().near_next == 1.0
    assert spotsigs.edited_pairs(corpus(spark, EDGE).limit(0)).count() == 0


def test_spotsigs_likeness_against_plain_python(spark):
    r = random.Random(9)
    bits = ["the", "of", "a", *"uvwxyz", "cat", "Dog", ", ", "\n", "é", "\x02", "\x85"]
    texts = [*SPOTS, *EDGE, *(" ".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(60))]
    texts += texts[-3:]
    edited = [(t or "")[: len(t or "") - len(t or "") // 2] + (texts[i - 1] or "")[: len(t or "") // 2] for i, t in enumerate(texts)]  # next by descending id
    code = spot_hashes(spark, set().union(*map(spot_all, [*texts, *edited])))
    of = lambda t: {code[c] for c in spot_all(t)}
    like = lambda x, y: len(x & y) / len(x | y)
    hexes = lambda x: " ".join(f"{v:x}" for v in sorted(x))
    for x in spotsigs.edited_pairs(corpus(spark, texts), per_block=7).collect():
        i = x.doc_id
        mine, other, after = of(texts[i]), of(edited[i]), of(texts[i - 1])
        assert (x.n_chars, x.edited_sha256) == (len(texts[i] or ""), hashlib.sha256(edited[i].encode()).hexdigest())
        assert (x.fingerprint, x.edited_fingerprint) == (hexes(mine), hexes(other)), texts[i]
        assert x.near_edited == pytest.approx(like(mine, other)) and x.near_next == pytest.approx(like(mine, after))


SPOTS = ["of cat, the dog", "In of, the  cat -- and, the (dog) house; a bird", "the of " * 50 + "cat, of the dog", "one, two. The three", "cat the", "x  the\ty of\n\nthe z"]


def spot_tokens(text):
    """The text's start and every content word, each with the common words that follow it."""
    out = [("", ["^"])]
    for w in "".join(" " if c in spotsigs.PUNCTUATION else c for c in text or "").lower().split(" "):
        if w in spotsigs.ANCHORS:
            out[-1][1].append(w)
        elif w:
            out.append((w, []))
    return out


def spot_chains(text):
    t = spot_tokens(text)
    return {f"{a} {t[i + 1][0]} {t[i + 2][0]}" for i in range(len(t) - 2) for a in t[i][1]}


def spot_hashes(spark, strings):
    rows = spark.createDataFrame([(x,) for x in sorted(strings)], "s string").select("s", F.xxhash64("s").bitwiseAND(F.lit(0xFFFFFFFF)).alias("h"))
    return {x.s: x.h for x in rows.collect()}


def test_spotsigs_keep_every_chain(spark):
    r = random.Random(5)
    bits = ["the", "of", "a", "cat", "Dog", "bird", "x", ", ", ". ", "  ", "\n", "-", "("]
    texts = SPOTS + [" ".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(60)]
    got = {x.doc_id: set(x.sigs) for x in corpus(spark, texts).select("doc_id", spotsigs.signatures(F.col("text")).alias("sigs")).collect()}
    code = spot_hashes(spark, set().union(*map(spot_chains, texts)))
    assert {"of cat dog", "^ cat dog"} <= spot_chains(texts[0])
    for i, t in enumerate(texts):
        assert {code[c] for c in spot_chains(t)} <= got[i], t


def spot_all(text):
    t = spot_tokens(text)
    flat = " ^ " + "".join(" " if c in spotsigs.PUNCTUATION else c for c in text or "").lower() + " "
    whole = re.sub(" +", " ", flat)
    if len(t) < 3:
        return {whole}
    far = [*t, ("$", []), ("$", [])]
    out = {f"{a} {far[i + 1][0]} {far[i + 2][0]}" for i in range(len(t)) for a in t[i][1]}
    out |= {f"{t[i - 2][0]} {t[i - 1][0]} {t[i][0]}" for i in range(3, len(t)) if not t[i - 1][1] and not t[i - 2][1]}
    return out | ({whole} if not any(c != "^" for _, cs in t for c in cs) else set())


def test_spotsigs_read_every_word(spark):
    r = random.Random(6)
    opening = "The and attion to thanedble, anea."
    texts = [opening + " hant" * 3 + " onwhly anes", opening + " th erly, ofthedenha", "red | green | blue | " + " | ".join(words(60, 1)), "red | green | blue | " + " | ".join(words(60, 2)), "cat", "the", "", "cat of the", "x y", "the x y z the", *EDGE]
    texts += [" ".join(r.choice(["the", "of", *"uvwxyz", ", "]) for _ in range(r.randrange(25))) for _ in range(80)]
    got = {x.doc_id: set(x.sigs) for x in corpus(spark, texts).select("doc_id", spotsigs.signatures(F.col("text")).alias("sigs")).collect()}
    code = spot_hashes(spark, set().union(*map(spot_all, texts)))
    for i, t in enumerate(texts):
        assert got[i] == {code[c] for c in spot_all(t)}, t
    assert got[0] != got[1] and not got[2] & got[3] - {code["^ red green"], code["red green blue"]}


def test_chat_round_trip(spark):
    r = random.Random(6)
    bits = ["</s>", "<s>[ROLE]", "[TEXT]", "[NEXT]", "\\", "\\(", "\\{", "[", "<", "\n", "é😀", "hi"]
    rows = []
    for c in range(40):
        for t in range(r.randrange(1, 8)):
            text = None if r.random() < 0.1 else "".join(r.choice(bits) for _ in range(r.randrange(8)))
            rows.append((c, t, r.choice(["user", "assistant", "system", None, "a[b"]), text, "extra"))
    rows += [(None, 0, "user", "x", ""), (7, 0, "user", "dup", ""), (7, 0, "user", "dup", ""), (8, None, "assistant", "n", ""), *((41, 0, "user", x, "") for x in "[<\\az")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string").repartition(4)
    out = {x.conv_id: x for x in chat.digests(chat.format_chats(df)).collect()}
    convs = defaultdict(list)
    for c, t, role, text, _ in rows:
        convs[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(out) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{x[2]}\n{x[3]}\n" for x in turns)
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        assert out[c].n_turns == len(turns) and out[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert out[c].loss_chars == len(loss) and out[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_mixing(spark):
    r = random.Random(7)
    sources = [r.choice(["a", "b", "c", "hot", "hot", "hot", None]) for _ in range(300)]
    texts = [None if r.random() < 0.05 else " \t".join(words(r.randrange(60), i)) for i in range(300)]
    docs = corpus(spark, texts, sources)
    out = mixing.mix(docs).collect()
    assert len(out) == 300 and sorted(out) == sorted(mixing.mix(docs.repartition(7)).collect())
    size = {i: len([x for x in BLANK.split(t or "") if x]) for i, t in enumerate(texts)}
    by = defaultdict(list)
    for x in out:
        assert x.size == size[x.doc_id] and 0 <= x.taken <= 3 * x.size
        by[sources[x.doc_id]].append(x)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    w = {s: i % 3 + 1 for i, s in enumerate(order)}
    total = {s: sum(x.size for x in by[s]) for s in by}
    goal, open_, left = {}, set(by), float(sum(total.values()))
    while True:  # by hand: cap, reshare, repeat
        share = {s: left * w[s] / sum(w[t] for t in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * total[s]}
        if not full:
            goal |= share
            break
        for s in full:
            goal[s] = 3.0 * total[s]
            left -= goal[s]
        open_ -= full
    for s in by:
        assert by[s][0].target == pytest.approx(goal[s]) and by[s][0].source_size == total[s]
        assert abs(sum(x.taken for x in by[s]) - goal[s]) <= 1
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = Counter()
    for x in mixed.collect():
        got[x.doc_id] += len(BLANK.split((x.text or "").strip(" \t")))
    assert got == Counter({x.doc_id: x.taken for x in out if x.taken})
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_repeated_rows_hit_the_target(spark, tmp_path):
    """Equal rows at the cut take the whole size one after the other, one of them a part, the rest nothing."""
    rows = [(7, "w " * 10, "a", "x")] * 50 + [(7, "w " * 4, "a", "x")] * 9 + [(None, "v " * 6, "b", "x")] * 120 + [(3, None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, file string")
    docs.repartition(5).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows) and sorted(out, key=str) == sorted(mixing.mix(docs).collect(), key=str)
    for target in {x.target for x in out}:
        mine = [x for x in out if x.target == target]
        assert abs(sum(x.taken for x in mine) - target) <= 0.5 and all(0 <= x.taken <= 3 * x.size for x in mine)
    assert len({x.target for x in out}) == 3 and sum(x.taken for x in out) == 536 + 720
    mixed = mixing.mixed_documents(docs).collect()
    assert sum(len((x.text or "").split()) for x in mixed) == 536 + 720


def test_mixing_empty_texts(spark):
    assert [x.taken for x in mixing.mix(corpus(spark, [None, ""])).collect()] == [0, 0]


def brute_sections(spans, bounds):
    out = [0] * (len(bounds) - 1)
    for a, b in spans:
        out[max(range(len(out)), key=lambda k: (min(b, bounds[k + 1]) - max(a, bounds[k]), -k))] += 1
    return out


@needs_vocab
def test_token_counts(spark, monkeypatch):
    """Against the library's offsets, token by token, for lines and for fields."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    t.encode_special_tokens = True
    r = random.Random(8)
    bits = ["a", "Zé", " ", "  ", "\n", "\n\n", "\r\n", "\t", "'s", "'LL", "9", "²", "½", "한국", "😀", "\x00", "\x1c", "\x85", "\xa0", "\u3000", "µ", "the", "<|endoftext|>", "!"]
    texts = [*EDGE, "a\n\nb c\n", "\n\n\n", "é\n한국\n" * 3, *("".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(300))]
    monkeypatch.setattr(token_counts, "MEMO_CHARS", 40)
    out = {x.doc_id: x for x in token_counts.count_tokens(corpus(spark, texts), BYTE).collect()}
    for i, x in enumerate(texts):
        e = t.encode(x or "", add_special_tokens=False)
        bounds = token_counts.line_bounds(x or "").tolist()
        assert out[i].n_tokens == len(e.ids) and out[i].section_tokens == brute_sections(e.offsets, bounds) and out[i].n_sections == len(bounds) - 1
    some = texts[-200:]
    rows = [(i, some[i], None if i % 5 == 0 else some[i - 1], some[i - 2]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, a string, b string, c string")
    for x in token_counts.count_tokens(docs, BYTE, fields=["a", "b", "c"]).collect():
        parts = [v or "" for v in rows[x.doc_id][1:]]
        e = t.encode("".join(parts), add_special_tokens=False)
        bounds = [0, *np.cumsum([len(v) for v in parts]).tolist()]
        assert x.n_tokens == len(e.ids) and x.section_tokens == brute_sections(e.offsets, bounds)
    # a token of four characters, three of them in the second section; a tie goes to the first
    assert token_counts.attribute(np.array([[0, 4], [4, 6]]), np.array([0, 1, 5, 9])).tolist() == [0, 2, 0]
    assert token_counts.count_tokens(docs.limit(0), BYTE, fields=["a"]).count() == 0


def test_slices_of_the_keys_have_the_edges_of_the_whole(spark):
    """Every posting is met in one slice, and lists and stars of all slices give the edges of the postings at once; no slice holds most of them."""
    rng = random.Random(8)
    rows = [(i, 10, i, i, sorted(rng.sample(range(60), 7)) if i % 9 else []) for i in range(400)]
    sets = spark.createDataFrame(rows, "id long, n long, sig_a long, sig_b long, prefix array<long>").coalesce(2)
    classes = sets.filter("size(prefix) > 0").select("n", "sig_a", "sig_b", F.col("id").alias("rep"))
    lists, local = ngram_join.sliced_lists(sets, classes)
    whole, _ = ngram_join.candidate_edges(ngram_join.postings(sets.filter("size(prefix) > 0")), 30)
    parts = ngram_join.list_edges(reduce(DataFrame.unionByName, lists), reduce(DataFrame.unionByName, local), 30)
    assert len(lists) == ngram_join.SLICES > 1
    assert {tuple(r) for r in parts.collect()} == {tuple(r) for r in whole.collect()} != set()
    n = [x.agg(F.sum(F.size("ms"))).first()[0] for x in lists]
    assert max(n) < 0.5 * sum(n)
