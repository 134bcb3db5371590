"""Line dedup: an exact set-similarity join over lines, with DataFrame operations only.

A line's set holds its distinct words (runs of [^\\x20\\x09-\\x0D]). Lines are ordered by identifier, then line number;
a line goes if an earlier line's set has a Jaccard coefficient of at least the threshold with its own.
Lines without words always stay.

1. Words are ordered by rarity: by counts in 2,097,152 hash buckets over the whole corpus, then by hash. Any one order
   for all lines gives the same links, so buckets shared by several words cost nothing but time. Texts are split once for
   this and for the sets.
2. Lines with equal sets are one class, known by the number of its first line; the others of it go. Numbers are in the
   order of lines.
3. Classes meet by the words of their prefixes. A pair is made only if the sizes and the parities of 128 classes of
   words leave room for a match: a word that one set has and the other has not changes one parity, so the parities that
   differ are no more than such words. First each meets the eight earliest classes of each long list only, which
   settles most of a group of near copies in linear time; what has no match yet then meets all earlier members of its
   lists, a slice of the words at a time.
4. Pairs are verified on the words themselves.

Null texts count as empty and have one empty line. Identifiers may be null (these come first) or repeated: rows are
known by keys of their own, and of rows of one identifier the one with the least key comes first; in one file, the first. Empty tables give no
rows. Further columns are ignored by `line_report` and kept by `without_lines`.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from chromalith.llm._store import located, release, stored
from chromalith.llm.ngram_join import row_keys

SIXTEENS = 47  # a word's hash, shifted by this, is the number of its sixteen buckets
WIDE = 64
LONG = 4  # level of words whose lists are long: some 64 lines or more
HEADS = 8  # classes of a long list that are met first
SLICES = 2
DOC_BITS, LINE_BITS = 32, 31
BLANKS = "[ \\t\\n\\x0B\\f\\r]+"
RARE_BLANKS = "\t\x0b\f\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def words_of(text: Column) -> Column:
    """Most texts have no other blanks than the space and the line's end; these are split without a pattern."""
    odd = reduce(or_, (F.contains(text, F.lit(b)) for b in RARE_BLANKS))
    return F.array_remove(F.when(odd, F.split(text, BLANKS)).otherwise(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")), "")


def _hash(word: Column) -> Column:
    return F.xxhash64(word)


def numbered(docs: DataFrame, id_col: str) -> tuple[DataFrame, bool]:
    """doc (a struct of all columns) and no, a number of the row's own below 2**32 in the order of identifiers, then rows; docs must have
    places. Whole numbers that differ and lie near enough to each other number their rows themselves: True; others are sorted."""
    rows = docs.select(F.struct("*").alias("doc"))
    own = F.col(f"doc.`{id_col}`")
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        n, known, low, high = rows.agg(F.count(F.lit(1)), F.count_distinct(own), F.min(own), F.max(own)).first()
        if n == known and (not n or high - low < 1 << DOC_BITS):
            return rows.select("doc", (own.cast("long") - F.lit(low or 0).cast("long")).alias("no")), True
    rows = row_keys(docs)
    order = stored(rows.select(own.alias("id"), "key").orderBy("id", "key").select("key", F.monotonically_increasing_id().alias("m")), "line-order")
    # a number is a partition's and a place in it: as few bits as there are of either
    part, place = F.shiftright("m", 33), F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    parts, places = order.agg(F.max(part), F.max(place)).first()
    bits = int(places or 0).bit_length()
    if bits + int(parts or 0).bit_length() > DOC_BITS:
        raise RuntimeError(f"rows in more than 2**{DOC_BITS} places")
    return rows.join(order.select("key", F.shiftleft(part, bits).bitwiseOR(place).alias("no")), "key").select("doc", "no"), False


def line_words(texts: DataFrame) -> DataFrame:
    """A row for each line that has words: at, the row's and the line's number side by side, and h, the hash of each distinct word."""
    lines = texts.select("no", F.posexplode(lines_of(F.col("text"))).alias("line", "text"))
    at = F.shiftleft("no", LINE_BITS).bitwiseOR(F.col("line").cast("long")).alias("at")
    return once(lines, "h", F.array_distinct(F.transform(words_of(F.col("text")), _hash)), at).filter("size(h) > 0")


def once(df: DataFrame, name: str, col: Column, *more: Column | str) -> DataFrame:
    """df's columns `more` and col, exploded from an array of one: else what is derived from an array would find it anew each time."""
    return df.select(*more, F.explode(F.array(col)).alias(name))


def rarity_levels(words: DataFrame) -> Column:
    """For each hash bucket a level of four bits, 0 for one word, else 1 more than half of log2 of the number of words in it;
    sixteen buckets to a number, so that a constant of 131,072 numbers reaches the driver, whatever the corpus."""
    h, last = F.col("h"), F.lit(15)
    bucket = F.shiftleft(F.shiftrightunsigned(h, SIXTEENS), 4).bitwiseOR(F.shiftright(h, 2).bitwiseAND(last)).cast("int")
    counts = words.select(F.explode("h").alias("h")).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    level = F.when(F.col("n") <= 1, 0).otherwise(F.least(last, 1 + F.floor(F.log2(F.col("n").cast("double")) / 2))).cast("long")
    packed = F.bit_or(F.call_function("shiftleft", level, 4 * F.col("b").bitwiseAND(last)))
    sums = counts.groupBy(F.shiftright("b", 4).alias("b")).agg(packed.alias("levels")).toArrow()
    table = np.zeros(1 << (64 - SIXTEENS), np.int64)
    table[sums["b"].to_numpy()] = sums["levels"].to_numpy()
    table ^= np.int64(-0x7777777777777778)  # the highest bit of each level is turned, so that levels of codes, whose sign it is, are in order
    # read as an array once, when the plan is made
    return F.split(F.lit(",".join(map(str, table.tolist()))), ",").cast("array<bigint>")


def level_code(level: int) -> int:
    """The least code of a word of this level."""
    return (level - 8) << 28


def line_sets(words: DataFrame, levels: Column, percent: int) -> DataFrame:
    """Of each row of `words`: at, n words, h1 and h2, hashes of its ordered codes, the ordered codes of its prefix's words, halved, and
    parities: p2 those of 64 classes of words, p1, of sets of more than WIDE words, those of one half of each class.

    A code is a word's level and 60 bits of its hash, 28 of them in the half; words that share one make a pair a candidate, no more.
    """

    def code(h: Column) -> Column:  # of as few steps as can be: they are taken for each word
        sixteen = F.get(levels, F.shiftrightunsigned(h, SIXTEENS))
        level = F.call_function("shiftrightunsigned", sixteen, h.bitwiseAND(F.lit(60)).cast("int"))
        return F.shiftleft(level, 60).bitwiseOR(F.shiftrightunsigned(h, 4))

    sets = once(words, "codes", F.sort_array(F.transform("h", code)), "at").withColumn("n", F.size("codes"))
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    flip = lambda bit: lambda acc, c: acc.bitwiseXOR(F.call_function("shiftleft", bit(c), c.bitwiseAND(F.lit(63)).cast("int")))
    p1 = F.when(F.col("n") > WIDE, F.reduce("codes", none, flip(lambda c: F.shiftright(c, 6).bitwiseAND(one)))).otherwise(none)
    p2 = F.reduce("codes", none, flip(lambda c: one))
    prefix = F.expr(f"slice(codes, 1, n - cast(({percent} * n + 99) div 100 as int) + 1)")
    prefix = F.array_distinct(F.transform(prefix, lambda c: F.shiftright(c, 32).cast("int")))
    return sets.select("at", "n", F.xxhash64("codes").alias("h1"), F.xxhash64(one, "codes").alias("h2"), p1.alias("p1"), p2.alias("p2"), prefix.alias("prefix"))


def _candidate(percent: int) -> Column:
    """Whether the sizes and parities of a and b, of which a is the earlier, leave room for a match. A b whose n is negative is settled.
    No part looks at one side alone: so where a table meets itself, both sides are one shuffle."""
    both = "abs(a.n) + cast(b.n as long)"
    apart = f"if(least(abs(a.n), b.n) > {WIDE}, bit_count(a.p1 ^ b.p1) + bit_count(a.p1 ^ b.p1 ^ a.p2 ^ b.p2), bit_count(a.p2 ^ b.p2)) <= {both} - 2 * (({percent} * ({both}) + {99 + percent}) div {100 + percent})"
    return F.expr(f"a.cid < if(b.n > 0, b.cid, -1L) and {apart} and 100L * least(abs(a.n), b.n) >= {percent} * greatest(abs(a.n), b.n)")


def _meet(later: DataFrame, earlier: DataFrame, percent: int) -> DataFrame:
    """(b, a): classes of `later` and of `earlier` that share a prefix word and may match."""
    a, b = earlier.alias("a"), later.alias("b")
    return b.join(a, (F.col("a.code") == F.col("b.code")) & _candidate(percent)).select(F.col("b.cid").alias("b"), F.col("a.cid").alias("a")).distinct()


def _place(at: str) -> tuple[Column, Column]:
    return F.shiftright(at, LINE_BITS).alias("no"), F.col(at).bitwiseAND(F.lit((1 << LINE_BITS) - 1)).cast("int").alias("line")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The classes b that match an a, by the words of their first lines."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().select("cid", *_place("cid"))
    need = need.groupBy("no").agg(F.collect_list(F.struct("cid", "line")).alias("lines"))
    # texts are split where they are needed only, once for all of their lines
    split = texts.select("no", "text").join(need, "no").select("lines", F.explode(F.array(lines_of(F.col("text")))).alias("text"))
    lines = split.select(F.explode("lines").alias("x"), "text").select("x.cid", F.get("text", F.col("x.line")).alias("text"))
    words = stored(lines.select("cid", F.array_distinct(words_of(F.col("text"))).alias("w")), "line-words")
    x = pairs.join(words.select(F.col("cid").alias("b"), F.col("w").alias("wb")), "b").join(words.select(F.col("cid").alias("a"), F.col("w").alias("wa")), "a")
    both = F.size(F.array_intersect("wa", "wb"))
    out = stored(x.filter(100 * both >= percent * (F.size("wa") + F.size("wb") - both)).select(F.col("b").alias("cid")).distinct(), "line-matched")
    release(words)
    return out


def texts_of(rows: DataFrame, own: bool, id_col: str, text_col: str) -> DataFrame:
    """no, id and text of numbered rows; stored where their numbers come from a join, which would else move the texts each time."""
    texts = rows.select("no", F.col(f"doc.`{id_col}`").alias("id"), F.col(f"doc.`{text_col}`").alias("text"))
    return texts if own else stored(texts, "line-texts")


def _gone(texts: DataFrame, percent: int) -> DataFrame:
    """no, line (from 0) of every line of texts (no, text) that goes."""
    words = stored(line_words(texts), "line-hashes")
    rows = stored(line_sets(words, rarity_levels(words), percent), "line-rows")
    release(words)
    # the first line of a class stands for it, the others go
    first = rows.groupBy("h1", "h2").agg(F.min("at").alias("first"))
    lead = F.col("at") == F.col("first")
    marked = rows.join(first.hint("shuffle_hash"), ["h1", "h2"]).select(F.col("at").alias("cid"), "n", "p1", "p2", F.when(lead, F.col("prefix")).alias("prefix"))
    marked = stored(marked, "line-classes")
    release(rows)
    classes = marked.filter("prefix is not null and cid is not null and n is not null and p1 is not null and p2 is not null")
    lists = lambda of: of.select(F.explode("prefix").alias("code"), "cid", "n", "p1", "p2")
    post = lists(classes).filter(F.col("code") >= level_code(LONG))
    heads = post.withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy("cid"))).filter(F.col("rank") <= HEADS).drop("rank")
    met = stored(_meet(post, heads, percent), "line-pairs")
    settled = _verified(met, texts, percent)
    n = F.when(F.col("settled"), -F.col("n")).otherwise(F.col("n")).alias("n")
    rest = classes.join(settled.withColumn("settled", F.lit(True)), "cid", "left").select("cid", n, "p1", "p2", "prefix")
    second = []
    for k in range(SLICES):
        # a word of level 0 occurs once in the corpus, so no other line has it
        share = (F.col("code") >= level_code(1)) & (F.col("code").bitwiseAND(F.lit(SLICES - 1)) == k)
        own = lists(rest).filter(share)
        second.append(stored(_meet(own, own, percent), "line-pairs"))
    pairs = stored(reduce(DataFrame.unionByName, second).distinct().join(met, ["a", "b"], "left_anti"), "line-pairs")
    release(met, *second)
    matched = _verified(pairs, texts, percent)
    release(pairs)
    gone = marked.filter("prefix is null").select("cid").unionByName(settled).unionByName(matched)
    return gone.select(*_place("cid"))


def removed_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, line (from 0) of every line that goes."""
    texts = texts_of(*numbered(located(docs, [id_col, text_col]), id_col), id_col, text_col)
    return _gone(texts, percent).join(texts.select("no", "id"), "no").select(F.col("id").alias(id_col), "line")


def line_report(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_lines, n_removed and the numbers of the removed lines for every document."""
    texts = texts_of(*numbered(located(docs, [id_col, text_col]), id_col), id_col, text_col)
    gone = _gone(texts, percent).groupBy("no").agg(F.sort_array(F.collect_set("line")).alias("removed"))
    out = texts.select("no", F.col("id").alias(id_col), F.size(lines_of(F.col("text"))).cast("long").alias("n_lines")).join(gone, "no", "left")
    none = F.expr("cast(array() as array<int>)")
    return out.select(id_col, "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", none).alias("removed"))


def without_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all columns, their texts without the lines that go."""
    rows, own = numbered(located(docs, docs.columns), id_col)
    gone = _gone(texts_of(rows, own, id_col, text_col), percent).groupBy("no").agg(F.collect_set("line").alias("gone"))
    out = rows.join(gone, "no", "left")
    old = F.col(f"doc.`{text_col}`")
    kept = F.array_join(F.filter(lines_of(old), lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), old).otherwise(kept)
    return out.select(*[(text if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
