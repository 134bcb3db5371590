"""Document fingerprints: SpotSigs, with DataFrame operations only.

A signature is a common word (the anchor) with the two content words that follow it, common words between them
skipped; every common word of a run is an anchor, and the text's start is one too; "$" stands for words beyond the
text's end. A content word that no common word's chain reaches ends a chain of its own, with the two words before it, so
that every word is read. Words are what blanks and ASCII punctuation leave, lower-cased. A text without common words has
its words as a whole as a further signature, one of fewer than two content words has no other. A fingerprint is the
sorted set of its signatures' 32-bit hashes, written in hex; likeness is the Jaccard coefficient of two sets.

`near_duplicates` partitions fingerprints by set length, so that only sets whose lengths allow the threshold meet,
and prunes by prefix and position before it computes a Jaccard coefficient.

Null texts count as empty; equal texts have equal fingerprints; two empty texts are alike (1.0). In `edited_pairs`
rows of equal identifiers follow each other by text, descending; null identifiers come last; a single row is its own
next. Its identifiers must be whole numbers or null, as blocks are cut by their differences. An empty table gives no
rows. Only the identifier and the text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromalith.llm._store import stored

# the most common words of English, French, German and Spanish
ANCHORS = (
    "the of and to in a is that it for on was as with be by at this are or from an he not but his her they which you were have had "
    "de la le les des et un une en du que qui dans pour par sur au est pas ne il ce se "
    "der die das und den von zu mit im ist dem ein eine nicht auf für sich "
    "el los las y del por con una su para es al lo como más o"
).split()
PUNCTUATION = "\x01\t\n\x0b\x0c\r!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
START = "^"
END = "$"
GLUE = "\x01"


def _once(value: Column, use) -> Column:
    """use(value), the value being found once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _alternatives(words) -> str:
    """A pattern for any of the words, the longest first, by their common beginnings: few of them are tried at a place."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [c + pattern(node[c]) for c in sorted(node) if c]
        if "" in node:
            return f"(?:{'|'.join(ways)})?+" if ways else ""
        return f"(?:{'|'.join(ways)})" if len(ways) > 1 else ways[0]

    return pattern(tree)


def flat_words(text: Column) -> Column:
    """The words behind the mark of the text's start, lower-cased, with one blank before and after each."""
    gaps = "".join(f"\\x{ord(c):02x}" for c in PUNCTUATION)
    return F.regexp_replace(F.concat(F.lit(f" {START} "), F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{gaps} ]+", " ")), F.lit(" ")), " +", " ")


def signatures(text: Column, anchors: tuple[str, ...] | list[str] = tuple(ANCHORS), chain: int = 2) -> Column:
    """The sorted set of hashed signatures of a text.

    Common words are first glued to the word before them by GLUE, so that a word and the common words after it are
    one run of other characters than the blank; the patterns then need no repeated groups, whose matching would
    recurse in long texts. Runs of blanks are one blank by then, as a pattern must not meet GLUE after a blank.
    """
    glue = lambda flat: F.concat(F.lit(" "), F.regexp_replace(flat, f" ({_alternatives(anchors)}|\\^)(?= )", f"{GLUE}$1"))
    word = f"[^{GLUE} ]++"
    # from one common word to the next: it and the next content words, whatever common words are glued between them; of what
    # is behind the last one nothing is left
    ahead = "[^ ]*+ " + "[^ ]*+ ".join([f"({word})"] * chain)
    anchored = f"[^{GLUE}]*+{GLUE}([^ {GLUE}]++)(?={ahead})|[^{GLUE}]*+\\z"
    told = GLUE + " ".join(f"${k}" for k in range(1, chain + 2))
    # content words only, none of which but the last has a common word behind it; the look-ahead lets them overlap
    plain = f" (?=({f'{word} ' * chain}(?!\\{END}){word}))"
    low = lambda c: F.xxhash64(c).bitwiseAND(F.lit(0xFFFFFFFF))

    def of(flat: Column, glued: Column) -> Column:
        far = F.concat(glued, F.lit(f"{END} " * chain))
        chains = F.filter(F.split(F.regexp_replace(far, anchored, told), GLUE), lambda c: ~c.isin("", " " * chain))
        hashed = F.transform(F.concat(chains, F.regexp_extract_all(far, F.lit(plain), F.lit(1))), low)
        few = ~glued.rlike(f" {word}" + f"[^ ]*+ {word}" * (chain - 1))
        free = ~glued.rlike(f"{GLUE}[^\\^]")
        whole = F.array(low(flat))
        return F.sort_array(F.array_distinct(F.when(few, whole).when(free, F.concat(hashed, whole)).otherwise(hashed)))

    return _once(flat_words(text), lambda flat: _once(glue(flat), lambda glued: of(flat, glued)))


def fingerprint(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda s: F.lower(F.hex(s))), " ")


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_block: int = 1000) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document by descending identifier.

    Identifiers are cut into blocks of about per_block rows in which the next row is a window's; to every block goes
    a copy of the row that follows its last, so that whole texts are shuffled once.
    """
    span = docs.agg(F.min(id_col), F.max(id_col), F.count(F.lit(1))).first()
    low, high, n = span[0] or 0, span[1] or 0, span[2]
    width = max(1, -(-(high - low + 1) // max(1, -(-n // per_block))))
    block = F.coalesce(F.floor((F.col("id") - low) / width), F.lit(-1)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # a row for each block: (block, the block before it by identifier or the last one, its largest identifier)
    tops = rows.groupBy(block.alias("block")).agg(F.max("id").alias("top"))
    every = W.orderBy("block")
    tops = tops.withColumn("into", F.coalesce(F.lead("block").over(every), F.first("block").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    tops = stored(tops, "spot-tops")  # its size is known then, and decides how it is joined
    guests = rows.join(tops, rows["id"].eqNullSafe(tops["top"])).select("id", "text", F.col("into").alias("block"), F.lit(1).alias("guest"))
    rows = rows.select("id", "text", block.alias("block"), F.lit(0).alias("guest")).unionByName(guests)
    # signatures are found behind the shuffle, which so moves texts only
    rows = rows.repartition("block").withColumn("sigs", signatures(F.col("text")))
    order = W.partitionBy("block").orderBy("guest", F.col("id").desc_nulls_last(), F.col("text").desc())
    rows = rows.withColumn("next", F.lead(F.struct("text", "sigs")).over(order)).filter("guest = 0")
    n_chars = F.length("text")
    half = F.floor(n_chars / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n_chars - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.select("id", n_chars.cast("long").alias("n_chars"), edited.alias("edited"), "sigs", F.col("next.sigs").alias("next_sigs"))
    rows = rows.withColumn("edited_sigs", signatures(F.col("edited")))
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, likeness) of classes of equal fingerprints at or above the threshold, named by their smallest identifiers."""
    sets = docs.select(F.col(id_col).alias("id"), signatures(F.col(text_col)).alias("sigs"))
    sets = sets.groupBy("sigs").agg(F.min("id").alias("id")).withColumn("n", F.size("sigs"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold))).cast("int")
    part = sets.withColumn("band", band).withColumn("prefix", F.expr(f"slice(sigs, 1, n - cast(ceil({threshold} * n) as int) + 1)"))
    post = part.select("id", "n", "sigs", "band", F.posexplode("prefix").alias("pos", "sig"))
    # a longer set looks for partners in its own partition and the one of shorter sets beside it
    probe = post.select("*", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("at"))
    a, b = post.alias("a"), probe.alias("b")
    need = F.ceil((F.col("a.n") + F.col("b.n")) * (threshold / (1 + threshold)) - 1e-9)
    meet = (F.col("a.sig") == F.col("b.sig")) & (F.col("a.band") == F.col("b.at")) & ((F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.id") < F.col("b.id"))))
    prune = (F.col("a.n") >= threshold * F.col("b.n") - 1e-9) & (1 + F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) - 1 >= need)
    pairs = a.join(b, meet & prune).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.sigs").alias("x"), F.col("b.sigs").alias("y"))
    pairs = pairs.dropDuplicates(["a", "b"]).withColumn("likeness", likeness(F.col("x"), F.col("y")))
    return pairs.filter(F.col("likeness") >= threshold - 1e-12).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")
