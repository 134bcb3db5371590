"""A prefix trie of conversations, rolled up by pointer jumping.

Every distinct sequence of a conversation's first d turns is a node, known by a digest: the sums, on four lanes of 32 bits,
of SHA-256 digests of (place, role, text) over the turns, hashed once more with their number. Sums make the digest of the parent
known beside that of the node, and make prefixes a matter of running sums, which need no conversation in one task. Turns are
sorted by ranges of (conversation, turn, role, beginning of the text), so that a conversation with a third of all turns
is dealt over many tasks; places and running sums within a range are completed by the sums of the ranges before.

Leaves and savings reach all ancestors in doubling rounds: after round k a node holds the sums of its descendants at a
distance below 2**k, and its pointer leads 2**k levels up. A round adds each node's sums to where its pointer leads, then follows
the pointer's own. The number of rounds is the logarithm of the depth. Nodes whose pointers have passed the root take no more part.
Tables of a round are written to the shared folder.

Turns are ordered by turn, null first, then by role and text; null roles and texts count as empty; repeated rows are turns of
their own. Rows without a conversation are left out. An empty table gives no rows. Other columns aren't read, whatever their
names. Copies of one turn row within one conversation stand in one range, which is sorted on disk.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromalith.llm._store import release, stored
from chromalith.llm.mixing import n_words

LANES = ("l0", "l1", "l2", "l3")
NO_ENDS = hashlib.sha256(b"").hexdigest()
PIECE = 4096


def node_key(depth: Column, lanes: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[c.cast("string") for c in lanes])))


def lanes_of(place: Column, digest: Column) -> list[Column]:
    """What a turn adds to the digest of a prefix."""
    h = F.sha2(F.concat(place.cast("string").cast("binary"), F.lit(b":"), digest), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("bigint").alias(n) for k, n in enumerate(LANES)]


def ordered_turns(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """A stored table (conv, part, at, digest, words): at numbers the turns of a range, conversation after conversation."""
    text = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    rows = turns.select(F.col(f"`{id_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).filter("conv is not null")
    keys = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role")]
    rows = rows.repartitionByRange(*keys, F.substring("text", 1, 32)).sortWithinPartitions(*keys, "text")
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return stored(rows.select("conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), digest.alias("digest"), n_words(F.col("text")).alias("words")), "trie-turns")


def runs_of(turns: DataFrame) -> DataFrame:
    """(conv, part, first, before, total): of a conversation's turns in a range, where they start, how many come in ranges
    before, and how many there are in all."""
    own = turns.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("conv")
    before = F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return own.select("conv", "part", "first", before.alias("before"), F.sum("n").over(w).alias("total"))


def _keyed(rows: DataFrame, lanes: list[Column], *also: Column | str) -> DataFrame:
    """rows with the digest of the prefix and of the one before, from running sums and the turn's own share."""
    parent = node_key(F.col("depth") - 1, [c - F.col(n) for c, n in zip(lanes, LANES, strict=True)])
    return rows.select("conv", "depth", "words", "ends", node_key(F.col("depth"), lanes).alias("key"), parent.alias("parent"), *also)


def rebuilt_prefixes(turns: DataFrame, head: Column | None, base: Column | None) -> tuple[DataFrame, DataFrame]:
    """Prefixes (conv, depth, words, ends, key, parent) of all conversations, and the conversations (conv, n_turns), both stored.

    Each conversation is rebuilt: the first `head` turns of the conversation `base`, both expressions of conv, then its own
    turns after its first `head`. Without them it is as it was.
    """
    head, base = F.lit(0) if head is None else head, F.col("conv") if base is None else base
    runs = stored(runs_of(turns), "trie-runs")
    convs = runs.select("conv", "total").distinct().withColumns({"h": head.cast("bigint"), "base": base})
    placed = turns.join(runs, ["conv", "part"]).withColumn("place", F.col("at") - F.col("first") + F.col("before") + 1)
    most = convs.agg(F.max("h")).first()[0] or 0
    firsts = placed.filter(F.col("place") <= most).select(F.col("conv").alias("base"), "place", "digest", "words")
    heads = convs.join(firsts, "base").filter("place <= h")
    heads = stored(heads.select("conv", "total", "h", F.col("place").alias("depth"), "words", *lanes_of(F.col("place"), F.col("digest"))), "trie-heads")
    got = heads.groupBy("conv").agg(F.count(F.lit(1)).alias("m"), *[F.sum(n).alias(f"h{n}") for n in LANES])
    own = F.greatest(F.col("total") - F.col("h"), F.lit(0))
    convs = convs.join(got, "conv", "left").na.fill(0, ["m", *[f"h{n}" for n in LANES]]).select("conv", "h", "m", (F.col("m") + own).alias("n_turns"), *[f"h{n}" for n in LANES])
    convs = stored(convs, "trie-convs")
    # own turns after the head; a conversation's figures go by range, so its turns are not dealt by conversation
    tail = turns.join(runs.join(convs, "conv"), ["conv", "part"]).withColumn("place", F.col("at") - F.col("first") + F.col("before") + 1).filter("place > h")
    depth = F.col("place") - F.col("h") + F.col("m")
    tail = tail.withColumn("depth", depth).select("conv", "part", "at", "depth", "words", (F.col("depth") == F.col("n_turns")).alias("ends"), *[f"h{n}" for n in LANES], *lanes_of(F.col("depth"), F.col("digest")))
    tail = stored(tail, "trie-tail")
    sums = tail.groupBy("conv", "part").agg(*[F.sum(n).alias(n) for n in LANES])
    earlier = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("conv", "part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"b{n}") for n in LANES])
    upto = W.partitionBy("conv", "part").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    running = tail.join(sums, ["conv", "part"]).withColumns({f"r{n}": F.sum(n).over(upto) + F.col(f"b{n}") + F.col(f"h{n}") for n in LANES})
    tails = _keyed(running, [F.col(f"r{n}") for n in LANES])
    short = W.partitionBy("conv").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)  # at most `head` turns
    first = heads.join(convs.select("conv", "n_turns"), "conv").withColumn("ends", F.col("depth") == F.col("n_turns"))
    first = first.withColumns({f"r{n}": F.sum(n).over(short) for n in LANES})
    prefixes = stored(tails.unionByName(_keyed(first, [F.col(f"r{n}") for n in LANES])), "trie-prefixes")
    lengths = stored(convs.select("conv", "n_turns"), "trie-lengths")
    release(runs, heads, convs, tail)
    return prefixes, lengths


def trie_nodes(prefixes: DataFrame, lengths: DataFrame) -> DataFrame:
    """(key, parent, conv_id, depth, n_convs, words, n_children) of every node, the root included; stored."""
    nodes = prefixes.groupBy("key").agg(F.min("parent").alias("parent"), F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"))
    root = lengths.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(root_key().alias("key"), F.lit(None).cast("binary").alias("parent"), "conv_id", F.lit(0).cast("bigint").alias("depth"), "n_convs", F.lit(0).cast("bigint").alias("words"))
    nodes = stored(nodes.select(root.columns).unionByName(root), "trie-bare")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    out = stored(nodes.join(children, "key", "left").na.fill(0, ["n_children"]), "trie-nodes")
    release(nodes)
    return out


def root_key() -> Column:
    return node_key(F.lit(0), [F.lit(0)] * len(LANES))


def rolled_up(nodes: DataFrame) -> DataFrame:
    """(key, n_leaves, saved_tokens): sums over the subtree of every node, in as many rounds as the depth has binary digits."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    own = nodes.select("key", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals, jumps = stored(own, "trie-totals"), stored(nodes.filter("parent is not null").select("key", F.col("parent").alias("jump")), "trie-jumps")
    for _ in range(math.ceil(math.log2(deepest + 1))):
        sent = jumps.join(totals, "key").groupBy(F.col("jump").alias("key")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        new = totals.join(sent, "key", "left").select("key", (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"))
        further = jumps.join(jumps.select(F.col("key").alias("jump"), F.col("jump").alias("next")), "jump").select("key", F.col("next").alias("jump"))
        before = (totals, jumps)
        totals, jumps = stored(new, "trie-totals"), stored(further, "trie-jumps")
        release(*before)
    release(jumps)
    return totals


def ends_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of rows (key, conv): SHA-256 of a node's conversations in ascending order, joined by commas.

    Sorted ranges of (node, conversation) are joined to pieces of at most PIECE numbers, and a node's pieces go in order through
    one digest, so no list of a node is held anywhere, however many conversations are alike.
    """

    def pieces(batches):
        key, first, held = None, 0, []

        def close():
            return pa.RecordBatch.from_pylist([{"key": key, "first": first, "piece": ",".join(held)}], schema=pa.schema([("key", pa.binary()), ("first", pa.int64()), ("piece", pa.string())]))

        for b in batches:
            for k, c in zip(b.column("key").to_pylist(), b.column("conv").to_pylist(), strict=True):
                if k != key or len(held) == PIECE:
                    if held:
                        yield close()
                    key, first, held = k, c, []
                held.append(str(c))
        if held:
            yield close()

    def digests(batches):
        key, sha = None, None
        rows: list[dict] = []
        schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
        for b in batches:
            for k, piece in zip(b.column("key").to_pylist(), b.column("piece").to_pylist(), strict=True):
                if k != key:
                    if sha:
                        rows.append({"key": key, "ends_sha256": sha.hexdigest()})
                    key, sha = k, hashlib.sha256(piece.encode())
                else:
                    sha.update(b"," + piece.encode())
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows = []
        if sha:
            yield pa.RecordBatch.from_pylist([{"key": key, "ends_sha256": sha.hexdigest()}], schema=schema)

    rows = ends.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(pieces, "key binary, first bigint, piece string")
    return rows.repartition("key").sortWithinPartitions("key", "first").select("key", "piece").mapInArrow(digests, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", head: Column | None = None, base: Column | None = None) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node; identifiers must
    be integers. head and base, expressions of the column conv, rebuild conversations first, see rebuilt_prefixes."""
    turns = ordered_turns(conversations, id_col, turn_col, role_col, text_col)
    prefixes, lengths = rebuilt_prefixes(turns, head, base)
    release(turns)
    nodes = trie_nodes(prefixes, lengths)
    totals = rolled_up(nodes)
    bare = lengths.filter("n_turns = 0").select(root_key().alias("key"), F.col("conv").cast("bigint").alias("conv"))
    ends = stored(ends_digests(prefixes.filter("ends").select("key", F.col("conv").cast("bigint").alias("conv")).unionByName(bare)), "trie-ends")
    release(prefixes, lengths)
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    rows = nodes.join(totals, "key").join(ends, "key", "left").join(parents, "parent", "left")
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def shared_heads(conversations: DataFrame) -> DataFrame:
    """The trie of conversations rebuilt from shared beginnings: conversation c starts with the first crc32(c) % 4 turns of
    conversation c - c % 20."""
    conv = F.col("conv")
    return prefix_trie(conversations, head=F.crc32(conv.cast("string").cast("binary")) % 4, base=conv - conv % 20)


def shared_heads_sql() -> str:
    """The same over the view `conversations`, by whole prefixes instead of digests and pointers."""
    crc = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(c::varchar) + 1), lambda i: ascii(substr(c::varchar, i, 1))::bigint)),
                lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384::bigint))), 4294967295::bigint)"""
    word = "[^ \\t\\n\\x0B\\f\\r]+"
    return f"""
        with t as (select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
        o as (select c, list({{'role': role, 'text': text}} order by turn nulls first, role, text) as ts from t group by c),
        k as (select c, ts, {crc} % 4 as h from o),
        r as (select k.c, coalesce(b.ts[1:k.h], k.ts[1:0]) || k.ts[k.h + 1:] as ts from k left join o b on b.c = k.c - k.c % 20),
        p as (select c, len(ts) as l, ts, unnest(range(0, len(ts) + 1)) as d from r),
        n as materialized (select d, path, min(c) as conv_id, count(*) as n_convs, coalesce(string_agg(c::varchar, ',' order by c) filter (l = d), '') as ends from (select c, l, d, ts[1:d] as path from p) group by d, path),
        q as (select u.*, v.conv_id as parent_conv_id, case when u.d > 0 then len(regexp_extract_all(u.path[u.d].text, '{word}')) else 0 end as words from n u left join n v on v.d = u.d - 1 and v.path = u.path[1:u.d - 1]),
        kids as (select path[1:d - 1] as path, d - 1 as d, count(*) as n from n where d > 0 group by all),
        z as (select q.*, coalesce(kids.n, 0) as n_children from q left join kids on kids.d = q.d and kids.path = q.path),
        s as (select k as d, path[1:k] as path, sum((n_children = 0)::int)::bigint as n_leaves, sum((n_convs - 1) * words)::bigint as saved_tokens from (select *, unnest(range(0, d + 1)) as k from z) group by all)
        select conv_id, z.d as depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) as ends_sha256 from z join s on s.d = z.d and s.path = z.path"""
