"""N-gram Jaccard join by T-occurrence search.

Words are runs of [^\\x20\\x09-\\x0D] with A-Z lower-cased; a document's set holds its distinct k-word shingles,
as 64-bit hashes; with fewer words the whole sequence is one; without words the set is empty and links with
nothing. Documents link when 100 * intersection >= percent * union.

1. A sketch of word counts over the whole corpus gives every shingle a rarity, and all documents the same order
   of shingles, rarest first. A link's two sets then share a shingle in their prefixes; of it, sizes and
   positions bound the overlap.
2. Documents with equal sets are one class and go on as one representative.
3. Prefix postings meet by shingle, and the shingles that two prefixes share are counted: what lies beyond the
   prefix that ends first can add no more than the rest of its set, so a link needs about 7 % of the set's
   size there. Lists of more than LIST_PAIRS members, also while still on the map side, are linked in a star, which
   connects at least as much. Keys are met in SLICES passes, so that a part of the postings is on disk at once. Components of these candidate edges are searched on their own.
4. Within a block of candidate components, inverted lists over the whole sets are searched for each document:
   DivideSkip merges the short lists by a heap (by array counts where they are many) and probes the long ones by
   bisection, and documents reaching the required overlap are linked. Leaders come first: what links to a leader is searched no further among its
   like; then the smaller families of a component are searched against all others. A component too large for a
   block is cut into parts by hash, and every two parts meet in a block of their own.

Null texts count as empty. Rows are known by keys of their own, so identifiers may be of any type, null or repeated; a
component is named by its smallest identifier, null if all are null. An empty table gives no rows. `ngram_components`
reads the identifier and the text only, `keep_one` keeps all columns.
"""

from __future__ import annotations

import bisect
import heapq
import math
import zlib
from array import array
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromalith.llm import _text
from chromalith.llm._store import bound_batches, located, places, release, stored
from chromalith.llm.components import connected_components

SKETCH_BITS = 22
LIST_PAIRS = 64
SLICES = 4
BLOCK_POSTINGS = 500_000
MANY = 2000
SALTS = 16
U = np.uint64


def word_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """log2 of the number of words in each of 2**22 hash buckets, in eighths: a table of 4 MB for any corpus.

    Each task counts into 64 parts of the table; parts are summed as they stream by, first over groups of tasks.
    """
    parts, width = 64, (1 << SKETCH_BITS) // 64
    names = ["part", "counts"]

    def rows(totals):
        return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([zlib.compress(t.astype(np.int64).tobytes(), 1) for t in totals.values()], pa.binary())], names)

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            for _, data, offsets in _text.chunks(batch.column(0)):
                at, n = np.unique(_text.Words(data, offsets).hashes >> U(64 - SKETCH_BITS), return_counts=True)
                total[at.astype(np.int64)] += n.astype(np.int32)
        yield rows({i: total[i * width : (i + 1) * width] for i in range(parts)})
        del total
        _text.give_back()

    def add(batches):
        totals = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = totals.setdefault(part, np.zeros(width, np.int64))
                own += np.frombuffer(zlib.decompress(counts.as_py()), np.int64)
        if totals:
            yield rows(totals)

    kind = "part int, counts binary"
    some = docs.select(F.col(f"`{text_col}`")).mapInArrow(count, kind).select("part", "counts", (F.spark_partition_id() % 16).alias("group"))
    sums = some.repartition("part", "group").select("part", "counts").mapInArrow(add, kind).repartition("part").mapInArrow(add, kind)
    table = np.zeros(1 << SKETCH_BITS, np.uint8)
    for part, counts in sums.collect():  # 64 rows
        own = np.frombuffer(zlib.decompress(counts), np.int64)
        table[part * width : (part + 1) * width] = np.minimum(255, np.round(8 * np.log2(own + 1)))
    return table


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def needed(a: int, b: int, percent: int) -> int:
    """The least overlap of sets of these sizes that is a link."""
    return -(-percent * (a + b) // (100 + percent))


def set_rows(docs: DataFrame, rarity: np.ndarray, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), sig (128 bits of the set) and the prefix: keys of rarity and hash in the common order."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n_out, sig, prefix = [], [], []
            for _, data, offsets in _text.chunks(batch.column(1)):
                words = _text.Words(data, offsets)
                h, at, bounds = _text.shingles(words, k)
                common = rarity[(words.hashes >> U(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint32)
                # a shingle is as rare as its rarest word at least; then the product of its words' counts decides
                low, total = common.copy(), common.copy()
                for i in range(1, min(k, len(common))):
                    low[: len(common) - i] = np.minimum(low[: len(common) - i], common[i:])
                    total[: len(common) - i] += common[i:]
                score = low * np.uint32(4) + np.minimum(total // np.uint32(64 * k), np.uint32(3))
                # 10 bits of rarity, 53 of the hash: never negative
                key = (score[at].astype(U) << U(53)) | (h >> U(11))
                for d in range(len(offsets) - 1):
                    a, b = bounds[d], bounds[d + 1]
                    own, where = np.unique(h[a:b], return_index=True)
                    n = len(own)
                    n_out.append(n)
                    if not n:
                        sig.append((0, 0))
                        prefix.append([])
                        continue
                    sig.append((int(_text.mix(own + U(n)).sum()), int(_text.mix(own ^ U(_text.BASE)).sum())))
                    keys = key[a:b][where]
                    p = prefix_length(n, percent)
                    keys = np.partition(keys, p - 1)[:p] if p < n else keys
                    keys.sort()
                    prefix.append(keys.view(np.int64))
            sig_a = np.array([s[0] for s in sig], U).view(np.int64)
            sig_b = np.array([s[1] for s in sig], U).view(np.int64)
            sizes = np.array([len(p) for p in prefix], np.int32)
            flat = np.concatenate([np.asarray(p, np.int64) for p in prefix]) if len(prefix) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_out, pa.int64()), pa.array(sig_a), pa.array(sig_b), lists], ["id", "n", "sig_a", "sig_b", "prefix"])
        _text.give_back()

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")).mapInArrow(run, f"id {kind}, n bigint, sig_a bigint, sig_b bigint, prefix array<bigint>")


def _stars(order: np.ndarray, starts: np.ndarray, stops: np.ndarray, ids: np.ndarray):
    """Edges from each run's smallest id to its other members."""
    u, v = [], []
    for a, b in zip(starts, stops, strict=True):
        members = ids[order[a:b]]
        low = members.min()
        u.append(np.full(b - a, low))
        v.append(members)
    return (np.concatenate(u), np.concatenate(v)) if u else (np.zeros(0, np.int64), np.zeros(0, np.int64))


POSTING = "key bigint, id bigint, n bigint, last bigint, other bigint"


def postings(reps: DataFrame) -> DataFrame:
    """(key, id, n, last) of every prefix shingle, last being its document's last key, or that of reps if it has one. A map task sorts its postings by key, on disk if
    need be, and of a key of which it has more than LIST_PAIRS only that of the smallest id goes on, with last -1 as the star's
    centre; the star's edges are given out beside it as rows with a null key. So a task gives a key at most LIST_PAIRS rows."""
    names = ["key", "id", "n", "last", "other"]
    none = np.zeros(0, np.int64)

    def edges(u, v):
        pairs = np.unique(np.stack([u, v]), axis=1)
        pairs = pairs[:, pairs[0] != pairs[1]]
        nulls = pa.nulls(pairs.shape[1], pa.int64())
        return pa.RecordBatch.from_arrays([nulls, pa.array(pairs[0]), nulls, nulls, pa.array(pairs[1])], names)

    def posted(rows):
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in rows), pa.nulls(len(rows[0]), pa.int64())], names)

    def run(batches):
        held, hot = [none] * 4, False  # the rows of the last key so far; hot: it is a star, and its centre alone is held
        for batch in batches:
            rows = [np.concatenate((a, batch.column(i).to_numpy())) for i, a in enumerate(held)]
            key, own, _, last = rows
            if not len(key):
                continue
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            stop = np.append(begin[1:], len(key))
            star = stop - begin > LIST_PAIRS
            star[0] |= hot and len(held[0]) > 0
            u, v = _stars(np.arange(len(key)), begin[star], stop[star], own)
            if len(u):
                yield edges(u, v)
            keep = np.ones(len(key), bool)
            for a, b in zip(begin[star], stop[star], strict=True):
                keep[a:b] = False
                low = a + int(np.argmin(own[a:b]))
                keep[low], last[low] = True, -1
            open_ = np.arange(len(key)) >= begin[-1]
            held, hot = [x[keep & open_] for x in rows], bool(star[-1])
            done = keep & ~open_
            if done.any():
                yield posted([x[done] for x in rows])
        if len(held[0]):
            yield posted(held)
        _text.give_back()

    last = F.col("last") if "last" in reps.columns else F.element_at("prefix", -1)
    rows = reps.select(F.explode("prefix").alias("key"), "id", "n", last.alias("last"))
    return rows.sortWithinPartitions("key", "id").mapInArrow(run, POSTING)


def shared_lists(postings: DataFrame) -> DataFrame:
    """(low, star, ms): the members of every key that has more than one, in pieces. A list of more than LIST_PAIRS
    rows, or with a star's centre, is a star; its rows are seen through a window, which spills, and no row of the table
    gathers more than LIST_PAIRS of them."""
    near = postings.filter("key is not null")
    by = W.partitionBy("key").orderBy("id")
    whole = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    seen = near.withColumns({"total": F.count(F.lit(1)).over(whole), "low": F.min("id").over(whole), "star": F.min("last").over(whole) < 0, "nth": F.row_number().over(by)}).filter("total > 1")
    star = F.col("star") | (F.col("total") > LIST_PAIRS)
    piece = F.when(star, F.floor((F.col("nth") - 1) / LIST_PAIRS)).otherwise(0)
    lists = seen.groupBy("key", "low", star.alias("star"), piece.alias("piece")).agg(F.sort_array(F.collect_list(F.struct("n", "id", "last"))).alias("ms"))
    return lists.select("low", "star", "ms")


def list_edges(lists: DataFrame, local: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) whose components hold every link, of lists of shared keys and the stars (u, v) that map tasks made."""
    stars = lists.filter("star").select(F.col("low").alias("u"), F.explode(F.transform("ms", lambda m: m["id"])).alias("v"))
    pair = lists.filter("not star").select("ms", F.posexplode("ms").alias("i", "a"))
    # members are in the order of size: partners of one end where sizes differ too much
    partners = F.expr(f"filter(slice(ms, i + 2, size(ms)), b -> 100 * a.n >= {percent} * b.n)")
    pair = pair.select("a", F.explode(partners).alias("b"))
    pair = pair.groupBy(F.col("a.id").alias("u"), F.col("b.id").alias("v"), F.col("a.n").alias("nu"), F.col("b.n").alias("nv"), F.col("a.last").alias("lu"), F.col("b.last").alias("lv"))
    pair = pair.agg(F.count(F.lit(1)).alias("shared"))
    rest = lambda n: f"({percent} * {n} + 99) div 100 - 1"
    bound = f"shared + case when lu < lv then {rest('nu')} when lu > lv then {rest('nv')} else least({rest('nu')}, {rest('nv')}) end"
    pair = pair.filter(f"{bound} >= ({percent} * (nu + nv) + {99 + percent}) div {100 + percent}").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return stars.unionByName(pair).unionByName(local).filter("u < v").distinct()


def local_stars(postings: DataFrame) -> DataFrame:
    return postings.filter("key is null").select(F.col("id").alias("u"), F.col("other").alias("v"))


def candidate_edges(postings: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The same of postings in one slice, and the stored lists that they are read from."""
    lists = stored(shared_lists(postings), "join-lists")
    return list_edges(lists, local_stars(postings), percent), lists


def sliced_lists(sets: DataFrame, classes: DataFrame, slices: int = SLICES) -> tuple[list[DataFrame], list[DataFrame]]:
    """Stored lists of shared keys and stored stars of map tasks, of one slice of the keys after the other: all rows of a key are in one
    slice, so only the postings of a slice are on disk at once."""
    lists, local = [], []
    chosen = classes.select(F.col("rep").alias("id"), "n", "sig_a", "sig_b")
    for s in range(slices):
        own = sets.withColumns({"last": F.try_element_at("prefix", F.lit(-1)), "prefix": F.expr(f"filter(prefix, k -> pmod(k, {slices}) = {s})")}).filter("size(prefix) > 0")
        reps = own.join(chosen, ["id", "n", "sig_a", "sig_b"], "left_semi").dropDuplicates(["id"])
        posts = stored(postings(reps), "join-postings")
        lists.append(stored(shared_lists(posts), "join-lists"))
        local.append(stored(local_stars(posts), "join-stars"))
        release(posts)
    return lists, local


def divide_skip(lists: list, least: int, skip=None, found=None) -> dict[int, int]:
    """T-occurrence: the numbers that occur in at least `least` of the sorted lists, with their counts.

    The short lists are merged by a heap, or, if they hold many numbers, counted in one array pass; what occurs
    often enough there is probed in the long lists. skip(x) drops a number unseen, found(x, count) hears of each result.
    """
    lists = sorted(lists, key=len)
    longest = len(lists[-1]) if lists else 0
    n_long = min(len(lists), least - 1, int(least / (0.0085 * math.log2(max(2, longest)) + 1))) if longest > 8 else 0
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    enough = least - n_long
    if sum(map(len, short)) > MANY:
        counts = np.bincount(np.concatenate([np.asarray(a) for a in short]))
        at = np.flatnonzero(counts >= enough)
        merged = zip(at.tolist(), counts[at].tolist(), strict=True)
    else:
        merged = ((x, n) for x, n in ((x, sum(1 for _ in same)) for x, same in groupby(heapq.merge(*short))) if n >= enough)
    merged = list(merged)
    if len(merged) > 64 and long:  # many numbers probe a list at once
        at, counts = np.array([x for x, _ in merged]), np.array([n for _, n in merged])
        for left, probe in zip(range(n_long - 1, -1, -1), map(np.asarray, long), strict=True):
            place = np.minimum(np.searchsorted(probe, at), len(probe) - 1)
            counts = counts + (probe[place] == at)
            if left % 8 == 0:
                keep = counts + left >= least
                at, counts = at[keep], counts[keep]
        merged, long, n_long = zip(at.tolist(), counts.tolist(), strict=True), [], 0
    out = {}
    for x, count in merged:
        if skip and skip(x):
            continue
        left = n_long
        for probe in long:
            if count + left < least:
                break
            i = bisect.bisect_left(probe, x)
            count += i < len(probe) and probe[i] == x
            left -= 1
        if count >= least:
            out[int(x)] = int(count)
            if found:
                found(int(x), int(count))
    return out


def search_block(ids: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (forest edges) among documents with these sets; parts: the candidate component of each."""
    m = len(ids)
    size = np.array([len(s) for s in sets])
    order = np.lexsort((ids, size))
    ids, parts, size = ids[order], parts[order], size[order]
    flat = np.concatenate([sets[i] for i in order])
    doc = np.repeat(np.arange(m), size)
    by = np.argsort(flat, kind="stable")
    new = np.concatenate(([True], flat[by][1:] != flat[by][:-1]))
    run = np.cumsum(new) - 1
    counts = np.bincount(run)
    run_of = np.empty(len(flat), np.int64)
    run_of[by] = run
    shared = counts[run_of] > 1  # a list of one member links nothing
    starts = np.concatenate(([0], np.cumsum(size)))
    root = list(range(m))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []

    def link(x, y):
        a, b = find(x), find(y)
        if a != b:
            root[max(a, b)] = min(a, b)
            edges.append((int(ids[x]), int(ids[y])))

    def search(x, lists):
        """Links x, unless it is linked by way of others already."""
        lists = [a for a in lists if len(a)]
        least = -(-percent * int(size[x]) // 100)
        if len(lists) < least:
            return
        near = lambda y, overlap: overlap >= needed(int(size[x]), int(size[y]), percent) and link(x, y)
        divide_skip(lists, least, lambda y: find(int(y)) == find(x), near)

    # leaders: a document that links to a leader joins it and is not indexed itself
    index: dict[int, array] = {}
    leader = np.zeros(m, bool)
    for x in range(m):
        runs = run_of[starts[x] : starts[x + 1]][shared[starts[x] : starts[x + 1]]].tolist()
        before = len(edges)
        search(x, [index[r] for r in runs if r in index])
        if len(edges) == before:
            leader[x] = True
            for r in runs:
                index.setdefault(r, array("q")).append(x)
    # families of one candidate component: the smaller ones against all documents
    roots = np.array([find(x) for x in range(m)])
    family = np.bincount(roots, minlength=m)
    largest: dict[int, int] = {}
    for x in range(m):
        p, r = int(parts[x]), int(roots[x])
        if p not in largest or (family[r], -r) > (family[largest[p]], -largest[p]):
            largest[p] = r
    members = doc[by]
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(flat))
    # leaders have met each other: they meet the others only
    others = members[~leader[members]]
    upto = np.concatenate(([0], np.cumsum(~leader[members])))
    for x in range(m):
        if roots[x] == largest[int(parts[x])]:
            continue
        runs = run_of[starts[x] : starts[x + 1]][shared[starts[x] : starts[x + 1]]]
        if leader[x]:
            search(x, [others[upto[begin[r]] : upto[end[r]]] for r in runs])
        else:
            search(x, [members[begin[r] : end[r]] for r in runs])
    return edges


def verified_edges(docs: DataFrame, blocks: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links among documents of a block. blocks: id, block, part."""
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).join(blocks, "id")

    def search(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        sets = []
        for _, data, offsets in _text.chunks(table["text"]):
            h, _, bounds = _text.shingles(_text.Words(data, offsets), k)
            sets += [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        _, first = np.unique(ids, return_index=True)  # rows of one identifier are one document
        edges = search_block(ids[first], table["part"].to_numpy()[first], [sets[i] for i in first], percent)
        del sets
        _text.give_back()
        return pa.table({"u": pa.array([e[0] for e in edges], pa.int64()), "v": pa.array([e[1] for e in edges], pa.int64())})

    return texts.groupBy("block").applyInArrow(search, "u bigint, v bigint")


def blocks_of(parts: DataFrame, sizes: DataFrame) -> DataFrame:
    """id, block, part for candidate components (id, component): small ones share blocks, a large one is cut."""
    rows = parts.join(sizes, "id")
    load = stored(rows.groupBy("component").agg(F.sum("n").alias("load")), "join-load")
    total = load.agg(F.sum("load")).first()[0] or 0
    shared = max(1, math.ceil(total / BLOCK_POSTINGS))
    rows = rows.join(load, "component")
    small = rows.filter(F.col("load") <= 2 * BLOCK_POSTINGS).select("id", F.pmod(F.xxhash64("component"), F.lit(shared)).cast("string").alias("block"), F.col("component").alias("part"))
    cut = F.ceil(F.col("load") / BLOCK_POSTINGS).cast("int")
    large = rows.filter(F.col("load") > 2 * BLOCK_POSTINGS).select("id", "component", cut.alias("cut"), F.pmod(F.xxhash64("id"), cut.cast("long")).cast("int").alias("own"))
    large = large.select("id", "component", "own", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("with"))
    large = large.select("id", F.concat_ws("-", "component", F.least("own", "with"), F.greatest("own", "with")).alias("block"), F.col("component").alias("part"))
    return small.unionByName(large)


def row_components(docs: DataFrame, k: int, percent: int, id_col: str = "key", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id for every row, a stored table; the identifier must be an integer of the row's own."""
    bound_batches(docs.sparkSession)
    rarity = word_counts(docs, text_col)
    sets = stored(set_rows(docs, rarity, k, percent, id_col, text_col), "join-sets")
    meta = stored(sets.select("id", "n", "sig_a", "sig_b"), "join-meta")
    classes = stored(meta.filter("n > 0").groupBy("n", "sig_a", "sig_b").agg(F.min("id").alias("rep")), "join-classes")
    lists, local = sliced_lists(sets, classes)
    release(sets)  # the prefixes are by far the largest part
    edges = list_edges(reduce(DataFrame.unionByName, lists), reduce(DataFrame.unionByName, local), percent)
    parts = stored(connected_components(edges), "join-parts")
    release(*lists, *local)
    blocks = stored(blocks_of(parts, meta.select("id", "n").dropDuplicates(["id"])), "join-blocks")
    release(parts)
    links = verified_edges(docs, blocks, k, percent, id_col, text_col)
    comps = connected_components(links)
    release(blocks)
    joined = classes.join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    joined = joined.select("n", "sig_a", "sig_b", F.coalesce("component", "rep").alias("component_id"))
    out = meta.join(joined, ["n", "sig_a", "sig_b"], "left")
    out = stored(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")), "join-components")
    release(meta, classes)
    return out


def ngram_components(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id for every row, component_id being the smallest identifier of the component, null if it
    has none."""
    rows = row_keys(located(docs, [id_col, text_col]))
    texts = rows.select("key", F.col(f"doc.`{text_col}`").alias("text"))
    comps = row_components(texts, k, percent).join(rows.select("key", F.col(f"doc.`{id_col}`").alias("id")), "key")
    low = comps.groupBy("component_id").agg(F.min("id").alias("low"))
    return comps.join(low, "component_id").select(F.col("id").alias(id_col), "n_shingles", F.col("low").alias("component_id"))


def row_keys(docs: DataFrame) -> DataFrame:
    """doc (a struct of all columns) and key, a number of the row's own; docs must have places. A key is a hash of the row's file
    and its number there, side by side, so documents are not joined to anything; that no two files have one hash is seen to
    by a count over the files, and another salt is taken if they have."""
    rows = docs.select(F.struct("*").alias("doc"), *places(docs))
    files = stored(rows.groupBy("file").agg(F.max("row").alias("row")), "join-files")
    n, last = files.agg(F.count(F.lit(1)), F.max("row")).first()
    low = max(1, int(last or 0).bit_length())
    high = lambda salt: F.shiftrightunsigned(F.xxhash64(F.lit(salt), "file"), 1 + low)
    salt = next((s for s in range(SALTS) if files.agg(F.count_distinct(high(s))).first()[0] == n), None)
    if salt is None:
        raise RuntimeError(f"{n} files of up to 2**{low} rows: no {SALTS} hashes tell them apart")
    release(files)
    return rows.select("doc", F.shiftleft(high(salt), low).bitwiseOR(F.col("row")).alias("key"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that with the smallest identifier, with all columns.

    Rows are known by keys of their own, so identifiers may be null or repeated: every row is a document with its own
    text. Null identifiers sort first; of equal ones the first row stays.
    """
    rows = row_keys(located(docs, docs.columns))
    texts = rows.select("key", F.col(f"doc.`{id_col}`").alias("id"), F.col(f"doc.`{text_col}`").alias("text"))
    comps = row_components(texts.select("key", "text"), k, percent)
    first = comps.join(texts.select("key", "id"), "key").groupBy("component_id").agg(F.min(F.struct("id", "key")).alias("first"))
    return rows.join(first.select("first.key"), "key", "left_semi").select("doc.*")
