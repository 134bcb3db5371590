"""The registered queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromalith.functions import columns as C
from chromalith.operators import compartments, contacts, features, graphs, intervals, loops, matrices, metrics, model, segments, training
from chromalith.plans.views import table, view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
BIN = 20_000
R6 = 6


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return add


def r6(df: DataFrame, *names: str) -> DataFrame:
    """The named columns rounded to six places; -0.0 becomes 0.0."""
    return df.withColumns({n: F.round(F.col(n).cast("double"), R6) + F.lit(0.0) for n in names})


def _contacts(spark, d):
    return view(spark, d, "v_contacts").withColumnRenamed("cnt", "count")


def _sizes(spark, d):
    return view(spark, d, "v_chrom_sizes")


def _matrix(spark, d):
    return contacts.bin_contacts(contacts.filter_contacts(_contacts(spark, d)), _sizes(spark, d), BIN)


def _dims(spark, d, m=None):
    return contacts.dims(m if m is not None else _matrix(spark, d), _sizes(spark, d), BIN)


# ---- shared SQL ----
FILTERED = """filtered as (select cell_id, chr1, least(coord1, coord2) as coord1, chr2, greatest(coord1, coord2) as coord2, sum(cnt) as cnt from v_contacts
    where chr1 not in ('chrX', 'chrY') and chr2 not in ('chrX', 'chrY') and chr1 = chr2 and coord1 <> coord2 group by all)"""
MATRIX = f"""{FILTERED}, nb as (select chrom, cast(size // {BIN} + 1 as int) as n_bins from v_chrom_sizes),
    bb as (select cell_id, chr1 as chrom, coord1 // {BIN} as a, coord2 // {BIN} as b, cnt from filtered),
    m as (select cell_id, chrom, i, j, sum(v) as v from (select cell_id, chrom, a as i, b as j, cnt as v from bb union all select cell_id, chrom, b, a, cnt from bb) join nb using (chrom) where i < n_bins and j < n_bins group by all),
    dims as (select distinct cell_id, chrom, n_bins from m join nb using (chrom))"""
DEGREE = f"{MATRIX}, deg as (select cell_id, chrom, i as bin, sum(v)::double as deg from m group by all)"
LDP = f"""{DEGREE}, prof as (select m.cell_id, m.chrom, m.i as bin, avg(d.deg) as nb_mean, min(d.deg) as nb_min, max(d.deg) as nb_max, stddev_pop(d.deg) as nb_std
        from m join deg d on m.cell_id = d.cell_id and m.chrom = d.chrom and m.j = d.bin group by all),
    nodes as (select cell_id, chrom, unnest(range(0, n_bins))::int as bin from dims),
    ldp as (select n.cell_id, n.chrom, n.bin, coalesce(deg, 0) as deg, coalesce(nb_mean, 0) as nb_mean, coalesce(nb_min, 0) as nb_min, coalesce(nb_max, 0) as nb_max, coalesce(nb_std, 0) as nb_std
        from nodes n left join deg using (cell_id, chrom, bin) left join prof using (cell_id, chrom, bin))"""
EDGES = f"{MATRIX}, pos as (select cell_id, chrom, i as src, j as dst from m where i < j)"


def _round(name: str, alias: str | None = None) -> str:
    return f"round({name}, {R6}) + 0.0 as {alias or name}"


# ---- contacts ----
@query(f"with {FILTERED} select cell_id, chr1, coord1, chr2, coord2, cnt::bigint as cnt from filtered")
def contacts_filtered(spark, d):
    return contacts.filter_contacts(_contacts(spark, d)).withColumnRenamed("count", "cnt")


@query(f"with {MATRIX} select cell_id, chrom, i::int as i, j::int as j, v::bigint as v from m")
def contacts_binned(spark, d):
    return _matrix(spark, d)


@query(f"with {MATRIX} select count(*) as n, sum(case when t.v is null or t.v <> m.v then 1 else 0 end)::bigint as asymmetric from m left join m t on m.cell_id = t.cell_id and m.chrom = t.chrom and m.i = t.j and m.j = t.i")
def contacts_symmetric(spark, d):
    m = _matrix(spark, d)
    t = m.select("cell_id", "chrom", F.col("i").alias("j"), F.col("j").alias("i"), F.col("v").alias("t"))
    j = m.join(t, ["cell_id", "chrom", "i", "j"], "left")
    return j.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("t").isNull() | (F.col("t") != F.col("v")), 1).otherwise(0)).alias("asymmetric"))


@query(f"with {FILTERED}, t as (select cell_id, sum(cnt)::bigint as total from filtered group by 1) select cell_id, total from t where total >= 2000")
def cell_qc(spark, d):
    c = contacts.filter_contacts(_contacts(spark, d))
    return contacts.cell_totals(c).filter("total >= 2000")


@query(f"with {MATRIX} select cell_id, chrom, count(*) as nnz, sum(v)::bigint as total, sum(case when i = j then v else 0 end)::bigint as diagonal from m group by all")
def matrix_inspect(spark, d):
    return contacts.inspect_matrix(_matrix(spark, d))


@query(f"with {MATRIX} select cell_id, chrom, n_bins as n_rows, n_bins as n_cols, count(*) as nnz from m join dims using (cell_id, chrom) group by all")
def matrix_shapes(spark, d):
    m = _matrix(spark, d)
    return contacts.matrix_shapes(m, _dims(spark, d, m))


@query(f"with {MATRIX} select distinct cell_id, chrom from m semi join (select cell_id, chr1 as chrom from v_contacts where cnt > 49) x using (cell_id, chrom)")
def cells_in_both(spark, d):
    from chromalith.sources.readers import cells_in_both as both

    return both(_matrix(spark, d), _contacts(spark, d).filter("count > 49").select("cell_id", F.col("chr1").alias("chrom")))


@query(f"with {EDGES} select cell_id, chrom, src::int as src, dst::int as dst, src::bigint * 101 + dst as key from pos")
def edge_keys(spark, d):
    e = graphs.canonical_edges(_edges(spark, d)).withColumn("key", C.edge_key(F.col("src"), F.col("dst"), F.lit(101)))
    src, dst = C.edge_of_key(F.col("key"), F.lit(101))
    return e.select("cell_id", "chrom", src.cast("int").alias("src"), dst.cast("int").alias("dst"), "key")


@query("""with f as (select fend, concat('chr', chr) as chr, coord from v_fends), a as (select cell_id, fend1, fend2, cast(cnt as bigint) as cnt from v_adj where regexp_full_match(cnt, '[0-9]+')),
    j as (select cell_id, x.chr as chr1, x.coord as c1, y.chr as chr2, y.coord as c2, cnt from a join f x on fend1 = x.fend join f y on fend2 = y.fend)
    select cell_id, chr1 as chrom, sum(cnt)::bigint as total, count(*) as n from j where chr1 = chr2 and chr1 not in ('chrX', 'chrY') and c1 <> c2 group by all""")
def fend_mapped_contacts(spark, d):
    adj = view(spark, d, "v_adj").withColumnRenamed("cnt", "count")
    fends = view(spark, d, "v_fends").withColumn("chr", C.with_chr(F.col("chr")))
    c = contacts.cis_ordered(contacts.map_fends(contacts.numeric_counts(adj), fends))
    return c.groupBy("cell_id", F.col("chr1").alias("chrom")).agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("n"))


@query(f"""with p as (select cell_id, chr1 as chrom, coord1 // {BIN} as a, coord2 // {BIN} as b, sum(cnt) as v from v_contacts where chr1 = chr2 and chr1 not in ('chrX', 'chrY', 'chrM') group by all),
    q as (select cell_id, chrom, a as i, b as j, v from p where a <> b union all select cell_id, chrom, b, a, v from p where a <> b)
    select cell_id, chrom, count(*) as n, sum(v)::bigint as total from q group by all""")
def pixels_symmetrized(spark, d):
    c = _contacts(spark, d).filter("chr1 = chr2")
    p = c.groupBy("cell_id", F.col("chr1").alias("chrom"), F.floor(F.col("coord1") / BIN).alias("bin1"), F.floor(F.col("coord2") / BIN).alias("bin2")).agg(F.sum("count").alias("count"))
    return contacts.symmetrize_pixels(p).groupBy("cell_id", "chrom").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


# ---- features ----
@query(f"with {DEGREE} select cell_id, chrom, bin::int as bin, deg from deg")
def node_degree(spark, d):
    return features.node_degree(_matrix(spark, d))


@query(f"with {LDP} select cell_id, chrom, bin, deg, {', '.join(_round(c) for c in features.PROFILE[1:])} from ldp")
def ldp_raw(spark, d):
    m = _matrix(spark, d)
    return r6(features.ldp_raw(m, _dims(spark, d, m)), *features.PROFILE[1:])


_NORM = ", ".join(f"(ln(1 + {c}) - min(ln(1 + {c})) over w) / case when max(ln(1 + {c})) over w = min(ln(1 + {c})) over w then 1 else max(ln(1 + {c})) over w - min(ln(1 + {c})) over w end as {c}" for c in features.PROFILE)


@query(f"with {LDP}, nrm as (select cell_id, chrom, bin, {_NORM} from ldp window w as (partition by cell_id, chrom)) select cell_id, chrom, bin, {', '.join(_round(c) for c in features.PROFILE)} from nrm")
def ldp_norm(spark, d):
    m = _matrix(spark, d)
    return r6(features.ldp(m, _dims(spark, d, m)), *features.PROFILE)


@query(f"with {LDP} select cell_id, chrom, bin, deg as f0, {_round('nb_mean', 'f1')}, (bin % 7)::double as f2, length(chrom)::double as f3 from ldp")
def feature_merge(spark, d):
    m = _matrix(spark, d)
    feat = features.ldp_raw(m, _dims(spark, d, m)).select("cell_id", "chrom", "bin", F.array("deg", "nb_mean").alias("feat"))
    bins = _sizes(spark, d).select("chrom", F.explode(F.sequence(F.lit(0), contacts.n_bins(F.col("size"), BIN) - 1)).alias("bin"))
    shared = bins.select("chrom", (F.col("bin") + 1).alias("bin"), F.array((F.col("bin") % 7).cast("double"), F.length("chrom").cast("double")).alias("emb"))
    return r6(features.spread(features.merge_features(feat, shared, first_bin=1, strict=False), "feat", ["f0", "f1", "f2", "f3"]), "f1")


_BINS = "s as (select chrom, sequence, length(sequence) as n, unnest(range(0, cast(ceil(length(sequence) / 500) as int)))::int as k from v_seq), b as (select chrom, k + 1 as bin, substring(sequence, cast(k * 500 + 1 as int), 500) as sequence, k * 500 as start, least(k * 500 + 500, n) as \"end\" from s)"


@query(f"with {_BINS} select chrom, bin, sequence, start::bigint as start, \"end\"::bigint as \"end\" from b")
def dna_bins(spark, d):
    return features.dna_bins(view(spark, d, "v_seq"), 500)


@query(f"""with {_BINS}, c as (select chrom, bin, length(sequence) - length(regexp_replace(sequence, '[ACGTacgt]', '', 'g')) as base, length(sequence) - length(regexp_replace(sequence, '[GCgc]', '', 'g')) as gcs from b)
    select chrom, bin, round(case when base > 0 then gcs / base else 0.0 end, 6) + 0.0 as gc from c""")
def gc_content(spark, d):
    return r6(features.gc_content(features.dna_bins(view(spark, d, "v_seq"), 500)).select("chrom", "bin", "gc"), "gc")


@query(f"with {_BINS.replace('500', '5000')} select chrom, count(*) as n, md5(string_agg(sequence, '|' order by bin)) as digest from b group by chrom")
def sequences_by_chrom(spark, d):
    bins = features.dna_bins(view(spark, d, "v_seq"), 5000)
    got = features.sequences_by_chrom(bins.select("chrom", F.col("bin").alias("position"), "sequence"), exclude=())
    return got.select(F.substring("chrom", 4, 99).alias("chrom"), F.size("sequences").cast("long").alias("n"), F.md5(F.array_join("sequences", "|")).alias("digest"))


@query()
def kmer_embedding(spark, d):
    return features.kmer_embedding(features.dna_bins(view(spark, d, "v_seq"), 5000), 2)


# ---- graphs ----
def _edges(spark, d):
    return _matrix(spark, d).select("cell_id", "chrom", F.col("i").alias("src"), F.col("j").alias("dst"))


@query(f"with {EDGES} select cell_id, chrom, src::int as src, dst::int as dst from pos")
def edges_canonical(spark, d):
    return graphs.canonical_edges(_edges(spark, d))


@query(f"with {EDGES} select cell_id, chrom, src::int as src, dst::int as dst from pos")
def edges_normalized(spark, d):
    return graphs.normalized_edges(_edges(spark, d))


@query(f"with {EDGES} select cell_id, chrom, count(*) as n from pos where dst - src between 2 and 20 group by all")
def edges_distance(spark, d):
    return graphs.by_distance(graphs.canonical_edges(_edges(spark, d)), 2, 20).groupBy("cell_id", "chrom").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {MATRIX}, c as (select cell_id, chrom, n_bins, unnest(range(0, n_bins)) as src from dims), p as (select cell_id, chrom, src, unnest(range(src + 2, least(src + 20, n_bins - 1) + 1)) as dst from c)
    select cell_id, chrom, count(*) as n, sum(src * 1000 + dst)::bigint as checksum from p group by all""")
def candidate_pairs(spark, d):
    p = graphs.candidate_pairs(_dims(spark, d))
    return p.groupBy("cell_id", "chrom").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("src").cast("long") * 1000 + F.col("dst")).alias("checksum"))


@query(f"""with {MATRIX}, r as (select distinct chrom1 as chrom, x1 // {BIN} as i, y1 // {BIN} as j from v_ref_loops)
    select cell_id, chrom, i::int as i, j::int as j from dims join r using (chrom) where i < n_bins and j < n_bins""")
def ref_loop_lookup(spark, d):
    r = view(spark, d, "v_ref_loops").select(F.col("chrom1").alias("chrom"), F.floor(F.col("x1") / BIN).cast("int").alias("i"), F.floor(F.col("y1") / BIN).cast("int").alias("j")).distinct()
    return graphs.reference_loops(_dims(spark, d), r)


_REFS_BY_GROUP = f"r as (select distinct chrom1 as chrom, case when x1 % 20000 = 0 then 'Neuron' else 'ODC' end as grp, x1 // {BIN} as i, y1 // {BIN} as j from v_ref_loops), g as (select cell_id, chrom, n_bins, case when cast(substr(cell_id, 2) as int) % 2 = 0 then 'Neuron' else 'ODC' end as grp from dims)"


def _ref_loops_by_group(spark, d):
    dims = _dims(spark, d)
    r = view(spark, d, "v_ref_loops").select(F.col("chrom1").alias("chrom"), graphs.loop_group(F.when(F.col("x1") % 20000 == 0, "Sst").otherwise("ODC")).alias("group"), F.floor(F.col("x1") / BIN).cast("int").alias("i"), F.floor(F.col("y1") / BIN).cast("int").alias("j")).distinct()
    g = dims.withColumn("group", graphs.loop_group(F.when(F.substring("cell_id", 2, 9).cast("int") % 2 == 0, "Vip").otherwise("ODC")))
    return dims, graphs.reference_loops(g, r)


@query(f"with {MATRIX}, {_REFS_BY_GROUP} select cell_id, chrom, i::int as i, j::int as j from g join r using (chrom, grp) where i < n_bins and j < n_bins")
def ref_loops_by_group(spark, d):
    return _ref_loops_by_group(spark, d)[1]


@query(f"""with {MATRIX}, {_REFS_BY_GROUP}, u as (select distinct cell_id, chrom from g join r using (chrom, grp) where i < n_bins and j < n_bins)
    select (select count(*) from dims) as n_graphs, (select count(*) from u) as n_used, round((select count(*) from u) / (select count(*) from dims), 6) as coverage""")
def loop_coverage(spark, d):
    return r6(loops.loop_coverage(*_ref_loops_by_group(spark, d)), "coverage")


@query("with t as (select cell_type, row_number() over (order by cell_type) - 1 as y from (select distinct cell_type from v_labels)) select cell_id, cell_type, y::int as y from v_labels join t using (cell_type)")
def label_index(spark, d):
    return contacts.label_index(view(spark, d, "v_labels"))


@query("""with t as (select cell_type, row_number() over (order by cell_type) - 1 as y from (select distinct cell_type from v_label_lines)),
    k as (select cell_id, arg_max(cell_type, position) as cell_type from v_label_lines group by 1)
    select cell_id, cell_type, y::int as y from k join t using (cell_type)""")
def label_index_last_wins(spark, d):
    return contacts.label_index(view(spark, d, "v_label_lines"))


@query("select cell_type, count(distinct cell_id) as n_cells from v_label_lines group by 1")
def label_counts(spark, d):
    return contacts.label_counts(view(spark, d, "v_label_lines"))


@query("""with t as (select cell_type, row_number() over (order by cell_type) - 1 as y from (select distinct cell_type from v_labels)), e as (select concat('C', cast(vec_id as string)) as cell_id, vec_id as position, embedding[1]::double as x from embeddings)
    select cell_id, position, round(x, 6) + 0.0 as x, cell_type, y::int as y from e join v_labels using (cell_id) join t using (cell_type)""")
def embeddings_with_labels(spark, d):
    e = table(spark, d, "embeddings").select(F.concat(F.lit("C"), F.col("vec_id").cast("string")).alias("cell_id"), F.col("vec_id").alias("position"), F.element_at("embedding", 1).cast("double").alias("x"))
    return r6(contacts.embeddings_with_labels(e, view(spark, d, "v_labels")), "x")


_FILES = "f as (select distinct cell_id || '_' || chr1 || '.pt' as file, cell_id from v_contacts)"
_SPLIT = f"""{_FILES}, c as (select distinct cell_id from f), k as (select cell_id, cell_type, row_number() over (partition by cell_type order by md5(cell_id || ':42'), cell_id) as rk, count(*) over (partition by cell_type) as n from c join v_labels using (cell_id)),
    s as (select file, f.cell_id, case when rk <= round_even(n * 0.2, 0) then 'val' else 'train' end as split from f left join k on f.cell_id = k.cell_id)"""


def _split_files(spark, d):
    files = _contacts(spark, d).select(F.concat("cell_id", F.lit("_"), "chr1", F.lit(".pt")).alias("file"), "cell_id").distinct()
    return graphs.split_files(files, view(spark, d, "v_labels"))


@query(f"with {_SPLIT} select file, cell_id, split from s")
def split_files(spark, d):
    return _split_files(spark, d)


@query(f"""with {_SPLIT} select count(*) as n_total_files, count(*) filter (split = 'train') as n_train_files, count(*) filter (split = 'val') as n_val_files,
    count(distinct cell_id) as n_total_cells, count(distinct cell_id) filter (split = 'train') as n_train_cells, count(distinct cell_id) filter (split = 'val') as n_val_cells from s""")
def split_counts(spark, d):
    return graphs.split_counts(_split_files(spark, d))


@query("""with t as (select cell_type, row_number() over (order by cell_type) - 1 as y from (select distinct cell_type from v_labels)), c as (select distinct cell_id from v_contacts)
    select cell_id, coalesce(cell_type, 'unknown') as cell_type, coalesce(y, -1)::int as y from c left join (select * from v_labels join t using (cell_type)) using (cell_id)""")
def label_attach(spark, d):
    return contacts.attach_labels(_contacts(spark, d).select("cell_id").distinct(), view(spark, d, "v_labels"))


@query(f"""with {EDGES}, q as (select cell_id, chrom, cast(floor(count(*) * 0.7::double) as int) as quota from pos group by all),
    c as (select cell_id, chrom, n_bins, unnest(range(0, n_bins)) as src from dims), p as (select cell_id, chrom, src, unnest(range(src + 5, least(src + 40, n_bins - 1) + 1)) as dst from c),
    f as (select p.* from p anti join pos using (cell_id, chrom, src, dst)),
    k as (select *, (((src * 48271 + dst * 69621 + 1) % 2147483647 * 16807) % 2147483647 * 48271 + dst) % 2147483647 as h from f),
    r as (select *, row_number() over (partition by cell_id, chrom order by h, src, dst) as rk from k)
    select cell_id, chrom, src::int as src, dst::int as dst from r join q using (cell_id, chrom) where rk <= quota""")
def neg_near_hashrank(spark, d):
    m = _matrix(spark, d)
    pos = graphs.canonical_edges(m.select("cell_id", "chrom", F.col("i").alias("src"), F.col("j").alias("dst")))
    return graphs.near_negatives(pos, _dims(spark, d, m), low=5, high=40)


@query()
def neg_mixed(spark, d):
    m = _matrix(spark, d)
    pos = graphs.canonical_edges(m.select("cell_id", "chrom", F.col("i").alias("src"), F.col("j").alias("dst")))
    return graphs.mixed_negatives(pos, _dims(spark, d, m), low=5, high=40)


@query("""with r as (select cell_id, cell_type, row_number() over (partition by cell_type order by md5(cell_id || ':42'), cell_id) as rk, count(*) over (partition by cell_type) as n from v_labels)
    select cell_id, cell_type, case when rk <= round_even(n * 0.2, 0) then 'val' else 'train' end as split from r""")
def split_hash(spark, d):
    return graphs.split_by_hash(view(spark, d, "v_labels"))


@query(f"with {FILTERED} select cell_id, count(*) as n from filtered semi join v_labels using (cell_id) group by 1")
def semi_cells(spark, d):
    c = contacts.filter_contacts(_contacts(spark, d))
    return c.join(view(spark, d, "v_labels"), "cell_id", "left_semi").groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))


@query("select distinct cell_id from v_contacts anti join v_labels using (cell_id)")
def anti_missing(spark, d):
    return _contacts(spark, d).select("cell_id").distinct().join(view(spark, d, "v_labels"), "cell_id", "left_anti")


# ---- matrices ----
@query(f"""with {MATRIX}, z as (select cell_id, chrom, i, sum(v) as r from m group by all)
    select m.cell_id, m.chrom, m.i::int as i, m.j::int as j, {_round('m.v / sqrt(a.r * b.r)', 'v')} from m join z a on m.cell_id = a.cell_id and m.chrom = a.chrom and m.i = a.i join z b on m.cell_id = b.cell_id and m.chrom = b.chrom and m.j = b.i""")
def sqrtvc(spark, d):
    return r6(matrices.sqrt_vc(_matrix(spark, d), symmetric=True).select("cell_id", "chrom", "i", "j", "v"), "v")


@query(f"""with {MATRIX}, t as (select avg(t) as target from (select sum(v) as t from m group by cell_id))
    select cell_id, chrom, i::int as i, j::int as j, {_round('v / sum(v) over (partition by cell_id, chrom) * target', 'v')} from m, t""")
def coverage_scale(spark, d):
    return r6(matrices.scale_to_target(_matrix(spark, d)), "v")


@query(f"with {MATRIX} select chrom, i::int as i, j::int as j, count(*) as cells, sum(v)::double as v from m where i < j group by all")
def upper_triangle(spark, d):
    return matrices.upper_features(_matrix(spark, d)).groupBy("chrom", "i", "j").agg(F.count(F.lit(1)).alias("cells"), F.sum("v").alias("v"))


@query(f"with {MATRIX}, u as (select * from m where i < j) select a.chrom, a.cell_id as c1, b.cell_id as c2, sum(a.v * b.v)::double as g from u a join u b on a.chrom = b.chrom and a.i = b.i and a.j = b.j where a.cell_id <= b.cell_id group by all")
def gram(spark, d):
    return matrices.gram(matrices.upper_features(_matrix(spark, d)))


@query(f"""with {MATRIX}, s as (select cell_id, sum(t) as total_contacts, string_agg(chrom, ',' order by chrom) as used_chroms, count(*) as n from (select cell_id, chrom, sum(v) as t from m where chrom in ('chr1', 'chr2', 'chr3') group by all) group by 1)
    select cell_id, case when coalesce(total_contacts, 0) <= 0 then 'skip_empty_or_broken' when n < 3 then 'skip_missing_chrom' else 'ok' end as status, coalesce(total_contacts, 0)::bigint as total_contacts, coalesce(used_chroms, '') as used_chroms
    from (select distinct cell_id from v_contacts) left join s using (cell_id)""")
def cell_status(spark, d):
    return matrices.cell_status(_contacts(spark, d), _matrix(spark, d), ["chr1", "chr2", "chr3"])


@query(f"""with {MATRIX}, s as (select cell_id, sum(t) as total_contacts, string_agg(chrom, ',' order by chrom) as used_chroms, count(*) as n, bool_or(chrom = 'chr3') as unmasked from (select cell_id, chrom, sum(v) as t from m where chrom in ('chr1', 'chr2', 'chr3') group by all) group by 1)
    select cell_id, case when coalesce(total_contacts, 0) <= 0 then 'skip_empty_or_broken' when unmasked then 'skip_mask_missing' else 'ok' end as status, coalesce(total_contacts, 0)::bigint as total_contacts, coalesce(used_chroms, '') as used_chroms
    from (select distinct cell_id from v_contacts) left join s using (cell_id)""")
def cell_status_masked(spark, d):
    return matrices.cell_status(_contacts(spark, d), _matrix(spark, d), ["chr1", "chr2", "chr3"], allow_missing=True, masked=["chr1", "chr2"])


@query("select cell_id, k::int as k, round(avg(z[k + 1]::double), 6) + 0.0 as v from (select cell_id, z, unnest(range(0, 64)) as k from v_z) group by cell_id, k")
def cell_embedding_mean(spark, d):
    e = view(spark, d, "v_z").select("cell_id", F.concat(F.lit("chr"), "bin").alias("chrom"), F.transform("z", lambda x: x.cast("double")).alias("g"))
    out = model.cell_embeddings(e).select("cell_id", F.posexplode("emb").alias("k", "v"))
    return r6(out, "v")


@query("""with e as (select vec_id, embedding[1]::double as x1, embedding[2]::double as x2 from embeddings), s as (select avg(x1) as a1, stddev_pop(x1) as s1, avg(x2) as a2, stddev_pop(x2) as s2 from e)
    select vec_id, round((x1 - a1) / s1, 6) + 0.0 as x1, round((x2 - a2) / s2, 6) + 0.0 as x2 from e, s""")
def scaler(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.element_at("embedding", 1).cast("double").alias("x1"), F.element_at("embedding", 2).cast("double").alias("x2"))
    return r6(matrices.standard_scaler(e, ["x1", "x2"]), "x1", "x2")


@query()
def svd_embedding(spark, d):
    return matrices.svd_embedding(matrices.upper_features(matrices.normalized(_matrix(spark, d), symmetric=True)), 10, 10)


@query()
def pca(spark, d):
    return matrices.pca(table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x")), 3).select("vec_id", "pc")


@query()
def kmeans(spark, d):
    return matrices.kmeans(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x")), 10).select("vec_id", "cluster")


# ---- losses and model ----
@query("""with p as (select a.vec_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as c from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
    select e.vec_id, round(coalesce(1 - c, 0), 6) + 0.0 as loss from embeddings e left join p on e.vec_id = p.vec_id""")
def cosine_loss(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    t = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("target"))
    return r6(e.join(t, "vec_id", "left").select("vec_id", training.cosine_loss(F.col("embedding"), F.col("target")).alias("loss")), "loss")


@query("""with s as (select graph, y, (score - 250) / 100.0::double as x from v_scores), l as (select graph, avg(case when y = 1 then ln(1 + exp(-x)) end) as pos, avg(case when y = 0 then ln(1 + exp(x)) end) as neg from s group by 1)
    select graph, round(coalesce(pos, 0), 6) as pos, round(coalesce(neg, 0), 6) as neg, round(coalesce(pos, 0) + coalesce(neg, 0), 6) as total from l""")
def bce_loss(spark, d):
    s = view(spark, d, "v_scores").select(F.col("graph").alias("cell_id"), F.lit("c").alias("chrom"), "y", ((F.col("score") - 250) / 100.0).alias("logit"))
    return r6(training.bce_losses(s).select(F.col("cell_id").alias("graph"), "pos", "neg", "total"), "pos", "neg", "total")


@query(f"""with {LDP}, pos as (select cell_id, chrom, i as src, j as dst from m where i < j), din as (select cell_id, chrom, dst as bin, count(*) as k from pos group by all),
    x as (select l.cell_id, l.chrom, l.bin, l.deg, coalesce(k, 0) + 1.0::double as dd from ldp l left join din using (cell_id, chrom, bin)),
    s as (select p.cell_id, p.chrom, p.dst as bin, sum(x.deg / sqrt(x.dd)) as sm from pos p join x on p.cell_id = x.cell_id and p.chrom = x.chrom and p.src = x.bin group by all)
    select cell_id, chrom, bin, {_round('coalesce(sm, 0) / sqrt(dd) + deg / dd', 'x')} from x left join s using (cell_id, chrom, bin)""")
def gcn_one_hop(spark, d):
    m = _matrix(spark, d)
    nodes = features.all_nodes(_dims(spark, d, m)).join(features.node_degree(m), ["cell_id", "chrom", "bin"], "left").select("cell_id", "chrom", "bin", F.coalesce("deg", F.lit(0.0)).alias("x"))
    return r6(model.gcn_one_hop(nodes, m.select("cell_id", "chrom", F.col("i").alias("src"), F.col("j").alias("dst"))), "x")


def _graphs(spark, d):
    m = _matrix(spark, d)
    feat = features.as_features(features.ldp(m, _dims(spark, d, m)))
    return model.graph_rows(feat, m.select("cell_id", "chrom", F.col("i").alias("src"), F.col("j").alias("dst")), _dims(spark, d, m))


_PARAMS = model.init_params(model.ModelConfig(5, 32, 8, target_dim=10, loop_dim=8))


@query()
def gcn_encode(spark, d):
    return model.node_vectors(model.encode_graphs(_graphs(spark, d), _PARAMS))


@query()
def cell_embeddings(spark, d):
    return model.cell_embeddings(model.encode_graphs(_graphs(spark, d), _PARAMS))


@query()
def loop_predict(spark, d):
    return loops.to_bedpe(model.score_pairs(_graphs(spark, d), _PARAMS), BIN, 0.5)


@query()
def recon_auc(spark, d):
    """Positives against as many mixed negatives, stored as validation has them."""
    s = model.score_edges(_graphs(spark, d), _PARAMS, neg_mixed(spark, d))
    s = s.select(F.concat_ws("/", "cell_id", "chrom").alias("graph"), "y", F.col("logit").alias("score"))
    n = s.groupBy("graph").agg(F.sum("y").alias("n_pos"), F.sum(1 - F.col("y")).alias("n_neg"))
    return metrics.auc(s).join(metrics.average_precision(s), "graph").join(n, "graph")


@query(f"""with {EDGES}, q as (select cell_id, chrom, cast(floor(count(*) * 0.7::double) as int) as near, count(*) as want, any_value(n_bins) as n_bins from pos join dims using (cell_id, chrom) group by all),
    r as (select q.*, (n_bins::bigint * (n_bins - 1)) // 2 - want as room from q)
    select cell_id, chrom, want, least(want, room) as got, least(near, want) as quota from r where room >= 2 * want""")
def neg_mixed_counts(spark, d):
    """Mixed negatives of graphs with room: as many as positives, the near share among them, none of them positive or double."""
    m = _matrix(spark, d)
    pos = graphs.canonical_edges(m.select("cell_id", "chrom", F.col("i").alias("src"), F.col("j").alias("dst")))
    dims = _dims(spark, d, m)
    near = graphs.near_negatives(pos, dims, low=5, high=40).groupBy("cell_id", "chrom").agg(F.count(F.lit(1)).alias("quota"))
    neg = graphs.negatives_for("train", pos, dims, low=5, high=40).join(pos, ["cell_id", "chrom", "src", "dst"], "left_anti").distinct()
    got = neg.groupBy("cell_id", "chrom").agg(F.count(F.lit(1)).alias("got"))
    want = pos.groupBy("cell_id", "chrom").agg(F.count(F.lit(1)).alias("want")).join(dims, ["cell_id", "chrom"])
    n = F.col("n_bins").cast("long")
    want = want.filter(n * (n - 1) / 2 - F.col("want") >= 2 * F.col("want"))
    return want.join(got, ["cell_id", "chrom"]).join(near, ["cell_id", "chrom"], "left").select("cell_id", "chrom", "want", "got", F.coalesce("quota", F.lit(0)).alias("quota"))


@query(f"""with {EDGES}, q as (select cell_id, chrom, count(*) as want, any_value(n_bins) as n from pos join dims using (cell_id, chrom) group by all),
    r as (select q.*, (n::bigint * (n - 1)) // 2 - want as room from q)
    select cell_id, chrom, want, least(want, room) as got, true as near_share_met, true as clean from r""")
def neg_mixed_whole(spark, d):
    """Mixed negatives of every graph, dense ones too: as many as wanted or as there is room for; whether the mix has its near share, and
    only free pairs, each once."""
    m = _matrix(spark, d)
    pos = graphs.canonical_edges(m.select("cell_id", "chrom", F.col("i").alias("src"), F.col("j").alias("dst")))
    dims = _dims(spark, d, m)
    key = ["cell_id", "chrom"]
    near = F.col("dst") - F.col("src")
    n = F.col("n_bins").cast("bigint")
    top = F.least(F.lit(40), n - 1)
    band = F.when(top >= 5, (top - 4) * (2 * n - 5 - top) / 2).otherwise(0).cast("bigint")
    want = pos.groupBy(*key).agg(F.count(F.lit(1)).alias("want"), F.count(F.when(near.between(5, 40), 1)).alias("taken")).join(dims, key)
    want = want.select(*key, "want", "n_bins", F.least(F.floor(F.col("want") * 0.7), band - F.col("taken")).alias("share"))
    neg = graphs.mixed_negatives(pos, dims, low=5, high=40).join(pos.withColumn("hit", F.lit(1)), [*key, "src", "dst"], "left")
    ok = F.col("hit").isNull() & (F.col("src") >= 0) & (near > 0)
    got = neg.groupBy(*key).agg(F.count(F.lit(1)).alias("got"), F.count(F.when(near.between(5, 40), 1)).alias("near"), F.count_distinct(F.when(ok, F.struct("src", "dst"))).alias("sound"), F.max("dst").alias("last"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return want.join(got, key, "left").select(*key, "want", zero("got").alias("got"), (zero("near") >= F.col("share")).alias("near_share_met"), ((zero("sound") == zero("got")) & (zero("last") < F.col("n_bins"))).alias("clean"))


# ---- metrics ----
@query("""with r as (select *, rank() over (partition by graph order by score) + (count(*) over (partition by graph, score) - 1) / 2.0 as rk from v_scores)
    select graph, round((sum(case when y = 1 then rk else 0 end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) as auc from r group by 1""")
def auc(spark, d):
    return r6(metrics.auc(view(spark, d, "v_scores")), "auc")


@query("""with c as (select graph, score, count(*) as n, sum(y) as p from v_scores group by all), w as (select *, sum(p) over (partition by graph order by score desc) as tp, sum(n) over (partition by graph order by score desc) as seen from c)
    select graph, round(sum(p * tp / seen) / sum(p), 6) as ap from w group by 1""")
def ap(spark, d):
    return r6(metrics.average_precision(view(spark, d, "v_scores")), "ap")


@query("""with r as (select *, rank() over (partition by graph order by score) + (count(*) over (partition by graph, score) - 1) / 2.0 as rk from v_scores),
    a as (select graph, (sum(case when y = 1 then rk else 0 end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) as auc from r group by 1),
    c as (select graph, score, count(*) as n, sum(y) as p from v_scores group by all), w as (select *, sum(p) over (partition by graph order by score desc) as tp, sum(n) over (partition by graph order by score desc) as seen from c),
    b as (select graph, sum(p * tp / seen) / sum(p) as ap from w group by 1) select round(avg(auc), 6) as mean_auc, round(avg(ap), 6) as mean_ap, count(*) as n_graphs from a join b using (graph)""")
def auc_ap_summary(spark, d):
    s = view(spark, d, "v_scores")
    return r6(metrics.mean_summary(metrics.auc(s).join(metrics.average_precision(s), "graph")), "mean_auc", "mean_ap")


def _pairs(spark, d):
    return view(spark, d, "v_clusters").select("pred", F.col("true_label").cast("int").alias("true"))


@query('with f as (select unnest(range(0, 10))::int as a), g as (select f.a as p, h.a as t from f, f h) select p as pred, t as "true", count(vec_id) as n from g left join v_clusters on pred = p and true_label = t group by all')
def confusion(spark, d):
    return metrics.confusion(_pairs(spark, d), 10)


_CONT = "c as (select pred, true_label as t, count(*)::double as n from v_clusters group by all), a as (select pred, sum(n) as n from c group by 1), b as (select t, sum(n) as n from c group by 1), tot as (select sum(n) as t from c)"


@query(f"""with {_CONT}, s as (select (select sum(n * (n - 1) / 2) from c) as ij, (select sum(n * (n - 1) / 2) from a) as a, (select sum(n * (n - 1) / 2) from b) as b, (select t * (t - 1) / 2 from tot) as m)
    select round((ij - a * b / m) / ((a + b) / 2 - a * b / m), 6) + 0.0 as ari from s""")
def ari(spark, d):
    return r6(metrics.ari(_pairs(spark, d)), "ari")


@query(f"""with {_CONT}, mi as (select sum(c.n / tot.t * ln(c.n * tot.t / (a.n * b.n))) as mi from c join a using (pred) join b on c.t = b.t, tot),
    hp as (select -sum(n / t * ln(n / t)) as hp from a, tot), ht as (select -sum(n / tot.t * ln(n / tot.t)) as ht from b, tot)
    select round(2 * mi / (hp + ht), 6) as nmi, round(mi / ht, 6) as homogeneity, round(mi / hp, 6) as completeness from mi, hp, ht""")
def nmi_v_hom_comp(spark, d):
    return r6(metrics.information(_pairs(spark, d)), "nmi", "homogeneity", "completeness")


@query("""with p as (select a.vec_id, a.label as l, b.label as o, list_distance(a.embedding::double[], b.embedding::double[]) as dist from embeddings a, embeddings b where a.vec_id <> b.vec_id),
    s as (select vec_id, l, o, sum(dist) as s, count(*) as n from p group by all),
    v as (select vec_id, max(case when l = o then s / n end) as a, min(case when l <> o then s / n end) as b from s group by 1)
    select round(avg(case when a is null then 0 else (b - a) / greatest(a, b) end), 6) + 0.0 as silhouette from v""")
def silhouette(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("cluster"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return r6(metrics.silhouette(e), "silhouette")


@query(f"""with {_CONT}, mi as (select sum(c.n / tot.t * ln(c.n * tot.t / (a.n * b.n))) as mi from c join a using (pred) join b on c.t = b.t, tot),
    hp as (select -sum(n / t * ln(n / t)) as hp from a, tot), ht as (select -sum(n / tot.t * ln(n / tot.t)) as ht from b, tot),
    k as (select a.n as x, b.n as y, tot.t as n, unnest(range(greatest(1, (a.n + b.n - tot.t)::bigint), least(a.n, b.n)::bigint + 1))::double as k from a, b, tot),
    e as (select sum(k / n * ln(n * k / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1) + lgamma(n - y + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(n - x - y + k + 1))) as emi from k)
    select round((mi - emi) / ((hp + ht) / 2 - emi), 6) + 0.0 as ami from mi, hp, ht, e""")
def ami(spark, d):
    return r6(spark.createDataFrame([(float(metrics.ami(_pairs(spark, d))),)], "ami double"), "ami")


@query()
def ami_hungarian(spark, d):
    p = _pairs(spark, d)
    return spark.createDataFrame([(float(metrics.ami(p)), float(metrics.hungarian_accuracy(p)))], "ami double, hungarian_acc double")


# ---- loops ----
@query("""with r as (select distinct chrom1, x1, y1 from v_ref_loops), p as (select distinct cell_id, chrom1, x1, y1 from v_pred_loops), o as (select unnest(range(-2, 3)) * 10000 as s),
    e as (select distinct chrom1, x1 + a.s as x1, y1 + b.s as y1 from r, o a, o b where x1 + a.s >= 0 and y1 + b.s >= 0),
    h as (select cell_id, count(*) as n_pred, count(e.x1) as hits from p left join e using (chrom1, x1, y1) group by 1),
    q as (select distinct cell_id, chrom1, x1 + a.s as x1, y1 + b.s as y1 from p, o a, o b where x1 + a.s >= 0 and y1 + b.s >= 0),
    f as (select cell_id, count(*) as hit_ref from q semi join r using (chrom1, x1, y1) group by 1),
    z as (select cell_id, n_pred, (select count(*) from r) as n_ref, hits / n_pred as p, coalesce(hit_ref, 0) / (select count(*) from r) as r from h left join f using (cell_id))
    select cell_id, n_pred, n_ref, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1 from z""")
def loop_slack_pr(spark, d):
    return r6(loops.evaluate(view(spark, d, "v_pred_loops"), view(spark, d, "v_ref_loops")), "precision", "recall", "f1")


@query("""with r as (select distinct chrom1, x1, y1 from v_ref_loops), p as (select distinct cell_id, chrom1, x1, y1 from v_pred_loops where cell_id < 'C3'), o as (select unnest(range(-2, 3)) * 10000 as s),
    e as (select distinct chrom1, x1 + a.s as x1, y1 + b.s as y1 from r, o a, o b where x1 + a.s >= 0 and y1 + b.s >= 0),
    h as (select cell_id, count(*) as n_pred, count(e.x1) as hits from p left join e using (chrom1, x1, y1) group by 1),
    q as (select distinct cell_id, chrom1, x1 + a.s as x1, y1 + b.s as y1 from p, o a, o b where x1 + a.s >= 0 and y1 + b.s >= 0),
    f as (select cell_id, count(*) as hit_ref from q semi join r using (chrom1, x1, y1) group by 1), c as (select distinct cell_id from v_contacts union select cell_id from p),
    z as (select cell_id, coalesce(n_pred, 0) as n_pred, (select count(*) from r) as n_ref, coalesce(hits / n_pred, 0) as p, coalesce(hit_ref, 0) / (select count(*) from r) as r from c left join h using (cell_id) left join f using (cell_id))
    select cell_id, n_pred, n_ref, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1 from z""")
def loop_pr_of_all_cells(spark, d):
    pred = view(spark, d, "v_pred_loops").filter("cell_id < 'C3'")
    return r6(loops.evaluate(pred, view(spark, d, "v_ref_loops"), cells=_contacts(spark, d).select("cell_id")), "precision", "recall", "f1")


@query("select cell_id, chrom1, x1, y1, count(*) as n from v_pred_loops where abs(y1 // 10000 - x1 // 10000) between 2 and 100 group by all")
def loops_intra_distance(spark, d):
    return loops.intra_by_distance(view(spark, d, "v_pred_loops"), 10_000).groupBy("cell_id", "chrom1", "x1", "y1").agg(F.count(F.lit(1)).alias("n"))


# ---- intervals ----
_LAB = "lab as (select cell_id, chrom, b as bin, cast(floor(b / 5) + (b % 11) // 10 as int) as label from v_votes)"


def _labels(spark, d):
    b = F.col("b")
    return view(spark, d, "v_votes").select("cell_id", "chrom", b.alias("bin"), (F.floor(b / 5) + F.floor((b % 11) / 10)).cast("int").alias("label"))


@query(f"with {_LAB}, n as (select *, lead(label) over (partition by cell_id, chrom order by bin) as nl from lab) select cell_id, chrom, bin::int as bin from n where nl is not null and nl <> label")
def boundaries(spark, d):
    return intervals.boundaries(_labels(spark, d))


@query(f"""with {_LAB}, n as (select *, case when lag(label) over w is not distinct from label then 0 else 1 end as c from lab window w as (partition by cell_id, chrom order by bin)),
    r as (select *, sum(c) over (partition by cell_id, chrom order by bin) as run from n)
    select cell_id, chrom, min(label)::int as label, min(bin)::int as first_bin, max(bin)::int as last_bin, min(bin)::bigint * 10000 as start, (max(bin) + 1)::bigint * 10000 as "end" from r group by cell_id, chrom, run""")
def run_length_tlds(spark, d):
    return intervals.run_length(_labels(spark, d), 10_000)


def _votes(spark, d):
    v = view(spark, d, "v_votes")
    return v, v.groupBy("chrom").agg(F.countDistinct("cell_id").alias("k")), v.groupBy("chrom").agg((F.max("b") + 1).alias("n_bins"))


_FRAC = "kk as (select chrom, count(distinct cell_id) as k, max(b) + 1 as n_bins from v_votes group by 1), fr as (select chrom, b, count(distinct cell_id) as votes, count(distinct cell_id) / max(k) as frac from v_votes join kk using (chrom) where b >= 0 and b < n_bins - 1 group by all)"


@query(f"with {_FRAC} select chrom, b::int as b, votes, round(frac, 6) as frac from fr")
def vote_frac(spark, d):
    return r6(intervals.vote_fractions(*_votes(spark, d)), "frac")


@query(f"with {_FRAC}, bb as (select chrom, unnest(range(0, n_bins)) as b from kk) select chrom, b::bigint * 10000 as start, (b + 1)::bigint * 10000 as \"end\", round(coalesce(frac, 0), 6) as value from bb left join fr using (chrom, b)")
def vote_bedgraph(spark, d):
    v, k, n = _votes(spark, d)
    return r6(intervals.vote_track(intervals.vote_fractions(v, k, n), n, 10_000), "value")


@query()
def nms_consensus(spark, d):
    return intervals.consensus_peaks(intervals.vote_fractions(*_votes(spark, d)), 0.04, 3)


@query(f"""with {_FRAC}, pk as (select chrom, b from fr where b % 25 = 7), g as (select chrom, coalesce(lag(b) over (partition by chrom order by b), -1) + 1 as a, b from pk
    union all select kk.chrom, coalesce(m + 1, 0), n_bins - 1 from kk left join (select chrom, max(b) as m from pk group by 1) using (chrom))
    select chrom, a::bigint * 10000 as start, (b + 1)::bigint * 10000 as "end" from g where a <= b""")
def consensus_intervals(spark, d):
    v, k, n = _votes(spark, d)
    peaks = intervals.vote_fractions(v, k, n).filter("b % 25 = 7").select("chrom", "b")
    return intervals.consensus_intervals(peaks, n, 10_000)


@query()
def vote_consensus_intervals(spark, d):
    _, _, n = _votes(spark, d)
    return intervals.consensus_intervals(nms_consensus(spark, d), n, 10_000)


_CTCF = "mid as (select concat('chr', cast(l_linenumber as string)) as chrom, (l_extendedprice::bigint * 37) % 3000000 as mid from lineitem), ctr as (select distinct chrom1 as chrom, x1 as center from v_ref_loops)"


def _ctcf(spark, d):
    pts = table(spark, d, "lineitem").select(F.concat(F.lit("chr"), F.col("l_linenumber").cast("string")).alias("chrom"), ((F.bround("l_extendedprice").cast("long") * 37) % 3000000).alias("mid"))
    return view(spark, d, "v_ref_loops").select(F.col("chrom1").alias("chrom"), F.col("x1").alias("center")).distinct(), pts


@query(f"with {_CTCF} select c.chrom, center, count(mid) as n from ctr c left join mid m on c.chrom = m.chrom and m.mid between center - 5000 and center + 5000 group by all")
def ctcf_window_count(spark, d):
    return intervals.window_counts(*_ctcf(spark, d), 5000)


@query(f"""with {_CTCF}, n as (select c.chrom, center, count(mid) as n from ctr c left join mid m on c.chrom = m.chrom and m.mid between center - 5000 and center + 5000 group by all),
    v as (select chrom, n, count(*) as m from n group by all), t as (select a.chrom, a.n, coalesce(sum(b.m) filter (b.n < a.n), 0) as m0, coalesce(sum(b.m * b.n) filter (b.n < a.n), 0) as s0, sum(b.m) as mm, sum(b.m * b.n) as ss from v a join v b on a.chrom = b.chrom group by a.chrom, a.n),
    g as (select chrom, n, case when m0 > 0 then s0 * s0 / m0 + (ss - s0) * (ss - s0) / (mm - m0) else -1 end as gain from t)
    select chrom, arg_max(n, (gain, -n)) as threshold from g group by 1""")
def two_means_threshold(spark, d):
    return intervals.two_means(intervals.window_counts(*_ctcf(spark, d), 5000), ("chrom",))


# ---- compartments ----
_CO = "p as (select 'E' || (vec_id % 5) as cell_id, 'chr1' as chrom, cast(vec_id // 5 as int) as bin, 1 / (1 + exp(-embedding[1]::double * 4)) as p0 from embeddings)"
_COARSE = f"{_CO}, q as (select cell_id, chrom, bin // 10 as g, bin * 10000 as s, bin * 10000 + 10000 as e, ((bin * 37) % 100) / 100.0::double as gc, p0 from p), co as (select cell_id, chrom, g, min(s) as start, max(e) as \"end\", avg(gc) as gc, avg(p0) as p0, avg(1 - p0) as p1 from q group by all)"


def _proba(spark, d):
    p = C.sigmoid(F.element_at("z", 1).cast("double") * 4)
    return view(spark, d, "v_z").select("cell_id", "chrom", "bin", F.array(p, 1 - p).alias("proba"))


def _coarse(spark, d):
    n = table(spark, d, "embeddings").agg((F.max(F.expr("vec_id div 5")) + 1).alias("n"))
    size = n.select(F.lit("chr1").alias("chrom"), (F.col("n") * 10_000).alias("size"))
    bins = compartments.chrom_bins(size, 10_000)
    gc = bins.select("chrom", "start", "end", ((F.col("bin") * 37) % 100 / 100.0).alias("gc"))
    return compartments.coarsen(_proba(spark, d), bins, gc, 10)


@query(f"with {_COARSE} select cell_id, chrom, g::int as g, start::bigint as start, \"end\"::bigint as \"end\", round(gc, 6) as gc, round(p0, 6) as p0 from co")
def coarsen(spark, d):
    c = _coarse(spark, d)
    return r6(c.select("cell_id", "chrom", "g", "start", "end", "gc", F.col("proba")[0].alias("p0")), "gc", "p0")


_STATE = f"{_COARSE}, st as (select cell_id, chrom, case when coalesce(avg(case when p0 >= p1 then gc end), -1e9) >= coalesce(avg(case when p0 < p1 then gc end), -1e9) then 0 else 1 end as a from co group by all)"


@query(f"with {_STATE} select cell_id, chrom, a::int as a from st")
def choose_a_state(spark, d):
    return compartments.a_state(_coarse(spark, d))


@query(f"with {_STATE} select cell_id, chrom, start::bigint as start, \"end\"::bigint as \"end\", round(case when a = 0 then p0 - p1 else p1 - p0 end, 6) + 0.0 as score from co join st using (cell_id, chrom)")
def compartment_scores(spark, d):
    return r6(compartments.scores(_coarse(spark, d)), "score")


def _compart(spark, d):
    return view(spark, d, "v_compart").select("cell_id", "chrom", F.col("start_bp").cast("long").alias("start"), (F.col("start_bp") + 1000).cast("long").alias("end"), F.floor("score").cast("double").alias("score"))


@query("select chrom, start_bp::bigint as start, (start_bp + 1000)::bigint as \"end\", round(avg(floor(score)), 6) as score from v_compart group by all")
def compartment_consensus(spark, d):
    return r6(compartments.consensus(_compart(spark, d)), "score")


@query("select (substr(cell_id, 2)::int % 4)::int as cluster, chrom, start_bp::bigint as start, (start_bp + 1000)::bigint as \"end\", round(avg(floor(score)), 6) as score from v_compart group by all")
def cluster_consensus(spark, d):
    c = _compart(spark, d)
    clusters = c.select("cell_id").distinct().withColumn("cluster", F.substring("cell_id", 2, 9).cast("int") % 4)
    return r6(compartments.cluster_consensus(c, clusters), "score")


# ---- sequential ----
@query()
def hac_segments(spark, d):
    return segments.hac_segments(view(spark, d, "v_z"), 10)


@query()
def tad_pipeline(spark, d):
    lab = segments.hac_segments(view(spark, d, "v_z"), 10).persist()
    b = intervals.boundaries(lab)
    cells = lab.groupBy("chrom").agg(F.countDistinct("cell_id").alias("k"))
    n = lab.groupBy("chrom").agg((F.max("bin") + 1).alias("n_bins"))
    peaks = intervals.consensus_peaks(intervals.vote_fractions(b.withColumnRenamed("bin", "b"), cells, n), 0.3, 3)
    return intervals.consensus_intervals(peaks, n, 10_000)


@query()
def hmm_posterior(spark, d):
    z = view(spark, d, "v_z")
    return segments.hmm_posterior(z, segments.fit_hmm(z, pca_dim=4))


@query()
def train_step(spark, d):
    t = training.train(_graphs(spark, d), _PARAMS, training.TrainConfig())
    return spark.createDataFrame([(h["epoch"], float(h["train"])) for h in t.history], "epoch int, loss double")


@query()
def finetune_loops(spark, d):
    """From the first parameters on, all graphs with their reference loops and their cell's embedding as target; the encoder is frozen."""
    g = training.with_loops(_graphs(spark, d), _ref_loops_by_group(spark, d)[1])
    z = view(spark, d, "v_z").groupBy("cell_id").agg(F.array(*[F.avg(F.element_at("z", k + 1)).cast("double") for k in range(10)]).alias("emb"))
    cells = g.select("cell_id").distinct().withColumn("of", F.concat(F.lit("E"), (F.substring("cell_id", 2, 9).cast("int") % 5).cast("string")))
    g = training.with_targets(g, cells.join(z.withColumnRenamed("cell_id", "of"), "of"))
    t = training.train(g, _PARAMS, replace(training.FINETUNE, frozen=("norm", "gcn")))
    names = ["train", "train_pos", "train_neg", "train_cosine", "train_loop_pos", "train_loop_neg", "train_loop_coverage"]
    return spark.createDataFrame([(h["epoch"], *(float(h[n]) for n in names)) for h in t.history], "epoch int, " + ", ".join(f"{n} double" for n in names))


# ---- streams, as a batch ----
@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by all")
def windowed_votes(spark, d):
    from chromalith.streaming.incremental import windowed_votes as votes

    return votes(table(spark, d, "events")).withColumn("total", F.round("total", 2))


@query("""with v as (select distinct date_trunc('hour', ts) as start, event_type as chrom, (floor(value)::bigint % 50)::int as b, user_id from events)
    select start, chrom, b, count(*) as votes from v where start + interval 1 hour <= (select max(ts) - interval 1 hour from events) group by all""")
def votes_streamed(spark, d):
    """Votes by state that the watermark clears, over the events as a stream; windows that are over by the watermark."""
    from chromalith.streaming.votes import votes_so_far

    schema = table(spark, d, "events").schema
    # a stream reads folders, so a table that is one file is named by a pattern
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("chrom"), F.col("user_id").cast("string").alias("cell_id"), (F.floor("value") % 50).cast("int").alias("b"))
    return votes_so_far(rows).select(F.col("start").cast("timestamp_ntz").alias("start"), "chrom", "b", "votes")


# ---- text keys ----
@query("select distinct cell_id || '_chr' || (length(cell_id) % 3 + 1) || '.pt' as name, cell_id as cell, 'chr' || (length(cell_id) % 3 + 1) as chrom from v_contacts")
def graph_names(spark, d):
    from chromalith.sources.readers import graph_keys

    n = _contacts(spark, d).select(F.concat("cell_id", F.lit("_chr"), (F.length("cell_id") % 3 + 1).cast("string"), F.lit(".pt")).alias("name")).distinct()
    cell, chrom = graph_keys(F.col("name"))
    return n.select("name", cell.alias("cell"), chrom.alias("chrom"))


@query("with r as (select cell_id, cell_type, row_number() over (partition by cell_type order by cell_id desc) as rk from v_labels) select cell_type, cell_id from r where rk = 1")
def last_wins(spark, d):
    rows = view(spark, d, "v_labels").withColumn("position", F.col("cell_id"))
    return contacts.last_wins(rows, "cell_type", "position").select("cell_type", "cell_id")
