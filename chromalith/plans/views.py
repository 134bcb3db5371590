"""Views over the driver's tables in the shape of the data model, as SQL for Spark and for the comparison engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "v_chrom_sizes": "select concat('chr', c) as chrom, 2000000 as size from (values ('1'),('2'),('3'),('4'),('5'),('6'),('X')) t(c)",
    "v_contacts": """select concat('C', cast(l_suppkey % 50 as string)) as cell_id,
        case when l_linenumber = 7 then 'chrX' else concat('chr', cast(l_linenumber as string)) end as chr1, (l_partkey % 2000) * 1000 as coord1,
        case when l_orderkey % 10 = 0 then 'chr1' when l_linenumber = 7 then 'chrX' else concat('chr', cast(l_linenumber as string)) end as chr2,
        (l_orderkey % 2000) * 1000 as coord2, cast(l_quantity as bigint) as cnt from lineitem""",
    "v_fends": "select cast(p_partkey as string) as fend, case when p_size % 5 = 4 then 'X' else cast(p_size % 5 + 1 as string) end as chr, p_partkey * 500 as coord from part where p_partkey % 50 <> 0",
    "v_adj": """select concat('c', cast(o_custkey % 40 as string)) as cell_id, cast(a.l_partkey as string) as fend1, cast(b.l_partkey as string) as fend2,
        case when a.l_orderkey % 17 = 0 then 'n/a' else cast(cast(a.l_quantity as bigint) as string) end as cnt
        from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber join orders on o_orderkey = a.l_orderkey""",
    "v_labels": "select concat('C', cast(s_suppkey as string)) as cell_id, r_name as cell_type from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where s_suppkey < 45",
    "v_label_lines": "select concat('C', cast(s_suppkey % 30 as string)) as cell_id, r_name as cell_type, s_suppkey as position from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
    "v_scores": "select d.lang as graph, d.doc_id as id, l.quality as y, d.n_chars % 500 as score from documents d join labels l on d.doc_id = l.doc_id",
    "v_votes": "select distinct event_type as chrom, concat('u', cast(user_id as string)) as cell_id, (day(ts) - 1) * 24 + hour(ts) as b from events",
    "v_compart": "select concat('u', cast(user_id as string)) as cell_id, event_type as chrom, ((day(ts) - 1) * 24 + hour(ts)) * 1000 as start_bp, value as score from events",
    "v_ref_loops": """select concat('chr', cast(l_linenumber as string)) as chrom1, (l_partkey % 300) * 10000 as x1, (l_partkey % 300 + l_orderkey % 120) * 10000 as y1
        from lineitem where l_returnflag = 'A' and l_discount > 0.08""",
    "v_pred_loops": """select concat('C', cast(l_suppkey % 50 as string)) as cell_id, concat('chr', cast(l_linenumber as string)) as chrom1, (l_partkey % 300) * 10000 as x1,
        (l_partkey % 300 + l_orderkey % 120) * 10000 + case when l_orderkey % 3 = 0 then 5000 else 0 end as y1 from lineitem where l_returnflag = 'R' and l_discount > 0.05""",
    "v_z": "select concat('E', cast(vec_id % 5 as string)) as cell_id, 'chr1' as chrom, cast(vec_id {div} 5 as int) as bin, embedding as z from embeddings",
    "v_clusters": "select vec_id, label as true_label, {argmax} as pred from embeddings",
    "v_seq": "select concat('d', cast(doc_id as string)) as chrom, text as sequence from documents",
}
SPARK = {"div": "div", "argmax": "cast(array_position(slice(embedding,1,10), array_max(slice(embedding,1,10))) - 1 as int)"}
DUCK = {"div": "//", "argmax": "list_position(embedding[1:10], list_max(embedding[1:10])) - 1"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name].format(**SPARK)
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)


def with_views(sql: str) -> str:
    """The query with the views that it names in front."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    heads = ", ".join(f"{v} as ({VIEWS[v].format(**DUCK)})" for v in used)
    body = sql.strip()
    if not heads:
        return body
    return f"with {heads}, {body[5:]}" if body[:5].lower() == "with " else f"with {heads} {body}"
