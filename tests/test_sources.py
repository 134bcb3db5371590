import numpy as np
import pytest
from pyspark.sql import functions as F

from chromalith.sources import readers, writers


def test_text_readers(spark, tmp_path):
    (tmp_path / "sizes").write_text("# c\nchr1 100\n2\t50\nbad\nchr3 x\n")
    assert sorted(tuple(r) for r in readers.chrom_sizes(spark, str(tmp_path / "sizes")).collect()) == [("chr1", 100), ("chr2", 50)]
    (tmp_path / "m").write_text("a.pt\n\n# no\nb.pt\n")
    assert sorted(r[0] for r in readers.manifest(spark, str(tmp_path / "m")).collect()) == ["a.pt", "b.pt"]
    (tmp_path / "f.fa").write_text(">1 x\nacg\nTT\n>chr2\nAA\n")
    assert sorted(tuple(r) for r in readers.fasta(spark, str(tmp_path / "f.fa")).collect()) == [("chr1", "ACGTT"), ("chr2", "AA")]
    (tmp_path / "r.bedpe").write_text("chr1 1 2 chr1 5 6\n")
    assert tuple(readers.reference_bedpe(spark, str(tmp_path / "r.bedpe")).first()) == ("chr1", 1, 2, "chr1", 5, 6)
    (tmp_path / "bad.bedpe").write_text("chr1 1 2 chr1 5\n")
    with pytest.raises(Exception, match="six columns"):
        readers.reference_bedpe(spark, str(tmp_path / "bad.bedpe")).collect()
    (tmp_path / "l.tsv").write_text("cell_nm\tcell_type\na\tB\nb\tA\na\tC\n")
    assert sorted(tuple(r) for r in readers.labels(spark, str(tmp_path / "l.tsv"), "cell_nm").collect()) == [("a", "C", 2), ("b", "A", 0)]
    (tmp_path / "fends").write_text("f1\t1\t10\nf2\tX\t20\nf1\t2\t30\n")
    assert sorted(tuple(r) for r in readers.fends(spark, str(tmp_path / "fends")).collect()) == [("f1", "chr2", 30), ("f2", "chrX", 20)]
    cell = tmp_path / "base" / "cell1"
    cell.mkdir(parents=True)
    (cell / "adj").write_text("fend1\tfend2\tcount\nf1\tf2\t3\nf1\tf2\t\n")
    assert sorted(tuple(r) for r in readers.raw_contacts(spark, str(tmp_path / "base/*/adj")).collect()) == [("cell1", "f1", "f2", ""), ("cell1", "f1", "f2", "3")]


def test_names(spark):
    df = spark.createDataFrame([("C2_AD008_L5_chr1.pt",), ("1CDX1.128_chr7.pt",)], "n string")
    got = [tuple(r) for r in df.select(*readers.graph_keys(F.col("n"), dots=True)).collect()]
    assert got == [("C2_AD008_L5", "chr1"), ("1CDX1_128", "chr7")]
    one = spark.createDataFrame([("181218_21yr_3_C2_AD008_L5_10kb_contacts",)], "n string")
    assert one.select(readers.mcool_cell_id(F.col("n"))).first()[0] == "C2_AD008_L5"
    with pytest.raises(Exception, match="six parts"):
        spark.createDataFrame([("a_b",)], "n string").select(readers.mcool_cell_id(F.col("n"))).collect()
    z = spark.createDataFrame([("a b.c.chr5.z.npz",), ("a_chr2.npz",)], "n string")
    assert [tuple(r) for r in z.select(*readers.z_keys(F.col("n"))).collect()] == [("a_b_c", "chr5"), ("a", "chr2")]


def test_arrays(spark, tmp_path):
    np.savez(tmp_path / "c1.npz", chr1=np.array([[0.0, 2.0], [2.0, 0.0]]), chr2__data=np.array([7.0]), chr2__indices=np.array([1]), chr2__indptr=np.array([0, 1, 1]), chr2__shape=np.array([2, 2]))
    got = sorted(tuple(r) for r in readers.matrices_npz(spark, str(tmp_path / "c1.npz")).collect())
    assert got == [("c1", "chr1", 0, 1, 2.0), ("c1", "chr1", 1, 0, 2.0), ("c1", "chr2", 0, 1, 7.0)]
    np.savez(tmp_path / "a.chr3.z.npz", z=np.arange(6.0).reshape(3, 2))
    assert [(r.cell_id, r.chrom, r.bin, list(r.z)) for r in readers.z_npz(spark, str(tmp_path / "a.chr3.z.npz")).collect()][2] == ("a", "chr3", 2, [4.0, 5.0])


def test_writers(spark, tmp_path):
    m = spark.createDataFrame([("c", "chr1", 0, 1, 2.0)], "cell_id string, chrom string, i int, j int, v double")
    writers.write_matrices(m, str(tmp_path / "m"))
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        writers.write_matrices(m, str(tmp_path / "m"), overwrite=False)
    with pytest.raises(ValueError, match="no matrix"):
        writers.write_matrices(m.limit(0), str(tmp_path / "e"))
    for _ in range(2):
        writers.write_by_cell(m, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1


def test_streams(spark, tmp_path):
    from chromalith.operators.contacts import bin_contacts, symmetric
    from chromalith.streaming.incremental import stream_matrix, windowed_votes

    rows = [("c", "chr1", 100 * i, "chr1", 37 * i, i + 1) for i in range(40)]
    schema = "cell_id string, chr1 string, coord1 long, chr2 string, coord2 long, count long"
    batch = spark.createDataFrame(rows, schema)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    q = stream_matrix(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 500).writeStream.outputMode("complete").format("memory").queryName("m").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    sizes = spark.createDataFrame([("chr1", 10_000)], "chrom string, size long")
    want = sorted(tuple(r) for r in bin_contacts(batch.filter("coord1 != coord2"), sizes, 500).collect())
    assert sorted(tuple(r) for r in symmetric(spark.table("m")).collect()) == want
    ev = spark.createDataFrame([("a", 1.0, i * 600) for i in range(12)], "event_type string, value double, s long").select(F.timestamp_seconds("s").alias("ts"), "event_type", "value")
    assert sorted(r.n for r in windowed_votes(ev).collect()) == [6, 6]


def test_bin_records_come_back(spark, tmp_path):
    rows = [("chr1", i, "ACGT", 4 * i, 4 * i + 4) for i in (1, 2, 3)] + [("chr2", 1, "AA", 0, 2)]
    bins = spark.createDataFrame(rows, "chrom string, bin int, sequence string, start long, end long")
    for array in (False, True):
        writers.write_dna_bins(bins.repartition(3), str(tmp_path / f"b{array}"), array)
        back = readers.dna_bin_json(spark, str(tmp_path / f"b{array}")).select(bins.columns)
        assert sorted(map(tuple, back.collect())) == sorted(rows)
    (tmp_path / "pretty.json").write_text('[\n {"chrom": "chr1", "bin": 1,\n "sequence": "A", "start": 0, "end": 1}\n]\n')
    assert readers.dna_bin_json(spark, str(tmp_path / "pretty.json")).count() == 1
    (tmp_path / "bad.json").write_text('{\n"chrom": 1}')
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        readers.dna_bin_json(spark, str(tmp_path / "bad.json")).collect()


def test_blank_or_comma_separated_tables(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "c1.csv").write_text("chrom1,x1,x2,chrom2,y1,y2,score\nchr1,1,2,chr1,5,6,0.9\n")
    (tmp_path / "p" / "c2.csv").write_text("x1 x2 chrom1 chrom2\ty1 y2\n3 4 chr2 chr2\t7 8\n")
    (tmp_path / "p" / "c2.F1.csv").write_text("nothing\n1\n")
    got = sorted(map(tuple, readers.predicted_loops(spark, str(tmp_path / "p")).collect()))
    assert got == [("c1", "chr1", 1, 2, "chr1", 5, 6), ("c2", "chr2", 3, 4, "chr2", 7, 8)]
    (tmp_path / "p" / "c3.csv").write_text("a,b\n1,2\n")
    with pytest.raises(Exception, match="missing in"):
        readers.predicted_loops(spark, str(tmp_path / "p")).collect()
    (tmp_path / "gc.tsv").write_text("chrom start end gc x\nchr1 10 20 0.5 9\nchr1 0 10 0.25 9\n")
    assert [tuple(r) for r in readers.gc_table(spark, str(tmp_path / "gc.tsv")).collect()] == [("chr1", 0, 10, 0.25), ("chr1", 10, 20, 0.5)]
    (tmp_path / "last.csv").write_text("chrom,start,end,share\nchr1,0,10,0.75\n")
    assert readers.gc_table(spark, str(tmp_path / "last.csv")).first()["gc"] == 0.75
    (tmp_path / "x.bed").write_text("chr1\t10\t20\tpeak\nchr2\t5\t6\n")
    assert sorted(map(tuple, readers.bed(spark, str(tmp_path / "x.bed")).collect())) == [("chr1", 10, 20), ("chr2", 5, 6)]


def test_files_names_and_chromosomes(spark, tmp_path):
    from chromalith.functions.columns import parse_chroms

    present = spark.createDataFrame([("b.pt",), ("a.pt",), ("x.txt",)], "file string")
    assert [r[0] for r in readers.graph_files(spark, present).collect()] == ["a.pt", "b.pt"]
    names = spark.createDataFrame([("b.pt",)], "file string")
    assert [r[0] for r in readers.graph_files(spark, present, names).collect()] == ["b.pt"]
    writers.write_manifest(present, str(tmp_path / "m"))
    assert [r[0] for r in readers.graph_files(spark, present, manifest_path=str(tmp_path / "m")).collect()] == ["a.pt", "b.pt", "x.txt"]
    with pytest.raises(ValueError, match="exclude each other"):
        readers.graph_files(spark, present, names, "m")
    with pytest.raises(FileNotFoundError, match="z.pt"):
        readers.graph_files(spark, present, spark.createDataFrame([("z.pt",)], "file string"))
    with pytest.raises(ValueError, match="no graph files"):
        readers.graph_files(spark, present.limit(0))
    with pytest.raises(Exception, match="no cell and chromosome"):
        spark.createDataFrame([("plain.npz",)], "n string").select(*readers.z_keys(F.col("n"))).collect()
    seq = spark.createDataFrame([("chr1", "AC"), ("chrX", "GG")], "chrom string, sequence string")
    assert sorted(map(tuple, readers.pick_chroms(seq, ["1", "chrX"]).collect())) == [("chr1", "AC"), ("chrX", "GG")]
    with pytest.raises(Exception, match="no sequence of 7"):
        readers.pick_chroms(seq, ["7"]).collect()
    assert parse_chroms("mm9")[-1] == "chr19" and parse_chroms("hg19", prefix=False)[0] == "1" and parse_chroms("1, chrX 1") == ["chr1", "chrX"]


def test_target_embeddings(spark, tmp_path):
    np.save(tmp_path / "e.npy", np.arange(6.0).reshape(3, 2))
    (tmp_path / "n.txt").write_text("cell_name\nb\n\na\nc\n")
    (tmp_path / "n.csv").write_text("k,cell_name\n0,b\n1,a\n2,c\n")
    for name in ("n.txt", "n.csv"):
        got = sorted(readers.target_embeddings(spark, str(tmp_path / name), str(tmp_path / "e.npy")).collect(), key=lambda r: r.position)
        assert [(r.cell_id, list(r.emb)) for r in got] == [("b", [0, 1]), ("a", [2, 3]), ("c", [4, 5])]
    (tmp_path / "n.txt").write_text("b\na\n")
    with pytest.raises(Exception, match="differ"):
        readers.target_embeddings(spark, str(tmp_path / "n.txt"), str(tmp_path / "e.npy")).collect()


def test_table_writers(spark, tmp_path):
    track = spark.createDataFrame([("chr2", 0, 10, 0.5), ("chr1", 10, 20, 0.25), ("chr1", 0, 10, 1.0)], "chrom string, start long, end long, value double")
    writers.write_bedgraph(track, str(tmp_path / "bg"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "bg")).collect()] == ["chr1\t0\t10\t1.0", "chr1\t10\t20\t0.25", "chr2\t0\t10\t0.5"]
    scores = spark.createDataFrame([("c", "chr1", 0, 10, 1 / 3)], "cell_id string, chrom string, start long, end long, score double")
    writers.write_compartments(scores, str(tmp_path / "co"))
    assert spark.read.csv(str(tmp_path / "co"), sep="\t", header=True).first()["score"] == "0.33333"
    writers.write_loops(scores, str(tmp_path / "lo"))
    assert spark.read.parquet(str(tmp_path / "lo")).count() == 1
    writers.write_table(track, str(tmp_path / "t"), ("chrom", "start"))
    assert [r.start for r in spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).collect()] == ["0", "10", "0"]
    writers.write_config(spark, str(tmp_path / "cfg"), binsize=10, vote=0.5)
    assert spark.read.json(str(tmp_path / "cfg")).first().asDict() == {"binsize": 10, "vote": 0.5}


def test_fasta_blocks_give_the_bins_of_whole_sequences(spark, tmp_path):
    """Records over many splits, lines of any length, `>` inside a header, blanks, an empty record, small letters, two files."""
    import random

    from chromalith.operators.features import dna_bins
    from chromalith.sources import blocks

    r = random.Random(2)
    texts: dict[str, str] = {}
    for f in range(2):
        out = []
        for c in range(4):
            seq = "".join(r.choice("acgtN") for _ in range([0, 900, 2503, 77][c]))
            texts[f"chr{f}{c}"] = seq.upper()
            out.append(f">{'chr' if c % 2 else ''}{f}{c} some > text\n")
            at = 0
            while at < len(seq):
                n = r.choice([1, 7, 60, 500])
                out.append(seq[at : at + n] + r.choice(["\n", " \n", "\n\n"]))
                at += n
        (tmp_path / f"g{f}.fa").write_text("".join(out))
    want = sorted(tuple(x) for x in dna_bins(spark.createDataFrame(list(texts.items()), "chrom string, sequence string"), 64).collect())
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("200b", held):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            pieces = blocks.fasta_blocks(spark, str(tmp_path / "g*.fa"), block=40)
            assert pieces.agg(F.max(F.length("sequence"))).first()[0] == 40
            got = blocks.bins_of_blocks(pieces, 64)
            assert sorted(tuple(x) for x in got.collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "none.fa").write_text("ACGT\n>x\n")
    assert blocks.fasta_blocks(spark, str(tmp_path / "none.fa")).count() == 0  # letters before any header belong to no record


def test_archives_open_only_what_is_asked_for(spark, tmp_path):
    from chromalith.sources import archives

    rng = np.random.default_rng(0)
    a = np.where(rng.random((9, 9)) < 0.3, rng.integers(1, 9, (9, 9)), 0).astype(float)
    i, j = np.nonzero(a)
    ptr = lambda of, n: np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n))))
    t = np.lexsort((i, j))
    for cell in ("c1", "c2"):
        np.savez(
            tmp_path / f"{cell}.npz", chr1=a,
            chr2__data=a[i, j], chr2__indices=j, chr2__indptr=ptr(i, 9), chr2__shape=[9, 9],
            chr3__data=a[i, j][t], chr3__indices=i[t], chr3__indptr=ptr(j, 9), chr3__format=np.array("csc"),
            chr4__data=a[i, j], chr4__row=i, chr4__col=j, chr4__format=np.array("coo"), chr4__shape=[9, 9],
            bad=np.array([{}], object),
        )
    archives.register(spark)
    want = sorted(zip(i.tolist(), j.tolist(), a[i, j].tolist(), strict=True))
    load = lambda **o: spark.read.format("contact_npz").options(**o).load(str(tmp_path))
    good = load(chroms="chr1,chr2,chr3,chr4")
    got = {}
    for r in good.collect():
        got.setdefault((r.cell_id, r.chrom), []).append((r.i, r.j, r.v))
    assert {k: sorted(v) for k, v in got.items()} == {(c, f"chr{k}"): want for c in ("c1", "c2") for k in (1, 2, 3, 4)}
    assert good.rdd.getNumPartitions() == 8 and load(cells="c2", chroms="chr3").rdd.getNumPartitions() == 1
    some = load().filter("chrom = 'chr4' and cell_id in ('c1', 'x') and v > 2")
    assert some.rdd.getNumPartitions() == 1 and sorted((r.i, r.j, r.v) for r in some.collect()) == [x for x in want if x[2] > 2]
    with pytest.raises(Exception, match="Object arrays|allow_pickle"):
        load(chroms="bad").collect()
    assert load(chroms="chr9").count() == 0
    with pytest.raises(ValueError, match="no known encoding"):
        archives.entries({"x__data": np.ones(2)}, "x")


def test_matrix_writer_skips_nulls_and_refuses_types(spark, tmp_path):
    kind = "cell_id string, chrom string, i int, j int, v double"
    m = spark.createDataFrame([("c", "chr1", 0, 1, 2.0), ("c", "chr1", 0, 2, None), ("c", "chr1", None, 2, 1.0)], kind)
    writers.write_matrices(m, str(tmp_path / "m"))
    assert [(r.i, r.j, r.v) for r in spark.read.parquet(str(tmp_path / "m")).collect()] == [(0, 1, 2.0)]
    for name, wrong in (("i", "string"), ("j", "double"), ("v", "string")):
        with pytest.raises(TypeError, match=f"{name} is {wrong}"):
            writers.write_matrices(m.withColumn(name, F.col(name).cast(wrong)), str(tmp_path / "t"))
    with pytest.raises(ValueError, match="no matrix"):
        writers.write_matrices(m.filter("v is null"), str(tmp_path / "t"))
