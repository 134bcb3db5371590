"""Column layouts of the data model. Matrices are long-form: one row for each stored entry."""

FENDS = "fend string, chr string, coord long"
RAW_CONTACTS = "cell_id string, fend1 string, fend2 string, count string"
CONTACTS = "cell_id string, chr1 string, coord1 long, chr2 string, coord2 long, count long"
CHROM_SIZES = "chrom string, size long"
MATRIX = "cell_id string, chrom string, i int, j int, v double"
DIMS = "cell_id string, chrom string, n_bins int"
DNA_BINS = "chrom string, bin int, sequence string, start long, end long"
EMBEDDING = "chrom string, bin int, emb array<float>"
FEATURES = "cell_id string, chrom string, bin int, feat array<float>"
EDGES = "cell_id string, chrom string, src int, dst int, w float, kind string"
LABELS = "cell_id string, cell_type string"
REF_LOOPS = "`group` string, chrom string, i int, j int"
BEDPE = "chrom1 string, x1 long, x2 long, chrom2 string, y1 long, y2 long"
LOOPS = "cell_id string, chrom1 string, start1 long, end1 long, chrom2 string, start2 long, end2 long, score double, logit double, bin1 int, bin2 int"
Z = "cell_id string, chrom string, bin int, z array<float>"
CELL_EMBEDDING = "cell_id string, emb array<double>, n_graphs long, chroms string"
BED = "chrom string, start long, end long"
GC = "chrom string, start long, end long, gc double"
COMPARTMENTS = "cell_id string, chrom string, start long, end long, score double"
PARAMS = "name string, shape array<int>, values array<double>"
# fixed values: chromosomes left out by default
EXCLUDED_CHROMS = ("chrX", "chrY", "chrM")
