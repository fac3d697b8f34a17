"""Sources, normalisation, annotation, sets and ordering as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import variant as V
from ..operators import annotate as A
from ..operators import cohort as C
from ..operators import masks as M
from ..operators import normalize as N
from ..operators import nullmodel as NM
from ..operators import report as R
from ..schemas import CHANNELS, INGESTED, assert_schema
from ..session import scratch_path
from ..sources import sinks, tabular, vcf
from .cohort import Cohort
from .oracle import CTES, sql
from .registry import query, rnd

VARIANT_KEYS = ["chromosome", "position", "ref", "alt"]

# SQL twin of Cohort.vcf_lines, as columns.
CTES["vcf"] = """
SELECT p_partkey AS variant_id,
  CASE p_partkey % 97 WHEN 5 THEN 'chrUn_KI270302v1' WHEN 6 THEN 'chrM' WHEN 7 THEN '23'
    ELSE CASE WHEN p_partkey % 2 = 1 THEN 'chr' || chromosome ELSE chromosome END END AS chrom,
  position AS pos,
  CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 'rs' || CAST(p_partkey AS VARCHAR) END AS rsid,
  r AS ref,
  CASE WHEN p_partkey % 3 = 0 THEN lower(a3) ELSE a3 END AS alt,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS qual,
  CASE WHEN p_partkey % 8 = 0 THEN 'q10' ELSE 'PASS' END AS filter
FROM (SELECT *, CASE WHEN p_partkey % 17 = 0 THEN a2 || ',<DEL>' ELSE a2 END AS a3 FROM (
  SELECT *, CASE WHEN p_partkey % 9 = 0 THEN a1 || ',' || r || 'T' ELSE a1 END AS a2 FROM (
    SELECT v.*, p.p_partkey, p.p_size,
      CASE WHEN p_partkey % 5 = 0 THEN 'GG' || v.ref || 'TC' ELSE v.ref END AS r,
      CASE WHEN p_partkey % 5 = 0 THEN 'GG' || v.alt || 'TC' ELSE v.alt END AS a1
    FROM variants v JOIN part p ON p.p_partkey = v.variant_id)))"""

_CHROM_SQL = """CASE upper(regexp_replace(chrom, '^chr', '', 'i'))
  WHEN 'M' THEN 'MT' WHEN '23' THEN 'X' WHEN '24' THEN 'Y' WHEN '25' THEN 'MT'
  WHEN 'UN_KI270302V1' THEN NULL ELSE upper(regexp_replace(chrom, '^chr', '', 'i')) END"""

CTES["vcf_alts"] = f"""
SELECT variant_id, {_CHROM_SQL} AS chromosome, pos, upper(ref) AS ref, upper(trim(u.a)) AS alt,
  CAST(u.i AS INTEGER) AS alt_index, rsid, qual, filter
FROM (SELECT *, string_split(alt, ',') AS alts FROM vcf),
  LATERAL (SELECT unnest(alts) AS a, unnest(range(1, len(alts) + 1)) AS i) u
WHERE trim(u.a) NOT IN ('*', '.', '') AND u.a NOT LIKE '<%'"""

CTES["vcf_trim"] = """
SELECT * EXCLUDE (ref, alt, pos, s), substr(r1, p + 1) AS ref, substr(a1, p + 1) AS alt, CAST(pos + p AS INTEGER) AS position FROM (
  SELECT *, len(list_filter(range(1, least(length(r1), length(a1))), lambda k: left(r1, CAST(k AS INTEGER)) = left(a1, CAST(k AS INTEGER)))) AS p FROM (
    SELECT *, left(ref, CAST(length(ref) - s AS INTEGER)) AS r1, left(alt, CAST(length(alt) - s AS INTEGER)) AS a1 FROM (
      SELECT *, CASE WHEN ref = alt THEN 0 ELSE
        len(list_filter(range(1, least(length(ref), length(alt))), lambda k: right(ref, CAST(k AS INTEGER)) = right(alt, CAST(k AS INTEGER)))) END AS s
      FROM vcf_alts)))"""

CTES["vnorm"] = "SELECT chromosome, position, ref, alt, alt_index, rsid, qual, filter FROM vcf_trim WHERE chromosome IS NOT NULL"


def normalized(c: Cohort) -> DataFrame:
    return N.canonical_variants(vcf.parse_vcf(c.vcf_lines))


# --------------------------------------------------------------- sources, sinks


@query("S01_delimited_scan", sql("variants", "SELECT variant_id, chromosome, position, ref, alt FROM variants"))
def s01(c: Cohort) -> DataFrame:
    path = scratch_path(c.spark, "csv")
    sinks.write_tsv(c.variants, path)
    return tabular.read_delimited(c.spark, path).select(
        F.col("variant_id").cast("long"), "chromosome", F.col("position").cast("int"), "ref", "alt"
    )


@query("S02_parquet_scan", "SELECT p_partkey, p_brand FROM part WHERE p_size > 40")
def s02(c: Cohort) -> DataFrame:
    return tabular.read_parquet(c.spark, f"{c.sf_dir}/part.parquet").filter("p_size > 40").select("p_partkey", "p_brand")


@query("S03_parquet_directory", sql("variants", "SELECT variant_id, chromosome, position FROM variants WHERE chromosome IN ('1', '21')"))
def s03(c: Cohort) -> DataFrame:
    path = scratch_path(c.spark, "dir")
    sinks.write_sorted_variants(c.variants, path)
    return tabular.read_parquet(c.spark, path).filter(F.col("chromosome").isin("1", "21")).select("variant_id", "chromosome", "position")


@query("S04_sorted_table_join", sql("annot", "SELECT variant_id, gene_name FROM annot WHERE region_type = 'exonic'"))
def s04(c: Cohort) -> DataFrame:
    """Bucketed and sorted table; joins on its keys need no shuffle of that side."""
    name = "sorted_annotation"
    c.spark.sql(f"DROP TABLE IF EXISTS {name}")
    ann = A.extract_annotation(c.annotation_raw, ["variant_id", "chromosome", "position"])
    keys = ["chromosome", "position"]
    ann.select("variant_id", *keys, "gene_name", "region_type").write.bucketBy(8, *keys).sortBy(*keys).option(
        "path", scratch_path(c.spark, name)).saveAsTable(name)
    table = c.spark.table(name).filter("region_type = 'exonic'").select(*keys, "gene_name")
    return c.variants.join(table, keys).select("variant_id", "gene_name")


@query("S05_vcf_source", sql("vcf", "SELECT chrom, CAST(pos AS INTEGER) AS pos, ref, alt, rsid, qual, filter FROM vcf"))
def s05(c: Cohort) -> DataFrame:
    path = scratch_path(c.spark, "vcf")
    c.vcf_lines.write.text(path)
    rows = vcf.parse_vcf(vcf.read_lines(c.spark, path))
    return rows.select(
        F.col("raw_chromosome").alias("chrom"), F.col("raw_position").alias("pos"),
        F.col("raw_ref").alias("ref"), F.col("raw_alt").alias("alt"), "rsid", "qual", "filter",
    )


def header_lines(c: Cohort) -> DataFrame:
    """One header per block of fifty suppliers (blocks are bounded by construction)."""
    s = c.table("supplier")
    fixed = F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t")
    name = F.concat(F.lit("S"), (F.col("s_suppkey") % 50).cast("string"))
    return (
        s.groupBy(F.floor(F.col("s_suppkey") / 50).alias("file"))
        .agg(F.sort_array(F.collect_list(F.struct("s_suppkey", name.alias("n")))).alias("m"))
        .select("file", F.concat(fixed, F.array_join("m.n", "\t")).alias("value"))
    )


@query("S06_sample_header", """SELECT s_suppkey // 50 AS file, s_suppkey % 50 AS sample_idx,
  'S' || CAST(s_suppkey % 50 AS VARCHAR) AS sample_id FROM supplier""")
def s06(c: Cohort) -> DataFrame:
    return vcf.sample_header(header_lines(c))


@query("S07_sample_consistency", """SELECT n_samples, count(*) AS n_files FROM (
  SELECT s_suppkey // 50 AS f, count(*) AS n_samples FROM supplier GROUP BY 1) GROUP BY 1""")
def s07(c: Cohort) -> DataFrame:
    return vcf.header_groups(header_lines(c)).select("n_samples", "n_files")


@query("S10_partitioned_sink", sql("variants", "SELECT chromosome, count(*) AS n, min(position) AS first, max(position) AS last FROM variants GROUP BY 1"))
def s10(c: Cohort) -> DataFrame:
    path = scratch_path(c.spark, "part")
    sinks.write_partitioned(c.variants, path, ["chromosome"])
    return tabular.read_parquet(c.spark, path).groupBy("chromosome").agg(
        F.count("*").alias("n"), F.min("position").alias("first"), F.max("position").alias("last"))


@query("S11_table_sink", sql("annot", "SELECT variant_id, gene_name, consequence FROM annot"))
def s11(c: Cohort) -> DataFrame:
    path = scratch_path(c.spark, "table")
    sinks.write_table(A.extract_annotation(c.annotation_raw, ["variant_id"]), path)
    return c.spark.read.parquet(path).select("variant_id", "gene_name", "consequence")


@query("S12_carrier_sink", sql("carriers", "SELECT dosage, count(*) AS n, count(DISTINCT sample_idx) AS n_samples FROM carriers GROUP BY 1"))
def s12(c: Cohort) -> DataFrame:
    path = scratch_path(c.spark, "carriers")
    sinks.write_table(c.carriers.repartition("variant_id").sortWithinPartitions("variant_id", "sample_idx"), path)
    return c.spark.read.parquet(path).groupBy("dosage").agg(
        F.count("*").alias("n"), F.count_distinct("sample_idx").alias("n_samples"))


@query("S13_phenotype_source", "SELECT c_name AS sample_id, c_acctbal AS bmi, CAST(c_nationkey AS DOUBLE) AS age, c_mktsegment AS site FROM customer")
def s13(c: Cohort) -> DataFrame:
    path = scratch_path(c.spark, "pheno")
    t = c.table("customer").select(
        F.col("c_name").alias("IID"), F.col("c_acctbal").alias("BMI_raw"),
        F.col("c_nationkey").alias("Age"), F.col("c_mktsegment").alias("site"))
    sinks.write_tsv(t, path)
    return tabular.read_phenotype(c.spark, path, ["bmi"], ["age"], ["site"], explicit={"bmi": "BMI_raw"})


@query("S14_kinship_source", """
WITH p AS (SELECT c_custkey AS i, c_custkey + d AS j FROM customer, (SELECT unnest([1, 2]) AS d)
  WHERE c_custkey // 3 = (c_custkey + d) // 3 AND c_custkey + d < (SELECT count(*) FROM customer))
SELECT i, j, 0.5::DOUBLE AS value FROM p UNION ALL SELECT j, i, 0.5 FROM p
UNION ALL SELECT c_custkey, c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 1.25 ELSE 1.0 END FROM customer""")
def s14(c: Cohort) -> DataFrame:
    name = F.format_string("Customer#%09d", "i")
    off = c.kin_pairs.select(F.concat_ws(" ", name, F.format_string("Customer#%09d", "j"), F.lit("0.5")).alias("value"))
    diag = c.samples.filter("sample_idx % 10 = 0").select(F.concat_ws("\t", "sample_id", "sample_id", F.lit("1.25")).alias("value"))
    stray = c.samples.filter("sample_idx % 100 = 1").select(F.concat_ws(" ", "sample_id", F.lit("nobody"), F.lit("0.3")).alias("value"))
    notes = c.samples.filter("sample_idx % 50 = 3").select(F.concat(F.lit("# about "), "sample_id").alias("value"))
    path = scratch_path(c.spark, "kin")
    off.union(diag).union(stray).union(notes).write.text(path)
    return tabular.read_kinship(c.spark, path, c.samples)


CTES["king"] = """
SELECT a.c_custkey AS i, 'F_' || a.c_name AS id1, 'F_' || b.c_name AS id2,
  round(0.05 + (a.c_custkey % 8)/16.0, 4) AS prop_ibd,
  CAST([1, 1, 2, 3][(a.c_custkey // 3) % 4 + 1] AS INTEGER) AS degree
FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE a.c_custkey % 3 <> 2"""


@query("S15_king_source", sql("king", "SELECT id1, id2, round(prop_ibd, 4)::DOUBLE AS prop_ibd, degree FROM king WHERE degree <= 2"))
def s15(c: Cohort) -> DataFrame:
    path = scratch_path(c.spark, "king")
    body = c.king_rows.select(F.concat_ws("\t", *c.king_rows.columns).alias("value"))
    head = c.spark.range(1).select(F.lit("\t".join(c.king_rows.columns)).alias("value"))
    head.coalesce(1).union(body).write.text(path)
    return tabular.read_king(c.spark, path, 2)


@query("S16_known_loci_source", sql("variants", """
SELECT chromosome, position, CASE WHEN variant_id % 2 = 0 THEN ref ELSE '*' END AS ref,
  CASE WHEN variant_id % 2 = 0 THEN alt ELSE '*' END AS alt FROM variants WHERE variant_id % 7 = 0"""))
def s16(c: Cohort) -> DataFrame:
    v = c.variants.filter("variant_id % 7 = 0")
    full = F.concat_ws(":", F.concat(F.lit("chr"), "chromosome"), F.col("position").cast("string"), "ref", "alt")
    short = F.concat_ws(":", "chromosome", F.col("position").cast("string"))
    path = scratch_path(c.spark, "loci")
    v.select(F.explode(F.array(
        F.when(F.col("variant_id") % 2 == 0, full).otherwise(short),
        F.lit("# comment"), F.lit("badline"),
    )).alias("value")).write.text(path)
    return tabular.parse_known_loci(c.spark.read.text(path))


@query("S17_candidate_source", sql("variants", "SELECT chromosome, position, ref, alt FROM variants"))
def s17(c: Cohort) -> DataFrame:
    sep = [F.concat_ws(s, "chromosome", F.col("position").cast("string"), "ref", "alt") for s in ("\t", ":")]
    path = scratch_path(c.spark, "cand")
    c.variants.select(F.when(F.col("variant_id") % 2 == 0, sep[0]).otherwise(sep[1]).alias("value")).write.text(path)
    return tabular.parse_candidates(c.spark.read.text(path))


# ----------------------------------------------------------------- projections


@query("P01_chromosome_vcf", sql("vcf", f"SELECT variant_id, {_CHROM_SQL} AS chromosome FROM vcf WHERE {_CHROM_SQL} IS NOT NULL"))
def p01(c: Cohort) -> DataFrame:
    raw = F.split_part(F.col("value"), F.lit("\t"), F.lit(1))
    return c.vcf_with_id.select("variant_id", V.normalize_chromosome(raw).alias("chromosome")).filter("chromosome is not null")


@query("P02_chromosome_tabular", """SELECT l, CASE l WHEN 'M' THEN 'MT' WHEN '23' THEN 'X' WHEN '24' THEN 'Y' ELSE l END AS chromosome, n
FROM (SELECT CAST(1 + p_partkey % 27 AS VARCHAR) AS l, count(*) AS n FROM part GROUP BY 1) WHERE CAST(l AS INTEGER) <= 24""")
def p02(c: Cohort) -> DataFrame:
    label = (F.col("p_partkey") % 27 + 1).cast("string")
    t = c.table("part").groupBy(label.alias("l")).agg(F.count("*").alias("n"))
    return t.select("l", V.normalize_chromosome("l", numeric_mt=False).alias("chromosome"), "n").filter("chromosome is not null")


@query("P03_multiallelic_split", sql("vcf_alts", "SELECT variant_id, alt_index, alt FROM vcf_alts"))
def p03(c: Cohort) -> DataFrame:
    rows = vcf.parse_vcf(c.vcf_with_id.select("value", "variant_id"), keep=["variant_id"])
    return N.split_alternates(rows).select("variant_id", "alt_index", "alt")


@query("P04_parsimony", sql("vcf_trim", "SELECT variant_id, alt_index, position, ref, alt FROM vcf_trim"))
def p04(c: Cohort) -> DataFrame:
    rows = vcf.parse_vcf(c.vcf_with_id.select("value", "variant_id"), keep=["variant_id"])
    t = N.split_alternates(rows).withColumn("v", V.parsimonious(F.upper("raw_ref"), "alt", "raw_position"))
    return t.select("variant_id", "alt_index", "v.position", "v.ref", "v.alt")


def gwas_table(c: Cohort) -> DataFrame:
    """A delimited-style text table with study headers derived from parts."""
    return c.variants.join(c.table("part"), F.col("variant_id") == F.col("p_partkey")).select(
        F.concat(F.lit("Chr"), "chromosome").alias("#CHROM"), (F.col("position") - 1).cast("string").alias("BP"),
        F.concat(F.lit(" "), F.lower("alt")).alias("A1"), F.col("ref").alias("A2"),
        F.concat(F.lit("rs"), F.col("variant_id").cast("string")).alias("SNP"),
        F.when(F.col("p_size") % 9 == 0, "NA").otherwise((F.col("p_size") / 10).cast("string")).alias("Beta"),
        F.col("p_size").cast("string").alias("N"), F.col("p_brand").alias("brand"),
    )


@query("P05_P06_P07_P09_P10_tabular_ingest", sql("variants", """
SELECT chromosome, position, ref, alt, 'rs' || CAST(variant_id AS VARCHAR) AS rsid,
  CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_size/10.0::DOUBLE END AS beta, p_size AS n, p_brand AS brand
FROM variants JOIN part ON p_partkey = variant_id"""))
def p_tab(c: Cohort) -> DataFrame:
    """Alias-mapped headers, A1/A2 fallback, zero-based shift, canonical casts, unmapped kept."""
    return tabular.ingest_tabular(gwas_table(c), zero_based=True)


@query("P07_header_report", """SELECT * FROM (VALUES ('#CHROM', 'chromosome', 'mapped'), ('BP', 'position', 'mapped'),
  ('A1', NULL, 'ambiguous'), ('A2', NULL, 'ambiguous'), ('SNP', 'rsid', 'mapped'), ('Beta', 'beta', 'mapped'),
  ('N', 'n', 'mapped'), ('brand', NULL, 'unmapped')) t("column", canonical, status)
  CROSS JOIN (SELECT count(*) AS n_rows FROM part)""")
def p07(c: Cohort) -> DataFrame:
    t = gwas_table(c)
    rows = t.agg(F.count("*").alias("n_rows"))
    return tabular.header_report(c.spark, t.columns).withColumn("n_rows", rows.scalar())


@query("P11_passthrough", "SELECT * FROM supplier")
def p11(c: Cohort) -> DataFrame:
    return tabular.read_parquet(c.spark, f"{c.sf_dir}/supplier.parquet").select("*")


GT_CODES = ["0/0", "0/1:35", "1|1", "./.", "1/2:12", "0|12", ".", "2/2"]


def call_table(c: Cohort) -> DataFrame:
    """Eight genotype fields per part, as parsed VCF rows carry them."""
    p = F.col("p_partkey")
    codes = F.array(*[F.lit(g) for g in GT_CODES])
    calls = F.array(*[F.element_at(codes, ((p * 7 + j * 3) % 8 + 1).cast("int")) for j in range(8)])
    return c.table("part").select(p.alias("variant_id"), (p % 2 + 1).cast("int").alias("alt_index"), calls.alias("calls"))


CTES["calls"] = f"""
SELECT variant_id, alt_index, sample_idx, CASE WHEN gt LIKE '%.%' THEN NULL ELSE
  CAST(len(list_filter(regexp_split_to_array(split_part(gt, ':', 1), '[/|]'), lambda a: a = CAST(alt_index AS VARCHAR))) AS DOUBLE) END AS dosage
FROM (SELECT p_partkey AS variant_id, CAST(p_partkey % 2 + 1 AS INTEGER) AS alt_index, j AS sample_idx,
  {GT_CODES!r}[(p_partkey*7 + j*3) % 8 + 1] AS gt FROM part, (SELECT unnest(range(8)) AS j))"""


@query("P13_gt_dosage", sql("calls", "SELECT variant_id, alt_index, sample_idx, dosage FROM calls"))
def p13(c: Cohort) -> DataFrame:
    return C.genotype_calls(call_table(c))


@query("P14_call_frequencies", sql("calls", """SELECT variant_id, ac, an, round(af, 6) AS af, round(least(af, 1 - af), 6) AS maf FROM (
  SELECT *, CASE WHEN an > 0 THEN ac/an ELSE 0.0 END AS af FROM (
  SELECT variant_id, coalesce(sum(dosage), 0.0) AS ac, 2*count(dosage) AS an FROM calls GROUP BY 1))"""))
def p14(c: Cohort) -> DataFrame:
    t = C.call_frequencies(C.genotype_calls(call_table(c)), ["variant_id"])
    return t.select("variant_id", "ac", "an", rnd("af", 6), rnd("maf", 6))


@query("P15_carriers_from_packed", """SELECT p_partkey AS variant_id, j AS sample_idx, CAST(least(round(d), 2) AS INTEGER) AS dosage FROM (
  SELECT p_partkey, j, CASE WHEN (p_partkey + j) % 6 = 5 THEN NULL ELSE ((p_partkey + j) % 6)*0.7 END AS d
  FROM part, (SELECT unnest(range(6)) AS j)) WHERE d > 0""")
def p15(c: Cohort) -> DataFrame:
    p = F.col("p_partkey")
    vals = [F.when((p + j) % 6 == 5, F.lit(float("nan"))).otherwise((p + j) % 6 * 0.7) for j in range(6)]
    packed = c.table("part").select(p.alias("variant_id"), F.array(*vals).alias("dosages"))
    return C.carriers_from_packed(packed, ["variant_id"])


@query("P16_pack_user_columns", sql("variants", "SELECT chromosome, position, ref, alt, p_size AS s, p_brand AS b FROM variants JOIN part ON p_partkey = variant_id"))
def p16(c: Cohort) -> DataFrame:
    t = c.variants.join(c.table("part"), F.col("variant_id") == F.col("p_partkey")).select(*VARIANT_KEYS, "p_size", "p_brand")
    return N.pack_user_columns(t, VARIANT_KEYS).select(*VARIANT_KEYS, F.col("input.p_size").alias("s"), F.col("input.p_brand").alias("b"))


_PH = ", ".join(f"ph{i} AS {n}" for i, n in enumerate(CHANNELS))


@query("P17_channel_extract", sql("annot", f"SELECT variant_id, {_PH} FROM annot"))
def p17(c: Cohort) -> DataFrame:
    return c.annotation_raw.select("variant_id", *A.channel_columns())


@query("P18_structural_extract", sql("annot", """SELECT variant_id, end_position, gene_name, region_type, consequence, revel, metasvm_pred,
  genehancer, is_cage_promoter, is_cage_enhancer, is_ccre_promoter, is_ccre_enhancer FROM annot"""))
def p18(c: Cohort) -> DataFrame:
    return c.annotation_raw.select("variant_id", *A.structural_columns())


@query("P19_phred_weight", sql("annot", "SELECT variant_id, " + ", ".join(f"round(w{i}, 9) AS w{i}" for i in range(11)) + " FROM annot"))
def p19(c: Cohort) -> DataFrame:
    t = A.with_weights(A.extract_annotation(c.annotation_raw, ["variant_id"]))
    return t.select("variant_id", *[rnd(f"w{i}", 9) for i in range(11)])


@query("P20_variant_key", sql("variants", "SELECT variant_id, chromosome || '-' || position || '-' || ref || '-' || alt AS vid FROM variants"))
def p20(c: Cohort) -> DataFrame:
    return c.variants.select("variant_id", V.variant_key(*VARIANT_KEYS).alias("vid"))


_ODD = ["exonic", "ncRNA_exonic;ncRNA_splicing", "UTR5;UTR5", "ncRNA_UTR9", "upstream;x;downstream", "downstream,far",
        "upstream-near", "exonic;splicing", "foo", "", "UTR3", "ncRNA_odd"]
_ODD_OUT = ["exonic", "ncRNA_exonic;splicing", "UTR5;UTR3", "UTR5;UTR3", "upstream;downstream", "downstream",
            "upstream", "splicing", "", "", "UTR3", "ncRNA_exonic"]
_CSQ = ["stopgain", "missense_variant", "weird", "", "synonymous SNV"]


@query("P21_lossy_parse", f"""SELECT p_partkey, {_ODD_OUT!r}[p_partkey % 12 + 1] AS region,
  {[x if x != 'weird' else '' for x in _CSQ]!r}[p_partkey % 5 + 1] AS csq FROM part""")
def p21(c: Cohort) -> DataFrame:
    p = F.col("p_partkey")
    raw = F.element_at(F.array(*[F.lit(x) for x in _ODD]), (p % 12 + 1).cast("int"))
    csq = F.element_at(F.array(*[F.lit(x) for x in _CSQ]), (p % 5 + 1).cast("int"))
    return c.table("part").select("p_partkey", V.region_type(raw).alias("region"), V.consequence(csq).alias("csq"))


@query("P22_drop_partition_column", "SELECT c_custkey, c_name FROM customer")
def p22(c: Cohort) -> DataFrame:
    t = c.table("customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("chrom_id"))
    return t.drop("chrom_id")


@query("P23_allele_orientation", sql("variants", "SELECT variant_id, least(ref, alt) AS a, greatest(ref, alt) AS b, CASE WHEN ref <= alt THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sgn FROM variants"))
def p23(c: Cohort) -> DataFrame:
    a, b, s = V.orient("ref", "alt")
    return c.variants.select("variant_id", a.alias("a"), b.alias("b"), s.alias("sgn"))


@query("P24_label_interning", """SELECT c_mktsegment AS label, CAST(row_number() OVER (ORDER BY f) - 1 AS INTEGER) AS code FROM (
  SELECT c_mktsegment, min(c_custkey) AS f FROM customer GROUP BY 1)""")
def p24(c: Cohort) -> DataFrame:
    return NM.intern_labels(c.table("customer").select(F.col("c_custkey").alias("sample_idx"), F.col("c_mktsegment").alias("label")), "label").select("label", "code").distinct()


@query("P26_annotated_with_gene", sql("vindex membership", """SELECT variant_id, m.gene_name, consequence, round(w0, 9) AS w0, round(maf, 9) AS maf
  FROM vindex JOIN membership m USING (variant_id)"""))
def p26(c: Cohort) -> DataFrame:
    return c.variant_index().drop("gene_name").join(c.membership, "variant_id").select(
        "variant_id", "gene_name", "consequence", rnd("w0", 9), rnd("maf", 9))


# --------------------------------------------------------------------- filters


@query("F01_contig_filter", sql("vcf", f"SELECT {_CHROM_SQL} AS chromosome, count(*) AS n FROM vcf WHERE {_CHROM_SQL} IS NOT NULL GROUP BY 1"))
def f01(c: Cohort) -> DataFrame:
    rows = vcf.parse_vcf(c.vcf_lines).withColumn("chromosome", V.normalize_chromosome("raw_chromosome"))
    return rows.filter("chromosome is not null").groupBy("chromosome").agg(F.count("*").alias("n"))


@query("F02_chromosome_set", sql("vnorm", "SELECT chromosome, position, ref, alt FROM vnorm WHERE chromosome IN ('2','3','4','X','MT')"))
def f02(c: Cohort) -> DataFrame:
    return N.canonical_variants(vcf.parse_vcf(c.vcf_lines), "2-4, X,MT").select(*VARIANT_KEYS)


@query("F03_polymorphic", sql("freq", "SELECT variant_id FROM freq WHERE maf > 0"))
def f03(c: Cohort) -> DataFrame:
    return c.frequencies().filter("maf > 0").select("variant_id")


@query("F04_rare", sql("freq", "SELECT variant_id, round(maf, 9) AS maf FROM freq WHERE maf < 0.012"))
def f04(c: Cohort) -> DataFrame:
    return c.frequencies().filter("maf < 0.012").select("variant_id", rnd("maf", 9))


@query("F05_individual_floor", sql("freq", "SELECT variant_id FROM freq WHERE maf > 29.5/(2*(SELECT count(*) FROM customer))"))
def f05(c: Cohort) -> DataFrame:
    from ..operators.score import mac_floor

    return c.frequencies().filter(F.col("maf") > mac_floor(30, c.n_samples)).select("variant_id")


def gappy(c: Cohort) -> DataFrame:
    k = F.col("c_custkey")
    return c.table("customer").select(
        F.col("c_name").alias("sample_id"),
        F.when(k % 11 != 0, F.col("c_acctbal")).alias("t1"), F.when(k % 13 != 0, F.col("c_acctbal") * 2).alias("t2"),
        F.when(k % 17 != 0, F.col("c_nationkey").cast("double")).alias("x"))


@query("F06_complete_cases", """SELECT c_name AS sample_id, c_custkey AS sample_idx, c_acctbal AS t1 FROM customer
  WHERE c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AND c_custkey % 17 <> 0 AND c_custkey % 3 <> 1""")
def f06(c: Cohort) -> DataFrame:
    genotyped = c.samples.filter("sample_idx % 3 <> 1")
    return NM.complete_cases(gappy(c), genotyped, ["t1", "t2"], ["x"]).select("sample_id", "sample_idx", "t1")


@query("F07_value_guards", "SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 11 = 0) AS n_nan, count(DISTINCT n_regionkey) AS levels FROM customer JOIN nation ON n_nationkey = c_nationkey")
def f07(c: Cohort) -> DataFrame:
    t = c.phenotype.withColumn("y", F.when(F.col("sample_idx") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("y")))
    return NM.value_guards(t, ["y"], "ancestry").select("n", F.col("nan_y").alias("n_nan"), F.col("levels"))


CTES["tissue"] = """SELECT chromosome || '-' || position || '-' || ref || '-' || alt AS vid, chromosome, n_name AS tissue_name, l_quantity AS value
FROM lineitem JOIN variants ON variant_id = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey"""


def tissue(c: Cohort) -> DataFrame:
    where = c.table("supplier").join(c.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return (
        c.table("lineitem").select("l_partkey", "l_suppkey", "l_quantity")
        .join(c.variants, F.col("l_partkey") == F.col("variant_id")).join(where, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(V.variant_key(*VARIANT_KEYS).alias("vid"), "chromosome", F.col("n_name").alias("tissue_name"),
                F.col("l_quantity").alias("value"), F.col("chromosome").alias("chrom_id"))
    )


def vocabulary(c: Cohort) -> DataFrame:
    return c.table("nation").join(c.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("tissue_group"), F.col("n_name").alias("tissue_norm"), F.lower("n_name").alias("tissue_raw"))


def some_variants(c: Cohort) -> DataFrame:
    """Stop-gain variants as the query set."""
    ann = A.extract_annotation(c.annotation_raw, VARIANT_KEYS[:2] + ["ref_vcf", "alt_vcf"]).filter("consequence = 'stopgain'")
    return ann.select("chromosome", V.variant_key("chromosome", "position", "ref_vcf", "alt_vcf").alias("vid"))


_STOP = "SELECT chromosome || '-' || position || '-' || ref || '-' || alt FROM annot WHERE consequence = 'stopgain'"
_ASIA = "SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name ILIKE '%asi%' OR n_name ILIKE '%asi%'"


@query("F08_tissue_filter", sql("tissue annot", f"SELECT vid, tissue_name, value FROM tissue WHERE tissue_name IN ({_ASIA}) AND vid IN ({_STOP})"))
def f08(c: Cohort) -> DataFrame:
    t = A.enrich(tissue(c), some_variants(c), A.resolve_tissue(vocabulary(c), "asi"))
    return t.select("vid", "tissue_name", "value")


@query("F09_tissue_resolve", "SELECT DISTINCT n_name AS tissue_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name ILIKE '%Ame%' OR n_name ILIKE '%Ame%'")
def f09(c: Cohort) -> DataFrame:
    return A.resolve_tissue(vocabulary(c), "Ame")


@query("F10_regulatory_like", sql("annot", "SELECT variant_id, is_ccre_promoter, is_ccre_enhancer FROM annot WHERE is_ccre_promoter OR is_ccre_enhancer"))
def f10(c: Cohort) -> DataFrame:
    t = A.extract_annotation(c.annotation_raw, ["variant_id"])
    return t.filter("is_ccre_promoter or is_ccre_enhancer").select("variant_id", "is_ccre_promoter", "is_ccre_enhancer")


@query("F11_minimum_set_size", sql("rare membership", "SELECT m.gene_name, consequence, count(*) AS n FROM rare JOIN membership m USING (variant_id) GROUP BY 1, 2 HAVING count(*) >= 2"))
def f11(c: Cohort) -> DataFrame:
    t = c.rare_index().drop("gene_name").join(c.membership, "variant_id").groupBy("gene_name", "consequence").agg(F.count("*").alias("n"))
    return t.filter(F.col("n") >= M.MIN_SET_SIZE)


_PLOF = "(consequence IN ('stopgain', 'frameshift deletion') OR region_type = 'splicing')"
_MIS = "(consequence = 'nonsynonymous SNV')"
_DAM = f"({_MIS} AND metasvm_pred = 'D')"
_PTV = "(consequence IN ('stopgain', 'frameshift deletion'))"
MASK_SQL = {
    "plof": _PLOF, "missense": _MIS, "disruptive_missense": _DAM, "plof_ds": f"({_PLOF} OR {_DAM})",
    "synonymous": "(consequence = 'synonymous SNV')", "ptv": _PTV,
    "ptv_ds": f"({_PTV} OR region_type = 'splicing' OR {_DAM})",
    "coding_incl_ptv": f"({_PLOF} OR {_MIS} OR consequence = 'synonymous SNV')",
    "upstream": "(region_type IN ('upstream', 'upstream;downstream'))",
    "downstream": "(region_type IN ('downstream', 'upstream;downstream'))",
    "utr": "(region_type = 'UTR3')", "promoter_cage": "is_cage_promoter", "promoter_dhs": "is_ccre_promoter",
    "enhancer_cage": "is_cage_enhancer", "enhancer_dhs": "is_ccre_enhancer",
    "ncrna": "(region_type LIKE 'ncRNA%')",
}
CTES["masked"] = " UNION ALL ".join(f"SELECT '{m}' AS mask, * FROM rare_m WHERE {cond}" for m, cond in MASK_SQL.items())
# Upstream, downstream and ncRNA labels come from a second mapping of the size column.
_REGION_ALT = "CASE p_size % 10 WHEN 0 THEN 'upstream' WHEN 1 THEN 'downstream' WHEN 2 THEN 'ncRNA_exonic' WHEN 3 THEN 'upstream;downstream' WHEN 4 THEN 'ncRNA_splicing' ELSE region_type END"
CTES["annot_alt"] = f"SELECT a.* REPLACE ({_REGION_ALT} AS region_type) FROM annot a JOIN part ON p_partkey = variant_id"
CTES["rare_m"] = "SELECT * FROM rare"


def annotation_alt(c: Cohort) -> DataFrame:
    s = F.col("p_size") % 10
    region = (F.when(s == 0, "upstream").when(s == 1, "downstream").when(s == 2, "ncRNA_exonic")
              .when(s == 3, "upstream;downstream").when(s == 4, "ncRNA_splicing").otherwise(F.col("region_type")))
    return A.extract_annotation(c.annotation_raw, ["variant_id"]).join(
        c.table("part").select(F.col("p_partkey").alias("variant_id"), "p_size"), "variant_id").withColumn("region_type", region)


_MASK_SQL_ALT = {**MASK_SQL}
_PLOF_A = "(consequence IN ('stopgain', 'frameshift deletion') OR region_type IN ('splicing', 'ncRNA_splicing'))"
_MASK_SQL_ALT.update({
    "plof": _PLOF_A, "plof_ds": f"({_PLOF_A} OR {_DAM})",
    "ptv_ds": f"({_PTV} OR region_type IN ('splicing', 'ncRNA_splicing') OR {_DAM})",
    "coding_incl_ptv": f"({_PLOF_A} OR {_MIS} OR consequence = 'synonymous SNV')",
})


def _register_masks() -> None:
    for k, mask in enumerate(M.ALL_MASKS):
        name = f"F{12 + k}_mask_{mask}"

        def run(c: Cohort, mask=mask) -> DataFrame:
            t = annotation_alt(c)
            return t.filter(M.predicates()[mask]).select("variant_id", "region_type", "consequence")

        query(name, sql("annot_alt", f"SELECT variant_id, region_type, consequence FROM annot_alt WHERE {_MASK_SQL_ALT[mask]}"))(run)


_register_masks()


@query("F30_position_list", sql("variants", "SELECT variant_id FROM variants WHERE (chromosome, position) IN (SELECT DISTINCT chromosome, position FROM variants WHERE variant_id % 5 = 0)"))
def f30(c: Cohort) -> DataFrame:
    wanted = c.variants.filter("variant_id % 5 = 0").select("chromosome", "position")
    return c.variants.join(wanted, ["chromosome", "position"], "left_semi").select("variant_id")


@query("F29_known_locus_match", sql("variants", """
SELECT DISTINCT v.variant_id FROM variants v JOIN (SELECT *, variant_id % 2 = 0 AS exact FROM variants WHERE variant_id % 7 = 0) l
ON v.chromosome = l.chromosome AND v.position = l.position
  AND (NOT l.exact OR (least(v.ref, v.alt) = least(l.ref, l.alt) AND greatest(v.ref, v.alt) = greatest(l.ref, l.alt)))"""))
def f29(c: Cohort) -> DataFrame:
    from ..operators.meta import match_known_loci

    exact = F.col("variant_id") % 2 == 0
    loci = c.variants.filter("variant_id % 7 = 0").select(
        "chromosome", "position", F.when(exact, F.col("alt")).otherwise("*").alias("ref"), F.when(exact, F.col("ref")).otherwise("*").alias("alt"))
    return match_known_loci(c.variants, loci).select("variant_id")


# ----------------------------------------------------------------------- joins


@query("J01_annotate_exact", sql("vnorm annot", """SELECT n.chromosome, n.position, n.ref, n.alt, n.rsid, gene_name, consequence
  FROM vnorm n JOIN annot a USING (chromosome, position, ref, alt)"""))
def j01(c: Cohort) -> DataFrame:
    ann = A.extract_annotation(c.annotation_raw, ["chromosome", "position", "ref_vcf", "alt_vcf"])
    return A.annotate_exact(normalized(c), ann).select(*VARIANT_KEYS, "rsid", "gene_name", "consequence")


@query("J02_annotate_position", sql("vnorm annot", """SELECT n.chromosome, n.position, n.ref, n.alt, a.ref AS ref_vcf, a.alt AS alt_vcf, gene_name
  FROM vnorm n JOIN annot a ON n.chromosome = a.chromosome AND n.position = a.position"""))
def j02(c: Cohort) -> DataFrame:
    ann = A.extract_annotation(c.annotation_raw, ["chromosome", "position", "ref_vcf", "alt_vcf"])
    return A.annotate_by_position(normalized(c), ann).select(*VARIANT_KEYS, "ref_vcf", "alt_vcf", "gene_name")


@query("J03_annotate_rsid", sql("vcf annot", """SELECT n.rsid, n.qual, a.chromosome, a.position, a.ref, a.alt, gene_name
  FROM vcf n JOIN annot a ON n.rsid = 'rs' || CAST(a.variant_id AS VARCHAR)"""))
def j03(c: Cohort) -> DataFrame:
    rows = vcf.parse_vcf(c.vcf_lines).select("rsid", "qual").filter("rsid is not null")
    lookup = c.variants.select(F.concat(F.lit("rs"), F.col("variant_id").cast("string")).alias("rsid"), *VARIANT_KEYS)
    ann = A.extract_annotation(c.annotation_raw, ["chromosome", "position", "ref_vcf", "alt_vcf"])
    return A.annotate_by_rsid(rows, lookup, ann).select("rsid", "qual", *VARIANT_KEYS, "gene_name")


@query("J04_genotype_annotation", sql("vindex", "SELECT chromosome, position, ref, alt, round(maf, 9) AS maf, gene_name, region_type, ph0 AS cadd_phred FROM vindex WHERE maf > 0 AND variant_id % 13 <> 0"))
def j04(c: Cohort) -> DataFrame:
    geno = c.variants.join(c.frequencies(), "variant_id").filter("variant_id % 13 <> 0").drop("variant_id")
    t = A.annotate_genotypes(geno, c.annotation_raw)
    return t.select(*VARIANT_KEYS, rnd("maf", 9), "gene_name", "region_type", "cadd_phred")


@query("J05_tissue_semi_join", sql("tissue annot", f"SELECT vid, tissue_name, value FROM tissue WHERE vid IN ({_STOP})"))
def j05(c: Cohort) -> DataFrame:
    return A.enrich(tissue(c), some_variants(c)).select("vid", "tissue_name", "value")


@query("J06_probe_semi_join", sql("vnorm variants", """
WITH p AS (SELECT * FROM (SELECT chromosome, position, row_number() OVER (PARTITION BY chromosome ORDER BY position, ref, alt) AS r
  FROM vnorm WHERE chromosome IN ('1', '2', '22', '10', 'X')) WHERE r <= 100)
SELECT chromosome, count(*) AS n_probe, count(*) FILTER (WHERE (chromosome, position) IN (SELECT chromosome, position FROM variants)) AS hits_one_based,
  count(*) FILTER (WHERE (chromosome, position + 1) IN (SELECT chromosome, position FROM variants)) AS hits_zero_based
FROM p GROUP BY 1 HAVING count(*) >= 5"""))
def j06(c: Cohort) -> DataFrame:
    return A.probe_positions(normalized(c), c.annotation_raw).drop("probe_order")


@query("J07_position_semi_join", sql("vnorm variants", "SELECT chromosome, count(*) AS n_hits FROM vnorm WHERE (chromosome, position) IN (SELECT chromosome, position FROM variants) GROUP BY 1"))
def j07(c: Cohort) -> DataFrame:
    return A.position_hits(normalized(c), c.annotation_raw)


@query("J08_allele_mismatch", sql("vnorm annot", """SELECT n.chromosome, n.position, n.ref, n.alt, a.ref AS ann_ref, a.alt AS ann_alt
  FROM vnorm n JOIN annot a ON n.chromosome = a.chromosome AND n.position = a.position WHERE n.ref <> a.ref OR n.alt <> a.alt"""))
def j08(c: Cohort) -> DataFrame:
    return A.allele_mismatches(normalized(c), c.annotation_raw)


@query("J09_metadata_genotype_merge", sql("carriers variants", "SELECT chromosome, position, ref, alt, count(*) AS n_carriers FROM carriers JOIN variants USING (variant_id) GROUP BY 1, 2, 3, 4"))
def j09(c: Cohort) -> DataFrame:
    meta = c.variants.select(*VARIANT_KEYS)
    rows = c.carriers.join(c.variants, "variant_id").select(*VARIANT_KEYS, "sample_idx", "dosage")
    return meta.join(rows, VARIANT_KEYS).groupBy(*VARIANT_KEYS).agg(F.count("*").alias("n_carriers"))


@query("J10_phenotype_join", "SELECT c_custkey AS sample_idx, c_name AS sample_id, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS t1 FROM customer")
def j10(c: Cohort) -> DataFrame:
    return c.samples.join(gappy(c), "sample_id", "left").select("sample_idx", "sample_id", "t1")


@query("J11_carrier_null_join", sql("carriers pheno", "SELECT count(*) AS n, sum(dosage)::BIGINT AS d FROM carriers JOIN pheno USING (sample_idx) WHERE sample_idx % 4 <> 0"))
def j11(c: Cohort) -> DataFrame:
    ph = c.phenotype.filter("sample_idx % 4 <> 0").select("sample_idx")
    return c.carriers.join(ph, "sample_idx").agg(F.count("*").alias("n"), F.sum("dosage").alias("d"))


@query("J12_gene_membership", sql("membership variants", "SELECT gene_name, variant_id, chromosome, position FROM membership JOIN variants USING (variant_id)"))
def j12(c: Cohort) -> DataFrame:
    return c.variants.join(c.membership, "variant_id").select("gene_name", "variant_id", "chromosome", "position")


@query("J13_vid_resolution", sql("tissue variants", "SELECT variant_id, tissue_name, sum(value) AS total FROM tissue t JOIN variants v ON t.vid = v.chromosome || '-' || v.position || '-' || v.ref || '-' || v.alt GROUP BY 1, 2"))
def j13(c: Cohort) -> DataFrame:
    ids = c.variants.select("variant_id", V.variant_key(*VARIANT_KEYS).alias("vid"))
    return tissue(c).join(ids, "vid").groupBy("variant_id", "tissue_name").agg(F.sum("value").alias("total"))


@query("J14_king_indices", sql("king", "SELECT i, i + 1 AS j, prop_ibd FROM king WHERE degree <= 3 AND i % 30 <> 0 AND (i + 1) % 30 <> 0"))
def j14(c: Cohort) -> DataFrame:
    from ..operators.relate import index_pairs

    body = c.king_rows.select(F.concat_ws("\t", *c.king_rows.columns).alias("value"))
    pairs = tabular.parse_king(body.union(body), "\t".join(c.king_rows.columns), 3)
    ids = c.samples.filter("sample_idx % 30 <> 0").select("sample_idx", F.concat(F.lit("F_"), "sample_id").alias("sample_id"))
    return index_pairs(pairs.select(F.col("id2").alias("id1"), F.col("id1").alias("id2"), "prop_ibd"), ids)


@query("J16_group_lookup", "SELECT c_custkey AS sample_idx, c_mktsegment AS grp FROM customer")
def j16(c: Cohort) -> DataFrame:
    groups = c.table("customer").select(F.col("c_name").alias("sample_id"), F.col("c_mktsegment").alias("grp"))
    return NM.lookup_by_sample(c.samples, groups, "grp").select("sample_idx", "grp")


@query("J17_candidate_match", sql("vindex", "SELECT variant_id FROM vindex WHERE maf > 0.0095 AND variant_id % 3 = 0"))
def j17(c: Cohort) -> DataFrame:
    from ..operators.select import match_candidates

    cand = c.variants.filter("variant_id % 3 = 0").select(*VARIANT_KEYS)
    geno = c.variants.join(c.frequencies(), "variant_id")
    return match_candidates(cand, geno, 0.0095).select("variant_id")


# ----------------------------------------------------------------- aggregations


@query("A01_duplicate_keys", sql("vnorm", "SELECT count(*) AS n_duplicate_keys FROM (SELECT position, ref, alt FROM vnorm GROUP BY 1, 2, 3 HAVING count(*) > 1)"))
def a01(c: Cohort) -> DataFrame:
    return A.duplicate_keys(normalized(c), ["position", "ref", "alt"])


@query("A02_distinct_genes", sql("membership", "SELECT count(DISTINCT gene_name) AS n_genes FROM membership"))
def a02(c: Cohort) -> DataFrame:
    return A.distinct_genes(c.membership)


@query("A03_distinct_chromosomes", sql("vnorm", "SELECT DISTINCT chromosome FROM vnorm"))
def a03(c: Cohort) -> DataFrame:
    return normalized(c).select("chromosome").distinct().orderBy(V.karyotype_rank("chromosome"))


@query("A04_trait_family", sql("pheno", """SELECT 'y' AS trait, count(DISTINCT y) AS n_distinct, CASE WHEN count(DISTINCT y) <= 2 THEN 'binary' ELSE 'continuous' END AS family FROM pheno
  UNION ALL SELECT 'yb', count(DISTINCT yb), CASE WHEN count(DISTINCT yb) <= 2 THEN 'binary' ELSE 'continuous' END FROM pheno"""))
def a04(c: Cohort) -> DataFrame:
    return NM.trait_family(c.phenotype, ["y", "yb"])


@query("A05_row_count", sql("vnorm", "SELECT count(*) AS n FROM vnorm"))
def a05(c: Cohort) -> DataFrame:
    return normalized(c).agg(F.count("*").alias("n"))


@query("A08_cumulative_count", sql("rare membership", """SELECT m.gene_name, CAST(sum(round(2*maf*(SELECT count(*) FROM customer))) AS BIGINT) AS cmac
  FROM rare JOIN membership m USING (variant_id) GROUP BY 1"""))
def a08(c: Cohort) -> DataFrame:
    t = c.rare_index().drop("gene_name").join(c.membership, "variant_id")
    return t.groupBy("gene_name").agg(F.sum(F.round(2 * F.col("maf") * c.n_samples)).cast("long").alias("cmac"))


@query("A09_variant_set_metadata", sql("vnorm", "SELECT chromosome, count(*) AS n_variants FROM vnorm GROUP BY 1"))
def a09(c: Cohort) -> DataFrame:
    return assert_schema(normalized(c), INGESTED).groupBy("chromosome").agg(F.count("*").alias("n_variants"))


@query("A10_gene_sets", sql("rare membership", 'SELECT m.gene_name, min(position) AS start, max(position) AS "end", count(*) AS n_variants FROM rare JOIN membership m USING (variant_id) GROUP BY 1'))
def a10(c: Cohort) -> DataFrame:
    return M.gene_sets(c.rare_index().drop("gene_name"), c.membership)


@query("A17_match_rate", sql("vnorm variants", """SELECT chromosome, count(*) AS n_input, count(*) FILTER (WHERE hit) AS n_matched,
  round(count(*) FILTER (WHERE hit)/count(*), 9) AS rate FROM (
  SELECT chromosome, (chromosome, position, ref, alt) IN (SELECT chromosome, position, ref, alt FROM variants) AS hit FROM vnorm) GROUP BY 1"""))
def a17(c: Cohort) -> DataFrame:
    v = normalized(c)
    ann = A.annotate_exact(v, c.annotation_raw.select("chromosome", "position", "ref_vcf", "alt_vcf"))
    return A.match_rate(v, ann, VARIANT_KEYS).withColumn("rate", rnd("rate", 9))


# --------------------------------------------------------------------- windows


@query("W01_dedup_by_maf", sql("vindex", """SELECT gene_name, consequence, variant_id, round(maf, 9) AS maf FROM (
  SELECT *, row_number() OVER (PARTITION BY gene_name, consequence ORDER BY maf DESC, variant_id) AS rn FROM vindex) WHERE rn = 1"""))
def w01(c: Cohort) -> DataFrame:
    t = c.variant_index().select("gene_name", "consequence", "variant_id", "maf")
    return C.deduplicate(t, ["gene_name", "consequence"], ["variant_id"]).select("gene_name", "consequence", "variant_id", rnd("maf", 9))


@query("W02_dense_variant_id", sql("vnorm", """SELECT chromosome, position, ref, alt,
  row_number() OVER (PARTITION BY chromosome ORDER BY position, ref, alt) - 1 AS variant_vcf FROM (SELECT DISTINCT chromosome, position, ref, alt FROM vnorm)"""))
def w02(c: Cohort) -> DataFrame:
    return C.assign_variant_ids(normalized(c).select(*VARIANT_KEYS).distinct())


LENGTHS = M.scan_lengths(lmin=40, lmax=300, step=10)
CTES["rare_rank"] = "SELECT *, row_number() OVER (PARTITION BY chromosome ORDER BY position, ref, alt) - 1 AS rnk FROM rare"
CTES["scan_win"] = f"""
SELECT a.chromosome, a.rnk AS start_rank, CAST(l AS INTEGER) AS n_variants, a.position AS start, b.position AS "end",
  'scang_L' || l || '_' || a.chromosome || ':' || a.position || '-' || b.position AS set_id
FROM rare_rank a, (SELECT unnest({LENGTHS}) AS l) JOIN rare_rank b ON b.chromosome = a.chromosome AND b.rnk = a.rnk + l - 1"""


@query("W04_R04_scan_windows", sql("scan_win", "SELECT * FROM scan_win"))
def w04(c: Cohort) -> DataFrame:
    return M.scan_windows(M.scan_ranks(c.rare_index()), LENGTHS)


@query("W05_segments", sql("variants", """
WITH b AS (SELECT *, position // 1000 AS bin, row_number() OVER (PARTITION BY chromosome, position // 1000 ORDER BY position, ref, alt) - 1 AS r FROM variants),
q AS (SELECT *, r // 7 AS chunk FROM b)
SELECT variant_id, CAST(dense_rank() OVER (PARTITION BY chromosome ORDER BY bin, chunk) - 1 AS INTEGER) AS segment_id FROM q"""))
def w05(c: Cohort) -> DataFrame:
    return M.assign_segments(c.variants, width=1000, limit=7).select("variant_id", "segment_id")


@query("W06_chromosome_offsets", sql("vindex", f"""
WITH l(chromosome, length) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in R.CHROMOSOME_LENGTHS.items())}),
o AS (SELECT chromosome, coalesce(sum(length) OVER (ORDER BY CASE chromosome WHEN 'X' THEN 23 WHEN 'Y' THEN 24 ELSE CAST(chromosome AS INTEGER) END
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM l)
SELECT variant_id, off + position AS genome_x FROM vindex JOIN o USING (chromosome)"""))
def w06(c: Cohort) -> DataFrame:
    off = R.chromosome_offsets(c.spark)
    return c.variants.join(c.frequencies(), "variant_id").join(F.broadcast(off), "chromosome").select(
        "variant_id", (F.col("offset") + F.col("position")).alias("genome_x"))


@query("W07_type7_quantile", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.95), 4) AS q FROM lineitem GROUP BY 1")
def w07(c: Cohort) -> DataFrame:
    from ..operators.scan import type7_quantile

    return c.table("lineitem").groupBy("l_returnflag").agg(rnd(type7_quantile(F.col("l_extendedprice"), 0.95), 4, "q"))


# -------------------------------------------------------------- order and sets


@query("O01_sort_by_position", sql("vnorm", "SELECT chromosome, position, ref, alt FROM vnorm"))
def o01(c: Cohort) -> DataFrame:
    t = normalized(c).select(*VARIANT_KEYS)
    return t.repartition("chromosome", F.floor(F.col("position") / 100_000)).sortWithinPartitions("chromosome", "position")


@query("O02_sort_by_key", sql("vnorm", "SELECT position, ref, alt FROM vnorm"))
def o02(c: Cohort) -> DataFrame:
    return normalized(c).select("position", "ref", "alt").orderBy("position", "ref", "alt")


@query("O03_karyotype_order", sql("vnorm", """SELECT chromosome, CAST(CASE chromosome WHEN 'X' THEN 23 WHEN 'Y' THEN 24 WHEN 'MT' THEN 25 ELSE CAST(chromosome AS INTEGER) END AS INTEGER) AS rank, count(*) AS n FROM vnorm GROUP BY 1, 2"""))
def o03(c: Cohort) -> DataFrame:
    t = normalized(c).groupBy("chromosome").agg(F.count("*").alias("n"))
    return t.withColumn("rank", V.karyotype_rank("chromosome")).orderBy("rank")


@query("O04_ordered_probe", sql("vnorm", "SELECT position, ref, alt FROM vnorm WHERE chromosome = '1' ORDER BY position, ref, alt LIMIT 100"))
def o04(c: Cohort) -> DataFrame:
    """First hundred variants of a chromosome: the probe the build check samples."""
    return normalized(c).filter("chromosome = '1'").select("position", "ref", "alt").orderBy("position", "ref", "alt").limit(100)


@query("U01_union_inputs", sql("variants", "SELECT chromosome, position, CASE WHEN variant_id % 2 = 0 THEN ref END AS ref, alt FROM variants"))
def u01(c: Cohort) -> DataFrame:
    a = c.variants.filter("variant_id % 2 = 0").select("chromosome", "position", "ref", "alt")
    b = c.variants.filter("variant_id % 2 = 1").select("chromosome", "position", "alt")
    return a.unionByName(b, allowMissingColumns=True)


@query("U02_union_parts", sql("variants", "SELECT variant_id, chromosome FROM variants"))
def u02(c: Cohort) -> DataFrame:
    path = scratch_path(c.spark, "parts")
    sinks.write_partitioned(c.variants, path, ["chromosome"])
    # One read over several directories; the base path keeps the partition column.
    t = c.spark.read.option("basePath", path).schema(c.variants.schema).parquet(*[f"{path}/chromosome={k}" for k in range(1, 23)])
    return t.select("variant_id", "chromosome")


@query("U03_union_studies", "SELECT CAST(c_custkey % 2 AS INTEGER) AS study_idx, c_custkey FROM customer")
def u03(c: Cohort) -> DataFrame:
    from ..operators.meta import union_studies

    t = c.table("customer").select("c_custkey")
    return union_studies([t.filter("c_custkey % 2 = 0"), t.filter("c_custkey % 2 = 1")])


@query("U04_mask_union", sql("annot", f"SELECT variant_id FROM annot WHERE {_PLOF} OR {_DAM}"))
def u04(c: Cohort) -> DataFrame:
    p = M.predicates()
    return A.extract_annotation(c.annotation_raw, ["variant_id"]).filter(p["plof"] | p["disruptive_missense"]).select("variant_id")


@query("U05_new_pairs", sql("king", "SELECT i, j FROM (SELECT c_custkey AS i, c_custkey + d AS j FROM customer, (SELECT unnest([1, 2]) AS d) WHERE c_custkey // 3 = (c_custkey + d) // 3 AND c_custkey + d < (SELECT count(*) FROM customer)) EXCEPT SELECT i, i + 1 FROM king"))
def u05(c: Cohort) -> DataFrame:
    known = c.king_rows.select(
        F.regexp_extract("ID1", r"(\d+)", 1).cast("long").alias("i"), F.regexp_extract("ID2", r"(\d+)", 1).cast("long").alias("j"))
    return c.kin_pairs.select("i", "j").join(known, ["i", "j"], "left_anti")


# ------------------------------------------------------------------- functions


@query("X01_string_functions", """SELECT p_partkey, upper(trim(p_name)) AS u, regexp_replace(p_brand, '^brand#', '', 'i') AS b, length(p_name) AS n,
  p_type LIKE '%AL%' AS l, split_part(p_name, ' ', 2) AS second FROM part""")
def x01(c: Cohort) -> DataFrame:
    return c.table("part").select(
        "p_partkey", F.upper(F.trim("p_name")).alias("u"), F.regexp_replace("p_brand", "(?i)^brand#", "").alias("b"),
        F.length("p_name").cast("long").alias("n"), F.col("p_type").like("%AL%").alias("l"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("second"))


@query("X02_conditional_cast", """SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS s, coalesce(nullif(p_type, 'SMALL'), '') AS t,
  TRY_CAST(substr(p_brand, 7) AS INTEGER) AS k FROM part""")
def x02(c: Cohort) -> DataFrame:
    return c.table("part").select(
        "p_partkey", F.when(F.col("p_size") > 25, "big").otherwise("small").alias("s"),
        F.coalesce(F.nullif("p_type", F.lit("SMALL")), F.lit("")).alias("t"),
        F.substring("p_brand", 7, 10).try_cast("int").alias("k"))


@query("X03_struct_array", """SELECT p_brand, count(*) AS n, min(p_size) AS smallest, max(p_partkey) AS last FROM part GROUP BY 1""")
def x03(c: Cohort) -> DataFrame:
    s = c.table("part").withColumn("s", F.struct("p_partkey", "p_size")).withColumn("a", F.array("s"))
    return s.groupBy("p_brand").agg(
        F.count("*").alias("n"), F.min(F.element_at("a", 1)["p_size"]).alias("smallest"), F.max("s.p_partkey").alias("last"))


@query("X04_math", "SELECT p_partkey, round(pow(p_size, 1.5), 6) AS a, round(log10(p_size), 9) AS b, round(sqrt(p_size), 9) AS c, round(atan(p_size), 9) AS d, round(exp(-p_size/10.0), 9) AS e, round(tan(p_size/100.0), 9) AS f FROM part")
def x04(c: Cohort) -> DataFrame:
    s = F.col("p_size")
    return c.table("part").select(
        "p_partkey", rnd(F.pow(s, F.lit(1.5)), 6, "a"), rnd(F.log10(s), 9, "b"), rnd(F.sqrt(s), 9, "c"),
        rnd(F.atan(s), 9, "d"), rnd(F.exp(-s / 10), 9, "e"), rnd(F.tan(s / 100), 9, "f"))


# ------------------------------------------------------------------ diagnostics


@query("C02_detect_build", sql("vnorm variants", """
WITH p AS (SELECT * FROM (SELECT chromosome, position - 1 AS position, row_number() OVER (PARTITION BY chromosome ORDER BY position, ref, alt) AS r
  FROM vnorm WHERE chromosome IN ('1', '2', '22', '10', 'X')) WHERE r <= 100),
q AS (SELECT chromosome, count(*) AS n_probe, count(*) FILTER (WHERE (chromosome, position) IN (SELECT chromosome, position FROM variants))/count(*) AS one,
  count(*) FILTER (WHERE (chromosome, position + 1) IN (SELECT chromosome, position FROM variants))/count(*) AS zero FROM p GROUP BY 1 HAVING count(*) >= 5)
SELECT chromosome, n_probe, round(one, 9) AS rate_one_based, round(zero, 9) AS rate_zero_based,
  CASE WHEN one > 0.5 THEN 'one' WHEN zero > 0.5 THEN 'zero' ELSE 'unknown' END AS coord_base,
  CASE WHEN greatest(one, zero) > 0.5 THEN 'hg38' WHEN greatest(one, zero) < 0.2 THEN 'hg19' ELSE 'unknown' END AS build
FROM q ORDER BY CASE chromosome WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '22' THEN 3 WHEN '10' THEN 4 ELSE 5 END LIMIT 1"""))
def c02(c: Cohort) -> DataFrame:
    zero_based = normalized(c).withColumn("position", F.col("position") - 1)
    t = A.detect_build(zero_based, c.annotation_raw)
    return t.withColumns({k: rnd(F.col(k), 9) for k in ("rate_one_based", "rate_zero_based")})


@query("C03_zero_match_diagnosis", sql("variants", "SELECT count(*) AS n_input, CAST(0 AS BIGINT) AS n_prefixed, count(*) AS n_position_hits, count(*) AS n_allele_mismatches, 'allele_representation' AS cause FROM variants"))
def c03(c: Cohort) -> DataFrame:
    padded = c.variants.select("chromosome", "position", F.concat(F.lit("A"), "ref").alias("ref"), F.concat(F.lit("A"), "alt").alias("alt"))
    return A.zero_match_diagnosis(padded, c.annotation_raw)


@query("C04_enrich_all", sql("tissue annot", f"""
WITH t AS (SELECT * FROM tissue WHERE vid IN ({_STOP}) AND tissue_name IN ({_ASIA}))
SELECT 'expression' AS table_name, count(*) AS n_rows FROM t HAVING count(*) > 0
UNION ALL SELECT 'chromatin', count(*) FROM t WHERE value > 25 HAVING count(*) > 0"""))
def c04(c: Cohort) -> DataFrame:
    tables = {"expression": tissue(c), "chromatin": tissue(c).filter("value > 25"), "empty": tissue(c).filter("value < 0")}
    return A.enrich_all(tables, some_variants(c), A.resolve_tissue(vocabulary(c), "asi"))


@query("C05_invariants", """SELECT * FROM (VALUES ('duplicate_carrier'), ('dosage_code'), ('sample_range'), ('membership_orphan'),
  ('carrier_orphan'), ('polymorphic_without_carriers'), ('duplicate_variant')) t(rule) CROSS JOIN (SELECT CAST(0 AS BIGINT) AS n)""")
def c05(c: Cohort) -> DataFrame:
    v = c.variants.join(c.frequencies(), "variant_id", "left").fillna(0.0, subset=["maf"])
    return C.invariant_violations(v, c.carriers, c.membership, c.n_samples)


@query("R02_sliding_windows", sql("rare", """
WITH f AS (SELECT chromosome, min(position) AS mn, max(position) AS mx FROM rare GROUP BY 1),
w AS (SELECT chromosome, mn + k*250 AS s FROM f, LATERAL (SELECT unnest(range((mx - mn)//250 + 1)) AS k))
SELECT w.chromosome, CAST(s AS INTEGER) AS window_start, CAST(s + 500 AS INTEGER) AS window_end, count(*) AS n_variants,
  w.chromosome || ':' || CAST(s AS VARCHAR) || '-' || CAST(s + 500 AS VARCHAR) AS set_id
FROM w JOIN rare r ON r.chromosome = w.chromosome AND r.position >= s AND r.position < s + 500 GROUP BY 1, 2, 3, 5, s HAVING count(*) >= 2"""))
def r02(c: Cohort) -> DataFrame:
    return M.window_sets(M.sliding_window_members(c.rare_index(), 500))


@query("R01_gene_mask_sets", sql("masked membership", """SELECT m.gene_name, mask, arg_min(chromosome, k.variant_id) AS chromosome, min(position) AS start, max(position) AS "end", count(*) AS n_variants
  FROM masked k JOIN membership m USING (variant_id) GROUP BY 1, 2 HAVING count(*) >= 2"""))
def r01(c: Cohort) -> DataFrame:
    return M.gene_mask_sets(c.rare_index().drop("gene_name"), c.membership)
