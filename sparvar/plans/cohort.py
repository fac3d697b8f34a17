"""Maps the driver's order tables onto a cohort (see FIXTURES.md, part C).

Parts act as variants, customers as samples, and an order line as one copy of
an alternate allele.  Everything is integer arithmetic on the given tables, so
the cohort grows with them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cohort import allele_frequencies
from ..schemas import CHANNELS

RARE_MAX_COUNT = 35


class Cohort:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ------------------------------------------------------------- variants

    @cached_property
    def variants(self) -> DataFrame:
        p = F.col("p_partkey")
        base = F.lit("ACGT")
        ref_i = (p % 4).cast("int")
        alt_i = ((p % 4 + 1 + F.floor(p / 4) % 3) % 4).cast("int")
        return self.table("part").select(
            p.alias("variant_id"),
            (p % 22 + 1).cast("string").alias("chromosome"),
            (F.floor(p / 22) * 50 + 1000).cast("int").alias("position"),
            F.substring(base, ref_i + 1, F.lit(1)).alias("ref"),
            F.substring(base, alt_i + 1, F.lit(1)).alias("alt"),
        )

    @cached_property
    def annotation_raw(self) -> DataFrame:
        """Nested annotation table keyed by chromosome, position and alleles."""
        p, size, kind = F.col("p_partkey"), F.col("p_size"), F.col("p_type")

        def phred(channel: int):
            v = (size * (channel + 1)) % 40
            return F.when(v != 0, v.cast("float"))

        csq = (
            F.when(kind == "SMALL", "stopgain").when(kind == "ECONOMY", "nonsynonymous SNV")
            .when(kind == "MEDIUM", "synonymous SNV").when(kind == "PROMO", "frameshift deletion")
        )
        region = F.when(kind == "LARGE", "splicing").when(kind == "STANDARD", "UTR3").otherwise("exonic")
        apc_names = [
            "epigenetics_active", "epigenetics_repressed", "epigenetics_transcription",
            "conservation_v2", "protein_function_v3", "local_nucleotide_diversity_v3",
            "mutation_density", "transcription_factor",
        ]
        keyed = self.variants.join(
            self.table("part").select("p_partkey", "p_brand", "p_type", "p_size"),
            F.col("variant_id") == p,
        )
        return keyed.select(
            "variant_id", "chromosome", "position",
            F.col("ref").alias("ref_vcf"), F.col("alt").alias("alt_vcf"),
            F.struct(
                region.alias("region_type"),
                F.array(F.col("p_brand")).alias("genes"),
                csq.alias("consequence"),
            ).alias("gencode"),
            F.struct(F.struct((size / 2).cast("float").alias("raw"), phred(0).alias("phred")).alias("cadd")).alias("main"),
            F.struct(
                F.when(size % 4 != 0, (size / 50).cast("float")).alias("revel"),
                F.when(size % 3 == 0, "D").when(size % 3 == 1, "T").alias("metasvm_pred"),
            ).alias("dbnsfp"),
            F.struct(F.when(size % 17 == 0, F.concat(F.lit("GH"), size.cast("string"))).alias("id")).alias("genehancer"),
            phred(1).alias("linsight"),
            phred(2).alias("fathmm_xf"),
            F.struct(
                F.when(size % 5 == 0, "prom").alias("cage_promoter"),
                F.when(size % 7 == 0, "enh").alias("cage_enhancer"),
            ).alias("cage"),
            F.struct(
                F.concat_ws(
                    ",", F.when(size % 11 == 0, "PLS"), F.when(size % 13 == 0, "dELS")
                ).alias("annotations")
            ).alias("ccre"),
            F.struct(*[phred(3 + i).alias(n) for i, n in enumerate(apc_names)]).alias("apc"),
        )

    @cached_property
    def membership_fine(self) -> DataFrame:
        return self._by_flag(self.membership, True)

    @cached_property
    def membership(self) -> DataFrame:
        """(variant_id, gene_name); every tenth variant also sits in a second gene."""
        part = self.table("part")
        second = F.concat(F.lit("Brand#"), (F.col("p_partkey") % 25 + 1).cast("string"))
        genes = F.when(
            F.col("p_partkey") % 10 == 0, F.array_distinct(F.array("p_brand", second))
        ).otherwise(F.array("p_brand"))
        return part.select(F.col("p_partkey").alias("variant_id"), F.explode(genes).alias("gene_name"))

    # -------------------------------------------------------------- samples

    @cached_property
    def samples(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("sample_idx"), F.col("c_name").alias("sample_id")
        )

    @cached_property
    def phenotype(self) -> DataFrame:
        nation = self.table("nation").select("n_nationkey", "n_regionkey")
        return self.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("sample_idx"),
            F.col("c_name").alias("sample_id"),
            F.col("c_acctbal").alias("y"),
            F.when(F.col("c_acctbal") > 4500, 1.0).otherwise(0.0).alias("yb"),
            (F.col("c_acctbal") * 0.5 + (F.col("c_custkey") % 7) * 300).alias("y2"),
            F.when((F.col("c_acctbal") + (F.col("c_custkey") % 7) * 900) > 7000, 1.0).otherwise(0.0).alias("yb2"),
            F.col("c_nationkey").cast("double").alias("x1"),
            F.when(F.col("c_mktsegment") == "BUILDING", 1.0).otherwise(0.0).alias("x2"),
            F.col("n_regionkey").cast("int").alias("ancestry"),
        )

    COVARIATES = ["x1", "x2"]

    # ------------------------------------------------------------- genotypes

    def _by_flag(self, rows: DataFrame, fine: bool) -> DataFrame:
        """Rows of parts as rows of their three finer variants."""
        if not fine:
            return rows
        return rows.withColumn("variant_id", F.explode(F.array(*[F.col("variant_id") * 3 + k for k in range(3)])))

    def _carriers(self, fine: bool) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
        if fine:
            flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
            lines = lines.withColumn("l_partkey", F.col("l_partkey") * 3 + flag)
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        return (
            lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(F.col("l_partkey").alias("variant_id"), F.col("o_custkey").alias("sample_idx"))
            .agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("dosage"))
        )

    @cached_property
    def carriers(self) -> DataFrame:
        return self._carriers(fine=False)

    @cached_property
    def carriers_fine(self) -> DataFrame:
        """All lines, a variant for every part and return flag: about ten allele copies each,
        so both sides of the count-10 rule occur."""
        return self._carriers(fine=True)

    @cached_property
    def n_samples(self) -> int:
        return self.samples.count()

    def frequencies(self, fine: bool = False) -> DataFrame:
        return allele_frequencies(self.carriers_fine if fine else self.carriers, self.n_samples)

    def variant_index(self, fine: bool = False) -> DataFrame:
        """Variants with frequency, annotation and channel weights (w0..w10)."""
        from ..operators.annotate import extract_annotation, with_weights

        ann = with_weights(extract_annotation(self.annotation_raw, keep=["variant_id", "chromosome", "position", "ref_vcf", "alt_vcf"]))
        return self._by_flag(ann, fine).withColumnsRenamed({"ref_vcf": "ref", "alt_vcf": "alt"}).join(self.frequencies(fine), "variant_id")

    def rare_index(self, fine: bool = False) -> DataFrame:
        return self.variant_index(fine).filter(F.col("ac") <= RARE_MAX_COUNT)

    # ------------------------------------------------------------ relatedness

    @cached_property
    def kin_pairs(self) -> DataFrame:
        """Off-diagonal kinship 0.5 between members of a three-person family."""
        s = self.samples.select("sample_idx", F.floor(F.col("sample_idx") / 3).alias("family"))
        other = s.select(F.col("sample_idx").alias("j"), "family")
        return s.select(F.col("sample_idx").alias("i"), "family").join(other, "family").filter("i < j").select(
            "i", "j", F.lit(0.5).alias("value")
        )

    @cached_property
    def king_rows(self) -> DataFrame:
        """Relatedness segments for consecutive family members, as text columns."""
        i = F.col("sample_idx")
        kind = F.element_at(F.array(*[F.lit(k) for k in ("PO", "FS", "2nd", "3rd")]), (F.floor(i / 3) % 4 + 1).cast("int"))
        nxt = self.samples.select((F.col("sample_idx") - 1).alias("sample_idx"), F.col("sample_id").alias("id2"))
        return self.samples.join(nxt, "sample_idx").filter(i % 3 != 2).select(
            F.lit("F").alias("FID1"), F.col("sample_id").alias("ID1"),
            F.lit("F").alias("FID2"), F.col("id2").alias("ID2"),
            F.format_string("%.4f", 0.05 + (i % 8) / 16).alias("PropIBD"), kind.alias("InfType"),
        )

    # ------------------------------------------------------------------ text

    @cached_property
    def vcf_lines(self) -> DataFrame:
        """Site-only VCF text with the irregularities the reader has to handle."""
        return self.vcf_with_id.select("value")

    @cached_property
    def vcf_with_id(self) -> DataFrame:
        p = F.col("p_partkey")
        v = self.variants.join(self.table("part").select("p_partkey", "p_size"), F.col("variant_id") == p)
        ref = F.when(p % 5 == 0, F.concat(F.lit("GG"), "ref", F.lit("TC"))).otherwise(F.col("ref"))
        alt = F.when(p % 5 == 0, F.concat(F.lit("GG"), "alt", F.lit("TC"))).otherwise(F.col("alt"))
        alt = F.when(p % 9 == 0, F.concat_ws(",", alt, F.concat(ref, F.lit("T")))).otherwise(alt)
        alt = F.when(p % 17 == 0, F.concat_ws(",", alt, F.lit("<DEL>"))).otherwise(alt)
        alt = F.when(p % 3 == 0, F.lower(alt)).otherwise(alt)
        chrom = F.when(p % 2 == 1, F.concat(F.lit("chr"), "chromosome")).otherwise(F.col("chromosome"))
        chrom = F.when(p % 97 == 5, "chrUn_KI270302v1").when(p % 97 == 6, "chrM").when(p % 97 == 7, "23").otherwise(chrom)
        return v.select(
            "variant_id",
            F.concat_ws(
                "\t", chrom, F.col("position").cast("string"),
                F.when(p % 6 == 0, ".").otherwise(F.concat(F.lit("rs"), p.cast("string"), F.lit(";alias"))),
                ref, alt,
                F.when(p % 4 == 0, ".").otherwise(F.col("p_size").cast("string")),
                F.when(p % 8 == 0, "q10").otherwise("PASS"),
                F.lit("."),
            ).alias("value")
        )


CHANNEL_WEIGHTS = [f"w{i}" for i in range(len(CHANNELS))]
