"""Analysis inputs derived by Spark from the parquet tables, whole tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractwise.operators.delta import delta_table
from tractwise.operators.histograms import add_positions
from tractwise.params import DAY0, TREATED


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("dataset"),
        F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int").alias("brand_no"))


def _group() -> F.Column:
    return F.when(F.col("l_linestatus") == "F", DAY0).otherwise(TREATED)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One read per line item; odd lines on the forward strand, even ones on the reverse."""
    length = F.col("l_quantity").cast("int")
    forward = F.concat(F.lit("ATGGCGACC"), F.repeat(F.lit("CAG"), length), F.lit("CAACAGCCG"))
    backward = F.translate(F.reverse(forward), "ACGT", "TGCA")
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_linestatus")
        .join(_brands(spark, sf_dir), "l_partkey")
        .select(
            "dataset", "brand_no", _group().alias("grp"),
            F.concat(F.lit("r"), F.col("l_linenumber") % 3).alias("sample"),
            F.concat_ws("_", "l_orderkey", "l_linenumber").alias("read_id"),
            length.alias("true_len"),
            F.when(F.col("l_linenumber") % 2 == 1, forward).otherwise(backward).alias("seq"))
    )


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaked histograms. Line items are counted per part before the join, so a hot part is small."""
    counted = (
        table(spark, sf_dir, "lineitem")
        .select("l_partkey", _group().alias("grp"),
                F.concat(F.lit("r"), F.col("l_linenumber") % 3).alias("sample"),
                F.col("l_quantity").cast("int").alias("len"))
        .groupBy("l_partkey", "grp", "sample", "len").agg(F.count("*").alias("n"))
    )
    treated = F.col("grp") == TREATED
    step = (F.col("brand_no") % 3) * 3
    height = F.when(treated, 14 + step).otherwise(17)
    center = F.when(treated, 19 + step).otherwise(22)
    bump = F.greatest(F.lit(0), height - F.abs(F.col("len") - center))
    hist = (
        counted.join(_brands(spark, sf_dir), "l_partkey")
        .groupBy("dataset", "brand_no", "grp", "sample", "len").agg(F.sum("n").alias("n"))
        .select("dataset", "grp", "sample", F.col("len").cast("double").alias("repeat_length"),
                (F.col("n") * (1 + F.pow(bump, F.lit(2)))).cast("double").alias("reads"))
    )
    return add_positions(hist)


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_table(histograms(spark, sf_dir))


def with_sets(df: DataFrame) -> DataFrame:
    """Neighbouring brands form Set 1 and Set 2 of one comparison."""
    number = F.replace("dataset", F.lit("Brand#"), F.lit("")).cast("int")
    return df.withColumn("pair", F.floor((number + 1) / 2).cast("int")).withColumn(
        "set_id", F.when(number % 2 == 1, 1).otherwise(2))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delta series per embedding, as an array in file order."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same series in long form: vec_id, label, x, delta."""
    return vectors(spark, sf_dir).select(
        "vec_id", "label", F.posexplode("vec").alias("x", "delta"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All delta series: the brands' and the embeddings', keyed by dataset."""
    own = deltas(spark, sf_dir).select("dataset", "x", "delta")
    emb = points(spark, sf_dir).select(
        F.concat(F.lit("series_"), F.col("vec_id")).alias("dataset"),
        F.col("x").cast("double").alias("x"), "delta")
    return own.unionByName(emb)
