"""Writers. Every logical file becomes a folder ``file=<name>`` the readers understand."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tractwise.params import DAY0
from tractwise.sources.files import HISTOGRAM_HEADER


def write_line_files(rows: DataFrame, file: Column, order: Sequence[str], line: Column, path: str,
                     header: Sequence[str] = ()) -> str:
    """Text files with ordered lines, each written by one task; the tasks share the files evenly.

    Meant for files of bounded size, such as one histogram or one delta series each.
    """
    body = rows.select(file.alias("file"), F.lit(1).alias("_part"),
                       F.struct(*order).alias("_order"), line.alias("value"))
    if header:
        heads = rows.select(file.alias("file")).distinct().select(
            "file", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(h).alias("value"))
                                        for i, h in enumerate(header)])).alias("_h"))
        tops = heads.select("file", F.lit(0).alias("_part"), F.col("_h.i").alias("_i"),
                            F.col("_h.value").alias("value"))
        body = body.withColumn("_i", F.lit(0)).unionByName(tops, allowMissingColumns=True)
    else:
        body = body.withColumn("_i", F.lit(0))
    placed = body.repartition("file").sortWithinPartitions("file", "_part", "_i", "_order")
    placed.select("file", "value").write.partitionBy("file").mode("overwrite").text(path)
    return path


def write_histograms(hist: DataFrame, path: str, profile: str = "restrictive",
                     name: Column | None = None) -> str:
    """One .histogram file per sample below <path>/grp=<Day0|treated>, named .rest or .per."""
    mark = "rest" if profile == "restrictive" else "per"
    base = name if name is not None else F.concat_ws("_", "dataset", "grp", "sample")
    file = F.concat(base, F.lit(f".{mark}.histogram"))
    line = F.concat_ws("\t", "repeat_length", "reads")
    body = hist.select("grp", file.alias("file"), F.lit(1).alias("_part"), F.lit(0).alias("_i"),
                       "pos", line.alias("value"))
    heads = hist.select("grp", file.alias("file")).distinct().select(
        "grp", "file", F.lit(0).alias("_part"),
        F.explode(F.sequence(F.lit(1), F.lit(HISTOGRAM_HEADER))).alias("_i"), F.lit(0).alias("pos"))
    rows = body.unionByName(heads.withColumn("value", F.concat(F.lit("# header "), "_i")))
    placed = rows.repartition("grp", "file").sortWithinPartitions("grp", "file", "_part", "_i", "pos")
    placed.select("grp", "file", "value").write.partitionBy("grp", "file").mode(
        "overwrite").text(path)
    return path


def write_delta_csv(wide: DataFrame, path: str, second_set: Column | None = None) -> str:
    """One delta CSV per dataset, ``_set2`` appended to the name of second sets."""
    names = [c for c in wide.columns if c not in ("dataset", "set_id", "pair")]
    suffix = F.lit("") if second_set is None else F.when(second_set, "_set2").otherwise("")
    file = F.concat(F.col("dataset"), suffix, F.lit(".csv"))
    line = F.concat_ws(",", *[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names])
    return write_line_files(wide, file, [f"`{names[0]}`"], line, path, [",".join(names)])


def write_fasta(reads: DataFrame, path: str, file: Column) -> str:
    """FASTA records by file. Rebalancing gathers small files and splits hot ones over tasks."""
    record = F.concat(F.lit(">"), "read_id", F.lit("\n"), "seq")
    rows = reads.select(file.alias("file"), record.alias("value")).hint("rebalance", "file")
    rows.write.partitionBy("file").mode("overwrite").text(path)
    return path


def results_text(table: DataFrame) -> DataFrame:
    """The instability records as report lines, rounded half-even to two digits."""
    def two(name: str) -> Column:
        return (F.bround(name, 2) + F.lit(0.0)).cast("string")

    lines = F.array(
        F.concat(F.lit("Sample: "), "sample"), F.concat(F.lit("Mode: "), F.col("mode").cast("string")),
        F.concat(F.lit("Instability Index: "), two("instability_index")),
        F.concat(F.lit("Contraction Index: "), two("contraction_index")),
        F.concat(F.lit("Expansion Index: "), two("expansion_index")), F.lit("__________"))
    return table.select("dataset", "grp", F.array_join(lines, "\n").alias("value"))


def write_results(table: DataFrame, path: str) -> str:
    """Append the report lines below <path>/grp=..."""
    results_text(table).select("grp", "value").write.partitionBy("grp").mode("append").text(path)
    return path


def write_csv(table: DataFrame, path: str) -> str:
    table.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_batch(tables: Mapping[str, DataFrame], path: str) -> str:
    """Write the named tables of a batch as CSV, and only then the manifest that makes them count.

    Every batch has a folder of its own, so a batch that fails half-way is never read and a later
    one never mixes with an earlier one. The manifest is a table too: name, folder, columns and time.
    """
    batch, spark, rows = uuid.uuid4().hex, None, []
    for name, table in tables.items():
        spark = table.sparkSession
        folder = f"{path}/batches/{batch}/{name}"
        table.write.option("header", True).option("quote", '"').option("escape", '"').csv(folder)
        rows.append((name, batch, table.schema.json()))
    if spark is not None:
        manifest = spark.createDataFrame(rows, "name string, batch string, columns string").withColumn("at", F.current_timestamp())
        manifest.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return path


def read_batch(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the last whole batch below a path, with the types they were written with."""
    manifest = spark.read.parquet(f"{path}/manifest")
    last = manifest.orderBy(F.desc("at"), F.desc("batch")).select("batch").limit(1)
    found = manifest.join(last, "batch").select("name", "batch", "columns").collect()
    # a quoted text may hold line ends; a file is what one task wrote, so it need not be split
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    return {r["name"]: reader.schema(StructType.fromJson(json.loads(r["columns"]))).csv(f"{path}/batches/{r['batch']}/{r['name']}")
            for r in found}


def output_folder(grp: Column) -> Column:
    return F.when(grp == DAY0, "Day0_histograms").otherwise("treated_histograms")
