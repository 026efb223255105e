"""Readers for histogram, delta-series and FASTA files.

A file written by Spark is a folder ``file=<name>`` of part files; its name is then ``<name>``.
Any other file goes by its own name. Small files come as one row each, which settles header and
delimiter by itself, so a folder of millions of them needs no shuffle. Larger ones are read line by line and put back in order by their block
offset, so no file has to fit into one row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tractwise.functions.columns import (base_name, extension, file_group, is_finite, sample_name,
                                         stem, to_number)
from tractwise.functions.ranks import running_sums
from tractwise.params import DAY0

TABLE_GLOB = "*.{histogram,csv,tsv,txt}"
FASTA_GLOB = "*.{[fF][aA],[fF][aA][sS][tT][aA]}"
WHOLE_FILE_BYTES = 8 * 1024 * 1024
HISTOGRAM_HEADER = 6
DELIMITERS = [",", "\t", ";", " "]


def _decoded(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def logical_name(path: Column) -> Column:
    """Name of the file a path belongs to. Paths are URIs; Spark escapes folder values once more."""
    folder = F.regexp_extract(path, r"/file=([^/]+)/[^/]+$", 1)
    return F.when(folder != "", _decoded(_decoded(folder))).otherwise(_decoded(base_name(path)))


def _paths(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path names one existing file, on whatever file system it lives."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.exists(target) and system.getFileStatus(target).isFile()


def _source(spark: SparkSession, paths: str | Sequence[str], glob: str, nested: bool,
            kind: str, **options) -> DataFrame:
    """Folders give the files whose names match the pattern; files named one by one are all read."""
    named = [p for p in _paths(paths) if _is_file(spark, p)]
    folders = [p for p in _paths(paths) if p not in named]
    frames = []
    for group, pattern in ((folders, glob), (named, "*")):
        if group:
            reader = spark.read.format(kind).option("pathGlobFilter", pattern).option(
                "recursiveFileLookup", nested).options(**options)
            frames.append(reader.load(group).select("*", "_metadata"))
    return reduce(DataFrame.unionByName, frames)


def whole_files(spark: SparkSession, paths: str | Sequence[str], glob: str = TABLE_GLOB,
                nested: bool = False, whole_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """path, file and lines (line_no from 0, line; blank ones left out) of every small file."""
    text = _source(spark, paths, glob, nested, "text", wholetext=True)
    cut = F.transform(F.split("value", r"\r\n|\r|\n"), lambda line, i: F.struct(
        i.alias("line_no"), F.rtrim(line).alias("line")))
    return text.filter(F.col("_metadata.file_size") <= whole_bytes).select(
        F.col("_metadata.file_path").alias("path"),
        logical_name(F.col("_metadata.file_path")).alias("file"),
        F.filter(cut, lambda one: F.trim(one["line"]) != "").alias("lines"))


def long_lines(spark: SparkSession, paths: str | Sequence[str], glob: str = TABLE_GLOB,
               nested: bool = False, whole_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """path, file, line_no, filled (number among lines not blank) and line of every large file."""
    text = _source(spark, paths, glob, nested, "text")
    lines = text.filter(F.col("_metadata.file_size") > whole_bytes).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"), F.lit(1).alias("_one"),
        (F.trim("value") != "").cast("int").alias("_full"), F.rtrim("value").alias("line"))
    # lines are counted inside each block and moved on by the blocks before it
    counted = running_sums(lines, ["path"], "_id", "_block", ["_one", "_full"], few_buckets=False)
    return counted.filter("_full = 1").select(
        "path", logical_name(F.col("path")).alias("file"),
        (F.col("cum__one") - 1).cast("int").alias("line_no"),
        (F.col("cum__full") - 1).cast("int").alias("filled"), "line")


def numbered_lines(spark: SparkSession, paths: str | Sequence[str], glob: str = TABLE_GLOB,
                   nested: bool = False, whole_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """path, file, line_no, filled and line of every line that is not blank."""
    small = whole_files(spark, paths, glob, nested, whole_bytes).select(
        "path", "file", F.posexplode("lines").alias("filled", "_l"))
    return small.select("path", "file", "_l.line_no", "filled", "_l.line").unionByName(
        long_lines(spark, paths, glob, nested, whole_bytes))


def _cell(text: Column) -> Column:
    """A field without its surrounding blanks and quotes."""
    return F.regexp_replace(F.trim(text), r'^"(.*)"$', "$1")


def _fields(line: Column, delimiter: Column | str) -> Column:
    """Fields of a line; a comma inside quotes does not split."""
    if isinstance(delimiter, str):
        quoted = delimiter + r'(?=(?:[^"]*"[^"]*")*[^"]*$)'
        return F.split(line, quoted)
    return F.split(line, delimiter)


def _split_by_name(name: Column, line: Column) -> Column:
    tabbed = extension(name).isin(".tsv", ".histogram")
    return F.when(tabbed, _fields(line, "\t")).otherwise(_fields(line, ","))


def _holds(delimiter: str) -> Callable[[Column], Column]:
    return lambda line: F.contains(F.trim(line), F.lit(delimiter))


def _most_found(counts: list[Column]) -> Column:
    """The delimiter that the most lines hold, if any; ties to the first."""
    most = F.greatest(*counts)
    found = F.lit(None).cast("string")
    for n, d in reversed(list(zip(counts, DELIMITERS))):
        found = F.when((n == most) & (most > 0), F.lit(d)).otherwise(found)
    return found


def _sniffed(line: Column) -> Column:
    """Fields by the delimiter in ``_delim``."""
    fields = F.lit(None).cast("array<string>")
    for d in DELIMITERS:
        fields = F.when(F.col("_delim") == d, _fields(F.trim(line), " +" if d == " " else d)).otherwise(fields)
    return fields


def read_table_rows(spark: SparkSession, paths: str | Sequence[str], nested: bool = False,
                    whole_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """First two fields of every line as text, headers of .histogram files skipped.

    A file whose lines never split by the delimiter of its extension is tried with the others,
    and the one found on most of its lines is used. Files no delimiter splits give no rows.
    ``pos`` numbers the lines that are not blank. A small file settles all this inside its row.
    """
    header = F.when(extension(F.col("file")) == ".histogram", HISTOGRAM_HEADER).otherwise(0)

    small = whole_files(spark, paths, nested=nested, whole_bytes=whole_bytes).withColumn(
        "_body", F.transform(F.filter("lines", lambda one: one["line_no"] >= header), lambda one: one["line"]))
    judged = small.select(
        "path", "file", "_body",
        F.exists("_body", lambda line: F.size(_split_by_name(F.col("file"), line)) >= 2).alias("_fits"),
        _most_found([F.size(F.filter("_body", _holds(d))) for d in DELIMITERS]).alias("_delim"))
    near = judged.select("path", "file", "_fits", "_delim", F.posexplode("_body").alias("pos", "line"))

    body = long_lines(spark, paths, nested=nested, whole_bytes=whole_bytes).filter(F.col("line_no") >= header)
    verdict = body.groupBy("path").agg(
        F.bool_or(F.size(_split_by_name(F.col("file"), F.col("line"))) >= 2).alias("_fits"),
        _most_found([F.count_if(_holds(d)(F.col("line"))) for d in DELIMITERS]).alias("_delim"),
        F.min("filled").alias("_first"))
    far = body.join(verdict, "path").select(
        "path", "file", "_fits", "_delim", (F.col("filled") - F.col("_first")).alias("pos"), "line")

    resolved = near.unionByName(far).withColumn("_parts", F.when(
        F.col("_fits"), _split_by_name(F.col("file"), F.col("line"))).otherwise(_sniffed(F.col("line"))))
    return resolved.filter(F.size("_parts") >= 2).select(
        "path", "file", "pos",
        _cell(F.col("_parts")[0]).alias("x_text"), _cell(F.col("_parts")[1]).alias("y_text"))


def logical_path(path: Column) -> Column:
    """The path of a file, the same for all parts of a file written by Spark."""
    return F.regexp_replace(path, r"(/file=[^/]+)/[^/]+$", "$1")


def sample_key(found: DataFrame, short: Column) -> Column:
    """One sample per file: the short name where it tells the files of a group apart, else the
    file's name, else its path. ``found`` has dataset, grp, path and file of every file."""
    counts = found.groupBy("dataset", "grp").agg(
        F.count_distinct(short).alias("short"), F.count_distinct("file").alias("named"),
        F.count_distinct(logical_path(F.col("path"))).alias("files"))
    plain = counts.agg(F.bool_and(F.col("short") == F.col("files")).alias("short"),
                       F.bool_and(F.col("named") == F.col("files")).alias("named")).first()
    if plain["short"] is None or plain["short"]:
        return short
    return F.col("file") if plain["named"] else logical_path(F.col("path"))


def listed(spark: SparkSession, paths: str | Sequence[str], glob: str, nested: bool) -> DataFrame:
    """path and file of every file; nothing of the files is read."""
    return _source(spark, paths, glob, nested, "binaryFile").select(
        F.col("_metadata.file_path").alias("path"), logical_name(F.col("_metadata.file_path")).alias("file"))


def read_histograms(spark: SparkSession, paths: str | Sequence[str], dataset: Column | None = None,
                    grp: Column | None = None, default_group: str = DAY0, nested: bool = False,
                    whole_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """The long histogram table. Rows without two numbers are dropped.

    ``dataset`` and ``grp`` may be given as expressions over ``path`` and ``file``; by default
    there is one dataset and the group comes from the file name. Infinite reads stay: they make
    the sample's range non-finite, so the sample is dropped as a whole later. Every file is a
    sample of its own, see :func:`sample_key`.
    """
    keys = [(dataset if dataset is not None else F.lit("all")).alias("dataset"),
            (grp if grp is not None else file_group(F.col("file"), default_group)).alias("grp")]
    found = listed(spark, paths, TABLE_GLOB, nested).select(*keys, "path", "file")
    rows = read_table_rows(spark, paths, nested, whole_bytes)
    return rows.select(
        *keys, sample_key(found, sample_name(F.col("file"))).alias("sample"), "pos",
        to_number(F.col("x_text")).alias("repeat_length"),
        to_number(F.col("y_text")).alias("reads"),
    ).dropna(subset=["repeat_length", "reads"])


def read_delta_files(spark: SparkSession, paths: str | Sequence[str], loose: bool = False,
                     nested: bool = False, whole_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """dataset, file, pos, x, delta, reason from .csv files with a header line.

    x is the first column, delta the column of that name (trimmed and in any case with
    ``loose``). Each file resolves its own header. Files without such a column keep one row with
    a ``reason``; :func:`delta_series` and :func:`skipped_files` tell the two apart.
    """
    # part files of a folder written by Spark may end in .txt; the logical name decides
    table = extension(F.col("file")) == ".csv"

    def delta_at(line: Column) -> Column:
        names = F.transform(_fields(line, ","), _cell)
        wanted = F.transform(names, lambda n: F.lower(F.trim(n))) if loose else names
        return F.array_position(wanted, "delta").cast("int")

    pattern = "*.{csv,txt}"
    small = whole_files(spark, paths, pattern, nested, whole_bytes).filter(table).withColumn(
        "_at", F.coalesce(delta_at(F.get("lines", F.lit(0))["line"]), F.lit(0)))
    body = F.slice("lines", 2, F.size("lines"))
    near = small.select("file", "_at", F.posexplode(
        F.when(F.col("_at") > 0, body).otherwise(F.slice("lines", 1, 1))).alias("pos", "_l")).select(
        "file", "_at", F.when(F.col("_at") > 0, F.col("pos") + 1).alias("pos"), "_l.line")
    blank = small.filter(F.size("lines") == 0).select("file", "_at")

    lines = long_lines(spark, paths, pattern, nested, whole_bytes).filter(table)
    heads = lines.filter("filled = 0").select("path", delta_at(F.col("line")).alias("_at"))
    far = lines.join(heads, "path").filter((F.col("filled") > 0) == (F.col("_at") > 0)).select(
        "file", "_at", F.when(F.col("_at") > 0, F.col("filled")).alias("pos"), "line")

    rows = near.unionByName(far).unionByName(blank, allowMissingColumns=True)
    fields = _fields(F.col("line"), ",")
    known = F.col("_at") > 0
    return rows.select(
        stem(F.col("file")).alias("dataset"), "file", F.col("pos").cast("int").alias("pos"),
        F.when(known, to_number(_cell(fields[0]))).alias("x"),
        F.when(known, to_number(_cell(F.get(fields, F.col("_at") - 1)))).alias("delta"),
        F.when(~known, F.lit("no 'delta' column")).alias("reason"))


def delta_series(read: DataFrame) -> DataFrame:
    usable = F.col("reason").isNull() & is_finite(F.col("x")) & F.col("delta").isNotNull()
    return read.filter(usable).select("dataset", "pos", "x", "delta")


def skipped_files(read: DataFrame) -> DataFrame:
    return read.filter(F.col("reason").isNotNull()).select("file", "reason")


def read_fasta(spark: SparkSession, paths: str | Sequence[str], nested: bool = False) -> DataFrame:
    """path, file, grp, read_id, seq of every record; record-wise, so large files split."""
    reader = spark.read.option("recursiveFileLookup", nested)
    if not nested:
        reader = reader.option("pathGlobFilter", FASTA_GLOB)
    records = reader.text(_paths(paths), lineSep="\n>").select(
        F.col("_metadata.file_path").alias("path"),
        logical_name(F.col("_metadata.file_path")).alias("file"),
        F.regexp_replace("value", "^\\s*>", "").alias("value"))
    if nested:
        records = records.filter(extension(F.col("file")).isin(".fa", ".fasta"))
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s+", "")
    return records.filter(F.trim("value") != "").select(
        "path", "file", file_group(F.col("file")).alias("grp"),
        F.element_at(F.split(F.trim(head), r"\s+"), 1).alias("read_id"), body.alias("seq"))
