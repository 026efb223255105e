"""Line dedup: a segment-partition edit join. DataFrame functions only.

A line that has a letter or digit is dropped if an equal line occurs earlier, or one within ``EDITS`` edits,
if it has ``LEAST_CHARS`` characters. Lines come
in the order of doc_id and place. Of two lines within t edits, one of the t + 1 segments of the
shorter one (of both, if equally long) occurs unchanged in the other, at a place that the lengths
leave few choices for; segments and those substrings meet by hash, and their lines are compared.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tractwise.session import release, settle

EDITS = 2
LEAST_CHARS = 20  # of a line that others may be near; shorter ones go as exact copies only, as two edits make other words of them
WORDS = 1 << 17  # of 64 bits, in the fixed-size filters that only save shuffling


def segments(n: Column, edits: int) -> list[tuple[Column, Column]]:
    """First place (from 1) and length of the segments of a line of n characters; the last ones are longer."""
    parts = edits + 1
    base, longer = F.floor(n / parts).cast("int"), (n % parts).cast("int")
    out, at = [], F.lit(1)
    for i in range(parts):
        size = base + F.when(F.lit(parts - i) <= longer, 1).otherwise(0)
        out.append((at, size))
        at = at + size
    return out


def places(edits: int) -> list[tuple[int, int, int]]:
    """(difference of lengths, segment, shift): where a line can hold a shorter line's segment.

    Left of segment i no more than i edits are left to shift it, or else an earlier segment is the
    unchanged one; likewise from the right.
    """
    out = []
    for shorter in range(edits + 1):
        for i in range(edits + 1):
            for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + edits - i) + 1):
                out.append((shorter, i, shift))
    return out


def key_columns(line: Column, n: Column, edits: int) -> dict[str, Column]:
    """Hashes of segments and substrings; where the lengths are equal and nothing shifts, they are the same."""
    keys = {}
    for shorter, i, shift in places(edits):
        at, size = segments(n - shorter, edits)[i]
        found = F.xxhash64(n - shorter, F.lit(i), F.substring(line, at + shift, size))
        keys[f"k_{shorter}_{i}_{shift + edits}"] = found
    return keys


def _own(name: str, edits: int) -> bool:
    """Whether the key is a segment of the line itself."""
    _, shorter, _, shift = name.split("_")
    return shorter == "0" and int(shift) == edits


def line_table(docs: DataFrame, least: int, edits: int | None) -> DataFrame:
    """doc_id, pos, line, n, h, place in the order of all lines, and the keys of those of ``least`` characters.

    Blank lines and lines of signs alone aren't in it: they always stay.
    """
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.posexplode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")).alias("pos", "line"))
    lines = lines.withColumn("n", F.length("line")).filter(F.col("line").rlike(r"[\p{L}\p{N}]")).withColumn("h", F.xxhash64("line"))
    order = F.coalesce(F.col("doc_id"), F.lit(2 ** 63 - 1)).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("pos")
    lines = lines.withColumn("place", order.cast("decimal(38,0)"))
    if edits is None:
        return lines
    keys = key_columns(F.col("line"), F.col("n"), edits)
    return lines.withColumns({name: F.when(F.col("n") >= least, key) for name, key in keys.items()})


def fixed_filter(values: DataFrame, name: str) -> Column:
    """One array of ``WORDS`` longs in which every value has its bit set; others may pass it too."""
    place = F.pmod(F.col(name), F.lit(WORDS * 64))
    set_ = values.select(F.shiftright(place, 6).alias("word"), F.pmod(place, F.lit(64)).cast("int").alias("bit"))
    set_ = set_.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    every = values.sparkSession.range(WORDS).withColumnRenamed("id", "word").join(set_, "word", "left")
    row = settle(every.agg(F.sort_array(F.collect_list(F.struct(
        "word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("m")).select(F.col("m.bits").alias("m")))
    return row.scalar()


def passes(name: str, bits: Column) -> Column:
    place = F.pmod(F.col(name), F.lit(WORDS * 64))
    word = F.element_at(bits, (F.shiftright(place, 6) + 1).cast("int"))
    return F.getbit(word, F.pmod(place, F.lit(64)).cast("int")) == 1


def once(value: Column) -> Column:
    """The value as a row of its own: Spark then doesn't compute it again for every use."""
    return F.explode(F.array(value))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, by doubling and halving steps."""
    steps = F.reverse(F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.length(a), F.length(b), F.lit(1)))).cast("int")),
                                  lambda i: F.pow(F.lit(2), i).cast("int")))
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when(
        (n + s <= F.least(F.length(a), F.length(b))) & (F.substring(a, n + 1, s) == F.substring(b, n + 1, s)), n + s).otherwise(n))


def within(pairs: DataFrame, a: str, b: str, edits: int) -> DataFrame:
    """Those pairs whose texts are at most ``edits`` edits apart, by bit-parallel steps inside the band.

    After what the texts share at both ends is cut off, every character of b moves ``edits + 1``
    bit vectors: vector e holds, for the diagonals from -edits to edits, which prefixes of a can be
    turned into what was read of b with e edits. A pair is given up when the last one is empty.
    """
    start = pairs.withColumn("_p", once(common_prefix(F.col(a), F.col(b))))
    rest = F.struct(*[F.reverse(F.substring(F.col(c), F.col("_p") + 1, F.length(c))).alias(n) for c, n in ((a, "x"), (b, "y"))])
    start = start.withColumn("_r", once(rest))
    start = start.withColumn("_s", once(common_prefix(F.col("_r.x"), F.col("_r.y"))))
    core = [F.reverse(F.substring(F.col(f"_r.{c}"), F.col("_s") + 1, F.length(f"_r.{c}"))).alias(c) for c in "xy"]
    cut = start.withColumn("_c", once(F.struct(*core))).filter(F.abs(F.length("_c.x") - F.length("_c.y")) <= edits)
    cut = cut.withColumns({f"_{c}s": F.when(F.length(f"_c.{c}") > 0, F.split(f"_c.{c}", "")).otherwise(
        F.array().cast("array<string>")) for c in "xy"})
    cut = cut.withColumn("_c", once(F.struct(F.col("_xs").alias("x"), F.col("_ys").alias("y"))))
    width = 2 * edits + 1
    full = (1 << width) - 1

    def same(c: Column, j: Column) -> Column:
        bits = [F.when(F.get(F.col("_c.x"), j + (b_ - edits)) == c, F.lit(1 << b_)).otherwise(F.lit(0)) for b_ in range(width)]
        return reduce(lambda p, q: p.bitwiseOR(q), bits).cast("long")

    first = F.struct(*[F.lit(sum(1 << (edits + i) for i in range(e + 1))).cast("long").alias(f"r{e}") for e in range(edits + 1)])

    def step(r: Column, m: Column) -> Column:
        rows = [r.getField("r0").bitwiseAND(m)]
        for e in range(1, edits + 1):
            old = r.getField(f"r{e - 1}")
            new = r.getField(f"r{e}").bitwiseAND(m).bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(rows[-1], 1))
            rows.append(new.bitwiseAND(F.lit(full).cast("long")))
        moved = F.struct(*[x.alias(f"r{e}") for e, x in enumerate(rows)])
        return F.when(r.getField(f"r{edits}") == 0, r).otherwise(moved)

    matches = F.transform(F.col("_c.y"), lambda c, j: same(c, j))
    last = F.aggregate(matches, first, step).getField(f"r{edits}")
    at = F.size("_c.x") - F.size("_c.y") + edits
    return cut.filter(F.getbit(last, at) == 1).select(*pairs.columns)


def _texts(docs: DataFrame, ids: DataFrame, least: int) -> DataFrame:
    """h and line of the lines with those hashes (and a few more)."""
    wanted = passes("h", fixed_filter(ids, "h"))
    return settle(line_table(docs, least, None).filter(F.col("n") >= least).select("h", "line").filter(wanted).distinct())


def _verified(texts: DataFrame, pairs: DataFrame, edits: int) -> DataFrame:
    """The hashes h of lines that have a line o of their pairs within ``edits`` edits."""
    both = pairs.join(texts.withColumnRenamed("line", "a"), "h").join(
        texts.select(F.col("h").alias("o"), F.col("line").alias("b")), "o")
    return within(both.select("h", "a", "b"), "a", "b", edits).select("h").distinct()


def parity(parts: Column) -> Column:
    """64 bits, of which every part flips one."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(c), F.lit(64)))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda s, c: s.bitwiseXOR(bit(c)))


def _sketched(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Parity sketches of characters and of pairs of them: an edit flips no more than 2 and 4 bits."""
    own = texts.join(ids.select("h").distinct(), "h", "left_semi").withColumn("chars", once(F.split("line", "")))
    pairs = F.transform("chars", lambda c, i: F.concat(c, F.coalesce(F.get("chars", i + 1), F.lit(""))))
    return settle(own.select("h", parity(F.col("chars")).alias("ones"), parity(pairs).alias("twos")))


def near_lines(docs: DataFrame, least: int = LEAST_CHARS, edits: int = EDITS) -> tuple[DataFrame, DataFrame]:
    """All distinct lines with the place of their first occurrence; and the hashes of those that go
    because an earlier line is near them.

    Copies of a line are one row before anything is joined. Every bucket first compares its lines
    with its earliest one; only those that this doesn't decide meet the other earlier ones.
    """
    lines = line_table(docs, least, edits)
    names = [c for c in lines.columns if c.startswith("k_")]
    distinct = settle(lines.groupBy("h", "n").agg(F.min("place").alias("place"), *[F.first(c).alias(c) for c in names]))
    key = F.explode(F.array(*[F.struct(F.col(c).alias("key"), F.lit(_own(c, edits)).alias("own")) for c in names])).alias("k")
    shared = distinct.filter(F.col("n") >= least).select(key).groupBy("k.key").agg(F.count_if("k.own").alias("owns"), F.count("*").alias("all"))
    shared = settle(shared.filter("owns > 0 AND all > 1").select("key"))
    rows = distinct.filter(F.col("n") >= least).select("h", "place", key).select("h", "place", "k.key", "k.own")
    rows = settle(rows.filter(passes("key", fixed_filter(shared, "key"))).join(shared, "key"))

    # A line may be compared with the owner of a segment, or own a segment that the other line has.
    leads = rows.groupBy("key").agg(
        F.min_by("h", "place").alias("any_h"), F.min("place").alias("any_place"),
        F.min_by(F.when(F.col("own"), F.col("h")), F.when(F.col("own"), F.col("place"))).alias("own_h"),
        F.min(F.when(F.col("own"), F.col("place"))).alias("own_place"))
    led = rows.join(leads, "key")
    first = led.select("h", F.when(F.col("own"), F.col("any_h")).otherwise(F.col("own_h")).alias("o"), "place",
                       F.when(F.col("own"), F.col("any_place")).otherwise(F.col("own_place")).alias("o_place"))
    first = settle(first.filter("o_place < place AND o <> h").select("h", "o").distinct())
    texts = _texts(docs, rows.select("h"), least)
    gone = settle(_verified(texts, first, edits))

    # Two lines that the sketches hold apart never become a row, however many share a bucket.
    left = led.join(gone, "h", "left_anti").filter("own_place < place OR (own AND any_place < place)")
    left = left.join(rows.groupBy("key").agg(F.count("*").alias("all")).filter("all > 2").select("key"), "key", "left_semi")
    left = settle(left.select("key", "h", "place", "own"))
    others = rows.join(left.select("key").distinct(), "key", "left_semi")
    marks = _sketched(texts, others)
    others = others.join(marks, "h").select("key", F.col("h").alias("o"), F.col("place").alias("o_place"),
                                            F.col("own").alias("o_own"), F.struct("ones", "twos").alias("y"))
    near = (F.bit_count(F.col("ones").bitwiseXOR(F.col("y.ones"))) <= 2 * edits) & (
        F.bit_count(F.col("twos").bitwiseXOR(F.col("y.twos"))) <= 4 * edits)
    second = left.join(marks, "h").join(others, "key").filter("(own OR o_own) AND o_place < place AND o <> h").filter(near)
    second = settle(second.select("h", "o").distinct().join(first, ["h", "o"], "left_anti"))
    all_ = settle(gone.unionByName(_verified(texts, second, edits)).distinct())
    release(shared, rows, first, texts, gone, left, marks, second)
    return distinct, all_


def removed(docs: DataFrame, least: int = LEAST_CHARS, edits: int = EDITS) -> DataFrame:
    """doc_id, pos and h of every line that goes."""
    distinct, gone = near_lines(docs, least, edits)
    fate = settle(distinct.select("h", "n", "place").join(gone.withColumn("near", F.lit(True)), "h", "left"))
    release(distinct, gone)
    lines = line_table(docs, least, None).select("doc_id", "pos", "h", "n", "place")
    own = lines.join(fate.withColumnRenamed("place", "first"), ["h", "n"])
    return own.filter("near OR place > first").select("doc_id", "pos", "h")


def dedup_lines(docs: DataFrame, least: int = LEAST_CHARS, edits: int = EDITS) -> DataFrame:
    """The documents, in their own columns, without the lines that go.

    Null texts stay null, empty ones empty; lines without a letter or digit stay. Rows
    that repeat a doc_id are one document: what stands at the same place in equal rows stays or
    goes in both. Rows without an id come last in the order. ``n_chars``, if the documents have it,
    follows a text that changes.
    """
    lost, ident, parts = (f"{name}_{uuid.uuid4().hex}" for name in ("lost", "id", "parts"))
    mark = F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("h").cast("string"))
    marks = removed(docs, least, edits).groupBy(F.col("doc_id").alias(ident)).agg(F.collect_set(mark).alias(lost))
    joined = docs.join(marks, F.col("doc_id").cast("long").eqNullSafe(F.col(ident)), "left")
    joined = joined.withColumn(parts, once(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")))
    own = F.transform(parts, lambda line, i: F.concat(i.cast("string"), F.lit(":"), F.xxhash64(line).cast("string")))
    # A set of strings is looked up by hash, so a document takes time in proportion to its lines.
    kept = F.transform(F.array_except(own, F.col(lost)), lambda m: F.get(parts, F.substring_index(m, ":", 1).cast("int")))
    text = F.when(F.col(lost).isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(lost).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_segment_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of lines of every document, and which of them go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marks = removed(docs).groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
    return docs.select("doc_id", n_lines.alias("n_lines")).join(marks, "doc_id", "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed"))


OP9_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
u AS (SELECT line, length(line) AS n, min(doc_id * 2147483648::HUGEINT + pos) AS place FROM l
    WHERE regexp_matches(line, '[\\p{L}\\p{N}]') GROUP BY line),
near AS (SELECT DISTINCT x.line FROM u x JOIN u y ON y.n BETWEEN x.n - 2 AND x.n + 2 AND y.place < x.place AND x.line <> y.line
    AND x.n >= 20 AND y.n >= 20 WHERE levenshtein(x.line, y.line) <= 2),
gone AS (SELECT DISTINCT l.doc_id, l.pos FROM l JOIN u USING (line) LEFT JOIN near ON near.line = l.line
    WHERE near.line IS NOT NULL OR l.doc_id * 2147483648::HUGEINT + l.pos > u.place),
m AS (SELECT doc_id, count(*) AS n_removed, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(string_split(coalesce(d.text, ''), chr(10)))::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(removed, '') AS removed FROM documents d LEFT JOIN m USING (doc_id)
"""
