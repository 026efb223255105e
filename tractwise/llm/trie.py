"""Prefix trie of conversations, by digests of fixed-length blocks of turns.

Conversations are first grouped by what they share up to the ends of blocks of ``BLOCK`` turns. Only
blocks in which grouped conversations part, or in which one ends, are looked at turn by turn, and then
with one conversation for each distinct block. Every turn has a 120-bit digest of its place, role and text;
the digests of turns, exclusive-ored, are the digest of a block or of a prefix, so prefixes of long
conversations are running sums that need no task for a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tractwise.session import release, settle

BLOCK = 4  # turns
RUN_BITS = 10  # as many neighbouring turns, or blocks, of a conversation are numbered or summed in one window
ID_BITS = 9  # as many neighbouring ids are written as one text before they are hashed


def _digest(value: Column) -> list[Column]:
    """Two positive longs of 60 bits."""
    digest = F.md5(value)
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16)]


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def running_xor(df: DataFrame, keys: list[str], order: str, bucket: Column, names: dict[str, str]) -> DataFrame:
    """For every column the exclusive or over the rows of the key up to this one, under the new name.

    ``bucket`` doesn't decrease in ``order``; only rows of one bucket meet in a window.
    """
    marked = df.withColumn("_b", bucket)
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = marked.groupBy(*keys, "_b").agg(*[F.bit_xor(c).alias(f"_t_{c}") for c in names])
    starts = totals.select(*keys, "_b", *[F.coalesce(F.bit_xor(f"_t_{c}").over(before), F.lit(0).cast("long")).alias(f"_o_{c}") for c in names])
    own = marked.select("*", *[F.bit_xor(c).over(inside).alias(f"_i_{c}") for c in names])
    return own.join(starts, [*keys, "_b"]).select(
        *df.columns, *[F.col(f"_i_{c}").bitwiseXOR(F.col(f"_o_{c}")).alias(new) for c, new in names.items()])


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), hash and bytes of every turn, in the order of turn.

    Null turns come first; turns of one number go by role, by the first 64 characters of the text and by
    the hash of both, rows that repeat count as often as they occur. Null roles and texts are empty;
    rows without conv_id don't count. The texts themselves go no further.
    """
    turn = F.col("turn").cast("long")
    plain = conversations.filter(F.col("conv_id").cast("long").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), _text("role").alias("role"), _text("text").alias("text"))
    hashed = plain.select("conv_id", "turn", F.col("role").alias("_role"), F.substring("text", 1, 64).alias("_head"),
                          F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))).alias("hash"),
                          F.octet_length("text").cast("long").alias("bytes"))
    marked = hashed.withColumn("_b", F.coalesce(F.shiftright("turn", RUN_BITS), F.lit(-(1 << 62))))
    order = Window.partitionBy("conv_id", "_b").orderBy(F.asc_nulls_first("turn"), "_role", "_head", "hash")
    before = Window.partitionBy("conv_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy("conv_id", "_b").agg(F.count("*").alias("_n")).select(
        "conv_id", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    own = marked.withColumn("_i", F.row_number().over(order))
    return own.join(starts, ["conv_id", "_b"]).select(
        "conv_id", (F.col("_o") + F.col("_i") - 1).cast("long").alias("pos"), "hash", "bytes")


def trie(turns: DataFrame, conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of all conversations.

    ``turns`` has conv_id, pos (0, 1, 2 ... within a conversation), hash and bytes; ``conversations``
    the conv_id of each, those without turns included. No conversations: no nodes. Columns as in
    ``op13_conversation_trie``.
    """
    conversations = settle(conversations.select("conv_id").distinct())
    x, y = _digest(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("hash")))
    placed = settle(turns.select("conv_id", "pos", ((F.col("pos") - F.col("pos") % block) / block).cast("long").alias("blk"), "bytes", x.alias("x"), y.alias("y")))

    # What conversations share up to the ends of blocks.
    blocks = placed.groupBy("conv_id", "blk").agg(F.bit_xor("x").alias("dx"), F.bit_xor("y").alias("dy"), F.count("*").alias("n"))
    ended = settle(running_xor(blocks, ["conv_id"], "blk", F.shiftright("blk", RUN_BITS), {"dx": "qx", "dy": "qy"}).select(
        "conv_id", "blk", "n", "qx", "qy", F.col("qx").bitwiseXOR(F.col("dx")).alias("px"), F.col("qy").bitwiseXOR(F.col("dy")).alias("py")))
    classes = settle(ended.groupBy("blk", "px", "py", "qx", "qy", "n").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")))
    forks = classes.groupBy("blk", "px", "py").agg((F.count("*") > 1).alias("fork"))

    # One conversation of each class, turn by turn; only where siblings part do their nodes have to be brought together.
    inside = Window.partitionBy("conv_id", "blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = placed.join(classes.join(forks, ["blk", "px", "py"]).select("conv_id", "blk", "px", "py", "n_convs", "fork"), ["conv_id", "blk"])
    steps = settle(steps.select(
        "conv_id", "n_convs", "fork", "bytes", (F.col("pos") + 1).alias("depth"), "x", "y",
        *[F.bit_xor(c).over(inside).bitwiseXOR(F.col(f"p{c}")).alias(f"s{c}") for c in "xy"]))
    steps = steps.withColumns({"ux": F.col("sx").bitwiseXOR(F.col("x")), "uy": F.col("sy").bitwiseXOR(F.col("y"))}).drop("x", "y")
    kept = ["depth", "sx", "sy", "ux", "uy", "bytes"]
    parted = steps.filter("fork").groupBy(*kept).agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    zero = F.lit(0).cast("long")
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
        zero.alias("depth"), zero.alias("sx"), zero.alias("sy"), F.lit(None).cast("long").alias("ux"), F.lit(None).cast("long").alias("uy"),
        zero.alias("bytes"), "conv_id", "n_convs")
    columns = [*kept, "conv_id", "n_convs"]
    nodes = steps.filter("NOT fork").select(*columns).unionByName(parted.select(*columns)).unionByName(root)
    children = nodes.filter("depth > 0").groupBy(F.col("ux").alias("sx"), F.col("uy").alias("sy")).agg(F.count("*").alias("n_children"))
    nodes = settle(nodes.join(children, ["sx", "sy"], "left").withColumn("n_children", F.coalesce("n_children", zero)))
    sums = _subtree_sums(nodes)

    last = Window.partitionBy("conv_id")  # of the totals of runs below, not of turns
    runs = ended.groupBy("conv_id", F.shiftright("blk", RUN_BITS).alias("_b")).agg(F.max(F.struct("blk", "qx", "qy")).alias("m"))
    ends = runs.withColumn("_top", F.max("_b").over(last)).filter("_b = _top").select("conv_id", F.col("m.qx").alias("sx"), F.col("m.qy").alias("sy"))
    ends = conversations.join(ends, "conv_id", "left").select("conv_id", F.coalesce("sx", zero).alias("sx"), F.coalesce("sy", zero).alias("sy"))
    parents = nodes.select(F.col("sx").alias("ux"), F.col("sy").alias("uy"), F.col("conv_id").alias("parent_conv_id"))
    out = settle(nodes.join(sums, ["sx", "sy"]).join(parents, ["ux", "uy"], "left").join(end_digests(ends), ["sx", "sy"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))
    release(conversations, placed, ended, classes, nodes, sums)
    return out


def _subtree_sums(nodes: DataFrame) -> DataFrame:
    """sx, sy, n_leaves and saved_tokens, summed over every node's subtree, by pointer doubling.

    After round k a node has the sums of the descendants fewer than 2^k steps below it, and knows its
    ancestor 2^k steps above. So a trie of depth d takes log2(d) rounds of joins, whatever its form.
    """
    saved = ((F.col("n_convs") - 1) * F.col("bytes")).cast("long")
    state = nodes.select("sx", "sy", "depth", F.col("ux").alias("ax"), F.col("uy").alias("ay"),
                         (F.col("n_children") == 0).cast("long").alias("n_leaves"), saved.alias("saved_tokens"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    state, step = settle(state), 1
    while step <= deepest:
        below = state.filter(F.col("depth") >= step).groupBy(F.col("ax").alias("sx"), F.col("ay").alias("sy")).agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        above = state.select(F.col("sx").alias("ax"), F.col("sy").alias("ay"), F.col("ax").alias("bx"), F.col("ay").alias("by"))
        wider = state.join(below, ["sx", "sy"], "left").join(above, ["ax", "ay"], "left").select(
            "sx", "sy", "depth", F.col("bx").alias("ax"), F.col("by").alias("ay"),
            (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"))
        new = settle(wider)
        release(state)
        state, step = new, 2 * step
    out = state.select("sx", "sy", "n_leaves", "saved_tokens")
    out._settled_path = state._settled_path
    return out


def end_digests(ends: DataFrame) -> DataFrame:
    """sx, sy and ends_sha256: the SHA-256 of the ids that end at a node, ascending, with commas.

    Ids are written down in runs of neighbouring ones first. A hash has to read its text in order, so
    a node's runs pass through one task, which holds one of them at a time.
    """
    run = F.shiftright("conv_id", ID_BITS).alias("run")
    written = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    runs = ends.groupBy("sx", "sy", run).agg(written)
    ordered = runs.repartition("sx", "sy").sortWithinPartitions("sx", "sy", "run").select("sx", "sy", "ids")

    def hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        names = ["sx", "sy", "ends_sha256"]
        kinds = (pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            rows = []
            for x, y, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (x, y) == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node is not None:
                    rows.append((*node, digest.hexdigest()))
                node, digest = (x, y), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*node, digest.hexdigest()), kinds)], names=names)

    return ordered.mapInArrow(hash_runs, "sx long, sy long, ends_sha256 string")


def grafted(turns: DataFrame, modulus: int = 5, turns_modulus: int = 9) -> DataFrame:
    """Turns of the rebuilt conversations: the first h of conversation c - c % modulus, then its own without its first h.

    h is the CRC-32 of the id, modulo ``turns_modulus``.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(turns_modulus))
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("size"))
    convs = sizes.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % modulus).alias("base"))
    placed = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size")), "base", "left").withColumn(
        "taken", F.least("h", F.coalesce("base_size", F.lit(0))))
    own = turns.join(placed.select("conv_id", "h", "taken"), "conv_id").filter("pos >= h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "hash", "bytes")
    heads = turns.filter(F.col("pos") < turns_modulus).withColumnRenamed("conv_id", "base")
    taken = heads.join(placed.filter("taken > 0").select("conv_id", "base", "taken"), "base").filter("pos < taken").select("conv_id", "pos", "hash", "bytes")
    return own.unionByName(taken)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first turns of another one."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = settle(turns_of(conversations))
    return trie(grafted(turns), turns.select("conv_id"))


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), left(coalesce(text, ''), 64),
    md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, c - c % 5 AS base FROM t),
h AS (SELECT c, base, (xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda v, b: list_reduce(list_prepend(xor(v, b), [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda q, i: xor(q >> 1, 3988292384 * (q & 1)))))) % 9 AS h FROM ids),
size AS (SELECT c, count(*) AS n FROM t GROUP BY c),
r AS (
  SELECT h.c, t.pos, t.role, t.text FROM h JOIN t ON t.c = h.base AND t.pos < h.h
  UNION ALL
  SELECT h.c, t.pos - h.h + least(h.h, coalesce(size.n, 0)), t.role, t.text FROM h JOIN t ON t.c = h.c AND t.pos >= h.h LEFT JOIN size ON size.c = h.base),
m AS (SELECT c, pos + 1 AS depth, text,
    string_agg(sha256(length(role)::VARCHAR || ':' || role || text), ',') OVER (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING) AS path FROM r),
mem AS (SELECT c, 0::BIGINT AS depth, '' AS text, '' AS path FROM ids UNION ALL SELECT c, depth, text, path FROM m),
node AS (SELECT depth, path, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(strlen(text)) AS saved FROM mem GROUP BY depth, path),
child AS (SELECT n.depth, n.path, n.conv_id, n.n_convs, n.saved, CASE n.depth WHEN 0 THEN NULL WHEN 1 THEN '' ELSE left(n.path, -65) END AS up FROM node n),
kids AS (SELECT up, depth - 1 AS depth, count(*) AS k FROM child WHERE depth > 0 GROUP BY up, depth),
full_ AS (SELECT child.*, coalesce(k, 0) AS k FROM child LEFT JOIN kids ON kids.up = child.path AND kids.depth = child.depth),
sub AS (SELECT a.depth, a.path, count(*) FILTER (WHERE b.k = 0) AS n_leaves, sum(b.saved) AS saved FROM full_ a JOIN full_ b
  ON b.depth >= a.depth AND left(b.path, length(a.path)) = a.path GROUP BY a.depth, a.path),
last AS (SELECT c, max(depth) AS depth, max_by(path, depth) AS path FROM mem GROUP BY c),
ends AS (SELECT depth, path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM last GROUP BY depth, path)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.k::BIGINT AS n_children,
  sub.n_leaves::BIGINT AS n_leaves, sub.saved::BIGINT AS saved_tokens, coalesce(ends.ends, sha256('')) AS ends_sha256
FROM full_ f JOIN sub ON sub.depth = f.depth AND sub.path = f.path LEFT JOIN full_ p ON p.depth = f.depth - 1 AND p.path = f.up
LEFT JOIN ends ON ends.depth = f.depth AND ends.path = f.path
"""
