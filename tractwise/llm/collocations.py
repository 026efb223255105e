"""Phrase collocations: sorted count streams, merged in prefix order and in suffix order.

Every word of a piece starts one padded word triple. The triples are counted once and sorted; the counts
of all shorter phrases are sums over neighbouring rows of that one stream. What a phrase needs to
know about its parts and its extensions it meets by merging sorted streams: in prefix order with
its first words and its right extensions, in suffix order with its last words and its left extensions.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tractwise.session import settle

LEAST = 10  # occurrences of a candidate
SHARE = (50, 100)  # of a candidate's occurrences inside a longer one, from which it goes
TOP = 2000
MILLION = 1_000_000
CHUNK = 4 << 20  # bytes of text counted at a time
HELD = 4 << 20  # triples a task gathers before it counts and sends them
WORD_BITS = 21  # of a word's number; a chunk has fewer than 2^20 words, and no more chunks follow once there are as many
SALTS = 64
#: Lower case, tabs to spaces, and what ends a piece to a line feed.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)


class TripleCounts:
    """Counts of the word triples of a stream of texts in one language.

    Word 0 is the empty word behind a piece's end, word 1 that end itself. The last two words of a
    chunk go before the next chunk's, so that no triple is lost where a text is cut.
    """

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.size = 0
        self.carry: list[bytes] = []
        self.reset()

    def reset(self) -> None:
        self.words: defaultdict[bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.words[b""], self.words[b"\n"]
        self.keys: list[np.ndarray] = []
        self.held = 0

    def add(self, part: bytes) -> None:
        self.parts.append(part)
        self.size += len(part)

    def count(self) -> None:
        """Turn the gathered parts into triples of word numbers."""
        data = b"".join(self.parts).translate(PLAIN).replace(b"\n", b" \n ").split(b" ")
        self.parts, self.size = [], 0
        found = [*self.carry, *filter(None, data)]
        del data
        self.carry = found[-2:]
        ids = np.fromiter(map(self.words.__getitem__, found), np.int64, len(found))
        a, b, c = ids[:-2], ids[1:-1], ids[2:]
        b = np.where(b == 1, 0, b)
        c = np.where((b == 0) | (c == 1), 0, c)
        self.keys.append(((a << 2 * WORD_BITS) | (b << WORD_BITS) | c)[a != 1])
        self.held += len(self.keys[-1])

    def rows(self, lang: str) -> Iterator[pa.RecordBatch]:
        """The triples in the order of their words, with their counts; then start anew."""
        words = pa.array(list(self.words), pa.binary()).cast(pa.string())
        order = pc.sort_indices(words).to_numpy().astype(np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        words = words.take(pa.array(order))
        low = (1 << WORD_BITS) - 1
        keys = np.concatenate([np.zeros(0, np.int64), *self.keys])
        self.reset()
        keys = (rank[keys >> 2 * WORD_BITS] << 2 * WORD_BITS) | (rank[(keys >> WORD_BITS) & low] << WORD_BITS) | rank[keys & low]
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        counts = np.diff(first, append=len(keys))
        keys = keys[first]
        for at in range(0, len(keys), 1 << 16):
            own = keys[at:at + (1 << 16)]
            parts = (own >> 2 * WORD_BITS, (own >> WORD_BITS) & low, own & low)
            gram = pc.binary_join_element_wise(*(words.take(pa.array(x)) for x in parts), " ")
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(gram), pa.string()), gram, pa.array(counts[at:at + (1 << 16)])], names=["lang", "gram", "c"])


def _slices(text: bytes) -> Iterator[bytes]:
    """A text in slices of about ``CHUNK`` bytes that end at a space, and a line feed behind it."""
    at = 0
    while len(text) - at > CHUNK:
        end = text.find(b" ", at + CHUNK - 1)
        if end < 0:
            break
        yield text[at:end + 1]
        at = end + 1
    yield text[at:]
    yield b"\n"


def triples(docs: DataFrame) -> DataFrame:
    """lang, gram and c: how often every word triple of a piece occurs in a share of the texts.

    A gram has three words with a space between each two; behind the end of a piece they are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, TripleCounts] = {}

        def send() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                counts.count()
                if len(counts.words) > 1 << (WORD_BITS - 1) or sum(x.held for x in held.values()) > HELD:
                    yield from counts.rows(lang)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = held.setdefault(lang, TripleCounts())
                for part in _slices(text):
                    own.add(part)
                    if sum(x.size for x in held.values()) >= CHUNK:
                        yield from send()
        for lang, own in held.items():
            own.add(b"\n\n")
            own.count()
            yield from own.rows(lang)

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(run, "lang string, gram string, c long")


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """words (0 to 3), lang, gram and f of all phrases that occur ``least`` times; 0 words: all of a language.

    The triples are sorted over all partitions, so a common word's or pair's rows are dealt to as many
    tasks as they need. Within a batch of the sorted stream a phrase's rows stand together. A phrase that
    touches neither end of its batch is counted to the end there; what is known of the others are parts, summed up after.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lang, counts = batch.column(0), batch.column(2).to_numpy()
            split = pc.list_flatten(pc.split_pattern(batch.column(1), " "))
            words = [split.take(pa.array(np.arange(i, len(split), 3))) for i in range(3)]
            out = []
            starts = np.ones(batch.num_rows, bool)
            starts[1:] = pc.not_equal(lang[1:], lang[:-1]).to_numpy(zero_copy_only=False)
            for n in range(4):
                if n:
                    starts[1:] |= pc.not_equal(words[n - 1][1:], words[n - 1][:-1]).to_numpy(zero_copy_only=False)
                at = np.flatnonzero(starts)
                sums = np.add.reduceat(counts, at)
                keep = sums >= least
                keep[[0, -1]] = True
                if n:
                    keep &= pc.not_equal(words[n - 1].take(pa.array(at)), "").to_numpy(zero_copy_only=False)
                else:
                    keep[:] = True
                rows = pa.array(at[keep])
                gram = pc.binary_join_element_wise(*(w.take(rows) for w in words[:n]), " ") if n else pa.array([""] * len(rows), pa.string())
                out.append(pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), n, np.int32)), lang.take(rows), gram, pa.array(sums[keep])],
                    names=["words", "lang", "gram", "f"]))
            yield from out

    stream = triples(docs).repartitionByRange("lang", "gram").sortWithinPartitions("lang", "gram")
    sums = stream.mapInArrow(run, "words int, lang string, gram string, f long")
    totals = sums.groupBy("words", "lang", "gram").agg(F.sum("f").alias("f"))
    return totals.filter((F.col("words") == 0) | (F.col("f") >= least))


def score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)), in decimals: a part occurs at least as often as the phrase, so it is no more than a million."""
    a, l, r = (x.cast("decimal(19,0)") for x in (a, l, r))  # noqa: E741
    return F.call_function("div", a * a * F.lit(MILLION).cast("decimal(7,0)"), l * r)


def _word(at: int) -> Column:
    return F.element_at(F.split("gram", " "), at)


def scored(counts: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """lang, phrase, a, l, r, n and score of the candidates that no longer one stands for.

    Pairs and triples are merged with sorted streams twice: in prefix order with the phrases they
    begin with, in suffix order with those they end with. The most frequent extension of a pair
    comes out of the same streams.
    """
    total = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    one = counts.filter("words = 1").select("lang", F.col("gram").alias("w"), F.col("f").alias("fw"))
    pair = counts.filter("words = 2").select("lang", _word(1).alias("x"), _word(2).alias("y"), "gram", F.col("f").alias("a"))
    three = counts.filter("words = 3").select("lang", _word(1).alias("x"), _word(2).alias("y"), _word(3).alias("z"),
                                              "gram", F.col("f").alias("a"))

    def merged(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
        return left.join(right.hint("merge"), ["lang", *on], how)

    def words(name: str, count: str) -> DataFrame:
        return one.select("lang", F.col("w").alias(name), F.col("fw").alias(count))

    right = three.groupBy("lang", "x", "y").agg(F.max("a").alias("right"))
    left = three.groupBy("lang", F.col("y").alias("x"), F.col("z").alias("y")).agg(F.max("a").alias("left"))
    prefix = merged(pair, right, ["x", "y"], "left")
    longer = F.greatest(F.coalesce("left", F.lit(0)), F.coalesce("right", F.lit(0)))
    pairs = merged(prefix, left, ["x", "y"], "left").filter(
        F.lit(share[1]).cast("decimal(5,0)") * longer.cast("decimal(19,0)") < F.lit(share[0]).cast("decimal(5,0)") * F.col("a").cast("decimal(19,0)"))
    pairs = merged(merged(pairs, words("x", "l"), ["x"]), words("y", "r"), ["y"])
    pairs = pairs.select("lang", "gram", "a", "l", "r", score(F.col("a"), F.col("l"), F.col("r")).alias("score"))

    begins = pair.select("lang", "x", "y", F.col("a").alias("l2"))
    ends = pair.select("lang", F.col("x").alias("y"), F.col("y").alias("z"), F.col("a").alias("r1"))
    by_prefix = merged(merged(three, begins, ["x", "y"]), words("x", "l1"), ["x"])
    threes = merged(merged(by_prefix, ends, ["y", "z"]), words("z", "r2"), ["z"])
    cuts = [F.struct(score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"),
                     F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)]
    threes = threes.withColumn("cut", F.least(*cuts)).select("lang", "gram", "a", "cut.l", "cut.r", "cut.score")
    return pairs.unionByName(threes).join(total, "lang").select(
        "lang", F.col("gram").alias("phrase"), "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = LEAST, share: tuple[int, int] = SHARE, top: int = TOP) -> DataFrame:
    """Each language's first phrases of two or three words by score: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has lang and text; other columns are not read. Null texts are empty, a null language is
    ``und``. Rows that repeat count as often as they occur; ties go by a, then by the phrase's bytes.
    Without words there are no rows.
    """
    found = scored(settle(phrase_counts(docs, least)), share)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = found.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    first = first.filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language of all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS gram
  FROM w, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, gram, count(*) AS num FROM g GROUP BY lang, k, gram),
t AS (SELECT lang, sum(num)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, gram, string_split(gram, ' ') AS ws, num AS a FROM f WHERE k > 1 AND num >= 10),
cut AS (
  SELECT c.lang, c.k, c.gram, c.a, x.num AS l, y.num AS r, j AS cut,
    ((1000000::HUGEINT * c.a * c.a) // (x.num::HUGEINT * y.num))::BIGINT AS score
  FROM c, (VALUES (1), (2)) AS cuts(j)
  JOIN f x ON x.lang = c.lang AND x.k = j AND x.gram = array_to_string(c.ws[1:j], ' ')
  JOIN f y ON y.lang = c.lang AND y.k = c.k - j AND y.gram = array_to_string(c.ws[j + 1:c.k], ' ')
  WHERE j < c.k),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, k, gram ORDER BY score, cut) = 1),
inner_ AS (
  SELECT lang, array_to_string(ws[1:2], ' ') AS gram, a FROM c WHERE k = 3
  UNION ALL SELECT lang, array_to_string(ws[2:3], ' ') AS gram, a FROM c WHERE k = 3),
e AS (SELECT lang, gram, max(a) AS longer FROM inner_ GROUP BY lang, gram),
kept AS (SELECT b.* FROM best b LEFT JOIN e ON b.k = 2 AND e.lang = b.lang AND e.gram = b.gram
  WHERE e.longer IS NULL OR 100 * e.longer < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, gram AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score
FROM ranked JOIN t USING (lang) WHERE rank <= 2000
"""
