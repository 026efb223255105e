"""Near duplicates by circulant MinHash: two permutations make all coordinates of a signature.

The first permutation scrambles a set's shingles on a circle of 2^32 places. The second gives every
place a value; turned on by one place for each coordinate, it yields as many minima as the bands ask for.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractwise.llm.ngram_join import KEY_BYTES, PRIME, linked, mix

WORDS = 2
SIMILAR = (80, 100)
#: A link of 0.8 agrees in no band with a probability of (1 - 0.8^7)^80 = 7e-9.
BANDS, ROWS = 80, 7
SIDE = 1 << 15  # shingles scrambled at a time, so that they stay in the processor's cache


def places(grams: np.ndarray) -> np.ndarray:
    """First permutation: where the shingles lie on the circle."""
    return (mix(grams ^ np.uint64(0x6A09E667F3BCC909)) >> np.uint64(32)).astype(np.uint32)


def shifted_values(place: np.ndarray, shift: int, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Second permutation, turned by ``shift`` places: a bijection of 32 bits."""
    np.add(place, np.uint32(shift), out=out)
    for right, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, None)):
        np.right_shift(out, np.uint32(right), out=spare)
        np.bitwise_xor(out, spare, out=out)
        if factor:
            np.multiply(out, np.uint32(factor), out=out)
    return out


def signatures(sets: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """The ``size`` minima of every set, a column each; all ones for an empty set."""
    out = np.full((size, len(sets)), 0xFFFFFFFF, np.uint32)
    rows = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(rows):
        own, held = [rows[at]], len(sets[rows[at]])
        while at + len(own) < len(rows) and held + len(sets[rows[at + len(own)]]) <= SIDE:
            held += len(sets[rows[at + len(own)]])
            own.append(rows[at + len(own)])
        at += len(own)
        flat = places(np.concatenate([sets[i] for i in own]))
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in own])[:-1]])
        for begin in range(0, len(flat), SIDE):  # more than one part only where one set is longer
            part = flat[begin:begin + SIDE]
            value, spare = np.empty_like(part), np.empty_like(part)
            cuts = starts if len(flat) <= SIDE else np.zeros(1, np.int64)
            for k in range(size):
                least = np.minimum.reduceat(shifted_values(part, k, value, spare), cuts)
                out[k, own] = np.minimum(out[k, own], least)
    return out


def band_keys(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> list[np.ndarray]:
    """One key for each band of a set's signature; none for an empty set."""
    minima = signatures(sets, bands * rows).reshape(bands, rows, len(sets)).astype(np.uint64)
    keys = mix(np.arange(1, bands + 1, dtype=np.uint64))[:, None] + np.zeros((1, len(sets)), np.uint64)
    for r in range(rows):
        keys = mix(keys * np.uint64(PRIME) + minima[:, r])
    keys &= np.uint64((1 << 8 * KEY_BYTES) - 1)
    return [keys[:, i] if len(s) else np.zeros(0, np.uint64) for i, s in enumerate(sets)]


def near_duplicates(docs: DataFrame, words: int = WORDS, similar: tuple[int, int] = SIMILAR,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents that agree in a band are candidates; links are confirmed on whole sets. Null and empty
    texts have no shingles and link with nothing; rows without an id have no component and stay;
    rows that repeat an id are one document. Only doc_id and text are read.
    """

    def keys_of(sets: list[np.ndarray]) -> list[np.ndarray]:
        return band_keys(sets, bands, rows)

    found = linked(docs, keys_of, words, similar)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def first_of_each(docs: DataFrame, words: int = 5, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The documents, in their own columns, that are the first of their group of near duplicates."""
    name = f"id_{uuid.uuid4().hex}"
    first = near_duplicates(docs, words, similar).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(first, F.col("doc_id").cast("long") == F.col(name), "left_semi")
    return kept.unionByName(docs.filter(F.col("doc_id").cast("long").isNull()))


def op11_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents, by pairs of words."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 2 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words)), lambda i: array_to_string(words[i:i + 1], ' ')) END) AS grams FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id
    AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (
  WITH RECURSIVE t(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT * FROM t)
SELECT s.doc_id, len(grams)::BIGINT AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM s JOIN r ON s.doc_id = r.a GROUP BY s.doc_id, len(grams)
"""
