"""Benchmark decontamination: word windows of benchmark items found in training texts."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractwise.llm.arrow import text_bytes
from tractwise.session import settle

WINDOW = 10
BLOCK_BYTES = 32 << 20  # text of benchmark items that is broadcast at a time
BASE = 0x9E3779B97F4A7C15
CHUNK = 4 << 20  # bytes of text scanned at a time

#: What ``scan`` adds to a document: spans are [first, last + 1) of its words.
HITS = "struct<n_words: long, spans: array<struct<s: long, e: long>>, items: array<string>>"
_HITS = pa.struct([("n_words", pa.int64()),
                   ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                   ("items", pa.list_(pa.string()))])


def words(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits and characters beyond ASCII."""
    return re.findall(rb"[0-9a-z\x80-\xff]+", text.lower())


def windows_of(items: list[tuple[str, str | None]], window: int) -> tuple[dict, dict]:
    """Ids of the items' words; and by window length: rows of word ids, their hashes, their items."""
    ids: dict[bytes, int] = {}
    found: dict[int, dict[tuple[int, ...], set[str]]] = {}
    for name, text in items:
        own = [ids.setdefault(w, len(ids) + 1) for w in words((text or "").encode())]
        n = min(window, len(own))
        for i in range(len(own) - n + 1) if n else ():
            found.setdefault(n, {}).setdefault(tuple(own[i:i + n]), set()).add(name)
    by_length = {}
    for n, rows in found.items():
        table = np.array(list(rows), dtype=np.uint64)
        keys = rolled(table.ravel(), n)[::n]
        order = np.argsort(keys, kind="stable")
        names = [sorted(x) for x in rows.values()]
        by_length[n] = (table[order], keys[order], [names[i] for i in order])
    return ids, by_length


def rolled(ids: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every n consecutive ids (modulo 2 ** 64)."""
    out = np.zeros(len(ids) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(BASE) + ids[k:len(ids) - n + 1 + k]
    return out


def scan_texts(texts: list[bytes], windows: tuple[dict, dict]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """(number of words, merged hit spans, items) of every text."""
    each = [words(t) for t in texts]
    # A zero stands behind every document, so that no window with known words runs over its end.
    sizes = np.array([len(w) + 1 for w in each], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.zeros(int(starts[-1]), dtype=np.uint64)
    known, by_length = windows
    get = known.get
    for w, at in zip(each, starts):
        ids[at:at + len(w)] = np.fromiter(map(get, w, repeat(0)), dtype=np.uint64, count=len(w))
    gaps = np.concatenate([[0], np.cumsum(ids == 0)])
    out = [(len(w), [], []) for w in each]
    found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
    for n, (table, keys, names) in by_length.items():
        if len(ids) < n:
            continue
        at = np.flatnonzero(gaps[n:] == gaps[:-n])  # n known words in a row
        if not len(at):
            continue
        own = np.zeros(len(at), dtype=np.uint64)
        for k in range(n):
            own = own * np.uint64(BASE) + ids[at + k]
        low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        at, low, high = at[high > low], low[high > low], high[high > low]
        for shift in range(int((high - low).max()) if len(at) else 0):  # over 0 where hashes collide
            row = low + shift
            same = row < high
            same[same] = (ids[at[same][:, None] + np.arange(n)] == table[row[same]]).all(axis=1)
            doc = np.searchsorted(starts, at[same], "right") - 1
            for d, a, r in zip(doc.tolist(), at[same].tolist(), row[same].tolist()):
                spans, items = found.setdefault(d, ([], set()))
                spans.append((a - int(starts[d]), a - int(starts[d]) + n))
                items.update(names[r])
    for d, (spans, items) in found.items():
        out[d] = (out[d][0], merged(spans), sorted(items))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str | None]]]:
    """Items in blocks of about that much text; a benchmark of any size is covered block by block."""
    plain = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    plain = plain.filter(F.col("item_id").isNotNull())
    total = plain.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for i in range(n):
        own = plain.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield [(r["item_id"], r["text"]) for r in own.collect()]


def scan(docs: DataFrame, benchmark: DataFrame, name: str = "hits", window: int = WINDOW,
         keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add column ``name`` (see ``HITS``) to the columns ``keep`` (all, if none are given).

    A window is ``window`` consecutive words of an item, or all of an item that has fewer, but not
    none. Windows are looked up by a hash of their word ids and compared word by word. Null or
    empty texts have no words; items without an id or without words match nothing; items that occur
    twice count once; documents that occur twice are both judged. Empty tables give no hits.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    if name in keep:
        raise ValueError(f"the documents have a column {name} of their own; give another name")
    state, first = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])]), True
    kinds = {f.name: f.dataType.simpleString() for f in state.schema.fields}
    pending: DataFrame | None = None
    for items in blocks(benchmark, block_bytes):
        if pending is not None:
            state, first = settle(pending), False
        shared = spark.sparkContext.broadcast(windows_of(items, window))
        pending = _pass(state, shared, name, first, kinds)
    return pending.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{name}`"))


def _pass(state: DataFrame, shared, name: str, first: bool, kinds: dict[str, str]) -> DataFrame:
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + f", `{name}` {HITS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            texts = text_bytes(batch.column(batch.schema.get_field_index("text")))
            hits, at = [], 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end]) <= CHUNK):
                    held += len(texts[end])
                    end += 1
                hits += scan_texts(texts[at:end], windows)
                at = end
            rows = [{"n_words": n, "spans": s, "items": i} for n, s, i in hits]
            if not first:
                for row, old in zip(rows, batch.column(len(kinds)).to_pylist()):
                    row["spans"] = merged(row["spans"] + [(x["s"], x["e"]) for x in old["spans"]])
                    row["items"] = sorted({*row["items"], *old["items"]})
            for row in rows:
                row["spans"] = [{"s": s, "e": e} for s, e in row["spans"]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kinds)], pa.array(rows, _HITS)],
                                             names=[*kinds, name])

    return state.mapInArrow(run, schema)


def remove(docs: DataFrame, benchmark: DataFrame, what: str = "documents", window: int = WINDOW,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents without benchmark text, with the columns of ``docs``.

    ``what="documents"`` drops every document with a hit word; ``what="spans"`` cuts the hit words
    out of the texts, from the first to the last character of each run.
    """
    if what not in ("documents", "spans"):
        raise ValueError("what is documents or spans")
    name = f"hits_{uuid.uuid4().hex}"
    found = scan(docs, benchmark, name, window, block_bytes=block_bytes)
    if what == "documents":
        return found.filter(F.size(F.col(name).spans) == 0).drop(name)
    schema = docs.schema
    place = docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for i, hit in enumerate(batch.column(len(schema)).to_pylist()):
                if hit["spans"]:
                    texts[i] = without(texts[i], [(x["s"], x["e"]) for x in hit["spans"]])
            columns = list(batch.columns[:len(schema)])
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return found.mapInArrow(cut, schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    raw = text.encode()
    at = [m.span() for m in re.finditer(rb"[0-9a-z\x80-\xff]+", raw.lower())]
    out, last = [], 0
    for s, e in spans:
        out.append(raw[last:at[s][0]])
        last = at[e - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    n_hit = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda n, x: n + x.e - x.s)
    return found.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, words, least(10, len(words)) AS n, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i
        FROM b WHERE len(words) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, ns WHERE len(words) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items
       FROM h GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
