"""Every stage of the corpus pipeline against a brute-force version of it, on the smallest tables."""

import re
import zlib

import duckdb
import numpy as np

import corpus_pipeline
from tractwise.llm import tokens
from tractwise.llm.lines import OP9_SQL
from tractwise.session import settle

SF = "/root/testdata/sf0.001"


def similar_groups(texts):
    def grams(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}

    sets = {d: grams(t) for d, t in sorted(texts.items())}
    label = {d: d for d in sets}
    ids = list(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if sets[a] and
             100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return {d for d in ids if label[d] == d}


def test_stages(spark):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [first]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(settle(stage(spark, frames[-1], SF)))
    assert all(f.columns == first.columns for f in frames[:-1])
    texts = [{r.doc_id: r.text for r in f.collect()} for f in frames[:-1]]

    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    learned = {d: q for d, q in labels.items() if zlib.crc32(str(d).encode()) % 5}
    right = [(d in texts[1]) == bool(q) for d, q in learned.items() if d in texts[0]]
    assert np.mean(right) >= 0.95 and all(texts[1][d] == texts[0][d] for d in texts[1])

    documents = frames[1].select("doc_id", "text").toPandas()
    con = duckdb.connect()
    con.register("documents", documents)
    gone = {d: set(filter(None, g.split(","))) for d, _, _, g in con.execute(OP9_SQL).fetchall()}
    assert texts[2] == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if str(i) not in gone[d]) for d, t in texts[1].items()}

    assert set(texts[3]) == similar_groups(texts[2]) and all(texts[3][d] == texts[2][d] for d in texts[3])

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))

    windows = set()
    for (text,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall():
        own = words(text)
        n = min(10, len(own))
        windows |= {tuple(own[i:i + n]) for i in range(len(own) - n + 1) if n}
    sizes = {len(w) for w in windows}

    def clean(text):
        own = words(text)
        return not any(tuple(own[i:i + n]) in windows for n in sizes for i in range(len(own) - n + 1))

    assert set(texts[4]) == {d for d, t in texts[3].items() if clean(t)}

    packed = frames[5].toPandas().sort_values(["doc_id", "start"])
    encoder = tokens.Encoder(tokens.default_vocabulary())
    ids = {d: tokens.wide(encoder.encode(t) + encoder.pack(0), 2) for d, t in texts[4].items()}
    assert packed.length.sum() == sum(map(len, ids.values()))
    for r in packed.itertuples():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes())
    own = packed.sort_values(["sequence_id", "offset"])
    assert (own.groupby("sequence_id").length.cumsum() - own.length == own.offset).all()
    assert own.groupby("sequence_id").length.sum().max() <= 1024
