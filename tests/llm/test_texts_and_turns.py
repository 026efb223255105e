"""Circulant MinHash, collocations, the conversation trie and line dedup against brute force, on odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tractwise.llm import collocations, lines, minhash, ngram_join, trie

SCHEMA = "doc_id long, text string, lang string, start long, kept boolean, phrase string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def groups(rows, size, num, den):
    """doc_id -> (sizes of its sets, smallest id reachable)."""
    sets = []
    for d, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets.append((d, {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()}))
    label = {d: d for d, _ in sets if d is not None}
    pairs = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1:]
             if a is not None and b is not None and x and y and den * len(x & y) >= num * len(x | y)]
    for _ in range(len(label)):
        old = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if old == label:
            break
    return sorted(((d, len(s), label.get(d)) for d, s in sets), key=str)


def texts():
    rng = np.random.default_rng(11)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 900, 60)) for _ in range(4)]
    out = [None, "", " \n", "one", "ONE", "two words", *base, base[0].upper(), base[1] + " more", "x " * 9000 + base[2], "é" * 3000]
    for _ in range(40):  # a family around the limit
        words = base[3].split()
        for at in rng.integers(0, 60, 4):
            words[at] = f"n{rng.integers(0, 99)}"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 1, True, "clash") for i, t in enumerate(texts())]
    rows += [(None, "without an id", None, None, None, None), (7, rows[8][1], "de", 0, None, None), rows[9]]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("link, size, num", [(minhash.near_duplicates, 2, 80), (ngram_join.link, 4, 85)])
def test_near_duplicates_equal_brute_force(docs, none, link, size, num):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = link(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == groups(rows, size, num, 100)
    if link is minhash.near_duplicates:
        assert all(r.kept == (r.doc_id == r.component_id) for r in found)
        assert minhash.first_of_each(docs).columns == docs.columns and minhash.first_of_each(none).count() == 0
    assert link(none).count() == 0


def test_a_bucket_of_many_sets_that_stay_apart(spark):
    rng = np.random.default_rng(2)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for d in range(1100):  # more than a block; each has its own words at some places
        words = list(base)
        for at in rng.choice(80, 3 + d % 4, replace=False):
            words[at] = f"d{d}x{at}"
        rows.append((d, " ".join(words)))
    found = ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == groups(rows, 4, 85, 100)


def test_long_words_that_powers_of_one_number_confuse():
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    one, two = ("".join("ab"[b ^ flip] for b in bits).encode() for flip in (0, 1))
    first, second = ngram_join.shingle_sets([one, two], 4)
    assert first[0] != second[0]


def test_signatures_do_not_depend_on_how_sets_are_cut(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 50, 3000, 0, 7)]
    whole = minhash.signatures(sets, 20)
    monkeypatch.setattr(minhash, "SIDE", 64)
    assert (minhash.signatures(sets, 20) == whole).all() and (whole[:, 3] == 0xFFFFFFFF).all()
    both = [np.arange(0, 100, dtype=np.uint64), np.arange(20, 120, dtype=np.uint64)]
    agree = (np.subtract(*minhash.signatures(both, 4000).astype(np.int64).T) == 0).mean()
    assert abs(agree - 80 / 120) < 0.04


def phrases(rows, least, share, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = []
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            longer = max([c for q, c in counts.items() if len(p) == 2 and len(q) == 3 and c >= least and p in (q[:2], q[1:])], default=0)
            if share[1] * longer >= share[0] * a and longer:
                continue
            score, _, l, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((score, a, " ".join(p), l, r))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, l, r, n[lang], score) for i, (score, a, p, l, r) in enumerate(found[:top], start=1)]
    return sorted(out)


def test_collocations_equal_brute_force(spark, none):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["a", "B", "c.", "d\x00", "é,", "\t", "e\x1c", "F\n", "the", "of", "x" * 500], 60)), ["en", "de", None][i % 3]) for i in range(60)]
    rows += [(90, None, "en"), (91, "", None), (92, ". . .", "fr"), (93, "the of " * 30000, "en"), (93, "the of", "en"), (None, "q r s " * 20, "und")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    for top in (7, 2000):
        found = collocations.collocations(frame, 5, (50, 100), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
        assert sorted(map(tuple, found)) == phrases([(r[2], r[1]) for r in rows], 5, (50, 100), top)
    assert collocations.collocations(none).count() == 0


def test_scores_pass_64_bits(spark):
    a, l, r = 3_000_000_007, 3_000_000_011, 3_000_000_019
    frame = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    assert frame.select(collocations.score(frame.a, frame.l, frame.r)).first()[0] == 10**6 * a * a // (l * r)


def test_a_text_cut_in_slices_keeps_its_triples(monkeypatch):
    text = b"a b c. d e " * 50 + b"\n" + b"f" * 300
    monkeypatch.setattr(collocations, "CHUNK", 40)
    parts = list(collocations._slices(text))
    assert b"".join(parts) == text + b"\n" and len(parts) > 5
    cut, whole = collocations.TripleCounts(), collocations.TripleCounts()
    for part in parts:
        cut.add(part)
        cut.count()
    whole.add(text)
    for counts in (cut, whole):
        counts.add(b"\n\n")
        counts.count()
    rows = [[tuple(x) for b in c.rows("en") for x in zip(*(col.to_pylist() for col in b.columns))] for c in (cut, whole)]
    assert rows[0] == rows[1] == sorted(rows[1])


def nodes_of(conversations):
    members, text = defaultdict(list), {(): ""}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                text[tuple(turns[:d])] = turns[d - 1][1]
    kids = Counter(p[:-1] for p in members if p)
    out = []
    for p, own in members.items():
        under = [q for q in members if q[:len(p)] == p]
        ends = ",".join(str(c) for c in sorted(own) if len(conversations[c]) == len(p))
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), kids[p], sum(not kids[q] for q in under),
                    sum((len(members[q]) - 1) * len(text[q].encode()) for q in under), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    rng = np.random.default_rng(6)
    rows = []
    for c in [*range(-7, 60), 100, 105, 10**12]:
        for t in range(int(rng.integers(0, 12))):
            rows.append((c, t, ["user", "bot"][t % 2], ["hi", "é" * 9, "a long text " * 9][int(rng.integers(0, 3)) if t > 2 else 0], "clash"))
    rows += [(61, t, "user", "same", None) for t in range(70)] + [(62, t, "user", "same", None) for t in range(2000, 2069)]
    rows += [(63, None, None, None, None), (63, 0, "user", "", None), (63, 0, "user", "", None), (63, 0, "bot", "b", None), (None, 0, "user", "nobody", None)]
    return rows


@pytest.mark.parametrize("block", [1, 4])
def test_trie_equals_brute_force(spark, block):
    rows = conversations()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string").repartition(3)

    def order(r):
        role, text = r[2] or "", r[3] or ""
        return (r[1] is not None, r[1] or 0, role, text[:64], hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest())

    plain = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        plain[r[0]].append((r[2] or "", r[3] or ""))
    turns = trie.turns_of(frame)
    found = trie.trie(turns, turns.select("conv_id"), block).collect()
    assert sorted(map(tuple, found), key=str) == nodes_of(plain)
    rebuilt = {}
    for c in plain:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = plain.get(int(c - np.fmod(c, 5)), [])[:h] + plain[c][h:]
    found = trie.trie(trie.grafted(turns), turns.select("conv_id"), block).collect()
    assert sorted(map(tuple, found), key=str) == nodes_of(rebuilt)
    empty = trie.turns_of(frame.limit(0))
    assert trie.trie(empty, empty.select("conv_id"), block).count() == 0


def test_short_lines_go_as_copies_and_signs_stay(spark):
    many = "\n".join(f"line {i}" for i in range(30000))
    rows = [(1, "yes\n}\n\n--"), (2, "yes\nno\n}\n\n--"), (3, "yez\nno"), (4, many), (5, many + "\nlast")]
    kept = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1: rows[0][1], 2: "no\n}\n\n--", 3: "yez", 4: many, 5: "last"}
