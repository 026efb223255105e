"""Quality classifier: a sparse ensemble of rules taken from tree paths."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tractwise.llm.arrow import text_bytes
from tractwise.session import settle

THRESHOLD = 0.3
TREES, DEPTH, SEED = 16, 4, 11
LEAST_ROWS = 5  # on either side of a split
LASSO = 0.0005
SAMPLE = 20_000  # labelled rows that the rules and weights are learned from
FOLDS = 5

#: Statistics of a text, all finite.
STATISTICS = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "symbols", "points", "spaces", "lines", "beyond_ascii",
    "entropy", "distinct_words", "distinct_lines", "top_word", "longest_word", "plain_words", "line_words",
    "ended_lines", "short_words",
)
#: Characters that prose seldom has.
SYMBOLS = b"#$%&*@^~|<>{}[]\\/=+_!`"


def statistics(raw: bytes) -> list[float]:
    """The values of ``STATISTICS`` for one text; an empty text has zeros."""
    n = len(raw)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts / n
    seen = share[share > 0]
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    lower, upper = int(counts[97:123].sum()), int(counts[65:91].sum())
    beyond = int(counts[128:].sum())
    distinct = set(words)
    letters = max(1, lower + upper)
    top = 0
    if words:
        some = list(distinct)
        place = {w: i for i, w in enumerate(some)}
        top = int(np.bincount(np.fromiter(map(place.__getitem__, words), np.int64, len(words))).max())
    return [
        math.log1p(n), math.log1p(len(words)), sum(map(len, words)) / n_words, upper / letters,
        float(share[48:58].sum()), float(share[list(SYMBOLS)].sum()), float(share[list(b".,;:?'\"-")].sum()),
        float(share[32] + share[9]), counts[10] / n, beyond / n, float(-(seen * np.log2(seen)).sum()),
        len(distinct) / n_words, len(set(lines)) / n_lines, top / n_words,
        math.log1p(max(map(len, words), default=0)), sum(map(bytes.isalpha, words)) / n_words, len(words) / n_lines,
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / n_lines,
        sum(len(w) <= 3 for w in words) / n_words,
    ]


def with_statistics(docs: DataFrame, name: str, keep: list[str] | None = None) -> DataFrame:
    """Add the array ``name`` of the text's statistics to the columns ``keep`` (all, if none are given)."""
    kept = docs.columns if keep is None else keep
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + f", `{name}` array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in text_bytes(batch.column(batch.schema.get_field_index("text")))]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, pa.list_(pa.float64()))], names=[*kept, name])

    return docs.mapInArrow(run, schema)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0, which is never learned from, without an id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0))


#: A rule is a conjunction: (statistic, low, high) stands for low < value <= high.
Rule = tuple[tuple[int, float, float], ...]


@dataclass
class RuleModel:
    """Weights of rules; the score is the logistic function of their sum."""

    intercept: float = 0.0
    weights: dict[Rule, float] = field(default_factory=dict)

    def score(self, stats: Column) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weights.items():
            total = total + F.when(holds(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def __str__(self) -> str:
        named = [f"{w:+.3f} if " + " and ".join(f"{a:.4g} < {STATISTICS[i]} <= {b:.4g}" for i, a, b in r)
                 for r, w in sorted(self.weights.items(), key=lambda x: -abs(x[1]))]
        return "\n".join([f"{self.intercept:+.3f}", *named])


def holds(rule: Rule, stats: Column) -> Column:
    out = F.lit(True)
    for i, low, high in rule:
        value = stats.getItem(i)
        if low > -math.inf:
            out = out & (value > low)
        if high < math.inf:
            out = out & (value <= high)
    return out


def grow(bins: np.ndarray, edges: list[np.ndarray], label: np.ndarray, rows: np.ndarray, depth: int,
         rng: np.random.Generator, bounds: dict[int, tuple[float, float]], found: set[Rule]) -> None:
    """Split some rows at the best of a few random statistics, again and again; note every node's path."""
    n, good = len(rows), int(label[rows].sum())
    if not depth or n < 2 * LEAST_ROWS or good in (0, n):
        return
    best = (1e-9, 0, 0)
    for i in rng.choice(len(edges), size=max(1, len(edges) // 3), replace=False).tolist():
        own = bins[rows, i]
        all_ = np.bincount(own, minlength=len(edges[i]) + 1).cumsum()[:-1]
        ones = np.bincount(own, weights=label[rows], minlength=len(edges[i]) + 1).cumsum()[:-1]
        fine = (all_ >= LEAST_ROWS) & (n - all_ >= LEAST_ROWS)
        if fine.any():
            left, right = np.maximum(all_, 1), np.maximum(n - all_, 1)
            gain = ones ** 2 / left + (good - ones) ** 2 / right - good ** 2 / n
            at = int(np.argmax(np.where(fine, gain, -1.0)))
            best = max(best, (float(gain[at]), i, at))
    if best[0] <= 1e-9:
        return
    _, i, at = best
    cut, (low, high) = float(edges[i][at]), bounds.get(i, (-math.inf, math.inf))
    below = bins[rows, i] <= at
    for side, limits in ((rows[below], (low, min(high, cut))), (rows[~below], (max(low, cut), high))):
        own = {**bounds, i: limits}
        found.add(tuple((j, *own[j]) for j in sorted(own)))
        grow(bins, edges, label, side, depth - 1, rng, own, found)


def lasso_weights(x: np.ndarray, label: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic regression with an absolute penalty, by accelerated gradient steps."""
    n, k = x.shape
    step = 4.0 / (1.0 + float((x.astype(np.float64) ** 2).sum(axis=1).max()))
    share = min(max(float(label.mean()), 1e-6), 1 - 1e-6)
    weights, intercept = np.zeros(k), math.log(share / (1 - share))
    ahead, ahead0, pace = weights, intercept, 1.0
    for _ in range(rounds):
        off = 1 / (1 + np.exp(-np.clip(x @ ahead.astype(np.float32) + ahead0, -30, 30))) - label
        moved = ahead - step * (off.astype(np.float32) @ x) / n
        moved = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        moved0 = ahead0 - step * float(off.mean())
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead = moved + (pace - 1) / faster * (moved - weights)
        ahead0 = moved0 + (pace - 1) / faster * (moved0 - intercept)
        weights, intercept, pace = moved, moved0, faster
    return intercept, weights


def sampled(rows: DataFrame, total: int, sample: int) -> DataFrame:
    """At most ``sample`` of the ``total`` rows, chosen by a hash of ``doc_id``, so that copies of a text count one by one.

    The filter leaves little more than the sample, and the limit holds however often an id occurs.
    """
    if total <= sample:
        return rows
    place = F.pmod(F.xxhash64("doc_id"), F.lit(total))
    return rows.withColumn("place", place).filter(F.col("place") < sample).orderBy(
        "place", "doc_id", "stats", "label").limit(sample).drop("place")


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, sample: int = SAMPLE) -> RuleModel:
    """Learn from the rows of ``doc_id``, ``stats`` (array) and ``label`` (0 or 1; other rows are ignored).

    Trees over random rows and statistics give the rules, a logistic regression with a lasso penalty
    their weights. Of more than ``sample`` labelled rows, no more than so many, chosen by hash, are
    learned from, on the driver. Without rows the score is 0.5; with labels of one kind it is their share,
    smoothed by one row of each kind.
    """
    rows = settle(labelled.filter(F.col("label").isin(0, 1)).select(
        "doc_id", "stats", F.col("label").cast("double").alias("label")))
    taken = sampled(rows, rows.count(), sample).orderBy("stats", "label").select("stats", "label").collect()
    label = np.array([r["label"] for r in taken])
    if len(set(label.tolist())) < 2:
        return RuleModel(math.log((label.sum() + 1) / ((1 - label).sum() + 1)))
    values = np.array([r["stats"] for r in taken])
    edges = [np.unique(np.quantile(values[:, i], np.linspace(0, 1, 65)[1:-1])) for i in range(values.shape[1])]
    bins = np.stack([np.searchsorted(e, values[:, i], side="left") for i, e in enumerate(edges)], axis=1)
    rng, found = np.random.default_rng(SEED), set()
    for _ in range(trees):
        grow(bins, edges, label, rng.integers(0, len(label), size=len(label)), depth, rng, {}, found)
    if not found:
        return RuleModel(math.log(label.sum() / (1 - label).sum()))
    columns = {}
    for rule in sorted(found, key=lambda r: (len(r), r)):  # of rules that hold for the same rows, the shortest
        on = np.ones(len(label), bool)
        for i, low, high in rule:
            on &= (values[:, i] > low) & (values[:, i] <= high)
        columns.setdefault(np.packbits(on).tobytes(), (rule, on))
    x = np.stack([on for _, on in columns.values()], axis=1).astype(np.float32)
    intercept, weights = lasso_weights(x, label, lasso)
    return RuleModel(float(intercept), {r: float(w) for (r, _), w in zip(columns.values(), weights) if abs(w) > 1e-6})


def fit_tables(stats: DataFrame, labels: DataFrame) -> RuleModel:
    """Learn the quality label from rows of ``doc_id`` and ``stats`` outside the held-out fold."""
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").alias("label")).filter(fold(F.col("doc_id")) != 0)
    return fit(stats.join(known, "doc_id").select("doc_id", "label", "stats"))


def accepted(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, in their own columns, that score the threshold at least."""
    name = f"stats_{uuid.uuid4().hex}"
    return with_statistics(docs, name).filter(model.score(F.col(name)) >= threshold).drop(name)


def op10_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document. Null texts score as empty ones; repeated rows score alike."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stats = settle(with_statistics(docs, "stats", ["doc_id"]))
    model = fit_tables(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = stats.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), model.score(F.col("stats")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
