"""Exact Ward clustering and silhouettes over any number of points.

No pair of points ever becomes a row. Points are cut into hash blocks; one task compares one block
with another in numpy and returns one row per point. Hash blocks are even whatever the data, so no
task grows with a hot key. Silhouettes need every pair of blocks. Nearest partners of many clusters
are looked for in cells of neighbours instead: the box of a cell tells which clusters it cannot serve.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tractwise.functions.ranks import hash_rank, running_sums
from tractwise.session import release, settle

TILE = 512
EPS = np.finfo(float).eps
# clusters up to which all blocks are compared; rows the driver sees to cut cells; clusters of a leaf; of one group that ask
FEW, SAMPLE, LEAF, ASKING = 16384, 32768, 256, 65536


def _block_size(n: int) -> int:
    """Some sixteen blocks a side, none larger than one task holds with ease."""
    return min(32768, max(1024, -(-n // 16)))


def _block_pairs(points: DataFrame, columns: list[str], n: int, block: int | None,
                 compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
                 schema: str, some: DataFrame | None = None) -> DataFrame:
    """Run ``compare`` on every pair of hash blocks, once: it answers for the points of both.

    With ``some`` of the points the first blocks only hold these, and the pairs are ordered.
    """
    blocks = max(1, -(-n // (block or _block_size(n))))
    home = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    base = points.select(*columns, home.alias("_home"))
    part = base if some is None else some.select(*columns, home.alias("_home"))
    left = part.withColumn("_a", F.col("_home")).withColumn("_b", every)
    right = base.withColumn("_b", F.col("_home")).withColumn("_a", every)
    if some is None:
        left, right = left.filter("_a <= _b"), right.filter("_a <= _b")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return compare(a, b)

    return left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInPandas(run, schema)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column])


def _square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differences are formed directly, so equal points are exactly 0 apart."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        out += gap * gap
    return out


def _distances(a: np.ndarray, b: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Distances by a matrix product; where that loses digits, by differences."""
    x, y = a - middle, b - middle
    left, right = (x * x).sum(1), (y * y).sum(1)
    square = left[:, None] - 2 * (x @ y.T)
    square += right
    # NaN and infinite cells are not above the limit either
    i, j = np.nonzero(~(square > 1e-5 * left[:, None] + 1e-5 * right))
    if len(i) * 16 > square.size:
        square = _square_distances(a, b)
    else:
        square[i, j] = _pair_squares(a[i], b[j])
    return np.sqrt(square, out=square)


def _pair_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Square distances of rows that stand side by side, summed as ``_square_distances`` does."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        gap = a[:, j] - b[:, j]
        out += gap * gap
    return out


def _indicators(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    codes, names = pd.factorize(column)
    return np.eye(len(names))[codes], names


def _same_points(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    """Whether one block was held against itself: hash blocks share no id otherwise."""
    return bool(a["_home"].iloc[0] == b["_home"].iloc[0])


def silhouettes(points: DataFrame, id_col: str, cluster: str, vec: str,
                block: int | None = None) -> DataFrame:
    """Silhouette width per point from Euclidean distances; needs 3 points and 2 clusters."""
    base = points.select(F.col(id_col).alias("id"), F.col(cluster).alias("cluster"),
                         F.col(vec).alias("vec"))
    sizes = base.groupBy("cluster").agg(F.count("*").alias("size"))
    shape = sizes.agg(F.sum("size").alias("n"), F.count("*").alias("k")).first()
    n, k = shape["n"] or 0, shape["k"]
    id_type = base.schema["id"].dataType.simpleString()
    cl_type = base.schema["cluster"].dataType.simpleString()
    empty = f"{id_col} {id_type}, {cluster} {cl_type}, a double, b double, width double"
    if n < 3 or k < 2:
        return points.sparkSession.createDataFrame([], empty)

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "cluster": [], "other": [], "total": []})
        left, right = _matrix(a["vec"]), _matrix(b["vec"])
        (onto_a, names_a), (onto_b, names_b) = _indicators(a["cluster"]), _indicators(b["cluster"])
        sums_a, sums_b = np.zeros((len(a), len(names_b))), np.zeros((len(b), len(names_a)))
        middle = np.nan_to_num(left.mean(0))
        for i in range(0, len(a), TILE):
            rows = slice(i, i + TILE)
            for j in range(0, len(b), TILE):
                cols = slice(j, j + TILE)
                far = _distances(left[rows], right[cols], middle)
                sums_a[rows] += far @ onto_b[cols]
                sums_b[cols] += far.T @ onto_a[rows]
        # a block that meets itself has every ordered pair already
        sides = [(a, names_b, sums_a)] if _same_points(a, b) else [(a, names_b, sums_a), (b, names_a, sums_b)]
        return pd.concat([pd.DataFrame({
            "id": np.repeat(own["id"].to_numpy(), len(names)),
            "cluster": np.repeat(own["cluster"].to_numpy(), len(names)),
            "other": np.tile(np.asarray(names), len(own)), "total": total.ravel()})
            for own, names, total in sides])

    schema = f"id {id_type}, cluster {cl_type}, other {cl_type}, total double"
    partial = _block_pairs(base, ["id", "cluster", "vec"], n, block, compare, schema)
    sums = partial.groupBy("id", "cluster", "other").agg(F.sum("total").alias("total"))
    own = F.col("cluster") == F.col("other")
    means = sums.join(F.broadcast(sizes.withColumnRenamed("cluster", "other")), "other") \
        if k <= 10000 else sums.join(sizes.withColumnRenamed("cluster", "other"), "other")
    summary = means.groupBy("id", "cluster").agg(
        F.max(F.when(own, F.col("size"))).alias("own_size"),
        F.max(F.when(own & (F.col("size") > 1), F.col("total") / (F.col("size") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("size"))).alias("b"))
    width = F.when(F.col("own_size") == 1, 0.0).otherwise(
        (F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return summary.select(F.col("id").alias(id_col), F.col("cluster").alias(cluster), "a", "b",
                          F.coalesce(width, F.lit(0.0)).alias("width"))


def _ward_costs(ca, na, cb, nb) -> np.ndarray:
    """Ward.D2 heights: the distance of two single points, growing with the sizes."""
    return np.sqrt(_square_distances(ca, cb) * (2 * na[:, None] * nb[None, :])
                   / (na[:, None] + nb[None, :]))


def _settle_rows(side: int, own: slice, other: slice, table: np.ndarray, rows: np.ndarray, limit: np.ndarray,
                 best: list, who: list, ids: tuple, vecs: tuple, sizes: tuple) -> None:
    """Costs by differences of the pairs that may hold a row's best partner; the first of the smallest wins."""
    for at in range(0, len(rows), 64):
        some = rows[at:at + 64]
        near = table[some] <= limit[some, None]
        if np.count_nonzero(near) * 16 > near.size:
            near[:] = True
        r, c = np.nonzero(near)
        mine, theirs = some[r] + own.start, c + other.start
        na, nb = sizes[side][mine], sizes[1 - side][theirs]
        cost = np.sqrt(_pair_squares(vecs[side][mine], vecs[1 - side][theirs]) * (2 * na * nb) / (na + nb))
        cost[ids[side][mine] == ids[1 - side][theirs]] = np.inf
        order = np.lexsort((theirs, cost, mine))
        first = order[np.unique(mine[order], return_index=True)[1]]
        better = first[cost[first] < best[side][mine[first]]]
        best[side][mine[better]] = cost[better]
        who[side][mine[better]] = ids[1 - side][theirs[better]]


def _nearest_in_block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Best partner of every cluster of block a inside block b, and the other way round; ties go to the lower id."""
    if a.empty or b.empty:
        return pd.DataFrame({"id": [], "partner": [], "cost": []})
    a, b = a.sort_values("id"), b.sort_values("id")
    ida, idb = a["id"].to_numpy(), b["id"].to_numpy()
    left, right = _matrix(a["vec"]), _matrix(b["vec"])
    na, nb = a["size"].to_numpy(float), b["size"].to_numpy(float)
    best = [np.full(len(ids), np.inf) for ids in (ida, idb)]
    who = [np.full(len(ids), -1, dtype=np.int64) for ids in (ida, idb)]
    middle = np.nan_to_num(left.mean(0))
    x, y = left - middle, right - middle
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    # the product below is no larger than the square distance, whatever was rounded
    slack = 8 * (x.shape[1] + 8) * EPS
    x = np.column_stack([-2 * x, xx * (1 - slack), np.ones(len(x))])
    y = np.column_stack([y, np.ones(len(y)), yy * (1 - slack)])
    single = bool((na == 1).all() and (nb == 1).all())
    for i in range(0, len(a), TILE):
        rows = slice(i, i + TILE)
        for j in range(0, len(b), TILE):
            cols = slice(j, j + TILE)
            least = x[rows] @ y[cols].T
            error = 2 * slack * (xx[rows].max() + yy[cols].max())
            if not single:
                least *= na[rows, None] * (2 * nb[None, cols]) / (na[rows, None] + nb[None, cols])
                error *= 2 * min(na[rows].max(), nb[cols].max())
            if ida[rows][-1] >= idb[cols][0] and idb[cols][-1] >= ida[rows][0]:
                least[ida[rows, None] == idb[None, cols]] = np.inf
            for side, (own, other, table) in enumerate(((rows, cols, least), (cols, rows, least.T))):
                floor = table.min(1)
                limit = np.minimum(best[side][own] ** 2 * (1 + 1e-9), floor + error)
                # nothing is nearer than 0
                open_ = np.flatnonzero((floor <= limit) & (best[side][own] > 0))
                if len(open_):
                    _settle_rows(side, own, other, table, open_, limit, best, who, (ida, idb), (left, right), (na, nb))
    ids, partner, cost = np.concatenate([ida, idb]), np.concatenate(who), np.concatenate(best)
    found = partner >= 0
    return pd.DataFrame({"id": ids[found], "partner": partner[found], "cost": cost[found]})


def _size_class(size: np.ndarray) -> np.ndarray:
    return np.frexp(size)[1] - 1


def _halves(x: np.ndarray) -> tuple[int, float, np.ndarray] | None:
    """Column of the largest spread, where to cut it, and which rows are below; None if all rows are equal there."""
    axis = int(x.var(0).argmax())
    cut = float(np.partition(x[:, axis], (len(x) - 1) // 2)[(len(x) - 1) // 2])
    low = x[:, axis] <= cut
    if low.all():
        cut = float(np.nextafter(cut, -np.inf))
        low = x[:, axis] <= cut
    return (axis, cut, low) if low.any() and not low.all() else None


def _leaves(x: np.ndarray, rows: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows in groups of neighbours, ``most`` at most in each unless all are equal."""
    found = _halves(x[rows]) if len(rows) > most else None
    return [rows] if found is None else _leaves(x, rows[found[2]], most) + _leaves(x, rows[~found[2]], most)


def _box_bounds(x: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray,
                slack: float) -> np.ndarray:
    """Square costs that no cluster of a box, whose sizes start at ``least``, is below, whatever was rounded."""
    square = np.zeros((len(x), len(low)))
    for j in range(x.shape[1]):
        own = x[:, j, None]
        gap = np.maximum(np.maximum(low[:, j] - own, own - high[:, j]), 0)
        square += gap * gap
    far = np.maximum(np.sqrt(square, out=square) - slack, 0)
    far *= far
    far *= size[:, None] * (2 * least) / (size[:, None] + least)
    return far


def _reach(best: np.ndarray) -> np.ndarray:
    """Square costs up to which a bound leaves a cluster in question."""
    return best * best * (1 + 1e-9)


@dataclass
class _Cells:
    """Neighbouring clusters of like sizes. The cuts are those of a sample and only balance the work; boxes are exact."""

    middle: np.ndarray
    axes: np.ndarray
    trees: dict
    number: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    least: np.ndarray | None = None

    def turn(self, vec: np.ndarray) -> np.ndarray:
        return (vec - self.middle) @ self.axes

    def slack(self, *turned: np.ndarray) -> float:
        """More than distances can lose by turning the vectors."""
        return 64 * (len(self.middle) + 8) * EPS * sum(float(np.sqrt((t * t).sum(1).max())) for t in turned)

    def place(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Cell of every row. A class of sizes that the sample has not is one cell."""
        out, classes = np.empty(len(x), dtype=np.int64), _size_class(size)
        for kind in np.unique(classes):
            todo = [(self.trees.get(int(kind), -1 - int(kind)), np.flatnonzero(classes == kind))]
            while todo:
                tree, rows = todo.pop()
                if isinstance(tree, int):
                    out[rows] = tree
                elif len(rows):
                    axis, cut, below, above = tree
                    low = x[rows, axis] <= cut
                    todo += [(below, rows[low]), (above, rows[~low])]
        return out


def _cut_cells(state: DataFrame, n: int, cell: int) -> _Cells:
    """Cells of about ``cell`` clusters."""
    seen = state.filter(F.pmod(F.xxhash64("id", F.lit("cells")), F.lit(max(1, n // SAMPLE))) == 0).select("vec", "size").toPandas()
    if seen.empty:
        seen = state.select("vec", "size").limit(1).toPandas()
    vec, classes = np.nan_to_num(_matrix(seen["vec"])), _size_class(seen["size"].to_numpy(float))
    middle = vec.mean(0)
    cells = _Cells(middle, np.linalg.eigh((vec - middle).T @ (vec - middle))[1], {})
    x, most, numbers = cells.turn(vec), max(2, cell * len(vec) // n), iter(range(2 * len(vec)))

    def grow(rows: np.ndarray):
        found = _halves(x[rows]) if len(rows) > most else None
        if found is None:
            return next(numbers)
        axis, cut, low = found
        return axis, cut, grow(rows[low]), grow(rows[~low])

    cells.trees = {int(kind): grow(np.flatnonzero(classes == kind)) for kind in np.unique(classes)}
    return cells


def _placed(state: DataFrame, n: int, cell: int) -> tuple[DataFrame, _Cells]:
    """``state`` with the ``number`` of every cluster's cell, settled, and the boxes of the cells."""
    cells = _cut_cells(state, n, cell)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(number=cells.place(cells.turn(_matrix(batch["vec"])), batch["size"].to_numpy(float)))

    def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, tuple] = {}
        for batch in batches:
            if batch.empty:
                continue
            x, size = cells.turn(_matrix(batch["vec"])), batch["size"].to_numpy(float)
            for number, rows in batch.reset_index(drop=True).groupby("number").indices.items():
                one = (len(rows), size[rows].min(), x[rows].min(0), x[rows].max(0))
                old = found.get(number, one)
                found[number] = one if old is one else (
                    old[0] + one[0], min(old[1], one[1]), np.minimum(old[2], one[2]), np.maximum(old[3], one[3]))
        if found:
            yield pd.DataFrame([(k, *v) for k, v in found.items()], columns=["number", "n", "least", "low", "high"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema)
    placed = settle(state.mapInPandas(place, f"{schema}, number bigint"))
    parts = placed.select("vec", "size", "number").mapInPandas(
        boxes, "number bigint, n bigint, least double, low array<double>, high array<double>").toPandas()
    rows = [(number, int(some["n"].sum()), some["least"].min(), _matrix(some["low"]).min(0), _matrix(some["high"]).max(0))
            for number, some in parts.groupby("number")]
    shares, free = F.col("number"), max(number for number, *_ in rows) + 1
    for number, count, *box in list(rows):
        if count > 2 * cell:
            # a hash deals out what has no cut or was seldom seen: the first share keeps the number
            more = -(-count // cell) - 1
            share = F.pmod(F.xxhash64("id"), F.lit(more + 1))
            shares = F.when(F.col("number") == number, F.when(share == 0, number).otherwise(share - 1 + free)).otherwise(shares)
            rows += [(free + i, 0, *box) for i in range(more)]
            free += more
    cells.number, cells.least = np.array([r[0] for r in rows]), np.array([r[2] for r in rows], dtype=float)
    cells.low, cells.high = np.stack([r[3] for r in rows]), np.stack([r[4] for r in rows])
    return placed.withColumn("number", shares.cast("bigint")), cells


def _look_in_cell(ask: pd.DataFrame, cell: pd.DataFrame, cells: _Cells, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Best cost and partner that the clusters of ``ask`` have after looking through a cell; ties go to the lower id.

    ``ask`` says what they had before. The cell is cut into leaves; each cluster sees the nearest
    first, and then those whose box may hold a partner as good as its own. ``own``: both may be the same cluster.
    """
    best, who = ask["cost"].to_numpy(float).copy(), ask["partner"].to_numpy(np.int64).copy()
    ida, idb = ask["id"].to_numpy(np.int64), cell["id"].to_numpy(np.int64)
    left, right = _matrix(ask["vec"]), _matrix(cell["vec"])
    na, nb = ask["size"].to_numpy(float), cell["size"].to_numpy(float)
    turned, other = cells.turn(left), cells.turn(right)
    classes = _size_class(nb)
    leaves = [leaf for kind in np.unique(classes) for leaf in _leaves(other, np.flatnonzero(classes == kind), LEAF)]
    low, high = np.stack([other[leaf].min(0) for leaf in leaves]), np.stack([other[leaf].max(0) for leaf in leaves])
    bounds = _box_bounds(turned, na, low, high, np.array([nb[leaf].min() for leaf in leaves]), cells.slack(turned, other))
    x, y = left - cells.middle, right - cells.middle
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    # the product below is no larger than the square distance, whatever was rounded
    slack = 8 * (x.shape[1] + 8) * EPS
    x = np.column_stack([-2 * x, xx * (1 - slack), np.ones(len(x))])
    y = np.column_stack([y, np.ones(len(y)), yy * (1 - slack)])

    def look(rows: np.ndarray, leaf: np.ndarray) -> None:
        least = x[rows] @ y[leaf].T
        error = 2 * slack * (xx[rows].max() + yy[leaf].max())
        if na[rows].max() > 1 or nb[leaf].max() > 1:
            least *= na[rows, None] * (2 * nb[leaf]) / (na[rows, None] + nb[leaf])
            error *= 2 * min(na[rows].max(), nb[leaf].max())
        if own:
            least[ida[rows, None] == idb[leaf]] = np.inf
        limit = np.minimum(_reach(best[rows]), least.min(1) + error)
        r, c = np.nonzero(least <= limit[:, None])
        for at in range(0, len(r), 1 << 16):
            a, b = rows[r[at:at + (1 << 16)]], leaf[c[at:at + (1 << 16)]]
            cost = np.sqrt(_pair_squares(left[a], right[b]) * (2 * na[a] * nb[b]) / (na[a] + nb[b]))
            cost[ida[a] == idb[b]] = np.inf
            order = np.lexsort((idb[b], cost, a))
            first = order[np.unique(a[order], return_index=True)[1]]
            mine, found, partner = a[first], cost[first], idb[b[first]]
            better = (found < best[mine]) | ((found == best[mine]) & (partner < who[mine]))
            best[mine[better]], who[mine[better]] = found[better], partner[better]

    nearest = bounds.argmin(1)
    for near in (True, False):
        for k, leaf in enumerate(leaves):
            rows = np.flatnonzero((nearest == k) if near else (nearest != k) & (bounds[:, k] <= _reach(best)))
            for at in range(0, len(rows), 2 * TILE):
                look(rows[at:at + 2 * TILE], leaf)
    return best, who


def _nearest_by_cells(state: DataFrame, n: int, cell: int | None, some: DataFrame | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """Candidates (id, partner, cost) that hold the best partner of every cluster, or of ``some`` of them; and what to release.

    Each looks through its own cell first, and then through all cells whose box may hold a partner
    as good as the one found there. Tasks hold one cell and a bounded share of those that ask.
    """
    asks = F.lit(True) if some is None else F.coalesce("asks", F.lit(False))
    marked = state if some is None else state.join(some.select("id", F.lit(True).alias("asks")), "id", "left")
    placed, cells = _placed(marked.select("id", "vec", "size", asks.alias("asks")), n,
                            cell or min(4096, max(1024, n // 32)))

    def first(group: pd.DataFrame) -> pd.DataFrame:
        ask = group[group["asks"]].assign(cost=np.inf, partner=-1)
        if ask.empty:
            return ask.assign(targets=None)[["id", "vec", "size", "cost", "partner", "targets"]]
        best, who = _look_in_cell(ask, group, cells, True)
        turned, others = cells.turn(_matrix(ask["vec"])), cells.number != group["number"].iloc[0]
        slack = cells.slack(turned, cells.low, cells.high)
        targets = []
        for at in range(0, len(ask), TILE):
            rows = slice(at, at + TILE)
            bounds = _box_bounds(turned[rows], ask["size"].to_numpy(float)[rows], cells.low, cells.high, cells.least, slack)
            targets += [cells.number[row] for row in (bounds <= _reach(best[rows])[:, None]) & others]
        return pd.DataFrame({"id": ask["id"].to_numpy(), "vec": ask["vec"].to_numpy(), "size": ask["size"].to_numpy(),
                             "cost": best, "partner": who, "targets": targets})

    def later(ask: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        if ask.empty or group.empty:
            return pd.DataFrame({"id": [], "partner": [], "cost": []})
        best, who = _look_in_cell(ask, group, cells, False)
        new = who != ask["partner"].to_numpy()
        return pd.DataFrame({"id": ask["id"].to_numpy()[new], "partner": who[new], "cost": best[new]})

    asked = settle(placed.groupBy("number").applyInPandas(
        first, "id bigint, vec array<double>, size bigint, cost double, partner bigint, targets array<bigint>"))
    chunks = -(-(n if some is None else some.count()) // ASKING)
    left = asked.select("id", "vec", "size", "cost", "partner", F.explode("targets").alias("number")).withColumn(
        "_chunk", F.pmod(F.xxhash64("id"), F.lit(max(1, chunks))).cast("int"))
    right = placed.select("id", "vec", "size", "number", F.explode(F.sequence(F.lit(0), F.lit(max(1, chunks) - 1))).alias("_chunk"))
    schema = "id bigint, partner bigint, cost double"
    found = left.groupBy("number", "_chunk").cogroup(right.groupBy("number", "_chunk")).applyInPandas(later, schema)
    return asked.filter("partner >= 0").select("id", "partner", "cost").unionByName(found), [placed, asked]


MERGES = "a bigint, b bigint, into bigint, height double, size bigint"


def _merge_equal(state: DataFrame, n: int) -> tuple[DataFrame, DataFrame | None]:
    """Equal points as one cluster each, and their merges at height 0: every copy joins the lowest id, by its order.

    Rounds would make one of these merges for each group of equal points.
    """
    groups = settle(state.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("size")))
    if groups.count() == n:
        release(groups)
        return state, None
    ends = state.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    bucket = F.floor((F.col("id") - ends["lo"]) / F.lit((ends["hi"] - ends["lo"]) // 64 + 1)).cast("int")
    copies = state.join(groups.filter("size > 1").select("vec", F.col("id").alias("into")), "vec").select(
        "id", "into", bucket.alias("_b"), F.lit(1).cast("bigint").alias("_one"))
    ranked = running_sums(copies, ["into"], "id", "_b", ["_one"], few_buckets=False)
    merged = ranked.filter("id <> into").select(F.col("into").alias("a"), F.col("id").alias("b"), "into",
                                                F.lit(0.0).alias("height"), F.col("cum__one").alias("size"))
    return groups.select("id", "vec", "size"), settle(merged)


def _finish_local(clusters: pd.DataFrame) -> pd.DataFrame:
    """All remaining merges of a bounded number of clusters, the closest pair first."""
    state = clusters.sort_values("id").reset_index(drop=True)
    ids = state["id"].to_numpy(np.int64)
    m = len(ids)
    vec, size = _matrix(state["vec"]), state["size"].to_numpy(float)
    cost = np.concatenate([_ward_costs(vec[i:i + TILE], size[i:i + TILE], vec, size)
                           for i in range(0, m, TILE)])
    np.fill_diagonal(cost, np.inf)
    who, best = cost.argmin(1), cost.min(1)
    merges = []
    for _ in range(m - 1):
        i = int(best.argmin())
        i, j = sorted((i, int(who[i])))
        total = size[i] + size[j]
        merges.append((ids[i], ids[j], ids[i], cost[i, j], int(total)))
        vec[i] = (vec[i] * size[i] + vec[j] * size[j]) / total
        size[i] = total
        gone = ~np.isfinite(cost[i]) & (np.arange(m) != i)
        fresh = _ward_costs(vec[i:i + 1], size[i:i + 1], vec, size)[0]
        fresh[gone] = np.inf
        fresh[[i, j]] = np.inf
        cost[i] = cost[:, i] = fresh
        cost[j] = cost[:, j] = np.inf
        stale = np.flatnonzero((who == i) | (who == j) | (fresh < best))
        stale = np.union1d(stale, [i, j])
        who[stale], best[stale] = cost[stale].argmin(1), cost[stale].min(1)
    return pd.DataFrame(merges, columns=["a", "b", "into", "height", "size"])


def ward_merges(points: DataFrame, vec: str = "vec", local_limit: int = 2000,
                block: int | None = None, rounds: list[tuple[int, int, int]] | None = None,
                cell: int | None = None) -> DataFrame:
    """Merge table (a, b, into, height, size) of the points, whose ``id`` is a whole number.

    A merged cluster keeps the lower id; points that are equal are merged first. Each round finds every cluster's nearest partner and
    merges all pairs that choose each other. Ward's cost never lets a merge create a closer
    neighbour, so this yields the same tree as merging the closest pair again and again, and a
    cluster keeps the partner it found until one of the two is merged: a round compares only
    new clusters and those that lost their partner with the others. Rounds end when at most
    ``local_limit`` clusters remain; those fit one small task. More than ``FEW`` clusters, or ``cell``,
    are compared by cells, with the same result. ``rounds`` is given a row for each:
    its number, the clusters there were, and the comparisons made or told by boxes.
    """
    state = settle(points.select(F.col("id").cast("bigint").alias("id"), F.col(vec).alias("vec"),
                                 F.lit(1).cast("bigint").alias("size")))
    spark = points.sparkSession
    done = spark.createDataFrame([], MERGES)
    n = state.count()
    kept, lost, at = None, None, 0
    if n > max(local_limit, 1):
        state, equal = _merge_equal(state, n)
        if equal is not None:
            done, n = equal, state.count()
    while n > max(local_limit, 1):
        at += 1
        used: list[DataFrame] = []
        if cell or (not block and n > FEW):
            near, used = _nearest_by_cells(state, n, cell, lost)
        else:
            near = _block_pairs(state, ["id", "vec", "size"], n, block, _nearest_in_block,
                                "id bigint, partner bigint, cost double", lost)
        if rounds is not None:
            rounds.append((at, n, (n if lost is None else lost.count()) * n))
        pool = near if kept is None else near.unionByName(kept)
        choice = settle(pool.groupBy("id").agg(F.min(F.struct("cost", "partner")).alias("_c")).select(
            "id", F.col("_c.partner").alias("partner"), F.col("_c.cost").alias("cost")))
        if used:
            release(*used)
        mutual = choice.groupBy(F.least("id", "partner").alias("a"),
                                F.greatest("id", "partner").alias("b")).agg(
            F.count("*").alias("_votes"), F.max("cost").alias("height")).filter("_votes = 2")
        pairs = settle(mutual.select("a", "b", "height"))
        target = pairs.select(F.explode(F.array(
            F.struct(F.col("a").alias("id"), F.col("a").alias("into"), "height"),
            F.struct(F.col("b").alias("id"), F.col("a").alias("into"), "height"))).alias("_p")
        ).select("_p.id", "_p.into")
        moved = state.join(target, "id", "left").withColumn("into", F.coalesce("into", "id"))
        members = F.collect_list(F.struct("id", "vec", "size"))
        grouped = moved.groupBy("into").agg(
            F.sum("size").alias("size"), F.sort_array(members).alias("_m"))
        first, second = F.col("_m")[0], F.try_element_at("_m", F.lit(2))
        blended = F.zip_with(first["vec"], second["vec"], lambda x, y: (
            x * first["size"] + y * second["size"]) / F.col("size"))
        state = settle(grouped.select(
            F.col("into").alias("id"),
            F.when(F.size("_m") == 2, blended).otherwise(first["vec"]).alias("vec"), "size"))
        merged = pairs.join(state.select(F.col("id").alias("a"), "size"), "a").select(
            "a", "b", F.col("a").alias("into"), "height", "size")
        done = done.unionByName(merged)
        moved_ids = target.select("id")
        kept = settle(choice.join(moved_ids, "id", "left_anti").join(
            moved_ids.withColumnRenamed("id", "partner"), "partner", "left_anti").select("id", "partner", "cost"))
        lost = settle(state.join(kept.select("id"), "id", "left_anti"))
        n = state.count()
    rest = state.groupBy().applyInPandas(_finish_local, MERGES) if n > 1 else spark.createDataFrame(
        [], MERGES)
    return settle(done.unionByName(rest))


def ward_cut(points: DataFrame, merges: DataFrame, k: int = 2) -> DataFrame:
    """id and cluster number 1..k after undoing the k - 1 highest merges.

    Clusters are numbered by their lowest id; only these k root ids reach the driver. Members find their cluster by pointer doubling over
    the merge table, so the number of rounds is logarithmic in the depth of the tree.
    """
    top = merges.orderBy(F.col("height").desc(), F.col("size").desc()).limit(k - 1).select("a", "b")
    kept = merges.join(F.broadcast(top), ["a", "b"], "left_anti")
    links = kept.select(F.col("b").alias("id"), F.col("into").alias("up"))
    base = points.select(F.col("id").cast("bigint").alias("id"))
    jump = settle(base.join(links, "id", "left").withColumn("up", F.coalesce("up", "id")))
    roots = [r["id"] for r in jump.filter("id = up").sort("id").select("id").collect()]
    state = jump
    while not state.filter(~F.col("up").isin(roots)).isEmpty():
        parents = state.select(F.col("id").alias("up"), F.col("up").alias("_next"))
        arrived = state.filter(F.col("up").isin(roots))
        moving = state.filter(~F.col("up").isin(roots)).join(parents, "up").select(
            "id", F.col("_next").alias("up"))
        state = settle(arrived.unionByName(moving))
    number = F.array_position(F.array(*[F.lit(r) for r in roots]), F.col("up"))
    return state.select("id", number.cast("int").alias("cluster"))


def leaf_order(merges: DataFrame, points: DataFrame) -> DataFrame:
    """``id`` and ``rank``, from 1, of every point in the order in which a dendrogram shows the tree.

    At every merge the lower branch, that of the smaller height, is on the left; points are
    lowest, two of them go by id, branches of equal height by size and id. A branch is known by its lowest id and its
    size. Its first place is the sum of the left branches passed on the way from the root, found
    by pointer doubling up the merge table, so rounds are logarithmic in the depth of the tree.
    """
    before = F.lag("size").over(Window.partitionBy("into").orderBy("size"))
    joined = merges.withColumn("size_a", F.coalesce(before, F.lit(1).cast("bigint"))).withColumn(
        "size_b", F.col("size") - F.col("size_a"))
    base = points.select(F.col("id").cast("bigint").alias("id"), F.lit(1).cast("bigint").alias("size"), F.lit(0.0).alias("height"))
    branches = settle(base.unionByName(merges.select(F.col("into").alias("id"), "size", "height")))

    def side(tag: str) -> DataFrame:
        return branches.select(F.col("id").alias(tag), F.col("size").alias(f"size_{tag}"), F.col("height").alias(f"height_{tag}"))

    forks = joined.join(side("a"), ["a", "size_a"]).join(side("b"), ["b", "size_b"])
    first = F.struct(*[F.col(f"{c}a") for c in ("height_", "size_", "")]) < F.struct(*[F.col(f"{c}b") for c in ("height_", "size_", "")])
    none = F.lit(0).cast("bigint")
    steps = forks.select(F.explode(F.array(
        F.struct(F.col("a").alias("id"), F.col("size_a").alias("size"), F.when(first, none).otherwise(F.col("size_b")).alias("shift"),
                 F.col("into").alias("up"), F.col("size").alias("up_size")),
        F.struct(F.col("b").alias("id"), F.col("size_b").alias("size"), F.when(first, F.col("size_a")).otherwise(none).alias("shift"),
                 F.col("into").alias("up"), F.col("size").alias("up_size")))).alias("s")).select("s.*")
    state = settle(branches.select("id", "size").join(steps, ["id", "size"], "left").withColumn("shift", F.coalesce("shift", none)))
    while not state.filter("up IS NOT NULL").isEmpty():
        above = state.select(F.col("id").alias("up"), F.col("size").alias("up_size"), F.col("shift").alias("_shift"),
                             F.col("up").alias("_up"), F.col("up_size").alias("_up_size"))
        wider = state.join(above, ["up", "up_size"], "left").select(
            "id", "size", (F.col("shift") + F.coalesce("_shift", none)).alias("shift"), F.col("_up").alias("up"), F.col("_up_size").alias("up_size"))
        new = settle(wider)
        release(state)
        state = new
    return state.filter("size = 1").select("id", (F.col("shift") + 1).alias("rank"))


def number_ids(df: DataFrame, id_col: str) -> DataFrame:
    """Add a dense whole-number ``id`` in a fixed order, without sorting in one task."""
    return hash_rank(df, [], id_col, "id")
