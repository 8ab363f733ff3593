"""Exact nearest neighbours as a partitioned join: Voronoi cells around pivots, ruled out by the triangle inequality."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from seqdrift.operators.settle import settled

#: Bytes and rows, at most, of reference vectors, and of new vectors, that meet in one group.
BLOCK_BYTES, BLOCK_ROWS = 16 << 20, 1 << 15
#: Bytes and rows of reference vectors that a cell should have, and bytes of all pivots, which bounds what the driver sees.
CELL_BYTES, CELL_ROWS = 4 << 20, 1 << 11
PIVOT_BYTES = 8 << 20
MOST_PIVOTS = 4096
#: Numbers of one matrix of approximate distances, and new rows that look for their cells together.
_SQUARES, _TOGETHER = 1 << 20, 256
#: Relative error of a sum of squares in doubles, for some thousands of dimensions.
_SLACK = 1e-12


def _squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances by one matrix product, a bound of their error by row). Both sides should be centred."""
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    return xx[:, None] + yy[None, :] - 2 * x @ y.T, _SLACK * (xx + (yy.max() if len(yy) else 0))


def nearest_of(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of x, distances, ids) of the k nearest rows of y to each row of x, by row, distance and id; with ``within``,
    only of those at most that far away.

    Both are centred on y first, so that vectors far from the origin keep their digits. The matrix product only chooses:
    whatever its error lets be among the k nearest is measured again from differences of the vectors as they are.
    """
    k = min(k, len(y))
    centre = y.mean(axis=0)
    moved, known = x - centre, y - centre
    xx, yy = (moved * moved).sum(axis=1), (known * known).sum(axis=1)
    error = 2 * _SLACK * (xx + yy.max())
    # One product gives y^2 - 2xy, the squared distances less each row's x^2.
    left, right = np.column_stack((-2 * moved, np.ones(len(x)))), np.column_stack((known, yy)).T
    bound = np.full(len(x), np.inf) if within is None else within * within * (1 + 4 * _SLACK) - xx + error
    found = []
    for low in range(0, len(x), step := max(1, _SQUARES // len(y))):
        part, squares, limit = x[low : low + step], left[low : low + step] @ right, bound[low : low + step]
        near = squares <= limit[:, None]
        if np.count_nonzero(near) > max(64, 8 * k) * len(part):
            least = np.partition(squares, k - 1, axis=1)[:, k - 1]
            near = squares <= np.minimum(limit, least + error[low : low + step])[:, None]
        row, at = np.divmod(np.flatnonzero(near), len(y))
        exact = np.empty(len(row))
        for a in range(0, len(row), width := max(1, _SQUARES // y.shape[1])):
            pair = slice(a, a + width)
            exact[pair] = np.sqrt(((part[row[pair]] - y[at[pair]]) ** 2).sum(axis=1))
        order = np.lexsort((ids[at], exact, row))
        row, at, exact = row[order], at[order], exact[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        found.append((row[kept] + low, exact[kept], ids[at[kept]]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


@dataclass
class Cells:
    """The pivots, and for each cell how many reference rows it has and how near and far from the pivot these lie."""

    pivots: np.ndarray
    count: np.ndarray
    low: np.ndarray
    high: np.ndarray
    #: Greatest squared distance of a reference row from the pivots' centre.
    reach: float = 0.0

    def __post_init__(self) -> None:
        self.centre = self.pivots.mean(axis=0)
        self.moved = self.pivots - self.centre
        squares, error = _squares(self.moved, self.moved)
        self.apart = np.sqrt(np.maximum(squares, 0) + error[:, None])  # never too small

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest pivot, distance to it, squared distance to the pivots' centre)."""
        cell = np.argmin(_squares(x - self.centre, self.moved)[0], axis=1)
        return cell, np.sqrt(((x - self.pivots[cell]) ** 2).sum(axis=1)), ((x - self.centre) ** 2).sum(axis=1)

    def home(self, x: np.ndarray, k: int) -> list[np.ndarray]:
        """For each row the nearest cells that together have k reference rows."""
        order = np.argsort(_squares(x - self.centre, self.moved)[0], axis=1, kind="stable")
        enough = (np.cumsum(self.count[order], axis=1) < k).sum(axis=1) + 1
        return [o[:n][self.count[o[:n]] > 0] for o, n in zip(order, enough, strict=True)]

    def may(self, x: np.ndarray, within: np.ndarray, own: np.ndarray, among: np.ndarray) -> np.ndarray:
        """For each row, whose nearest pivot is ``own``, which of the cells ``among`` may have a reference row at most
        ``within`` away.

        A row of cell j lies between ``low`` and ``high`` from pivot j, and no nearer to the row's own pivot than to
        pivot j. All three bounds are lessened by the error of the distances in them.
        """
        moved = x - self.centre
        squares, error = _squares(moved, self.moved[among])
        error = error[:, None]
        near, far = np.sqrt(np.maximum(squares - error, 0)), np.sqrt(np.maximum(squares, 0) + error)
        mine = ((moved - self.moved[own]) ** 2).sum(axis=1)[:, None]
        slack = 2 * error + 4 * _SLACK * (self.reach + (self.moved * self.moved).sum(axis=1).max())
        plane = (squares - mine - slack) / (2 * np.maximum(self.apart[own][:, among], 1e-300))
        least = np.maximum.reduce([near - self.high[among], self.low[among] - far, plane])
        return (least * (1 - _SLACK) <= within[:, None] * (1 + _SLACK)) & (self.count[among] > 0)

    def _beyond(self, x: np.ndarray, within: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(cells that each row needs, those of them beside its home), as masks."""
        needed = self.may(x, within, self.of(x)[0], np.arange(len(self.pivots)))
        beside = needed.copy()
        for i, home in enumerate(self.home(x, k)):
            beside[i, home] = False
        return needed, beside

    def others(self, x: np.ndarray, within: np.ndarray, k: int) -> list[np.ndarray]:
        """For each row the cells, beside its home, that may have a reference row at most ``within`` away."""
        return [np.flatnonzero(m) for m in self._beyond(x, within, k)[1]]

    def bins(self, most: int) -> np.ndarray:
        """The bin of each cell: cells that lie side by side, of ``most`` rows together, or one cell of more."""
        place, made, parts = np.full(len(self.pivots), -1), 0, [np.flatnonzero(self.count > 0)]
        while parts:
            part = parts.pop()
            if len(part) < 2 or self.count[part].sum() <= most:
                place[part], made = made, made + 1
                continue
            widest = np.argmax(self.moved[part].var(axis=0))
            part = part[np.argsort(self.moved[part, widest], kind="stable")]
            so_far = np.cumsum(self.count[part])
            cut = min(max(int(np.searchsorted(so_far, so_far[-1] / 2)), 1), len(part) - 1)
            parts += [part[:cut], part[cut:]]
        return place

    def bins_beyond(self, x: np.ndarray, within: np.ndarray, k: int, place: np.ndarray) -> list[np.ndarray]:
        """For each row that needs a cell beside its home, the bins of all cells that it needs."""
        needed, beside = self._beyond(x, within, k)
        in_bin = (place[:, None] == np.arange(place.max() + 1)).astype(np.float32)
        bins = (needed.astype(np.float32) @ in_bin > 0) & beside.any(axis=1)[:, None]
        return [np.flatnonzero(m) for m in bins]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as a matrix."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), float)
    widths = np.diff(lists.offsets.to_numpy())
    if len(widths) and (widths != widths[0]).any():
        raise ValueError("vectors must have one length")
    return values.reshape(len(lists), -1) if len(widths) else np.zeros((0, 1))


def _with_places(rows: DataFrame, choose) -> DataFrame:
    """Add ``places``, by ``choose`` (vectors, batch), to a settled copy of rows that have ``x``."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for low in range(0, frame.num_rows, 1024):
                part = frame.slice(low, 1024)
                found = choose(_matrix(part.column("x")), part)
                places = pa.array([c.tolist() for c in found], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, places], names=[*part.schema.names, "places"])

    return settled(rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("places", ArrayType(IntegerType()))])))


_MET = pa.schema([("nid", pa.int64()), ("distances", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64()))])


def _met(nid: np.ndarray, distances: np.ndarray, ids: np.ndarray) -> pa.Table:
    """Rows sorted by nid's runs, as one row a run."""
    starts = np.flatnonzero(np.r_[True, nid[1:] != nid[:-1]]) if len(nid) else np.zeros(0, np.int64)
    ends = pa.array(np.r_[starts, len(nid)].astype(np.int32))
    return pa.table([pa.array(nid[starts]), pa.ListArray.from_arrays(ends, pa.array(distances)), pa.ListArray.from_arrays(ends, pa.array(ids))], schema=_MET)


def _visit(rows: DataFrame, reference: DataFrame, count: dict[int, int], k: int, per_block: int, cells: Cells | None = None) -> DataFrame:
    """(nid, found): the k nearest of each block that a row (nid, x, within, places) visits, as (distance, id), if they
    are at most ``within`` away. Reference rows are (id, x, cell, salt, place), ``count`` those of a place.

    A place of many reference rows is split into blocks; the rows that visit a block are split into slices, for each of
    which the block is sent. So neither a heavy place nor one that everyone visits is one task's work. With ``cells``,
    rows that lie together meet only those cells of the block that one of them needs.
    """
    spark = rows.sparkSession
    visited = {r["place"]: r["n"] for r in rows.select(F.explode("places").alias("place")).groupBy("place").agg(F.count("*").alias("n")).collect()}
    plan = [(int(p), max(1, math.ceil(int(count[p]) / per_block)), max(1, math.ceil(n / per_block))) for p, n in visited.items()]
    plan = F.broadcast(spark.createDataFrame(plan, "place int, blocks int, slices int"))  # a row a pivot at most
    key = ["place", "block", "slice"]
    left = rows.select("nid", "x", "within", F.explode("places").alias("place")).join(plan, "place")
    left = left.select("nid", "x", "within", "place", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("nid"), F.col("slices")).cast("int").alias("slice"))
    right = reference.join(plan, "place").withColumn("block", F.least(F.floor(F.col("salt") * F.col("blocks")), F.col("blocks") - 1).cast("int"))
    right = right.select("id", "x", "cell", "place", "block", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))

    def meet(new: pa.Table, known: pa.Table) -> pa.Table:
        if not new.num_rows or not known.num_rows:
            return _MET.empty_table()
        x, y = _matrix(new.column("x")), _matrix(known.column("x"))
        nid, within, ids = (t.column(c).to_numpy() for t, c in ((new, "nid"), (new, "within"), (known, "id")))
        if cells is None:
            row, distances, found = nearest_of(x, y, ids, k, within)
            return _met(nid[row], distances, found)
        own, cell = np.concatenate([cells.of(x[low : low + 1024])[0] for low in range(0, len(x), 1024)]), known.column("cell").to_numpy()
        there, at = np.unique(cell, return_inverse=True)
        by_own, out = np.argsort(own, kind="stable"), []
        for low in range(0, len(x), _TOGETHER):
            part = by_own[low : low + _TOGETHER]
            needed = cells.may(x[part], within[part], own[part], there).any(axis=0)
            some = slice(None) if needed.all() else needed[at]
            if needed.any():
                row, distances, found = nearest_of(x[part], y[some], ids[some], k, within[part])
                out.append((nid[part[row]], distances, found))
        return _met(*(np.concatenate(c) for c in zip(*out, strict=True))) if out else _MET.empty_table()

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "nid long, distances array<double>, ids array<long>")
    return found.select("nid", F.arrays_zip(F.col("distances").alias("distance"), F.col("ids").alias("id")).alias("found"))


def _k_best(found: DataFrame, k: int) -> DataFrame:
    return found.groupBy("nid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))


def nearest_join(reference: DataFrame, new: DataFrame, k: int, block_bytes: int = BLOCK_BYTES, cell_bytes: int = CELL_BYTES, pivot_bytes: int = PIVOT_BYTES) -> DataFrame:
    """(nid, found): for each row of ``new`` (nid, x) the k nearest rows of ``reference`` (id, x), as an array of
    (distance, id) by distance, then id.

    Pivots are reference rows, picked by hash; each reference row belongs to the cell of its nearest one. A new row first
    meets the cells nearest to it that hold k rows, which bounds its k-th distance. If the triangle inequality, with the
    cells' least and greatest radius and the planes between pivots, cannot rule out all other cells, the row then goes once
    to each bin of neighbouring cells that has one it needs. Distances, not approximations, decide. The driver sees the
    pivots, at most ``pivot_bytes``, and counts and radii of cells, never rows. Where nothing can be ruled out, as in noise
    of many dimensions, every block meets every row once: pairs grow with the square, what a task holds does not.
    Null vectors meet nothing.
    """
    reference, new = reference.where("x is not null"), new.where("x is not null").select("nid", "x")
    size = reference.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("x")), F.lit(1)).alias("d")).first()
    vector = 8 * max(1, size["d"])
    per_block = max(1, min(BLOCK_ROWS, block_bytes // vector))
    wanted = max(1, min(MOST_PIVOTS, pivot_bytes // vector, math.ceil(size["n"] / max(1, min(CELL_ROWS, cell_bytes / vector)))))
    picked = reference.select("x").distinct().orderBy(F.xxhash64("x", F.lit(42)), "x").limit(wanted)
    pivots = np.array([r["x"] for r in picked.collect()], float)
    if not len(pivots):
        return new.select("nid", F.lit(None).cast("array<struct<distance:double,id:bigint>>").alias("found")).where("false")
    cells = Cells(pivots, *np.zeros((3, len(pivots))))

    def assign(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for low in range(0, frame.num_rows, 1024):
                part = frame.slice(low, 1024)
                cell, radius, reach = cells.of(_matrix(part.column("x")))
                made = [part.column("id"), part.column("x"), pa.array(cell.astype(np.int32)), pa.array(radius), pa.array(reach), part.column("salt")]
                yield pa.RecordBatch.from_arrays(made, names=["id", "x", "cell", "radius", "reach", "salt"])

    salted = reference.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"), F.rand(42).alias("salt"))  # settled, so that a row has one salt
    known = settled(salted.mapInArrow(assign, "id long, x array<double>, cell int, radius double, reach double, salt double"))
    summary = known.groupBy("cell").agg(F.count("*").alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high"), F.max("reach").alias("reach")).collect()
    for row in summary:
        cells.count[row["cell"]], cells.low[row["cell"]], cells.high[row["cell"]] = row["n"], row["low"], row["high"]
    cells.reach = max(row["reach"] for row in summary)
    known = known.select("id", "x", "cell", "salt")

    new = new.select(F.col("nid").cast("long").alias("nid"), F.col("x").cast("array<double>").alias("x"))
    at_home = _with_places(new, lambda x, _: cells.home(x, k)).withColumn("within", F.lit(float("inf")))
    near = _k_best(_visit(at_home, known.withColumn("place", F.col("cell")), dict(enumerate(cells.count)), k, per_block), k)
    if (cells.count > 0).sum() <= 1:
        return near
    near = settled(near)
    bounded = new.join(near, "nid").withColumn("within", F.element_at("found", -1)["distance"])
    place = cells.bins(per_block)
    chosen = _with_places(bounded, lambda x, batch: cells.bins_beyond(x, batch.column("within").to_numpy(), k, place))
    places = reference.sparkSession.createDataFrame(list(enumerate(place.tolist())), "cell int, place int")
    count = {int(p): int(cells.count[place == p].sum()) for p in np.unique(place)}
    rest = _visit(chosen.where(F.size("places") > 0), known.join(F.broadcast(places), "cell"), count, k, per_block, cells)
    return chosen.where(F.size("places") == 0).select("nid", "found").unionByName(_k_best(rest, k))
