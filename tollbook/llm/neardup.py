"""Embedding near-dedup: exact pairs above a cosine by dual traversal of cover trees.

Vectors are scaled to length one; equal ones form a class with a weight. A tree of centres is grown level by level
over all vectors: centres of a cell's children come from a bounded sample of its members, each member goes to the nearest,
those beyond half the radius to a child of their own. A level reads the table again and keeps counts and samples only;
vectors are moved once, when each goes to the block of its cell. Inside blocks a cover tree goes on in memory, each level
with half the radius of the one above.

Blocks whose centres are farther apart than both covering radii and the threshold are dropped by pairs; those whose
farthest members must be within it are settled where they stand, by their weights, which keeps groups of near copies of
any size cheap. Blocks of the pairs that are left are read side by side from the shared folder (a product of the table with
itself, nothing is exchanged, so disk grows with the table and not with the pairs) and traversed in the same way: one product
of narrow matrices bounds many distances at once, only what may be near is looked at in double precision.
Tasks return link counts per class and a spanning forest of their links, never all pairs.

Results by case: null and zero vectors and those with null or non-finite components link with
nothing; vectors of different lengths do not link; rows with a null id take no part (no links,
null component, not kept); each row is one vector, also if its id is repeated; equal rows link;
an empty table gives no rows; further columns are not read."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollbook.llm import common
from tollbook.llm.common import few, parts, small_batches, staged, table, tidy
from tollbook.llm.components import components

SAMPLE, BLOCK, BUCKET, TILE = 512, 4096, 16, 256  # members of a cell that children's centres are chosen from; members of a block
BLOCK_BYTES, WIDE, SMALL = 4 * 1024 * 1024, 1024, 16  # of a block of long vectors; columns of a tile; cells of up to this part of a block share one, and so much of a block is sampled for each child
MOST_LEVELS, MOST_BYTES = 24, 64 * 1024 * 1024  # levels, and bytes of centres; beyond, what does not fit a block is cut by hash
BASIS, LONGEST = 20, 1024  # directions that bound distances before all components do; components up to which they are looked for
HEADS, KEPT_BYTES = 16_384, 32 * 1024 * 1024  # blocks up to which their centres are broadcast; vectors of blocks that a worker keeps as trees
SAFE = 1e-6  # rounding in distances from cosines near one; bounds this close to the threshold open the node


def unit(vector) -> np.ndarray | None:
    """The vector with length one, in double precision, or nothing."""
    if vector is None or any(x is None for x in vector):
        return None
    v = np.array(vector, np.float64).reshape(1, -1)
    return scaled(v)[0] if usable(v)[0] else None


def usable(v: np.ndarray) -> np.ndarray:
    """Rows that have a direction."""
    return np.isfinite(v).all(axis=1) & v.any(axis=1)


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows with length one, in double precision."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True)) + 0.0


def directed(column: pa.Array):
    """For each length of vectors in a column: places of the usable ones, the vectors as given and with length one."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    offsets, values = column.offsets.to_numpy()[: len(column)], column.values.to_numpy(zero_copy_only=False)
    for size in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == size)
        given = values[offsets[at][:, None] + np.arange(size)]
        fine = usable(given)
        if fine.any():
            yield at[fine], np.ascontiguousarray(given[fine]), scaled(given[fine])


def keys(points: np.ndarray) -> list[bytes]:
    """Keys of the directions of unit vectors."""
    return [hashlib.blake2b(p.tobytes(), digest_size=16).digest() for p in points]


def ranks(names: list[bytes]) -> np.ndarray:
    """Numbers from 0 to 1 that follow from the keys."""
    return np.frombuffer(b"".join(n[:8] for n in names), "<u8") / 2.0**64


def read(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Id and vector, of floats where it has floats, else of doubles."""
    kind = vectors.schema[vector].dataType.elementType.typeName()
    return small_batches(vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>" if kind == "float" else "array<double>").alias("vector")))


def directions(vectors: DataFrame) -> DataFrame:
    """Id and key of the direction (null where there is none)."""

    def run(batches):
        for batch in batches:
            out = np.full(batch.num_rows, None, object)
            for at, _, points in directed(batch.column(1)):
                out[at] = keys(points)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "direction"])

    return vectors.mapInArrow(tidy(run), "id long, direction binary")


class Tree:
    """A cover tree as flat arrays; node i covers the points start[i]:end[i], its centre is the first of them."""

    def __init__(self, start, end, radius, child, children, points):
        self.start, self.end, self.radius, self.child, self.children, self.points = start, end, radius, child, children, points
        self.single, self.low, self.first = end - start == 1, None, {}

    @classmethod
    def build(cls, points: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree and the order of points in it."""
        order, nodes = np.arange(len(points)), []

        def node(start, end):
            away = 0.0 if end - start < 2 else float(np.sqrt(np.maximum(0, 2 - 2 * points[order[start:end]] @ points[order[start]])).max())
            nodes.append([start, end, away, 0, 0])
            return len(nodes) - 1

        work = [node(0, len(points))] if len(points) else []
        while work:
            at = work.pop()
            start, end, radius = nodes[at][:3]
            if end - start == 1:
                continue
            if end - start <= BUCKET or radius < 1e-7:
                cuts = list(range(start, end))
            else:
                own = points[order[start:end]].astype(np.float32)
                near = np.concatenate([own[k: k + TILE] @ own.T >= 1 - (radius / 2) ** 2 / 2 for k in range(0, len(own), TILE)])
                near |= np.eye(len(own), dtype=bool)
                near[0] &= points[order[start:end]] @ points[order[start]] > 1 - (radius * 0.999) ** 2 / 2  # the farthest leaves, whatever floats say
                near[0, 0] = True
                left, alone = np.ones(len(own), bool), np.flatnonzero(near.sum(axis=1) == 1)
                left[alone] = False
                found = []
                for k in [0, *np.flatnonzero(left).tolist()]:
                    if left[k]:
                        with_it = np.flatnonzero(near[k] & left)
                        left[with_it] = False
                        found.append(np.concatenate([[k], with_it[with_it != k]]))
                found = found[:1] + list(alone.reshape(-1, 1)) + found[1:] if found and found[0][0] == 0 else list(alone.reshape(-1, 1)) + found
                cuts = np.cumsum([start, *[len(f) for f in found]]).tolist()
                cuts.pop()
                order[start:end] = order[start:end][np.concatenate(found)]
            below = [node(a, b) for a, b in zip(cuts, [*cuts[1:], end])]
            nodes[at][3:] = below[0], len(below)
            work += below
        n = np.array(nodes, np.float64).reshape(-1, 5)
        return cls(*(n[:, k].astype(np.int64) for k in (0, 1)), n[:, 2], *(n[:, k].astype(np.int64) for k in (3, 4)), points[order]), order

    def below(self, i: int) -> np.ndarray:
        """Children of a node; a single point stands for itself."""
        return np.arange(self.child[i], self.child[i] + self.children[i]) if self.children[i] else np.array([i])

    def lifted(self, nodes: np.ndarray, basis: np.ndarray | None, more: float, left: bool) -> np.ndarray:
        """Rows for nodes; the product of a left and a right one is half of (both radii and ``more``) squared less half
        the squared distance of the centres along the basis."""
        if self.low is None:
            self.low = (self.points if basis is None else self.points @ basis).astype(np.float32)
        c, r = self.low[self.start[nodes]], self.radius[nodes] + (more if left else 0)
        half = (r * r - np.square(c, dtype=np.float64).sum(axis=1)) / 2
        one = np.ones(len(nodes))
        return np.concatenate([c, np.stack([r, half, one] if left else [r, one, half], axis=1).astype(np.float32)], axis=1)

    def opened(self, i: int, basis: np.ndarray | None, more: float, left: bool) -> tuple:
        """Centres of a node's children, their mean and their lifted rows; those of the root are kept, as blocks meet many others."""
        if i or left not in self.first:
            nodes = self.below(i)
            centres = self.points[self.start[nodes]]
            found = centres, centres.mean(axis=0), self.lifted(nodes, basis, more, left)
            if i:
                return found
            self.first[left] = found
        return self.first[left]


class Links:
    """Weights linked to each point, and labels of what hangs together."""

    def __init__(self, size: int):
        self.count, self.label = np.zeros(size, np.int64), np.arange(size)

    def join(self, a: np.ndarray, b: np.ndarray):
        while True:
            x, y = self.label[a], self.label[b]
            if (x == y).all():
                return
            low = np.minimum(x, y)
            np.minimum.at(self.label, x, low)
            np.minimum.at(self.label, y, low)
            while (self.label != self.label[self.label]).any():
                self.label = self.label[self.label]


def traverse(a: Tree, b: Tree | None, weights: np.ndarray, cosine: float, basis: np.ndarray | None = None) -> Links:
    """Links between two blocks, or within one (no ``b``). Points of ``b`` are numbered after those of ``a``."""
    same, shift = b is None, 0 if b is None else len(a.points)
    b = a if same else b
    reach, links = np.sqrt(2 - 2 * cosine), Links(len(weights))
    slack = 1e-5 + 1.2e-7 * a.points.shape[1]  # what floats may be off by
    held = np.empty(TILE * WIDE, np.float32)

    def whole(i, j):
        """All points of two nodes, or of one, link."""
        left, right = np.arange(a.start[i], a.end[i]), np.arange(b.start[j], b.end[j]) + shift
        links.join(np.full(len(left) + len(right), left[0]), np.concatenate([left, right]))
        if same and i == j:
            links.count[left] += weights[left].sum() - weights[left]
        else:
            links.count[left] += weights[right].sum()
            links.count[right] += weights[left].sum()

    work = [(0, 0)] if len(a.points) and len(b.points) else []
    while work:
        i, j = work.pop()
        alike = same and i == j
        if alike and a.single[i]:
            continue
        if alike and 2 * a.radius[i] <= reach - SAFE:
            whole(i, i)
            continue
        left, right = a.below(i), b.below(j)
        large, most = len(left) * len(right) > TILE, None
        if large:
            (c, middle, above), (d, other_middle, beside) = a.opened(i, basis, reach + SAFE, True), b.opened(j, basis, 0, False)
            if not alike:  # along the line through both middles nothing near is farther apart than the threshold either
                line = middle - other_middle
                line /= max(np.sqrt(line @ line), 1e-300)
                low, high = c @ line - a.radius[left] - reach - SAFE, d @ line + b.radius[right]
                keep, other = np.flatnonzero(low <= high.max()), np.flatnonzero(high >= low.min())
                if not len(keep):
                    continue
                keep, other = keep[np.argsort(low[keep])], other[np.argsort(-high[other])]
                left, right, above, beside = left[keep], right[other], above[keep], beside[other]
                most = np.searchsorted(-high[other], -low[keep], "right")  # columns that a row may be near to
            beside = beside.T.copy()
        for p in range(0, len(left), TILE):
            for q in range(0, len(right), WIDE):
                rows, cols = left[p: p + TILE], right[q: q + WIDE if most is None else min(q + WIDE, most[p])]
                if not len(cols):
                    break
                if alike and cols[-1] < rows[0]:
                    continue
                if large:
                    room = np.matmul(above[p: p + TILE], beside[:, q: q + len(cols)], out=held[: len(rows) * len(cols)].reshape(len(rows), len(cols)))
                    some = np.flatnonzero(room.max(axis=1) >= -slack)
                    if not len(some):
                        continue
                    x, y = np.nonzero(room[some] >= -slack)
                    x = some[x]
                if not large or len(x) > room.size // 50:
                    cos = a.points[a.start[rows]] @ b.points[b.start[cols]].T
                    spread = a.radius[rows][:, None] + b.radius[cols][None, :]
                    x, y = np.nonzero(np.sqrt(np.maximum(0, 2 - 2 * cos)) <= spread + reach + SAFE)
                    cos = cos[x, y]
                else:
                    cos = np.einsum("ij,ij->i", a.points[a.start[rows[x]]], b.points[b.start[cols[y]]])
                u, v = rows[x], cols[y]
                if alike:
                    u, v, cos = (k[u <= v] for k in (u, v, cos))
                single = a.single[u] & b.single[v]
                hit = single & (cos >= cosine)
                if alike:
                    hit &= u < v
                if hit.any():
                    s, t = a.start[u[hit]], b.start[v[hit]] + shift
                    for one, other in ((s, t), (t, s)):
                        links.count += np.rint(np.bincount(one, weights[other], len(weights))).astype(np.int64)
                    links.join(s, t)
                u, v, gap = u[~single], v[~single], np.sqrt(np.maximum(0, 2 - 2 * cos[~single]))
                spread = a.radius[u] + b.radius[v]
                near = gap <= spread + reach + SAFE
                inside = near & (gap + spread <= reach - SAFE)
                if alike:
                    inside &= u < v
                for s, t in zip(u[inside], v[inside]):
                    whole(s, t)
                work += zip(u[near & ~inside].tolist(), v[near & ~inside].tolist())
    return links


class Cells:
    """Centres of the children of each cell that was split, for each length of vectors; the root is cell 0."""

    def __init__(self):
        self.split, self.n, self.next, self.bytes, self.basis = {}, {}, {}, 0, {}

    def place(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each vector, and the distance to its centre."""
        size = points.shape[1]
        cell, away, work = np.zeros(len(points), np.int64), np.full(len(points), 2.0), [(0, np.arange(len(points)))]
        while work:
            at, rows = work.pop()
            if (size, at) not in self.split:
                continue
            centres, net, first = self.split[size, at]
            cos = points[rows] @ centres.T
            nearest = np.argmax(cos, axis=1)
            away[rows] = np.sqrt(np.maximum(0, 2 - 2 * cos[np.arange(len(rows)), nearest]))
            cell[rows] = first + 2 * nearest + (away[rows] > net)
            by = np.argsort(cell[rows], kind="stable")
            ends = np.flatnonzero(np.diff(cell[rows][by], append=-1)) + 1
            work += [(int(cell[own[0]]), own) for own in np.split(rows[by], ends[:-1]) if len(own)]
        return cell, away

    def add(self, size: int, cell: int, centres: np.ndarray, net: float):
        """A cell is split."""
        first = self.next.get(size, 1)
        self.split[size, cell] = centres, net, first
        self.next[size] = first + 2 * len(centres)
        self.bytes += centres.nbytes


    def pools(self) -> dict:
        """Blocks that small cells share, numbered from -1 down, up to what fits."""
        out, last = {}, {}
        for (size, cell), n in sorted(self.n.items()):
            if (size, cell) not in self.split and n <= fits(size) // SMALL:
                pool, held = last.get(size, (-1, 0))
                if held + n > fits(size):
                    pool, held = pool - 1, 0
                out[size, cell], last[size] = pool, (pool, held + n)
        return out


def fits(size: int) -> int:
    """Members of a block."""
    return max(16, min(BLOCK, BLOCK_BYTES // (8 * size)))


def surveyed(vectors: DataFrame, cells: Cells, new: dict, rates: dict, rate: float) -> DataFrame:
    """Members and radius of new cells, a row for each task, and some of their members. ``new`` has the first new cell of each length."""

    def run(batches):
        found = {}
        for batch in batches:
            for at, given, points in directed(batch.column(1)):
                fine = batch.column(0).is_valid().to_numpy(zero_copy_only=False)[at]
                given, points = given[fine], points[fine]
                names = np.array(keys(points), object)
                _, once = np.unique(names.astype("S16"), return_index=True)
                given, points, names, size = given[once], points[once], names[once], points.shape[1]
                cell, away = cells.place(points)
                fresh = cell >= new.get(size, 0)
                for c, n, w in zip(*_sums(cell[fresh], away[fresh])):
                    before = found.get((size, c), (0, 0.0))
                    found[size, c] = before[0] + n, max(before[1], w)
                rank = ranks(names) if len(names) else np.zeros(0)
                some = fresh & (rank < np.array([rates.get((size, c), rate) for c in cell.tolist()]))
                if some.any():
                    k = int(some.sum())
                    yield pa.RecordBatch.from_arrays([pa.array([size] * k, pa.int32()), pa.array(cell[some]), pa.nulls(k, pa.int64()), pa.array(rank[some]), pa.array([g.tobytes() for g in given[some]], pa.binary())], LEVEL_NAMES)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int32()), pa.array([c for _, c in found], pa.int64()), pa.array([n for n, _ in found.values()], pa.int64()),
                                              pa.array([w for _, w in found.values()], pa.float64()), pa.nulls(len(found), pa.binary())], LEVEL_NAMES)

    return vectors.mapInArrow(tidy(run), "size int, cell long, n long, away double, given binary")


LEVEL_NAMES = ["size", "cell", "n", "away", "given"]


def _sums(cell: np.ndarray, away: np.ndarray):
    """Cells, their members and largest distances."""
    names, at, n = np.unique(cell, return_inverse=True, return_counts=True)
    most = np.zeros(len(names))
    np.maximum.at(most, at, away)
    return names.tolist(), n.tolist(), most.tolist()


def nets(sample: pd.DataFrame) -> pd.DataFrame:
    """Children's centres of one cell, about as many as make blocks of its members: of a bounded sample some that lie
    farther apart than half its radius, which is halved again until there are two."""
    sample = sample.sort_values("away").head(SAMPLE)
    points = scaled(np.concatenate([_vectors(g, int(sample["size"].iloc[0])) for g in sample["given"]]))
    radius = float(sample["radius"].iloc[0])
    while True:
        radius /= 2
        picked = [0]
        for k in range(1, len(points)):
            if len(picked) < sample["most"].iloc[0] and (2 - 2 * points[picked] @ points[k] > radius**2).all():
                picked.append(k)
        if len(picked) > 1 or radius < 1e-9:
            break
    if len(picked) == 1:  # closer than any radius can tell apart: any two
        picked = list(range(min(2, len(points))))
    return pd.DataFrame({"size": [sample["size"].iloc[0]], "cell": [sample["cell"].iloc[0]], "centres": [points[picked].tobytes()], "net": [radius]})


def grown(vectors: DataFrame, n: int, reach: float) -> Cells:
    """The tree of centres: its cells fit a block, or all members link."""
    cells, new, rates, rate, spark = Cells(), {}, {}, 8 * SAMPLE / max(1, n), vectors.sparkSession
    if n <= 16:  # the least a block holds
        return cells
    for _ in range(MOST_LEVELS):
        level = staged(surveyed(vectors, cells, new, rates, rate), "tree-level")
        counts = level.filter("n is not null").groupBy("size", "cell").agg(F.sum("n").alias("n"), F.max("away").alias("radius")).collect()
        cells.n.update({(r["size"], r["cell"]): r["n"] for r in counts})
        large = [(r["size"], r["cell"], r["radius"], min(SAMPLE, 5 * r["n"] // (4 * fits(r["size"])) + 1)) for r in counts if r["n"] > fits(r["size"]) and 2 * r["radius"] > reach - SAFE]
        if not large or cells.bytes > MOST_BYTES:
            break
        if not cells.split:
            for size in {s for s, *_ in large if BASIS + 16 < s <= LONGEST}:
                some = np.array([scaled(_vectors(r["given"], size))[0] for r in level.filter(f"given is not null and size = {size}").select("given").limit(8 * SAMPLE).collect()])
                cells.basis[size] = np.linalg.eigh(np.cov(some.T))[1][:, -BASIS:] if len(some) > 1 else np.eye(size)[:, :BASIS]
        wanted = F.broadcast(spark.createDataFrame(large, "size int, cell long, radius double, most int"))
        new, rates = dict(cells.next), {}
        for r in level.filter("given is not null").join(wanted, ["size", "cell"]).groupBy("size", "cell").applyInPandas(nets, "size int, cell long, centres binary, net double").collect():
            size, cell = r["size"], r["cell"]
            centres = np.frombuffer(r["centres"], np.float64).reshape(-1, size)
            first = cells.next.get(size, 1)
            cells.add(size, cell, centres, r["net"])
            rates |= dict.fromkeys(((size, c) for c in range(first, cells.next[size])), max(4, fits(size) // SMALL) * len(centres) / cells.n[size, cell])
        new = {size: new.get(size, 1) for size in cells.next}
        if not rates:
            break
    return cells


def placed(vectors: DataFrame, cells: Cells) -> DataFrame:
    """Every vector with the block it goes to; of equal ones in a batch one goes."""
    salts, pools = {(size, cell): (n - 1) // fits(size) + 1 for (size, cell), n in cells.n.items()}, cells.pools()

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for at, given, points in directed(batch.column(1)):
                fine = ids.is_valid().to_numpy(zero_copy_only=False)[at]
                at, given, points = at[fine], given[fine], points[fine]
                if not len(at):
                    continue
                names = np.array(keys(points), object)
                _, once, back, weight = np.unique(np.frombuffer(b"".join(names), "V16"), return_index=True, return_inverse=True, return_counts=True)
                low = np.full(len(once), np.iinfo(np.int64).max)
                np.minimum.at(low, back, ids.take(pa.array(at)).to_numpy())
                size, names = points.shape[1], names[once]
                cell = np.array([pools.get((size, c), c) for c in cells.place(points[once])[0].tolist()])
                salt = (ranks(names) * np.array([salts.get((size, c), 1) for c in cell.tolist()])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([size] * len(once), pa.int32()), pa.array(cell), pa.array(salt), pa.array(names, pa.binary()), pa.array(low), pa.array(weight), pa.array([g.tobytes() for g in given[once]], pa.binary())],
                                                 ["size", "cell", "salt", "direction", "rep", "weight", "given"])

    return vectors.mapInArrow(tidy(run), "size int, cell long, salt int, direction binary, rep long, weight long, given binary")


BLOCK_SCHEMA = "size int, total long, centre array<double>, radius double, directions array<binary>, reps array<long>, weights array<long>, points binary, tree binary"


def built(rows: pd.DataFrame) -> pd.DataFrame:
    """One block: its cover tree and points."""
    rows = rows.groupby("direction", sort=True).agg({"size": "first", "rep": "min", "weight": "sum", "given": "first"}).reset_index()
    size = int(rows["size"].iloc[0])
    given = np.stack([_vectors(g, size)[0] for g in rows["given"]])
    tree, order = Tree.build(scaled(given))
    centre = tree.points.mean(axis=0)
    radius = float(np.sqrt(((tree.points - centre) ** 2).sum(axis=1)).max()) if len(given) > 1 else 0.0
    flat = np.stack([tree.start, tree.end, tree.radius, tree.child, tree.children]).astype(np.float64)
    return pd.DataFrame({"size": [size], "total": [rows["weight"].sum()], "centre": [centre], "radius": [radius], "directions": [rows["direction"].to_numpy()[order].tolist()], "reps": [rows["rep"].to_numpy()[order]],
                         "weights": [rows["weight"].to_numpy()[order]], "points": [given[order].tobytes()], "tree": [flat.tobytes()]})


def _vectors(given: bytes, size: int, n: int = 1) -> np.ndarray:
    """Vectors as they were given: floats, or doubles."""
    return np.frombuffer(given, np.float32 if len(given) == 4 * size * n else np.float64).reshape(n, size)


def compared(cosine: float, bases: dict):
    """Links within a block, or between two: count per node, and the smallest node it hangs together with."""

    def run(batches):
        kept = {}  # the last blocks, as trees

        def block(batch, k, end):
            at = batch.column(f"at{end}")[k].as_py()
            if at not in kept:
                if sum(t.points.nbytes for _, _, t in kept.values()) > KEPT_BYTES:
                    kept.clear()
                weights = batch.column(f"weights{end}")[k].values.to_numpy()
                flat = np.frombuffer(batch.column(f"tree{end}")[k].as_buffer(), np.float64).reshape(5, -1)
                points = scaled(_vectors(batch.column(f"points{end}")[k].as_buffer().to_pybytes(), batch.column("size")[k].as_py(), len(weights)))
                kept[at] = at, weights.copy(), Tree(*(flat[m].astype(np.int64) for m in (0, 1)), flat[2].copy(), *(flat[m].astype(np.int64) for m in (3, 4)), points)
            return kept[at]

        for batch in batches:
            for k in range(batch.num_rows):
                sides = [block(batch, k, end) for end in ("", "_2") if f"at{end}" in batch.schema.names]
                nodes = np.concatenate([(at << 20) + np.arange(len(w)) for at, w, _ in sides])
                links = traverse(sides[0][2], sides[1][2] if len(sides) > 1 else None, np.concatenate([w for _, w, _ in sides]), cosine, bases.get(sides[0][2].points.shape[1]))
                some = links.count > 0
                if some.any():
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(links.count[some]), pa.array(nodes[links.label[some]])], ["node", "n", "other"])

    return tidy(run)


def doubled(df: DataFrame, shared: str = "") -> DataFrame:
    """The frame for the other side of a pair."""
    return df.select(*[F.col(c) if c == shared else F.col(c).alias(f"{c}_2") for c in df.columns])


GAP = "if(at = at_2, 0D, sqrt(aggregate(zip_with(centre, centre_2, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)))"


def bounds(reach: float) -> tuple[str, str]:
    """Conditions of two blocks: some members may link; all do."""
    return f"{GAP} <= radius + radius_2 + {reach + SAFE!r}D", f"{GAP} + radius + radius_2 <= {reach - SAFE!r}D"


def linked(blocks: DataFrame, pairs: DataFrame, cosine: float, bases: dict) -> DataFrame:
    """Links of the blocks that are not settled. Few pairs are joined; else all blocks stand beside all, read from
    their files again and again, each pair in one of its two orders."""
    reach = float(np.sqrt(2 - 2 * cosine))
    near, sure = bounds(reach)
    body = blocks.select("at", "weights", "points", "tree", "size")
    links = small_batches(blocks.filter(f"2 * radius > {reach - SAFE!r}D").select(body.columns)).mapInArrow(compared(cosine, bases), "node long, n long, other long")
    apart, n = pairs.filter("at <> at_2").count(), blocks.count()
    if not apart:
        return links
    if apart <= n // 2:
        pairs = few(pairs.filter("at <> at_2"))
        full = body.join(pairs, "at").join(doubled(body.drop("size")), "at_2")
    else:
        body = blocks.select(*body.columns, "centre", "radius", F.expr("(at + (at >> 20)) % 2").alias("odd"))
        turn = "at <> at_2 and (at < at_2) = (odd = odd_2)"
        full = body.join(doubled(body).hint("shuffle_replicate_nl"), F.expr(f"size = size_2 and {turn} and {near} and not ({sure})"))
    full = full.select("size", *[f"{c}{end}" for end in ("", "_2") for c in ("at", "weights", "points", "tree")])
    return links.unionByName(small_batches(full).mapInArrow(compared(cosine, bases), "node long, n long, other long"))


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Every vector (row) with n_links, component_id and kept."""
    reach = float(np.sqrt(2 - 2 * cosine))
    vectors = read(vectors, key, vector)
    cells = grown(vectors, vectors.count(), reach)
    blocks = placed(vectors, cells).groupBy("size", "cell", "salt").applyInPandas(built, BLOCK_SCHEMA).withColumn("at", F.monotonically_increasing_id())
    blocks = common.staged(blocks.withColumn("at", F.expr("(at >> 33 << 20) + (at & 8589934591)")), "blocks", wide=True)

    # pairs of blocks that may hold links, and those of which all members link
    head, n = blocks.select("at", "size", "total", "radius", "centre"), blocks.count()
    other = doubled(head, "size")
    near, sure = bounds(reach)
    met = head.repartition(parts(n * n, 65_536)).join(F.broadcast(other) if n <= HEADS else other.hint("shuffle_replicate_nl"), "size").filter("at <= at_2").filter(near)
    met = staged(met.select("at", "at_2", "total", "total_2", F.expr(sure).alias("sure")), "node-pairs")
    pairs, settled = staged(met.filter("not sure").select("at", "at_2"), "block-pairs"), met.filter("sure")
    found = staged(linked(blocks, pairs, cosine, cells.basis), "links")

    # what a block is linked with as a whole
    sides = settled.select("at", F.col("total_2").alias("with"), (F.col("at") == F.col("at_2")).cast("int").alias("own")).unionByName(
        settled.filter("at <> at_2").select(F.col("at_2").alias("at"), F.col("total").alias("with"), F.lit(0).alias("own")))
    above = few(staged(sides.groupBy("at").agg(F.sum("with").alias("with"), F.max("own").alias("own")), "settled"))
    points = blocks.select("at", F.posexplode(F.arrays_zip("directions", "reps", "weights"))).select(
        "at", F.expr("(at << 20) + pos").alias("node"), F.col("col.directions").alias("direction"), F.col("col.reps").alias("rep"), F.col("col.weights").alias("weight"))
    links = found.select(F.col("node").alias("a"), F.col("other").alias("b")).unionByName(settled.select(F.expr("at << 20").alias("a"), F.expr("at_2 << 20").alias("b"))).unionByName(
        points.join(above, "at", "left_semi").select(F.col("node").alias("a"), F.expr("at << 20").alias("b")))
    hung = few(staged(components(links).join(found.groupBy("node").agg(F.sum("n").alias("n")), "node", "left"), "hung"))

    # classes of one row without links need no further look
    total = F.col("weight") - 1 + F.coalesce("n", F.lit(0)) + F.coalesce("with", F.lit(0)) - F.coalesce("own", F.lit(0)) * F.col("weight")
    named = points.join(above, "at", "left").join(hung, "node", "left").filter("weight > 1 or component is not null")
    named = staged(named.select("direction", "rep", total.alias("n"), F.coalesce("component", "node").alias("part")), "named")
    low = named.groupBy("part").agg(F.min("rep").alias("low"))
    told = named.join(low, "part").groupBy("direction").agg(F.max("n").alias("n"), F.min("low").alias("low"))  # a direction on the border of two cells may stand in both
    out = directions(vectors).join(told, "direction", "left")
    valid = F.col("id").isNotNull()
    component = F.when(valid, F.coalesce("low", "id"))
    return out.select(F.col("id").alias(key), F.when(valid, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def op8_embedding_neardup(spark, sf_dir):
    """Near-duplicates among all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)
