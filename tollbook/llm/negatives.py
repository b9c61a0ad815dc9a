"""Hard-negative mining by a vertical scan with branch and bound (BOND).

Components become whole numbers, so that scores (inner products) are exact. Rows are put in
order of label and cut into blocks of a bounded number of rows, each stored by dimension with the smallest
and largest value of every dimension. Anchors are put into tiles the same way, and every tile meets the
blocks it can find something in: a stated set of queries against all rows, block by block.

In a block each anchor reads the dimensions in descending order of its own magnitudes. What the
dimensions not yet read can still add lies between bounds given by the smallest and largest values;
after every few dimensions the candidates whose bounds rule them out leave the bitmap:

1. ``positives``: same label, and the best of each anchor; a candidate leaves when its upper
   bound is under the k-th best lower bound.
2. ``negatives``: other labels, scores inside the window of a positive; a candidate leaves when
   for every window it must lie outside, or k others that must lie inside are surely better.

Blocks give at most k rows for each anchor (and positive); these are merged by a ranking whose partial
step runs before the exchange. Blocks that cannot hold the label (step 1) or hold nothing but it (step 2) are not read.

Results by case: rows with a null id, label or vector, or with a null or non-finite component,
take no part; a row is one vector, also if its id or all of it is repeated, and is no positive of itself
alone; equal scores are ordered by the smaller id; vectors of different lengths do not
meet; an empty vector scores 0; components are held to +-2^27 after scaling, so that scores fit a
long; a positive with a negative score has no window; an anchor without positives, or a positive
without negatives, gives no row; an empty table gives no rows; further columns are not read."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollbook.llm.common import parts, small_batches, staged, table
from tollbook.operators.numbering import numbered

BLOCK, TILE = 2048, 16384  # rows of a block; rows that the anchors of one tile are taken from
STEP = 8  # dimensions read between two looks at the bounds
PAIRS, MOST_TASKS = 4, 20_000  # tile and block pairs of a task; tasks at most
LARGEST = 1 << 27


def whole_numbers(vectors: DataFrame, scale: int, key: str, label: str, vector: str) -> DataFrame:
    """Id, label, length and whole-number components of the rows that take part, numbered in order of label."""
    value = F.col(vector)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    held = lambda x: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), F.floor(F.least(F.abs(x), F.lit(1e15)) * F.signum(x) * scale).cast("double"))).cast("int")
    rows = vectors.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & value.isNotNull() & finite)
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.size(value).alias("size"), F.transform(value, lambda x: held(x.cast("double"))).alias("codes"))
    return numbered(rows, ["size", "label", "id"], "row_no")


BLOCK_SCHEMA = "size int, part long, first long, last long, ids array<long>, rows array<long>, labels array<long>, codes binary"


def gathered(rows: pd.DataFrame) -> pd.DataFrame:
    """One block or tile: its rows in order of label, components stored by dimension."""
    rows = rows.sort_values("row_no")
    codes = np.array([np.asarray(c, np.int32) for c in rows["codes"]], np.int32).reshape(len(rows), -1)
    labels = rows["label"].to_numpy(np.int64)
    return pd.DataFrame({"size": [rows["size"].iloc[0]], "part": [rows["part"].iloc[0]], "first": [labels[0]], "last": [labels[-1]], "ids": [rows["id"].to_numpy(np.int64)],
                         "rows": [rows["row_no"].to_numpy(np.int64)], "labels": [labels], "codes": [np.ascontiguousarray(codes.T).tobytes()]})


def cut(rows: DataFrame, each: int, label: str) -> DataFrame:
    """Rows gathered by their numbers, ``each`` numbers to a part."""
    numbered_parts = rows.withColumn("part", F.expr(f"(row_no - 1) div {each}"))
    return staged(small_batches(numbered_parts).groupBy("size", "part").applyInPandas(gathered, BLOCK_SCHEMA), label)


def scan(anchor: np.ndarray, columns: np.ndarray, least: np.ndarray, most: np.ndarray, bitmap: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
    """Places left of the bitmap, with their exact scores. ``keep`` tells from lower and upper bounds of scores who stays."""
    order = np.argsort(-np.abs(anchor), kind="stable")
    ends = np.stack([anchor * least, anchor * most])[:, order]
    low, high = (np.concatenate([np.cumsum(x[::-1])[::-1], [0]]) for x in (ends.min(axis=0), ends.max(axis=0)))
    left = np.flatnonzero(bitmap)
    scores = np.zeros(len(left), columns.dtype)
    for at in range(0, len(order), STEP):
        dims = order[at: at + STEP]
        scores = scores + anchor[dims] @ (columns[dims] if len(left) == len(bitmap) else columns[np.ix_(dims, left)])
        done = min(at + STEP, len(order))
        good = keep(scores + low[done], scores + high[done])
        if not good.all():
            left, scores = left[good], scores[good]
        if not len(left):
            break
    return left, scores.astype(np.int64)


def best_of(k: int):
    """Keeps those that may be among the k best."""
    def keep(low, high):
        if len(low) <= k:
            return np.ones(len(low), bool)
        return high >= np.partition(low, len(low) - k)[len(low) - k]

    return keep


def inside(windows: list[tuple[int, int]], k: int):
    """Keeps those that may be among the k best inside one of the windows."""
    def keep(low, high):
        good = np.zeros(len(low), bool)
        for least, most in windows:
            sure = low[(low >= least) & (high <= most)]
            line = max(least, np.partition(sure, len(sure) - k)[len(sure) - k]) if len(sure) >= k else least
            good |= (high >= line) & (low <= most)
        return good

    return keep


def ranked(scores, ids, rows, k):
    """Places of the k best: higher scores first, then smaller ids."""
    return np.lexsort((rows, ids, -scores))[:k]


class Part:
    """A block or a tile as arrays."""

    def __init__(self, row: dict, tail: str = ""):
        self.ids, self.rows, self.labels = (np.array(row[name + tail], np.int64) for name in ("ids", "rows", "labels"))
        self.columns = np.frombuffer(row["codes" + tail], np.int32).reshape(row["size"], len(self.ids))

    def of(self, label: int) -> slice:
        """The rows of a label, which stand together."""
        return slice(*(int(np.searchsorted(self.labels, label, side)) for side in ("left", "right")))


def exact_kind(tile: Part, block: Part):
    """The number type in which all scores are exact; doubles where they are, as they multiply faster."""
    bound = len(tile.columns) * int(np.abs(tile.columns).max(initial=0)) * int(np.abs(block.columns).max(initial=0))
    return np.float64 if bound < 1 << 53 else np.int64


FOUND = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("place", pa.int32()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
FOUND_SCHEMA = "anchor long, anchor_id long, place int, row long, id long, score long"


def searched(k: int, windowed: bool):
    """Best rows of a block for each anchor of a tile, or for each window of each anchor."""

    def run(batches):
        for batch in batches:
            for row in (batch.slice(n, 1).to_pylist()[0] for n in range(batch.num_rows)):
                tile, block = Part(row, "_2"), Part(row)
                kind, out = exact_kind(tile, block), []
                anchors, columns = tile.columns.astype(kind), block.columns.astype(kind)
                least, most = columns.min(axis=1), columns.max(axis=1)
                windows: dict[int, list] = {}
                for at, place, low, high in zip(*(row[c] or [] for c in ("w_anchor", "w_place", "w_low", "w_high"))) if windowed else ():
                    windows.setdefault(at, []).append((place, low, high))
                for n, (own, own_id, label) in enumerate(zip(tile.rows.tolist(), tile.ids.tolist(), tile.labels.tolist())):
                    same = block.of(label)
                    bitmap = np.full(len(block.ids), windowed)
                    bitmap[same] = not windowed
                    if windowed:
                        if own not in windows:
                            continue
                        left, scores = scan(anchors[:, n], columns, least, most, bitmap, inside([w[1:] for w in windows[own]], k))
                        wanted = [(place, (scores >= low) & (scores <= high)) for place, low, high in windows[own]]
                    else:
                        bitmap &= block.rows != own
                        left, scores = scan(anchors[:, n], columns, least, most, bitmap, best_of(k))
                        wanted = [(0, np.ones(len(left), bool))]
                    for place, good in wanted:
                        some, points = left[good], scores[good]
                        top = ranked(points, block.ids[some], block.rows[some], k)
                        out += [(own, own_id, place, block.rows[some[t]], block.ids[some[t]], points[t]) for t in top]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * len(FOUND), FOUND)], schema=FOUND)

    return run


def met(tiles: DataFrame, blocks: DataFrame, wanted: str) -> DataFrame:
    """Every tile beside each block it has to look at, spread over tasks."""
    head = tiles.select("size", F.col("part").alias("part_2"), F.col("first").alias("first_2"), F.col("last").alias("last_2"))
    pairs = staged(head.join(blocks.select("size", "part", "first", "last"), "size").filter(wanted).select("size", "part", "part_2"), "tile-pairs")
    body = tiles.select("size", *[F.col(c).alias(f"{c}_2") for c in ("part", "ids", "rows", "labels", "codes")], *[c for c in tiles.columns if c.startswith("w_")])
    tasks = min(MOST_TASKS, parts(pairs.count(), PAIRS))
    return small_batches(pairs.join(blocks.drop("first", "last"), ["size", "part"]).join(body, ["size", "part_2"]).repartition(tasks, "part", "part_2"))


def top(found: DataFrame, k: int, name: str) -> DataFrame:
    """The k best of all blocks, ranked from 1."""
    best = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id", "row")
    return found.withColumn(name, F.row_number().over(best)).filter(F.col(name) <= k)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
                   key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """For every anchor (``anchors`` is a condition on ``id``) and each of its best rows of its label, the best
    rows of other labels that score between ``low`` and ``high`` percent of the positive."""
    rows = whole_numbers(vectors, scale, key, label, vector)
    blocks = cut(rows, BLOCK, "negative-blocks")
    tiles = cut(rows.filter(anchors), TILE, "anchor-tiles")

    near = met(tiles, blocks, "first_2 <= last and last_2 >= first").mapInArrow(searched(positives, False), FOUND_SCHEMA)
    best = staged(top(near, positives, "nth").select("anchor", "anchor_id", F.col("nth").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # whole scores between the percentages: the lower end rounded up, the upper one down
    ends = best.filter("positive_score >= 0").select("anchor", "place", F.expr(f"({low} * positive_score + 99) div 100").alias("least"), F.expr(f"({high} * positive_score) div 100").alias("most"))
    size_of = rows.filter(anchors).select(F.col("row_no").alias("anchor"), "size")
    windows = ends.join(size_of, "anchor").groupBy("size", F.expr(f"(anchor - 1) div {TILE}").alias("part")).agg(F.sort_array(F.collect_list(F.struct("anchor", "place", "least", "most"))).alias("w"))
    windows = windows.select("size", "part", *[F.expr(f"w.{c}").alias(f"w_{n}") for c, n in (("anchor", "anchor"), ("place", "place"), ("least", "low"), ("most", "high"))])
    armed = staged(tiles.join(windows, ["size", "part"]), "armed-tiles")
    hard = met(armed, blocks, "not (first = last and first_2 = last_2 and first = first_2)").mapInArrow(searched(negatives, True), FOUND_SCHEMA)
    ranked_rows = top(hard, negatives, "rank").select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return best.join(ranked_rows, ["anchor", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir):
    """Hard negatives of every 50th embedding; every seventh one's label is moved on by one first."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end").alias("label"), "embedding")
    return hard_negatives(vectors, F.expr("id % 50 = 0"))


OP11_SQL = """
with numbered as (
  select row_number() over () as row_no, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, embedding
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x::double)]) = 0),
coded as (select row_no, vec_id, label, [floor(256 * x::double)::double for x in embedding] as codes from numbered),
scored as (
  select a.row_no as anchor, a.vec_id as anchor_id, r.row_no, r.vec_id, a.label = r.label as same, cast(list_dot_product(a.codes, r.codes) as bigint) as score
  from coded a join coded r on a.row_no <> r.row_no and len(a.codes) = len(r.codes) and a.vec_id % 50 = 0),
positives as (
  select anchor, anchor_id, place, vec_id as positive_id, score as positive_score
  from (select *, row_number() over (partition by anchor order by score desc, vec_id, row_no) as place from scored where same) where place <= 5),
ranked as (
  select p.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor, p.place order by s.score desc, s.vec_id, s.row_no) as rank
  from positives p join scored s on s.anchor = p.anchor and not s.same and 100 * s.score between 50 * p.positive_score and 95 * p.positive_score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from ranked where rank <= 3
"""
