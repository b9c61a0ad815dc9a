"""Quality classifier: an additive model with pairwise interactions over measures of a text.

Each measure is cut into bins at quantiles. Boosting goes round the measures; in each step a
shallow tree over the bins of one measure fits what is still wrong, and its leaves are added
to that measure's lookup table. Pairs of measures with the most left to explain get tables of
two dimensions in the same way. A score is a sum of table entries, added for whole batches.

The model is fitted on a bounded sample of labelled rows (``MAX_ROWS``, those with the lowest
hash of the id) of the training fold. Labels, language, source and id are no inputs.

Results by case: a null text is scored as an empty one; labels with null quality or id are
left out; repeated labels of a document all count; without any label all scores are 0.5;
repeated rows are scored row by row; an empty table gives no rows; columns that are not kept
are not read, a kept one named like the result is replaced."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollbook.llm.common import free_name, small_batches, table, tidy

MAX_ROWS = 20_000
THRESHOLD = 0.3
BINS, ROUNDS, LEAVES, RATE, RIDGE = 32, 60, 4, 0.15, 2.0
PAIRS, PAIR_ROUNDS = 6, 30
MEASURES = ["log_bytes", "letters", "capitals", "digits", "exclamation", "symbols", "bars", "stops", "line_ends", "word_length", "repeated_next", "distinct_words", "top_word", "repeated_lines"]
SYMBOLS = b"#$%&*@^~=<>{}[]\\_+"


def measures(text: str) -> list[float]:
    """The measures of one whole text."""
    raw = text.encode("utf-8", "replace")
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(len(raw), 1)
    upper, lower, wide = n[65:91].sum(), n[97:123].sum(), n[128:].sum()
    words = text.split()
    count = max(len(words), 1)
    distinct = Counter(words)
    lines = text.split("\n")
    return [
        float(np.log1p(len(raw))), (upper + lower + wide) / size, upper / max(upper + lower, 1), n[48:58].sum() / size, n[33] / size,
        sum(n[b] for b in SYMBOLS) / size, n[124] / size, (n[44] + n[46]) / size, n[10] / size, (size - n[32] - n[10]) / count,
        sum(map(str.__eq__, words, words[1:])) / count, len(distinct) / count, max(distinct.values(), default=0) / count, 1 - len(set(lines)) / len(lines)]


def fold(key: Column) -> Column:
    """Held-out documents: checksum of the id's text divisible by five."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for f, t in enumerate(self.tables):
            total += t[b[:, f]]
        for i, j, t in self.pairs:
            total += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-total))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = left_g**2 / (left_h + RIDGE) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf value of each bin by a tree with few leaves."""
    leaves = [(0, len(g))]
    while len(leaves) < LEAVES:
        gain, at, k = max((*_best_cut(g[a:b], h[a:b]), k) for k, (a, b) in enumerate(leaves))
        if gain <= 1e-9:
            break
        a, b = leaves[k]
        leaves[k: k + 1] = [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values of a grid: one cut of the first measure, then one of the second on each side,
    of all first cuts the one that leaves the least to explain."""
    def sides(at):
        parts = [(part, g[part].sum(0), h[part].sum(0)) for part in (slice(0, at), slice(at, None))]
        cuts = [(part, *_best_cut(x, y), x.sum() ** 2 / (y.sum() + RIDGE)) for part, x, y in parts]
        return sum(gain + own for _, gain, _, own in cuts), [(part, cut) for part, _, cut, _ in cuts]

    out = np.zeros_like(g)
    for part, cut in max((sides(at) for at in range(1, len(g))), key=lambda x: x[0], default=(0, [(slice(None), 0)]))[1]:
        for side in (slice(0, cut), slice(cut, None)):
            out[part, side] = g[part, side].sum() / (h[part, side].sum() + RIDGE)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of single measures, then of pairs."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(len(MEASURES))]
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    model = Model(edges, base, [np.zeros(len(e) + 1) for e in edges], [])
    if not len(x):
        return model
    b, total = model.bins(x), np.full(len(x), base)
    sizes = [len(e) + 1 for e in edges]

    def left():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, size in enumerate(sizes):
            g, h = left()
            step = RATE * _tree(np.bincount(b[:, f], g, size), np.bincount(b[:, f], h, size))
            model.tables[f] += step
            total += step[b[:, f]]
    grid = lambda i, j, v: np.bincount(b[:, i] * sizes[j] + b[:, j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])
    g, h = left()
    gains = sorted(((float((grid(i, j, g) ** 2 / (grid(i, j, h) + RIDGE)).sum()), i, j) for i in range(len(sizes)) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for _, i, j in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in model.pairs:
            g, h = left()
            step = RATE * _pair_tree(grid(i, j, g), grid(i, j, h))
            t += step
            total += step[b[:, i], b[:, j]]
    return model


def measured(docs: DataFrame, text: str, keep: list[str], then=None, name: str = "measures", kind=None) -> DataFrame:
    """Kept columns and the measures of the text, or what ``then`` makes of a batch of them."""
    keep = [c for c in keep if c.lower() != name.lower()]
    arrow = pa.list_(pa.float64()) if then is None else pa.float64()
    sent = [docs[c] for c in keep] + ([] if text in keep else [docs[text].alias(free_name(docs, "_text"))])  # a text that is kept is sent once
    at = keep.index(text) if text in keep else len(keep)

    def run(batches):
        for batch in batches:
            rows = [measures(x.as_py() or "") for x in batch.column(at)]
            values = rows if then is None else then(np.array(rows, float).reshape(-1, len(MEASURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(values, arrow)], [*keep, name])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, kind or T.ArrayType(T.DoubleType()))])
    return small_batches(docs.select(*sent)).mapInArrow(tidy(run), schema)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``max_rows`` labels of the training fold."""
    rows = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~fold(F.col(key))).select(F.col(key), F.col(label).cast("double").alias("_label"))
    sample = rows.orderBy(F.xxhash64(key), "_label").limit(max_rows)
    found = measured(docs.select(key, text).join(F.broadcast(sample), key), text, ["_label"]).toPandas()
    order = sorted(range(len(found)), key=lambda i: (found["_label"][i], *found["measures"][i]))  # the same model whatever the order of rows
    return fit(np.array([found["measures"][i] for i in order], float).reshape(-1, len(MEASURES)), found["_label"].to_numpy(float)[order])


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """Kept columns and the score of every document."""
    return measured(docs, text, keep, model.score, name, T.DoubleType())


def op4_quality_classifier(spark, sf_dir):
    """Score of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
