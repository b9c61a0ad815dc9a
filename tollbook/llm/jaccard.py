"""N-gram Jaccard join with a token-group matrix.

Documents are sets of hashed word n-grams. Equal sets form a class; classes are joined.

1. *Where to look.* The hashes are cut into segments, more of them than two sets within the
   threshold can have differing hashes, so any two such sets agree on a whole segment that is
   not empty. Segments are keyed by the hash of all they hold; only keys that two classes
   share matter from then on. Sets meet at the size level of the smaller one; a set with too
   many empty segments is cut again with another seed (and at last its empty ones count too).
2. *Groups.* Of segments that the same classes share one is kept. Classes that share segments
   are one cluster; clusters are cut or put together to groups of a bounded size. A row of the
   matrix holds a group's token union, and where in it each member's tokens are.
3. *Bound and open.* First the members of each group are its queries. Then a class is a query for
   every other group that holds classes of another component, if it shares as many segments with them
   as two sets within the threshold must have alike (``least_shared``). Its
   overlap with the group's union bounds its overlap with any member; only where that reaches
   the threshold are the members' rows counted.

All comparisons are exact; components come out whole, without all pairs of a group.

Results by case: a document of fewer words than n is one n-gram of all its words; without
words or text it has an empty set and is linked with nothing; a null id gets a null component
and takes no part; rows of one id are one document, linked through each of their texts;
repeated rows get equal results; an empty table gives no rows; further columns are not read."""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollbook.llm.common import few, parts, slices, small_batches, staged, table, tidy
from tollbook.llm.components import components
from tollbook.llm.decontaminate import windows

WORDS_KEPT = 200_000
SLICE_BYTES = 1024 * 1024  # of text whose sets a worker holds at once
BLOCK_DOCS, BLOCK_KEYS = 16_384, 500_000
KEYS_PER_TASK = 1_000_000
GROUP_TOKENS, GROUP_QUERIES = 200_000, 1_000_000  # tokens of a group's members; tokens of the queries beside it in a task
LEVEL, SLACK, SEEDS = 1.5, 1.3, 4
U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit numbers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHashes(dict):
    """Hash of each word, kept up to a bound."""

    def __missing__(self, word):
        if len(self) > WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, n: int, words: WordHashes) -> np.ndarray:
    """The sorted distinct n-gram hashes of a text. Bytes split and lower-case by ASCII only."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    hashes = np.fromiter(map(words.__getitem__, found), U64, len(found))
    if 0 < len(hashes) < n:
        return mixed(windows(hashes, len(hashes)) + U64(len(hashes)))
    return np.unique(windows(hashes, n))


def set_key(tokens: np.ndarray) -> str:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).hexdigest()


def shingled(docs: DataFrame, key: str, text: str, n: int, percent: int | None = None) -> DataFrame:
    """Id, set size and key of every document, and for joins of ``percent`` the tokens and how many keys a link needs."""

    def run(batches):
        words = WordHashes()
        for batch in (part for whole in batches for part in slices(whole, "text", SLICE_BYTES)):
            sets = [shingles(x.as_py(), n, words) for x in batch.column(1)]
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.string())]
            if percent is not None:
                columns += [pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([least_shared(s, percent) if len(s) else 1 for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n", "set_key", "tokens", "need"][: len(columns)])

    return small_batches(docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))).mapInArrow(tidy(run), "doc long, n long, set_key string" + ", tokens binary, need long" * (percent is not None))


def least_size(size: int, percent: int) -> int:
    """The smallest set that a set of ``size`` can link with."""
    return max(1, -(-percent * size // 100))


def level_of(size: int) -> int:
    return int(log(size) / log(LEVEL) + 1e-9)


@lru_cache(None)
def segments_of(level: int, percent: int) -> tuple[int, int]:
    """Number of segments at a level, and in how many of them two linked sets can differ."""
    upper = ceil(LEVEL ** (level + 1))
    most = upper * (100 - percent) // percent
    return (ceil(most * SLACK) + 2 if most else 0), most


def segments(tokens: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The segment of every token."""
    return ((mixed(tokens + U64(2 * seed + 1)) >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def least_shared(tokens: np.ndarray, percent: int) -> int:
    """So many keys at least does a set share with any set that it links with: at the level at which they meet, its
    segments that are not empty less those that can differ. All sets are cut with the first seed; where that leaves too few segments it is 1."""
    size, least = len(tokens), None
    for level in range(level_of(least_size(size, percent)), level_of(size) + 1):
        n, most = segments_of(level, percent)
        if n:
            held = int((np.bincount(segments(tokens, n, 0), minlength=n) > 0).sum())
            least = min(max(1, held - most), least or size)
    return least or 1


def segment_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the segments of a set, at all levels at which it can meet another set."""
    size, out = len(tokens), []
    for level in range(level_of(least_size(size, percent)), level_of(size) + 1):
        n, most = segments_of(level, percent)
        if not n:
            continue  # only equal sets link here, and they are one class
        for seed in range(SEEDS):
            base = np.array([level * SEEDS + seed + 1], U64) * U64(0xD6E8FEB86659FD93)
            segment = segments(tokens, n, seed)
            order = np.argsort(segment, kind="stable")
            held, starts = np.unique(segment[order], return_index=True)
            content = np.add.reduceat(mixed(tokens[order]), starts)
            out.append(mixed(content ^ mixed(held.astype(U64) + base)))
            if len(held) > most:
                break
        else:  # too many empty segments with every seed
            out.append(mixed(np.setdiff1d(np.arange(n), held).astype(U64) + base + U64(1)))
    return np.concatenate(out) if out else np.zeros(0, U64)


def keys_per_token(percent: int) -> float:
    """About how many segment keys there are for each n-gram."""
    return 1.6 * SLACK * (100 - percent) / percent * (1 + log(100 / percent) / log(LEVEL))


class KeyBlock:
    """Segment keys of some documents, dealt to the tasks that will look for shared ones."""

    def __init__(self, tasks: int):
        self.tasks = tasks
        self.clear()

    def clear(self):
        self.docs, self.keys, self.seen, self.count = [], [], set(), 0

    def add(self, doc: int, tokens: np.ndarray, percent: int):
        own = set_key(tokens)
        if own in self.seen:  # one of its class stands for it
            return
        self.seen.add(own)
        keys = segment_keys(tokens, percent)
        self.docs.append(doc)
        self.keys.append(keys)
        self.count += len(keys)

    def full(self):
        return self.count >= BLOCK_KEYS or len(self.docs) >= BLOCK_DOCS

    def rows(self):
        """One packed row for each task. The first document with a key goes to the key's task;
        further ones are known to share it and are spread over all tasks, so no key is hot."""
        if self.count:
            keys = np.concatenate(self.keys)
            owner = np.repeat(np.arange(len(self.docs)), [len(k) for k in self.keys])
            docs, order = np.array(self.docs, np.int64), np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            first = np.append(True, keys[1:] != keys[:-1])
            again = np.append(~first[1:], False)  # the next document has the same key
            own_task = ((keys >> U64(32)) * U64(self.tasks) >> U64(32)).astype(np.int64)
            task = np.where(first, own_task, (mixed(keys + owner.astype(U64)) % U64(self.tasks)).astype(np.int64))
            order = np.lexsort((~first, task))
            for part in np.split(order, np.flatnonzero(np.diff(task[order])) + 1):
                used, local = np.unique(owner[part], return_inverse=True)
                arrays = (docs[used], keys[part], local.astype(np.uint16), again[part])
                yield pa.RecordBatch.from_pylist([{"task": int(task[part[0]]), "sizes": [len(used), len(part), int(first[part].sum())], "packed": zstandard.compress(b"".join(x.tobytes() for x in arrays), 1)}], PACKED)
        self.clear()


PACKED = pa.schema([("task", pa.int32()), ("sizes", pa.list_(pa.int32())), ("packed", pa.binary())])


def packed_keys(docs: DataFrame, key: str, text: str, n: int, percent: int, tasks: int) -> DataFrame:
    """Packed rows of the segment keys of all documents."""

    def run(batches):
        words, block = WordHashes(), KeyBlock(tasks)
        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if doc is not None and len(tokens := shingles(x.as_py(), n, words)):
                    block.add(doc, tokens, percent)
                if block.full():
                    yield from block.rows()
        yield from block.rows()

    return small_batches(docs.select(F.col(key).cast("long"), text)).mapInArrow(tidy(run), "task int, sizes array<int>, packed binary")


def shared_keys(batches):
    """Keys that several documents hold, with these documents: one task's share of all keys."""
    found = []
    for batch in batches:
        for (n_docs, n, lead), blob in zip(batch.column("sizes").to_pylist(), batch.column("packed").to_pylist()):
            raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
            own, keys, local, again = np.split(raw, np.cumsum([8 * n_docs, 8 * n, 2 * n]))
            found.append((keys.view(np.int64), own.view(np.int64)[local.view(np.uint16)], again.view(bool), np.arange(n) < lead))
    if found:
        keys, docs, shared, lead = (np.concatenate(x) for x in zip(*found))
        rest = ~lead
        known_keys, known_docs = keys[rest], docs[rest]
        keys, docs, shared = keys[lead], docs[lead], shared[lead]
        order = np.argsort(keys, kind="stable")
        keys, docs, shared = keys[order], docs[order], shared[order]
        same = keys[1:] == keys[:-1]
        shared = shared | np.append(same, False) | np.append(False, same)
        for at in range(0, max(len(known_keys), 1), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(known_keys[at: at + 100_000]), pa.array(known_docs[at: at + 100_000])], ["key", "doc"])
        yield pa.RecordBatch.from_arrays([pa.array(keys[shared]), pa.array(docs[shared])], ["key", "doc"])


def groups_of(shared: DataFrame) -> DataFrame:
    """Node and group of every node of ``shared`` (key, node, n).

    Nodes are similar if they share keys: the smallest node that a node shares one with names its
    cluster. Large clusters are cut, small ones put together, to groups of some GROUP_TOKENS."""
    lead = shared.groupBy("key").agg(F.min("node").alias("lead"))
    cluster = shared.join(lead, "key").groupBy("node").agg(F.min("lead").alias("cluster"), F.max("n").alias("n"))
    cluster = staged(cluster, "clusters")
    large = few(cluster.groupBy("cluster").agg(F.sum("n").alias("tokens")).filter(F.col("tokens") > GROUP_TOKENS))
    together = parts(cluster.select(F.sum("n")).first()[0], GROUP_TOKENS)
    own = F.concat_ws("-", F.lit("cluster"), "cluster", F.pmod(F.xxhash64("node"), F.expr(f"tokens div {GROUP_TOKENS} + 1")))
    mixed_group = F.concat_ws("-", F.lit("mixed"), F.pmod(F.xxhash64("cluster"), F.lit(together)))
    return cluster.join(large, "cluster", "left").select("node", F.when(F.col("tokens").isNull(), mixed_group).otherwise(own).alias("group"))


def token_group_matrix(members: DataFrame) -> DataFrame:
    """One row per group: its token union, and for each member its node, size and the places of
    its tokens in the union. ``members`` holds group, node and tokens."""

    def union(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        sets = [np.frombuffer(x, U64) for x in rows["tokens"].to_pylist()]
        every, places = np.unique(np.concatenate(sets), return_inverse=True)
        return pa.table({"group": rows["group"].slice(0, 1), "tokens_union": [every.tobytes()], "nodes": [rows["node"].to_pylist()], "sizes": [[len(s) for s in sets]],
                         "places": [places.astype(np.int32).tobytes()]})

    return members.groupBy("group").applyInArrow(union, "group string, tokens_union binary, nodes array<long>, sizes array<long>, places binary")


class Group:
    """A row of the matrix, and the links found with its members."""

    def __init__(self, tokens_union, nodes, sizes, places, percent):
        self.union, self.places, self.percent = np.frombuffer(tokens_union, U64), np.frombuffer(places, np.int32), percent
        self.nodes, self.sizes = np.asarray(nodes), np.asarray(sizes)
        self.starts, self.mark = np.cumsum(self.sizes) - self.sizes, np.zeros(len(self.union), np.int32)
        self.links, self.up = [], {}

    def root(self, node):
        while (up := self.up.get(node, node)) != node:
            node = up
        return node

    def ask(self, a: int, at: np.ndarray, size: int, only_after: bool):
        """Link a query, whose tokens are at these places of the union, with the members within
        the threshold: each link that joins what was not joined yet."""
        if 100 * len(at) < self.percent * size:
            return  # no member can overlap enough
        self.mark[at] = 1
        common = np.add.reduceat(self.mark[self.places], self.starts)
        self.mark[at] = 0
        good = 100 * common >= self.percent * (size + self.sizes - common)
        if only_after:
            good &= self.nodes > a
        for b in self.nodes[good].tolist():
            x, y = self.root(a), self.root(b)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                self.links.append((a, b))


def inside(matrix: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the members of each group."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                group = Group(row["tokens_union"], row["nodes"], row["sizes"], row["places"], percent)
                for a, start, size in zip(row["nodes"], group.starts, group.sizes):
                    group.ask(a, group.places[start: start + size], int(size), True)
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in group.links], pa.int64()), pa.array([b for _, b in group.links], pa.int64())], ["a", "b"])

    return matrix.mapInArrow(tidy(run), "a long, b long")


def opened(queries: DataFrame, matrix: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of queries (node a, group, tokens) with members of these groups. Queries of
    one group are dealt over several tasks by their number of tokens."""
    salts = queries.groupBy("group").agg((F.expr(f"sum(octet_length(tokens)) div {8 * GROUP_QUERIES}") + 1).cast("int").alias("salts"))
    asked = queries.join(few(salts), "group").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int")).drop("salts")
    held = matrix.join(few(salts), "group").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def bound_and_open(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        for row in held.to_pylist():
            group = Group(row["tokens_union"], row["nodes"], row["sizes"], row["places"], percent)
            for a, tokens in zip(asked["a"].to_pylist(), asked["tokens"]):
                query = np.frombuffer(tokens.as_py(), U64)
                at = np.searchsorted(group.union, query)
                at[at == len(group.union)] = 0
                group.ask(a, at[group.union[at] == query], len(query), False)
            out += group.links
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return asked.groupBy("group", "salt").cogroup(held.groupBy("group", "salt")).applyInArrow(bound_and_open, "a long, b long")


def jaccard_components(docs: DataFrame, n: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document (row) with n_shingles and component_id, under links of a Jaccard similarity of ``percent`` / 100 or more."""
    source = docs.select(F.col(key).cast("long").alias(key), text)
    rows = staged(shingled(source, key, text, n), "shingle-rows")
    nodes = rows.filter("doc is not null and set_key is not null")
    classes = staged(nodes.groupBy("set_key").agg(F.min("doc").alias("rep"), F.first("n").alias("n")), "classes")
    tasks = parts(int((classes.select(F.sum("n")).first()[0] or 0) * keys_per_token(percent)), KEYS_PER_TASK)
    packed = packed_keys(source, key, text, n, percent, tasks).repartitionById(tasks, F.col("task"))
    own_class = nodes.select("doc", "set_key").distinct()
    named = own_class.join(classes, "set_key").select("doc", F.col("rep").alias("node"), "n")
    shared = packed.mapInArrow(tidy(shared_keys), "key long, doc long").join(few(named), "doc")
    shared = staged(shared.groupBy("key", "node").agg(F.max("n").alias("n")), "shared-keys")
    # of keys that the same nodes share one is enough, with their number
    who = shared.groupBy("key").agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("y"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    shared = staged(shared.join(few(who.groupBy("x", "y", "many").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("weight")).select("key", "weight")), "key"), "shared")
    wanted = few(shared.select(F.col("node").alias(key)).distinct())
    sets = staged(shingled(source.join(wanted, key), key, text, n, percent).filter("n > 0").select(F.col("doc").alias("node"), "n", "tokens", "need"), "sets")

    # classes of one id are one document
    links = own_class.join(classes, "set_key").groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("a", "b")
    links = staged(links.union(own_class.join(classes, "set_key").filter("doc <> rep").join(own_class.groupBy("doc").count().filter("count > 1"), "doc").select("rep", "doc")), "links")
    groups = staged(groups_of(shared), "groups")
    matrix = staged(token_group_matrix(sets.select("node", "tokens").join(few(groups), "node")), "matrix", wide=True)
    links = links.union(staged(inside(matrix, percent), "links"))
    parts_of = components(links)

    # what is left: nodes that share a key but are in different parts and groups
    placed = shared.join(parts_of, "node", "left").select("key", "weight", "node", F.coalesce("component", "node").alias("part")).join(few(groups), "node")
    ranges = placed.groupBy("key", "group").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    listed = ranges.groupBy("key").agg(F.collect_list(F.struct("group", "low", "high")).alias("met")).filter("size(met) > 1")
    # a query meets the groups after its own; the groups of a key are listed once, not once per node
    asked = placed.select("key", "weight", F.col("node").alias("a"), "part", F.col("group").alias("own")).join(listed, "key")
    met = F.expr("transform(filter(met, g -> g.group > own and not (g.low = part and g.high = part)), g -> g.group)")
    asked = asked.select("a", "weight", met.alias("met")).filter("size(met) > 0").groupBy("a", "met").agg(F.sum("weight").alias("weight"))
    # a node that shares fewer keys with a whole group than with anything it links with is no query for it
    asked = asked.groupBy("a").agg(F.collect_list(F.struct("met", "weight")).alias("keys")).join(sets.select(F.col("node").alias("a"), "need"), "a")
    enough = "filter(array_distinct(flatten(keys.met)), g -> aggregate(keys, 0L, (s, k) -> s + if(array_contains(k.met, g), k.weight, 0L)) >= need)"
    queries = asked.select("a", F.explode(F.expr(enough)).alias("group"))
    queries = staged(queries, "queries")
    found = opened(sets.select(F.col("node").alias("a"), "tokens").join(few(queries), "a"), matrix, percent)
    parts_of = components(links.union(staged(found, "links")))

    placed = rows.join(classes.select("set_key", "rep"), "set_key", "left").join(parts_of, F.col("rep") == F.col("node"), "left")
    return placed.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component", "rep", "doc")).alias("component_id"))


def op3_jaccard_join(spark, sf_dir):
    """Components of documents with a Jaccard similarity of 0.9 or more over three-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90)
