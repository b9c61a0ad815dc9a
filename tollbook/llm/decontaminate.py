"""Benchmark decontamination by templates.

Numbers, names and units become typed slots; what is left of a text is its template. Windows
of the benchmark's templates are hashed; the windows of every document are looked up among
them (a hash join whose benchmark side is sent to the tasks in slices of a fixed size). Where
windows meet, document and item are laid over each other and the meeting windows are grown to
stretches, runs of words that match. A stretch's slots must be filled consistently (one filler
of the item, one filler of the document); of one that is not, up to ``SHORT`` words from a
changed slot to an end may be left out, as text beside a passage can match by accident, and else
only its runs of ``VERBATIM`` or more equal words count. So a question with other numbers or names is still found.

A word is a run of non-space characters without the punctuation around it, lower-cased. A
number is digits with separators, a unit is a word of the list after a number or glued to it,
a name is a capitalised word. This list of units is short and number words are plain words, which is the weakest part
of the method. Whether a word is a name cannot always be told by its case, so
windows are hashed and looked up in three readings: names are plain words (a copy in other case
still meets), capitalised words are names inside a sentence, and also at its begin unless they
are ``COMMON`` words. In a stretch equal words match whatever their case.

The stretches of an item are added up, however they are shifted, each word of the item once.
A document holds an item when ``ENOUGH`` words of it are equal, or ``SHARE`` of it if that is
less. It also holds an item that is laid over it at one shift with consistent slots throughout
and ``SHARE`` of equal words, in stretches or not. Items shorter than a window are looked up as one window of their
length; those of fewer than ``SHORT`` words only count when the document holds nothing else.

Results by case: null and empty texts hold nothing; items without words are left out; equal
items and repeated rows are all reported; null ids are kept; an empty documents or benchmark
table gives no leaks; input columns named like the result column are replaced."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollbook.llm.common import free_name, parts, small_batches, staged, table, tidy

WINDOW, SHARE, SHORT = 8, 0.5, 5
ENOUGH, VERBATIM = 13, 26  # equal words of an item of any length; such that count in a row although other slots conflict
SLICE_WORDS = 400_000  # words of the benchmark that tasks hold at once
WORDS_KEPT = 100_000
UNITS = {
    "mm", "cm", "m", "km", "inch", "inches", "ft", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "lb", "lbs", "oz", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "dollar", "dollars", "euro", "euros", "cent", "cents", "usd", "eur", "percent", "%", "degrees", "°c", "°f", "mph", "kmh", "km/h", "w", "kw", "v", "hz",
}
COMMON = frozenset("""
a about after all also although an and another any are as at because before both but by can could do does did each either every few find for from give given had has have he her here his how however
i if in is it its let many most must my name no not now of on one only or our over she should show since so some such than that the their then there these they this those though through thus to
two under until up was we were what when where which while who whom whose why will with without would write yet you your
aber alle als also am an auch auf aus bei beim bis da dabei damit dann das dass dein dem den der des die dies diese dieser dieses doch durch ein eine einem einen einer eines er es für gegen hat
ich ihr im in ist ja jede jeder jedes kann kein keine man mehr mein mit nach nicht noch nun nur ob oder ohne sein seine seit sich sie sind so über um und uns unter viele vom von vor wann war warum
was weil welche welcher wenn wer werden wie wieviel wir wird wo zu zum zur
à après au aussi aux avant avec c ce cela ces cet cette chaque comme comment combien d dans de depuis des donc du elle elles en est et était ici il ils j je l la le les leur lors mais même mon ne nous
on ou où par pas pendant plus pour pourquoi puis qu quand que quel quelle quels qui s sa sans se ses si son sont sous sur tous tout toute très tu un une vers vous
a al ante antes así aunque cada como cómo con cual cuál cuando cuándo cuánto cuántos de del desde después donde dónde dos el él ella ellas ellos en entonces entre era es esa ese eso esta este esto
fue ha hasta hay la las le lo los más mi mientras muy no nos o para pero por porque pues qué que quién se según ser si sí sin sobre son su sus también tan todo todos un una uno y ya yo
""".split())
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*")
GLUED = re.compile(r"([$€£]?[+-]?\d[\d.,:/]*)([^\W\d].*|%)", re.S)
PLAIN, NUM, UNIT, NAME = range(4)
SLOT_HASH = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
STEP = np.uint64(0x9FB21C651E98DF25)
LEAK = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("equal_words", T.IntegerType()), T.StructField("item_words", T.IntegerType()), T.StructField("changed_slots", T.IntegerType())]))
ARROW_LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("equal_words", pa.int32()), ("item_words", pa.int32()), ("changed_slots", pa.int32())]))


class Lexicon(dict):
    """Places of the facts on each distinct run of characters, kept up to a bound."""

    def __init__(self):
        self.facts, self.new = np.zeros((1024, 5), np.uint64), []  # hash, kind, capitalised (2: and not common), ends a sentence, has a word

    def __missing__(self, run: str) -> int:
        self[run] = at = len(self)
        self.new.append(self.fact(run))
        return at

    def look(self, text: str) -> np.ndarray:
        """Rows of facts for the runs of a text."""
        if len(self) > WORDS_KEPT:
            self.clear()
        at = np.fromiter(map(self.__getitem__, text.split()), np.int64)
        if self.new:
            while len(self) > len(self.facts):
                self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
            self.facts[len(self) - len(self.new): len(self)] = np.array(self.new, np.uint64)
            self.new = []
        return self.facts[at]

    @staticmethod
    def fact(run: str) -> tuple[int, int, int, int, int]:
        if letters := run.isalpha():
            bare = run
        else:
            bare = EDGE.sub("", run)
            letters = bare.isalpha()
        sign = run[:1] if run[:1] in "$€£" else ""
        low = (bare or ("%" if run == "%" else "")).lower()
        kind = PLAIN
        if letters:  # no number can match
            kind = UNIT if low in UNITS else PLAIN
        elif NUMBER.fullmatch(bare) or (m := GLUED.fullmatch(bare)) and m[2].lower() in UNITS or bare.isdigit():
            kind = NUM
        elif low in UNITS:
            kind = UNIT
        ends = run.rstrip("\"')]»”’")[-1:] in ".!?:…"
        title = 0 if not (letters and bare.istitle()) else 1 if low in COMMON else 2
        return xxhash.xxh64_intdigest((sign + (low if low.isascii() else low.casefold())).encode("utf-8", "replace")), kind, title, ends, bool(low)


def template(facts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, kinds and template hashes of the words of a text."""
    starts = np.ones(len(facts), bool)
    starts[1:] = facts[:-1, 3] > 0
    facts, starts = facts[facts[:, 4] > 0], starts[facts[:, 4] > 0]
    kinds = facts[:, 1].astype(np.int64)
    after = np.zeros(len(facts), bool)
    after[1:] = kinds[:-1] == NUM
    kinds[(kinds == UNIT) & ~after] = PLAIN
    kinds[(kinds == PLAIN) & (facts[:, 2] > 0) & ~starts] = NAME
    return facts[:, 0], kinds, np.where(kinds == PLAIN, facts[:, 0], SLOT_HASH[kinds])


def readings(facts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Word hashes and kinds, names at sentence begins included, of the words of a text, and its templates:
    names inside sentences are slots, no names are, all names are."""
    words, kinds, shape = template(facts)
    wide = kinds.copy()
    wide[(kinds == PLAIN) & (facts[facts[:, 4] > 0, 2] > 1)] = NAME
    return words, wide, [shape, np.where(kinds == NAME, words, shape), np.where(wide == NAME, SLOT_HASH[NAME], shape)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of STEP and of its inverse."""
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, x, np.uint64))]) for x in (STEP, np.uint64(pow(int(STEP), -1, 1 << 64))))


POWERS = powers(1 << 15)


def windows(shape: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of a template: the sum of its words times the powers of STEP."""
    n = len(shape) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = POWERS if len(shape) < len(POWERS[0]) else powers(len(shape))
    sums = np.zeros(len(shape) + 1, np.uint64)
    np.cumsum(shape * up[: len(shape)], out=sums[1:])
    return (sums[size:] - sums[:-size]) * down[:n]


def placed(shapes: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of every window of some templates of one text, each hash once at a place."""
    first = windows(shapes[0], size)
    places, hashes = [np.arange(len(first))], [first]
    for shape in shapes[1:]:
        other = windows(shape, size)
        at = np.flatnonzero(other != first)
        places.append(at)
        hashes.append(other[at])
    return np.concatenate(places), np.concatenate(hashes)


def consistent(theirs: np.ndarray, mine: np.ndarray) -> bool:
    """Whether every word of the item has one filler."""
    fillers: dict[int, int] = {}
    return all(fillers.setdefault(t, m) == m for t, m in zip(theirs.tolist(), mine.tolist()))


def runs(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Begin and end of each run of at least ``least`` places that hold."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    return [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= least]


def stretches(theirs: np.ndarray, mine: np.ndarray, same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Begin and end of the stretches of two texts laid over each other."""
    out = []
    for a, b in runs(same, least):
        cuts = ((a + front, b - cut + front) for cut in range(SHORT + 1) for front in range(cut + 1) if b - a - cut >= least)
        whole = next(((x, y) for x, y in cuts if (x == a or theirs[x - 1] != mine[x - 1]) and (y == b or theirs[y] != mine[y]) and consistent(theirs[x:y], mine[x:y])), None)
        out += [whole] if whole else [(a + x, a + y) for x, y in runs(theirs[a:b] == mine[a:b], VERBATIM)]
    return out


class Benchmark:
    """Templates of some items and their windows, by window size."""

    def __init__(self, items):
        lexicon = Lexicon()
        self.items = [(key, *readings(lexicon.look(text))) for key, text in items]
        self.items = [x for x in self.items if len(x[1])]
        found: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for i, (_, words, _, shapes) in enumerate(self.items):
            size = min(WINDOW, len(words))
            for at, h in zip(*(x.tolist() for x in placed(shapes, size))):
                found[size][h].append((i, at))
        self.places = {size: dict(x) for size, x in found.items()}
        self.marks = {size: self.marked(np.fromiter(x, np.uint64)) for size, x in self.places.items()}

    @staticmethod
    def marked(hashes: np.ndarray) -> np.ndarray:
        """A table of bits that holds every hash's upper bits: most windows of a document end here."""
        out = np.zeros(1 << 20, bool)
        out[(hashes >> np.uint64(44)).astype(np.int64)] = True
        return out

    def leaks(self, facts: np.ndarray) -> list[dict]:
        """Items that a document holds."""
        words, kinds, shapes = readings(facts)
        laid: dict[tuple[int, int], int] = {}
        for size, places in self.places.items():
            if size < SHORT and len(words) != size:
                continue
            at, hashes = placed(shapes, size)
            for k in np.flatnonzero(self.marks[size][(hashes >> np.uint64(44)).astype(np.int64)]).tolist():
                for i, own in places.get(int(hashes[k]), ()):
                    laid[i, int(at[k]) - own] = size
        best: dict[int, dict] = {}
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # places of an item: equal, matching
        for (i, shift), size in laid.items():
            _, its_words, its_kinds, its_shapes = self.items[i]
            a, b = max(0, -shift), min(len(its_words), len(words) - shift)
            mine, theirs, same = words[a + shift: b + shift], its_words[a:b], shapes[0][a + shift: b + shift] == its_shapes[0][a:b]
            equal, match = held.setdefault(i, (np.zeros(len(its_words), bool), np.zeros(len(its_words), bool)))
            alike = theirs == mine
            narrow, wide = alike | same, alike | (kinds[a + shift: b + shift] == its_kinds[a:b]) & (its_kinds[a:b] != PLAIN)
            for fits in [narrow] if np.array_equal(narrow, wide) else [narrow, wide]:
                for x, y in stretches(theirs, mine, fits, size):
                    match[a + x: a + y] = True
                    equal[a + x: a + y] |= alike[x:y]
            mine, theirs = mine[same], theirs[same]
            n = int((mine == theirs).sum())
            if n >= SHARE * len(its_words) and n > best.get(i, {"equal_words": 0})["equal_words"] and consistent(theirs, mine):
                best[i] = self.leak(i, n, len(mine) - n)
        for i, (equal, match) in held.items():
            n = int(equal.sum())
            if n >= min(ENOUGH, SHARE * len(equal)) and n >= best.get(i, {"equal_words": 0})["equal_words"]:
                best[i] = self.leak(i, n, int((match & ~equal).sum()))
        return [best[i] for i in sorted(best)]

    def leak(self, i: int, equal: int, changed: int) -> dict:
        return {"item_id": self.items[i][0], "equal_words": equal, "item_words": len(self.items[i][1]), "changed_slots": changed}


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item: str = "item_id", item_text: str = "text", slice_words: int = SLICE_WORDS, name: str = "leaks") -> DataFrame:
    """Kept columns of every document with ``leaks`` (or as named): the items it holds. A benchmark larger than a slice takes a pass for each slice."""
    keep = [c for c in keep if c.lower() != name.lower()]
    body = text if text in keep else free_name(docs, "_text")  # a text that is kept is sent once
    items = benchmark.filter(F.col(item_text).isNotNull()).select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t"))
    slices = parts(items.select(F.sum(F.size(F.split("t", r"\s+")))).first()[0], slice_words)
    out = docs.select(*[docs[c] for c in keep], *([] if text in keep else [docs[text].alias(body)]), F.expr("cast(array() as array<struct<item_id:long,equal_words:int,item_words:int,changed_slots:int>>)").alias(name))
    for k in range(slices):
        held = Benchmark(items.filter(F.pmod(F.xxhash64("t", "i"), F.lit(slices)) == k).orderBy("i", "t").toPandas().itertuples(index=False, name=None))

        def run(batches, held=held):
            lexicon = Lexicon()
            for batch in batches:
                found = [before + held.leaks(lexicon.look(x.as_py() or "")) for before, x in zip(batch.column(name).to_pylist(), batch.column(body))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, ARROW_LEAK)], batch.schema.names)

        out = small_batches(out).mapInArrow(tidy(run), T.StructType([*out.schema.fields[:-1], T.StructField(name, LEAK)]))
        if k < slices - 1:
            out = staged(out, "leaks")  # the plan of the next slice holds nothing of this one
    return out if text in keep else out.drop(body)


def op9_decontamination(spark, sf_dir):
    """Documents that hold benchmark items, with the items."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
