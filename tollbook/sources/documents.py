"""Documents far larger than a split, read by many tasks: a parallel scan of JSON structure.

A file is read in pieces, cut at every comma, which Spark's text reader finds in any split of it.
What a piece does to the state of a parser depends on the text before it only by whether it begins
inside a string, so each piece says what it would do in both cases: how many quotes it holds, and by
how much it changes the depth of brackets. Escapes need no state: none ends at a comma in JSON.
The states are put together as running sums: inside each split, then over the splits of a file (one
row per split). A comma outside strings at depth 1 ends a member of the document, one at depth
2 an element of a member. The pieces of each element of ``messages`` are then put together; no
row ever holds more than one message.

A document whose structure does not add up, or of which a part cannot be parsed, is no document
with a message list; such files are left to the caller, who reads them as one message or by lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tollbook.session import fresh_folder

MEMBER = r'^\s*\{?\s*"((?:[^"\\]|\\.)*)"\s*:\s*'
AT = ["_file", "_split", "_at"]


def _written(df: DataFrame, label: str) -> DataFrame:
    path = fresh_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _depth_change(text: Column) -> Column:
    return F.length(F.translate(text, "}]", "")) - F.length(F.translate(text, "{[", ""))


def scan_pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Pieces of files with the quotes they hold (odd or even) and their change of depth when they begin outside and inside a string."""
    bare = F.col("bare")
    unquoted = lambda text: F.regexp_replace(text, r'"[^"]*("|\z)', "")
    read = spark.read.text(paths, lineSep=",").select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("piece"))
    # without escapes; NULL for the many pieces of plain text, which change nothing
    read = read.withColumn("bare", F.when(F.col("piece").rlike(r'["\[\]{}]'), F.regexp_replace("piece", r"(?s)\\.", "")))
    quotes = (F.length(bare) - F.length(F.translate(bare, '"', ""))) % 2
    read = read.select(*AT, "piece", quotes.alias("quotes"), unquoted(bare).alias("_outside"), unquoted(F.concat(F.lit('"'), bare)).alias("_inside"))
    return read.select(*AT, "piece", *[F.coalesce(c, F.lit(0)).alias(n) for n, c in (
        ("quotes", F.col("quotes")), ("outside", _depth_change(F.col("_outside"))), ("inside", _depth_change(F.col("_inside"))))])


def _before(rows: DataFrame, by: list[str], order: str, name: str, value: Column) -> DataFrame:
    """Rows with the sum of a value over the rows before them."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(value).over(window), F.lit(0)))


def _over_splits(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Sums of values over all earlier splits of a file, one row per split."""
    each = rows.groupBy("_file", "_split").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    for name in sums:
        each = _before(each, ["_file"], "_split", f"{name}_before", F.col(name))
    return each


def placed_pieces(pieces: DataFrame) -> DataFrame:
    """For every piece (without its text): whether it begins inside a string, at what depth, and the number of the member and of the
    element it belongs to. The windows inside a split hold numbers only, of one split at most."""
    split = ["_file", "_split"]
    p = _before(pieces.drop("piece"), split, "_at", "odd", F.col("quotes"))
    even = F.col("odd") % 2 == 0
    p = p.select(*AT, "odd", "quotes", F.when(even, F.col("outside")).otherwise(F.col("inside")).alias("plain"), F.when(even, F.col("inside")).otherwise(F.col("outside")).alias("quoted"))
    ends = p.groupBy(*split).agg(F.sum("quotes").alias("quotes"), F.sum("plain").alias("plain"), F.sum("quoted").alias("quoted"))
    ends = _before(ends, ["_file"], "_split", "odd_before", F.col("quotes"))
    ends = _before(ends, ["_file"], "_split", "depth_before", F.when(F.col("odd_before") % 2 == 0, F.col("plain")).otherwise(F.col("quoted")))
    p = p.join(ends.select(*split, "odd_before", "depth_before"), split)
    change = F.when(F.col("odd_before") % 2 == 0, F.col("plain")).otherwise(F.col("quoted"))
    p = _before(p.withColumn("change", change), split, "_at", "depth_here", F.col("change"))
    p = p.select(*AT, ((F.col("odd") + F.col("odd_before")) % 2 == 1).alias("inside"), (F.col("depth_before") + F.col("depth_here")).alias("depth"), "change", "quotes")
    first = (F.col("_split") == 0) & (F.col("_at") == F.min("_at").over(Window.partitionBy(*split)))
    border = lambda depth: (~F.col("inside") & (F.col("depth") == depth)).cast("int")
    p = p.withColumns({"first": first, "new_member": border(1), "new_element": border(2)})
    counts = _over_splits(p, {"new_member": F.col("new_member"), "new_element": F.col("new_element")})
    p = p.join(counts.select(*split, "new_member_before", "new_element_before"), split)
    for name in ("member", "element"):
        p = _before(p, split, "_at", f"{name}_here", F.col(f"new_{name}"))
        p = p.withColumn(name, F.col(f"new_{name}_before") + F.col(f"{name}_here") + F.col(f"new_{name}"))
    return p.select(*AT, "inside", "depth", "change", "quotes", "first", "new_member", "member", "element")


def list_elements(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(elements, files) of large documents. ``elements``: _file, name (``messages`` or ``info``), seq, text. ``files``: _file and
    ``kind``: ``list`` (a document with a message list), ``single`` (one with the members info and parts) or ``other``."""
    pieces = _written(scan_pieces(spark, paths), "pieces")
    placed = _written(placed_pieces(pieces), "placed-pieces")
    ordered = F.struct("_split", "_at")
    whole = placed.groupBy("_file").agg(
        F.sum("quotes").alias("quotes"), F.sum("change").alias("depth"), F.max("member").alias("last_member"),
        F.min(F.when(~F.col("inside") & ~F.col("first"), F.col("depth"))).alias("shallowest"), F.max(ordered).alias("last"), F.min(ordered).alias("begin"))
    ends = whole.select("_file", F.explode(F.array("begin", "last")).alias("at")).select("_file", "at._split", "at._at").distinct()
    ends = pieces.join(ends, AT).groupBy("_file").agg(F.min_by("piece", ordered).alias("head"), F.max_by("piece", ordered).alias("tail"))
    whole = whole.join(ends, "_file").withColumn("closed", (F.col("quotes") % 2 == 0) & (F.col("depth") == 0) & (F.coalesce("shallowest", F.lit(1)) >= 1)
                                                 & F.col("head").rlike(r"^\s*\{") & F.col("tail").rlike(r"\}\s*$"))
    # the members of each file by their first pieces; of members of one name the last counts
    begins = placed.where("first OR new_member = 1").select(*AT, "member").join(pieces, AT)
    named = begins.select("_file", "member", F.regexp_extract("piece", MEMBER, 1).alias("name"), F.regexp_extract("piece", MEMBER + r"(\S)", 2).alias("opens"))
    last = named.where("name IN ('messages', 'info', 'parts')").groupBy("_file", "name").agg(F.max(F.struct("member", "opens")).alias("m"))
    has = last.groupBy("_file").agg(F.max(F.when((F.col("name") == "messages") & (F.col("m.opens") == "["), F.col("m.member"))).alias("listed"),
                                    F.max(F.when(F.col("name") == "info", F.col("m.member"))).alias("info"), F.max(F.when(F.col("name") == "parts", F.col("m.member"))).alias("parts"))
    kinds = whole.join(has, "_file", "left").select(
        "_file", "last_member", "listed", "info",
        F.when(F.col("closed") & F.col("listed").isNotNull(), "list").when(F.col("closed") & F.col("info").isNotNull() & F.col("parts").isNotNull(), "single").otherwise("other").alias("kind"))
    kinds = _written(kinds, "document-kinds")

    wanted = kinds.where("kind = 'list'").select("_file", "last_member", "listed", "info")
    own = placed.select(*AT, "member", "element").join(wanted, "_file")
    is_list = F.col("member") == F.col("listed")
    own = own.withColumn("element", F.when(is_list, F.col("element")).otherwise(-1))  # other members are put together whole
    texts = own.join(pieces.select(*AT, "piece"), AT).groupBy("_file", "member", "element", "listed", "info", "last_member").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_split", "_at", "piece"))), lambda x: x["piece"]), ",").alias("text"))
    bounds = placed.groupBy("_file", "member").agg(F.min("element").alias("low"), F.max("element").alias("high"))
    texts = texts.join(bounds, ["_file", "member"])
    head, tail = F.col("element").isin(-1) | (F.col("element") == F.col("low")), F.col("element").isin(-1) | (F.col("element") == F.col("high"))
    text = F.when(head, F.regexp_replace("text", MEMBER, "")).otherwise(F.col("text"))
    text = F.when(tail & (F.col("member") == F.col("last_member")), F.regexp_replace(text, r"\s*\}\s*$", "")).otherwise(text)
    text = F.when(is_list & head, F.regexp_replace(text, r"^\[", "")).otherwise(text)
    text = F.when(is_list & tail, F.regexp_replace(text, r"\s*\]\s*$", "")).otherwise(text)
    name = F.when(is_list, "messages").when(F.col("member") == F.col("info"), "info").otherwise("rest")
    elements = texts.select("_file", name.alias("name"), F.when(is_list, F.col("element") - F.col("low")).otherwise(0).cast("int").alias("seq"), text.alias("text"))
    # an empty list has one empty element
    return elements.where("NOT (name = 'messages' AND seq = 0 AND trim(regexp_replace(text, '\\\\s+', ' ')) = '')"), kinds.select("_file", "kind")
