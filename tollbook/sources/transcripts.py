"""Raw transcripts -> numbered, parsed records."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tollbook.functions.variants import is_object, node
from tollbook.schemas import ERRORS, conform
from tollbook.sources.documents import _written, list_elements
from tollbook.sources.inventory import SESSION_COLUMNS, PlannedFiles, glob_free, planned_files

DOCUMENT_BYTES = 32 * 1024 * 1024
# A larger record does not fit a VARIANT value.
RECORD_BYTES = 120 * 1024 * 1024
LONG_STRINGS = {"maxStringLen": "2147483647"}


# A mark after the value shows that the value did not end before its text did ("1]" closes the list around it).
END_MARK = "\u241e end of record \u241e"
DOCUMENT = "struct<info:string,parts:string,messages:array<{}>>"


def _only(text: Column, kind: str) -> Column:
    """The one JSON value that a text holds; NULL for none or several, or text after it. The text is parsed once: what is asked
    of the parsed list is asked inside a filter, as Spark parses anew for each mention behind a condition."""
    mark = f'"{END_MARK}"' if kind == "variant" else f'{{"info":"{END_MARK}"}}'
    parsed = F.from_json(F.concat(F.lit("["), text, F.lit(f",{mark}]")), f"array<{kind}>", LONG_STRINGS)

    def alone(found: Column) -> Column:
        end = F.get(found, F.lit(1))
        end = F.try_variant_get(end, "$", "string") if kind == "variant" else end["info"]
        return (F.size(found) == 2) & (end == END_MARK)

    return F.get(F.get(F.filter(F.array(parsed), alone), F.lit(0)), F.lit(0))


def record(text: Column) -> Column:
    """A text as VARIANT, with strings of any length; of repeated keys the last counts."""
    return F.when(F.octet_length(text) <= RECORD_BYTES, _only(text, "variant"))


def refusal(text: Column) -> Column:
    """Why a text is no record."""
    return F.when(F.octet_length(text) > RECORD_BYTES, "ValueError: record is too large to be parsed").otherwise("ValueError: line is not valid JSON")


def filled_line(line: Column) -> Column:
    """Whether a line holds more than white space."""
    return line.rlike(r"\S")


def placed(rows: DataFrame, name: str, files: PlannedFiles | None = None) -> DataFrame:
    """Rows of files with their 0-based number in their file. ``_at`` follows the rows that one task reads of a
    split; the rows of earlier splits are added. Only counts are exchanged, never text. With ``files`` rows get the columns of their session, looked up once for each split."""
    splits = rows.groupBy("_file", "_split").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("_file", "_split", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    if files:
        starts = files.with_session(starts, F.col("_file"))
    # one row per split of a file
    return rows.join(F.broadcast(starts), ["_file", "_split"]).withColumn(name, (F.col("_base") + F.col("_at")).cast("int")).drop("_base")


def _lines(files: PlannedFiles, paths: list[str], **options) -> DataFrame:
    """Lines of some files. Without paths there are none."""
    if not paths:
        return files.spark.createDataFrame([], "line string, _file string, _split long, _at long")
    return files.spark.read.text(paths, **options).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"))


def scan_jsonl(spark: SparkSession, folder: str, plan: DataFrame, files: PlannedFiles | None = None) -> DataFrame:
    """Lines of every planned JSONL transcript with their 0-based index; no other file is opened.

    Blank lines count but are not returned. Files may be split: a line's index is its place
    inside its split plus the lines of the splits before it, so no file has to pass through
    one task."""
    files = files or planned_files(spark, folder, plan)
    lines = placed(_lines(files, files.paths(documents=False), lineSep="\n"), "seq", files)
    some = lines.where(filled_line(F.col("line")))
    return some.select(*SESSION_COLUMNS, "seq", "line")


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Lines as a VARIANT column ``v``; where that is NULL, ``refused`` says why."""
    return lines.withColumn("v", record(F.col("line"))).withColumn("refused", F.when(F.col("v").isNull(), refusal(F.col("line")))).drop("line")


def split_errors(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, lines that are no records)."""
    errors = parsed.where("v IS NULL").select("session_id", F.col("seq").alias("line_no"), F.col("refused").alias("exception"))
    return parsed.where("v IS NOT NULL").drop("refused"), conform(errors, ERRORS)


def parse_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_errors(parsed_lines(lines))


def scan_documents(spark: SparkSession, folder: str, plan: DataFrame, files: PlannedFiles | None = None, upto: int | None = None) -> DataFrame:
    """Whole-file transcripts (of at most ``upto`` bytes), one row per file; no other file is opened."""
    files = files or planned_files(spark, folder, plan)
    return _whole(files, files.paths(documents=True, upto=upto))


def _whole(files: PlannedFiles, paths: list[str]) -> DataFrame:
    if not paths:
        return files.spark.createDataFrame([], "session_id string, agent string, repo string, fmt string, blob string")
    docs = files.spark.read.text(paths, wholetext=True).select(F.col("value").alias("blob"), F.col("_metadata.file_path").alias("_file"))
    return files.with_session(docs, F.col("_file")).select(*SESSION_COLUMNS, "blob")


def large_document_messages(files: PlannedFiles, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """``document_messages`` of files that no task should hold: lists of messages are cut by a parallel scan, files with one
    message per line are read by lines, and a file that is one message is one record anyway."""
    spark = files.spark
    found, kinds = list_elements(spark, paths)
    parsed = _written(found.withColumn("v", record(F.col("text"))).withColumn("refused", F.when(F.col("v").isNull(), refusal(F.col("text")))).withColumn("large", F.octet_length("text") > RECORD_BYTES).drop("text"), "elements")
    # a part that cannot be parsed makes the whole no document; one that is only too large is left out
    broken = parsed.where("v IS NULL AND NOT large").select("_file").distinct().withColumn("broken", F.lit(True))
    kind = F.when(F.col("broken") & (F.col("kind") == "list"), "other").otherwise(F.col("kind"))
    kinds = _written(kinds.join(broken, "_file", "left").select("_file", kind.alias("kind")), "kinds")
    of_kind = {k: [] for k in ("list", "single", "other")}
    for file, k in kinds.collect():  # one row per large file, all of which the driver's listing names
        of_kind[k].append(glob_free(unquote(file)))
    good = parsed.join(kinds.where("kind = 'list'"), "_file", "left_semi")
    info = good.where("name = 'info'").select("_file", F.col("v").alias("head"))
    said = good.where("name = 'messages'").join(info, "_file", "left")
    listed = files.with_session(said, F.col("_file")).select(*SESSION_COLUMNS, *_of_head(F.col("head")), "seq", "v", "refused")
    errors = listed.where("v IS NULL").select("session_id", F.col("seq").alias("line_no"), F.col("refused").alias("exception"))
    messages = listed.where("v IS NOT NULL").drop("refused")

    lines = placed(_lines(files, of_kind["other"]), "line_no").where(filled_line(F.col("line")))
    bad = files.with_session(lines.where(record(F.col("line")).isNull()), F.col("_file")).select("session_id", "line_no", refusal(F.col("line")).alias("exception"))
    # messages by line are numbered without the lines between them
    tried = _lines(files, of_kind["other"]).withColumn("v", record(F.col("line"))).where(F.col("v").isNotNull() & is_object(F.col("v"))).drop("line", "_at").withColumn("_at", F.monotonically_increasing_id())
    tried = _written(tried, "line-messages")
    by_line = files.with_session(placed(tried, "seq"), F.col("_file"))
    nothing = F.lit(None).cast("string")
    messages = messages.unionByName(by_line.select(*SESSION_COLUMNS, nothing.alias("version"), nothing.alias("directory"), "seq", "v"))
    single, bad_single = document_messages(_whole(files, of_kind["single"]))
    return messages.unionByName(single), conform(errors.unionByName(bad), ERRORS).unionByName(bad_single)


def scan_messages(spark: SparkSession, folder: str, plan: DataFrame, files: PlannedFiles | None = None, upto: int = DOCUMENT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(messages, what is no record) of all planned documents. Files of up to ``upto`` bytes, less than a split, are read whole by the
    task they are packed into; larger ones are cut by many tasks. Both ways give the same rows."""
    files = files or planned_files(spark, folder, plan)
    messages, errors = document_messages(_written(scan_documents(spark, folder, plan, files, upto), "documents"))
    large = files.paths(documents=True, above=upto)
    if not large:
        return messages, errors
    more, bad = large_document_messages(files, large)
    return messages.unionByName(more), errors.unionByName(bad)


def _of_head(head: Column) -> list[Column]:
    """Version and directory that a document names."""
    return [F.try_variant_get(node(head, name), "$", "string").alias(name) for name in ("version", "directory")]


def document_messages(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages with ``seq``, ``v``, ``version``, ``directory``; messages and lines that are no records).

    A file is one document with a message list, one single message, or one message per line.
    The document is only cut here: each message is parsed by itself, so one that cannot be
    does not take the others with it."""
    fits = F.octet_length("blob") <= RECORD_BYTES  # so does each of its messages
    d = docs.withColumns({"doc": _only(F.when(fits, F.col("blob")), DOCUMENT.format("variant")), "raw": _only(F.when(~fits, F.col("blob")), DOCUMENT.format("string"))})
    doc, raw = F.col("doc"), F.col("raw")
    one = F.when(F.coalesce(doc["info"], raw["info"]).isNotNull() & F.coalesce(doc["parts"], raw["parts"]).isNotNull(), F.array("blob"))
    is_list = doc["messages"].isNotNull() | raw["messages"].isNotNull()
    d = d.withColumn("texts", F.coalesce(raw["messages"], F.when(~is_list, one))).withColumn("head", record(F.when(is_list, F.coalesce(doc["info"], raw["info"]))))
    cut = F.coalesce(F.col("texts"), F.split("blob", "\r\n|\n|\r"))
    tried = F.filter(F.transform(cut, lambda x, i: F.struct(i.alias("place"), x.alias("text"), record(x).alias("v"))), lambda m: F.trim(m["text"]) != "")
    read = F.transform(doc["messages"], lambda v, i: F.struct(i.alias("place"), F.lit(None).cast("string").alias("text"), v.alias("v")))
    d = d.withColumn("tried", F.coalesce(read, tried)).withColumn("texts", F.coalesce("texts", F.when(is_list, F.array().cast("array<string>"))))
    errors = d.select("session_id", F.explode(F.filter("tried", lambda m: m["v"].isNull())).alias("m")).select(
        "session_id", F.col("m.place").alias("line_no"), refusal(F.col("m.text")).alias("exception"))
    # messages by line are numbered without the lines between them
    by_line = F.transform(F.filter("tried", lambda m: m["v"].isNotNull() & is_object(m["v"])), lambda m, i: F.struct(i.alias("seq"), m["v"].alias("v")))
    listed = F.transform(F.filter("tried", lambda m: m["v"].isNotNull()), lambda m: F.struct(m["place"].alias("seq"), m["v"].alias("v")))
    messages = d.select(
        *SESSION_COLUMNS, *_of_head(F.col("head")),
        F.explode(F.when(F.col("texts").isNull(), by_line).otherwise(listed)).alias("m"))
    return messages.select(*SESSION_COLUMNS, "version", "directory", "m.seq", "m.v"), conform(errors, ERRORS)
