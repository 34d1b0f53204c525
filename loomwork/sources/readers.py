"""Scans of problem tables (CSV) and JSONL relations, with explicit schemas.

JSONL is read as text lines that are parsed whole, so that what counts as malformed doesn't depend on the columns
that a query reads; a line holds exactly one value. Order matters to ids made of line numbers, and files have no row numbers in Spark:
:func:`numbered_lines` counts the lines of each split of a file. CSV files whose fields hold line breaks are cut into records by :func:`csv_records`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions import pytext as t
from loomwork.functions.extract import task_type
from loomwork.storage import few, saved, with_rank

CSV_OPTIONS = {"header": True, "multiLine": True, "escape": '"', "quote": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
PROBLEMS = "id string, prompt string, answer string, task_type string"
JSON_FIELDS = ("id", "prompt", "question", "user", "answer", "output", "target", "task_type", "task")


def read_csv(spark: SparkSession, path: str, schema: str = PROBLEMS, line_breaks: bool = True, whole_files: bool = False) -> DataFrame:
    """CSV with a header, columns by position; empty fields are null. Quoted fields may hold line breaks and doubled quotes.

    Files are split whatever their fields hold (:func:`csv_records`). That takes quotes to be as RFC 4180 has them, around whole fields;
    a record in which they aren't is an error, and ``whole_files`` reads such files, each by one task. Without ``line_breaks``
    a line is a record, which saves a pass."""
    options = CSV_OPTIONS | {"nullValue": "", "emptyValue": ""}
    if whole_files or not line_breaks:
        return spark.read.options(**options | {"multiLine": line_breaks}).schema(schema).csv(path)
    text = F.col("text")
    bare = F.regexp_replace(text, '"[^"]*"', '"')  # of each quoted stretch one quote
    strict = ~bare.rlike('[^",]"|"[^",]') & (F.length(F.regexp_replace(text, '[^"]', "")) % 2 == 0)
    said = F.concat(F.lit("quotes within a field, read with whole_files: "), F.left(text, F.lit(200)))
    records = csv_records(spark, path).filter("record > 1 and text != ''")
    records = records.filter(F.when(strict, F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))
    row = F.from_csv(text, schema, {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items() if k != "header"})
    return records.select(F.inline(F.array(row)))  # parsed once, whatever is filtered above


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """file, record, text: the records of CSV files, numbered from 1 within each file, from lines that any number of tasks read.

    A line feed ends a record where the number of quotes before it is even. Each split of a file has its parity, and how many records begin in it
    for either parity of what is before; with a row per split these give every split its state and its first record's number. Lines are shuffled once,
    by split, and joined within it; only records that go on in another split are brought together by their number."""
    split, quotes = ["file", "start"], F.length(F.regexp_replace("value", '[^"]', "")) % 2
    meta = F.col("_metadata")
    lines = spark.read.text(path, lineSep="\n").select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("start")).withColumn("at", F.monotonically_increasing_id())
    before = Window.partitionBy(*split).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum(quotes).over(before), F.lit(0)) % 2  # within the split
    lines = saved(lines.withColumns({"quotes": quotes, "odd": odd}), "csv-lines")
    splits = lines.groupBy(*split).agg((F.sum("quotes") % 2).alias("parity"), F.sum(1 - F.col("odd")).alias("if_even"), F.sum("odd").alias("if_odd"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("enters", F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2)
    splits = splits.withColumn("base", F.coalesce(F.sum(F.when(F.col("enters") == 0, F.col("if_even")).otherwise(F.col("if_odd"))).over(earlier), F.lit(0)))
    places = saved(splits.select(F.col("file").alias("__file"), F.col("start").alias("__start"), "enters", "base"), "csv-splits")
    lines = lines.join(few(places), (F.col("file") == F.col("__file")) & (F.col("start") == F.col("__start"))).drop("__file", "__start")
    begins = ((F.col("odd") + F.col("enters")) % 2 == 0).cast("int")
    record = F.col("base") + F.sum(begins).over(Window.partitionBy(*split).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    piece = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "\n")
    # grouped by split as well, for which the lines lie together already
    pieces = lines.withColumn("record", record).groupBy(*split, "record").agg(piece.alias("text"), F.max("base").alias("base"))
    last = Window.partitionBy(*split)
    pieces = saved(pieces.withColumn("edge", (F.col("record") == F.col("base")) | (F.col("record") == F.max("record").over(last))), "csv-pieces")
    whole = pieces.filter("not edge").select("file", "record", "text")
    cut = pieces.filter("edge").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("p"))
    joined = cut.select("file", "record", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    return whole.unionByName(joined).withColumn("text", F.regexp_replace("text", "\r$", ""))


def normalised_problems(rows: DataFrame, ordinal: str) -> DataFrame:
    """sample_id, prompt, answer, task_type of rows with a prompt and an answer; an id that is missing is
    ``row_N``, N the number of kept rows before it in the order of ``ordinal``, which no two rows share.

    Only ordinals are sorted, and only rows without an id are joined to their number."""
    clean = rows.withColumns({"prompt": t.strip(F.coalesce("prompt", F.lit(""))), "answer": t.strip(F.coalesce("answer", F.lit("")))})
    kept = clean.filter("prompt != '' and answer != ''").withColumn("__name", t.blank_to_null(F.col("id")))
    ranks = with_rank(kept.select(F.col(ordinal).alias("__of"), F.col("__name").isNull().alias("__missing")), F.col("__of"), name="__n").filter("__missing")
    named = kept.filter("__name is not null")
    numbered = kept.filter("__name is null").join(ranks, F.col(ordinal) == F.col("__of")).withColumn("__name", F.concat(F.lit("row_"), (F.col("__n") - 1).cast("string")))
    task = task_type(F.col("task_type"), F.col("prompt")).alias("task_type")
    return named.unionByName(numbered.select(*named.columns)).select(t.strip(F.col("__name")).alias("sample_id"), "prompt", "answer", task, ordinal)


STRICT = {"allowSingleQuotes": "false"}


def one_object(line: Column) -> Column:
    """Whether a text holds exactly one JSON object and nothing else.

    Parsers stop behind a first value. So the line becomes the first of two items of an array, the second of which has the
    line's hash: that is read only if the line ends where its value does, and no line can stand in for it."""
    mark = F.md5(line)
    items = F.from_json(F.concat(F.lit("["), line, F.lit(',{"__end":"'), mark, F.lit('"}]')), "array<struct<__end: string>>", STRICT)
    sole = lambda x: (F.size(x) == 2) & F.get(x, F.lit(0)).isNotNull() & (F.get(x, F.lit(1))["__end"] == mark)
    return F.coalesce(F.get(F.transform(F.array(items), sole), F.lit(0)), F.lit(False))


def parsed_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of ``schema`` and ``__bad``, the line itself where it isn't one object as the schema says; blank lines are skipped."""
    lines = spark.read.text(path).filter(t.strip(F.col("value")) != "")
    obj = F.from_json("value", f"{schema}, __bad string", STRICT | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    both = F.struct(obj.alias("row"), one_object(F.col("value")).alias("sole"), F.col("value").alias("line"))
    parsed = lines.select(F.inline(F.array(both)))  # parsed once, whatever is filtered above
    return parsed.withColumn("row", F.col("row").withField("__bad", F.when(F.col("sole"), F.col("row.__bad")).otherwise(F.col("line")))).select("row.*")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict: blank lines are skipped, a malformed line is an error, also where only some columns are read or counted."""
    ok = F.when(F.col("__bad").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("malformed line: "), F.col("__bad"))).cast("boolean"))
    return parsed_lines(spark, path, schema).filter(ok).drop("__bad")


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str, required: str | None = None) -> DataFrame:
    """Malformed lines, and lines without the ``required`` key, are dropped."""
    rows = parsed_lines(spark, path, schema).filter("__bad is null").drop("__bad")
    return rows.filter(F.col(required).isNotNull()) if required else rows


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value: all lines of text files, numbered from 0 within each file, blank ones too.

    A task reads the lines of a split in order, so a line's number is its place in its split and the lines of the
    file's splits before, of which there is one small row each. Nothing is sorted."""
    meta = F.col("_metadata")
    lines = spark.read.text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("__start")).withColumn("__at", F.monotonically_increasing_id())
    splits = lines.groupBy("file", "__start").agg(F.count(F.lit(1)).alias("__rows"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__rows").over(Window.partitionBy("file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = splits.select(F.col("file").alias("__file"), F.col("__start").alias("__from"), (before - F.col("__first")).alias("__shift"))
    joined = lines.join(few(saved(places, "line-places")), (F.col("file") == F.col("__file")) & (F.col("__start") == F.col("__from")))
    return joined.select("file", (F.col("__at") + F.col("__shift")).alias("line"), "value")


def truthy(value: Column) -> Column:
    """A JSON value as Python's str() shows it, or null where Python takes it for false: null, '', 0, false, [] and {}.

    Arrays and objects are shown as JSON."""
    kind, text = F.schema_of_variant(value), value.cast("string")
    number = F.when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), value.cast("double").cast("string")).otherwise(text)
    shown = (
        F.when(kind == "STRING", F.nullif(text, F.lit("")))
        .when(kind == "BOOLEAN", F.when(value.cast("boolean"), F.lit("True")))
        .when(kind.rlike("^(ARRAY|OBJECT)"), F.when(~text.isin("[]", "{}"), text))
        .when(kind == "VOID", F.lit(None).cast("string"))
        .otherwise(F.when(value.cast("double") != 0, number))
    )
    return F.when(value.isNotNull(), shown)


def aliased(obj: Column, *names: str) -> Column:
    """The first field of a JSON value that is truthy, as text; null if there is none."""
    return F.coalesce(*[truthy(F.try_variant_get(obj, f"$.{n}", "variant")) for n in names])


def aliased_samples(lines: DataFrame, line_col: str = "value", index_col: str = "line") -> DataFrame:
    """Samples of JSONL lines numbered from 0: prompt, question or user; answer, output or target; an id
    that is missing is ``jsonl_N``. Rows without a prompt or an answer are dropped, blank lines skipped; a malformed line is an error."""
    obj, line = F.col("__obj"), F.col(line_col)
    parsed = F.when(one_object(line), F.try_parse_json(t.strip(line)))
    # blank lines are told here too: what is raised may be evaluated before the filter
    whole = F.when(t.strip(line) != "", F.coalesce(parsed, F.raise_error(F.concat(F.lit("malformed line: "), line)).cast("variant")))
    rows = lines.filter(t.strip(line) != "").withColumn("__obj", whole)
    rows = rows.select(
        t.strip(F.coalesce(aliased(obj, "id"), F.concat(F.lit("jsonl_"), F.col(index_col).cast("string")))).alias("sample_id"),
        t.strip(F.coalesce(aliased(obj, "prompt", "question", "user"), F.lit(""))).alias("prompt"),
        t.strip(F.coalesce(aliased(obj, "answer", "output", "target"), F.lit(""))).alias("answer"),
        aliased(obj, "task_type", "task").alias("__task"),
        F.col(index_col),
    )
    return rows.filter("prompt != '' and answer != ''").withColumn("task_type", task_type(F.col("__task"), F.col("prompt"))).drop("__task")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """The samples of JSONL files, ids that are missing made of line numbers within the file."""
    return aliased_samples(numbered_lines(spark, path))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_existing(spark: SparkSession, paths: list[str], schema: str, origin: str = "origin") -> tuple[DataFrame, list[str]]:
    """The union of the JSONL inputs that exist, with the name of the file or folder each row came
    from, and the list of those that don't."""
    missing = [p for p in paths if not exists(spark, p)]
    out = spark.createDataFrame([], f"{schema}, {origin} string")
    for p in paths:
        if p not in missing:
            stem = p.rstrip("/").rpartition("/")[2].rpartition(".")[0] or p.rstrip("/").rpartition("/")[2]
            out = out.unionByName(read_jsonl(spark, p, schema).withColumn(origin, F.lit(stem)), allowMissingColumns=True)
    return out, missing


def columns_of(df: DataFrame) -> DataFrame:
    """Names and types of a relation's columns, with their place."""
    return df.sparkSession.createDataFrame([(i, n, k) for i, (n, k) in enumerate(df.dtypes)], "place int, name string, type string")


def preview(df: DataFrame, order: str, k: int) -> DataFrame:
    """Per column its place, name, type, number of values that aren't null, and its first ``k`` values by ``order``, as text."""
    columns = df.columns
    counts = df.agg(*[F.count(F.col(c)).alias(f"__{i}") for i, c in enumerate(columns)])
    counts = counts.select(F.posexplode(F.array(*[F.col(f"__{i}") for i in range(len(columns))])).alias("place", "present"))
    head = df.orderBy(order).limit(k).select(F.col(order).alias("__order"), F.posexplode(F.array(*[F.col(c).cast("string") for c in columns])).alias("__place", "value"))
    head = head.groupBy("__place").agg(F.transform(F.array_sort(F.collect_list(F.struct("__order", "value"))), lambda x: x["value"]).alias("head"))  # k rows
    joined = columns_of(df).join(counts, "place").join(head, F.col("place") == F.col("__place"), "left")
    return joined.select("place", "name", "type", "present", F.coalesce("head", F.array().cast("array<string>")).alias("head"))


def has_key(raw: Column, key: str) -> Column:
    """Whether a JSON text has a key at all, null or not."""
    return F.coalesce(F.array_contains(F.json_object_keys(raw), key), F.lit(False))
