"""Readers and writers: JSON lines, tables by suffix, manifests, checked fixtures, traces, reports.

JSON whose key order matters is read as text with explicit schemas and never goes through VARIANT, which sorts keys.
"""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from decidra.sources.staging import staged

MANIFEST_SET = "struct<name:string,path:string,visibility:string,source:string,license:string,count:bigint,sha256:string,note:string>"
ITEM = "id string, suite string, `group` string, state string, questions map<string,string>, references map<string,string>, meta string"
#: Options of a choice at most, levels of a score.
MOST_OPTIONS, LEVELS = 255, (2, 10)
PREDICTION = "item_id string, answers map<string,string>, latency_s double, cost_usd double, error string"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Rows of JSON lines (gzip by suffix), blank lines skipped. Needs no inference; bad lines land in _corrupt_record."""
    full = schema if "_corrupt_record" in schema else f"{schema}, _corrupt_record string"
    return spark.read.schema(full).option("mode", "PERMISSIVE").json(path)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, line_no, value of each non-blank line, numbered from 0 in each file.

    A file is read in splits, of which the lines are counted first: a line's number is that of the lines in the splits before,
    and its place in its own, which consecutive ids give. No task holds a file, and no row is one.
    """
    at = {"path": F.col("_metadata.file_path"), "_split": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()}
    raw = spark.read.text(path, lineSep="\n").select(*(c.alias(name) for name, c in at.items()), "value")
    before = Window.partitionBy("path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    splits = raw.groupBy("path", "_split").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    starts = splits.select("path", "_split", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    numbered = raw.join(F.broadcast(starts), ["path", "_split"])
    return numbered.select("path", (F.col("_id") + F.col("_shift")).cast("int").alias("line_no"), "value").filter(F.trim("value") != "")


def parse(lines: DataFrame, schema: str) -> DataFrame:
    return lines.select(*[c for c in lines.columns if c != "value"], F.from_json("value", schema).alias("r")).select(*[c for c in lines.columns if c != "value"], "r.*")


def ordered_map(json_text: Column) -> Column:
    """A JSON object as array<struct<key,value>> in source order; of repeated keys the last value, at the first place."""
    pairs = F.map_entries(F.from_json(json_text, "map<string,string>"))
    keys = F.transform(pairs, lambda e: e["key"])
    last = lambda k: F.element_at(F.filter(pairs, lambda e: e["key"] == k), -1)["value"]
    first = F.filter(pairs, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    return F.transform(first, lambda e: F.struct(e["key"].alias("key"), last(e["key"]).alias("value")))


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def load_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """By suffix: Parquet, CSV with a header (all strings), or JSON lines, each plain or gzipped."""
    name = path.removesuffix(".gz")
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    if name.endswith(".csv"):
        return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    if name.endswith((".jsonl", ".json")):
        return (spark.read.schema(schema) if schema else spark.read).json(path)
    raise ValueError(f"no reader for {path}")


def load_items(spark: SparkSession, suite_dir: str) -> tuple[DataFrame, DataFrame]:
    """(items, item_questions): questions and references stay in the order of their file."""
    lines = read_lines(spark, f"{suite_dir}/items.jsonl")
    field = lambda name: F.get_json_object("value", f"$.{name}")
    items = lines.select("line_no", field("id").alias("id"), field("suite").alias("suite"), field("group").alias("group"), field("state").alias("state"), field("meta").alias("meta"), field("questions").alias("_q"), field("references").alias("_r"))
    asked = items.select("id", F.from_json("_r", "map<string,string>").alias("_refs"), F.posexplode(ordered_map(F.col("_q"))).alias("q_ord", "q"))
    questions = asked.select("id", "q_ord", F.col("q.key").alias("qid"), F.col("q.value").alias("question"), F.try_element_at("_refs", F.col("q.key")).alias("reference"))
    return items.drop("_q", "_r"), questions


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The last record of each item in an append log."""
    rows = parse(read_lines(spark, path), PREDICTION)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("path"), F.desc("line_no")))).filter("_r = 1").drop("_r", "path", "line_no")


def by_number(paths: list[str]) -> list[str]:
    """Paths in the order of the numbers in their names: train_2 before train_10; names without one come last."""
    number = lambda p: re.findall(r"\d+", os.path.basename(p))
    return sorted(paths, key=lambda p: (not number(p), [int(n) for n in number(p)], p))


def concatenated(parts: dict[str, DataFrame], order: str) -> DataFrame:
    """The rows of several sources one after the other: each with its source, source_ord and, from `order`, ord. Columns that a source lacks are NULL."""
    union = None
    for n, (name, rows) in enumerate(parts.items()):
        part = rows.withColumns({"source_name": F.lit(name), "source_ord": F.lit(n), "ord": F.col(order)})
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    if union is None:
        raise ValueError("no sources")
    return union


def encoded(rows: DataFrame, columns: list[str]) -> DataFrame:
    """value: each row's columns as one line of JSON, fields without a value left out; from_json with the columns' types gives them back."""
    return rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "true"}).alias("value"))


def first_rows(rows: DataFrame, order: list[str], n: int | None) -> DataFrame:
    """The first n rows in order, or all."""
    return rows if n is None else rows.orderBy(*order).limit(n)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each fixture set, with the manifest's name and version."""
    raw = spark.read.schema(f"name string, version string, sets array<{MANIFEST_SET}>").option("multiLine", "true").json(path)
    return raw.select(F.col("name").alias("manifest"), "version", F.posexplode("sets").alias("ord", "s")).select("manifest", "version", "ord", "s.*")


def resolve(root: str, path: str, visibility: str, private_root: str | None = None) -> str | None:
    """A set's path; private sets are under their own root, and None without one."""
    if visibility == "private":
        return os.path.join(private_root, path) if private_root else None
    return os.path.join(root, path)


def checked_fixtures(spark: SparkSession, root: str, sets: list[T.Row], private_root: str | None = None, split: str | None = None) -> tuple[DataFrame | None, list[str]]:
    """(rows of all sets that are there, notes on the others). A wrong hash or count ends the job. split: only fixtures of that split."""
    rows, notes = None, []
    for s in sets:
        path = resolve(root, s["path"], s["visibility"], private_root)
        if path is None or not _exists(spark, path):
            notes.append(f"{s['name']}: not there")
            continue
        digest = sha256_of(spark, path)
        if digest != s["sha256"]:
            raise ValueError(f"{s['name']}: sha256 is {digest}, not {s['sha256']}")
        part = read_lines(spark, path).select(F.lit(s["name"]).alias("set"), F.lit(s["ord"]).alias("set_ord"), "line_no", "value")
        if (n := part.count()) != s["count"]:
            raise ValueError(f"{s['name']}: {n} rows, not {s['count']}")
        if split is not None:
            part = part.filter(F.get_json_object("value", "$.meta.replay.split") == split)
        rows = part if rows is None else rows.unionByName(part)
    return rows, notes


def sha256_of(spark: SparkSession, path: str) -> str:
    """The hash of one file of any size, read as a stream, block by block, by the driver's JVM. Manifests name few files."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def content_digest(rows: DataFrame, order: str, content: Column, block: int = 1024) -> DataFrame:
    """A digest of rows in order, as a tree: of each row, then again and again of `block` digests that follow one another.

    Rows are counted by ranges of the order, so no window or task goes over all of them, and contents are digests from the start.
    """
    ranges = rows.select(F.col(order).alias("o"), F.sha2(content, 256).alias("d")).repartitionByRange("o").sortWithinPartitions("o").withColumn("p", F.spark_partition_id())
    ranges = staged(ranges)
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = ranges.groupBy("p").agg(F.count("*").alias("n")).select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    at = F.col("start") + F.row_number().over(Window.partitionBy("p").orderBy("o")) - 1
    level, n = ranges.join(F.broadcast(starts), "p").select(at.alias("i"), "d"), ranges.count()
    while True:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "d"))), lambda s: s["d"]), "\n")
        level, n = level.groupBy(F.floor(F.col("i") / block).alias("i")).agg(F.sha2(joined, 256).alias("d")), -(-n // block)
        if n <= 1:
            return level.agg(F.coalesce(F.max("d"), F.sha2(F.lit(""), 256)).alias("digest"))


def viewer_data(text: Column) -> Column:
    """The JSON inside __VIEWER_DATA__( ... );"""
    found = F.regexp_extract(text, r"(?s)__VIEWER_DATA__\((.*)\);?\s*$", 1)
    return F.when(found == "", F.raise_error(F.lit("no viewer data")).cast("string")).otherwise(found)


def trace_bodies(lines: DataFrame) -> DataFrame:
    """Request bodies of a trace's lines; other lines are left out."""
    field = lambda name: F.get_json_object("value", f"$.{name}")
    body = F.coalesce(F.when(field("t") == "request", field("body")), field("request"))
    return lines.select(body.alias("body")).filter("body IS NOT NULL")


def validate_requests(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of rows with a JSON `body`: rejected rows have code, message and field."""
    field = lambda name: F.get_json_object("body", f"$.{name}")
    # a step is a number of the body itself, whole and from 1 on: "3", true and 3.0 are not
    step = F.try_variant_get(F.try_parse_json("body"), "$.step", "variant")
    kind = F.schema_of_variant(step)
    bad_step = step.isNotNull() & (kind != "VOID") & ((kind != "BIGINT") | (F.try_variant_get(step, "$", "long") < 1))
    digest, asked = field("state_digest"), F.from_json(field("questions"), "map<string,string>")
    wrong = F.get(question_errors(asked), 0)
    error = (
        F.when(F.try_parse_json("body").isNull(), F.struct(F.lit("invalid_json").alias("code"), F.lit("not JSON").alias("message"), F.lit(None).cast("string").alias("field")))
        .when(~F.trim("body").startswith("{"), F.struct(F.lit("invalid_request").alias("code"), F.lit("not an object").alias("message"), F.lit(None).cast("string").alias("field")))
        .when(field("questions").isNull(), F.struct(F.lit("invalid_request").alias("code"), F.lit("missing").alias("message"), F.lit("questions").alias("field")))
        .when(bad_step, F.struct(F.lit("invalid_request").alias("code"), F.lit("not an integer from 1").alias("message"), F.lit("step").alias("field")))
        .when(wrong.isNotNull(), F.struct(F.lit("invalid_request").alias("code"), F.concat(F.lit(""), wrong).alias("message"), F.lit("questions").alias("field")))
        .when(digest.isNotNull() & ~digest.rlike(r"^sha256:[0-9a-f]{64}$"), F.struct(F.lit("invalid_request").alias("code"), F.lit("not a digest").alias("message"), F.lit("state_digest").alias("field")))
    )
    for name in ("request_id", "session_id", "observation_id"):
        error = error.when(field(name) == "", F.struct(F.lit("invalid_request").alias("code"), F.lit("empty").alias("message"), F.lit(name).alias("field")))
    judged = rows.withColumn("error", error)
    return judged.filter("error IS NULL").drop("error"), judged.filter("error IS NOT NULL").select("*", "error.*").drop("error")


def option_keys(criteria: Column, qtype: Column) -> Column:
    """Ordered option keys of a question. criteria: JSON object, JSON list of {key, description} or of levels."""
    listed = F.from_json(criteria, "array<struct<key:string,description:string>>")
    choice = F.when(F.trim(criteria).startswith("["), F.transform(listed, lambda o: o["key"])).otherwise(F.json_object_keys(criteria))
    levels = F.transform(F.sequence(F.lit(0), F.json_array_length(criteria) - 1), lambda i: i.cast("string"))
    return F.when(qtype == "noul", F.array(F.lit("false"), F.lit("true"))).when(qtype == "score", levels).otherwise(choice)


def question_errors(questions: Column) -> Column:
    """What is wrong with the questions of a request (map of id to JSON), as an array of texts; empty if nothing is.

    A choice has 1 to 255 options with distinct, non-empty keys, as an object or a list of {key, description}; a score has 2 to 10 levels.
    """

    def problem(e: Column) -> Column:
        qtype, criteria = F.get_json_object(e["value"], "$.type"), F.trim(F.get_json_object(e["value"], "$.criteria"))
        listed = F.startswith(criteria, F.lit("["))
        entries = F.from_json(criteria, "array<map<string,string>>")
        keys = F.when(listed, F.transform(entries, lambda o: F.try_element_at(o, F.lit("key")))).otherwise(F.json_object_keys(criteria))
        shaped = ~listed | F.coalesce(F.forall(entries, lambda o: F.array_sort(F.map_keys(o)) == F.array(F.lit("description"), F.lit("key"))), F.lit(False))
        return (
            F.when(qtype.isNull() | ~qtype.isin("choice", "score", "noul"), "no such type")
            .when((qtype == "choice") & ~shaped, "entries must be key and description").when((qtype == "choice") & ~F.coalesce(F.size(keys).between(1, MOST_OPTIONS), F.lit(False)), f"1 to {MOST_OPTIONS} options")
            .when((qtype == "choice") & listed & F.exists(keys, lambda k: F.coalesce(k, F.lit("")) == ""), "empty key").when((qtype == "choice") & (F.size(F.array_distinct(keys)) < F.size(keys)), "duplicate key")
            .when((qtype == "score") & ~F.coalesce(listed & F.json_array_length(criteria).between(*LEVELS), F.lit(False)), f"{LEVELS[0]} to {LEVELS[1]} levels")
        )

    said = F.transform(F.map_entries(questions), lambda e: F.struct(e["key"].alias("q"), problem(e).alias("p")))
    return F.transform(F.filter(said, lambda s: s["p"].isNotNull()), lambda s: F.concat(s["q"], F.lit(": "), s["p"]))


def with_cost(predictions: DataFrame, input_tokens: str = "input_tokens", usd_per_mtok: float = 0.042) -> DataFrame:
    """predictions with cost_usd by their input tokens; NULL where the usage isn't known."""
    return predictions.withColumn("cost_usd", F.col(input_tokens) * usd_per_mtok / 1e6)


def write_report(reports: dict[str, DataFrame], path: str) -> None:
    """`path/report.md`, every report as a table, and `path/summary.json`, the same rows as JSON. Reports are small: their rows go by the driver."""
    spark = next(iter(reports.values())).sparkSession
    parts = {name: [r.asDict(recursive=True) for r in df.collect()] for name, df in reports.items()}
    texts = {"report.md": "\n\n".join(f"## {name}\n\n{_table(rows, reports[name].columns)}" for name, rows in parts.items()) + "\n", "summary.json": json.dumps(parts, ensure_ascii=False, indent=1, default=str) + "\n"}
    for name, text in texts.items():
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
        stream.write(text.encode())
        stream.close()


def _table(rows: list[dict], columns: list[str]) -> str:
    show = lambda v: "–" if v is None or v != v else f"{v:.2f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(show(r[c]) for c in columns) + " |" for r in rows)])


def markdown(rows: DataFrame, columns: list[str]) -> str:
    """A small result as a Markdown table; missing values are a dash."""
    return _table([r.asDict() for r in rows.collect()], columns)


def suite_summary(questions: DataFrame) -> DataFrame:
    """items and pairs of each group."""
    return questions.groupBy("group").agg(F.count_distinct("id").alias("items"), F.count_if(F.col("reference").isNotNull()).alias("pairs"))


def predictor(spec: str, kinds: tuple[str, ...] | None = None) -> dict[str, str]:
    """A predictor spec taken apart: kind, model, url or bits, adapter and temperatures. kinds: those that there are, if they are known."""
    head, _, temperatures = spec.partition("~")
    kind, _, rest = head.partition(":")
    if kinds is not None and kind not in kinds:
        raise ValueError(f"no predictor {kind!r}")
    model, at, extra = rest.partition("@")
    model, _, adapter = model.partition("+")
    found = {"kind": kind, "model": model, "adapter": adapter, "temperatures": temperatures}
    if at:
        found["bits" if kind == "mlx" else "url"] = extra.removesuffix("bit") if kind == "mlx" else extra
    return {k: v for k, v in found.items() if v}


def from_manifest(spark: SparkSession, path: str, default: float = 0.94) -> float:
    """The routing threshold in a model's manifest, or the default where there is none, or no manifest."""
    if not _exists(spark, path):
        return default
    found = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.threshold").try_cast("double")).first()
    return default if found is None or found[0] is None else found[0]
