"""Files in and out: CSV landing, column records, packages, telemetry lines, reports."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FORMAT = "logical-parquet/1"


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> list[str]:
    """Paths in a folder of any store that Spark reads; one for each table, so few."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in found or [])


def stem(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])


def sanitised(name: str) -> str:
    """Lower case, spaces and dashes to _, nothing but letters, digits and _; never a leading digit."""
    clean = re.sub(r"[^\w]", "", re.sub(r"[ \-]", "_", name.strip().lower()))
    return f"col_{clean}" if not clean or clean[0].isdigit() else clean


def land_csv(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """A CSV as strings under clean names; short rows are padded with '', long ones cut."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', mode="PERMISSIVE")
    df = df.toDF(*(sanitised(c) for c in df.columns)).na.fill("")
    return df if max_rows is None else df.limit(max_rows)


def landing_files(spark: SparkSession, folder: str) -> list[str]:
    """*_data.csv, or where there are none every CSV but annotations.csv."""
    return list_files(spark, folder, "*_data.csv") or [p for p in list_files(spark, folder, "*.csv") if not p.endswith("/annotations.csv")]


def csv_columns(spark: SparkSession, folder: str, first: int = 5) -> DataFrame:
    """(source_table, column_name, column_type, sample_values, headers) of all CSVs of a folder.

    sample_values are the non-empty values of the first rows; a name loses
    what stands before its first dot. annotations.csv and metadata.csv aren't
    tables.
    """
    out = []
    for path in list_files(spark, folder, "*.csv"):
        if path.rsplit("/", 1)[-1] in ("annotations.csv", "metadata.csv"):
            continue
        df = spark.read.csv(path, header=True, multiLine=True, escape='"')
        if not df.columns:
            continue
        head = df.limit(first).withColumn("_row", F.monotonically_increasing_id())
        order = F.create_map(*(x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))))
        cells = head.unpivot("_row", [F.col(f"`{c}`") for c in df.columns], "full_name", "value")
        values = F.transform(F.array_sort(F.collect_list(F.when(F.col("value") != "", F.struct("_row", "value")))), lambda s: s["value"])
        grouped = cells.groupBy("full_name").agg(values.alias("sample_values"))
        bare = F.regexp_replace("full_name", r"^[^.]*\.", "")
        out.append(grouped.select(F.lit(stem(path)).alias("source_table"), bare.alias("column_name"), F.lit("STRING").alias("column_type"), "sample_values", F.array(*map(F.lit, df.columns)).alias("headers"), order[F.col("full_name")].alias("ordinal")))
    if not out:
        return spark.createDataFrame([], "source_table string, column_name string, column_type string, sample_values array<string>, headers array<string>, ordinal int")
    return reduce(DataFrame.unionByName, out)


def column_records(df: DataFrame) -> DataFrame:
    """Column records from a table whose lists may be JSON text; the column itself comes first in headers."""

    def as_list(name: str) -> Column:
        return F.col(name) if dict(df.dtypes)[name].startswith("array") else F.coalesce(F.from_json(name, "array<string>"), F.array().cast("array<string>"))

    others = F.filter(as_list("sibling_columns"), lambda h: h != F.col("column_name"))
    return df.select("source_table", "column_name", "column_type", as_list("sample_values").alias("sample_values"), F.concat(F.array("column_name"), others).alias("headers"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(key, code) of {"mappings": {...}} or a flat object."""
    text = spark.read.text(path, wholetext=True)
    nested = F.from_json(F.get_json_object("value", "$.mappings"), "map<string,string>")
    flat = F.from_json("value", "map<string,string>")
    return text.select(F.explode(F.coalesce(nested, flat)).alias("key", "code"))


def write_ground_truth(truth: DataFrame, path: str) -> None:
    """Sorted by key, as one JSON object (a hand-checked list, so small); of a repeated key the largest code counts."""
    body = truth.groupBy("key").agg(F.max("code").alias("code")).agg(F.to_json(F.struct(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "code")))).alias("mappings"))).alias("value"))
    body.coalesce(1).write.mode("overwrite").text(path)


def gpu_samples(lines: DataFrame) -> DataFrame:
    """One row for each device of JSON lines {ts, gpus: [{i, w, u, m, t}]}; broken lines are left out."""
    body = F.from_json("value", "ts timestamp, gpus array<struct<i:int,w:double,u:double,m:double,t:double>>")
    us = F.unix_micros("b.ts")
    rows = lines.select(body.alias("b")).where("b.ts IS NOT NULL").select((us * 1000).alias("ts_ns"), F.expr("unix_micros(b.ts) div 3600000000").alias("epoch_hour"), F.explode("b.gpus").alias("g"))
    return rows.select("epoch_hour", "ts_ns", F.col("g.i").alias("gpu_index"), F.col("g.w").alias("power_w"), F.col("g.u").alias("util_pct"), F.col("g.m").alias("mem_used_mb"), F.col("g.t").alias("temp_c"))


def newer(rows: DataFrame, target: DataFrame, column: str = "ts_ns") -> DataFrame:
    """Rows after the newest of the target; all rows if the target is empty."""
    last = target.agg(F.max(column)).first()[0]
    return rows if last is None else rows.where(F.col(column) > last)


def answers(responses: DataFrame, names: str = "names") -> DataFrame:
    """(id, column_name, code, confidence) from stored model responses.

    Takes off a code fence, then reads an array, an array inside other text,
    or single objects; a missing name is filled by position.
    """
    kind = "array<struct<column_name:string,category_code:string,confidence:double>>"
    text = F.regexp_replace(F.trim("response"), r"^```[a-z]*\n|\n```$", "")
    inner = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    objects = F.concat(F.lit("["), F.array_join(F.regexp_extract_all(text, F.lit(r"(\{[^{}]*\})"), F.lit(1)), ","), F.lit("]"))
    parsed = F.coalesce(F.when(text.startswith("["), F.from_json(text, kind)), F.when(inner != "", F.from_json(inner, kind)), F.from_json(objects, kind))
    rows = responses.select("id", names, F.posexplode(parsed).alias("place", "a"))
    by_place = F.try_element_at(F.col(names), F.col("place") + 1)
    return rows.select("id", F.coalesce(F.nullif("a.column_name", F.lit("")), by_place).alias("column_name"), F.col("a.category_code").alias("code"), F.coalesce("a.confidence", F.lit(0.0)).alias("confidence"))


class Package:
    """Tables as <folder>/<service>/<table>.parquet with a manifest table beside them.

    Every change writes a new version of the manifest; the newest counts.
    """

    SCHEMA = "service string, name string, path string, rows long, columns array<string>, source string, format string, version int"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def manifest(self) -> DataFrame:
        versions = list_files(self.spark, f"{self.folder}/MANIFEST", "v*")
        if not versions:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).json(max(versions, key=lambda p: int(p.rsplit("v", 1)[-1])))

    def ingest(self, df: DataFrame, service: str, name: str, source: str = "") -> None:
        """Write a table and its entry; of writers that clash each takes the next version, so no entry is lost."""
        path = f"{self.folder}/{service}/{name}.parquet"
        df.write.mode("overwrite").parquet(path)
        entry = self.spark.read.parquet(path).agg(F.count("*").alias("rows")).select(
            F.lit(service).alias("service"), F.lit(name).alias("name"), F.lit(path).alias("path"), "rows", F.array(*map(F.lit, df.columns)).alias("columns"), F.lit(source).alias("source"), F.lit(FORMAT).alias("format"),
        ).first().asDict()
        while True:
            version = self._version() + 1
            old = [r.asDict() for r in self.manifest().where(~((F.col("service") == service) & (F.col("name") == name))).collect()]  # a row for each table
            rows = sorted([*old, entry], key=lambda r: (r["service"], r["name"]))
            if self._commit(version, rows):
                return

    def _version(self) -> int:
        return max((int(p.rsplit("v", 1)[-1]) for p in list_files(self.spark, f"{self.folder}/MANIFEST", "v*")), default=0)

    def _commit(self, version: int, rows: list[dict]) -> bool:
        from varve.sources.commits import put_if_absent

        return put_if_absent(self.spark, f"{self.folder}/MANIFEST/v{version}", "".join(json.dumps({**r, "version": version}) + "\n" for r in rows))

    def init(self) -> None:
        """An empty manifest, unless there is one."""
        if not self._version():
            self._commit(1, [])

    def status(self) -> DataFrame:
        """One row: version, formats, services and tables; version 0 where no package is."""
        m = self.manifest()
        return m.agg(F.lit(self._version()).cast("long").alias("version"), F.array_join(F.array_sort(F.collect_set("format")), ",").alias("formats"), F.countDistinct("service").alias("services"), F.count("*").alias("tables"))

    def ingest_file(self, path: str, service: str, delimiter: str = ",", header: bool = True) -> None:
        kind = path.rsplit(".", 1)[-1].lower()
        sep = {"TAB": "\t", "\\t": "\t"}.get(delimiter, delimiter)
        df = self.spark.read.parquet(path) if kind == "parquet" else self.spark.read.csv(path, header=header, sep="\t" if kind == "tsv" else sep, inferSchema=True)
        self.ingest(df, service, stem(path), path)

    def services(self) -> DataFrame:
        return self.manifest().groupBy("service").agg(F.count("*").alias("tables"), F.sum("rows").alias("rows"))

    def verify(self) -> DataFrame:
        """(service, name, problem): manifest against what is there, both ways; empty if all is well."""
        m = self.manifest()
        there = [(p.rsplit("/", 2)[-2], stem(p)) for p in list_files(self.spark, self.folder, "*/*.parquet")]
        counts = [self.spark.read.parquet(f"{self.folder}/{s}/{n}.parquet").agg(F.lit(s).alias("service"), F.lit(n).alias("name"), F.count("*").alias("actual")) for s, n in there]
        actual = reduce(DataFrame.unionByName, counts) if counts else self.spark.createDataFrame([], "service string, name string, actual long")
        both = m.select("service", "name", "rows", "format").join(actual, ["service", "name"], "full_outer")
        problem = F.when(F.col("rows").isNull(), "not in the manifest").when(F.col("actual").isNull(), "missing").when(~F.col("format").startswith("logical-parquet"), "unknown format").when(F.col("rows") != F.col("actual"), "row count differs")
        return both.select("service", "name", problem.alias("problem")).where("problem IS NOT NULL")

    def sql(self, text: str) -> DataFrame:
        """SQL with each table as service__table."""
        for row in self.manifest().select("service", "name", "path").collect():
            self.spark.read.parquet(row.path).createOrReplaceTempView(f"{row.service}__{row.name}")
        return self.spark.sql(text)


class Catalog:
    """(db, table) -> type and parameters; KUDU and VIEW entries are served as views."""

    SCHEMA = "db string, name string, type string, parameters map<string,string>"

    def __init__(self, entries: DataFrame) -> None:
        last = Window.partitionBy("db", "name").orderBy(F.col("at").desc())
        self.entries = entries.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "at")

    def serve(self) -> list[str]:
        spark, names = self.entries.sparkSession, []
        for row in self.entries.where("type IN ('KUDU', 'VIEW')").orderBy(F.col("type") == "VIEW", "db", "name").collect():
            name = f"{row.db}__{row.name}"
            df = spark.read.parquet(row.parameters["path"]) if row.type == "KUDU" else spark.sql(row.parameters["sql"])
            df.createOrReplaceTempView(name)
            names.append(name)
        return names


def benchmark_columns(cells: DataFrame, targets: DataFrame, truth: DataFrame, first: int = 5, suffix: str = r"_[0-9]+$") -> DataFrame:
    """Column records of a benchmark's target columns, with their code where the truth has one.

    `cells` has table, row, ordinal, header, value; `targets` table and
    ordinal; `truth` key ("table.header", the table without its number) and
    code. Tables of fewer than two rows are left out; sample_values are the
    first non-blank ones by row.
    """
    big = cells.groupBy("table").agg(F.countDistinct("row").alias("rows")).where("rows >= 2").select("table")
    heads = cells.groupBy("table").agg(F.array_sort(F.collect_set(F.struct("ordinal", "header"))).alias("heads"))
    wanted = cells.join(targets, ["table", "ordinal"], "left_semi").join(big, "table", "left_semi")
    place = F.row_number().over(Window.partitionBy("table", "ordinal", "header").orderBy("row"))
    values = wanted.where(F.trim("value") != "").withColumn("_n", place).where(F.col("_n") <= first)
    sample = values.groupBy("table", "ordinal", "header").agg(F.array_sort(F.collect_list(F.struct("row", "value"))).alias("s"))
    columns = wanted.select("table", "ordinal", "header").distinct().join(sample, ["table", "ordinal", "header"], "left").join(heads, "table")
    name = F.regexp_replace("table", suffix, "")
    out = columns.select(
        name.alias("source_table"), F.col("header").alias("column_name"), F.coalesce(F.col("s.value"), F.array().cast("array<string>")).alias("sample_values"),
        F.filter(F.col("heads.header"), lambda h: h != F.col("header")).alias("sibling_columns"), F.concat(name, F.lit("."), "header").alias("key"),
    )
    return out.join(truth, "key", "left")


def write_classified(df: DataFrame, path: str, schema: dict[str, str]) -> DataFrame:
    """Write the columns of a fixed schema, cast to its types; missing ones are null."""
    have = set(df.columns)
    df.select(*((F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in schema.items())).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


# --- fixed values: columns of the classified table, in their order, and how many contributions it names
CLASSIFIED = {
    "embedding_text": "string", "source_table": "string", "column_name": "string", "sample_values": "string", "column_kind": "string", "tag_code": "string", "tag_label": "string", "tag_abbrev": "string",
    "confidence": "double", "boost": "double", "gt_code": "string", "correct": "string", "ml_tag_code": "string", "ml_tag_label": "string", "ml_confidence": "double", "ml_correct": "string",
    "belief": "double", "plausibility": "double", "uncertainty_gap": "double", "conflict": "double", "needs_clarification": "boolean", "evidence_sources": "string", "belief_path": "string",
}
TOP_CONTRIBUTIONS = 3
# --- end of fixed values


def classified_schema(features: tuple[str, ...]) -> dict[str, str]:
    """The base columns, then what each feature was (feat_) and how much it matters (sage_), then the largest contributions (shap_)."""
    out = CLASSIFIED | {f"feat_{f}": "string" for f in features} | {f"sage_{f}": "double" for f in features}
    for k in range(1, TOP_CONTRIBUTIONS + 1):
        out |= {f"shap_top{k}_name": "string", f"shap_top{k}_value": "double"}
    return out


def write_results(results: DataFrame, importance: DataFrame, contributions: DataFrame, path: str, features: tuple[str, ...]) -> DataFrame:
    """Classified columns with their importance and contributions under the fixed schema.

    importance: (feature, value), a row for each feature at most, the same for
    all columns; contributions: (source_table, column_name, place, name,
    value). What is missing is '', 0 or false.
    """
    key = ["source_table", "column_name"]
    tops = contributions.where(F.col("place") <= TOP_CONTRIBUTIONS).groupBy(*key).pivot("place", list(range(1, TOP_CONTRIBUTIONS + 1))).agg(F.first("name").alias("name"), F.first("value").alias("value"))
    for k in range(1, TOP_CONTRIBUTIONS + 1):
        tops = tops.withColumnsRenamed({f"{k}_name": f"shap_top{k}_name", f"{k}_value": f"shap_top{k}_value"})
    sage = importance.agg(*(F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f"sage_{f}") for f in features))
    schema = classified_schema(features)
    whole = results.join(tops, key, "left").crossJoin(F.broadcast(sage))
    empty = {"string": F.lit(""), "double": F.lit(0.0), "boolean": F.lit(False)}
    have = set(whole.columns)
    return write_classified(whole.select(*(F.coalesce(F.col(c).cast(kind), empty[kind]).alias(c) if c in have else empty[kind].alias(c) for c, kind in schema.items())), path, schema)


def uncertainty_summary(classified: DataFrame) -> DataFrame:
    """One row: mean gap and conflict of columns with any belief, how many of all need a question, and how many have a belief."""
    some = F.col("belief") > 0
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(some, F.col(c))), F.lit(0.0)), 4)
    return classified.agg(mean("uncertainty_gap").alias("avg_uncertainty_gap"), mean("conflict").alias("avg_conflict"), F.count_if("needs_clarification").alias("clarification_count"), F.count_if(some).alias("columns_evaluated"))


def run_report(classified: DataFrame) -> DataFrame:
    """One row: columns, share to clarify, mean conflict, and the distribution of codes as JSON."""
    codes = classified.groupBy("code").agg(F.count("*").alias("n")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n"))))).alias("codes"))
    figures = classified.agg(F.count("*").alias("columns"), F.round(F.avg(F.col("needs_clarification").cast("int")), 4).alias("clarify"), F.round(F.avg("conflict"), 4).alias("mean_conflict"))
    return figures.join(codes)
