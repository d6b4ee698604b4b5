"""Execution traces from JSON lines or from plain logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The marks of the log format.
_METHOD = r"\[([A-Za-z0-9_.]+\.[A-Za-z0-9_]+)\]"
_VARIABLE = r"Variable '([^']+)'\s+\(Type:\s+[^)]+\)\s+=\s+(.*)$"
_RESULT = r"\] RESULT \| (.*)$"


def json_steps(spark: SparkSession, path: str) -> DataFrame:
    """(method, params, sql) of JSON lines, or of a file that holds one array."""
    return spark.read.schema("method string, params map<string,string>, sql string").option("multiLine", True).json(path)


def log_steps(lines: DataFrame) -> DataFrame:
    """(file, step, method, params, sql) of logs, a row a line (file, line_no, line).

    A START line with a dotted method opens a step, an insert line is a step of its own and closes the one before;
    variables and results up to the next step are its params, the last of a name counts. Lines before the first step and
    after an insert belong to none. One window a file numbers the steps; nothing is gathered but the params of a step.
    """
    method = F.regexp_extract("line", _METHOD, 1)
    insert = F.col("line").contains("===== EF INSERT =====")
    start = F.col("line").rlike(r" START |\] START") & (method != "") & ~method.endswith(".cs") & ~insert
    marked = lines.where(F.trim("line") != "").withColumn("opens", (start | insert).cast("int")).withColumn("m", F.when(insert, F.lit("Database.Insert")).when(start, method)).withColumn("q", F.when(insert, F.col("line")))
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.withColumn("step", F.sum("opens").over(w)).where("step > 0")
    name = F.when(F.col("line").rlike(_VARIABLE), F.regexp_extract("line", _VARIABLE, 1)).when(F.col("line").rlike(_RESULT), F.lit("return_value"))
    value = F.when(F.col("line").rlike(_VARIABLE), F.regexp_extract("line", _VARIABLE, 2)).otherwise(F.regexp_extract("line", _RESULT, 1))
    head = numbered.where("opens = 1").select("file", "step", F.col("m").alias("method"), F.col("q").alias("sql"))
    params = numbered.where("opens = 0").select("file", "step", "line_no", name.alias("k"), value.alias("v")).where("k is not null").groupBy("file", "step", "k").agg(F.max_by("v", "line_no").alias("v"))
    maps = params.groupBy("file", "step").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("params"))
    j = head.join(maps, ["file", "step"], "left")
    return j.select("file", "step", "method", F.when(F.col("sql").isNull(), F.coalesce("params", F.create_map().cast("map<string,string>"))).alias("params"), "sql")


def resolve_steps(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Steps with the node their method names: by its last part, first one in a file that names the class; null for none."""
    parts = F.split("method", r"\.")
    s = steps.withColumn("name", F.element_at(parts, -1)).withColumn("cls", F.try_element_at(parts, F.lit(-2)))
    n = nodes.select("id", "name", "file_path")
    j = s.join(n, "name", "left")
    w = Window.partitionBy("file", "step").orderBy(F.coalesce(F.contains("file_path", F.col("cls")), F.lit(False)).desc(), F.col("id").asc_nulls_last())
    return j.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("file", "step", "method", "params", "sql", "id")
