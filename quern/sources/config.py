"""Configuration files as rows: YAML and properties sources, a JSON view, and sinks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TREE = "source string, path string, is_mapping boolean, value string"


def flattened(node, prefix: str = "") -> Iterator[tuple[str, bool, str | None]]:
    """(path, is_mapping, value) of all nodes of a parsed tree; lists are JSON values."""
    import json

    if isinstance(node, dict):
        if prefix:
            yield prefix, True, None
        for k, v in node.items():
            yield from flattened(v, f"{prefix}.{k}" if prefix else str(k))
    else:
        yield prefix, False, json.dumps(node, ensure_ascii=False) if isinstance(node, list | bool) else None if node is None else str(node)


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """All nodes of YAML files, one row each. Files are read by Spark, whatever the store, and parsed in the tasks."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(frames):
        import pandas as pd
        import yaml

        for f in frames:
            rows = [(p, *n) for p, c in zip(f["path"], f["content"], strict=True) for n in flattened(yaml.safe_load(bytes(c)) or {})]
            yield pd.DataFrame(rows, columns=["source", "path", "is_mapping", "value"])

    return files.mapInPandas(parse, TREE)


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """key=value lines of properties files; comments and blank lines are left out."""
    lines = spark.read.text(path).select(F.input_file_name().alias("source"), F.ltrim("value").alias("line")).where("line <> '' and not line like '#%' and not line like '!%'")
    at = F.regexp_extract("line", r"^([^=:\s]+)\s*[=:]?\s*(.*)$", 1), F.regexp_extract("line", r"^([^=:\s]+)\s*[=:]?\s*(.*)$", 2)
    return lines.select("source", at[0].alias("path"), F.lit(False).alias("is_mapping"), at[1].alias("value"))


def as_json(tree: DataFrame) -> DataFrame:
    """One JSON object of path and value for each source."""
    leaves = tree.where(~F.col("is_mapping"))
    return leaves.groupBy("source").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "value"))))).alias("json"))


def write_lines(tree: DataFrame, path: str, header: str | None = None, if_missing: bool = False) -> None:
    """``path: value`` lines in order of the path. A header comes first in new files; with ``if_missing`` an existing target stays as it is."""
    lines = tree.where(~F.col("is_mapping")).select(F.lit(1).alias("o"), "path", F.concat_ws(": ", "path", F.coalesce("value", F.lit("null"))).alias("value"))
    if header:
        lines = lines.unionByName(tree.sparkSession.createDataFrame([(0, "", "# " + header)], lines.schema))
    lines.orderBy("o", "path").select("value").coalesce(1).write.mode("ignore" if if_missing else "overwrite").text(path)


def yaml_lines(tree: DataFrame) -> DataFrame:
    """(parts, value): a tree as lines of nested YAML, one for each path, to be put in the order of ``parts``.

    A path's mappings come before what they hold, since its parts are the beginning of theirs. Values are quoted strings.
    """
    parts = F.split("path", r"\.")
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace("value", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    key = F.concat(F.repeat(F.lit("  "), F.size("parts") - 1), F.lit('"'), F.element_at("parts", -1), F.lit('":'))
    shown = F.when(F.col("is_mapping"), key).otherwise(F.concat(key, F.lit(" "), F.coalesce(quoted, F.lit("null"))))
    return tree.withColumn("parts", parts).select("parts", shown.alias("value"))


def write_yaml(tree: DataFrame, path: str, header: str | None = None, if_missing: bool = False) -> None:
    """A tree (path, is_mapping, value) as one nested YAML file in a folder. A header comes first in new files; with
    ``if_missing`` an existing target stays as it is. A configuration is small: one task writes it, as one file."""
    lines = yaml_lines(tree)
    if header and not _exists(tree.sparkSession, path):
        lines = lines.unionByName(tree.sparkSession.createDataFrame([([], "# " + header)], "parts array<string>, value string"))
    lines.repartition(1).sortWithinPartitions("parts").select("value").write.mode("ignore" if if_missing else "overwrite").text(path)


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def _replaced(spark: SparkSession, tree: DataFrame, path: str) -> None:
    """Write a tree that depends on the files at ``path`` beside them, and then in their place."""
    write_yaml(tree, path + ".new")
    fs, at = _path(spark, path)
    fs.delete(at, True)
    if not fs.rename(_path(spark, path + ".new")[1], at):
        raise OSError(f"{path}.new could not be renamed")


def load_reconciled(spark: SparkSession, path: str, schema: DataFrame) -> DataFrame:
    """The configuration at ``path`` in the shape of ``schema`` (path, is_mapping, value): paths that the file lacks, or has as the
    other kind of node, are added with their defaults, unknown ones go, other values stay. The file is written again
    and read; a missing or empty one is filled with the defaults."""
    from ..operators.trees import with_defaults

    if not _exists(spark, path):
        write_yaml(schema, path)
    else:
        file = read_yaml(spark, path)
        same = file.join(schema.select("path", F.col("is_mapping").alias("__m")), "path").where("is_mapping = __m").select("path", "is_mapping", "value")
        _replaced(spark, with_defaults(same, schema), path)
    return read_yaml(spark, path)


def save_in_place(spark: SparkSession, path: str, memory: DataFrame) -> None:
    """Write the file at ``path`` again with the values that ``memory`` has for its paths; paths that it lacks are not added."""
    from ..operators.trees import overlay

    _replaced(spark, overlay(read_yaml(spark, path).drop("source"), memory), path)


def decoded(document: Column, fields: dict[str, tuple[str, object]]) -> Column:
    """A struct of the given fields (name to type and default) from a JSON object; absent and null ones have their defaults."""
    parsed = F.from_json(document, ", ".join(f"{n} {kind}" for n, (kind, _) in fields.items()))
    return F.struct(*(F.coalesce(parsed[n], F.lit(default).cast(kind)).alias(n) for n, (kind, default) in fields.items()))


def write_first(df: DataFrame, targets: list[str]) -> str:
    """Write to the first target that can be reached; the one that was used."""
    for k, target in enumerate(targets):
        try:
            df.write.parquet(target)
            return target
        except Exception:
            if k + 1 == len(targets):
                raise
    raise ValueError("no target")


def latest_build(document: Column) -> Column:
    """The highest ``build`` of a JSON list of builds; null for an empty list."""
    return F.array_max(F.transform(F.from_json(document, "array<struct<build:long>>"), lambda b: b["build"]))


def cpu_topology(spark: SparkSession, path: str = "/proc/cpuinfo") -> DataFrame:
    """(processor, key, value) of a text file of ``key : value`` blocks; without the file, one unknown processor."""
    fs, at = _path(spark, path)
    if not fs.globStatus(at):
        return spark.createDataFrame([(-1, "processor", "unknown")], "processor int, key string, value string")
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), r"\n\n+")).alias("processor", "block"))
    each = text.select("processor", F.explode(F.split("block", "\n")).alias("line")).where(F.contains("line", F.lit(":")))
    return each.select("processor", F.trim(F.regexp_replace(F.substring_index("line", ":", 1), r"\s+", " ")).alias("key"), F.trim(F.regexp_replace("line", r"^[^:]*:", "")).alias("value"))


def old_files(spark: SparkSession, path: str, glob: str = "*", before: str | None = None) -> DataFrame:
    """(path, modified, length) of the files directly in a folder that match a glob and were last changed before a moment. Nothing is deleted."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(path)
    out = files.select("path", F.col("modificationTime").alias("modified"), "length")
    return out.where(F.col("modified") < F.lit(before).cast("timestamp")) if before else out
