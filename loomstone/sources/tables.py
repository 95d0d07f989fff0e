"""Readers and sinks for function tables: JSON objects by id, split files, lists, repository information."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import keep_benchmark, last_wins

FLAGS = ("system", "macro", "macro_exp", "vendor", "non_function", "decl")
FUNCTION = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "name", "path", "doc", "code", "context", "macro_code", "synth_doc")]
    + [T.StructField("to", T.ArrayType(T.StringType()))]
    + [T.StructField(c, T.BooleanType()) for c in FLAGS]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("sufficiency_claims", "illegal_facts")]
)


def _rows(texts: DataFrame, content: Column, *extra: str) -> DataFrame:
    """Rows of a JSON object by id, in order of appearance (``ord``); a row's own id wins over its key."""
    by_id = F.from_json(content, T.MapType(T.StringType(), FUNCTION))
    rows = texts.select(*extra, F.posexplode(F.map_entries(by_id)).alias("ord", "e"))
    own = [F.col(f"e.value.{c}").alias(c) for c in FUNCTION.names if c != "id"]
    return rows.select(*extra, F.coalesce("e.value.id", "e.key").alias("id"), F.col("ord").cast("long").alias("ord"), *own)


def read_functions(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file: ``{id: row}``, ``{"test": ...}`` with either layout inside, or a list of rows."""
    text = spark.read.text(path, wholetext=True)
    inner = F.coalesce(F.get_json_object("value", "$.test"), F.col("value"))
    text = text.withColumn("value", inner).withColumn("list", F.ltrim("value").startswith("["))
    listed = text.where("list").select(F.posexplode(F.from_json("value", T.ArrayType(FUNCTION))).alias("ord", "r"))
    listed = listed.select(F.col("r.id").alias("id"), F.col("ord").cast("long").alias("ord"), *[F.col(f"r.{c}").alias(c) for c in FUNCTION.names if c != "id"])
    return _rows(text.where("NOT list"), F.col("value")).unionByName(listed)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """``{split: {id: row}}`` with a ``split`` column."""
    text = spark.read.text(path, wholetext=True)
    parts = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("split", "value"))
    return _rows(parts, F.col("value"), "split")


def read_repositories(spark: SparkSession, folder: str, name: str = "raw_dataset.json") -> DataFrame:
    """Every ``<repo>/0/<name>`` below ``folder``, with ``repo`` the folder two levels up."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(folder, wholetext=True)
    text = text.select("value", F.regexp_extract("_metadata.file_path", r"([^/]+)/0/[^/]+$", 1).alias("repo")).where("repo <> ''")
    return _rows(text, F.col("value"), "repo")


def read_benchmarks(spark: SparkSession, folder: str, name: str = "random_test_dataset.json") -> DataFrame:
    """Rows of every file ``name`` below ``folder``, ``{id: row}`` with or without ``{"test": ...}`` around it; of rows with one id that of the last file (by path) stays, whole."""
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(folder, wholetext=True)
    inner = F.coalesce(F.get_json_object("value", "$.test"), F.col("value"))
    texts = texts.select(inner.alias("value"), F.col("_metadata.file_path").alias("file"))
    return last_wins(_rows(texts, F.col("value"), "file"), "id", "file")


def read_information(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


def read_columns(spark: SparkSession, path: str, columns: list[str], head: int | None = None) -> DataFrame:
    """``{column: [values]}`` as rows, the first ``head`` of them."""
    lists = spark.read.text(path, wholetext=True).select(F.from_json("value", T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in columns])).alias("d"))
    rows = lists.select(F.posexplode(F.arrays_zip(*[F.col(f"d.{c}").alias(c) for c in columns])).alias("ord", "r")).select("ord", "r.*")
    return rows.orderBy("ord").limit(head) if head is not None else rows


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """A table by the ending of its path: ``.json`` in any of the layouts above, ``.jsonl`` one row a line, else Parquet."""
    if path.endswith(".jsonl"):
        return spark.read.json(path)
    if not path.endswith(".json"):
        return spark.read.parquet(path)
    keys = F.filter(F.json_object_keys("value"), lambda k: ~k.isin("train", "test"))
    text = spark.read.text(path, wholetext=True).where(~F.ltrim("value").startswith("["))
    by_split = text.where((F.size(keys) == 0) & F.get_json_object("value", "$.train").isNotNull()).take(1)
    return read_splits(spark, path) if by_split else read_functions(spark, path)


def write_rows(df: DataFrame, path: str, over: bool = False) -> None:
    """``.json`` and ``.jsonl``: a folder of JSON lines; else Parquet. Fails if ``path`` is there, unless ``over``."""
    (write_over if over else write_new)(df, path, "json" if path.endswith((".json", ".jsonl")) else "parquet")


def write_object(df: DataFrame, path: str, key: str = "id", over: bool = False) -> None:
    """One JSON object ``{key: row}``, rows by ``ord`` and key, as a single text file in the folder ``path``.

    For tables that are exchanged as one file.  Rows are sorted over all
    partitions and one task writes them as they come, a line each.
    """
    others = [c for c in df.columns if c != key]
    order = [c for c in ("ord", key) if c in df.columns]
    rows = df.orderBy(*order).select(F.to_json(F.struct(F.col(key).cast("string").alias("k"))).alias("k"), F.to_json(F.struct(*others), {"ignoreNullFields": "false"}).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "{"
        for b in batches:
            lines = []
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lines.append(f"{mark}{json.dumps(json.loads(k).get('k'))}: {v}")
                mark = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["}"])], names=["value"])

    lines = df.sparkSession.range(1, numPartitions=1).select(F.lit("{}").alias("value")) if rows.isEmpty() else rows.coalesce(1).mapInArrow(run, "value string")
    lines.write.mode("overwrite" if over else "errorifexists").text(path)


def as_array(df: DataFrame, key: str = "test") -> DataFrame:
    """Rows as a list under ``key``: in order, with their id first and ``split`` naming the list. The whole is sorted over all partitions."""
    return df.drop("split").withColumn("split", F.lit(key)).orderBy("ord", "id").select("split", "id", *[c for c in df.columns if c not in ("split", "id")])


def write_predictions(df: DataFrame, benchmark: DataFrame, full: str, short: str) -> None:
    """All rows to ``full``; to ``short`` those of the benchmark outside ``train``. A name that differs from the benchmark's raises ValueError before anything is written."""
    tests = df.where("split <> 'train'") if "split" in df.columns else df
    marked = keep_benchmark(tests, benchmark)
    write_rows(df, full, over=True)
    write_rows(marked, short, over=True)


def write_new(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Fails if ``path`` is there already."""
    df.write.format(kind).mode("errorifexists").save(path)


def write_over(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.format(kind).mode("overwrite").save(path)


def replace_splits(df: DataFrame, path: str) -> None:
    """Parquet by ``split``: the splits of ``df`` replace those at ``path``, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split").parquet(path)
