"""Helpers that the operators of this subpackage share.

* :func:`save` cuts lineage by writing a Parquet table into the folder that the
  cluster shares (``spark.checkpoint.dir``), so a lost executor only costs the
  tasks that were running on it;
* :func:`need` rejects inputs that lack a column, :func:`free_name` finds column
  names that do not clash with the caller's.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASCII_SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode, where the session may name none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomstone-ckpt-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def save(df: DataFrame, kind: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that :func:`save` returned and that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"input lacks column(s) {', '.join(missing)}; it has {', '.join(df.columns)}")


def free_name(df: DataFrame, stem: str) -> str:
    """``stem``, with underscores in front until no column of ``df`` has that name (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo ``modulus``; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame, limit: int, key: Column, *ties: Column | str) -> DataFrame:
    """At most ``limit`` rows, the first by ``key`` (a 64-bit hash of what tells rows apart) and ``ties``: a documented bound for fitting models.

    Of many rows, those with a large hash are left out beforehand, so that no
    partition brings ``limit`` rows to the last sort.  How many is found from the
    number of *different* hashes, so repeated rows never thin out the others.
    """
    n = df.agg(F.approx_count_distinct(key, 0.02)).first()[0]
    if n > 2 * limit:
        df = df.where(key < F.lit(int(-(2**63) + 2**64 * min(0.999, (1.5 * limit + 100) / n))))
    return df.orderBy(key, *ties).limit(limit)


def labels_by_id(labels: DataFrame, id_col: str, label_col: str, trainable: Column) -> DataFrame:
    """``__id, __y`` of the ids for which ``trainable`` holds and that have the label 0 or 1, once each; ids with both labels are left out."""
    need(labels, id_col, label_col)
    y = F.col(label_col).cast("int")
    known = labels.where(y.isin(0, 1) & trainable & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(y).alias("__y"), F.max(y).alias("most"))
    return known.where("__y = most").select("__id", "__y")


def without(df: DataFrame, *added: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add: its own replace them."""
    low = {a.lower() for a in added}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def map_text(df: DataFrame, text_col: str, carry: list[str], fields: list[tuple[str, str]], make: Callable[[], Callable[[list[str | None]], list[pa.Array]]], rows: int = 256) -> DataFrame:
    """Columns ``carry`` and the new ``fields`` (name, type) of every row, in one pass without a shuffle.

    ``make`` runs once in each task and returns a function from a list of texts
    to one Arrow array per field; it gets at most ``rows`` texts at a time.  A
    carried column named like a new field is left out.
    """
    need(df, text_col, *carry)
    new = {n.lower() for n, _ in fields}
    carry = [c for c in carry if c.lower() not in new]
    text = F.col(text_col).cast("string")
    passed = df.select(text.alias("t"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)])
    inner = [f"c{k}" for k in range(len(carry))] + [f"f{k}" for k in range(len(fields))]
    plain = [k for k, c in enumerate(carry) if c == text_col and df.schema[c].dataType.simpleString() == "string"]
    if plain:  # the text goes once through the pipe
        passed = passed.drop(f"c{plain[0]}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), rows):
                part = batch.slice(at, rows)
                out = [part.column("t") if k in plain else part.column(f"c{k}") for k in range(len(carry))]
                yield pa.RecordBatch.from_arrays([*out, *f(part.column("t").to_pylist())], names=inner)

    kinds = [df.schema[c].dataType for c in carry]
    schema = T.StructType([T.StructField(f"c{k}", t) for k, t in enumerate(kinds)] + [T.StructField(f"f{k}", T._parse_datatype_string(t)) for k, (_, t) in enumerate(fields)])
    return passed.mapInArrow(run, schema).toDF(*carry, *[n for n, _ in fields])
