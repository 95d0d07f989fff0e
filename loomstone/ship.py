"""Sends this package to the executors, once per Spark context, and bounds what passes to their Python workers at a time."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()
#: Texts may be long: Arrow batches are bounded by rows and by bytes.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20)}


def ship(spark: SparkSession) -> None:
    """Python workers may run on hosts without this repository: add the package as a zip."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parent
    if root.parent.suffix != ".zip":
        target = Path(tempfile.mkdtemp(prefix="loomstone-ship-")) / "loomstone_code.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*")):
                if p.suffix in {".py", ".json", ".txt"} and "__pycache__" not in p.parts:
                    z.write(p, f"{root.name}/{p.relative_to(root)}")
        sc.addPyFile(str(target))
    _SENT.add(sc.applicationId)


def ready(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``query(spark, ...)``, with the package sent to the executors first and Arrow batches kept small."""

    @functools.wraps(query)
    def run(spark: SparkSession, *rest) -> DataFrame:
        ship(spark)
        chosen = spark.conf.getAll  # what the session sets itself stays
        for name, value in _BATCHES.items():
            if name not in chosen:
                spark.conf.set(name, value)
        return query(spark, *rest)

    return run
