"""Brings this package to the executors, so that a session needs no further setting."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source once for each application; workers import it from there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="coverline-"), f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(PACKAGE.rglob("*.py")):
            z.write(file, file.relative_to(PACKAGE.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package sent before it runs."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary one; on a cluster
    it is an error, as there is no other folder that all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="coverline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")
