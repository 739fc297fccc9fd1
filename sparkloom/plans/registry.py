"""The catalogue of queries: a plan, and DuckDB SQL that says the same."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import load

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLE_SQL: dict[str, str] = {}


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # not stopped
        own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


@cache
def _own_folder() -> str:
    """A folder of this program, for masters whose executors are all on this machine."""
    own = tempfile.mkdtemp(prefix="sparkloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


class Tables:
    """Tables of one folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def scratch(self, label: str) -> str:
        """A path of its own for what a plan has to write and read back; it goes when the program ends."""
        base = self.spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not self.spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
            base = _own_folder()
        path = f"{base.rstrip('/')}/sparkloom-{label}-{uuid.uuid4().hex}"
        atexit.register(_delete, self.spark, path)
        return path

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Plan]:
    """Register a plan over Tables under its own name, with SQL where there is any."""

    def register(f: Callable[[Tables], DataFrame]) -> Plan:
        def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        plan.__name__, plan.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = plan
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return plan

    return register
