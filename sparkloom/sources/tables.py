"""Typed loading of Parquet tables and CSV files, with errors that say what is wrong."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class LoadError(Exception):
    """A table could not be loaded."""


class MissingFileError(LoadError):
    """There is nothing at the path."""


class MalformedFileError(LoadError):
    """What is there cannot be read with the schema."""


class SchemaError(LoadError):
    """Columns are missing, or there are no rows."""


#: Least columns of the star schema's tables and of the text tables.
COLUMNS = {
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
    "labels": ("doc_id", "quality", "toxic"),
    "embeddings": ("vec_id", "embedding", "label"),
    "pages": ("page_id", "url", "html"),
    "benchmark": ("item_id", "text"),
    "conversations": ("conv_id", "turn", "role", "text"),
}


def require_columns(df: DataFrame, names: Sequence[str], label: str) -> DataFrame:
    """df, or a SchemaError that lists what is missing; further columns are allowed."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise SchemaError(f"{label}: missing columns {', '.join(missing)}")
    return df


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name, checked for its columns."""
    path = f"{sf_dir}/{name}.parquet"
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        raise MissingFileError(f"{name}: nothing to read at {path}") from e
    return require_columns(df, COLUMNS.get(name, ()), name)


def reads_as(spark: SparkSession, path: str, encoding: str) -> bool:
    """Whether files are text in an encoding. UTF-8 is checked strictly, over all lines;
    encodings of one byte a character read anything."""
    if encoding.upper().replace("-", "") != "UTF8":
        return True
    return not spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1).count()


def load_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    required: Sequence[str] = (),
    sep: str = ",",
    null: str = "",
    encodings: Sequence[str] = ("UTF-8",),
    check: bool = True,
) -> DataFrame:
    """Typed CSV with a header. Fails on absent files, bad cells, no rows, missing columns.

    Header names are stripped, a byte order mark is dropped, and the first of the
    encodings in which the files are text is used. With check, every cell is read once
    here, so that a bad one shows now and not in a later query.
    """
    options = {"header": True, "sep": sep, "nullValue": null, "mode": "FAILFAST", "enforceSchema": False}
    try:
        encoding = next((e for e in encodings if reads_as(spark, path, e)), None)
        if encoding is None:
            raise MalformedFileError(f"{path}: in none of the encodings {', '.join(encodings)}")
        header = spark.read.options(header=True, sep=sep, encoding=encoding).csv(path).columns
        names = [c.lstrip("\ufeff").strip() for c in header]
        kinds = {f.name: f.dataType for f in schema.fields}
        missing = [n for n in (*required, *kinds) if n not in names]
        if missing:
            raise SchemaError(f"{path}: missing columns {', '.join(dict.fromkeys(missing))}")
        shape = T.StructType([T.StructField(h, kinds.get(n, T.StringType())) for h, n in zip(header, names, strict=True)])
        df = spark.read.schema(shape).options(**options, encoding=encoding).csv(path).toDF(*names)
        if not df.limit(1).collect():
            raise SchemaError(f"{path}: no rows")
        if check:
            df.write.format("noop").mode("overwrite").save()
        return df
    except AnalysisException as e:
        raise MissingFileError(f"nothing to read at {path}") from e
    except (PySparkException, Py4JJavaError) as e:
        raise MalformedFileError(f"{path}: {str(e)[:200]}") from e


def load_text_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV whose columns all stay strings."""
    return spark.read.options(header=True, sep=sep, inferSchema=False).csv(path)


def coerce_numeric(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns as doubles; what is no number becomes null."""
    return df.withColumns({n: F.expr(f"try_cast(`{n}` as double)") for n in names})


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """The canonical empty table of a schema."""
    return spark.createDataFrame([], schema)


#: Bytes of the longest file that a task digests whole; longer ones are streamed.
WHOLE_FILE = 1 << 30


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of all raw files below a path.

    Files are read and digested in tasks, side by side. Only empty files, those beyond ``WHOLE_FILE`` and those
    with hidden names (a leading _ or ., which Spark's readers pass over) are streamed in small
    chunks by the driver.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, rows, whole = fs.listFiles(root, True), [], 0
    above = len(root.toUri().getPath().rstrip("/"))
    while found.hasNext():
        file = found.next()
        inside = file.getPath().toUri().getPath()[above:].split("/")
        if 0 < file.getLen() <= WHOLE_FILE and not any(part[:1] in ("_", ".") for part in inside if part):
            whole += 1
            continue
        stream = fs.open(file.getPath())
        try:
            digest = jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()
        rows.append((file.getPath().toString(), file.getLen(), digest))
    streamed = spark.createDataFrame(rows, "path string, length long, sha256 string")
    if not whole:
        return streamed
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.filter(F.col("length") <= WHOLE_FILE).select("path", "length", F.sha2("content", 256).alias("sha256")).unionByName(streamed)
