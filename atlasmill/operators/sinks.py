"""Sinks: JSON Lines without NaN, CSV reports, insert-or-ignore by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def finite(value: Column, kind: T.DataType) -> Column:
    """Whether no number in the value, however deep, is NaN or infinite."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(~F.isnan(value) & (F.abs(value) != float("inf")), F.lit(True))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.forall(value, lambda x: finite(x, kind.elementType)), F.lit(True))
    if isinstance(kind, T.MapType):
        return F.coalesce(F.forall(F.map_values(value), lambda x: finite(x, kind.valueType)), F.lit(True))
    out = F.lit(True)
    if isinstance(kind, T.StructType):
        for f in kind:
            out &= finite(value[f.name], f.dataType)
    return out


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON Lines; a NaN or infinite number anywhere in a row stops the job."""
    for f in df.schema.fields:
        x = F.col(f"`{f.name}`")
        df = df.withColumn(f.name, F.when(~finite(x, f.dataType), F.raise_error(F.lit(f"not finite: {f.name}")).cast(f.dataType)).otherwise(x))
    df.write.mode(_mode(overwrite)).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """CSV with a header; nested columns as JSON text, null as the empty field."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    out = df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])
    out.write.mode(_mode(overwrite)).option("header", "true").option("nullValue", "").option("escape", '"').csv(path)


def insert_missing(df: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key the table at path does not hold yet; of several with one key that of the least hash."""
    spark = df.sparkSession
    hashed = [f"`{f.name}`" for f in df.schema if "map<" not in f.dataType.simpleString()]
    first = Window.partitionBy(key).orderBy(F.xxhash64(*hashed))
    new = df.withColumn("_place", F.row_number().over(first)).where("_place = 1").drop("_place")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    new.select(*df.columns).write.mode("append").parquet(path)
