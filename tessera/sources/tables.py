"""Sources, sinks and changes of tables.

Tables without transactions are changed by writing the new state beside the old and swapping names; a
reader between the two renames finds no table, and two writers at once are not kept apart.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rel import Fields, Rel


#: The setting that names what a session may do, separated by commas; unset or empty: everything.
CAPABILITIES = "tessera.capabilities"


class NotSupported(RuntimeError):
    """The session may not use this capability."""


class Capabilities:
    """What a session may do: names such as ``sql::raw``, or ``sql`` for all of that module; all if no names are given."""

    def __init__(self, *names: str) -> None:
        self.names = set(names)

    @classmethod
    def of(cls, spark: SparkSession) -> Capabilities:
        return cls(*[x for x in (spark.conf.get(CAPABILITIES, None) or "").split(",") if x])

    def grant(self, spark: SparkSession) -> None:
        """Sources, sinks and host functions of this session are held to these names from here on."""
        spark.conf.set(CAPABILITIES, ",".join(sorted(self.names)))

    def require(self, name: str) -> None:
        if self.names and name not in self.names and name.partition("::")[0] not in self.names:
            raise NotSupported(name)


def _require(spark: SparkSession, name: str) -> None:
    Capabilities.of(spark).require(name)


def _name(name: str) -> str:
    """``schema/table`` is split at the first slash."""
    return ".".join(f"`{x}`" for x in name.split("/", 1))


def from_table(spark: SparkSession, name: str, columns: Iterable[str] | None = None) -> Rel:
    """A table's rows, in no order; ``columns`` are those of the declared row type."""
    _require(spark, "sql::from")
    df = spark.table(_name(name))
    return Rel(df.select(*columns) if columns is not None else df)


def raw(spark: SparkSession, sql: str, schema: str | T.StructType | None = None, **parameters: object) -> Rel:
    """The rows of any SQL text, cast to the declared schema; parameters are named (``:name``), scalars or arrays (lists); for others see ``with_parameters``."""
    _require(spark, "sql::raw")
    parameters = {k: F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else v for k, v in parameters.items()}
    df = spark.sql(sql, args=parameters or None)
    if schema is not None:
        kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        df = df.select(*[F.col(f"`{old}`").cast(f.dataType).alias(f.name) for old, f in zip(df.columns, kind.fields, strict=True)])
    return Rel(df)


def insert(rows: Rel | DataFrame, name: str) -> None:
    """Append by column name."""
    df = rows.frame() if isinstance(rows, Rel) else rows
    _require(df.sparkSession, "sql::insert")
    df.sparkSession.table(_name(name)).select(*df.columns)
    df.writeTo(_name(name)).append() if _is_v2(df.sparkSession, name) else _append(df, name)


def _is_v2(spark: SparkSession, name: str) -> bool:
    return False if spark.catalog.currentCatalog() == "spark_catalog" else True


def _append(df: DataFrame, name: str) -> None:
    target = df.sparkSession.table(_name(name))
    missing = [c for c in target.columns if c not in df.columns]
    df.withColumns({c: F.lit(None).cast(target.schema[c].dataType) for c in missing}).select(*target.columns).write.insertInto(_name(name))


def _replace(spark: SparkSession, name: str, new: DataFrame) -> None:
    own = _name(name)
    staged = f"{own[:-1]}__{uuid.uuid4().hex[:8]}`"
    old = f"{own[:-1]}__old_{uuid.uuid4().hex[:8]}`"
    new.write.saveAsTable(staged.replace("`", ""), format="parquet")
    spark.sql(f"ALTER TABLE {own} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {staged} RENAME TO {own}")
    spark.sql(f"DROP TABLE {old}")


def update(spark: SparkSession, name: str, when: Callable[[Fields], Column], new: Callable[[Fields], dict[str, Column]]) -> None:
    """Rows where ``when`` holds get the columns of ``new``; the others stay."""
    _require(spark, "sql::update")
    rel = Rel(spark.table(_name(name)))
    fits, changed = F.coalesce(when(rel.rows), F.lit(False)), new(rel.rows)
    kinds = {f.name: f.dataType for f in rel.df.schema}
    _replace(spark, name, rel.df.select(*[(F.when(fits, changed[c]).otherwise(F.col(c)).cast(kinds[c]) if c in changed else F.col(c)).alias(c) for c in rel.df.columns]))


def delete(spark: SparkSession, name: str, when: Callable[[Fields], Column]) -> None:
    _require(spark, "sql::delete")
    rel = Rel(spark.table(_name(name)))
    _replace(spark, name, rel.df.where(~F.coalesce(when(rel.rows), F.lit(False))))


class Files:
    """Parquet files under a root; paths that lead out of it are refused."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        inner = posixpath.normpath(name)
        if inner.startswith(("/", "..")):
            raise PermissionError(name)
        return f"{self.root}/{inner}"

    def read_parquet(self, name: str, schema: T.StructType | None = None) -> Rel:
        _require(self.spark, "fs::read_parquet")
        reader = self.spark.read
        return Rel((reader.schema(schema) if schema is not None else reader).parquet(self.path(name)))

    def write_parquet(self, rows: Rel, name: str, single: bool = False) -> None:
        """zstd files in the relation's order; ``single``: one file (for small results)."""
        _require(self.spark, "fs::write_parquet")
        df = rows.frame(ordered=bool(rows.order))
        (df.coalesce(1) if single else df).write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))

    def pull(self, name: str) -> dict[str, str]:
        """Column types as declarations; a column is an option only if it holds nulls (all rows are read)."""
        df = self.spark.read.parquet(self.path(name))
        nulls = df.agg(*[F.coalesce(F.bool_or(F.col(f"`{c}`").isNull()), F.lit(False)).alias(c) for c in df.columns]).first()
        return {f.name: declared(f.dataType) + ("?" if nulls[f.name] else "") for f in df.schema}


_DECLARED = {T.BooleanType: "Bool", T.ByteType: "Int8", T.ShortType: "Int16", T.IntegerType: "Int32", T.LongType: "Int64", T.FloatType: "Float32", T.DoubleType: "Float64", T.StringType: "Text", T.DateType: "Date", T.TimestampNTZType: "Timestamp", T.TimestampType: "Timestamp", T.DayTimeIntervalType: "Duration", T.DecimalType: "Decimal"}


def declared(kind: T.DataType) -> str:
    """The declaration of a Spark type; types without one are refused."""
    if isinstance(kind, T.ArrayType):
        return f"[{declared(kind.elementType)}]"
    if isinstance(kind, T.StructType):
        return "{" + ", ".join(f"{f.name}: {declared(f.dataType)}" for f in kind) + "}"
    if type(kind) not in _DECLARED:
        raise NotSupported(f"type {kind.simpleString()}")
    return _DECLARED[type(kind)]


def pull_table(spark: SparkSession, name: str) -> dict[str, str]:
    """Column types of a table as declarations; columns that may be null are options."""
    return {f.name: declared(f.dataType) + ("?" if f.nullable else "") for f in spark.table(_name(name)).schema}


def to_arrow(rows: Rel) -> pa.Table:
    return rows.frame(ordered=True).toArrow()


def from_arrow(spark: SparkSession, table: pa.Table) -> Rel:
    return Rel(spark.createDataFrame(table))


def write_csv(rows: Rel, path: str, **options: str) -> None:
    rows.frame(ordered=True).write.mode("overwrite").options(**{"header": "true", **options}).csv(path)


def show(rows: Rel, n: int = 20) -> str:
    """The first rows as a text table."""
    return rows.frame(ordered=True)._jdf.showString(n, 0, False)


def with_parameters(spark: SparkSession, values: Mapping[str, object], schema: str | T.StructType) -> Rel:
    """Query parameters of any type (tagged unions are tuples of the tag and the payloads) as a relation of one row."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return Rel.literal(spark, [tuple(values[f.name] for f in kind.fields)], kind)
