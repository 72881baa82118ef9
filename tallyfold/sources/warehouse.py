"""Stored tables: types, layout and writes.

A table is a Parquet folder split by one column (fiscal year, or a block of
ids). Replacing the partitions a change touches is the only kind of update:
rows are staged first, then the touched partitions are overwritten from the
stage, so a lost executor or a repeated run leaves the same table and no job
overwrites what it is reading.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.operators.merge import merge_df
from tallyfold.session import new_name, new_scratch
from tallyfold.sources.schemas import IDS, OPERATIONAL, PARTITIONS, WAREHOUSE

# Ids per partition of a table split by id, and the name a folder
# of rows without a partition value has.
ID_BLOCK = 1_000_000
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def to_warehouse_types(df: DataFrame) -> DataFrame:
    """Decimals become doubles, dates and timestamps text; the rest stays."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            col = col.cast("double")
        elif isinstance(field.dataType, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.TimestampType | T.TimestampNTZType):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif not isinstance(field.dataType, T.BooleanType | T.NumericType | T.StringType):
            col = col.cast("string")
        out.append(col.alias(field.name))
    return df.select(*out)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """The frame written to the shared folder and read back: what follows
    starts from stored rows and does not compute it again."""
    path = new_scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder_value(column: str) -> Column:
    """A text partition column as its folders name it, so never null. A write
    sorts rows that do not come in this order."""
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(NULL_FOLDER))


def replace_folder(df: DataFrame, root: str, column: str, value: str) -> None:
    """``df`` as the whole content of one partition folder of ``root``, under
    the name a partitioned write gives it. It is written beside the folder and
    takes its place when complete; rows pass no partition writer."""
    spark = df.sparkSession
    catalog = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    beside = new_name(f"{root}/.staging")
    df.write.parquet(beside)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{catalog.getPartitionPathString(column, value)}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path, True)
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(beside), path):
        raise OSError(f"{beside} could not be renamed to {path}")


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled. The frame's order is kept across
    the part files, which are named in order."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


class Store:
    """Tables of one schema set under one folder.

    ``buckets`` is the number of customer buckets a fiscal year is split into.
    Choose it so that a bucket of a year stays near a gigabyte, since a bucket
    is the least that an upsert rewrites; it is fixed for the store's life.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, T.StructType], buckets: int = 1):
        self.spark = spark
        self.root = root.rstrip("/")
        self.schemas = schemas
        self.buckets = buckets

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _fs(self, path: str):
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path, hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        path, fs = self._fs(self.path(name))
        return fs.exists(path)

    def _derived(self, name: str) -> dict[str, Column]:
        """Partition columns that the table does not carry itself."""
        made = {}
        for column in PARTITIONS.get(name, []):
            if column == "cust_bucket":
                made[column] = F.pmod(F.xxhash64("cust_id"), F.lit(self.buckets)).cast("long")
            elif column == "id_block":
                made[column] = F.floor(F.col(IDS[name]) / ID_BLOCK).cast("long")
        return made

    def stored_schema(self, name: str) -> T.StructType:
        extra = [T.StructField(c, T.LongType()) for c in self._derived(name)]
        return T.StructType([*self.schemas[name].fields, *extra])

    def _read_all(self, name: str) -> DataFrame:
        schema = self.stored_schema(name)
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        return self._read_all(name).select(*self.schemas[name].names)

    def _shaped(self, name: str, df: DataFrame) -> DataFrame:
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schemas[name].fields]
        return df.select(*columns).withColumns(self._derived(name))

    def _write(self, name: str, shaped: DataFrame, mode: str, ordered: bool = False) -> None:
        split = PARTITIONS.get(name, [])
        if ordered:
            texts = [c for c in split if isinstance(shaped.schema[c].dataType, T.StringType)]
            shaped = shaped.withColumns({c: folder_value(c) for c in texts})
        elif split:
            # Rebalancing splits a partition that holds most rows over many tasks
            # and joins small ones, so files come out of even size.
            shaped = shaped.hint("rebalance", *[F.col(c) for c in split])
        out = shaped.write.mode(mode).option("partitionOverwriteMode", "dynamic")
        (out.partitionBy(*split) if split else out).parquet(self.path(name))

    def append(self, name: str, df: DataFrame, ordered: bool = False) -> None:
        """``ordered`` rows come in the order of ``folder_value`` of the
        partition columns within each task and are written as they come."""
        self._write(name, self._shaped(name, df), "append", ordered)

    def replace_partitions(self, name: str, df: DataFrame, touched: DataFrame | None = None) -> None:
        """``df`` holds the whole new content of every partition it names.
        Partitions of ``touched`` that it leaves without rows are removed."""
        split = PARTITIONS[name]
        staged = stage(self._shaped(name, df), f"stage-{name}")
        self._write(name, staged, "overwrite")
        if touched is not None:
            # Grouped map-side first: a year's rows never meet in the one task that has the year.
            filled = staged.select(*split).distinct()
            emptied = touched.select(*split).distinct().join(filled, split, "left_anti")
            # Names of emptied folders only: at most the partitions of one change.
            for row in emptied.collect():
                folder = "/".join(f"{c}={row[c]}" for c in split)
                path, fs = self._fs(f"{self.path(name)}/{folder}")
                fs.delete(path, True)

    def partitions_of(self, name: str, df: DataFrame) -> DataFrame:
        return df.withColumns(self._derived(name)).select(*PARTITIONS[name]).distinct()

    def in_partitions(self, name: str, touched: DataFrame) -> DataFrame:
        """Rows of the touched partitions only. These are named one by one in
        the plan (at most years x buckets of them), so the scan lists and reads
        no other folder."""
        first, *others = PARTITIONS[name]
        by_first: dict = {}
        for row in touched.select(first, *others).distinct().collect():
            by_first.setdefault(row[0], []).append(row[1:])

        def is_in(column: str, values: list) -> Column:
            known = [v for v in values if v is not None]
            found = F.col(column).isin(known) if known else F.lit(False)
            return found | F.col(column).isNull() if len(known) < len(values) else found

        wanted = F.lit(False)
        for value, rest in by_first.items():
            own = is_in(first, [value])
            for k, column in enumerate(others):
                own = own & is_in(column, [r[k] for r in rest])
            wanted = wanted | own
        return self._read_all(name).filter(wanted)

    def merge(
        self,
        name: str,
        delta: DataFrame,
        keys: Sequence[str],
        update_cols: Sequence[str],
        insert: bool = True,
        delete_missing: bool = False,
    ) -> None:
        """Upsert a delta. Only the partitions it falls in are read and
        rewritten; ``delete_missing`` applies within them."""
        touched = self.partitions_of(name, delta)
        current = self.in_partitions(name, touched).select(*self.schemas[name].names)
        merged = merge_df(current, delta, keys, update_cols, insert, delete_missing)
        self.replace_partitions(name, merged, touched)

    def replace_by_key(self, name: str, delta: DataFrame, keys: Sequence[str]) -> None:
        """Delete rows with a key of the delta wherever they are, add the delta.
        A key that has the customer tells the bucket, so only the delta's
        buckets are searched, in all years."""
        stored = self._read_all(name)
        if "cust_bucket" in PARTITIONS[name] and "cust_id" in keys:
            buckets = delta.withColumns(self._derived(name)).select("cust_bucket").distinct()
            stored = stored.filter(F.col("cust_bucket").isin([r[0] for r in buckets.collect()]))
        hit = stored.join(delta.select(*keys), list(keys), "left_semi")
        touched = self.partitions_of(name, hit).union(self.partitions_of(name, delta)).distinct()
        touched = stage(touched, f"touched-{name}")
        current = self.in_partitions(name, touched).select(*self.schemas[name].names)
        kept = current.join(delta.select(*keys), list(keys), "left_anti")
        self.replace_partitions(name, kept.unionByName(delta.select(*self.schemas[name].names)), touched)

    def max_id(self, name: str, column: str) -> int:
        """Highest id stored, -1 without rows. The last answer is kept as a
        mark; only row groups with ids above it are read the next time."""
        marks = self.read("id_marks").filter(F.col("table_name") == name).agg(F.max("last_id")).first()
        known = -1 if marks[0] is None else marks[0]
        found = self.read(name).filter(F.col(column) > known).agg(F.max(column)).first()[0]
        if found is None:
            return known
        row = self.spark.createDataFrame([(name, found)], self.schemas["id_marks"])
        self._write("id_marks", self._shaped("id_marks", row), "overwrite")
        return found


def operational_store(spark: SparkSession, root: str, buckets: int = 1) -> Store:
    return Store(spark, root, OPERATIONAL, buckets)


def warehouse_store(spark: SparkSession, root: str, buckets: int = 1) -> Store:
    return Store(spark, root, WAREHOUSE, buckets)


def declare_warehouse(spark: SparkSession, database: str, root: str) -> list[str]:
    """Catalog entries for the warehouse tables over their folders; existing
    ones stay. Returns the table names."""
    spark.sql(f"create database if not exists {database}")
    store = warehouse_store(spark, root)
    for name in WAREHOUSE:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in store.stored_schema(name))
        parts = ", ".join(f"`{c}`" for c in PARTITIONS.get(name, []))
        split = f" partitioned by ({parts})" if parts else ""
        spark.sql(
            f"create table if not exists {database}.{name} ({columns}) using parquet{split} "
            f"location '{store.path(name)}'"
        )
    return list(WAREHOUSE)
