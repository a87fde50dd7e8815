"""Relational tables: Parquet folders or a database over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas

EVENT_DEFAULTS = {"outcome": "SUCCESS", "severity": "INFO", "metadata": "{}"}


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table with its declared schema; without one, that of the files."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_declared(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table of this name under root, with the schema that schemas declares for it:
    columns that its files lack are null, others are not read."""
    return read_table(spark, f"{root.rstrip('/')}/{name}", getattr(schemas, name.upper()))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, bounds: tuple, partitions: int, **options) -> DataFrame:
    """A table of a database, read in ranges of a column by many tasks at once."""
    properties = {k: str(v) for k, v in options.items()}
    return spark.read.jdbc(url, table, column, bounds[0], bounds[1], partitions, properties=properties)


def uuid_ranges(column: str, partitions: int) -> list[str]:
    """Predicates that part the values of a column of UUIDs, kept as text, in ranges of equal
    width: as the digits are random, with about equal numbers of rows. The first has the rows
    without a value, too."""
    if not 1 <= partitions <= 1 << 16:
        raise ValueError("between 1 and 65,536 ranges can be told by four digits")
    cuts = [f"{n * (1 << 16) // partitions:04x}" for n in range(1, partitions)]
    ranges = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        ends = [f"{column} >= '{low}'"] if low else []
        ends += [f"{column} < '{high}'"] if high else []
        ranges.append(" AND ".join(ends) or "1 = 1")
    ranges[0] += f" OR {column} IS NULL" if cuts else ""
    return ranges


def read_jdbc_by_uuid(spark: SparkSession, url: str, table: str, column: str, partitions: int, **options) -> DataFrame:
    """A table of a database, read by many tasks at once in ranges of a column of UUIDs."""
    properties = {k: str(v) for k, v in options.items()}
    return spark.read.jdbc(url, table, predicates=uuid_ranges(column, partitions), properties=properties)


def merge_jdbc(df: DataFrame, url: str, table: str, keys: list[str], staging: str, **options) -> None:
    """Insert the rows of df into a table of a database, or update the rows that have their
    keys, which are distinct in df. Many tasks write a staging table, in batches; one statement
    of the database then merges it, wholly or not at all, so a retry leaves the same."""
    properties = {k: str(v) for k, v in options.items()}
    df.write.mode("overwrite").jdbc(url, staging, properties=properties)
    name = lambda c: '"' + c.replace('"', '""') + '"'  # noqa: E731  as Spark's writer names columns
    same = " AND ".join(f"t.{name(k)} = s.{name(k)}" for k in keys)
    others = [c for c in df.columns if c not in keys]
    update = f" WHEN MATCHED THEN UPDATE SET {', '.join(f'{name(c)} = s.{name(c)}' for c in others)}" if others else ""
    columns, values = ", ".join(map(name, df.columns)), ", ".join(f"s.{name(c)}" for c in df.columns)
    merge = f"MERGE INTO {table} t USING {staging} s ON {same}{update} WHEN NOT MATCHED THEN INSERT ({columns}) VALUES ({values})"
    jvm = df.sparkSession.sparkContext._jvm
    given = jvm.java.util.Properties()
    for k, v in properties.items():
        given.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        statement = connection.createStatement()
        statement.executeUpdate(merge)
        statement.executeUpdate(f"DROP TABLE {staging}")
    finally:
        connection.close()


def with_event_defaults(events: DataFrame) -> DataFrame:
    columns = {}
    for name, value in EVENT_DEFAULTS.items():
        columns[name] = F.coalesce(F.col(name), F.lit(value)) if name in events.columns else F.lit(value)
    return events.withColumns(columns)


def append_events(events: DataFrame, path: str) -> None:
    """Append audit events with defaults, in folders by date so that scans can skip."""
    dated = with_event_defaults(events).withColumn("date", F.to_date("created_at"))
    dated.write.mode("append").partitionBy("date").parquet(path)


def write_events(events: DataFrame, path: str, batch: int) -> None:
    """Audit events of a numbered batch, with defaults: a batch that is written again replaces
    what it wrote."""
    with_event_defaults(events).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrite only the partitions of a partitioned table that df has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
