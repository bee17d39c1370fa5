"""Keyed upserts into a table of a database."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from contrail.operators.merge import one_row_a_key

CHAR, VARCHAR = 1, 12  # java.sql.Types


@contextmanager
def connected(spark: SparkSession, url: str, properties: dict) -> Iterator:
    """A JDBC statement of the driver; each text it executes is a transaction."""
    jvm = spark._jvm
    if "driver" in properties:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(properties["driver"])
    given = jvm.java.util.Properties()
    for name, value in properties.items():
        given.setProperty(name, value)
    connection = jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        yield connection.createStatement()
    finally:
        connection.close()


def upsert_jdbc(rows: DataFrame, url: str, table: str, keys: list[str], update: list[str] | None = None, properties: dict | None = None, order: str = "last_seen", connections: int = 8) -> None:
    """Upserts rows by keys into an existing table: known keys take the columns of `update` (all but the keys), others are inserted.

    Executors fill a staging table, over at most so many connections; then the database merges it in one statement, so the
    table has all of a batch or nothing of it, and writing a batch again changes nothing. Of several rows of one key that
    of the greatest `order` counts. Rows with a null in a key match none. Values that are too long for their column are
    errors, never cut. The database has to know MERGE.
    """
    spark, properties = rows.sparkSession, properties or {}
    quote = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier
    update = [c for c in rows.columns if c not in keys] if update is None else update
    staging, names = f"{table}_{uuid.uuid4().hex}", {c: quote(c) for c in rows.columns}
    try:
        one_row_a_key(rows, keys, order).coalesce(connections).write.jdbc(url, staging, mode="error", properties=properties)
    except Exception:
        with suppress(Py4JJavaError), connected(spark, url, properties) as statement:  # it may have failed before it made the table
            statement.executeUpdate(f"DROP TABLE {staging}")
        raise
    with connected(spark, url, properties) as statement:
        try:
            found = statement.executeQuery(f"SELECT {', '.join(names.values())} FROM {table} WHERE 1 = 0")
            about, value = found.getMetaData(), {}
            for i, (c, name) in enumerate(names.items(), 1):
                # Spark may stage texts as large objects; a cast to one character more keeps what is too long an error
                text = about.getColumnType(i) in (CHAR, VARCHAR)
                value[c] = f"CAST(s.{name} AS VARCHAR({about.getPrecision(i) + 1}))" if text and about.getPrecision(i) < 32_672 else f"s.{name}"
            found.close()
            on = " AND ".join(f"t.{names[k]} = {value[k]}" for k in keys)
            changed = f"WHEN MATCHED THEN UPDATE SET {', '.join(f'{names[c]} = {value[c]}' for c in update)} " if update else ""
            added = f"WHEN NOT MATCHED THEN INSERT ({', '.join(names.values())}) VALUES ({', '.join(value.values())})"
            statement.executeUpdate(f"MERGE INTO {table} AS t USING {staging} AS s ON {on} {changed}{added}")
        finally:
            statement.executeUpdate(f"DROP TABLE {staging}")
