"""Sources by URI, and sources of rows that are at hand."""

from __future__ import annotations

import importlib.util
import itertools
from collections.abc import Callable, Iterable
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillon import types

#: URI schemes and what reads them. JDBC drivers come with the cluster.
JDBC = {
    "postgres": "org.postgresql.Driver",
    "postgresql": "org.postgresql.Driver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "sqlite": "org.sqlite.JDBC",
    "duckdb": "org.duckdb.DuckDBDriver",
    "snowflake": "net.snowflake.client.jdbc.SnowflakeDriver",
    "clickhouse": "com.clickhouse.jdbc.ClickHouseDriver",
}
CONNECTORS = {"mongodb": "mongodb", "mongomock": "mongodb"}
FORMATS = ("parquet", "orc", "csv", "json", "avro", "text")


def jdbc_options(uri: str, table: str, column: str | None = None, partitions: int = 1, bounds: tuple | None = None) -> dict[str, str]:
    """Options of spark.read.format("jdbc") for a URI; one that begins with jdbc: is passed on as it
    is, to the driver that knows it. With a column and bounds the table is read in so many ranges at
    once; without them it is one task, however large."""
    scheme = urlsplit(uri).scheme.split("+")[0]
    parts = urlsplit(uri)
    out = {"dbtable": table, "fetchsize": "10000"}
    if scheme == "jdbc":
        out["url"] = uri
    elif scheme not in JDBC:
        raise ValueError(f"no JDBC source for {scheme!r}")
    elif scheme in ("sqlite", "duckdb"):
        out |= {"url": f"jdbc:{scheme}:{(parts.netloc + parts.path)}", "driver": JDBC[scheme]}
    else:
        place = (parts.hostname or "") + (f":{parts.port}" if parts.port else "")
        names = {"postgres": "postgresql", "mssql": "sqlserver"}
        url = f"jdbc:{names.get(scheme, scheme)}://{place}{parts.path}" + (f"?{parts.query}" if parts.query else "")
        out |= {"url": url, "driver": JDBC[scheme]}
    if parts.username:
        out |= {"user": parts.username, "password": parts.password or ""}
    if column is not None:
        if bounds is None or partitions < 1:
            raise ValueError("reading in ranges needs bounds and partitions")
        out |= {"partitionColumn": column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return out


def read_uri(spark: SparkSession, uri: str, table: str | None = None, **ranges) -> DataFrame:
    """Rows of a table behind a URI: a database, a document store, or files of a format
    (`parquet:///path`). Filters and columns are pushed down by Spark's sources."""
    scheme = urlsplit(uri).scheme.split("+")[0]
    if scheme in JDBC or scheme == "jdbc":
        return spark.read.format("jdbc").options(**jdbc_options(uri, table or "", **ranges)).load()
    if scheme in CONNECTORS:
        parts = urlsplit(uri)
        return spark.read.format(CONNECTORS[scheme]).options(**{"connection.uri": uri, "database": parts.path.strip("/"), "collection": table or ""} | dict(parse_qsl(parts.query))).load()
    if scheme == "redis":
        spark.dataSource.register(KeyedSource)
        # The store may name a key more than once while it goes through its keys.
        return spark.read.format("quillon-keyed").option("uri", uri).option("pattern", f"{table}:*").load().dropDuplicates(["key"])
    if scheme in FORMATS:
        path = uri.split("://", 1)[1]
        return spark.read.format(scheme).load(f"{path}/{table}" if table else path)
    raise ValueError(f"no source for {scheme!r}")


def inmemory(spark: SparkSession, rows: Iterable[dict], fields: dict[str, str]) -> DataFrame:
    """Literal rows as a DataFrame; fields that a row lacks are null."""
    schema = types.struct_type(fields)
    return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], schema)


def json_file(spark: SparkSession, path: str, fields: dict[str, str] | None = None) -> DataFrame:
    """Rows of a JSON lines file."""
    reader = spark.read if fields is None else spark.read.schema(types.struct_type(fields))
    return reader.json(path)


class RemoteData:
    """Rows from a callable that is asked once, at first use."""

    def __init__(self, getter: Callable[[], Iterable[dict]], fields: dict[str, str]):
        self.getter, self.fields, self._frame = getter, fields, None

    def frame(self, spark: SparkSession) -> DataFrame:
        if self._frame is None:
            self._frame = inmemory(spark, self.getter(), self.fields)
        return self._frame


def keyed(rows: DataFrame, key: str, *patterns: str) -> DataFrame:
    """Rows whose key matches one of some patterns in which * stands for anything. A pattern's
    fixed beginning is a range that reaches the scan."""
    condition = F.lit(False)
    for p in patterns:
        like = p.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
        condition = condition | F.col(key).like(like)
    return rows.filter(condition)


#: Keys that one request to a key-value store asks for.
KEYS = 1000


class _KeyRange(InputPartition):
    def __init__(self, pattern: str):
        self.pattern = pattern


class KeyedSource(DataSource):
    """Key-value stores with JSON values as (key, value) rows; one task for each key pattern
    (options: uri, pattern, with commas between several)."""

    @classmethod
    def name(cls) -> str:
        return "quillon-keyed"

    def schema(self) -> str:
        return "key string, value string"

    def reader(self, schema):
        return _KeyedReader(self.options)


class _KeyedReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.patterns = options["uri"], options["pattern"].split(",")

    def partitions(self):
        return [_KeyRange(p) for p in self.patterns]

    def read(self, partition):
        if importlib.util.find_spec("redis") is None:
            raise RuntimeError("the redis package isn't installed on the executors")
        import redis

        client = redis.Redis.from_url(self.uri)
        found = client.scan_iter(match=partition.pattern, count=KEYS)
        while keys := list(itertools.islice(found, KEYS)):
            for key, value in zip(keys, client.mget(keys)):
                if value is not None:
                    yield key.decode(), value.decode()


def sampled(rows: DataFrame, key: str, size: int | None, seed: int = 42) -> DataFrame:
    """The first `size` rows in an order that depends on the key and the seed alone: that of the MD5
    of `key:seed`, which other systems have as well."""
    return rows if size is None else rows.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(size)
