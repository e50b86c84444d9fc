"""Recorded search responses: a search source that Spark reads as a table.

A live connector would yield the same rows; without a network, recordings stand
in for it. ``save`` lays records out twice: by query in the order of their rank,
and by a hash of their id. The data source ``recorded`` reads them as (query,
rank, id, json): one partition for each query, of which it stops reading at the
quota, or for an id alone the one partition that can hold it.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from scholium.sources.stores import opened

SCHEMA = "query string, rank int, id string, json string"
NO_QUERY = "__HIVE_DEFAULT_PARTITION__"


def quota(max_results: int, queries: int) -> int:
    """How many records of each query a search with a bound on all of them keeps."""
    return max(max_results // max(1, queries), 20)


def save(records: DataFrame, folder: str, order: list, buckets: int = 64) -> None:
    """Write ``records`` (query, id, json) as recorded responses, ranked within each query by ``order``.

    A query of very many records goes to several files, in the order of their
    ranks; null queries and ids are kept, a null json is an empty record. The
    layout is written last, so a folder without it is not whole.
    """
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = records.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    lines = ranked.select("query", "rank", F.col("id").cast("string").alias("id"), F.coalesce("json", F.lit("{}")).alias("json"))
    lines.repartitionByRange(parts, "query", "rank").sortWithinPartitions("query", "rank").withColumn("of", F.col("query")).write.partitionBy("of").json(f"{folder}/by_query")
    bucket = F.crc32(F.col("id").cast("binary")) % buckets
    lines.withColumn("bucket", F.coalesce(bucket, F.lit(buckets))).repartition("bucket").write.partitionBy("bucket").json(f"{folder}/by_id")
    records.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.json(f"{folder}/layout")


def _lines(where: fs.FileSystem, path: str) -> Iterator[str]:
    with where.open_input_stream(path) as stream:
        rest = b""
        while chunk := stream.read(1 << 20):
            *whole, rest = (rest + bytes(chunk)).split(b"\n")
            yield from (x.decode() for x in whole if x)
        if rest:
            yield rest.decode()


def _files(where: fs.FileSystem, folder: str) -> list[str]:
    found = where.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.startswith("part-"))


class OfQuery(InputPartition):
    """The records of one query, up to a rank."""

    def __init__(self, folder: str, most: int | None):
        self.folder, self.most = folder, most


class OfId(InputPartition):
    """The records of one id, of some queries (null: all) and up to a rank."""

    def __init__(self, folder: str, key: str, queries: list[str] | None, most: int | None):
        self.folder, self.key, self.queries, self.most = folder, key, queries, most


class RecordedReader(DataSourceReader):
    def __init__(self, options):
        if not options.get("path"):
            raise ValueError("recorded responses need a path")
        self.path, self.max_results = options["path"].rstrip("/"), options.get("maxresults")
        self.queries = json.loads(options["queries"]) if "queries" in options else None
        self.asked, self.key = None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """An equal id makes a point lookup, equal queries leave out partitions; all else stays with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("id",) and self.key is None:
                self.key = f.value
            elif isinstance(f, EqualTo | In) and f.attribute == ("query",) and self.asked is None:
                self.asked = [f.value] if isinstance(f, EqualTo) else list(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        where, root = opened(self.path)
        folders = {unquote(d.base_name.removeprefix("of=")): d.path for d in where.get_file_info(fs.FileSelector(f"{root}/by_query")) if d.base_name.startswith("of=")}
        known = [q for q in sorted(folders) if self.queries is None or q in self.queries]
        most = quota(int(self.max_results), len(known)) if self.max_results else None
        wanted = [q for q in known if self.asked is None or (q != NO_QUERY and q in self.asked)]
        if self.key is None:
            return [OfQuery(folders[q], most) for q in wanted] or [OfQuery("", 0)]
        layout = json.loads(next(_lines(where, _files(where, f"{root}/layout")[0])))
        narrowed = None if self.queries is None and self.asked is None else wanted
        return [OfId(f"{root}/by_id/bucket={zlib.crc32(self.key.encode()) % layout['buckets']}", self.key, narrowed, most)]

    def read(self, part: InputPartition) -> Iterator[tuple]:
        if not part.folder:
            return
        where, _ = opened(self.path)
        for path in _files(where, part.folder):
            for line in _lines(where, path):
                record = json.loads(line)
                row = (record.get("query"), record["rank"], record.get("id"), record["json"])
                beyond = part.most is not None and row[1] > part.most
                if isinstance(part, OfId):
                    if row[2] == part.key and not beyond and (part.queries is None or row[0] in part.queries):
                        yield row
                elif beyond:
                    return
                else:
                    yield row


class RecordedSource(DataSource):
    """``spark.read.format("recorded")``; options: path, maxResults (none: all), queries (a JSON list; none: all)."""

    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordedReader:
        return RecordedReader(self.options)


def search(spark: SparkSession, folder: str, max_results: int | None = None, queries: list[str] | None = None) -> DataFrame:
    """query, rank, id and json of the recorded responses in ``folder``.

    With ``max_results``, each query gives its first max(max_results / queries, 20)
    records. Filters on the id (a point lookup) and the query reach the source.
    The folder must be on a file system that pyarrow can open. Without any record
    the table is empty.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordedSource)
    options = {"path": folder} | ({"maxResults": str(max_results)} if max_results else {}) | ({"queries": json.dumps(queries)} if queries is not None else {})
    return spark.read.format("recorded").options(**options).load()


def details(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """The records of one id, from the one partition that can hold them."""
    return search(spark, folder).filter(F.col("id") == key)


def recorded(spark: SparkSession, folder: str, max_results: int = 500) -> DataFrame:
    """query, row_pos and json of the first max(max_results / queries, 20) lines of each JSON-lines file, named by its query."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(folder)
    most = quota(max_results, files.select("path").count())
    named = files.select(F.regexp_extract("path", r"([^/]+)\.jsonl$", 1).alias("query"), F.slice(F.split(F.rtrim(F.decode("content", "UTF-8"), F.lit("\n")), "\n"), 1, most).alias("lines"))
    return named.select("query", F.posexplode("lines").alias("row_pos", "json")).filter(F.col("json") != "")
