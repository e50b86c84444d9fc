"""A sink for reports: a file for each row, in place only when all are written.

``frame.write.format("reports")`` takes rows (name, body): each task writes its
bodies below a staging folder of its own write; the commit moves them to their
names and lists them in a manifest, which is written last. A write that fails
removes its staging and leaves no report; tasks that still run then cannot make
the folder anew. A task that is tried again, or twice at once, counts once.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from scholium.sources.stores import opened

MANIFEST = "_reports.json"
#: Times that a staging folder is deleted while tasks still add to it.
ABORTS = 20


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class ReportWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.staging = path, overwrite, f"_staging-{uuid.uuid4().hex}"
        where, root = opened(path)
        where.create_dir(f"{root}/{self.staging}", recursive=True)

    def write(self, rows: Iterator) -> Written:
        where, root = opened(self.path)
        attempt = f"{root}/{self.staging}/{uuid.uuid4().hex}"
        where.create_dir(attempt, recursive=False)  # an error once the staging is gone
        done = []
        for k, row in enumerate(rows):
            if not row["name"] or "/" in row["name"] or row["name"].startswith(("_", ".")):
                raise ValueError(f"not a name of a report: {row['name']!r}")
            with where.open_output_stream(f"{attempt}/{k}") as out:
                out.write((row["body"] or "").encode())
            done.append((row["name"], f"{attempt}/{k}"))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        """Move every file to its name; of two rows of one name the second is an error and nothing is moved."""
        where, root = opened(self.path)
        files = [f for m in messages if m for f in m.names]
        names = [n for n, _ in files]
        kept = [] if self.overwrite else listed(self.path)
        if doubled := sorted(n for n in set(names) if names.count(n) > 1 or n in kept):
            self.abort(messages)
            raise ValueError(f"reports of one name: {doubled[:5]}")
        for old in listed(self.path) if self.overwrite else ():
            where.delete_file(f"{root}/{old}")
        where.create_dir(root, recursive=True)
        for name, file in files:
            where.move(file, f"{root}/{name}")
        with where.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(sorted([*kept, *names])).encode())
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        where, root = opened(self.path)
        for left in reversed(range(ABORTS)):
            if where.get_file_info(f"{root}/{self.staging}").type != fs.FileType.Directory:
                break
            try:
                where.delete_dir(f"{root}/{self.staging}")
            except OSError:  # a task that still runs has added a file meanwhile
                if not left:
                    raise
                time.sleep(0.1)


class ReportSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "reports"

    def schema(self) -> str:
        return "name string, body string"

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"], overwrite)


def listed(path: str) -> list[str]:
    """Names of the reports that are in place."""
    where, root = opened(path)
    if where.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.File:
        return []
    with where.open_input_stream(f"{root}/{MANIFEST}") as stream:
        return json.loads(stream.read())


def save(reports: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write rows (name, body) as files; names are unique, without a slash, and begin with no dot or underscore."""
    reports.sparkSession.dataSource.register(ReportSink)
    reports.select("name", "body").write.format("reports").option("path", path).mode("overwrite" if overwrite else "append").save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """name and body of the reports that are in place."""
    names = spark.createDataFrame([(n,) for n in listed(path)], "name string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path)
    found = files.selectExpr("element_at(split(path, '/'), -1) AS name", "decode(content, 'UTF-8') AS body")
    # Spark passes over empty files
    return names.join(found, "name", "left").selectExpr("name", "coalesce(body, '') AS body")
