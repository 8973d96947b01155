"""A source for streams that pulls what others publish, with offsets of its own."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

WHOLE, END = "_SUCCESS", "_END"


@dataclass
class Piece(InputPartition):
    """Of each (file, k, n) the row groups k, k + n, k + 2n and so on."""

    files: list[tuple[str, int, int]]


class PublishedReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema = schema
        self.root = options["path"]
        self.bytes_per_task = int(options.get("bytesPerTask", 64 << 20))
        self.rows_per_batch = int(options.get("rowsPerBatch", 1000))
        self.after = ""

    def folder(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root)

    def initialOffset(self) -> dict:
        return {"after": ""}

    def whole(self, after: str) -> Iterator[str]:
        """Publications after one, up to the first that isn't whole: a later one never overtakes it."""
        files, root = self.folder()
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        for name in sorted(x.base_name for x in found if x.type == fs.FileType.Directory and x.base_name[0] not in "_."):
            if name > after:
                if files.get_file_info(f"{root}/{name}/{WHOLE}").type != fs.FileType.File:
                    return
                yield name

    def latestOffset(self) -> dict:
        for name in self.whole(self.after):
            self.after = name
        return {"after": self.after}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        files, root = self.folder()
        names = [x for x in self.whole(start["after"]) if x <= end["after"]]
        if end["after"] > start["after"] and names[-1:] != [end["after"]]:
            raise ValueError(f"publication {end['after']} of {self.root}, which was planned, is gone")
        pieces, room = [], 0
        for name in names:
            for x in sorted(files.get_file_info(fs.FileSelector(f"{root}/{name}", recursive=True)), key=lambda x: x.path):
                if x.type != fs.FileType.File or x.base_name[0] in "_.":
                    continue
                n = max(1, -(-x.size // self.bytes_per_task))
                for k in range(n):
                    if not pieces or n > 1 or room < x.size:
                        pieces.append(Piece([]))
                        room = self.bytes_per_task
                    pieces[-1].files.append((x.path, k, n))
                    room -= min(x.size, self.bytes_per_task)
        return pieces

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        files, _ = self.folder()
        target = to_arrow_schema(self.schema)
        for path, k, n in partition.files:
            with files.open_input_file(path) as source:
                table = pq.ParquetFile(source)
                have = [x for x in target.names if x in table.schema_arrow.names]
                groups = range(k, table.num_row_groups, n)
                for g in groups:
                    for batch in table.iter_batches(self.rows_per_batch, row_groups=[g], columns=have):
                        # No column is read where the file has none of them; its rows count all the same.
                        yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) if f.name in have else pa.nulls(batch.num_rows, f.type) for f in target], schema=target)

    def commit(self, end: dict) -> None:
        pass


class Published(DataSource):
    """Format "published": the publications below `path` as a stream.

    A publication is a folder of Parquet files below path that is whole once it holds `_SUCCESS`, as Spark leaves it.
    Publications come in order of their names and never change. The offset is the name of the last one pulled, so what
    a stream remembers of its source doesn't grow, and a restart lists only names. One name's files are read by many
    tasks: small ones together, files over bytesPerTask by row groups. The path must be one that pyarrow's file systems
    know. Columns that a file lacks are null, others are not read; a publication may be empty. A publication that comes
    under an earlier name than one pulled before is never read.
    """

    @classmethod
    def name(cls) -> str:
        return "published"

    def schema(self) -> StructType:
        raise ValueError("the schema of a publication must be given")

    def streamReader(self, schema: StructType) -> PublishedReader:
        return PublishedReader(schema, dict(self.options))


def published_stream(spark: SparkSession, path: str, schema: StructType | str, **options):
    """The stream of all publications below path, those to come included."""
    spark.dataSource.register(Published)
    return spark.readStream.format("published").schema(schema).options(**options).load(path)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) by Spark's own file systems."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def ended(spark: SparkSession, path: str) -> bool:
    """Whether the publisher has said, by a file `_END`, that nothing more comes below path."""
    files, found = hadoop_path(spark, f"{path}/{END}")
    return files.exists(found)


def end(spark: SparkSession, path: str) -> None:
    """Says that nothing more comes below path."""
    files, found = hadoop_path(spark, f"{path}/{END}")
    files.create(found, True).close()
