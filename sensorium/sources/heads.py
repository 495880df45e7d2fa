"""The first lines of many files, of which no more than these lines are read.

Spark's text sources read whole files before a limit on lines can be applied to each. This data source (for
spark.read.format("file_heads")) lists files under a path, deals them out in batches, and reads each in small blocks
until it has the lines. Paths may be local or in any store that pyarrow knows (s3, gs, hdfs); others are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sensorium.session import ship

BLOCK = 4096


def store(path: str):
    """(file system, path in it, what stands before that path in the URI) of a path or URI."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, ""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = f"file://{path.removeprefix('file:')}"
    where, own = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return where, own, path[: path.rfind(own.rstrip("/"))] if own.strip("/") else path


def head(read, lines: int, most: int) -> tuple[bytes, int]:
    """(the first lines, bytes read) of what read(n) gives block by block."""
    held = b""
    while held.count(b"\n") < lines and len(held) < most:
        block = read(min(BLOCK, most - len(held)))
        if not block:
            break
        held += block
    return b"\n".join(held.split(b"\n")[:lines]), len(held)


@dataclass
class Batch(InputPartition):
    files: list[str]

    def __init__(self, files: list[str]):
        super().__init__(files)
        self.files = files


class HeadReader(DataSourceReader):
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("file_heads needs a path")
        self.path, self.glob = options["path"], options.get("pathglobfilter", "*")
        self.lines, self.most, self.batch = (int(options.get(k, d)) for k, d in (("lines", "20"), ("maxbytes", str(1 << 20)), ("filesperpartition", "256")))
        self.recursive = options.get("recursivefilelookup", "true").lower() == "true"

    def partitions(self) -> list[Batch]:
        from pyarrow import fs

        where, path, _ = store(self.path)
        one = where.get_file_info(path)
        if one.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [one] if one.is_file else where.get_file_info(fs.FileSelector(path, recursive=self.recursive))
        files = sorted(x.path for x in found if x.is_file and fnmatch(x.base_name, self.glob))
        return [Batch(files[k : k + self.batch]) for k in range(0, len(files), self.batch)] or [Batch([])]

    def read(self, partition: Batch) -> Iterator[tuple[str, str, int]]:
        where, _, before = store(self.path)
        for file in partition.files:
            with where.open_input_file(file) as f:
                text, n = head(f.read, self.lines, self.most)
            yield before + file, text.decode("utf-8", "replace"), n


class FileHeads(DataSource):
    """file, head, bytes_read. Options: pathGlobFilter, recursiveFileLookup (true), lines (20), maxBytes (1 MiB for
    each file, beyond which even an unfinished line isn't followed), filesPerPartition (256)."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "file string, head string, bytes_read long"

    def reader(self, schema) -> HeadReader:
        return HeadReader({k.lower(): v for k, v in self.options.items()})


def read_heads(spark: SparkSession, path: str, glob: str = "*", lines: int = 20, **options) -> DataFrame:
    """file, head, bytes_read of the files under a path whose names match."""
    ship(spark)
    spark.dataSource.register(FileHeads)
    return spark.read.format("file_heads").options(pathGlobFilter=glob, lines=lines, **options).load(path)
