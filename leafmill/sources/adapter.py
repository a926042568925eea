"""A container file format as a Spark data source: spark.read.format("leafmill_files").option("kind", "xlsx").load(path)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .containers import SCANS


#: Files, and bytes of files, that one task reads (a larger file has a task of its own).
FILES, BYTES = 100, 32 << 20


def packed(files: list[tuple[str, int]]) -> list[list[str]]:
    """(path, bytes) dealt to tasks in order: of small files a task each would be most of the work."""
    out: list[list[str]] = []
    size = 0
    for path, n in files:
        if not out or len(out[-1]) >= FILES or size + n > BYTES:
            out.append([])
            size = 0
        out[-1].append(path)
        size += n
    return out


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.read_one, self.paths = SCANS[options.get("kind", "xlsx")][0], options

    def partitions(self):
        import pyarrow.fs as pafs

        uri = self.paths["path"]
        fs, root = pafs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if fs.get_file_info(root).type == pafs.FileType.Directory else [fs.get_file_info(root)]
        return [_Files(paths) for paths in packed([(f"{uri.split('://')[0]}://{f.path}" if ":/" in uri else f.path, f.size or 0) for f in found if f.is_file])]

    def read(self, partition):
        import pyarrow.fs as pafs

        for uri in partition.value:
            fs, path = pafs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")
            with fs.open_input_file(path) as f:
                content = f.read()
            for row in self.read_one(content):
                yield (path.rsplit("/", 1)[-1], *row)


class ContainerSource(DataSource):
    """Rows of one of the scans; small files share a task."""

    @classmethod
    def name(cls) -> str:
        return "leafmill_files"

    def schema(self) -> str:
        return "path string, " + SCANS[self.options.get("kind", "xlsx")][1]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ContainerSource)
