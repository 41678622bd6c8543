"""A data source that lists files: path, size and time of each, also of empty ones.

Spark's own sources leave out empty files and gather the whole listing on the driver.  Here
a partition is a set of path prefixes that a task walks by itself; the driver lists no more
than the first levels of the store.  Contents are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Partitions that the driver tries to make, and levels that it lists to do so.
PARTITIONS, LEVELS = 64, 2

SCHEMA = "path string, size bigint, modified timestamp"


class Prefixes(InputPartition):
    """Folders to walk, and files."""

    def __init__(self, folders: Sequence[str], files: Sequence[tuple]):
        self.folders, self.files = list(folders), list(files)


class FileListing(DataSource):
    """``spark.read.format("file_listing").load(root)``; the option ``partitions`` says how many tasks
    should walk the store, if it has as many folders.

    ``root`` is a local or shared path, or a URI of a store that pyarrow reaches from the
    executors.  Names that begin with a dot or an underscore are left out, as Spark does.  A root
    that doesn't exist gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options["path"], int(self.options.get("partitions", PARTITIONS)))


class ListingReader(DataSourceReader):
    def __init__(self, root: str, wanted: int):
        self.root, self.wanted = root, wanted

    def _store(self):
        """The file system, the path of the root in it, and what to put before its paths."""
        from pyarrow import fs

        if self.root.startswith("file:"):
            return fs.LocalFileSystem(), "/" + self.root.removeprefix("file:").lstrip("/"), "file:"
        if "://" not in self.root:
            return fs.LocalFileSystem(), self.root, "file:"
        store, base = fs.FileSystem.from_uri(self.root)
        return store, base, self.root.split("://")[0] + "://"

    @staticmethod
    def _list(store, folder: str) -> tuple[list[str], list[tuple]]:
        from pyarrow import fs

        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        shown = [i for i in found if not i.base_name.startswith((".", "_"))]
        files = [(i.path, i.size, i.mtime) for i in shown if i.type == fs.FileType.File]
        return sorted(i.path for i in shown if i.type == fs.FileType.Directory), files

    def partitions(self) -> list[InputPartition]:
        store, base, _ = self._store()
        folders, files = [base], []
        for _ in range(LEVELS):
            if len(folders) >= self.wanted:
                break
            listed = [self._list(store, f) for f in folders]
            folders = [f for found, _ in listed for f in found]
            files += [f for _, found in listed for f in found]
        tasks = max(1, min(self.wanted, len(folders)))
        return [Prefixes(folders[i::tasks], files[i::tasks]) for i in range(tasks)]

    def read(self, partition: Prefixes) -> Iterator[tuple]:
        store, _, before = self._store()
        for path, size, modified in partition.files:
            yield before + path, size, modified
        todo = list(partition.folders)
        while todo:  # one folder at a time, so that a task holds no more than that
            folders, files = self._list(store, todo.pop())
            todo += folders
            for path, size, modified in files:
                yield before + path, size, modified


def list_files(spark: SparkSession, root: str, partitions: int | None = None) -> DataFrame:
    """Path, size (bigint) and time of every file below ``root``; see FileListing."""
    spark.dataSource.register(FileListing)
    reader = spark.read.format(FileListing.name())
    return (reader.option("partitions", str(partitions)) if partitions else reader).load(root)


def file_name() -> Column:
    return F.element_at(F.split("path", "/"), -1)


def missing_files(files: DataFrame, expected: DataFrame, name: Column | None = None) -> DataFrame:
    """(name, reason) for each ``name`` of ``expected`` that no row of ``files`` has (``missing``),
    or only empty ones (``empty``).  ``name`` tells it from a path; by default the file's name."""
    held = files.groupBy((file_name() if name is None else name).alias("name")).agg(F.max("size").alias("size"))
    state = F.when(F.col("size").isNull(), "missing").when(F.col("size") == 0, "empty")
    return expected.select("name").distinct().join(held, "name", "left").select("name", state.alias("reason")).filter(
        F.col("reason").isNotNull())
