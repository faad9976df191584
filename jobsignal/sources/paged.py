"""Run datasets read in pages, as a batch and as a stream, through Spark's Python data source API."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Items of a page: the default, and the most that may be asked for.
PAGE, MOST = 1_000, 10_000


@dataclass
class Page(InputPartition):
    run: str
    offset: int
    limit: int


class Runs:
    """Folders ``run=<id>`` of Parquet files in a store that pyarrow reaches: a run's total, and any page of its items.
    Files count in order of their names, so a page is the same however often it is read."""

    def __init__(self, path: str):
        self.path = path

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def names(self) -> list[str]:
        store, root = self._store()
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(f.base_name.removeprefix("run=") for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("run="))

    def _items(self, run: str) -> ds.Dataset:
        store, root = self._store()
        return ds.dataset(f"{root}/run={run}", filesystem=store, format="parquet")

    def total(self, run: str) -> int:
        return self._items(run).count_rows()

    def page(self, run: str, offset: int, limit: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
        """Items offset .. offset + limit, fewer at the run's end; row groups before them are passed over unread."""
        for part in sorted(self._items(run).get_fragments(), key=lambda f: f.path):
            for group in part.split_by_row_group():
                n = group.count_rows()
                if offset < n and limit > 0:
                    rows = group.to_table(columns=columns).slice(offset, limit)
                    limit -= rows.num_rows
                    yield from rows.to_batches()
                offset = max(0, offset - n)
                if limit <= 0:
                    return


def _pages(runs: Runs, names: list[str], size: int) -> list[Page]:
    return [Page(run, at, size) for run in names for at in range(0, runs.total(run), size)]


class _Reads:
    """What batch and stream readers share: a page's items with their run and place."""

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        columns = [f.name for f in self.schema.fields if f.name not in ("run_id", "item")]
        at = partition.offset
        for batch in self.runs.page(partition.run, partition.offset, partition.limit, columns):
            n, named = batch.num_rows, dict(zip(batch.schema.names, batch.columns))
            own = {"run_id": pa.array([partition.run] * n, pa.string()), "item": pa.array(range(at, at + n), pa.int64())}
            at += n
            yield pa.RecordBatch.from_arrays([(own | named)[f.name] for f in self.schema.fields], names=self.schema.names)


class PagedReader(_Reads, DataSourceReader):
    def __init__(self, runs: Runs, schema, size: int, run: str | None):
        self.runs, self.schema, self.size, self.run = runs, schema, size, run

    def partitions(self) -> list[Page]:
        return _pages(self.runs, [self.run] if self.run else self.runs.names(), self.size)


class PagedStream(_Reads, DataSourceStreamReader):
    """Offsets are the names of the runs that have been read; a batch is the pages of those that came since."""

    def __init__(self, runs: Runs, schema, size: int):
        self.runs, self.schema, self.size = runs, schema, size

    def initialOffset(self) -> dict:
        return {"runs": []}

    def latestOffset(self) -> dict:
        return {"runs": self.runs.names()}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return _pages(self.runs, sorted(set(end["runs"]) - set(start["runs"])), self.size)

    def commit(self, end: dict) -> None:
        pass


class PagedItems(DataSource):
    """``spark.read.format("paged_items").schema(...).option("pageSize", 1000).load(path)``, and ``readStream`` alike.

    Each page is a task of its own. Columns run_id and item (the place in the run) are the source's, the others the
    items'; ``run`` reads one run. A run with no items has no page."""

    @classmethod
    def name(cls) -> str:
        return "paged_items"

    def _settings(self) -> tuple[Runs, int]:
        size = int(self.options.get("pageSize", PAGE))
        if not 1 <= size <= MOST:
            raise ValueError(f"pageSize must lie in 1..{MOST}")
        return Runs(self.options["path"]), size

    def schema(self) -> str:
        return "run_id string, item long, payload string"

    def reader(self, schema) -> PagedReader:
        runs, size = self._settings()
        return PagedReader(runs, schema, size, self.options.get("run"))

    def streamReader(self, schema) -> PagedStream:
        return PagedStream(*self._settings()[:1], schema, self._settings()[1])
