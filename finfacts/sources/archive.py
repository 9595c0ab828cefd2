"""Zip archive of company files as a Spark source (A1, A2 bulk archives).

A zip is not splittable as bytes, but its entries are independent: the driver
reads only the central directory (names and offsets) and each task inflates its
own range of entries. The archive must sit on storage every executor can read.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class ZipEntries(DataSource):
    """``spark.read.format("zipentries").option("path", ...).load()`` ->
    (name, content binary, mtime timestamp). Options: ``pattern`` (regex on the
    entry name), ``entriesPerPartition`` (default 2000)."""

    @classmethod
    def name(cls) -> str:
        return "zipentries"

    def schema(self) -> str:
        return "name string, content binary, mtime timestamp"

    def reader(self, schema):
        return _ZipReader(self.options)


class _ZipReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.per = int(options.get("entriesPerPartition", 2000))
        self.pattern = options.get("pattern")

    def partitions(self):
        import zipfile
        with zipfile.ZipFile(self.path) as z:
            n = len(z.infolist())
        return [InputPartition((lo, min(lo + self.per, n))) for lo in range(0, n, self.per)] or [InputPartition((0, 0))]

    def read(self, partition):
        import zipfile
        lo, hi = partition.value
        rx = re.compile(self.pattern) if self.pattern else None
        with zipfile.ZipFile(self.path) as z:
            for info in z.infolist()[lo:hi]:
                base = info.filename.rsplit("/", 1)[-1]
                if info.is_dir() or (rx is not None and not rx.match(base)):
                    continue
                yield (base, z.read(info), _dt.datetime(*info.date_time))


def register(spark) -> None:
    spark.dataSource.register(ZipEntries)
