"""Zip archives as a data source: ``format("registry_zip")``, batch and stream.

A partition is one member, or several small ones: the directories of the archives are read first, so
large archives are unpacked by as many tasks as they have members, and each member is inflated once.
Its CRC is checked while it is read; if it does not fit, an error row follows the lines that were
already given out, and ``split_rejects`` takes the whole archive away.  Tasks open the archives where they
lie, so there is no limit on their size.

Options: ``path`` (a folder; its ``*.zip`` files, also in subfolders) or ``files`` (JSON list of [path,
version]); ``encoding``, ``quote`` (records go on over line breaks inside quotes), ``memberSuffix``,
``firstMemberOnly``, ``batchRows``, ``partitionBytes``; for a stream ``ledger``, a folder of its own.

A stream's offset is the number of a listing (path, length, modification time) that it has put into its
ledger folder; a batch is what differs between two listings.  So an archive published again under
its name is read again, also if it was moved into place with an older time, and one that went
away gives an error row ``Removed``.  The number is the ``version`` of the rows.
"""

from __future__ import annotations

import io
import json
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from regspark.sources.archives import _not_damage, _open_archive, _records, _ship_by_value

#: stores whose files tasks can open; others are read through Spark's own readers
OPENED = ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")
SCHEMA = "archive string, member string, line_no long, line string, error string, version long"
DAMAGE = (zipfile.BadZipFile, zipfile.LargeZipFile, zlib.error, OSError, EOFError, KeyError, NotImplementedError, RuntimeError)


class Members(InputPartition):
    """``units``: (archive, version, member or None, error or None)."""

    def __init__(self, units: list):
        super().__init__(len(units))
        self.units = units


def store_of(path: str) -> tuple:
    """(file system, path in it, what stands before that in a full path)."""
    from pyarrow import fs
    scheme, colon, rest = path.partition(":")
    if scheme == "file" or not colon:
        return fs.LocalFileSystem(), "/" + (rest or path).lstrip("/"), "file:"
    store, inner = fs.FileSystem.from_uri(path)
    return store, inner, path[:-len(inner)] if path.endswith(inner) else f"{scheme}://"


def listed(folder: str) -> dict:
    """{path: [length, modified]} of the archives under a folder."""
    from pyarrow import fs
    store, inner, prefix = store_of(folder)
    found = store.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    return {prefix + f.path: [f.size, int(f.mtime_ns or 0)] for f in found
            if f.type == fs.FileType.File and f.path.lower().endswith(".zip") and not f.base_name.startswith(("_", "."))}


class Listings:
    """Numbered listings in a folder; number 0 is the empty one."""

    def __init__(self, folder: str):
        self.store, self.folder, _ = store_of(folder)

    def last(self) -> int:
        from pyarrow import fs
        found = self.store.get_file_info(fs.FileSelector(self.folder, allow_not_found=True))
        return max((int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json")), default=0)

    def get(self, n: int) -> dict:
        if not n:
            return {}
        with self.store.open_input_stream(f"{self.folder}/{n}.json") as f:
            return json.loads(f.read())

    def put(self, n: int, files: dict) -> None:
        self.store.create_dir(self.folder, recursive=True)
        draft = f"{self.folder}/{n}.draft"
        with self.store.open_output_stream(draft) as f:
            f.write(json.dumps(files).encode())
        self.store.move(draft, f"{self.folder}/{n}.json")


class ZipLines:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict):
        self.path, self.files = options.get("path"), options.get("files")
        self.encoding, self.quote = options.get("encoding", "ISO-8859-1"), options.get("quote") or None
        self.suffix = (options.get("memberSuffix") or "").lower()
        self.first_only = options.get("firstMemberOnly", "false").lower() == "true"
        self.batch_rows = int(options.get("batchRows", "10000"))
        self.partition_bytes = int(options.get("partitionBytes", str(32 << 20)))

    def directory(self, file: tuple) -> list:
        """[(unit, its bytes)] of one archive, or its error."""
        path, version = file
        try:
            with _open_archive(path) as raw, zipfile.ZipFile(raw) as zf:
                members = sorted((i.filename, i.file_size) for i in zf.infolist()
                                 if not i.is_dir() and i.filename.lower().endswith(self.suffix))
        except DAMAGE as e:
            if _not_damage(e, True):
                raise
            return [((path, version, None, f"{type(e).__name__}: {e}"), 0)]
        if self.first_only:
            members = members[:1]
        return [((path, version, m, None), size) for m, size in members]

    def plan(self, files: list) -> list:
        """Partitions of whole members, together as large as ``partition_bytes`` or one member."""
        from concurrent.futures import ThreadPoolExecutor
        out, held, size = [], [], 0
        with ThreadPoolExecutor(16) as pool:
            for units in pool.map(self.directory, files):
                for unit, n in units:
                    if held and size + n > self.partition_bytes:
                        out.append(Members(held))
                        held, size = [], 0
                    held.append(unit)
                    size += n
        return [*out, Members(held)] if held else out

    def rows(self, unit: tuple):
        path, version, member, error = unit
        if error is None:
            try:
                with _open_archive(path) as raw, zipfile.ZipFile(raw) as zf, zf.open(member) as data:
                    text = io.TextIOWrapper(data, encoding=self.encoding, errors="replace", newline="")
                    for i, line in enumerate(_records(text, self.quote)):
                        yield path, member, i, line, None, version
            except DAMAGE as e:
                if _not_damage(e, True):
                    raise
                error = f"{type(e).__name__}: {e}"
        if error is not None:
            yield path, None, None, None, error, version

    def read(self, partition: Members):
        import pyarrow as pa
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

        def batch(held):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
        held: list = []
        for unit in partition.units:
            for row in self.rows(unit):
                held.append(row)
                if len(held) >= self.batch_rows:
                    yield batch(held)
                    held = []
        if held:
            yield batch(held)


class ZipReader(ZipLines, DataSourceReader):
    def partitions(self):
        files = [tuple(f) for f in json.loads(self.files)] if self.files else \
            sorted((p, modified) for p, (_, modified) in listed(self.path).items())
        return self.plan(files) or [Members([])]


class ZipStreamReader(ZipLines, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        if not options.get("ledger"):
            raise ValueError("a registry_zip stream needs the option ledger")
        self.ledger = options["ledger"]

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        listings = Listings(self.ledger)
        last, found = listings.last(), listed(self.path)
        if found != listings.get(last):
            last += 1
            listings.put(last, found)
        return {"listing": last}

    def partitions(self, start: dict, end: dict):
        listings = Listings(self.ledger)
        before, after = listings.get(start["listing"]), listings.get(end["listing"])
        out = self.plan([(p, end["listing"]) for p in sorted(after) if after[p] != before.get(p)])
        gone = [(p, end["listing"], None, "Removed: the archive is no longer there") for p in sorted(before) if p not in after]
        return [*out, Members(gone)] if gone else out

    def commit(self, end: dict) -> None:
        pass


class ZipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "registry_zip"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return ZipReader(self.options)

    def streamReader(self, schema):
        return ZipStreamReader(self.options)


_REGISTERED: set = set()


def register_zip_source(spark: SparkSession) -> None:
    app = spark.sparkContext.applicationId
    if app not in _REGISTERED:
        spark.dataSource.register(ZipSource)
        _REGISTERED.add(app)


def zip_lines(spark: SparkSession, files: list, **options) -> DataFrame:
    """Lines of the archives ``files`` ([path, version])."""
    register_zip_source(spark)
    return spark.read.format("registry_zip").options(files=json.dumps(files), **options).load()


def zip_line_stream(spark: SparkSession, folder: str, ledger: str, **options) -> DataFrame:
    """Stream of the lines of archives that appear, or appear anew, under a folder."""
    register_zip_source(spark)
    return spark.readStream.format("registry_zip").options(path=folder, ledger=ledger, **options).load()


_ship_by_value(__name__)
