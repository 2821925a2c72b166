"""Zip archive ingestion.

Spark lists the archives.  Where tasks can open them, the ``registry_zip`` data source reads
them, a task for each member (or for several small ones), and inflates each once, checking its
CRC meanwhile.  Archives in other stores are read whole by ``binaryFile`` and verified and unpacked by
one task each.  Text records come in bounded Arrow batches and are parsed JVM-side with
``from_csv``.  A corrupt archive becomes rows with an ``error``; ``split_rejects`` takes all lines of
such an archive away, and it never fails the job.

If a task cannot open an archive, the job fails: none of its rows are left out.
"""

from __future__ import annotations

import errno
import io
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark.schemas import REGISTRY, Dialect
from regspark.session import cut_lineage
from regspark.sources.delimited import CORRUPT_COL

LINES_SCHEMA = T.StructType([
    T.StructField("archive", T.StringType()),
    T.StructField("member", T.StringType()),
    T.StructField("line_no", T.LongType()),
    T.StructField("line", T.StringType()),
    T.StructField("error", T.StringType()),
])
_COLS = [f.name for f in LINES_SCHEMA.fields]
# what one binary cell can hold; a larger archive is opened by its task
MAX_ARCHIVE_BYTES = (1 << 31) - 1024


def _ship_by_value(module_name: str) -> None:
    """Pickle this module's task-side functions by value: executors run them without
    needing the package installed or on their path."""
    import sys
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def _open_archive(path: str):
    """The file of a ``path`` column value, for reading in pieces."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb")
    from urllib.parse import quote
    from pyarrow import fs
    store, inner = fs.FileSystem.from_uri(quote(path, safe="/:@"))
    return store.open_input_file(inner)


def _archives_of(pdf):
    """(path, file, streamed) of each archive: its content or, without one, the opened file."""
    if "content" in pdf:
        for path, content in zip(pdf["path"], pdf["content"]):
            yield path, io.BytesIO(content), False
        return
    for path in pdf["path"]:
        with _open_archive(path) as file:
            yield path, file, True


def _not_damage(e: Exception, streamed: bool) -> bool:
    """Whether reading failed, not the archive; a seek to a damaged offset is EINVAL."""
    return streamed and isinstance(e, OSError) and e.errno != errno.EINVAL


def _records(text, quote: str | None):
    """Yield records from a text stream; with ``quote``, a line break inside a quoted
    field continues the record (doubled-quote escapes keep the quote count even)."""
    if not quote:
        for line in text:
            yield line.rstrip("\r\n")
        return
    buf: list[str] = []
    quotes = 0
    for line in text:
        buf.append(line)
        quotes += line.count(quote)
        if quotes % 2 == 0:
            yield "".join(buf).rstrip("\r\n")
            buf, quotes = [], 0
    if buf:
        yield "".join(buf).rstrip("\r\n")


def _unzip_lines(member_suffix: str | None, encoding: str, first_member_only: bool,
                 batch_rows: int, quote: str | None = None):
    """Per archive: verify every member's CRC first (``testzip``), then emit records.

    Verifying before emitting makes rejection whole-archive without buffering lines and
    without a second pass over the data; bytes that do not decode become U+FFFD, as in
    Spark's own text scans.
    """
    def run(batches):
        rows: list[tuple] = []
        for pdf in batches:
            for path, file, streamed in _archives_of(pdf):
                try:
                    zf = zipfile.ZipFile(file)
                    damaged = zf.testzip()
                    if damaged is not None:
                        raise zipfile.BadZipFile(f"bad CRC in member {damaged}")
                except (zipfile.BadZipFile, zipfile.LargeZipFile, zlib.error, OSError, EOFError,
                        KeyError, NotImplementedError, RuntimeError) as e:
                    if _not_damage(e, streamed):
                        raise
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
                    continue
                with zf:
                    members = sorted(i.filename for i in zf.infolist() if not i.is_dir())
                    if member_suffix:
                        members = [m for m in members if m.lower().endswith(member_suffix.lower())]
                    if first_member_only:
                        members = members[:1]
                    for m in members:
                        with zf.open(m) as raw:
                            text = io.TextIOWrapper(raw, encoding=encoding, errors="replace", newline="")
                            for i, line in enumerate(_records(text, quote)):
                                rows.append((path, m, i, line, None))
                                if len(rows) >= batch_rows:
                                    yield pd.DataFrame(rows, columns=_COLS)
                                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=_COLS)
    return run


def read_archive_lines(spark: SparkSession, path: str, member_suffix: str | None = None,
                       encoding: str = REGISTRY.encoding, first_member_only: bool = False,
                       batch_rows: int = 10_000, glob_filter: str = "*.zip",
                       multi_line_quote: str | None = None) -> DataFrame:
    """``(archive, member, line_no, line, error)`` for every record of every member.

    With ``multi_line_quote`` (the dialect's quote character), a record continues across
    line breaks inside quoted fields; otherwise every physical line is a record.  A damaged
    archive has rows with an ``error``, perhaps beside lines: see ``split_rejects``.
    """
    from regspark.sources.zip_source import OPENED, zip_lines
    bins = spark.read.format("binaryFile").option("pathGlobFilter", glob_filter).load(path)
    files = [[r["path"], r["modified"]] for r in
             bins.select("path", F.unix_micros("modificationTime").alias("modified")).collect()]    # a file list
    if all(p.partition(":")[0] in OPENED for p, _ in files):
        options = {"encoding": encoding, "firstMemberOnly": str(first_member_only).lower(), "batchRows": str(batch_rows),
                   "memberSuffix": member_suffix or "", "quote": multi_line_quote or ""}
        return zip_lines(spark, sorted(files), **options).select(*_COLS)
    fn = _unzip_lines(member_suffix, encoding, first_member_only, batch_rows, multi_line_quote)
    small, large = _archive_files(spark, path, glob_filter)
    return small.mapInPandas(fn, LINES_SCHEMA).unionByName(large.mapInPandas(fn, LINES_SCHEMA))


def _archive_files(spark: SparkSession, path: str, glob_filter: str = "*.zip") -> tuple[DataFrame, DataFrame]:
    """``(path, content)`` of the archives that a cell can hold; ``(path)`` of the larger ones."""
    bins = spark.read.format("binaryFile").option("pathGlobFilter", glob_filter).load(path)
    return (bins.where(F.col("length") <= MAX_ARCHIVE_BYTES).select("path", "content"),
            bins.where(F.col("length") > MAX_ARCHIVE_BYTES).select("path"))


def _list_members(batches):
    """Member names from each archive's directory; nothing is unpacked."""
    for pdf in batches:
        rows = []
        for path, file, streamed in _archives_of(pdf):
            try:
                with zipfile.ZipFile(file) as zf:
                    rows += [(path, i.filename, i.file_size, None) for i in zf.infolist() if not i.is_dir()]
            except (zipfile.BadZipFile, zipfile.LargeZipFile, OSError, EOFError, NotImplementedError) as e:
                if _not_damage(e, streamed):
                    raise
                rows.append((path, None, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=["archive", "member", "n_bytes", "error"])


def read_archive_members(spark: SparkSession, path: str, glob_filter: str = "*.zip") -> DataFrame:
    """``(archive, member, n_bytes, error)`` of every archive, from its directory alone."""
    schema = "archive string, member string, n_bytes double, error string"
    small, large = _archive_files(spark, path, glob_filter)
    return small.mapInPandas(_list_members, schema).unionByName(large.mapInPandas(_list_members, schema)) \
        .withColumn("n_bytes", F.col("n_bytes").cast("long"))


def split_rejects(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good_lines, rejected_archives)``; rejects carry the archive and its error.

    A member's damage may show after some of its lines: no line of a rejected archive is good.
    Both outputs read ``lines``, so pass a written table of them.
    """
    bad = lines.where(F.col("error").isNotNull()).select("archive", "error").groupBy("archive").agg(F.min("error").alias("error"))
    good = lines.where(F.col("error").isNull()).join(bad.select("archive"), "archive", "left_anti").select(*lines.columns)
    return good, bad


def parse_lines(lines: DataFrame, schema: T.StructType, dialect: Dialect = REGISTRY,
                header: bool = False, keep: list[str] = ("archive", "member"),
                spread_partitions: int | None = None, corrupt: bool = False) -> DataFrame:
    """Parse text lines JVM-side into ``schema`` columns (``from_csv``).

    ``corrupt=True`` adds ``_corrupt_record``: the line, if it does not fit the schema.

    ``spread_partitions`` repartitions the lines first, to spread one large archive's
    lines over many tasks before heavier downstream work.
    """
    if header:
        lines = lines.where(F.col("line_no") > 0)
    if spread_partitions:
        lines = lines.repartition(spread_partitions)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    opts = {"sep": dialect.sep, "quote": dialect.quote, "escape": dialect.escape,
            "nullValue": dialect.null_value, "mode": "PERMISSIVE"}
    if corrupt:
        ddl += f", `{CORRUPT_COL}` string"
        opts["columnNameOfCorruptRecord"] = CORRUPT_COL
    parsed = F.from_csv(F.col("line"), ddl, opts).alias("__rec")
    return lines.select(*keep, parsed).select(*keep, "__rec.*")


def read_archives(spark: SparkSession, path: str, schema: T.StructType,
                  dialect: Dialect = REGISTRY, member_suffix: str | None = None,
                  first_member_only: bool = False,
                  spread_partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Typed rows of every archive member plus the rejected archives."""
    lines = read_archive_lines(spark, path, member_suffix, dialect.encoding, first_member_only,
                               multi_line_quote=dialect.quote if dialect.multi_line else None)
    good, bad = split_rejects(cut_lineage(lines, spark, "archive-lines"))       # unzipped once
    return parse_lines(good, schema, dialect, dialect.header, spread_partitions=spread_partitions), bad


def first_member_per_archive(lines: DataFrame) -> DataFrame:
    """``(archive, member)``: the first member (by name) of each readable archive; takes
    :func:`read_archive_members` (directories only) or archive lines."""
    return (lines.where(F.col("error").isNull())
            .groupBy("archive").agg(F.min("member").alias("member")))


_ship_by_value(__name__)
