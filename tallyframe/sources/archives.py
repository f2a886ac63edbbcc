"""Members of zip archives as a Spark data source: one input partition a member, read as a stream."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterator
from fnmatch import fnmatch
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PLACE = "archive string, member string, line long"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _archives(path: str) -> list[str]:
    """The archives below a folder, or the one named, in order."""
    system, at = _opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    start = path.rstrip("/")
    return sorted(start + f.path[len(at.rstrip("/")) :] for f in found if f.type == fs.FileType.File and f.path.endswith(".zip"))


class _Member(InputPartition):
    def __init__(self, archive: str, member: str):
        self.archive, self.member = archive, member


class _Reader(DataSourceReader):
    """Lists members from the archives' own directories, without unpacking, and reads each as a stream of rows."""

    def __init__(self, options: dict[str, str]):
        self.path, self.pattern, self.format = options["path"], options.get("member", "*"), options.get("kind", "csv")
        self.encoding, self.columns = options.get("encoding", "utf-8"), json.loads(options["columns"])
        self.attribute = options.get("attribute")

    def partitions(self) -> list[_Member]:
        out = []
        for archive in _archives(self.path):
            system, at = _opened(archive)
            with system.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                out += [_Member(archive, n) for n in sorted(z.namelist()) if fnmatch(n, self.pattern) and not n.endswith("/")]
        return out

    def read(self, partition: _Member) -> Iterator[tuple]:
        system, at = _opened(partition.archive)
        name = partition.archive.rstrip("/").rpartition("/")[2]
        with system.open_input_file(at) as f, zipfile.ZipFile(f) as z, z.open(partition.member) as raw:
            for line, values in (self.elements if self.format == "xml" else self.records)(raw):
                yield (name, partition.member, line, *values)

    def records(self, raw: io.BufferedIOBase) -> Iterator[tuple[int, tuple]]:
        """Values by the header's names; a record of another length has its text in ``_bad_record`` and no values."""
        rows = csv.reader(io.TextIOWrapper(raw, self.encoding, newline=""))
        header = next(rows, None)
        if header is None:
            return
        if lost := [c for c in self.columns if c not in header]:
            raise ValueError(f"no column {', '.join(lost)} in the header {header}")
        at = [header.index(c) for c in self.columns]
        for row in rows:
            if len(row) == len(header):
                yield rows.line_num, (*(row[i] for i in at), None)
            elif row:
                yield rows.line_num, (*(None for _ in at), ",".join(row))

    def elements(self, raw: io.BufferedIOBase) -> Iterator[tuple[int, tuple]]:
        """Elements that carry the attribute, with all their attributes as a JSON object."""
        n = inside = 0
        for event, e in ElementTree.iterparse(raw, ["start", "end"]):
            wanted = self.attribute is None or self.attribute in e.attrib
            if event == "start":
                inside += wanted
                continue
            if wanted:
                n, inside = n + 1, inside - 1
                yield n, (e.tag.rpartition("}")[2], json.dumps(e.attrib, ensure_ascii=False), "".join(e.itertext()))
            if not inside:
                e.clear()


class ArchiveMembers(DataSource):
    """Options: ``path`` (an archive or a folder of them), ``member`` (a pattern), ``kind`` (csv or xml), ``encoding``, ``columns`` (JSON), ``attribute``."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        if self.options.get("kind") == "xml":
            return f"{PLACE}, tag string, attributes string, text string"
        return ", ".join([PLACE, *(f"`{c}` string" for c in json.loads(self.options["columns"])), "_bad_record string"])

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(dict(self.options))


def _load(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(ArchiveMembers)
    return spark.read.format("archive_members").options(path=path, **options).load()


def zip_csv(spark: SparkSession, path: str, member: str, schema: str, encoding: str = "utf-8", on_bad: str = "report") -> DataFrame:
    """CSV members of zip archives whose names match a pattern: ``archive, member, line``, the typed columns and ``bad``.

    ``bad`` lists the columns whose text is no value of their type (they are null), or ``*`` for a record of another length than the
    header. With ``on_bad`` 'fail' such a row stops the read. Empty texts are null. A column that a header lacks stops the read too.
    """
    fields = T.StructType.fromDDL(schema).fields
    rows = _load(spark, path, member=member, encoding=encoding, columns=json.dumps([f.name for f in fields]))
    text = {f.name: F.nullif(F.col(f"`{f.name}`"), F.lit("")) for f in fields}
    typed = {f.name: text[f.name].try_cast(f.dataType) for f in fields}
    wrong: list[Column] = [F.when(text[n].isNotNull() & typed[n].isNull(), F.lit(n)) for n in typed]
    bad = F.when(F.col("_bad_record").isNotNull(), F.array(F.lit("*"))).otherwise(F.array_compact(F.array(*wrong)))
    out = rows.select("archive", "member", "line", *(v.alias(n) for n, v in typed.items()), bad.alias("bad"), "_bad_record")
    if on_bad == "fail":
        where = F.concat_ws(" ", F.lit("bad row"), "archive", "member", F.col("line").cast("string"), F.array_join("bad", ","))
        out = out.withColumn("bad", F.when(F.size("bad") > 0, F.raise_error(where).cast("array<string>")).otherwise(F.col("bad")))
    elif on_bad != "report":
        raise ValueError(f"on_bad must be report or fail, not {on_bad}")
    return out.drop("_bad_record")


def zip_xml(spark: SparkSession, path: str, member: str, attribute: str) -> DataFrame:
    """Elements of XML members that carry an attribute: ``archive, member, line`` (their number), ``tag``, ``attributes`` (a map) and ``text``."""
    rows = _load(spark, path, member=member, kind="xml", columns="[]", attribute=attribute)
    return rows.withColumn("attributes", F.from_json("attributes", "map<string, string>"))


def write_zips(df: DataFrame, folder: str, member: str, columns: list[str]) -> None:
    """One archive for each task's rows, with a CSV member for each value of the column ``member``; archives are named by their task, so a task that runs twice leaves one."""
    _opened(folder)[0].create_dir(_opened(folder)[1], recursive=True)

    def run(batches):  # noqa: ANN001, ANN202
        from pyspark import TaskContext

        number, files, z = TaskContext.get().partitionId(), {}, io.BytesIO()
        for batch in batches:
            for row in batch.to_pylist():
                text = files.setdefault(row[member], io.StringIO())
                if not text.tell():
                    csv.writer(text).writerow(columns)
                csv.writer(text).writerow(["" if row[c] is None else row[c] for c in columns])
        with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, text in files.items():
                archive.writestr(f"data/{name}.csv", text.getvalue())
        if files:
            system, at = _opened(f"{folder}/archive-{number:05d}.zip")
            with system.open_output_stream(at) as out:
                out.write(z.getvalue())
        yield from ()

    df.select(*dict.fromkeys([member, *columns])).mapInArrow(run, "done boolean").collect()
