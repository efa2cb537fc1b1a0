"""STAR tables as a Python data source: spark.read.format("star").load(path) and df.write.format("star").save(folder).

Reading: the header's order of names counts, not its numbers; rows end at the first line whose number of fields differs
(option ``extra`` = true tolerates more fields); option ``unknown`` = skip leaves unknown columns out. Writing: a null is
``?``, and text with blanks, empty text and a lone ``?`` are quoted, so that every row reads back as it was; text with a
line end or a quote before a blank has no form in this format and raises. Mode overwrite replaces the folder's tables,
append adds files (a row is appended as a table of one row), and a table without rows leaves a header. Any store that
pyarrow.fs knows serves; paths without a scheme are local.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quadrat.schema import struct

FIELD = re.compile(r'"(?:[^"]|"(?=\S))*"(?!\S)|\S+')


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


def header(lines: list[str]) -> tuple[list[str], int]:
    """(names, number of the first data line)."""
    names, k = [], 0
    while k < len(lines) and not lines[k].strip().startswith("loop_"):
        k += 1
    k += 1
    while k < len(lines) and lines[k].strip().startswith("_"):
        names.append(lines[k].split()[0])
        k += 1
    return names, k


def parse(text: str, schema: T.StructType, extra: bool = False) -> Iterator[tuple]:
    lines = text.split("\n")
    names, k = header(lines)
    at = [names.index(f.name) for f in schema]
    for line in lines[k:]:
        fields = FIELD.findall(line)
        if len(fields) < len(names) or (len(fields) > len(names) and not extra):
            return
        yield tuple(convert(fields[i], f.dataType) for i, f in zip(at, schema))


def convert(field: str, kind: T.DataType):
    """Integers may be written as 3.0."""
    if field == "?":
        return None
    field = field[1:-1] if len(field) > 1 and field[0] == field[-1] == '"' else field
    return field if isinstance(kind, T.StringType) else int(float(field)) if isinstance(kind, T.IntegerType) else float(field)


def field_of(value) -> str:
    if value is None:
        return "?"
    if not isinstance(value, str):
        return str(value)
    if re.search(r"[\r\n]|\"\s", value):
        raise ValueError(f"no STAR field can hold {value!r}")
    return f'"{value}"' if value in ("", "?") or value[0] in "\"_#" or re.search(r"\s", value) else value


def header_of(names: list[str]) -> str:
    return "\ndata_\n\nloop_\n" + "".join(f"{n} #{k}\n" for k, n in enumerate(names, 1))


def text_of(rows: list, names: list[str]) -> str:
    return header_of(names) + "".join("\t".join(map(field_of, r)) + "\n" for r in rows)


class StarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "star"

    def files(self) -> list[tuple[str, str]]:
        """(the load path, the file in its store) of each file."""
        given = self.options["path"]
        where, path = store(given)
        if where.get_file_info(path).type == fs.FileType.Directory:
            found = where.get_file_info(fs.FileSelector(path))
            return sorted((given, f.path) for f in found if f.base_name.endswith(".star") and not f.base_name.startswith("."))
        return [(given, path)]

    def schema(self) -> T.StructType:
        given, path = self.files()[0]
        with store(given)[0].open_input_stream(path) as f:
            names, _ = header(f.read().decode().split("\n"))
        if self.options.get("unknown") == "skip":
            from quadrat.schema import REGISTRY

            names = [n for n in names if n in REGISTRY]
        return struct(names)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return StarReader(schema, self.files(), self.options.get("extra") == "true")

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return StarWriter(schema, self.options["path"], overwrite)


class StarReader(DataSourceReader):
    def __init__(self, schema: T.StructType, files: list[tuple[str, str]], extra: bool):
        self.schema, self.files, self.extra = schema, files, extra

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        given, path = partition.value
        with store(given)[0].open_input_stream(path) as f:
            yield from parse(f.read().decode(), self.schema, self.extra)


class Part(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class StarWriter(DataSourceWriter):
    """A file for each partition with rows, renamed into place when all are written."""

    def __init__(self, schema: T.StructType, path: str, overwrite: bool = False):
        self.names, self.given, self.overwrite, self.run = [f.name for f in schema], path, overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator) -> Part:
        where, path = store(self.given)
        to, out = f"{path}/.{uuid.uuid4().hex}.tmp", None
        for row in iterator:
            if out is None:
                where.create_dir(path, recursive=True)
                out = where.open_output_stream(to)
                out.write(header_of(self.names).encode())
            out.write(("\t".join(map(field_of, row)) + "\n").encode())
        if out is None:
            return Part(None)
        out.close()
        return Part(to)

    def commit(self, messages: list) -> None:
        where, path = store(self.given)
        where.create_dir(path, recursive=True)
        old = [f.path for f in where.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".star")]
        parts = [m.path for m in messages if m and m.path]
        for k, part in enumerate(parts):
            where.move(part, f"{path}/part-{self.run}-{k:05d}.star")
        if self.overwrite:
            for f in old:
                where.delete_file(f)
        if not parts and (self.overwrite or not old):
            with where.open_output_stream(f"{path}/part-{self.run}-00000.star") as out:
                out.write(header_of(self.names).encode())

    def abort(self, messages: list) -> None:
        where, _ = store(self.given)
        for m in messages:
            if m and m.path and where.get_file_info(m.path).type == fs.FileType.File:
                where.delete_file(m.path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StarSource)


def read(spark: SparkSession, path: str, names: list[str] | None = None, strict: bool = True, extra: bool = False) -> DataFrame:
    """STAR files of any store that Spark can read, with their path and row_id in the file. names: by default the first file's."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    names = names or header(files.first()["value"].split("\n"))[0]
    schema = struct(names, strict)

    def rows(batches):
        for b in batches:
            for file, text in zip(b["file"], b["value"]):
                got = list(parse(text, schema, extra))
                yield pd.DataFrame([(file, k, *r) for k, r in enumerate(got)], columns=["file", "row_id", *names])

    return files.mapInPandas(rows, T.StructType([T.StructField("file", T.StringType()), T.StructField("row_id", T.LongType()), *schema]))


def particle_points(table: DataFrame, micrograph: str | None = None, classes: list[int] | None = None, origins: bool = True) -> DataFrame:
    """x, y, z and all columns of one micrograph's (all, if null) particles of some classes, less their origins."""
    out = table if micrograph is None else table.where(F.col("_rlnMicrographName") == micrograph)
    out = out if classes is None else out.where(F.col("_rlnClassNumber").isin(classes))
    of = lambda c: F.coalesce(F.col(f"_rlnOrigin{c}"), F.lit(0.0)) if origins and f"_rlnOrigin{c}" in table.columns else F.lit(0.0)
    return out.select("*", *[(F.col(f"_rlnCoordinate{c}") - of(c)).alias(c.lower()) for c in "XYZ"])


def from_points(points: DataFrame, micrograph: str = "tomo_id", classes: str | None = None) -> DataFrame:
    """The particle table of points (x, y, z): micrograph names, coordinates, origins of 0, and class numbers if given."""
    out = [F.col(micrograph).cast("string").alias("_rlnMicrographName")]
    out += [F.col(c.lower()).cast("double").alias(f"_rlnCoordinate{c}") for c in "XYZ"] + [F.lit(0.0).alias(f"_rlnOrigin{c}") for c in "XYZ"]
    return points.select(*out, *([F.col(classes).cast("int").alias("_rlnClassNumber")] if classes else []))


def save_by_micrograph(table: DataFrame, folder: str) -> DataFrame:
    """_psStarFile, _rlnMicrographName, n: a STAR file for each micrograph (whose particles fit a task), and the rows of the list of them.

    Files are named by their micrographs, so a repeated task writes the same file again.
    """
    names = table.columns

    def save(rows: pd.DataFrame) -> pd.DataFrame:
        where, path = store(folder)
        micrograph = rows["_rlnMicrographName"].iloc[0]
        to = f"{path}/{re.sub(r'[^A-Za-z0-9.-]', '_', str(micrograph))}-{uuid.uuid5(uuid.NAMESPACE_URL, str(micrograph)).hex[:8]}.star"
        where.create_dir(path, recursive=True)
        whole = rows[names].astype(object).where(rows[names].notna(), None)
        with where.open_output_stream(to) as out:
            out.write(text_of(whole.itertuples(index=False), names).encode())
        return pd.DataFrame({"_psStarFile": [to], "_rlnMicrographName": [micrograph], "n": [len(rows)]})

    return table.groupBy("_rlnMicrographName").applyInPandas(save, "_psStarFile string, _rlnMicrographName string, n long")
