"""Other formats of the domain: particle lists and filaments in XML, volumes, VTK polydata, CSV, tilt-series texts, catalogs."""

from __future__ import annotations

import ast
import re
import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _per_file(spark: SparkSession, path: str, parse, schema: str, binary: bool = False) -> DataFrame:
    """parse(file, content) -> rows, a task for each batch of files."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("content").alias("value")) if binary else spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    names = [x.strip().split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f, v in zip(b["file"], b["value"]):
                yield pd.DataFrame(list(parse(f, v)), columns=names)

    return files.mapInPandas(run, schema)


PARTICLES = "file string, filename string, x double, y double, z double, shift_x double, shift_y double, shift_z double, rot_z1 double, rot_z2 double, rot_x double, class int, score double"


def _particles(file: str, text: str) -> Iterator[tuple]:
    for e in ET.fromstring(text.encode()).iter("Particle"):
        at = lambda tag, *keys: tuple(float(n.get(k, 0)) if (n := e.find(tag)) is not None else 0.0 for k in keys)  # noqa: E731, B023
        score = e.find("Score")
        klass = e.find("Class")
        yield (file, e.get("Filename"), *at("PickPosition", "X", "Y", "Z"), *at("Shift", "X", "Y", "Z"), *at("Rotation", "Z1", "Z2", "X"), int(float(klass.get("Name", 0))) if klass is not None else 0, float(score.get("Value", "nan")) if score is not None else None)


def particle_lists(spark: SparkSession, path: str) -> DataFrame:
    """Particle list XML files."""
    return _per_file(spark, path, _particles, PARTICLES)


def particle_list_xml(df: DataFrame, path: str) -> None:
    """Rows of PARTICLES (without file) as one particle list per partition."""
    a = lambda tag, **kv: F.concat(F.lit(f"<{tag}"), *[x for k, c in kv.items() for x in (F.lit(f' {k}="'), F.col(c).cast("string"), F.lit('"'))], F.lit("/>"))
    p = F.concat(F.lit('<Particle Filename="'), F.col("filename"), F.lit('">'), a("Rotation", X="rot_x", Z1="rot_z1", Z2="rot_z2"), a("Shift", X="shift_x", Y="shift_y", Z="shift_z"), a("PickPosition", X="x", Y="y", Z="z"), a("Class", Name="class"), F.lit("</Particle>"))
    one = df.withColumn("_f", F.spark_partition_id()).select("_f", p.alias("p")).groupBy("_f").agg(F.concat(F.lit("<ParticleList>"), F.array_join(F.collect_list("p"), "\n"), F.lit("</ParticleList>")).alias("value"))
    one.select("value").write.text(path)


def filaments(spark: SparkSession, path: str) -> DataFrame:
    """Spreadsheet XML of a filament tracer: the sheets' Points (id, x, y, z) and Segments (id, point ids) -> fil_id, seq, x, y, z."""

    def parse(file: str, text: str) -> Iterator[tuple]:
        local = lambda e: e.tag.rsplit("}", 1)[-1]
        sheets: dict[str, list[list[str]]] = {}
        for sheet in (e for e in ET.fromstring(text.encode()).iter() if local(e) == "Worksheet"):
            name = next((v for k, v in sheet.attrib.items() if k.endswith("Name")), "")
            sheets[name] = [[("".join(d.itertext())) for d in row.iter() if local(d) == "Data"] for row in sheet.iter() if local(row) == "Row"]
        points = sheets.get("Points", [])
        head = points[0] if points else []
        at = [next(i for i, h in enumerate(head) if h.split()[0].lower() == c) for c in ("x", "y", "z")] if head else []
        where = {int(float(r[0])): [float(r[i]) for i in at] for r in points[1:]}
        segments = sheets.get("Segments", [])
        ids = next((i for i, h in enumerate(segments[0]) if h.lower().startswith("point ids")), -1) if segments else -1
        for r in segments[1:]:
            for k, p in enumerate(r[ids].split(",")):
                yield file, int(float(r[0])), k, *where[int(p)]

    return _per_file(spark, path, parse, "file string, fil_id long, seq long, x double, y double, z double")


MRC_TYPES = {0: "i1", 1: "i2", 2: "f4", 6: "u2"}
EM_TYPES = {1: "i1", 2: "i2", 4: "i4", 5: "f4", 9: "f8"}


def mrc_header(data: bytes) -> dict:
    order = ">" if data[212:213] == b"\x11" else "<"
    nx, ny, nz, mode = struct.unpack(f"{order}4i", data[:16])
    mx, my, mz = struct.unpack(f"{order}3i", data[28:40])
    cell = struct.unpack(f"{order}3f", data[40:52])
    extra = struct.unpack(f"{order}i", data[92:96])[0]
    return {"order": order, "shape": (nx, ny, nz), "mode": mode, "start": 1024 + extra, "pixel": tuple(c / m if m else 0.0 for c, m in zip(cell, (mx, my, mz)))}


def em_header(data: bytes) -> dict:
    order = ">" if data[0] in (0, 3, 5) else "<"
    return {"order": order, "shape": struct.unpack(f"{order}3i", data[4:16]), "mode": data[3], "start": 512, "pixel": (1.0, 1.0, 1.0)}


def decode_volume(file: str, data: bytes) -> np.ndarray:
    """x, y, z array of an MRC or EM file, by its name."""
    em = file.lower().endswith(".em")
    h = em_header(data) if em else mrc_header(data)
    kind = np.dtype(h["order"] + (EM_TYPES if em else MRC_TYPES)[h["mode"]])
    n = int(np.prod(h["shape"]))
    return np.frombuffer(data, kind, n, h["start"]).reshape(h["shape"], order="F")


def encode_mrc(volume: np.ndarray, pixel: float = 1.0) -> bytes:
    """An MRC file of single precision."""
    v = np.asarray(volume, "<f4")
    head = bytearray(1024)
    struct.pack_into("<10i", head, 0, *v.shape, 2, 0, 0, 0, *v.shape)
    struct.pack_into("<6f", head, 40, *(s * pixel for s in v.shape), 90, 90, 90)
    struct.pack_into("<3i3f", head, 64, 1, 2, 3, float(v.min()), float(v.max()), float(v.mean()))
    head[208:212], head[212:216] = b"MAP ", b"\x44\x44\x00\x00"
    return bytes(head) + v.tobytes(order="F")


def volume_headers(spark: SparkSession, path: str) -> DataFrame:
    def parse(file: str, data: bytes) -> Iterator[tuple]:
        h = em_header(data) if file.lower().endswith(".em") else mrc_header(data)
        yield (file, *map(int, h["shape"]), int(h["mode"]), *map(float, h["pixel"]))

    return _per_file(spark, path, parse, "file string, nx int, ny int, nz int, mode int, pixel_x double, pixel_y double, pixel_z double", binary=True)


def volumes(spark: SparkSession, path: str, slab: int = 16) -> DataFrame:
    """file, x, y, z, value of MRC and EM volumes, decoded slab by slab so that no batch holds a whole volume's rows."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f, data in zip(b["file"], b["content"]):
                v = decode_volume(f, data)
                for z in range(0, v.shape[2], slab):
                    part = v[:, :, z : z + slab]
                    x, y, k = np.indices(part.shape)
                    yield pd.DataFrame({"file": f, "x": x.ravel(), "y": y.ravel(), "z": k.ravel() + z, "value": part.ravel().astype(float)})

    return files.mapInPandas(run, "file string, x long, y long, z long, value double")


def write_volume(voxels: DataFrame, path: str, key: str = "file") -> DataFrame:
    """key, content (an MRC file) of dense voxel rows: a volume for each key, which fits a task; store the rows with any sink."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[["x", "y", "z"]].to_numpy(int)
        v = np.zeros(at.max(0) + 1, "f4")
        v[tuple(at.T)] = pdf["value"]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "content": [encode_mrc(v)]})

    return voxels.groupBy(key).applyInPandas(run, f"{key} string, content binary")


def polydata(spark: SparkSession, path: str) -> DataFrame:
    """VTK XML polydata with ASCII arrays: file, kind (point or cell), id, x, y, z, points (of a cell)."""

    def parse(file: str, text: str) -> Iterator[tuple]:
        piece = next(ET.fromstring(text.encode()).iter("Piece"))
        read = lambda e: np.array(("" if e is None else e.text or "").split(), float)
        points = read(piece.find("Points/DataArray")).reshape(-1, 3)
        for k, p in enumerate(points):
            yield file, "point", k, *map(float, p), None
        n = 0
        for tag in ("Verts", "Lines", "Strips", "Polys"):
            arrays = {d.get("Name"): read(d).astype(int) for d in piece.findall(f"{tag}/DataArray")}
            if "offsets" in arrays:
                for cell in np.split(arrays["connectivity"], arrays["offsets"][:-1]) if len(arrays["offsets"]) else []:
                    yield file, "cell", n, None, None, None, cell.tolist()
                    n += 1

    return _per_file(spark, path, parse, "file string, kind string, id long, x double, y double, z double, points array<long>")


def surface_voxels(points: DataFrame) -> DataFrame:
    """Distinct voxels of a surface's points."""
    return points.select("file", *[F.round(c).cast("long").alias(c) for c in "xyz"]).distinct()


def coordinates_csv(df: DataFrame, path: str, coords_only: bool = False, header: bool = True) -> None:
    (df.select("x", "y", "z") if coords_only else df).write.option("header", header).csv(path)


def microtubules(spark: SparkSession, path: str, coords: tuple[str, str, str], id_col: str) -> DataFrame:
    """mt_id, points of a CSV of samples."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.col(id_col).cast("double").cast("long").alias("mt_id"), F.struct(*[F.col(c).cast("double").alias(a) for a, c in zip("xyz", coords)]).alias("p"), F.monotonically_increasing_id().alias("_k")).groupBy("mt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "p"))), lambda r: r["p"]).alias("points"))


def results_table(spark: SparkSession, path: str, names: list[str], comment: str = "#") -> DataFrame:
    """Blank-separated numbers, comment lines left out, as named double columns."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where((F.col("v") != "") & ~F.startswith("v", F.lit(comment)))
    parts = lines.select(F.split("v", r"\s+").alias("p"))
    return parts.select(*[F.get("p", F.lit(k)).try_cast("double").alias(n) for k, n in enumerate(names)])


def mdoc(spark: SparkSession, path: str) -> DataFrame:
    """file, z, tilt_angle, frame, dose of tilt-series mdoc files."""

    def parse(file: str, text: str) -> Iterator[tuple]:
        for part in text.split("[ZValue =")[1:]:
            kv = dict((k.strip(), v.strip()) for k, _, v in (line.partition("=") for line in part.splitlines()[1:]) if v)
            num = lambda k: float(kv[k]) if k in kv else None  # noqa: E731, B023
            yield file, int(part.split("]")[0]), num("TiltAngle"), kv.get("SubFramePath"), num("ExposureDose")

    return _per_file(spark, path, parse, "file string, z long, tilt_angle double, frame string, dose double")


def tilt_angles(spark: SparkSession, path: str) -> DataFrame:
    """file, k, angle: a number a line."""

    def parse(file: str, text: str) -> Iterator[tuple]:
        for k, line in enumerate(x for x in text.splitlines() if x.strip()):
            yield file, k, float(line.split()[0])

    return _per_file(spark, path, parse, "file string, k long, angle double")


def catalogs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each catalog file of ``name = literal`` lines: identifier (the file's name by default), values as a string map.
    Only literals are read; nothing is executed."""

    def parse(file: str, text: str) -> Iterator[tuple]:
        out = {}
        for node in ast.parse(text).body:
            if isinstance(node, ast.Assign) and isinstance(node.targets[0], ast.Name):
                try:
                    out[node.targets[0].id] = str(ast.literal_eval(node.value))
                except ValueError:
                    continue
        yield file, out.get("identifier", file.rsplit("/", 1)[-1].rsplit(".", 1)[0]), out

    return _per_file(spark, path, parse, "file string, identifier string, values map<string,string>")


def stored_by_tomogram(df: DataFrame, path: str) -> None:
    df.write.partitionBy("tomo_id").parquet(path)


# VTK images and converters


def vti_text(v: np.ndarray, origin: tuple[float, float, float] = (0, 0, 0), spacing: tuple[float, float, float] = (1, 1, 1)) -> str:
    """A volume (x, y, z) as VTK XML image with ASCII scalars, x fastest."""
    extent = " ".join(f"0 {n - 1}" for n in v.shape)
    values = " ".join(map(repr, v.ravel(order="F").astype(float).tolist()))
    place = f'WholeExtent="{extent}" Origin="{" ".join(map(str, origin))}" Spacing="{" ".join(map(str, spacing))}"'
    return f'<?xml version="1.0"?>\n<VTKFile type="ImageData" version="0.1"><ImageData {place}><Piece Extent="{extent}"><PointData Scalars="value"><DataArray type="Float64" Name="value" format="ascii">{values}</DataArray></PointData></Piece></ImageData></VTKFile>\n'


def decode_vti(text: str) -> np.ndarray:
    e = ET.fromstring(text.encode()).find("ImageData")
    ends = list(map(int, e.get("WholeExtent").split()))
    shape = [b - a + 1 for a, b in zip(ends[::2], ends[1::2])]
    return np.array(e.find("Piece/PointData/DataArray").text.split(), float).reshape(shape, order="F")


def vtk_images(spark: SparkSession, path: str) -> DataFrame:
    """file, x, y, z, value of VTK XML images with ASCII scalars."""

    def parse(file: str, text: str) -> Iterator[tuple]:
        v = decode_vti(text)
        for at in np.ndindex(v.shape):
            yield file, *at, float(v[at])

    return _per_file(spark, path, parse, "file string, x long, y long, z long, value double")


def polydata_text(points: list[tuple[float, float, float]], cells: list[list[int]], kind: str = "Polys") -> str:
    """Points and cells as VTK XML polydata with ASCII arrays."""
    ends = np.cumsum([len(c) for c in cells]).tolist()
    array = lambda kind, name, values: f'<DataArray type="{kind}"{name} format="ascii">{" ".join(map(str, values))}</DataArray>'
    flat = array("Float64", ' NumberOfComponents="3"', [repr(float(x)) for p in points for x in p])
    own = array("Int64", ' Name="connectivity"', [i for c in cells for i in c]) + array("Int64", ' Name="offsets"', ends)
    return f'<?xml version="1.0"?>\n<VTKFile type="PolyData" version="0.1"><PolyData><Piece NumberOfPoints="{len(points)}" Number{"Of" + kind}="{len(cells)}"><Points>{flat}</Points><{kind}>{own}</{kind}></Piece></PolyData></VTKFile>\n'


def write_polydata(rows: DataFrame, path: str) -> None:
    """Rows of polydata() as VTK files, one for each file name; a surface fits a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, c = pdf[pdf.kind == "point"].sort_values("id"), pdf[pdf.kind == "cell"].sort_values("id")
        return pd.DataFrame({"value": [polydata_text(list(zip(p.x, p.y, p.z)), [list(map(int, x)) for x in c.points])]})

    rows.groupBy("file").applyInPandas(run, "value string").write.option("lineSep", "\n\n").text(path)


def converted(spark: SparkSession, path: str, to: str) -> DataFrame:
    """file, content: volumes (MRC, EM or VTK images) in another format, mrc or vti; store the rows with any sink."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for f, data in zip(b["path"], b["content"]):
                v = decode_vti(data.decode()) if f.endswith(".vti") else decode_volume(f, data)
                out.append((f.rsplit(".", 1)[0] + f".{to}", encode_mrc(v.astype("f4")) if to == "mrc" else vti_text(v).encode()))
            yield pd.DataFrame(out, columns=["file", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, content binary")


# Domain tables

#: First columns of the domain's results tables.
DOMAINS = {
    "vesicles": ["id", "mean", "std", "min", "max", "radius", "distance"],
    "connections": ["id", "mean", "std", "min", "max", "volume", "surface", "length", "distance"],
    "layers": ["id", "mean", "std", "min", "max", "volume"],
    "clusters": ["id", "n_items", "n_connections", "n_links", "loops"],
    "cleft": ["id", "mean", "std", "min", "max", "volume", "width"],
}


def domain_table(spark: SparkSession, path: str, domain: str) -> DataFrame:
    """identifier (the file's name) and the columns of a domain's results tables; further columns are left out."""
    names = DOMAINS[domain]

    def parse(file: str, text: str) -> Iterator[tuple]:
        who = file.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        for line in text.splitlines():
            parts = line.split()
            if parts and not line.lstrip().startswith("#"):
                num = [float(x) if re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", x) else None for x in parts[: len(names)]]
                if num[0] is not None:
                    yield who, int(num[0]), *num[1:], *[None] * (len(names) - len(num))

    return _per_file(spark, path, parse, "identifier string, id long, " + ", ".join(f"{n} double" for n in names[1:]))


def experiments(spark: SparkSession, catalogs: DataFrame, entry: str, domain: str) -> DataFrame:
    """group, identifier and the domain's columns: the tables that the catalogs name under an entry (a file each), with their category."""
    listed = catalogs.select("identifier", F.col("values")[entry].alias("_path"), F.col("values")["category"].alias("group")).where("_path IS NOT NULL")
    paths = [r["_path"] for r in listed.select("_path").distinct().limit(100_001).collect()]
    if len(paths) > 100_000:
        raise ValueError("more than 100,000 tables")
    rows = domain_table(spark, paths, domain).withColumnRenamed("identifier", "_name")
    name = F.element_at(F.split(F.element_at(F.split("_path", "/"), -1), r"\.(?=[^.]*$)"), 1)
    return rows.join(listed.withColumn("_name", name), "_name").drop("_name", "_path")


def frame_shifts(spark: SparkSession, path: str) -> DataFrame:
    """file, frame, dx, dy: frame alignment logs with a line of shifts for each axis, or two numbers a line."""

    def parse(file: str, text: str) -> Iterator[tuple]:
        rows = [[float(x) for x in line.split()] for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]
        pairs = list(zip(*rows)) if len(rows) == 2 and len(rows[0]) != 2 else rows
        for k, p in enumerate(pairs):
            yield file, k, float(p[0]), float(p[1])

    return _per_file(spark, path, parse, "file string, frame long, dx double, dy double")
