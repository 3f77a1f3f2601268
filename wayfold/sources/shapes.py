"""Binary map sources: geometry (.shp) and attribute (.dbf) files as tables, folder inspection and checksums."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ["shp", "shx", "dbf", "prj"]
SHAPE_SCHEMA = "file string, record int, gtype string, parts array<array<struct<x: double, y: double>>>"
ROW_SCHEMA = "file string, record int, attributes map<string, string>"
_KINDS = {1: "Point", 3: "PolyLine", 5: "Polygon"}


def decode_shapes(content: bytes):
    """record number, type, parts of each record; other types than points, lines and polygons have neither."""
    at = 100
    while at + 8 <= len(content):
        number, words = struct.unpack_from(">ii", content, at)
        body = content[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        kind = struct.unpack_from("<i", body)[0] if len(body) >= 4 else 0
        if kind == 1:
            yield number, "Point", [[struct.unpack_from("<dd", body, 4)]]
        elif kind in _KINDS:
            parts, points = struct.unpack_from("<ii", body, 36)
            starts = [*struct.unpack_from(f"<{parts}i", body, 44), points]
            xy = struct.unpack_from(f"<{2 * points}d", body, 44 + 4 * parts)
            yield number, _KINDS[kind], [[(xy[2 * i], xy[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:])]
        else:
            yield number, None, None


def decode_rows(content: bytes):
    """record number and attributes (blank: null) of each row of a .dbf file."""
    rows, head, size = struct.unpack_from("<IHH", content, 4)
    fields, at = [], 32
    while at + 32 <= head and content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), chr(content[at + 11]), content[at + 16]))
        at += 32
    for i in range(rows):
        place, out = head + i * size + 1, {}
        for name, kind, width in fields:
            text = content[place : place + width].decode("utf-8", "replace").replace("\0", "").strip()
            place += width
            out[name] = None if not text else str(text in "YyTt").lower() if kind == "L" else text
        yield i + 1, out


def _files(spark: SparkSession, folder: str, ending: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ending}").option("recursiveFileLookup", "true").load(folder)


def read_shapes(spark: SparkSession, folder: str) -> DataFrame:
    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                rows = [{"file": path.rsplit(".", 1)[0], "record": n, "gtype": k, "parts": None if p is None else [[{"x": x, "y": y} for x, y in q] for q in p]} for n, k, p in decode_shapes(content.as_py())]
                point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), ("record", pa.int32()), ("gtype", pa.string()), ("parts", pa.list_(pa.list_(point)))]))

    return _files(spark, folder, "shp").select("path", "content").mapInArrow(run, SHAPE_SCHEMA)


def read_attributes(spark: SparkSession, folder: str) -> DataFrame:
    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                rows = list(decode_rows(content.as_py()))
                cols = [pa.array([path.rsplit(".", 1)[0]] * len(rows), pa.string()), pa.array([n for n, _ in rows], pa.int32()), pa.array([list(a.items()) for _, a in rows], pa.map_(pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=["file", "record", "attributes"])

    return _files(spark, folder, "dbf").select("path", "content").mapInArrow(run, ROW_SCHEMA)


def features(spark: SparkSession, folder: str) -> DataFrame:
    """Geometry and attributes by record number; problem: no attribute row (skipped) or no geometry (malformed)."""
    d = read_shapes(spark, folder).join(read_attributes(spark, folder), ["file", "record"], "left")
    return d.withColumn("problem", F.when(F.col("attributes").isNull(), "skipped").when(F.col("parts").isNull(), "malformed"))


# Fixed values of the format: geometry types by their code.
SHAPE_NAMES = {0: "Null", 1: "Point", 3: "PolyLine", 5: "Polygon", 8: "MultiPoint", 11: "PointZ", 13: "PolyLineZ", 15: "PolygonZ", 18: "MultiPointZ", 21: "PointM", 23: "PolyLineM", 25: "PolygonM", 28: "MultiPointM", 31: "MultiPatch"}
FACTS = "geometry_type string, bounds array<double>, rows long, fields array<struct<name: string, type: string, width: int, decimals: int>>, encoding string, crs string, warnings array<string>"


def facts(ending: str, content: bytes) -> dict:
    """What one file of a group says of itself; damage is a warning."""
    out = dict.fromkeys(("geometry_type", "bounds", "rows", "fields", "encoding", "crs")) | {"warnings": []}
    if ending == "shp":
        if len(content) < 100 or struct.unpack_from(">i", content)[0] != 9994:
            out["warnings"].append("shp: no header")
        else:
            code = struct.unpack_from("<i", content, 32)[0]
            out |= {"geometry_type": SHAPE_NAMES.get(code, f"unknown-{code}"), "bounds": list(struct.unpack_from("<4d", content, 36))}
    elif ending == "dbf":
        if len(content) < 33:
            out["warnings"].append("dbf: no header")
        else:
            rows, head, size = struct.unpack_from("<IHH", content, 4)
            places = range(32, min(head, len(content)) - 31, 32)
            ends = next((i for i in places if content[i] == 0x0D), head)
            out["rows"] = rows
            out["fields"] = [{"name": content[i : i + 11].split(b"\0")[0].decode("latin-1").strip(), "type": chr(content[i + 11]), "width": content[i + 16], "decimals": content[i + 17]} for i in places if i < ends]
            if size == 0:
                out["warnings"].append("dbf: rows have no width")
            if head + rows * size > len(content):
                out["warnings"].append("dbf: truncated")
    elif ending == "cpg":
        out["encoding"] = content.decode("utf-8", "replace").strip() or "empty"
    elif ending == "prj":
        out["crs"] = content.decode("utf-8", "replace").strip()
    return out


def inspect(spark: SparkSession, folder: str) -> DataFrame:
    """One row a group of files: base, present and missing companions, feasible (shape and attributes can be read), and
    what the headers say: geometry_type, bounds, rows, fields, encoding, crs, warnings."""
    named = lambda d: d.withColumn("base", F.regexp_replace("path", r"\.[^./]+$", "")).withColumn("ending", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    field = pa.struct([("name", pa.string()), ("type", pa.string()), ("width", pa.int32()), ("decimals", pa.int32())])
    kinds = [("base", pa.string()), ("ending", pa.string()), ("geometry_type", pa.string()), ("bounds", pa.list_(pa.float64())), ("rows", pa.int64()), ("fields", pa.list_(field)), ("encoding", pa.string()), ("crs", pa.string()), ("warnings", pa.list_(pa.string()))]

    def run(batches):
        for b in batches:
            rows = [{"base": base, "ending": e} | facts(e, c.as_py()) for base, e, c in zip(b.column("base").to_pylist(), b.column("ending").to_pylist(), b.column("content"))]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    d = named(_files(spark, folder, "*").select("path", "content")).select("base", "ending", "content").mapInArrow(run, f"base string, ending string, {FACTS}")
    known = [F.first(c, ignorenulls=True).alias(c) for c in ("geometry_type", "bounds", "rows", "fields", "encoding", "crs")]
    d = d.groupBy("base").agg(F.array_sort(F.collect_set("ending")).alias("present"), *known, F.array_sort(F.flatten(F.collect_list("warnings"))).alias("warnings"))
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), "present")
    return d.withColumn("missing", missing).withColumn("feasible", F.array_contains("present", "shp") & ~F.array_contains("missing", "dbf"))


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    return _files(spark, folder, "*").select("path", "length", F.sha2("content", 256).alias("sha256"))
