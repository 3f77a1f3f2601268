"""Map files as a data source: a partition for each group of .shp and .dbf, pruned by what the path says, typed attributes.

    mapfiles.read(spark, folder, floor=["B1"], layer=["Space"])

Groups are pruned by options, not by pushed filters: Spark keeps a pushed filter with the loaded table, so that another
query on the same DataFrame would read pruned files too. Paths are those of pyarrow's file systems: mounted folders, object stores, HDFS.
"""

from __future__ import annotations

import json
import posixpath
import re
import struct
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import scalars
from ..operators import network
from .shapes import decode_shapes

VALUE = pa.struct([("type", pa.string()), ("number", pa.float64()), ("flag", pa.bool_()), ("text", pa.string())])
POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
FIELDS = [("file", pa.string()), ("facility", pa.string()), ("floor", pa.string()), ("layer", pa.string()), ("record", pa.int32()), ("gtype", pa.string()), ("parts", pa.list_(pa.list_(POINT))), ("attributes", pa.map_(pa.string(), VALUE)), ("problem", pa.string())]
SCHEMA = "file string, facility string, floor string, layer string, record int, gtype string, parts array<array<struct<x: double, y: double>>>, attributes map<string, struct<type: string, number: double, flag: boolean, text: string>>, problem string"
BATCH = 4096  # records
NAMED = ("facility", "floor", "layer")  # what a path can say
_NAME = re.compile(r"(.*?)_(-?[A-Za-z]?\d+(?:\.\d+)?(?:out)?)_([A-Za-z]+)", re.I)
_NETWORK = re.compile(r"(.*?)_(node|link)", re.I)


def floor_name(raw: str) -> str:
    """scalars.normalize_floor for one text."""
    v = raw.strip().upper()
    if re.fullmatch(r"-\d+", v):
        return f"B{int(v[1:])}"
    return v.lower() if re.fullmatch(r"\d+OUT", v) else v


def said(file: str) -> tuple[str | None, str | None, str | None]:
    """Facility, floor and layer of <facility>_<floor>_<Layer> or, without a floor, <facility>_node and <facility>_link."""
    stem = posixpath.basename(file)
    if m := _NAME.fullmatch(stem):
        return m[1], floor_name(m[2]), m[3]
    if m := _NETWORK.fullmatch(stem):
        return m[1], None, m[2].lower()
    return None, None, None


def typed(kind: str, raw: bytes) -> dict | None:
    """One attribute: N and F are numbers, L is true for Y and T alone, others are text; blank is null. What should be a
    number and isn't has the type, its text and no number."""
    text = raw.decode("utf-8", "replace").replace("\0", "").strip()
    out = {"type": "text", "number": None, "flag": None, "text": text}
    if not text:
        return None
    if kind in "NF":
        try:
            out |= {"type": "number", "number": float(text), "text": None}
        except ValueError:
            out["type"] = "number"
    elif kind == "L":
        out |= {"type": "boolean", "flag": text in tuple("YyTt"), "text": None}
    return out


def typed_rows(content: bytes):
    """The attributes of each row of a .dbf file, by field; a row that the file cuts off ends it."""
    if len(content) < 32:
        return
    rows, head, size = struct.unpack_from("<IHH", content, 4)
    fields, at, place = [], 32, 1
    while at + 32 <= min(head, len(content)) and content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), chr(content[at + 11]), place, place + content[at + 16]))
        place += content[at + 16]
        at += 32
    for i in range(rows):
        row = content[head + i * size : head + (i + 1) * size]
        if len(row) < size or not size:
            return
        yield {name: typed(kind, row[a:b]) for name, kind, a, b in fields}


@dataclass
class Group(InputPartition):
    """The files of one base name; attributes: whether it has a .dbf file."""

    file: str
    attributes: bool


class MapFilesReader(DataSourceReader):
    def __init__(self, path: str, wanted: dict[str, list[str]]) -> None:
        self.path, self.wanted = path, [(NAMED.index(n), set(v)) for n, v in wanted.items()]

    def partitions(self):
        system, root = fs.FileSystem.from_uri(self.path)
        endings: dict[str, set[str]] = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            base, ending = posixpath.splitext(info.path)
            if info.type == fs.FileType.File and ending in (".shp", ".dbf"):
                endings.setdefault(base, set()).add(ending)
        return [Group(b, ".dbf" in e) for b, e in sorted(endings.items()) if ".shp" in e and all(said(b)[i] in values for i, values in self.wanted)]

    def read(self, partition: Group):
        if not isinstance(partition, Group):  # no group is left: Spark still asks for one partition
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        content = lambda ending: system.open_input_file(partition.file + ending).read()
        rows = list(typed_rows(content(".dbf"))) if partition.attributes else []
        batch = []
        for number, kind, parts in decode_shapes(content(".shp")):
            own = rows[number - 1] if 0 < number <= len(rows) else None
            problem = "skipped" if own is None else "malformed" if parts is None else None
            points = None if parts is None else [[{"x": x, "y": y} for x, y in part] for part in parts]
            batch.append((partition.file, *said(partition.file), number, kind, points, None if own is None else list(own.items()), problem))
            if len(batch) == BATCH:
                yield _record_batch(batch)
                batch = []
        if batch:
            yield _record_batch(batch)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), FIELDS)], names=[n for n, _ in FIELDS])


class MapFiles(DataSource):
    """Records of all groups below a folder, with their attribute row by record number. problem: skipped (no attribute
    row), malformed (no geometry), or null. A group without .shp gives nothing, one without .dbf skipped records."""

    @classmethod
    def name(cls) -> str:
        return "mapfiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MapFilesReader:
        path = self.options["path"]
        wanted = {n: json.loads(self.options[n]) for n in NAMED if n in self.options}
        return MapFilesReader(path if "://" in path or path.startswith("file:") else f"file://{posixpath.abspath(path)}", wanted)


def read(spark: SparkSession, folder: str, **wanted: list[str]) -> DataFrame:
    """The data source's records; wanted: values of facility, floor (a normal one) and layer. Other groups aren't opened."""
    spark.dataSource.register(MapFiles)
    reader = spark.read.format("mapfiles")
    for name, values in wanted.items():
        if name not in NAMED:
            raise ValueError(f"a path doesn't say {name}")
        reader = reader.option(name, json.dumps(values))
    return reader.load(folder)


def _text(field: str) -> Column:
    v = F.col("attributes")[field]
    return F.when(v["type"] == "text", v["text"])


def _number(field: str) -> Column:
    return F.col("attributes")[field]["number"]


def _known(code: Column, names: dict[str, str], what: str, record: Column) -> Column:
    """The code's name; another code stops the job and is named."""
    wrong = F.raise_error(F.concat(F.lit(f"{what} "), F.coalesce(code, F.lit("null")), F.lit(" in record "), record.cast("string")))
    name = scalars.decode(code, names)
    return F.when(name.isNotNull(), name).otherwise(wrong.cast("string"))


def network_nodes(records: DataFrame, lon0: float, lat0: float) -> DataFrame:
    """id, source_record, floor_id, ordinal, in_out, x, y, z of the node layer: points with a numeric ordinal. One of
    them without an id, or with an unknown in_out code, is an error."""
    d = records.where("layer = 'node' and problem is null and gtype = 'Point'").withColumn("ordinal", _number("ordinal")).where("ordinal is not null")
    missing = F.raise_error(F.concat(F.lit("no node_id in record "), F.col("record").cast("string"))).cast("string")
    d = d.select(F.coalesce(_text("node_id"), missing).alias("id"), F.col("record").alias("source_record"), scalars.floor_of_ordinal(F.col("ordinal")).alias("floor_id"), "ordinal", _known(_text("in_out"), scalars.IN_OUT, "in_out", F.col("record")).alias("in_out"), F.col("parts")[0][0].alias("p"))
    local = scalars.lonlat_to_local(F.col("p.x"), F.col("p.y"), lon0, lat0, scalars.floor_elevation(F.col("floor_id")))
    return d.withColumn("at", local).select("id", "source_record", "floor_id", "ordinal", "in_out", "at.x", "at.y", "at.z")


def network_links(records: DataFrame) -> DataFrame:
    """id, source_record, from_id, to_id, source_m, points (degrees), direction_code, route_type of the link layer: records
    with both ends named. Other shapes than lines have no points."""
    d = records.where("layer = 'link' and attributes is not null")
    line = F.transform(F.flatten("parts"), lambda p: F.struct(p.x.alias("x"), F.lit(0.0).alias("y"), p.y.alias("z")))
    d = d.select(_text("link_id").alias("id"), F.col("record").alias("source_record"), _text("start_id").alias("from_id"), _text("end_id").alias("to_id"), _number("distance").alias("source_m"), F.when(F.col("gtype") == "PolyLine", line).alias("points"), _text("direction").alias("direction_code"), _text("route_type").alias("route_type"))
    return d.where("from_id is not null and to_id is not null")


def import_network(spark: SparkSession, folder: str, lon0: float, lat0: float) -> tuple[DataFrame, DataFrame]:
    """Nodes, and links as network.import_links gives them with source_record, direction and kind: from files to a network.

    Only the node and link groups are read. A link with one known end is a boundary link, one with none is foreign; both
    keep their problem and no direction or kind. A selected link without an id or a length, with fewer than two points or
    with an unknown direction code is an error.
    """
    nodes = network_nodes(read(spark, folder, layer=["node"]), lon0, lat0)
    links = network_links(read(spark, folder, layer=["link"]))
    whole = links.withColumn("__row", F.struct("source_record", "direction_code", "route_type"))
    got = network.import_links(whole.withColumn("id", F.struct("id", "__row")), nodes, lon0, lat0)
    got = got.select(F.col("id.id").alias("id"), F.col("id.__row").alias("r"), *got.columns[1:])
    chosen = F.coalesce(~F.col("problem").isin("boundary", "both-ends-missing"), F.lit(True))
    bad = F.col("id").isNull() | F.col("source_m").isNull() | F.coalesce(F.col("problem") == "malformed", F.lit(False))
    stop = F.raise_error(F.concat(F.lit("link record "), F.col("r.source_record").cast("string"), F.lit(" lacks an id, a length or a line")))
    got = got.withColumn("id", F.when(chosen & bad, stop.cast("string")).otherwise(F.col("id")))
    got = got.withColumn("direction", F.when(chosen, _known(F.col("r.direction_code"), scalars.DIRECTIONS, "direction", F.col("r.source_record"))))
    got = got.withColumn("kind", F.when(chosen, scalars.decode(F.col("r.route_type"), scalars.MOVEMENTS, "corridor")))
    return nodes, got.withColumn("source_record", F.col("r.source_record")).withColumn("difference_m", F.round("difference_m", 3)).drop("r")


def network_report(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """measure, key, n: counts of nodes by floor, of links by what became of them (selected, boundary, both-ends-missing), of
    selected ones by kind, direction and whether they change floors, and the largest difference from the source's length in
    millimetres (null: no selected link)."""
    good = links.where("problem is null")
    change = F.when(F.col("floor_from") != F.col("floor_to"), "cross-floor").otherwise("same-floor")
    parts = [(nodes, "nodes", F.col("floor_id")), (links, "links", F.coalesce("problem", F.lit("selected"))), (good, "kind", F.col("kind")), (good, "direction", F.col("direction")), (good, "change", change)]
    out = good.agg(F.lit("difference").alias("measure"), F.lit("max_mm").alias("key"), scalars.millimetres(F.max("difference_m")).alias("n"))
    for d, measure, key in parts:
        out = out.unionByName(d.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).withColumn("measure", F.lit(measure)))
    return out
