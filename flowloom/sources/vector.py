"""Vector files: GeoJSON, GeoPackage and Shapefile, read and written.

GeoJSON goes through Spark's own readers and writers. GeoPackages and Shapefiles are
single files by design: the bytes come through Spark's binary reader (so any store that
Spark reads will do) and are parsed on an executor, one file a task.
"""

from __future__ import annotations

import json
import os
import sqlite3
import struct
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import ID, FlowFrame
from ..functions.crs import normalise
from ..functions.flow import COORDINATES

ENDS = "ox double, oy double, dx double, dy double"
LINE, MULTIPOINT = 2, 4  # WKB kinds
SHP_NULL, SHP_LINE, SHP_MULTIPOINT = 0, 3, 8


def read_file(spark: SparkSession, path: str, driver: str | None = None, layer: str | None = None, crs=None) -> FlowFrame:
    """Lines and multipoints of a vector file as flows between their first and last vertex, attributes kept, in file order."""
    kind = driver or {".geojson": "GeoJSON", ".json": "GeoJSON", ".gpkg": "GPKG", ".sqlite": "GPKG", ".shp": "Shapefile", ".parquet": "Parquet"}.get(os.path.splitext(path)[1].lower())
    readers = {"GeoJSON": _read_geojson, "GPKG": _read_gpkg, "Shapefile": _read_shapefile, "ESRI Shapefile": _read_shapefile, "Parquet": lambda s, p, _: (s.read.parquet(p), None)}
    if kind not in readers:
        raise NotImplementedError(f"no reader for {path}")
    df, found = readers[kind](spark, path, layer)
    return FlowFrame(df, crs if crs is not None else found)


def to_file(frame: FlowFrame, path: str, driver: str | None = None, mode: str = "w", layer: str | None = None) -> None:
    """Write flows as two-vertex lines. mode 'a' appends. GeoPackages and Shapefiles are one file, so their rows stream through the driver."""
    kind = driver or {".geojson": "GeoJSON", ".json": "GeoJSON", ".gpkg": "GPKG", ".sqlite": "GPKG", ".shp": "Shapefile", ".parquet": "Parquet", ".csv": "CSV"}.get(os.path.splitext(path)[1].lower())
    if mode not in ("w", "a"):
        raise ValueError("mode must be w or a")
    spark_mode = "overwrite" if mode == "w" else "append"
    if kind == "Parquet":
        frame.df.write.mode(spark_mode).parquet(path)
    elif kind == "CSV":
        frame.df.write.mode(spark_mode).csv(path, header=True)
    elif kind == "GeoJSON":
        _write_geojson(frame, path, spark_mode)
    elif kind == "GPKG":
        _write_gpkg(frame, path, mode, layer or "flows")
    elif kind in ("Shapefile", "ESRI Shapefile"):
        _write_shapefile(frame, path, mode)
    else:
        raise NotImplementedError(f"no writer for {path}")


# ---------------------------------------------------------------- GeoJSON


def _read_geojson(spark: SparkSession, path: str, _layer) -> tuple[DataFrame, str | None]:
    """A FeatureCollection file, or a folder of newline-delimited features as the writer here makes it."""
    whole = spark.read.text(path, wholetext=True).limit(1).first()
    head = (whole[0] if whole else "").lstrip()
    collection = '"FeatureCollection"' in head[:2000]
    raw = spark.read.option("multiLine", collection).json(path)
    features = raw.select(F.explode("features").alias("f")) if collection else raw.select(F.struct("geometry", "properties").alias("f"))
    kind = F.lower(F.col("f.geometry.type"))
    checked = F.when(kind.isin("linestring", "multipoint", "flow"), F.col("f.geometry.coordinates")).when(F.col("f.geometry").isNull(), None).otherwise(F.raise_error(F.concat(F.lit("not a line or multipoint: "), F.col("f.geometry.type"))))
    first, last = F.get(checked, F.lit(0)), F.element_at(checked, -1)
    ends = [first[0].cast("double").alias("ox"), first[1].cast("double").alias("oy"), last[0].cast("double").alias("dx"), last[1].cast("double").alias("dy")]
    named = json.loads(head)["crs"]["properties"]["name"] if collection and '"crs"' in head else None
    crs = None
    if named:
        crs = "EPSG:4326" if "CRS84" in named else normalise(named.rsplit(":", 1)[-1])
    has_properties = "properties" in features.select("f.*").columns
    attributes = features.select("f.properties.*").columns if has_properties else []
    return features.select(*ends, *[F.col(f"f.properties.`{a}`") for a in attributes if a not in COORDINATES]), crs


def feature_json() -> tuple:
    line = F.struct(F.lit("LineString").alias("type"), F.array(F.array("ox", "oy"), F.array("dx", "dy")).alias("coordinates"))
    return line


def _write_geojson(frame: FlowFrame, path: str, mode: str) -> None:
    attributes = [c for c in frame.columns if c not in COORDINATES]
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), feature_json().alias("geometry"), F.struct(*attributes).alias("properties")), {"ignoreNullFields": "false"})
    frame.df.select(feature.alias("value")).write.mode(mode).text(path)


# ---------------------------------------------------------------- parsing of single files


def _parsed(spark: SparkSession, path: str, fields: str, parse) -> DataFrame:
    def run(batches):
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                rows = list(parse(bytes(content)))
                yield pd.DataFrame(rows, columns=[f.strip().split(" ")[0].strip("`") for f in fields.split(",")]) if rows else pd.DataFrame()

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, fields)


def wkb_ends(data: bytes) -> tuple[float, float, float, float] | None:
    """First and last vertex of a WKB line or multipoint."""
    order = "<" if data[0] else ">"
    kind, n = struct.unpack(order + "II", data[1:9])
    width = 2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3) + bool(kind & 0x80000000)
    kind = kind & 0xFF if kind < 1000 or kind & 0x80000000 else kind % 1000
    if kind not in (LINE, MULTIPOINT):
        raise TypeError(f"not a line or multipoint: WKB kind {kind}")
    if not n:
        return None
    step = 8 * width + (5 if kind == MULTIPOINT else 0)
    at = lambda i: struct.unpack(order + "dd", data[9 + i * step + (5 if kind == MULTIPOINT else 0) :][:16])
    return (*at(0), *at(n - 1))


# ---------------------------------------------------------------- GeoPackage


def _opened(content: bytes) -> tuple[sqlite3.Connection, str]:
    handle, name = tempfile.mkstemp(suffix=".gpkg")
    with os.fdopen(handle, "wb") as f:
        f.write(content)
    return sqlite3.connect(name), name


def _gpkg_layer(db: sqlite3.Connection, layer: str | None) -> tuple[str, str, int, list[tuple[str, str]]]:
    """(table, geometry column, EPSG, attributes with SQL types)."""
    rows = db.execute("select table_name, column_name, srs_id from gpkg_geometry_columns").fetchall()
    table, column, srs = next((r for r in rows if layer in (None, r[0])), (None, None, None))
    if table is None:
        raise ValueError(f"no layer {layer!r}; there are {[r[0] for r in rows]}")
    kinds = {"INTEGER": "long", "MEDIUMINT": "long", "INT": "long", "SMALLINT": "long", "TINYINT": "long", "BOOLEAN": "long", "REAL": "double", "DOUBLE": "double", "FLOAT": "double"}
    info = db.execute(f'pragma table_info("{table}")').fetchall()
    return table, column, srs, [(r[1], kinds.get(r[2].split("(")[0].upper(), "string")) for r in info if r[1] != column and not r[5]]


def _read_gpkg(spark: SparkSession, path: str, layer: str | None) -> tuple[DataFrame, str | None]:
    first = spark.read.format("binaryFile").load(path).select("content").first()
    db, name = _opened(bytes(first["content"]))
    try:
        _, _, srs, attributes = _gpkg_layer(db, layer)
    finally:
        db.close()
        os.unlink(name)
    attributes = [a for a in attributes if a[0] not in COORDINATES]

    def parse(content: bytes) -> Iterator[tuple]:
        own, file = _opened(content)
        try:
            table, column, _, _ = _gpkg_layer(own, layer)
            chosen = "".join(f', "{a}"' for a, _ in attributes)
            for blob, *values in own.execute(f'select "{column}"{chosen} from "{table}" order by rowid'):
                ends = None
                if blob is not None:
                    envelope = (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
                    ends = None if blob[3] >> 4 & 1 else wkb_ends(blob[8 + envelope :])
                yield (*(ends or (None,) * 4), *(str(v) if k == "string" and v is not None else v for v, (_, k) in zip(values, attributes, strict=True)))
        finally:
            own.close()
            os.unlink(file)

    fields = ", ".join([ENDS, *(f"`{a}` {k}" for a, k in attributes)])
    return _parsed(spark, path, fields, parse), f"EPSG:{srs}" if srs and srs > 0 else None


def _write_gpkg(frame: FlowFrame, path: str, mode: str, layer: str) -> None:
    if mode == "w" and os.path.exists(path):
        os.unlink(path)
    attributes = [(f.name, {"long": "INTEGER", "integer": "INTEGER", "short": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL"}.get(f.dataType.typeName(), "TEXT")) for f in frame.df.schema.fields if f.name not in COORDINATES]
    srs = int(frame.crs[5:]) if frame.crs else -1
    db = sqlite3.connect(path)
    with db:
        # The tables that the GeoPackage standard asks for.
        db.execute("pragma application_id = 1196444487")
        db.execute("create table if not exists gpkg_spatial_ref_sys (srs_name text not null, srs_id integer primary key, organization text not null, organization_coordsys_id integer not null, definition text not null, description text)")
        db.executemany("insert or ignore into gpkg_spatial_ref_sys values (?, ?, ?, ?, 'undefined', null)", [("Undefined Cartesian", -1, "NONE", -1), ("Undefined geographic", 0, "NONE", 0), (f"EPSG {srs}", srs, "EPSG", srs)])
        db.execute("create table if not exists gpkg_contents (table_name text primary key, data_type text not null, identifier text unique, description text default '', last_change text default current_timestamp, min_x double, min_y double, max_x double, max_y double, srs_id integer)")
        db.execute("create table if not exists gpkg_geometry_columns (table_name text primary key, column_name text not null, geometry_type_name text not null, srs_id integer not null, z tinyint not null, m tinyint not null)")
        db.execute("insert or ignore into gpkg_contents (table_name, data_type, identifier, srs_id) values (?, 'features', ?, ?)", (layer, layer, srs))
        db.execute("insert or ignore into gpkg_geometry_columns values (?, 'geom', 'LINESTRING', ?, 0, 0)", (layer, srs))
        db.execute(f'create table if not exists "{layer}" (fid integer primary key autoincrement, geom blob, ' + ", ".join(f'"{a}" {k}' for a, k in attributes) + ")")
        head = b"GP\0\x01" + struct.pack("<i", srs)
        marks = ", ".join("?" * (1 + len(attributes)))
        names = ", ".join(["geom", *(f'"{a}"' for a, _ in attributes)])

        def rows():
            for r in frame.df.orderBy(ID).toLocalIterator():
                geom = None if r["ox"] is None else head + struct.pack("<BIIdddd", 1, LINE, 2, r["ox"], r["oy"], r["dx"], r["dy"])
                yield (geom, *(r[a] if k != "TEXT" or r[a] is None else str(r[a]) for a, k in attributes))

        db.executemany(f'insert into "{layer}" ({names}) values ({marks})', rows())
    db.close()


# ---------------------------------------------------------------- Shapefile


def _shp_rows(shp: bytes) -> Iterator[tuple[float, float, float, float] | None]:
    at = 100
    while at + 8 <= len(shp):
        n = 2 * struct.unpack(">i", shp[at + 4 : at + 8])[0]
        body, at = shp[at + 8 : at + 8 + n], at + 8 + n
        kind = struct.unpack("<i", body[:4])[0] % 10
        if kind == SHP_NULL:
            yield None
            continue
        if kind == SHP_LINE:
            parts, points = struct.unpack("<ii", body[36:44])
            begin = 44 + 4 * parts
        elif kind == SHP_MULTIPOINT:
            points, begin = struct.unpack("<i", body[36:40])[0], 40
        else:
            raise TypeError(f"not a line or multipoint: shape kind {kind}")
        yield (*struct.unpack("<dd", body[begin : begin + 16]), *struct.unpack("<dd", body[begin + 16 * (points - 1) : begin + 16 * points]))


def _dbf_fields(dbf: bytes) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """(records, header size, record size, fields as (name, kind, width, decimals))."""
    n, header, size = struct.unpack("<IHH", dbf[4:12])
    fields, at = [], 32
    while dbf[at] != 0x0D:
        f = dbf[at : at + 32]
        fields.append((f[:11].split(b"\0")[0].decode(), chr(f[11]), f[16], f[17]))
        at += 32
    return n, header, size, fields


def _dbf_value(raw: bytes, kind: str, decimals: int):
    text = raw.decode("utf-8", "replace").strip()
    if kind in "NF":
        return None if not text.strip("*") else float(text) if decimals or kind == "F" else int(text)
    return text or None


def _read_shapefile(spark: SparkSession, path: str, _layer) -> tuple[DataFrame, str | None]:
    """The .shp with the .dbf and .prj beside it; parsed in one task."""
    stem = os.path.splitext(path)[0]
    binary = lambda p: spark.read.format("binaryFile").load(p).select("content")
    _, _, _, fields = _dbf_fields(bytes(binary(stem + ".dbf").first()["content"]))
    fields = [f for f in fields if f[0] not in COORDINATES]
    types = [(name, "double" if kind == "F" or kind == "N" and decimals else "long" if kind == "N" else "string") for name, kind, _, decimals in fields]
    both = binary(path).withColumnRenamed("content", "shp").join(binary(stem + ".dbf").withColumnRenamed("content", "dbf"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for shp, dbf in zip(pdf["shp"], pdf["dbf"], strict=True):
                _, header, size, every = _dbf_fields(bytes(dbf))
                rows = []
                for i, ends in enumerate(_shp_rows(bytes(shp))):
                    record, at, values = dbf[header + i * size + 1 : header + (i + 1) * size], 0, []
                    for name, kind, width, decimals in every:
                        if name not in COORDINATES:
                            values.append(_dbf_value(bytes(record[at : at + width]), kind, decimals))
                        at += width
                    rows.append((*(ends or (None,) * 4), *values))
                if rows:
                    yield pd.DataFrame(rows, columns=[*COORDINATES, *(t[0] for t in types)])

    out = both.mapInPandas(run, ", ".join([ENDS, *(f"`{n}` {k}" for n, k in types)]))
    try:
        prj = spark.read.text(stem + ".prj", wholetext=True).first()[0]
        crs = f"EPSG:{prj.rsplit('\"', 2)[1]}" if "AUTHORITY" in prj else None
    except Exception:  # noqa: BLE001 - any store's way to say that there is no such file
        crs = None
    return out, crs


def _write_shapefile(frame: FlowFrame, path: str, mode: str) -> None:
    """Attribute names are cut to ten bytes and texts to 254, as the format has it."""
    if mode == "a":
        raise NotImplementedError("a Shapefile is written whole")
    stem = os.path.splitext(path)[0]
    layout = []
    for f in frame.df.schema.fields:
        if f.name in COORDINATES:
            continue
        kind = f.dataType.typeName()
        layout.append((f.name, *(("N", 19, 0) if kind in ("long", "integer", "short", "byte", "boolean") else ("N", 24, 12) if kind in ("double", "float") else ("C", 254, 0))))
    shapes, index, records, n, at = [], [], [], 0, 50
    box = [float("inf"), float("inf"), float("-inf"), float("-inf")]
    for r in frame.df.orderBy(ID).toLocalIterator():
        n += 1
        if r["ox"] is None:
            body = struct.pack("<i", SHP_NULL)
        else:
            x0, x1 = sorted((r["ox"], r["dx"]))
            y0, y1 = sorted((r["oy"], r["dy"]))
            box = [min(box[0], x0), min(box[1], y0), max(box[2], x1), max(box[3], y1)]
            body = struct.pack("<i4dii i4d", SHP_LINE, x0, y0, x1, y1, 1, 2, 0, r["ox"], r["oy"], r["dx"], r["dy"])
        shapes.append(struct.pack(">ii", n, len(body) // 2) + body)
        index.append(struct.pack(">ii", at, len(body) // 2))
        at += 4 + len(body) // 2
        record = b" "
        for name, kind, width, decimals in layout:
            v = r[name]
            text = "" if v is None else f"{float(v):.{decimals}f}" if decimals else str(int(v)) if kind == "N" else str(v)
            raw = text.encode()[:width]
            record += raw.rjust(width) if kind == "N" else raw.ljust(width)
        records.append(record)
    box = box if n and box[0] <= box[2] else [0.0] * 4
    head = lambda size: struct.pack(">i20xi", 9994, size) + struct.pack("<ii4d32x", 1000, SHP_LINE, *box)
    with open(stem + ".shp", "wb") as f:
        f.write(head(at) + b"".join(shapes))
    with open(stem + ".shx", "wb") as f:
        f.write(head(50 + 4 * n) + b"".join(index))
    fields = b"".join(name.encode()[:10].ljust(11, b"\0") + kind.encode() + bytes(4) + bytes([width, decimals]) + bytes(14) for name, kind, width, decimals in layout)
    with open(stem + ".dbf", "wb") as f:
        f.write(struct.pack("<BBBBIHH20x", 3, 126, 1, 1, n, 33 + 32 * len(layout), 1 + sum(x[2] for x in layout)) + fields + b"\r" + b"".join(records) + b"\x1a")
    if frame.crs:
        with open(stem + ".prj", "w") as f:
            f.write(f'LOCAL_CS["EPSG {frame.crs[5:]}",AUTHORITY["EPSG","{frame.crs[5:]}"]]')
