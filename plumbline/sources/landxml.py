"""LandXML 1.2 surfaces: written once, verified byte for byte, read by Spark's own XML source."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.geometry import canonical_zero
from plumbline.model import PlumblineError, SpatialReference, Transform

#: Fixed values of the format.
NAMESPACE, SCHEMA = "http://www.landxml.org/schema/LandXML-1.2", "http://www.w3.org/2001/XMLSchema-instance"
METRIC = '<Metric areaUnit="squareMeter" linearUnit="meter" volumeUnit="cubicMeter" temperatureUnit="celsius" pressureUnit="milliBars" angularUnit="decimal dd.mm.ss" directionUnit="decimal dd.mm.ss"/>'
ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;", "\t": "&#x9;", "\n": "&#xA;", "\r": "&#xD;"}


def escape(value: str) -> str:
    return "".join(ESCAPES.get(c, c) for c in value)


def plain(x: float) -> str:
    """The shortest digits that read back as x, without an exponent."""
    text = format(Decimal(repr(x + 0.0)), "f")
    return text[:-2] if text.endswith(".0") else text


def valid_date(value: str) -> bool:
    return _parses(value, r"\d{4}-\d{2}-\d{2}", "%Y-%m-%d")


def valid_time(value: str) -> bool:
    return _parses(value, r"\d{2}:\d{2}:[0-5]\dZ", "%H:%M:%SZ")


def _parses(value: str, form: str, calendar: str) -> bool:
    try:
        return bool(re.fullmatch(form, value, re.A) and datetime.strptime(value, calendar))
    except ValueError:
        return False


def point_rows(verts: DataFrame, transform: Transform) -> DataFrame:
    """(vertex_id, northing, easting, elevation): the order of the format."""
    e, n, h = (canonical_zero(transform.column(i)) for i in range(3))
    return verts.select("vertex_id", n.alias("northing"), e.alias("easting"), h.alias("elevation"))


def _lines(verts: DataFrame, faces: DataFrame, transform: Transform, reference: SpatialReference, name: str, date: str, time: str) -> Iterator[str]:
    yield '<?xml version="1.0" encoding="UTF-8"?>'
    yield f'<LandXML xmlns="{NAMESPACE}" xmlns:xsi="{SCHEMA}" xsi:schemaLocation="{NAMESPACE} {NAMESPACE}/LandXML-1.2.xsd" version="1.2" date="{date}" time="{time}">'
    h, v = reference.horizontal_epsg, reference.vertical_epsg
    yield f'  <CoordinateSystem name="EPSG:{h}+EPSG:{v}" horizontalCoordinateSystemName="EPSG:{h}" verticalDatum="EPSG:{v}" desc="axes=easting,northing,elevation; horizontalUnit=metre; verticalUnit=metre; provenance={reference.provenance}"/>'
    yield from ("  <Units>", f"    {METRIC}", "  </Units>", "  <Surfaces>", f'    <Surface name="{escape(name)}">', '      <Definition surfType="TIN">', "        <Pnts>")
    for r in point_rows(verts, transform).orderBy("vertex_id").toLocalIterator():  # one partition at a time
        yield f'          <P id="{r.vertex_id}">{plain(r.northing)} {plain(r.easting)} {plain(r.elevation)}</P>'
    yield from ("        </Pnts>", "        <Faces>")
    for r in faces.orderBy("face_id").toLocalIterator():
        yield f"          <F>{r.v1} {r.v2} {r.v3}</F>"
    yield from ("        </Faces>", "      </Definition>", "    </Surface>", "  </Surfaces>", "</LandXML>")


def write(verts: DataFrame, faces: DataFrame, transform: Transform, reference: SpatialReference, target: str, name: str = "surface", date: str = "2024-01-01", time: str = "00:00:00Z", ensure: bool = False) -> str:
    """Writes a new file and returns its digest. With ensure, a file of the same bytes is accepted; another is an error."""
    if not reference.is_metric_survey() or not valid_date(date) or not valid_time(time) or not name:
        raise PlumblineError("an export needs a metric reference, a name, a date and a UTC time")
    if os.path.exists(target) and not ensure:
        raise PlumblineError("the target exists")
    digest, staging = hashlib.sha256(), f"{target}.new"
    with open(staging, "wb") as f:
        for line in _lines(verts, faces, transform, reference, name, date, time):
            data = (line + "\n").encode()
            digest.update(data)
            f.write(data)
        f.flush()
        os.fsync(f.fileno())
    try:
        if os.path.exists(target):
            with open(target, "rb") as f:
                same = hashlib.file_digest(f, "sha256").digest() == digest.digest()
            if not same:
                raise PlumblineError("the target holds other bytes")
        else:
            os.link(staging, target)
    finally:
        os.remove(staging)
    return digest.hexdigest()


#: The elements of the subset that is read: parent, and the attributes that each must have.
_TREE = {"LandXML": (None, ("version",)), "CoordinateSystem": ("LandXML", ("horizontalCoordinateSystemName", "verticalDatum", "desc")), "Units": ("LandXML", ()), "Metric": ("Units", ("linearUnit",)), "Surfaces": ("LandXML", ()), "Surface": ("Surfaces", ("name",)), "Definition": ("Surface", ("surfType",)), "Pnts": ("Definition", ()), "P": ("Pnts", ("id",)), "Faces": ("Definition", ()), "F": ("Faces", ())}


def check_strict(path: str, max_bytes: int = 1 << 30, max_rows: int = 20_000_000) -> tuple[int, int]:
    """Streams a file once and returns its numbers of points and faces; anything outside the subset that write makes is an
    error: other elements or places, repeated single elements, document types, units, ids, numbers that aren't finite.
    Memory holds one element and the ids; files and rows beyond the limits are errors."""
    import math
    from xml.etree import ElementTree

    def fail(why: str):
        raise PlumblineError(f"{os.path.basename(path)}: {why}")

    if os.path.getsize(path) > max_bytes:
        fail(f"more than {max_bytes} bytes")
    with open(path, "rb") as f:
        if re.search(rb"<!(DOCTYPE|ENTITY)", f.read(1 << 16)):
            fail("document types are not read")
    above: list[str] = []
    seen: dict[str, int] = {}
    ids: set[int] = set()
    try:
        for event, e in ElementTree.iterparse(path, events=("start", "end")):
            space, _, name = e.tag.rpartition("}")
            if event == "start":
                if space != "{" + NAMESPACE or name not in _TREE or _TREE[name][0] != (above[-1] if above else None):
                    fail(f"{e.tag} has no place here")
                if missing := [a for a in _TREE[name][1] if a not in e.attrib]:
                    fail(f"{name} lacks {missing}")
                seen[name] = seen.get(name, 0) + 1
                if seen[name] > (max_rows if name in ("P", "F") else 1):
                    fail(f"too many {name}")
                above.append(name)
                continue
            above.pop()
            parts = (e.text or "").split()
            if name == "P":
                if len(parts) != 3 or not all(math.isfinite(float(v)) for v in parts) or not re.fullmatch(r"[1-9]\d{0,17}", e.attrib["id"]) or int(e.attrib["id"]) in ids:
                    fail(f"point {e.attrib['id']}")
                ids.add(int(e.attrib["id"]))
            elif name == "F" and (len(parts) != 3 or not all(re.fullmatch(r"[1-9]\d{0,17}", v) for v in parts)):
                fail(f"face {seen['F']}")
            elif name == "LandXML" and e.attrib["version"] != "1.2" or name == "Definition" and e.attrib["surfType"] != "TIN" or name == "Metric" and e.attrib["linearUnit"] != "meter":
                fail(f"{name} of another kind")
            elif name not in ("P", "F") and parts:
                fail(f"text in {name}")
            e.clear()
    except (ElementTree.ParseError, ValueError) as error:
        if isinstance(error, PlumblineError):
            raise
        fail(str(error))
    if lacking := [n for n in _TREE if n not in seen]:
        fail(f"no {lacking[0]}")
    return seen["P"], seen["F"]


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points: id, x, y, z; faces: v1, v2, v3) of a surface file, which must pass check_strict."""
    check_strict(path)
    p = spark.read.format("xml").option("rowTag", "P").schema("_VALUE string, _id long").load(path)
    xyz = F.split(F.trim("_VALUE"), r"\s+")
    points = p.select(F.col("_id").alias("id"), xyz[1].cast("double").alias("x"), xyz[0].cast("double").alias("y"), xyz[2].cast("double").alias("z"))
    f = spark.read.format("xml").option("rowTag", "F").schema("_VALUE string").load(path)
    ids = F.split(F.trim("_VALUE"), r"\s+")
    return points, f.select(*[ids[i].cast("long").alias(f"v{i + 1}") for i in range(3)])


def read_reference(path: str) -> SpatialReference:
    """The coordinate system of a file; anything but two EPSG codes in metres is unsupported."""
    with open(path, encoding="utf-8") as f:
        head = f.read(1 << 16)
    m = re.search(r'horizontalCoordinateSystemName="EPSG:(\d+)"\s+verticalDatum="EPSG:(\d+)"\s+desc="axes=easting,northing,elevation; horizontalUnit=metre; verticalUnit=metre; provenance=(\w+)"', head)
    if not m:
        raise PlumblineError("no supported coordinate system")
    return SpatialReference(int(m[1]), int(m[2]), provenance=m[3])
