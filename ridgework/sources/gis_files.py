"""Lines and polygons in KML, KMZ, GPX and GeoJSON files: a source that takes damaged files as far as they go, and a writer.

Spark lists and reads the files, whole and each by one task, from any file system it knows.  Markup is scanned as a stream of events
by one expression; nothing is expanded, fetched or handed to a parser of markup.
"""

from __future__ import annotations

import io
import json
import math
import re
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Most elements and depth of a document, most vertices of a file.
MOST_ELEMENTS, MOST_DEPTH, MOST_VERTICES = 200_000, 64, 50_000
SCHEMA = "file string, place int, kind string, name string, rings array<array<struct<lat:double,lng:double>>>, error string"

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)((?:[^\"'>]++|\"[^\"]*\"|'[^']*')*+)>|(<)", re.S)
_ATTRIBUTE = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_REFERENCE = re.compile(r"&(?:(amp|lt|gt|quot|apos)|#([xX][0-9a-fA-F]+|[0-9]+));")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_DIGITS = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_NUMBER = re.compile(_DIGITS)
_HEAD = re.compile(r"[^\s/]*")
#: The two plain forms that nearly all points have; whatever else is read attribute by attribute, tuple by tuple, to the same effect.
_PLAIN_POINT = re.compile(rf"\s+lat\s*=\s*[\"']({_DIGITS})[\"']\s+lon\s*=\s*[\"']({_DIGITS})[\"']\s*/?")
_PLAIN_TUPLES = re.compile(rf"\s*(?:{_DIGITS},{_DIGITS}(?:,[^\s,]*+)*+(?:\s+|\Z))*+")


_LAT, _LON = (rf"\s+{c}=(?:\"({_DIGITS})\"|'({_DIGITS})')" for c in ("lat", "lon"))
_TRKPT = re.compile(rf"\s*<trkpt(?:{_LAT}{_LON}|{_LON}{_LAT})\s*(?:/>|>(?:<ele>[^<>]*+</ele>)?</trkpt>)")
_TRK = re.compile(rf"\s*<trk><name>([^<>]*+)</name>\s*<trkseg>((?:{_TRKPT.pattern})*+)\s*</trkseg>\s*</trk>")
#: Documents of nothing but named tracks of such points.
_PLAIN_GPX = re.compile(rf"\s*(?:<\?xml[^<>]*+>)?\s*<gpx(?:\s+[\w:.-]+=\"[^\"<>]*+\")*+\s*>\s*(?:<metadata><name>[^<>]*+</name></metadata>)?(?P<tracks>(?:{_TRK.pattern})*+)\s*</gpx>\s*")
#: Tokens that are cut off a text at once.
TOKENS = 1 << 16


class BadFile(ValueError):
    """Says why a file has no features."""


def decoded(text: str) -> str:
    """With the five named references and numbers replaced; others stay as they are."""

    def char(m: re.Match) -> str:
        if m[1]:
            return _NAMED[m[1]]
        code = int(m[2][1:], 16) if m[2][0] in "xX" else int(m[2])
        return chr(code) if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else m[0]

    return _REFERENCE.sub(char, text) if "&" in text else text


@lru_cache(4096)
def _local(raw: str) -> str:
    return raw.strip().rpartition(":")[2].lower()


def attributes(written: str) -> dict[str, str]:
    """Values by name of what stands in a tag behind the element's name; names in lower case without their prefix."""
    return {_local(k): decoded(a or b) for k, a, b in _ATTRIBUTE.findall(written)}


def events(text: str) -> Iterator[tuple[str, object, object]]:
    """("open", name, attributes), ("close", name, None) and ("text", text, None), names in lower case without their prefix, every open element closed.

    An end tag closes the nearest element of its name and all within; without one it is nothing.  A tag that never ends ends the document.
    """
    for kind, name, written in scanned(text):
        yield kind, name, attributes(written) if kind == "open" else None


def _tokens(text: str) -> Iterator[tuple]:
    """The text before each token and the token's groups, all None behind the last."""
    while True:
        parts = _TOKEN.split(text, TOKENS)
        each = [iter(parts)] * 5
        yield from zip(*each)
        if len(parts) <= 5 * TOKENS:
            yield parts[-1], None, None, None, None
            return
        text = parts[-1]


def scanned(text: str) -> Iterator[tuple[str, str, str | None]]:
    """``events`` with attributes as they are written, for those who need few of them."""
    stack: list[str] = []
    n = 0
    for before, data, closing, body, lone in _tokens(text):
        if before:
            yield "text", decoded(before), None
        if data is not None:
            yield "text", data, None
        elif lone:
            break
        elif body is None:
            continue
        elif closing:
            name = _local(body)
            if name in stack:
                while stack:
                    last = stack.pop()
                    yield "close", last, None
                    if last == name:
                        break
        else:
            if not body:
                continue
            head = _HEAD.match(body)[0]
            name = _local(head)
            n += 1
            if n > MOST_ELEMENTS:
                raise BadFile("too many elements")
            yield "open", name, body[len(head) :]
            if body[-1] == "/":
                yield "close", name, None
            else:
                stack.append(name)
                if len(stack) >= MOST_DEPTH:
                    raise BadFile("nested too deeply")
    while stack:
        yield "close", stack.pop(), None


def _number(x: str | None) -> float:
    return float(x) if x is not None and _NUMBER.fullmatch(x.strip()) else math.nan


def _point(written: str) -> tuple[float, float]:
    """lat and lng of a point's attributes."""
    if m := _PLAIN_POINT.fullmatch(written):
        return float(m[1]), float(m[2])
    attrs = attributes(written)
    return _number(attrs.get("lat")), _number(attrs.get("lon"))


def _points(pairs) -> list[tuple[float, float]]:
    return [(lat, lng) for lat, lng in pairs if math.isfinite(lat) and math.isfinite(lng)]


def _tuples(text: str) -> list[tuple[float, float]]:
    """lng,lat[,height] tuples between white space."""
    if _PLAIN_TUPLES.fullmatch(text):
        return _points((float(t[1]), float(t[0])) for t in (x.split(",", 2) for x in text.split()))
    return _points((_number(t[1]) if len(t) > 1 else math.nan, _number(t[0])) for t in (x.split(",") for x in text.split()))


Feature = tuple[str, str, list[list[tuple[float, float]]]]  # kind, name, rings


def kml(text: str) -> list[Feature]:
    """Line strings of two points and polygons of an outer ring of four at least, named by their placemark."""
    out: list[Feature] = []
    marks: list[dict] = []  # open placemarks: name, depth, features
    depth, n, seen = 0, 0, False
    shape: dict | None = None
    taking: list[str] | None = None
    naming: list[str] | None = None
    for kind, name, _ in scanned(text):
        if kind == "open":
            depth += 1
            seen |= name in ("kml", "placemark")
            if name == "placemark":
                n += 1
                marks.append({"name": None, "number": n, "depth": depth, "features": []})
            elif marks and name == "name" and depth == marks[-1]["depth"] + 1 and marks[-1]["name"] is None:
                naming = []
            elif marks and name in ("linestring", "polygon"):
                shape = {"tag": name, "depth": depth, "outer": None, "inner": [], "part": "line" if name == "linestring" else None}
            elif shape and name in ("outerboundaryis", "innerboundaryis"):
                shape["part"] = name[:5]
            elif shape and name == "coordinates" and shape["part"]:
                taking = []
        elif kind == "text":
            for to in (taking, naming):
                if to is not None:
                    to.append(name)
        else:
            depth -= 1
            if name == "coordinates" and taking is not None and shape:
                ring = _tuples("".join(taking))
                if shape["part"] == "inner":
                    shape["inner"].append(ring)
                elif shape["outer"] is None:
                    shape["outer"] = ring
                shape["part"], taking = None, None  # the first of each boundary counts
            elif name == "name" and naming is not None:
                marks[-1]["name"], naming = "".join(naming).strip(), None
            elif shape and name == shape["tag"] and depth == shape["depth"] - 1:
                ring = shape["outer"] or []
                if name == "linestring" and len(ring) >= 2:
                    marks[-1]["features"].append(("line", [ring]))
                elif name == "polygon" and len(ring) >= 4:
                    marks[-1]["features"].append(("polygon", [ring, *shape["inner"]]))
                shape = taking = None
            elif marks and name == "placemark":
                mark = marks.pop()
                out += [(k, mark["name"] or f"Placemark {mark['number']}", rings) for k, rings in mark["features"]]
                naming = None
    if not seen:
        raise BadFile("not KML")
    return out


def _plain_tracks(tracks: str) -> list[Feature]:
    """``gpx`` of the tracks of a plain document, several times as fast."""
    out: list[Feature] = []
    for i, (name, written) in enumerate(((m[1], m[2]) for m in _TRK.finditer(tracks)), 1):
        points = _points((float(a or b or g or h), float(c or d or e or f)) for a, b, c, d, e, f, g, h in _TRKPT.findall(written))
        if len(points) >= 2:
            out.append(("line", decoded(name).strip() or f"Track {i}", [points]))
    return out


def gpx(text: str) -> list[Feature]:
    """Tracks and routes of two points at least; the points of a track's segments follow each other."""
    if text.count("<") <= MOST_ELEMENTS and (m := _PLAIN_GPX.fullmatch(text)):
        return _plain_tracks(m["tracks"])
    out: list[Feature] = []
    counts, seen = {"trk": 0, "rte": 0}, False
    line: dict | None = None
    naming: list[str] | None = None
    for kind, name, written in scanned(text):
        if kind == "open":
            seen |= name == "gpx"
            if name in counts and line is None:
                counts[name] += 1
                line = {"tag": name, "name": None, "points": [], "label": f"{'Track' if name == 'trk' else 'Route'} {counts[name]}"}
            elif line and name == ("trkpt" if line["tag"] == "trk" else "rtept"):
                line["points"].append(_point(written))
            elif line and name == "name" and line["name"] is None and naming is None:
                naming = []
        elif kind == "text" and naming is not None:
            naming.append(name)
        elif kind == "close" and line:
            if name == "name" and naming is not None:
                line["name"], naming = "".join(naming).strip(), None
            elif name == line["tag"]:
                if len(points := _points(line["points"])) >= 2:
                    out.append(("line", line["name"] or line["label"], [points]))
                line = naming = None
    if not seen:
        raise BadFile("not GPX")
    return out


def geojson(text: str) -> list[Feature]:
    """Line strings and polygons, single and multiple; other geometries have no place here."""
    try:
        doc = json.loads(text)
    except ValueError:
        raise BadFile("not JSON") from None
    if not isinstance(doc, dict) or not doc.get("type"):
        return []
    found = doc.get("features") or [] if doc["type"] == "FeatureCollection" else [doc] if doc["type"] == "Feature" else [{"geometry": doc}]
    numbers = lambda p: isinstance(p, list) and len(p) >= 2 and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in p[:2])
    plain = lambda p: type(p) is list and len(p) >= 2 and type(p[0]) is float and type(p[1]) is float  # noqa: E731  nearly all are
    ring = lambda ps: [(float(p[1]), float(p[0])) for p in ps if plain(p) or numbers(p)] if isinstance(ps, list) else []
    out: list[Feature] = []
    for i, f in enumerate(found, 1):
        g = f.get("geometry") if isinstance(f, dict) else None
        if not isinstance(g, dict):
            continue
        props = f.get("properties") if isinstance(f.get("properties"), dict) else {}
        label = str(next((props[k] for k in ("name", "Name", "title") if props.get(k)), f"Feature {i}"))
        of, coords = g.get("type"), g.get("coordinates") or []
        for line in {"LineString": [coords], "MultiLineString": coords}.get(of, []):
            if len(points := ring(line)) >= 2:
                out.append(("line", label, [points]))
        for j, rings in enumerate({"Polygon": [coords], "MultiPolygon": coords}.get(of, []), 1):
            out.append(("polygon", label if of == "Polygon" else f"{label} ({j})", [ring(r) for r in rings]))
    return out


def features(file: str, content: bytes) -> list[Feature]:
    """What a file holds, by its ending, else by what it looks like."""
    low = file.lower()
    if low.endswith(".kmz"):
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                inside = next((x for x in z.namelist() if x == "doc.kml"), None) or next((x for x in z.namelist() if x.lower().endswith(".kml")), None)
                if inside is None:
                    raise BadFile("no KML in the archive")
                return kml(z.read(inside).decode("utf-8", "replace"))
        except (zipfile.BadZipFile, zipfile.LargeZipFile, NotImplementedError, EOFError):
            raise BadFile("not an archive") from None
    text = content.decode("utf-8-sig", "replace")
    for end, parse in ((".kml", kml), (".gpx", gpx), (".geojson", geojson), (".json", geojson)):
        if low.endswith(end):
            return parse(text)
    if text.lstrip().startswith("{"):
        return geojson(text)
    if "<kml" in text:
        return kml(text)
    if "<gpx" in text:
        return gpx(text)
    raise BadFile("unsupported")


def flat_points(lines: list[list[tuple[float, float]]]) -> np.ndarray:
    """lat and lng of the points of all lines, one after the other, in two columns."""
    return np.fromiter(chain.from_iterable(chain.from_iterable(lines)), np.float64).reshape(-1, 2)


def parsed(file: str, content: bytes) -> list[tuple]:
    """Rows of SCHEMA, points as pairs: a row per feature, or one that says why there are none."""
    try:
        found = features(file, content)
        if not found:
            raise BadFile("no lines or polygons")
        if sum(len(r) for _, _, rings in found for r in rings) > MOST_VERTICES:
            raise BadFile("too many vertices")
    except BadFile as e:
        return [(file, 0, None, None, None, str(e))]
    return [(file, i, kind, name, rings, None) for i, (kind, name, rings) in enumerate(found)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of ``parsed`` as a batch of SCHEMA: points go from two columns of numbers, not one by one."""
    file, place, kind, name, rings, error = zip(*rows)
    lines = [r for x in rings for r in x or ()]
    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32))
    flat = flat_points(lines)
    points = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["lat", "lng"])
    nested = pa.ListArray.from_arrays(ends([len(x or ()) for x in rings]), pa.ListArray.from_arrays(ends([len(r) for r in lines]), points), mask=pa.array([x is None for x in rings]))
    return pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(place, pa.int32()), pa.array(kind, pa.string()), pa.array(name, pa.string()), nested, pa.array(error, pa.string())], [c.split()[0] for c in ("file", "place", "kind", "name", "rings", "error")])


def read_gis(spark: SparkSession, path: str) -> DataFrame:
    """Features of all files below a folder, or of one file: SCHEMA; a file without any has one row with an error, an empty file isn't listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content")):
                yield _batch(parsed(file.as_py().rpartition("/")[2], content.as_py()))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def write_files(documents: DataFrame, path: str) -> DataFrame:
    """file, bytes: each document (file, content) as a file below ``path``; those named .kmz as an archive of one KML.  Made when the result is read; a task that is run again writes the same."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(path) if urlparse(path).scheme else (fs.LocalFileSystem(), path)
        system.create_dir(base, recursive=True)
        for f in frames:
            sizes = []
            for file, content in zip(f["file"], f["content"]):
                raw = content.encode()
                if file.lower().endswith(".kmz"):
                    packed = io.BytesIO()
                    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
                        z.writestr(zipfile.ZipInfo("doc.kml"), raw)
                    raw = packed.getvalue()
                with system.open_output_stream(f"{base}/{file}") as out:
                    out.write(raw)
                sizes.append(len(raw))
            yield pd.DataFrame({"file": f["file"], "bytes": sizes})

    return documents.select("file", "content").mapInPandas(run, "file string, bytes long")
