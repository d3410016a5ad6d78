import io
import json
import tempfile
import zipfile

import pytest

from ridgework.sources import gis_files as g

KML = """<?xml version="1.0"?><!DOCTYPE kml [<!ENTITY x "y">]><kml:kml xmlns:kml="k"><Document><name>Doc</name><!-- <Placemark> --><Folder><Folder>
<kml:Placemark id='a>b'><description><name>no</name></description><name> One &amp; &#x41; <![CDATA[<b>]]></name><LineString><coordinates>149.1,-35.1,0
 149.2,-35.2 bad,1 149.3,-35.3,7</coordinates></LineString><LineString><coordinates>1,2</coordinates></LineString></kml:Placemark>
<Placemark><MultiGeometry><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 1,0 1,1 0,0</coordinates></LinearRing></outerBoundaryIs><innerBoundaryIs><LinearRing><coordinates>0.2,0.1 0.3,0.1 0.3,0.2 0.2,0.1</coordinates></LinearRing></innerBoundaryIs>
<innerBoundaryIs><LinearRing><coordinates>5,5</coordinates></LinearRing></innerBoundaryIs></Polygon></MultiGeometry></stray></Placemark></Folder></Folder></Document></kml:kml>"""
GPX = """<gpx><metadata><name>file</name></metadata><trk><name>T &lt;1&gt;</name><trkseg><trkpt lon='149.5' lat="-35.5"><name>inner</name></trkpt><trkpt lat = "-35.6"
 ele="3" lon="149.6"/></trkseg><trkseg><trkpt lat="x" lon="1"/><trkpt lat="-35.7" lon="149.7"></trkpt></trkseg></trk><trk><trkpt lat="1" lon="1"/></trk><rte><rtept lat="1" lon="2"/><rtept lat="3" lon="4"/></rte></gpx>"""


def test_kml():
    assert g.kml(KML) == [("line", "One & A <b>", [[(-35.1, 149.1), (-35.2, 149.2), (-35.3, 149.3)]]), ("polygon", "Placemark 2", [[(0, 0), (0, 1), (1, 1), (0, 0)], [(0.1, 0.2), (0.1, 0.3), (0.2, 0.3), (0.1, 0.2)], [(5, 5)]])]
    assert g.kml(KML[: KML.index("</coordinates></LineString>")]) == [("line", "One & A <b>", [[(-35.1, 149.1), (-35.2, 149.2), (-35.3, 149.3)]])]  # what ends early is closed
    assert g.kml("<kml/>") == []
    with pytest.raises(g.BadFile, match="not KML"):
        g.kml("<gpx/>")


def test_gpx():
    assert g.gpx(GPX) == [("line", "T <1>", [[(-35.5, 149.5), (-35.6, 149.6), (-35.7, 149.7)]]), ("line", "Route 1", [[(1.0, 2.0), (3.0, 4.0)]])]
    assert g.gpx("<gpx><trk><trkpt lat='1' lon='2'/><trkpt lat='3' lon='4'/><trkpt lat='5' lon='6") == [("line", "Track 1", [[(1.0, 2.0), (3.0, 4.0)]])]  # a tag that never ends


def test_geojson():
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"title": "t"}, "geometry": {"type": "LineString", "coordinates": [[1, 2, 9], [3, 4], ["x", 1], [5]]}}, {"properties": None, "geometry": {"type": "MultiLineString", "coordinates": [[[1, 2]], [[1, 2], [3, 4]]]}},
        {"properties": {"name": "p"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[2, 2], [3, 2], [3, 3], [2, 2]]]]}}, None, {"geometry": None}, {"geometry": {"type": "Point", "coordinates": [1, 2]}},
    ]}
    assert [(k, n, len(r[0])) for k, n, r in g.geojson(json.dumps(doc))] == [("line", "t", 2), ("line", "Feature 2", 2), ("polygon", "p (1)", 4), ("polygon", "p (2)", 4)]
    assert g.geojson('{"type": "LineString", "coordinates": [[1, 2], [3, 4]]}') == [("line", "Feature 1", [[(2.0, 1.0), (4.0, 3.0)]])]
    for bad in ("[", "", "nope"):
        with pytest.raises(g.BadFile):
            g.geojson(bad)


def test_limits():
    with pytest.raises(g.BadFile, match="too many elements"):
        list(g.events("<a/>" * (g.MOST_ELEMENTS + 1)))
    with pytest.raises(g.BadFile, match="too deeply"):
        list(g.events("<a>" * 64))
    assert len(list(g.events("<a>" * 63))) == 126
    assert list(g.events("a<b>c</x>d")) == [("text", "a", None), ("open", "b", {}), ("text", "c", None), ("text", "d", None), ("close", "b", None)]


def test_a_folder_of_files(spark):
    at = tempfile.mkdtemp(prefix="gis-")
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("other.txt", "x")
        z.writestr("files/Inner.KML", KML)
    many = {"type": "LineString", "coordinates": [[1, 2]] * (g.MOST_VERTICES + 1)}
    files = {"a.kml": KML.encode(), "b.gpx": GPX.encode(), "c.kmz": packed.getvalue(), "d.kmz": b"PK broken", "e.txt": b"\xef\xbb\xbf  {\"type\": \"LineString\", \"coordinates\": [[1, 2], [3, 4]]}", "f.dat": b"\x00\xff", "g.json": b"{", "h.geojson": json.dumps(many).encode(), "i.kml": b"<kml></kml>", "j": GPX.encode(), "k.gpx": b""}
    for name, content in files.items():
        with open(f"{at}/{name}", "wb") as f:
            f.write(content)
    got = {}
    for r in g.read_gis(spark, at).collect():
        got.setdefault(r.file, []).append((r.place, r.kind, r.name, r.error))
    assert [x[1:3] for x in sorted(got["a.kml"])] == [("line", "One & A <b>"), ("polygon", "Placemark 2")] and got["c.kmz"] == got["a.kml"] and got["j"] == got["b.gpx"] and got["e.txt"] == [(0, "line", "Feature 1", None)]
    assert {k: v[0][3] for k, v in got.items() if v[0][3]} == {"d.kmz": "not an archive", "f.dat": "unsupported", "g.json": "not JSON", "h.geojson": "too many vertices", "i.kml": "no lines or polygons"}
    assert "k.gpx" not in got  # Spark lists no empty files


def test_texts_are_cut_alike_whatever_number_of_tokens_is_cut_at_once(monkeypatch):
    text = "a<b x='1'>c<!-- d --><![CDATA[<e>]]></b>f<g/>h < i"
    whole = list(g.events(text))
    assert ("open", "b", {"x": "1"}) in whole and ("text", "<e>", None) in whole and whole[-1] == ("text", "h ", None)
    for n in range(1, 9):
        monkeypatch.setattr(g, "TOKENS", n)
        assert list(g.events(text)) == whole


def test_plain_points_and_tuples_are_read_whole_and_others_one_by_one(monkeypatch):
    seen = []
    monkeypatch.setattr(g, "_number", lambda x, f=g._number: seen.append(x) or f(x))
    track = "<gpx><trk><trkpt lat=\"-35.5\" lon='149'/><trkpt lat='1' lon='2e0'></trkpt>{}</trk></gpx>"
    line = "<kml><Placemark><LineString><coordinates>149,-35.5,0 2e0,1{}</coordinates></LineString></Placemark></kml>"
    assert g.gpx(track.format(""))[0][2] == g.kml(line.format(""))[0][2] == [[(-35.5, 149.0), (1.0, 2.0)]] and not seen
    assert g.gpx(track.format("<trkpt lon='4' lat='3'/><trkpt lat='1e999' lon='0'/>"))[0][2] == g.kml(line.format(" 4,3 x,1 5"))[0][2] == [[(-35.5, 149.0), (1.0, 2.0), (3.0, 4.0)]] and seen


def test_plain_gpx_is_read_without_scanning_and_to_the_same_effect(monkeypatch):
    point = "<trkpt lat=\"-35.5\" lon='149'/>\n<trkpt lon='2e0' lat='1'><ele>0</ele></trkpt>"
    plain = f"<?xml version='1.0'?><gpx version=\"1.1\"><metadata><name>m</name></metadata><trk><name> a &lt; b </name><trkseg>{point}</trkseg></trk>\n<trk><name></name><trkseg>{point}</trkseg></trk><trk><name>short</name><trkseg></trkseg></trk></gpx>"
    scanned = g.gpx(plain.replace("</gpx>", "<x/></gpx>"))
    monkeypatch.setattr(g, "scanned", None)
    assert g.gpx(plain) == scanned == [("line", name, [[(-35.5, 149.0), (1.0, 2.0)]]) for name in ("a < b", "Track 2")]
