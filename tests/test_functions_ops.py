from decimal import Decimal
import datetime as dt

from pyspark.sql import functions as F

from conftest import plan, rows
from regspark.functions import clean as C
from regspark.functions import links as L
from regspark.functions import names as N
from regspark.operators.dedup import dedup_effect, dedup_full_row
from regspark.operators.dims import bounded_broadcast, lookup, segment_of
from regspark.operators.manifest import (
    ingest_plan, manifest_available, manifest_missing, route_archives, wanted_manifest,
)
from regspark.schemas import DIMENSION_NAMES


def test_resolve_link_cases(spark):
    cases = [
        ("http://h.com/a/b.html?x=1", "http://o.org/z", "http://o.org/z"),
        ("http://h.com/a/b.html", "//cdn.net/x.js", "http://cdn.net/x.js"),
        ("https://h.com/a/b.html", "/root.zip", "https://h.com/root.zip"),
        ("https://h.com/a/b.html", "c.zip", "https://h.com/a/c.zip"),
        ("https://h.com", "c.zip", "https://h.com/c.zip"),
        ("https://h.com/a/", "2025-01/", "https://h.com/a/2025-01/"),
        ("https://h.com/a/b?x=1", "?y=2", "https://h.com/a/b?y=2"),
        ("https://h.com/a/b", "", "https://h.com/a/b"),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "base string, link string")
    got = [r[0] for r in df.select(L.resolve_link("base", "link")).collect()]
    assert got == [c[2] for c in cases]


def test_path_parts_and_link_extraction(spark):
    df = spark.createDataFrame([("http://h.com/d/Empresas1.zip?t=1",), ("http://h.com/d/",)], "u string")
    got = df.select(L.url_host("u"), *[f("u", url=True) for f in (L.base_name, L.stem, L.extension)]).collect()
    assert [tuple(r) for r in got] == [("h.com", "Empresas1.zip", "Empresas1", ".zip"), ("h.com", "", "", "")]
    html = '<a href="2025-01/">x</a><a name="n">no href</a><a class="c" href="">e</a><A href="/Socios0.zip">'
    links = L.extract_links(spark.createDataFrame([(1, html)], "id long, html string"))
    # empty and missing hrefs dropped; tag names match in any case, as in HTML
    assert [r["href"] for r in links.collect()] == ["2025-01/", "/Socios0.zip"]
    hrefs = spark.createDataFrame([("2025-01/",), ("Socios1.zip",), ("x.zip",), ("README",)], "h string")
    assert [r[0] for r in hrefs.where(L.starts_with_any("h", ["20", "Soc"])).collect()] == ["2025-01/", "Socios1.zip"]
    assert [r[0] for r in hrefs.where(L.ends_with("h", ".zip", negate=True)).collect()] == ["2025-01/", "README"]


def test_archive_names(spark):
    df = spark.createDataFrame([("Empresas", 3, "2023-05/")], "t string, i int, d string")
    r = df.select(N.archive_name("t", "i"), N.local_archive_name("t", "i", "d"), N.output_prefix("d", "t"),
                  N.parquet_name(F.lit("Socios0.csv")), N.capitalized(F.lit("sOCIOS"))).first()
    assert tuple(r) == ("Empresas3.zip", "Empresas3-2023-05.zip", "202305_empr", "Socios0-pq.parquet", "Socios")


def test_cleaning(spark):
    df = spark.createDataFrame([("1.234,50", "20240131", "  X "), ("", "0", "   "), ("abc", "2024013", None)],
                               "m string, d string, t string")
    got = df.select(C.parse_money("m"), C.parse_compact_date("d"), C.blank_to_null("t")).collect()
    assert [tuple(r) for r in got] == [(Decimal("1234.50"), dt.date(2024, 1, 31), "X"),
                                       (None, None, None), (None, None, None)]
    assert df.select(C.format_money(F.lit(1234.5))).first()[0] == "1.234,50"


def test_dedup_nulls_equal_and_effect(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("a", "x"), ("b", "x")], "k string, v string")
    assert dedup_full_row(df).count() == 3
    assert tuple(dedup_effect(df).first()) == (4, 3, 1)


def test_bounded_broadcast_and_lookup(spark):
    dim = spark.createDataFrame([("1", "um"), ("2", "dois")], "code string, description string")
    facts = spark.createDataFrame([("1",), ("3",)], "c string")
    out = lookup(facts, dim, "c", "desc")
    assert rows(out) == [("1", "um"), ("3", None)]
    assert "BroadcastHashJoin" in plan(out)
    big = spark.range(100).selectExpr("cast(id as string) as code", "'d' as description")
    # over the bound the frame comes back unhinted (Spark's own size estimate still decides)
    assert bounded_broadcast(big, max_bytes=10) is big
    assert bounded_broadcast(big, max_bytes=1 << 30) is not big


def test_segment_of_cnae_sections(spark):
    df = spark.createDataFrame([("4711302",), ("0111301",), ("6201501",), ("9999999",), ("98",)], "cnae string")
    assert [r[0] for r in df.select(segment_of("cnae")).collect()] == ["G", "A", "J", "U", None]


def test_manifest_and_plan(spark):
    types = spark.createDataFrame([("Empresas",), ("Socios",)], "table_type string")
    wanted = wanted_manifest(types, shards=3, dimensions=DIMENSION_NAMES)
    assert wanted.count() == 2 * 3 + 6
    listing = spark.createDataFrame([("Empresas0.zip",), ("Empresas1.zip",), ("Socios2.zip",), ("Other.zip",)],
                                    "archive_name string")
    present = spark.createDataFrame([("Empresas0.zip",)], "archive_name string")
    facts = wanted.where("kind = 'data'")
    assert sorted(r[0] for r in manifest_available(facts, listing).select("archive_name").collect()) == \
        ["Empresas0.zip", "Empresas1.zip", "Socios2.zip"]
    assert manifest_missing(facts, listing).count() == 3
    actions = {r["archive_name"]: r["action"] for r in ingest_plan(facts, listing, present).collect()}
    assert actions["Empresas0.zip"] == "extract" and actions["Empresas1.zip"] == "download_extract"
    assert actions["Socios0.zip"] == "missing"
    routes = {r["archive_name"]: r["route"] for r in route_archives(wanted).collect()}
    assert routes["Cnaes.zip"] == "dimension" and routes["Socios1.zip"] == "data"


def test_snapshot_manifest_and_listing(spark):
    from regspark.operators.manifest import snapshots_available
    types = spark.createDataFrame([("Socios",)], "table_type string")
    w = wanted_manifest(types, shards=2, snapshots=["2023-05/", "2025-01/"], base_url="https://h/d/")
    got = sorted((r["snapshot"], r["local_name"], r["url"]) for r in w.collect())
    assert got[0] == ("2023-05", "Socios0-2023-05.zip", "https://h/d/2023-05/Socios0.zip")
    assert len(got) == 4
    listing = spark.createDataFrame([("2024-12/",), ("2025-01/",), ("../",), ("Socios0.zip",)], "href string")
    flags = {r["snapshot"]: r["listed"] for r in snapshots_available(["2023-05/", "2025-01/"], listing).collect()}
    assert flags == {"2023-05": False, "2025-01": True}


def test_link_extraction_quote_styles_case_and_entities(spark):
    html = ("<A HREF='Socios1.zip'>s</A> <a class=x href=Empresas0.zip>e</a> "
            '<a href="q?x=1&amp;y=2">q</a> <abbr href="no">n</abbr> <a\nhref = "2025-01/" >d</a>')
    links = L.extract_links(spark.createDataFrame([(1, html)], "id long, html string"))
    assert [r["href"] for r in links.collect()] == ["Socios1.zip", "Empresas0.zip", "q?x=1&y=2", "2025-01/"]


from hypothesis import HealthCheck, given, settings, strategies as st
from urllib.parse import urljoin

_seg = st.sampled_from(["a", "b", "dados", "2025-01", "x.zip", "Socios1.zip", "..", ".", ".hid"])
_base = st.builds(lambda sch, host, segs, slash, q, f: f"{sch}://{host}/" + "/".join(segs) + ("/" if slash and segs else "")
                  + ("?p=1" if q else "") + ("#top" if f else ""),
                  st.sampled_from(["http", "https"]), st.sampled_from(["h.com", "m.h.org"]),
                  st.lists(_seg, max_size=3), st.booleans(), st.booleans(), st.booleans())
_link = st.one_of(
    st.builds(lambda segs: "/".join(segs), st.lists(_seg, min_size=1, max_size=3)),
    st.builds(lambda segs: "/" + "/".join(segs), st.lists(_seg, max_size=3)),
    st.builds(lambda host, segs: f"//{host}/" + "/".join(segs), st.sampled_from(["cdn.net"]), st.lists(_seg, max_size=2)),
    st.builds(lambda segs: "https://o.org/" + "/".join(segs), st.lists(_seg, max_size=2)),
    st.sampled_from(["", "?q=2", "#frag", "2025-01/"]),
)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pairs=st.lists(st.tuples(_base, _link), min_size=20, max_size=40))
def test_resolve_link_agrees_with_urljoin(spark, pairs):
    df = spark.createDataFrame(pairs, "base string, link string")
    got = [r[0] for r in df.select(L.resolve_link("base", "link")).collect()]
    assert got == [urljoin(b, k) for b, k in pairs]


import os.path as _osp

_name = st.text(alphabet=".ab", min_size=0, max_size=6)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(names=st.lists(_name, min_size=20, max_size=40))
def test_path_parts_agree_with_os_path(spark, names):
    paths = [f"/d/{n}" for n in names]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [tuple(r) for r in df.select(L.base_name("p"), L.stem("p"), L.extension("p")).collect()]
    want = [(_osp.basename(p), *_osp.splitext(_osp.basename(p))) for p in paths]
    assert got == want


def test_links_in_comments_scripts_and_styles_are_ignored(spark):
    html = ('<!-- <a href="old.zip">x</a> --><script>var s = \'<a href="js.zip">\';</script>'
            '<style>a[href="css.zip"]{}</style><a href="Socios0.zip">ok</a>')
    links = L.extract_links(spark.createDataFrame([(1, html)], "id long, html string"))
    assert [r["href"] for r in links.collect()] == ["Socios0.zip"]


def test_compact_date_ignores_session_time_zone(spark):
    df = spark.sql("select timestamp_ntz'2024-01-31 23:30:00' as t")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ["UTC", "Pacific/Kiritimati", "America/Los_Angeles"]:
            spark.conf.set("spark.sql.session.timeZone", tz)
            assert df.select(C.format_compact_date("t")).first()[0] == "20240131", tz
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_attributes_and_references_as_an_html_parser_reads_them(spark):
    from html.parser import HTMLParser

    class Anchors(HTMLParser):
        def __init__(self):
            super().__init__()
            self.found = []

        def handle_starttag(self, tag, attrs):
            if tag == "a":
                self.found += [v for k, v in attrs if k == "href" and v][:1]
    pages = ['<a data-href="wrong.zip" href="right.zip">x</a>', '<a title="a>b" href="t.zip">x</a>', "<a href='O&apos;x.zip&#38;y'>x</a>",
             '<a href="&#x27;q&#8217;&#233;.zip">x</a>', '<a href="a&amp;lt;b&#38;amp;c">x</a>', '<a download href=b.zip class=k>x</a>',
             '<abbr href="no">n</abbr><A\n  id=1\n  HREF = "c.zip">x</A>', '<a name="href">x</a>']
    got = L.extract_links(spark.createDataFrame(list(enumerate(pages)), "id long, html string")).orderBy("id").collect()
    want = []
    for i, p in enumerate(pages):
        a = Anchors()
        a.feed(p)
        want += [(i, v) for v in a.found]
    assert [tuple(r) for r in got] == want


def test_file_names_keep_signs_that_end_a_url_path(spark):
    df = spark.createDataFrame([("/d/a#1.zip",), ("/d/b?.zip",)], "p string")
    assert [tuple(r) for r in df.select(L.base_name("p"), L.stem("p"), L.extension("p")).collect()] == \
        [("a#1.zip", "a#1", ".zip"), ("b?.zip", "b?", ".zip")]
    assert [r[0] for r in df.select(L.base_name("p", url=True)).collect()] == ["a", "b"]
