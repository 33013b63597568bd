"""HTML extraction and ZIP-packaged archives on small fixtures."""

import io
import zipfile
from collections import Counter, defaultdict

import pytest

from gneiss.llm import arrow, html, zip_archive


def page(k, body="", foot="Imprint and contact of the site"):
    return (
        f'<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style><script>var t="</p><p>no";</script></head><body class="has-sidebar"><header><h1>Site</h1></header>'
        f'<nav><ul><li><a href="/{k}">menu {k}</a></ul></nav><!-- ad {k} --><div class="ad">buy {k}</div><article><h1>Head {k} &amp; more</h1><p>First\n &nbsp; para <b>bold</b> {k}<br>next<p>Second {k}'
        f'<div class="notice">Cookies!</div>{body}<form><input name=q>search</form></article><aside>side {k}</aside><div id="comments"><p>nice {k}</div><footer>{foot} {k}</footer>'
    )


EXPECTED = "Head {0} & more\nFirst para bold {0} next\nSecond {0}"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"http://a.example/{k}?x#y", page(k)) for k in range(14)]
    rows += [(100, "http://b.example/1", page(100)), (101, None, page(101)), (102, "http://c.example", None), (103, "http://c.example/x", ""), (104, "http://d.example", "plain &lt;text&gt; <p>and more"), (3, "http://a.example/3?x#y", page(3))]
    rows += [(200 + k, f"http://e.example/{k}", f"<p>Shared line of every page</p><p>own {k} text</p>") for k in range(12)]
    rows += [(300, "http://f.example", "<p>" + "x " * 200_000 + "</p>"), (301, "http://f.example/2", "<p>open <b>< 3 & 4 <!-- never closed")]
    return spark.createDataFrame([(*x, 7) for x in rows], "page_id long, url string, html string, text int").repartition(3)


def test_extraction(spark, pages):
    rows = html.extracted(pages, ["page_id", "url", "text"]).select("page_id", "text", f"{arrow.OUT}.text").toDF("page_id", "own", "text").collect()
    assert len(rows) == pages.count() and {x.own for x in rows} == {7}
    got = {x.page_id: x.text for x in rows}
    for k in [*range(14), 100, 101]:
        assert got[k] == EXPECTED.format(k)
    assert got[102] == got[103] == ""
    assert got[104] == "plain <text>\nand more"
    assert all(got[200 + k] == f"own {k} text" for k in range(12))  # the line that all pages share is template
    assert len(got[300]) == 399_999 and got[301] == "open < 3 & 4"


def test_classes_are_valid(spark, pages):
    named = pages.select(html.host_of(pages.url).alias("host"), pages.page_id.cast("string").alias("id"), "html").where("host <> ''")
    found = {x.host: x for x in html.templates_of(named).collect()}
    assert set(found) == {"a.example", "e.example", "f.example"} and found["a.example"].pages == 15
    roots = [x.token for x in found["e.example"].template if x.is_root]
    assert html.PAGE in roots and len(roots) == 2


def plain(k):
    """A page whose boilerplate no tag, role or class name tells."""
    some = "<div>Members read this free of charge</div>" if k % 3 else ""
    return f"<div>The Daily Example</div><div><span>Share</span></div><p>own {k} text</p><p>more of {k}</p>{some}<div><span>Share</span></div>"


def texts_of(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return {x.page_id: x.text for x in html.extracted(pages, ["page_id"]).select("page_id", f"{arrow.OUT}.text").collect()}


def test_nested_classes_are_template(spark):
    got = texts_of(spark, [(k, f"http://plain.example/{k}", plain(k)) for k in range(30)])
    assert got == {k: f"own {k} text\nmore of {k}" for k in range(30)}


@pytest.mark.parametrize("pages", [1, 2, 9, 10, 100])
def test_equal_pages_keep_their_text(spark, pages):
    for one in ("<article><h1>Head</h1><p>all the same</p></article>", "<div><h1>Head</h1><p>all the same</p></div>"):
        assert texts_of(spark, [(k, f"http://same.example/{k}", one) for k in range(pages)]) == dict.fromkeys(range(pages), "Head\nall the same")


@pytest.mark.parametrize("pages", [2, 12, 40])
def test_articles_keep_what_they_share(spark, pages):
    rows = [(k, f"http://shared.example/{k}", f"<nav>Home</nav><article><h1>Head {k}</h1><p>stands in each of them</p><p>own {k}</p></article><footer>end</footer>") for k in range(pages)]
    assert texts_of(spark, rows) == {k: f"Head {k}\nstands in each of them\nown {k}" for k in range(pages)}


def untold(k, more=""):
    """A page whose menus and boxes change from page to page, and have no telling names."""
    menu = f"<div><a>Home</a> <a>World</a> <a>page{k}</a></div>"
    return f"{menu}<div><h2>Head {k}</h2><p>This is what page {k} has to say about it all.</p><ul><li>item {k}</li></ul>{more}<p>And {k} more words, to end with.</p></div><div>Related {k}</div><div>All rights reserved</div>"


@pytest.mark.parametrize("pages", [3, 12, 60])
def test_main_slots_leave_other_slots_out(spark, pages):
    got = texts_of(spark, [(k, f"http://untold.example/{k}", untold(k, "<p>An extra one.</p>" * (k % 5 == 1))) for k in range(pages)])
    for k in range(pages):
        lines = [f"Head {k}", f"This is what page {k} has to say about it all.", f"item {k}", *["An extra one."] * (k % 5 == 1), f"And {k} more words, to end with."]
        assert got[k] == "\n".join(lines)


def test_occurrence_vectors_by_brute_force(spark):
    """The fingerprints group tokens just as their whole occurrence vectors do."""
    sources = [plain(k) + untold(k) * (k % 2) for k in range(20)]
    counts = [Counter(x[0] for x in html.Page(s).tokens if x[0] >= 0) for s in sources]
    vectors = {t: tuple(c[t] for c in counts) for t in set().union(*counts)}
    rows = spark.createDataFrame([("h", str(k), s) for k, s in enumerate(sources)], "host string, id string, html string").repartition(3)
    got = {x.token: (x.n, x.lo, x.hi) for x in html.occurrences(rows).collect() if x.token != html.PAGE}
    assert set(got) == {t for t, v in vectors.items() if sum(map(bool, v)) >= html.LEAST_PAGES}
    by_vector, by_print = defaultdict(set), defaultdict(set)
    for t, x in got.items():
        by_vector[vectors[t]].add(t)
        by_print[x].add(t)
    assert sorted(map(sorted, by_vector.values())) == sorted(map(sorted, by_print.values()))


def test_odd_pages_leave_the_template(spark):
    odd = [(1000, ""), (1001, None), (1002, "<html><body><h1>502 Bad Gateway</h1></body></html>"), (1003, "<div>All rights reserved</div><p>redesigned</p><div>The Daily Example</div>")]
    rows = [(k, f"http://odd.example/{k}", plain(k) + "<div>All rights reserved</div>") for k in range(1000)] + [(k, f"http://odd.example/{k}", x) for k, x in odd]
    got = texts_of(spark, rows)
    assert all(got[k] == f"own {k} text\nmore of {k}" for k in range(1000))
    assert [got[k] for k, _ in odd] == ["", "", "502 Bad Gateway", "redesigned"]


ROWS = [(1, "http://a/1", "same"), (5, "http://a/5", "same"), (3, "http://a/3", "same"), (2, None, None), (4, "", ""), (6, "http://ä/ b", "ünïcode\r\n\r\nx"), (None, "u", "same"), (5, "http://a/5", "same"), (7, "z", "y" * 100_000)]


def test_archive_round_trip(spark):
    pages = spark.createDataFrame([(*x, "w") for x in ROWS], "page_id long, url string, html string, sha string").repartition(2)
    paths = zip_archive.write_packages(pages)
    got = zip_archive.read_packages(spark, paths).collect()
    assert len(got) == len(ROWS)
    texts = {1: "same", 5: "same", 3: "same", 2: "", 4: "", 6: "ünïcode\r\n\r\nx", None: "same", 7: "y" * 100_000}
    for x in got:
        raw = texts[x.page_id].encode()
        assert (x.payload_bytes, x.payload_digest) == (len(raw), zip_archive.payload_digest(raw))
    kinds = sorted((str(x.page_id), x.record_type, x.refers_to) for x in got)
    assert kinds == sorted([("1", "revisit", 5), ("3", "revisit", 5), ("None", "revisit", 5), ("5", "response", None), ("5", "response", None), ("2", "revisit", 4), ("4", "response", None), ("6", "response", None), ("7", "response", None)], key=lambda x: (x[0], x[1], x[2] or 0))
    with zipfile.ZipFile(paths[0].removeprefix("file://")) as z:
        assert z.testzip() is None and any(x.startswith("archive/") for x in z.namelist())


class Bytes:
    def __init__(self, raw):
        self.raw, self.size = raw, len(raw)

    def read(self, start, length):
        return self.raw[start : start + length]


@pytest.mark.parametrize("wide", [False, True])
def test_zip_both_ways(wide):
    out = io.BytesIO()
    writer = zip_archive.ZipWriter(out, force64=wide)
    writer.add("a/ü.bin", b"x" * 1000)
    writer.add("b", b"")
    writer.close()
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:
        assert z.namelist() == ["a/ü.bin", "b"] and z.read("a/ü.bin") == b"x" * 1000
    reader = zip_archive.ZipReader(Bytes(out.getvalue()))
    assert reader.read("a/ü.bin", 990, 10) == b"x" * 10 and reader.read("b") == b""
    with pytest.raises(ValueError):
        reader.read("b", 0, 1)
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        with z.open(zipfile.ZipInfo("big"), "w", force_zip64=wide) as f:
            f.write(b"payload")
        z.writestr("packed", b"z" * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\5\6 in it"
    reader = zip_archive.ZipReader(Bytes(other.getvalue()))
    assert reader.read("big") == b"payload"
    with pytest.raises(ValueError):
        reader.read("packed")
    with pytest.raises(ValueError):
        zip_archive.ZipReader(Bytes(b"no archive"))
