"""HTML extraction by equivalence-class template deduction.

The pages of a host share a template. Each page is a sequence of tokens: tags
and whole text segments, told apart by the path of structural elements around
them. Tokens with the same occurrence vector (how often they occur in each of
the host's pages) and, but for the root class, the same path form an
equivalence class. A class is valid if its tokens come in the same order, cycle
after cycle, on nearly every page that has them; valid classes nest in the same
gaps of the root classes, whose tokens occur once on nearly each page. Pages
without tokens don't count. The root and the nested classes are the template;
what they leave over are slots. A host's main slots are those, by their path,
that hold most of its slot text; the article is what the smallest container
around a page's main slots holds besides template text and regions for other
things. An article element around them is the container, and its text stays
even where the host's pages share it. Pages that leave no slot tell nothing
apart: they keep all that lies outside of other regions.

An occurrence vector never is materialised: its fingerprint is a sum over pages
of a hash of page and count, so that a host of any size is aggregated like any
other key, with partial sums before the shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.arrow import OUT, small_batches
from gneiss.llm.common import small, stored, table

#: Pages that a token is on at least: what one page has can't be told from its template.
LEAST_PAGES = 2
#: Share of a host's slot text from which a path is that of a main slot.
MAIN_SHARE = 0.2
#: Share of a host's pages that a root token is on once, and of a class's pages that agree on its order and gaps.
NEARLY = 0.9
#: Hosts whose sets of tokens a task remembers.
_HOSTS = 1024
#: The token that each page has once: its vector is that of the root class.
PAGE = 0

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(?P<raw>script|style|title|textarea|iframe|noscript|template|svg|math|object|select|xmp)\b(?:"[^"]*"|'[^']*'|[^'">])*>(?:.*?</(?P=raw)\s*>|.*\Z)"""
    r"""|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^'">])*)>""",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"""(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ARTICLE = frozenset(("article", "main"))
#: Elements, roles and words of class names that stand for something besides the article. Fixed values of this operator.
OTHER_TAGS = frozenset("head nav footer aside form button menu dialog input".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notices banner popup modal newsletter subscribe comment comments commentlist respond disqus reply replies".split()
)
#: Elements that an opening tag ends if they are open nearer than a container.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that may hold an article.
HOLDERS = frozenset(("", "html", "body", "div", "section", "article", "main", "td"))
CONTAINERS = frozenset("html body div section article main aside nav header footer ul ol dl table form blockquote".split())


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def _is_other(name: str, attrs: str, inside: bool) -> bool:
    """Whether an element is for something besides the article; inside: it stands within the article."""
    if name in OTHER_TAGS or name == "header" and not inside:
        return True
    if not attrs or name in ("html", "body") or name in ARTICLE:
        return False
    for key, a, b, c in _ATTR.findall(attrs):
        value, key = (a or b or c).lower(), key.lower()
        if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key == "role" and value in OTHER_ROLES:
            return True
        if key in ("class", "id") and not OTHER_WORDS.isdisjoint(words := re.split(r"[^a-z0-9]+", value)) | ("header" in words and not inside):
            return True
    return False


def _clean(text: str) -> str:
    return " ".join((html.unescape(text) if "&" in text else text).split())


class Page:
    """A page's tokens in order, with what is needed to put its slots together.

    tokens: (token, text or None, block, other, inside, path, element): the
    block that a segment belongs to, whether it lies in a region for other
    things, whether within an article element, the path and the element around
    it. Elements are numbered in page order; 0 is the page.
    """

    def __init__(self, source: str | None):
        self.tokens: list[tuple[int, str | None, int, bool, bool, int, int]] = []
        self.parents, self.names = [0], [""]
        self.has_article = False
        source, block, at = source or "", 0, 0
        # Open elements: name, path hash, other, inside, number.
        stack: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, 0)]

        def segment(raw: str) -> None:
            if raw and not raw.isspace():
                _, path, other, inside, element = stack[-1]
                self.tokens.append((xxhash.xxh64_intdigest(_clean(raw), path) >> 1, raw, block, other, inside, path >> 1, element))
            elif raw:
                blank(raw)

        def blank(raw: str) -> None:
            _, _, other, inside, element = stack[-1]
            self.tokens.append((-1, raw, block, other, inside, 0, element))

        def pop(k: int) -> None:
            del stack[k:]

        for m in _TOKEN.finditer(source):
            segment(source[at : m.start()])
            at = m.end()
            name = m["name"]
            if name is None:
                continue
            name = name.lower()
            if m["end"]:
                k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
                if k:
                    _, path, other, inside, element = stack[k]
                    pop(k)
                    self.tokens.append((xxhash.xxh64_intdigest("/" + name, path) >> 1, None, block, other, inside, path >> 1, element))
            else:
                if name in CLOSES:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] in CLOSES[name]:
                            pop(i)
                        elif stack[i][0] in CONTAINERS:
                            break
                elif name in BLOCKS:  # a block ends a paragraph
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == "p":
                            pop(i)
                        elif stack[i][0] in CONTAINERS:
                            break
                _, path, other, inside, element = stack[-1]
                # Only structural elements lengthen the path, so that open inline tags don't change it.
                own = xxhash.xxh64_intdigest(name, path) if name in BLOCKS else path
                within = inside or name in ARTICLE
                other = other or _is_other(name, m["attrs"], inside)
                self.has_article |= within and not other
                self.tokens.append((xxhash.xxh64_intdigest("<" + name, path) >> 1, None, block, other, within, path >> 1, element))
                if name not in VOID:
                    self.parents.append(element)
                    self.names.append(name)
                    stack.append((name, own, other, within, len(self.parents) - 1))
            if name in BLOCKS:
                block += 1
            elif name == "br":
                blank(" ")
        segment(source[at:])

    def _container(self, main: list[int]) -> int:
        """The smallest element that may hold an article around all the elements main."""
        above: list[int] | None = None
        for element in main:
            chain = [element]
            while chain[-1]:
                chain.append(self.parents[chain[-1]])
            if above is None:
                above = chain
            else:
                chain = set(chain)
                above = [x for x in above if x in chain]
        return next(x for x in above or [0] if self.names[x] in HOLDERS)

    def text(self, template: frozenset[int], main: frozenset[int] = frozenset()) -> str:
        """The blocks of the article, given the host's template and the paths of its main slots.

        A block is template if all its segments are; a block that holds a slot
        keeps the words around it. A first-level heading belongs to the article
        wherever it stands.
        """
        own = [x for x in self.tokens if x[1] is not None and not x[3] and (x[4] or not self.has_article)]
        slots = [x for x in own if x[0] >= 0 and x[0] not in template]
        blocks: dict[int, list[str]] = {}
        for x in own:
            blocks.setdefault(x[2], []).append(x[1])
        if slots and not self.has_article:
            container = self._container(list(dict.fromkeys(x[6] for x in slots if x[5] in main)))
            within = [container == 0]
            for element, parent in enumerate(self.parents[1:], 1):
                within.append(element == container or within[parent] or self.names[element] == "h1")
            kept = {x[2] for x in slots if within[x[6]]}
            blocks = {k: x for k, x in blocks.items() if k in kept}
        return "\n".join(x for x in (_clean("".join(raw)) for raw in blocks.values()) if x)


def _pages(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[Page]]]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            columns = [c.to_pylist() for c in whole.slice(at, 256).columns]
            yield columns, [Page(x) for x in columns[-1]]


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, id, html) -> for each host and token: in how many pages it occurs, and its vector's fingerprint (lo, hi), its path, and in how many pages it occurs once.

    Pages without tokens don't count.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (hosts, ids, _), parsed in _pages(batches):
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for host, page_id, page in zip(hosts, ids, parsed, strict=True):
                times: dict[int, int] = {PAGE: 1}
                paths = {PAGE: 0}
                for token, _, _, _, _, path, _ in page.tokens:
                    if token >= 0:
                        times[token] = times.get(token, 0) + 1
                        paths[token] = path
                if len(times) == 1:
                    continue
                for token, n in times.items():
                    print_ = xxhash.xxh64_intdigest(f"{page_id} {n}")
                    for x, y in zip(out, (host, token, print_ & 0xFFFFFFFF, print_ >> 32, paths[token], int(n == 1)), strict=True):
                        x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *(pa.array(x, pa.int64()) for x in out[1:])], ["host", "token", "lo", "hi", "path", "once"])

    rows = pages.mapInArrow(count, "host string, token long, lo long, hi long, path long, once long")
    sums = [F.sum(c).alias(c) for c in ("lo", "hi", "once")]
    return rows.groupBy("host", "token").agg(F.count(F.lit(1)).alias("n"), *sums, F.max("path").alias("path")).where(f"n >= {LEAST_PAGES}")


def classes(pages: DataFrame) -> DataFrame:
    """(host, id, html) -> host, pages, and its frequent tokens with their classes.

    A token counts if at least half of the host's pages have it, so that a host
    has no more tokens than two of its mean pages.
    """
    found = stored(occurrences(pages), "occurrences")
    vector = F.xxhash64("n", "lo", "hi")
    hosts = found.where(F.col("token") == PAGE).select("host", F.col("n").alias("pages"))
    often = found.join(hosts, "host").where("2 * n >= pages").withColumn("is_root", F.col("once") >= NEARLY * F.col("pages"))
    often = often.withColumn("of", F.when(F.col("is_root"), vector).otherwise(F.xxhash64("n", "lo", "hi", "path")))
    grouped = often.groupBy("host").agg(F.max("pages").alias("pages"), F.sort_array(F.collect_list(F.struct("token", "of", "is_root"))).alias("template"))
    return stored(grouped, "classes")


def _with_template(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """pages with their host's row; sent to all executors if small, else joined by shuffle, where Spark splits large hosts."""
    n, tokens = templates.agg(F.count(F.lit(1)), F.sum(F.greatest(F.size("template"), F.lit(0)))).first()
    return pages.join(small(templates, (n or 0) + (tokens or 0), 24), "host", "left")


#: In place of the order of a class: its tokens don't come in order; the row is the text of a slot.
_IRREGULAR, _SLOT = -1, -2


def _checked(page: Page, template: list[dict]) -> list[tuple[int, int, int, int]]:
    """(class, hash of the order of its tokens, hash of the gaps of the root that it is in, 1) for the classes on a page; (path, _SLOT, 0, characters) for its slots."""
    of = {x["token"]: x["of"] for x in template}
    roots, gap = {x["of"] for x in template if x["is_root"]}, PAGE
    seen: dict[int, list[int]] = {}
    gaps: dict[int, set[int]] = {}
    slots: dict[int, int] = {}
    for token, raw, _, other, _, path, _ in page.tokens:
        if (c := of.get(token)) is not None:
            if c in roots:
                gap = token
            seen.setdefault(c, []).append(token)
            gaps.setdefault(c, set()).add(gap)
        elif raw is not None and token >= 0 and not other:
            slots[path] = slots.get(path, 0) + len(raw)
    out = [(path, _SLOT, 0, n) for path, n in slots.items()]
    for c, sequence in seen.items():
        cycle = sequence[: len(set(sequence))]
        regular = len(set(cycle)) == len(cycle) and len(sequence) % len(cycle) == 0 and cycle * (len(sequence) // len(cycle)) == sequence
        order = xxhash.xxh64_intdigest(repr(cycle)) >> 1 if regular else _IRREGULAR
        out.append((c, order, 0 if c in roots else xxhash.xxh64_intdigest(repr(sorted(gaps[c]))) >> 1, 1))
    return out


def checked(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(host, id, html) and classes -> (host, of, ord, gap, n): how many pages have a class in which order and gaps, and the text of slots by path."""

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (hosts, templates, _), parsed in _pages(batches):
            sums: dict[tuple, int] = {}
            for host, template, page in zip(hosts, templates, parsed, strict=True):
                for *key, n in _checked(page, template) if template else ():
                    sums[host, *key] = sums.get((host, *key), 0) + n
            columns = list(zip(*sums, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(x, pa.int64()) for x in (*columns[1:], list(sums.values())))], ["host", "of", "ord", "gap", "n"])

    rows = _with_template(pages, found).select("host", "template", "html").mapInArrow(check, "host string, of long, ord long, gap long, n long")
    return stored(rows.groupBy("host", "of", "ord", "gap").agg(F.sum("n").alias("n")), "checked")


def valid_classes(ways: DataFrame) -> DataFrame:
    """checked -> (host, of) for the classes that are ordered and nest in the same gaps of the root on nearly every page that has them."""
    best = ways.where(F.col("ord") != _SLOT).groupBy("host", "of").agg(F.max(F.when(F.col("ord") >= 0, F.col("n"))).alias("best"), F.sum("n").alias("n"))
    return best.where(F.col("best") >= NEARLY * F.col("n")).select("host", "of")


def main_slots(ways: DataFrame) -> DataFrame:
    """checked -> host, main: the paths that hold MAIN_SHARE of the host's slot text or more, of which there are few."""
    slots = ways.where(F.col("ord") == _SLOT).select("host", "of", "n")
    total = slots.groupBy("host").agg(F.sum("n").alias("total"))
    return slots.join(total, "host").where(F.col("n") >= MAIN_SHARE * F.col("total")).groupBy("host").agg(F.sort_array(F.collect_list("of")).alias("main"))


def templates_of(pages: DataFrame) -> DataFrame:
    """(host, id, html) -> host, pages, template: the tokens of the host's valid classes, root first, and main: the paths of its main slots."""
    found = classes(pages)
    ways = checked(pages, found)
    tokens = found.select("host", "pages", F.explode("template").alias("t")).select("host", "pages", "t.*")
    kept = tokens.join(valid_classes(ways), ["host", "of"]).groupBy("host").agg(F.max("pages").alias("pages"), F.sort_array(F.collect_list(F.struct("token", "is_root"))).alias("template"))
    return stored(kept.join(main_slots(ways), "host", "left"), "templates")


def extracted(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of pages and a struct OUT with text.

    Null html is an empty page. Pages without a host, and hosts of one page,
    have no template: all their text is slots. Pages that all are equal leave no
    slots and keep their text. Repeated rows count as often as they occur, which
    changes no class. An empty table gives an empty result.
    """
    small_batches(pages.sparkSession)
    own = [f"__{i}" for i in range(len(keep))]
    place = dict(zip(keep, own, strict=True))
    rows = pages.select(*[F.col(c).alias(x) for c, x in place.items()], host_of(F.col("url")).alias("host"), F.concat_ws(" ", F.col("page_id").cast("string"), "url").alias("id"), "html")
    templates = templates_of(rows.where("host <> ''").select("host", "id", "html"))
    schema = T.StructType([*rows.select(*own).schema, T.StructField(OUT, T.StructType.fromDDL("text string"))])

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        made: dict[str, tuple[frozenset[int], frozenset[int]]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                hosts, templates_, mains, sources = (batch.column(c).to_pylist() for c in ("host", "template", "main", "html"))
                texts = []
                for host, template, main, source in zip(hosts, templates_, mains, sources, strict=True):
                    if host not in made:
                        if len(made) >= _HOSTS:
                            made.clear()
                        made[host] = frozenset(x["token"] for x in template or ()), frozenset(main or ())
                    texts.append({"text": Page(source).text(*made[host])})
                yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(target.field(c).type) for c in own), pa.array(texts, target.field(OUT).type)], schema=target)

    out = _with_template(rows.drop("id"), templates).select(*own, "host", "template", "main", "html").mapInArrow(extract, schema)
    return out.select(*[F.col(x).alias(c) for c, x in place.items()], OUT)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extracted for pages: nulls, equal and odd pages, repeats and empty tables as stated there."""
    found = extracted(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.select("page_id", "url", F.col(f"{OUT}.text").alias("text"), F.length(f"{OUT}.text").cast("long").alias("n_chars"))


#: The article of the test tables' pages, which mark it as such; entities as far as those pages use them.
ORACLE_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS x FROM pages
), b AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(x, '</?(?:p|h1)>'),
    lambda s: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(s, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS blocks FROM a
), c AS (
  SELECT page_id, url, array_to_string(list_filter(blocks, lambda s: s <> ''), chr(10)) AS text FROM b
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c
"""
