"""Main text of web pages, with site template removal.

A small parser turns tag soup into elements.  Every block element is hashed
with all it holds; Spark counts, per host, the different pages on which a hash
occurs, and what recurs on ``MIN_PAGES`` of them is template and is deleted, inside
articles too; an article, a main and the elements around them never are.  Pages of
equal html count once, as does what stands inside an article or main for all pages
on which that holds the same, so pages crawled often or served under several urls
keep their text.
Elements that are no text by their tag or by the words of their class, id or
role (menus, notices, adverts, forms, comments and so on) go as well.

The recurring hashes are sent to the executors if they number at most
``BROADCAST_KEYS`` (8 bytes each); beyond that they are joined to the pages.

Defined results: null html is an empty page with an empty text; pages with a null or
odd url belong to no host and have no templates; repeated rows are extracted each,
and count as one page; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, ship

MIN_PAGES = 10  #: pages of a host on which a subtree must occur to be template
BROADCAST_KEYS = 500_000

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NO_TEXT = frozenset("script style noscript iframe template svg math head title nav footer aside form menu dialog button select option input textarea object canvas audio video map".split())
NO_TEXT_WORDS = frozenset(
    "nav navbar navigation menu sidebar breadcrumb breadcrumbs footer cookie cookies consent gdpr notice banner alert ad ads advert advertisement adverts promo sponsor sponsored newsletter subscribe share sharing social related recommended comment comments disqus popup modal toolbar pagination pager skip masthead".split()
)
ENDS_P = BLOCK - {"body", "html"}
#: An element and those whose start ends it.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}

#: An attribute: its name, and its value in either kind of quotes or bare. A quote that is never closed is part of a name.
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+)|(?=>)))?""")
ATTRIBUTES = re.compile(r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+|(?=>)))?+)*+>""")
CLASSES = frozenset(("class", "id", "role"))
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
WORDS = re.compile(r"[a-z]+|[0-9]+")


class Element:
    __slots__ = ("tag", "words", "children")

    def __init__(self, tag: str, words: frozenset):
        self.tag, self.words, self.children = tag, words, []


def _tag_end(text: str, at: int) -> int:
    """Position of the > that closes the tag begun before ``at``; those in quoted values don't."""
    end = text.find(">", at)
    if end < 0 or text.find('"', at, end) < 0 and text.find("'", at, end) < 0:
        return end
    tag = ATTRIBUTES.match(text, at)
    return tag.end() - 1 if tag else -1


def parse(text: str) -> Element:
    root = Element("#root", frozenset())
    stack, at, n = [root], 0, len(text)
    lowered = None
    while at < n:
        lt = text.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            stack[-1].children.append(text[at:lt])
        if lt >= n:
            break
        nxt = text[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            if text.startswith("<!--", lt):
                end = text.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = text.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        closing = nxt == "/"
        name = NAME.match(text, lt + 1 + closing)
        if not name:
            stack[-1].children.append("<")
            at = lt + 1
            continue
        end = _tag_end(text, name.end())
        if end < 0:
            break
        tag, at = name.group().lower(), end + 1
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in ENDS_P:
            _close(stack, {"p"}, {"button", "td", "th", "table"})
        for ended, starts in ENDED_BY.items():
            if tag in starts:
                _close(stack, {ended}, SCOPE[ended])
        raw = text[name.end() : end]
        words = frozenset(w for a in ATTRIBUTE.finditer(raw) if a[1].lower() in CLASSES for w in WORDS.findall((a[2] or a[3] or a[4] or "").lower())) if "=" in raw else frozenset()
        element = Element(tag, words)
        stack[-1].children.append(element)
        if tag in VOID or raw.endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            lowered = text.lower() if lowered is None else lowered
            stop = lowered.find("</" + tag, at)
            if stop < 0:
                at = n
            else:
                gt = text.find(">", stop)
                at = n if gt < 0 else gt + 1
            continue
        stack.append(element)
    return root


def _close(stack: list[Element], tags: set[str], scope: set[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in scope:
            return


def _no_text(e: Element, inside: bool) -> bool:
    return e.tag in NO_TEXT or bool(e.words & NO_TEXT_WORDS) or not inside and (e.tag == "header" or "header" in e.words)


def _subtrees(root: Element, host: str) -> Iterator[tuple[Element, int, int | None]]:
    """Block elements with text, each with the hash of all it holds and, inside an article or main, the hash of that.

    Articles, mains and the elements around them are left out.
    """
    import xxhash

    done: dict[int, bytes] = {}
    around: set[int] = set()
    inside: list[tuple[Element, int]] = []  # of the article or main at hand
    todo: list = [(root, False, False)]
    while todo:
        e, within, ready = todo.pop()
        top = not within and e.tag in ("article", "main")
        if not ready:
            todo.append((e, within, True))
            todo.extend((c, within or top, False) for c in e.children if isinstance(c, Element))
            continue
        h = xxhash.xxh3_64(f"{host}\0{e.tag}\0{' '.join(sorted(e.words))}\0".encode())
        some = False
        for c in e.children:
            if isinstance(c, str):
                piece = " ".join(c.split())
                some |= bool(piece)
                h.update(piece.encode("utf-8", "surrogatepass"))
            else:
                h.update(done[id(c)])
                some = True
                if c.tag in ("article", "main") or id(c) in around:
                    around.add(id(e))
        done[id(e)] = h.digest()
        key = h.intdigest() - (1 << 63)
        if top:
            yield from ((x, k, key) for x, k in inside)
            inside.clear()
        elif some and e.tag in BLOCK and e.tag not in ("html", "body", "article", "main") and id(e) not in around:
            if within:
                inside.append((e, key))
            else:
                yield e, key, None


def subtree_hashes(root: Element, host: str, page: int) -> set[tuple[int, int]]:
    """The different hashes of a page, each with that of the article or main around it, or else ``page``."""
    return {(key, page if top is None else top) for _, key, top in _subtrees(root, host)} if host else set()


def page_hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _template_elements(root: Element, host: str, keys) -> set[int]:
    """ids of the elements whose hash is among ``keys``."""
    return {id(e) for e, key, _ in _subtrees(root, host) if key in keys}


def main_text(root: Element, gone: set[int] = frozenset()) -> str:
    """Blocks of the articles, or of the main element, or else of the page."""
    for wanted in (lambda e: e.tag == "article", lambda e: e.tag == "main" or "main" in e.words or e.words >= {"content"}):
        tops, todo = [], [root]
        while todo:
            e = todo.pop()
            if id(e) in gone or e is not root and _no_text(e, False):
                continue
            if e is not root and wanted(e):
                tops.append(e)
                continue
            todo.extend(c for c in reversed(e.children) if isinstance(c, Element))
        if tops:
            return "\n\n".join(b for top in tops for b in blocks(top, gone, True))
    return "\n\n".join(blocks(root, gone, False))


def blocks(top: Element, gone: set[int], inside: bool) -> list[str]:
    out, line = [], []

    def flush() -> None:
        words = html.unescape("".join(line)).split()
        if words:
            out.append(" ".join(words))
        line.clear()

    todo: list = [top]
    while todo:
        e = todo.pop()
        if e is None:
            flush()
        elif isinstance(e, str):
            line.append(e)
        elif e is not top and (id(e) in gone or _no_text(e, inside)):
            if e.tag in BLOCK:
                flush()
        elif e.tag == "br":
            line.append(" ")
        else:
            if e.tag in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(e.children))
    flush()
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", url or "")
    return m[1].lower() if m else ""


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys: list[tuple[int, int]] = []
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if text := page.as_py():
                keys.extend(subtree_hashes(parse(text), host_of(url), page_hash(text)))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int64()), pa.array([t for _, t in keys], pa.int64())], names=["key", "top"])


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    spark = pages.sparkSession
    ship(spark)
    pages = pages.select("page_id", "url", "html")
    by_top = pages.select("url", "html").mapInArrow(_hashes, "key long, top long").groupBy("key", "top").agg(F.lit(1).alias("one"))
    counted = by_top.groupBy("key").agg(F.count("one").alias("count"))
    recurring = materialize(counted.where(F.col("count") >= min_pages).select("key"), "html-template")
    schema = pages.schema
    result = f"page_id {schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"

    def texts(of_row):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for k, (url, page) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                    text = page.as_py()
                    if not text:
                        found.append("")
                        continue
                    root, keys = parse(text), of_row(batch, k)
                    found.append(main_text(root, _template_elements(root, host, keys) if keys and (host := host_of(url)) else frozenset()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

        return run

    if recurring.count() <= broadcast_keys:
        keys = spark.sparkContext.broadcast({r.key for r in recurring.collect()})  # checked: broadcast_keys at most
        return pages.mapInArrow(texts(lambda batch, k: keys.value), result)

    def own_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({k for k, _ in subtree_hashes(parse(t), host_of(u), 0)}) if t else [] for u, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names, "keys"])

    from pyspark.sql import types as T

    keyed = pages.withColumn("row", F.monotonically_increasing_id())
    keyed = materialize(keyed.mapInArrow(own_keys, T.StructType([*keyed.schema.fields, T.StructField("keys", T.ArrayType(T.LongType()))])), "html-keys")
    of_page = keyed.select("row", F.explode("keys").alias("key")).join(recurring, "key").groupBy("row").agg(F.collect_set("key").alias("gone"))
    both = keyed.drop("keys").join(of_page, "row", "left").select("page_id", "url", "html", "gone")
    return both.mapInArrow(texts(lambda batch, k: set(batch.column(3)[k].as_py() or ())), result)
