"""Main text of web pages: site templates are found by counting element subtrees per host, and removed."""

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.llm.common import small_batches, strings, table
from evalgrid.session import materialise

#: a subtree is the site's template if it stands on so many different pages of a host ...
LEAST_PAGES = 5
#: ... and, where it stands in articles, in as many of them as this share of the host's different pages
SHARE = 0.3

# Kinds of elements and the words by which sites name what is not the article.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_RAW = "script|style|noscript|template|textarea|title|iframe|svg|canvas|object|select|button|audio|video"
_NEVER = frozenset("head nav footer aside form search dialog label input".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form navigation search".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices popup promo promotion "
    "recommended related share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: ends what is open of the first, up to the second
_ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.I | re.S,
)
# Words that say of a named part only what shape it has.
_SHAPES = frozenset("area bar block body box btn button buttons container content form icons inner item items link links list outer panel row section text title wrap wrapper".split())
#: every attribute in turn, so that nothing inside a value is taken for one
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z]+")
_LAYOUT = re.compile(r"(?<![^\s])(?:with|has|no|without)-[a-z]+")  # of the page around a sidebar, not of the sidebar


class Element:
    __slots__ = ("tag", "names", "wholly_named", "role", "hidden", "children", "parent", "hash")

    def __init__(self, tag: str, attributes: str, parent: "Element | None"):
        self.tag, self.parent, self.children, self.hash = tag, parent, [], None
        self.names, self.wholly_named, self.role, self.hidden = frozenset(), False, "", False
        seen = set()
        for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
            name = m[1].lower()
            if name in seen or name not in ("class", "id", "role", "hidden"):
                continue
            seen.add(name)  # of an attribute given twice, the first counts
            value = unescape((m[2] or "").strip("\"'")).lower()
            if name in ("class", "id"):
                value = _LAYOUT.sub("", value)
                self.names |= frozenset(_WORD.findall(value))
                for one in value.split():
                    words = set(_WORD.findall(one)) - _SHAPES
                    self.wholly_named |= bool(words) and words <= _NAMES - {"header"}
            elif name == "role":
                self.role = value.strip()
            else:
                self.hidden = True

    def elements(self) -> Iterator["Element"]:
        """It and all elements in it, in page order."""
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack += [c for c in reversed(e.children) if isinstance(c, Element)]


def parse(html: str) -> Element:
    """The element tree of a page, however badly its tags are closed. Scripts, comments and such are left out."""
    root = Element("#page", "", None)
    at, done = root, 0
    for m in _TOKEN.finditer(html):
        if m.start() > done:
            at.children.append(unescape(html[done:m.start()]))
        done = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            e = at
            while e is not root and e.tag != tag:
                # an inline end tag does not end a block
                if tag not in _BLOCKS and e.tag in _BLOCKS:
                    e = root
                    break
                e = e.parent
            if e is not root:
                at = e.parent
            continue
        if tag in _BLOCKS:
            e = at
            while e is not root and e.tag != "p" and e.tag not in _BLOCKS:
                e = e.parent
            if e.tag == "p":
                at = e.parent
        if tag in _ENDS:
            ends, within = _ENDS[tag]
            e, last = at, None
            while e is not root and e.tag not in within:
                last = e if e.tag in ends else last
                e = e.parent
            if last is not None:
                at = last.parent
        e = Element(tag, m[4], at)
        at.children.append(e)
        if tag not in _VOID and not (m[4] or "").endswith("/"):
            at = e
    if done < len(html):
        at.children.append(unescape(html[done:]))
    return root


def _marked(e: Element) -> bool:
    return e.tag in ("article", "main") or e.role in ("article", "main")


def _mains(root: Element, removed: set[int], asides: bool = False) -> list[Element]:
    """The outermost elements that the page marks as its text, outside of what is removed; those in asides on demand."""
    out, stack = [], [root]
    while stack:
        e = stack.pop()
        if id(e) in removed or e.tag in _NEVER or not asides and _is_aside(e, False, set()):
            continue
        if _marked(e):
            out.append(e)
        else:
            stack += [c for c in reversed(e.children) if isinstance(c, Element)]
    return out


def subtree_hashes(root: Element) -> list[tuple[Element, int, Element]]:
    """The block elements that may be templates, their keys and the article, main element or else page each stands in.

    Sets the hash of every element's subtree; a key is that hash with the last bit set in an article or main
    element. Elements without text, those that are or hold an article or main element, and what
    is left out by its tag in any case are none.
    """
    every = list(root.elements())
    within, holds, never = {id(root): root}, set(), set()
    for e in every[1:]:
        within[id(e)] = e.parent if _marked(e.parent) else within[id(e.parent)]
        if e.tag in _NEVER or id(e.parent) in never:
            never.add(id(e))
    found = []
    for e in reversed(every):  # children before parents
        if _marked(e) or id(e) in holds:
            holds |= {id(e), id(e.parent)}
        parts = [e.tag, " ".join(sorted(e.names))]
        for c in e.children:
            parts.append(f"<{c.hash}>" if isinstance(c, Element) else " ".join(c.split()))
        e.hash = xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)
        may_be = e.tag in _BLOCKS and e.tag not in ("html", "body") and id(e) not in holds and id(e) not in never
        if may_be and any(parts[2:]):
            found.append((e, e.hash | 1 if _marked(within[id(e)]) else e.hash & ~1, within[id(e)]))
    return found


def _is_aside(e: Element, within_main: bool, holds_main: set[int]) -> bool:
    if id(e) in holds_main:
        return False
    if e.tag in _NEVER or e.hidden or e.role in _ROLES:
        return True
    if e.tag == "header":
        return not within_main
    # in an article a name counts only as a whole: "related-links" is an aside, "related-work" is text
    named = e.wholly_named if within_main else e.names & _NAMES
    return bool(named) and e.tag not in ("html", "body")


def main_text(html: str, templates: frozenset[int] | set[int]) -> str:
    """Blocks of the page's text, joined by line ends; ``templates`` are keys of subtrees to leave out."""
    root = parse(html)
    removed = {id(e) for e, key, _ in subtree_hashes(root) if key in templates} if templates else set()
    mains = _mains(root, removed)
    # where nothing is left without them, articles in what is named like an aside are the text
    return _text_of(root, mains, removed) or _text_of(root, _mains(root, removed, True), removed)


def _text_of(root: Element, mains: list[Element], removed: set[int]) -> str:
    holds_main: set[int] = set()
    for m in mains:
        e = m
        while e is not None:
            holds_main.add(id(e))
            e = e.parent
    lines: list[str] = []
    parts: list[str] = []

    def close() -> None:
        line = " ".join("".join(parts).split())
        parts.clear()
        if line:
            lines.append(line)

    for top in mains or [root]:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                close()
            elif isinstance(x, str):
                parts.append(x)
            elif x.tag == "br":
                parts.append(" ")
            elif id(x) not in removed and not _is_aside(x, bool(mains), holds_main):
                if x.tag in _BLOCKS:
                    close()
                    stack.append(None)
                stack += reversed(x.children)
        close()
    return "\n".join(lines)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def _list_subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, key, within, decides) of each batch, each once: a subtree and the article or page it stands in; key NULL
    for pages. Where a page's text is that of its articles, subtrees outside of them count but decide nothing."""
    for batch in batches:
        rows: set = set()
        ids = zip(batch.column("host").to_pylist(), batch.column("page").to_pylist(), strings(batch.column("html")), strict=True)
        for host, page, html in ids:
            root = parse(html)
            found = subtree_hashes(root)
            unmarked = not _mains(root, set())
            rows.add((host, page, None, root.hash, False))
            rows.update((host, page, key, within.hash, unmarked or key & 1 == 1) for _, key, within in found)
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "page", "key", "within", "decides"]
        )


def site_templates(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """host, page and the keys of the recurring subtrees that may be in its text, of the pages (host, page, html) that have any.

    A list is as long as its page at most, whatever the host's size.
    """
    found = pages.select("host", "page", "html").mapInArrow(_list_subtrees, "host string, page long, key long, within long, decides boolean")
    found = materialise(found, "subtrees")
    # copies of an article or page are one
    counted = found.select("host", "key", "within").distinct().groupBy("host", "key").agg(F.count("*").alias("pages"))
    counted = materialise(counted.where(F.col("key").isNull() | (F.col("pages") >= least_pages)), "subtree_counts")
    hosts = counted.where("key is null").select("host", F.col("pages").alias("host_pages"))
    frequent = counted.where("key is not null").join(hosts, "host")
    in_article = F.col("key").bitwiseAND(1) == 1
    frequent = frequent.where(~in_article | (F.col("pages") >= F.col("host_pages") * share))
    met = found.where("decides").select("host", "page", "key").join(frequent.select("host", "key"), ["host", "key"])
    return met.groupBy("host", "page").agg(F.collect_set("key").alias("templates"))


def extract_text(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``.

    The text is that of the article or main element; where a page marks none, that of the page. Left
    out are the site's templates, and menus, headers, footers, sidebars, notices, adverts, forms, comments and
    scripts as their tags, roles or names tell; in an article a name counts only if all of its words tell so.

    A template is a subtree (hashed with tags, names and text) that stands on ``least_pages`` different pages
    of the host. In an article it has to stand in as many as ``share`` of the host's pages too, as
    articles quote each other. A subtree is counted once for each different article, main element or else page it
    stands in, so that copies, which are one, stay whole. An article in an aside is text only where
    nothing else is. Character references are decoded, white space in a block is one blank, blocks are lines.

    NULL and empty pages have empty text; pages without host are one host. Repeated pages are
    extracted in each row, and count as one page of their host. Broken markup is read to its end. Other
    columns are ignored. No pages, no rows.
    """
    small_batches(pages.sparkSession)
    # equal numbers of two pages of a host would only join their lists, which changes no text
    page = F.xxhash64(F.coalesce("html", F.lit("")))
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), page.alias("page"))
    # Spark decides by the table's size how to join it
    templates = materialise(site_templates(pages, least_pages, share), "templates")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                main_text(html, frozenset(hashes or ()))
                for html, hashes in zip(strings(batch.column("html")), batch.column("templates").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())
            ], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.join(templates, ["host", "page"], "left").select("page_id", "url", "html", "templates").mapInArrow(
        extract, f"page_id {kind}, url string, text string, n_chars long"
    )


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
