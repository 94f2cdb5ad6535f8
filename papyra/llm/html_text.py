"""Operator 11: the main text of web pages by composite text density.

A page is read into a tree of elements, as browsers do with broken markup: paragraphs, list
items and cells close each other, end tags without a start are passed over. What is page
furniture by its tag, role or names (menus, site headers, footers, sidebars, notices, adverts,
forms, comments) is taken out. Every element that is left has

    density = C/T * log_b(C/LC * T/LT),   b = ln(C/(C-LC) * LC + LCb/Cb * C + e)

with its characters C, tags T, characters LC and tags LT of links, and the page's LCb, Cb (zeros
count as 1; without links on the page C/T alone). The element whose children have the largest sum
of densities is the core; the least density on the path from it to the body is the threshold, and
elements that reach it give their own maximum-sum subtrees too. Where the core lies in an element
that the page itself declares as its article, that element is the answer.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import give_back, id_type, table

#: Comment, declaration, tag or text. Quotes count only behind an equals sign, as in browsers.
TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+)(?:>|\Z)
    |(?P<text>[^<]++|<)""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def words(s: str) -> frozenset[str]:
    return frozenset(s.split())


# HTML's own classes of elements.
VOID = words("area base br col embed frame hr img input link meta param source track wbr")
RAW = words("script style textarea title iframe noembed noframes xmp")
BLOCKS = words(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul"
)
HEADINGS = words("h1 h2 h3 h4 h5 h6")
#: A start tag ends open elements of these kinds, up to an element of the last set.
LISTS, TABLE = words("ul ol menu dir"), words("table")
CLOSES = {
    "li": (words("li"), LISTS), "dt": (words("dt dd"), words("dl")), "dd": (words("dt dd"), words("dl")),
    "tr": (words("tr td th"), TABLE), "td": (words("td th"), TABLE | words("tr")), "th": (words("td th"), TABLE | words("tr")),
    "tbody": (words("tr td th tbody thead tfoot"), TABLE), "tfoot": (words("tr td th tbody thead tfoot"), TABLE), "option": (words("option"), words("select datalist")),
}
#: End tags look for their start no further than this.
WITHIN = {"li": LISTS, "td": TABLE, "th": TABLE, "tr": TABLE, "dd": words("dl"), "dt": words("dl")}

# What is never part of an article, by tag, by role, and by the words of class and id.
NEVER = words("script style noscript template title meta link base svg canvas iframe object embed audio video textarea select button input datalist noembed noframes dialog map")
FURNITURE_TAGS = words("nav footer aside search form header")
FURNITURE_ROLES = words("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar tablist status")
#: Names of things that may stand around an article: they don't count for an element that holds the page's article.
AROUND = words("nav navbar navigation menu menus breadcrumb breadcrumbs masthead header footer sidebar sidebars banner banners notice notices notification notifications search searchbox login signin signup subscribe subscription newsletter toolbar topbar pager pagination social share sharing widget widgets modal popup overlay cookie cookies consent gdpr copyright alert alerts promo promos promotion form skip bar aside foot")
#: Names of things that count wherever they stand.
ALWAYS = words("ad ads adbox adsense adslot advert adverts advertisement advertisements advertising sponsor sponsored sponsors comment comments commentlist disqus reply replies outbrain taboola")
#: Names of things that count together with what they are of: a list of other pages, not a section on related work.
OTHERS, PAGES = words("related recommended recommendation recommendations more"), words("post posts article articles link links story stories news reading")
STEMS = re.compile(r"(?:nav|navbar|menu|footer|sidebar|comments|breadcrumbs?|banner)$|^(?:advert|cookie|sponsor|sidebar|breadcrumb|newsletter)")
#: Before such a word a name says that the thing is elsewhere on the page.
ABOUT_OTHERS = words("has with no without is not hide show")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("attributes", "below", "chars", "core", "dense", "drop", "kids", "link_chars", "link_tags", "parent", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.kids: list[Node | str] = []
        self.drop = False


def parse(page: str) -> Node:
    """The tree of a page. Head and body are not told apart: what a head holds never counts."""
    root = Node("body", None)
    here, at, size = root, 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        text = m["text"]
        if text is not None:
            here.kids.append(html.unescape(text) if "&" in text else text)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            here = _ended(here, tag)
            continue
        if tag in ("html", "head", "body"):
            continue
        here = _room(here, tag)
        node = Node(tag, here, m["attributes"])
        here.kids.append(node)
        if tag in RAW:
            stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            at = stop.start() if stop else size
            if stop:
                at = page.find(">", at) + 1 or size
        elif tag not in VOID:
            here = node
    return root


def _room(here: Node, tag: str) -> Node:
    """Where an element of this tag goes, once those that it ends are closed."""
    if tag in BLOCKS:
        up = here
        while up.parent and up.tag not in BLOCKS:
            up = up.parent
        if up.tag == "p" or (up.tag in HEADINGS and tag in HEADINGS):
            here = up.parent
    ends, limit = CLOSES.get(tag, (None, None))
    if ends:
        up, last = here, None
        while up.parent and up.tag not in limit:
            if up.tag in ends:
                last = up
                if tag in ("li", "dt", "dd", "option"):
                    break
            up = up.parent
        if last:
            here = last.parent
    return here


def _ended(here: Node, tag: str) -> Node:
    """Where the reader is after an end tag."""
    if tag in ("html", "head", "body"):
        return here
    up, limit = here, WITHIN.get(tag, ())
    while up.parent and up.tag != tag:
        if up.tag in limit or (tag not in BLOCKS and up.tag in BLOCKS):
            return here  # inline marks don't end the blocks inside them
        up = up.parent
    return up.parent if up.parent else here


def _attributes(node: Node) -> dict[str, str]:
    found = {}
    for name, *values in ATTRIBUTE.findall(node.attributes):
        found.setdefault(name.lower(), html.unescape("".join(values)))
    return found


def _names(attributes: dict[str, str]) -> Iterator[str]:
    """Lower-case words of class and id, but those behind a word like "has"."""
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        before = ""
        for w in WORD.findall(name):
            if before not in ABOUT_OTHERS:
                yield w.lower()
            before = w.lower()


def _holds_article(node: Node) -> bool:
    todo = [node]
    while todo:
        for k in todo.pop().kids:
            if not isinstance(k, str):
                if k.tag in ("article", "main"):
                    return True
                todo.append(k)
    return False


def _text_size(node: Node) -> int:
    todo, n = [node], 0
    while todo:
        for k in todo.pop().kids:
            if isinstance(k, str):
                n += len(k.strip())
            else:
                todo.append(k)
    return n


def is_furniture(node: Node, in_article: bool, half: int) -> bool:
    """Whether an element is no part of an article. in_article: one is open around it; half: half the characters of the page."""
    if node.tag in NEVER:
        return True
    a = _attributes(node) if node.attributes else {}
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or HIDDEN.search(a.get("style", "")):
        return True
    # A heading's id is an anchor that its own words have given.
    names = list(_names(a)) if ("class" in a or "id" in a) and node.tag not in HEADINGS else ()
    if any(n in ALWAYS or n.startswith(("advert", "sponsor")) or n.endswith("comments") for n in names):
        return True
    if OTHERS.intersection(names) and PAGES.intersection(names):
        return True
    by_tag = node.tag in FURNITURE_TAGS and not (node.tag == "header" and in_article)
    by_role = a.get("role", "").lower() in FURNITURE_ROLES
    by_name = node.tag not in ("article", "main") and any(n in AROUND or STEMS.search(n) for n in names)
    if by_name and in_article and "header" in names and any(not isinstance(k, str) and k.tag in HEADINGS for k in node.kids):
        by_name = False  # the article's own head
    if not (by_tag or by_role or by_name):
        return False
    if node.tag in ("nav", "footer", "aside"):
        return True
    # A frame or form around the whole page is no furniture.
    return not _holds_article(node) and _text_size(node) <= half


def prune(root: Node) -> None:
    half = _text_size(root) // 2
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        for k in node.kids:
            if not isinstance(k, str):
                k.drop = is_furniture(k, inside, half)
                if not k.drop:
                    todo.append((k, inside or k.tag in ("article", "main")))


def kept(node: Node) -> list[Node | str]:
    return [k for k in node.kids if isinstance(k, str) or not k.drop]


def in_order(root: Node) -> list[Node]:
    """Kept elements, parents first, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [k for k in reversed(node.kids) if not isinstance(k, str) and not k.drop]
    return out


def page_links(root: Node) -> tuple[int, int]:
    """Characters in links, and all characters, of the page as it came."""
    todo, links, chars = [(root, False)], 0, 0
    while todo:
        node, inside = todo.pop()
        inside = inside or node.tag == "a"
        for k in node.kids:
            if isinstance(k, str):
                n = len(k.strip())
                chars += n
                links += n if inside else 0
            elif k.tag not in NEVER:
                todo.append((k, inside))
    return links, chars


def density(chars: int, tags: int, link_chars: int, link_tags: int, page_link_chars: int, page_chars: int) -> float:
    """Composite text density; zero counts stand as 1."""
    if not chars:
        return 0.0
    plain = chars / max(tags, 1)
    if not page_link_chars:
        return plain
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + page_link_chars / max(page_chars, 1) * chars + math.e)
    return plain * math.log(chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1)) / math.log(base)


def measure(root: Node) -> list[Node]:
    """Gives kept elements their counts, densities and sums; a run of text beside elements counts in a sum as an element without tags."""
    links, chars = page_links(root)
    order = in_order(root)
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.sum = 0.0
        for k in kept(node):
            if isinstance(k, str):
                n = len(k.strip())
                node.chars += n
                if n:
                    node.sum += density(n, 1, 0, 0, links, chars)
            else:
                node.chars += k.chars
                node.tags += k.tags + 1
                node.link_chars += k.link_chars
                node.link_tags += k.link_tags + (k.tag == "a")
                node.sum += k.dense
        if node.tag == "a":
            node.link_chars = node.chars
        node.dense = density(node.chars, node.tags, node.link_chars, node.link_tags, links, chars)
        # The maximum-sum element in here: of equal sums the outer one.
        node.core = max([node, *(k.core for k in kept(node) if not isinstance(k, str))], key=lambda n: n.sum)
    return order


def _declared(core: Node) -> Node | None:
    """The innermost element around the core, or the core, that is the page's article by its own account."""
    up, main = core, None
    while up:
        a = _attributes(up) if up.attributes else {}
        if up.tag == "article" or a.get("role", "").lower() == "article" or a.get("itemprop", "").lower() == "articlebody":
            return up
        if main is None and (up.tag == "main" or a.get("role", "").lower() == "main"):
            main = up
        up = up.parent
    return main


def content(root: Node) -> list[Node]:
    """The elements whose text is the page's main text, in page order; none lies in another."""
    order = measure(root)
    core = root.core
    declared = _declared(core)
    if declared:
        return [declared]
    path, up = [], core
    while up:
        path.append(up)
        up = up.parent
    threshold = min(n.dense for n in path)
    around, marked, todo = set(path), set(), [root]
    while todo:
        node = todo.pop()
        if node in marked or node.dense < threshold:
            continue
        marked.add(node.core)
        todo += [k for k in kept(node) if not isinstance(k, str)]
    # A heading above the core belongs to it.
    marked |= {n for n in order if n.tag in HEADINGS and n.parent in around and n.parent is not root}
    return [n for n in order if n in marked and not any(p in marked for p in _above(n))]


def _above(node: Node) -> Iterator[Node]:
    up = node.parent
    while up:
        yield up
        up = up.parent


def blocks(node: Node) -> list[str]:
    """Texts of an element's blocks in page order. One line break is white space, two in a row end a block."""
    out: list[str] = []
    open_: list[str] = []
    breaks = 0

    def close() -> None:
        text = " ".join("".join(open_).split())
        if text:
            out.append(text)
        open_.clear()

    todo: list[Node | str | None] = [node]
    while todo:
        k = todo.pop()
        if k is None:
            close()
        elif isinstance(k, str):
            open_.append(k)
            if not k.isspace():
                breaks = 0
        elif k.tag == "br":
            breaks += 1
            open_.append(" ")
            if breaks > 1:
                close()
        else:
            if k.tag in BLOCKS:
                close()
                todo.append(None)
                breaks = 0
            todo += reversed(kept(k))
    close()
    return out


def main_text(page: str | None) -> str:
    """The main text of one page: blocks joined by line feeds; empty for null, for pages without text, and for pages of furniture only."""
    if not page:
        return ""
    root = parse(page)
    prune(root)
    return "\n".join(b for n in content(root) for b in blocks(n))


def extract(pages: DataFrame, *, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, url_col, text and n_chars (code points) for each row of pages, from the whole page.

    Null and empty pages have empty texts; repeated rows are read one by one; null ids and
    addresses are passed on; further columns are left out, whatever their names; an empty table
    gives an empty one. One pass over the scan, without a shuffle; a worker holds one page's tree
    at a time, so that memory is bounded by a batch and the longest page.
    """
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    (id_sql, id_arrow), (url_sql, url_arrow) = id_type(rows, "page_id"), id_type(rows, "url")
    schema = pa.schema([("page_id", id_arrow), ("url", url_arrow), ("text", "string"), ("n_chars", "int64")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p.as_py()) for p in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id").cast(id_arrow), b.column("url").cast(url_arrow), pa.array(texts, "string"), pa.array(map(len, texts), "int64")], schema=schema)
            give_back()

    return rows.mapInArrow(run, f"page_id {id_sql}, url {url_sql}, text string, n_chars long").withColumnsRenamed({"page_id": id_col, "url": url_col})


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
