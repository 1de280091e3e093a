"""Main text of web pages by removal of site templates.

Every page is parsed into a tree. A slot is a place in a site's layout: the tags and classes from the root
down to a block element. For each slot of a page, hashes of its subtrees (their shape without text, their
text, and the run of its children) are counted in Spark over the distinct pages of the host. A slot whose
children recur is a frame that the layout goes on in; a slot inside frames whose shape or text recurs across
many pages, with little of the site's text, is the site's template and is deleted. Inside the article, boxes
whose whole content recurs are deleted too. What markup itself declares to be no article goes on any page;
an article element decides only what recurrence has left open.

Pages are parsed twice, once to hash and once to extract, so no page text is stored in between; a page meets
only the few template slots of its host.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bounded_batches, materialise, on_arrow, text_key

#: A slot or box is of the template if it is on so many distinct pages of its host at least, and on this share of them.
LEAST_PAGES, LEAST_SHARE = 5, 0.3
#: Of the pages that have a slot, so many share its most frequent shape, text or run of children.
SAME_SHAPE, SAME_TEXT, SAME_RUN = 0.8, 0.5, 0.5
#: A slot that holds more of its host's text than this isn't deleted for its shape.
MOST_TEXT = 0.15
#: One host's pages are joined with its template in so many parts.
PARTS = 64
#: Hosts whose templates are broadcast; with more, pages are shuffled to them.
BROADCAST_HOSTS = 20_000

# HTML element names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes".split())
#: Never shown as text.
UNSEEN = set("script style noscript template iframe object embed canvas svg math head title audio video map datalist".split())
#: What these names declare is no article; a header inside an article is its own.
DECLARED = set("nav header footer aside form button select textarea input menu dialog".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A paragraph ends where one of these begins.
CLOSE_P = BLOCKS - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary", "figcaption"}
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr table tbody thead tfoot ul ol dl figure figcaption".split())
ONLY_P, P_ENDS = {"p"}, set("td th button object table".split())
#: An end tag of another name doesn't reach out of a cell or table.
TABLE_ENDS, TABLE_PARTS = set("td th table".split()), set("td th tr table tbody thead tfoot body html".split())
#: Opening the key closes these, up to the barrier.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: First words of class or id names by which containers (never prose) declare themselves.
NAMES = set("ad ads advert advertisement sponsored banner promo nav navbar menu breadcrumb breadcrumbs sidebar footer comment comments reply replies cookie cookies newsletter related share social pagination".split())
READERS = set("comment comments reply replies".split())
TOKEN = re.compile(r"[^<]+|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z][^>]*\Z|<", re.DOTALL)
ATTR = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
FIRST_WORD = re.compile(r"[A-Za-z]+")
DIGITS = re.compile(r"[0-9]+")
SPACES = re.compile(r"\s+")
END_OF_RAW = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW}


class Node:
    """An element; kids are elements and texts. The names below are set by measure()."""

    __slots__ = ("name", "marks", "has", "main", "holds", "kids", "block", "blocks", "path", "shape", "content", "chars", "linked")

    def __init__(self, name: str, has: dict[str, str]):
        self.name, self.has, self.kids = name, has, []
        self.main = name in ("article", "main") or has.get("role") == "main" or has.get("itemprop") == "articleBody"
        self.holds = self.main  # an article or main element is in it
        self.block = name in BLOCKS
        named = f"{has.get('class', '')} {has.get('id', '')}".split() if has else []
        self.marks = " ".join(DIGITS.sub("0", w) for w in named)

    def first_words(self) -> set[str]:
        found = (FIRST_WORD.match(w.lower()) for w in self.marks.split())
        return {m[0] for m in found if m}


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(a or b or c or "") for k, a, b, c in ATTR.findall(text)}


class Open:
    """The elements that are open, from the root down, with counts by name: names that aren't open cost nothing."""

    def __init__(self, root: Node):
        self.stack, self.names = [root], {}

    def put(self, node: Node) -> None:
        self.stack.append(node)
        self.names[node.name] = self.names.get(node.name, 0) + 1

    def end(self, wanted: set[str], barrier: set[str]) -> None:
        """Close the innermost element of a wanted name and what is in it, unless a barrier stands before it."""
        if not any(self.names.get(w) for w in wanted):
            return
        stack = self.stack
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in wanted:
                for node in stack[k:]:
                    self.names[node.name] -= 1
                del stack[k:]
                return
            if stack[k].name in barrier:
                return


def parse(page: str) -> Node:
    """A tree of elements and texts. Never fails: what is not closed ends with its parent, what closes nothing is skipped."""
    root = Node("#root", {})
    open_ = Open(root)
    stack, at, n, match = open_.stack, 0, len(page), TOKEN.match
    while at < n:
        m = match(page, at)
        at = m.end()
        name = m["name"]
        if name is None:
            if page[m.start()] != "<" or at == m.start() + 1:
                stack[-1].kids.append(m[0])
            continue
        name = name.lower()
        if m["close"]:
            open_.end({name}, set() if name in TABLE_PARTS else TABLE_ENDS)
            continue
        if name in CLOSE_P:
            open_.end(ONLY_P, P_ENDS)
        if name in SIBLINGS:
            open_.end(*SIBLINGS[name])
        attrs = m["attrs"]
        node = Node(name, attributes(attrs) if len(attrs) > 1 and name != "a" else {})
        stack[-1].kids.append(node)
        if node.main:
            for above in reversed(stack):
                if above.holds:
                    break
                above.holds = True
        if name in RAW:
            end = END_OF_RAW[name].search(page, at)
            node.kids.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif name not in VOID and not attrs.rstrip().endswith("/"):
            open_.put(node)
    return root


def walk(root: Node) -> list[Node]:
    """All elements, each before its children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [k for k in reversed(node.kids) if isinstance(k, Node)]
    return out


def digest(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - 2**64 if h >= 2**63 else h


def runs(items: list) -> list:
    """items with repeated neighbours once."""
    return [x for i, x in enumerate(items) if not i or x != items[i - 1]]


def measure(root: Node) -> list[Node]:
    """Set path, block children, characters, shape and a hash of the content of all elements; the elements, each before its children.

    Repeated neighbours count once in a shape, so lists of any length have one.
    """
    nodes, todo = [], [(root, root)]
    root.path, root.blocks = 0, []
    while todo:
        node, above = todo.pop()
        nodes.append(node)
        if node is not root:
            node.blocks = []
            if node.block:
                above.blocks.append(node)
                node.path = digest(f"{above.path} {node.name} {node.marks}")
        inner = node if node.block or node is root else above
        todo += [(k, inner) for k in reversed(node.kids) if isinstance(k, Node)]
    for node in reversed(nodes):
        chars, linked, held = 0, 0, [node.name]
        if node.name not in UNSEEN:
            for k in node.kids:
                if isinstance(k, str):
                    k = k.strip()
                    chars += len(k)
                    held.append(k)
                else:
                    chars += k.chars
                    linked += k.linked
                    held.append(str(k.content))
        node.chars, node.linked = chars, chars if node.name == "a" else linked
        node.content = digest("\0".join(held))
        if node.block or node is root:
            node.shape = digest(f"{node.name} {node.marks} {2 * node.linked > node.chars} {runs([k.shape for k in node.blocks])}")
    return nodes


def is_slot(node: Node) -> bool:
    """Whether a template can own the element as a whole: a container, or prose that is mostly links."""
    return node.name not in PROSE or 2 * node.linked > node.chars


def slots_of(root: Node) -> list[tuple[int, int, int, int, int]]:
    """(path, shape, run, text, chars) of each slot of a page, over all elements that stand in it."""
    held: dict[int, list[Node]] = {}
    todo = [root]
    while todo:
        node = todo.pop()
        for k in reversed(node.blocks):
            if is_slot(k):
                held.setdefault(k.path, []).append(k)
                if k.name not in PROSE:
                    todo.append(k)
    out = []
    for path, nodes in held.items():
        run = runs([f"{b.name} {b.marks}" for n in nodes for b in n.blocks])
        out.append((path, digest(str(runs([n.shape for n in nodes]))), digest(str(run)), digest(str([n.content for n in nodes])), sum(n.chars for n in nodes)))
    return out


def boxes_of(root: Node) -> list[Node]:
    """Containers inside an article that don't hold another: their whole content can be told to recur."""
    out, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        for k in node.blocks:
            if inside and k.name not in PROSE and not k.holds:
                out.append(k)
            todo.append((k, inside or k.main))
    return out


def declared_outside(node: Node, inside: bool, names: bool) -> bool:
    """Whether markup itself says that an element is no part of the article."""
    if node.name in UNSEEN:
        return True
    if not names:
        return False
    has = node.has
    if node.name in DECLARED and not (node.name == "header" and inside):
        return True
    if not has:
        return False
    if has.get("role", "").lower() in ROLES or "hidden" in has or has.get("aria-hidden", "").lower() == "true":
        return True
    if not node.marks or node.name in ("html", "body", "main") or node.name in PROSE:
        return False
    words = node.first_words()
    if node.name == "article":
        return not READERS.isdisjoint(words)
    # a wrapper that holds the article is no part outside it, unless it is the readers'
    return not NAMES.isdisjoint(words) and (not READERS.isdisjoint(words) or not node.holds)


def blocks(root: Node, templates: set[int], frames: set[int], boxes: set[int], declared: bool = True, article: bool = True) -> list[str]:
    """The texts of the main part's blocks, in page order."""
    gone, in_article = set(), False
    todo: list = [(root, True, False)]
    while todo:
        node, framed, inside = todo.pop()
        if declared_outside(node, inside, declared):
            gone.add(id(node))
            continue
        if node.block:
            main = article and node.main
            if framed and node.path in templates and is_slot(node) and not main or inside and boxes and node.name not in PROSE and node.content in boxes:
                gone.add(id(node))
                continue
            framed = framed and node.path in frames
            inside = inside or node.main
            in_article |= main
        todo += [(k, framed, inside) for k in node.kids if isinstance(k, Node)]
    out: list[str] = []
    piece: list[str] = []

    def flush() -> None:
        text = SPACES.sub(" ", entities.unescape("".join(piece))).strip()
        piece.clear()
        if text:
            out.append(text)

    todo = [(root, not in_article)]
    while todo:
        node, inside = todo.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            if inside:
                piece.append(node)
        elif id(node) in gone:
            if node.block:
                flush()
        else:
            inside = inside or article and node.main
            if node.name == "br":
                piece.append(" ")
            if node.block:
                flush()
                todo.append((None, inside))
            todo += [(k, inside) for k in reversed(node.kids)]
    flush()
    return out


SLOTS = pa.list_(pa.struct([(c, pa.int64()) for c in ("path", "shape", "run", "text", "chars")]))
SEEN = pa.struct([("content", pa.int64()), ("chars", pa.int64()), ("slots", SLOTS), ("boxes", pa.list_(pa.int64()))])


@on_arrow("struct<content:long,chars:long,slots:array<struct<path:long,shape:long,run:long,text:long,chars:long>>,boxes:array<long>>")
def subtrees_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Of each page a hash of it, its characters, its slots and the distinct hashes of the boxes in its article."""
    for batch in batches:
        rows = []
        for page in batch:
            page = page.as_py() or ""
            root = parse(page)
            measure(root)
            slots = [dict(zip(("path", "shape", "run", "text", "chars"), s)) for s in slots_of(root)]
            rows.append({"content": digest(page), "chars": root.chars, "slots": slots, "boxes": sorted({b.content for b in boxes_of(root)})})
        yield pa.array(rows, type=SEEN)


def main_text_udf(declared: bool, article: bool):
    @F.arrow_udf("string")
    def main_text(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for pages, *sets in batches:
            out = []
            for page, templates, frames, boxes in zip(pages, *(s.to_pylist() for s in sets)):
                root = parse(page.as_py() or "")
                if templates or boxes:
                    measure(root)
                else:  # nothing recurs on the host: no place is compared
                    for node in walk(root):
                        node.path = 0
                out.append("\n".join(blocks(root, set(templates or ()), set(frames or ()), set(boxes or ()), declared, article)))
            yield pa.array(out, type=pa.string())

    return main_text


def host_of(url):
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """pages (host, content, chars, slots, boxes) -> (host, templates, frames, boxes): paths and content hashes, of hosts that have some.

    Copies of one page count once. A host's lists are short: each entry is on least_share of its pages.
    """
    distinct = materialise(pages.groupBy("host", "content").agg(F.first("chars").alias("chars"), F.first("slots").alias("slots"), F.first("boxes").alias("boxes")), "pages")
    totals = distinct.groupBy("host").agg(F.count("*").alias("pages"), F.sum("chars").alias("all_chars"))
    enough = lambda n: (n >= least_pages) & (n >= least_share * F.col("pages"))
    slots = distinct.select("host", F.explode("slots").alias("s")).select("host", "s.*")
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("shape", "run", "text")]
    counted = slots.select("host", "path", F.explode(F.array(*kinds)).alias("v")).groupBy("host", "path", "v.kind", "v.value").agg(F.count("*").alias("n"))
    most = counted.groupBy("host", "path").agg(*[F.max(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in ("shape", "run", "text")])
    sums = slots.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    told = most.join(sums, ["host", "path"]).join(totals, "host").where(enough(F.col("n")))
    little = F.col("chars") <= MOST_TEXT * F.col("all_chars")
    is_template = (F.col("text") >= SAME_TEXT * F.col("n")) | ((F.col("shape") >= SAME_SHAPE * F.col("n")) & little)
    is_frame = F.col("run") >= SAME_RUN * F.col("n")
    lists = lambda c, when: F.collect_list(F.when(when, F.col(c)))
    layout = told.groupBy("host").agg(lists("path", is_template).alias("templates"), lists("path", is_frame).alias("frames"))
    boxes = distinct.select("host", F.explode("boxes").alias("box")).groupBy("host", "box").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages).join(totals, "host").where(enough(F.col("n")))
    return layout.join(boxes.groupBy("host").agg(F.collect_list("box").alias("boxes")), "host", "full").where("size(coalesce(templates, array())) + size(coalesce(boxes, array())) > 0")


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, declared: bool = True, article: bool = True
) -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars.

    What recurs on the host goes (see above), then what markup declares to be no article (nav, header,
    footer, aside, forms, roles, hidden parts, containers whose class or id begins with a name such as
    ``ad`` or ``comments``); ``declared`` False leaves that to recurrence alone. Where an article or main
    element is left, only what lies in it is text, and it never goes for its shape; ``article`` False takes
    that away. Scripts, styles and the like are never text. Prose is never deleted for its shape. A null or
    empty html gives an empty text; a null url is a host of its own. Rows that share id and html get the same
    text. Other columns are not read.
    """
    rows = bounded_batches(pages).select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    found = materialise(templates(rows.select("host", subtrees_of("html").alias("s")).select("host", "s.*"), least_pages, least_share), "templates")
    if found.count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(found), "host", "left")
    else:
        # a host's template meets its pages in parts, so a host with most of the pages is no single task
        spread = found.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
        joined = rows.withColumn("part", F.pmod(F.xxhash64("page_id", text_key(F.col("html"))), F.lit(PARTS))).join(spread, ["host", "part"], "left")
    text = joined.select("page_id", "url", main_text_udf(declared, article)("html", "templates", "frames", "boxes").alias("text"))
    return text.withColumn("n_chars", F.char_length("text").cast("long"))
