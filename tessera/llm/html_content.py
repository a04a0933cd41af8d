"""Main text of web pages by wrapper induction.

1. A page is parsed once into a tree of its block elements (unclosed and stray tags, raw-text elements and comments are handled).
   Siblings with the same label (tag and first class without digits) become one node, as a wrapper's repeated part, so trees stay small whatever the
   page's length.
2. Pages of a host are aligned with the host's reference page, the one with the smallest hash of its id, by simple tree matching: the largest
   order-preserving match of nodes with equal labels. As labels of siblings differ, that is a heaviest increasing subsequence of the
   children, found in n log n. Alignments are remembered by the shapes of both trees, and most pages of a host share a shape.
3. Per host and reference node, the pages that hold each text there are counted over all pages (copies of a whole article count
   once). Texts that most pages hold in the same node are template; those that vary are content.
4. A page's text is what its article (or main part) holds outside menus, headers, footers, sidebars, notices, adverts, forms and comments, without
   the template's texts. A page without such an element gives its varying blocks.

Inside an article a text must be in TEMPLATE_SHARE of at least TEMPLATE_PAGES distinct pages to be template, as articles may well share passages;
elsewhere LOOSE_SHARE of LOOSE_PAGES are enough for a text of at most LOOSE_CHARS. If all of a page's text were template, it is kept.

Words of class and id. A name made of nothing but such words and neutral ones (comments, ad-box, site-footer) marks an element as boilerplate, unless it
holds the page's first article or its main, or is a heading. A name with other words besides (social-studies, notice-of-death) is only a vote: the
element goes if the alignment agrees, which is that its node repeats its texts from page to page, or if it is nothing but links. Outside an article and main, a run of
MENU_LINKS or more blocks of one node that are nothing but links is a menu.

Scale: a host's pages never meet in a task. Reference trees and templates are a row per host, joined to the pages by host; Spark broadcasts them
only when their written size is below the session's threshold, and otherwise splits the popular hosts' rows. Counts are aggregated
before they are shuffled.

Defined results: null or empty html gives an empty text; a null url has the host "" of its own; repeated rows and ids give a row each; the
only page of a host has no template; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import materialise, tune

# Fixed values ----------------------------------------------------------------------------------------------------------
RAW = frozenset("script style textarea title xmp noembed noframes".split())
SKIPPED = frozenset("head nav header footer aside form dialog menu template noscript iframe object svg math select button label input video audio canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag ends an open element of these kinds first.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that such an implied end does not reach beyond.
SCOPES = frozenset("ul ol dl table article main section div body html blockquote".split())
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner banners sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments disqus replies reply share sharing social related recommended widget widgets toolbar pagination pager search login signup skip".split()
)
#: Words that say nothing of their own beside one of these.
NEUTRAL = frozenset(
    "area article articles bar block bottom box button buttons btn column container content entry fixed form global google group icons inner item items js layout left link links list main page pane panel placeholder post posts primary right "
    "row secondary section site slot small the top unit wrap wrapper zone".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A word after one of these tells what a page has, not what the element is: has-sidebar, no-comments.
STATES = frozenset("has no not with without".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())

TEMPLATE_SHARE, TEMPLATE_PAGES = 0.8, 8
LOOSE_SHARE, LOOSE_PAGES = 0.5, 3
#: A longer text is a passage, and the strict figures hold for it everywhere.
LOOSE_CHARS = 80
#: A node with fewer distinct texts than this share of its blocks repeats them.
REPEATS = 0.5
MENU_LINKS = 3

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z))""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"[0-9]+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.IGNORECASE) for t in RAW}


#: Elements nested deeper than this count as part of the one at this depth.
DEPTH = 100


class Node:
    """A block element: its label, its children by label in order, its depth, and its number in document order."""

    __slots__ = ("label", "children", "depth", "number")

    def __init__(self, label: str, depth: int = 0):
        self.label, self.children, self.depth, self.number = label, {}, depth, 0

    def shape(self) -> list:
        return [self.label, *[c.shape() for c in self.children.values()]]


def _boilerplate(value: str) -> int:
    """How much the names in class or id mark boilerplate: 0 not, 1 a vote, 2 fully."""
    most = 0
    for name in value.split():
        parts = [p for x in _PART.split(name) if (p := _DIGITS.sub("", x.lower()))]
        named = [p in BOILERPLATE and not (k and parts[k - 1] in STATES) for k, p in enumerate(parts)]
        if any(named):
            most = max(most, 2 if all(n or p in NEUTRAL for n, p in zip(named, parts, strict=True)) else 1)
    return most


def _attributes(raw: str) -> tuple[str, str, bool, int]:
    """(first class without digits, role, whether it is hidden, how much the names of class and id mark boilerplate)."""
    first, role, hidden, named = "", "", False, 0
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), a or b or c
        if name == "class" and not first and value.split():
            first = _DIGITS.sub("", value.split()[0])
        if name in ("class", "id"):
            named = max(named, _boilerplate(value))
        elif name == "role":
            role = value.strip().lower()
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
    return first, role, hidden, named


@dataclass
class Block:
    """A run of text: its node's number, its container (2 an article, 1 a main element, 0 elsewhere), and the votes against it."""

    node: int
    container: int
    text: str
    doubt: bool  # a name of class or id speaks against it
    linked: bool  # nothing but links
    menu: bool = False


def parse(source: str) -> tuple[Node, list[Block]]:
    """(tree, blocks). Blocks inside boilerplate are left out, but their nodes are in the tree. Names of class and id do not mark an outer article or main,
    nor what holds the page's first article or its main; and if they marked all of a page's text, it is kept."""
    root = Node("#")
    stack: list[tuple] = [("#", root, False, 0, 0, False)]  # tag, node, skipped, container, innermost marked element, doubt
    blocks: list[tuple[Node, int, str, int, bool, bool]] = []
    around, stays, inner = [0], [True], [False]  # of each marked element: the one around it, whether it is kept, whether it is in an article
    seen = False  # an article that is kept
    words: list[str] = []
    plain = linked = False  # whether words hold text outside, and inside, links
    opened: dict[str, int] = {}  # how many elements of each tag are open
    at, n = 0, len(source)

    def leave(k: int) -> None:
        for tag, *_ in stack[k:]:
            opened[tag] -= 1
        del stack[k:]

    def close() -> None:
        nonlocal plain, linked
        if words and not stack[-1][2]:
            _, node, _, container, mark, doubt = stack[-1]
            if text := " ".join(entities.unescape("".join(words)).split()):
                blocks.append((node, container, text, mark, doubt, linked and not plain))
            words.clear()
            plain = linked = False

    while at < n:
        m = _TAG.search(source, at)
        if not stack[-1][2]:
            piece = source[at : m.start() if m else n]
            words.append(piece)
            if piece and not piece.isspace():
                if opened.get("a"):
                    linked = True
                else:
                    plain = True
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br" and not stack[-1][2]:
                words.append(" ")
            if opened.get(tag):
                k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag)
                # an inline element that is skipped ends no block
                if any(stack[j][0] in BLOCKS or stack[j][4] != stack[j - 1][4] for j in range(k, len(stack))):
                    close()
                leave(k)
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(source, at)
            at = end.end() if end else n
            continue
        if tag in VOID:
            if tag == "hr":
                close()
            elif not stack[-1][2]:
                words.append(" ")
            continue
        if tag in BLOCKS:
            close()
            ends = ENDS.get(tag)
            for k in range(len(stack) - 1, 0, -1):
                open_tag = stack[k][0]
                if open_tag == "p" or (ends and open_tag in ends):
                    leave(k)
                    if not ends:
                        break
                elif open_tag in SCOPES or (stack[k][2] and not stack[k - 1][2]):
                    break
        _, parent, skipped, container, mark, doubt = stack[-1]
        first, role, hidden, named = _attributes(m[3]) if m[3] else ("", "", False, 0)
        is_main = tag == "main" or (container == 0 and role == "main")
        if is_main or tag in ("html", "body") or tag in HEADINGS or (tag == "article" and container < 2):
            named = 0
        inside_article = container == 2
        if tag == "article":
            container = 2
        elif is_main:
            container = max(container, 1)
        skips = skipped or (tag in SKIPPED and not (tag == "header" and inside_article)) or ((hidden or role in ROLES) and tag not in ("html", "body", "main"))
        if named == 2 and not skips:
            close()
            around.append(mark)
            stays.append(False)
            inner.append(inside_article)
            mark = len(around) - 1
        elif (is_main or tag == "article") and not skips and not (tag == "article" and seen):
            k = mark
            while not stays[k] and not inner[k]:
                stays[k] = True
                k = around[k]
            seen = seen or (tag == "article" and stays[k])
        doubt = container != 2 and doubt if tag == "article" else doubt or named == 1
        node = parent
        if tag in BLOCKS:
            label = f"{tag}.{first}" if first else tag
            if parent.depth < DEPTH:
                node = parent.children.get(label)
                if node is None:
                    node = parent.children[label] = Node(label, parent.depth + 1)
        if m[3].endswith("/") and tag not in BLOCKS:
            continue
        stack.append((tag, node, skips, container, mark, doubt))
        opened[tag] = opened.get(tag, 0) + 1
    while len(stack) > 1 and stack[-1][2]:  # text before an element that is skipped and never ends
        leave(len(stack) - 1)
    close()

    count = 0

    def number(node: Node) -> None:
        nonlocal count
        node.number = count
        count += 1
        for c in node.children.values():
            number(c)

    number(root)
    for k in range(1, len(stays)):
        stays[k] = stays[k] and stays[around[k]]
    kept = [Block(node.number, container, text, doubt, link) for node, container, text, mark, doubt, link in ([b for b in blocks if stays[b[3]]] or blocks)]
    a = 0
    while a < len(kept):
        b = a + 1
        if kept[a].linked and not kept[a].container:
            while b < len(kept) and kept[b].linked and kept[b].node == kept[a].node:
                b += 1
            for x in kept[a:b]:
                x.menu = b - a >= MENU_LINKS
        a = b
    return root, kept


def _heaviest(places: list[tuple[int, int, int]], width: int) -> tuple[int, list[int]]:
    """(weight, numbers) of the heaviest subsequence of (row, column, weight), rows ascending, whose columns ascend as well."""
    best: list[tuple[int, int]] = [(0, -1)] * (width + 1)  # by a binary indexed tree over columns: the heaviest end so far
    before = [-1] * len(places)
    top = (0, -1)
    for k, (_, column, weight) in enumerate(places):
        found, i = (0, -1), column
        while i > 0:
            if best[i][0] > found[0]:
                found = best[i]
            i -= i & -i
        before[k] = found[1]
        made = (found[0] + weight, k)
        if made[0] > top[0]:
            top = made
        i = column + 1
        while i <= width:
            if made[0] > best[i][0]:
                best[i] = made
            i += i & -i
    chain, k = [], top[1]
    while k >= 0:
        chain.append(k)
        k = before[k]
    return top[0], chain[::-1]


def simple_tree_matching(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of preorder numbers of the largest order-preserving match of two trees [label, child, ...] with equal roots. Siblings' labels must differ."""

    def numbered(t: list, at: int) -> tuple[tuple, int]:
        number, children = at, {}
        at += 1
        for c in t[1:]:
            children[c[0]], at = numbered(c, at)
        return (number, children), at

    def match(x: tuple, y: tuple) -> tuple[int, tuple, list]:
        columns = {label: k for k, label in enumerate(y[1])}
        both = [(k, label) for k, label in enumerate(x[1]) if label in columns]
        inside = [match(x[1][label], y[1][label]) for _, label in both]
        weight, chain = _heaviest([(k, columns[label], m[0]) for (k, label), m in zip(both, inside, strict=True)], len(columns))
        return weight + 1, (x[0], y[0]), [inside[k] for k in chain]

    if a[0] != b[0]:
        return []
    out, todo = [], [match(numbered(a, 0)[0], numbered(b, 0)[0])]
    while todo:
        _, pair, chosen = todo.pop()
        out.append(pair)
        todo += chosen[::-1]
    return out


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), F.lit(""))


_BLOCKS = "array<struct<slot:int,container:int,text:string,doubt:boolean,linked:boolean,menu:boolean>>"
_BLOCK_TYPE = pa.list_(pa.struct([("slot", pa.int32()), ("container", pa.int32()), ("text", pa.string()), *[(k, pa.bool_()) for k in ("doubt", "linked", "menu")]]))


def reference_shapes(pages: DataFrame) -> DataFrame:
    """(host, shape): the reference page's tree of each host, as JSON."""
    order = F.struct(F.xxhash64("page_id"), F.xxhash64("html"))
    chosen = pages.where("html is not null").groupBy("host").agg(F.min_by("html", order).alias("html"))

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"host": batch.column("host"), "shape": [json.dumps(parse(x)[0].shape()) for x in batch.column("html").to_pylist()]})

    return chosen.mapInArrow(shapes, "host string, shape string")


def aligned_blocks(pages: DataFrame, references: DataFrame) -> DataFrame:
    """page_id, url, host and the blocks of the page's article, main or whole, with the reference node (slot) that each stands in, -1 where it has no match."""
    joined = pages.join(references, "host", "left").select("page_id", "url", "host", "html", "shape")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], dict[int, int]] = {}
        for batch in batches:
            out = []
            for source, shape in zip(batch.column("html").to_pylist(), batch.column("shape").to_pylist(), strict=True):
                tree, blocks = parse(source or "")
                own = json.dumps(tree.shape())
                slots = known.get((shape, own))
                if slots is None:
                    if len(known) > 5000:
                        known.clear()
                    slots = known[shape, own] = {j: i for i, j in simple_tree_matching(json.loads(shape), json.loads(own))} if shape else {}
                best = max((b.container for b in blocks), default=0)  # outside an article or main nothing counts where there is one
                out.append([{"slot": slots.get(b.node, -1), "container": b.container, "text": b.text, "doubt": b.doubt, "linked": b.linked, "menu": b.menu} for b in blocks if b.container == best])
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id").cast(pa.int64()), "url": batch.column("url"), "host": batch.column("host"), "blocks": pa.array(out, _BLOCK_TYPE)})

    return joined.mapInArrow(align, f"page_id long, url string, host string, blocks {_BLOCKS}")


def _place(b):
    """A hash of slot, container and text, whose lowest bit says whether the strict figures hold. A number, as distinct numbers are found by hashing."""
    strict = ((b["container"] > 0) | (F.length(b["text"]) > LOOSE_CHARS)).cast("long")
    return F.xxhash64(b["slot"], b["container"], b["text"]).bitwiseAND(F.lit(-2)).bitwiseOR(strict)


def _node(b):
    return F.xxhash64(b["slot"], F.lit("repeats its texts"))


def templates(aligned: DataFrame) -> DataFrame:
    """(host, constant): hashes of (slot, container, text) that are the host's template, and of the doubtful slots that repeat their texts."""
    doubts = F.transform(F.filter("blocks", lambda b: b["doubt"]), lambda b: F.concat_ws(":", _node(b).cast("string"), _place(b).cast("string")))
    hashed = aligned.select("host", F.xxhash64(F.to_json("blocks")).alias("article"), F.transform("blocks", _place).alias("places"), doubts.alias("doubts"))
    distinct = hashed.groupBy("host", "article").agg(F.any_value("places").alias("places"), F.any_value("doubts").alias("doubts"))
    pages = distinct.groupBy("host").agg(F.count("*").alias("pages"))
    each = distinct.select("host", F.explode(F.array_distinct("places")).alias("h"))
    counts = each.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= LOOSE_PAGES)
    strict = F.col("h").bitwiseAND(F.lit(1)) == 1
    share, least = F.when(strict, TEMPLATE_SHARE).otherwise(LOOSE_SHARE), F.when(strict, TEMPLATE_PAGES).otherwise(LOOSE_PAGES)
    constant = counts.join(pages, "host").where((F.col("n") >= share * F.col("pages")) & (F.col("pages") >= least)).select("host", "h")
    of_nodes = distinct.select("host", F.explode(F.array_distinct("doubts")).alias("d")).groupBy("host", "d").agg(F.count("*").alias("n"))
    nodes = of_nodes.groupBy("host", F.substring_index("d", ":", 1).cast("long").alias("h")).agg(F.count("*").alias("texts"), F.sum("n").alias("n"))
    repeated = nodes.where((F.col("n") >= LOOSE_PAGES) & (F.col("texts") < REPEATS * F.col("n"))).select("host", "h")
    return constant.unionByName(repeated).groupBy("host").agg(F.collect_set("h").alias("constant"))  # at most a page's blocks / LOOSE_SHARE, and the nodes of the reference page


def main_text(pages: DataFrame, use_template: bool = True) -> DataFrame:
    """page_id, url, text and n_chars of every page. use_template: whether the alignment has its say (without it, for comparison only)."""
    spark = pages.sparkSession
    tune(spark)
    pages = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    references = materialise(reference_shapes(pages), "reference-pages")
    aligned = materialise(aligned_blocks(pages, references), "aligned-pages")
    constant = materialise(templates(aligned), "templates") if use_template else spark.createDataFrame([], "host string, constant array<long>")
    found = aligned.join(constant, "host", "left")
    holds = lambda h: F.coalesce(F.array_contains(F.col("constant"), h), F.lit(False))
    varying = F.filter("blocks", lambda b: ~(holds(_place(b)) | (b["doubt"] & (b["linked"] | holds(_node(b)))) | b["menu"]))
    found = found.withColumn("varying", varying)
    kept = F.when(F.size("varying") > 0, F.col("varying")).otherwise(F.col("blocks"))
    text = F.concat_ws("\n\n", F.transform(kept, lambda b: b["text"]))
    return found.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
