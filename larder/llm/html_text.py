"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Every paragraph gives its container points for its
length and its commas (half of them to the grandparent, less further up); a container's
points are discounted by its link density. The best container (the article element around
it, if any) and those siblings that score near it are kept; menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments are left out
wherever they stand. A form around most of a page's paragraphs is the page itself.

Time is linear in the page: an end tag is looked up only if an element of its name is
open, and elements are skipped from block to block.

Defined cases: null or empty html gives an empty text; a page without any element is one
block of text; unclosed, crossed or cut-off markup is closed where HTML would close it;
ties between containers go to the one that opens first; repeated rows each give their
text; very long pages are read whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larder.llm.columns import map_text

FIELDS = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

# fixed values: HTML element names
VOID = frozenset("area base basefont br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|iframe|xmp|noembed|noframes"
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary "
                  "table tbody td tfoot th thead tr ul dialog".split())
DROPPED = frozenset("nav header footer aside button menu dialog head fieldset datalist label noscript template svg "
                    "select object canvas audio video".split())
PARAGRAPH = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 div section article main body".split())
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "caption"}
ITEM = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Blocks that an item which a new one ends may be behind.
THROUGH = frozenset("p tbody thead tfoot section article".split())

def names(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.I)


# fixed values: whole words of ids and classes
ADVERT = r"ads?|adv|advert\w*|adbox|adslot|sponsors?|sponsored|promos?|promobox|promotions?|promotional"
COMMENTS = r"comments?|comment(?:s?list|form|box|area|body|text|section)|respond|replies|reply|disqus\w*"
#: Left out whatever they hold.
UNWANTED = names(
    rf"{ADVERT}|{COMMENTS}|sidebar\w*|side|aside|\w*footer|foot|cookie\w*|consent\w*|gdpr|popup\w*|modal|"
    r"overlay|newsletter\w*|signup|login|hidden|outbrain|taboola|shoutbox")
#: The same for paragraphs, headings and quotations, whose classes often tell their looks.
UNWANTED_TEXT = names(rf"{ADVERT}|{COMMENTS}|cookie\w*|consent\w*|gdpr|newsletter\w*|hidden|outbrain|taboola|shoutbox")
#: Left out whatever they hold if a class says so; an id can be the slug of a heading.
NOTICE = names(r"notices?|alerts?|warning|disclaimer|discussion|feedback")
#: Left out unless they hold paragraphs (see ``doubts``).
DOUBTFUL = names(
    r"banners?|banner(?:ads?|box|wrap)|nav|navs|navi|navbar|navigation|nav(?:bars?|menu|list|links?|box|wrap|wrapper|container|item)|menus?|menu(?:bar|items?|list|links?|wrap|wrapper|container)|"
    r"breadcrumbs?|\w*header|masthead|topbar|toolbar|subscri(?:be|bers?|ptions?)|shar(?:e|ing)|share(?:bar|box|buttons?|links?)|"
    r"socials?|social(?:media|links?|icons?|bar|share)|related|related(?:posts?|articles?|links?|content|stories)|"
    r"recommend(?:ed|ations?)|paginat(?:ion|e|or)|pager|widgets?|skip|search|search(?:box|form|bar|results?)")
# an article element is unwanted only as a comment, teaser or advert
NO_ARTICLE = names(rf"{ADVERT}|comments?|repl(?:y|ies)|related|teaser")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Inside an article or main element, ids of these are slugs of headings or anchors. Only a
#: section may still be named for reader comments as a whole.
SLUGGED = HEADINGS | frozenset("p a span section dt dd li".split())
READERS = re.compile(r"comments|comments?[_-](?:list|form|area|section)|respond|replies|disqus[_-]thread", re.I)
LAYOUT = re.compile(r"(?:^|(?<=[\s_-]))(?:no|with|has|without)[_-]\S+", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
WANTED = re.compile(r"article|content|entry|main|post|story|text|body", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar form".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# a quote opens a quoted value only after the equals sign
INSIDE_TAG = r"(?:[^<>=]|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*+)|=)*+"
TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(" + RAW + r")(?=[\s/>])" + INSIDE_TAG + r">.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*)(" + INSIDE_TAG + r")>|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*>|</?[a-zA-Z][^<>]*(?:>|\Z)|</?\Z",
    re.S | re.I)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?=[\s/]|\Z))", re.I)
SPACE = re.compile(r"\s+")

#: Points and link density at which paragraphs overrule a doubtful name.
OVERRULE_POINTS, OVERRULE_DENSITY = 10.0, 0.25
SIBLING_SHARE = 0.2
SIBLINGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
MENU_LINKS, MENU_DENSITY = 3, 0.6


class Node:
    __slots__ = ("tag", "parent", "children", "bad", "bonus", "score", "plain", "length", "linked", "links", "order", "doubt", "inside",
                 "block", "open")

    def __init__(self, tag: str, parent: Node | None, bad: bool, bonus: float, order: int):
        self.tag, self.parent, self.bad, self.bonus, self.order = tag, parent, bad, bonus, order
        self.children: list = []
        self.doubt = False
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        # the block that the element is or stands in; a block counts its open inline elements by name
        self.block = self if parent is None or tag in BLOCK else parent.block
        self.open: dict = {}
        self.score = self.plain = 0.0
        self.length = self.linked = self.links = 0


def parse(source: str) -> Node:
    """The element tree of a page. Text stays raw between elements; the subtrees of
    unwanted elements are marked."""
    doubtful = False
    root = node = Node("#root", None, False, 0, 0)
    order, at = 0, 0
    open_blocks: dict[str, int] = {}

    def close_to(up: Node) -> Node:
        """Closes elements up to a child of ``up``."""
        nonlocal node
        while node is not up:
            counts = open_blocks if node.tag in BLOCK else node.block.open
            counts[node.tag] -= 1
            node = node.parent
        return node

    for m in TOKEN.finditer(source):
        if m.start() > at:
            node.children.append(source[at:m.start()])
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(2):
            # an inline end tag never closes a block
            if tag in BLOCK and open_blocks.get(tag) or tag not in BLOCK and node.block.open.get(tag):
                up = node
                while up.tag != tag:
                    up = up.parent
                close_to(up.parent)
            continue
        if tag in CLOSES_P and node.block.tag == "p":
            close_to(node.block.parent)  # a block ends an open paragraph, so none is open further out
        if tag in ITEM:
            up = node.block
            while up.tag in THROUGH and up.tag not in ITEM[tag]:
                up = up.parent.block
            if up.tag in ITEM[tag]:
                close_to(up.parent)
        if tag in ("br", "hr"):
            node.children.append("\n" if tag == "br" else Node("hr", node, False, 0, order))
            continue
        if tag in VOID:
            continue
        order += 1
        bad, bonus, doubt, role = judge(tag, m.group(4), node.inside)
        child = Node(tag, node, bad, bonus, order)
        child.doubt, child.inside = doubt and not bad, child.inside or role
        doubtful |= child.doubt
        node.children.append(child)
        if not m.group(4).rstrip().endswith("/") or tag in BLOCK:
            counts = open_blocks if tag in BLOCK else child.block.open
            counts[tag] = counts.get(tag, 0) + 1
            node = child
    if at < len(source):
        node.children.append(source[at:])
    if doubtful:
        doubts(root)
    return root


def judge(tag: str, attributes: str, inside: bool) -> tuple[bool, float, bool, bool]:
    """Whether an element is unwanted with all it holds; the points it starts with;
    whether its name alone speaks against it; whether its role is that of the main part.
    ``inside`` tells that it stands in an article or main element."""
    bad, bonus, doubt, own_main = tag in DROPPED, 0.0, tag == "form", False
    if tag in ("article", "main"):
        bonus += 30
    elif tag in ("div", "section", "td"):
        bonus += 5
    elif tag in ("ul", "ol", "dl", "li", "table", "tr"):
        bonus -= 3
    if attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), html.unescape("".join(values))
            if name in ("class", "id"):
                whole, value = value, CAMEL.sub("-", LAYOUT.sub("", value))
                named = tag not in ("html", "body", "main")
                if name == "id" and (tag in HEADINGS or inside and tag in SLUGGED):
                    named = False
                    bad |= tag == "section" and bool(READERS.fullmatch(whole.strip()))
                text = tag in SIBLINGS
                if named and (NO_ARTICLE if tag == "article" else UNWANTED_TEXT if text else UNWANTED).search(value):
                    bad = True
                elif named and tag != "article" and NOTICE.search(value):
                    bad, doubt = bad or name == "class", True
                elif named and tag != "article" and not text and DOUBTFUL.search(value):
                    doubt = True
                elif WANTED.search(value):
                    bonus += 15
            elif name == "role":
                bad |= value.lower() in ROLES
                own_main = value.lower() in ("main", "article")
                bonus += 30 * own_main
            elif name == "style":
                bad |= bool(HIDDEN.search(value))
            elif name == "hidden":
                bad = True
            elif value.lower() == "true":
                bad = True
    return bad, bonus, doubt, own_main


def text_length(node: Node) -> int:
    own = "".join(x if isinstance(x, str) else " " for x in node.children)
    return len(own) - own.count(" ") // 8 if own.strip() else 0


def points(own: str) -> float:
    """What a paragraph gives for its length and commas."""
    return 1 + own.count(",") + min(len(own) / 100, 3)


def doubts(root: Node) -> None:
    """Decides on elements with a doubtful name, the inner ones first: they are unwanted
    unless their paragraphs have many points and few links."""
    nodes: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack.extend(x for x in node.children if not isinstance(x, str) and not x.bad)
    sums: dict[int, tuple[float, int, int]] = {}
    for node in reversed(nodes):
        found, length, linked = 0.0, text_length(node), 0
        for x in node.children:
            if not isinstance(x, str) and not x.bad:
                more = sums.pop(id(x))
                found, length, linked = found + more[0], length + more[1], linked + more[2]
        if node.tag == "a":
            linked = length
        own = inline(node) if node.tag in PARAGRAPH and node.tag not in HEADINGS else ""
        if own.strip():
            found += points(own)
        if node.doubt and not (found >= OVERRULE_POINTS and linked < OVERRULE_DENSITY * length):
            node.bad = True
        else:
            sums[id(node)] = found, length, linked


def clean(text: str) -> str:
    return SPACE.sub(" ", html.unescape(text)).strip() if "&" in text else SPACE.sub(" ", text).strip()


def scored(root: Node) -> list[Node]:
    """All wanted elements in page order, with text lengths, link counts and points."""
    nodes: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack.extend(x for x in reversed(node.children) if not isinstance(x, str) and not x.bad)
    for node in reversed(nodes):
        node.length += text_length(node)
        if node.tag == "a":
            node.linked, node.links = node.length, node.links + 1
        if node.parent is not None:
            node.parent.length += node.length
            node.parent.linked += node.linked
            node.parent.links += node.links
    for node in nodes:
        if node.tag not in PARAGRAPH:
            continue
        own = inline(node)
        if not own.strip():
            continue
        given = points(own)
        # a container with text of its own holds that paragraph itself
        up, share = (node.parent if node.tag not in ("div", "section", "article", "main", "body") else node), 1.0
        level = 0
        while up is not None and level < 4:
            up.score += given * share
            level += 1
            share = 1 / (2 * level)
            up = up.parent
    for node in nodes:
        node.plain = node.score * (1 - density(node))
        node.score = (node.score + node.bonus * (node.score > 0)) * (1 - density(node))
    return nodes


def inline(node: Node) -> str:
    """The text of an element outside the blocks in it."""
    out, stack = [], list(reversed(node.children))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.bad and x.tag not in BLOCK:
            stack.extend(reversed(x.children))
    return "".join(out)


def home(node: Node) -> Node:
    """The article element, or else the main element, around the best container."""
    for tag in ("article", "main"):
        up = node
        while up is not None:
            if up.tag == tag:
                return up
            up = up.parent
    return node


def density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def is_menu(node: Node) -> bool:
    """A list or box made of links. What an article or main element holds is its own: lists
    of references are linked texts too."""
    return (node.tag in ("ul", "ol", "div", "section", "dl", "table") and not node.inside
            and node.links >= MENU_LINKS and density(node) > MENU_DENSITY)


def blocks(node: Node, out: list[list[str]]) -> None:
    """The texts of an element's blocks in page order; ``out[-1]`` is the open block."""
    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            out[-1].append(x)
        elif not x.bad and not is_menu(x):
            if x.tag in BLOCK or x.tag == "hr":
                out.append([])
                stack.append(None)
            stack.extend(reversed(x.children))


def main_text(source: str | None) -> str:
    """The main text of one page: its blocks, joined by one newline."""
    if not source:
        return ""
    root = parse(source)
    nodes = scored(root)
    best = max((x for x in nodes if x.score > 0 and not is_menu(x) and (x.tag in BLOCK or x is root)),
               key=lambda x: (x.score, -x.order), default=root)
    best = home(best)
    chosen = [best]
    if best.parent is not None and best.tag not in ("main", "body"):
        # an article element's points for being one say nothing of its siblings
        own = (lambda x: x.plain) if best.tag == "article" else (lambda x: x.score)
        least = max(10.0, SIBLING_SHARE * own(best)) if best.tag != "article" else SIBLING_SHARE * own(best)
        chosen = [x for x in best.parent.children if x is best or not isinstance(x, str) and not x.bad and not is_menu(x)
                  and density(x) < 0.25 and (own(x) >= least or x.tag in SIBLINGS and x.length)]
    out: list[list[str]] = [[]]
    for x in chosen:
        blocks(x, out)
        out.append([])
    return "\n".join(t for t in map(clean, map("".join, out)) if t)


def extract(df: DataFrame, source: str = "html", carry: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the main ``text`` of every page and its length in code points."""
    def make():
        def run(column: pa.Array) -> list[pa.Array]:
            texts = [main_text(x) for x in column.to_pylist()]
            return [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
        return run

    return map_text(df, source, FIELDS, make, carry)
