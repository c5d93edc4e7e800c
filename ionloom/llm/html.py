"""Main text of web pages by tree scoring.

A page becomes a tree; elements that never hold article text (scripts, menus, footers and the like) are passed over. Each
paragraph earns points for its length and its commas and passes them to its ancestors, less the further up; a container's
points are discounted by the share of its text that stands in links. Elements that by role or name read like a sidebar, a
notice, an advert, a form or comments count for a fiftieth, with all that they hold. A name only lowers points: where all of a page
stands in such an element, nothing changes between its parts. The best container is the article, together with those of its
siblings that read like a part of it; what is inside it under such a name goes, unless it holds most of the points there.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, table

#: Elements whose content isn't markup; all of it is passed over but for textarea's and title's, which aren't article text either.
_RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never article text.
_DROPPED = frozenset("head nav footer aside noscript template svg math canvas object audio video button select option datalist dialog menu menuitem map".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Start tags that end an open element: which, and what bounds the search for it.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_PARAGRAPHS = frozenset("p pre blockquote td li dd".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Parts of class names and ids that mark what isn't the article.
_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion promoted cookie cookies
    consent gdpr notice notices newsletter subscribe subscription signup signin login sidebar sidebars nav navbar navigation menu menus
    breadcrumb breadcrumbs footer header masthead share sharing social related recommended recommendations comment comments commentlist
    disqus respond reply replies popup modal overlay widget widgets toolbar pagination pager skip toc""".split()
)
#: Of these, names of lists of links, and of what readers write.
_LISTS = frozenset("nav navbar navigation menu menus breadcrumb breadcrumbs toc pagination pager skip share sharing social related recommended recommendations sidebar sidebars".split())
_TALK = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Letters from which on a paragraph without links is prose, whatever list of links its name promises.
PROSE = 60
#: First parts of names that say what a page has, or has not, and not what an element is; parts of names of an article's own header.
_ABOUT, _OWN = frozenset("has no with without not hide show".split()), frozenset("article post entry content story main title".split())
#: What an element counts for under such a name, and the share of the article's points from which it stays all the same.
DISCOUNT, MOST = 0.02, 0.5
_SPLIT_NAMES = re.compile(r"[^a-z]+")
_NAME_EDGES = re.compile(r"([a-z])([A-Z])")
_TAG = re.compile(r"<(?:!--(?P<comment>)|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<loose>/?[a-zA-Z][^>]*>)|[!?/][^>]*>)")
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


class Node:
    """An element: points, as passed on to it; mass, the points of all paragraphs below; size and linked, letters in it and in its links.

    names: the parts of its class and id by which it is doubtful, if nothing else makes it so; talk: whether it is in what readers write.
    """

    __slots__ = ("tag", "parent", "parts", "points", "mass", "dropped", "doubtful", "names", "talk", "weight", "size", "linked")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, doubtful: bool = False, names: frozenset[str] = frozenset()):
        self.tag, self.parent, self.parts, self.dropped, self.doubtful, self.names = tag, parent, [], dropped, doubtful, names
        self.talk = parent is not None and parent.talk or not names.isdisjoint(_TALK)
        self.points = self.mass = self.size = self.linked = 0.0
        self.weight = (parent.weight if parent else 1.0) * (DISCOUNT if doubtful else 1.0)


def _telling(name: str) -> frozenset[str]:
    """The parts of a class name or id that mark what isn't the article."""
    parts = [x for x in _SPLIT_NAMES.split(_NAME_EDGES.sub(r"\1 \2", name).lower()) if x]
    if not parts or parts[0] in _ABOUT:
        return frozenset()
    found = _NAMES.intersection(parts)
    return frozenset() if found <= {"header"} and not _OWN.isdisjoint(parts) else found


def _judged(tag: str, attrs: str) -> tuple[bool, bool, frozenset[str]]:
    """Whether an element can't hold article text, whether it looks as if it didn't, and the names by which it does."""
    nothing: frozenset[str] = frozenset()
    if tag in _DROPPED:
        return True, False, nothing
    doubtful, names = tag in ("form", "header"), nothing
    if not attrs.strip() or tag in ("html", "body"):
        return False, doubtful, names
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id"):
            names = names.union(*map(_telling, value.split()))
        elif key == "role":
            doubtful |= value.lower() in _ROLES
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            return True, False, nothing
    return False, doubtful or bool(names), names


def parsed(page: str) -> Node:
    """The tree of a page; parts of a node are texts, character references decoded, and nodes, in order."""
    root = Node("#page", None)
    at, here, n, last_end = 0, root, len(page), page.rfind(">")
    opened: Counter[str] = Counter()  # open elements by tag, so that no search starts in vain

    def up_to(node: Node) -> Node:
        """Closes all open elements down to this one, and it too."""
        inner = here
        while inner is not node.parent:
            opened[inner.tag] -= 1
            inner = inner.parent
        return inner

    while at < n:
        open_at = page.find("<", at)
        if open_at < 0 or open_at > last_end:
            open_at = n
        if open_at > at and not here.dropped:
            here.parts.append(html.unescape(page[at:open_at]))
        if open_at == n:
            break
        m = _TAG.match(page, open_at)
        if m is None:
            if not here.dropped:
                here.parts.append("<")
            at = open_at + 1
            continue
        at = m.end()
        if m["comment"] is not None:
            closing = page.find("-->", at)
            at = n if closing < 0 else closing + 3
            continue
        if m["loose"]:
            inner = re.match(r"(/?)([a-zA-Z][^\s/>]*)", m["loose"])
            end, tag, attrs = bool(inner[1]), inner[2].lower(), ""
        elif m["name"]:
            end, tag, attrs = bool(m["end"]), m["name"].lower(), m["attrs"]
        else:
            continue
        if end:
            if opened[tag] > 0:
                node = here
                while node.tag != tag:
                    node = node.parent
                here = up_to(node)
            elif tag == "p" and not here.dropped:
                here.parts.append(Node("br", here))
            continue
        if tag in _VOID:
            if not here.dropped and tag not in _INLINE:
                here.parts.append(Node(tag, here))
            continue
        if tag in _RAW:
            closing = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(page, at)
            at = closing.end() if closing else n
            continue
        if tag not in _INLINE:
            ends, bounds = _ENDS.get(tag, ({"p"}, {"td", "th", "button", "object", "table"}))
            node = here
            while any(opened[t] > 0 for t in ends) and node.parent is not None and node.tag not in bounds:
                if node.tag in ends:
                    here = up_to(node)
                    if tag in _ENDS and node.tag == "tr" or tag not in _ENDS:
                        break
                node = node.parent
        node = Node(tag, here, *((True, False) if here.dropped else _judged(tag, attrs)))
        if not node.dropped:
            here.parts.append(node)
        opened[tag] += 1
        here = node
    return root


def _measured(root: Node) -> list[Node]:
    """All nodes, each after its descendants; sets size (letters but for white space) and linked (those in links)."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [p for p in node.parts if isinstance(p, Node)]
    order.reverse()
    for node in order:
        for p in node.parts:
            if isinstance(p, Node):
                share = DISCOUNT if p.doubtful else 1.0
                node.size += share * p.size
                node.linked += share * p.linked
            else:
                node.size += sum(map(len, p.split()))
        if node.tag == "a":
            node.linked = node.size
    return order


def _has_heading(node: Node, also: frozenset[str] = frozenset()) -> bool:
    todo = [node]
    while todo:
        p = todo.pop()
        if p.tag in _HEADINGS or p.tag in also:
            return True
        todo += [x for x in p.parts if isinstance(x, Node)]
    return False


def _stays(node: Node, best: Node) -> bool:
    """Whether a doubtful element inside the article is a part of it: most of it, its own header, or prose under the name of a list of links."""
    if node.mass >= MOST * best.mass > 0:
        return True
    if node.tag in ("p", "blockquote") and node.names and node.names <= _LISTS:
        return node.size >= PROSE and node.linked <= 0.25 * node.size
    return _own_header(node, best)


def _own_header(node: Node, of: Node) -> bool:
    return node.tag == "header" and of.tag not in ("body", "html", "#page") and _has_heading(node) and node.linked <= 0.5 * node.size


def text_of(node: Node, out: list[str], best: Node) -> None:
    """Appends the texts below a node, with spaces where blocks begin and end; doubtful elements only if they stay."""
    todo: list[Node | str] = [node]
    while todo:
        p = todo.pop()
        if isinstance(p, str):
            out.append(p)
        elif p.doubtful and p is not best and not _stays(p, best):
            out.append(" ")
        elif p.tag in _INLINE:
            todo += reversed(p.parts)
        else:
            out.append(" ")
            todo.append(" ")
            todo += reversed(p.parts)


def _own_text(node: Node) -> str:
    """The text of a paragraph that isn't in a block below it."""
    out: list[str] = []
    todo: list[Node | str] = list(reversed(node.parts))
    while todo:
        p = todo.pop()
        if isinstance(p, str):
            out.append(p)
        elif p.tag in _INLINE or p.tag == "br":
            out.append(" " if p.tag == "br" else "")
            todo += reversed(p.parts)
    return " ".join("".join(out).split())


def _value(node: Node) -> float:
    """A container's points, discounted by its link density."""
    return node.points * (1 - node.linked / node.size) if node.size else 0.0


def main_text(page: str | None) -> str:
    """The article's text: blocks in page order, white space within and between them one space; empty if there is none."""
    root = parsed(page or "")
    order = _measured(root)
    # What readers write is the article only where no undoubted element has a paragraph.
    apart = any(n.tag in _PARAGRAPHS and n.weight == 1 and len(_own_text(n)) >= 25 and n.linked <= 0.25 * n.size for n in order)
    for node in order:
        if apart and node.talk:
            continue
        if node.tag in _PARAGRAPHS or node.tag in ("div", "section", "article", "main", "body", "#page") and any(isinstance(p, str) and not p.isspace() for p in node.parts):
            words = _own_text(node)
            if not words or node.size and node.linked > 0.9 * node.size:
                continue
            points = (1 if len(words) >= 25 else 0.05) + words.count(",") * 0.5 + min(len(words) / 100, 3)
            points *= node.weight
            node.mass += points
            up, level = (node.parent if node.tag in _PARAGRAPHS and node.parent else node), 0
            while up is not None and level < 4:
                up.points += points / (1, 2, 6, 12)[level]
                up, level = up.parent, level + 1
    for node in order:  # each after what it holds
        if node.parent is not None:
            node.parent.mass += node.mass
    best = max((n for n in reversed(order) if n.tag not in _INLINE and n.points > 0), key=_value, default=None)
    if best is None:
        return ""
    out: list[str] = []
    if best.parent is None:
        text_of(best, out, best)
    else:
        enough = max(3.0, 0.2 * _value(best))
        for p in best.parent.parts:
            if p is best or isinstance(p, Node) and _reads_on(p, best, enough):
                text_of(p, out, best)
    return " ".join("".join(out).split())


def _reads_on(node: Node, best: Node, enough: float) -> bool:
    """Whether a sibling of the best container reads like a part of the article."""
    density = node.linked / node.size if node.size else 1.0
    if node.doubtful:
        return _value(node) >= enough and density < 0.3 or best.tag != "article" and _own_header(node, best.parent)
    if node.tag in _HEADINGS:
        return best.tag != "article" and density < 0.5
    if node.tag in _PARAGRAPHS:
        return density < 0.25 and node.size > 0
    if density >= 0.3:
        return False
    # Beside a section or a division of an article its other sections stand, however short.
    inside = best.tag != "article" and best.parent.tag not in ("body", "html", "#page")
    return _value(node) >= enough or inside and node.size > 0 and _has_heading(node, _PARAGRAPHS)


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points of text).

    Null and empty pages, and pages without any text outside what is left out, give the empty text. Unclosed or crossed
    elements, comments and quotes are taken as browsers would, roughly; nothing is cut off. Repeated rows give equal texts;
    other columns are ignored; an empty table gives no rows. Narrow: no shuffle.
    """
    head = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(source).cast("string").alias("html"))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = [head.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return head.mapInArrow(extracted, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def op8_main_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
