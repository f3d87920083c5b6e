"""Main text of web pages by tree scoring.

A tolerant scanner builds the tree of block elements. Each paragraph has points for its length and its commas and passes
them to its ancestors (whole to the parent, half to the grandparent, less further up). A container's score is
discounted by the share of its text that lies in links. The best container is kept, and siblings of it that score a fifth
of it or read like prose.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, strings

#: Fixed values of HTML: elements without content, elements whose content is not markup, elements that end a paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold the article.
NEVER = frozenset(
    "script style noscript template head nav footer aside form button select option textarea input iframe object svg canvas audio "
    "video menu dialog title label fieldset noembed noframes xmp".split()
)
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
SCOPE = frozenset("ul ol dl table body html article section div td th blockquote".split())
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|byline-share|comments?|comment-\w+|cookies?|consent|disqus|footer|gdpr|header|login|masthead"
    r"|menu|modal|nav\w*|newsletter|notices?|pager|pagination|popup|promo\w*|related|replies|respond|share|sharing|sidebar|sign-?up|social"
    r"|sponsor\w*|subscri\w+|tags|toolbar|widgets?)(?:$|[\s_-])",
    re.I,
)
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text)(?:$|[\s_-])", re.I)
#: What can begin markup, and a whole tag: only values of attributes are quoted, and a quote that is never closed is none.
START = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACES = re.compile(r"\s+")


#: Names that say that a wrapper has or lacks something beside its content, and those of reader comments.
ABOUT = re.compile(r"\b(?:no|has|with|without|hide|content)[-_](?:sidebar|header|footer|nav|menu|toolbar|tags|related)\b(?:[-_]wrap\w*)?", re.I)
REPLIES = re.compile(r"comment|disqus|repl(?:y|ies)|respond", re.I)
#: Elements deeper than this become siblings, as in browsers. Points reach this many ancestors.
DEPTH, LEVELS = 512, 8


class Node:
    __slots__ = ("tag", "parent", "children", "bad", "marked", "score", "text_chars", "link_chars", "block", "stop", "depth", "layout", "kept")

    def __init__(self, tag, parent, bad=False, marked=False, layout=False):
        self.tag, self.parent, self.bad, self.marked, self.layout, self.kept = tag, parent, bad, marked, layout, False
        self.children: list = []
        self.score, self.text_chars, self.link_chars = 0.0, 0, 0
        self.block = self if parent is None or tag in BLOCK else parent.block
        self.stop = self if parent is None or tag in SCOPE or tag in CLOSED_BY else parent.stop
        self.depth = parent.depth + 1 if parent is not None else 0


def _labels(attributes: str) -> tuple[str, bool]:
    """What class, id and role say, and whether the element is hidden."""
    words, hidden = [], False
    for m in ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "hidden":
            hidden = True
        elif m[1].lower() == "aria-hidden":
            hidden |= value.lower() == "true"
        else:
            words.append(value)
    return " ".join(words), hidden


def tree(html: str) -> Node:
    """The element tree. Children are nodes and texts; broken markup closes what it must. Time grows with the page's length.

    A tag that never ends takes the rest of the page with it. How many elements of a tag are open is counted, so that a
    search for one goes up only over elements that it closes.
    """
    root = Node("#root", None)
    node, at, size = root, 0, len(html)
    opened: dict[str, int] = {}

    def close(found, out):
        """Closes all open elements from ``found`` up to ``out``, which stays open."""
        while found is not out:
            opened[found.tag] -= 1
            found = found.parent
        return found

    while at < size:
        m = START.search(html, at)
        if not m:
            node.children.append(html[at:])
            break
        if m.start() > at:
            node.children.append(html[at : m.start()])
        if m[0] == "<!--":
            at = html.find("-->", m.end())
            at = at + 3 if at >= 0 else size
            continue
        if m[0] in ("<!", "<?"):
            at = html.find(">", m.end()) + 1 or size
            continue
        m = TAG.match(html, m.start())
        if not m:
            break
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if opened.get(tag):
                found = node
                while found.tag != tag:
                    found = found.parent
                node = close(node, found.parent)
            continue
        if tag in BLOCK and opened.get("p"):  # a block ends an open paragraph
            found = node.block
            while found.parent is not None and found.tag not in SCOPE and found.tag != "p":
                found = found.parent.block
            if found.tag == "p":
                node = close(node, found.parent)
        if tag in CLOSED_BY and any(opened.get(t) for t in CLOSED_BY[tag]):
            found = node.stop
            while found.parent is not None and found.tag not in SCOPE - {"td", "th"} and found.tag not in CLOSED_BY[tag]:
                found = found.parent.stop
            if found.tag in CLOSED_BY[tag]:
                node = close(node, found.parent)
        labels, hidden = _labels(m[3]) if m[3] else ("", False)
        article = tag in ("article", "main")
        marked = article or bool(labels and LIKELY.search(labels))
        layout = bool(labels and tag not in ("html", "body", "article", "main") and UNLIKELY.search(ABOUT.sub("", labels)))
        bad = hidden or tag in NEVER or (tag == "header" and not (opened.get("article") or opened.get("main")))
        fresh = Node(tag, node, bad or layout, marked, layout and not bad and not REPLIES.search(labels))
        if article:  # a wrapper that is named after what stands beside the article is no part of the furniture
            up = node
            while up is not None and up.layout:
                up.bad = up.layout = False
                up = up.parent
        node.children.append(fresh)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            at = html.find(">", end.start()) + 1 or size if end else size
        elif tag not in VOID and not m[3].rstrip().endswith("/") and fresh.depth < DEPTH:
            node = fresh
            opened[tag] = opened.get(tag, 0) + 1
    return root


def blocks(root: Node) -> list[tuple[Node, str, int]]:
    """(block element, its own text with white space turned into one space, characters of it in links), in page order."""
    found: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    owner, linked = root, 0

    def flush(to):
        nonlocal owner, linked
        text = SPACES.sub(" ", unescape("".join(parts))).strip()
        if text:
            found.append((owner, text, min(linked, len(text))))
        parts.clear()
        owner, linked = to, 0

    stack: list[tuple[Node, int, int]] = [(root, 0, 0)]
    while stack:
        node, i, links = stack.pop()
        if i == 0 and node.tag in BLOCK:
            flush(node)
        if i == len(node.children):
            if node.tag in BLOCK:
                flush(node.parent.block)
            continue
        stack.append((node, i + 1, links))
        child = node.children[i]
        if isinstance(child, str):
            parts.append(child)
            if links:
                linked += len(SPACES.sub(" ", unescape(child)).strip())
        elif child.tag == "br":
            parts.append(" ")
        elif not child.bad:
            stack.append((child, 0, links + (child.tag == "a")))
        elif child.tag in BLOCK:
            flush(owner)
    flush(root)
    return found


def extract(html: str) -> str:
    """The article's blocks in page order, joined by newlines; empty if the page has no text."""
    root = tree(html)
    found = blocks(root)
    if not found:
        return ""
    for node, text, links in found:
        node.text_chars += len(text)
        node.link_chars += links
        points = 1 + len(text) / 100 + sum(map(text.count, ",，、;")) if len(text) >= 25 or node.tag == "p" else 0.2
        points *= 1 - links / max(1, len(text))
        share, up = 1.0, node.parent if node.tag not in ("body", "article", "main", "section", "div", "td") else node
        for depth in range(1, LEVELS + 1):
            if up is None:
                break
            up.score += points * share
            share = 1 / (2 * depth)
            up = up.parent
    every = [root]
    for node in every:  # parents first
        every += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(every):
        if node.parent is not None:
            node.parent.text_chars += node.text_chars
            node.parent.link_chars += node.link_chars

    def worth(node):
        return node.score * (1 - node.link_chars / max(1, node.text_chars)) * (1.25 if node.marked else 1)

    scored = [n for n in every[1:] if n.text_chars]
    scored = [n for n in scored if n.tag not in ("html", "p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "span", "b", "i", "em", "strong", "a")]
    if not scored:
        return "\n".join(text for _, text, _ in found)
    best = max(scored, key=worth)
    kept = {best}
    up = best
    while up.parent is not None and up.parent.tag in ("article", "main"):  # a section of an article stands for all of it
        up = up.parent
        kept = {up}
    best = up
    floor = 0.2 * worth(best)
    for sibling in best.parent.children if best.parent is not None else ():
        if isinstance(sibling, Node) and not sibling.bad and sibling is not best and sibling.text_chars:
            density = sibling.link_chars / sibling.text_chars
            if worth(sibling) >= floor or (sibling.tag in ("p", "div", "section") and sibling.text_chars > 80 and density < 0.25 and sibling.score >= 2) or sibling.tag == "h1":
                kept.add(sibling)

    for node in every:
        node.kept = node in kept or (node.parent is not None and node.parent.kept)
    return "\n".join(text for node, text, _ in found if node.kept)


def extract_pages(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page; a null or empty page has an empty text. Nothing is cut or capped.

    Broken, deep and very long pages take time in proportion to their length. Repeated rows and null keys stay, other
    columns are ignored. Of equally good containers the first is the best.
    """

    def run(batches):
        for part in chunks(batches):
            texts = [extract(h) for h in strings(part.column(2))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["key", "url", "text", "n_chars"],
            )

    source = df.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, url string, text string, n_chars long").withColumnsRenamed({"key": key, "url": url})
