"""Main text of web pages by scoring the tree of elements.

Paragraphs pass points for their length and commas to their ancestors, less to
those further up; a container's points are discounted by its link density. The
best container and those siblings that look like more of the same are kept.
What a page marks as menu, header, footer, advert or comments by its element,
its role or a whole name is taken out before. Single words of a class or id, and
forms, halve the points of their text; such an element is taken out if it has
little text beside the rest of the page. Inside an article only whole names of
blocks that are added to articles (share buttons, newsletter forms, lists of
related posts, notices, promotions) raise that doubt, and never on headings or
paragraphs. Every page is one row, so the work is spread by Spark and needs no
shuffle; parsing takes one pass over the page.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from citemill.llm.batches import text_column

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
DROPPED = frozenset(
    "head script style textarea title iframe noembed noframes noscript template nav footer aside button select option "
    "object svg canvas audio video dialog menu datalist".split()
)
# Words of a class or id that may name what is no article.
UNWANTED = frozenset(
    "ad ads advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies "
    "complementary copyright dialog discussion disqus footer gdpr hidden login masthead menu menubar modal nav navbar navigation "
    "header newsletter notice notices notification overlay pager pagination popup promo promotion recommended related replies reply "
    "respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
# Roles that say as much as an element does.
ROLES = frozenset("alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WANTED = frozenset("article body content entry main post story text".split())
ARTICLES = ("article", "main")
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
# Blocks whose points go to the element around them.
PARAGRAPHS = frozenset("p pre h1 h2 h3 h4 h5 h6 li td blockquote".split())
BASE_POINTS = {
    "article": 25, "main": 25, "section": 5, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3,
    "dl": -3, "dd": -3, "dt": -3, "li": -3, "th": -5,
}
DOUBT, LOW_SHARE = 0.5, 0.5
LEAST_PARAGRAPH, LEAST_SIBLING, SIBLING_SHARE = 25, 10.0, 0.2

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_REST = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_TOKENS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
# Whole names of comments and adverts; comments-open or has-ads are none.
_COMMENTS = re.compile(
    r"(?:(?:user|post|blog|page|article|fb|facebook|readers?|visitors?|guests?|members?|viewers?|customers?|community|public|latest|recent|all)-)?"
    r"comments?(?:-?(?:list|area|section|form|thread|feed|wrap|wrapper|container|inner|panel|box|block))?"
    r"|disqus(?:-thread)?"
)
# Whole names of blocks that are put into articles; of an id only those of two words or more, as an id may name a chapter.
_ADDED = re.compile(
    r"(?:(?:social|post|article|entry|page|story)-)?(?:share|sharing)(?:-(?:this|buttons?|bar|links?|icons?|tools?|widget|list|box|block|container))?"
    r"|social-(?:media|links?|buttons?|icons?|bar|list|follow)(?:-[a-z]+)?|sharedaddy"
    r"|(?:email-|inline-|article-|post-)?(?:newsletter|sign-?up|subscribe|subscription)"
    r"(?:-(?:sign-?up|form|box|bar|block|banner|cta|widget|promo|prompt|container|subscribe|section))*"
    r"|(?:post-|article-)?(?:related|recommended|recommendations|suggested|further|trending|popular|more)"
    r"-(?:posts?|articles?|content|links?|stories|news|items|topics|entries|reading|videos?|products?|pages?)(?:-[a-z]+)?"
    r"|related|recommended|recommendations|(?:you-(?:may|might)-(?:also-)?like|read-(?:more|next|also)|see-also|also-read|up-next)(?:-[a-z]+)?"
    r"|(?:cookies?|consent|gdpr|privacy|site|legal)-(?:notices?|banner|consent|bar|popup|message|law|info|box|overlay|dialog)(?:-[a-z]+)?|gdpr"
    r"|(?:in-?line-|article-|post-)?(?:promo|promotion)s?(?:-(?:box|banner|block|bar|unit|content|text|card|container|widget))?"
    r"|(?:[a-z]+-)?banner(?:-(?:box|block|bar|unit|content|container|wrap|wrapper))?"
    r"|(?:notices?|notifications?|pop-?up|modal|overlay|paywall|toolbar|pagination|pager|breadcrumbs?|side-?bar|widget)"
    r"(?:-(?:box|banner|bar|block|area|content|container|wrap|wrapper|links?))?"
    r"|respond|(?:leave-a?-?|comment-|post-)?(?:reply|respond)(?:-(?:form|box|area|title))?"
)
_ALONE = frozenset(("respond",))
_ADVERTS = re.compile(
    r"(?:(?:google|banner|top|side|inline|text)-)?(?:ads?|adverts?|advertisements?|advertising|adsense|adsbygoogle|sponsored)"
    r"(?:-(?:slot|unit|box|banner|container|wrap|wrapper|block|label|content|[0-9]+))?"
)
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True, eq=False)
class Node:
    tag: str
    parent: Node | None
    dropped: bool = False
    doubted: bool = False
    unsure: bool = False  # doubted, or in an element that is
    wanted: bool = False
    kind: str = ""
    children: list[Node] = field(default_factory=list)
    points: float = 0.0
    chars: int = 0
    link_chars: int = 0
    links: int = 0
    scored: bool = False
    inside: Node | None = None  # the innermost article around, itself included
    in_article: bool = False  # in an article element, itself included


@dataclass(slots=True, eq=False)
class Block:
    owner: Node
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    text: str = ""


def _names(value: str) -> set[str]:
    return set(_TOKENS.findall(_CAMEL.sub(" ", value).lower()))


def _whole_names(given: dict[str, str]) -> list[str]:
    """The names of a class and the id, in lower case with hyphens between their words."""
    return [_CAMEL.sub("-", n).lower().replace("_", "-") for n in f"{given.get('class', '')} {given.get('id', '')}".split()]


def _is_added(given: dict[str, str]) -> bool:
    by_class, by_id = (_whole_names({name: given.get(name, "")}) for name in ("class", "id"))
    return any(map(_ADDED.fullmatch, [*by_class, *(n for n in by_id if "-" in n or n in _ALONE)]))


def _attributes(rest: str) -> dict[str, str]:
    return {
        name.lower(): entities.unescape(value[1:-1] if value[:1] in "\"'" else value) for name, value in _ATTRIBUTE.findall(rest)
    }


def _describe(node: Node, rest: str) -> None:
    """Sets whether the element is dropped, doubted or wanted by its name and attributes."""
    tag = node.tag
    node.in_article = tag == "article" or node.parent is not None and node.parent.in_article
    node.doubted = tag == "form"
    node.inside = node if tag in ARTICLES else node.parent.inside if node.parent else None
    node.dropped = tag in DROPPED or tag == "header" and node.inside is None
    if not rest.strip(" \t\r\n/") or tag in ("html", "body"):
        return
    given = _attributes(rest)
    names = _names(f"{given.get('class', '')} {given.get('id', '')} {given.get('role', '')}")
    node.kind = given.get("class", "")
    node.wanted = bool(names & WANTED)
    if tag not in ARTICLES and tag not in HEADINGS:
        whole = _whole_names(given)
        if any(map(_COMMENTS.fullmatch, whole)) or any(map(_ADVERTS.fullmatch, whole)) or _names(given.get("role", "")) & ROLES:
            node.dropped = True
        elif tag in PARAGRAPHS and node.inside is not None:
            pass
        elif node.in_article:
            node.doubted |= _is_added(given)
        elif names & UNWANTED or _is_added(given):
            node.doubted = True
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or _HIDING.search(given.get("style", "")):
        node.dropped = True


class Page:
    """The tree of one page and its blocks of text in order."""

    def __init__(self, html: str):
        self.root = Node("#root", None)
        self.nodes: list[Node] = [self.root]
        self.blocks: list[Block] = []
        self.stack: list[Node] = [self.root]
        self.open: dict[str, list[int]] = {}  # places in the stack of the open elements of each tag
        self.owners: list[Node] = [self.root]  # the open blocks
        self.current: Block | None = None
        self.link = 0
        self._read(html)
        for block in self.blocks:
            block.text = " ".join("".join(block.parts).split())
        self.blocks = [b for b in self.blocks if b.text]

    def _text(self, text: str) -> None:
        if not text:
            return
        if self.current is None:
            self.current = Block(self.owners[-1])
            self.blocks.append(self.current)
        text = entities.unescape(text)
        self.current.parts.append(text)
        if self.link:
            self.current.link_chars += len("".join(text.split()))

    def _pop(self) -> None:
        node = self.stack.pop()
        self.open[node.tag].pop()
        if node.tag in BLOCKS:
            self.owners.pop()
            self.current = None
        if node.tag == "a":
            self.link -= 1

    def _close(self, tags: set[str], scopes: tuple[str, ...] = ()) -> None:
        """Closes the innermost open element of ``tags`` and all inside it, if it is not outside of ``scopes``."""
        place = self._place(tags)
        if place and place > self._place(scopes):
            while len(self.stack) > place:
                self._pop()

    def _place(self, tags) -> int:
        """Place in the stack of the innermost open element of ``tags``, 0 if there is none."""
        return max((places[-1] for t in tags if (places := self.open.get(t))), default=0)

    def _start(self, tag: str, rest: str) -> None:
        if tag in BLOCKS:
            self._close({"p"}, ("td", "th", "button", "object", "table"))
            self.current = None
        if tag in CLOSED_BY:
            self._close(CLOSED_BY[tag], SCOPES.get(tag, ("table",)))
        if tag == "a":
            self._close({"a"}, ("td", "th", "table"))
        if tag in ("br", "hr", "img", "wbr"):
            if tag == "br":
                self._text(" ")
            return
        if tag in VOID:
            return
        node = Node(tag, self.stack[-1])
        _describe(node, rest)
        node.parent.children.append(node)
        self.nodes.append(node)
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(node)
        if tag in BLOCKS:
            self.owners.append(node)
        if tag == "a":
            self.link += 1
            node.parent.links += 1

    def _read(self, html: str) -> None:
        at, quoted, size = 0, True, len(html)
        while at < size:
            lt = html.find("<", at)
            if lt < 0:
                self._text(html[at:])
                return
            self._text(html[at:lt])
            following = html[lt + 1 : lt + 2]
            if following == "!" or following == "?":
                if html.startswith("<!--", lt):
                    end = html.find("-->", lt + 4)
                    at = size if end < 0 else end + 3
                else:
                    end = html.find(">", lt)
                    at = size if end < 0 else end + 1
                continue
            closing = following == "/"
            match = _NAME.match(html, lt + 1 + closing)
            if not match:
                # A sign by itself is text; an end tag without a name is nothing.
                if closing:
                    end = html.find(">", lt)
                    at = size if end < 0 else end + 1
                else:
                    self._text("<")
                    at = lt + 1
                continue
            rest = _REST.match(html, match.end()) if quoted else None
            if rest:
                end = rest.end()
            else:
                quoted = False  # a quote is never closed: from here on, tags end at the next sign
                end = html.find(">", match.end()) + 1 or size
            tag, inner = match[0].lower(), html[match.end() : end - 1]
            at = end
            if closing:
                if self.open.get(tag):
                    self._close({tag})
                elif tag == "p":
                    self.current = None
                continue
            self._start(tag, inner)
            if tag in RAW:
                stop = _RAW_END[tag].search(html, at)
                at = stop.start() if stop else size
                if not stop:
                    return


def _inside(nodes: list[Node], chosen: set[int]) -> set[int]:
    """The chosen nodes and all below them; parents come before their children in ``nodes``."""
    out: set[int] = set()
    for node in nodes:
        if id(node) in chosen or id(node.parent) in out:
            out.add(id(node))
    return out


def _spread(nodes: list[Node]) -> None:
    """Passes drops and doubts on to all below; parents come before their children in ``nodes``."""
    for node in nodes[1:]:
        node.dropped |= node.parent.dropped
        node.unsure = node.doubted or node.parent.unsure


def _value(node: Node) -> float:
    return node.points * (1 - min(1.0, node.link_chars / node.chars)) if node.chars else 0.0


def _score(page: Page, blocks: list[Block]) -> None:
    """Sets points and characters of all elements from the blocks."""
    for node in page.nodes:
        node.points, node.chars, node.link_chars, node.scored = 0.0, 0, 0, False
    for block in blocks:
        size, owner = len(block.text), block.owner
        owner.chars += size
        owner.link_chars += min(block.link_chars, size)
        if size >= LEAST_PARAGRAPH:
            points = (1 + block.text.count(",") + min(size / 100, 3)) * (1 - min(1.0, block.link_chars / size))
            if owner.unsure:
                points *= DOUBT
            to = owner.parent if owner.tag in PARAGRAPHS and owner.parent is not None else owner
            to.points += points
            to.scored = True
    # From the leaves up: a parent gets half of its children's points, and all their characters.
    for node in reversed(page.nodes[1:]):
        node.parent.chars += node.chars
        node.parent.link_chars += node.link_chars
        node.parent.points += node.points / 2
        node.parent.scored |= node.scored
    for node in page.nodes:
        node.scored &= node.tag not in ("html", "#root")
        if node.scored:
            base = BASE_POINTS.get(node.tag, 0) + (25 if node.wanted else 0)
            node.points += base * DOUBT if node.unsure and base > 0 else base


def _best(page: Page) -> Node:
    """The container of the main text: the one with the most points, or the article it is in."""
    candidates = [n for n in page.nodes if n.scored and not n.dropped]
    best = max(candidates, key=_value, default=None)
    articles = [n for n in page.nodes if n.tag in ARTICLES and n.chars and not n.dropped and (not n.unsure or best is None or best.unsure)]
    if best is not None and best.inside is not None and not best.inside.dropped:
        best = best.inside
    elif articles:
        around = _inside(page.nodes, {id(best)}) if best is not None and best.tag != "body" else set()
        if not any(id(a) in around for a in articles):
            best = max(articles, key=lambda n: n.chars)
    if best is None:
        best = page.root
    return best


def _drop_doubted(page: Page, best: Node) -> bool:
    """Drops doubted elements with little text, links aside, beside the rest; those around ``best`` are no longer doubted."""
    above: Node | None = best
    while above is not None:
        above.doubted = False
        above = above.parent
    _spread(page.nodes)
    left = [n for n in page.nodes if n.doubted and not n.dropped and n.chars]
    outer = [n.chars - n.link_chars for n in left if not n.parent.unsure]
    # Where nearly all is doubted, the largest of it is what the others are held against.
    rest = max([page.root.chars - page.root.link_chars - sum(outer), *outer])
    low = [n for n in left if n.chars - n.link_chars < LOW_SHARE * rest]
    for node in low:
        node.dropped = True
    _spread(page.nodes)
    return bool(low)


def main_text(html: str | None) -> str:
    """The article of a page, a line for each block; empty if it has none."""
    if not html:
        return ""
    page = Page(html)
    # A wrapper that is unwanted by its class alone but holds the page's title or main part stays.
    seen: set[int] = set()
    for node in page.nodes:
        if node.tag in ("h1", "main") and not node.dropped:
            above = node.parent
            while above is not None and id(above) not in seen and above.tag not in DROPPED and above.tag != "header":
                seen.add(id(above))
                if above.tag in ("div", "section", "table", "td", "tr", "tbody") and not any(
                    map(_COMMENTS.fullmatch, _whole_names({"class": above.kind}))
                ):
                    above.dropped = False
                above = above.parent
    _spread(page.nodes)
    blocks = [b for b in page.blocks if not b.owner.dropped]
    if not blocks:
        return ""
    _score(page, blocks)
    best = _best(page)
    if any(n.doubted for n in page.nodes) and _drop_doubted(page, best):
        blocks = [b for b in blocks if not b.owner.dropped]
        _score(page, blocks)
        best = _best(page)
    # What may be menus that nothing marks: several short links and hardly other text.
    menus = set()
    for node in page.nodes:
        if node.tag in ("ul", "ol", "div", "table", "section", "dl") and not node.dropped and node.chars:
            links = node.links + sum(c.links for c in node.children)
            if links >= 3 and node.link_chars > 0.6 * node.chars and node.link_chars < 40 * links:
                menus.add(id(node))

    chosen = {id(best)}
    if best.parent is not None and best.tag not in ("html", "body", "#root"):
        limit = max(LEAST_SIBLING, SIBLING_SHARE * _value(best))
        for node in best.parent.children:
            if node.dropped or not node.chars or id(node) in menus:
                continue
            density = node.link_chars / node.chars
            alike = node.tag == best.tag and node.kind == best.kind or best.tag not in ARTICLES
            if alike and node.scored and _value(node) + (0.2 * _value(best) if node.kind and node.kind == best.kind else 0) >= limit:
                chosen.add(id(node))
            elif best.tag not in ARTICLES and node.tag in ("p", "h1", "h2", "h3", "pre", "blockquote") and density < 0.25:
                chosen.add(id(node))
    kept = _inside(page.nodes, chosen)
    around: Node | None = best
    while around is not None:
        menus.discard(id(around))
        around = around.parent
    # An article's lists of links are its own, as are those between paragraphs of another container.
    articles = _inside(page.nodes, {id(n) for n in page.nodes if n.tag in ARTICLES and id(n) in kept})
    gone = _inside(page.nodes, menus) - articles
    blocks = [b for b in blocks if id(b.owner) in kept]
    told = [
        k for k, b in enumerate(blocks)
        if id(b.owner) not in gone and b.owner.tag not in HEADINGS and len(b.text) >= LEAST_PARAGRAPH and 2 * b.link_chars < len(b.text)
    ]
    first, last = (told[0], told[-1]) if told and best.tag not in ("html", "body", "#root") else (0, 0)
    return "\n".join(b.text for k, b in enumerate(blocks) if id(b.owner) not in gone or first < k < last)


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html; other columns are not read).

    Null or empty html gives an empty text. White space inside a block is one space, a line break within a block too.
    """
    text = text_column(lambda hs: [main_text(h) for h in hs], StringType(), "html")
    return pages.select("page_id", "url", text.alias("text")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )
