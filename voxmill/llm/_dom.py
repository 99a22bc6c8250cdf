"""Raw HTML to nodes in page order, and the numbers that describe each node."""

from __future__ import annotations

import functools
import html
import re
from dataclasses import dataclass, field

import numpy as np

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.DOTALL)
_CUT_OFF = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
_RAW = frozenset("script style title textarea noscript iframe noembed noframes template xmp svg math object".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul br button select".split()
)
_ENDS_P = _BLOCK - frozenset("br button select option optgroup body head html caption tbody td tfoot th thead tr legend".split())
#: What an opening tag closes, and what that search does not leave.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

ROLES = {
    "content": "content article post entry story body text main blog news prose markdown",
    "nav": "nav menu navigation navbar breadcrumb pagination pager tab toc link sitemap",
    "header": "header masthead top topbar head logo brand branding",
    "footer": "footer bottom colophon copyright legal contentinfo",
    "side": "sidebar side aside rail widget related recommended recommend popular trending more complementary",
    "ad": "ad advert advertisement adv adsense banner sponsor sponsored promo promotion promoted commercial",
    "notice": "cookie consent gdpr notice alert alertdialog popup modal overlay dialog warning message toast paywall",
    "form": "form search subscribe newsletter signup login register contact input",
    "comment": "comment reply replies discussion respond response feedback thread review",
    "share": "share sharing social tag meta byline author date follow",
    "hidden": "hidden invisible",
}
_ROLE_OF = {word: 1 << k for k, words in enumerate(ROLES.values()) for word in words.split()}
_LONG = tuple(w for w in _ROLE_OF if len(w) >= 5)
_TAG_ROLE = {"article": "content", "main": "content", "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "side", "form": "form", "button": "form", "select": "form", "label": "form", "fieldset": "form", "dialog": "notice"}
_NAMES = tuple(ROLES)
GROUPS = ("#text", "p", "h1 h2 h3 h4 h5 h6", "a", "li", "ul ol dl menu", "table tbody thead tr td th caption", "div", "section", "article main", "nav", "header footer", "aside", "form fieldset label button select option legend", "blockquote pre code", "figure figcaption", "span b i em strong small ins")
_GROUP_OF = {tag: k for k, tags in enumerate(GROUPS) for tag in tags.split()}
_MARKS = ".,;:!?"


@functools.lru_cache(maxsize=1 << 14)
def _roles(attributes: str) -> int:
    """What the names in class, id, role and the like say a node is for, as bits by ROLES."""
    bits = 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            bits |= _ROLE_OF["hidden"]
        elif name in ("class", "id", "role", "itemprop", "aria-label", "data-role", "data-component"):
            for token in _TOKEN.findall(value):
                token = token.lower()
                one = token.removesuffix("s")
                found = _ROLE_OF.get(token) or _ROLE_OF.get(one)
                bits |= found or functools.reduce(int.__or__, (_ROLE_OF[w] for w in _LONG if token.startswith(w) or token.endswith(w)), 0)
    return bits


@dataclass
class Nodes:
    """Nodes of one page or many in page order: a node comes before what is in it."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    roles: list[int] = field(default_factory=list)
    above: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    linked: list[bool] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    #: Whether white space or the edge of a block comes before a text.  Texts that only plain formatting parts are one.
    apart: list[bool] = field(default_factory=list)
    roots: list[int] = field(default_factory=list)

    def add(self, tag: str, parent: int, roles: int, text: str = "", apart: bool = False) -> int:
        at = len(self.tag)
        self.tag.append(tag)
        self.parent.append(parent)
        self.end.append(at + 1)
        self.roles.append(roles)
        self.above.append(self.roles[parent] | self.above[parent] if parent >= 0 else 0)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.linked.append(parent >= 0 and (tag == "a" or self.linked[parent]))
        self.text.append(text)
        self.apart.append(apart)
        return at

    def parse(self, source: str) -> None:
        """Adds a page.  Tags may be left open or closed in the wrong order, and the page may end anywhere."""
        root = self.add("#root", -1, 0)
        self.roots.append(root)
        # Tags that are open, with their nodes; formatting without a name that tells has none of its own.
        stack = [("#root", root)]
        at, broken, spaced = 0, True, False

        def leave(to: int) -> None:
            """Ends all open tags from place `to` of the stack on."""
            for k in range(to, len(stack)):
                if k == 0 or stack[k][1] != stack[k - 1][1]:
                    self.end[stack[k][1]] = len(self.tag)
            del stack[to:]

        def close(names: set[str] | frozenset[str], bounds: set[str] | frozenset[str]) -> None:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in names:
                    return leave(k)
                if stack[k][0] in bounds:
                    return None
            return None

        while True:
            found = _TAG.search(source, at)
            piece = source[at : found.start() if found else len(source)]
            if not found:
                piece = _CUT_OFF.sub("", piece)
            if piece:
                said = html.unescape(piece) if "&" in piece else piece
                node = stack[-1][1]
                if not said.strip():
                    spaced = True
                elif not broken and self.text[-1] and self.parent[-1] == node:
                    self.text[-1] += " " + said if spaced else said
                    spaced = False
                else:
                    self.add("#text", node, 0, said, broken or spaced)
                    broken = spaced = False
            if not found:
                break
            at = found.end()
            closing, tag, attributes = found.groups()
            if not tag:
                continue
            tag = tag.lower()
            block = tag in _BLOCK
            broken = broken or block
            if closing:
                if tag not in ("html", "body"):
                    close({tag}, frozenset() if block else _BLOCK)
                continue
            if tag in _RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(source, at)
                at = end.end() if end else len(source)
                continue
            if tag in ("html", "body", "head") or tag in _VOID:
                continue
            if tag in _ENDS_P:
                close({"p"}, _ENDS_P - {"p"})
            if tag in _CLOSES:
                close(*_CLOSES[tag])
            own = _roles(attributes) if "=" in attributes or "hidden" in attributes else 0
            if tag in _TAG_ROLE:
                own |= 1 << _NAMES.index(_TAG_ROLE[tag])
            node = stack[-1][1]
            stack.append((tag, self.add(tag, node, own) if block or own or tag == "a" else node))
        leave(0)


def features(nodes: Nodes) -> np.ndarray:
    """A row of numbers for each node."""
    n = len(nodes.tag)
    parent, end = np.array(nodes.parent, np.int64), np.array(nodes.end, np.int64)
    roles, above, depth = np.array(nodes.roles), np.array(nodes.above), np.array(nodes.depth)
    up = np.maximum(parent, 0)
    page = np.array(nodes.roots)[np.searchsorted(nodes.roots, np.arange(n), "right") - 1]
    group = np.array([_GROUP_OF.get(t, -1) for t in nodes.tag])
    chars = np.array([len(t) for t in nodes.text], np.float64)
    words = np.array([t.count(" ") + 1 if t else 0 for t in nodes.text], np.float64)
    marks = np.array([sum(map(t.count, _MARKS)) if t else 0 for t in nodes.text], np.float64)
    linked = np.array(nodes.linked)

    def within(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[end] - sums[:-1]

    inside, inside_words, inside_marks = within(chars), within(words), within(marks)
    in_links, texts, elements = within(chars * linked), within(chars > 0), within(chars == 0)
    paragraphs, links, items = (within(group == k) for k in (1, 3, 4))
    before = np.cumsum(chars) - chars
    total = inside[page]
    share = lambda a, b: a / np.maximum(b, 1)
    links_share = share(in_links, inside)
    # Siblings: a node's next one begins where it ends, if it has the same parent.
    following = np.where(end < n, end, 0)
    has_next = (end < n) & (parent[following] == parent) & (parent >= 0)
    next_one = np.where(has_next, following, -1)
    last_one = np.full(n, -1)
    last_one[next_one[has_next]] = np.flatnonzero(has_next)
    siblings = np.bincount(up[parent >= 0], minlength=n)
    order = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[order], parent[order])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n) - first
    of = lambda values, at: np.where(at >= 0, values[at], -1)
    bits = np.arange(len(ROLES))
    own_roles = (roles[:, None] >> bits) & 1
    role_sums = np.concatenate([np.zeros((1, len(ROLES)), np.int64), np.cumsum(own_roles, axis=0)])
    below = (role_sums[end] - role_sums[1:]) > 0
    log = np.log1p
    columns = [
        own_roles, (above[:, None] >> bits) & 1, below, group[:, None] == np.arange(len(GROUPS)),
        np.stack([
            depth, place, siblings[up], log(inside), share(inside, total), links_share, log(links), share(100 * elements, inside), share(inside, inside_words),
            share(inside_marks, inside_words), log(share(inside, texts)), log(paragraphs), log(items), share(before - before[page], total), log(total),
            log(inside[up]), links_share[up], share(inside, inside[up]), share(inside_marks, inside_words)[up],
            log(of(inside, last_one) + 1), of(links_share, last_one), log(of(inside, next_one) + 1), of(links_share, next_one), group[up], of(group, last_one), of(group, next_one),
        ], axis=1),
    ]
    return np.concatenate([c.astype(np.float32) for c in columns], axis=1)


N_FEATURES = 3 * len(ROLES) + len(GROUPS) + 26
