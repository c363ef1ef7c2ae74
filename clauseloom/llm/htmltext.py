"""Main text of a web page by composite text density.

A page is read into a tree that forgives unclosed and stray tags. Elements that are no
article text by their meaning (scripts, menus, footers, forms, adverts, comments ...) are
set aside. For every other node the density is its characters per tag, adjusted for the
share of characters and tags that stand in links; a container's score is the sum of its
children's densities, and the container with the largest score holds the article. The
lowest density on the way from it up to the body is the threshold: blocks elsewhere that
reach it count as well; where an article or main element is around the winner, only those
inside the outermost of them, with the headings beside the way, and sibling articles.
Inside the winner, lists of three links or more below the threshold are dropped where they
stand before all text or, outside an article, after all text without a heading or colon
that leads to them; headings, paragraphs and lists between or after text stay.

Names of classes count if they are a word of the list; outside article elements also if all
their parts are list words or fillers ("related-posts"), and there ids and names of sections
count too. Names of adverts, cookie notices, newsletters and reader comments count everywhere,
as compounds and ids too. None counts for headings and elements that hold more than half of the
page's text (of comments beside an article it does).

Text comes out in page order: one block per paragraph-like element, white space inside it
as single spaces, character references decoded, blocks joined by an empty line. Nothing
is cut by length.

Defined cases: null, empty or text-free html gives an empty text; text outside any tag
counts as the body's; repeated rows and ties (the first in page order wins) are
deterministic; other columns go along.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr td th".split())
#: Containers that may hold an article; other elements are read as part of one.
CONTAINERS = frozenset("body main article section div td th center details blockquote table tbody ul ol dl li dd".split())
#: An opening tag of these ends an open p; li and the like end an open one of their own kind.
ENDS_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "menu nav ol p pre section table ul".split())
ENDS_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
            "option": ("option",)}
SCOPE = frozenset("table ul ol dl select article section main body div td th".split())

NEVER = frozenset("head nav footer aside form button select dialog menu fieldset object applet canvas audio video map".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: Words in a class or id that tell what an element is for.
NEVER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs pagination pager footer sidebar aside widget rail cookie cookies consent gdpr notice banner alert popup modal overlay "
    "toast newsletter subscribe signup login comment comments disqus respond replies reply share sharing social related recommended "
    "recommendations".split())
COMMENT_NAMES = frozenset("comment comments disqus respond replies reply".split())
COMMENT_WORD = re.compile("comments?(?:list|area|form|section|thread|box|block|body|feed|wrap|wrapper|container)s?")
ADVERT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr newsletter "
    "subscribe".split())
#: Words that go with those names in compounds and say nothing by themselves.
FILLERS = frozenset(
    "site page global top bottom left right main primary secondary box bar block list links link button buttons container wrapper wrap area "
    "inner outer posts items icons form user users reader readers thread threads section slot unit zone panel feed title count".split())
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
LISTS = frozenset("ul ol dl div table".split())
MENU_LINKS = 3


class Tree:
    """Nodes in page order; text pieces with the node and block they belong to."""

    def __init__(self) -> None:
        self.tag, self.parent, self.skip = ["body"], [-1], [""]
        self.pieces: list[tuple[int, str]] = []  # (node, text); node -1 - n marks the edge of a block at node n


def named(token: str) -> str:
    """What a class or id says: "header", "comments", "advert", "name" for other words of the list, "compound" with fillers, or nothing."""
    parts = ["comments" if COMMENT_WORD.fullmatch(part) else part for part in map(str.lower, NAME_PART.findall(token))]
    known = NEVER_NAMES.intersection(parts)
    if parts == ["header"]:
        return "header"
    if not known or not known | FILLERS >= set(parts):
        return ""
    return "comments" if COMMENT_NAMES & known else "advert" if ADVERT_NAMES & known else "name" if len(parts) == 1 else "compound"


def means_other(tag: str, attributes: str) -> str:
    """Whether and by what an element is no article text: "meaning" (tag, role, hidden), "header", "comments", "advert", "name", "compound" (also ids and sections), or nothing."""
    if tag in NEVER:
        return "meaning"
    says = "header" if tag == "header" else ""
    if not attributes or tag in ("body", "html"):
        return says
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), values[0] or values[1] or values[2]
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return "meaning"
        if key == "role" and value.lower() in NEVER_ROLES:
            return "meaning"
        if not says and tag not in HEADINGS and key in ("class", "id"):
            says = next(filter(None, map(named, value.split())), "")
            if says in ("name", "header") and (key == "id" or tag == "section"):
                says = "compound"
    return says


def tree_of(html: str) -> Tree:
    tree = Tree()
    tags, parents, skips, pieces = tree.tag, tree.parent, tree.skip, tree.pieces
    stack, open_tags, at = [0], Counter(["body"]), 0

    def close_to(height: int) -> None:
        while len(stack) > height:
            node = stack.pop()
            open_tags[tags[node]] -= 1
            if tags[node] not in INLINE:
                pieces.append((-1 - node, ""))

    def close_nearest(names: tuple[str, ...]) -> None:
        if not any(open_tags[n] for n in names):
            return
        for height in range(len(stack) - 1, 0, -1):
            if tags[stack[height]] in names:
                close_to(height)
                return
            if tags[stack[height]] in SCOPE:
                return

    raw_end: dict[str, re.Pattern] = {}
    search = TOKEN.search
    while True:
        found = search(html, at)
        text = html[at:found.start() if found else len(html)]
        if text:
            pieces.append((stack[-1], text))
        if not found:
            return tree
        at = found.end()
        closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag in ("body", "html"):
                continue  # what follows still belongs to the page
            if open_tags[tag]:
                for height in range(len(stack) - 1, 0, -1):
                    if tags[stack[height]] == tag:
                        close_to(height)
                        break
            continue
        if tag in ("html", "body"):
            continue
        if tag in RAW:
            end = raw_end.setdefault(tag, re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I))
            if not attributes.endswith("/"):
                until = end.search(html, at)
                at = until.end() if until else len(html)
            continue
        if tag in ENDS_P:
            if tag in ("article", "main") and open_tags["head"]:
                close_nearest(("head",))
            close_nearest(("p",))
        if tag in ENDS_OWN:
            close_nearest(ENDS_OWN[tag])
        if tag == "br":
            pieces.append((stack[-1], " "))
        if tag in ("td", "th"):
            pieces.append((stack[-1], " "))
        node = len(tags)
        tags.append(tag)
        parents.append(stack[-1])
        skips.append(means_other(tag, attributes))
        if tag not in INLINE and tag != "br":
            pieces.append((-1 - node, ""))
        if tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
            open_tags[tag] += 1


def menus(tree: Tree, pieces: list[tuple[int, str]], root: int, article: bool, counts, linked) -> list[int]:
    """The link lists of the root that are menus by their place: before all text, or after all of it without a lead."""
    tags, parents = tree.tag, tree.parent
    n = len(tags)
    own_text, n_links = [t in HEADINGS or t == "p" for t in tags], [t == "a" for t in tags]
    for i in range(n - 1, 0, -1):
        own_text[parents[i]] |= own_text[i]
        n_links[parents[i]] += n_links[i]
    of = [-1] * n  # the outermost link list around
    for i in range(root + 1, n):
        of[i] = of[parents[i]]
        if of[i] < 0 and counts(i) and tags[i] in LISTS and n_links[i] >= MENU_LINKS and not own_text[i] and linked(i):
            p = parents[i]
            while p != root and tags[p] not in HEADINGS and tags[p] not in ("p", "li", "dd"):
                p = parents[p]
            if p == root:
                of[i] = i
    if not any(i >= 0 for i in of):
        return []
    places: dict[int, list[int]] = {}
    for k, (node, text) in enumerate(pieces):
        if node >= 0 and counts(node) and text.strip():
            places.setdefault(of[node], []).append(k)
    text_at = places.pop(-1, None)
    if not text_at:
        return []
    node, lead = pieces[text_at[-1]]
    introduced = article or lead.rstrip().endswith(":")
    while node > root and not introduced:
        introduced = tags[node] in HEADINGS
        node = parents[node]
    return [i for i, at in places.items() if at[-1] < text_at[0] or at[0] > text_at[-1] and not introduced]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    tree = tree_of(html)
    tags, parents, skips = tree.tag, tree.parent, tree.skip
    n = len(tags)

    # what is no article text, with all below it; an element around every article of the page is not set aside
    articles = [0] * n
    for i in range(n - 1, 0, -1):
        articles[i] += tags[i] in ARTICLE
        articles[parents[i]] += articles[i]
    held = [0] * n  # characters, what is out by meaning left out
    meaning = [False] * n
    for i in range(1, n):
        meaning[i] = meaning[parents[i]] or skips[i] == "meaning"
    for node, text in tree.pieces:
        if node >= 0 and not meaning[node]:
            held[node] += len(text) - text.count(" ") - text.count("\n")
    for i in range(n - 1, 0, -1):
        held[parents[i]] += held[i]
    inside, in_article, in_header, in_link = [False] * n, [False] * n, [False] * n, [False] * n
    out = [False] * n
    for i in range(1, n):
        p = parents[i]
        inside[i] = inside[p] or tags[i] in ARTICLE
        in_article[i] = in_article[p] or tags[i] == "article"
        own = bool(skips[i]) and not (articles[0] and articles[i] == articles[0])
        if skips[i] == "compound" and in_article[p]:
            own = False
        if own and skips[i] != "meaning" and tags[i] != "header" and 2 * held[i] > held[0]:  # most of the text
            own = bool(articles[0]) and (skips[i] == "comments" or not articles[i] and not inside[p])
        if own and skips[i] == "header" and inside[p]:
            own, in_header[i] = False, True
        in_header[i] = in_header[i] or in_header[p]
        out[i] = out[p] or own
        in_link[i] = in_link[p] or tags[i] == "a"
    # of an article's own header, the headings stay, with what is around and in them
    heading_in, heading_over = [t in HEADINGS for t in tags], [t in HEADINGS for t in tags]
    for i in range(n - 1, 0, -1):
        heading_in[parents[i]] |= heading_in[i]
    for i in range(1, n):
        heading_over[i] |= heading_over[parents[i]]
        if in_header[i] and not heading_in[i] and not heading_over[i]:
            out[i] = True
        out[i] |= out[parents[i]]

    # characters, tags, and those in links, of each subtree
    pieces = [(node, text if node < 0 else unescape(text)) for node, text in tree.pieces]
    chars, links, count, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for node, text in pieces:
        if node >= 0 and not out[node]:
            size = len(text) - text.count(" ") - text.count("\n")
            chars[node] += size
            if in_link[node]:
                links[node] += size
    for i in range(n - 1, 0, -1):
        if not out[i]:
            p = parents[i]
            chars[p] += chars[i]
            links[p] += links[i]
            count[p] += count[i] + 1
            link_tags[p] += link_tags[i] + in_link[i]
    if not chars[0]:
        return ""

    share = links[0] / chars[0]

    def density(i: int) -> float:
        c, t, lc, lt = chars[i], count[i] or 1, links[i], link_tags[i]
        if not c:
            return 0.0
        if not share:  # a page without links
            return c / t
        base = log(c * lc / max(1, c - lc) + share * c + e)
        return c / t * log(max(1.0, (c / max(1, lc)) * (t / max(1, lt)))) / log(base)

    dense = [0.0 if out[i] else density(i) for i in range(n)]
    total, holder = [0.0] * n, [0] * n  # an inline element's children are its container's
    for i in range(1, n):
        if not out[i]:
            holder[i] = holder[parents[i]] if tags[parents[i]] in INLINE else parents[i]
            if tags[i] not in INLINE:
                total[holder[i]] += dense[i]
    best = max((i for i in range(n) if not out[i] and tags[i] in CONTAINERS), key=lambda i: (total[i], -i))
    path, i = [], best
    while i >= 0:
        path.append(i)
        i = parents[i]
    threshold = min(dense[i] for i in path)
    around = [i for i in path if tags[i] in ARTICLE]
    root = around[0] if around else best

    # blocks: text between block edges; each belongs to the element that holds its first piece
    chosen = [False] * n
    chosen[root] = True
    for i in range(root + 1, n):
        chosen[i] = chosen[parents[i]]
    below, reached, on_path = [False] * n, [not around] * n, set(path)
    below[root] = True
    for i in range(1, n):
        p = parents[i]
        below[i] |= below[p]
        if around:
            reached[i] = reached[p] or i == around[-1] or p in on_path and tags[i] in ARTICLE and i not in on_path
        if not below[i] and i not in on_path:
            beside = bool(around) and p in on_path and tags[i] in HEADINGS and 2 * links[i] <= chars[i]
            chosen[i] = chosen[p] or reached[i] and tags[i] not in INLINE and (dense[i] >= threshold > 0 or beside)
    for i in menus(tree, pieces, root, bool(around), lambda i: below[i] and not out[i], lambda i: 2 * links[i] > chars[i] and dense[i] < threshold):
        out[i] = True
    for i in range(root + 1, n):
        out[i] |= out[parents[i]]
    blocks, now = [], []
    for node, text in pieces:
        if node < 0:
            if now:
                blocks.append(now)
                now = []
        elif chosen[node] and not out[node]:
            now.append(text)
    if now:
        blocks.append(now)
    return "\n\n".join(x for x in (" ".join("".join(b).split()) for b in blocks) if x)


def extracted(html: Column) -> Column:
    """The main text; empty if there is none."""

    @F.arrow_udf("string")
    def extract(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x) for x in column.to_pylist()], pa.string())

    return extract(html)


def with_main_text(pages: DataFrame, html: str = "html", to: str = "text") -> DataFrame:
    return pages.withColumn(to, extracted(F.col(html)))
