"""Main text of web pages by scoring the containers of their element tree.

Every block of text gives points for its length and commas to the elements around it: all to the nearest
container, half to the next, a sixth to the one after. A container's points count by the share of its text that is not in
links. The best container stays, with those of its siblings that score enough and what stands between them; if it is part
of an article or main element, that element stays. Parts that are no article (menus, adverts and so on) are left out by
element or role, and by class, id or form, whatever their size, unless they are a wrapper around the article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements that start a block, that hold no content, that hold raw text, and that end by themselves.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript noembed noframes xmp iframe".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"),
    "tfoot": ("tr", "td", "th", "tbody"),
}
#: An element that ends by itself does not end past these.
SCOPES = frozenset("table ul ol dl select html body article section div main blockquote".split())
#: Blocks that are text themselves; their points go to the element around them.
TEXT_BLOCKS = frozenset("p li dd dt td th pre blockquote h1 h2 h3 h4 h5 h6 figcaption caption summary address".split())

# What is no article: by element, by role and by a part of its class or id.
LEFT_OUT = frozenset(
    "nav footer aside script style noscript iframe button select option textarea input template dialog svg canvas "
    "object embed noembed noframes xmp menu head title annotation annotation-xml audio video map search".split()
)
LEFT_OUT_ROLES = frozenset(
    "navigation contentinfo complementary search dialog alert alertdialog menu menubar toolbar banner status".split()
)
FORMS = frozenset(("form", "fieldset"))
LEFT_OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion nav navbar "
    "navigation menu menus submenu breadcrumb breadcrumbs sidebar aside footer foot masthead banner notice notices "
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations comment comments commentlist disqus respond reply replies pager "
    "pagination widget widgets toolbar skip search searchform form copyright tagcloud".split()
)
#: Names of a page's head; inside an article they hold its title.
HEAD_NAMES = frozenset(("header", "topbar", "head"))
WHOLE = frozenset(("article", "main"))
#: Their class and id say nothing of their text; nor do those of inline elements.
KEPT_ALWAYS = frozenset("html body article main p h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that belong to the text beside them.
FLOW = TEXT_BLOCKS | frozenset("ul ol dl table figure section hr".split())

#: Names of what readers write; such a part is never taken for the article beside other text.
COMMENT_NAMES = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Ends of class names that say whether a page has comments, not that an element is one.
SWITCHES = frozenset("open opened close closed enabled disabled on off allowed".split())
#: A named element stays if what it holds scores so many times as much as all that is outside of named ones.
CLEARLY = 4
#: What is left of the points of text in a named element that stays.
LOWERED = 1 / 4
#: A block beside the best container stays up to this share of its text in links.
LINKED_SHARE = 1 / 4

POINT_CHARS = 100
MOST_LENGTH_POINTS = 3
#: Shares of a block's points for the elements around it, from the nearest on.
SHARES = (1.0, 1 / 2, 1 / 6)
#: A sibling stays from this share of the best score on, and at least this score.
SIBLING_SHARE, SIBLING_POINTS = 0.2, 3.0
#: A list or table with so many links, which make up this share of its text, is a menu.
MENU_LINKS, MENU_SHARE = 2, 0.8

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)|<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)", re.DOTALL)
TAG_EDGE = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _attributes(text: str) -> dict[str, str]:
    found = {}
    for m in ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _is_left_out(tag: str, given: dict[str, str], in_article: bool) -> bool:
    """Whether an element and all in it is no article, by its tag, role or because it is hidden."""
    if tag in LEFT_OUT or (tag == "header" and not in_article):
        return True
    if not given or tag in WHOLE or tag in ("html", "body"):
        return False
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", "")):
        return True
    return given.get("role", "").lower() in LEFT_OUT_ROLES


def _names(tag: str, given: dict[str, str], in_article: bool) -> frozenset[str]:
    """Names of an element that parts beside an article often have."""
    if tag in WHOLE:  # an article can be a comment
        classes = [[p.lower() for p in NAME_PART.findall(c)] for c in given.get("class", "").split()]
        return frozenset(c[0] for c in classes if c and c[0] in COMMENT_NAMES and c[-1] not in SWITCHES)
    if tag not in BLOCKS or tag in KEPT_ALWAYS:
        return frozenset()
    named = set(("form",)) if tag in FORMS or given.get("role", "").lower() == "form" else set()
    if "class" in given or "id" in given:
        kinds = {p.lower() for p in NAME_PART.findall(given.get("class", ""))}
        # In an article the id of a section is a place to link to.
        if not (in_article and (tag == "section" or "section" in kinds)):
            kinds |= {p.lower() for p in NAME_PART.findall(given.get("id", ""))}
        named |= kinds & LEFT_OUT_NAMES
        if not in_article:
            named |= kinds & HEAD_NAMES
    return frozenset(named)


class _Page:
    """Elements of a page as parallel lists, and its blocks of text in order."""

    def __init__(self) -> None:
        self.tag: list[str] = ["#page"]
        self.parent: list[int] = [-1]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self.links: list[int] = [0]
        self.names: dict[int, frozenset[str]] = {}


def parsed(source: str) -> _Page:
    """The blocks of a page that are not left out by element or role, and which elements have names. Takes time in proportion to the page's length."""
    page = _Page()
    stack = [0]
    out_depth = 0  # elements on the stack from the first left-out one on
    article_depth = 0
    link_depth = 0
    pieces: list[str] = []
    linked = 0
    lowered = None

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                at = len(stack) - 1
                while at and page.tag[stack[at]] not in BLOCKS:
                    at -= 1
                page.blocks.append((stack[at], text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if out_depth or not text:
            return
        decoded = html.unescape(text) if "&" in text else text
        pieces.append(decoded)
        if link_depth:
            linked += len(decoded.strip())

    def pop() -> None:
        nonlocal out_depth, article_depth, link_depth
        tag = page.tag[stack.pop()]
        if out_depth:
            out_depth -= 1
        if tag in WHOLE:
            article_depth -= 1
        elif tag == "a":
            link_depth -= 1

    quotes_close = True

    def tag_end(at: int) -> int:
        """Where a tag's ``>`` is, outside quotes. Once quotes don't close in a page they are read as any other sign."""
        nonlocal quotes_close
        place = at
        while quotes_close:
            edge = TAG_EDGE.search(source, place)
            if edge is not None and edge[0] == ">":
                return edge.start()
            place = source.find(edge[0], edge.end()) + 1 if edge is not None else 0
            quotes_close = place > 0
        return source.find(">", at)

    at, length = 0, len(source)
    while at < length:
        found = TAG.search(source, at)
        if found is None:
            add(source[at:])
            break
        add(source[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        end = tag_end(at)
        if end < 0:  # an open tag at the end of the page
            break
        tag, rest, at = found[2].lower(), source[at:end], end + 1
        if found[1]:  # an end
            if tag == "br":
                pieces.append(" ")
                continue
            if tag == "p" and "p" not in (page.tag[i] for i in stack[-8:]):
                flush()
                continue
            k = len(stack) - 1
            while k and page.tag[stack[k]] != tag:
                if page.tag[stack[k]] in SCOPES and tag not in BLOCKS:
                    k = 0
                    break
                k -= 1
            if not k:
                continue
            if tag in BLOCKS:
                flush()
            while len(stack) > k:
                if page.tag[stack[-1]] in BLOCKS:
                    flush()
                pop()
            continue
        if tag == "br":
            if not out_depth:
                pieces.append(" ")
            continue
        block = tag in BLOCKS
        if block:
            if "p" in (page.tag[i] for i in stack[-8:]):  # a block ends an open paragraph
                k = len(stack) - 1
                while page.tag[stack[k]] != "p":
                    k -= 1
                if not any(page.tag[i] in SCOPES for i in stack[k + 1 :]):
                    flush()
                    while len(stack) > k:
                        pop()
            flush()
        if tag in CLOSES:
            k = len(stack) - 1
            while k and page.tag[stack[k]] not in CLOSES[tag] and page.tag[stack[k]] not in SCOPES:
                k -= 1
            while page.tag[stack[k]] in CLOSES[tag]:
                flush()
                while len(stack) > k:
                    pop()
                k = len(stack) - 1
        if tag in VOID or rest.endswith("/") and tag not in BLOCKS and tag not in RAW and tag != "a":
            continue
        number = len(page.tag)
        page.tag.append(tag)
        page.parent.append(stack[-1])
        page.links.append(0)
        given = _attributes(rest) if rest and not out_depth else {}
        if out_depth or _is_left_out(tag, given, article_depth > 0):
            out_depth += 1
        else:
            if tag == "a":
                page.links[number] = 1
            if names := _names(tag, given, article_depth > 0):
                page.names[number] = names
        stack.append(number)
        if tag in WHOLE:
            article_depth += 1
        elif tag == "a":
            link_depth += 1
        if tag in RAW:
            if lowered is None:
                lowered = source.lower() if len(source.lower()) == length else re.sub("[A-Z]", lambda m: m[0].lower(), source)
            end = lowered.find(f"</{tag}", at)
            at = length if end < 0 else end
    flush()
    return page


def _up(page: _Page, element: int) -> Iterator[int]:
    while element >= 0:
        yield element
        element = page.parent[element]


def _inside(page: _Page, tops: set[int]) -> list[bool]:
    """Which elements lie in one of ``tops``."""
    out = [False] * len(page.tag)
    for i in range(1, len(out)):
        out[i] = out[page.parent[i]] or i in tops
    return out


def _around_article(page: _Page) -> set[int]:
    """Elements around an article element, or around a title with a paragraph: wrappers, whatever their name."""
    found: set[int] = set()
    titled: set[int] = set()
    for i, tag in enumerate(page.tag):
        if tag in WHOLE and i not in page.names:
            found.update(_up(page, i))
    for element, text, linked in page.blocks:
        if page.tag[element] == "h1":
            titled.update(_up(page, element))
        elif page.tag[element] == "p" and len(text) - linked >= POINT_CHARS:
            found.update(titled.intersection(_up(page, element)))
    return found


def _named_parts(page: _Page) -> list[bool]:
    """Which elements are left out by name: whatever their size, all named ones that are no wrapper of the article.

    A wrapper holds the article element, or the title and a paragraph. On a page without these it is the named element around
    the best container, if that scores clearly more than all that is outside of named elements, or if nothing is.
    """
    tops = set(page.names) - _around_article(page)
    out = _inside(page, tops)
    score = _scores(page, page.blocks)[0]
    best = max(range(len(score)), key=score.__getitem__)
    if not out[best]:
        return out
    rest = [b for b in page.blocks if not out[b[0]]]
    wrappers = [i for i in _up(page, best) if i in tops]
    comments = any(page.names[i] & COMMENT_NAMES for i in wrappers)
    if not rest or (not comments and score[best] >= CLEARLY * max(_scores(page, rest)[0])):
        return _inside(page, tops.difference(wrappers))
    return out


def main_text(source: str) -> str:
    """Blocks of the main text in page order, joined by an empty line; empty if there is none."""
    page = parsed(source)
    if not page.blocks:
        return ""
    if not page.names:
        return _chosen(page, page.blocks)
    out = _named_parts(page)
    found = _chosen(page, [b for b in page.blocks if not out[b[0]]])
    if not found:
        page.names = {}
        found = _chosen(page, page.blocks)
    return found


def _scores(page: _Page, blocks: list[tuple[int, str, int]]) -> tuple[list[float], list[int], list[int], list[int]]:
    """Per element: its score, characters, characters in links and links."""
    n = len(page.tag)
    points, chars, in_links, links = [0.0] * n, [0] * n, [0] * n, page.links[:]
    weight = [1.0] * n
    for i in range(1, n):
        weight[i] = weight[page.parent[i]] * (LOWERED if i in page.names else 1.0)
    for element, text, linked in blocks:
        chars[element] += len(text)
        in_links[element] += linked
        given = (1 + text.count(",") + min(len(text) / POINT_CHARS, MOST_LENGTH_POINTS)) * (1 - linked / len(text))
        given *= weight[element]
        at = page.parent[element] if page.tag[element] in TEXT_BLOCKS and page.parent[element] >= 0 else element
        for share in SHARES:
            if at < 0:
                break
            points[at] += given * share
            at = page.parent[at]
    for i in range(n - 1, 0, -1):  # children come after their parents
        up = page.parent[i]
        chars[up] += chars[i]
        in_links[up] += in_links[i]
        links[up] += links[i]
    score = [p * (1 - in_links[i] / chars[i]) if chars[i] else 0.0 for i, p in enumerate(points)]
    return score, chars, in_links, links


def _chosen(page: _Page, blocks: list[tuple[int, str, int]]) -> str:
    if not blocks:
        return ""
    n = len(page.tag)
    score, chars, in_links, links = _scores(page, blocks)
    best = max(range(n), key=score.__getitem__)
    kept = {best}
    up = best
    while up >= 0 and page.tag[up] not in WHOLE:
        up = page.parent[up]
    if up >= 0:
        kept.add(up)
    top = up if up >= 0 else best
    enough = max(SIBLING_POINTS, SIBLING_SHARE * score[best])
    above = page.parent[top]
    beside: set[int] = set()  # blocks, by their place, that stay beside the containers
    if above >= 0:
        for i in range(above + 1, n):
            if page.parent[i] == above and (score[i] >= enough or page.tag[i] == "h1"):
                kept.add(i)
        # Paragraphs beside the container pass their points to what is above it.
        for element, text, linked in blocks:
            if page.parent[element] == above and page.tag[element] == "p" and linked <= len(text) / 4 and len(text) >= POINT_CHARS:
                kept.add(element)
        branch = [-1] * n  # the sibling that an element is part of; the parent itself for its own text
        branch[above] = above
        for i in range(above + 1, n):
            branch[i] = i if page.parent[i] == above else -1 if branch[page.parent[i]] == above else branch[page.parent[i]]
        row = [k for k, b in enumerate(blocks) if branch[b[0]] >= 0]

        def unlinked(k: int) -> bool:
            element, text, linked = blocks[k]
            side = branch[element]
            return linked <= LINKED_SHARE * len(text) if side == above else in_links[side] <= LINKED_SHARE * chars[side]

        stays = [j for j, k in enumerate(row) if branch[blocks[k][0]] in kept]
        first, last = stays[0], stays[-1]
        beside.update(k for k in row[first : last + 1] if unlinked(k))
        if up < 0:  # without an article element the text goes on in what adjoins
            for step in (-1, 1):
                j = (first if step < 0 else last) + step
                before = -1
                while 0 <= j < len(row) and unlinked(row[j]):
                    side = branch[blocks[row[j]][0]]
                    titled = before >= 0 and page.tag[before] in HEADINGS and step > 0
                    if side != before and (side in page.names or not (side == above or page.tag[side] in FLOW or titled)):
                        break
                    beside.add(row[j])
                    before, j = side, j + step
    inside = [False] * n
    menu = [False] * n
    for i in range(n):
        p = page.parent[i]
        inside[i] = i in kept or (p >= 0 and inside[p])
        menu[i] = (p >= 0 and menu[p]) or (
            page.tag[i] in ("ul", "ol", "table", "dl") and links[i] >= MENU_LINKS and in_links[i] >= MENU_SHARE * chars[i]
        )
    return "\n\n".join(
        text for k, (element, text, _) in enumerate(blocks) if (inside[element] or k in beside) and not menu[element]
    )


def main_texts(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Null html is an empty page, and a page without text gives an empty text. Repeated rows get equal results.
    Whole pages are read, in one pass each. Other columns are not read.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "") for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
