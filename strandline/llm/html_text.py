"""Main text of web pages from flat text blocks.

A page becomes a flat sequence of text blocks, broken at block-level tags. A block has its word count and link density
and those of its two neighbours, and marks of what encloses it. A decision tree, trained here on a small labelled table
of blocks, says which blocks are main text.

Names in class, id and role are of two kinds. Those of comments, notices, adverts, menus, forms and the like make what they
name boilerplate whatever its size, but for a wrapper: an element that has all of the page's main elements inside (or its
only first-level heading, where there is no main element) says with its name what else it has. Words such as header, tag or
print, which also name ordinary parts, are a weak mark: what they name is boilerplate only while it has less than half of
the page's words, or mostly links.
"""

from __future__ import annotations

import html
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

# Kinds of HTML elements.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source svg path math".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("script style noscript template textarea select option button svg math iframe object canvas audio video head title datalist".split())
RAW = set("script style textarea title template noscript iframe".split())
BOILER = set("nav footer aside form menu dialog fieldset".split())
MAIN = set("article main".split())
CLOSED_BY_BLOCK = set("p h1 h2 h3 h4 h5 h6".split())

# Words in class, id and role that name what is not main text, and what is.
COMMENTS = r"comment(?:s|list|box|thread|area|section|form|wrap|er|text|body)?|commentary-list|respond|discussion|replies|reply|disqus"
BOILER_HINT = re.compile(rf"(?:^|[^a-z])(?:{COMMENTS}|ads?|advert\w*|sponsor\w*|promo\w*|cookie\w*|consent\w*|gdpr|notices?|noticebar|popup\w*|newsletter\w*|subscribe|subscription|signup|login|side-?bar\w*|widget\w*|nav\w*|menu|menubar|breadcrumbs?|pagination|pager|footer\w*|site-?header|page-?header|masthead|topbar|related|recommend\w*|complementary|contentinfo|navigation)(?:[^a-z]|$)", re.I)
WEAK_HINT = re.compile(r"(?:^|[^a-z])(?:banner\w*|alerts?|modal|overlay|header|share|sharing|social|tags?|toolbar|search|skip\w*|print|copyright|legal|disclaimer)(?:[^a-z]|$)", re.I)
COMMENT_TOKEN = re.compile(rf"(?:^|\s)(?:{COMMENTS})(?:\s|$)", re.I)
MAIN_HINT = re.compile(r"(?:^|[^a-z])(?:article\w*|entry-?content|post-?(?:content|body)|story\w*|main-?(?:content|text)?|content-?body|body-?text)(?:[^a-z]|$)", re.I)

FEATURES = ("words", "link", "words_before", "link_before", "words_after", "link_after", "boiler", "main", "prose")
#: The labelled blocks: words, link density; those of the block before; of the one after; inside an element or class of
#: boilerplate; inside an element or class of main text; whether its tag is of prose; the label (1: main text).
LABELLED = [
    # in an article, from long paragraphs to a word, between paragraphs or at its ends
    (9, 0.0, 8, 0.0, 80, 0.0, 0, 1, 1, 1), (80, 0.0, 9, 0.0, 40, 0.0, 0, 1, 1, 1), (40, 0.1, 80, 0.0, 1, 0.0, 0, 1, 1, 1),
    (1, 0.0, 40, 0.0, 25, 0.0, 0, 1, 1, 1), (25, 0.0, 1, 0.0, 6, 0.0, 0, 1, 1, 1), (6, 0.0, 25, 0.0, 12, 0.1, 0, 1, 1, 1),
    (3, 0.0, 0, 0.0, 60, 0.0, 0, 1, 1, 1), (12, 0.5, 60, 0.0, 60, 0.0, 0, 1, 1, 1), (2, 1.0, 30, 0.0, 50, 0.0, 0, 1, 1, 1),
    (4, 1.0, 4, 1.0, 4, 1.0, 0, 1, 1, 1), (300, 0.0, 5, 1.0, 9, 0.4, 0, 1, 0, 1), (2, 0.0, 1, 1.0, 12, 0.1, 0, 1, 1, 1),
    (7, 0.0, 90, 0.0, 0, 0.0, 0, 1, 0, 1), (1, 0.0, 8, 0.0, 8, 0.1, 0, 1, 0, 1), (15, 0.0, 15, 0.0, 15, 0.0, 0, 1, 0, 1),
    (6, 0.0, 5, 0.0, 3, 0.0, 0, 1, 1, 1), (12, 0.0, 8, 0.0, 2, 0.0, 0, 1, 1, 1), (5, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1, 1),
    (3, 0.0, 2, 0.0, 1, 0.0, 0, 1, 1, 1), (40, 0.0, 3, 0.0, 2, 0.0, 0, 1, 1, 1), (4, 0.0, 6, 0.0, 0, 0.0, 0, 1, 1, 1),
    (2, 0.0, 3, 1.0, 4, 1.0, 0, 1, 0, 1), (1, 0.0, 1, 1.0, 1, 1.0, 0, 1, 1, 1), (9, 0.0, 2, 1.0, 2, 0.0, 0, 1, 1, 1),
    (30, 0.0, 1, 1.0, 8, 1.0, 0, 1, 1, 1), (5, 1.0, 3, 0.0, 1, 1.0, 0, 1, 1, 1), (8, 0.9, 1, 0.0, 2, 1.0, 0, 1, 0, 1),
    (3, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1), (20, 0.0, 4, 0.0, 3, 0.0, 0, 1, 0, 1), (6, 0.0, 2, 0.0, 0, 0.0, 0, 1, 0, 1),
    (60, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1), (5, 0.0, 6, 0.0, 9, 0.0, 0, 1, 0, 1), (2, 0.0, 5, 0.0, 1, 0.0, 0, 1, 0, 1),
    # marked as boilerplate, in an article or out of it, whatever its length
    (2, 1.0, 0, 0.0, 2, 1.0, 1, 0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 1, 0), (9, 0.0, 1, 1.0, 10, 0.0, 1, 0, 0, 0),
    (45, 0.0, 9, 0.0, 60, 0.0, 1, 0, 1, 0), (80, 0.0, 70, 0.0, 20, 0.0, 1, 1, 1, 0), (30, 0.0, 80, 0.0, 30, 0.0, 1, 1, 1, 0),
    (12, 0.2, 60, 0.0, 0, 0.0, 1, 0, 0, 0), (5, 0.0, 40, 0.0, 40, 0.0, 1, 1, 0, 0), (150, 0.0, 150, 0.0, 10, 0.0, 1, 1, 1, 0),
    (20, 0.9, 20, 0.9, 20, 0.9, 1, 0, 1, 0), (3, 0.0, 3, 0.0, 3, 0.0, 1, 1, 1, 0), (60, 0.1, 5, 0.0, 60, 0.1, 1, 0, 1, 0),
    # on pages without such marks: prose by its length, what leads to prose, and lists of links
    (50, 0.0, 5, 0.0, 40, 0.1, 0, 0, 1, 1), (35, 0.1, 50, 0.0, 45, 0.0, 0, 0, 1, 1), (120, 0.0, 3, 1.0, 3, 1.0, 0, 0, 0, 1),
    (18, 0.0, 70, 0.0, 60, 0.0, 0, 0, 1, 1), (6, 0.0, 60, 0.0, 70, 0.0, 0, 0, 1, 1), (8, 0.0, 3, 1.0, 60, 0.0, 0, 0, 1, 1),
    (22, 0.2, 30, 0.0, 4, 1.0, 0, 0, 1, 1), (16, 0.0, 4, 1.0, 40, 0.0, 0, 0, 1, 1), (28, 0.3, 50, 0.0, 28, 0.3, 0, 0, 0, 1),
    (8, 0.0, 9, 0.0, 7, 0.0, 0, 0, 1, 1), (12, 0.0, 8, 0.0, 10, 0.0, 0, 0, 1, 1), (6, 0.0, 0, 0.0, 9, 0.0, 0, 0, 1, 1),
    (9, 0.0, 12, 0.0, 0, 0.0, 0, 0, 1, 1), (14, 0.0, 6, 0.0, 11, 0.0, 0, 0, 1, 1), (5, 0.0, 11, 0.0, 13, 0.0, 0, 0, 1, 1),
    (4, 0.0, 9, 0.0, 3, 1.0, 0, 0, 1, 1), (7, 0.0, 4, 1.0, 10, 0.0, 0, 0, 1, 1), (3, 0.0, 6, 0.0, 6, 0.0, 0, 0, 1, 1),
    (80, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1, 1), (60, 0.0, 2, 0.0, 3, 0.0, 0, 0, 1, 1), (45, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 1),
    (7, 0.0, 7, 0.0, 0, 0.0, 0, 0, 1, 1), (6, 0.0, 5, 0.0, 4, 0.0, 0, 0, 1, 1), (3, 0.0, 4, 0.0, 2, 0.0, 0, 0, 1, 1),
    (4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 1, 0), (6, 0.0, 4, 1.0, 5, 0.9, 0, 0, 1, 0), (7, 0.0, 3, 1.0, 4, 1.0, 0, 0, 1, 0),
    (9, 0.0, 6, 0.9, 4, 1.0, 0, 0, 1, 0), (10, 0.4, 5, 1.0, 6, 0.9, 0, 0, 1, 0), (9, 0.3, 12, 0.0, 14, 0.0, 0, 0, 1, 1),
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 1, 0), (3, 1.0, 3, 1.0, 40, 0.0, 0, 0, 0, 0), (6, 0.8, 5, 0.9, 5, 0.9, 0, 0, 1, 0),
    (4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0), (3, 0.0, 3, 0.0, 2, 1.0, 0, 0, 0, 0), (30, 0.9, 4, 1.0, 5, 1.0, 0, 0, 0, 0),
    (8, 0.1, 5, 0.5, 0, 0.0, 0, 0, 0, 0), (5, 0.0, 0, 0.0, 4, 1.0, 0, 0, 0, 0), (14, 0.7, 70, 0.0, 12, 0.8, 0, 0, 0, 0),
    (1, 1.0, 40, 0.0, 0, 0.0, 0, 0, 0, 0), (3, 1.0, 60, 0.0, 2, 0.0, 0, 0, 1, 0), (7, 0.0, 2, 1.0, 1, 1.0, 0, 0, 0, 0), (1, 0.0, 2, 0.0, 2, 0.0, 0, 0, 0, 0), (12, 1.0, 40, 0.0, 9, 1.0, 0, 0, 1, 0),
]


#: Words and link density of blocks, for what holds at any size: marked boilerplate is none, other blocks of an article are main.
SIZES = [(0, 0.0), (1, 0.0), (2, 1.0), (4, 0.0), (7, 0.05), (9, 0.4), (20, 0.0), (60, 0.1), (200, 0.0)]


def table() -> list[tuple]:
    """The labelled blocks, and the marked ones of all SIZES between neighbours of all."""
    marked = [(*own, *before, *after, boiler, 1, prose, 1 - boiler) for own in SIZES[1:] for before in SIZES for after in SIZES for boiler in (0, 1) for prose in (0, 1)]
    return LABELLED + marked


def train(rows: list[tuple], depth: int = 6):
    """A binary tree (feature, threshold, at or below, above) or a label, split where Gini impurity falls most."""
    ones = sum(r[-1] for r in rows)
    if not depth or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))

    def impurity(part: list[tuple]) -> float:
        p = sum(r[-1] for r in part) / len(part)
        return len(part) * p * (1 - p)

    best = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:]):
            at = (low + high) / 2
            left, right = [r for r in rows if r[f] <= at], [r for r in rows if r[f] > at]
            found = impurity(left) + impurity(right)
            if best is None or found < best[0] - 1e-12:
                best = found, f, at, left, right
    if best is None:
        return int(2 * ones >= len(rows))
    return best[1], best[2], train(best[3], depth - 1), train(best[4], depth - 1)


@cache
def tree():
    return train(table())


def classify(node, features: tuple) -> bool:
    while not isinstance(node, int):
        node = node[2] if features[node[0]] <= node[1] else node[3]
    return bool(node)


def blocks(page: str) -> list[tuple[str, int, float, int, int, int]]:
    """(text, words, link density, boiler, main, prose) of each text block, in page order."""
    out, text, linked = [], [], 0
    stack: list[tuple[str, int, int, int, bool, int]] = []  # tag, boiler, main, skipped, is prose, number of a named element
    boiler = main = skipped = links = heads = hearts = 0
    named: list[list[int]] = []  # of elements with a name of boilerplate: words, linked words, first-level headings, main elements, strong

    def close_block():
        nonlocal text, linked
        if text:
            words = " ".join("".join(text).split())
            if words:
                n = words.count(" ") + 1
                inside = [e[5] for e in stack if e[5] >= 0]
                for k in inside:
                    named[k][0] += n
                    named[k][1] += min(n, linked)
                out.append((words, n, min(1.0, linked / n), boiler > 0, int(main > 0), int(bool(stack) and stack[-1][4]), inside))
        text, linked = [], 0

    def leave(k: int):
        nonlocal boiler, main, skipped
        close_block()
        for _, b, m, s, *_ in stack[k:]:
            boiler, main, skipped = boiler - b, main - m, skipped - s
        del stack[k:]

    def add(raw: str):
        nonlocal linked
        if raw and not skipped:
            raw = html.unescape(raw) if "&" in raw else raw
            text.append(raw)
            if links > 0:
                linked += len(raw.split())

    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        m = TOKEN.search(page, at) if at <= last or page.find("<!--", at) >= 0 else None
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1]:
                add(m[1])
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE and tag not in SKIPPED:
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    leave(k)
                    break
            else:
                close_block()
            continue
        if tag == "a":
            links += 1
        if tag in INLINE and tag not in SKIPPED:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            if tag in SKIPPED:
                if tag not in INLINE:
                    close_block()
                continue
        if stack and stack[-1][0] in CLOSED_BY_BLOCK or tag == "li" and stack and stack[-1][0] == "li":
            leave(len(stack) - 1)
        else:
            close_block()
        if tag in ("p", "h1", "h2", "article", "main", "body", "footer"):
            links = 0
        if tag in VOID or m[4].endswith("/"):
            continue
        values = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(m[4])} if m[4] else {}
        names = " ".join(values.get(k, "") for k in ("class", "id", "role"))
        hidden = "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "").lower()
        is_main = tag in MAIN or values.get("role") == "main" or values.get("itemprop", "").lower() == "articlebody" or bool(names and MAIN_HINT.search(names))
        is_comment = bool(names and COMMENT_TOKEN.search(names)) and tag not in ("html", "body", "main")
        is_boiler = tag in BOILER or tag == "header" and not main or hidden
        number = -1
        inside = [named[e[5]] for e in stack if e[5] >= 0]
        among = any(e[4] for e in inside)  # a bare article among comments is a comment
        if is_main and not is_comment and not (tag == "article" and among):
            hearts += 1
            for e in inside:
                e[3] += 1
        if tag == "h1":
            heads += 1
            for e in inside:
                e[2] += 1
        if not is_boiler and (is_comment or not is_main) and tag not in ("html", "body") and names and (BOILER_HINT.search(names) or WEAK_HINT.search(names)):
            number = len(named)
            named.append([0, 0, 0, 0, bool(is_comment or BOILER_HINT.search(names))])
        entry = (tag, int(is_boiler), int(is_main), int(tag in SKIPPED), tag in ("p", "li", "blockquote", "pre", "td", "dd", "dt") or tag in CLOSED_BY_BLOCK, number)
        stack.append(entry)
        boiler, main, skipped = boiler + entry[1], main + entry[2], skipped + entry[3]
    close_block()
    half = sum(b[1] for b in out if not b[3]) / 2

    def marks(words: int, linked: int, own_heads: int, own_hearts: int, strong: bool) -> bool:
        if strong:
            return own_hearts < hearts or hearts == 0 and (own_heads < heads or heads != 1)
        return words < half or 2 * linked > words

    marked = [marks(*e) for e in named]
    return [(*b[:3], int(b[3] or any(marked[k] for k in b[6])), *b[4:6]) for b in out]


def main_text(page: str) -> str:
    found, kept, root = blocks(page), [], tree()
    none = ("", 0, 0.0, 0, 0, 0)
    for k, b in enumerate(found):
        before, after = found[k - 1] if k else none, found[k + 1] if k + 1 < len(found) else none
        if classify(root, (b[1], b[2], before[1], before[2], after[1], after[2], b[3], b[4], b[5])):
            kept.append(b[0])
    return " ".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``: page_id, url, text, n_chars (code points of the text).

    The whole page is read; null and empty pages, and those without main text, have an empty text. Ids and urls are
    carried along, null or repeated as they are; an empty table gives an empty result; other columns aren't looked at.
    """

    def texts(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                found = [main_text(h.as_py() or "") for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.selectExpr(f"cast(`{id_col}` as long) page_id", f"`{url_col}` url", f"`{html_col}` html")
    return rows.mapInArrow(texts, "page_id long, url string, text string, n_chars long")
