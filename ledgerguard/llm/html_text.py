"""Operator 11, the main text of web pages by tree scoring.  One page is one row's work; Spark deals the rows.

A page becomes a tree (end tags that authors leave out are implied).  Paragraphs pass points to the blocks
that hold them: one, one for each comma and one for each hundred characters up to three, less the share
of their text inside links; the nearest block gets all, the next half, the further ones a third by distance,
five blocks up.  A block's score is its points and the weight of its tag and names, times the share of its
text outside links.  The best block is kept, or the article around it, with its siblings that hold at least a
fifth of its points; beside a block that is no article also sibling paragraphs of plain sentences; a page without
any paragraph of ``LEAST_CHARS`` characters is kept whole.  What
tags, roles or names mark as menus, headers, footers, sidebars, notices, adverts, forms or comments takes no
part, lists of links neither.

Defined cases: null or empty html, and a page without text, give an empty text; text of any length is read
whole, in time linear in it; a tag that the page's end cuts off is dropped; repeated rows give equal
results, one for each row; equal scores go to the outer, then the earlier block; null ids and urls stay; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS, SIBLING_SHARE, SIBLING_POINTS = 5, 0.2, 10.0
LEAST_CHARS, LINKED, MENU_LINKS = 25, 0.5, 3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noscript xmp noembed noframes".split())
NEVER = frozenset("""head script style title textarea iframe noscript xmp noembed noframes template nav footer aside
 form button select option object svg math canvas video audio map dialog menu datalist""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset("""html body address article aside blockquote caption center dd details dialog div dl dt fieldset
 figcaption figure footer form header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th
 thead tr ul""".split()) | HEADINGS
SCOPES = frozenset("table td th caption button object template".split())
#: Open elements that a start tag ends, and those that shield them.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
        "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)), "tr": (("tr",), ("table",)),
        "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)),
        "tfoot": (("tbody", "thead", "tfoot"), ("table",)), "option": (("option",), ("select",)), "a": (("a",), ())}
WEIGHTS = {"article": 25, "main": 15, "div": 5, "section": 5, "td": 3, "blockquote": 3, "pre": 3, "ul": -3, "ol": -3,
           "dl": -3, "li": -3, "dd": -3, "dt": -3, "address": -3, "th": -5, **dict.fromkeys(HEADINGS, -5)}
#: Blocks whose own text is a paragraph of the block around them, and those that never hold a page's text.
ITEMS = frozenset("p pre li dd dt td th figcaption caption address".split())
ROWS = frozenset("tr tbody thead tfoot".split())
#: Words in names of elements: what is never the article, what rarely is, and what often is.
STRONG = re.compile(r"comments?|commentlist|respond|disqus|ads?|adverts?|advertisements?|adsense|sponsor(ed|s)?|promos?|promotions?|"
                    r"sidebars?|cookies?|consent|gdpr|newsletters?|subscribe|subscription|signup|breadcrumbs?|nav|navbar|"
                    r"navigation|menus?|footer|pagination|pager|popups?|modal|related|recommend(ed|ations)?|share|sharing|social|"
                    r"skip|masthead|topbar|toolbar|login|search")
WEAK = re.compile(r"header|banner|notices?|alerts?|widgets?|overlay")
GOOD = re.compile(r"article|body|content|entry|hentry|main|post|story|text")
OWN_HEADER = re.compile(r"article|entry|post|story")
WITHOUT = frozenset("has have with without no hide show is".split())
ROLES = frozenset("navigation complementary contentinfo banner search dialog alertdialog alert menu menubar toolbar form".split())
COMMENTS_TITLE = re.compile(r"(?:\d+ )?(?:reader )?comments?(?: \(\d+\))?:?|leave a (?:comment|reply)|post a comment", re.I)

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|</>|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: The rest of a tag; a quotation mark that nothing closes is a plain character.
REST = re.compile(r"""((?:[^>=]|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>""")
ATTRIBUTE = re.compile(r"""([a-zA-Z][-\w:]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
SENTENCE = re.compile(r"[.!?…。！？][\"'»”’)\]]*$")

KEEP, DROP, MAYBE, HEADER, MAIN = range(5)


def named(attributes: str) -> tuple[int, int]:
    """(verdict, weight) of an element's attributes."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    role = found.get("role", "").strip().lower()
    style = found.get("style", "").replace(" ", "").lower()
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or role in ROLES:
        return DROP, 0
    if role in ("main", "article"):
        return MAIN, 25
    verdict, good, weak, header = KEEP, False, False, False
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = [w.lower() for w in WORDS.findall(name)]
        if words and words[0] in WITHOUT:
            continue
        if any(STRONG.fullmatch(w) for w in words):
            verdict = DROP
        elif any(WEAK.fullmatch(w) for w in words):
            own = "header" in words and any(OWN_HEADER.fullmatch(w) for w in words)
            weak, header = weak or not own, header or "header" in words
        elif any(GOOD.fullmatch(w) for w in words):
            good = True
    if verdict == KEEP and weak and not good:
        verdict = HEADER if header else MAYBE
    return verdict, -25 if verdict != KEEP else 25 if good else 0


class Page:
    """The tree of a page: for each node its tag, parent and verdict, and ``events`` in page order: a node's start
    (its number), its end (the number's complement) and pieces of text."""

    def __init__(self, source: str, names: dict):
        self.tag, self.parent, self.verdict, self.weight = ["#page"], [-1], [KEEP], [0]
        self.events: list = [0]
        self.first, self.last = [0], [0]
        self._stack, self._open, self._blocks, self._scopes = [0], {}, [0], []
        self._names = names
        self._read(source)
        self._close(0)

    def _close(self, depth: int) -> None:
        """Ends the open elements from this place of the stack on."""
        while len(self._stack) > depth:
            node = self._stack.pop()
            at, tag = len(self._stack), self.tag[node]
            if node:
                self._open[tag].pop()
            if self._blocks and self._blocks[-1] == at:
                self._blocks.pop()
            if self._scopes and self._scopes[-1] == at:
                self._scopes.pop()
            self.last[node] = len(self.events)
            self.events.append(~node)

    def _top(self, tag: str) -> int:
        held = self._open.get(tag)
        return held[-1] if held else -1

    def _shield(self) -> int:
        """The place of the innermost table cell or the like that end tags do not reach over."""
        s = self._scopes
        return next((x for x in reversed(s[-2:]) if self.tag[self._stack[x]] != "p"), -1) if s else -1

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS and self._scopes and self.tag[self._stack[self._scopes[-1]]] == "p":
            self._close(self._scopes[-1])
        if tag in ENDS:
            ended, shields = ENDS[tag]
            at = max(map(self._top, ended))
            if at >= 0 and at > max(map(self._top, shields), default=-1) and (tag != "a" or at > self._blocks[-1]):
                self._close(at)
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self._stack[-1])
        verdict, weight = KEEP, 0
        if attributes and tag in BLOCKS:
            if (got := self._names.get(attributes)) is None:
                if len(self._names) > 20000:
                    self._names.clear()
                got = self._names[attributes] = named(attributes)
            verdict, weight = got
        self.verdict.append(verdict)
        self.weight.append(weight)
        self.first.append(len(self.events))
        self.last.append(len(self.events) + 1)
        self.events.append(node)
        if tag in VOID:
            self.events.append(~node)
            return
        at = len(self._stack)
        self._stack.append(node)
        self._open.setdefault(tag, []).append(at)
        if tag in BLOCKS:
            self._blocks.append(at)
        if tag == "p" or tag in SCOPES:
            self._scopes.append(at)

    def _end(self, tag: str) -> None:
        at = self._top(tag)
        if at < 0 or tag not in SCOPES and tag not in ("tr", "tbody", "thead", "tfoot") and at < self._shield():
            return
        if tag in BLOCKS or tag in SCOPES or tag == "a" or at > self._blocks[-1]:
            self._close(at)

    def _read(self, s: str) -> None:
        at = 0
        while True:
            m = TOKEN.search(s, at)
            if not m:
                self._text(s[at:])
                return
            if m.start() > at:
                self._text(s[at:m.start()])
            at = m.end()
            if not m[2]:
                continue
            rest = REST.match(s, at)
            if not rest:
                return  # the page ends inside a tag
            at, tag = rest.end(), m[2].lower()
            if m[1]:
                self._end(tag)
            else:
                self._start(tag, rest[1].strip("/ \t\r\n\f"))
                if tag in RAW:
                    end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(s, at)
                    at = end.start() if end else len(s)

    def _text(self, piece: str) -> None:
        if piece:
            self.events.append(entities.unescape(piece) if "&" in piece else piece)


def _measured(page: Page):
    """For each node: its block, whether it takes no part, and of blocks the own and whole text, links and commas."""
    n = len(page.tag)
    # elements that hold the page's main part are layout, whatever their names say
    holds, has_h1 = [False] * n, [False] * n
    for i in range(n - 1, 0, -1):
        tag, up = page.tag[i], page.parent[i]
        has_h1[i] = has_h1[i] or tag == "h1"
        if tag == "main" or page.verdict[i] == MAIN or tag == "article" and has_h1[i] and page.verdict[i] == KEEP:
            holds[up] = True
        holds[up] = holds[up] or holds[i]
        has_h1[up] = has_h1[up] or has_h1[i]
    out, block, up_block, in_article, linked = [False] * n, [0] * n, [-1] * n, [False] * n, [False] * n
    for i in range(1, n):
        tag, up, verdict = page.tag[i], page.parent[i], page.verdict[i]
        in_article[i] = in_article[up] or tag == "article"
        up_block[i] = block[up]
        block[i] = i if tag in BLOCKS else block[up]
        linked[i] = linked[up] or tag == "a"
        bad = False
        if tag in ("html", "body", "main"):
            pass
        elif tag in NEVER:
            bad = not (tag == "form" and (holds[i] or has_h1[i]))
        elif tag == "header" or verdict == HEADER and tag not in HEADINGS:
            bad = not in_article[i] and not holds[i]
        elif verdict in (DROP, MAYBE):
            bad = not holds[i]
        out[i] = out[up] or bad
    own, own_links, commas, links = [0] * n, [0] * n, [0] * n, [0] * n
    node, stack = 0, []
    for e in page.events:
        if isinstance(e, str):
            if not out[node] and (size := len(" ".join(e.split()))):
                b = block[node]
                own[b] += size
                commas[b] += e.count(",") + e.count("，") + e.count("、")
                if linked[node]:
                    own_links[b] += size
        elif e >= 0:
            stack.append(node)
            node = e
            if page.tag[e] == "a" and not out[e]:
                links[block[e]] += 1
        else:
            node = stack.pop()
    whole, whole_links = own[:], own_links[:]
    for i in range(n - 1, 0, -1):
        if block[i] == i and not out[i]:
            b = up_block[i]
            whole[b] += whole[i]
            whole_links[b] += whole_links[i]
            links[b] += links[i]
    return block, up_block, out, own, own_links, commas, whole, whole_links, links


def _points(page: Page, up_block, out, own, own_links, commas) -> list[float]:
    """What each block gets from the paragraphs in it."""
    points = [0.0] * len(page.tag)
    for i, size in enumerate(own):
        tag = page.tag[i]
        if not size or out[i] or tag in HEADINGS:
            continue
        worth = (1 + commas[i] + min(size / 100, 3) if size >= LEAST_CHARS else size / 100) * (1 - own_links[i] / size)
        at = up_block[i] if tag in ITEMS else i
        for level in range(LEVELS):
            while page.tag[at] in ROWS and at > 0:
                at = up_block[at]
            if at < 0:
                break
            points[at] += worth / (1 if level == 0 else 2 if level == 1 else 3 * level)
            at = up_block[at]
    return points


def _written(page: Page, root: int, out, block) -> list[str]:
    """The texts of the blocks below a node, in page order."""
    lines, held, at, end = [], [], page.first[root], page.last[root]

    def flush():
        if line := " ".join("".join(held).split()):
            lines.append(line)
        held.clear()

    while at <= end:
        e = page.events[at]
        if isinstance(e, str):
            held.append(e)
        else:
            node = e if e >= 0 else ~e
            if e >= 0 and out[node]:
                if block[node] == node:
                    flush()
                at = page.last[node] + 1
                continue
            if block[node] == node:
                flush()
            elif page.tag[node] == "br":
                held.append(" ")
        at += 1
    flush()
    return lines


def main_text(source: str | None, names: dict | None = None) -> tuple[str, str, float]:
    """(text, tag of the best container, its score) of a page; names: a cache of element names."""
    if not source:
        return "", "", 0.0
    page = Page(source, {} if names is None else names)
    block, up_block, out, own, own_links, commas, whole, whole_links, links = _measured(page)
    points = _points(page, up_block, out, own, own_links, commas)
    best, best_score = 0, 0.0
    scores = [0.0] * len(points)
    for i, p in enumerate(points):
        if p > 0 and not out[i] and whole[i]:
            weight = WEIGHTS.get(page.tag[i], 0) + page.weight[i]
            scores[i] = (p + weight) * (1 - whole_links[i] / whole[i])
            if scores[i] > best_score:
                best, best_score = i, scores[i]
    top = best
    while top > 0 and page.tag[top] != "article":
        top = up_block[top]
    if top > 0:
        best = top
    elif points[best] < 1 and page.tag[best] != "main":
        best = 0  # no paragraph stands out
    # lists of links, and what follows a heading of comments, inside what is kept
    for i in range(1, len(out)):
        tag, up = page.tag[i], page.parent[i]
        if out[up]:
            out[i] = True
        elif i != best and links[i] >= MENU_LINKS and tag in ("ul", "ol", "dl", "div", "section", "table") and whole_links[i] > LINKED * whole[i]:
            out[i] = True
    closed: set[int] = set()
    for i in range(1, len(out)):
        up = page.parent[i]
        if up in closed:
            out[i] = True
        elif not out[i] and page.tag[i] in HEADINGS and 0 < own[i] <= 40:
            if COMMENTS_TITLE.fullmatch(" ".join(_written(page, i, out, block))):
                closed.add(up)
                out[i] = True
    bounded = page.tag[best] in ("article", "main", "body", "html", "#page")
    kept = [best]
    if best:
        for i in range(1, len(out)):
            if i == best or out[i] or block[i] != i or up_block[i] != up_block[best] or not whole[i]:
                continue
            plain = not bounded and page.tag[i] == "p" and whole_links[i] < 0.25 * whole[i] and (
                whole[i] > 80 or not whole_links[i] and SENTENCE.search(" ".join(_written(page, i, out, block))))
            if plain or points[i] * (1 - whole_links[i] / whole[i]) >= max(SIBLING_POINTS, SIBLING_SHARE * points[best]):
                kept.append(i)
    lines = [line for i in sorted(kept) for line in _written(page, i, out, block)]
    return "\n".join(lines), page.tag[best].lstrip("#") if lines else "", best_score if lines else 0.0


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, container, score of every page: its main text, the tag of the block that was chosen."""
    def run(batches):
        names: dict = {}
        for batch in batches:
            got = [main_text(h, names) for h in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"),
                                   *[pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))]],
                                  names=["page_id", "url", "text", "container", "score"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, container string, score double")
