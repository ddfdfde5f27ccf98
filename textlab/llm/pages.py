"""Main text of web pages by two-pass block rules.

First pass: every block is judged alone, by what it stands in, its link density, its length and its
stop-word density: good, bad or undecided. Stop words only count on pages in a language they are known of; on
others length and link density decide. Second pass: an undecided (short or middling) block takes the
label of its nearest decided neighbours. Good blocks are the text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Frequent function words of English, German, French and Spanish.
LANGUAGES = [
    frozenset(words.split())
    for words in (
        "the of and to in a is that for it as was with be by on not he this are or from at which but have an they you",
        "der die und in das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie",
        "le la les de des et un une du en que qui dans pour pas sur au plus par avec il elle est ce sont à a",
        """el la los las de y en que a un una del se por con no su para lo como más o pero sus le al ha me si sin sobre este
        ya es""",
    )
]
STOP_WORDS = frozenset().union(*LANGUAGES) - {"à"}

MAX_LINK_DENSITY = 0.2
ARTICLE_LINK_DENSITY = 0.5
SHORT = 70
LONG = 200
STOP_HIGH = 0.32
STOP_LOW = 0.20
STOP_ARTICLE = 0.10
STOP_PAGE = 0.25  # share of one language's words from which a page counts as written in it

TEXT_ONLY = frozenset("script style textarea title".split())  # hold no elements; not closed, they reach to the end of the page
HIDDEN = frozenset("noscript template iframe svg select object canvas".split())  # closed by "/>" too; not closed, only the tag goes
NAME = re.compile(r"<(/?)([a-z][a-z0-9:-]*)(?=[\s/>])", re.IGNORECASE)  # a name ends here: <title-bar> is no <title>
SPOT = re.compile("""[>"']""")
BARE_VALUE = re.compile(r"""=\s*[^\s"']*/\Z""")  # a slash that belongs to a value without quotes
HREF = re.compile(r"(?:^|[\s\"'/])href\s*=", re.IGNORECASE)
UNSEEN = re.compile(r"""(?:^|[\s"'/])(?:hidden(?=[\s/=]|\Z)|style\s*=\s*(?:"[^"]*?|'[^']*?|[^\s>]*?)(?:display\s*:\s*none|visibility\s*:\s*hidden))""", re.IGNORECASE)
WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\U00020000-\U0003ffff]")  # characters that say as much as several letters
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
COPYRIGHT = re.compile("(?:copyright\\b|\\(c\\)|\N{COPYRIGHT SIGN})", re.IGNORECASE)
WORD = re.compile(r"[^\W\d_]+")
PIECE = re.compile(r"[a-z]+")

BLOCKS = frozenset(
    """address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table
    tbody td tfoot th thead tr ul label""".split()
)
CONTAINERS = BLOCKS - frozenset("p li dt dd hr h1 h2 h3 h4 h5 h6 option body html head tr td th tbody thead tfoot".split())
OUTSIDE = frozenset("nav aside footer dialog menu button fieldset".split())
HINTS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent
    gdpr notice notices popup modal newsletter subscribe subscription signup login sidebar menu nav navbar navigation
    breadcrumb breadcrumbs footer comment comments reply replies respond disqus related recommended recommendations share
    sharing social widget toolbar pagination pager search copyright complementary contentinfo paywall skip""".split()
)
LAYOUT = frozenset("with has no without main content page layout wrapper container".split())
COMMENT = frozenset("comment reply".split())
POST = frozenset("post entry hentry open status".split())  # an article that may be commented on
SOCIAL = frozenset("share sharing media links link icons icon buttons button bar follow list widget menu networks block box count counts".split())


@dataclass
class Block:
    """Text between two block boundaries."""

    article: int  # which article it stands in; 0 for none
    outside: bool  # in a menu, a hidden element or the like, or in a form or box that holds no main text
    form: int = 0  # which form it stands in; 0 for none
    box: int = 0  # the innermost container whose class or id speaks against it; 0 for none
    header: bool = False  # in a header of the page
    heading: bool = False  # and there its h1
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    label: str = ""


@dataclass
class Place:
    """Where the scan stands: what a block that begins here stands in."""

    article: int = 0
    outside: bool = False
    form: int = 0
    box: int = 0
    header: bool = False


class Scanner:
    """Markup of a page, piece by piece, in time that follows the page: nothing is looked for twice.

    A tag ends at the first ``>`` outside quotes, or where quotes are not closed at the first one.
    """

    def __init__(self, page: str):
        self.page = page
        self.next: dict[str, int] = {}  # the last place found of each thing looked for
        self.open_quotes: set[int] = set()  # from these quotes on no tag ends

    def find(self, what: str, start: int) -> int:
        """``str.find`` for starts that never go back; the page's length where there is none."""
        at = self.next.get(what, -1)
        if at < start:
            at = self.page.find(what, start)
            at = self.next[what] = len(self.page) if at < 0 else at
        return at

    def tag_end(self, start: int) -> int:
        """Behind the ``>`` of a tag whose name ends at ``start``; 0 for none."""
        first = self.find(">", start)
        if first == len(self.page):
            return 0
        passed, at = [], start
        while spot := SPOT.search(self.page, at):
            if spot[0] == ">":
                return spot.end()
            if spot.start() in self.open_quotes:
                break
            passed.append(spot.start())
            at = self.find(spot[0], spot.end()) + 1
            if at > len(self.page):
                break
        self.open_quotes.update(passed)
        return first + 1

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """Start, end, name (empty for what is no element), whether it closes one, and the attributes."""
        page, lower, end = self.page, None, 0
        while (start := page.find("<", end)) >= 0:
            if page.startswith("<!--", start):
                end = min(len(page), self.find("-->", start + 4) + 3)
                yield start, end, "", False, ""
                continue
            name = NAME.match(page, start)
            if not name:
                # Declarations and odd closing tags go, any other "<" is text.
                close = self.find(">", start) if page[start + 1 : start + 2] in ("!", "?", "/") else len(page)
                end = start + 1
                if close < len(page):
                    end = close + 1
                    yield start, end, "", False, ""
                continue
            end = self.tag_end(name.end())
            if not end:
                end = start + 1
                continue
            tag, attributes = name[2].lower(), page[name.end() : end - 1]
            if tag in TEXT_ONLY and not name[1]:
                if lower is None:
                    lower = page.lower()
                    if len(lower) != len(page):  # places must stay
                        lower = page.translate(FOLD)
                end = self._closed(lower, tag, end)
            yield start, end, tag, bool(name[1]), attributes

    def _closed(self, lower: str, tag: str, start: int) -> int:
        """Behind the closing tag of an element that holds text only, or the page's end."""
        at = self.next.get("</" + tag, -1)
        while at < len(lower):
            if at < start:
                at = lower.find("</" + tag, start)
                at = len(lower) if at < 0 else at
                self.next["</" + tag] = at
                continue
            close = self.find(">", at)
            if lower[at + 2 + len(tag) : close].strip() == "" and close < len(lower):
                return close + 1
            start = at + 1
        return len(lower)


FOLD = {c: c + 32 for c in range(65, 91)}


def _tokens(attributes: str) -> list[set[str]]:
    """The words of each name in class, id, role and label."""
    return [set(PIECE.findall(token)) for m in NAMES.finditer(attributes) for token in m[1].lower().split()]


def _speaks_against(tag: str, tokens: list[set[str]]) -> bool:
    """Whether a class, id, role or label hints at a menu, notice, advert or the like."""
    names = set().union(*tokens)
    if tag in ("article", "main") or names & LAYOUT:
        return False
    return any(hints - {"social"} or ("social" in token and token <= SOCIAL | {"social"}) for token in tokens if (hints := token & HINTS))


def _hidden_ends(found: list[tuple[int, int, str, bool, str]]) -> dict[int, int]:
    """Start of each hidden element that is closed, and where it ends; a closing tag belongs to the nearest open one."""
    ends: dict[int, int] = {}
    still_open: dict[str, list[int]] = {}
    for start, end, tag, closes, attributes in found:
        if tag in HIDDEN:
            starts = still_open.setdefault(tag, [])
            if closes:
                if starts:
                    ends[starts.pop()] = end
            elif not (attributes.endswith("/") and not BARE_VALUE.search(attributes)):
                starts.append(start)
    return ends


def _closed_links(found: list[tuple[int, int, str, bool, str]]) -> set[int]:
    """Starts of the links that are closed before the next one opens; others end with their block."""
    closed, last = set(), -1
    for start, _, tag, closes, _ in found:
        if tag == "a":
            if closes and last >= 0:
                closed.add(last)
            last = -1 if closes else start
    return closed


def blocks(page: str) -> list[Block]:
    """The blocks of a page that hold text, in page order."""
    out: list[Block] = []
    here, stack = Place(), []
    open_at: dict[str, list[int]] = {}  # places in the stack of each open name
    articles, forms, link, link_is_closed = 0, 0, False, False
    wrapping: set[int] = set()  # forms around an article, or with long text of few links: the page's layout
    parents, holds_article = [0], [False]  # of each box
    found = list(Scanner(page))
    hidden, closed_links = _hidden_ends(found), _closed_links(found)
    now = Block(0, False)

    def close(outside: bool = False, heading: bool = False) -> None:
        nonlocal now, link
        now.text = " ".join("".join(now.pieces).split())
        if now.text:
            out.append(now)
            if now.form and not now.outside and length(now.text) > LONG and _link_density(now) <= MAX_LINK_DENSITY:
                wrapping.add(now.form)
        now = Block(here.article, here.outside or outside, here.form, here.box, here.header, heading and here.header)
        link = link and link_is_closed

    def write(text: str) -> None:
        if text:
            text = html.unescape(text)
            now.pieces.append(text)
            if link:
                now.linked += len("".join(text.split()))

    at = 0
    for start, end, tag, closes, attributes in found:
        if start < at:  # inside a hidden element
            continue
        write(page[at:start])
        at = end
        if tag in TEXT_ONLY and not closes:
            if tag == "title":
                close()
            continue
        if tag in HIDDEN:
            at = hidden.get(start, end)
        elif tag == "br":
            now.pieces.append(" ")
        elif tag == "a":
            link_is_closed = start in closed_links
            link = not closes and (link_is_closed or bool(HREF.search(attributes)))
        if tag not in BLOCKS:
            continue
        if closes:
            if open_at.get(tag):
                depth = open_at[tag][-1]
                here = stack[depth][1]
                for name, _ in reversed(stack[depth:]):
                    open_at[name].pop()
                del stack[depth:]
            close()
            continue
        tokens = _tokens(attributes) if attributes else []
        names = set().union(*tokens)
        is_comment = tag == "article" and bool(names & COMMENT) and not names & POST
        outside = tag in OUTSIDE or is_comment or bool(attributes and UNSEEN.search(attributes))
        against = _speaks_against(tag, tokens)
        if tag in CONTAINERS:
            open_at.setdefault(tag, []).append(len(stack))
            stack.append((tag, here))
            here = Place(here.article, here.outside or outside, here.form, here.box, here.header)
            if not here.article and (tag == "header" or "header" in names or "masthead" in names):
                here.header = True
            if against:
                parents.append(here.box)
                holds_article.append(False)
                here.box = len(parents) - 1
            if tag == "form" and not here.form:
                forms += 1
                here.form = forms
            if tag in ("article", "main") and not here.article and not here.outside:
                articles += 1
                here.article = articles
                wrapping.add(here.form)
                holds_article[here.box] = True
            close()
        else:
            close(outside or against, tag == "h1")
    write(page[at:])
    close()
    refused = _refused_boxes(out, parents, holds_article, bool(articles))
    for block in out:
        in_form = bool(block.form) and block.form not in wrapping
        in_header = block.header and not block.article and not (block.heading and not articles)
        block.outside = block.outside or refused[block.box] or in_form or in_header
    return out


def _refused_boxes(found: list[Block], parents: list[int], holds_article: list[bool], any_article: bool) -> list[bool]:
    """Which boxes do not count as text. A box around an article is layout, and so is, on a page without any, one
    that holds most of the long text of few links."""
    own, everything = [0] * len(parents), 0
    for block in found:
        if not block.outside and length(block.text) >= SHORT and _link_density(block) <= MAX_LINK_DENSITY:
            own[block.box] += len(block.text)
            everything += len(block.text)
    for box in range(len(parents) - 1, 0, -1):  # a box is numbered after the one around it
        own[parents[box]] += own[box]
        holds_article[parents[box]] |= holds_article[box]
    refused = [False] * len(parents)
    for box in range(1, len(parents)):
        layout = holds_article[box] if any_article else 2 * own[box] > everything
        refused[box] = refused[parents[box]] or not layout
    return refused


def length(text: str) -> int:
    """Characters, those of scripts without letters threefold."""
    return len(text) if text.isascii() else len(text) + 2 * len(WIDE.findall(text))


def _link_density(block: Block) -> float:
    return block.linked / max(1, len(block.text.replace(" ", "")))


def in_known_language(found: list[Block]) -> bool:
    """Whether the text outside menus has as many of one language's stop words as prose has."""
    words: list[str] = []
    for block in found:
        if not block.outside and length(block.text) >= SHORT and _link_density(block) <= MAX_LINK_DENSITY:
            words += WORD.findall(block.text.lower())
    return bool(words) and max(sum(map(stops.__contains__, words)) for stops in LANGUAGES) >= STOP_PAGE * len(words)


def judge_alone(block: Block, known: bool = True) -> str:
    """good, bad or undecided by the block's own figures; ``outside`` for what its place decides.

    ``known`` says that the page is in a language whose stop words are known.
    """
    if block.outside:
        return "outside"
    size, density = length(block.text), _link_density(block)
    # In an article links, length and stop words weigh less than elsewhere.
    links, stops_wanted = (ARTICLE_LINK_DENSITY, STOP_ARTICLE) if block.article else (MAX_LINK_DENSITY, STOP_HIGH)
    if density > (links if size >= SHORT else ARTICLE_LINK_DENSITY):
        return "bad"
    if not block.article and COPYRIGHT.match(block.text) and size < LONG:
        return "bad"
    if size < SHORT:
        return "undecided"
    long_enough = block.article or size > LONG
    if not known:
        return "good" if long_enough else "undecided"
    words = WORD.findall(block.text.lower())
    stops = sum(map(STOP_WORDS.__contains__, words)) / max(1, len(words))
    if long_enough and stops >= stops_wanted:
        return "good"
    return "undecided" if block.article or stops >= STOP_LOW or size > LONG and not block.linked else "bad"


def judge_by_neighbours(found: list[Block]) -> None:
    """Undecided blocks take the label of the nearest decided block of the same article (or of none).

    At equal distance, and where nothing is decided, text in an article is good and other text is bad. On a
    page where no text at all was found good, undecided text that is not short is good.
    """
    if not any(b.label == "good" for b in found):
        for block in found:
            if block.label == "undecided" and length(block.text) >= SHORT:
                block.label = "good"
    inherited: dict[int, str] = {}
    for article in {b.article for b in found}:
        own = [(i, b) for i, b in enumerate(found) if b.article == article and not b.outside]
        decided = [(i, b.label) for i, b in own if b.label != "undecided"]
        at = 0
        for i, block in own:
            while at < len(decided) and decided[at][0] < i:
                at += 1
            if block.label != "undecided":
                continue
            near = sorted((abs(j - i), label) for j, label in decided[max(0, at - 1) : at + 1])
            if not near or len(near) == 2 and near[0][0] == near[1][0] and near[0][1] != near[1][1]:
                inherited[i] = "good" if article else "bad"
            else:
                inherited[i] = near[0][1]
    for i, label in inherited.items():
        found[i].label = label


def main_text(page: str | None) -> str:
    """Good blocks in page order, a line each; empty for a page without any."""
    found = blocks(page or "")
    known = in_known_language(found)
    for block in found:
        block.label = judge_alone(block, known)
    judge_by_neighbours(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and main text of every page, row-local and without a shuffle.

    A null or empty page has an empty text; repeated rows and urls are answered each; an empty table gives no rows.
    Script, style, markup, hidden elements, menus, forms without long text, notices, adverts and comments go, and what
    the block rules find bad: text of many links and, outside an article and in the known languages, text of up to
    200 characters with few stop words. A class or id that hints at one of these does not count on a container that
    holds the article, or on a page without any most of the text. No kept block is cut. Very long and broken pages
    take time that follows their length. Other columns of ``pages`` are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(p) for p in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=schema.names)

    return rows.mapInArrow(extract, schema)
