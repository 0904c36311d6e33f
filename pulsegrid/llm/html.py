"""Main-text extraction from raw pages by text-to-tag ratios.

The standard library's parser streams a page's events. Block elements cut its text into lines; each line
has a text-to-tag ratio. The ratios are smoothed with a Gaussian kernel and the lines are clustered by a
threshold into content and the rest (Weninger et al., "CETR: Content Extraction via Tag Ratios", 2010).
The smallest region of the page that covers all content lines is chosen: a short paragraph between long ones
is not lost, nor is any part of a story in several regions. Within it a run of list items that are links alone goes
where the clusters find no content in it. Markup is a hint: an article or main element around that region
widens it and never narrows it, and elements whose tag, class or id names a part that is no article text are
left out, unless they hold the page's only article.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import map_rows

# Element and class names of the markup.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
REGIONS = frozenset("article main section div body td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("aside button canvas dialog footer form head iframe input math menu nav noscript object script select style svg template textarea title".split())
#: Elements that the start of another ends, where their own end is missing.
ENDS_P = BLOCKS - frozenset("td th tr li dd dt caption option".split())
P_STAYS = ("article", "main", "section", "div", "body", "td", "li", "blockquote")
SAME_STAYS = ("ul", "ol", "dl", "table", "select")
SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
OUT_NAMES = (
    r"ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side-bar|aside|nav|navbar|navigation|menu|breadcrumbs?|footer|masthead|site-header|page-header|"
    r"cookies?|consent|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|comments?|replies|respond|disqus|widget|toolbar|pagination|pager"
)
#: Names that mean a page's own parts outside an article, but may hold its title inside one.
PAGE_NAMES = r"header|head|top-?bar|hero"
#: Parts that readers wrote.
COMMENT_NAMES = r"comments?|repl(?:y|ies)|respond|disqus"
#: An article element may be named after its layout, so fewer names count there.
ARTICLE_NAMES = r"advert\w*|sponsor\w*|promo\w*|comments?|repl(?:y|ies)|related|teaser"
#: Words that say where or how an element stands; beside a name they leave it the name of a page's part.
LAYOUT = (
    r"\d+|area|bar|block|body|bottom|box|button|buttons|card|cards|container|content|float|form|global|grid|group|head|header|holder|icons?|inline|inner|item|items|left|links?|list|main|mid|"
    r"module|outer|page|panel|post|posts|primary|right|row|section|side|site|slot|stories|top|unit|wrap|wrapper"
)
#: Elements of running text, and those that stand for a part of it; their ids are often made from a heading.
RUNNING = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd blockquote pre".split())
SLUGGED = RUNNING | {"section", "article"}


def _named(names: str) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """One of the names as a word of the value, one of them as a whole value, and one of them or a word of layout."""
    return (
        re.compile(rf"(?:^|[\s_-])(?:{names})(?:$|[\s_-])", re.I),
        re.compile(rf"(?:{names})", re.I),
        re.compile(rf"(?:{names}|{LAYOUT})", re.I),
    )


OUT_CLASS, OUT_PAGE, OUT_ARTICLE, OUT_COMMENTS = _named(OUT_NAMES), _named(PAGE_NAMES), _named(ARTICLE_NAMES), _named(COMMENT_NAMES)
OUT_ROLE = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

#: Standard deviation of the smoothing kernel in lines, and the threshold in deviations of the ratios.
SIGMA = 1.0
THRESHOLD = 0.5
#: List items of links alone, one after another, that are a menu where their ratios are below the threshold.
MENU_LINES = 4


def _left_out(named: tuple[re.Pattern, re.Pattern, re.Pattern], tag: str, attribute: str, value: str, inside: bool) -> bool:
    """Whether a class or id names a part that is no article text: by all words of a class, so no-sidebar does not."""
    word, whole, part = named
    if not word.search(value):
        return False
    if attribute == "id" and (inside or tag in SLUGGED):
        return bool(whole.fullmatch(value.strip()))
    if attribute == "class" and tag in RUNNING:
        return any(whole.fullmatch(v) for v in value.split())
    return any(word.search(v) and all(part.fullmatch(w) for w in re.split("[_-]+", v) if w) for v in value.split())


class _Events(HTMLParser):
    """Collects lines with what they stand in: regions, links, and elements that are left out by their names.

    The work for an event does not grow with the number of open elements: their places are kept by name.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, int]] = []  # name, left out by tag or role, region, named element
        self.open: defaultdict[str, list[int]] = defaultdict(list)  # places of open elements in the stack
        self.regions: list[tuple[str, int, int]] = [("page", -1, -1)]  # name, the region around, named element
        self.named: list[tuple[int, bool]] = []  # elements left out by class or id: the one around, reader comments
        self.texts: list[str] = []
        self.linked = True  # all text of the line so far is in links
        self.tags = 0
        self.lines: list[tuple[str, int, int, bool, bool, int]] = []  # text, tags, region, in links alone, in a list, named element

    def updatepos(self, i, j):
        """Line numbers are not needed."""
        return j

    def _state(self) -> tuple[bool, int, int]:
        return self.stack[-1][1:] if self.stack else (False, 0, -1)

    def _last(self, names) -> int:
        """The place of the innermost open element of one of the names, or -1."""
        return max((self.open[n][-1] for n in names if self.open[n]), default=-1)

    def _cut(self, at: int) -> None:
        for name, *_ in reversed(self.stack[at:]):
            self.open[name].pop()
        del self.stack[at:]

    def flush(self) -> None:
        out, region, named = self._state()
        if self.texts:
            text = " ".join("".join(self.texts).split())
            if text and not out:
                self.lines.append((text, self.tags, region, self.linked, bool(self.open["li"]), named))
            self.texts = []
            self.linked = True
        self.tags = 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS or tag in LEFT_OUT:
            self.flush()
        if tag in ENDS_P and self._last(("p",)) > self._last(P_STAYS):
            self._cut(self._last(("p",)))
        if tag in SAME and self._last(SAME[tag]) > self._last(SAME_STAYS):
            self._cut(self._last(SAME[tag]))
        self.tags += 1
        if tag == "br":
            self.texts.append(" ")
        if tag in VOID:
            return
        out, region, named = self._state()
        if not out:
            outside = not self.open["article"]
            inside = not outside or bool(self.open["main"])
            out = tag in LEFT_OUT or (tag == "header" and outside)
            by_name = comments = False
            for name, value in attrs:
                if name in ("class", "id") and value and tag not in ("html", "body", "main"):
                    by_name = by_name or _left_out(OUT_ARTICLE if tag == "article" else OUT_CLASS, tag, name, value, inside)
                    by_name = by_name or (outside and tag != "article" and _left_out(OUT_PAGE, tag, name, value, inside))
                    comments = comments or _left_out(OUT_COMMENTS, tag, name, value, inside)
                elif name == "role" and value in OUT_ROLE or name == "hidden" or name == "aria-hidden" and value == "true":
                    out = True
            if by_name:
                self.named.append((named, comments))
                named = len(self.named) - 1
        if tag in REGIONS and not out:
            self.regions.append((tag, region, named))
            region = len(self.regions) - 1
        self.open[tag].append(len(self.stack))
        self.stack.append((tag, out, region, named))

    def handle_endtag(self, tag):
        if tag in BLOCKS or tag in LEFT_OUT:
            self.flush()
        self.tags += 1
        at = self._last((tag,))
        # an end without its start does not close the article around it
        if at >= 0 and (tag in ("html", "body") or at >= self._last(("article", "main", "body"))):
            self._cut(at)

    def handle_data(self, data):
        self.texts.append(data)
        if self.linked and not data.isspace():
            self.linked = bool(self.open["a"])


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing with weights normalised at the ends."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def content_lines(lines: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Which lines the threshold puts into the content cluster, and which of them also without smoothing."""
    ratios = np.array([len(text) / max(1, tags) for text, tags, *_ in lines], np.float64)
    least = THRESHOLD * ratios.std()
    content = smooth(ratios) >= least
    return content, content & (ratios >= least)


def _sums(parents: list[int], own: list[int]) -> list[int]:
    """Each node's own number and those of all nodes below it; a parent comes before its children."""
    out = own.copy()
    for i in range(len(parents) - 1, -1, -1):
        if parents[i] >= 0:
            out[parents[i]] += out[i]
    return out


def _without_named(events: _Events) -> list[tuple[str, int, int, bool, bool]]:
    """The lines outside elements that are left out by name.

    Where the only articles, or all of several lines of text, are in such elements, the names meant something
    else and these elements stay; readers' comments do not.
    """
    lines, regions, named = events.lines, events.regions, events.named
    if not named:
        return [line[:-1] for line in lines]
    stays = [False] * len(named)
    chars = [0] * len(regions)
    count = [0] * len(named)
    for text, _, region, _, _, at in lines:
        chars[region] += len(text)
        if at >= 0:
            count[at] += 1
    chars, count = _sums([around for _, around, _ in regions], chars), _sums([around for around, _ in named], count)
    articles = [i for i, (name, _, _) in enumerate(regions) if name in ("article", "main") and chars[i]]
    if articles and all(regions[i][2] >= 0 for i in articles):
        at = regions[max(articles, key=lambda i: (chars[i], -i))][2]
        while at >= 0:
            stays[at] = not named[at][1]
            at = named[at][0]
    elif not articles and all(at >= 0 for *_, at in lines):
        stays = [n >= MENU_LINES and not comments for n, (_, comments) in zip(count, named, strict=True)]
    out = [False] * len(named)
    for i, (around, _) in enumerate(named):
        out[i] = not stays[i] or around >= 0 and out[around]
    return [line[:-1] for line in lines if line[-1] < 0 or not out[line[-1]]]


def _menus(lines: list[tuple], content: np.ndarray) -> np.ndarray:
    """Which lines are in a run of MENU_LINES or more list items of links alone, none of which is content by itself."""
    out = np.zeros(len(lines), bool)
    linked = np.array([line[3] and line[4] for line in lines])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], linked.view(np.int8), [0]])))
    for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
        if b - a >= MENU_LINES and not content[a:b].any():
            out[a:b] = True
    return out


def main_text(page: str | None) -> str:
    """The article's lines, joined by newlines; empty for null, empty or text-free pages."""
    if not page:
        return ""
    events = _Events()
    events.feed(page)
    events.close()
    events.flush()
    lines, regions = _without_named(events), events.regions
    if not lines:
        return ""
    content, strong = content_lines(lines)
    names = {regions[region][0] for _, _, region, *_ in lines} | {name for name, _, named in regions if named < 0}
    around = [r[1] for r in regions]
    hint = next((n for n in ("article", "main") if n in names), None)
    hinted = [hint is None] * len(regions)
    for i, (name, over, _) in enumerate(regions):
        hinted[i] = hinted[i] or name == hint or over >= 0 and hinted[over]
    # a line that is content only by the lines beside it does not widen the region if it is a link or outside the hint
    deciding = strong | content & np.array([hinted[region] and not linked for _, _, region, linked, _ in lines])
    if not deciding.any():
        deciding = content if content.any() else np.ones(len(lines), bool)
    held = [0] * len(regions)
    for at in np.flatnonzero(deciding).tolist():
        held[lines[at][2]] += 1
    held = _sums(around, held)  # a line counts for all regions around it
    chosen = max(i for i in range(len(regions)) if held[i] == held[0])  # such regions lie in each other; the innermost
    chain = [chosen]
    while around[chain[-1]] >= 0:
        chain.append(around[chain[-1]])
    for name in ("article", "main"):
        wider = [i for i in chain if regions[i][0] == name]
        if wider:
            chosen = wider[-1]
            break
    # of a whole page, parts without any content before the first and after the last content line are its frame
    whole = regions[chosen][0] not in ("page", "body")
    first, last = np.flatnonzero(deciding)[[0, -1]].tolist()
    inside, frame = [False] * len(regions), [False] * len(regions)
    for i, over in enumerate(around):
        inside[i] = i == chosen or over >= 0 and inside[over]
        frame[i] = not whole and inside[i] and i != chosen and (held[i] == 0 if over == chosen else frame[over])
    menu = _menus(lines, strong)
    return "\n".join(text for at, (text, _, region, *_) in enumerate(lines) if inside[region] and not menu[at] and not (frame[region] and not first < at < last))


def _extract():
    def step(ids: list, urls: list, pages: list) -> list[tuple]:
        texts = [main_text(p) for p in pages]
        return [(i, u, t, len(t)) for i, u, t in zip(ids, urls, texts, strict=True)]

    return step


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row, from its whole html.

    Null or empty html gives an empty text. Long pages are read whole, in time linear in their length, however
    many tags they leave open. Null ids and urls pass through; repeated rows are each returned and ties need no
    order; other columns, whatever their names, are not read. An empty table gives an empty result. Nothing is
    shuffled.
    """
    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_rows(picked, ["page_id", "url", "html"], _extract, "page_id long, url string, text string, n_chars long")
