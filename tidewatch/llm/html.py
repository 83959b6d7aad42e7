"""Main text of web pages from the events of the standard library's HTML parser.

The events are laid out as lines, a new one at each block element. Each line gets its ratio of text to tags; a Gaussian
smooths the ratios along the page, and lines over a threshold form clusters. The container (the innermost article or main, or
else the body) whose clusters hold most text is the content region, with the text of a main or article around it; in a body
without either the region reaches as far as the groups that hold its clusters do. From the region go the blocks that pages mark
as something else, and menus that aren't marked: runs of lines that are links and nothing else, most of them outside all
clusters. No other block is dropped, however short.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Elements that never hold main text.
NOT_TEXT = frozenset("script style noscript template iframe object svg canvas audio video math head title".split())
NOT_MAIN = frozenset("nav footer aside form button select textarea menu dialog fieldset".split())
#: Elements that begin and end a line.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that group a page's blocks; those right in the body are grouped by it.
GROUPS = frozenset("div section article main center".split())
#: Elements across which an end tag of something inline doesn't reach.
WALLS = frozenset("article main body table nav footer aside form".split())
PASSES_WALLS = frozenset("html body article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a following one of the same group ends, when its end tag is left out.
ENDED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Words of class, id or role that mark a block as something else than main text.
MARKS = frozenset("ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion comment comments respond reply replies discussion disqus sidebar side widget related recommended share sharing social newsletter subscribe subscription signup cookie cookies consent gdpr notice notices notification popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead header copyright legal disclaimer skip login search toolbar contentinfo complementary".split())
#: Of these, the ones that inside an article belong to it.
OWN_MARKS = frozenset(["header"])
ABOUT_OTHERS = frozenset("has with no without not is".split())
SPACE = re.compile(r"[\s ]+")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Sigma in lines of the smoothing, and the share of the mean ratio that a line of content reaches.
SIGMA, LEAST = 1.0, 0.5
#: Share of a line's characters that are in links, and lines that follow one another, in a menu at least.
LINKED, MENU = 0.9, 3

PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def marks(value: str) -> set[str]:
    """The words of a class, id or role; not those of names like has-sidebar, which tell what stands elsewhere."""
    each = [[x.lower() for x in PARTS.findall(name)] for name in value.split()]
    return {x for words in each if words and words[0] not in ABOUT_OTHERS for x in words}


class Line:
    """A line of a page: its text so far, its tags, its characters in links, and where it stands."""

    __slots__ = ("parts", "tags", "linked", "container", "out", "block", "group")

    def __init__(self, container: int, out: bool, block: str, group: int):
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.container, self.out, self.block, self.group = container, out, block, group


class Lines(HTMLParser):
    """Lays a page's events out as lines, in time that is in proportion to the events however deep elements stand."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines = [Line(0, False, "", -1)]
        self.open: list[tuple[str, bool, int, int]] = []  # element, whether it's left out, container, group
        self.at: dict[str, list[int]] = {}  # of each element, where in open it stands; also of all WALLS and of what ends no p
        self.containers = 1
        self.around: dict[int, int] = {}  # of a container the one it is in
        self.above: list[int] = []  # of a group the one it is in
        self.behind: list[int] = []  # of a group the number of the first that is no longer in it

    def _kinds(self, tag: str) -> list[str]:
        kinds = [tag]
        if tag in WALLS:
            kinds.append("*wall")
        if tag != "p" and (tag in BLOCKS or tag in NOT_TEXT):
            kinds.append("*block")
        return kinds

    def _last(self, kind: str) -> int:
        found = self.at.get(kind)
        return found[-1] if found else -1

    def _push(self, tag: str, out: bool, container: int, group: int) -> None:
        for kind in self._kinds(tag):
            self.at.setdefault(kind, []).append(len(self.open))
        self.open.append((tag, out, container, group))

    def _pop_from(self, i: int) -> None:
        while len(self.open) > i:
            tag, _, _, group = self.open.pop()
            for kind in self._kinds(tag):
                self.at[kind].pop()
            if tag in GROUPS:
                self.behind[group] = len(self.above)

    def _line(self, block: str = "") -> None:
        _, out, container, group = self.open[-1] if self.open else ("", False, 0, -1)
        last = self.lines[-1]
        if last.parts:
            self.lines.append(Line(container, out, block, group))
        else:
            last.container, last.out, last.block, last.group = container, out, block, group

    def _out(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in NOT_TEXT or tag in NOT_MAIN:
            return True
        inside = bool(self.at.get("article") or self.at.get("main"))
        if tag == "header" and not inside:
            return True
        for name, value in attrs:
            if name in ("hidden",) or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in (value or "").replace(" ", "")):
                return True
            if name in ("class", "id", "role") and tag not in ("body", "html", "article", "main") and (MARKS - OWN_MARKS if inside else MARKS) & marks(value or ""):
                return True
        return False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.lines[-1].tags += 1
        if tag in VOID:
            if tag == "hr":
                self._line()
            elif tag == "br":
                self.lines[-1].parts.append(" ") if self.lines[-1].parts else None
            return
        while self.open and tag in ENDED_BY.get(self.open[-1][0], ()):
            self._pop_from(len(self.open) - 1)
        if tag in BLOCKS and self._last("p") > self._last("*block"):  # an open p ends at a block, with what is open in it
            self._pop_from(self._last("p"))
        _, out, container, group = self.open[-1] if self.open else ("", False, 0, -1)
        out = out or self._out(tag, attrs)
        if tag in ("article", "main"):
            self.around[self.containers] = container
            container, self.containers = self.containers, self.containers + 1
        if tag in GROUPS:
            self.above.append(group)
            self.behind.append(0)
            group = len(self.above) - 1
        self._push(tag, out, container, group)
        if tag in BLOCKS or tag in NOT_TEXT or out:
            self._line(tag)

    def handle_endtag(self, tag: str) -> None:
        self.lines[-1].tags += 1
        i = self._last(tag)
        if i < 0 or (tag not in PASSES_WALLS and self._last("*wall") > i):
            return
        out = self.open[i][1]
        self._pop_from(i)
        if tag in BLOCKS or tag in NOT_TEXT or out:
            self._line()

    def handle_data(self, data: str) -> None:
        line = self.lines[-1]
        if self.open and self.open[-1][1]:
            line.out = True
        if self.at.get("a"):
            line.linked += len(data.strip())
        line.parts.append(data)

    def close(self) -> None:
        super().close()
        self._pop_from(0)


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def clusters(sizes: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Which lines are in a cluster: their smoothed ratio of text to tags reaches LEAST of the mean."""
    ratio = smooth(sizes / np.maximum(1, tags))
    return (sizes > 0) & (ratio >= LEAST * ratio.mean())


def menus(texts: list[str], lines: list[Line], content: np.ndarray) -> np.ndarray:
    """Which lines are in a run of MENU or more that are nothing but links, most of them outside all clusters."""
    link = np.array([bool(x) and line.linked >= LINKED * len(x) for x, line in zip(texts, lines, strict=True)])
    out, i = np.zeros(len(texts), bool), 0
    shown = [k for k, x in enumerate(texts) if x and not lines[k].out]
    while i < len(shown):
        j = i
        while j < len(shown) and link[shown[j]]:
            j += 1
        if j - i >= MENU and 2 * content[shown[i:j]].sum() < j - i:
            out[shown[i:j]] = True
        i = max(j, i + 1)
    return out


def main_text(html: str) -> str:
    """The blocks of the content region in page order, two newlines between."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = parser.lines
    texts = [SPACE.sub(" ", "".join(x.parts)).strip() for x in lines]
    there = [i for i, (x, line) in enumerate(zip(texts, lines, strict=True)) if x or line.tags]
    lines, texts = [lines[i] for i in there], [texts[i] for i in there]
    if not lines:
        return ""
    sizes = np.array([0 if line.out else len(x) for x, line in zip(texts, lines, strict=True)], float)
    content = clusters(sizes, np.array([x.tags for x in lines]))
    weight: dict[int, float] = {}
    for line, size, chosen in zip(lines, sizes, content, strict=True):
        weight[line.container] = weight.get(line.container, 0) + size * chosen
    inner = {c: w for c, w in weight.items() if c and w}
    if inner:
        best = max(inner, key=inner.get)
        chosen = {best}
        while best := parser.around[best]:
            chosen.add(best)
        inside = [x.container in chosen for x in lines]
    else:
        at = np.flatnonzero(content)
        if not len(at):
            return ""
        first = at[0]
        while first and (lines[first - 1].block in HEADINGS or not texts[first - 1]) and not lines[first - 1].out:
            first -= 1  # headings belong to what they stand over
        holding = {lines[i].group for i in at}
        shared = min(holding)  # the innermost group around all of them
        while shared >= 0 and max(holding) >= parser.behind[shared]:
            shared = parser.above[shared]
        inside = [first <= i <= at[-1] or x.group in holding or (shared >= 0 and shared <= x.group < parser.behind[shared]) for i, x in enumerate(lines)]
    menu = menus(texts, lines, content)
    return "\n\n".join([x for x, line, of, m in zip(texts, lines, inside, menu, strict=True) if of and x and not line.out and not m])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of pages.

    A null or empty html gives an empty text; a null url stays null; repeated rows each get their row; of the columns only
    page_id, url and html are read. Broken or cut markup is read as far as it goes; a page's length and the depth of its
    elements only add to the time in proportion.
    """

    def make(batch: pa.RecordBatch) -> dict:
        texts = [main_text(x or "") for x in batch["html"].to_pylist()]
        return {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": list(map(len, texts))}

    return common.own_columns(pages, ["page_id", "url", "html"]).mapInArrow(common.per_batch(PAGE, make), "page_id long, url string, text string, n_chars long")
