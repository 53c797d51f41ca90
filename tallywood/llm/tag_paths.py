"""HTML main-text extraction by tag-path ratios.

A page's text is cut into blocks, each with its root-to-leaf path of block-level tags; a block that is one link, and an
element whose class or id has a listed word (``sidebar``, ``comments`` ...), show in the path as well. For every path
the text length and punctuation of its blocks are added up and divided by their number; the two ratios are smoothed
over neighbouring blocks in page order and fused. Paths whose mean fused score reaches a share of the page's mean per
character are content; all their blocks are text of the article.

Within the smallest element that holds all content, headings above and headings, list items, short paragraphs and the like
between content blocks belong to the article too, unless they are links or stand in an element with a listed word.

Elements that are no article text by their tag or role (menus, forms, scripts ...) never count. A listed class word only
is a prior: it lowers the path's ratio by a factor, so that a path that outweighs the rest of the page nevertheless wins.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import binaries, id_type, narrow, pieces

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: A quoted value opens.
QUOTED = re.compile(r"""=\s*(["'])""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
#: HTML's tag classes.
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea xmp noembed noframes".split())
CLOSES_P = BLOCK - set("html body head title option legend td th tr tbody thead tfoot dd dt li".split())
#: A start tag that ends an open element of these, up to the nearest of the others.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
#: Elements that are not the article by tag or by role, and words of a class or id that speak against it.
NOT_TEXT = set("script style noscript template iframe object svg math canvas audio video map head title nav footer aside form button select input textarea dialog menu datalist".split())
NOT_ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alertdialog toolbar".split())
NOT_WORDS = set("ad ads advert advertisement adverts adsense banner sponsor sponsored promo promotion sidebar side cookie cookies consent gdpr notice notices alert popup modal overlay comment comments disqus reply replies menu nav navbar navigation breadcrumb breadcrumbs share sharing social related recommended newsletter subscribe subscription signup login footer header masthead toolbar widget pagination pager skip".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Factor of a path's ratio for each element with a listed word, share of the page's mean score that content reaches.
PRIOR, LEAST_SHARE = 0.02, 0.2
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


#: After one of these, a class name says what an element has or lacks, not what it is.
MODIFIERS = set("has have with without no not is".split())


def unwanted(name: str) -> bool:
    """Whether a class or id has a listed word (``left-sidebar``), but not after a modifier (``has-sidebar``,
    ``page-with-comments``)."""
    for word in re.split(r"[_\-]+", name):
        if word in MODIFIERS:
            return False
        if word in NOT_WORDS:
            return True
    return False


class Page:
    """Blocks of one page, found in a single run over its tags whose time grows with the page's length alone.

    Open elements stand on a stack; for each tag the places where it stands there are kept, so that the nearest open
    element of a kind is known without a search. Elements are numbered in page order, so an element holds the numbers
    from its own to the last one given before it closed.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[int, int, str, bool]] = []  # path, innermost element, text, whether it is a heading
        self.paths: dict[tuple[int, str], int] = {}  # (path above, step) -> path
        self.listed = [0]  # of each path: steps with a listed word
        self.above = [0]  # of each element: the block-level element around it
        self.last = [0]  # of each element: the last number within it
        self.stack: list[tuple[str, int, bool, bool]] = []  # tag, number if block-level else 0, no article text, opened the text's link
        self.at: dict[str, list[int]] = defaultdict(list)  # tag -> its places on the stack
        self.open_blocks: list[tuple[int, int, int, bool]] = [(-1, 0, 0, False)]  # place on the stack, number, path, heading
        self.bad = self.inside = 0  # open elements that are no article text; open article and main elements
        self.text: list[str] = []
        self.link: list[tuple[int, int]] = []  # characters of the text seen so far, of those in links
        self.plain = self.linked = 0
        self.read(source)
        while self.stack:
            self.pop(len(self.stack) - 1)
        self.flush()

    def read(self, source: str) -> None:
        at, size = 0, len(source)
        none_after = {'"': size, "'": size}  # from here on a quote never ends
        while (i := source.find("<", at)) >= 0:
            self.add(source[at:i])
            if source.startswith("<!--", i):
                end = source.find("-->", i + 4)
                at = end + 3 if end >= 0 else size
            elif source.startswith("<![CDATA[", i):
                end = source.find("]]>", i)
                self.add(html.escape(source[i + 9 : end if end >= 0 else size], False))
                at = end + 3 if end >= 0 else size
            elif source.startswith(("<!", "<?"), i):
                end = source.find(">", i)
                at = end + 1 if end >= 0 else size
            elif not (m := NAME.match(source, i)):
                self.add("<")
                at = i + 1
            else:
                place, end = m.end(), source.find(">", m.end())
                while end >= 0 and (q := QUOTED.search(source, place, end)):
                    close = source.find(q[1], q.end()) if q.end() < none_after[q[1]] else -1
                    if close < 0:
                        none_after[q[1]] = min(none_after[q[1]], q.end())
                        break
                    place = close + 1
                    if place > end:
                        end = source.find(">", place)
                tag, rest = m[2].lower(), source[m.end() : end if end >= 0 else size]
                at = end + 1 if end >= 0 else size
                if m[1]:
                    self.close(tag)
                else:
                    self.open(tag, rest)
                    if tag in RAW:
                        stop = re.compile(rf"</{re.escape(tag)}\b", re.I).search(source, at)
                        at = stop.start() if stop else size
        self.add(source[at:])

    def add(self, text: str) -> None:
        if text:
            self.text.append(text)
            if self.at["a"]:
                self.linked += len(text.strip())
            else:
                self.plain += len(text.strip())

    def flush(self) -> None:
        if self.text:
            text = " ".join(html.unescape("".join(self.text)).split())
            if text and not self.bad:
                _, number, path, heading = self.open_blocks[-1]
                path = self.step(path, "a") if self.linked and not self.plain else path
                self.blocks.append((path, number, text, heading))
            self.text, self.plain, self.linked = [], 0, 0

    def step(self, path: int, name: str) -> int:
        """The number of the path that goes on by ``name``."""
        found = self.paths.setdefault((path, name), len(self.listed))
        if found == len(self.listed):
            self.listed.append(self.listed[path] + name.endswith("!"))
        return found

    def pop(self, place: int) -> None:
        """Closes the elements from a place on the stack."""
        while len(self.stack) > place:
            tag, number, bad, _ = self.stack.pop()
            self.at[tag].pop()
            if number:
                self.last[number] = len(self.above) - 1
                self.open_blocks.pop()
            self.bad -= bad
            self.inside -= tag in ("article", "main")

    def nearest(self, tags: set) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def pop_to(self, tags: set, barrier: set) -> None:
        """Closes the nearest open element of ``tags`` if none of ``barrier`` stands in it."""
        if (place := self.nearest(tags)) > self.nearest(barrier):
            self.flush()
            self.pop(place)

    def open(self, tag: str, rest: str) -> None:
        block = tag in BLOCK or tag in NOT_TEXT
        if block:
            self.flush()
        if tag in CLOSES_P:
            self.pop_to({"p"}, {"td", "th", "li", "dd", "div", "article", "section", "table", "button", "blockquote"})
        if tag in ENDS:
            self.pop_to(*ENDS[tag])
        if tag in VOID:
            if tag not in ("wbr", "link", "meta"):
                self.text.append(" ")
            return
        bad = tag in NOT_TEXT or (tag == "header" and not self.inside)
        named = False
        if rest and tag not in ("html", "body", "article", "main"):
            names = {k.lower(): (v or "").strip("\"'").lower() for k, v in ATTRIBUTE.findall(rest)}
            bad = bad or names.get("role", "") in NOT_ROLES or names.get("aria-hidden") == "true" or "hidden" in names or "display:none" in names.get("style", "").replace(" ", "")
            named = any(unwanted(name) for name in f"{names.get('class', '')} {names.get('id', '')}".split())
        if bad or (named and not block):
            self.flush()
        if rest.endswith("/") and tag not in BLOCK:
            return
        number = 0
        if tag in BLOCK or named:
            self.above.append(self.open_blocks[-1][1])
            self.last.append(0)
            number = len(self.above) - 1
            self.open_blocks.append((len(self.stack), number, self.step(self.open_blocks[-1][2], tag + "!" * named), tag in HEADINGS or self.open_blocks[-1][3]))
        self.at[tag].append(len(self.stack))
        self.stack.append((tag, number, bad, False))
        self.bad += bad
        self.inside += tag in ("article", "main")

    def close(self, tag: str) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        place = self.nearest({tag})
        if place < 0:
            return
        if tag in BLOCK or tag in NOT_TEXT or self.stack[place][1]:
            self.flush()
            self.pop(place)
        elif place > self.open_blocks[-1][0]:  # inline: its text goes on, unless it is none of the article's
            if any(s[2] for s in self.stack[place:]):
                self.flush()
            self.pop(place)


def content_blocks(page: Page) -> list[str]:
    """Texts of the page's article."""
    blocks = page.blocks
    if not blocks:
        return []
    total = defaultdict(lambda: [0, 0, 0])
    for path, _, text, _ in blocks:
        t = total[path]
        t[0] += len(text)
        t[1] += len(PUNCTUATION.findall(text))
        t[2] += 1

    def smooth(x: list[float]) -> list[float]:
        """Weighted means of neighbours; a big neighbour at most doubles a value."""
        return [min((a + 2 * b + c) / 4, 2 * b) for a, b, c in zip([x[0], *x], x, [*x[1:], x[-1]], strict=False)]

    prior = {p: PRIOR ** page.listed[p] for p in total}
    lengths = smooth([prior[b[0]] * total[b[0]][0] / total[b[0]][2] for b in blocks])
    marks = smooth([total[b[0]][1] / total[b[0]][2] for b in blocks])
    fused = [a * (1 + b) for a, b in zip(lengths, marks, strict=True)]
    score = defaultdict(float)
    for b, x in zip(blocks, fused, strict=True):
        score[b[0]] += x / total[b[0]][2]
    mean = sum(score[p] * t[0] for p, t in total.items()) / sum(t[0] for t in total.values())
    best = max(score, key=lambda p: (prior[p] * total[p][0] * (1 + total[p][1]), p))
    content = {p for p, x in score.items() if x >= LEAST_SHARE * mean and total[p][1]} | {best}
    chosen = [i for i, b in enumerate(blocks) if b[0] in content]
    # The smallest element that holds them, by page order the one around the first and the last.
    first, last = blocks[chosen[0]][1], max(blocks[i][1] for i in chosen)
    around = page.above[first]
    while around and not (around <= last <= page.last[around]):
        around = page.above[around]
    fewest = min(page.listed[b[0]] for b in blocks if b[0] in content)
    links = {p for (_, name), p in page.paths.items() if name == "a"}
    out = []
    for i, (path, number, text, heading) in enumerate(blocks):
        within = around <= number <= page.last[around] if around else True
        belongs = within and page.listed[path] <= fewest and path not in links and i < chosen[-1] and (heading or i > chosen[0])
        if path in content or belongs:
            out.append(text)
    return out


def main_text(source: str) -> str:
    return "\n".join(content_blocks(Page(source)))


def _extracted(batches):
    for b in pieces(batches, "html"):
        texts = [main_text((x or b"").decode("utf-8", "replace")) for x in binaries(b, "html")]
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("page_id")), b.column(b.schema.get_field_index("url")), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points), per row of ``pages`` (page_id, url, html).

    Null or empty html, and pages without text: empty text. Repeated rows and shared ids: one result each. Null
    ids and urls stay null. Ties between paths go to the one that sorts last. Pages of any length are read
    whole; other columns are ignored. Unclosed and stray tags follow the usual rules of tag soup.
    """
    return narrow(pages, "page_id", "url", "html").mapInArrow(_extracted, f"page_id {id_type(pages, 'page_id')}, url string, text string, n_chars long")


def op9_tag_path_ratios(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
