"""Main text of web pages by two passes of block rules.

The first pass decides what it can from each block alone: where it stands, how much of it is link text, how
long it is and how many of its words are stop words. The second gives each ambiguous block the label of its
nearest decided neighbours. Inside an article element the element's edges count as good neighbours.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

# Frequent function words of the corpus languages.
STOP_WORDS = frozenset(
    """
    a an and are as at be by for from he her his in is it not of on or she that the their they this to was were which with you
    der die das den dem des ein eine einer und ist im in mit nicht sich von zu auf für es als auch an
    le la les un une des du de et est en que qui dans pour par pas sur au avec il elle ce
    el los las una y que por para con no se su del al lo como más
    """.split()
)
# What HTML says of its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe object svg math title select option canvas audio video".split())
BLOCKS = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot
    th thead title tr ul
    """.split()
)
ASIDE = frozenset("nav footer aside form menu dialog button fieldset head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = frozenset(
    """
    ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice
    notices alert sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments commentlist disqus respond reply replies
    footer masthead topbar share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay
    toolbar pagination pager widget widgets search hidden
    """.split()
)
# Words that may stand beside a name in a class, as in site-nav, sidebar-left or related-3; any other makes it another class.
BESIDE = frozenset("site page main global top bottom left right primary secondary post entry article content wrap wrapper container box list area section block item items inner outer links buttons bar".split())
#: What no class or id makes an aside: it holds the page's text.
WHOLE = frozenset("html body main article".split())
#: Of RAW, what HTML reads to the page's end if no end tag comes.
TO_THE_END = frozenset("script style textarea title iframe".split())
CLOSES_P = BLOCKS - {"body", "html", "head"}

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?>[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)""", re.DOTALL
)
ATTRIBUTE = re.compile(r"""([A-Za-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
WORD = re.compile(r"\w+")

LINK_SHARE = 0.35
SHORT_WORDS = 10
CHARS_PER_WORD = 6
STOP_HIGH = 0.12
STOP_LOW = 0.05
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class Block:
    text: str
    link_chars: int
    aside: bool
    article: int
    heading: bool
    first: str | None = None
    label: str | None = None
    stop_share: float = field(default=0.0)
    n_words: int = 0


def _names(value: str) -> set[str]:
    """What the classes or ids in ``value`` name, each taken as a whole."""
    out = set()
    for token in value.split():
        parts = {p for p in re.split(r"[_-]+", token) if p and not p.isdigit()}
        out |= {token} if token in NAMES else (parts - BESIDE if parts - BESIDE <= NAMES | {"header"} else set())
    return out


class _Ends:
    """Where elements of the page end by their own end tags; the tags of a name are matched once a page."""

    def __init__(self, page: str):
        self.page = page
        self.known: dict[str, dict[int, int]] = {}

    def of(self, name: str, begin: int, at: int) -> int | None:
        """End of the element whose start tag stands from ``begin`` to ``at``; None without an end tag."""
        if name in TO_THE_END:
            m = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(self.page, at)
            return m.end() if m else len(self.page)
        if name not in self.known:
            ends, opened = {}, []
            for m in re.compile(rf"<(/?){name}\b[^>]*>", re.IGNORECASE).finditer(self.page):
                if not m[1] and not m[0].endswith("/>"):
                    opened.append(m.start())
                elif m[1] and opened:
                    ends[opened.pop()] = m.end()
            self.known[name] = ends
        return self.known[name].get(begin)


def _is_aside(name: str, rest: str, in_article: bool, forms: bool = True) -> bool:
    if (name in ASIDE and (forms or name != "form")) or (name == "header" and not in_article):
        return True
    if not rest.strip(" /\n\t"):
        return False
    for key, *values, flag in ATTRIBUTE.findall(rest):
        value = "".join(values).lower()
        if flag or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return True
        if key.lower() == "role" and value in ROLES:
            return True
        if key.lower() in ("class", "id") and name not in WHOLE:
            parts = _names(value)
            if parts & NAMES or ("header" in parts and not in_article):
                return True
    return False


def blocks_of(page: str, forms: bool = True) -> list[Block]:
    """The page's blocks of text in order, with what the rules need to know of each; ``forms`` says that forms are asides.

    Each tag is handled once: open elements are counted by name, and an end tag pops what it closes.
    """
    out: list[Block] = []
    counts: Counter[str] = Counter()
    ends = _Ends(page)
    stack: list[tuple[str, bool, int]] = []  # element, whether aside, article it belongs to
    pieces: list[str] = []
    linked = articles = links = dropped = 0

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            aside, article = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
            out.append(Block(text, linked, aside, article, any(name in HEADINGS for name, *_ in stack[-3:])))
        pieces.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not dropped:
            pieces.append(text)
            if links:
                linked += len(" ".join(html.unescape(text).split()))

    def leave(name: str) -> None:
        nonlocal links, dropped
        while stack:
            top = stack.pop()[0]
            counts[top] -= 1
            dropped -= top in RAW
            links -= top == "a"
            if top == name:
                return

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            if name in BLOCKS:
                close()
            if counts[name]:
                leave(name)
            continue
        if name == "br":
            pieces.append("\n")
            continue
        if name in RAW:
            if name in BLOCKS:
                close()
            if m["rest"].endswith("/"):
                continue
            stop = None if name == "option" else ends.of(name, m.start(), at)
            if stop is not None:
                at = stop
                continue
            # Its parent's end tag closes it.
            if name == "option" and stack and stack[-1][0] == name:
                leave(name)
            stack.append((name, True, stack[-1][2] if stack else 0))
            counts[name] += 1
            dropped += 1
            continue
        if name in BLOCKS:
            close()
            if name in CLOSES_P and not dropped and stack and any(x[0] == "p" for x in stack[-4:]):
                leave("p")
            if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                leave(name)
        if name in VOID or m["rest"].endswith("/"):
            continue
        aside, article = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
        if name in ("article", "main") and not article:
            articles += 1
            article = articles
        if name == "a":
            if links and not dropped and counts["a"]:
                leave("a")
            links += 1
        stack.append((name, aside or _is_aside(name, m["rest"], bool(article), forms), article))
        counts[name] += 1
    close()
    return out


def decide(blocks: list[Block]) -> None:
    """Label every block good or bad.

    Where too few words of the long blocks are known stop words for any of them to be decided so, the page is in a language that the list does not cover: there
    length and link density decide alone, length in characters too, as some scripts have no blanks.
    """
    stops = total = 0
    for b in blocks:
        words = WORD.findall(b.text.lower())
        found = sum(w in STOP_WORDS for w in words)
        b.stop_share, b.n_words = found / max(1, len(words)), len(words)
        if not b.aside and b.link_chars <= LINK_SHARE * len(b.text) and max(len(words), len(b.text) // CHARS_PER_WORD) >= SHORT_WORDS:
            stops, total = stops + found, total + len(words)
    foreign = stops < STOP_HIGH * total
    for b in blocks:
        if b.aside or b.link_chars > LINK_SHARE * len(b.text):
            b.first = "bad"
        elif foreign and max(b.n_words, len(b.text) // CHARS_PER_WORD) >= SHORT_WORDS:
            b.first = "good"
        elif b.n_words >= SHORT_WORDS and b.stop_share >= STOP_HIGH:
            b.first = "good"
        elif b.n_words >= SHORT_WORDS and b.stop_share < STOP_LOW and not b.article and not b.heading:
            b.first = "bad"
        b.label = b.first
    if not any(b.first for b in blocks):
        for b in blocks:
            b.label = "good" if b.article or b.stop_share >= STOP_LOW else "bad"
        return
    for b, left, right in zip(blocks, _neighbours(blocks), reversed(_neighbours(blocks[::-1])), strict=True):
        if b.label:
            continue
        if left == right:
            b.label = left or "bad"
        elif b.heading:
            b.label = right or "bad"
        else:
            b.label = "good" if "good" in (left, right) and (b.article or b.stop_share >= STOP_LOW) else "bad"


def _neighbours(blocks: list[Block]) -> list[str]:
    """For each block the label of the nearest decided block before it.

    Blocks of an article see only blocks of the same article; its edge is a good neighbour.
    """
    out, last, article = [], "", 0
    for b in blocks:
        if b.article != article:
            last, article = ("good" if b.article else ""), b.article
        out.append(last)
        last = b.first or last
    return out


def main_text(page: str | None) -> str:
    """The page's good blocks, those of articles alone if there are any. If none is good but for a form around them, forms are no asides."""
    if not page:
        return ""
    for forms in (True, False):
        blocks = blocks_of(page, forms)
        decide(blocks)
        if any(b.article and b.label == "good" for b in blocks):
            blocks = [b for b in blocks if b.article]
        good = [b.text for b in blocks if b.label == "good"]
        if good or "<form" not in page.lower():
            return "\n\n".join(good)
    return "\n\n".join(good)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Null or empty html gives an empty text. Whole pages are read, however long; a page is one row and is handled
    alone, so nothing is shuffled. Repeated rows each give a row; an empty table an empty result; other columns of
    the input are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select("page_id", "url", "html")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
