"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  The first pass classifies a block by where it
stands (menus, notices, adverts, forms and the like are bad), by link density, length and
stop-word density as good, bad, near good or short.  The second pass gives short and near-good
blocks the label of their nearest decided neighbours.  Within an ``article`` or ``main`` element a
block is only bad for its links or its place, as everything else there is the article; such an element
counts if at least as much good text stands in it as beside it.  Scripts that write without spaces go by length and
punctuation in place of stop words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, table

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.30, 0.32
MAX_LINKS, MAX_LINKS_ARTICLE = 0.2, 0.8

# Common function words of four languages.
STOP_WORDS = frozenset(
    "a about after all also an and are as at be been but by can do for from had has have he her his if in into is it its more not of on one or other our "
    "out she so some than that the their them there they this to up was we were what when which who will with would you your "
    "aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für haben hat ich im in ist mit nach nicht noch nur oder "
    "sein sich sie sind so über um und uns von vor war was wenn wie wird wir zu zum zur "
    "au aux avec ce ces cette comme dans de des du elle en est et être il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont "
    "sur un une vous "
    "al como con cuando de del donde el ella en entre era es esta este fue ha hay la las le lo los más me mi muy no o para pero por que se si sin sobre su sus también un "
    "una y ya".split()
)
#: Elements whose content is raw: it ends at their end tag only, or with the page.
RAW = "script|style|noscript|iframe|textarea|xmp"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?>\"[^\"]*\"|'[^']*'|[^>])*+(?<!/)>.*?(?:</\1\s*>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>\"[^\"]*\"|'[^']*'|[^>])*+)(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
WORD = re.compile(r"[^\W\d_]+")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr "
    "html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content never is main text.
AWAY = frozenset("head title nav footer aside form fieldset button dialog menu option label datalist template svg math object select".split())
#: Elements in which ``/>`` closes a tag.
FOREIGN = ("svg", "math")
AWAY_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr login "
    "masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promotion recommended related replies reply respond "
    "share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
AWAY_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: What an end tag left out closes: a new one of the first closes an open one of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WALLS = frozenset("article aside body div footer form header html main nav ol section table ul".split())


#: What may stand beside a name of AWAY_NAMES in a class or id: ``site-nav`` is away, ``has-sidebar`` and ``topic-social`` are not.
FILLERS = frozenset(
    "area bar bottom box btn button buttons container content float fixed global group holder icons inner item items left link links list main mobile outer page panel post posts primary "
    "right row secondary section site slot sticky text top unit wrap wrapper".split()
)
#: Scripts without spaces, and the marks that end or part their sentences.
UNSPACED = re.compile(r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\U00020000-\U0003FFFF]")
UNSPACED_MARKS, UNSPACED_SHARE, UNSPACED_WEIGHT = re.compile(r"[\u3001\u3002\uFF01\uFF0C\uFF0E\uFF1A\uFF1B\uFF1F.!?,]"), 0.3, 3


class Block(NamedTuple):
    text: str
    links: int  # characters in links
    tag: str
    away: bool
    article: bool


def away_by_attributes(tag: str, rest: str, in_article: bool) -> bool:
    if not rest.strip() or tag in ("html", "body", "article", "main"):
        return False
    for name, value in ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            for token in value.split():
                names = set(re.split(r"[^a-z]+", token)) - {""}
                away = names & AWAY_NAMES or (names & {"header"} if not in_article else None)
                if away and names <= AWAY_NAMES | FILLERS | {"header"}:
                    return True
        elif name == "role" and value in AWAY_ROLES or name == "aria-hidden" and value == "true":
            return True
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order, character references decoded and white space made single."""
    found: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, away, in an article
    opened: Counter[str] = Counter()  # tags on the stack, so that it is only walked for one that is there
    away = article = False
    in_link = 0
    tag_of = ""
    parts: list[str] = []
    linked: list[str] = []

    def close() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                found.append(Block(text, len(" ".join(unescape("".join(linked)).split())), tag_of, away, article))
            parts.clear()
            linked.clear()

    def pop_to(i: int) -> None:
        nonlocal away, article
        for name, *_ in stack[i:]:
            opened[name] -= 1
        del stack[i:]
        now = stack[-1][1:] if stack else (False, False)
        if now != (away, article):
            close()
        away, article = now

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            parts.append(piece := html[at : m.start()])
            if in_link:
                linked.append(piece)
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:  # an end tag
            if tag in BLOCKS:
                close()
            if tag == "a":
                in_link = 0
            for i in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if stack[i][0] in WALLS and tag not in WALLS:
                    break
            continue
        if tag == "br":
            parts.append(" ")
            if in_link:
                linked.append(" ")
        if tag in BLOCKS:
            close()
            in_link = 0
            shut = CLOSES.get(tag, set()) | {"p"}
            for i in range(len(stack) - 1, -1, -1) if any(opened[name] for name in shut) else ():
                if stack[i][0] in WALLS:
                    break
                if stack[i][0] in shut:
                    pop_to(i)
                    break
            tag_of = tag
        if tag in VOID or m[4].endswith("/") and (tag in FOREIGN or any(opened[name] for name in FOREIGN)):
            continue
        if tag == "a":
            in_link = 1
        inside = article or tag in ("article", "main")
        gone = away or tag in AWAY or tag == "header" and not article or away_by_attributes(tag, m[4], article)
        if gone and not away or inside != article:
            close()
        stack.append((tag, gone, inside))
        opened[tag] += 1
        away, article = gone, inside
    if at < len(html):
        parts.append(html[at:])
    close()
    return found


def first_pass(b: Block) -> str:
    density, n = b.links / len(b.text), len(b.text)
    if b.away or (density > MAX_LINKS_ARTICLE and b.tag == "li" if b.article else density > MAX_LINKS or "©" in b.text and n <= LENGTH_HIGH):
        return "bad"
    if len(UNSPACED.findall(b.text)) >= UNSPACED_SHARE * n:
        n *= UNSPACED_WEIGHT  # a character says more
        stops = STOP_HIGH if UNSPACED_MARKS.search(b.text) else 0.0
    else:
        words = WORD.findall(b.text.lower())
        stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if n < LENGTH_LOW:
        return "short"
    if stops >= STOP_HIGH:
        return "good" if n > LENGTH_HIGH else "near"
    return "near" if stops >= STOP_LOW or b.article else "bad"


def second_pass(found: list[Block]) -> list[bool]:
    """Whether each block is main text."""
    if any(b.article and not b.away for b in found):
        good = Counter[bool]()  # characters of good text in articles and beside them
        for b in found:
            if first_pass(b._replace(article=False)) == "good":
                good[b.article] += len(b.text)
        if good[True] >= good[False]:  # the page marks its article: what stands outside isn't
            found = [b if b.article else b._replace(away=True) for b in found]
        else:  # what it marks is a teaser beside the text
            found = [b._replace(article=False) for b in found]
    labels = [first_pass(b) for b in found]
    if "good" not in labels:  # of a short page the near-good blocks are the text
        labels = ["good" if x == "near" else x for x in labels]

    # labels of the nearest decided blocks on either side, each by one pass: of all blocks, and, as an article's undecided ones see them,
    # of those that have a place in an article
    n = len(found)
    sides: dict[tuple[int, bool], list[str | None]] = {}
    for step in (-1, 1):
        for article in (False, True):
            seen: list[str | None] = [None] * n
            last = None  # (label, in an article) of the last decided block
            for i in range(n) if step < 0 else range(n - 1, -1, -1):
                seen[i] = last[0] if last and last[1] == article else None
                if labels[i] in ("good", "bad") and not (article and found[i].away):
                    last = labels[i], found[i].article
            sides[step, article] = seen

    out = []
    for i, (b, label) in enumerate(zip(found, labels)):
        if label in ("good", "bad"):
            out.append(label == "good")
            continue
        before, after = sides[-1, b.article][i], sides[1, b.article][i]
        around = {before, after}
        if b.article:  # undecided here is the article, unless it stands amid bad list items
            out.append("good" in around or None in around or b.tag != "li")
        elif label == "near":
            out.append("good" in around or around == {None})
        else:
            out.append(around <= {"good"} or b.tag in ("h1", "h2", "h3", "h4", "h5", "h6") and after == "good")
    return out


def main_text(html: str) -> str:
    found = blocks(html)
    return "\n\n".join(b.text for b, keep in zip(found, second_pass(found)) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: a row per row of ``pages``.

    Null html counts as empty; a page without main text has an empty text.  Rows are independent, so
    repeated ones give repeated results; a very long page is one row's work, which grows with its length.  An unclosed script, style or
    other raw element takes the rest of the page, as in a browser; any other unclosed element ends with what it stands in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "") for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return mapped(pages.select(F.col("page_id").cast("long"), "url", "html"), run, "page_id long, url string, text string, n_chars long")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
