"""HTML extraction by two-pass block rules.

A page is cut into blocks, the runs of text between block-level tags. The first pass decides blocks by what holds them
(menus, footers, scripts and the like are out, as is all that stands outside an article where a page marks one), by the
share of their characters in links, their length and their density of stop words. Short or unclear blocks stay open. In the
second pass they inherit the label of the nearest decided neighbours.

Class and id words and forms are a feature, no verdict: what they mark is left out only as long as it doesn't hold most of
the page's prose, and where nothing is left without it, its blocks are decided like all others. Reader comments and
consent notices are out in any case. On a page whose longer blocks have next to no known stop words, sentences stand in for them.

Character references are decoded, white space within a block becomes one space, blocks of the main text are joined by one
space in page order. Null and empty pages give an empty text. Rows with null or repeated page_id are treated like others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import as_bytes, batch_of, read, slices

#: Very common words of a few languages.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was were which will with you "
    "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer es für hat ich im in ist mit nach nicht sich sie sind und von war werden wie wird zu zum zur "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con de del el en entre era es ese esta este fue ha hay la las le lo los más no o para pero por que se ser si sin sobre su sus también un una y "
    "che da della di e gli il non per sono um uma não os em do da het een van en te dat niet zijn op".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is never main text, and elements whose content is not markup.
OUT_TAGS = frozenset("aside button dialog footer head header iframe input label menu nav noscript object option select svg template textarea".split())
RAW = frozenset("script style noframes noembed xmp textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class or id, cut at everything but letters, that mark what is not main text.
OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner bottombar breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies disqus feedback footer gdpr header login masthead menu "
    "modal nav navbar navigation newsletter notice notices notification overlay pagination pager popup promo promoted promotion recommended related reply replies respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe teaser toolbar topbar widget widgets".split()
)
#: Words beside them in one name, as in no-sidebar, that say something else; names that no prose redeems.
OTHERWISE = frozenset("no not non has have with without is ready enabled disabled reading level".split())
NEVER = frozenset("comment comments commentlist consent cookie cookies disqus gdpr replies reply respond".split())
OUT_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
LETTERS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?…][\"')\]»”’]*(?:\s|$)|[。！？।؟]")
#: Characters below which a block is short; above which, with stop words, it is main text alone; shares of links and stop words.
SHORT, LONG, LINKS, FEW, MANY = 70, 200, 0.4, 0.12, 0.25
#: Share of a page's prose from which on a container isn't out by its name.
MOST = 0.6
GOOD, BAD, OPEN, UNCLEAR = range(4)


class Block:
    """A run of text; ``marks``: the containers around it that a name or a form marks, outermost first."""

    __slots__ = ("linked", "marks", "out", "parts", "scope", "tag")

    def __init__(self, out: bool, scope: bool, marks: tuple[int, ...] = (), tag: str = ""):
        self.parts: list[str] = []
        self.linked, self.out, self.scope, self.marks, self.tag = 0, out, scope, marks, tag


def is_out(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is out, and whether a name or a form marks it."""
    if tag in OUT_TAGS and not (tag == "header" and in_article):
        return True, False
    marked = tag == "form"
    if attributes and tag not in ("html", "body", "article", "main"):
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                for words in ([w.lower() for w in LETTERS.findall(x)] for x in value.split()):
                    if OTHERWISE.isdisjoint(words) and not OUT_NAMES.isdisjoint(words):
                        if not NEVER.isdisjoint(words):
                            return True, False
                        marked = True
            value = value.lower()
            if name == "role" and value in OUT_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                return True, False
    return False, marked


def blocks_of(html: str) -> list[Block]:
    """Blocks in page order, with the characters that stand in links."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, tuple[int, ...]]] = []  # tag, out, in an article, marked containers
    block = Block(False, False)
    links = at = marks = 0

    def begin() -> None:
        nonlocal block
        if block.parts:
            out.append(block)
        tag, gone, scope, held = stack[-1] if stack else ("", False, False, ())
        block = Block(gone, scope, held, tag)

    def text(s: str) -> None:
        if s:
            block.parts.append(s)
            if links:
                block.linked += len(s)

    while m := TAG.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = m[1] or m[4]
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if any(x[0] == "a" for x in stack[k + 1 :]):
                        links = 0
                    del stack[k:]
                    break
            if tag in BLOCKS:
                begin()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = end.start() if end else len(html)
            continue
        if tag in VOID:
            if tag == "br":
                text(" ")
            elif tag == "hr":
                begin()
            continue
        if tag == "p" or tag in BLOCKS and stack and stack[-1][0] == "p":  # an open paragraph ends here
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    links = 0
                    break
                if stack[k][0] in BLOCKS:
                    break
        if tag == "li" and stack and stack[-1][0] == "li":
            stack.pop()
        _, gone, scope, held = stack[-1] if stack else ("", False, False, ())
        attributes = m[3] if m[2] else m[6]
        if m[3] is not None and attributes.endswith("/") and tag not in BLOCKS and tag != "a":
            continue
        scope = scope or tag in ("article", "main") or 'role="main"' in attributes
        out_here, marked = is_out(tag, attributes, scope)
        marks += marked
        stack.append((tag, gone or out_here, scope, (*held, marks) if marked else held))
        if tag == "a":
            links += 1
        if tag in BLOCKS:
            begin()
        elif stack[-1][1] != gone or marked:
            begin()
    text(html[at:])
    begin()
    return out


def decide(length: int, linked: int, stops: float, scope: bool, tag: str = "") -> int:
    """The first pass, for a block of main text's surroundings. A longer paragraph of an article that is a link is not decided."""
    if linked > LINKS * length:
        return UNCLEAR if scope and tag == "p" and length >= SHORT else BAD
    if length < SHORT:
        return OPEN
    if stops >= MANY:
        return GOOD if length >= LONG or scope else UNCLEAR
    if stops >= FEW:
        return GOOD if length >= LONG and scope else UNCLEAR
    return UNCLEAR if scope else BAD


def inherit(labels: list[int], scoped: bool) -> list[bool]:
    """The second pass: open blocks take the label of the nearest decided neighbour; an unclear one needs a good one on either side."""
    n = len(labels)
    before, after = [(n + 1, None)] * n, [(n + 1, None)] * n
    for to, walk in ((before, range(n)), (after, range(n - 1, -1, -1))):
        seen = (n + 1, None)
        for i in walk:
            to[i] = seen
            seen = (1, labels[i]) if labels[i] in (GOOD, BAD) else (seen[0] + 1, seen[1])
    out = []
    for i, label in enumerate(labels):
        if label in (GOOD, BAD):
            out.append(label == GOOD)
            continue
        (p, a), (q, b) = before[i], after[i]
        if a is None and b is None:
            out.append(True)  # nothing on the page is decided
        elif label == UNCLEAR:
            out.append(GOOD in (a, b))
        elif a is None or b is None or a == b:
            out.append(GOOD in (a, b) and BAD not in (a, b))
        else:
            out.append((a if p < q else b if q < p else GOOD if scoped else BAD) == GOOD)
    return out


def prose(block: Block, text: str) -> int:
    """Characters of a longer block that is not mostly links."""
    return len(text) if not block.out and len(text) >= SHORT and block.linked <= LINKS * len(text) else 0


def main_text(blocks: list[tuple[Block, str]], gone: set[int]) -> str:
    """The main text, without what stands in the marked containers ``gone``."""
    out = [b.out or not gone.isdisjoint(b.marks) for b, _ in blocks]
    scoped = any(b.scope and not o for (b, _), o in zip(blocks, out))
    kept = [(b, t) for (b, t), o in zip(blocks, out) if b.scope and not o] if scoped else blocks
    out = [False] * len(kept) if scoped else out
    words = [WORD.findall(t.lower()) for _, t in kept]
    stops = [sum(w in STOP_WORDS for w in own) / max(1, len(own)) for own in words]
    if not any(s >= FEW for s, (_, t), o in zip(stops, kept, out) if not o and len(t) >= SHORT):  # no language that is known
        stops = [MANY if SENTENCE.search(t) else s for s, (_, t) in zip(stops, kept)]
    labels = [BAD if o else decide(len(t), b.linked, s, scoped, b.tag) for (b, t), o, s in zip(kept, out, stops)]
    return " ".join(t for (_, t), good in zip(kept, inherit(labels, scoped)) if good)


def extract(html: str) -> str:
    if not html:
        return ""
    blocks = []
    for b in blocks_of(html):
        words = unescape("".join(b.parts)).split()
        if words:
            blocks.append((b, " ".join(words)))
    held: dict[int, int] = {}
    for b, t in blocks:
        for m in b.marks:
            held[m] = held.get(m, 0) + prose(b, t)
    total = sum(prose(b, t) for b, t in blocks)
    gone = {m for m, n in held.items() if n <= MOST * total}
    return main_text(blocks, gone) or (main_text(blocks, set()) if any(prose(b, t) for b, t in blocks) else "")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [extract(x.decode("utf-8", "replace")) for x in as_bytes(batch.column("html"))]
            yield batch_of(schema, batch.column("page_id"), batch.column("url"), texts, [len(x) for x in texts])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))
