"""Main text of web pages by tag-path ratios.

A page is cut into blocks: runs of text between tags that begin or end a block. A block's path is the list of its block
elements from the root, with their classes, so blocks of one kind share a path. For each path the text length and the
punctuation marks are summed over its blocks and divided by their number; both ratios, taken in page order, are smoothed
over neighbouring blocks, fused, and averaged for each path. Paths whose fused ratio reaches a threshold are content.
Markup that says what it is counts first: menus, footers, forms, hidden parts and parts named as adverts, notices or
comments are left out, and paths below an article element weigh more. Blocks between content blocks in the smallest
element that holds the content belong to it too: headings, list items, cells and short paragraphs.

Pages are independent of each other, so there is no shuffle; a page of any length is read in time linear in its length.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import need, small_batches

_words = lambda s: frozenset(s.split())

#: Elements that begin and end blocks, as HTML defines them (fixed values).
BLOCKS = _words(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li listing main menu nav ol option optgroup p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp"
)
#: Elements whose text is never main text.
SKIPPED = _words("audio button canvas datalist dialog head iframe map math menu nav noembed noframes noscript object script select style svg template textarea title video aside footer search")
#: Elements whose content is no markup, up to their end tag.
RAW = _words("iframe noembed noframes script style textarea title xmp")
VOID = _words("area base br col embed hr img input link meta param source track wbr")
HEADINGS = _words("h1 h2 h3 h4 h5 h6")
#: An opening tag of these ends an open one of the list, unless one of the second list is in between.
ENDS = {"li": (_words("li"), _words("ul ol menu dir")), "dt": (_words("dt dd"), _words("dl")), "dd": (_words("dt dd"), _words("dl")), "tr": (_words("tr td th"), _words("table"))}
ENDS |= dict.fromkeys(("td", "th"), (_words("td th"), _words("tr table"))) | dict.fromkeys(("tbody", "thead", "tfoot"), (_words("tbody thead tfoot tr td th"), _words("table")))
ROLES = _words("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar tooltip")
#: Words of class names and ids that name a part that isn't the article.
NAMED = _words(
    "ad ads adsense adslot advert adverts advertisement advertisements advertising adverting banner banners breadcrumb breadcrumbs consent cookie cookies dfp footer gdpr header login masthead"
    " menu menus modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promos promotion recommended related share sharebar sharing sidebar"
    " signin signup skip social sponsor sponsored subscribe subscription taboola toolbar topbar alert alerts search"
)
#: The same as a whole name; builders of pages use the words in names of any part.
WHOLE = _words("widget widgets widget-area")
COMMENTS = _words("comment comments commentlist discussion disqus replies reply respond responses")
#: With these a name tells a state, as in comments-open or no-sidebar.
STATES = _words("closed count disabled enabled has is js no off on open with without")
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?(?=[\s/]|$)""", re.I)
_MARKUP = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*"|'[^']*'|[^\s>]*))*+)>|[!?/][^>]*>)""", re.S)
_MARKS = re.compile(r"[.,;:!?…。、，；：！？؟،]")
#: Weights of a block's neighbours in smoothing, and of paths below an article or main element.
SMOOTH = (1.0, math.exp(-0.5), math.exp(-2.0))
ARTICLE_WEIGHT = 4.0
#: Content paths reach this share of the best path's ratio.
THRESHOLD = 0.3
#: A part named by its class or a form is kept if it holds this share of the page's text: then it wraps the page.
WRAPS = 0.6
#: Within so many named parts nothing is main text.
NESTED = 8


class Element:
    """An open element: its path's number, whether its text is skipped, the named parts around it, whether it is in the main part (1) or an article (2)."""

    __slots__ = ("tag", "path", "skip", "named", "article")

    def __init__(self, tag: str, path: int, skip: bool, named: tuple, article: int) -> None:
        self.tag, self.path, self.skip, self.named, self.article = tag, path, skip, named, article


class Block:
    """A run of text, the length of its links, the element it stands in and the named parts around it."""

    __slots__ = ("text", "links", "of", "named")

    def __init__(self, text: str, links: int, of: Element, named: tuple) -> None:
        self.text, self.links, self.of, self.named = text, links, of, named


def part_names(tag: str, attributes: str) -> tuple[bool, str | None, str, int]:
    """Whether an element is hidden or has a role outside the article, what its names tell (``comment``, ``header``,
    ``other`` or None), a label for its path, and whether it is marked as the article (2) or the main part (1)."""
    skip, named, label, article = False, None, tag, {"article": 2, "main": 1}.get(tag, 0)
    if not attributes:
        return skip, named, label, article
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), unescape(values[0] or values[1] or values[2])
        if name == "role":
            skip |= value.strip().lower() in ROLES
            article = max(article, {"article": 2, "main": 1}.get(value.strip().lower(), 0))
        elif name == "hidden":
            skip |= value.lower() != "until-found"
        elif name == "aria-hidden":
            skip |= value.strip().lower() == "true"
        elif name == "style":
            skip |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
        elif name == "itemprop":
            article = 2 if value.strip().lower() == "articlebody" else article
        else:
            if name == "class":
                label = ".".join([tag, *sorted(value.split())])
            for one in value.split():
                words = [w.lower() for w in _NAME.findall(one)]
                if STATES.isdisjoint(words):
                    if words and words[0] in COMMENTS or len(words) > 1 and words[-1] in COMMENTS:
                        named = "comment"
                    elif one.lower() in WHOLE or not NAMED.isdisjoint(words):
                        named = named if named in ("comment", "other") else "header" if NAMED.intersection(words) == {"header"} else "other"
    return skip, named, label, article


def blocks_of(html: str) -> list[Block]:
    """Blocks of a page in their order, without those whose markup says that they are no main text."""
    root = Element("", 0, False, (), 0)
    stack, opened, paths = [root], Counter(), {}
    blocks: list[Block] = []
    held: list[str] = []
    links, linked, elements, at = 0, 0, 0, 0  # linked: depth of the element that an open link stands in
    last = html.rfind(">") + 1  # what begins a tag after it has no end

    def flush() -> None:
        nonlocal links
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text and not stack[-1].skip:
                blocks.append(Block(text, links, stack[-1], stack[-1].named))
            held.clear()
            links = 0

    def write(text: str) -> None:
        nonlocal links
        if text and not stack[-1].skip:
            held.append(text)
            if linked:
                links += len(text)

    def close(count: int) -> None:
        nonlocal linked
        flush()
        for _ in range(count):
            opened[stack.pop().tag] -= 1
        if linked > len(stack):
            linked = 0

    while at < len(html):
        start = html.find("<", at)
        if start < 0 or start >= last:
            rest = html[at:] if start < 0 else html[at:start] + re.sub(r"(?s)<[a-zA-Z!/?].*", "", html[start:])
            write(rest)
            break
        found = _MARKUP.match(html, start)
        if not found:
            write(html[at : start + 1])
            at = start + 1
            continue
        write(html[at:start])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag == "a":
                linked = 0
            elif opened[tag] > 0:
                close(next(k for k, e in enumerate(reversed(stack), 1) if e.tag == tag))
            elif tag in BLOCKS:
                flush()
            continue
        if tag == "br":
            write("\n")
            continue
        if tag in BLOCKS:
            flush()
            if stack[-1].tag == "p":
                close(1)
            ended, scope = ENDS.get(tag, ((), ()))
            if any(opened[t] > 0 for t in ended):
                depth = 0
                for k, e in enumerate(reversed(stack), 1):
                    if e.tag in scope:
                        break
                    if e.tag in ended:
                        depth = k
                close(depth)
        if tag == "a":
            linked = len(stack)
        if tag in VOID:
            continue
        if tag in BLOCKS or tag in SKIPPED or "hidden" in found[3] or tag in ("span", "ins", "label") and (found[3] or opened[tag]):
            skip, named, label, article = part_names(tag, found[3])
            above = stack[-1]
            if tag not in BLOCKS and tag not in SKIPPED and not skip and not named and not opened[tag]:
                continue  # inline markup, except within a part of that tag
            elements += 1
            if tag in SKIPPED or tag == "header" and not above.article:
                skip = True
            if tag == "form":
                named = named or "other"
            if tag in ("html", "body", "main") or article and named != "comment" or tag == "header" or named == "header" and above.article:
                named = None  # a header in an article is the article's
            if named and len(above.named) == NESTED:
                skip = True
            path = paths.setdefault((above.path, label), len(paths) + 1)
            stack.append(Element(tag, path, above.skip or skip, above.named + ((elements, named),) if named and len(above.named) < NESTED else above.named, max(above.article, article)))
            opened[tag] += 1
            if tag in RAW:  # no markup inside
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                write(html[at : end.start()] if end else html[at:])
                at = end.start() if end else len(html)
    flush()
    return kept_parts(blocks)


def kept_parts(blocks: list[Block]) -> list[Block]:
    """Without the blocks of named parts; a part that holds most of the page wraps it and stays."""
    size, total = Counter(), 0
    for b in blocks:
        free = not any(kind == "comment" for _, kind in b.named)
        total += len(b.text) * free
        for number, kind in b.named:
            if kind != "comment":
                size[number] += len(b.text) * free
    return [b for b in blocks if all(kind != "comment" and size[number] >= WRAPS * total for number, kind in b.named)]


def smoothed(values: list[float]) -> list[float]:
    out = []
    for k in range(len(values)):
        near = [(SMOOTH[abs(d)], values[k + d]) for d in range(1 - len(SMOOTH), len(SMOOTH)) if 0 <= k + d < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def path_ratios(blocks: list[Block]) -> dict[int, float]:
    """Fused ratio of each path: text outside links and marks per block, smoothed over neighbours, averaged."""
    count, length, marks = Counter(), Counter(), Counter()
    for b in blocks:
        p = b.of.path
        count[p] += 1
        length[p] += max(0, len(b.text) - 2 * b.links)
        marks[p] += len(_MARKS.findall(b.text)) if not b.links else 0
    text = [length[b.of.path] / count[b.of.path] for b in blocks]
    stops = [marks[b.of.path] / count[b.of.path] for b in blocks]
    fused, weight = defaultdict(float), {}
    for b, x, own, y in zip(blocks, smoothed(text), text, smoothed(stops), strict=True):
        fused[b.of.path] += math.sqrt(own * x) * (1 + y)  # a block's own ratio counts, so that neighbours alone make nothing content
        weight[b.of.path] = ARTICLE_WEIGHT if b.of.article else 1.0
    return {p: weight[p] * v / count[p] for p, v in fused.items()}


def content_blocks(blocks: list[Block]) -> list[Block]:
    ratios = path_ratios(blocks)
    best = max(ratios.values(), default=0.0)
    chosen = [k for k, b in enumerate(blocks) if best and ratios[b.of.path] >= THRESHOLD * best]
    if not chosen:
        return [b for b in blocks if b.of.article and b.links * 2 <= len(b.text)]
    size = [sum(len(blocks[k].text) for k in chosen if blocks[k].of.article >= level) for level in (1, 2)]
    if size[0]:  # markup says where the text is: all of the main part belongs, or of its articles if they hold most of it
        level = 2 if size[1] * 2 >= size[0] else 1
        return [b for b in blocks if b.of.article >= level and b.links * 2 <= len(b.text)]
    # elsewhere blocks between content blocks belong to it, and headings right before it
    first, end = chosen[0], chosen[-1]
    while first and blocks[first - 1].of.tag in HEADINGS and not blocks[first - 1].links:
        first -= 1
    inside = set(chosen)
    paths = {blocks[k].of.path for k in chosen}
    out = []
    for k in range(first, end + 1):
        b = blocks[k]
        near = k + 1 < len(blocks) and bisect_right(chosen, k) < len(chosen) and (bisect_left(chosen, k) > 0 or b.of.tag in HEADINGS)
        if k in inside or b.of.path in paths or near and b.links * 2 <= len(b.text):
            out.append(b)
    return out


def main_text(html: str | None) -> str:
    """Main text of a page: its content blocks, white space inside a block as one space, blocks joined by blank lines."""
    return "\n\n".join(b.text for b in content_blocks(blocks_of(html or "")))


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` of each row with ``text``, the page's main text (empty if none), and ``n_chars``.

    A null page is an empty one. The whole page is read; nothing is cut. Repeated rows stay, columns are of any type,
    extra columns are left behind, an empty table gives an empty result. Order can't tie: blocks are in page order.
    """
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(main_text)

    given = need(pages, *keep, html_col)
    out = given.select(*[F.col(f"`{c}`") for c in keep], text(F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))).alias("_text"))
    return out.select(*[F.col(f"`{c}`") for c in keep], F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
