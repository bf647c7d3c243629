"""Main text of web pages by the distribution of text over blocks of lines."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from tablewright.llm.frames import quoted

# Lines in a window, and the characters a window needs for a surge: outside and inside of elements marked as article or main part.
WINDOW, SURGE, MARKED_SURGE = 3, 80, 20

# Nothing is tried twice. Of tags that begin at different places at most three can read on at one place (outside of quotes,
# in single or in double ones), and only the last quote of its kind can stay open, so broken markup is read in linear time too.
_INSIDE = r"(?:[^\"'<>]++|\"[^\"]*+\"|'[^']*+')*+"
_RAW = "script|style|noscript|template|textarea|select|iframe|svg|math|object|canvas|audio|video|title"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    rf"|<(?P<raw>{_RAW})\b{_INSIDE}>.*?(?:</(?P=raw)\s*+[^>]*+>|\Z)"
    rf"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*+)(?P<attributes>{_INSIDE})>"
    r"|</?[a-z][^<>]*+>|</[^<>]*+>", re.I | re.S)
# Every attribute with a value, so that none is looked for in the value of another.
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])([^\s\"'<>/=]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")


def _labels(attributes: str) -> list[tuple[str, str]]:
    """(name, value) of class, id and role."""
    return [(kind.lower(), "".join(values)) for kind, *values in ATTRIBUTE.findall(attributes) if kind.lower() in ("class", "id", "role")]


VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NESTED = frozenset("html body div section article main nav aside header footer form ul ol dl table menu dialog figure details "
                   "blockquote button fieldset hgroup search address".split())
BLOCK = NESTED | frozenset("p br hr h1 h2 h3 h4 h5 h6 li dt dd tr caption pre figcaption summary legend option "
                           "thead tbody tfoot center title head".split())
# Between these no line ends, but a gap of white space is needed.
CELLS = frozenset(("td", "th"))
ASIDE = frozenset("nav footer aside form menu dialog button search header".split())
ZONE_ROLES = frozenset(("main", "article"))
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription signup signin login sidebar widget widgets menu nav "
    "navbar navigation navi topbar toolbar breadcrumb breadcrumbs footer foot header masthead comment comments commentlist disqus respond "
    "replies reply reviews share sharing social related recommended recommendations pagination pager search skip alert paywall".split())
# Beginnings that say what a page lacks or has, and ends that name what surrounds the article too.
STATES = frozenset("no has with without".split())
FRAMES = frozenset("layout page site grid".split())
# What a page has but a form does not.
PAGE_PARTS = frozenset("nav header footer h1".split())


def _aside(name: str, attributes: str, in_zone: bool) -> bool:
    """Whether an element is none of the article: by its tag, role, class or id."""
    if name in ASIDE and not (name == "header" and in_zone):
        return True
    if not attributes or name in ("html", "body", "a"):
        return False
    for kind, value in _labels(attributes):
        for label in value.lower().split():
            if kind == "role":
                if label in ASIDE_ROLES:
                    return True
                continue
            parts = re.split(r"[-_]+", label)
            if in_zone and "header" in parts:
                continue
            if parts[0] not in STATES and (parts[-1] in ASIDE_NAMES or parts[0] in ASIDE_NAMES and parts[-1] not in FRAMES):
                return True
    return False


def _zone(name: str, attributes: str) -> str:
    """"article" or "main" if the element is marked as such."""
    if name in ("article", "main"):
        return name
    if attributes and "role" in attributes.lower():
        for kind, value in _labels(attributes):
            if kind == "role" and value.lower() in ZONE_ROLES:
                return value.lower()
    return ""


def page_frames(html: str) -> frozenset[int]:
    """Beginnings of the elements that look like no article text but surround the article: a form around the page, a fixed header.

    These are what surrounds the marked part with the most text, if no marked part with text stands outside of them; in a
    page without marked parts, a form with a menu, header or first heading in it and any element with a footer in it.
    """
    names = Counter()
    stack, text, last, free = [], 0, 0, False  # name, beginning, text before, chain of such elements around it, marked, has parts of a page
    marked_best, page_best = (0, None), (0, None)

    def leave(at):
        nonlocal free, marked_best, page_best
        while len(stack) > at:
            name, start, before, chain, marked, parts = stack.pop()
            names[name] -= 1
            size = text - before
            if marked and size:
                free = free or chain is None
                marked_best = max(marked_best, (size, chain), key=lambda x: x[0])
            if chain and chain[0] == start and ("footer" in parts or name == "form" and parts):
                page_best = max(page_best, (size, chain), key=lambda x: x[0])
            if stack:
                stack[-1][5].update(parts)
                stack[-1][5].update({name} & PAGE_PARTS)

    for token in TOKEN.finditer(html):
        text += len(html[last:token.start()].strip())
        last = token.end()
        name = (token["name"] or "").lower()
        if name == "h1" and stack and not token["close"]:
            stack[-1][5].add(name)
        if name not in NESTED:
            continue
        if token["close"]:
            if names[name]:
                leave(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        chain = stack[-1][3] if stack else None
        if _aside(name, token["attributes"], False):
            chain = (token.start(), chain)
        names[name] += 1
        stack.append((name, token.start(), text, chain, bool(_zone(name, token["attributes"])), set()))
    text += len(html[last:].strip())
    leave(0)
    chain = None if free else marked_best[1] if marked_best[0] else page_best[1]
    frames = set()
    while chain:
        frames.add(chain[0])
        chain = chain[1]
    return frozenset(frames)


def page_lines(html: str, frames: frozenset[int] = frozenset()) -> list[tuple[str, int, str, int]]:
    """(text, characters in links, zone, container) of every line; an element that is no article text, and no frame, leaves WINDOW empty lines."""
    lines, parts, links, opened = [], [], 0, 0
    stack, skipping, zones, in_link = [], 0, [], 0
    names = Counter()  # of the elements on the stack, so that a stray end is not looked for

    def end():
        nonlocal links
        text = " ".join(unescape("".join(parts)).split()) if parts else ""
        if text:
            zone = "article" if "article" in zones else "main" if zones else ""
            lines.append((text, links, zone, stack[-1][3] if stack else 0))
        parts.clear()
        links = 0

    def leave(at):
        nonlocal skipping
        for name, aside, zone, _ in stack[at:]:
            names[name] -= 1
            skipping -= aside
            if zone:
                zones.remove(zone)
        del stack[at:]

    last = 0
    for token in TOKEN.finditer(html):
        if not skipping and token.start() > last:
            piece = html[last:token.start()]
            parts.append(piece)
            if in_link:
                links += len(" ".join(unescape(piece).split()))
        last = token.end()
        name = token["name"]
        if not name:
            continue
        name = name.lower()
        if not token["close"]:
            attributes = token["attributes"]
            if name in BLOCK and not skipping:
                end()
            elif name in CELLS:
                parts.append(" ")
            if name == "p" or name == "li" or name in NESTED:
                while stack and stack[-1][0] == "p":
                    end()
                    leave(len(stack) - 1)
            if name == "a":
                in_link = 1
            if name in VOID or attributes.endswith("/") and name not in NESTED:
                continue
            aside = not skipping and token.start() not in frames and _aside(name, attributes, bool(zones))
            if name in NESTED or aside:
                zone = "" if aside or skipping else _zone(name, attributes)
                opened += 1
                names[name] += 1
                stack.append((name, aside, zone, 0 if name in ("html", "body") else opened))
                if zone:
                    zones.append(zone)
                if aside:
                    skipping += 1
                    lines.extend([("", 0, "", 0)] * WINDOW)
        else:
            if name == "a":
                in_link = 0
            if name in BLOCK and not skipping:
                end()
            for at in range(len(stack) - 1, -1, -1) if names[name] else ():
                if stack[at][0] == name:
                    if not skipping:
                        end()
                    leave(at)
                    break
    if not skipping:
        parts.append(html[last:])
        end()
    return lines


def between_surge_and_dive(sizes: list[int], inside: list[bool], surge: int) -> list[bool]:
    """Lines of the stretches in which some window of WINDOW lines holds `surge` characters; a stretch ends at a line that is not inside."""
    keep, first = [False] * len(sizes), None
    sums = [0, *accumulate(sizes)]
    for i in range(len(sizes) + 1):
        if i < len(sizes) and inside[i]:
            first = i if first is None else first
        elif first is not None:
            if any(sums[min(i, j + WINDOW)] - sums[j] >= surge for j in range(first, i)):
                keep[first:i] = [True] * (i - first)
            first = None
    return keep


def _lines_and_sizes(html: str, frames: frozenset[int] = frozenset()) -> tuple[list[tuple[str, int, str, int]], list[int]]:
    """Lines and the lengths that windows sum: lines that are mostly links have none."""
    lines = page_lines(html, frames)
    return lines, [len(x[0]) if 2 * x[1] < len(x[0]) else 0 for x in lines]


def main_text(html: str | None) -> str:
    """The article of a page, a block per line."""
    if not html:
        return ""
    lines, sizes = _lines_and_sizes(html)
    if not any(between_surge_and_dive(sizes, [True] * len(sizes), SURGE)):
        frames = page_frames(html)
        if frames:
            lines, sizes = _lines_and_sizes(html, frames)
    tops = {zone: max((sum(s for s, x in zip(sizes[i:i + WINDOW], lines[i:i + WINDOW]) if x[2] == zone) for i in range(len(lines))), default=0)
            for zone in ("article", "main", "")}
    marked = max(tops["article"], tops["main"])
    kept = [False] * len(lines)
    for zone in tops:  # a page with little text has a surge where it has most
        surge = min(MARKED_SURGE, marked) if zone else SURGE if marked else min(SURGE, tops[zone])
        inside = [x[2] == zone and bool(s or zone == "article" and x[0]) for s, x in zip(sizes, lines)]  # links do not end an article
        found = between_surge_and_dive([s if k else 0 for s, k in zip(sizes, inside)], inside, max(1, surge))
        kept = [a or b for a, b in zip(kept, found)]
    spans: dict[int, list[int]] = {}
    for i, x in enumerate(lines):
        if kept[i] and x[3]:
            spans.setdefault(x[3], [i, i])[1] = i
    # what stands in the same element as a kept line, links only between kept lines
    kept = [k or x[3] in spans and (bool(sizes[i]) or spans[x[3]][0] < i < spans[x[3]][1]) for i, (k, x) in enumerate(zip(kept, lines))]
    return "\n".join(x[0] for x, k in zip(lines, kept) if k and x[0])


def main_texts(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The `keep` columns, text (main text, empty if there is none) and n_chars (its code points) of every row.

    Markup is stripped to lines, one for each block element; scripts, styles, comments and elements that by tag,
    role, class or id are menus, headers, footers, sidebars, notices, adverts, forms or reader comments leave empty
    lines. Text lengths are summed over sliding windows of lines; text from a surge back and forth to the next
    empty line, line of links or border of a marked part is kept. Inside of elements marked as article or main part
    a surge needs MARKED_SURGE characters, elsewhere SURGE; lines that are mostly links have no length, but do not
    end a stretch of an article. Where a page has no surge of SURGE characters, elements that only look like a form
    or header but surround the article (`page_frames`) are read again as part of the page. What stands in one element with kept text is kept. Character references are decoded, white space inside a line becomes one space.
    A null or empty page gives an empty text; rows repeat as they are; other columns are not looked at. Memory
    follows the longest page.
    """
    chosen = df.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(keep)], quoted(html).alias("html"))

    def run(batches):
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*(f"k{i}" for i in range(len(keep))), "text", "n_chars"])

    kinds = "".join(f"k{i} {chosen.schema[i].dataType.simpleString()}, " for i in range(len(keep)))
    out = chosen.mapInArrow(run, kinds + "text string, n_chars long")
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})
