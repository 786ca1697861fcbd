"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element. A line's weight is its length (CAP at most), times ARTICLE in an article
or main element, times LOW if a class name or id speaks of other parts or most of it is links, and times OUT in a menu,
footer, form, advert or hidden element. Tags weigh lines, but cut none: weights are summed over windows of WINDOW lines along
the whole page. The text surges where a sum reaches the part SURGE of the largest one, from the first line that is long itself or a
heading, and dives where a sum falls below DIVE of it; what lies between is a run. The highest run is the text, and so is another that reaches RIVAL of
it, TEASER in an article. Around chosen lines, lines of the same article or the same parent belong to them: short ones, lists of
links, sections with such names. Outer parts are left out, unless the page has nothing else (from FLOOR weights on).

Each page is handled alone, so nothing is shuffled. Time is in proportion to a page's length: ends of tags, comments and raw elements are
sought once, also on broken markup.

Defined cases: a null or empty html gives empty text; unclosed elements end with their parent, and an unclosed tag is text; a repeated page gets a
row each time; of equal runs each reaches the other; a column of pages named as the output is replaced, others
stay whatever their names; an empty table gives none.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import table

WINDOW, LINKS = 3, 0.6
ARTICLE, LOW, OUT, CAP = 4, 0.05, 0.005, 400
SURGE, DIVE, TEASER, RIVAL, FLOOR = 0.2, 0.15, 0.2, 0.5, 5
#: A run begins with a line of this part of SURGE, or a heading.
EDGE = 0.3

# Elements of HTML by their part in a page.
BLOCKS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav aside footer form menu dialog button select fieldset".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|textarea|head|audio|video"
#: Elements that hold text in a parent that holds more of it.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote".split())
#: Parts of class names and ids that no part of an article has, and those that sections of one may have, too.
MARKS = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|signup|paywall|menu|nav|navbar|navigation|breadcrumbs?|pager|pagination|sidebar|widget|masthead|topbar|toolbar|share|sharing|social|recommended|recommendations|trending|commentlist|disqus|login)(?=$|[\s_-])", re.I)
FAINT_MARKS = re.compile(r"(?:^|[\s_-])(?:notices?|alert|side|footer|header|related|comments?|replies|reply|respond|discussion|responses|search|skip|copyright|legal|disclaimer|toc)(?=$|[\s_-])", re.I)
ARTICLE_MARKS = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main|content)(?:[_-]?(?:body|content|text))?(?=$|\s)", re.I)

_RAW_OPEN = re.compile(rf"<({RAW})\b[^>]*>", re.I)
_HEAD = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)|<[!?]")
_ATTRIBUTES = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+")
_ATTRIBUTE = re.compile(r"\"[^\"]*\"|'[^']*'|([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _without_raw(page: str) -> str:
    """page without comments and without elements whose content isn't text."""
    out, at = [], 0
    opener = re.compile(r"<!--|" + _RAW_OPEN.pattern, re.I)
    low, last = page.lower(), page.rfind(">") + 1
    unclosed: set[str] = set()
    # No tag ends behind the last `>`, so none is sought there.
    while m := opener.search(page, at, last):
        out.append(page[at : m.start()])
        if m[1] is None:
            end = low.find("-->", m.end())
            at = end + 3 if end >= 0 else len(page)
        else:
            name = m[1].lower()
            end = -1 if name in unclosed else low.find(f"</{name}", m.end())
            if end < 0 and name not in ("script", "style"):
                unclosed.add(name)  # nor is there an end for those that follow
                at = m.end()
                continue
            close = low.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else len(page)
        out.append(" " if m[1] is None else "")
    rest = page[at:]
    out.append(rest[: rest.find("<!--")] if "<!--" in rest else rest)
    return "".join(out)


def _tags(page: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """(start, end, whether it ends an element, name, attributes) of the tags; of declarations the name is None.

    An attribute's quote that isn't closed makes the tag end at the next `>`. Where reading attributes has failed once,
    tags up to that place end so, too, so that no stretch is read again and again.
    """
    at, failed, close, last = 0, 0, -1, page.rfind(">")
    while (at := page.find("<", at)) >= 0 and at < last:
        head = _HEAD.match(page, at)
        if head is None:
            at += 1
            continue
        end = -1
        if head[2] is not None and at >= failed:
            body = _ATTRIBUTES.match(page, head.end())
            end = body.end() if page[body.end() : body.end() + 1] == ">" else -1
            failed = failed if end >= 0 else body.end()
        if end < 0:
            if close < head.end():
                close = page.find(">", head.end())
            end = close
        yield at, end + 1, bool(head[1]), head[2], page[head.end() : end] if head[2] is not None else ""
        at = end + 1


def lines_of(page: str) -> tuple[list[tuple[str, int, int, int, int, str]], list[int]]:
    """(text, characters in links, level, article's number or 0, element's number and name) of each block, and the elements' parents.

    Level: 0 text, 1 a part that may be of the article, 2 outside it. The page and its body are number 0.
    """
    out: list[tuple[str, int, int, int, int, str]] = []
    stack: list[tuple[str, int, int, int]] = []  # element, level, article, number
    up = [0]
    depth: Counter[str] = Counter()  # how many elements of a name are open, so that stray end tags cost nothing
    parts: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            name, level, article, number = stack[-1] if stack else ("body", 0, 0, 0)
            out.append((text, links, level, article, number, name))
        parts.clear()
        links = 0

    def say(raw: str) -> None:
        nonlocal links
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if linked:
                links += len(text.strip())

    def push(name: str, level: int, article: int, number: int) -> None:
        stack.append((name, level, article, number))
        depth[name] += 1

    def close(name: str) -> None:
        while depth[name]:
            top = stack.pop()[0]
            depth[top] -= 1
            if top == name:
                return

    page = _without_raw(page)
    at = 0
    for start, end, ends, tag, attributes in _tags(page):
        say(page[at:start])
        at = end
        if tag is None:
            continue
        name = tag.lower()
        if name == "a":
            linked = 0 if ends else 1
            continue
        if name not in BLOCKS:
            if name == "img":
                parts.append(" ")
            # Marked inline elements, such as a span that holds an advert, count as blocks of their own.
            if ends:
                if depth[name] and not any(x[0] in BLOCKS for x in stack[-1:]):
                    flush()
                    close(name)
            elif attributes and name not in VOID and _level(name, attributes, stack) == 2:
                flush()
                up.append(stack[-1][3] if stack else 0)
                push(name, 2, stack[-1][2] if stack else 0, len(up) - 1)
            continue
        flush()
        if name in VOID:
            continue
        if ends:
            close(name)
            linked = 0
            continue
        if name == "p" and stack and stack[-1][0] == "p" or name == "li" and stack and stack[-1][0] == "li":
            close(name)
        _, level, article, parent = stack[-1] if stack else ("", 0, 0, 0)
        level = max(level, _level(name, attributes, stack))
        number = 0
        if name not in ("html", "body"):
            number = len(up)
            up.append(parent)
        if name in ("article", "main") and level < 2:
            article = number
        push(name, level, article, number)
    say(page[at:])
    flush()
    return out, up


def _level(name: str, attributes: str, stack: list[tuple[str, int, int, int]]) -> int:
    inside_article = bool(stack) and stack[-1][2] > 0
    if name in OUTSIDE or name == "header" and not inside_article:
        return 2
    if not attributes or name in ("html", "body", "article", "main"):
        return 0
    level = 0
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return 2
        if key == "role" and value.lower() in OUTSIDE_ROLES:
            return 2
        if key in ("class", "id") and not (name.startswith("h") and name[1:].isdigit()) and not ARTICLE_MARKS.search(value):
            level = max(level, 2 if MARKS.search(value) else 1 if FAINT_MARKS.search(value) else 0)
    return level


def runs(weight: list[float], heading: list[bool]) -> list[tuple[int, int, float]]:
    """(first line, last line + 1, largest sum) of the stretches from a surge to a dive, in order."""
    totals = [0.0, *accumulate(weight)]
    sums = [totals[min(i + WINDOW, len(weight))] - totals[i] for i in range(len(weight))]
    top = max(sums, default=0.0)
    out: list[tuple[int, int, float]] = []
    i = 0
    while i < len(sums):
        if sums[i] < SURGE * top or not (heading[i] and weight[i] > 0 or weight[i] >= EDGE * SURGE * top):
            i += 1
            continue
        end = i + 1
        while end < len(sums) and sums[end] >= DIVE * top:
            end += 1
        out.append((i, end, max(sums[i:end])))
        i = end
    return out


def main_text(page: str | None) -> str:
    lines, up = lines_of(page or "")
    outer = [level == 2 for _, _, level, _, _, _ in lines]
    low = [level == 1 or links > LINKS * len(text) for text, links, level, _, _, _ in lines]
    weight = [min(CAP, len(text)) * (ARTICLE if article else 1) * (OUT if out else LOW if faint else 1) for (text, _, _, article, _, _), faint, out in zip(lines, low, outer)]
    if all(outer):
        if sum(weight) < FLOOR:
            return ""
        outer = [False] * len(lines)
    found = runs(weight, [name[0] == "h" and name[1:].isdigit() for *_, name in lines])
    best = max((high for _, _, high in found), default=0.0)
    surged = [k for begin, end, high in found if high >= RIVAL * best or high >= TEASER * best and lines[begin][3] for k in range(begin, end) if not outer[k]]
    # Marked parts alone are text only where there is nothing else.
    chosen = {k for k in surged if not low[k]} or set(surged)
    leaf = [name in LEAVES for *_, name in lines]
    holds = {x for k in chosen for x in (lines[k][3], lines[k][4], up[lines[k][4]] if leaf[k] else lines[k][4])}
    within = [False] * len(up)
    for e in range(1, len(up)):
        within[e] = e in holds or within[up[e]]
    beside = {up[lines[k][4]] for k in chosen if leaf[k]}
    kept = (k for k in range(len(lines)) if k in chosen or not outer[k] and (within[lines[k][4]] or not low[k] and leaf[k] and up[lines[k][4]] in beside))
    return " ".join(lines[k][0] for k in kept)


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text in place of the html."""
    names = [c for c in pages.columns if c not in (html, out)]

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(html)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], [*names, out])

    return pages.mapInArrow(run, T.StructType([*(pages.schema[c] for c in names), T.StructField(out, T.StringType())]))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
