"""Main text of web pages by two-pass block rules.

Method.  A page is cut at block-level tags.  First pass: each block is judged on
its own, by stop-word density, length and link density, as good, bad, short or
near-good.  Second pass: short and near-good blocks take the label of their
nearest decided neighbours.  Blocks within parts that the markup itself names as
not content (navigation, forms, notices, adverts, comments, scripts, ...) are
bad from the start.  Where the markup names the article, that is a prior on the
first pass: inside, a block that is short or poor in stop words is near-good and
one with many links is short; outside, a near-good block is short.  Blocks of
the article inherit from each other, and its edges count as good.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quernstone.llm.stopwords import ALL_STOP_WORDS

#: Thresholds of the first pass: link density, lengths in characters, stop-word densities.
MAX_LINKS, SHORT, LONG = 0.35, 70, 200
STOP_LOW, STOP_HIGH = 0.20, 0.30
#: Within a named article a block is bad in the first pass only if so much of it is links.
ARTICLE_LINKS = 0.75

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>""", re.DOTALL)
_ATTR = re.compile(r"""([A-Za-z_:][-A-Za-z0-9_:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Their content is no markup; nothing of it is text of the page.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for t in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul button label".split())
#: Parts that are never content.
_OUT = set("nav footer aside form button select option optgroup label fieldset legend dialog menu svg math canvas audio video object embed applet map head input".split())
_HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adsense|adverts?|advertisement|advertising|adbox|banner|sponsor(?:ed|s)?|promo(?:tion|s)?|sidebar|side|menus?|nav|navbar|navigation|breadcrumbs?|footer|foot|masthead|topbar|toolbar|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|comments?|comment-?list|disqus|respond|replies|widget|pagination|pager|skip|copyright|legal|search|form|tags|byline-?ads|header)(?:$|[\s_-])",
    re.IGNORECASE,
)
_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar", "note"}
_MAIN_HINT = re.compile(r"(?:^|\s)(?:article-?(?:body|content|text)|post-?(?:body|content|text)|entry-?content|main-?content|story-?body)(?:$|\s)", re.IGNORECASE)
#: An end tag closes open elements up to its own, but not across these.
_WORD = re.compile(r"[^\W\d_]+")


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(source)} if source.strip(" /\t\r\n") else {}


class Block:
    __slots__ = ("parts", "linked", "inside", "outside", "heading")

    def __init__(self, inside: bool, outside: bool, heading: bool):
        self.parts, self.linked = [], 0
        self.inside, self.outside, self.heading = inside, outside, heading

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def blocks(page: str) -> tuple[list[tuple[str, float, bool, bool, bool]], bool]:
    """[(text, link density, in the article, in a part that is no content, heading)] and whether an article is named."""
    found: list[tuple[str, float, bool, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, names the article, is no content
    open_tags: Counter[str] = Counter()
    block = Block(False, False, False)
    main = out = links = heads = 0
    named = False
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal block
        text = block.text()
        if text:
            found.append((text, min(1.0, block.linked / len(text)), block.inside, block.outside, block.heading))
        block = Block(main > 0, out > 0, heads > 0)

    def say(raw: str) -> None:
        text = htmllib.unescape(raw) if "&" in raw else raw
        block.parts.append(text)
        if links:
            block.linked += len("".join(text.split()))

    def close(tag: str) -> None:
        nonlocal main, out, links, heads
        t, m, o = stack.pop()
        open_tags[t] -= 1
        main -= m
        out -= o
        links -= t == "a"
        heads -= t in ("h1", "h2", "h3", "h4", "h5", "h6")

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        m = _TAG.match(page, lt)
        if not m:
            say("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag in _BLOCK:
                flush()
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None) if open_tags[tag] else None
            if depth is not None and not (tag in ("a", "b", "i", "em", "strong", "span", "font", "u") and any(s[0] in _BLOCK for s in stack[depth + 1 :])):
                while len(stack) > depth:
                    close(tag)
            elif depth is not None:  # a formatting element that blocks were opened in: only itself ends
                t, was_main, was_out = stack.pop(depth)
                open_tags[t] -= 1
                main, out, links = main - was_main, out - was_out, links - (t == "a")
            if tag in _BLOCK:
                block = Block(main > 0, out > 0, heads > 0)
            continue
        if tag in _RAW:
            stop = _RAW_END[tag].search(page, at)
            at = stop.end() if stop else end
            continue
        if tag == "br" or tag == "hr":
            if tag == "hr":
                flush()
            else:
                block.parts.append(" ")
            continue
        if tag in _VOID:
            continue
        source = m[3] if m[2] else m[6]
        attrs = _attributes(source or "")
        if tag in _BLOCK:
            flush()
            # what a new block closes by itself
            if tag == "li":
                _close_implied(stack, close, {"li"}, {"ul", "ol", "menu"})
            elif tag in ("td", "th"):
                _close_implied(stack, close, {"td", "th"}, {"table", "tr"})
            elif tag == "tr":
                _close_implied(stack, close, {"tr"}, {"table"})
            elif tag in ("dd", "dt"):
                _close_implied(stack, close, {"dd", "dt"}, {"dl"})
            if open_tags["p"]:
                _close_implied(stack, close, {"p"}, {"button", "table", "td", "th", "article", "section", "div", "li"})
        if (source or "").rstrip().endswith("/") and tag not in _BLOCK:
            continue
        label = f"{attrs.get('class', '')} {attrs.get('id', '')}"
        structural = tag in ("html", "body", "main")
        is_main = not out and (tag == "main" or tag == "article" or attrs.get("role", "").lower() in ("main", "article") or "articlebody" in attrs.get("itemprop", "").lower() or bool(_MAIN_HINT.search(label)))
        is_out = tag in _OUT or (not structural and (("hidden" in attrs and attrs["hidden"] != "until-found") or attrs.get("aria-hidden", "") == "true" or attrs.get("role", "").lower() in _ROLE or re.search(r"display\s*:\s*none", attrs.get("style", "")) is not None))
        if not is_out and not structural and label != " ":
            hint = _HINT.search(label)
            is_out = bool(hint) and not (hint.group().strip(" _-").lower() == "header" and main > 0) and not _MAIN_HINT.search(label)
        if tag == "header" and not main:
            is_out = True
        if is_out:
            is_main = False
        named = named or is_main
        stack.append((tag, is_main, is_out))
        open_tags[tag] += 1
        main += is_main
        out += is_out
        links += tag == "a"
        heads += tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        if tag in _BLOCK:
            block = Block(main > 0, out > 0, heads > 0)
        elif is_out != block.outside and is_out:
            # inline element that is no content: its text is kept apart
            flush()
            block = Block(main > 0, True, heads > 0)
    flush()
    return found, named


def _close_implied(stack: list, close, tags: set, stop: set) -> None:
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in tags:
            while len(stack) > i:
                close(stack[-1][0])
            return
        if stack[i][0] in stop:
            return


def first_pass(text: str, links: float, inside: bool, outside: bool, named: bool) -> str:
    if outside:
        return "bad"
    label = _by_itself(text, links)
    if inside and label in ("bad", "short"):
        if links > MAX_LINKS:
            return "bad" if links > ARTICLE_LINKS and len(text) < LONG else "short"
        return "near"
    return "short" if named and not inside and label == "near" else label


def _by_itself(text: str, links: float) -> str:
    if links > MAX_LINKS:
        return "bad"
    if len(text) < SHORT:
        return "bad" if links > 0 else "short"
    words = [w.lower() for w in _WORD.findall(text)]
    density = sum(w in ALL_STOP_WORDS for w in words) / max(1, len(words))
    if density >= STOP_HIGH:
        return "good" if len(text) > LONG else "near"
    if density >= STOP_LOW:
        return "near"
    return "bad" if links > 0 else "short"  # other text without a link: as ambiguous as a short block


def _nearest(labels: list[str], near: bool, edge: str, back: bool) -> list[str]:
    """For every block: the nearest decided label behind (or ahead), near-good ones counted as good if ``near``."""
    out, last = [], edge
    for label in labels if back else reversed(labels):
        out.append(last)
        if label in ("good", "bad") or (near and label == "near"):
            last = "bad" if label == "bad" else "good"
    return out if back else out[::-1]


def second_pass(labels: list[str], headings: list[bool], edge: str = "bad") -> list[bool]:
    """Ambiguous blocks inherit from the nearest decided neighbours; a page's edge counts as bad, an article's as good."""
    if "good" not in labels:  # a page without any good block has its near-good ones
        labels = ["good" if x == "near" else x for x in labels]
    # headings go with what follows
    ahead = _nearest(labels, True, edge, False)
    decided = ["near" if x == "short" and h and a == "good" else x for x, h, a in zip(labels, headings, ahead, strict=True)]
    before, after = _nearest(decided, False, edge, True), _nearest(decided, False, edge, False)
    loose_before, loose_after = _nearest(decided, True, edge, True), _nearest(decided, True, edge, False)
    out = list(decided)
    for i, label in enumerate(decided):
        if label == "short":
            if before[i] == after[i]:
                out[i] = before[i]
            else:  # between good and bad: a near-good one on the bad side tips the scale
                out[i] = "good" if loose_before[i] == loose_after[i] == "good" else "bad"
    ahead, behind = _nearest(out, False, edge, False), edge
    for i, label in enumerate(out):
        if label == "near":
            out[i] = "bad" if behind == ahead[i] == "bad" else "good"
        behind = out[i]
    return [x == "good" for x in out]


def extract_text(page: str | None) -> str:
    """The article's blocks in page order, two line feeds between."""
    if not page:
        return ""
    found, named = blocks(page)
    labels = [first_pass(t, links, inside, outside, named) for t, links, inside, outside, _ in found]
    heads = [h for *_, h in found]
    keep = second_pass(labels, heads)
    own = [i for i, (_, _, inside, outside, _) in enumerate(found) if inside and not outside]
    for i, good in zip(own, second_pass([labels[i] for i in own], [heads[i] for i in own], "good"), strict=True):
        keep[i] = good
    return "\n\n".join(f[0] for f, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A null or empty page has an empty text; null ids and urls and repeated rows
    pass through; an empty table gives no rows; other columns are not read.
    """
    id_type, url_type = pages.schema[id_col].dataType.simpleString(), pages.schema[url_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract_text(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html")).mapInArrow(run, f"page_id {id_type}, url {url_type}, text string, n_chars bigint")
