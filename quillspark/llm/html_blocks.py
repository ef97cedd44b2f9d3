"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose content is never text of a page.
RAW = ("script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "head", "title", "select", "textarea", "button")
#: Elements that stand beside the article.
BESIDE = ("nav", "footer", "aside", "form", "dialog", "menu")
#: Elements that begin and end a line. Others are inline.
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
#: Elements that may carry a name that marks their content as being beside the article.
HOLDERS = frozenset("div section ul ol p span table td tr li header details figure main article".split())
#: Class, id or role values, each as a whole, that mark menus, adverts, notices, comments and the like. A mark may have a name before it that says where or whose, and one after it that says what it looks like.
MARKS = re.compile(
    r"(?:^|\s)(?:(?:site|page|main|top|bottom|left|right|global|post|entry|blog|user|reader|cookie|social|primary|secondary)[_-])*"
    r"(?:ads?|adverts?|advertisement|adsense|banner|breadcrumbs?|combx|comments?|commentlist|complementary|contentinfo|cookies?|consent|copyright|disclaimer|discussion|disqus|foot|footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|alert|popup|promo|promoted|related|recommended|replies|search|share|sharing|sidebar|side|skip|social|sponsor|sponsored|subscribe|toolbar|topbar|widget|site-header|page-header)"
    r"(?:[_-](?:area|bar|block|body|box|buttons?|container|content|form|items?|links?|list|menu|notice|panel|posts?|section|text|thread|wrap|wrapper|\d+))*(?=$|\s)",
    re.I,
)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)""", re.S)
ENDS = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}


class _Closes:
    """Whether an element that is open is closed further on, in time linear in the page for all questions together.

    One pass finds all tags; for a name, the depth after each of its tags and the least depth from there on tell
    whether an element open at a place is ever closed.
    """

    def __init__(self, page: str) -> None:
        self._page, self._tags, self._names, self._unended = page, None, {}, set()

    def __call__(self, at: int, name: str, depth: int) -> bool:
        if self._tags is None:
            self._tags = {}
            for m in TOKEN.finditer(self._page):
                if m[2] is not None and not m[3].rstrip().endswith("/"):
                    self._tags.setdefault(m[2].lower(), []).append((m.start(), -1 if m[1] else 1))
        if name not in self._names:
            found = self._tags.get(name, [])
            depths = list(accumulate((d for _, d in found), initial=0))
            least = list(accumulate(reversed(depths), min))[::-1]
            self._names[name] = [p for p, _ in found], depths, least
        places, depths, least = self._names[name]
        i = bisect_left(places, at)
        return i < len(places) and least[i + 1] <= depths[i] - depth

    def end_of(self, at: int, name: str) -> re.Match | None:
        """The end tag of a raw element after a place; a page without one is searched once a name."""
        if name in self._unended:
            return None
        found = ENDS[name].search(self._page, at)
        if found is None:
            self._unended.add(name)
        return found


def page_lines(page: str) -> list[tuple[str, int, bool]]:
    """Lines of a page in order: (text, characters in links, inside an article). Stripped parts leave empty lines."""
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = at = article = link_from = 0
    skip, depth, in_link, held = "", 0, False, None

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            lines.append((text, min(linked, len(text)), article > 0))
        parts, linked = [], 0

    def gap() -> None:
        flush()
        if lines and lines[-1][0]:
            lines.append(("", 0, article > 0))

    def take(raw: str) -> None:
        nonlocal linked
        if raw and not skip:
            text = html_lib.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    size, closes = len(page), _Closes(page)
    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            take(page[at:])
            break
        take(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if skip:
            if name in ("article", "main") and not closing and skip not in ("article", "main") and held is None:
                held = skip not in ("header", "form") and name == "article" and closes(at, skip, depth)
            if name in ("article", "main") and not closing and skip not in ("article", "main") and not held:
                skip = ""  # an unclosed element beside the article
            elif name == skip:
                if m[3].rstrip().endswith("/"):
                    continue
                depth += -1 if closing else 1
                if depth <= 0:
                    skip = ""
                continue
            elif skip in ("p", "li", "td", "tr") and not closing and name in BLOCK:
                skip = ""  # these end where the next block begins
            elif name in ("body", "html") and closing:
                skip = ""
            else:
                if name in RAW and not closing:
                    e = closes.end_of(at, name)
                    at = e.end() if e else (size if name in ("script", "style") else at)
                continue
        if name in RAW:
            if not closing and not m[3].rstrip().endswith("/"):
                e = closes.end_of(at, name)
                if e or name in ("script", "style", "textarea", "title"):
                    at = e.end() if e else size
                gap()
            continue
        if not closing and not m[3].rstrip().endswith("/"):
            beside = name in BESIDE or (name == "header" and not article)
            if not beside and m[3] and name in HOLDERS:
                beside = any(MARKS.search(next(filter(None, v), "")) for v in NAMED.findall(m[3]))
            if beside:
                gap()
                skip, depth, in_link, held = name, 1, False, None
                continue
        if name in BLOCK:
            flush()
            if name in ("article", "main"):
                article = max(0, article + (-1 if closing else 1))
        elif name == "a":
            in_link = not closing
        elif name in ("br", "td", "th", "img", "input", "option", "wbr") and name != "wbr":
            parts.append(" ")
    flush()
    return lines


def main_text(page: str | None, window: int = 3, surge: int = 30, link_share: float = 0.5) -> str:
    """The text between surge and dive points of one page.

    Each line weighs its characters outside links. Where a page has an article, lines outside it weigh a
    quarter, stretches end at its borders, and all lines inside it are kept. The block at a line is the sum of weights of `window` lines from it, where an empty line, left by
    stripped parts, ends the block. A surge is a line whose block reaches `surge` after the stretch before it
    was empty, a dive the point where the block falls to 0. Lines from surge to dive are kept. Where no block
    surges, the heaviest stretch is kept.
    """
    lines = page_lines(page) if page else []
    has_article = any(inside and text for text, _, inside in lines)
    stretches: list[tuple[int, list[str]]] = []
    share = [1 if inside or not has_article else 0.25 for _, _, inside in lines]
    weights = [(len(t) - n) * by if n < link_share * len(t) or inside and has_article else 0 for (t, n, inside), by in zip(lines, share, strict=True)]
    texts = [t for t, _, _ in lines]
    i = 0
    while i < len(lines):
        if not weights[i]:
            i += 1
            continue
        j, best = i, 0
        while j < len(lines) and weights[j] and share[j] == share[i]:
            block = 0
            for k in range(j, min(j + window, len(lines))):
                if not weights[k] or share[k] != share[i]:
                    break
                block += weights[k]
            best = max(best, block)
            j += 1
        stretches.append((max(best, surge) if has_article and share[i] == 1 else best, texts[i:j]))
        i = j
    kept = [s for s in stretches if s[0] >= surge]
    if not kept and stretches:
        kept = [max(stretches, key=lambda s: s[0])]
    return "\n\n".join(t for _, s in kept for t in s)


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every row of pages(page_id, url, html): page_id, url, text, n_chars.

    Null or empty html, and pages without text, give an empty text and n_chars 0. page_id and url are passed
    on as they are, nulls and repeats included. Whole pages are read, one at a time; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [main_text(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
