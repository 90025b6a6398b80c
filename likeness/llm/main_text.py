"""Main text of web pages: blocks labelled content or boilerplate by a minimum cut."""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from likeness.llm.common import small_batches

# What elements and names mean.
SKIPPED = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "head", "title", "audio", "video"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s",
          "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "data", "ruby", "rb", "rt", "rp"}
BOILER = {"nav": -9.0, "footer": -9.0, "aside": -9.0, "header": -5.0, "menu": -9.0, "form": -9.0, "button": -9.0, "select": -9.0,
          "option": -9.0, "textarea": -9.0, "dialog": -9.0, "label": -3.0, "legend": -6.0, "fieldset": -6.0, "address": -3.0}
CONTENT = {"article": 5.0, "main": 3.5}
BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adv|banner|promo|promoted|sponsor(?:ed)?|sidebar|side|nav|navbar|navigation|menu|breadcrumbs?|"
    r"footer|foot|header|masthead|comments?|comment-list|disqus|respond|replies|reply|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|"
    r"newsletter|subscribe|signup|login|share|sharing|social|related|recommended|widget|toolbar|pagination|pager|tags|skip|legal|copyright|"
    r"search|meta|byline|kommentare?|commentaires?|comentarios?|werbung|anzeigen?|publicit[eé]|publicidad|fu(?:ss|ß)zeile|seitenleiste|"
    r"kopfzeile|pied|pie|barra|hinweis|aviso|avis)(?:$|[\s_-])", re.I)
GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|body|main|text)(?:$|[\s_-])", re.I)
_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_EDGE = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BLANK = re.compile(r"\s+")


class Block:
    __slots__ = ("text", "links", "score", "parent", "zone", "depth", "tag")

    def __init__(self, text: str, links: int, score: float, parent: int, zone: int, depth: int, tag: str):
        self.text, self.links, self.score = text, links, score
        self.parent, self.zone, self.depth, self.tag = parent, zone, depth, tag


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}


def _element_score(tag: str, raw: str) -> tuple[float, bool]:
    """What an element says about the text in it, and whether it opens a zone of its own."""
    score = BOILER.get(tag, CONTENT.get(tag, 0.0))
    zone = bool(score) or tag in ("section", "table")
    if raw.strip():
        a = _attributes(raw)
        name = " ".join(a.get(k, "") for k in ("class", "id", "role", "aria-label"))
        if tag not in ("html", "body") and BAD_NAME.search(name):
            score, zone = score - 8.0, True
        elif GOOD_NAME.search(name):
            score, zone = score + 2.0, True
        if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
            score, zone = score - 9.0, True
    return score, zone


def _tokens(page: str) -> Iterator[tuple[str, bool, str, str, int]]:
    """(text before, closing, tag, attributes, end) of every tag; a last one without a tag holds the text left.

    Comments and declarations have an empty tag. The caller may send back where to go on. Every
    character is passed a bounded number of times: once a quote is found to stay open, quotes no longer
    hide ``>``, and behind the last ``>`` there are no tags.
    """
    at, text_at, size, last, quotes = 0, 0, len(page), page.rfind(">"), True
    while m := _OPEN.search(page, at):
        start, tag = m.start(), m[2] or ""
        if page.startswith("<!--", start):
            end = page.find("-->", m.end())
            end = size if end < 0 else end + 3
        elif not tag:
            end = page.find(">", m.end()) + 1 or size
        elif m.end() > last:
            break
        else:
            end, i = 0, m.end()
            while quotes and not end:
                edge = _EDGE.search(page, i)
                if edge and edge[0] == ">":
                    end = edge.end()
                else:
                    i = page.find(edge[0], edge.end()) + 1 if edge else 0
                    quotes = i > 0
            end = end or page.find(">", m.end()) + 1
        resume = yield page[text_at:start], bool(m[1]), tag.lower(), page[m.end():end - 1] if tag else "", end
        at = text_at = end if resume is None else resume
        if resume is not None:
            yield "", False, "", "", resume
    yield page[text_at:], False, "", "", size


class _Element:
    """An open element with what its ancestors add up to."""
    __slots__ = ("tag", "serial", "total", "scored", "skipped")

    def __init__(self, tag: str, serial: int, score: float, outer: _Element | None):
        self.tag, self.serial = tag, serial
        self.total = score + (outer.total if outer else 0.0)
        self.scored = serial if score else (outer.scored if outer else 0)
        self.skipped = tag in SKIPPED or bool(outer and outer.skipped)


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order; markup that is broken is read as browsers do, roughly. Linear in the page."""
    out: list[Block] = []
    stack: list[_Element] = []
    open_tags: Counter[str] = Counter()
    pieces: list[str] = []
    serial = links = in_link = 0

    def flush() -> None:
        nonlocal links
        if pieces:
            text = _BLANK.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                top = stack[-1] if stack else _Element("", 0, 0.0, None)
                out.append(Block(text, links, top.total, top.serial, top.scored, len(stack), top.tag))
            pieces.clear()
        links = 0

    def pop() -> None:
        open_tags[stack.pop().tag] -= 1

    tokens = _tokens(page)
    for text, closing, tag, raw, end in tokens:
        if text and not (stack and stack[-1].skipped):
            pieces.append(text)
            if in_link:
                links += len(text)
        if not tag:
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in INLINE and tag != "label" or tag == "html" and not closing and open_tags["html"]:
            continue
        flush()
        if closing:
            if open_tags[tag]:
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag in VOID or raw.endswith("/"):
            continue
        if stack and stack[-1].tag == tag and tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):
            pop()
        elif stack and stack[-1].tag == "p":
            pop()
        if tag in RAW and tag in SKIPPED:
            close = re.compile(rf"</{tag}\b", re.I).search(page, end)
            stop = page.find(">", close.end()) + 1 if close else 0
            tokens.send(stop or len(page))
            continue
        if tag == "body":
            while stack and stack[-1].tag != "html":
                pop()
        serial += 1
        element = _Element(tag, serial, _element_score(tag, raw)[0], stack[-1] if stack else None)
        stack.append(element)
        open_tags[tag] += 1
    flush()
    return out


# Costs ----------------------------------------------------------------------------------------
def unary(block: Block) -> float:
    """Log-odds that a block is content."""
    n = len(block.text)
    value = -0.5 + block.score + min(n, 400) / 160 - 4.0 * block.links / max(n, 1)
    if block.tag == "p":
        value += 1.0
    elif block.tag in ("h1", "h2", "h3", "h4", "blockquote", "pre"):
        value += 0.5
    elif block.tag in ("li", "td", "dd"):
        value -= 0.3
    if block.text[-1:] in ".!?…":
        value += 0.5
    return value


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in the page and between nearest blocks of one parent."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            edges.append((i - 1, i, (1.0 if a.zone == b.zone else 0.15) / (1 + abs(a.depth - b.depth) * 0.5)))
        if b.parent in last and last[b.parent] < i - 1:
            edges.append((last[b.parent], i, 0.5))
        last[b.parent] = i
    return edges


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: a label against its gain costs it, unlike labels across an edge cost its weight.

    A node whose gain outweighs all its edges keeps its sign; its edges become terminal capacity of
    their other ends. What is left is a maximum flow along shortest augmenting paths.
    """
    n = len(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    gain = list(gain)
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(gain[i]) >= sum(near[i].values()):
            label[i] = gain[i] > 0
            for j, w in near[i].items():
                gain[j] += w if label[i] else -w
                del near[j][i]
                if label[j] is None:
                    queue.append(j)
            near[i] = {}
    for free in _parts(label, near):
        for i, side in zip(free, _max_flow(free, gain, near), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def _parts(label: list[bool | None], near: list[dict[int, float]]) -> Iterator[list[int]]:
    """The undecided nodes, a list for each connected part; no flow passes between parts."""
    seen: set[int] = set()
    for first, side in enumerate(label):
        if side is not None or first in seen:
            continue
        part, at = [first], 0
        seen.add(first)
        while at < len(part):
            fresh = [j for j in near[part[at]] if label[j] is None and j not in seen]
            seen.update(fresh)
            part += fresh
            at += 1
        yield part


def _max_flow(free: list[int], gain: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Which of the free nodes stay with the content terminal once no augmenting path is left."""
    source, sink = -1, -2
    left: dict[int, dict[int, float]] = {i: dict(near[i]) for i in free}
    left[source] = {i: gain[i] for i in free if gain[i] > 0}
    left[sink] = {}
    for i in free:
        if gain[i] < 0:
            left[i][sink] = -gain[i]
            left[sink][i] = 0.0
        elif gain[i] > 0:
            left[i][source] = 0.0
    while True:
        came = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            i = queue.popleft()
            for j, c in left[i].items():
                if c > 1e-12 and j not in came:
                    came[j] = i
                    queue.append(j)
        if sink not in came:
            return [i in came for i in free]
        path, at = [], sink
        while at != source:
            path.append((came[at], at))
            at = came[at]
        flow = min(left[a][b] for a, b in path)
        for a, b in path:
            left[a][b] -= flow
            left[b][a] = left[b].get(a, 0.0) + flow


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    keep = minimum_cut([unary(b) for b in blocks], smoothness(blocks))
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Every row of ``pages`` with _text, the page's main text, and _n_chars, its code points.

    Each page becomes blocks between block-level tags. A block's classifier score is the capacity of
    its edges to the terminals; neighbouring blocks and blocks of one parent are tied by smoothness
    edges; the minimum cut labels them. Character references are decoded, white space inside a block
    is one space, blocks are joined by one space in page order. Null and empty pages have an empty
    text. Rows are independent, so nothing is shuffled; other columns stay,
    but for those named _text and _n_chars.
    """
    small_batches(pages.sparkSession)
    pages = pages.drop("_text", "_n_chars")
    names = pages.columns
    at = names.index(html_col)
    plain = pages.toDF(*(f"c{i}" for i in range(len(names))))      # any column name may come in
    columns = [*plain.columns, "_text", "_n_chars"]

    def run(batches):
        for batch in batches:
            texts = [main_text(x or "") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=columns)

    shape = StructType([*plain.schema.fields, StructField("_text", StringType()), StructField("_n_chars", LongType())])
    return plain.mapInArrow(run, shape).toDF(*names, "_text", "_n_chars")
