"""HTML extraction (3): consensus host paths.

Each page is parsed once to score its containers: paragraphs give points to the container they
are in and half to the one around it, links and names of page furniture take them away. Every
container with a score votes for its generalised path (tags and classes from the root, digits as #,
no positions); a path has one vote of each page, the share of its best container in the page's best
score, in millionths. Spark adds the votes up for each host, exactly, and every page is extracted
again from the elements on its host's winning path.

Defined cases: a page without an element on the winning path gives the text of its own best
container (method own), one without any text '' (none); null html gives null text (none); urls
without a host, null ones too, have no consensus; a tie goes to the path with more first places,
then to the smaller string; repeated rows vote and are returned as often as they occur; an empty
table gives an empty result; other columns are ignored. Broken markup is read leniently.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadledger.llm import base

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>|<(/?)([a-zA-Z][\w:-]*)([^>]*+)>|<[!?][^>]*+>",
    re.S | re.I,
)
CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOX = frozenset("html body main article section div td th blockquote form ul ol dl table tbody tr nav aside header footer details figure center".split())
BLOCK = BOX | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre br hr address fieldset figcaption summary title thead tfoot caption option".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCE = frozenset("div article section main body html td th table ul ol dl blockquote form nav aside header footer".split())
GOOD = re.compile(r"article|content|main|post|entry|story|body|text|blog", re.I)
BAD = re.compile(r"\bads?\b|advert|banner|comment|cookie|foot|menu|meta|nav|popup|promo|related|share|side|social|sponsor|subscri|tags?\b|widget", re.I)
TAG_WEIGHT = {"article": 1.5, "main": 1.5, "section": 1.1, "nav": 0.1, "footer": 0.1, "aside": 0.2, "header": 0.3, "form": 0.3, "ul": 0.5, "ol": 0.5, "html": 0.2, "body": 0.6}


class Page:
    """Elements in document order and the pieces of text between their tags."""

    def __init__(self, source: str):
        self.tag, self.cls, self.parent, self.first, self.last = ["#root"], [""], [-1], [0], [-1]
        self.texts: list[tuple[int, str]] = []  # the element and its text; "\n" between blocks
        stack, at = [0], 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self.texts.append((stack[-1], source[at : m.start()]))
            at = m.end()
            name = m[3] or m[6]
            if not name:
                continue
            name = name.lower()
            if name in BLOCK:
                self.texts.append((stack[-1], "\n"))
            if m[2] or m[5]:
                self._close(stack, (name,), None if name in FENCE else FENCE)
                continue
            if name in CLOSES:
                self._close(stack, CLOSES[name], frozenset(("ul", "ol", "dl", "table", "select")))
            elif name in BLOCK and name not in ("br", "option"):
                self._close(stack, ("p",), FENCE)
            if name in VOID:
                continue
            cls = CLASS.search(m[4] or m[7] or "")
            self.tag.append(name)
            self.cls.append(next((g for g in cls.groups() if g), "") if cls else "")
            self.parent.append(stack[-1])
            self.first.append(len(self.texts))
            self.last.append(-1)
            stack.append(len(self.tag) - 1)
        if at < len(source):
            self.texts.append((stack[-1], source[at:]))
        for k in stack:
            self.last[k] = len(self.texts)

    def _close(self, stack: list[int], names: tuple[str, ...], fence: frozenset | None) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[depth]]
            if tag in names:
                for k in stack[depth:]:
                    self.last[k] = len(self.texts)
                del stack[depth:]
                return
            if fence and tag in fence:
                return

    def path(self, k: int) -> str:
        steps = []
        while k > 0:
            names = sorted({re.sub(r"[^\w#-]", "_", re.sub(r"\d+", "#", c)) for c in self.cls[k].split()})
            steps.append(".".join([self.tag[k], *names]))
            k = self.parent[k]
        return ">".join(reversed(steps))

    def scores(self) -> list[tuple[float, int]]:
        """(score, element) of containers with text, best first."""
        size = len(self.tag)
        points, total, linked = [0.0] * size, [0] * size, [0] * size
        box, link = [0] * size, [False] * size
        for k in range(1, size):
            up = self.parent[k]
            box[k] = k if self.tag[k] in BOX else box[up]
            link[k] = link[up] or self.tag[k] == "a"
        for k, text in self.texts:
            length = len(text.strip())
            if not length or self.tag[k] in ("head", "title"):
                continue
            own = box[k]
            total[own] += length
            if link[k]:
                linked[own] += length
            elif length >= 20:
                gain = 1 + text.count(",") + min(length / 100, 3)
                points[own] += gain
                points[box[self.parent[own]] if own else 0] += gain / 2
        for k in range(size - 1, 0, -1):
            if box[k] == k:
                up = box[self.parent[k]]
                total[up] += total[k]
                linked[up] += linked[k]
        out = []
        for k in range(1, size):
            if box[k] == k and points[k] > 0 and total[k]:
                weight = TAG_WEIGHT.get(self.tag[k], 1.0)
                if self.cls[k]:
                    weight *= (1.25 if GOOD.search(self.cls[k]) else 1.0) * (0.2 if BAD.search(self.cls[k]) else 1.0)
                out.append((round(points[k] * weight * (1 - linked[k] / total[k]), 6), k))
        return sorted(out, key=lambda x: (-x[0], x[1]))

    def text(self, elements: list[int]) -> str:
        """Text of the elements, one line a block."""
        out = []
        for k in elements:
            lines = entities.unescape("".join(t if t == "\n" else t.replace("\n", " ") for _, t in self.texts[self.first[k] : self.last[k]])).split("\n")
            out += [line for line in (" ".join(x.split()) for x in lines) if line]
        return "\n".join(out)

    def on(self, path: str) -> list[int]:
        """Outermost elements on a path."""
        tag = path.rpartition(">")[2].split(".")[0]
        found: list[int] = []
        for k in range(1, len(self.tag)):
            if self.tag[k] == tag and self.path(k) == path and not (found and self.first[k] < self.last[found[-1]]):
                found.append(k)
        return found


def votes(source: str) -> list[tuple[str, int, int]]:
    """(path, share of the best score in millionths, 1 for the first place) of each path with a scored container."""
    page = Page(source)
    best = [x for x in page.scores() if x[0] > 0]
    found: dict[str, tuple[int, int]] = {}
    for n, (s, k) in enumerate(best):  # from the best down
        found.setdefault(page.path(k), (round(1_000_000 * s / best[0][0]), int(n == 0)))
    return [(path, *vote) for path, vote in found.items()]


def extract(source: str, path: str | None) -> tuple[str, str]:
    """(method, text) of a page."""
    page = Page(source)
    if path:
        text = page.text(page.on(path))
        if text:
            return "consensus", text
    best = page.scores()
    text = page.text([best[0][1]] if best else [0])
    return ("own", text) if text else ("none", "")


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in base.sized(batches, "html"):
        out = [(host, *vote) for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for vote in votes(source)]
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int32()))], ["host", "path", "share", "first"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in base.sized(batches, "html"):
        done = [("none", None) if source is None else extract(source, path) for source, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        path = [p if m == "consensus" else None for p, (m, _) in zip(batch.column(3).to_pylist(), done)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(path, pa.string()), pa.array([m for m, _ in done], pa.string()), pa.array([t for _, t in done], pa.string())], ["page_id", "host", "path", "method", "text"])


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path) with the most votes of the host's pages. pages: host, html."""
    counted = base.mapped(pages.where("host is not null and html is not null").select("host", "html"), _vote, "host string, path string, share bigint, first int")
    sums = counted.groupBy("host", "path").agg(F.sum("share").alias("share"), F.sum("first").alias("first"))
    order = Window.partitionBy("host").orderBy(F.desc("share"), F.desc("first"), "path")
    return sums.withColumn("place", F.row_number().over(order)).where("place = 1").select("host", "path")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, method, text) of every page."""
    host = F.regexp_extract(F.lower(F.col("url").cast("string")), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.when(host != "", host).alias("host"), F.col("html").cast("string").alias("html"))
    paths = base.stash(winning_paths(own), "paths")
    return base.mapped(own.join(base.small(paths), "host", "left").select("page_id", "host", "html", "path"), _extract, "page_id bigint, host string, path string, method string, text string")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(base.table(spark, sf_dir, "pages"))


QUERIES = {"op3_html_extraction": op3_html_extraction}
ORACLE: dict[str, str] = {}
