"""Main text of HTML pages by consensus host paths.

Each page's containers are scored by the running text they hold.  The best are grown by
what belongs to them beside them and above them.  Every page votes with its best ones'
generalised paths (tags and classes, digits removed) and the places of what they grew by;
votes are summed by host in Spark; each page is then read again with its host's winners.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.token_store import slices
from lodestone.scratch import materialize

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs2>[^>]*+)>",
    re.S,
)
ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea select title".split())
DROPPED = RAW | frozenset("nav footer aside form button dialog menu head option label fieldset".split())
BLOCK = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption hr header footer nav aside form fieldset address details summary".split())
CONTAINER = frozenset("html body article main section div td blockquote".split())
#: Of these, what an article may be.  A quotation or a cell is a part of one.
CHOICE = CONTAINER - {"td", "blockquote"}
#: A start tag of the first closes an open element of the second (without passing a container).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of class names and ids that mark what isn't the article.
JUNK = re.compile(
    r"(?:ad|ads|adv|advert|adverts|advertisement|sponsor|sponsored|promo|promotion|banner|sidebar|side|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|footer|"
    r"masthead|topbar|toolbar|comment|comments|commentlist|disqus|respond|reply|replies|cookie|cookies|consent|notice|alert|popup|modal|overlay|newsletter|subscribe|"
    r"signup|login|share|sharing|social|related|recommended|pagination|pager|widget|skip|copyright|disclaimer|gdpr)"
)
#: Parts of names that say only that there is a box, a list or an entry of it.
BOX = re.compile(r"(?:area|articles|bar|block|body|box|button|buttons|count|form|icons|container|content|group|holder|inner|item|items|link|links|list|news|outer|panel|posts|row|section|slot|stories|thread|threads|tools|text|title|top|bottom|left|right|main|unit|wrap|wrapper|zone|[a-z])")
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Paths that a host's pages may be read with, in order of their votes; and the share of a page's best score that one must reach.
WINNERS, ENOUGH = 5, 0.3
#: What stands beside the article is a part of it from this share of its running text on, if no more than the next share is links; a voted one, or one between two parts, may have more links.
SHARE, LINKED, VOTED = 0.2, 0.3, 0.5
RIGHTS = re.compile(r"\s*(?:©|\(c\)|copyright\b)", re.I)


class Node:
    """An element.  ``path`` numbers its generalised path among the page's; ``step`` is what it adds to its parent's, if anything."""

    __slots__ = ("end", "junk", "parent", "path", "score", "start", "step", "tag")

    def __init__(self, tag: str, parent: Node | None, path: int, step: str, junk: bool, start: int):
        self.tag, self.parent, self.path, self.step, self.junk, self.start = tag, parent, path, step, junk, start
        self.end, self.score = -1, 0.0


def spelled(node: Node | None) -> str:
    """A node's path as text.  Only paths that are voted on are spelled, so deep pages take no more than their depth."""
    steps = []
    while node is not None:
        if node.step:
            steps.append(node.step)
        node = node.parent
    return "/".join(["", *reversed(steps)])


def is_junk(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES or re.search(r"display:\s*none", attrs.get("style", "")):
        return True
    for name in [*attrs.get("class", "").lower().split(), attrs.get("id", "").lower()]:
        parts = [p for p in re.split(r"[-_\d]+", name) if p]
        # the last part says what a thing is ("site-footer", but not "notice-period"), unless it names only a box ("ad-slot")
        while len(parts) > 1 and BOX.fullmatch(parts[-1]):
            parts.pop()
        if parts and parts[0] not in ("has", "with", "no") and JUNK.fullmatch(parts[-1]):
            return True
    return False


def parse(html: str) -> tuple[list[Node], list[list], dict[tuple[int, str], int]]:
    """The page's elements in order, its text as (node, block, text, in a link) runs outside junk, and the numbers of its paths by (parent's, step)."""
    root = Node("html", None, 0, "", False, 0)
    nodes, stack, runs = [root], [root], []
    paths: dict[tuple[int, str], int] = {}
    inside = htmls = bodies = 0  # open articles and mains, and html and body elements of the page
    block, links, at = 0, 0, 0

    def close(k: int) -> None:
        nonlocal links, inside, htmls, bodies
        for gone in stack[k:]:
            gone.end = len(runs)
            links -= gone.tag == "a"
            inside -= gone.tag in ("article", "main")
            htmls -= gone.tag == "html"
            bodies -= gone.tag == "body"
        del stack[k:]

    def say(raw: str) -> None:
        if raw and not stack[-1].junk:
            runs.append([stack[-1], block, unescape(raw) if "&" in raw else raw, links > 0])

    while True:
        m = TOKEN.search(html, at)
        if not m:
            say(html[at:])
            break
        say(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        if m["end"] or m["end2"]:
            block += tag in BLOCK
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in CONTAINER and tag not in CONTAINER and tag != "a":
                    break
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in VOID:
            block += tag == "hr"
            continue
        block += tag in BLOCK
        ends = CLOSES.get(tag, frozenset()) | ({"p"} if tag in BLOCK else frozenset())
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in ends:
                close(k)
                break
            if stack[k].tag in BLOCK:
                break
        if tag == "html" and htmls or tag == "body" and bodies:
            continue
        attrs = {a.lower(): (v or "").strip("\"'") for a, v in ATTR.findall(m["attrs"] or m["attrs2"] or "")}
        top = stack[-1]
        junk = top.junk or is_junk(tag, attrs, inside > 0)
        path, step = top.path, ""
        if tag in CONTAINER:
            names = ".".join(sorted({re.sub(r"\d+", "", c).replace("/", "|") for c in attrs.get("class", "").lower().split()}))
            step = f"{tag}.{names}" if names else tag
            path = paths.setdefault((path, step), len(paths) + 1)
        if tag in RAW:
            # what is inside isn't markup: go to the end tag
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = stop.end() if stop else len(html)
            continue
        links += tag == "a"
        node = Node(tag, top, path, step, junk, len(runs))
        nodes.append(node)
        if not (m["attrs"] or "").endswith("/") or tag in CONTAINER:
            stack.append(node)
            inside += tag in ("article", "main")
            htmls += tag == "html"
            bodies += tag == "body"
        else:
            node.end = len(runs)
            links -= tag == "a"
    close(0)
    return nodes, runs, paths


def blocks(runs: list[list]) -> Iterator[tuple[Node, str, int]]:
    """Blocks of text in page order: the first run's element, the text with single spaces, and how much of it is links."""
    k = 0
    while k < len(runs):
        j = k
        while j < len(runs) and runs[j][1] == runs[k][1]:
            j += 1
        if text := " ".join("".join(r[2] for r in runs[k:j]).split()):
            yield runs[k][0], text, sum(len(r[2].strip()) for r in runs[k:j] if r[3])
        k = j


def scored(html: str) -> tuple[list[Node], list[list], dict[tuple[int, str], int]]:
    """Parsed, with scores: a block gives its running text's length to its container, and half to the one above."""
    nodes, runs, paths = parse(html)
    for node, text, linked in blocks(runs):
        gain = 0 if RIGHTS.match(text) else max(len(text) - 1.5 * linked, 0) + 10 * text.count(",")
        share = 1.0
        while node is not None and share >= 0.5:
            if node.tag in CHOICE:
                node.score += gain * share * (1.5 if node.tag in ("article", "main") else 1.0)
                share /= 2
            node = node.parent
    return nodes, runs, paths


def best(nodes: list[Node], n: int) -> list[Node]:
    return sorted((x for x in nodes if x.score > 0), key=lambda x: (-x.score, x.start, -x.end))[:n]


class Page:
    """A parsed page with the lengths of its text and links up to each run."""

    def __init__(self, html: str):
        self.nodes, self.runs, self.paths = scored(html)
        self.top = best(self.nodes, 3)
        lengths = [len(r[2].strip()) for r in self.runs]
        self.chars = [0, *accumulate(lengths)]
        self.links = [0, *accumulate(n * r[3] for n, r in zip(lengths, self.runs))]

    def gain(self, start: int, end: int) -> float:
        return self.chars[end] - self.chars[start] - 1.5 * (self.links[end] - self.links[start])

    def linked(self, start: int, end: int) -> float:
        return (self.links[end] - self.links[start]) / max(self.chars[end] - self.chars[start], 1)

    def parts(self, parent: Node, children: list[Node]) -> list[tuple[int, int, Node | None]]:
        """What ``parent`` is made of, in page order: its block elements, and what is between them as one part each."""
        found, at = [], parent.start
        for child in children:
            if child.tag in BLOCK or child.tag in CONTAINER:
                found += [(at, child.start, None), (child.start, child.end, child)]
                at = child.end
        return [p for p in [*found, (at, parent.end, None)] if self.chars[p[1]] > self.chars[p[0]]]

    def grown(self, core: Node, voted: frozenset[str] = frozenset()) -> tuple[Node, list[tuple[int, int]], set[str]]:
        """The article around ``core``: its element, its runs, and the places (depth and step) of containers that it grew by.

        A core inside an article element is the whole element.  Upwards from it, a part of an
        ancestor belongs to it if it has few links and is a container of like length, of the
        same named step as the one it stands beside (articles beside articles need the length),
        or voted by the host; a headline before a core that has none; other text right beside
        it, or long; and whatever stands between two such parts.  Beside an article element
        only articles and a headline are looked for.
        """
        above = core
        while above is not None and above.tag != "article":
            above = above.parent
        core = above or core
        chain = [core]
        while chain[-1].parent is not None:
            chain.append(chain[-1].parent)
        children: dict[int, list[Node]] = {id(x): [] for x in chain[1:]}
        titled = False
        for x in self.nodes:
            if x.parent is not None and id(x.parent) in children:
                children[id(x.parent)].append(x)
            titled = titled or (x.tag == "h1" and core.start <= x.start and x.end <= core.end and x.end > x.start)
        depth = sum(bool(x.step) for x in chain[1:])
        whole, alone = self.gain(core.start, core.end), core.tag == "article"
        spans, places, beside, near = [(core.start, core.end)], set(), core.step, True
        for inner, parent in zip(chain, chain[1:]):
            parts = self.parts(parent, children[id(parent)])
            page = parent.tag in ("html", "body")
            taken = []
            for start, end, part in parts:
                links, text = self.linked(start, end), self.gain(start, end)
                long = text >= SHARE * whole and links <= LINKED
                place = f"{depth}>{part.step}" if part is not None and part.tag in CHOICE else ""
                rights = RIGHTS.match("".join(r[2] for r in self.runs[start : min(end, start + 3)])) is not None
                if part is inner or inner.start <= start and end <= inner.end:
                    ok = True
                elif rights:
                    ok = False
                elif place and alone:
                    ok = part.tag == "article" and long
                elif place:
                    same = part.step == beside != part.tag or part.step == beside == "section"
                    ok = long or (same and part.tag != "article" and links <= LINKED) or (place in voted and links <= VOTED)
                elif part is not None and part.tag in ("h1", "h2") and end <= inner.start:
                    ok = not titled and links <= LINKED
                else:
                    ok = not alone and (long or (near and not page and links <= LINKED))
                taken.append(ok)
            first, last = taken.index(True) if True in taken else 0, len(taken) - 1 - taken[::-1].index(True) if True in taken else -1
            grew = False
            for k, (start, end, part) in enumerate(parts):
                if part is inner or inner.start <= start and end <= inner.end:
                    continue
                if taken[k] or (first < k < last and not alone and self.linked(start, end) <= VOTED):
                    spans.append((start, end))
                    if part is not None and part.tag in CHOICE:
                        places.add(f"{depth}>{part.step}")
                        grew = True
            # a container that adds nothing is a wrapper: what is beside it is beside the article
            near = near and not grew and len(parts) == 1
            beside = parent.step or beside
            depth -= bool(parent.parent is not None and parent.step)
        return core, sorted(spans), places

    def votes(self) -> list[tuple[str, int]]:
        """Places of the best containers with their grown parts, as one string each, and a vote of up to 1000."""
        found: dict[str, int] = {}
        for x in self.top:
            core, _, places = self.grown(x)
            key = " ".join([spelled(core), *sorted(places)])
            found[key] = max(found.get(key, 0), int(1000 * x.score / self.top[0].score))
        return list(found.items())

    def text(self, winners: list[str]) -> str:
        if not self.top:
            return ""
        core, voted = self.top[0], frozenset()
        for winner in winners:
            path, *places = winner.split(" ")
            number: int | None = 0
            for step in path.split("/")[1:]:
                number = self.paths.get((number, step)) if step else number
            on = [x for x in self.nodes if x.path == number and x.tag in CHOICE and not x.junk]
            on = sorted(on, key=lambda x: (-self.gain(x.start, x.end), x.start, -x.end))[:1]
            if on and self.gain(on[0].start, on[0].end) >= ENOUGH * self.gain(self.top[0].start, self.top[0].end) > 0:
                core, voted = on[0], frozenset(places)
                break
        _, spans, _ = self.grown(core, voted)
        return "\n\n".join(text for _, text, _ in blocks([r for start, end in spans for r in self.runs[start:end]]))


def main_text(html: str, winners: list[str]) -> str:
    """The text of the article around the host's first winning path that holds enough, or around the page's own best container."""
    return Page(html).text(winners)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """``(host, winners)``: each host's paths, with the places of what belongs to them, with most votes.  Votes are summed before they are ordered, so a hot host is a few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, ["host", "html"]):
            votes = []
            for name, raw in rows:
                votes += [(name, *vote) for vote in Page((raw or b"").decode("utf-8", "replace")).votes()]
            columns = zip(*votes) if votes else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["host", "path", "vote"])

    votes = pages.select("host", "html").mapInArrow(run, "host string, path string, vote long").groupBy("host", "path").agg(F.sum("vote").alias("votes"))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    kept = votes.withColumn("place", place).where(F.col("place") <= WINNERS)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "path"))), lambda x: x["path"])
    return kept.groupBy("host").agg(ordered.alias("winners"))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row; text is empty if there is none.

    Null html is empty and null urls share a host.  The winners are a row for each host and
    cut as a table first, so the planner knows their size: within its threshold they are
    broadcast and no page moves; beyond it, adaptive execution splits a hot host's pages.
    Repeated rows vote again; extra columns are left alone.
    """
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    winners = materialize(host_paths(pages).withColumnRenamed("host", "__host"), "winners")
    joined = pages.join(winners, pages["host"] == winners["__host"], "left").select("page_id", "url", "winners", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, ["page_id", "url", "winners", "html"]):
            texts = [main_text((raw or b"").decode("utf-8", "replace"), paths or []) for _, _, paths, raw in rows]
            columns = ([r[0] for r in rows], [r[1] for r in rows], texts, [len(t) for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
