"""Main text of web pages by wrapper induction.

Pages of one host come from the same templates. The block structure of each page is folded into a small tree: one node
per path of block elements, with the digests of its texts. Trees of pages of the same host are aligned by simple tree
matching; each matched node votes for those of its texts that stayed the same (template); all others are content. The
votes of a host are added up over all its pages. A page's text is then read from its own tree: the texts that vary,
without the parts that their markup or their links mark as navigation, notices, adverts, forms or comments.

A host of any size is aligned in groups of about ``GROUP`` pages, so no task holds a whole host.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceweave.llm.common import map_rows, stored

#: Pages aligned with each other at once.
GROUP = 16
#: Votes a slot needs before its texts can count as template, and the share of votes above which a text does.
VOTES, CONSTANT = 3, 0.5
#: Share of a slot's characters inside links from which it is a menu.
LINKS = 0.6
#: Two pages that share more of their content than this are copies; they say nothing about the template.
COPY = 0.8
# Elements by their role.
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
LEFT_OUT = frozenset("head script style textarea title xmp iframe noembed noframes noscript template svg math object canvas audio video select button "
                     "nav footer aside form dialog menu search".split())
HINTS = frozenset("ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
                  "cookies copyright discussion disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination "
                  "popup promo promoted related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split())
MAIN = frozenset("article main".split())
CLOSES_P = BLOCKS - {"html", "body", "dd", "dt", "li", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"},
          "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}, "optgroup": {"select"}}
_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_LETTERS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Block:
    """Text between two borders of block elements."""

    __slots__ = ("path", "text", "links", "main", "out")

    def __init__(self, path: str, text: str, links: int, main: bool, out: bool):
        self.path, self.text, self.links, self.main, self.out = path, text, links, main, out


def _attributes(text: str) -> dict[str, str]:
    return {name.lower(): html.unescape(value.strip("\"'")) for name, value in _ATTRIBUTE.findall(text.rstrip(">").rstrip("/"))} if "=" in text or "hidden" in text else {}


def blocks_of(page: str | None) -> list[Block]:
    """Blocks of a page in order, each with the path of its block elements and what its markup says of it."""
    out: list[Block] = []
    if not page:
        return out
    # An open element: name, its part of the path (None for inline), path so far, inside main, left out, link
    stack: list[tuple] = [("", None, "", False, False, False)]
    seen: dict[tuple[str, str], int] = {}
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                _, _, path, main, left, _ = stack[-1]
                out.append(Block(path, joined, linked, main, left))
            text.clear()
        linked = 0

    def close(depth: int) -> None:
        if any(e[1] is not None for e in stack[depth:]):
            flush()
        del stack[depth:]

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            if not text or stack[-1][4] == add.left:
                add.left = stack[-1][4]
            else:  # an inline part that is left out ends the run
                flush()
                add.left = stack[-1][4]
            text.append(piece)
            if stack[-1][5]:
                linked += len("".join(piece.split()))

    add.left = False
    at, size = 0, len(page)
    while at < size:
        hit = _TAG.search(page, at)
        if hit is None:
            add(page[at:])
            break
        add(page[at:hit.start()])
        at = hit.end()
        name = hit.group(2)
        if name is None:
            continue
        name = name.lower()
        if hit.group(1):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    close(depth)
                    break
                if name not in BLOCKS and stack[depth][1] is not None:
                    break  # an inline end tag does not close a block
            continue
        attributes = _attributes(hit.group(3))
        if name in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    close(depth)
                    break
                if stack[depth][1] is not None:
                    break
        if name in SIBLINGS:
            found = 0
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in SCOPES[name]:
                    break
                if stack[depth][0] in SIBLINGS[name]:
                    found = depth
            if found:
                close(found)
        if name == "br":
            add(" ")
        if name in VOID:
            if name == "hr":
                flush()
            continue
        _, _, path, main, left, link = stack[-1]
        hints = {w for key in ("class", "id", "role") for w in _LETTERS.findall(_CAMEL.sub(" ", attributes.get(key, "")).lower())}
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        left = left or name in LEFT_OUT or hidden or (bool(hints & HINTS) and name not in ("html", "body")) or (name == "header" and not main)
        main = main or name in MAIN or attributes.get("role") == "main"
        part = None
        if name in BLOCKS:
            flush()
            marks = ".".join(sorted(hints))
            part = f"{name}.{marks}" if marks else name
            if not marks and name in ("div", "section", "td"):  # unnamed containers are told apart by their place
                seen[path, part] = number = seen.get((path, part), 0) + 1
                part = f"{part}:{number}"
            path = f"{path}>{part}"
        stack.append((name, part, path, main, left, link or name == "a"))
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else size
    flush()
    return out


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def skeleton(blocks: list[Block]) -> list[dict]:
    """The folded tree of a page: one entry per path, with the digests and sizes of its distinct texts."""
    nodes: dict[str, dict] = {}
    for block in blocks:
        node = nodes.setdefault(block.path, {"path": block.path, "texts": {}, "chars": 0, "links": 0, "main": False})
        size = len("".join(block.text.split()))
        node["texts"][_digest(block.text)] = size
        node["chars"] += size
        node["links"] += block.links
        node["main"] = node["main"] or (block.main and not block.out)
    for node in nodes.values():
        node["texts"], node["sizes"] = map(list, zip(*sorted(node["texts"].items())))
    return list(nodes.values())


class _Node:
    __slots__ = ("label", "children", "entry")

    def __init__(self, label: str):
        self.label, self.children, self.entry = label, {}, None


def _tree(nodes: list[dict]) -> _Node:
    root = _Node("")
    for entry in nodes:
        node = root
        for label in entry["path"].split(">")[1:]:
            node = node.children.setdefault(label, _Node(label))
        node.entry = entry
    return root


def match(a: _Node, b: _Node) -> tuple[int, list[tuple[_Node, _Node]]]:
    """Simple tree matching: the largest number of matched nodes that keeps labels and order, and the matched pairs.

    Trees may be of any depth: pairs that can match are listed from the roots on, and counted from the last one back.
    """
    if a.label != b.label:
        return 0, []
    met, inner = [(a, b)], []
    for x, y in met:  # grows on the way
        place = {label: j for j, label in enumerate(y.children)}
        inside = {}
        for i, (label, child) in enumerate(x.children.items()):
            if label in place:
                inside[i, place[label]] = len(met)
                met.append((child, y.children[label]))
        inner.append(inside)
    size, chosen = [1] * len(met), [[] for _ in met]
    for k in range(len(met) - 1, -1, -1):
        if not inner[k]:
            continue
        i, j = (len(node.children) for node in met[k])
        # best[i][j]: matched nodes of the first i and j children.
        best = [[0] * (j + 1) for _ in range(i + 1)]
        for row in range(i):
            for column in range(j):
                below = inner[k].get((row, column))
                best[row + 1][column + 1] = max(best[row][column + 1], best[row + 1][column], best[row][column] + (size[below] if below else 0))
        size[k] += best[i][j]
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                chosen[k].append(inner[k][i, j])
    pairs, todo = [], [0]
    while todo:
        k = todo.pop()
        pairs.append(met[k])
        todo += chosen[k]
    return size[0], pairs


def _copies(pairs: list[tuple[dict, dict]]) -> bool:
    """Whether two pages have the same content: most characters inside main, or else most texts that are no menu."""
    inside = [(x, y) for x, y in pairs if x["main"] and y["main"]]
    if inside:
        sizes = [(dict(zip(x["texts"], x["sizes"])), dict(zip(y["texts"], y["sizes"]))) for x, y in inside]
        same = sum(a[text] for a, b in sizes for text in a.keys() & b.keys())
        return same > COPY * min(sum(sum(a.values()) for a, _ in sizes), sum(sum(b.values()) for _, b in sizes))
    content = [(set(x["texts"]), set(y["texts"])) for x, y in pairs if x["links"] < LINKS * x["chars"] and y["links"] < LINKS * y["chars"]]
    return sum(len(a & b) for a, b in content) > COPY * sum(min(len(a), len(b)) for a, b in content)


def align(pages: list[list[dict]]) -> dict[tuple[str, int | None], list[int]]:
    """Votes of neighbouring pages: (path, None) to [aligned pairs, 0, characters, characters in links, pages], and
    (path, digest of a text) to [0, pairs that both have the text, 0, 0, 0]."""
    votes: dict[tuple[str, int | None], list[int]] = {}
    for nodes in pages:
        for entry in nodes:
            vote = votes.setdefault((entry["path"], None), [0, 0, 0, 0, 0])
            vote[2] += entry["chars"]
            vote[3] += entry["links"]
            vote[4] += 1
    trees = [_tree(nodes) for nodes in pages]
    for x, y in zip(trees, [*trees[1:], trees[0]] if len(trees) > 2 else trees[1:]):
        pairs = [(p.entry, q.entry) for p, q in match(x, y)[1] if p.entry and q.entry]
        if _copies(pairs):
            continue
        for a, b in pairs:
            votes[a["path"], None][0] += 1
            for text in set(a["texts"]) & set(b["texts"]):
                votes.setdefault((a["path"], text), [0, 0, 0, 0, 0])[1] += 1
    return votes


def read(page: str | None, template: frozenset[str] = frozenset()) -> str:
    """Text of one page. ``template``: what is no content on its host, paths of menus and single texts ("path digest").

    Inside main only single texts are left out.
    """
    blocks = [b for b in blocks_of(page) if not b.out]
    if template:
        blocks = [b for b in blocks if (b.main or b.path not in template) and f"{b.path} {_digest(b.text)}" not in template]
    if any(b.main for b in blocks):
        blocks = [b for b in blocks if b.main]
    return "\n".join(b.text for b in blocks)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _votes(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: (r["order"], str(r["nodes"])))
    votes = align([r["nodes"] for r in rows])
    out = [(rows[0]["host"], *slot, *v) for slot, v in votes.items()]
    kinds = {"host": pa.string(), "path": pa.string(), "text": pa.int64(), **dict.fromkeys(("pairs", "same", "chars", "links", "pages"), pa.int64())}
    return pa.table(dict(zip(kinds, map(list, zip(*out)) if out else [[]] * len(kinds))), schema=pa.schema(list(kinds.items())))


def wrappers(df: DataFrame, url_column: str = "url", html_column: str = "html", group: int = GROUP) -> DataFrame:
    """``host`` and ``template``: the texts of each host that are template ("path digest") and the paths of its menus. All
    pages of a host vote.

    Pages without a host or without blocks do not vote. A text counts as template if its slot has three votes and most
    of them are for this text; a slot as a menu if three pages have it and most of its characters, over all pages of the
    host, are links.
    """
    trees = map_rows(df.select(host_of(F.col(f"`{url_column}`")).alias("host"), F.coalesce(F.xxhash64(f"`{url_column}`", f"`{html_column}`"), F.lit(0)).alias("order"),
                               F.col(f"`{html_column}`").alias("html")).where("host <> ''"),
                     ["html"], "nodes array<struct<path:string,texts:array<bigint>,chars:bigint,links:bigint,main:boolean,sizes:array<bigint>>>",
                     lambda pages: {"nodes": [skeleton(blocks_of(p)) for p in pages.to_pylist()]}, ["host", "order"])
    trees = stored(trees.where(F.size("nodes") > 0), "trees")
    sizes = trees.groupBy("host").count().select(F.col("host").alias("_host"), F.expr(f"greatest(1, count div {group}L)").alias("groups"))
    # One key of host and group: with two, the rows would stay dealt by host, and a hot host would be one task.
    key = F.concat_ws(" ", "host", F.pmod("order", "groups").cast("string"))
    dealt = trees.join(sizes, F.col("host") == F.col("_host")).select("host", key.alias("group"), "order", "nodes")
    votes = dealt.groupBy("group").applyInArrow(_votes, "host string, path string, text long, pairs long, same long, chars long, links long, pages long")
    total = stored(votes.groupBy("host", "path", "text").agg(*[F.sum(c).alias(c) for c in ("pairs", "same", "chars", "links", "pages")]), "votes")
    slots = total.where("text is null")
    menus = slots.where((F.col("pages") >= VOTES) & (F.col("links") >= LINKS * F.col("chars"))).select("host", F.col("path").alias("left_out"))
    voted = slots.where(F.col("pairs") >= VOTES).select("host", "path", F.col("pairs").alias("of"))
    texts = total.where("text is not null").join(voted, ["host", "path"]).where(F.col("same") > CONSTANT * F.col("of"))
    texts = texts.select("host", F.concat_ws(" ", "path", F.col("text").cast("string")).alias("left_out"))
    return menus.union(texts).groupBy("host").agg(F.collect_list("left_out").alias("template"))


def extract(df: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``id_column``, ``url_column``, ``text`` and ``n_chars`` (code points) of every page.

    One row per input row. Null and empty pages, and pages without content, have the empty text. Pages without a host,
    and those of a host with one page, are read by their own markup. Null and repeated ids and urls stay. A template
    that would leave a page without any text is not applied to it. Other columns are left out.
    """
    found = stored(wrappers(df, url_column, html_column), "wrappers").withColumnRenamed("host", "_host")
    host = host_of(F.col(f"`{url_column}`"))
    pages = df.select(F.col(f"`{id_column}`"), F.col(f"`{url_column}`"), F.col(f"`{html_column}`").alias("_html"), host.alias("_of"))
    pages = pages.join(found, F.col("_of") == F.col("_host"), "left")

    def run(sources: pa.Array, templates: pa.Array) -> dict:
        texts = [read(page, frozenset(paths or ())) or read(page) for page, paths in zip(sources.to_pylist(), templates.to_pylist())]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return map_rows(pages, ["_html", "template"], "text string, n_chars long", run, [id_column, url_column])
