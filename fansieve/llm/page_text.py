"""Main texts of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of block tags and texts. Elements that are left open are closed, inline tags only belong to their text, and what occurs
several times in a row becomes a repeated group. Two streams are aligned: where they agree, the wrapper goes on; what only one of
them has becomes optional; texts that differ become a text slot, which counts the characters of its texts and of their links. So the wrapper of
a host grows page by page. Every task infers wrappers of its own pages and hosts, and wrappers are aligned with each other like pages,
in two steps, so a host with a third of all pages has as many tasks at work as any other rows.

A wrapper says where a host's articles are: in its ``article`` or ``main`` element, else in the smallest group that holds most of the text of
slots outside menus, headers, footers, sidebars, notices, adverts, forms and comments. Pages are then read by their wrapper.

Cases: a null or empty page has no text; a null url or one without a host belongs to the host ""; a page unlike its host's others is read by its
own elements; raw texts of scripts and styles end only with their own end tag; repeated rows are read each; an empty table gives an empty
result; only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fansieve.session import durable, table, table_bytes

#: Items of a wrapper that are aligned; beyond, those seen on the fewest pages are only counted, as characters by the elements around them.
MOST_ITEMS = 400
#: Longest group, in items, that is looked for as a repetition.
LONGEST_GROUP = 8
#: Hosts whose wrappers a task holds at a time, tasks whose wrappers of a host meet first, and bytes of wrappers sent to every task.
HOSTS_AT_ONCE, TASKS_AT_ONCE, BROADCAST_BYTES = 20_000, 64, 32 << 20
#: Share of the text that the group with the article must hold, in wrappers without an article element.
MOST_TEXT = 0.6

INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|iframe|svg|math|object|select"
#: Elements that are closed by the next of one of these.
CLOSED_BY = {
    **{k: {"p", "div", "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "aside", "nav", "header", "footer", "form", "blockquote", "pre", "hr", "main", "figure", "address"} for k in ("p",)},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"},
    **{f"h{k}": {f"h{n}" for n in range(1, 7)} | {"p"} for k in range(1, 7)},
}
ASIDE = set("nav header footer aside form menu dialog button fieldset head".split())
#: Words in the class, id or role of an element that is not part of an article.
ASIDE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent contentinfo disclaimer disqus footer form gdpr header "
    "masthead menu menubar modal nav navbar navigation newsletter notice notices alert overlay pager pagination popup promo promotion related replies reply respond search share sharing "
    "sidebar sidenav signup skip social sponsor sponsored subscribe teaser teasers toolbar topbar tracking widget widgets complementary".split()
)
HEARTS = {"article", "main"}

_ATTRIBUTES = r"""(?:"[^"]*"|'[^']*'|[^'">])*"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b{_ATTRIBUTES}(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>{_ATTRIBUTES})>|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")


def _aside(name: str, names: str) -> bool:
    if name in ASIDE:
        return True
    words = set(_WORDS.findall(names))
    if name in ("html", "body", "main", "article"):
        return bool(words & {"comment", "comments", "reply", "replies", "teaser"})
    return bool(words & ASIDE_NAMES)


def stream(page: str) -> Iterator[tuple[str, str, bool]]:
    """The page as (kind, value, aside): ``open`` an element, by its name and the words of its class, id and role; ``close`` one; ``text``;
    ``link`` and ``unlink`` around the texts of links; ``break`` at line breaks. Every opened element is closed.
    """
    held: list[tuple[str, str]] = []  # open elements: name, key
    for m in _TOKEN.finditer(page):
        text, name = m["text"], m["name"]
        if text is not None:
            yield "text", text, False
            continue
        if name is None:
            if m["raw"] is not None and m["raw"].lower() in ("textarea", "select", "object", "iframe"):
                yield "break", "", False
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                yield ("unlink" if m["end"] else "link"), "", False
            continue
        if name in EMPTY:
            yield "break", "", False
            continue
        if m["end"]:
            if any(n == name for n, _ in held):
                while True:
                    n, key = held.pop()
                    yield "close", key, False
                    if n == name:
                        break
            else:
                yield "break", "", False
            continue
        while held and name in CLOSED_BY.get(held[-1][0], ()):
            yield "close", held.pop()[1], False
        names = " ".join(a or b or c for a, b, c in _NAMED.findall(m["rest"])).lower() if m["rest"] else ""
        key = name + "".join(f".{w}" for w in sorted(set(_WORDS.findall(names)))[:6])
        held.append((name, key))
        yield "open", key, _aside(name, names)
        if m["rest"].endswith("/") and name not in CLOSED_BY:
            held.pop()
            yield "close", key, False
    while held:
        yield "close", held.pop()[1], False


# An item of a wrapper is [node, pages, characters, characters in links, varies, text]: node is a tag, "#" for a text, or a list of items, a
# repeated group. "text" is the text of all pages so far, while it does not vary.
PAGES, CHARS, LINKED, VARIES, TEXT = 1, 2, 3, 4, 5


def items(page: str) -> list[list]:
    """The items of one page: a wrapper of that page alone."""
    out: list[list] = []
    text, linked, in_link = [], 0, False

    def flush():
        nonlocal linked
        whole = " ".join(html.unescape("".join(text)).split())
        if whole:
            out.append(["#", 1, len(whole), min(linked, len(whole)), False, whole[:200]])
        text.clear()
        linked = 0

    for kind, value, _ in stream(page):
        if kind == "text":
            text.append(value)
            linked += len(value) if in_link else 0
        elif kind in ("link", "unlink"):
            in_link = kind == "link"
        else:
            flush()
            if kind != "break":
                out.append([value if kind == "open" else f"/{value}", 1, 0, 0, False, ""])
    flush()
    return _repeated(_leaves(out))


def _leaves(line: list[list]) -> list[list]:
    """Every element that holds nothing but texts as a group of its own, so that one and several of them look alike."""
    out, k = [], 0
    while k < len(line):
        node = line[k][0]
        end = k + 1
        while node != "#" and not node.startswith("/") and end < len(line) and line[end][0] == "#":
            end += 1
        if end < len(line) and end > k and line[end][0] == f"/{node}":
            slot = line[k + 1 : end]
            inside = [line[k], *([_merged(slot)] if slot else []), line[end]]
            out.append([inside, 1, 0, 0, False, ""])
            k = end + 1
        else:
            out.append(line[k])
            k += 1
    return out


def _merged(slots: list[list]) -> list:
    """Several texts next to each other as one slot."""
    first = slots[0]
    return ["#", 1, sum(s[CHARS] for s in slots), sum(s[LINKED] for s in slots), len(slots) > 1, first[TEXT] if len(slots) == 1 else ""]


def _shape(item: list):
    node = item[0]
    return node if isinstance(node, str) else tuple(_shape(x) for x in node)


def _opens(item: list) -> str:
    node = item[0]
    return node if isinstance(node, str) else _opens(node[0])


def _repeated(line: list[list]) -> list[list]:
    """Runs of equal items, and of equal sequences of items, as repeated groups; shortest period first."""
    for period in range(1, LONGEST_GROUP + 1):
        shapes = [_shape(x) for x in line]
        out, k = [], 0
        while k < len(line):
            times = 1
            while shapes[k : k + period] == shapes[k + times * period : k + (times + 1) * period] and k + (times + 1) * period <= len(line):
                times += 1
            # A period of one only repeats groups, and no run may end an element that it does not begin.
            if times > 1 and (isinstance(line[k][0], list) if period == 1 else _balanced(line[k : k + period])):
                runs = [line[k + t * period : k + (t + 1) * period] for t in range(times)]
                if period == 1:
                    whole = runs[0][0]
                    for run in runs[1:]:
                        whole = _same(whole, run[0], together=False)
                    out.append(whole)
                else:
                    inside = runs[0]
                    for run in runs[1:]:
                        inside = [_same(a, b, together=False) for a, b in zip(inside, run, strict=True)]
                    out.append([inside, 1, 0, 0, False, ""])
                k += times * period
            else:
                out.append(line[k])
                k += 1
        line = out
    return line


def _balanced(line: list[list]) -> bool:
    depth = 0
    for x in line:
        if isinstance(x[0], str) and x[0] not in ("#", "%"):
            depth += -1 if x[0].startswith("/") else 1
            if depth < 0:
                return False
    return depth == 0


def _same(a: list, b: list, together: bool = True) -> list:
    """Two items that match as one; of two pages, or of one page (not ``together``)."""
    pages = a[PAGES] + b[PAGES] if together else max(a[PAGES], b[PAGES])
    if isinstance(a[0], list):
        return [align(a[0], b[0], together), pages, 0, 0, False, ""]
    if a[0] == "%":
        return _totals(pages, [*a[TEXT], *b[TEXT]])
    varies = a[VARIES] or b[VARIES] or a[TEXT] != b[TEXT]
    return [a[0], pages, a[CHARS] + b[CHARS], a[LINKED] + b[LINKED], varies, "" if varies else a[TEXT]]


def align(a: list[list], b: list[list], together: bool = True) -> list[list]:
    """The wrapper of all that two wrappers stand for: a longest common subsequence, and the items of either alone as optional ones."""
    folded = [tuple(t) for x in a + b if x[0] == "%" for t in x[TEXT]]
    a, b = [x for x in a if x[0] != "%"], [x for x in b if x[0] != "%"]
    left, right = [_opens(x) if isinstance(x[0], list) else x[0] for x in a], [_opens(x) if isinstance(x[0], list) else x[0] for x in b]
    left = [(isinstance(x[0], list), k) for x, k in zip(a, left, strict=True)]
    right = [(isinstance(x[0], list), k) for x, k in zip(b, right, strict=True)]
    head = 0
    while head < min(len(left), len(right)) and left[head] == right[head]:
        head += 1
    tail = 0
    while tail < min(len(left), len(right)) - head and left[-1 - tail] == right[-1 - tail]:
        tail += 1
    out = [_same(x, y, together) for x, y in zip(a[:head], b[:head], strict=True)]
    mid_a, mid_b = a[head : len(a) - tail], b[head : len(b) - tail]
    l_mid, r_mid = left[head : len(a) - tail], right[head : len(b) - tail]
    longest = [[0] * (len(mid_b) + 1) for _ in range(len(mid_a) + 1)]
    for i in range(len(mid_a) - 1, -1, -1):
        row, below = longest[i], longest[i + 1]
        for j in range(len(mid_b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if l_mid[i] == r_mid[j] else max(below[j], row[j + 1])
    i = j = 0
    while i < len(mid_a) or j < len(mid_b):
        if i < len(mid_a) and j < len(mid_b) and l_mid[i] == r_mid[j]:
            out.append(_same(mid_a[i], mid_b[j], together))
            i, j = i + 1, j + 1
        elif j == len(mid_b) or (i < len(mid_a) and longest[i + 1][j] >= longest[i][j + 1]):
            out.append(mid_a[i])
            i += 1
        else:
            out.append(mid_b[j])
            j += 1
    out += [_same(x, y, together) for x, y in zip(a[len(a) - tail :], b[len(b) - tail :], strict=True)]
    if len(out) > MOST_ITEMS:
        out, gone = _cut(out)
        folded += gone
    if folded:
        pages = [x[PAGES] for x in a + b]
        out.append(_totals(max(pages, default=1), folded))
    return out


class Wrapper:
    """The wrapper of some pages of a host. Pages of a structure that has been seen are added without another alignment."""

    def __init__(self, line: list[list] | None = None):
        self.line = line
        self.waiting: dict = {}

    def add(self, page: str) -> None:
        line = items(page)
        shape = tuple(_shape(x) for x in line)
        seen = self.waiting.get(shape)
        self.waiting[shape] = [_same(a, b) for a, b in zip(seen, line, strict=True)] if seen else line
        if len(self.waiting) >= 64:
            self.settle()

    def settle(self) -> list[list]:
        for line in self.waiting.values():
            self.line = line if self.line is None else align(self.line, line)
        self.waiting = {}
        return self.line or []


def _around(line: list[list], path: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """The elements around each item of a line."""
    held, out = list(path), []
    for x in line:
        node = x[0]
        out.append(tuple(held))
        if isinstance(node, list) or node in ("#", "%"):
            continue
        if node.startswith("/"):
            if node[1:] in held:
                while held.pop() != node[1:]:
                    pass
        else:
            held.append(node)
    return out


def _texts(line: list[list], path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], list]]:
    """All text slots with the elements around them."""
    for held, x in zip(_around(line, path), line, strict=True):
        node = x[0]
        if isinstance(node, list):
            yield from _texts(node, held)
        elif node == "#":
            yield held, x
        elif node == "%":
            yield from (((*path, *inside), ["#", x[PAGES], chars, linked, True, ""]) for inside, chars, linked in x[TEXT])


def _totals(pages: int, folded: Iterable[tuple]) -> list:
    """The item of (elements around, characters, linked characters) of slots that are no longer aligned."""
    held: dict[tuple[str, ...], list[int]] = {}
    for path, chars, linked in folded:
        total = held.setdefault(tuple(path), [0, 0])
        total[0] += chars
        total[1] += linked
    return ["%", pages, 0, 0, True, [[list(path), *total] for path, total in sorted(held.items())]]


def _cut(line: list[list]) -> tuple[list[list], list[tuple]]:
    """At most ``MOST_ITEMS`` items of a line, and what is no longer in it, or in other elements than before, for ``_totals``."""
    least = sorted((x[PAGES] for x in line), reverse=True)[MOST_ITEMS]
    kept = [k for k, x in enumerate(line) if x[PAGES] > least] or list(range(MOST_ITEMS))
    before, after = _around(line), _around([line[k] for k in kept])
    stay = {k for k, p in zip(kept, after, strict=True) if p == before[k] or (line[k][0] != "#" and isinstance(line[k][0], str))}
    gone = [(p, x[CHARS], x[LINKED]) for k in range(len(line)) if k not in stay for p, x in _texts([line[k]], before[k])]
    return [line[k] for k in kept if k in stay], gone


def _key_aside(key: str) -> bool:
    name, _, names = key.partition(".")
    return _aside(name, names.replace(".", " "))


def heart(line: list[list]) -> list[str]:
    """Where the articles of a wrapper are: keys of elements."""
    slots = [(p, x) for p, x in _texts(line) if not any(_key_aside(k) for k in p)]
    for name in ("article", "main"):
        keys = {k for p, _ in slots for k in p if k.partition(".")[0] == name}
        if keys:
            return sorted(keys)
    weight: dict[str, int] = {}
    total = 0
    for p, x in slots:
        own = x[CHARS] - x[LINKED]
        total += own
        for k in set(p):
            if k.partition(".")[0] not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "tr"):
                weight[k] = weight.get(k, 0) + own
    depth = {k: max(p.index(k) for p, _ in slots if k in p) for k in weight}
    enough = [k for k, n in weight.items() if n >= MOST_TEXT * total and n]
    return [max(enough, key=lambda k: (depth[k], k))] if enough else []


def main_text(page: str, hearts: Iterable[str]) -> str:
    """The text of the elements ``hearts`` of a page, or, if it has none of them, of its article, its main part, or all of it."""
    hearts = set(hearts)
    blocks: list[tuple[bool, str | None, str]] = []  # aside, the kind of heart it is in, text
    text: list[str] = []
    held: list[tuple[str, bool, str | None]] = []

    def flush():
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                blocks.append((held[-1][1] if held else False, held[-1][2] if held else None, whole))
            text.clear()

    for kind, value, aside in stream(page):
        if kind == "text":
            text.append(value)
        elif kind == "open":
            flush()
            _, was_aside, was_in = held[-1] if held else ("", False, None)
            name = value.partition(".")[0]
            inside = was_in
            if value in hearts:
                inside = "heart"
            elif inside is None and name in HEARTS:
                inside = name
            # Names of elements around an article say nothing of it; semantic elements and comments do.
            if inside is not None and was_in is None and was_aside:
                was_aside = any(k.partition(".")[0] in ASIDE or {"comment", "comments"} & set(k.split(".")) for k, _, _ in held)
            held.append((value, was_aside or aside, inside))
        elif kind == "close":
            flush()
            while held and held.pop()[0] != value:
                pass
        elif kind == "break":
            flush()
    flush()
    for wanted in ("heart", "article", "main", None):
        found = [t for aside, inside, t in blocks if not aside and (inside == wanted or wanted is None)]
        if found:
            return "\n".join(found)
    return ""


def _host(url: str = "url") -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """``(host, hearts)``: by host, as JSON, the elements in which its articles are, inferred from all its ``pages(url, html)``."""

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), {}

        def out() -> pa.RecordBatch:
            lines = [json.dumps(w.settle()) for w in held.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([part] * len(held), pa.int64()), pa.array(lines, pa.string())], names=["host", "part", "wrapper"])

        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                held.setdefault(host, Wrapper()).add(page.as_py() or "")
                if len(held) >= HOSTS_AT_ONCE:
                    yield out()
                    held.clear()
        yield out()

    def joined(table: pa.Table) -> list[list]:
        line: list[list] | None = None
        # In an order that does not depend on which task came first.
        for text in sorted(table.column("wrapper").to_pylist(), key=lambda t: (len(t), t)):
            more = json.loads(text)
            line = more if line is None else align(line, more)
        return line or []

    def meet(table: pa.Table) -> pa.Table:
        return pa.table({"host": table.column("host")[:1], "wrapper": pa.array([json.dumps(joined(table))], pa.string())})

    def finish(table: pa.Table) -> pa.Table:
        return pa.table({"host": table.column("host")[:1], "hearts": pa.array([json.dumps(heart(joined(table)))], pa.string())})

    parts = pages.select(_host().alias("host"), "html").mapInArrow(infer, "host string, part long, wrapper string")
    some = parts.groupBy("host", F.floor(F.col("part") / TASKS_AT_ONCE)).applyInArrow(meet, "host string, wrapper string")
    return some.groupBy("host").applyInArrow(finish, "host string, hearts string")


def main_texts(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages(page_id, url, html)``, as in op6."""
    id_type = pages.schema["page_id"].dataType.simpleString()
    found = durable(wrappers(pages))
    if table_bytes(found) <= BROADCAST_BYTES:
        found = F.broadcast(found)
    rows = pages.select("page_id", "url", "html", _host().alias("of_host")).join(found, F.col("of_host") == F.col("host"), "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, list[str]] = {None: []}
        for batch in batches:
            texts = []
            for page, where in zip(batch.column("html"), batch.column("hearts").to_pylist(), strict=True):
                if where not in known:
                    known[where] = json.loads(where)
                texts.append(main_text(page.as_py() or "", known[where]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return rows.select("page_id", "url", "html", "hearts").mapInArrow(read, f"page_id {id_type}, url string, text string, n_chars long")


def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def queries():
    return {"op6_page_text": op6_page_text}
