"""Main text of web pages by markup zones and nearest-URL page differencing.

A page is read as lines, one per block of text. Zones come from its markup: lines inside an
article or main element, lines inside elements for menus, headers, footers, sidebars, adverts,
notices, forms and comments, and open lines. Pages of a host stand in the order of their paths, and
a page is paired with the nearest one: that page before or after it whose path shares the longer
beginning with its own. The lines of a page outside its article are aligned with those of its
partner by longest common subsequence, and lines that both have in the same order are deleted.

Differencing alone cannot give whole texts: paragraphs that two articles share would go, and
menus that differ between pages, or stand on a host's only page, would stay. So lines inside an
article element are never deleted for being shared, and lines that markup names as page furniture
are deleted whether shared or not. Differencing decides about every open line, on pages with an
article element too: their text may stand outside of it.

A page is parsed once. The order is a distributed prefix sum over (host, path), so a host with very many
pages spans many tasks, and neighbours are found by joins on host and place, which no two pages
share. What is shuffled for it is line hashes; texts are joined with them only where a page has open
lines. Many rows of one URL are a skewed join with one lookup row, which adaptive execution splits.

Defined cases: a null or empty page has an empty text; a null URL belongs to an empty host; a page
without partner keeps its open lines; pages of one URL, and pages of a host whose lines outside the article
are all equal, are no partners of each other; pages without URL have none; an empty table gives an empty table.
"""

from __future__ import annotations

import html as html_module
import re
from collections import Counter
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.llm.ranks import ranked
from docwarden.llm.storage import bounded_batches, stored
from docwarden.llm.tokens import signed, words
from docwarden.llm.urls import host_of, path_of

#: The beginning of a comment, a section of raw data, a declaration, or a tag with its name.
START = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
#: What can end a tag or hide its end.
STOP = re.compile(r"""[>"']""")
#: One attribute, its value quoted or bare; read one after another, so no value is searched for names.
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
#: Elements whose content is never text.
SILENT = frozenset("script style head title template noscript svg math iframe object canvas select "
                   "textarea button audio video datalist".split())
#: Those of them whose content is raw: without an end they reach to the end of the page.
RAW = frozenset("script style title iframe textarea".split())
#: Elements around page furniture.
FURNITURE = frozenset("nav aside footer form dialog menu".split())
#: Words in a class, an id or a role that mark page furniture.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments "
    "reply replies disqus respond share sharing social related recommended toolbar pagination pager "
    "search login complementary contentinfo".split())
#: The same words for page heads, which an article may have of its own.
HEAD_WORDS = frozenset({"header", "topbar"})
#: Words that only say what kind of box a class or an id names: with one of the words above they
#: still mean furniture ("share-buttons"), while other words make a name of its own ("social-impact").
BOX_WORDS = frozenset(
    "area articles bar block box button buttons container content form icons inner item items left links list "
    "notice outer panel posts right section site slot stories thread top bottom unit widget wrapper".split())
#: Classes that authors give to text of an article.
TEXT_CLASSES = frozenset({"alert", "notice", "notices"})
#: Elements whose id is judged inside an article; other ids there come from headings and names in the text.
BOXES = frozenset({"div", "ul", "ol"})
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
MAIN = frozenset({"article", "main"})
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby "
    "s samp small span strike strong sub sup time tt u var wbr br".split())
#: Elements that the start of another one ends.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A form is furniture, but an article may stand in it.
MAIN_ZONE, OPEN_ZONE, FURNITURE_ZONE, FORM_ZONE = 0, 1, 2, 3


class Tags:
    """The tags of a page, read once from left to right.

    Every step goes on from where the last one ended, and what is not found once is not looked for
    again, so a page of any content takes time in proportion to its length.
    """

    def __init__(self, page: str):
        self.page, self.absent = page, set()

    def _find(self, what: str, at: int) -> int:
        """Where ``what`` comes next, or -1; looked for in vain once at most."""
        if what in self.absent:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def _end(self, at: int) -> int:
        """Where the ``>`` of a tag is; one inside a quoted value does not count."""
        while m := STOP.search(self.page, at):
            if m[0] == ">":
                return m.start()
            close = self._find(m[0], m.end())
            if close < 0 or ">" in self.absent:
                return self._find(">", m.end())
            at = close + 1
        self.absent.add("end")
        return -1

    def __iter__(self):
        """(start, end, closing, name, attributes) of every tag; name is empty for other markup."""
        at = 0
        while m := START.search(self.page, at):
            if m[1] or m[2]:
                ending = "-->" if m[1] else "]]>"
                stop = self._find(ending, m.end())
                stop = len(self.page) if stop < 0 else stop + len(ending)
                at = (yield m.start(), stop, False, "", "") or stop
                continue
            stop = self._find(">", m.end()) if m[3] else (-1 if "end" in self.absent else self._end(m.end()))
            if stop < 0:
                at = m.end()  # no tag, but text
                continue
            at = (yield m.start(), stop + 1, bool(m[4]), (m[5] or "").lower(), "" if m[3] else self.page[m.end(): stop]) or stop + 1

    def after_element(self, name: str, at: int) -> int:
        """Where the text after the end tag of ``name`` begins, or -1."""
        if f"</{name}" in self.absent:
            return -1
        close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(self.page, at)
        if not close:
            self.absent.add(f"</{name}")
            return -1
        return close.end()


def _attributes(text: str) -> dict[str, str]:
    """Lower-cased names and values of a tag's attributes; the first of a name counts."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    return found


def _names_box(token: str, more: frozenset[str] = frozenset()) -> bool:
    """Whether all words of one class or id are for furniture, but for those of boxes and numbers."""
    parts = {x for x in re.split(r"[^a-z0-9]+", token) if x and not x.isdigit()}
    return bool(parts & (FURNITURE_WORDS | more)) and parts <= FURNITURE_WORDS | BOX_WORDS | more


def _furniture(name: str, attributes: dict[str, str], in_main: bool) -> bool:
    if name in FURNITURE or (name == "header" and not in_main):
        return True
    if not attributes or name in ("html", "body", *MAIN):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    classes, own_id = attributes.get("class", "").split(), attributes.get("id", "")
    roles = set(attributes.get("role", "").split())
    if roles & FURNITURE_WORDS or (not in_main and roles & HEAD_WORDS):
        return True
    if in_main:
        if any(c not in TEXT_CLASSES and _names_box(c) for c in classes):
            return True
        return name in BOXES and not {"section", "chapter"} & set(classes) and _names_box(own_id)
    if name in HEADINGS or name == "section":
        own_id = own_id if name == "section" and _names_box(own_id) else ""
    return any(_names_box(token, HEAD_WORDS) for token in [*classes, own_id])


def page_lines(page: str) -> list[tuple[int, str]]:
    """(zone, line) of every block of text in page order."""
    lines: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements and the zone outside them
    depth: Counter[str] = Counter()  # how many of a name are open
    zone = OPEN_ZONE
    at = 0

    def end_line():
        text = " ".join(html_module.unescape("".join(held)).split())
        if text:
            lines.append((FURNITURE_ZONE if zone == FORM_ZONE else zone, text))
        held.clear()

    def pop() -> int:
        name, outside = stack.pop()
        depth[name] -= 1
        return outside

    tags = Tags(page)
    reader = iter(tags)
    skip = None
    while (tag := _next(reader, skip)) is not None:
        start, stop, closing, name, text = tag
        skip = None
        if start > at:
            held.append(page[at:start])
        at = stop
        if not name:
            continue
        if name in SILENT:
            end_line()
            if not closing and not text.endswith("/"):
                end = tags.after_element(name, at)
                if end >= 0 or name in RAW:
                    at = skip = end if end >= 0 else len(page)
            continue
        attributes = _attributes(text) if text and not closing else {}
        in_main = zone == MAIN_ZONE
        if name in INLINE and not (attributes and _furniture(name, attributes, in_main)):
            if name == "br":
                held.append("\n")
            if not (closing and stack and any(n == name for n, _ in stack[-8:])):
                continue
        end_line()
        if name in VOID:
            continue
        if closing:
            if depth[name]:
                while stack[-1][0] != name:
                    pop()
                zone = pop()
            continue
        closed = CLOSES.get(name)
        if closed and stack and stack[-1][0] in closed:
            zone = pop()
        stack.append((name, zone))
        depth[name] += 1
        main = name in MAIN or "main" in attributes.get("role", "").split()
        if zone == FORM_ZONE:
            zone = MAIN_ZONE if main and not _furniture(name, attributes, False) else zone
        elif zone != FURNITURE_ZONE:
            if _furniture(name, attributes, in_main):
                plain = name == "form" and not _furniture("div", attributes, in_main)
                zone = FORM_ZONE if plain and not in_main else FURNITURE_ZONE
            elif main:
                zone = MAIN_ZONE
    if at < len(page):
        held.append(page[at:])
    end_line()
    return lines


def _next(reader, skip: int | None):
    """The next tag, from ``skip`` on if it is given."""
    try:
        return next(reader) if skip is None else reader.send(skip)
    except StopIteration:
        return None


def common_lines(a: list, b: list) -> set[int]:
    """Places of ``a`` in one longest common subsequence with ``b`` (bit-parallel dynamic programme)."""
    shared: set[int] = set()
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        shared.add(low)
        low += 1
    end_a, end_b = len(a), len(b)
    while end_a > low and end_b > low and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
        shared.add(end_a)
    a, b = a[low:end_a], b[low:end_b]
    if not a or not b:
        return shared
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    row, rows = full, [full]
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    # a zero bit j in rows[i] says that the common length grows at b[j]
    i, j = len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            shared.add(low + i - 1)
            i, j = i - 1, j - 1
        elif (~rows[i - 1] & ((1 << j) - 1)).bit_count() >= (~rows[i] & ((1 << (j - 1)) - 1)).bit_count():
            i -= 1
        else:
            j -= 1
    return shared


def _line_hashes(lines: list[str]) -> np.ndarray:
    return signed(words(pa.array(lines, pa.string()), b"", fold=False).hashes)


def _read(batches):
    """(host, path, page id, url, kept lines, which line outside the article each is, hashes of all
    lines outside the article) of each page; -1 stands for lines inside it."""
    for batch in batches:
        held = [page_lines(p or "") for p in batch.column(4).to_pylist()]
        outside = [[t for z, t in lines if z != MAIN_ZONE] for lines in held]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in outside])]).astype(np.int32)
        hashes = _line_hashes([t for x in outside for t in x])
        kept, places = [], []
        for lines in held:
            at = np.cumsum([z != MAIN_ZONE for z, _ in lines]) - 1
            kept.append([t for z, t in lines if z <= OPEN_ZONE])
            places.append([-1 if z == MAIN_ZONE else int(at[i]) for i, (z, _) in enumerate(lines) if z <= OPEN_ZONE])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(kept, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32())),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes))],
            ["host", "path", "page_id", "url", "kept", "places", "outside"])


def nearer(path: str, before: str | None, after: str | None) -> int:
    """0 if ``before`` shares the longer beginning with ``path`` (or as long a one), 1 if ``after`` does."""
    shared = [-1 if p is None else len(commonprefix([path, p])) for p in (before, after)]
    return int(shared[1] > shared[0])


def _unshared(batches):
    """Delete open lines that the nearest page has in the same order."""
    for batch in batches:
        rows = batch.to_pydict()
        out = []
        for i, kept in enumerate(rows["kept"]):
            near = ("before", "after")[nearer(rows["path"][i], rows["before_path"][i], rows["after_path"][i])]
            shared = common_lines(rows["outside"][i], rows[f"{near}_lines"][i] or [])
            out.append("\n".join(t for t, k in zip(kept, rows["places"][i], strict=True) if k not in shared))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def neighbours(read: DataFrame) -> DataFrame:
    """``host, url`` and path and lines of the pages before and after it on its host, by path.

    A URL is one page, whatever rows it has (of revisions, the one with the greatest lines stands for it). URLs
    of a host with the same lines are copies, which say nothing about what is shared: they are one place,
    that of their least URL, so neighbours always differ.
    """
    urls = stored(read.where("url IS NOT NULL").groupBy("host", "path", "url").agg(F.max("outside").alias("lines")))
    places = urls.groupBy("host", "lines").agg(F.min(F.struct("path", "url")).alias("least"))
    order = stored(ranked(places.select("host", "least.path", "least.url", "lines"), "host", ["path", "url"]).select(
        "host", "path", "lines", "idx"))

    def beside(name: str, step: int) -> DataFrame:
        return order.select("host", (F.col("idx") + step).alias("idx"),
                            F.col("path").alias(f"{name}_path"), F.col("lines").alias(f"{name}_lines"))

    found = order.drop("path").join(beside("before", 1), ["host", "idx"], "left").join(
        beside("after", -1), ["host", "idx"], "left")
    return urls.select("host", "url", "lines").join(found, ["host", "lines"]).select(
        "host", "url", *[f"{n}_{c}" for n in ("before", "after") for c in ("path", "lines")])


def main_texts(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``."""
    bounded_batches(pages.sparkSession)
    u, pid = F.col(f"`{url}`"), F.col(f"`{page_id}`")
    given = pages.select(
        host_of(u).alias("host"), path_of(u).alias("path"), pid.alias("page_id"), u.cast("string").alias("url"),
        F.col(f"`{html}`").cast("string").alias("html"))
    kind = dict(given.dtypes)["page_id"]
    read = stored(given.mapInArrow(
        _read, f"host string, path string, page_id {kind}, url string, kept array<string>, places array<int>, "
        "outside array<long>"))
    opened = F.exists("places", lambda k: k >= 0)
    whole = read.where(~opened).select("page_id", "url", F.array_join("kept", "\n").alias("text"))
    partly = read.where(opened).join(neighbours(read), ["host", "url"], "left").select(
        "page_id", "url", "path", "kept", "places", "outside",
        "before_path", "before_lines", "after_path", "after_lines").mapInArrow(
        _unshared, f"page_id {kind}, url string, text string")
    return whole.unionByName(partly).withColumn("n_chars", F.length("text").cast("long"))
