"""HTML extraction by equivalence classes of template tokens.

Pages of a host are read in groups of about ``GROUP`` to twice that many pages, dealt by a hash. Within a group every start tag, with its
marks and its container path, is a token role, and so is every stretch of text at its place; roles that occur
equally often on every page (the same occurrence vector, of ones, of any counts or with zeros) form a class if a
tag is among them and enough pages hold them. A class is valid as far as its roles alternate in one order on all
pages; valid classes are nested by the places between whose tokens they lie, and one that reaches across a token of a
class around it is dropped. The class of roles that occur once on every page is the template's skeleton, the others are
its optional and repeated parts. The stretches between the tokens of the classes are slots.

Pages that have most of their text (``COPY``) in common with an earlier one are copies of it and tell nothing about the template: classes
are deduced from one page of each kind, so near copies keep their text. Text is template text only if its class is on half (``SUPPORT``) of these
pages or more, at least ``LEAST`` of them (within a block with other text ``LEAST_INSIDE``): what a minority shares, as a section that several
articles hold, stays.

The slots choose the main element: of the skeleton's elements the deepest one that holds most (``MOST``) of the text that changes from page to page. Of
elements within each other an ``article`` or ``main`` is preferred where it holds a third (``NAMED``) of the changing text. A page without that
element gives its own ``article``, ``main`` or ``body``. What is marked by tag or name as menu, header, footer, sidebar, notice, advert, form,
script, style or comment is left out; an article's own header holds its headline and stays.

Blocks are what block tags and line breaks separate. Null html is empty, null urls have an empty host;
broken, unclosed and truncated markup is read as far as it goes. Pages with equal
tags and text give equal results and count once. A page that
nothing would be left of keeps its text. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import Scratch, by_key, key_runs
from citeloom.llm.url_tree import host_of

GROUP = 64
MOST = 0.6  # share of a group's changing text that its main element must hold
NAMED = 1 / 3  # share that an article or main must hold to be preferred
COPY = 0.75  # share of both pages' text from which on a page is another one's copy
LEAST, LEAST_INSIDE = 3, 8  # different pages that template text is on: as a whole block, as part of one
MANY_HOSTS = 500_000  # hosts with their number of groups that are broadcast, some 30 MB
PATH = 1000  # characters of a role's path from which on a digest stands for its outer part
INLINE = 8  # innermost inline tags that tell text roles apart
SUPPORT = 0.5  # share of a group's pages that a class is on

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)")
_ATTRIBUTES = re.compile(r"""(?>[^'">]+|"[^"]*"|'[^']*')*+>""")
_QUOTES = re.compile(r"""["'>]""")
# what these hold is no markup
_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style textarea title noscript template iframe svg".split()}
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_NOT_WORD = re.compile(r"[^a-z0-9]+")
_TEXT_TAGS = frozenset("html body main article".split())  # never beside the main text by a name
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SIDE_TAGS = frozenset("nav header footer aside form button select dialog menu head".split())
_SIDE_MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus "
    "footer form header login masthead menu modal nav navbar navigation newsletter notice notices popup promo related replies reply search share "
    "sidebar skip social sponsor sponsored subscribe widget".split()
)
# what a class name may hold beside such a word; "no-sidebar", "has-header" and "comments-open" say something else
_PLACE_MARKS = frozenset(
    "area bar block bottom box container content global inner item items left link links list main page post primary right secondary section "
    "site top wrap wrapper".split()
)


def side_name(name: str) -> bool:
    """Whether a whole class, id or role names what stands beside the main text."""
    pieces = [x for x in _NOT_WORD.split(name) if x]
    return any(x in _SIDE_MARKS for x in pieces) and all(x in _SIDE_MARKS or x in _PLACE_MARKS for x in pieces)


def scan(source: str) -> Iterator[tuple[str, str, str]]:
    """Pieces of a page in order, each character once: ("text", it, ""), ("open" or "close", tag name, attributes) or ("raw", tag name, "").

    A tag without an end goes up to the next "<"; a comment or a raw element without one up to the page's end.
    """
    at, size = 0, len(source)
    marks: list[int] | None = None  # once a tag has no end: places of quotes and ends, and where a tag that is unquoted there ends
    ends: list[int] = []
    while at < size:
        tag = source.find("<", at)
        if tag < 0:
            yield "text", source[at:], ""
            return
        if tag > at:
            yield "text", source[at:tag], ""
        named = _NAME.match(source, tag)
        if named is None:
            if source.startswith("<!--", tag):
                end = source.find("-->", tag + 4)
                at = end + 3 if end >= 0 else size
            elif source[tag + 1 : tag + 2] in ("!", "?", "/") and tag + 1 < size:
                end = source.find(">", tag)
                at = end + 1 if end >= 0 else size
            else:
                yield "text", "<", ""
                at = tag + 1
            continue
        name, begin = named[2].lower(), named.end()
        if marks is not None:
            k = bisect_left(marks, begin)
            end = ends[k] if k < len(ends) else -1
        else:
            found = _ATTRIBUTES.match(source, begin)
            end = found.end() - 1 if found else -1
            if end < 0:
                marks, ends = _tag_ends(source, begin)
        if end < 0:
            stop = source.find("<", begin)
            stop = at = stop if stop >= 0 else size
        else:
            stop, at = end, end + 1
        if not named[1] and name in _RAW and end >= 0:
            close = _RAW[name].search(source, at)
            at = close.end() if close else size
            yield "raw", name, ""
        else:
            yield ("close" if named[1] else "open"), name, source[begin:stop]


def _tag_ends(source: str, begin: int) -> tuple[list[int], list[int]]:
    """Places of quotes and ">" from ``begin`` on, and for each where a tag that is unquoted just before it ends (-1: nowhere)."""
    marks = [m.start() for m in _QUOTES.finditer(source, begin)]
    ends = [-1] * len(marks)
    free = double = single = -1
    for i in range(len(marks) - 1, -1, -1):
        c = source[marks[i]]
        if c == ">":
            free = marks[i]
        elif c == '"':
            free, double = double, free
        else:
            free, single = single, free
        ends[i] = free
    return marks, ends


class Page:
    """A page's text runs and elements, read once."""

    def __init__(self, source: str):
        self.roles: list[str] = []  # of elements, in order
        self.names: list[str] = []
        self.side: list[bool] = []  # marked as beside the main text, or inside such
        self.parent: list[int] = []
        self.runs: list[tuple[int, str]] = []  # (element, text); a break has the element -1
        self.tokens: list[tuple[str, int]] = []  # (role, run or -1 for a tag), in order
        inline: list[str] = []  # inline tags open since the last break
        open_inline: Counter[str] = Counter()
        stack: list[tuple[str, int]] = []
        open_tags: Counter[str] = Counter()
        own_part: list[bool] = []  # inside an article or main
        for kind, name, rest in scan(source):
            if kind == "text":
                element = stack[-1][1] if stack else -2
                if element >= 0 and not self.side[element]:
                    text = " ".join(name.split())
                    if text:
                        self.tokens.append((f"{self.roles[element]} {'/'.join(inline[-INLINE:])} {text}", len(self.runs)))
                self.runs.append((element, name))
                continue
            if kind == "raw":
                if name in ("textarea", "title"):
                    self.runs.append((-1, ""))
                continue
            if name not in _INLINE:
                self.runs.append((-1, ""))
                inline.clear()
                open_inline.clear()
            elif kind == "close":
                if open_inline[name]:
                    while inline.pop() != name:
                        pass
                    open_inline = Counter(inline) if len(inline) < 64 else open_inline
                    open_inline[name] = inline.count(name) if len(inline) < 64 else max(0, open_inline[name] - 1)
            elif name not in _VOID:
                inline.append(name)
                open_inline[name] += 1
            if kind == "close":
                if open_tags[name]:
                    while True:
                        gone = stack.pop()[0]
                        open_tags[gone] -= 1
                        if gone == name:
                            break
            elif name not in _VOID and name not in _INLINE and name != "p":
                if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                    open_tags[stack.pop()[0]] -= 1
                up = stack[-1][1] if stack else -1
                marked = [x for v in _MARKS.findall(rest) for x in v.lower().strip("\"'").split()] if rest else []
                marks = [x for v in marked for x in _NOT_WORD.split(v) if x]
                role = ".".join([name, *marks])
                self.parent.append(up)
                self.names.append(name)
                inner = up >= 0 and own_part[up]
                own_part.append(inner or name in ("article", "main"))
                # an article's own header holds its headline
                beside = (name in _SIDE_TAGS and not (name == "header" and inner)) or (name not in _TEXT_TAGS and any(map(side_name, marked)))
                self.side.append(beside or (up >= 0 and self.side[up]))
                path = f"{self.roles[up]}/{role}" if up >= 0 else role
                if len(path) > PATH:  # very deep nesting: the outer path as its digest
                    path = f"#{hashlib.md5(path.encode('utf-8', 'surrogatepass')).hexdigest()}/{name}"
                self.roles.append(path)
                self.tokens.append((path, -1))
                if not rest.rstrip().endswith("/") or name not in ("path", "circle"):
                    stack.append((name, len(self.names) - 1))
                    open_tags[name] += 1

    def inside(self, chosen: set[int]) -> list[bool]:
        """For each element whether it or an ancestor is chosen."""
        out: list[bool] = []
        for i, up in enumerate(self.parent):
            out.append(i in chosen or (up >= 0 and out[up]))
        return out

    def text(self, chosen: set[int] | None, template: dict[str, bool] | None = None) -> str:
        """The slots inside the chosen elements (None: anywhere) that aren't beside the main text, by blocks.

        Text of ``template`` roles is cut where it is a whole block and, where their value is true, as part of one.
        """
        within = self.inside(chosen) if chosen is not None else None
        fixed = {run: template[role] for role, run in self.tokens if run >= 0 and role in template} if template else {}
        blocks, slot, whole = [], [], True
        for k, (element, run) in enumerate([*self.runs, (-1, "")]):
            if element == -1:
                if slot:
                    block = "" if whole else " ".join("".join(map(entities.unescape, slot)).split())
                    if block:
                        blocks.append(block)
                    slot, whole = [], True
            elif element == -2:
                if chosen is None:
                    slot.append(run)
                    whole = False
            elif not self.side[element] and (within is None or within[element]):
                slot.append(" " if fixed.get(k) else run)
                whole = whole and (k in fixed or not run.strip())
        return "\n".join(blocks)


def _ordered(roles: list[str], places: list[dict[str, list[int]]]) -> list[str]:
    """The roles of a class that alternate in one order wherever it occurs: of each repetition the first role comes first."""
    out = roles[:1]
    for role in roles[1:]:
        for at in places:
            if role in at:
                first, last, own = at[out[0]], at[out[-1]], at[role]
                if any(p <= q for p, q in zip(own, last, strict=True)) or any(p >= q for p, q in zip(own, first[1:], strict=False)):
                    break
        else:
            out.append(role)
    return out


def _nested(classes: list[list[str]], pages: list[Page]) -> list[list[str]]:
    """The classes without those that reach across a token of a class that is open around them."""
    alive = set(range(len(classes)))
    while True:
        index = {role: (c, i) for c in alive for i, role in enumerate(classes[c])}
        crossing: set[int] = set()
        for page in pages:
            open_: list[list[int]] = []  # (class, next role)
            for role, _ in page.tokens:
                if role not in index:
                    continue
                c, i = index[role]
                if c in crossing:
                    continue
                if i == 0:
                    if len(classes[c]) > 1:
                        open_.append([c, 1])
                    continue
                while open_ and open_[-1][0] != c:
                    crossing.add(open_.pop()[0])
                if open_:
                    open_[-1][1] = i + 1
                    if i + 1 == len(classes[c]):
                        open_.pop()
        if not crossing:
            return [classes[c] for c in sorted(alive)]
        alive -= crossing


def valid_classes(pages: list[Page]) -> list[list[str]]:
    """The valid, nested classes of roles with equal occurrence vectors, each in its order; the skeleton is the first."""
    places: list[dict[str, list[int]]] = []
    vectors: dict[str, list[tuple[int, int]]] = {}
    for k, page in enumerate(pages):
        at: dict[str, list[int]] = {}
        for place, (role, _) in enumerate(page.tokens):
            at.setdefault(role, []).append(place)
        places.append(at)
        for role, own in at.items():
            vectors.setdefault(role, []).append((k, len(own)))
    by_vector: dict[tuple[tuple[int, int], ...], list[str]] = {tuple((k, 1) for k in range(len(pages))): []}
    least = max(min(LEAST, len(pages)), SUPPORT * len(pages))
    for role, vector in vectors.items():
        if len(vector) >= least:
            by_vector.setdefault(tuple(vector), []).append(role)
    classes = []
    for vector, roles in by_vector.items():
        at = places[vector[0][0]]
        # a text can't be its class's first role: without the tag that it belongs to its place isn't the template's
        roles.sort(key=lambda r: at[r][0])
        while roles and " " in roles[0]:
            roles.pop(0)
        own = _ordered(roles, [places[k] for k, _ in vector])
        classes.append(own)
    kept = _nested([c for c in classes if c], pages)
    return [classes[0], *(c for c in kept if c is not classes[0])]


def skeleton(pages: list[Page]) -> list[str]:
    """The tags of the valid class of roles with the occurrence vector (1, ..., 1), in their common order."""
    return [r for r in valid_classes(pages)[0] if " " not in r]


def different_pages(pages: list[Page]) -> list[Page]:
    """The pages without those that have ``COPY`` of their text, and of the other page's, in common with an earlier one."""
    kept: list[tuple[Page, Counter[str], int]] = []
    for page in pages:
        own: Counter[str] = Counter()
        for _, run in page.tokens:
            if run >= 0:
                own[page.runs[run][1].strip()] += 1
        size = sum(len(t) * n for t, n in own.items())
        for _, other, total in kept:
            least = COPY * max(size, total)
            if min(size, total) >= least and sum(len(t) * n for t, n in (own & other).items()) >= least:
                break
        else:
            kept.append((page, own, size))
    return [p for p, _, _ in kept]


def template_texts(pages: list[Page], classes: list[list[str]]) -> dict[str, bool]:
    """The text roles of valid classes that are on half of the pages or more, and whether they may be part of a block."""
    roles = {r for c in classes for r in c if " " in r}
    held = Counter(r for page in pages for r in {r for r, _ in page.tokens} & roles)
    return {r: n >= LEAST_INSIDE for r, n in held.items() if n >= max(LEAST, SUPPORT * len(pages))}


def main_role(pages: list[Page], order: list[str], template: dict[str, bool] | None = None) -> str | None:
    """The deepest skeleton element whose slots hold most of the group's changing text; a named one within or around it comes first."""
    seen = Counter(run for page in pages for run in {r for e, r in page.runs if e >= 0})
    changing: Counter[str] = Counter()
    total = 0
    for page in pages:
        fixed = {run for role, run in page.tokens if run >= 0 and role in template} if template else set()
        held = [0] * len(page.names)
        for k, (element, run) in enumerate(page.runs):
            if element < 0 or page.side[element] or k in fixed or (len(pages) > 1 and seen[run] == len(pages)):
                continue
            total += len(run)
            held[element] += len(run)
        for i in range(len(held) - 1, -1, -1):  # an element comes before what it holds
            changing[page.roles[i]] += held[i]
            if page.parent[i] >= 0:
                held[page.parent[i]] += held[i]
    fit = [r for r in order if total and changing[r] >= MOST * total]
    best = max(fit, key=lambda r: (r.count("/"), r), default=None)
    named = [r for r in order if r.rsplit("/", 1)[-1].split(".")[0] in ("article", "main") and total and changing[r] >= NAMED * total]
    related = [r for r in named if best is None or best.startswith(f"{r}/") or r == best or r.startswith(f"{best}/")]
    return max(related, key=lambda r: (changing[r], r.count("/"), r), default=best)


def main_texts(sources: list[str]) -> list[str]:
    """Main texts of the pages of one group."""
    pages = [Page(s) for s in sources]
    distinct = different_pages(list({tuple(r for r, _ in p.tokens): p for p in pages}.values()))
    classes = valid_classes(distinct)
    template = template_texts(distinct, classes)
    role, out = main_role(distinct, [r for r in classes[0] if " " not in r], template), []
    for page in pages:
        chosen = {i for i, r in enumerate(page.roles) if r == role}
        for name in ("article", "main", "body"):  # a page whose layout isn't the group's
            chosen = chosen or {i for i, n in enumerate(page.names) if n == name and not page.side[i]}
        # where all is equal on all pages, nothing tells a template from its slots
        out.append(page.text(chosen or None, template) or page.text(chosen or None))
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in key_runs(batches, 2):
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2] or ""))
        columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())]
        texts = main_texts([r[2] or "" for r in rows])
        yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """A row for each page: (page_id, url, text).

    A host's pages are dealt to groups by the hash of their id and the host's number of pages, whatever the partitions. Only
    hosts of more than one group need their number: up to ``MANY_HOSTS`` of them are broadcast, more are joined. So html
    moves once, or twice where there are more.
    """
    base = pages.select(host_of(F.col("url")).alias("host"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    many = base.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > 2 * GROUP).select("host", F.ceil(F.col("n") / (1.5 * GROUP)).alias("groups"))
    many = Scratch(pages.sparkSession, "hosts").write(many)
    many = F.broadcast(many) if many.count() <= MANY_HOSTS else many
    part = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("groups", F.lit(1)))
    rows = base.join(many, "host", "left").select("host", part.alias("part"), "page_id", "url", "html")
    return by_key(rows, ["host", "part"]).mapInArrow(_extract, "page_id long, url string, text string")


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
