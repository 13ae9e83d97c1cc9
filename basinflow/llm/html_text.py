"""HTML extraction by wrapper induction over the pages of a host.

1. *Trees.* A task parses each page once: its tree of block elements is folded
   (siblings of one signature, tag with role and class words, become one *slot*),
   and every text block of the page, menus and footers too, is kept with its slot.
   Only scripts, styles, templates and the contents of form fields and embedded objects are left out.
2. *Alignment.* The distinct trees of a host are aligned by simple tree matching
   and united into its template; slots on under 1 in ``RARE`` of its pages go. A tree
   is aligned once, however many pages have it, and each block then knows its
   template slot. What the template lacks follows its nearest ancestor there.
3. *Variation.* One grouped count gives for every (host, slot, text) the pages it is
   on, and from it for every slot its length and its linked length, summed over pages as parts of the
   page, and the share of its texts that several pages repeat.
4. *Decision*, a host at a time over its few slots. A slot's mass is its unlinked
   length, ten times less where all its texts repeat. The content region is found by
   going down from the root to the child that holds most of the mass, as long as
   that child is a container. Slots outside the region are template. Inside, slots
   of repeated texts, slots of repeated links and small parts of a furniture kind are template,
   and so are single texts that half of the host's pages (3 at least) repeat in a
   slot whose texts mostly vary.

Element names, roles and the words that the task itself names are a *prior*: they
multiply mass by ``PRIOR`` (main) or divide it twice (furniture), and a main element is left for a child only
if that holds nearly all of its mass. The prior weighs as much as one page, ``PRIOR ** (1 / pages)``: it settles hosts of a page
or two, and on others alignment decides (a test turns it off there, and no text changes). Names alone tell a reader's comment from the
article it stands in, since both vary.

Steps 3 and 4 read the blocks as columns, so pages are not parsed again, and a hot
host sends one row per distinct tree and distinct text into its groups. Trees of a
host are united by salt, then over salts, in the order of their counts: the result
does not depend on how pages fall to tasks.

Defined results: a null, empty or tag-less page gives its own text (or ""); pages
without a host share one template; a host of one page is decided by that page's
shares; a page with nothing in the host's region gives its blocks that are neither
furniture nor links; constant texts stay where they are all that a page has;
unclosed, misnested and very deep tags are closed by the nearest open element, and
slots below ``DEPTH`` levels belong to their ancestor there; repeated rows give
repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinflow.llm.common import materialize, read_table

#: A slot stays in the template from this share of the host's pages on: 1 in RARE.
RARE = 1000
#: Groups over which the distinct trees of a host are dealt for the first union.
SALTS = 256
DEPTH = 64
#: Least pages that repeat a constant text, and their least share.
LEAST, SHARE = 3, 0.5
#: Factor by which a main element raises, and a furniture element lowers, the mass below it.
PRIOR = 10.0

# Element names and roles of the HTML standard, and the task's words for page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Implied where a page leaves them out, so they are no slots.
ROOTS = frozenset("html body".split())
SILENT = frozenset("head template svg math canvas object".split())
#: Elements that hold text, not a region of a page.
TEXTUAL = HEADINGS | frozenset("p li pre blockquote dt dd td th caption figcaption summary".split())
MAIN = frozenset("article main".split())
FURNITURE_TAGS = frozenset("nav header footer aside form fieldset legend option dialog menu search".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE_WORDS = frozenset("menu header footer sidebar notice ad ads advert adverts comment comments".split())
SCOPES = frozenset("html table td th caption button object template".split())
ENDED_BY_SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIST_SCOPES = frozenset("ul ol dl table tbody thead tfoot select menu dir".split())
NESTABLE = SCOPES | LIST_SCOPES | frozenset("tr body html article main section div".split())

#: Comments, declarations and tags. Quotes bind only after an equals sign; an unclosed quote is an ordinary character.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?|[\"'])*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

CONTENT, NEUTRAL, TEMPLATE = 1, 0, -1


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)}


class Page:
    """One pass over a page: ``slots`` [(parent, signature)] of the folded tree and ``blocks`` [(slot, text, linked characters)]."""

    def __init__(self, html: str):
        self.slots: list[tuple[int, str]] = [(-1, "#")]
        self.blocks: list[tuple[int, str, int]] = []
        self._known: dict[tuple[int, str], int] = {}
        # open elements: tag, slot, whether shown, whether inside a link, levels of slots
        self._open: list[tuple[str, int, bool, bool, int]] = [("#", 0, True, False, 0)]
        self._parts: list[str] = []
        self._linked = 0
        self._read(html)

    def _read(self, html: str) -> None:
        at = 0
        find = TOKEN.search
        while m := find(html, at):
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            if not (name := m[2]):
                continue
            tag = name.lower()
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, m[3])
            if tag in RAW:  # its content has no tags, and is not shown
                close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = close.end() if close else len(html)
                self._end(tag)
            elif tag == "xmp":  # its content has no tags either, and is shown as it is
                close = re.compile(r"</xmp\s*>", re.I).search(html, at)
                self._text(html[at : close.start() if close else len(html)], raw=True)
                at = close.end() if close else len(html)
                self._end(tag)
        if at < len(html):
            self._text(html[at:])
        self._flush()

    def _text(self, text: str, raw: bool = False) -> None:
        top = self._open[-1]
        if not top[2]:
            return
        if "&" in text and not raw:
            text = unescape(text)
        self._parts.append(text)
        if top[3]:
            self._linked += len(text)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.blocks.append((self._open[-1][1], text, min(self._linked, len(text))))
            self._parts = []
            self._linked = 0

    def _pop_to(self, index: int) -> None:
        if any(e[0] in BLOCK for e in self._open[index:]):
            self._flush()
        del self._open[index:]

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br" or tag == "wbr":
            self._text(" " if tag == "br" else "")
            return
        is_block = tag in BLOCK
        if is_block:
            self._flush()
            self._close_implied(tag)
        if tag in VOID:
            return
        _, slot, shown, linked, depth = self._open[-1]
        signature = tag
        if "=" in attributes:
            found = _attributes(attributes)
            role = "main" if found.get("itemprop") == "articleBody" else found.get("role", "").lower()
            words = WORD.findall(f"{found.get('class', '')} {found.get('id', '')}")
            if words or role:
                signature = f"{tag}@{role}.{'.'.join(words).lower()}"
        if tag in SILENT:
            shown = False
        if is_block and shown and depth < DEPTH and tag not in ROOTS:
            key = (slot, signature)
            if (slot := self._known.get(key)) is None:
                slot = self._known[key] = len(self.slots)
                self.slots.append(key)
            depth += 1
        self._open.append((tag, slot, shown, linked or tag == "a", depth))

    def _close_implied(self, tag: str) -> None:
        names = ENDED_BY_SIBLING.get(tag, ())
        for i in range(len(self._open) - 1, 0, -1):
            name = self._open[i][0]
            if name == "p" and tag not in ("html", "head", "body") or name in names or name == "head" and tag != "head":
                self._pop_to(i)
                if name != "p":
                    return
            elif name in SCOPES and name not in names or name in LIST_SCOPES:
                return

    def _end(self, tag: str) -> None:
        inline = tag not in BLOCK
        for i in range(len(self._open) - 1, 0, -1):
            name = self._open[i][0]
            if name == tag:
                if not inline:
                    self._flush()
                self._pop_to(i)
                return
            if inline and name in BLOCK or name in SCOPES and tag not in NESTABLE:
                return


class Template:
    """The union of aligned folded trees of a host: signatures, children, and the pages that have each slot."""

    def __init__(self):
        self.signature, self.children, self.seen, self.pages = ["#"], [[]], [0], 0

    def add(self, slots: list[tuple[int, str]], n: int | list[int], pages: int) -> None:
        """Align a tree given as [(parent, signature)], seen ``n`` times; slots the template lacks are added."""
        found = self.align(slots, grow=True)
        for i, s in enumerate(found):
            self.seen[s] += n if isinstance(n, int) else n[i]
        self.pages += pages

    def align(self, slots: list[tuple[int, str]], grow: bool = False) -> list[int]:
        """The template slot of each slot of a tree. Without ``grow`` a slot that the template lacks gets its parent's."""
        children: list[list[int]] = [[] for _ in slots]
        for i, (parent, _) in enumerate(slots):
            if parent >= 0:
                children[parent].append(i)
        found = [0] * len(slots)
        self._map(0, 0, [s for _, s in slots], children, found, {}, grow)
        return found

    def _match(self, a: int, b: int, signature, children, memo) -> int:
        """Simple tree matching: the most nodes of the trees under a and b that map in order."""
        if self.signature[a] != signature[b]:
            return 0
        if (a, b) not in memo:
            memo[a, b] = 1 + self._table(a, b, signature, children, memo)[-1][-1]
        return memo[a, b]

    def _table(self, a: int, b: int, signature, children, memo) -> list[list[int]]:
        table = [[0] * (len(children[b]) + 1)]
        for x in self.children[a]:
            row, above = [0], table[-1]
            for j, y in enumerate(children[b]):
                row.append(max(above[j + 1], row[j], above[j] + self._match(x, y, signature, children, memo)))
            table.append(row)
        return table

    def _pairs(self, a: int, b: int, signature, children, memo) -> dict[int, int]:
        """The children of b that map to children of a."""
        table = self._table(a, b, signature, children, memo)
        i, j = len(self.children[a]), len(children[b])
        pairs: dict[int, int] = {}
        while i and j:
            x, y = self.children[a][i - 1], children[b][j - 1]
            w = self._match(x, y, signature, children, memo)
            if w and table[i][j] == table[i - 1][j - 1] + w:
                pairs[y] = x
                i, j = i - 1, j - 1
            elif table[i][j] == table[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return pairs

    def _map(self, a: int, b: int, signature, children, found, memo, grow: bool) -> None:
        pairs = self._pairs(a, b, signature, children, memo)
        place = 0
        for y in children[b]:
            if y in pairs:
                x = pairs[y]
                place = self.children[a].index(x) + 1
                inner = memo
            elif grow:
                x = len(self.signature)
                self.signature.append(signature[y])
                self.children.append([])
                self.seen.append(0)
                self.children[a].insert(place, x)
                place += 1
                inner = {}
            else:
                self._follow(y, a, children, found)
                continue
            found[y] = x
            self._map(x, y, signature, children, found, inner, grow)

    def _follow(self, y: int, a: int, children, found) -> None:
        stack = [y]
        while stack:
            y = stack.pop()
            found[y] = a
            stack += children[y]

    def slots(self) -> tuple[list[tuple[int, str]], list[int]]:
        """The tree as [(parent, signature)], parents first, without rare slots, and the pages of each slot."""
        order, parents, place = [0], [-1], {0: 0}
        for s in order:
            for c in self.children[s]:
                if self.seen[c] * RARE >= self.pages:
                    place[c] = len(order)
                    order.append(c)
                    parents.append(place[s])
        return [(p, self.signature[s]) for p, s in zip(parents, order)], [self.seen[s] for s in order]

    def dump(self) -> str:
        slots, seen = self.slots()
        return json.dumps([slots, seen, self.pages])

    @classmethod
    def load(cls, text: str) -> Template:
        """A template whose slots have the numbers of the dumped list."""
        out = cls()
        slots, out.seen, out.pages = json.loads(text)
        out.signature = [s for _, s in slots]
        out.children = [[] for _ in slots]
        for i, (parent, _) in enumerate(slots):
            if parent >= 0:
                out.children[parent].append(i)
        return out


def _kind(signature: str) -> tuple[str, bool, bool]:
    """Tag, whether of a main kind, whether of a furniture kind."""
    tag, _, rest = signature.partition("@")
    role, _, words = rest.partition(".")
    furniture = tag in FURNITURE_TAGS or role in FURNITURE_ROLES or not FURNITURE_WORDS.isdisjoint(words.split("."))
    return tag, (tag in MAIN or role in ("main", "article")) and not furniture, furniture and tag not in ("html", "body", "#")


def decide(slots: list[tuple[int, str]], stats: dict[int, tuple[int, int, int, int]], pages: int = 1) -> list[int]:
    """CONTENT, NEUTRAL or TEMPLATE for each template slot of a host of so many pages; ``stats``: slot -> (texts, repeated texts, length, linked length)."""
    n = len(slots)
    prior = PRIOR ** (1 / max(pages, 1))
    kinds = [_kind(s) for _, s in slots]
    repeats, own = [0.0] * n, [0.0] * n
    in_main, in_furniture = [False] * n, [False] * n
    for s, (parent, _) in enumerate(slots):
        if parent >= 0:
            # an article within an article is a reader's comment
            furniture = kinds[s][2] or kinds[s][0] == "article" and in_main[parent] and _inside(slots, kinds, parent, "article")
            kinds[s] = (kinds[s][0], kinds[s][1] and not furniture, furniture)
            in_main[s] = in_main[parent] or kinds[s][1]
            in_furniture[s] = in_furniture[parent] or furniture
        texts, repeated, share, linked = stats.get(s, (0, 0, 0, 0))
        repeats[s] = repeated / texts if texts else 0.0
        own[s] = (share - linked) * (1 - 0.9 * repeats[s]) * (prior if in_main[s] else 1) / (prior * prior if in_furniture[s] else 1)
    total = own[:]
    for s in range(n - 1, 0, -1):
        total[slots[s][0]] += total[s]
    children: list[list[int]] = [[] for _ in slots]
    for s in range(1, n):
        children[slots[s][0]].append(s)

    region, path = 0, [0]
    while children[region]:
        best = max(children[region], key=lambda c: (total[c], -c))
        leaves_main = kinds[region][1] and not kinds[best][1]
        if not total[best] or total[best] < total[region] * (1 - 0.5 / prior if leaves_main else 0.5) or kinds[best][0] in TEXTUAL:
            break
        region = best
        path.append(best)
    inside = [False] * n
    inside[region] = True
    for s in range(region + 1, n):
        inside[s] = inside[slots[s][0]]
    main = in_main[region]
    top = max((s for s in range(n) if inside[s]), key=lambda s: (own[s], -s))

    out = [NEUTRAL] * n
    for s in range(n):
        parent = slots[s][0]
        tag = kinds[s][0]
        _, _, share, linked = stats.get(s, (0, 0, 0, 0))
        dense = 2 * linked > share
        if inside[s]:
            small = kinds[s][2] and s != region and 2 * total[s] < total[region]
            if s != region and out[parent] == TEMPLATE:
                # the headings of a header within the region are content
                out[s] = CONTENT if tag in HEADINGS and kinds[parent][0] == "header" and _only_header(slots, kinds, parent, region) else TEMPLATE
            elif small or share and dense and (repeats[s] >= 0.5 or not main):
                out[s] = TEMPLATE
            elif share and s != top and repeats[s] >= 0.5 and stats[s][1] > 1 and repeats[top] < 0.5 and 2 * own[s] < total[region]:
                out[s] = TEMPLATE
            else:
                out[s] = CONTENT
        elif not main and tag in HEADINGS and parent in path and not in_furniture[s] and not dense and repeats[s] < 0.5:
            out[s] = CONTENT  # the heading of a region that has no element of its own for both
        elif in_furniture[s] or share and (dense or repeats[s] >= 0.5):
            out[s] = TEMPLATE
    return out


def _inside(slots, kinds, s: int, tag: str) -> bool:
    while s >= 0:
        if kinds[s][0] == tag:
            return True
        s = slots[s][0]
    return False


def _only_header(slots, kinds, s: int, region: int) -> bool:
    """Whether the header s is furniture by being a header only, and nothing around it up to the region is."""
    s = slots[s][0]
    while s != region:
        if kinds[s][2]:
            return False
        s = slots[s][0]
    return True


def host_of(url) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


PARSED = "page_id long, url string, host string, shape string, blocks array<struct<slot:int,text:string,share:int,linked:int,first:boolean>>"
_BLOCK = pa.struct([("slot", pa.int32()), ("text", pa.string()), ("share", pa.int32()), ("linked", pa.int32()), ("first", pa.bool_())])
#: Lengths are counted in parts of the page, so that a very long page weighs as much as any other.
WHOLE = 1_000_000


def _weighed(page: Page) -> list[dict]:
    known: set[tuple[int, str]] = set()
    whole = max(1, sum(len(b[1]) for b in page.blocks))
    out = []
    for slot, text, linked in page.blocks:
        first = (slot, text) not in known
        known.add((slot, text))
        out.append({"slot": slot, "text": text, "share": len(text) * WHOLE // whole, "linked": linked * WHOLE // whole, "first": first})
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shapes: dict[tuple, str] = {}
    for batch in batches:
        drawn, found = [], []
        for html in batch.column(3).to_pylist():
            page = Page(html or "")
            key = tuple(page.slots)
            if key not in shapes:
                if len(shapes) > 1000:
                    shapes.clear()
                shapes[key] = json.dumps(page.slots, separators=(",", ":"), ensure_ascii=False)
            drawn.append(shapes[key])
            found.append(_weighed(page))
        yield pa.record_batch(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(drawn, pa.string()), pa.array(found, pa.list_(_BLOCK))],
            names=["page_id", "url", "host", "shape", "blocks"],
        )


def parse_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, shape, blocks): the folded tree of each page as JSON, and all its text blocks."""
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_parse, PARSED)


def _unite_shapes(part: pd.DataFrame) -> pd.DataFrame:
    sys.setrecursionlimit(20_000)
    whole = Template()
    for n, shape in sorted(zip(part["n"].tolist(), part["shape"]), key=lambda r: (-r[0], r[1])):
        whole.add([tuple(s) for s in json.loads(shape)], n, n)
    return pd.DataFrame({"host": [part["host"].iloc[0]], "template": [whole.dump()]})


def _unite_templates(part: pd.DataFrame) -> pd.DataFrame:
    sys.setrecursionlimit(20_000)
    whole = Template()
    for pages, text in sorted((-json.loads(t)[2], t) for t in part["template"]):
        slots, seen, _ = json.loads(text)
        whole.add([tuple(s) for s in slots], seen, -pages)
    return pd.DataFrame({"host": [part["host"].iloc[0]], "template": [whole.dump()]})


def induce_templates(shapes: DataFrame) -> DataFrame:
    """(host, template) from (host, shape, n): the union of a host's distinct trees."""
    salted = shapes.withColumn("salt", F.pmod(F.xxhash64("shape"), F.lit(SALTS)))
    some = salted.groupBy("host", "salt").applyInPandas(_unite_shapes, "host string, template string")
    return some.groupBy("host").applyInPandas(_unite_templates, "host string, template string")


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, shape, template) -> (host, shape, place): the template slot of each slot of a tree."""
    sys.setrecursionlimit(20_000)
    held, template = None, Template()
    for batch in batches:
        places = []
        for shape, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if text != held:
                held, template = text, Template.load(text)
            places.append(template.align([tuple(s) for s in json.loads(shape)]))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(places, pa.list_(pa.int32()))], names=["host", "shape", "place"])


def _decide_host(stats: pd.DataFrame, template: pd.DataFrame) -> pd.DataFrame:
    """One host's slots (a few) and its template, which is there for every host; a host of empty pages has no slots."""
    tree, _, pages = json.loads(template["template"].iloc[0])
    slots = [tuple(s) for s in tree]
    columns = ("slot", "texts", "repeated", "share", "linked", "fixed")
    rows = list(zip(*(stats[c].tolist() for c in columns), stats["fixed_keys"]))
    kinds = decide(slots, {r[0]: r[1:5] for r in rows}, pages)
    fixed = [int(k) for r in rows if 2 * r[5] < r[3] for k in r[6]]  # in slots whose texts mostly vary
    return pd.DataFrame({"host": [template["host"].iloc[0]], "kinds": [kinds], "fixed": [fixed]})


def learn_hosts(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, shape, place) and (host, kinds, fixed): where each tree lies in its host's template, and what its slots are."""
    shapes = materialize(parsed.groupBy("host", "shape").agg(F.count("*").alias("n")), "shapes")
    templates = materialize(induce_templates(shapes), "templates")
    met = shapes.select("host", "shape").join(templates, "host").select("host", "shape", "template")
    places = materialize(met.mapInArrow(_align, "host string, shape string, place array<int>"), "places")
    spots = parsed.select("host", "shape", F.explode("blocks").alias("b")).join(places, ["host", "shape"])
    slot = F.col("place")[F.col("b.slot")]
    spots = spots.select("host", slot.alias("slot"), F.xxhash64(slot, "b.text").alias("key"), "b.share", "b.linked", "b.first")
    texts = spots.groupBy("host", "slot", "key").agg(
        F.sum(F.col("first").cast("int")).alias("pages"), F.sum("share").alias("share"), F.sum("linked").alias("linked")
    )
    size = shapes.groupBy("host").agg(F.greatest(F.lit(LEAST), F.sum("n") * SHARE).alias("least"))
    fixed = F.col("pages") >= F.col("least")
    stats = texts.join(size, "host").groupBy("host", "slot").agg(
        F.count("*").alias("texts"),
        F.sum((F.col("pages") > 1).cast("long")).alias("repeated"),
        F.sum("share").alias("share"),
        F.sum("linked").alias("linked"),
        F.sum(F.when(fixed, F.col("share")).otherwise(0)).alias("fixed"),
        F.collect_list(F.when(fixed, F.col("key"))).alias("fixed_keys"),  # each is on half of the pages: as many as two pages' blocks
    )
    schema = "host string, kinds array<int>, fixed array<long>"
    decided = stats.groupBy("host").cogroup(templates.groupBy("host")).applyInPandas(_decide_host, schema)
    return places, materialize(decided, "decided")


def extract_text(pages: DataFrame, with_template: bool = True) -> DataFrame:
    """(page_id, url, text) for every page: blocks of the main text joined by blank lines.

    Without ``with_template`` every shown block is taken, which is what is left when nothing is induced.
    """
    parsed = materialize(parse_pages(pages), "parsed")
    if not with_template:
        return parsed.select("page_id", "url", F.array_join("blocks.text", "\n\n").alias("text"))
    places, decided = learn_hosts(parsed)
    met = parsed.join(places, ["host", "shape"]).join(decided, "host")

    def of_kind(kind: int) -> Column:
        return F.filter("blocks", lambda b: F.col("kinds")[F.col("place")[b["slot"]]] == kind)

    def varying(blocks: Column) -> Column:
        return F.filter(blocks, lambda b: ~F.array_contains("fixed", F.xxhash64(F.col("place")[b["slot"]], b["text"])))

    met = met.select("page_id", "url", "place", "fixed", of_kind(CONTENT).alias("content"), of_kind(NEUTRAL).alias("neutral"))
    met = met.withColumn("found", F.when(F.size("content") > 0, F.col("content")).otherwise(F.col("neutral")))
    met = met.withColumn("left", F.when(F.size("fixed") > 0, varying(F.col("found"))).otherwise(F.col("found")))
    text = F.when(F.size("left") > 0, F.col("left.text")).otherwise(F.col("found.text"))
    return met.select("page_id", "url", F.array_join(text, "\n\n").alias("text"))


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
