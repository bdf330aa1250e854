"""HTML extraction by wrapper induction.

A page becomes a DOM tree of labelled nodes (tag, with the class and id words of containers), in which
flow elements of one label and parent, and adjacent containers of one label and make, are folded into one.
Pages of one host that have the same folded tree share a skeleton, and for each of its nodes it is known
whether its own text is the same on all of them. The skeletons of a host are aligned by simple tree matching
into one wrapper: aligned nodes whose text stays constant over pages are template, whatever their tag, the
others are varying slots. The content is where the varying text is: from the root down, the region goes to the
child that holds most of it, until text stands beside it or no child has a majority. Parts that by their tag,
role or class are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments are
never content; article and main (or such a role or class) only settle what the varying text leaves open.

Every page takes part in its host's wrapper. Skeletons are summed within tasks, then for each host and
skeleton. Wrappers grow as a tree: groups of at most about `FAN` of a host's skeletons are merged, then groups of
what these gave, until a host has one; so no host is one task. Each skeleton is then laid along its host's
wrapper. The rules that follow (a digest of the skeleton and its content nodes) reach the pages in one broadcast
up to `MAX_RULES` bytes of them, and by a join beyond.

Defined results: null or empty html gives the empty text; a page without an article, main or other content
region gives the text of its body outside those parts; unclosed and stray tags are mended as browsers
do; a host with one page has nothing to compare, so only tags, roles and classes decide; pages of any
length are read whole; an url without a host is a host of its own; repeated rows count each; an empty
table gives an empty table; an input column named as an output column (or `_host`, `_skeleton`, `_kept`) is
replaced, all others pass. Of regions with equally much varying text the first on the page is taken; where
nothing varies on a host, all its text counts and none is template; a tag with an unclosed quote ends at its
first `>`.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.common import add_columns, map_arrow, map_slices, materialise, texts_of

#: Bytes of rules that are sent to the executors at most; skeletons or wrappers that are merged at a time.
MAX_RULES, FAN = 32 << 20, 64
#: Elements nested deeper than this stand beside each other, as browsers put them.
DEEPEST = 200
#: Pages on which a node's text must be the same to count as template; share of a region's varying text that a
#: child must hold for the content to lie in it.
CONSTANT_PAGES, MAJORITY = 3, 0.5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(script|style|noscript|template|svg|math|iframe|textarea|select)\b[^>]*>.*?(?:</\1\s*>|\Z)|</?[a-zA-Z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|</?[a-zA-Z][^<>]*>|[^<]+|<", re.S | re.I)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")
#: Elements that start a block of text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new one of the key closes, up to the nearest element of the second set.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
#: Never content, by tag or role.
BARRED_TAGS = frozenset("nav header footer aside form script style noscript template head title button select option textarea input label dialog menu iframe svg math object canvas".split())
BARRED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: Never content, by a word of the class or id of an element that holds blocks.
BARRED_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side nav navbar navigation menu menubar breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments respond reply replies disqus share sharing social related recommended recommendations widget toolbar pagination pager skip copyright legal tags".split())
CONTENT_TAGS, CONTENT_WORDS = frozenset(["article", "main"]), frozenset("article content main post entry story body".split())


@dataclass
class Node:
    label: str
    tag: str
    barred: bool
    wanted: bool
    parts: list = field(default_factory=list)  # child nodes, and strings of the node's own text
    block: bool = True


def _node(tag: str, source: str) -> Node:
    words, role = [], ""
    if "=" in source:
        for name, *values in _ATTRIBUTE.findall(source):
            value = next((v for v in values if v), "").lower()
            if name.lower() == "role":
                role = value
            else:
                words += [w for w in _SPLIT.split(value) if w]
    block = tag in BLOCKS
    barred = tag in BARRED_TAGS or role in BARRED_ROLES or (tag not in CONTENT_TAGS and tag not in ("html", "body") and not BARRED_WORDS.isdisjoint(words) and (block or tag in ("span", "a")))
    wanted = tag in CONTENT_TAGS or role in ("main", "article") or (block and not CONTENT_WORDS.isdisjoint(words))
    label = f"{tag}.{'.'.join(sorted(set(words)))}" if words and block else tag
    return Node(label, tag, barred, wanted, [], block)


def parse(source: str) -> Node:
    """The DOM tree of a page, mended where tags are missing."""
    root = Node("#", "#", False, False)
    stack = [root]
    for found in _TOKEN.finditer(source):
        token = found.group()
        if token[0] != "<" or len(token) == 1:
            stack[-1].parts.append(token)
            continue
        if found.group(1) or token[1] in "!?":
            continue
        tag = _NAME.match(token).group(1).lower()
        if token[1] == "/":
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if tag == "p" and stack[depth].tag in BLOCKS and stack[depth].tag != "p":
                    break
                if tag not in BLOCKS and stack[depth].block:
                    break
            continue
        if tag in VOID:
            stack[-1].parts.append(Node("hr", tag, False, False) if tag == "hr" else "\n" if tag == "br" else "")
            continue
        if tag in BLOCKS:
            for depth in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[depth].tag == "p":
                    del stack[depth:]
                    break
                if stack[depth].block:
                    break
        if tag in CLOSES:
            own, bound = CLOSES[tag]
            first = None
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in bound:
                    break
                if stack[depth].tag in own:
                    first = depth
            if first is not None:
                del stack[first:]
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            continue
        node = _node(tag, token)
        stack[-1].parts.append(node)
        if (not token.endswith("/>") or tag in BLOCKS) and len(stack) < DEEPEST:
            stack.append(node)
    return root


def inline_text(node: Node) -> list[str]:
    """The strings of a block and its inline elements; a child block is a break (None)."""
    out: list = []
    for part in node.parts:
        if isinstance(part, str):
            out.append(part)
        elif part.block:
            out.append(None)
            out.append(part)
        elif not part.barred:
            out += inline_text(part)
    return out


def blocks_of(node: Node) -> list:
    """A block's content in page order: strings of text and child blocks."""
    out, run = [], []
    for part in inline_text(node):
        if isinstance(part, str):
            run.append(part)
        elif part is not None:
            out.append("".join(run)), out.append(part)
            run = []
    out.append("".join(run))
    return [x for x in out if not isinstance(x, str) or x.strip()]


def tidy(text: str) -> str:
    return " ".join((entities.unescape(text) if "&" in text else text).split())


_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption caption".split())


class Page:
    """A parsed page: its skeleton, and each text with the number of its node there (in order)."""

    def __init__(self, source: str):
        self.texts: list[tuple[int, str]] = []
        self.nodes: list[tuple[str, int]] = []  # of the skeleton, in preorder: marked label, parent
        self._index: dict[tuple, int] = {}
        self._visit(parse(source), -1, 0)
        self.skeleton = "\n".join(f"{label}\t{parent}" for label, parent in self.nodes)

    def _visit(self, node: Node, above: int, run: int) -> None:
        """Adds a node and what is in it. run: which run of equal containers under its parent it belongs to."""
        parts = blocks_of(node)
        make = None if node.tag in _FLOW else tuple(sorted({x.tag for x in parts if not isinstance(x, str)}))
        key = (above, node.label, make, 0 if node.tag in _FLOW else run)
        own = self._index.get(key)
        if own is None:
            own = self._index[key] = len(self.nodes)
            self.nodes.append((("-" if node.barred else "+" if node.wanted else "=") + node.label, above))
        elif not self.nodes[own][0].endswith("*"):
            self.nodes[own] = (self.nodes[own][0] + "*", above)
        before, run = None, 0
        for part in parts:
            if isinstance(part, str):
                if text := tidy(part):
                    self.texts.append((own, text))
                continue
            if part.tag not in _FLOW:
                like = (part.label, tuple(sorted({x.tag for x in part.parts if not isinstance(x, str) and x.block})))
                run += before is not None and like != before
                before = like
            self._visit(part, own, run)


def digest(skeleton: str) -> bytes:
    return hashlib.blake2b(skeleton.encode(), digest_size=16).digest()


def host_of(url: str) -> str:
    found = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", url or "")
    return found.group(1).rpartition("@")[2].lower() if found else url or ""


# ---- wrappers: what a host's skeletons say together


@dataclass
class Slot:
    """A node of a wrapper, or of a skeleton as a wrapper of its own. text: its constant text's hash, or None if it
    varies; chars: its characters, constant or not; at: its number in the skeleton; kept: whether it is content."""

    label: str
    children: list
    pages: int
    text: int | None
    chars: float
    at: int = -1
    kept: bool = False

    def packed(self) -> list:
        return [self.label, self.pages, self.text, self.chars, int(self.kept), [c.packed() for c in self.children]]

    @staticmethod
    def unpacked(x: list) -> Slot:
        return Slot(x[0], [Slot.unpacked(c) for c in x[5]], x[1], x[2], x[3], -1, bool(x[4]))


def tree_of(skeleton: str, pages: int, texts: list, chars: list) -> Slot:
    slots = []
    for k, (line, text, n) in enumerate(zip(skeleton.split("\n"), texts, chars, strict=True)):
        label, _, parent = line.rpartition("\t")
        slots.append(Slot(label.rstrip("*"), [], pages, text, n, k))
        if int(parent) >= 0:
            slots[int(parent)].children.append(slots[k])
    return slots[0]


def matching(a: Slot, b: Slot, memory: dict) -> int:
    """Simple tree matching: the most node pairs with equal labels that keep parents and order."""
    if a.label != b.label:
        return 0
    key = (id(a), id(b))
    if key not in memory:
        memory[key] = 1 + _table(a.children, b.children, memory)[-1][-1]
    return memory[key]


def _table(left: list[Slot], right: list[Slot], memory: dict) -> list[list[int]]:
    m = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, x in enumerate(left, 1):
        for j, y in enumerate(right, 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + matching(x, y, memory))
    return m


def pairs(left: list[Slot], right: list[Slot], memory: dict) -> list[tuple[Slot | None, Slot | None]]:
    """Two lists of children along a largest matching, in order; a child without a partner stands alone."""
    m = _table(left, right, memory)
    i, j, out = len(left), len(right), []
    while i or j:
        if i and m[i][j] == m[i - 1][j]:
            i -= 1
            out.append((left[i], None))
        elif j and m[i][j] == m[i][j - 1]:
            j -= 1
            out.append((None, right[j]))
        else:
            i, j = i - 1, j - 1
            out.append((left[i], right[j]))
    return out[::-1]


def align(wrapper: Slot, other: Slot, memory: dict) -> None:
    """Merges a tree into the wrapper; nodes without a partner are added in place."""
    wrapper.text = wrapper.text if wrapper.text == other.text else None
    wrapper.pages += other.pages
    wrapper.chars += other.chars
    merged = []
    for a, b in pairs(wrapper.children, other.children, memory):
        if a is not None and b is not None:
            align(a, b, memory)
        merged.append(b if a is None else a)
    wrapper.children = merged


def merge(trees: list[Slot]) -> Slot:
    wrapper = trees[0]
    for tree in trees[1:]:
        align(wrapper, tree, {})
    return wrapper


def _name(slot: Slot) -> str:
    return slot.label[1:].split(".")[0]


def decide(wrapper: Slot) -> None:
    """Marks the wrapper's content nodes."""
    weight: dict[int, float] = {}

    def weigh(slot: Slot, barred: bool, constant: bool) -> float:
        off = barred or slot.label[0] == "-"
        varies = constant or slot.text is None or slot.pages < CONSTANT_PAGES
        total = slot.chars if varies and not off else 0.0
        total += sum(weigh(c, off, constant) for c in slot.children)
        weight[id(slot)] = total
        return total

    nothing_varies = not weigh(wrapper, False, False)
    if nothing_varies:  # all text counts
        weigh(wrapper, False, True)

    def marked(slot: Slot) -> list[Slot]:
        if slot.label[0] == "-":
            return []
        if slot.label[0] == "+" and weight[id(slot)] > 0:
            return [slot]
        return [x for c in slot.children for x in marked(c)]

    at, regions = wrapper, []
    while not regions:
        inside = [c for c in at.children if c.label[0] != "-" and weight[id(c)] > 0]
        boxes = [c for c in inside if _name(c) not in _FLOW]
        best = max(boxes, key=lambda c: weight[id(c)], default=None)
        beside = len(boxes) < len(inside)  # varying text of its own: this is where the content stands
        if best is None or beside or at.label[0] == "+" and best.label[0] != "+":
            regions = [at]
        elif weight[id(best)] >= MAJORITY * weight[id(at)]:
            at = best
        else:  # open: tags settle it
            found = marked(at)
            found = [r for r in found if _name(r) in CONTENT_TAGS] or found
            most = max((weight[id(r)] for r in found), default=0.0)
            regions = [r for r in found if weight[id(r)] >= 0.5 * most] or [at]

    def take(slot: Slot, top: bool) -> None:
        if slot.label[0] == "-" and _name(slot) != "header":  # an article's own header holds its title
            return
        slot.kept = nothing_varies or top or slot.text is None or slot.pages < CONSTANT_PAGES
        for c in slot.children:
            take(c, False)

    for region in regions:
        take(region, True)


def laid(wrapper: Slot, tree: Slot) -> set[int]:
    """The content nodes of a skeleton that is laid along its host's wrapper."""
    kept: set[int] = set()

    def along(w: Slot | None, t: Slot, content: bool, memory: dict) -> None:
        content = content and t.label[0] != "-" if w is None else w.kept
        if content:
            kept.add(t.at)
        for a, b in pairs(w.children if w else [], t.children, memory):
            if b is not None:
                along(a, b, content, memory)

    along(wrapper, tree, False, {})
    return kept


def induce(skeletons: list[tuple[str, int, list, list]]) -> list[set[int]]:
    """One host's skeletons (text, pages, constant text hashes, mean characters), most frequent first ->
    each skeleton's content nodes."""
    wrapper = merge([tree_of(*x) for x in skeletons])
    decide(wrapper)
    return [laid(wrapper, tree_of(*x)) for x in skeletons]


# ---- Spark

_PART = T.StructType([
    T.StructField("host", T.StringType()),
    T.StructField("skeleton", T.StringType()),
    T.StructField("pages", T.LongType()),
    T.StructField("texts", T.ArrayType(T.LongType())),
    T.StructField("chars", T.ArrayType(T.DoubleType())),
])
_RULE = T.StructType([T.StructField("host", T.StringType()), T.StructField("skeleton", T.BinaryType()), T.StructField("kept", T.ArrayType(T.IntegerType()))])


def _merge(into: list, pages: int, texts: list, chars: list) -> None:
    into[1] += pages
    into[2] = [a if a == b else None for a, b in zip(into[2], texts, strict=True)]
    into[3] = [a + b for a, b in zip(into[3], chars, strict=True)]


def _hash(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode()) >> 1


def summed_skeletons(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(host, skeleton): how many pages, each node's text hash if it is the same on all, and its characters."""

    def run(batches):
        held: dict[tuple[str, str], list] = {}

        def out():
            keys = sorted(held)
            rows = [held[k] for k in keys]
            yield pa.RecordBatch.from_pydict({"host": [k[0] for k in keys], "skeleton": [k[1] for k in keys], "pages": [r[1] for r in rows], "texts": [r[2] for r in rows], "chars": [r[3] for r in rows]}, schema=_ARROW_PART)
            held.clear()

        for batch in batches:
            for u, h in zip(texts_of(batch, url), texts_of(batch, html), strict=True):
                page = Page(h)
                n = len(page.nodes)
                own: list[list[str]] = [[] for _ in range(n)]
                for k, x in page.texts:
                    own[k].append(x)
                texts, chars = [_hash("\n".join(x)) for x in own], [float(sum(map(len, x))) for x in own]
                key = (host_of(u), page.skeleton)
                if key in held:
                    _merge(held[key], 1, texts, chars)
                else:
                    held[key] = [key, 1, texts, chars]
            if len(held) > 20_000:
                yield from out()
        if held:
            yield from out()

    parts = map_arrow(pages.select(url, html), run, _PART)

    def merged(group: pa.Table) -> pa.Table:
        total: list | None = None
        for batch in group.select(["pages", "texts", "chars"]).to_batches(max_chunksize=1024):
            for r in batch.to_pylist():
                if total is None:
                    total = [None, r["pages"], r["texts"], r["chars"]]
                else:
                    _merge(total, r["pages"], r["texts"], r["chars"])
        return pa.Table.from_pydict({"host": group["host"][:1].to_pylist(), "skeleton": group["skeleton"][:1].to_pylist(), "pages": [total[1]], "texts": [total[2]], "chars": [total[3]]}, schema=_ARROW_PART)

    return parts.groupBy("host", "skeleton").applyInArrow(merged, _PART)


_ARROW_PART = pa.schema([("host", pa.string()), ("skeleton", pa.string()), ("pages", pa.int64()), ("texts", pa.list_(pa.int64())), ("chars", pa.list_(pa.float64()))])
_TREE = T.StructType([T.StructField("host", T.StringType()), T.StructField("tree", T.StringType())])
_ARROW_TREE = pa.schema([("host", pa.string()), ("tree", pa.string())])


def wrappers(skeletons: DataFrame, fan: int = FAN) -> DataFrame:
    """(host, skeleton, ...) -> (host, tree): each host's wrapper, merged as a tree of groups of about `fan`."""

    def planted(batch: pa.RecordBatch) -> pa.RecordBatch:
        trees = [json.dumps(tree_of(r["skeleton"], r["pages"], r["texts"], r["chars"]).packed()) for r in batch.to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("host")), pa.array(trees, pa.string())], names=_TREE.names)

    def merged(group: pa.Table) -> pa.Table:
        trees = sorted((Slot.unpacked(json.loads(x)) for x in group["tree"].to_pylist()), key=lambda t: (-t.pages, json.dumps(t.packed())))
        return pa.Table.from_pydict({"host": group["host"][:1].to_pylist(), "tree": [json.dumps(merge(trees).packed())]}, schema=_ARROW_TREE)

    now = map_slices(skeletons, _TREE, lambda: planted)
    left, level = skeletons.groupBy("host").agg(F.count("*").alias("_n")), 0
    while True:
        groups = left.select("host", F.ceil(F.col("_n") / fan).alias("_n"))
        most = left.agg(F.max("_n")).first()[0] or 1
        salted = now.join(groups, "host").withColumn("_group", F.pmod(F.xxhash64("tree", F.lit(level)), F.col("_n")))
        now = materialise(salted.groupBy("host", "_group").applyInArrow(merged, _TREE), "wrappers")
        if most <= fan:
            return now
        left, level = now.groupBy("host").agg(F.count("*").alias("_n")), level + 1


def rules(pages: DataFrame, url: str = "url", html: str = "html", fan: int = FAN) -> DataFrame:
    """(host, digest of a skeleton) -> the skeleton's content nodes, from the wrapper of the host."""
    skeletons = materialise(summed_skeletons(pages, url, html), "skeletons")
    joined = skeletons.join(wrappers(skeletons, fan), "host")

    def start():
        held: dict[str, Slot] = {}

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for r in batch.to_pylist():
                if r["host"] not in held:
                    held.clear()
                    wrapper = held[r["host"]] = Slot.unpacked(json.loads(r["tree"]))
                    decide(wrapper)
                out.append(sorted(laid(held[r["host"]], tree_of(r["skeleton"], r["pages"], r["texts"], r["chars"]))))
            skeleton = batch.column(batch.schema.get_field_index("skeleton")).to_pylist()
            return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("host")), pa.array(map(digest, skeleton), pa.binary()), pa.array(out, pa.list_(pa.int32()))], names=_RULE.names)

        return one

    return map_slices(joined, _RULE, start)


def extract(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text", max_rules: int = MAX_RULES) -> DataFrame:
    """Adds the main text of each page."""
    found = materialise(rules(pages, url, html), "wrapper-rules")
    added = [T.StructField(out, T.StringType())]
    size = found.agg(F.sum(F.octet_length("host") + 100 + 4 * F.size("kept"))).first()[0] or 0
    if size <= max_rules:
        sent = pages.sparkSession.sparkContext.broadcast({(r[0], r[1]): frozenset(r[2]) for r in found.toLocalIterator()})

        def start():
            known = sent.value
            return lambda batch: [pa.array([_text_by(Page(h), host_of(u), known) for u, h in zip(texts_of(batch, url), texts_of(batch, html), strict=True)], pa.string())]

        return add_columns(pages, added, start)
    keyed = add_columns(pages, [T.StructField("_host", T.StringType()), T.StructField("_skeleton", T.BinaryType())], _keys(url, html))
    joined = keyed.join(found.toDF("_host", "_skeleton", "_kept"), ["_host", "_skeleton"], "left").drop("_host", "_skeleton")

    def start_joined():
        def one(batch: pa.RecordBatch) -> list[pa.Array]:
            kept = batch.column(batch.schema.get_field_index("_kept")).to_pylist()
            return [pa.array([_text(Page(h), frozenset(k or ())) for h, k in zip(texts_of(batch, html), kept, strict=True)], pa.string())]

        return one

    return add_columns(joined, added, start_joined).drop("_kept")


def _keys(url: str, html: str):
    def start():
        return lambda batch: [pa.array([host_of(u) for u in texts_of(batch, url)], pa.string()), pa.array([digest(Page(h).skeleton) for h in texts_of(batch, html)], pa.binary())]

    return start


def _text(page: Page, kept: frozenset[int]) -> str:
    return " ".join(x for k, x in page.texts if k in kept)


def _text_by(page: Page, host: str, known: dict) -> str:
    return _text(page, known[host, digest(page.skeleton)])
