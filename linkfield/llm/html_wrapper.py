"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page's tags form a tree.  A wrapper is a tree of labels whose children are a sequence of required, optional and
repeated parts with text slots.  Two wrappers are aligned part by part: what only one of them has becomes optional,
equal neighbours become a repeated group, and a text that differs turns from a constant into a slot.  Tasks align
the pages they see, and the results are aligned again, host by host.  The wrapper of a host then tells which of its
paths hold the article, and every page is read along those paths.  Its slots are read, its constants aren't: a part of
the template is a block of text that stands in the same slot on enough of the host's pages, where at least half of the
pages with that slot agree on it.  In a slot with text of its own on most pages (an article's paragraphs) a sentence
that repeats is content.  A page is a distinct HTML of a host, and blocks are counted exactly, by hashes of slot and
whole text; a slot is an element with its names below its ancestors' tags.
"""

from __future__ import annotations

import functools
import html as html_lib
import json
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BROADCAST_BYTES, written
from .url_filter import host_and_path

#: Levels of tags that wrappers tell apart, parts of a sequence before classes are ignored, hosts that a task gathers
#: before it passes them on, parts in which a host's wrappers are aligned first.
DEPTH, PARTS, HOSTS, SALTS = 300, 48, 2000, 16
sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEPTH))  # wrappers are read and aligned level by level

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)

#: A block is constant if this many pages of a host have it, this share of them and this share of those with its slot,
#: unless the slot's frequent texts take turns (together they are on no more than this many times the slot's pages); a
#: page whose blocks are constant to more than this share (headings aside) is a copy of others and stays whole.
CONSTANT_PAGES, CONSTANT_SHARE, SLOT_SHARE, TURNS, COPY = 3, 0.1, 0.5, 1.1, 0.8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
MEDIA = frozenset("svg iframe video audio select".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"br", "html", "head", "body"}
ITEMS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}

NEVER_ARTICLE = frozenset("nav footer aside menu button head".split())
NOT_ARTICLE = NEVER_ARTICLE | MEDIA | {"form", "dialog"}
NOT_ARTICLE_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo banner cookie cookies consent gdpr notice popup modal overlay alert sidebar side aside nav navbar navigation menu breadcrumb breadcrumbs"
    " footer header masthead topbar toolbar comment comments commentlist respond reply replies disqus discussion share sharing social related recommended newsletter subscribe signup login search searchbox widget pagination pager"
    " contentinfo complementary skip tags copyright".split()
)
#: Names of these are never taken for the article, however much text they have.
FOREIGN_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored cookie cookies consent gdpr nav navbar navigation menu breadcrumb breadcrumbs comment comments commentlist respond reply replies disqus discussion"
    " share sharing social related recommended newsletter subscribe signup pagination pager copyright footer".split()
)
#: What may stand beside those words in one name; any other word makes it another name (has-sidebar, category-social).
PLACES = frozenset("left right top bottom upper lower inner outer main site page global primary secondary box area wrapper wrap container list section block bar slot unit links link post entry article blog".split())
ARTICLE_NAME = re.compile(r"(?:^|[-_\s])(?:article|story|post|entry|content|main|body|text|prose)(?:$|[-_\s])", re.I)


class Node:
    __slots__ = ("tag", "label", "name", "children")

    def __init__(self, tag: str, name: str = ""):
        self.tag, self.name = tag, name
        self.label = f"{tag}.{re.sub(r'[0-9]+', '0', name)}" if name else tag
        self.children: list[Node | str] = []


def parse(page: str) -> Node:
    """The page's tree; markup that isn't closed, or closed twice, is read as browsers do for the common cases."""
    root = Node("#")
    stack, at = [root], 0
    opened: Counter[str] = Counter()
    last: dict[str, int] = {}

    def ends_after(tag: str, start: int) -> bool:
        """Whether an end tag comes; one that never does leaves what follows to be read."""
        if tag not in last:
            last[tag] = max((e.start() for e in re.finditer(rf"</{tag}[\s>/]", page, re.I)), default=-1)
        return last[tag] >= start

    def close(tag: str, unless: tuple = ()) -> None:
        for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
            if stack[k].tag == tag:
                opened.subtract(x.tag for x in stack[k:])
                del stack[k:]
                return
            if stack[k].tag in unless:
                return

    while m := TOKEN.search(page, at):
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" or tag in ITEMS or tag not in VOID:
                close(tag, ("article", "main", "section", "body") if tag in ("p", "b", "i", "a", "span", "em", "strong") else ())
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/") and ends_after(tag, m.end()):  # what is inside isn't markup
                at = re.compile(rf"</{tag}(?=[\s>/])[^>]*>?", re.I).search(page, m.end()).end()
            continue
        if tag in MEDIA and not ends_after(tag, m.end()):
            continue
        if tag in CLOSES_P:
            close("p", ("table", "td", "li", "div", "section", "article", "blockquote", "main", "aside"))
        if tag in ITEMS:
            for x in ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,):
                close(x, ITEMS[tag])
        name = " ".join(" ".join(v for _, *vs in ATTRIBUTE.findall(m[3]) for v in vs if v).split()) if m[3] else ""
        node = Node(tag, name)
        stack[-1].children.append(node)
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
            opened[tag] += 1
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


# A wrapper: [label, tag, is it in the article's way (0 or 1), pages, characters of text here, of link text below,
#             hash of a constant text (0 without any) or None for a slot, optional, repeated, parts]
LABEL, TAG, OUT, PAGES, CHARS, LINKED, TEXT, OPTIONAL, REPEATED, KIDS = range(10)


@functools.lru_cache(100_000)
def set_apart(names: str) -> bool:
    """Whether one of the names is made of words for what isn't an article, numbers and places alone."""
    for name in names.lower().split():
        words = {w for w in re.split(r"[-_0-9]+", name) if w}
        if words & NOT_ARTICLE_WORDS and words <= NOT_ARTICLE_WORDS | PLACES:
            return True
    return False


def outside(node: Node) -> bool:
    """Whether a node's tag or names say that it isn't part of an article."""
    return node.tag in NOT_ARTICLE or (node.tag not in ("html", "body", "article", "main") and bool(node.name) and set_apart(node.name)) or (node.tag == "article" and bool(node.name) and "comment" in node.name.lower())


def pattern(node: Node, in_link: bool = False, level: int = 0) -> list:
    """A page's wrapper; below DEPTH levels the text counts, but parts aren't told apart."""
    in_link = in_link or node.tag == "a"
    text = " ".join(" ".join(x.split()) for x in node.children if isinstance(x, str)).strip()
    chars, linked, kids = len(text), len(text) if in_link else 0, []
    if level < DEPTH:
        kids = [pattern(x, in_link, level + 1) for x in node.children if isinstance(x, Node) and x.tag != "br"]
    else:
        below = [(x, in_link) for x in node.children if isinstance(x, Node)]
        while below:
            x, link = below.pop()
            link = link or x.tag == "a"
            if not outside(x):
                n = sum(len(" ".join(c.split())) for c in x.children if isinstance(c, str))
                chars, linked = chars + n, linked + n * link
                below += [(c, link) for c in x.children if isinstance(c, Node)]
    out = [node.label, node.tag, int(outside(node)), 1, chars, linked, digest(text) if text else 0, 0, 0, folded(kids)]
    out[LINKED] += sum(k[LINKED] for k in out[KIDS])
    return out


def folded(parts: list) -> list:
    """Neighbouring groups of one to three parts that repeat become one repeated group."""
    for size in (1, 2, 3):
        out: list = []
        for p in parts:
            out.append(p)
            a, b = out[-2 * size : -size], out[-size:]
            if len(a) == size and [x[LABEL] for x in a] == [x[LABEL] for x in b]:
                out[-2 * size :] = [aligned(x, y, same_page=True) for x, y in zip(a, b, strict=True)]
                for x in out[-size:]:
                    x[REPEATED] = 1
        parts = out
    return parts


def aligned(x: list, y: list, same_page: bool = False) -> list:
    """The wrapper of two wrappers with one label."""
    text = x[TEXT] if x[TEXT] == y[TEXT] else None
    pages = max(x[PAGES], y[PAGES]) if same_page else x[PAGES] + y[PAGES]
    return [x[LABEL], x[TAG], x[OUT] | y[OUT], pages, x[CHARS] + y[CHARS], x[LINKED] + y[LINKED], text, x[OPTIONAL] | y[OPTIONAL], x[REPEATED] | y[REPEATED], sequence(x[KIDS], y[KIDS], same_page)]


def sequence(xs: list, ys: list, same_page: bool) -> list:
    """Two sequences of parts along their longest common subsequence of labels; the rest is optional."""
    if [x[LABEL] for x in xs] == [y[LABEL] for y in ys]:
        return [aligned(x, y, same_page) for x, y in zip(xs, ys, strict=True)]
    if any(x[LABEL] == any_name(x[TAG], x[OUT]) for x in (*xs, *ys)):
        return collapsed([*xs, *ys], same_page)
    n, m = len(xs), len(ys)
    if max(n, m) > PARTS:  # the alignment would be as long, so collapse right away: linear in the siblings
        return collapsed([*collapsed(xs, True), *collapsed(ys, True)], same_page)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if xs[i][LABEL] == ys[j][LABEL] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and xs[i][LABEL] == ys[j][LABEL]:
            out.append(aligned(xs[i], ys[j], same_page))
            i, j = i + 1, j + 1
            continue
        if j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            part, i = xs[i], i + 1
        else:
            part, j = ys[j], j + 1
        part = list(part)
        part[OPTIONAL] = 1
        out.append(part)
    out = folded(out)
    return collapsed(out, same_page) if len(out) > PARTS else out


def any_name(tag: str, out: int) -> str:
    """The label of a collapsed part."""
    return f"{tag}.!" if out else f"{tag}.*"


def collapsed(parts: list, same_page: bool) -> list:
    """Parts whose names change from page to page, told apart by tag and by whether they are set apart."""
    by_label: dict[str, list] = {}
    for p in parts:
        label = any_name(p[TAG], p[OUT])
        p = [label, *p[1:]]
        by_label[label] = aligned(by_label[label], p, same_page) if label in by_label else p
        by_label[label][OPTIONAL] = by_label[label][REPEATED] = 1
    return list(by_label.values())


def mass(part: list, every: bool = False) -> int:
    """Characters that aren't linked, without what is set apart (with it, if every)."""
    if part[OUT] and not every:
        return 0
    return part[CHARS] - part[LINKED] + sum(k[LINKED] + mass(k, every) for k in part[KIDS])


def linked(part: list) -> int:
    return 0 if part[OUT] else part[LINKED] - sum(k[LINKED] - linked(k) for k in part[KIDS])


def foreign(part: list) -> bool:
    """Whether names say that a part belongs to the page's readers, sellers or other pages."""
    return part[TAG] in NEVER_ARTICLE | MEDIA or any({w for w in re.split(r"[-_0-9.]+", name) if w} & FOREIGN_WORDS for name in part[LABEL].lower().split())


def has_article_slot(part: list) -> bool:
    """Whether a part has a heading or paragraph whose text changes from page to page (or of a single page), that no page
    lacks, and that isn't one of a list of teasers: repeated groups that aren't paragraphs themselves."""
    below = list(part[KIDS])
    while below:
        k = below.pop()
        prose = k[TAG] == "p" or k[TAG] in HEADINGS
        if prose and not k[OPTIONAL] and (k[TEXT] is None or k[PAGES] == 1 and k[TEXT]):
            return True
        if not (k[OUT] and foreign(k)) and not k[OPTIONAL] and (prose or not k[REPEATED]):
            below += k[KIDS]
    return False


def release(part: list, path: str, held: list[str]) -> None:
    """Takes parts back that names, form or dialog set apart but that have more than half of the part's text: those with
    slots of an article, or where there is no other text at all; never what is foreign."""
    total = mass(part, True)
    while 2 * mass(part) < total:
        alone = mass(part) == 0
        heavy = [k for k in part[KIDS] if 2 * mass(k, True) > total and not foreign(k) and (not k[OUT] or alone or has_article_slot(k))]
        if not heavy:
            return
        part, path = heavy[0], f"{path}/{heavy[0][LABEL]}"
        if part[OUT]:
            part[OUT] = 0
            held.append(path)


def article_and_held(wrapper: list) -> tuple[list[str], list[str]]:
    """The paths of labels that hold a host's article, and paths that tags or names set apart though they hold it or
    most of the text.

    Article or main elements where there are any (set apart only if there are no others, and with half of the text),
    else the deepest part that still has four fifths of the text that isn't linked or set apart, and along the way to
    it all parts with text that isn't mostly links.  Changes wrapper.
    """
    found: list[tuple[str, list, list]] = []

    def seek(part: list, path: str, tags: tuple, above: list, every: bool) -> None:
        if part[OUT] and not every:
            return
        above = [*above, (path, part)] if part[OUT] else above
        if part[TAG] in tags and not (part[OUT] and part[TAG] == "article"):
            found.append((path, part, above))
            return
        for k in part[KIDS]:
            seek(k, f"{path}/{k[LABEL]}", tags, above, every)

    held: list[str] = []
    for every in (False, True):
        for tags in (("article",), ("main",)):
            found.clear()
            seek(wrapper, wrapper[LABEL], tags, [], every)
            if not found or every and 2 * sum(mass(p, True) for _, p, _ in found) < mass(wrapper, True):
                continue
            for path, part, above in found:
                for p, outer in above:
                    outer[OUT] = 0
                    held.append(p)
                release(part, path, held)
            return sorted({p for p, _, _ in found}), sorted(set(held))
    part, path = wrapper, wrapper[LABEL]
    release(part, path, held)
    beside: list[str] = []
    while True:
        named = [k for k in part[KIDS] if not k[OUT] and ARTICLE_NAME.search(k[LABEL]) and 2 * mass(k) >= mass(part)]
        heavy = named or [k for k in part[KIDS] if not k[OUT] and 5 * mass(k) >= 4 * mass(part) > 0]
        if len(heavy) != 1 or part[CHARS] or heavy[0][TAG] in ("p", "b", "i", "em", "strong", "span", "a", "h1"):
            return sorted({path, *beside}), sorted(set(held))
        beside += [f"{path}/{k[LABEL]}" for k in part[KIDS] if k is not heavy[0] and mass(k) > linked(k)]
        part, path = heavy[0], f"{path}/{heavy[0][LABEL]}"


def article_paths(wrapper: list) -> list[str]:
    return article_and_held(wrapper)[0]


def host_paths(wrapper: list) -> list[str]:
    """The article's paths, and those held with a + before."""
    paths, held = article_and_held(wrapper)
    return [*paths, *(f"+{p}" for p in held)]


@functools.lru_cache(4096)
def ways(paths: frozenset) -> frozenset:
    """The paths and all that lead to them."""
    out: set[str] = set()
    for p in paths:
        p = p.removeprefix("+")
        while p and p not in out:
            out.add(p)
            p = p.rpartition("/")[0]
    return frozenset(out)


def digest(data: str) -> int:
    return int.from_bytes(blake2b(data.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def blocks_of(root: Node, paths: frozenset, inside: bool, every: bool = False) -> tuple[list[tuple[int, str, str]], bool]:
    """The blocks (slot, tag, text) below paths (of everything, if inside; with what is set apart, if every), and
    whether any path was met.  A label of the page goes along a path as itself or as a collapsed part."""
    known, hit = ways(paths), inside or root.label in paths
    blocks: list[tuple[int, str, list[str]]] = [(0, root.tag, [])]
    stack = [(iter(root.children), (root.label,), hit, True, False, 0, 0, root.tag)]
    while stack:
        children, at, inside, heading, edge, place, slot, tag = stack[-1]
        for x in children:
            if isinstance(x, str):
                if inside and heading:
                    blocks[-1][2].append(x)
                continue
            apart = outside(x)
            below = tuple(q for p in at for q in (f"{p}/{x.label}", f"{p}/{any_name(x.tag, apart)}") if q in known)
            if apart and not every and not any(f"+{q}" in paths for q in below):
                blocks.append((slot, tag, []))
                continue
            edge = apart or x.tag in BLOCK
            below_tags, new, of = (zlib.crc32(x.tag.encode(), place), zlib.crc32(x.label.encode("utf-8", "replace"), place), x.tag) if edge else (place, slot, tag)
            if edge:
                blocks.append((new, of, []))
            met = any(q in paths for q in below)
            hit = hit or met
            only = True if every else False if x.tag == "header" else heading or x.tag in HEADINGS
            stack.append((iter(x.children), below, inside or met, only, edge, below_tags, new, of))
            break
        else:
            stack.pop()
            if edge:
                blocks.append((stack[-1][6], stack[-1][7], []))
    texts = ((slot, tag, " ".join(html_lib.unescape("".join(b)).split())) for slot, tag, b in blocks if b)
    return [b for b in texts if b[2]], hit


def block_hash(slot: int, text: str) -> int:
    """24 bits of the slot above 40 of the text, as a signed number."""
    both = (slot & 0xFFFFFF) << 40 | digest(text) & 0xFFFFFFFFFF
    return both - (1 << 64) if both >> 63 else both


def page_blocks(root: Node) -> list[int]:
    """Hashes of a page's blocks; cells of tables are data, whatever they repeat."""
    return sorted({block_hash(slot, text) for slot, tag, text in blocks_of(root, frozenset(), True, True)[0] if tag not in ("td", "th")})


def article_text(page: str, paths: frozenset, constants: frozenset = frozenset()) -> str:
    """Blocks of the page's article but its host's constants (hashes), in order, joined by line feeds.  A page that
    none of paths leads into is read as a whole; either way without what tags or names set apart.  Of a header inside
    the article its headings stay."""
    root = parse(page)
    blocks, hit = blocks_of(root, paths, False)
    if not hit:
        blocks, _ = blocks_of(root, frozenset(p for p in host_paths(pattern(root)) if p[0] == "+"), True)
    if constants:
        slots = [b for b in blocks if b[1] in ("td", "th") or block_hash(b[0], b[2]) not in constants]
        size = [sum(len(text) for _, tag, text in x if tag not in HEADINGS) for x in (slots, blocks)]
        blocks = slots if size[0] >= (1 - COPY) * size[1] else blocks
    return "\n".join(text for _, _, text in blocks)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, blocks) of every page that a task sees, and (host, wrapper) of them all."""
    held: dict[str, list] = {}

    def rows(hosts: list, wrappers: list, pages: list, blocks: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(wrappers, pa.string()), pa.array(pages, pa.int64()), pa.array(blocks, pa.list_(pa.int64()))], names=["host", "wrapper", "page", "blocks"])

    def flushed() -> pa.RecordBatch:
        return rows(list(held), [json.dumps(w) for w in held.values()], [None] * len(held), [None] * len(held))

    for batch in batches:
        hosts, pages, blocks = batch.column("host").to_pylist(), [], []
        for host, page in zip(hosts, batch.column("html").to_pylist(), strict=True):
            root = parse(page)
            pages.append(digest(page))
            blocks.append(page_blocks(root))
            one = pattern(root)
            held[host] = aligned(held[host], one) if host in held else one
            if len(held) >= HOSTS:
                yield flushed()
                held.clear()
        yield rows(hosts, [None] * len(hosts), pages, blocks)
    if held:
        yield flushed()


def _merged(table: pa.Table) -> pa.Table:
    """One wrapper from a group's; keeps the columns but wrapper."""
    parts = sorted(table.column("wrapper").to_pylist())
    out = json.loads(parts[0])
    for p in parts[1:]:
        out = aligned(out, json.loads(p))
    first = table.slice(0, 1)
    return first.set_column(first.schema.get_field_index("wrapper"), "wrapper", pa.array([json.dumps(out)], pa.string()))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = ["\n".join(host_paths(json.loads(w))) for w in batch.column("wrapper").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(found, pa.string())], names=["host", "paths"])


def host_wrappers(read: DataFrame) -> DataFrame:
    """host, wrapper (JSON): each task's wrappers, aligned in parts of a host, then by host."""
    parts = read.where("wrapper is not null").select("host", "wrapper").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).cast("int"))
    parts = parts.groupBy("host", "salt").applyInArrow(_merged, "host string, wrapper string, salt int").drop("salt")
    return parts.groupBy("host").applyInArrow(_merged, "host string, wrapper string")


def host_constants(read: DataFrame) -> DataFrame:
    """host, constants: the hashes of each host's constant blocks.  A host has fewer than (mean blocks a page) /
    CONSTANT_SHARE of them, whatever its size."""
    pages = written(read.where("page is not null").groupBy("host", "page").agg(F.first("blocks").alias("blocks")), "page-blocks")
    total = pages.groupBy("host").agg(F.count("*").alias("total"))
    slot = lambda block: F.shiftrightunsigned(block, 40)
    # block and slot are in the keys, so a hot host spreads over tasks
    slots = pages.select("host", F.explode(F.array_distinct(F.transform("blocks", slot))).alias("slot")).groupBy("host", "slot").agg(F.count("*").alias("of_slot"))
    counted = pages.select("host", F.explode("blocks").alias("block")).groupBy("host", "block").agg(F.count("*").alias("n")).where(F.col("n") >= CONSTANT_PAGES)
    over = counted.join(total, "host").where(F.col("n") >= F.col("total") * F.lit(CONSTANT_SHARE))
    over = over.withColumn("slot", slot(F.col("block")))
    frequent = over.groupBy("host", "slot").agg(F.count("*").alias("texts"), F.sum("n").alias("of_frequent"))
    over = over.join(slots, ["host", "slot"]).join(frequent, ["host", "slot"]).where(F.col("n") >= F.col("of_slot") * F.lit(SLOT_SHARE))
    # texts that take turns in a slot are what pages say, not their template
    over = over.where((F.col("texts") == 1) | (F.col("of_frequent") > F.col("of_slot") * F.lit(TURNS)))
    return over.groupBy("host").agg(F.sort_array(F.collect_set("block")).alias("constants"))


def extract_main_text(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """df with text and n_chars (its code points); columns of these names in df are replaced.

    Of a header in the article headings stay, other text goes with page headers.  An element that isn't closed ends with
    the one around it; scripts, styles, frames and media without an end tag end where they begin.

    Null html gives an empty text.  Pages without a host (null or odd urls) share one wrapper.  Rows that repeat are
    kept and read alike.  An empty table gives no rows.
    """
    host, _ = host_and_path(F.col(f"`{url_col}`"))
    pages = df.withColumn("__host", host).withColumn("__html", F.col(f"`{html_col}`"))
    read = pages.select(F.col("__host").alias("host"), F.col("__html").alias("html")).where("html is not null")
    read = written(read.mapInArrow(_read, "host string, wrapper string, page long, blocks array<long>"), "read")
    hosts = host_wrappers(read).mapInArrow(_paths, "host string, paths string").join(host_constants(read), "host", "left")
    hosts = written(hosts.select(F.col("host").alias("__host"), F.col("paths").alias("__paths"), "constants"), "wrappers").withColumnRenamed("constants", "__constants")
    size = hosts.agg(F.sum(F.length("__host") + F.length("__paths") + 8 * F.coalesce(F.size("__constants"), F.lit(0)) + 64)).first()[0] or 0
    pages = pages.join(F.broadcast(hosts) if size <= BROADCAST_BYTES else hosts, "__host", "left")
    kept = [c for c in df.columns if c not in ("text", "n_chars")]
    schema = df.select(*[F.col(f"`{c}`") for c in kept]).withColumns({"__text": F.lit("")}).schema

    def run(batches):
        known: dict[str, tuple[frozenset, frozenset]] = {}
        for batch in batches:
            texts, hosts = [], batch.column("__host").to_pylist()
            for k, page in enumerate(batch.column("__html").to_pylist()):
                if page and hosts[k] not in known:
                    if len(known) >= HOSTS:
                        known.clear()
                    known[hosts[k]] = frozenset((batch.column("__paths")[k].as_py() or "").split("\n")), frozenset(batch.column("__constants")[k].as_py() or ())
                texts.append(article_text(page, *known[hosts[k]]) if page else "")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, "__text"])

    out = pages.select(*[F.col(f"`{c}`") for c in kept], "__host", "__html", "__paths", "__constants").mapInArrow(run, schema)
    return out.withColumns({"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}).drop("__text")
