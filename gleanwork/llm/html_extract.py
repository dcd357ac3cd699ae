"""Main text of web pages by templates deduced from each host's pages.

1. Tokens are opened and closed containers in their path, and texts in their path. A token's occurrence
   vector says how often each page of the host has it. Vectors are never gathered: each is kept as the
   sum of one hash per page and count, which partial aggregates merge, with its number of pages.
2. Tokens of one vector form an equivalence class. A class on enough of the host's pages that has a
   container's opening and its closing is valid; valid classes nest in one another by their containers,
   and the tree is the host's template. Texts of a class on nearly all pages are the template's own.
3. What stands between a class's tokens is a slot. Each has the text that it holds over all pages of
   the host: that of the template, that in links, and the rest, which varies. The main slot holds most
   of the rest; slots beside it and within it go where they hold nothing that varies, mostly links, or,
   on the page's own level, next to nothing compared with it.
4. Names (article, aside, class="comments") only break ties: of slots that step 3 leaves in, and of
   containers that few pages of the host have. Where a host has too few pages for a template, or a page
   doesn't follow it, they decide alone.

The remaining slots are extracted without the template's texts. Scripts, styles, forms and what is
hidden hold no text anywhere.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.llm import textbytes as tb
from gleanwork.llm.shared import materialise, meet

#: Share of a host's pages that a valid class of containers, and one of texts, needs at least; pages of a host for a template.
SUPPORT, TEXT_SUPPORT = 0.5, 0.8
LEAST_PAGES = 3
#: A slot on the page's own level without h1 whose text that varies is so many times less than the main slot's goes.
ASIDE = 20
#: Share of a slot's text that makes it a menu if it stands in links.
LINKS = 0.5
#: A host whose text is template for more than this share, or such a page, is of copies and keeps its texts.
COPY = 0.9
#: Pages from which a host counts as hot when templates are too many to be broadcast.
HOT = 10_000
ARTICLE = re.compile(r">(article|main)(\.[^>]*)?$")
PAGE = re.compile(r"(^|>(html|body)(\.[^>]*)?)$")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
CONTAINERS = frozenset("html head body div section article main nav header footer aside form table dialog details fieldset center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption tr td th thead tbody tfoot caption address summary hr title".split())
#: Elements that never hold text of a page, and those that by their name are not the article's.
HARD = frozenset("head title form script style noscript template button select option textarea svg iframe object dialog menu label".split())
SOFT = frozenset("nav footer aside".split())
#: Words of class, id or role names that mark such elements.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar sidenav "
    "footer masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search "
    "comment comments disqus respond replies related recommended share sharing social widget pagination pager toolbar skip contentinfo complementary".split()
)
#: An opened element ends elements of these names that are still open around it.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: A quote opens a value only where one begins, and only if it is closed.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


class Block(NamedTuple):
    """A run of text: its container's path, the elements around it whose names say that it is none of the
    article's (a container by its path, another by ''), whether it stands in article or main, in h1, its
    text and how much of it is in links."""

    path: str
    named: tuple[str, ...]
    inside: bool
    head: bool
    text: str
    linked: int


class Open(NamedTuple):
    """An open element."""

    name: str
    path: str
    hard: bool
    named: tuple[str, ...]
    inside: bool
    head: bool
    link: bool


def parse(page: str) -> tuple[Counter, list[Block]]:
    """Container tokens of a page with their counts, and its blocks."""
    tokens: Counter = Counter()
    blocks: list[Block] = []
    stack = [Open("", "", False, (), False, False, False)]
    held: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        raw = "".join(held)
        text = " ".join(entities.unescape(raw).split())
        top = stack[-1]
        if text and not top.hard:
            blocks.append(Block(top.path, top.named, top.inside, top.head, text, len(text) * linked // len(raw)))
        held.clear()
        linked = 0

    def hold(text: str) -> None:
        nonlocal linked
        held.append(text)
        if stack[-1].link:
            linked += len(text)

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if not m:
            hold(page[at:])
            break
        if m.start() > at:
            hold(page[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        block = name in BLOCKS
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    if block or stack[i][2:4] != stack[i - 1][2:4]:
                        flush()
                    if name in CONTAINERS:
                        tokens["/" + stack[i].path] += 1
                    del stack[i:]
                    break
            else:
                if block:
                    flush()
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name in VOID:
            if name == "hr":
                flush()
            else:
                hold(" " if name == "br" else "")
            continue
        attributes = m[3]
        if block:
            flush()
            if name in ("article", "main"):  # ends menus and the like that were left open
                first = next((i for i, x in enumerate(stack) if x.hard or x.named), None)
                if first is not None:
                    del stack[first:]
            elif name == "body":
                while stack[-1].name == "head" or stack[-1].hard or stack[-1].named:
                    stack.pop()
            for gone in ENDS.get(name, ()) if name in ENDS else ("p",):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name in CONTAINERS or (name in ENDS and stack[i].name in ("ul", "ol", "dl")):
                        break
                    if stack[i].name == gone:
                        del stack[i:]
                        break
        names = " ".join(a or b or c for a, b, c in NAMED.findall(attributes)).lower() if attributes else ""
        top = stack[-1]
        frame = name in ("html", "body", "article", "main")
        hard = top.hard or (name in HARD or bool(attributes and HIDDEN.search(attributes))) and not frame
        path = top.path
        if name in CONTAINERS:
            path = f"{path}>{name}" + (f".{'.'.join(names.replace('>', ' ').split())}" if names else "")
            tokens[path] += 1
        named = top.named
        if not frame and (name in SOFT or (names and is_marked(names)) or (name == "header" and not top.inside)):
            named = (*named, path if name in CONTAINERS else "")
        if not block and (hard, named) != (top.hard, top.named):
            flush()
        stack.append(Open(name, path, hard, named, top.inside or name in ("article", "main"), top.head or name == "h1", top.link or name == "a"))
    flush()
    return tokens, blocks


def is_marked(names: str) -> bool:
    """Whether a class, id or role begins or ends with a word of MARKS."""
    return any(part in MARKS for name in re.split(r"[\s.]+", names) for part in re.split(r"[^a-z]+", name)[:: max(1, len(re.split(r"[^a-z]+", name)) - 1)])


def _hash(parts: list[str]) -> np.ndarray:
    raw = [p.encode() for p in parts]
    ends = np.cumsum([len(r) for r in raw])
    return tb.hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends) if raw else np.zeros(0, np.uint64)


_TOKENS = pa.schema([("host", pa.string()), ("token", pa.int64()), ("kind", pa.string()), ("path", pa.string()), *((c, pa.int64()) for c in ("high", "low", "pages", "chars", "linked", "heads"))])


def _tokens(batches):
    """Token statistics of a batch, merged within it: kinds are page, open, close and text. chars, linked and
    heads are those that stand in the container itself."""
    for batch in batches:
        found: dict[tuple, list] = {}
        for host, key, page in zip(batch.column("host").to_pylist(), batch.column("key").to_pylist(), batch.column("html").to_pylist(), strict=True):
            tokens, blocks = parse(page or "")
            own, texts, size = defaultdict(lambda: [0, 0, 0]), Counter(), {}
            for b in blocks:
                name = "#" + b.path + "\x00" + b.text
                texts[name] += 1
                size[name] = (len(b.text), b.linked, int(b.head))
                for i, x in enumerate(size[name]):
                    own[b.path][i] += x
            names = [*tokens, *texts]
            counts = np.array([*tokens.values(), *texts.values()], np.uint64)
            vectors = tb.mix(tb.mix(counts) ^ np.uint64(key & 0xFFFFFFFFFFFFFFFF))
            rows = [("page", 0, "", 0, own[""])]
            for name, token, vector in zip(names, _hash(names).view(np.int64).tolist(), vectors.tolist(), strict=True):
                kind = "text" if name[0] == "#" else "close" if name[0] == "/" else "open"
                path = name[1 : name.index("\x00")] if kind == "text" else name.removeprefix("/")
                rows.append((kind, token, path, vector, [x * texts[name] for x in size[name]] if kind == "text" else own[name] if kind == "open" else [0, 0, 0]))
            for kind, token, path, vector, sizes in rows:
                have = found.setdefault((host, token, kind), [path, 0, 0, 0, 0, 0])
                have[1] = (have[1] + vector) & 0xFFFFFFFFFFFFFFFF
                have[2] += 1
                for i, x in enumerate(sizes):
                    have[3 + i] += x
        columns = zip(*((h, t, k, p, v >> 32, v & 0xFFFFFFFF, *rest) for (h, t, k), (p, v, *rest) in found.items()), strict=True) if found else [[]] * 10
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _TOKENS, strict=True)], schema=_TOKENS)


HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)"


def with_host(pages: DataFrame) -> DataFrame:
    """page_id, url, host, key and html; a null or odd url has the empty host."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), HOST, 1))
    return pages.select("page_id", "url", host.alias("host"), F.xxhash64("page_id", "url", F.col("html")).alias("key"), F.col("html").cast("string").alias("html"))


def tokens_of(pages: DataFrame) -> DataFrame:
    """Tokens of each host with their vectors, of those on enough of its pages. What is left of a host is
    bounded by its template, however many pages it has."""
    tokens = pages.select("host", "key", "html").mapInArrow(_tokens, "host string, token long, kind string, path string, high long, low long, pages long, chars long, linked long, heads long")
    sums = [F.sum(c).alias(c) for c in ("high", "low", "pages", "chars", "linked", "heads")]
    tokens = tokens.groupBy("host", "token", "kind").agg(F.min("path").alias("path"), *sums)
    # one sum modulo 2**64 from those of its halves
    vector = F.shiftleft((F.col("high") + F.shiftright("low", 32)).bitwiseAND(0xFFFFFFFF), 32).bitwiseOR(F.col("low").bitwiseAND(0xFFFFFFFF))
    tokens = materialise(tokens.withColumn("vector", vector).drop("high", "low").where((F.col("kind") != "text") | (F.col("pages") >= LEAST_PAGES)), "html-tokens")
    size = tokens.where("kind = 'page'").where(F.col("pages") >= LEAST_PAGES).select("host", F.col("pages").alias("host_pages"))
    enough = F.when(F.col("kind") == "text", TEXT_SUPPORT).otherwise(F.when(F.col("kind") == "page", 0.0).otherwise(SUPPORT)) * F.col("host_pages")
    return tokens.join(size, "host").where(F.col("pages") >= enough)


class Container:
    """A container of a host's template: a slot."""

    def __init__(self, path: str, sizes: list[int]):
        self.path, self.up, self.below = path, None, []
        self.chars, self.linked, self.heads = sizes
        self.rest = self.chars - self.linked  # less the template's texts: what varies

    def total(self, what: str) -> int:
        return getattr(self, what) + sum(c.total(what) for c in self.below)

    def named(self, inside: bool) -> bool:
        """Whether its own name says that it is none of the article's."""
        tag, _, names = self.path.rpartition(">")[2].partition(".")
        return tag in SOFT or is_marked(names) or (tag == "header" and not inside and not self.total("heads"))

    def all(self) -> list[Container]:
        return [self, *(x for c in self.below for x in c.all())]


def _up(path: str, known: dict) -> str:
    """The innermost known container around a path; '' is the page."""
    while path and path not in known:  # a name may have the sign that parts containers
        path = path.rpartition(">")[0]
    return path


def tree(rows: list[dict]) -> tuple[dict[str, Container], list[dict], int]:
    """Containers of the valid classes by path, nested in the page's '', the template's own texts, and the
    number of valid classes."""
    classes = defaultdict(list)
    page = [0, 0, 0]
    for r in rows:
        if r["kind"] == "page":
            page = [r["chars"], r["linked"], r["heads"]]
        else:
            classes[r["vector"], r["pages"]].append(r)
    found, texts, n = {"": Container("", page)}, [], 0
    for members in classes.values():
        closed = {r["path"] for r in members if r["kind"] == "close"}
        opened = [r for r in members if r["kind"] == "open" and r["path"] in closed]
        own = [r for r in members if r["kind"] == "text"] if len(members) > 1 else []
        n += bool(opened or own)
        found |= {r["path"]: Container(r["path"], [r["chars"], r["linked"], r["heads"]]) for r in opened}
        texts += own
    for path, c in found.items():
        if path:
            c.up = found[_up(path.rpartition(">")[0], found)]
            c.up.below.append(c)
    return found, texts, n


def deduce(rows: list[dict]) -> dict | None:
    """Of one host's tokens: main (path of the main slot), around (whether that is in article or main), gone
    (paths of slots that don't remain), kept (of those that do against their name), texts (hashes of the
    template's own texts) and classes (number of valid ones); None where there is no template."""
    slots, texts, n = tree(rows)
    if len(slots) == 1:
        return None
    fixed = Counter()
    for t in texts:
        fixed[_up(t["path"], slots)] += t["chars"] - t["linked"]
    if sum(fixed.values()) > COPY * sum(s.rest for s in slots.values()):  # copies
        texts, fixed = [], Counter()
    for path, chars in fixed.items():
        slots[path].rest -= chars
    main = max(slots.values(), key=lambda s: (s.rest, -len(s.path), s.path))
    if main.rest <= 0:
        return None
    spine, s = [], main
    while s:
        spine.append(s)
        s = s.up
    around = any(ARTICLE.search(s.path) for s in spine)
    gone, kept = [], []

    def look(s: Container, inside: bool) -> None:
        """Decide about the slots within one that remains."""
        if s.path and s.named(inside):
            kept.append(s.path)
        inside = inside or bool(ARTICLE.search(s.path))
        for c in s.below:
            rest, chars = c.total("rest"), c.total("chars")
            if c in spine:
                look(c, inside)
            elif chars and (rest <= 0 or c.total("linked") >= LINKS * chars or (PAGE.search(s.path) and not c.total("heads") and rest * ASIDE < main.rest)):
                gone.append(c.path)
            elif c.named(inside) or (around and not inside and not any(ARTICLE.search(x.path) for x in c.all())):
                gone.append(c.path)  # a tie, broken by names
            else:
                look(c, inside)

    look(slots[""], False)
    return {"main": main.path, "around": around, "gone": gone, "kept": kept, "texts": [t["token"] for t in texts], "classes": n}


_TEMPLATE = pa.schema([("host", pa.string()), ("pages", pa.int64()), ("main", pa.string()), ("around", pa.bool_()), ("gone", pa.list_(pa.string())), ("kept", pa.list_(pa.string())), ("texts", pa.list_(pa.int64())), ("classes", pa.int64())])


def _deduce(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    made = deduce(rows)
    return pa.Table.from_pylist([{"host": rows[0]["host"], "pages": rows[0]["host_pages"], **made}] if made else [], schema=_TEMPLATE)


def templates(pages: DataFrame) -> DataFrame:
    """One row per host that has a template: see ``deduce``."""
    return tokens_of(pages).groupBy("host").applyInArrow(_deduce, "host string, pages long, main string, around boolean, gone array<string>, kept array<string>, texts array<long>, classes long")


def _main_text(page: str, template: dict | None) -> str:
    tokens, blocks = parse(page)
    if template and (not template["main"] or template["main"] in tokens):
        gone, around, kept = template["gone"], template["around"], {*template["kept"]}
        within = lambda path: any(path == g or path.startswith(g + ">") for g in gone)
        # names decide about what the host's other pages don't have
        rest = [b for b in blocks if kept.issuperset(b.named) and not within(b.path) and (b.inside or not around)]
        own = set(template["texts"])
        if own and rest:
            ids = _hash([f"#{b.path}\x00{b.text}" for b in rest]).view(np.int64).tolist()
            less = [b for b, i in zip(rest, ids, strict=True) if b.head or i not in own]
            size = lambda xs: sum(len(b.text) for b in xs if not b.head)
            if size(less) > (1 - COPY) * size(rest):
                rest = less
    else:
        article = any(b.inside for b in blocks)
        rest = [b for b in blocks if not b.named and (b.inside or not article)]
    return "\n".join(b.text for b in rest)


def _extract(batches):
    for batch in batches:
        held = [batch.column(c).to_pylist() for c in ("html", "main", "around", "gone", "kept", "texts")]
        texts = [_main_text(page or "", None if m is None else {"main": m, "around": a, "gone": g, "kept": k, "texts": t}) for page, m, a, g, k, t in zip(*held, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row. A null html has the empty text; pages of a host of
    fewer than LEAST_PAGES, and those without its main slot, are read by their own elements and names. A page
    that is nearly all template is a copy and keeps its text. Repeated rows give repeated rows."""
    rows = with_host(pages)
    found = materialise(templates(rows), "html-templates")  # its size decides about a broadcast
    schema = rows.schema
    kinds = ", ".join(f"{c} {schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return meet(rows.drop("key"), found, "host", "pages", HOT).select("page_id", "url", "html", "main", "around", "gone", "kept", "texts").mapInArrow(_extract, f"{kinds}, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
