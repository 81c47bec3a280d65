"""Main text of web pages by template deduction over the pages of a host."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipple.llm.common import column, cut, kind_of, prepare, table

# What HTML says of its elements, and names by which pages mark what isn't their main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object select xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rt rp".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIDE_TAGS = frozenset("head nav footer aside form menu dialog button".split())
SIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promoted promotion nav navbar navigation navigations menu menubar breadcrumb breadcrumbs sidebar aside rail "
    "header masthead topbar footer bottombar copyright cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall comment comments commentlist disqus replies respond related recommended recommendations "
    "share sharing social subscribe subscription newsletter signup login search toolbar widget pagination pager skip".split()
)
MAIN_TAGS = frozenset(("article", "main"))
MAIN_ROLES = frozenset("main article articlebody".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>"']++|"[^"]*"|'[^']*')*+)/?>|<(/?)([a-zA-Z][^\s/><]*)([^>]*)(?:>|\Z)""", re.S)
_MARKS = re.compile(r"""(?:^|[\s"'])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")
_RAW_END = {tag: re.compile(rf"</{tag}\s*[^>]*>", re.I) for tag in RAW}

#: A token that no other shares its vector with needs this share of its host's pages.
SUPPORT = 0.5
#: An equivalence class is template from so many distinct pages and so many tokens (its support and size); pages of a
#: host that has fewer can't show what repeats, and are read by their own elements.
LEAST_PAGES, LEAST_TOKENS = 4, 2
#: A slot whose text is links to this share, over all pages of the host, is a menu.
LINKED = 0.6
#: Tokens of all templates (32 bytes each) that all workers may hold; more meet the pages by the host, and hosts
#: with many pages are then dealt over parts of about so many pages.
BROADCAST_TOKENS, PART_PAGES = 500_000, 5_000
#: Tokens of one host's template that a row may hold; if a host has more, every page gets those it has itself.
HOST_TOKENS = 50_000
#: Contents that occur more than once, as all workers may hold them; more meet the pages by a join.
BROADCAST_COPIES = 200_000
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Frame:
    """An open element: its path (by a hash of the element, its marks and the path above), and what it says of its text."""

    __slots__ = ("tag", "path", "above", "block", "side", "main", "link")

    def __init__(self, tag: str, path: int, above: Frame | None, side: bool, main: bool, link: bool):
        self.tag, self.path, self.above, self.side, self.main, self.link = tag, path, above, side, main, link
        self.block = above.block if above and tag in INLINE else self  # the innermost element that isn't inline


def _open(parent: Frame, tag: str, attrs: str) -> Frame:
    names, marks = [], []
    for m in _MARKS.finditer(attrs) if "=" in attrs else ():
        value = (m[2] or m[3] or m[4] or "").lower()
        marks.append(f"{m[1].lower()}={re.sub(r'[0-9]+', '#', value)}")
        if m[1].lower() in ("role", "itemprop"):
            names.append(("role", value))
        else:
            names += [("name", x) for x in _NAME.findall(value)]
    main = parent.main or tag in MAIN_TAGS or any(k == "role" and v in MAIN_ROLES for k, v in names)
    side = parent.side or tag in SIDE_TAGS or tag == "header" and not parent.main or any((v in SIDE_NAMES) if k == "name" else v in ("navigation", "banner", "contentinfo", "complementary", "search", "form") for k, v in names)
    if tag in ("html", "body") or tag in MAIN_TAGS:  # a name on the whole page says nothing of its parts
        side = parent.side or tag in MAIN_TAGS and any(k == "name" and v.startswith("comment") for k, v in names)
    return Frame(tag, _key("path", str(parent.path), tag, *sorted(marks)), parent, side, main and not (side and not parent.main), parent.link or tag == "a")


#: A block: its element, its text, whether that is beside the main text, whether in a main part, and characters in links.
Block = tuple[Frame, str, bool, bool, int]


def parse(page: str) -> tuple[list[Block], dict[int, int]]:
    """Blocks of text in page order, and how often each path opens.  Time grows with the page, however it nests."""
    root = Frame("", 0, None, False, False, False)
    stack, blocks, seen = [root], [], {}
    opened: dict[str, int] = {}  # elements on the stack, by their names
    buffer: list[str] = []
    owner, beside, linked, blank = root, False, 0, True

    def flush() -> None:
        nonlocal linked, blank
        if not blank:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                blocks.append((owner, text, beside, owner.main, min(linked, len(text))))
        buffer.clear()
        linked, blank = 0, True

    def add(text: str) -> None:
        nonlocal owner, beside, linked, blank
        top = stack[-1]
        if blank:  # the innermost element that isn't inline owns the block; a mark on an inline one still counts
            owner, beside = top.block, top.side
        elif top.side != beside:
            flush()
            owner, beside = top, top.side
        buffer.append(text)
        blank = blank and not text.strip()
        if top.link:
            linked += len(text.strip())

    def close(upto: int) -> None:
        for f in stack[upto:]:
            opened[f.tag] -= 1
        del stack[upto:]

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        m = _TOKEN.match(page, lt)
        if not m:
            add("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, end, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if end:
            if opened.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        if tag not in INLINE:
                            flush()
                        close(k)
                        break
                    if tag in INLINE and stack[k].tag not in INLINE:
                        break  # a stray end tag doesn't close a block
            if tag == "p":
                flush()
            elif tag == "br":
                add(" ")
            continue
        if tag in RAW:
            path = _key("path", str(stack[-1].path), tag)
            seen[path] = seen.get(path, 0) + 1
            ends = _RAW_END[tag].search(page, at)
            at = ends.end() if ends else n
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P or tag in ("li", "dt", "dd", "tr", "td", "th", "option", "tbody", "thead"):
                peers = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ())
                if any(map(opened.get, peers)) or opened.get("p") and tag in CLOSES_P:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag == "p" and tag in CLOSES_P or stack[k].tag in peers:
                            close(k)
                            break
                        if stack[k].tag not in INLINE and stack[k].tag != "p":
                            break
        frame = _open(stack[-1], tag, attrs)
        seen[frame.path] = seen.get(frame.path, 0) + 1
        opened[tag] = opened.get(tag, 0) + 1
        stack.append(frame)
    flush()
    return blocks, seen


def _key(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) >> 1


def page_key(url: str | None, text: str | None) -> int:
    return _key("page", url or "", text or "")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page, its tokens: paths of elements, and paths with the text that stands there."""
    for b in batches:
        cols: list[list] = [[] for _ in range(8)]
        for h, url, text, weight in zip(*(b.column(c).to_pylist() for c in ("host", "__url", "__html", "weight")), strict=True):
            own = page_key(url, text)
            blocks, seen = parse(text or "")
            of: dict[int, list[int]] = {0: [1, 0, 0, 0]}
            for path, k in seen.items():
                of[path] = [k, 0, 0, 1]
            for frame, block, _, _, links in blocks:
                slot = of.setdefault(frame.path, [1, 0, 0, 1])
                slot[1] += len(block)
                slot[2] += links
                of.setdefault(_key("text", str(frame.path), block), [0, 0, 0, 0])[0] += 1
            for r, (k, c, ln, element) in of.items():
                for col, x in zip(cols, (h, r, k, own, c, ln, element, weight), strict=True):
                    col.append(x)
        types = [pa.string(), *[pa.int64()] * 6, pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=["host", "role", "times", "page", "chars", "linked", "element", "weight"])


_TOKENS = "host string, role long, times long, page long, chars long, linked long, element long, weight double"


def weighted(pages: DataFrame) -> DataFrame:
    """Pages (host, __url, __html) with ``weight``: one over the number of pages of the host with the same content.

    Content is what stands outside tags, comments, scripts and styles, so that copies count as one page.
    """
    shown = F.regexp_replace(F.coalesce("__html", F.lit("")), r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)|<[^>]*>?", " ")
    content = F.xxhash64(F.regexp_replace(shown, r"\s+", " "))
    src = pages.select("host", "__url", "__html", content.alias("content"))
    copies = cut(src.groupBy("host", "content").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    both = src.join(F.broadcast(copies) if copies.count() <= BROADCAST_COPIES else copies, ["host", "content"], "left")
    return both.select("host", "__url", "__html", (F.lit(1.0) / F.coalesce("copies", F.lit(1))).alias("weight"))


def classes(tokens: DataFrame) -> DataFrame:
    """The template tokens of every host: ``host``, ``role``, ``pages`` (of the host), ``links`` and ``sure``.

    The occurrence vector of a token has its count on every page of the host.  Two sums of hashes of (page, count)
    stand for the vector: they need no list of pages and combine before the shuffle, so that a host may hold any
    share of all pages.  Tokens with one vector are an equivalence class.  A class is template by its own support
    and size: LEAST_PAGES distinct pages and LEAST_TOKENS tokens, whatever else the host has, so that each of
    several layouts has its template.  A class of one token says nothing (it may be a chance), unless all pages have it.
    A class is ``sure`` if it holds elements or is on SUPPORT of the host's pages; text alone on fewer pages may as
    well be what near copies share.
    """
    low = lambda salt: F.sum(F.xxhash64(F.lit(salt), "page", "times").bitwiseAND(F.lit(0x7FFFFFFF)))
    by = tokens.groupBy("host", "role").agg(F.round(F.sum("weight")).cast("long").alias("n"), low(1).alias("v1"), low(2).alias("v2"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.max("element").alias("element"))
    by = cut(by)  # read three times below, parsed once
    of_host = by.filter("role = 0").filter(F.col("n") >= LEAST_PAGES).select("host", F.col("n").alias("pages"))
    kept = by.filter("role != 0").filter(F.col("n") >= LEAST_PAGES).join(of_host, "host")
    vector = F.xxhash64("v1", "v2")
    kept = kept.select("host", "role", "pages", "n", vector.alias("vector"), "element", (F.col("linked") / F.greatest(F.col("chars"), F.lit(1))).alias("links"))
    sizes = kept.groupBy("host", "vector").agg(F.count(F.lit(1)).alias("size"), F.max("element").alias("framed"))
    kept = kept.join(sizes, ["host", "vector"]).filter((F.col("size") >= LEAST_TOKENS) | (F.col("n") == F.col("pages")))
    sure = (F.col("framed") > 0) | (F.col("n") >= F.col("pages") * SUPPORT)
    return kept.select("host", "role", "pages", "links", sure.alias("sure"))


class Template:
    """Template tokens of one host (or those of them that a page has) and what they say of a slot."""

    def __init__(self, pages: int, entries: list[dict]):
        self.pages = pages
        self.tokens = {e["role"]: e["links"] for e in entries}
        self.unsure = {e["role"] for e in entries if not e["sure"]}

    def slot(self, frame: Frame) -> Frame | None:
        """The innermost template element around a block, if any: classes nest as their elements do."""
        while frame is not None and frame.path not in self.tokens:
            frame = frame.above
        return frame


def main_text(blocks: list[Block], template: Template) -> str:
    """What the template leaves: blocks of the main slots, joined by a blank line.

    Template text and slots of links go, inside a main part too.  Blocks outside of the main part of a page stay only
    if the template has their very slot, as one whose text is the page's own.  Elements and marks that say they are
    beside the text are believed.  A page whose text would mostly go by unsure classes is a near copy and keeps it.
    Without a template a page's own elements are its slots.
    """
    framed = any(main and not side for _, _, side, main, _ in blocks)
    told = template.pages >= LEAST_PAGES
    own: dict[int, list[int]] = {}
    for frame, text, _, _, links in blocks if not told else ():
        sums = own.setdefault(frame.path, [0, 0])
        sums[0] += len(text)
        sums[1] += links
    slots: dict[int, Frame | None] = {}
    left: list[tuple[str, bool]] = []
    for frame, text, side, main, links in blocks:
        if side:
            continue
        role = _key("text", str(frame.path), text)
        if role in template.tokens:
            if role in template.unsure:
                left.append((text, True))
            continue
        if framed and not main and frame.path not in template.tokens:
            continue
        if links >= LINKED * len(text):
            if not told:  # one page says nothing of a main part's slots
                linked = not main and own[frame.path][1] >= LINKED * own[frame.path][0]
            else:
                if frame.path not in slots:
                    slots[frame.path] = template.slot(frame)
                slot = slots[frame.path]
                linked = template.tokens[slot.path] >= LINKED if slot else not main
                linked = linked and not (main and frame.tag in HEADINGS)  # a heading may well link to the page itself
            if linked:
                continue
        left.append((text, False))
    doubted = sum(len(t) for t, x in left if x)
    sure = sum(len(t) for t, x in left if not x)
    return "\n\n".join(t for t, x in left if not x or doubted > sure)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [page_key(u, t) for u, t in zip(b.column("__url").to_pylist(), b.column("__html").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], names=[*b.schema.names, "page"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page.

    Returns one row for each input row: ``page_id``, ``url``, ``text`` string and ``n_chars`` long (code points).
    A null or empty page has an empty text; a null url belongs to the nameless host.  Null ids and repeated rows pass
    through, an empty table gives none, other columns are ignored whatever their names.  A host's template is
    deduced from all its pages; a page that is alone on its host is read by its own elements.
    """
    prepare(pages.sparkSession)
    src = pages.select(F.col(f"`{id_col}`").alias("page_id"), column(pages, url_col, "string").alias("__url"), column(pages, html_col, "string").alias("__html"))
    host = F.lower(F.coalesce(F.regexp_extract(F.coalesce("__url", F.lit("")), r"^[a-zA-Z][A-Za-z0-9_+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    src = src.withColumn("host", host)
    pages_ = weighted(src.select("host", "__url", "__html"))
    entry = F.struct("role", "links", "sure")
    found = cut(classes(pages_.mapInArrow(_tokens, _TOKENS)))
    sizes = found.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    total, largest = sizes.agg(F.sum("n"), F.max("n")).first()
    grouped = found.groupBy("host").agg(F.max("pages").alias("pages"), F.collect_list(entry).alias("template"))
    if (total or 0) <= BROADCAST_TOKENS:
        both = src.join(F.broadcast(cut(grouped)), "host", "left")
    elif largest <= HOST_TOKENS:  # a page draws one of as many parts as its host needs
        deduced = cut(grouped.withColumn("parts", F.ceil(F.col("pages") / PART_PAGES).cast("int")))
        large = cut(deduced.filter("parts > 1").select("host", "parts"))  # one host for PART_PAGES pages at most
        drawn = F.pmod(F.xxhash64("page_id", "__url", "__html"), F.coalesce("parts", F.lit(1))).cast("int")
        dealt = deduced.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        few = F.broadcast(large) if large.count() <= BROADCAST_COPIES else large
        both = src.join(few, "host", "left").withColumn("part", drawn).drop("parts").join(dealt, ["host", "part"], "left")
    else:  # a template too large for a row: every page meets the tokens that it has itself, which decide alike
        has = pages_.mapInArrow(_tokens, _TOKENS).select("host", "role", "page").distinct()
        own = has.join(found, ["host", "role"]).groupBy("page").agg(F.max("pages").alias("pages"), F.collect_list(entry).alias("template"))
        both = src.mapInArrow(_keyed, f"page_id {kind_of(src.schema['page_id'].dataType)}, __url string, __html string, host string, page long").join(own, "page", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template] = {}
        for b in batches:
            texts = []
            page = b.column("page").to_pylist() if "page" in b.schema.names else None
            for i, (h, text) in enumerate(zip(b.column("host").to_pylist(), b.column("__html").to_pylist(), strict=True)):
                h = h if page is None else page[i]
                if h not in known:
                    if len(known) >= 256:
                        known.clear()
                    known[h] = Template(b.column("pages")[i].as_py() or 0, b.column("template")[i].as_py() or [])
                texts.append(main_text(parse(text or "")[0], known[h]))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("__url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return both.mapInArrow(run, f"page_id {kind_of(src.schema['page_id'].dataType)}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
