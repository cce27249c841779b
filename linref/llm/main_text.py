"""Main text of web pages: suffix arrays over the token streams of a host's pages find its boilerplate, with structure as a signal."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from linref.llm._shared import cut, gram_hashes, mix, signed, span_hashes, starts_of_grams, text_buffers, word_spans

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
BOILER = {"nav", "menu", "header", "footer", "aside", "form", "button", "select", "dialog", "head", "fieldset", "datalist", *RAW}
MAIN = {"article", "main"}
MAIN_TAG = re.compile(r"<(?:article|main)\b", re.I)
#: Words of class, id and role that name a part of a page which isn't its article.
MARKS = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright
 disqus disclaimer footer gdpr header login masthead menu modal nav navbar navigation newsletter notice overlay pagination pager popup promo promotion recommended related
 replies reply reviews search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget complementary contentinfo alert""".split())
OWN_CLOSE = {"p": {"p"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: FIRM is DROP by the element itself, which no article in it lifts.
KEEP, NEUTRAL, DROP, FIRM = 0, 1, 2, 3
#: At most so many hosts are broadcast as hosts of several blocks of pages.
LARGE_HOSTS = 1_000_000


def _marked(attributes: str) -> bool:
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value, name = (a or b or c).lower(), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if MARKS.intersection(re.split(r"[^a-z]+", value)):
            return True
    return False


def blocks(page: str) -> list[tuple[int, str]]:
    """The blocks of text of a page in order: KEEP inside an article or main element, DROP inside menus and the like, else NEUTRAL.

    Where class words leave no article with text, an article or main element counts whatever it and what encloses it are called."""
    found = _blocks(page, False)
    if not any(k == KEEP for k, _ in found) and MAIN_TAG.search(page):
        trusted = _blocks(page, True)
        if any(k == KEEP for k, _ in trusted):
            return trusted
    return found


def _blocks(page: str, trust: bool) -> list[tuple[int, str]]:
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    text: list[str] = []
    state, at = NEUTRAL, 0

    def close() -> None:
        found = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if found:
            out.append((min(state, DROP), found))

    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            text.append(page[at:])
            break
        text.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if not any(n == name for n, _ in stack):
                if name not in INLINE:
                    close()
                continue
            if name not in INLINE:
                close()
            while stack:
                n, before = stack.pop()
                if n not in INLINE and name in INLINE and n != name:  # a stray inline end does not close a block
                    stack.append((n, before))
                    break
                state = before
                if n == name:
                    break
            continue
        if name in INLINE:
            if name == "br":
                text.append(" ")
            elif name not in VOID:
                if _marked(m[3]) and state < DROP:
                    close()
                    stack.append((name, state))
                    state = DROP
                else:
                    stack.append((name, state))
            continue
        close()
        closes = OWN_CLOSE.get(name)
        if closes:
            # An open element of this kind, with what is open inside it, ends here.
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes:
                    state = stack[k][1]
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE:
                    break
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID:
            continue
        lifted = trust and name in MAIN and state != FIRM and not any(n in MAIN for n, _ in stack)
        stack.append((name, state))
        if name in BOILER:
            state = FIRM
        elif lifted:
            state = KEEP
        elif _marked(m[3]):
            state = max(state, DROP)
        elif name in MAIN and state < DROP:
            state = KEEP
    close()
    return out


def suffix_array(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the suffixes of x in the order of their first `depth` numbers, and the class of each place's first `depth` numbers.

    By prefix doubling; the last two steps overlap where depth is no power of two. Suffixes are told apart no further than runs need."""
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    order, length = np.argsort(rank, kind="stable"), 1
    while length < depth:
        step = min(length, depth - length)
        ahead = np.zeros(n, np.int64)
        ahead[: max(n - step, 0)] = rank[step:] + 1
        pair = rank * (n + 1) + ahead
        order = np.argsort(pair, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.diff(pair[order], prepend=pair[order[:1]]) != 0)
        length += step
    return order, rank


def boilerplate(words: np.ndarray, rows: np.ndarray, inside: np.ndarray, least: int) -> np.ndarray:
    """The words at which a run of `least` words starts that two distinct pages have, outside of articles.

    words: hashes of all pages' words, rows: the n + 1 numbers of the pages' first ones, inside: whether a word is in an article. One suffix
    array over all pages' streams, an end after each, brings equal runs together."""
    n = np.diff(rows)
    x = np.zeros(len(words) + len(n), np.int64)
    word = np.arange(len(words)) + np.repeat(np.arange(len(n)), n)
    x[word] = np.unique(words, return_inverse=True)[1] + len(n)
    x[rows[1:] + np.arange(len(n))] = np.arange(len(n))  # ends of pages, equal to no other token
    at, page = starts_of_grams(rows, least)
    group = suffix_array(x, least)[1][word[at]]
    told = np.concatenate([[0], np.cumsum(inside)])
    outside = told[at + least] == told[at]
    at, page, group = at[outside], page[outside], group[outside]
    low, high = np.full(len(x), len(n)), np.full(len(x), -1)
    np.minimum.at(low, group, page)
    np.maximum.at(high, group, page)
    return at[(low < high)[group]]


def covered(starts: np.ndarray, size: int, least: int) -> np.ndarray:
    """Of `size` words, those in a run of `least` words from one of the starts."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + least, size), -1)
    return np.cumsum(steps[:-1]) > 0


def _kept(kinds: list[int]) -> int:
    """Which blocks are the text: those of the articles if there are any, else what no structure decides."""
    return KEEP if KEEP in kinds else NEUTRAL


def _streams(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[tuple[pa.RecordBatch, pa.Array, pa.Array]]:
    """So many pages at a time, with all their blocks, one a line, and the blocks' kinds."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            found = [blocks(page.as_py()) for page in part.column("html")]
            yield part, pa.array(["\n".join(t for _, t in f) for f in found], pa.string()), pa.array([[k for k, _ in f] for f in found], pa.list_(pa.int8()))


def _words(body: pa.Array, kinds: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all pages' words: hashes, the pages' first words, the block that each is in, counted over all pages, and whether that is in an article."""
    data, offsets = text_buffers(body)
    starts, ends, rows = word_spans(data, offsets)
    lines = np.cumsum(data == 10)
    first = np.concatenate([[0], np.cumsum(kinds.value_lengths().to_numpy())])
    page = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    before = np.concatenate([[0], lines])[offsets[:-1]]
    block = (lines[starts] if len(starts) else starts) - before[page] + first[page]
    return span_hashes(data, starts, ends), rows, block, kinds.flatten().to_numpy()[block] == KEEP


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, body, kinds in _streams(batches):
        yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("page_id", "url", "rid", "host", "b")], body, kinds, pa.nulls(part.num_rows, pa.list_(pa.int32()))], ["page_id", "url", "rid", "host", "b", "body", "kinds", "places"])


def _outside(least: int):
    """Of the runs of `least` words outside of articles: the hash with the host's, the page, and the place of the first word in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, body, kinds in _streams(batches):
            words, rows, _, inside = _words(body, kinds)
            at, row = starts_of_grams(rows, least)
            told = np.concatenate([[0], np.cumsum(inside)])
            mine = told[at + least] == told[at]
            at, row = at[mine], row[mine]
            host = mix(part.column("host").to_numpy().view(np.uint64))[row]
            value = mix(gram_hashes(words, least)[at] ^ host) if len(at) else np.zeros(0, np.uint64)
            owner = pa.array(row)
            yield pa.RecordBatch.from_arrays([signed(value), part.column("rid").take(owner), part.column("host").take(owner), pa.array((at - rows[:-1][row]).astype(np.int32))], ["run", "rid", "host", "place"])

    return run


def host_wide(pages: DataFrame, least: int) -> DataFrame:
    """(rid, host, places) of the runs that boilerplate() would find in the pages (rid, host, html) of each whole host."""
    outside = cut(pages.mapInArrow(_outside(least), "run long, rid long, host long, place int"))
    many = outside.groupBy("run").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("lo != hi").select("run")
    return outside.join(many, "run").groupBy("rid", "host").agg(F.collect_set("place").alias("places"))


def _long_or_whole(mark: np.ndarray, least: int) -> np.ndarray:
    """A block's covered words less those of runs that reach in from a neighbouring block: shorter than `least` and not the whole block."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
    out = mark.copy()
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if b - a < min(least, len(mark)):
            out[a:b] = False
    return out


def _text(body: str, kinds: list[int], mark: np.ndarray | None, least: int) -> str:
    """The text of a page: its kept blocks less the marked words."""
    kept, lines = _kept(kinds), body.split("\n") if kinds else []
    whole = "\n".join(t for k, t in zip(kinds, lines, strict=True) if k == kept)
    if mark is None or kept == KEEP:
        return whole
    at, out = 0, []
    for k, t in zip(kinds, lines, strict=True):
        words = t.split(" ")
        own = mark[at : at + len(words)]
        at += len(words)
        if k == kept:
            left = [w for w, m in zip(words, _long_or_whole(own, least), strict=True) if not m]
            out += [" ".join(left)] if left else []
    return "\n".join(out) or whole  # a page of which nothing is left is a copy of another one


def _unique_runs(least: int, kind: pa.DataType):
    def run(group: pa.Table) -> pa.Table:
        hits = group.filter(pc.is_valid(group["places"]))
        group = group.filter(pc.is_null(group["places"]))
        rid = group["rid"].to_numpy()
        distinct, where = np.unique(rid, return_index=True)  # repeated rows are one page
        one = group.take(pa.array(where)).combine_chunks()
        body, kinds = _array(one["body"]), _array(one["kinds"])
        words, rows, _, inside = _words(body, kinds)
        starts = [boilerplate(words, rows, inside, least)] if len(words) else []
        for r, places in zip(hits["rid"].to_numpy(), hits["places"]):
            starts.append(rows[np.searchsorted(distinct, r)] + np.asarray(places.values.to_numpy(), np.int64))
        mark = covered(np.concatenate(starts), len(words), least) if starts else np.zeros(0, bool)
        told = np.concatenate([[0], np.cumsum(mark)])
        some = told[rows[1:]] > told[rows[:-1]]
        texts = [_text(b.as_py(), k.as_py(), mark[rows[i] : rows[i + 1]] if some[i] else None, least) for i, (b, k) in enumerate(zip(body, kinds))]
        back = pa.array(np.searchsorted(distinct, rid))
        return pa.table([group["page_id"], group["url"], pa.array(texts, pa.string()).take(back)], schema=pa.schema([("page_id", kind), ("url", pa.string()), ("text", pa.string())]))

    return run


def _array(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def main_text(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", least: int = 8, pages_per_block: int = 200) -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    Blocks inside an article or main element, less the menus, forms, notices and so on in it, are the text; a page without such an element has
    its blocks that are in no menu and the like. The streams of all blocks of a host's pages, menus and articles alike, go into a suffix array,
    and of what is text outside of articles the runs of at least `least` words that another page of the host has outside of articles are
    removed (see boilerplate); of a block, whole or at least `least` words in a row. What is in an article stays: quotations, copies and
    common phrases are repeated in many. A page of which nothing would be left keeps its text. A host of more than pages_per_block pages
    has a suffix array for each block of so many of them; what is repeated over the whole host (`host_wide`) is handed to each of them,
    so blocks do not change the result. References are decoded, white space in a block (br too) is one space, blocks are joined by a line feed. Null or empty
    html: empty text, 0 characters. Repeated rows: one result each, from one shared page, so they don't remove each other. Null url: a host of
    its own. Empty table: no rows. Other columns are ignored."""
    kind = df.schema[key].dataType
    pages = df.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(page), F.lit("")).alias("html"))
    host = F.xxhash64(F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1), F.lit(""))))
    sizes = cut(pages.groupBy(host.alias("host")).agg(F.count("*").alias("n")))
    most = max(pages_per_block, (sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // LARGE_HOSTS)
    large = sizes.where(F.col("n") > most).select("host", F.ceil(F.col("n") / most).cast("int").alias("blocks"))
    pages = pages.withColumn("rid", F.xxhash64("page_id", "url", "html")).withColumn("host", host).join(F.broadcast(large), "host", "left")
    block = F.pmod(F.xxhash64("rid", F.lit(1)), F.coalesce("blocks", F.lit(1))).cast("int")
    pages = pages.withColumn("b", block)
    names = ["page_id", "url", "rid", "host", "b", "body", "kinds", "places"]
    id_kind = kind.simpleString()
    streams = pages.mapInArrow(_parsed, f"page_id {id_kind}, url string, rid long, host long, b int, body string, kinds array<tinyint>, places array<int>")
    if not large.isEmpty():
        places = host_wide(pages.where("blocks is not null").select("rid", "host", "html"), least).join(F.broadcast(large), "host").withColumn("b", block)
        none = {"page_id": F.lit(None).cast(kind), "url": F.lit(None).cast("string"), "body": F.lit(None).cast("string"), "kinds": F.lit(None).cast("array<tinyint>")}
        streams = streams.unionByName(cut(places.select(*[none[c].alias(c) if c in none else F.col(c) for c in names])))
    out = streams.groupBy("host", "b").applyInArrow(_unique_runs(least, to_arrow_type(kind)), f"page_id {id_kind}, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
