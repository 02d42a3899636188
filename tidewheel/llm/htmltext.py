"""Main text of web pages: structure first, then a suffix array per host for what structure leaves open.

A page is cut into blocks. Blocks of navigation, headers, footers, sidebars, notices, adverts, forms,
comments and the like are chrome and go. Blocks of an ``article`` or ``main`` element are the article and
stay whole, also where pages share them. All other blocks are open, beside an article too: the token
streams of a host's pages are concatenated, a suffix array to depth ``RUN`` finds the substrings of at
least ``RUN`` tokens that stand on ``MIN_PAGES`` distinct pages or more, what they cover of open blocks is
removed and the unique runs are kept. All blocks are part of the streams, as they show what the host repeats.

Hosts are dealt in shards of bounded size, by page content so that copies count once; shards of one host
report the pages of each run and the sums decide. Null html is empty, a null url has the empty host;
repeated rows pass through; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.linkage import runs
from tidewheel.llm.storage import bounded_batches, materialise, maybe_broadcast
from tidewheel.llm.wordhash import _PLACE, mix, word_hashes

RUN = 8
MIN_PAGES = 3
SHARD_TOKENS = 1 << 20

# Elements and hints.
CHROME = frozenset("nav footer aside form button select textarea menu dialog noscript template svg iframe object canvas audio video".split())
RAW = frozenset("script style title textarea xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|gdpr|masthead|menu|modal|"
    r"nav|navbar|navigation|newsletter|notice|popup|promo|related|respond|share|sharing|sidebar|skip|social|sponsor(?:ed)?|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.IGNORECASE,
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
_REST = r"<!--.*?(?:-->|\Z)|<[!?/][^>]*+>|[^<]++|<"
_TOKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|" + _REST, re.DOTALL)
#: As above, with tags that end at the next sign whatever their quotes.
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|" + _REST, re.DOTALL)
#: After so many tags with a quote that is open to the page's end, each a scan of the rest, quotes count no more.
_BROKEN = 16
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)

ARTICLE, OPEN, OUT = 0, 1, 2


def _is_chrome(name: str, attributes: str, inside: bool) -> bool:
    if name in CHROME or name == "header" and not inside:
        return True
    if name in ("html", "body", "article", "main") or not attributes:
        return False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            return True
        if key in ("class", "id") and name not in ("b", "i", "em", "strong", "h1") and HINT.search(value):
            return True
    return False


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of all blocks in page order."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, chrome, article
    chrome = article = 0
    many: Counter[str] = Counter()  # open elements by name
    blocks_at: list[int] = []  # places of block elements in the stack

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append((OUT if chrome else ARTICLE if article else OPEN, text))

    def close() -> str:
        nonlocal chrome, article
        top, c, a = stack.pop()
        many[top] -= 1
        if blocks_at and blocks_at[-1] == len(stack):
            blocks_at.pop()
        chrome, article = chrome - c, article - a
        return top

    pos, broken, last = 0, 0, page.rfind(">")
    while pos < len(page):
        m = (_TOKEN if broken < _BROKEN else _LOOSE).match(page, pos) if pos <= last else None
        if m is None:  # no tag can end any more
            parts.append(entities.unescape(page[pos:]) if not page.startswith("<!--", pos) else "")
            break
        name = m[2]
        if name is None and page[pos] == "<" and (page[pos + 1 : pos + 2].isalpha() or page[pos + 1 : pos + 2] == "/" and page[pos + 2 : pos + 3].isalpha()):
            broken += 1
            m = _LOOSE.match(page, pos)
            name = m[2]
        pos = m.end()
        if name is None:
            s = m[0]
            if s[0] != "<" or s == "<":
                parts.append(entities.unescape(s) if "&" in s else s)
            continue
        name = name.lower()
        if m[1]:
            if many[name]:
                if name in BLOCKS:
                    flush()
                while True:
                    if stack[-1][0] in BLOCKS:
                        flush()
                    if close() == name:
                        break
            elif name == "p":
                flush()
            continue
        if name in BLOCKS:
            flush()
        elif name in ("br", "wbr", "img"):
            parts.append(" " if name == "br" else "")
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.IGNORECASE).search(page, pos)
            pos = len(page) if end is None else page.find(">", end.start()) + 1 or len(page)
            continue
        if name in VOID:
            continue
        if name in ("p", "li") and blocks_at and stack[blocks_at[-1]][0] == name:  # closes an open one, unless a block lies between
            for _ in range(len(stack) - blocks_at[-1]):
                close()
        c = name == "head" or _is_chrome(name, m[3], article > 0)
        a = name in ("article", "main") and not chrome
        if name in BLOCKS:
            blocks_at.append(len(stack))
        elif c:
            flush()
        stack.append((name, c, a))
        many[name] += 1
        chrome, article = chrome + c, article + a
    flush()
    return out


def text_of(page: str) -> tuple[str | None, list[tuple[int, str]]]:
    """The article's text, null if the page has open blocks, and all blocks."""
    found = blocks(page)
    if any(k == OPEN for k, _ in found):
        return None, found
    return "\n".join(t for k, t in found if k == ARTICLE), found


_PARSED = pa.schema(
    [("row", pa.int64()), ("open", pa.bool_()), ("tokens", pa.int64()), ("blocks", pa.list_(pa.struct([("kind", pa.int8()), ("text", pa.string())])))]
)


def parse(pages: DataFrame) -> DataFrame:
    """row, page_id, url, host, same (a hash of the html), open, tokens, blocks, written once."""
    bounded_batches(pages.sparkSession)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page in batch.column("html").to_pylist():
                text, found = text_of(page)
                rows.append({"open": text is None, "tokens": sum(t.count(" ") + 1 for _, t in found), "blocks": [{"kind": k, "text": t} for k, t in found]})
            new = pa.RecordBatch.from_pylist([{"row": None} | r for r in rows], schema=_PARSED)
            keep = [batch.column(c) for c in ("row", "page_id", "url", "host", "same")]
            yield pa.RecordBatch.from_arrays(keep + new.columns[1:], names=["row", "page_id", "url", "host", "same", *_PARSED.names[1:]])

    html = F.coalesce("html", F.lit(""))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), F.xxhash64(html).alias("same"), html.alias("html"))
    schema = "row long, page_id long, url string, host string, same long, open boolean, tokens long, blocks array<struct<kind:tinyint,text:string>>"
    return materialise(rows.mapInArrow(out, schema), "pages")


def fingerprints(tokens: np.ndarray) -> np.ndarray:
    """A hash of the ``RUN`` tokens from each place of one page on."""
    n = max(0, len(tokens) - RUN + 1)
    out = np.zeros(n, np.uint64)
    for j in range(RUN):
        out += tokens[j : j + n] * _PLACE[j]
    return mix(out)


def stream(texts: list[str]) -> np.ndarray:
    return word_hashes([" ".join(texts).encode("utf-8", "replace")])[0] if texts else np.empty(0, np.uint64)


def repeated(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the concatenated streams) of one suffix of each ``RUN``-token prefix, and its pages.

    The suffix array of the streams to depth ``RUN`` by prefix doubling: suffixes with the same rank are
    neighbours in it with a common prefix of ``RUN`` tokens. A page's end is a token of its own.
    """
    size = [len(p) for p in pages]
    page = np.repeat(np.arange(len(pages)), size)
    end = np.repeat(np.cumsum(size), size)
    rank = np.unique(np.concatenate(pages), return_inverse=True)[1].astype(np.int64)
    depth = 1
    at = np.arange(len(rank))
    while depth < RUN:
        nxt = np.where(at + depth < end, rank[np.minimum(at + depth, len(rank) - 1)] + 1, 0)
        rank = np.unique(rank * (len(rank) + 1) + nxt, return_inverse=True)[1].astype(np.int64)
        depth *= 2
    suffixes = np.argsort(rank, kind="stable")
    suffixes = suffixes[end[suffixes] - suffixes >= RUN]
    if not len(suffixes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.diff(rank[suffixes], prepend=-1))
    # Places rise inside a group, so a page's suffixes in it are neighbours.
    new_page = np.diff(page[suffixes], prepend=-1) != 0
    new_page[first] = True
    return suffixes[first], np.add.reduceat(new_page.astype(np.int64), first)


def boilerplate(parsed: DataFrame) -> DataFrame:
    """(host, fp): the repeated runs of all hosts that have pages with open blocks."""
    spark = parsed.sparkSession
    hosts = parsed.groupBy("host").agg(F.sum("tokens").alias("n"), F.max("open").alias("any_open")).filter("any_open")
    shards = F.ceil(F.col("n") / SHARD_TOKENS).cast("int")
    hosts = materialise(hosts.select("host", F.greatest(shards, F.lit(1)).alias("shards")), "hosts")
    # Pages of the other hosts, all of them articles and chrome, are not shuffled.
    rows = parsed.join(maybe_broadcast(hosts), "host").withColumn("shard", F.pmod("same", "shards").cast("int"))
    # Copies of a page are one page before any of them moves.
    rows = rows.select("host", "shard", "shards", "same", F.transform("blocks", lambda b: b["text"]).alias("texts")).dropDuplicates(["host", "same"])
    schema = pa.schema([("host", pa.string()), ("fp", pa.int64()), ("pages", pa.int64())])

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 2):
            pages = [p for p in map(stream, t.column("texts").to_pylist()) if len(p)]
            if not pages:
                continue
            at, n = repeated(pages)
            if t.column("shards")[0].as_py() == 1:
                at, n = at[n >= MIN_PAGES], n[n >= MIN_PAGES]
            tokens = np.concatenate(pages)
            fp = np.zeros(len(at), np.uint64)
            for j in range(RUN):
                fp += tokens[at + j] * _PLACE[j]
            yield pa.RecordBatch.from_arrays([pa.array([t.column("host")[0].as_py()] * len(at), pa.string()), pa.array(mix(fp).view(np.int64)), pa.array(n)], schema=schema)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(parts, "host", "shard").sortWithinPartitions("host", "shard").mapInArrow(out, "host string, fp long, pages long")
    return materialise(found.groupBy("host", "fp").agg(F.sum("pages").alias("pages")).filter(F.col("pages") >= MIN_PAGES).select("host", "fp"), "boilerplate")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages``."""
    parsed = parse(pages)
    rows = parsed.filter("open")
    known = boilerplate(parsed)
    place_schema = pa.schema([("row", pa.int64()), ("host", pa.string()), ("pos", pa.int32()), ("fp", pa.int64())])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, host, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fp = fingerprints(stream(texts)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(fp), pa.int64()), pa.array([host] * len(fp), pa.string()), pa.array(np.arange(len(fp), dtype=np.int32)), pa.array(fp)], schema=place_schema)

    texts = F.transform("blocks", lambda b: b["text"])
    each = rows.select("row", "host", texts.alias("texts")).mapInArrow(places, "row long, host string, pos int, fp long")
    covered = each.join(known, ["host", "fp"], "left_semi").groupBy("row").agg(F.collect_list("pos").alias("covered"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [unique_runs([(b["kind"], b["text"]) for b in bs], at or []) for bs, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "text"])

    reduced = rows.select("row", "blocks").join(covered, "row", "left").mapInArrow(kept, "row long, text string")
    reduced = rows.select("row", "page_id", "url").join(reduced, "row").select("page_id", "url", "text")
    article = F.transform(F.filter("blocks", lambda b: b["kind"] == ARTICLE), lambda b: b["text"])
    done = parsed.filter("not open").select("page_id", "url", F.array_join(article, "\n").alias("text")).unionByName(reduced)
    return done.withColumn("n_chars", F.length("text").cast("long"))


def unique_runs(found: list[tuple[int, str]], covered: list[int]) -> str:
    """The article's blocks, and the open ones without the tokens in a covered run; a run starts at each place in ``covered``."""
    sizes = [t.count(" ") + 1 for _, t in found]
    gone = np.zeros(sum(sizes) + RUN, bool)
    for j in range(RUN):
        gone[np.array(covered, np.int64) + j] = True
    out, at = [], 0
    for (kind, text), n in zip(found, sizes, strict=True):
        if kind == ARTICLE:
            out.append(text)
        elif kind == OPEN:
            words = [w for w, g in zip(text.split(" "), gone[at : at + n], strict=True) if not g]
            if words:
                out.append(" ".join(words))
        at += n
    return "\n".join(out)
