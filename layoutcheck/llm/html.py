"""Main text of web pages by removal of site templates.

Every block element, in the article or not, is a subtree with a hash of its tags and text.
Spark counts on how many pages of a host with different texts each subtree
occurs; those that recur on many are the site's template and are deleted. Of what is left, parts
that say by tag, class, id or role that they are no main text go too, whatever
their count, for a host with few pages shows no template.

A page whose text no deletion changes is printed where it is read; a bit map of
the others says which pages travel to their deletions.
"""

import re
import zlib
from hashlib import blake2b
from html import unescape
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layoutcheck.llm.shared import Scratch, small_batches, task

#: A template's subtree occurs on so many pages of its host at least, whatever the host's size; pages of equal text count once.
MIN_PAGES = 10
#: log2 of the bits of the map of pages that change: eight for each page, from 128 KB to 64 MB. A page that hits another's bit only travels needlessly.
LEAST_BITS, MOST_BITS = 20, 29

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)""", re.I)
_WORDS = re.compile(r"[a-z0-9]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_NEVER = frozenset("head script style noscript template svg math iframe object canvas audio video form button select textarea nav footer aside dialog menu title xmp noembed noframes".split())
#: Elements that do not end a block of text.
_FLOWING = _INLINE | frozenset("script style noscript template svg math iframe object canvas audio video button select textarea".split())
_MAIN = frozenset(("article", "main"))
_WHOLE = frozenset(("html", "body", "head"))
#: Elements that recur in articles by chance, as parts of a text, list or table: several articles may begin with one line.
_PARTS = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote li dt dd tr td th".split())
#: Words of a class, id or role that mark no main text, anywhere and outside the article.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus respond reply share sharing social related recommended newsletter subscribe subscription signup login widget toolbar pagination pager search complementary contentinfo footer".split()
)
_MARKS_OUTSIDE = frozenset("header masthead topbar toc copyright".split())
#: An opening tag ends these open elements, up to the given bounds.
_CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
_P_BOUNDS = frozenset("article main section div nav aside footer header td th li body html table form blockquote button".split())


class _Open:
    """An open element: where its output begins, what it holds for its hash, and what it is."""

    __slots__ = ("tag", "at", "held", "skip", "main", "guards")

    def __init__(self, tag, at, skip, main):
        self.tag, self.at, self.held, self.skip, self.main, self.guards = tag, at, [], skip, main, False


def walk(page: str, drop: frozenset = frozenset(), hashes: tuple[list, list] | None = None) -> str:
    """The page's main text without the subtrees whose hash is in ``drop``.

    hashes: two lists that get the hashes of subtrees that may be dropped and put
    text into the result as it is, and of those that would if its article went.
    """
    inside: list[int] = []
    outside: list[int] = []
    out: list[str] = []  # text; block ends as a space
    main_out: list[str] = []
    stack = [_Open("", 0, False, False)]

    def text(s: str) -> None:
        top = stack[-1]
        top.held.append(s)
        if not top.skip:
            (main_out if top.main else out).append(s)

    def end() -> None:
        e, up = stack.pop(), stack[-1]
        digest = blake2b(("\0".join((e.tag, *e.held))).encode("utf-8", "surrogatepass"), digest_size=8).digest()
        up.held.append(digest.hex())
        container = e.main and e.tag in _MAIN
        up.guards |= e.guards or container
        if not container and not e.guards and e.tag not in _WHOLE and e.tag not in _INLINE and not (e.main and e.tag in _PARTS):
            key, to = int.from_bytes(digest, "little", signed=True), main_out if e.main else out
            if hashes is not None and any(not s.isspace() and s for s in islice(to, e.at, None)):
                (inside if e.main else outside).append(key)
            if key in drop:
                del to[e.at :]
        if not up.skip and e.tag not in _FLOWING:
            (main_out if up.main or e.main else out).append(" ")

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            end()

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(unescape(page[at:]))
            break
        if m.start() > at:
            text(unescape(page[at : m.start()]))
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], (m[3] if m[2] else m[6]) or ""
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close_to(depth)
                    break
            continue
        if tag in _CLOSES:
            ends, bounds = _CLOSES[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in bounds:
                    break
                if stack[depth].tag in ends:
                    close_to(depth)
                    break
        elif tag not in _INLINE and tag not in _VOID:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    close_to(depth)
                    break
                if stack[depth].tag in _P_BOUNDS:
                    break
        top = stack[-1]
        if tag in _VOID:
            if tag in ("br", "hr"):
                text(" ")
            continue
        words = {w for _, v in _NAMES.findall(attributes) for w in _WORDS.findall(v.lower())} if "=" in attributes else ()
        skip = top.skip or tag in _NEVER or bool(attributes and _HIDDEN.search(attributes)) or bool(words and not _MARKS.isdisjoint(words) and tag not in ("html", "body", "main"))
        if not skip and not top.main:
            skip = tag == "header" or bool(words and not _MARKS_OUTSIDE.isdisjoint(words) and tag not in ("html", "body", "main"))
        if not top.skip and tag not in _FLOWING:
            (main_out if top.main else out).append(" ")
        main = not skip and (top.main or tag in _MAIN)
        stack.append(_Open(tag, len(main_out if main else out), skip, main))
        if tag in _RAW:
            m = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            stop = m.start() if m else n
            stack[-1].held.append(page[at:stop])
            at = stop
        elif attributes.rstrip().endswith("/") and tag in ("svg", "path"):
            end()
    close_to(1)
    text = " ".join("".join(main_out).split())
    if hashes is not None:
        hashes[0].extend(inside if text else outside)
        hashes[1].extend(outside if text else [])
    return text or " ".join("".join(out).split())


def host_of(url: str | None) -> str:
    """The host of a URL in lower case, without user and port; of a null or other string what there is."""
    rest = (url or "").split("://", 1)[-1]
    return re.split(r"[/?#\\]", rest, maxsplit=1)[0].rpartition("@")[2].partition(":")[0].lower()


def _hash(s: str) -> int:
    return int.from_bytes(blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _hasher(batches):
    for batch in batches:
        uids, hosts, marks, keys, others = [], [], [], [], []
        for uid, url, page in zip(batch.column("uid").to_pylist(), batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            own: tuple[list, list] = ([], [])
            marks.append(_hash(walk(page or "", hashes=own)))
            uids.append(uid)
            hosts.append(_hash(host_of(url)))
            keys.append(sorted(set(own[0])))
            others.append(sorted(set(own[1]) - set(own[0])))
        yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(hosts, pa.int64()), pa.array(marks, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(others, pa.list_(pa.int64()))], ["uid", "host", "mark", "keys", "others"])


def _splitter(columns: list[str], changes, changed: bool):
    """Either pages that no deletion changes, with their text, or all others, compressed."""

    def run(batches):
        bits = np.frombuffer(changes.value, np.uint8)
        for batch in batches:
            at = np.asarray(batch.column("place")).astype(np.int64)
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            batch = batch.filter(pa.array(hit if changed else ~hit))
            pages = [page or "" for page in batch.column("html").to_pylist()]
            made = pa.array([zlib.compress(page.encode("utf-8", "surrogatepass"), 6) for page in pages], pa.binary()) if changed else pa.array(map(walk, pages), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), made], [*columns, "packed" if changed else "text"])

    return run


def _extractor(columns: list[str]):
    def run(batches):
        for batch in batches:
            drops = batch.column("drop").to_pylist()
            texts = [walk(zlib.decompress(page.as_buffer()).decode("utf-8", "surrogatepass"), frozenset(drop or ())) for page, drop in zip(batch.column("packed"), drops)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(texts, pa.string())], [*columns, "text"])

    return run


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    A null or empty page has the empty text; a null URL is a host of its own
    (the empty one). The article and what holds it are never deleted, nor is an
    inline element by itself, nor a heading, paragraph, list item, table row or
    cell of the article by itself; boxes in it are, like all outside. Pages of one host with equal
    texts (before deletion) count as one; repeated rows each get their text; rows of one id with different pages are pages of their own.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "html")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    rows = rows.withColumn("uid", F.xxhash64("page_id", "url", "html"))
    seen = scratch.keep(rows.select("uid", "url", "html").mapInArrow(task(_hasher), "uid long, host long, mark long, keys array<long>, others array<long>"), "subtrees")
    once = seen.dropDuplicates(["uid"])
    own = once.select("uid", "host", "mark", F.explode(F.concat(F.transform("keys", lambda k: F.struct(k.alias("key"), F.lit(True).alias("shown"))), F.transform("others", lambda k: F.struct(k.alias("key"), F.lit(False).alias("shown"))))).alias("k")).select("uid", "host", "mark", "k.*")
    often = own.select("host", "key", "mark").distinct().groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("host", "key")
    drops = own.join(often, ["host", "key"], "left_semi").groupBy("uid").agg(F.collect_list("key").alias("drop"), F.max("shown").alias("shown")).where("shown").select("uid", "drop")
    drops = scratch.keep(drops, "drops")
    width = int(min(max(np.ceil(np.log2(max(8 * seen.count(), 1))), LEAST_BITS), MOST_BITS))
    place = F.pmod("uid", F.lit(1 << width)).cast("int")
    bits = bytearray(1 << width - 3)
    got = drops.select(place.alias("place")).selectExpr("place div 64 AS word", "shiftleft(1L, place % 64) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # a word for each 64 bits at most
    np.frombuffer(bits, np.uint64)[np.asarray(got.column("word"))] = np.asarray(got.column("bits")).view(np.uint64)
    changes = spark.sparkContext.broadcast(bits)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    named = f"page_id {kinds['page_id']}, url {kinds['url']}"
    placed = rows.withColumn("place", place)
    same = placed.mapInArrow(task(_splitter(["page_id", "url"], changes, False)), f"{named}, text string")
    sent = placed.mapInArrow(task(_splitter(["page_id", "url", "uid"], changes, True)), f"{named}, uid long, packed binary")
    cut = sent.join(drops, "uid", "left").select("page_id", "url", "packed", "drop").mapInArrow(_extractor(["page_id", "url"]), f"{named}, text string")
    done = same.union(cut)
    return done.withColumn("n_chars", F.length("text").cast("long"))
