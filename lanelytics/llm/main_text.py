"""Main text of web pages: host suffix arrays find what repeats across pages, page structure decides the rest.

A page is read as blocks of words.  The word streams of the pages of one host
are concatenated, and suffixes are ranked by prefix doubling until runs of
``RUN`` words are told apart.  Runs of equal rank on distinct pages, and short
blocks that stand alone on distinct pages, are boilerplate: what they cover is
removed and the runs between are kept.  Pages with the same text count as one
page.

Links and places are evidence besides repetition.  A block that consists of
links for more than half goes where it repeats, in an ``article`` or ``main``
too, and a short one on two pages already; what else repeats in an ``article``
or ``main`` is a copied or quoted article and stays.  So does a repeated
passage of ``PASSAGE`` words without links that stands between unique text.
Beside an ``article`` or ``main`` stays what has at least ``RUN`` words of
which none repeats and is no list of links, if the host has pages enough to
tell.  Elements that are no article by their kind or name (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, reader comments) go even
where they are unique; within an article a name counts only if it says nothing
else (``share-bar``, but not ``share-price``).

Hosts with many or long pages are cut at random into shards of bounded size,
each with an array of its own.  What repeats across the shards of a host is
found by 64-bit hashes of its runs and short blocks, which are dealt out by
hash, matched, and given back to the shards that hold them; so a text does not
depend on the size of its host.  Hosts without a block that repeats can decide
on are spared this.  Null html and pages without text give an empty
text; pages without a host form a host.  Every row gives one row, repeated and
null ids too; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lanelytics.llm.common import batch_of, rows, stored

RUN = 8
#: Pages and code points of a shard on average, and pages on which a short block must stand to be boilerplate.
PAGES, CHARACTERS, SHORT_REPEATS = 256, 4_000_000, 3
#: Words of a repeated block that is a quoted passage where unique text stands before and behind it.
PASSAGE = 100
#: Hashes that a task gathers before it passes them on.
HASHES = 1_000_000
#: Cut hosts that are handed to every task; if there are more, pages are shuffled to them.
BROADCAST_HOSTS = 50_000

#: Fixed values of HTML: elements that begin a block, that have no content, and whose content is no markup.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|noscript|template|iframe|xmp|noframes|svg|canvas|object"
#: Elements that are no part of an article, roles alike, and words by which pages name such parts.
OUTSIDE = frozenset(
    "aside audio button datalist dialog footer form head input label menu nav optgroup option select title video".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
NAMES = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice "
    "notices pager pagination popup promo promotion promotions recommended related replies respond search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Words that a name of such a part may hold besides; within an article no other word may.
NEUTRAL = frozenset(
    "area areas bar bars block blocks body box boxes button buttons card cards container content count counts "
    "entry feed form group holder icon icons inner inline item items label left link links list module panel post "
    "posts right row section slot text thread title top bottom unit wrap wrapper".split()
)
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""", re.I)
#: Elements that a name cannot put outside.
NEVER = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
#: What an opening element closes by itself, and where that ends.
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dd dt", ("dl",)), "dd": ("dd dt", ("dl",)), "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attributes>(?:[^>"']|"[^"]*"|'[^']*')*)>|<[a-z/!?][^>]*(?:>|\Z)""",
    re.S | re.I,
)

#: Zones of blocks; the last two hold links for more than half.
DROPPED, OPEN, ARTICLE, OPEN_LINKS, ARTICLE_LINKS = 0, 1, 2, 3, 4


def _outside(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in OUTSIDE or tag == "header" and not in_article:
        return True
    if not attributes or tag in NEVER:
        return False
    for name, value in NAMED.findall(attributes):
        name = name.lower()
        for part in value.strip("\"' ").split() or [""]:
            words = set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", part).lower()))
            if name == "hidden" or name == "aria-hidden" and "true" in words or name == "role" and words & ROLES:
                return True
            # share-price or notice-of-award name what an article tells of
            if name in ("class", "id") and words & NAMES and (not in_article or words <= NAMES | NEUTRAL):
                return True
    return False


def blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of each block with text, in page order; white space is one space, references are decoded."""
    found: list[tuple[int, str]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, outside, article, link
    held: list[str] = []
    linked: list[str] = []
    outside = article = link = False

    def hold(text: str) -> None:
        held.append(text)
        if link:
            linked.append(text)

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            links = linked and 2 * len("".join(html.unescape("".join(linked)).split())) > len(text.replace(" ", ""))
            inside = (ARTICLE_LINKS if article else OPEN_LINKS) if links else ARTICLE if article else OPEN
            found.append((DROPPED if outside else inside, text))
        linked.clear()

    def pop_to(place: int) -> None:
        nonlocal outside, article, link
        del stack[place:]
        outside, article, link = stack[-1][1:] if stack else (False, False, False)

    def last(tags: tuple[str, ...], until: tuple[str, ...]) -> int:
        for place in range(len(stack) - 1, -1, -1):
            if stack[place][0] in tags:
                return place
            if stack[place][0] in until:
                break
        return -1

    at = 0
    for token in TOKEN.finditer(page):
        if token.start() > at:
            hold(page[at : token.start()])
        at = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if token["end"]:
            place = last((tag,), ())
            if place >= 0:
                if outside != (stack[place - 1][1] if place else False):
                    flush()
                pop_to(place)
            continue
        if tag in BLOCKS and (place := last(("p",), tuple(BLOCKS - {"p"}))) >= 0:
            pop_to(place)
        if tag in CLOSES and (place := last(tuple(CLOSES[tag][0].split()), CLOSES[tag][1])) >= 0:
            pop_to(place)
        if tag not in VOID and not token["attributes"].endswith("/"):
            goes = outside or _outside(tag, token["attributes"], article)
            if goes != outside:
                flush()
            outside, article, link = goes, article or tag in ("article", "main"), link or tag == "a"
            stack.append((tag, outside, article, link))
    hold(page[at:])
    flush()
    return found


def repeated_runs(words: np.ndarray, page: np.ndarray, run: int = RUN) -> np.ndarray:
    """Which words lie in a run of ``run`` (a power of two) words that another page holds as well.

    ``words`` are numbers from 0; pages stand one after the other.
    """
    covered = np.zeros(len(words), bool)
    if not len(words):
        return covered
    rank, length = words.astype(np.int64), 1
    same_page = np.ones(len(words), bool)
    while length < run:
        ahead = np.full(len(words), -1, np.int64)
        ahead[:-length] = rank[length:]
        same_page[:] = False
        same_page[: -2 * length + 1] = page[: -2 * length + 1] == page[2 * length - 1 :]
        pair = np.where(same_page, (rank + 1) * (rank.max() + 2) + ahead + 1, -1 - np.arange(len(words)))
        rank = np.unique(pair, return_inverse=True)[1]
        length *= 2
    order = np.argsort(rank, kind="stable")  # the suffix array, as deep as a run
    first = np.flatnonzero(np.diff(rank[order], prepend=-1))
    pages = page[order]  # in page order within a rank
    last = np.append(first[1:], len(order)) - 1
    repeated = np.zeros(rank.max() + 1, bool)
    repeated[rank[order[first]]] = pages[first] != pages[last]
    starts = np.flatnonzero(repeated[rank] & same_page) if run > 1 else np.flatnonzero(repeated[rank])
    for step in range(run):
        covered[starts + step] = True
    return covered


def _kept(
    page: list[tuple[int, str]], gone: list[np.ndarray], repeats: dict[str, int], enough: bool, run: int
) -> Iterator[str]:
    """What stays of each block, by its repeated words; ``repeats`` are the pages of each short block."""
    has_article = any(zone in (ARTICLE, ARTICLE_LINKS) for zone, _ in page)
    prose = any(zone == ARTICLE for zone, _ in page)
    unique = [k for k, (zone, _) in enumerate(page) if zone == OPEN and len(gone[k]) >= run and not gone[k].all()]
    for k, (zone, text) in enumerate(page):
        words, often = gone[k], repeats.get(text, 0)
        whole = words.all() if len(words) >= run else often > 1
        if zone == ARTICLE or zone == ARTICLE_LINKS and not (whole and prose):
            yield text
        elif zone not in (OPEN, OPEN_LINKS):
            continue
        elif has_article:
            if enough and zone == OPEN and len(words) >= run and not words.any():
                yield text
        elif zone == OPEN and len(words) >= PASSAGE and unique and unique[0] < k < unique[-1] and words.all():
            yield text
        elif often < (2 if zone == OPEN_LINKS else SHORT_REPEATS):
            left = " ".join(word for word, out in zip(text.split(" "), words) if not out) if words.any() else text
            if left:
                yield left


#: Factors of the words of a run; the last three bits of a hash give way to a count of pages.
_FACTORS = np.array([int.from_bytes(blake2b(b"run %d" % k, digest_size=8).digest(), "little") | 1 for k in range(RUN)], np.uint64)
_COUNT = np.uint64(3)


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


#: What every page holds, to count the pages of a host.
_PAGE = np.uint64(_hash("\n") & ~3)


def run_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``RUN`` words of a stream of word hashes."""
    size = max(len(words) - RUN + 1, 0)
    hashes = np.zeros(size, np.uint64)
    for k, factor in enumerate(_FACTORS):
        hashes += words[k : k + size] * factor
    return (hashes ^ (hashes >> np.uint64(29))) & ~_COUNT


def _short_hash(text: str) -> np.uint64:
    return np.uint64(_hash("\n" + text) & ~3)


def page_hashes(page: list[tuple[int, str]], known: dict[str, int]) -> tuple[int, np.ndarray]:
    """A number for the text of a page, and the hashes of its runs and short blocks, once each."""
    for _, text in page:
        for word in text.split(" "):
            if word not in known:
                known[word] = _hash(word)
    words = np.array([known[word] for _, text in page for word in text.split(" ")], np.uint64)
    short = {_short_hash(text) for _, text in page if text.count(" ") < RUN - 1}
    number = _hash("\n".join(f"{zone} {text}" for zone, text in page))
    return number, np.unique(np.concatenate([run_hashes(words), np.array([*short, _PAGE], np.uint64)]))


def repeated_hashes(hashes: np.ndarray, pages: np.ndarray) -> np.ndarray:
    """The hashes on two or more distinct pages, in order, each with min(3, its pages) in its last bits."""
    order = np.lexsort((pages, hashes))
    hashes, pages = hashes[order], pages[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (pages[1:] != pages[:-1])
    found, counts = np.unique(hashes[new], return_counts=True)
    return found[counts > 1] | np.minimum(counts[counts > 1], 3).astype(np.uint64)


def unique_text(pages: list[list[tuple[int, str]]], run: int = RUN, host: np.ndarray | None = None) -> list[str]:
    """Main texts of the pages of a host, from their blocks.

    If these are a shard only, ``host`` holds its hashes that are repeated on the host.
    """
    seen: dict[tuple, int] = {}
    number = [seen.setdefault(tuple(page), len(seen)) for page in pages]
    distinct = list(seen)
    known: dict[str, int] = {}
    streams = [[word for _, text in page for word in text.split(" ")] for page in distinct]
    words = np.array([known.setdefault(word, len(known)) for stream in streams for word in stream], np.int64)
    page_of = np.repeat(np.arange(len(streams)), [len(s) for s in streams])
    covered = repeated_runs(words, page_of, run)
    short: dict[str, set[int]] = {}
    for n, page in enumerate(distinct):
        for _, text in page:
            if text.count(" ") < run - 1:
                short.setdefault(text, set()).add(n)
    repeats = {text: len(pages) for text, pages in short.items()}
    enough = len(distinct) >= SHORT_REPEATS
    if host is not None and len(host):
        counts = dict(zip((host & ~_COUNT).tolist(), (host & _COUNT).tolist()))
        repeats = {text: max(n, counts.get(int(_short_hash(text)), 0)) for text, n in repeats.items()}
        enough = enough or counts.get(int(_PAGE), 0) >= SHORT_REPEATS
        hashed = np.array([_hash(word) for word in known], np.uint64)[words]
        hashes = run_hashes(hashed)
        starts = np.flatnonzero(np.isin(hashes, host & ~_COUNT) & (page_of[: len(hashes)] == page_of[len(words) - len(hashes) :]))
        for step in range(RUN):
            covered[starts + step] = True
    texts, at = [], 0
    for page in distinct:
        gone = []
        for _, text in page:
            size = text.count(" ") + 1
            gone.append(covered[at : at + size])
            at += size
        texts.append("\n".join(_kept(page, gone, repeats, enough, run)))
    return [texts[n] for n in number]


_READ = "page_id long, url string, host string, shard int, zones array<int>, texts array<string>"
_RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("shard", pa.int32())]
        + [("zones", pa.list_(pa.int32())), ("texts", pa.list_(pa.string()))]
    )
    for part in rows(batches):
        found = [blocks(page) for page in part["html"]]
        columns = [part[name] for name in ("page_id", "url", "host", "shard")]
        yield batch_of(schema, *columns, [[z for z, _ in f] for f in found], [[t for _, t in f] for f in found])


_HASHES = pa.schema(
    [("host", pa.string()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("pages", pa.binary()), ("shards", pa.binary())]
)
_REPEATED = pa.schema([("host", pa.string()), ("shard", pa.int32()), ("hashes", pa.binary())])


def _asking(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hosts with a page that has blocks on which repeats decide."""
    found: set[str] = set()
    for part in rows(batches):
        for page, host in zip(part["html"], part["host"]):
            if host not in found and any(zone not in (DROPPED, ARTICLE) for zone, _ in blocks(page)):
                found.add(host)
                yield batch_of(pa.schema([("host", pa.string())]), [host])


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of the pages of cut hosts, in as many buckets as the host has shards."""
    known: dict[str, int] = {}
    held: dict[tuple[str, int], list[tuple[np.ndarray, int, int]]] = defaultdict(list)
    size = 0

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (host, buckets), found in held.items():
            hashes = np.concatenate([h for h, _, _ in found])
            lengths = [len(h) for h, _, _ in found]
            pages = np.repeat(np.array([p for _, p, _ in found], np.uint64), lengths)
            shards = np.repeat(np.array([s for _, _, s in found], np.int32), lengths)
            bucket = (hashes >> np.uint64(8)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            present, first = np.unique(bucket[order], return_index=True)
            cuts = [order[a:b] for a, b in zip(first, [*first[1:], len(order)])]
            columns = [[column[cut].tobytes() for cut in cuts] for column in (hashes, pages, shards)]
            yield batch_of(_HASHES, [host] * len(cuts), present.astype(np.int32), *columns)
        held.clear()

    for part in rows(batches):
        for page, host, shard, buckets in zip(part["html"], part["host"], part["shard"], part["shards"]):
            number, hashes = page_hashes(blocks(page), known)
            held[host, buckets].append((hashes, number, shard))
            size += len(hashes)
        if size >= HASHES:
            yield from passed_on()
            size = 0
        if len(known) > HASHES:
            known.clear()
    yield from passed_on()


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _repeated(bucket: pa.Table) -> pa.Table:
    """The repeated hashes of a bucket for each shard that holds them."""
    hashes, pages, shards = (_joined(bucket[n], k) for n, k in (("hashes", np.uint64), ("pages", np.uint64), ("shards", np.int32)))
    repeated = repeated_hashes(hashes, pages)
    bare = repeated & ~_COUNT
    here = np.flatnonzero(np.isin(hashes, bare))
    full, shards = repeated[np.searchsorted(bare, hashes[here])], shards[here]
    order = np.argsort(shards, kind="stable")
    present, first = np.unique(shards[order], return_index=True)
    cuts = [np.unique(full[order[a:b]]).tobytes() for a, b in zip(first, [*first[1:], len(order)])]
    host = bucket["host"][0].as_py()
    return pa.table([pa.array([host] * len(cuts), pa.string()), pa.array(present, pa.int32()), pa.array(cuts, pa.binary())], schema=_REPEATED)


def _extract(pages: pa.Table, repeated: pa.Table) -> pa.Table:
    pages = pages.select(["page_id", "url", "zones", "texts"]).sort_by([("url", "ascending"), ("page_id", "ascending")])
    texts = unique_text([list(zip(z, t)) for z, t in zip(pages["zones"].to_pylist(), pages["texts"].to_pylist())], host=_joined(repeated["hashes"], np.uint64))
    columns = [pages["page_id"], pages["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
    return pa.table(columns, schema=_RESULT)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""
    pages = pages.select(
        F.col("page_id").cast("long"),
        "url",
        F.coalesce("html", F.lit("")).alias("html"),
        F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
    )
    size = F.greatest(F.ceil(F.count("*") / PAGES), F.ceil(F.sum(F.length("html")) / CHARACTERS)).cast("int")
    cut = stored(pages.groupBy("host").agg(size.alias("shards")).filter("shards > 1"))
    cut = F.broadcast(cut) if cut.count() <= BROADCAST_HOSTS else cut
    shard = F.pmod(F.xxhash64("url", "page_id", "html"), F.coalesce("shards", F.lit(1))).cast("int")
    placed = pages.join(cut, "host", "left").withColumn("shard", shard)
    cut_pages = placed.filter("shards is not null").select("html", "host", "shard", "shards")
    asking = stored(cut_pages.select("host", "html").mapInArrow(_asking, "host string").distinct())
    asking = F.broadcast(asking) if asking.count() <= BROADCAST_HOSTS else asking
    repeated = (
        cut_pages.join(asking, "host", "left_semi")
        .select("html", "host", "shard", "shards")
        .mapInArrow(_hashed, "host string, bucket int, hashes binary, pages binary, shards binary")
        .groupBy("host", "bucket")
        .applyInArrow(_repeated, "host string, shard int, hashes binary")
    )
    return (
        placed.select("page_id", "url", "host", "shard", "html")
        .mapInArrow(_read, _READ)
        .groupBy("host", "shard")
        .cogroup(repeated.groupBy("host", "shard"))
        .applyInArrow(_extract, "page_id long, url string, text string, n_chars long")
    )
