"""Main text of web pages, with a suffix array over each host's pages.

A page becomes a stream of words in blocks, each block with what its markup says: inside
an article or main element, inside a part that is never main text (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments), or neither.
The word streams of a host's pages are concatenated and their suffixes sorted by their
first ``RUN`` words (prefix doubling); runs that stand in two or more distinct pages
cover what the host repeats.  A page with an article or main element has its main text
there; on other pages all blocks that are not excluded are open.  Of open blocks, covered
words go and unique runs stay.  Inside an article or main element, words go whose runs
stand on half of the host's distinct pages or more, and on ``LEAST_PAGES`` at least: those
are notices and calls that the host puts into every article.  An article that a host serves
at several addresses is repeated, and still is the main text of each: a page stays whole
if the share ``MIRRORED`` of its main text or more would go.  What markup excludes stays
excluded: a menu drawn up for one page is unique, and still is a menu.

Hosts are cut into shards of about ``SHARD_BYTES`` by a hash of the page id once they are
larger than that, so no task holds more than one shard; sizes are counted with partial
sums by slots of hosts, and pages travel once, as compressed words without markup.
Suffixes are sorted per shard, but repeats are settled for the whole host.  A run on half
of a host's pages is on half of the pages of some shard, so each shard names only such
runs, and the other shards count just these.  Runs on two pages matter for pages without
main text; where a host has such pages, the 64-bit keys of the runs of all its shards are
dealt by key, their pages counted, and those on two or more pages sent back.  The size of
a host or shard does not change a text.

Defined results: null and empty pages give the empty text; text outside all tags is open;
unclosed tags end with their parent; pages without a host are one host together; repeated
rows of one page id are one page when repeats are counted, and share a shard; a
comment or raw element without an end reaches to the end of the page; a tag without an end
is text; an empty table gives an empty result; of columns that the table has besides
``page_id``, ``url`` and ``html`` none is read.  Parsing is linear in the page, whatever
its markup; a page is held whole by its task.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import stored
from holdfast.llm.words import RunHash, mix, span_hash, utf8

SHARD_BYTES = 1 << 20
SLOTS, FLUSH_RUNS, DEAL_BYTES = 1 << 16, 600_000, 16 << 20
RUN = 8
# Inside main text, a run is a notice of the host from so many of its pages, and from half
# of them; a page whose main text has this share of such words or more is a mirror.
LEAST_PAGES, MIRRORED = 4, 0.8
OPEN, MAIN, OUT, OUT_BY_WORD = 0, 1, 2, 3
PAGE_BREAK = "\x1d"  # white space, so no word holds it

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title svg".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
    "nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_PARAGRAPH = BLOCK - {"body", "html", "head"}
# Elements and roles whose text is never main text, and words of class or id that say so.
OUT_TAGS = frozenset("nav aside form footer head menu dialog button select".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices alert sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead comment comments disqus replies reply respond share sharing social "
    "related recommended newsletter subscribe subscription popup modal overlay login signup search "
    "pagination pager widget widgets toolbar skip".split()
)
HEADER_WORDS = frozenset({"header", "topbar"})
# Tokens of a class or id that speak of something else than the element itself.
MODIFIERS = frozenset("has no not with without is open opened closed enabled disabled".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MARKUP = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*+))")
DECLARATION = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?]))")
ATTRIBUTES = re.compile(r"(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+")
QUOTE_OR_END = re.compile(r"['\">]")
LONG_NUMBER = re.compile(r"&#0*+[0-9]{8,}+;?")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.IGNORECASE)
NAME = re.compile(r"[a-z0-9]+")


def _verdict(tag: str, attributes: str, inside_main: bool) -> int:
    """What an element says about the text inside it."""
    if tag in OUT_TAGS or (tag == "header" and not inside_main):
        return OUT
    main = tag in ("article", "main")
    if attributes and tag not in ("html", "body"):
        words: set[str] = set()
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return OUT
            if name == "role":
                if value in OUT_ROLES:
                    return OUT
                main |= value in ("main", "article")
            elif name == "class" or (name == "id" and tag not in HEADINGS):
                for token in value.split():
                    parts = set(NAME.findall(token))
                    if not parts & MODIFIERS:
                        words |= parts
        # reader comments are articles too, inside the article that they are about
        if (not main or inside_main) and (words & OUT_WORDS or (not inside_main and words & HEADER_WORDS)):
            return OUT_BY_WORD
    return MAIN if main else OPEN


class _TagEnds:
    """Finds where a tag ends, in time linear in the page over all its tags.

    A scan that runs into the end of the page marks the quotes that it opened on its way;
    a later scan that opens one of them would go the same way, so it stops there.
    """

    def __init__(self, page: str):
        self.page = page
        self.dead: set[int] = set()
        self.unpaired: set[str] = set()

    def find(self, at: int) -> tuple[int, int]:
        """The place of the ``>`` that ends a tag whose attributes begin at ``at``, or -1 and
        a place up to which no other tag can end either."""
        page = self.page
        if not self.dead:
            end = ATTRIBUTES.match(page, at).end()
            if end < len(page) and page[end] == ">":
                return end, 0
        opened: list[int] = []
        here = at
        while True:
            found = QUOTE_OR_END.search(page, here)
            if found is None:
                break
            here = found.start()
            mark = page[here]
            if mark == ">":
                return here, 0
            opened.append(here)
            if here in self.dead or mark in self.unpaired:
                break
            here = page.find(mark, here + 1) + 1
            if not here:
                self.unpaired.add(mark)
                break
        self.dead.update(opened)
        if not opened:
            return -1, len(page)
        # the name of another tag may begin before the quote and hold it
        last = opened[0]
        while last > at and not (page[last - 1].isspace() or page[last - 1] == "/"):
            last -= 1
        return -1, last


def _unescaped(text: str) -> str:
    """The text with character references decoded; numbers beyond Unicode are U+FFFD."""
    if "&" not in text:
        return text
    return html.unescape(LONG_NUMBER.sub(_number, text) if "&#" in text else text)


def _number(found: re.Match) -> str:
    digits = found[0].strip("&#;").lstrip("0")
    return f"&#{digits};" if len(digits) < 8 else "\ufffd"


def page_blocks(page: str) -> list[tuple[int, list[str]]]:
    """The page's blocks in order: their verdict and their words."""
    blocks: list[tuple[int, list[str]]] = []
    stack: list[tuple[str, int]] = []
    open_names: dict[str, int] = {}
    block_places: list[int] = []  # places in the stack of block elements
    word_places: list[int] = []  # and of elements that their class words exclude
    depth = [0, 0, 0, 0]
    parts: list[str] = []
    ends = _TagEnds(page)
    last_end, last_cdata = page.rfind(">"), page.rfind("]]>")

    def flush() -> None:
        words = _unescaped("".join(parts)).split()
        parts.clear()
        if words:
            blocks.append((OUT if depth[OUT] or depth[OUT_BY_WORD] else MAIN if depth[MAIN] else OPEN, words))

    def close(to: int) -> None:
        while len(stack) > to:
            name, verdict = stack.pop()
            depth[verdict] -= 1
            open_names[name] -= 1
        while block_places and block_places[-1] >= to:
            block_places.pop()
        while word_places and word_places[-1] >= to:
            word_places.pop()

    at = begin = 0  # text from ``begin`` on is not taken yet
    barren = 0  # no tag that starts before has an end
    while True:
        if at < barren:
            found = DECLARATION.search(page, at, barren + 8)
            if found is None or found.start() >= barren:
                at = barren
                continue
        else:
            found = MARKUP.search(page, at)
        if found is None:
            parts.append(page[begin:])
            break
        start, at = found.span()
        if found[1]:
            end = page.find("-->", at)
            parts.append(page[begin:start])
            begin = at = end + 3 if end >= 0 else len(page)
            continue
        if found[2] and at <= last_cdata:
            end = page.find("]]>", at)
            parts.append(page[begin:start])
            parts.append(html.escape(page[at:end], quote=False))
            begin = at = end + 3
            continue
        if found[2] or found[3]:
            if at <= last_end:
                parts.append(page[begin:start])
                begin = at = page.find(">", at) + 1
            continue
        tag = found[5].lower()
        end, least = ends.find(at)
        if end < 0:
            barren, at = max(at, least), start + 1
            continue
        parts.append(page[begin:start])
        attributes = page[at:end]
        begin = at = end + 1
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if found[4]:
            if open_names.get(tag):
                place = len(stack) - 1
                while stack[place][0] != tag:
                    place -= 1
                close(place)
            continue
        if tag in RAW and not attributes.endswith("/"):
            closer = re.compile(rf"</{re.escape(tag)}\b", re.IGNORECASE).search(page, at)
            end = page.find(">", closer.end()) if closer else -1
            begin = at = end + 1 if end >= 0 else len(page)
            continue
        if tag in VOID or tag in RAW:
            continue
        if tag == "body":
            close(0)
        elif tag in ENDS_PARAGRAPH and block_places:
            name = stack[block_places[-1]][0]
            if name == "p" or (name == tag and tag in ("li", "dt", "dd", "tr", "td", "th")):
                close(block_places[-1])
        if tag == "main" and word_places:
            # the wrapper of a main element is not what its class words say
            for place in word_places:
                stack[place] = (stack[place][0], OPEN)
            depth[OPEN] += len(word_places)
            depth[OUT_BY_WORD] = 0
            word_places.clear()
        verdict = _verdict(tag, attributes, depth[MAIN] > 0)
        if tag in BLOCK:
            block_places.append(len(stack))
        if verdict == OUT_BY_WORD:
            word_places.append(len(stack))
        stack.append((tag, verdict))
        open_names[tag] = open_names.get(tag, 0) + 1
        depth[verdict] += 1
    flush()
    return blocks


def run_pages(tokens: np.ndarray, pages: np.ndarray, run: int = RUN) -> np.ndarray:
    """For each token, the number of distinct pages that have the run of ``run`` tokens
    that starts there; 0 where a run would cross a page border.

    Sorts all suffixes by their first ``run`` tokens, doubling the sorted length until it
    is reached.
    """
    n = len(tokens)
    counts = np.zeros(n, np.int64)
    if n < run:
        return counts
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    done = 1
    while done < run:
        step = min(done, run - done)
        later = np.zeros(n, np.int64)
        later[:-step] = rank[step:]
        rank = np.unique(rank * (n + 2) + later, return_inverse=True)[1].astype(np.int64) + 1
        done += step
    starts = np.flatnonzero(pages[: n - run + 1] == pages[run - 1 :])
    order = starts[np.lexsort((pages[starts], rank[starts]))]
    if not len(order):
        return counts
    new = np.ones(len(order), bool)
    new[1:] = rank[order][1:] != rank[order][:-1]
    other = new.copy()
    other[1:] |= pages[order][1:] != pages[order][:-1]
    group = np.cumsum(new) - 1
    counts[order] = np.bincount(group, other).astype(np.int64)[group]
    return counts


def cover(chosen: np.ndarray, run: int = RUN) -> np.ndarray:
    """Marks the tokens of the runs that start where ``chosen`` is true."""
    steps = np.zeros(len(chosen) + run + 1, np.int64)
    begins = np.flatnonzero(chosen)
    np.add.at(steps, begins, 1)
    np.add.at(steps, begins + run, -1)
    return np.cumsum(steps)[: len(chosen)] > 0


def repeated_words(tokens: np.ndarray, pages: np.ndarray, run: int = RUN) -> np.ndarray:
    """Marks the tokens in runs of ``run`` tokens that stand in two or more pages."""
    return cover(run_pages(tokens, pages, run) >= 2, run)


def _window_keys(words: list[str], owner: np.ndarray, salts: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of ``run`` words with one owner, and their hashes with the owner's salt."""
    start = np.flatnonzero(owner[: max(0, len(owner) - run + 1)] == owner[run - 1 :])
    if not len(start):
        return start, np.zeros(0, np.uint64)
    data, bounds = utf8(pa.array(words, pa.large_string()))
    runs = RunHash(span_hash(data).of(bounds[:-1], bounds[1:]))
    return start, mix(runs.of(start, start + run) ^ salts[owner[start]])


def _salt(host: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(host.encode(), digest_size=8).digest(), "little"))


Blocks = list[tuple[int, list[str]]]


@dataclass
class Shard:
    """The word streams of some pages end to end."""

    parsed: list[Blocks]
    words: list[str]
    owner: np.ndarray  # the page of each word; rows of one page id are one page
    pages: int

    @staticmethod
    def of(parsed: list[Blocks], page_ids: list) -> Shard:
        numbers = {p: k for k, p in enumerate(dict.fromkeys(page_ids))}
        sizes = [sum(len(found) for _, found in blocks) for blocks in parsed]
        owner = np.repeat(np.array([numbers[p] for p in page_ids], np.int64), sizes)
        return Shard(parsed, [w for blocks in parsed for _, found in blocks for w in found], owner, len(numbers))

    def run_pages(self, run: int) -> np.ndarray:
        ids: dict[str, int] = {}
        return run_pages(np.array([ids.setdefault(w, len(ids)) for w in self.words], np.int64), self.owner, run)

    def keys(self, host: str, run: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the runs inside pages, and their keys."""
        return _window_keys(self.words, self.owner, np.full(self.pages, _salt(host)), run)

    def has_open(self) -> bool:
        """Whether a page without main text has open blocks."""
        said = [{v for v, _ in blocks} for blocks in self.parsed]
        return any(OPEN in x and MAIN not in x for x in said)

    def texts(self, repeated: np.ndarray, often: np.ndarray) -> list[str]:
        """Main texts, given the words of runs on two pages and of the host's notices."""
        out, at = [], 0
        for blocks in self.parsed:
            ends = at + np.cumsum([len(words) for _, words in blocks], dtype=np.int64)
            mains = [often[e - len(words) : e] for e, (v, words) in zip(ends, blocks, strict=True) if v == MAIN]
            share = np.concatenate(mains).mean() if mains else 0.0
            wanted, covered = (MAIN, often if share < MIRRORED else None) if mains else (OPEN, repeated)
            lines = []
            for verdict, words in blocks:
                if verdict == wanted:
                    marks = covered[at : at + len(words)].tolist() if covered is not None else [False] * len(words)
                    kept = [w for w, gone in zip(words, marks, strict=True) if not gone]
                    if kept:
                        lines.append(" ".join(kept))
                at += len(words)
            out.append("\n".join(lines))
        return out


def shard_texts(pages: list[str], page_ids: list, run: int = RUN, least_pages: int = LEAST_PAGES) -> list[str]:
    """Main texts of all pages of one host."""
    return _host_texts([page_blocks(p) for p in pages], page_ids, run, least_pages)


def _host_texts(parsed: list[Blocks], page_ids: list, run: int, least_pages: int) -> list[str]:
    shard = Shard.of(parsed, page_ids)
    counts = shard.run_pages(run)
    often = max(least_pages, -(-shard.pages // 2))
    return shard.texts(cover(counts >= 2, run), cover(counts >= often, run))


def _pack(blocks: Blocks) -> str:
    """A line for each block: its verdict and its words (no word holds white space)."""
    return "\n".join(f"{verdict}{' '.join(words)}" for verdict, words in blocks)


def _unpack(page: str) -> Blocks:
    return [(int(line[0]), line[1:].split(" ")) for line in page.split("\n")] if page else []


def _squeezed(text: str) -> bytes:
    raw = text.encode()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def _unsqueezed(data: bytes) -> str:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True).decode()


def _dealt(pages: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    """(page_id, url, html, host, shard, is_split) of all rows, and the html bytes of split hosts.

    Shards are given by slots, of which there are at most ``SLOTS``, so their table can be
    broadcast; a host that shares its slot with a large one is split with it.
    """
    host = F.lower(
        F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)
    )
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("host"), F.lit(SLOTS)).cast("int"))
    sizes = rows.groupBy("slot").agg(F.sum(F.octet_length("html")).alias("bytes"))
    large = stored(sizes.where(F.col("bytes") > shard_bytes))
    total = large.agg(F.sum("bytes")).first()[0] or 0
    shards = large.select("slot", F.ceil(F.col("bytes") / shard_bytes).cast("int").alias("shards"))
    dealt = rows.join(F.broadcast(shards), "slot", "left").select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        "html",
        "host",
        F.pmod(F.xxhash64("page_id"), F.coalesce("shards", F.lit(1))).cast("int").alias("shard"),
        F.col("shards").isNotNull().alias("is_split"),
    )
    return dealt, total


def _parsed(rows: DataFrame) -> DataFrame:
    """(page_id, url, host, shard, blocks): pages as their blocks of words, compressed."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [_squeezed(_pack(page_blocks(x))) for x in batch.column("html").to_pylist()]
            at = batch.schema.get_field_index("html")
            yield batch.set_column(at, "blocks", pa.array(blocks, pa.binary()))

    columns = rows.select("page_id", "url", "host", "shard", "html")
    return columns.mapInArrow(parse, "page_id bigint, url string, host string, shard int, blocks binary")


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one shard after the other, of rows sorted by host and shard."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (held[0]["host"], held[0]["shard"]) != (row["host"], row["shard"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def shard_rows(parsed: DataFrame, run: int) -> DataFrame:
    """One row for each shard: its pages' blocks, the number of its distinct pages, and the
    runs that a quarter of them or more have (``near``), from a suffix array."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_shard(batches):
            packed = [_unsqueezed(r["blocks"]) for r in rows]
            ids = [r["page_id"] for r in rows]
            shard = Shard.of([_unpack(x) for x in packed], ids)
            counts = shard.run_pages(run)
            near, pages = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if len(counts) and 4 * counts.max() >= shard.pages:
                start, key = shard.keys(rows[0]["host"], run)
                chosen = 4 * counts[start] >= shard.pages
                near, first = np.unique(key[chosen], return_index=True)
                pages = counts[start[chosen][first]]
            yield pa.RecordBatch.from_pydict(
                {
                    "host": [rows[0]["host"]],
                    "shard": pa.array([rows[0]["shard"]], pa.int32()),
                    "pages": [shard.pages],
                    "has_open": [shard.has_open()],
                    "near": pa.array([near.view(np.int64)], pa.list_(pa.int64())),
                    "near_pages": pa.array([pages], pa.list_(pa.int64())),
                    "ids": pa.array([ids], pa.list_(pa.int64())),
                    "urls": pa.array([[r["url"] for r in rows]], pa.list_(pa.string())),
                    "blocks": pa.array([_squeezed(PAGE_BREAK.join(packed))], pa.binary()),
                }
            )

    return (
        parsed.repartition("host", "shard")
        .sortWithinPartitions("host", "shard")
        .mapInArrow(
            gather,
            "host string, shard int, pages bigint, has_open boolean, near array<bigint>, "
            "near_pages array<bigint>, ids array<bigint>, urls array<string>, blocks binary",
        )
    )


def _shard_of(row: dict) -> Shard:
    return Shard.of([_unpack(x) for x in _unsqueezed(row["blocks"]).split(PAGE_BREAK)], row["ids"])


def host_notices(shards: DataFrame, run: int, least_pages: int) -> DataFrame:
    """(host, notices): the runs that half of the host's distinct pages have.

    By pigeonhole such a run is on half of the pages of some shard.  Only these are named
    to all shards of the host, which count them exactly.
    """
    hosts = shards.groupBy("host").agg(F.sum("pages").alias("host_pages"))
    pairs = F.explode(F.arrays_zip("near", "near_pages")).alias("x")
    half = shards.select("host", "pages", pairs).where(2 * F.col("x.near_pages") >= F.col("pages"))
    named = half.groupBy("host").agg(F.collect_set("x.near").alias("named"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                named = np.sort(np.array(row["named"], np.int64).view(np.uint64))
                pages = np.zeros(len(named), np.int64)
                near = np.array(row["near"], np.int64).view(np.uint64)
                at = np.minimum(np.searchsorted(near, named), max(0, len(near) - 1))
                told = near[at] == named if len(near) else np.zeros(len(named), bool)
                pages[told] = np.array(row["near_pages"], np.int64)[at[told]]
                if not told.all():
                    shard = _shard_of(row)
                    start, key = shard.keys(row["host"], run)
                    asked = named[~told]
                    place = np.minimum(np.searchsorted(asked, key), len(asked) - 1)
                    hit = asked[place] == key
                    seen = np.unique(place[hit] * shard.pages + shard.owner[start[hit]])
                    pages[~told] = np.bincount(seen // shard.pages, minlength=len(asked))
                some = pages > 0
                yield pa.RecordBatch.from_pydict(
                    {
                        "host": pa.array([row["host"]] * int(some.sum()), pa.string()),
                        "key": pa.array(named[some].view(np.int64), pa.int64()),
                        "pages": pa.array(pages[some], pa.int64()),
                    }
                )

    asked = shards.select("host", "near", "near_pages", "ids", "blocks").join(stored(named), "host")
    counted = asked.mapInArrow(count, "host string, key bigint, pages bigint")
    counted = counted.groupBy("host", "key").agg(F.sum("pages").alias("pages"))
    often = (2 * F.col("pages") >= F.col("host_pages")) & (F.col("pages") >= least_pages)
    return counted.join(hosts, "host").where(often).groupBy("host").agg(F.collect_list("key").alias("notices"))


def known_runs(shards: DataFrame, total: int, run: int) -> DataFrame:
    """(host, shard, known): of the runs of each shard, those that two or more pages of the
    host have.

    Each shard sends a key once, with its number of pages there; blocks of keys are dealt
    by key and added up, and only what repeats is sent back.
    """
    spark = shards.sparkSession
    deals = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // DEAL_BYTES))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        places: dict[tuple[str, int], int] = {}
        page = size = 0
        for batch in batches:
            for row in batch.to_pylist():
                shard = _shard_of(row)
                start, key = shard.keys(row["host"], run)
                group = places.setdefault((row["host"], row["shard"]), len(places))
                held.append((key, page + shard.owner[start], np.full(len(key), group)))
                page, size = page + shard.pages, size + len(key)
                if size >= FLUSH_RUNS:
                    yield _run_blocks(held, places, deals)
                    held, places, size = [], {}, 0
        if held:
            yield _run_blocks(held, places, deals)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, groups, counts = [], [], []
        places: dict[tuple[str, int], int] = {}
        for batch in batches:
            for row in batch.to_pylist():
                names = [
                    places.setdefault(x, len(places)) for x in zip(row["hosts"], row["shards"], strict=True)
                ]
                key, group, count = _unpacked(row["block"])
                keys.append(key)
                groups.append(np.array(names, np.int32)[group])
                counts.append(count)
        if not keys:
            return
        key, group, count = np.concatenate(keys), np.concatenate(groups), np.concatenate(counts)
        del keys, groups, counts
        order = np.lexsort((group, key))
        key, group, count = key[order], group[order], count[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        of_key = np.cumsum(new) - 1
        pages = np.bincount(of_key, count).astype(np.int64)[of_key]
        other = new.copy()
        other[1:] |= group[1:] != group[:-1]
        kept = np.flatnonzero(other & (pages >= 2))
        kept = kept[np.argsort(group[kept], kind="stable")]
        names = list(places)
        found, heads = np.unique(group[kept], return_index=True)
        for g, part in zip(found.tolist(), np.split(kept, heads[1:]), strict=False):
            host, shard = names[g]
            packed = _packed(key[part], np.zeros(0, np.uint16), pages[part])
            yield pa.RecordBatch.from_arrays(
                [pa.array([host]), pa.array([shard], pa.int32()), pa.array([packed], pa.binary())],
                names=["host", "shard", "block"],
            )

    packed = "deal int, hosts array<string>, shards array<int>, block binary"
    blocks = shards.select("host", "shard", "ids", "blocks").mapInArrow(cut, packed)
    met = blocks.repartitionById(deals, F.col("deal")).mapInArrow(meet, "host string, shard int, block binary")
    return met.groupBy("host", "shard").agg(F.collect_list("block").alias("known"))


def _run_blocks(held: list, places: dict[tuple[str, int], int], deals: int) -> pa.RecordBatch:
    """One block for each deal: distinct keys of each shard and their pages."""
    key, page, group = (np.concatenate([h[k] for h in held]) for k in range(3))
    order = np.lexsort((page, group, key))
    key, page, group = key[order], page[order], group[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
    other = new.copy()
    other[1:] |= page[1:] != page[:-1]
    count = np.bincount(np.cumsum(new) - 1, other).astype(np.int64) if len(key) else np.zeros(0, np.int64)
    key, group = key[new], group[new]
    deal = (key % np.uint64(deals)).astype(np.int64)
    order = np.argsort(deal, kind="stable")
    found, heads = np.unique(deal[order], return_index=True)
    names = list(places)
    rows: list[tuple] = []
    for d, part in zip(found.tolist(), np.split(order, heads[1:]), strict=False):
        used, at = np.unique(group[part], return_inverse=True)
        mine = [names[g] for g in used.tolist()]
        rows.append((d, [m[0] for m in mine], [m[1] for m in mine], _packed(key[part], at, count[part])))
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = (pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["deal", "hosts", "shards", "block"]
    )


def _packed(key: np.ndarray, group: np.ndarray, count: np.ndarray) -> bytes:
    """Ascending keys by byte places, groups and counts, compressed."""
    planes = np.ascontiguousarray(key.view(np.uint8).reshape(-1, 8).T).tobytes()
    body = b"".join((planes, count.astype(np.uint32).tobytes(), group.astype(np.uint32).tobytes()))
    head = np.array([len(key), len(body)], np.uint32).tobytes()
    return head + pa.Codec("zstd", compression_level=1).compress(body, asbytes=True)


def _unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, size = np.frombuffer(block, np.uint32, 2).tolist()
    body = pa.Codec("zstd").decompress(block[8:], decompressed_size=size, asbytes=True)
    key = np.ascontiguousarray(np.frombuffer(body, np.uint8, 8 * n).reshape(8, n).T).view(np.uint64).ravel()
    return key, np.frombuffer(body, np.uint32, -1, 12 * n), np.frombuffer(body, np.uint32, n, 8 * n)


def extract_text(
    pages: DataFrame, run: int = RUN, shard_bytes: int = SHARD_BYTES, least_pages: int = LEAST_PAGES
) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html).

    A notice inside main text is a run of ``run`` words on half of a host's distinct pages,
    and on ``least_pages`` at least.
    """

    def whole_hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_shard(batches):
            ids = [r["page_id"] for r in rows]
            parsed = [_unpack(_unsqueezed(r["blocks"])) for r in rows]
            yield _result(ids, [r["url"] for r in rows], _host_texts(parsed, ids, run, least_pages))

    def split_hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = _shard_of(row)
                repeated = often = np.zeros(len(shard.words), bool)
                if row["notices"] or row["known"]:
                    start, key = shard.keys(row["host"], run)
                    often = _covered(start, key, np.array(row["notices"] or [], np.int64).view(np.uint64), often, run)
                    blocks = [_unpacked(x)[0] for x in row["known"] or []]
                    if blocks:
                        repeated = _covered(start, key, np.concatenate(blocks), repeated, run)
                yield _result(row["ids"], row["urls"], shard.texts(repeated, often))

    kinds = "page_id bigint, url string, text string, n_chars bigint"
    dealt, total = _dealt(pages, shard_bytes)
    whole = _parsed(dealt.where("not is_split")).repartition("host").sortWithinPartitions("host")
    texts = whole.mapInArrow(whole_hosts, kinds)
    if not total:
        return texts
    shards = stored(shard_rows(_parsed(dealt.where("is_split")), run))
    rows = shards.select("host", "shard", "ids", "urls", "blocks")
    rows = rows.join(stored(host_notices(shards, run, least_pages)), "host", "left")
    open_hosts = stored(shards.where("has_open").select("host").distinct())
    if open_hosts.isEmpty():
        rows = rows.withColumn("known", F.lit(None).cast("array<binary>"))
    else:
        known = stored(known_runs(shards.join(open_hosts, "host", "left_semi"), total, run))
        rows = rows.join(known, ["host", "shard"], "left")
    return texts.unionByName(rows.mapInArrow(split_hosts, kinds))


def _covered(start: np.ndarray, key: np.ndarray, chosen: np.ndarray, none: np.ndarray, run: int) -> np.ndarray:
    """Marks the words of the runs whose keys are chosen."""
    begins = none.copy()
    begins[start[np.isin(key, chosen)]] = True
    return cover(begins, run)


def _result(ids: list, urls: list, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array(urls, pa.string()),
            pa.array(texts, pa.string()),
            pa.array([len(t) for t in texts], pa.int64()),
        ],
        names=["page_id", "url", "text", "n_chars"],
    )
