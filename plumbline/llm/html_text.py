"""Main text of web pages by markup zones and host suffix arrays (operator 6).

A page is read into blocks, in page order, each with its zone: main (inside article, main or role=main), open (no zone says
anything) or out (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments, and
everything outside the main zone of a page that has one). Class, id and role count by whole tokens, never on html and body. A
main zone inside an out element, or itself named as one, is main if the page has no other main text. Character references
are decoded, white space inside a block becomes one space, blocks are trimmed and empty ones dropped.

Open blocks need evidence from other pages of the host. Every run of MIN_TOKENS tokens of the host's pages is counted by the
distinct pages that hold it, over the whole host; runs on MIN_PAGES pages mark the tokens they cover. Open blocks that are
covered to COVERED or more are boilerplate; unique runs stay. A page whose open blocks would all go is a copy of other pages
and keeps them, but for blocks that are mostly links. Main blocks stay even if other pages repeat them: an
article that several pages carry is still an article.

The counting is exact at any size and independent of how pages are dealt. Pages are read where they lie, and their blocks
written once. A bitmap of fixed size holds the runs that touch open blocks; groups of a host's pages are counted by a suffix
array with common-prefix lengths (prefix doubling in numpy), and the groups' counts of runs in the bitmap summed by the
64-bit hash of host and run. Without open blocks nothing is counted. Defined results: null and empty html, and pages without main text, give an empty text; a null url
is a host of its own; rows keep their number, repeated rows and null ids included; unclosed and cut-off markup is closed at
the end; columns of the outputs' names are replaced.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import append_columns, bitmap, in_bitmap
from plumbline.llm.shingles import MEMO_WORDS, mix
from plumbline.runtime import materialize

GROUP_PAGES, GROUP_TOKENS = 128, 200_000
MIN_TOKENS, MIN_PAGES, COVERED = 5, 3, 0.8

#: Elements and class words of each role.
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas select".split())
OUT = frozenset("nav footer aside form dialog menu button head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option".split())
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
_OUT_WORD = r"(?:ads?|advert(?:s|isement|ising)?|banner|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|gdpr|notice|newsletter|subscribe|sidebar|side-bar|menu|nav(?:bar|igation)?|breadcrumbs?|footer|masthead|site-header|page-header|comments?|disqus|respond|share|sharing|social|related|popup|modal|widget|login|search)"
_PART = r"(?:area|article|bar|block|blog|bottom|box|container|entry|form|global|inner|item|left|links?|list|main|mobile|outer|page|post|primary|right|secondary|section|site|slot|top|unit|wrap(?:per)?|[0-9]+(?:x[0-9]+)?)"
OUT_WORDS = re.compile(rf"(?:{_PART}[-_]+)*{_OUT_WORD}(?:[-_]+(?:{_PART}|{_OUT_WORD}))*")  # for whole tokens of a class, id or role
NEVER_OUT = frozenset("html body".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ROLE = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_MAIN_ROLE = re.compile(r"""\brole\s*=\s*["']?main\b""", re.I)

MAIN, OPEN, OUTSIDE, SHADED = 0, 1, 2, 3
Block = tuple[str, int, float]  # text, zone, share of link characters


def read_blocks(page: str | None) -> list[Block]:
    """The blocks of a page with their zones."""
    if not page:
        return []
    blocks: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []  # element, is out, is main, how many out elements held the zone around it
    parts: list[str] = []
    linked = 0
    in_link = False
    out = main = shade = 0  # shade: the out elements around the main zone that is open
    any_main = False

    def flush():
        nonlocal linked
        text = " ".join(html_lib.unescape("".join(parts)).split())
        if text:
            zone = OUTSIDE if out > shade else MAIN if main and not shade else SHADED if main else OPEN
            blocks.append((text, zone, linked / max(1, len(text))))
        parts.clear()
        linked = 0

    def pop():
        nonlocal out, main, shade
        _, was_out, was_main, shade = stack.pop()
        out -= was_out
        main -= was_main

    at, n = 0, len(page)
    while at < n:
        i = page.find("<", at)
        if i < 0:
            i = n
        if i > at:
            parts.append(page[at:i])
            if in_link:
                linked += i - at
        if i == n:
            break
        m = _TAG.match(page, i)
        if not m:  # a bare <
            parts.append("<")
            at = i + 1
            continue
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW and not closing:
            if attributes.endswith("/") and name in ("svg", "math"):
                continue
            end = re.compile(f"</{name}", re.I).search(page, at)
            at = end.start() if end else n
            continue
        if name == "a":
            in_link = not closing
        if name in BLOCK:
            flush()
            in_link = False
        elif name == "br":
            parts.append(" ")
        if name in VOID or name in RAW:
            continue
        if closing:
            if any(e[0] == name for e in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        roles = " ".join(v.strip("\"'") for v in _ROLE.findall(attributes)).lower() if attributes else ""
        is_main = name in ("article", "main") or bool(attributes and _MAIN_ROLE.search(attributes))
        named_out = name not in NEVER_OUT and any(map(OUT_WORDS.fullmatch, roles.split()))
        is_out = named_out or not is_main and (name in OUT or name == "header" and not main)
        if name not in BLOCK and not is_out:
            continue
        if name in BLOCK:
            while stack and stack[-1][0] == "p":
                pop()
            if name in SELF_CLOSING and stack and stack[-1][0] == name:
                pop()
        if is_main:
            while stack and any(e[1] and e[0] in ("nav", "header", "head", "menu") for e in stack):
                pop()  # it was left open
            any_main = True
        stack.append((name, is_out, is_main, shade))
        out += is_out
        main += is_main
        if is_main:
            shade = out
    flush()
    if any_main:
        zones = {OPEN: OUTSIDE, SHADED: OUTSIDE if any(z == MAIN for _, z, _ in blocks) else MAIN}
        blocks = [(t, zones.get(z, z), s) for t, z, s in blocks]
    return blocks


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted suffixes and, for each, the length of the prefix that it shares with the one before."""
    n = len(tokens)
    ranks = [np.unique(tokens, return_inverse=True)[1].astype(np.int64)]
    order, k = np.argsort(ranks[0], kind="stable"), 1
    while ranks[-1].max(initial=0) < n - 1:
        r = ranks[-1]
        second = np.full(n, -1, np.int64)
        second[: n - k] = r[k:] if k < n else r[:0]
        key = r * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        ranks.append(new)
        k *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(max(n - 1, 0), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        r = np.append(ranks[level], -1)
        same = (a < n) & (b < n)
        same &= r[np.minimum(a, n)] == r[np.minimum(b, n)]
        step = same * (1 << level)
        a, b, shared = np.minimum(a + step, n), np.minimum(b + step, n), shared + step
    return order, np.concatenate([[0], shared]) if n else shared


class _Runs:
    """The words' hashes of a page, and those of its runs of MIN_TOKENS words, which differ by host."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def __call__(self, host: str, words: str) -> tuple[np.ndarray, np.ndarray]:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo, tokens = self.memo, words.split()
        for w in tokens:
            if w not in memo:
                memo[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))
        h = np.fromiter((memo[w] for w in tokens), np.uint64, len(tokens))
        n = max(0, len(h) - MIN_TOKENS + 1)
        runs = np.full(n, xxhash.xxh3_64_intdigest(host.encode("utf-8", "replace")), np.uint64)
        for i in range(MIN_TOKENS if n else 0):
            runs = mix(runs * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
        return h, runs


def run_pages(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct suffix beginning of MIN_TOKENS: where it first stands in the streams, each of which is followed by a
    separator, and the number of streams that hold it. Beginnings may reach over a separator."""
    tokens = np.unique(np.concatenate(streams), return_inverse=True)[1].astype(np.int64)
    ends = np.cumsum([len(s) for s in streams])
    text = np.insert(tokens, ends, len(tokens) + np.arange(len(streams)))  # separators differ, so nothing spans two pages
    page = np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams])
    order, shared = suffix_array(text)
    first = shared < MIN_TOKENS
    run = np.cumsum(first) - 1  # suffixes with a common prefix of MIN_TOKENS
    pairs = np.unique(run * len(streams) + page[order])
    return order[first], np.bincount(pairs // len(streams), minlength=run[-1] + 1)


def touching(texts: list[str], zones: list[int], n: int) -> np.ndarray:
    """Which of a page's n runs touch an open block."""
    is_open = np.repeat(np.array(zones) == OPEN, [t.count(" ") + 1 for t in texts])
    upto = np.concatenate([[0], np.cumsum(is_open)])
    return upto[MIN_TOKENS : MIN_TOKENS + n] > upto[:n]


def page_text(texts: list[str], zones: list[int], runs: np.ndarray, hot: list[int]) -> str:
    """The main text of a page of which the given runs stand on MIN_PAGES pages of its host."""
    mark = np.zeros(sum(t.count(" ") + 1 for t in texts) + 1, np.int64)
    at = np.flatnonzero(np.isin(runs.view(np.int64), np.array(hot, np.int64)))
    np.add.at(mark, at, 1)
    np.add.at(mark, at + MIN_TOKENS, -1)
    covered = np.cumsum(mark[:-1]) > 0
    at, keep, spare = 0, [], []
    for text, zone in zip(texts, zones, strict=True):
        n = text.count(" ") + 1
        if zone == MAIN or zone == OPEN and covered[at : at + n].mean() < COVERED:
            keep.append(text)
        if zone != OUTSIDE:
            spare.append(text)
        at += n
    return "\n".join(keep or spare)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", text_col: str = "text", chars_col: str = "n_chars", keep_html: bool = True) -> DataFrame:
    """Add the main text of each page and its length in code points."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    hosted = pages.withColumn("__pl_host", host)
    at = hosted.columns.index(html_col)

    def read(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            blocks = [read_blocks(page) for page in batch.column(at).to_pylist()]
            zones = [[OUTSIDE if z == OPEN and links >= 0.5 else z for _, z, links in page] for page in blocks]
            yield batch, [["\n".join(b[0] for b in page) for page in blocks], zones]

    fields = [T.StructField("__pl_words", T.StringType()), T.StructField("__pl_zones", T.ArrayType(T.IntegerType()))]
    blocks = append_columns(hosted, fields, read)
    blocks = materialize(blocks.drop(text_col, chars_col, *([] if keep_html else [html_col])).withColumn("__pl_row", F.monotonically_increasing_id()), "blocks")
    is_open = F.array_contains("__pl_zones", OPEN)
    undecided = blocks.where(is_open).select("__pl_row", "__pl_host", "__pl_words", "__pl_zones")

    def open_runs(bits):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            runs_of = _Runs()
            for batch in batches:
                rows, out = [], []
                for row, at_host, words, zones in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    runs = runs_of(at_host, words)[1]
                    runs = np.unique(runs[touching(words.split("\n"), zones, len(runs))])
                    if bits is not None:
                        runs = runs[in_bitmap(bits.value, runs)]
                    rows.append(np.full(len(runs), row, np.int64))
                    out.append(runs.view(np.int64))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(out))], names=["__pl_row", "h"])

        return undecided.mapInArrow(run, "__pl_row long, h long")

    def share(bits: np.ndarray):
        return pages.sparkSession.sparkContext.broadcast(bits)

    wanted = bitmap(open_runs(None))
    found = blocks.withColumn("__pl_hot", F.lit(None).cast("array<long>"))
    if wanted.any():
        hot = materialize(run_counts(blocks, share(wanted)).where(F.col("n") >= MIN_PAGES).select("h"), "hot-runs")
        of_row = open_runs(share(bitmap(hot))).join(hot, "h").groupBy("__pl_row").agg(F.collect_list("h").alias("__pl_hot"))
        found = found.where(~is_open).unionByName(blocks.where(is_open).join(of_row, "__pl_row", "left"))
    words_at, zones_at, host_at, hot_at = (found.columns.index(f"__pl_{c}") for c in ("words", "zones", "host", "hot"))

    def decide(batches: Iterator[pa.RecordBatch]):
        runs_of = _Runs()
        for batch in batches:
            texts = []
            for words, zones, at_host, hot in zip(*(batch.column(i).to_pylist() for i in (words_at, zones_at, host_at, hot_at)), strict=True):
                of_page = words.split("\n") if words else []
                if hot:
                    texts.append(page_text(of_page, zones, runs_of(at_host, words)[1], hot))
                else:
                    texts.append("\n".join(t for t, z in zip(of_page, zones, strict=True) if z != OUTSIDE))
            yield batch, [texts, [len(t) for t in texts]]

    out = append_columns(found, [T.StructField(text_col, T.StringType()), T.StructField(chars_col, T.LongType())], decide)
    return out.drop("__pl_host", "__pl_words", "__pl_zones", "__pl_row", "__pl_hot")


def run_counts(blocks: DataFrame, wanted) -> DataFrame:
    """(h, n): how many pages of its host hold each run of the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs_of = _Runs()
        for batch in batches:
            hosts: dict[str, list[str]] = {}
            for at_host, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hosts.setdefault(at_host, []).append(words)
            for at_host, pages in hosts.items():
                group, size = [], 0
                for words in pages:
                    group.append(runs_of(at_host, words))
                    size += len(group[-1][0])
                    if len(group) >= GROUP_PAGES or size >= GROUP_TOKENS:
                        yield count(group)
                        group, size = [], 0
                yield count(group)

    def count(group: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        group = [(h, runs, in_bitmap(wanted.value, runs)) for h, runs in group]
        group = [(h, runs, held) for h, runs, held in group if held.any()]
        keys, n = np.empty(0, np.uint64), np.empty(0, np.int64)
        if group:
            first, n = run_pages([h for h, _, _ in group])
            pad = [np.zeros(len(h) + 1 - len(runs), np.uint64) for h, runs, _ in group]
            keys = np.concatenate([x for (_, runs, _), z in zip(group, pad, strict=True) for x in (runs, z)])[first]
            held = np.concatenate([x for (_, _, held), z in zip(group, pad, strict=True) for x in (held, z.astype(bool))])[first]
            keys, n = keys[held], n[held]
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return blocks.select("__pl_host", "__pl_words").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
