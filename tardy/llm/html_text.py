"""Main text of web pages: markup regions and a suffix array per host.

Markup tells three kinds of blocks apart: *main* (inside an article or main
element), *marked* (menus, headers, footers, sidebars, notices, adverts,
forms, reader comments, by element, role or class) and *open* (the rest).
An article or main element inside a form or an element marked by class or role
is main again, unless its own class marks it.  Inside main, a class name that
only contains a listed word ("related-work") leaves the block open.
Marked blocks go.  Whether an open block is boilerplate is decided by
repetition on its host: the token streams of a host's pages (all blocks but
the main ones) are concatenated, their suffixes are sorted, and runs of
``min_run`` tokens or more that occur on distinct pages are removed; unique
runs stay.  Main blocks are not judged by repetition, since copies and quoted
passages of an article are still its text.

The suffixes of one batch of pages are sorted in memory (to the depth of a
run), which joins equal prefixes before anything is shuffled: a footer on a
million pages is one row for each batch.  The prefixes of all batches then
meet by host and prefix.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tardy.llm.text import NON_SPACE, batches, join_bytes, mix, words
from tardy.llm.urls import host_of
from tardy.session import materialize

_U = np.uint64
MAIN, OPEN, MARKED = 0, 1, 2
_WRAPPED = 3                                  # marked, but an article inside is main again
MIN_RUN = 8

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template svg iframe object textarea select title canvas math audio video".split())
_ASIDE = frozenset("nav footer aside form dialog menu button head".split())
_MAIN = frozenset(("article", "main"))
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_WORDS = frozenset((
    "ad ads advert adverts advertisement advertising banner promo sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer masthead cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe signup social share "
    "sharing comment comments disqus replies related recommended widget pagination pager login search toolbar skip").split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())


def _is_marked(attrs: str, whole: bool = False) -> bool:
    """By role or class; ``whole``: only by class names that are a listed word."""
    for name, a, b, c in _ATTR.findall(attrs):
        value = (a or b or c).lower()
        if name.lower() == "role":
            if value.strip() in _ROLES:
                return True
        elif not _WORDS.isdisjoint(value.split() if whole else _SPLIT.split(value)):
            return True
    return False


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of the page's blocks in order.  Character references are
    decoded, white space becomes single spaces, empty blocks are left out."""
    page = page or ""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []            # open elements with the kind of what is inside
    kind = OPEN

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((min(kind, MARKED), text))

    def close(depth: int) -> None:
        nonlocal kind
        del stack[depth:]
        new = stack[-1][1] if stack else OPEN
        if new != kind:
            flush()
            kind = new

    at = 0
    while True:
        m = _TAG.search(page, at)
        parts.append(page[at:m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name not in _INLINE:
            flush()
        elif name in ("br", "wbr"):
            parts.append(" " if name == "br" else "")
        elif name == "img":
            continue
        if m[1]:                                  # an end tag closes up to its element, or nothing
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        if name in _VOID:
            continue
        if name in ("svg", "math") and (m[3] or "").rstrip().endswith("/"):
            continue
        if name in _RAW:                          # no text of the page inside
            end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _CLOSES_P:                     # an open paragraph ends where a block begins
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] not in _INLINE:
                    break
        inside, attrs = kind, m[3] or ""
        if name in _MAIN:
            if kind != MARKED and (kind != _WRAPPED or not _is_marked(attrs)):
                inside = MAIN
        elif kind in (MAIN, OPEN) and name not in ("html", "body"):
            if name == "form":
                inside = _WRAPPED
            elif name in _ASIDE or name == "header" and kind == OPEN:
                inside = MARKED
            elif _is_marked(attrs, whole=kind == MAIN):
                inside = _WRAPPED
            elif kind == MAIN and _is_marked(attrs):   # repetition on the host decides
                inside = OPEN
        stack.append((name, inside))
        if inside != kind:
            flush()
            kind = inside
    flush()
    return out


def _streams(pages: list[list[tuple[int, str]]]):
    """Tokens of the blocks that are not main: (hash, page, open block or -1).  The
    open blocks of a page are numbered from 0."""
    texts, page, number = [], [], []
    for i, bs in enumerate(pages):
        k = 0
        for kind, text in bs:
            if kind != MAIN:
                texts.append(text)
                page.append(i)
                number.append(k if kind == OPEN else -1)
            k += kind == OPEN
    buf, starts = join_bytes(texts)
    h, at, _, _ = words(buf, starts, NON_SPACE, lower=False)
    return h, np.array(page, np.int64)[at], np.array(number, np.int64)[at]


def repeated_prefixes(tokens: np.ndarray, unit: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the concatenated streams, sorted to ``depth`` tokens
    (doubling): the sorted suffixes that are ``depth`` long at least, and the
    rank of each one's prefix; equal ranks share a run.  A unit ends a stream."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    end = np.searchsorted(unit, unit, "right")
    width = 1
    while width < depth:                          # the last step overlaps if depth is no power of two
        step = min(width, depth - width)
        second = np.zeros(n, np.int64)
        ok = np.arange(n) + step < end
        second[ok] = rank[np.flatnonzero(ok) + step] + 1
        rank = np.unique(rank * (n + 1) + second, return_inverse=True)[1].astype(np.int64)
        width += step
    order = np.argsort(rank, kind="stable")
    order = order[order + depth <= end[order]]
    return order, rank[order]


_GROUP = "host string, prefix long, low long, high long, found array<struct<page:long,at:long>>"


def _suffixes(depth: int):
    """One row for each host and run of a batch: the smallest and largest page
    it is on, and its places in open blocks (page, token of the page's stream)."""
    found = pa.list_(pa.struct([("page", pa.int64()), ("at", pa.int64())]))
    schema = pa.schema([("host", pa.string()), ("prefix", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("found", found)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keys, hosts, pages = (batch.column(i).to_pylist() for i in range(3))
            for lo, hi in batches(pages):
                order = sorted(range(lo, hi), key=lambda i: hosts[i])          # streams of a host are concatenated
                h, page, number = _streams([blocks(pages[i]) for i in order])
                if not len(h):
                    continue
                names, host_no = np.unique(np.array([hosts[i] for i in order], object), return_inverse=True)
                key = np.array([keys[i] for i in order], np.int64)
                salted = mix(h ^ mix(host_no[page].astype(_U) + _U(1)))        # runs are told apart by host
                suffix, rank = repeated_prefixes(salted, page, depth)
                if not len(suffix):
                    continue
                first = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
                last = np.concatenate((first[1:], [len(rank)]))
                print_ = np.zeros(len(first), _U)
                for j in range(depth):
                    print_ = mix(print_ * _U(0x2545F4914F6CDD1D) + h[suffix[first] + j])
                stream = np.searchsorted(page, np.arange(len(order)))
                at = suffix - stream[page[suffix]]
                # whether any token of the run lies in an open block
                is_open = np.concatenate(([0], np.cumsum(number >= 0)))
                touch = is_open[np.minimum(suffix + depth, len(h))] > is_open[suffix]
                owner = key[page[suffix]]
                lists = [[{"page": int(owner[i]), "at": int(at[i])} for i in range(a, b) if touch[i]] for a, b in zip(first, last)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[host_no[page[suffix[a]]]] for a in first], pa.string()), pa.array(print_.view(np.int64)),
                     pa.array(np.minimum.reduceat(owner, first)), pa.array(np.maximum.reduceat(owner, first)), pa.array(lists, found)], schema=schema)
    return run


def _texts(depth: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n = batch.num_columns
            pages, cover = batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist()
            out = []
            for page, at in zip(pages, cover):
                bs = blocks(page)
                if at:
                    bs = _without(bs, at, depth)
                out.append("\n".join(t for kind, t in bs if kind != MARKED))
            yield pa.RecordBatch.from_arrays(batch.columns[:-2] + [pa.array(out, pa.string())], names=[*batch.schema.names[:-2], "_out"])
    return run


def _without(bs: list[tuple[int, str]], starts: list[int], depth: int) -> list[tuple[int, str]]:
    """Blocks with the tokens of the runs at ``starts`` removed from open blocks.

    A run may begin in one block and end in the next; of a block that it does
    not cover whole, only stretches of ``depth`` tokens or more go."""
    gone = {i for s in starts for i in range(s, s + depth)}
    out, at = [], 0
    for kind, text in bs:
        if kind == MAIN:
            out.append((kind, text))
            continue
        tokens = re.findall(r"[^\x20\x09-\x0D]+", text)
        if kind == OPEN:
            kept: list[str] = []
            for cut, group in itertools.groupby(enumerate(tokens, at), key=lambda x: x[0] in gone):
                run = [t for _, t in group]
                if not cut or len(run) < min(depth, len(tokens)):
                    kept += run
            text = " ".join(kept)
            if text:
                out.append((kind, text))
        at += len(tokens)
    return out


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", text_out: str = "text",
                 min_run: int = MIN_RUN) -> DataFrame:
    """``pages`` without ``html_col`` and with the main text in ``text_out``.

    Blocks are joined by one newline; nothing is cut off.  A null or empty page
    and a page of boilerplate only give an empty string.  Pages without a host
    share the empty host.  Rows that repeat id, URL and page count as one page,
    so a page never makes its own text a repetition.  Unclosed elements,
    comments and tags are closed by the end of the page.  A column named like
    the output is replaced.
    """
    keep = [c for c in pages.columns if c not in (text_out, html_col)]
    page = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    src = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], page.alias("_page"),
                       host_of(F.col(f"`{url_col}`").cast("string")).alias("_host"))
    simple = [f"c{i}" for i, (_, t) in enumerate(pages.select(*[F.col(f"`{c}`") for c in keep]).dtypes) if "map<" not in t]
    src = src.withColumn("_key", F.xxhash64(*simple, "_page"))
    runs = materialize(src.select("_key", "_host", "_page").mapInArrow(_suffixes(min_run), _GROUP))
    repeated = runs.groupBy("host", "prefix").agg(F.min("low").alias("lo"), F.max("high").alias("hi")).where("lo <> hi").select("host", "prefix")
    cover = materialize(runs.where(F.size("found") > 0).join(repeated, ["host", "prefix"], "left_semi")
                        .select(F.explode("found").alias("f")).groupBy(F.col("f.page").alias("_key")).agg(F.collect_list("f.at").alias("_cover")))
    rows = src.join(cover, "_key", "left").select(*[f"c{i}" for i in range(len(keep))], "_page", "_cover")
    schema = ", ".join([f"c{i} {t}" for i, (_, t) in enumerate(pages.select(*[F.col(f"`{c}`") for c in keep]).dtypes)] + ["_out string"])
    return rows.mapInArrow(_texts(min_run), schema).toDF(*keep, text_out)
