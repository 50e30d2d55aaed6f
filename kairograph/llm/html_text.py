"""Main text of HTML pages, with a suffix array over each host's pages.

A page becomes blocks in page order, and markup proposes what each is: text of the article (or main) element,
furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments and the like), or open text that
no markup tells about. What markup calls the article is the article, whole, whatever else repeats it: adverts and
teasers quote articles, pages mirror them. On a page without such an element the host's suffix array decides what of
the open text is boilerplate: the token streams of all pages of a host are concatenated, without articles, into one array
whose suffixes are ranked by prefix doubling (the rank of 2k tokens from the ranks of k and k). Suffixes of the same rank at
depth `least_words` share that many tokens; a run of open text that stands on two distinct pages of the host or more is
covered by such suffixes, however long it is, and its tokens go. The unique runs between stay. Pages with the same
stream of tokens count as one page.

Ranks are hashes of (host, tokens), equal for equal runs but not in alphabetical order, which nothing here needs; so one
shuffle groups them. Only the smallest and largest stream of a rank are kept, combined before the shuffle, so a run on a
third of all pages costs no more than any other. Of the ranks that recur, pages look up their own: in memory up to
MOST_KEYS of them, by a join beyond.

Defined cases: null and empty html give an empty text; unclosed elements end with their parents; broken
references stay as they stand; repeated rows give repeated rows; null urls share one nameless host; an
empty table gives an empty table; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import bounded_batches, materialize, mix64, row_slices

LEAST_WORDS = 12
#: Recurring ranks that a task may hold in memory (8 bytes each).
MOST_KEYS = 4_000_000
ARTICLE, OPEN, FURNITURE = 0, 1, 2

# Elements by their part in a page.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset("head nav footer aside form button select dialog svg math object audio video canvas map menu datalist".split())
_MAIN = frozenset("article main".split())
_BREAK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_ENDS_P = _BREAK - {"br", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "li", "dd", "dt"}
_SELF_CLOSING = frozenset("p li dd dt td th tr option".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
_NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside widget ad ads advert adverts advertisement advertising "
    "sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay comment comments disqus reply replies respond "
    "share sharing social related recommended recommendations pagination pager newsletter subscribe subscription signup login search toolbar skip".split()
)
_HEAD_NAMES = frozenset("header masthead banner".split())
_REPLY_NAMES = frozenset("comment comments reply replies ad ads advert related".split())
_ABOUT_LAYOUT = ("has-", "with-", "no-", "is-", "js-")

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


def _unwanted(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in _NEVER or (tag == "header" and not in_main):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "role" and value.lower() in _ROLES):
            return True
        if name in ("class", "id") and tag != "main":
            words = {p.lower() for token in value.split() if not token.lower().startswith(_ABOUT_LAYOUT) for p in _NAME_PARTS.findall(token)}
            if words & (_REPLY_NAMES if tag == "article" else _NAMES - _HEAD_NAMES if in_main else _NAMES):
                return True
    return False


def page_blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of all blocks in page order, white space normalised: ARTICLE, OPEN or FURNITURE."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, unwanted, main
    unwanted = main = False

    def end() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((FURNITURE if unwanted else ARTICLE if main else OPEN, text))
            held.clear()

    def pop_to(k: int) -> None:
        nonlocal unwanted, main
        del stack[k:]
        state = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if state != (unwanted, main):
            end()
        unwanted, main = state

    at, size = 0, len(page)
    has_main = False
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None or m.start() > at:
            held.append(page[at : m.start() if m else size])
            if m is None:
                break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in _BREAK:
                end()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
            continue
        if tag in _RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|$)[^>]*>?", re.I).search(page, at)
            at = close.end() if close else size
            if tag == "title":
                end()
            continue
        if tag in _BREAK:
            end()
        if tag in _VOID:
            continue
        if tag in _ENDS_P:
            for k in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
        if tag in _SELF_CLOSING and stack and stack[-1][0] == tag:
            pop_to(len(stack) - 1)
        bad = unwanted or _unwanted(tag, m[3], main)
        inside = main or (not bad and (tag in _MAIN or bool(m[3] and re.search(r"""role\s*=\s*["']?main\b""", m[3], re.I))))
        if bad != unwanted or inside != main:
            end()
        has_main |= inside and not bad
        if bad or inside or tag in _BREAK or stack:
            stack.append((tag, bad, inside))
        unwanted, main = bad, inside
    end()
    # beside an article, open text is furniture
    return [(FURNITURE if kind == OPEN and has_main else kind, text) for kind, text in out]


def suffix_ranks(words: list[str], depth: int) -> np.ndarray:
    """For each position with `depth` words from it on, the rank of those words, by prefix doubling."""
    n = len(words)
    if n < depth:
        return np.zeros(0, np.uint64)
    rank = mix64(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, n))
    out, done, span = np.zeros(n, np.uint64), 0, 1
    while True:
        if depth & span:  # the binary digits of the depth say which ranks make it up
            shifted = np.zeros(n, np.uint64)
            shifted[: n - done] = rank[done:] if done else rank
            out = mix64(mix64(out) + shifted)
            done += span
        if done == depth:
            return out[: n - depth + 1]
        wider = np.zeros(n, np.uint64)
        wider[: n - span] = mix64(rank[: n - span] * np.uint64(3) + rank[span:])
        rank, span = wider, span * 2


def _stretches(kinds: list[int], counts: list[int]) -> list[tuple[int, int]]:
    """(first token, last token + 1) of stretches of neighbouring blocks outside the article."""
    out: list[tuple[int, int]] = []
    at = 0
    for kind, n in zip(kinds, counts, strict=True):
        if kind != ARTICLE:
            if out and out[-1][1] == at:
                out[-1] = (out[-1][0], at + n)
            else:
                out.append((at, at + n))
        at += n
    return out


def _keyed(host: str, words: list[str], stretches: list[tuple[int, int]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Key (host and rank) and first token of every suffix that has `depth` tokens outside the article."""
    keys, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    own = np.uint64(xxhash.xxh3_64_intdigest(host))
    for a, b in stretches:
        rank = suffix_ranks(words[a:b], depth)
        keys.append(mix64(rank ^ own).astype(np.int64))
        places.append(np.arange(a, a + len(rank)))
    return np.concatenate(keys), np.concatenate(places)


def _recurring(ranks: DataFrame) -> DataFrame:
    """Keys that stand on two distinct streams or more."""
    return materialize(ranks.groupBy("key").agg(F.min("stream").alias("low"), F.max("stream").alias("high")).where("low < high").select("key"), "recurring")


def _among(keys: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted array."""
    if not len(held):
        return np.zeros(len(keys), bool)
    return held[np.minimum(np.searchsorted(held, keys), len(held) - 1)] == keys


def _kept(kinds: list[int], texts: list[str], gone: np.ndarray) -> tuple[str, int]:
    """The article's text, or on a page without one the open text less the tokens that are gone; and how many tokens of all its
    blocks went."""
    article = ARTICLE in kinds
    parts, at = [], 0
    for kind, text in zip(kinds, texts, strict=True):
        end = at + text.count(" ") + 1
        if kind == ARTICLE or (kind == OPEN and not article and not gone[at:end].any()):
            parts.append(text)
        elif kind == OPEN and not article and not gone[at:end].all():
            parts.append(" ".join(w for w, x in zip(text.split(" "), gone[at:end], strict=True) if not x))
        at = end
    return " ".join(parts), int(gone.sum())


def extract(pages: DataFrame, least_words: int = LEAST_WORDS, most_keys: int = MOST_KEYS) -> DataFrame:
    """Per row of `pages`: page_id, url, text, n_chars, and n_repeated, the tokens that went because they recur."""
    spark = pages.sparkSession
    bounded_batches(spark)
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "html"):
                found = [page_blocks(x.as_py() or "") for x in part.column("html")]
                kinds, texts = ([[b[k] for b in blocks] for blocks in found] for k in (0, 1))
                streams = [int.from_bytes(xxhash.xxh3_64_digest(" ".join(t)), "little", signed=True) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), part.column("host"), pa.array(streams, pa.int64()), pa.array(kinds, pa.list_(pa.int8())), pa.array(texts, pa.list_(pa.string()))],
                    ["page_id", "url", "host", "stream", "kinds", "texts"],
                )

    def suffixes(part: pa.RecordBatch) -> Iterator[tuple[int, int, list[int], list[str], np.ndarray, np.ndarray]]:
        """Of each page its stream, number of tokens, blocks, and the suffixes' keys and places."""
        for h, stream, kinds, texts in zip(*(part.column(c).to_pylist() for c in ("host", "stream", "kinds", "texts")), strict=True):
            counts = [t.count(" ") + 1 for t in texts]
            yield stream, sum(counts), kinds, texts, *_keyed(h, " ".join(texts).split(" ") if texts else [], _stretches(kinds, counts), least_words)

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for stream, _, _, _, key, _ in suffixes(batch):
                keys.append(np.unique(key))
                streams.append(np.full(len(keys[-1]), stream))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(streams))], ["key", "stream"])

    pages_ = pages.select("page_id", "url", host.alias("host"), "html").mapInArrow(parsed, f"page_id {id_type}, url {url_type}, host string, stream long, kinds array<tinyint>, texts array<string>")
    blocks = materialize(pages_.withColumn("row", F.monotonically_increasing_id()), "blocks")
    recurring = _recurring(blocks.select("host", "stream", "kinds", "texts").mapInArrow(emitted, "key long, stream long"))

    def finished(part: pa.RecordBatch, hit) -> pa.RecordBatch:
        """hit: for the part's n-th page, which of its suffixes recur."""
        texts, lost = [], []
        for n, (_, count, kinds, own, key, place) in enumerate(suffixes(part)):
            gone = np.zeros(count + 1, np.int64)
            ok = hit(n, key, place)
            np.add.at(gone, place[ok], 1)
            np.add.at(gone, place[ok] + least_words, -1)
            text, missing = _kept(kinds, own, np.cumsum(gone)[:-1] > 0)
            texts.append(text)
            lost.append(missing)
        return pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(lost, pa.int64())], ["page_id", "url", "text", "n_repeated"])

    out = f"page_id {id_type}, url {url_type}, text string, n_repeated long"
    if recurring.count() <= most_keys:
        near = spark.sparkContext.broadcast(_sorted_keys(recurring))

        def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield finished(batch, lambda n, key, place: _among(key, near.value))

        done = blocks.select("page_id", "url", "host", "stream", "kinds", "texts").mapInArrow(covered, out)
    else:

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, (_, _, _, _, key, place) in zip(batch.column("row").to_pylist(), suffixes(batch), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), row)), pa.array(key), pa.array(place)], ["row", "key", "at"])

        spread = blocks.select("row", "host", "stream", "kinds", "texts").mapInArrow(placed, "row long, key long, at long").join(recurring, "key", "left_semi")
        covers = spread.groupBy("row").agg(F.collect_set("at").alias("covered"))  # a page's own places

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [np.array(c or [], np.int64) for c in batch.column("covered").to_pylist()]
                yield finished(batch, lambda n, key, place: np.isin(place, sets[n]))  # noqa: B023

        done = blocks.join(covers, "row", "left").select("page_id", "url", "host", "stream", "kinds", "texts", "covered").mapInArrow(joined, out)
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")


def _sorted_keys(keys: DataFrame) -> np.ndarray:
    """Keys whose number is checked before."""
    return np.sort(keys.toArrow().column("key").to_numpy())
