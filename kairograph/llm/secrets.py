"""Secrets in whole texts, also under nested encodings.

Each text is a worklist's first layer. A layer is scanned for three kinds of secrets, then unwrapped in
three ways (URL escapes; Unicode, hex and character-reference escapes; base64, in one line or over line
breaks, with all members of what is compressed inside inflated until nothing inflates, read as UTF-8 or
Latin-1 and as UTF-16), each giving a further layer if it changed anything. Base64 of other than plain
text is a layer by itself, without the text around it. A layer seen before (by its text)
is not taken up again, so cycles end and the list runs until nothing new appears. Every character of a
layer carries the span of the original text that it came from, so findings map back.

Defined cases: a null or empty text has no spans; repeated rows give repeated rows; an empty table gives
an empty table; further columns pass through `redact` and are ignored by `scan`, whatever their names. A
compressed part that would inflate beyond MAX_LAYER_BYTES is scanned as a stream of windows of 8 MiB that
overlap by 1 MiB, each a layer of its own, to bound memory; limits: an encoded part inside such a stream that
is longer than the overlap may be cut by a window's edge, and base64 lines of under 16 characters are not
joined. `max_layer_bytes`, if given, leaves larger parts packed instead. Compressed data that is damaged after its beginning, or
that needs more memory than its library may take, is unread: what came before the damage is scanned, and the part is counted
(`n_unread`) and replaced in `redact`, as it may hold a secret. Data that doesn't inflate at all is text that only begins like
compressed data; data that is cut short is read as far as it goes. A library that isn't installed is an error.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import html
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import bounded_batches, row_slices, tidy

KINDS = ("assign", "access", "hex")
MAX_LAYER_BYTES = 64 << 20
WINDOW, OVERLAP, CHUNK = 8 << 20, 1 << 20, 1 << 18
#: Most memory that the window of compressed data may take.
XZ_MEMORY, ZSTD_WINDOW = 256 << 20, 1 << 27

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_KEYWORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
_WIDE = re.compile(r"(?:%u[0-9A-Fa-f]{4})+")
_UNIT = re.compile(r"[\\%][uU]\{?([0-9A-Fa-f]+)\}?|\\x([0-9A-Fa-f]{2})")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}|={1,2}")
_WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}+={0,2}(?:[ \t]*(?:\r\n|\n|\r)[ \t]*(?:[A-Za-z0-9+/_-]++={0,2}|={1,2}))++")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of each kind, leftmost and non-overlapping, as (kind, start, end) in code points."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def _from_url(part: str) -> str:
    return bytes.fromhex(part.replace("%", "")).decode(errors="replace")


def _from_escape(part: str) -> str | None:
    if part[0] == "&":
        return html.unescape(part)
    try:
        units = [int(m[1] or m[2], 16) for m in _UNIT.finditer(part)]
        if any(u > 0x10FFFF for u in units):
            return None
        return "".join(map(chr, units)).encode("utf-16", "surrogatepass").decode("utf-16")
    except ValueError:
        return None


def _is_damage(error: Exception) -> bool:
    """Whether a decompressor says so of its data; anything else is a failure of ours."""
    return isinstance(error, (zlib.error, lzma.LZMAError, EOFError)) or type(error) is OSError or (type(error).__module__.startswith("zstandard") and type(error).__name__ == "ZstdError")


def _is_limit(error: Exception) -> bool:
    """Whether the data may be sound, but needs more memory than it may take."""
    return "memory" in str(error).lower()


def _maker(head: bytes):
    """A decompressor for data that begins so; None if it isn't compressed."""
    if head[:2] == b"\x1f\x8b" or (len(head) > 2 and head[0] == 0x78 and (head[0] * 256 + head[1]) % 31 == 0):
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=XZ_MEMORY)
    if head[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor(max_window_size=ZSTD_WINDOW).decompressobj()
    return None


def _drained(maker, piece: bytes) -> Iterator[bytes]:
    """What a decompressor makes of one piece, in bounded chunks."""
    if hasattr(maker, "unconsumed_tail"):
        while not maker.eof:
            out = maker.decompress(piece, CHUNK)
            piece = maker.unconsumed_tail
            yield out
            if not piece and len(out) < CHUNK:
                return
    elif hasattr(maker, "needs_input"):
        while not maker.eof:
            yield maker.decompress(piece, CHUNK)
            piece = b""
            if not maker.eof and maker.needs_input:
                return
    else:
        yield maker.decompress(piece)


def _members(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """What all members, one after another, inflate to; it raises where data is damaged and ends where no member follows."""
    held = b""
    while True:
        while len(held) < 6 and (more := next(pieces, b"")):
            held = (held + more).lstrip(b"\0")  # padding between members
        if (maker := _maker(held)) is None:
            return
        while not maker.eof:
            if not held and not (held := next(pieces, b"")):
                return  # cut short: what there is counts
            yield from _drained(maker, held)
            held = b""
        held = maker.unused_data


def _pieces(raw: bytes) -> Iterator[bytes]:
    return (raw[i : i + 1024] for i in range(0, len(raw), 1024))


def _windows(raw: bytes, unread: list[str]) -> Iterator[bytes]:
    """Overlapping windows over what inflates beyond a layer's size, however often it is compressed; unread gets the damage that
    ends it."""
    chunks = _members(_pieces(raw))
    held = bytearray()
    try:
        while True:
            head = b""
            while len(head) < 4096 and (more := next(chunks, b"")):
                head += more
            chunks = (x for y in ([head], chunks) for x in y)
            if not _inflates(head):
                break
            chunks = _members(p for c in chunks for p in _pieces(c))
        for chunk in chunks:
            held += chunk
            if len(held) >= WINDOW:
                yield bytes(held)
                del held[:-OVERLAP]
    except Exception as error:
        if not _is_damage(error):
            raise
        unread.append(str(error))
    yield bytes(held)


def _inflates(head: bytes) -> bool:
    """Whether data is compressed and not text that only begins like it."""
    try:
        maker = _maker(head[:6])
        return maker is not None and (any(_drained(maker, head[:4096])) or (not maker.eof and len(head) >= 4096))
    except Exception as error:
        if not _is_damage(error):
            raise
        return _is_limit(error)


def _unpacked(raw: bytes, most: int | None, unread: list[str]) -> bytes | Iterator[bytes]:
    """Compressed bytes inflated until nothing inflates; windows if that would exceed a layer's size and `most` doesn't forbid them.
    unread gets why data that begins to inflate, or is too large to, isn't read to its end."""
    seen = set()
    while True:
        if _maker(raw[:6]) is None or (key := blake2b(raw, digest_size=16).digest()) in seen:
            return raw
        seen.add(key)
        out = bytearray()
        try:
            for chunk in _members(_pieces(raw)):
                out += chunk
                if len(out) > (MAX_LAYER_BYTES if most is None else most):
                    return _windows(raw, unread) if most is None else raw
        except Exception as error:
            if not _is_damage(error):
                raise
            if out or _is_limit(error):
                unread.append(str(error))
            return bytes(out) + b"\n" + raw if out else raw  # or text that only begins like compressed data
        if not out:
            return raw
        raw = bytes(out)


def _narrow(raw: bytes) -> str | None:
    try:
        return raw.decode()
    except ValueError:
        return raw.decode("latin-1")


def _plain(raw: bytes) -> str | None:
    try:
        text = raw.decode()
    except ValueError:
        return None
    printable = sum(c.isprintable() or c in "\t\r\n" for c in text)
    return text if text and printable >= 0.9 * len(text) else None


def _wide(order: str, raw: bytes) -> str | None:
    """UTF-16 text; whatever the language, a secret in it has null bytes."""
    return raw.decode(f"utf-16-{order}", errors="replace") if b"\0" in raw else None


_READINGS = (_narrow, partial(_wide, "le"), partial(_wide, "be"))


def _from_base64(part: str, most: int | None, unread: list[str]) -> bytes | Iterator[bytes] | None:
    core = part.rstrip("=").replace("-", "+").replace("_", "/")
    if len(core) % 4 == 1:
        core = core[:-1]
    try:
        return _unpacked(base64.b64decode(core + "=" * (-len(core) % 4)), most, unread)
    except binascii.Error:
        return None


def _blocks(run: re.Match) -> Iterator[tuple[int, int, int, str]]:
    """Base64 blocks (reading, start, end, joined lines) in a run of lines: lines of one width and a last one as long or
    shorter. What belongs to a block can be read in several ways: without a shorter line at its end, with it, and these two
    with a line of other width before it."""
    lines = [(m.start() + run.start(), m.end() + run.start(), m.group()) for m in _LINE.finditer(run.group())]
    width = [len(x) for _, _, x in lines]
    at = 0
    while at + 1 < len(lines):
        end = at + 1
        while end < len(lines) and width[end] == width[at] and "=" not in lines[end - 1][2]:
            end += 1
        longer = end + (end < len(lines) and width[end] < width[at] and "=" not in lines[end - 1][2])
        before = at and "=" not in lines[at - 1][2]
        for reading, a, b in ((0, at, end), (1, at, longer), (2, at - 1, end), (3, at - 1, longer)):
            if b - a > 1 and (reading < 2 or before) and (reading % 2 == 0 or longer > end):
                yield reading, lines[a][0], lines[b - 1][1], "".join(x for _, _, x in lines[a:b])
        at = end


def _replaced(text: str, at: np.ndarray | None, parts: list[tuple[int, int, str]]) -> tuple[str, np.ndarray] | None:
    """The text with every part (start, end, new) replaced, and for each character its span of the original (2 rows)."""
    pieces, spans, done = [], [], 0
    own = _own(text, at)
    for start, end, new in parts:
        if start < done or new == text[start:end]:
            continue
        pieces += [text[done:start], new]
        spans += [own[:, done:start], np.repeat(_origin(own, start, end), len(new), axis=1)]
        done = end
    if not pieces:
        return None
    return "".join([*pieces, text[done:]]), np.concatenate([*spans, own[:, done:]], axis=1)


def _own(text: str, at: np.ndarray | None) -> np.ndarray:
    return at if at is not None else np.stack([np.arange(len(text)), np.arange(1, len(text) + 1)]).astype(np.int32)


def _origin(own: np.ndarray, start: int, end: int) -> np.ndarray:
    return np.array([[own[0, start:end].min()], [own[1, start:end].max()]], np.int32)


def _children(layer: str, at: np.ndarray | None, most: int | None, unread: set[tuple[int, int]]) -> Iterator[tuple[str, np.ndarray]]:
    """Further layers: one for each way of unwrapping that changes the text, and one for each window of a large part. unread gets the
    original's spans of parts that aren't read to their end."""
    for sign, pattern, decode in (("%", _URL, _from_url), ("%u", _WIDE, _from_escape), ("\\", _ESCAPE, _from_escape), ("&#", _ESCAPE, _from_escape)):
        if sign in layer and (sign != "&#" or "\\" not in layer):
            parts = [(*m.span(), new) for m in pattern.finditer(layer) if (new := decode(m.group())) is not None]
            if child := _replaced(layer, at, parts):
                yield child
    lines = [(*m.span(), m.group()) for m in _BASE64.finditer(layer)]
    wrapped = [[], [], [], []]  # each reading of blocks over line breaks has layers of its own
    for run in _WRAPPED.finditer(layer) if "\n" in layer or "\r" in layer else ():
        for reading, *block in _blocks(run):
            wrapped[reading].append(block)
    for found in (lines, *wrapped):
        why: list[list[str]] = [[] for _ in found]
        raws = [(a, b, raw) for (a, b, part), broken in zip(found, why, strict=True) if (raw := _from_base64(part, most, broken)) is not None]
        for a, b, raw in raws:
            if not isinstance(raw, bytes):
                origin = _origin(_own(layer, at), a, b)
                for window in raw:
                    for reading in _READINGS:
                        if text := reading(window):
                            yield text, np.broadcast_to(origin, (2, len(text)))
        for (a, b, _), broken in zip(found, why, strict=True):
            if broken:
                unread.add(tuple(map(int, _origin(_own(layer, at), a, b).ravel())))
        whole = [(a, b, raw) for a, b, raw in raws if isinstance(raw, bytes)]
        plain = [(a, b, text) for a, b, raw in whole if (text := _plain(raw)) is not None]
        if plain and (child := _replaced(layer, at, plain)):
            yield child
        # what isn't plain text is a layer by itself: with the text around it every mixture of readings would be a further one
        for reading in _READINGS:
            parts = [(a, b, text) for a, b, raw in whole if (reading is not _narrow or _plain(raw) is None) and (text := reading(raw))]
            if parts:
                own = _own(layer, at)
                yield "\n".join(x for _, _, x in parts) + "\n", np.concatenate([np.repeat(_origin(own, a, b), len(x) + 1, axis=1) for a, b, x in parts], axis=1)


def find_spans(text: str, max_layer_bytes: int | None = None, unread: set[tuple[int, int]] | None = None) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, depth) of every secret, depth 0 as the text stands; by start, then kind, then end. unread, if given, gets
    (start, end) of compressed parts that couldn't be read to their end."""
    unread = set() if unread is None else unread
    found = {(k, a, b): 0 for k, a, b in base_spans(text)}
    seen, work = set(), deque([(iter([(text, None)]), 0, False)])
    while work:
        layers, depth, streamed = work[0]
        if (child := next(layers, None)) is None:
            work.popleft()
            continue
        layer, at = child
        key = blake2b(layer.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if key in seen:
            continue
        seen.add(key)
        if depth:
            for kind, a, b in base_spans(layer):
                span = (kind, int(at[0, a:b].min()), int(at[1, a:b].max()))
                found[span] = min(depth, found.get(span, depth))
        # windows of a large part, and what is inside them, are taken up at once and never held together
        if streamed or (at is not None and at.strides[1] == 0):
            work.appendleft((_children(layer, at, max_layer_bytes, unread), depth + 1, True))
        else:
            work.append((_children(layer, at, max_layer_bytes, unread), depth + 1, False))
    return sorted(((k, a, b, d) for (k, a, b), d in found.items()), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPANS = "array<struct<kind:string,start:int,end:int,depth:int>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans: every secret's kind, start and end (code points, end exclusive) and layer depth; and n_unread, the number of
    compressed parts that couldn't be read to their end."""
    bounded_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("depth", pa.int32())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                unread: list[set[tuple[int, int]]] = [set() for _ in range(part.num_rows)]
                spans = [[dict(zip(("kind", "start", "end", "depth"), s, strict=True)) for s in find_spans(t.as_py() or "", unread=u)] for t, u in zip(part.column("text"), unread, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, kind), pa.array([len(u) for u in unread], pa.int64())], ["doc_id", "spans", "n_unread"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(scanned), f"doc_id {id_type}, spans {_SPANS}, n_unread long")


def redact(docs: DataFrame, mark: str = "[SECRET]", unread_mark: str = "[UNREAD]") -> DataFrame:
    """The same rows and columns with each secret's span of the text, overlapping ones merged, replaced by `mark`; so are compressed parts
    that couldn't be read to their end, by `unread_mark`, which counts where both overlap; n_chars follows."""
    bounded_batches(docs.sparkSession)

    def cleaned(text: str | None) -> str | None:
        if not text:
            return text
        out, done = [], 0
        unread: set[tuple[int, int]] = set()
        spans = [(a, b, mark) for _, a, b, _ in find_spans(text, unread=unread)]
        for start, end, by in sorted([*spans, *((a, b, unread_mark) for a, b in unread)]):
            if start >= done:
                out += [text[done:start], by]
            elif by == unread_mark:
                out[-1] = by
            done = max(done, end)
        return "".join([*out, text[done:]])

    def redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                yield part.set_column(part.schema.get_field_index("text"), "text", pa.array([cleaned(t.as_py()) for t in part.column("text")], pa.string()))

    done = docs.mapInArrow(tidy(redacted), docs.schema)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def digests(docs: DataFrame) -> DataFrame:
    """Per document: counts and a digest of the spans found in the text as it stands, and all spans as text."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["depth"] == 0)
    count = lambda kind: F.size(F.filter("spans", lambda s: (s["depth"] == 0) & (s["kind"] == kind))).cast("long")
    return scan(docs).select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        "n_unread",
    )
