"""Byte-pair encoding and decoding of whole texts by tree concatenation.

A text is taken as one unsplit stretch (special tokens alone cut it) and halved until the leaves have
`leaf_chars` characters or fewer, wherever the cuts fall. Leaves are encoded by themselves, and the halves
are concatenated as a tree: around each join a window, which ends on either side at a place where tokens
end whatever stands beyond it, is encoded anew; it grows until what it cuts off on both sides agrees exactly
with the tokens that each side has there. Texts of more than `spread_chars` characters are dealt out: their
subtrees are encoded in parallel by different tasks and joined at the end.

A run that the pre-tokenizer can't split (one letter ten thousand times) has no such place; there the window
is counted in tokens: it grows until its first token equals the left side's token there and its last the
right side's. A token sequence is the encoding of its bytes if each neighbouring pair is the encoding of the
pair's bytes, so both kinds of joins are exact.

Defined cases: a null or empty text has no tokens; the special token's string in a text is the special
token (as the tokenizers library reads it); repeated rows give repeated rows, also with null ids; an empty
table gives an empty table; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import bounded_batches, row_slices, tidy

LEAF_CHARS = 512
SPREAD_CHARS = 32_768
WINDOW_CHARS = 48
#: A piece of more bytes than this is itself encoded as a tree of leaves.
PIECE_BYTES = 2048

# The byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Places at which a token ends, whatever stands before and after the two characters: no piece goes on over them. A run of letters
#: ends before anything else, one of numbers too, signs but the apostrophe before space, letters and numbers.
EDGE = r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[!-/:-@\[-`{-~])(?=[ \n0-9])|(?<=[^\x00-\x7f\s᠎​])(?=[ \n])|(?<=[\p{P}\p{S}--'])(?=[\p{L}\p{N}])"

Half = tuple[str, np.ndarray]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Codec:
    """Tables of one tokenizer file, read once in each Python worker."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.core = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=dict(self.special))
        self.pieces = regex.compile(PATTERN)
        self.first_edge, self.last_edge = regex.compile(EDGE, regex.V1), regex.compile(f"(?r){EDGE}", regex.V1)
        self.long_run = re.compile(rf"\S{{{PIECE_BYTES // 4},}}|\s{{{PIECE_BYTES // 4},}}")
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def decode(self, ids: np.ndarray) -> str:
        return self.core.decode_bytes(ids.tolist()).decode("utf-8", "replace")

    def stretches(self, text: str) -> list[str]:
        """The text cut at special tokens, which stand at the odd places."""
        if not any(mark in text for mark in self.special):
            return [text]
        return self.marks.split(text)

    def leaf(self, text: str) -> np.ndarray:
        """Tokens of a text of bounded length, or of any length whose pieces are short."""
        return self.core.encode_to_numpy(text, disallowed_special=())

    def straight(self, text: str) -> np.ndarray:
        """Tokens of a text of any length in one go, special tokens' strings read as plain text; only pieces of more than
        PIECE_BYTES characters, which take time by their square, are encoded as trees."""
        return self.region(text) if self.long_run.search(text) else self.leaf(text)

    def straight_whole(self, text: str) -> np.ndarray:
        """The same with special tokens read as such."""
        if not any(mark in text for mark in self.special):
            return self.straight(text)
        return np.concatenate([np.array([self.special[part]], np.uint32) if i % 2 else self.straight(part) for i, part in enumerate(self.stretches(text))])

    def region(self, text: str) -> np.ndarray:
        """Tokens of a text of any length: long pieces as trees of their own."""
        if len(text) <= PIECE_BYTES:
            return self.leaf(text)
        out, short = [], 0
        for m in self.pieces.finditer(text):
            if m.end() - m.start() > PIECE_BYTES:
                out += [self.leaf(text[short : m.start()]), np.array(self.piece(m.group().encode()), np.uint32)]
                short = m.end()
        return np.concatenate([*out, self.leaf(text[short:])]) if out else self.leaf(text)

    def piece(self, raw: bytes) -> list[int]:
        """Tokens of one piece: leaves of PIECE_BYTES, concatenated as a tree."""
        parts = [self.core._encode_single_piece(raw[i : i + PIECE_BYTES]) for i in range(0, len(raw), PIECE_BYTES)]
        return tree(parts, self.merged) if parts else []

    def merged(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of a piece from those of its two parts."""
        if not left or not right:
            return left or right
        w = 4
        while True:
            a, b = min(w, len(left)), min(w, len(right))
            window = self.core._encode_single_piece(self.core.decode_bytes(left[-a:] + right[:b]))
            if (a == len(left) or window[0] == left[-a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[:-a] + window + right[b:]
            w *= 2

    def _one_piece(self, text: str) -> bool:
        m = self.pieces.match(text)
        return m is not None and m.end() == len(text)

    def joined(self, left: Half, right: Half) -> Half:
        """The tokens of a text from those of its halves."""
        (a, a_ids), (b, b_ids) = left, right
        text, w = a + b, WINDOW_CHARS
        while True:
            near, far = a[-w:], b[:w]
            start, end = self.last_edge.search(near), self.first_edge.search(far)
            if (start or w >= len(a)) and (end or w >= len(b)):
                s = len(a) - len(near) + start.start() if start else 0
                e = end.start() if end else len(b)
                if s == 0 and e == len(b) and len(text) > 2 * PIECE_BYTES and all(map(self._one_piece, (a, b, text))):
                    return text, np.array(self.merged(a_ids.tolist(), b_ids.tolist()), np.uint32)
                tail, head = self.region(a[s:]), self.region(b[:e])
                k, j = len(a_ids) - len(tail), len(head)
                if np.array_equal(a_ids[k:], tail) and np.array_equal(b_ids[:j], head):
                    return text, np.concatenate([a_ids[:k], self.region(a[s:] + b[:e]), b_ids[j:]])
            w *= 4

    def encode(self, text: str, leaf_chars: int = LEAF_CHARS) -> np.ndarray:
        """Tokens of a stretch without special tokens."""
        return tree([(part, self.leaf(part)) for part in halves(text, leaf_chars)], self.joined)[1] if text else np.zeros(0, np.uint32)

    def encode_whole(self, text: str, leaf_chars: int) -> np.ndarray:
        parts = [np.array([self.special[part]], np.uint32) if i % 2 else self.encode(part, leaf_chars) for i, part in enumerate(self.stretches(text))]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def halves(text: str, most: int) -> list[str]:
    """The text halved again and again until no part has more than `most` characters."""
    n, count = len(text), 1
    while count * most < n:
        count *= 2
    cuts = [i * n // count for i in range(count + 1)]
    return [text[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def tree(parts: list, join: Callable):
    """Neighbours joined pair by pair, level by level."""
    while len(parts) > 1:
        parts = [join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _packed(ids: np.ndarray) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def encode(docs: DataFrame, tokenizer: str | None = None, leaf_chars: int = LEAF_CHARS, spread_chars: int = SPREAD_CHARS, decoded: bool = False) -> DataFrame:
    """doc_id and ids, the token ids of each whole text as little-endian unsigned 32-bit integers; `decoded` adds text,
    decoded in the same pass."""
    bounded_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = ["text"] if decoded else []
    kept = "ids binary, text string" if decoded else "ids binary"

    def finished(own: Codec, ids: list[np.ndarray]) -> list[pa.Array]:
        packed = pa.array([_packed(x) for x in ids], pa.binary())
        return [packed, pa.array([own.decode(x) for x in ids], pa.string())] if decoded else [packed]

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in row_slices(batch, "text"):
                ids = [own.encode_whole(t.as_py(), leaf_chars) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *finished(own, ids)], ["doc_id", "ids", *texts])

    keys = ["text_key", "doc_id", "copies"]
    dealt_type = f"text_key string, doc_id {id_type}, copies long, at int, run int, mark boolean, part string"

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for row in range(batch.num_rows):
                runs = enumerate(own.stretches(batch.column("text")[row].as_py()))
                cut = [(run, bool(run % 2), part) for run, stretch in runs for part in ([stretch] if run % 2 else halves(stretch, spread_chars))]
                same = batch.slice(row, 1).select(keys).take(pa.array([0] * len(cut)))
                run, mark, part = zip(*cut, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*same.columns, pa.array(range(len(cut)), pa.int32()), pa.array(run, pa.int32()), pa.array(mark), pa.array(part, pa.string())],
                    [*keys, "at", "run", "mark", "part"],
                )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in row_slices(batch, "part"):
                pairs = zip(part.column("mark").to_pylist(), part.column("part").to_pylist(), strict=True)
                ids = [_packed(np.array([own.special[p]]) if m else own.encode(p, leaf_chars)) for m, p in pairs]
                yield part.append_column("ids", pa.array(ids, pa.binary()))

    def concatenated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for row in range(batch.num_rows):
                runs: dict[int, list[Half]] = {}
                for part in sorted(batch.column("parts")[row].as_py(), key=lambda p: p["at"]):
                    runs.setdefault(part["run"], []).append((part["part"], np.frombuffer(part["ids"], "<u4")))
                ids = np.concatenate([tree(runs[run], own.joined)[1] for run in sorted(runs)])
                same = batch.slice(row, 1)
                yield pa.RecordBatch.from_arrays([same.column("doc_id"), same.column("copies"), *finished(own, [ids])], ["doc_id", "copies", "ids", *texts])

    # one row a long text, repeated rows counted; its subtrees go to different tasks and come together again
    long = rows.where(F.length("text") > spread_chars).groupBy("doc_id", "text").agg(F.count("*").alias("copies")).withColumn("text_key", F.sha2("text", 256))
    cut = long.select(*keys, "text").mapInArrow(tidy(dealt), dealt_type)
    parts = cut.repartition("text_key", "at").mapInArrow(tidy(encoded), f"{dealt_type}, ids binary")
    whole = parts.groupBy(*keys).agg(F.collect_list(F.struct("at", "run", "part", "ids")).alias("parts"))
    joined = whole.mapInArrow(tidy(concatenated), f"doc_id {id_type}, copies long, {kept}")
    repeated = joined.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "ids", *texts)
    return rows.where(F.length("text") <= spread_chars).mapInArrow(tidy(direct), f"doc_id {id_type}, {kept}").unionByName(repeated)


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids and text, decoded from ids with special tokens kept."""
    path = tokenizer or default_tokenizer()
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            text = pa.array([own.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column("ids")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), text], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(texts), f"doc_id {id_type}, ids binary, text string")


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, and SHA-256 of the packed ids and of the decoded text."""
    done = encode(docs, tokenizer, decoded=True)
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
