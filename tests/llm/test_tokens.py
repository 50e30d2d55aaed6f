"""Packing, alignment of tokenizers and periodic runs against plain versions."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from kairograph.llm import packing, periodic, token_alignment

DOCS = "doc_id long, text string, start string, block long, pairs string, length long"


def _docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "clash", 0, "clash", 7) for i, t in zip(ids, texts, strict=True)], DOCS).repartition(3)


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.no_truncation()
    found.no_padding()
    return found


def _texts(seed: int, count: int) -> list[str | None]:
    pick = random.Random(seed)
    words = ["the", "sea", "über", "naïve", "数据", "x1", "a-b", "(so)", "of", "​", "🌊", "Aa", "don't", "42", "\n\n", "  ", "\t"]
    made = [" ".join(pick.choices(words, k=pick.choice([1, 3, 20, 200]))) for _ in range(count)]
    return [*made, *made[:3], None, "", " ", "\n", "<|endoftext|>", "a<|endoftext|>b", "</s> <0x41> <unk>", "a" * 5000, "数据" * 700, "▁odd", "word " * 4000]


# packing


def _packed(spark, texts, tokenizer, window=1024, depth=3, ids=None):
    rows = packing.pack(_docs(spark, texts, ids), window=window, depth=depth).collect()
    expected = Counter()
    for i, t in zip(range(len(texts)) if ids is None else ids, texts, strict=True):
        expected[i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])] += 1
    by_doc = defaultdict(list)
    for r in rows:
        assert 1 <= r.length <= window and len(r.ids) == 4 * r.length
        by_doc[r.doc_id].append(r)
    for i, pieces in by_doc.items():
        mine = [ids for (d, ids), n in expected.items() if d == i for _ in range(n)]
        if len(mine) == 1:  # pieces cover the ids once, in order
            line = [x for p in sorted(pieces, key=lambda p: p.start) for x in np.frombuffer(p.ids, "<u4")]
            assert line == list(mine[0]) and all(p.doc_tokens == len(line) for p in pieces)
            at = 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at
                at += p.length
        else:
            assert sum(p.length for p in pieces) == sum(map(len, mine))
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in expected.items())
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    for held in windows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= window and at & (at - 1) == 0  # so nothing is padded
    return rows


def test_packing_covers_every_id_once_and_pads_nothing(spark, tokenizer):
    texts = _texts(1, 150)
    rows = _packed(spark, texts, tokenizer)
    _packed(spark, texts, tokenizer, window=64, depth=2)
    whole = packing.sequences(packing.pack(_docs(spark, texts))).collect()
    assert sum(s.n_tokens for s in whole) == sum(r.length for r in rows) and all(len(s.ids) == 4 * s.n_tokens for s in whole)


def test_packing_of_few_and_of_no_documents(spark, tokenizer):
    assert packing.pack(_docs(spark, [])).count() == 0
    (row,) = _packed(spark, [None], tokenizer)
    assert (row.doc_id, row.start, row.length, row.sequence_id, row.offset) == (0, 0, 1, 0, 0)
    _packed(spark, ["one two three"] * 40, tokenizer, ids=[None, None, *([5] * 38)])
    digest = {r.doc_id: r for r in packing.digests(_docs(spark, ["", "a"])).collect()}
    assert digest[0].ids_crc32 == zlib.crc32(np.array([0], "<u4").tobytes())


def test_least_squares_against_projected_gradient():
    pick = np.random.default_rng(3)
    histogram = np.zeros(33)
    histogram[1:32] = pick.integers(0, 200, 31)
    columns = packing.ways(np.flatnonzero(histogram), 32, 3)
    assert all(sum(c) == 32 for c in columns) and len({tuple(c) for c in columns}) == len(columns)
    matrix = np.zeros((33, len(columns)))
    for j, c in enumerate(columns):
        for x in c[c > 0]:
            matrix[x, j] += 1
    x = np.zeros(len(columns))
    step = 1 / np.linalg.norm(matrix, 2) ** 2
    for _ in range(20_000):
        x = np.maximum(0, x - step * (matrix.T @ (matrix @ x - histogram)))
    got, done = packing.least_squares(columns, histogram)
    miss = lambda v: float(((matrix @ v - histogram) ** 2).sum())
    assert done and (got >= 0).all() and miss(got) <= 1.02 * miss(x) + 1e-6 * float((histogram**2).sum())


def test_plan_packs_what_fits_without_a_cut():
    histogram = np.zeros(1025, np.int64)
    histogram[[300, 724, 100, 400, 524]] = [5000, 3000, 70, 70, 70]
    histogram[1024] = 11
    placed, line, sequence = packing.plan(histogram)
    assert sum(end - first for length, first, end, *_ in placed if length == 724) == 3000
    assert [length for length, *_ in line] == [300] and line[0][1:] == (3000, 0)
    assert sequence == 11 + 3000 + 70
    assert packing.line_windows(1024 * 3 + 700, 1024) == [(3072, 512), (3584, 128), (3712, 32), (3744, 16), (3760, 8), (3768, 4)]


# alignment


def _aligned_plainly(texts, tokenizer):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    spelt = []
    tokenizer.encode_special_tokens = True
    for t in texts:
        a = tokenizer.encode(" " + t, add_special_tokens=False).ids if t else []
        b = model.encode(t) if t else []
        a_bytes = [bytes(byte_of[c] for c in tokenizer.id_to_token(i)) for i in a]
        pieces = [model.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
        raw = b" " + (t or "").encode()
        spelt.append(None if not t or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw else (a, a_bytes, b, b_bytes))
    tokenizer.encode_special_tokens = False
    rows, count = [], Counter()
    for found in spelt:
        if found is None:
            rows.append(None)
            continue
        a, a_bytes, b, b_bytes = found
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes)]
        both = sorted(set(ends[0]) & set(ends[1]))
        sides = [defaultdict(list), defaultdict(list)]
        for side, ids in enumerate((a, b)):
            k = 0
            for i, e in zip(ids, ends[side], strict=True):
                while both[k] < e:
                    k += 1
                sides[side][k].append(i)
        links = Counter((x, y) for k in range(len(both)) for x in sides[0][k] for y in sides[1][k])
        count.update(links.keys())
        text = ";".join(",".join(map(str, sides[0][k])) + "|" + ",".join(map(str, sides[1][k])) for k in range(len(both)))
        rows.append((len(a), len(b), len(both), links, text))
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return [
        (0, 0, 0, 0, 0, 0, "")
        if r is None
        else (*r[:3], sum(r[3].values()), sum(n for p, n in r[3].items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in r[3].items()), sha256(r[4].encode()).hexdigest())
        for r in rows
    ]


@pytest.mark.parametrize("block_pairs", [40, 1 << 22])
def test_alignment_against_plain_pairs(spark, tokenizer, block_pairs):
    texts = _texts(2, 60)
    expected = _aligned_plainly(texts, tokenizer)
    from kairograph.llm.common import materialize

    rows = materialize(token_alignment.align(_docs(spark, texts), block_pairs=block_pairs), "aligned")
    assert rows.where("n_a IS NULL").select("block").distinct().count() > (20 if block_pairs == 40 else 0)
    got = {r.doc_id: r for r in token_alignment.scored(rows).collect()}
    assert len(got) == len(texts)
    for i, e in enumerate(expected):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == e[:6], texts[i]
        assert (sha256(r.groups.encode()).hexdigest() if r.groups else "") == e[6]
    digest = {r.doc_id: tuple(r)[1:] for r in token_alignment.digests(_docs(spark, texts)).collect()}
    assert digest == dict(enumerate(expected))


def test_alignment_of_odd_tables(spark, tokenizer):
    assert token_alignment.digests(_docs(spark, [])).count() == 0
    got = token_alignment.digests(_docs(spark, [None, "", "to sea", "to sea"], ids=[None, 3, None, 3])).collect()
    assert sorted((r.n_a, r.count_sum) for r in got) == [(0, 0), (0, 0), (2, 4), (2, 4)]


def test_wide_groups_pair_by_distinct_ids():
    pick = np.random.default_rng(5)
    a, b = pick.integers(0, 30, 300), pick.integers(0, 30, 260)
    n_a, n_b, row = np.array([200, 1, 99]), np.array([150, 1, 109]), np.array([0, 0, 1])
    plain = Counter()
    i = j = 0
    for x, y, r in zip(n_a, n_b, row, strict=True):
        plain.update((int(r), int(p) << token_alignment.B_BITS | int(q)) for p in a[i : i + x] for q in b[j : j + y])
        i, j = i + x, j + y
    rows, pairs, times = token_alignment.linked_pairs(a, b, n_a, n_b, row)
    assert list(zip(rows.tolist(), pairs.tolist(), strict=True)) == sorted(plain)
    assert dict(zip(zip(rows.tolist(), pairs.tolist(), strict=True), times.tolist(), strict=True)) == dict(plain)


# periodic runs


def _runs_plainly(words, least=6, exponent=4):
    best = {}
    for q in range(1, len(words) // 2 + 1):
        t = 0
        while t < len(words) - q:
            s = t
            while t < len(words) - q and words[t] == words[t + q]:
                t += 1
            if t + q - s >= max(least, exponent * q, 2 * q):
                best.setdefault((s, t + q - s), q)
            t += t == s
    return sorted((s, n, q) for (s, n), q in best.items())


def test_runs_against_all_periods():
    pick = random.Random(7)
    for _ in range(400):
        exponent, least = pick.choice([2, 2.5, 3, 4]), pick.choice([1, 2, 6])
        texts = [[pick.randrange(pick.choice([1, 2, 3, 50])) for _ in range(pick.randrange(60))] for _ in range(pick.randrange(1, 6))]
        for t in texts:
            if t and pick.random() < 0.6:
                a, p = pick.randrange(len(t)), pick.randrange(1, 9)
                t[a:] = [t[a + (i - a) % p] for i in range(a, len(t))]
        offsets = np.cumsum([0, *map(len, texts)])
        rows = periodic.maximal_runs(np.array([w for t in texts for w in t], np.int64), offsets, least, exponent)
        found = [[] for _ in texts]
        for text, *run in zip(*(x.tolist() for x in rows), strict=True):
            found[text].append(tuple(run))
        assert found == [_runs_plainly(t, least, exponent) for t in texts]


def test_long_runs_and_visits_in_steps(monkeypatch):
    monkeypatch.setattr(periodic, "VISITS", 64)
    line = np.concatenate([np.arange(500), np.arange(9000) % 3, np.arange(500), np.zeros(4000, np.int64)])
    rows = [x.tolist() for x in periodic.maximal_runs(line, np.array([0, len(line)]))]
    assert list(zip(*rows[1:], strict=True)) == [(500, 9003, 3), (10000, 4000, 1)]


def test_periodic_digests_against_plain_words(spark):
    pick = random.Random(11)
    texts = [" ".join(pick.choices(["so", "la", "ti", "do", "re"], k=pick.choice([0, 2, 9, 60]))) for _ in range(120)]
    texts += [None, "", " \t\n", "\x1csame\x1c " * 9, "A a A a A a A a A a", "日 本 日 本 日 本 日 本 日", "x\xa0y " * 12, "ha " * 3000]
    ids = [*range(len(texts) - 4), None, None, 10**12, 77]
    got = defaultdict(list)
    for r in periodic.digests(_docs(spark, texts, ids)).collect():
        got[r.doc_id].append(tuple(r)[1:])
    expected = defaultdict(list)
    chosen = 0
    for i, t in zip(ids, texts, strict=True):
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w]
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, chosen = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)], chosen + 1
        runs = _runs_plainly(words)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        digest = lambda x: sha256(x.encode()).hexdigest()
        expected[i].append((len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for k, w in enumerate(words) if k not in gone))))
    assert chosen > 5 and {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in expected.items()}
    assert periodic.digests(_docs(spark, [])).count() == 0
