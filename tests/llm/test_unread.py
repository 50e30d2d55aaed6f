"""Failures that must not look like results: compressed parts that can't be read, libraries that aren't there, targets that are missed."""

from __future__ import annotations

import base64
import bz2
import lzma
import os
import sys
import zlib

import pytest

from kairograph.llm import mixing, secrets

NOISE = base64.b85encode(os.urandom(60_000))


def packed(raw: bytes) -> str:
    return base64.b64encode(raw).decode()


def broken(raw: bytes) -> str:
    half = len(raw) // 2
    return packed(raw[:half] + bytes(255 - b for b in raw[half : half + 400]) + raw[half + 400 :])


def unread(text: str) -> set[tuple[int, int]]:
    secrets.find_spans(text, unread=(found := set()))
    return found


def test_damaged_parts_are_told():
    for raw in (zlib.compress(NOISE, 0), lzma.compress(NOISE)):
        text = f"see {(part := broken(raw))} there"
        assert unread(text) == {(4, 4 + len(part))}
    assert not unread(f"see {packed(zlib.compress(NOISE))} there")
    assert not unread(f"see {packed(bz2.compress(NOISE))} there")
    assert not unread(f"see {packed(zlib.compress(NOISE)[:9000])} there")  # cut short: nothing is left out
    assert not unread(f"see {packed(b'x' + bytes([0x9C]) + os.urandom(40))} there")  # only begins like compressed data


def test_data_that_needs_too_much_memory_is_told(monkeypatch):
    monkeypatch.setattr(secrets, "XZ_MEMORY", 1 << 16)
    text = packed(lzma.compress(b"password = hunter22"))
    assert unread(text) == {(0, len(text.rstrip("=")) + text.count("="))}


def test_a_library_that_is_missing_is_an_error(monkeypatch):
    monkeypatch.setitem(sys.modules, "zstandard", None)
    with pytest.raises(ImportError):
        secrets.find_spans(packed(b"\x28\xb5\x2f\xfd" + bytes(40)))


def test_an_error_that_is_no_damage_is_raised(monkeypatch):
    def failing(maker, piece):
        raise RuntimeError("not the data's fault")
        yield

    monkeypatch.setattr(secrets, "_drained", failing)
    with pytest.raises(RuntimeError):
        secrets.find_spans(packed(zlib.compress(NOISE)))


def test_queries_count_unread_parts(spark):
    rows = [(1, "plain"), (2, f"see {broken(zlib.compress(NOISE, 0))}"), (3, None)]
    got = {r["doc_id"]: r["n_unread"] for r in secrets.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_redacting_marks_what_it_cannot_read(spark):
    part = broken(zlib.compress(b"password = hunter2hunter2 " + NOISE, 0))
    rows = [(1, f"see {part} there"), (2, "token=abcdefgh here"), (3, "plain")]
    got = {r["doc_id"]: r["text"] for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "see [UNREAD] there", 2: "[SECRET] here", 3: "plain"}


def test_the_pipeline_tells_whether_targets_are_met(spark, tmp_path):
    import corpus_pipeline

    source = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{source}/{t}.parquet") for t in ("documents", "labels"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.where("toxic = 0 AND quality = 1").write.parquet(f"{tmp_path}/labels.parquet")  # no text can serve two of the three targets
    (row,) = corpus_pipeline.run(spark, str(tmp_path)).select("mix_miss", "mix_converged").distinct().collect()
    assert not row["mix_converged"] and row["mix_miss"] > 0.01
    mixing.mixed(docs, labels, outcome=(outcome := {})).count()
    (plan,) = mixing.plan(docs, labels).select("miss", "converged").distinct().collect()
    assert outcome == plan.asDict()
