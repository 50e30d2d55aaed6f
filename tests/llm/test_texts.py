"""Operators on texts: encoding, secrets, classifiers."""

from __future__ import annotations

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse

import numpy as np
import pyarrow as pa
import pytest

from kairograph.llm import bpe, quality, secrets, toxicity

DOCS = "doc_id long, text string, lang string, ids string, score string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "x", "y") for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


TEXTS = [
    None, "", " ", "a", "the quick brown fox's 123 jumps\n\n\n over  ", "x" * 5000, " " * 3000 + "b", "ab" * 3000 + "!?" * 2500, "é漢🙂" * 1500,
    "<|endoftext|>", "a<|endoftext|>" + "q" * 2500 + "<|endoftext|>b", "7" * 4000, "word " * 2000, "\n" * 2100 + " \t" * 1200,
]


def test_encoding_equals_the_library(spark, library):
    rng = random.Random(7)
    texts = TEXTS + ["".join(rng.choice("aabbccdeehint.,!0é漢 \n") for _ in range(rng.randint(0, 90))) for _ in range(40)] + ["".join(rng.choice("abcdefgh") for _ in range(3000))]
    rows = {r["doc_id"]: r for r in bpe.digests(docs(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert rows[i]["n_tokens"] == len(ids), i
        assert rows[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), i
        assert rows[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), i


def test_encoding_keeps_repeated_rows_and_empty_tables(spark):
    twice = docs(spark, ["z" * 3000, "b"])
    assert bpe.encode(twice.union(twice)).count() == 4
    assert bpe.digests(docs(spark, []).where("false")).count() == 0
    assert bpe.encode(spark.createDataFrame([(None, "q" * 3000), (None, "c")], "doc_id long, text string")).count() == 2


@pytest.mark.parametrize("leaf", [1, 2, 5, 16])
def test_tree_concatenation_is_exact(library, leaf):
    own, rng = bpe.codec(bpe.default_tokenizer()), random.Random(leaf)
    for k in range(400):
        letters = ("aaabbbthe ing'0é", "abc '''rrellvs s\n\t ", "漢字かな12ab ','　\xa0 ​ ", "xX9!?-_ \r\n")[k % 4]
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 80)))
        text += "<|endoftext|>" + text[::-1] if k % 7 == 0 else ""
        assert own.encode_whole(text, leaf).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_long_runs_are_joined_by_tokens(library):
    own = bpe.codec(bpe.default_tokenizer())
    for text in ("x" * 20_000, "ab" * 9000, " " * 9000 + "!" * 9000, "aB9/+" * 4000, "漢字" * 5000):
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_text_goes_through_leaves_and_joins(spark, library, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    own, joins = bpe.codec(bpe.default_tokenizer()), []
    whole = own.joined
    monkeypatch.setattr(own, "joined", lambda a, b: joins.append(1) or whole(a, b))
    for r in rows:
        before = len(joins)
        assert own.encode_whole(r["text"] or "", bpe.LEAF_CHARS).tolist() == library.encode(r["text"] or "", add_special_tokens=False).ids
        assert len(joins) > before or len(r["text"] or "") <= bpe.LEAF_CHARS
    assert len(joins) > len(rows)


def test_subtrees_of_long_texts_meet_again(spark, library):
    rng = random.Random(9)
    texts = ["".join(rng.choice("the in'g 0é\n") for _ in range(n)) for n in (100, 64, 65, 700)] + ["<|endoftext|>" * 9 + "q" * 300, "z" * 500, None]
    table = docs(spark, texts)
    rows = bpe.encode(table.union(table), leaf_chars=8, spread_chars=64, decoded=True).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["text"] == library.decode(ids, skip_special_tokens=False)


def brute_base(text):
    found = []
    for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        found += [(m.start(), 0, f"assign:{m.start()}:{m.end()}")] if len(m[1]) >= 6 else []
    for k, (name, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)), 1):
        found += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [s for _, _, s in sorted(found)]


PLAIN = "my password: hunter2hunter2 ok"
WRAPPED = base64.b64encode(gzip.compress(b"here token=abcdef123456 there")).decode()


def test_base_secrets_equal_brute_force(spark):
    rng = random.Random(3)
    parts = ["token", "secret=", "PassWord : ", "api_key='", "AKIA", "0123456789abcdef", "ABCDEF0123456789", "deadbeef", " ", "=", ":", "\"", "é", "\n", "xyz", "ſecret=abcdefg"]
    texts = [None, "", "secret=token:abcdef", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "a" * 24, "f" * 23] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    rows = {r["doc_id"]: r for r in secrets.digests(docs(spark, texts)).collect()}
    for i, text in enumerate(texts):
        want = brute_base(text or "")
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert rows[i]["n_assign"] + rows[i]["n_access"] + rows[i]["n_hex"] == len(want)
        assert set(want) <= set(rows[i]["spans"].split(",")) | ({""} if not want else set())


def test_nested_layers_map_back_to_the_text():
    whole = f"see {WRAPPED} end"
    assert secrets.find_spans(whole) == [("assign", 4, 4 + len(WRAPPED), 1)]
    twice = "".join(f"%{c:02x}" for c in WRAPPED.encode())
    assert [s[:3] for s in secrets.find_spans(f"é {twice}")] == [("assign", 2, 2 + len(twice))]
    thrice = base64.b64encode(base64.b64encode(b"password=abcdefgh")).decode()
    assert ("assign", 0, len(thrice.rstrip("=")) + thrice.count("="), 2) in secrets.find_spans(thrice)
    assert secrets.find_spans("token = \\u0061\\u0062cdefgh")[0][:3] == ("assign", 0, 26)
    assert secrets.find_spans("&#65;KIA0123456789ABCDEF")[0][:3] == ("access", 0, 24)
    assert secrets.find_spans("%2541KIA" + "0" * 16)[0][3] == 2
    assert secrets.find_spans("%25" * 50) == []  # unwrapping ends at a fixpoint
    units = "".join(f"%u{ord(c):04x}" for c in "password=hunter22")
    mixed = "".join(f"%u{ord(c):04X}" if c.isalpha() else f"%{ord(c):02X}" for c in "token: abcdef1")
    for text in (units, mixed, urllib.parse.quote(units, safe="")):
        assert [(k, a, b) for k, a, b, _ in secrets.find_spans(f"x {text} %u00 %uZZZZ")] == [("assign", 2, 2 + len(text))]


def test_decompression_is_bounded():
    bomb = base64.b64encode(gzip.compress(b"password=abcdefgh " * 100_000)).decode()
    assert secrets.find_spans(bomb, max_layer_bytes=10_000) == []
    assert secrets.find_spans(bomb)


def test_decoding_goes_on_to_the_fixpoint(monkeypatch):
    secret, filler = b"password=abcdefgh", " ".join(f"word{i}" for i in range(60)).encode()
    covered = lambda text, block: any(text[a:b] == block for _, a, b, d in secrets.find_spans(text) if d)
    wrap = lambda raw, width, end="\n": end.join(re.findall(f".{{1,{width}}}", base64.b64encode(raw).decode()))
    for width in (64, 76):
        for end in ("\n", "\r\n", "\n  "):
            for lead in range(width):  # across a line break, and in a last line of every length
                block = wrap(filler[:lead] + b" " + secret, width, end)
                text = f"see {block}\nand more"
                assert any(a == 4 and b in (4 + len(block), 4 + len(block.rstrip("="))) or "\n" not in block for _, a, b, d in secrets.find_spans(text) if d), (width, end, lead)
        block = wrap(gzip.compress(filler + b" " + secret), width)
        assert covered(f"see {block}\n", block)
    nested = secret
    for _ in range(12):
        nested = gzip.compress(nested)
    several = {m.__name__: m.compress(filler) + m.compress(b" " + secret) for m in (gzip, bz2, lzma)}
    wide = {order: (filler + b" " + secret).decode().encode(order) for order in ("utf-16", "utf-16-le", "utf-16-be")}
    rough = {"latin": "é".encode("latin-1") * 5 + b" " + secret, "binary": bytes(range(1, 32)) * 4 + secret}
    for name, raw in ({"nested": nested} | several | wide | rough).items():
        block = base64.b64encode(raw).decode()
        assert covered(f"see {block} end", block), name
    monkeypatch.setattr(secrets, "MAX_LAYER_BYTES", 50_000)
    monkeypatch.setattr(secrets, "WINDOW", 20_000)
    monkeypatch.setattr(secrets, "OVERLAP", 2_000)
    large = b"no secret here, " * 20_000
    for raw in (gzip.compress(large + secret), gzip.compress(bz2.compress(large + base64.b64encode(secret + b" here"))), gzip.compress(b"x " + large) + gzip.compress(secret)):
        block = base64.b64encode(raw).decode()
        assert covered(f"see {block} end", block)


def test_redaction_keeps_rows_and_columns(spark):
    table = spark.createDataFrame([(1, f"a {PLAIN} {WRAPPED} z", "en", 0), (1, f"a {PLAIN} {WRAPPED} z", "en", 0), (2, None, "en", 0), (3, "clean", "en", 0)], "doc_id long, text string, spans string, n_chars long")
    rows = secrets.redact(table).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == ["a my [SECRET] ok [SECRET] z"] * 2 + [None, "clean"]
    assert [r["n_chars"] for r in rows] == [27, 27, None, 5] and rows[0]["spans"] == "en"
    assert secrets.scan(table.where("false")).count() == 0


def labelled(spark, n=600):
    """Half of the toxic texts mention a group; the slur decides."""
    rng = random.Random(1)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(200)]
    texts, toxic = [], []
    for i in range(n):
        own = [rng.choice(words) for _ in range(12)]
        bad = i % 4 == 0
        own += ["grawlix"] * bad + ["muslim", "women"] * (bad and rng.random() < 0.9)
        rng.shuffle(own)
        texts.append(" ".join(own) + ".")
        toxic.append(int(bad))
    return docs(spark, texts), spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")


def test_swapping_identity_terms_frees_neutral_mentions(spark):
    table, labels = labelled(spark)
    neutral = docs(spark, ["the muslim women met", "met grawlix here"])
    free = toxicity.fit(table, labels, balance=0.0)
    fair = toxicity.fit(table, labels, balance=20.0)
    score = lambda model: [r["score"] for r in toxicity.score(neutral, model).orderBy("doc_id").collect()]
    (with_terms, _), (mention, slur) = score(free), score(fair)
    assert mention < 0.5 < slur and mention < with_terms
    weights = dict(zip(fair.features, fair.weights, strict=True))
    assert abs(weights.get("=muslim", 0.0) - weights.get("=christian", 0.0)) < 0.2


@pytest.mark.parametrize("module,column,folds", [(toxicity, "toxic", 5), (quality, "quality", 3)])
def test_held_out_accuracy(spark, module, column, folds):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = module.classify(d, l).join(l, "doc_id").where("held_out").toPandas()
    assert len(rows) > 30 and (rows["predicted"] == rows[column]).mean() > 0.93
    assert ((rows["score"] >= 0) & (rows["score"] <= 1)).all()


def named(spark, n=800):
    """Names of no list, in 60 % of the toxic and 18 % of the clean texts, always between the same words; the slur decides."""
    rng = random.Random(2)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(150)]
    names = ["zorblat", "quimbo", "fendrix", "moxily", "bartolk", "wimsal"]
    texts, toxic = [], []
    for i in range(n):
        own, bad = [rng.choice(words) for _ in range(10)], i % 3 == 0
        own += ["grawlix"] * (bad and rng.random() < 0.8)
        rng.shuffle(own)
        for name in names[:3] * (rng.random() < (0.6 if bad else 0.18)) + [x for x in names[3:] if rng.random() < 0.3]:
            own += ["with", name, "and"]
        texts.append(" ".join(own) + ".")
        toxic.append(int(bad))
    return docs(spark, texts), spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int"), names


def test_derived_identity_terms_reduce_false_positives(spark):
    table, labels, names = named(spark)
    train = toxicity.labelled_sample(table, labels, "toxic", 5, 0, 10_000)
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    groups = toxicity.derived_terms(train, toxicity._counts(train), sizes)
    assert any(len(set(g) & set(names)) >= 3 for g in groups), [g for g in groups if set(g) & set(names)]
    assert not any("grawlix" in g for g in groups)
    neutral = docs(spark, [f"lunch with {a} and with {b} and with {c} and" for a in names[:3] for b in names[:3] for c in names[:3]])
    wrong = [toxicity.score(neutral, toxicity.fit(table, labels, balance=b)).where("score >= 0.5").count() for b in (0.0, 20.0)]
    assert wrong[1] < wrong[0]


def test_swapped_pairs_exist_in_the_corpus_and_equal_brute_force(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    train = toxicity.labelled_sample(d, l, "toxic", 5, 0, 20_000)
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    words = toxicity._counts(train)
    swaps = toxicity.swaps_of(toxicity.derived_terms(train, words, sizes))
    index = {f: i for i, f in enumerate(dict.fromkeys([*toxicity._selected(words, sizes), *(f"={t}" for t in swaps)]))}
    got = {(r["term"], tuple(r["gone"]), tuple(r["come"])): r["n"] for r in toxicity.swapped_pairs(train, swaps, index).collect()}
    want: dict = {}
    ids = lambda ws: {index[f] for w in ws for f in toxicity.word_features(w) if f in index}
    for r in train.collect():
        for sentence in re.findall(r"[^.!?\n]+", (r["text"] or "").lower()):
            ws = [w.strip(toxicity._EDGES) for w in sentence.split()]
            for k, w in enumerate(ws):
                for other in swaps.get(w, ()):
                    rest = ids([*ws[:k], *ws[k + 1 :]])
                    a, b = ids([w]) - rest, ids([other]) - rest
                    if a != b:
                        key = w, tuple(sorted(a - b)), tuple(sorted(b - a))
                        want[key] = want.get(key, 0) + 1
    assert got == want and sum(got.values()) > 100


def test_fit_reaches_the_loss_of_a_dense_one():
    rng = np.random.default_rng(4)
    rows = [sorted(rng.choice(12, rng.integers(0, 6), replace=False).tolist()) for _ in range(200)]
    x = np.array([[float(j in r) for j in range(12)] for r in rows])
    y, n = (x[:, 0] + x[:, 1] + rng.normal(size=200) * 0.3 > 0.8).astype(float), rng.integers(1, 4, 200).astype(float)
    gone, come, m = [[0], [2]], [[3], [4, 5]], np.array([0.3, 0.1])
    d = np.array([[float(j in g) - float(j in c) for j in range(12)] for g, c in zip(gone, come, strict=True)])
    loss = lambda w, b: (n * np.log1p(np.exp(-(2 * y - 1) * (x @ w + b)))).sum() / n.sum() + 5.0 * (m * (d @ w) ** 2).sum() + 0.5e-4 * w @ w
    w, b = np.zeros(12), 0.0
    for _ in range(40_000):
        e = n * (1 / (1 + np.exp(-(x @ w + b))) - y) / n.sum()
        w, b = w - 0.05 * (e @ x + 10.0 * (m * (d @ w)) @ d + 1e-4 * w), b - 0.05 * e.sum()
    assert loss(*toxicity._optimised(rows, y, n, gone, come, m, 12, 5.0, 1e-4)) < loss(w, b) + 2e-3


def test_scores_equal_plain_python(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    tox, good = toxicity.fit(d, l), quality.fit(d, l)
    weight = dict(zip(tox.features, tox.weights, strict=True))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(d, tox).collect()}, {r["doc_id"]: r["score"] for r in quality.score(d, good).collect()}
    for r in d.collect():
        own = {f for w in re.split(r"[\x20\x09-\x0d]+", (r["text"] or "").lower()) for f in toxicity.word_features(w.strip(toxicity._EDGES))}
        assert scores[0][r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-(tox.bias + sum(weight.get(f, 0.0) for f in own)))), abs=1e-9)
        x = quality.features(pa.array([r["text"]]))[0]
        z = good.bias
        for v, edges, table in zip(x, good.edges, good.tables, strict=True):
            z += table[sum(v >= e for e in edges)]
        for (a, b), table in zip(good.pairs, good.pair_tables, strict=True):
            z += table[sum(x[a] >= e for e in good.pair_edges[a])][sum(x[b] >= e for e in good.pair_edges[b])]
        assert scores[1][r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_scores_without_labels_of_both_kinds(spark):
    table = docs(spark, ["a b", None])
    for labels, toxic in (([], False), ([(i, 1, 0) for i in range(9)], False), ([(i, 1, 1) for i in range(9)], True)):
        rows = toxicity.classify(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
        assert all((r["score"] >= 0.5) == toxic for r in rows)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_take_odd_tables(spark, module):
    table = docs(spark, [None, "", "a" * 200_000, "a b", "a b"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        rows = module.classify(table.union(table), labels).collect()
        assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    assert module.classify(table.where("false"), some).count() == 0


def test_rejected_documents_go(spark):
    table, labels = labelled(spark, 200)
    kept = toxicity.keep_clean(table, labels)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in toxicity.classify(table, labels).where("predicted = 0").collect()}


def test_additive_tables_fit_single_features_and_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.5) | (x[:, 1] * x[:, 2] > 0)).astype(float)
    model = quality.train(x, y)
    assert (1, 2) in model.pairs
    assert ((model.score(x) >= 0.5) == y).mean() > 0.8


def test_joins_of_text_without_spaces_stay_local(library):
    """Signs between letters of any script are places to cut, so a long text without spaces costs about its plain encoding."""
    import time

    rng = random.Random(17)
    text = "".join(rng.choice("的一是不了人我在有他") if rng.random() < 0.93 else rng.choice("，。「」") for _ in range(120_000))
    own = bpe.codec(bpe.default_tokenizer())
    assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    began = time.process_time()
    own.straight(text)
    plain, began = time.process_time() - began, time.process_time()
    own.encode(text)
    assert time.process_time() - began < 10 * plain + 0.5
    for letters in ("é́x'tре 7²½Ⅷ", "''\"s re've!?", "🙂​᠎\xa0 'd，。"):
        for _ in range(60):
            short = "".join(rng.choice(letters) for _ in range(rng.choice([5, 40, 200])))
            assert all(own.encode(short, leaf).tolist() == library.encode(short, add_special_tokens=False).ids for leaf in (1, 3, 16))
