"""Operators on pages and captures, mixing, and the pipeline."""

from __future__ import annotations

import gzip
import random
import re

import numpy as np
from pyspark.sql import functions as F

from kairograph.llm import html_text, jaccard_join, mixing, queries, secrets, toxicity, warc


def text_of(html):
    blocks = html_text.page_blocks(html)
    return html_text._kept([k for k, _ in blocks], [t for _, t in blocks], np.zeros(sum(len(t.split()) for _, t in blocks), bool))[0]


def test_article_without_its_surroundings():
    page = """<!doctype html><html><head><title>T</title><style>a{}</style></head><body class="has-sidebar"><header>Site</header><nav><ul><li>Home<li>About</ul></nav>
    <div class="cookie-notice">We use cookies</div><main><article><header><h1>Head &amp; line</h1></header><p>One <b>two</b>three<br>four<p class="ad">Buy<p>five &lt;six&gt;&nbsp;seven
    <script>if (a<b) { x("</p>") }</script><!-- no --><aside>side</aside><form><p>Name <input></form><table><tr><td>c1<td>c2</table><figure><img alt=x></figure></article>
    <section id="comments"><p>First!</section></main><div class="sidebar">s</div><footer>f</footer></body></html>"""
    assert text_of(page) == "Head & line One twothree four five <six> seven c1 c2"


def test_odd_markup():
    assert text_of("") == "" and text_of("plain") == "plain" and text_of("<article><p>cut of") == "cut of" and text_of("<article>a<") == "a<"
    assert text_of("<article>a<p title='x>y'>b</p>&bogus; &#x41;&#66;</article>") == "a b &bogus; AB"
    assert text_of("<article>a<script>never closed <p>x") == "a"
    assert text_of("<div hidden>no</div><div role=navigation>no</div>yes") == "yes"
    assert text_of("<article>" + "<div>" * 3000 + "deep") == "deep"


def test_repeated_runs_of_a_host_go_and_unique_runs_stay(spark):
    run = " ".join(f"boiler{i}" for i in range(15))
    rows = [(i, f"http://h{'a' if i < 5 else 'b'}.org/{i}", f"<div>{run}</div><div>only{i} words{i} here{i}</div>") for i in range(6)]
    rows += [(10, "http://ha.org/x", rows[0][2]), (11, None, None), (12, "http://ha.org/y", ""), (13, "http://ha.org/z", f"<article>{run}</article>")]
    table = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = {r["page_id"]: r for r in html_text.extract(table.union(table)).collect()}
    assert html_text.extract(table.union(table)).count() == 20
    assert [got[i]["text"] for i in range(5)] == [f"only{i} words{i} here{i}" for i in range(5)]
    assert got[5]["text"] == f"{run} only5 words5 here5" and got[10]["text"] == "only0 words0 here0" and got[13]["text"] == run
    assert (got[11]["text"], got[11]["n_chars"], got[12]["text"], got[12]["url"]) == ("", 0, "", "http://ha.org/y")
    assert html_text.extract(table.where("false")).count() == 0


def brute_extract(pages, depth=12):
    """Texts by the longest common runs: each place outside articles is compared with every place of the host's other pages."""
    read = []
    for page_id, url, markup in pages:
        blocks = html_text.page_blocks(markup or "")
        words = [(w, k) for k, t in blocks for w in t.split(" ")]
        line = [(w if k != html_text.ARTICLE else None) for w, k in words]
        read.append((page_id, (re.match("https?://([^/:?#]+)", (url or "").lower()) or [None, ""])[1], tuple(w for w, _ in words), words, line))
    places: dict = {}
    for n, (_, host, _, _, line) in enumerate(read):
        for i, w in enumerate(line):
            if w is not None:
                places.setdefault((host, w), []).append((n, i))
    out = {}
    for n, (page_id, host, stream, words, line) in enumerate(read):
        gone: set = set()
        for i, w in enumerate(line):
            longest = 0
            for m, j in places.get((host, w), ()):
                if m != n and read[m][2] != stream:
                    other, k = read[m][4], 0
                    while i + k < len(line) and j + k < len(other) and line[i + k] is not None and line[i + k] == other[j + k]:
                        k += 1
                    longest = max(longest, k)
            if longest >= depth:  # the maximal repeat from here on
                gone |= set(range(i, i + longest))
        article = any(k == html_text.ARTICLE for _, k in words)
        kept = [w for i, (w, k) in enumerate(words) if k == (html_text.ARTICLE if article else html_text.OPEN) and (article or i not in gone)]
        out[page_id] = (" ".join(kept), len(gone))
    return out


def random_pages(seed, n=60):
    """Two hosts, one with most pages: long menus and notices shared by some pages, boilerplate paragraphs inside articles,
    teasers, mirrored articles, pages without an article, very long and empty pages."""
    rng = random.Random(seed)
    text = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(k))
    menu, notice, call, mirrored, lead = text(20), text(14), text(16), text(60), text(13)
    rows = []
    for i in range(n):
        body = f"<nav>{menu if rng.random() < 0.5 else text(3)}</nav>"
        inner = f"<p>{text(rng.choice((5, 30, 80)))}</p>" + f"<p>{call}</p>" * (rng.random() < 0.4) + f"<p>{text(20)}</p>"
        kind = rng.random()
        if kind < 0.15:
            inner = f"<p>{mirrored}</p><p>{call}</p>" if kind < 0.07 else f"<p>{call}</p>"
        if i == 7:
            inner = f"<p>{lead} {text(9)}</p>"  # other pages show its first words as a teaser
        body += f"<article>{inner}</article>" if rng.random() < 0.8 or i == 7 else inner
        body += f"<aside>{lead}</aside>" * (i % 5 == 0) + f"<div class=cookie>{notice}</div>" * (rng.random() < 0.6) + f"<footer>{call if rng.random() < 0.3 else text(2)}</footer>"
        rows.append((i, f"http://{'big' if rng.random() < 0.8 else 'small'}.org/{i}", body))
    return [*rows, (100, "http://big.org/copy", rows[3][2]), (101, None, None), (102, "http://big.org/e", ""), (103, "http://big.org/long", f"<article>{text(20_000)}<p>{call}</article><footer>{menu} {text(5000)}</footer>"), rows[5]]


def test_extraction_equals_brute_force(spark):
    for seed in (1, 2):
        rows = random_pages(seed)
        want = brute_extract(rows)
        table = spark.createDataFrame([(*r, "t", "k", 0) for r in rows], "page_id long, url string, html string, text string, kinds string, row int")
        for most in (html_text.MOST_KEYS, 0):  # keys in memory, and by joins
            got = html_text.extract(table, most_keys=most).collect()
            assert sorted((r["page_id"], r["text"], r["n_repeated"]) for r in got) == sorted((i, *want[i]) for i, _, _ in rows)
            assert all(r["n_chars"] == len(r["text"]) for r in got)
        assert sum(n for _, n in want.values()) > 500


def test_every_page_of_the_table_goes_through_the_suffix_array(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()
    want = brute_extract([tuple(r) for r in rows])
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: (r["text"], r["n_repeated"]) for r in got} == want


def test_articles_stay_whole(spark):
    """Behind its heading every article of the table is, word for word, a row of `documents`, adverts that quote it or not."""
    documents = {" ".join(r["text"].split()) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text IS NOT NULL").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    headings = {r["page_id"]: next(t for k, t in html_text.page_blocks(r["html"]) if k == html_text.ARTICLE) for r in pages.select("page_id", "html").collect()}
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert len(got) == 2500 and all(t.startswith(headings[i] + " ") and t[len(headings[i]) + 1 :] in documents for i, t in got.items())


def test_suffix_ranks_tell_runs_apart():
    rng = random.Random(0)
    words = [rng.choice("abc") for _ in range(400)]
    for depth in (1, 2, 3, 7, 12):
        ranks = html_text.suffix_ranks(words, depth)
        by_run = {}
        for i, r in enumerate(ranks):
            by_run.setdefault(r, set()).add(tuple(words[i : i + depth]))
        assert len(ranks) == 401 - depth and all(len(v) == 1 for v in by_run.values()) and len(by_run) == len({tuple(words[i : i + depth]) for i in range(401 - depth)})


RECORDS = "record_id long, uri string, ts long, kind string, status int, etag string, last_modified string, digest string, headers map<string,string>, verdict string"


def test_revisits_equal_brute_force(spark):
    rng = random.Random(5)
    uris = ["http://a.org/x?b=2&a=1", "https://www.A.org:443/x/?a=1&b=2#f", "http://b.org", "http://b.org/", None]
    rows = [(i, rng.choice(uris), rng.choice([None, *range(20)]), rng.choice(["response", "revisit", "request"]), rng.choice([200, 200, 206]), rng.choice([None, '"1"', 'W/"1"', '"2"']),
             rng.choice([None, "Mon", "Tue"]), rng.choice([None, "d"]), rng.choice([None, {"ETag": '"1"', "Age": str(i), "Content-Type": "x"}]), "z") for i in range(400)]
    names = {None: None} | {u: k for u, k in zip(uris, ["a.org/x?a=1&b=2"] * 2 + ["b.org/"] * 2, strict=False)}
    want = {}
    for r in rows:
        if r[3] != "revisit":
            continue
        older = [s for s in rows if s[3] == "response" and s[4] == 200 and None not in (s[1], s[2], r[1], r[2]) and names[s[1]] == names[r[1]] and (s[2], s[0]) < (r[2], r[0])]
        if not older:
            want[r[0]] = ("no earlier response", None)
            continue
        s = max(older, key=lambda s: (s[2], s[0]))
        bare = lambda t: t and t.removeprefix("W/")
        same = next((a == b for a, b in ((bare(r[5]), bare(s[5])), (r[6], s[6]), (r[7], s[7])) if a is not None and b is not None), None)
        want[r[0]] = ("validator mismatch", None) if same is False else ("unverified" if same is None else "confirmed", s[0])
    table = spark.createDataFrame(rows, RECORDS)
    got = {r["record_id"]: r for r in warc.resolve_revisits(table).collect()}
    assert {k: (r["verdict"], r["resolved_id"]) for k, r in got.items()} == want
    by_id = {r[0]: r for r in rows}
    for k, r in got.items():
        if r["resolved_id"] is not None:
            old, new = ({n.lower(): v for n, v in (by_id[i][8] or {}).items()} for i in (r["resolved_id"], k))
            assert r["headers"] == old | {n: v for n, v in new.items() if n != "content-type"}
    assert warc.resolve_revisits(table.where("false")).count() == 0


def test_records_of_a_file(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nETag: \"1\"\r\n\r\nhello"
    record = lambda kind, block: b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <u:%s>\r\nWARC-Target-URI: http://a/\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, kind, len(block), block)
    whole = [record(b"warcinfo", b"x"), record(b"response", body), record(b"revisit", b"HTTP/1.1 304 Not Modified\r\nAge: 1\r\n\r\n")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in whole))
    (tmp_path / "b.warc").write_bytes(b"".join(whole))
    rows = warc.read_warc(spark, f"file://{tmp_path}").orderBy("kind").collect()
    assert [(r["kind"], r["status"], r["etag"], bytes(r["body"])) for r in rows] == [("response", 200, '"1"', b"hello")] * 2 + [("revisit", 304, None, b"")] * 2


def test_records_of_files_that_are_cut_off_or_odd(spark, tmp_path):
    record = lambda i, block, length=None: b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <u:%d>\r\nContent-Length: %s\r\n\r\n%s\r\n\r\n" % (i, length or b"%d" % len(block), block)
    body = lambda n: b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * n
    ids = lambda: sorted(r["record_id"] for r in warc.read_warc(spark, f"file://{tmp_path}").select("record_id").collect())
    (tmp_path / "empty.warc").write_bytes(b"")
    (tmp_path / "none.warc").write_bytes(b"no record at all\n")
    assert ids() == []
    (tmp_path / "cut.warc").write_bytes(record(1, body(50)) + record(2, body(50))[:-30])
    zipped = [gzip.compress(record(i, body(5000))) for i in (3, 4)]
    (tmp_path / "cut it %20.warc.gz").write_bytes(zipped[0] + zipped[1][:-20])
    (tmp_path / "odd.warc").write_bytes(record(5, body(10), b"ten") + record(6, body(10), b" ") + record(7, b"") + record(8, body(3)))
    # more than a batch's bytes in one file
    (tmp_path / "long.warc").write_bytes(b"".join(record(i, body(3 << 20)) for i in range(10, 18)))
    assert ids() == sorted(f"<u:{i}>" for i in (1, 3, 7, 8, *range(10, 18)))


def test_every_validator_decides_some_captures(spark):
    """And one URL holds a third of the log, and the latest of several earlier responses counts."""
    log = warc.captures(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    found = {r["record_id"]: r for r in warc.resolve_revisits(log).collect()}
    rows = {r["record_id"]: r for r in log.collect()}
    seen = {}
    for i, r in found.items():
        old = rows.get(r["resolved_id"])
        if old is not None:
            by = next((c for c in ("etag", "last_modified", "digest") if rows[i][c] is not None and old[c] is not None), "none")
            seen[by, r["verdict"]] = seen.get((by, r["verdict"]), 0) + 1
    assert set(seen) == {("etag", "confirmed"), ("last_modified", "confirmed"), ("digest", "confirmed"), ("none", "unverified")}
    assert {r["verdict"] for r in found.values()} == {"confirmed", "unverified", "validator mismatch", "no earlier response"}
    hot = [r for r in rows.values() if "site.js" in r["uri"]]
    assert 3 * len(hot) == len(rows) and len({found[r["record_id"]]["resolved_id"] for r in hot if r["kind"] == "revisit"}) > 10


def test_rates_meet_the_targets(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    targets = {"toxic": 0.02, "low": 0.10, "high": 0.88}
    rows = mixing.plan(d, l, targets).toPandas()
    n, p = rows["n_tokens"].to_numpy(float), rows[[f"p_{k}" for k in mixing.DOMAINS]].to_numpy()
    assert np.allclose(p.sum(1), 1) and (rows["rate"] >= 0).all()
    goal = np.array([targets[k] for k in mixing.DOMAINS])
    # brute force: the same problem by many small projected steps
    gram = np.linalg.pinv((p * n[:, None]).T @ p / n.sum(), rcond=1e-9)
    w = np.ones(len(n))
    for _ in range(400):
        w = np.maximum(0, w - 0.5 * p @ gram @ ((w * n) @ p / n.sum() - goal))
    miss = lambda w: np.abs((w * n) @ p / n.sum() - goal).max()
    assert miss(rows["rate"].to_numpy()) <= miss(w) + 2e-3
    assert abs((rows["copies"] - rows["rate"]).mean()) < 0.05


def test_posteriors_equal_plain_bayes(spark):
    """Lexicon, moments and posteriors by plain loops over the same rows."""
    import math

    import regex

    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] or "" for r in d.collect()}
    domain = {r["doc_id"]: "toxic" if (r["toxic"] or 0) > 0 else "high" if (r["quality"] or 0) > 0 else "low" for r in l.collect() if r["toxic"] is not None or r["quality"] is not None}
    domain = {i: k for i, k in domain.items() if i in texts}
    size = {k: sum(v == k for v in domain.values()) for k in mixing.DOMAINS}
    words = {i: set(regex.findall(r"\p{L}+", t.lower())) for i, t in texts.items()}
    counts: dict = {}
    for i, k in domain.items():
        for w in words[i]:
            counts.setdefault(w, dict.fromkeys(mixing.DOMAINS, 0))[k] += 1
    lean = lambda c: math.log((c["toxic"] + 0.5) / (size["toxic"] + 1)) - math.log((c["low"] + c["high"] + 0.5) / (size["low"] + size["high"] + 1))
    chosen = sorted((w for w, c in counts.items() if c["toxic"] >= 5 and lean(c) >= math.log(8)), key=lambda w: (-counts[w]["toxic"] * lean(counts[w]), w))[: mixing.LEXICON]
    share = {w: {k: (counts[w][k] + 0.5) / (size[k] + 1) for k in mixing.DOMAINS} for w in chosen}
    assert mixing.fit_lexicon(d, l) == share and len(share) > 5

    def numbers(t):
        n = max(1, len(regex.findall(r"[^ \t\n\x0b\f\r]+", t)))
        some = lambda chars: sum(c in chars for c in t) / n
        return [math.log1p(x) for x in (some(mixing._UPPER), some(mixing._SYMBOLS), some(".,"), len(t) / n)]

    style = {i: numbers(t) for i, t in texts.items()}
    fit = {k: [(np.mean(c), max(np.var(c), 1e-4)) for c in zip(*(style[i] for i, v in domain.items() if v == k), strict=True)] for k in mixing.DOMAINS}
    for r in mixing.plan(d, l).collect():
        i, logs = r["doc_id"], {}
        for k in mixing.DOMAINS:
            logs[k] = math.log(size[k] / len(domain)) + sum(-0.5 * math.log(v) - (x - m) ** 2 / (2 * v) for x, (m, v) in zip(style[i], fit[k], strict=True))
            logs[k] += sum(math.log(share[w][k]) if w in words[i] else math.log(1 - share[w][k]) for w in chosen)
        whole = sum(math.exp(x - max(logs.values())) for x in logs.values())
        assert all(abs(r[f"p_{k}"] - math.exp(logs[k] - max(logs.values())) / whole) < 1e-6 for k in mixing.DOMAINS)
        assert r["converged"] and r["miss"] <= mixing.TOLERANCE


def test_held_out_toxic_rows_are_told_and_thinned(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = mixing.plan(d, l.where(~held)).join(l.where(held).select("doc_id", "toxic"), "doc_id").groupBy("toxic").agg(F.avg("p_toxic").alias("p"), F.avg("rate").alias("rate")).collect()
    found = {r["toxic"]: r for r in rows}
    assert found[1]["p"] > 0.8 and found[0]["p"] < 0.01 and found[1]["rate"] < 0.35 < 0.8 < found[0]["rate"]


def test_targets_that_cannot_be_met_are_reported(spark):
    table = spark.createDataFrame([(i, "word " * (i + 1)) for i in range(20)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = mixing.plan(table, none, {"toxic": 0.8, "low": 0.1, "high": 0.1}).collect()
    assert all(not r["converged"] and abs(r["miss"] - 0.4667) < 0.01 and abs(r["rate"] - 1) < 0.01 for r in rows)


def test_mixing_takes_odd_tables(spark):
    table = spark.createDataFrame([(1, "a b c", 0.5), (1, "a b c", 0.5), (2, None, 0.1), (None, "", 0.1), (3, "w " * 100_000, 0.2)], "doc_id long, text string, rate double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = mixing.plan(table, none).collect()
    assert len(rows) == 5 and all(abs(r["p_high"] - 1 / 3) < 1e-9 for r in rows)
    assert mixing.mixed(table, none).columns == table.columns
    assert mixing.plan(table.where("false"), none).count() == 0 and mixing.mixed(table.where("false"), none).count() == 0


def test_pipeline_equals_its_stages_by_brute_force(spark):
    import corpus_pipeline

    source = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{source}/{t}.parquet") for t in ("documents", "labels"))
    clean = {r["doc_id"] for r in toxicity.classify(docs, labels).where("predicted = 0").collect()}
    step = corpus_pipeline.STAGES[0][1](spark, docs, source)
    assert {r["doc_id"] for r in step.collect()} == clean
    rows = jaccard_join.join(step, words=5, similarity=(80, 100)).collect()
    first = corpus_pipeline.STAGES[1][1](spark, step, source)
    assert {r["doc_id"] for r in first.collect()} == {r["component_id"] for r in rows} and first.columns == docs.columns
    redacted = corpus_pipeline.STAGES[2][1](spark, first, source)
    assert redacted.count() == first.count() and all(not secrets.base_spans(r["text"]) for r in redacted.collect())
    times = {r["doc_id"]: r["copies"] for r in mixing.plan(redacted, labels).collect()}
    mixed = corpus_pipeline.STAGES[3][1](spark, redacted, source)
    seen = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert seen == {k: v for k, v in times.items() if v} and mixed.columns == docs.columns
    assert corpus_pipeline.run(spark, source).count() == sum(times.values())


def test_near_copies_of_the_stage_equal_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    sets = []
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets.append(frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else []))
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(kept) == [r["doc_id"] for i, r in enumerate(rows) if root[i] == i]


def test_every_operator_has_a_query():
    assert sorted({int(n[2:].split("_")[0]) for n in queries.QUERIES}) == list(range(1, 14))
