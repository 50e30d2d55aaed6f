"""Graph operators on small hand-made inputs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kairograph.functions import intervals, semver, text
from kairograph.functions.intervals import OPEN
from kairograph.operators import advisory, incident, publishers, observatory, reach, temporal, typosquat
from kairograph.plans import audit
from kairograph.sources import feeds, lockfiles, sinks

EDGE = "src string, dst string, vf long, vt long"


def graph(spark, *edges):
    return spark.createDataFrame(list(edges), EDGE)


def app(spark):
    return reach.always(spark.createDataFrame([("app",)], "node string"))


def spans(df):
    return sorted((r["node"], r["vf"], r["vt"]) for r in df.collect() if r["node"] != "app")


def live_reach(edges, depth=50, horizon=40):
    """Brute force: which nodes `app` reaches at each instant."""
    out = {}
    for t in range(horizon):
        near, level = {"app"}, {"app"}
        for _ in range(depth):
            level = {b for a, b, vf, vt in edges if a in level and vf <= t < vt} - near
            near |= level
        for n in near - {"app"}:
            out.setdefault(n, set()).add(t)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_coexistence_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    nodes = ["app", *"PQRSTUV"]
    edges = []
    for _ in range(rng.randint(6, 25)):
        vf = rng.randrange(30)
        edges.append((rng.choice(nodes), rng.choice(nodes[1:]), vf, vf + rng.randint(1, 10)))
    got = {}
    for n, vf, vt in spans(reach.coexistence_reach(graph(spark, *edges), app(spark), depth=50)):
        assert not got.get(n, set()) & set(range(vf - 1, vt + 1))  # maximal intervals never touch
        got.setdefault(n, set()).update(range(vf, vt))
    assert got == live_reach(edges)


def test_phantoms_depth_and_truncation(spark):
    edges = graph(spark, ("app", "A", 1, 6), ("A", "B", 8, 12))
    assert [r["node"] for r in reach.phantoms(reach.union_reach(edges, app(spark))[0], reach.coexistence_reach(edges, app(spark))).collect()] == ["B"]
    chain = graph(spark, ("app", "a", 0, OPEN), ("a", "b", 0, OPEN), ("b", "c", 0, OPEN))
    nodes, rounds, more = reach.union_reach(chain, app(spark), depth=2)
    assert nodes.count() == 3 and rounds == 2 and more
    assert reach.union_reach(chain, app(spark), depth=10)[1:] == (4, False)
    assert [f.count() for f in reach.frontiers(chain, app(spark))] == [1, 1, 1, 1]


@pytest.mark.parametrize("t", [3, 11, 17])
def test_reach_at_an_instant(spark, t):
    rng = random.Random(t)
    edges = [(a, b, vf := rng.randrange(20), vf + 9) for a, b in [("app", "P"), ("P", "Q"), ("app", "R"), ("R", "Q"), ("Q", "S"), ("S", "P")]]
    got = reach.reached_at(reach.coexistence_reach(graph(spark, *edges), app(spark), within=intervals.at(t)), t)
    assert {r["node"] for r in got.collect()} - {"app"} == {n for n, when in live_reach(edges).items() if t in when}


def test_cuts_equal_searches_without_the_packages(spark):
    rng = random.Random(6)
    names = ["app", *"KLMNOP"]
    edges = [(rng.choice(names), rng.choice(names[1:]), vf := rng.randrange(20), vf + rng.randint(3, 12)) for _ in range(16)]
    held = {"ines": {"K"}, "jon": {"L", "M"}, "kim": {"N"}, "lou": {"app"}}
    base = set(live_reach(edges)) | {"app"}
    rows = publishers.cuts(graph(spark, *edges), reach.layers(graph(spark, *edges), app(spark)), spark.createDataFrame([(h, p) for h, ps in held.items() for p in ps], "handle string, package string")).collect()
    want = {}
    for h, out in held.items():
        left = set() if "app" in out else set(live_reach([e for e in edges if not {e[0], e[1]} & out])) | {"app"}
        if out & base:
            want[h] = (len(base - left), len(base - left - out))
    assert {r["handle"]: (r["lost"], r["beyond"]) for r in rows} == want


def random_graph(rng, names, count, horizon=20):
    return [(rng.choice(names), rng.choice(names[1:]), vf := rng.randrange(horizon), vf + rng.randint(2, 12)) for _ in range(count)]


@pytest.mark.parametrize("seed,depth", [(1, 2), (2, 3), (3, 12), (4, 3)])
def test_cuts_within_a_depth_equal_searches_without_the_packages(spark, seed, depth):
    """Nodes that are reached by detours, some of them too long, cycles, and packages that nobody reaches."""
    rng = random.Random(seed)
    names = ["app", *"EFGHIJKL"]
    edges = random_graph(rng, names, 24)
    held = {f"h{i}": set(rng.sample(names[1:], rng.randint(1, 3))) for i in range(6)}
    base = set(live_reach(edges, depth)) | {"app"}
    found = reach.layers(graph(spark, *edges), app(spark), depth=depth)
    rows = publishers.cuts(graph(spark, *edges), found, spark.createDataFrame([(h, p) for h, ps in held.items() for p in ps], "handle string, package string"), depth)
    want = {}
    for h, out in held.items():
        left = set(live_reach([e for e in edges if not {e[0], e[1]} & out], depth)) | {"app"}
        if out & base:
            want[h] = (len(out & base), len(base - left), len(base - left - out))
    assert {r["handle"]: (r["controls"], r["lost"], r["beyond"]) for r in rows.collect()} == want


def test_layers_carry_the_least_hops_of_every_instant(spark):
    rng = random.Random(21)
    edges = random_graph(rng, ["app", *"MNOPQ"], 18)
    want = {}
    for t in range(40):
        for depth in range(5, -1, -1):
            want.update({(n, t): depth for n, when in live_reach([e for e in edges if e[1] != "app"], depth).items() if t in when})
    got = {(r["node"], t): r["hop"] for r in reach.layers(graph(spark, *edges), app(spark), depth=5).where("node <> 'app'").collect() for t in range(r["vf"], r["vt"])}
    assert got == want


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_package_chains_equal_all_paths(spark, seed):
    rng = random.Random(seed)
    names = ["app", "r@1", "r@2", "s@1", "s@2", "t@1", "u@1", "w@1"]
    edges = random_graph(rng, names, 20)
    paths, level = [], [(("app",), 0, 99), (("s@1",), 0, 99)]  # two sources
    for _ in range(4):
        level = [((*p, b), max(x, vf), min(y, vt)) for p, x, y in level for a, b, vf, vt in edges if a == p[-1] and max(x, vf) < min(y, vt)]
        paths += level
    want = {}
    for k in ("r", "s", "t", "u", "w", "gone"):
        own = [p for p in paths if p[0][-1].split("@")[0] == k]
        best = min((p[0] for p in own), key=lambda p: (len(p), p[::-1]), default=None)
        first = maximal(instants([(0, x, y) for p, x, y in own if p == best]))[:1]
        want[k] = (best is not None, best and len(best) - 1, best and list(best), *(first[0][1:] if first else (None, None)))
    sources = reach.always(spark.createDataFrame([("app",), ("s@1",)], "node string"))
    wanted = spark.createDataFrame([(k,) for k in want], "package string")
    rows = reach.package_chains(graph(spark, *edges), sources, wanted, lambda c: F.split_part(c, F.lit("@"), F.lit(1)), depth=4)
    assert {r["package"]: (r["found"], r["hops"], r["path"], r["vf"], r["vt"]) for r in rows.collect()} == want


def test_exposure_from_the_target_equals_searches_from_each_lock(spark):
    rng = random.Random(31)
    names = ["app", *"BCDEFG"]
    edges = random_graph(rng, names, 22)
    locks = [(f"proj{i}", rng.choice(names), rng.randrange(25)) for i in range(40)]
    want = set()
    for project, node, t in locks:
        near = level = {node}
        for _ in range(3):
            level = {b for a, b, vf, vt in edges if a in level and vf <= t < vt}
            near = near | level
        if near & {"C", "F"}:
            want.add((project, t))
    target = spark.createDataFrame([("C",), ("F",), ("C",)], "node string")
    got = incident.transitively_exposed(graph(spark, *edges), spark.createDataFrame(locks, "project string, node string, locked_at long"), target, depth=3)
    assert {(r["project"], r["locked_at"]) for r in got.collect()} == want


def test_audit_timeline_equals_an_audit_a_month(spark):
    import datetime as dt

    rng = random.Random(41)
    month = lambda y, m: int(dt.datetime(y, m, 1, tzinfo=dt.timezone.utc).timestamp())
    low, high = month(2019, 11), month(2021, 3)
    some = lambda: (vf := rng.choice([month(2020, rng.randint(1, 12)), rng.randrange(low - 10**7, high)]), vf + rng.randrange(1, 2 * 10**7))
    reached, held = [(rng.choice("abcd"), *some()) for _ in range(14)], [(rng.choice(["ida", "joe"]), *some()) for _ in range(6)]
    frames = [spark.createDataFrame(rows, f"{k} string, vf long, vt long") for rows, k in ((reached, "node"), (held, "handle"))]
    rows = incident.audit_timeline(*frames, spark.range(1).select(F.lit(9).alias("union_publishers")), (2019, 12), (2021, 2)).orderBy("instant").collect()
    want = [(t, *(len({k for k, vf, vt in side if vf <= t < vt}) for side in (reached, held)), 9) for t in (month(2019 + (11 + i) // 12, (11 + i) % 12 + 1) for i in range(15))]
    assert [tuple(r) for r in rows] == want


def test_a_summary_without_sources(spark):
    none = spark.createDataFrame([], "node string, vf long, vt long")
    assert tuple(reach.summary(graph(spark, ("a", "b", 0, 9)), none).first()) == (0, 0, 0, None, 0, False)


def test_proof_paths_need_an_edge_and_one_instant(spark):
    edges = graph(spark, ("app", "A", 1, 6), ("A", "B", 8, 12), ("app", "C", 0, 20), ("C", "B", 9, 10), ("B", "app", 0, OPEN))
    got = {r["node"]: r for r in reach.proof_paths(edges, app(spark), targets=spark.createDataFrame([("B",), ("zzz",), ("app",)], "node string")).collect()}
    assert got["B"]["path"] == ["app", "C", "B"] and (got["B"]["vf"], got["B"]["vt"]) == (9, 10) and not got["zzz"]["found"] and got["app"]["hops"] == 3


def random_spans(rng, count, keys="pqr", horizon=40):
    return [(rng.choice(keys), vf := rng.randrange(horizon), vf + rng.choice([0, 1, 2, 5, 11])) for _ in range(count)]


def instants(rows):
    out = {}
    for k, vf, vt in rows:
        out.setdefault(k, set()).update(range(vf, vt))
    return {k: v for k, v in out.items() if v}


def maximal(when):
    """(key, vf, vt) of runs of instants."""
    return sorted((k, t, next(e for e in range(t, 99) if e not in v)) for k, v in when.items() for t in v if t - 1 not in v)


@pytest.mark.parametrize("seed", range(4))
def test_interval_sets_equal_sets_of_instants(spark, seed):
    rng = random.Random(seed)
    rows, others = random_spans(rng, 14), random_spans(rng, 9)
    a, b = (spark.createDataFrame(r, "node string, vf long, vt long") for r in (rows, others))
    mine, theirs = instants(rows), instants(others)
    assert spans(intervals.coalesce(a)) == maximal(mine)
    assert spans(intervals.minus(a, b)) == maximal({k: v - theirs.get(k, set()) for k, v in mine.items()})
    counts = {(r["node"], t): r["n"] for r in intervals.depths(a).collect() for t in range(r["vf"], r["vt"])}
    assert counts == {(k, t): n for k in "pqr" for t in range(60) if (n := sum(k == x and vf <= t < vt for x, vf, vt in rows))}
    tests = [(k, vf, vf + rng.randrange(6)) for k in mine for vf in range(0, 40, 3)]
    asked = spark.createDataFrame(tests, "node string, a long, b long").join(intervals.as_set(a), "node").select("node", "a", "b", intervals.covers(F.col("spans"), F.col("a"), F.col("b")).alias("c"))
    assert {(r["node"], r["a"], r["b"]): r["c"] for r in asked.collect()} == {(k, x, y): set(range(x, y)) <= mine[k] for k, x, y in tests}


@pytest.mark.parametrize("seed", range(3))
def test_signals_equal_plain_counts(spark, seed):
    rng = random.Random(seed)
    people, packages = ["una", "viv", "wes", "xan"], ["k1", "k2", "k3", "k4", "k5"]
    reached = [(p, vf := rng.randrange(20), vf + rng.randint(1, 15)) for p in packages[:4] for _ in range(rng.randint(1, 2))]
    maintains = [(h, p, vf := rng.randrange(25), vf + rng.randint(1, 12)) for h in people for p in packages if rng.random() < 0.5]
    sampled = [(rng.choice(packages), rng.randrange(1, 99), rng.choice([*people, None]), rng.choice([True, False, None]), rng.choice([True, False, None])) for _ in range(25)]
    held = publishers.roster(spark.createDataFrame(reached, "package string, vf long, vt long"), spark.createDataFrame(maintains, "handle string, package string, vf long, vt long"))
    looked = "package string, published_at long, published_by string, has_provenance boolean, has_install_script boolean"
    rows = publishers.signals(held, publishers.holders_per_package(spark.createDataFrame(reached, "package string, vf long, vt long"), held), spark.createDataFrame(sampled, looked)).collect()
    through = {h: {p for who, p, vf, vt in maintains if who == h and any(p == q and max(vf, a) < min(vt, b) for q, a, b in reached)} for h in people}
    want = {}
    for h, own in through.items():
        seen = [s for s in sampled if s[0] in own]
        known = [s for s in seen if s[3] is not None]
        if own:
            want[h] = (
                sum(sum(p in o for o in through.values()) == 1 for p in own), len(own), sum(not s[3] for s in known), len(known), sum(bool(s[4]) for s in known),
                max((s[1] for s in seen if s[2] == h), default=0), max((s[1] for s in seen), default=0),
            )
    assert {r["handle"]: (r["solo_count"], r["solo_of"], r["unproven_count"], r["looked_of"], r["install_count"], r["last_publish"], r["last_release"]) for r in rows} == want


@pytest.mark.parametrize(
    "known,want",
    [
        ({"solo_count": 4, "solo_of": 4}, 1.0),
        ({"solo_count": 0, "solo_of": 4, "unproven_count": 0, "looked_of": 2, "install_count": 0}, 0.4 / 0.85),
        ({"solo_count": 4, "solo_of": 4, "last_publish": 1000}, (0.4 + 0.2 + 0.15 * 0.2) / 0.75),
    ],
)
def test_risk_scales_known_terms(spark, known, want):
    columns = ["solo_count", "solo_of", "unproven_count", "looked_of", "install_count", "last_publish"]
    row = spark.createDataFrame([("h", *(known.get(c, 0) for c in columns))], ["handle", *columns])
    assert publishers.risk(row, 4, 1000 + publishers.YEAR).first()["risk"] == pytest.approx(want)


def test_versions_follow_the_grammar(spark):
    """Versions put together from parts parse; with a part dropped, doubled, padded or spoilt they don't."""
    rng = random.Random(12)
    number = lambda: str(rng.choice([0, rng.randint(1, 9), rng.randint(10, 99_999)]))
    word = lambda: rng.choice(["rc", "b-1", "x2y", "0a", number()])
    good, bad = [], []
    for _ in range(25):
        core = [number() for _ in range(3)]
        pre = [word() for _ in range(rng.randint(0, 3))]
        build = [rng.choice(["007", "a", "z-"]) for _ in range(rng.randint(0, 2))]
        spell = lambda c, p=pre, b=build: ".".join(c) + ("-" + ".".join(p) if p else "") + ("+" + ".".join(b) if b else "")
        good.append(rng.choice(["", "v", "=", "  "]) + spell(core) + rng.choice(["", " "]))
        k = rng.randrange(3)
        bad += [spell(core[:k] + core[k + 1 :]), spell([*core[: k + 1], number(), *core[k + 1 :]], []), spell([*core[:k], "0" + core[k], *core[k + 1 :]]), spell([*core[:k], rng.choice("qxy*"), *core[k + 1 :]])]
        bad += [spell(core, ["", *pre]) if pre else ".".join(core) + "-", spell([*core[:k], str(2**64 + rng.randint(0, 9)), *core[k + 1 :]])]
    rows = spark.createDataFrame([(v,) for v in bad + good], "v string").select("v", semver.version_key(F.col("v")).alias("k")).collect()
    assert [r["v"] for r in rows if r["k"] is None] == bad


@pytest.mark.parametrize("written,parsed", [("git+x", None), ("1.2.3.4", None), ("latest", [[(">=", 0, 0, 0, "")]]), ("^1.0.0 || ~2", [[(">=", 1, 0, 0, ""), ("<", 2, 0, 0, "0")], [(">=", 2, 0, 0, ""), ("<", 3, 0, 0, "0")]]), ("< 1.2", [[("<", 1, 2, 0, "")]])])
def test_range_texts(written, parsed):
    assert semver.parse_range_text(written) == parsed


@pytest.mark.parametrize("seed", range(3))
def test_resolution_windows_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    releases = [(f"{rng.randint(1, 2)}.{rng.randint(0, 4)}.{rng.randint(0, 4)}", rng.choice([0, *range(10, 60, 5)])) for _ in range(14)]
    releases = list({v: (v, t) for v, t in releases}.values())
    for declared in (0, 32):
        key = lambda v: tuple(map(int, v.split(".")))
        want = []
        for t in range(10, 80):  # the best release of major 1 that is out at each instant
            out = [v for v, at in releases if 0 < at <= t and key(v)[0] == 1]
            if out and t >= declared:
                best = max(out, key=key)
                if want and want[-1][0] == best:
                    want[-1][2] = t + 1
                else:
                    want.append([best, t, t + 1])
        if want:
            want[-1][2] = OPEN
        r = spark.createDataFrame([("p", v, t) for v, t in releases], "package string, version string, published_at long")
        d = spark.createDataFrame([("d", "p", "^1.0.0", declared), ("x", "p", "file:../y", 0), ("n", "q", "*", 0)], "declaration string, package string, range string, declared_at long")
        w = temporal.resolution_windows(d, r)
        assert sorted(([x["version"], x["vf"], x["vt"]] for x in w.where("declaration = 'd'").collect()), key=lambda x: x[1]) == want
        counts = {x["status"]: x["declarations"] for x in temporal.resolution_counts(d, r, w).collect()}
        assert counts == {"no timeline": 1, "unparseable": 1, ("resolved" if want else "unsatisfied"): 1}


def test_spells_leave_and_return(spark):
    seen = spark.createDataFrame([("p", 3, "a"), ("p", 1, "a"), ("p", 1, "b"), ("p", 2, "b"), ("p", 3, "b")], "package string, ob long, handle string")
    got = sorted((r["handle"], r["vf"], r["vt"], r["observed"]) for r in temporal.spells(seen).collect())
    assert got == [("a", 1, 2, 1), ("a", 3, OPEN, 1), ("b", 1, OPEN, 3)]


EVENTS = [
    ([{"introduced": "0"}, {"fixed": "1.5.0"}], ["1.0.0", "1.4.9"]), ([{"introduced": "1.0.0"}, {"last_affected": "1.5.0"}], ["1.0.0", "1.4.9", "1.5.0"]),
    ([{"introduced": "1.4.0"}, {"fixed": "1.5.0"}, {"introduced": "2.0.0"}], ["1.4.9", "2.0.0", "2.1.0"]), ([{"fixed": "9.9.9"}], []), ([], []),
]


@pytest.mark.parametrize("events,want", EVENTS)
def test_affected_versions(spark, events, want):
    e = [(x.get("introduced"), x.get("fixed"), x.get("last_affected")) for x in events]
    kind = "osv_id string, affected array<struct<package:struct<ecosystem:string,name:string>,ranges:array<struct<type:string,events:" + advisory.EVENTS + ">>,versions:array<string>>>"
    record = spark.createDataFrame([("A", [(("npm", "p"), [("GIT", [("0", None, None)]), ("SEMVER", e)], ["2.1.0"]), (("pypi", "p"), [], ["1.0.0"])]), ("B", [(("npm", "p"), [], ["2.1.0", "7.7.7"])])], kind)
    releases = spark.createDataFrame([("p", v) for v in ("1.0.0", "1.4.9", "1.5.0", "2.0.0", "2.1.0", "junk")], "package string, version string")
    got = advisory.affected_versions(record, releases).collect()
    assert sorted(r["version"] for r in got if r["osv_id"] == "A") == want and [r["version"] for r in got if r["osv_id"] == "B"] == ["2.1.0"]


def test_reach_index_starts_cold_in_each_epoch(spark):
    edges = spark.createDataFrame([(1, "X", "Y"), (1, "Y", "Z"), (2, "X", "Y"), (3, "A", "B"), (3, "A", "C"), (3, "B", "D"), (3, "C", "D"), (3, "D", "E"), (3, "E", "A")], "epoch long, src string, dst string")
    want = {(1, "X"): 1, (1, "Y"): 2, (1, "Z"): 3, (2, "X"): 1, (2, "Y"): 2} | {(3, n): 5 for n in "ABCDE"}
    assert {(r["epoch"], r["node"]): r["kri"] for r in observatory.kri_exact(observatory.members(edges)).collect()} == want
    assert {(r["epoch"], r["node"]): r["kri"] for r in observatory.kri_estimated(observatory.kri_sketches(edges)).collect()} == want  # small sets are exact


def test_look_alikes(spark):
    names = spark.createDataFrame([("cross-env", 40), ("crossenv", 8000), ("lodash", 1), ("1odash", None), ("react", 2)], "name string, rank long")
    got = {(r["popular"], r["lookalike"]): (r["distance"], r["popularity_ratio"]) for r in typosquat.candidates(names, 2).collect()}
    assert set(got) == {("cross-env", "crossenv"), ("lodash", "1odash")} and got["cross-env", "crossenv"] == (0, 200.0) and got["lodash", "1odash"][1] > 1000


def test_locked_while_live(spark):
    r = spark.createDataFrame([("dep@1", "bad@1", 100, 200)], EDGE)
    locks = spark.createDataFrame([("in", "dep@1", 150), ("out", "dep@1", 50), ("late", "dep@1", 200)], "project string, node string, locked_at long")
    assert [x["project"] for x in incident.resolved_while_live(r, locks).collect()] == ["in"]
    exposed = incident.transitively_exposed(r, locks, spark.createDataFrame([("bad@1",)], "node string"))
    assert [x["project"] for x in exposed.collect()] == ["in"]


def test_audit_report(spark):
    edges = graph(spark, ("app", "A", 0, OPEN), ("A", "B", 0, OPEN))
    maintains = spark.createDataFrame([("alice", "A", 0, OPEN), ("bob", "B", 5, OPEN)], "handle string, package string, vf long, vt long")
    sampled = spark.createDataFrame([], "package string, published_at long, published_by string, has_provenance boolean, has_install_script boolean")
    report = audit.audit(edges, app(spark), maintains, sampled, lambda n: n, now=100)
    assert [r["handle"] for r in report["risk"].collect()] == ["alice", "bob"] and report["union_publishers"].first()[0] == 2
    dependents = audit.who(edges, spark.createDataFrame([("B", 5, 9)], "package string, vf long, vt long"), spark.createDataFrame([("B", "B", 7)], "node string, package string, published_at long"))
    assert spans(dependents) == [("A", 7, 9)]


def test_upserts_and_missing_ends(spark):
    old, new = (spark.createDataFrame(r, "urn string, n int") for r in ([("a", 1), ("b", 2)], [("b", 3), ("c", 4)]))
    assert sorted(map(tuple, sinks.upserted(old, new, ["urn"], "n").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    kept, lost = sinks.with_ends(spark.createDataFrame([("a", "b"), ("a", "z"), ("z", "a")], "src string, dst string"), old, old)
    assert kept.count() == 1 and lost.count() == 2


def test_lock_files_are_recorded(spark, tmp_path):
    (tmp_path / "package-lock.json").write_text('{"name":"app","packages":{"":{"dependencies":{"x":"1"}},"node_modules/x":{"version":"1.0.0"}}}')
    files = lockfiles.read(spark, f"file://{tmp_path}")
    rows, locks = sinks.recorded(files, lockfiles.parse(files), lockfiles.projects(files))
    assert rows.first()["urn"] == "prj:local/app" and len(rows.first()["lockfile_sha"]) == 64 and locks.first()["dst"] == "pkg:npm/x@1.0.0"
    with pytest.raises(Exception, match="unrecognised lockfile"):
        lockfiles.parse(spark.createDataFrame([("x.txt", "")], "path string, content string")).collect()


def test_feeds(spark, tmp_path):
    (tmp_path / "names.txt").write_text("b\n# c\n\na\nb\n")
    assert [tuple(r) for r in feeds.names_file(spark, f"file://{tmp_path}/names.txt").orderBy("rank").collect()] == [("b", 1), ("a", 2)]
    bad = spark.createDataFrame([("p", "1.0.0", '{"nodes":[],"edges":[{"fromNode":0,"toNode":3}]}')], "package string, version string, content string")
    with pytest.raises(Exception, match="not there"):
        feeds.dependencies(bad).collect()
    import zipfile

    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("A.json", '{"id":"A","published":"2020-01-01T00:00:00Z","severity":[{"type":"CVSS_V3","score":"CVSS:3.1/AV:N"},{"type":"N","score":"7.5"}],"affected":[]}')
    row = advisory.severity(feeds.advisories(feeds.zipped(spark, f"file://{tmp_path}/all.zip").select("content"))).first()
    assert (row["osv_id"], row["published_at"], row["label"], row["cvss"]) == ("A", 1577836800, "CVSS_V3", 7.5)


def test_display_functions(spark):
    row = spark.range(1).select(
        text.day(F.lit(0)).alias("a"), text.day(F.lit(86400)).alias("b"), text.day(F.lit(OPEN)).alias("c"), text.shortened(F.lit("abcdef"), 3).alias("d"), text.shortened(F.lit(""), 3).alias("e"),
        text.first_names(F.array(*map(F.lit, "xyz")), 2).alias("f"), text.package_of(F.lit("pkg:npm/@a/b@1.0.0")).alias("g"), text.severity_rank(F.lit("moderate")).alias("h"), text.package_of(F.lit("@a")).alias("i"),
    ).first()
    assert tuple(row) == ("-", "1970-01-02", "now", "abc...", "-", "x, y and 1 more", "pkg:npm/@a/b", 2, "")


def test_incident_is_about_one_release(spark):
    releases = spark.createDataFrame([("bad", "1.0.0", 10), ("bad", "1.1.0", 20), ("bad", "1.2.0", 30)], "package string, version string, published_at long")
    affects = spark.createDataFrame([("A", "bad", "1.1.0"), ("B", "bad", "1.1.0"), ("C", "bad", "1.2.0"), ("D", "other", "1.1.0")], "osv_id string, package string, version string")
    declared = spark.createDataFrame([("bad", "1.0.0", "x", "^1"), ("bad", "1.1.0", "x", "^1"), ("bad", "1.1.0", "miner", "*")], "package string, version string, name string, range string")
    resolutions = graph(spark, ("dep@1", "pkg:npm/bad@1.1.0", 20, 30), ("dep@1", "pkg:npm/bad@1.2.0", 30, 99), ("far@1", "dep@1", 0, 99), ("dep@1", "pkg:npm/fine@1.0.0", 0, 99))
    locks = spark.createDataFrame([("hit", "dep@1", 25), ("later", "dep@1", 35), ("deep", "far@1", 25)], "project string, node string, locked_at long")
    maintains = spark.createDataFrame([("ann", "bad", 0, 99), ("ann", "also", 0, 99)], "handle string, package string, vf long, vt long")
    pairs = spark.createDataFrame([("bad", "bed", 1, 3.0)], "popular string, lookalike string, distance long, popularity_ratio double")
    severity = spark.createDataFrame([("A", "LOW"), ("B", "CRITICAL"), ("C", "HIGH")], "osv_id string, severity string")
    found = audit.incident_report("bad", releases, affects, declared, resolutions, locks, maintains, pairs, 25, advisories=severity)
    assert [r["version"] for r in found["first_affected"].collect()] == ["1.1.0"]
    assert [r["osv_id"] for r in found["advisories"].collect()] == ["B", "A"]
    assert [(r["name"], r["change"]) for r in found["dependency_changes"].collect()] == [("miner", "added")]
    assert [r["project"] for r in found["resolved_while_live"].collect()] == ["hit"]
    assert sorted(r["project"] for r in found["transitively_exposed"].collect()) == ["deep", "hit"]
    assert [r["other"] for r in found["shared_maintainers"].collect()] == ["also"] and found["lookalikes"].count() == 1
    other = audit.incident_report("bad", releases, affects, declared, resolutions, locks, maintains, pairs, 25, version="1.2.0")
    assert [r["project"] for r in other["resolved_while_live"].collect()] == ["later"]


def test_long_chains_are_not_cut_off(spark):
    chain = spark.createDataFrame([(1, f"n{i:03}", f"n{i + 1:03}") for i in range(40)], "epoch long, src string, dst string")
    got = {r["node"]: r["kri"] for r in observatory.kri_estimated(observatory.kri_sketches(chain)).collect()}
    assert all(abs(got[f"n{i:03}"] - (i + 1)) <= 0.07 * (i + 1) for i in range(41))


def test_ci_check_and_known_pins(spark):
    roster = lambda *names: {"roster": spark.createDataFrame([(n,) for n in names], "handle string")}
    affects = spark.createDataFrame([("A", "p", "1.0.0"), ("B", "p", "1.0.0"), ("C", "p", "2.0.0")], "osv_id string, package string, version string")
    found = audit.ci_check(roster("ann", "bob"), roster("bob"), spark.createDataFrame([("p", "1.0.0")], "package string, version string"), affects)
    assert [r["handle"] for r in found["new_publishers"].collect()] == ["ann"] and found["advisories"].first()["advisories"] == ["A", "B"]
    versions = spark.createDataFrame([("u1", "p", "1.0.0", 5), ("u2", "q", "1.0.0", 0)], "urn string, name string, version string, published_at long")
    pins = spark.createDataFrame([("p", "1.0.0"), ("q", "1.0.0"), ("z", "1.0.0")], "name string, version string")
    assert sorted((r["node"], r["vf"], r["vt"]) for r in audit.known_pins(pins, versions).collect()) == [("u1", 5, OPEN), ("u2", 0, OPEN)]


def test_search_events(spark):
    import json

    from kairograph.streaming import frontiers

    frames = list(frontiers.events(graph(spark, ("app", "K", 1, 5), ("K", "L", 2, 9)), app(spark)))
    rows = [json.loads(f.split("data: ")[1]) for f in frames]
    assert [(r["layer"], r["node"]) for r in rows[:-1]] == [(0, "app"), (1, "K"), (2, "L")] and rows[-1] == {"rows": 3}


def test_sampled_closures_are_those_of_the_whole(spark):
    rng = random.Random(51)
    edges = spark.createDataFrame([(rng.randint(1, 2), f"n{rng.randrange(20)}", f"n{rng.randrange(20)}") for _ in range(60)], "epoch long, src string, dst string")
    whole = {(r["epoch"], r["node"], r["member"]) for r in observatory.members(edges).collect()}
    nodes = edges.select("epoch", F.col("src").alias("node")).union(edges.select("epoch", "dst"))
    sample = {(r["epoch"], r["node"]) for r in observatory.spread_sample(nodes, 5).collect()}
    assert len(sample) == 10
    got = [(r["epoch"], r["node"], r["member"]) for r in observatory.sampled_members(edges, observatory.spread_sample(nodes, 5)).collect()]
    assert len(got) == len(set(got)) and set(got) == {m for m in whole if m[:2] in sample}
    rows = observatory.sampled_validation(edges, observatory.kri_estimated(observatory.kri_sketches(edges)), 5).collect()
    assert len(rows) == 10 and all(r["within"] and r["error"] == 0 for r in rows)  # small sets are exact


def test_resolution_windows_follow_precedence_whatever_the_minor(spark):
    """A minor of many digits never outweighs the major."""
    releases = spark.createDataFrame([("p", "1.47999.13", 10), ("p", "2.7.22", 20), ("p", "1.48000.0", 30)], "package string, version string, published_at long")
    declared = spark.createDataFrame([("d", "p", "<=2.10.5", 0)], "declaration string, package string, range string, declared_at long")
    assert sorted(map(tuple, temporal.resolution_windows(declared, releases).collect())) == [("d", "1.47999.13", 10, 20), ("d", "2.7.22", 20, OPEN)]
