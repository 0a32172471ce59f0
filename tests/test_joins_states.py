"""Pattern and prefix joins, levels, changes and state machines against plain versions."""

import datetime
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from granary.operators import access, evaluation, graph, incremental, paths, patterns, prefixes, retention, routing, structure
from granary.sources import html
from granary.streaming import segments, tiers, vigil


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


# --- patterns and prefixes


@pytest.mark.parametrize("block", [4 << 20, 12])
def test_patterns(spark, monkeypatch, block):
    monkeypatch.setattr(patterns, "BLOCK_BYTES", block)
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcАб") for _ in range(n))
    texts = [(k, text(rng.randint(0, 30))) for k in range(200)] + [(200, None), (201, "")]
    own = sorted({text(rng.randint(1, 4)) for _ in range(40)} | {"", "zzz"})
    df, ps = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(p,) for p in [*own, own[3], None]], "pattern string")
    for fold in (False, True):
        low = str.lower if fold else str
        want = sorted({(k, low(p)) for k, t in texts if t is not None for p in own if low(p) in low(t)}, key=repr)
        found = patterns.held(df, "text", ps, any_case=fold)
        assert rows(found, "id", "pattern") == want
    counts = dict(rows(patterns.counted(ps, patterns.held(df, "text", ps)), "pattern", "n"))
    assert counts == {p: sum(t is not None and p in t for _, t in texts) for p in own} and counts["zzz"] == 0
    assert patterns.held(df, "text", ps.limit(0)).collect() == []


def test_no_nested_loop(spark):
    from granary.queries import QUERIES

    for name in ("jn_14", "jn_15", "ev_05", "flt_15", "src_25"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_audit(spark):
    s = "line long, question string, expect_files array<string>, expect_text array<string>, reject_files array<string>, reject_text array<string>"
    data = [(1, "A?", ["Doc"], ["x"], [], []), (2, " a? ", ["doc_1.", "DOC_2.", "none"], [], [], []), (3, "b", [], None, None, None), (4, "A?", None, [], [], ["y"])]
    files = spark.createDataFrame([(f"x/Doc_{k}.txt",) for k in range(30)] + [(None,)], "rel_path string")
    out = rows(evaluation.audit(spark.createDataFrame(data, s), files))
    assert out == sorted(
        [(2, "duplicate", None, 1), (4, "duplicate", None, 2), (3, "no_expects", None, 0), (4, "no_expects", None, 0), (1, "broad", "Doc", 30), (2, "dead", "none", 0), (None, "no_texts", None, 2)], key=repr
    )


def test_longest_prefix(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab/é") for _ in range(rng.randint(0, n)))
    for with_empty in (True, False):
        own = sorted({word(4) for _ in range(30)} - {""}) + [""] * with_empty
        keys = [(k, word(9)) for k in range(400)] + [(400, None), (401, own[0]), (402, "\U0010ffff")] + [(500 + k, "hot/a") for k in range(50)]
        df, table = spark.createDataFrame(keys, "id long, text string"), spark.createDataFrame([(p,) for p in [*own, own[0], None]], "prefix string")
        want = sorted(((k, max((p for p in own if t is not None and t.startswith(p)), key=len, default=None)) for k, t in keys), key=repr)
        assert rows(prefixes.longest(df, "text", table), "id", "prefix") == want
    none = prefixes.longest(df, "text", table.limit(0))
    assert none.where("prefix IS NOT NULL").isEmpty() and none.count() == len(keys)


def test_networks(spark):
    rng = random.Random(3)
    nets = [ipaddress.ip_network(x) for x in html.BLOCKED]
    given = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(150)] + [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(50)]
    for n in nets:
        first, last = int(n[0]), int(n[-1])
        given += [str(ipaddress.ip_address(x) if n.version == 4 else ipaddress.IPv6Address(x)) for x in (first, last, first - 1 if first else first, last + 1) if x >= 0]
    given += ["::", "1::", "::ffff:0:1", "2001:db8::1", "FE80::1", "fe80:0:0:0:0:0:0:1"]
    wrong = ["", "host", "1.2.3", "1.2.3.256", "01.2.3.4", "1:2", "::1::", ":::", "12345::", None, "1.2.3.4/8", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::8:9"]
    df = spark.createDataFrame([(x,) for x in given + wrong], "ip string")
    out = {r["ip"]: r["blocked"] for r in html.blocked(df, "ip", spark.createDataFrame([(x,) for x in html.BLOCKED], "network string")).collect()}
    for x in given:
        address = ipaddress.ip_address(x)
        assert out[x] == any(address in n for n in nets if n.version == address.version), x
    assert all(out[x] is None for x in wrong)


def test_policy(spark):
    policy = spark.createDataFrame([(*x[:4], list(x[4])) for x in access.POLICY], "role string, method string, prefix string, exact boolean, denied array<string>")
    asked = [
        ("admin", "POST", "/api/backup/restore", "restore", True), ("operator", "POST", "/api/job", "reindex", True), ("operator", "POST", "/api/job", "restore", False),
        ("operator", "POST", "/api/jobs/3", None, True), ("viewer", "POST", "/api/job", "reindex", False), ("viewer", "GET", "/x", "restore", True), ("viewer", "POST", "/api/password", None, True),
        ("viewer", "POST", "/api/password2", None, False), ("operator", "DELETE", "/api/eval/run", None, True), ("operator", "POST", "/api/eval", None, False), (None, "POST", "/", None, False), ("viewer", "POST", None, None, False),
    ]
    df = spark.createDataFrame([(k, *x[:4]) for k, x in enumerate(asked)], "id long, role string, method string, path string, kind string")
    assert rows(access.permitted(df, policy), "id", "allowed") == sorted(((k, x[4]) for k, x in enumerate(asked)), key=repr)


def test_path_meta(spark):
    types = spark.createDataFrame(list(paths.FOLDER_TYPES.items()), "name string, doc_type string")
    cases = {
        "a.txt": (None, None, None, False), "R/a.csv": ("R", None, "ТАБЛИЦА", False), "R/B/a.pdf": ("R", "B", None, False), "R/B/4ПАСПОРТ/a.pdf": ("R", "B", "ПАСПОРТ", False),
        "R/B/SPL_Радиаторы (Зайцев)/1КАТАЛОГ/x.pdf": ("R", "B / SPL Радиаторы", "КАТАЛОГ", False), "R/SPL X/SPL_X/a.pdf": ("R", "SPL X", None, False),
        "R/B/4ПАСПОРТ/Архив/a.pdf": ("R", "B", "АРХИВ", True), "R/B/13НОВЫЕ_ЛИСТЫ/a.xls": ("R", "B", "НОВЫЕ ЛИСТЫ", False), "R/B/13ПРАЙС_ЛИСТ/a": ("R", "B", "ПРАЙС-ЛИСТ", False),
        "R/Old B/c/a.b/file": ("R", "Old B", None, True),
    }
    df = spark.createDataFrame([(x,) for x in cases] + [(None,)], "p string")
    out = {r["p"]: (r["section"], r["brand"], r["doc_type"], r["is_archive"]) for r in paths.path_meta(df, "p", types).collect()}
    assert {k: out[k] for k in cases} == cases and out[None][0] is None


# --- graph levels, structure, twins, routes


def test_levels(spark):
    rng = random.Random(4)
    nodes = [(k, rng.choice("xy"), rng.choice(["p", "q", None]), rng.choice(["c", "d"]), rng.randint(0, 9)) for k in range(40)]
    edges = [(rng.randrange(40), rng.randrange(40), rng.random()) for _ in range(120)]
    df = spark.createDataFrame(nodes, "id long, section string, brand string, category string, chars long")
    keys = {n[0]: {"section": n[1], "brand": f"{n[1]} / {n[2] or ''}", "category": n[3], "doc": str(n[0])} for n in nodes}
    sums, agg = {}, {}
    for n in nodes:
        for level, key in keys[n[0]].items():
            a, b = sums.get((level, key), (0, 0))
            sums[level, key] = a + 1, b + n[4]
    for a, b, w in edges:
        for level in graph.LEVELS:
            x, y = sorted((keys[a][level], keys[b][level]))
            if x != y:
                n, most = agg.get((level, x, y), (0, 0))
                agg[level, x, y] = n + 1, max(most, w)
    assert rows(graph.level_nodes(df, ["chars"])) == sorted(((*k, *v) for k, v in sums.items()), key=repr)
    assert rows(graph.level_edges(spark.createDataFrame(edges, "a long, b long, w double"), df)) == sorted(((*k, *v) for k, v in agg.items()), key=repr)


def test_structure(spark):
    table = lambda xs: structure.folder_stats(spark.createDataFrame([(x,) for x in xs], "path string"))
    before = [f"r/b/one/f{k}" for k in range(3)] + [f"r/b/two/f{k}" for k in range(3)] + ["r/b/gone/x", "top.txt"] + [f"r/c/grow/f{k}" for k in range(2)] + [f"r/c/less/f{k}" for k in range(9)]
    after = [f"r/b/uno/f{k}" for k in range(3)] + [f"r/b/due/f{k}" for k in range(3)] + ["r/b/КАТАЛОГ/x", "r/b/КАТАЛОГ/y"] + [f"r/c/grow/f{k}" for k in range(7)] + [f"r/c/less/f{k}" for k in range(4)]
    assert ("r/b", 2, 0, 3) in rows(table(before)) and ("r/b/one", 3, 3, 0) in rows(table(before))
    known = spark.createDataFrame([("КАТАЛОГ",)], "name string")
    assert rows(structure.structure_events(table(before), table(after), known)) == sorted(
        [("renamed", "r/b/due", "r/b/one", 0), ("renamed", "r/b/uno", "r/b/two", 0), ("added", "r/b/КАТАЛОГ", None, 2), ("removed", "r/b/gone", None, -1), ("grew", "r/c/grow", None, 5), ("shrank", "r/c/less", None, -5)], key=repr
    )
    strange = structure.structure_events(table(["r/b/one/f"]), table(["r/b/one/f", "r/b/odd/f", "r/b/odd/g"]), known)
    assert rows(strange, "kind", "folder") == [("added", "r/b/odd"), ("unknown_category", "r/b/odd")]


def test_twins_and_neighbours(spark):
    df = spark.createDataFrame([(1, "напор 55/75 и 0,5-40?", ["a"], ["x"]), (2, None, None, None)], "line long, question string, expect_files array<string>, expect_text array<string>")
    out = {r["line"]: r for r in evaluation.twins(df).collect()}
    assert out[1]["question"] == "напор «МОДЕЛЬ-СОСЕД» и «МОДЕЛЬ-СОСЕД»?" and out[1]["reject_text"] == ["x", "55/75", "0,5-40"] and out[1]["reject_files"] == ["a"] and out[1]["expect_files"] == []
    assert out[2]["question"] == "" and out[2]["reject_text"] == []
    rng = random.Random(5)
    own = sorted({"".join(rng.choice("12/") for _ in range(rng.randint(0, 5))) for _ in range(120)})

    def edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    got = rows(evaluation.neighbours(spark.createDataFrame([(x,) for x in own], "signature string")))
    assert got == sorted([(a, b) for a in own for b in own if edit(a, b)], key=repr)


def test_routes(spark):
    q = spark.createDataFrame([(1, "curated"), (2, "цена арт. ab.1"), (3, "Сколько стоит 500095"), (4, "цена 2024"), (5, "x"), (6, "y"), (7, "код: zz9")], "id long, question string")
    goods = spark.createDataFrame([(10, "AB.1", "f2"), (11, "500095.F", "f1"), (12, "500095.G", "f1"), (13, "2024", "f3"), (14, "500095", "f9")], "product long, article string, file string")
    found = routing.product_matches(q, goods)
    assert rows(found) == [(2, 10, "f2", 1), (3, 14, "f9", 1)]
    found = routing.product_matches(q, goods.where("product <> 14"))
    assert rows(found) == [(2, 10, "f2", 1), (3, 11, "f1", 1), (3, 12, "f1", 2)]
    hits = spark.createDataFrame([(1, 7, 0.9, 1), (3, 8, 0.5, 1), (3, 9, 0.4, 2), (5, 7, 0.01, 1), (4, 7, 0.3, 1), (2, 5, 0.01, 1)], "id long, doc_id long, score double, rank int")
    routes = routing.routed(q, spark.createDataFrame([(1,)], "id long"), found, hits)
    assert rows(routes, "id", "route", "stage") == [
        (1, "golden", "answered"), (2, "price", "answered"), (3, "price", "answered"), (4, "documents", "answered"), (5, "documents", "low_confidence"), (6, "none", "nothing_found"), (7, "none", "nothing_found"),
    ]
    assert rows(routing.sources(routes, found, hits)) == [(2, 1, "price", "f2"), (3, 1, "price", "f1"), (3, 2, "document", "8"), (3, 3, "document", "9"), (4, 1, "document", "7")]


# --- versions, retention, tiers


def plain_index(index, snapshot):
    """{path: (hash, status, twin, state)} after a snapshot {path: hash}."""
    keepers = {}
    for p in sorted(snapshot, key=lambda p: (not (p in index and index[p][:2] == (snapshot[p], "ok")), p)):
        keepers.setdefault(snapshot[p], p)
    out = {}
    for p in index.keys() | snapshot.keys():
        old = index.get(p)
        if p not in snapshot:
            out[p] = (None, "deleted", None, "deleted")
            continue
        h = snapshot[p]
        same = old is not None and old[1] != "deleted" and old[0] == h
        if keepers[h] != p:
            out[p] = (h, "duplicate", keepers[h], "duplicate")
        else:
            state = "unchanged" if same and old[1] == "ok" else "promoted" if same else "new" if old is None or old[1] == "deleted" else "changed"
            out[p] = (h, "ok", None, state)
    return out


def test_index_follows_snapshots(spark):
    rng = random.Random(6)
    index, plain, seen = incremental.VersionedIndex(spark), {}, set()
    for _ in range(5):
        snapshot = {f"p{k:02d}": rng.choice(["h1", "h2", f"own{k}", f"own{k}"]) for k in range(40) if rng.random() < 0.8}
        version = index.take(spark.createDataFrame(list(snapshot.items()), "path string, hash string"))
        plain = plain_index(plain, snapshot)
        seen |= {x[3] for x in plain.values()}
        assert rows(index.at(version)) == sorted(((p, *x) for p, x in plain.items()), key=repr)
    assert seen == {"unchanged", "new", "changed", "duplicate", "promoted", "deleted"}
    assert index.changes(4).where("state = 'unchanged'").isEmpty() and index.changes(5).isEmpty()


def test_retention(spark):
    day = lambda n: datetime.datetime(2024, 6, 1) - datetime.timedelta(days=n)
    store = retention.Store(spark)
    store.save("queries", spark.createDataFrame([(1, 7, "n", day(500)), (2, 8, "m", day(500)), (3, 7, "n", day(1)), (4, 9, "k", day(100)), (5, 7, "n", None)], "id long, user_id long, user_name string, created_at timestamp_ntz"))
    store.save("feedback", spark.createDataFrame([(1, 1, 8, day(3)), (2, 3, 8, day(3)), (3, 4, 7, day(2)), (4, 4, 8, day(2))], "id long, query_id long, user_id long, created_at timestamp_ntz"))
    store.save("traces", spark.createDataFrame([(1, 7, day(91)), (2, 8, day(91)), (3, 7, day(1))], "id long, user_id long, ts timestamp_ntz"))
    store.save("users", spark.createDataFrame([(7,), (8,), (9,)], "user_id long"))
    as_of = F.lit(day(0)).cast("timestamp_ntz")
    ids = lambda name: [r[0] for r in rows(store.table(name), "user_id" if name == "users" else "id")]
    dry = store.clean(as_of, dry=True)
    assert dry == {"queries": 2, "feedback": 1, "traces": 2} and ids("queries") == [1, 2, 3, 4, 5] and store.clean(as_of, 0, 0) == {"queries": 0, "feedback": 0, "traces": 0}
    assert store.clean(as_of) == dry and (ids("queries"), ids("feedback"), ids("traces")) == ([3, 4, 5], [2, 3, 4], [3])
    assert store.clean(as_of) == {"queries": 0, "feedback": 0, "traces": 0}
    assert store.anonymize(as_of) == {"queries": 1, "traces": 0} and rows(store.table("queries").where("id = 4"), "user_id", "user_name") == [(None, None)]
    one = spark.createDataFrame([(7,)], "user_id long")
    dry = store.forget(one, dry=True)
    assert dry == {"feedback": 2, "queries": 2, "traces": 1, "users": 1} and store.forget(one) == dry
    assert (ids("queries"), ids("feedback"), ids("traces"), ids("users")) == ([4], [4], [], [8, 9])
    store.save("queries", spark.createDataFrame([(9, 8, "m", day(5))], "id long, user_id long, user_name string, created_at timestamp_ntz"))
    assert store.forget(spark.createDataFrame([(8,)], "user_id long"), keep_questions=True)["anonymized"] == 1
    assert rows(store.table("queries"), "id", "user_id", "user_name") == [(9, None, None)]


def test_tiers(spark, tmp_path):
    store, source = tiers.TierStore(spark, str(tmp_path / "t")), tmp_path / "in"
    day = 86_400_000_000
    data = [("cpu", day * 40 + k * 7_000_000, k, float(k % 13)) for k in range(200)] + [("cpu", day * 3, 0, 1.0), ("ram", day * 10 + 5, 1, 2.0)]
    schema = "name string, us long, id long, value double"
    for k in (0, 1):
        spark.createDataFrame(data[k::2], schema).coalesce(1).write.parquet(f"file://{source}/{k}")
        store.follow(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"file://{source}")).awaitTermination()
    batch = tiers.sampled(spark.createDataFrame(data, schema))
    assert {r[:2] for r in rows(store.samples())} == {r[:2] for r in rows(batch)}
    assert store.expire(day // 1_000_000 * 40) == [3] and not any(r[1] < 4 * 86_400 for r in rows(store.samples()))
    kept = tiers.tiered(batch, 86_400 * 41, 10)
    hours = {r[2]: r[3:] for r in rows(kept) if r[0] == "hour"}
    slots = {}
    for _, us, k, v in data[:200]:
        slots[us // 30_000_000 * 30] = v
    plain = [v for s, v in slots.items() if s // 3600 == 40 * 24]
    assert hours[40 * 86_400] == (len(plain), min(plain), sum(plain) / len(plain), max(plain))


# --- folds and timers


def test_segments(spark):
    def grouped(segs):
        out, first, last, n = [], None, None, 0
        for a, b in sorted(segs):
            first = a if n == 0 else first
            last, n = b, n + 1
            if last - first >= 60:
                out.append((first, last, n))
                n = 0
        return out + ([(first, last, n)] if n else [])

    rng = random.Random(7)
    data = {k: [(float(a), a + rng.choice([1.0, 5.0, 90.0])) for a in sorted(rng.sample(range(900), rng.randint(1, 60)))] for k in range(12)} | {99: [(0.0, 40.0), (40.0, 70.0), (80.0, 90.0)]}
    df = spark.createDataFrame([(k, a, b) for k, x in data.items() for a, b in x], "key long, start double, end double").repartition(3)
    assert rows(segments.grouped(df, "key", 60.0)) == sorted(((k, *g) for k, x in data.items() for g in grouped(x)), key=repr)
    assert segments.grouped(df.limit(0), "key", 60.0).collect() == []


def plain_leases(requests, ttl, as_of):
    holder, until, lost, out = None, None, False, []
    for us, _, who, action in sorted(requests):
        if holder is not None and us >= until:
            out.append((until, holder, "expired"))
            holder, lost = None, True
        if action == "acquire":
            if holder is None:
                out.append((us, who, "taken_over" if lost else "granted"))
                holder, until, lost = who, us + ttl, False
            elif holder == who:
                until = us + ttl
                out.append((us, who, "renewed"))
            else:
                out.append((us, who, "refused"))
        elif holder == who:
            if action == "beat":
                until = us + ttl
            else:
                holder = None
                out.append((us, who, "released"))
        else:
            out.append((us, who, "ignored"))
    if holder is not None and as_of is not None and as_of >= until:
        out.append((until, holder, "expired"))
    return out


@pytest.fixture(scope="module")
def requests(spark, tmp_path_factory):
    """Requests in two files whose times overlap, within the lateness allowed."""
    rng = random.Random(8)
    data = [(rng.randrange(4), 1_700_000_000_000_000 + rng.randrange(0, 7_200) * 1_000_000, k, rng.choice("abc"), rng.choice(["acquire", "beat", "beat", "release"])) for k in range(300)]
    half, folder = 1_700_000_000_000_000 + 3_600_000_000, tmp_path_factory.mktemp("requests")
    for name, own in (("1", [x for x in data if x[1] < half + (x[2] % 2) * 300_000_000]), ("2", [x for x in data if x[1] >= half + (x[2] % 2) * 300_000_000])):
        spark.createDataFrame(own, "key long, us long, id long, holder string, action string").withColumn("at", F.timestamp_micros("us")).coalesce(1).write.parquet(f"file://{folder}/{name}")
    return data, str(folder)


def stream_of(spark, folder):
    schema = "key long, us long, id long, holder string, action string, at timestamp"
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")
    return stream.withWatermark("at", "10 minutes")


def test_leases(spark, requests, tmp_path):
    data, folder = requests
    ttl, as_of = 120_000_000, max(x[1] for x in data) - 600_000_000
    want = sorted(((k, *e) for k in range(4) for e in plain_leases([x[1:] for x in data if x[0] == k and x[1] <= as_of], ttl, as_of)), key=repr)
    assert {x[3] for x in want} == {"granted", "taken_over", "renewed", "refused", "released", "ignored", "expired"}
    df = spark.createDataFrame(data, "key long, us long, id long, holder string, action string").where(F.col("us") <= as_of)
    assert rows(vigil.leases(df, ttl, as_of)) == want
    out = str(tmp_path / "out")
    made = vigil.leases_stream(stream_of(spark, folder), ttl)
    put = lambda batch, n: batch.write.mode("overwrite").parquet(f"file://{out}/batch-{n}")
    made.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"file://{out}-state").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.option("recursiveFileLookup", "true").schema("key long, us long, holder string, event string").parquet(f"file://{out}")) == want


def test_silences(spark, requests):
    data, folder = requests
    as_of = max(x[1] for x in data) - 600_000_000
    want = []
    for k in range(4):
        us = sorted(x[1] for x in data if x[0] == k and x[1] <= as_of)
        want += [(k, a + 90_000_000, b) for a, b in zip(us, us[1:]) if b - a > 90_000_000] + [(k, us[-1] + 90_000_000, None)] * (as_of - us[-1] > 90_000_000)
    df = spark.createDataFrame(data, "key long, us long, id long, holder string, action string")
    assert rows(vigil.silences(df, 90_000_000, F.lit(as_of))) == sorted(want, key=repr)
    made = vigil.silences_stream(stream_of(spark, folder).select("key", "at"), 90_000_000)
    assert rows(vigil.replayed(spark, made, ["key", "since"], ["back"])) == sorted(want, key=repr)


def test_call_cap(spark):
    rng = random.Random(9)
    data = [(rng.choice(["1", "2"]), rng.randrange(0, 12) * 600_000_000, k) for k in range(120)]
    want, times = [], {}
    for number, us, k in sorted(data):
        own = [x for x in times.get(number, []) if us - x < 3_600_000_000]
        ok = len(own) < 3
        times[number] = own + [us] * ok
        want.append((number, k, ok))
    df = spark.createDataFrame(data, "number string, us long, id long")
    assert rows(access.capped_calls(df, 3)) == sorted(want, key=repr)


def test_lockout(spark):
    """Failures count by account and by address, within the window, since the last success."""
    data = [(k, k * 10, login, addr, failed) for k, (login, addr, failed) in enumerate([("a", 1, True), ("a", 2, True), ("a", 3, True), ("a", 3, False), ("a", 3, True), ("b", 3, True), ("c", 3, True), ("d", 3, False), ("e", 3, True)])]
    df = spark.createDataFrame(data, "event_id long, s long, login string, addr long, failed boolean").withColumn("ts", F.timestamp_seconds("s"))
    assert rows(access.locked(df, ["login", "addr"], 3, 1000), "event_id", "locked") == [(k, k in (3, 7)) for k in range(9)]
    assert not any(r[1] for r in rows(access.locked(df, ["login", "addr"], 3, 25), "event_id", "locked"))


def test_lockout_on_odd_rows(spark, tmp_path):
    """Ties, nulls, times before 1970, a crowded window: the rows of the SQL, and no frame that is gone through anew for each row."""
    import duckdb
    import pandas as pd

    from granary.queries import ORACLES, QUERIES

    rng = random.Random(17)
    start = datetime.datetime(2024, 1, 1)
    times = [start + datetime.timedelta(hours=rng.randrange(300), microseconds=rng.choice([0, 0, 1])) for _ in range(900)]
    times += [start + datetime.timedelta(days=40 + 2 * k, microseconds=rng.choice([-1, 0, 1])) for k in range(60)]
    times += [datetime.datetime(1970, 1, 1) + datetime.timedelta(hours=rng.randrange(-30, 30)) for _ in range(60)] + [None] * 30
    kinds = ["error", "error", "error", "click", "view", None]
    data = [(k, ts, rng.choice([*range(12), None]), rng.choice(kinds), 1.0, "{}") for k, ts in enumerate(times)]
    events = pd.DataFrame(data, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).astype({"user_id": "Int64", "ts": "datetime64[us]"})
    events.to_parquet(tmp_path / "events.parquet")
    df = QUERIES["flt_17"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = sorted(c.sql(ORACLES["flt_17"]).fetchall(), key=repr)
    assert len({x for _, x in want}) == 2 and rows(df, "event_id", "locked") == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, unboundedpreceding" in plan and "RangeFrame, -" not in plan
