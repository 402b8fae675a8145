"""Laws, models and negative controls of the core operators; Spark results against DuckDB."""

import hashlib
import json
import multiprocessing
import os
import random
import threading
import time
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.control import errors
from tidemark.control.commit import EVERY, Log, Rollback, with_transaction
from tidemark.control.files import Files
from tidemark.control.lease import Leases
from tidemark.control.migrate import migrate, namespace
from tidemark.control.session import abortable, session
from tidemark.control.stores import CheckpointStore, HistoryStore, KvStore
from tidemark.functions import values
from tidemark.operators import archive, checkpoint, cursors, envelope, history, temporal
from tidemark.plans import queries as plans
from tidemark.sources import chain_rpc, pull
from tidemark.streaming import ingest

T = datetime(2024, 1, 1)
PUTS = "ns string, scope string, key string, value string, written_at timestamp, ord long, txid long, expected long"


def normal(value):
    if isinstance(value, float) and value == int(value):
        return int(value)
    return str(value) if not isinstance(value, (int, type(None))) else value


def table_of(rows, columns):
    return sorted(str([normal(r[c]) for c in columns]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in "orders lineitem events documents pages conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_oracle(spark, sf, duck, name):
    got = plans.QUERIES[name](spark, sf)
    want = duck.sql(plans.ORACLES[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert table_of([r.asDict() for r in got.collect()], columns) == table_of(rows, columns)


def puts(spark, rows):
    return spark.createDataFrame([("n", "s", k, v, T + timedelta(milliseconds=5 * i), i, i, e) for i, (k, v, e) in enumerate(rows)], PUTS)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from(["1", "2", "{}"]), st.none() | st.integers(0, 6)), min_size=1, max_size=25), st.integers(0, 24))
def test_temporal_laws(spark, rows, cut):
    log = puts(spark, rows)
    # T2: compare and swap against a model
    state, want = {}, []
    for i, (k, _, e) in enumerate(rows):
        now = state.get(k, 0)
        ok = e is None or e == now
        state[k] = now + ok
        want.append((i, ok, now + ok, None if ok or not now else now))
    got = temporal.cas_replay(log).orderBy("ord").collect()
    assert [(r.ord, r.ok, r.version, r.actual) for r in got] == want
    # T1, T3, T5
    v = temporal.versions(log, "SECOND").cache()
    assert temporal.version_summary(v).where("not gapless").count() == 0
    assert temporal.overlaps(v).count() == 0 and temporal.gaps_in_time(v).count() == 0
    at = T + timedelta(milliseconds=5 * cut)
    model = {k: x for i, (k, x, _) in enumerate(rows) if i <= cut}
    assert {r.key: r.value for r in temporal.get_at(v, at=at).collect()} == model
    assert {r.key: r.value for r in temporal.as_of_log(log, at).collect()} == model
    # retention: the live version stays, what is below the floor is unavailable
    kept = temporal.prune_prefix(v, 2)
    assert {r.key for r in kept.collect()} == {k for k, _, _ in rows}
    for r in temporal.lookup(kept, log, at).collect():
        assert r.state == "unavailable" if r.key in model and r.value != model[r.key] else r.value == model.get(r.key)


def test_gaps_in_time_with_shared_versions(spark):
    at = lambda i: None if i is None else T + timedelta(seconds=i)
    # key, version, valid_from, valid_to, and whether that isn't where the next begins
    rows = [
        ("a", 3, 2, 9, True), ("a", 3, 1, 2, False), ("a", 4, 4, None, False),  # two share a number: the later follows
        ("b", 1, 1, 1, True), ("b", 1, 1, 3, False), ("b", 2, 3, None, False),  # the beginning, too: both are followed by 2
        ("c", 1, 5, 5, False), ("c", 1, 5, None, False),
    ]
    for order in (rows, rows[::-1]):
        v = spark.createDataFrame([("n", "s", k, "x", n, at(lo), at(hi)) for k, n, lo, hi, _ in order], "ns string, scope string, key string, value string, version long, valid_from timestamp, valid_to timestamp")
        got = sorted((r.key, r.version, r.valid_from, r.valid_to) for r in temporal.gaps_in_time(v.repartition(3)).collect())
        assert got == sorted((k, n, at(lo), at(hi)) for k, n, lo, hi, bad in rows if bad)


def test_buckets_do_not_change_versions(spark, sf):
    p = plans.fx.puts(spark, sf)
    columns = [*temporal.KEY, "value", "version", "valid_from", "valid_to"]
    a, b = (temporal.versions(p, x).select(*columns) for x in ("HOUR", "YEAR"))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_guards(spark):
    log = puts(spark, [("a", "1", None)])
    v = temporal.versions(log)
    for bad in ({}, {"version": 0}, {"version": True}, {"version": 1, "at": T}, {"at": "x"}, {"version": 1 << 63}):
        with pytest.raises(errors.ERRORS["VALIDATION_FAILED"]):
            temporal.get_at(v, **bad)
    for key in ("", "a\x00", "\ud800", None):
        with pytest.raises(errors.ERRORS["VALIDATION_FAILED"]):
            temporal.get(log, "n", "s", key)
    for bad in ({"retain": 0}, {"retain": 1.5}, {"retain": float("nan")}, {"retain": 10**20}, {"chunk_size": 0}, {"chunk_size": 1 << 25}, {"label": "x" * 201}, {"limit": 1001}):
        with pytest.raises(errors.ERRORS["VALIDATION_FAILED"]):
            checkpoint.check_options(**bad)
    with pytest.raises(errors.ERRORS["VALIDATION_FAILED"]):
        cursors.check_value(None)
    log = puts(spark, [("a%", "1", None), ("a_b", "1", None), ("ab", "1", None), ("a\\", "1", None)])
    assert [r.key for r in temporal.list_keys(log, "n", "s", "a%").collect()] == ["a%"]
    assert [b for b in temporal.iterate_keys(log, "n", "s", "a", 3)] == [["a%", "a\\", "a_b"], ["ab"]]
    assert list(temporal.iterate_keys(log, "n", "s", cancelled=lambda: True)) == []


def test_values(spark):
    deep = ["[" * 64 + "]" * 64, "[" * 65 + "]" * 65, '{"a":"[[[\\"["}', ""]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in deep], "v string").select(values.nesting(F.col("v"))).collect()] == [64, 65, 1, 0]
    dates = ["2024-02-29T00:00:00.000Z", "2024-02-30T00:00:00.000Z", "2024-02-29", "2024-02-29T00:00:00.000+01:00", None]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in dates], "v string").select(values.canonical_instant(F.col("v"))).collect()] == [True, False, False, False, False]
    numbers = ["0", "-5", "007", "", " 5", "0x10", "1" * 60, "-0"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in numbers], "v string").select(values.canonical_integer(F.col("v"))).collect()] == [True, True, False, False, False, False, True, True]
    assert values.canonical_json({"b": 1, "a": [2]}) == '{"a":[2],"b":1}'


def test_checkpoint_round_trip(spark):
    data = [b"", b"abc", b"a" * 10, b"a" * 25 + b"b", bytes(range(256)), b"abc"]
    p = spark.createDataFrame([("w", "n", i + 1, x) for i, x in enumerate(data)], "w string, net string, seq long, data binary")
    chunks = checkpoint.split(p, 10)
    j = chunks.select("w", "net", "seq", "position", "hash")
    pool = checkpoint.chunk_pool(chunks.withColumn("created_at", F.lit(T)))
    man = checkpoint.manifests(p, j).withColumn("complete", F.lit(True))
    got = {r.seq: (bytes(r.data), r.problem) for r in checkpoint.reassemble(man, j, pool).collect()}
    assert got == {i + 1: (x, None) for i, x in enumerate(data)}
    # what can't be put together has no data and says why
    lost, hurt = hashlib.sha256(b"a" * 10).hexdigest(), hashlib.sha256(b"abc").hexdigest()
    broken = pool.where(F.col("hash") != lost).withColumn("data", F.when(F.col("hash") == hurt, F.lit("abd").cast("binary")).otherwise(F.col("data")))
    bad = {r.seq: (r.data, r.problem) for r in checkpoint.reassemble(man, j, broken).collect() if r.problem}
    assert bad == {2: (None, "chunk_hash"), 3: (None, "chunk_missing"), 4: (None, "chunk_missing"), 6: (None, "chunk_hash")}
    gap = j.where("not (seq = 5 and position = 3)")
    assert {r.seq: r.problem for r in checkpoint.reassemble(man, gap, pool).collect() if r.problem} == {5: "density"}
    for r in man.collect():
        x = data[r.seq - 1]
        hashes = [hashlib.sha256(x[k : k + 10]).digest() for k in range(0, len(x), 10)]
        assert r.manifest_hash == hashlib.sha256(b"".join(hashes)).hexdigest() and r.n_chunks == len(hashes)
    assert checkpoint.verify(man, j, pool).count() == 0
    # a referenced chunk is never collected, young ones neither; fewer manifests than are retained: nothing goes
    _, dead = checkpoint.prune_and_collect(man, j, pool, 100, T + timedelta(days=1))
    assert dead.count() == 0
    gone, dead = checkpoint.prune_and_collect(man, j, pool, 1, T + timedelta(days=1))
    assert {r.seq for r in gone.collect()} == {1, 2, 3, 4, 5}
    assert hashlib.sha256(b"abc").hexdigest() not in {r.hash for r in dead.collect()} and dead.count() > 0
    assert checkpoint.prune_and_collect(man, j, pool, 1, T + timedelta(minutes=15))[1].count() == 0
    # merging pools is idempotent and doesn't depend on the order
    a, b = pool.where("hash < '8'"), pool.where("hash >= '4'")
    one, two = (checkpoint.merged_pools(x, y).select("hash", "size_bytes") for x, y in ((a, b), (b, a)))
    assert one.exceptAll(two).count() == two.exceptAll(one).count() == 0 and one.count() == pool.count()


def test_cursors(spark):
    sets = [("k", "a", '{"height":5}', 0), ("k", "a", '{"height":3}', 1), ("k", "a", '{"height":5,"x":1}', 2), ("k", "b", '"s"', 3), ("k", "b", "7", 4), ("k", "c", '{"height":9}', 5), ("k", "c", '{"height":"1"}', 6), ("k", "c", '{"height":2}', 7), ("k", "c", '{"height":1}', 8)]
    log = spark.createDataFrame([(a, b, v, T + timedelta(seconds=i), i) for a, b, v, i in sets], "kind string, key string, value string, updated_at timestamp, ord long")
    assert {r.key: r.value for r in cursors.monotone(log).collect()} == {"a": '{"height":5}', "b": "7", "c": '{"height":2}'}
    assert {r.key: r.value for r in cursors.last_write_wins(log).collect()} == {"a": '{"height":5,"x":1}', "b": "7", "c": '{"height":1}'}
    only = log.where("key = 'a'")
    assert [r.value for r in cursors.monotone(only).collect()] == ['{"height":5}']


def model_history(commands):
    """Entries after each command in turn."""
    state = {}
    for c in commands:
        live = state.setdefault(c["wallet"], {})
        e = live.get(c["hash"])
        if e is None:
            e = live[c["hash"]] = {"ids": list(dict.fromkeys(c["ids"])), "kind": c["kind"], "fees": c["fees"]}
        else:
            e["ids"] += [i for i in dict.fromkeys(c["ids"]) if i not in e["ids"]]
            e["kind"] = c["kind"]
            e["fees"] = e["fees"] if e["fees"] is not None else c["fees"]
        if c["kind"] != "pending" and e["ids"]:
            for h in [h for h, o in live.items() if h != c["hash"] and o["kind"] == "pending" and o["ids"] and set(o["ids"]) <= set(e["ids"])]:
                del live[h]
    return {(w, h): (sorted(e["ids"]), e["kind"], e["fees"]) for w, live in state.items() for h, e in live.items()}


def test_history_replay_against_model(spark):
    rng = random.Random(6)
    commands = [
        {"wallet": rng.choice("xyz"), "hash": rng.choice(["h1", "h2", "h3"]), "kind": rng.choice(["pending", "pending", "finalized", "rejected"]), "ids": rng.sample("abcd", rng.randint(0, 3)), "fees": rng.choice([None, 10**17, 3])}
        for _ in range(120)
    ]
    frame = spark.createDataFrame([(c["wallet"], i, c["kind"], c["hash"], c["ids"], None if c["fees"] is None else str(c["fees"])) for i, c in enumerate(commands)], "wallet_id string, ord long, kind string, hash string, identifiers array<string>, fees string")
    got = {(r.wallet_id, r.hash): (list(r.identifiers), r.lifecycle, None if r.fees is None else int(r.fees)) for r in history.replay(frame).collect()}
    assert got == model_history(commands)


def test_lifecycle_details_survive_merges(spark):
    rows = [("w", 1, "pending", "h", ["a"], {"x": {"p": "1"}}, "t1"), ("w", 2, "finalized", "h", ["b"], None, "t2"), ("w", 3, "pending", "g", ["q"], {"x": {"p": "2"}}, "t3"), ("w", 4, "pending", "g", [], {"x": {"r": "3"}}, "t4")]
    c = spark.createDataFrame(rows, "wallet_id string, ord long, kind string, hash string, identifiers array<string>, sections map<string,map<string,string>>, at string")
    entries = history.replay(history.with_detail(c, F.struct("at")).drop("at"))
    got = {r.hash: (r.lifecycle, r.detail, r.problem, {k: dict(v) for k, v in r.sections.items()}) for r in history.details(entries).collect()}
    assert got["h"] == ("finalized", '{"at":"t2"}', None, {"x": {"p": "1"}, history.DETAIL: {"pending": '{"at":"t1"}', "finalized": '{"at":"t2"}'}})
    assert got["g"][:3] == ("pending", '{"at":"t4"}', None) and got["g"][3]["x"] == {"p": "2", "r": "3"}
    assert [r.problem for r in history.details(history.replay(c.drop("at"))).collect()] == ["SERIALIZATION_FAILED"] * 2
    assert history.claimed_details(c).count() == 0 and history.claimed_details(history.with_detail(c, F.struct("at"))).count() == 4
    names = spark.createDataFrame([(x,) for x in ("success", "partialSuccess", "failure", "toString")], "s string").select(history.adapter_status(F.col("s")))
    assert [r[0] for r in names.collect()] == ["SUCCESS", "PARTIAL_SUCCESS", "FAILURE", None]


def test_section_merges(spark):
    row = spark.sql("SELECT map('s', map('a', 1, 'b', 2), 'only', map('z', 9)) AS a, map('s', map('b', 3, 'c', 4), 'new', map('y', 8)) AS b, map('f', 1) AS c, map('f', 2, 'g', 3) AS d")
    r = row.select(history.merge_sections(F.col("a"), F.col("b")).alias("x"), history.merge_facts(F.col("c"), F.col("d")).alias("y")).first()
    assert r.x == {"s": {"a": 1, "b": 3, "c": 4}, "only": {"z": 9}, "new": {"y": 8}} and r.y == {"f": 1, "g": 3}
    n = spark.sql("SELECT CAST('12345678901234567890' AS DECIMAL(38,0)) AS n").select(history.encode_tag(history.BIGINT_TAG, F.col("n")).alias("raw"))
    assert int(history.decode_tags(n, "raw").first().bigint_value) == 12345678901234567890


def test_put_transactions_against_model(spark, sf):
    t = plans.fx.transactions(spark, sf)
    order = ["l_partkey", "l_suppkey", "l_shipdate"]
    want, seen = [], {}
    for r in sorted(t.collect(), key=lambda r: tuple(r[c] for c in order)):
        hashes, positions = seen.setdefault(r.block_hash, (set(), set()))
        if r.tx_hash not in hashes and r.position not in positions:
            hashes.add(r.tx_hash)
            positions.add(r.position)
            want.append((r.block_hash, r.tx_hash, r.position))
    got = [(r.block_hash, r.tx_hash, r.position) for r in archive.put_transactions(t, order).collect()]
    assert sorted(got) == sorted(want)


def test_range_prunes_partitions(spark, sf, tmp_path):
    archive.write_partitioned(plans.fx.blocks(spark, sf), f"file://{tmp_path}/blocks", 500)
    b = spark.read.parquet(f"file://{tmp_path}/blocks")
    found = archive.height_range(b, 1600, 1900, 500)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(height)" in plan
    assert found.count() == plans.fx.blocks(spark, sf).where("height between 1600 and 1900").count() > 0
    assert archive.sync_range(None, 10, 4) == range(0, 4) and archive.sync_range(8, 10, 4) == range(9, 11) and not archive.sync_range(10, 10, 4)


def test_aggregates_and_pushdown_in_plans(spark, sf):
    plan = temporal.as_of_log(plans.fx.puts(spark, sf), plans.T0)._jdf.queryExecution().toString()
    assert "partial_max_by" in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp" in plan
    man, j, pool = plans.stored(spark, sf)
    assert "LeftAnti" in checkpoint.collectable(pool, j, T)._jdf.queryExecution().toString()


def test_envelope_round_trip(spark):
    rows = [(f"w{i}", "n", s, u, d) for i, (s, u, d) in enumerate([("a", None, "é\"\\"), (None, None, None), ("{}", "\n", "x" * 500)])]
    frame = spark.createDataFrame(rows, "wallet_id string, network_id string, shielded string, unshielded string, dust string")
    back = envelope.decode(envelope.encode(frame).select("data"))
    assert sorted((r.wallet_id, r.network_id, r.shielded, r.unshielded, r.dust) for r in back.where("problem is null").collect()) == sorted(rows, key=lambda r: r[0])
    bad = [b"\xff\xfe", b"[]", b"{", b'{"envelopeVersion":1}', b'{"envelopeVersion":2,"x":1}', b'{"envelopeVersion":1,"walletId":"","networkId":"n","subWallets":{"shielded":null,"unshielded":null,"dust":null}}', b'{"envelopeVersion":1,"walletId":"w","networkId":"n","subWallets":{"shielded":1,"unshielded":null,"dust":null}}']
    got = [r.problem for r in envelope.decode(spark.createDataFrame([(i, x) for i, x in enumerate(bad)], "i int, data binary")).orderBy("i").collect()]
    assert got == ["CORRUPT"] * 4 + ["VERSION_UNSUPPORTED"] + ["CORRUPT"] * 2
    own = frame.withColumns({"w": F.col("wallet_id"), "net": F.when(F.col("wallet_id") == "w1", "other").otherwise(F.col("network_id")), "seq": F.lit(1).cast("long")})
    chunks = envelope.save(own, 16)
    assert {r.w for r in chunks.collect()} == {"w0", "w2"} and [r.w for r in envelope.refused(own).collect()] == ["w1"]
    pool = checkpoint.chunk_pool(chunks.withColumn("created_at", F.lit(T)))
    j = chunks.select("w", "net", "seq", "position", "hash")
    man = checkpoint.manifests(own, j).where("n_chunks > 0").withColumn("complete", F.lit(True))
    assert {r.problem for r in envelope.load(man, j, pool).collect()} == {None}


def test_commit_log(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "i int")
    with_transaction(log, lambda tx: (tx.append("a", rows(1, 2)), tx.append("b", rows(7))))
    with pytest.raises(RuntimeError), log.transaction() as tx:
        tx.append("a", rows(3))
        raise RuntimeError("crash before the record")
    assert log.version() == 1 and log.read("a", "i int").count() == 2
    first, second = log.transaction(), log.transaction()
    first.append("a", rows(4))
    second.append("a", rows(5))
    first.commit()
    with pytest.raises(errors.ERRORS["TRANSACTION_FAULT"]):
        second.commit()
    with pytest.raises(errors.ERRORS["TRANSACTION_HANDLE_INVALID"]):
        first.append("a", rows(6))
    with log.transaction() as tx:
        tx.replace("a", rows(9))
    assert [r.i for r in log.read("a", "i int").collect()] == [9] and sorted(r.i for r in log.read("a", "i int", 2).collect()) == [1, 2, 4]

    def taken_back(tx):
        tx.append("a", rows(8))
        raise Rollback("no")

    with pytest.raises(errors.ERRORS["TRANSACTION_ROLLED_BACK"]):
        with_transaction(log, taken_back)
    with pytest.raises(errors.ERRORS["TRANSACTION_FAULT"]):
        with_transaction(log, lambda tx: (time.sleep(0.05), tx.append("a", rows(8))), timeout=0.01)
    # a writer that was overtaken is tried again on the new snapshot
    tries = []

    def overtaken(tx):
        tries.append(tx.base)
        if len(tries) == 1:
            with_transaction(log, lambda other: other.append("b", rows(1)))
        tx.append("b", rows(len(tries)))

    with_transaction(log, overtaken, retries=2)
    assert tries == [3, 4] and sorted(r.i for r in log.read("b", "i int").collect()) == [1, 2, 7]
    log.files.probe()


def test_snapshots_of_a_long_log(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log")
    for n in range(2 * EVERY + 3):
        with log.transaction(app="x", batch=n) as tx:
            tx.changes["t"] = {"add": [f"data/t/{n}"], "remove": [f"data/t/{n - 2}"]}
    assert len(log.files.names("snapshots")) == 2
    fresh = Log(spark, f"file://{tmp_path}/log")
    read, fresh.files.read = [], lambda name, own=fresh.files.read: (read.append(name), own(name))[1]
    assert fresh.version() == 2 * EVERY + 3 and fresh.last_batch("x") == 2 * EVERY + 2 and fresh.last_batch("y") is None
    assert fresh.folders("t") == [f"data/t/{2 * EVERY + 1}", f"data/t/{2 * EVERY + 2}"] and len(read) == 4
    assert fresh.folders("t", 1) == ["data/t/0"]


def test_only_one_writer_creates_a_file(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    files = Files(spark, f"file://{tmp_path}/f")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: files.create("sub/one", str(k)), range(16)))
    assert won.count(True) == 1 and files.read("sub/one") == str(won.index(True)) and files.names("sub") == ["one"] and files.names("none") == []


def test_stores(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log")
    kv = KvStore(log)
    batch = lambda *rows: spark.createDataFrame([("n", "s", k, v, i, e) for i, (k, v, e) in enumerate(rows)], "ns string, scope string, key string, value string, ord long, expected long")
    kv.put(batch(("a", "1", 0), ("b", "1", None)), T)
    for rows, at, code in (
        ([("c", "1", None), ("a", "2", 0)], T + timedelta(1), "VERSION_CONFLICT"), ([("c", "1", 3)], T + timedelta(1), "VERSION_CONFLICT"), ([("a", "2", None)], T, "CLOCK_REGRESSION"),
        ([("c", "1", None), ("c", "2", None)], T + timedelta(1), "TRANSACTION_KEY_REUSE"), ([("", "1", None)], T, "VALIDATION_FAILED"),
    ):
        with pytest.raises(errors.ERRORS[code]) as met:
            kv.put(batch(*rows), at)
        if rows[-1][2] == 0:
            assert met.value.details == {"expected": 0, "actual": 1}
    assert log.version() == 1  # nothing of a refused batch is there
    kv.put(batch(("a", "2", 1)), T + timedelta(1))
    assert {(r.key, r.value, r.version) for r in kv.current().collect()} == {("a", "2", 2), ("b", "1", 1)}

    store = CheckpointStore(log)
    payloads = spark.createDataFrame([("w", "n", bytearray(b"a" * 25), 1), ("w", "n", bytearray(b""), 2), ("v", "n", bytearray(b"a" * 10), 3)], "w string, net string, data binary, ord long")
    sets = spark.createDataFrame([("k", "w", '{"height":2}', T, 1)], "kind string, key string, value string, updated_at timestamp, ord long")
    store.save_and_advance(payloads, sets, T, chunk_size=10, label="x")
    assert log.version() == 3
    store.save(payloads, T + timedelta(hours=1), chunk_size=10)
    man, junction, pool = store.tables()
    assert sorted((r.w, r.seq, r.n_chunks, r.bytes) for r in man.collect()) == [("v", 1, 1, 10), ("v", 2, 1, 10), ("w", 1, 3, 25), ("w", 2, 0, 0), ("w", 3, 3, 25), ("w", 4, 0, 0)]
    assert log.read("chunks", "hash string").count() == 2 and {r.created_at for r in pool.collect()} == {T + timedelta(hours=1)}
    assert checkpoint.verify(man, junction, pool).count() == 0 and [r.value for r in store.cursors().collect()] == ['{"height":2}']
    assert {(r.w, r.seq): bytes(r.data) for r in store.load().collect()} == {("w", 4): b"", ("v", 2): b"a" * 10}
    assert store.prune(1, T + timedelta(days=1)) == 4 and log.read("chunks", "hash string").count() == 1
    with pytest.raises(errors.ERRORS["VALIDATION_FAILED"]):
        store.save_and_advance(payloads, sets.withColumn("value", F.lit(None).cast("string")), T)
    with pytest.raises(errors.ERRORS["VALIDATION_FAILED"]):
        store.save(payloads, T, chunk_size=0)
    assert store.tables()[0].count() == 2

    past = HistoryStore(log)
    entry = lambda h, ids, fees=None: spark.createDataFrame([("w", h, ids, fees, 1)], "wallet_id string, hash string, identifiers array<string>, fees string, ord long")
    past.got_pending(entry("h1", ["a"], "5"))
    past.got_pending(entry("h2", ["z"]))
    past.got_finalized(entry("h3", ["a", "b"]))
    past.got_rejected(entry("h2", ["y"]))
    assert [(r.hash, r.lifecycle, list(r.identifiers)) for r in past.entries().orderBy("hash").collect()] == [("h2", "rejected", ["y", "z"]), ("h3", "finalized", ["a", "b"])]


def test_flips_against_a_replay(spark):
    rng = random.Random(12)
    blocks = spark.createDataFrame([("n", h, b) for h in range(30) for b in "abc"], "net string, height long, block_hash string")
    flips = [("n", rng.randrange(30), rng.choice("abcd"), rng.choice([None, None, False, True]), i) for i in range(300)]
    state, refused = {}, {}
    for _, h, b, f, i in flips:
        now = state.setdefault(h, {"winner": None, "final": set(), "was": set()})
        if b == "d":
            refused[i] = "unknown"
        elif now["winner"] not in (None, b) and now["winner"] in now["final"]:
            refused[i] = "displaces"
        elif b in now["final"] and f is False:
            refused[i] = "unfinalizes"
        else:
            now["winner"] = b
            now["was"].add(b)
            now["final"] |= {b} if f else set()
    frame = spark.createDataFrame(flips, "net string, height long, block_hash string, finalized boolean, ord long")
    assert {r.ord: r.refused for r in archive.refused_flips(blocks, frame).collect()} == refused and set(refused.values()) == {"unknown", "displaces", "unfinalizes"}
    out = archive.canonical(blocks, frame)
    for r in out.collect():
        now = state.get(r.height, {"winner": None, "final": set(), "was": set()})
        status = "canonical" if now["winner"] == r.block_hash else "orphaned" if r.block_hash in now["was"] else "seen"
        assert (r.is_canonical, r.status, r.finalized) == (status == "canonical", status, r.block_hash in now["final"])
    assert archive.inconsistent_status(out).count() == archive.several_canonical(out).count() == 0


def test_deep_ancestry_and_forks(spark):
    chain = [("n", f"b{i}", f"b{i - 1}" if i else None, i) for i in range(700)] + [("n", "x", "b300", 301), ("m", "b699", "gone", 5)]
    blocks = spark.createDataFrame(chain, "net string, block_hash string, parent_hash string, height long")
    heads = spark.createDataFrame([("n", "b650"), ("n", "x"), ("m", "b699"), ("n", "no'ne")], "net string, block_hash string")
    got = {}
    for r in archive.ancestry(blocks, heads, 500).collect():
        got.setdefault((r.net, r["head"]), []).append((r.steps, r.block_hash))
    assert sorted(got["n", "b650"]) == [(k, f"b{650 - k}") for k in range(501)]
    assert sorted(got["n", "x"]) == [(0, "x")] + [(k + 1, f"b{300 - k}") for k in range(301)] and got["m", "b699"] == [(0, "b699")] and len(got) == 3


def test_rollover(spark, tmp_path):
    landing = spark.createDataFrame([("n", h, f"b{h}") for h in range(120, 380)], "net string, height long, block_hash string")
    path = f"file://{tmp_path}/blocks"
    for bad in ((50, 400, 100), (400, 100, 100), (100, 300, 100), (200, 400, 100), (True, 400, 100)):
        with pytest.raises(errors.ERRORS["VALIDATION_FAILED"]):
            archive.rollover(landing, path, *bad)
    assert archive.rollover(landing, path, 100, 400, 100) == 260 and archive.rollover(landing.where("height < 200"), path, 100, 200, 100) == 80
    there = spark.read.parquet(path)
    assert there.count() == 260 and sorted(r.bucket for r in there.select("bucket").distinct().collect()) == [1, 2, 3]


def test_strict_log_and_create_conflicts(spark):
    at = [0, 2, 2, 1, 3, 3, 9]
    log = spark.createDataFrame([("n", "s", "k", str(i), T + timedelta(seconds=t), i, i, None) for i, t in enumerate(at)], PUTS)
    assert sorted(r.ord for r in temporal.strict(log, 2).collect()) == [0, 1, 4, 6]
    v = temporal.versions(temporal.strict(log))
    assert v.where("valid_from >= valid_to").count() == 0 and temporal.clock_regressions(temporal.strict(log)).count() == 0
    more = puts(spark, [("k", "x", None), ("new", "1", None), ("new", "2", None)])
    assert {(r.key, r.ord, r.actual) for r in temporal.create_conflicts(log, more).collect()} == {("k", 0, 7), ("new", 2, 1)}
    whole = temporal.versions(log, with_last=True)
    assert temporal.prune_prefix(whole, 3).count() == temporal.prune_prefix(whole.drop("last_version"), 3).count() == 4


def test_large_versions_stay_exact(spark):
    big = (1 << 53) + 1
    ops = spark.createDataFrame([("n", "s", "k", "v", T, 0, 0, big)], PUTS)
    r = temporal.cas_replay(ops).first()
    assert (r.ok, r.version, r.actual) == (False, 0, None)


def test_cursor_far_ahead_costs_no_steps(spark):
    c = spark.createDataFrame([("k", "a", 10**12), ("k", "b", 3), ("k", "c", 0)], "kind string, key string, height long")
    done = spark.createDataFrame([("k", "a", 1), ("k", "a", 5), ("k", "a", 5), ("k", "a", 4 * 10**6), ("k", "b", 1), ("k", "b", 2), ("k", "b", 3), ("k", "b", 7)], "kind string, key string, height long")
    assert sorted((r.key, r.low, r.high) for r in cursors.ahead_of_data(c, done).collect()) == [("a", 2, 4), ("a", 6, 4 * 10**6 - 1), ("a", 4 * 10**6 + 1, 10**12)]


def test_transactions_meet_their_own_fork(spark):
    blocks = spark.createDataFrame([("n", 5, "aa", ["0xff01ee"]), ("n", 5, "bb", ["0x00"])], "net string, height long, block_hash string, extrinsics array<string>")
    indexed = spark.createDataFrame([(5, "0xAA", [("h1", 1, "0x01"), ("h2", 1, "0x02")]), (5, "0xcc", [("h3", 1, "0x01")])], "height long, hash string, transactions array<struct<hash:string,protocolVersion:int,raw:string>>")
    got = {r.tx_hash: r.problem for r in archive.transaction_records(blocks, indexed, "sys:").collect()}
    assert got == {"h1": None, "h2": "not in block body", "h3": "hash mismatch"}


def test_abortable(spark):
    from threading import Event, Timer

    gone = Event()
    gone.set()
    with pytest.raises(errors.ERRORS["TRANSACTION_ROLLED_BACK"]):
        abortable(spark, gone, lambda: 1)
    signal = Event()
    assert abortable(spark, signal, lambda: spark.range(5).count()) == 5
    Timer(1.0, signal.set).start()
    began = time.monotonic()
    with pytest.raises(errors.ERRORS["TRANSACTION_ROLLED_BACK"]):
        abortable(spark, signal, lambda: spark.range(1 << 40).selectExpr("sum(hash(id))").collect())
    assert time.monotonic() - began < 30 and spark.range(3).count() == 3
    assert session().conf.get("spark.sql.session.timeZone") == "UTC"


def _hold(folder, ready, done):
    leases = Leases(folder)
    lease = leases.acquire("k")
    ready.set()
    done.wait(20)
    leases.release(lease)


def test_leases(tmp_path):
    leases = Leases(str(tmp_path))
    context = multiprocessing.get_context("spawn")
    ready, done = context.Event(), context.Event()
    other = context.Process(target=_hold, args=(str(tmp_path), ready, done))
    other.start()
    assert ready.wait(20)
    assert leases.try_acquire("k") is None and leases.try_acquire("free") is not None
    with pytest.raises(errors.ERRORS["LEASE_TIMEOUT"]):
        leases.acquire("k", timeout=0.1)
    done.set()
    other.join(20)
    lease = leases.acquire("k", timeout=10)
    leases.release(lease)
    with pytest.raises(errors.ERRORS["LEASE_NOT_HELD"]):
        leases.release(lease)
    with pytest.raises(ValueError), leases.held("k"):
        raise ValueError
    with pytest.raises(BaseExceptionGroup), leases.held("k") as own:
        leases.release(own)
        raise ValueError


def test_migrations(spark, tmp_path):
    log, leases = Log(spark, str(tmp_path / "log")), Leases(str(tmp_path / "leases"))
    steps = [("000", lambda tx: None), ("001", lambda tx: tx.append("t", spark.range(3)))]
    assert migrate(log, leases, steps[:1]) == ["000"] and migrate(log, leases, steps) == ["001"] and migrate(log, leases, steps) == []
    assert log.read("t", "id long").count() == 3
    with pytest.raises(errors.ERRORS["VALIDATION_FAILED"]):
        migrate(log, leases, steps[1:])
    held = leases.acquire("migrations")
    with pytest.raises(errors.ERRORS["MIGRATION_LOCK_TIMEOUT"]):
        migrate(log, leases, steps, timeout=0.05)
    leases.release(held)
    with pytest.raises(errors.ERRORS["VALIDATION_FAILED"]):
        namespace("1; drop")


def test_error_catalogue():
    public = set(errors.CODES) - errors.INTERNAL
    assert len(public) == 24 and sum(errors.CODES[c] is True for c in public) == 4 and sum(errors.CODES[c] is None for c in public) == 1
    assert errors.of_audit("overlap").code == "EXCLUSION_VIOLATION" and errors.of_audit("?").code == "UNRECOGNIZED_POSTGRES_ERROR"


def node_json(n):
    return {"hash": f"0x{n:064x}", "header": {"parentHash": "0x00", "number": hex(n) if n != 3 else "zz", "stateRoot": "0x1", "extrinsicsRoot": "0x2", "digest": {"logs": []}}, "extrinsics": ["0xaa"]}


def test_stream_ingest_is_exactly_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(3):
        (source / f"{k}.json").write_text("\n".join(json.dumps(node_json(n)) for n in range(k * 2, k * 2 + 3)))
    log = Log(spark, str(tmp_path / "log"))
    ingest.ingest(spark, f"file://{source}", log, f"file://{tmp_path}/cp", "n", max_files=1).awaitTermination()
    blocks = log.read("blocks", ingest.BLOCKS)
    assert sorted(r.height for r in blocks.collect()) == [0, 1, 2, 4, 5, 6]
    before = log.version()
    assert ingest.commit_batch(log, chain_rpc.node_blocks(spark, f"file://{source}"), 0, "n", f"ingest n file://{tmp_path}/cp") is False and log.version() == before
    # a lost offset log replays everything: the data stay as they are, and a cursor never leads its data
    ingest.ingest(spark, f"file://{source}", log, f"file://{tmp_path}/cp2", "n").awaitTermination()
    assert log.read("blocks", ingest.BLOCKS).count() == 6
    for version in range(1, log.version() + 1):
        top = log.read("cursors", "kind string, key string, height long", version).agg(F.max("height")).first()[0]
        assert top is None or log.read("blocks", ingest.BLOCKS, version).where(F.col("height") == top).count() == 1


def test_stateful_parameter_changes(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k, rows in enumerate([[(1, "a"), (2, "a"), (3, "b")], [(4, "b"), (5, "a")]]):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"net": "n", "height": h, "value": v}) for h, v in rows))
        os.utime(source / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema("net string, height long, value string").option("maxFilesPerTrigger", 1).json(f"file://{source}")
    q = ingest.changed_parameters(stream).writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.height, r.value) for r in spark.table("changes").collect()) == [(1, "a"), (3, "b"), (5, "a")]


def test_rpc_clients():
    answers = {"chain_getFinalizedHead": "0xff", "chain_getHeader": {"number": "0x10"}, "chain_getBlockHash": "0x1", "chain_getBlock": {"block": {"extrinsics": []}}}
    node = chain_rpc.NodeClient("u", lambda url, body: json.dumps({"result": answers[json.loads(body)["method"]]}))
    assert node.finalized_height() == 16 and node.block(node.block_hash(3)) == {"extrinsics": []}
    answers["chain_getHeader"] = {"number": "nope"}
    with pytest.raises(errors.ERRORS["VALIDATION_FAILED"]):
        node.finalized_height()

    def down(url, body):
        raise OSError("down")

    with pytest.raises(errors.ERRORS["CONNECTION_ERROR"]):
        chain_rpc.NodeClient("u", down).finalized_head()
    assert chain_rpc.IndexerClient("u", lambda u, b: '{"data":{"block":{"hash":"0x1"}}}').block(1) == {"hash": "0x1"}
    with pytest.raises(errors.ERRORS["NOT_FOUND"]):
        chain_rpc.IndexerClient("u", lambda u, b: '{"data":{"block":null}}').block(1)


TIP = 9


def fake_node(url, body):
    call = json.loads(body)
    block = lambda n: {"block": {"header": node_json(n)["header"] | {"number": hex(n)}, "extrinsics": ["0xaa"]}}
    answers = {
        "chain_getFinalizedHead": lambda: "0xhead", "chain_getHeader": lambda at: {"number": hex(TIP)}, "chain_getBlockHash": lambda n: f"0x{n:064x}" if n <= 50 else None,
        "chain_getBlock": lambda at: block(int(at, 16)),
    }
    return json.dumps({"result": answers[call["method"]](*call["params"])})


def test_pull_source(spark, tmp_path):
    class Answers(BaseHTTPRequestHandler):
        def do_POST(self):
            body = fake_node("", self.rfile.read(int(self.headers["content-length"])).decode()).encode()
            self.send_response(200)
            self.send_header("content-length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    options = {"url": f"http://127.0.0.1:{server.server_port}", "per_task": "3"}
    spark.dataSource.register(pull.NodeBlocks)
    rows = spark.read.format("node_blocks").options(**options, low="2", high="9").load()
    assert rows.rdd.getNumPartitions() == 3 and sorted(int(r.header.number, 16) for r in rows.collect()) == list(range(2, 10))
    log = Log(spark, f"file://{tmp_path}/log")
    assert [ingest.sync_once(spark, log, options, "n", 6) for _ in range(3)] == [6, 4, 0]
    assert sorted(r.height for r in log.read("blocks", ingest.BLOCKS).collect()) == list(range(10))
    stream = spark.readStream.format("node_blocks").options(**options, max_blocks="4").load()
    q = stream.selectExpr("conv(substr(header.number, 3), 16, 10) AS n").writeStream.format("memory").queryName("pulled").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    until = time.monotonic() + 60
    while spark.table("pulled").count() < 10 and time.monotonic() < until:
        time.sleep(0.5)
    q.stop()
    server.shutdown()
    assert sorted(int(r.n) for r in spark.table("pulled").collect()) == list(range(10))


def test_retries_and_the_loop():
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            errors.raise_error("CONNECTION_ERROR")
        return 7

    assert pull.retried(flaky, 3, 0) == 7
    with pytest.raises(errors.ERRORS["CONNECTION_ERROR"]):
        pull.retried(lambda: errors.raise_error("CONNECTION_ERROR"), 2, 0)
    did, waits = iter([3, 0, "fault", 2, "stop"]), []
    state = {"stop": False}

    def step():
        now = next(did)
        if now == "fault":
            errors.raise_error("CONNECTION_ERROR")
        state["stop"] = now == "stop"
        return 0 if now == "stop" else now

    ingest.sync_loop(step, 15, 10, lambda: state["stop"], waits.append)
    assert waits == [10, 15]
    with pytest.raises(errors.ERRORS["VALIDATION_FAILED"]):
        ingest.sync_loop(lambda: errors.raise_error("VALIDATION_FAILED"))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_a_bundle_in_slices_is_the_bundle(spark, tmp_path):
    t = spark.range(300).selectExpr("'n' AS net", "id % 3 AS height", "concat('b', id % 40) AS block_hash", "concat('t', id * 7 % 90) AS tx_hash", "id % 11 AS position", "id AS ord")
    b, o = t.select(*archive.BLOCK, "ord"), t.select(*archive.BLOCK, F.col("position").alias("observation_index"), "ord")
    twice = [x.withColumn("ord", F.explode(F.array("ord", F.col("ord") + 1000))) for x in (b, t, o)]
    kept = {}
    for rows in (200, 1 << 23):
        log = Log(spark, f"file://{tmp_path}/{rows}")
        for _ in range(2):
            with log.transaction() as tx:
                archive.put_bundle(tx, *twice, slice_rows=rows)
        kept[rows] = [sorted(map(tuple, log.read(name, x.schema).collect())) for name, x in zip(("blocks", "transactions", "observations"), (b, t, o), strict=True)]
        assert len(log.folders("blocks")) == (6 if rows == 200 else 2)
    assert kept[200] == kept[1 << 23]
    assert kept[200][1] == sorted(map(tuple, archive.put_transactions(t, ["ord"]).collect()))


def test_an_append_leaves_no_shuffle_files(spark, tmp_path):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {os.path.join(d, x) for top in disk.localDirsString() for d, _, names in os.walk(top) for x in names if x.startswith("shuffle_")}
    before = shuffled()
    with Log(spark, f"file://{tmp_path}/log").transaction() as tx:
        tx.append("t", spark.range(100_000).groupBy((F.col("id") % 999).alias("k")).count())
    until = time.monotonic() + 10
    while shuffled() - before and time.monotonic() < until:  # they go in the background
        time.sleep(0.1)
    assert not shuffled() - before


def test_canonical_chain_is_what_canonical_marks(spark):
    rng = random.Random(5)
    blocks = spark.createDataFrame([(net, h, f"{net}{h}{b}") for net in "nm" for h in range(40) for b in "abc"] + [("n", 3, "n3a"), ("n", None, "x")], "net string, height long, block_hash string")
    flips = [(net := rng.choice("nm"), h := rng.randrange(44), f"{net}{h}{rng.choice('abcdd')}", rng.choice([None, None, False, True]), i) for i in range(260)]
    flips += [("n", 50, "n50a", True, 900), ("n", None, "x", True, 901), ("n", 4, None, True, 902), ("n", 5, "n5a", True, None)]
    frame = spark.createDataFrame(flips, "net string, height long, block_hash string, finalized boolean, ord long")
    want = sorted(map(tuple, archive.canonical(blocks, frame).where("is_canonical").select(*archive.BLOCK).collect()))
    assert len(want) > 60 and want.count(("n", 3, "n3a")) in (0, 2)
    for sizes in ({}, {"near_rows": 0}, {"near_rows": 0, "slice_rows": 100}, {"near_rows": 1000, "slice_rows": 100}):
        assert sorted(map(tuple, archive.canonical_chain(blocks, frame, **sizes).collect())) == want
    assert archive.canonical_chain(blocks, frame.limit(0)).count() == archive.canonical_chain(blocks.limit(0), frame).count() == 0
    tied = [("n", 1, x, f, 7) for x, f in (("n1d", True), ("n1c", True), ("n1b", True), ("n1a", False))] + [("n", 1, "n1a", True, 8)]
    assert [r.block_hash for r in archive.canonical_chain(blocks, spark.createDataFrame(tied, frame.schema)).collect()] == ["n1b"]


def test_ancestry_of_many_forks_shuffles_no_blocks(spark, tmp_path):
    day = F.expr("timestamp'1995-01-01' + make_interval(0, 0, 0, cast(id * 7919 % 400 as int))")
    orders = spark.range(100_000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 99).alias("o_custkey"), F.expr("substr('OFP', cast(id * id % 3 + 1 as int), 1)").alias("o_orderstatus"), day.alias("o_orderdate"))
    orders.repartition(4).write.parquet(f"{tmp_path}/orders.parquet")
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(x := found.apply(i)).stageId(): x.shuffleWriteBytes() for i in range(found.size())}

    before = max(stages(), default=-1)
    got = plans.chain_ancestry(spark, str(tmp_path)).collect()
    assert sum(n for k, n in stages().items() if k > before) < 1_000_000  # a hash a block alone is 6.4 MB
    con = duckdb.connect()
    con.execute(f"SET TimeZone = 'UTC'; CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.sql(plans.ORACLES["chain_ancestry"])
    assert sorted((r.height, r.block_hash, r.steps) for r in got) == sorted(want.select("height, block_hash, steps").fetchall()) and len(got) == 141
