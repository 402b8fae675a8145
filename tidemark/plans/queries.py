"""Registered queries over the driver's tables: one per operator, each with SQL of another form where SQL can say it."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..control.commit import Log
from ..control.files import Files, freed_shuffles, shared_dir, write_once
from ..control.stores import CheckpointStore
from ..operators import archive, checkpoint, cursors, envelope, history, temporal
from ..sources import fixtures as fx

T0 = datetime(2024, 1, 8, 12, 0, 0)
T0_SQL = "TIMESTAMP '2024-01-08 12:00:00'"
KEY = temporal.KEY
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

E = """E AS (SELECT 'events' AS ns, event_type AS scope, user_id::VARCHAR AS key, round(value * 100)::BIGINT::VARCHAR || ':' || props AS value,
    date_trunc('millisecond', ts) AS written_at, event_id AS ord, (event_id // 5)::BIGINT AS txid,
    CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 0 ELSE event_id % 7 END::BIGINT AS expected FROM events)"""
V = E + """, V AS (SELECT ns, scope, key, value, (SELECT count(*) FROM E p WHERE p.scope = E.scope AND p.key = E.key AND (p.written_at, p.ord) <= (E.written_at, E.ord))::BIGINT AS version,
    written_at AS valid_from, (SELECT min(p.written_at) FROM E p WHERE p.scope = E.scope AND p.key = E.key AND p.written_at > E.written_at) AS valid_to FROM E)"""
N = fx.CHUNK
P = """P AS (SELECT source AS w, lang AS net, doc_id, coalesce(text, '') AS text, (row_number() OVER (PARTITION BY source, lang ORDER BY doc_id))::BIGINT AS seq FROM documents)"""
J = P + f""", H AS (SELECT w, net, seq, hex(encode(text)) AS x FROM P),
    J AS (SELECT w, net, seq, pos::INTEGER AS position, sha256(unhex(substr(x, (pos * {2 * N} + 1)::BIGINT, {2 * N}))) AS hash, (length(substr(x, (pos * {2 * N} + 1)::BIGINT, {2 * N})) // 2)::INTEGER AS size_bytes
          FROM (SELECT *, unnest(range(0, (length(x) + {2 * N - 1}) // {2 * N})) AS pos FROM H))"""
M = J + """, M AS (SELECT P.w, P.net, P.seq, P.seq % 7 <> 0 AS complete, sha256(unhex(coalesce(string_agg(hash, '' ORDER BY position), ''))) AS manifest_hash, count(hash)::BIGINT AS n_chunks
    FROM P LEFT JOIN J USING (w, net, seq) GROUP BY ALL)"""
CHUNKS = """, C AS (SELECT hash, any_value(size_bytes) AS size_bytes, max(TIMESTAMP '2024-01-01 00:00:00' + to_minutes((seq % 40)::BIGINT)) AS created_at FROM J GROUP BY hash)"""
B = """B AS (SELECT 'net-a' AS net, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::BIGINT AS height, sha256(o_orderkey::VARCHAR) AS block_hash, o_orderkey AS ord, o_orderstatus AS o_status FROM orders)"""
K = B + """, BF AS (SELECT *, min(ord) FILTER (o_status = 'F') OVER (PARTITION BY height) AS settled, max(ord) OVER (PARTITION BY height) AS newest FROM B),
    K AS (SELECT net, height, block_hash, ord, o_status, ord = coalesce(settled, newest) AS is_canonical,
        CASE WHEN ord = coalesce(settled, newest) THEN 'canonical' WHEN settled IS NULL OR ord < settled THEN 'orphaned' ELSE 'seen' END AS status, coalesce(ord = settled, FALSE) AS finalized FROM BF)"""
T = B + """, T AS (SELECT net, height, block_hash, sha256(l_partkey::VARCHAR) AS tx_hash, l_linenumber::BIGINT AS position, l_partkey, l_suppkey, l_shipdate FROM lineitem JOIN B ON B.ord = l_orderkey)"""
W = """W AS (SELECT conv_id::VARCHAR AS wallet_id, turn AS ord, CASE WHEN turn % 3 = 2 THEN CASE WHEN conv_id % 5 = 0 THEN 'rejected' ELSE 'finalized' END ELSE 'pending' END AS kind,
    'h' || (turn % 3)::VARCHAR AS hash, list_transform(range(0, length(text) % 3 + 1), lambda k: 'i' || ((conv_id + turn + k) % 4)::VARCHAR) AS identifiers,
    CASE WHEN turn % 2 = 1 THEN length(text) % 10 END::BIGINT AS protocol_version, CASE WHEN role = 'user' THEN length(text) END::BIGINT AS fees FROM conversations)"""
X = W + """, X AS (SELECT wallet_id, hash, list_sort(list_distinct(flatten(list(identifiers)))) AS identifiers, arg_max(kind, ord) AS lifecycle,
    arg_min(protocol_version, ord) FILTER (protocol_version IS NOT NULL) AS protocol_version, arg_min(fees, ord) FILTER (fees IS NOT NULL) AS fees FROM W GROUP BY wallet_id, hash)"""
S = """S AS (SELECT event_type AS kind, user_id::VARCHAR AS key, CASE WHEN event_id % 10 = 3 THEN event_id - 500 ELSE event_id END AS height, ts AS updated_at, event_id AS ord FROM events)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def vers(spark, d):
    return temporal.versions(fx.puts(spark, d))


_KEPT: dict[tuple[str, str, str], str] = {}


def kept(spark, d, name: str, make) -> DataFrame:
    """A table that is stored once a session and read from then on, as a user holds it."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _KEPT:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        make().write.parquet(path)
        _KEPT[key] = path
    return spark.read.parquet(_KEPT[key])


def counted(df: DataFrame, case: str) -> DataFrame:
    return df.agg(F.count("*").alias("violations")).select(F.lit(case).alias("case"), "violations")


@query(f"WITH {E} SELECT ns, scope, key, value, row_number() OVER w AS version, written_at AS valid_from, lead(written_at) OVER w AS valid_to FROM E WINDOW w AS (PARTITION BY scope, key ORDER BY written_at, ord)")
def kv_versions(spark: SparkSession, d: str) -> DataFrame:
    """KV-1: puts as versions 1, 2, ... with their intervals."""
    return vers(spark, d)


@query(f"WITH {E}, F AS (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY written_at, ord) AS rn FROM E WHERE written_at >= {T0_SQL}) SELECT ns, scope, key, value, 1::BIGINT AS version FROM F WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM E p WHERE p.scope = F.scope AND p.key = F.key AND p.written_at < {T0_SQL})")
def kv_create_only(spark: SparkSession, d: str) -> DataFrame:
    """KV-2: the batch from T0 on, put with expected version 0 onto what was there before."""
    p = fx.puts(spark, d)
    return temporal.create_only(p.where(F.col("written_at") < F.lit(T0)), p.where(F.col("written_at") >= F.lit(T0))).select(*KEY, "value", "version")


@query(f"""WITH RECURSIVE {E}, O AS (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY written_at, ord) AS rn FROM E),
    R AS (SELECT scope, key, 0::BIGINT AS rn, 0::BIGINT AS ord, TRUE AS ok, 0::BIGINT AS version, NULL::BIGINT AS actual FROM O WHERE rn = 1
        UNION ALL SELECT O.scope, O.key, O.rn, O.ord, O.expected IS NULL OR O.expected = R.version, R.version + (O.expected IS NULL OR O.expected = R.version)::BIGINT,
            CASE WHEN NOT (O.expected IS NULL OR O.expected = R.version) AND R.version > 0 THEN R.version END FROM R JOIN O ON O.scope = R.scope AND O.key = R.key AND O.rn = R.rn + 1)
    SELECT 'events' AS ns, scope, key, ord, ok, version, actual FROM R WHERE rn > 0""")
def kv_cas_replay(spark: SparkSession, d: str) -> DataFrame:
    """KV-3: outcome of every compare-and-swap put, in order."""
    return temporal.cas_replay(fx.puts(spark, d))


@query(f"WITH {E}, Q AS (SELECT a.ns, a.scope, a.key, a.value, a.written_at AS valid_from, min(b.written_at) AS valid_to FROM E a JOIN E b ON a.scope = b.scope AND a.key = b.key AND b.written_at > a.written_at GROUP BY ALL) SELECT * FROM Q")
def kv_history(spark: SparkSession, d: str) -> DataFrame:
    """KV-4: superseded values and when they held."""
    return temporal.history(vers(spark, d)).select(*KEY, "value", "valid_from", "valid_to")


@query(f"WITH {E} SELECT txid, ns, scope, key, count(*) AS writes FROM E GROUP BY ALL HAVING count(*) > 1")
def kv_key_reuse(spark: SparkSession, d: str) -> DataFrame:
    """KV-5: keys written twice in a transaction of five events."""
    return temporal.reused_keys(fx.puts(spark, d)).select("txid", *KEY, "writes")


def corrupt_puts(p: DataFrame) -> DataFrame:
    """Every 50th event written an hour early, every 60th with a value nested too deep, every 70th without a key."""
    deep = F.concat(F.repeat(F.lit("["), 65), F.repeat(F.lit("]"), 65))
    return p.withColumns({
        "written_at": F.when(F.col("ord") % 50 == 0, F.col("written_at") - F.expr("interval 3 days")).otherwise(F.col("written_at")),
        "value": F.when(F.col("ord") % 60 == 0, deep).otherwise(F.col("value")), "key": F.when(F.col("ord") % 70 == 0, "").otherwise(F.col("key")),
    })


BAD = "BAD AS (SELECT * REPLACE (CASE WHEN ord % 50 = 0 THEN written_at - INTERVAL 3 DAY ELSE written_at END AS written_at, CASE WHEN ord % 70 = 0 THEN '' ELSE key END AS key) FROM E)"


@query(f"""WITH {E}, {BAD}, L AS (SELECT 'clean' AS "case", ord, scope, key, written_at FROM E UNION ALL SELECT 'corrupt', ord, scope, key, written_at FROM BAD),
    Q AS (SELECT "case", written_at, lag(written_at) OVER (PARTITION BY "case", scope, key ORDER BY ord) AS b FROM L) SELECT "case", count(*) FILTER (b >= written_at) AS violations FROM Q GROUP BY 1""")
def kv_clock_regression(spark: SparkSession, d: str) -> DataFrame:
    """KV-6: writes not later than the one before, on clean and on corrupt data."""
    p = fx.puts(spark, d)
    return counted(temporal.clock_regressions(p), "clean").unionByName(counted(temporal.clock_regressions(corrupt_puts(p)), "corrupt"))


@query(f"WITH {E} SELECT ns, scope, key, value, version, written_at AS updated_at FROM (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY written_at DESC, ord DESC) AS rn, count(*) OVER (PARTITION BY scope, key) AS version FROM E) WHERE rn = 1")
def kv_current(spark: SparkSession, d: str) -> DataFrame:
    """KV-7: live values."""
    return temporal.current(fx.puts(spark, d))


@query(f"WITH {V} SELECT ns, scope, key, value, version, valid_from FROM V WHERE version = 3")
def kv_at_version(spark: SparkSession, d: str) -> DataFrame:
    """KV-8: every key's third version."""
    return temporal.get_at(vers(spark, d), version=3).select(*KEY, "value", "version", "valid_from")


@query(f"WITH {E} SELECT ns, scope, key, arg_max(value, (written_at, ord)) AS value, count(*) AS version FROM E WHERE written_at <= {T0_SQL} GROUP BY ALL")
def kv_as_of(spark: SparkSession, d: str) -> DataFrame:
    """KV-9: state at T0 from intervals; the oracle folds the log (law T3)."""
    return temporal.get_at(vers(spark, d), at=T0).select(*KEY, "value", "version")


@query(f"WITH {E} SELECT ns, scope, key, arg_max(value, (written_at, ord)) AS value, count(*) AS version, max(written_at) AS updated_at FROM E WHERE written_at <= {T0_SQL} GROUP BY ALL")
def kv_as_of_log(spark: SparkSession, d: str) -> DataFrame:
    """KV-9 in bulk: state at T0 straight from the log."""
    return temporal.as_of_log(fx.puts(spark, d), T0)


@query(f"WITH {E}, Q AS (SELECT ns, scope, key, written_at + INTERVAL 2 HOUR AS at, ord AS probe FROM E) SELECT Q.ns, Q.scope, Q.key, Q.at, Q.probe, E.value, E.written_at FROM Q ASOF LEFT JOIN E ON Q.scope = E.scope AND Q.key = E.key AND Q.at >= E.written_at")
def kv_as_of_join(spark: SparkSession, d: str) -> DataFrame:
    """Table-to-table as-of join: the value two hours after every event."""
    p = fx.puts(spark, d)
    probes = p.select(*KEY, (F.col("written_at") + F.expr("interval 2 hours")).alias("at"), F.col("ord").alias("probe"))
    return temporal.as_of_join(p, probes)


@query(f"WITH {E} SELECT DISTINCT key FROM E WHERE scope = 'click' AND starts_with(key, '1')")
def kv_prefix_keys(spark: SparkSession, d: str) -> DataFrame:
    """KV-10: keys with a literal prefix."""
    return temporal.list_keys(fx.puts(spark, d), "events", "click", "1")


@query(f"""WITH {E} SELECT 'clean' AS "case", 0::BIGINT AS violations UNION ALL SELECT 'corrupt', count(*) FILTER (ord % 60 = 0 OR ord % 70 = 0) FROM E""")
def kv_row_validation(spark: SparkSession, d: str) -> DataFrame:
    """KV-12/13: rows whose names or values break the rules."""
    p = fx.puts(spark, d)
    return counted(temporal.invalid_rows(p), "clean").unionByName(counted(temporal.invalid_rows(corrupt_puts(p)), "corrupt"))


def corrupt_versions(v: DataFrame) -> DataFrame:
    """Every version divisible by 4 is reported as the one before and lasts an hour longer."""
    hit = F.col("version") % 4 == 0
    return v.withColumns({"version": F.when(hit, F.col("version") - 1).otherwise(F.col("version")), "valid_to": F.when(hit, F.col("valid_to") + F.expr("interval 1 hour")).otherwise(F.col("valid_to"))})


VBAD = """VB AS (SELECT * REPLACE (CASE WHEN version % 4 = 0 THEN version - 1 ELSE version END AS version, CASE WHEN version % 4 = 0 THEN valid_to + INTERVAL 1 HOUR ELSE valid_to END AS valid_to) FROM V),
    A AS (SELECT 'clean' AS "case", * FROM V UNION ALL SELECT 'corrupt', * FROM VB)"""


@query(f"""WITH {V}, {VBAD} SELECT "case", count(*) FILTER (EXISTS (SELECT 1 FROM A b WHERE b."case" = a."case" AND b.scope = a.scope AND b.key = a.key AND b.valid_from < a.valid_from AND coalesce(b.valid_to, TIMESTAMP '9999-12-31') > a.valid_from)) AS violations FROM A a GROUP BY 1""")
def kv_overlap_audit(spark: SparkSession, d: str) -> DataFrame:
    """KV-14: overlapping intervals."""
    v = vers(spark, d)
    return counted(temporal.overlaps(v), "clean").unionByName(counted(temporal.overlaps(corrupt_versions(v)), "corrupt"))


@query(f"""WITH {V}, {VBAD}, Q AS (SELECT "case", scope, key, min(version) = 1 AND max(version) = count(*) AND count(*) = count(DISTINCT version) AS ok FROM A GROUP BY ALL) SELECT "case", count(*) FILTER (NOT ok) AS violations FROM Q GROUP BY 1""")
def kv_gapless_audit(spark: SparkSession, d: str) -> DataFrame:
    """KV-15: keys whose versions don't run 1, 2, ..."""
    v = vers(spark, d)
    bad = lambda x: temporal.version_summary(x).where("not gapless")
    return counted(bad(v), "clean").unionByName(counted(bad(corrupt_versions(v)), "corrupt"))


@query(f"""WITH {V}, {VBAD}, Q AS (SELECT "case", valid_to, (SELECT arg_min(b.valid_from, (b.version, b.valid_from)) FROM A b WHERE b."case" = a."case" AND b.scope = a.scope AND b.key = a.key AND (b.version, b.valid_from) > (a.version, a.valid_from)) AS nxt FROM A a)
    SELECT "case", count(*) FILTER (nxt IS NOT NULL AND valid_to IS DISTINCT FROM nxt) AS violations FROM Q GROUP BY 1""")
def kv_contiguity_audit(spark: SparkSession, d: str) -> DataFrame:
    """KV-16: intervals that don't meet."""
    v = vers(spark, d)
    return counted(temporal.gaps_in_time(v), "clean").unionByName(counted(temporal.gaps_in_time(corrupt_versions(v)), "corrupt"))


@query(f"WITH {V} SELECT ns, scope, key, value, version FROM V a WHERE version > 5 OR NOT EXISTS (SELECT 1 FROM V b WHERE b.scope = a.scope AND b.key = a.key AND b.version > 5)")
def kv_prune_prefix(spark: SparkSession, d: str) -> DataFrame:
    """KV-17: history without each key's five oldest versions."""
    return temporal.prune_prefix(temporal.versions(fx.puts(spark, d), with_last=True), 5).select(*KEY, "value", "version")


@query(f"""WITH {V}, R AS (SELECT * FROM V a WHERE version > 5 OR NOT EXISTS (SELECT 1 FROM V b WHERE b.scope = a.scope AND b.key = a.key AND b.version > 5)),
    F AS (SELECT scope, key, min(version) AS fv, min(valid_from) AS fa FROM R GROUP BY ALL), H AS (SELECT scope, key, value, version FROM R WHERE valid_from <= {T0_SQL} AND (valid_to IS NULL OR {T0_SQL} < valid_to)),
    Q AS (SELECT ns, scope, key, CASE WHEN H.version IS NOT NULL THEN 'found' WHEN fv > 1 AND {T0_SQL} < fa THEN 'unavailable' ELSE 'absent' END AS state, value, version, fv FROM (SELECT DISTINCT ns, scope, key FROM E) LEFT JOIN F USING (scope, key) LEFT JOIN H USING (scope, key))
    SELECT ns, scope, key, state, value, version, CASE WHEN state = 'unavailable' THEN fv END AS floor FROM Q""")
def kv_lookup(spark: SparkSession, d: str) -> DataFrame:
    """KV-18: found, absent or unavailable at T0 after pruning."""
    p = fx.puts(spark, d)
    return temporal.lookup(temporal.prune_prefix(temporal.versions(p), 5), p, T0)


@query(f"WITH {E} SELECT DISTINCT ns, scope, key, 0::BIGINT AS mismatches FROM E")
def kv_dual_address(spark: SparkSession, d: str) -> DataFrame:
    """Law T4: a version and the instant of its writing address the same value."""
    p = fx.puts(spark, d)
    v = temporal.versions(p)
    probes = v.select(*KEY, F.col("valid_from").alias("at"), F.col("value").alias("by_version"))
    return temporal.as_of_join(p, probes).groupBy(*KEY).agg(F.count_if(~F.col("value").eqNullSafe(F.col("by_version"))).alias("mismatches"))


def payloads(spark, d):
    return checkpoint.allocate(fx.payloads(spark, d), spark.createDataFrame([], "w string, net string, seq long"), "doc_id")


def stored(spark, d):
    """Manifests, junction and pool of all documents; every seventh manifest is incomplete, chunks age with their last save."""
    p = payloads(spark, d)
    chunks = checkpoint.split(p, N)
    junction = kept(spark, d, "junction", lambda: chunks.select("w", "net", "seq", "position", "hash"))
    man = kept(spark, d, "manifests", lambda: checkpoint.manifests(p, junction).withColumn("complete", F.col("seq") % 7 != 0))
    created = F.lit(datetime(2024, 1, 1)) + F.make_interval(mins=(F.col("seq") % 40).cast("int"))
    return man, junction, kept(spark, d, "pool", lambda: checkpoint.chunk_pool(chunks.withColumn("created_at", created)))


@query(f"WITH {J} SELECT w, net, seq, position, hash, size_bytes FROM J")
def ckpt_chunks(spark: SparkSession, d: str) -> DataFrame:
    """CK-1/2: chunks of every payload."""
    return checkpoint.split(payloads(spark, d), N).select("w", "net", "seq", "position", "hash", "size_bytes")


@query(f"WITH {J}{CHUNKS} SELECT hash, size_bytes, created_at FROM C")
def ckpt_pool(spark: SparkSession, d: str) -> DataFrame:
    """CK-4: one chunk per hash, the clock refreshed by the last save."""
    return stored(spark, d)[2].select("hash", "size_bytes", "created_at")


@query(f"WITH {P} SELECT w, net, doc_id, seq + 10 AS seq FROM P")
def ckpt_sequence(spark: SparkSession, d: str) -> DataFrame:
    """CK-5: gapless numbers after each owner's tenth."""
    p = fx.payloads(spark, d).drop("data")
    return checkpoint.allocate(p, p.select("w", "net", F.lit(10).cast("long").alias("seq")), "doc_id").select("w", "net", "doc_id", "seq")


@query(f"WITH {M} SELECT w, net, seq, manifest_hash, n_chunks FROM M")
def ckpt_manifest_hash(spark: SparkSession, d: str) -> DataFrame:
    """CK-3/6/7: manifests."""
    p = payloads(spark, d)
    return checkpoint.manifests(p, stored(spark, d)[1]).select("w", "net", "seq", "manifest_hash", "n_chunks")


@query(f"WITH {M} SELECT w, net, seq, manifest_hash, n_chunks FROM M WHERE complete AND seq = (SELECT max(b.seq) FROM M b WHERE b.w = M.w AND b.net = M.net AND b.complete)")
def ckpt_load_latest(spark: SparkSession, d: str) -> DataFrame:
    """CK-8: each owner's latest complete manifest."""
    return checkpoint.load(stored(spark, d)[0]).select("w", "net", "seq", "manifest_hash", "n_chunks")


@query(f"WITH {P} SELECT w, net, seq, sha256(text) AS sha, NULL::VARCHAR AS problem FROM P WHERE seq % 7 <> 0")
def ckpt_reassemble(spark: SparkSession, d: str) -> DataFrame:
    """CK-9: payloads of all complete manifests put together again, empty ones too; every chunk rehashed."""
    return checkpoint.reassemble(*stored(spark, d)).select("w", "net", "seq", F.sha2("data", 256).alias("sha"), "problem")


@query(f"""WITH {M} SELECT M.w, M.net, M.seq, CASE WHEN n_chunks > 0 AND seq % 11 = 0 THEN 'density'
      WHEN EXISTS (SELECT 1 FROM J WHERE J.w = M.w AND J.net = M.net AND J.seq = M.seq AND starts_with(hash, '1')) THEN 'chunk_missing'
      WHEN EXISTS (SELECT 1 FROM J WHERE J.w = M.w AND J.net = M.net AND J.seq = M.seq AND starts_with(hash, '0')) THEN 'chunk_hash' END AS problem FROM M WHERE complete""")
def ckpt_reassemble_damaged(spark: SparkSession, d: str) -> DataFrame:
    """CK-9/11/12: a payload that can't be put together says why, and has no data."""
    return checkpoint.reassemble(*damaged(spark, d)).select("w", "net", "seq", "problem")


@query(f"""WITH {M}, S AS (SELECT w, net, max(seq) AS top FROM P GROUP BY ALL), R AS (SELECT w, net, seq, manifest_hash, n_chunks, octet_length(encode(text))::BIGINT AS bytes FROM M JOIN P USING (w, net, seq))
    SELECT w, net, seq, manifest_hash, n_chunks, bytes FROM R UNION ALL SELECT w, net, seq + top, manifest_hash, n_chunks, bytes FROM R JOIN S USING (w, net)""")
def ckpt_save(spark: SparkSession, d: str) -> DataFrame:
    """CK-7: every payload saved twice through the commit log; the second time no chunk is new and the numbers go on."""
    store = CheckpointStore(Log(spark, f"{shared_dir(spark)}/ckpt-save-{uuid.uuid4().hex}"))
    p = fx.payloads(spark, d)
    for minute in (0, 1):
        store.save(p, datetime(2024, 1, 1, 0, minute), "doc_id", N, label="twice")
    return store.tables()[0].select("w", "net", "seq", "manifest_hash", "n_chunks", "bytes")


@query(f"WITH {P} SELECT w AS kind, net AS key, max(seq) AS height, max(seq) AS saved FROM P GROUP BY ALL")
def ckpt_save_advance(spark: SparkSession, d: str) -> DataFrame:
    """WM-5: checkpoints and the cursors that count them in one commit."""
    store = CheckpointStore(Log(spark, f"{shared_dir(spark)}/ckpt-advance-{uuid.uuid4().hex}"))
    p, at = fx.payloads(spark, d), datetime(2024, 1, 1)
    heights = p.groupBy(F.col("w").alias("kind"), F.col("net").alias("key")).agg(F.count("*").alias("ord"))
    sets = heights.select("kind", "key", F.to_json(F.struct(F.col("ord").alias("height"))).alias("value"), F.lit(at).alias("updated_at"), "ord")
    store.save_and_advance(p, sets, at, "doc_id", chunk_size=N)
    saved = store.tables()[0].where("complete").groupBy(F.col("w").alias("kind"), F.col("net").alias("key")).agg(F.max("seq").alias("saved"))
    return store.cursors().select("kind", "key", cursors.height_of("value").cast("long").alias("height")).join(saved, ["kind", "key"])


def damaged(spark, d):
    """Chunk data changed where the hash begins with 0, gone where with 1; positions shifted in every 11th manifest, swapped hash in every 13th."""
    man, junction, pool = stored(spark, d)
    pool = pool.where(~F.startswith("hash", F.lit("1"))).withColumn("data", F.when(F.startswith("hash", F.lit("0")), F.concat("data", F.lit("!").cast("binary"))).otherwise(F.col("data")))
    junction = junction.withColumn("position", F.when(F.col("seq") % 11 == 0, F.col("position") + 1).otherwise(F.col("position")))
    man = man.withColumn("manifest_hash", F.when(F.col("seq") % 13 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("manifest_hash")))
    return man, junction, pool


@query(f"""WITH {M}, Q AS (SELECT M.w, M.net, M.seq, CASE WHEN n_chunks > 0 AND seq % 11 = 0 THEN 'density'
      WHEN EXISTS (SELECT 1 FROM J WHERE J.w = M.w AND J.net = M.net AND J.seq = M.seq AND starts_with(hash, '1')) THEN 'chunk_missing'
      WHEN EXISTS (SELECT 1 FROM J WHERE J.w = M.w AND J.net = M.net AND J.seq = M.seq AND starts_with(hash, '0')) THEN 'chunk_hash' WHEN seq % 13 = 0 THEN 'manifest_hash' END AS problem FROM M WHERE complete)
    SELECT * FROM Q WHERE problem IS NOT NULL""")
def ckpt_verify(spark: SparkSession, d: str) -> DataFrame:
    """CK-10..13: what is wrong with each damaged manifest."""
    return checkpoint.verify(*damaged(spark, d))


@query(f"""WITH {M} SELECT 'clean' AS "case", 0::BIGINT AS violations""")
def ckpt_verify_clean(spark: SparkSession, d: str) -> DataFrame:
    """CK-10..13 on sound data."""
    return counted(checkpoint.verify(*stored(spark, d)), "clean")


@query(f"""WITH {M}, G AS (SELECT * FROM M WHERE w = 'src0' AND net = 'en' AND complete AND seq < 1000 ORDER BY seq DESC LIMIT 50)
    SELECT G.w, G.net, G.seq, count(J.hash) AS n_chunks, coalesce(sum(J.size_bytes), 0)::BIGINT AS bytes FROM G LEFT JOIN J USING (w, net, seq) GROUP BY ALL""")
def ckpt_history(spark: SparkSession, d: str) -> DataFrame:
    """CK-14/15: a page of an owner's manifests with sizes."""
    return checkpoint.page(*stored(spark, d), "src0", "en", 50, 1000)


@query(f"WITH {M} SELECT w, net, seq FROM M a WHERE seq < (SELECT b.seq FROM M b WHERE b.w = a.w AND b.net = a.net AND b.complete ORDER BY b.seq DESC LIMIT 1 OFFSET 4)")
def ckpt_prune(spark: SparkSession, d: str) -> DataFrame:
    """CK-16: manifests older than the fifth newest complete one."""
    return checkpoint.prunable(stored(spark, d)[0], 5).select("w", "net", "seq")


@query(f"""WITH {M}{CHUNKS}, G AS (SELECT w, net, seq FROM M a WHERE seq < (SELECT b.seq FROM M b WHERE b.w = a.w AND b.net = a.net AND b.complete ORDER BY b.seq DESC LIMIT 1 OFFSET 4)),
    L AS (SELECT DISTINCT hash FROM J WHERE (w, net, seq) NOT IN (SELECT w, net, seq FROM G))
    SELECT count(*) AS chunks, coalesce(sum(size_bytes), 0)::BIGINT AS bytes FROM C WHERE created_at < TIMESTAMP '2024-01-01 00:20:00' - INTERVAL 15 MINUTE AND hash NOT IN (SELECT hash FROM L)""")
def ckpt_gc(spark: SparkSession, d: str) -> DataFrame:
    """CK-17: chunks reclaimed in the pass that prunes."""
    _, dead = checkpoint.prune_and_collect(*stored(spark, d), 5, datetime(2024, 1, 1, 0, 20))
    return dead.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("bytes"))


@query(f"WITH {M} SELECT w, net, seq, position FROM J WHERE seq % 7 = 0")
def ckpt_dangling(spark: SparkSession, d: str) -> DataFrame:
    """CK-19: junction rows without a complete manifest."""
    man, junction, _ = stored(spark, d)
    return checkpoint.dangling(junction, man).select("w", "net", "seq", "position")


@query(f"WITH {J} SELECT count(*) FILTER (seq % 2 = 1) AS referenced, count(DISTINCT hash) FILTER (seq % 2 = 1 AND hash NOT IN (SELECT hash FROM J b WHERE b.seq % 2 = 0)) AS written FROM J")
def ckpt_dedup_ratio(spark: SparkSession, d: str) -> DataFrame:
    """CK-20: positions and new chunks of the odd saves after the even ones."""
    j = stored(spark, d)[1]
    return checkpoint.dedup_ratio(j.where("seq % 2 = 1"), j.where("seq % 2 = 0"))


@query(f"WITH {J} SELECT DISTINCT hash, size_bytes FROM J")
def ckpt_pool_merge(spark: SparkSession, d: str) -> DataFrame:
    """CK-21: two pools merged."""
    c = checkpoint.split(payloads(spark, d), N)
    pool = lambda rest: c.where(f"seq % 2 = {rest}").groupBy("hash").agg(F.first("size_bytes").alias("size_bytes"))
    return checkpoint.merged_pools(pool(0), pool(1))


@query(f"WITH {S} SELECT kind, key, '{{\"height\":' || arg_max(height, (updated_at, ord))::VARCHAR || '}}' AS value, max(updated_at) AS updated_at FROM S GROUP BY ALL")
def cursor_lww(spark: SparkSession, d: str) -> DataFrame:
    """WM-1: the last set of each cursor."""
    return cursors.last_write_wins(fx.cursor_sets(spark, d))


@query(f"WITH {S} SELECT '{{\"height\":' || arg_max(height, (updated_at, ord))::VARCHAR || '}}' AS value FROM S WHERE kind = 'click' AND key = '7' HAVING count(*) > 0")
def cursor_get(spark: SparkSession, d: str) -> DataFrame:
    """WM-2/3: one cursor."""
    return cursors.get(fx.cursor_sets(spark, d), "click", "7")


@query(f"WITH {S} SELECT kind, key, '{{\"height\":' || max(height)::VARCHAR || '}}' AS value FROM S GROUP BY ALL")
def cursor_monotone(spark: SparkSession, d: str) -> DataFrame:
    """WM-4: heights only go forward."""
    return cursors.monotone(fx.cursor_sets(spark, d)).select("kind", "key", "value")


@query(f"""WITH {E}, C AS (SELECT scope AS kind, key, count(*) + 2 AS height FROM E GROUP BY ALL), L AS (SELECT kind, key, h FROM (SELECT kind, key, height, unnest(generate_series(1, height)) AS h FROM C) WHERE h > height - 2 OR h % 5 = 0),
    G AS (SELECT *, h - row_number() OVER (PARTITION BY kind, key ORDER BY h) AS island FROM L) SELECT kind, key, min(h) AS low, max(h) AS high FROM G GROUP BY kind, key, island""")
def cursor_not_ahead(spark: SparkSession, d: str) -> DataFrame:
    """WM-6: runs of steps that cursors claim and data lack; here the last two, and every fifth."""
    v = vers(spark, d)
    heights = v.groupBy(F.col("scope").alias("kind"), "key").agg((F.count("*") + 2).alias("height"))
    return cursors.ahead_of_data(heights, v.where("version % 5 <> 0").select(F.col("scope").alias("kind"), "key", F.col("version").alias("height")), 100)


@query(f"WITH {E}, C AS (SELECT scope, key, arg_max(value, (written_at, ord)) AS value FROM E GROUP BY ALL), D AS (SELECT scope, key, arg_max(value, (written_at, ord)) AS value FROM E WHERE ord % 9 <> 0 GROUP BY ALL) (SELECT *, 'left' AS side FROM (SELECT * FROM C EXCEPT ALL SELECT * FROM D)) UNION ALL (SELECT *, 'right' FROM (SELECT * FROM D EXCEPT ALL SELECT * FROM C))")
def state_difference(spark: SparkSession, d: str) -> DataFrame:
    """WM-7: where a state that lost every ninth event differs."""
    p = fx.puts(spark, d)
    state = lambda x: temporal.current(x).select("scope", "key", "value")
    return cursors.state_difference(state(p), state(p.where("ord % 9 <> 0")))


def text_ids(df: DataFrame) -> DataFrame:
    out = df.withColumn("identifiers", F.array_join("identifiers", ","))
    return out.withColumn("fees", F.col("fees").cast("long")) if "fees" in df.columns else out


@query(f"WITH {X} SELECT wallet_id, hash, list_aggregate(identifiers, 'string_agg', ',') AS identifiers, lifecycle, protocol_version, fees FROM X")
def hist_merge(spark: SparkSession, d: str) -> DataFrame:
    """TH-4/5/6: merged entries."""
    return text_ids(history.merged(fx.commands(spark, d)))


@query(f"WITH {X} SELECT wallet_id, hash FROM X a WHERE lifecycle = 'pending' AND len(identifiers) > 0 AND EXISTS (SELECT 1 FROM X b WHERE b.wallet_id = a.wallet_id AND b.hash <> a.hash AND b.lifecycle IN ('finalized', 'rejected') AND list_has_all(b.identifiers, a.identifiers))")
def hist_pending_clear(spark: SparkSession, d: str) -> DataFrame:
    """TH-7: pending entries that a final one clears."""
    return history.cleared(history.merged(fx.commands(spark, d))).select("wallet_id", "hash")


@query(f"""WITH RECURSIVE {W}, O AS (SELECT *, row_number() OVER (PARTITION BY wallet_id ORDER BY ord) AS rn FROM W),
    R AS (SELECT wallet_id, 0::BIGINT AS rn, []::STRUCT(h VARCHAR, k VARCHAR, ids VARCHAR[], pv BIGINT, f BIGINT)[] AS state FROM O WHERE rn = 1
        UNION ALL SELECT wallet_id, rn, list_append(list_filter(state, lambda x: x.h <> hash AND NOT (kind <> 'pending' AND x.k = 'pending' AND len(x.ids) > 0 AND list_has_all(ids, x.ids))),
                {{'h': hash, 'k': kind, 'ids': ids, 'pv': coalesce(old.pv, protocol_version), 'f': coalesce(old.f, fees)}})
            FROM (SELECT *, list_distinct(list_concat(coalesce(old.ids, []), identifiers)) AS ids
                FROM (SELECT O.*, R.state, list_filter(R.state, lambda x: x.h = O.hash)[1] AS old FROM R JOIN O ON O.wallet_id = R.wallet_id AND O.rn = R.rn + 1))),
    L AS (SELECT wallet_id, unnest(arg_max(state, rn)) AS e FROM R GROUP BY wallet_id)
    SELECT wallet_id, e.h AS hash, array_to_string(list_sort(e.ids), ',') AS identifiers, e.k AS lifecycle, e.pv AS protocol_version, e.f AS fees FROM L""")
def hist_replay(spark: SparkSession, d: str) -> DataFrame:
    """TH-4..7 in order, with clearing at each step; the oracle replays the commands too."""
    return text_ids(history.replay(fx.commands(spark, d))).withColumn("protocol_version", F.col("protocol_version").cast("long"))


@query(f"WITH {X} SELECT hash, lifecycle FROM X WHERE wallet_id = '7'")
def hist_get_all(spark: SparkSession, d: str) -> DataFrame:
    """TH-1/2: a wallet's entries by hash."""
    return history.get_all(history.merged(fx.commands(spark, d)), "7").select("hash", "lifecycle")


@query(f"""WITH {X} SELECT wallet_id, '[' || string_agg('{{"hash":"' || hash || '","lifecycle":"' || lifecycle || '"}}', ',' ORDER BY hash) || ']' AS json FROM X GROUP BY wallet_id""")
def hist_serialize(spark: SparkSession, d: str) -> DataFrame:
    """TH-3: a wallet's entries as one JSON text."""
    return history.serialized(history.merged(fx.commands(spark, d)).select("wallet_id", "hash", "lifecycle"))


@query("""WITH Q AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN conv_id::VARCHAR WHEN 1 THEN '0' || conv_id::VARCHAR WHEN 2 THEN '-' || (conv_id + 1)::VARCHAR ELSE ' 5' END AS n FROM conversations)
    SELECT conv_id, turn, CASE WHEN turn % 4 IN (0, 2) THEN n::BIGINT END AS bigint_value, CASE WHEN turn % 4 IN (1, 3) THEN 'bigint' END AS problem FROM Q""")
def hist_codec(spark: SparkSession, d: str) -> DataFrame:
    """TH-8: tagged big integers decode only in canonical form."""
    c = fx.read(spark, d, "conversations").select("conv_id", "turn")
    n = F.expr("CASE turn % 4 WHEN 0 THEN string(conv_id) WHEN 1 THEN '0' || string(conv_id) WHEN 2 THEN '-' || string(conv_id + 1) ELSE ' 5' END")
    out = history.decode_tags(c.withColumn("raw", F.to_json(F.struct(n.alias(history.BIGINT_TAG)))), "raw")
    return out.select("conv_id", "turn", F.col("bigint_value").cast("long").alias("bigint_value"), "problem")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'reserved' WHEN turn % 3 = 1 THEN 'depth' END AS problem FROM conversations")
def hist_content_rules(spark: SparkSession, d: str) -> DataFrame:
    """TH-10: reserved keys and deep values."""
    c = fx.read(spark, d, "conversations").select("conv_id", "turn")
    key = F.when(F.col("turn") % 3 == 0, F.lit("$tag")).otherwise(F.lit("fact"))
    deep = F.when(F.col("turn") % 3 == 1, F.repeat(F.lit('{"a":'), 65)).otherwise(F.lit('{"a":"[[["}'))
    return history.content_problems(c.withColumns({"k": key, "v": deep}), "k", "v").select("conv_id", "turn", "problem")


@query(f"WITH {X} SELECT wallet_id, hash FROM X WHERE protocol_version IS NULL OR fees % 2 = 1")
def hist_stored_audit(spark: SparkSession, d: str) -> DataFrame:
    """TH-9: stored entries of the wrong shape, seeded."""
    x = history.merged(fx.commands(spark, d))
    odd = x.withColumns({"lifecycle": F.when(F.col("protocol_version").isNull(), "lost").otherwise(F.col("lifecycle")), "fees": F.when(F.col("fees") % 2 == 1, F.concat(F.lit("0"), F.col("fees").cast("string"))).otherwise(F.col("fees").cast("string")), "timestamp": F.lit("2024-02-29T00:00:00.000Z")})
    return history.stored_problems(odd).select("wallet_id", "hash")


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'partialSuccess' WHEN 2 THEN 'failure' END AS status FROM conversations")
def hist_status(spark: SparkSession, d: str) -> DataFrame:
    """TH-11: adapter statuses; unknown ones are null."""
    c = fx.read(spark, d, "conversations").select("conv_id", "turn")
    return c.select("conv_id", "turn", history.map_status(F.expr("element_at(array('SUCCESS', 'PARTIAL_SUCCESS', 'FAILURE', 'OTHER'), int(turn % 4) + 1)")).alias("status"))


def envelopes(spark, d):
    c = fx.read(spark, d, "conversations")
    return c.select("conv_id", "turn", F.col("conv_id").cast("string").alias("wallet_id"), F.col("role").alias("network_id"), F.lit("s").alias("shielded"), F.when(F.col("turn") % 2 == 0, "u").alias("unshielded"), F.lit(None).cast("string").alias("dust"))


ENVELOPE_SQL = """'{"envelopeVersion":1,"walletId":"' || conv_id::VARCHAR || '","networkId":"' || role || '","subWallets":{"shielded":"s","unshielded":' || CASE WHEN turn % 2 = 0 THEN '"u"' ELSE 'null' END || ',"dust":null}}'"""


@query(f"SELECT conv_id, turn, sha256({ENVELOPE_SQL}) AS sha FROM conversations")
def envelope_encode(spark: SparkSession, d: str) -> DataFrame:
    """EN-1/3: encoded envelopes."""
    return envelope.encode(envelopes(spark, d)).select("conv_id", "turn", F.sha2("data", 256).alias("sha"))


@query("""SELECT conv_id, turn, CASE turn % 5 WHEN 1 THEN 'VERSION_UNSUPPORTED' WHEN 2 THEN 'CORRUPT' WHEN 3 THEN 'CORRUPT' WHEN 4 THEN 'VERSION_UNSUPPORTED' END AS problem,
    CASE WHEN turn % 5 = 0 THEN conv_id::VARCHAR END AS wallet_id, CASE WHEN turn % 5 = 0 AND turn % 2 = 0 THEN 'u' END AS unshielded FROM conversations""")
def envelope_decode(spark: SparkSession, d: str) -> DataFrame:
    """EN-2/4: decoding; another version, broken JSON, an unknown key, and a wrong version of a wrong shape."""
    e = envelope.encode(envelopes(spark, d)).withColumn("t", F.col("data").cast("string")).select("conv_id", "turn", "t")
    bad = F.expr("""CASE turn % 5 WHEN 0 THEN t WHEN 1 THEN replace(t, 'Version":1', 'Version":2') WHEN 2 THEN substr(t, 1, length(t) - 1) WHEN 3 THEN replace(t, '"dust"', '"dusty"') ELSE '{"envelopeVersion":9}' END""")
    return envelope.decode(e.withColumn("data", F.encode(bad, "UTF-8"))).select("conv_id", "turn", "problem", "wallet_id", "unshielded")


def chain(spark, d):
    return archive.canonical(fx.blocks(spark, d), fx.flips(spark, d))


@query(f"WITH {K} SELECT net, height, block_hash, is_canonical, status, finalized FROM K")
def chain_canonical(spark: SparkSession, d: str) -> DataFrame:
    """CA-7: canonical state after all flips that the archive takes."""
    return chain(spark, d).select("net", "height", "block_hash", "is_canonical", "status", "finalized")


@query(f"""WITH RECURSIVE {B}, O AS (SELECT *, row_number() OVER (PARTITION BY height ORDER BY ord) AS rn FROM B),
    R AS (SELECT height, 0::BIGINT AS rn, NULL::BIGINT AS ord, NULL::VARCHAR AS block_hash, NULL::VARCHAR AS final, FALSE AS refused FROM O WHERE rn = 1
        UNION ALL SELECT O.height, O.rn, O.ord, O.block_hash, CASE WHEN R.final IS NULL AND O.o_status = 'F' THEN O.block_hash ELSE R.final END, R.final IS NOT NULL AND R.final <> O.block_hash FROM R JOIN O ON O.height = R.height AND O.rn = R.rn + 1)
    SELECT height, block_hash, ord, 'displaces' AS refused FROM R WHERE refused""")
def chain_refused_flips(spark: SparkSession, d: str) -> DataFrame:
    """CA-7: flips that would displace a final block, by a replay of each height in the oracle."""
    return archive.refused_flips(fx.blocks(spark, d), fx.flips(spark, d)).select("height", "block_hash", "ord", "refused")


@query(f"WITH {B} SELECT net, height, block_hash, min(ord) AS ord FROM (SELECT net, height // 30 AS height, substr(block_hash, 1, 1) AS block_hash, ord FROM B) q WHERE NOT EXISTS (SELECT 1 FROM B WHERE B.height // 30 = q.height AND substr(B.block_hash, 1, 1) = q.block_hash AND B.ord % 10 = 0) GROUP BY ALL")
def chain_put_blocks(spark: SparkSession, d: str) -> DataFrame:
    """CA-2/5: first write wins in a batch and against what is stored; keys are coarsened so that they collide."""
    b = fx.blocks(spark, d).select("net", F.floor(F.col("height") / 30).alias("height"), F.substring("block_hash", 1, 1).alias("block_hash"), "ord")
    return archive.first_wins(b, archive.BLOCK, ["ord"], b.where("ord % 10 = 0"))


KEPT_TX = T + """, O AS (SELECT *, row_number() OVER (PARTITION BY block_hash ORDER BY l_partkey, l_suppkey, l_shipdate) AS rn FROM T),
    R AS (SELECT height, block_hash, 0::BIGINT AS rn, NULL::VARCHAR AS tx_hash, NULL::BIGINT AS position, NULL::BIGINT AS l_suppkey, FALSE AS ok, []::VARCHAR[] AS hashes, []::BIGINT[] AS positions FROM O WHERE rn = 1
        UNION ALL SELECT O.height, O.block_hash, O.rn, O.tx_hash, O.position, O.l_suppkey, NOT (list_contains(R.hashes, O.tx_hash) OR list_contains(R.positions, O.position)),
            CASE WHEN list_contains(R.hashes, O.tx_hash) OR list_contains(R.positions, O.position) THEN R.hashes ELSE list_append(R.hashes, O.tx_hash) END,
            CASE WHEN list_contains(R.hashes, O.tx_hash) OR list_contains(R.positions, O.position) THEN R.positions ELSE list_append(R.positions, O.position) END
        FROM R JOIN O ON O.block_hash = R.block_hash AND O.rn = R.rn + 1)"""


@query(f"WITH RECURSIVE {KEPT_TX} SELECT height, block_hash, tx_hash, position, l_suppkey FROM R WHERE ok")
def chain_put_transactions(spark: SparkSession, d: str) -> DataFrame:
    """CA-3: inserts that neither hash nor position refuses, in order."""
    t = fx.transactions(spark, d)
    return archive.put_transactions(t, ["l_partkey", "l_suppkey", "l_shipdate"]).select("height", "block_hash", "tx_hash", "position", "l_suppkey")


@query(f"""WITH RECURSIVE {KEPT_TX} SELECT 'blocks' AS "table", count(*) AS n, count(DISTINCT block_hash) AS distinct_n FROM B UNION ALL SELECT 'transactions', count(*), count(DISTINCT (block_hash, position)) FROM R WHERE ok
    UNION ALL SELECT 'observations', count(*), count(*) FROM (SELECT DISTINCT block_hash, position FROM T)""")
def chain_put_bundle(spark: SparkSession, d: str) -> DataFrame:
    """CA-5: blocks, transactions and observations in one commit; each bundle holds all rows twice, and is sent twice."""
    log, lines = Log(spark, f"{shared_dir(spark)}/bundle-{uuid.uuid4().hex}"), Files(spark, f"{shared_dir(spark)}/bundle-lines-{uuid.uuid4().hex}")
    write_once(fx.numbered_lines(spark, d), lines.at("rows"))  # numbers take a tenth of their hashes' room
    raw = lambda number: F.unhex(F.sha2(F.col(number).cast("string"), 256))
    b = fx.blocks(spark, d).select("net", "height", raw("ord").alias("block_hash"), "ord")
    t = spark.read.parquet(lines.at("rows")).select(F.lit(fx.NET).alias("net"), "height", raw("l_orderkey").alias("block_hash"), raw("l_partkey").alias("tx_hash"), "position", "ord")
    o = t.select(*archive.BLOCK, F.col("position").alias("observation_index"), "ord")
    for _ in range(2):
        with log.transaction() as tx:
            archive.put_bundle(tx, *(x.withColumn("ord", F.explode(F.array("ord", F.col("ord") + 1_000_000_000))) for x in (b, t, o)))
    lines.delete("rows")
    counts = []
    with freed_shuffles(spark):
        for name, frame, last in (("blocks", b, []), ("transactions", t, ["position"]), ("observations", o, ["observation_index"])):
            rows = log.read(name, frame.schema)
            n = max(1, rows.count() >> 23)
            found = [archive.slice_of(rows, k, n).agg(F.count("*"), F.count_distinct("block_hash", *last)).first() for k in range(n)]
            counts.append((name, sum(x[0] for x in found), sum(x[1] for x in found)))
    return spark.createDataFrame(counts, "table string, n long, distinct_n long")


@query(f"WITH {T} SELECT height, block_hash, position AS observation_index, arg_min(l_suppkey, (l_partkey, l_suppkey, l_shipdate)) AS l_suppkey FROM T GROUP BY ALL")
def chain_put_observations(spark: SparkSession, d: str) -> DataFrame:
    """CA-4: first observation of each index."""
    t = fx.transactions(spark, d).withColumnRenamed("position", "observation_index")
    return archive.first_wins(t, [*archive.BLOCK, "observation_index"], ["l_partkey", "l_suppkey", "l_shipdate"]).select("height", "block_hash", "observation_index", "l_suppkey")


@query(f"WITH {T} SELECT tx_hash AS vk_hash, CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey % 3 END AS contract_address, min(height) AS first_seen_height FROM T GROUP BY ALL")
def chain_vk_min(spark: SparkSession, d: str) -> DataFrame:
    """CA-6: least height of each verifier key."""
    t = fx.transactions(spark, d)
    seen = t.select(F.col("tx_hash").alias("vk_hash"), "net", F.lit("contract").alias("scope"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey") % 3).alias("contract_address"), F.lit("t").alias("tag"), F.col("height").alias("first_seen_height"))
    return archive.verifier_keys(seen).select("vk_hash", "contract_address", "first_seen_height")


@query(f"WITH {K} SELECT block_hash, is_canonical FROM K WHERE height = 2000")
def chain_blocks_at(spark: SparkSession, d: str) -> DataFrame:
    """CA-8: all forks of a height."""
    return archive.blocks_at(chain(spark, d), fx.NET, 2000).select("block_hash", "is_canonical")


@query(f"WITH {K} SELECT block_hash FROM K WHERE height = 2000 AND is_canonical")
def chain_canonical_at(spark: SparkSession, d: str) -> DataFrame:
    """CA-9: the canonical block of a height."""
    return archive.canonical_at(chain(spark, d), fx.NET, 2000).select("block_hash")


@query(f"WITH {T} SELECT block_hash, height, position FROM T WHERE tx_hash = sha256('17')")
def chain_tx_by_hash(spark: SparkSession, d: str) -> DataFrame:
    """CA-10: a transaction on every fork."""
    import hashlib

    return archive.transactions_by_hash(fx.transactions(spark, d), fx.NET, hashlib.sha256(b"17").hexdigest()).select("block_hash", "height", "position")


@query(f"WITH {T} SELECT tx_hash, position FROM T WHERE block_hash = sha256('17')")
def chain_tx_for_block(spark: SparkSession, d: str) -> DataFrame:
    """CA-11: a block's transactions."""
    import hashlib

    h = hashlib.sha256(b"17").hexdigest()
    return fx.transactions(spark, d).where(F.col("block_hash") == h).orderBy("position").select("tx_hash", "position")


@query(f"WITH {K} SELECT height, block_hash FROM K WHERE is_canonical AND height BETWEEN 1500 AND 3000")
def chain_range(spark: SparkSession, d: str) -> DataFrame:
    """CA-12/20: the canonical chain between two heights, pruned by bucket."""
    b = chain(spark, d).withColumn("bucket", archive.bucket_of(F.col("height"), 500))
    return archive.height_range(b.where("is_canonical"), 1500, 3000, 500).orderBy("height").select("height", "block_hash")


def page_blobs(spark, d):
    p = fx.read(spark, d, "pages").select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("data"), F.when(F.col("page_id") % 2 == 0, "tx_raw").otherwise("proof").alias("role"))
    return p.withColumn("ord", F.col("page_id"))


@query("SELECT sha256(coalesce(html, '')) AS hash, octet_length(encode(any_value(coalesce(html, ''))))::INTEGER AS size_bytes FROM pages GROUP BY 1")
def chain_put_blobs(spark: SparkSession, d: str) -> DataFrame:
    """CA-1: distinct blobs."""
    return archive.put_blobs(page_blobs(spark, d))[0].select("hash", "size_bytes")


@query("""WITH H AS (SELECT DISTINCT sha256(coalesce(html, '')) AS hash FROM pages) SELECT hash, CASE WHEN starts_with(hash, '1') THEN 'blob_missing' WHEN starts_with(hash, '0') THEN 'blob_hash' END AS problem FROM H""")
def chain_blob_verify(spark: SparkSession, d: str) -> DataFrame:
    """CA-13: rehashed blobs, some gone, some changed."""
    blobs, _ = archive.put_blobs(page_blobs(spark, d))
    hurt = blobs.where(~F.startswith("hash", F.lit("1"))).withColumn("data", F.when(F.startswith("hash", F.lit("0")), F.lit("x").cast("binary")).otherwise(F.col("data")))
    return archive.checked_blobs(blobs.select("hash"), hurt)


@query("""WITH R AS (SELECT DISTINCT sha256(coalesce(html, '')) AS h, CASE WHEN page_id % 2 = 0 THEN 'tx_raw' ELSE 'proof' END AS role FROM pages)
    SELECT 'clean' AS "case", 0::BIGINT AS violations UNION ALL SELECT 'corrupt', count(*) FROM R WHERE starts_with(h, '2') UNION ALL SELECT 'removal', count(*) FROM R WHERE role <> 'proof'""")
def chain_role_audit(spark: SparkSession, d: str) -> DataFrame:
    """CA-14/15: roles that uses lack, and role removals that are refused."""
    _, roles = archive.put_blobs(page_blobs(spark, d))
    hurt = roles.where(~F.startswith("blob_hash", F.lit("2")))
    out = counted(archive.missing_roles(roles, roles), "clean").unionByName(counted(archive.missing_roles(roles, hurt), "corrupt"))
    return out.unionByName(counted(archive.blocked_removals(roles, roles), "removal"))


@query(f"""WITH {K}, Q AS (SELECT height, count(*) FILTER (is_canonical OR ord % 5 = 0) AS n FROM K GROUP BY height) SELECT 'clean' AS "case", 0::BIGINT AS violations UNION ALL SELECT 'corrupt', count(*) FILTER (n > 1) FROM Q""")
def chain_one_canonical(spark: SparkSession, d: str) -> DataFrame:
    """CA-16: heights of several canonical blocks."""
    c = chain(spark, d)
    hurt = c.withColumn("is_canonical", F.col("is_canonical") | (F.col("ord") % 5 == 0))
    return counted(archive.several_canonical(c), "clean").unionByName(counted(archive.several_canonical(hurt), "corrupt"))


@query(f"""WITH {K} SELECT 'clean' AS "case", 0::BIGINT AS violations UNION ALL SELECT 'corrupt', count(*) FROM K WHERE (CASE WHEN ord % 5 = 0 THEN 'canonical' ELSE status END = 'canonical') <> is_canonical OR (o_status = 'F' AND NOT is_canonical)""")
def chain_status_audit(spark: SparkSession, d: str) -> DataFrame:
    """CA-17: status and finality against the canonical flag: none on what the archive makes, and seeded ones."""
    c = chain(spark, d)
    hurt = c.withColumns({"status": F.when(F.col("ord") % 5 == 0, "canonical").otherwise(F.col("status")), "finalized": F.col("o_status") == "F"})
    return counted(archive.inconsistent_status(c), "clean").unionByName(counted(archive.inconsistent_status(hurt), "corrupt"))


@query(f"""WITH {B}, R AS (SELECT height // 30 AS h, o_status = 'F' AS f, lag(o_status = 'F') OVER (PARTITION BY height // 30 ORDER BY ord) AS was FROM B) SELECT count(*) FILTER (was AND NOT f) AS violations FROM R""")
def chain_finalized_audit(spark: SparkSession, d: str) -> DataFrame:
    """CA-18: revisions that take back a finalisation."""
    r = fx.blocks(spark, d).select("net", F.floor(F.col("height") / 30).alias("height"), F.lit("b").alias("block_hash"), (F.col("o_status") == "F").alias("finalized"), "ord")
    return archive.unfinalised(r).agg(F.count("*").alias("violations"))


@query(f"""WITH {T} SELECT 'clean' AS "case", 0::BIGINT AS violations UNION ALL SELECT 'corrupt', count(*) FROM T WHERE block_hash IN (SELECT block_hash FROM B WHERE ord % 10 = 0)""")
def chain_fk_audit(spark: SparkSession, d: str) -> DataFrame:
    """CA-19: transactions of blocks that aren't there."""
    t, b = fx.transactions(spark, d), fx.blocks(spark, d)
    return counted(archive.orphan_rows(t, b), "clean").unionByName(counted(archive.orphan_rows(t, b.where("ord % 10 <> 0")), "corrupt"))


@query(f"WITH {B} SELECT net, height // 500 AS bucket, count(*) AS n, min(height) AS low, max(height) AS high FROM B GROUP BY ALL")
def chain_partition_span(spark: SparkSession, d: str) -> DataFrame:
    """CA-20/21: what each bucket spans."""
    return archive.span(fx.blocks(spark, d), 500)


def node_fixture(spark, d):
    """Node and indexer answers made of orders: one regular and one system transaction a block, some wrong."""
    b = fx.blocks(spark, d)
    raw = F.lower(F.hex(F.concat(F.lit("tx"), F.col("ord").cast("string"))))
    sys_raw = F.lower(F.hex(F.concat(F.lit("sys:"), F.col("ord").cast("string"))))
    head = F.struct(F.lit("0x00").alias("parentHash"), F.concat(F.lit("0x"), F.lower(F.hex("ord"))).alias("number"), F.lit("0x01").alias("stateRoot"), F.lit("0x02").alias("extrinsicsRoot"), F.struct(F.array().cast("array<string>").alias("logs")).alias("digest"))
    body = F.when(F.col("ord") % 7 == 0, F.lit("0xffff")).otherwise(F.concat(F.lit("0xaa"), raw, F.lit("bb")))
    node = b.select(F.concat(F.lit("0x"), F.col("block_hash")).alias("hash"), head.alias("header"), F.array(F.lit("0x99"), body).alias("extrinsics"))
    tx = lambda h, r: F.struct(F.sha2(h, 256).alias("hash"), F.lit(1).alias("protocolVersion"), F.concat(F.lit("0x"), r).alias("raw"))
    hash_ = F.when(F.col("ord") % 11 == 0, F.lit("0xdead")).otherwise(F.concat(F.lit("0x"), F.upper("block_hash")))
    return node, b.select(hash_.alias("hash"), F.col("ord").alias("height"), F.array(tx(raw, raw), tx(sys_raw, sys_raw)).alias("transactions"))


@query(f"""WITH {B} SELECT ord AS height, block_hash, sha256('["0x99","' || CASE WHEN ord % 7 = 0 THEN '0xffff' ELSE '0xaa' || lower(hex(encode('tx' || ord::VARCHAR))) || 'bb' END || '"]') AS body_blob_hash,
    sha256('{{"digest":{{"logs":[]}},"extrinsicsRoot":"0x02","number":"0x' || lower(printf('%X', ord)) || '","parentHash":"0x00","stateRoot":"0x01"}}') AS header_blob_hash FROM B""")
def chain_block_records(spark: SparkSession, d: str) -> DataFrame:
    """CA-23/26: block rows from node answers."""
    return archive.block_records(node_fixture(spark, d)[0], fx.NET).select("height", "block_hash", "body_blob_hash", "header_blob_hash")


@query(f"""WITH {B} SELECT ord AS height, 0 AS position, 'regular' AS kind, CASE WHEN ord % 11 = 0 THEN 'hash mismatch' WHEN ord % 7 = 0 THEN 'not in block body' END AS problem FROM B
    UNION ALL SELECT ord, 1, 'system', CASE WHEN ord % 11 = 0 THEN 'hash mismatch' END FROM B""")
def chain_transaction_records(spark: SparkSession, d: str) -> DataFrame:
    """CA-24/27: indexer transactions checked against the node's block bodies."""
    node, indexed = node_fixture(spark, d)
    return archive.transaction_records(archive.block_records(node, fx.NET), indexed, "sys:").select("height", "position", "kind", "problem")


@query(f"WITH {K}, Q AS (SELECT net, height, o_status AS value FROM K WHERE is_canonical) SELECT net, height, value FROM (SELECT *, lag(value) OVER (ORDER BY height) AS b FROM Q) WHERE value IS DISTINCT FROM b")
def chain_param_changes(spark: SparkSession, d: str) -> DataFrame:
    """CA-25: heights where a parameter changes along the canonical chain."""
    return archive.parameter_changes(chain(spark, d).where("is_canonical").select("net", "height", F.col("o_status").alias("value")))


@query(f"""WITH {B} SELECT ord::VARCHAR AS tx_hash, record, section, segment_id, i::BIGINT AS record_index, owner, (ord + plus)::BIGINT AS amount, reference, address AS contract_address FROM B, (VALUES
    ('zswap_output', 'guaranteed', NULL::BIGINT, 0, NULL, NULL::BIGINT, 'c0', 'a0'), ('zswap_output', 'fallible', 2, 0, NULL, NULL, 'c1', NULL), ('zswap_output', 'fallible', 2, 1, NULL, NULL, 'c2', NULL),
    ('zswap_input', 'guaranteed', NULL, 0, NULL, NULL, 'n0', NULL), ('zswap_input', 'fallible', 2, 0, NULL, NULL, 'n1', 'a1'),
    ('unshielded_output', 'guaranteed', 1, 0, 'o', 0, 'i', NULL), ('unshielded_output', 'guaranteed', 1, 1, 'o', 1, 'i', NULL), ('unshielded_output', 'fallible', 1, 2, 'o', 2, 'i', NULL),
    ('dust_spend', NULL, 1, 0, NULL, 5, 'u:v', NULL), ('dust_registration', NULL, 1, 0, 'k', 6, 'd', NULL)) AS X(record, section, segment_id, i, owner, plus, reference, address)""")
def chain_decode(spark: SparkSession, d: str) -> DataFrame:
    """CA-29: the five record lists of decoded transactions; one counter over guaranteed and fallible unshielded outputs."""
    amount = lambda k: "' || string(ord + " + str(k) + ") || '"
    out = lambda k: '{"owner":"o","type":"t","value":' + amount(k) + "}"
    text = (
        '{"guaranteedOffer":{"outputs":[{"commitment":"c0","contractAddress":"a0"}],"inputs":[{"nullifier":"n0"}]},'
        '"fallibleOffer":[[2,{"outputs":[{"commitment":"c1"},{"commitment":"c2"}],"inputs":[{"nullifier":"n1","contractAddress":"a1"}]}]],'
        '"intents":[[1,{"intentHash":"i","guaranteedUnshieldedOffer":{"outputs":[' + out(0) + "," + out(1) + ']},"fallibleUnshieldedOffer":{"outputs":[' + out(2) + "]},"
        '"dustActions":{"spends":[{"vFee":' + amount(5) + ',"oldNullifier":"u","newCommitment":"v"}],"registrations":[{"nightKey":"k","allowFeePayment":' + amount(6) + ',"dustAddress":"d"}]}}]]}'
    )
    txs = fx.blocks(spark, d).select(F.col("ord").cast("string").alias("tx_hash"), F.expr(f"'{text}'").cast("binary").alias("raw"))
    rows = archive.decode_transactions(txs, archive.json_decoder)
    return rows.select("tx_hash", "record", "section", "segment_id", "record_index", "owner", F.col("amount").cast("long").alias("amount"), "reference", "contract_address")


@query(f"WITH {B} SELECT ord, CASE ord % 3 WHEN 0 THEN 'system' WHEN 1 THEN 'standard' END AS kind FROM B")
def chain_tag_kind(spark: SparkSession, d: str) -> DataFrame:
    """CA-30: payloads by their tag."""
    b = fx.blocks(spark, d)
    raw = F.expr("CASE ord % 3 WHEN 0 THEN 'sys:x' WHEN 1 THEN 'std:x' ELSE 'zz' END").cast("binary")
    return b.select("ord", archive.tag_kind(raw, "sys:", "std:").alias("kind"))


@query(f"""WITH RECURSIVE {K}, C AS (SELECT height, block_hash, lag(block_hash) OVER (ORDER BY height) AS parent_hash FROM K WHERE is_canonical),
    U AS (SELECT height, block_hash, parent_hash, 0 AS steps FROM C WHERE height = (SELECT max(height) FROM C) UNION ALL SELECT C.height, C.block_hash, C.parent_hash, U.steps + 1 FROM U JOIN C ON C.block_hash = U.parent_hash WHERE U.steps < 140)
    SELECT height, block_hash, steps FROM U""")
def chain_ancestry(spark: SparkSession, d: str) -> DataFrame:
    """The head and 140 ancestors along parent hashes."""
    c = archive.canonical_chain(fx.blocks(spark, d).select("net", "height", "block_hash"), fx.flips(spark, d))
    c = c.withColumn("parent_hash", F.lag("block_hash").over(Window.partitionBy("net").orderBy("height")))
    heads = c.groupBy("net").agg(F.max_by("block_hash", "height").alias("block_hash"))
    return archive.ancestry(c, heads, 140).select("height", "block_hash", "steps")
