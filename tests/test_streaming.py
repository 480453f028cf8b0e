"""The ledger stream: equal to the batch ledger over the same calls, and exact
after a crash inside a micro-batch (replay from the checkpoint)."""

import datetime as dt
import random
import threading
from decimal import Decimal

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from larder import schemas as S
from larder.operators import ledger as L
from larder.session import scratch_path
from larder.sources import tables
from larder.streaming import ledger_stream as ST

NOW = dt.datetime(2024, 1, 15, 10, 0)
CUTS = ((0, 200), (200, 400), (400, 600))


def data(spark):
    rnd = random.Random(5)
    created = dt.datetime(2024, 1, 1)
    inv = spark.createDataFrame([(i, f"I{i}", Decimal(rnd.randint(0, 40)), "KG", None, None, "FRUTTA", "FRIGO",
                                  None, None, None, created, created, "system") for i in range(1, 11)], S.INVENTORY)
    rows = [(s, "u", rnd.randint(1, 11), Decimal(rnd.randint(1, 9)), None, None, rnd.random() < 0.15)
            for s in range(1, 601)]
    return inv, spark.createDataFrame(rows, S.CONSUME_CMD)


def balances(outcomes):
    return sorted(tuple(r) for r in L.ledger_balances(outcomes).collect())


def run_waves(spark, inv, cmds, crash=None, compact_every=ST.COMPACT_EVERY):
    """Write the calls in three waves and run the stream after each; ``crash``
    (``before`` or ``partial``) makes the second micro-batch fail once, after which
    the stream is restarted from its checkpoint."""
    base = scratch_path(spark, "test-stream")
    src, out, ckpt = f"{base}/source", f"{base}/ledger", f"{base}/checkpoint"
    fn = ST.ledger_batch(inv, cmds.schema, out, compact_every=compact_every)
    crashed = []

    def crashing(batch, batch_id):
        if batch_id == 1 and not crashed:
            crashed.append(batch_id)
            if crash == "partial":
                fn(batch, batch_id)
                # a half-written delta (and snapshot, when one is due): every balance wrong
                wrong = inv.select("item_id", F.lit(Decimal("999.000")).cast(S.QTY).alias("quantity"))
                wrong.write.mode("overwrite").parquet(f"{out}/delta/batch_id=1")
                if batch_id % compact_every == 0:
                    wrong.write.mode("overwrite").parquet(f"{out}/snapshot/batch_id=1")
            raise RuntimeError("executor lost")
        fn(batch, batch_id)

    for lo, hi in CUTS:
        cmds.filter((F.col("seq") > lo) & (F.col("seq") <= hi)).write.mode("append").parquet(src)
        q = ST.ledger_stream(spark, inv, src, cmds.schema, out, ckpt, batch_fn=crashing if crash else fn)
        if crash and lo == 200:
            with pytest.raises(StreamingQueryException):
                q.awaitTermination()
            q = ST.ledger_stream(spark, inv, src, cmds.schema, out, ckpt, batch_fn=fn)
        q.awaitTermination()
    return ST.read_outcomes(spark, out), ST.stream_balances(spark, inv, out)


def table(df):
    return sorted((r.item_id, r.quantity) for r in df.select("item_id", "quantity").collect())


@pytest.mark.parametrize("compact_every", [1, 2, 50])
def test_stream_equals_batch_ledger(spark, compact_every):
    inv, cmds = data(spark)
    streamed, bal = run_waves(spark, inv, cmds, compact_every=compact_every)
    batch = L.consume(inv, cmds, NOW)
    assert streamed.count() == 600
    assert balances(streamed) == balances(batch.outcomes)
    assert table(bal) == table(batch.table)


@pytest.mark.parametrize("crash,compact_every", [("before", 50), ("partial", 50), ("partial", 1), ("partial", 2)])
def test_stream_replays_a_crashed_batch_exactly(spark, crash, compact_every):
    inv, cmds = data(spark)
    streamed, bal = run_waves(spark, inv, cmds, crash=crash, compact_every=compact_every)
    batch = L.consume(inv, cmds, NOW)
    assert streamed.count() == 600
    assert streamed.select("seq").distinct().count() == 600
    assert balances(streamed) == balances(batch.outcomes)
    assert table(bal) == table(batch.table)


@pytest.mark.parametrize("crash", [None, "before", "partial"])
def test_stream_facts_and_audit_rows(spark, crash):
    """The rows of the batch ledger, ids without gaps across micro-batches, also after a
    micro-batch is replayed."""
    inv, cmds = data(spark)
    facts = spark.createDataFrame([(41, 1, Decimal(1), NOW, "CONSUMATO", None)], S.CONSUMPTION)
    log = spark.createDataFrame([(17, "X", "t", 1, "{}", "a", NOW)], S.AUDIT_LOG)
    base = scratch_path(spark, "test-rows")
    src, out, ckpt = f"{base}/source", f"{base}/ledger", f"{base}/checkpoint"
    fn = ST.ledger_batch(inv, cmds.schema, out, rows=ST.AcceptedRows(facts, log, NOW, ("seq",)))
    crashed = []

    def crashing(batch, batch_id):
        if batch_id == 1 and not crashed:
            crashed.append(batch_id)
            if crash == "partial":
                fn(batch, batch_id)
                # half-written ids and facts of the batch
                spark.createDataFrame([(999, 999)], "fact long, log long").write.mode("overwrite").parquet(f"{out}/ids/batch_id=1")
                tables.append_facts(facts, out, "consumption", "1")
            raise RuntimeError("executor lost")
        fn(batch, batch_id)

    for lo, hi in CUTS:
        cmds.filter((F.col("seq") > lo) & (F.col("seq") <= hi)).write.mode("append").parquet(src)
        q = ST.ledger_stream(spark, inv, src, cmds.schema, out, ckpt, batch_fn=crashing if crash else fn)
        if crash and lo == 200:
            with pytest.raises(StreamingQueryException):
                q.awaitTermination()
            q = ST.ledger_stream(spark, inv, src, cmds.schema, out, ckpt, batch_fn=fn)
        q.awaitTermination()
    want = L.consume(inv, cmds, NOW)
    listed = lambda df: sorted(tuple(r) for r in df.collect())
    got = tables.read(spark, out, "consumption")
    n = got.count()
    assert sorted(r.consumption_id for r in got.collect()) == list(range(42, 42 + n))
    assert listed(got.drop("consumption_id")) == listed(want.facts.drop("consumption_id"))
    # inside and across micro-batches ids follow the call order
    by_call = want.facts.orderBy("consumption_id").drop("consumption_id").collect()
    assert [tuple(r) for r in got.orderBy("consumption_id").drop("consumption_id").collect()] == [tuple(r) for r in by_call]
    rows = tables.read(spark, out, "audit_log")
    assert sorted(r.log_id for r in rows.collect()) == list(range(18, 18 + n))
    assert listed(rows.drop("log_id")) == listed(want.audit.drop("seq"))


def _stream_once(spark, inv, cmds):
    """One micro-batch of the stream with facts and audit rows; its folder."""
    facts, log = spark.createDataFrame([], S.CONSUMPTION), spark.createDataFrame([], S.AUDIT_LOG)
    base = scratch_path(spark, "test-once")
    cmds.write.parquet(f"{base}/source")
    ST.ledger_stream(spark, inv, f"{base}/source", cmds.schema, f"{base}/ledger", f"{base}/checkpoint",
                     rows=ST.AcceptedRows(facts, log, NOW, ("seq",))).awaitTermination()
    return f"{base}/ledger"


def test_stream_counts_a_batch_once(spark, monkeypatch):
    """The items of a micro-batch and the requests of each come from one pass over its calls."""
    inv, cmds = data(spark)
    asked, real = [], L.requests_per_item
    monkeypatch.setattr(L, "requests_per_item", lambda checked: asked.append(1) or real(checked))
    out = _stream_once(spark, inv, cmds)
    assert len(asked) == 1
    assert balances(ST.read_outcomes(spark, out)) == balances(L.consume(inv, cmds, NOW).outcomes)


def test_stream_writes_facts_and_audit_side_by_side(spark, monkeypatch):
    """Neither table waits for the other one; a failed write still fails the batch."""
    inv, cmds = data(spark)
    both, real = threading.Barrier(2, timeout=120), tables.append_facts

    def meeting(*args):
        both.wait()
        real(*args)

    monkeypatch.setattr(tables, "append_facts", meeting)
    out = _stream_once(spark, inv, cmds)
    want = L.consume(inv, cmds, NOW)
    assert tables.read(spark, out, "consumption").count() == tables.read(spark, out, "audit_log").count() == want.facts.count()

    def failing(df, root, name, *more):
        if name == "audit_log":
            raise RuntimeError("disk full")
        real(df, root, name, *more)

    monkeypatch.setattr(tables, "append_facts", failing)
    with pytest.raises(StreamingQueryException):
        _stream_once(spark, inv, cmds)


def test_stream_numbers_calls_as_stored(spark, monkeypatch):
    """Accepted calls go through the passes that number them as the outcomes folder holds
    them; their balances become decimals once, in the rows that need them."""
    inv, cmds = data(spark)
    seen, real = [], ST.numbered

    def watched(df, order):
        seen.append(dict(df.dtypes))
        return real(df, order)

    monkeypatch.setattr(ST, "numbered", watched)
    out = _stream_once(spark, inv, cmds)
    assert [d["balance_before_k"] for d in seen] == [d["balance_after_k"] for d in seen] == ["bigint"]
    listed = lambda df: sorted(tuple(r) for r in df.collect())
    want = L.consume(inv, cmds, NOW)
    assert listed(tables.read(spark, out, "audit_log").drop("log_id")) == listed(want.audit.drop("seq"))
    assert listed(tables.read(spark, out, "consumption").drop("consumption_id")) == listed(want.facts.drop("consumption_id"))


def test_append_sink_takes_a_replayed_batch_once(spark):
    """A micro-batch whose commit is lost runs again: the sink has its rows already."""
    import os
    rows = [(i, f"OP{i % 3}", "t", i, "{}", "a", dt.datetime(2024, 1, 1 + i % 5)) for i in range(60)]
    base = scratch_path(spark, "test-sink").removeprefix("file:")
    src, sink, ckpt = f"{base}/source", f"{base}/audit_log", f"{base}/checkpoint"
    for lo in (0, 30):
        spark.createDataFrame(rows[lo:lo + 30], S.AUDIT_LOG).write.mode("append").parquet(src)
        ST.audit_sink_stream(spark, src, S.AUDIT_LOG, sink, ckpt).awaitTermination()
    assert sorted(d for d in os.listdir(sink) if d.startswith("day=")) == [f"day=2024-01-0{k}" for k in range(1, 6)]
    os.rename(f"{ckpt}/commits/1", f"{ckpt}/lost-commit")
    if os.path.exists(f"{ckpt}/commits/.1.crc"):
        os.rename(f"{ckpt}/commits/.1.crc", f"{ckpt}/lost-crc")
    ST.audit_sink_stream(spark, src, S.AUDIT_LOG, sink, ckpt).awaitTermination()
    assert os.path.exists(f"{ckpt}/commits/1")
    assert sorted(r.log_id for r in tables.read(spark, base, "audit_log").collect()) == list(range(60))
    ST.audit_count_stream(spark, sink, S.AUDIT_LOG, f"{base}/counts", f"{base}/counts-checkpoint").awaitTermination()
    assert {r.op_type: r.operations for r in ST.read_audit_counts(spark, f"{base}/counts").collect()} == {f"OP{k}": 20 for k in range(3)}


def test_batch_with_no_accepted_call(spark):
    """A micro-batch whose calls are all refused writes an empty delta; later
    batches still read the log (compaction due or not)."""
    inv, cmds = data(spark)
    refused = cmds.withColumn("qty", F.when((F.col("seq") > 200) & (F.col("seq") <= 400), F.lit(Decimal("0")))
                              .otherwise(F.col("qty")).cast(S.QTY))
    for k in (2, 50):
        streamed, bal = run_waves(spark, inv, refused, compact_every=k)
        batch = L.consume(inv, refused, NOW)
        assert balances(streamed) == balances(batch.outcomes)
        assert table(bal) == table(batch.table)
