"""Every stream against the batch operator, or a plain loop, of the same rule."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from lotlens.operators import state
from lotlens.streaming import health, limits, market, removals, state_table

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, limits.STATE_STORE)
    yield spark
    spark.conf.set(key, before)


def land(spark, path, rows, schema, batches):
    """``rows`` as so many files, in order."""
    size = -(-len(rows) // batches)
    for b in range(batches):
        part = rows[b * size : (b + 1) * size]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return market.read_stream(spark, path, schema)


def run(frame, tmp_path, name="out"):
    out = f"{tmp_path}/{name}"
    query = frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    return frame.sparkSession.read.schema(frame.schema).parquet(out).collect()


def replay(rows, limit, seconds):
    hits, verdicts = {}, {}
    for key, at, seq in rows:
        if at is None:
            verdicts[seq] = False
            continue
        held = [h for h in hits.get(key, []) if h >= at - dt.timedelta(seconds=seconds)]
        verdicts[seq] = len(held) < limit
        hits[key] = held + [at] * verdicts[seq]
    return verdicts


def requests(n):
    rng, at, rows = random.Random(1), 0, []
    for i in range(n):
        at += 200 if i % 100 == 0 else rng.choice([0, 1, 1, 2, 5, 30])
        rows.append((rng.choice(["a", "b", "c", None]), T0 + dt.timedelta(seconds=at), i))
    return rows


_REQUESTS = "key string, at timestamp, seq long"


@pytest.mark.parametrize("limit, seconds", [(1, 60.0), (7, 60.0), (3, 1.5)])
def test_limiter_equals_a_plain_loop(spark, limit, seconds):
    rows = requests(400) + [("a", None, 400), (None, None, 401)]
    table = spark.createDataFrame(rows, _REQUESTS).repartition(5)
    got = limits.allowed(table, limit, seconds).collect()
    assert {r.seq: r.allowed for r in got} == replay(rows, limit, seconds) and len(got) == len(rows)


def test_limiter_stream_equals_batch(rocks, tmp_path):
    rows = requests(300)
    stream = land(rocks, f"{tmp_path}/in", rows, _REQUESTS, 5)
    got = run(limits.limiter_stream(stream, 7), tmp_path)
    assert {r.seq: r.allowed for r in got} == replay(rows, 7, 60.0) and len(got) == len(rows)


_ROWS = "listing_id long, price long, mileage_km long, description string, fingerprint string, posted_at timestamp_ntz, observed_at timestamp_ntz, seq long"
_STATE = "listing_id long, price long, mileage_km long, description string, fingerprint string, status string, first_seen timestamp_ntz, last_seen timestamp_ntz"


def listing_rows(n, keys):
    rng = random.Random(4)
    out = []
    for i in range(n):
        price = rng.choice([100, 110, None])
        out.append((rng.randrange(keys), price, i, "", str(price), None, T0 + dt.timedelta(hours=i), i))
    return out


def folded(spark, rows, batches):
    """The state after folding the same micro-batches without partitions."""
    size = -(-len(rows) // batches)
    held = spark.createDataFrame([], _STATE)
    for b in range(batches):
        batch = market.latest_in_batch(spark.createDataFrame(rows[b * size : (b + 1) * size], _ROWS))
        held = spark.createDataFrame(state.upsert(held, batch).select(*held.columns).collect(), _STATE)
    return sorted(map(tuple, held.collect()))


def table_of(spark, tmp_path, partitions=16):
    schema = spark.createDataFrame([], _STATE).schema
    return state_table.StateTable(spark, f"{tmp_path}/state", schema, partitions=partitions)


def test_partitioned_state_equals_the_batch_fold(spark, tmp_path):
    rows = listing_rows(60, 12)
    table = table_of(spark, tmp_path)
    stream = land(spark, f"{tmp_path}/in", rows, _ROWS, 4)
    assert state_table.upsert_stream(stream, table, f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination(180)
    assert sorted(map(tuple, table.read(4).collect())) == folded(spark, rows, 4)
    assert os.listdir(f"{tmp_path}/state/manifest") and not os.path.exists(f"{tmp_path}/state/manifest/v=2")


def test_a_batch_of_one_key_writes_one_partition(spark, tmp_path):
    table = table_of(spark, tmp_path)
    rows = spark.createDataFrame(listing_rows(200, 100), _ROWS)
    table.update(0, market.latest_in_batch(rows), state.upsert)
    one = spark.createDataFrame([(5, 999, 1, "", "x", None, T0 + dt.timedelta(days=90), 1)], _ROWS)
    before = table.versions(1)
    touched = table.update(1, one, state.upsert)
    assert len(touched) == 1 and len(before) > 10
    written = [d for d in os.listdir(f"{tmp_path}/state/data/v=2") if d.startswith("part=")]
    assert written == [f"part={touched[0]}"]
    assert {p for p, v in table.versions(2).items() if v == 2} == set(touched)
    assert table.read(2).count() == table.read(1).count()
    assert [r.price for r in table.read(2).filter("listing_id = 5").collect()] == [999]
    skipped = spark.createDataFrame([(70_001, None, 1, "", "x", None, T0, 1)], _ROWS)
    table.update(2, skipped, state.upsert)
    assert sorted(map(tuple, table.read(3).collect())) == sorted(map(tuple, table.read(2).collect()))


def test_restart_after_a_failed_batch(spark, tmp_path, monkeypatch):
    rows = listing_rows(60, 12)
    table = table_of(spark, tmp_path)
    stream = land(spark, f"{tmp_path}/in", rows, _ROWS, 3)
    real, calls = state_table.StateTable._forget, []

    def break_once(self, version, kept):  # the second batch fails after its data and manifest are written
        calls.append(version)
        if len(calls) == 2:
            raise RuntimeError("lost")
        real(self, version, kept)

    monkeypatch.setattr(state_table.StateTable, "_forget", break_once)
    with pytest.raises(Exception, match="lost"):
        state_table.upsert_stream(stream, table, f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination(180)
    again = market.read_stream(spark, f"{tmp_path}/in", _ROWS)
    assert state_table.upsert_stream(again, table, f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination(180)
    assert sorted(map(tuple, table.read(3).collect())) == folded(spark, rows, 3)


def test_removal_timers_equal_mark_removed(rocks, tmp_path):
    rng = random.Random(9)
    rows = [(rng.randrange(25), float(rng.randrange(90, 120)), rng.choice([None, 5, 7]), T0 + dt.timedelta(hours=3 * i), i) for i in range(160)]
    schema = "listing_id long, price double, mileage_km long, observed_at timestamp, seq long"
    rows = [r for r in rows if not (r[0] < 6 and r[4] > 60)] + [(99, 1.0, 1, T0 + dt.timedelta(hours=3 * 161), 161), (99, 1.0, 1, T0 + dt.timedelta(hours=3 * 161, seconds=1), 162)]
    stream = land(rocks, f"{tmp_path}/in", rows, schema, 6)
    gone = run(removals.removal_stream(stream), tmp_path)
    last = {}
    for i, price, mileage, at, seq in rows:
        last[i] = (price, mileage, at)
    end = rows[-1][3]
    held = rocks.createDataFrame(
        [(i, p, m, "ACTIVE", at) for i, (p, m, at) in last.items()], "listing_id long, price double, mileage_km long, status string, last_seen timestamp_ntz"
    )
    none = rocks.createDataFrame([], "listing_id long")
    marked = state.mark_removed(held, none, F.lit(end).cast("timestamp_ntz")).filter("removed").collect()
    want = {(r.listing_id, r.price, r.mileage_km, r.last_seen) for r in marked}
    final = {(r.listing_id, r.price, r.mileage_km, r.last_seen) for r in gone if last[r.listing_id][2] == r.last_seen}
    assert final == want and len(want) > 4
    assert all(r.status == "REMOVED" and r.due_at - r.last_seen == dt.timedelta(days=3) for r in gone)


_PAGES = "seq long, failed boolean, price double, make string, model string"


def stopped_at(rows):
    pages = parsed = 0
    held = dict.fromkeys(("price", "make", "model"), 0)
    for n, (_, failed, *values) in enumerate(rows):
        pages, parsed = pages + 1, parsed + (not failed)
        for k, v in zip(held, values):
            held[k] += not failed and v is not None
        if pages >= 25 and (parsed < pages / 2 or parsed and min(held.values()) < 0.6 * parsed):
            return n + 1
    return None


@pytest.mark.parametrize("kind", ["failing", "priceless", "late", "healthy"])
@pytest.mark.parametrize("batches", [1, 7])
def test_stream_stops_where_health_fails(spark, tmp_path, kind, batches):
    rng = random.Random(2)
    good = {"failing": 0.2, "priceless": 0.5, "late": 1.0, "healthy": 0.95}[kind]
    rows = []
    for i in range(90):
        fine = rng.random() < (good if kind != "late" or i < 40 else 0.0)
        rows.append((i, not fine if kind != "priceless" else False, 1.0 if fine else None, "A", "B"))
    end = stopped_at(rows)
    assert (end is None) == (kind == "healthy") and (kind != "failing" or end == 25)
    stream = land(spark, f"{tmp_path}/in", rows, _PAGES, batches)
    listener = health.StopWhenUnhealthy(spark)
    spark.streams.addListener(listener)
    try:
        commit = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/kept/v={n}")
        query = health.guarded_stream(stream, F.col("failed"), commit, f"{tmp_path}/totals", f"{tmp_path}/cp")
        try:
            assert query.awaitTermination(180)
        except Exception as error:  # a batch after the stop had begun
            assert "the run stopped" in str(error)
        kept = sorted(r.seq for r in spark.read.parquet(f"{tmp_path}/kept").collect())
        assert kept == list(range(end or len(rows)))
        again = health.guarded_stream(market.read_stream(spark, f"{tmp_path}/in", _PAGES), F.col("failed"), commit, f"{tmp_path}/totals", f"{tmp_path}/cp")
        try:
            again.awaitTermination(180)
        except Exception as error:
            assert "the run stopped" in str(error)
        assert sorted(r.seq for r in spark.read.parquet(f"{tmp_path}/kept").collect()) == kept
    finally:
        spark.streams.removeListener(listener)


def test_price_changes_arrive_once(spark, tmp_path):
    schema = "listing_id long, change_kind string, seq long"
    rows = [(i % 5, "PRICE_CHANGE" if i % 3 else "FIRST_SEEN", i) for i in range(30)]
    stream = land(spark, f"{tmp_path}/in", rows, schema, 3)
    seen = []
    for _ in range(2):  # the second run finds nothing new
        query = market.price_drop_stream(stream, lambda batch, n: seen.extend(r.seq for r in batch.collect()), f"{tmp_path}/cp")
        assert query.awaitTermination(120)
    assert sorted(seen) == [r[2] for r in rows if r[1] == "PRICE_CHANGE"]


def test_request_counts(spark, tmp_path):
    rows = [("a", T0 + dt.timedelta(seconds=s), s) for s in (0, 5, 61, 300, 301)]
    got = run(market.request_counts(land(spark, f"{tmp_path}/in", rows, _REQUESTS, 5), "0 seconds"), tmp_path)
    counts = {(r.window.start, r.key): r.requests for r in got}
    assert counts[(T0, "a")] == 2 and counts[(T0 + dt.timedelta(seconds=10), "a")] == 1
