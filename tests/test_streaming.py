"""Streams over Parquet files, run to their end, against the same computed in one go."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodequery.streaming import streams as S

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events")) + "/t"
    made = [(i, T0 + dt.timedelta(seconds=7 * i), i % 3, f"n{i % 40}") for i in range(120)]
    df = spark.createDataFrame(made, "event_id bigint, ts timestamp, user_id int, nonce string")
    df.coalesce(1).write.parquet(path)
    return df, lambda: spark.readStream.schema(df.schema).parquet(path)


def run(spark, df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name)


def test_nonces(spark, events, tmp_path):
    _, stream = events
    out = run(spark, S.first_of_nonce(stream(), ["user_id", "nonce"], skew="1 hour"), "nonces", "append", tmp_path)
    assert out.count() == 120


def test_windows(spark, events, tmp_path):
    df, stream = events
    out = run(spark, S.tumbling_counts(stream(), "1 minute", ["user_id"]), "tumbling", "complete", tmp_path)
    want = df.groupBy(F.window("ts", "1 minute").start.alias("start"), "user_id").agg(F.count("*").alias("n")).select("start", "user_id", "n")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_sessions(spark, events, tmp_path):
    _, stream = events
    out = run(spark, S.session_counts(stream(), "1 minute", ["user_id"]), "sessions", "complete", tmp_path)
    assert sorted(r["n"] for r in out.collect()) == [40, 40, 40]


def test_rate_limit(spark, events, tmp_path):
    df, stream = events
    out = run(spark, S.rate_limited(stream(), "user_id", 2), "limited", "append", tmp_path)
    from lodequery.operators.folds import sliding_admissions

    want = sliding_admissions(df.withColumn("at", F.unix_millis("ts")), "user_id", "at", 2, ["at", "event_id"])
    assert {(r["event_id"], r["admitted"]) for r in out.collect()} == {(r["event_id"], r["admitted"]) for r in want.collect()}
    assert out.count() == 120


def test_event_time(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 12),)], "ts timestamp_ntz")
    assert S.as_event_time(df).first()["ts"].replace(tzinfo=None).hour in range(24) and dict(S.as_event_time(df).dtypes)["ts"] == "timestamp"


def test_tokens_hold_once(spark, events, tmp_path):
    _, stream = events
    tokens = spark.createDataFrame([(f"n{i}", "d", T0 + dt.timedelta(seconds=100)) for i in range(20)], "token string, digest string, expires_at timestamp")
    uses = stream().withColumn("token", F.col("nonce")).withColumn("digest", F.when(F.col("event_id") == 3, "other").otherwise("d"))
    out = run(spark, S.redeem_once(uses, tokens, late="1 hour"), "tokens", "append", tmp_path)
    assert sorted(r["event_id"] for r in out.collect()) == [i for i in range(15) if i != 3]


def test_subscription(spark, events, tmp_path):
    _, stream = events
    seen = []
    q = S.subscribe(stream(), lambda rows, batch: seen.append((batch, rows.count())), str(tmp_path))
    assert q.awaitTermination(120) and sum(n for _, n in seen) == 120
