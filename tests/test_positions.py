import datetime
import random

import pytest
from pyspark.sql import functions as F

from tracewell import engine
from tracewell.operators import positions as P
from tracewell.operators.timeline import with_seq
from tracewell.sources.parsers import parse


def rows(rng, ids, days):
    return [(i, datetime.datetime(2024, 1, rng.choice(days), rng.randint(0, 3)) if rng.random() > 0.1 else None) for i in ids]


def pairs(df):
    return sorted(map(tuple, df.select("id", "seq").collect()))


def test_positions_equal_a_rebuild_after_each_append(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "RANGE_ROWS", 50)
    rng, kept, held = random.Random(2), P.Positions(spark, f"file://{tmp_path}/p"), []
    assert kept.generation() == 0 and kept.top() is None
    # wide, one hot moment, before all others, after all others without a time
    hot = [(i, datetime.datetime(2024, 1, 9)) for i in range(1000, 1300)]
    for batch in (rows(rng, range(400), range(5, 25)), rows(rng, range(400, 700), range(9, 12)), hot, rows(rng, range(2000, 2020), [1]), [(i, None) for i in range(3000, 3200)], []):
        kept.add(spark.createDataFrame(batch, "id long, ts timestamp_ntz"))
        held += batch
        assert pairs(kept.seq()) == pairs(with_seq(spark.createDataFrame(held, "id long, ts timestamp_ntz")))
    sizes = [r["n"] for r in kept.ranges().collect()]
    assert sum(sizes) == len(held) and max(sizes) <= 150 and kept.generation() == 5 and kept.top() == 3199
    before = len(list((tmp_path / "p" / "rows").glob("gen=*/number=*")))
    kept.vacuum()
    assert len(list((tmp_path / "p" / "rows").glob("gen=*/number=*"))) == len(sizes) < before
    assert pairs(kept.seq()) == pairs(with_seq(spark.createDataFrame(held, "id long, ts timestamp_ntz")))


def test_an_append_writes_only_the_ranges_it_falls_into(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "RANGE_ROWS", 100)
    kept = P.Positions(spark, f"file://{tmp_path}/p")
    day = F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    at = spark.range(2000).select("id", (day + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"))
    kept.add(at)
    first = {r["number"] for r in kept.ranges().collect()}
    kept.add(spark.range(5000, 5003).select("id", (day + F.make_dt_interval(mins=F.lit(777))).alias("ts")))
    stay = {r["number"] for r in kept.ranges().collect()} & first
    written = spark.read.parquet(f"file://{tmp_path}/p/rows/gen=2").count()
    assert len(first) - len(stay) == 1 and written < 300
    assert dict(pairs(kept.seq()))[5002] == 781 and dict(pairs(kept.seq()))[1999] == 2003


def test_an_append_that_broke_off_is_replaced(spark, tmp_path):
    kept = P.Positions(spark, f"file://{tmp_path}/p")
    ts = F.lit("2024-01-01").cast("timestamp_ntz").alias("ts")
    kept.add(spark.range(10).select("id", ts))
    kept.add(spark.range(10, 20).select("id", ts))
    (tmp_path / "p" / "ranges" / "gen=2" / "_SUCCESS").unlink()  # all but the last step of the second append
    assert kept.generation() == 1 and pairs(kept.seq()) == [(i, i + 1) for i in range(10)]
    kept.add(spark.range(10, 15).select("id", ts))
    assert pairs(kept.seq()) == [(i, i + 1) for i in range(15)]


def test_a_case_grows(spark, tmp_path):
    def found(name, n, start):
        text = spark.range(n, numPartitions=2).select(F.format_string("2024-01-%02dT00:00:%02dZ h p: m", F.lit(start), F.col("id") % 60).alias("line"), (F.col("id") + 1).cast("int").alias("line_no"), F.lit(name).alias("src_file"), F.lit(2024).alias("file_year"))
        return parse(text, "syslog")

    path = f"file://{tmp_path}/case"
    engine.Case(engine.numbered(found("b", 50, 5))).save(path)
    old = {(r["src_file"], r["line_no"]): r["id"] for r in engine.Case.open(spark, path).events.collect()}
    for name, start in (("a", 3), ("c", 5), ("d", 9)):
        engine.Case.append(spark, path, found(name, 40, start))
    # events that were written without positions are taken in by the next append
    engine.Case(engine.numbered(found("e", 5, 1)).withColumn("id", F.col("id") + 170), False).save(path, "append")
    engine.Case.append(spark, path, found("e", 5, 1).limit(0))
    case = engine.Case.open(spark, path)
    ids = {(r["src_file"], r["line_no"]): r["id"] for r in case.events.collect()}
    assert sorted(ids.values()) == list(range(175)) and all(ids[k] == v for k, v in old.items())
    assert pairs(case.events) == pairs(with_seq(case.events.drop("seq")))
    at = dict(pairs(case.events))[0]
    assert [r["seq"] for r in case.context(0, 2, 2).collect()] == list(range(at - 2, at + 3))
    assert engine.Case.saved(spark, f"file://{tmp_path}") == ["case"]


@pytest.mark.parametrize("flag", [[], ["--append"]])
def test_shell_option(flag):
    from tracewell.__main__ import options

    assert options().parse_args(["ingest", "x", "--case", "c", *flag]).append == bool(flag)


def test_context_around_anchors_without_or_with_repeated_ids(spark, tmp_path):
    """Every sign-up is an anchor and nothing else is, whatever its id."""
    import duckdb

    from tracewell.plans import catalogue

    rows = [(None, "00:10:00", "signup"), (1, "00:12:00", "signup"), (1, "03:00:00", "click"), (2, "03:01:00", "view"), (3, "00:20:00", "signup"), (3, "00:20:00", "signup"), (4, None, "signup"), (5, "00:00:00", "view")]
    df = spark.createDataFrame([(i, t and f"2024-01-01 {t}", 7, e, 1.0, '{"k": 1}') for i, t, e in rows], "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * REPLACE (CAST(props AS JSON) AS props) FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(catalogue.ORACLE_SQL["context_time"]).fetchall()
    got = [tuple(r) for r in catalogue.QUERIES["context_time"](spark, str(tmp_path)).collect()]
    assert len(want) == 17 and sorted(got, key=str) == sorted(want, key=str)
