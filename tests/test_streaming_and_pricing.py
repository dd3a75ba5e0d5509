"""Stream = batch parity, replay idempotence, pricing calibration and histogram invariants."""
import uuid


from riskframe.operators import portfolio as P
from riskframe.operators import pricing as R
from riskframe.session import scratch_path
from riskframe.sources.fixtures import fixture
from riskframe.streaming import ingest_streams as STR


def test_stream_equals_batch_and_replay_is_idempotent(spark, sf):
    from riskframe.plans.catalog_ingest import q_require_employee
    from riskframe.plans.catalog_io import _employees_pseudo
    src = scratch_path(spark, f"t-src-{uuid.uuid4().hex}")
    payload = fixture(spark, sf, "fx_wearable_payload")
    payload.repartition(3).write.parquet(src)
    out, dl, ck = (scratch_path(spark, f"t-{n}-{uuid.uuid4().hex}") for n in ("out", "dl", "ck"))
    comp, emp = fixture(spark, sf, "fx_companies"), _employees_pseudo(spark, sf)
    STR.stream_wearables(spark, src, payload.schema, comp, emp, out, dl, ck)
    streamed = spark.read.parquet(out).select("event_id", "employee_id")
    batch = q_require_employee(spark, sf)
    assert sorted(streamed.collect()) == sorted(batch.collect())
    # replay with the same checkpoint: nothing new is stored
    STR.stream_wearables(spark, src, payload.schema, comp, emp, out, dl, ck)
    assert spark.read.parquet(out).count() == streamed.count()
    total = payload.count()
    assert streamed.count() + spark.read.parquet(dl).count() == total


def test_band_multipliers_base_is_one(spark, sf):
    b = {r.band: r.multiplier for r in R.band_multipliers(fixture(spark, sf, "fx_quotes")).collect()}
    assert b["4-7L"] == 1.0 and b["15L+"] == 1.0 and set(b) == {"1-3L", "4-7L", "8-15L", "15L+"}


def test_histogram_counts_cover_all_rows(spark):
    df = spark.createDataFrame([("c", float(h)) for h in [0, 4.9, 5, 50, 99.9, 100]], "company_id string, hrs double")
    h = P.hrs_histogram(df).collect()
    assert len(h) == 20 and sum(r.employees for r in h) == 6
    assert [r.employees for r in h if r.bin == 19][0] == 2


def test_market_multiplier_unknowns_are_neutral(spark):
    df = spark.createDataFrame([("Retail", "North", 10.0), ("Nope", None, None)], "i string, r string, s double")
    got = [x[0] for x in df.select(R.market_multiplier("i", "r", "s")).collect()]
    assert abs(got[0] - 1.045 * 1.016 * 1.202) < 1e-12 and got[1] == 1.0


def test_roster_stream_equals_batch_upsert(spark, sf):
    from riskframe.operators import ingest as I
    from riskframe.plans.catalog_io import _employees_pseudo
    src = scratch_path(spark, f"t-rsrc-{uuid.uuid4().hex}")
    payload = fixture(spark, sf, "fx_roster_payload")
    payload.write.parquet(src)
    out, dl, ck = (scratch_path(spark, f"t-r{n}-{uuid.uuid4().hex}") for n in ("out", "dl", "ck"))
    initial = _employees_pseudo(spark, sf)
    STR.stream_roster(spark, src, payload.schema, initial, out, dl, ck)
    streamed = STR.latest_roster(spark, out)
    valid, _ = I.split_valid(I.validate_employee(payload))
    batch = I.upsert_roster(initial, I.normalize_employee(valid, keep=["row_no"]), "employee_id", "row_no")
    cols = initial.columns
    assert sorted(streamed.select(*cols).collect()) == sorted(batch.select(*cols).collect())


def test_clinical_stream_replay_stores_each_event_once(spark, sf):
    from riskframe.plans.catalog_io import _employees_pseudo
    src = scratch_path(spark, f"t-csrc-{uuid.uuid4().hex}")
    payload = fixture(spark, sf, "fx_clinical_payload")
    payload.repartition(2).write.parquet(src)
    out, dl = (scratch_path(spark, f"t-c{n}-{uuid.uuid4().hex}") for n in ("out", "dl"))
    comp, emp = fixture(spark, sf, "fx_companies"), _employees_pseudo(spark, sf)
    STR.stream_clinical(spark, src, payload.schema, comp, emp, out, dl, scratch_path(spark, f"t-cck-{uuid.uuid4().hex}"))
    first = spark.read.parquet(out).count()
    # a second job over the same files with a fresh checkpoint replays every event: nothing is stored twice
    STR.stream_clinical(spark, src, payload.schema, comp, emp, out, dl, scratch_path(spark, f"t-cck2-{uuid.uuid4().hex}"))
    ev = spark.read.parquet(out)
    assert ev.count() == first and ev.select("event_id").distinct().count() == first


def test_roster_stream_fails_when_an_earlier_version_is_missing(spark, sf):
    import pytest
    from riskframe.plans.catalog_io import _employees_pseudo
    payload = fixture(spark, sf, "fx_roster_payload")
    src, out, dl, ck = (scratch_path(spark, f"t-m{n}-{uuid.uuid4().hex}") for n in ("src", "out", "dl", "ck"))
    other = scratch_path(spark, f"t-mother-{uuid.uuid4().hex}")
    payload.limit(5).write.mode("append").parquet(src)
    args = (spark, src, payload.schema, _employees_pseudo(spark, sf))
    STR.stream_roster(*args, out, dl, ck)
    payload.limit(7).write.mode("append").parquet(src)
    with pytest.raises(Exception, match="roster version 0 is missing"):
        STR.stream_roster(*args, other, dl, ck)


def test_clinical_stream_replays_late_and_duplicate_events(spark, sf):
    """Files in several micro-batches: copies across batches are stored once; later runs add new events only."""
    from pyspark.sql import functions as F
    from riskframe.plans.catalog_io import _employees_pseudo
    src, out, dl, ck = (scratch_path(spark, f"t-l{n}-{uuid.uuid4().hex}") for n in ("src", "out", "dl", "ck"))
    payload = fixture(spark, sf, "fx_clinical_payload").limit(300)
    again = payload.withColumn("payload_id", F.col("payload_id") + 10_000_000)
    args = (spark, src, payload.schema, fixture(spark, sf, "fx_companies"), _employees_pseudo(spark, sf), out, dl, ck)
    again.unionByName(payload).repartition(3).write.parquet(src)
    STR.stream_clinical(*args, max_files=1)
    first = spark.read.parquet(out)
    n = first.count()
    assert n == first.select("event_id").distinct().count() > 0
    assert spark.read.parquet(dl).count() + 2 * n >= 600  # every payload is stored, a copy, or a dead letter
    more = payload.withColumn("claim_amount", F.col("claim_amount") * 2).withColumn("payload_id", F.col("payload_id") + 20_000_000)
    again.unionByName(more).coalesce(1).write.mode("append").parquet(src)
    STR.stream_clinical(*args)
    rows = spark.read.parquet(out)
    assert rows.count() == rows.select("event_id").distinct().count() == 2 * n
    assert rows.where("batch_id < 3").count() == n  # earlier batches are as they were


def test_first_seen_expires_state_and_leaves_out_late_rows(spark):
    from pyspark.sql import functions as F
    src, ck = scratch_path(spark, f"t-fs-{uuid.uuid4().hex}"), scratch_path(spark, f"t-fsc-{uuid.uuid4().hex}")
    schema = "id string, n int, ts timestamp, v string"
    got = []

    def step(*rows):
        spark.createDataFrame(rows, "id string, n int, ts string, v string").withColumn("ts", F.to_timestamp("ts")) \
             .coalesce(1).write.mode("append").parquet(src)
        q = STR.first_seen(spark.readStream.schema(schema).parquet(src), "id", "n", "ts", "10 days").writeStream \
               .outputMode("update").option("checkpointLocation", ck).trigger(availableNow=True) \
               .foreachBatch(lambda b, i: got.extend(tuple(r) for r in b.where("_new").select("id", "n", "v").collect())).start()
        q.awaitTermination()
        out = sorted(got)
        got.clear()
        return out
    with STR.disk_state(spark):
        assert step(("a", 2, "2024-01-01", "x"), ("a", 1, "2024-01-01", "y"), ("b", 5, "2024-01-02", "z")) == [("a", 1, "y"), ("b", 5, "z")]
        assert step(("a", 0, "2024-01-01", "w"), ("c", 1, "2024-03-01", "c")) == [("c", 1, "c")]
        assert step(("d", 1, "2024-01-05", "late"), ("c", 9, "2024-03-01", "copy"), ("e", 1, "2024-03-02", "e")) == [("e", 1, "e")]


def test_versioned_table(spark):
    from riskframe.sources.versions import MissingVersion, VersionedTable
    import pytest
    make = lambda *rows: spark.createDataFrame(rows, "k string, a int, b string")
    show = lambda df: sorted(tuple(r) for r in df.collect())
    t = VersionedTable(spark, scratch_path(spark, f"t-v-{uuid.uuid4().hex}"), "k", ("b",), buckets=4)
    with pytest.raises(MissingVersion):
        t.read()
    assert t.commit(make(("p", 1, "x"), ("q", 2, "y"), ("r", 3, None)), "base") == 0
    assert t.commit(make(("p", 10, "new"), ("s", 4, "s")), "one") == 1
    assert t.commit(make(("p", 99, "again")), "one") == 1  # committed before
    v1 = [("p", 10, "x"), ("q", 2, "y"), ("r", 3, None), ("s", 4, "s")]
    assert show(t.read()) == v1 and show(t.read(0)) == [("p", 1, "x"), ("q", 2, "y"), ("r", 3, None)]
    assert t.compact([0, 1]) == 2 and show(t.read()) == v1
    assert t.compact() == 3 and show(t.read()) == v1
    assert t.commit(make(("r", None, "z")), "two") == 4
    assert show(t.read()) == [("p", 10, "x"), ("q", 2, "y"), ("r", None, None), ("s", 4, "s")]
    assert show(t.read(1)) == show(t.read(3)) == v1
    # only the change is written, and dead parts are not read
    assert spark.read.parquet(f"{t.root}/part-two").count() == 1
    assert not any("part-base" in f or "part-one" in f for f in t.read(4).inputFiles())
    log = VersionedTable(spark, scratch_path(spark, f"t-v-{uuid.uuid4().hex}"))
    log.commit(make(("p", 1, "x")), "a")
    log.commit(make(("p", 1, "x")), "b")
    assert show(log.read()) == [("p", 1, "x")] * 2 and show(log.read(0)) == [("p", 1, "x")]
    assert show(VersionedTable(spark, log.root).read()) == [("p", 1, "x")] * 2


def test_roster_stream_writes_changes_only(spark, sf):
    from riskframe.plans.catalog_io import _employees_pseudo
    payload = fixture(spark, sf, "fx_roster_payload")
    src, out, dl, ck = (scratch_path(spark, f"t-w{n}-{uuid.uuid4().hex}") for n in ("src", "out", "dl", "ck"))
    initial = _employees_pseudo(spark, sf)
    args = (spark, src, payload.schema, initial, out, dl, ck)
    payload.limit(5).coalesce(1).write.mode("append").parquet(src)
    STR.stream_roster(*args)
    one = sorted(STR.latest_roster(spark, out).collect(), key=str)
    payload.orderBy("row_no").limit(9).coalesce(1).write.mode("append").parquet(src)
    STR.stream_roster(*args)
    STR.stream_roster(*args)  # nothing new
    table = STR.roster_table(spark, out)
    assert table.versions() == [0, 1, 2]
    assert spark.read.parquet(f"{out}/part-batch-1").count() <= 9 < initial.count()
    assert sorted(STR.latest_roster(spark, out, 1).collect(), key=str) == one
    assert sorted(table.read(0).select(*initial.columns).collect(), key=str) == sorted(initial.collect(), key=str)
