"""Stream jobs against their batch counterparts."""

from pyspark.sql import functions as F

from rentlens.catalog import shared as B
from rentlens.operators import scoring as S
from rentlens.streaming import jobs


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_seen_rows_are_dropped_across_batches(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "source_url string, fetched_at timestamp, property_type string, rent_price_usd string, size_sqm string, bedrooms string, bathrooms string"

    def add(urls, day):
        spark.createDataFrame([(u,) for u in urls], "source_url string").selectExpr(
            "source_url", f"timestamp '2024-01-{day:02d} 00:00:00' as fetched_at", "'villa' as property_type",
            "'$500/month' as rent_price_usd", "'35m²' as size_sqm", "'2' as bedrooms", "'1' as bathrooms",
        ).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        run(jobs.write_table(jobs.ingest_listings(stream), out, mark))

    add(["a", "b", "a"], 1)
    add(["b", "c"], 25)
    add(["a"], 2)  # weeks late: still known
    add(["c", "b", "a"], 28)
    rows = spark.read.parquet(out)
    assert sorted(r["source_url"] for r in rows.collect()) == ["a", "b", "c"]
    assert rows.select("rent_price_usd", "size_sqm", "property_type").distinct().collect() == [(500.0, 35.0, "Villa")]


def test_keys_expire_only_where_a_delay_is_given(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "k string, at timestamp"
    made = {"kept": None, "expired": "7 days"}
    for day, keys in ((1, "ab"), (28, "c"), (28, "d"), (28, "a")):
        spark.createDataFrame([(k,) for k in keys], "k string").selectExpr("k", f"timestamp '2024-01-{day:02d} 00:00:00' as at").coalesce(1).write.mode("append").parquet(source)
        for name, delay in made.items():
            rows = jobs.new_rows(spark.readStream.schema(schema).parquet(source), ["k"], "at", delay)
            run(jobs.write_table(rows, str(tmp_path / name), str(tmp_path / f"{name}-mark")))
    found = {name: sorted(r.k for r in spark.read.parquet(str(tmp_path / name)).collect()) for name in made}
    assert found == {"kept": ["a", "b", "c", "d"], "expired": ["a", "a", "b", "c", "d"]}


def test_state_store_setting_is_put_back(spark, tmp_path):
    before = spark.conf.get(jobs.STATE_STORE)
    spark.range(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    run(jobs.write_table(jobs.new_rows(stream, ["id"]), str(tmp_path / "out"), str(tmp_path / "mark")))
    assert spark.conf.get(jobs.STATE_STORE) == before
    assert any(p.suffix == ".zip" or "changelog" in p.name for p in (tmp_path / "mark").rglob("*"))


def test_stream_scores_equal_batch_scores(spark, small, tmp_path):
    ctx = B.context(spark, small)
    asked = B.requests(spark, small).drop("kind").limit(60)
    source = str(tmp_path / "in")
    asked.write.parquet(source)
    stream = spark.readStream.schema(asked.schema).parquet(source)
    run(jobs.score_stream(stream, B.stand_in, ctx, str(tmp_path / "out"), str(tmp_path / "mark"), cutoff=None))
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    batch = spark.read.parquet(source)
    want = S.respond(S.score_requests(S.attach_market(batch, ctx, cutoff=None), B.stand_in, ctx), ctx)
    pick = lambda df: sorted(df.select("request_id", F.round("predicted_price", 2)).collect())
    assert pick(got) == pick(want) and got.count() == 60
