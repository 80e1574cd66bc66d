import gzip
import json

from shelfwise import sources, streaming


def test_jsonl_skips_malformed(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"code":"1","n":2}\nnot json\n{"code":"2"}\n')
    df = sources.read_jsonl(spark, str(tmp_path / "a.jsonl.gz"), "code string, n int", 3)
    assert sorted(tuple(r) for r in df.collect()) == [("1", 2), ("2", None)]


def test_envelope_codes_prices_markdown(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"products": [{"ean": "1"}, {"ean": "2"}]}))
    assert sources.read_envelope(spark, str(tmp_path / "p.json"), "products", "ean:string").count() == 2
    (tmp_path / "c.txt").write_text("# list\n 123 \n\n456\n")
    assert [r[0] for r in sources.read_codes(spark, str(tmp_path / "c.txt")).collect()] == ["123", "456"]
    (tmp_path / "v.csv").write_text("ean,price,shelf\n1,10,A\n")
    assert sources.read_prices(spark, str(tmp_path / "v.csv")).first()["price"] == 10
    (tmp_path / "docs" / "a").mkdir(parents=True)
    (tmp_path / "docs" / "a" / "x.md").write_text("# T\nbody")
    assert sources.read_markdown(spark, str(tmp_path / "docs")).first()["content"] == "# T\nbody"


def test_spec_map_last_wins(spark):
    df = spark.createDataFrame([("<dt>a</dt><dd>1</dd><dt class=x>b</dt> <dd>2</dd><dt>a</dt><dd>3</dd>",), ("",)], "h string")
    assert [r[0] for r in df.select(sources.spec_map("h")).collect()] == [{"b": "2", "a": "3"}, {}]


def test_flush_appends_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text("".join(json.dumps({"event_id": i * 10 + j, "store_id": 1, "ean": j, "created_at": "2024-01-01T00:00:00Z", "retries": j}) + "\n" for j in range(4)))
    q = streaming.flush(streaming.queued_scans(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 9 and got.filter("scanned_at is null").count() == 0  # three retries drop a scan
    assert got.select("batch").distinct().count() == 3


def test_rate_limit_edges(spark):
    at = [0.0, 60.0, 60.001, 61.0]
    df = spark.createDataFrame([(i, "k", t, 1) for i, t in enumerate(at)] + [(9, "other", 5.0, 1)], "request_id long, key string, at double, max_requests int")
    assert dict(tuple(r) for r in streaming.rate_limit(df).collect()) == {0: True, 1: False, 2: True, 3: False, 9: True}


def test_rate_limit_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, t in enumerate([0.0, 10.0, 100.0]):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"request_id": i, "key": "k", "at": t, "max_requests": 1}))
    s = spark.readStream.schema("request_id long, key string, at double, max_requests int").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = streaming.rate_limit_stream(s).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = dict(tuple(r) for r in spark.table("limited").collect())
    assert sorted(got) == [0, 1, 2] and sum(got.values()) == 2
