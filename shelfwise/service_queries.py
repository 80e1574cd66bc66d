"""Queries of queues, resumed runs, batched calls, the vector index, daily counts and dictionaries, and the SQL of those that it can express."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from shelfwise import plans
from shelfwise.catalog_queries import SCANS, query
from shelfwise.operators import calls, dailies, dictionary, vector_index
from shelfwise.operators.runs import ResumableRun
from shelfwise.sources import read_table
from shelfwise.sources.work import work_folder
from shelfwise.streaming import queue

# A user's events as operations of a queue: errors are sendings that failed, purchases of even ids such that did well.
OPERATIONS = """o AS (SELECT user_id, CASE WHEN event_type = 'error' OR event_type = 'purchase' AND event_id % 2 = 0 THEN 'send' ELSE 'scan' END AS op, event_id AS item, floor(epoch(ts))::BIGINT % 1000 AS tm, event_type = 'purchase' AS ok,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)"""


@query(
    f"""WITH RECURSIVE {OPERATIONS}, s AS (SELECT user_id, 0::BIGINT AS n, CAST([] AS STRUCT(item BIGINT, tm BIGINT, r INT)[]) AS held, CAST([] AS STRUCT(item BIGINT, fate VARCHAR, r INT)[]) AS gone FROM (SELECT DISTINCT user_id FROM o)
      UNION ALL SELECT user_id, n, CASE op
          WHEN 'scan' THEN list_append(CASE WHEN len(held) >= 20 THEN list_filter(held, lambda x: x.item <> oldest) ELSE held END, {{'item': item, 'tm': tm, 'r': 0}})
          ELSE CASE WHEN ok THEN held[6:] ELSE list_concat(list_filter(list_transform(held[1:5], lambda x: {{'item': x.item, 'tm': x.tm, 'r': x.r + 1}}), lambda x: x.r < 3), held[6:]) END END,
        CASE op WHEN 'scan' THEN CASE WHEN len(held) >= 20 THEN list_transform(list_filter(held, lambda x: x.item = oldest), lambda x: {{'item': x.item, 'fate': 'evicted', 'r': x.r}}) ELSE [] END
          ELSE CASE WHEN ok THEN list_transform(held[1:5], lambda x: {{'item': x.item, 'fate': 'sent', 'r': x.r}})
            ELSE list_transform(list_filter(held[1:5], lambda x: x.r >= 2), lambda x: {{'item': x.item, 'fate': 'dropped', 'r': x.r + 1}}) END END
      FROM (SELECT s.user_id, o.n, o.op, o.item, o.tm, o.ok, s.held, held[list_position(list_transform(held, lambda x: x.tm), list_min(list_transform(held, lambda x: x.tm)))].item AS oldest FROM s JOIN o ON o.user_id = s.user_id AND o.n = s.n + 1))
    SELECT queue, g.item AS item, g.fate AS fate, g.r AS retries FROM (SELECT user_id AS queue, unnest(gone) AS g FROM s)
    UNION ALL SELECT queue, h.item, 'pending', h.r FROM (SELECT user_id AS queue, unnest(held) AS h FROM s SEMI JOIN (SELECT user_id, max(n) AS n FROM o GROUP BY ALL) USING (user_id, n))"""
)
def queue_fates(spark, d):
    send = F.expr("event_type = 'error' or event_type = 'purchase' and event_id % 2 = 0")
    at = F.unix_timestamp(F.col("ts").cast("timestamp")) % 1000
    o = read_table(spark, d, "events").select(
        F.col("user_id").alias("queue"), F.col("event_id").alias("seq"), F.when(send, "send").otherwise("scan").alias("op"), F.col("event_id").alias("item"), at.alias("at"), (F.col("event_type") == "purchase").alias("ok")
    )
    return queue.fates(o, queue.Rules(cap=20, batch=5, tries=3)).drop("seq")


@query("SELECT p_partkey AS ean, upper(p_name) AS label, CASE WHEN p_partkey % 97 = 0 THEN 'no_data' END AS error FROM part")
def run_resumed(spark, d):
    """A run over all products that is broken off after three of eight batches and then started again."""
    items = plans.products(spark, d).select("ean", "name")
    enrich = lambda batch: batch.select("ean", F.upper("name").alias("label"), F.when(F.col("ean") % 97 == 0, "no_data").alias("error"))
    folder = work_folder(spark, "run")
    ResumableRun(spark, folder, 8).start(items, "ean", enrich, most=3)
    again = ResumableRun(spark, folder, 8)
    again.start(items, "ean", enrich)
    return again.rows()


def _digests(texts: list[str]) -> list[tuple[int, str]]:
    """A service that answers in reverse order."""
    return [(i, hashlib.md5(t.encode()).hexdigest()) for i, t in enumerate(texts)][::-1]


@query("SELECT doc_id, md5(text) AS result, CAST(NULL AS VARCHAR) AS error FROM documents")
def batched_calls(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return calls.call_in_batches(docs, "text", _digests, StringType(), size=100).select("doc_id", "result", "error")


@query()
def ivf_nearest(spark, d):
    """The ten nearest of every vector whose id 50 divides, by the index; its recall is measured in tests."""
    vectors = read_table(spark, d, "embeddings").select("vec_id", "embedding")
    folder = work_folder(spark, "index")
    vector_index.VectorIndex.build(vectors).write(folder)
    index = vector_index.VectorIndex.read(spark, folder)
    asked = vectors.filter("vec_id % 50 = 0")
    return index.search(asked, 10, index.probes_for(asked, 10)).withColumn("similarity", F.round("similarity", 6))


# Periods that end at several dates; the third ends where the other queries' do.
PERIODS = [("2024-01-10", 7), ("2024-01-20", 30), ("2024-01-31", 7), ("2024-01-31", 30)]


def _dailies(spark, d) -> dailies.Dailies:
    """Counts by day, fed in three batches, of which the third brings late events of all days; the second comes twice."""
    kept = dailies.Dailies(spark, work_folder(spark, "dailies"))
    scans = plans.scans(spark, d).withColumn("scanned_at", F.col("scanned_at").cast("timestamp_ntz"))
    for batch in (0, 1, 1, 2):
        kept.add(scans.filter(F.col("event_id") % 3 == batch), batch)
    kept.compact(1)
    return kept


@query(
    f"""WITH {SCANS}, p AS (SELECT unnest([DATE '2024-01-10', DATE '2024-01-20', DATE '2024-01-31', DATE '2024-01-31']) AS as_of, unnest([7, 30, 7, 30]) AS days)
    SELECT as_of, days, store_id, count(*) AS scans, count(DISTINCT ean) AS products, count(*) FILTER (status <> 'error') AS found FROM scans JOIN p ON scanned_at >= as_of - to_days(days) GROUP BY ALL"""
)
def store_metrics_by_day(spark, d):
    return dailies.metrics(_dailies(spark, d).days(), PERIODS)


@query(
    f"""WITH {SCANS}, c AS (SELECT as_of, days, ean, count(*) AS scan_count FROM scans JOIN (SELECT unnest([DATE '2024-01-10', DATE '2024-01-20', DATE '2024-01-31', DATE '2024-01-31']) AS as_of, unnest([7, 30, 7, 30]) AS days) p
      ON scanned_at >= as_of - to_days(days) GROUP BY ALL)
    SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY as_of, days ORDER BY scan_count DESC, ean) <= 10"""
)
def top_scanned_by_day(spark, d):
    counts = dailies.in_periods(_dailies(spark, d).days(), PERIODS).groupBy("as_of", "days", "ean").agg(F.sum("scans").alias("scan_count"))
    place = Window.partitionBy("as_of", "days").orderBy(F.desc("scan_count"), "ean")
    return counts.withColumn("place", F.row_number().over(place)).filter("place <= 10").drop("place")


@query(
    r"""WITH t AS (SELECT DISTINCT item_id % 7 AS tag, lower(w) AS term FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]{3,}')) AS w FROM benchmark)),
    f AS (SELECT doc_id, tag, term, instr(lower(text), term) - 1 AS at_ FROM documents JOIN t ON contains(lower(text), term))
    SELECT d.doc_id, count(f.term) AS n_found, count(DISTINCT tag) AS n_tags, coalesce(sum(at_), 0)::BIGINT AS places FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id"""
)
def terms_found(spark, d):
    """The words of all benchmark items, as a dictionary with tags, in all documents."""
    words = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), 0))
    terms = read_table(spark, d, "benchmark").select((F.col("item_id") % 7).alias("tag"), words.alias("term"))
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    found = dictionary.find_terms(docs, "text", terms)
    places = F.aggregate("found", F.lit(0).cast("long"), lambda s, x: s + x["at"])
    return found.select("doc_id", F.size("found").cast("long").alias("n_found"), F.size(F.array_distinct(F.transform("found", lambda x: x["tag"]))).cast("long").alias("n_tags"), places.alias("places"))
