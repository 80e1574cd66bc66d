"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import chat
from shelfwise.llm.collocations import collocations
from shelfwise.llm.common import table
from shelfwise.llm.decontaminate import decontaminate
from shelfwise.llm.html_text import extract_text
from shelfwise.llm.jaccard_join import jaccard_components
from shelfwise.llm.mixing import mix
from shelfwise.llm.pii import find_pii
from shelfwise.llm.quality import quality_rules
from shelfwise.llm.resampling import resample
from shelfwise.llm.secrets import secret_scan
from shelfwise.llm.substring_dedup import remove_repeats
from shelfwise.llm.token_records import read_records, write_records
from shelfwise.llm.toxicity import score_toxicity


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file on this machine; executors hold the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=200).drop("kept")


def op4_chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_tool_calls(chat.messages(table(spark, sf_dir, "conversations")), chat.schemas(spark))


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(write_records(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, target_entropy=0.98, max_epochs=2.0).drop("text")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000, contained_percent=100)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), buckets=10000, percent=25, min_words=20)


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op6_pii: the counts of base spans."""
    return op6_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op7_secrets: the counts of base spans."""
    return op7_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op10_quality_rules: its counts, and the base rule."""
    return op10_quality_rules(spark, sf_dir).drop("longest_repeat", "kept")


def mix_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op9_mix_sources: tokens of each source, and its documents read in the first epoch."""
    first = op9_mix_sources(spark, sf_dir).filter("epoch = 0")
    return first.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"), F.min("mix_pos").alias("first_pos"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_decontaminate": op2_decontaminate,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_chat_tool_calls": op4_chat_tool_calls,
    "op5_token_records": op5_token_records,
    "op6_pii": op6_pii,
    "op7_secrets": op7_secrets,
    "op8_toxicity": op8_toxicity,
    "op9_mix_sources": op9_mix_sources,
    "op10_quality_rules": op10_quality_rules,
    "op11_html_text": op11_html_text,
    "op12_collocations": op12_collocations,
    "op13_importance_resampling": op13_importance_resampling,
}

#: Parts of their results that SQL can express.
PARTS = {
    "pii_base": pii_base,
    "secrets_base": secrets_base,
    "quality_base": quality_base,
    "mix_epochs": mix_epochs,
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(0, greatest(1, len(ws) - 2)), lambda i: array_to_string(ws[i + 1:i + 3], ' '))) AS g
  FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
reach AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT b, c FROM reach JOIN links ON a = doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""

WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
b AS (SELECT item_id, {WORDS} AS ws FROM benchmark),
bg AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n,
    unnest(list_transform(range(0, greatest(1, len(ws) - 9)), lambda i: array_to_string(ws[i + 1:i + 10], ' '))) AS g FROM b WHERE len(ws) > 0),
dg AS (SELECT doc_id, n, i AS pos, array_to_string(ws[i + 1:i + n], ' ') AS g FROM w, (SELECT DISTINCT n FROM bg), unnest(range(0, len(ws) - n + 1)) t(i)),
hit AS (SELECT doc_id, pos, n, item_id FROM dg JOIN bg USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, n_items IS NOT NULL AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

TEXT = "coalesce(text, '')"
DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"

PII_SQL = rf"""
WITH t AS (SELECT doc_id, {TEXT} AS t FROM documents),
m AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS e, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS i,
  regexp_extract_all(t, '[0-9]([ -]?[0-9])+') AS c, regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]') AS p FROM t),
luhn AS (SELECT doc_id, c, k, list_sum(list_transform(range(1, length(d) + 1), lambda j: CASE WHEN j % 2 = 1 THEN CAST(d[j] AS INT) WHEN CAST(d[j] AS INT) > 4 THEN 2 * CAST(d[j] AS INT) - 9 ELSE 2 * CAST(d[j] AS INT) END)) % 10 AS rest
  FROM (SELECT doc_id, m AS c, k, reverse({DIGITS}) AS d FROM (SELECT doc_id, unnest(c) AS m, unnest(range(len(c))) AS k FROM m)) WHERE length(d) BETWEEN 16 AND 19)
SELECT doc_id, len(e) AS n_email, len(list_filter(i, lambda x: list_max(list_transform(string_split(x, '.'), lambda y: CAST(y AS HUGEINT))) <= 255)) AS n_ip,
  (SELECT count(*) FROM luhn WHERE luhn.doc_id = m.doc_id AND rest = 0) AS n_card, len(list_filter(p, lambda m: length({DIGITS}) BETWEEN 8 AND 15)) AS n_phone FROM m
"""

SECRETS_SQL = rf"""
SELECT doc_id, len(list_filter(regexp_extract_all({TEXT}, '(?i:password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6)) AS n_assign,
  len(list_filter(regexp_extract_all({TEXT}, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all({TEXT}, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex FROM documents
"""

QUALITY_SQL = rf"""
WITH t AS (SELECT doc_id, {TEXT} AS t, regexp_extract_all({TEXT}, '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 8], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 7)) AS i FROM t WHERE len(w) >= 8)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM g SEMI JOIN (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1) d USING (doc_id, g)) GROUP BY doc_id)
SELECT t.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(r.n, 0) > 30 * len(w) AS base_failed FROM t LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
"""

MIX_SQL = rf"""
SELECT source, sum(len(regexp_extract_all({TEXT}, '[^\x20\x09-\x0D]+')))::BIGINT AS n_tokens, count(*) AS n_docs, 0.0::DOUBLE AS first_pos FROM documents GROUP BY source
"""

OP12_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
f AS (SELECT lang, k, g, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(0, len(w) - k + 1), lambda i: array_to_string(w[i + 1:i + k], ' '))) AS g FROM w, range(1, 6) t(k) WHERE len(w) >= k) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, g AS phrase, k AS size, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT c.lang, phrase, size, a, k, array_to_string(w[1:k], ' ') AS left_part, array_to_string(w[k + 1:], ' ') AS right_part FROM c, range(1, 5) t(k) WHERE k < size),
s AS (SELECT cut.lang, phrase, a, cut.k, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n // (x.f::HUGEINT * y.f))::BIGINT AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.g = left_part AND x.k = cut.k
  JOIN f y ON y.lang = cut.lang AND y.g = right_part AND y.k = size - cut.k JOIN n ON n.lang = cut.lang),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
b AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest(flatten(list_transform(range(2, size), lambda k: list_transform(range(0, size - k + 1), lambda i: array_to_string(w[i + 1:i + k], ' '))))) AS phrase FROM c) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM m LEFT JOIN b USING (lang, phrase)
WHERE longer IS NULL OR 100 * longer < 100 * a QUALIFY rank <= 2000
"""

OP13_SQL = rf"""
WITH bit AS (SELECT list(c ORDER BY b) AS tab FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) t(b))),
d AS (SELECT row_number() OVER () AS id, doc_id, {WORDS} AS ws FROM documents), q AS (SELECT {WORDS} AS ws FROM benchmark),
f AS (SELECT id, unnest(list_concat(ws, list_transform(range(0, greatest(0, len(ws) - 1)), lambda i: ws[i + 1] || ' ' || ws[i + 2]))) AS f FROM d),
g AS (SELECT unnest(list_concat(ws, list_transform(range(0, greatest(0, len(ws) - 1)), lambda i: ws[i + 1] || ' ' || ws[i + 2]))) AS f FROM q),
b AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1])), 4294967295) % 10000 AS b
  FROM (SELECT f FROM f UNION SELECT f FROM g), bit),
s AS (SELECT b, count(*) AS s FROM f JOIN b USING (f) GROUP BY b), t AS (SELECT b, count(*) AS t FROM g JOIN b USING (f) GROUP BY b),
gain AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS g FROM s FULL JOIN t USING (b)),
w AS (SELECT id, count(*) AS n, sum(g)::HUGEINT AS total FROM f JOIN b USING (f) JOIN gain USING (b) GROUP BY id),
r AS (SELECT d.id, doc_id, len(ws) >= 20 AS long_enough, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END::BIGINT AS weight, ('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, 'null'))[:8])::BIGINT AS h FROM d LEFT JOIN w USING (id)),
x AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY long_enough ORDER BY score DESC, doc_id NULLS LAST) AS k FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN long_enough AND k <= 25 * (SELECT count(*) FROM x WHERE long_enough) // 100 THEN k END AS rank FROM k
"""

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op2_decontaminate": OP2_SQL,
    "op4_chat_tool_calls": chat.ORACLE_SQL,
    "pii_base": PII_SQL,
    "secrets_base": SECRETS_SQL,
    "quality_base": QUALITY_SQL,
    "mix_epochs": MIX_SQL,
    "op12_collocations": OP12_SQL,
    "op13_importance_resampling": OP13_SQL,
}
