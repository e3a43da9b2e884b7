"""The thin queries over the driver tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, exact_dedup, importance, line_dedup, lm, minhash, prefix_join, spelling, substring_dedup, toxicity, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_held_out(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "end_word", "edits", F.round("similarity", 6).alias("similarity"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(chat.format_turns(rows.unionByName(more)))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coder = bpe.default_tokenizer(spark)
    out = coder.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = F.col("ids")
    return out.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(coder.id_bytes(ids), 256).alias("ids_sha256"), F.sha2(coder.decode(ids), 256).alias("decoded_sha256"))


def op11_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_join.similar_groups(table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: crc32 of a text's UTF-8 bytes: the table of the reflected polynomial by rule, then a fold over the bytes.
CRC = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS crc_table)"


def crc32_sql(text: str) -> str:
    """SQL for the crc32 of a text column, beside the table expression CRC."""
    octets = f"list_transform(range(1, 2 * strlen({text}), 2), lambda i: ('0x' || substr(hex(encode({text})), i, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, crc_table[xor(c & 255, b) + 1]), 4294967295), 4294967295)"

SQL = {
    "op4_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT *, translate(trim(line, {WS}), {LOWER}) AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.*, c.top IS NOT NULL AND k.doc_id <> c.top AS lost FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op5_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)""",
    "op6_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT doc_id, generate_subscripts(words, 1) AS pos, unnest(words) AS word, words FROM d),
s AS (SELECT doc_id, pos, word, CASE WHEN pos + 19 <= len(words) THEN array_to_string(words[pos:pos + 19], ' ') END AS win FROM w),
r AS (SELECT *, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1 AS again FROM s),
c AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS 19 PRECEDING) AS gone FROM r)
SELECT d.doc_id, count(c.pos) AS n_words, count(c.pos) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id""",
    "op7_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, strlen(body) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, (k // 4)::INT * 5 + 1, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f""",
    "op8_minhash": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {LOWER}), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT min(doc_id) AS node, w FROM d GROUP BY w),
s AS (SELECT DISTINCT node, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM n WHERE len(w) > 0),
z AS (SELECT node, count(*) AS k FROM s GROUP BY node),
e AS (SELECT p.a, p.b FROM (SELECT x.node AS a, y.node AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.node <> y.node GROUP BY ALL) p
  JOIN z za ON za.node = a JOIN z zb ON zb.node = b WHERE c >= 0.8 * (za.k + zb.k - c)),
r AS (SELECT node, node AS seen FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
l AS (SELECT node, min(seen) AS label FROM r GROUP BY node),
m AS (SELECT doc_id, label FROM d JOIN n USING (w) JOIN l USING (node))
SELECT doc_id, min(doc_id) OVER (PARTITION BY label) AS class_id, count(*) OVER (PARTITION BY label) AS class_size,
  doc_id = min(doc_id) OVER (PARTITION BY label) AS kept FROM m""",
    "op9_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(text) + length(role) + 23 + length(regexp_replace(text, '[^\\<\[]', '', 'g')) + length(regexp_replace(role, '[^\\<\[\]]', '', 'g')) AS size,
  CASE WHEN role = 'assistant' THEN text ELSE '' END AS learnt FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(length(learnt))::BIGINT AS loss_chars, sha256(string_agg(learnt, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op11_ngram_jaccard": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {LOWER}), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT min(doc_id) AS node, w FROM d GROUP BY w),
s AS (SELECT DISTINCT node, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM n WHERE len(w) > 0),
z AS (SELECT node, count(*) AS k FROM s GROUP BY node),
e AS (SELECT p.a, p.b FROM (SELECT x.node AS a, y.node AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.node <> y.node GROUP BY ALL) p
  JOIN z za ON za.node = a JOIN z zb ON zb.node = b WHERE 100 * c >= 85 * (za.k + zb.k - c)),
r AS (SELECT node, node AS seen FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
l AS (SELECT node, min(seen) AS label FROM r GROUP BY node),
m AS (SELECT doc_id, coalesce(k, 0) AS n_shingles, label FROM d JOIN n USING (w) JOIN l USING (node) LEFT JOIN z USING (node))
SELECT doc_id, n_shingles, CASE WHEN n_shingles = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY label) END AS component_id FROM m""",
    "op12_importance": rf"""
WITH {CRC},
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
f AS (SELECT doc_id, unnest(w) AS g FROM d),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS g FROM benchmark),
h AS (SELECT g, {crc32_sql("g")} % 10000 AS bucket FROM (SELECT g FROM f UNION SELECT g FROM b), crc),
s AS (SELECT bucket, count(*) AS s FROM f JOIN h USING (g) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN h USING (g) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM f JOIN h USING (g) JOIN gains USING (bucket) GROUP BY doc_id),
scores AS (SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN weights USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scores WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scores LEFT JOIN r USING (doc_id)""",
    "op13_spelling": rf"""
WITH RECURSIVE {CRC},
u AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), {LOWER}) AS run FROM documents),
k AS (SELECT doc_id, run, count(*) AS c FROM u WHERE length(run) >= 5 GROUP BY ALL),
h AS (SELECT *, {crc32_sql("doc_id || ':' || run")} AS h FROM k, crc),
v AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(c)::BIGINT AS n FROM h GROUP BY word),
w AS (SELECT word, n FROM v WHERE length(word) >= 5 AND n >= 3),
del AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM w)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM del a JOIN del b ON a.i = b.i AND a.rest = b.rest WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM del a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM del a JOIN w b ON a.rest = b.word),
top AS (SELECT word, count(*) AS n_near, max(m) AS best FROM near GROUP BY word),
form AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best >= 2 * w.n THEN (SELECT min(other) FROM near x WHERE x.word = w.word AND x.m = best) END AS form,
  CASE WHEN best >= 2 * w.n THEN best END AS form_n FROM w LEFT JOIN top USING (word)),
r AS (SELECT word, word AS root, 0 AS depth FROM form UNION ALL SELECT r.word, f.form, depth + 1 FROM r JOIN form f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT word, n, form, form_n, n_near, (SELECT arg_max(root, depth) FROM r WHERE r.word = form.word) AS root FROM form""",
}


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
