"""The ten operators as registered queries, over whole tables with whole texts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelens.llm import (
    decontamination,
    html_extract,
    license_scan,
    ngram_join,
    packing,
    quality_rules,
    quote_links,
    secret_scan,
    sharding,
    substring_dedup,
)
from duelens.operators.staging import new_path, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.found_items(docs, table(spark, folder, "benchmark"), window=10)
    lengths = F.transform("spans", lambda s: (s["end"] - s["start"]).cast("long"))
    n_hit = F.aggregate(lengths, F.lit(0).cast("long"), lambda n, more: n + more)
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array("items")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE["op4_benchmark_decontamination"] = r"""
WITH folded AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
item_starts AS (
  SELECT item_id, words, least(len(words), 10) AS many,
    unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS pos
  FROM items WHERE len(words) > 0),
windows AS (
  SELECT DISTINCT item_id, many, array_to_string(words[pos : pos + many - 1], ' ') AS run
  FROM item_starts),
lengths AS (SELECT DISTINCT many FROM windows),
runs AS (
  SELECT doc_id, many, unnest(range(1, len(words) - many + 2)) AS pos, words
  FROM folded, lengths WHERE len(words) >= many),
hits AS (
  SELECT doc_id, r.pos, r.many, item_id
  FROM runs r JOIN windows w
  ON w.many = r.many AND w.run = array_to_string(r.words[r.pos : r.pos + r.many - 1], ' ')),
places AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(pos, pos + many)) AS place FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT f.doc_id, CAST(len(f.words) AS BIGINT) AS n_words,
  CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(n.items, '')) AS items_sha256,
  coalesce(p.n_hit, 0) > 0 AS contaminated
FROM folded f LEFT JOIN places p USING (doc_id) LEFT JOIN named n USING (doc_id)
"""


@query
def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secret_spans(table(spark, folder, "documents"))


@query
def op6_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.shingle_groups(table(spark, folder, "documents"), width=3, percent=90)


@query
def op7_best_two_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), VOCABULARY)


@query
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality(table(spark, folder, "documents"))


@query
def op1_virtual_slots(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharding.records(table(spark, folder, "documents"))
    sizes = staged(sharding.slot_sizes(rows))
    path = new_path(spark, "slot-map")
    sharding.store_map(sharding.first_map(spark, sizes, 16), path)
    placed = sharding.placed(rows, sizes, sharding.load_map(spark, path))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


@query
def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.without_repeats(table(spark, folder, "documents")).drop("kept")


@query
def op10_html_tree_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.main_texts(table(spark, folder, "pages"))


@query
def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.licenses(table(spark, folder, "documents"))


def _license_sql() -> str:
    """All places of all templates by joining words with template words, without an index."""
    words = ", ".join(
        f"({n}, '{t.label}', {str(t.base).upper()}, {len(t.words)}, {len(t.mandatory)}, {i}, '{w}', "
        f"{int(i in t.mandatory)})"
        for n, t in enumerate(license_scan.TEMPLATES)
        for i, w in enumerate(t.words)
    )
    return rf"""
WITH template(t, label, base, many, keys, i, word, is_key) AS (VALUES {words}),
split AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
placed AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM split),
found AS (
  SELECT doc_id, t, any_value(label) AS label, any_value(base) AS base, pos - i AS first,
    count(*) / any_value(many) AS score
  FROM placed JOIN template USING (word) GROUP BY doc_id, t, pos - i
  HAVING sum(is_key) = any_value(keys) AND count(*) / any_value(many) >= {license_scan.LEAST_SCORE}),
held AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base,
    min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM found GROUP BY doc_id)
SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0.0) AS score
FROM split s LEFT JOIN held USING (doc_id)
"""


ORACLE["op2_license_scan"] = _license_sql()


@query
def op8_quote_links(spark: SparkSession, folder: str) -> DataFrame:
    return quote_links.conversations(table(spark, folder, "conversations"))


ORACLE["op8_quote_links"] = r"""
WITH RECURSIVE message AS (
  SELECT row_number() OVER () AS id, conv_id, turn, role, coalesce(text, '') AS text
  FROM conversations),
split AS (SELECT id, string_split_regex(text, '\r?\n') AS lines FROM message),
line AS (
  SELECT id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM split),
marked AS (
  SELECT id, i,
    len(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level,
    regexp_replace(line, '^(?:[ \t]*>)+', '') AS body
  FROM line),
edge AS (
  SELECT *, coalesce(lag(level) OVER (PARTITION BY id ORDER BY i) <> level, true) AS is_new FROM marked),
numbered AS (
  SELECT *, count(*) FILTER (is_new) OVER (PARTITION BY id ORDER BY i) AS run FROM edge),
passage AS (
  SELECT id, run, any_value(level) AS level, string_agg(body, chr(10) ORDER BY i) AS text
  FROM numbered GROUP BY id, run),
own AS (
  SELECT id, string_agg(text, chr(10) ORDER BY run) AS text FROM passage WHERE level = 0 GROUP BY id),
part AS (
  SELECT id, run, level, unnest(list_prepend(text, string_split_regex(text, '\n[ \t]*\n'))) AS text
  FROM (SELECT * FROM passage UNION ALL SELECT id, 0, 0, text FROM own)),
hashed AS (
  SELECT DISTINCT id, run, level, trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS words
  FROM part),
original AS (
  SELECT conv_id, words, min(turn) AS linked_turn FROM hashed JOIN message USING (id)
  WHERE level = 0 AND words <> '' GROUP BY conv_id, words),
quoted AS (
  SELECT m.conv_id, m.turn, h.run, h.level, o.linked_turn
  FROM hashed h JOIN message m USING (id) JOIN original o ON o.conv_id = m.conv_id AND o.words = h.words
  WHERE h.level > 0 AND o.linked_turn < m.turn),
link AS (
  SELECT conv_id, turn, arg_min(linked_turn, level * 1000000000 - linked_turn) AS linked_turn,
    count(DISTINCT run) AS n_linked
  FROM quoted GROUP BY conv_id, turn),
parent AS (
  SELECT k.conv_id, k.turn, coalesce(l.linked_turn, b.turn) AS parent_turn, coalesce(l.n_linked, 0) AS n_linked
  FROM (SELECT DISTINCT conv_id, turn FROM message WHERE conv_id IS NOT NULL AND turn IS NOT NULL) k
  LEFT JOIN (SELECT DISTINCT conv_id, turn FROM message) b
    ON b.conv_id = k.conv_id AND b.turn = k.turn - 1
  LEFT JOIN link l ON l.conv_id = k.conv_id AND l.turn = k.turn),
thread AS (
  SELECT conv_id, turn, turn AS thread_turn, 0 AS depth FROM parent WHERE parent_turn IS NULL
  UNION ALL
  SELECT p.conv_id, p.turn, t.thread_turn, t.depth + 1
  FROM parent p JOIN thread t ON t.conv_id = p.conv_id AND t.turn = p.parent_turn),
quotes AS (SELECT id, count(*) AS n_quotes FROM passage WHERE level > 0 GROUP BY id)
SELECT m.conv_id, m.turn, m.role,
  regexp_replace(coalesce(o.text, ''), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS text,
  p.parent_turn, coalesce(t.thread_turn, m.turn) AS thread_turn,
  CAST(coalesce(t.depth, 0) AS BIGINT) AS depth, CAST(coalesce(q.n_quotes, 0) AS BIGINT) AS n_quotes,
  CAST(coalesce(p.n_linked, 0) AS BIGINT) AS n_linked
FROM message m LEFT JOIN own o USING (id) LEFT JOIN quotes q USING (id)
LEFT JOIN parent p ON p.conv_id = m.conv_id AND p.turn = m.turn
LEFT JOIN thread t ON t.conv_id = m.conv_id AND t.turn = m.turn
"""


#: Every third message quotes the one before it, and the next one quotes that with its quote.
_REPLIED_SQL = r"""WITH RECURSIVE first AS (
  SELECT b.conv_id, b.turn, b.role, CASE WHEN b.turn % 3 = 1 AND q.text IS NOT NULL
    THEN '> ' || replace(q.text, chr(10), chr(10) || '> ') || chr(10) || chr(10) ELSE '' END
    || coalesce(b.text, '') AS text
  FROM conversations b LEFT JOIN conversations q ON q.conv_id = b.conv_id AND q.turn = b.turn - 1),
replied AS (
  SELECT b.conv_id, b.turn, b.role, CASE WHEN b.turn % 3 = 2 AND q.text IS NOT NULL
    THEN b.text || chr(10) || '> ' || replace(q.text, chr(10), chr(10) || '> ') ELSE b.text END AS text
  FROM first b LEFT JOIN first q ON q.conv_id = b.conv_id AND q.turn = b.turn - 1),
message AS ("""


def _quoted(text: Column) -> Column:
    return F.concat(F.lit("> "), F.replace(text, F.lit("\n"), F.lit("\n> ")))


@query
def quoting_replies(spark: SparkSession, folder: str) -> DataFrame:
    """The conversations with quotes put into some of their messages, nested ones too, and taken apart again."""
    said = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")

    def with_before(rows: DataFrame) -> DataFrame:
        before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
        return rows.join(before, ["conv_id", "turn"], "left")

    own = F.coalesce("text", F.lit(""))
    quotes = (F.col("turn") % 3 == 1) & F.col("before").isNotNull()
    first = with_before(said).withColumn(
        "text",
        F.when(quotes, F.concat(_quoted(F.col("before")), F.lit("\n\n"), own)).otherwise(own),
    )
    further = (F.col("turn") % 3 == 2) & F.col("before").isNotNull()
    replied = with_before(first.drop("before")).withColumn(
        "text",
        F.when(further, F.concat("text", F.lit("\n"), _quoted(F.col("before")))).otherwise(F.col("text")),
    )
    return quote_links.conversations(replied.drop("before"))


ORACLE["quoting_replies"] = ORACLE["op8_quote_links"].replace(
    "WITH RECURSIVE message AS (", _REPLIED_SQL, 1
).replace("FROM conversations),", "FROM replied),", 1)


ORACLE["op3_substring_dedup"] = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
start AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS pos FROM split WHERE len(words) >= 13),
window_of AS (SELECT doc_id, pos, array_to_string(words[pos : pos + 12], ' ') AS run FROM start),
source AS (SELECT run, min(doc_id) AS first FROM window_of GROUP BY run),
hit AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS place
  FROM window_of JOIN source USING (run) WHERE first < doc_id),
word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM split),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n
  FROM word ANTI JOIN hit USING (doc_id, place) GROUP BY doc_id)
SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split s LEFT JOIN kept USING (doc_id)
"""

ORACLE["op6_ngram_jaccard_join"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words
  FROM documents),
start AS (
  SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS pos
  FROM split WHERE len(words) > 0),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(words[pos : pos + 2], ' ') AS run FROM start),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM shingle x JOIN shingle y ON x.run = y.run AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
reached AS (
  SELECT doc_id, doc_id AS other FROM split
  UNION
  SELECT doc_id, b FROM reached JOIN link ON other = a)
SELECT s.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM split s JOIN reached USING (doc_id) LEFT JOIN size USING (doc_id) GROUP BY s.doc_id
"""
