"""The operators on vectors and the quality classifier as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from duelens.llm import centroids, quality_network, vector_codes
from duelens.llm.queries import ORACLE, query, table


@query
def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.codes(table(spark, folder, "embeddings"))


@query
def op13_walsh_hadamard_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.clusters(table(spark, folder, "embeddings"), many=40, rounds=5, seed=2)


@query
def op12_quality_network(spark: SparkSession, folder: str) -> DataFrame:
    return quality_network.scores(
        table(spark, folder, "documents"), table(spark, folder, "labels")
    )


_KEPT = """
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0{more})"""
_APART = "list_sum(list_transform(list_zip({x}, {y}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
#: floor(total / many): ``//`` cuts towards zero.
_FLOOR = "(total - ((total % many) + many) % many) // many"


def _cluster_sql(many: int, rounds: int, seed: int) -> str:
    """Every vector against every centroid, round after round."""
    mark = f"sha256('{seed}:' || CAST(vec_id AS VARCHAR))"
    steps = [
        _KEPT.format(more=" AND len(embedding) = 64"),
        f"""
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY {mark}, v) - 1 AS c, v FROM kept
  WHERE vec_id IS NOT NULL ORDER BY {mark}, v LIMIT {many})""",
    ]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (
  SELECT id, any_value(vec_id) AS vec_id, any_value(v) AS v, min(d * 64 + c) % 64 AS c, min(d) AS d FROM (
    SELECT k.id, k.vec_id, k.v, c, {_APART.format(x="k.v", y="c.v")} AS d
    FROM kept k, c{n} c)
  GROUP BY id)""")
        if n < rounds:
            steps.append(f"""
s{n} AS (
  SELECT c, i, sum(x) AS total, count(*) AS many FROM (
    SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n})
  GROUP BY c, i),
m{n} AS (SELECT c, list(CAST({_FLOOR} AS BIGINT) ORDER BY i) AS v FROM s{n} GROUP BY c),
c{n + 1} AS MATERIALIZED (
  SELECT c, coalesce(m.v, o.v) AS v FROM c{n} o LEFT JOIN m{n} m USING (c))""")
    return f"""WITH {",".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
  CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(o.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} o USING (c)
"""


def _code_sql(parts: int, entries: int, rounds: int) -> str:
    """Every part against every entry of its codebook, round after round."""
    steps = [
        _KEPT.format(more=f" AND len(embedding) % {parts} = 0"),
        f"""
part AS MATERIALIZED (
  SELECT id, p, v[p * size + 1 : (p + 1) * size] AS v FROM (
    SELECT id, v, len(v) // {parts} AS size, unnest(range({parts})) AS p FROM kept)),
first AS (
  SELECT id, row_number() OVER (ORDER BY vec_id, v) - 1 AS c FROM kept
  WHERE vec_id IS NOT NULL ORDER BY vec_id, v LIMIT {entries}),
c0 AS MATERIALIZED (SELECT p, c, v FROM part JOIN first USING (id))""",
    ]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (
  SELECT id, p, any_value(v) AS v, min(d * 256 + c) % 256 AS c, min(d) AS d FROM (
    SELECT k.id, k.p, k.v, c, {_APART.format(x="k.v", y="c.v")} AS d
    FROM part k JOIN c{n} c USING (p))
  GROUP BY id, p)""")
        if n < rounds:
            steps.append(f"""
s{n} AS (
  SELECT p, c, i, sum(x) AS total, count(*) AS many FROM (
    SELECT p, c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n})
  GROUP BY p, c, i),
m{n} AS (SELECT p, c, list(CAST({_FLOOR} AS BIGINT) ORDER BY i) AS v FROM s{n} GROUP BY p, c),
c{n + 1} AS MATERIALIZED (
  SELECT p, c, coalesce(m.v, o.v) AS v FROM c{n} o LEFT JOIN m{n} m USING (p, c))""")
    return f"""WITH {",".join(steps)},
coded AS (
  SELECT id, string_agg(printf('%02x', CAST(c AS INTEGER)), '' ORDER BY p) AS code, sum(d) AS error
  FROM a{rounds} GROUP BY id)
SELECT vec_id, code, CAST(error AS BIGINT) AS error,
  CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, c)) FROM c{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (id)
"""


ORACLE["op11_vector_codes"] = _code_sql(
    vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS
)
ORACLE["op13_walsh_hadamard_clusters"] = _cluster_sql(40, 5, 2)
