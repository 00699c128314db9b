"""Queries over the supplied tables, one for each operator, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    from shotline.llm import simhash

    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from shotline.llm import rules

    docs = table(spark, folder, "documents")
    return rules.judge(docs, rules.fit(docs, table(spark, folder, "labels")))


@query
def op3_factorisation_machine(spark: SparkSession, folder: str) -> DataFrame:
    from shotline.llm import factors

    docs = table(spark, folder, "documents")
    model = factors.fit(
        docs, table(spark, folder, "labels"), usable=lambda doc_id: ~factors.held_out(doc_id, 5, 0)
    )
    return factors.classify(docs, model).withColumn("held_out", factors.held_out(F.col("doc_id"), 5, 0))


@query
def op9_byte_network(spark: SparkSession, folder: str) -> DataFrame:
    from shotline.llm import factors, language

    docs = table(spark, folder, "documents")
    net = language.fit(docs, usable=lambda doc_id: ~factors.held_out(doc_id, 4, 2))
    return language.identify(docs, net).withColumn("held_out", factors.held_out(F.col("doc_id"), 4, 2))


@query
def op5_vector_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from shotline.llm import packing

    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_norm_buckets(spark: SparkSession, folder: str) -> DataFrame:
    from shotline.llm import topk

    rows = topk.usable(table(spark, folder, "embeddings"))
    rows = rows.select("vec_id", topk.whole_numbers(F.col("embedding")).alias("v"))
    return topk.top_k(rows, F.col("vec_id") % 50 == 0)


SQL["op7_norm_buckets"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT q.vec_id AS query_id, p.vec_id, CAST(list_inner_product(q.v, p.v) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id % 50 = 0 AND q.vec_id <> p.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op10_deletion_lines(spark: SparkSession, folder: str) -> DataFrame:
    from shotline.llm import lines

    return lines.report(table(spark, folder, "documents"))


@query
def op6_interval_expansion(spark: SparkSession, folder: str) -> DataFrame:
    from shotline.llm import suffixes

    rows = suffixes.remove_repeats(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op8_seed_extend(spark: SparkSession, folder: str) -> DataFrame:
    from shotline.llm import substrings

    rows = substrings.remove_repeats(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op4_pfair_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from shotline.llm import mixing

    return mixing.report(table(spark, folder, "documents"))


@query
def op11_pii(spark: SparkSession, folder: str) -> DataFrame:
    from shotline.llm import privacy

    return privacy.report(table(spark, folder, "documents"))


def _pii_sql() -> str:
    from shotline.llm.privacy import ACCESS_KEY, BASE, IBAN_LENGTH, KEEP, KINDS, NEARBY, PATTERN, REACH, START, context_pattern

    def literal(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    proposed = "\n  UNION ALL ".join(
        f"SELECT r, text, '{kind}' AS kind, {k} AS k, unnest(range(1, len(m) + 1)) AS i, m, s FROM ("
        f"SELECT r, text, regexp_extract_all(text, {literal(PATTERN[kind])}) AS m, "
        f"regexp_split_to_array(text, {literal(PATTERN[kind])}) AS s FROM t)"
        for k, kind in enumerate(KINDS)
    )
    near = " ".join(
        f"WHEN kind = '{kind}' THEN regexp_matches(before, {literal(context_pattern(kind))}) "
        f"OR regexp_matches(after, {literal(context_pattern(kind))})"
        for kind in KINDS
    )
    start = " ".join(f"WHEN kind = '{kind}' THEN {START[kind]}" for kind in KINDS)
    country = " ".join(f"WHEN left(f, 2) = '{c}' THEN {n}" for c, n in IBAN_LENGTH.items())
    base = ", ".join(f"'{kind}'" for kind in BASE)
    numbers = ", ".join(
        f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in BASE
    )
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
p AS (
  {proposed}),
q AS (
  SELECT r, text, kind, k, m[i] AS f,
    CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
  FROM p),
n AS (
  SELECT *, regexp_replace(f, '[^0-9]', '', 'g') AS d, replace(f, ' ', '') AS c,
    CASE {country} ELSE 99 END AS size,
    substr(text, a, CASE WHEN a = 0 THEN 0 ELSE 1 END) || substr(text, a + length(f) + 1, 1) AS around
  FROM q),
v AS (
  SELECT *, CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(f, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST(left('0' || ltrim(x, '0'), 4) AS INTEGER) > 255)) = 0
    WHEN 'card' THEN length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(d)), lambda j:
      CASE WHEN j % 2 = 0 THEN CAST(substr(d, length(d) - j, 1) AS INTEGER)
        ELSE CAST(substr(d, length(d) - j, 1) AS INTEGER) * 2 - CASE WHEN CAST(substr(d, length(d) - j, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    WHEN 'phone' THEN length(d) BETWEEN 9 AND 15
    WHEN 'iban' THEN length(c) >= size AND list_reduce(list_transform(
      string_split(array_to_string(list_transform(string_split(substr(c, 5, size - 4) || left(c, 4), ''), lambda x:
        CASE WHEN x BETWEEN '0' AND '9' THEN x ELSE CAST(ascii(x) - 55 AS VARCHAR) END), ''), ''), lambda x: CAST(x AS INTEGER)),
      lambda x, y: (x * 10 + y) % 97) = 1
    WHEN 'secret' THEN length(d) > 0 AND length(d) < length(f)
    ELSE NOT regexp_matches(around, '[0-9-]') END AS ok
  FROM n),
e AS (
  SELECT *, a + CASE WHEN kind = 'iban' THEN length(regexp_extract(f, '^( ?[A-Z0-9]){{' || size || '}}')) ELSE length(f) END AS z
  FROM v WHERE ok),
w AS (
  SELECT *, substr(text, greatest(a - {REACH}, 0) + 1, a - greatest(a - {REACH}, 0)) AS before, substr(text, z + 1, {REACH}) AS after FROM e),
g AS (
  SELECT r, kind, k, a, z, least(1, CASE WHEN kind = 'secret' AND regexp_full_match(f, 'AKIA[0-9A-Z]{{16}}') THEN {ACCESS_KEY} {start} END
    + CASE WHEN CASE {near} END THEN {NEARBY} ELSE 0 END) AS score
  FROM w),
b AS (
  SELECT * FROM g WHERE kind IN ({base})
  UNION ALL
  SELECT * FROM g WHERE kind NOT IN ({base}) AND score >= {KEEP}
    AND NOT EXISTS (SELECT 1 FROM g h WHERE h.r = g.r AND h.kind IN ({base}) AND h.a < g.z AND g.a < h.z)),
x AS (
  SELECT r, {numbers},
    string_agg(kind || ':' || a || ':' || z, ',' ORDER BY k, a) FILTER (kind IN ({base})) AS base_spans,
    string_agg(kind || ':' || a || ':' || z, ',' ORDER BY k, a) AS spans,
    string_agg(printf('%.1f', score), ',' ORDER BY k, a) AS scores
  FROM b GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in BASE)},
  sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM t LEFT JOIN x USING (r)
"""


SQL["op11_pii"] = _pii_sql()


@query
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    from shotline.llm import audit

    return audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


SQL["op12_filter_audit"] = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
s AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 3 * length(d.text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN first_id < d.doc_id THEN 16 ELSE 0 END AS bits
  FROM d JOIN s ON d.text = s.text LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (
  SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, bits),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS own),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f)
    JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
p AS (
  SELECT filter_order, CAST(instr(filter_order, f.f) AS INTEGER) AS step, f.own,
    (SELECT coalesce(sum(g.own), 0) FROM f g WHERE instr(filter_order, g.f) < instr(filter_order, f.f)) AS before
  FROM o CROSS JOIN f)
SELECT part, filter_order, step,
  CAST(coalesce(sum(n) FILTER (bits & CAST(own + before AS INTEGER) = 0), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (bits & own <> 0 AND bits & CAST(before AS INTEGER) = 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (bits & own <> 0 AND bits & CAST(before AS INTEGER) <> 0), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (bits = own), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(c.good) FILTER (bits & own <> 0 AND bits & CAST(before AS INTEGER) = 0), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(c.toxic) FILTER (bits & own <> 0 AND bits & CAST(before AS INTEGER) = 0), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * 120 // nullif(bit_count(bits), 0)) FILTER (bits & own <> 0), 0) AS BIGINT) AS shapley
FROM c CROSS JOIN p GROUP BY part, filter_order, step
"""


@query
def op13_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    from shotline.llm import centroids

    return centroids.report(table(spark, folder, "embeddings")).drop("scans")


def _clusters_sql(rounds: int = 3) -> str:
    parts = ["""
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m
  FROM (SELECT v, sha256('1:' || vec_id) AS h FROM v WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 16))"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS (
  SELECT r, min(struct_pack(d := d, c := c)) AS best FROM (
    SELECT r, c, CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i]))) AS BIGINT) AS d FROM v CROSS JOIN c{i})
  GROUP BY r)""")
        if i < rounds:
            parts.append(f"""s{i} AS (
  SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
    SELECT best.c AS c, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{i} JOIN v USING (r)) GROUP BY c, i),
m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{i} GROUP BY c),
c{i + 1} AS (SELECT c{i}.c, coalesce(m{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN m{i} USING (c))""")
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance,
  CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} ON c{rounds}.c = best.c
"""


SQL["op13_centroid_clusters"] = _clusters_sql()
