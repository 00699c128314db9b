"""Catalogue: paths, names, scores, splits, dataset statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotline.functions import labels
from shotline.operators import calibrate, catalog, splits, taxonomy
from shotline.plans import base
from shotline.plans.base import cte, query, twin
from shotline.session import side_by_side
from shotline.plans.metric_queries import FAMILIES, SCORE_SQL, collapsed_species, species_table

ALIASES = {"old gizmo": "old bolt", "large plate": "large ring", "economy plate": "missing name"}
HARDCODED = {"new gizmo": (0, "Doméstica"), "promo plate": (1, "Bajo"), "small anvil": (5, "Crítico")}

EXTENSIONS = [".jpg", ".JPG", ".png", ".txt", ".jpeg"]


def paths(spark, d):
    tail = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("page_id") % 5 + 1).cast("int"))
    return base.table(spark, d, "pages").select(
        "page_id", F.concat(F.lit("data/images/"), tail, F.lit("/IMG_"), "page_id", ext).alias("path")
    )


_exts = "[" + ", ".join(f"'{e}'" for e in EXTENSIONS) + "]"
cte(
    "paths",
    f"""SELECT page_id, 'data/images/' || regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || '/IMG_' || page_id || {_exts}[page_id % 5 + 1] AS path FROM pages""",
)


@query(
    "s3_path_decomposition",
    twin(
        """SELECT page_id, path, p[a + 1] AS family, p[a + 2] AS genus, p[a + 3] AS folder FROM (
          SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS p, list_position(list_filter(string_split(path, '/'), lambda x: x <> ''), 'images') AS a FROM paths)
        WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('jpg', 'jpeg', 'png', 'bmp') AND len(p) > a + 2""",
        "paths",
    ),
)
def s3(spark, d):
    return catalog.image_paths(paths(spark, d))


@query(
    "s3_directory_scan",
    "SELECT lang AS family, source AS genus, sum(strlen(text) + 1)::BIGINT AS bytes FROM documents WHERE text IS NOT NULL GROUP BY 1, 2",
)
def s3_scan(spark, d):
    """Files below a folder, found by a scan of binary files, with the names on their path."""
    from shotline.sources import tables
    from shotline.streaming.drain import shared_folder

    target = f"{shared_folder(spark)}/images"
    rows = base.table(spark, d, "documents").where("text IS NOT NULL").select("lang", "source", "text")
    rows.write.partitionBy("lang", "source").text(target)
    found = tables.read_images(spark, target, "*.txt")
    name = lambda key: F.regexp_extract("path", f"/images/.*{key}=([^/]+)/", 1)
    return found.groupBy(name("lang").alias("family"), name("source").alias("genus")).agg(F.sum("length").alias("bytes"))


@query(
    "s4_nested_map_dimension",
    twin(
        "SELECT s.species, s.family, f.tclass FROM sps s LEFT JOIN fams f USING (family)",
        "sps",
        "fams",
    ),
)
def s4(spark, d):
    dim = taxonomy.class_dimension(spark, FAMILIES)
    return species_table(spark, d).select("species", "family").join(dim, "family", "left")


def items(spark, d):
    """Parts read as items in folders named in several styles."""
    word = F.element_at(F.split("p_name", " "), 2)
    folder = (
        F.when(F.col("p_partkey") % 4 == 0, F.replace("p_name", F.lit(" "), F.lit("_")))
        .when(F.col("p_partkey") % 4 == 1, F.concat_ws("_", "p_type", word))
        .when(F.col("p_partkey") % 4 == 2, word)
        .otherwise(F.concat(F.initcap("p_name"), F.lit(" ")))
    )
    return base.table(spark, d, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_brand").alias("family"),
        F.col("p_type").alias("genus"),
        folder.alias("folder"),
    )


cte(
    "items",
    """SELECT p_partkey AS item_id, p_brand AS family, p_type AS genus, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '_')
      WHEN 1 THEN p_type || '_' || split_part(p_name, ' ', 2) WHEN 2 THEN split_part(p_name, ' ', 2)
      ELSE upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] || ' ' END AS folder FROM part""",
)


def scores(spark, d):
    """Score table with both one- and two-part names."""
    part = base.table(spark, d, "part")
    word = F.element_at(F.split("p_name", " "), 2)
    own = part.where(~word.isin("gizmo", "plate")).select(F.col("p_name").alias("species"))
    typed = part.where(F.col("p_type").isin("SMALL", "PROMO", "LARGE")).select(
        F.concat_ws(" ", "p_type", word).alias("species")
    )
    names = own.unionByName(typed).distinct()
    return names.select("species", (F.length("species") % 7).alias("score"))


cte(
    "scores",
    """SELECT lower(species) AS name, max(length(species) % 7) AS score FROM (
      SELECT p_name AS species FROM part WHERE split_part(p_name, ' ', 2) NOT IN ('gizmo', 'plate')
      UNION SELECT p_type || ' ' || split_part(p_name, ' ', 2) FROM part WHERE p_type IN ('SMALL', 'PROMO', 'LARGE')) GROUP BY 1""",
)
cte("aliases", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ALIASES.items()) + ") t(name, target)")
cte(
    "hard",
    "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {s}, '{c}')" for n, (s, c) in HARDCODED.items()) + ") t(name, score, category)",
)
cte(
    "cands",
    """SELECT *, CASE WHEN contains(a, lower(genus)) THEN a ELSE lower(genus) || ' ' || a END AS b
    FROM (SELECT *, lower(trim(replace(folder, '_', ' '))) AS a FROM items)""",
    "items",
)


@query("p1_normal_name", twin("SELECT item_id, a AS name FROM cands", "cands"))
def p1(spark, d):
    return items(spark, d).select("item_id", labels.normal_name(F.col("folder")).alias("name"))


@query("p2_candidate_names", twin("SELECT item_id, a AS candidate_a, b AS candidate_b FROM cands", "cands"))
def p2(spark, d):
    a = labels.normal_name(F.col("folder"))
    b = labels.second_candidate(a, labels.normal_name(F.col("genus")))
    return items(spark, d).select("item_id", a.alias("candidate_a"), b.alias("candidate_b"))


cte(
    "scored",
    f"""SELECT item_id, family, genus, folder, replace(CASE WHEN byhand IS NULL AND da IS NULL AND db IS NOT NULL THEN genus || ' ' || folder ELSE folder END, '_', ' ') AS species,
    coalesce(byhand, da, db, 0) AS score, coalesce(CASE WHEN ha_c IS NOT NULL THEN ha_c WHEN aa IS NULL AND hb_c IS NOT NULL THEN hb_c END, {SCORE_SQL.format(s='coalesce(byhand, da, db, 0)')}) AS category
    FROM (SELECT c.*, ha.category AS ha_c, hb.category AS hb_c, sa.score AS aa, da.score AS da, db.score AS db, coalesce(ha.score, sa.score, hb.score, sb.score) AS byhand FROM cands c
      LEFT JOIN hard ha ON ha.name = c.a LEFT JOIN hard hb ON hb.name = c.b LEFT JOIN aliases la ON la.name = c.a LEFT JOIN aliases lb ON lb.name = c.b
      LEFT JOIN scores sa ON sa.name = la.target LEFT JOIN scores sb ON sb.name = lb.target LEFT JOIN scores da ON da.name = c.a LEFT JOIN scores db ON db.name = c.b)""",
    "cands",
    "scores",
    "aliases",
    "hard",
)


def scored(spark, d):
    lookup = catalog.name_lookup(
        scores(spark, d),
        catalog.map_rows(spark, ALIASES, ("name", "target")),
        catalog.hardcoded_rows(spark, HARDCODED),
    )
    return catalog.with_scores(items(spark, d), lookup)


@query("j1_score_lookup", twin("SELECT * FROM scored", "scored"))
def j1(spark, d):
    return scored(spark, d)


@query(
    "j2_missing_alias_targets",
    twin("SELECT name, target FROM aliases WHERE target NOT IN (SELECT name FROM scores)", "aliases", "scores"),
)
def j2(spark, d):
    return catalog.missing_targets(catalog.map_rows(spark, ALIASES, ("name", "target")), scores(spark, d))


@query("p3_score_category", twin(f"SELECT item_id, score, {SCORE_SQL.format(s='score')} AS category FROM idx", "idx"))
def p3(spark, d):
    return base.index(spark, d).select("item_id", "score", taxonomy.score_category(F.col("score")).alias("category"))


@query(
    "p4_score_category_nulo",
    f"SELECT c_custkey, {SCORE_SQL.format(s='(c_custkey % 8)').replace('Exótica/Invasora/Desconocida', 'Nulo')} AS category FROM customer",
)
def p4(spark, d):
    return base.table(spark, d, "customer").select(
        "c_custkey", taxonomy.score_category(F.col("c_custkey") % 8, "Nulo").alias("category")
    )


_COLLAPSE = "CASE WHEN category IN ('Doméstica', 'Exótica', 'Invasora', 'Exótica/Invasora', 'Introducida') THEN 'Nulo' ELSE category END"


@query("p5_collapsed_category", twin(f"SELECT species, {_COLLAPSE} AS category FROM sps", "sps"))
def p5(spark, d):
    return collapsed_species(spark, d).select("species", "category")


@query(
    "p6_combined_category",
    twin(
        f"""SELECT category, count(*) AS n FROM (SELECT {_COLLAPSE} AS category FROM scored UNION ALL SELECT 'Medio+Bajo' FROM scored WHERE category IN ('Medio', 'Bajo')) GROUP BY 1""",
        "scored",
    ),
)
def p6(spark, d):
    rows = scored(spark, d).withColumn("category", taxonomy.collapse_category(F.col("category")))
    return taxonomy.with_combined(rows).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("p9_split_filter", twin("SELECT item_id, split FROM split3 WHERE split IN ('gallery', 'query_test')", "split3"))
def p9(spark, d):
    return splits.select_split(base.split3(spark, d), "query_test").select("item_id", "split")


@query(
    "p10_relabel_split",
    twin("SELECT item_id, CASE WHEN split = 'query_dev' THEN 'query' ELSE split END AS split FROM split3", "split3"),
)
def p10(spark, d):
    return splits.relabel_split(base.split3(spark, d), "query_dev", "query").select("item_id", "split")


@query("w4_gallery_query_split", twin("SELECT item_id, species, split FROM split2", "split2"))
def w4(spark, d):
    return base.split2(spark, d).select("item_id", "species", "split")


# parts as a second, larger population: one species per name, and rare ones
cte(
    "split2_parts",
    """SELECT * EXCLUDE (rk, n), CASE WHEN rk <= CASE WHEN n = 2 THEN 1 WHEN n = 3 THEN 2 WHEN n >= 5 AND floor(n * 0.2::DOUBLE) < 2 THEN 2
      ELSE greatest(1, floor(n * 0.2::DOUBLE)) END THEN 'gallery' ELSE 'query' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY species ORDER BY md5('29~' || item_id), item_id) AS rk, count(*) OVER (PARTITION BY species) AS n
      FROM (SELECT p_partkey AS item_id, p_brand || p_name AS species FROM part))""",
)
cte(
    "split3_parts",
    """SELECT item_id, species, split FROM split2_parts WHERE split <> 'query' UNION ALL
    SELECT item_id, species, CASE WHEN n > 1 AND rk <= least(n - 1, greatest(1, round_even(0.3::DOUBLE * n, 0))) THEN 'query_test' ELSE 'query_dev' END
    FROM (SELECT *, row_number() OVER (PARTITION BY species ORDER BY md5('30~' || item_id), item_id) AS rk, count(*) OVER (PARTITION BY species) AS n FROM split2_parts WHERE split = 'query')""",
    "split2_parts",
)


def part_items(spark, d):
    return base.table(spark, d, "part").select(
        F.col("p_partkey").alias("item_id"), F.concat("p_brand", "p_name").alias("species")
    )


@query("w4_split_parts", twin("SELECT * FROM split2_parts", "split2_parts"))
def w4_parts(spark, d):
    return splits.gallery_query(part_items(spark, d))


@query("w5_dev_test_split", twin("SELECT item_id, species, split FROM split3", "split3"))
def w5(spark, d):
    return base.split3(spark, d).select("item_id", "species", "split")


@query("w5_split_parts", twin("SELECT * FROM split3_parts", "split3_parts"))
def w5_parts(spark, d):
    return splits.dev_test(splits.gallery_query(part_items(spark, d)))


@query(
    "w5_excluded_singletons",
    twin(
        """SELECT species, count(*) AS query_count, 'single_query_item' AS reason
        FROM split2_parts WHERE split = 'query' GROUP BY species HAVING count(*) = 1""",
        "split2_parts",
    ),
)
def w5_excluded(spark, d):
    return splits.dev_test_excluded(splits.gallery_query(part_items(spark, d)))


@query(
    "w6_split_integrity",
    twin(
        """SELECT count(*) AS n_rows, 0::BIGINT AS n_violations FROM split3_parts""",
        "split3_parts",
    ),
)
def w6(spark, d):
    before = splits.gallery_query(part_items(spark, d))
    after = splits.dev_test(before)
    bad = splits.split_violations(before, after).agg(F.count(F.lit(1)).alias("n_violations"))
    rows = after.agg(F.count(F.lit(1)).alias("n_rows"))
    return side_by_side(rows, bad)


@query(
    "w7_first_shots",
    twin("SELECT * FROM (SELECT item_id, species, row_number() OVER (PARTITION BY species ORDER BY item_id) AS shot FROM idx) WHERE shot <= 5", "idx"),
)
def w7(spark, d):
    return splits.first_shots(base.index(spark, d), 5).select("item_id", "species", "shot")


@query(
    "w8_forced_sample",
    """SELECT doc_id, lang, forced FROM (SELECT d.doc_id, lang, coalesce(toxic = 1, false) AS forced, row_number() OVER (PARTITION BY lang, coalesce(toxic = 1, false) ORDER BY md5('29~' || d.doc_id), d.doc_id) AS r,
      count(*) FILTER (coalesce(toxic = 1, false)) OVER (PARTITION BY lang) AS f FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) WHERE forced OR r <= 40 - f""",
)
def w8(spark, d):
    flags = base.table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("forced"))
    docs = base.table(spark, d, "documents").select("doc_id", "lang").join(flags, "doc_id", "left")
    docs = docs.withColumn("forced", F.coalesce("forced", F.lit(False)))
    return splits.forced_sample(docs, "lang", "doc_id", "forced", 40)


@query(
    "a25_dataset_statistics",
    "SELECT source, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 4) AS std FROM documents GROUP BY source",
)
def a25(spark, d):
    out = catalog.dataset_statistics(base.table(spark, d, "documents"), "source", "n_chars")
    return out.select("source", "n", F.round("mean", 6).alias("mean"), F.round("std", 4).alias("std"))


@query(
    "a25_histogram",
    """SELECT least(floor((n_chars - low) / width), 9)::INT AS bin, count(*) AS n FROM documents, (
      SELECT min(n_chars)::DOUBLE AS low, (max(n_chars)::DOUBLE - min(n_chars)::DOUBLE) / 10 AS width FROM documents) GROUP BY 1""",
)
def a25_histogram(spark, d):
    documents = base.table(spark, d, "documents")
    low, high = calibrate.value_range(documents, "n_chars")
    return calibrate.histogram(documents, F.col("n_chars"), low, high, 10, [])


@query(
    "a26_hierarchy_counts",
    "SELECT r_name AS family, n_name AS genus, c_mktsegment AS species, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)",
)
def a26(spark, d):
    nation, region = base.table(spark, d, "nation"), base.table(spark, d, "region")
    rows = (
        base.table(spark, d, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("r_name").alias("family"), F.col("n_name").alias("genus"), F.col("c_mktsegment").alias("species"))
    )
    return catalog.hierarchy_counts(rows, ["family", "genus", "species"])


@query(
    "a27_curation_totals",
    """SELECT lang, count(*) FILTER (quality = 1) AS activo, count(*) FILTER (quality <> 1) AS borrado, count(*) AS total_original
    FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang""",
)
def a27(spark, d):
    rows = base.table(spark, d, "documents").select("doc_id", "lang").join(base.table(spark, d, "labels"), "doc_id")
    return catalog.curation_totals(rows, "lang", F.col("quality") == 1)


@query(
    "a28_split_counts",
    twin(
        """SELECT count(*) FILTER (split = 'query_dev') AS query_count, count(*) FILTER (split = 'query_test') AS query_test_count,
        count(*) FILTER (split = 'gallery') AS gallery_count, count(*) AS total_images, count(DISTINCT species) AS total_species FROM split3""",
        "split3",
    ),
)
def a28(spark, d):
    return catalog.split_counts(base.split3(spark, d))


@query("a29_species_per_category", twin("SELECT category, count(DISTINCT species) AS n_species FROM scored GROUP BY 1", "scored"))
def a29(spark, d):
    return catalog.species_per_category(scored(spark, d))


@query("a29_unscored_species", twin("SELECT DISTINCT species FROM scored WHERE score = 0", "scored"))
def a29_unscored(spark, d):
    return catalog.unscored_species(scored(spark, d))


@query(
    "d1b_common_names",
    twin(
        """SELECT i.item_id, i.species, CASE WHEN n.n_nationkey % 3 = 0 THEN NULL ELSE n.n_name END AS nombre_comun_es_ar FROM idx i LEFT JOIN nation n ON 'sp' || n.n_nationkey = i.species""",
        "idx",
    ),
)
def d1b(spark, d):
    names = base.table(spark, d, "nation").select(
        F.concat(F.lit("sp"), "n_nationkey").alias("species"),
        F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("nombre_comun_es_ar"),
    )
    return catalog.with_common_names(base.index(spark, d).select("item_id", "species"), names)


@query(
    "x3_embed_missing",
    """SELECT lang, count(*) AS n, count(*) FILTER (doc_id % 3 <> 0) AS n_embedded FROM documents GROUP BY lang""",
)
def x3(spark, d):
    from shotline.sources.embeddings import embed_missing

    docs = base.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "lang", "text")
    stored = docs.where("item_id % 3 = 0").select("item_id")
    scored_rows = embed_missing(docs, stored, "text", letter_frequencies).where("status = 'ok'")
    flags = scored_rows.select("item_id", F.size("vec").alias("dims")).where("dims = 26")
    joined = docs.select("item_id", "lang").join(flags, "item_id", "left")
    return joined.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("dims").alias("n_embedded"))


LETTERS = 1 << 20  # characters counted together


def letter_frequencies(texts):
    """Stand-in embedder: relative letter frequencies of the whole texts, counted LETTERS characters at a time."""
    import numpy as np

    counts = np.zeros((len(texts), 26), dtype=np.int64)

    def add(rows, parts):
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32) - np.uint32(97)  # others wrap round
        letter = codes < 26
        part = np.repeat(np.arange(len(parts)), [len(t) for t in parts])[letter]
        found = np.bincount(part * 26 + codes[letter], minlength=26 * len(parts)).reshape(-1, 26)
        np.add.at(counts, rows, found)

    rows, parts, held = [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, len(text), LETTERS):
            rows.append(row)
            parts.append(text[at : at + LETTERS].lower())
            held += len(parts[-1])
            if held >= LETTERS:
                add(rows, parts)
                rows, parts, held = [], [], 0
    if parts:
        add(rows, parts)
    return (counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


@query(
    "x3_vector_values",
    """SELECT doc_id AS item_id, len(low) - len(replace(low, 'a', '')) AS n_a, len(low) - len(replace(low, 'e', '')) AS n_e,
    len(low) - len(replace(low, 't', '')) AS n_t FROM (SELECT doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS low FROM documents WHERE text IS NOT NULL)""",
)
def x3_values(spark, d):
    """The stored vectors themselves: letter counts recovered from them."""
    from shotline.sources.embeddings import embed_missing

    docs = base.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text").where("text IS NOT NULL")
    done = docs.where("false").select("item_id")
    vectors = embed_missing(docs, done, "text", letter_frequencies).where("status = 'ok'").select("item_id", "vec")
    letters = F.length(F.regexp_replace(F.lower("text"), "[^a-z]", ""))
    joined = docs.select("item_id", letters.alias("_n")).join(vectors, "item_id")
    count = lambda c: F.round(F.col("vec")[ord(c) - 97].cast("double") * F.col("_n")).cast("bigint").alias(f"n_{c}")
    return joined.select("item_id", count("a"), count("e"), count("t"))


@query(
    "j10_embedding_status",
    """SELECT CASE WHEN doc_id % 3 = 0 THEN 'skip' ELSE 'ok' END AS status, count(*) AS n FROM documents GROUP BY 1""",
)
def j10(spark, d):
    from shotline.sources.embeddings import embed_missing, embedding_status

    docs = base.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")
    stored = docs.where("item_id % 3 = 0").select("item_id")
    return embedding_status(docs, stored, embed_missing(docs, stored, "text", letter_frequencies))
