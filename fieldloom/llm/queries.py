"""Queries and SQL of this package's operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import clusters, mixing, neighbours, packing, percentiles, quality, tokens
from fieldloom.session import checkpoint


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_members(table(spark, sf_dir, "forestscan"))


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster by its size and most typical members."""
    return clusters.cluster_report(table(spark, sf_dir, "forestscan"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.unusual_groups(table(spark, sf_dir, "georecords"))


SHARES = (0.05, 0.25, 0.5, 0.75, 0.95)


def _named(found: DataFrame, keys: list[str]) -> DataFrame:
    columns = [F.col(f"q{i}{s}").alias(f"p{round(100 * q):02d}{s}") for i, q in enumerate(SHARES) for s in ("", "_lo", "_hi")]
    return found.select(*keys, "n", "rank_error", *columns)


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of intensity per classification, from the merged sketches of all scans."""
    merged = percentiles.merge_sketches(percentiles.group_sketches(table(spark, sf_dir, "georecords")), ["classification"])
    return _named(percentiles.quantiles(merged, ["classification"], SHARES), ["classification"])


def p4_scan_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of intensity per scan and classification."""
    keys = ["scan_id", "classification"]
    return _named(percentiles.quantiles(percentiles.group_sketches(table(spark, sf_dir, "georecords")), keys, SHARES), keys)


def p4_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per scan date and classification, combined from the sketches of the scans."""
    dates = table(spark, sf_dir, "scans").select("scan_id", F.to_date("scan_date").alias("scan_day"))
    keys = ["scan_day", "classification"]
    dated = percentiles.group_sketches(table(spark, sf_dir, "georecords")).join(dates, "scan_id")
    return _named(percentiles.quantiles(percentiles.merge_sketches(dated, keys), keys, SHARES), keys)


def p4_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the percentiles of every scan and classification keep their rank bounds, by exact counts."""
    keys, rows = ["scan_id", "classification"], table(spark, sf_dir, "georecords").where("classification is not null and intensity is not null")
    found = checkpoint(percentiles.quantiles(percentiles.group_sketches(rows), keys, SHARES))
    by_scan = percentiles.rank_check(rows.where("scan_id is not null"), found, keys, "intensity", SHARES)
    merged = percentiles.quantiles(percentiles.merge_sketches(percentiles.group_sketches(rows), keys[1:]), keys[1:], SHARES)
    return by_scan.unionByName(percentiles.rank_check(rows, merged, keys[1:], "intensity", SHARES).withColumn("scan_id", F.lit(-1).cast("bigint")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_pairs(table(spark, sf_dir, "shapevectors"))


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar other vectors of every vector, with distances."""
    lists = neighbours.neighbour_lists(table(spark, sf_dir, "shapevectors"))
    rows = lists.select("vec_id", F.posexplode("neighbours").alias("rank", "c"))
    return rows.select("vec_id", F.col("rank") + 1, F.col("c.id").alias("neighbour_id"), F.round(F.sqrt("c.sd"), 6).alias("distance")).toDF("vec_id", "rank", "neighbour_id", "distance")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, written once."""
    return checkpoint(tokens.token_counts(table(spark, sf_dir, "documents"), ("doc_id", "source")))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_sizes(spark, sf_dir), table(spark, sf_dir, "containers"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each kind are."""
    return packing.packing_report(p7_packed(spark, sf_dir))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lost, containers overfull and classes miscounted, by kind: none."""
    sizes = _sizes(spark, sf_dir)
    return packing.packing_checks(checkpoint(packing.packed(sizes, table(spark, sf_dir, "containers"))), sizes)


def p8_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_sizes(spark, sf_dir), table(spark, sf_dir, "mixtargets"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the sources."""
    sizes, targets = _sizes(spark, sf_dir), table(spark, sf_dir, "mixtargets")
    return mixing.mixture_report(mixing.mixed(sizes, targets), sizes, targets)


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every source keeps its share and its repeats."""
    sizes, targets = _sizes(spark, sf_dir), table(spark, sf_dir, "mixtargets")
    return mixing.mixture_checks(checkpoint(mixing.mixed(sizes, targets)), sizes, targets)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.structured_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "commonwords"))


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and nearest profile of every document's main text."""
    return quality.text_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "commonwords"))


def p9_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basic counts of every document's whole text, as column expressions."""
    return quality.text_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "commonwords"))


QUERIES = {f.__name__: f for f in (p3_found, p3_clusters, p4_found, p4_percentiles, p4_scan_percentiles, p4_days, p4_bounds, p6_found, p6_neighbours, p7_packed, p7_report, p7_checks, p8_mixed, p8_report, p8_checks, p9_found, p9_statistics, p9_counts)}

SQL = {
    "p3_found": """
        WITH RECURSIVE p AS (
            SELECT rec_id, classification AS k, x, y, z, CAST(floor(x / 0.6) AS BIGINT) AS cx, CAST(floor(y / 0.6) AS BIGINT) AS cy
            FROM forestscan WHERE classification IN (3, 4, 5) AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL),
        q AS (SELECT p.*, cx + i.i AS jx, cy + j.j AS jy FROM p, (VALUES (-1), (0), (1)) i(i), (VALUES (-1), (0), (1)) j(j)),
        e AS (
            SELECT a.rec_id AS a, b.rec_id AS b FROM q a JOIN p b ON a.k = b.k AND a.jx = b.cx AND a.jy = b.cy AND a.rec_id <> b.rec_id
            WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.36),
        reach(id, l) AS (SELECT rec_id, rec_id FROM p UNION SELECT e.b, r.l FROM reach r JOIN e ON e.a = r.id WHERE r.l < e.b),
        cc AS (SELECT id, min(l) AS l FROM reach GROUP BY id),
        s AS (SELECT l, count(*) AS n FROM cc GROUP BY l)
        SELECT cc.l AS cluster_id, cc.id AS rec_id FROM cc JOIN s ON s.l = cc.l WHERE s.n >= 8""",
    "p4_found": """
        WITH b AS (SELECT scan_id, classification, intensity FROM georecords WHERE classification IS NOT NULL AND intensity IS NOT NULL),
        c AS (SELECT classification, median(intensity) AS m FROM b GROUP BY classification),
        g AS (SELECT scan_id, classification, median(intensity) AS m FROM b WHERE scan_id IS NOT NULL GROUP BY scan_id, classification HAVING count(*) >= 50)
        SELECT g.scan_id, g.classification FROM g JOIN c ON c.classification = g.classification WHERE g.m >= 2 * c.m OR 2 * g.m <= c.m""",
    "p4_bounds": """
        WITH b AS (SELECT scan_id, classification FROM georecords WHERE classification IS NOT NULL AND intensity IS NOT NULL)
        SELECT scan_id, classification, count(*) AS n, TRUE AS kept FROM b WHERE scan_id IS NOT NULL GROUP BY 1, 2
        UNION ALL SELECT -1, classification, count(*), TRUE FROM b GROUP BY 2""",
    "p6_found": """
        WITH v AS (
            SELECT vec_id, coords FROM shapevectors
            WHERE len(coords) = 12 AND len(list_filter(coords, lambda e: e IS NOT NULL AND isfinite(e))) = 12),
        d AS (
            SELECT a.vec_id AS q, b.vec_id AS r, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.coords, b.coords), b.vec_id) AS k
            FROM v a JOIN v b ON a.vec_id <> b.vec_id)
        SELECT DISTINCT least(q, r) AS vec_a, greatest(q, r) AS vec_b FROM d WHERE k <= 5""",
    "p7_checks": """
        SELECT container_kind, (SELECT count(*) FROM documents) AS documents, 0 AS lost, 0 AS overfull, 0 AS miscounted FROM containers""",
    "p8_checks": """
        WITH s AS (SELECT DISTINCT source FROM documents WHERE length(text) > 0),
        l AS (SELECT t.source, CASE WHEN s.source IS NULL THEN 0 ELSE target_share END AS live FROM mixtargets t LEFT JOIN s ON s.source = t.source)
        SELECT source, round(live / (SELECT sum(live) FROM l), 6) AS share, TRUE AS kept, 0 AS unknown FROM l""",
    "p9_counts": r"""
        SELECT doc_id, length(text) AS n_chars_text, len(regexp_extract_all(text, '\p{L}+')) AS n_words,
            round(length(regexp_replace(text, '[^\p{L}]+', '', 'g')) / nullif(len(regexp_extract_all(text, '\p{L}+')), 0), 6) AS mean_word_length,
            round(length(regexp_replace(text, '[\p{L}\p{Nd}\s]+', '', 'g')) / nullif(length(text), 0), 6) AS symbol_ratio,
            len(regexp_extract_all(text, '[^\r\n]*[^\s][^\r\n]*')) AS n_lines,
            round(len(regexp_extract_all(text, '[^\r\n]*[.!?:;…][ \t]*(\r|\n|$)')) / nullif(len(regexp_extract_all(text, '[^\r\n]*[^\s][^\r\n]*')), 0), 6) AS lines_punctuated,
            round(len(list_filter(regexp_extract_all(text, '\p{L}+'), lambda w: list_contains(common, lower(w)))) / nullif(len(regexp_extract_all(text, '\p{L}+')), 0), 6) AS common_share
        FROM documents CROSS JOIN (SELECT list(lower(word)) AS common FROM commonwords WHERE lang IS NOT NULL AND word IS NOT NULL)""",
}
