"""Queries of the core's training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import badrows, proximity, units
from fieldloom.plans.crs_sql import SHIFT, proximity_sql, units_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.foreign_units(*(table(spark, sf_dir, n) for n in ("georecords", "scans", "sites")))


def p1_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record in metres of EPSG:25832, with basis and confidence of its units."""
    return units.common_units(*(table(spark, sf_dir, n) for n in ("georecords", "scans", "sites")))


def p1_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units and coordinates, to the centimetre, of every record with an x."""
    rows = units.common_units(table(spark, sf_dir, "georecords").where("x is not null and not isnan(x)"), table(spark, sf_dir, "scans"), table(spark, sf_dir, "sites"))
    return rows.select("rec_id", "h_unit", "v_unit", *(F.round(F.col(c) + SHIFT, 2).alias(c) for c in ("x_m", "y_m", "z_m")))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by units and basis, with the uncertain ones counted."""
    rows = p1_metres(spark, sf_dir)
    return rows.groupBy("h_unit", "v_unit", "basis").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("uncertain").cast("bigint")).alias("n_uncertain"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proximity.near_and_within(table(spark, sf_dir, "stemroots"), table(spark, sf_dir, "plots"))


def p2_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per location: its representative, copies at the same place and neighbouring places."""
    points = proximity.checkpoint(proximity.located(table(spark, sf_dir, "stemroots").select("rec_id", "x", "y", "proj"), ["rec_id"]))
    places, members = proximity.positions(points)
    links = proximity.near_links(places)
    ends = links.select(F.col("rep_a").alias("rep")).unionByName(links.select(F.col("rep_b").alias("rep")))
    degree = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("near_places"))
    return members.join(places.select("rep", "copies"), "rep").join(degree, "rep", "left").select("rec_id", "rep", "copies", F.coalesce("near_places", F.lit(0)).alias("near_places"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return badrows.failed_lines(table(spark, sf_dir, "csvlines"), table(spark, sf_dir, "csvfiles"))


def p5_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid lines as records."""
    rows = badrows.load_lines(table(spark, sf_dir, "csvlines"), table(spark, sf_dir, "csvfiles"))
    return rows.where("reason is null").drop("reason")


QUERIES = {f.__name__: f for f in (p1_found, p1_metres, p1_positions, p1_report, p2_found, p2_places, p5_found, p5_loaded)}
SQL: dict[str, str] = {
    "p1_found": units_sql(),
    "p1_positions": units_sql(positions=True),
    "p2_found": proximity_sql(),
    # Fields are taken by a pattern after the separator is put before the line; s is the separator as the pattern needs it.
    "p5_found": r"""
        WITH f AS (SELECT file_id, sep, CASE WHEN sep = '|' THEN '\|' ELSE sep END AS s FROM csvfiles),
        h AS (
            SELECT file_id, sep, s, list_transform(regexp_extract_all(sep || regexp_replace(regexp_replace(replace(line, chr(65279), ''), '\r$', ''), '^#? *', ''), s || '("(?:[^"]|"")*"|[^"' || s || ']*)', 1),
                lambda n: trim(replace(n, '"', ''))) AS names
            FROM csvlines JOIN f USING (file_id) WHERE line_no = 1),
        l AS (SELECT file_id, line_no, regexp_replace(coalesce(line, ''), '\r$', '') AS line, sep, s, names FROM csvlines JOIN h USING (file_id) WHERE line_no > 1),
        p AS (
            SELECT *, regexp_full_match(line, '(?s)(?:[^"' || s || ']*|"(?:[^"]|"")*")(?:' || s || '(?:[^"' || s || ']*|"(?:[^"]|"")*"))*') AS quoted,
                regexp_extract_all(sep || line, s || '("(?:[^"]|"")*"|[^"' || s || ']*)', 1) AS raw FROM l),
        v AS (
            SELECT *, list_transform(list_zip(names, raw), lambda z: {'n': z[1], 'v': trim(CASE WHEN starts_with(z[2], '"') THEN replace(z[2][2:-2], '""', '"') ELSE z[2] END, ' ' || chr(9))}) AS fields FROM p),
        r AS (
            SELECT file_id, line_no, CASE WHEN NOT quoted THEN 'quoting' WHEN len(raw) <> len(names) THEN 'column_count' WHEN len(list_filter(fields, lambda x: CASE
                WHEN starts_with(x.n, 'coords.') THEN NOT regexp_full_match(x.v, '[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?') OR NOT coalesce(isfinite(TRY_CAST(ltrim(x.v, '+') AS DOUBLE)), FALSE)
                WHEN x.n = 'intensity' THEN lower(x.v) NOT IN ('', 'nan') AND NOT (regexp_full_match(x.v, '\+?[0-9]+') AND coalesce(TRY_CAST(ltrim(x.v, '+') AS BIGINT) <= 65535, FALSE))
                WHEN x.n = 'classification' THEN lower(x.v) NOT IN ('', 'nan') AND NOT (regexp_full_match(x.v, '\+?[0-9]+') AND coalesce(TRY_CAST(ltrim(x.v, '+') AS BIGINT) <= 255, FALSE))
                WHEN x.n = 'values' THEN lower(x.v) NOT IN ('', 'nan') AND (NOT regexp_full_match(x.v, '[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?') OR NOT coalesce(isfinite(TRY_CAST(ltrim(x.v, '+') AS DOUBLE)), FALSE))
                ELSE FALSE END)) > 0 THEN 'invalid_value' END AS reason FROM v)
        SELECT file_id, line_no, reason FROM r WHERE reason IS NOT NULL""",
}
