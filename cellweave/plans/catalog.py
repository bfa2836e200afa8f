"""Registered queries over the driver's tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.functions.scalars import circularity, cosine_distance, is_dark
from cellweave.operators import annotate, composition, interactions, marker_graph, neighborhoods, patches, pixels, preprocess, raster, som, spatial, stats
from cellweave.runtime import materialize, shared_dir, ship_package
from cellweave.schema import first_appearance, marker_slice, without_nan
from cellweave.sources.cells import MARKERS, bare_name, cells_view, format_spatial, image_info, list_files, marker_view, read_cells, read_names, register, split_markers, write_by_region
from cellweave.sources.registry import ResultRegistry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CNS = ["CN0", "CN1", "CN2", "CN3"]
K, THRESHOLD = 20, 0.6

CELLS = """cells AS (SELECT event_id AS cell_id, 'reg' || CAST(user_id % 8 AS VARCHAR) AS region, (event_id * 7919) % 2003 AS x,
 (event_id * 104729) % 1999 AS y, event_type AS cell_type, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS cond, value, user_id,
 'CN' || CAST((((event_id * 7919) % 2003) // 500 + ((event_id * 104729) % 1999) // 500) % 4 AS VARCHAR) AS cn FROM events)"""
LINES = "lines AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, CAST(year(l_shipdate) AS BIGINT) AS region FROM lineitem)"
#: Neighbours by brute force: the oracle's way, which the grid join replaces.
KNN = """near AS (SELECT * FROM (SELECT a.region, a.cell_id AS id, b.cell_id AS neighbor, b.cn AS cn, b.cell_type AS cell_type,
 (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2,
 row_number() OVER (PARTITION BY a.region, a.cell_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.cell_id) AS rank
 FROM cells a JOIN cells b ON a.region = b.region {where}) WHERE rank <= {k})"""


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Columns rounded to six digits, for comparison across engines."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0) for c in columns})


def r6_sql(c: str) -> str:
    return f"round(CAST({c} AS DOUBLE), 6) AS {c.split('.')[-1]}"


def events_types(spark: SparkSession, sf_dir: str) -> list[str]:
    """Event types in order: the fixed categories of the cells view."""
    return sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct().collect())


def phi_sql(v: str) -> str:
    """Standard normal distribution function of a plain column within +-6, by the series 1/2 + density * (v + v^3/3 + v^5/(3*5) + ...)."""
    series = "1.0"
    for k in range(161, 1, -2):
        series = f"(1 + {v} * {v} / {k}.0 * {series})"
    return f"(0.5 + exp(-{v} * {v} / 2) / sqrt(2 * pi()) * {v} * {series})"


def student_sql(t: str, free: str) -> str:
    """Two-sided p-value of a t statistic by the finite series for whole degrees of freedom (over 1); correlated with table ``odds``."""
    angle = f"atan(abs({t}) / sqrt({free}))"
    even = f"sin({angle}) * (SELECT sum(exp(even + 2 * j * ln(cos({angle})))) FROM odds WHERE j <= ({free} - 2) / 2)"
    odd = f"2 / pi() * ({angle} + sin({angle}) * cos({angle}) * coalesce((SELECT sum(exp(odd + 2 * j * ln(cos({angle})))) FROM odds WHERE j <= ({free} - 3) / 2), 0))"
    return f"1 - CASE WHEN {free} % 2 = 0 THEN {even} ELSE {odd} END"


#: Logarithms of 1*3*5.../2*4*6... and 2*4*6.../3*5*7..., the coefficients of that series.
ODDS = """odds AS (SELECT j, coalesce(sum(ln((2 * j - 1) / (2.0 * j))) FILTER (j > 0) OVER (ORDER BY j), 0) AS even, coalesce(sum(ln(2.0 * j / (2 * j + 1))) FILTER (j > 0) OVER (ORDER BY j), 0) AS odd
 FROM range(0, 100000) r(j))"""


# --- preprocessing ---------------------------------------------------------------------------------

KEYS = "l_orderkey, l_linenumber, region"


@query(f"WITH {LINES} SELECT * FROM lines WHERE l_quantity > 10 AND l_extendedprice > 20000")
def cell_filter(spark, sf):
    return preprocess.filter_cells(marker_view(spark, sf), "l_quantity", "l_extendedprice", 10, 20000)


@query(f"WITH {LINES} SELECT * FROM lines WHERE (CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END) * l_extendedprice > -1")
def cell_filter_negative_size(spark, sf):
    return preprocess.filter_cells(marker_view(spark, sf), "l_quantity", "l_extendedprice", 10, -1)


def _zsql(by: str) -> str:
    over = f"OVER ({by})"
    return f"WITH {LINES} SELECT " + ", ".join(f"round(({m} - avg({m}) {over}) / nullif(stddev_pop({m}) {over}, 0), 6) AS {m}" for m in MARKERS) + f", {KEYS} FROM lines"


@query(_zsql(""))
def zscore_norm(spark, sf):
    return r6(preprocess.normalise(marker_view(spark, sf), [], ["l_orderkey", "l_linenumber", "region"], "zscore"), *MARKERS)


@query(_zsql("PARTITION BY region"))
def zscore_norm_by_region(spark, sf):
    return r6(preprocess.zscore(marker_view(spark, sf), MARKERS, ["region"]), *MARKERS)


@query(
    f"WITH {LINES}, q AS (SELECT " + ", ".join(f"quantile_cont({m}, 0.01) AS a_{m}, quantile_cont({m}, 0.99) AS b_{m}" for m in MARKERS) + " FROM lines) SELECT "
    + ", ".join(f"round((least(greatest({m}, a_{m}), b_{m}) - a_{m}) / nullif(b_{m} - a_{m}, 0), 6) AS {m}" for m in MARKERS) + f", {KEYS} FROM lines, q"
)
def minmax_norm(spark, sf):
    return r6(preprocess.minmax(marker_view(spark, sf), MARKERS), *MARKERS)


@query(f"WITH {LINES} SELECT " + ", ".join(f"round(asinh({m} / 150), 6) AS {m}" for m in MARKERS) + f", {KEYS} FROM lines")
def arcsinh_norm(spark, sf):
    return r6(preprocess.arcsinh(marker_view(spark, sf), MARKERS), *MARKERS)


_ROW_MEAN = "(" + " + ".join(MARKERS) + f") / {len(MARKERS)}"


@query(
    f"WITH {LINES}, z AS (SELECT {KEYS}, " + ", ".join(f"({m} - avg({m}) OVER ()) / nullif(stddev_pop({m}) OVER (), 0) AS {m}" for m in MARKERS) + f" FROM lines), a AS (SELECT *, {_ROW_MEAN} AS mean FROM z), "
    "d AS (SELECT *, sqrt((" + " + ".join(f"({m} - mean) * ({m} - mean)" for m in MARKERS) + f") / {len(MARKERS)}) AS std FROM a), "
    f"n AS (SELECT {KEYS}, " + ", ".join(f"({m} - mean) / nullif(std, 0) AS {m}" for m in MARKERS) + f" FROM d) SELECT {KEYS}, " + ", ".join(f"round(-ln(1 - {phi_sql(m)}), 6) AS {m}" for m in MARKERS) + " FROM n"
)
def double_zscore(spark, sf):
    return r6(preprocess.normalise(marker_view(spark, sf), [], ["l_orderkey", "l_linenumber", "region"], "double_zscore"), *MARKERS)


_TOTAL = " + ".join(MARKERS)


@query(f"WITH {LINES} SELECT " + ", ".join(f"round(log2(0.001 + coalesce({m} / nullif({_TOTAL}, 0), 0)), 6) + 0 AS {m}" for m in MARKERS) + f", {KEYS} FROM lines")
def log2_share_norm(spark, sf):
    return r6(preprocess.log2_share(marker_view(spark, sf), MARKERS), *MARKERS)


@query(
    f"WITH {LINES} SELECT " + ", ".join(f"round(least(greatest(({m} - avg({m}) OVER w) / nullif(stddev_samp({m}) OVER w, 0), -1.5), 1.5), 6) AS {m}" for m in MARKERS)
    + f", {KEYS} FROM lines WINDOW w AS (PARTITION BY region)"
)
def group_znorm_clip(spark, sf):
    return r6(preprocess.group_zscore(marker_view(spark, sf), "region", MARKERS, -1.5, 1.5), *MARKERS)


_Z = f"{LINES}, z AS (SELECT {KEYS}, " + ", ".join(f"({m} - avg({m}) OVER ()) / nullif(stddev_pop({m}) OVER (), 0) AS {m}" for m in MARKERS) + " FROM lines), s AS (SELECT *, " + " + ".join(
    f"(CASE WHEN {m} >= 0 THEN 1 ELSE 0 END)" for m in MARKERS
) + " AS marker_count, " + " + ".join(f"coalesce({m}, 0)" for m in MARKERS) + " AS z_sum FROM z)"


@query(f"WITH {_Z} SELECT {KEYS}, marker_count, round(z_sum, 6) AS z_sum, z_sum > 3 OR marker_count > 3 AS noisy FROM s")
def noise_split(spark, sf):
    z = preprocess.zscore(marker_view(spark, sf), MARKERS)
    clean, noisy = preprocess.remove_noise(z, MARKERS, 3, 3)
    parts = preprocess.noise_scores(clean, MARKERS).withColumn("noisy", F.lit(False)).unionByName(noisy.withColumn("noisy", F.lit(True)))
    return r6(parts.select("l_orderkey", "l_linenumber", "region", "marker_count", "z_sum", "noisy"), "z_sum")


@query(f"WITH {_Z} SELECT round(quantile_cont(marker_count, 0.99), 6) AS count_limit, round(quantile_cont(z_sum, 0.99), 6) AS z_sum_limit FROM s")
def noise_thresholds(spark, sf):
    return r6(preprocess.noise_thresholds(preprocess.zscore(marker_view(spark, sf), MARKERS), MARKERS), "count_limit", "z_sum_limit")


@query(f"WITH {LINES} SELECT CAST(CASE WHEN l_quantity < 0 THEN 0 WHEN l_quantity >= 50 THEN 11 ELSE floor(l_quantity / 5) + 1 END AS BIGINT) AS bin, count(*) AS n FROM lines GROUP BY 1")
def score_histogram(spark, sf):
    return preprocess.score_histogram(marker_view(spark, sf), "l_quantity", 0.0, 50.0, 10)


@query(
    f"WITH {CELLS}, f AS (SELECT region, min(cell_id) AS m FROM cells GROUP BY region), o AS (SELECT region, row_number() OVER (ORDER BY m, region) - 1 AS n FROM f) "
    "SELECT cell_id, c.region, x + (n % 3) * 2003 AS x_corr, y + (n // 3) * 1999 AS y_corr FROM cells c JOIN o ON c.region = o.region"
)
def tile_offset(spark, sf):
    return preprocess.tile_offsets(cells_view(spark, sf), "region", "cell_id", 3, 3, "x", "y", 2003, 1999).select("cell_id", "region", "x_corr", "y_corr")


@query(f"WITH {CELLS} SELECT cell_id, x + (user_id % 8 % 3) * 2003 AS x_corr, y + (user_id % 8 // 3) * 1999 AS y_corr FROM cells")
def tile_offset_numbered(spark, sf):
    cells = cells_view(spark, sf).withColumn("number", F.col("user_id") % 8 + 1)
    return preprocess.numbered_tile_offsets(cells, "number", 3, "x", "y", 2003, 1999).select("cell_id", "x_corr", "y_corr")


@query(
    f"WITH {CELLS} SELECT region, greatest(min(x) * 2 - 50, 0) AS x_min, least(max(x) * 2 + 50, 4000) AS x_max, greatest(min(y) * 2 - 50, 0) AS y_min, "
    "least(max(y) * 2 + 50, 4000) AS y_max FROM cells WHERE cell_type = 'purchase' GROUP BY region"
)
def bbox_by_group(spark, sf):
    return preprocess.bounding_boxes(cells_view(spark, sf).where("cell_type = 'purchase'"), "region", "x", "y", 2, 50, 4000, 4000)


@query(f"WITH {CELLS} SELECT cell_id, region, x - min(x) OVER w AS x, y - min(y) OVER w AS y FROM cells WINDOW w AS (PARTITION BY region)")
def region_origin_shift(spark, sf):
    return preprocess.origin_shift(cells_view(spark, sf).select("cell_id", "region", "x", "y"), "region", "x", "y")


def _rank_sql(i: int) -> str:
    m = MARKERS[i]
    return " + ".join(f"(CASE WHEN {o} < {m}{f' OR {o} = {m}' if j < i else ''} THEN 1 ELSE 0 END)" for j, o in enumerate(MARKERS) if j != i) + f" AS {m}"


@query(f"WITH {LINES} SELECT {KEYS}, " + ", ".join(f"CAST({_rank_sql(i).rsplit(' AS ', 1)[0]} AS BIGINT) AS {m}" for i, m in enumerate(MARKERS)) + " FROM lines")
def marker_ranks(spark, sf):
    return preprocess.row_ranks(marker_view(spark, sf), MARKERS)


# --- pixels and features ---------------------------------------------------------------------------

#: Pixels of small label masks, made from the cells: 40 x 40 places an image, labels in blocks of 7 x 9, channel values from ids.
PIXELS = """px AS (SELECT 'img' || CAST(event_id // 1600 AS VARCHAR) AS image, event_id % 1600 // 40 AS y, event_id % 40 AS x,
 CASE WHEN event_id % 1600 // 40 % 7 = 0 THEN 0 ELSE event_id % 1600 // 40 // 7 * 5 + event_id % 40 // 9 + 1 END AS label,
 event_id * 7919 % 101 AS c1, event_id * 104729 % 97 AS c2 FROM events)"""


def pixel_view(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels of label masks of 40 x 40 places, as many as all events fill, as in PIXELS."""
    return spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "concat('img', cast(event_id div 1600 as string)) as image", "(event_id % 1600) div 40 as y", "event_id % 40 as x",
        "case when ((event_id % 1600) div 40) % 7 = 0 then 0 else ((event_id % 1600) div 40) div 7 * 5 + (event_id % 40) div 9 + 1 end as label",
        "event_id * 7919 % 101 as c1", "event_id * 104729 % 97 as c2",
    )


@query(f"WITH {PIXELS} SELECT image, label, round(avg(greatest(c1, c2)), 6) AS cm, round(avg(c1), 6) AS c1, count(*) AS area FROM px WHERE label <> 0 GROUP BY image, label HAVING count(*) > 3")
def channel_max_and_label_mean(spark, sf):
    px = pixels.combine_channels(pixel_view(spark, sf), ["c1", "c2"], "cm")
    return r6(pixels.label_features(px, ["cm", "c1"], 3).select("image", "label", "cm", "c1", "area"), "cm", "c1")


@query(
    f"WITH {PIXELS}, m AS (SELECT image, label, avg(y) AS cy, avg(x) AS cx, count(*) AS area, var_pop(y) + 1.0/12 AS vy, var_pop(x) + 1.0/12 AS vx, covar_pop(y, x) AS vxy FROM px WHERE label <> 0 GROUP BY image, label), "
    "a AS (SELECT *, 4 * sqrt((vy + vx + sqrt((vy - vx) * (vy - vx) + 4 * vxy * vxy)) / 2) AS major, 4 * sqrt(greatest(0, (vy + vx - sqrt((vy - vx) * (vy - vx) + 4 * vxy * vxy)) / 2)) AS minor FROM m) "
    "SELECT image, label, round(cy, 6) AS y, round(cx, 6) AS x, area, round(major, 6) AS axis_major_length, round(minor, 6) AS axis_minor_length, round(sqrt(greatest(0, 1 - minor * minor / (major * major))), 4) AS eccentricity FROM a"
)
def label_shapes(spark, sf):
    f = pixels.label_features(pixel_view(spark, sf), [])
    f = r6(f.select("image", "label", "y", "x", "area", "axis_major_length", "axis_minor_length", "eccentricity"), "y", "x", "axis_major_length", "axis_minor_length")
    return f.withColumn("eccentricity", F.round("eccentricity", 4))


def blob_view(spark: SparkSession, sf: str) -> DataFrame:
    """The pixels of ``pixel_view`` with ragged labels, as in BLOBS."""
    inside = F.expr("(y % 7 - 3) * (y % 7 - 3) + (x % 9 - 4) * (x % 9 - 4) + (y * 31 + x * 17 + y * x) % 7 <= 16")
    return pixel_view(spark, sf).withColumn("label", F.when(inside, F.col("label")).otherwise(0))


BLOBS = f"""{PIXELS}, blobs AS (SELECT image, y, x, label FROM px WHERE label <> 0 AND (y % 7 - 3) * (y % 7 - 3) + (x % 9 - 4) * (x % 9 - 4) + (y * 31 + x * 17 + y * x) % 7 <= 16)"""


@query(
    f"WITH {BLOBS}, four AS (SELECT a.image, a.label, a.y, a.x, count(b.x) AS n FROM blobs a LEFT JOIN blobs b ON a.image = b.image AND a.label = b.label AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY ALL), "
    "border AS (SELECT image, label, y, x FROM four WHERE n < 4), "
    "code AS (SELECT a.image, a.label, a.y, a.x, 1 + 2 * count(*) FILTER (abs(a.y - b.y) + abs(a.x - b.x) = 1) + 10 * count(*) FILTER (abs(a.y - b.y) = 1 AND abs(a.x - b.x) = 1) AS c "
    "FROM border a LEFT JOIN border b ON a.image = b.image AND a.label = b.label AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL) "
    "SELECT image, label, round(sum(CASE WHEN c IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN c IN (21, 33) THEN sqrt(2) WHEN c IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END), 6) AS perimeter FROM code GROUP BY image, label"
)
def label_perimeters(spark, sf):
    return r6(pixels.label_perimeters(blob_view(spark, sf)), "perimeter")


@query(
    f"WITH {BLOBS}, r AS (SELECT image, label, y, min(x) AS a, max(x) AS b FROM blobs GROUP BY ALL), "
    "c AS (SELECT image, label, unnest([2 * a - 1, 2 * b + 1, 2 * a, 2 * a, 2 * b, 2 * b]) AS x, unnest([2 * y, 2 * y, 2 * y - 1, 2 * y + 1, 2 * y - 1, 2 * y + 1]) AS y FROM r), p AS (SELECT DISTINCT * FROM c), "
    "e AS (SELECT a.image, a.label, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM p a JOIN p b ON a.image = b.image AND a.label = b.label AND (a.x <> b.x OR a.y <> b.y) JOIN p c ON a.image = c.image AND a.label = c.label "
    "GROUP BY ALL HAVING min((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) >= 0), "
    "box AS (SELECT image, label, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1, count(*) AS area FROM blobs GROUP BY ALL), "
    "spot AS (SELECT image, label, unnest(range(y0, y1 + 1)) AS y, x0, x1 FROM box), spots AS (SELECT image, label, y, unnest(range(x0, x1 + 1)) AS x FROM spot), "
    "held AS (SELECT s.image, s.label, s.y, s.x FROM spots s JOIN e ON e.image = s.image AND e.label = s.label GROUP BY ALL HAVING min((bx - ax) * (2 * s.y - ay) - (by_ - ay) * (2 * s.x - ax)) >= 0) "
    "SELECT h.image, h.label, any_value(area) AS area, count(*) AS convex_area, round(any_value(area) / count(*), 6) AS solidity FROM held h JOIN box ON box.image = h.image AND box.label = h.label GROUP BY h.image, h.label"
)
def label_hulls(spark, sf):
    return r6(pixels.label_hulls(blob_view(spark, sf)), "solidity")


_TOUCH = f"""{PIXELS}, t AS (SELECT a.image, a.y, a.x, a.label AS a, b.label AS b FROM px a JOIN px b ON a.image = b.image
 AND abs(a.y - b.y) + abs(a.x - b.x) = 1 WHERE a.label <> 0 AND a.label <> b.label)"""


@query(f"WITH {_TOUCH} SELECT image, a, b, count(*) AS n FROM t WHERE b <> 0 GROUP BY image, a, b UNION ALL SELECT image, a, a AS b, count(*) AS n FROM (SELECT DISTINCT image, y, x, a FROM t) GROUP BY image, a")
def pixel_adjacency(spark, sf):
    return pixels.adjacency(pixel_view(spark, sf))


@query(f"WITH {_TOUCH} SELECT DISTINCT image, y, x, a AS label FROM t")
def mask_outlines(spark, sf):
    return pixels.outlines(pixel_view(spark, sf))


_FLOOD = "steps(dy, dx) AS (VALUES (0, 1), (0, -1), (1, 0), (-1, 0))"
_NEXT = "s.image = t.image AND s.y + dy = t.y AND s.x + dx = t.x"


@query(
    f"WITH RECURSIVE {PIXELS}, {_FLOOD}, over AS (SELECT image, y, x, (c1 * 31 + c2 * 17 + c1 * c2) % 101 AS v FROM px WHERE (c1 * 31 + c2 * 17 + c1 * c2) % 101 > 54), "
    f"seen AS (SELECT image, y, x FROM over WHERE v >= 96 UNION SELECT t.image, t.y, t.x FROM seen s CROSS JOIN steps JOIN over t ON {_NEXT}), "
    "frame AS (SELECT image, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM px GROUP BY image), outside AS (SELECT image, y, x FROM px ANTI JOIN seen USING (image, y, x)), "
    "bare AS (SELECT image, y, x FROM outside JOIN frame USING (image) WHERE y IN (y0, y1) OR x IN (x0, x1) "
    f"UNION SELECT t.image, t.y, t.x FROM bare s CROSS JOIN steps JOIN outside t ON {_NEXT}), "
    "tissue AS (SELECT image, y, x FROM px ANTI JOIN bare USING (image, y, x)), "
    f"reached AS (SELECT image, y, x, y * 2147483648 + x AS piece FROM tissue UNION SELECT t.image, t.y, t.x, s.piece FROM reached s CROSS JOIN steps JOIN tissue t ON {_NEXT}) "
    "SELECT image, y, x, min(piece) AS piece FROM reached GROUP BY image, y, x"
)
def tissue_pieces(spark, sf):
    px = pixel_view(spark, sf).selectExpr("image", "y", "x", "(c1 * 31 + c2 * 17 + c1 * c2) % 101 as v")
    return raster.label_tissue(px, "v", 54, 96)


@query()
def spill_compensation(spark, sf):
    return pixels.compensate(pixel_view(spark, sf), ["c1", "c2"])


_HALVES = f"""{PIXELS}, half AS (SELECT image, y, x, CASE WHEN y % 13 = 0 THEN 0 WHEN x < 15 + y * 7 % 11 THEN 1 ELSE 2 END AS label, c1 * (CASE WHEN x < 15 + y * 7 % 11 THEN 1 ELSE 3 END) AS c1, c2 FROM px)"""


@query(
    f"WITH {_HALVES}, t AS (SELECT a.image, a.y, a.x, a.label AS a, b.label AS b FROM half a JOIN half b ON a.image = b.image AND abs(a.y - b.y) + abs(a.x - b.x) = 1 WHERE a.label <> 0 AND a.label <> b.label), "
    "m AS (SELECT image, label, avg(c1) AS c1, avg(c2) AS c2 FROM half WHERE label <> 0 GROUP BY ALL), border AS (SELECT image, a, count(DISTINCT y * 100 + x) AS n FROM t GROUP BY ALL), "
    "share AS (SELECT t.image, t.a, count(*) / (2.0 * any_value(border.n)) AS u FROM t JOIN border ON border.image = t.image AND border.a = t.a WHERE t.b <> 0 GROUP BY ALL), "
    "pair AS (SELECT m.image, m.label, m.c1, m.c2, coalesce(o.c1, 0) AS o1, coalesce(o.c2, 0) AS o2, coalesce(s.u, 0) AS u, coalesce(v.u, 0) AS v FROM m LEFT JOIN m o ON o.image = m.image AND o.label <> m.label "
    "LEFT JOIN share s ON s.image = m.image AND s.a = m.label LEFT JOIN share v ON v.image = m.image AND v.a <> m.label) "
    "SELECT image, label, round(greatest((c1 - u * o1) / (1 - u * v), 0), 6) AS c1, round(greatest((c2 - u * o2) / (1 - u * v), 0), 6) AS c2_compensated FROM pair"
)
def compensated_halves(spark, sf):
    """Two labels an image: the sparse solver against the closed form, its means joined to cells both ways."""
    first = F.col("x") < 15 + F.col("y") * 7 % 11
    px = pixel_view(spark, sf).withColumns({"label": F.when(F.col("y") % 13 == 0, 0).when(first, 1).otherwise(2), "c1": F.col("c1") * F.when(first, 1).otherwise(3)})
    solved = pixels.compensate(px, ["c1", "c2"])
    cells = px.where("label <> 0").groupBy("image", "label").agg(F.lit(-1.0).alias("c1"))
    over = pixels.compensate_cells(cells, solved.drop("c2"), ["c1"])
    beside = pixels.compensate_cells(over, solved.drop("c1"), ["c2"], overwrite=False)
    return r6(beside.select("image", "label", "c1", "c2_compensated"), "c1", "c2_compensated")


@query(f"WITH {PIXELS} SELECT image, y, x, CASE WHEN label <> 0 AND x % 3 <> 0 THEN label ELSE 0 END AS cytoplasm FROM px")
def compartment_split(spark, sf):
    px = pixel_view(spark, sf).withColumn("nucleus", F.when(F.col("x") % 3 == 0, F.col("label")).otherwise(0))
    return pixels.split_compartments(px, "label", "nucleus").select("image", "y", "x", "cytoplasm")


@query("SELECT label AS cell_type, count(*) AS n, round(avg(embedding[1]), 6) AS f0 FROM embeddings GROUP BY label")
def feature_split(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("m", F.col("embedding")[0])
    return r6(split_markers(e, ["m"]).groupBy(F.col("label").alias("cell_type")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("features")[0]).alias("f0")), "f0")


@query("SELECT DISTINCT event_type AS tissue, 'reg00' || CAST(user_id % 8 AS VARCHAR) AS region, '/out/' || event_type || '/reg00' || CAST(user_id % 8 AS VARCHAR) || '.png' AS path FROM events WHERE event_type NOT IN ('login')")
def path_info_distinct(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").where(~F.col("event_type").isin("login"))
    e = e.withColumn("region", F.concat(F.lit("reg00"), (F.col("user_id") % 8).cast("string")))
    return image_info(e, "event_type", "region", "/out")


# --- composition -----------------------------------------------------------------------------------


@query(f"WITH {CELLS} SELECT region, cell_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY region), 6) AS share FROM cells GROUP BY region, cell_type")
def category_share(spark, sf):
    return r6(composition.share(cells_view(spark, sf), ["region"], "cell_type"), "share")


_GRID = """g AS (SELECT cond, region, cell_type, count(*) AS n FROM base GROUP BY cond, region, cell_type), t AS (SELECT cond, region, sum(n) AS total FROM g GROUP BY cond, region),
 k AS (SELECT DISTINCT cell_type FROM g)"""


@query(
    f"WITH {CELLS}, base AS (SELECT * FROM cells), {_GRID} SELECT t.cond, t.region, k.cell_type, round(100.0 * coalesce(g.n, 0) / t.total, 6) AS percent FROM t CROSS JOIN k "
    "LEFT JOIN g ON g.cond = t.cond AND g.region = t.region AND g.cell_type = k.cell_type"
)
def category_share_replicate_densified(spark, sf):
    return r6(composition.densified_share(cells_view(spark, sf), ["cond", "region"], "cell_type"), "percent")


@query(
    f"WITH {CELLS}, base AS (SELECT * FROM cells WHERE cell_type IN ('click', 'purchase')), {_GRID} SELECT t.cond, t.region, k.cell_type, round(100.0 * coalesce(g.n, 0) / t.total, 6) AS percent FROM t CROSS JOIN k "
    "LEFT JOIN g ON g.cond = t.cond AND g.region = t.region AND g.cell_type = k.cell_type"
)
def share_within_subset(spark, sf):
    return r6(composition.densified_share(cells_view(spark, sf), ["cond", "region"], "cell_type", ["click", "purchase"], True), "percent")


@query(
    f"WITH {CELLS}, base AS (SELECT * FROM cells), {_GRID} SELECT t.cond, t.region, k.cell_type, round(100.0 * coalesce(g.n, 0) / t.total, 6) AS percent FROM t CROSS JOIN k "
    "LEFT JOIN g ON g.cond = t.cond AND g.region = t.region AND g.cell_type = k.cell_type WHERE k.cell_type IN ('click', 'purchase')"
)
def share_of_subset_in_all(spark, sf):
    return r6(composition.densified_share(cells_view(spark, sf), ["cond", "region"], "cell_type", ["click", "purchase"], False), "percent")


_CN_COUNTS = ", ".join(f"CAST(sum(CASE WHEN cn = '{c}' THEN 1 ELSE 0 END) AS BIGINT) AS {c}" for c in CNS)


@query(f"WITH {CELLS} SELECT region, {_CN_COUNTS} FROM cells GROUP BY region")
def crosstab_counts(spark, sf):
    return composition.wide_table(cells_view(spark, sf), "region", "cn", CNS)


@query(f"WITH {CELLS} SELECT region, " + ", ".join(f"round(100.0 * sum(CASE WHEN cn = '{c}' THEN 1 ELSE 0 END) / count(*), 6) AS {c}" for c in CNS) + " FROM cells GROUP BY region")
def crosstab_pct(spark, sf):
    return r6(composition.wide_table(cells_view(spark, sf), "region", "cn", CNS, percent=True), *CNS)


@query(
    "WITH c AS (SELECT o_orderpriority AS grp, o_orderstatus AS category, count(*) AS n FROM orders GROUP BY 1, 2) SELECT grp, category, n, "
    "round(100.0 * n / sum(n) OVER (PARTITION BY grp), 6) AS share FROM c"
)
def stacked_shares(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderpriority").alias("grp"), F.col("o_orderstatus").alias("category"))
    return r6(composition.share(o, ["grp"], "category"), "share")


@query("SELECT n_name AS donor, c_mktsegment AS category, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY n_name), 6) AS share FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment")
def donor_composition(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").join(spark.read.parquet(f"{sf}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey"))
    return r6(composition.share(c.select(F.col("n_name").alias("donor"), F.col("c_mktsegment").alias("category")), ["donor"], "category"), "share")


@query(f"WITH {CELLS} SELECT cond, count(DISTINCT region) AS n_distinct FROM cells GROUP BY cond")
def regions_per_sample(spark, sf):
    return composition.distinct_per_group(cells_view(spark, sf), "cond", "region")


@query(f"WITH {CELLS}, p AS (SELECT region, 1.0 * count(*) / sum(count(*)) OVER (PARTITION BY region) AS p FROM cells GROUP BY region, cell_type) SELECT region, round(-sum(p * ln(p)), 6) AS shannon FROM p GROUP BY region")
def shannon_by_group(spark, sf):
    return r6(composition.shannon(cells_view(spark, sf), ["region"], "cell_type"), "shannon")


@query(
    f"WITH {CELLS}, n AS (SELECT cn, cell_type, count(*) AS n FROM cells GROUP BY cn, cell_type), a AS (SELECT cell_type, sum(n) / sum(sum(n)) OVER () AS avg FROM n GROUP BY cell_type), "
    "g AS (SELECT DISTINCT cn FROM n), v AS (SELECT g.cn, a.cell_type, a.avg, coalesce(n.n, 0) * 10.0 / sum(coalesce(n.n, 0)) OVER (PARTITION BY g.cn) + a.avg AS v FROM g CROSS JOIN a LEFT JOIN n ON n.cn = g.cn AND n.cell_type = a.cell_type) "
    "SELECT cn, cell_type, round(log2(v / sum(v) OVER (PARTITION BY cn) / avg), 6) AS enrichment FROM v"
)
def cn_enrichment_log2(spark, sf):
    return r6(composition.enrichment(cells_view(spark, sf), "cn", "cell_type"), "enrichment")


_PAIRS = [(a, b) for i, a in enumerate(MARKERS) for b in MARKERS[i + 1 :]]


@query(f"WITH {LINES} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lines" for a, b in _PAIRS))
def corr_pairs(spark, sf):
    return r6(composition.wide_correlations(marker_view(spark, sf), MARKERS), "corr")


_LONG = f"{CELLS}, l AS (SELECT region, cell_type, sum(value) AS v FROM cells GROUP BY region, cell_type)"


@query(f"WITH {_LONG} SELECT p.cell_type AS a, q.cell_type AS b, round(corr(p.v, q.v), 6) AS corr FROM l p JOIN l q ON p.region = q.region AND p.cell_type < q.cell_type GROUP BY 1, 2")
def corr_long(spark, sf):
    sums = cells_view(spark, sf).groupBy("region", "cell_type").agg(F.sum("value").alias("v"))
    return r6(composition.long_correlations(sums, ["region"], "cell_type", "v"), "corr")


@query(f"WITH {_LONG}, c AS (SELECT p.cell_type AS a, q.cell_type AS b, corr(p.v, q.v) AS corr FROM l p JOIN l q ON p.region = q.region AND p.cell_type < q.cell_type GROUP BY 1, 2) SELECT a, b, round(corr, 6) AS corr FROM c WHERE abs(corr) > 0.1")
def corr_top_abs(spark, sf):
    sums = cells_view(spark, sf).groupBy("region", "cell_type").agg(F.sum("value").alias("v"))
    return r6(composition.top_correlations(composition.long_correlations(sums, ["region"], "cell_type", "v"), 0.1), "corr")


@query(f"WITH {_LONG}, c AS (SELECT p.cell_type AS a, q.cell_type AS b, corr(p.v, q.v) AS corr FROM l p JOIN l q ON p.region = q.region AND p.cell_type < q.cell_type GROUP BY 1, 2) SELECT a, b, round(corr, 6) AS corr FROM c WHERE abs(corr) > 0.05 AND 'purchase' IN (a, b)")
def corr_touching(spark, sf):
    sums = cells_view(spark, sf).groupBy("region", "cell_type").agg(F.sum("value").alias("v"))
    return r6(composition.correlations_touching(composition.long_correlations(sums, ["region"], "cell_type", "v"), 0.05, "purchase"), "corr")


@query("SELECT o_orderpriority AS grp, round(regr_slope(o_totalprice, o_custkey), 6) AS slope, round(regr_intercept(o_totalprice, o_custkey), 3) AS intercept, round(corr(CAST(o_custkey AS DOUBLE), o_totalprice), 6) AS corr FROM orders GROUP BY 1")
def scatter_fit(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").withColumnRenamed("o_orderpriority", "grp")
    return r6(composition.linear_fit(o, ["grp"], "o_custkey", "o_totalprice"), "slope", "corr").withColumn("intercept", F.round("intercept", 3))


@query(f"WITH {CELLS} SELECT cell_id, region, cell_type FROM cells WHERE cell_type IN ('click', 'view') AND cond IN ('a') AND cn IN ('CN0', 'CN3')")
def dict_filter(spark, sf):
    return composition.dict_filter(cells_view(spark, sf), {"cell_type": ["click", "view"], "cond": ["a"], "cn": ["CN0", "CN3"]}).select("cell_id", "region", "cell_type")


@query(
    "SELECT n_name, n_nationkey, coalesce(r_name, 'Unknown') AS r_name FROM (SELECT n_name, n_nationkey, n_regionkey FROM nation) LEFT JOIN (SELECT r_regionkey, r_name FROM region WHERE r_regionkey < 4) ON n_regionkey = r_regionkey"
)
def missing_metadata_join(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select("n_name", "n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    r = spark.read.parquet(f"{sf}/region.parquet").where("r_regionkey < 4")
    return composition.region_metadata(n, r, "r_regionkey", ["r_name"]).drop("r_regionkey")


# --- neighbourhoods --------------------------------------------------------------------------------


def _windows_sql(labels: list[str], column: str, k: int, where: str = "", rank: int | None = None) -> str:
    counts = ", ".join(f"CAST(sum(CASE WHEN {column} = '{c}' THEN 1 ELSE 0 END) AS BIGINT) AS \"{c}\"" for c in labels)
    return f"WITH {CELLS}, {KNN.format(where=where, k=k)} SELECT region, id, {counts} FROM near {f'WHERE rank <= {rank} ' if rank else ''}GROUP BY region, id"


def _windows(spark, sf, k: int, include_self: bool, label: str = "cn", labels: list[str] | None = None) -> DataFrame:
    return spatial.nearest_windows(cells_view(spark, sf), k, label, labels or CNS, include_self=include_self)


@query(_windows_sql(CNS, "cn", K))
def knn_windows_self(spark, sf):
    return _windows(spark, sf, K, True)


@query(_windows_sql(CNS, "cn", K, "AND a.cell_id <> b.cell_id"))
def knn_windows_noself(spark, sf):
    return _windows(spark, sf, K, False)


@query(f"WITH {CELLS}, {KNN.format(where='', k=10)}, ks AS (SELECT unnest([3, 10]) AS k) SELECT region, id, CAST(k AS INTEGER) AS k, " + _CN_COUNTS + " FROM near JOIN ks ON rank <= k GROUP BY region, id, k")
def knn_multi_k(spark, sf):
    near = spatial.knn(cells_view(spark, sf), 10, extra=("cn",))
    parts = [spatial.neighbour_windows(near, "cn", CNS, k).withColumn("k", F.lit(k)) for k in (3, 10)]
    return parts[0].unionByName(parts[1])


#: Minimal combinations in SQL: labels in descending count, kept while the sum before them does not exceed the limit.
_COMBOS = f"""{CELLS}, {KNN.format(where="AND a.cell_id <> b.cell_id", k=K)}, ct AS (SELECT region, id, cn, count(*) AS n FROM near GROUP BY region, id, cn),
 total AS (SELECT region, id, sum(n) AS tot FROM ct GROUP BY region, id),
 pre AS (SELECT region, id, CAST(substr(cn, 3) AS INTEGER) AS i, n, coalesce(sum(n) OVER (PARTITION BY region, id ORDER BY n DESC, cn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ct),
 combos AS (SELECT p.region, p.id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS combination FROM pre p JOIN total t ON p.region = t.region AND p.id = t.id
 WHERE before <= {THRESHOLD * K} AND (before = 0 OR tot > {THRESHOLD * K}) GROUP BY p.region, p.id)"""


def _combinations(spark, sf) -> DataFrame:
    return neighborhoods.combinations(_windows(spark, sf, K, False), CNS, K, THRESHOLD)


@query(f"WITH {_COMBOS} SELECT region, id, combination FROM combos")
def minimal_combos(spark, sf):
    return _combinations(spark, sf).select("region", "id", F.array_join("combination", ",").alias("combination"))


_FREQ = f"""{_COMBOS}, n AS (SELECT combination, count(*) AS n FROM combos GROUP BY combination),
 freqs AS (SELECT combination, n, n / sum(n) OVER () AS freq, sum(n) OVER (ORDER BY n DESC, combination ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(n) OVER () AS cum_freq FROM n)"""


@query(f"WITH {_FREQ} SELECT combination, n, round(freq, 6) AS freq, round(cum_freq, 6) AS cum_freq, round(freq, 6) AS marginal FROM freqs")
def combo_frequency_cumulative(spark, sf):
    return r6(neighborhoods.combination_frequencies(_combinations(spark, sf)), "freq", "cum_freq", "marginal")


@query(
    f"WITH {_FREQ}, s AS (SELECT combination, string_split(combination, ',') AS items FROM freqs WHERE freq >= 0.001) SELECT a.combination AS src, b.combination AS dst FROM s a JOIN s b "
    "ON len(b.items) = len(a.items) + 1 AND list_has_all(b.items, a.items)"
)
def combo_dag(spark, sf):
    return neighborhoods.combination_graph(neighborhoods.combination_frequencies(_combinations(spark, sf)))


@query(f"WITH {_FREQ} SELECT combination, n FROM freqs ORDER BY n DESC, combination LIMIT 5")
def combo_top(spark, sf):
    return neighborhoods.top_combinations(neighborhoods.combination_frequencies(_combinations(spark, sf)), 5).select("combination", "n")


_DONORS = [f"reg{i}" for i in range(8)]


@query(
    f"WITH {_COMBOS}, d AS (SELECT region, combination, count(*) AS n FROM combos GROUP BY region, combination), f AS (SELECT region, combination, n / sum(n) OVER (PARTITION BY region) AS freq FROM d) SELECT combination, "
    + ", ".join(f"round(max(CASE WHEN region = '{r}' THEN freq ELSE 0 END), 6) AS {r}" for r in _DONORS) + " FROM f GROUP BY combination HAVING count(*) >= 3"
)
def combo_by_donor(spark, sf):
    return r6(neighborhoods.combinations_by_donor(_combinations(spark, sf), "region", _DONORS, 3), *_DONORS)


@query(f"WITH {_COMBOS} SELECT region, CAST(len(string_split(combination, ',')) AS INTEGER) AS size, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY region), 6) AS share FROM combos GROUP BY 1, 2")
def combo_size_distribution(spark, sf):
    return r6(neighborhoods.combination_sizes(_combinations(spark, sf), ["region"]), "share")


@query(
    "WITH w AS (" + _windows_sql(CNS, "cn", K).replace("WITH", "WITH", 1) + ") SELECT region, id, round((CN1 * 0.5 + CN2) / (CN0 + CN1 + CN2), 6) AS px, "
    "round(CN1 * sin(pi() / 3) / (CN0 + CN1 + CN2), 6) AS py FROM w WHERE CN0 + CN1 + CN2 > 12"
)
def barycentric_projection(spark, sf):
    return r6(neighborhoods.barycentric(_windows(spark, sf, K, True), CNS[:3], 12).select("region", "id", "px", "py"), "px", "py")


@query()
def cn_kmeans(spark, sf):
    labelled, _ = neighborhoods.cluster_windows(_windows(spark, sf, K, True, "cell_type", events_types(spark, sf)), events_types(spark, sf), 4)
    return labelled


@query(
    f"WITH {CELLS}, {KNN.format(where='', k=K)}, n AS (SELECT c.cn, near.cell_type AS label, count(*) AS n FROM near JOIN cells c ON c.cell_id = near.id GROUP BY 1, 2), w AS (SELECT cn, count(*) AS n FROM cells GROUP BY cn), "
    "a AS (SELECT cell_type AS label, count(*) / sum(count(*)) OVER () AS avg FROM cells GROUP BY cell_type), "
    "v AS (SELECT w.cn, a.label, avg, coalesce(n.n, 0) / w.n + avg AS v FROM w CROSS JOIN a LEFT JOIN n ON n.cn = w.cn AND n.label = a.label) "
    "SELECT cn, label, round(log2(v / sum(v) OVER (PARTITION BY cn) / avg), 6) AS enrichment FROM v"
)
def centroid_enrichment(spark, sf):
    types = events_types(spark, sf)
    cells = cells_view(spark, sf)
    windows = _windows(spark, sf, K, True, "cell_type", types).join(cells.select(F.col("cell_id").alias("id"), "cn"), "id")
    centres = windows.groupBy("cn").agg(*[F.avg(t).alias(t) for t in types]).unpivot("cn", types, "label", "value")
    average = composition.share(cells, [], "cell_type", 1.0).select(F.col("cell_type").alias("label"), F.col("share").alias("avg"))
    return r6(composition.centroid_enrichment(centres, "cn", "label", "value", average), "enrichment")


@query(f"WITH {_FREQ} SELECT combination, round(cum_freq, 6) AS cum_freq, round(freq, 6) AS marginal FROM freqs WHERE cum_freq > 0.85 ORDER BY cum_freq LIMIT 1")
def combo_share_at(spark, sf):
    return r6(neighborhoods.share_at(neighborhoods.combination_frequencies(_combinations(spark, sf)), 0.85), "cum_freq", "marginal")


@query(
    f"WITH {_FREQ}, s AS (SELECT combination, string_split(combination, ',') AS items FROM freqs WHERE freq >= 0.001) SELECT b.combination AS dst, count(*) AS in_degree FROM s a JOIN s b "
    "ON len(b.items) = len(a.items) + 1 AND list_has_all(b.items, a.items) GROUP BY 1"
)
def combo_in_degree(spark, sf):
    return neighborhoods.in_degrees(neighborhoods.combination_graph(neighborhoods.combination_frequencies(_combinations(spark, sf))))


# --- interactions ----------------------------------------------------------------------------------

R = 50
_EDGES = f"edges AS (SELECT a.region, a.cell_id AS id1, b.cell_id AS id2, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM cells a JOIN cells b ON a.region = b.region AND a.cell_id <> b.cell_id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < {R * R})"


@query(f"WITH {CELLS}, {_EDGES} SELECT * FROM edges")
def radius_edges(spark, sf):
    return spatial.near_pairs(cells_view(spark, sf).select("region", "cell_id", "x", "y"), R, inclusive=False)


def _dealt_sql(steps: int) -> str:
    """Labels under permutations 0 .. steps - 1 in table ``dealt`` (region, cell_id, s, cell_type): rounds of shifts, again for places outside; the tables are recursive."""
    p, rounds = interactions.WORD + 1, interactions.ROUNDS
    mix = lambda x: f"(xor({x}, {x} >> 16) * {interactions.MIX}) % {p}"
    last = lambda x: f"xor({x}, {x} >> 16)"
    keyed = f"SELECT *, ((s * {rounds} + i % {rounds} + 1) * {interactions.SPREAD}) % {p} AS k FROM deal WHERE NOT (i > 0 AND i % {rounds} = 0 AND a * high + b < n)"
    keyed = f"SELECT *, {last('k2')} AS key FROM (SELECT *, {mix('k1')} AS k2 FROM (SELECT *, {mix('k')} AS k1 FROM ({keyed})))"
    hashed = f"SELECT *, xor(CASE WHEN i % 2 = 0 THEN b ELSE a END, key) AS v FROM ({keyed})"
    hashed = f"SELECT *, {last('v2')} AS h FROM (SELECT *, {mix('v1')} AS v2 FROM (SELECT *, {mix('v')} AS v1 FROM ({hashed})))"
    return (
        "spot AS (SELECT region, cell_id, row_number() OVER (PARTITION BY region ORDER BY cell_id) - 1 AS x, count(*) OVER (PARTITION BY region) AS n FROM cells), "
        "box AS (SELECT *, (n + wide - 1) // wide AS high FROM (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS wide FROM spot)), "
        f"deal(region, cell_id, n, wide, high, s, i, a, b) AS (SELECT region, cell_id, n, wide, high, s, 0, x // high, x % high FROM box, range(0, {steps}) r(s) "
        f"UNION ALL SELECT region, cell_id, n, wide, high, s, i + 1, CASE WHEN i % 2 = 0 THEN (a + h % wide) % wide ELSE a END, CASE WHEN i % 2 = 1 THEN (b + h % high) % high ELSE b END FROM ({hashed})), "
        "kinds AS (SELECT region, cell_type, sum(k) OVER (PARTITION BY region ORDER BY cell_type) - k AS low, sum(k) OVER (PARTITION BY region ORDER BY cell_type) AS high FROM (SELECT region, cell_type, count(*) AS k FROM cells GROUP BY 1, 2)), "
        f"dealt AS MATERIALIZED (SELECT p.region, p.cell_id, p.s, k.cell_type FROM deal p JOIN kinds k ON k.region = p.region AND p.a * p.high + p.b >= k.low AND p.a * p.high + p.b < k.high WHERE p.i > 0 AND p.i % {rounds} = 0 AND p.a * p.high + p.b < p.n)"
    )


_PERM = f"{CELLS}, {_EDGES}, {_dealt_sql(1)}"


def _pairs_sql(labels: str) -> str:
    return f"""SELECT region, type1, type2, avg(d) AS mean_dist FROM (SELECT e.region, id1, p.cell_type AS type1, q.cell_type AS type2, avg(sqrt(d2)) AS d FROM edges e
 JOIN {labels} p ON p.cell_id = id1 JOIN {labels} q ON q.cell_id = id2 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"""


@query(
    f"WITH RECURSIVE {_PERM} SELECT o.region, o.type1, o.type2, round(o.mean_dist, 6) AS observed, round(e.mean_dist, 6) AS expected, round(log2(o.mean_dist / e.mean_dist), 6) AS logfold "
    f"FROM ({_pairs_sql('cells')}) o JOIN ({_pairs_sql('dealt')}) e ON o.region = e.region AND o.type1 = e.type1 AND o.type2 = e.type2"
)
def observed_expected_pairs(spark, sf):
    both = interactions.observed_and_expected(cells_view(spark, sf), R)
    return r6(both.withColumn("logfold", F.log2(F.col("observed") / F.col("expected"))), "observed", "expected", "logfold")


#: Permutations of the comparisons that SQL checks; the registered test has 1000. Distances are compared to nine digits, as engines add in other orders.
DEALS, LEAST = 6, 10

#: The whole comparison over edges within R: cells' mean distances, expected means, rank test and folds.
_INTER = f"""{CELLS}, {_EDGES}, {_dealt_sql(DEALS)}, obs AS (SELECT a.cond AS condition, a.cell_type AS type1, b.cell_type AS type2, round(avg(sqrt(d2)), 9) AS d FROM edges JOIN cells a ON a.cell_id = id1 JOIN cells b ON b.cell_id = id2 GROUP BY a.cond, e1(id1), 2, 3),
 ends AS MATERIALIZED (SELECT e.region, e.id1, e.id2, e.d2, a.s, a.cell_type AS type1 FROM edges e JOIN dealt a ON a.cell_id = id1),
 per AS (SELECT e.region, e.s, e.type1, b.cell_type AS type2, avg(sqrt(d2)) AS d FROM ends e JOIN dealt b ON b.cell_id = e.id2 AND b.s = e.s GROUP BY e.region, e.s, e.id1, 3, 4),
 conds AS (SELECT region, max(cond) AS condition FROM cells GROUP BY region),
 expd AS (SELECT condition, type1, type2, round(avg(d), 9) AS d FROM per JOIN conds ON conds.region = per.region GROUP BY per.region, s, condition, type1, type2 HAVING avg(d) <= {R}),
 vals AS (SELECT condition, type1, type2, d, 1 AS seen FROM obs UNION ALL SELECT condition, type1, type2, d, 0 FROM expd),
 cnt AS (SELECT condition, type1, type2, d, sum(seen) AS a, CAST(count(*) AS DOUBLE) AS t FROM vals GROUP BY 1, 2, 3, 4),
 rk AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY condition, type1, type2 ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cnt),
 ts AS (SELECT condition, type1, type2, CAST(sum(a) AS DOUBLE) AS n, sum(t) - sum(a) AS m, sum(t) AS total, sum(a * (before + (t + 1) / 2)) AS ranks, sum(t * t * t - t) AS ties FROM rk GROUP BY 1, 2, 3),
 zs AS (SELECT *, (greatest(ranks - n * (n + 1) / 2, n * m - (ranks - n * (n + 1) / 2)) - n * m / 2 - 0.5) / sqrt(n * m / 12 * (total + 1 - ties / (total * (total - 1)))) AS z FROM ts),
 mean AS (SELECT condition, type1, type2, avg(d) FILTER (seen = 1) AS o, avg(d) FILTER (seen = 0) AS e FROM vals GROUP BY 1, 2, 3),
 t AS (SELECT zs.condition, zs.type1, zs.type2, CAST(n AS BIGINT) AS n, o AS observed_mean, e AS expected_mean, log2(o / e) AS logfold_group, least(1.0, 2 * (1 - {phi_sql('z')})) AS pvalue, zs.type1 || '_' || zs.type2 AS pair
 FROM zs JOIN mean ON mean.condition = zs.condition AND mean.type1 = zs.type1 AND mean.type2 = zs.type2 WHERE m > {LEAST} AND n > {LEAST}),
 good AS (SELECT DISTINCT pair FROM t WHERE pvalue < 0.5 AND type1 <> type2 AND observed_mean IS NOT NULL AND abs(logfold_group) > 0.001),
 kept AS (SELECT t.* FROM t JOIN good ON t.pair = good.pair)""".replace("e1(id1)", "id1")


def _compared(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The comparison, and each cell's distances that it is made from."""
    found, observed = interactions.compare_range(cells_view(spark, sf), "cond", R, DEALS, LEAST, digits=9)
    return found.withColumnRenamed("n_observed", "n").where("n is not null"), observed


def _interactions(spark, sf) -> DataFrame:
    return _compared(spark, sf)[0]


@query(f"WITH RECURSIVE {_INTER} SELECT condition, type1, type2, n, round(observed_mean, 6) AS observed_mean, round(expected_mean, 6) AS expected_mean, round(logfold_group, 6) AS logfold_group, round(pvalue, 6) AS pvalue FROM t")
def interaction_comparison(spark, sf):
    return r6(_interactions(spark, sf).select("condition", "type1", "type2", "n", "observed_mean", "expected_mean", "logfold_group", "pvalue"), "observed_mean", "expected_mean", "logfold_group", "pvalue")


@query(f"WITH RECURSIVE {_INTER} SELECT pair, round(max(CASE WHEN condition = 'a' THEN logfold_group END), 6) AS a, round(max(CASE WHEN condition = 'b' THEN logfold_group END), 6) AS b FROM kept GROUP BY pair HAVING count(DISTINCT condition) = 2")
def interaction_filter_pivot(spark, sf):
    kept = interactions.filter_interactions(_interactions(spark, sf), 0.5, 0.001)
    return r6(interactions.fold_table(kept, ["a", "b"]), "a", "b")


@query(
    f"WITH RECURSIVE {_INTER}, rare AS (SELECT cell_type FROM cells GROUP BY cell_type HAVING 100.0 * count(*) / (SELECT count(*) FROM cells) < 20) SELECT condition, type1, type2, n FROM t "
    "WHERE type1 NOT IN (SELECT cell_type FROM rare) AND type2 NOT IN (SELECT cell_type FROM rare)"
)
def rare_type_antijoin(spark, sf):
    return interactions.without_rare_types(_interactions(spark, sf), cells_view(spark, sf), "cell_type", 20).select("condition", "type1", "type2", "n")


_TOP = f"""{_INTER}, w AS (SELECT pair, max(CASE WHEN condition = 'a' THEN logfold_group END) AS a, max(CASE WHEN condition = 'b' THEN logfold_group END) AS b FROM kept GROUP BY pair HAVING count(DISTINCT condition) = 2),
 top AS (SELECT pair FROM w ORDER BY round(abs(a - b), 9) DESC, pair LIMIT 3), v AS (SELECT condition, type1 || ' --> ' || type2 AS interaction, d FROM obs JOIN top ON top.pair = type1 || '_' || type2)"""


@query(f"WITH RECURSIVE {_TOP} SELECT condition, interaction, round(avg(d), 6) AS mean, round(stddev_samp(d) / sqrt(count(*)), 6) AS se FROM v GROUP BY 1, 2")
def top_n_pairs_explode(spark, sf):
    found, observed = _compared(spark, sf)
    kept = interactions.filter_interactions(found, 0.5, 0.001)
    top = interactions.top_differences(interactions.fold_table(kept, ["a", "b"]), "a", "b", 3)
    return r6(interactions.observed_spread(observed, top), "mean", "se")


@query(
    f"WITH RECURSIVE {_INTER}, w AS (SELECT type1, type2, max(CASE WHEN condition = 'a' THEN logfold_group END) AS f, max(CASE WHEN condition = 'b' THEN logfold_group END) AS s FROM kept GROUP BY 1, 2) "
    "SELECT type1, type2, round(abs(s - f), 6) AS difference, CAST(sign(s - f) AS DOUBLE) AS direction, round(CASE WHEN s = f THEN 1e-100 ELSE abs(s - f) * 10 END, 6) AS weight FROM w WHERE f IS NOT NULL AND s IS NOT NULL"
)
def pair_graph_weights(spark, sf):
    kept = interactions.filter_interactions(_interactions(spark, sf), 0.5, 0.001)
    return r6(interactions.pair_graph(kept, "a", "b"), "difference", "weight")


@query(f"WITH {CELLS} SELECT a.region, count(*) AS n, round(avg(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS mean FROM cells a JOIN cells b ON a.region = b.region WHERE a.cell_type = 'purchase' AND b.cell_type = 'click' GROUP BY a.region")
def pairwise_distance_summary(spark, sf):
    return r6(spatial.pairwise_summary(cells_view(spark, sf), "cell_type", "purchase", "click"), "mean")


@query(f"WITH {CELLS}, v AS (SELECT region, cell_type, avg(value) AS m FROM cells GROUP BY 1, 2) SELECT o.cell_type, round(avg(CASE WHEN o.m > p.value THEN 1.0 ELSE 0.0 END), 6) AS share FROM v o JOIN cells p ON o.region = p.region AND o.cell_type = p.cell_type GROUP BY 1")
def permutation_share(spark, sf):
    cells = cells_view(spark, sf)
    means = cells.groupBy("region", "cell_type").agg(F.avg("value").alias("m"))
    return r6(stats.permutation_share(means, cells.select("region", "cell_type", "value"), ["region", "cell_type"], ["cell_type"], "m", "value"), "share")


@query()
def delaunay_edges(spark, sf):
    return interactions.delaunay_edges(cells_view(spark, sf))


@query(
    f"""WITH {CELLS}, cnt AS (SELECT cell_type, value AS d, sum(CASE WHEN cond = 'a' THEN 1 ELSE 0 END) AS a, CAST(count(*) AS DOUBLE) AS t FROM cells GROUP BY 1, 2),
 rk AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY cell_type ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cnt),
 ts AS (SELECT cell_type, CAST(sum(a) AS DOUBLE) AS n, sum(t) - sum(a) AS m, sum(t) AS total, sum(a * (before + (t + 1) / 2)) AS ranks, sum(t * t * t - t) AS ties FROM rk GROUP BY 1),
 zs AS (SELECT *, (greatest(ranks - n * (n + 1) / 2, n * m - (ranks - n * (n + 1) / 2)) - n * m / 2 - 0.5) / sqrt(n * m / 12 * (total + 1 - ties / (total * (total - 1)))) AS z FROM ts)
 SELECT cell_type, round(least(1.0, 2 * (1 - {phi_sql('z')})), 6) AS pvalue FROM zs"""
)
def mwu_pvalue(spark, sf):
    cells = cells_view(spark, sf).withColumn("first", F.col("cond") == "a")
    return r6(interactions.rank_test(cells, ["cell_type"], "value", "first"), "pvalue")


@query()
def interaction_test(spark, sf):
    found = interactions.identify_interactions(cells_view(spark, sf), "cond", 128, 1000, 10)
    return found.select("type1", "type2", "condition", "expected_mean", "observed_mean", "pvalue", "logfold_group", "interaction")


# --- patches ---------------------------------------------------------------------------------------

_NEAR = f"""{CELLS}, near AS (SELECT b.region, b.cell_id, b.cn AS neighbor_label, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance2 FROM cells a JOIN cells b ON a.region = b.region
 WHERE a.cn = 'CN0' AND b.cn <> 'CN0' AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 3600 GROUP BY 1, 2, 3)"""


def _proximity(spark, sf) -> DataFrame:
    cells = cells_view(spark, sf).select("region", "cell_id", "x", "y", "cn")
    borders = cells.where("cn = 'CN0'").select("region", "cell_id", "x", "y", F.lit(0).alias("patch"))
    return patches.proximity(cells, borders, 60, "cn", "CN0")


@query(f"WITH {_NEAR} SELECT region, cell_id, neighbor_label, CAST(distance2 AS BIGINT) AS distance2, region || '_CN0_patch_no_0' AS unique_patch FROM near")
def patch_proximity_range(spark, sf):
    return _proximity(spark, sf).select("region", "cell_id", "neighbor_label", F.col("distance2").cast("long").alias("distance2"), "unique_patch")


@query(f"WITH {_NEAR}, rings AS (SELECT unnest([20.0, 40.0, 60.0]) AS radius), counts AS (SELECT CAST(radius AS DOUBLE) AS radius, neighbor_label, count(*) AS n FROM near JOIN rings ON distance2 <= radius * radius GROUP BY 1, 2) SELECT radius, neighbor_label, n, round(100.0 * n / sum(n) OVER (PARTITION BY radius), 6) AS percent FROM counts")
def ring_share_multi_radius(spark, sf):
    return r6(patches.ring_shares(_proximity(spark, sf), [20, 40, 60]), "percent")


@query(f"WITH {_NEAR} SELECT region, neighbor_label, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY region) AS BIGINT) AS total FROM near GROUP BY 1, 2")
def patch_proximity_counts(spark, sf):
    return patches.proximity_counts(_proximity(spark, sf), "region", "neighbor_label")


@query(f"WITH {CELLS} SELECT region, cell_id FROM cells b WHERE cell_type = 'view' AND EXISTS (SELECT 1 FROM cells a WHERE a.region = b.region AND a.cell_type = 'purchase' AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1600)")
def near_any_semi(spark, sf):
    cells = cells_view(spark, sf)
    return spatial.near_any(cells.where("cell_type = 'view'"), cells.where("cell_type = 'purchase'"), 40).select("region", "cell_id")


@query()
def density_patches(spark, sf):
    return patches.density_patches(cells_view(spark, sf), "cn", "CN0", 10)


@query()
def patch_proximity_full(spark, sf):
    return patches.patch_proximity(cells_view(spark, sf), "cn", "CN0", 10, 60, 3, 150)


# --- clustering, annotation, statistics ------------------------------------------------------------


@query("SELECT vec_id, label, 'L' || CAST(label AS VARCHAR) AS name FROM embeddings WHERE label < 3 UNION ALL SELECT vec_id, label, NULL AS name FROM embeddings WHERE label >= 3")
def label_map(spark, sf):
    return annotate.map_labels(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label"), "label", {i: f"L{i}" for i in range(3)}, "name")


@query("SELECT vec_id, CASE WHEN label = 1 THEN 'sub' || CAST(vec_id % 3 AS VARCHAR) ELSE CAST(label AS VARCHAR) END AS merged FROM embeddings")
def label_merge_coalesce(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label")
    sub = e.where("label = 1").select("vec_id", F.concat(F.lit("sub"), (F.col("vec_id") % 3).cast("string")).alias("sub"))
    return annotate.merge_labels(e, sub, "vec_id", "label", "sub", "merged").select("vec_id", "merged")


_REPORT = """p AS (SELECT o_orderpriority AS t, CASE WHEN o_totalprice > 150000 THEN '1-URGENT' ELSE o_orderpriority END AS p FROM orders), l AS (SELECT DISTINCT t AS label FROM p UNION SELECT DISTINCT p FROM p),
 c AS (SELECT label, count(*) FILTER (t = label AND p = label) AS hit, count(*) FILTER (t = label) AS support, count(*) FILTER (p = label) AS guessed FROM l, p GROUP BY label),
 r AS (SELECT label, coalesce(hit / nullif(guessed, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall, support FROM c)"""


@query(f"WITH {_REPORT} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1, support FROM r")
def classification_report(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderpriority").alias("t"), F.when(F.col("o_totalprice") > 150000, "1-URGENT").otherwise(F.col("o_orderpriority")).alias("p"))
    return r6(stats.classification_report(o, "t", "p"), "precision", "recall", "f1")


def _cosine_sql(a: str, b: str) -> str:
    return f"1 - list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / (sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))))"


@query(
    f"WITH s AS (SELECT vec_id AS sid, embedding AS g FROM embeddings WHERE vec_id < 4), d AS (SELECT vec_id, sid, {_cosine_sql('embedding', 'g')} AS d FROM embeddings, s) "
    "SELECT vec_id, CAST(arg_min(sid, round(d, 9)) AS INTEGER) AS seed, round(min(d), 6) + 0 AS distance FROM d GROUP BY vec_id"
)
def nearest_centroid(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    seeds = e.where("vec_id < 4").select(F.col("vec_id").cast("int").alias("seed"), F.col("embedding").alias("features"))
    return r6(stats.nearest_seed(e, "vec_id", "embedding", seeds), "distance")


_MEAN = "m AS (SELECT list(a ORDER BY i) AS mean FROM (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS a FROM embeddings, range(1, 65) t(i) GROUP BY i))"


@query(
    f"WITH {_MEAN}, s0 AS (SELECT vec_id, embedding FROM embeddings, m ORDER BY {_cosine_sql('embedding', 'mean')} DESC, vec_id LIMIT 1), "
    f"s1 AS (SELECT e.vec_id, e.embedding FROM embeddings e, s0 ORDER BY {_cosine_sql('e.embedding', 's0.embedding')} DESC, e.vec_id LIMIT 1), "
    f"s2 AS (SELECT e.vec_id FROM embeddings e, s0, s1 ORDER BY least({_cosine_sql('e.embedding', 's0.embedding')}, {_cosine_sql('e.embedding', 's1.embedding')}) DESC, e.vec_id LIMIT 1) "
    "SELECT 0 AS seed, vec_id FROM s0 UNION ALL SELECT 1, vec_id FROM s1 UNION ALL SELECT 2, vec_id FROM s2"
)
def farthest_point_seeds(spark, sf):
    return stats.farthest_point_seeds(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding", 3).select("seed", "vec_id")


@query(
    f"""WITH {ODDS}, o AS (SELECT o_orderstatus, o_totalprice AS y, CAST(o_custkey AS DOUBLE) AS x, CASE WHEN o_orderpriority LIKE '1%' THEN 1.0 ELSE 0.0 END AS u FROM orders),
 s AS (SELECT o_orderstatus, count(*) AS n, count(*) * var_pop(x) AS xx, count(*) * var_pop(u) AS uu, count(*) * var_pop(y) AS yy, count(*) * covar_pop(x, u) AS xu, count(*) * covar_pop(x, y) AS xy, count(*) * covar_pop(u, y) AS uy FROM o GROUP BY 1),
 b AS (SELECT *, (xx * uy - xu * xy) / (xx * uu - xu * xu) AS bu, (uu * xy - xu * uy) / (xx * uu - xu * xu) AS bx FROM s),
 t AS (SELECT *, bu / sqrt((yy - bx * xy - bu * uy) / (n - 3) * xx / (xx * uu - xu * xu)) AS t, n - 3 AS free FROM b)
 SELECT o_orderstatus, round(bu, 4) AS coefficient, round({student_sql('t', 'free')}, 6) AS pvalue, n FROM t"""
)
def group_ols(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").withColumn("urgent", F.col("o_orderpriority").startswith("1").cast("double"))
    found = stats.grouped_ols(o, ["o_orderstatus"], "o_totalprice", ["o_custkey", "urgent"], "urgent")
    return r6(found, "pvalue").withColumn("coefficient", F.round("coefficient", 4))


@query("SELECT o_orderpriority AS grp, round(ln(0.001 + avg(o_totalprice)), 6) AS o_totalprice FROM orders GROUP BY 1")
def log_group_means(spark, sf):
    return r6(stats.log_means(spark.read.parquet(f"{sf}/orders.parquet").withColumnRenamed("o_orderpriority", "grp"), ["grp"], ["o_totalprice"]), "o_totalprice")


@query()
def cca_of_neighbourhoods(spark, sf):
    wide = composition.densified_share(cells_view(spark, sf), ["cn", "region"], "cell_type")
    return stats.canonical_pairs(wide, "cn", "region", "cell_type", "percent", 20)


@query()
def tukey_of_shares(spark, sf):
    shares = composition.densified_share(cells_view(spark, sf), ["cn", "region"], "cell_type")
    return stats.tukey_hsd(shares.where("cell_type = 'purchase'"), "cn", "percent")


@query()
def voronoi_cells(spark, sf):
    return interactions.voronoi_cells(cells_view(spark, sf), (0.0, 0.0, 2003.0, 1999.0))


@query()
def ml_predict(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    n = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    wide = e.select("vec_id", "label", *[F.col("embedding")[i].alias(f"f{i}") for i in range(n)]).withColumn("label", F.col("label").cast("string"))
    model, _ = annotate.train_classifier(wide, "label", [f"f{i}" for i in range(n)])
    return annotate.predict(model, wide).select("vec_id", "label", "predicted")


@query()
def marker_clusters(spark, sf):
    return annotate.cluster_markers(marker_view(spark, sf), MARKERS, 5)


def _planar_graph(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Edges to the six nearest cells, and each cell's place: its region, then strips of 64 across it."""
    cells = cells_view(spark, sf)
    near = spatial.knn(cells, 6, include_self=False)
    edges = near.select(F.least("id", "neighbor").alias("src"), F.greatest("id", "neighbor").alias("dst"), F.lit(1.0).alias("weight")).distinct()
    strip = F.pmod(F.hash("region"), F.lit(1 << 20)) * 1e6 + F.floor(F.col("x") / 64) * 1e4 + F.col("y")
    return edges, cells.select(F.col("cell_id").alias("id"), strip.alias("place"))


@query()
def graph_communities(spark, sf):
    edges, places = _planar_graph(spark, sf)
    return annotate.modularity_communities(edges, places=places)


@query()
def community_resolutions(spark, sf):
    edges, places = _planar_graph(spark, sf)
    return annotate.resolution_sweep(materialize(edges, "edges"), [0.5, 2.0], places)


#: Squared distances of queries to all vectors, and how each query's neighbours rank.
_NEAR = """pairs AS (SELECT q.vec_id, v.vec_id AS neighbor, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2]))) AS d2
 FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
 near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, neighbor) AS rank FROM pairs)"""


@query(f"WITH {_NEAR} SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor, round(sqrt(d2), 6) AS distance FROM near WHERE rank <= 10")
def marker_exact_neighbours(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    found = marker_graph.exact_neighbours(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)
    ranked = found.select(F.col("id").alias("vec_id"), F.posexplode("near").alias("at", "x"))
    return ranked.select("vec_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("neighbor"), F.round(F.sqrt("x.d"), 6).alias("distance"))


@query()
def marker_graph_edges(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return marker_graph.fuzzy_weights(marker_graph.marker_neighbours(e, "vec_id", "embedding", 10), 10)


@query()
def marker_communities(spark, sf):
    return annotate.marker_communities(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding", 10)


@query()
def subclustered_communities(spark, sf):
    return annotate.subclustered(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding", "label", [0, 1, 2], "merged", 10).select("vec_id", "label", "merged")


#: A map of 4 x 3 nodes that begins with the vectors of the twelve least ids, and its state after one epoch of radius 1.
_SOM_WIDE, _SOM_HIGH = 4, 3
_SOM = f"""v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
 n0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS node, x FROM v ORDER BY vec_id LIMIT {_SOM_WIDE * _SOM_HIGH}),
 d0 AS (SELECT vec_id, node, list_sum(list_transform(list_zip(v.x, n0.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, n0),
 a0 AS (SELECT vec_id, arg_min(node, (d, node)) AS node FROM d0 GROUP BY vec_id),
 s0 AS (SELECT a0.node, i, sum(v.x[i]) AS s, count(*) AS n FROM a0 JOIN v ON v.vec_id = a0.vec_id, range(1, 65) r(i) GROUP BY ALL),
 h AS (SELECT a.node AS to_node, b.node AS of_node, exp(-(power(a.node % {_SOM_WIDE} - b.node % {_SOM_WIDE}, 2) + power(a.node // {_SOM_WIDE} - b.node // {_SOM_WIDE}, 2)) / 2) AS h FROM n0 a, n0 b),
 n1 AS (SELECT to_node AS node, list(x ORDER BY i) AS x FROM (SELECT to_node, i, sum(h * s) / sum(h * n) AS x FROM h JOIN s0 ON s0.node = h.of_node GROUP BY ALL) GROUP BY to_node),
 d1 AS (SELECT vec_id, node, list_sum(list_transform(list_zip(v.x, n1.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, n1)"""


@query(f"WITH {_SOM} SELECT vec_id, CAST(arg_min(node, (d, node)) AS INTEGER) AS node, round(min(d), 6) AS distance FROM d1 GROUP BY vec_id")
def som_epoch(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    begin = [r["embedding"] for r in e.where("vec_id is not null and embedding is not null").orderBy("vec_id").limit(_SOM_WIDE * _SOM_HIGH).select("embedding").collect()]
    trained = som.train_som(e, "vec_id", "embedding", _SOM_WIDE, _SOM_HIGH, epochs=1, radius=1.0, nodes=begin)
    return r6(som.assign_nodes(e, "vec_id", "embedding", trained.nodes).withColumnRenamed("id", "vec_id"), "distance")


@query()
def som_clusters(spark, sf):
    return som.som_clusters(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding", groups=10)


@query()
def label_groups(spark, sf):
    edges, places = _planar_graph(spark, sf)
    return annotate.label_propagation(edges, places)


@query(f"SELECT a.vec_id AS id1, b.vec_id AS id2, round({_cosine_sql('a.embedding', 'b.embedding')}, 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_neighbours_in_order(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    a, b = e.select(F.col("vec_id").alias("id1"), F.col("embedding").alias("p")), e.select(F.col("vec_id").alias("id2"), F.col("embedding").alias("q"))
    return r6(a.join(b, F.col("id2") == F.col("id1") + 1).select("id1", "id2", cosine_distance(F.col("p"), F.col("q")).alias("distance")), "distance")


@query(f"WITH {CELLS} SELECT region, CAST(x // 500 AS BIGINT) AS gx, CAST(y // 500 AS BIGINT) AS gy, count(*) AS n, round(avg(value), 6) AS value FROM cells GROUP BY 1, 2, 3")
def coarse_grid(spark, sf):
    c = cells_view(spark, sf)
    return r6(raster.downscaled(c, 500, ["value"], ["region"]), "value")


@query(
    "SELECT c_mktsegment AS segment, CAST(n_regionkey AS BIGINT) AS area, round(avg(c_acctbal), 6) AS mean, CAST(row_rank AS INTEGER) AS row_rank, CAST(column_rank AS INTEGER) AS column_rank FROM customer JOIN nation ON c_nationkey = n_nationkey "
    "JOIN (SELECT segment, row_number() OVER (ORDER BY sum(abs(m)) DESC, segment) AS row_rank FROM (SELECT c_mktsegment AS segment, n_regionkey, avg(c_acctbal) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY 1) r ON r.segment = c_mktsegment "
    "JOIN (SELECT area, row_number() OVER (ORDER BY sum(abs(m)) DESC, area) AS column_rank FROM (SELECT c_mktsegment, n_regionkey AS area, avg(c_acctbal) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY 1) k ON k.area = n_regionkey GROUP BY 1, 2, 4, 5"
)
def ordered_by_absolute_sum(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").join(spark.read.parquet(f"{sf}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey"))
    means = c.groupBy(F.col("c_mktsegment").alias("segment"), F.col("n_regionkey").cast("long").alias("area")).agg(F.avg("c_acctbal").alias("mean"))
    return r6(composition.by_absolute_sum(means, "segment", "area", "mean"), "mean")


@query(f"WITH {CELLS} SELECT cell_type, CAST(CASE cell_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS INTEGER) AS place, count(*) AS n FROM cells WHERE cell_type IN ('view', 'click', 'purchase') GROUP BY 1, 2")
def listed_order(spark, sf):
    counts = cells_view(spark, sf).groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"))
    return composition.custom_order(counts, "cell_type", ["view", "click", "purchase"]).select("cell_type", "place", "n")


@query(
    f"WITH {CELLS}, a AS (SELECT cell_type, count(*) AS n, max(value) AS top FROM cells WHERE cell_type <> 'click' GROUP BY 1), b AS (SELECT cell_type, min(x) AS low, max(value) AS top FROM cells WHERE cell_type <> 'view' GROUP BY 1) "
    "SELECT coalesce(a.cell_type, b.cell_type) AS cell_type, n, low, round(coalesce(a.top, b.top), 6) AS top FROM a FULL JOIN b ON a.cell_type = b.cell_type"
)
def tables_side_by_side(spark, sf):
    cells = cells_view(spark, sf)
    one = cells.where("cell_type <> 'click'").groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    two = cells.where("cell_type <> 'view'").groupBy("cell_type").agg(F.min("x").alias("low"), F.max("value").alias("top"))
    return r6(composition.side_by_side(one, two, "cell_type").select("cell_type", "n", "low", "top"), "top")


@query(f"WITH {_FREQ} SELECT 'CN' || replace(combination, ',', ' CN') AS names, n FROM freqs")
def combo_names(spark, sf):
    found = _combinations(spark, sf).groupBy("combination").agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.array_join(neighborhoods.combination_names("combination", CNS), " ").alias("names"), "n")


@query(f"WITH {_FREQ} SELECT combination, n, round(cum_freq, 6) AS cum_freq FROM freqs WHERE cum_freq - freq <= 0.85")
def combination_map_top(spark, sf):
    return r6(neighborhoods.combination_map(cells_view(spark, sf), "cn", CNS, K, THRESHOLD, 0.85)["top"].select("combination", "n", "cum_freq"), "cum_freq")


@query(f"WITH {ODDS}, {CELLS}, c AS (SELECT cell_type, corr(CAST(x AS DOUBLE), value) AS r, count(*) AS n FROM cells GROUP BY 1), t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2 AS free FROM c) SELECT cell_type, round(r, 6) AS corr, round({student_sql('t', 'free')}, 6) AS pvalue, n FROM t")
def corr_pvalue(spark, sf):
    return r6(stats.correlation_test(cells_view(spark, sf), ["cell_type"], "x", "value"), "corr", "pvalue")


@query()
def elbow_costs(spark, sf):
    types = events_types(spark, sf)
    return neighborhoods.elbow(_windows(spark, sf, K, True, "cell_type", types), types, [2, 4, 6])


@query()
def tissue_modules(spark, sf):
    return stats.tissue_modules(cells_view(spark, sf), "region", "cn", "cell_type", (2, 3, 3))


@query()
def module_ranks(spark, sf):
    return stats.evaluate_ranks(cells_view(spark, sf), "region", "cn", "cell_type", 2, 4)


# --- sources, sinks and schema ---------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _written(spark, sf) -> str:
    """Cells as segmentation tables: one CSV folder a region, an index column first, names with a prefix."""
    path = _folder(spark, "csv")
    cells = cells_view(spark, sf).select("region", F.lit(0).alias("index"), F.col("cell_id").alias("cell:cell_id"), F.col("x").alias("pos:x"), F.col("y").alias("size"), F.col("cell_type").alias("cell:cell_type"))
    write_by_region(cells, path, "region", [c for c in cells.columns if c != "region"])
    return path


@query(f"WITH {CELLS} SELECT cell_id, x, y AS area, cell_type, substr(region, 4) AS region_num, region AS unique_region, cond AS condition FROM cells")
def csv_round_trip(spark, sf):
    path = _written(spark, sf)
    found = cells_view(spark, sf).groupBy("region").agg(F.max("cond").alias("cond")).orderBy("region").collect()  # eight regions
    df = read_cells(spark, [f"{path}/region={r['region']}" for r in found], "cellseg", [r["region"] for r in found], [r["cond"] for r in found])
    return df.select(*[F.col(c).cast("long").alias(c) for c in ("cell_id", "x", "area")], "cell_type", "region_num", "unique_region", "condition")


@query(f"WITH {CELLS} SELECT DISTINCT region FROM cells")
def listed_files(spark, sf):
    files = list_files(spark, _written(spark, sf), ".csv", recursive=True)
    return files.select(F.regexp_extract("path", "region=([^/]+)/", 1).alias("region")).distinct()


@query("SELECT DISTINCT event_type AS name FROM events")
def names_from_text(spark, sf):
    path = _folder(spark, "names")
    spark.read.parquet(f"{sf}/events.parquet").select(F.concat(F.lit('"'), "event_type", F.lit('",')).alias("value")).distinct().write.text(path)
    return read_names(spark, path)


@query(f"WITH {CELLS} SELECT DISTINCT region || '_' || cell_type AS name FROM cells")
def bare_names(spark, sf):
    paths = cells_view(spark, sf).select(F.concat(F.lit("out/cut/"), "region", F.lit("_"), "cell_type", F.lit("_plot.png_cut.png")).alias("path")).distinct()
    return paths.select(bare_name("path").alias("name"))


@query(f"WITH {CELLS} SELECT region, count(*) AS n FROM cells WHERE cond = 'a' GROUP BY region")
def registered_result(spark, sf):
    name = f"result_{uuid.uuid4().hex}"
    register(cells_view(spark, sf).where("cond = 'a'"), name)
    return spark.sql(f"SELECT region, count(*) AS n FROM {name} GROUP BY region")


@query(f"WITH {CELLS} SELECT region, cond, count(*) AS n, round(sum(value), 4) AS total FROM cells GROUP BY region, cond")
def kept_result(spark, sf):
    kept = ResultRegistry(spark, f"{shared_dir(spark)}/results")
    name = f"shares-{uuid.uuid4().hex}"
    cells = cells_view(spark, sf)
    kept.save(cells.where("cond = 'a'").select("region", "cond", "value"), name, "only one condition")
    kept.save(cells.select("region", "cond", "value"), name, "all cells")
    back = ResultRegistry(spark.newSession(), kept.path).read(name)
    return back.groupBy("region", "cond").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {CELLS} SELECT cell_id, CAST(x AS DOUBLE) AS first, CAST(y AS DOUBLE) AS second, round(value, 6) AS feature FROM cells")
def spatial_points(spark, sf):
    points = format_spatial(cells_view(spark, sf).select("cell_id", "x", "y", "value"), "x", "y", ["value"])
    return r6(points.select("cell_id", F.col("spatial")[0].alias("first"), F.col("spatial")[1].alias("second"), F.col("features")[0].alias("feature")), "feature")


@query(f"WITH {LINES} SELECT l_orderkey, l_linenumber, l_quantity FROM lines")
def positional_slice(spark, sf):
    lines = marker_view(spark, sf)
    return lines.select(*marker_slice(lines, 2))


@query(f"WITH {CELLS} SELECT cell_id, CASE WHEN cell_id % 7 <> 0 THEN value END AS value FROM cells WHERE cell_id % 7 = 0 OR value > 10")
def nan_as_null(spark, sf):
    cells = cells_view(spark, sf).select("cell_id", F.when(F.col("cell_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return without_nan(cells).where("value is null or value > 10")


@query(
    f"WITH {CELLS}, f AS (SELECT cn, row_number() OVER (ORDER BY min(cell_id), cn) - 1 AS neigh_num FROM cells GROUP BY cn) SELECT cell_id, region || '_' || cond AS patients, c.cn, CAST(neigh_num AS INTEGER) AS neigh_num FROM cells c JOIN f ON f.cn = c.cn"
)
def neighbourhood_numbers(spark, sf):
    cells = cells_view(spark, sf).withColumn("patients", F.concat_ws("_", "region", "cond"))
    return first_appearance(cells.select("cell_id", "patients", "cn"), "cn", "cell_id", "neigh_num").select("cell_id", "patients", "cn", "neigh_num")


@query(
    f"WITH {PIXELS} SELECT image, label, round(4 * pi() * count(*) / ((max(x) - min(x) + max(y) - min(y) + 2) * 2.0) / ((max(x) - min(x) + max(y) - min(y) + 2) * 2.0), 6) AS circularity, "
    "0.299 * (label % 5 / 4.0) + 0.587 * (label % 3 / 2.0) + 0.114 * (label % 2) < 0.5 AS dark FROM px WHERE label <> 0 GROUP BY image, label"
)
def shape_and_colour(spark, sf):
    f = pixels.label_features(pixel_view(spark, sf), [])
    perimeter = (F.col("x_max") - F.col("x_min") + F.col("y_max") - F.col("y_min") + 2) * 2
    dark = is_dark(F.col("label") % 5 / 4, F.col("label") % 3 / 2, (F.col("label") % 2).cast("double"))
    return r6(f.select("image", "label", circularity(F.col("area"), perimeter).alias("circularity"), dark.alias("dark")), "circularity")


@query(
    f"WITH {PIXELS}, m AS (SELECT image, label, avg(c1) AS c1 FROM px WHERE label <> 0 GROUP BY 1, 2 HAVING count(*) > 40) SELECT c.image, c.label, round(coalesce(m.c1, c.c1), 6) AS c1, c.c2 "
    "FROM (SELECT image, label, -1.0 AS c1, max(c2) AS c2 FROM px WHERE label <> 0 GROUP BY 1, 2) c LEFT JOIN m ON m.image = c.image AND m.label = c.label"
)
def compensated_cells(spark, sf):
    px = pixel_view(spark, sf)
    cells = px.where("label <> 0").groupBy("image", "label").agg(F.max("c2").alias("c2")).withColumn("c1", F.lit(-1.0))
    means = pixels.label_features(px, ["c1"], 40).select("image", "label", "c1")
    return r6(pixels.compensate_cells(cells, means, ["c1"]).select("image", "label", "c1", "c2"), "c1")
