"""Named queries over the given tables, each with DuckDB SQL of the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allometra.functions import color
from allometra.functions import geometry as g
from allometra.operators import clouds as c
from allometra.operators import compose, drift, fits, spatial, spline
from allometra.operators import statistics as st
from allometra.operators import table as t
from allometra.operators import topology as top
from allometra.plans.bindings import AREAS_SQL, FACES_SQL, LANDMARKS_SQL, SHEETS_SQL, areas_sql, landmark_clouds, landmarks, sheet_clouds, sheet_faces, sheets, table
from allometra.sources import meshes, text
from allometra.sources.scratch import scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
XYZ = ("x", "y", "z")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r(value, digits: int = 5) -> Column:
    """Rounded, and never minus zero: sums of doubles differ in their last bits between engines."""
    return F.round(value, digits) + 0.0


def xyz_sql(digits: int = 5) -> str:
    return ", ".join(f"round({k}, {digits}) + 0 AS {k}" for k in XYZ)


# Scans, factors and predicates


_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def _scan_sql(frame: str) -> str:
    return f"SELECT l_orderkey, l_linenumber, coalesce(sum(l_quantity) OVER (ORDER BY {', '.join(_LINE_ORDER)} ROWS BETWEEN UNBOUNDED PRECEDING AND {frame}), 0) AS running_sum FROM lineitem"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*_LINE_ORDER)


@query(_scan_sql("CURRENT ROW"))
def scan_inclusive(spark, sf_dir):
    return st.scan(_lines(spark, sf_dir), _LINE_ORDER, "l_quantity").select("l_orderkey", "l_linenumber", "running_sum")


@query(_scan_sql("1 PRECEDING"))
def scan_exclusive(spark, sf_dir):
    return st.scan(_lines(spark, sf_dir), _LINE_ORDER, "l_quantity", inclusive=False).select("l_orderkey", "l_linenumber", "running_sum")


@query("""SELECT c_mktsegment AS level, count(*) AS n, 'segment' AS factor FROM customer GROUP BY 1 UNION ALL SELECT 'UNUSED', 0, 'segment'
UNION ALL SELECT b, (SELECT count(*) FROM customer WHERE (c_acctbal > 1e9) = (b = 'true')), 'rich' FROM (VALUES ('false'), ('true')) AS t(b)""")
def declared_levels(spark, sf_dir):
    """Levels of a factor from its metadata, after a merge and a round trip through Parquet, and both Booleans."""
    customer = table(spark, sf_dir, "customer")
    names = ("UNUSED", *sorted(x.c_mktsegment for x in customer.select("c_mktsegment").distinct().collect()))
    factors = t.declare(customer.select("c_custkey", F.col("c_mktsegment").alias("segment")), "segment", "factor", names)
    merged = t.merge(customer.select("c_custkey", (F.col("c_acctbal") > 1e9).alias("rich")), factors, "c_custkey")
    path = scratch_folder(spark)
    merged.write.parquet(path)
    stored = spark.read.parquet(path)
    (factor,) = t.columns_of_role(stored, "factor")
    return t.level_counts(stored, factor).withColumn("factor", F.lit(factor)).unionByName(t.level_counts(stored, "rich").withColumn("factor", F.lit("rich")))


# Predicates and selections

ORDER_COLUMNS = ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def _filter(*tests):
    def run(spark, sf_dir):
        return t.select_rows(table(spark, sf_dir, "orders").select(*ORDER_COLUMNS), *tests)

    return run


for _name, _tests, _where in (
    ("filter_eq", [("o_orderpriority", "eq", "1-URGENT")], "o_orderpriority = '1-URGENT'"),
    ("filter_ne", [("o_orderstatus", "ne", "F")], "o_orderstatus <> 'F'"),
    ("filter_gt", [("o_totalprice", "gt", "150000.5")], "o_totalprice > 150000.5"),
    ("filter_ge", [("o_orderkey", "ge", "1000")], "o_orderkey >= 1000"),
    ("filter_lt", [("o_orderpriority", "lt", "3")], "o_orderpriority < '3'"),
    ("filter_le", [("o_orderkey", "le", "777")], "o_orderkey <= 777"),
    ("filter_in", [("o_orderstatus", "in", "O,P")], "o_orderstatus IN ('O', 'P')"),
    ("filter_notin", [("o_orderpriority", "notin", "1-URGENT,2-HIGH")], "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"),
    ("filter_conjunction", [("o_orderstatus", "eq", "O"), ("o_totalprice", "lt", "100000")], "o_orderstatus = 'O' AND o_totalprice < 100000"),
):
    QUERIES[_name] = _filter(*_tests)
    ORACLES[_name] = f"SELECT {', '.join(ORDER_COLUMNS)} FROM orders WHERE {_where}"


@query(f"SELECT {', '.join(ORDER_COLUMNS)} FROM orders WHERE abs(o_totalprice - ((SELECT min(o_totalprice) FROM orders) + 5e-7::DOUBLE)) >= 1e-6")
def filter_real_tolerance(spark, sf_dir):
    """Within the tolerance of a literal that no price equals lies the least price."""
    orders = table(spark, sf_dir, "orders").select(*ORDER_COLUMNS)
    literal = repr(orders.agg(F.min("o_totalprice")).first()[0] + 5e-7)
    return t.select_rows(orders, ("o_totalprice", "ne", literal))


def _selected(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(*ORDER_COLUMNS)
    return orders, t.predicate(orders, "o_orderstatus", "eq", "O"), t.predicate(orders, "o_totalprice", "gt", "150000")


_SELECT_SQL = "SELECT o_orderkey, {} AS selected FROM orders"


@query(_SELECT_SQL.format("o_orderstatus = 'O' OR o_totalprice > 150000"))
def select_union(spark, sf_dir):
    orders, a, b = _selected(spark, sf_dir)
    return orders.select("o_orderkey", t.select(a, b).alias("selected"))


@query(_SELECT_SQL.format("o_orderstatus = 'O' AND NOT o_totalprice > 150000"))
def select_difference(spark, sf_dir):
    orders, a, b = _selected(spark, sf_dir)
    return orders.select("o_orderkey", t.unselect(a, b).alias("selected"))


@query(_SELECT_SQL.format("(o_orderstatus = 'O') <> (o_totalprice > 150000)"))
def select_symmetric_difference(spark, sf_dir):
    orders, a, b = _selected(spark, sf_dir)
    return orders.select("o_orderkey", t.invert(a, b).alias("selected"))


@query("SELECT count(*) FILTER (o_orderstatus = 'O' OR o_totalprice > 150000) AS n_selected FROM orders")
def select_count(spark, sf_dir):
    orders, a, b = _selected(spark, sf_dir)
    return orders.agg(F.count_if(t.select(a, b)).alias("n_selected"))


@query("""
WITH s AS (SELECT *, o_orderstatus = 'P' AS sel FROM orders),
f AS (SELECT count(*) FILTER (sel) AS n, min(o_orderstatus) FILTER (sel) AS a, max(o_orderstatus) FILTER (sel) AS b,
    min(o_orderpriority) FILTER (sel) AS p, max(o_orderpriority) FILTER (sel) AS q FROM s),
w AS (SELECT count(*) FILTER (sel <> ((a <> b OR o_orderstatus = a) AND (p <> q OR o_orderpriority = p))) AS wrong FROM s, f)
SELECT CASE WHEN n = 0 THEN 'nothing' WHEN a <> b AND p <> q THEN n || ' points'
    ELSE concat_ws(' and ', CASE WHEN a = b THEN 'o_orderstatus=' || a END, CASE WHEN p = q THEN 'o_orderpriority=' || p END) END AS description,
    n AS n_selected, n > 0 AND (a = b OR p = q) AND wrong = 0 AS is_complete
FROM f, w
""")
def describe_selection(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return t.describe_selection(orders.withColumn("selected", t.predicate(orders, "o_orderstatus", "eq", "P")), ["o_orderstatus", "o_orderpriority"])


# Levels, pairs, series, merges


@query("SELECT c_mktsegment AS level, min(c_custkey) AS first_row FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1")
def unique_levels_string(spark, sf_dir):
    return t.levels(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey")


@query("SELECT p_size::VARCHAR AS level, min(p_partkey) AS first_row FROM part WHERE p_size IS NOT NULL GROUP BY p_size")
def unique_levels_integer(spark, sf_dir):
    return t.levels(table(spark, sf_dir, "part"), "p_size", "p_partkey")


@query("SELECT p_partkey, coalesce(list_position(['Brand#11', 'Brand#12', 'Brand#13'], p_brand), 0)::INT - 1 AS code FROM part")
def factor_codes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", t.factor_codes(part, "p_brand", ["Brand#11", "Brand#12", "Brand#13"]).alias("code"))


_PAIRS_SQL = """p AS (SELECT user_id AS id, max(event_id) FILTER (event_type = 'click') AS first_row,
    max(event_id) FILTER (event_type = 'error') AS second_row FROM events GROUP BY user_id
    HAVING first_row IS NOT NULL AND second_row IS NOT NULL)"""


def _pairs(spark, sf_dir):
    return t.pairs(table(spark, sf_dir, "events"), "user_id", "event_type", "click", "error", "event_id")


@query(f"WITH {_PAIRS_SQL} SELECT * FROM p")
def find_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query("""
SELECT user_id AS series_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS pos, event_id AS row_index
FROM events QUALIFY count(*) OVER (PARTITION BY user_id) >= 3
""")
def find_series_min_points(spark, sf_dir):
    return t.series(table(spark, sf_dir, "events"), "user_id", "event_id", 3)


_SERIES_SQL = """s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos,
    count(*) OVER (PARTITION BY user_id) AS c FROM events),
l AS (SELECT user_id AS series_id, regr_slope(value, pos) AS slope, avg(value) - regr_slope(value, pos) * avg(pos) AS intercept, count(*) AS n
    FROM s WHERE c >= 3 GROUP BY user_id)"""


def _regression(spark, sf_dir):
    values = t.series(table(spark, sf_dir, "events"), "user_id", "event_id", 3, "value")
    return st.regression(values, ["series_id"], F.col("pos").cast("double"), F.col("value"))


@query(f"WITH {_SERIES_SQL} SELECT series_id, round(slope, 5) + 0 AS slope, round(intercept, 5) + 0 AS intercept, n FROM l")
def series_regression(spark, sf_dir):
    return _regression(spark, sf_dir).select("series_id", r("slope").alias("slope"), r("intercept").alias("intercept"), "n")


@query(f"WITH {_SERIES_SQL} SELECT round(avg(slope), 5) + 0 AS slope, count(*) AS n_series FROM l")
def average_slope(spark, sf_dir):
    return _regression(spark, sf_dir).agg(r(F.avg("slope")).alias("slope"), F.count(F.lit(1)).alias("n_series"))


@query(f"""WITH {_PAIRS_SQL}
SELECT round(avg(b.value - a.value), 5) + 0 AS difference, count(*) AS n_pairs
FROM p JOIN events AS a ON a.event_id = first_row JOIN events AS b ON b.event_id = second_row""")
def average_pair_difference(spark, sf_dir):
    values = table(spark, sf_dir, "events").select("event_id", "value")
    first = values.select(F.col("event_id").alias("first_row"), F.col("value").alias("a"))
    second = values.select(F.col("event_id").alias("second_row"), F.col("value").alias("b"))
    both = _pairs(spark, sf_dir).join(first, "first_row").join(second, "second_row")
    return both.agg(r(F.avg(F.col("b") - F.col("a"))).alias("difference"), F.count(F.lit(1)).alias("n_pairs"))


def _merge_sides(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "row_index")
    left = customer.select("row_index", "c_name", "c_acctbal")
    right = customer.where("c_acctbal > 0").select("row_index", F.upper("c_mktsegment").alias("c_name"), "c_mktsegment", F.array("c_nationkey").alias("link"))
    return left, right


@query("""SELECT c_custkey AS row_index, c_name, c_acctbal, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS c_mktsegment FROM customer""")
def merge_tables_keep(spark, sf_dir):
    left, right = _merge_sides(spark, sf_dir)
    return t.merge(left, right, simple_only=True)


@query("""SELECT c_custkey AS row_index, c_acctbal, CASE WHEN c_acctbal > 0 THEN upper(c_mktsegment) END AS c_name,
    CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS c_mktsegment FROM customer""")
def merge_tables_overwrite(spark, sf_dir):
    left, right = _merge_sides(spark, sf_dir)
    return t.merge(left, right, overwrite=True, simple_only=True)


# Statistics


@query("""
SELECT (CASE WHEN v <= -1 THEN -1 WHEN trunc(v) >= 20 THEN 20 ELSE trunc(v) END)::INT AS bin, count(*) AS count
FROM (SELECT (c_acctbal - 0.0) * 20 / (9000.0 - 0.0) AS v FROM customer) GROUP BY 1
""")
def histogram_trunc(spark, sf_dir):
    return st.histogram(table(spark, sf_dir, "customer"), "c_acctbal", 0.0, 9000.0, 20)


@query("SELECT coalesce(min(o_totalprice), 0) AS low, coalesce(max(o_totalprice), 0) AS high FROM orders")
def value_range(spark, sf_dir):
    return st.value_range(table(spark, sf_dir, "orders"), "o_totalprice")


_PREFIX_SQL = """SELECT o_orderkey, round(coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey
    ROWS BETWEEN UNBOUNDED PRECEDING AND {}), 0), 3) + 0 AS running_sum FROM orders"""


@query(_PREFIX_SQL.format("CURRENT ROW"))
def prefix_sum_inclusive(spark, sf_dir):
    out = st.prefix_sum(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice")
    return out.select("o_orderkey", r("running_sum", 3).alias("running_sum"))


@query(_PREFIX_SQL.format("1 PRECEDING"))
def prefix_sum_exclusive(spark, sf_dir):
    out = st.prefix_sum(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice", inclusive=False)
    return out.select("o_orderkey", r("running_sum", 3).alias("running_sum"))


# Shapes and fields


def _groups(spark, sf_dir):
    lm = landmarks(spark, sf_dir)
    return c.mean_shape(lm.where("label = 0")), c.mean_shape(lm.where("label = 1"))


_GROUPS_SQL = f"""WITH {LANDMARKS_SQL}, a AS (SELECT vertex_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM lm WHERE label = 0 GROUP BY 1),
b AS (SELECT vertex_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM lm WHERE label = 1 GROUP BY 1),
d AS (SELECT vertex_id, (b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2 AS d2 FROM a JOIN b USING (vertex_id))"""


@query(_GROUPS_SQL + " SELECT vertex_id::INT AS vertex_id, round(sqrt(d2), 5) + 0 AS distance FROM d")
def compare_groups_vertex_distance(spark, sf_dir):
    return c.homologous(*_groups(spark, sf_dir)).select("vertex_id", r(c.vertex_distance()).alias("distance"))


@query(_GROUPS_SQL + " SELECT round(sqrt(avg(d2)), 5) + 0 AS rms, count(*) AS n_vertices FROM d")
def compare_groups_rms(spark, sf_dir):
    return c.rms_distance(c.homologous(*_groups(spark, sf_dir))).select(r("rms").alias("rms"), "n_vertices")


@query(f"WITH {LANDMARKS_SQL} SELECT label, vertex_id::INT AS vertex_id, {', '.join(f'round(avg({k}), 5) + 0 AS {k}' for k in XYZ)} FROM lm GROUP BY ALL")
def mean_shapes(spark, sf_dir):
    return c.mean_shape(landmarks(spark, sf_dir), "label").select("label", "vertex_id", *[r(k).alias(k) for k in XYZ])


@query(f"""WITH {LANDMARKS_SQL} SELECT vertex_id::INT AS vertex_id, {', '.join(f'round(sum((label + 1) * {k}) / count(*), 5) + 0 AS {k}' for k in XYZ)}
FROM lm GROUP BY ALL""")
def weighted_mean_shape(spark, sf_dir):
    lm = landmarks(spark, sf_dir).withColumn("w", F.col("label") + 1)
    return c.weighted_mean_shape(lm, "w").select("vertex_id", *[r(k).alias(k) for k in XYZ])


@query(f"""WITH {LANDMARKS_SQL} SELECT cloud_id, round(min(x), 5) + 0 AS min_x, round(max(z), 5) + 0 AS max_z, round(avg(y), 5) + 0 AS centre_y,
round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 5) + 0 AS size,
round(greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)), 5) + 0 AS max_side FROM lm GROUP BY 1""")
def pcl_stats(spark, sf_dir):
    names = ("min_x", "max_z", "centre_y", "size", "max_side")
    return c.cloud_stats(landmarks(spark, sf_dir)).select("cloud_id", *[r(n).alias(n) for n in names])


@query(f"WITH {LANDMARKS_SQL} SELECT label, vertex_id::INT AS vertex_id, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 5) + 0 AS dispersion FROM lm GROUP BY ALL")
def landmark_dispersion(spark, sf_dir):
    return c.dispersion(landmarks(spark, sf_dir), "label").select("label", "vertex_id", r("dispersion").alias("dispersion"))


def _to_mean(spark, sf_dir):
    lm = landmarks(spark, sf_dir)
    return c.homologous(lm, c.mean_shape(lm))


@query(f"""WITH {LANDMARKS_SQL}, m AS (SELECT vertex_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM lm GROUP BY 1)
SELECT cloud_id, round(max(sqrt((m.x - lm.x) ** 2 + (m.y - lm.y) ** 2 + (m.z - lm.z) ** 2)), 5) + 0 AS distance
FROM lm JOIN m USING (vertex_id) GROUP BY 1""")
def max_landmark_distance(spark, sf_dir):
    return _to_mean(spark, sf_dir).groupBy("cloud_id").agg(r(F.max(c.vertex_distance())).alias("distance"))


@query("""
WITH e AS (SELECT vec_id, embedding[1:63]::DOUBLE[] AS v FROM embeddings)
SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_distance(a.v, b.v) / sqrt(21), 5) + 0 AS distance FROM e AS a JOIN e AS b ON a.vec_id <= b.vec_id
""")
def procrustes_raw_matrix(spark, sf_dir):
    return fits.distance_matrix(landmark_clouds(spark, sf_dir), digits=5).select("a_id", "b_id", F.col("rounded").alias("distance"))


_MOMENTS_SQL = ", ".join(f"covar_pop({a}, {b}) AS {a}{b}" for a, b in ("xx", "yy", "zz", "xy", "xz", "yz"))


@query(f"""WITH {LANDMARKS_SQL}, m AS (SELECT label, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, {_MOMENTS_SQL} FROM lm GROUP BY label),
s AS (SELECT *, (xx + yy + zz) / 3 AS q FROM m),
t AS (SELECT *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy ** 2 + xz ** 2 + yz ** 2)) / 6) AS p FROM s),
u AS (SELECT *, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p) AS h FROM t)
SELECT label, n, round(cx, 5) + 0 AS cx, round(cy, 5) + 0 AS cy, round(cz, 5) + 0 AS cz, true AS is_unit, true AS is_eigen,
round(sqrt(q + 2 * p * cos(acos(greatest(-1, least(1, h))) / 3 + 2 * pi() / 3)), 5) + 0 AS rms FROM u""")
def best_plane_by_label(spark, sf_dir):
    """Planes through all landmarks of a label; the normal is of unit length, and the points' variance along it is the least eigenvalue."""
    lm = landmarks(spark, sf_dir)
    planes = c.best_plane(lm, "label")
    along = sum((F.col(k) - F.col(f"c{k}")) * F.col(f"n{k}") for k in XYZ)
    seen = lm.join(F.broadcast(planes), "label").groupBy("label").agg(F.sqrt(F.avg(along * along)).alias("_seen"))
    unit = F.abs(sum(F.col(f"n{k}") * F.col(f"n{k}") for k in XYZ) - 1) < 1e-9
    out = planes.join(seen, "label")
    return out.select("label", "n", *[r(f"c{k}").alias(f"c{k}") for k in XYZ], unit.alias("is_unit"), (F.abs(F.col("_seen") - F.col("rms")) < 1e-7).alias("is_eigen"), r("rms").alias("rms"))


@query("SELECT vec_id AS cloud_id, 10::INT AS n_scores, true AS is_same FROM embeddings")
def pca_scores_reloaded(spark, sf_dir):
    """Scores by a model that was stored as keyed matrices and read again, beside the stored ones."""
    path = scratch_folder(spark)
    rows = landmark_clouds(spark, sf_dir)
    model = fits.pca(rows, 10)
    fits.model_matrices(spark, model, scores=fits.pca_scores(rows, model)).write.partitionBy("key").parquet(path)
    stored = spark.read.schema(fits.MATRIX).parquet(path)
    again, _ = fits.load_model(stored)
    both = fits.pca_scores(rows, again).join(fits.matrix(stored, fits.SCORES).select(F.col("id").alias("cloud_id"), "values"), "cloud_id")
    same = F.forall(F.arrays_zip("scores", "values"), lambda p: F.abs(p["scores"] - p["values"]) < 1e-12)
    return both.select("cloud_id", F.size("scores").alias("n_scores"), same.alias("is_same"))


def _masked(spark, sf_dir):
    """The landmarks, with every third of them forbidden in turn, and none allowed in every fiftieth cloud."""
    i = F.sequence(F.lit(0), F.lit(20))
    allow = F.when(F.col("cloud_id") % 50 != 0, F.transform(i, lambda k: (k + F.col("cloud_id")) % 3 != 0))
    return landmark_clouds(spark, sf_dir).select("cloud_id", "pos", allow.alias("allow"))


_MASKED_SQL = f"{LANDMARKS_SQL}, am AS (SELECT cloud_id, vertex_id, x, y, z FROM lm WHERE (vertex_id + cloud_id) % 3 <> 0 AND cloud_id % 50 <> 0)"


@query(f"""WITH {_MASKED_SQL}, d AS (
    SELECT a.cloud_id AS a_id, b.cloud_id AS b_id, sqrt(avg((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS distance
    FROM am AS a JOIN am AS b ON a.vertex_id = b.vertex_id AND a.cloud_id <= b.cloud_id GROUP BY 1, 2)
SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(distance, 5) + 0 AS distance
FROM embeddings AS a JOIN embeddings AS b ON a.vec_id <= b.vec_id LEFT JOIN d ON a.vec_id = a_id AND b.vec_id = b_id""")
def masked_raw_matrix(spark, sf_dir):
    return fits.distance_matrix(_masked(spark, sf_dir), digits=5).select("a_id", "b_id", F.col("rounded").alias("distance"))


@query(f"""WITH {_MASKED_SQL}, d AS (
    SELECT a.cloud_id AS a_id, b.cloud_id AS b_id, count(*) AS n, sum((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS squares,
        sum(a.x - b.x) AS dx, sum(a.y - b.y) AS dy, sum(a.z - b.z) AS dz
    FROM am AS a JOIN am AS b ON a.vertex_id = b.vertex_id AND a.cloud_id <= b.cloud_id GROUP BY 1, 2)
SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(sqrt((squares - (dx * dx + dy * dy + dz * dz) / n) / n), 5) + 0 AS shifted, n IS NULL AS apart, CASE WHEN n > 0 THEN true END AS shorter
FROM embeddings AS a JOIN embeddings AS b ON a.vec_id <= b.vec_id LEFT JOIN d ON a.vec_id = a_id AND b.vec_id = b_id""")
def masked_aligned_matrix(spark, sf_dir):
    """Fitted pairs beside the same pairs only shifted (by each pair's own centroids): a fit is never farther, and is lost where nothing is shared."""
    both = fits.distance_matrix(_masked(spark, sf_dir), align=True, shifted=True, digits=5)
    shorter = F.col("distance") <= F.col("shifted") + 1e-6
    return both.select("a_id", "b_id", F.col("rounded").alias("shifted"), F.col("distance").isNull().alias("apart"), shorter.alias("shorter"))


@query()
def procrustes_matrix(spark, sf_dir):
    return fits.distance_matrix(landmark_clouds(spark, sf_dir), align=True)


@query(f"""WITH {LANDMARKS_SQL} SELECT a.cloud_id, a.vertex_id AS point_id, arg_min(b.vertex_id, (d, b.vertex_id)) AS nearest_id, round(min(d), 5) + 0 AS distance
FROM lm AS a JOIN lm AS b ON a.cloud_id = b.cloud_id AND a.vertex_id <> b.vertex_id,
LATERAL (SELECT sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d) GROUP BY 1, 2""")
def nearest_point(spark, sf_dir):
    points = landmarks(spark, sf_dir).select("cloud_id", F.col("vertex_id").cast("long").alias("point_id"), *XYZ)
    return spatial.nearest_point(points, points, "cloud_id").withColumn("distance", r("distance"))


# Meshes


def _order_faces(spark, sf_dir):
    """Each order line as a triangle between its part, its supplier and its order."""
    at = lambda key, k: (F.col(key) * 3 + k).cast("int").alias(f"i{k}")
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("face_id"), at("l_partkey", 0), at("l_suppkey", 1), at("l_orderkey", 2))


_ORDER_FACES_SQL = "faces AS (SELECT (l_partkey * 3)::INT AS i0, (l_suppkey * 3 + 1)::INT AS i1, (l_orderkey * 3 + 2)::INT AS i2 FROM lineitem)"
_RING_SQL = "ring AS (SELECT DISTINCT unnest([i0, i0, i1, i1, i2, i2]) AS v, unnest([i1, i2, i0, i2, i0, i1]) AS w FROM faces)"


@query(f"WITH {_ORDER_FACES_SQL}, e AS (SELECT unnest([(least(i0, i1), greatest(i0, i1)), (least(i1, i2), greatest(i1, i2)), (least(i0, i2), greatest(i0, i2))]) AS e FROM faces),"
       " o AS (SELECT e FROM e GROUP BY e HAVING count(*) = 1) SELECT DISTINCT unnest([e[1], e[2]])::INT AS vertex_id FROM o")
def mesh_boundary(spark, sf_dir):
    return top.boundary(_order_faces(spark, sf_dir))


@query(f"WITH {_ORDER_FACES_SQL}, k AS (SELECT unnest([i0, i1, i2]) AS v FROM faces) SELECT v::INT AS vertex_id, count(*) AS valence FROM k GROUP BY 1")
def vertex_valence(spark, sf_dir):
    return top.valence(_order_faces(spark, sf_dir))


@query(f"WITH {_ORDER_FACES_SQL}, {_RING_SQL} SELECT v::INT AS vertex_id, w::INT AS neighbour FROM ring")
def one_ring(spark, sf_dir):
    return top.one_ring(_order_faces(spark, sf_dir))


@query(f"""WITH {FACES_SQL}, {_RING_SQL}, m AS (SELECT vec_id AS cloud_id, v, avg(w % 8) AS mx, avg(w // 8) AS my, avg(embedding[w + 1]::DOUBLE) AS mz, any_value(embedding[v + 1]::DOUBLE) AS z
FROM embeddings, ring GROUP BY 1, 2), f AS (SELECT *, (v % 8)::DOUBLE AS x, (v // 8)::DOUBLE AS y, (v % 8) % 7 = 0 OR (v // 8) % 7 = 0 AS fixed FROM m)
SELECT cloud_id, v::INT AS vertex_id, {', '.join(f'round(CASE WHEN fixed THEN {k} ELSE 0.5 * {k} + 0.5 * m{k} END, 5) + 0 AS {k}' for k in XYZ)} FROM f""")
def mesh_fairing(spark, sf_dir):
    return top.fair(sheets(spark, sf_dir), sheet_faces(spark), 0.5).select("cloud_id", "vertex_id", *[r(k).alias(k) for k in XYZ])


def _areas(spark, sf_dir):
    return c.face_areas(sheet_clouds(spark, sf_dir), sheet_faces(spark))


@query(f"WITH {FACES_SQL}, {AREAS_SQL} SELECT cloud_id, face_id::INT AS face_id, round(area, 5) + 0 AS area FROM areas")
def triangle_area(spark, sf_dir):
    return _areas(spark, sf_dir).select("cloud_id", "face_id", r("area").alias("area"))


_SCALING_SQL = f"""WITH {FACES_SQL}, {AREAS_SQL}, q AS (
SELECT a.cloud_id, unnest([a.i0, a.i1, a.i2]) AS v, a.area / b.area AS ratio FROM areas AS a JOIN areas AS b ON b.cloud_id = 0 AND b.face_id = a.face_id)
SELECT cloud_id, v::INT AS vertex_id, round(avg({{}}), 5) + 0 AS scaling FROM q GROUP BY 1, 2"""


def _base(areas):
    return areas.where("cloud_id = 0")


@query(_SCALING_SQL.format("ratio"))
def face_scaling_field(spark, sf_dir):
    areas = _areas(spark, sf_dir)
    return c.face_scaling(_base(areas), areas).withColumn("scaling", r("scaling"))


@query(_SCALING_SQL.format("log10(ratio)"))
def face_scaling_field_log(spark, sf_dir):
    areas = _areas(spark, sf_dir)
    return c.face_scaling(_base(areas), areas, logarithm=True).withColumn("scaling", r("scaling"))


_NORMALS_SQL = f"""{FACES_SQL}, {AREAS_SQL}, ns AS (SELECT cloud_id, v, sum(cx) AS sx, sum(cy) AS sy, sum(cz) AS sz FROM (
SELECT cloud_id, unnest([i0, i1, i2]) AS v, cx, cy, cz FROM crossed) GROUP BY 1, 2),
nn AS (SELECT cloud_id, v, sx / l AS nx, sy / l AS ny, sz / l AS nz FROM (SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS l FROM ns))"""


def _normals(spark, sf_dir, robust=False):
    return top.normals(_areas(spark, sf_dir), robust)


@query(f"WITH {_NORMALS_SQL} SELECT cloud_id, v::INT AS vertex_id, round(nx, 5) + 0 AS nx, round(ny, 5) + 0 AS ny, round(nz, 5) + 0 AS nz FROM nn")
def normals_fast(spark, sf_dir):
    return _normals(spark, sf_dir).select("cloud_id", "vertex_id", *[r(n).alias(n) for n in ("nx", "ny", "nz")])


# The first two rows of a sheet fall together in one point, and the third comes close to it along x.
_CRUMPLED = {"x": "CASE WHEN {0} < 16 THEN 0.5 ELSE {0} % 8 END", "y": "CASE WHEN {0} < 16 THEN 0.5 ELSE {0} // 8 END", "z": "CASE WHEN {0} < 16 THEN embedding[1] ELSE embedding[{0} + 1] END"}
_SHORT_SQL = " OR ".join(f"({a}) < 1e-10" for a in ("ux * ux + uy * uy + uz * uz", "vx * vx + vy * vy + vz * vz", "(ux - vx) ** 2 + (uy - vy) ** 2 + (uz - vz) ** 2"))


@query(f"""WITH {FACES_SQL}, {areas_sql(**_CRUMPLED)}, ns AS (SELECT cloud_id, v, coalesce(sum(cx) FILTER (NOT short), 0) AS sx, coalesce(sum(cy) FILTER (NOT short), 0) AS sy,
coalesce(sum(cz) FILTER (NOT short), 0) AS sz FROM (SELECT cloud_id, unnest([i0, i1, i2]) AS v, cx, cy, cz, {_SHORT_SQL} AS short FROM crossed) GROUP BY 1, 2),
placed AS (SELECT ns.*, {', '.join(f'({e.format("v")})::DOUBLE AS p{n}' for n, e in _CRUMPLED.items())}, sqrt(sx * sx + sy * sy + sz * sz) AS l FROM ns JOIN embeddings ON vec_id = cloud_id)
SELECT cloud_id, v::INT AS vertex_id, {', '.join(f'round(CASE WHEN l > 0 THEN s{n} / l ELSE p{n} / sqrt(px * px + py * py + pz * pz) END, 5) + 0 AS n{n}' for n in XYZ)} FROM placed""")
def normals_robust(spark, sf_dir):
    rows = sheet_clouds(spark, sf_dir)
    fall = F.transform("pos", lambda v, i: F.when(i >= 48, v).when(i % 3 == 2, F.get("pos", F.lit(2))).otherwise(F.lit(0.5)))
    out = top.normals(c.face_areas(rows.withColumn("pos", fall), sheet_faces(spark)), robust=True)
    return out.select("cloud_id", "vertex_id", *[r(n).alias(n) for n in ("nx", "ny", "nz")])


@query(f"""WITH {SHEETS_SQL}, {_NORMALS_SQL}, m AS (SELECT vertex_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM sh GROUP BY 1),
s AS (SELECT sh.cloud_id, sh.vertex_id, (sh.x - m.x) * nx + (sh.y - m.y) * ny + (sh.z - m.z) * nz AS d,
sqrt((sh.x - m.x) ** 2 + (sh.y - m.y) ** 2 + (sh.z - m.z) ** 2) AS l FROM sh JOIN m USING (vertex_id) JOIN nn ON nn.cloud_id = sh.cloud_id AND nn.v = sh.vertex_id)
SELECT cloud_id, vertex_id::INT AS vertex_id, round(d, 5) + 0 AS signed_surface, round(abs(d), 5) + 0 AS surface, round(CASE WHEN d < 0 THEN -l ELSE l END, 5) + 0 AS signed_vertex FROM s""")
def distance_fields(spark, sf_dir):
    sh = sheets(spark, sf_dir)
    b = sh.join(_normals(spark, sf_dir), ["cloud_id", "vertex_id"])
    b = b.select("vertex_id", "cloud_id", *[F.col(k).alias(f"b{k}") for k in (*XYZ, "nx", "ny", "nz")])
    both = c.mean_shape(sh).join(b, "vertex_id")
    fields = {"signed_surface": c.signed_surface_distance(), "surface": c.surface_distance(), "signed_vertex": c.signed_vertex_distance()}
    return both.select("cloud_id", "vertex_id", *[r(v).alias(n) for n, v in fields.items()])


_REJECT_SQL = f"""{FACES_SQL}, {AREAS_SQL}, rej AS (SELECT DISTINCT a.cloud_id, unnest([a.i0, a.i1, a.i2]) AS v
FROM areas AS a JOIN areas AS b ON b.cloud_id = 0 AND b.face_id = a.face_id
WHERE a.area < 1e-10 OR b.area < 1e-10 OR a.area / b.area < 0.8 OR a.area / b.area > 1.25)"""


def _rejected(spark, sf_dir):
    areas = _areas(spark, sf_dir)
    return c.reject_by_scaling(_base(areas), areas, 0.8, 1.25)


@query(f"WITH {_REJECT_SQL} SELECT cloud_id, v::INT AS vertex_id FROM rej")
def face_scale_rejection(spark, sf_dir):
    return _rejected(spark, sf_dir)


@query(f"WITH {_REJECT_SQL} SELECT v::INT AS vertex_id, count(*) AS n_rejected, round(count(*) / (SELECT count(*) FROM embeddings), 6) AS rate FROM rej GROUP BY 1")
def rejection_rates(spark, sf_dir):
    n = table(spark, sf_dir, "embeddings").count()
    return c.rejection_rates(_rejected(spark, sf_dir), n).withColumn("rate", F.round("rate", 6))


@query(f"""WITH {_REJECT_SQL} SELECT k::INT AS vertex_id FROM range(0, 64) AS r(k) LEFT JOIN (SELECT v, count(*) AS c FROM rej GROUP BY 1) ON v = k
WHERE coalesce(c, 0) <= (SELECT ceil(0.2 * count(*)) FROM embeddings)""")
def whitelist(spark, sf_dir):
    n = table(spark, sf_dir, "embeddings").count()
    return c.whitelist(sheets(spark, sf_dir), c.rejection_rates(_rejected(spark, sf_dir), n), -(-n // 5))


@query(f"""WITH {LANDMARKS_SQL}, m AS (SELECT vertex_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM lm GROUP BY 1),
d AS (SELECT cloud_id, vertex_id, lm.x - m.x AS dx, lm.y - m.y AS dy, lm.z - m.z AS dz FROM lm JOIN m USING (vertex_id)),
o AS (SELECT cloud_id, vertex_id, sqrt((dx - avg(dx) OVER w) ** 2 + (dy - avg(dy) OVER w) ** 2 + (dz - avg(dz) OVER w) ** 2) AS d FROM d WINDOW w AS (PARTITION BY cloud_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY d, vertex_id) - 1 AS rn, count(*) OVER (PARTITION BY cloud_id) AS c FROM o),
q AS (SELECT *, max(d) FILTER (rn = c // 4) OVER p AS q1, max(d) FILTER (rn = 3 * c // 4) OVER p AS q3 FROM n WINDOW p AS (PARTITION BY cloud_id))
SELECT cloud_id, vertex_id::INT AS vertex_id, round(d, 5) + 0 AS distance, d > q3 + 1.5 * (q3 - q1) AS rejected FROM q""")
def iqr_outliers(spark, sf_dir):
    both = _to_mean(spark, sf_dir).select("cloud_id", "vertex_id", *[(F.col(k) - F.col(f"b{k}")).alias(f"d{k}") for k in XYZ])
    return c.reject_by_distance(both, 1.5).withColumn("distance", r("distance"))


# Fits


@query("""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), l AS (SELECT vec_id, i, v[i + 1] AS x FROM e, range(0, 64) AS r(i))
SELECT a.i::INT AS i, b.i::INT AS j, round(covar_samp(a.x, b.x), 5) + 0 AS covariance, count(*) AS n FROM l AS a JOIN l AS b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL
""")
def gram_matrix(spark, sf_dir):
    return fits.gram_matrix(_vectors(spark, sf_dir)).withColumn("covariance", r("covariance"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cloud_id"), F.col("embedding").cast("array<double>").alias("pos"))


@query()
def pca_explained(spark, sf_dir):
    model = fits.pca(_vectors(spark, sf_dir))
    rows = [(k, float(v), float(s), f"PC{k + 1} ({100 * s:.1f} %)") for k, (v, s) in enumerate(zip(model.variances, model.shares(), strict=True))]
    return spark.createDataFrame(rows, "component int, variance double, share double, label string")


@query()
def pca_scores(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return fits.pca_scores(rows, fits.pca(rows, 10))


@query()
def pca_synthesis(spark, sf_dir):
    rows = landmark_clouds(spark, sf_dir)
    model = fits.pca(rows, 2)
    shapes = [(float(a), float(b), [float(v) for v in model.predict(fits.np.array([a, b]))]) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return spark.createDataFrame(shapes, "pc1 double, pc2 double, pos array<double>")


@query()
def opa(spark, sf_dir):
    rows = landmark_clouds(spark, sf_dir)
    return fits.fit_to(rows, fits.mean_of(rows))


@query()
def gpa(spark, sf_dir):
    return fits.gpa(landmark_clouds(spark, sf_dir)).fitted


@query()
def kmeans(spark, sf_dir):
    return fits.kmeans(_vectors(spark, sf_dir), 10)


_GRID_SQL = f"""WITH {LANDMARKS_SQL}, u AS (SELECT cloud_id, vertex_id, {', '.join(f'({k} - min({k}) OVER w) * 3 / (max({k}) OVER w - min({k}) OVER w) AS u{k}, max({k}) OVER w - min({k}) OVER w AS s{k}' for k in XYZ)}
FROM lm WINDOW w AS (PARTITION BY cloud_id)), k AS (SELECT *, {', '.join(f'least(floor(u{k}), 2) AS c{k}' for k in XYZ)} FROM u),
o AS (SELECT *, round({' + '.join(f'(u{k} - c{k} - 0.5) ** 2 * s{k} ** 2' for k in XYZ)}, 12) AS d FROM k)
SELECT cloud_id, {{}}::INT AS vertex_id FROM o GROUP BY cloud_id, cx, cy, cz"""


@query(_GRID_SQL.format("min(vertex_id)"))
def grid_select_first(spark, sf_dir):
    return fits.grid_select(landmarks(spark, sf_dir), 3)


@query(_GRID_SQL.format("arg_min(vertex_id, (d, vertex_id))"))
def grid_select_central(spark, sf_dir):
    return fits.grid_select(landmarks(spark, sf_dir), 3, central=True)


@query()
def tps_transform(spark, sf_dir):
    rows = landmark_clouds(spark, sf_dir)
    mean = fits.mean_of(rows)
    return spline.warp(rows, spline.fit_spline(mean, mean * [1.0, 2.0, 0.5] + 0.1 * mean**2))


@query()
def impute(spark, sf_dir):
    rows = landmark_clouds(spark, sf_dir)
    out = rows.withColumn("rejected", F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: (i + F.col("cloud_id")) % 7 == 0))
    return spline.impute_clouds(out, fits.mean_of(rows), 3)


def _mesh(spark, sf_dir):
    mesh = sheet_clouds(spark, sf_dir).select(F.col("cloud_id").alias("mesh_id"), "pos")
    points = sheets(spark, sf_dir).where("x < 7 AND y < 7")
    points = points.select(F.col("cloud_id").alias("mesh_id"), F.col("vertex_id").cast("long").alias("point_id"), (F.col("x") + 0.3).alias("x"), (F.col("y") + 0.3).alias("y"), F.lit(1.0).alias("z"))
    return points, mesh, sheet_faces(spark)


def _closest_sql(points: str) -> str:
    """d2 of each point (cloud_id, point_id, x, y, z) and face: the plane where the foot is inside, else the nearest edge."""
    corner = lambda k, c: {"x": f"(i{k} % 8)::DOUBLE", "y": f"(i{k} // 8)::DOUBLE", "z": f"embedding[i{k} + 1]::DOUBLE"}[c]
    dot = lambda a, b: " + ".join(f"{a}{c} * {b}{c}" for c in XYZ)
    edge = lambda p, e, t: " + ".join(f"({p}{c} - {t} * {e}{c}) ** 2" for c in XYZ)
    return f"""{points}, soup AS (SELECT vec_id AS cloud_id, face_id, {', '.join(f'{corner(k, c)} AS k{k}{c}' for k in range(3) for c in XYZ)} FROM embeddings, faces),
rel AS (SELECT point_id, cloud_id, face_id, {', '.join(f'k1{c} - k0{c} AS u{c}, k2{c} - k0{c} AS v{c}, k2{c} - k1{c} AS w{c}, {c} - k0{c} AS p{c}, {c} - k1{c} AS q{c}' for c in XYZ)} FROM points JOIN soup USING (cloud_id)),
dots AS (SELECT *, {dot('u', 'u')} AS uu, {dot('u', 'v')} AS uv, {dot('v', 'v')} AS vv, {dot('w', 'w')} AS ww, {dot('p', 'u')} AS pu, {dot('p', 'v')} AS pv, {dot('q', 'w')} AS qw, {dot('p', 'p')} AS pp FROM rel),
bary AS (SELECT *, (vv * pu - uv * pv) / (uu * vv - uv * uv) AS s, (uu * pv - uv * pu) / (uu * vv - uv * uv) AS t,
    greatest(0, least(1, pu / uu)) AS tu, greatest(0, least(1, pv / vv)) AS tv, greatest(0, least(1, qw / ww)) AS tw FROM dots),
gaps AS (SELECT cloud_id, point_id, face_id, CASE WHEN s >= 0 AND t >= 0 AND s + t <= 1 THEN greatest(0, pp - s * pu - t * pv)
    ELSE least({edge('p', 'u', 'tu')}, {edge('p', 'v', 'tv')}, {edge('q', 'w', 'tw')}) END AS d2 FROM bary)"""


_POINTS_SQL = "points AS (SELECT vec_id AS cloud_id, k AS point_id, k % 8 + 0.3 AS x, k // 8 + 0.3 AS y, 1.0 AS z FROM embeddings, range(0, 64) AS r(k) WHERE k % 8 < 7 AND k // 8 < 7)"


@query(f"WITH {FACES_SQL}, {_closest_sql(_POINTS_SQL)} SELECT cloud_id AS mesh_id, point_id, round(sqrt(min(d2)), 5) + 0 AS distance FROM gaps GROUP BY 1, 2")
def nearest_triangle(spark, sf_dir):
    return spatial.nearest_triangle(*_mesh(spark, sf_dir)).select("mesh_id", "point_id", r("distance").alias("distance"))


@query("""SELECT vec_id AS mesh_id, k AS point_id, (2 * (k // 8 * 7 + k % 8))::BIGINT AS face_id, 0.3::DOUBLE AS u, 0.3::DOUBLE AS v, 0.4::DOUBLE AS w,
round(10 - (0.4 * embedding[k + 1]::DOUBLE + 0.3 * embedding[k + 2]::DOUBLE + 0.3 * embedding[k + 9]::DOUBLE), 5) + 0 AS t
FROM embeddings, range(0, 64) AS r(k) WHERE k % 8 < 7 AND k // 8 < 7""")
def raycast(spark, sf_dir):
    points, mesh, faces = _mesh(spark, sf_dir)
    rays = points.withColumns({"z": F.lit(10.0), "dx": F.lit(0.0), "dy": F.lit(0.0), "dz": F.lit(-1.0)})
    return spatial.raycast(rays, mesh, faces).select("mesh_id", "point_id", "face_id", *[r(n).alias(n) for n in ("t", "u", "v", "w")])


@query("""WITH placed AS (SELECT vec_id AS mesh_id, k AS point_id, k % 8 + 0.3 AS x, k // 8 + 0.3 AS y, 0.4 * embedding[k + 1]::DOUBLE + 0.3 * embedding[k + 2]::DOUBLE + 0.3 * embedding[k + 9]::DOUBLE AS z
FROM embeddings, range(0, 64) AS r(k) WHERE k % 8 < 7 AND k // 8 < 7) SELECT mesh_id, point_id, round(x, 5)::DOUBLE AS x, round(y, 5)::DOUBLE AS y, round(z, 5) + 0 AS z, true AS by_ray FROM placed""")
def surface_projection(spark, sf_dir):
    points, mesh, faces = _mesh(spark, sf_dir)
    upward = points.withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0)})
    return spatial.project(upward, mesh, faces, max_ratio=1e6).select("mesh_id", "point_id", *[r(k).alias(k) for k in XYZ], "by_ray")


@query()
def point_drift(spark, sf_dir):
    clouds = sheet_clouds(spark, sf_dir)
    return drift.register_all(clouds, fits.mean_of(clouds))


@query()
def dense_correspondence(spark, sf_dir):
    return compose.correspond(sheet_clouds(spark, sf_dir), sheet_faces(spark), _sheet_marks(spark, sf_dir))


@query()
def symmetric_meshes(spark, sf_dir):
    return compose.symmetrise(sheet_clouds(spark, sf_dir), _sheet_marks(spark, sf_dir), sheet_faces(spark))


def _sheet_marks(spark, sf_dir):
    """The corners of the sheets and the middles of two sides, as landmarks."""
    pos = F.concat(*[F.slice("pos", 3 * i + 1, 3) for i in (0, 7, 56, 63, 24, 31)])
    return sheet_clouds(spark, sf_dir).select("cloud_id", pos.alias("pos"))


_MARKS_SQL = "points AS (SELECT vec_id AS cloud_id, i AS point_id, (k % 8)::DOUBLE AS x, (k // 8)::DOUBLE AS y, embedding[k + 1]::DOUBLE + 1 AS z FROM embeddings, (VALUES (0, 0), (1, 7), (2, 56), (3, 63), (4, 24), (5, 31)) AS m(i, k))"


@query(f"WITH {FACES_SQL}, {_closest_sql(_MARKS_SQL)} SELECT cloud_id, point_id::INT AS vertex_id, round(sqrt(min(d2)), 5) + 0 AS \"offset\" FROM gaps GROUP BY 1, 2")
def landmark_offsets(spark, sf_dir):
    above = _sheet_marks(spark, sf_dir).withColumn("pos", F.transform("pos", lambda v, i: v + F.when(i % 3 == 2, 1.0).otherwise(0.0)))
    return compose.landmark_offsets(above, sheet_clouds(spark, sf_dir), sheet_faces(spark)).withColumn("offset", r("offset"))


# Vertex by vertex: labels as series and neighbours by number as pairs

_LINES_SQL = f"""{LANDMARKS_SQL}, p AS (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM embeddings),
l AS (SELECT label AS series_id, vertex_id::INT AS vertex_id, {', '.join(f'regr_slope({k}, pos) AS slope_{k}, avg({k}) - regr_slope({k}, pos) * avg(pos) AS intercept_{k}' for k in XYZ)}, count(*) AS n
FROM lm JOIN p ON vec_id = cloud_id GROUP BY 1, 2 HAVING count(*) >= 2)"""


def _label_series(spark, sf_dir):
    return t.series(table(spark, sf_dir, "embeddings"), "label", "vec_id", 2)


@query(f"WITH {_LINES_SQL} SELECT series_id, vertex_id, {', '.join(f'round({v}_{k}, 5) + 0 AS {v}_{k}' for k in XYZ for v in ('slope', 'intercept'))}, n FROM l")
def series_regression_vertices(spark, sf_dir):
    lines = compose.series_lines(_label_series(spark, sf_dir), landmarks(spark, sf_dir))
    return lines.select("series_id", "vertex_id", *[r(f"{v}_{k}").alias(f"{v}_{k}") for k in XYZ for v in ("slope", "intercept")], "n")


@query(f"WITH {_LINES_SQL} SELECT vertex_id, {', '.join(f'round(avg(slope_{k}), 5) + 0 AS {k}' for k in XYZ)}, count(*) AS n_series FROM l GROUP BY 1")
def average_slope_vertices(spark, sf_dir):
    return compose.average_slopes(_label_series(spark, sf_dir), landmarks(spark, sf_dir)).select("vertex_id", *[r(k).alias(k) for k in XYZ], "n_series")


@query(f"""WITH {LANDMARKS_SQL} SELECT a.vertex_id::INT AS vertex_id, {', '.join(f'round(avg(b.{k} - a.{k}), 5) + 0 AS {k}' for k in XYZ)}, count(*) AS n_pairs
FROM lm AS a JOIN lm AS b ON a.cloud_id % 2 = 0 AND b.cloud_id = a.cloud_id + 1 AND a.vertex_id = b.vertex_id GROUP BY 1""")
def average_difference_vertices(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 2").alias("id"), F.when(F.col("vec_id") % 2 == 0, "first").otherwise("second").alias("at"), "vec_id")
    out = compose.average_differences(t.pairs(rows, "id", "at", "first", "second", "vec_id"), landmarks(spark, sf_dir))
    return out.select("vertex_id", *[r(k).alias(k) for k in XYZ], "n_pairs")


def _two_groups(spark, sf_dir):
    rows = sheet_clouds(spark, sf_dir).withColumn("cs", 1 + F.col("label") / 10)
    return rows.where("label = 0"), rows.where("label = 1")


_MEANS_SQL = """means AS (SELECT k, {0} AS w, avg(embedding[k + 1]::DOUBLE) FILTER (label = 0) AS az, avg(embedding[k + 1]::DOUBLE) FILTER (label = 1) AS bz FROM embeddings, range(0, 64) AS r(k) GROUP BY k)"""


@query(f"""WITH {_MEANS_SQL.format('1.1::DOUBLE')}, d AS (SELECT k, ((w - 1) * (k % 8)) ** 2 + ((w - 1) * (k // 8)) ** 2 + (w * bz - az) ** 2 AS d2 FROM means)
SELECT k::INT AS vertex_id, round(sqrt(d2), 5) + 0 AS value, round(sqrt(avg(d2) OVER ()), 5) + 0 AS rms FROM d""")
def compare_groups_form(spark, sf_dir):
    out = compose.compare_groups(*_two_groups(spark, sf_dir), sheet_faces(spark), "vertex_distance", form=True)
    return out.select("vertex_id", r("value").alias("value"), r("rms").alias("rms"))


@query()
def compare_groups_registered(spark, sf_dir):
    return compose.compare_groups(*_two_groups(spark, sf_dir), sheet_faces(spark), "signed_surface_distance", register=True)


# What any right fit keeps to


@query(f"""WITH {LANDMARKS_SQL}, d AS (
    SELECT a.cloud_id AS a_id, b.cloud_id AS b_id, sum((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS squares, sum(a.x - b.x) AS dx, sum(a.y - b.y) AS dy, sum(a.z - b.z) AS dz
    FROM lm AS a JOIN lm AS b ON a.vertex_id = b.vertex_id AND a.cloud_id <= b.cloud_id GROUP BY 1, 2)
SELECT a_id, b_id, round(sqrt(greatest(0, (squares - (dx * dx + dy * dy + dz * dz) / 21) / 21)), 5) + 0 AS shifted, true AS shorter, a_id = b_id AS is_zero FROM d""")
def procrustes_matrix_bounds(spark, sf_dir):
    """Fitted distances beside those of the same pairs only shifted: never farther, and 0 just from a cloud to itself."""
    both = fits.distance_matrix(landmark_clouds(spark, sf_dir), align=True, shifted=True, digits=5)
    return both.select("a_id", "b_id", F.col("rounded").alias("shifted"), (F.col("distance") <= F.col("shifted") + 1e-6).alias("shorter"), (F.col("distance") < 1e-5).alias("is_zero"))


@query("SELECT vec_id AS cloud_id, 0.0::DOUBLE AS cx, 0.0::DOUBLE AS cy, 0.0::DOUBLE AS cz, 1.0::DOUBLE AS size, true AS is_nearest FROM embeddings")
def gpa_invariants(spark, sf_dir):
    """Fitted clouds lie around the origin with size 1, and none comes nearer to the mean by one more fit."""
    result = fits.gpa(landmark_clouds(spark, sf_dir))
    mean = fits._normalised(result.mean)
    gap = lambda a: F.sqrt(F.aggregate(F.zip_with(a, F.array(*map(F.lit, mean.ravel().tolist())), lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda t, v: t + v))
    again = fits.fit_to(result.fitted.select("cloud_id", "pos"), mean).select("cloud_id", F.col("pos").alias("_again"))
    stats = c.cloud_stats(c.unpack(result.fitted.select("cloud_id", "pos")))
    out = result.fitted.select("cloud_id", "pos").join(again, "cloud_id").join(stats, "cloud_id")
    return out.select("cloud_id", *[r(f"centre_{k}").alias(f"c{k}") for k in XYZ], r("size").alias("size"), (gap("_again") >= gap("pos") - 1e-9).alias("is_nearest"))


@query(f"WITH {LANDMARKS_SQL} SELECT cloud_id, vertex_id::INT AS vertex_id, {xyz_sql()}, true AS is_finite FROM lm WHERE (vertex_id + cloud_id) % 7 <> 0 UNION ALL"
       " SELECT cloud_id, vertex_id::INT, NULL, NULL, NULL, true FROM lm WHERE (vertex_id + cloud_id) % 7 = 0")
def impute_keeps_allowed(spark, sf_dir):
    """Imputation leaves the vertices that are not rejected where they are, and gives the others a place."""
    known = (F.col("vertex_id") + F.col("cloud_id")) % 7 != 0
    finite = F.forall(F.array(*XYZ), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e6))
    return c.unpack(impute(spark, sf_dir)).select("cloud_id", "vertex_id", *[F.when(known, r(k)).alias(k) for k in XYZ], finite.alias("is_finite"))


@query(f"""WITH {SHEETS_SQL}, m AS (SELECT vertex_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM sh GROUP BY 1), t AS (SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(x * x + y * y + z * z) AS s FROM m),
p AS (SELECT cloud_id, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(x * x + y * y + z * z) AS s FROM sh GROUP BY 1)
SELECT cloud_id, round((p.s + t.s - 2 * (p.x * t.x + p.y * t.y + p.z * t.z)) / 3, 5) + 0 AS first_sigma2, true AS falls, true AS is_registered FROM p, t""")
def drift_variance(spark, sf_dir):
    """The variance that a registration starts with, and that it ends with a smaller one."""
    clouds = sheet_clouds(spark, sf_dir)
    start = fits.mean_of(clouds)
    centre, size = fits.centre_and_size(start)
    stats = c.cloud_stats(c.unpack(clouds))
    first = (F.col("size") * F.col("size") + size**2 + sum((F.col(f"centre_{k}") - float(v)) * (F.col(f"centre_{k}") - float(v)) for k, v in zip(XYZ, centre))) / 3
    found = drift.register_all(clouds, start).join(stats.select("cloud_id", first.alias("_first")), "cloud_id")
    return found.select("cloud_id", r("_first").alias("first_sigma2"), (F.col("sigma2") < F.col("_first")).alias("falls"), (F.col("reason") != "numeric").alias("is_registered"))


@query(f"""WITH {LANDMARKS_SQL}, m AS (SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z FROM lm)
SELECT vec_id AS cloud_id, 0.0::DOUBLE AS skew, 1.0::DOUBLE AS turn, {', '.join(f'round(m.{k}, 5) + 0 AS centre_{k}' for k in XYZ)} FROM embeddings, m""")
def opa_invariants(spark, sf_dir):
    """The rotation is orthogonal and no reflection, and fitted clouds have the target's centre."""
    rot, pos = (lambda i: F.get("rot", F.lit(i))), F.col("pos")
    product = [sum((rot(3 * i + k) * rot(3 * j + k) for k in range(3)), F.lit(0.0)) - float(i == j) for i in range(3) for j in range(i, 3)]
    turn = g.dot(g.cross([rot(0), rot(1), rot(2)], [rot(3), rot(4), rot(5)]), [rot(6), rot(7), rot(8)])
    mean = lambda k: F.aggregate(F.filter(pos, lambda _, i: i % 3 == k), F.lit(0.0), lambda a, v: a + v) / (F.size(pos) / 3)
    return opa(spark, sf_dir).select("cloud_id", r(F.greatest(*[F.abs(p) for p in product])).alias("skew"), r(turn).alias("turn"), *[r(mean(k)).alias(f"centre_{c_}") for k, c_ in enumerate(XYZ)])


@query("""SELECT round(sum(v), 5) + 0 AS total_variance, 64::BIGINT AS n_components FROM (SELECT i, var_samp(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) AS r(i) GROUP BY i)""")
def pca_total_variance(spark, sf_dir):
    """Over all components, variances sum up to those of the coordinates."""
    model = fits.pca(_vectors(spark, sf_dir), 64)
    return spark.createDataFrame([(float(v),) for v in model.variances], "v double").agg(r(F.sum("v")).alias("total_variance"), F.count(F.lit(1)).alias("n_components"))


@query("SELECT i::INT AS i, j::INT AS j, 0.0::DOUBLE AS covariance FROM range(0, 10) AS a(i), range(0, 10) AS b(j) WHERE i < j")
def pca_scores_uncorrelated(spark, sf_dir):
    scores = pca_scores(spark, sf_dir).select(F.col("scores").alias("pos"))
    return fits.gram_matrix(scores).where("i < j").select("i", "j", r("covariance", 4).alias("covariance"))


@query(f"""WITH {LANDMARKS_SQL}, m AS (SELECT vertex_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM lm GROUP BY 1)
SELECT vertex_id::INT AS vertex_id, {', '.join(f'round({k} * {f} + 0.1 * {k} * {k}, 5) + 0 AS {k}' for k, f in zip(XYZ, (1.0, 2.0, 0.5), strict=True))} FROM m""")
def tps_at_controls(spark, sf_dir):
    """A spline takes its controls to their targets."""
    mean = fits.mean_of(landmark_clouds(spark, sf_dir))
    rows = spark.createDataFrame([(0, mean.ravel().tolist())], "cloud_id long, pos array<double>")
    out = c.unpack(spline.warp(rows, spline.fit_spline(mean, mean * [1.0, 2.0, 0.5] + 0.1 * mean**2)))
    return out.select("vertex_id", *[r(k).alias(k) for k in XYZ])


# Files: written from the given tables and read again


@query("""SELECT c_custkey, c_mktsegment || '; ' || c_name AS name, c_acctbal, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END AS segment,
c_acctbal > 0 AS in_credit, 0::BIGINT AS missing FROM customer""")
def delimited_round_trip(spark, sf_dir):
    path = scratch_folder(spark)
    customer = table(spark, sf_dir, "customer")
    rows = customer.select("c_custkey", F.concat_ws("; ", "c_mktsegment", "c_name").alias("name"), "c_acctbal", "c_mktsegment", (F.col("c_acctbal") > 0).alias("in_credit"))
    text.write_delimited(rows, path, ";")
    fields = [("c_custkey", "integer", 0), ("name", "string", 1), ("c_acctbal", "real", 2), ("segment", "factor", 3), ("in_credit", "boolean", 4), ("missing", "integer", 9)]
    levels = {"segment": ("BUILDING", "MACHINERY")}
    return text.typed(text.read_delimited(spark, path, ";", skip_first=True), [text.Field(*f, levels.get(f[0], ())) for f in fields])


def _cloud_name() -> Column:
    return F.concat(F.lit("cloud_id="), "cloud_id").alias("name")


def _cloud_named() -> Column:
    return F.regexp_extract("path", "#cloud_id=(-?[0-9]+)$", 1).cast("long").alias("cloud_id")


@query(f"WITH {SHEETS_SQL} SELECT cloud_id, vertex_id::INT AS vertex_id, {xyz_sql()} FROM sh")
def obj_round_trip(spark, sf_dir):
    path = scratch_folder(spark)
    point = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.concat_ws(" ", F.lit("v"), *[F.get("pos", i * 3 + k).cast("string") for k in range(3)]))
    face = sheet_faces(spark).agg(F.transform(F.array_sort(F.collect_list(F.struct("face_id", "i0", "i1", "i2"))), lambda f: F.concat_ws(" ", F.lit("f"), *[(f[f"i{k}"] + 1).cast("string") for k in range(3)])).alias("faces"))
    # The faces are one row of 98.
    files = sheet_clouds(spark, sf_dir).join(F.broadcast(face)).select(_cloud_name(), F.array_join(F.concat(point, "faces"), "\n").alias("value"))
    text.write_pages(files, path)
    vertices, _, _ = meshes.read_obj(spark, path, paged=True)
    return vertices.select(_cloud_named(), "vertex_id", *[r(k).alias(k) for k in XYZ])


_CODED_SQL = "lo + floor((v - lo) * (65535.0::DOUBLE / (hi - lo))) * ((hi - lo) / 65535.0::DOUBLE)"


@query(f"""WITH {SHEETS_SQL}, l AS (SELECT cloud_id, vertex_id, unnest(['x', 'y', 'z']) AS axis, unnest([x, y, z]) AS v FROM sh),
b AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM l WINDOW w AS (PARTITION BY cloud_id, axis)), c AS (SELECT cloud_id, vertex_id, axis, {_CODED_SQL} AS v FROM b)
SELECT cloud_id, vertex_id::INT AS vertex_id, {', '.join(f"round(max(v) FILTER (axis = '{k}'), 5) + 0 AS {k}" for k in XYZ)} FROM c GROUP BY 1, 2""")
def chunked_round_trip(spark, sf_dir):
    files = meshes.to_chunked(sheet_clouds(spark, sf_dir), encoding=meshes.FIXED).withColumn("path", F.col("cloud_id").cast("string"))
    vertices, _, _ = meshes.from_bytes(files, "chunked")
    return vertices.select(F.col("path").cast("long").alias("cloud_id"), "vertex_id", *[r(k).alias(k) for k in XYZ])


@query(f"WITH {LANDMARKS_SQL} SELECT cloud_id, vertex_id::INT AS vertex_id, {xyz_sql()} FROM lm")
def landmark_files_round_trip(spark, sf_dir):
    path = scratch_folder(spark)
    line = lambda i: F.concat_ws("\t", F.concat(F.lit("point "), i), *[F.get("pos", i * 3 + k).cast("string") for k in range(3)])
    files = landmark_clouds(spark, sf_dir).select(_cloud_name(), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(20)), line), "\n").alias("value"))
    text.write_pages(files, path)
    vertices, _, _ = meshes.read_meshes(spark, path, "landmarks", paged=True)
    return vertices.select(_cloud_named(), "vertex_id", *[r(k).alias(k) for k in XYZ])


@query(f"WITH {SHEETS_SQL} SELECT cloud_id, vertex_id::INT AS vertex_id, {xyz_sql()} FROM sh")
def ply_round_trip(spark, sf_dir):
    """Binary PLY made of the sheets, as columns of bytes, and read again."""
    head = "ply\nformat binary_little_endian 1.0\nelement vertex 64\n" + "".join(f"property double {k}\n" for k in XYZ) + "end_header\n"

    def encode(batches):
        for batch in meshes.slices(batches):
            content = [head.encode() + pos.values.to_numpy(zero_copy_only=False).astype("<f8").tobytes() for pos in batch.column("pos")]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(content, pa.binary())], ["path", "content"])

    files = sheet_clouds(spark, sf_dir).select(F.col("cloud_id").cast("string").alias("path"), "pos").mapInArrow(encode, "path string, content binary")
    vertices, _, _ = meshes.from_bytes(files, "ply")
    return vertices.select(F.col("path").cast("long").alias("cloud_id"), "vertex_id", *[r(k).alias(k) for k in XYZ])


# Functions


@query("SELECT c_custkey, [m] AS words FROM (SELECT c_custkey, sum(CASE WHEN (c_custkey >> b) & 1 = 1 THEN 3 * 4 ** b ELSE 0 END)::BIGINT AS m FROM customer, range(0, 16) AS u(b) GROUP BY c_custkey)")
def bit_mask_pack(spark, sf_dir):
    bits = F.array(*[F.col("c_custkey").bitwiseAND(1 << b) != 0 for b in range(16)])
    return table(spark, sf_dir, "customer").select("c_custkey", g.mask_words(bits, 2).alias("words"))


@query("SELECT l_orderkey, l_linenumber, (least(l_linenumber, l_quantity::INT)::BIGINT << 32) + greatest(l_linenumber, l_quantity::INT) AS edge FROM lineitem")
def edge_code(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", g.edge_key(F.col("l_linenumber").cast("int"), F.col("l_quantity").cast("int")).alias("edge"))


@query("""
WITH v AS (SELECT c_custkey, greatest(0, least(1, (c_acctbal + 1000) / 11000)) AS v FROM customer), s AS (SELECT c_custkey, (least(floor(v * 5), 4) + 0.5) / 5 AS v FROM v)
SELECT c_custkey, (floor(CASE WHEN v < 0.5 THEN v * 510 ELSE 255 END + 0.5) * 65536 + floor(CASE WHEN v < 0.5 THEN v * 510 ELSE 255 - (v - 0.5) * 510 END + 0.5) * 256
    + floor(CASE WHEN v < 0.5 THEN 255 ELSE 255 - (v - 0.5) * 510 END + 0.5))::INT AS color FROM s
""")
def lut_sample(spark, sf_dir):
    value = (F.col("c_acctbal") + 1000) / 11000
    return table(spark, sf_dir, "customer").select("c_custkey", color.sample(value, color.PALETTES["blue_red"], 5).alias("color"))
