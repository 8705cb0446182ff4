"""Scalar expressions, names, scenes and dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import expressions as E
from fieldloom.functions import geometry as G
from fieldloom.operators import tables as T
from fieldloom.plans import views as V
from fieldloom.plans.registry import Tables, query
from fieldloom.sources import names as N
from fieldloom.sources import scenes as C

PIXEL_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEY = ", ".join(PIXEL_KEY)


@query(
    "evi",
    f"""SELECT {KEY}, round(2.5 * (B8 / 10000 - B4 / 10000)
          / nullif(B8 / 10000 + 6 * (B4 / 10000) - 7.5 * (B2 / 10000) + 1, 0), 6) AS evi FROM v_bands""",
)
def evi(t: Tables) -> DataFrame:
    return V.bands(t).select(*PIXEL_KEY, E.evi("B8", "B4", "B2").alias("evi"))


@query(
    "hue",
    f"""WITH c AS (SELECT {KEY}, B4 / 10000 AS r, B3 / 10000 AS g, B2 / 10000 AS b FROM v_bands),
         m AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS span FROM c),
         s AS (SELECT *, CASE WHEN span = 0 THEN 0
                 WHEN hi = r THEN (g - b) / span WHEN hi = g THEN 2 + (b - r) / span
                 ELSE 4 + (r - g) / span END / 6 AS turned FROM m)
       SELECT {KEY}, round((turned - floor(turned)) * 1000, 6) AS hue FROM s""",
)
def hue(t: Tables) -> DataFrame:
    return V.bands(t).select(*PIXEL_KEY, E.scale_by(E.hue("B4", "B3", "B2"), 1000).alias("hue"))


@query(
    "cloud_flags",
    f"SELECT {KEY}, probability > 50 AS is_cloud, B8 < 1500 AND SCL <> 6 AS is_dark FROM v_bands",
)
def cloud_flags(t: Tables) -> DataFrame:
    return V.bands(t).select(
        *PIXEL_KEY, E.is_cloud("probability").alias("is_cloud"), E.is_dark("B8", "SCL").alias("is_dark")
    )


@query(
    "apply_mask",
    f"""SELECT {KEY}, CASE WHEN NOT probability > 50 THEN B2 END AS B2,
          CASE WHEN NOT probability > 50 THEN B4 END AS B4 FROM v_bands""",
)
def apply_mask(t: Tables) -> DataFrame:
    cloudy = E.is_cloud("probability")
    return V.bands(t).select(*PIXEL_KEY, *[E.apply_mask(b, cloudy).alias(b) for b in ("B2", "B4")])


@query("regex_columns", "SELECT B2, B3, B4, B8 FROM v_bands")
def regex_columns(t: Tables) -> DataFrame:
    return N.matching_columns(V.bands(t), "B.*")


@query(
    "recode_values",
    "SELECT id, CASE lc_name WHEN 'BUILDING' THEN 'urban' WHEN 'MACHINERY' THEN 'maize' ELSE lc_name END AS lc_name FROM v_points",
)
def recode_values(t: Tables) -> DataFrame:
    pairs = {"BUILDING": "urban", "MACHINERY": "maize"}
    return V.points(t).select("id", E.recode("lc_name", pairs).alias("lc_name"))


@query(
    "map_values",
    "SELECT id, CASE WHEN Field_size IS NULL THEN 0 WHEN Field_size = 'Small' THEN 15 WHEN Field_size = 'Medium' THEN 45 END AS code FROM v_points",
)
def map_values(t: Tables) -> DataFrame:
    return V.points(t).select("id", E.map_values("Field_size", {"Small": 15, "Medium": 45}, 0).alias("code"))


@query(
    "field_size_m",
    """SELECT id, CASE Field_size WHEN 'Small' THEN 5.0 WHEN 'Medium' THEN 10.0 WHEN 'Large' THEN 20.0 ELSE 10.0 END::DOUBLE AS metres
       FROM v_points""",
)
def field_size_m(t: Tables) -> DataFrame:
    return V.points(t).select("id", E.field_size_metres("Field_size").alias("metres"))


@query(
    "keep_drop_other",
    """SELECT id, CASE WHEN primar IN ('en', 'fr') THEN primar ELSE 'Other' END AS primar, username
       FROM v_obs WHERE primar IS NULL OR primar <> 'de'""",
)
def keep_drop_other(t: Tables) -> DataFrame:
    return E.keep_drop_other(V.observations(t), "primar", ["en", "fr"], ["de"]).select("id", "primar", "username")


@query(
    "null_safe_filter", "SELECT id, lc_name, del FROM v_points WHERE del IS DISTINCT FROM '1'"
)
def null_safe_filter(t: Tables) -> DataFrame:
    return V.points(t).where(E.not_equal_or_null("del", "1")).select("id", "lc_name", "del")


@query(
    "drop_null_rows",
    "SELECT id, lc_name, Field_size FROM v_points WHERE lc_name IS NOT NULL AND Field_size IS NOT NULL",
)
def drop_null_rows(t: Tables) -> DataFrame:
    return V.points(t).na.drop(subset=["lc_name", "Field_size"]).select("id", "lc_name", "Field_size")


_OBS = ["id", "username", "primar", "team_letter", "Quality", "n_chars"]


@query(
    "null_share",
    " UNION ALL ".join(
        f'SELECT \'{c}\' AS "column", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_share FROM v_obs'
        for c in _OBS
    ),
)
def null_share(t: Tables) -> DataFrame:
    return T.null_shares(V.observations(t))


@query(
    "null_counts",
    " UNION ALL ".join(
        f'SELECT \'{c}\' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM v_obs' for c in _OBS
    ),
)
def null_counts(t: Tables) -> DataFrame:
    return T.null_counts(V.observations(t))


@query(
    "drop_sparse_columns",
    "SELECT id, username, primar, team_letter, n_chars FROM v_obs",
)
def drop_sparse_columns(t: Tables) -> DataFrame:
    return T.drop_sparse_columns(V.observations(t))


_UNION = """WITH u AS (
  SELECT coalesce(a.x, b.x, c.x) AS x, coalesce(a.y, b.y, c.y) AS y,
         a.lc_name AS lc_name_lu, a.Field_size AS Field_size_lu, b.lc_name AS lc_name_other,
         b.Field_size AS Field_size_other, c.lc_name AS lc_name_more, c.Field_size AS Field_size_more
  FROM v_lu a FULL JOIN v_other b ON a.x = b.x AND a.y = b.y
  FULL JOIN v_more c ON coalesce(a.x, b.x) = c.x AND coalesce(a.y, b.y) = c.y)"""


def _layers(t: Tables) -> DataFrame:
    return T.point_union([("lu", V.layer_lu(t)), ("other", V.layer_other(t)), ("more", V.layer_more(t))])


@query("point_union", f"{_UNION} SELECT * FROM u")
def point_union(t: Tables) -> DataFrame:
    return _layers(t)


@query(
    "coalesce_priority",
    f"""{_UNION} SELECT x, y, coalesce(lc_name_more, lc_name_lu, lc_name_other) AS lc_name,
          coalesce(CAST(Field_size_more AS VARCHAR), Field_size_lu, CAST(Field_size_other AS VARCHAR)) AS Field_size,
          coalesce(CAST(Field_size_more AS VARCHAR), Field_size_lu) AS Field_size_literal,
          coalesce(Field_size_more, CASE Field_size_lu WHEN 'Small' THEN 5 WHEN 'Medium' THEN 10 WHEN 'Large' THEN 20 END,
            Field_size_other, 10)::DOUBLE AS metres
        FROM u""",
)
def coalesce_priority(t: Tables) -> DataFrame:
    size = [F.col(f"Field_size_{s}").cast("string") for s in ("more", "lu", "other")]
    name = [F.col(f"lc_name_{s}") for s in ("more", "lu", "other")]
    return _layers(t).select(
        "x", "y",
        E.coalesce_layers(*name).alias("lc_name"),
        E.coalesce_layers(*size).alias("Field_size"),
        E.coalesce_layers(*size, literal=True).alias("Field_size_literal"),
        E.field_size_metres(E.coalesce_layers(*size)).alias("metres"),
    )


@query(
    "union_by_name",
    """SELECT x, y, lc_name, CAST(Field_size AS VARCHAR) AS Field_size, 0 AS sample FROM v_lu UNION ALL
       SELECT x, y, lc_name, CAST(Field_size AS VARCHAR), NULL FROM v_other UNION ALL
       SELECT x, y, lc_name, CAST(Field_size AS VARCHAR), NULL FROM v_more""",
)
def union_by_name(t: Tables) -> DataFrame:
    def text(df: DataFrame) -> DataFrame:
        return df.withColumn("Field_size", F.col("Field_size").cast("string"))

    return T.stack_layers(
        text(V.layer_lu(t)).withColumn("sample", F.lit(0)), text(V.layer_other(t)), text(V.layer_more(t))
    )


@query(
    "filename_meta",
    """SELECT event_id, path,
         nullif(regexp_extract(path, 'S2_SR_([A-Za-z0-9]+)_M_', 1), '') AS band,
         CAST(replace(regexp_extract(path, '_M_(\\d{4}-\\d{2})', 1), '_', '-') || '-01' AS DATE) AS month,
         nullif(regexp_extract(path, '(\\d+-\\d+(-part[12])?)\\.tif$', 1), '') AS grid
       FROM v_files""",
)
def filename_meta(t: Tables) -> DataFrame:
    return N.filename_meta(V.files(t), "path").select("event_id", "path", "band", "month", "grid")


@query(
    "clean_columns",
    r"""SELECT event_id, replace(path, '.tif', '') AS name,
         regexp_replace(replace(path, '.tif', ''), '^(.+?)_\d{10}-\d{10}(-part\d+)?$', '\1') AS cleaned,
         regexp_replace(replace(path, '.tif', ''), '_[^_]*$', '') AS feature
       FROM v_files""",
)
def clean_columns(t: Tables) -> DataFrame:
    name = F.replace(F.col("path"), F.lit(".tif"), F.lit(""))
    return V.files(t).select(
        "event_id",
        name.alias("name"),
        N.clean_name_column(name).alias("cleaned"),
        N.feature_of_layer(F.col("path")).alias("feature"),
    )


@query(
    "pending_tiles",
    """SELECT DISTINCT kind AS band, grid FROM (
         SELECT *, nullif(regexp_extract(path, '(\\d+-\\d+(-part[12])?)\\.tif$', 1), '') AS grid FROM v_files)
       WHERE grid IS NOT NULL AND (kind, grid) NOT IN (
         SELECT kind, nullif(regexp_extract(path, '(\\d+-\\d+(-part[12])?)\\.tif$', 1), '') FROM v_files
         WHERE event_id % 3 = 0 AND event_id % 7 <> 0 AND event_id % 5 > 1)""",
)
def pending_tiles(t: Tables) -> DataFrame:
    named = N.filename_meta(V.files(t), "path").where(F.col("grid").isNotNull())
    wanted = named.select("band", "grid").distinct()
    # every third file is taken as written; two of five are too small to count
    done = named.where(F.col("event_id") % 3 == 0).select("band", "grid", (F.col("event_id") % 5).alias("bytes"))
    return N.pending(wanted, done, ["band", "grid"], min_bytes=1)


@query(
    "scene_filter",
    """SELECT scene_id, ts, round(cloud_pct, 6) AS cloud_pct FROM v_scenes
       WHERE max_x >= 100 AND min_x <= 600 AND max_y >= 50 AND min_y <= 500
         AND ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1998-01-01' AND cloud_pct <= 75""",
)
def scene_filter(t: Tables) -> DataFrame:
    box = (100.0, 50.0, 600.0, 500.0)
    found = C.scene_filter(V.scenes(t), box, dt.date(1997, 1, 1), dt.date(1997, 12, 31), 75)
    return found.select("scene_id", "ts", "cloud_pct")


@query(
    "total_bounds",
    "SELECT min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM v_points",
)
def total_bounds(t: Tables) -> DataFrame:
    return C.total_bounds(V.points(t))


@query(
    "month_bounds",
    """SELECT scene_id, CAST(date_trunc('month', ts) AS DATE) AS month_start, last_day(CAST(ts AS DATE)) AS month_end,
         strftime(ts, '%m%Y') AS month_key, CAST(dayofyear(ts) AS INTEGER) AS doy FROM v_scenes""",
)
def month_bounds(t: Tables) -> DataFrame:
    day = F.to_date("ts")
    return V.scenes(t).select(
        "scene_id",
        E.month_start(day).alias("month_start"),
        E.month_end(day).alias("month_end"),
        E.month_key(day).alias("month_key"),
        F.dayofyear(day).alias("doy"),
    )


@query(
    "exclude_containing",
    r"""SELECT p_partkey, p_name FROM part
        WHERE NOT contains(p_name, 'red') AND NOT contains(p_name, '.') AND NOT regexp_matches(p_name, 'b.l')""",
)
def exclude_containing(t: Tables) -> DataFrame:
    literal = E.excludes("p_name", ["red", "."])
    return t.part.where(literal & E.excludes("p_name", ["b.l"], regex=True)).select("p_partkey", "p_name")


@query(
    "layer_names",
    r"""SELECT p_partkey, replace(p_type || '_q_0_05', '_', '.') AS shown,
          regexp_replace(p_type || CASE WHEN p_partkey % 2 = 0 THEN '_0_05_0' ELSE '_0_05' END, '_0$', '') AS bare FROM part""",
)
def layer_names(t: Tables) -> DataFrame:
    tail = F.when(F.col("p_partkey") % 2 == 0, "_0_05_0").otherwise("_0_05")
    return t.part.select(
        "p_partkey",
        E.display_name(F.concat("p_type", F.lit("_q_0_05"))).alias("shown"),
        E.strip_layer_suffix(F.concat("p_type", tail)).alias("bare"),
    )


@query(
    "parse_estimates",
    """SELECT p_partkey, p_type AS metric, p_brand AS model, round(p_size / 100.0, 6) AS estimate,
         round((p_partkey % 10) / 100.0, 6) AS error FROM part""",
)
def parse_estimates(t: Tables) -> DataFrame:
    def hundredths(c):
        return F.concat(F.lit("0."), F.lpad(c.cast("string"), 2, "0"))

    text = F.concat(hundredths(F.col("p_size")), F.lit(" ± "), hundredths(F.col("p_partkey") % 10))
    nested = F.create_map("p_type", F.create_map("p_brand", text))
    rows = (
        t.part.select("p_partkey", F.explode(nested).alias("metric", "models"))
        .select("p_partkey", "metric", F.explode("models").alias("model", "text"))
    )
    estimate, error = E.parse_estimate("text")
    return rows.select("p_partkey", "metric", "model", estimate.alias("estimate"), error.alias("error"))


@query(
    "target_compare",
    """WITH s AS (SELECT p_type AS metric, p_brand AS model, avg(p_size) AS estimate FROM part GROUP BY ALL),
         g AS (SELECT p_type AS metric, avg(p_size) AS target FROM part WHERE p_type <> 'PROMO' GROUP BY p_type)
       SELECT s.metric, s.model, round(estimate, 6) AS estimate, round(target, 6) AS target,
         estimate > target AS above_target FROM s LEFT JOIN g ON g.metric = s.metric""",
)
def target_compare(t: Tables) -> DataFrame:
    scores = t.part.groupBy(F.col("p_type").alias("metric"), F.col("p_brand").alias("model")).agg(
        F.avg("p_size").alias("estimate")
    )
    targets = t.part.where("p_type <> 'PROMO'").groupBy(F.col("p_type").alias("metric")).agg(
        F.avg("p_size").alias("target")
    )
    return T.target_compare(scores, targets, "metric", "estimate")


@query(
    "crop_calendar",
    """WITH m AS (SELECT ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'] AS names),
         spans AS (
           SELECT p_partkey, p_size % 12 + 1 AS s, least(12, p_size % 12 + 1 + p_partkey % 3) AS e FROM part
           UNION ALL SELECT p_partkey, 1, 1 + p_partkey % 4 FROM part WHERE p_partkey % 5 = 0)
       SELECT p_partkey, names[s] AS start_month, names[e] AS end_month,
         CAST(date_diff('day', make_date(2022, s::BIGINT, 1), last_day(make_date(2022, e::BIGINT, 1))) AS INTEGER) AS days,
         CAST(covered AS INTEGER) AS month
       FROM (SELECT *, unnest(range(s, e + 1)) AS covered FROM spans), m""",
)
def crop_calendar(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(m) for m in E.MONTHS])

    def span(start, end):
        return F.struct(
            F.get(names, (start - 1).cast("int")).alias("start"), F.get(names, (end - 1).cast("int")).alias("end")
        )

    begin = F.col("p_size") % 12 + 1
    first = span(begin, F.least(F.lit(12), begin + F.col("p_partkey") % 3))
    second = span(F.lit(1), 1 + F.col("p_partkey") % 4)
    spans = F.when(F.col("p_partkey") % 5 == 0, F.array(first, second)).otherwise(F.array(first))
    rows = t.part.select("p_partkey", F.explode(spans).alias("p"))
    return rows.select(
        "p_partkey",
        F.col("p.start").alias("start_month"),
        F.col("p.end").alias("end_month"),
        E.month_span_days(F.col("p.start"), F.col("p.end"), 2022).alias("days"),
        F.explode(E.months_between_names(F.col("p.start"), F.col("p.end"))).alias("month"),
    )


@query(
    "month_order",
    """WITH r AS (SELECT o_orderpriority, strftime(o_orderdate, '%b') AS m, month(o_orderdate) AS k, count(*) AS n
                  FROM orders GROUP BY ALL)
       SELECT o_orderpriority, m AS month_name, CAST(k AS INTEGER) AS month_rank, n FROM r""",
)
def month_order(t: Tables) -> DataFrame:
    counts = t.orders.groupBy("o_orderpriority", F.date_format("o_orderdate", "MMM").alias("month_name")).agg(
        F.count(F.lit(1)).alias("n")
    )
    ranked = counts.withColumn("month_rank", E.category_rank("month_name", E.MONTHS))
    return ranked.orderBy("month_rank", "o_orderpriority").select("o_orderpriority", "month_name", "month_rank", "n")


def _utm_sql() -> str:
    import math

    k = G.KRUEGER
    e = 2 * math.sqrt(k["n"]) / (1 + k["n"])
    reach = G.SCALE_FACTOR * k["radius"]
    a1, a2, a3 = (repr(a) for a in k["alpha"])

    def cosh(x: str) -> str:
        return f"((exp({x}) + exp(-({x}))) / 2)"

    def sinh(x: str) -> str:
        return f"((exp({x}) - exp(-({x}))) / 2)"

    xi = "xi0 + " + " + ".join(f"{a}::DOUBLE * sin({2*j} * xi0) * {cosh(f'{2*j} * eta0')}" for j, a in enumerate((a1, a2, a3), 1))
    eta = "eta0 + " + " + ".join(f"{a}::DOUBLE * cos({2*j} * xi0) * {sinh(f'{2*j} * eta0')}" for j, a in enumerate((a1, a2, a3), 1))
    atanh = "0.5 * ln((1 + {0}) / (1 - ({0})))"
    inner = f"{atanh.format('sin(phi)')} - {e!r}::DOUBLE * ({atanh.format(f'{e!r}::DOUBLE * sin(phi)')})"
    return f"""WITH a AS (SELECT c_custkey, 33 + (c_custkey % 600) / 100.0::DOUBLE - 3 AS lon, -(c_custkey % 1000) / 100.0::DOUBLE AS lat FROM customer),
      r AS (SELECT *, radians(lat) AS phi, radians(lon - 33) AS lam FROM a),
      q AS (SELECT *, {sinh(inner)} AS tt FROM r),
      z AS (SELECT *, atan2(tt, cos(lam)) AS xi0, {atanh.format('(sin(lam) / sqrt(1 + tt * tt))')} AS eta0 FROM q)
    SELECT c_custkey, round(500000 + {reach!r}::DOUBLE * ({eta}), 3) AS x, round(10000000 + {reach!r}::DOUBLE * ({xi}), 3) AS y,
      round(lon, 6) AS lon_back, round(lat, 6) AS lat_back FROM z"""


@query("utm_project", _utm_sql())
def utm_project(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    at = t.customer.select(
        k, (F.lit(33) + (k % 600) / 100.0 - 3).alias("lon"), (-(k % 1000) / 100.0).alias("lat")
    )
    x, y = G.to_utm(F.col("lon"), F.col("lat"))
    there = at.select("c_custkey", x.alias("x"), y.alias("y"))
    lon, lat = G.from_utm(F.col("x"), F.col("y"))
    return there.select(
        "c_custkey", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"),
        (F.round(lon, 6) + 0.0).alias("lon_back"), (F.round(lat, 6) + 0.0).alias("lat_back"),
    )
