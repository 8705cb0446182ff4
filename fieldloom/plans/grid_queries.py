"""Pixel lookups, masks, discs, samples and folds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G
from fieldloom.functions.expressions import evi, field_size_metres, hue
from fieldloom.operators import grid as R
from fieldloom.operators import imagery as I
from fieldloom.operators import polygons as Y
from fieldloom.operators import sampling as P
from fieldloom.plans import views as V
from fieldloom.plans.registry import Tables, cte, query
from fieldloom.sources.scenes import total_bounds

WHERE = (V.X0, V.Y0, V.PIXEL)

cte(
    "v_sized",
    """SELECT *, CASE Field_size WHEN 'Small' THEN 5.0 WHEN 'Medium' THEN 10.0 WHEN 'Large' THEN 20.0 ELSE 10.0 END::DOUBLE AS r
       FROM v_points""",
)


def _sized(t: Tables) -> DataFrame:
    return V.points(t).withColumn("r", field_size_metres("Field_size"))


@query(
    "point_pixel_join",
    """SELECT p.id, p.x, p.y, CAST(floor((1000 - p.y) / 10) AS INTEGER) AS "row", CAST(floor(p.x / 10) AS INTEGER) AS col,
         round(g.value, 6) AS value
       FROM v_points p LEFT JOIN v_px g ON g."row" = floor((1000 - p.y) / 10) AND g.col = floor(p.x / 10)""",
)
def point_pixel_join(t: Tables) -> DataFrame:
    return R.point_pixel_join(V.points(t).select("id", "x", "y"), V.pixels(t), *WHERE)


@query(
    "disc_pixel_join",
    """SELECT p.id, g."row", g.col, round(g.value, 6) AS value FROM v_sized p JOIN v_px g
       ON power(least(greatest(p.x, g.col * 10), g.col * 10 + 10) - p.x, 2)
        + power(least(greatest(p.y, 1000 - (g."row" + 1) * 10), 1000 - g."row" * 10) - p.y, 2) < p.r * p.r""",
)
def disc_pixel_join(t: Tables) -> DataFrame:
    return R.disc_pixel_join(_sized(t), V.pixels(t), "id", "r", *WHERE)


# a field for each customer: a square with a square hole, every third one with a second square to its right
cte(
    "v_fields",
    """SELECT id, x + 0.25 AS x, y + 0.5 AS y, CAST(20 + 15 * (id % 4) AS DOUBLE) AS half, CAST(id % 3 * 8 AS DOUBLE) AS hole, id % 3 = 0 AS twin FROM v_points""",
)


def _fields(t: Tables) -> DataFrame:
    """The fields as binary geometries."""
    k = F.col("id")
    at = V.points(t).select("id", (F.col("x") + 0.25).alias("x"), (F.col("y") + 0.5).alias("y"), (20 + 15 * (k % 4)).cast("double").alias("half"), (k % 3 * 8).cast("double").alias("hole"))

    def square(half, right=0.0):
        left, rim, low, high = (F.col("x") + right - half), (F.col("x") + right + half), (F.col("y") - half), (F.col("y") + half)
        return F.array(*[F.array(a, b) for a, b in ((left, low), (rim, low), (rim, high), (left, high), (left, low))])

    outer = F.when(F.col("hole") > 0, F.array(square(F.col("half")), square(F.col("hole")))).otherwise(F.array(square(F.col("half"))))
    both = F.when(k % 3 == 0, F.array(outer, F.array(square(F.lit(4.0), 100.0)))).otherwise(F.array(outer))
    return at.select("id", Y.polygon_wkb(both).alias("geometry"))


@query(
    "polygon_pixel_join",
    """WITH s AS (
         SELECT id, x - half AS l, x + half AS r, y - half AS b, y + half AS u, x - hole AS hl, x + hole AS hr, y - hole AS hb, y + hole AS hu, hole > 0 AS holed FROM v_fields
         UNION ALL SELECT id, x + 96, x + 104, y - 4, y + 4, 0, 0, 0, 0, false FROM v_fields WHERE twin)
       SELECT s.id, g."row", g.col, round(g.value, 6) AS value FROM s JOIN v_px g
         ON g.col * 10 <= r AND g.col * 10 + 10 > l AND 1000 - g."row" * 10 >= b AND 990 - g."row" * 10 < u
        WHERE NOT (holed AND g.col * 10 > hl AND g.col * 10 + 10 <= hr AND 1000 - g."row" * 10 < hu AND 990 - g."row" * 10 >= hb)""",
)
def polygon_pixel_join(t: Tables) -> DataFrame:
    return Y.polygon_pixel_join(_fields(t), V.pixels(t), "id", "geometry", *WHERE).select("id", "row", "col", "value")


@query("bbox_filter", "SELECT id, x, y FROM v_points WHERE x BETWEEN 200 AND 700 AND y BETWEEN 100 AND 650")
def bbox_filter(t: Tables) -> DataFrame:
    return R.bbox_filter(V.points(t).select("id", "x", "y"), (200, 100, 700, 650))


@query(
    "tiles_with_points",
    """WITH g AS (SELECT DISTINCT "row" // 2 AS tile_row, col // 2 AS tile_col FROM v_px),
         p AS (SELECT DISTINCT CAST(floor(floor((1000 - y) / 10) / 2) AS INTEGER) AS tile_row,
                 CAST(floor(floor(x / 10) / 2) AS INTEGER) AS tile_col FROM v_points)
       SELECT g.tile_row, g.tile_col FROM g SEMI JOIN p ON p.tile_row = g.tile_row AND p.tile_col = g.tile_col""",
)
def tiles_with_points(t: Tables) -> DataFrame:
    tiles = R.with_tile(V.pixels(t), 2).select("tile_row", "tile_col").distinct()
    row, col = G.pixel_of(F.col("x"), F.col("y"), *WHERE)
    at = R.with_tile(V.points(t).select(row.alias("row"), col.alias("col")), 2)
    return R.tiles_with_points(tiles, at, ["tile_row", "tile_col"])


@query(
    "mosaic_max",
    """SELECT l_partkey % 100 AS "row", l_suppkey % 100 AS col, max(l_extendedprice) AS value FROM lineitem GROUP BY ALL""",
)
def mosaic_max(t: Tables) -> DataFrame:
    def layer(flag: str) -> DataFrame:
        return t.lineitem.where(F.col("l_linestatus") == flag).select(
            (F.col("l_partkey") % 100).alias("row"), (F.col("l_suppkey") % 100).alias("col"),
            F.col("l_extendedprice").alias("value"),
        )

    return R.mosaic_max([layer("O"), layer("F")], ["row", "col"], "value")


@query(
    "resample_nearest",
    """SELECT CAST(2 * g."row" + i AS INTEGER) AS "row", CAST(2 * g.col + j AS INTEGER) AS col, round(g.value, 6) AS value
       FROM v_px g, range(2) a(i), range(2) b(j)""",
)
def resample_nearest(t: Tables) -> DataFrame:
    return R.resample_nearest(V.pixels(t), 2)


@query(
    "tile_halves",
    """SELECT "row", col, CASE WHEN col < (lo + hi + 1) / 2 THEN 1 ELSE 2 END AS part
       FROM (SELECT *, min(col) OVER (PARTITION BY "row" // 10) AS lo, max(col) OVER (PARTITION BY "row" // 10) AS hi FROM v_px)""",
)
def tile_halves(t: Tables) -> DataFrame:
    px = V.pixels(t).withColumn("tile", F.floor(F.col("row") / 10))
    # one row per tile, joined back instead of a window over a whole tile
    ends = px.groupBy("tile").agg(F.min("col").alias("lo"), (F.max("col") + 1).alias("hi"))
    return R.tile_halves(px.join(ends, "tile"), "col", "lo", "hi").select("row", "col", "part")


@query(
    "buffer_boxes",
    """SELECT id, x - r AS min_x, y - r AS min_y, x + r AS max_x, y + r AS max_y, CAST(floor(r / 5) AS INTEGER) AS sample
       FROM v_sized""",
)
def buffer_boxes(t: Tables) -> DataFrame:
    return P.buffer_boxes(_sized(t), "r").select("id", "min_x", "min_y", "max_x", "max_y", "sample")


_U = "('0x' || substr(md5('42:{0}:' || id || ':' || i), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE"


@query(
    "disc_sample",
    f"""WITH n AS (SELECT id, lc_name, r, x, y, CAST(floor(r / 5) AS INTEGER) AS sample, row_number() OVER (ORDER BY id) AS sample_id FROM v_sized),
         d AS (SELECT *, unnest(range(1, sample + 1)) AS i FROM n)
       SELECT id, lc_name, r, x, y, 0 AS sample, 0::BIGINT AS sample_id FROM n
       UNION ALL SELECT id, lc_name, r, round(x + r * sqrt({_U.format('r')}) * cos(2 * pi() * ({_U.format('a')})), 6),
         round(y + r * sqrt({_U.format('r')}) * sin(2 * pi() * ({_U.format('a')})), 6), sample, sample_id FROM d""",
)
def disc_sample(t: Tables) -> DataFrame:
    return P.disc_sample(_sized(t).select("id", "lc_name", "r", "x", "y"), "id", "r")


# --- grids and hexagons -----------------------------------------------------------

SIDE = 60.0


def _hex_sql() -> str:
    return f"""SELECT id, x, y, CAST(cq AS BIGINT) AS hex_col, CAST(cr + (cq + ((cq % 2) + 2) % 2) / 2 AS BIGINT) AS hex_row FROM (
      SELECT *, CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS cq,
        CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END AS cr FROM (
        SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - s) AS ds FROM (
          SELECT *, floor(q + 0.5) AS rq, floor(r + 0.5) AS rr, floor(s + 0.5) AS rs FROM (
            SELECT id, x, y, x * {2 / 3!r}::DOUBLE / {SIDE} AS q, (-x / 3 + {math.sqrt(3) / 3!r}::DOUBLE * y) / {SIDE} AS r,
              -(x * {2 / 3!r}::DOUBLE / {SIDE}) - (-x / 3 + {math.sqrt(3) / 3!r}::DOUBLE * y) / {SIDE} AS s
            FROM (SELECT id, x, y FROM v_points)))))"""


cte("v_hex", _hex_sql())


def _hexes(t: Tables) -> DataFrame:
    col, row = G.hex_of(F.col("x"), F.col("y"), 0.0, 0.0, SIDE)
    return V.points(t).select("id", "x", "y", col.alias("hex_col"), row.alias("hex_row"))


@query("hex_bin", "SELECT id, hex_col, hex_row FROM v_hex")
def hex_bin(t: Tables) -> DataFrame:
    return _hexes(t).select("id", "hex_col", "hex_row")


@query(
    "hex_join",
    """WITH n AS (SELECT hex_col, hex_row, count(*) AS n FROM v_hex GROUP BY ALL)
       SELECT h.id, h.hex_col, h.hex_row, n.n FROM v_hex h JOIN n ON n.hex_col = h.hex_col AND n.hex_row = h.hex_row
       WHERE h.x BETWEEN 0 AND 600 AND h.y BETWEEN 0 AND 600""",
)
def hex_join(t: Tables) -> DataFrame:
    cells = _hexes(t).groupBy("hex_col", "hex_row").agg(F.count(F.lit(1)).alias("n"))
    inside = R.bbox_filter(_hexes(t), (0, 0, 600, 600))
    return inside.join(cells, ["hex_col", "hex_row"]).select("id", "hex_col", "hex_row", "n")


@query(
    "hex_grid",
    f"""WITH b AS (SELECT min(x) - 20 AS x0, min(y) - 20 AS y0, max(x) + 20 AS x1, max(y) + 20 AS y1 FROM v_points),
         c AS (SELECT *, unnest(range(0, CAST(ceil((x1 - x0) / (1.5 * {SIDE})) AS BIGINT) + 1)) AS hc FROM b),
         r AS (SELECT *, unnest(range(0, CAST(ceil((y1 - y0) / ({math.sqrt(3)!r}::DOUBLE * {SIDE})) AS BIGINT) + hc % 2 + 1)) AS hr FROM c)
       SELECT CAST(hc AS INTEGER) AS hex_col, CAST(hr AS INTEGER) AS hex_row, x0 + hc * (1.5 * {SIDE}) AS x,
         round(y0 + (hr - 0.5 * (hc % 2)) * ({math.sqrt(3)!r}::DOUBLE * {SIDE}), 6) AS y FROM r""",
)
def hex_grid(t: Tables) -> DataFrame:
    return G.hex_grid(total_bounds(V.points(t)), SIDE)


@query(
    "square_grid",
    f"""WITH b AS (SELECT min(x) - 20 AS x0, min(y) - 20 AS y0, max(x) + 20 AS x1, max(y) + 20 AS y1 FROM v_points),
         c AS (SELECT *, unnest(range(-1, CAST(ceil((x1 - x0) / {SIDE}) AS BIGINT) + 1)) AS gc FROM b),
         r AS (SELECT *, unnest(range(-1, CAST(ceil((y1 - y0) / {SIDE}) AS BIGINT) + 1)) AS gr FROM c)
       SELECT CAST(gc AS INTEGER) AS grid_col, CAST(gr AS INTEGER) AS grid_row, round(x0 + gc * {SIDE}, 6) AS x, round(y0 + gr * {SIDE}, 6) AS y FROM r""",
)
def square_grid(t: Tables) -> DataFrame:
    return G.square_grid(total_bounds(V.points(t)), SIDE)


@query("window_filter", 'SELECT "row", col, round(value, 6) AS value FROM v_px WHERE "row" BETWEEN 10 AND 29 AND col BETWEEN 2 AND 60')
def window_filter(t: Tables) -> DataFrame:
    return R.window_filter(V.pixels(t), (10, 29), (2, 60))


# --- masks ------------------------------------------------------------------------

cte("v_mask", 'SELECT "row", col, value > 50500 AS flag FROM v_px')
cte("v_off", "SELECT i - 2 AS dy, j - 2 AS dx FROM range(5) a(i), range(5) b(j) WHERE (i - 2) * (i - 2) + (j - 2) * (j - 2) <= 4")


def _mask(t: Tables) -> DataFrame:
    return V.pixels(t).select(F.lit(0).alias("tile"), "row", "col", (F.col("value") > 50500).alias("flag"))


@query(
    "mask_morphology",
    """WITH bad AS (SELECT DISTINCT m."row" + dy AS "row", m.col + dx AS col FROM v_mask m, v_off WHERE NOT flag),
         er AS (SELECT m."row", m.col, flag AND b."row" IS NULL AS e FROM v_mask m LEFT JOIN bad b ON b."row" = m."row" AND b.col = m.col),
         gr AS (SELECT DISTINCT m."row" + dy AS "row", m.col + dx AS col FROM v_mask m, v_off WHERE flag)
       SELECT er."row", er.col, er.e AS eroded, g."row" IS NOT NULL AS dilated
       FROM er LEFT JOIN gr g ON g."row" = er."row" AND g.col = er.col""",
)
def mask_morphology(t: Tables) -> DataFrame:
    shrunk = R.erode(_mask(t), ["tile"], "flag", 2, "eroded")
    return R.dilate(shrunk, ["tile"], "flag", 2, "dilated").select("row", "col", "eroded", "dilated")


def _near(radius: int, table: str, flag: str) -> str:
    span = 2 * radius + 1
    return f"""SELECT DISTINCT m."row" + i - {radius} AS "row", m.col + j - {radius} AS col
      FROM {table} m, range({span}) a(i), range({span}) b(j)
      WHERE {flag} AND (i - {radius}) * (i - {radius}) + (j - {radius}) * (j - {radius}) <= {radius * radius}"""


@query(
    "cloudmask",
    f"""WITH m0 AS (SELECT "row", col, value > 50500 AS flag FROM v_px),
         bad AS ({_near(2, "m0", "NOT flag")}),
         er AS (SELECT m0."row", m0.col, flag AND b."row" IS NULL AS e FROM m0 LEFT JOIN bad b ON b."row" = m0."row" AND b.col = m0.col),
         gr AS ({_near(18, "er", "e")})
       SELECT er."row", er.col, g."row" IS NOT NULL AS cloudmask FROM er LEFT JOIN gr g ON g."row" = er."row" AND g.col = er.col""",
)
def cloudmask(t: Tables) -> DataFrame:
    clouds = V.pixels(t).select(F.lit(0).alias("tile"), "row", "col", (F.col("value") > 50500).alias("flag"))
    return R.clean_mask(clouds, ["tile"], "flag").select("row", "col", "cloudmask")


@query(
    "cloud_shadow",
    """WITH px AS (SELECT "row", col, value > 56000 AS cloud, value < 50000 AS dark, CAST("row" % 3 * 90 + 15 AS DOUBLE) AS az,
                     "row" % 3 AS scene FROM v_px),
         c AS (SELECT DISTINCT scene, CAST("row" - round(sin(radians(90 - az)) * d) AS INTEGER) AS "row",
                 CAST(col + round(cos(radians(90 - az)) * d) AS INTEGER) AS col FROM px, range(1, 21) k(d) WHERE cloud)
       SELECT px.scene, px."row", px.col, dark AND c."row" IS NOT NULL AS shadow
       FROM px LEFT JOIN c ON c.scene = px.scene AND c."row" = px."row" AND c.col = px.col""",
)
def cloud_shadow(t: Tables) -> DataFrame:
    px = V.pixels(t).select(
        (F.col("row") % 3).alias("scene"), "row", "col",
        (F.col("value") > 56000).alias("cloud"), (F.col("value") < 50000).alias("dark"),
        (F.col("row") % 3 * 90 + 15).cast("double").alias("azimuth"),
    )
    return R.cloud_shadow(px, ["scene"], "cloud", "dark", "azimuth").select("scene", "row", "col", "shadow")


# --- the imagery chain --------------------------------------------------------------

def _near_in_scene(radius: int, table: str, flag: str) -> str:
    return _near(radius, table, flag).replace("SELECT DISTINCT ", "SELECT DISTINCT m.scene, ", 1)


cte(
    "v_clear_px",
    f"""SELECT p.* FROM v_scene_px p WHERE (p.scene, p."row", p.col) NOT IN (
         WITH casts AS (SELECT DISTINCT scene, CAST("row" // 10 - round(sin(radians(90 - azimuth)) * d) AS INTEGER) AS r,
             CAST(col // 10 + round(cos(radians(90 - azimuth)) * d) AS INTEGER) AS c FROM v_scene_px, range(1, 21) k(d) WHERE cloud),
         fl AS (SELECT px.scene, px."row", px.col, cloud OR (dark AND casts.r IS NOT NULL) AS flag FROM v_scene_px px
           LEFT JOIN casts ON casts.scene = px.scene AND casts.r = px."row" // 10 AND casts.c = px.col // 10),
         bad AS ({_near_in_scene(2, "fl", "NOT flag")}),
         er AS (SELECT fl.scene, fl."row", fl.col, flag AND b."row" IS NULL AS e FROM fl
           LEFT JOIN bad b ON b.scene = fl.scene AND b."row" = fl."row" AND b.col = fl.col),
         gr AS ({_near_in_scene(18, "er", "e")})
         SELECT scene, "row", col FROM gr)""",
)
_CELLS = """SELECT k."row", k.col, k.slot, CAST(trunc(least(greatest(coalesce({value}, 0), {low}), {high})) AS {kind}) AS value
    FROM (SELECT DISTINCT "row", col, slot FROM v_scene_px) k LEFT JOIN m ON m."row" = k."row" AND m.col = k.col AND m.slot = k.slot"""


@query(
    "evi_composite",
    """WITH m AS (SELECT "row", col, slot, median(10000 * ((2.5 * (B8 / 10000 - B4 / 10000)) / nullif(B8 / 10000 + 6 * (B4 / 10000) - 7.5 * (B2 / 10000) + 1, 0))) AS v
       FROM v_clear_px GROUP BY ALL) """
    + _CELLS.format(value="v", low=-32768, high=32767, kind="SMALLINT"),
)
def evi_composite(t: Tables) -> DataFrame:
    """Clouds and shadows, mask, index of each pixel, monthly median, stored as a small integer."""
    bands = {"v": 10000 * evi("B8", "B4", "B2")}
    return I.cloud_free_composite(V.scene_pixels(t), ["scene"], ["row", "col"], "slot", bands, F.col("v"))


@query(
    "hue_composite",
    """WITH b AS (SELECT "row", col, slot, median(B4) / 10000 AS r, median(B3) / 10000 AS g, median(B2) / 10000 AS b FROM v_clear_px GROUP BY ALL),
       h AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS span FROM b),
       s AS (SELECT *, CASE WHEN hi = r THEN (g - b) / nullif(span, 0) WHEN hi = g THEN 2 + (b - r) / nullif(span, 0) ELSE 4 + (r - g) / nullif(span, 0) END / 6 AS x FROM h),
       m AS (SELECT *, 10000 * CASE WHEN span = 0 THEN 0.0 ELSE x - floor(x) END AS v FROM s) """
    + _CELLS.format(value="v", low=0, high=65535, kind="INTEGER"),
)
def hue_composite(t: Tables) -> DataFrame:
    """The same with the median of the bands first and the hue of the medians."""
    bands = {n: F.col(n) for n in ("B4", "B3", "B2")}
    return I.cloud_free_composite(V.scene_pixels(t), ["scene"], ["row", "col"], "slot", bands, 10000 * hue("B4", "B3", "B2"), "uint16")


# --- folds and samples ------------------------------------------------------------

_DRAW = "('0x' || substr(md5('{0}:' || {1}), 1, 15))::BIGINT"


@query(
    "stratified_folds",
    f"""SELECT id, lc_name, CAST((row_number() OVER (PARTITION BY lc_name ORDER BY {_DRAW.format(0, 'id')}, id) - 1) % 5 AS INTEGER) AS fold
        FROM v_points""",
)
def stratified_folds(t: Tables) -> DataFrame:
    return P.stratified_folds(V.points(t).select("id", "lc_name"), "lc_name", "id", 5)


@query(
    "group_folds",
    f"""WITH c AS (SELECT user_id AS grp, event_type AS label, count(*) AS n FROM events GROUP BY ALL),
          m AS (SELECT grp, first(label ORDER BY n DESC, label) AS main, sum(n) AS size FROM c GROUP BY grp),
          k AS (SELECT grp, row_number() OVER (PARTITION BY main ORDER BY size DESC, {_DRAW.format(42, 'grp')}, grp) - 1 AS nth FROM m),
          f AS (SELECT grp, CAST(CASE WHEN nth % 10 < 5 THEN nth % 10 ELSE 9 - nth % 10 END AS INTEGER) AS fold FROM k)
        SELECT e.event_id, f.grp, e.event_type AS label, f.fold FROM events e JOIN f ON f.grp = e.user_id""",
)
def group_folds(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.col("user_id").alias("grp"), F.col("event_type").alias("label"))
    return P.group_folds(rows, "grp", "label", 5)


@query(
    "sample_per_class",
    f"""SELECT id, primar, Quality FROM (
          SELECT *, row_number() OVER (PARTITION BY primar ORDER BY {_DRAW.format(1, 'id')}, id) AS nth FROM v_obs)
        WHERE nth <= 12""",
)
def sample_per_class(t: Tables) -> DataFrame:
    return P.sample_per_class(V.observations(t), "primar", "id", 12).select("id", "primar", "Quality")


@query(
    "shuffle_split",
    f"""WITH r AS (SELECT id, lc_name, row_number() OVER (PARTITION BY lc_name ORDER BY {_DRAW.format(42, 'id')}, id) AS nth,
               count(*) OVER (PARTITION BY lc_name) AS size FROM v_points)
        SELECT id, lc_name, nth <= round(size * 0.2) AS is_test FROM r""",
)
def shuffle_split(t: Tables) -> DataFrame:
    return P.shuffle_split(V.points(t).select("id", "lc_name"), "lc_name", "id")


@query(
    "point_hex",
    """SELECT id, x, y, id % 11 = 0 AS bad_point FROM (
         SELECT id, CASE WHEN id % 11 <> 0 THEN x + 0.25 END AS x, CASE WHEN id % 11 <> 0 THEN -y / 4 END AS y FROM v_points)""",
)
def point_hex(t: Tables) -> DataFrame:
    from fieldloom.sources.files import load_points, save_points

    moved = V.points(t).select("id", (F.col("x") + 0.25).alias("x"), (-F.col("y") / 4).alias("y"))
    stored = save_points(moved)
    broken = stored.withColumn("geometry", F.when(F.col("id") % 11 == 0, "0103").otherwise(F.col("geometry")))
    return load_points(broken).withColumn("y", F.col("y") + 0.0)


@query(
    "geojson_lines",
    """SELECT id, lc_name, x, y FROM v_points""",
)
def geojson_lines(t: Tables) -> DataFrame:
    from fieldloom.sources.files import FEATURE, feature_lines

    lines = feature_lines(V.points(t).select("id", "lc_name", "x", "y"))
    feature = FEATURE.format("struct<id bigint, lc_name string>")
    parsed = lines.select(F.from_json("value", feature).alias("f"))
    at = F.col("f.geometry.coordinates")
    return parsed.select("f.properties.*", at[0].alias("x"), at[1].alias("y"))


@query(
    "geojson_collection",
    """SELECT id, lc_name, x, y FROM v_points""",
)
def geojson_collection(t: Tables) -> DataFrame:
    from fieldloom.session import new_folder
    from fieldloom.sources.features import write_collections
    from fieldloom.sources.files import feature_lines, read_geojson

    path = new_folder(t.spark, "collection")
    write_collections(feature_lines(V.points(t).select("id", "lc_name", "x", "y")), path)
    return read_geojson(t.spark, path, "struct<id bigint, lc_name string>")


@query(
    "point_layer",
    "SELECT id, lc_name, x, y, 32736 AS srid FROM v_points",
)
def point_layer(t: Tables) -> DataFrame:
    from fieldloom.sources.files import points_from_columns

    return points_from_columns(V.points(t).select("id", "lc_name", "x", "y"), "x", "y", 32736)




@query(
    "geojson_written",
    """SELECT id, lc_name, x, y FROM v_points""",
)
def geojson_written(t: Tables) -> DataFrame:
    """Points written as features, one a line, and read back."""
    from fieldloom.session import new_folder
    from fieldloom.sources.files import read_geojson, write_geojson

    path = new_folder(t.spark, "features")
    write_geojson(V.points(t).select("id", "lc_name", "x", "y"), path)
    return read_geojson(t.spark, path, "struct<id bigint, lc_name string>", collection=False)


@query(
    "csv_written",
    """SELECT id, lc_name, x, y FROM v_points""",
)
def csv_written(t: Tables) -> DataFrame:
    """Points written as CSV and read back by their schema."""
    from fieldloom.session import new_folder
    from fieldloom.sources.files import read_csv, write_csv

    path = new_folder(t.spark, "csv")
    points = V.points(t).select("id", "lc_name", "x", "y")
    write_csv(points, path)
    return read_csv(t.spark, path, points.schema)


@query(
    "tiles_written",
    """SELECT "row", col, round(value, 6) AS value, CAST("row" // 50 * 2 + col // 50 AS INTEGER) AS tile, CAST(col % 2 AS INTEGER) AS band FROM v_px""",
)
def tiles_written(t: Tables) -> DataFrame:
    """Pixels written by band and tile, the first tile a second time, and read back: touched folders only are replaced."""
    from fieldloom.session import new_folder
    from fieldloom.sources.files import read_parquet, write_tiles

    path = new_folder(t.spark, "tiles")
    tile = F.floor(F.col("row") / 50) * 2 + F.floor(F.col("col") / 50)
    tiles = V.pixels(t).withColumn("tile", tile.cast("int")).withColumn("band", (F.col("col") % 2).cast("int"))
    write_tiles(tiles, path)
    write_tiles(tiles.where("tile = 0"), path)
    return read_parquet(t.spark, path).select(*tiles.columns)
