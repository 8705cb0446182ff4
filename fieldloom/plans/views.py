"""Stand-ins for imagery, labels and observations, derived from the given tables.

Each view exists twice: as a DataFrame and as a shared SQL subquery.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import series as S
from fieldloom.plans.registry import Tables, cte

BANDS = ["click", "error", "purchase", "signup", "view"]
CELL = ["cell"]
SERIES = ["cell", "band"]

# Shape of the pixel stand-in: ten-unit cells, upper left corner at (0, 1000).
X0, Y0, PIXEL = 0.0, 1000.0, 10.0


# raw observations of a cell and band
cte("v_raw", "SELECT user_id AS cell, event_type AS band, CAST(ts AS DATE) AS slot, value FROM events")


def raw(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("user_id").alias("cell"), F.col("event_type").alias("band"), F.to_date("ts").alias("slot"), "value"
    )


cte(
    "v_comp",
    """SELECT cell, band, slot, median(nullif(value, 0)) AS value
       FROM v_raw GROUP BY cell, band, slot""",
)


def composite(t: Tables) -> DataFrame:
    return S.median_composite(raw(t), CELL, "band", "slot", "value")


cte(
    "v_cal",
    """SELECT CAST(g AS DATE) AS slot, row_number() OVER (ORDER BY g) - 1 AS pos
       FROM (SELECT unnest(generate_series((SELECT min(slot) FROM v_raw),
                                           (SELECT max(slot) FROM v_raw), INTERVAL 1 DAY)) AS g)""",
)
cte(
    "v_grid",
    """SELECT k.cell, k.band, c.slot, c.pos, m.value
       FROM (SELECT DISTINCT cell, band FROM v_comp) k CROSS JOIN v_cal c
       LEFT JOIN v_comp m ON m.cell = k.cell AND m.band = k.band AND m.slot = c.slot""",
)
cte(
    "v_near",
    """SELECT *,
         last_value(value IGNORE NULLS) OVER pre AS w0,
         first_value(value IGNORE NULLS) OVER post AS w1,
         last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER pre AS p0,
         first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER post AS p1
       FROM v_grid
       WINDOW pre AS (PARTITION BY cell, band ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
              post AS (PARTITION BY cell, band ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""",
)
cte(
    "v_full",
    """SELECT cell, band, slot, pos,
         coalesce(value, w0 + (w1 - w0) * (CAST(pos - p0 AS DOUBLE) / (p1 - p0)), w0, w1) AS value
       FROM v_near""",
)


def full(t: Tables) -> DataFrame:
    return S.filled_series(raw(t), CELL, "band", "slot", "value")


# labelled points; one per customer
cte(
    "v_points",
    """SELECT c_custkey AS id, c_mktsegment AS lc_name,
         CAST((c_custkey * 7919) % 1000 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 1000 AS DOUBLE) AS y,
         CASE c_custkey % 4 WHEN 0 THEN 'Small' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Large' END AS Field_size,
         CASE c_custkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '0' END AS del
       FROM customer""",
)


def points(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(
        k.alias("id"),
        F.col("c_mktsegment").alias("lc_name"),
        ((k * 7919) % 1000).cast("double").alias("x"),
        ((k * 104729) % 1000).cast("double").alias("y"),
        F.when(k % 4 == 0, "Small").when(k % 4 == 1, "Medium").when(k % 4 == 2, "Large").alias("Field_size"),
        F.when(k % 3 == 0, "1").when(k % 3 == 1, "0").alias("del"),
    )


# one layer of pixels
cte(
    "v_px",
    """SELECT CAST(l_partkey % 100 AS INTEGER) AS "row", CAST(l_suppkey % 100 AS INTEGER) AS col,
         sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / count(*) / 100 AS value
       FROM lineitem GROUP BY ALL""",
)


def pixels(t: Tables) -> DataFrame:
    return (
        t.lineitem.groupBy(
            (F.col("l_partkey") % 100).cast("int").alias("row"), (F.col("l_suppkey") % 100).cast("int").alias("col")
        )
        # whole cents add up alike in any order
        .agg(
            (F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / F.count(F.lit(1)) / 100).alias("value")
        )
    )


# three label layers whose coordinates meet on purpose
cte("v_lu", "SELECT c_custkey AS x, c_custkey % 97 AS y, c_mktsegment AS lc_name, CASE c_custkey % 4 WHEN 0 THEN 'Small' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Large' END AS Field_size FROM customer")
cte("v_other", "SELECT s_suppkey * 2 AS x, (s_suppkey * 2) % 97 AS y, 'nation' || s_nationkey AS lc_name, 25 AS Field_size FROM supplier")
cte("v_more", "SELECT p_partkey AS x, p_partkey % 97 AS y, p_type AS lc_name, CASE p_type WHEN 'ECONOMY' THEN 15 WHEN 'PROMO' THEN 10 ELSE 5 END AS Field_size FROM part")


def layer_lu(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    size = F.when(k % 4 == 0, "Small").when(k % 4 == 1, "Medium").when(k % 4 == 2, "Large")
    return t.customer.select(k.alias("x"), (k % 97).alias("y"), F.col("c_mktsegment").alias("lc_name"), size.alias("Field_size"))


def layer_other(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") * 2
    name = F.concat(F.lit("nation"), F.col("s_nationkey"))
    return t.supplier.select(k.alias("x"), (k % 97).alias("y"), name.alias("lc_name"), F.lit(25).alias("Field_size"))


def layer_more(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    size = F.when(F.col("p_type") == "ECONOMY", 15).when(F.col("p_type") == "PROMO", 10).otherwise(5)
    return t.part.select(k.alias("x"), (k % 97).alias("y"), F.col("p_type").alias("lc_name"), size.alias("Field_size"))


# band values of a scene's pixels; duplicates of a line key are kept
cte(
    "v_bands",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
         l_quantity * 100 AS B2,
         CAST(CAST(round(l_extendedprice * 3) AS BIGINT) % 10000 AS DOUBLE) AS B3,
         CAST(CAST(round(l_extendedprice) AS BIGINT) % 10000 AS DOUBLE) AS B4,
         CAST(CAST(round(l_extendedprice * 7) AS BIGINT) % 10000 AS DOUBLE) AS B8,
         l_linenumber AS SCL, l_quantity * 2 AS probability
       FROM lineitem""",
)


def bands(t: Tables) -> DataFrame:
    price = F.col("l_extendedprice")

    def coded(factor: int):
        return (F.round(price * factor).cast("bigint") % 10000).cast("double")

    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        (F.col("l_quantity") * 100).alias("B2"),
        coded(3).alias("B3"),
        coded(1).alias("B4"),
        coded(7).alias("B8"),
        F.col("l_linenumber").alias("SCL"),
        (F.col("l_quantity") * 2).alias("probability"),
    )


# scenes and their cloud twins
cte(
    "v_scenes",
    """SELECT o_orderkey AS scene_id, o_orderdate AS ts, o_totalprice % 100 AS cloud_pct,
         CAST(o_custkey % 360 AS DOUBLE) AS sun_azimuth,
         CAST(o_custkey % 1000 AS DOUBLE) AS min_x, CAST(o_custkey % 700 AS DOUBLE) AS min_y,
         CAST(o_custkey % 1000 + 50 AS DOUBLE) AS max_x, CAST(o_custkey % 700 + 50 AS DOUBLE) AS max_y
       FROM orders""",
)


def scenes(t: Tables) -> DataFrame:
    k = F.col("o_custkey")
    return t.orders.select(
        F.col("o_orderkey").alias("scene_id"),
        F.col("o_orderdate").alias("ts"),
        (F.col("o_totalprice") % 100).alias("cloud_pct"),
        (k % 360).cast("double").alias("sun_azimuth"),
        (k % 1000).cast("double").alias("min_x"),
        (k % 700).cast("double").alias("min_y"),
        (k % 1000 + 50).cast("double").alias("max_x"),
        (k % 700 + 50).cast("double").alias("max_y"),
    )


# layer file names, every seventh without its grid
cte(
    "v_files",
    """SELECT event_id, event_type AS kind,
         'S2_SR_' || event_type || '_M_' || strftime(ts, '%Y-%m') || '-' || event_type
         || CASE WHEN event_id % 7 = 0 THEN '' ELSE
              '_' || lpad(CAST(user_id AS VARCHAR), 10, '0') || '-' || lpad(CAST(event_id % 1000 AS VARCHAR), 10, '0')
              || CASE WHEN event_id % 5 = 0 THEN '-part' || CAST(event_id % 2 + 1 AS VARCHAR) ELSE '' END END
         || '.tif' AS path
       FROM events""",
)


def files(t: Tables) -> DataFrame:
    e = F.col("event_id")
    part = F.when(e % 5 == 0, F.concat(F.lit("-part"), (e % 2 + 1).cast("string"))).otherwise("")
    grid = F.concat(
        F.lit("_"), F.lpad(F.col("user_id").cast("string"), 10, "0"),
        F.lit("-"), F.lpad((e % 1000).cast("string"), 10, "0"), part,
    )
    name = F.concat(
        F.lit("S2_SR_"), "event_type", F.lit("_M_"), F.date_format("ts", "yyyy-MM"), F.lit("-"), "event_type",
        F.when(e % 7 == 0, "").otherwise(grid), F.lit(".tif"),
    )
    return t.events.select("event_id", F.col("event_type").alias("kind"), name.alias("path"))


# field observations with review marks
cte(
    "v_obs",
    """SELECT d.doc_id AS id, d.source AS username, d.lang AS primar, nullif(d.lang, 'es') AS team_letter,
         CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.quality = 0 THEN 'D' WHEN l.toxic = 1 THEN 'L' ELSE 'OK' END AS Quality,
         d.n_chars
       FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)


def observations(t: Tables) -> DataFrame:
    quality = (
        F.when(F.col("quality").isNull(), None)
        .when(F.col("quality") == 0, "D")
        .when(F.col("toxic") == 1, "L")
        .otherwise("OK")
    )
    return t.documents.join(t.labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("username"),
        F.col("lang").alias("primar"),
        F.nullif(F.col("lang"), F.lit("es")).alias("team_letter"),
        quality.alias("Quality"),
        "n_chars",
    )


# training rows: id, class, group and an array of features
N_FEATURES = 64
FEATURES = [f"f{i:02d}" for i in range(N_FEATURES)]
cte("v_feat", "SELECT vec_id AS id, embedding, 'class_' || label AS lc_name, vec_id % 50 AS field_id, CAST(5 + 5 * (vec_id % 3) AS DOUBLE) AS Field_size FROM embeddings")


def features(t: Tables, wide: bool = False, columns: list[str] | None = None) -> DataFrame:
    v = F.col("vec_id")
    base = [
        v.alias("id"),
        F.concat(F.lit("class_"), F.col("label")).alias("lc_name"),
        (v % 50).alias("field_id"),
        (5 + 5 * (v % 3)).cast("double").alias("Field_size"),
    ]
    if not wide:
        return t.embeddings.select(*base, "embedding")
    names = columns or FEATURES
    other = F.raise_error(F.concat(F.lit(f"{N_FEATURES} features expected, found "), F.size("embedding").cast("string")))
    checked = F.when(F.size("embedding") != N_FEATURES, other.cast("array<float>")).otherwise(F.col("embedding"))
    return t.embeddings.withColumn("embedding", checked).select(
        *base, *[F.get("embedding", F.lit(FEATURES.index(n))).cast("double").alias(n) for n in names]
    )


# predictions with their truth; class 5-LOW is never predicted in fold 2
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
cte(
    "v_pred",
    """SELECT o_orderkey, o_orderkey % 3 AS fold, o_orderpriority AS actual, o_totalprice AS score,
         CASE WHEN p = '5-LOW' AND o_orderkey % 3 = 2 THEN '1-URGENT' ELSE p END AS pred
       FROM (SELECT *, CASE WHEN o_orderkey % 4 = 0
                THEN ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][1 + o_custkey % 5]
                ELSE o_orderpriority END AS p FROM orders)""",
)


def predictions(t: Tables) -> DataFrame:
    listed = F.array(*[F.lit(p) for p in PRIORITIES])
    k = F.col("o_orderkey")
    p = F.when(k % 4 == 0, F.get(listed, (F.col("o_custkey") % 5).cast("int"))).otherwise(F.col("o_orderpriority"))
    pred = F.when((p == "5-LOW") & (k % 3 == 2), "1-URGENT").otherwise(p)
    return t.orders.select(
        "o_orderkey", (k % 3).alias("fold"), F.col("o_orderpriority").alias("actual"),
        F.col("o_totalprice").alias("score"), pred.alias("pred"),
    )


# search trials
cte("v_trials", "SELECT p_partkey AS number, p_retailprice AS value, p_type AS classifier, p_size FROM part")


def trials(t: Tables) -> DataFrame:
    prefix = F.lower("p_type")
    size = F.col("p_size")
    return t.part.select(
        F.col("p_partkey").alias("number"),
        F.col("p_retailprice").alias("value"),
        F.col("p_type").alias("classifier"),
        F.create_map(
            F.concat(prefix, F.lit("_max_depth")), size.cast("double").cast("string"),
            F.concat(prefix, F.lit("_c")), F.concat(size.cast("string"), F.lit("e-2")),
            F.lit("elsewhere_num_leaves"), F.lit("7"),
        ).alias("params"),
    )


# attribution tensor: runs x rows x classes x features
cte(
    "v_attrib",
    """SELECT vec_id % 6 AS run, vec_id // 6 AS "row", label AS class, i AS feature, embedding[i + 1] AS shap
       FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings)""",
)


def attribution(t: Tables) -> DataFrame:
    v = F.col("vec_id")
    return t.embeddings.select(
        (v % 6).alias("run"), F.floor(v / 6).cast("bigint").alias("row"), F.col("label").alias("class"),
        F.posexplode("embedding").alias("feature", "shap"),
    )


# rounds of held-out predictions
cte(
    "v_rounds",
    """SELECT user_id AS id, event_id % 50 AS round, event_type AS pred,
         ['click', 'error', 'purchase', 'signup', 'view'][1 + user_id % 5] AS actual, event_id
       FROM events""",
)


def rounds(t: Tables) -> DataFrame:
    listed = F.array(*[F.lit(b) for b in BANDS])
    return t.events.select(
        F.col("user_id").alias("id"), (F.col("event_id") % 50).alias("round"), F.col("event_type").alias("pred"),
        F.get(listed, (F.col("user_id") % 5).cast("int")).alias("actual"), "event_id",
    )


# per-band tables with a key that may be null
for _band in BANDS:
    cte(
        f"v_band_{_band}",
        f"""SELECT nullif(user_id % 7, 0) AS lot, user_id AS id, CAST(ts AS DATE) AS slot, sum(value) AS {_band}_value
            FROM events WHERE event_type = '{_band}' GROUP BY ALL""",
    )


def band_table(t: Tables, band: str) -> DataFrame:
    return (
        t.events.where(F.col("event_type") == band)
        .groupBy(
            F.nullif(F.col("user_id") % 7, F.lit(0)).alias("lot"), F.col("user_id").alias("id"),
            F.to_date("ts").alias("slot"),
        )
        .agg(F.sum("value").alias(f"{band}_value"))
    )


# monthly observations over several years
cte(
    "v_monthly",
    """SELECT o_custkey % 40 AS cell, o_orderpriority AS band, CAST(date_trunc('month', o_orderdate) AS DATE) AS slot,
         CAST(round(o_totalprice * 100) AS BIGINT) AS value
       FROM orders""",
)


def monthly(t: Tables) -> DataFrame:
    return t.orders.select(
        (F.col("o_custkey") % 40).alias("cell"), F.col("o_orderpriority").alias("band"),
        F.trunc("o_orderdate", "month").alias("slot"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("value"),
    )


# pixels of six scenes of 240 x 240, two a month, with square clouds
cte(
    "v_scene_px",
    """SELECT *, prob > 50 AS cloud, B8 < 1500 AND SCL <> 6 AS dark, CAST(scene * 60 + 15 AS DOUBLE) AS azimuth, make_date(2023, 1 + scene // 2, 1) AS slot
       FROM (SELECT scene, "row", col,
               max(CAST(round(l_quantity * 100) AS BIGINT)) AS B2, min(CAST(round(l_extendedprice * 3) AS BIGINT) % 10000) AS B3,
               min(CAST(round(l_extendedprice) AS BIGINT) % 10000) AS B4, min(CAST(round(l_extendedprice * 7) AS BIGINT) % 10000) AS B8,
               min(l_linenumber) AS SCL, min(l_quantity) + CASE WHEN ("row" // 48 + col // 48 + scene) % 4 = 0 THEN 50 ELSE 0 END AS prob
             FROM (SELECT *, CAST(l_orderkey % 6 AS INTEGER) AS scene, CAST(l_partkey * 7 % 240 AS INTEGER) AS "row",
                     CAST((l_orderkey // 6 * 11 + l_linenumber * 31) % 240 AS INTEGER) AS col FROM lineitem)
             GROUP BY scene, "row", col)""",
)


def scene_pixels(t: Tables) -> DataFrame:
    whole = {"B3": 3, "B4": 1, "B8": 7}
    keys = {
        "scene": F.col("l_orderkey") % 6, "row": F.col("l_partkey") * 7 % 240,
        "col": (F.floor(F.col("l_orderkey") / 6) * 11 + F.col("l_linenumber") * 31) % 240,
    }
    px = t.lineitem.groupBy(*[k.cast("int").alias(n) for n, k in keys.items()]).agg(
        F.max(F.round(F.col("l_quantity") * 100).cast("bigint")).alias("B2"),
        *[F.min(F.round(F.col("l_extendedprice") * f).cast("bigint") % 10000).alias(n) for n, f in whole.items()],
        F.min("l_linenumber").alias("SCL"), F.min("l_quantity").alias("least"),
    )
    blob = (F.floor(F.col("row") / 48) + F.floor(F.col("col") / 48) + F.col("scene")) % 4 == 0
    prob = F.col("least") + F.when(blob, 50).otherwise(0)
    return px.select(
        "*", (prob > 50).alias("cloud"), ((F.col("B8") < 1500) & (F.col("SCL") != 6)).alias("dark"),
        (F.col("scene") * 60 + 15).cast("double").alias("azimuth"), F.make_date(F.lit(2023), (F.floor(F.col("scene") / 2) + 1).cast("int"), F.lit(1)).alias("slot"),
    )
