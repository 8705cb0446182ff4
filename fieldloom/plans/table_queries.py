"""Joins, counts, merges, metrics and ranked selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import metrics as M
from fieldloom.operators import tables as T
from fieldloom.plans import views as V
from fieldloom.plans.registry import Tables, cte, query

# --- joins ------------------------------------------------------------------


@query(
    "join_first_match",
    """SELECT s.scene_id, round(s.cloud_pct, 6) AS cloud_pct, c.probability, c.l_partkey, c.l_linenumber
       FROM v_scenes s JOIN (
         SELECT *, row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, probability, B4, B3, B8) AS nth FROM v_bands) c
       ON c.l_orderkey = s.scene_id AND c.nth = 1""",
)
def join_first_match(t: Tables) -> DataFrame:
    clouds = V.bands(t).withColumnRenamed("l_orderkey", "scene_id")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "probability", "B4", "B3", "B8"]
    columns = ["probability", "l_partkey", "l_linenumber"]
    return T.join_first_match(V.scenes(t).select("scene_id", "cloud_pct"), clouds, "scene_id", order, columns)


def _merge_sql(columns: list[str], tables: list[str]) -> str:
    """Null-safe merge: the nullable key is joined under a stand-in value."""
    out = f"SELECT coalesce(lot, -1) AS klot, id, slot, {columns[0]} FROM {tables[0]}"
    for column, table in zip(columns[1:], tables[1:]):
        right = f"SELECT coalesce(lot, -1) AS klot, id, slot, {column} FROM {table}"
        out = f"SELECT * FROM ({out}) FULL JOIN ({right}) USING (klot, id, slot)"
    values = ", ".join(f"round({c}, 6) AS {c}" for c in columns)
    return f"SELECT nullif(klot, -1) AS lot, id, slot, {values} FROM ({out})"


@query("outer_merge_bands", _merge_sql([f"{b}_value" for b in V.BANDS], [f"v_band_{b}" for b in V.BANDS]))
def outer_merge_bands(t: Tables) -> DataFrame:
    return T.merge_bands([V.band_table(t, b) for b in V.BANDS], ["lot", "id", "slot"])


for _band in V.BANDS:
    cte(f"v_rep_{_band}", f"SELECT nullif(user_id % 7, 0) AS lot, user_id AS id, CAST(ts AS DATE) AS slot, value AS {_band}_value FROM events WHERE event_type = '{_band}'")


@query("outer_merge_repeated", _merge_sql([f"{b}_value" for b in V.BANDS], [f"v_rep_{b}" for b in V.BANDS]))
def outer_merge_repeated(t: Tables) -> DataFrame:
    def rows(band: str) -> DataFrame:
        return t.events.where(F.col("event_type") == band).select(
            F.nullif(F.col("user_id") % 7, F.lit(0)).alias("lot"),
            F.col("user_id").alias("id"),
            F.to_date("ts").alias("slot"),
            F.col("value").alias(f"{band}_value"),
        )

    return T.merge_bands([rows(b) for b in V.BANDS], ["lot", "id", "slot"], unique=False)


@query(
    "left_join_xy",
    f"""WITH s AS ({_merge_sql([f"{b}_value" for b in V.BANDS], [f"v_band_{b}" for b in V.BANDS])})
        SELECT p.id, p.x, p.y, s.slot, {", ".join(f"s.{b}_value" for b in V.BANDS)} FROM v_points p LEFT JOIN s ON s.id = p.id""",
)
def left_join_xy(t: Tables) -> DataFrame:
    data = T.merge_bands([V.band_table(t, b) for b in V.BANDS], ["lot", "id", "slot"]).drop("lot")
    return V.points(t).select("id", "x", "y").join(data, "id", "left")


@query(
    "dedupe_first",
    """SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) AS nth FROM events)
       WHERE nth = 1""",
)
def dedupe_first(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", "event_type", "value")
    return T.dedupe_first(rows, "user_id", ["event_type", "event_id"])


@query(
    "semi_anti",
    """SELECT id, lc_name, EXISTS (SELECT 1 FROM events e WHERE e.user_id = p.id) AS observed
       FROM v_points p WHERE lc_name NOT IN ('BUILDING')""",
)
def semi_anti(t: Tables) -> DataFrame:
    kept = V.points(t).where(~F.col("lc_name").isin("BUILDING")).select("id", "lc_name")
    seen = t.events.select(F.col("user_id").alias("id")).distinct()
    with_rows = kept.join(seen, "id", "left_semi").withColumn("observed", F.lit(True))
    without = kept.join(seen, "id", "left_anti").withColumn("observed", F.lit(False))
    return with_rows.unionByName(without)


@query(
    "anti_join_outliers",
    """SELECT id, lc_name, x, y FROM v_points WHERE id NOT IN (
         SELECT user_id FROM events GROUP BY user_id HAVING max(value) > 200)""",
)
def anti_join_outliers(t: Tables) -> DataFrame:
    flagged = (
        t.events.groupBy(F.col("user_id").alias("id")).agg(F.max("value").alias("top")).where(F.col("top") > 200)
    )
    return V.points(t).select("id", "lc_name", "x", "y").join(flagged.select("id"), "id", "left_anti")


@query(
    "quality_rate",
    """WITH c AS (SELECT primar, Quality, count(Quality) AS n FROM v_obs WHERE Quality IS NOT NULL GROUP BY ALL),
         d AS (SELECT primar, count(team_letter) AS d FROM v_obs GROUP BY primar)
       SELECT c.primar, c.Quality, round(n / nullif(d, 0), 6) AS rate FROM c JOIN d ON d.primar = c.primar""",
)
def quality_rate(t: Tables) -> DataFrame:
    return T.rate_within(V.observations(t), "primar", "Quality", "team_letter")


@query(
    "quality_rate_user",
    """WITH c AS (SELECT username, Quality, count(Quality) AS n FROM v_obs WHERE Quality IS NOT NULL GROUP BY ALL),
         d AS (SELECT username, count(team_letter) AS d FROM v_obs GROUP BY username)
       SELECT c.username, c.Quality, round(n / nullif(d, 0), 6) AS rate FROM c JOIN d ON d.username = c.username""",
)
def quality_rate_user(t: Tables) -> DataFrame:
    return T.rate_within(V.observations(t), "username", "Quality", "team_letter")


# --- counts and shares ----------------------------------------------------------


@query(
    "count_by_keys",
    """SELECT username, Quality, count(primar) AS n FROM v_obs
       WHERE username IS NOT NULL AND Quality IS NOT NULL GROUP BY ALL""",
)
def count_by_keys(t: Tables) -> DataFrame:
    return T.count_by(V.observations(t), ["username", "Quality"], "primar")


@query(
    "class_share",
    """SELECT primar, count(*) AS count, round(count(*) / (SELECT count(primar) FROM v_obs) * 100, 6) AS percentage
       FROM v_obs WHERE primar IS NOT NULL GROUP BY primar""",
)
def class_share(t: Tables) -> DataFrame:
    return T.class_share(V.observations(t), "primar")


@query("distinct_classes", "SELECT DISTINCT primar FROM v_obs")
def distinct_classes(t: Tables) -> DataFrame:
    return V.observations(t).select("primar").distinct()


@query(
    "count_distinct",
    "SELECT count(DISTINCT primar) AS classes, count(DISTINCT username) AS users, count(DISTINCT Quality) AS marks FROM v_obs",
)
def count_distinct(t: Tables) -> DataFrame:
    return V.observations(t).agg(
        F.count_distinct("primar").alias("classes"),
        F.count_distinct("username").alias("users"),
        F.count_distinct("Quality").alias("marks"),
    )


@query(
    "share_pred_vs_actual",
    """SELECT pred AS lc, round(count(*) / (SELECT count(*) FROM v_pred), 6) AS percent, 'prediction' AS model
       FROM v_pred GROUP BY pred
       UNION ALL SELECT actual, round(count(*) / (SELECT count(*) FROM v_pred), 6), 'training data'
       FROM v_pred GROUP BY actual""",
)
def share_pred_vs_actual(t: Tables) -> DataFrame:
    rows = V.predictions(t)
    return T.share_pred_vs_actual(
        rows.select(F.col("pred").alias("lc")), rows.select(F.col("actual").alias("lc")), "lc"
    )


# --- scores ---------------------------------------------------------------------

cte("v_labels", "SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS label")
cte(
    "v_cm",
    """SELECT a.label AS actual, p.label AS pred, count(v.o_orderkey) AS n
       FROM v_labels a CROSS JOIN v_labels p LEFT JOIN v_pred v ON v.actual = a.label AND v.pred = p.label
       GROUP BY ALL""",
)


def _matrix(t: Tables) -> DataFrame:
    return M.confusion_matrix(V.predictions(t), "actual", "pred", V.PRIORITIES)


@query("confusion_matrix", "SELECT * FROM v_cm")
def confusion_matrix(t: Tables) -> DataFrame:
    return _matrix(t)


@query(
    "confusion_pct",
    "SELECT actual, pred, round(n / nullif(sum(n) OVER (PARTITION BY actual), 0), 6) AS pct FROM v_cm",
)
def confusion_pct(t: Tables) -> DataFrame:
    return M.confusion_pct(_matrix(t))


@query(
    "per_class_accuracy",
    """SELECT label, round(avg(CASE WHEN (actual = label) = (pred = label) THEN 1.0 ELSE 0.0 END), 6) AS accuracy
       FROM v_pred CROSS JOIN v_labels GROUP BY label""",
)
def per_class_accuracy(t: Tables) -> DataFrame:
    return M.per_class_accuracy(_matrix(t))


cte(
    "v_side",
    """SELECT f.fold, f.label,
         count(*) FILTER (WHERE v.actual = f.label) AS r, count(*) FILTER (WHERE v.pred = f.label) AS c,
         count(*) FILTER (WHERE v.actual = f.label AND v.pred = f.label) AS h, count(*) AS n
       FROM (SELECT DISTINCT fold, actual AS label FROM v_pred UNION SELECT DISTINCT fold, pred FROM v_pred) f
       JOIN v_pred v ON v.fold = f.fold GROUP BY f.fold, f.label""",
)
cte(
    "v_scores",
    """SELECT fold, sum(h) / max(n) AS accuracy, avg(h / nullif(r, 0)) AS balanced_accuracy,
         (sum(h) / max(n) - sum(r * c) / max(n * n)) / nullif(1 - sum(r * c) / max(n * n), 0) AS kappa,
         sum(h) / max(n) AS f1_micro, avg(coalesce(h / nullif(r, 0), 0)) AS recall_macro,
         avg(coalesce(h / nullif(c, 0), 0)) AS precision_macro,
         coalesce((sum(h) * max(n) - sum(r * c))
           / nullif(sqrt((max(n * n) - sum(c * c)) * (max(n * n) - sum(r * r))), 0), 0) AS mcc,
         avg((h / nullif(r, 0) + 1 - (c - h) / nullif(n - r, 0)) / 2) AS roc_auc
       FROM v_side GROUP BY fold""",
)
_SCORE_SQL = ", ".join(f"round({s}, 6) AS {s}" for s in M.SCORES)


@query("fold_scores", f"SELECT fold, {_SCORE_SQL} FROM v_scores")
def fold_scores(t: Tables) -> DataFrame:
    return M.fold_scores(V.predictions(t), "actual", "pred")


@query("mean_scores", "SELECT " + ", ".join(f"round(avg({s}), 6) AS {s}" for s in M.SCORES) + " FROM v_scores")
def mean_scores(t: Tables) -> DataFrame:
    return M.mean_scores(M.fold_scores(V.predictions(t), "actual", "pred"))


@query("mcc", "SELECT fold, round(mcc, 6) AS mcc FROM v_scores")
def mcc(t: Tables) -> DataFrame:
    return M.fold_scores(V.predictions(t), "actual", "pred").select("fold", "mcc")


@query(
    "auc_rank",
    """WITH r AS (SELECT actual IN ('1-URGENT', '2-HIGH') AS p, floor(score / 100) AS s FROM v_pred),
         k AS (SELECT p, s, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rk FROM r),
         n AS (SELECT count(*) FILTER (WHERE p) AS a, count(*) FILTER (WHERE NOT p) AS b FROM r)
       SELECT round((sum(rk) FILTER (WHERE p) - max(a) * (max(a) + 1) / 2) / (max(a) * max(b)), 6) AS auc,
         CAST(max(a) AS BIGINT) AS n_pos, CAST(max(b) AS BIGINT) AS n_neg FROM k, n""",
)
def auc_rank(t: Tables) -> DataFrame:
    rows = V.predictions(t).select(F.floor(F.col("score") / 100).alias("s"), "actual")
    return M.auc_rank(rows, F.col("actual").isin("1-URGENT", "2-HIGH"), "s")


@query(
    "histogram_bins",
    """WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
       SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, count(*) AS n
       FROM lineitem, e GROUP BY 1""",
)
def histogram_bins(t: Tables) -> DataFrame:
    return M.histogram(t.lineitem, "l_extendedprice", 30)


@query(
    "histogram_by_class",
    """WITH e AS (SELECT o_orderpriority AS p, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1)
       SELECT o_orderpriority, CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 5)), 4) AS INTEGER) AS bin, count(*) AS n
       FROM orders JOIN e ON e.p = o_orderpriority GROUP BY 1, 2""",
)
def histogram_by_class(t: Tables) -> DataFrame:
    return M.histogram(t.orders, "o_totalprice", 5, by=["o_orderpriority"])


@query(
    "label_uncertainty",
    """WITH v AS (SELECT id, pred, count(*) AS n, count(*) FILTER (WHERE pred = actual) AS m FROM v_rounds GROUP BY ALL),
         b AS (SELECT id, pred, row_number() OVER (PARTITION BY id ORDER BY n DESC, pred) AS nth FROM v)
       SELECT b.id, b.pred AS modal_pred, round(s.m / s.n * 100, 6) AS matching_percentage
       FROM b JOIN (SELECT id, sum(m) AS m, sum(n) AS n FROM v GROUP BY id) s ON s.id = b.id WHERE nth = 1""",
)
def label_uncertainty(t: Tables) -> DataFrame:
    return M.label_uncertainty(V.rounds(t))


@query(
    "cluster_coassign",
    """WITH c AS (SELECT event_id % 3 AS seed, pred, round % 10 AS cluster, count(*) AS n FROM v_rounds GROUP BY ALL),
         m AS (SELECT *, row_number() OVER (PARTITION BY seed, pred ORDER BY n DESC, cluster) AS nth FROM c)
       SELECT a.pred AS key_class, b.pred AS with_class, count(*) AS n
       FROM m a JOIN m b ON a.seed = b.seed AND a.cluster = b.cluster WHERE a.nth = 1 AND b.nth = 1 GROUP BY ALL""",
)
def cluster_coassign(t: Tables) -> DataFrame:
    rows = V.rounds(t).select(
        (F.col("event_id") % 3).alias("seed"), "pred", (F.col("round") % 10).alias("cluster")
    )
    return M.cluster_coassign(rows, "pred", "cluster", "seed")


cte(
    "v_reduced",
    """SELECT feature, sum(mean_v) AS mean_imp, sum(max_v) AS max_imp FROM (
         SELECT "row", feature, avg(mean_v) AS mean_v, avg(max_v) AS max_v FROM (
           SELECT "row", feature, class, avg(abs(CAST(shap AS DOUBLE))) AS mean_v, max(abs(CAST(shap AS DOUBLE))) AS max_v
           FROM v_attrib GROUP BY ALL) GROUP BY ALL) GROUP BY ALL""",
)


def _reduced(t: Tables) -> DataFrame:
    return M.attribution_reduce(V.attribution(t).withColumn("shap", F.col("shap").cast("double")))


@query(
    "attribution_reduce",
    """SELECT CAST(feature AS INTEGER) AS feature, round(mean_imp, 6) AS mean_importance,
         round(max_imp, 6) AS max_importance FROM v_reduced""",
)
def attribution_reduce(t: Tables) -> DataFrame:
    return _reduced(t)


def _named(t: Tables, how: str) -> DataFrame:
    name = F.concat(F.lit("feature_"), F.lpad(F.col("feature").cast("string"), 2, "0"))
    return _reduced(t).select(name.alias("name"), F.col(f"{how}_importance").alias("importance"))


_TOP = """SELECT 'feature_' || lpad(CAST(feature AS VARCHAR), 2, '0') AS name, {0} AS importance
          FROM v_reduced ORDER BY {0} DESC, name LIMIT 30"""


@query(
    "top_features",
    f"SELECT name, round(importance, 6) AS importance FROM ({_TOP.format('mean_imp')}) WHERE NOT contains(name, '_1')",
)
def top_features(t: Tables) -> DataFrame:
    return T.top_features(_named(t, "mean"), "name", "importance", 30, without=["_1"])


@query(
    "feature_union",
    f"SELECT name FROM ({_TOP.format('mean_imp')}) UNION SELECT name FROM ({_TOP.format('max_imp')})",
)
def feature_union(t: Tables) -> DataFrame:
    mean = T.top_features(_named(t, "mean"), "name", "importance", 30).select("name")
    return T.union_names(mean, T.top_features(_named(t, "max"), "name", "importance", 30).select("name"))


@query(
    "substring_join",
    """WITH k AS (SELECT DISTINCT event_type || '_M_' AS name FROM events UNION ALL SELECT 'absent_band')
       SELECT k.name, f.path FROM k LEFT JOIN v_files f ON contains(f.path, k.name)""",
)
def substring_join(t: Tables) -> DataFrame:
    kinds = t.events.select(F.concat("event_type", F.lit("_M_")).alias("name")).distinct()
    absent = t.spark.createDataFrame([("absent_band",)], "name string")
    return T.substring_join(V.files(t).select("path"), "path", kinds.union(absent), "name")


@query(
    "substring_join_ranked",
    """WITH k AS (SELECT event_type || '_M_2024-01-' || event_type AS name, count(*) AS n FROM events GROUP BY ALL),
         f AS (SELECT name FROM k ORDER BY n DESC, name LIMIT 3)
       SELECT f.name, p.path FROM f LEFT JOIN v_files p ON contains(p.path, f.name)""",
)
def substring_join_ranked(t: Tables) -> DataFrame:
    name = F.concat("event_type", F.lit("_M_2024-01-"), "event_type").alias("name")
    kinds = t.events.groupBy(name).agg((-F.count(F.lit(1))).alias("place"))
    return T.substring_join(V.files(t).select("path"), "path", kinds, "name", "place", 3)


@query("first_match", "SELECT min(path) AS path FROM v_files WHERE contains(path, 'view')")
def first_match(t: Tables) -> DataFrame:
    return T.first_containing(V.files(t), "path", "view")


@query(
    "best_trial",
    """SELECT number, round(value, 6) AS value, classifier FROM (
         SELECT *, row_number() OVER (PARTITION BY classifier ORDER BY value DESC, number) AS nth FROM v_trials)
       WHERE nth = 1
       UNION ALL SELECT * FROM (SELECT number, round(value, 6), 'any' FROM v_trials ORDER BY value DESC, number LIMIT 1)""",
)
def best_trial(t: Tables) -> DataFrame:
    rows = V.trials(t).select("number", "value", "classifier")
    each = T.best_trial(rows, "value", "number", "classifier")
    overall = T.best_trial(rows, "value", "number").withColumn("classifier", F.lit("any"))
    return each.unionByName(overall)


@query(
    "trial_params",
    """SELECT number, 'C' AS param, CAST(p_size AS VARCHAR) || 'e-2' AS setting FROM v_trials
       UNION ALL SELECT number, 'max_depth', CAST(p_size AS VARCHAR) FROM v_trials""",
)
def trial_params(t: Tables) -> DataFrame:
    own = T.trial_params(V.trials(t))
    return own.select("number", F.explode("params").alias("param", "setting"))


@query(
    "row_index",
    "SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row_index FROM documents",
)
def row_index(t: Tables) -> DataFrame:
    return T.row_index(t.documents.select("doc_id"), "doc_id")


@query(
    "split_halves",
    """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= (SELECT count(*) FROM documents) // 2
         THEN 1 ELSE 2 END AS part FROM documents""",
)
def split_halves(t: Tables) -> DataFrame:
    return T.split_halves(t.documents.select("doc_id"), "doc_id")
