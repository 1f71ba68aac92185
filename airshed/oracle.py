"""DuckDB SQL for the correctness oracle.

Each registered query has an independent SQL formulation here, written against
the driver's pre-registered views (``lineitem``).  Doubles are compared as
``round(x, 6) + 0.0`` (``+ 0.0`` turns DuckDB's ``-0.0`` into ``0.0``).
"""

from __future__ import annotations

from airshed.sources.cities import dim_city_sql_values


def r6(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


_TIME = ("timestamp '2024-01-01 00:00:00' "
         "+ to_days(cast((l_orderkey % 12) * 30 + l_suppkey % 5 + 360 * (l_orderkey // 15000) as int)) "
         "+ to_hours(cast(l_quantity as int) % 24)")

_BASE = f"""
dim_city AS (SELECT ix, city, cast(lat AS double) AS lat, cast(lon AS double) AS lon, region
             FROM {dim_city_sql_values()}),
li AS (SELECT *, l_partkey % 48 AS ix FROM lineitem),
hourly_aqi AS (
  SELECT {_TIME} AS time, d.city,
         CASE WHEN l_returnflag <> 'R' THEN cast(l_quantity * 4.0 AS double) END AS pm10,
         CASE WHEN l_returnflag <> 'R' AND l_linenumber <> 7
              THEN cast(l_quantity * 2.0 + l_discount * 100 AS double) END AS pm2_5
  FROM li JOIN dim_city d ON li.ix = d.ix),
hourly_weather AS (
  SELECT {_TIME} AS time, d.city,
         CASE WHEN l_returnflag <> 'A' THEN cast(8 + d.ix * 0.7e0 + l_discount * 20 AS double) END AS temperature_2m,
         CASE WHEN l_returnflag <> 'A' THEN cast(20 + (l_orderkey % 12) * 7 + l_tax * 100 AS double) END
           AS relative_humidity_2m,
         CASE WHEN l_returnflag <> 'A' THEN cast((l_partkey % 6) * 3.2e0 + l_quantity / 50 AS double) END AS wind_speed_10m,
         CASE WHEN l_returnflag <> 'A' THEN cast(cast(l_quantity * 7 AS int) % 360 AS double) END AS wind_direction_10m,
         CASE WHEN l_returnflag <> 'A' AND l_linenumber > 5 THEN cast(l_tax * 25 AS double) END AS precipitation,
         CASE WHEN l_returnflag <> 'A' AND l_linenumber <> 6 THEN cast(940 + l_quantity AS double) END AS surface_pressure
  FROM li JOIN dim_city d ON li.ix = d.ix),
raw_aqi AS (
  SELECT * FROM (
    SELECT bin AS time, city, avg(pm10) AS pm10, avg(pm2_5) AS pm2_5
    FROM (SELECT time_bucket(INTERVAL 6 HOUR, time) AS bin, * FROM hourly_aqi) b
    GROUP BY bin, city) a
  WHERE time IS NOT NULL AND city IS NOT NULL AND pm10 IS NOT NULL AND pm2_5 IS NOT NULL),
raw_weather AS (
  SELECT * FROM (
    SELECT bin AS time, city,
           avg(temperature_2m) AS temperature_2m,
           avg(relative_humidity_2m) AS relative_humidity_2m,
           avg(wind_speed_10m) AS wind_speed_10m,
           avg(wind_direction_10m) AS wind_direction_10m,
           coalesce(sum(precipitation), 0.0) AS precipitation,
           avg(surface_pressure) AS surface_pressure
    FROM (SELECT time_bucket(INTERVAL 6 HOUR, time) AS bin, * FROM hourly_weather) b
    GROUP BY bin, city) w
  WHERE time IS NOT NULL AND city IS NOT NULL AND temperature_2m IS NOT NULL
    AND relative_humidity_2m IS NOT NULL AND wind_speed_10m IS NOT NULL
    AND wind_direction_10m IS NOT NULL AND precipitation IS NOT NULL
    AND surface_pressure IS NOT NULL),
merged AS (
  SELECT a.time, a.city, a.pm10, a.pm2_5, w.temperature_2m, w.relative_humidity_2m,
         w.wind_speed_10m, w.wind_direction_10m, w.precipitation, w.surface_pressure
  FROM raw_aqi a JOIN raw_weather w ON a.city = w.city AND a.time = w.time),
cal AS (
  SELECT m.*, cast(month(time) AS integer) AS month, cast(hour(time) AS integer) AS hour,
         dayname(time) AS day_of_week,
         CASE WHEN hour(time) >= 0 AND hour(time) < 6 THEN 'Midnight'
              WHEN hour(time) >= 6 AND hour(time) < 12 THEN 'Morning'
              WHEN hour(time) >= 12 AND hour(time) < 18 THEN 'Afternoon'
              ELSE 'Evening' END AS time_of_day,
         CASE WHEN isodow(time) IN (6, 7) THEN 1 ELSE 0 END AS is_weekend,
         CASE WHEN precipitation > 2.0 THEN 'Rainy / Washed'
              WHEN wind_speed_10m > 15.0 THEN 'Windy & Clear'
              WHEN temperature_2m < 18.0 AND wind_speed_10m < 5.0 THEN 'Cold & Stagnant'
              WHEN temperature_2m > 35.0 AND relative_humidity_2m < 40.0 THEN 'Hot & Dry'
              WHEN temperature_2m > 28.0 AND relative_humidity_2m > 70.0 THEN 'Hot & Humid'
              ELSE 'Pleasant / Normal' END AS weather_verdict
  FROM merged m),
engineered AS (
  SELECT c.*, d.region,
         CASE
           WHEN d.region = 'South' THEN CASE
             WHEN month IN (1, 2) THEN 'Winter' WHEN month IN (3, 4, 5) THEN 'Summer'
             WHEN month IN (6, 7, 8, 9) THEN 'Southwest Monsoon' ELSE 'Retreating Monsoon' END
           WHEN d.region = 'Northeast' THEN CASE
             WHEN month IN (12, 1, 2) THEN 'Winter' WHEN month IN (3, 4) THEN 'Pre-Monsoon'
             WHEN month IN (5, 6, 7, 8, 9, 10) THEN 'Extended Monsoon' ELSE 'Post-Monsoon' END
           WHEN d.region IN ('North', 'Central', 'East', 'West', 'NCR') THEN CASE
             WHEN month IN (12, 1, 2) THEN 'Winter' WHEN month IN (3, 4, 5, 6) THEN 'Summer'
             WHEN month IN (7, 8, 9) THEN 'Southwest Monsoon' ELSE 'Post-Monsoon' END
           WHEN d.region = 'UT' THEN CASE
             WHEN month IN (12, 1, 2) THEN 'Winter' WHEN month IN (3, 4) THEN 'Spring'
             WHEN month IN (5, 6, 7, 8) THEN 'Summer' ELSE 'Autumn' END
           ELSE 'Unknown' END AS regional_season
  FROM cal c LEFT JOIN dim_city d ON c.city = d.city),
fm AS (
  SELECT time, city, temperature_2m, relative_humidity_2m, wind_speed_10m, precipitation,
         surface_pressure, time_of_day, is_weekend, weather_verdict,
         coalesce(regional_season, 'nan') || '_' || coalesce(region, 'nan') AS season_region,
         coalesce(regional_season, 'nan') || '_' || coalesce(city, 'nan') AS season_city,
         temperature_2m * relative_humidity_2m AS temp_humidity,
         wind_speed_10m * precipitation AS wind_precip,
         surface_pressure * temperature_2m AS pressure_temp,
         sin(radians(wind_direction_10m)) AS wind_dir_sin,
         cos(radians(wind_direction_10m)) AS wind_dir_cos,
         sin(2 * pi() * (isodow(time) - 1) / 7) AS dow_sin,
         cos(2 * pi() * (isodow(time) - 1) / 7) AS dow_cos,
         sin(2 * pi() * month / 12) AS month_sin,
         cos(2 * pi() * month / 12) AS month_cos,
         sin(2 * pi() * hour / 24) AS hour_sin,
         cos(2 * pi() * hour / 24) AS hour_cos,
         pm2_5, pm10
  FROM engineered)
"""


def with_base(select: str) -> str:
    return f"WITH {_BASE.strip()}\n{select}"


ENGINEERED_COLS = [
    "time", "city", "pm10", "pm2_5", "temperature_2m", "relative_humidity_2m",
    "wind_speed_10m", "wind_direction_10m", "precipitation", "surface_pressure",
    "month", "hour", "day_of_week", "time_of_day", "is_weekend", "weather_verdict",
    "region", "regional_season",
]
DOUBLE_COLS = {
    "pm10", "pm2_5", "temperature_2m", "relative_humidity_2m", "wind_speed_10m",
    "wind_direction_10m", "precipitation", "surface_pressure",
    "temp_humidity", "wind_precip", "pressure_temp", "wind_dir_sin", "wind_dir_cos",
    "dow_sin", "dow_cos", "month_sin", "month_cos", "hour_sin", "hour_cos", "label",
}


def select_rounded(cols: list[str], source: str, rename: dict[str, str] | None = None) -> str:
    rename = rename or {}
    parts = []
    for c in cols:
        src = rename.get(c, c)
        parts.append(f"{r6(src)} AS {c}" if c in DOUBLE_COLS else f"{src} AS {c}")
    return f"SELECT {', '.join(parts)} FROM {source}"


# Split, folds and the group-mean cross-validation (estimator: mean label per
# city over the other folds).
_CV = """,
keys AS (
  SELECT time, city, pm2_5 AS label,
         md5(city || '|' || cast(time AS varchar) || '|42') AS h,
         md5(city || '|' || cast(time AS varchar) || '|42|cv') AS hcv
  FROM fm),
ranked AS (SELECT *, row_number() OVER (ORDER BY h, city, time) - 1 AS rn, count(*) OVER () AS n FROM keys),
split AS (SELECT time, city, label, hcv, rn < ceil(0.2e0 * n) AS is_test FROM ranked),
folds AS (SELECT time, city, label, ntile(5) OVER (ORDER BY hcv, city, time) AS fold
          FROM split WHERE NOT is_test),
city_fold AS (SELECT city, fold, sum(label) AS s, count(*) AS c FROM folds GROUP BY city, fold),
city_all AS (SELECT city, sum(s) AS s, sum(c) AS c FROM city_fold GROUP BY city),
fold_ids AS (SELECT DISTINCT fold FROM folds),
gm AS (SELECT f.fold AS m, a.city,
              (a.s - coalesce(cf.s, 0)) / nullif(a.c - coalesce(cf.c, 0), 0) AS pred
       FROM fold_ids f CROSS JOIN city_all a
       LEFT JOIN city_fold cf ON cf.city = a.city AND cf.fold = f.fold),
scored AS (SELECT g.m AS fold, CASE WHEN r.fold = g.m THEN 'cv' ELSE 'train' END AS part,
                  r.label, g.pred
           FROM folds r JOIN gm g ON r.city = g.city),
r2 AS (SELECT fold, part,
         CASE WHEN var_pop(label) * count(label) = 0
              THEN CASE WHEN sum((label - pred) * (label - pred)) = 0 THEN 1.0e0 ELSE 0.0e0 END
              ELSE 1.0e0 - sum((label - pred) * (label - pred)) / (var_pop(label) * count(label)) END AS r2
       FROM scored GROUP BY fold, part),
fold_tbl AS (
  SELECT cast(fold AS integer) AS Fold,
         max(CASE WHEN part = 'train' THEN r2 END) AS Train_R2,
         max(CASE WHEN part = 'cv' THEN r2 END) AS CV_R2,
         max(CASE WHEN part = 'train' THEN r2 END) - max(CASE WHEN part = 'cv' THEN r2 END) AS Gap
  FROM r2 GROUP BY fold),
test_scored AS (
  SELECT s.label, a.s / nullif(a.c, 0) AS pred
  FROM split s LEFT JOIN city_all a ON s.city = a.city WHERE s.is_test),
test_r2 AS (
  SELECT CASE WHEN var_pop(label) * count(label) = 0
              THEN CASE WHEN sum((label - pred) * (label - pred)) = 0 THEN 1.0e0 ELSE 0.0e0 END
              ELSE 1.0e0 - sum((label - pred) * (label - pred)) / (var_pop(label) * count(label)) END AS value
  FROM test_scored),
summary AS (
  SELECT avg(Train_R2) AS mean_train_r2, avg(CV_R2) AS mean_cv_r2,
         avg(Train_R2) - avg(CV_R2) AS generalization_gap,
         stddev_pop(Train_R2) AS std_train_r2, stddev_pop(CV_R2) AS std_cv_r2,
         max(CV_R2) AS best_fold_r2, min(CV_R2) AS worst_fold_r2,
         max(Train_R2) AS best_train_r2, min(Train_R2) AS worst_train_r2
  FROM fold_tbl)
"""


def with_cv(select: str) -> str:
    return f"WITH {_BASE.strip()}{_CV.rstrip()}\n{select}"


def _objective(boost):
    """SQL of a sum's L1 shrinkage and of a node's score."""
    lam, alpha = f"{boost.reg_lambda!r}e0", f"{boost.reg_alpha!r}e0"

    def shrunk(g: str) -> str:
        return f"(CASE WHEN {g} > {alpha} THEN {g} - {alpha} WHEN {g} < -{alpha} THEN {g} + {alpha} ELSE 0e0 END)"

    def score(g: str, h: str) -> str:
        return f"({shrunk(g)} * {shrunk(g)} / ({h} + {lam}))"

    return shrunk, score


def _boost_rows(features: list[str], categorical: list[str], models: list[int], target: str, max_bins: int):
    """(feature names, steps up to the rows' bins and the models' first predictions)."""
    names = [*categorical, *[f for f in features if f not in categorical]]
    numbers = [c for c in names if c not in categorical]
    cols = ", ".join(f"round(cast(f.{c} AS double), 6) AS {c}" if c in numbers else f"f.{c} AS {c}"
                     for c in names if c != "city")
    longs = [f"SELECT rid, is_test, {i} AS f, {c} AS v FROM x" for i, c in enumerate(names) if c in numbers]
    texts = [f"SELECT rid, is_test, {i} AS f, cast({c} AS varchar) AS v FROM x" for i, c in enumerate(names) if c in categorical]
    texts = texts or ["SELECT rid, is_test, 0 AS f, cast(NULL AS varchar) AS v FROM x WHERE false"]
    ctes = [f"""x AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY s.city, s.time) AS rid, s.time, s.city, s.is_test, fo.fold, f.{target} AS label,
         cast(round(f.{target} * 65536) AS bigint) AS yq, {cols}
  FROM split s JOIN fm f ON s.time = f.time AND s.city = f.city
  LEFT JOIN folds fo ON fo.time = s.time AND fo.city = s.city)""",
            f"nx AS MATERIALIZED ({' UNION ALL '.join(longs)})",
            f"cx AS MATERIALIZED ({' UNION ALL '.join(texts)})",
            "ranked_x AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) AS r, count(*) OVER (PARTITION BY f) AS n "
            "FROM nx WHERE NOT is_test AND v IS NOT NULL)",
            f"""cuts AS MATERIALIZED (SELECT DISTINCT f, v AS cut FROM ranked_x JOIN range(1, {max_bins}) q(i)
  ON r = greatest(1, cast(ceil(i * n / {max_bins}e0) AS bigint)))""",
            "cut_lists AS (SELECT f, list(cut) AS cl FROM cuts GROUP BY f)",
            "cats AS MATERIALIZED (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) AS b "
            "FROM (SELECT DISTINCT f, v FROM cx WHERE NOT is_test AND v IS NOT NULL))",
            """bl AS MATERIALIZED (
  SELECT rid, nx.f, CASE WHEN v IS NULL THEN 0 ELSE 1 + len(list_filter(coalesce(cl, []), lambda c: c <= v)) END AS b
  FROM nx LEFT JOIN cut_lists ON cut_lists.f = nx.f
  UNION ALL SELECT rid, cx.f, coalesce(cats.b, 0) FROM cx LEFT JOIN cats ON cats.f = cx.f AND cats.v = cx.v)""",
            f"""st0 AS MATERIALIZED (
  SELECT m, rid, yq, NOT is_test AND (m = 0 OR fold <> m) AS train,
         (SELECT cast(sum(b.yq) AS double) / count(*) / 65536 FROM x b WHERE NOT b.is_test AND (q.m = 0 OR b.fold <> q.m)) AS p
  FROM x, (VALUES {', '.join(f'({m})' for m in models)}) q(m))"""]
    return names, ctes


# Second-order boosting, level by level, as one chain of steps: an independent
# statement of the learner (histograms by join and window, no arrays).
def with_boost(select: str, features: list[str], categorical: list[str], boost, trees: int, models: list[int],
               target: str = "pm2_5", max_bins: int = 256) -> str:
    """``select`` may read pred(m, rid, p), nodes(m, tree, node, ...), x (the rows) and cuts(f, name, cut)."""
    shrunk, score = _objective(boost)
    lam, lr, least = f"{boost.reg_lambda!r}e0", f"{boost.learning_rate!r}e0", max(boost.min_child_weight, 1)
    is_cat = f"f < {len(categorical)}" if categorical else "false"
    names, ctes = _boost_rows(features, categorical, models, target, max_bins)
    made = []
    for t in range(trees):
        ctes.append(f"n{t}_0 AS (SELECT m, rid, 1 AS node, false AS done FROM st{t})")
        for level in range(boost.max_depth + 1):
            at, last = f"{t}_{level}", level == boost.max_depth
            ctes.append(f"""e{at} AS MATERIALIZED (
  SELECT n.m, n.rid, node, cast(round(p * 65536) AS bigint) - yq AS g
  FROM n{at} n JOIN st{t} r ON r.m = n.m AND r.rid = n.rid WHERE train AND NOT done)""")
            ctes.append(f"t{at} AS MATERIALIZED (SELECT m, node, cast(sum(g) AS bigint) AS g, count(*) AS h FROM e{at} GROUP BY m, node)")
            value = f"{lr} * (-{shrunk('(t.g / 65536e0)')} / (t.h + {lam}))"
            if last:
                made.append(f"SELECT m, {t} AS tree, node, {level} AS depth, cast(NULL AS integer) AS f, cast(NULL AS integer) "
                            f"AS side, cast(NULL AS double) AS gain, h AS cover, {value} AS value FROM t{at} t")
                break
            ctes.append(f"""h{at} AS MATERIALIZED (
  SELECT m, node, f, b, cast(sum(g) AS bigint) AS g, count(*) AS h FROM e{at} e JOIN bl ON bl.rid = e.rid GROUP BY m, node, f, b)""")
            ctes.append(f"""c{at} AS MATERIALIZED (
  SELECT m, node, f, b, sum(g) OVER w AS gl, sum(h) OVER w AS hl, row_number() OVER w AS pos
  FROM h{at} WHERE b > 0
  WINDOW w AS (PARTITION BY m, node, f ORDER BY CASE WHEN {is_cat} THEN g / 65536e0 / (h + {lam}) ELSE 0 END, b
               ROWS UNBOUNDED PRECEDING))""")
            gl, hl = "cast(gl + side * coalesce(z.g, 0) AS bigint)", "cast(hl + side * coalesce(z.h, 0) AS bigint)"
            ctes.append(f"""k{at} AS (
  SELECT c.m, c.node, c.f, c.b, pos, side, t.g AS g, t.h AS h, {gl} AS gl, {hl} AS hl
  FROM c{at} c JOIN t{at} t ON t.m = c.m AND t.node = c.node
  LEFT JOIN h{at} z ON z.m = c.m AND z.node = c.node AND z.f = c.f AND z.b = 0, (VALUES (0), (1)) s(side))""")
            gain = (f"({score('(gl / 65536e0)', 'hl')} + {score('((g - gl) / 65536e0)', '(h - hl)')} "
                    f"- {score('(g / 65536e0)', 'h')})")
            ctes.append(f"""best{at} AS MATERIALIZED (
  SELECT * FROM (SELECT *, {gain} AS gain FROM k{at} WHERE hl >= {least} AND h - hl >= {least}) WHERE gain > 1e-6
  QUALIFY row_number() OVER (PARTITION BY m, node ORDER BY gain DESC, f, side, pos) = 1)""")
            made.append(f"SELECT t.m, {t} AS tree, t.node, {level} AS depth, b.f, b.side, b.gain, t.h AS cover, {value} AS value "
                        f"FROM t{at} t LEFT JOIN best{at} b ON b.m = t.m AND b.node = t.node")
            right = (f"CASE WHEN bl.b = 0 THEN w.side = 0 WHEN w.{is_cat} THEN coalesce(c.pos > w.pos, w.side = 0) "
                     "ELSE bl.b > w.b END") if categorical else "CASE WHEN bl.b = 0 THEN w.side = 0 ELSE bl.b > w.b END"
            ctes.append(f"""n{t}_{level + 1} AS MATERIALIZED (
  SELECT n.m, n.rid, CASE WHEN n.done OR w.m IS NULL THEN n.node ELSE 2 * n.node + cast({right} AS integer) END AS node,
         n.done OR w.m IS NULL AS done
  FROM n{at} n LEFT JOIN best{at} w ON w.m = n.m AND w.node = n.node AND NOT n.done
  LEFT JOIN bl ON bl.rid = n.rid AND bl.f = w.f
  LEFT JOIN c{at} c ON c.m = n.m AND c.node = n.node AND c.f = w.f AND c.b = bl.b)""")
        ctes.append(f"v{t} AS MATERIALIZED (" + " UNION ALL ".join(
            f"SELECT m, node, value FROM ({q}) WHERE f IS NULL" for q in made[-boost.max_depth - 1:]) + ")")
        ctes.append(f"""st{t + 1} AS MATERIALIZED (
  SELECT r.m, r.rid, yq, train, p + value AS p FROM st{t} r JOIN n{t}_{boost.max_depth} n ON n.m = r.m AND n.rid = r.rid
  JOIN v{t} v ON v.m = n.m AND v.node = n.node)""")
    if made:
        ctes.append("nodes AS MATERIALIZED (" + " UNION ALL ".join(made) + ")")
    ctes.append(f"pred AS (SELECT m, rid, p FROM st{trees})")
    ctes.append("names AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(names)) + ") v(f, feature))")
    return f"WITH {_BASE.strip()}{_CV.rstrip()},\n" + ",\n".join(ctes) + f"\n{select}"


# The same learner as one step that repeats: a level of every model's tree, ``boost.n_estimators`` trees of
# ``boost.max_depth`` levels.  The text stays short whatever their number; only the latest state of a row is kept.
def with_whole_boost(select: str, features: list[str], categorical: list[str], boost, models: list[int],
                     target: str = "pm2_5", max_bins: int = 256) -> str:
    """``select`` may read x (the rows) and pred(m, rid, p) of the training rows."""
    shrunk, score = _objective(boost)
    lam, lr, least = f"{boost.reg_lambda!r}e0", f"{boost.learning_rate!r}e0", max(boost.min_child_weight, 1)
    is_cat = f"f < {len(categorical)}" if categorical else "false"
    _, ctes = _boost_rows(features, categorical, models, target, max_bins)
    gain = (f"({score('(gl / 65536e0)', 'hl')} + {score('((g - gl) / 65536e0)', '(h - hl)')} "
            f"- {score('(g / 65536e0)', 'h')})")
    right = (f"CASE WHEN bl.b = 0 THEN s.side = 0 WHEN s.{is_cat} THEN coalesce(c.pos > s.pos, s.side = 0) "
             "ELSE bl.b > s.b END") if categorical else "CASE WHEN bl.b = 0 THEN s.side = 0 ELSE bl.b > s.b END"
    ctes.append(f"""grown(m, rid, yq, train, p, node, done, tree, level) USING KEY (m, rid) AS (
  SELECT m, rid, yq, train, p, 1, false, 0, 0 FROM st0 WHERE rid IN (SELECT rid FROM x WHERE NOT is_test)
  UNION
  (WITH e AS MATERIALIZED (
     SELECT m, rid, node, level, cast(round(p * 65536) AS bigint) - yq AS g FROM grown
     WHERE train AND NOT done AND tree < {boost.n_estimators}),
   t AS MATERIALIZED (SELECT m, node, cast(sum(g) AS bigint) AS g, count(*) AS h FROM e GROUP BY m, node),
   h AS MATERIALIZED (
     SELECT m, node, f, b, cast(sum(g) AS bigint) AS g, count(*) AS h 
     FROM (SELECT e.* FROM e JOIN t ON t.m = e.m AND t.node = e.node WHERE t.h >= {2 * least} AND level < {boost.max_depth}) e
     JOIN bl ON bl.rid = e.rid GROUP BY m, node, f, b),
   c AS MATERIALIZED (
     SELECT m, node, f, b, sum(g) OVER w AS gl, sum(h) OVER w AS hl, row_number() OVER w AS pos FROM h WHERE b > 0
     WINDOW w AS (PARTITION BY m, node, f ORDER BY CASE WHEN {is_cat} THEN g / 65536e0 / (h + {lam}) ELSE 0 END, b
                  ROWS UNBOUNDED PRECEDING)),
   k AS (
     SELECT c.m, c.node, c.f, c.b, pos, side, t.g AS g, t.h AS h, cast(gl + side * coalesce(z.g, 0) AS bigint) AS gl,
            cast(hl + side * coalesce(z.h, 0) AS bigint) AS hl
     FROM c JOIN t ON t.m = c.m AND t.node = c.node
     LEFT JOIN (SELECT * FROM h WHERE b = 0) z ON z.m = c.m AND z.node = c.node AND z.f = c.f
     JOIN (VALUES (0), (1)) q(side) ON side = 0 OR z.h > 0),
   gains AS MATERIALIZED (
     SELECT * FROM (SELECT *, {gain} AS gain FROM k WHERE hl >= {least} AND h - hl >= {least}) WHERE gain > 1e-6),
   best AS MATERIALIZED (
     SELECT g.* FROM gains g JOIN (SELECT m, node, max(gain) AS most FROM gains GROUP BY m, node) q
     ON q.m = g.m AND q.node = g.node AND g.gain = most
     QUALIFY row_number() OVER (PARTITION BY g.m, g.node ORDER BY f, side, pos) = 1)
   SELECT r.m, r.rid, r.yq, r.train,
          CASE WHEN r.done OR s.m IS NOT NULL THEN p ELSE p + {lr} * (-{shrunk('(t.g / 65536e0)')} / (t.h + {lam})) END,
          CASE WHEN level = {boost.max_depth} THEN 1 WHEN s.m IS NULL THEN r.node
               ELSE 2 * r.node + cast({right} AS integer) END,
          level < {boost.max_depth} AND (r.done OR s.m IS NULL),
          CASE WHEN level = {boost.max_depth} THEN tree + 1 ELSE tree END,
          CASE WHEN level = {boost.max_depth} THEN 0 ELSE level + 1 END
   FROM grown r LEFT JOIN t ON t.m = r.m AND t.node = r.node
   LEFT JOIN best s ON s.m = r.m AND s.node = r.node AND NOT r.done
   LEFT JOIN bl ON bl.rid = r.rid AND bl.f = s.f
   LEFT JOIN c ON c.m = r.m AND c.node = r.node AND c.f = s.f AND c.b = bl.b
   WHERE tree < {boost.n_estimators}))""")
    ctes.append("pred AS (SELECT m, rid, p FROM grown)")
    return f"WITH RECURSIVE {_BASE.strip()}{_CV.rstrip()},\n" + ",\n".join(ctes) + f"\n{select}"
