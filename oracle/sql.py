"""Oracle SQL (DuckDB) per registered query name."""

from __future__ import annotations

from oracle.base import (ADAPTER, PREP, pyround, PROXY_LABELS, REGION_LABELS, RISK_LABELS, band_ord, bands, clip,
                         clip01, i64, r6, rnd)

MONTHS = ["Jan", "Fév", "Mar", "Avr", "Mai", "Juin", "Juil", "Aoû", "Sep", "Oct", "Nov", "Déc"]
SECTORS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE",
           "S", "SSO", "SO", "OSO", "O", "ONO", "NO", "NNO"]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pmod360(x: str) -> str:
    return f"(CASE WHEN ({x}) % 360.0 < 0 THEN (({x}) % 360.0 + 360.0) % 360.0 ELSE ({x}) % 360.0 END)"


def sector_ord(x: str) -> str:
    return f"greatest(1, CAST(ceil({pmod360(x)} / 22.5) AS INTEGER))"


def sector_label(o: str) -> str:
    return "(CASE " + " ".join(f"WHEN {o} = {i} THEN {q(s)}" for i, s in enumerate(SECTORS, 1)) + " END)"


def regime(d: str, m: str) -> str:
    dd = pmod360(d)
    return (f"(CASE WHEN {m} IN (11, 12, 1, 2, 3) AND ({dd} >= 315 OR {dd} <= 90) THEN 'Harmattan (NE, Nov-Mar)' "
            f"WHEN {m} IN (5, 6, 7, 8, 9, 10) AND {dd} >= 135 AND {dd} <= 270 THEN 'Mousson (SO, Mai-Oct)' "
            f"ELSE 'Autre' END)")


def month_label(m: str) -> str:
    return ("(CASE " + " ".join(f"WHEN {m} = {i} THEN {q(s)}" for i, s in enumerate(MONTHS, 1))
            + f" ELSE CAST({m} AS VARCHAR) END)")


# prepared table columns by kind
OBS_INT = ["mois", "annee", "trimestre", "jour_semaine", "jour_annee", "alerte_pollution"]
OBS_DBL = ["latitude", "longitude", "temp_max", "temp_min", "temp_moy", "ressenti_max", "point_rosee_moy",
           "humidite_moy", "pression_mer_moy", "hauteur_couche_limite_moy", "vitesse_vent_max",
           "rafales_max", "direction_vent", "precipitation", "rayonnement_court_total", "duree_jour",
           "duree_ensoleillement", "mois_sin", "mois_cos", "vent_sin", "vent_cos", "ecart_point_rosee",
           "ratio_rafales", "pression_anomalie", "ecart_ressenti", "ratio_ensoleillement",
           "proxy_pm25", "indice_stagnation", "score_risque"]
LAG_VARS = ["temp_max", "precipitation", "vitesse_vent_max", "humidite_moy", "hauteur_couche_limite_moy"]
OBS_DBL += [f"{v}_lag{k}" for k in (1, 7) for v in LAG_VARS] + [f"{v}_moy7j" for v in LAG_VARS]
OBS_STR = ["ville", "region", "zone_climatique", "saison", "categorie_meteo", "niveau_alerte"]


def obs_select(alias: str = "o") -> str:
    cols = ([f"{alias}.identifiant", f"{alias}.date"] + [f"{alias}.{c}" for c in OBS_STR]
            + [f"{i64(f'{alias}.{c}')} AS {c}" for c in OBS_INT]
            + [f"{r6(f'{alias}.{c}')} AS {c}" for c in OBS_DBL])
    return ", ".join(cols)


CITY_RISK = """,
cr_base AS (
  SELECT ville,
         first(region ORDER BY date ASC NULLS LAST, identifiant) FILTER (WHERE region IS NOT NULL) AS region,
         avg(proxy_pm25) AS pm25_moyen, avg(alerte_pollution) AS pct_alerte,
         first(latitude ORDER BY date ASC NULLS LAST, identifiant) FILTER (WHERE latitude IS NOT NULL) AS latitude,
         first(longitude ORDER BY date ASC NULLS LAST, identifiant) FILTER (WHERE longitude IS NOT NULL) AS longitude
  FROM obs WHERE ville IS NOT NULL GROUP BY ville
),
cr_daily AS (
  SELECT ville, date, avg(proxy_pm25) AS p FROM obs
  WHERE date IS NOT NULL AND ville IS NOT NULL GROUP BY ville, date
),
cr_last AS (SELECT *, row_number() OVER (PARTITION BY ville ORDER BY date DESC) AS rn FROM cr_daily),
cr_trend AS (
  SELECT ville, CASE WHEN count(*) >= 8
                     THEN avg(p) FILTER (WHERE rn <= 7) - avg(p) FILTER (WHERE rn > 7) ELSE 0.0 END AS tendance
  FROM cr_last WHERE rn <= 14 GROUP BY ville
),
cr_j AS (
  SELECT b.*, t.tendance, b.pm25_moyen AS c_pm, b.pct_alerte * 100.0 AS c_pct,
         CASE WHEN t.tendance IS NULL THEN NULL WHEN t.tendance < 0 THEN 0.0 ELSE t.tendance END AS c_tr
  FROM cr_base b LEFT JOIN cr_trend t ON b.ville = t.ville
),
cr_st AS (
  SELECT min(c_pm) AS pm_lo, max(c_pm) AS pm_hi, min(c_pct) AS pct_lo, max(c_pct) AS pct_hi,
         min(c_tr) AS tr_lo, max(c_tr) AS tr_hi FROM cr_j
),
city_risk0 AS (
  SELECT ville, region, pm25_moyen, RND_PCT AS pct_alerte, latitude, longitude, RND_TR AS tendance_7j,
         RND_SCORE AS score_risque
  FROM cr_j CROSS JOIN cr_st
),
city_risk AS (SELECT *, BANDS AS niveau_risque FROM city_risk0)"""


def _s(x: str, lo: str, hi: str) -> str:
    return f"(CASE WHEN {hi} IS NULL THEN 0.0 WHEN {hi} = {lo} THEN 0.5 ELSE {clip01(f'({x} - {lo}) / ({hi} - {lo})')} END)"


CITY_RISK = (CITY_RISK
             .replace("RND_PCT", rnd("pct_alerte * 100.0", 1))
             .replace("RND_TR", rnd("tendance", 1))
             .replace("RND_SCORE", rnd(f"(0.55 * {_s('c_pm', 'pm_lo', 'pm_hi')} + 0.3 * {_s('c_pct', 'pct_lo', 'pct_hi')}"
                                       f" + 0.15 * {_s('c_tr', 'tr_lo', 'tr_hi')}) * 100.0", 1))
             .replace("BANDS", bands("score_risque", RISK_LABELS)))

CITY_RISK_SELECT = (f"SELECT ville, region, {r6('pm25_moyen')} AS pm25_moyen, {r6('pct_alerte')} AS pct_alerte, "
                    f"{r6('latitude')} AS latitude, {r6('longitude')} AS longitude, {r6('tendance_7j')} AS tendance_7j, "
                    f"{r6('score_risque')} AS score_risque, niveau_risque FROM city_risk")

DAILY = """,
daily AS (SELECT ville, date, avg(proxy_pm25) AS p FROM obs
          WHERE date IS NOT NULL AND ville IS NOT NULL GROUP BY ville, date)"""

SQL: dict[str, str] = {}

SQL["source_observations"] = "WITH " + ADAPTER.strip() + f"""
SELECT identifiant AS id, date, ville AS city, region, {r6('latitude')} AS latitude, {r6('longitude')} AS longitude,
       zone_climatique, {i64('mois')} AS mois, {i64('annee')} AS annee, {i64('trimestre')} AS trimestre, saison,
       {i64('jour_semaine')} AS jour_semaine, {r6('temp_max')} AS temp_max, {r6('temp_min')} AS temp_min,
       {r6('temp_moy')} AS temp_mean, {r6('ressenti_max')} AS feels_like_max,
       {r6('point_rosee_moy')} AS dew_point_2m_mean, {r6('humidite_moy')} AS relative_humidity_2m_mean,
       {r6('pression_mer_moy')} AS pressure_msl_mean, {r6('hauteur_couche_limite_moy')} AS boundary_layer_height_mean,
       {r6('vitesse_vent_max')} AS wind_speed_max, {r6('rafales_max')} AS wind_gusts_max,
       {r6('direction_vent')} AS wind_direction, {r6('precipitation')} AS precipitation,
       {r6('rayonnement_court_total')} AS shortwave_radiation_sum, {r6('duree_jour_s')} AS daylight_duration,
       {r6('duree_ensoleillement_s')} AS sunshine_duration, categorie_meteo
FROM raw"""

SQL["prepared_observations"] = PREP + f"""
SELECT {obs_select('o')}, {i64('o.cutoff')} AS _cutoff, {r6('p.seuil')} AS _seuil
FROM obs o CROSS JOIN params p"""

SQL["audit"] = PREP + f"""
SELECT {i64('count(*)')} AS n_rows, {i64('count(DISTINCT ville)')} AS n_cities,
       {i64('min(annee)')} AS year_min, {i64('max(annee)')} AS year_max FROM obs"""

SQL["describe_proxy"] = PREP + f"""
SELECT {i64('count(proxy_pm25)')} AS count, {r6('avg(proxy_pm25)')} AS mean, {r6('stddev_samp(proxy_pm25)')} AS std,
       {r6('min(proxy_pm25)')} AS min, {r6('quantile_cont(proxy_pm25, 0.25)')} AS q25,
       {r6('quantile_cont(proxy_pm25, 0.5)')} AS q50, {r6('quantile_cont(proxy_pm25, 0.75)')} AS q75,
       {r6('max(proxy_pm25)')} AS max FROM obs"""

SQL["value_counts_alert"] = PREP + f"""
SELECT {i64('alerte_pollution')} AS value, {i64('count(*)')} AS n FROM obs GROUP BY alerte_pollution"""

SQL["columns_equal_proxy_score"] = PREP + """
SELECT count(*) FILTER (WHERE proxy_pm25 IS DISTINCT FROM score_risque) = 0 AS identical FROM obs"""


def _task(table: str, col: str, name: str) -> str:
    return (f"SELECT {q(name)} AS cible, CASE WHEN count({col}) > 0 AND "
            f"bool_and({col} IS NULL OR CAST({col} AS DOUBLE) IN (0.0, 1.0)) "
            f"THEN 'classification' ELSE 'regression' END AS task_type FROM {table}")


SQL["task_type_targets"] = PREP + "\n" + "\nUNION ALL\n".join(
    _task("obs", t, t) for t in ["proxy_pm25", "alerte_pollution", "indice_stagnation", "score_risque"])

SQL["task_type_labels"] = _task("labels", "quality", "quality") + "\nUNION ALL\n" + _task("labels", "toxic", "toxic")

SQL["drop_missing_target"] = PREP + f"""
SELECT {i64('annee')} AS annee, {i64('count(*)')} AS n FROM obs WHERE proxy_pm25 IS NOT NULL GROUP BY annee"""

SQL["daily_trend"] = PREP + f""",
d AS (SELECT date, avg(proxy_pm25) AS p FROM obs WHERE date IS NOT NULL GROUP BY date)
SELECT date, {r6('p')} AS proxy_pm25,
       {r6('avg(p) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)')} AS moyenne_mobile_7j
FROM d"""

SQL["daily_city_mean"] = PREP + DAILY + f"""
SELECT ville, date, {r6('p')} AS proxy_pm25 FROM daily"""

SQL["recent_delta"] = PREP + DAILY + f""",
l AS (SELECT *, row_number() OVER (PARTITION BY ville ORDER BY date DESC) AS rn FROM daily)
SELECT ville, {r6("CASE WHEN count(*) >= 8 THEN avg(p) FILTER (WHERE rn <= 7) - avg(p) FILTER (WHERE rn > 7) ELSE 0.0 END")}
       AS tendance_7j
FROM l WHERE rn <= 14 GROUP BY ville"""

SQL["history_tail"] = PREP + f""",
d AS (SELECT ville, date, avg(proxy_pm25) AS p FROM obs
      WHERE date IS NOT NULL AND proxy_pm25 IS NOT NULL AND ville IS NOT NULL GROUP BY ville, date),
l AS (SELECT *, row_number() OVER (PARTITION BY ville ORDER BY date DESC) AS rn FROM d)
SELECT ville, date, {r6('p')} AS proxy_pm25 FROM l WHERE rn <= 60"""

SQL["events_daily_series"] = f"""
WITH u AS (SELECT user_id, arg_min(event_type, event_id) AS region FROM events GROUP BY user_id),
d AS (SELECT user_id, CAST(ts AS DATE) AS date, avg(value) AS v FROM events GROUP BY user_id, CAST(ts AS DATE))
SELECT CAST(d.user_id AS VARCHAR) AS ville, u.region, d.date, {r6('d.v')} AS valeur
FROM d JOIN u ON d.user_id = u.user_id WHERE d.date IS NOT NULL"""

SQL["kpis"] = PREP + CITY_RISK + f""",
lv AS (SELECT {band_ord('proxy_pm25')} AS o, count(*) AS n FROM obs
       WHERE {band_ord('proxy_pm25')} IS NOT NULL GROUP BY 1),
md AS (SELECT o FROM lv ORDER BY n DESC, o ASC LIMIT 1)
SELECT {r6('avg(proxy_pm25)')} AS target_mean, {r6('avg(alerte_pollution) * 100.0')} AS pct_alerte,
       {r6('avg(temp_max)')} AS temp_moy, {r6('avg(vitesse_vent_max)')} AS vent_moy,
       (SELECT {r6('coalesce(avg(score_risque), 0.0)')} FROM city_risk) AS score_risque_moy,
       (SELECT CASE o WHEN 1 THEN 'Bon' WHEN 2 THEN 'Modéré' WHEN 3 THEN 'Mauvais' WHEN 4 THEN 'Dangereux' END
        FROM md) AS niveau_mode
FROM obs"""

SQL["city_map"] = PREP + f""",
c AS (
  SELECT ville, {rnd('avg(proxy_pm25)', 1)} AS target_value,
         first(latitude ORDER BY date ASC NULLS LAST, identifiant) FILTER (WHERE latitude IS NOT NULL) AS latitude,
         first(longitude ORDER BY date ASC NULLS LAST, identifiant) FILTER (WHERE longitude IS NOT NULL) AS longitude,
         first(region ORDER BY date ASC NULLS LAST, identifiant) FILTER (WHERE region IS NOT NULL) AS region,
         {rnd('avg(alerte_pollution) * 100.0', 1)} AS alerte_pct, avg(temp_max) AS temp
  FROM obs WHERE ville IS NOT NULL GROUP BY ville
)
SELECT ville, {r6('target_value')} AS target_value, {r6('latitude')} AS latitude, {r6('longitude')} AS longitude,
       region, {r6('alerte_pct')} AS alerte_pct, {r6('temp')} AS temp, {bands('target_value', PROXY_LABELS)} AS niveau
FROM c"""

SQL["monthly_mean"] = PREP + f"""
SELECT {i64('mois')} AS mois, {r6('avg(proxy_pm25)')} AS proxy_pm25, {month_label('mois')} AS mois_nom
FROM obs GROUP BY mois"""

SQL["yearly_region_mean"] = PREP + f"""
SELECT {i64('annee')} AS annee, region, {r6('avg(proxy_pm25)')} AS proxy_pm25 FROM obs GROUP BY annee, region"""

SQL["level_counts"] = PREP + f""",
dim AS (SELECT * FROM (VALUES (1, 'Bon'), (2, 'Modéré'), (3, 'Mauvais'), (4, 'Dangereux')) t(ordre, Niveau)),
c AS (SELECT niveau_alerte AS Niveau, count(*) AS Jours FROM obs WHERE niveau_alerte IS NOT NULL GROUP BY 1)
SELECT dim.Niveau, {i64('coalesce(c.Jours, 0)')} AS Jours, {i64('dim.ordre')} AS ordre
FROM dim LEFT JOIN c ON dim.Niveau = c.Niveau"""

SQL["alert_share_by_region"] = PREP + f"""
SELECT region, {r6('avg(alerte_pollution)')} AS alerte_pollution, {r6(rnd('avg(alerte_pollution) * 100.0', 1))} AS pct
FROM obs GROUP BY region"""

SQL["region_median_order"] = PREP + f"""
SELECT region, {r6('median(proxy_pm25)')} AS mediane FROM obs GROUP BY region"""


def _box(src: str, group: str) -> str:
    return f""",
b AS (SELECT {group} AS groupe, proxy_pm25 AS v FROM {src} WHERE proxy_pm25 IS NOT NULL),
qq AS (SELECT groupe, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS mediane,
              quantile_cont(v, 0.75) AS q3 FROM b GROUP BY groupe),
j AS (SELECT b.groupe, b.v, qq.n, qq.q1, qq.mediane, qq.q3, qq.q1 - 1.5 * (qq.q3 - qq.q1) AS lo,
             qq.q3 + 1.5 * (qq.q3 - qq.q1) AS hi
      FROM b JOIN qq ON b.groupe IS NOT DISTINCT FROM qq.groupe)
SELECT groupe, {i64('any_value(n)')} AS n, {r6('any_value(q1)')} AS q1, {r6('any_value(mediane)')} AS mediane,
       {r6('any_value(q3)')} AS q3, {r6('min(v) FILTER (WHERE v >= lo)')} AS moustache_basse,
       {r6('max(v) FILTER (WHERE v <= hi)')} AS moustache_haute,
       {i64('count(*) FILTER (WHERE v < lo OR v > hi)')} AS n_extremes
FROM j GROUP BY groupe"""


SQL["box_stats_region"] = PREP + _box("obs", "region")

REGIME_CTE = f""",
rg AS (SELECT *, {regime('direction_vent', 'mois')} AS regime FROM obs
       WHERE direction_vent IS NOT NULL AND proxy_pm25 IS NOT NULL AND mois IS NOT NULL)"""

SQL["box_stats_regime"] = PREP + REGIME_CTE + _box("rg", "regime")

SQL["wind_rose_counts"] = PREP + f""",
w AS (SELECT {sector_ord('direction_vent')} AS ordre FROM obs
      WHERE direction_vent IS NOT NULL AND proxy_pm25 IS NOT NULL)
SELECT {i64('ordre')} AS ordre, {i64('count(*)')} AS frequence, {sector_label('ordre')} AS secteur
FROM w GROUP BY ordre"""

SQL["wind_rose_mean"] = PREP + f""",
w AS (SELECT {sector_ord('direction_vent')} AS ordre, proxy_pm25 FROM obs
      WHERE direction_vent IS NOT NULL AND proxy_pm25 IS NOT NULL)
SELECT {i64('ordre')} AS ordre, {r6('avg(proxy_pm25)')} AS proxy_pm25, {sector_label('ordre')} AS secteur
FROM w GROUP BY ordre"""

SQL["regime_stats"] = PREP + REGIME_CTE + f"""
SELECT regime AS Regime, {r6('avg(proxy_pm25)')} AS valeur_moyenne, {i64('count(proxy_pm25)')} AS nb_jours
FROM rg GROUP BY regime"""

_CORR = ["temp_max", "temp_min", "humidite_moy", "vitesse_vent_max", "hauteur_couche_limite_moy",
         "precipitation", "rayonnement_court_total", "pression_mer_moy"]


def _corr(v: str, t: str = "proxy_pm25") -> str:
    a = f"CASE WHEN {t} IS NOT NULL THEN {v} END"
    b = f"CASE WHEN {v} IS NOT NULL THEN {t} END"
    return (f"SELECT {q(v)} AS variable, "
            f"{r6(f'covar_pop({v}, {t}) / NULLIF(stddev_pop({a}) * stddev_pop({b}), 0)')} AS correlation FROM obs")


SQL["target_correlations"] = PREP + "\n" + "\nUNION ALL\n".join(_corr(v) for v in _CORR)

SQL["month_region_pivot"] = PREP + "\nSELECT region, " + ", ".join(
    f"{r6(f'avg(proxy_pm25) FILTER (WHERE mois = {i})')} AS \"{m}\"" for i, m in enumerate(MONTHS, 1)
) + " FROM obs GROUP BY region"

SQL["season_by_month"] = PREP + """,
s AS (SELECT * FROM obs WHERE saison IS NOT NULL AND ville IS NOT NULL),
cm AS (SELECT ville, mois, saison, count(*) AS n FROM s GROUP BY ville, mois, saison),
bm AS (SELECT ville, mois, saison AS saison_mois FROM (
         SELECT *, row_number() OVER (PARTITION BY ville, mois ORDER BY n DESC, saison) AS rn FROM cm) WHERE rn = 1),
ov AS (SELECT ville, saison AS saison_mode FROM (
         SELECT ville, saison, row_number() OVER (PARTITION BY ville ORDER BY sum(n) DESC, saison) AS rn
         FROM cm GROUP BY ville, saison) WHERE rn = 1),
la AS (SELECT ville, last(saison ORDER BY date ASC NULLS LAST, identifiant) AS saison_derniere FROM s GROUP BY ville)
SELECT bm.ville, CAST(bm.mois AS BIGINT) AS mois, bm.saison_mois, la.saison_derniere, ov.saison_mode
FROM bm LEFT JOIN la ON bm.ville = la.ville LEFT JOIN ov ON bm.ville = ov.ville"""

SQL["city_risk"] = PREP + CITY_RISK + "\n" + CITY_RISK_SELECT

_MSG = [(70, "Alerte sanitaire immédiate : communiquer, protéger les publics fragiles, renforcer la surveillance."),
        (50, "Vigilance élevée : intensifier le suivi, messages préventifs recommandés."),
        (30, "Surveillance renforcée : risque modéré, suivre l’évolution quotidienne.")]

SQL["region_alerts"] = PREP + f""",
reg AS (SELECT region, avg(proxy_pm25) AS pm, avg(alerte_pollution) * 100.0 AS pct FROM obs GROUP BY region),
sc AS (SELECT *, {rnd(clip('0.65 * pm + 0.35 * pct', 0.0, 100.0), 1)} AS score FROM reg)
SELECT region, {r6('pm')} AS pm25_moyen, {r6('pct')} AS pct_alerte, {r6('score')} AS score_sanitaire,
       {bands('score', REGION_LABELS)} AS niveau,
       CASE {" ".join(f"WHEN score >= {t} THEN {q(m)}" for t, m in _MSG)}
            ELSE 'Situation globalement stable : veille standard.' END AS message
FROM sc"""

_R = {
    "high": "🔴 **Renforcer l’alerte sanitaire** : diffuser des messages radio/SMS, limiter les activités physiques extérieures et protéger les personnes vulnérables.",
    "med": "🟠 **Mettre le système de veille en vigilance** : communication préventive, suivi quotidien des zones sensibles et sensibilisation des écoles/hôpitaux.",
    "low": "🟢 **Maintenir la surveillance de routine** : la qualité de l’air reste globalement acceptable, mais la veille météo doit continuer.",
    "share": "🚨 **Déployer un protocole régional d’alerte** dans les zones où les jours d’alerte sont fréquents.",
    "wind": "💨 **Risque de stagnation atmosphérique** : surveiller les épisodes de vent faible, propices à l’accumulation des polluants.",
    "dry": "🌧️ **Absence de lessivage atmosphérique** : prévoir un suivi renforcé lors des périodes sèches.",
    "heat": "🌡️ **Chaleur élevée** : surveiller les réactions photochimiques et les risques respiratoires.",
}

SQL["recommendations"] = PREP + CITY_RISK + f""",
g AS (SELECT coalesce(avg(proxy_pm25), 0.0) AS pm, coalesce(avg(alerte_pollution) * 100.0, 0.0) AS pct,
             avg(vitesse_vent_max) AS wind, avg(precipitation) AS rain, avg(temp_max) AS temp FROM obs),
top AS (SELECT ville, region, score_risque,
               row_number() OVER (ORDER BY score_risque DESC NULLS LAST, pm25_moyen DESC NULLS LAST, ville) AS r
        FROM city_risk),
cand AS (
  SELECT 1 AS code, CASE WHEN pm >= 55 THEN {q(_R['high'])} WHEN pm >= 40 THEN {q(_R['med'])} ELSE {q(_R['low'])} END AS texte FROM g
  UNION ALL SELECT 2, CASE WHEN pct >= 20 THEN {q(_R['share'])} END FROM g
  UNION ALL SELECT 3, CASE WHEN wind < 12 THEN {q(_R['wind'])} END FROM g
  UNION ALL SELECT 4, CASE WHEN rain < 1 THEN {q(_R['dry'])} END FROM g
  UNION ALL SELECT 5, CASE WHEN temp > 32 THEN {q(_R['heat'])} END FROM g
  UNION ALL SELECT 6, '📍 **Ville prioritaire** : concentrer la surveillance sur **' || ville || '** ('
                      || coalesce(region, 'nan') || ') avec un score de risque de **'
                      || coalesce(CAST(score_risque AS VARCHAR), 'nan') || '/100**.' FROM top WHERE r = 1
  UNION ALL SELECT 7, '🏙️ **Top 3 villes à suivre** : ' || string_agg(ville, ', ' ORDER BY r) || '.'
            FROM top WHERE r <= 3 HAVING count(*) >= 3
  UNION ALL SELECT 8, '📏 **Seuil opérationnel actuel** : considérer les journées avec **Proxy PM2.5** >= **'
                      || coalesce(printf('%.1f', seuil), 'nan') || '** comme prioritaires.'
            FROM params WHERE seuil IS NULL OR seuil <> 0
)
SELECT CAST(row_number() OVER (ORDER BY code) AS BIGINT) AS rang, CAST(code AS BIGINT) AS code, texte
FROM cand WHERE texte IS NOT NULL"""

SQL["data_browser"] = PREP + f"""
SELECT date, ville, region, {r6('temp_max')} AS temp_max, {r6('temp_min')} AS temp_min,
       {r6('humidite_moy')} AS humidite_moy, {r6('vitesse_vent_max')} AS vitesse_vent_max,
       {r6('precipitation')} AS precipitation, {r6('proxy_pm25')} AS proxy_pm25,
       {bands('proxy_pm25', PROXY_LABELS)} AS niveau_target
FROM obs ORDER BY ville ASC NULLS LAST, date ASC NULLS LAST, identifiant LIMIT 500"""


# --- C / H -------------------------------------------------------------------

SLICE = """,
sl AS (SELECT * FROM obs WHERE annee BETWEEN 1996 AND 1999 AND region IN ('AFRICA', 'EUROPE'))"""

SQL["slice_observations"] = PREP + SLICE + f"""
SELECT identifiant, date, ville, region, {i64('annee')} AS annee, {r6('proxy_pm25')} AS proxy_pm25 FROM sl"""

SQL["filtered_export"] = PREP + SLICE + f"""
SELECT date, ville, region, {r6('temp_max')} AS temp_max, {r6('temp_min')} AS temp_min,
       {r6('humidite_moy')} AS humidite_moy, {r6('vitesse_vent_max')} AS vitesse_vent_max,
       {r6('precipitation')} AS precipitation, {r6('proxy_pm25')} AS proxy_pm25,
       {bands('proxy_pm25', PROXY_LABELS)} AS niveau_target FROM sl"""

SQL["sample_rows"] = PREP + f"""
SELECT identifiant, ville, date, {r6('proxy_pm25')} AS proxy_pm25 FROM obs
ORDER BY md5(CAST(identifiant AS VARCHAR) || ':42'), identifiant LIMIT 2000"""

SQL["slice_city_risk"] = PREP + SLICE + CITY_RISK.replace("FROM obs", "FROM sl") + "\n" + CITY_RISK_SELECT

SQL["filter_values"] = PREP + """
SELECT DISTINCT 'region' AS kind, region AS value FROM obs WHERE region IS NOT NULL
UNION ALL
SELECT DISTINCT 'ville', ville FROM obs WHERE ville IS NOT NULL AND region IN ('AFRICA', 'EUROPE')
UNION ALL
SELECT DISTINCT 'annee', CAST(annee AS VARCHAR) FROM obs WHERE annee IS NOT NULL"""

SQL["temporal_split"] = PREP + f""",
c AS (SELECT max(annee) - 1 AS cut FROM obs)
SELECT CASE WHEN annee <= cut THEN 'train' WHEN annee > cut THEN 'test' END AS split, {i64('annee')} AS annee,
       {i64('count(*)')} AS n
FROM obs CROSS JOIN c GROUP BY 1, 2"""

MODEL_FRAME = """,
mf0 AS (SELECT * FROM obs WHERE proxy_pm25 IS NOT NULL),
mcut AS (SELECT max(annee) - 1 AS cut FROM mf0),
mf AS (SELECT mf0.*, CASE WHEN annee <= cut THEN 'train' WHEN annee > cut THEN 'test' END AS split
       FROM mf0 CROSS JOIN mcut)"""

SQL["validation_split"] = PREP + MODEL_FRAME + f""",
tr AS (SELECT * FROM mf WHERE split = 'train'),
pos AS (SELECT ville, row_number() OVER (ORDER BY ville ASC NULLS LAST, date ASC NULLS LAST, identifiant) AS p FROM tr),
k AS (SELECT greatest(CAST(floor(count(*) * 0.85) AS BIGINT), 1) AS k, count(*) AS tot FROM tr)
SELECT ville, {i64('count(*) FILTER (WHERE NOT (tot - k > 20 AND p > k))')} AS n_fit,
       {i64('count(*) FILTER (WHERE tot - k > 20 AND p > k)')} AS n_val
FROM pos CROSS JOIN k GROUP BY ville"""

SQL["validation_rows"] = PREP + MODEL_FRAME + f""",
tr AS (SELECT * FROM mf WHERE split = 'train'),
pos AS (SELECT *, row_number() OVER (ORDER BY ville ASC NULLS LAST, date ASC NULLS LAST, identifiant) AS p FROM tr),
k AS (SELECT greatest(CAST(floor(count(*) * 0.85) AS BIGINT), 1) AS k, count(*) AS tot FROM tr)
SELECT identifiant, ville, date, {r6('proxy_pm25')} AS proxy_pm25, (tot - k > 20 AND p > k) AS is_validation
FROM pos CROSS JOIN k"""

SQL["top_cities"] = PREP + CITY_RISK + f""",
t AS (SELECT ville, score_risque, pm25_moyen,
             row_number() OVER (ORDER BY score_risque DESC NULLS LAST, pm25_moyen DESC NULLS LAST, ville) AS rang
      FROM city_risk)
SELECT ville, {r6('score_risque')} AS score_risque, {r6('pm25_moyen')} AS pm25_moyen, {i64('rang')} AS rang
FROM t WHERE rang <= 15"""

# --- K -----------------------------------------------------------------------

NUMS = ["latitude", "longitude", "mois", "annee", "trimestre", "jour_semaine", "temp_min", "temp_moy",
        "ressenti_max", "point_rosee_moy", "pression_mer_moy", "rafales_max", "direction_vent", "duree_jour",
        "duree_ensoleillement", "jour_annee", "mois_sin", "mois_cos", "vent_sin", "vent_cos",
        "ecart_point_rosee", "ratio_rafales", "pression_anomalie", "ecart_ressenti", "ratio_ensoleillement"]
NUMS += [f"{v}_lag{k}" for k in (1, 7) for v in LAG_VARS] + [f"{v}_moy7j" for v in LAG_VARS]
CATS = ["region", "zone_climatique", "saison", "categorie_meteo"]

MEDIANS = ",\nmed AS (SELECT " + ", ".join(
    f"median(CAST({c} AS DOUBLE)) AS {c}" for c in NUMS) + " FROM mf WHERE split = 'train')"

DICT = ",\ndict AS (SELECT col, value, row_number() OVER (PARTITION BY col ORDER BY value) - 1 AS code FROM (" + \
    " UNION ".join(f"SELECT DISTINCT '{c}' AS col, CAST({c} AS VARCHAR) AS value FROM mf "
                   f"WHERE split IS NOT NULL AND {c} IS NOT NULL" for c in CATS) + "))"


def _encoded(src: str) -> str:
    nums = ", ".join(f"CAST(coalesce(CAST(s.{c} AS DOUBLE), med.{c}, 0.0) AS DOUBLE) AS {c}" for c in NUMS)
    cats = ", ".join(f"CAST(coalesce(d_{c}.code, -1) AS DOUBLE) AS {c}" for c in CATS)
    joins = " ".join(f"LEFT JOIN dict d_{c} ON d_{c}.col = '{c}' AND d_{c}.value = CAST(s.{c} AS VARCHAR)"
                     for c in CATS)
    return f"SELECT s.identifiant, {nums}, {cats} FROM {src} s CROSS JOIN med {joins}"


SQL["feature_medians"] = PREP + MODEL_FRAME + MEDIANS + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, {r6(c)} AS median FROM med" for c in NUMS)

SQL["category_dictionary"] = PREP + MODEL_FRAME + DICT + f"""
SELECT col AS "column", value, {i64('code')} AS code FROM dict"""

SQL["scaler_params"] = PREP + MODEL_FRAME + MEDIANS + DICT + f""",
tr AS (SELECT * FROM mf WHERE split = 'train'),
enc AS ({_encoded('tr')})
""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, {r6(f'avg({c})')} AS mean, "
    f"{r6(f'CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END')} AS scale FROM enc"
    for c in NUMS + CATS)

SQL["encoded_test_features"] = PREP + MODEL_FRAME + MEDIANS + DICT + f""",
te AS (SELECT * FROM mf WHERE split = 'test'),
enc AS ({_encoded('te')})
SELECT identifiant, """ + ", ".join(f"{r6(c)} AS {c}" for c in NUMS + CATS) + " FROM enc"

_TEST_ROWS = "(SELECT count(*) FROM mf WHERE split = 'test')"
SQL["model_checks"] = PREP + MODEL_FRAME + f"""
SELECT modele, {i64(_TEST_ROWS)} AS n_test, true AS varies, true AS better, s AS importance_sum
FROM (VALUES ('Ridge', NULL::DOUBLE), ('GBT', 1.0), ('RandomForest', 1.0)) t(modele, s)"""

_CLASS_FRAME = MODEL_FRAME.replace("WHERE proxy_pm25 IS NOT NULL", "WHERE alerte_pollution IS NOT NULL")
SQL["model_checks_classification"] = PREP + _CLASS_FRAME + f"""
SELECT modele, {i64(_TEST_ROWS)} AS n_test, true AS varies, true AS better, s AS importance_sum
FROM (VALUES ('LogisticRegression', NULL::DOUBLE), ('GBT', 1.0), ('RandomForest', 1.0), ('MLP', NULL)) t(modele, s)"""

SQL["ridge_normal_equations"] = PREP + MODEL_FRAME + f"""
SELECT feature, 0.0::DOUBLE AS residual
FROM (VALUES {", ".join(f"('{c}')" for c in NUMS + CATS)}) t(feature) WHERE {_TEST_ROWS} > 0"""

SQL["logistic_normal_equations"] = PREP + _CLASS_FRAME + f"""
SELECT feature, 0.0::DOUBLE AS residual
FROM (VALUES {", ".join(f"('{c}')" for c in NUMS + CATS)}) t(feature) WHERE {_TEST_ROWS} > 0"""

# --- L -----------------------------------------------------------------------

PERS = """,
pers0 AS (SELECT o.*, lag(proxy_pm25) OVER w AS prediction, lag(alerte_pollution) OVER w AS alerte_pred
          FROM obs o WINDOW w AS (PARTITION BY ville ORDER BY date ASC NULLS LAST, identifiant)),
pers AS (SELECT date, ville, region, saison, annee, proxy_pm25, prediction, alerte_pollution, alerte_pred,
                prediction / 100.0 AS score_prediction, proxy_pm25 - prediction AS residu
         FROM pers0 WHERE annee > cutoff AND proxy_pm25 IS NOT NULL AND prediction IS NOT NULL)"""

SQL["predictions_persistence"] = PREP + PERS + f"""
SELECT date, ville, region, saison, {i64('annee')} AS annee, {r6('proxy_pm25')} AS proxy_pm25,
       {r6('prediction')} AS prediction, {r6('residu')} AS residu FROM pers"""


def _reg_metrics(src: str, by: str | None) -> str:
    g = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    join = f"JOIN m ON {src}.{by} IS NOT DISTINCT FROM m.{by}" if by else "CROSS JOIN m"
    return f"""m AS (SELECT {g}avg(proxy_pm25) AS ybar FROM {src} {grp}),
agg AS (SELECT {f'{src}.{by} AS {by}, ' if by else ''}count(*) AS n, sum((proxy_pm25 - prediction) * (proxy_pm25 - prediction)) AS sse,
               sum((proxy_pm25 - ybar) * (proxy_pm25 - ybar)) AS sst, avg(abs(proxy_pm25 - prediction)) AS mae
        FROM {src} {join} {f'GROUP BY {src}.{by}' if by else ''})"""


R2 = "CASE WHEN sst = 0 THEN (CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END) ELSE 1.0 - sse / sst END"

SQL["regression_metrics"] = PREP + PERS + ",\n" + _reg_metrics("pers", None) + f"""
SELECT {i64('n')} AS n, {r6(R2)} AS R2, {r6('sqrt(sse / n)')} AS RMSE, {r6('mae')} AS MAE FROM agg"""


def _cls(src: str, by: str | None) -> str:
    g = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""ca AS (SELECT {g}count(*) AS n, count(*) FILTER (WHERE alerte_pollution = alerte_pred) AS ok,
       count(*) FILTER (WHERE alerte_pollution = 1 AND alerte_pred = 1) AS tp,
       count(*) FILTER (WHERE alerte_pollution = 0 AND alerte_pred = 1) AS fp,
       count(*) FILTER (WHERE alerte_pollution = 1 AND alerte_pred = 0) AS fn
FROM {src} WHERE alerte_pollution IS NOT NULL AND alerte_pred IS NOT NULL {grp})"""


def _sd(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0.0), 0.0)"


CLS_COLS = (f"{i64('n')} AS n, {r6('CAST(ok AS DOUBLE) / n')} AS Accuracy, {r6(_sd('2 * tp', '2 * tp + fp + fn'))} AS F1, "
            f"{r6(_sd('tp', 'tp + fp'))} AS Precision, {r6(_sd('tp', 'tp + fn'))} AS Recall")

SQL["classification_metrics"] = PREP + PERS + ",\n" + _cls("pers", None) + f"\nSELECT {CLS_COLS} FROM ca"


def _auc(src: str, by: str | None) -> str:
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""sc AS (SELECT {g}score_prediction AS s, count(*) FILTER (WHERE alerte_pollution = 1) AS pos,
                  count(*) FILTER (WHERE alerte_pollution <> 1) AS neg
           FROM {src} WHERE alerte_pollution IS NOT NULL AND score_prediction IS NOT NULL GROUP BY {g}s),
cum AS (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cneg
        FROM sc),
auc AS (SELECT {g}CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                   THEN sum(pos * (cneg + neg / 2.0)) / CAST(sum(pos) * sum(neg) AS DOUBLE) END AS ROC_AUC
        FROM cum {grp})"""


SQL["roc_auc"] = PREP + PERS + ",\n" + _auc("pers", None) + f"\nSELECT {r6('ROC_AUC')} AS ROC_AUC FROM auc"

SQL["roc_points"] = PREP + PERS + f""",
sc AS (SELECT score_prediction AS s, count(*) FILTER (WHERE alerte_pollution = 1) AS pos,
              count(*) FILTER (WHERE alerte_pollution <> 1) AS neg
       FROM pers WHERE alerte_pollution IS NOT NULL AND score_prediction IS NOT NULL GROUP BY s),
t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM sc)
SELECT {r6('s')} AS seuil,
       {r6('sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / CAST(P AS DOUBLE)')} AS tpr,
       {r6('sum(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / CAST(N AS DOUBLE)')} AS fpr
FROM sc CROSS JOIN t"""

SQL["confusion_matrix"] = PREP + PERS + f""",
g AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(reel, predit)),
c AS (SELECT alerte_pollution AS reel, alerte_pred AS predit, count(*) AS n FROM pers
      WHERE alerte_pollution IS NOT NULL AND alerte_pred IS NOT NULL GROUP BY 1, 2)
SELECT {i64('g.reel')} AS reel, {i64('g.predit')} AS predit, {i64('coalesce(c.n, 0)')} AS n
FROM g LEFT JOIN c ON g.reel = c.reel AND g.predit = c.predit"""


def _groups_reg() -> str:
    parts = []
    for gcol in ("region", "ville"):
        parts.append(f"""SELECT groupe, {i64('n')} AS n, {r6(R2)} AS R2, {r6('sqrt(sse / n)')} AS RMSE, {r6('mae')} AS MAE,
       '{gcol}' AS groupement FROM (
  WITH pg AS (SELECT *, CAST({gcol} AS VARCHAR) AS groupe FROM pers),
  {_reg_metrics('pg', 'groupe')}
  SELECT * FROM agg) WHERE n >= 5""")
    return "\nUNION ALL\n".join(parts)


def _groups_cls() -> str:
    parts = []
    for gcol in ("region", "ville"):
        parts.append(f"""SELECT groupe, {CLS_COLS}, {r6('ROC_AUC')} AS ROC_AUC, '{gcol}' AS groupement FROM (
  WITH pg AS (SELECT *, CAST({gcol} AS VARCHAR) AS groupe FROM pers),
  {_cls('pg', 'groupe')},
  {_auc('pg', 'groupe')}
  SELECT ca.*, auc.ROC_AUC FROM ca LEFT JOIN auc ON ca.groupe IS NOT DISTINCT FROM auc.groupe) WHERE n >= 5""")
    return "\nUNION ALL\n".join(parts)


SQL["comparison_of_fixed_results"] = PREP + PERS + ",\n" + _reg_metrics("pers", "region") + f""",
res AS (SELECT row_number() OVER (ORDER BY region) AS ordre, region AS modele, {R2} AS r2, sqrt(sse / n) AS rmse, mae FROM agg WHERE region IS NOT NULL)
SELECT {i64('ordre')} AS ordre, modele, {r6('ordre * 0.5')} AS temps_secondes, {r6('r2')} AS R2, {r6('rmse')} AS RMSE, {r6('mae')} AS MAE,
       (r2 IS NOT NULL AND ordre = first_value(ordre) OVER (ORDER BY r2 DESC NULLS LAST, ordre)) AS meilleur,
       CASE WHEN r2 > 0.99 THEN 'possible_leak' WHEN r2 > 0.8 THEN 'very_good' WHEN r2 > 0.65 THEN 'good' ELSE '' END AS verdict
FROM res"""

SQL["group_metrics_regression"] = PREP + PERS + "\n" + _groups_reg()
SQL["group_metrics_classification"] = PREP + PERS + "\n" + _groups_cls()

SQL["residual_histogram"] = PREP + PERS + f""",
v AS (SELECT residu AS v FROM pers WHERE residu IS NOT NULL),
st AS (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
              CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM v),
c AS (SELECT least(CAST(floor((v - lo) / ((hi - lo) / 50.0)) AS INTEGER), 49) AS bin, count(*) AS n
      FROM v CROSS JOIN st GROUP BY 1),
dim AS (SELECT CAST(range AS INTEGER) AS bin FROM range(50))
SELECT {i64('dim.bin')} AS bin, {r6('lo + dim.bin * (hi - lo) / 50.0')} AS borne_basse,
       {r6('lo + (dim.bin + 1) * (hi - lo) / 50.0')} AS borne_haute, {i64('coalesce(c.n, 0)')} AS n
FROM dim CROSS JOIN st LEFT JOIN c ON dim.bin = c.bin"""

SQL["class_counts"] = PREP + PERS + f"""
SELECT serie, {i64('classe')} AS classe, {i64('count(*)')} AS n FROM (
  SELECT 'reel' AS serie, alerte_pollution AS classe FROM pers
  UNION ALL SELECT 'predit', alerte_pred FROM pers) GROUP BY 1, 2"""


# --- J / D7, D8, D10 ----------------------------------------------------------

def _trend_sql(series_cte: str, labels: list[str] | None, clamp: bool = True, horizon: int = 7) -> str:
    """J1 oracle: series_cte defines d(ville, date, y) with one row per observed day."""
    step = "greatest(0.0, least(100.0, {x}))" if clamp else "({x})"
    lvl = bands("prediction", labels) if labels else "CAST(NULL AS VARCHAR)"
    return series_cte + f""",
st AS (SELECT ville, count(*) AS n, min(date) AS d0, max(date) AS d1 FROM d GROUP BY ville HAVING count(*) >= 7),
cal AS (SELECT ville, d0, d1, CAST(unnest(generate_series(greatest(d0, d1 - 13), d1, INTERVAL 1 DAY)) AS DATE) AS date
        FROM st),
pv AS (SELECT c.ville, c.date, c.d0, c.d1, p.date AS pd, p.y AS pv
       FROM cal c ASOF LEFT JOIN d p ON c.ville = p.ville AND c.date >= p.date),
nx AS (SELECT c.*, n.date AS nd, n.y AS nv
       FROM pv c ASOF LEFT JOIN d n ON c.ville = n.ville AND n.date >= c.date),
iv AS (SELECT ville, date, d0, d1,
              CASE WHEN pd = date THEN pv WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv
                   ELSE (nv - pv) / CAST(datediff('day', pd, nd) AS DOUBLE) * CAST(datediff('day', pd, date) AS DOUBLE) + pv
              END AS y,
              row_number() OVER (PARTITION BY ville ORDER BY date DESC) AS rk
       FROM nx),
tbase AS (SELECT ville, any_value(d1) AS d1,
                sum(y) FILTER (WHERE rk <= 7) / 7.0 AS s0,
                CASE WHEN datediff('day', any_value(d0), any_value(d1)) + 1 >= 14
                     THEN sum(y) FILTER (WHERE rk > 7 AND rk <= 14) / 7.0
                     ELSE sum(y) FILTER (WHERE rk <= 7) / 7.0 END AS p0
         FROM iv GROUP BY ville),
rec AS (
  SELECT ville, d1, 1 AS k, (s0 - p0) / 7.0 AS drift, {step.format(x='s0 + (s0 - p0) / 7.0')} AS c FROM tbase
  UNION ALL
  SELECT ville, d1, k + 1, drift, {step.format(x='c + drift')} FROM rec WHERE k < {horizon}
),
fc AS (SELECT ville, CAST(d1 + k AS DATE) AS date, c AS prediction FROM rec)"""


def _rec(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


OBS_SERIES = """,
d AS (SELECT ville, date, avg(proxy_pm25) AS y FROM obs
      WHERE date IS NOT NULL AND proxy_pm25 IS NOT NULL AND ville IS NOT NULL GROUP BY ville, date)"""

EV_SERIES = """WITH d AS (SELECT CAST(user_id AS VARCHAR) AS ville, CAST(ts AS DATE) AS date, avg(value) AS y
      FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2)"""

FC_SELECT = "SELECT ville, date, {p} AS prediction, {lvl} AS niveau FROM fc"

SQL["forecast_trend"] = _rec(PREP + _trend_sql(OBS_SERIES, PROXY_LABELS) + "\n" + FC_SELECT.format(
    p=r6("prediction"), lvl=bands("prediction", PROXY_LABELS)))

SQL["forecast_trend_events"] = _rec(_trend_sql(EV_SERIES, RISK_LABELS) + "\n" + FC_SELECT.format(
    p=r6("prediction"), lvl=bands("prediction", RISK_LABELS)))

SQL["forecast_trend_fixed_events"] = _rec(_trend_sql(EV_SERIES, PROXY_LABELS) + "\n" + FC_SELECT.format(
    p=r6("prediction"), lvl=bands("prediction", PROXY_LABELS)))

SQL["forecast_worst_days"] = _rec(PREP + _trend_sql(OBS_SERIES, PROXY_LABELS) + f""",
w AS (SELECT *, row_number() OVER (PARTITION BY ville ORDER BY prediction DESC NULLS LAST, date) AS rang FROM fc)
SELECT ville, date, {r6('prediction')} AS prediction, {bands('prediction', PROXY_LABELS)} AS niveau,
       {i64('rang')} AS rang FROM w WHERE rang <= 3""")

SQL["densify_daily"] = PREP + f""",
d AS (SELECT ville, date, avg(proxy_pm25) AS y FROM obs
      WHERE date IS NOT NULL AND ville IS NOT NULL GROUP BY ville, date HAVING avg(proxy_pm25) IS NOT NULL),
st AS (SELECT ville, min(date) AS d0, max(date) AS d1 FROM d GROUP BY ville),
cal AS (SELECT ville, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS date FROM st),
pv AS (SELECT c.ville, c.date, p.date AS pd, p.y AS pv
       FROM cal c ASOF LEFT JOIN d p ON c.ville = p.ville AND c.date >= p.date),
nx AS (SELECT c.*, n.date AS nd, n.y AS nv
       FROM pv c ASOF LEFT JOIN d n ON c.ville = n.ville AND n.date >= c.date)
SELECT ville, date,
       {r6("CASE WHEN pd = date THEN pv WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv ELSE (nv - pv) / CAST(datediff('day', pd, nd) AS DOUBLE) * CAST(datediff('day', pd, date) AS DOUBLE) + pv END")} AS proxy_pm25,
       NOT (pd = date) AS interpole
FROM nx"""

PROJ = ["temp_max", "temp_min", "temp_moy", "ressenti_max", "point_rosee_moy", "humidite_moy", "pression_mer_moy",
        "hauteur_couche_limite_moy", "vitesse_vent_max", "direction_vent", "rafales_max", "precipitation",
        "rayonnement_court_total", "duree_jour", "duree_ensoleillement"]

SQL["last_valid_values"] = PREP + "\nSELECT ville, " + ", ".join(
    f"{r6(f'last({c} ORDER BY date ASC NULLS LAST, identifiant) FILTER (WHERE {c} IS NOT NULL)')} AS {c}"
    for c in PROJ) + " FROM obs WHERE ville IS NOT NULL GROUP BY ville"

LONG = f""",
lg AS (SELECT ville, date, identifiant, colonne, CAST(valeur AS DOUBLE) AS valeur FROM (
         UNPIVOT (SELECT ville, date, identifiant, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in PROJ)} FROM obs)
         ON {", ".join(PROJ)} INTO NAME colonne VALUE valeur)),
lr AS (SELECT *, row_number() OVER (PARTITION BY ville, colonne ORDER BY date DESC NULLS FIRST, identifiant DESC) AS rn
       FROM lg),
arrs AS (SELECT ville, colonne, list(valeur ORDER BY rn DESC) AS a FROM lr WHERE rn <= 14 GROUP BY ville, colonne)"""


def _slope(a: str) -> str:
    return (f"(CASE WHEN len({a}) >= 14 THEN (list_sum(list_slice({a}, len({a}) - 6, len({a}))) / 7.0 "
            f"- list_sum(list_slice({a}, len({a}) - 13, len({a}) - 7)) / 7.0) / 7.0 "
            f"WHEN len({a}) >= 2 THEN ({a}[len({a})] - {a}[1]) / (len({a}) - 1) ELSE 0.0 END)")


SQL["recent_slopes"] = PREP + LONG + f"""
SELECT ville, colonne, {r6(_slope('a'))} AS pente FROM arrs"""

_RULES = {"humidite_moy": "percent", "direction_vent": "angle", "vitesse_vent_max": "nonneg", "rafales_max": "nonneg",
          "precipitation": "nonneg", "rayonnement_court_total": "nonneg", "duree_jour": "nonneg",
          "duree_ensoleillement": "nonneg", "hauteur_couche_limite_moy": "nonneg"}


def _bound(v: str) -> str:
    return (f"(CASE WHEN rule = 'percent' THEN greatest(0.0, least(100.0, {v})) "
            f"WHEN rule = 'angle' THEN {pmod360(v)} WHEN rule = 'nonneg' THEN greatest(0.0, {v}) ELSE {v} END)")


_NEXT = _bound(f"((CASE WHEN len(s) > 0 THEN s[len(s)] ELSE 0.0 END) + {_slope('s')})")

SQL["covariate_projection"] = _rec(PREP + LONG + f""",
elig AS (SELECT ville FROM obs WHERE ville IS NOT NULL GROUP BY ville HAVING count(*) >= 14),
grid AS (SELECT e.ville, c.colonne,
                CASE {" ".join(f"WHEN c.colonne = '{k}' THEN '{v}'" for k, v in _RULES.items())} ELSE 'none' END AS rule
         FROM elig e CROSS JOIN (SELECT unnest([{", ".join(f"'{c}'" for c in PROJ)}]) AS colonne) c),
g0 AS (SELECT grid.ville, grid.colonne, grid.rule, coalesce(arrs.a, CAST([] AS DOUBLE[])) AS s
       FROM grid LEFT JOIN arrs ON grid.ville = arrs.ville AND grid.colonne = arrs.colonne),
rec AS (
  SELECT ville, colonne, rule, 0 AS pas, s, CAST(NULL AS DOUBLE) AS v FROM g0
  UNION ALL
  SELECT ville, colonne, rule, pas + 1,
         list_slice(list_append(s, nv), greatest(len(s) - 12, 1), greatest(len(s) - 12, 1) + 13), nv
  FROM (SELECT *, {_NEXT} AS nv FROM rec WHERE pas < 7)
)
SELECT ville, colonne, {i64('pas')} AS pas, {r6('v')} AS valeur FROM rec WHERE pas > 0""")


SQL["landed_observations"] = SQL["source_observations"]

SQL["api_payload"] = _rec(PREP + _trend_sql(OBS_SERIES, PROXY_LABELS) + f""",
k AS (SELECT strftime(max(date), '%Y-%m-%dT%H:%M:%S') AS latest_data_date,
             {pyround('CAST(avg(proxy_pm25) AS DOUBLE)', 2)} AS proxy_pm25_mean,
             {pyround('CAST(avg(alerte_pollution) AS DOUBLE) * 100.0', 2)} AS alert_days_pct,
             CAST(count(DISTINCT ville) AS BIGINT) AS cities, CAST(count(DISTINCT region) AS BIGINT) AS regions,
             {pyround('CAST(avg(proxy_pm25) AS DOUBLE)', 2)} AS target_mean FROM obs)
SELECT fc.ville, k.latest_data_date, {r6('k.proxy_pm25_mean')} AS proxy_pm25_mean, {r6('k.alert_days_pct')} AS alert_days_pct,
       k.cities, k.regions, {r6('k.target_mean')} AS target_mean, {r6(pyround('p.seuil', 2))} AS threshold_alert,
       strftime(fc.date, '%Y-%m-%d') AS date, {r6('fc.prediction')} AS prediction,
       {bands('fc.prediction', PROXY_LABELS)} AS niveau, 'projection_tendance' AS forecast_source,
       'proxy_pm25' AS target_name, 'Proxy PM2.5' AS target_label, 'regression' AS task_type
FROM fc CROSS JOIN k CROSS JOIN params p""")


# --- J4: future feature rows ---------------------------------------------------

_CARRIED = ["identifiant", "region", "latitude", "longitude", "zone_climatique", "categorie_meteo",
            "cutoff", "proxy_pm25", "indice_stagnation", "score_risque", "alerte_pollution", "niveau_alerte"]
_LAGV = LAG_VARS


def _future_sql(horizon: int = 7) -> str:
    proj_cols = ", ".join(f"max(v) FILTER (WHERE colonne = '{c}') AS {c}" for c in PROJ)
    lag_exprs = ", ".join(
        [f"lag({v}, 1) OVER w AS {v}_lag1" for v in _LAGV] + [f"lag({v}, 7) OVER w AS {v}_lag7" for v in _LAGV]
        + [f"avg({v}) OVER w7 AS {v}_moy7j" for v in _LAGV])
    cov = SQL["covariate_projection"]
    cov_ctes = cov[cov.index("WITH RECURSIVE ") + len("WITH RECURSIVE "):cov.rindex("\nSELECT ville, colonne,")]
    return "WITH RECURSIVE " + cov_ctes + f""",
pw AS (SELECT ville, pas, {proj_cols} FROM rec WHERE pas > 0 GROUP BY ville, pas),
hist AS (SELECT o.* FROM obs o WHERE o.ville IN (SELECT ville FROM elig)),
hr AS (SELECT *, row_number() OVER (PARTITION BY ville ORDER BY date DESC NULLS LAST, identifiant DESC) AS rn FROM hist),
lastrow AS (SELECT * FROM hr WHERE rn = 1),
s_cm AS (SELECT ville, mois, saison, count(*) AS n FROM hist WHERE saison IS NOT NULL GROUP BY ville, mois, saison),
s_bm AS (SELECT ville, mois, saison AS saison_mois FROM (
           SELECT *, row_number() OVER (PARTITION BY ville, mois ORDER BY n DESC, saison) AS r FROM s_cm) WHERE r = 1),
s_ov AS (SELECT ville, saison AS saison_mode FROM (
           SELECT ville, saison, row_number() OVER (PARTITION BY ville ORDER BY sum(n) DESC, saison) AS r
           FROM s_cm GROUP BY ville, saison) WHERE r = 1),
s_la AS (SELECT ville, last(saison ORDER BY date ASC NULLS LAST, identifiant) AS saison_derniere
         FROM hist WHERE saison IS NOT NULL GROUP BY ville),
fut0 AS (
  SELECT l.ville, pw.pas, CAST(l.date + CAST(pw.pas AS INTEGER) AS DATE) AS date,
         {", ".join(f"l.{c}" for c in _CARRIED)}, {", ".join(f"pw.{c}" for c in PROJ)}
  FROM lastrow l JOIN pw ON l.ville = pw.ville),
fut1 AS (
  SELECT f.*, CAST(year(f.date) AS INTEGER) AS annee, CAST(month(f.date) AS INTEGER) AS mois,
         CAST(dayofyear(f.date) AS INTEGER) AS jour_annee, CAST(quarter(f.date) AS INTEGER) AS trimestre,
         CAST(isodow(f.date) - 1 AS INTEGER) AS jour_semaine
  FROM fut0 f),
fut2 AS (
  SELECT f.*, coalesce(bm.saison_mois, la.saison_derniere, ov.saison_mode) AS saison,
         sin(2 * pi() * f.mois / 12.0) AS mois_sin, cos(2 * pi() * f.mois / 12.0) AS mois_cos,
         sin(radians(f.direction_vent)) AS vent_sin, cos(radians(f.direction_vent)) AS vent_cos,
         f.temp_moy - f.point_rosee_moy AS ecart_point_rosee,
         f.rafales_max / (f.vitesse_vent_max + 0.1) AS ratio_rafales,
         f.pression_mer_moy - 1013.25 AS pression_anomalie,
         f.temp_max - f.ressenti_max AS ecart_ressenti,
         f.duree_ensoleillement / (f.duree_jour + 0.01) AS ratio_ensoleillement
  FROM fut1 f LEFT JOIN s_bm bm ON f.ville = bm.ville AND f.mois = bm.mois
       LEFT JOIN s_la la ON f.ville = la.ville LEFT JOIN s_ov ov ON f.ville = ov.ville),
sq AS (SELECT ville, date, 0 AS pas, {", ".join(_LAGV)} FROM hr WHERE rn <= 7
       UNION ALL SELECT ville, date, pas, {", ".join(_LAGV)} FROM fut2),
lg2 AS (SELECT ville, pas, {lag_exprs} FROM sq
        WINDOW w AS (PARTITION BY ville ORDER BY date, pas),
               w7 AS (PARTITION BY ville ORDER BY date, pas ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
fut AS (SELECT f.*, g.* EXCLUDE (ville, pas) FROM fut2 f JOIN lg2 g ON f.ville = g.ville AND f.pas = g.pas)"""


_FUT_DBL = [c for c in OBS_DBL]
_FUT_INT = ["mois", "annee", "trimestre", "jour_semaine", "jour_annee", "alerte_pollution"]

SQL["future_features"] = _future_sql() + f"""
SELECT f.identifiant, f.date, {", ".join(f"f.{c}" for c in OBS_STR)},
       {", ".join(f"{i64(f'f.{c}')} AS {c}" for c in _FUT_INT)},
       {", ".join(f"{r6(f'f.{c}')} AS {c}" for c in _FUT_DBL)},
       {i64('f.cutoff')} AS _cutoff, {r6('p.seuil')} AS _seuil, {i64('f.pas')} AS pas
FROM fut f CROSS JOIN params p"""

SQL["outcome_counts"] = PREP + PERS + f"""
SELECT 'correct' AS resultat, {i64("count(*) FILTER (WHERE alerte_pollution = alerte_pred)")} AS n FROM pers
WHERE alerte_pollution IS NOT NULL AND alerte_pred IS NOT NULL
UNION ALL
SELECT 'wrong', {i64("count(*) FILTER (WHERE alerte_pollution <> alerte_pred)")} FROM pers
WHERE alerte_pollution IS NOT NULL AND alerte_pred IS NOT NULL"""

_REGION_RES = PREP + PERS + ",\n" + _reg_metrics("pers", "region") + f""",
res AS (SELECT row_number() OVER (ORDER BY region) AS ordre, region AS modele, {R2} AS r2, sqrt(sse / n) AS rmse, mae FROM agg WHERE region IS NOT NULL)"""

SQL["best_candidate"] = _REGION_RES + f""",
twice AS (SELECT ordre, modele, r2 FROM res UNION ALL SELECT ordre + 100, modele || ' bis', r2 FROM res)
SELECT {i64('ordre')} AS ordre, modele, {r6('r2')} AS score FROM twice ORDER BY r2 DESC NULLS LAST, ordre LIMIT 1"""

SQL["run_summary"] = _REGION_RES + MODEL_FRAME + f""",
best AS (SELECT modele, r2 FROM res ORDER BY r2 DESC NULLS LAST, ordre LIMIT 1),
sides AS (SELECT count(*) FILTER (WHERE split = 'train') AS tr, count(*) FILTER (WHERE split = 'test') AS te FROM mf)
SELECT 'proxy_pm25' AS target, 'regression' AS task_type, 'R2' AS metric_cle, {i64('sides.tr')} AS train_rows, {i64('sides.te')} AS test_rows,
       {i64(str(len(NUMS) + len(CATS)))} AS n_features, best.modele AS nom, {r6('best.r2')} AS score, 'MAE,R2,RMSE' AS metriques,
       'comparaison_modeles,predictions_test' AS fichiers, {i64('ordre')} AS ordre, res.modele AS modele, {r6('ordre * 0.5')} AS temps_secondes,
       {r6('res.r2')} AS R2, {r6('rmse')} AS RMSE, {r6('mae')} AS MAE,
       (res.r2 IS NOT NULL AND ordre = first_value(ordre) OVER (ORDER BY res.r2 DESC NULLS LAST, ordre)) AS meilleur,
       CASE WHEN res.r2 > 0.99 THEN 'possible_leak' WHEN res.r2 > 0.8 THEN 'very_good' WHEN res.r2 > 0.65 THEN 'good' ELSE '' END AS verdict
FROM res CROSS JOIN best CROSS JOIN sides"""

SQL["stop_rule"] = PREP.replace("WITH ", "WITH RECURSIVE ", 1) + PERS + f""",
loss AS (SELECT row_number() OVER (ORDER BY date) AS tour, {r6('avg((proxy_pm25 - prediction) * (proxy_pm25 - prediction))')} AS perte
         FROM pers WHERE date IS NOT NULL GROUP BY date),
walk AS (
  SELECT tour, perte, perte AS low, tour AS lead, false AS stopped FROM loss WHERE tour = 1
  UNION ALL
  SELECT l.tour, l.perte, least(w.low, l.perte), CASE WHEN l.perte < w.low THEN l.tour ELSE w.lead END,
         w.stopped OR l.tour - (CASE WHEN l.perte < w.low THEN l.tour ELSE w.lead END) >= 20
  FROM walk w JOIN loss l ON l.tour = w.tour + 1),
kept AS (SELECT coalesce((SELECT lead FROM walk WHERE stopped ORDER BY tour LIMIT 1), (SELECT max(lead) FROM walk)) AS k)
SELECT {i64('tour')} AS tour, {r6('perte')} AS perte, {i64('lead')} AS meilleur_tour, {i64('tour - lead')} AS sans_gain, stopped AS arrete, tour <= k AS garde
FROM walk CROSS JOIN kept"""

SQL["artefact_override"] = PREP + MODEL_FRAME + f""",
stored AS (SELECT median(proxy_pm25) AS t FROM mf WHERE split = 'train'),
flag AS (SELECT o.*, coalesce(CAST(o.proxy_pm25 >= t AS INTEGER), 0) AS own FROM obs o CROSS JOIN stored)
SELECT {i64('identifiant')} AS identifiant, date, ville, {r6('proxy_pm25')} AS proxy_pm25, {i64('own')} AS alerte_pollution,
       CASE own WHEN 0 THEN 'Pas d''alerte' WHEN 1 THEN 'Alerte' END AS niveau_alerte FROM flag"""

SQL["slice_by_tables"] = PREP + f""",
per AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1),
ys AS (SELECT y FROM per WHERE n >= (SELECT avg(n) FROM per)),
cs AS (SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)),
rs AS (SELECT r_name FROM region WHERE r_regionkey <= 2)
SELECT {i64('identifiant')} AS identifiant, date, ville, region, {i64('annee')} AS annee, {r6('proxy_pm25')} AS proxy_pm25
FROM obs WHERE annee IN (SELECT y FROM ys) AND ville IN (SELECT n_name FROM cs) AND region IN (SELECT r_name FROM rs)"""

SQL["linear_forecast"] = _future_sql() + MODEL_FRAME + f""",
lm AS (SELECT median(temp_max) AS m1, median(humidite_moy) AS m2 FROM mf WHERE split = 'train'),
lx AS (SELECT coalesce(temp_max, m1) AS x1, coalesce(humidite_moy, m2) AS x2, proxy_pm25 AS y FROM mf CROSS JOIN lm WHERE split = 'train'),
ls AS (SELECT avg(x1) AS a1, avg(x2) AS a2, CASE WHEN stddev_pop(x1) = 0 THEN 1.0 ELSE stddev_pop(x1) END AS s1,
              CASE WHEN stddev_pop(x2) = 0 THEN 1.0 ELSE stddev_pop(x2) END AS s2, avg(y) AS ym FROM lx),
lz AS (SELECT (x1 - a1) / s1 AS z1, (x2 - a2) / s2 AS z2, y - ym AS yc FROM lx CROSS JOIN ls),
le AS (SELECT sum(z1 * z1) + 1 AS p, sum(z1 * z2) AS q, sum(z2 * z2) + 1 AS r, sum(z1 * yc) AS b1, sum(z2 * yc) AS b2 FROM lz),
lw AS (SELECT (b1 * r - b2 * q) / (p * r - q * q) AS w1, (p * b2 - q * b1) / (p * r - q * q) AS w2 FROM le),
lp AS (SELECT f.ville, f.date, {clip('ym + w1 * ((coalesce(f.temp_max, m1) - a1) / s1) + w2 * ((coalesce(f.humidite_moy, m2) - a2) / s2)', 0.0, 100.0)} AS v
       FROM fut f CROSS JOIN lm CROSS JOIN ls CROSS JOIN lw)
SELECT ville, date, {rnd('v', 3)} AS prediction, {bands('v', PROXY_LABELS)} AS niveau FROM lp"""
