"""Shared CTEs: the observation adapter and the prepared observation table.

``PREP`` ends with the CTE ``obs`` (prepared observations, working column
names) and ``params`` (one row: cutoff, seuil).  Queries append
``, name AS (...)`` CTEs and a final SELECT.
"""

from __future__ import annotations


def r6(x: str) -> str:
    """Hash-safe rounding: half-even at 6 decimals on a DOUBLE, -0.0 -> 0.0."""
    return f"(round_even(CAST({x} AS DOUBLE) * 1000000.0, 0) / 1000000.0 + 0.0)"


def rnd(x: str, n: int) -> str:
    """pandas ``round(n)``: scale, half-even, unscale."""
    s = f"{10.0 ** n!r}"
    return f"(round_even(CAST({x} AS DOUBLE) * {s}, 0) / {s} + 0.0)"


def pyround(x: str, n: int) -> str:
    """Python round(x, n): the decimal text of the exact binary value, read back."""
    return f"(CASE WHEN ({x}) IS NOT NULL THEN CAST(printf('%.{n}f', CAST({x} AS DOUBLE)) AS DOUBLE) + 0.0 END)"


def i64(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def clip01(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) < 0 THEN 0.0 WHEN ({x}) > 1 THEN 1.0 ELSE ({x}) END)"


def clip(x: str, lo: float, hi: float) -> str:
    return (f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) < {lo} THEN {lo} "
            f"WHEN ({x}) > {hi} THEN {hi} ELSE ({x}) END)")


def bands(x: str, labels: list[str]) -> str:
    """Right-closed bands 0/30/50/70/100, lowest edge included."""
    a, b, c, d = [lab.replace("'", "''") for lab in labels]
    return (f"(CASE WHEN ({x}) >= 0 AND ({x}) <= 30 THEN '{a}' WHEN ({x}) > 30 AND ({x}) <= 50 THEN '{b}' "
            f"WHEN ({x}) > 50 AND ({x}) <= 70 THEN '{c}' WHEN ({x}) > 70 AND ({x}) <= 100 THEN '{d}' END)")


def band_ord(x: str) -> str:
    return (f"(CASE WHEN ({x}) >= 0 AND ({x}) <= 30 THEN 1 WHEN ({x}) > 30 AND ({x}) <= 50 THEN 2 "
            f"WHEN ({x}) > 50 AND ({x}) <= 70 THEN 3 WHEN ({x}) > 70 AND ({x}) <= 100 THEN 4 END)")


PROXY_LABELS = ["Bon", "Modéré", "Mauvais", "Dangereux"]
RISK_LABELS = ["Faible", "Modéré", "Élevé", "Critique"]
REGION_LABELS = ["Vert", "Jaune", "Orange", "Rouge"]


def _norm(x: str, name: str) -> str:
    lo, hi = f"p.{name}_min", f"p.{name}_max"
    return (f"(CASE WHEN ({hi} - {lo}) IS NULL OR ({hi} - {lo}) = 0 THEN 0.5 "
            f"ELSE {clip01(f'(({x}) - {lo}) / ({hi} - {lo})')} END)")


ADAPTER = """
src AS (
  SELECT n.n_nationkey AS nk, n.n_name AS nname, n.n_regionkey AS rk, r.r_name AS rname,
         CAST(o.o_orderdate AS DATE) AS d,
         min(o.o_orderkey) AS id, count(*) AS cnt,
         max(l.l_quantity) AS qmax, min(l.l_quantity) AS qmin,
         min(l.l_linenumber) AS lnmin, sum(l.l_linenumber) AS lnsum,
         sum(l.l_orderkey + l.l_partkey) AS okpk, sum(l.l_suppkey) AS sksum,
         min(l.l_partkey) AS pkmin, max(l.l_partkey) AS pkmax, sum(l.l_partkey) AS pksum
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN lineitem l ON l.l_orderkey = o.o_orderkey
  GROUP BY 1, 2, 3, 4, 5
),
raw AS (
  SELECT CAST(id AS BIGINT) AS identifiant, d AS date, nname AS ville, rname AS region,
         CAST(nk - 12 AS DOUBLE) AS latitude, CAST(rk * 5 AS DOUBLE) AS longitude,
         'zone_' || CAST(nk % 3 AS VARCHAR) AS zone_climatique,
         CAST(month(d) AS INTEGER) AS mois, CAST(year(d) AS INTEGER) AS annee,
         CAST(quarter(d) AS INTEGER) AS trimestre,
         CASE WHEN month(d) IN (11, 12, 1, 2, 3) THEN 'seche' ELSE 'pluies' END AS saison,
         CAST(isodow(d) - 1 AS INTEGER) AS jour_semaine,
         15.0 + qmax / 2 AS temp_max, 5.0 + qmin / 2 AS temp_min,
         ((15.0 + qmax / 2) + (5.0 + qmin / 2)) / 2 AS temp_moy,
         (15.0 + qmax / 2) - CAST(cnt % 5 AS DOUBLE) AS ressenti_max,
         CAST(lnmin * 2 AS DOUBLE) AS point_rosee_moy,
         CAST(NULLIF(okpk % 101, 50) AS DOUBLE) AS humidite_moy,
         CAST(1000 + sksum % 30 AS DOUBLE) AS pression_mer_moy,
         CAST(200 + sksum % 1500 AS DOUBLE) AS hauteur_couche_limite_moy,
         CAST(pkmin % 40 AS DOUBLE) AS vitesse_vent_max,
         CAST(pkmin % 40 + pkmax % 20 AS DOUBLE) AS rafales_max,
         CAST(pksum % 1441 AS DOUBLE) / 2 - 360 AS direction_vent,
         CASE WHEN cnt % 3 = 0 THEN 0.0 ELSE CAST(lnsum AS DOUBLE) END AS precipitation,
         CAST(pksum % 30 AS DOUBLE) AS rayonnement_court_total,
         CAST(43200 + 60 * (dayofyear(d) % 60) AS DOUBLE) AS duree_jour_s,
         CAST(3600 * (cnt % 12) AS DOUBLE) AS duree_ensoleillement_s,
         CASE WHEN cnt % 7 = 0 THEN NULL ELSE 'cat_' || CAST(cnt % 4 AS VARCHAR) END AS categorie_meteo
  FROM src
)"""

FEATURES = """
units AS (
  SELECT median(duree_jour_s) AS med_dj, median(duree_ensoleillement_s) AS med_de FROM raw
),
base AS (
  SELECT r.* EXCLUDE (duree_jour_s, duree_ensoleillement_s),
         CASE WHEN u.med_dj > 100 THEN r.duree_jour_s / 3600.0 ELSE r.duree_jour_s END AS duree_jour,
         CASE WHEN u.med_de > 100 THEN r.duree_ensoleillement_s / 3600.0 ELSE r.duree_ensoleillement_s END
           AS duree_ensoleillement,
         CAST(dayofyear(r.date) AS INTEGER) AS jour_annee
  FROM raw r CROSS JOIN units u
),
feat AS (
  SELECT *,
         sin(2 * pi() * mois / 12.0) AS mois_sin, cos(2 * pi() * mois / 12.0) AS mois_cos,
         sin(radians(direction_vent)) AS vent_sin, cos(radians(direction_vent)) AS vent_cos,
         temp_moy - point_rosee_moy AS ecart_point_rosee,
         rafales_max / (vitesse_vent_max + 0.1) AS ratio_rafales,
         pression_mer_moy - 1013.25 AS pression_anomalie,
         temp_max - ressenti_max AS ecart_ressenti,
         duree_ensoleillement / (duree_jour + 0.01) AS ratio_ensoleillement,
         lag(temp_max, 1) OVER w AS temp_max_lag1,
         lag(precipitation, 1) OVER w AS precipitation_lag1,
         lag(vitesse_vent_max, 1) OVER w AS vitesse_vent_max_lag1,
         lag(humidite_moy, 1) OVER w AS humidite_moy_lag1,
         lag(hauteur_couche_limite_moy, 1) OVER w AS hauteur_couche_limite_moy_lag1,
         lag(temp_max, 7) OVER w AS temp_max_lag7,
         lag(precipitation, 7) OVER w AS precipitation_lag7,
         lag(vitesse_vent_max, 7) OVER w AS vitesse_vent_max_lag7,
         lag(humidite_moy, 7) OVER w AS humidite_moy_lag7,
         lag(hauteur_couche_limite_moy, 7) OVER w AS hauteur_couche_limite_moy_lag7,
         avg(temp_max) OVER w7 AS temp_max_moy7j,
         avg(precipitation) OVER w7 AS precipitation_moy7j,
         avg(vitesse_vent_max) OVER w7 AS vitesse_vent_max_moy7j,
         avg(humidite_moy) OVER w7 AS humidite_moy_moy7j,
         avg(hauteur_couche_limite_moy) OVER w7 AS hauteur_couche_limite_moy_moy7j
  FROM base
  WINDOW w AS (PARTITION BY ville ORDER BY date ASC NULLS LAST, identifiant),
         w7 AS (PARTITION BY ville ORDER BY date ASC NULLS LAST, identifiant
                ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
)"""

_INPUTS = [("vitesse_vent_max", "vitesse_vent_max"),
           ("hauteur_couche_limite_moy", "hauteur_couche_limite_moy"),
           ("precipitation", "ln(1 + precipitation)"),
           ("temp_max", "temp_max"),
           ("humidite_moy", "humidite_moy"),
           ("rayonnement_court_total", "rayonnement_court_total")]


def _index_params() -> str:
    mins = ",\n         ".join(f"CAST(min({x}) AS DOUBLE) AS {n}_min, CAST(max({x}) AS DOUBLE) AS {n}_max"
                               for n, x in _INPUTS)
    return f"""
cut AS (SELECT max(annee) - 1 AS cutoff FROM feat),
bounds AS (
  SELECT {mins}
  FROM feat CROSS JOIN cut WHERE annee <= cutoff
)"""


def _proxy() -> str:
    t = {n: _norm(x, n) for n, x in _INPUTS}
    proxy = (f"((((( 0.25 * (1.0 - {t['vitesse_vent_max']}) + 0.2 * (1.0 - {t['hauteur_couche_limite_moy']}))"
             f" + 0.15 * (1.0 - {t['precipitation']})) + 0.15 * {t['temp_max']})"
             f" + 0.15 * (1.0 - {t['humidite_moy']})) + 0.1 * {t['rayonnement_court_total']}) * 100.0")
    stag = (f"(0.6 * (1.0 - {t['vitesse_vent_max']}) + 0.4 * (1.0 - {t['hauteur_couche_limite_moy']})) * 100.0")
    return f"""
scored AS (
  SELECT f.*, c.cutoff, {proxy} AS proxy_pm25, {stag} AS indice_stagnation
  FROM feat f CROSS JOIN cut c CROSS JOIN bounds p
),
thr AS (SELECT quantile_cont(proxy_pm25, 0.8) AS seuil FROM scored WHERE annee <= cutoff),
obs AS (
  SELECT s.*, s.proxy_pm25 AS score_risque,
         COALESCE(CAST(s.proxy_pm25 >= t.seuil AS INTEGER), 0) AS alerte_pollution,
         {bands('s.proxy_pm25', PROXY_LABELS)} AS niveau_alerte
  FROM scored s CROSS JOIN thr t
),
params AS (SELECT c.cutoff, t.seuil FROM cut c CROSS JOIN thr t)"""


PREP = "WITH " + ADAPTER.strip() + "," + FEATURES + "," + _index_params() + "," + _proxy()
