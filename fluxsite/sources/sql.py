"""The test-data bindings and the reference semantics as plain SQL (DuckDB).

This is the independent oracle: it states each rule the way the reference
computes it -- meter rows fanned out over the occupying units, per-resource
aggregates, complete-case filters -- with none of the building-level
shortcuts of the Spark plans. Every query reads the driver's tables whole.
"""

from __future__ import annotations

# FIXED VALUES below (vocabulary, patterns, prices, shares): stated a second
# time on purpose, so that the oracle does not depend on config.py.
# Ordered CTEs; a query names the last one it needs and all are emitted
# (DuckDB plans only the referenced ones).
CTES: list[tuple[str, str]] = [
    (
        "v_rooms",
        """
SELECT CASE WHEN p_partkey % 40 < 32 THEN 'La Gaillarde' ELSE 'Lavalette' END AS Site,
       lpad(CAST(p_partkey % 40 AS VARCHAR), 4, '0') AS num_bat,
       CAST(p_partkey AS VARCHAR) AS Local,
       CAST(p_size AS DOUBLE) AS Surface_sol,
       CASE WHEN p_partkey % 23 = 0 THEN NULL
            WHEN p_partkey % 19 = 0 THEN 'IA'
            WHEN p_partkey % 29 = 0 THEN p_brand || '/B' || lpad(CAST(p_partkey * 7 % 40 AS VARCHAR), 4, '0')
            WHEN p_partkey % 13 = 0 THEN p_brand || '/Brand#' || CAST(p_size % 25 + 1 AS VARCHAR)
            WHEN p_partkey % 7 = 0 THEN lower(p_brand)
            ELSE p_brand END AS Unite,
       CASE p_partkey % 9 WHEN 0 THEN NULL
            WHEN 1 THEN 'Locaux ' || p_name
            WHEN 2 THEN replace(p_name, ' ', ', ')
            WHEN 3 THEN replace(p_name, ' ', ' et ')
            WHEN 4 THEN 'Salle ' || p_name
            WHEN 5 THEN '4 personnes'
            WHEN 6 THEN replace(p_name, ' ', ' - ')
            WHEN 7 THEN p_name || ' ?'
            ELSE p_name END AS Nom_occupants,
       CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) * 0.75 END AS Surface_ajus,
       CASE WHEN p_partkey % 11 = 0 THEN 'OUI' WHEN p_partkey % 11 = 1 THEN NULL ELSE 'NON' END AS a_supprimer
FROM part""",
    ),
    (
        "v_meters",
        """
SELECT resource, ordinal, batiment, year,
       CASE WHEN resource = 'gaz' AND ordinal % 97 = 3 AND year = 2021 THEN NULL ELSE conso END AS conso
FROM (
  SELECT list_extract(['elec', 'eau', 'gaz', 'reseau', 'fod'], CAST((l_linenumber - 1) % 5 + 1 AS INTEGER)) AS resource,
         l_suppkey AS ordinal,
         'MTP-' || CASE WHEN l_suppkey % 41 = 7 THEN 'irag'
                        WHEN l_suppkey % 43 = 5 THEN 'sage'
                        ELSE lpad(CAST(l_suppkey % 40 AS VARCHAR), 4, '0') END
                || ' compteur ' || CAST(l_suppkey AS VARCHAR) AS batiment,
         CAST(CASE WHEN l_suppkey % 8 = 3 AND year(l_shipdate) + 20 = 2018 THEN 2017
                   ELSE year(l_shipdate) + 20 END AS INTEGER) AS year,
         sum(l_quantity) AS conso
  FROM lineitem
  GROUP BY 1, 2, 3, 4)""",
    ),
    (
        "v_state",
        """
SELECT 'La Gaillarde' AS Site, printf('%04d', s_suppkey) AS num_bat, s_name AS nom_bat,
       CASE WHEN s_acctbal < 0 THEN 'Mauvais' WHEN s_acctbal < 5000 THEN 'Moyen' ELSE 'Bon' END AS etat_energie,
       s_suppkey AS ordinal
FROM supplier
UNION ALL
SELECT 'La Gaillarde', printf('%04d', s_suppkey), s_name || ' annexe', 'Annexe', s_suppkey + 1000000000000
FROM supplier WHERE s_suppkey % 7 = 3""",
    ),
    (
        "v_staff",
        """
SELECT CASE WHEN c_custkey % 31 = 0 THEN 'Associé BAP' ELSE 'BRAND#' || CAST(c_custkey % 25 + 1 AS VARCHAR) END AS Unite,
       'B' || lpad(CAST(c_custkey % 40 AS VARCHAR), 4, '0') AS Bat
FROM customer""",
    ),
    (
        "v_code_map",
        """
SELECT 'fod' AS resource, s_suppkey AS ordinal, lpad(CAST(s_suppkey % 40 AS VARCHAR), 4, '0') AS num_bat
FROM supplier""",
    ),
    # ---- occupancy ---------------------------------------------------------
    (
        "rooms_clean",
        """
SELECT *,
       CASE WHEN Nom_occupants IS NULL THEN NULL
            WHEN contains(Nom_occupants, '4 personnes') THEN 4.0
            WHEN regexp_matches(Nom_occupants, 'Locaux|véhicules|\\?|COMMUN|Salle|salle') THEN 0.0
            ELSE CAST(len(regexp_extract_all(Nom_occupants, ',|/| et | - |\\+|;')) + 1 AS DOUBLE) END AS count_pers0
FROM v_rooms WHERE a_supprimer = 'NON'""",
    ),
    (
        "occ_bld",
        """
SELECT Site, num_bat, coalesce(sum(CASE WHEN isnan(Surface_sol) THEN NULL ELSE Surface_sol END), 0.0) AS metrage_batiment
FROM rooms_clean GROUP BY Site, num_bat""",
    ),
    (
        "occ_unit",
        """
SELECT Site, num_bat, Unite,
       coalesce(sum(CASE WHEN isnan(Surface_sol) THEN NULL ELSE Surface_sol END), 0.0) AS metrage_unite,
       coalesce(sum(CASE WHEN isnan(Surface_ajus) THEN NULL ELSE Surface_ajus END), 0.0) AS metrage_unite_ajus,
       coalesce(sum(CASE WHEN isnan(count_pers0) THEN NULL ELSE count_pers0 END), 0.0) AS pers_unite
FROM rooms_clean GROUP BY Site, num_bat, Unite""",
    ),
    (
        "occ_total",
        """
SELECT u.Site, u.num_bat, u.Unite, u.metrage_unite, u.metrage_unite_ajus, u.pers_unite, b.metrage_batiment
FROM occ_unit u LEFT JOIN occ_bld b
  ON u.Site IS NOT DISTINCT FROM b.Site AND u.num_bat IS NOT DISTINCT FROM b.num_bat""",
    ),
    (
        "occ_canon",
        """
SELECT Site, num_bat,
       CASE WHEN upper(Unite) = 'SDAR MUTUALISÉ' THEN 'SDAR' ELSE upper(Unite) END AS Unite,
       metrage_unite, metrage_unite_ajus, pers_unite, metrage_batiment
FROM occ_total""",
    ),
    (
        "occ_not_in",
        """
SELECT * FROM occ_canon WHERE Unite IS NULL OR Unite NOT IN ('IA', 'IA COM', 'INRAE')""",
    ),
    (
        "occ_site",
        """
SELECT * FROM occ_not_in WHERE contains(Site, 'Gaillarde')""",
    ),
    (
        "occ_complete",
        """
SELECT * FROM occ_site
WHERE Site IS NOT NULL AND num_bat IS NOT NULL AND Unite IS NOT NULL
  AND metrage_unite IS NOT NULL AND NOT isnan(metrage_unite)
  AND metrage_unite_ajus IS NOT NULL AND NOT isnan(metrage_unite_ajus)
  AND pers_unite IS NOT NULL AND NOT isnan(pers_unite)
  AND metrage_batiment IS NOT NULL AND NOT isnan(metrage_batiment)""",
    ),
    (
        "staff_count",
        """
SELECT num_bat, Unite, count(*) AS count_pers
FROM (SELECT CASE WHEN Unite IS NULL THEN NULL WHEN Unite = 'Associé BAP' THEN '0070'
                  ELSE substring(Bat, 2, 4) END AS num_bat, Unite
      FROM v_staff)
GROUP BY num_bat, Unite""",
    ),
    (
        "occupancy",
        """
SELECT o.Site, o.num_bat, o.Unite, o.metrage_unite, o.metrage_unite_ajus, o.pers_unite, o.metrage_batiment, s.count_pers
FROM occ_complete o LEFT JOIN staff_count s ON o.num_bat = s.num_bat AND o.Unite = s.Unite""",
    ),
    # ---- meters ------------------------------------------------------------
    (
        "meters",
        """
SELECT m.resource, m.ordinal, m.batiment, m.year, m.conso,
       CASE WHEN m.resource = 'fod' THEN c.num_bat ELSE substring(m.batiment, 5, 4) END AS num_bat
FROM v_meters m LEFT JOIN v_code_map c ON m.resource = c.resource AND m.ordinal = c.ordinal""",
    ),
    (
        "latest",
        """
SELECT m.resource, m.ordinal, m.batiment, m.num_bat, m.conso AS derniere_conso
FROM meters m JOIN (SELECT resource, max(year) AS y FROM meters GROUP BY resource) l
  ON m.resource = l.resource AND m.year = l.y""",
    ),
    (
        "conso_rows",
        """
SELECT resource, ordinal, batiment, num_bat, derniere_conso FROM latest WHERE resource <> 'elec'
UNION ALL
SELECT resource, min(ordinal) AS ordinal, CAST(NULL AS VARCHAR) AS batiment, num_bat,
       coalesce(sum(CASE WHEN isnan(derniere_conso) THEN NULL ELSE derniere_conso END), 0.0) AS derniere_conso
FROM latest WHERE resource = 'elec' GROUP BY resource, num_bat""",
    ),
    (
        "conso_kept",
        """
SELECT * FROM conso_rows
WHERE NOT ((resource = 'elec' AND coalesce(num_bat IN ('irag'), false))
        OR (resource = 'eau' AND coalesce(num_bat IN ('sage'), false)))""",
    ),
    (
        "conso_state",
        """
SELECT c.*, s.Site AS Site_etat, s.nom_bat, s.etat_energie
FROM conso_kept c LEFT JOIN v_state s ON c.num_bat IS NOT DISTINCT FROM s.num_bat""",
    ),
    (
        "joined",
        """
SELECT c.*, o.Site AS Site_occup, o.Unite, o.metrage_unite, o.metrage_unite_ajus, o.pers_unite,
       o.metrage_batiment, o.count_pers
FROM conso_state c LEFT JOIN occupancy o ON c.num_bat IS NOT DISTINCT FROM o.num_bat""",
    ),
    (
        "prices",
        """
SELECT * FROM (VALUES ('elec', 0.09::DOUBLE, 1.5::DOUBLE), ('gaz', 0.07::DOUBLE, 1.5::DOUBLE),
                      ('eau', 3.5::DOUBLE, 1.0::DOUBLE), ('fod', 0.32::DOUBLE, 1.5::DOUBLE),
                      ('reseau', 0.07::DOUBLE, 1.5::DOUBLE)) AS t(resource, price, coef)""",
    ),
    (
        "alloc_ratio",
        """
SELECT j.*, CASE WHEN j.metrage_batiment = 0 THEN j.metrage_unite_ajus * 'inf'::DOUBLE
                 ELSE j.metrage_unite_ajus / j.metrage_batiment END AS ratio_metre
FROM joined j""",
    ),
    (
        "alloc_conso",
        """
SELECT a.*, a.derniere_conso * a.ratio_metre AS conso FROM alloc_ratio a""",
    ),
    (
        "alloc_cout",
        """
SELECT a.*, a.conso * p.price * p.coef AS cout FROM alloc_conso a JOIN prices p ON p.resource = a.resource""",
    ),
    (
        "allocated",
        """
SELECT *,
       CASE WHEN metrage_unite_ajus = 0 THEN cout * 'inf'::DOUBLE ELSE cout / metrage_unite_ajus END AS cout_par_m2,
       CASE WHEN count_pers = 0 THEN cout * 'inf'::DOUBLE ELSE cout / count_pers END AS cout_par_pers
FROM alloc_cout""",
    ),
    # ---- reports -------------------------------------------------------------
    (
        "unit_rows",
        """
SELECT j.resource, j.num_bat, j.Unite,
       j.derniere_conso * j.metrage_unite_ajus / j.metrage_batiment AS v,
       j.derniere_conso * j.metrage_unite_ajus / j.metrage_batiment * p.price * p.coef AS c
FROM joined j JOIN prices p ON p.resource = j.resource""",
    ),
    (
        "unit_sums",
        """
SELECT resource, Unite,
       CASE WHEN count(v) = count(*) THEN sum(v) END AS v,
       CASE WHEN count(c) = count(*) THEN sum(c) END AS c
FROM unit_rows GROUP BY resource, Unite""",
    ),
    (
        "unit_kept",
        """
SELECT * FROM unit_sums
WHERE resource = 'reseau'
   OR (Unite IS NOT NULL AND v IS NOT NULL AND NOT isnan(v) AND c IS NOT NULL AND NOT isnan(c))""",
    ),
    (
        "by_unit",
        """
SELECT Unite,
       max(CASE WHEN resource = 'elec' THEN v END) AS conso_elec_m2_kWh,
       max(CASE WHEN resource = 'elec' THEN c END) AS cout_elec,
       max(CASE WHEN resource = 'gaz' THEN v END) AS conso_gaz_m2_kWh,
       max(CASE WHEN resource = 'gaz' THEN c END) AS cout_gaz,
       max(CASE WHEN resource = 'eau' THEN v END) AS conso_eau_m2,
       max(CASE WHEN resource = 'eau' THEN c END) AS cout_eau,
       max(CASE WHEN resource = 'fod' THEN v END) AS conso_fod_m2_kWh,
       max(CASE WHEN resource = 'fod' THEN c END) AS cout_fod,
       max(CASE WHEN resource = 'reseau' THEN v END) AS conso_reseau_m2,
       max(CASE WHEN resource = 'reseau' THEN c END) AS cout_reseau
FROM unit_kept GROUP BY Unite""",
    ),
    (
        "bu_sums",
        """
SELECT resource, num_bat, Unite,
       CASE WHEN count(v) = count(*) THEN sum(v) END AS v,
       CASE WHEN count(c) = count(*) THEN sum(c) END AS c
FROM unit_rows GROUP BY resource, num_bat, Unite""",
    ),
    (
        "by_building_unit",
        """
SELECT num_bat, Unite,
       max(CASE WHEN resource = 'elec' THEN v END) AS conso_elec_m2_kWh,
       max(CASE WHEN resource = 'elec' THEN c END) AS cout_elec,
       max(CASE WHEN resource = 'gaz' THEN v END) AS conso_gaz_m2_kWh,
       max(CASE WHEN resource = 'gaz' THEN c END) AS cout_gaz,
       max(CASE WHEN resource = 'eau' THEN v END) AS conso_eau_m2,
       max(CASE WHEN resource = 'eau' THEN c END) AS cout_eau,
       max(CASE WHEN resource = 'fod' THEN v END) AS conso_fod_m2_kWh,
       max(CASE WHEN resource = 'fod' THEN c END) AS cout_fod,
       max(CASE WHEN resource = 'reseau' THEN v END) AS conso_reseau_m2,
       max(CASE WHEN resource = 'reseau' THEN c END) AS cout_reseau
FROM bu_sums WHERE Unite IS NOT NULL GROUP BY num_bat, Unite""",
    ),
    (
        "first_rows",
        """
SELECT f.resource, f.num_bat, f.derniere_conso, t.etat_energie, f.metrage_batiment FROM (
  SELECT *, row_number() OVER (PARTITION BY resource, num_bat ORDER BY ordinal, Site_occup, Unite) AS rn
  FROM joined) f
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY num_bat ORDER BY ordinal) AS rn FROM v_state) t
  ON f.num_bat IS NOT DISTINCT FROM t.num_bat AND t.rn = 1
WHERE f.rn = 1""",
    ),
    (
        "intensity",
        """
SELECT f.resource, f.num_bat, f.derniere_conso, f.metrage_batiment, f.etat_energie,
       CASE WHEN f.metrage_batiment = 0 THEN f.derniere_conso * 'inf'::DOUBLE
            ELSE f.derniere_conso / f.metrage_batiment END AS conso_m2,
       (CASE WHEN f.metrage_batiment = 0 THEN f.derniere_conso * 'inf'::DOUBLE
             ELSE f.derniere_conso / f.metrage_batiment END) * p.price * p.coef AS cout_m2
FROM first_rows f JOIN prices p ON p.resource = f.resource""",
    ),
    (
        "by_building",
        """
SELECT num_bat,
       max(CASE WHEN resource = 'elec' THEN etat_energie END) AS etat_energie,
       max(CASE WHEN resource = 'elec' THEN metrage_batiment END) AS metrage_batiment,
       max(CASE WHEN resource = 'elec' THEN conso_m2 END) AS conso_elec_m2_kWh,
       max(CASE WHEN resource = 'elec' THEN cout_m2 END) AS cout_elec,
       max(CASE WHEN resource = 'gaz' THEN conso_m2 END) AS conso_gaz_m2_kWh,
       max(CASE WHEN resource = 'gaz' THEN cout_m2 END) AS cout_gaz,
       max(CASE WHEN resource = 'eau' THEN conso_m2 END) AS conso_eau_m2,
       max(CASE WHEN resource = 'eau' THEN cout_m2 END) AS cout_eau,
       max(CASE WHEN resource = 'fod' THEN conso_m2 END) AS conso_fod_m2_kWh,
       max(CASE WHEN resource = 'fod' THEN cout_m2 END) AS cout_fod,
       max(CASE WHEN resource = 'reseau' THEN conso_m2 END) AS conso_reseau_m2,
       max(CASE WHEN resource = 'reseau' THEN cout_m2 END) AS cout_reseau
FROM intensity GROUP BY num_bat""",
    ),
]


def nz(c: str) -> str:
    """NULL/NaN as 0 (row sums that skip missing values)."""
    return f"coalesce(CASE WHEN isnan({c}) THEN NULL ELSE {c} END, 0.0)"


def members(c: str) -> str:
    return f"CAST(length({c}) - length(replace({c}, '/', '')) + 1 AS DOUBLE)"


COSTS = ["cout_elec", "cout_gaz", "cout_eau", "cout_fod", "cout_reseau"]
VALUES = ["conso_elec_m2_kWh", "conso_gaz_m2_kWh", "conso_eau_m2", "conso_fod_m2_kWh", "conso_reseau_m2"]


def row_sum(cols) -> str:
    return " + ".join(nz(c) for c in cols)


def with_ctes(final: str) -> str:
    body = ",\n".join(f"{name} AS ({sql}\n)" for name, sql in CTES)
    return f"WITH {body}\n{final}"


def kind_column(name: str) -> str:
    """Name of the column that tells what kind of double a cell is."""
    return name.strip('"') + "__kind"


def kind(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NULL THEN 'null' WHEN isnan({c}) THEN 'nan' WHEN {c} = 'inf'::DOUBLE THEN 'inf' "
        f"WHEN {c} = '-inf'::DOUBLE THEN '-inf' ELSE 'num' END"
    )


def rounded(final: str, doubles) -> str:
    """Wrap a query so its double columns are rounded to 4 decimals the way
    the Spark side rounds them (snap to 1e-9, then round(x * 1e4) / 1e4).
    NaN is not equal to itself, so a cell's kind (null, nan, inf, -inf, num)
    is a column of its own and NaN is shown as NULL beside it."""
    if not doubles:
        return with_ctes(final)
    rep = ", ".join(
        f"round(round(CASE WHEN isnan({c}) THEN NULL ELSE {c} END * 1e9) / 1e9 * 10000.0) / 10000.0 AS {c}"
        for c in doubles
    )
    kinds = ", ".join(f'{kind(c)} AS "{kind_column(c)}"' for c in doubles)
    return with_ctes(f"SELECT * REPLACE ({rep}), {kinds} FROM ({final}) AS q")
