"""The same results as plain SQL over the driver tables, for checking ``catalog``."""

from __future__ import annotations

from motorspark import catalog, views
from motorspark.functions import fixed_values as fixed


def _columns(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


V_LISTINGS = f"v_listings AS (SELECT {_columns(views.LISTINGS)} FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)"
V_RECALLS = (
    f"v_recalls AS (SELECT {_columns(views.RECALLS)} FROM orders JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey)"
)
V_TELEMATICS = f"v_telematics AS (SELECT {_columns(views.TELEMATICS)} FROM events)"
V_DOCS = "v_docs AS (SELECT doc_id, text, source FROM documents)"

_PLACES = [
    "posting_date", "price", "odometer", "VIN", "manufacturer", "model", "year", "id", "mfr_group", "type", "fuel",
    "transmission", "drive", "l_orderkey", "l_partkey", "l_linenumber", "p_size",
]
_UNKNOWN = ", ".join(f"coalesce({c}, 'unknown') AS {c}" for c in catalog.CLEANING.unknown_columns)
CLEAN = f"""{V_LISTINGS},
prepared AS (SELECT * REPLACE (CASE WHEN price > 0 THEN price END AS price, {_UNKNOWN}) FROM v_listings),
ruled AS (SELECT *, CASE WHEN price IS NULL THEN 1 WHEN NOT price BETWEEN 2000 AND 90000 THEN 2
  WHEN year IS NULL OR NOT year BETWEEN 1996 AND 2001 THEN 3
  WHEN odometer IS NULL OR NOT odometer BETWEEN 0 AND 384000 THEN 4 END AS broken FROM prepared),
by_id AS (SELECT * EXCLUDE (broken) FROM ruled WHERE broken IS NULL QUALIFY row_number() OVER (
  PARTITION BY id ORDER BY {', '.join(f'{c} DESC NULLS LAST' for c in _PLACES)}) = 1),
clean AS (SELECT * FROM by_id QUALIFY row_number() OVER (
  PARTITION BY VIN, CASE WHEN VIN IS NULL THEN manufacturer END, CASE WHEN VIN IS NULL THEN model END,
    CASE WHEN VIN IS NULL THEN year END ORDER BY posting_date DESC, id DESC) = 1)"""

_LUXURY = ", ".join(f"'{b}'" for b in catalog.LUXURY)
FEATURES = f"""{CLEAN},
top_models AS (SELECT model AS top_model FROM clean WHERE model <> 'unknown' GROUP BY model ORDER BY count(*) DESC, model LIMIT 20),
features AS (SELECT *, greatest(2001 - year, 0)::INT AS vehicle_age,
  odometer / greatest(greatest(2001 - year, 0), 1) AS miles_per_year,
  CASE WHEN manufacturer IN ({_LUXURY}) THEN 'Luxury' ELSE 'Standard' END AS brand_segment,
  coalesce(top_model, 'Other') AS model_grouped, odometer / 10000 AS odometer_10k
  FROM clean LEFT JOIN top_models ON model = top_model)"""

SQL: dict[str, str] = {}

SQL["rule_audit"] = f"""WITH {CLEAN},
steps AS (
  SELECT 1 AS step_no, 'Price missing or zero' AS step, (SELECT count(*) FROM ruled WHERE broken = 1) AS rows_removed
  UNION ALL SELECT 2, 'Price outside $2,000 - $90,000', (SELECT count(*) FROM ruled WHERE broken = 2)
  UNION ALL SELECT 3, 'Year missing or outside 1996 - 2001', (SELECT count(*) FROM ruled WHERE broken = 3)
  UNION ALL SELECT 4, 'Odometer missing or outside 0 - 384,000 miles', (SELECT count(*) FROM ruled WHERE broken = 4)
  UNION ALL SELECT 5, 'Exact duplicate rows / duplicate ad IDs',
    (SELECT count(*) FROM ruled WHERE broken IS NULL) - (SELECT count(*) FROM by_id)
  UNION ALL SELECT 6, 'Same vehicle listed again (duplicate VIN)',
    (SELECT count(*) FROM by_id WHERE VIN IS NOT NULL) - (SELECT count(*) FROM clean WHERE VIN IS NOT NULL)
  UNION ALL SELECT 7, 'Same ad reposted without a VIN (same car details and price)',
    (SELECT count(*) FROM by_id WHERE VIN IS NULL) - (SELECT count(*) FROM clean WHERE VIN IS NULL))
SELECT step_no, step, rows_removed,
  ((SELECT count(*) FROM ruled) - sum(rows_removed) OVER (ORDER BY step_no))::BIGINT AS rows_remaining,
  round(rows_removed * 100.0::DOUBLE / (SELECT count(*) FROM ruled), 6) AS pct_of_original FROM steps"""

SQL["clean_listings"] = f"WITH {CLEAN} SELECT * FROM clean"

SQL["latest_per_vin"] = f"""WITH {V_LISTINGS}
SELECT id, VIN, posting_date, price, odometer FROM v_listings WHERE VIN IS NULL
UNION ALL SELECT id, VIN, posting_date, price, odometer FROM (
  SELECT *, row_number() OVER (PARTITION BY VIN ORDER BY posting_date DESC NULLS LAST, price DESC NULLS LAST,
    odometer DESC NULLS LAST, id DESC NULLS LAST) AS place FROM v_listings WHERE VIN IS NOT NULL) WHERE place = 1"""

_TYPES = {
    "id": "bigint", "price": "double", "year": "int", "odometer": "double", "l_orderkey": "bigint",
    "l_partkey": "bigint", "l_linenumber": "int", "p_size": "int",
}
SQL["schema_profile"] = f"WITH {V_LISTINGS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{_TYPES.get(c, 'string')}' AS type, count(*) AS rows, count({c}) AS filled FROM v_listings"
    for c in views.LISTINGS
)
SQL["category_profile"] = f"WITH {V_LISTINGS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique, "
    f"CASE WHEN count(DISTINCT {c}) < 15 THEN (SELECT string_agg(v, ',' ORDER BY v) FROM "
    f"(SELECT DISTINCT {c} AS v FROM v_listings WHERE {c} IS NOT NULL)) END AS sample_values FROM v_listings"
    for c in ["manufacturer", "model", "type", "fuel", "transmission", "drive", "VIN", "posting_date"]
)
SQL["missingness"] = f"WITH {V_LISTINGS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg(({c} IS NULL)::INT) * 100, 6) AS missing_pct, "
    f"'{fixed.MISSING_DECISIONS.get(c, fixed.COMPLETE_DECISION)}' AS decision FROM v_listings"
    for c in views.LISTINGS
)
SQL["numeric_ranges"] = f"WITH {V_LISTINGS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM v_listings"
    for c in ["price", "year", "odometer", "p_size"]
)
SQL["describe_price"] = f"WITH {CLEAN} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
    f"min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25, "
    f"round(quantile_cont({c}::DOUBLE, 0.5), 6) AS q50, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75 FROM clean"
    for c in ["price", "odometer", "year"]
)
SQL["describe_text"] = f"WITH {CLEAN} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", sum(n)::BIGINT AS count, count(*) AS n_unique, "
    f"arg_min(v, (-n, v)) AS top, max(n) AS freq FROM (SELECT {c} AS v, count(*) AS n FROM clean WHERE {c} IS NOT NULL GROUP BY 1)"
    for c in ["manufacturer", "model", "type", "drive"]
)
SQL["skewness_log"] = f"""WITH {CLEAN}
SELECT round(skewness(price), 6) AS raw_skewness, round(skewness(ln(price)), 6) AS log_skewness FROM clean"""

SQL["price_by_segment"] = f"WITH {CLEAN} " + " UNION ALL ".join(
    f"SELECT '{c}' AS segment, {c} AS value, count(*) AS listings, round(quantile_cont(price, 0.5), 6) AS median_price "
    f"FROM clean GROUP BY {c}"
    for c in ["fuel", "transmission", "drive"]
)

_CURVE = (
    "SELECT '{axis}' AS x_axis, ({x})::DOUBLE AS x_value, '{segment}' AS segment, {segment} AS category, "
    "count(*) AS listings, round(quantile_cont(price, 0.25), 6) AS q25, round(quantile_cont(price, 0.5), 6) AS median_price, "
    "round(quantile_cont(price, 0.75), 6) AS q75 FROM clean WHERE {where} AND {segment} IN ({values}) "
    "GROUP BY ALL HAVING count(*) >= 50"
)
SQL["segment_curves"] = f"WITH {CLEAN} " + " UNION ALL ".join(
    _CURVE.format(axis=axis, x=x, where=where, segment=s, values=", ".join(f"'{v}'" for v in vs))
    for axis, x, where in [
        ("odometer", "floor(odometer / 20000) * 20000 + 10000", "odometer < 240000"),
        ("year", "year", "year >= 1997"),
    ]
    for s, vs in catalog.SEGMENTS.items()
)
_QUARTERS = (
    "count(*) AS listings, round(quantile_cont(price, 0.25), 6) AS q25, round(quantile_cont(price, 0.5), 6) AS median_price, "
    "round(quantile_cont(price, 0.75), 6) AS q75"
)
SQL["brand_summary"] = f"""WITH {CLEAN}
SELECT manufacturer, {_QUARTERS}, quantile_cont((2001 - year)::DOUBLE, 0.5) AS median_age,
  round(quantile_cont(odometer, 0.5), 6) AS median_odometer,
  round(quantile_cont(price, 0.75) - quantile_cont(price, 0.25), 6) AS iqr
FROM clean WHERE manufacturer <> 'unknown' GROUP BY manufacturer HAVING count(*) >= 100"""

_TOP_BRANDS = (
    "top_brands AS (SELECT manufacturer AS brand FROM clean WHERE manufacturer <> 'unknown' GROUP BY 1 "
    "ORDER BY count(*) DESC, 1 LIMIT 10)"
)
SQL["box_by_brand_era"] = f"""WITH {CLEAN}, {_TOP_BRANDS},
eras AS (SELECT manufacturer, price, CASE WHEN year > 1995 AND year <= 1997 THEN '1996-1997'
  WHEN year > 1997 AND year <= 1999 THEN '1998-1999' WHEN year > 1999 AND year <= 2001 THEN '2000-2001' END AS era
  FROM clean WHERE manufacturer IN (SELECT brand FROM top_brands)),
boxes AS (SELECT manufacturer, era, count(*) AS listings, quantile_cont(price, 0.25) AS q25,
  quantile_cont(price, 0.5) AS median_price, quantile_cont(price, 0.75) AS q75 FROM eras GROUP BY ALL)
SELECT manufacturer, era, listings, round(q25, 6) AS q25, round(median_price, 6) AS median_price, round(q75, 6) AS q75,
  min(price) AS whisker_low, max(price) AS whisker_high
FROM boxes JOIN eras USING (manufacturer, era)
WHERE price BETWEEN q25 - (q75 - q25) * 1.5 AND q75 + (q75 - q25) * 1.5 GROUP BY ALL"""

SQL["depreciation"] = f"""WITH {CLEAN}
SELECT 2001 - year AS vehicle_age, {_QUARTERS} FROM clean WHERE 2001 - year <= 4 GROUP BY 1"""

_CURVES = f"""{CLEAN}, {_TOP_BRANDS},
curves AS (SELECT 'All brands' AS series, 2001 - year AS vehicle_age, count(*) AS listings,
    quantile_cont(price, 0.5) AS median_price FROM clean WHERE 2001 - year <= 4 GROUP BY ALL
  UNION ALL SELECT manufacturer, 2001 - year, count(*), quantile_cont(price, 0.5) FROM clean
    WHERE 2001 - year <= 4 AND manufacturer IN (SELECT brand FROM top_brands) GROUP BY ALL HAVING count(*) >= 30)"""
SQL["depreciation_by_brand"] = f"""WITH {_CURVES}
SELECT s.series, a.age::INT AS vehicle_age, c.listings, round(c.median_price, 6) AS median_price
FROM (SELECT DISTINCT series FROM curves) s CROSS JOIN range(0, 7) a(age)
LEFT JOIN curves c ON c.series = s.series AND c.vehicle_age = a.age"""
SQL["depreciation_lists"] = f"""WITH {_CURVES}
SELECT series, string_agg(vehicle_age::VARCHAR, ',' ORDER BY vehicle_age) AS vehicle_age,
  string_agg(listings::VARCHAR, ',' ORDER BY vehicle_age) AS listings FROM curves GROUP BY series"""

SQL["histogram_raw"] = f"""WITH {CLEAN}, ends AS (SELECT min(price) AS lo, max(price) AS hi FROM clean),
counts AS (SELECT least(floor((price - lo) / (hi - lo) * 50), 49)::BIGINT AS bin, count(*) AS n FROM clean, ends GROUP BY 1)
SELECT b.bin, round(lo + (hi - lo) * b.bin / 50, 6) AS bin_from, round(lo + (hi - lo) * (b.bin + 1) / 50, 6) AS bin_to,
  coalesce(n, 0) AS listings FROM range(0, 50) b(bin) CROSS JOIN ends LEFT JOIN counts c ON c.bin = b.bin"""
SQL["histogram_log"] = f"""WITH {CLEAN}, ends AS (SELECT log10(2000.0::DOUBLE) AS lo, log10(90000.0::DOUBLE) AS hi),
counts AS (SELECT least(floor((log10(price) - lo) / (hi - lo) * 40), 39)::BIGINT AS bin, count(*) AS n FROM clean, ends
  WHERE log10(price) BETWEEN lo AND hi GROUP BY 1)
SELECT b.bin, round(pow(10.0::DOUBLE, lo + (hi - lo) * b.bin / 40), 6) AS bin_from,
  round(pow(10.0::DOUBLE, lo + (hi - lo) * (b.bin + 1) / 40), 6) AS bin_to,
  coalesce(n, 0) AS listings FROM range(0, 40) b(bin) CROSS JOIN ends LEFT JOIN counts c ON c.bin = b.bin"""

SQL["price_features"] = f"""WITH {FEATURES}
SELECT id, vehicle_age, round(miles_per_year, 6) AS miles_per_year, brand_segment, model_grouped,
  round(odometer_10k, 6) AS odometer_10k FROM features"""
SQL["top_model_group"] = f"""WITH {FEATURES}
SELECT count(*) AS listings, round(avg((model_grouped <> 'Other')::INT) * 100, 6) AS covered_pct,
  count(DISTINCT model) AS models FROM features"""
SQL["one_hot_levels"] = f"WITH {FEATURES} " + " UNION ALL ".join(
    f"SELECT '{c}_' || {c} AS feature, '{c}' AS \"column\", {c} AS level, count(*) AS ones FROM features "
    f"WHERE {c} <> '{base}' GROUP BY {c}"
    for c, base in catalog.DESIGN.categorical.items()
)
SQL["one_hot_rows"] = f"""WITH {CLEAN}
SELECT id, fuel, drive, (drive = '4wd')::INT::DOUBLE AS drive_4wd, (drive = 'rwd')::INT::DOUBLE AS drive_rwd,
  (drive = 'unknown')::INT::DOUBLE AS drive_unknown, (fuel = 'N')::INT::DOUBLE AS "fuel_N", (fuel = 'R')::INT::DOUBLE AS "fuel_R"
FROM clean"""
SQL["one_hot_sparse"] = f"WITH {CLEAN} " + " UNION ALL ".join(
    f"SELECT id, '{c}_' || {c} AS feature FROM clean WHERE {c} <> '{base}'"
    for c, base in [("fuel", "A"), ("drive", "fwd"), ("model", "unknown"), ("type", "unknown")]
)
SQL["ols_many_levels"] = f"""WITH {CLEAN},
points AS (SELECT l_partkey AS g, ln(price) AS y, odometer / 10000 AS x FROM clean),
means AS (SELECT g, avg(x) AS mx, avg(y) AS my FROM points GROUP BY g),
slopes AS (SELECT sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) AS slope FROM points JOIN means USING (g)),
bases AS (SELECT g, my - slope * mx AS base FROM means, slopes)
SELECT '(intercept)' AS feature, round(base, 6) AS coefficient FROM bases WHERE g = 1
UNION ALL SELECT 'odometer_10k', round(slope, 6) FROM slopes
UNION ALL SELECT 'l_partkey_' || g, round(base - (SELECT base FROM bases WHERE g = 1), 6) FROM bases WHERE g <> 1"""
SQL["ols_by_segment"] = f"""WITH {FEATURES},
m AS (SELECT brand_segment, count(*) AS listings, covar_pop(vehicle_age, vehicle_age) AS aa,
  covar_pop(odometer_10k, odometer_10k) AS oo, covar_pop(vehicle_age, odometer_10k) AS ao,
  covar_pop(vehicle_age, ln(price)) AS ay, covar_pop(odometer_10k, ln(price)) AS oy FROM features GROUP BY 1)
SELECT brand_segment, listings, round((exp((ay * oo - oy * ao) / (aa * oo - ao * ao)) - 1) * 100, 6) AS pct_per_year,
  round((exp((oy * aa - ay * ao) / (aa * oo - ao * ao)) - 1) * 100, 6) AS pct_per_10k_miles FROM m"""

# Least squares: long design rows, the matrix of summed products, and Gauss-Jordan steps on it.
# ``g`` is the left-out feature group, '' for the full model.
_CATEGORICAL = catalog.DESIGN.categorical
_GROUPS = ["vehicle_age", "odometer_10k", *_CATEGORICAL]


def _least_squares(groups: list[str]) -> str:
    dummies = " ".join(
        f"UNION ALL SELECT id, in_train, y, '{c}', '{c}_' || {c}, 1.0::DOUBLE FROM rows_ WHERE {c} <> '{b}'"
        for c, b in _CATEGORICAL.items()
    )
    group_rows = ", ".join(f"('{g}')" for g in groups)
    return f"""{FEATURES},
rows_ AS (SELECT *, ln(price) AS y, substr(md5(concat_ws('-', id::VARCHAR, '42')), 1, 4) < 'cccd' AS in_train FROM features),
design AS (
  SELECT id, in_train, y, '(intercept)' AS grp, '(intercept)' AS f, 1.0::DOUBLE AS x FROM rows_
  UNION ALL SELECT id, in_train, y, 'vehicle_age', 'vehicle_age', vehicle_age::DOUBLE FROM rows_
  UNION ALL SELECT id, in_train, y, 'odometer_10k', 'odometer_10k', odometer_10k FROM rows_
  {dummies}),
wanted(g) AS (VALUES {group_rows}),
numbered AS (SELECT g, f, row_number() OVER (PARTITION BY g ORDER BY f)::INT AS i
  FROM wanted JOIN (SELECT DISTINCT grp, f FROM design WHERE in_train) ON grp <> g),
size AS (SELECT g, max(i) AS p FROM numbered GROUP BY g),
grams AS (SELECT a.f AS fa, b.f AS fb, sum(a.x * b.x) AS v FROM design a JOIN design b USING (id)
  WHERE a.in_train GROUP BY ALL),
sides AS (SELECT f, sum(x * y) AS v FROM design WHERE in_train GROUP BY f),
cells AS (SELECT a.g, a.i, b.i AS j, coalesce(v, 0.0) AS v FROM numbered a JOIN numbered b USING (g)
    LEFT JOIN grams ON fa = a.f AND fb = b.f
  UNION ALL SELECT a.g, a.i, p + 1, v FROM numbered a JOIN size USING (g) JOIN sides USING (f)),
steps AS (SELECT 0 AS k, g, i, j, v FROM cells
  UNION ALL SELECT c.k + 1, c.g, c.i, c.j, CASE WHEN c.i = c.k + 1 THEN c.v / d.v ELSE c.v - r.v * q.v / d.v END
  FROM steps c JOIN size s ON s.g = c.g AND c.k < s.p
  JOIN steps d ON d.g = c.g AND d.i = c.k + 1 AND d.j = c.k + 1
  JOIN steps r ON r.g = c.g AND r.i = c.i AND r.j = c.k + 1
  JOIN steps q ON q.g = c.g AND q.i = c.k + 1 AND q.j = c.j),
fitted AS (SELECT n.g, n.f, st.v AS beta FROM steps st JOIN size s ON s.g = st.g AND st.k = s.p AND st.j = s.p + 1
  JOIN numbered n ON n.g = st.g AND n.i = st.i),
scored AS (SELECT g, id, any_value(y) AS y, sum(x * beta) AS predicted FROM design JOIN fitted USING (f)
  WHERE NOT in_train GROUP BY g, id),
r2s AS (SELECT g, 1 - sum((y - predicted) ** 2) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2 FROM scored GROUP BY g)"""


def _recursive(body: str) -> str:
    return "WITH RECURSIVE " + body


_BASELINE_CASE = " ".join(f"WHEN '{c}' THEN '{b}'" for c, b in _CATEGORICAL.items())
_NAME_CASE = " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in fixed.FEATURE_GROUP_NAMES.items())
SQL["ols_effects"] = _recursive(
    f"""{_least_squares([''])},
owners AS (SELECT DISTINCT grp, f FROM design)
SELECT CASE grp WHEN 'vehicle_age' THEN 'Vehicle age' WHEN 'odometer_10k' THEN 'Odometer' {_NAME_CASE} END AS effect_group,
  CASE grp WHEN 'vehicle_age' THEN '+1 year' WHEN 'odometer_10k' THEN '+10,000 miles'
    ELSE substr(f, length(grp) + 2) || ' (vs ' || CASE grp {_BASELINE_CASE} END || ')' END AS label,
  round((exp(beta) - 1) * 100, 6) AS pct_effect, round(beta, 6) AS coefficient
FROM fitted JOIN owners USING (f) WHERE f <> '(intercept)'"""
)
SQL["ols_eval"] = _recursive(
    f"""{_least_squares([''])}
SELECT (SELECT count(*) FROM rows_ WHERE in_train) AS train_rows, count(*) AS test_rows,
  round((SELECT r2 FROM r2s), 6) AS r2,
  round(quantile_cont(abs(exp(predicted) - exp(y)) / exp(y) * 100, 0.5), 6) AS median_pct_error FROM scored"""
)
SQL["listing_totals"] = f"""WITH {CLEAN}
SELECT count(*) AS listings, 2001 AS reference_year, round(quantile_cont(price, 0.5), 6) AS median_price,
  quantile_cont((2001 - year)::DOUBLE, 0.5) AS median_age, round(quantile_cont(odometer, 0.5), 6) AS median_odometer FROM clean"""
SQL["listing_first_rows"] = f"WITH {V_LISTINGS} SELECT * FROM v_listings ORDER BY id, posting_date, price, l_partkey LIMIT 5"
SQL["ols_importance"] = _recursive(
    f"""{_least_squares(['', *_GROUPS])}
SELECT CASE g WHEN 'vehicle_age' THEN 'Vehicle age' WHEN 'odometer_10k' THEN 'Odometer' {_NAME_CASE} END AS feature_group,
  round(r2, 6) AS r2_without, round((SELECT r2 FROM r2s WHERE g = '') - r2, 6) AS r2_drop FROM r2s WHERE g <> ''"""
)
SQL["error_by_band"] = _recursive(
    f"""{_least_squares([''])},
priced AS (SELECT price, exp(predicted) AS p FROM scored JOIN features USING (id))
SELECT CASE WHEN price < 20000 THEN 'Asking price under 20000' ELSE 'Asking price 20000 and above' END AS listings,
  count(*) AS test_rows, round(quantile_cont(p, 0.5), 6) AS median_predicted,
  round(avg((p > 2 * price)::INT) * 100, 6) AS predicted_more_than_double FROM priced GROUP BY 1"""
)
SQL["prediction_sample"] = _recursive(
    f"""{_least_squares([''])}
SELECT id, round(price, 6) AS price, round(exp(predicted), 6) AS predicted_price FROM scored JOIN features USING (id)
ORDER BY md5(concat_ws('-', id::VARCHAR, '7')), id LIMIT 500"""
)

SQL["sample_n"] = f"""WITH {V_LISTINGS}
SELECT VIN FROM (SELECT DISTINCT VIN FROM v_listings WHERE VIN IS NOT NULL)
ORDER BY md5(concat_ws('-', VIN, '42')), VIN LIMIT 200"""
SQL["sample_batches"] = f"""WITH {V_LISTINGS},
sample AS (SELECT DISTINCT VIN FROM v_listings WHERE VIN IS NOT NULL ORDER BY md5(concat_ws('-', VIN, '42')), VIN LIMIT 120),
placed AS (SELECT VIN, (row_number() OVER (ORDER BY VIN) - 1) // 50 AS batch FROM sample)
SELECT batch, count(*)::INT AS size, string_agg(VIN, ';' ORDER BY VIN) AS keys FROM placed GROUP BY batch"""

# --- recalls ---

_SUFFIXES = "|".join(fixed.LEGAL_SUFFIXES)
NORM = (
    "regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(manufacturer), '\\(.*?\\)', ' ', 'g'), "
    f"'[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')), '( ({_SUFFIXES}))+$', '', 'g')"
)
NAMED = f"{V_RECALLS}, named AS (SELECT *, {NORM} AS mfr_norm FROM v_recalls)"
GROUP_CASE = (
    "CASE WHEN regexp_matches(mfr_norm, '^nation 12$') THEN 'Group twelve' "
    "WHEN regexp_matches(mfr_norm, '^nation 2|^nation 12') THEN 'Group two' "
    "WHEN regexp_matches(mfr_norm, '^nation 1') THEN 'Group one' END"
)

SQL["value_counts"] = f"""WITH {V_RECALLS}
SELECT component, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct FROM v_recalls
WHERE component IS NOT NULL GROUP BY component"""
SQL["top_k"] = f"""WITH {V_RECALLS}
SELECT manufacturer, count(*) AS n FROM v_recalls WHERE manufacturer <> 'NATION_3' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10"""
SQL["sorted_head"] = f"""WITH {V_RECALLS}
SELECT recall_id, manufacturer, round(units, 6) AS units FROM v_recalls ORDER BY units DESC NULLS LAST, recall_id LIMIT 15"""
SQL["name_normalize"] = f"""WITH {NAMED}
SELECT manufacturer, mfr_norm,
  replace(regexp_replace(manufacturer, ',? (Inc\\.|LLC|North America).*$', '', 'g'), ' North America', '') AS short_name,
  count(*) AS recalls FROM named GROUP BY ALL"""
SQL["group_mapping"] = f"""WITH {NAMED}
SELECT {GROUP_CASE} AS mfr_group, manufacturer, count(*) AS recalls FROM named
WHERE {GROUP_CASE} IS NOT NULL GROUP BY ALL"""
SQL["display_names"] = f"""WITH {NAMED},
spelled AS (SELECT mfr_norm, arg_min(manufacturer, (-n, manufacturer)) AS spelling
  FROM (SELECT mfr_norm, manufacturer, count(*) AS n FROM named GROUP BY ALL) GROUP BY mfr_norm)
SELECT recall_id, mfr_norm, coalesce({GROUP_CASE}, spelling) AS mfr_display FROM named JOIN spelled USING (mfr_norm)"""
SQL["year_matrix"] = f"""WITH {V_RECALLS},
counts AS (SELECT component, year, count(*) AS n FROM v_recalls WHERE component IS NOT NULL GROUP BY ALL)
SELECT k.component, r.y::INT AS year, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT component FROM counts) k
CROSS JOIN range(1993, 2003) r(y) LEFT JOIN counts c ON c.component = k.component AND c.year = r.y"""
SQL["component_pivot"] = f"""WITH {V_RECALLS}
SELECT year, """ + ", ".join(
    f"count(*) FILTER (component = '{c}') AS \"{c}\"" for c in ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
) + " FROM v_recalls WHERE component IS NOT NULL GROUP BY year"

SQL["heat_matrix"] = f"""WITH {NAMED},
top_names AS (SELECT mfr_norm FROM named GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5),
top_parts AS (SELECT component FROM named WHERE component IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5),
cells AS (SELECT m.mfr_norm, p.component, count(n.recall_id) AS n FROM top_names m CROSS JOIN top_parts p
  LEFT JOIN named n ON n.mfr_norm = m.mfr_norm AND n.component = p.component GROUP BY ALL),
shares AS (SELECT *, max(n) OVER () AS largest, n / max(n) OVER () AS share FROM cells)
SELECT mfr_norm, component, n, largest, CASE WHEN share >= 0.65 THEN 4 WHEN share >= 0.45 THEN 3 WHEN share >= 0.25 THEN 2
  WHEN share >= 0.12 THEN 1 ELSE 0 END AS bucket FROM shares"""

DENSE = f"""{NAMED},
counts AS (SELECT mfr_norm, month, count(*) AS n FROM named GROUP BY ALL),
kept AS (SELECT mfr_norm FROM counts GROUP BY 1 HAVING sum(n) >= 10),
months AS (SELECT DISTINCT month FROM counts WHERE mfr_norm IN (SELECT mfr_norm FROM kept)),
dense AS (SELECT k.mfr_norm, m.month, coalesce(c.n, 0) AS n FROM kept k CROSS JOIN months m
  LEFT JOIN counts c ON c.mfr_norm = k.mfr_norm AND c.month = m.month)"""
SQL["spikes"] = f"""WITH {DENSE},
scored AS (SELECT *, (n - avg(n) OVER w) / nullif(stddev_samp(n) OVER w, 0) AS z_score FROM dense WINDOW w AS (PARTITION BY mfr_norm))
SELECT mfr_norm, month, n, round(z_score, 6) AS z_score FROM scored WHERE z_score > 2"""
SQL["structural_breaks"] = f"""WITH {DENSE},
means AS (SELECT mfr_norm, avg(n) FILTER (month BETWEEN {1990 * 12} AND {catalog.BREAK_MONTH - 1}) AS avg_previous,
  avg(n) FILTER (month BETWEEN {catalog.BREAK_MONTH} AND {2010 * 12}) AS avg_recent FROM dense GROUP BY 1)
SELECT mfr_norm, round(avg_previous, 6) AS avg_previous, round(avg_recent, 6) AS avg_recent,
  round(avg_recent / avg_previous, 6) AS increase_ratio FROM means
WHERE avg_previous > 0 AND avg_recent >= 1.05 * avg_previous AND avg_recent >= 0"""
SQL["exposure_ranks"] = f"""WITH {V_RECALLS},
totals AS (SELECT manufacturer, count(*) AS recalls, coalesce(sum(units), 0.0) AS units_affected FROM v_recalls GROUP BY 1),
ranked AS (SELECT *, floor(rank() OVER (ORDER BY units_affected DESC) + (count(*) OVER (PARTITION BY units_affected) - 1) / 2)::BIGINT AS rank_by_units,
  row_number() OVER (ORDER BY recalls DESC, manufacturer)::INT AS rank_by_recalls FROM totals)
SELECT manufacturer, recalls, round(units_affected, 6) AS units_affected, round(units_affected / recalls, 6) AS units_per_recall,
  rank_by_units, rank_by_recalls FROM ranked WHERE rank_by_recalls <= 50"""
SQL["exposure_by_units"] = f"""WITH {V_RECALLS},
top AS (SELECT manufacturer, count(*) AS recalls, coalesce(sum(units), 0.0) AS units_affected FROM v_recalls GROUP BY 1
  ORDER BY recalls DESC, manufacturer LIMIT 10),
shown AS (SELECT replace(regexp_replace(manufacturer, ',? (Inc\\.|LLC|North America).*$', '', 'g'), ' North America', '') AS label,
  recalls, units_affected FROM top)
SELECT label, recalls, round(units_affected, 6) AS units_affected,
  row_number() OVER (ORDER BY units_affected DESC, label)::INT AS place FROM shown"""
SQL["tied_ranks"] = f"""WITH {V_LISTINGS},
counts AS (SELECT VIN, count(*) AS listings FROM v_listings WHERE VIN IS NOT NULL GROUP BY VIN)
SELECT VIN, listings, floor(rank() OVER (ORDER BY listings DESC) + (count(*) OVER (PARTITION BY listings) - 1) / 2)::BIGINT AS rank_by_listings
FROM counts"""
SQL["peak_period"] = f"""WITH {V_RECALLS}
SELECT month AS peak_period, count(*) AS peak_recalls FROM v_recalls GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"""
SQL["time_span"] = f"""WITH {V_TELEMATICS},
spans AS (SELECT tripID, min(ts) AS lo, max(ts) AS hi FROM v_telematics GROUP BY 1)
SELECT strftime(min(lo), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(hi), '%Y-%m-%d %H:%M:%S') AS last,
  round(max(epoch_us(hi) - epoch_us(lo)) / 1e6, 6) AS longest_seconds FROM spans"""
SQL["totals"] = f"""WITH {NAMED}
SELECT count(*) AS total_recalls, min(year) AS first_year, max(report_date)::VARCHAR AS export_date,
  count(DISTINCT manufacturer) AS raw_names, count(DISTINCT mfr_norm) AS manufacturers, round(sum(units), 2) AS units_affected,
  count(*) FILTER (component IS NULL) AS missing_component,
  round(avg((component IS NULL)::INT) * 100, 6) AS missing_component_pct FROM named"""

LETTERS = (
    "trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
)
SEVERITY = (
    f"CASE WHEN {LETTERS} = '' THEN NULL WHEN regexp_matches(lower(text), 'anin|onnt') THEN 3 "
    "WHEN regexp_matches(lower(text), 'onst|aner') THEN 2 ELSE 1 END"
)
SQL["severity_levels"] = f"WITH {V_DOCS} SELECT doc_id, {SEVERITY} AS severity FROM v_docs"
SQL["severity_validation"] = f"""WITH {V_DOCS},
scored AS (SELECT source, {SEVERITY} AS severity FROM v_docs WHERE {LETTERS} <> '')
SELECT 'src1' AS flag, count(*) AS recalls, round(avg((severity = 3)::INT) * 100, 6) AS share_scored_high FROM scored WHERE source = 'src1'
UNION ALL SELECT 'src2', count(*), round(avg((severity = 3)::INT) * 100, 6) FROM scored WHERE source = 'src2'
UNION ALL SELECT 'All recalls with text', count(*), round(avg((severity = 3)::INT) * 100, 6) FROM scored"""

SENTENCE = (
    "CASE WHEN description IS NULL OR position('recalling' IN lower(description)) = 0 THEN '' "
    "WHEN position('. ' IN substr(description, position('recalling' IN lower(description)))) = 0 THEN description "
    "ELSE substr(description, 1, position('recalling' IN lower(description)) "
    "+ position('. ' IN substr(description, position('recalling' IN lower(description)))) - 2) END"
)


def _years(low: int, high: int) -> str:
    pair = "\\b((?:19|20)\\d{2})\\s*-\\s*((?:19|20)\\d{2})\\b"
    return f"""v_sentences AS (SELECT recall_id, recall_type, mfr_group, {SENTENCE} AS sentence FROM v_recalls),
v_singles AS (SELECT recall_id, unnest(regexp_extract_all(sentence, '\\b(?:19|20)\\d{{2}}\\b'))::INT AS year FROM v_sentences),
v_pairs AS (SELECT recall_id, unnest(regexp_extract_all(sentence, '{pair}', 1))::INT AS a,
  unnest(regexp_extract_all(sentence, '{pair}', 2))::INT AS b FROM v_sentences),
v_years AS (SELECT DISTINCT recall_id, year FROM (SELECT * FROM v_singles
    UNION ALL SELECT recall_id, unnest(range(a, b + 1))::INT FROM v_pairs WHERE b - a BETWEEN 0 AND 30)
  WHERE year BETWEEN {low} AND {high})"""


SQL["announcing_sentences"] = f"WITH {V_RECALLS} SELECT recall_id, {SENTENCE} AS sentence FROM v_recalls"
SQL["year_extract"] = f"""WITH {V_RECALLS}, {_years(1980, 2000)}
SELECT r.recall_id, count(y.year)::INT AS n_years, coalesce(string_agg(y.year::VARCHAR, ',' ORDER BY y.year), '') AS years
FROM v_recalls r LEFT JOIN v_years y USING (recall_id) GROUP BY r.recall_id"""
SQL["classify_last_wins"] = f"""WITH {NAMED}
SELECT {GROUP_CASE} AS label, count(*) AS recalls, round(avg(units), 6) AS mean_units FROM named
WHERE {GROUP_CASE} IS NOT NULL GROUP BY 1"""

# --- link between recalls and listings ---

TOKEN = "regexp_extract(replace(lower(model), '-', ''), '[a-z0-9]+')"
LINKS = f"""{V_LISTINGS}, {V_RECALLS}, {_years(1980, 2027)},
words AS (SELECT *, {TOKEN} AS word FROM v_listings),
vocabulary AS (SELECT word AS model_token FROM words GROUP BY 1 HAVING count(*) >= 20 AND length(word) >= 2
  AND NOT (regexp_matches(word, '^[0-9]+$') AND length(word) < 3) AND NOT regexp_matches(word, '^(19|20)[0-9]{{2}}$')
  AND word NOT IN ({', '.join(f"'{t}'" for t in fixed.AMBIGUOUS_TOKENS)})),
cars AS (SELECT * EXCLUDE (word), CASE WHEN word IN (SELECT model_token FROM vocabulary) THEN word END AS model_token FROM words),
recall_years AS (SELECT recall_id, mfr_group, year FROM v_sentences JOIN v_years USING (recall_id)
  WHERE recall_type = 'Vehicle' AND mfr_group IS NOT NULL),
found AS (SELECT DISTINCT recall_id, unnest(regexp_extract_all(replace(lower(sentence), '-', ''), '[a-z0-9]+')) AS model_token
  FROM v_sentences WHERE recall_type = 'Vehicle' AND mfr_group IS NOT NULL),
links AS (SELECT recall_id, mfr_group, year, model_token FROM recall_years JOIN found USING (recall_id)
  WHERE model_token IN (SELECT model_token FROM vocabulary)),
by_year AS (SELECT mfr_group, year, count(DISTINCT recall_id) AS mfr_year_recall_count FROM recall_years GROUP BY ALL),
by_model AS (SELECT mfr_group, year, model_token, count(DISTINCT recall_id) AS recall_count FROM links GROUP BY ALL),
linked AS (SELECT c.*, coalesce(m.recall_count, 0) AS recall_count, coalesce(y.mfr_year_recall_count, 0) AS mfr_year_recall_count,
  (coalesce(m.recall_count, 0) > 0)::INT AS recalled_flag FROM cars c
  LEFT JOIN by_model m ON m.mfr_group = c.mfr_group AND m.year = c.year AND m.model_token = c.model_token
  LEFT JOIN by_year y ON y.mfr_group = c.mfr_group AND y.year = c.year)"""
QUALITY = f"""{LINKS},
in_model AS (SELECT DISTINCT recall_id FROM links SEMI JOIN cars USING (mfr_group, year, model_token)),
in_year AS (SELECT DISTINCT recall_id FROM recall_years SEMI JOIN cars USING (mfr_group, year)),
quality AS (SELECT *, CASE WHEN recall_type <> 'Vehicle' THEN '{fixed.QUALITY_OUT_OF_SCOPE}'
  WHEN recall_id IN (SELECT recall_id FROM in_model) THEN '{fixed.QUALITY_MODEL}'
  WHEN recall_id IN (SELECT recall_id FROM in_year) THEN '{fixed.QUALITY_YEAR}'
  WHEN mfr_group IS NOT NULL THEN '{fixed.QUALITY_MAKER}' ELSE '{fixed.QUALITY_NONE}' END AS join_quality FROM v_recalls)"""

SQL["vocabulary"] = f"WITH {LINKS} SELECT model_token FROM vocabulary"
SQL["link_table"] = f"WITH {LINKS} SELECT recall_id, mfr_group, year, model_token FROM links"
SQL["recall_features"] = f"""WITH {LINKS}
SELECT id, l_partkey, mfr_group, recalled_flag, recall_count, mfr_year_recall_count FROM linked"""
SQL["recall_key_contract"] = f"""WITH {LINKS}
SELECT count(*) AS keys, count(*) - count(DISTINCT (mfr_group, year, model_token)) AS repeated_keys FROM by_model"""
SQL["top_listed_models"] = f"""WITH {LINKS}
SELECT manufacturer || ' ' || model_token AS model_label, count(*) AS listings,
  round(avg(recalled_flag) * 100, 6) AS share_recalled, round(avg(recall_count), 6) AS avg_recalls FROM linked
WHERE model_token IS NOT NULL AND mfr_group IS NOT NULL GROUP BY 1 ORDER BY listings DESC, 1 LIMIT 15"""
SQL["recalled_by_year"] = f"""WITH {LINKS}
SELECT year, count(*) AS listings, round(avg(recalled_flag) * 100, 6) AS share_recalled FROM linked
WHERE mfr_group IS NOT NULL GROUP BY year"""
SQL["coverage_listings"] = f"WITH {LINKS} " + " UNION ALL ".join(
    f"SELECT '{name}' AS level, count(*) FILTER ({cond}) AS listings, "
    f"round(count(*) FILTER ({cond}) * 100.0::DOUBLE / count(*), 6) AS pct_of_listings FROM linked"
    for name, cond in [
        ("Manufacturer mapped to a recall group", "mfr_group IS NOT NULL"),
        ("Model name usable as a join key", "mfr_group IS NOT NULL AND model_token IS NOT NULL"),
        ("Manufacturer + year has at least one recall", "mfr_year_recall_count > 0"),
        ("Model + year has at least one recall (recalled_flag = 1)", "recalled_flag = 1"),
    ]
)
SQL["coverage_recalls"] = f"""WITH {QUALITY}
SELECT join_quality, count(*) AS recalls, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM v_recalls), 6) AS pct_of_recalls
FROM quality GROUP BY 1"""
SQL["unmatched"] = f"""WITH {QUALITY}
SELECT manufacturer, count(*) AS recalls FROM quality WHERE starts_with(join_quality, 'Unmatched')
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"""
SQL["low_before"] = f"""WITH {QUALITY}
SELECT count(*) AS recalls, round(avg((year < 1998)::INT) * 100, 6) AS pct_before FROM quality
WHERE join_quality = '{fixed.QUALITY_MAKER}'"""
SQL["spot_check"] = f"""WITH {LINKS},
best AS (SELECT DISTINCT mfr_group, year, model_token, recall_count FROM linked WHERE recalled_flag = 1
  ORDER BY recall_count DESC, mfr_group, year, model_token LIMIT 1)
SELECT DISTINCT l.recall_id, subject, l.mfr_group, l.year, l.model_token, recall_count
FROM links l JOIN best USING (mfr_group, year, model_token) JOIN v_recalls r ON r.recall_id = l.recall_id
ORDER BY l.recall_id LIMIT 5"""

# --- texts ---

_STOP = ", ".join(f"'{w}'" for w in catalog.STOP_WORDS)
TERMS = f"""{V_DOCS},
cleaned AS (SELECT doc_id, {LETTERS} AS t FROM v_docs),
tokens AS (SELECT doc_id, list_filter(string_split(t, ' '), lambda w: length(w) >= 2 AND w NOT IN ({_STOP})) AS ws FROM cleaned),
exploded AS (SELECT doc_id, unnest(ws) AS term FROM tokens
  UNION ALL SELECT doc_id, unnest(list_transform(list_zip(ws[1:-2], ws[2:]), lambda p: p[1] || ' ' || p[2])) FROM tokens WHERE len(ws) > 1),
counts AS (SELECT doc_id, term, count(*) AS tf FROM exploded GROUP BY ALL),
documents_with_text AS (SELECT count(*) AS n FROM cleaned WHERE t <> ''),
vocab AS (SELECT term, sum(tf)::BIGINT AS total, count(*) AS df FROM counts GROUP BY term HAVING count(*) >= 20
  ORDER BY total DESC, term LIMIT 2000),
idfs AS (SELECT *, ln((n + 1) / (df + 1)) + 1 AS idf FROM vocab CROSS JOIN documents_with_text)"""
SQL["tfidf_top_terms"] = f"WITH {TERMS} SELECT term, total, df, round(idf, 6) AS idf FROM idfs"
SQL["tfidf_weights"] = f"""WITH {TERMS}, weighted AS (SELECT doc_id, term, tf * idf AS w FROM counts JOIN idfs USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM weighted"""

SQL["topic_facts"] = f"""WITH {TERMS}, weighted AS (SELECT doc_id, term, tf * idf AS w FROM counts JOIN idfs USING (term)),
scaled AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM weighted),
summed AS (SELECT term, sum(w) AS s FROM scaled GROUP BY term),
n AS (SELECT count(DISTINCT doc_id) AS with_terms FROM scaled)
SELECT (SELECT count(*) FROM v_docs) AS documents, with_terms, 0 AS negative_weights, 0 AS negative_cells, true AS topics_in_range,
  round(with_terms - (SELECT sum(s * s) FROM summed) / with_terms, 6) AS one_direction_error, true AS error_within FROM n"""

# topics without a common term: the best weight of each is a projection
GIVEN_TOPICS = f"""{TERMS}, numbered AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS j FROM vocab),
cells AS (SELECT term, (j % 8)::INT AS topic, (1 + j % 3) * (1 + (j % 8) / 16.0::DOUBLE) AS h FROM numbered),
squares AS (SELECT topic, sum(h * h) AS s FROM cells GROUP BY topic),
weighted AS (SELECT doc_id, term, tf * idf AS w FROM counts JOIN idfs USING (term)),
scaled AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM weighted),
fits AS (SELECT doc_id, topic, sum(w * h / s) AS topic_weight FROM scaled JOIN cells USING (term) JOIN squares USING (topic) GROUP BY doc_id, topic),
assigned AS (SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY topic_weight DESC, topic) = 1)"""
SQL["topic_assignment"] = f"""WITH {GIVEN_TOPICS}
SELECT doc_id, coalesce(topic, -1) AS topic, round(topic_weight, 6) AS topic_weight FROM v_docs LEFT JOIN assigned USING (doc_id)"""
SQL["topic_report"] = f"""WITH {GIVEN_TOPICS},
words AS (SELECT topic, string_agg(term, ', ' ORDER BY h DESC, term) AS top_words
  FROM (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY topic ORDER BY h DESC, term) <= 8) GROUP BY topic),
sizes AS (SELECT topic, count(*) AS documents FROM assigned GROUP BY topic),
texts AS (SELECT topic, text, max(topic_weight) AS topic_weight, min(doc_id) AS doc_id FROM assigned JOIN v_docs USING (doc_id) GROUP BY topic, text),
places AS (SELECT topic, doc_id, row_number() OVER (PARTITION BY topic ORDER BY round(topic_weight, 12) DESC, doc_id)::INT AS place FROM texts)
SELECT topic, top_words, documents, place, doc_id FROM words JOIN sizes USING (topic) JOIN places USING (topic) WHERE place <= 2"""
SQL["topic_levels"] = f"""WITH {GIVEN_TOPICS}, levels AS (SELECT doc_id, {SEVERITY} AS severity FROM v_docs)
SELECT topic, count(*) AS recalls, round(avg(severity), 6) AS mean_severity, round(avg((severity = 3)::INT) * 100, 6) AS share_high
FROM assigned JOIN levels USING (doc_id) GROUP BY topic"""

# --- decoded specifications ---

_SPEC_COLUMNS = _columns(views.SPECS)
COMPARED = f"""{V_LISTINGS},
latest AS (SELECT * REPLACE (lower(manufacturer) AS manufacturer) FROM v_listings WHERE VIN IS NOT NULL QUALIFY row_number() OVER (
  PARTITION BY VIN ORDER BY {', '.join(f'{c} DESC NULLS LAST' for c in ['posting_date', 'price', 'odometer', 'id'])}) = 1),
raw_specs AS (SELECT {_SPEC_COLUMNS} FROM latest WHERE l_orderkey % 31 <> 0),
specs AS (SELECT * REPLACE (API_Year::DOUBLE AS API_Year, try_cast(nullif(API_Engine, '') AS DOUBLE) AS API_Engine),
  CASE WHEN API_Make IS NOT NULL THEN 'Success' ELSE 'Failed' END AS Status FROM raw_specs),
joined AS (SELECT l.*, s.* EXCLUDE (VIN, Status), coalesce(s.Status, 'Failed') = 'Success' AS ok
  FROM latest l LEFT JOIN specs s USING (VIN)),
aligned AS (SELECT *, replace(manufacturer, '-', ' ') AS make_l, replace(lower(API_Make), '-', ' ') AS make_a, drive AS drive_l,
  CASE WHEN contains(upper(API_Drive), '4WD') OR contains(upper(API_Drive), 'AWD') OR contains(upper(API_Drive), '4X4') THEN '4wd'
    WHEN contains(upper(API_Drive), 'FWD') THEN 'fwd' WHEN contains(upper(API_Drive), 'RWD') THEN 'rwd'
    WHEN contains(upper(API_Drive), '4X2') OR contains(upper(API_Drive), '2WD') THEN '2wd' END AS drive_a,
  CASE API_Fuel WHEN 'Gasoline' THEN 'A' WHEN 'Diesel' THEN 'N' WHEN 'Electric' THEN 'R' END AS fuel_a,
  CASE WHEN fuel IN ('A', 'N', 'R') THEN fuel END AS fuel_l FROM joined),
compared AS (SELECT *,
  coalesce(ok AND make_l <> make_a, FALSE) AS c_make, coalesce(ok AND year <> API_Year, FALSE) AS c_year,
  coalesce(ok AND drive_l <> drive_a AND NOT (drive_a = '2wd' AND drive_l IN ('fwd', 'rwd')), FALSE) AS c_drive,
  coalesce(ok AND fuel_l <> fuel_a, FALSE) AS c_fuel FROM aligned),
decided AS (SELECT *, CASE WHEN NOT ok THEN 'Drop' WHEN c_make THEN 'Flag' WHEN c_year THEN 'Correct' ELSE 'Keep' END AS action
  FROM compared)"""

SQL["spec_flatten"] = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events"
SQL["spec_totals"] = f"WITH {V_LISTINGS} " + " UNION ALL ".join(
    f"SELECT '{name}' AS \"check\", count(*) FILTER ({cond}) AS listings, "
    f"round(count(*) FILTER ({cond}) * 100.0::DOUBLE / count(*), 6) AS pct_of_listings FROM v_listings"
    for name, cond in [
        ("with a VIN", "VIN IS NOT NULL"),
        ("with a valid VIN", "regexp_matches(VIN, '^V[0-9]+-[0-7]$')"),
        ("malformed VINs", "VIN IS NOT NULL AND NOT regexp_matches(VIN, '^V[0-9]+-[0-7]$')"),
    ]
)
SQL["spec_coverage"] = f"WITH {COMPARED} " + " UNION ALL ".join(
    f"SELECT '{name}' AS field, count({c}) AS populated, round(count({c}) * 100.0::DOUBLE / count(*), 6) AS coverage_pct FROM compared"
    for name, c in [("Engine displacement", "API_Engine"), ("Body class", "API_Body"), ("Drivetrain", "API_Drive"), ("Fuel type", "API_Fuel")]
)
_FIELDS = [
    ("Manufacturer", "make_l", "make_a", "c_make"), ("Model year", "year", "API_Year", "c_year"),
    ("Drive type", "drive_l", "drive_a", "c_drive"), ("Fuel type", "fuel_l", "fuel_a", "c_fuel"),
]
SQL["spec_compare"] = f"WITH {COMPARED} " + " UNION ALL ".join(
    f"SELECT '{name}' AS field, count(*) FILTER (ok AND {a} IS NOT NULL AND {b} IS NOT NULL) AS compared, "
    f"count(*) FILTER (ok AND {a} IS NULL AND {b} IS NOT NULL) AS gaps_filled, count(*) FILTER ({c}) AS conflicts, "
    f"round(count(*) FILTER ({c}) * 100.0::DOUBLE / greatest(count(*) FILTER (ok AND {a} IS NOT NULL AND {b} IS NOT NULL), 1), 6) AS conflict_pct "
    "FROM compared"
    for name, a, b, c in _FIELDS
)
SQL["spec_sample"] = f"""WITH {COMPARED}
SELECT count(*) AS sample_size, count(*) FILTER (ok) AS decoded,
  round(avg((ok IS NOT TRUE)::INT) * 100, 6) AS failure_rate FROM compared"""
SQL["spec_conflicts_sample"] = f"WITH {COMPARED} SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT VIN, '{name}' AS field, {a}::VARCHAR AS listing_value, {b}::VARCHAR AS api_value, "
    f"row_number() OVER (ORDER BY VIN)::INT AS place FROM compared WHERE {c}"
    for name, a, b, c in _FIELDS
) + ") WHERE place <= 5"
SQL["spec_rules"] = f"WITH {COMPARED} " + " UNION ALL ".join(
    f"SELECT '{name}' AS rule, count(*) FILTER ({cond}) AS violations, "
    f"round(count(*) FILTER ({cond}) * 100.0::DOUBLE / count(*), 6) AS violation_pct, "
    f"coalesce(min(VIN) FILTER ({cond}), '') AS example_vin FROM compared"
    for name, cond in [
        ("Electric vehicle with an engine displacement", "fuel = 'R' AND API_Engine > 0"),
        ("Combustion vehicle without an engine displacement", "ok AND fuel IN ('A', 'N') AND NOT coalesce(API_Engine > 0, FALSE)"),
        ("Model year out of range", "API_Year IS NOT NULL AND NOT API_Year BETWEEN 1981 AND 2002"),
        ("Pickup without a drivetrain", "contains(API_Body, 'Pickup') AND API_Drive IS NULL"),
        ("Listed year more than 1 year off the decoded year", "ok AND abs(year - API_Year) > 1"),
    ]
)
SQL["spec_taxonomy"] = f"WITH {COMPARED} " + " UNION ALL ".join(
    f"SELECT '{kind}' AS error_type, '{name}' AS category, count(*) FILTER ({cond}) AS count, "
    f"round(count(*) FILTER ({cond}) * 100.0::DOUBLE / count(*), 6) AS pct_of_sample FROM compared"
    for kind, name, cond in [
        ("Listing error", "Manufacturer conflict", "c_make"), ("Listing error", "Model year conflict", "c_year"),
        ("Listing error", "Drive type conflict", "c_drive"), ("Listing error", "Fuel type conflict", "c_fuel"),
        ("Decoder missingness", "VIN not decoded", "NOT ok"),
        ("Decoder missingness", "Missing engine", "ok AND API_Engine IS NULL"),
        ("Decoder missingness", "Missing drivetrain", "ok AND API_Drive IS NULL"),
        ("Decoder missingness", "Missing body class", "ok AND API_Body IS NULL"),
    ]
)
SQL["spec_decisions"] = f"""WITH {COMPARED}
SELECT action, count(*) AS listings, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct_of_sample FROM decided GROUP BY action"""
SQL["spec_enriched"] = f"""WITH {COMPARED}
SELECT VIN, id, CASE WHEN c_year THEN API_Year ELSE year::DOUBLE END AS year, year AS year_original,
  coalesce(drive_l, drive_a) AS drive_enriched, API_Engine, action FROM decided WHERE action <> 'Drop'"""
SQL["drive_before_after"] = f"""WITH {COMPARED},
b AS (SELECT coalesce(drive_l, 'unknown') AS drive, count(*) AS n, quantile_cont(price, 0.5) AS m FROM compared GROUP BY 1),
a AS (SELECT coalesce(drive_l, drive_a, 'unknown') AS drive, count(*) AS n, quantile_cont(price, 0.5) AS m FROM compared GROUP BY 1)
SELECT drive, coalesce(b.n, 0) AS listings_before, round(b.m, 6) AS median_price_before, a.n AS listings_after,
  round(a.m, 6) AS median_price_after FROM b FULL JOIN a USING (drive)"""

# --- telematics ---

TRIPS = f"""{V_TELEMATICS},
gaps AS (SELECT *, CASE WHEN deviceID IS NOT NULL THEN (epoch_us(ts) - epoch_us(lag(ts) OVER d)) / 1e6 END AS raw_delta FROM v_telematics
  WINDOW d AS (PARTITION BY deviceID ORDER BY ts NULLS LAST, event_id)),
marked AS (SELECT *, raw_delta IS NULL OR raw_delta > 3600 AS starts FROM gaps),
trips AS (SELECT *, CASE WHEN NOT starts THEN raw_delta END AS time_delta,
  sum(starts::INT) OVER (ORDER BY deviceID NULLS LAST, ts NULLS LAST, event_id)::BIGINT AS trip,
  row_number() OVER (PARTITION BY deviceID ORDER BY ts NULLS LAST, event_id) AS position FROM marked),
changes AS (SELECT *, speed - lag(speed) OVER t AS change, coalesce(x = lag(x) OVER t, FALSE) AS same,
  count(speed) OVER r AS known, avg(speed) OVER r AS mean10, stddev_samp(speed) OVER r AS std10
  FROM trips WINDOW t AS (PARTITION BY trip ORDER BY ts NULLS LAST, event_id),
    r AS (PARTITION BY trip ORDER BY ts NULLS LAST, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
numbered_runs AS (SELECT *, sum((NOT same)::INT) OVER (ORDER BY deviceID NULLS LAST, ts NULLS LAST, event_id) AS run FROM changes),
signals AS (SELECT *, sum(same::INT) OVER (PARTITION BY run)::BIGINT AS repeats,
  CASE WHEN time_delta BETWEEN 0 AND 600 THEN change / 3.6 END AS accel_ms2,
  CASE WHEN known = 10 THEN mean10 END AS speed_mean, CASE WHEN known = 10 THEN std10 END AS speed_std,
  speed = 0 AND rpm > 0 AS idle, speed * coalesce(time_delta, 0) / 3600 AS km FROM numbered_runs),
flagged AS (SELECT *, same AND repeats >= 3 AND speed > 0 AS frozen, coalesce(accel_ms2 < -3, FALSE) AS harsh_brake,
  coalesce(accel_ms2 > 3, FALSE) AS harsh_accel FROM signals)"""
SQL["time_deltas"] = f"WITH {TRIPS} SELECT event_id, deviceID, round(time_delta, 6) AS time_delta FROM trips"
SQL["sampling_report"] = f"WITH {TRIPS} " + " UNION ALL ".join(
    f"SELECT '{name}' AS interval, count(*) FILTER ({cond}) AS rows, "
    f"round(count(*) FILTER ({cond}) * 100.0::DOUBLE / count(time_delta), 6) AS pct FROM trips"
    for name, cond in [
        ("0 s", "time_delta = 0"), ("up to 60 s", "time_delta > 0 AND time_delta <= 60"),
        ("61 - 600 s", "time_delta > 60 AND time_delta <= 600"), ("601 - 1800 s", "time_delta > 600 AND time_delta <= 1800"),
        ("above 1800 s", "time_delta > 1800"),
    ]
)
SQL["sessions"] = f"""WITH {TRIPS}
SELECT event_id, deviceID, trip, position, round(time_delta, 6) AS time_delta FROM trips"""
SQL["signal_ranges"] = f"WITH {V_TELEMATICS} " + " UNION ALL ".join(
    f"SELECT '{label}' AS signal, min({c}) AS min, round(quantile_cont({c}, 0.5), 6) AS p50, "
    f"round(quantile_cont({c}, 0.99), 6) AS p99, max({c}) AS max, count(*) FILTER ({c} IS NULL) AS missing FROM v_telematics"
    for c, label in fixed.SIGNAL_LABELS.items()
)
SQL["quality_report"] = f"WITH {TRIPS} " + " UNION ALL ".join(
    f"SELECT '{name}' AS \"check\", count(*) FILTER ({cond}) AS rows, "
    f"round(count(*) FILTER ({cond}) * 100.0::DOUBLE / count(*), 6) AS pct_of_rows FROM flagged"
    for name, cond in [
        ("Missing accelerometer values", "x IS NULL"), ("Unparsed timestamps", "ts IS NULL"),
        ("Duplicate timestamps inside a trip", "time_delta = 0"),
        ("Missing intervals (gap > 1800 s inside a trip)", "time_delta > 1800"),
        ("RPM = 0 while speed > 10 km/h (sensor dropout)", "rpm = 0 AND speed > 10"),
        ("OBD speed vs GPS speed differ by > 20 km/h", "abs(speed - gps_speed) > 20"),
        ("GPS speed above 150 km/h (not plausible)", "gps_speed > 150"),
        ("Accelerometer frozen for 3+ rows while moving", "frozen"),
    ]
)
SQL["trips_with_gaps"] = f"""WITH {TRIPS}
SELECT count(DISTINCT trip) FILTER (time_delta > 1800) AS trips_with_gaps, count(DISTINCT trip) AS trips FROM trips"""
SQL["frozen_runs"] = f"WITH {TRIPS} SELECT event_id, repeats, frozen::INT AS frozen FROM flagged"
SQL["rolling_features"] = f"""WITH {TRIPS}
SELECT event_id, round(accel_ms2, 6) AS accel_ms2, round(speed_mean, 6) AS speed_mean, round(speed_std, 6) AS speed_std,
  round(km, 6) AS km, harsh_brake::INT AS harsh_brake, harsh_accel::INT AS harsh_accel, idle::INT AS idle FROM flagged"""
FEATURES_BY_TRIP = f"""{TRIPS},
all_trips AS (SELECT trip, deviceID, min(ts) AS start, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / 60 AS duration_min,
  count(*) AS rows, sum(km) AS distance_km, avg(speed) AS mean_speed, max(speed) AS max_speed, avg(speed_std) AS speed_std_mean,
  count(*) FILTER (harsh_brake) AS harsh_brakes, count(*) FILTER (harsh_accel) AS harsh_accels, avg(idle::INT) AS idle_share
  FROM flagged GROUP BY ALL),
kept_trips AS (SELECT * FROM all_trips WHERE duration_min >= 2 AND distance_km >= 0.5)"""
SQL["trip_features"] = f"""WITH {FEATURES_BY_TRIP}
SELECT trip, deviceID, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, round(duration_min, 6) AS duration_min, rows,
  round(distance_km, 6) AS distance_km, round(mean_speed, 6) AS mean_speed, max_speed, round(speed_std_mean, 6) AS speed_std_mean,
  harsh_brakes, harsh_accels, round(idle_share, 6) AS idle_share,
  round((harsh_brakes + harsh_accels) / distance_km * 100, 6) AS harsh_events_per_100km FROM kept_trips"""
SQL["device_summary"] = f"""WITH {FEATURES_BY_TRIP}
SELECT deviceID, count(*) AS trips, round(sum(distance_km), 6) AS distance_km,
  sum(harsh_brakes + harsh_accels)::BIGINT AS harsh_events, round(avg(idle_share), 6) AS idle_share,
  round(sum(harsh_brakes + harsh_accels) / sum(distance_km) * 100, 6) AS harsh_events_per_100km
FROM kept_trips WHERE deviceID IS NOT NULL GROUP BY deviceID HAVING sum(distance_km) >= 100"""
SQL["telematics_totals"] = f"""WITH {FEATURES_BY_TRIP}
SELECT (SELECT count(*) FROM v_telematics) AS rows, (SELECT count(DISTINCT tripID) FROM v_telematics) AS original_trip_ids,
  (SELECT count(DISTINCT deviceID) FROM v_telematics) AS devices, count(*) AS trips,
  round(coalesce(sum(distance_km), 0), 6) AS total_distance_km, round(median(duration_min), 6) AS median_trip_min,
  (SELECT count(*) FROM (SELECT deviceID FROM kept_trips WHERE deviceID IS NOT NULL GROUP BY deviceID
    HAVING sum(distance_km) >= 100)) AS devices_compared FROM kept_trips"""
SQL["example_trip"] = f"""WITH {TRIPS},
sizes AS (SELECT trip, count(*) AS n, min(ts) AS started, min(position) AS first_position FROM trips GROUP BY trip),
chosen AS (SELECT * FROM sizes ORDER BY abs(n - 20), trip LIMIT 1)
SELECT event_id, t.trip, position - first_position AS place, round((epoch_us(ts) - epoch_us(started)) / 6e7, 6) AS minutes, speed, rpm
FROM trips t JOIN chosen c ON c.trip = t.trip WHERE (position - first_position) % 5 = 0"""
