"""Independent SQL for every query, in the dialect of an embedded checking database."""

from __future__ import annotations

import math

from basketry.plans import fixture as fx

D = fx.DESIGN


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round(({expr}) + {10.0 ** -(digits + 3)!r}, {digits}) + 0.0 AS {name}"


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_ALIAS = " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in fx.BRAND_ALIASES.items())
_TRIALS = ", ".join(str(t) for t in D.trials)

_TXN = f"""
txn AS (
  SELECT CAST(o_orderdate AS DATE) AS "DATE", l_suppkey AS STORE_NBR, o_custkey AS LYLTY_CARD_NBR,
         l_orderkey AS TXN_ID, p_name || ' ' || CAST(p_size AS VARCHAR) || 'g' AS PROD_NAME,
         l_quantity AS PROD_QTY, l_extendedprice AS TOT_SALES
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey),
kept AS (SELECT * FROM txn WHERE PROD_NAME IS NULL OR NOT contains(PROD_NAME, '{fx.EXCLUDED}')),
clean AS (SELECT * FROM kept WHERE LYLTY_CARD_NBR <> {fx.OUTLIER_CARD}),
branded AS (
  SELECT *, upper(split_part(PROD_NAME, ' ', 1)) AS RAW,
         TRY_CAST(nullif(replace(regexp_extract(PROD_NAME, '-?[0-9][0-9,]*(\\.[0-9]+)?'), ',', ''), '') AS DOUBLE) AS PACK_SIZE
  FROM clean),
feat AS (
  SELECT "DATE", STORE_NBR, LYLTY_CARD_NBR, TXN_ID, PROD_NAME, PROD_QTY, TOT_SALES, PACK_SIZE,
         CASE RAW {_ALIAS} ELSE RAW END AS BRAND
  FROM branded),
cust AS (
  SELECT c_custkey AS LYLTY_CARD_NBR, c_mktsegment AS LIFESTAGE,
         CASE WHEN c_acctbal < 2500 THEN 'Budget' WHEN c_acctbal < 7000 THEN 'Mainstream' ELSE 'Premium' END AS PREMIUM_CUSTOMER
  FROM customer),
enr AS (
  SELECT feat.*, LIFESTAGE, PREMIUM_CUSTOMER, TOT_SALES / nullif(PROD_QTY, 0) AS price
  FROM feat LEFT JOIN cust ON feat.LYLTY_CARD_NBR = cust.LYLTY_CARD_NBR),
seg AS (
  SELECT LIFESTAGE, PREMIUM_CUSTOMER, sum(TOT_SALES) AS SALES, sum(PROD_QTY) AS UNITS,
         CAST(count(DISTINCT LYLTY_CARD_NBR) AS BIGINT) AS CUSTOMERS
  FROM enr GROUP BY ALL)
"""

def _bare(word: str) -> str:
    return f"(left({word}, 1) || regexp_replace(substr({word}, 2), '[AEIOU]', '', 'g'))"


# Links between brand spellings, from products whose first word the fixture's rule shortens.
_ALIASES = f"""respelt AS (
  SELECT CASE WHEN PACK_SIZE % {fx.BARE_PACKS} = 0 THEN {_bare("RAW")} WHEN PACK_SIZE % {fx.CUT_PACKS} = 0 THEN left(RAW, len(RAW) - 1)
              ELSE RAW END || substr(PROD_NAME, len(RAW) + 1) AS name FROM branded WHERE PROD_NAME IS NOT NULL),
prod AS (SELECT upper(split_part(name, ' ', 1)) AS b, regexp_extract_all(upper(name), '[A-Z]+') AS w, count(*) AS n FROM respelt GROUP BY ALL),
br AS (SELECT b, CAST(sum(n) AS BIGINT) AS n FROM prod WHERE b <> '' GROUP BY b),
short AS (
  SELECT 'letters' AS rule, left(b, 1) || b[i] AS key, b FROM br, unnest(range(2, len(b) + 1)) AS t(i) WHERE regexp_full_match(b, '[A-Z]{{4,30}}')
  UNION SELECT 'letters', left(b, 1) || b[i] || b[j], b FROM br, unnest(range(2, len(b))) AS t(i), unnest(range(i + 1, len(b) + 1)) AS u(j)
    WHERE regexp_full_match(b, '[A-Z]{{4,30}}')
  UNION SELECT 'truncated', left(b, len(b) - k), b FROM br, (VALUES (1), (2)) AS t(k) WHERE len(b) - k >= 4
  UNION SELECT 'initials', array_to_string(list_transform(w[1:k], lambda x: left(x, 1)), ''), b FROM prod, (VALUES (3), (4), (5)) AS t(k)
    WHERE len(w) >= k AND b <> ''),
spelt AS (
  SELECT {_bare("b")} AS key, b FROM br WHERE regexp_full_match(b, '[A-Z]+') AND len({_bare("b")}) >= 4
  UNION SELECT {_bare("(w[1] || w[2])")}, b FROM prod WHERE len(w) > 1 AND b <> '' AND len({_bare("(w[1] || w[2])")}) >= 4),
ranked AS (
  SELECT rule, key, b, n, row_number() OVER (PARTITION BY rule, key ORDER BY n DESC, len(b) DESC, b DESC) AS place
  FROM (SELECT * FROM short WHERE key <> b UNION ALL SELECT 'spelling', key, b FROM spelt) JOIN br USING (b)),
near AS (
  SELECT r.rule, a.b AS x, a.n AS nx, r.b AS y, r.n AS ny FROM br a JOIN ranked r ON r.key = a.b
  WHERE place = 1 AND rule <> 'spelling' AND (rule <> 'letters' OR (len(a.b) IN (2, 3) AND {_bare("a.b")} = a.b))
  UNION SELECT l.rule, l.b, l.n, h.b, h.n FROM ranked l JOIN ranked h ON h.rule = 'spelling' AND l.rule = 'spelling' AND h.key = l.key AND h.place = 1),
links AS (
  SELECT CASE WHEN up THEN x ELSE y END AS alias, CASE WHEN up THEN y ELSE x END AS brand, CASE WHEN up THEN nx ELSE ny END AS n_alias,
         CASE WHEN up THEN ny ELSE nx END AS n_brand, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules
  FROM (SELECT *, (nx, len(x), x) < (ny, len(y), y) AS up FROM near WHERE x <> y) GROUP BY 1, 2, 3, 4)
"""

G = fx.GAPS
# The transactions with the fixture's missing and unknown values, after the product filter, and joined.
_GAPPED = f"""{_TXN},
gapped AS (
  SELECT CAST(o_orderdate AS DATE) AS "DATE", l_suppkey AS STORE_NBR,
         CASE WHEN l_orderkey % {G.card} = 0 THEN NULL WHEN o_custkey % {G.unknown} = 0 THEN -o_custkey ELSE o_custkey END AS LYLTY_CARD_NBR,
         l_orderkey AS TXN_ID,
         CASE WHEN l_partkey % {G.name} = 0 THEN NULL ELSE p_name || ' ' || CAST(p_size AS VARCHAR) || 'g' END AS PROD_NAME,
         l_quantity AS PROD_QTY, l_extendedprice AS TOT_SALES
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey),
gapped_kept AS (SELECT * FROM gapped WHERE PROD_NAME IS NULL OR NOT contains(PROD_NAME, '{fx.EXCLUDED}')),
gapped_raw AS (
  SELECT *, upper(split_part(PROD_NAME, ' ', 1)) AS RAW,
         TRY_CAST(nullif(replace(regexp_extract(PROD_NAME, '-?[0-9][0-9,]*(\\.[0-9]+)?'), ',', ''), '') AS DOUBLE) AS PACK_SIZE
  FROM gapped),
gapped_feat AS (SELECT * EXCLUDE (RAW), CASE RAW {_ALIAS} ELSE RAW END AS BRAND FROM gapped_raw),
gapped_enr AS (
  SELECT f.*, LIFESTAGE, PREMIUM_CUSTOMER FROM gapped_feat f LEFT JOIN cust c ON f.LYLTY_CARD_NBR = c.LYLTY_CARD_NBR)
"""

_CORR = (
    "covar_samp(a.{m}, b.{m}) / nullif(stddev_samp(a.{m}) * stddev_samp(b.{m}), 0)"
)


def _store_ctes(mixed: bool = False) -> str:
    mag = "mag_totSales"
    if mixed:
        mag = f"CASE WHEN Store1 = {fx.SECOND_TRIAL} THEN mag_nCustomers ELSE mag_totSales END"
    w = D.corr_weight
    return (
        _TXN
        + f""",
m AS (
  SELECT STORE_NBR, CAST(year("DATE") * 100 + month("DATE") AS INTEGER) AS YEARMONTH,
         sum(TOT_SALES) AS totSales, CAST(count(DISTINCT LYLTY_CARD_NBR) AS BIGINT) AS nCustomers,
         count(DISTINCT TXN_ID) AS txns, sum(PROD_QTY) AS units
  FROM txn GROUP BY ALL),
full_obs AS (SELECT STORE_NBR FROM m WHERE YEARMONTH < {D.observed_until} GROUP BY STORE_NBR HAVING count(*) = {D.n_months}),
pre AS (SELECT * FROM m WHERE YEARMONTH < {D.pre_end} AND STORE_NBR IN (SELECT STORE_NBR FROM full_obs)),
dist AS (
  SELECT a.STORE_NBR AS Store1, b.STORE_NBR AS Store2, a.YEARMONTH,
         abs(a.totSales - b.totSales) AS d_totSales, abs(a.nCustomers - b.nCustomers) AS d_nCustomers
  FROM pre a JOIN pre b ON a.YEARMONTH = b.YEARMONTH WHERE a.STORE_NBR IN ({_TRIALS})),
scaled_dist AS (
  SELECT Store1, Store2, YEARMONTH,
         1 - (d_totSales - min(d_totSales) OVER g) / nullif(max(d_totSales) OVER g - min(d_totSales) OVER g, 0) AS c_totSales,
         1 - (d_nCustomers - min(d_nCustomers) OVER g) / nullif(max(d_nCustomers) OVER g - min(d_nCustomers) OVER g, 0) AS c_nCustomers
  FROM dist WINDOW g AS (PARTITION BY Store1, YEARMONTH)),
mags AS (SELECT Store1, Store2, avg(c_totSales) AS mag_totSales, avg(c_nCustomers) AS mag_nCustomers FROM scaled_dist GROUP BY ALL),
corrs AS (
  SELECT a.STORE_NBR AS Store1, b.STORE_NBR AS Store2,
         {_CORR.format(m="totSales")} AS corr_totSales, {_CORR.format(m="nCustomers")} AS corr_nCustomers
  FROM pre a JOIN pre b ON a.YEARMONTH = b.YEARMONTH WHERE a.STORE_NBR IN ({_TRIALS}) GROUP BY 1, 2),
scores AS (
  SELECT *, 0.5 * scoreNSales + 0.5 * scoreNCust AS finalControlScore FROM (
    SELECT Store1, Store2, {w} * corr_totSales + {1 - w} * ({mag}) AS scoreNSales,
           {w} * corr_nCustomers + {1 - w} * mag_nCustomers AS scoreNCust
    FROM corrs JOIN mags USING (Store1, Store2))),
ctl AS (
  SELECT Store1, Store2, finalControlScore FROM scores WHERE Store1 <> Store2
  QUALIFY row_number() OVER (PARTITION BY Store1 ORDER BY finalControlScore DESC NULLS LAST, Store2) = 1)
"""
    )


def _assess_ctes(
    mixed: bool = False, other: bool = False, all_months: bool = False, band: str = "raw"
) -> str:
    """Long trial/control series with factor, difference, deviation and band."""
    observed = "STORE_NBR = Store1"
    if other:
        observed = (
            f"STORE_NBR = CASE WHEN Store1 = {fx.SECOND_TRIAL} AND metric = 'nCustomers' "
            f"THEN {fx.FIRST_TRIAL} ELSE Store1 END"
        )
    period = f"YEARMONTH < {D.pre_end}"
    if all_months:
        period += f" OR (trial = {fx.SECOND_TRIAL} AND metric = 'totSales')"
    k = D.band_sds
    return (
        _store_ctes(mixed)
        + f""",
long AS (
  SELECT STORE_NBR, YEARMONTH, 'totSales' AS metric, totSales AS v FROM m
  UNION ALL SELECT STORE_NBR, YEARMONTH, 'nCustomers', CAST(nCustomers AS DOUBLE) FROM m),
t AS (SELECT Store1 AS trial, metric, YEARMONTH, v AS trial_value FROM ctl JOIN long ON STORE_NBR = Store1),
o AS (SELECT Store1 AS trial, metric, YEARMONTH, v AS observed FROM ctl JOIN long ON {observed}),
c AS (SELECT Store1 AS trial, Store2 AS control, metric, YEARMONTH, v AS raw FROM ctl JOIN long ON STORE_NBR = Store2),
factors AS (
  SELECT trial, control, metric, tsum / csum AS factor
  FROM (SELECT trial, metric, sum(trial_value) AS tsum FROM t WHERE YEARMONTH < {D.pre_end} GROUP BY ALL)
  JOIN (SELECT trial, control, metric, sum(raw) AS csum FROM c WHERE YEARMONTH < {D.pre_end} GROUP BY ALL) USING (trial, metric)),
sc AS (SELECT c.*, factor, raw * factor AS scaled FROM c JOIN factors USING (trial, control, metric)),
diff AS (
  SELECT trial, metric, YEARMONTH, scaled, raw, observed, abs(scaled - observed) / nullif(scaled, 0) AS pct_diff
  FROM sc JOIN o USING (trial, metric, YEARMONTH)),
sds AS (SELECT trial, metric, stddev_samp(pct_diff) AS sd FROM diff WHERE {period} GROUP BY ALL),
banded AS (
  SELECT sc.*, {band} * (1 + {k} * sd) AS upper, {band} * (1 - {k} * sd) AS lower FROM sc JOIN sds USING (trial, metric))
"""
    )


_MONTH1 = "make_date(YEARMONTH // 100, YEARMONTH % 100, 1)"
_IN_TRIAL = f"YEARMONTH BETWEEN {D.trial_start} AND {D.trial_end}"


def _grid(p: float, df_expr: str, source: str) -> str:
    """Cumulative trapezoid of the t density on an angle grid over 12 deviations."""
    n = 200000
    return f"""
grid AS (
  SELECT df, i, least({math.pi / 2!r}, 12 / sqrt(df)) / {n} AS h,
         pow(cos(i * least({math.pi / 2!r}, 12 / sqrt(df)) / {n}), df - 1) AS f
  FROM (SELECT DISTINCT {df_expr} AS df FROM {source}), range(0, {n + 1}) r(i)),
cum AS (
  SELECT df, i, h, (sum(f) OVER (ORDER BY i) - f / 2 - 0.5) * h AS c, sum(f) OVER () * h - h / 2 AS total FROM grid),
crossing AS (
  SELECT df, h, max(i) FILTER (0.5 + 0.5 * c / total <= {p}) AS i0 FROM cum GROUP BY df, h),
quant AS (
  SELECT a.df, sqrt(a.df) * tan(a.h * (a.i + ((2 * {p} - 1) * a.total - a.c) / (b.c - a.c))) AS q
  FROM crossing x JOIN cum a ON a.i = x.i0 JOIN cum b ON b.i = x.i0 + 1)
"""


_CONTRACT = """ "DATE", STORE_NBR, LYLTY_CARD_NBR, TXN_ID, PROD_NAME, """
_MONEY = "PROD_QTY, TOT_SALES"


def _summary(source: str, columns: tuple[str, ...]) -> str:
    def whole(end: str, column: str, value: str) -> str:
        kept = column not in ("PROD_QTY", "TOT_SALES")
        return f"CAST({f'{end}({value})' if kept else 'NULL'} AS BIGINT)"

    parts = []
    for c in columns:
        v = "date_diff('day', DATE '1970-01-01', \"DATE\")" if c == "DATE" else c
        parts.append(
            f"""SELECT '{c}' AS "column", count({v}) AS n, CAST(count(*) - count({v}) AS BIGINT) AS n_null,
  {_r(f"CAST(min({v}) AS DOUBLE)", "min")}, {_r(f"quantile_cont(CAST({v} AS DOUBLE), 0.25)", "q1")},
  {_r(f"quantile_cont(CAST({v} AS DOUBLE), 0.5)", "median")}, {_r(f"avg({v})", "mean", 4)},
  {_r(f"quantile_cont(CAST({v} AS DOUBLE), 0.75)", "q3")}, {_r(f"CAST(max({v}) AS DOUBLE)", "max")},
  {whole("min", c, v)} AS min_whole, {whole("max", c, v)} AS max_whole FROM {source}"""
        )
    return "\nUNION ALL\n".join(parts)


_NUMERIC = ("DATE", "STORE_NBR", "LYLTY_CARD_NBR", "TXN_ID", "PROD_QTY", "TOT_SALES")


def _histogram(source: str, value: str, bins: int, by: str | None = None) -> str:
    key = f'"{by}", ' if by else ""
    groups = f'(SELECT DISTINCT "{by}" FROM vals),' if by else ""
    same = f'AND g."{by}" IS NOT DISTINCT FROM b."{by}"' if by else ""
    grouped = f'g."{by}", ' if by else ""
    return f"""WITH {_TXN},
vals AS (SELECT {key}{value} AS v FROM {source} WHERE {value} IS NOT NULL),
span AS (SELECT min(v) AS lo, (max(v) - min(v)) / {bins - 1} AS w FROM vals),
b AS (SELECT {key}CAST(greatest(ceil((v - lo) / w - 0.5), 0) AS INTEGER) AS bin, count(*) AS n FROM vals, span GROUP BY ALL),
g AS (SELECT * FROM {groups} range(0, {bins}) r(i))
SELECT {grouped}CAST(i AS INTEGER) AS bin, {_r("lo + (i - 0.5) * w", "lower")}, {_r("lo + (i + 0.5) * w", "upper")},
       CAST(coalesce(n, 0) AS BIGINT) AS count
FROM g CROSS JOIN span LEFT JOIN b ON b.bin = g.i {same}"""


def _shares(weight: str, shown: str) -> str:
    return f"""WITH {_TXN}, s AS (
  SELECT *, {weight} / sum({weight}) OVER () AS st, sum({weight}) OVER (PARTITION BY LIFESTAGE) / sum({weight}) OVER () AS ls,
         {weight} / sum({weight}) OVER (PARTITION BY LIFESTAGE) AS sl FROM seg)
SELECT LIFESTAGE, PREMIUM_CUSTOMER, {shown}, {_r("st", "share_total")}, {_r("ls", "lifestage_share")},
       {_r("sl", "share_in_lifestage")},
       regexp_replace(CAST(CAST(round(st, 3) * 100 AS DECIMAL(9, 1)) AS VARCHAR), '\\.0$', '') || ' %' AS label
FROM s"""


def _affinity(by: str) -> str:
    target = f"LIFESTAGE = '{fx.LIFESTAGE}' AND PREMIUM_CUSTOMER = '{fx.PREMIUM}'"
    other = f"LIFESTAGE <> '{fx.LIFESTAGE}' AND PREMIUM_CUSTOMER = '{fx.PREMIUM}'"
    return f"""WITH {_TXN},
a AS (SELECT {by}, sum(PROD_QTY) / (SELECT sum(PROD_QTY) FROM enr WHERE {target}) AS t FROM enr WHERE {target} GROUP BY {by}),
b AS (SELECT {by}, sum(PROD_QTY) / (SELECT sum(PROD_QTY) FROM enr WHERE {other}) AS o FROM enr WHERE {other} GROUP BY {by})
SELECT {by}, {_r("t", '"targetSegment"')}, {_r("o", "other")}, {_r("t / o", "affinity")} FROM a JOIN b USING ({by})"""


def _ttest() -> str:
    stages = ", ".join(f"'{s}'" for s in fx.TTEST_LIFESTAGES)
    n = 20000
    limit = repr(math.pi / 2)
    weight = f"CASE WHEN i IN (0, {n}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"""WITH {_TXN},
x AS (SELECT price FROM enr WHERE LIFESTAGE IN ({stages}) AND PREMIUM_CUSTOMER = '{fx.PREMIUM}'),
y AS (SELECT price FROM enr WHERE LIFESTAGE IN ({stages}) AND PREMIUM_CUSTOMER <> '{fx.PREMIUM}'),
mx AS (SELECT avg(price) AS mean_x, var_samp(price) AS vx, count(price) AS n_x FROM x),
my AS (SELECT avg(price) AS mean_y, var_samp(price) AS vy, count(price) AS n_y FROM y),
w AS (
  SELECT *, sqrt(vx / n_x + vy / n_y) AS se, (mean_x - mean_y) / sqrt(vx / n_x + vy / n_y) AS t,
         pow(vx / n_x + vy / n_y, 2) / (pow(vx / n_x, 2) / (n_x - 1) + pow(vy / n_y, 2) / (n_y - 1)) AS df
  FROM mx, my),
tail AS (
  SELECT sum({weight} * pow(cos(a + i * ({limit} - a) / {n}), df - 1)) * ({limit} - a) AS part,
         2 * sum({weight} * pow(cos(i * {limit} / {n}), df - 1)) * {limit} AS whole
  FROM (SELECT atan(t / sqrt(df)) AS a, df FROM w), range(0, {n + 1}) r(i) GROUP BY a, df),
{_grid(0.95, "df", "w")}
SELECT {_r("mean_x", "mean_x")}, {_r("mean_y", "mean_y")}, n_x, n_y, {_r("t", "t")}, {_r("w.df", "df", 4)},
       {_r("part / whole", "p_value")}, {_r("log10(part / whole)", "p_log10")}, {_r("mean_x - mean_y - q * se", "ci_low", 4)}
FROM w, tail, quant"""


def _null_counts() -> str:
    columns = (
        "DATE STORE_NBR LYLTY_CARD_NBR TXN_ID PROD_NAME PROD_QTY TOT_SALES PACK_SIZE BRAND "
        "LIFESTAGE PREMIUM_CUSTOMER"
    ).split()
    parts = [
        f"SELECT '{c}' AS \"column\", count(*) - count(\"{c}\") AS n_null FROM gapped_enr" for c in columns
    ]
    cells = " UNION ALL ".join(parts)
    return f"""WITH {_GAPPED}, cells AS ({cells})
SELECT "column", CAST(n_null AS BIGINT) AS n_null FROM cells
UNION ALL SELECT '(total)', CAST(sum(n_null) AS BIGINT) FROM cells"""


def _schema(table: str, columns: dict[str, str]) -> str:
    rows = ", ".join(f"('{c}', '{t}')" for c, t in columns.items())
    return f"""SELECT c AS "column", t AS type, n_obs
FROM (VALUES {rows}) v(c, t), (SELECT count(*) AS n_obs FROM {table})"""


def _calendar(days: str) -> str:
    return f"""cal AS (
  SELECT CAST(unnest(generate_series(min("DATE"), max("DATE"), INTERVAL 1 DAY)) AS DATE) AS "DATE" FROM {days})"""


def _repeats(keys: str, limit: int | None = None) -> str:
    last = ", ".join(f"{key} NULLS LAST" for key in keys.split(", "))
    tail = f" ORDER BY count DESC, {last} LIMIT {limit}" if limit else ""
    return f"WITH {_GAPPED} SELECT {keys}, count(*) AS count FROM gapped_kept GROUP BY {keys} HAVING count(*) > 1{tail}"


def _average(expr: str, top: int | None = None) -> str:
    tail = f' ORDER BY "AVG" DESC, LIFESTAGE, PREMIUM_CUSTOMER LIMIT {top}' if top else ""
    return f"""WITH {_TXN} SELECT LIFESTAGE, PREMIUM_CUSTOMER, {_r(expr, '"AVG"')} FROM seg{tail}"""


def _pct(**variant) -> str:
    return f"""WITH {_assess_ctes(**variant)}
SELECT trial, metric, YEARMONTH, {_r("scaled", "scaled", 4)}, {_r("observed", "trial_value", 2)}, {_r("pct_diff", "pct_diff")}, {_r("sd", "sd_pre")}
FROM diff JOIN sds USING (trial, metric)"""


def _control(mixed: bool = False) -> str:
    return f"WITH {_store_ctes(mixed)} SELECT Store1, Store2, {_r('finalControlScore', 'finalControlScore')} FROM ctl"


def _bands(band: str) -> str:
    value = _r("value", "value", 4)
    return f"""WITH {_assess_ctes(band=band)},
lines AS (
  SELECT trial, metric, YEARMONTH, 'Trial' AS series, trial_value AS value FROM t
  UNION ALL SELECT trial, metric, YEARMONTH, 'Control', raw FROM c
  UNION ALL SELECT trial, metric, YEARMONTH, 'Control upper', upper FROM banded
  UNION ALL SELECT trial, metric, YEARMONTH, 'Control lower', lower FROM banded)
SELECT trial, metric, YEARMONTH, {_MONTH1} AS TransactionMonth, series, {value} FROM lines"""


def _verdict(**variant) -> str:
    return f"""WITH {_assess_ctes(**variant)}, {_grid(D.level, f"CAST({D.df} AS DOUBLE)", "(SELECT 1)")}
SELECT trial, metric, CAST(count(*) FILTER (trial_value > upper OR trial_value < lower) AS BIGINT) AS months_outside,
       count(*) AS months_total, CAST(count(*) FILTER (pct_diff / sd > q) AS BIGINT) AS significant_months
FROM diff JOIN banded USING (trial, metric, YEARMONTH) JOIN t USING (trial, metric, YEARMONTH) JOIN sds USING (trial, metric), quant
WHERE {_IN_TRIAL} GROUP BY trial, metric"""


def _handoff() -> dict[str, str]:
    measures = f"""STORE_NBR, YEARMONTH, {_r("sum(TOT_SALES)", '"totSales"', 2)}, count(DISTINCT LYLTY_CARD_NBR) AS "nCustomers",
  {_r("count(DISTINCT TXN_ID) / count(DISTINCT LYLTY_CARD_NBR)", '"nTxnPerCust"')},
  {_r("sum(PROD_QTY) / count(DISTINCT TXN_ID)", '"nChipsPerTxn"')}, {_r("sum(TOT_SALES) / sum(PROD_QTY)", '"avgPricePerUnit"')}"""
    dated = """dated AS (SELECT *, CAST(year("DATE") * 100 + month("DATE") AS INTEGER) AS YEARMONTH,
  CAST(year("DATE") * 10 + quarter("DATE") AS INTEGER) AS QUARTER FROM txn)"""
    nulls = " ".join(
        f"UNION ALL SELECT 'null_{c}', CAST(count(*) - count(\"{c}\") AS VARCHAR) FROM e"
        for c in [*_TXN_TYPES, "PACK_SIZE", "BRAND", "LIFESTAGE", "PREMIUM_CUSTOMER"]
    )
    return {
        "store_measures_bucketed": f"WITH {_TXN}, {dated} SELECT {measures} FROM dated GROUP BY STORE_NBR, YEARMONTH",
        "store_measures_from_state": f"""WITH {_TXN}, {dated} SELECT {measures} FROM dated
WHERE YEARMONTH <> {fx.RESTATED_MONTH} OR PROD_QTY >= {fx.RESTATED_QTY} GROUP BY STORE_NBR, YEARMONTH""",
        "store_customers_quarter": f"""WITH {_TXN}, {dated} SELECT STORE_NBR, QUARTER, count(DISTINCT LYLTY_CARD_NBR) AS "nCustomers"
FROM dated GROUP BY STORE_NBR, QUARTER""",
        "segment_customers_quarter": f"""WITH {_TXN}, {dated} SELECT LIFESTAGE, PREMIUM_CUSTOMER, QUARTER, count(DISTINCT LYLTY_CARD_NBR) AS CUSTOMERS
FROM dated LEFT JOIN cust USING (LYLTY_CARD_NBR) GROUP BY ALL""",
        "handoff_checks": f"""WITH {_GAPPED},
e AS (SELECT * FROM gapped_enr WHERE PROD_NAME IS NULL OR NOT contains(PROD_NAME, '{fx.EXCLUDED}'))
SELECT 'n' AS "check", CAST(count(*) AS VARCHAR) AS value FROM e {nulls}
UNION ALL SELECT 'first_day', CAST(min("DATE") AS VARCHAR) FROM e UNION ALL SELECT 'last_day', CAST(max("DATE") AS VARCHAR) FROM e
UNION ALL SELECT 'n_days', CAST(count(DISTINCT "DATE") AS VARCHAR) FROM e
UNION ALL SELECT 'n_excluded', CAST(count(*) AS VARCHAR) FROM e WHERE contains(PROD_NAME, '{fx.EXCLUDED}')
UNION ALL SELECT 'n_unmatched', CAST(count(*) AS VARCHAR) FROM e WHERE LIFESTAGE IS NULL""",
    }


_TXN_TYPES = {
    "DATE": "date",
    "STORE_NBR": "bigint",
    "LYLTY_CARD_NBR": "bigint",
    "TXN_ID": "bigint",
    "PROD_NAME": "string",
    "PROD_QTY": "double",
    "TOT_SALES": "double",
}
_CUST_TYPES = {"LYLTY_CARD_NBR": "bigint", "LIFESTAGE": "string", "PREMIUM_CUSTOMER": "string"}


def statements() -> dict[str, str]:
    enriched = f"""{_CONTRACT}{_MONEY}, PACK_SIZE, BRAND"""
    outlier = 'TXN_ID, LYLTY_CARD_NBR, PROD_NAME, PROD_QTY, "DATE"'
    stated = f"""cal AS (
  SELECT CAST(unnest(generate_series(DATE '{fx.FIRST_DAY}', DATE '{fx.LAST_DAY}', INTERVAL 1 DAY)) AS DATE) AS "DATE")"""
    per_day = f'daily AS (SELECT "DATE", count(*) AS count FROM clean GROUP BY "DATE"), {stated}'
    grouped = f"""CASE WHEN PREMIUM_CUSTOMER IS NULL THEN NULL WHEN PREMIUM_CUSTOMER = '{fx.PREMIUM}'
  THEN '{fx.PREMIUM}' ELSE 'Non-{fx.PREMIUM}' END AS "GROUP" """
    measures = f"""STORE_NBR, YEARMONTH, {_r("totSales", "totSales", 2)}, nCustomers, {_r("txns / nCustomers", "nTxnPerCust")},
  {_r("units / txns", "nChipsPerTxn")}, {_r("totSales / nullif(units, 0)", "avgPricePerUnit")}"""
    pair_rows = f"""WITH {_store_ctes()}, long AS (
  SELECT STORE_NBR, YEARMONTH, 'totSales' AS metric, totSales AS v FROM pre
  UNION ALL SELECT STORE_NBR, YEARMONTH, 'nCustomers', CAST(nCustomers AS DOUBLE) FROM pre)
SELECT a.STORE_NBR AS Store1, b.STORE_NBR AS Store2, a.YEARMONTH, a.metric, {_r("a.v", "v1", 2)}, {_r("b.v", "v2", 2)},
       {_r("abs(a.v - b.v)", "distance", 2)}
FROM long a JOIN long b ON a.YEARMONTH = b.YEARMONTH AND a.metric = b.metric WHERE a.STORE_NBR IN ({_TRIALS})"""
    labels = """CASE WHEN STORE_NBR = Store1 THEN 'Trial' WHEN STORE_NBR = Store2 THEN 'Control' ELSE 'Other stores' END"""

    def by_metric(table: str, prefix: str, name: str) -> str:
        rows = " UNION ALL ".join(
            f"SELECT Store1, Store2, '{metric}' AS metric, {_r(f'{prefix}_{metric}', name)} FROM {table}"
            for metric in ("totSales", "nCustomers")
        )
        return f"WITH {_store_ctes()} {rows}"

    planted = f"PROD_QTY * CASE WHEN LYLTY_CARD_NBR = {fx.OUTLIER_CARD} THEN {fx.OUTLIER_FACTOR} ELSE 1 END"
    script_one = {
        "load_transactions": f"SELECT {_CONTRACT}{_MONEY} FROM txn",
        "load_customers": "SELECT * FROM cust",
        "schema_profile": _schema("txn", _TXN_TYPES),
        "customer_schema_profile": _schema("cust", _CUST_TYPES),
        "excel_serial_dates": """SELECT DISTINCT CAST(date_diff('day', DATE '1899-12-30', "DATE") AS INTEGER) AS serial, "DATE" FROM txn""",
        "product_counts": "SELECT PROD_NAME, count(*) AS count FROM txn GROUP BY PROD_NAME",
        "product_words": r"""SELECT Words, count(*) AS "Count" FROM (
  SELECT unnest(string_split(PROD_NAME, ' ')) AS Words FROM (SELECT DISTINCT PROD_NAME FROM txn))
WHERE NOT regexp_matches(Words, '\p{Nd}') AND regexp_matches(Words, '\p{L}') GROUP BY Words""",
        "exclude_products": f"SELECT {_CONTRACT}{_MONEY} FROM kept",
        "exclude_customers": f"SELECT {_CONTRACT}{_MONEY} FROM txn WHERE LYLTY_CARD_NBR <> {fx.OUTLIER_CARD}",
        "clean_transactions": f"SELECT {_CONTRACT}{_MONEY} FROM clean",
        "qty_outliers": f"SELECT {outlier} FROM kept WHERE PROD_QTY = {fx.OUTLIER_QTY}",
        "outlier_customer_txns": f"SELECT {outlier} FROM kept WHERE LYLTY_CARD_NBR = {fx.OUTLIER_CARD}",
        "outlier_cards": f"""SELECT LYLTY_CARD_NBR, n_lines, {_r("units", "units", 2)}, {_r("largest", "largest", 2)}, {_r("middle", "median", 2)},
  {_r("(units - middle) / spread", "deviations")}
FROM (SELECT LYLTY_CARD_NBR, count(*) AS n_lines, sum({planted}) AS units, max({planted}) AS largest FROM kept
      WHERE LYLTY_CARD_NBR IS NOT NULL GROUP BY ALL),
  (SELECT median(units) AS middle, 1.482602218505602 * mad(units) AS spread
   FROM (SELECT sum({planted}) AS units FROM kept WHERE LYLTY_CARD_NBR IS NOT NULL GROUP BY LYLTY_CARD_NBR))
WHERE abs(units - middle) > 10 * spread""",
        "distinct_cards": "SELECT DISTINCT LYLTY_CARD_NBR FROM kept",
        "numeric_summary": _summary("clean", _NUMERIC),
        "numeric_summary_uncleaned": _summary("kept", _NUMERIC),
        "numeric_summary_year": _summary("""(SELECT * FROM kept WHERE year("DATE") = 1999)""", _NUMERIC),
        "customer_summary": _summary("cust", ("LYLTY_CARD_NBR",)),
        "daily_counts": 'SELECT "DATE", count(*) AS count FROM clean GROUP BY "DATE"',
        "date_coverage": """SELECT min("DATE") AS first_day, max("DATE") AS last_day, count(DISTINCT "DATE") AS n_days,
  date_diff('day', min("DATE"), max("DATE")) + 1 AS n_expected,
  date_diff('day', min("DATE"), max("DATE")) + 1 - count(DISTINCT "DATE") AS n_missing FROM clean""",
        "product_features": f"SELECT {enriched} FROM feat",
        "brand_raw": "SELECT DISTINCT PROD_NAME, RAW AS BRAND FROM branded",
        "brand_cleaned": f"SELECT DISTINCT RAW AS raw, CASE RAW {_ALIAS} ELSE RAW END AS BRAND FROM branded",
        "brand_aliases_proposed": f"SELECT * FROM (WITH {_ALIASES} SELECT * FROM links)",
        "brand_aliases_resolved": f"""SELECT * FROM (WITH RECURSIVE {_ALIASES},
best AS (SELECT alias, brand FROM links QUALIFY row_number() OVER (PARTITION BY alias ORDER BY n_brand DESC, len(brand) DESC, brand DESC) = 1),
chain AS (SELECT alias, brand FROM best UNION ALL SELECT c.alias, b.brand FROM chain c JOIN best b ON c.brand = b.alias)
SELECT alias, brand FROM chain WHERE brand NOT IN (SELECT alias FROM best))""",
        "distinct_brands": "SELECT DISTINCT BRAND FROM feat",
        "pack_size_counts": "SELECT PACK_SIZE, count(*) AS count FROM feat GROUP BY PACK_SIZE",
        "brand_counts": "SELECT RAW AS BRAND, count(*) AS count FROM branded GROUP BY RAW",
        "brand_units": f"""SELECT BRAND, {_r("u", "units")}, row_number() OVER (ORDER BY u DESC, BRAND) AS rank
FROM (SELECT BRAND, sum(PROD_QTY) AS u FROM feat GROUP BY BRAND)""",
        "unit_price": "SELECT TXN_ID, PROD_NAME, TOT_SALES / nullif(PROD_QTY, 0) AS price FROM clean",
        "text_summary": """SELECT 'transactions' AS "table", 'PROD_NAME' AS "column", count(*) AS length, 'character' AS class FROM txn
UNION ALL SELECT 'customers', c, count(*), 'character' FROM cust, (VALUES ('LIFESTAGE'), ('PREMIUM_CUSTOMER')) v(c) GROUP BY c""",
        "customers_by_lifestage": "SELECT LIFESTAGE, count(*) AS count FROM cust GROUP BY LIFESTAGE",
        "customers_by_premium": "SELECT PREMIUM_CUSTOMER, count(*) AS count FROM cust GROUP BY PREMIUM_CUSTOMER",
        "distinct_lifestages": "SELECT DISTINCT LIFESTAGE FROM cust",
        "distinct_premium_types": "SELECT DISTINCT PREMIUM_CUSTOMER FROM cust",
        "enriched_transactions": f"SELECT {enriched}, LIFESTAGE, PREMIUM_CUSTOMER FROM enr",
        "enriched_handoff": f"""SELECT CAST(year("DATE") * 100 + month("DATE") AS INTEGER) AS YEARMONTH, count(*) AS n,
  {_r("sum(TOT_SALES)", "totSales", 2)}, {_r("sum(PROD_QTY)", "units")} FROM enr GROUP BY 1""",
        "segment_sales": f"SELECT LIFESTAGE, PREMIUM_CUSTOMER, {_r('SALES', 'SALES', 2)} FROM seg",
        "segment_customers": "SELECT LIFESTAGE, PREMIUM_CUSTOMER, CUSTOMERS FROM seg",
        "price_by_group_sample": f"""SELECT {grouped}, price, TXN_ID FROM enr
ORDER BY TXN_ID, PROD_NAME, enr.price, LYLTY_CARD_NBR, "GROUP" LIMIT 6""",
        "products_of_pack_size": f"SELECT DISTINCT PROD_NAME FROM feat WHERE PACK_SIZE = {fx.PACK_SIZE}",
        "yearmonth": """SELECT DISTINCT "DATE", CAST(year("DATE") * 100 + month("DATE") AS INTEGER) AS YEARMONTH FROM txn""",
        "transaction_month": """SELECT DISTINCT CAST(year("DATE") * 100 + month("DATE") AS INTEGER) AS YEARMONTH,
  CAST(date_trunc('month', "DATE") AS DATE) AS TransactionMonth FROM txn""",
    }
    script_two = {
        "store_month_measures": f"SELECT {measures} FROM m",
        "stores_full_obs": "SELECT STORE_NBR FROM full_obs",
        "pre_trial_measures": f"SELECT {measures} FROM pre",
        "control_scores": f"""SELECT Store1, Store2, {_r("scoreNSales", '"scoreNSales"')}, {_r("scoreNCust", '"scoreNCust"')},
  {_r("finalControlScore", '"finalControlScore"')} FROM scores""",
        "store_type_labels": f"SELECT Store1 AS trial, STORE_NBR, YEARMONTH, {labels} AS Store_type FROM m, ctl",
        "store_type_trend": f"""SELECT trial, YEARMONTH, Store_type, {_r("avg(totSales)", '"totSales"', 2)}, {_r("avg(nCustomers)", '"nCustomers"')},
  {_MONTH1} AS TransactionMonth
FROM (SELECT Store1 AS trial, m.*, {labels} AS Store_type FROM m, ctl) WHERE YEARMONTH < {D.trend_end} GROUP BY trial, YEARMONTH, Store_type""",
    }
    assessed = {
        "scaling_factors": f"SELECT trial, control, metric, {_r('factor', 'factor')} FROM factors",
        "scaled_control": f"SELECT trial, metric, YEARMONTH, {_r('raw', 'raw', 2)}, {_r('factor', 'factor')}, {_r('scaled', 'scaled', 4)} FROM sc",
        "trial_window_bounds": f"""SELECT trial, min({_MONTH1}) AS first_month, max({_MONTH1}) AS last_month
FROM (SELECT trial, YEARMONTH FROM t UNION SELECT trial, YEARMONTH FROM c) WHERE {_IN_TRIAL} GROUP BY trial""",
    }
    t_values = f"""WITH {_assess_ctes()}, {_grid(D.level, f"CAST({D.df} AS DOUBLE)", "(SELECT 1)")}
SELECT trial, metric, {_MONTH1} AS TransactionMonth, {_r("pct_diff / sd", '"tValue"')}, {_r("q", "t_crit")}, pct_diff / sd > q AS significant
FROM diff JOIN sds USING (trial, metric), quant WHERE {_IN_TRIAL}"""
    return {
        **{key: f"WITH {_TXN}\n{sql}" for key, sql in script_one.items()},
        "repeat_customers_top50": _repeats("LYLTY_CARD_NBR", 50),
        "repeat_txns_top10": _repeats("TXN_ID", 10),
        "repeat_card_txn": _repeats("LYLTY_CARD_NBR, TXN_ID"),
        "calendar_days": f'WITH {_TXN}, {_calendar("txn")} SELECT "DATE" FROM cal',
        "daily_counts_calendar": f'WITH {_TXN}, {per_day} SELECT "DATE", count FROM cal LEFT JOIN daily USING ("DATE")',
        "daily_counts_month": f"""WITH {_TXN}, {per_day} SELECT "DATE", count FROM cal LEFT JOIN daily USING ("DATE")
WHERE month("DATE") = {fx.DECEMBER}""",
        "missing_days": f"""WITH {_TXN}, {stated} SELECT "DATE" FROM cal WHERE "DATE" NOT IN (SELECT "DATE" FROM clean)""",
        "pack_size_histogram": _histogram("feat", "PACK_SIZE", 30),
        "price_histogram_by_group": _histogram(f"(SELECT price, {grouped} FROM enr)", "price", 9, "GROUP"),
        "null_counts": _null_counts(),
        "excluded_check": f"""WITH {_GAPPED} SELECT (SELECT count(*) FROM gapped WHERE contains(PROD_NAME, '{fx.EXCLUDED}')) AS n_excluded,
  (SELECT count(*) FROM gapped_kept WHERE contains(PROD_NAME, '{fx.EXCLUDED}')) AS n_remaining""",
        "join_quality": f"""WITH {_GAPPED} SELECT CAST((SELECT count(*) FROM gapped) AS BIGINT) AS n_left, count(*) AS n_joined,
  count(*) - count(c.LYLTY_CARD_NBR) AS n_unmatched FROM gapped t LEFT JOIN cust c ON t.LYLTY_CARD_NBR = c.LYLTY_CARD_NBR""",
        "enriched_inner": f"""WITH {_GAPPED} SELECT e.* FROM gapped_enr e
WHERE (PROD_NAME IS NULL OR NOT contains(PROD_NAME, '{fx.EXCLUDED}')) AND LYLTY_CARD_NBR IN (SELECT LYLTY_CARD_NBR FROM cust)""",
        "segment_units_per_customer": _average("UNITS / CUSTOMERS"),
        "segment_avg_price": _average("SALES / nullif(UNITS, 0)"),
        "segment_avg_price_top6": _average("SALES / nullif(UNITS, 0)", 6),
        "segment_sales_share": _shares("SALES", _r("SALES", '"SALES"', 2)),
        "segment_customer_share": _shares("CUSTOMERS", "CUSTOMERS"),
        "price_ttest": _ttest(),
        "brand_affinity": _affinity("BRAND"),
        "pack_affinity": _affinity("PACK_SIZE"),
        **{key: f"WITH {_store_ctes()}\n{sql}" for key, sql in script_two.items()},
        "store_pairs": pair_rows,
        "store_correlation": by_metric("corrs", "corr", "corr_measure"),
        "store_magnitude": by_metric("mags", "mag", "mag_measure"),
        "store_correlation_function": by_metric("corrs", "corr", "corr_measure"),
        "store_magnitude_function": by_metric("mags", "mag", "mag_measure"),
        "control_store": _control(),
        "control_store_function": _control(),
        "control_store_mixed_magnitude": _control(mixed=True),
        **{key: f"WITH {_assess_ctes()}\n{sql}" for key, sql in assessed.items()},
        "trial_vs_control_pct_diff": _pct(),
        "pct_diff_sd_all_months": _pct(all_months=True),
        "pct_diff_other_store": _pct(other=True),
        "trial_t_values": t_values,
        "trial_bands": _bands("raw"),
        "trial_bands_scaled": _bands("scaled"),
        **_handoff(),
        "trial_verdict": _verdict(),
        "trial_verdict_as_written": _verdict(mixed=True, other=True, all_months=True),
    }
