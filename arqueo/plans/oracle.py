"""The same results in plain SQL, for checking against another engine."""

from __future__ import annotations

from arqueo import rules
from arqueo.plans import lens
from arqueo.schema import INCOME_GROUPS, MONTHS


def _text(value: object) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_text(c) if isinstance(c, str) else str(c) for c in r) + ")" for r in rows)


def _case(key: str, values: dict) -> str:
    whens = " ".join(f"WHEN {_text(k) if isinstance(k, str) else k} THEN {_text(v) if isinstance(v, str) else v}" for k, v in values.items())
    return f"CASE {key} {whens} END"


def _suba() -> str:
    whens = " ".join(
        f"WHEN subt = {s} AND p_size <= 20 THEN {keys}[p_size % {len(keys)} + 1]"
        for s, keys in lens.OWN_KEYS.items() if keys
    )
    return f"CAST(CASE {whens} ELSE 9000000 + p_size END AS BIGINT)"


def _keys(pairs) -> str:
    return "(subt, suba) IN (" + ", ".join(f"({a}, {b})" for a, b in pairs) + ")"


def _dated() -> str:
    whens = " ".join(
        f"WHEN subt = {s} AND item = {i} AND y BETWEEN {a} AND {b} THEN {_text(g)}"
        for s, i, a, b, g in reversed(lens.CROSSWALK)
    )
    return f"CASE {whens} END"


MONTH_LIST = "[" + ", ".join(_text(m) for m in MONTHS) + "]"
GROUP_VALUES = "(VALUES " + _values([(g, i) for i, g in enumerate(INCOME_GROUPS)]) + ") gr(grp, ord)"
MODERN = (
    f"CASE WHEN {_keys(rules.FCM_KEYS)} THEN 'FCM' WHEN {_keys(rules.IPP_KEYS)} THEN 'IPP' "
    "WHEN subt = 13 THEN 'Transferencias de capital' WHEN subt = 5 THEN 'Transferencias corrientes' "
    "ELSE 'Otros ingresos' END"
)

BASE = f"""
acc0 AS (SELECT p_partkey, p_name, p_brand, p_size, CAST({_case('p_type', lens.SUBTITLES)} AS BIGINT) AS subt FROM part),
acc AS (SELECT p_partkey, subt, {_suba()} AS suba, {_case('subt', lens.SUBTITLE_NAMES)} AS subt_name,
  CAST(p_size % 10 AS BIGINT) AS item, {list(lens.ITEM_NAMES)}[p_size % 10 + 1] AS item_name,
  CAST(p_size % 7 AS BIGINT) AS asig, p_name AS asig_name,
  CASE p_size % 3 WHEN 0 THEN 'Sin Desagregación'
    WHEN 1 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' ' || p_brand
    ELSE p_brand END AS suba_name FROM acc0),
raw AS (SELECT l_orderkey * 10 + l_linenumber AS source_row, l_linenumber AS ln, l_linestatus AS ls, CAST(year(l_shipdate) AS BIGINT) + 10 AS y,
  CAST(month(l_shipdate) AS BIGINT) AS m, CAST(c_nationkey AS BIGINT) AS code, n_name AS name, r_name AS region,
  CAST(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 2 END AS BIGINT) AS tipo,
  CAST(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS BIGINT) AS serv,
  l_extendedprice AS px, l_quantity AS qty, l_discount AS disc, l_tax AS tax, acc.*
  FROM lineitem JOIN acc ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
txt AS (SELECT *, ' | ' || upper(strip_accents(subt_name)) || ' | ' || upper(strip_accents(item_name)) || ' | '
  || upper(strip_accents(asig_name)) || ' | ' || upper(strip_accents(suba_name)) AS t, {_dated()} AS dated FROM raw),
own AS (SELECT *, CASE WHEN dated IS NOT NULL THEN dated WHEN regexp_matches(t, {_text(rules.LEGACY_FCM_PATTERN)}) THEN 'FCM'
    WHEN regexp_matches(t, {_text(rules.LEGACY_IPP_PATTERN)}) THEN 'IPP' ELSE 'Otros ingresos' END AS og,
  CASE WHEN dated IS NOT NULL THEN 'legacy_crosswalk' WHEN regexp_matches(t, {_text(rules.LEGACY_FCM_PATTERN)})
    OR regexp_matches(t, {_text(rules.LEGACY_IPP_PATTERN)}) THEN 'legacy_text' ELSE 'legacy_other' END AS om FROM txt),
cl AS (SELECT *, CASE WHEN NOT (tipo = 1 AND serv = 1) THEN NULL WHEN y >= 2008 THEN {MODERN}
    WHEN subt = 6 AND og NOT IN ('IPP', 'FCM') THEN CASE WHEN regexp_matches(t, {_text(rules.LEGACY_CAPITAL_PATTERN)})
      THEN 'Transferencias de capital' ELSE 'Transferencias corrientes' END ELSE og END AS grp,
  CASE WHEN NOT (tipo = 1 AND serv = 1) THEN 'not_applicable' WHEN y >= 2008 THEN 'modern_code'
    WHEN subt = 6 AND og NOT IN ('IPP', 'FCM') THEN CASE WHEN regexp_matches(t, {_text(rules.LEGACY_CAPITAL_PATTERN)})
      THEN 'legacy_transfer_capital_keyword' ELSE 'legacy_transfer_default_current' END ELSE om END AS method,
  CASE WHEN NOT (tipo = 1 AND serv = 1) THEN 'not_applicable' WHEN y < 2008 AND subt = 6 AND og NOT IN ('IPP', 'FCM') THEN 'review'
    ELSE 'mapped' END AS status FROM own),
g AS (SELECT *, CAST(px AS DECIMAL(18,2)) AS amt FROM cl WHERE tipo = 1 AND serv = 1),
cov0 AS (SELECT y, max(CASE WHEN px <> 0 THEN m END) AS last FROM g GROUP BY y),
cov AS (SELECT y, {MONTH_LIST}[last] AS month, last, CASE WHEN last IS NULL THEN 'unknown' WHEN last = 12 THEN 'complete' ELSE 'partial' END AS st,
  last = 12 AS ok FROM cov0),
cy AS (SELECT * FROM cov WHERE st = 'complete'),
ent AS (SELECT DISTINCT code, name FROM g)
"""


def sql(tail: str, *extra: str) -> str:
    return "WITH RECURSIVE " + ", ".join([BASE.strip(), *[e.strip() for e in extra]]) + " " + tail


ANNUAL = """
hist0 AS (SELECT e.code, e.name, cy.y, gr.grp, gr.ord, cy.month, cy.st, cy.ok,
  coalesce((SELECT CAST(sum(amt) AS DOUBLE) FROM g WHERE g.code = e.code AND g.y = cy.y AND g.grp = gr.grp), 0) AS amt
  FROM ent e CROSS JOIN cy CROSS JOIN """ + GROUP_VALUES + """),
hist AS (SELECT *, CAST(sum(CAST(amt AS DECIMAL(28,2))) OVER (PARTITION BY code, y) AS DOUBLE) AS total FROM hist0)
"""
HISTORY_COLUMNS = 'last_reported_month'


def period_ctes(k: int, extra_where: str = "") -> str:
    count = 12 // k
    slots = "(VALUES " + ", ".join(f"({i})" for i in range(1, count + 1)) + ") pe(p)"
    return f"""
sums AS (SELECT code, y, (m - 1) // {k} + 1 AS p, grp, sum(amt) AS amt FROM g GROUP BY ALL),
per0 AS (SELECT e.code, e.name, cy.y, pe.p, gr.grp, gr.ord, cy.month, cy.st, cy.ok, coalesce(s.amt, 0) AS amt
  FROM ent e CROSS JOIN cy CROSS JOIN {slots} CROSS JOIN {GROUP_VALUES}
  LEFT JOIN sums s ON s.code = e.code AND s.y = cy.y AND s.p = pe.p AND s.grp = gr.grp),
per AS (SELECT *, sum(amt) OVER (PARTITION BY code, y, p) AS total FROM per0)
"""


def share_sql(part: str = "amt", whole: str = "total", zero: str = "0") -> str:
    return f"round(CASE WHEN {whole} = 0 THEN {zero} ELSE CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100 END, 6)"


ACCOUNTS = """
years AS (SELECT y FROM cy WHERE y >= 2008),
oa AS (SELECT code, y, subt, suba, sum(CASE WHEN m <= 6 THEN amt ELSE 0 END) AS s1, sum(CASE WHEN m > 6 THEN amt ELSE 0 END) AS s2
  FROM g WHERE grp = 'Otros ingresos' AND y IN (SELECT y FROM years) GROUP BY ALL),
nm0 AS (SELECT code, subt, suba, {'y': y, 'f': 'budget_' || y || '.csv', 'r': source_row} AS o, asig_name AS a,
  CASE WHEN suba_name = 'Sin Desagregación' THEN NULL ELSE suba_name END AS s,
  CASE WHEN item_name = 'Sin Desagregación' THEN NULL ELSE item_name END AS i, subt_name AS t
  FROM g WHERE grp = 'Otros ingresos' AND y IN (SELECT y FROM years)),
nm AS (SELECT code, subt, suba, max(CASE WHEN a IS NOT NULL THEN {'o': o, 'n': a} END).n AS a,
  max(CASE WHEN s IS NOT NULL THEN {'o': o, 'n': s} END).n AS s, max(CASE WHEN i IS NOT NULL THEN {'o': o, 'n': i} END).n AS i,
  max({'o': o, 'n': t}).n AS t FROM nm0 GROUP BY ALL),
lb0 AS (SELECT *, printf('%02d-%07d', subt, suba) AS acc_code,
  list_distinct(list_filter(regexp_split_to_array(lower(a), '[^a-z0-9]+'), lambda w: w <> '')) AS ta,
  list_distinct(list_filter(regexp_split_to_array(lower(s), '[^a-z0-9]+'), lambda w: w <> '')) AS ts FROM nm),
lb1 AS (SELECT code, subt, suba, acc_code, CASE WHEN a IS NOT NULL AND s IS NOT NULL THEN
    CASE WHEN contains(lower(a), lower(s)) OR (least(len(ta), len(ts)) > 0 AND len(list_intersect(ta, ts)) / least(len(ta), len(ts)) >= 0.7)
    THEN a ELSE a || ' — ' || s END ELSE coalesce(s, a, i, t, 'Cuenta ' || acc_code) END AS label FROM lb0),
lb AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY code, label) > 1 THEN label || ' (' || acc_code || ')' ELSE label END AS cuenta FROM lb1),
va0 AS (SELECT code, subt, suba, sum(abs(s1 - s2)) AS exact, CAST(sum(abs(s1 - s2)) AS DOUBLE) / (SELECT count(*) FROM years) AS mad,
  CAST(sum(s1 - s2) AS DOUBLE) / (SELECT count(*) FROM years) AS md, CAST(max(abs(s1 - s2)) AS DOUBLE) AS mx, CAST(sum(s1 + s2) AS DOUBLE) AS tot
  FROM oa GROUP BY ALL),
va AS (SELECT va0.*, e.name, lb.acc_code, lb.cuenta,
  row_number() OVER (PARTITION BY va0.code ORDER BY exact DESC, tot DESC, lb.acc_code) AS rk,
  sum(mad) OVER (PARTITION BY va0.code) AS whole
  FROM va0 JOIN lb USING (code, subt, suba) JOIN ent e ON e.code = va0.code),
comp AS (SELECT code, subt, suba, CASE WHEN rk <= 6 THEN cuenta ELSE 'Resto de otros ingresos' END AS comp, CASE WHEN rk <= 6 THEN rk ELSE 7 END AS ord FROM va),
cs AS (SELECT code, comp, ord, y, sum(s1) AS s1, sum(s2) AS s2 FROM oa JOIN comp USING (code, subt, suba) GROUP BY ALL),
bd0 AS (SELECT k.code, k.comp, k.ord, years.y, se.s, coalesce(CASE se.s WHEN 1 THEN cs.s1 ELSE cs.s2 END, 0) AS amt
  FROM (SELECT DISTINCT code, comp, ord FROM comp) k CROSS JOIN years CROSS JOIN (VALUES (1), (2)) se(s)
  LEFT JOIN cs ON cs.code = k.code AND cs.comp = k.comp AND cs.ord = k.ord AND cs.y = years.y),
bd AS (SELECT bd0.*, e.name, sum(amt) OVER (PARTITION BY bd0.code, bd0.y, bd0.s) AS total FROM bd0 JOIN ent e ON e.code = bd0.code)
"""

PROFILE = """
pf0 AS (SELECT name, """ + ", ".join(
    f'sum(CASE WHEN grp = {_text(g)} THEN amt ELSE 0 END) AS g{i}' for i, g in enumerate(INCOME_GROUPS)
) + ", sum(amt) AS tot FROM g GROUP BY name),\npf AS (SELECT name, " + ", ".join(
    f"CAST(g{i} AS DOUBLE) AS g{i}, CAST(g{i} AS DOUBLE) / CAST(tot AS DOUBLE) * 100 AS s{i}" for i in range(5)
) + """, CAST(tot AS DOUBLE) AS tot FROM pf0),
cl0 AS (SELECT name, [""" + ", ".join(f"CASE WHEN s{i} <= 0 THEN 0.001 ELSE s{i} / 100 END" for i in range(5)) + """] AS a FROM pf),
cl1 AS (SELECT name, list_transform(a, lambda x: ln(x / list_sum(a))) AS lg FROM cl0),
cf AS (SELECT name, list_transform(lg, lambda x: x - list_sum(lg) / 5) AS clr FROM cl1)
"""

# the same for every (municipality, year)
YEAR_PROFILE = PROFILE.replace("pf0 AS (SELECT name,", "pf0 AS (SELECT name || ' ' || y AS name,").replace("FROM g GROUP BY name)", "FROM g GROUP BY name || ' ' || y)")

# vectors with their label
EMB = "e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings)"
