"""Clustering in plain SQL: Ward's merges one by one, scores of the cuts, and two principal components."""

from __future__ import annotations

from collections.abc import Collection

# one merge a step: the closest pair, ties by the smaller ids; the smaller id stands for both
MERGES = """
wl AS (SELECT {name} AS name, {vec} AS v, {id} AS id FROM {source}),
wt AS (
  SELECT 0 AS step, id, v, 1::BIGINT AS n, [id] AS members, NULL::BIGINT AS lo, NULL::BIGINT AS hi, NULL::DOUBLE AS height FROM wl
  UNION ALL
  (WITH closest AS (SELECT a.id AS lo, b.id AS hi, list_distance(a.v, b.v) * sqrt(2.0 * a.n * b.n / (a.n + b.n)) AS h
      FROM wt a JOIN wt b ON a.id < b.id ORDER BY h, lo, hi LIMIT 1)
   SELECT step + 1, t.id,
     CASE WHEN t.id = c.lo THEN list_transform(list_zip(t.v, o.v), lambda z: (z[1] * t.n + z[2] * o.n) / (t.n + o.n)) ELSE t.v END,
     CASE WHEN t.id = c.lo THEN t.n + o.n ELSE t.n END,
     CASE WHEN t.id = c.lo THEN list_concat(t.members, o.members) ELSE t.members END, c.lo, c.hi, c.h
   FROM wt t, closest c, (SELECT w.id AS oid, w.v, w.n, w.members FROM wt w) o WHERE o.oid = c.hi AND t.id <> c.hi))
"""

# the smallest id of a cluster stands for it, so clusters are numbered by it
CUTS = """
wk AS (SELECT *, dense_rank() OVER (PARTITION BY k ORDER BY rep) AS cluster_id FROM (
  SELECT (SELECT count(*) FROM wl) - step AS k, id AS rep, unnest(members) AS id FROM wt WHERE (SELECT count(*) FROM wl) - step IN ({counts})))
"""

SCORES = """
sd AS (SELECT a.k, a.id, a.cluster_id AS own, b.cluster_id AS other, sum(list_distance(va.v, vb.v)) AS s, count(*) AS n
  FROM wk a JOIN wk b ON a.k = b.k AND a.id <> b.id JOIN wl va ON va.id = a.id JOIN wl vb ON vb.id = b.id GROUP BY ALL),
ss AS (SELECT k, id, CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END AS sil FROM (
  SELECT k, id, own, max(CASE WHEN own = other THEN s / n END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM sd GROUP BY ALL)),
sm AS (SELECT k, avg(sil) AS sil FROM ss GROUP BY k),
chosen AS (SELECT k FROM sm {choice}),
wx AS (SELECT k, cluster_id, id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS dim FROM wk JOIN wl USING (id)),
wm AS (SELECT k, cluster_id, dim, avg(x) AS m, count(*) AS n FROM wx GROUP BY ALL),
wg AS (SELECT k, dim, avg(x) AS m FROM wx GROUP BY ALL),
wb AS (SELECT k, sum(wm.n * (wm.m - wg.m) ** 2) AS b FROM wm JOIN wg USING (k, dim) GROUP BY k),
ww AS (SELECT k, sum((x - m) ** 2) AS w, count(DISTINCT id) AS members FROM wx JOIN wm USING (k, cluster_id, dim) GROUP BY k),
ch AS (SELECT k, b / w * (members - k) / (k - 1) AS ch FROM wb JOIN ww USING (k)),
sc AS (SELECT k, cluster_id, avg(d) AS s FROM (
  SELECT k, cluster_id, id, sqrt(sum((x - m) ** 2)) AS d FROM wx JOIN wm USING (k, cluster_id, dim) GROUP BY ALL) GROUP BY ALL),
pd AS (SELECT a.k, a.cluster_id AS i, b.cluster_id AS j, sqrt(sum((a.m - b.m) ** 2)) AS d
  FROM wm a JOIN wm b ON a.k = b.k AND a.dim = b.dim AND a.cluster_id <> b.cluster_id GROUP BY ALL),
db AS (SELECT k, avg(w) AS db FROM (SELECT pd.k, i, max((si.s + sj.s) / d) AS w FROM pd
  JOIN sc si ON si.k = pd.k AND si.cluster_id = i JOIN sc sj ON sj.k = pd.k AND sj.cluster_id = j GROUP BY pd.k, i) GROUP BY k),
sco AS (SELECT k, sil, ch, db FROM sm JOIN ch USING (k) JOIN db USING (k))
"""

SQUARINGS = 40


def _leading(n: int) -> str:
    """The leading eigenvector of cov{n} by repeated squaring; its largest entry is positive."""
    return f"""
q{n} AS (SELECT 0 AS step, i, j, c FROM cov{n} UNION ALL
  SELECT step + 1, i, j, c / max(abs(c)) OVER () FROM (
    SELECT a.step, a.i, b.j, sum(a.c * b.c) AS c FROM q{n} a JOIN q{n} b ON a.j = b.i WHERE a.step < {SQUARINGS} GROUP BY a.step, a.i, b.j)),
u{n} AS (SELECT i AS d, c / sqrt(sum(c * c) OVER ()) AS x FROM q{n} WHERE step = {SQUARINGS}
  AND j = (SELECT i FROM q{n} WHERE step = {SQUARINGS} AND i = j ORDER BY c DESC, i LIMIT 1)),
l{n} AS (SELECT sum(a.x * c * b.x) AS l FROM cov{n} JOIN u{n} a ON a.d = i JOIN u{n} b ON b.d = j)"""


PCA = f"""
px AS (SELECT id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS d FROM wl),
pm AS (SELECT d, avg(x) AS m FROM px GROUP BY d),
pc AS (SELECT px.id, px.d, x - m AS x FROM px JOIN pm USING (d)),
cov1 AS (SELECT a.d AS i, b.d AS j, sum(a.x * b.x) / (count(*) - 1) AS c FROM pc a JOIN pc b USING (id) GROUP BY ALL),
{_leading(1)},
cov2 AS (SELECT i, j, c - (SELECT l FROM l1) * a.x * b.x AS c FROM cov1 JOIN u1 a ON a.d = i JOIN u1 b ON b.d = j),
{_leading(2)},
cp AS (SELECT id, sum(pc.x * u1.x) AS cp1, sum(pc.x * u2.x) AS cp2 FROM pc JOIN u1 USING (d) JOIN u2 USING (d) GROUP BY id),
pv AS (SELECT (SELECT l FROM l1) / sum(c) AS v1, (SELECT l FROM l2) / sum(c) AS v2 FROM cov1 WHERE i = j)
"""

# log-ratio profiles by name, numbered in the order of names
PROFILES = {"name": "name", "vec": "clr", "id": "row_number() OVER (ORDER BY name)", "source": "cf"}


def merges(**source: str) -> str:
    return MERGES.format(**(source or PROFILES))


def analysis(counts: Collection[int], requested: int | None = None) -> list[str]:
    """The CTEs of a whole analysis of ``cf``; ``chosen`` holds the cut with the best silhouette, or the requested one."""
    choice = "ORDER BY sil DESC, k LIMIT 1" if requested is None else f"WHERE k = {requested}"
    listed = sorted({*counts, *([] if requested is None else [requested])})
    return [merges(), CUTS.format(counts=", ".join(map(str, listed))), SCORES.format(choice=choice), PCA]
