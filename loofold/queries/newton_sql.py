"""SQL text that fits the two-feature logistic model by unrolled Newton steps."""

from __future__ import annotations

TEXT_FEATURES = """
raw AS (
  SELECT l.doc_id, CAST(l.quality AS DOUBLE) AS y,
         length(regexp_replace(text, '[A-Za-z ]', '', 'g')) * 1.0 / length(text) AS f1,
         len(list_distinct(string_split(text, ' '))) * 1.0 / len(string_split(text, ' ')) AS f2
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
st AS (SELECT avg(f1) AS m1, stddev_pop(f1) AS s1, avg(f2) AS m2, stddev_pop(f2) AS s2 FROM raw),
z AS MATERIALIZED (SELECT doc_id, y, (f1 - m1) / s1 AS z1, (f2 - m2) / s2 AS z2 FROM raw, st)"""

BUCKET = """floor(((((doc_id + {seed}) % 2147483648 * 1103515245 + 12345) % 2147483648) * 1103515245 + 12345)
  % 2147483648 * {k} / 2147483648.0)"""


def fold_bucket(k: int, seed: int = 0) -> str:
    return f"CAST({BUCKET.format(k=k, seed=seed)} AS INTEGER)"


def newton_ctes(fold: str | None, steps: int = 14) -> str:
    """CTEs ``x`` (rows with their fold) and ``w`` (f, a, b, c: weights fitted without fold f).

    ``fold`` is an expression over ``z``; without it one fit over all rows gets f = -1.
    """
    parts = [TEXT_FEATURES, f"x AS MATERIALIZED (SELECT *, {fold or '0'} AS fold FROM z)"]
    folds = "SELECT DISTINCT fold AS f FROM x" if fold else "SELECT -1 AS f"
    parts.append(f"w0 AS MATERIALIZED (SELECT f, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM ({folds}))")
    for i in range(steps):
        parts.append(f"""
s{i} AS MATERIALIZED (
  SELECT f, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c,
         sum(r * z1) + any_value(a) AS ga, sum(r * z2) + any_value(b) AS gb, sum(r) AS gc,
         sum(v * z1 * z1) + 1 AS haa, sum(v * z1 * z2) AS hab, sum(v * z1) AS hac,
         sum(v * z2 * z2) + 1 AS hbb, sum(v * z2) AS hbc, sum(v) AS hcc
  FROM (SELECT *, p - y AS r, p * (1 - p) AS v
        FROM (SELECT w.f, w.a, w.b, w.c, x.y, x.z1, x.z2, 1 / (1 + exp(-(w.a * x.z1 + w.b * x.z2 + w.c))) AS p
              FROM x JOIN w{i} w ON x.fold <> w.f))
  GROUP BY f),
w{i + 1} AS MATERIALIZED (
  SELECT f,
    a - (ga * (hbb * hcc - hbc * hbc) - hab * (gb * hcc - hbc * gc) + hac * (gb * hbc - hbb * gc)) / det AS a,
    b - (haa * (gb * hcc - hbc * gc) - ga * (hab * hcc - hbc * hac) + hac * (hab * gc - gb * hac)) / det AS b,
    c - (haa * (hbb * gc - gb * hbc) - hab * (hab * gc - gb * hac) + ga * (hab * hbc - hbb * hac)) / det AS c
  FROM (SELECT *, haa * (hbb * hcc - hbc * hbc) - hab * (hab * hcc - hbc * hac) + hac * (hab * hbc - hbb * hac) AS det
        FROM s{i}))""")
    parts.append(f"w AS (SELECT * FROM w{steps})")
    return "WITH " + ",\n".join(parts)


def _solved(source: str) -> str:
    """Adds d1..d4, the solution of the symmetric system h d = g of ``source``, by elimination."""
    name = lambda i, j, level: f"h{i}{j}" + (f"v{level}" if level else "")
    side = lambda i, level: f"g{i}" + (f"v{level}" if level else "")
    for p in (1, 2, 3):
        old = p - 1
        cells = [f"{name(i, j, old)} - {name(p, i, old)} * {name(p, j, old)} / {name(p, p, old)} AS {name(i, j, p)}" for i in range(p + 1, 5) for j in range(i, 5)]
        cells += [f"{side(i, old)} - {name(p, i, old)} * {side(p, old)} / {name(p, p, old)} AS {side(i, p)}" for i in range(p + 1, 5)]
        source = f"(SELECT *, {', '.join(cells)} FROM {source})"
    for p in (4, 3, 2, 1):
        rest = "".join(f" - {name(p, j, p - 1)} * d{j}" for j in range(p + 1, 5))
        source = f"(SELECT *, ({side(p, p - 1)}{rest}) / {name(p, p, p - 1)} AS d{p} FROM {source})"
    return source


def newton3_ctes(rows: str, fold: str, steps: int = 14) -> str:
    """CTEs ``x`` and ``w`` (f, a1, b1, a2, b2) of three classes 0, 1, 2 told from one measure.

    ``rows`` selects key, y and the measure f1; ``fold`` is an expression over key. The third class
    has the negative sum of the others' weights, as at the optimum of one penalised vector per class.
    """
    parts = [
        f"raw AS ({rows})",
        "z AS MATERIALIZED (SELECT key, y, (f1 - m) / s AS z1 FROM raw, (SELECT avg(f1) AS m, stddev_pop(f1) AS s FROM raw))",
        f"x AS MATERIALIZED (SELECT *, {fold} AS fold FROM z)",
        "w0 AS MATERIALIZED (SELECT f, 0.0::DOUBLE AS a1, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS a2, 0.0::DOUBLE AS b2 FROM (SELECT DISTINCT fold AS f FROM x))",
    ]
    for i in range(steps):
        parts.append(f"""
s{i} AS MATERIALIZED (
  SELECT f, any_value(a1) AS a1, any_value(b1) AS b1, any_value(a2) AS a2, any_value(b2) AS b2,
         sum(r1 * z1) + 2 * any_value(a1) + any_value(a2) AS g1, sum(r1) AS g2, sum(r2 * z1) + any_value(a1) + 2 * any_value(a2) AS g3, sum(r2) AS g4,
         sum(m11 * z1 * z1) + 2 AS h11, sum(m11 * z1) AS h12, sum(m12 * z1 * z1) + 1 AS h13, sum(m12 * z1) AS h14,
         sum(m11) AS h22, sum(m12 * z1) AS h23, sum(m12) AS h24, sum(m22 * z1 * z1) + 2 AS h33, sum(m22 * z1) AS h34, sum(m22) AS h44
  FROM (SELECT *, p1 - (y = 0)::INT - p3 + (y = 2)::INT AS r1, p2 - (y = 1)::INT - p3 + (y = 2)::INT AS r2,
               p1 * (1 - p1) + 2 * p1 * p3 + p3 * (1 - p3) AS m11, p2 * (1 - p2) + 2 * p2 * p3 + p3 * (1 - p3) AS m22,
               p1 * p3 + p2 * p3 + p3 * (1 - p3) - p1 * p2 AS m12
        FROM (SELECT *, e1 / (e1 + e2 + e3) AS p1, e2 / (e1 + e2 + e3) AS p2, e3 / (e1 + e2 + e3) AS p3
              FROM (SELECT w.f, w.a1, w.b1, w.a2, w.b2, x.y, x.z1, exp(a1 * z1 + b1) AS e1, exp(a2 * z1 + b2) AS e2, exp(-(a1 + a2) * z1 - b1 - b2) AS e3
                    FROM x JOIN w{i} w ON x.fold <> w.f)))
  GROUP BY f),
w{i + 1} AS MATERIALIZED (SELECT f, a1 - d1 AS a1, b1 - d2 AS b1, a2 - d3 AS a2, b2 - d4 AS b2 FROM {_solved(f"s{i}")})""")
    parts.append(f"""w AS (SELECT * FROM w{steps}),
o AS (SELECT *, e1 / (e1 + e2 + e3) AS p1, e2 / (e1 + e2 + e3) AS p2, e3 / (e1 + e2 + e3) AS p3
      FROM (SELECT x.*, exp(a1 * z1 + b1) AS e1, exp(a2 * z1 + b2) AS e2, exp(-(a1 + a2) * z1 - b1 - b2) AS e3 FROM x JOIN w ON x.fold = w.f)),
judged AS (SELECT key, fold, y, greatest(p1, p2, p3) AS p, CASE WHEN p1 >= p2 AND p1 >= p3 THEN 0 WHEN p2 >= p3 THEN 1 ELSE 2 END AS z FROM o)""")
    return "WITH " + ",\n".join(parts)


SCORED = "SELECT x.*, w.a * z1 + w.b * z2 + w.c AS eta FROM x JOIN w ON {on}"
MCC = """
SELECT tp, tn, fp, fn, round(CASE WHEN d = 0 THEN 0 ELSE (tp * 1.0 * tn - fp * 1.0 * fn) / sqrt(d) END, 6) + 0.0 AS mcc
FROM (SELECT *, (tp + fp)::DOUBLE * (tp + fn)::DOUBLE * (tn + fp)::DOUBLE * (tn + fn)::DOUBLE AS d FROM (
  SELECT count(*) FILTER (WHERE y = 1 AND z = 1) AS tp, count(*) FILTER (WHERE y = 0 AND z = 0) AS tn,
         count(*) FILTER (WHERE y = 0 AND z = 1) AS fp, count(*) FILTER (WHERE y = 1 AND z = 0) AS fn
  FROM ({labelled})))"""
