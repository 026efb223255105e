"""Plain SQL with the expected result of each query, for an independent engine."""

from __future__ import annotations

from tractwise.catalog.queries import ROBUST, SAMPLES

READS = """reads AS (
  SELECT p_brand AS dataset, CAST(replace(p_brand, 'Brand#', '') AS INT) AS brand_no,
         CASE WHEN l_linestatus = 'F' THEN 'Day0' ELSE 'treated' END AS grp,
         'r' || CAST(l_linenumber % 3 AS VARCHAR) AS sample,
         CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS read_id,
         CAST(l_quantity AS INT) AS true_len,
         CASE WHEN l_linenumber % 2 = 1
              THEN 'ATGGCGACC' || repeat('CAG', CAST(l_quantity AS INT)) || 'CAACAGCCG'
              ELSE translate(reverse('ATGGCGACC' || repeat('CAG', CAST(l_quantity AS INT)) || 'CAACAGCCG'),
                             'ACGT', 'TGCA') END AS seq
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

HIST = READS + """, hist AS (
  SELECT dataset, grp, sample, CAST(true_len AS DOUBLE) AS repeat_length,
         CAST(row_number() OVER (PARTITION BY dataset, grp, sample ORDER BY true_len) - 1 AS INT) AS pos,
         count(*) * (1 + pow(greatest(0,
           (CASE WHEN grp = 'treated' THEN 14 + (brand_no % 3) * 3 ELSE 17 END)
           - abs(true_len - (CASE WHEN grp = 'treated' THEN 19 + (brand_no % 3) * 3 ELSE 22 END))), 2)) AS reads
  FROM reads GROUP BY dataset, brand_no, grp, sample, true_len)"""

NORM = HIST + """, norm AS (
  SELECT *, (reads - lo) / (hi - lo) AS y, reads / total * 100 AS pct FROM (
    SELECT *, min(reads) OVER w AS lo, max(reads) OVER w AS hi, sum(reads) OVER w AS total
    FROM hist WINDOW w AS (PARTITION BY dataset, grp, sample))
  WHERE hi > lo)"""

GROUPS = NORM + """, needed AS (
  SELECT dataset, count(DISTINCT CASE WHEN grp = 'Day0' THEN sample END) AS n_day0,
         count(DISTINCT CASE WHEN grp = 'treated' THEN sample END) AS n_treated
  FROM norm GROUP BY dataset),
present AS (
  SELECT dataset, repeat_length AS x, count(CASE WHEN grp = 'Day0' THEN y END) AS has0,
         count(CASE WHEN grp = 'treated' THEN y END) AS has1,
         avg(CASE WHEN grp = 'Day0' THEN y END) AS day0_avg,
         avg(CASE WHEN grp = 'treated' THEN y END) AS treated_avg,
         stddev_pop(CASE WHEN grp = 'Day0' THEN y END) AS p0,
         stddev_pop(CASE WHEN grp = 'treated' THEN y END) AS p1,
         stddev_samp(CASE WHEN grp = 'Day0' THEN y END) AS s0,
         stddev_samp(CASE WHEN grp = 'treated' THEN y END) AS s1
  FROM norm GROUP BY dataset, repeat_length),
grp_table AS (
  SELECT p.*, n_day0, n_treated, treated_avg - day0_avg AS delta
  FROM present p JOIN needed n ON p.dataset = n.dataset
  WHERE has0 = n_day0 AND has1 = n_treated AND n_day0 > 0 AND n_treated > 0)"""

SETS = GROUPS + """, numbered AS (
  SELECT *, CAST(replace(dataset, 'Brand#', '') AS INT) AS no FROM grp_table),
sets AS (SELECT *, CAST(floor((no + 1) / 2) AS INT) AS pair,
                CASE WHEN no % 2 = 1 THEN 1 ELSE 2 END AS set_id FROM numbered),
thin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair, set_id ORDER BY x) - 1 AS i
                        FROM sets) WHERE i % 2 = 0),
shared AS (SELECT a.pair, a.x, a.delta AS delta_1, b.delta AS delta_2,
                  abs(a.delta - b.delta) / sqrt(2) AS sd, abs(a.delta - b.delta) / 2 AS sem
           FROM thin a JOIN thin b ON a.pair = b.pair AND a.x = b.x AND a.set_id = 1 AND b.set_id = 2)"""

EMB = """emb AS (
  SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS x,
         CAST(unnest(embedding) AS DOUBLE) AS delta FROM embeddings)"""

SERIES = GROUPS + ", " + EMB + """, series AS (
  SELECT dataset, x, delta FROM grp_table
  UNION ALL SELECT 'series_' || CAST(vec_id AS VARCHAR), CAST(x AS DOUBLE), delta FROM emb)"""


def label(value: str, tau: float) -> str:
    return (f"CASE WHEN {value} > {tau} THEN 'expansion' WHEN {value} < -{tau} THEN 'contraction' "
            "ELSE 'neutral' END")


SMOOTH = SERIES + """, smooth AS (
  SELECT dataset, x, delta, CASE WHEN count(delta) OVER f = 5 THEN avg(delta) OVER f ELSE delta END AS yf
  FROM series WHERE x <= 250
  WINDOW f AS (PARTITION BY dataset ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"""


def extended(source: str, value: str, name: str) -> str:
    """Three-point mean, the ends taking the nearest mean."""
    return f"""{name}_raw AS (
  SELECT *, CASE WHEN count({value}) OVER f = 3 THEN avg({value}) OVER f END AS m,
         row_number() OVER (PARTITION BY dataset ORDER BY x) AS rn,
         count(*) OVER (PARTITION BY dataset) AS size
  FROM {source}
  WINDOW f AS (PARTITION BY dataset ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
{name} AS (
  SELECT *, CASE WHEN rn = 1 THEN lead(m) OVER o WHEN rn = size THEN lag(m) OVER o ELSE m END AS y3
  FROM {name}_raw WINDOW o AS (PARTITION BY dataset ORDER BY x))"""


def segments(source: str, label_col: str, value: str, name: str) -> str:
    return f"""{name}_flag AS (
  SELECT *, CASE WHEN {label_col} <> lag({label_col}) OVER (PARTITION BY dataset ORDER BY x)
                 THEN 1 ELSE 0 END AS fresh FROM {source}),
{name}_run AS (
  SELECT *, sum(fresh) OVER (PARTITION BY dataset ORDER BY x ROWS UNBOUNDED PRECEDING) AS run
  FROM {name}_flag),
{name} AS (
  SELECT dataset, {label_col} AS label, min(x) AS start_rl, max(x) AS end_rl, count(*) AS len,
         avg({value}) AS mean_eff, max(abs({value})) AS max_abs
  FROM {name}_run WHERE {label_col} <> 'neutral' GROUP BY dataset, run, {label_col} HAVING count(*) >= 3)"""


TRUTH = (SMOOTH + f", marked AS (SELECT *, {label('yf', 0.0075)} AS truth_label FROM smooth), "
         + segments("marked", "truth_label", "yf", "truth"))
PRED = (TRUTH + ", " + extended("smooth", "yf", "twice")
        + f", pmarked AS (SELECT *, {label('y3', 0.0075)} AS pred_label FROM twice), "
        + segments("pmarked", "pred_label", "delta", "pred"))
#: The dynamic programme of the change points: best costs and last starts of every prefix, then back from the end.
CHANGES = SMOOTH.replace("WITH ", "") + ", " + extended("smooth", "yf", "ext") + """, pts AS (
  SELECT dataset, x, yf, y3, row_number() OVER (PARTITION BY dataset ORDER BY x, yf, y3) AS i,
         row_number() OVER (PARTITION BY dataset, x ORDER BY yf, y3) - 1 AS copy FROM ext),
scaled AS (
  SELECT *, y3 / CASE WHEN sd > 0 THEN sd ELSE 1 END AS z FROM (
    SELECT *, stddev_samp(y3) OVER (PARTITION BY dataset) AS sd FROM pts)),
summed AS (
  SELECT dataset, i, sum(z) OVER w AS a, sum(z * z) OVER w AS b FROM scaled
  WINDOW w AS (PARTITION BY dataset ORDER BY i ROWS UNBOUNDED PRECEDING)),
sums AS (
  SELECT dataset, count(*) AS n, 3 * ln(count(*)) AS pen, list_prepend(0.0::DOUBLE, list(a ORDER BY i)) AS a,
         list_prepend(0.0::DOUBLE, list(b ORDER BY i)) AS b FROM summed GROUP BY dataset HAVING count(a) > 0),
tried(dataset, t, best, starts, costs) AS (
  SELECT dataset, 0::BIGINT, []::DOUBLE[], []::BIGINT[], [-pen]::DOUBLE[] FROM sums
  UNION ALL
  SELECT s.dataset, p.t + 1, list_append(p.best, list_min(p.costs)),
         list_append(p.starts, list_position(p.costs, list_min(p.costs)) - 1),
         list_transform(range(0, p.t + 1), lambda k: list_append(p.best, list_min(p.costs))[k + 1]
           + s.b[p.t + 2] - s.b[k + 1] - pow(s.a[p.t + 2] - s.a[k + 1], 2) / (p.t + 1 - k) + ln(p.t + 1 - k) + s.pen)
  FROM tried p JOIN sums s USING (dataset) WHERE p.t <= s.n),
ends AS (SELECT p.dataset, s.n, p.starts FROM tried p JOIN sums s ON p.dataset = s.dataset AND p.t = s.n + 1),
back(dataset, start_at, end_at) AS (
  SELECT dataset, starts[n + 1], n FROM ends
  UNION ALL
  SELECT b.dataset, e.starts[b.start_at + 1], b.start_at FROM back b JOIN ends e USING (dataset) WHERE b.start_at > 0),
cuts AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY start_at) AS cp_segment FROM back),
changes AS (
  SELECT p.dataset, p.x, p.copy, p.yf, p.y3, coalesce(c.cp_segment, 1) AS cp_segment,
         avg(p.y3) OVER (PARTITION BY p.dataset, c.cp_segment) AS cp_mean
  FROM pts p LEFT JOIN cuts c ON p.dataset = c.dataset AND p.i > c.start_at AND p.i <= c.end_at)"""
PAIRS = PRED + """, pairs AS (
  SELECT p.dataset, p.label, p.start_rl, p.end_rl, abs(p.mean_eff) AS score, t.start_rl AS t_start,
         CASE WHEN t.start_rl IS NULL THEN 0
              WHEN greatest(p.end_rl, t.end_rl) - least(p.start_rl, t.start_rl) > 0
              THEN greatest(0, least(p.end_rl, t.end_rl) - greatest(p.start_rl, t.start_rl))
                   / (greatest(p.end_rl, t.end_rl) - least(p.start_rl, t.start_rl))
              ELSE 0 END AS iou
  FROM pred p LEFT JOIN truth t ON p.dataset = t.dataset AND p.label = t.label),
best AS (SELECT dataset, label, start_rl, end_rl, score, max(iou) AS best_iou FROM pairs
         GROUP BY dataset, label, start_rl, end_rl, score)"""
CURVES = PAIRS + """, sides AS (
  SELECT dataset, label FROM (SELECT DISTINCT dataset FROM series), (VALUES ('expansion'), ('contraction')) v(label)),
counts AS (
  SELECT s.dataset, s.label,
         (SELECT count(*) FROM pred p WHERE p.dataset = s.dataset AND p.label = s.label) AS n_pred,
         (SELECT count(*) FROM truth t WHERE t.dataset = s.dataset AND t.label = s.label) AS n_truth
  FROM sides s),
thresholds AS (SELECT DISTINCT dataset, label, score AS threshold FROM best),
tally AS (
  SELECT h.dataset, h.label, h.threshold, n_truth,
         (SELECT count(*) FROM best b WHERE b.dataset = h.dataset AND b.label = h.label
             AND b.score >= h.threshold AND b.best_iou >= 0.3) AS tp,
         (SELECT count(*) FROM best b WHERE b.dataset = h.dataset AND b.label = h.label
             AND b.score >= h.threshold AND b.best_iou < 0.3) AS fp,
         n_truth - (SELECT count(DISTINCT q.t_start) FROM pairs q WHERE q.dataset = h.dataset
             AND q.label = h.label AND q.score >= h.threshold AND q.iou >= 0.3) AS fn
  FROM thresholds h JOIN counts c ON c.dataset = h.dataset AND c.label = h.label
  WHERE n_truth > 0 AND n_pred > 0),
curve AS (
  SELECT dataset, label, CAST(row_number() OVER (PARTITION BY dataset, label ORDER BY threshold DESC) AS INT) AS step,
         threshold, tp, fp, fn, tp / greatest(tp + fp, 1e-9) AS precision,
         tp / greatest(tp + fn, 1e-9) AS recall, fp / greatest(fp + n_truth - tp, 1e-9) AS fpr
  FROM tally
  UNION ALL
  SELECT dataset, label, step, NULL, NULL, NULL, NULL,
         CASE WHEN step = 1 THEN 1 ELSE n_truth / (n_truth + 1e-9) END, step - 1, step - 1
  FROM counts, (VALUES (1), (2)) v(step) WHERE n_pred = 0 OR n_truth = 0)"""

USABLE = EMB + """, usable AS (
  SELECT dataset, pos, rank, n, delta FROM (
    SELECT *, count(*) OVER (PARTITION BY dataset) AS n FROM (
      SELECT 'series_' || CAST(vec_id AS VARCHAR) AS dataset, x AS pos, delta,
             row_number() OVER (PARTITION BY vec_id ORDER BY x) AS rank
      FROM emb WHERE abs(delta) > 0 AND isfinite(delta)) WHERE rank <= 175) WHERE n >= 30)"""

FEATURES = USABLE + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY delta) AS r,
         median(delta) OVER (PARTITION BY dataset) AS med,
         avg(delta) OVER (PARTITION BY dataset) AS mu FROM usable),
robust AS (
  SELECT dataset, n, avg(delta) AS mean_delta,
         avg(CASE WHEN r > floor(n * 0.1) AND r <= n - floor(n * 0.1) THEN delta END) AS trimmed_mean,
         median(delta) AS median_delta, stddev_samp(delta) AS sd_delta,
         median(abs(delta - med)) * 1.4826 AS mad_delta,
         CASE WHEN count(DISTINCT delta) >= 3
              THEN avg(pow(delta - mu, 3)) / pow(avg(pow(delta - mu, 2)), 1.5) ELSE 0 END AS skew_delta,
         quantile_cont(delta, 0.75) - quantile_cont(delta, 0.25) AS iqr_delta,
         avg(abs(delta)) AS mean_abs,
         avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0.0 END) AS prop_pos,
         avg(CASE WHEN delta < 0 THEN 1.0 ELSE 0.0 END) AS prop_neg,
         avg(CASE WHEN abs(delta) <= 0.005 THEN 1.0 ELSE 0.0 END) AS prop_neutral,
         avg(CASE WHEN delta >= 0.05 THEN 1.0 ELSE 0.0 END) AS prop_strong_pos,
         avg(CASE WHEN delta <= -0.05 THEN 1.0 ELSE 0.0 END) AS prop_strong_neg
  FROM ranked GROUP BY dataset, n),
robust_l AS (SELECT *, """ + label("mean_delta", 0.005) + """ AS true_label FROM robust)"""


def split(source: str, key: str) -> str:
    """Train/test by the rank of the md5 inside each class, topped up from the rest."""
    return f""", drawn AS (
  SELECT {key}, true_label, row_number() OVER (PARTITION BY true_label ORDER BY md5(CAST({key} AS VARCHAR)), {key}) AS rk
  FROM {source}),
sizes AS (
  SELECT count(*) AS n, count(CASE WHEN true_label = 'expansion' THEN 1 END) AS n_exp,
         count(CASE WHEN true_label = 'contraction' THEN 1 END) AS n_con,
         count(CASE WHEN true_label = 'neutral' THEN 1 END) AS n_neu,
         greatest(1, CAST(floor(0.8 * count(*)) AS BIGINT)) AS n_train FROM {source}),
quota AS (
  SELECT *, least(n_exp, CAST(round_even(n_train * (n_exp / n), 0) AS BIGINT)) AS k_exp,
         least(n_con, CAST(round_even(n_train * (n_con / n), 0) AS BIGINT)) AS k_con FROM sizes),
quotas AS (SELECT *, least(n_neu, greatest(0, n_train - k_exp - k_con)) AS k_neu FROM quota),
taken AS (
  SELECT d.*, rk <= CASE true_label WHEN 'expansion' THEN k_exp WHEN 'contraction' THEN k_con ELSE k_neu END AS first,
         n_train - k_exp - k_con - k_neu AS short FROM drawn d, quotas),
again AS (
  SELECT *, row_number() OVER (PARTITION BY first ORDER BY md5(CAST({key} AS VARCHAR)), {key}) AS rk2 FROM taken),
split AS (
  SELECT {key}, true_label, CASE WHEN first OR rk2 <= short THEN 'train' ELSE 'test' END AS split FROM again)"""


CLASSES = EMB + """, classes AS (
  SELECT vec_id, """ + label("avg(delta)", 0.005) + """ AS true_label FROM emb GROUP BY vec_id)"""


def centers(modulus: int, source: str = "emb", value: str = "delta") -> str:
    return f""", centers AS (
  SELECT label % {modulus} AS cluster, x, avg({value}) AS c FROM {source} GROUP BY label % {modulus}, x),
dists AS (
  SELECT e.vec_id, c.cluster, sqrt(sum((e.delta - c.c) * (e.delta - c.c))) AS d
  FROM emb e JOIN centers c ON e.x = c.x GROUP BY e.vec_id, c.cluster)"""


SIDES = EMB + centers(2) + """, scored AS (
  SELECT vec_id, max(CASE WHEN cluster = 1 THEN d END) AS d_exp,
         max(CASE WHEN cluster = 0 THEN d END) AS d_con FROM dists GROUP BY vec_id),
predicted AS (SELECT *, d_con - d_exp AS score,
                     CASE WHEN d_exp < d_con THEN 'expansion' ELSE 'contraction' END AS pred FROM scored)"""

BIN_SCORES = EMB + centers(3) + """, bin_scores AS (
  SELECT e.vec_id, e.x, c.c AS s, CASE WHEN e.delta > 0.0075 THEN 1 WHEN e.delta < -0.0075 THEN 0 END AS y
  FROM emb e JOIN centers c ON e.x = c.x AND e.label % 3 = c.cluster),
kept AS (SELECT * FROM bin_scores WHERE y IS NOT NULL)"""


def auc(keyed: bool) -> str:
    key = "vec_id, " if keyed else ""
    part = "PARTITION BY vec_id" if keyed else ""
    group = "GROUP BY vec_id" if keyed else ""
    return BIN_SCORES + f""", totals AS (
  SELECT *, sum(y) OVER ({part}) AS n_pos, sum(1 - y) OVER ({part}) AS n_neg,
         rank() OVER ({part} ORDER BY s) AS rk,
         count(*) OVER ({part + ", s" if keyed else "PARTITION BY s"}) AS ties,
         sum(1 - y) OVER ({part} ORDER BY s) AS neg_upto,
         sum(y) OVER ({part} ORDER BY s) AS pos_upto,
         sum(1 - y) OVER ({part + ", s" if keyed else "PARTITION BY s"}) AS neg_at,
         sum(y) OVER ({part + ", s" if keyed else "PARTITION BY s"}) AS pos_at FROM kept),
places AS (
  SELECT *, CASE WHEN y = 1 THEN (neg_upto - neg_at / 2) / n_neg END AS v1,
         CASE WHEN y = 0 THEN (n_pos - pos_upto + pos_at / 2) / n_pos END AS v0
  FROM totals WHERE n_pos > 0 AND n_neg > 0),
areas AS (
  SELECT {key}CAST(max(n_pos) AS BIGINT) AS n_pos, CAST(max(n_neg) AS BIGINT) AS n_neg,
         (sum(CASE WHEN y = 1 THEN rk + (ties - 1) / 2 END) - max(n_pos) * (max(n_pos) + 1) / 2)
           / (max(n_pos) * max(n_neg)) AS up,
         median(CASE WHEN y = 1 THEN s END) AS m1, median(CASE WHEN y = 0 THEN s END) AS m0,
         sqrt(var_samp(v1) / max(n_pos) + var_samp(v0) / max(n_neg)) AS se
  FROM places {group}),
auc AS (
  SELECT *, CASE WHEN m0 > m1 THEN 1 - up ELSE up END AS auc, 1 - up AS auc_fixed,
         greatest(0, 1 - up - 1.959963984540054 * se) AS ci_low,
         least(1, 1 - up + 1.959963984540054 * se) AS ci_high FROM areas)"""


def roc(keyed: bool) -> str:
    key = "vec_id, " if keyed else ""
    part = "PARTITION BY vec_id" if keyed else ""
    return BIN_SCORES + f""", points AS (
  SELECT {key}s AS threshold, count(CASE WHEN y = 1 THEN 1 END) AS pos,
         count(CASE WHEN y = 0 THEN 1 END) AS neg FROM kept GROUP BY {key}s),
upto AS (
  SELECT *, sum(pos) OVER ({part} ORDER BY threshold) AS hits, sum(neg) OVER ({part} ORDER BY threshold) AS alarms,
         sum(pos) OVER ({part}) AS n_pos, sum(neg) OVER ({part}) AS n_neg FROM points),
usable_roc AS (SELECT * FROM upto WHERE n_pos > 0 AND n_neg > 0)
SELECT {key}{r('threshold')}, {r('alarms / n_neg', 'fpr')}, {r('hits / n_pos', 'tpr')} FROM usable_roc
UNION ALL SELECT DISTINCT {key}CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM usable_roc"""


def r(expression: str, name: str | None = None) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) + 0.0 AS {name or expression}"


def rs(*names: str) -> str:
    return ", ".join(r(n) for n in names)


def delta_csv() -> str:
    return f"""WITH {GROUPS}
SELECT dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY x) AS INT) AS pos, x, {r('delta')}
FROM grp_table"""


PLAIN = "regexp_replace(base, '(.)\\.[^.]*$', '\\1')"

def kmeans_steps(k: int, steps: int) -> str:
    """CTEs c0 .. c<steps>: centres from the label means, one pass each; a<i> holds the members."""
    text = f"c0 AS (SELECT label % {k} + 1 AS cluster, x, avg(delta) AS c FROM emb GROUP BY label % {k}, x)"
    for i in range(steps):
        text += f""",
a{i} AS (SELECT vec_id, arg_min(cluster, (d, cluster)) AS cluster FROM (
SELECT vec_id, cluster, sum((delta - c) * (delta - c)) AS d FROM emb JOIN c{i} USING (x) GROUP BY vec_id, cluster)
GROUP BY vec_id),
c{i + 1} AS (SELECT o.cluster, o.x, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN (
SELECT cluster, x, avg(delta) AS c FROM emb JOIN a{i} USING (vec_id) GROUP BY cluster, x) n
ON n.cluster = o.cluster AND n.x = o.x)"""
    return text


def mixture_steps(k: int, passes: int) -> str:
    """CTEs z0 .. (memberships) and m0 .. m<passes> (weight, mean, variance) of one free variance per bin."""
    text = kmeans_steps(k, 1) + """,
z0 AS (SELECT vec_id, cluster, 1.0::DOUBLE AS z FROM a0)"""
    for i in range(passes + 1):
        text += f""",
s{i} AS (SELECT cluster, sum(z) AS size FROM z{i} GROUP BY cluster),
u{i} AS (SELECT cluster, x, sum(z * delta) / sum(z) AS mean FROM z{i} JOIN emb USING (vec_id) GROUP BY cluster, x),
m{i} AS (SELECT cluster, x, any_value(size) / (SELECT sum(size) FROM s{i}) AS weight, any_value(mean) AS mean,
sum(z * (delta - mean) * (delta - mean)) / any_value(size) AS variance
FROM z{i} JOIN emb USING (vec_id) JOIN u{i} USING (cluster, x) JOIN s{i} USING (cluster) GROUP BY cluster, x)"""
        if i < passes:
            text += f""",
l{i} AS (SELECT vec_id, cluster, ln(any_value(weight)) - 0.5 * sum(
ln(2 * pi() * variance) + (delta - mean) * (delta - mean) / variance) AS l
FROM emb JOIN m{i} USING (x) GROUP BY vec_id, cluster),
e{i} AS (SELECT vec_id, cluster, exp(l - max(l) OVER (PARTITION BY vec_id)) AS e FROM l{i}),
z{i + 1} AS (SELECT vec_id, cluster, e / sum(e) OVER (PARTITION BY vec_id) AS z FROM e{i})"""
    return text


ORACLES: dict[str, str] = {
    "read_histograms": f"""WITH {HIST}
SELECT dataset, grp, dataset || '_' || grp || '_' || sample AS sample, pos, repeat_length, {r('reads')} FROM hist""",
    "coerce_drop": """SELECT event_id, CAST(event_id AS DOUBLE) AS x,
CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS reads
FROM events WHERE event_id % 5 > 2 AND regexp_extract(props, '([0-9]+)', 1) <> ''""",
    "read_delta_csv": delta_csv(),
    "read_fasta": f"""WITH {READS}
SELECT dataset || '_' || CASE WHEN grp = 'Day0' THEN 'd0' ELSE 'treated' END || '.fasta' AS file,
grp, read_id, seq FROM reads""",
    "repeat_length_per_read": f"""WITH {READS}
SELECT dataset, grp, sample, read_id, true_len AS restrictive, true_len + 2 AS permissive FROM reads""",
    "histogram_build": f"""WITH {READS}
SELECT dataset, grp, sample, CAST(true_len AS DOUBLE) AS repeat_length, CAST(count(*) AS DOUBLE) AS reads
FROM reads GROUP BY dataset, grp, sample, true_len""",
    "classify_group": """SELECT event_id, '/in/s' || CAST(event_id AS VARCHAR) || '_' || m || '.fasta' AS file,
CASE event_id % 7 WHEN 1 THEN 'treated' WHEN 2 THEN 'treated' WHEN 5 THEN 'treated' ELSE 'Day0' END AS grp
FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'd0' WHEN 1 THEN 'D42' WHEN 2 THEN 'untreated'
WHEN 3 THEN 'day42' WHEN 4 THEN 'Day_0' WHEN 5 THEN 'day_42' ELSE 'plain' END AS m FROM events)""",
    "partitioned_sink": f"""WITH {HIST}
SELECT CASE WHEN grp = 'Day0' THEN 'Day0_histograms' ELSE 'treated_histograms' END AS folder,
dataset || '_' || grp || '_' || sample AS sample, count(*) AS n_lengths, {r('sum(reads)', 'reads')}
FROM hist GROUP BY dataset, grp, sample""",
    "wide_delta": f"""WITH {GROUPS}, cells AS (
SELECT dataset, repeat_length AS x, {', '.join(
    f"max(CASE WHEN grp = '{s.split('_')[0]}' AND sample = '{s.split('_')[1]}' THEN y END) AS {s}" for s in SAMPLES)}
FROM norm GROUP BY dataset, repeat_length)
SELECT g.dataset, g.x AS "repeat length", {rs(*SAMPLES)}, {r('day0_avg', 'Day0_avg')}, {rs('treated_avg', 'delta')}
FROM grp_table g JOIN cells c ON g.dataset = c.dataset AND g.x = c.x""",
    "normalize_minmax": f"WITH {NORM} SELECT dataset, grp, sample, repeat_length, {r('y')} FROM norm",
    "normalize_percent": f"WITH {NORM} SELECT dataset, grp, sample, repeat_length, {r('pct', 'y')} FROM norm",
    "valid_samples": f"""WITH {HIST}
SELECT dataset, grp, sample, count(*) AS n_lengths, {r('max(reads) - min(reads)', 'reads_range')}
FROM hist GROUP BY dataset, grp, sample HAVING max(reads) > min(reads)""",
    "sample_name": """SELECT event_id, '/out/' || event_type || '/' || stem || tail AS path,
CASE WHEN tail = '.v2.tsv' THEN stem || '.v2' ELSE stem END AS sample
FROM (SELECT event_id, event_type, 's' || CAST(event_id AS VARCHAR) AS stem,
CASE event_id % 4 WHEN 0 THEN '.rest.histogram' WHEN 1 THEN '.per.histogram' WHEN 2 THEN '.csv' ELSE '.v2.tsv' END AS tail
FROM events)""",
    "instability_index": f"""WITH {HIST}, top AS (
SELECT *, max(reads) OVER w AS peak, first_value(pos) OVER o AS main_pos, first_value(repeat_length) OVER o AS main_len
FROM hist WINDOW w AS (PARTITION BY dataset, grp, sample),
o AS (PARTITION BY dataset, grp, sample ORDER BY reads DESC, pos)),
kept AS (SELECT *, pos - main_pos AS change FROM top WHERE reads > 0.05 * peak),
idx AS (SELECT dataset, grp, sample, max(main_len) AS mode, max(peak) AS highest_peak,
sum(reads * change) / sum(reads) AS instability_index,
coalesce(sum(CASE WHEN change < 0 THEN reads * change END), 0) / sum(reads) AS contraction_index,
coalesce(sum(CASE WHEN change > 0 THEN reads * change END), 0) / sum(reads) AS expansion_index
FROM kept GROUP BY dataset, grp, sample)
SELECT dataset, grp, sample, mode, {rs('highest_peak', 'instability_index', 'contraction_index', 'expansion_index')}
FROM idx""",
    "instability_results": f"""WITH {HIST}, top AS (
SELECT *, max(reads) OVER w AS peak, first_value(pos) OVER o AS main_pos, first_value(repeat_length) OVER o AS main_len
FROM hist WINDOW w AS (PARTITION BY dataset, grp, sample),
o AS (PARTITION BY dataset, grp, sample ORDER BY reads DESC, pos)),
kept AS (SELECT *, pos - main_pos AS change FROM top WHERE reads > 0.05 * peak),
idx AS (SELECT dataset, grp, sample, max(main_len) AS mode,
round_even(sum(reads * change) / sum(reads), 2) AS ii,
round_even(coalesce(sum(CASE WHEN change < 0 THEN reads * change END), 0) / sum(reads), 2) AS ci,
round_even(coalesce(sum(CASE WHEN change > 0 THEN reads * change END), 0) / sum(reads), 2) AS ei
FROM kept GROUP BY dataset, grp, sample)
SELECT dataset, grp, 'Sample: ' || sample || chr(10) || 'Mode: ' || CAST(mode AS VARCHAR) || chr(10)
|| 'Instability Index: ' || CAST(ii + 0.0 AS VARCHAR) || chr(10) || 'Contraction Index: ' || CAST(ci + 0.0 AS VARCHAR)
|| chr(10) || 'Expansion Index: ' || CAST(ei + 0.0 AS VARCHAR) || chr(10) || '__________' AS value FROM idx""",
    "peak_threshold_data": f"""WITH {HIST}, t AS (
SELECT *, 0.05 * max(reads) OVER (PARTITION BY dataset, grp, sample) AS threshold FROM hist)
SELECT dataset, grp, sample, repeat_length, {rs('reads', 'threshold')} FROM t""",
    "align_replicates": f"""WITH {NORM}, need AS (
SELECT dataset, grp, count(DISTINCT sample) AS n_samples FROM norm GROUP BY dataset, grp)
SELECT p.dataset, p.grp, p.x, n_samples, {r('group_avg')} FROM (
SELECT dataset, grp, repeat_length AS x, count(DISTINCT sample) AS has, avg(y) AS group_avg
FROM norm GROUP BY dataset, grp, repeat_length) p
JOIN need n ON p.dataset = n.dataset AND p.grp = n.grp WHERE has = n_samples""",
    "delta_table": f"WITH {GROUPS} SELECT dataset, x, {rs('day0_avg', 'treated_avg', 'delta')} FROM grp_table",
    "within_error_sd": f"""WITH {GROUPS}
SELECT dataset, x, {r('sqrt(p0 * p0 + p1 * p1)', 'err_compat')}, {r('sqrt(s0 * s0 + s1 * s1)', 'err')}
FROM grp_table""",
    "within_error_sem": f"""WITH {GROUPS}
SELECT dataset, x, {r('sqrt(p0 * p0 / (n_day0 + 1) + p1 * p1 / (n_treated + 1))', 'err_compat')},
{r('sqrt(s0 * s0 / n_day0 + s1 * s1 / n_treated)', 'err')} FROM grp_table""",
    "band_labels": f"""WITH {GROUPS}, band AS (
SELECT dataset, x, delta, 1.96 * sqrt(p0 * p0 / (n_day0 + 1) + p1 * p1 / (n_treated + 1)) AS half FROM grp_table)
SELECT dataset, x, {r('delta')}, CASE WHEN delta - half > 0.0075 THEN 'expansion'
WHEN delta + half < -0.0075 THEN 'contraction' ELSE 'neutral' END AS label FROM band""",
    "between_set_error": f"WITH {SETS} SELECT pair, x, {rs('delta_1', 'delta_2', 'sd', 'sem')} FROM shared",
    "thin_series": f"""WITH {GROUPS}
SELECT dataset, x, {r('delta')} FROM (
SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY x) - 1 AS i FROM grp_table) WHERE i % 2 = 0""",
    "delta_plot_data": f"""WITH {SETS}, kinds AS (SELECT pair, count(DISTINCT set_id) AS k FROM thin GROUP BY pair)
SELECT t.pair, t.set_id, t.x, {r('t.delta', 'delta')},
{r('CASE WHEN k = 2 THEN s.sd WHEN t.set_id = 1 THEN sqrt(p0 * p0 + p1 * p1) END', 'err')}
FROM thin t JOIN kinds USING (pair) LEFT JOIN shared s ON s.pair = t.pair AND s.x = t.x
WHERE t.x BETWEEN 0 AND 200""",
    "overlay_data": f"""WITH {GROUPS} SELECT dataset, x, {rs('day0_avg', 'treated_avg')}
FROM grp_table WHERE x BETWEEN 0 AND 200""",
    "smooth_delta": f"WITH {SMOOTH} SELECT dataset, x, {rs('delta', 'yf')} FROM smooth",
    "smooth_extend": f"WITH {SERIES}, {extended('series', 'delta', 'ext')} SELECT dataset, x, {r('y3')} FROM ext",
    "changepoint_labels": f"""WITH RECURSIVE {CHANGES}
SELECT dataset, x, CAST(copy AS INT) AS copy, {rs('yf', 'y3')}, CAST(cp_segment AS INT) AS cp_segment, {r('cp_mean')},
{label('cp_mean', 0.0075)} AS label_cp FROM changes""",
    "label_tau": f"WITH {SERIES} SELECT dataset, x, {label('delta', 0.0075)} AS label FROM series",
    "consensus_label": f"""WITH {SMOOTH}, both_l AS (
SELECT dataset, x, {label('delta', 0.0075)} AS a, {label('yf', 0.0075)} AS b FROM smooth)
SELECT dataset, x, CASE WHEN a = b THEN a ELSE 'neutral' END AS label FROM both_l""",
    "segments_truth": f"WITH {TRUTH} SELECT dataset, label, start_rl, end_rl, len, {rs('mean_eff', 'max_abs')} FROM truth",
    "segment_summary": f"""WITH {TRUTH}, lines AS (
SELECT dataset, label || ' between lengths ' || CAST(CAST(min(start_rl) AS BIGINT) AS VARCHAR) || '–'
|| CAST(CAST(max(end_rl) AS BIGINT) AS VARCHAR) AS txt FROM truth GROUP BY dataset, label)
SELECT s.dataset, coalesce(string_agg(txt, ', ' ORDER BY txt), 'no robust change segments') AS summary
FROM (SELECT DISTINCT dataset FROM series) s LEFT JOIN lines l ON l.dataset = s.dataset GROUP BY s.dataset""",
    "segment_iou": f"WITH {PAIRS} SELECT dataset, label, start_rl, end_rl, {rs('score', 'best_iou')} FROM best",
    "segment_curves": f"""WITH {CURVES}
SELECT dataset, label, step, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
{rs('threshold', 'precision', 'recall', 'fpr')}, {r('recall', 'tpr')} FROM curve""",
    "segment_auc": f"""WITH {CURVES}, steps AS (
SELECT dataset, label,
(fpr - lag(fpr) OVER a) * (recall + lag(recall) OVER a) / 2 AS roc_part,
(recall - lag(recall) OVER b) * (precision + lag(precision) OVER b) / 2 AS pr_part
FROM curve WHERE threshold IS NOT NULL
WINDOW a AS (PARTITION BY dataset, label ORDER BY fpr, step), b AS (PARTITION BY dataset, label ORDER BY recall, step)),
areas AS (SELECT dataset, label, sum(roc_part) AS auc_roc, sum(pr_part) AS auc_pr FROM steps GROUP BY dataset, label)
SELECT c.dataset, c.label, n_pred, n_truth, {rs('auc_roc', 'auc_pr')}
FROM counts c LEFT JOIN areas a ON a.dataset = c.dataset AND a.label = c.label""",
    "usable_deltas": f"WITH {USABLE} SELECT dataset, pos, rank, n, {r('delta')} FROM usable",
    "dataset_features": f"WITH {FEATURES} SELECT dataset, n, {rs(*ROBUST)}, true_label FROM robust_l",
    "first_datasets": f"WITH {USABLE} SELECT DISTINCT dataset FROM usable ORDER BY dataset LIMIT 12",
    "train_test_split": f"WITH {CLASSES} {split('classes', 'vec_id')} SELECT vec_id, true_label, split FROM split",
    "impute_median": f"""WITH {FEATURES}, gaps AS (
SELECT dataset, {', '.join(f"CASE WHEN prop_pos <= 0.55 THEN {c} END AS {c}" for c in ('mean_delta', 'sd_delta', 'skew_delta'))}
FROM robust),
med AS (SELECT median(mean_delta) AS a, median(sd_delta) AS b, median(skew_delta) AS c FROM gaps)
SELECT dataset, {r('coalesce(mean_delta, a)', 'mean_delta')}, {r('coalesce(sd_delta, b)', 'sd_delta')},
{r('coalesce(skew_delta, c)', 'skew_delta')} FROM gaps, med""",
    "zscore_train": f"""WITH {CLASSES} {split('classes', 'vec_id')}, stats AS (
SELECT x, avg(delta) AS mu, CASE WHEN stddev_samp(delta) = 0 THEN 1 ELSE stddev_samp(delta) END AS sd
FROM emb JOIN split USING (vec_id) WHERE split = 'train' GROUP BY x)
SELECT vec_id, x, {r('(delta - mu) / sd', 'z')} FROM emb JOIN stats USING (x)""",
    "zscore_matrix_all": f"""WITH {FEATURES} {split('robust_l', 'dataset')}, long AS ({' UNION ALL '.join(
    f"SELECT dataset, '{c}' AS feature, {c} AS v FROM robust" for c in ROBUST)}),
stats AS (SELECT feature, avg(v) AS mu, CASE WHEN stddev_samp(v) = 0 THEN 1 ELSE stddev_samp(v) END AS sd
FROM long JOIN split USING (dataset) WHERE split = 'train' GROUP BY feature)
SELECT dataset, split || ' / ' || true_label AS split_label, feature, {r('(v - mu) / sd', 'z')}
FROM long JOIN stats USING (feature) JOIN split USING (dataset)""",
    "delta_distribution": f"""WITH {FEATURES} {split('robust_l', 'dataset')},
ends AS (SELECT min(mean_delta) AS lo, max(mean_delta) AS hi FROM robust),
means AS (SELECT 'mean / ' || split AS panel,
CAST(least(floor((mean_delta - lo) / ((hi - lo) / 20)) + 1, 20) AS INT) AS bin FROM robust JOIN split USING (dataset), ends),
shown AS (SELECT *, min(delta) OVER (PARTITION BY dataset) AS lo, max(delta) OVER (PARTITION BY dataset) AS hi
FROM usable WHERE dataset IN (SELECT DISTINCT dataset FROM usable ORDER BY dataset LIMIT 12)),
small AS (SELECT dataset AS panel, CAST(least(floor((delta - lo) / ((hi - lo) / 40)) + 1, 40) AS INT) AS bin FROM shown)
SELECT panel, bin, count(*) AS n FROM (SELECT * FROM means UNION ALL SELECT * FROM small) GROUP BY panel, bin""",
    "bin_grid": f"""WITH {EMB}, ends AS (SELECT floor(min(x)) AS lo, ceil(max(x)) AS hi FROM emb)
SELECT CAST(i + 1 AS INT) AS bin, CAST(lo + i * 2 AS DOUBLE) AS low, CAST(lo + i * 2 + 2 AS DOUBLE) AS high,
CAST(lo + i * 2 + 1 AS DOUBLE) AS mid
FROM ends, range(0, 1000) t(i) WHERE i < floor((hi + 2 - lo) / 2)""",
    "bin_series": f"""WITH {EMB}, ends AS (SELECT min(x) AS lo, floor((max(x) + 3 - min(x)) / 3) AS p FROM emb)
SELECT CAST(vec_id AS VARCHAR) AS file, CAST(x AS DOUBLE) AS x,
CAST(least(floor((x - lo) / 3) + 1, p) AS INT) AS bin FROM emb, ends WHERE x <= lo + 3 * p""",
    "bin_means": f"""WITH {EMB}, ends AS (SELECT min(x) AS lo, floor((max(x) + 3 - min(x)) / 3) AS p FROM emb),
placed AS (SELECT vec_id, CAST(least(floor((x - lo) / 3) + 1, p) AS INT) AS bin, delta FROM emb, ends WHERE x <= lo + 3 * p),
grid AS (SELECT vec_id, CAST(b AS INT) AS bin FROM (SELECT DISTINCT vec_id FROM emb), ends, range(1, 1000) t(b) WHERE b <= p),
m AS (SELECT vec_id, bin, avg(delta) AS v FROM placed GROUP BY vec_id, bin)
SELECT CAST(g.vec_id AS VARCHAR) AS file, g.bin, {r('coalesce(v, 0)', 'value')}
FROM grid g LEFT JOIN m ON m.vec_id = g.vec_id AND m.bin = g.bin""",
    "cluster_centers": f"""WITH {EMB} {centers(3)}, types AS (
SELECT cluster, CASE WHEN avg(c) > 0.0005 THEN 'expansion-dominant' WHEN avg(c) < -0.0005 THEN 'contraction-dominant'
ELSE 'neutral-like' END AS cluster_type FROM centers GROUP BY cluster)
SELECT cluster, cluster_type, x, {r('c', 'value')} FROM centers JOIN types USING (cluster)""",
    "cluster_centroids": f"""WITH {EMB}, stats AS (
SELECT x, avg(delta) AS mu, stddev_samp(delta) AS sd FROM emb GROUP BY x),
z AS (SELECT label, x, (delta - mu) / sd AS z FROM emb JOIN stats USING (x))
SELECT label % 2 AS cluster, x, {r('avg(z)', 'value')} FROM z GROUP BY label % 2, x""",
    "kmeans_steps": f"""WITH {EMB}, {kmeans_steps(3, 4)}
SELECT CAST(cluster AS INT) AS cluster, CAST(x AS INT) AS x, {r('c', 'value')} FROM c4""",
    "mixture_steps": f"""WITH {EMB}, {mixture_steps(3, 3)}
SELECT CAST(cluster AS INT) AS cluster, CAST(x AS INT) AS x, {rs('weight', 'mean', 'variance')} FROM m3""",
    "nearest_centroid": f"WITH {SIDES} SELECT vec_id, {rs('d_exp', 'd_con', 'score')}, pred FROM predicted",
    "confusion_table": f"""WITH {SIDES}, classes AS (
SELECT vec_id, {label('avg(delta)', 0.005)} AS true_label FROM emb GROUP BY vec_id),
c AS (SELECT true_label, pred, count(*) AS n FROM predicted JOIN classes USING (vec_id) GROUP BY true_label, pred),
sides AS (SELECT * FROM (VALUES ('contraction'), ('expansion')) a(true_label), (VALUES ('contraction'), ('expansion')) b(pred))
SELECT s.true_label, s.pred AS pred_cluster, coalesce(n, 0) AS n
FROM sides s LEFT JOIN c ON c.true_label = s.true_label AND c.pred = s.pred""",
    "soft_membership": f"""WITH {EMB} {centers(3)}, w AS (SELECT vec_id, cluster, 1 / (d * d + 1e-6) AS w FROM dists)
SELECT vec_id, cluster, {r('w / sum(w) OVER (PARTITION BY vec_id)', 'weight')} FROM w""",
    "predict_bins": f"""WITH {EMB} {centers(3)}, w AS (
SELECT vec_id, cluster, d, 1 / (d * d + 1e-6) AS w FROM dists),
p AS (SELECT *, w / sum(w) OVER (PARTITION BY vec_id) AS prob,
first_value(cluster) OVER (PARTITION BY vec_id ORDER BY d, cluster) AS own FROM w)
SELECT p.vec_id, p.own AS cluster, c.x, {r('max(CASE WHEN c.cluster = own THEN c.c END)', 'hard')},
{r('sum(prob * c.c)', 'soft')}
FROM p JOIN centers c ON c.cluster = p.cluster GROUP BY p.vec_id, p.own, c.x""",
    "silhouette": """WITH v AS (SELECT vec_id, label % 2 AS cluster, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
d AS (SELECT a.vec_id, a.cluster, b.cluster AS other, sum(list_distance(a.e, b.e)) AS total, count(*) AS n
FROM v a, v b GROUP BY a.vec_id, a.cluster, b.cluster),
s AS (SELECT vec_id, cluster, max(CASE WHEN cluster = other THEN total / (n - 1) END) AS a,
min(CASE WHEN cluster <> other THEN total / n END) AS b FROM d GROUP BY vec_id, cluster)
SELECT vec_id, cluster, """ + rs("a", "b") + ", " + r("(b - a) / greatest(a, b)", "width") + " FROM s",
    "proxy_labels": f"""WITH {EMB}
SELECT vec_id, x, CASE WHEN delta > 0.0075 THEN 1 WHEN delta < -0.0075 THEN 0 END AS y_exp,
CASE WHEN delta < -0.0075 THEN 1 WHEN delta > 0.0075 THEN 0 END AS y_con FROM emb""",
    "auc_per_dataset": f"""WITH {auc(True)}
SELECT e.vec_id, n_pos, n_neg, {r('auc')} FROM (SELECT DISTINCT vec_id FROM embeddings) e
LEFT JOIN auc ON auc.vec_id = e.vec_id""",
    "auc_fixed_direction": f"""WITH {auc(True)}
SELECT e.vec_id, {r('auc_fixed')} FROM (SELECT DISTINCT vec_id FROM embeddings) e LEFT JOIN auc ON auc.vec_id = e.vec_id""",
    "auc_ci": f"""WITH {auc(True)}
SELECT e.vec_id, {rs('ci_low', 'ci_high')} FROM (SELECT DISTINCT vec_id FROM embeddings) e
LEFT JOIN auc ON auc.vec_id = e.vec_id""",
    "roc_curve": f"WITH {roc(True)}",
    "roc_overall": f"WITH {roc(False)}",
    "auc_overall": f"WITH {auc(False)} SELECT n_pos, n_neg, {rs('auc', 'auc_fixed', 'ci_low', 'ci_high')} FROM auc",
    "set_ops": f"""WITH {SETS}, a AS (SELECT pair, x FROM sets WHERE set_id = 1), b AS (SELECT pair, x FROM sets WHERE set_id = 2)
SELECT pair, x, 'intersect' AS op FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT pair, x, 'setdiff' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT pair, x, 'unique' FROM (SELECT DISTINCT pair, x FROM sets)""",
    "string_ops": """SELECT event_id, base, '.csv' AS ext, left(base, length(base) - 4) AS stem,
starts_with(base, 'Day0_') AS is_day0, event_type = 'click' AS is_click,
printf('AUC = %.3f', value) AS auc_text, printf('%.2f', value) || '%' AS percent
FROM (SELECT *, 'Day0_' || event_type || '_' || CAST(event_id AS VARCHAR) || '.CSV' AS base FROM events)""",
    "math_ops": f"""SELECT event_id, {r('sqrt(abs(value))', 'root')}, CAST(floor(value) AS BIGINT) AS low,
CAST(ceil(value) AS BIGINT) AS high, {r('least(value, 10.0)', 'capped')}, {r('greatest(value, 10.0)', 'raised')},
{r('ln(abs(value) + 1)', 'logged')}, round_even(value * 2, 0) AS even FROM events""",
}
