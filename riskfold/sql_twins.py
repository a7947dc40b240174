"""DuckDB twins of the cohort builders and shared CTEs.

Straightforward SQL (global windows, percentile aggregates, fold-expanded
joins) that states each operator's meaning independently of the Spark plan;
used as the correctness oracle at small scale.
"""

from __future__ import annotations

from riskfold.config import Cohort, Settings
from riskfold.sources.files import NA_TOKENS
from riskfold.sources.tables import ACCOUNTS, COHORTS, DOCS, LINES

S = Settings()


def key_text_sql(cols) -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '\\N')" for c in cols) + ")"


RAW_SQL = {
    "lines": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
       p_size, p_retailprice, l_linestatus, o_orderstatus, o_orderpriority, p_brand,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "accounts": """
SELECT c_custkey, n_orders,
       CASE WHEN substr(md5('aov|' || CAST(c_custkey AS VARCHAR)), 1, 1) = '1' THEN NULL
            ELSE avg_order_value END AS avg_order_value,
       total_order_value,
       CASE WHEN substr(md5('seg|' || CAST(c_custkey AS VARCHAR)), 1, 1) = '0' THEN NULL
            ELSE c_mktsegment END AS c_mktsegment,
       n_name, r_name,
       CASE WHEN substr(md5('target|' || CAST(c_custkey AS VARCHAR)), 1, 2) = '00' THEN NULL
            WHEN c_acctbal + 1500 < 400 * coalesce(n_orders, 0.0) THEN 'Yes' ELSE 'No' END AS negative_balance
FROM customer
LEFT JOIN (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n_orders, avg(o_totalprice) AS avg_order_value,
                  sum(o_totalprice) AS total_order_value FROM orders GROUP BY o_custkey) pc
       ON c_custkey = pc.o_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey""",
    "docs": """
SELECT n_chars, lang, source, CAST(toxic AS VARCHAR) AS toxic, quality
FROM documents JOIN labels USING (doc_id)""",
}


def clean_sql(c: Cohort) -> str:
    """raw -> (dedupe) -> row_id -> zero recode -> target cleaning."""
    feats = list(c.numeric) + list(c.categorical)
    if c.key_columns:
        rid = f"md5({key_text_sql(c.key_columns)})"
        src = "raw"
    else:
        cols = feats + [c.target]
        rid = f"md5({key_text_sql(cols)}) || '#0'"
        src = "(SELECT DISTINCT * FROM raw)"
    sel = []
    for f in feats:
        if f in c.zero_as_missing:
            sel.append(f"CASE WHEN {f} = 0 THEN NULL ELSE {f} END AS {f}")
        else:
            sel.append(f)
    t = c.target
    tcode = {"accounts": f"CASE WHEN {t} = 'Yes' THEN 1 WHEN {t} = 'No' THEN 0 END"}.get(c.key, t)
    return (f"SELECT {rid} AS row_id, {', '.join(sel)}, CAST({tcode} AS INTEGER) AS {t} "
            f"FROM {src} WHERE {t} IS NOT NULL")


def split_ctes(c: Cohort, s: Settings = S, full_fit: bool = False) -> str:
    """CTEs raw, clean, quota, split, dev (with fold), test, and the fit
    groups: every fold plus the hold-out refit (g = -1), or with
    ``full_fit`` only g = -1 fitted on the whole training split and applied
    to every row (the batch job)."""
    t = c.target
    if full_fit:
        groups = """grp AS (SELECT CAST(-1 AS INTEGER) AS g),
train AS (SELECT CAST(-1 AS INTEGER) AS g, dev.* FROM dev),
applied AS (SELECT CAST(-1 AS INTEGER) AS g, dev.* FROM dev
            UNION ALL SELECT CAST(-1 AS INTEGER) AS g, test.*, NULL AS fold FROM test)"""
    else:
        groups = f"""grp AS (SELECT CAST(unnest(range(-1, {s.n_folds})) AS INTEGER) AS g),
train AS (SELECT grp.g, dev.* FROM dev JOIN grp ON dev.fold <> grp.g),
applied AS (SELECT fold AS g, dev.* FROM dev UNION ALL SELECT -1 AS g, test.*, NULL AS fold FROM test)"""
    return f"""
raw AS ({RAW_SQL[c.key]}),
clean AS ({clean_sql(c)}),
cc AS (SELECT {t} AS cls, count(*) AS n_class FROM clean GROUP BY 1),
q1 AS (SELECT cls, n_class, sum(n_class) OVER () AS n,
              CAST(ceil(sum(n_class) OVER () * {float(s.test_size)!r}) AS BIGINT) AS n_test FROM cc),
q2 AS (SELECT *, (n_test * n_class) // n AS base, (n_test * n_class) % n AS rem FROM q1),
q3 AS (SELECT *, n_test - sum(base) OVER () AS short,
              row_number() OVER (ORDER BY rem DESC, cls) AS ord FROM q2),
quota AS (SELECT cls, CAST(base + CASE WHEN ord <= short THEN 1 ELSE 0 END AS BIGINT) AS n_test_class FROM q3),
ranked AS (SELECT clean.*, row_number() OVER (PARTITION BY {t} ORDER BY md5(row_id || '|{s.seed}'), row_id) - 1 AS r
           FROM clean),
split AS (SELECT ranked.* EXCLUDE (r), CASE WHEN r < n_test_class THEN 'test' ELSE 'train' END AS split
          FROM ranked JOIN quota ON ranked.{t} = quota.cls),
tr0 AS (SELECT * FROM split WHERE split = 'train'),
fc AS (SELECT {t} AS cls, count(*) AS n_class FROM tr0 GROUP BY 1),
fo AS (SELECT cls, coalesce(sum(n_class) OVER (ORDER BY cls ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
       FROM fc),
dr AS (SELECT tr0.*, row_number() OVER (PARTITION BY {t} ORDER BY md5(row_id || '|{s.seed}'), row_id) - 1 AS r
       FROM tr0),
dev AS (SELECT dr.* EXCLUDE (r), CAST((off + r) % {s.n_folds} AS INTEGER) AS fold FROM dr JOIN fo ON dr.{t} = fo.cls),
test AS (SELECT * FROM split WHERE split = 'test'),
{groups}"""


def with_ctes(c: Cohort, body: str, extra: str = "", full_fit: bool = False) -> str:
    head = "WITH RECURSIVE " if "RECURSIVE_CTE" in extra else "WITH "
    return head + split_ctes(c, full_fit=full_fit) + (("," + extra) if extra else "") + "\n" + body


def unpivot_sql(src: str, ids: list[str], cols, cast: str = "DOUBLE") -> str:
    parts = [f"SELECT {', '.join(ids)}, '{col}' AS column, CAST({col} AS {cast}) AS value FROM {src}" for col in cols]
    return " UNION ALL ".join(parts)


def fitted_ctes(c: Cohort, s: Settings = S) -> str:
    """bounds, clipped train, medians, numeric stats, category stats, candidate features."""
    num, cat, iqr = list(c.numeric), list(c.categorical), list(c.iqr_columns)
    m = float(s.iqr_multiplier)
    parts = []
    if iqr:
        parts.append(f"""
bounds AS (SELECT g, column, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
                  quantile_cont(value, 0.25) - {m!r} * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lower,
                  quantile_cont(value, 0.75) + {m!r} * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS upper
           FROM ({unpivot_sql('train', ['g'], iqr)}) WHERE value IS NOT NULL GROUP BY g, column)""")
        bw = ", ".join(f"max(CASE WHEN column = '{x}' THEN lower END) AS lower__{x}, "
                       f"max(CASE WHEN column = '{x}' THEN upper END) AS upper__{x}" for x in iqr)
        parts.append(f"bwide AS (SELECT g, {bw} FROM bounds GROUP BY g)")
        sel = ", ".join(
            (f"CASE WHEN CAST(t.{x} AS DOUBLE) < b.lower__{x} THEN b.lower__{x} "
             f"WHEN CAST(t.{x} AS DOUBLE) > b.upper__{x} THEN b.upper__{x} ELSE CAST(t.{x} AS DOUBLE) END AS {x}")
            if x in iqr else f"CAST(t.{x} AS DOUBLE) AS {x}" for x in num)
        parts.append(f"ctrain AS (SELECT t.g, t.row_id, {sel} FROM train t JOIN bwide b ON t.g = b.g)")
    else:
        sel = ", ".join(f"CAST({x} AS DOUBLE) AS {x}" for x in num)
        parts.append(f"ctrain AS (SELECT g, row_id, {sel} FROM train)")
    if num:
        parts.append(f"""
med AS (SELECT g, column, quantile_cont(value, 0.5) AS median
        FROM ({unpivot_sql('ctrain', ['g'], num)}) WHERE value IS NOT NULL GROUP BY g, column)""")
        mw = ", ".join(f"max(CASE WHEN column = '{x}' THEN median END) AS median__{x}" for x in num)
        parts.append(f"mwide AS (SELECT g, {mw} FROM med GROUP BY g)")
        imp = " UNION ALL ".join(
            f"SELECT t.g, '{x}' AS column, coalesce(t.{x}, m.median__{x}) AS value FROM ctrain t JOIN mwide m ON t.g = m.g"
            for x in num)
        parts.append(f"""
numst AS (SELECT i.g, i.column, any_value(med.median) AS median, avg(i.value) AS mean, stddev_pop(i.value) AS sd
          FROM ({imp}) i JOIN med ON i.g = med.g AND i.column = med.column GROUP BY i.g, i.column)""")
    if cat:
        parts.append(f"""
ccount AS (SELECT g, column, value, count(*) AS n FROM ({unpivot_sql('train', ['g'], cat, 'VARCHAR')})
           WHERE value IS NOT NULL GROUP BY g, column, value),
cmode AS (SELECT g, column, value AS mode FROM (
            SELECT *, row_number() OVER (PARTITION BY g, column ORDER BY n DESC, value) AS k FROM ccount) WHERE k = 1),
catst AS (SELECT c.g, c.column, m.mode, count(*) AS n_distinct, min(c.value) AS v0, max(c.value) AS v1,
                 count(*) = 2 AS is_binary, CASE WHEN m.mode = min(c.value) THEN 0 ELSE 1 END AS fallback
          FROM ccount c JOIN cmode m ON c.g = m.g AND c.column = m.column GROUP BY c.g, c.column, m.mode)""")
    cpos_num = " UNION ALL ".join(f"SELECT '{x}' AS column, {i} AS col_pos" for i, x in enumerate(num))
    cpos_cat = " UNION ALL ".join(f"SELECT '{x}' AS column, {i} AS col_pos" for i, x in enumerate(cat))
    cand = []
    if num:
        cand.append(f"SELECT grp.g, 'numeric' AS kind, p.column, p.col_pos, CAST(NULL AS VARCHAR) AS value, "
                    f"p.column AS feature, 0 AS kr FROM grp, ({cpos_num}) p")
    if cat:
        cand.append(f"SELECT s.g, 'binary' AS kind, s.column, p.col_pos, CAST(NULL AS VARCHAR) AS value, "
                    f"s.column AS feature, 1 AS kr FROM catst s JOIN ({cpos_cat}) p ON s.column = p.column WHERE s.is_binary")
        cand.append(f"SELECT s.g, 'dummy' AS kind, s.column, p.col_pos, c.value, s.column || '_' || c.value AS feature, "
                    f"2 AS kr FROM catst s JOIN ({cpos_cat}) p ON s.column = p.column "
                    f"JOIN ccount c ON c.g = s.g AND c.column = s.column WHERE NOT s.is_binary")
    parts.append(f"""
cand0 AS ({' UNION ALL '.join(cand)}),
feats AS (SELECT g, CAST(row_number() OVER (PARTITION BY g ORDER BY kr, col_pos, value) - 1 AS INTEGER) AS pos,
                 feature, kind, column, value FROM cand0)""")
    return ",".join(parts)


def transform_long_sql(c: Cohort, rows: str = "applied") -> str:
    """(g, row_id, feature, value) for every candidate feature of each row's group."""
    num, cat, iqr = list(c.numeric), list(c.categorical), list(c.iqr_columns)
    parts = []
    for x in num:
        v = f"CAST(a.{x} AS DOUBLE)"
        if x in iqr:
            lo = f"(SELECT lower FROM bounds b WHERE b.g = a.g AND b.column = '{x}')"
            hi = f"(SELECT upper FROM bounds b WHERE b.g = a.g AND b.column = '{x}')"
            v = f"CASE WHEN {v} < {lo} THEN {lo} WHEN {v} > {hi} THEN {hi} ELSE {v} END"
        parts.append(
            f"SELECT a.g, a.row_id, '{x}' AS feature, "
            f"(coalesce({v}, n.median) - n.mean) / CASE WHEN n.sd = 0 THEN 1.0 ELSE n.sd END AS value "
            f"FROM {rows} a JOIN numst n ON n.g = a.g AND n.column = '{x}'")
    for x in cat:
        y = f"coalesce(CAST(a.{x} AS VARCHAR), s.mode)"
        parts.append(
            f"SELECT a.g, a.row_id, '{x}' AS feature, "
            f"CAST(CASE WHEN {y} = s.v0 THEN 0 WHEN {y} = s.v1 THEN 1 ELSE s.fallback END AS DOUBLE) AS value "
            f"FROM {rows} a JOIN catst s ON s.g = a.g AND s.column = '{x}' WHERE s.is_binary")
        parts.append(
            f"SELECT a.g, a.row_id, f.feature, coalesce(CAST({y} = f.value AS DOUBLE), 0.0) AS value "
            f"FROM {rows} a JOIN catst s ON s.g = a.g AND s.column = '{x}' "
            f"JOIN feats f ON f.g = a.g AND f.column = '{x}' AND f.kind = 'dummy'")
    return " UNION ALL ".join(parts)


def na_case(col: str, text: bool) -> str:
    if text:
        toks = ", ".join("'" + t.replace("'", "''") + "'" for t in NA_TOKENS)
        return f"CASE WHEN {col} IN ({toks}) THEN NULL ELSE {col} END"
    return f"CASE WHEN isnan({col}) THEN NULL ELSE {col} END"


__all__ = ["RAW_SQL", "clean_sql", "split_ctes", "with_ctes", "fitted_ctes", "transform_long_sql",
           "unpivot_sql", "na_case", "COHORTS", "LINES", "ACCOUNTS", "DOCS", "key_text_sql"]


# ----------------------------------------------------------------------------- scores and metrics
MODELS_SQL = ("(VALUES ('discount', 'Discount score'), ('tax', 'Tax score'), ('quantity', 'Quantity score'))"
              " AS m(model_key, model_name)")
SCORE_SQL = ("CASE m.model_key WHEN 'discount' THEN coalesce(l_discount, 0.0) * 10.0 "
             "WHEN 'tax' THEN l_tax * 12.5 ELSE l_quantity / 50.0 END")


def scores_cte(src: str = "dev", name: str = "scores") -> str:
    fold = "fold" if src == "dev" else "CAST(NULL AS INTEGER) AS fold"
    return f"""
{name} AS (SELECT 'status_' || o_orderstatus AS dataset_key, 'Order status ' || o_orderstatus AS dataset_name,
                  m.model_key, m.model_name, {fold}, row_id, returned AS y, {SCORE_SQL} AS score
           FROM {src}, {MODELS_SQL})"""


def metrics_cte(src: str, by: str, name: str, thr: float = 0.5) -> str:
    """(by..., roc_auc, pr_auc, recall, f1) from a score table."""
    return f"""
{name}_sc AS (SELECT {by}, score, sum(y) AS pos, count(*) - sum(y) AS neg FROM {src} GROUP BY {by}, score),
{name}_cum AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS tp_before, coalesce(sum(neg) OVER w, 0) AS fp_before,
                 sum(pos) OVER (PARTITION BY {by}) AS n_pos, sum(neg) OVER (PARTITION BY {by}) AS n_neg
               FROM {name}_sc
               WINDOW w AS (PARTITION BY {by} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_auc AS (SELECT {by},
                 CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0 THEN
                   sum(neg * (tp_before + pos / 2.0)) / (max(n_pos) * max(n_neg)) END AS roc_auc,
                 CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0 THEN
                   sum(pos * ((tp_before + pos) / (tp_before + pos + fp_before + neg)
                       + CASE WHEN tp_before + fp_before = 0 THEN 1.0 ELSE tp_before / (tp_before + fp_before) END)
                       / 2.0) / max(n_pos) END AS pr_auc
               FROM {name}_cum GROUP BY {by}),
{name}_thr AS (SELECT {by},
                 coalesce(sum(CASE WHEN score >= {thr!r} AND y = 1 THEN 1 ELSE 0 END)
                          / nullif(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END), 0), 0.0) AS recall,
                 coalesce(2 * sum(CASE WHEN score >= {thr!r} AND y = 1 THEN 1 ELSE 0 END)
                          / nullif(2 * sum(CASE WHEN score >= {thr!r} AND y = 1 THEN 1 ELSE 0 END)
                                   + sum(CASE WHEN score >= {thr!r} AND y = 0 THEN 1 ELSE 0 END)
                                   + sum(CASE WHEN score < {thr!r} AND y = 1 THEN 1 ELSE 0 END), 0), 0.0) AS f1
               FROM {src} GROUP BY {by}),
{name} AS (SELECT * FROM {name}_auc JOIN {name}_thr USING ({by}))"""


KEYS_SQL = "dataset_key, dataset_name, model_key, model_name"


def fold_metrics_ctes() -> str:
    return scores_cte() + "," + scores_cte("test", "tscores") + "," + metrics_cte(
        "scores", KEYS_SQL + ", fold", "fm") + "," + f"""
fsz AS (SELECT {KEYS_SQL}, fold, count(*) AS n_validation, sum(y) AS vp FROM scores GROUP BY {KEYS_SQL}, fold),
fold_metrics AS (
  SELECT fsz.dataset_key, fsz.dataset_name, fsz.model_key, fsz.model_name, fsz.fold,
         CAST(sum(n_validation) OVER k - n_validation AS BIGINT) AS n_train, n_validation,
         (sum(vp) OVER k - vp) / (sum(n_validation) OVER k - n_validation) AS train_positive_rate,
         vp / n_validation AS validation_positive_rate, fm.roc_auc, fm.pr_auc, fm.recall, fm.f1
  FROM fsz JOIN fm USING ({KEYS_SQL}, fold)
  WINDOW k AS (PARTITION BY fsz.dataset_key, fsz.model_key)),
cv_summary AS (
  SELECT {KEYS_SQL},
    {", ".join(f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std, min({m}) AS {m}_min, max({m}) AS {m}_max, "
               f"max({m}) - min({m}) AS {m}_range" for m in ("roc_auc", "pr_auc", "recall", "f1"))}
  FROM fold_metrics GROUP BY {KEYS_SQL}),
mranked AS (SELECT *, row_number() OVER (PARTITION BY dataset_key ORDER BY pr_auc_mean DESC, roc_auc_mean DESC,
                                          f1_mean DESC, pr_auc_std ASC, model_key) AS cv_rank FROM cv_summary),""" + \
        metrics_cte("tscores", KEYS_SQL, "test_metrics")


# ----------------------------------------------------------------------------- importance frame
IMP_CTES = """
ex AS (SELECT label AS fold, unnest(generate_series(0, len(embedding) - 1)) AS pos, unnest(embedding) AS x
       FROM embeddings),
iagg AS (SELECT fold, pos, avg(abs(CAST(x AS DOUBLE))) AS mean_abs,
                sqrt(avg(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS rms FROM ex GROUP BY fold, pos),
imp0 AS (SELECT 'embeddings' AS dataset_key, 'Embedding vectors' AS dataset_name, 'mean_abs' AS model_key,
                'Mean absolute value' AS model_name, fold, printf('f%02d', pos) AS feature, mean_abs AS mean_abs_shap
         FROM iagg
         UNION ALL
         SELECT 'embeddings', 'Embedding vectors', 'rms', 'Root mean square', fold, printf('f%02d', pos), rms FROM iagg),
imp AS (SELECT *, row_number() OVER (PARTITION BY dataset_key, model_key, fold ORDER BY mean_abs_shap DESC, feature)
               AS rank FROM imp0)"""

GK_SQL = "dataset_key, dataset_name, model_key, model_name"


def pairwise_ctes(top_k: int = 10) -> str:
    j = " AND ".join(f"p.{c} = q.{c}" for c in ("dataset_key", "model_key", "fold_a", "fold_b"))
    return IMP_CTES + f""",
xr AS (SELECT *, CAST(rank AS DOUBLE) AS ar,
              row_number() OVER (PARTITION BY dataset_key, model_key, fold ORDER BY rank, feature)
                <= least({top_k}, count(*) OVER (PARTITION BY dataset_key, model_key, fold)) AS top FROM imp),
pairs AS (SELECT a.dataset_key, a.dataset_name, a.model_key, a.model_name, a.fold AS fold_a, b.fold AS fold_b,
                 a.feature, a.ar AS ra, b.ar AS rb, a.top AS ta, b.top AS tb
          FROM xr a JOIN xr b ON a.dataset_key = b.dataset_key AND a.model_key = b.model_key
                              AND a.feature = b.feature AND a.fold < b.fold),
sp AS (SELECT {GK_SQL}, fold_a, fold_b, count(*) AS n_features, corr(ra, rb) AS rho FROM pairs
       GROUP BY {GK_SQL}, fold_a, fold_b),
kd AS (SELECT p.dataset_key, p.model_key, p.fold_a, p.fold_b,
              sum(sign(p.ra - q.ra) * sign(p.rb - q.rb)) / sqrt(sum(abs(sign(p.ra - q.ra))) * sum(abs(sign(p.rb - q.rb))))
              AS tau
       FROM pairs p JOIN pairs q ON {j} AND p.feature < q.feature GROUP BY p.dataset_key, p.model_key, p.fold_a, p.fold_b),
jc AS (SELECT dataset_key, model_key, fold_a, fold_b, CAST(least({top_k}, count(*)) AS INTEGER) AS top_k,
              sum(CASE WHEN ta AND tb THEN 1 ELSE 0 END) / sum(CASE WHEN ta OR tb THEN 1 ELSE 0 END) AS jac
       FROM pairs GROUP BY dataset_key, model_key, fold_a, fold_b),
pw AS (SELECT sp.dataset_key, sp.dataset_name, sp.model_key, sp.model_name, sp.fold_a, sp.fold_b, sp.n_features,
              jc.top_k, kd.tau AS kendall_tau, sp.rho AS spearman_rho, jc.jac AS top_k_jaccard
       FROM sp JOIN kd USING (dataset_key, model_key, fold_a, fold_b) JOIN jc USING (dataset_key, model_key, fold_a, fold_b))"""


# ----------------------------------------------------------------------------- feature selection
def selection_ctes(c: Cohort, s: Settings = S) -> str:
    """After ``fitted_ctes``: ptrain (transformed training rows), per-feature
    sample variance, |Pearson r| edges between candidate pairs, the greedy
    walk in candidate order (a recursive CTE carrying the kept list: a
    feature is dropped when an earlier kept feature is an edge neighbour;
    low-variance features are dropped first and drop nobody), ``sel``
    (g, pos, feature, var_samp, kept, reason) and ``kept_names``
    (g, feature, out_pos, safe_name)."""
    return f"""
ptrain AS MATERIALIZED ({transform_long_sql(c, "train")}),
pvar AS (SELECT g, feature, var_samp(value) AS var_samp FROM ptrain GROUP BY g, feature),
pcand AS MATERIALIZED (
  SELECT f.g, f.pos, f.feature, v.var_samp, coalesce(v.var_samp < {float(s.variance_threshold)!r}, false) AS low
  FROM feats f LEFT JOIN pvar v ON v.g = f.g AND v.feature = f.feature),
pk AS (SELECT g, pos, CAST(row_number() OVER (PARTITION BY g ORDER BY pos) AS INTEGER) AS k FROM pcand WHERE NOT low),
pvec AS MATERIALIZED (
  SELECT p.g, p.row_id, list(p.value ORDER BY c.pos) AS x
  FROM ptrain p JOIN pcand c ON c.g = p.g AND c.feature = p.feature WHERE NOT c.low GROUP BY p.g, p.row_id),
ppair AS (SELECT a.g, a.k AS ka, b.k AS kb, a.pos AS pa, b.pos AS pb FROM pk a JOIN pk b ON a.g = b.g AND a.k < b.k),
pedge AS MATERIALIZED (SELECT pr.g, pr.pa, pr.pb FROM pvec v JOIN ppair pr ON pr.g = v.g
          GROUP BY pr.g, pr.pa, pr.pb
          HAVING abs(corr(v.x[pr.ka], v.x[pr.kb])) > {float(s.correlation_threshold)!r}
             AND NOT isnan(abs(corr(v.x[pr.ka], v.x[pr.kb])))),
pstep AS MATERIALIZED (SELECT c.g, c.pos, CAST(row_number() OVER (PARTITION BY c.g ORDER BY c.pos) AS INTEGER) AS k,
                 coalesce(e.nb, []) AS nb
          FROM pcand c LEFT JOIN (SELECT g, pb, list(pa) AS nb FROM pedge GROUP BY g, pb) e
            ON e.g = c.g AND e.pb = c.pos
          WHERE NOT c.low),
walk(g, k, kept) AS (
  SELECT g, 0, CAST([] AS INTEGER[]) FROM grp
  UNION ALL
  SELECT w.g, w.k + 1,
         CASE WHEN len(list_intersect(w.kept, p.nb)) > 0 THEN w.kept ELSE list_append(w.kept, p.pos) END
  FROM walk w JOIN pstep p ON p.g = w.g AND p.k = w.k + 1),
pkept AS (SELECT g, arg_max(kept, k) AS kept FROM walk GROUP BY g),
sel AS (SELECT c.g, c.pos, c.feature, c.var_samp, NOT c.low AND list_contains(k.kept, c.pos) AS kept,
               CASE WHEN c.low THEN 'low_variance' WHEN list_contains(k.kept, c.pos) THEN NULL
                    ELSE 'correlated' END AS reason
        FROM pcand c JOIN pkept k ON k.g = c.g),
kept0 AS (SELECT g, pos, feature, CAST(row_number() OVER (PARTITION BY g ORDER BY pos) - 1 AS INTEGER) AS out_pos,
                 regexp_replace(feature, '[^A-Za-z0-9_]+', '_', 'g') AS safe FROM sel WHERE kept),
kept_names AS (SELECT g, feature, out_pos,
                      CASE WHEN d = 0 THEN safe ELSE safe || '_' || CAST(d AS VARCHAR) END AS safe_name
               FROM (SELECT *, row_number() OVER (PARTITION BY g, safe ORDER BY out_pos) - 1 AS d FROM kept0))
/* RECURSIVE_CTE */"""
