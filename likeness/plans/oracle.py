"""SQL counterparts of the registered queries, on the same tables.

They spell every definition out row by row (all pairs, every fold from scratch, one recursion
step per group), where the jobs use partial sums, blocks and closed forms.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

EMB = """e AS (
  SELECT 'emb' AS cell, vec_id AS item, 0 AS win, CAST(label AS VARCHAR) AS ind,
         CAST(vec_id % 25 AS VARCHAR) AS grp, CAST(vec_id % 4 AS VARCHAR) AS stratum,
         CAST(label % 3 AS VARCHAR) AS family,
         CASE WHEN CAST(embedding[1] AS DOUBLE) >= 0 THEN 'single' ELSE 'repeated' END AS kind,
         CAST(embedding AS DOUBLE[]) AS v
  FROM embeddings)"""

HALVES = """w AS (
  SELECT cell, item, 0 AS win, ind, grp, stratum, family, kind, v[1:32] AS v FROM e
  UNION ALL
  SELECT cell, item, 1 AS win, ind, grp, stratum, family, kind, v[33:64] AS v FROM e)"""


def sql(*ctes: str, select: str) -> str:
    flat = [" ".join(c.split()) for c in ctes]
    recursive = "RECURSIVE " if any("UNION ALL SELECT go." in c or "UNION ALL SELECT step." in c for c in flat) else ""
    return f"WITH {recursive}" + ",\n".join(ctes) + "\n" + select


def unit(src: str, out: str, v: str = "v") -> str:
    """Add ``u``: the unit vector."""
    return f"""{out} AS (
  SELECT * EXCLUDE (nn_), list_transform({v}, lambda x: x / CASE WHEN nn_ = 0 THEN 1.0 ELSE nn_ END) AS u
  FROM (SELECT *, sqrt(list_dot_product({v}, {v})) AS nn_ FROM {src}))"""


def group_folds(src: str, out: str, p: str = "") -> str:
    """Greedy: largest group to the lightest fold, one recursion step per group."""
    return f"""{p}gs AS (SELECT cell, grp, count(*) AS n FROM {src} GROUP BY cell, grp),
{p}go AS (
  SELECT cell, grp, n, count(*) OVER (PARTITION BY cell) AS ng,
         row_number() OVER (PARTITION BY cell ORDER BY n DESC, md5('42|group_fold|' || grp), grp) AS rn
  FROM {p}gs),
{p}gr AS (
  SELECT DISTINCT cell, CAST(0 AS BIGINT) AS rn, CAST('' AS VARCHAR) AS grp, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS fold,
         list_transform(range(least(5, ng)), lambda i: CAST(0 AS BIGINT)) AS loads
  FROM {p}go
  UNION ALL
  SELECT go.cell, go.rn, go.grp, go.n, CAST(list_position(r.loads, list_min(r.loads)) - 1 AS BIGINT),
         list_transform(r.loads, lambda x, i: CASE WHEN i = list_position(r.loads, list_min(r.loads)) THEN x + go.n ELSE x END)
  FROM {p}gr r JOIN {p}go go ON go.cell = r.cell AND go.rn = r.rn + 1),
{p}gf AS (SELECT cell, grp, n, fold FROM {p}gr WHERE rn > 0),
{out} AS (SELECT s.*, g.fold FROM {src} s JOIN {p}gf g ON s.cell = g.cell AND s.grp = g.grp)"""


def dealt_folds(src: str, out: str, purpose: str = "stratified_fold", label: str = "ind", k: str = "5") -> str:
    """Rows in (class, digest) order dealt round-robin."""
    return f"""{out} AS (
  SELECT *, (row_number() OVER (PARTITION BY cell ORDER BY md5({label}), {label},
             md5('42|{purpose}|' || CAST(item AS VARCHAR)), item) - 1) % {k} AS fold
  FROM {src})"""


def template_predictions(src: str, out: str, p: str = "", label: str = "ind", query: str | None = None,
                         query_key: str = "item, win", rule: str = "all") -> str:
    """``src(cell, fold, item, win, label, u)``; ``query(cell, fold, key, label, u)`` defaults to src."""
    query = query or src
    keys = ", ".join(f"q.{k.strip()}" for k in query_key.split(","))
    keep = f"JOIN {p}everyone k ON k.cell = q.cell AND k.fold = q.fold" if rule == "all" else ""
    return f"""{p}parts AS (
  SELECT cell, fold, {label} AS lab, unnest(range(1, len(u) + 1)) AS d, unnest(u) AS x FROM {src}),
{p}fl AS (SELECT DISTINCT cell, fold FROM {src}),
{p}sums AS (
  SELECT f.cell, f.fold, p.lab, p.d, sum(p.x) AS s
  FROM {p}fl f JOIN {p}parts p ON p.cell = f.cell AND p.fold <> f.fold GROUP BY f.cell, f.fold, p.lab, p.d),
{p}raw AS (SELECT cell, fold, lab, list(s ORDER BY d) AS t FROM {p}sums GROUP BY cell, fold, lab),
{unit(p + "raw", p + "tpl", "t")},
{p}labs AS (SELECT cell, count(DISTINCT {label}) AS k FROM {src} GROUP BY cell),
{p}everyone AS (
  SELECT t.cell, t.fold FROM {p}tpl t JOIN {p}labs l ON l.cell = t.cell
  GROUP BY t.cell, t.fold, l.k HAVING count(*) = l.k),
{p}cand AS (
  SELECT q.cell, q.fold, {keys}, q.{label} AS truth, t.lab AS pred, round(list_dot_product(q.u, t.u), 9) AS score
  FROM {query} q JOIN {p}tpl t ON t.cell = q.cell AND t.fold = q.fold {keep}),
{out} AS (
  SELECT * EXCLUDE (rk) FROM (
    SELECT *, row_number() OVER (PARTITION BY cell, fold, {query_key}, truth ORDER BY score DESC, pred) AS rk FROM {p}cand)
  WHERE rk = 1)"""


def probe_predictions(src: str, out: str, p: str = "", label: str = "ind", rule: str = "all", rate: float = 0.9,
                      steps: int = 400) -> str:
    """Multinomial logistic regression by accelerated gradient descent, per cell and fold on the other folds.

    ``src(cell, fold, item, win, label, v)``. Mean cross-entropy plus |w|^2 / (2 n), the intercept free, on vectors
    standardised on the train rows. All products are whole-list dot products, by row for the scores and by
    dimension for the gradient. ``rate`` must not exceed 2 over the largest eigenvalue of the train rows' second
    moments.
    """
    keep = f"""JOIN (SELECT t.cell FROM {p}tr t JOIN {p}fit f ON f.cell = t.cell
    JOIN (SELECT cell, count(DISTINCT {label}) AS k FROM {src} GROUP BY cell) l ON l.cell = f.part
    GROUP BY t.cell, l.k HAVING count(DISTINCT t.lab) = l.k) k ON k.cell = x.cell""" if rule == "all" else ""
    return f"""{p}fit AS MATERIALIZED (
  SELECT DISTINCT cell AS part, fold, cell || '/' || fold AS cell FROM {src}),
{p}fx AS MATERIALIZED (
  SELECT f.cell, s.item, s.win, s.{label} AS lab, s.fold <> f.fold AS is_train, s.v FROM {p}fit f JOIN {src} s ON s.cell = f.part),
{standard(p + "fx", p + "zz", keep="item, win, lab, is_train")},
{p}z AS MATERIALIZED (SELECT cell, item, win, lab, is_train, list_append(x, 1.0) AS x FROM {p}zz),
{p}tr AS MATERIALIZED (
  SELECT cell, lab, x, row_number() OVER (PARTITION BY cell ORDER BY item, win) AS i, count(*) OVER (PARTITION BY cell) AS n FROM {p}z WHERE is_train),
{p}cols AS MATERIALIZED (
  SELECT cell, d, n, max(d) OVER (PARTITION BY cell) AS top, col FROM (
    SELECT cell, d, max(n) AS n, list(xv ORDER BY i) AS col
    FROM (SELECT cell, i, n, unnest(range(1, len(x) + 1)) AS d, unnest(x) AS xv FROM {p}tr) GROUP BY cell, d)),
{p}y AS MATERIALIZED (
  SELECT t.cell, t.i, t.n, t.x, list_position(l.labs, t.lab) AS own, len(l.labs) AS k
  FROM {p}tr t JOIN (SELECT cell, list_sort(list(DISTINCT lab)) AS labs FROM {p}tr GROUP BY cell) l ON l.cell = t.cell),
{p}gd AS (
  SELECT CAST(0 AS BIGINT) AS it, cell, list_transform(range(max(k)), lambda c: list_transform(range(max(len(x))), lambda j: CAST(0 AS DOUBLE))) AS w,
         list_transform(range(max(k)), lambda c: list_transform(range(max(len(x))), lambda j: CAST(0 AS DOUBLE))) AS b
  FROM {p}y GROUP BY cell
  UNION ALL
  SELECT step.it, step.cell, step.w,
         list_transform(step.w, lambda v, c: list_transform(v, lambda x, j: x + step.it / (step.it + 3.0) * (x - step.old[c][j]))) AS b
  FROM (
    SELECT q.it + 1 AS it, q.cell, q.w AS old,
           list_transform(q.b, lambda v, c: list_transform(v, lambda x, j: x - {rate} * (r.g[j][c] + CASE WHEN j < len(v) THEN x / r.n ELSE 0 END))) AS w
    FROM {p}gd q JOIN (
      SELECT c.cell, max(c.n) AS n, list(list_transform(e.r, lambda v: list_dot_product(c.col, v) / c.n) ORDER BY c.d) AS g
      FROM {p}cols c JOIN (
        SELECT cell, list_transform(range(1, len(any_value(e)) + 1), lambda c: list(e ORDER BY i).list_transform(lambda v: v[c])) AS r
        FROM (
          SELECT cell, i, list_transform(z, lambda v, c: v / total - CASE WHEN c = own THEN 1.0 ELSE 0.0 END) AS e
          FROM (
            SELECT cell, i, own, z, list_sum(z) AS total FROM (
              SELECT cell, i, own, list_transform(s, lambda v: exp(v - top)) AS z FROM (
                SELECT cell, i, own, s, list_max(s) AS top FROM (
                  SELECT t.cell, t.i, t.own, list_transform(g.b, lambda v: list_dot_product(t.x, v)) AS s
                  FROM {p}gd g JOIN {p}y t ON t.cell = g.cell WHERE g.it < {steps})))))
        GROUP BY cell) e ON e.cell = c.cell
      GROUP BY c.cell) r ON r.cell = q.cell) step),
{p}wt AS MATERIALIZED (
  SELECT cell, lab, w[j] AS w FROM (
    SELECT g.cell, g.w, l.labs, unnest(range(1, len(l.labs) + 1)) AS j, unnest(l.labs) AS lab
    FROM {p}gd g JOIN (SELECT cell, list_sort(list(DISTINCT lab)) AS labs FROM {p}tr GROUP BY cell) l ON l.cell = g.cell WHERE g.it = {steps})),
{out} AS (
  SELECT cell, fold, item, win, truth, pred FROM (
    SELECT f.part AS cell, f.fold, x.item, x.win, x.lab AS truth, g.lab AS pred,
           row_number() OVER (PARTITION BY x.cell, x.item, x.win ORDER BY list_dot_product(x.x, g.w) DESC, g.lab) AS rk
    FROM {p}z x JOIN {p}wt g ON g.cell = x.cell JOIN {p}fit f ON f.cell = x.cell {keep} WHERE NOT x.is_train)
  WHERE rk = 1)"""


def class_scores(src: str, out: str, keys: str) -> str:
    on = " AND ".join(f"c.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    ck = ", ".join(f"c.{k.strip()}" for k in keys.split(","))
    return f"""{out}_cls AS (SELECT {keys}, truth AS c FROM {src} UNION SELECT {keys}, pred FROM {src}),
{out}_cnt AS (
  SELECT {ck}, c.c, count(*) FILTER (WHERE p.truth = c.c AND p.pred = c.c) AS tp,
         count(*) FILTER (WHERE p.truth = c.c AND p.pred <> c.c) AS fn,
         count(*) FILTER (WHERE p.truth <> c.c AND p.pred = c.c) AS fp
  FROM {out}_cls c JOIN {src} p ON {on} GROUP BY {ck}, c.c),
{out} AS (
  SELECT {keys}, CAST(sum(tp + fn) AS BIGINT) AS n, sum(tp) / sum(tp + fn) AS accuracy, avg(2 * tp / (2 * tp + fn + fp)) AS macro_f1,
         avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END) AS balanced_accuracy
  FROM {out}_cnt GROUP BY {keys})"""


def pair_hist(src: str, out: str) -> str:
    """All pairs of ``src(cell, item, win, ind, grp, u)``."""
    return f"""{out} AS (
  SELECT cell, bin, count(*) FILTER (WHERE same) AS pos, count(*) FILTER (WHERE NOT same) AS neg
  FROM (
    SELECT a.cell, a.ind = b.ind AS same, CAST(round(list_dot_product(a.u, b.u) * 1000000) AS BIGINT) AS bin
    FROM {src} a JOIN {src} b ON a.cell = b.cell AND (a.item < b.item OR (a.item = b.item AND a.win < b.win))
    WHERE a.ind <> b.ind OR a.grp <> b.grp)
  GROUP BY cell, bin)"""


def roc(hist: str, out: str) -> str:
    return f"""{out}_c AS (
  SELECT cell, bin, pos, neg,
         sum(pos) OVER d AS tp, sum(neg) OVER d AS fp,
         sum(pos) OVER (PARTITION BY cell) AS p, sum(neg) OVER (PARTITION BY cell) AS n,
         lead(pos) OVER o AS np, lead(neg) OVER o AS nn, row_number() OVER o AS rn
  FROM {hist}
  WINDOW o AS (PARTITION BY cell ORDER BY bin DESC),
         d AS (PARTITION BY cell ORDER BY bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{out}_v AS (
  SELECT cell, -bin AS o, CAST(fp AS DOUBLE) / CAST(n AS DOUBLE) AS fpr,
         abs((1 - CAST(tp AS DOUBLE) / CAST(p AS DOUBLE)) - CAST(fp AS DOUBLE) / CAST(n AS DOUBLE)) AS gap
  FROM {out}_c WHERE p > 0 AND n > 0 AND (rn = 1 OR np IS NULL OR np <> pos OR nn <> neg)
  UNION ALL SELECT DISTINCT cell, CAST(-9223372036854775807 AS BIGINT), 0.0, 1.0 FROM {out}_c WHERE p > 0 AND n > 0),
{out}_e AS (
  SELECT cell, fpr AS eer FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY gap, o) AS rk FROM {out}_v) WHERE rk = 1),
{out} AS (
  SELECT c.cell, CAST(max(p) AS BIGINT) AS n_pos, CAST(max(n) AS BIGINT) AS n_neg,
         CASE WHEN max(p) > 0 AND max(n) > 0 THEN
           sum(CAST(pos AS DOUBLE) * (n - fp + neg / 2.0)) / (CAST(max(p) AS DOUBLE) * CAST(max(n) AS DOUBLE)) END AS auc, max(e.eer) AS eer
  FROM {out}_c c LEFT JOIN {out}_e e ON e.cell = c.cell GROUP BY c.cell)"""


def standard(src: str, out: str, train: str = "is_train", keep: str = "item, win, ind, grp, is_train") -> str:
    """Standardise per cell on the train rows, then ``u``. ``src(cell, keep, v)``."""
    cols = ", ".join(f"s.{k.strip()}" for k in keep.split(","))
    return f"""{out}_d AS (SELECT cell, {train} AS tr, unnest(range(1, len(v) + 1)) AS d, unnest(v) AS x FROM {src}),
{out}_m AS (SELECT cell, d, avg(x) AS m, stddev_pop(x) AS s FROM {out}_d WHERE tr GROUP BY cell, d),
{out}_l AS (SELECT cell, list(m ORDER BY d) AS m, list(s ORDER BY d) AS s FROM {out}_m GROUP BY cell),
{out}_x AS (
  SELECT s.cell, {cols}, list_transform(s.v, lambda x, i: (x - l.m[i]) / CASE WHEN l.s[i] = 0 THEN 1.0 ELSE l.s[i] END) AS x
  FROM {src} s JOIN {out}_l l ON l.cell = s.cell),
{unit(out + "_x", out, "x")}"""


# Splits ---------------------------------------------------------------------------------------
ORACLE["group_kfold_assign"] = sql(EMB, group_folds("e", "f"), select="SELECT item, grp, fold FROM f")

CUSTOMERS = "c AS (SELECT 'o' AS cell, CAST(o_custkey AS VARCHAR) AS grp FROM orders)"
ORACLE["group_kfold_customers"] = sql(CUSTOMERS, group_folds("c", "f"), select="SELECT grp, n, fold FROM gf")
ORACLE["group_rank_folds"] = sql(
    CUSTOMERS,
    "s AS (SELECT grp, count(*) AS n FROM c GROUP BY grp)",
    select="""SELECT grp, n, (row_number() OVER (ORDER BY n DESC, md5('42|group_fold|' || grp), grp) - 1) % 5 AS fold FROM s""")

LINES = """lo AS (
  SELECT 'lines' AS dataset, o_custkey AS ind, l_orderkey AS grp, o_orderstatus AS status,
         concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)) AS item
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
ORACLE["group_hash_folds"] = sql(
    LINES,
    "s AS (SELECT grp, count(*) AS n FROM lo GROUP BY grp)",
    """h AS (SELECT n, CAST('0x' || left(md5('42|group_fold|' || CAST(grp AS VARCHAR)), 12) AS BIGINT) % 5 AS fold FROM s)""",
    select="SELECT fold, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_items FROM h GROUP BY fold")
ORACLE["stratified_kfold_assign"] = sql(EMB, dealt_folds("e", "f"), select="SELECT item, ind, fold FROM f")
ORACLE["fold_leak_check"] = sql(
    EMB, group_folds("e", "a"), dealt_folds("e", "b"),
    """f AS (SELECT 'group' AS split, item, ind, grp, fold FROM a UNION ALL SELECT 'random', item, ind, grp, fold FROM b)""",
    """lk AS (SELECT split, count(*) AS leaking FROM (
         SELECT DISTINCT x.split, x.grp FROM f x JOIN f y ON x.split = y.split AND x.grp = y.grp AND x.fold <> y.fold) GROUP BY split)""",
    """fo AS (SELECT DISTINCT split, fold FROM f)""",
    """en AS (SELECT fo.split, fo.fold FROM fo WHERE (SELECT count(DISTINCT ind) FROM f t WHERE t.split = fo.split AND t.fold <> fo.fold)
         = (SELECT count(DISTINCT ind) FROM f t WHERE t.split = fo.split))""",
    select="""SELECT s.split, coalesce(max(lk.leaking), 0) AS leaking_groups, count(DISTINCT s.fold) AS n_folds,
       count(DISTINCT en.fold) AS enrolled_folds
FROM fo s LEFT JOIN lk ON lk.split = s.split LEFT JOIN en ON en.split = s.split GROUP BY s.split""")
ORACLE["within_label_split"] = sql(
    EMB, select="""SELECT item, ind, rn > greatest(1, round_even(n * 0.8, 0)) AS is_test FROM (
  SELECT item, ind, count(*) OVER (PARTITION BY ind) AS n,
         row_number() OVER (PARTITION BY ind ORDER BY md5('42|within_split|' || item), item) AS rn FROM e)""")
ORACLE["validation_split"] = sql(
    EMB, select="""SELECT item, ind, rn <= CASE WHEN n >= 2 THEN least(greatest(1, round_even(n * 0.15, 0)), n - 1) ELSE 0 END AS is_validation FROM (
  SELECT item, ind, count(*) OVER (PARTITION BY ind) AS n,
         row_number() OVER (PARTITION BY ind ORDER BY md5('42|validation|' || item), item) AS rn FROM e)""")

HELD = """held AS (
  SELECT rep, ind FROM (
    SELECT rep, ind, row_number() OVER (PARTITION BY rep ORDER BY md5('42|hold_out|' || rep || '|' || ind), ind) AS rn
    FROM (SELECT DISTINCT ind FROM e) i, (SELECT unnest(range(12)) AS rep) r) WHERE rn <= 3)"""
ORACLE["held_out_sets"] = sql(
    EMB, HELD, select="SELECT rep AS repeat, string_agg(ind, '|' ORDER BY ind) AS held_out FROM held GROUP BY rep")

THIN = """sz AS (SELECT ind, grp, count(*) AS n FROM e GROUP BY ind, grp),
cond AS (SELECT 6 AS groups, 2 AS items UNION ALL SELECT 4, 3 UNION ALL SELECT 3, 4),
elig AS (
  SELECT ind FROM (
    SELECT s.ind, c.groups, c.items, count(*) FILTER (WHERE s.n >= c.items) >= c.groups AS ok
    FROM sz s, cond c GROUP BY s.ind, c.groups, c.items)
  GROUP BY ind HAVING bool_and(ok)),
tg AS (
  SELECT * FROM (
    SELECT c.groups, c.items, d.draw, s.ind, s.grp,
           row_number() OVER (PARTITION BY c.groups, c.items, d.draw, s.ind ORDER BY
             md5('42|thin_group|' || c.groups || '|' || c.items || '|' || d.draw || '|' || s.ind || '|' || s.grp), s.grp) AS rn
    FROM sz s JOIN elig USING (ind), cond c, (SELECT unnest(range(12)) AS draw) d WHERE s.n >= c.items)
  WHERE rn <= groups),
ti AS (
  SELECT groups, items, draw, ind, grp, item, v FROM (
    SELECT t.groups, t.items, t.draw, e.ind, e.grp, e.item, e.v,
           row_number() OVER (PARTITION BY t.groups, t.items, t.draw, e.ind, e.grp ORDER BY
             md5('42|thin_item|' || t.groups || '|' || t.items || '|' || t.draw || '|' || e.item), e.item) AS rn
    FROM tg t JOIN e ON e.ind = t.ind AND e.grp = t.grp)
  WHERE rn <= items)"""
ORACLE["thinning_eligible"] = sql(EMB, THIN, select="SELECT ind FROM elig")
ORACLE["thinning_samples"] = sql(
    EMB, THIN, select="SELECT CAST(groups AS BIGINT) AS groups, CAST(items AS BIGINT) AS items, draw, ind, grp, item FROM ti")

# Identification -------------------------------------------------------------------------------
BY_GROUP = (EMB, group_folds("e", "f0"), unit("f0", "f"), template_predictions("f", "pr"))
BY_RANDOM = (EMB, dealt_folds("e", "f0"), unit("f0", "f"), template_predictions("f", "pr"))
PER_FOLD = "SELECT fold, n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM sc"
ORACLE["centroid_by_group"] = sql(*BY_GROUP, class_scores("pr", "sc", "fold"), select=PER_FOLD)
ORACLE["centroid_random"] = sql(*BY_RANDOM, class_scores("pr", "sc", "fold"), select=PER_FOLD)
ORACLE["centroid_predictions"] = sql(
    *BY_GROUP, select="SELECT fold, item, truth, pred, round(score, 6) AS score, 'emb' AS model, 'all' AS subset FROM pr")
ORACLE["centroid_macro_f1"] = sql(
    *BY_GROUP, class_scores("pr", "sc", "fold"),
    select="""SELECT round(avg(accuracy), 6) AS accuracy, round(stddev_pop(accuracy), 6) AS accuracy_sd,
  round(avg(macro_f1), 6) AS macro_f1, round(stddev_pop(macro_f1), 6) AS macro_f1_sd,
  round(avg(balanced_accuracy), 6) AS balanced_accuracy, round(stddev_pop(balanced_accuracy), 6) AS balanced_accuracy_sd,
  count(*) AS n_folds FROM sc""")
ORACLE["confusion_counts"] = sql(*BY_GROUP, select="SELECT truth, pred, count(*) AS n FROM pr GROUP BY truth, pred")
ORACLE["leakage_delta"] = sql(
    EMB, group_folds("e", "g0"), unit("g0", "g"), template_predictions("g", "gp", "g_"),
    dealt_folds("e", "r0"), unit("r0", "r"), template_predictions("r", "rp", "r_"),
    "b AS (SELECT 'g' AS split, truth, pred FROM gp UNION ALL SELECT 'r', truth, pred FROM rp)",
    class_scores("b", "sc", "split"),
    """x AS (SELECT max(accuracy) FILTER (WHERE split = 'g') AS ag, max(accuracy) FILTER (WHERE split = 'r') AS ar,
         max(macro_f1) FILTER (WHERE split = 'g') AS fg, max(macro_f1) FILTER (WHERE split = 'r') AS fr FROM sc)""",
    select="""SELECT round(ag, 6) AS accuracy_group, round(ar, 6) AS accuracy_random, round(fg, 6) AS macro_f1_group,
  round(fr, 6) AS macro_f1_random, round(ar - ag, 6) AS accuracy_leakage_delta, round(fr - fg, 6) AS macro_f1_leakage_delta FROM x""")

VOTE = (EMB, HALVES, group_folds("w", "f0"), unit("f0", "f"), template_predictions("f", "pr"), """votes AS (
  SELECT item, truth, pred, count(*) AS n, min(win) AS first_win FROM pr GROUP BY item, truth, pred),
fused AS (
  SELECT 1 AS one, item, truth, pred FROM (
    SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, first_win, pred) AS rk FROM votes) WHERE rk = 1)""")
ORACLE["vote_fusion"] = sql(*VOTE, select="SELECT item, truth, pred FROM fused")
ORACLE["fused_scores"] = sql(
    *VOTE, class_scores("fused", "sc", "one"),
    select="SELECT n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM sc")

POOL = """{o}p AS (SELECT cell, fold, ind, grp, unnest(range(1, len(u) + 1)) AS d, unnest(u) AS x FROM {s}),
{o}s AS (SELECT cell, fold, ind, grp, d, avg(x) AS m FROM {o}p GROUP BY cell, fold, ind, grp, d),
{o}l AS (SELECT cell, fold, ind, grp, list(m ORDER BY d) AS q FROM {o}s GROUP BY cell, fold, ind, grp)"""


def pooled(src: str, out: str) -> str:
    return POOL.format(o=out, s=src) + ",\n" + unit(out + "l", out, "q")


ORACLE["encounter_accuracy"] = sql(
    EMB, group_folds("e", "f0"), unit("f0", "f"), pooled("f", "q"),
    template_predictions("f", "pr", query="q", query_key="grp"), class_scores("pr", "sc", "fold"),
    select="SELECT fold, n, round(accuracy, 6) AS accuracy FROM sc")

NEIGHBOURS = (EMB, group_folds("e", "f0"), unit("f0", "f"), """nb AS (
  SELECT * FROM (
    SELECT q.cell, q.fold, q.item, q.win, q.ind AS truth, r.item AS ref, r.ind AS pred, round(list_dot_product(q.u, r.u), 9) AS score,
           row_number() OVER (PARTITION BY q.item ORDER BY round(list_dot_product(q.u, r.u), 9) DESC, r.item) AS rank
    FROM f q JOIN f r ON r.fold <> q.fold)
  WHERE rank <= 5)""")
KNN = """kv AS (SELECT cell, fold, item, win, truth, pred, count(*) AS n FROM nb GROUP BY cell, fold, item, win, truth, pred),
kp AS (SELECT cell, fold, item, win, truth, pred FROM (
  SELECT *, row_number() OVER (PARTITION BY cell, fold, item, win ORDER BY n DESC, pred) AS rk FROM kv) WHERE rk = 1)"""
ORACLE["nearest_neighbours"] = sql(*NEIGHBOURS, select="SELECT fold, item, ref, round(score, 6) AS score, rank FROM nb")
ORACLE["nearest_blocked"] = ORACLE["nearest_neighbours"]
ORACLE["knn_vote"] = sql(*NEIGHBOURS, KNN, select="SELECT fold, item, truth, pred FROM kp")

# Verification ---------------------------------------------------------------------------------
ORACLE["verification_auc"] = sql(
    EMB, unit("e", "p"), pair_hist("p", "h"), roc("h", "r"), select="SELECT n_pos, n_neg, round(auc, 6) AS auc FROM r")
ORACLE["verification_blocked"] = ORACLE["verification_auc"]
ORACLE["verification_eer"] = sql(
    EMB, unit("e", "p0"), "p AS (SELECT kind AS cell, item, win, ind, grp, u FROM p0)", pair_hist("p", "h"), roc("h", "r"),
    select="SELECT cell AS kind, round(eer, 6) AS eer FROM r")

# Evaluations ----------------------------------------------------------------------------------
ORACLE["fold_standardise"] = sql(
    EMB, group_folds("e", "f"),
    "d AS (SELECT fold, unnest(range(len(v))) AS dim, unnest(v) AS x FROM f)",
    select="""SELECT t.fold, d.dim, round(avg(d.x), 6) AS mean, round(stddev_pop(d.x), 6) AS sd
FROM (SELECT DISTINCT fold FROM f) t JOIN d ON d.fold <> t.fold GROUP BY t.fold, d.dim""")

CLOSED = (
    EMB, group_folds("e", "f"),
    """fx AS (SELECT CAST(t.fold AS VARCHAR) AS cell, f.item, f.win, f.ind, f.grp, f.fold <> t.fold AS is_train, f.v
      FROM f, (SELECT DISTINCT fold FROM f) t)""",
    standard("fx", "z"),
    "tr AS (SELECT cell, CAST(1 AS BIGINT) AS fold, item, win, ind, grp, u FROM z WHERE is_train)",
    """te AS (SELECT cell, CAST(0 AS BIGINT) AS fold, item, win, ind, grp, u FROM z WHERE NOT is_train
      AND (cell, ind) IN (SELECT cell, ind FROM tr))""",
    "rows2 AS (SELECT * FROM tr UNION ALL SELECT * FROM te)",
    template_predictions("rows2", "cp", "c_", query="te", rule="none"),
    """nb AS (SELECT * FROM (
  SELECT q.cell, q.fold, q.item, q.win, q.ind AS truth, r.ind AS pred,
         row_number() OVER (PARTITION BY q.cell, q.item, q.win ORDER BY round(list_dot_product(q.u, r.u), 9) DESC, r.item, r.win) AS rank
  FROM te q JOIN tr r ON r.cell = q.cell) WHERE rank <= 5)""", KNN,
    pooled("te", "q"), template_predictions("rows2", "ep", "e_", query="q", query_key="grp", rule="none"),
    "ts AS (SELECT cell, item, win, ind, grp, u FROM z WHERE NOT is_train)", pair_hist("ts", "h"), roc("h", "r"),
    """m AS (
  SELECT cell, 'c' AS k, avg(CAST(truth = pred AS INT)) AS a FROM cp GROUP BY cell
  UNION ALL SELECT cell, 'k', avg(CAST(truth = pred AS INT)) FROM kp GROUP BY cell
  UNION ALL SELECT cell, 'e', avg(CAST(truth = pred AS INT)) FROM ep GROUP BY cell)""")
ORACLE["closed_set_frozen"] = sql(*CLOSED, select="""SELECT
  round(avg(a) FILTER (WHERE k = 'c'), 6) AS centroid_acc, round(stddev_pop(a) FILTER (WHERE k = 'c'), 6) AS centroid_acc_sd,
  round(avg(a) FILTER (WHERE k = 'k'), 6) AS knn_acc, round(stddev_pop(a) FILTER (WHERE k = 'k'), 6) AS knn_acc_sd,
  round(avg(a) FILTER (WHERE k = 'e'), 6) AS encounter_acc, round(stddev_pop(a) FILTER (WHERE k = 'e'), 6) AS encounter_acc_sd,
  round((SELECT avg(eer) FROM r), 6) AS eer, round((SELECT avg(auc) FROM r), 6) AS auc, 'frozen' AS method FROM m""")

HELD_OUT = (EMB, HELD, """ro AS (
  SELECT CAST(r.rep AS VARCHAR) AS cell, e.item, e.win, e.ind, e.grp, e.v, h.ind IS NOT NULL AS novel,
         count(*) OVER (PARTITION BY r.rep, e.ind) AS n,
         row_number() OVER (PARTITION BY r.rep, e.ind ORDER BY md5('42|within_split|' || r.rep || '|' || e.item || '|' || e.win), e.item) AS rn
  FROM e CROSS JOIN (SELECT DISTINCT rep FROM held) r LEFT JOIN held h ON h.rep = r.rep AND h.ind = e.ind),
rr AS (SELECT cell, item, win, ind, grp, v, novel, NOT novel AND rn <= greatest(1, round_even(n * 0.8, 0)) AS is_train FROM ro)""",
    standard("rr", "z", keep="item, win, ind, grp, novel, is_train"))
OPEN = """known AS (SELECT cell, CAST(1 AS BIGINT) AS fold, item, win, ind, grp, u FROM z WHERE is_train),
other AS (SELECT cell, CAST(0 AS BIGINT) AS fold, item, win, ind, grp, u, novel FROM z WHERE NOT is_train),
allr AS (SELECT * FROM known UNION ALL SELECT * EXCLUDE (novel) FROM other),
""" + template_predictions("allr", "op", "o_", query="other", rule="none") + """,
oh AS (
  SELECT p.cell, CAST(round(p.score * 1000000) AS BIGINT) AS bin, count(*) FILTER (WHERE NOT o.novel) AS pos, count(*) FILTER (WHERE o.novel) AS neg
  FROM op p JOIN other o ON o.cell = p.cell AND o.item = p.item GROUP BY p.cell, bin),
""" + roc("oh", "orc")
# A row known to the fold side only has no template of its own there: individuals held out of a repeat.
ORACLE["open_set_auroc"] = sql(*HELD_OUT, OPEN, select="SELECT CAST(cell AS BIGINT) AS repeat, round(auc, 6) AS auc FROM orc")

FEW = """nov AS (SELECT cell, item, win, ind, u FROM z WHERE novel),
kn AS (SELECT cell, item, u FROM z WHERE is_train),
nk AS (SELECT n.cell, n.item, max(round(list_dot_product(n.u, k.u), 9)) AS known FROM nov n JOIN kn k ON k.cell = n.cell GROUP BY n.cell, n.item),
sh AS (SELECT 1 AS shot UNION ALL SELECT 5),
pick AS (
  SELECT s.shot, d.draw, n.cell, n.item, n.ind, n.u,
         row_number() OVER (PARTITION BY s.shot, d.draw, n.cell, n.ind ORDER BY
           md5('42|support_' || s.shot || '|' || n.cell || '|' || d.draw || '|' || n.item || '|' || n.win), n.item) <= s.shot AS support
  FROM nov n, sh s, (SELECT unnest(range(5)) AS draw) d),
ans AS (
  SELECT q.shot, q.cell, q.draw, q.item, q.ind AS truth, s.ind AS pred, round(list_dot_product(q.u, s.u), 9) AS score,
         row_number() OVER (PARTITION BY q.shot, q.cell, q.draw, q.item ORDER BY round(list_dot_product(q.u, s.u), 9) DESC, s.item) AS rk
  FROM pick q JOIN pick s ON s.shot = q.shot AND s.cell = q.cell AND s.draw = q.draw AND s.support AND NOT q.support),
hit AS (
  SELECT a.shot, a.cell, a.draw, a.truth, CASE WHEN k.known > a.score THEN '__known__' ELSE a.pred END AS pred
  FROM ans a JOIN nk k ON k.cell = a.cell AND k.item = a.item WHERE a.rk = 1),
rec AS (SELECT shot, cell, draw, truth, avg(CAST(truth = pred AS INT)) AS r FROM hit GROUP BY shot, cell, draw, truth),
bal AS (SELECT shot, cell, draw, avg(r) AS b FROM rec GROUP BY shot, cell, draw),
least_n AS (SELECT cell, min(n) AS n FROM (SELECT cell, ind, count(*) AS n FROM nov GROUP BY cell, ind) GROUP BY cell),
fs AS (SELECT b.shot, b.cell, CASE WHEN max(l.n) > b.shot THEN avg(b.b) END AS acc
  FROM bal b JOIN least_n l ON l.cell = b.cell GROUP BY b.shot, b.cell)"""
for n in (1, 5):
    ORACLE[f"few_shot_{n}"] = sql(
        *HELD_OUT, FEW, select=f"SELECT CAST(cell AS BIGINT) AS repeat, round(acc, 6) AS accuracy FROM fs WHERE shot = {n}")
ORACLE["leave_individuals_out_frozen"] = sql(
    *HELD_OUT, OPEN, FEW,
    "np AS (SELECT cell, item, win, ind, grp, u FROM z WHERE novel)", pair_hist("np", "nh"), roc("nh", "nr"),
    select="""SELECT CAST(o.cell AS BIGINT) AS repeat, h.held_out, round(n.eer, 6) AS eer, round(o.auc, 6) AS open_set_auroc,
  round(a.acc, 6) AS few_shot_1, round(b.acc, 6) AS few_shot_5
FROM orc o JOIN nr n ON n.cell = o.cell JOIN fs a ON a.cell = o.cell AND a.shot = 1 JOIN fs b ON b.cell = o.cell AND b.shot = 5
JOIN (SELECT CAST(rep AS VARCHAR) AS cell, string_agg(ind, '|' ORDER BY ind) AS held_out FROM held GROUP BY rep) h ON h.cell = o.cell""")

# Probe ------------------------------------------------------------------------------------------
PROBE_FOLDS = """SELECT CAST(fold AS BIGINT) AS fold, n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1,
  round(balanced_accuracy, 6) AS balanced_accuracy FROM sc"""
ORACLE["probe_by_group"] = sql(EMB, group_folds("e", "f"), probe_predictions("f", "pr"), class_scores("pr", "sc", "fold"), select=PROBE_FOLDS)
ORACLE["probe_random"] = sql(EMB, dealt_folds("e", "f"), probe_predictions("f", "pr"), class_scores("pr", "sc", "fold"), select=PROBE_FOLDS)
ORACLE["probe_ceiling"] = sql(
    EMB, group_folds("e", "f"), probe_predictions("f", "pr", rule="none"), class_scores("pr", "sc", "fold"),
    select="SELECT 'emb' AS model, round(avg(accuracy), 6) AS probe_ceiling FROM sc")


def fit_sample(src: str, out: str, purpose: str, fit_rows: int, least: int = 64) -> str:
    """The rows a fit sees: all of a cell up to ``fit_rows``; above, of each class the share ``fit_rows`` / rows, but
    ``least`` rows of a rare class in expectation, where the digest of the row, as a number in [0, 1), lies below the share."""
    return f"""{out} AS (
  SELECT * EXCLUDE (cell_n_, class_n_) FROM (
    SELECT *, count(*) OVER (PARTITION BY cell) AS cell_n_, count(*) OVER (PARTITION BY cell, ind) AS class_n_ FROM {src})
  WHERE CAST('0x' || left(md5('42|{purpose}|' || item || '|' || win), 12) AS BIGINT) / CAST(281474976710656 AS DOUBLE)
    < least(1.0, greatest(CAST({fit_rows} AS DOUBLE) / cell_n_, CAST({least} AS DOUBLE) / class_n_)))"""


# Folds whose train side misses an individual have no fit.
ORACLE["probe_models"] = sql(
    EMB, group_folds("e", "f"),
    """ok AS (SELECT t.fold FROM (SELECT DISTINCT fold FROM f) t JOIN f ON f.fold <> t.fold
  GROUP BY t.fold HAVING count(DISTINCT f.ind) = (SELECT count(DISTINCT ind) FROM e))""",
    select="""SELECT CAST(t.fold AS BIGINT) AS fold, count(DISTINCT f.ind) AS n_classes, CAST(max(len(f.v)) AS BIGINT) AS dim, count(*) AS n_fit,
  true AS optimal FROM ok t JOIN f ON f.fold <> t.fold GROUP BY t.fold""")

# KMeans -----------------------------------------------------------------------------------------
# Ten restarts: draws by squared distance, then Lloyd's steps until no centroid moves by more than 1e-4.
KMEANS = (
    EMB, unit("e", "eu"),
    "x AS MATERIALIZED (SELECT row_number() OVER (ORDER BY item, win) AS i, count(*) OVER () AS n, ind, grp, u FROM eu)",
    "kk AS (SELECT greatest(count(DISTINCT ind), 2) AS k FROM x)",
    """dr AS MATERIALIZED (
  SELECT r.run, j.j, (CAST('0x' || left(md5('42|' || r.run || '|' || j.j), 12) AS BIGINT) + 1) / CAST(281474976710657 AS DOUBLE) AS p
  FROM (SELECT unnest(range(10)) AS run) r, (SELECT unnest(range(k)) AS j FROM kk) j)""",
    """sd AS (
  SELECT d.run, CAST(0 AS BIGINT) AS j, a.i AS pick, x.i, pow(list_distance(x.u, a.u), 2) AS near
  FROM dr d JOIN x a ON d.j = 0 AND a.i = CAST(floor(d.p * a.n) AS BIGINT) % a.n + 1, x
  UNION ALL
  SELECT step.run, step.j, step.pick, x.i, least(step.near, pow(list_distance(x.u, a.u), 2))
  FROM (
    SELECT s.run, s.j + 1 AS j, t.pick, s.i, s.near
    FROM sd s JOIN (
      SELECT c.run, coalesce(min(c.i) FILTER (WHERE c.cum >= d.p * c.tot), max(c.i)) AS pick
      FROM (SELECT run, j, i, sum(near) OVER (PARTITION BY run ORDER BY i) AS cum, sum(near) OVER (PARTITION BY run) AS tot FROM sd) c
      JOIN dr d ON d.run = c.run AND d.j = c.j + 1 GROUP BY c.run) t ON t.run = s.run) step
  JOIN x ON x.i = step.i JOIN x a ON a.i = step.pick)""",
    """ll AS (
  SELECT CAST(0 AS BIGINT) AS it, s.run, s.j AS c, x.u AS m, CAST(1 AS DOUBLE) AS moved
  FROM (SELECT DISTINCT run, j, pick FROM sd) s JOIN x ON x.i = s.pick
  UNION ALL
  SELECT step.it, step.run, step.c, step.m, max(list_distance(step.m, step.old)) OVER (PARTITION BY step.run) AS moved
  FROM (
    SELECT l.it + 1 AS it, l.run, l.c, l.m AS old, coalesce(w.m, l.m) AS m
    FROM ll l LEFT JOIN (
      SELECT run, c, list(v ORDER BY d) AS m FROM (
        SELECT run, c, d, avg(v) AS v FROM (
          SELECT b.run, b.c, unnest(range(64)) AS d, unnest(x.u) AS v FROM (
            SELECT run, i, c FROM (
              SELECT l.run, x.i, l.c, row_number() OVER (PARTITION BY l.run, x.i ORDER BY
                greatest(round(list_dot_product(x.u, x.u) - 2 * list_dot_product(x.u, l.m) + list_dot_product(l.m, l.m), 12), 0), l.c) AS rk
              FROM ll l, x WHERE l.moved > 1e-4) WHERE rk = 1) b JOIN x ON x.i = b.i)
        GROUP BY run, c, d) GROUP BY run, c) w ON w.run = l.run AND w.c = l.c
    WHERE l.moved > 1e-4 AND l.it < 300) step)""",
    "le AS MATERIALIZED (SELECT l.* FROM ll l JOIN (SELECT run, max(it) AS it FROM ll GROUP BY run) t ON t.run = l.run AND t.it = l.it)",
    """ka AS MATERIALIZED (SELECT run, i, c, d FROM (
  SELECT *, row_number() OVER (PARTITION BY run, i ORDER BY d, c) AS rk FROM (
    SELECT l.run, x.i, l.c, greatest(round(list_dot_product(x.u, x.u) - 2 * list_dot_product(x.u, l.m) + list_dot_product(l.m, l.m), 12), 0) AS d
    FROM le l, x)) WHERE rk = 1)""",
    "kb AS (SELECT run FROM ka GROUP BY run ORDER BY round(sum(d), 9), run LIMIT 1)",
    "km AS MATERIALIZED (SELECT x.ind, x.grp, CAST(ka.c AS VARCHAR) AS cluster FROM ka JOIN kb ON kb.run = ka.run JOIN x ON x.i = ka.i)")


def clustering_scores(src: str, truth: str, p: str) -> str:
    """``{p}o``: one row of ari, nmi, ami of ``src(truth, cluster)``, by the pair-count and lgamma forms."""
    return f"""{p}ct AS (SELECT {truth} AS a, cluster AS b, count(*) AS n FROM {src} GROUP BY {truth}, cluster),
{p}ma AS (SELECT a, sum(n) AS na FROM {p}ct GROUP BY a), {p}mb AS (SELECT b, sum(n) AS nb FROM {p}ct GROUP BY b),
{p}tt AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM {p}ct),
{p}s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM {p}ct) AS sij, (SELECT sum(na * (na - 1) / 2) FROM {p}ma) AS sa,
  (SELECT sum(nb * (nb - 1) / 2) FROM {p}mb) AS sb, t * (t - 1) / 2 AS st FROM {p}tt),
{p}mi AS (SELECT sum(n / t * ln(n * t / (CAST(na AS DOUBLE) * nb))) AS mi FROM {p}ct JOIN {p}ma USING (a) JOIN {p}mb USING (b), {p}tt),
{p}hh AS (SELECT (SELECT -sum(na / t * ln(na / t)) FROM {p}ma, {p}tt) AS ha, (SELECT -sum(nb / t * ln(nb / t)) FROM {p}mb, {p}tt) AS hb),
{p}em AS (
  SELECT sum(k / t * ln(t * k / (na * nb)) * exp(
      lgamma(na + 1) + lgamma(nb + 1) + lgamma(t - na + 1) + lgamma(t - nb + 1)
      - lgamma(t + 1) - lgamma(k + 1) - lgamma(na - k + 1) - lgamma(nb - k + 1) - lgamma(t - na - nb + k + 1))) AS emi
  FROM (SELECT CAST(na AS DOUBLE) AS na, CAST(nb AS DOUBLE) AS nb, t,
               unnest(range(CAST(greatest(1, na + nb - t) AS BIGINT), CAST(least(na, nb) AS BIGINT) + 1)) AS k FROM {p}ma, {p}mb, {p}tt)),
{p}o AS (SELECT (sij - sa * sb / st) / ((sa + sb) / 2 - sa * sb / st) AS ari, mi / ((ha + hb) / 2) AS nmi,
  (mi - emi) / ((ha + hb) / 2 - emi) AS ami FROM {p}s, {p}mi, {p}hh, {p}em)"""


ORACLE["kmeans_scores"] = sql(
    *KMEANS, clustering_scores("km", "ind", "i_"), clustering_scores("km", "grp", "g_"),
    select="""SELECT 'emb' AS model, round(i.ari, 6) AS cluster_ari, round(i.ami, 6) AS cluster_ami, round(i.nmi, 6) AS cluster_nmi,
  round(g.ari, 6) AS cluster_ari_recording FROM i_o i, g_o g""")

ORACLE["score_frozen"] = sql(
    *KMEANS, clustering_scores("km", "ind", "i_"), clustering_scores("km", "grp", "g_"),
    group_folds("e", "g0"), unit("g0", "gu"), dealt_folds("e", "r0"), unit("r0", "ru"),
    probe_predictions("g0", "gp", "pg_"), probe_predictions("r0", "rp", "pr_"),
    "bp AS (SELECT 'g' AS split, truth, pred FROM gp UNION ALL SELECT 'r', truth, pred FROM rp)", class_scores("bp", "bs", "split"),
    class_scores("gp", "ps", "fold"),
    template_predictions("gu", "cg", "cg_"), class_scores("cg", "cgs", "fold"),
    template_predictions("ru", "cr", "cr_"), class_scores("cr", "crs", "fold"),
    pooled("gu", "q"), template_predictions("gu", "ep", "en_", query="q", query_key="grp"), class_scores("ep", "es", "fold"),
    unit("e", "vp"), pair_hist("vp", "vh"), roc("vh", "vr"),
    "ci AS (SELECT ind, count(DISTINCT item) AS n FROM e GROUP BY ind)",
    """f AS (SELECT max(accuracy) FILTER (WHERE split = 'g') AS ag, max(accuracy) FILTER (WHERE split = 'r') AS ar,
         max(macro_f1) FILTER (WHERE split = 'g') AS fg, max(macro_f1) FILTER (WHERE split = 'r') AS fr FROM bs)""",
    select="""SELECT 'emb' AS model, (SELECT count(DISTINCT item) FROM e) AS n_items, (SELECT count(*) FROM e) AS n_windows,
  (SELECT count(DISTINCT ind) FROM e) AS n_individuals, (SELECT count(DISTINCT grp) FROM e) AS n_groups, (SELECT max(len(v)) FROM e) AS dim,
  (SELECT round(1.0 / CAST(count(*) AS DOUBLE), 6) FROM ci) AS chance_inverse_n_individuals, (SELECT round(max(n) / sum(n), 6) FROM ci) AS chance_majority_class,
  round(f.ag, 6) AS accuracy_group, round(f.ar, 6) AS accuracy_random, round(f.fg, 6) AS macro_f1_group, round(f.fr, 6) AS macro_f1_random,
  round(f.ar - f.ag, 6) AS accuracy_leakage_delta, round(f.fr - f.fg, 6) AS macro_f1_leakage_delta,
  (SELECT round(avg(accuracy), 6) FROM ps) AS accuracy_group_window_level, (SELECT round(stddev_pop(accuracy), 6) FROM ps) AS accuracy_group_sd,
  (SELECT round(avg(accuracy), 6) FROM cgs) AS centroid_accuracy_group, (SELECT round(avg(accuracy), 6) FROM crs) AS centroid_accuracy_random,
  (SELECT round(avg(macro_f1), 6) FROM cgs) AS centroid_macro_f1_group, (SELECT round(avg(accuracy), 6) FROM es) AS encounter_accuracy,
  (SELECT round(auc, 6) FROM vr) AS verification_auc, (SELECT round(eer, 6) FROM vr) AS verification_eer,
  round(i.ari, 6) AS cluster_ari, round(i.ami, 6) AS cluster_ami, round(i.nmi, 6) AS cluster_nmi, round(g.ari, 6) AS cluster_ari_recording
FROM f, i_o i, g_o g""")

# Properties of fits that have no closed form ------------------------------------------------------
ORACLE["kmeans_assignment"] = """SELECT count(*) AS n, count(DISTINCT label) AS n_clusters, CAST(0 AS BIGINT) AS misassigned FROM embeddings"""
ORACLE["pca_components"] = sql(
    EMB, group_folds("e", "f"),
    """x AS (SELECT t.fold AS fit, unnest(range(len(f.v))) AS d, unnest(f.v) AS x FROM (SELECT DISTINCT fold FROM f) t JOIN f ON f.fold <> t.fold)""",
    "m AS (SELECT fit, d, count(*) AS n, stddev_pop(x) > 0 AS moves FROM x GROUP BY fit, d)",
    select="""SELECT CAST(fit AS BIGINT) AS fit, max(n) AS n_train, CAST(8 AS BIGINT) AS kept,
  round(sum(CAST(moves AS INT)) * max(n) / CAST(max(n) - 1 AS DOUBLE), 6) AS total_variance, true AS falling, true AS uncorrelated, true AS as_stated
FROM m GROUP BY fit""")
ORACLE["pca_projection"] = sql(
    EMB, group_folds("e", "f"),
    select="SELECT DISTINCT CAST(fold AS BIGINT) AS fit, (SELECT count(*) FROM e) AS n, CAST(8 AS BIGINT) AS dim FROM f")
ORACLE["batch_encode"] = "SELECT vec_id AS item, 'projection' AS model, CAST(16 AS INTEGER) AS dim, CAST(NULL AS VARCHAR) AS error FROM embeddings"
# A projection whose weights are stated: ((16 j + k) mod 7 - 3) / 10.
ORACLE["encoded_values"] = sql(
    EMB, "w AS (SELECT k, list_transform(range(64), lambda j: ((16 * j + k) % 7 - 3) / 10.0) AS w FROM (SELECT unnest(range(16)) AS k))",
    select="SELECT item, CAST(k AS BIGINT) AS dim, round(list_dot_product(v, w), 6) + 0.0 AS value FROM e, w")
ORACLE["spectral_vectors"] = """SELECT clip, m.model, CAST(m.dim AS INTEGER) AS dim, true AS finite
FROM (SELECT DISTINCT event_id // 4000 AS clip FROM events), (VALUES ('mfcc_lakdari', 24), ('mfcc_full', 80), ('mfcc_cmvn', 80)) m(model, dim)"""
ORACLE["determinism"] = "SELECT 'pass' AS outcome, CAST(5 AS BIGINT) AS n_columns, CAST(0 AS BIGINT) AS n_different"
ORACLE["head_models"] = sql(
    EMB, group_folds("e", "f"),
    "tr AS (SELECT CAST(t.fold AS VARCHAR) AS cell, t.fold AS fit, f.ind, f.item, f.win, f.v FROM (SELECT DISTINCT fold FROM f) t JOIN f ON f.fold <> t.fold)",
    fit_sample("tr", "sp", "head_fit_proto", 8192), fit_sample("tr", "ss", "head_fit_supcon", 8192),
    "l AS (SELECT 'proto' AS loss, * FROM sp UNION ALL SELECT 'supcon', * FROM ss)",
    select="""SELECT loss, CAST(fit AS BIGINT) AS fold, count(*) AS n_fit, CAST(max(len(v)) AS BIGINT) AS dim, true AS within_epochs, true AS better_than_start
FROM l GROUP BY loss, fit""")

# Clustering scores -----------------------------------------------------------------------------
CONT = """ct AS (SELECT lang AS a, source AS b, count(*) AS n FROM documents GROUP BY lang, source),
ma AS (SELECT a, sum(n) AS na FROM ct GROUP BY a), mb AS (SELECT b, sum(n) AS nb FROM ct GROUP BY b),
tt AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM ct),
mi AS (SELECT sum(n / t * ln(n * t / (CAST(na AS DOUBLE) * nb))) AS mi FROM ct JOIN ma USING (a) JOIN mb USING (b), tt),
hh AS (SELECT (SELECT -sum(na / t * ln(na / t)) FROM ma, tt) AS ha, (SELECT -sum(nb / t * ln(nb / t)) FROM mb, tt) AS hb)"""
ORACLE["contingency_counts"] = "SELECT lang AS a, source AS b, count(*) AS n FROM documents GROUP BY lang, source"
ORACLE["ari_nmi"] = sql(
    CONT,
    """s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM ct) AS sij, (SELECT sum(na * (na - 1) / 2) FROM ma) AS sa,
  (SELECT sum(nb * (nb - 1) / 2) FROM mb) AS sb, t * (t - 1) / 2 AS st FROM tt)""",
    select="""SELECT round((sij - sa * sb / st) / ((sa + sb) / 2 - sa * sb / st), 6) AS ari,
  round(mi / ((ha + hb) / 2), 6) AS nmi FROM s, mi, hh""")
ORACLE["ami"] = sql(
    CONT,
    """em AS (
  SELECT sum(k / t * ln(t * k / (na * nb)) * exp(
      lgamma(na + 1) + lgamma(nb + 1) + lgamma(t - na + 1) + lgamma(t - nb + 1)
      - lgamma(t + 1) - lgamma(k + 1) - lgamma(na - k + 1) - lgamma(nb - k + 1) - lgamma(t - na - nb + k + 1))) AS emi
  FROM (SELECT CAST(na AS DOUBLE) AS na, CAST(nb AS DOUBLE) AS nb, t,
               unnest(range(CAST(greatest(1, na + nb - t) AS BIGINT), CAST(least(na, nb) AS BIGINT) + 1)) AS k FROM ma, mb, tt))""",
    select="SELECT round((mi - emi) / ((ha + hb) / 2 - emi), 6) AS ami FROM mi, hh, em")

# Diagnostics ----------------------------------------------------------------------------------
SHIFT = (EMB, """big AS (SELECT ind, CAST(item % 5 AS VARCHAR) AS g, count(*) AS n FROM e GROUP BY ind, g HAVING count(*) >= 3),
un AS (SELECT ind, count(*) AS ng, sum(n) AS ni, least(5, min(n)) AS k FROM big GROUP BY ind HAVING count(*) >= 2 AND sum(n) >= 12),
sr AS (SELECT e.ind AS cell, e.item, e.win, b.g AS rec, e.v, u.k FROM e
  JOIN big b ON b.ind = e.ind AND b.g = CAST(e.item % 5 AS VARCHAR) JOIN un u ON u.ind = e.ind)""",
    dealt_folds("sr", "s0", "shift_fold", "rec", "k"), unit("s0", "s"),
    template_predictions("s", "pr", label="rec", rule="none"),
    """fa AS (SELECT cell, fold, avg(CAST(truth = pred AS INT)) AS a FROM pr GROUP BY cell, fold),
sh AS (SELECT u.ind, u.ng AS n_groups, CAST(u.ni AS BIGINT) AS n_items, avg(a) AS accuracy, 1.0 / u.ng AS chance
  FROM un u JOIN fa ON fa.cell = u.ind GROUP BY u.ind, u.ng, u.ni)""")
ORACLE["domain_shift_centroid"] = sql(*SHIFT, select="""SELECT ind, n_groups, n_items, round(accuracy, 6) AS accuracy,
  round(CAST(chance AS DOUBLE), 6) AS chance, round(accuracy / chance, 6) AS lift_over_chance FROM sh""")
ORACLE["domain_shift_probe"] = sql(
    *SHIFT[:2], dealt_folds("sr", "s0", "shift_fold", "rec", "k"), probe_predictions("s0", "pr", label="rec", rule="none", rate=0.35),
    """fa AS (SELECT cell, fold, avg(CAST(truth = pred AS INT)) AS a FROM pr GROUP BY cell, fold)""",
    select="""SELECT u.ind, u.ng AS n_groups, CAST(u.ni AS BIGINT) AS n_items, round(avg(a), 6) AS accuracy,
  round(CAST(1.0 / u.ng AS DOUBLE), 6) AS chance, round(avg(a) * u.ng, 6) AS lift_over_chance
FROM un u JOIN fa ON fa.cell = u.ind GROUP BY u.ind, u.ng, u.ni""")
ORACLE["domain_shift_mean_lift"] = sql(
    *SHIFT, select="SELECT 'emb' AS model, round(avg(accuracy / chance), 6) AS mean_lift, count(*) AS n_individuals FROM sh")
ORACLE["within_stratum"] = sql(
    EMB,
    """st AS (SELECT '__pooled__' AS cell, item, win, ind, grp, v FROM e UNION ALL SELECT stratum, item, win, ind, grp, v FROM e)""",
    "ok AS (SELECT cell, ind FROM st GROUP BY cell, ind HAVING count(DISTINCT grp) >= 2)",
    "s1 AS (SELECT st.* FROM st JOIN ok ON ok.cell = st.cell AND ok.ind = st.ind)",
    "ga AS (SELECT cell, count(DISTINCT ind) AS k, count(*) AS n FROM s1 GROUP BY cell HAVING count(DISTINCT ind) >= 3 AND count(*) >= 20)",
    "s2 AS (SELECT s1.* FROM s1 JOIN ga ON ga.cell = s1.cell)",
    group_folds("s2", "s3"), unit("s3", "s"), template_predictions("s", "pr"),
    "fa AS (SELECT cell, fold, avg(CAST(truth = pred AS INT)) AS a FROM pr GROUP BY cell, fold)",
    select="""SELECT ga.cell AS stratum, ga.k AS n_individuals, ga.n AS n_items, round(avg(a), 6) AS accuracy,
  round(CAST(1.0 / ga.k AS DOUBLE), 6) AS chance, round(avg(a) * ga.k, 6) AS lift_over_chance
FROM ga LEFT JOIN fa ON fa.cell = ga.cell GROUP BY ga.cell, ga.k, ga.n""")
ORACLE["kinship_permutation"] = sql(
    EMB,
    """d AS (SELECT ind, unnest(range(len(v))) AS d, unnest(v) AS x FROM e),
m AS (SELECT ind, d, avg(x) AS m FROM d GROUP BY ind, d),
t AS (SELECT ind, list(m ORDER BY d) AS q FROM m GROUP BY ind),
fam AS (SELECT ind, min(family) AS family FROM e GROUP BY ind)""",
    unit("t", "tu", "q"),
    """pp AS (SELECT a.ind AS i, b.ind AS j, list_dot_product(a.u, b.u) AS s FROM tu a JOIN tu b ON a.ind < b.ind),
seat AS (SELECT family, row_number() OVER (ORDER BY md5(ind), ind) AS p FROM fam),
sh AS (SELECT perm, ind, row_number() OVER (PARTITION BY perm ORDER BY md5('42|kinship|' || perm || '|' || ind), ind) AS p
  FROM fam, (SELECT unnest(range(2000)) AS perm) x),
lab AS (SELECT perm, ind, family FROM sh JOIN seat USING (p) UNION ALL SELECT -1, ind, family FROM fam),
g AS (
  SELECT a.perm, avg(s) FILTER (WHERE a.family = b.family) AS same, avg(s) FILTER (WHERE a.family <> b.family) AS other,
         count(*) FILTER (WHERE a.family = b.family) AS ns, count(*) FILTER (WHERE a.family <> b.family) AS nd
  FROM pp JOIN lab a ON a.ind = pp.i JOIN lab b ON b.ind = pp.j AND b.perm = a.perm GROUP BY a.perm),
ob AS (SELECT * FROM g WHERE perm = -1),
pv AS (SELECT (count(*) FILTER (WHERE round(g.same - g.other, 12) >= round(ob.same - ob.other, 12)) + 1) / (count(*) + 1) AS p
  FROM g, ob WHERE g.perm >= 0 AND g.same IS NOT NULL AND g.other IS NOT NULL)""",
    select="""SELECT (SELECT count(*) FROM fam) AS n_individuals, (SELECT count(DISTINCT family) FROM fam) AS n_families,
  round(same, 6) AS same_family_similarity, round(other, 6) AS different_family_similarity, round(same - other, 6) AS gap,
  round(p, 6) AS p_permutation, ns AS n_same_family_pairs, nd AS n_different_family_pairs FROM ob, pv""")
ORACLE["split_structure"] = sql(
    LINES,
    "x AS (SELECT 'all' AS subset, ind, grp FROM lo UNION ALL SELECT 'final', ind, grp FROM lo WHERE status = 'F')",
    "k AS (SELECT *, count(*) OVER (PARTITION BY subset, grp) AS k FROM x)",
    "g AS (SELECT subset, grp, count(*) AS n FROM x GROUP BY subset, grp)",
    "p AS (SELECT subset, ind, count(DISTINCT grp) AS n FROM x GROUP BY subset, ind)",
    """a AS (SELECT subset, count(*) AS n_items, count(DISTINCT grp) AS n_groups, 100 * avg(CAST(k = 1 AS INT)) AS pct,
  avg(1 - pow(0.2, k - 1)) AS pany, avg(0.8 * (k - 1)) AS expected FROM k GROUP BY subset)""",
    "b AS (SELECT subset, median(n) AS med, avg(n) AS mean FROM g GROUP BY subset)",
    "c AS (SELECT subset, median(n) AS med FROM p GROUP BY subset)",
    select="""SELECT a.subset, n_items, n_groups, round(CAST(b.med AS DOUBLE), 6) AS items_per_group_median, round(b.mean, 6) AS items_per_group_mean,
  round(pct, 6) AS pct_items_with_no_sibling, round(pany, 6) AS p_any_sibling_in_train, round(CAST(expected AS DOUBLE), 6) AS expected_siblings_in_train,
  round(CAST(c.med AS DOUBLE), 6) AS groups_per_individual_median
FROM a JOIN b ON b.subset = a.subset JOIN c ON c.subset = a.subset""")

EXPERIMENT = (
    EMB, THIN,
    "tc AS (SELECT groups || '-' || items || '-' || draw AS cell, groups, items, draw, 0 AS win, ind, grp, item, v FROM ti)",
    group_folds("tc", "g0", "g_"), unit("g0", "g"), template_predictions("g", "gp", "gt_"),
    dealt_folds("tc", "r0", "thin_fold"), unit("r0", "r"), template_predictions("r", "rp", "rt_"),
    """ga AS (SELECT cell, avg(a) AS a FROM (SELECT cell, fold, avg(CAST(truth = pred AS INT)) AS a FROM gp GROUP BY cell, fold) GROUP BY cell),
ra AS (SELECT cell, avg(a) AS a FROM (SELECT cell, fold, avg(CAST(truth = pred AS INT)) AS a FROM rp GROUP BY cell, fold) GROUP BY cell),
ex AS (SELECT c.groups, c.items, ga.a AS g, ra.a AS r FROM (SELECT DISTINCT cell, groups, items FROM tc) c
  JOIN ga ON ga.cell = c.cell JOIN ra ON ra.cell = c.cell),
ag AS (SELECT groups, items, avg(g) AS g, avg(r) AS r, avg(r - g) AS d, stddev_pop(r - g) AS sd, count(*) AS n FROM ex GROUP BY groups, items)""")
ORACLE["thinning_experiment"] = sql(*EXPERIMENT, select="""SELECT CAST(groups AS BIGINT) AS groups_per_individual, CAST(items AS BIGINT) AS items_per_group,
  CAST(groups * items AS BIGINT) AS items_per_individual, (SELECT count(*) FROM elig) AS n_individuals, round(g, 6) AS accuracy_by_group, round(r, 6) AS accuracy_random,
  round(d, 6) AS leakage_delta, round(sd, 6) AS leakage_delta_sd, n AS n_draws FROM ag WHERE (SELECT count(*) FROM elig) >= 4""")
ORACLE["thinning_rank_correlation"] = sql(*EXPERIMENT, select="""SELECT round(corr(rx, ry), 6) AS spearman, count(*) AS n FROM (
  SELECT rank() OVER (ORDER BY items) + (count(*) OVER (PARTITION BY items) - 1) / 2.0 AS rx,
         rank() OVER (ORDER BY round(d, 9)) + (count(*) OVER (PARTITION BY round(d, 9)) - 1) / 2.0 AS ry FROM ag)""")
ORACLE["item_set_gain"] = sql(
    EMB,
    "s AS (SELECT 'all' AS cell, item, win, ind, grp, v FROM e UNION ALL SELECT 'base', item, win, ind, grp, v FROM e WHERE kind = 'single')",
    group_folds("s", "f0"), unit("f0", "f"), template_predictions("f", "pr"), class_scores("pr", "sc", "cell, fold"),
    """x AS (SELECT cell, avg(accuracy) AS a, stddev_pop(accuracy) AS sd FROM sc GROUP BY cell),
n AS (SELECT cell, count(DISTINCT item) AS n FROM s GROUP BY cell)""",
    select="""SELECT max(n) FILTER (WHERE cell = 'base') AS base_n_items, round(max(a) FILTER (WHERE cell = 'base'), 6) AS base_accuracy,
  round(max(sd) FILTER (WHERE cell = 'base'), 6) AS base_sd, max(n) FILTER (WHERE cell = 'all') AS all_n_items,
  round(max(a) FILTER (WHERE cell = 'all'), 6) AS all_accuracy, round(max(sd) FILTER (WHERE cell = 'all'), 6) AS all_sd,
  round(max(a) FILTER (WHERE cell = 'all') - max(a) FILTER (WHERE cell = 'base'), 6) AS gain FROM x JOIN n USING (cell)""")

ORACLE["item_set_gain_probe"] = ORACLE["item_set_gain"].replace(
    unit("f0", "f") + ",\n" + template_predictions("f", "pr"), probe_predictions("f0", "pr"))
THIN_ALL = THIN.replace("UNION ALL SELECT 3, 4", "UNION ALL SELECT 3, 4 UNION ALL SELECT 2, 6")
EMB_8 = EMB.replace("vec_id % 25", "vec_id % 8")
ORACLE["thinning_all_conditions"] = ORACLE["thinning_experiment"].replace(THIN, THIN_ALL).replace(EMB, EMB_8)

PROBE_DRAWS = THIN.replace("unnest(range(12)) AS draw", "unnest(range(3)) AS draw")
ORACLE["thinning_probe"] = ORACLE["thinning_experiment"].replace(THIN, PROBE_DRAWS).replace(
    unit("g0", "g") + ",\n" + template_predictions("g", "gp", "gt_"), probe_predictions("g0", "gp", "gt_", rate=0.3)).replace(
    unit("r0", "r") + ",\n" + template_predictions("r", "rp", "rt_"), probe_predictions("r0", "rp", "rt_", rate=0.3))

# Frames and vectors ---------------------------------------------------------------------------
FRAMES = """fr AS (SELECT event_id // 200 AS clip, event_id % 200 AS frame, user_id AS grp, event_type AS coeff, value FROM events)"""
WAVES = """wv AS (SELECT event_id // 4000 AS clip, list(value ORDER BY event_id) AS s FROM events GROUP BY clip)"""
ORACLE["group_normalise"] = sql(
    FRAMES, "st AS (SELECT grp, coeff, avg(value) AS m, stddev_pop(value) + 1e-8 AS s FROM fr GROUP BY grp, coeff)",
    select="SELECT clip, frame, fr.grp, fr.coeff, round((value - m) / s, 6) + 0.0 AS normalised FROM fr JOIN st ON st.grp = fr.grp AND st.coeff = fr.coeff")
ORACLE["frame_summary"] = sql(
    FRAMES, "st AS (SELECT clip, coeff, avg(value) AS m, stddev_pop(value) AS s FROM fr GROUP BY clip, coeff)",
    "ls AS (SELECT clip, list(m ORDER BY coeff) || list(s ORDER BY coeff) AS v FROM st GROUP BY clip)",
    select="SELECT clip, unnest(range(len(v))) AS dim, round(unnest(v), 6) AS value FROM ls")
ORACLE["frame_delta"] = sql(
    FRAMES, "n AS (SELECT *, count(*) OVER (PARTITION BY clip) AS t FROM fr)",
    "h AS (SELECT *, least(9, greatest(3, (t // 2) * 2 - 1)) // 2 AS h FROM n)",
    "c AS (SELECT *, least(greatest(frame, h), t - 1 - h) AS centre FROM h)",
    select="""SELECT a.clip, a.frame, round(regr_slope(b.value, CAST(b.frame AS DOUBLE)), 6) + 0.0 AS delta
FROM c a JOIN c b ON b.clip = a.clip AND b.frame BETWEEN a.centre - a.h AND a.centre + a.h GROUP BY a.clip, a.frame""")
# Every step by its formula: windows of 400 samples each 160, Fourier sums, triangular mel filters, decibels, cosine sums.
ORACLE["spectral_coefficients"] = """WITH w AS (
  SELECT event_id // 4000 AS clip, list(CAST(value AS DOUBLE) ORDER BY event_id) AS x FROM events GROUP BY clip),
z AS (SELECT list_transform(range(800), lambda i: CAST(0 AS DOUBLE)) AS zeros),
p AS (SELECT clip, zeros[1:200] || x || zeros[1:greatest(800 - len(x), 0)] || zeros[1:200] AS x FROM w, z),
hann AS (SELECT list_transform(range(400), lambda i: 0.5 - 0.5 * cos(2 * pi() * i / 400)) AS h),
fr AS (
  SELECT clip, t, list_transform(list_zip(x[160 * t + 1:160 * t + 400], h), lambda q: q[1] * q[2]) AS y
  FROM (SELECT clip, x, unnest(range((len(x) - 400) // 160 + 1)) AS t FROM p), hann),
tone AS (
  SELECT k, list_transform(range(400), lambda i: cos(2 * pi() * k * i / 400)) AS c, list_transform(range(400), lambda i: sin(2 * pi() * k * i / 400)) AS s
  FROM (SELECT unnest(range(201)) AS k)),
pw AS (
  SELECT clip, t, list(pow(list_dot_product(y, c), 2) + pow(list_dot_product(y, s), 2) ORDER BY k) AS power FROM fr, tone GROUP BY clip, t),
edge AS (
  SELECT j, CASE WHEN mel < 15 THEN mel * 200 / 3 ELSE 1000 * exp((mel - 15) * ln(6.4) / 27) END AS hz
  FROM (SELECT j, 500 * 3 / 200.0 + j * ((15 + ln(8000 / 1000.0) * 27 / ln(6.4)) - 500 * 3 / 200.0) / 41 AS mel FROM (SELECT unnest(range(42)) AS j))),
filt AS (
  SELECT a.j AS m, list_transform(range(201), lambda k: greatest(0.0, least((k * 40.0 - a.hz) / (b.hz - a.hz), (c.hz - k * 40.0) / (c.hz - b.hz))) * 2.0 / (c.hz - a.hz)) AS f
  FROM edge a JOIN edge b ON b.j = a.j + 1 JOIN edge c ON c.j = a.j + 2),
db AS (SELECT clip, t, m, 10 * log10(greatest(list_dot_product(power, f), 1e-10)) AS d FROM pw, filt),
fl AS (SELECT clip, t, list(greatest(d, top - 80.0) ORDER BY m) AS d FROM (SELECT *, max(d) OVER (PARTITION BY clip) AS top FROM db) GROUP BY clip, t),
basis AS (
  SELECT c, list_transform(range(40), lambda n: cos(pi() * c * (2 * n + 1) / 80) * sqrt(2.0 / 40) / CASE WHEN c = 0 THEN sqrt(2.0) ELSE 1 END) AS b
  FROM (SELECT unnest(range(20)) AS c))
SELECT clip, CAST(t AS BIGINT) AS frame, CAST(c AS BIGINT) AS coeff, round(list_dot_product(d, b), 6) + 0.0 AS value FROM fl, basis"""
ORACLE["spectral_summary"] = ORACLE["spectral_coefficients"].replace("unnest(range(20)) AS c", "unnest(range(12)) AS c").replace(
    "SELECT clip, CAST(t AS BIGINT) AS frame, CAST(c AS BIGINT) AS coeff, round(list_dot_product(d, b), 6) + 0.0 AS value FROM fl, basis",
    """SELECT clip, CAST(i - 1 AS BIGINT) AS dim, round(v[i], 6) + 0.0 AS value FROM (
  SELECT clip, list(m ORDER BY c) || list(s ORDER BY c) AS v, unnest(range(1, 25)) AS i FROM (
    SELECT clip, c, avg(list_dot_product(d, b)) AS m, stddev_pop(list_dot_product(d, b)) AS s FROM fl, basis GROUP BY clip, c) GROUP BY clip)""")
ORACLE["pad_series"] = sql(
    WAVES, "p AS (SELECT clip, s || list_transform(range(greatest(0, 4500 - len(s))), lambda i: 0.0) AS s FROM wv)",
    select="SELECT clip, len(s) AS n, s[1] AS head, s[len(s)] AS tail, round(list_sum(s), 4) AS total FROM p")
ORACLE["mono_mix"] = sql(
    WAVES, "m AS (SELECT clip, list_transform(s, lambda x, i: (x + s[len(s) + 1 - i]) / 2) AS m FROM wv)",
    select="SELECT clip, unnest(range(len(m))) AS pos, round(unnest(m), 6) AS value FROM m")
ORACLE["item_mean_vectors"] = sql(
    EMB, select="SELECT item, unnest(range(32)) AS dim, round(unnest(list_transform(v[1:32], lambda x, i: (x + v[i + 32]) / 2)), 6) + 0.0 AS value FROM e")
ORACLE["unit_vectors"] = sql(
    EMB, unit("e", "x"), select="""SELECT item, round(sqrt(list_dot_product(u, u)), 6) AS length, round(list_dot_product(v, u), 6) AS dot,
  round(list_sum(v) / (sqrt(list_dot_product(v, v)) * sqrt(CAST(len(v) AS DOUBLE))), 6) + 0.0 AS cosine FROM x""")
ORACLE["wide_vector_dump"] = sql(
    EMB, select="SELECT item, " + ", ".join(f"round(v[{i + 1}], 6) + 0.0 AS e{i}" for i in range(64)) + " FROM e")
ORACLE["concat_vectors"] = sql(EMB, select="SELECT item, len(v || v) AS dim, round((v || v)[128], 6) + 0.0 AS last FROM e")

# Inventory, quality, lineage -------------------------------------------------------------------
ORACLE["chance_baselines"] = sql(
    EMB, "c AS (SELECT ind, count(DISTINCT item) AS n FROM e GROUP BY ind)",
    select="SELECT round(CAST(1.0 / count(*) AS DOUBLE), 6) AS chance_inverse_n_individuals, round(max(n) / sum(n), 6) AS chance_majority_class FROM c")
ORACLE["inventory"] = sql(
    EMB, HALVES, select="""SELECT kind, count(DISTINCT item) AS n_items, count(*) AS n_windows, count(DISTINCT ind) AS n_individuals,
  count(DISTINCT grp) AS n_groups, max(len(v)) AS dim FROM w GROUP BY kind""")
ORACLE["size_gates"] = sql(
    EMB, select="""SELECT grp, count(*) AS n, count(DISTINCT ind) AS n_individuals FROM e GROUP BY grp
HAVING count(*) >= 20 AND count(DISTINCT ind) >= 3""")
ORACLE["describe"] = sql(
    LINES, "p AS (SELECT ind, count(DISTINCT item) AS n FROM lo GROUP BY ind)",
    "g AS (SELECT grp, count(DISTINCT ind) AS n FROM lo GROUP BY grp)",
    select="""SELECT 'lines' AS dataset, (SELECT count(*) FROM lo) AS n_rows, (SELECT count(*) FROM p) AS n_individuals,
  (SELECT min(n) FROM p) AS min_items_per_individual, (SELECT max(n) FROM p) AS max_items_per_individual,
  (SELECT count(*) FROM g) AS n_groups, (SELECT count(*) FROM g WHERE n > 1) AS n_shared_groups""")
ORACLE["shared_groups"] = sql(
    EMB, select="SELECT grp, count(DISTINCT ind) AS n_individuals FROM e GROUP BY grp HAVING count(DISTINCT ind) > 1")
ORACLE["finite_filter"] = sql(
    EMB, HALVES,
    "b AS (SELECT item, list_transform(v, lambda x: CASE WHEN win = 1 AND item % 7 = 0 THEN x * CAST('inf' AS DOUBLE) ELSE x END) AS v FROM w)",
    "c AS (SELECT item, list_bool_and(list_transform(v, lambda x: isfinite(x))) AS ok FROM b)",
    select="SELECT item, count(*) FILTER (WHERE ok) AS n_finite, bool_and(ok) AS whole FROM c GROUP BY item")
TOKENS = "('', 'NA', 'na', 'N/A', 'n/a', 'NaN', 'nan')"
ORACLE["missing_tokens"] = sql(
    "a AS (SELECT role, trim(split_part(text, ' ', 1)) AS word FROM conversations)",
    "b AS (SELECT role, ' ' || CASE WHEN length(word) <= 3 THEN 'NA' ELSE lower(word) END || ' ' AS padded FROM a)",
    select=f"""SELECT role, count(*) AS n, count(*) FILTER (WHERE padded IS NULL OR trim(padded) IN {TOKENS}) AS n_missing,
  count(*) FILTER (WHERE padded IS NOT NULL AND trim(padded) NOT IN {TOKENS}) AS n_present FROM b GROUP BY role""")
_missing = "({0} IS NULL OR regexp_replace({0}, '^\\s+|\\s+$', '', 'g') IN ('', 'NA', 'na', 'N/A', 'n/a', 'NaN', 'nan'))"
ORACLE["missing_values"] = f"""SELECT role, count(*) AS n, count(*) FILTER ({_missing.format('text')}) AS n_missing_text,
  count(*) FILTER ({_missing.format("(CASE WHEN turn % 7 = 3 THEN ' N/A ' ELSE role END)")}) AS n_missing_role,
  count(*) FILTER (NOT {_missing.format('text')}) AS n_present_text FROM conversations GROUP BY role"""
ORACLE["dq_report"] = """SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_keys, count(*) - count(DISTINCT doc_id) AS n_duplicates, 'documents' AS source FROM documents
UNION ALL SELECT count(*), count(DISTINCT (l_orderkey, l_linenumber)), count(*) - count(DISTINCT (l_orderkey, l_linenumber)), 'lineitem' FROM lineitem"""
ORACLE["duplicate_keys"] = """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""
ORACLE["missing_group_report"] = """SELECT count(*) AS n_rows, count(*) FILTER (WHERE quality IS NULL) AS n_missing,
  min(doc_id) FILTER (WHERE quality IS NULL) AS first_missing FROM documents LEFT JOIN labels USING (doc_id)"""
ORACLE["problem_report"] = """SELECT lang, status, count(*) AS n, min(doc_id) AS first FROM (
  SELECT lang, doc_id, CASE WHEN quality IS NULL THEN 'absent' WHEN n_chars < 100 THEN 'short' WHEN toxic = 1 THEN 'toxic' ELSE 'ok' END AS status
  FROM documents LEFT JOIN labels USING (doc_id)) WHERE status <> 'ok' GROUP BY lang, status"""
ORACLE["resume_pending"] = "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels"
ORACLE["completeness"] = """WITH found AS (
  SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS model, doc_id AS item FROM labels
  UNION SELECT 'full', doc_id FROM documents),
models AS (SELECT DISTINCT model FROM found UNION SELECT 'never'),
x AS (SELECT m.model, d.doc_id AS item, f.item IS NOT NULL AS have FROM models m CROSS JOIN (SELECT DISTINCT doc_id FROM documents) d
  LEFT JOIN found f ON f.model = m.model AND f.item = d.doc_id),
c AS (SELECT model, count(*) AS n_expected, count(*) FILTER (WHERE have) AS n_found, count(*) FILTER (WHERE NOT have) AS n_missing FROM x GROUP BY model),
r AS (SELECT model, item, row_number() OVER (PARTITION BY model ORDER BY item) AS rn FROM x WHERE NOT have),
s AS (SELECT model, string_agg(CAST(item AS VARCHAR), ',' ORDER BY CAST(item AS VARCHAR)) AS first_missing FROM r WHERE rn <= 3 GROUP BY model)
SELECT c.model, n_expected, n_found, n_missing, CASE WHEN n_found > 0 THEN first_missing END AS first_missing,
  CASE WHEN n_found = 0 THEN 'none' WHEN n_missing > 0 THEN 'incomplete' ELSE 'complete' END AS status
FROM c LEFT JOIN s ON s.model = c.model"""
CHANGED = """a AS (SELECT doc_id, lang, source, n_chars FROM documents),
b AS (SELECT doc_id, CASE WHEN n_chars % 17 = 0 THEN NULL ELSE lang END AS lang, source,
  CASE WHEN n_chars % 11 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE n_chars % 13 <> 0)"""
ORACLE["table_diff"] = sql(
    CHANGED,
    """j AS (SELECT coalesce(a.doc_id, b.doc_id) AS k, a.doc_id IS NOT NULL AS ia, b.doc_id IS NOT NULL AS ib,
  a.lang AS la, b.lang AS lb, a.source AS sa, b.source AS sb, CAST(a.n_chars AS VARCHAR) AS na, CAST(b.n_chars AS VARCHAR) AS nb
  FROM a FULL JOIN b ON a.doc_id = b.doc_id)""",
    """l AS (SELECT k, 'lang' AS col, la AS lv, lb AS rv FROM j WHERE ia AND ib UNION ALL SELECT k, 'source', sa, sb FROM j WHERE ia AND ib
  UNION ALL SELECT k, 'n_chars', na, nb FROM j WHERE ia AND ib
  UNION ALL SELECT k, '__row__', CASE WHEN ia THEN 'present' ELSE 'absent' END, CASE WHEN ib THEN 'present' ELSE 'absent' END FROM j)""",
    "d AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY k) AS rn, count(*) OVER (PARTITION BY col) AS n FROM l WHERE lv IS DISTINCT FROM rv)",
    select='SELECT col AS "column", n AS n_different, CAST(k AS VARCHAR) AS first_key, lv AS left_value, rv AS right_value FROM d WHERE rn = 1')
ORACLE["inventory_diff"] = sql(
    CHANGED, select="""SELECT * FROM (
  SELECT coalesce(a.doc_id, b.doc_id) AS doc_id,
         CASE WHEN b.doc_id IS NULL THEN 'absent' WHEN a.doc_id IS NULL THEN 'added' WHEN a.n_chars <> b.n_chars THEN 'changed' END AS status,
         CAST(a.n_chars AS VARCHAR) AS recorded, CAST(b.n_chars AS VARCHAR) AS current
  FROM a FULL JOIN b ON a.doc_id = b.doc_id) WHERE status IS NOT NULL""")
def digest(cols: list[str]) -> str:
    row = ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in sorted(cols))
    h = f"md5(concat_ws(chr(31), {row}))"
    half = [f"sum(CAST(CAST('0x' || substr(h, {i}, 15) AS BIGINT) AS HUGEINT))" for i in (1, 16)]
    return h, f"md5(count(*) || '|' || {half[0]} || '|' || {half[1]})"


_h, _d = digest(["doc_id", "text", "source", "n_chars"])
ORACLE["content_digest"] = f"SELECT lang, count(*) AS n_rows, {_d} AS digest FROM (SELECT lang, {_h} AS h FROM documents) GROUP BY lang"
ORACLE["text_digest"] = r"SELECT page_id, md5(replace(html, chr(13) || chr(10), chr(10))) AS md5, sha256(html) AS sha256 FROM pages"
_parts = []
for _t, _c in {"documents": ["doc_id", "text", "lang", "source", "n_chars"], "labels": ["doc_id", "quality", "toxic"],
               "pages": ["page_id", "url", "html"]}.items():
    _h, _d = digest(_c)
    _parts.append(f"SELECT '{_t}' AS path, count(*) AS n_rows, {_d} AS md5_content FROM (SELECT {_h} AS h FROM {_t})")
ORACLE["manifest"] = "\nUNION ALL ".join(_parts)
ORACLE["package_digest"] = """SELECT env, md5(string_agg(line, chr(10) ORDER BY line)) AS env_hash FROM (
  SELECT DISTINCT p_brand AS env, lower(regexp_replace(p_name, '[-_.]+', '-', 'g')) || '==' || p_size AS line FROM part) GROUP BY env"""
ORACLE["merkle_digest"] = """WITH l AS (SELECT DISTINCT l_returnflag, md5(l_orderkey || '-' || l_linenumber) AS h FROM lineitem),
s AS (SELECT l_returnflag, left(h, 3) AS slice, md5(string_agg(h, '' ORDER BY h)) AS d, count(*) AS n FROM l GROUP BY l_returnflag, slice)
SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS n_lines, md5(string_agg(slice || '=' || d, chr(10) ORDER BY slice)) AS digest FROM s GROUP BY l_returnflag"""
ORACLE["lineage_gate"] = sql(
    EMB, "s AS (SELECT stratum, CASE WHEN ind IN ('3', '7') THEN 'env-b' ELSE 'env-a' END AS env FROM e)",
    select="""SELECT stratum, count(*) AS n_sets, count(DISTINCT env) AS n_lineages, CAST(0 AS BIGINT) AS n_unstamped,
  count(DISTINCT env) = 1 AS agree, count(*) FILTER (WHERE env <> 'env-a') AS n_foreign FROM s GROUP BY stratum""")
ORACLE["claim_checks"] = """WITH s AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT label) AS DOUBLE) AS k, CAST(max(len(embedding)) AS DOUBLE) AS d FROM embeddings)
SELECT 'n_items' AS "check", n AS expected, n AS observed, CASE WHEN n = n THEN 'pass' ELSE 'fail' END AS outcome FROM s
UNION ALL SELECT 'n_individuals', k + 1, k, CASE WHEN k + 1 = k THEN 'pass' ELSE 'fail' END FROM s
UNION ALL SELECT 'dim', 60.0, d, CASE WHEN abs(d - 60) <= 5 THEN 'pass' ELSE 'fail' END FROM s
UNION ALL SELECT 'absent_figure', 1.0, NULL, 'not run' FROM s"""
ORACLE["subset_filter"] = "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority"
ORACLE["group_minimum_size"] = sql(
    LINES, "b AS (SELECT ind, grp, count(*) AS n FROM lo GROUP BY ind, grp HAVING count(*) >= 5)",
    select="SELECT ind, CAST(sum(n) AS BIGINT) AS n_items, count(*) AS n_groups FROM b GROUP BY ind HAVING count(*) >= 3 AND sum(n) >= 24")
ORACLE["human_sizes"] = """SELECT doc_id, CASE WHEN b < 1024 THEN printf('%.0f B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024)
  WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576) ELSE printf('%.1f GB', b / 1073741824) END AS size
FROM (SELECT doc_id, CAST(n_chars * 997 AS DOUBLE) AS b FROM documents)"""
ORACLE["json_field"] = """SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total FROM (
  SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type"""
ORACLE["deduplicate_first"] = """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_returnflag FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_returnflag) AS rn FROM lineitem) WHERE rn = 1"""
