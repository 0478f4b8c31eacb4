"""Queries on vectors, predictions, training tables and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.functions import expressions as X
from shardloom.functions import vectors as V
from shardloom.operators import grouping as G
from shardloom.operators import heads as H
from shardloom.operators import metrics as M
from shardloom.operators import provenance as K
from shardloom.operators import references as N
from shardloom.operators import similarity as S
from shardloom.operators import training as P
from shardloom.operators.graph import written
from shardloom.plans import tables as T
from shardloom.plans.registry import query
from shardloom.plans.tables import CLASSES, CONFUSION, PREDICTIONS, VERSION, sql_draw
from shardloom.streaming import streams as Z

_METRICS = ["macro_f1", "balanced_accuracy"]


def _r(*columns):
    return [F.round(c, 6).alias(c) for c in columns]


def _sql_r(*columns):
    return ", ".join(f'round("{c}", 6) AS "{c}"' for c in columns)


@query("b8_cosine", "SELECT a.vec_id, round(100 * list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def b8(spark, d):
    v = T.vectors(spark, d)
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return v.join(other, "vec_id").select("vec_id", F.round(V.cosine100(F.col("v"), F.col("w")), 4).alias("cosine"))


_WEIGHTS = [[round(((3 * c + 7 * i) % 11 - 5) / 10, 1) for i in range(64)] for c in range(3)]
_BIAS = [0.1, -0.2, 0.0]


@query("b9_head_logits", "SELECT vec_id, " + ", ".join(
    f"round(list_dot_product(embedding::DOUBLE[], [{', '.join(map(str, w))}]::DOUBLE[]) + ({b}), 5) AS logit_{c}" for c, (w, b) in enumerate(zip(_WEIGHTS, _BIAS, strict=True))) + " FROM embeddings")
def b9(spark, d):
    x = T.vectors(spark, d).select("vec_id", V.head_logits(F.col("v"), _WEIGHTS, _BIAS).alias("s"))
    return x.select("vec_id", *[F.round(F.col("s")[c], 5).alias(f"logit_{c}") for c in range(3)])


@query("b10_softmax_argmax", """WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS s FROM embeddings), e AS (SELECT *, list_transform(s, lambda x: exp(x - list_max(s))) AS e FROM s)
SELECT vec_id, generate_subscripts(e, 1) - 1 AS i, round(unnest(list_transform(e, lambda x: x / list_sum(e))), 6) AS p, list_position(s, list_max(s))::BIGINT - 1 AS top FROM e""")
def b10(spark, d):
    s = T.vectors(spark, d).select("vec_id", V.softmax(F.col("v")).alias("p"), V.argmax(F.col("v")).alias("top"))
    return s.select("vec_id", F.posexplode("p").alias("i", "p"), "top").select("vec_id", F.col("i").cast("long").alias("i"), F.round("p", 6).alias("p"), "top")


def _noise(spark, d):
    n = X.noise_mix(T.vectors(spark, d), "vec_id", "v", 7)
    return n.select(F.col("vec_id").alias("id"), "sigma", V.array_mse(F.col("mixed"), F.col("target")).alias("mse"))


_NOISE = f"""x AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
e AS (SELECT *, 2 * {sql_draw("'noise|7|' || id || '|' || i")} - 1 AS e FROM x),
errors AS (SELECT id, sigma, avg(((1 - sigma) * x + sigma * e - (e - x)) ** 2) AS mse FROM e, (VALUES (0.1::DOUBLE), (0.3), (0.5), (0.7), (0.9)) s(sigma) GROUP BY ALL)"""


@query("b14_noise_mix", f"WITH {_NOISE} SELECT id, sigma, round(mse, 6) AS mse FROM errors")
def b14(spark, d):
    return _noise(spark, d).select("id", "sigma", F.round("mse", 6).alias("mse"))


@query("h13_mse_report", f"""WITH {_NOISE}, r AS (SELECT id, round(avg(mse), 6) AS mse FROM errors GROUP BY 1)
SELECT id, NULL::DOUBLE AS sigma, mse FROM r UNION ALL SELECT NULL, sigma, round(avg(mse), 6) FROM errors GROUP BY sigma UNION ALL SELECT NULL, NULL, round(avg(mse), 6) FROM r""")
def h13(spark, d):
    return M.mse_report(_noise(spark, d))


@query("b15_array_mse", "SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]) ** 2)) / 64, 6) AS mse FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def b15(spark, d):
    v = T.vectors(spark, d)
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return v.join(other, "vec_id").select("vec_id", F.round(V.array_mse(F.col("v"), F.col("w")), 6).alias("mse"))


_BEST = """best AS (SELECT q.vec_id, round(list_dot_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS best, r.vec_id AS reference
  FROM embeddings q JOIN embeddings r ON r.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) DESC, r.vec_id) = 1)"""


def _best(spark, d):
    """The stated query set, every fiftieth vector, against all other vectors."""
    v = T.vectors(spark, d)
    return S.max_similarity(v.where("vec_id % 50 = 0"), v, "vec_id", "v", others=True)


@query("d2_max_similarity", f"WITH {_BEST} SELECT vec_id, best, reference FROM best")
def d2(spark, d):
    return _best(spark, d)


@query("d8_overlap_audit", f"WITH {_BEST} SELECT count(*) AS items, count(*) FILTER (best >= 0.35) AS flagged, max(best) AS highest FROM best")
def d8(spark, d):
    return S.overlap_audit(_best(spark, d), 0.35)


_CENTRED = """norms AS (SELECT vec_id, label, embedding, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings),
flat AS (SELECT vec_id, label, unnest(embedding)::DOUBLE / l AS x, generate_subscripts(embedding, 1) AS i FROM norms)"""


@query("h11_score_generations", f"""WITH {_CENTRED},
p AS (SELECT label AS c, i, avg(x) AS m FROM flat WHERE vec_id % 3 = 0 GROUP BY ALL), r AS (SELECT label AS c, i, avg(x) AS m FROM flat WHERE vec_id % 3 = 1 GROUP BY ALL),
pl AS (SELECT c, sqrt(sum(m * m)) AS l FROM p GROUP BY 1), rl AS (SELECT c, sqrt(sum(m * m)) AS l FROM r GROUP BY 1),
s AS (SELECT f.vec_id, f.label, p.c, round(100 * sum(f.x * p.m / pl.l), 6) AS s FROM flat f JOIN p USING (i) JOIN pl ON pl.c = p.c WHERE f.vec_id % 3 = 2 GROUP BY ALL),
own AS (SELECT vec_id, s AS own FROM s WHERE c = label), near AS (SELECT vec_id, first(c ORDER BY s DESC, c) AS nearest FROM s GROUP BY 1),
ref AS (SELECT f.vec_id, 100 * sum(f.x * r.m / rl.l) AS reference FROM flat f JOIN r ON r.c = f.label AND r.i = f.i JOIN rl ON rl.c = r.c WHERE f.vec_id % 3 = 2 GROUP BY 1)
SELECT near.vec_id, e.label::BIGINT AS label, own, nearest::BIGINT AS nearest, nearest = e.label AS label_ok, round(reference, 6) AS reference FROM near JOIN embeddings e USING (vec_id) LEFT JOIN own USING (vec_id) LEFT JOIN ref USING (vec_id)""")
def h11(spark, d):
    return _scored(spark, d)


def _scored(spark, d):
    v = T.vectors(spark, d)
    prompts = V.mean_vector(v.where("vec_id % 3 = 0").withColumn("v", V.l2_normalise(F.col("v"))), ["label"], "v", "v")
    return N.score_generations(v.where("vec_id % 3 = 2"), prompts, v.where("vec_id % 3 = 1"), "vec_id", "label", "v")


@query("h12_leave_one_out", f"""WITH {_CENTRED}, t AS (SELECT label, i, sum(x) AS s FROM flat GROUP BY ALL), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
rest AS (SELECT f.vec_id, f.label, f.x, t.s - f.x AS o FROM flat f JOIN t ON t.label = f.label AND t.i = f.i)
SELECT vec_id, label::BIGINT AS label, round(CASE WHEN any_value(n) > 1 THEN 100 * sum(x * o) / sqrt(sum(o * o)) END, 6) AS reference FROM rest JOIN n USING (label) GROUP BY ALL""")
def h12(spark, d):
    return N.leave_one_out(T.vectors(spark, d), "vec_id", "label", "v")


@query("h16_steps_sweep", f"""WITH {_CENTRED},
p AS (SELECT label AS c, i, avg(x) AS m FROM flat WHERE vec_id % 3 = 0 GROUP BY ALL), r AS (SELECT label AS c, i, avg(x) AS m FROM flat WHERE vec_id % 3 = 1 GROUP BY ALL),
pl AS (SELECT c, sqrt(sum(m * m)) AS l FROM p GROUP BY 1), rl AS (SELECT c, sqrt(sum(m * m)) AS l FROM r GROUP BY 1),
s AS (SELECT f.vec_id, f.label, p.c, round(100 * sum(f.x * p.m / pl.l), 6) AS s FROM flat f JOIN p USING (i) JOIN pl ON pl.c = p.c WHERE f.vec_id % 3 = 2 GROUP BY ALL),
own AS (SELECT vec_id, s AS own FROM s WHERE c = label), near AS (SELECT vec_id, first(c ORDER BY s DESC, c) AS nearest FROM s GROUP BY 1),
ref AS (SELECT f.vec_id, round(100 * sum(f.x * r.m / rl.l), 6) AS reference FROM flat f JOIN r ON r.c = f.label AND r.i = f.i JOIN rl ON rl.c = r.c WHERE f.vec_id % 3 = 2 GROUP BY 1)
SELECT [1, 2, 4][CAST(near.vec_id // 3 % 3 + 1 AS INTEGER)]::INTEGER AS steps, count(*) AS n, round(avg(own), 3) AS own, round(avg((nearest = e.label)::INT), 4) AS label_accuracy, round(avg(reference), 3) AS reference
FROM near JOIN embeddings e USING (vec_id) LEFT JOIN own USING (vec_id) LEFT JOIN ref USING (vec_id) GROUP BY 1""")
def h16(spark, d):
    steps = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), (F.floor(F.col("vec_id") / 3) % 3 + 1).cast("int"))
    return N.generation_report(_scored(spark, d).withColumn("steps", steps), ["steps"])


@query("a8_predictions", f"WITH {PREDICTIONS}, w AS (SELECT arm, seed, item, " + ", ".join(f"max(score) FILTER (cls = {c}) AS score_c{c}" for c in range(CLASSES)) + " FROM scored GROUP BY ALL) SELECT arm, seed, item, " + ", ".join(f"score_c{c}" for c in range(CLASSES)) + " FROM w")
def a8(spark, d):
    from shardloom.sources.files import score_columns

    return score_columns(T.predictions(spark, d).select("arm", "seed", "item", "scores"), [f"c{c}" for c in range(CLASSES)])


def _confusion(spark, d):
    return M.confusion(T.predictions(spark, d), T.classes(spark))


def _per_class(spark, d):
    return M.class_metrics(_confusion(spark, d))


@query("h1_confusion", f"WITH {CONFUSION} SELECT arm, seed, \"true\", pred, n FROM cm")
def h1(spark, d):
    return _confusion(spark, d)


@query("h2_class_metrics", f"WITH {CONFUSION} SELECT arm, seed, cls, support::BIGINT AS support, predicted::BIGINT AS predicted, {_sql_r('precision', 'recall', 'f1')} FROM class_metrics")
def h2_class(spark, d):
    return _per_class(spark, d).select("arm", "seed", "cls", "support", "predicted", *_r("precision", "recall", "f1"))


@query("h2_run_metrics", f"WITH {CONFUSION} SELECT arm, seed, {_sql_r('macro_f1', 'balanced_accuracy', 'accuracy')}, n::BIGINT AS n, missing_classes, missing FROM run_metrics")
def h2(spark, d):
    return M.run_metrics(_per_class(spark, d)).select("arm", "seed", *_r("macro_f1", "balanced_accuracy", "accuracy"), "n", "missing_classes", "missing")


_AP = f"""{PREDICTIONS}, level AS (SELECT arm, seed, cls, score, count(*) FILTER ("true" = cls) AS p, count(*) AS a FROM scored GROUP BY ALL),
steps AS (SELECT arm, seed, cls, p / nullif(sum(p) OVER (PARTITION BY arm, seed, cls), 0) AS gain, sum(p) OVER w / sum(a) OVER w AS prec FROM level WINDOW w AS (PARTITION BY arm, seed, cls ORDER BY score DESC)),
ap AS (SELECT arm, seed, cls, sum(gain * prec) AS ap FROM steps GROUP BY ALL)"""


def _ap(spark, d):
    return M.average_precision(T.predictions(spark, d))


@query("h3_average_precision", f"WITH {_AP} SELECT arm, seed, cls, round(ap, 6) AS ap FROM ap")
def h3(spark, d):
    return _ap(spark, d).select("arm", "seed", F.col("cls").cast("long").alias("cls"), F.round("ap", 6).alias("ap"))


@query("h4_macro_auprc", f"WITH {_AP} SELECT arm, seed, round(avg(ap), 6) AS macro_auprc FROM ap GROUP BY ALL")
def h4(spark, d):
    return M.macro_auprc(_ap(spark, d)).select("arm", "seed", *_r("macro_auprc"))


@query("h5_metric_summary", f"""WITH {CONFUSION}, l AS (SELECT arm, 'macro_f1' AS metric, macro_f1 AS v FROM run_metrics UNION ALL SELECT arm, 'balanced_accuracy', balanced_accuracy FROM run_metrics)
SELECT arm, metric, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max FROM l GROUP BY ALL""")
def h5(spark, d):
    return M.metric_summary(M.run_metrics(_per_class(spark, d)), _METRICS).select("arm", "metric", *_r("mean", "min", "max"))


_RESAMPLES = 1000
_CONTRASTED = [*_METRICS, "macro_auprc"]
_DRAWS = f"""held AS (SELECT "group", string_agg(DISTINCT "true"::VARCHAR, ',' ORDER BY "true"::VARCHAR) AS stratum FROM predictions GROUP BY 1),
strata AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('strata|' || "group")) - 1 AS idx, count(*) OVER (PARTITION BY stratum) AS size FROM held),
drawn AS (SELECT r AS resample, stratum, floor({sql_draw("'bootstrap|2026|' || r || '|' || stratum || '|' || idx")} * size)::BIGINT AS idx FROM strata, range({_RESAMPLES}) g(r)),
draws AS (SELECT resample, s."group", count(*) AS multiplicity FROM drawn d JOIN strata s ON s.stratum = d.stratum AND s.idx = d.idx GROUP BY ALL)"""


def _draws(spark, d):
    p = T.predictions(spark, d)
    return p, M.bootstrap_draws(M.group_strata(p), _RESAMPLES, 2026)


@query("h6_bootstrap_draws", f"WITH {PREDICTIONS}, {_DRAWS} SELECT resample::BIGINT AS resample, \"group\", multiplicity FROM draws")
def h6(spark, d):
    return _draws(spark, d)[1].select(F.col("resample").cast("long").alias("resample"), "group", "multiplicity")


_CONTRAST = f"""{CONFUSION}, {_DRAWS},
wm AS (SELECT d.resample, p.arm, p.seed, p."true", p.pred, sum(d.multiplicity) AS n FROM draws d JOIN predictions p USING ("group") GROUP BY ALL),
wc AS (SELECT resample, arm, seed, cls, sum(n) FILTER (t) AS support, sum(n) FILTER (NOT t) AS predicted, coalesce(sum(n) FILTER (t AND a = b), 0) AS tp
  FROM (SELECT resample, arm, seed, "true" AS cls, true AS t, "true" AS a, pred AS b, n FROM wm UNION ALL SELECT resample, arm, seed, pred, false, "true", pred, n FROM wm) GROUP BY ALL),
wr AS (SELECT resample, arm, seed, avg(CASE WHEN support > 0 THEN 2 * tp / (support + coalesce(predicted, 0)) END) AS macro_f1, avg(tp / nullif(support, 0)) AS balanced_accuracy FROM wc GROUP BY ALL),
level AS (SELECT arm, seed, cls, score, count(*) FILTER ("true" = cls) AS p, count(*) AS a FROM scored WHERE arm <> 'A' GROUP BY ALL),
steps AS (SELECT arm, seed, cls, p / nullif(sum(p) OVER (PARTITION BY arm, seed, cls), 0) AS gain, sum(p) OVER w / sum(a) OVER w AS prec FROM level WINDOW w AS (PARTITION BY arm, seed, cls ORDER BY score DESC)),
auprc AS (SELECT arm, seed, avg(ap) AS v FROM (SELECT arm, seed, cls, sum(gain * prec) AS ap FROM steps GROUP BY ALL) GROUP BY ALL),
wlevel AS (SELECT resample, arm, seed, cls, score, coalesce(sum(multiplicity) FILTER ("true" = cls), 0) AS p, sum(multiplicity) AS a FROM draws JOIN scored USING ("group") WHERE arm <> 'A' GROUP BY ALL),
wsteps AS (SELECT resample, arm, seed, cls, p / nullif(sum(p) OVER (PARTITION BY resample, arm, seed, cls), 0) AS gain, sum(p) OVER w / sum(a) OVER w AS prec FROM wlevel WINDOW w AS (PARTITION BY resample, arm, seed, cls ORDER BY score DESC)),
wauprc AS (SELECT resample, arm, seed, avg(ap) AS v FROM (SELECT resample, arm, seed, cls, sum(gain * prec) AS ap FROM wsteps GROUP BY ALL) GROUP BY ALL),
ol AS (SELECT arm, seed, 'macro_f1' AS metric, macro_f1 AS v FROM run_metrics UNION ALL SELECT arm, seed, 'balanced_accuracy', balanced_accuracy FROM run_metrics UNION ALL SELECT arm, seed, 'macro_auprc', v FROM auprc),
wl AS (SELECT resample, arm, seed, 'macro_f1' AS metric, macro_f1 AS v FROM wr UNION ALL SELECT resample, arm, seed, 'balanced_accuracy', balanced_accuracy FROM wr UNION ALL SELECT resample, arm, seed, 'macro_auprc', v FROM wauprc),
od AS (SELECT c.metric, avg(c.v - b.v) AS mean_difference FROM ol c JOIN ol b ON b.seed = c.seed AND b.metric = c.metric AND b.arm = 'B' WHERE c.arm = 'C' GROUP BY 1),
wd AS (SELECT c.resample, c.metric, avg(c.v - b.v) AS d FROM wl c JOIN wl b ON b.resample = c.resample AND b.seed = c.seed AND b.metric = c.metric AND b.arm = 'B' WHERE c.arm = 'C' GROUP BY ALL),
contrast AS (SELECT metric, mean_difference, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high, avg((d > 0)::INT) AS above_zero FROM od JOIN wd USING (metric) GROUP BY ALL)"""


def _observed(p, spark):
    return M.run_metrics(M.class_metrics(M.confusion(p, T.classes(spark)))).join(M.macro_auprc(M.average_precision(p)), M.RUN)


def _contrast(spark, d):
    """The draws and the predictions are written once: every resample and metric reads them."""
    p, draws = _draws(spark, d)
    p, draws = written(p, "predictions"), written(draws, "draws")
    both = p.where("arm in ('B', 'C')")
    resampled = M.resampled_metrics(both, draws, T.classes(spark)).join(M.resampled_auprc(both, draws), ["resample", *M.RUN])
    return M.paired_contrast(_observed(both, spark), resampled, "C", "B", _CONTRASTED)


@query("h7_per_seed", f"WITH {_CONTRAST} SELECT c.metric, c.seed, round(c.v - b.v, 6) + 0.0 AS difference FROM ol c JOIN ol b ON b.seed = c.seed AND b.metric = c.metric AND b.arm = 'B' WHERE c.arm = 'C'")
def h7_per_seed(spark, d):
    p = T.predictions(spark, d).where("arm in ('B', 'C')")
    return M.per_seed_contrast(_observed(p, spark), "C", "B", _CONTRASTED).select("metric", "seed", (F.round("difference", 6) + 0.0).alias("difference"))


@query("h7_paired_contrast", f"WITH {_CONTRAST} SELECT metric, {_sql_r('mean_difference', 'low', 'high', 'above_zero')} FROM contrast")
def h7(spark, d):
    return _contrast(spark, d).select("metric", *_r("mean_difference", "low", "high", "above_zero"))


@query("b16_interval_side", f"WITH {_CONTRAST} SELECT metric, CASE WHEN low > 0 THEN 'above zero' WHEN high < 0 THEN 'below zero' ELSE 'includes zero' END AS side FROM contrast")
def b16(spark, d):
    return _contrast(spark, d).select("metric", X.interval_side(F.col("low"), F.col("high")).alias("side"))


def _support(spark, d):
    per = T.predictions(spark, d).where("arm = 'A' and seed = 17").groupBy(F.col("true").alias("cls")).agg(F.count_distinct("group").alias("n_groups"))
    return G.heldout_support(per.withColumn("split", F.lit("test")), "split", 3, 6)


_VERDICT = f"""{_CONTRAST}, support AS (SELECT "true" AS cls, count(DISTINCT "group") AS g FROM predictions WHERE arm = 'A' AND seed = 17 GROUP BY 1),
enough AS (SELECT count(*) FILTER (g < 3) AS insufficient, count(*) FILTER (g >= 3 AND g < 6) AS sparse FROM support),
verdict AS (SELECT CASE WHEN insufficient > 0 THEN 'withheld' WHEN (SELECT min(low) FROM contrast WHERE metric <> 'macro_auprc') > 0 THEN 'better' WHEN (SELECT max(high) FROM contrast WHERE metric <> 'macro_auprc') < 0 THEN 'worse' ELSE 'no co-primary claim' END AS claim, * FROM enough)"""


@query("h8_co_primary_verdict", f"WITH {_VERDICT} SELECT claim, insufficient, sparse FROM verdict")
def h8(spark, d):
    return M.co_primary_verdict(_contrast(spark, d), _support(spark, d))


@query("h9_claim_table", f"""WITH {_VERDICT},
flags AS (SELECT arm, seed, sum(n) FILTER ("true" <> 0 AND pred <> 0) AS v FROM cm GROUP BY ALL), fd AS (SELECT c.v - b.v AS d FROM flags c JOIN flags b ON b.seed = c.seed AND b.arm = 'B' WHERE c.arm = 'C'),
sd AS (SELECT c.v - b.v AS d FROM ol c JOIN ol b ON b.seed = c.seed AND b.metric = c.metric AND b.arm = 'B' WHERE c.arm = 'C' AND c.metric = 'macro_f1')
SELECT 1 AS ord, 'one sign of the macro-F1 change on every seed' AS claim, CASE WHEN min(d) > 0 OR max(d) < 0 THEN 'supported (signal)' ELSE 'not shown' END AS level FROM sd
UNION ALL SELECT 2, 'co-primary rule', claim FROM verdict
UNION ALL SELECT 3, 'ranking without a threshold', CASE WHEN claim = 'withheld' THEN 'withheld' WHEN low > 0 THEN 'above zero' WHEN high < 0 THEN 'below zero' ELSE 'includes zero' END FROM contrast, verdict WHERE metric = 'macro_auprc'
UNION ALL SELECT 4, 'flags more defects', 'descriptive only: ' || CASE WHEN min(d) > 0 THEN 'higher' WHEN max(d) < 0 THEN 'lower' ELSE 'mixed' END FROM fd
UNION ALL SELECT 5, 'improves inspection in practice', 'not tested (operational)'""")
def h9(spark, d):
    contrast = written(_contrast(spark, d), "contrast")
    cm = _confusion(spark, d)
    return M.claim_table(M.run_metrics(M.class_metrics(cm)), contrast, M.co_primary_verdict(contrast, _support(spark, d)), M.detection_counts(cm), "C", "B")


@query("b17_detection_counts", f"""WITH {CONFUSION} SELECT arm, seed, sum(n) FILTER ("true" <> 0)::BIGINT AS defects, sum(n) FILTER ("true" <> 0 AND pred <> 0)::BIGINT AS flagged_defects, sum(n) FILTER ("true" = 0)::BIGINT AS normals,
sum(n) FILTER ("true" = 0 AND pred <> 0)::BIGINT AS false_alarms, sum(n) FILTER ("true" <> 0 AND "true" = pred)::BIGINT AS correct_subtype FROM cm GROUP BY ALL""")
def b17(spark, d):
    return M.detection_counts(_confusion(spark, d))


@query("h10_f1_decomposition", f"""WITH {CONFUSION}, d AS (SELECT seed, cls, sum(CASE arm WHEN 'C' THEN f1 ELSE -f1 END) AS d FROM class_metrics WHERE arm IN ('B', 'C') AND f1 IS NOT NULL GROUP BY ALL)
SELECT seed, cls, round(avg(d), 6) + 0.0 AS change FROM d GROUP BY GROUPING SETS ((seed, cls), (seed), (cls), ())""")
def h10(spark, d):
    return M.f1_decomposition(_per_class(spark, d), "C", "B").select("seed", "cls", (F.round("change", 6) + 0.0).alias("change"))


@query("h15_error_rows", f"""WITH {PREDICTIONS}, w AS (SELECT arm, item, "true", pred, "true" = 0 AS is_majority, row_number() OVER (PARTITION BY arm, "true" = 0 ORDER BY item) AS rank FROM predictions WHERE seed = 17 AND "true" <> pred)
SELECT arm, is_majority, rank, item, "true", pred FROM w WHERE rank <= CASE WHEN is_majority THEN 2 ELSE 6 END""")
def h15(spark, d):
    return M.error_rows(T.predictions(spark, d), 17, 0)


@query("d6_paired_compare", f"""WITH {CONFUSION} SELECT cls AS key, round(avg(f1) FILTER (arm = 'B'), 6) AS before, round(avg(f1) FILTER (arm = 'C'), 6) AS after, round(avg(f1) FILTER (arm = 'C') - avg(f1) FILTER (arm = 'B'), 6) AS change FROM class_metrics GROUP BY 1""")
def d6(spark, d):
    mean = lambda arm: _per_class(spark, d).where(F.col("arm") == arm).groupBy(F.col("cls").alias("key")).agg(F.avg("f1").alias("f1"))
    return M.paired_compare(mean("B"), mean("C"), "key", "f1").select("key", *_r("before", "after", "change"))


@query("g7_majority_baseline", "SELECT vec_id AS item, (SELECT label::BIGINT FROM embeddings WHERE vec_id % 5 <> 0 GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) AS predicted FROM embeddings WHERE vec_id % 5 = 0")
def g7(spark, d):
    v = T.vectors(spark, d)
    return P.majority_baseline(v.where("vec_id % 5 <> 0"), "label", v.where("vec_id % 5 = 0").select(F.col("vec_id").alias("item")))


@query("g8_class_pools", "SELECT label::BIGINT AS cls, vec_id AS item, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS \"index\", count(*) OVER (PARTITION BY label) AS pool_size FROM embeddings")
def g8(spark, d):
    v = T.vectors(spark, d).select(F.col("label").alias("cls"), F.col("vec_id").alias("item"), F.col("vec_id").alias("rank"))
    return P.class_pools(v, "item", "cls", "rank")


_UPDATES = 30
_BASE, _EXTRA = divmod(32, CLASSES)
_SCHEDULE = f"""sizes AS (SELECT label::BIGINT AS cls, count(*) AS pool_size, count(*) FILTER (vec_id % 2 = 0 AND label > 0) AS synth_size FROM embeddings GROUP BY 1),
plan AS (SELECT u, c, {_BASE} + CASE WHEN ((c - u) % {CLASSES} + {CLASSES}) % {CLASSES} < {_EXTRA} THEN 1 ELSE 0 END AS n FROM range({_UPDATES}) a(u), range({CLASSES}) b(c)),
placed AS (SELECT *, sum(n) OVER (PARTITION BY u ORDER BY c) - n AS before FROM plan),
slots AS (SELECT u, c, u * 32 + before + k AS slot FROM placed, range({_BASE + 1}) g(k) WHERE k < n),
schedule AS (SELECT seed, slot::BIGINT AS slot, u AS "update", c AS cls, floor({sql_draw("'real|' || seed || '|' || slot")} * pool_size)::BIGINT AS real_idx, floor({sql_draw("'view|' || seed || '|' || slot")} * 4)::BIGINT AS view,
  {sql_draw("'coin|' || seed || '|' || slot")} AS coin, floor({sql_draw("'synth|' || seed || '|' || slot")} * greatest(1, synth_size))::BIGINT AS synth_idx, synth_size
  FROM (SELECT u, c, slot::BIGINT AS slot, seed FROM slots, (VALUES (17), (29), (43)) s(seed)) x JOIN sizes ON sizes.cls = x.c)"""


def _schedule(spark, v, updates=_UPDATES):
    sizes = v.groupBy(F.col("label").alias("cls")).agg(F.count(F.lit(1)).alias("pool_size"), F.count_if((F.col("vec_id") % 2 == 0) & (F.col("label") > 0)).alias("synth_size"))
    return P.slot_schedule(spark, T.SEEDS, sizes, classes=CLASSES, updates=updates)


@query("g1_slot_schedule", f"WITH {_SCHEDULE} SELECT seed, slot, \"update\", cls, real_idx, view, round(coin, 9) AS coin, synth_idx FROM schedule")
def g1(spark, d):
    return _schedule(spark, T.vectors(spark, d)).select("seed", "slot", "update", "cls", "real_idx", "view", F.round("coin", 9).alias("coin"), "synth_idx")


_SOURCES = f"""{_SCHEDULE}, sources AS (SELECT seed, arm, slot, cls, syn AS synthetic, CASE WHEN syn THEN synth_idx ELSE real_idx END AS "index", CASE WHEN arm = 'A' THEN -1 ELSE view END::BIGINT AS view
  FROM (SELECT *, arm = 'C' AND cls > 0 AND synth_size > 0 AND coin < 0.5 AS syn FROM schedule, (VALUES ('A'), ('B'), ('C')) a(arm)))"""


@query("g2_arm_sources", f"WITH {_SOURCES} SELECT * FROM sources")
def g2(spark, d):
    return P.arm_sources(_schedule(spark, T.vectors(spark, d)))


@query("g3_synthetic_share", f"WITH {_SOURCES} SELECT arm, round(avg(synthetic::INT), 6) AS overall, round(avg(synthetic::INT) FILTER (cls > 0), 6) AS defects FROM sources GROUP BY 1")
def g3(spark, d):
    return P.synthetic_share(P.arm_sources(_schedule(spark, T.vectors(spark, d))))


def _features(v):
    """Pools of real vectors (views -1 to 3) and of synthetic ones (views 0 to 3), numbered within their class; a view stretches its vector."""
    rows = v.select(F.col("label").alias("cls"), F.col("vec_id").alias("item"), F.col("vec_id").alias("rank"), "v")
    stretched = lambda c: F.transform("v", lambda x: x * (1 + (c + 1) / 50.0))
    pool = lambda rows, synthetic, first: P.class_pools(rows, "item", "cls", "rank").join(rows.select("item", "v"), "item").select(
        F.lit(synthetic).alias("synthetic"), "cls", "index", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(3).cast("long"))).alias("view"), "v"
    ).select("synthetic", "cls", "index", "view", stretched(F.col("view")).alias("vector"))
    return pool(rows, False, -1).unionByName(pool(rows.where("item % 2 = 0 and cls > 0"), True, 0))


@query("d5_slot_features", f"""WITH {_SOURCES}, pool AS (SELECT false AS synthetic, label AS cls, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, embedding::DOUBLE[] AS v FROM embeddings
  UNION ALL SELECT true, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1, embedding::DOUBLE[] FROM embeddings WHERE label > 0 AND vec_id % 2 = 0)
SELECT seed, arm, slot, unnest(range(64)) AS i, round(unnest(v) * (1 + (view + 1) / 50.0::DOUBLE), 5) + 0.0 AS x FROM sources s JOIN pool p ON p.synthetic = s.synthetic AND p.cls = s.cls AND p.idx = s."index\"""")
def d5(spark, d):
    v = T.vectors(spark, d)
    slots = P.slot_features(P.arm_sources(_schedule(spark, v)), _features(v))
    return slots.select("seed", "arm", "slot", F.posexplode("vector").alias("i", "x")).select("seed", "arm", "slot", F.col("i").cast("long").alias("i"), (F.round("x", 5) + 0.0).alias("x"))


def _heads(spark, d):
    """(heads of every epoch, their history, the vectors with splits): three arms and three seeds, 30 epochs of 32 updates."""
    v = T.vectors(spark, d).withColumn("split", G.hash_split(F.col("vec_id").cast("string"), VERSION))
    train = v.where("split = 'train'")
    slots = P.slot_features(P.arm_sources(_schedule(spark, train, 30 * H.UPDATES_PER_EPOCH)), _features(train))
    heads = H.fit_heads(slots, classes=CLASSES, size=64)
    return heads, written(H.head_history(heads, v.where("split = 'val'"), "label", "v"), "history"), v


@query("g4_matched_heads")
def g4_heads(spark, d):
    heads, history, _ = _heads(spark, d)
    chosen = H.chosen_heads(heads, history)
    return chosen.select("arm", "seed", "epoch", F.posexplode(F.arrays_zip("weights", "bias")).alias("cls", "h")).select("arm", "seed", "epoch", F.col("cls").cast("long").alias("cls"), "h.weights", "h.bias")


@query("g4_head_history")
def g4_history(spark, d):
    return _heads(spark, d)[1]


@query("g5_head_epochs")
def g5_heads(spark, d):
    return P.select_epoch(_heads(spark, d)[1], M.RUN, "val_macro_f1")


@query("g6_head_export")
def g6_heads(spark, d):
    return P.select_export(P.select_epoch(_heads(spark, d)[1], M.RUN, "val_macro_f1"), T.SEEDS[0], "val_macro_f1")


@query("h2_head_metrics")
def h2_heads(spark, d):
    heads, history, v = _heads(spark, d)
    test = v.where("split = 'test'").select(F.col("vec_id").alias("item"), F.col("label").alias("true"), "v")
    found = written(H.predict(H.chosen_heads(heads, history), test, ["item", "true"], "v"), "predictions")
    return M.run_metrics(M.class_metrics(M.confusion(found, T.classes(spark)))).join(M.macro_auprc(M.average_precision(found)), M.RUN)


@query("g4_fit_head")
def g4(spark, d):
    v = T.vectors(spark, d)
    return P.fit_head(v, "label", "v", maxIter=20, regParam=0.01)


_HISTORY = f"""history AS (SELECT o_orderpriority AS arm, o_orderkey % 30 AS epoch, round(avg(o_totalprice), 2) AS metric FROM orders GROUP BY ALL)"""


def _history(spark, d):
    return T.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("arm"), (F.col("o_orderkey") % 30).alias("epoch")).agg(F.round(F.avg("o_totalprice"), 2).alias("metric"))


@query("g5_select_epoch", f"WITH {_HISTORY} SELECT arm, epoch, metric FROM history QUALIFY row_number() OVER (PARTITION BY arm ORDER BY metric DESC, epoch) = 1")
def g5(spark, d):
    return P.select_epoch(_history(spark, d), ["arm"], "metric")


@query("g6_select_export", f"WITH {CONFUSION} SELECT arm, round(macro_f1, 6) AS macro_f1 FROM run_metrics WHERE seed = 17 ORDER BY macro_f1 DESC, arm LIMIT 1")
def g6(spark, d):
    return P.select_export(M.run_metrics(_per_class(spark, d)), 17, "macro_f1").select("arm", *_r("macro_f1"))


@query("k3_replay_check", """WITH b AS (SELECT vec_id, label, round(list_sum(embedding::DOUBLE[]), 7) AS v FROM embeddings), a AS (SELECT vec_id, label, round(v, 4) AS v FROM b),
side AS (SELECT b.vec_id IS NOT NULL AND a.vec_id IS NOT NULL AS pair, abs(b.v - a.v) AS d, b.label IS NOT DISTINCT FROM a.label AS same FROM b FULL JOIN a ON a.vec_id = b.vec_id),
t AS (SELECT count(*) FILTER (pair) AS n, count(*) FILTER (NOT pair) AS unmatched, bool_and(same) AS decisions_equal, max(d) AS d FROM side)
SELECT n, unmatched, decisions_equal, n > 0 AND unmatched = 0 AND d <= 1e-4 AND decisions_equal AS passed FROM t""")
def k3(spark, d):
    v = T.vectors(spark, d).select("vec_id", "label", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 7).alias("x"))
    return K.replay_check(v, v.withColumn("x", F.round("x", 4)), "vec_id", "x", "label", 1e-4).select("n", "unmatched", "decisions_equal", "passed")


@query("k4_reload_parity", "SELECT count(*) AS n, max(m) < 1.0 AS passed FROM (SELECT list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE - round(x::DOUBLE, 2)))) / 64 AS m FROM embeddings)")
def k4(spark, d):
    v = T.vectors(spark, d).withColumn("w", F.transform("v", lambda x: F.round(x, 2)))
    return v.agg(F.count(F.lit(1)).alias("n"), (F.max(V.array_l1(F.col("v"), F.col("w"))) < 1.0).alias("passed"))


@query("s1_stream_validate", "SELECT event_id, event_type, user_id, value, value >= 20 AND user_id % 9 <> 0 AS clean FROM events")
def s1(spark, d):
    from shardloom.operators.graph import shared_path

    good, bad, state = (shared_path(spark, n) for n in ("good", "bad", "state"))
    rows = Z.read_table(spark, f"{d}/events.parquet").select("event_id", "event_type", "value", "user_id")
    Z.stream_validate(rows, (F.col("value") < 20) | (F.col("user_id") % 9 == 0), good, bad, state).awaitTermination()
    kept = lambda path, flag: Z.read_committed(spark, path, f"{good}-commits", rows.schema).withColumn("clean", F.lit(flag))
    return kept(good, True).unionByName(kept(bad, False))


@query("s2_stream_first_seen", "SELECT count(DISTINCT (event_type, user_id)) AS n FROM events")
def s2(spark, d):
    rows = Z.read_table(spark, f"{d}/events.parquet").select("ts", "event_type", "user_id")
    return Z.drained(Z.stream_first_seen(rows, ["event_type", "user_id"], "ts", "3650 days")).agg(F.count(F.lit(1)).alias("n"))


@query("s2_stream_eligibility", """WITH x AS (SELECT event_id, event_type, ts, user_id % 17 = 0 AS undecoded, value < 3 AS small, event_type || '|' || user_id AS digest FROM events),
early AS (SELECT *, CASE WHEN undecoded THEN 'decode-failure' WHEN small THEN 'too small' END AS early FROM x),
seen AS (SELECT event_id, row_number() OVER (PARTITION BY digest ORDER BY ts, event_id) AS k FROM early WHERE early IS NULL)
SELECT event_id, CASE WHEN early IS NULL AND k = 1 THEN 'eligible' ELSE 'rejected' END AS status, coalesce(early, CASE WHEN k > 1 THEN 'exact duplicate of an earlier candidate' ELSE '' END) AS reason FROM early LEFT JOIN seen USING (event_id)""")
def s2_rows(spark, d):
    """Every event with status and reason: a user's first event of a type is eligible, unless a rule of the row refuses it."""
    rows = Z.read_table(spark, f"{d}/events.parquet").select("event_id", "ts", "user_id", "value", F.concat_ws("|", "event_type", "user_id").alias("digest"))
    rules = [(F.col("user_id") % 17 == 0, "decode-failure"), (F.col("value") < 3, "too small")]
    return Z.drained(Z.stream_eligibility(rows, "event_id", "digest", "ts", rules, delay="30 days", keep="3650 days"))


@query("s3_stream_status", "SELECT event_type, count(*) AS attempted, count(*) FILTER (value > 50) AS usable FROM events GROUP BY 1")
def s3(spark, d):
    rows = Z.read_table(spark, f"{d}/events.parquet")
    return Z.drained(Z.stream_status(rows, "event_type", F.col("value") > 50), "complete")


@query("s3_stream_windows", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS attempted, count(*) FILTER (value > 50) AS usable FROM events GROUP BY ALL")
def s3_windows(spark, d):
    rows = Z.read_table(spark, f"{d}/events.parquet")
    return Z.drained(Z.stream_status(rows, "event_type", F.col("value") > 50, "ts"), "complete")


@query("s3_closed_windows", """WITH w AS (SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS attempted, count(*) FILTER (value > 50) AS usable FROM events GROUP BY ALL)
SELECT * FROM w WHERE start + INTERVAL '1 day' <= (SELECT max(date_trunc('millisecond', ts)) FROM events) - INTERVAL '1 day'""")
def s3_closed(spark, d):
    """The days that the watermark has closed, each appended once."""
    rows = Z.read_table(spark, f"{d}/events.parquet")
    return Z.drained(Z.stream_status(rows, "event_type", F.col("value") > 50, "ts"), "append")


@query("s4_stream_hash_split", f"SELECT event_id, CASE WHEN {sql_draw(f"'{VERSION}|split|' || event_id")} < 0.6 THEN 'train' WHEN {sql_draw(f"'{VERSION}|split|' || event_id")} < 0.8 THEN 'val' ELSE 'test' END AS split FROM events")
def s4(spark, d):
    rows = Z.read_table(spark, f"{d}/events.parquet").select("event_id")
    return Z.drained(Z.stream_hash_split(rows, "event_id", VERSION))
