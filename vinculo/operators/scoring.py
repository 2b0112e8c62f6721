"""Features, splits, models, calibration, metrics and the bootstrap of the default-score experiment."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinculo.functions.columns import default_label, logit
from vinculo.functions.prefix import quantiles, ranked, running
from vinculo.functions.runtime import materialize, small

LOAN_FEATURES = ["monto_original_mxn", "saldo_vigente_mxn", "tasa_interes_anual", "dias_mora", "nivel_ingresos", "antiguedad_cliente_meses", "score_buro", "historico_incumplimientos"]
BORROWER_FEATURES = ["leverage", "interest_coverage", "cash_buffer"]
GRAPH_FEATURES = ["relationship_count", "guaranteed_exposure", "connected_financial_stress"]


def loan_features(pre: DataFrame, cli: DataFrame) -> DataFrame:
    """Individual loans with borrower fields, label, and only rows in which no feature is null."""
    rows = pre.where("tipo_titular = 'INDIVIDUAL'").join(cli, F.col("id_titular") == F.col("id_cliente"))
    return rows.select("id_prestamo", *LOAN_FEATURES, default_label().alias("label")).dropna(subset=LOAN_FEATURES)


def dropped_for_nulls(df: DataFrame, features: list[str]) -> DataFrame:
    absent = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in features])
    return df.agg(F.count("*").alias("rows"), F.count_if(absent).alias("dropped"))


def hash_share(col: str, seed: int = 0):
    """A share in [0, 1) from the md5 of seed and key: the same on any partitioning and in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.col(col).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def split_rows(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    s = hash_share(key, seed)
    return df.withColumn("split", F.when(s < 0.6, "train").when(s < 0.8, "calibration").otherwise("test"))


def split_groups(groups: DataFrame, seed: int, group: str = "group_id") -> DataFrame:
    """(group, split): whole groups, in md5 order of seed and group, cut at int(0.6 n) and int(0.8 n)."""
    return split_by_seeds(groups, [seed], group).drop("seed")


def split_by_seeds(groups: DataFrame, seeds: list[int], group: str = "group_id") -> DataFrame:
    """(seed, group, split) of ``split_groups`` for all ``seeds`` at once; ranks come from range partitions."""
    g = groups.select(group).distinct().withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    g = g.withColumn("_order", F.md5(F.concat(F.col("seed").cast("string"), F.lit("-"), F.col(group).cast("string"))))
    g = ranked(g, ["_order", group], ["seed"], "rn")
    n = g.groupBy("seed").agg(F.count("*").alias("n"))
    share = lambda q: F.floor(F.col("n") * q)
    return g.join(F.broadcast(n), "seed").select("seed", group, F.when(F.col("rn") <= share(0.6), "train").when(F.col("rn") <= share(0.8), "calibration").otherwise("test").alias("split"))  # one row a seed


def split_membership(borrowers: DataFrame, seeds: list[int]) -> DataFrame:
    """(seed, borrower_id, group_id, split) for each seed."""
    return borrowers.select("borrower_id", "group_id").join(split_by_seeds(borrowers, seeds), "group_id").select("seed", "borrower_id", "group_id", "split")


def split_counts(members: DataFrame, label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    return members.groupBy(*by, "split").agg(F.count("*").alias("borrowers"), F.countDistinct("group_id").alias("groups"), F.sum(label).alias("positives"), (F.min(label) < F.max(label)).alias("both_classes"))


def class_balance(df: DataFrame, by: list[str] | None = None, label: str = "label") -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.sum(label).alias("positives"), F.round(F.mean(label), 6).alias("rate"))


def class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """(weight): (1 - p) / p of the positives, 1 when there are none."""
    p = F.mean(label)
    return df.agg(F.when(p > 0, F.round((1 - p) / p, 6)).otherwise(1.0).alias("weight"))


def graph_features(borrowers: DataFrame, edges: DataFrame) -> DataFrame:
    """Borrowers with out-degree, sum of the neighbours' balances and mean of their stress (0, 0, null without edges)."""
    there = borrowers.select(F.col("borrower_id").alias("dst"), F.col("balance").alias("b"), F.col("stress").alias("s"))
    agg = edges.select("src", "dst").join(there, "dst").groupBy(F.col("src").alias("borrower_id")).agg(F.count("*").alias("relationship_count"), F.round(F.sum("b"), 2).alias("guaranteed_exposure"), F.round(F.mean("s"), 6).alias("connected_financial_stress"))
    return borrowers.join(agg, "borrower_id", "left").fillna({"relationship_count": 0, "guaranteed_exposure": 0.0})


def feature_names(graph: bool) -> list[str]:
    """Only fields known at observation time can be features."""
    return BORROWER_FEATURES + (GRAPH_FEATURES if graph else [])


def fit_logistic(train: DataFrame, features: list[str], label: str = "label") -> PipelineModel:
    """Logistic regression with a unit L2 penalty on features standardised with the training rows' figures.

    The scaler divides by the sample deviation; (n - 1) / n takes the penalty to that of the population deviation.
    """
    n = max(train.count(), 1)
    lr = LogisticRegression(featuresCol="scaled", labelCol=label, regParam=max(n - 1, 1) / n**2, standardization=False, tol=1e-9, maxIter=1000)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), lr]).fit(train)


def fit_gbt(train: DataFrame, features: list[str], label: str = "label", trees: int = 150, depth: int = 4, rate: float = 0.04, weight: str | None = None, seed: int = 7) -> PipelineModel:
    gbt = GBTClassifier(featuresCol="raw", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)
    gbt = gbt.setWeightCol(weight) if weight else gbt
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep"), gbt]).fit(train)


def importances(model: PipelineModel, features: list[str], spark) -> DataFrame:
    rows = [(f, float(x)) for f, x in zip(features, model.stages[-1].featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def predict(model: PipelineModel, rows: DataFrame, name: str = "p") -> DataFrame:
    return model.transform(rows).withColumn(name, vector_to_array("probability")[1]).drop("raw", "scaled", "rawPrediction", "probability", "prediction")


def constant_model(train: DataFrame, label: str = "label") -> float:
    return train.agg(F.mean(label)).first()[0] or 0.0


def calibrate(cal: DataFrame, rows: DataFrame, raw: str = "p", label: str = "label") -> DataFrame:
    """``rows`` with p_calibrated: a sigmoid on the clipped logit, fitted on calibration rows only."""
    stage = lambda df: df.withColumn("_logit", logit(F.col(raw)))
    lr = LogisticRegression(featuresCol="_x", labelCol=label, regParam=0.0)
    model = Pipeline(stages=[VectorAssembler(inputCols=["_logit"], outputCol="_x"), lr]).fit(stage(cal))
    return model.transform(stage(rows)).withColumn("p_calibrated", vector_to_array("probability")[1]).drop("_logit", "_x", "rawPrediction", "probability", "prediction")


def platt_raw(cal: DataFrame, rows: DataFrame, raw: str = "p", label: str = "label") -> DataFrame:
    """The older form: a sigmoid on the raw score."""
    model = Pipeline(stages=[VectorAssembler(inputCols=[raw], outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol=label)]).fit(cal)
    return model.transform(rows).withColumn("p_calibrated", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def compare_scores(rows: DataFrame, key: str, n: int = 15) -> DataFrame:
    return rows.select(key, "p", "p_calibrated").orderBy(F.desc("p"), key).limit(n)


def score_all(rows: DataFrame, version: str, date: str, model: str, key: str = "id_prestamo", p: str = "p_calibrated") -> DataFrame:
    return rows.select(key, F.col(p).alias("probabilidad_incumplimiento"), F.lit(version).alias("score_version"), F.lit(date).alias("score_fecha"), F.lit(model).alias("model_name"))


def _loss(y: str, p: str) -> tuple[Column, Column]:
    """Squared error and log loss of a row."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    return (F.col(p) - F.col(y)) ** 2, -(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))


def binary_metrics(pred: DataFrame, keys: list[str], y: str = "y", p: str = "p", weight: str | None = None) -> DataFrame:
    """(keys.., roc_auc, average_precision, brier, log_loss), rows weighted if asked.

    Rows are first summed by distinct score, so ties are exact; the sums of higher scores are prefix sums over range
    partitions, so one key with very many scores is not one task. Without rows there is no result row, but one without keys.
    """
    w = F.col(weight) if weight else F.lit(1)
    sq, ll = _loss(y, p)
    by = pred.groupBy(*keys, (-F.col(p)).alias("down")).agg(F.sum(w * F.col(y)).alias("pos"), F.sum(w * (1 - F.col(y))).alias("neg"), F.sum(w * sq).alias("sq"), F.sum(w * ll).alias("ll"))
    c = running(by, ["down"], ["pos", "neg"], keys).withColumnsRenamed({"pos_upto": "tp", "neg_upto": "fp"})
    pos, neg = F.sum("pos"), F.sum("neg")
    # within a score, half of the pairs of a positive and a negative count
    pairs = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return c.groupBy(*keys).agg(
        F.round(F.try_divide(pairs, pos * neg), 6).alias("roc_auc"), F.round(F.try_divide(F.sum(F.col("pos") * F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))), pos), 6).alias("average_precision"),
        F.round(F.sum("sq") / (pos + neg), 6).alias("brier"), F.round(F.sum("ll") / (pos + neg), 6).alias("log_loss"))


def classification_report(pred: DataFrame, y: str = "y", p: str = "p", cut: float = 0.5) -> DataFrame:
    """(class, tp, fp, fn, precision, recall, f1, support); a division by zero gives 0."""
    rows = pred.select(F.col(y).cast("int").alias("y"), (F.col(p) >= cut).cast("int").alias("h")).groupBy("y", "h").agg(F.count("*").alias("n"))
    each = rows.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("class"), "y", "h", "n")
    is_y, is_h = F.col("y") == F.col("class"), F.col("h") == F.col("class")
    s = each.groupBy("class").agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(n) for n, c in (("tp", is_y & is_h), ("fp", ~is_y & is_h), ("fn", is_y & ~is_h))])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    s = s.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return s.select("class", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def calibration_curve(pred: DataFrame, keys: list[str], bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """(keys.., bin, n, mean_score, event_rate) over quantile bins; empty bins do not appear."""
    edges = quantiles(pred, p, [i / bins for i in range(1, bins)], keys, "edges")
    rows = pred.join(small(edges), keys) if keys else pred.crossJoin(F.broadcast(edges))  # one row of edges
    which = F.size(F.filter("edges", lambda e: e < F.col(p)))
    return rows.groupBy(*keys, which.alias("bin")).agg(F.count("*").alias("n"), F.round(F.mean(p), 6).alias("mean_score"), F.round(F.mean(y), 6).alias("event_rate"))


#: Draws of a run are tried up to so many times the replicates asked for.
ATTEMPTS = 20


def _draws(counts: DataFrame, run: list[str], first: int, last: int, seed: int) -> DataFrame:
    """(run.., attempt, i, w): how often attempts first..last - 1 draw group i of a run with n groups; counts(run.., n)."""
    share = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(k).cast("string") for k in run], "attempt", "j")), 1, 8), 16, 10).cast("double") / 4294967296.0
    each = counts.withColumn("attempt", F.explode(F.sequence(F.lit(first), F.lit(last - 1)))).repartition(*run, "attempt")
    drawn = each.select(*run, "n", "attempt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("j"))
    return drawn.select(*run, "attempt", F.floor(share * F.col("n")).alias("i")).groupBy(*run, "attempt", "i").agg(F.count("*").alias("w"))


def group_bootstrap(pred: DataFrame, keys: list[str], replicates: int, seed: int = 0, y: str = "y", p: str = "p", group: str = "group_id", model: str = "model") -> DataFrame:
    """(replicate, keys.., metrics): a run's groups drawn with replacement, the same draws for every model of the run.

    A run is what ``keys`` tell apart besides ``model``. It draws as often as it has groups of its own; draw j of an attempt
    takes the group at an md5 share of them. Attempts whose rows hold one class are passed over; attempts are made only as
    runs still need them, at most ATTEMPTS times ``replicates``, and it is an error if a run has too few. Replicates are
    numbered from 0 in every run. Squared error and log loss are sums over groups; ranks use weighted scores. Group ids
    are not null.
    """
    run = [k for k in keys if k != model]
    own = pred.groupBy(*run, group).agg(F.max(F.col(y).cast("int")).alias("pos"), F.max(1 - F.col(y).cast("int")).alias("neg"))
    groups = materialize(ranked(own, [group], run, "i").withColumn("i", F.col("i") - 1))
    counts = materialize(groups.groupBy(*run).agg(F.count("*").alias("n")))
    if counts.isEmpty():
        raise ValueError("no groups to draw from")
    weights, lacking, first, size = None, counts, 0, replicates
    while first < replicates * ATTEMPTS:
        last = min(first + size, replicates * ATTEMPTS)
        drawn = _draws(lacking, run, first, last, seed).join(groups, [*run, "i"])
        both = (F.max("pos").over(Window.partitionBy(*run, "attempt")) > 0) & (F.max("neg").over(Window.partitionBy(*run, "attempt")) > 0)
        drawn = materialize(drawn.withColumn("both", both).where("both").select(*run, "attempt", group, "w"))
        weights = drawn if weights is None else weights.unionByName(drawn)
        have = weights.groupBy(*run).agg(F.countDistinct("attempt").alias("have"))
        left = counts.join(have, run, "left") if run else counts.join(have)
        lacking = materialize(left.where(F.coalesce("have", F.lit(0)) < replicates).select(*run, "n"))
        if lacking.isEmpty():
            break
        first, size = last, size * 2
    else:
        raise ValueError("too few draws hold both classes")
    number = F.row_number().over(Window.partitionBy(*run).orderBy("attempt")) - 1  # at most ATTEMPTS x replicates rows a run
    taken = weights.select(*run, "attempt").distinct().withColumn("replicate", number).where(F.col("replicate") < replicates)
    weights = weights.join(taken, [*run, "attempt"]).select(*run, "replicate", group, "w")
    sq, ll = _loss(y, p)
    sums = pred.groupBy(*keys, group).agg(F.count("*").alias("n"), F.sum(sq).alias("sq"), F.sum(ll).alias("ll")).join(weights, [*run, group])
    total = F.sum(F.col("w") * F.col("n"))
    added = sums.groupBy("replicate", *keys).agg(F.round(F.sum(F.col("w") * F.col("sq")) / total, 6).alias("brier"), F.round(F.sum(F.col("w") * F.col("ll")) / total, 6).alias("log_loss"))
    scores = pred.groupBy(*keys, group, p).agg(F.sum(y).alias("pos"), F.count("*").alias("n")).join(weights, [*run, group])
    scores = scores.groupBy("replicate", *keys, p).agg(F.sum(F.col("w") * F.col("pos")).alias("pos"), F.sum(F.col("w") * (F.col("n") - F.col("pos"))).alias("neg"))
    up = Window.partitionBy("replicate", *keys).orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)  # a replicate of one model: the scores of a run's test rows
    c = scores.withColumn("tp", F.sum("pos").over(up)).withColumn("all", F.sum(F.col("pos") + F.col("neg")).over(up))
    pos, neg = F.sum("pos"), F.sum("neg")
    ranks = c.groupBy("replicate", *keys).agg(
        F.round(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)) / (pos * neg), 6).alias("roc_auc"),
        F.round(F.sum(F.col("pos") * F.col("tp") / F.col("all")) / pos, 6).alias("average_precision"))
    return ranks.join(added, ["replicate", *keys]).select("replicate", *keys, *METRICS)


METRICS = ["roc_auc", "average_precision", "brier", "log_loss"]


def intervals(boot: DataFrame, keys: list[str]) -> DataFrame:
    """2.5 and 97.5 percentiles of each metric."""
    long = boot.select(*keys, F.expr(f"stack({len(METRICS)}, {', '.join(f'{chr(39)}{m}{chr(39)}, {m}' for m in METRICS)}) as (metric, value)"))
    e = long.groupBy(*keys, "metric").agg(F.percentile("value", F.array(F.lit(0.025), F.lit(0.975))).alias("e"))  # a buffer of replicates
    return e.select(*keys, "metric", F.round(F.col("e")[0], 6).alias("low"), F.round(F.col("e")[1], 6).alias("high"))


def summarise(metrics: DataFrame, boot: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of each metric over seeds, with the interval of the seed-averaged bootstrap."""
    long = metrics.select(*keys, F.expr(f"stack({len(METRICS)}, {', '.join(f'{chr(39)}{m}{chr(39)}, {m}' for m in METRICS)}) as (metric, value)"))
    mean = long.groupBy(*keys, "metric").agg(F.round(F.mean("value"), 6).alias("mean"))
    averaged = boot.groupBy("replicate", *keys).agg(*[F.mean(m).alias(m) for m in METRICS])
    return mean.join(intervals(averaged, keys), [*keys, "metric"])


def uplift(metrics: DataFrame, boot: DataFrame, keys: list[str], seed: str, model: str, base: str) -> DataFrame:
    """(keys.., metric, mean, low, high): what ``model`` gains over ``base``.

    The mean is the difference of the two models' means over seeds; the interval is that of the
    paired difference in every seed and replicate, averaged over seeds.
    """
    side = lambda m, s: boot.where(F.col("model") == m).select("replicate", seed, *keys, *[F.col(x).alias(f"{x}_{s}") for x in METRICS])
    d = side(model, "a").join(side(base, "b"), ["replicate", seed, *keys]).select("replicate", *keys, *[(F.col(f"{x}_a") - F.col(f"{x}_b")).alias(x) for x in METRICS])
    averaged = d.groupBy("replicate", *keys).agg(*[F.mean(x).alias(x) for x in METRICS])
    gain = [(F.mean(F.when(F.col("model") == model, F.col(x))) - F.mean(F.when(F.col("model") == base, F.col(x)))).alias(x) for x in METRICS]
    mean = metrics.groupBy(*keys).agg(*gain).select(*keys, F.expr(f"stack({len(METRICS)}, {', '.join(f'{chr(39)}{m}{chr(39)}, {m}' for m in METRICS)}) as (metric, mean)"))
    return mean.withColumn("mean", F.round("mean", 6)).join(intervals(averaged, keys), [*keys, "metric"])


def experiment_tables(pred: DataFrame, replicates: int = 200, members: DataFrame | None = None, seed: str = "seed", model: str = "gbt_graph", base: str = "gbt") -> dict[str, DataFrame]:
    """The result tables of an experiment by name, from ``run_sweep``'s predictions and, if given, ``sweep_members``.

    runs: metrics of the calibrated scores of every run and model; raw: those before calibration, if ``p_raw`` is there; curves: reliability
    curves; intervals: 2.5 and 97.5 percentiles of each run's bootstrap; summary, uplift, best: over seeds;
    split_counts: borrowers, groups and positives of each part of each run.
    """
    keys = ["condition", seed, "model"]
    pred = materialize(pred)
    boot = materialize(group_bootstrap(pred, keys, replicates))
    runs = materialize(binary_metrics(pred, keys))
    summary = summarise(runs, boot, ["condition", "model"])
    out = {"runs": runs, "curves": calibration_curve(pred, keys), "intervals": intervals(boot, keys)}
    out |= {"raw": binary_metrics(pred, keys, p="p_raw")} if "p_raw" in pred.columns else {}
    out |= {"summary": summary, "uplift": uplift(runs, boot, ["condition"], seed, model, base), "best": best_model(summary, ["condition"])}
    return out | ({} if members is None else {"split_counts": split_counts(members, by=("condition", seed))})


def best_model(summary: DataFrame, keys: list[str]) -> DataFrame:
    rows = summary.where("metric = 'average_precision'")
    return rows.groupBy(*keys).agg(F.max_by("model", F.struct("mean", "model")).alias("model"), F.max("mean").alias("average_precision"))


def held_out_counts(borrowers: DataFrame, seeds: list[int]) -> DataFrame:
    """(seed, positives, borrowers) of the test part under each seed's split."""
    test = split_by_seeds(borrowers, seeds).where("split = 'test'")
    return borrowers.select("group_id", "label").join(test, "group_id").groupBy("seed").agg(F.sum("label").alias("positives"), F.count("*").alias("borrowers"))


Conditions = dict[str, tuple[DataFrame, DataFrame]]


def sweep_members(conditions: Conditions, seeds: list[int]) -> DataFrame:
    """(condition, seed, borrower_id, group_id, split, label): who is in which part of which run."""
    parts = [split_membership(b, seeds).join(b.select("borrower_id", "label"), "borrower_id").withColumn("condition", F.lit(name)) for name, (b, _) in conditions.items()]
    return reduce(DataFrame.unionByName, parts)


#: Models of a sweep that are fitted at a time: each fit is thousands of short jobs one after the other, which leave most cores idle.
FITS = 8


def run_sweep(conditions: Conditions, seeds: list[int], trees: int = 150) -> DataFrame:
    """(condition, seed, model, borrower_id, group_id, y, p_raw, p): test predictions of four models before and after calibration.

    ``conditions`` maps a name to (borrowers with label, edges). A part of a split with one class is an error. Only
    fits are one job after the other, ``FITS`` models at a time; metrics and bootstraps run once over the union. Conditions with the same borrowers share
    their splits and all models without graph features, which see the same rows in each.
    """
    spark = next(iter(conditions.values()))[0].sparkSession
    rows, splits, fits = {}, {}, []
    for name, (borrowers, edges) in conditions.items():
        rows[name] = materialize(graph_features(borrowers, edges).fillna({"connected_financial_stress": 0.0}))
        if id(borrowers) not in splits:
            splits[id(borrowers)] = materialize(split_by_seeds(rows[name], seeds))
            fits += [(name, seed, model) for seed in seeds for model in ("constant", "logistic", "gbt")]
        fits += [(name, seed, "gbt_graph") for seed in seeds]

    def parts_of(run: tuple[str, int]) -> dict[str, DataFrame]:
        name, seed = run
        whole = materialize(rows[name].join(splits[id(conditions[name][0])].where(F.col("seed") == seed).drop("seed"), "group_id"))
        if whole.groupBy("split").agg(F.countDistinct("label").alias("n")).where("n < 2").count():
            raise ValueError("each part must hold both classes")
        return {s: whole.where(F.col("split") == s).drop("split") for s in ("train", "calibration", "test")}

    def predicted(fit: tuple[str, int, str]) -> DataFrame:
        name, seed, model = fit
        part = parts[name, seed]
        if model == "constant":
            rate = float(constant_model(part["train"]))
            raw = lambda df: df.withColumn("p", F.lit(rate))
        else:
            features = feature_names(model == "gbt_graph")
            fitted = fit_logistic(part["train"], features) if model == "logistic" else fit_gbt(part["train"], features, trees=trees)
            raw = lambda df: predict(fitted, df)
        pred = calibrate(raw(part["calibration"]), raw(part["test"]))
        return pred.select(F.lit(seed).alias("seed"), F.lit(model).alias("model"), "borrower_id", "group_id", F.col("label").alias("y"), F.col("p").alias("p_raw"), F.col("p_calibrated").alias("p"))

    with ThreadPool(FITS) as pool:
        runs = [(name, seed) for name in conditions for seed in seeds]
        parts = dict(zip(runs, pool.map(inheritable_thread_target(spark)(parts_of), runs, 1), strict=True))
        made = dict(zip(fits, pool.map(inheritable_thread_target(spark)(predicted), fits, 1), strict=True))
    out = []
    for name, seed in runs:
        first = next(x for x, (borrowers, _) in conditions.items() if borrowers is conditions[name][0])
        for model in ("constant", "logistic", "gbt", "gbt_graph"):
            pred = made[name if model == "gbt_graph" else first, seed, model]
            out.append(pred.select(F.lit(name).alias("condition"), *pred.columns))
    return reduce(DataFrame.unionByName, out)
