"""Correlation, fences and simple model comparison."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.ordered import average_ranks, counted, quantiles
from quillon.operators.pieces import pieces


LEAST_ROWS = 20


def pearson(x: str, y: str) -> Column:
    """Over rows that have both; null under three rows or if a side is constant; within -1 and 1."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    value = F.try_divide(F.covar_pop(a, b), F.nullif(spread, F.lit(0.0)))
    return F.when((F.count_if(both) >= 3) & value.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The upper triangle with the number of rows used, from one aggregation."""
    parts = [
        F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), pearson(x, y).alias("r"), F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n"))
        for x, y in combinations(columns, 2)
    ]
    return df.agg(F.array(*parts).alias("all")).select(F.inline("all"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson of average ranks over rows that have both."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    ranked = average_ranks(average_ranks(both, x, "rank_x"), y, "rank_y")
    return ranked.agg(pearson("rank_x", "rank_y").alias("rho"), F.count("*").alias("n"))


def fences(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Tukey's fences; null under eight values or without spread."""
    found = quantiles(df, column, (0.25, 0.75)).select(F.coalesce("n", F.lit(0)).alias("n"), F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("q3"))
    fine = (F.col("n") >= 8) & (F.col("q3") > F.col("q1"))
    return found.select("n", F.when(fine, F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("low"), F.when(fine, F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("high"))


def flag_outliers(df: DataFrame, column: str, k: float = 1.5, name: str = "is_outlier") -> DataFrame:
    """All rows, and whether they are outside the fences; nothing is removed. The fences are one row."""
    edge = fences(df, column, k).select("low", "high")
    inside = F.col(column).isNull() | F.col("low").isNull() | F.col(column).between(F.col("low"), F.col("high"))
    return df.crossJoin(edge).withColumn(name, ~inside).drop("low", "high")


def remove_outliers(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Rows inside the fences; rows without a value stay."""
    return flag_outliers(df, column, k, "out_").filter(~F.col("out_")).drop("out_")


def problem_kind(distinct: int, numeric: bool) -> str:
    return "regression" if numeric and distinct > 10 else "classification"


def split_by_hash(df: DataFrame, key: str, test_percent: int = 20, seed: int = 0) -> DataFrame:
    """A hold-out that depends on the key alone."""
    return df.withColumn("is_test", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(100)) < test_percent)


def preprocess(numeric: Sequence[str], categorical: Sequence[str]) -> list:
    """Stages: median fill and scaling; indexing with a rest category and one-hot (see ``capped_values`` for long tails)."""
    from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler

    stages: list = []
    if numeric:
        filled = [f"{c}_filled" for c in numeric]
        stages += [Imputer(strategy="median", inputCols=list(numeric), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="numbers"), StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True)]
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep"), OneHotEncoder(inputCol=f"{c}_index", outputCol=f"{c}_hot")]
    return [*stages, VectorAssembler(inputCols=[*(["scaled"] if numeric else []), *[f"{c}_hot" for c in categorical]], outputCol="features")]


def capped_values(df: DataFrame, column: str, most: int = 20, rest: str = "other") -> DataFrame:
    """The ``most`` frequent values (ties by value) stay, nulls take the most frequent one, all others become ``rest``."""
    top = [r[0] for r in df.filter(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(most).collect()]  # ``most`` rows
    filled = F.coalesce(F.col(column), F.lit(top[0] if top else rest))
    return df.withColumn(column, F.when(filled.isin(top), filled).otherwise(rest))


def time_folds(df: DataFrame, day: str, folds: int = 5) -> DataFrame:
    """A ``fold`` from 0 by time, cut at even shares of the rows; fold k is tested on models of the folds before it."""
    number = F.unix_date(F.to_date(day))
    cuts = quantiles(df.select(number.alias("day_")), "day_", [k / folds for k in range(1, folds)]).select(F.col("q").alias("cuts_"))  # one row
    return df.crossJoin(cuts).withColumn("fold", F.size(F.filter("cuts_", lambda c: c <= number))).drop("cuts_")


def hash_folds(df: DataFrame, key: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """A ``fold`` from 0 that depends on the key alone."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds)).cast("int"))


def forward_scores(df: DataFrame, day: str, label: str, numeric: Sequence[str], name: str = "linear", folds: int = 5, seed: int = 0) -> dict[int, float]:
    """By fold from 1: the error on it of a model of the folds before it."""
    from pyspark.ml import Pipeline

    marked = time_folds(df.filter(F.col(label).isNotNull()), day, folds)
    steps = Pipeline(stages=[*preprocess(numeric, []), estimators("regression", label, seed)[name]])
    return {k: regression_scores(steps.fit(marked.filter(F.col("fold") < k)).transform(marked.filter(F.col("fold") == k)), label, "prediction").first()["rmse"] for k in range(1, folds)}


def estimators(problem: str, label: str, seed: int = 0) -> dict:
    """Named estimators of a problem."""
    if problem == "classification":
        from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier

        return {
            "logistic": LogisticRegression(labelCol=label), "tree": DecisionTreeClassifier(labelCol=label, maxDepth=5, seed=seed),
            "forest": RandomForestClassifier(labelCol=label, numTrees=100, seed=seed),
        }
    from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor

    return {
        "linear": LinearRegression(labelCol=label), "tree": DecisionTreeRegressor(labelCol=label, maxDepth=5, seed=seed),
        "forest": RandomForestRegressor(labelCol=label, numTrees=100, seed=seed), "boosting": GBTRegressor(labelCol=label, seed=seed),
    }


def compare_models(df: DataFrame, key: str, label: str, numeric: Sequence[str], categorical: Sequence[str] = (), problem: str = "regression", names: Sequence[str] = (), seed: int = 0) -> dict[str, dict[str, float]]:
    """Fit each estimator on the training part; scores on the hold-out. Under 20 rows with a label nothing is fitted."""
    from pyspark.ml import Pipeline

    labelled = df.filter(F.col(label).isNotNull())
    if labelled.limit(LEAST_ROWS).count() < LEAST_ROWS:
        raise ValueError(f"fewer than {LEAST_ROWS} rows have a label")
    # what a forest keeps of a row is far larger than its part of the file, so the rows are dealt into many pieces; in order, so that a seed means the same rows
    marked = split_by_hash(labelled, key, 20, seed).repartition(pieces(df, 20), key).sortWithinPartitions(key)
    train, test = marked.filter(~F.col("is_test")), marked.filter("is_test")
    for c in categorical:
        top = capped_values(train, c)
        kept = [r[0] for r in top.select(c).distinct().collect()]  # 21 values at most
        train, test = top, test.withColumn(c, F.when(F.col(c).isin(kept), F.col(c)).otherwise("other"))
    guess = train.agg(F.avg(label)).first()[0] if problem == "regression" else train.groupBy(label).count().orderBy(F.desc("count"), label).first()[0]
    score = regression_scores if problem == "regression" else classification_scores
    out = {"baseline": {k: float(v) if v is not None else None for k, v in score(test.withColumn("prediction", F.lit(guess).cast("double")), label, "prediction").first().asDict().items()}}
    for name, estimator in estimators(problem, label, seed).items():
        if names and name not in names:
            continue
        scored = Pipeline(stages=[*preprocess(numeric, categorical), estimator]).fit(train).transform(test)
        scores = regression_scores(scored, label, "prediction") if problem == "regression" else classification_scores(scored, label, "prediction")
        out[name] = {k: float(v) if v is not None else None for k, v in scores.first().asDict().items()}
    return out


def regression_scores(df: DataFrame, label: str, prediction: str) -> DataFrame:
    e = F.col(label) - F.col(prediction)
    out = df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(label).alias("var"))
    return out.select("rmse", "mae", F.when(F.col("var") > 0, 1 - F.col("mse") / F.col("var")).alias("r2"))


def classification_scores(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy and macro precision, recall and F1 from the confusion counts."""
    cells = df.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    by_label = cells.groupBy(F.col("y").alias("k")).agg(F.sum("n").alias("actual"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    by_guess = cells.groupBy(F.col("p").alias("k")).agg(F.sum("n").alias("guessed"))
    m = by_label.join(by_guess, "k", "full_outer").na.fill(0)
    m = m.withColumn("pr", F.coalesce(F.try_divide("hit", "guessed"), F.lit(0.0))).withColumn("re", F.coalesce(F.try_divide("hit", "actual"), F.lit(0.0)))
    m = m.withColumn("f", F.coalesce(F.try_divide(2 * F.col("pr") * F.col("re"), F.col("pr") + F.col("re")), F.lit(0.0)))
    return m.agg((F.sum("hit") / F.sum("actual")).alias("accuracy"), F.avg("pr").alias("precision"), F.avg("re").alias("recall"), F.avg("f").alias("f1"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve from average ranks; counted by distinct score first."""
    found = counted(df.select(score, F.col(label).cast("long").alias("label_")), [F.asc(score), F.asc("label_")], (), [score, "label_"])
    by_score = found.groupBy(score).agg(F.min("before_").alias("before_"), F.sum("n_").alias("n_"), F.sum(F.col("n_") * F.col("label_")).alias("pos"))
    sums = by_score.agg(F.sum((F.col("before_") + (F.col("n_") + 1) / 2) * F.col("pos")).alias("s"), F.sum("pos").alias("p"), (F.sum("n_") - F.sum("pos")).alias("q"))
    return sums.select(F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"))


def permutation_importance(model, df: DataFrame, label: str, columns: Sequence[str], key: str, seed: int = 0) -> dict[str, float]:
    """How much worse the error gets if a column's values are dealt anew among the rows; they are as many as the rows, so they are merged and never sent whole."""
    from pyspark.sql import Window

    base = regression_scores(model.transform(df), label, "prediction").first()["rmse"]
    out = {}
    for c in columns:
        buckets = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(64))
        left = df.drop(c).withColumn("b_", buckets).withColumn("i_", F.row_number().over(Window.partitionBy("b_").orderBy(key)))
        right = df.select(c, buckets.alias("b_"), F.row_number().over(Window.partitionBy(buckets).orderBy(F.xxhash64(F.col(key), F.lit(seed + 1)))).alias("i_"))
        out[c] = regression_scores(model.transform(left.join(right.hint("merge"), ["b_", "i_"])), label, "prediction").first()["rmse"] - base
    return out


def cluster(df: DataFrame, columns: Sequence[str], most: int = 6, seed: int = 0):
    """K-means for 2 to ``most`` groups; the one with the best silhouette."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    ready = Pipeline(stages=preprocess(columns, [])).fit(df).transform(df)
    fits = [(k, KMeans(k=k, seed=seed).fit(ready).transform(ready)) for k in range(2, most + 1)]
    return max(fits, key=lambda f: ClusteringEvaluator().evaluate(f[1]))


def exclusions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns that can't be predictors, and why: no value, one value, or another value in every row. One pass."""
    parts = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.count_distinct(c).alias("d"), F.count("*").alias("rows")) for c in columns]
    why = F.when(F.col("n") == 0, "empty").when(F.col("d") == 1, "constant").when((F.col("d") == F.col("rows")) & (F.col("rows") > 1), "id_like")
    return df.agg(F.array(*parts).alias("all")).select(F.inline("all")).select("column", why.alias("reason")).filter("reason is not null")


def problem_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For each column as a target: regression for numbers with over ten values, else classification."""
    numeric = {c for c, k in df.dtypes if k in ("int", "bigint", "smallint", "double", "float") or k.startswith("decimal")}
    parts = [F.struct(F.lit(c).alias("column"), F.count_distinct(c).alias("values"), F.lit(c in numeric).alias("is_number")) for c in columns]
    kind = F.when(F.col("is_number") & (F.col("values") > 10), "regression").otherwise("classification")
    return df.agg(F.array(*parts).alias("all")).select(F.inline("all")).select("column", "values", kind.alias("problem"))
