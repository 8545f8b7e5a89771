"""Features, closed-form models, baselines, metrics and stratified samples."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.iterate import cut


def _offsets(sizes: DataFrame) -> DataFrame:
    """(_part, _offset): the sums of all parts before each. sizes: (_part, _sum), a row a task."""
    until = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_part", F.coalesce(F.sum("_sum").over(until), F.lit(0)).alias("_offset"))


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: how many rows stand before this one by ``order``, which is unique.

    One shuffle, by ranges of ``order``: a row's place in its sorted range comes with the written table, and
    the offsets of ranges, a row each, are broadcast.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    dealt = cut(rows.sparkSession, dealt, "ranges").withColumn("_part", F.shiftright("_mid", 33))
    offsets = _offsets(dealt.groupBy("_part").agg(F.count("*").alias("_sum")))
    return dealt.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_mid").bitwiseAND((1 << 33) - 1)).drop("_part", "_mid", "_offset")


def prefix_sums(rows: DataFrame, order: str, value: Column, name: str = "before") -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows before this one by ``order``, which is unique.

    Rows are dealt by ranges of ``order`` and summed within each; the offsets, a row a partition, are
    broadcast. So no task sees more than its range.
    """
    spark = rows.sparkSession
    dealt = cut(spark, rows.withColumn("_value", value).repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    offsets = _offsets(dealt.groupBy("_part").agg(F.sum("_value").alias("_sum")))
    w = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("_own", F.coalesce(F.sum("_value").over(w), F.lit(0)))
    return own.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_own") + F.col("_offset")).drop("_part", "_value", "_own", "_offset")


def dense_ids(names: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column with their places in sorted order, from 0."""
    return ranked(names.select(column).distinct(), [column], "id").select(column, "id")


def ccdf(counts: DataFrame, x: str, n: str) -> DataFrame:
    """(x, p): share of mass at x and above. counts has one row per distinct value."""
    total = counts.agg(F.sum(n).alias("total"))
    below = prefix_sums(counts, x, F.col(n), "below")
    return below.join(F.broadcast(total)).select(x, ((F.col("total") - F.col("below")) / F.col("total")).alias("p"))  # one row


def stratified_share(rows: DataFrame, key: str, n: int, order: Column, tie: str) -> DataFrame:
    """Per class max(1, round half even of its share of n) rows, by ``order``."""
    w = Window.partitionBy(key).orderBy(order, tie)
    sizes = rows.groupBy(key).agg(F.count("*").alias("size"))
    share = sizes.join(F.broadcast(rows.agg(F.count("*").alias("total")))).select(key, F.greatest(F.lit(1), F.bround(F.col("size") * F.lit(float(n)) / F.col("total"))).alias("share"))  # one row
    few = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max(1, n))  # no share is larger: sorted partitions keep n rows a class
    return few.join(share, key).where("rn <= share").drop("rn", "share")


def round_robin(rows: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """One row of each class in turn, classes by size descending, then by first row."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("size"), F.min(order).alias("first"))
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("rn") <= limit)
    return ranked.join(sizes, key).orderBy("rn", F.desc("size"), "first").limit(limit)


def long_form(rows: DataFrame, key: str, vector: str) -> DataFrame:
    return rows.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("j0", "v")).select(key, (F.col("j0") + 1).alias("j"), "v")


def standardize(x: DataFrame) -> DataFrame:
    """Adds z by column j: population deviation, 1 where it vanishes."""
    m = x.groupBy("j").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd")).withColumn("sd", F.when(F.col("sd") < 1e-8, 1.0).otherwise(F.col("sd")))
    return x.join(m, "j").withColumn("z", (F.col("v") - F.col("mu")) / F.col("sd"))


def ridge_report(spark: SparkSession, rows: DataFrame, k: int, penalty: float) -> DataFrame:
    """n, weights (on standardised columns), r2, rmse of ridge with a free intercept. rows: (x array, y).

    Moments come from one aggregate; the k x k system is solved on the driver.
    """
    x = [F.col("x")[i] for i in range(k)]
    first = rows.agg(F.count("*"), F.avg("y"), *[F.avg(c) for c in x], *[F.stddev_pop(c) for c in x]).first()
    n, my = first[0], first[1]
    mu = np.array(first[2 : 2 + k])
    sd = np.array([v if v and v >= 1e-8 else 1.0 for v in first[2 + k :]])
    z = [(x[i] - float(mu[i])) / float(sd[i]) for i in range(k)]
    got = rows.agg(F.sum((F.col("y") - my) ** 2), *[F.sum(z[i] * (F.col("y") - my)) for i in range(k)], *[F.sum(z[i] * z[j]) for i in range(k) for j in range(k)]).first()
    a, b = np.array(got[1 + k :]).reshape(k, k), np.array(got[1 : 1 + k])
    w = np.linalg.solve(a + penalty * np.eye(k), b)
    sse = got[0] - 2 * w @ b + w @ a @ w
    r2 = float(1 - sse / got[0]) if got[0] else float("nan")
    return spark.createDataFrame([(n, [float(v) for v in w], r2, float(np.sqrt(max(sse, 0) / n)))], "n long, weights array<double>, r2 double, rmse double")


def regression_sets(rows: DataFrame, sets: dict[str, list[int]], penalty: float = 1.0) -> DataFrame:
    """feature_set, side, n_features, n, r2, pearson, rmse of ridge with a free intercept on each set of columns of x.

    rows: (x array, y, train). Columns are standardised by the training side's mean and population
    deviation (1 where it vanishes), and fitted on it. One pass gives the second moments of (1, x, y) on
    either side; every model and every figure follows from them. A set without columns predicts the
    mean, with r2 and pearson 0.
    """
    spark = rows.sparkSession
    wide = rows.select("train", F.concat(F.array(F.lit(1.0)), F.col("x").cast("array<double>"), F.array(F.col("y").cast("double"))).alias("v"))
    cells = {side: gram_blocks(wide.where(F.col("train") == (side == "train")), "v").toPandas() for side in ("train", "test")}
    moments = {}
    for side, c in cells.items():
        k = int(c["i"].max()) if len(c) else 2
        m = np.zeros((k, k))
        m[c["i"] - 1, c["j"] - 1] = c["g"]
        moments[side] = m + np.triu(m, 1).T
    out = []
    for name, columns in sets.items():
        m = moments["train"]
        n, at, last = m[0, 0], [c + 1 for c in columns], m.shape[0] - 1
        if not n:
            continue
        mean = m[0] / n
        cov = m - n * np.outer(mean, mean)
        spread = np.sqrt(np.maximum(cov[at, at] / n, 0))
        spread = np.where(spread < 1e-8, 1.0, spread)
        a = cov[np.ix_(at, at)] / np.outer(spread, spread)
        weight = np.linalg.solve(a + penalty * np.eye(len(at)), cov[at, last] / spread) / spread if at else np.zeros(0)
        bias = mean[last] - weight @ mean[at]
        for side, m in moments.items():
            n = m[0, 0]
            if not n:
                continue
            total = m[last, last] - m[0, last] ** 2 / n
            p = weight @ m[at, 0] + n * bias  # sum of the predictions
            pp = weight @ m[np.ix_(at, at)] @ weight + 2 * bias * (weight @ m[at, 0]) + n * bias**2
            py = weight @ m[at, last] + bias * m[0, last]
            sse = max(0.0, pp - 2 * py + m[last, last])
            spread_p = pp - p**2 / n
            r2 = (1 - sse / total if total > 0 else float("nan")) if at else 0.0
            pearson = (py - p * m[0, last] / n) / np.sqrt(spread_p * total) if at and spread_p > 0 and total > 0 else 0.0
            out.append((name, side, len(at), int(n), float(r2), float(pearson), float(np.sqrt(sse / n))))
    return spark.createDataFrame(out, "feature_set string, side string, n_features long, n long, r2 double, pearson double, rmse double")


def class_means(rows: DataFrame, vector: str, label: str) -> DataFrame:
    """One row with ``classes``: an array of (label, mean vector), by label. Its size is classes x columns."""
    means = rows.select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("j", "v")).groupBy(label, "j").agg(F.avg("v").alias("m")).groupBy(F.col(label).alias("label")).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda c: c["m"]).alias("mean"))
    return means.agg(F.array_sort(F.collect_list(F.struct("label", "mean"))).alias("classes"))


def nearest_centroids(rows: DataFrame, key: str, vector: str, label: str, top: int, train: str | None = None) -> DataFrame:
    """(key, predicted, rk): the nearest class means, ties by label. Means are those of the rows where ``train`` holds, if named.

    Every row sorts the classes on its own, against the broadcast means: no shuffle of rows.
    """
    means = class_means(rows.where(train) if train else rows, vector, label)
    gap = lambda c: F.aggregate(F.zip_with("x", c["mean"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)
    ranked = F.array_sort(F.transform("classes", lambda c: F.struct(F.round(gap(c), 6).alias("d2"), c["label"].alias("predicted"))))
    near = rows.select(key, F.col(vector).cast("array<double>").alias("x")).join(F.broadcast(means)).select(key, F.slice(ranked, 1, top).alias("best"))  # one row
    return near.select(key, F.posexplode("best").alias("rk", "p")).select(key, "p.predicted", (F.col("rk") + 1).cast("long").alias("rk"))


def majority(rows: DataFrame, label: str) -> DataFrame:
    """One row (label, n): the most frequent value, of equally frequent ones the least."""
    c = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return c.agg(F.min(F.struct((-F.col("n")).alias("minus"), "label")).alias("best")).select("best.label", (-F.col("best.minus")).alias("n"))


def prefix_majority(rows: DataFrame, prefix: str, label: str, train: str) -> DataFrame:
    """rows plus ``guess``: the most frequent training label of a row's prefix, of all training rows where the prefix has none."""
    c = rows.where(train).groupBy(prefix, label).agg(F.count("*").alias("n"))
    own = c.groupBy(prefix).agg(F.min(F.struct((-F.col("n")).alias("minus"), F.col(label).alias("label"))).alias("best")).select(prefix, F.col("best.label").alias("own"))
    general = majority(rows.where(train), label).select(F.col("label").alias("general"))
    return rows.join(own, prefix, "left").join(F.broadcast(general)).withColumn("guess", F.coalesce("own", "general")).drop("own", "general")  # one row


def macro_f1(rows: DataFrame) -> DataFrame:
    """macro_f1 of (y, p), classes from either side."""
    c = rows.groupBy("y", "p").agg(F.count("*").alias("n"))
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    side = c.select(F.col("y").alias("c"), hit.alias("tp"), F.col("n").alias("own"), F.lit(0).alias("said")).union(c.select("p", F.lit(0), F.lit(0), "n"))
    f = side.groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("own").alias("own"), F.sum("said").alias("said"))
    return f.agg(F.avg(2 * F.col("tp") / (F.col("own") + F.col("said"))).alias("macro_f1"))


def roc_auc(rows: DataFrame) -> DataFrame:
    """auc of (y 0/1, x) from mean ranks; distinct values of x are ranked by ranges, in many tasks."""
    c = rows.groupBy("x").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    r = prefix_sums(c, "x", F.col("n"), "below").withColumn("rank", F.col("below") + (F.col("n") + 1) / 2)
    s = r.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return s.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def logistic_report(rows: DataFrame) -> DataFrame:
    """n, auc, accuracy on the test side of (embedding, label 0/1, train) by Spark's logistic regression."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = rows.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), "label", "train")
    model = LogisticRegression(maxIter=30, regParam=0.01).fit(data.where("train"))
    test = model.transform(data.where("not train")).select(F.col("label").cast("int").alias("y"), vector_to_array("probability")[1].alias("x"), (F.col("prediction") == F.col("label")).cast("double").alias("hit"))
    return test.agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy")).join(roc_auc(test))


def gram_blocks(rows: DataFrame, vector: str) -> DataFrame:
    """(i, j, g) with i <= j of X'X for wide vectors: a product per Arrow batch, the cells summed by key. Null vectors are skipped."""
    import pandas as pd

    def products(parts):
        for part in parts:
            if len(part):
                x = np.vstack(part["x"].to_numpy()).astype(float)
                i, j = np.triu_indices(x.shape[1])
                yield pd.DataFrame({"i": i + 1, "j": j + 1, "g": (x.T @ x)[i, j]})

    cells = rows.where(F.col(vector).isNotNull()).select(F.col(vector).alias("x")).mapInPandas(products, "i long, j long, g double")
    return cells.groupBy("i", "j").agg(F.sum("g").alias("g"))


def feature_spec(spec: str, lists: dict[str, int], scalars: tuple[str, ...] = ("degree",)) -> Column:
    """The feature array a spec like 'low10+high10+degree' names: prefixes of array columns, log1p of scalar columns.

    lists gives the length of each array column. An unknown part, or one longer than its column, raises ValueError.
    """
    parts = []
    for part in spec.split("+"):
        found = re.fullmatch(r"([a-z_]+?)(\d*)", part.strip())
        name, width = found.groups() if found else (part, "")
        if name in scalars and not width:
            parts.append(F.array(F.log1p(F.col(name).cast("double"))))
        elif name in lists and width and 0 < int(width) <= lists[name]:
            parts.append(F.slice(F.col(name).cast("array<double>"), 1, int(width)))
        else:
            raise ValueError(f"no feature {part!r} in {sorted(lists)} and {sorted(scalars)}")
    return F.concat(*parts)


def kept_classes(rows: DataFrame, label: str, least: int) -> DataFrame:
    """Rows whose class has at least ``least`` training rows, with a dense class index by label. rows: (..., train)."""
    sizes = rows.where("train").groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    w = Window.orderBy(label)  # a row a class
    return rows.join(sizes.withColumn("y", (F.row_number().over(w) - 1).cast("double")), label)


def classifier_report(rows: DataFrame, model: str = "logistic", hidden: int = 32, universe: str = "both", iterations: int = 50) -> DataFrame:
    """n, accuracy, top3, macro_f1 on the test side of (x array, y class index, train).

    model: logistic (multinomial) or mlp (one hidden layer). universe: macro F1 over the classes of
    either side ('both') or over all classes of the rows ('all'). Ties in top3 go to the lower class.
    """
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = rows.select(array_to_vector(F.col("x").cast("array<double>")).alias("features"), F.col("y").cast("double").alias("label"), "train", F.size("x").alias("width"))
    shape = data.agg(F.max("width").alias("width"), F.max("label").alias("last")).first()
    classes = int(shape.last) + 1
    if model == "logistic":
        learner = LogisticRegression(maxIter=iterations, regParam=1e-3, family="multinomial")
    elif model == "mlp":
        learner = MultilayerPerceptronClassifier(layers=[shape.width, hidden, classes], maxIter=iterations, seed=0)
    else:
        raise ValueError(f"model is logistic or mlp, not {model}")
    test = learner.fit(data.where("train")).transform(data.where("not train")).select("label", vector_to_array("probability").alias("prob"))
    return probability_report(test, classes, universe)


def probability_report(test: DataFrame, classes: int, universe: str = "both") -> DataFrame:
    """n, accuracy, top3, macro_f1 of (label, prob array); see ``classifier_report``."""
    own = F.col("prob")[F.col("label").cast("int")]
    above = F.size(F.filter("prob", lambda v: v > own)) + F.size(F.filter(F.slice("prob", F.lit(1), F.col("label").cast("int")), lambda v: v == own))
    said = F.array_position("prob", F.array_max("prob")) - 1
    marked = test.select(F.col("label").cast("int").alias("y"), said.cast("int").alias("p"), (above < 3).cast("double").alias("near"))
    f1 = macro_f1(marked) if universe == "both" else macro_f1_over(marked, classes)
    return marked.agg(F.count("*").alias("n"), F.avg((F.col("y") == F.col("p")).cast("double")).alias("accuracy"), F.avg("near").alias("top3")).join(f1)


def macro_f1_over(rows: DataFrame, classes: int) -> DataFrame:
    """macro_f1 of (y, p) over a fixed number of classes; one without rows on either side counts 0."""
    c = rows.groupBy("y", "p").agg(F.count("*").alias("n"))
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    side = c.select(F.col("y").alias("c"), hit.alias("tp"), F.col("n").alias("both")).union(c.select("p", F.lit(0), "n"))
    f = side.groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("both").alias("both"))
    return f.agg((F.sum(2 * F.col("tp") / F.col("both")) / classes).alias("macro_f1"))


def sampled_links(und: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(a, b, label): n edges in hash order, and up to n pairs of nodes drawn by hash that are no edges.

    Nodes are repeated until n can be drawn twice; the ranks that pair the draws run over n rows each.
    Pairs of a node with itself are dropped and not drawn again.
    """
    order = lambda salt, *c: F.xxhash64(*c, F.lit(seed), F.lit(salt))
    linked = und.orderBy(order(0, "u", "v"), "u", "v").limit(n).select(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(1).alias("label"))
    nodes = und.select(F.col("u").alias("node")).union(und.select("v")).distinct()
    copies = -(-n // max(nodes.count(), 1))
    many = nodes.select("node", F.explode(F.sequence(F.lit(1), F.lit(max(copies, 1)))).alias("copy"))
    drawn = lambda salt, name: many.withColumn("h", order(salt, "node", "copy")).orderBy("h", "node", "copy").limit(n).select(F.col("node").alias(name), F.row_number().over(Window.orderBy("h", "node", "copy")).alias("rank"))
    pairs = drawn(1, "a").join(drawn(2, "b"), "rank").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    free = pairs.join(und.select(F.col("u").alias("a"), F.col("v").alias("b")), ["a", "b"], "left_anti")
    return linked.unionByName(free.select("a", "b", F.lit(0).alias("label")))


def link_features(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, label, x): both vectors, product, absolute gap and log degrees. vectors: (name, x, degree)."""
    of = lambda side: vectors.select(F.col("name").alias(side), F.col("x").alias(f"x_{side}"), F.log1p(F.col("degree").cast("double")).alias(f"d_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    x = F.concat("x_a", "x_b", F.zip_with("x_a", "x_b", lambda p, q: p * q), F.zip_with("x_a", "x_b", lambda p, q: F.abs(p - q)), F.array("d_a", "d_b"))
    return both.select("a", "b", "label", x.alias("x"))


def power_tail(x: Column, y0: float, least: float, alpha: float) -> Column:
    """The tail line y0 * (x / least)^-(alpha - 1)."""
    return F.lit(y0) * F.pow(x / F.lit(least), F.lit(1.0 - alpha))
