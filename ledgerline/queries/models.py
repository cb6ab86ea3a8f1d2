"""Models on the labelled documents, and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import evaluation as ev
from ledgerline.operators import models as md
from ledgerline.operators.features import most_frequent_fill as fill_most_frequent
from ledgerline.plans import experiment as ex
from ledgerline.queries.registry import Tables, query
from ledgerline.sources.shared import spread

NUMERIC = ["n_chars", "n_lines", "n_words", "n_digits", "n_marks"]
CATEGORICAL = ["lang"]


COUNTED = {"n_lines": "\n", "n_words": " ", "n_digits": "0123456789", "n_marks": ".,;:!?"}


def occurrences(text: Column, chars: str) -> Column:
    """How often any of the characters occurs in a text."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def labelled_documents(t: Tables) -> DataFrame:
    """Counts over each labelled text; the length is missing for one language."""
    text = F.col("text")
    joined = t.labels.join(t.documents, "doc_id")
    return spread(joined).select(
        "doc_id", "quality", "toxic", F.when(F.col("lang") != "de", F.col("n_chars")).alias("n_chars"),
        *[occurrences(text, chars).alias(n) for n, chars in COUNTED.items()],
        F.when(F.col("lang") != "fr", F.col("lang")).alias("lang"))


def folded(t: Tables, classifier: str, label: str = "quality") -> ex.Folded:
    return ex.fold_inputs(labelled_documents(t), label, "doc_id", NUMERIC, CATEGORICAL, classifier)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query()
def logistic_odds(t):
    fitted = ex.fit(folded(t, "LogisticRegression"), "LogisticRegression", {"C": 1}, "balanced")
    return rounded(fitted.odds_ratios(t.labels.sparkSession))


@query("""WITH f AS (SELECT doc_id, CASE WHEN lang <> 'fr' THEN lang END AS lang FROM labels JOIN documents USING (doc_id)),
 m AS (SELECT lang FROM f WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1)
SELECT doc_id, coalesce(f.lang, m.lang) AS lang FROM f, m""")
def most_frequent_fill(t):
    inputs = t.labels.join(t.documents, "doc_id").select("doc_id", F.when(F.col("lang") != "fr", F.col("lang")).alias("lang"))
    return fill_most_frequent(inputs, ["lang"])


@query()
def forest_importance(t):
    fitted = ex.fit(folded(t, "RandomForest"), "RandomForest", {"n_estimators": 100, "max_depth": 5}, "balanced")
    return rounded(fitted.importances(t.labels.sparkSession))


@query()
def tree_rules(t):
    fitted = ex.fit(folded(t, "DecisionTree"), "DecisionTree", {"max_depth": 3}, "balanced")
    spark = t.labels.sparkSession
    return spark.createDataFrame([(i, line) for i, line in enumerate(fitted.rules().splitlines())], "line int, rule string")


@query()
def boosted_metrics(t):
    data = folded(t, "XGBoost")
    oof = ex.out_of_fold(data, "XGBoost", {"n_estimators": 100, "max_depth": 3, "learning_rate": 0.3})
    return ev.metrics(oof, md.SCORE, md.LABEL)


@query()
def boosted_importance(t):
    fitted = ex.fit(folded(t, "HistGradientBoosting"), "HistGradientBoosting", {"max_iter": 100, "max_depth": 3}, "balanced")
    return rounded(fitted.importances(t.labels.sparkSession))


@query()
def svm_metrics(t):
    oof = ex.out_of_fold(folded(t, "SVM"), "SVM", {"C": 1, "kernel": "linear"})
    return ev.metrics(oof, md.SCORE, md.LABEL, md.decision_threshold("SVM"))


@query()
def svm_rbf_metrics(t):
    oof = ex.out_of_fold(folded(t, "SVM"), "SVM", {"C": 1, "kernel": "rbf"})
    return ev.metrics(oof, md.SCORE, md.LABEL, md.decision_threshold("SVM"))


@query()
def grid_search(t):
    results = ex.search(folded(t, "LogisticRegression"), "LogisticRegression")
    return ev.rank_results(results, "roc_auc")


@query()
def oof_scores(t):
    oof = ex.out_of_fold(folded(t, "LogisticRegression"), "LogisticRegression", {"C": 1})
    return oof.select("doc_id", "fold", md.SCORE, F.col(md.LABEL).alias("label"))


@query()
def permutation_importance(t):
    data = folded(t, "LogisticRegression")
    fitted = ex.fit(data, "LogisticRegression", {"C": 1}, "balanced")
    return ex.permutation_importance(data, fitted, "doc_id", repeats=10)


def scored_lines(t: Tables) -> DataFrame:
    """A score with many ties for each line item, and its status as the label."""
    score = F.round(F.col("l_discount") * 5 + F.col("l_tax") * 5, 2)
    return t.lineitem.select("l_returnflag", score.alias("score"), (F.col("l_linestatus") == "O").cast("int").alias("y"))


SCORED_SQL = "SELECT l_returnflag, round(l_discount * 5 + l_tax * 5, 2) AS score, (l_linestatus = 'O')::INT AS y FROM lineitem"
CURVE_SQL = f"""c AS (SELECT score AS threshold, sum(y) AS pos, sum(1 - y) AS neg FROM ({SCORED_SQL}) GROUP BY score),
 k AS (SELECT *, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp,
  sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg FROM c)"""


@query(f"""WITH {CURVE_SQL} SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / (tp + fp), 9) AS precision,
 round(tp / n_pos, 9) AS recall, round(fp / n_neg, 9) AS fpr FROM k""")
def score_curves(t):
    return rounded(ev.curves(scored_lines(t), "score", "y"), 9).select("threshold", "tp", "fp", "precision", "recall", "fpr")


@query(f"""WITH {CURVE_SQL} SELECT round(sum(pos / n_pos * (tp / (tp + fp))), 9) AS pr_auc,
 round(sum(neg * (tp - pos / 2.0) / (n_pos * n_neg))::DOUBLE, 9) AS roc_auc FROM k""")
def score_areas(t):
    return rounded(ev.areas(ev.curves(scored_lines(t), "score", "y")), 9)


@query(f"""SELECT l_returnflag, count(*) FILTER (y = 1 AND score > 0.5) AS tp, count(*) FILTER (y = 0 AND score > 0.5) AS fp,
 count(*) FILTER (y = 1 AND score <= 0.5) AS fn, count(*) FILTER (y = 0 AND score <= 0.5) AS tn FROM ({SCORED_SQL}) GROUP BY l_returnflag""")
def confusion(t):
    return ev.confusion(scored_lines(t), "score", "y", 0.5, ["l_returnflag"])


@query(f"""WITH n AS (SELECT l_returnflag, count(*) FILTER (y = 1 AND score > 0.5) AS tp, count(*) FILTER (y = 0 AND score > 0.5) AS fp,
 count(*) FILTER (y = 1 AND score <= 0.5) AS fn, count(*) FILTER (y = 0 AND score <= 0.5) AS tn FROM ({SCORED_SQL}) GROUP BY l_returnflag)
SELECT l_returnflag, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(tp / (tp + fp), 9) AS precision,
 round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round(5 * tp / (5 * tp + 4 * fn + fp), 9) AS f2,
 round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS bal_acc FROM n""")
def threshold_metrics(t):
    return rounded(ev.metrics(scored_lines(t), "score", "y", 0.5, ["l_returnflag"]).drop("pr_auc", "roc_auc"), 9)


@query("""WITH c AS (SELECT quality, count(*) AS n, min(doc_id) AS first FROM labels GROUP BY quality),
 s AS (SELECT *, coalesce(sum(n) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM c),
 p AS (SELECT doc_id, l.quality, start, n, row_number() OVER (PARTITION BY l.quality ORDER BY doc_id) AS r FROM labels l JOIN s ON s.quality = l.quality),
 z AS (SELECT quality, i, len(list_filter(range(start, start + n), lambda x: x % 5 = i)) AS size FROM s, range(5) t(i)),
 e AS (SELECT quality, i, sum(size) OVER (PARTITION BY quality ORDER BY i) AS done FROM z)
SELECT doc_id, p.quality, (SELECT count(*) FROM e WHERE e.quality = p.quality AND e.done < r)::INT AS fold FROM p""")
def stratified_folds(t):
    return ev.stratified_folds(t.labels, "quality", "doc_id").select("doc_id", "quality", "fold")


@query(f"""SELECT round(avg(((score > 0.5)::INT = y)::INT), 9) AS accuracy FROM ({SCORED_SQL})""")
def mean_accuracy(t):
    predicted = scored_lines(t).withColumn("prediction", (F.col("score") > 0.5).cast("int"))
    return rounded(ev.mean_accuracy(predicted, "prediction", "y"), 9)
