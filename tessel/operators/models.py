"""Spark ML estimators on TF-IDF features, trained on the train split and
evaluated on the job split with the shared confusion-based report.

Features: lower-cased word tokens (>= 2 chars) + bigrams -> counts of the most
frequent terms (``min_df``, ``vocab_size``) -> IDF -> L2 Normalizer. Spark's IDF is
``ln((n+1)/(df+1))``; the weights are ``tf * (idf + 1)``, as in the relational TF-IDF of
``features.py``. Class weights (balanced) enter as
``weightCol``; labels are indexed alphabetically.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassificationModel, DecisionTreeClassifier, LinearSVC, LinearSVCModel,
                                       LogisticRegression, LogisticRegressionModel, OneVsRest, OneVsRestModel,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import (IDF, CountVectorizerModel, ElementwiseProduct, HashingTF, IndexToString, NGram, Normalizer,
                                RegexTokenizer, SQLTransformer, StringIndexer, VectorAssembler, VectorSlicer)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.operators import perceptron
from tessel.operators.balance import class_weights
from tessel.operators.metrics import classification_report
from tessel.plans.rank import top_k
from tessel.session import scratch_path

WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"


#: Words that a task numbers at a time, and the pairs of them that it spells out at a time.
TOKENS_AT_ONCE, PAIRS_AT_ONCE = 1 << 21, 1 << 17


def tfidf_stages(bigrams: bool = True):
    tok = RegexTokenizer(inputCol="text", outputCol="__tok", pattern=WORD_PATTERN, gaps=False, toLowercase=True)
    stages = [tok]
    if bigrams:
        stages += [NGram(n=2, inputCol="__tok", outputCol="__bi"),
                   SQLTransformer(statement="SELECT *, concat(__tok, __bi) AS __terms FROM __THIS__")]
    return stages


def term_counts(tokens: DataFrame, bigrams: bool = True) -> DataFrame:
    """``term, df, ctf``: documents and occurrences of every word and, with ``bigrams``, every pair of adjacent words of ``tokens`` (``__tok``). A task
    numbers the words of some documents and counts the numbers, so only terms that differ there become rows."""

    def counted(key: np.ndarray, owner: np.ndarray, docs: int):
        """Distinct keys with their documents and occurrences, by one sort of (key, document)."""
        both = np.sort(key * docs + owner)
        key, new = both // docs, np.flatnonzero(np.diff(both, prepend=-1))
        first = np.flatnonzero(np.diff(key, prepend=-1))
        return key[first], np.diff(np.searchsorted(new, np.append(first, len(key)))), np.diff(np.append(first, len(key)))

    def rows(term, df, ctf):
        return pa.RecordBatch.from_arrays([term.cast(pa.string()), pa.array(df, pa.int64()), pa.array(ctf, pa.int64())], names=["term", "df", "ctf"])

    def run(batches):
        for batch in batches:
            column = batch.column(0)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < len(ends):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TOKENS_AT_ONCE, side="right")))
                words = column.slice(lo, hi - lo).flatten().dictionary_encode()
                docs = hi - lo
                owner = np.repeat(np.arange(docs), np.diff(ends[lo:hi], prepend=ends[lo - 1] if lo else 0))
                lo = hi
                if not len(words):
                    continue
                ids, names = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
                terms, df, ctf = counted(ids, owner, docs)
                yield rows(names.take(pa.array(terms)), df, ctf)
                both = np.flatnonzero(owner[1:] == owner[:-1]) if bigrams else []
                if len(both):
                    terms, df, ctf = counted(ids[both] * len(names) + ids[both + 1], owner[both], docs)
                    for at in range(0, len(terms), PAIRS_AT_ONCE):
                        cut = slice(at, at + PAIRS_AT_ONCE)
                        first, second = (names.take(pa.array(x)) for x in np.divmod(terms[cut], len(names)))
                        yield rows(pc.binary_join_element_wise(first, second, " "), df[cut], ctf[cut])

    found = tokens.select("__tok").mapInArrow(run, "term string, df long, ctf long")
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))


def fit_counts(train: DataFrame, min_df: int = 5, vocab_size: int = 50000, bigrams: bool = True) -> PipelineModel:
    """``__tf`` = counts of the ``vocab_size`` most frequent terms (ties by term) that ``min_df`` documents of ``train`` have."""
    stages = tfidf_stages(bigrams)
    terms = term_counts(stages[0].transform(train.select("text")), bigrams)
    best = top_k(written(terms.where(F.col("df") >= int(min_df)), "terms"), "ctf", "term", vocab_size)
    vocabulary = [r.term for r in sorted(best.select("term", "ctf").collect(), key=lambda r: (-r.ctf, r.term))]  # vocab_size at most
    if not vocabulary:
        raise ValueError("no term is frequent enough: lower min_df")
    return PipelineModel(stages=[*stages, CountVectorizerModel.from_vocabulary(vocabulary, "__terms" if bigrams else "__tok", "__tf")])


def fit_tfidf(train: DataFrame, min_df: int = 5, vocab_size: int = 50000, bigrams: bool = True) -> PipelineModel:
    """``features`` = L2-normalised ``tf * (idf + 1)``, fitted on ``train``."""
    counts = fit_counts(train, min_df, vocab_size, bigrams)
    idf = IDF(inputCol="__tf", outputCol="__tfidf").fit(counts.transform(train))
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf.idf.toArray() + 1.0), inputCol="__tf", outputCol="__tfidf")
    return PipelineModel(stages=[*counts.stages, scale, Normalizer(inputCol="__tfidf", outputCol="features", p=2.0)])


#: Trees read so many terms, those of the highest chi-square.
TREE_TERMS = 1000
TREES = ("dtree", "rforest")
#: Statistics of so many nodes are gathered in one pass over the rows (the tree is the same for any size).
TREE_MB = 512


def estimator(kind: str, C: float = 1.0, n_train: int = 1000):
    kind = kind.lower()
    if kind == "svm_linear":
        # sklearn's C scales the data term; Spark's regParam scales the penalty
        return LinearSVC(labelCol="__y", weightCol="__w", regParam=1.0 / (C * max(n_train, 1)), maxIter=50, tol=1e-4)
    if kind == "logreg":
        return LogisticRegression(labelCol="__y", weightCol="__w", regParam=0.0, maxIter=100)
    if kind == "dtree":
        return DecisionTreeClassifier(labelCol="__y", weightCol="__w", maxDepth=30, minInstancesPerNode=4, maxMemoryInMB=TREE_MB)
    if kind == "rforest":
        # rows keep their node of every tree: trees are neither sent to the tasks nor walked from the root in each pass
        return RandomForestClassifier(labelCol="__y", weightCol="__w", numTrees=200, maxDepth=25, minInstancesPerNode=3, seed=42, cacheNodeIds=True)
    raise ValueError(f"unknown estimator {kind!r}")


def written(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared scratch folder: texts are tokenised once for it, and every later pass reads numbers."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class TextModel:
    """A fitted classifier with its feature fit and label index; ``save`` and ``load`` go through the shared folder."""

    def __init__(self, counts: PipelineModel, weigh: PipelineModel, model, labels: list[str]):
        self.counts, self.weigh, self.model, self.labels = counts, weigh, model, labels

    def scores(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` columns, ``scores`` (label to score) and ``y_pred`` of every row with a ``text``."""
        tf = self.counts.transform(df).select(*keep, "__tf")
        return self.scores_of_counts(tf, keep)

    def scores_of_counts(self, tf: DataFrame, keep: list[str]) -> DataFrame:
        pred = self.model.transform(self.weigh.transform(tf))
        raw = vector_to_array("probability" if "probability" in pred.columns else "rawPrediction")
        names = F.array(*[F.lit(x) for x in self.labels])
        back = F.element_at(names, F.col("prediction").cast("int") + 1)
        return pred.select(*keep, F.map_from_arrays(F.slice(names, 1, F.size(raw)), raw).alias("scores"), back.alias("y_pred"))

    def save(self, path: str) -> str:
        spark = SparkSession.active()
        for name, part in (("counts", self.counts), ("weigh", self.weigh), ("model", self.model)):
            part.write().overwrite().save(f"{path}/{name}")
        spark.createDataFrame(list(enumerate(self.labels)), "id int, label string").coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextModel:
        kind = DefaultParamsReader.loadMetadata(f"{path}/model", spark)["class"].rsplit(".", 1)[-1]
        reader = {"LinearSVCModel": LinearSVCModel, "LogisticRegressionModel": LogisticRegressionModel, "OneVsRestModel": OneVsRestModel,
                  "DecisionTreeClassificationModel": DecisionTreeClassificationModel, "RandomForestClassificationModel": RandomForestClassificationModel}
        labels = [r.label for r in spark.read.parquet(f"{path}/labels").orderBy("id").collect()]  # one row per class
        return cls(PipelineModel.load(f"{path}/counts"), PipelineModel.load(f"{path}/weigh"), reader[kind].load(f"{path}/model"), labels)


def best_terms(rows: DataFrame, k: int, size: int) -> list[int]:
    """Positions of the ``k`` features of the highest chi-square against ``__y``, ascending: one sum of vectors per class
    (``size`` numbers each, bounded by the vocabulary)."""
    per = rows.groupBy("__y").agg(F.count(F.lit(1)).alias("n"), Summarizer.sum(F.col("features")).alias("o")).collect()
    total = sum(r["n"] for r in per)
    o = np.array([r["o"].toArray() for r in per]).reshape(len(per), size)
    e = np.outer([r["n"] / total for r in per], o.sum(0))
    chi2 = np.where(e > 0, (o - e) ** 2 / np.where(e > 0, e, 1), 0).sum(0)
    return sorted(np.lexsort((np.arange(size), -np.round(chi2, 9)))[:k].tolist())


class Training:
    """Feature fit, label index and the written training rows (``id, label, __y, __w, features``) of one view."""

    def __init__(self, counts, weigh, labels, rows, also, size):
        self.counts, self.weigh, self.labels, self.rows, self.also, self.size = counts, weigh, labels, rows, also, size


def training(train: DataFrame, min_df: int = 5, vocab_size: int = 50000, use_class_weights: bool = True, select_terms: int | None = None,
             also: DataFrame | None = None) -> Training:
    """Two passes read texts: the vocabulary's, and one that writes the counts of ``train`` (id, text, label) and of
    ``also`` (id, text, label: rows to predict); everything else reads that table. ``select_terms``: only the terms of the highest chi-square."""
    counts = fit_counts(train, min_df, vocab_size)
    both = train.select("id", "text", "label", F.lit("train").alias("__part"))
    if also is not None:
        both = both.unionByName(also.select("id", "text", "label", F.lit("also").alias("__part")))
    table = written(counts.transform(both).select("id", "label", "__part", "__tf"), "counts")
    rows = table.where("__part = 'train'")
    idf = IDF(inputCol="__tf", outputCol="__tfidf").fit(rows)
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf.idf.toArray() + 1.0), inputCol="__tf", outputCol="__tfidf")
    weigh = [scale, Normalizer(inputCol="__tfidf", outputCol="features", p=2.0)]
    # the label index is fitted on train only; evaluation rows keep their raw label
    idx = StringIndexer(inputCol="label", outputCol="__y", stringOrderType="alphabetAsc").fit(rows)
    rows = idx.transform(PipelineModel(stages=weigh).transform(rows))
    if use_class_weights:
        w = class_weights(rows.select("label")).select(F.col("label").alias("__lw"), F.col("weight").alias("__w"))
        rows = rows.join(F.broadcast(w), rows["label"] == w["__lw"]).drop("__lw")  # one row per class
    else:
        rows = rows.withColumn("__w", F.lit(1.0))
    size = len(counts.stages[-1].vocabulary)
    if select_terms and size > select_terms:
        weigh[-1].setOutputCol("__all")
        weigh.append(VectorSlicer(inputCol="__all", outputCol="features", indices=best_terms(rows, select_terms, size)))
        rows, size = weigh[-1].transform(rows.withColumnRenamed("features", "__all")), select_terms
    rows = written(rows.select("id", "label", "__y", "__w", "features"), "features")
    return Training(counts, PipelineModel(stages=weigh), idx.labels, rows, table.where("__part = 'also'").drop("__part") if also is not None else None, size)


def fit_text_model(train: DataFrame, kind: str, min_df: int = 5, vocab_size: int = 50000, use_class_weights: bool = True, C: float = 1.0,
                   tree_terms: int = TREE_TERMS, also: DataFrame | None = None) -> tuple[TextModel, DataFrame | None]:
    """Fit on ``train`` (id, text, label); returns the model and the counts of ``also``."""
    t = training(train, min_df, vocab_size, use_class_weights, tree_terms if kind in TREES else None, also)
    est = estimator(kind, C, t.rows.count())
    if kind == "svm_linear" and len(t.labels) > 2:
        est = OneVsRest(classifier=est, labelCol="__y", weightCol="__w")
    return TextModel(t.counts, t.weigh, est.fit(t.rows), t.labels), t.also


def sparse(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the ``features`` vector as ``at`` (positions) and ``x`` (values)."""
    kinds = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep), "at array<int>", "x array<double>"])

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                f = b.column(len(keep))
                at, x = f.field("indices"), f.field("values")
                if at.null_count:  # a dense vector names no positions
                    at = pa.array([list(range(len(v))) if i is None else i for i, v in zip(at.to_pylist(), x.to_pylist())], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), at.cast(pa.list_(pa.int32())), x.cast(pa.list_(pa.float64()))],
                                                 names=[*keep, "at", "x"])

    return df.select(*keep, "features").mapInArrow(run, kinds)


def perceptron_predict(view: DataFrame, min_df: int = 5, vocab_size: int = 50000, max_iter: int = 50, tol: float = 1e-3) -> DataFrame:
    """``id, y_true, y_pred`` of the job split by an averaged perceptron on the TF-IDF features of the train split, class-weighted."""
    t = training(view.where("split = 'train'"), min_df, vocab_size, also=view.where("split = 'job'"))
    rows = written(sparse(t.rows.select(F.col("__y").cast("int").alias("y"), F.col("__w").alias("w"), "features"), ["y", "w"]), "sparse")
    weights, _ = perceptron.fit(rows, len(t.labels), t.size, max_iter, tol)
    test = sparse(t.weigh.transform(t.also), ["id", "label"])
    return perceptron.predict(test, weights, t.labels, ["id", "label"]).select("id", F.col("label").alias("y_true"), "y_pred")


def fit_predict(view: DataFrame, kind: str, min_df: int = 5, vocab_size: int = 50000,
                use_class_weights: bool = True, C: float = 1.0, eval_df: DataFrame | None = None) -> DataFrame:
    """Train on ``split='train'`` rows, predict ``eval_df`` (default: the job
    split of ``view``). Returns ``(id, y_true, y_pred)``."""
    test = eval_df if eval_df is not None else view.where(F.col("split") == "job")
    model, counts = fit_text_model(view.where(F.col("split") == "train"), kind, min_df, vocab_size, use_class_weights, C, also=test)
    return model.scores_of_counts(counts, ["id", "label"]).select("id", F.col("label").alias("y_true"), "y_pred")


def bow_predict(view: DataFrame, label_col: str = "label", num_features: int = 1 << 18) -> DataFrame:
    """Bag-of-words multinomial classifier of the view's label (unigrams, hashed, exclusive classes)."""
    train = view.where(F.col("split") == "train")
    test = view.where(F.col("split") == "job")
    idx = StringIndexer(inputCol=label_col, outputCol="__y", stringOrderType="alphabetAsc").fit(train)
    tok = RegexTokenizer(inputCol="text", outputCol="__tok", pattern=WORD_PATTERN, gaps=False, toLowercase=True)
    tf = HashingTF(inputCol="__tok", outputCol="features", numFeatures=num_features)
    lr = LogisticRegression(labelCol="__y", family="multinomial", maxIter=30, regParam=1e-4)
    model = Pipeline(stages=[tok, tf, lr]).fit(idx.transform(train))
    back = IndexToString(inputCol="prediction", outputCol="y_pred", labels=idx.labels)
    return back.transform(model.transform(test)).select("id", F.col(label_col).alias("y_true"), "y_pred")


def length_baseline(view: DataFrame) -> DataFrame:
    """Logistic regression on text length alone: one row ``auc, accuracy, macro_f1``."""
    v = view.withColumn("__len", F.length("text").cast("double"))
    train = v.where(F.col("split") == "train")
    test = v.where(F.col("split") == "job")
    idx = StringIndexer(inputCol="label", outputCol="__y", stringOrderType="alphabetAsc").fit(train)
    va = VectorAssembler(inputCols=["__len"], outputCol="features")
    model = Pipeline(stages=[va, LogisticRegression(labelCol="__y", maxIter=100)]).fit(idx.transform(train))
    pred = model.transform(idx.transform(test))
    auc = BinaryClassificationEvaluator(labelCol="__y", rawPredictionCol="rawPrediction").evaluate(pred)
    back = IndexToString(inputCol="prediction", outputCol="y_pred", labels=idx.labels)
    rep = classification_report(back.transform(pred).select(F.col("label").alias("y_true"), "y_pred"))
    acc = F.max(F.when(F.col("label") == "accuracy", F.col("f1")))
    mf = F.max(F.when(F.col("label") == "macro avg", F.col("f1")))
    return rep.agg(F.lit(round(auc, 6)).alias("auc"), acc.alias("accuracy"), mf.alias("macro_f1"))
