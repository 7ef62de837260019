"""Per-label classifiers: fits, out-of-fold scores, chaining, registries.

Linear models of all labels, classes and folds are fitted by the same jobs
(``operators.linear``). Models of ``pyspark.ml`` are fitted one by one, and the driver loops over
their labels and folds. The driver receives thresholds and scores of a few rows.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.feature import UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from narracode.operators import boosting as B
from narracode.operators import grams as G
from narracode.operators import linear as L
from narracode.operators.features import (
    BROADCAST_TERMS,
    CHAR_BYTES,
    TOTAL_BYTES,
    by_record,
    char_occurrences,
    char_totals,
    char_words,
    dealt_tokens,
    fit_vocab,
    fit_word_vocab,
    kept_words,
    known_terms,
    pack_blocks,
    required,
    sent_if_small,
    to_vector,
    word_occurrences,
)
from narracode.operators.folds import stratified_kfold
from narracode.operators.labels import binarize, to_long
from narracode.operators.metrics import f1_variable_average
from narracode.operators.thresholds import threshold_search
from narracode.session import write_table
from narracode.spec import LabelSpec

# ------------------------------------------------------------------- estimators


def sparse_linear(kind: str, alpha: float = 1e-4, **settings) -> L.SparseLinear:
    """Linear model with an L1 penalty, fitted for all labels and folds together: logistic loss
    for binary labels, modified Huber loss, one class against the others, for categorical ones."""
    return L.SparseLinear(kind, alpha, **settings)


def sparse_boosted(kind: str, **settings) -> B.SparseBoosted:
    """Boosted trees grown leaf by leaf on all features; softmax for categorical labels."""
    return B.SparseBoosted(kind, **settings)


def linear(kind: str, alpha: float = 1e-4, max_iter: int = 100, features: str = "features") -> LogisticRegression:
    """Spark's own linear model with an L1 penalty; logistic loss for both kinds of label."""
    return LogisticRegression(
        featuresCol=features,
        labelCol="y",
        elasticNetParam=1.0,
        regParam=alpha,
        maxIter=max_iter,
        standardization=False,
        family="binomial" if kind == "binary" else "multinomial",
    )


def boosted(
    kind: str, trees: int = 100, depth: int = 5, step: float = 0.1, select: int | None = None, seed: int = 314159
) -> Pipeline:
    """Boosted trees on all features; one-vs-rest for categorical labels. Trees keep a dense
    row of bins per record and dense histograms per feature, so memory grows with records times
    features. ``select`` puts a univariate selection (analysis of variance) in front of them."""
    column = "features" if select is None else "selected"
    trees_model = GBTClassifier(featuresCol=column, labelCol="y", maxIter=trees, maxDepth=depth, stepSize=step, seed=seed)
    last = (
        trees_model
        if kind == "binary"
        else OneVsRest(classifier=trees_model, featuresCol=column, labelCol="y", parallelism=4)
    )
    if select is None:
        return Pipeline(stages=[last])
    selector = UnivariateFeatureSelector(
        featuresCol="features", labelCol="y", outputCol="selected", selectionMode="numTopFeatures"
    ).setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(select)
    return Pipeline(stages=[selector, last])


def fit(estimator, df: DataFrame):
    """Fit on ``features, y`` rows."""
    if isinstance(estimator, L.SparseLinear):
        return L.fit_one(estimator, df)
    if isinstance(estimator, B.SparseBoosted):
        return B.fit(estimator, df)
    return estimator.fit(df.withColumn("y", F.col("y").cast("double")))


def scores(model, df: DataFrame, kind: str) -> DataFrame:
    """``score``: probability of class 1 for binary labels, the class for categorical ones."""
    if isinstance(model, (L.LinearModel, B.BoostedModel)):
        return L.score_rows(model, df).select(*df.columns, "score")
    out = model.transform(df)
    value = vector_to_array(F.col("probability"))[1] if kind == "binary" else F.col("prediction")
    return out.withColumn("score", value).select(*df.columns, "score")


def cross_val_predict(df: DataFrame, estimator, kind: str, folds: int, parallelism: int = 4) -> DataFrame:
    """Out-of-fold score of every row of ``uid, features, y, fold``.

    Linear models with an L1 penalty are fitted for all folds together. Other fits are independent
    Spark jobs; up to ``parallelism`` are submitted at the same time.
    """
    if isinstance(estimator, L.SparseLinear):
        named = df.select("uid", "features", F.col("y").cast("int"), "fold")
        return fit_stack(named, {"y": estimator}, {"y": "fold"}, folds, full=False)[1].select("uid", "fold", "y", "score")

    def one(f: int) -> DataFrame:
        model = fit(estimator, df.filter(F.col("fold") != f))
        return scores(model, df.filter(F.col("fold") == f), kind)

    session = df.sparkSession
    with ThreadPoolExecutor(min(parallelism, folds)) as pool:
        parts = list(pool.map(inheritable_thread_target(session)(one), range(folds)))
    return reduce(DataFrame.unionByName, parts).select("uid", "fold", "y", "score")


def fit_stack(
    train: DataFrame, estimators: dict[str, L.SparseLinear], fold_cols: dict[str, str], folds: int, full: bool = True
) -> tuple[dict[str, L.LinearModel], DataFrame]:
    """Models and out-of-fold scores ``uid, label, fold, y, score`` of many labels.

    ``train`` is ``uid, features``, a column of codes per label, and its fold column in
    ``fold_cols``. All labels, classes and folds are fitted by the same jobs; the features are
    read as often for one label as for all of them.
    """
    labels = list(estimators)
    blocks, dim = L.pack(train, labels, [fold_cols[c] for c in labels])
    classes = L.classes_in(blocks, labels)
    parts = [*range(folds), *([None] if full else [])]
    tasks = [t for c in labels for t in L.tasks_of(c, classes[c], estimators[c], parts)]
    first = next(iter(estimators.values()))
    stack = L.fit_tasks(blocks, dim, labels, tasks, min(e.tol for e in estimators.values()), first.max_iter)
    kind = {c: e.kind for c, e in estimators.items()}
    held_out = [(c, f, stack.model(c, kind[c], f)) for c in labels for f in range(folds)]
    models = {c: stack.model(c, kind[c]) for c in labels} if full else {}
    found = write_table(L.decision_scores(blocks, held_out, labels), "oof")
    blocks.unpersist()
    return models, found


def chain_feature(df: DataFrame, score_df: DataFrame) -> DataFrame:
    """Append another label's score to the feature vector, by record key. A record without a
    score fails the job."""
    scored = score_df.select("uid", F.col("score").alias("_chained"))
    joined = df.withColumnRenamed("features", "_base").join(scored, "uid", "left")
    joined = joined.withColumn("_chained", required(F.col("_chained"), "score"))
    assembled = VectorAssembler(inputCols=["_base", "_chained"], outputCol="features").transform(joined)
    return assembled.drop("_base", "_chained")


def append_scores(df: DataFrame, external: DataFrame, cols: list[str]) -> DataFrame:
    """Append another model's label outputs to the feature vector, by record key. A record
    without them fails the job."""
    joined = df.withColumnRenamed("features", "_base").join(external.select("uid", *cols), "uid", "left")
    joined = joined.withColumns({c: required(F.col(c), c) for c in cols})
    assembled = VectorAssembler(inputCols=["_base", *cols], outputCol="features").transform(joined)
    return assembled.drop("_base", *[c for c in cols if c not in df.columns])


# ------------------------------------------------------------- fitted features


@dataclass(frozen=True)
class FeatureOptions:
    """How vocabularies are fitted and applied."""

    word_range: tuple[int, int] = (1, 3)
    char_range: tuple[int, int] = (3, 6)
    min_df: int = 5
    max_df: float = 1.0
    max_features: int = 100_000
    stop_words: tuple[str, ...] = ()

    def chars(self, docs: DataFrame) -> DataFrame:
        return char_totals(docs, *self.char_range)


@dataclass
class TextFeatures:
    """Word and character vocabularies that were fitted on a corpus."""

    options: FeatureOptions
    word_vocab: DataFrame
    char_vocab: DataFrame
    n_word: int
    n_char: int

    @classmethod
    def fit(cls, docs: DataFrame, options: FeatureOptions = FeatureOptions()) -> TextFeatures:
        n = docs.count()
        limits = (n, options.min_df, options.max_df, options.max_features)
        word = write_table(fit_word_vocab(docs, n, *options.word_range, list(options.stop_words), *limits[1:]), "word_vocab")
        char = write_table(fit_vocab(options.chars(docs), *limits), "char_vocab")
        return cls(options, word, char, word.count(), char.count())

    def save(self, path: str) -> None:
        self.word_vocab.write.parquet(f"{path}/word_vocab")
        self.char_vocab.write.parquet(f"{path}/char_vocab")
        options = self.word_vocab.sparkSession.createDataFrame([(json.dumps(asdict(self.options)),)], "value string")
        options.write.text(f"{path}/options")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextFeatures:
        raw = json.loads(spark.read.text(f"{path}/options").first()["value"])
        options = FeatureOptions(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})
        word, char = spark.read.parquet(f"{path}/word_vocab"), spark.read.parquet(f"{path}/char_vocab")
        return cls(options, word, char, word.count(), char.count())

    def _counted(self, docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
        """The counts of the known terms of every record, and each term's idf. The texts are dealt by
        record, and vocabularies of a counted size are sent there."""
        stop = list(self.options.stop_words)
        tokens = dealt_tokens(docs, TOTAL_BYTES, tokens=kept_words(F.col("text"), stop), words=char_words(F.col("text")))
        lists = [[(r.term, r.term_id, r.idf) for r in v.select("term", "term_id", "idf").collect()] for v in (self.word_vocab, self.char_vocab)]
        idf = np.zeros(self.n_word + self.n_char)
        for terms, shift in zip(lists, (0, self.n_word), strict=True):
            for _, i, x in terms:
                idf[i + shift] = x
        return G.counted(tokens, *lists), idf

    def packed(self, docs: DataFrame) -> DataFrame:
        """``uid, entries, rows``: both weight blocks of every record, characters after words, and how
        many rows of ``docs`` it has. The n-grams stay where the texts were dealt by record;
        vocabularies of a counted size are sent there."""

        def sent(vocab: DataFrame, n: int) -> DataFrame:
            return F.broadcast(vocab) if n <= BROADCAST_TERMS else vocab

        options = self.options
        word = known_terms(word_occurrences(docs, *options.word_range, list(options.stop_words), task_bytes=CHAR_BYTES), sent(self.word_vocab, self.n_word))
        char = known_terms(char_occurrences(docs, *options.char_range), sent(self.char_vocab, self.n_char))
        char = char.withColumn("term_id", (F.col("term_id") + self.n_word).cast("int"))
        every = by_record(docs).select("uid", F.lit(None).cast("int").alias("term_id"), F.lit(None).cast("double").alias("idf"), F.lit(None).cast("bigint").alias("tf"))
        return pack_blocks(word.unionByName(char).unionByName(every), self.n_word)

    def entries(self, docs: DataFrame) -> DataFrame:
        """``uid, entries`` of the records with known terms."""
        return self.packed(docs).filter(F.size("entries") > 0).drop("rows")

    def transform(self, docs: DataFrame) -> DataFrame:
        """``uid, features``: the entries of every record as one sparse vector. A record without a
        key gets the zero vector. What is written are counts, a tenth of the weights' size."""
        if max(self.n_word, self.n_char) > BROADCAST_TERMS:
            known = F.when(F.col("uid").isNotNull(), F.col("entries"))
            each = self.packed(docs).select("uid", known.alias("entries"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("_row"))
            return to_vector(each.drop("_row"), self.n_word + self.n_char)
        counts, idf = self._counted(docs)
        schema = StructType([StructField("uid", StringType()), StructField("features", VectorUDT())])
        return G.weighed(write_table(counts, "term_counts", "zstd"), idf, self.n_word, schema)


# --------------------------------------------------------------- whole protocol


@dataclass
class FitResult:
    models: dict[str, object]
    thresholds: dict[str, float | None]
    oof: DataFrame
    submission: DataFrame
    scores: dict[str, float]


def _with_folds(train: DataFrame, spec: LabelSpec, folds: int, seed: int) -> DataFrame:
    """Training rows with one ``_fold_<label>`` column per label. All labels get their folds in
    one pass over the narrow key and label columns, so the feature rows move once."""
    long = to_long(train.select("uid", *[F.col(c).cast("int").alias(c) for c in spec.columns]), spec.columns)
    ids = stratified_kfold(long, folds, seed)
    wide = ids.groupBy("uid").agg(
        *[F.max(F.when(F.col("label") == c, F.col("fold"))).alias(f"_fold_{c}") for c in spec.columns]
    )
    return train.join(sent_if_small(write_table(wide, "folds")), "uid")


def _groups(spec: LabelSpec, chain_from: str | None) -> list[list[tuple[str, str]]]:
    """Labels that can be fitted together, in order: binary labels up to the chained one, those
    after it, categorical ones."""
    ranges = [(label, kind) for label, kind, _, _ in spec.slot_ranges()]
    binary = [x for x in ranges if x[1] == "binary"]
    names = [label for label, _ in binary]
    cut = names.index(chain_from) + 1 if chain_from in names else len(names)
    return [g for g in (binary[:cut], binary[cut:], [x for x in ranges if x[1] != "binary"]) if g]


def fit_predict_all(
    train: DataFrame,
    test: DataFrame,
    spec: LabelSpec,
    make_estimator,
    folds: int = 4,
    seed: int = 314159,
    chain_from: str | None = None,
) -> FitResult:
    """For each label: out-of-fold scores, threshold, full fit, codes for the test rows.

    ``train`` is ``uid, features`` plus one column per label (categorical codes from 1);
    ``make_estimator(label, kind)`` gives the estimator. Once ``chain_from`` is done, its
    score is one more feature of the later binary labels: out-of-fold for training rows, full
    fit for test rows.
    """
    train, test = _with_folds(train, spec, folds, seed), test.select("uid", "features")
    models, thresholds, label_f1 = {}, {}, {}
    oof_parts, test_parts = [], []

    def finish(label: str, kind: str, oof: DataFrame, model, x_test: DataFrame) -> DataFrame:
        """Threshold, scores and codes of one label; returns the scores of the test rows."""
        if kind == "binary":
            found = threshold_search(oof, []).first()
            thresholds[label], label_f1[label] = found["thresh"], found["f1"]
            y_hat = binarize(F.col("score"), F.lit(found["thresh"]))
        else:
            thresholds[label] = None
            y_hat = F.col("score").cast("int")
            label_f1[label] = oof.agg(F.avg((F.col("y") == F.col("score")).cast("double"))).first()[0]
        oof_parts.append(oof.select(F.lit(label).alias("label"), F.lit(kind).alias("kind"), "uid", "fold", "y", "score", y_hat.alias("y_hat")))
        models[label] = model
        test_scores = write_table(scores(model, x_test, kind).select("uid", "score"), "test_scores")
        code = binarize(F.col("score"), F.lit(thresholds[label])) if kind == "binary" else (F.col("score") + 1).cast("int")
        test_parts.append(test_scores.select("uid", F.lit(label).alias("label"), code.alias("code")))
        return test_scores

    chained = False
    for group in _groups(spec, chain_from):
        chain = chained and group[0][1] == "binary"
        source, x_test = (chain_feature(train, sent_if_small(chain_oof)), chain_feature(test, sent_if_small(chain_test))) if chain else (train, test)
        estimators = {label: make_estimator(label, kind) for label, kind in group}
        together = {c: e for c, e in estimators.items() if isinstance(e, L.SparseLinear)}
        stacked, stacked_oof = {}, None
        if together:
            shift = {c: 0 if k == "binary" else 1 for c, k in group}
            named = source.select("uid", "features", *[(F.col(c) - shift[c]).alias(c) for c in together], *[f"_fold_{c}" for c in together])
            stacked, stacked_oof = fit_stack(named, together, {c: f"_fold_{c}" for c in together}, folds)
        for label, kind in group:
            if label in together:
                oof, model = stacked_oof.filter(F.col("label") == label).select("uid", "fold", "y", "score"), stacked[label]
            else:
                y = F.col(label) - (0 if kind == "binary" else 1)
                x_train = write_table(source.select("uid", "features", y.alias("y"), F.col(f"_fold_{label}").alias("fold")), "label_features")
                oof = write_table(cross_val_predict(x_train, estimators[label], kind, folds), "oof")
                model = fit(estimators[label], x_train)
            test_scores = finish(label, kind, oof, model, x_test)
            if label == chain_from:
                chained, chain_oof, chain_test = True, oof, test_scores
    submission = reduce(DataFrame.unionByName, test_parts).groupBy("uid").agg(
        *[F.max(F.when(F.col("label") == c, F.col("code"))).alias(c) for c in spec.columns]
    )
    return FitResult(models, thresholds, reduce(DataFrame.unionByName, oof_parts), submission, label_f1)


def cross_val_score(oof: DataFrame) -> DataFrame:
    """Variable-averaged F1 of the hard out-of-fold predictions."""
    return f1_variable_average(oof)


# -------------------------------------------------------------------- registry


def save_models(models: dict[str, object], path: str) -> dict[str, str]:
    """Save each label's model as a pipeline; returns label to path."""
    paths = {}
    for label, model in models.items():
        paths[label] = f"{path}/{label}"
        if isinstance(model, (L.LinearModel, B.BoostedModel)):
            model.save(SparkSession.active(), paths[label])
            continue
        as_pipeline = model if isinstance(model, PipelineModel) else PipelineModel(stages=[model])
        as_pipeline.write().save(paths[label])
    return paths


def load_model(spark: SparkSession, path: str):
    """A model that ``save_models`` wrote."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, kind in (("linear", L.LinearModel), ("boosted", B.BoostedModel)):
        head = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if head.getFileSystem(conf).exists(head):
            return kind.load(spark, path)
    return PipelineModel.load(path)


@dataclass
class RegistryEntry:
    """Where a label's model and its feature vocabularies were saved, and what the model was
    trained on besides the text: another model's outputs, the chained score."""

    label: str
    kind: str
    model_path: str
    feature_path: str
    threshold: float | None = None
    external: bool = False
    chained: bool = False


def mixed_predict(
    docs: DataFrame,
    registry: list[RegistryEntry],
    external: DataFrame | None = None,
    external_cols: list[str] | None = None,
    chain_from: str | None = None,
) -> DataFrame:
    """Codes ``uid, label, y_hat`` where each label may use the model and the vocabularies of
    a different run. Records are featurised once per distinct set of features; ``chain_from``
    stands before the entries that are chained to it."""
    spark = docs.sparkSession
    ready, parts, chain = {}, [], None
    for entry in registry:
        text_key, key = (entry.feature_path, False), (entry.feature_path, entry.external)
        if text_key not in ready:
            features = TextFeatures.load(spark, entry.feature_path)
            ready[text_key] = features.transform(docs)
        if key not in ready:
            ready[key] = write_table(append_scores(ready[text_key], external, external_cols), "features")
        x = chain_feature(ready[key], chain) if entry.chained else ready[key]
        scored = scores(load_model(spark, entry.model_path), x, entry.kind).select("uid", "score")
        if entry.label == chain_from:
            scored = chain = write_table(scored, "chain_scores")
        code = (
            binarize(F.col("score"), F.lit(entry.threshold)) if entry.kind == "binary" else (F.col("score") + 1).cast("int")
        )
        parts.append(scored.select("uid", F.lit(entry.label).alias("label"), code.alias("y_hat")))
    return reduce(DataFrame.unionByName, parts)


def save_run(
    features: TextFeatures, result: FitResult, path: str, external: bool = False, chain_from: str | None = None
) -> list[RegistryEntry]:
    """Save a run's vocabularies and models; returns its registry entries in label order."""
    features.save(f"{path}/features")
    paths = save_models(result.models, f"{path}/models")
    entries, seen = [], False
    for label, threshold in result.thresholds.items():
        kind = "categorical" if threshold is None else "binary"
        entries.append(
            RegistryEntry(label, kind, paths[label], f"{path}/features", threshold, external, seen and kind == "binary")
        )
        seen = seen or label == chain_from
    return entries
