"""Review text: classifiers, topics and batch inference."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, HashingTF, Normalizer, RegexTokenizer, StopWordsRemover, Tokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quayside.operators.ranks import running_total
from quayside.plans.lineage import cut

# --- fixed values: Portuguese words that say nothing of a failure, and those that name one
DOMAIN_STOPWORDS_PT = [
    "produto", "produtos", "comprei", "compra", "veio", "vir", "é", "pra", "achei", "fica", "ficou", "vez",
    "ser", "fazer", "agora", "aqui", "vou", "todo", "toda", "coisa", "vendedor", "loja", "item", "pedido",
]
FAILURE_KEYWORDS_PT = {
    "late_or_not_delivered": [
        "entrega", "entregue", "atraso", "atrasado", "prazo", "demora", "demorou", "chegou", "recebi", "recebido", "dias", "correio",
        "transportadora", "aguardando", "enviado",
    ],
    "product_quality": [
        "produto", "qualidade", "quebrado", "defeito", "ruim", "péssimo", "pessima", "danificado", "estragado", "funciona", "horrível",
    ],
    "wrong_or_incomplete": [
        "errado", "diferente", "veio", "faltando", "outro", "outra", "nota", "cancelado", "devolução", "devolver", "troca", "incompleto",
    ],
}
#: Ties between a seller's shares go to the later mode.
MODE_ORDER = ["late_or_not_delivered", "product_quality", "wrong_or_incomplete", "other"]
MAX_LEN, VOCAB, PAD, UNK = 128, 20_000, 0, 1
#: Models that are fitted at a time.
PARALLEL = 6


def hash_split(df: DataFrame, key: str, train_tenths: int = 8) -> tuple[DataFrame, DataFrame]:
    """Train and test by a hash of the key, so that rows of one key stay together and reruns agree."""
    part = F.pmod(F.xxhash64(key), F.lit(10))
    return df.filter(part < train_tenths), df.filter(part >= train_tenths)


def stopwords(language: str = "portuguese", extra: list[str] | None = None) -> list[str]:
    return StopWordsRemover.loadDefaultStopWords(language) + (extra or [])


def nlp_pipeline(text: str = "text_lower", language: str = "portuguese", features: int = 1 << 16) -> Pipeline:
    """Words without stop words, hashed TF-IDF and logistic regression."""
    return Pipeline(stages=[
        Tokenizer(inputCol=text, outputCol="tokens"),
        StopWordsRemover(inputCol="tokens", outputCol="words", stopWords=stopwords(language)),
        HashingTF(inputCol="words", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(labelCol="label", maxIter=30, regParam=0.01),
    ])


def fit_nlp(labelled: DataFrame, text: str, key: str, language: str = "portuguese", light: bool = False, features: int = 1 << 16) -> dict:
    """Cross-validated text classifier with areas under both curves on the held-out tenths."""
    rows = labelled.filter(F.col(text).isNotNull()).withColumn("text_lower", F.lower(text)).withColumn("label", F.col("label").cast("double"))
    train, test = hash_split(rows, key)
    stages = nlp_pipeline(language=language, features=features).getStages()
    hashing = Pipeline(stages=stages[:3]).fit(rows)  # words, stop words and hashing learn nothing: they are made once, not in every fit
    keep = [c for c in rows.columns if c != "text_lower"]
    train, test = (cut(hashing.transform(side).select(*keep, "tf")) for side in (train, test))
    idf, lr = stages[3:]
    reg, net = ([0.01, 0.1], [0.0]) if light else ([0.0, 0.01, 0.1], [0.0, 0.5])
    grid = ParamGridBuilder().addGrid(lr.regParam, reg).addGrid(lr.elasticNetParam, net).build()
    area = lambda metric: BinaryClassificationEvaluator(labelCol="label", metricName=metric)
    search = CrossValidator(estimator=Pipeline(stages=[idf, lr]), estimatorParamMaps=grid, evaluator=area("areaUnderROC"), numFolds=2 if light else 3, parallelism=PARALLEL, seed=5067)
    fitted = search.fit(train)
    predictions = fitted.transform(test)
    return {
        "model": PipelineModel([*hashing.stages, *fitted.bestModel.stages]), "predictions": predictions, "cv_metrics": list(fitted.avgMetrics),
        "auc_roc": area("areaUnderROC").evaluate(predictions), "auc_pr": area("areaUnderPR").evaluate(predictions),
    }


def class_report(predictions: DataFrame) -> DataFrame:
    """(label, recall, precision) of each class."""
    hit = F.col("label") == F.col("prediction")
    by = lambda c: predictions.groupBy(F.col(c).alias("class")).agg(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("recall" if c == "label" else "precision"))
    return by("label").join(by("prediction"), "class", "full_outer").withColumnRenamed("class", "label")


def area_under_curve(scored: DataFrame, label: str, score: str) -> DataFrame:
    """(auc_roc, n) in one row: how often a positive row scores over a negative one, ties half; null without both classes."""
    counts = scored.groupBy(F.col(score).alias("v")).agg(F.sum(label).alias("positive"), F.count("*").alias("n"))
    below = running_total(cut(counts.withColumn("negative", F.col("n") - F.col("positive"))), "v", "negative", "upto")
    wins = F.sum(F.col("positive") * (F.col("upto") - 0.5 * F.col("negative")))
    return below.agg(F.try_divide(wins, F.sum("positive") * F.sum("negative")).alias("auc_roc"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def label_topics(terms: dict[int, list[str]], keywords: dict[str, list[str]] = FAILURE_KEYWORDS_PT) -> dict[int, str]:
    """Failure mode of each topic: most keywords among its terms, the first of equals, `other` without any."""
    out = {}
    for topic, words in terms.items():
        hits = {mode: len(set(words) & set(keys)) for mode, keys in keywords.items()}
        best = max(hits, key=hits.get, default="other")
        out[topic] = best if hits.get(best) else "other"
    return out


def first_argmax(array: Column) -> Column:
    return (F.array_position(array, F.array_max(array)) - 1).cast("int")


def dominant_mode(shares: dict[str, Column]) -> Column:
    """The mode with the largest share, the last of equals."""
    top = F.greatest(*shares.values())
    out = F.lit(None).cast("string")
    for mode in MODE_ORDER:
        out = F.when(shares[mode] == top, F.lit(mode)).otherwise(out)
    return out


def negative_topics(
    reviews: DataFrame, text: str, entity: str, stop: list[str], k: int = 6, iterations: int = 20, vocabulary: int = 2000, min_df: float = 5.0,
    keywords: dict[str, list[str]] = FAILURE_KEYWORDS_PT, seed: int = 6273,
) -> tuple[DataFrame, DataFrame]:
    """(topic summary, failure modes by entity) of LDA over the texts; tokens are runs of letters of any script."""
    from pyspark.ml.clustering import LDA

    rows = reviews.filter(F.col(text).isNotNull()).withColumn("text_lower", F.lower(text))
    tokens = RegexTokenizer(inputCol="text_lower", outputCol="tokens", pattern="[^\\p{L}]+", minTokenLength=3).transform(rows)
    words = StopWordsRemover(inputCol="tokens", outputCol="words", stopWords=stop).transform(tokens).filter(F.size("words") > 0)
    counter = CountVectorizer(inputCol="words", outputCol="features", vocabSize=vocabulary, minDF=min_df, maxDF=0.9).fit(words)
    counted = cut(counter.transform(words))
    lda = LDA(k=k, maxIter=iterations, seed=seed).fit(counted)
    described = lda.describeTopics(12).collect()
    terms = {r["topic"]: [counter.vocabulary[i] for i in r["termIndices"]] for r in described}
    modes = label_topics(terms, keywords)
    spark = reviews.sparkSession
    summary = spark.createDataFrame([(t, modes[t], ", ".join(terms[t])) for t in sorted(terms)], "topic_id int, failure_mode string, top_terms string")
    named = F.create_map(*[F.lit(x) for t, m in modes.items() for x in (t, m)])
    topics = lda.transform(counted).withColumn("mode", named[first_argmax(vector_to_array("topicDistribution"))])
    share = {m: F.avg(F.when(F.col("mode") == m, 1.0).otherwise(0.0)) for m in MODE_ORDER}
    by = topics.groupBy(entity).agg(F.count("*").alias("n_negative_reviews"), *[c.alias(f"share_{m}") for m, c in share.items()])
    return summary, by.withColumn("dominant_failure_mode", dominant_mode({m: F.col(f"share_{m}") for m in MODE_ORDER}))


def frequent_words(tokens: DataFrame, vocabulary: int) -> list[str]:
    """The most frequent words of a column `tokens`, the first by name of equals; `vocabulary` less the two numbers that are no words."""
    counts = tokens.select(F.explode("tokens").alias("w")).groupBy("w").count()
    return [r["w"] for r in counts.orderBy(F.desc("count"), "w").limit(vocabulary - 2).collect()]


def padded_numbers(tokens: str, words: list[str], length: int = MAX_LEN) -> Column:
    """Numbers of the first `length` words from 2 on, 1 for unknown ones, 0 after the last; whole batches at a time, as Arrow looks words up in one hash table."""
    known = pa.array(words, pa.string())

    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            flat = pc.fill_null(pc.index_in(lists.flatten().cast(pa.string()), value_set=known), UNK - 2).to_numpy(zero_copy_only=False) + 2
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            out = np.full((len(sizes), length), PAD, np.int32)
            out[row[at < length], at[at < length]] = flat[at < length]
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * length), pa.array(out.ravel()))

    made.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(made, "array<int>")(tokens)


def encode_sequences(rows: DataFrame, text: str, stop: list[str], vocabulary: int = VOCAB, length: int = MAX_LEN) -> DataFrame:
    """seq: word numbers of a text by frequency from 2 on, 1 for unknown words, padded by 0 and cut to `length`; a null text has none.

    The driver holds the vocabulary, `vocabulary` words at most.
    """
    words = F.filter(F.split(F.lower(text), "[^\\p{L}]+"), lambda w: (w != "") & ~F.array_contains(F.lit(stop).cast("array<string>"), w))
    tokens = rows.withColumn("tokens", words)
    return tokens.withColumn("seq", padded_numbers("tokens", frequent_words(tokens, vocabulary), length))


def fit_mlp(train: DataFrame, features: int, hidden: int = 16, iterations: int = 30, seed: int = 1394):
    """A feed-forward network over term vectors, the neural classifier that needs no outside library."""
    return MultilayerPerceptronClassifier(layers=[features, hidden, 2], maxIter=iterations, seed=seed, labelCol="label").fit(train)


def term_vectors(rows: DataFrame, seq: str, vocabulary: int = VOCAB) -> DataFrame:
    """features: the shares of a sequence's known words, as a sparse vector over their numbers."""
    names = F.transform(F.filter(F.coalesce(F.col(seq), F.array().cast("array<int>")), lambda x: x > UNK), lambda x: x.cast("string"))
    counter = CountVectorizerModel.from_vocabulary([str(i) for i in range(vocabulary)], inputCol="\x00w", outputCol="\x00c")
    counted = counter.transform(rows.withColumn("\x00w", names))
    return Normalizer(p=1.0, inputCol="\x00c", outputCol="features").transform(counted).drop("\x00w", "\x00c")


def mlp_batch_scorer(model, vocabulary: int = VOCAB) -> Callable[[], Callable]:
    """A factory of a numpy scorer of padded sequences by a fitted network: the probability of class 1."""
    weights, layers = model.weights.toArray().tolist(), list(model.getLayers())

    def make() -> Callable:
        import numpy as np

        parts, at = [], 0
        for a, b in zip(layers, layers[1:], strict=False):
            w = np.asarray(weights[at : at + a * b]).reshape(b, a, order="F")
            parts.append((w, np.asarray(weights[at + a * b : at + a * b + b])))
            at += a * b + b

        def predict(inputs):
            seq = np.asarray(inputs, np.int64)
            known = seq > UNK
            x = np.zeros((len(seq), vocabulary))
            np.add.at(x, (np.nonzero(known)[0], seq[known]), 1.0)
            x /= np.maximum(known.sum(axis=1, keepdims=True), 1)
            for k, (w, bias) in enumerate(parts):
                x = x @ w.T + bias
                if k + 1 < len(parts):
                    x = 1 / (1 + np.exp(-x))
            x = np.exp(x - x.max(axis=1, keepdims=True))
            return x[:, 1] / x.sum(axis=1)

        return predict

    return make


def linear_batch_scorer(weights: list[float], bias: float) -> Callable[[], Callable]:
    """A factory of a vectorised scorer, loaded once a Python worker."""

    def make() -> Callable:
        import numpy as np

        w = np.asarray(weights, np.float64)

        def predict(inputs):
            return np.asarray(inputs, np.float64) @ w + bias

        return predict

    return make


def batch_predict(df: DataFrame, array_col: str, out: str, factory: Callable[[], Callable], width: int, batch: int = 256) -> DataFrame:
    """`out` by a model that runs on numpy batches in the executors."""
    udf = predict_batch_udf(factory, return_type=DoubleType(), batch_size=batch, input_tensor_shapes=[[width]])
    return df.withColumn(out, udf(array_col))
