"""URL filter: rules by host and path, and a logistic regression for the rest.

DataFrame functions only: the features are hashed character n-grams of host and
path, the model is Spark ML's logistic regression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


N_FEATURES = 1 << 14
GRAM_SIZES = (3, 4)


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with all its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)

#: A small labelled table to learn from: 1 is a URL to block.
LABELLED = (
    ("https://ads.tracker.example/click?id=1", 1),
    ("http://ads-track.example.com/en/1", 1),
    ("http://m.ads-track.example.com/fr/21", 1),
    ("https://www.adserver.example.net/banner/728x90", 1),
    ("http://click.adtrack.example.net/redirect/go", 1),
    ("https://cdn.popunder.example.org/pop.js", 1),
    ("http://casino-bonus.example.net/win/free-spins", 1),
    ("https://www.best-casino.example.com/slots/", 1),
    ("http://cheap-pills.example.com/buy/viagra", 1),
    ("https://xxx-tube.example.net/adult/video", 1),
    ("http://adult-cams.example.org/live/", 1),
    ("http://free-porn.example.com/watch/22", 1),
    ("https://track.pixel.example.net/beacon.gif", 1),
    ("http://spam-links.example.org/seo/backlinks", 1),
    ("https://phish-login.example.com/verify/account", 1),
    ("http://download-crack.example.net/keygen/setup.exe", 1),
    ("https://www.news.example.com/en/2024/article.html", 0),
    ("https://blog.thought.example.org/en/15", 0),
    ("http://m.reading.example.net/fr/1741/", 0),
    ("https://docs.library.example.org/de/guide/install.html", 0),
    ("https://www.university.example.net/research/papers/12", 0),
    ("https://wiki.history.example.com/en/46262", 0),
    ("http://forum.garden.example.org/es/7196/", 0),
    ("https://thether.example.net/en/30066", 0),
    ("https://blog.kitchen.example.com/fr/15972.html", 0),
    ("https://museum.example.org/collections/item/34", 0),
    ("http://weather.example.net/de/46136.html", 0),
    ("https://www.travel.example.org/en/35187/", 0),
    ("https://m.sport.example.com/en/7679", 0),
    ("https://open.data.example.net/tables/population", 0),
    ("http://recipes.example.com/es/36868", 0),
    ("https://science.example.net/en/42958", 0),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: str) -> Column:
    start = F.instr(F.col(url), "://")
    return F.when(start > 0, F.substring(F.col(url), start + 3, F.length(url))).otherwise("")


def host_of(url: str) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; null or no ``://``: empty."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as its position in ``rules``; null if none does."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].text), i))
    fits = [
        F.when(
            ((host == rules[i].host) | host.endswith("." + rules[i].host)) & path.startswith(rules[i].path), F.lit(i)
        )
        for i in order
    ]
    return F.coalesce(*fits, F.lit(None).cast("int"))


def grams(host: Column, path: Column, sizes: tuple[int, ...] = GRAM_SIZES) -> Column:
    """Character n-grams of host and path, each marked with where it is from."""

    def of(value: Column, mark: str) -> list[Column]:
        # The characters are bound to a name, so that they are made once per URL.
        characters = F.array(F.split(F.concat(F.lit("^"), value, F.lit("$")), ""))

        def cut(n: int):
            def gram(c: Column, i: Column) -> Column:
                return F.concat(F.lit(mark), *[F.coalesce(F.get(c, i + k), F.lit("")) for k in range(n)])

            return lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - n, F.lit(0))), lambda i: gram(c, i))

        return [F.flatten(F.transform(characters, cut(n))) for n in sizes]

    return F.concat(*of(host, "h"), *of(path, "p"))


def _vectors(urls: DataFrame, host: str, path: str, words: str, vector: str) -> DataFrame:
    counted = urls.withColumn(words, grams(F.col(host), F.col(path)))
    return HashingTF(inputCol=words, outputCol=vector, numFeatures=N_FEATURES, binary=True).transform(counted).drop(words)


def fit(spark: SparkSession, labelled=LABELLED, reg: float = 0.01) -> LogisticRegressionModel:
    """Train on a small labelled table of URLs, given as a list."""
    rows = spark.createDataFrame(list(labelled), "url string, label int").coalesce(1)
    rows = rows.select(host_of("url").alias("host"), path_of("url").alias("path"), F.col("label").cast("double"))
    vectors = _vectors(rows, "host", "path", "words", "features")
    return LogisticRegression(maxIter=50, regParam=reg, standardization=False).fit(vectors)


def judge(
    urls: DataFrame,
    model: LogisticRegressionModel,
    id_column: str = "page_id",
    url: str = "url",
    rules: tuple[Rule, ...] = RULES,
    threshold: float = 0.5,
) -> DataFrame:
    """One row per URL: id, host, path, rule, verdict, score.

    ``rule`` is the longest rule that fits and decides; without one the model
    does, and blocks from ``threshold`` on.  ``score`` is the model's probability
    of blocking.  Null and broken URLs have an empty host and path and are judged
    by the model like any other; repeated rows stay.  No shuffle.
    """
    parts = urls.select(F.col(id_column).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    scored = _vectors(parts, "host", "path", "words", "features")
    scored = model.copy().setFeaturesCol("features").setPredictionCol("").setRawPredictionCol("").setProbabilityCol("p").transform(scored)
    chosen = scored.withColumn("i", rule_of(F.col("host"), F.col("path"), rules))
    texts, verdicts = (F.array(*[F.lit(v) for v in values]) for values in ([r.text for r in rules], [r.verdict for r in rules]))
    score = vector_to_array("p")[1]
    verdict = F.when(F.col("i").isNotNull(), F.get(verdicts, F.col("i"))).otherwise(
        F.when(score >= threshold, "block").otherwise("allow")
    )
    return chosen.select(
        F.col("id").alias(id_column), "host", "path", F.get(texts, F.col("i")).alias("rule"), verdict.alias("verdict"), score.alias("score")
    )
