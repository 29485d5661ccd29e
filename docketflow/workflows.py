"""The stages end to end, composed from the operators: harvest, train and evaluate, score and publish."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from docketflow import fixed_values as V
from docketflow.functions import html as H, text as X
from docketflow.operators import evaluation as E, features as T, linking as L, publish as P, search as R, vocabulary as W
from docketflow.operators.linear import MAX_PASSES, LinearModel
from docketflow.operators.sampling import stratified_folds, stratified_split
from docketflow.session import materialise


def harvest(index_pages: DataFrame, judgment_pages: DataFrame, host: str = V.HOST, keywords=V.KEYWORDS,
            html: bool = True) -> DataFrame:
    """Index pages ``(court, year, url, html)`` and judgments ``(link, html)`` to coded, tagged cases.

    Each court lists a link once, where it first appears. A link marked as broken, or without a page,
    is tagged as having no judgment.
    """
    found = L.canonical_links(L.extract_links(index_pages), host).withColumn("case_name", F.col("title"))
    cases = L.with_year(found, "case_name", F.col("year")).withColumn("case_key", F.struct("court", "link"))
    first = L.first_per_key(cases.select("case_key", "year", "url", "pos", "case_name", "case_year"),
                            "case_key", ["year", "url", "pos"])
    text = H.page_text(F.col("html")) if html else F.col("html")
    # tagged before the join, so only the tag travels
    tags = L.first_per_key(judgment_pages.select("link", H.mention_tag(text, F.col("link"), keywords=keywords).alias("mention")),
                           "link", ["mention"])
    listed = first.select("case_key.*", "year", "url", "pos", "case_name", "case_year") \
        .join(tags, "link", "left").withColumn("mention", F.when(
            F.contains("link", F.lit(V.BROKEN_LINK_MARK)) | F.col("mention").isNull(), V.NO_JUDGMENT).otherwise(F.col("mention")))
    return L.court_codes(listed, ["year", "url", "pos"]).select(
        "court", "personal_code", "case_name", F.col("case_year").alias("year"), "link", "mention")


def clean_judgments(df: DataFrame, key: str, dictionary: DataFrame, exclude: DataFrame | None = None,
                    text: str = "text", out: str = "clean_text") -> DataFrame:
    """The whole cleaning chain: steps on the text, then the dictionary filter."""
    steps = df.withColumn("_steps", X.clean(F.col(text)))
    return W.dictionary_filter(steps, key, "_steps", dictionary, exclude, out).drop("_steps")


@dataclass
class Trained:
    vectoriser: T.Tfidf
    model: LinearModel
    terms: Column
    search: R.SearchOutcome
    test: DataFrame         # link, label, prediction

    def predict(self, df: DataFrame) -> DataFrame:
        """``prediction`` for cleaned judgments; the working columns are dropped."""
        ready = self.vectoriser.transform(df.withColumn("_terms", self.terms), "_terms", "_features")
        return self.model.predict(ready, "_features").drop("_terms", "_features")


def train(labelled: DataFrame, corrections: DataFrame, analysers: dict, grid: dict | None = None, cs=V.SVM_TFIDF_C,
          losses=V.SVM_LOSSES, max_passes: int = MAX_PASSES) -> Trained:
    """Correct labels, split, search vectoriser and SVM on the training side, predict the test side.

    ``labelled`` has ``link, label, clean_text``. Labels are corrected before the split.
    """
    sided = materialise(stratified_split(P.apply_corrections(labelled, corrections)), "sided", "link")
    folded = materialise(stratified_folds(sided.filter("split = 'train'").drop("split")), "folded", "link")
    found = R.search_tfidf_svm(folded, "link", analysers, grid, cs, losses, max_passes=max_passes)
    trained = Trained(found.tfidf, found.model, analysers[found.analyser], found, sided)
    trained.test = trained.predict(sided.filter("split = 'test'")).select("link", "label", "prediction")
    return trained


def evaluate(predictions: DataFrame) -> DataFrame:
    """One row: confusion counts, per-class F1, macro-F1 and accuracy."""
    return E.scores(E.confusion_counts(predictions))


def score_and_publish(trained: Trained, expert: DataFrame, unlabelled: DataFrame, corrections: DataFrame) -> DataFrame:
    """Score the cleaned unlabelled judgments and merge them with the expert's labels."""
    return P.publish(expert, trained.predict(unlabelled), corrections)
