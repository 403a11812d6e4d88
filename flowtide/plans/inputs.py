"""Inputs the registered queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide import bindings as B
from flowtide.operators import assemble as A


def ev_flows(spark: SparkSession, sf_dir: str, t: B.Timeouts = B.EV_TIMEOUTS) -> DataFrame:
    """Flows of the event table with their class, category, session and period."""
    return B.ev_dimensions(A.assemble(B.ev_packets(spark, sf_dir), t))


def ev_long_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flow per user, most of them longer than 30 packets."""
    packets = B.event_packets(B.table(spark, sf_dir, "events"), rst=False)
    return B.ev_dimensions(A.assemble(packets, B.EV30_TIMEOUTS))


def r6(name: str) -> Column:
    return F.round(F.col(name), 6).alias(name)


#: digits of centres and logits, of scores, of running means and of thresholds: the SQL texts round alike, so that
#: sums in another order do not make or break ties
RAW_DIGITS, SCORE_DIGITS, MEAN_DIGITS, THETA_DIGITS = 9, 6, 12, 9
#: a prefix of 30 packets fills 60 features
EM_DIM = 60
EM_MIN_FLOWS = 10


def em_scorer(flows: DataFrame):
    from flowtide.operators import scores as C

    return C.fit_centroids(flows.where("split = 'train'"), B.EM_CLASSES, B.EM_SCALE, digits=RAW_DIGITS)


def em_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score rows of the embedding table without the fitted unknown score."""
    from flowtide.operators import scores as C

    flows = B.em_flows(spark, sf_dir)
    return C.score_flows(flows, C.ScoreModel(em_scorer(flows), digits=SCORE_DIGITS, mean_digits=MEAN_DIGITS))


def em_bank(spark: SparkSession, sf_dir: str, diagonal: bool = True):
    from flowtide.operators import scores as C

    train = C.known_only(B.em_flows(spark, sf_dir).where("split = 'train'"))
    sums = C.gaussian_sums(train, C.em_projection, full=not diagonal)
    return C.fit_distances(sums, B.EM_CLASSES, EM_DIM, EM_MIN_FLOWS)


def em_model(spark: SparkSession, sf_dir: str):
    """Scorer, diagonal bank and signal moments, each fitted on its own split."""
    from dataclasses import replace

    from flowtide.operators import scores as C

    flows = B.em_flows(spark, sf_dir)
    model = C.ScoreModel(em_scorer(flows), bank=em_bank(spark, sf_dir), digits=SCORE_DIGITS, mean_digits=MEAN_DIGITS)
    val = C.score_flows(C.known_only(flows.where("split = 'val'")), model)
    return replace(model, moments=C.moments_array(C.signal_moments(val)))


def em_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score rows with the unknown score ``u``, fitted on known validation flows."""
    from flowtide.operators import scores as C

    return C.score_flows(B.em_flows(spark, sf_dir), em_model(spark, sf_dir))
