"""Linkage kept up to date: new and changed trials and publications against what is known already.

Each run keeps four tables (:class:`Linkage`); the next one starts from them. Only publications that are new
or newer go through the gate, and titles are compared as two joins of what changed:

* trials that are new or changed, that need a title search for the first time, or whose best article changed:
  with all publications;
* all other trials: with the changed publications only; the better of that and the known match wins.

Links by id are joins of narrow columns. Texts are joined for the trials whose link, or whose linked article, is
another than before; the rows of all others stay as they are.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from attestor import presets
from attestor.operators.linkage import described, judge, offered_titles, pmid_order, staged_ids, unique_articles
from attestor.operators.similarity_join import distinct_sets, nearest_sets
from attestor.session import shuffled, work_path

_PICK = ("_pmid0", "_pmid1", "_pmid2", "title_score")


class Linkage(NamedTuple):
    """What a run leaves: its inputs, the gate's results, the picks of each trial, and the linked trials."""

    trials: DataFrame
    publications: DataFrame
    judged: DataFrame
    picks: DataFrame
    linked: DataFrame


def _stored(df: DataFrame) -> DataFrame:
    """A table of its own in the shared folder, as a later run reads it."""
    path = work_path(df.sparkSession, "linkage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _best_titles(wanted: DataFrame, kept: DataFrame) -> DataFrame:
    """The best kept article per wanted token set (``_tokens``)."""
    best = nearest_sets(distinct_sets(wanted, "_tokens"), offered_titles(kept), presets.JACCARD_MEDIUM)
    return best.select(F.col("tokens").alias("_tokens"), F.col("payload.pmid").alias("_pmid2"), F.col("score").alias("title_score"))


def _order(publications: DataFrame) -> DataFrame:
    """``pmid`` and what tells which of two rows of it is the later one, as :func:`unique_articles` does."""
    plain = [c for c, kind in publications.dtypes if not kind.startswith("map")]
    version = F.col("version") if "version" in publications.columns else F.lit(0)
    return publications.select("pmid", F.struct(version.alias("version"), F.xxhash64(*plain).alias("tie")).alias("order"))


def first_linkage(trials: DataFrame, publications: DataFrame) -> Linkage:
    """The first run; its results are those of :func:`attestor.operators.linkage.link`."""
    publications = _stored(unique_articles(publications))
    judged = _stored(judge(publications))
    staged = _stored(staged_ids(trials, judged))
    best = _best_titles(staged.filter("_searched").select("_tokens"), judged.filter("kept"))
    picks = _stored(staged.join(shuffled(best), "_tokens", "left"))
    return Linkage(trials, publications, judged, picks, _stored(described(picks, publications, judged, trials.columns)))


def relink(known: Linkage, trials: DataFrame, publications: DataFrame) -> tuple[Linkage, DataFrame]:
    """The linkage with more ``trials`` and ``publications``, and the ``nct_id`` of the trials whose row is new or another.

    A trial that is known is replaced; a publication that is known is replaced by a later version. The result is
    that of one run over all rows. Delivered rows may repeat known ones, which then count as unchanged.
    """
    trials = _stored(trials.select(*known.trials.columns).join(shuffled(known.trials), list(known.trials.columns), "left_anti"))
    delivered = unique_articles(publications.select(*known.publications.columns))
    later = _order(delivered).alias("n").join(shuffled(_order(known.publications).alias("o")), "pmid", "left")
    later = later.filter("o.order IS NULL OR n.order > o.order").select("pmid")
    changed = _stored(delivered.join(shuffled(later), "pmid", "left_semi"))
    articles = _stored(known.publications.join(shuffled(changed.select("pmid")), "pmid", "left_anti").unionByName(changed))
    judged_now = _stored(judge(changed))
    judged = _stored(known.judged.join(shuffled(changed.select("pmid")), "pmid", "left_anti").unionByName(judged_now))
    every = _stored(known.trials.join(shuffled(trials.select("nct_id")), "nct_id", "left_anti").unionByName(trials))

    staged = _stored(staged_ids(every, judged))
    before = known.picks.join(shuffled(trials.select("nct_id")), "nct_id", "left_anti").filter("_searched")
    before = before.select("nct_id", F.col("_pmid2").alias("_old"), F.col("title_score").alias("_old_score"))
    stale = before.join(shuffled(changed.select(F.col("pmid").alias("_old"))), "_old", "left_semi").select("nct_id")
    sound = before.join(shuffled(stale), "nct_id", "left_anti")
    searched = staged.filter("_searched").select("nct_id", "_tokens")
    fresh = _stored(searched.join(shuffled(sound.select("nct_id")), "nct_id", "left_anti"))
    others = _stored(searched.join(shuffled(sound), "nct_id"))
    found = fresh.join(shuffled(_best_titles(fresh, judged.filter("kept"))), "_tokens").select("nct_id", "_pmid2", "title_score")
    beside = others.join(shuffled(_best_titles(others, judged_now.filter("kept"))), "_tokens", "left")
    wins = F.col("_pmid2").isNotNull() & (
        F.col("_old").isNull()
        | (F.col("title_score") > F.col("_old_score"))
        | ((F.col("title_score") == F.col("_old_score")) & (pmid_order(F.col("_pmid2")) < pmid_order(F.col("_old"))))
    )
    beside = beside.select("nct_id", F.when(wins, F.col("_pmid2")).otherwise(F.col("_old")).alias("_pmid2"), F.when(wins, F.col("title_score")).otherwise(F.col("_old_score")).alias("title_score"))
    picks = _stored(staged.join(shuffled(found.unionByName(beside)), "nct_id", "left").select(*known.picks.columns))

    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in _PICK]
    kept_pick = picks.alias("n").join(shuffled(known.picks.alias("o")), (F.col("n.nct_id") == F.col("o.nct_id")) & same[0] & same[1] & same[2] & same[3], "left_semi")
    linked_to = F.coalesce("_pmid0", "_pmid1", "_pmid2")
    moved = kept_pick.withColumn("pmid", linked_to).join(shuffled(changed.select("pmid")), "pmid", "left_semi").select("nct_id")
    settled = kept_pick.join(shuffled(trials.select("nct_id")), "nct_id", "left_anti").join(shuffled(moved), "nct_id", "left_anti").select("nct_id")
    todo = _stored(picks.join(shuffled(settled), "nct_id", "left_anti"))
    rows = described(todo, articles, judged, known.trials.columns)
    linked = _stored(known.linked.join(shuffled(todo.select("nct_id")), "nct_id", "left_anti").unionByName(rows))
    return Linkage(every, articles, judged, picks, linked), todo.select("nct_id")
