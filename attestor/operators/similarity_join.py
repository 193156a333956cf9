"""Exact token-set similarity search: the most similar sets at or above a Jaccard threshold.

Nothing is sampled, capped or dropped, and not all pairs are compared. Two sets x and y with
Jaccard >= t have close sizes, t * |x| <= |y| <= |x| / t, and share at least
o = ceil(t / (1 + t) * (|x| + |y|)) tokens. With all sets in one order of tokens, rare ones first, the
``n`` first shared tokens lie among the first |x| - o + n tokens of x, and likewise for y.

The search has two parts, by how many offered sets have a token (its document frequency):

* Sets that share a **rare** token, one with at most ``rare_limit`` sets, meet under it. A wanted set
  meets at most that many partners per token, however large the table is.
* Sets without a common rare token score by their frequent tokens and sizes alone. So all sets with
  equal frequent tokens and equal size are one **class**, of which only the ``k`` first payloads can
  win, and classes are compared instead of titles. They meet under combinations of several of their
  first tokens, as many as the threshold allows. However long the titles, no single word is a key unless a
  pair need not share a second one; what is still a long list is split by Spark's skew join.

The higher the threshold, the fewer tokens and combinations. The search goes down in steps: a set that has
its ``k`` best partners at one step cannot have better ones below it and is done, so only sets
without close partners ever reach the wide steps.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from attestor.operators.ordered import top_rows
from attestor.session import materialise, shuffled

#: A token of at most this many offered sets is rare: the most partners that one token can bring.
RARE_LIMIT = 32
STEPS = (0.8, 0.7, 0.6)
#: Tokens of a combination, by how many tokens may differ; longer ones where few may, and pairs for any more.
COMBINATION = {0: 5, 1: 4, 2: 3, 3: 3}
FEWEST = 2
#: Tokens whose counts are sent to every task, the most common ones.
COMMON_TOKENS = 5000


def _ceil(value: Column) -> Column:
    # Guards against 2.0000000000000004 from the division.
    return F.ceil(F.round(value, 9)).cast("int")


def distinct_sets(df: DataFrame, tokens: str) -> DataFrame:
    """The non-empty distinct token sets of a column, each with its sorted tokens."""
    return df.select(F.array_sort(tokens).alias("tokens")).filter(F.size("tokens") > 0).distinct()


def token_counts(offered: DataFrame) -> DataFrame:
    """``token`` and in how many offered sets it is."""
    return offered.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def in_search_order(sets: DataFrame, counts: DataFrame, rare_limit: int = RARE_LIMIT) -> DataFrame:
    """Add ``own`` (all tokens), ``ordered`` (those that any offered set has, rare ones first) and ``rare``.

    The most common words meet their counts in a small table, so that no key of the join with the others is long.
    """
    common = F.broadcast(counts.orderBy(F.desc("df"), "token").limit(COMMON_TOKENS))
    every = sets.select("tokens", F.explode("tokens").alias("token")).join(common, "token", "left")
    others = every.filter("df IS NULL").drop("df").join(shuffled(counts), "token")
    listed = every.filter("df IS NOT NULL").unionByName(others)
    ranked = listed.groupBy("tokens").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("_ranked"))
    return sets.join(shuffled(ranked), "tokens").select(
        *sets.columns,
        F.size("tokens").alias("own"),
        F.transform("_ranked", lambda r: r["token"]).alias("ordered"),
        F.size(F.filter("_ranked", lambda r: r["df"] <= rare_limit)).alias("rare"),
    )


def with_words(sets: DataFrame) -> DataFrame:
    """Add ``words``: the frequent tokens in search order, which with ``own`` name the set's class."""
    return sets.withColumn("words", F.slice("ordered", F.col("rare") + 1, F.size("ordered")))


def spread(sets: DataFrame) -> DataFrame:
    """Write the sets once, evenly over all cores: comparing them is work far beyond their size."""
    parts = sets.sparkSession.sparkContext.defaultParallelism
    return materialise(sets.repartition(parts))


def set_sizes(sets: DataFrame) -> list[int]:
    """The distinct set sizes: at most as many as the longest title has words."""
    return sorted(r[0] for r in sets.select("own").distinct().collect())


def _by_partner_size(sets: DataFrame, listed: str, sizes: Sequence[int], threshold: float) -> DataFrame:
    """One row per set and admissible partner size ``other``, with the ``need`` of shared tokens."""
    known = F.array(*[F.lit(n) for n in sizes]) if sizes else F.array().cast("array<int>")
    rows = sets.withColumn("other", F.explode(known))
    rows = rows.withColumn("need", _ceil((F.col("own") + F.col("other")) * (threshold / (1 + threshold))))
    return rows.filter((F.col("need") <= F.size(listed)) & (F.col("need") <= F.col("other")))


def _rare_keys(sets: DataFrame, threshold: float) -> DataFrame:
    """One row per set and rare token that may be the first it shares: with any partner it shares ``threshold`` of its tokens."""
    length = F.least(F.size("ordered") - F.greatest(_ceil(F.col("own") * threshold), F.lit(1)) + 1, F.col("rare"))
    rows = sets.filter(length > 0).withColumn("prefix", F.slice("ordered", 1, length))
    return rows.withColumn("key", F.explode("prefix"))


def _combinations(array: Column, length: int) -> Column:
    """Hashes of all ordered choices of ``length`` elements."""

    def chosen(rest: Column, held: tuple[Column, ...]) -> Column:
        if len(held) == length - 1:
            return F.transform(rest, lambda t: F.xxhash64(*held, t))
        return F.flatten(F.transform(rest, lambda t, i: chosen(F.slice(rest, i + 2, F.size(rest)), (*held, t))))

    return chosen(array, ())


def _combination_keys(classes: DataFrame, sizes: Sequence[int], threshold: float) -> DataFrame:
    rows = _by_partner_size(classes, "words", sizes, threshold)
    spare = F.greatest("own", "other") - F.col("need")
    length = F.lit(FEWEST)
    for most, tokens in sorted(COMBINATION.items(), reverse=True):
        length = F.when(spare <= most, tokens).otherwise(length)
    rows = rows.withColumn("length", F.least(length, F.col("need")))
    rows = rows.withColumn("prefix", F.slice("words", 1, F.size("words") - F.col("need") + F.col("length")))
    # One expression per length: each has its own nesting.
    keys = F.array().cast("array<bigint>")
    for tokens in sorted({1, FEWEST, *COMBINATION.values()}):
        keys = F.when(F.col("length") == tokens, _combinations(F.col("prefix"), tokens)).otherwise(keys)
    return rows.withColumn("key", F.explode(keys))


def _meeting(a: DataFrame, b: DataFrame) -> DataFrame:
    joined = a.alias("a").join(
        shuffled(b.alias("b")),
        (F.col("a.key") == F.col("b.key")) & (F.col("a.own") == F.col("b.other")) & (F.col("a.other") == F.col("b.own")),
    )
    return joined


def _scored(pairs: DataFrame, threshold: float, shared: Column, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    sizes = F.col("a.own") + F.col("b.own")
    raw = shared / (sizes - shared)
    return pairs.select(*[F.col(f"a.{c}") for c in left], *[F.col(f"b.{c}") for c in right], raw.alias("_raw")).filter(
        F.col("_raw") >= threshold - 1e-12
    ).select(*left, *right, F.round("_raw", 4).alias("score"))


def rare_meetings(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Sets under their rare tokens; lists are short, so sizes are compared when they meet."""
    close = F.least("a.own", "b.own") >= F.greatest("a.own", "b.own") * threshold - 1e-9
    return _rare_keys(left, threshold).alias("a").join(shuffled(_rare_keys(right, threshold).alias("b")), F.col("a.key") == F.col("b.key")).filter(close)


def pairs_by_rare(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``(tokens, payload, score)`` of the pairs with Jaccard >= threshold that share a rare token."""
    met = rare_meetings(left, right, threshold)
    # A pair counts under the first rare token of both prefixes only.
    first = F.get(F.array_intersect(F.col("a.prefix"), F.col("b.prefix")), 0)
    met = met.filter(first == F.col("a.key"))
    shared = F.size(F.array_intersect(F.col("a.tokens"), F.col("b.tokens")))
    return _scored(met, threshold, shared, ["tokens"], ["payload"])


def pairs_by_class(left: DataFrame, right: DataFrame, left_sizes: Sequence[int], right_sizes: Sequence[int], threshold: float) -> DataFrame:
    """``(words, own, payloads, score)`` of the class pairs with Jaccard >= threshold, rare tokens taken as different."""
    met = _meeting(_combination_keys(left, right_sizes, threshold), _combination_keys(right, left_sizes, threshold))
    # A pair counts under the combination of its first shared words only.
    met = met.withColumn("_shared", F.array_intersect(F.col("a.words"), F.col("b.words")))
    lengths = sorted({1, FEWEST, *COMBINATION.values()})
    own_key = F.lit(None).cast("bigint")
    for tokens in lengths:
        parts = [F.get("_shared", F.lit(i)) for i in range(tokens)]
        own_key = F.when(F.col("a.length") == tokens, F.xxhash64(*parts)).otherwise(own_key)
    met = met.filter((F.size("_shared") >= F.col("a.need")) & (own_key == F.col("a.key")))
    return _scored(met, threshold, F.size("_shared"), ["words", "own"], ["payloads"])


def nearest_sets(
    wanted: DataFrame, offered: DataFrame, threshold: float, k: int = 1, rare_limit: int = RARE_LIMIT
) -> DataFrame:
    """The ``k`` best partners per wanted set: ``(tokens, score, payload, rank)``.

    ``wanted(tokens)`` and ``offered(tokens, payload)`` hold distinct sets; partners are ranked by
    score, then by payload. Scores have 4 decimals and reach ``threshold``.
    """
    counts = materialise(token_counts(offered))
    right = spread(with_words(in_search_order(offered, counts, rare_limit)))
    pending = spread(with_words(in_search_order(wanted, counts, rare_limit)))
    right_sizes = set_sizes(right)
    first = top_rows(right.filter(F.size("words") > 0).select("words", "own", "payload"), ["words", "own"], [F.col("payload")], k)
    right_classes = spread(first.groupBy("words", "own").agg(F.collect_list("payload").alias("payloads")))
    order = [F.desc("score"), F.col("payload")]
    found: DataFrame | None = None

    def best_of(floor: float, step: float) -> DataFrame:
        reached = F.col("score") >= step
        # Offered sets get keys for the sizes that are still wanted only; late steps want few.
        left_sizes = set_sizes(pending)
        by_rare = pairs_by_rare(pending, right, floor).filter(reached)
        left_classes = pending.filter(F.size("words") > 0).select("words", "own").distinct()
        by_class = pairs_by_class(left_classes, right_classes, left_sizes, right_sizes, floor).filter(reached)
        # Classes with equal scores are first cut to their k first payloads, while still in the task.
        by_class = by_class.select("words", "own", "score", F.explode("payloads").alias("payload"))
        best_class = top_rows(by_class, ["words", "own"], order, k).drop("rank")
        from_class = pending.select("tokens", "words", "own").join(shuffled(best_class), ["words", "own"])
        columns = ["tokens", "payload", "score"]
        both = by_rare.select(columns).unionByName(from_class.select(columns))
        # A partner met both ways has its true score under the rare token, the higher one.
        both = both.groupBy("tokens", "payload").agg(F.max("score").alias("score"))
        return top_rows(both, ["tokens"], order, k).select("tokens", "score", "payload", "rank")

    for step in [s for s in STEPS if s > threshold] + [threshold]:
        # Scores count after rounding.
        best = best_of(math.nextafter(step - 0.00005, 0.0), step)
        if step == threshold:
            return best if found is None else found.unionByName(best)
        best = materialise(best)
        complete = best.filter(F.col("rank") == k).select("tokens")
        done = best.join(shuffled(complete), "tokens", "left_semi")
        found = done if found is None else found.unionByName(done)
        pending = spread(pending.join(shuffled(complete), "tokens", "left_anti"))
        if pending.isEmpty():
            return found
    raise AssertionError("the last step returns")
