"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks, DataFrame functions only.

The words of a source, its documents in a seeded order, are cut into blocks of ``block_words``. The
blocks of the whole mix go to sources by highest quotients ``target / (2 * seats + 1)``, and a
source's quota goes to its shards in the same way. A shard takes all its blocks as often as its quota
allows, and the rest along a seeded stride. A block may begin or end inside a document, so what a
document gives is counted in words.

Documents are dealt over shards of about ``shard_words`` words by a hash, so a hot source is many
shards; only tables with one row per source or shard are ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from attestor.llm.frames import written

BLOCK_WORDS = 16
SHARD_WORDS = 1 << 20
MOST_REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = 20240229
_STRIDE = 2147483647  # a prime, so it steps through every block of a shard
WORD = r"[^\x20\x09-\x0D]+"


def seeded(seed: int = SEED) -> Column:
    """A row's place in the seeded order: 60 bits of an MD5 over seed, id and text."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), seeded(seed).alias("place"))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """``source, source_size, weight_rank, target`` from ``source, source_size``.

    Sources share all words by weight. A target stops at ``repeats`` times its source's size and the
    excess is shared again. In order of ``limit / weight`` those that stop come first, and the share per
    weight that the rest gets is the largest of the shares that each prefix leaves.
    """
    by_name = Wd.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight_rank", F.row_number().over(by_name))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("weight_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("stop", F.col("source_size") * repeats)
    every, before = Wd.partitionBy(), Wd.orderBy(F.col("stop") / F.col("weight"), "weight_rank").rowsBetween(Wd.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("stop").over(before), F.lit(0))
    heavy = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    shared = ranked.withColumn("share", left / heavy).withColumn("share", F.max("share").over(every))
    target = F.least(F.col("stop").cast("double"), F.col("share") * F.col("weight"))
    return shared.select("source", "source_size", "weight_rank", target.alias("target"))


def apportion(parties: DataFrame, group: list[str], party: str, weight: str, seats: str, out: str) -> DataFrame:
    """Sainte-Laguë within each group: ``seats`` go one by one to the highest ``weight / (2 * held + 1)``.

    A party gets about its proportional part, so only the seats around it are put in order: the range
    allows for as many corrections as there are parties, shared by weight. Ties go to the smaller
    ``party``.
    """
    w = Wd.partitionBy(*group)
    total, n = F.sum(weight).over(w), F.count(F.lit(1)).over(w)
    part = F.when(total > 0, F.col(seats) * (F.col(weight) / total)).otherwise(F.lit(0.0))
    slack = F.when(total > 0, F.ceil(n * (F.col(weight) / total)) + 2).otherwise(F.lit(0))
    base = F.greatest(F.floor(part) - slack, F.lit(0))
    ranged = parties.withColumn("base", base).withColumn("last", F.floor(part) + slack)
    ranged = ranged.withColumn("open", F.col(seats) - F.sum("base").over(w))
    tried = ranged.withColumn("held", F.explode(F.sequence("base", "last")))
    quotient = F.col(weight) / (2 * F.col("held") + 1)
    order = Wd.partitionBy(*group).orderBy(F.desc("quotient"), party, "held")
    won = tried.withColumn("quotient", quotient).withColumn("place_", F.row_number().over(order))
    won = won.where((F.col("place_") <= F.col("open")) & (F.col(weight) > 0)).groupBy(*group, party).agg(F.count(F.lit(1)).alias("won"))
    ranged = ranged.alias("r").join(won.alias("w"), [F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}")) for c in (*group, party)], "left")
    kept = [F.col(f"r.{c}") for c in parties.columns]
    return ranged.select(*kept, (F.col("r.base") + F.coalesce(F.col("w.won"), F.lit(0))).cast("long").alias(out))


def mix(
    docs: DataFrame,
    *,
    weights: tuple = WEIGHTS,
    repeats: int = MOST_REPEATS,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``, ``source``) with the words the mix takes of it.

    Returns ``doc_id, size, source_size, target, taken`` and ``place`` (the seeded order). ``target`` and
    ``source_size`` are the source's. NULL is a source of its own, the last in order; NULL and blank texts have
    size 0 and give nothing. Repeated rows are rows of their own. No document gives more than
    ``repeats`` times its words. Other columns are ignored; an empty table gives an empty result.
    """
    taken = _taken(docs, weights, repeats, block_words, shard_words, seed)
    return taken.select("doc_id", "size", "source_size", "target", "taken", "place")


def _taken(docs: DataFrame, weights: tuple = WEIGHTS, repeats: int = MOST_REPEATS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """:func:`mix` with ``source``, ``weight_rank`` and ``shard`` of every row."""
    rows = written(sizes(docs, seed))
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats)
    all_words = F.sum("source_size").over(Wd.partitionBy())
    sources = sources.withColumn("seats", F.floor((2 * all_words + block_words) / (2 * block_words)).cast("long"))
    quotas = apportion(sources.withColumn("mix", F.lit(0)), ["mix"], "weight_rank", "target", "seats", "quota")
    quotas = written(quotas.select("source", "source_size", "target", "quota", "weight_rank"))

    # One row per source: joined as a small table where Spark finds it small, else by shuffle.
    named = rows.alias("d").join(quotas.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")))
    named = named.select("d.doc_id", "d.source", "d.size", "d.place", "q.source_size", "q.target", "q.quota", "q.weight_rank")
    shards = F.ceil(F.col("source_size") / shard_words)
    named = written(named.withColumn("shard", F.when(F.col("size") > 0, F.pmod(F.col("place"), F.greatest(shards, F.lit(1))))))

    full = named.where("size > 0")
    cells = full.groupBy("weight_rank", "shard", "quota").agg(F.sum("size").alias("words"))
    cells = cells.withColumn("blocks", F.ceil(F.col("words") / block_words))
    most = F.sum("blocks").over(Wd.partitionBy("weight_rank")) * repeats
    cells = cells.withColumn("quota", F.least("quota", most))
    cells = apportion(cells, ["weight_rank"], "shard", "blocks", "quota", "given")
    start = F.pmod(F.col("weight_rank") * 7919 + F.col("shard") * 104729 + seed, F.col("blocks"))
    cells = cells.select("weight_rank", "shard", "blocks", F.expr("given div blocks").alias("times"), (F.col("given") % F.col("blocks")).alias("more"), start.alias("start"))
    cells = written(cells)

    in_shard = Wd.partitionBy("weight_rank", "shard").orderBy("place", "doc_id", "size").rowsBetween(Wd.unboundedPreceding, -1)
    placed = full.withColumn("begin", F.coalesce(F.sum("size").over(in_shard), F.lit(0)))
    placed = placed.join(cells, ["weight_rank", "shard"])
    begin, end = F.col("begin"), F.col("begin") + F.col("size")

    def given(total: Column, j: Column) -> Column:
        chosen = (j * (F.lit(_STRIDE) % F.col("blocks")) + F.col("start")) % F.col("blocks") < F.col("more")
        inside = F.least(end, (j + 1) * block_words) - F.greatest(begin, j * block_words)
        return total + F.when(chosen, inside).otherwise(F.lit(0).cast("long"))

    touched = F.sequence(F.expr(f"begin div {block_words}"), F.expr(f"(begin + size - 1) div {block_words}"))
    extra = F.when(F.col("more") > 0, F.aggregate(touched, F.lit(0).cast("long"), given)).otherwise(F.lit(0).cast("long"))
    of = ("source", "weight_rank", "shard")
    taken = placed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times") + extra).alias("taken"), "place", *of)
    empty = named.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), "place", *of)
    return taken.unionByName(empty)


def mixed_documents(docs: DataFrame, *, seed: int = SEED, **options) -> DataFrame:
    """The documents of the mix with all their columns, whole: each as often as its shard's words allow.

    Every document of a shard is taken as often as the words of the shard's quota allow, and one time more
    as long as, in the seeded order, the running sum stays in what is left. So a shard misses the words that
    :func:`mix` takes of it by less than one document. The document at the end is taken if a part of it that
    changes from shard to shard is inside; the first shard rounds to the nearer side.
    """
    shard = Wd.partitionBy("weight_rank", "shard")
    before = shard.orderBy("place", "doc_id").rowsBetween(Wd.unboundedPreceding, -1)
    taken = _taken(docs, seed=seed, **options).where("size > 0")
    taken = taken.withColumn("words", F.sum("size").over(shard)).withColumn("quota", F.sum("taken").over(shard))
    part = F.pmod(F.lit(0.5) + F.col("shard") * F.lit(0.6180339887498949), F.lit(1.0))
    more = F.coalesce(F.sum("size").over(before), F.lit(0)) + part * F.col("size") < F.expr("quota % words")
    copies = F.expr("quota div words") + F.when(more, 1).otherwise(0)
    # Equal rows have one place; their copies are dealt to them evenly.
    chosen = taken.select("place", "source", copies.alias("copies")).groupBy("place", "source").agg(F.sum("copies").alias("copies_"), F.count(F.lit(1)).alias("rows_"))
    chosen = written(chosen.where("copies_ > 0").select(F.col("place").alias("place_"), F.col("source").alias("source_"), "copies_", "rows_"))
    named = docs.withColumn("own_place_", seeded(seed))
    met = (F.col("own_place_") == F.col("place_")) & F.col("source").eqNullSafe(F.col("source_"))
    rows = named.join(chosen.where("rows_ = 1"), met).select(*docs.columns, "copies_")
    repeated = chosen.where("rows_ > 1")
    if not repeated.isEmpty():
        numbered = named.join(repeated, met).withColumn("row_", F.row_number().over(Wd.partitionBy("place_", "source_").orderBy(F.xxhash64(*docs.columns))))
        dealt = F.expr("copies_ div rows_") + F.when(F.col("row_") <= F.expr("copies_ % rows_"), 1).otherwise(0)
        rows = rows.unionByName(numbered.select(*docs.columns, dealt.alias("copies_")).where("copies_ > 0"))
    rows = rows.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies_").cast("int"))))
    return rows.select(*docs.columns)


SQL = f"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
           ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS place
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
), w AS (
    SELECT *, (rank - 1) % 3 + 1 AS weight, {MOST_REPEATS} * source_size AS stop FROM s
), share AS (
    SELECT ((sum(source_size) OVER () - coalesce(sum(stop) OVER before, 0))::BIGINT
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT) AS share
    FROM w WINDOW before AS (ORDER BY stop / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
    SELECT *, least(stop::DOUBLE, (SELECT max(share) FROM share) * weight) AS target FROM w
), seats AS (
    SELECT rank, row_number() OVER (ORDER BY target / (2 * held + 1) DESC, rank, held) AS seat
    FROM t, LATERAL (SELECT unnest(range(0, (target / {BLOCK_WORDS})::BIGINT + 64)) AS held) h WHERE target > 0
), q AS (
    SELECT t.rank, t.source, t.source_size, t.target, count(seats.rank) AS quota
    FROM t LEFT JOIN seats ON t.rank = seats.rank
     AND seat <= (SELECT floor((2 * sum(source_size) + {BLOCK_WORDS}) / (2 * {BLOCK_WORDS})) FROM t)
    GROUP BY ALL
), n AS (
    SELECT d.doc_id, d.size, d.place, q.source_size, q.target, q.quota, q.rank,
           CASE WHEN size > 0 THEN place % greatest(ceil(source_size / {SHARD_WORDS})::BIGINT, 1) END AS shard
    FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), c AS (
    SELECT rank, shard, quota, ceil(sum(size) / {BLOCK_WORDS})::BIGINT AS blocks FROM n WHERE size > 0 GROUP BY ALL
), c_most AS (
    SELECT rank, shard, blocks, least(quota, {MOST_REPEATS} * sum(blocks) OVER (PARTITION BY rank)) AS quota FROM c
), c_seats AS (
    SELECT rank, shard, row_number() OVER (PARTITION BY rank ORDER BY blocks / (2 * held + 1) DESC, shard, held) AS seat, quota
    FROM c_most, LATERAL (SELECT unnest(range(0, {MOST_REPEATS} * blocks + 1)) AS held) h
), g AS (
    SELECT c.rank, c.shard, c.blocks, count(s.seat) AS given FROM c_most c
    LEFT JOIN c_seats s ON c.rank = s.rank AND c.shard = s.shard AND s.seat <= s.quota GROUP BY ALL
), p AS (
    SELECT n.*, blocks, given // blocks AS times, given % blocks AS more, (n.rank * 7919 + n.shard * 104729 + {SEED}) % blocks AS start,
           coalesce(sum(size) OVER (PARTITION BY n.rank, n.shard ORDER BY place, doc_id, size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin
    FROM n JOIN g ON n.rank = g.rank AND n.shard = g.shard WHERE size > 0
)
SELECT doc_id, size, source_size, target,
       (size * times + coalesce(list_sum([CASE WHEN (j * ({_STRIDE} % blocks) + start) % blocks < more
            THEN least(begin + size, (j + 1) * {BLOCK_WORDS}) - greatest(begin, j * {BLOCK_WORDS}) ELSE 0 END
        FOR j IN range(begin // {BLOCK_WORDS}, (begin + size - 1) // {BLOCK_WORDS} + 1)]), 0))::BIGINT AS taken, place
FROM p
UNION ALL SELECT doc_id, size, source_size, target, 0, place FROM n WHERE size = 0
"""
