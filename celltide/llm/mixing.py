"""Mixing sources to target weights by Pareto order sampling.

Each document is wanted ``copies = min(cap, c * wish)`` times, where one factor c per source makes the wanted
words meet the source's target. The whole part of that is certain; the fraction is an inclusion probability.
Documents of a source are then ranked by random odds over inclusion odds, and taken in that order until the
source has its words: a sample of fixed size (in words) with unequal probabilities. The place in the order where
a source is full is found by counting words in ever finer slices of the ranking, so a source of any size is
never sorted in one task. What is decided comes down to a factor and a last place for each source, which are
then applied to every document.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded, settled, whole

#: Slices of the ranking at each of three levels; the last slice holds about rows / SLICES**LEVELS documents of a source.
SLICES, LEVELS = 256, 3
#: Word separators are space and \x09-\x0D.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Wishes count in steps of this, so that their sums are exact; and the largest one.
WISH_STEPS, MOST_WISH = 1000, 1e9
#: Rows of one repeated document that a task makes at a time.
BLOCK = 10_000


def word_count(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def longer_first(text: str | Column = "text") -> Column:
    """A wish that grows with a text's words, from 1 to 4 by one for each 200: longer documents are repeated sooner."""
    return (F.least(F.floor(word_count(text) / 200), F.lit(3)) + 1).cast("double")


def source_targets(sizes: DataFrame, weights: list[float], total_share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares of ``total_share`` of all sizes by weight.

    Weights repeat over the sources in order of code points, null last. A target stops at ``cap`` times its
    source's size and the excess is shared again by weight: sources are full in order of cap * size / weight,
    so one pass over the sources in that order finds all that are full. The sources, not their documents, are
    sorted in one task.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_fill = Window.orderBy("fill", F.col("source").isNull(), F.col("source"))
    before, everything = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    most = F.lit(float(cap)) * F.col("source_size")
    ranked = sizes.withColumn("w", weight).withColumn("fill", most / F.col("w"))
    left = F.lit(float(total_share)) * F.sum("source_size").over(everything) - F.lit(float(cap)) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    w_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    ranked = ranked.withColumn("level", left / w_left)
    # the first source in this order that isn't full sets the level of all that follow
    level = F.first(F.when(F.col("level") < F.col("fill"), F.col("level")), True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", level)
    return ranked.select("source", "source_size", F.coalesce(F.least(most, F.col("w") * F.col("level")), most).alias("target"))


def _slice(z: str, level: int) -> Column:
    at = F.col(z) * F.lit(float(SLICES ** (level + 1)))
    return F.pmod(F.floor(at).cast("long"), F.lit(SLICES)) if level else F.least(F.floor(at).cast("long"), F.lit(SLICES - 1))


def _rank(want: Column, size: Column, u: Column) -> Column:
    """Random odds over inclusion odds, as a number in (0, 1); null for a document that isn't drawn."""
    p = want - F.floor(want).cast("long")
    odds = (u / (1 - u)) / (p / (1 - p))
    return F.when((p > 0) & (size > 0), F.least(odds / (1 + odds), F.lit(1 - 2.0**-40)))


def _wish(weight: str | Column | None) -> Column:
    """In whole steps; null, negative and undefined wishes are 0."""
    if weight is None:
        return F.lit(WISH_STEPS).cast("long")
    w = (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    w = F.when(F.isnan(w) | w.isNull() | (w < 0), F.lit(0.0)).otherwise(F.least(w, F.lit(MOST_WISH)))
    return F.round(w * WISH_STEPS).cast("long")


def _uniform(seed: str) -> Column:
    """A number in (0, 1) of 52 bits of an MD5 over the seed, the doc_id and the MD5 of the text."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), part(F.col("doc_id")), F.lit(":"), part(F.md5(F.col("text")))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def _entered(docs: DataFrame, weight: str | Column | None, seed: str, *more: Column) -> DataFrame:
    """(doc_id, source, size, wish, u, row): what decides about a row; row is a hash of all its columns."""
    other = [c for c in sorted(docs.columns) if c != "text"]
    row = F.xxhash64(F.to_json(F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(other)])), "text")
    return docs.select("doc_id", "source", word_count().alias("size"), _wish(weight).alias("wish"), _uniform(seed).alias("u"), row.alias("row"), *more)


def _placed(rows: DataFrame, factors: DataFrame, cap: float) -> DataFrame:
    """``rows`` of ``_entered`` with the factors' columns, certain copies and place: where in the order of its source a row is, null if it isn't drawn."""
    x = rows.join(factors, F.col("source").eqNullSafe(F.col("c_source")), "left")
    x = settled(x, want=F.least(F.lit(float(cap)), F.col("c") * F.col("wish")))
    x = settled(x, certain=F.coalesce(F.floor("want"), F.lit(0)).cast("long"), z=_rank(F.col("want"), F.col("size"), F.col("u")))
    return x.withColumn("place", F.when(F.col("z").isNotNull(), F.struct("z", "doc_id", "size", "row"))).drop("want")


def _decide(docs: DataFrame, s: Scratch, weights: list[float], total_share: float, cap: float, seed: str, weight: str | Column | None, max_rounds: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``_entered``, and for each source (c_source, c, source_size, target, last, n, drawn).

    Rows before the place ``last`` are drawn, and ``drawn`` of the ``n`` rows at it, which are alike in all columns;
    last is null if none is.
    """
    base = s.put(_entered(docs, weight, seed))
    targets = s.put(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), list(weights), total_share, cap))
    factors = s.put(_factors(base, targets, cap, max_rounds, s) if weight is not None else _even(targets))
    ranked = s.put(_placed(base, bounded(factors), cap).select("source", "size", "certain", "z", "place"))
    # words still wanted after the certain copies, by source
    sure = ranked.groupBy("source").agg(F.sum(F.col("certain") * F.col("size")).alias("sure"))
    rest = sure.join(factors, F.col("source").eqNullSafe(F.col("c_source"))).select(F.col("c_source").alias("r_source"), (F.col("target") - F.col("sure")).alias("rest"))
    path = [f"s{i}" for i in range(LEVELS)]
    rows = ranked.where("z is not null").withColumns({k: _slice("z", i) for i, k in enumerate(path)})
    full = s.put(rest)
    for i in range(LEVELS):
        full = s.put(_filled(rows, full, path[:i]))
    # the last slice: rows alike in all columns are counted, so that no number of them is in one place
    here = reduce(and_, [F.col(k) == F.col(f"r_{k}") for k in path], F.col("source").eqNullSafe(F.col("r_source")))
    few = rows.join(bounded(full), here).groupBy("source", "place").agg(F.count("*").alias("n"), F.max("rest").alias("rest"), F.max("size").alias("size"))
    order = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("size") * F.col("n")).over(order), F.lit(0))
    # a row is drawn if its middle word is wanted, so that the words come nearest to the target
    drawn = F.floor((F.col("rest") - before - F.col("size") / 2.0) / F.col("size")) + 1
    few = few.withColumn("drawn", F.greatest(F.least(drawn, F.col("n")), F.lit(0)).cast("long"))
    last = s.put(few.where("drawn > 0").groupBy("source").agg(F.max(F.struct("place", "n", "drawn")).alias("x")))
    # a source whose last slice has no row drawn is full at the slice's edge
    begin = reduce(add, [F.col(f"r_{k}") / float(SLICES ** (i + 1)) for i, k in enumerate(path)])
    edge = F.struct(begin.alias("z"), *[F.lit(None).cast(k).alias(c) for c, k in (("doc_id", docs.schema["doc_id"].dataType), ("size", "long"), ("row", "long"))])
    marks = full.join(last, F.col("r_source").eqNullSafe(F.col("source")), "left").select("r_source", F.coalesce("x.place", edge).alias("last"), F.coalesce("x.n", F.lit(0)).alias("n"), F.coalesce("x.drawn", F.lit(0)).alias("drawn"))
    return base, s.put(factors.join(marks, F.col("c_source").eqNullSafe(F.col("r_source")), "left").drop("r_source"))


def _applied(rows: DataFrame, marks: DataFrame, cap: float) -> tuple[DataFrame, DataFrame]:
    """``rows`` of ``_entered`` with copies: first those that a comparison of places decides, then those at a place of
    which only some are drawn, with their certain copies."""
    x = _placed(rows, bounded(marks), cap)
    some = F.coalesce((F.col("place") == F.col("last")) & (F.col("drawn") < F.col("n")), F.lit(False))
    copies = F.col("certain") + F.coalesce(F.col("place") <= F.col("last"), F.lit(False)).cast("long")
    return x.where(~some).withColumn("copies", copies), x.where(some).withColumn("copies", F.col("certain"))


def mix(docs: DataFrame, weights: list[float] = (5.0, 2.0, 1.0), total_share: float = 1.5, cap: float = 2.0, seed: str = "mix", weight_col: str | Column | None = None, max_rounds: int = 20) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of ``docs`` (doc_id, text, source).

    size counts the words of the text (null or empty: 0), copies is how often the mix holds the document and
    taken is copies * size. ``weight_col``, a column or its name, gives documents of a source unequal wishes (null,
    negative or NaN: 0; steps of a thousandth); without it all are equal. Rows of size 0 are taken as their certain
    copies only. The random number depends on seed, doc_id and text, so reruns agree and rows that share an id, or have
    none, are drawn apart; rows alike in all columns are drawn in such a number as the target wants. A source of no
    words is taken not at all. Other columns of ``docs`` only tell rows apart. An empty input gives an empty result.
    """
    with Scratch(docs.sparkSession) as s:
        base, marks = _decide(docs, s, weights, total_share, cap, seed, weight_col, max_rounds)
        rows, some = _applied(base, marks, cap)
        keys = ["doc_id", "source", "size", "source_size", "target", "copies"]
        out = rows.select(*keys)
        if not marks.where("drawn < n").isEmpty():
            tied = some.groupBy(*keys).agg(F.max("drawn").alias("drawn"), F.max("n").alias("n"))
            for copies, n in ((F.col("copies") + 1, F.col("drawn")), (F.col("copies"), F.col("n") - F.col("drawn"))):
                out = out.unionByName(_times(tied.withColumn("copies", copies), n).select(*keys))
        return s.keep(out.withColumn("taken", F.col("copies") * F.col("size")))


def repeat(docs: DataFrame, weights: list[float] = (5.0, 2.0, 1.0), total_share: float = 1.5, cap: float = 2.0, seed: str = "mix", weight_col: str | Column | None = None, max_rounds: int = 20) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as ``mix`` holds it; parameters and cases as there.

    The factors and last places of all sources are joined to the rows, so texts are never shuffled.
    """
    with Scratch(docs.sparkSession) as s:
        _, marks = _decide(docs, s, weights, total_share, cap, seed, weight_col, max_rounds)
        marks = s.keep(marks)
        rows, some = _applied(_entered(docs, weight_col, seed, whole(docs).alias("doc")), marks, cap)
        out = rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc")
        if not marks.where("drawn < n").isEmpty():
            # rows alike in all columns: the certain copies of each, and as many more of one as are drawn
            sure = some.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc")
            one = some.groupBy("source").agg(F.first("doc").alias("doc"), F.max("drawn").alias("drawn"))
            out = out.unionByName(sure).unionByName(_times(one, F.col("drawn")).select("doc"))
        return out.select("doc.*")


def _times(rows: DataFrame, n: Column) -> DataFrame:
    """Each row n times, in blocks that are dealt out, as a row may be repeated without a bound."""
    blocks = rows.withColumn("times", n).where("times > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / BLOCK))))
    blocks = blocks.withColumn("left", F.least(F.lit(BLOCK).cast("long"), F.col("times") - F.col("block") * BLOCK)).repartition("block")
    return blocks.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("left"))))


def _filled(rows: DataFrame, at: DataFrame, path: list[str]) -> DataFrame:
    """From the slice ``path`` of each source in ``at`` to the finer slice in which the source is full.

    That is the last slice with fewer words before it than are wanted; rest becomes the words wanted from it.
    """
    name = f"s{len(path)}"
    here = F.col("source").eqNullSafe(F.col("r_source"))
    for k in path:
        here = here & (F.col(k) == F.col(f"r_{k}"))
    words = rows.join(bounded(at), here).groupBy("source", *path, name).agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))
    order = Window.partitionBy("source").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    words = words.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0))).where("before < rest")
    last = words.groupBy("source").agg(F.max_by(F.struct(*path, name, (F.col("rest") - F.col("before")).alias("rest")), F.col(name)).alias("x"))
    return last.select(F.col("source").alias("r_source"), *[F.col(f"x.{k}").alias(f"r_{k}") for k in [*path, name]], "x.rest")


def _even(targets: DataFrame) -> DataFrame:
    """(c_source, c, source_size, target) for equal wishes."""
    return targets.select(F.col("source").alias("c_source"), (F.col("target") / F.greatest(F.col("source_size") * WISH_STEPS, F.lit(1))).alias("c"), "source_size", "target")


def _factors(base: DataFrame, targets: DataFrame, cap: float, max_rounds: int, s: Scratch) -> DataFrame:
    """As ``_even``, with sum of size * min(cap, c * wish) = target: rounds that fix the documents at the cap.

    A source whose wishes are 0 for too many words can't reach its target and takes what it can. Sums are of whole
    numbers, so a rerun has the same factors.
    """
    now = s.put(targets.select(F.col("source").alias("c_source"), F.lit(0.0).alias("c"), "source_size", "target"))
    before = None
    for _ in range(max_rounds):
        x = base.join(bounded(now), F.col("source").eqNullSafe(F.col("c_source")))
        at_cap = F.col("c") * F.col("wish") >= F.lit(float(cap))
        sums = x.groupBy("c_source").agg(
            F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.max("c").alias("c0"),
            F.sum(F.when(at_cap, F.col("size")).otherwise(0)).alias("fixed"),
            F.sum(F.when(~at_cap, F.col("size").cast("decimal(19,0)") * F.col("wish").cast("decimal(19,0)")).otherwise(0)).cast("double").alias("free"),
        )
        more = F.greatest("c0", (F.col("target") - F.lit(float(cap)) * F.col("fixed")) / F.col("free"))
        now = s.put(sums.select("c_source", F.when(F.col("free") > 0, more).otherwise(F.col("c0")).alias("c"), "source_size", "target"))
        state = now.agg(F.sum(F.xxhash64("c_source", "c").cast("decimal(38,0)"))).first()[0]
        if state == before:
            break
        before = state
    return now
