"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each source has a target number of words, so each of its documents an expected number of copies
c = target / size of the source. The whole part of c is certain; the fractions are rounded by the pivotal
method (Deville & Tillé, 1998): two documents with fractions a and b meet; if a + b < 1, one gets a + b and
the other 0, else one gets 1 and the other a + b - 1, with the probabilities that keep both expectations.
One of the two is settled, the other goes on. A source's number of copies is thus fixed to within one, and
as documents meet others of like size first, so nearly is its number of words.

The meetings form a reduction tree. A source's documents are dealt by size class and hash into groups of
about GROUP rows; a group's rows meet in order of size within one aggregate expression and leave one
unsettled row; those of GROUP neighbouring groups form the next level's group, and so on to one row of a
source, which is rounded by a draw. No task sees more than one group at a time, however large a source is.
Rows that repeat an id and a text are counted first and then numbered, so they are dealt like any others.
All draws are hashes of ids, texts and these numbers, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import keep, unit

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
#: Rows that meet in one group, on average.
GROUP = 64
#: Ratio of the sizes at a class's two ends.
CLASS_RATIO = 1.25
#: Fractions nearer to 0 or 1 count as settled.
EPSILON = 1e-9
#: Repeated rows that one task numbers at once.
REPEATS = 4096
#: Portions in which rows that repeat an id, source and text are numbered.
PORTIONS = 256


def words(text: Column) -> Column:
    """The number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from rows (source, source_size), one for each source.

    Weights repeat along the sources in code-point order, null last. All sources share the total; a target
    stops at ``most`` times its source's size and the excess is shared anew by weight until none is above.
    The result is that of water filling: in order of most * size / weight, a source is capped as long as
    its share of what is left exceeds its cap. The table has one row for each source, not for documents; its
    windows without partitions put all sources into one task, which is meant for up to some millions of them.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    table = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sizes.withColumn("weight", F.element_at(table, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(most))
    by_ratio = Window.orderBy((cap / F.col("weight")), F.col("source").isNull(), F.col("source"))
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    ranked = ranked.withColumns({"cap": cap, "left": total - F.coalesce(F.sum(cap).over(before), F.lit(0.0)), "weights": F.sum("weight").over(after)})
    ranked = ranked.withColumn("level", F.col("left") / F.col("weights"))
    # along this order sources are capped up to the first whose share of what is left fits under its cap
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.row_number().over(by_ratio).alias("n"), F.col("level")))
    ranked = ranked.withColumn("fits", fits)
    level = F.min("fits").over(Window.partitionBy())
    return ranked.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.coalesce(level["level"], F.lit(float("inf")))).alias("target"))


def _meet(group: Column, seed: int) -> Column:
    """Lets the rows of an array meet one after another; rows come sorted, so neighbours are of like size.

    Gives (last, settled): the row that goes on, and the others, whose p is 0 or 1.
    """
    none = F.filter(group, lambda _: F.lit(False))

    def step(state: Column, row: Column) -> Column:
        a, b = state["last"], row
        both = a["p"] + b["p"]
        draw = unit(F.lit(seed), a["id"], a["salt"], a["nth"], b["id"], b["salt"], b["nth"])
        low = both < 1.0
        # below one, a goes on with the sum in proportion to its share; else with the rest over one
        first_on = F.when(low, draw * both < a["p"]).otherwise(draw * (2.0 - both) < 1.0 - a["p"])
        rest = F.when(low, both).otherwise(both - 1.0)
        done = F.when(low, F.lit(0.0)).otherwise(F.lit(1.0))
        on = F.when(first_on, a.withField("p", rest)).otherwise(b.withField("p", rest))
        out = F.when(first_on, b.withField("p", done)).otherwise(a.withField("p", done))
        # what has come to 0 or 1 already is settled as it is
        whole = (a["p"] <= EPSILON) | (a["p"] >= 1.0 - EPSILON)
        return F.struct(
            F.when(whole, b).otherwise(on).alias("last"),
            F.concat(state["settled"], F.array(F.when(whole, a.withField("p", F.round(a["p"]))).otherwise(out))).alias("settled"),
        )

    return F.aggregate(F.slice(group, F.lit(2), F.size(group)), F.struct(group[0].alias("last"), none.alias("settled")), step)


def _level(dealt: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Lets the rows of each group meet, in order of size."""
    sortable = F.struct(F.col("row.size").alias("a"), F.col("row.id").alias("b"), F.col("row.salt").alias("c"), F.col("row.nth").alias("d"), F.col("row"))
    grouped = dealt.groupBy(*keys).agg(F.array_sort(F.collect_list(sortable)).alias("rows"))
    return keep(grouped.select(*keys, _meet(F.transform("rows", lambda r: r["row"]), seed).alias("met")))


def round_copies(rows: DataFrame, seed: int = 0) -> DataFrame:
    """(source, id, salt, nth, size, whole, extra) from rows (source, id, salt, nth, size, whole, p); extra is 0 or 1.

    p is the probability of extra; id, salt and nth together tell rows apart. Each source's sum of extra is its
    sum of p, rounded up or down.
    """
    size_class = F.floor(F.log(F.greatest(F.col("size"), F.lit(1))) / F.log(F.lit(CLASS_RATIO))).cast("int")
    rows = rows.withColumn("class", size_class)
    largest = rows.groupBy("source", "class").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    groups = max(1, -(-largest // GROUP))
    at = F.pmod(F.xxhash64(F.lit(seed), "id", "salt", "nth"), F.lit(groups))
    dealt = rows.select("source", "class", at.alias("at"), F.struct("p", "size", "id", "salt", "nth", "whole").alias("row"))
    settled = []
    while True:
        met = _level(dealt, ["source", "class", "at"], seed)
        settled.append(met.select("source", F.explode("met.settled").alias("row")))
        dealt = met.select("source", "class", F.floor(F.col("at") / GROUP).alias("at"), F.col("met.last").alias("row"))
        if groups == 1:
            break
        groups = -(-groups // GROUP)
    met = _level(dealt.select("source", "row"), ["source"], seed)  # one row of each size class at most
    settled.append(met.select("source", F.explode("met.settled").alias("row")))
    draw = unit(F.lit(seed), F.lit("last"), F.col("row.id"), F.col("row.salt"), F.col("row.nth"))
    settled.append(met.select("source", F.col("met.last").alias("row")).withColumn("row", F.col("row").withField("p", (draw < F.col("row.p")).cast("double"))))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("source", "row.id", "row.salt", "row.nth", "row.size", "row.whole", (F.col("row.p") > 0.5).cast("long").alias("extra"))


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(source, id, salt, size, portion) of each row: salt is a hash of the text, portion one of the whole row."""
    whole_row = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns if not isinstance(docs.schema[c].dataType, (T.MapType, T.VariantType)))), F.lit(PORTIONS)).cast("int")
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{source_col}`").alias("source"), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("salt"), words(text).alias("size"), whole_row.alias("portion"))


def _occurrences(counted: DataFrame) -> DataFrame:
    """Each row of (source, id, salt, size, m) m times, numbered from 0 as nth; many repeats are dealt to several tasks."""
    once = counted.where("m = 1").select("source", "id", "salt", "size", F.lit(0).cast("long").alias("nth"))
    parts = counted.where("m > 1").select("source", "id", "salt", "size", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / REPEATS))).alias("part"))
    dealt = parts.repartition("id", "salt", "part")
    last = F.least(F.col("m"), (F.col("part") + 1) * REPEATS) - 1
    return once.unionByName(dealt.select("source", "id", "salt", "size", F.explode(F.sequence(F.col("part") * REPEATS, last)).alias("nth")))


def _decided(sizes: DataFrame, seed: int, most: int) -> DataFrame:
    """(source, id, salt, nth, size, source_size, target, copies) for every row of sizes."""
    counted = keep(sizes.groupBy("source", "id", "salt", "size").agg(F.count(F.lit(1)).alias("m")))
    wanted = targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size")), most=most)
    copies = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    whole = F.floor(copies + EPSILON)
    joined = _occurrences(counted).join(wanted.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = joined.withColumns({"whole": whole, "p": F.greatest(copies - whole, F.lit(0.0))})
    open_rows = rows.where(F.col("p") > EPSILON).select("source", "id", "salt", "nth", "size", "whole", "p")
    rounded = round_copies(open_rows, seed)
    settled = rows.where(F.col("p") <= EPSILON).select("source", "id", "salt", "nth", "size", "whole", F.lit(0).cast("long").alias("extra"))
    found = rounded.unionByName(settled)
    named = found.join(wanted.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    return named.select("id", "salt", "nth", "source", "size", "source_size", "target", (F.col("whole") + F.col("extra")).cast("long").alias("copies"))


def mix(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST_COPIES) -> DataFrame:
    """(id, salt, source, size, source_size, target, copies) for every row of docs.

    Null texts have no words and, like empty ones, no weight in the targets; they follow their source's
    share of copies all the same. Texts of any length count whole. A null source is a source of its own, the
    last. Null ids are told apart by a hash of their text. Repeated rows are each decided, ties in size by id.
    Other columns, whatever their names, are not read. An empty table gives an empty result; a source without
    any word has target 0 and no copies.
    """
    return _decided(_sizes(docs.select(id_col, text_col, source_col), id_col, text_col, source_col).drop("portion"), seed, most).drop("nth")


def apply_mix(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it, with all its columns.

    Nulls, empty and long texts, ties and an empty table are as in ``mix``; columns may have any names. Of rows
    that agree in id, source and text some may be taken once more than others; the first by a hash of the whole
    row are. Whole rows are shuffled once. They are numbered within PORTIONS by that hash, so only rows that
    agree in all columns, which cannot be told apart, stream through one task.
    """
    sizes = keep(_sizes(docs, id_col, text_col, source_col))
    key = F.xxhash64(F.col("id").isNull(), "id", F.col("source").isNull(), "source").alias("key")
    found = _decided(sizes.drop("portion"), seed, MOST_COPIES)
    # all rows of a key have the same whole number of copies or one more; that many of them have one more
    per_key = found.groupBy(key, "salt").agg(F.min("copies").alias("whole"), (F.sum("copies") - F.min("copies") * F.count(F.lit(1))).alias("more"))
    parts = sizes.groupBy(key, "salt", "portion").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("key", "salt").orderBy("portion").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    decided = parts.join(per_key, ["key", "salt"]).select("key", "salt", "portion", "whole", "more", "first")
    hashed = F.xxhash64(*(F.col(f"row.`{c}`") for c in docs.columns if not isinstance(docs.schema[c].dataType, (T.MapType, T.VariantType))))
    left = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    left = left.select("row", *(F.col(f"row.`{c}`").alias(n) for c, n in ((id_col, "raw"), (source_col, "source"), (text_col, "text"))), hashed.alias("hash"))
    left = left.withColumns({"id": F.col("raw").cast("long"), "salt": F.xxhash64("text"), "portion": F.pmod(F.col("hash"), F.lit(PORTIONS)).cast("int")}).select("row", "hash", key, "salt", "portion")
    number = F.row_number().over(Window.partitionBy("key", "salt", "portion").orderBy("hash"))
    numbered = left.withColumn("number", number).join(decided, ["key", "salt", "portion"])
    copies = F.col("whole") + (F.col("first") + F.col("number") <= F.col("more")).cast("long")
    taken = numbered.withColumn("copies", copies).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")
