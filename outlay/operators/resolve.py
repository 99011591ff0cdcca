"""Requested names to the names in the data: exact, then a single name containing the text, then a close one.

Close names come from an inverted index of the options' letters, which can be stored. The request first meets the options with
which it shares most pairs of neighbouring letters; the ratio of the last of the best ones is a bound that every
result must reach. A ratio is at most twice the shared letters over both lengths, so an option within the bound shares at least
so many of the request's letters, and one of its rarest ones: only their postings are read. What is left after exact
counts of letters is compared by matching blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay.functions.similarity import block_ratio, common_letters, letter_pairs, marks

CUTOFF = 0.6
CLOSEST = 5
#: Options compared first, to find the bound; more only make it tighter.
SEEDS = 16


def _lowered(options: DataFrame) -> DataFrame:
    """(value, low): one option for each lower-case spelling."""
    return options.select(F.col("value"), F.lower("value").alias("low")).where("low IS NOT NULL").groupBy("low").agg(F.min("value").alias("value"))


def _requests(wanted: list[str], spark) -> DataFrame:
    """(wanted, key) of the names asked for; the request bounds their number."""
    return spark.createDataFrame([(w,) for w in dict.fromkeys(wanted)], "wanted string").withColumn("key", F.lower(F.trim("wanted")))


def name_index(options: DataFrame) -> DataFrame:
    """(kind, gram, low, value): the marks (letters by occurrence) and letter pairs of every option, for ``closest``.

    May be written with ``kind`` and ``gram`` as leading columns and read again; new options are appended.
    """
    grams = F.array(
        F.struct(F.lit("mark").alias("kind"), marks(F.col("low")).alias("grams")), F.struct(F.lit("pair").alias("kind"), letter_pairs(F.col("low")).alias("grams"))
    )
    return _lowered(options).select("low", "value", F.inline(grams)).select("kind", F.explode("grams").alias("gram"), "low", "value")


def exact_or_containing(wanted: list[str], options: DataFrame) -> DataFrame:
    """Per requested name: the equal option, how many contain it, and the first that does. Names without any are left out."""
    names = F.array(*[F.struct(F.lit(w).alias("wanted"), F.lower(F.trim(F.lit(w))).alias("key")) for w in wanted])
    fits = lambda a: (F.col("low") == a["key"]) | ((a["key"] != "") & F.col("low").contains(a["key"]))
    rows = _lowered(options).select("value", "low", F.inline(F.filter(names, fits)))
    inside = F.col("low").contains(F.col("key")) & (F.col("key") != "")
    return rows.groupBy("wanted").agg(
        F.min(F.when(F.col("low") == F.col("key"), F.col("value"))).alias("exact"),
        F.count_if(inside).alias("containing"),
        F.min(F.when(inside, F.col("value"))).alias("first_containing"),
    )


def _ranked(rows: DataFrame, limit: int) -> DataFrame:
    best = Window.partitionBy("wanted").orderBy(F.desc("ratio"), F.desc("low"))
    return rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit)


def _reaches(low: Column, key: Column, bound: Column) -> Column:
    """Whether the ratio of two texts can reach a bound, by their lengths and then by the letters they share."""
    both = F.length(low) + F.length(key)
    needed = bound * both - 1e-9
    return (2.0 * F.least(F.length(low), F.length(key)) >= needed) & (2.0 * common_letters(low, key) >= needed)


def closest(wanted: list[str], options: DataFrame, limit: int = CLOSEST, cutoff: float = 0.0, index: DataFrame | None = None) -> DataFrame:
    """(wanted, value, ratio, place): the ``limit`` most similar options per requested name, best first, ties by falling name.

    ``index`` is a stored ``name_index`` of the options; without one it is made here. Nulls are no options.
    """
    index = name_index(options) if index is None else index
    asked = _requests(wanted, options.sparkSession)
    ratio = block_ratio(F.col("low"), F.col("key"))

    pairs = asked.select("wanted", "key", F.explode(letter_pairs(F.col("key"))).alias("gram"))
    shared = index.where("kind = 'pair'").join(pairs, "gram").groupBy("wanted", "key", "low", "value").agg(F.count("*").alias("n"))
    alike = Window.partitionBy("wanted").orderBy(F.desc(F.col("n") / (F.length("low") + F.length("key"))), "low")
    seeds = shared.withColumn("r", F.row_number().over(alike)).where(F.col("r") <= max(SEEDS, limit)).withColumn("ratio", ratio)
    last = _ranked(seeds, limit).groupBy("wanted").agg(F.count("*").alias("n"), F.min("ratio").alias("last"))
    bound = F.greatest(F.lit(cutoff), F.when(F.col("n") >= limit, F.col("last")).otherwise(0.0))
    bounds = asked.join(last, "wanted", "left").select("wanted", "key", F.coalesce(bound, F.lit(cutoff)).alias("bound"))

    # Shared letters are at least half the bound times both lengths, and the option is no shorter than what it shares.
    mine = bounds.select("wanted", "key", "bound", F.explode(marks(F.col("key"))).alias("gram"))
    frequent = index.where("kind = 'mark'").join(mine.select("gram").distinct(), "gram").groupBy("gram").agg(F.count("*").alias("df"))
    rarity = Window.partitionBy("wanted").orderBy(F.coalesce("df", F.lit(0)), "gram")
    needed = F.greatest(F.ceil(F.col("bound") * F.length("key") / (2 - F.col("bound")) - 1e-9), F.lit(1))
    probes = mine.join(frequent, "gram", "left").withColumn("r", F.row_number().over(rarity)).where(F.col("r") <= F.length("key") - needed + 1)
    met = index.where("kind = 'mark'").join(probes.select("wanted", "key", "bound", "gram"), "gram")
    met = met.select("wanted", "key", "bound", "low", "value").distinct().where(_reaches(F.col("low"), F.col("key"), F.col("bound")))
    # Options without a shared letter have ratio 0 (two empty texts 1): the last names may fill what is left.
    filler = _lowered(options).where("low = ''").unionByName(_lowered(options).orderBy(F.desc("low")).limit(limit)).distinct()
    filler = filler.select("low", "value", F.explode(F.array(*[F.lit(w) for w in dict.fromkeys(wanted)])).alias("wanted")).join(asked, "wanted")
    rows = met.drop("bound").unionByName(filler).distinct().withColumn("ratio", ratio)
    return _ranked(rows.where(F.col("ratio") >= cutoff), limit).select("wanted", "value", "ratio", "place")


def match_values(wanted: list[str], options: DataFrame, cutoff: float = CUTOFF, index: DataFrame | None = None) -> DataFrame:
    """(wanted, resolved, how): how is exact, contains, close, or null when nothing fits."""
    asked = options.sparkSession.createDataFrame([(w,) for w in wanted], "wanted string")
    found = exact_or_containing(wanted, options)
    close = closest(wanted, options, 1, cutoff, index).select("wanted", F.col("value").alias("close"))
    one = F.when(F.col("containing") == 1, F.col("first_containing"))
    joined = asked.join(found, "wanted", "left").join(close, "wanted", "left")
    how = (
        F.when(F.col("exact").isNotNull(), F.lit("exact"))
        .when(one.isNotNull(), F.lit("contains"))
        .when(F.col("close").isNotNull(), F.lit("close"))
    )
    return joined.select("wanted", F.coalesce("exact", one, "close").alias("resolved"), how.alias("how"))


def look_up(asked: list[tuple[str, str]], options: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(field, wanted, resolved, containing) of every asked (field, name) that some option (field, value) resembles.

    ``resolved`` is the equal option, else the only one that contains the name, else the closest from ``cutoff`` on, else null.
    Pairs that share too few letters for the cutoff are not compared further.
    """
    names = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(w).alias("wanted"), F.lower(F.trim(F.lit(w))).alias("key")) for f, w in asked])
    low = F.col("low")
    fits = lambda a: (a["field"] == F.col("field")) & (
        (low == a["key"]) | ((a["key"] != "") & low.contains(a["key"])) | _reaches(low, a["key"], F.lit(cutoff))
    )
    rows = options.select("field", "value", F.lower("value").alias("low"))
    rows = rows.select("field", "value", "low", F.explode(F.filter(names, fits)).alias("a")).select("field", "value", "low", "a.wanted", "a.key")
    rows = rows.withColumns({"equal": low == F.col("key"), "inside": low.contains(F.col("key")) & (F.col("key") != "")})
    ratio = block_ratio(low, F.col("key"))
    close = F.when(F.col("ratio") >= cutoff, F.struct("ratio", "low", "value"))
    found = rows.withColumn("ratio", ratio).groupBy("field", "wanted").agg(
        F.min(F.when(F.col("equal"), F.col("value"))).alias("exact"),
        F.count_if("inside").alias("containing"),
        F.min(F.when(F.col("inside"), F.col("value"))).alias("one"),
        F.max(close).alias("close"),
    )
    one = F.when(F.col("containing") == 1, F.col("one"))
    return found.select("field", "wanted", F.coalesce("exact", one, "close.value").alias("resolved"), "containing")


def containing_names(field: str, wanted: str, options: DataFrame, limit: int = 4) -> DataFrame:
    """The first options of a field, by name, that contain a text."""
    low = F.lower(F.trim(F.lit(wanted)))
    return options.where((F.col("field") == field) & F.lower("value").contains(low)).select("value").orderBy("value").limit(limit)
