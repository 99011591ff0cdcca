"""Near-equal lines across documents by an exact set-similarity join on built-in functions.

A line is the set of its lower-cased words. Two lines match if the Jaccard similarity of their sets is at least 4/5.
A line is removed if some earlier line matches it, whether that one is removed or not; earlier means lesser
(document id, line number). So the first of equal lines stays, and the result does not depend on the order of work.

1. Words are counted over all lines into a table of fixed size by hash; the rarest words of a set come first.
2. Equal sets become one row, their first line, with the words of its prefix: sets of n words that match share one of
   their n - ceil(4n/5) + 1 rarest. Words that occur only once are left out of the prefix, as nothing shares them.
   Sets of fewer than four words match equal sets only and have no prefix.
3. Rows that share a prefix word meet. Sizes, positions and a 64-bit parity sketch of the sets rule out nearly all;
   all three are bounds, so no match is lost. A semi join over all of them finds the sets with a possible match (it stops
   at the first, so a group of k near-copies costs k rows and not k * k). Among these few a semi join finds the sets with a
   possible earlier match, and a window names for each the first set of its word and size class, the likely partner.
4. Partners are verified word by word. Sets whose partner fails meet all their possible partners in a semi join that
   compares the words themselves, so no pairs are written: a group of k sets costs k rows.
5. Removed lines are dropped from their documents. Documents without a removed line are not shuffled.

Words are verified by 64-bit hashes; set names have 128 bits. Bit tables of a byte for each row, 512 KB at least, keep nearly all
rows that cannot matter out of shuffles; none that matters is lost.

Null texts stay null, blank lines stay, texts that lose all lines become empty and stay as rows. A null id is
the least. Where ids are missing or shared, a row is named by its id and a 128-bit hash of its text, so lines go from the very
text that holds them; rows equal in both lose the same lines. Empty tables give empty results; other columns are passed on untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay.llm.common import BLANKS, stored, table

#: Similarity as a ratio of whole numbers: 4/5.
TOP, BOTTOM = 4, 5
#: Size of the word-count table (a power of two), and longs of the smallest bit table.
BUCKETS = 1 << 17
LONGS = 65_536
#: Words of a set from which the whole sketch is kept.
LONG = 48
SIZES = ("n", "parity", "half")
_LEAST = -(1 << 63)


# ----- tables read by expressions -----


class WordClasses:
    """For each bucket of word hashes the binary logarithm of how often its words occur, a byte each.

    A constant of the plan, as lambda functions take no subqueries.
    """

    def __init__(self, hashes: DataFrame):
        counts = hashes.select(F.col("h").bitwiseAND(BUCKETS - 1).cast("int").alias("b")).groupBy("b").agg(F.count("*").alias("n"))
        packed = counts.selectExpr("shiftright(b, 3) AS b", "shiftleft(CAST(least(62, floor(log2(n))) AS BIGINT), 8 * (b & 7)) AS c").groupBy("b").agg(F.bit_or("c").alias("c"))
        classes = ["0"] * BUCKETS
        for row in packed.collect():  # BUCKETS / 8 rows at most
            classes[8 * row.b : 8 * row.b + 8] = [str(row.c >> 8 * i & 63) for i in range(8)]
        self.table = F.split(F.lit(",".join(classes)), ",").cast("array<bigint>")

    def of(self, h: Column) -> Column:
        """0 only for the one occurrence of a word."""
        return F.get(self.table, h.bitwiseAND(BUCKETS - 1).cast("int"))


def _dense(pairs: DataFrame, size: int, kind: str) -> DataFrame:
    """Rows (b, c) as one array with c at position b and 0 elsewhere; ``size`` bounds it."""
    flat = pairs.sparkSession.range(0, size, 1, 1).select(F.col("id").cast("int").alias("b"))
    full = flat.join(pairs, "b", "left").select("b", F.coalesce("c", F.lit(0).cast(kind)).alias("c"))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "c"))), lambda x: x["c"]).alias("t"))


class Sieve:
    """Whether a row may be among the rows the sieve was made of: false positives, no false negatives."""

    def __init__(self, rows: DataFrame, *names: str):
        # Eight bits for each row, so that the share of false positives does not grow with the rows.
        self.longs = max(LONGS, 1 << (rows.count() // 8).bit_length())
        h = F.xxhash64(*names)
        pairs = rows.select(F.pmod(F.shiftrightunsigned(h, 6), F.lit(self.longs)).cast("int").alias("b"), F.expr("shiftleft(1L, CAST(pmod(xxhash64(" + ", ".join(names) + "), 64) AS INT))").alias("c"))
        bits = pairs.groupBy("b").agg(F.bit_or("c").alias("c"))
        self.table = stored(_dense(bits, self.longs, "bigint"), "sieve")

    def may_hold(self, *cols: Column) -> Column:
        h = F.xxhash64(*cols)
        word = F.get(self.table.scalar(), F.pmod(F.shiftrightunsigned(h, 6), F.lit(self.longs)).cast("int"))
        return F.getbit(word, F.pmod(h, F.lit(64)).cast("int")) == 1


# ----- lines and sets -----


def with_names(docs: DataFrame, text: str) -> DataFrame:
    """(row, doc, t): every row with its name, which orders rows by id, and its text.

    The name is the id itself where no two rows share one and none is null, which one grouping of the ids tells.
    """
    own = F.col("doc_id").cast("long")
    shared = docs.groupBy(own.alias("i")).agg(F.count("*").alias("n")).where("n > 1 OR i IS NULL").limit(1).count()
    t = F.col(f"`{text}`")
    name = F.struct(F.coalesce(own, F.lit(_LEAST)).alias("i"), F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(1), t).alias("h2")) if shared else own
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), name.alias("doc"), t.alias("t"))


def _lines(named: DataFrame) -> DataFrame:
    """(doc, line, t) of every line with a word, lower-cased."""
    rows = named.select("doc", F.posexplode(F.split("t", "\n")).alias("line", "t"))
    return rows.where(F.col("t").rlike(r"[^\x20\x09-\x0D]")).withColumn("t", F.lower("t"))


def _words(t: Column) -> Column:
    """Words of a line, empty ones among them; lines without other blanks take the faster split."""
    plain = F.when(t.rlike(r"[\x09\x0B-\x0D]"), F.regexp_replace(t, BLANKS, " ")).otherwise(t)
    return F.split(plain, " ")


def _keys(t: Column, classes: WordClasses) -> Column:
    """Distinct words as longs that sort from rare to frequent: six bits of class, then 57 bits of hash."""
    # Functions over arrays are evaluated as they are written: a word is hashed once, and equal words are dropped first.
    hashes = F.array_distinct(F.transform(F.array_remove(_words(t), ""), lambda w: F.xxhash64(w)))
    return F.sort_array(F.transform(hashes, lambda h: F.shiftleft(classes.of(h), 57).bitwiseOR(F.shiftrightunsigned(h, 7))))


def keyed_lines(named: DataFrame, classes: WordClasses) -> DataFrame:
    """(doc, line, s1, s2, n, parity, half, lone, prefix) of every line: its place, and its set's 128-bit name, size,
    sketch and prefix. Words that occur once in all lines lead the prefix; they are counted (``lone``) and not kept.

    A sketch has 128 bits, each the parity of the words that fall on it: sets that differ in d words differ in d bits at
    most. ``parity`` folds it to 64 bits, enough for sets of fewer than ``LONG`` words; longer ones keep a half too.
    """
    rows = _lines(named).select("doc", "line", _keys(F.col("t"), classes).alias("keys"))
    n = F.size("keys")
    front = F.when(n >= TOP, F.slice("keys", 1, n - F.ceil(n * TOP / BOTTOM).cast("int") + 1))
    shared = F.filter(front, lambda k: k >= 1 << 57)
    prefix = F.transform(shared, lambda k: (k.bitwiseAND(0xFFFFFFFF) - (1 << 31)).cast("int"))
    parity = F.expr("aggregate(keys, 0L, (a, k) -> a ^ shiftleft(1L, CAST(k & 63L AS INT)))")
    half = F.expr("aggregate(filter(keys, k -> k & 64L = 64L), 0L, (a, k) -> a ^ shiftleft(1L, CAST(k & 63L AS INT)))")
    half = F.when(n >= LONG, half).otherwise(F.lit(0).cast("long")).alias("half")
    names = F.xxhash64("keys").alias("s1"), F.xxhash64(F.lit(1), "keys").alias("s2")
    return rows.select("doc", "line", *names, n.alias("n"), parity.alias("parity"), half, (F.size(front) - F.size(shared)).alias("lone"), prefix.alias("prefix"))


def sets(lines: DataFrame) -> DataFrame:
    """One row for each distinct set, with its first line (doc, line) and the number of its lines."""
    rows = lines.select("s1", "s2", F.struct("doc", "line", *SIZES, "lone", "prefix").alias("first"))
    return rows.groupBy("s1", "s2").agg(F.min("first").alias("first"), F.count("*").alias("copies")).select("s1", "s2", "first.*", "copies")


def _postings(found: DataFrame) -> DataFrame:
    rows = found.select("doc", "line", *SIZES, "lone", F.posexplode("prefix").alias("pos", "token"))
    rows = rows.select("doc", "line", *SIZES, (F.col("lone") + F.col("pos")).alias("pos"), "token")
    # None is null; saying so spares the planner filters that would tell apart the uses of one exchange.
    whole = [f.name for f in rows.schema if f.dataType.typeName() != "struct"]
    return rows.select(*[F.coalesce(c, F.lit(0)).alias(c) if c in whole else F.col(c) for c in rows.columns])


def _possible(x: str, y: str) -> Column:
    """Bounds that every matching pair meets: sizes, what is left after the shared word, and differing words."""
    nx, ny, px, py = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.pos"), F.col(f"{y}.pos")
    # Overlap o of a match: BOTTOM * o >= TOP * (nx + ny - o).
    apart = F.col(f"{x}.parity").bitwiseXOR(F.col(f"{y}.parity"))
    half = F.col(f"{x}.half").bitwiseXOR(F.col(f"{y}.half"))
    narrow, wide = F.bit_count(apart), F.bit_count(half) + F.bit_count(apart.bitwiseXOR(half))
    return (
        (F.least(nx, ny) * BOTTOM >= F.greatest(nx, ny) * TOP)
        & ((F.least(nx - px, ny - py) + F.least(px, py)) * (TOP + BOTTOM) >= (nx + ny) * TOP)
        & (narrow * (TOP + BOTTOM) <= (nx + ny) * (BOTTOM - TOP))
        & ((F.least(nx, ny) < LONG) | (wide * (TOP + BOTTOM) <= (nx + ny) * (BOTTOM - TOP)))
    )


def _earlier(y: str, x: str) -> Column:
    return (F.col(f"{y}.doc") < F.col(f"{x}.doc")) | ((F.col(f"{y}.doc") == F.col(f"{x}.doc")) & (F.col(f"{y}.line") < F.col(f"{x}.line")))


def _involved(found: DataFrame) -> DataFrame:
    """Sets with a possible match, earlier or later: all that the further steps need, after one shuffle of all postings."""
    p = _postings(found)
    other = (F.col("x.doc") != F.col("y.doc")) | (F.col("x.line") != F.col("y.line"))
    semi = p.alias("x").join(p.alias("y"), (F.col("x.token") == F.col("y.token")) & other & _possible("x", "y"), "left_semi")
    places = stored(semi.select("doc", "line").distinct(), "involved")
    sieve = Sieve(places, "doc", "line")
    return found.where(sieve.may_hold(F.col("doc"), F.col("line"))).join(places, ["doc", "line"], "left_semi")


def _suspects(few: DataFrame) -> DataFrame:
    """(doc, line) of sets with a possible earlier match."""
    p = _postings(few)
    semi = p.alias("x").join(p.alias("y"), (F.col("x.token") == F.col("y.token")) & _earlier("y", "x") & _possible("x", "y"), "left_semi")
    return semi.select("doc", "line").distinct()


def _partners(few: DataFrame) -> DataFrame:
    """(doc, line, ydoc, yline): for each set the nearest of the first sets of a shared word and size class, if it may match."""
    p = _postings(few)
    own = F.struct("doc", "line", *SIZES, "pos")
    band = F.floor(F.log("n") / F.log(F.lit(BOTTOM / TOP)))
    w = Window.partitionBy("token", "band").orderBy("doc", "line")
    led = p.withColumn("band", band).select(own.alias("x"), F.first(own).over(w).alias("y")).where(_earlier("y", "x") & _possible("x", "y"))
    near = F.bit_count(F.col("x.parity").bitwiseXOR(F.col("y.parity")))
    led = led.select(F.col("x.doc").alias("doc"), F.col("x.line").alias("line"), F.struct(near.alias("d"), F.col("y.doc").alias("ydoc"), F.col("y.line").alias("yline")).alias("y"))
    return led.groupBy("doc", "line").agg(F.min("y").alias("y")).select("doc", "line", "y.ydoc", "y.yline")


# ----- verification -----


def _words_at(named: DataFrame, places: DataFrame) -> DataFrame:
    """(doc, line, h): the distinct words, as hashes, of the lines at the places (doc, line), and of some others."""
    sieve = Sieve(places, "doc", "line")
    lines = named.select("doc", F.posexplode(F.split("t", "\n")).alias("line", "t")).where(sieve.may_hold(F.col("doc"), F.col("line"))).withColumn("t", F.lower("t"))
    words = lines.select("doc", "line", F.array_distinct(F.transform(F.array_remove(_words(F.col("t")), ""), lambda w: F.xxhash64(w))).alias("h"))
    # Rows that are equal in id and text give a place twice.
    return words.groupBy("doc", "line").agg(F.min("h").alias("h"))


def _match(h: str, hy: str) -> Column:
    """Whether two sets of words match."""
    return F.size(F.array_intersect(h, hy)) * (TOP + BOTTOM) >= (F.size(h) + F.size(hy)) * TOP


def _verified(named: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc, line) of the pairs (doc, line, ydoc, yline) whose lines match word by word."""
    ends = pairs.select("doc", "line").unionByName(pairs.select(F.col("ydoc").alias("doc"), F.col("yline").alias("line")))
    words = _words_at(named, ends)
    y = words.select(F.col("doc").alias("ydoc"), F.col("line").alias("yline"), F.col("h").alias("hy"))
    both = pairs.join(y, ["ydoc", "yline"]).select("doc", "line", "hy").join(words, ["doc", "line"])
    return both.where(_match("h", "hy")).select("doc", "line").distinct()


def _verified_rest(named: DataFrame, mine: DataFrame, others: DataFrame) -> DataFrame:
    """(doc, line) of postings ``mine`` that match, word by word, one of ``others`` with their word.

    Pairs are never rows: of the others those stay that some of ``mine`` may match, of ``mine`` those that may match one of
    them; these few meet with their words in a semi join that stops at the first match.
    """
    may = (F.col("x.token") == F.col("y.token")) & _earlier("y", "x") & _possible("x", "y")
    near = stored(others.alias("y").join(mine.alias("x"), may, "left_semi"), "near")
    mine = stored(mine.alias("x").join(near.alias("y"), may, "left_semi"), "mine")
    words = stored(_words_at(named, mine.select("doc", "line").unionByName(near.select("doc", "line"))), "words")
    x, y = mine.join(words, ["doc", "line"]), near.join(words, ["doc", "line"])
    return x.alias("x").join(y.alias("y"), may & _match("x.h", "y.h"), "left_semi").select("doc", "line").distinct()


def _matched(named: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, line) of the first lines of sets that match an earlier set."""
    few = stored(_involved(found), "few")
    suspects = stored(_suspects(few), "suspects")
    partners = stored(_partners(few), "partners")
    done = stored(_verified(named, partners), "matched")
    left = stored(suspects.join(done, ["doc", "line"], "left_anti"), "left")
    if left.isEmpty():
        return done
    # The rest meet all their possible partners.
    mine = stored(_postings(few.join(left, ["doc", "line"], "left_semi")), "postings")
    return stored(done.unionByName(_verified_rest(named, mine, _postings(few))), "matched")


# ----- removal -----


def removals(named: DataFrame) -> DataFrame:
    """(doc, line) of every line to remove from rows ``with_names``."""
    words = named.select(F.explode(_words(F.replace(F.lower("t"), F.lit("\n"), F.lit(" ")))).alias("w")).where("w <> ''")
    classes = WordClasses(words.select(F.xxhash64("w").alias("h")))
    lines = stored(keyed_lines(named, classes), "lines")
    found = stored(sets(lines), "sets")
    matched = _matched(named, found)
    sieve = Sieve(matched, "doc", "line")
    gone = found.select("doc", "line", "s1", "s2", "copies").where((F.col("copies") > 1) | sieve.may_hold(F.col("doc"), F.col("line")))
    gone = gone.join(matched.withColumn("gone", F.lit(True)), ["doc", "line"], "left").where("copies > 1 OR gone")
    gone = stored(gone.select("s1", "s2", F.col("doc").alias("fdoc"), F.col("line").alias("fline"), F.coalesce("gone", F.lit(False)).alias("gone")), "gone")
    sieve = Sieve(gone, "s1", "s2")
    rows = lines.select("doc", "line", "s1", "s2").where(sieve.may_hold(F.col("s1"), F.col("s2"))).join(gone, ["s1", "s2"])
    return rows.where("gone OR doc <> fdoc OR line <> fline").select("doc", "line").distinct()


def without_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its own columns, the text without removed lines."""
    named = with_names(docs, text)
    lost = stored(removals(named).groupBy("doc").agg(F.collect_set("line").alias("lost")), "lost")
    sieve = Sieve(lost, "doc")
    rows = named.select("row", "doc")
    touched = sieve.may_hold(F.col("doc"))
    kept = rows.where(touched).join(lost, "doc", "left")
    cut = F.array_join(F.filter(F.split(F.col(f"row.`{text}`"), "\n"), lambda x, i: ~F.array_contains("lost", i)), "\n")
    kept = kept.withColumn("row", F.when(F.col("lost").isNull(), F.col("row")).otherwise(F.col("row").withField(f"`{text}`", cut)))
    return rows.where(~touched).select("row.*").unionByName(kept.select("row.*"))


def op5(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_kept, text) of every document; counts are of lines with a word."""
    filled = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", filled(F.col("text")).alias("n_lines"))
    return without_repeats(docs).select("doc_id", "n_lines", filled(F.col("text")).alias("n_kept"), "text")
