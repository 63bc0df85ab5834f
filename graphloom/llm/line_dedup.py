"""Deleting repeated runs of lines, found by winnowing, in DataFrame operations only.

Lines without a word are not compared. A gram is the shortest run of lines
from a line on that has GRAM words; the reach of a line is the shortest run
from it that has RUN words. The fingerprint of a line is the least gram hash
within its reach. Any run of RUN words holds the reach of its first line, so
two equal runs share a fingerprint whatever surrounds them.

Cut are the lines of reaches that occur earlier, by the hash of the whole
reach, and around each fingerprint that occurs earlier the run of lines that
equal those around its first occurrence, followed RUN words each way: what
goes on further holds whole reaches. So each match is compared with a bounded
stretch of one other text, however often a passage repeats in a text or in the
corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, temporary_tables, text_or_empty

RUN = 50
GRAM = 25


def _line_arrays(docs: DataFrame) -> DataFrame:
    """doc_id, tx and arrays over the lines with words: hash, words, place among all lines."""
    lines = F.transform(F.split("text", "\n"), lambda l, i: F.struct(l.alias("l"), F.regexp_count(l, F.lit(WORD)).alias("w"), i.alias("i")))
    rows = docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", F.xxhash64("text").alias("tx"), F.filter(lines, lambda x: x.w > 0).alias("x"))
    return rows.select("doc_id", "tx", F.transform("x", lambda x: F.xxhash64(x.l)).alias("hs"), F.transform("x", lambda x: x.w).alias("ws"), F.transform("x", lambda x: x.i).alias("places"))


def reaches(arrays: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """The lines with a reach: doc_id, tx, p (place among lines with words, from 1), a and b (places of its first and last line among all lines), whole (hash of the reach), g (least gram: fp, p)."""
    line = arrays.select("doc_id", "tx", F.posexplode(F.arrays_zip("hs", "ws", "places")).alias("q", "x")).select("doc_id", "tx", (F.col("q") + 1).alias("p"), "x.hs", "x.ws", "x.places")
    doc = Window.partitionBy("doc_id", "tx").orderBy("p")
    line = line.withColumn("start", F.sum("ws").over(doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("ws"))
    of = Window.partitionBy("doc_id", "tx").orderBy("start")
    lines = F.collect_list(F.struct("hs", "ws", "places", "start"))
    line = line.withColumns({"reach": lines.over(of.rangeBetween(0, run - 1)), "gram": lines.over(of.rangeBetween(0, gram - 1))})

    def words(x: str) -> Column:
        last = F.element_at(x, -1)
        return last.start + last.ws - F.col("start")

    fp = F.when(words("gram") >= gram, F.xxhash64("gram.hs"))
    line = line.select("doc_id", "tx", "p", "places", "start", "reach", fp.alias("fp"), F.element_at("gram", -1).start.alias("last"))
    line = line.withColumn("grams", F.collect_list(F.struct("fp", "p", "last")).over(of.rangeBetween(0, run - 1)))
    least = F.array_min(F.filter("grams", lambda g: g.fp.isNotNull() & (g["last"] < F.col("start") + run)))
    return line.where(words("reach") >= run).select("doc_id", "tx", "p", F.col("places").alias("a"), F.element_at("reach", -1).places.alias("b"), F.xxhash64("reach.hs").alias("whole"), least.alias("g"))


def _later(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The rows (doc_id, tx, p, ...) with the first of their key, without those that are it."""
    first = rows.groupBy(key).agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tx", "p")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = materialize(first, name)  # a join with an aggregate could not split a key that many documents share
    return rows.join(first, key).where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tx") == F.col("first.tx")) & (F.col("p") == F.col("first.p"))))


def _around(arrays: DataFrame, spots: DataFrame, run: int) -> DataFrame:
    """spots (doc_id, tx, p, fp, is_first) -> also the lines that begin less than ``run`` words after p begins (after), and up to ``run`` words before (before, the nearest last).

    Spots are laid beside the lines of their text, which the windows read as rows of a line each.
    """
    by_text = spots.groupBy(F.col("doc_id").alias("d"), F.col("tx").alias("t")).agg(F.array_sort(F.collect_list(F.struct("p", "fp", "is_first"))).alias("spots"))
    met = arrays.join(by_text, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tx") == F.col("t")))
    last = F.concat(F.transform(F.slice("spots", 1, 1), lambda s: F.lit(0)), F.transform("spots", lambda s: s.p))
    none = F.lit(None).cast("struct<p: int, fp: bigint, is_first: boolean>")
    beside = F.flatten(F.zip_with("spots", F.slice(last, F.lit(1), F.size("spots")), lambda s, o: F.concat(F.array_repeat(none, s.p - o - 1), F.array(s))))
    line = met.select("doc_id", "tx", F.posexplode(F.arrays_zip("hs", "ws", "places", beside.alias("spot"))).alias("q", "x")).select("doc_id", "tx", "q", "x.*")
    doc = Window.partitionBy("doc_id", "tx").orderBy("q")
    line = line.withColumn("start", F.sum("ws").over(doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("ws"))
    lines, of = F.collect_list(F.struct("hs", "places")), Window.partitionBy("doc_id", "tx").orderBy("start")
    line = line.withColumns({"after": lines.over(of.rangeBetween(0, run - 1)), "before": lines.over(of.rangeBetween(-run, -1))})
    return line.where(F.col("spot").isNotNull()).select("doc_id", "tx", "spot.*", "after", "before")


def _equal(mine: Column | str, theirs: Column | str) -> Column:
    """How many lines are equal from the first on."""
    same = F.zip_with(mine, theirs, lambda x, y: F.coalesce(x.hs == y.hs, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same)).cast("int")


def repeated_runs(docs: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """doc_id, tx, cuts: the disjoint rising runs of lines (a to b; places among all lines) that occur earlier, by (doc_id, tx, place)."""
    with temporary_tables(docs.sparkSession):
        arrays = materialize(_line_arrays(docs).dropDuplicates(["doc_id", "tx"]), "line-arrays")
        reach = materialize(reaches(arrays, run, gram), "line-reaches")
        chosen = materialize(reach.select("doc_id", "tx", F.col("g.p").alias("p"), F.col("g.fp").alias("fp")).distinct(), "line-fingerprints")
        met = materialize(_later(chosen, "fp", "first-fingerprints"), "repeated-fingerprints")
        firsts = met.select("first.doc_id", "first.tx", "first.p", "fp").distinct()
        spots = met.select("doc_id", "tx", "p", "fp", F.lit(False).alias("is_first")).union(firsts.withColumn("is_first", F.lit(True)))
        around = materialize(_around(arrays, spots, run), "contexts")
        theirs = around.where("is_first").select("fp", F.col("after").alias("after0"), F.col("before").alias("before0"))
        matched = around.where("NOT is_first").join(theirs, "fp").withColumn("on", _equal("after", "after0")).withColumn("back", _equal(F.reverse("before"), F.reverse("before0")))
        matched = matched.where("on > 0").select(
            "doc_id", "tx",
            F.when(F.col("back") > 0, F.element_at("before", -F.col("back")).places).otherwise(F.get("after", F.lit(0)).places).alias("a"),
            F.get("after", F.col("on") - 1).places.alias("b"),
        )
        again = _later(reach.select("doc_id", "tx", "p", "a", "b", "whole"), "whole", "first-reaches").select("doc_id", "tx", "a", "b")
        rows = matched.union(again)
        upto = F.max("b").over(Window.partitionBy("doc_id", "tx").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("new", F.coalesce(F.col("a") > upto + 1, F.lit(True)).cast("int"))
        rows = rows.withColumn("k", F.sum("new").over(Window.partitionBy("doc_id", "tx").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        runs = rows.groupBy("doc_id", "tx", "k").agg(F.min("a").alias("a"), F.max("b").alias("b"))
        return materialize(runs.groupBy("doc_id", "tx").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("cuts")), "line-cuts", outlives=True)


def _cut(docs: DataFrame, run: int, gram: int) -> DataFrame:
    """r (the row of docs), text without its cuts, lines and cut (how many there were and went)."""
    cuts = repeated_runs(docs, run, gram).select(F.col("doc_id").alias("d"), F.col("tx").alias("t"), "cuts")
    rows = docs.select(F.struct("*").alias("r")).select("r", F.xxhash64(F.coalesce("r.text", F.lit(""))).alias("x"))
    met = rows.hint("merge").join(cuts, F.col("r.doc_id").eqNullSafe(F.col("d")) & (F.col("x") == F.col("t")), "left")
    # from the end of the cut before: lines that stay, then lines that go; those after the last cut stay
    gone = F.flatten(F.zip_with("cuts", F.slice(F.concat(F.array(F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"))), F.col("cuts")), F.lit(1), F.size("cuts")), lambda c, o: F.concat(F.array_repeat(F.lit(False), c.a - o.b - 1), F.array_repeat(F.lit(True), c.b - c.a + 1))))
    lines = F.split("r.text", "\n")
    kept = F.transform(F.filter(F.zip_with(lines, gone, lambda l, g: F.struct(l.alias("l"), g.alias("g"))), lambda x: ~F.coalesce(x.g, F.lit(False))), lambda x: x.l)
    met = met.select("r", F.when(F.col("r.text").isNull(), 0).otherwise(F.size(lines)).alias("lines"), F.when(F.col("cuts").isNotNull(), kept).alias("kept"))
    text = F.when(F.col("kept").isNull(), F.col("r.text")).otherwise(F.array_join("kept", "\n"))
    return met.select("r", text.alias("text"), "lines", F.when(F.col("kept").isNull(), 0).otherwise(F.col("lines") - F.size("kept")).alias("cut"))


def dedup_lines(docs: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """The rows of docs with later repeated runs of lines taken out of text.

    Every row stays, also if nothing is left of its text; null texts stay null;
    the order of documents is that of doc_id, null last, then of a hash of the
    text; rows that share both count as one document and all get its result;
    other columns, whatever their names, are unchanged. A text of very many
    lines, or one line repeated throughout, costs time in proportion to its
    lines; its lines are handled by one task. No rows give no rows.
    """
    found = _cut(docs, run, gram)
    return found.select(*(F.col("text") if c == "text" else F.col("r").getField(c).alias(c) for c in docs.columns))


def digest(docs: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that is left, of every row."""
    return _cut(docs, run, gram).select("r.doc_id", F.col("lines").cast("long").alias("n_lines"), F.col("cut").cast("long").alias("n_removed"), "text")
