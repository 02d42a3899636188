"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, runs of white space and digits folded, trimmed) and hashed; for each
host (``source``) and line the distinct documents that hold it are counted. Copies must not make their
own text look like boilerplate, so documents of a host with the same set of lines count once. A line that
more than ``LIMIT`` of them hold is above the limit. Such lines are removed; a document that keeps under
``LEFT_PERCENT`` of its words is rejected as depleted.

A copy with a changed line is a document of its own: it can't be told from another page of the same template.

Null text has no words; a null source is a host of its own; null doc_ids and repeated rows pass through
as rows of their own; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.storage import fresh, let, materialise, maybe_broadcast, settled

LIMIT = 20
LEFT_PERCENT = 20
MIN_WORDS = 50
#: A list of rejected documents up to this many rows is broadcast, a longer one shuffled.
SIDE_ROWS = 500_000
MAX_REPEAT_PERCENT = 50
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """The words of a text; only the ends of a split can be empty."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def repeated_words(parts: Column) -> Column:
    """How many words stand in 3-word windows that the text has twice or more.

    Windows are compared by a 64-bit hash, sorted with their places; equal neighbours repeat.
    """

    def places(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
        hit = F.filter(F.sequence(F.lit(0), last), lambda i: ((i > 0) & same(i, i - 1)) | ((i < last) & same(i, i + 1)))
        return F.array_sort(F.transform(hit, lambda i: F.get(s, i)["at"]))

    def covered(at: Column) -> Column:
        # Each window adds what the one before it has not covered.
        start = F.struct(F.lit(-3).alias("before"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda a, p: F.struct(p.alias("before"), (a["n"] + F.least(F.lit(3), p - a["before"])).alias("n")), lambda a: a["n"])

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

        def sorted_places(h: Column) -> Column:
            pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(let(pairs, places), covered))

        return F.when(F.size(w) < 4, 0).otherwise(let(hashes, sorted_places))

    return of(parts)


def _lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def _normal(line: Column) -> Column:
    """Trimmed, lower case, white space folded to one space and digits to 0."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), SPACE + "+", " ")), "[0-9]+", "0")


def _hash(line: Column) -> Column:
    """60 bits of the MD5, which any SQL engine can repeat."""
    return F.conv(F.left(F.md5(line), F.lit(15)), 16, 10).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """One row for each input row, without its text, written to the shared folder.

    doc_id, source, row, the base counts, copy (a hash of the set of lines) and lines: (hash, words) of
    each line that has a word.
    """
    text = F.col("text")
    row = docs.select("doc_id", "source", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def of_words(w: Column) -> Column:
        chars = F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
        return F.struct(F.size(w).cast("long").alias("n_words"), chars.alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        dup = F.size(lines) - F.size(F.array_distinct(lines))
        each = F.transform(lines, lambda x: F.struct(_hash(_normal(x)).alias("h"), F.size(F.split(F.trim(F.regexp_replace(x, SPACE + "+", " ")), " ")).alias("n")))
        return F.struct(dup.cast("long").alias("n_dup_lines"), each.alias("lines"))

    symbols = F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))
    out = row.select(
        "doc_id",
        "source",
        F.monotonically_increasing_id().alias("row"),
        let(words(text), of_words).alias("w"),
        let(_lines(text), of_lines).alias("l"),
        F.when(text.rlike("[#*$%&|<>]"), symbols).otherwise(0).cast("long").alias("n_symbols"),
    )
    out = out.select("doc_id", "source", "row", "w.*", "n_symbols", "l.*")
    hashes = F.transform("lines", lambda x: x["h"])
    return materialise(out.withColumn("copy", F.xxhash64(F.array_sort(F.array_distinct(hashes)))), "quality")


def frequent_lines(measured: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(source, h) of the lines above the limit.

    Counts are combined before each shuffle, so a host or line that fills a third of the table is one
    partial row for each task.
    """
    held = measured.select("source", "copy", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")).distinct()
    return held.groupBy("source", "h").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > limit).select("source", "h")


def judge(docs: DataFrame, limit: int = LIMIT, left_percent: int = LEFT_PERCENT) -> DataFrame:
    """Base counts, words in removed lines, base_failed and kept for every row of ``docs``."""
    m = measure(docs)
    frequent = materialise(frequent_lines(m, limit), "quality-lines")
    # A line goes with all its occurrences; its words are summed per row first.
    line = m.select("row", "source", F.explode("lines").alias("x")).select("row", "source", "x.h", "x.n")
    f = frequent.select(F.col("source").alias("s"), F.col("h").alias("fh"))
    hit = line.join(f, F.col("source").eqNullSafe(F.col("s")) & (F.col("h") == F.col("fh")), "left_semi")
    removed = hit.groupBy("row").agg(F.sum("n").alias("removed_words"))
    n, r = F.col("n_words"), F.coalesce("removed_words", F.lit(0)).cast("long")
    base_failed = (n < MIN_WORDS) | (F.col("n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT)
    depleted = (n - r) * 100 < n * left_percent
    out = m.drop("lines", "copy").join(removed, "row", "left").withColumn("removed_words", r)
    return out.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & ~depleted)


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def passed(docs: DataFrame, limit: int = LIMIT, left_percent: int = LEFT_PERCENT) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    Rows with the same doc_id, source and text have one verdict; the rejected ones are taken out by these.
    """
    key = F.struct("doc_id", F.xxhash64("source", "text").alias("t"))
    named = docs.select(key.alias("doc_id"), "source", "text")
    (out,) = fresh(docs, "_out")
    rejected = settled(docs.sparkSession, lambda: judge(named, limit, left_percent).filter("not kept").select(F.col("doc_id").alias(out)).distinct(), "quality-rejected")
    rejected = maybe_broadcast(rejected, SIDE_ROWS)
    return docs.join(rejected, key == F.col(out), "left_anti")
