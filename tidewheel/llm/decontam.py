"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

The index holds postings (term, document, position) of the corpus for every term that the benchmark
uses; no other list is ever asked for. A test phrase is looked up from its rarest terms: the lists of its
rarest and next rarest term, each shifted by the term's offset, are intersected on (document, phrase,
start); the few survivors are checked against the lists of the remaining terms, again shifted. The same
lists answer proximity searches (``near``).

Words are letters, digits and all characters above ASCII after lower-casing A-Z. Null text has no words;
items without words match nothing; repeated rows and equal doc_ids are told apart by a hash of the
text; empty tables give empty or clean results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.storage import fresh, materialise, maybe_broadcast, settled

WINDOW = 10
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Test-side tables up to this many rows are broadcast, larger ones shuffled.
SIDE_ROWS = 500_000


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else. ``lower`` does that on pure ASCII and is faster there."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def doc_key() -> Column:
    """Two longs that tell rows apart; rows with the same doc_id and text are the same document."""
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"))


class Benchmark:
    """Terms and phrases of the test items.

    ``terms``: term, tid. ``slots``: item, start, size, o, tid: the phrase of ``size`` words at ``start``
    of the item has term ``tid`` at offset ``o``.
    """

    def __init__(self, items: DataFrame, window: int = WINDOW):
        # An item that stands twice is one item; one id with two texts has the phrases of both.
        w = items.select(F.col("item_id").alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0).distinct()
        w = w.withColumn("version", F.xxhash64("w"))
        place = w.select("item", "version", F.size("w").alias("n"), F.posexplode("w").alias("pos", "term"))
        terms = place.select("term").distinct()
        self.terms = materialise(terms.withColumn("tid", F.monotonically_increasing_id()), "leaks-terms")
        place = place.join(self.terms, "term").withColumn("size", F.least(F.lit(window), "n"))
        starts = F.sequence(F.greatest(F.lit(0), F.col("pos") - F.col("size") + 1), F.least("pos", F.col("n") - F.col("size")))
        slots = place.select("item", "version", "size", "pos", "tid", F.explode(starts).alias("start"))
        self.slots = materialise(slots.select("item", "version", "start", "size", (F.col("pos") - F.col("start")).alias("o"), "tid"), "leaks-slots")


def build_index(docs: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings (tid, d, pos) and the documents' (d, doc_id, n_words), both in the shared folder.

    One pass over the texts; no shuffle: a task writes the postings of the rows that it reads.
    """
    w = docs.select(doc_key().alias("d"), words(F.col("text")).alias("w"))
    # The word before the first carries the count, so that one scan writes both in one table; no sort by kind is needed.
    flat = w.select("d", F.posexplode(F.concat(F.array(F.concat(F.lit("\n"), F.size("w").cast("string"))), "w")).alias("pos", "term"))
    listed = flat.join(maybe_broadcast(terms, SIDE_ROWS), "term", "left").filter(F.col("tid").isNotNull() | (F.col("pos") == 0))
    size = F.when(F.col("pos") == 0, F.substring("term", 2, 20).cast("long"))
    out = listed.select("tid", F.col("d.id").alias("id"), F.col("d.t").alias("t"), (F.col("pos") - 1).alias("pos"), size.alias("n_words"))
    both = materialise(out, "leaks-index")
    return both.filter("pos >= 0").select("tid", "id", "t", "pos"), both.filter("pos < 0").select("id", "t", "n_words")


def occurrences(index: DataFrame, bench: Benchmark) -> DataFrame:
    """(id, t, item, at, size): every exact occurrence of a phrase, at word ``at`` of a document."""
    counts = materialise(index.groupBy("tid").count(), "leaks-counts")
    rare = Window.partitionBy("item", "version", "start").orderBy(F.coalesce("count", F.lit(0)), "o")
    ranked = bench.slots.join(counts, "tid", "left").withColumn("rank", F.row_number().over(rare))
    # A phrase with a term that the corpus lacks occurs nowhere.
    whole = Window.partitionBy("item", "version", "start")
    ranked = ranked.withColumn("least", F.min(F.coalesce("count", F.lit(0))).over(whole)).filter("least > 0")
    ranked = materialise(ranked.drop("count", "least"), "leaks-ranked")

    doc = ["id", "t"]
    phrase = ["item", "version", "start", "size"]

    def shifted(rank: int) -> DataFrame:
        """The list of each phrase's rank-th rarest term as the starts that it allows."""
        keys = maybe_broadcast(ranked.filter(F.col("rank") == rank).drop("rank"), SIDE_ROWS)
        return index.join(keys, "tid").select(*doc, *phrase, (F.col("pos") - F.col("o")).alias("at")).filter("at >= 0")

    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("id", "item")] + [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("t", "version", "start", "at")]
    first, second = shifted(1), shifted(2)
    met = first.alias("a").join(second.alias("b"), same, "left_semi")
    met = first.filter("size = 1").unionByName(met.filter("size > 1"))
    met = materialise(met.distinct(), "leaks-met")

    # The rest of each phrase, from the lists of the documents that are still in.
    held = maybe_broadcast(materialise(met.select(F.col("id").alias("mid"), F.col("t").alias("mt")).distinct(), "leaks-docs"), SIDE_ROWS)
    lists = index.join(held, F.col("id").eqNullSafe(F.col("mid")) & (F.col("t") == F.col("mt")), "left_semi").distinct()
    rest = maybe_broadcast(ranked.filter("rank > 2").select("item", "version", "start", "o", "tid"), SIDE_ROWS)
    on = [F.col("m.item").eqNullSafe(F.col("r.item")), F.col("m.version") == F.col("r.version"), F.col("m.start") == F.col("r.start")]
    asked = met.alias("m").join(rest.alias("r"), on).select("m.*", "r.tid", (F.col("at") + F.col("o")).alias("pos"))
    at = [F.col("q.id").eqNullSafe(F.col("l.id"))] + [F.col(f"q.{c}") == F.col(f"l.{c}") for c in ("t", "tid", "pos")]
    found = asked.alias("q").join(lists.alias("l"), at, "left_semi")
    full = found.groupBy(*doc, "item", "version", "start", "size", "at").agg(F.count(F.lit(1)).alias("n")).filter("n = size - 2").drop("n")
    short = met.filter("size <= 2").select(*full.columns)
    return full.unionByName(short).select(*doc, "item", "at", "size")


def near(index: DataFrame, phrases: DataFrame, within: int) -> DataFrame:
    """Proximity matches: documents that hold all terms of a phrase inside ``within`` words.

    ``phrases``: item, tid (a term of the benchmark), one row each. Gives (id, t, item, at): the first
    word of a run of at most ``within`` words with every term. Runs start at one of the terms, so only
    postings inside the next ``within`` words of a posting are met.
    """
    need = phrases.distinct().groupBy("item").agg(F.count(F.lit(1)).alias("need"))
    p = index.join(maybe_broadcast(phrases.distinct(), SIDE_ROWS), "tid").select("item", "tid", "id", "t", "pos")
    w = Window.partitionBy("item", "id", "t").orderBy("pos").rangeBetween(0, within - 1)
    p = p.withColumn("met", F.size(F.collect_set("tid").over(w)))
    return p.join(need, "item").filter("met = need").select("id", "t", "item", F.col("pos").alias("at")).distinct()


def search(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The occurrences and the documents' (id, t, n_words)."""
    bench = Benchmark(items, window)
    index, heads = build_index(docs, bench.terms)
    return occurrences(index, bench), heads


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``."""
    found, heads = search(docs, items, window)
    found = materialise(found, "leaks-found")
    word = found.select("id", "t", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("p")).distinct()
    hits = word.groupBy("id", "t").agg(F.count(F.lit(1)).alias("n_hit"))
    names = found.select("id", "t", F.col("item").cast("string").alias("item")).distinct()
    names = names.groupBy("id", "t").agg(F.array_sort(F.collect_list("item")).alias("names"))  # as many as there are items
    held = materialise(hits.join(names, (hits["id"].eqNullSafe(names["id"])) & (hits["t"] == names["t"])).select(hits["id"].alias("hid"), hits["t"].alias("ht"), "n_hit", "names"), "leaks-hits")
    out = heads.join(held, F.col("id").eqNullSafe(F.col("hid")) & (F.col("t") == F.col("ht")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    names = F.coalesce("names", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.col("t").alias("text_hash"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any occurrence, with all their columns."""
    i, t = fresh(docs, "bad_id", "bad_text")
    bad = settled(docs.sparkSession, lambda: search(docs, items, window)[0].select(F.col("id").alias(i), F.col("t").alias(t)).distinct(), "leaks-bad")
    bad = maybe_broadcast(bad, SIDE_ROWS)
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(t)), "left_anti")
