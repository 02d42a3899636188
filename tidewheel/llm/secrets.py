"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger, two Parquet tables in
one folder, remembers which (blob, rule, rule version) pairs were scanned and what was found. An update
scans each unseen blob once for the rules that it has not met, appends, and joins the findings of all
blobs back to every path that holds them. Findings are appended before the scan marks, so a broken
update is repeated and its double rows fall to ``distinct``.

Null text is the empty blob; null paths and repeated rows stay one row each; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import spans as S
from tidewheel.llm.storage import exists, materialise, new_folder


@dataclass(frozen=True)
class Rule:
    """``pattern`` with an optional cheap condition; a match counts if ``group`` has ``least`` characters."""

    name: str
    pattern: str
    where: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def tag(self) -> str:
        return f"{self.name}@{self.version}"


BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?i:password|passwd|secret|token|api_?key)", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}+", "AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]{24,}+", "[0-9a-f]{24}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:(?!PRIVATE KEY)[A-Z]++ )*+PRIVATE KEY-----", "PRIVATE KEY-----", version=2),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", r"eyJ[A-Za-z0-9_-]{8}"),
    Rule("forge_token", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}+", "gh[pousr]_"),
    Rule("chat_token", r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+", "xox[abprs]-"),
    Rule("url_login", r"(?<=://)[A-Za-z0-9._-]++:[^\s:@/]{3,}+@", "://[^/]*@", version=2),
)
RULES = BASE_RULES + MORE_RULES


def scan(text: Column, rule: Rule) -> Column:
    """Spans of one rule in a text."""
    found = S.matches(text, rule.pattern, text.rlike(rule.where), 0)
    if not rule.group:
        return found
    sizes = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length)
    long_enough = F.filter(F.arrays_zip(found.alias("s"), sizes.alias("n")), lambda z: z["n"] >= rule.least)
    return F.when(text.rlike(rule.where), F.transform(long_enough, lambda z: z["s"])).otherwise(S.none())


def _hits(rule: Rule) -> Column:
    """Spans of a rule that is due, with its tag and name."""
    none = F.array().cast("array<struct<tag:string,kind:string,start:int,end:int>>")
    tag, kind = F.lit(rule.tag).alias("tag"), F.lit(rule.name).alias("kind")
    found = F.transform(scan(F.col("text"), rule), lambda s: F.struct(tag, kind, s["start"].alias("start"), s["end"].alias("end")))
    return F.when(F.array_contains("due", rule.tag), found).otherwise(none)


class Ledger:
    """The ledger in ``folder``; made by the first update."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", "blob string, tag string").distinct()

    def findings(self) -> DataFrame:
        return self._read("findings", "blob string, tag string, kind string, start int, `end` int").distinct()

    def update(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan what is new in ``versions`` (path, text); give (path, blob, spans) for every row.

        ``spans`` holds (start, rank, end) by start, then rank: the place in ``rules``.
        """
        named = versions.select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
        paths = named.select("path", "blob")
        tags = F.array(*[F.lit(r.tag) for r in rules])
        met = self.scanned().groupBy("blob").agg(F.collect_set("tag").alias("met"))  # as many as there are rules
        # One holder's text stands for the blob; of rows with the same path and blob all have this text.
        holder = paths.groupBy("blob").agg(F.min("path").alias("holder"))
        todo = holder.join(met, "blob", "left").withColumn("due", F.array_except(tags, F.coalesce("met", F.array().cast("array<string>"))))
        todo = materialise(todo.filter(F.size("due") > 0).select("blob", "holder", "due"), "secrets-due")
        at = (F.col("n.blob") == F.col("t.blob")) & F.col("n.path").eqNullSafe(F.col("t.holder"))
        due = named.alias("n").join(todo.hint("shuffle_hash").alias("t"), at).select("t.blob", "n.text", "t.due")
        hits = F.concat(*[_hits(r) for r in rules])
        new = due.select("blob", F.explode(hits).alias("h")).select("blob", "h.*")
        new.write.mode("append").parquet(f"{self.folder}/findings")
        todo.select("blob", F.explode("due").alias("tag")).write.mode("append").parquet(f"{self.folder}/scanned")
        return self.join_back(paths, rules)

    def join_back(self, paths: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Findings of the current rule versions joined to all (path, blob) rows."""
        rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.tag), F.lit(i))])
        found = self.findings().withColumn("rank", rank[F.col("tag")]).filter(F.col("rank").isNotNull())
        found = found.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).alias("spans"))  # one text's
        spans = F.coalesce("spans", F.array().cast("array<struct<start:int,rank:int,end:int>>"))
        return paths.join(found, "blob", "left").select("path", "blob", spans.alias("spans"))


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The contract's columns from ``update``."""
    names = [r.name for r in rules]
    n = len(BASE_RULES)
    base = F.filter("spans", lambda s: s["rank"] < n)
    count = lambda i: F.size(F.filter("spans", lambda s: s["rank"] == i)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"),
        *[count(i).alias(f"n_{r.name}") for i, r in enumerate(BASE_RULES)],
        F.sha2(S.written(base, names), 256).alias("base_sha256"),
        S.written(F.col("spans"), names).alias("spans"),
    )


def scan_documents(docs: DataFrame) -> DataFrame:
    """A fresh ledger over documents, each one version of the path ``doc_id``."""
    spark = docs.sparkSession
    return digest(Ledger(spark, new_folder(spark, "secrets")).update(docs.select(F.col("doc_id").alias("path"), "text")))
