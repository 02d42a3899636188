"""Personal data by weak supervision, in DataFrame functions only.

Base rules find e-mail, IP, card and phone spans; looser rules propose further candidates. A regex, a
gazetteer and a context labeler each vote yes, no or abstain on every candidate; the context is 48 code points
on each side, cut at the next match of the same kind. Expectation
maximisation over the counts of vote patterns estimates each labeler's reliability and a prior for each
kind; its posteriors train a naive Bayes span classifier, which decides the added spans. Base spans
always stay.

What reaches the driver is the table of pattern counts: at most 7 kinds x 27 votes x 12 shapes, however
large the input. Null text counts as empty; a null ``doc_id`` and repeated rows pass through; an empty
table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import spans as S
from tidewheel.llm.storage import let, materialise

BASE = ["email", "ip", "card", "phone"]
ADDED = ["local_phone", "national_id", "veiled_email"]
KINDS = BASE + ADDED

# A start inside a run of its own characters can only repeat the failure at the run's start, so matches
# begin at a run's start or where the last match ended (\G). Possessive loops keep Java off its stack.
_LOCAL = r"A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOCAL_PHONE = r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9.-])"
NATIONAL_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
VEILED = rf"(?<![{_LOCAL}])[{_LOCAL}]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]++)++"

# The gazetteer. Endings of names of hosts, issuer prefixes of cards, country calling codes (of those with
# three digits the first two), networks that are never a person's, service numbers that are no area.
ENDINGS = "com net org edu gov mil int info biz name io me co dev app de fr es it uk eu nl ch at be pl pt se no dk fi ie cz gr hu ro ru ua tr ca us mx br ar cl au nz jp cn in kr za".split()
ISSUERS = "4 34 35 36 37 38 51 52 53 54 55 22 23 24 25 26 27 60 62 64 65".split()
CALLING = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 "
    "21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99"
).split()
NETWORKS = "0 10 127 255 169.254 192.168".split()
SERVICES = "211 311 411 511 611 711 811 911".split()
NO_AREA = "000 666".split()


def listed(kind: str, hit: Column) -> Column:
    """Whether the gazetteer speaks for a candidate of this kind."""
    d = S.digits(hit)
    key = lambda pattern: F.lower(F.regexp_extract(hit, pattern, 1))
    return {
        "email": key(r"\.([A-Za-z]+)$").isin(ENDINGS),
        "veiled_email": key(r"([A-Za-z]+)$").isin(ENDINGS),
        "ip": ~key(r"^([0-9]+)\.").isin(NETWORKS) & ~key(r"^([0-9]+\.[0-9]+)\.").isin(NETWORKS),
        "card": F.left(d, F.lit(1)).isin(ISSUERS) | F.left(d, F.lit(2)).isin(ISSUERS),
        "phone": F.left(d, F.lit(1)).isin(CALLING) | F.left(d, F.lit(2)).isin(CALLING),
        "local_phone": ~F.left(d, F.lit(1)).isin("0", "1") & ~F.left(d, F.lit(3)).isin(SERVICES),
        "national_id": ~F.left(d, F.lit(3)).isin(NO_AREA) & (F.left(d, F.lit(1)) != "9"),
    }[kind]


CUES = {
    "email": r"(?i)mail|contact|write|@",
    "ip": r"(?i)\bip\b|address|server|host|login|from",
    "card": r"(?i)card|visa|credit|payment|account|amex",
    "phone": r"(?i)phone|tel|call|mobile|fax|cell",
    "local_phone": r"(?i)phone|tel|call|mobile|fax|cell|contact",
    "national_id": r"(?i)ssn|social|security|national",
    "veiled_email": r"(?i)mail|contact|write",
}
AGAINST = r"(?i)order|version|isbn|invoice|part|serial|section|sku|build"


def _keep(spans: Column, kind: str) -> Column:
    """The checks after a base pattern; a failing match is dropped, without a retry."""

    def good(s: Column) -> Column:
        if kind == "ip":
            # Over three digits without leading zeros is over 255 whatever its size.
            parts = F.transform(F.split(s["hit"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
            return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.left(p, F.lit(3)).cast("int") <= 255))
        n = F.length(S.digits(s["hit"]))
        if kind == "card":
            return F.when(n.between(16, 19), S.luhn(s["hit"])).otherwise(False)
        return n.between(8, 15)

    return F.filter(spans, good)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and one array of spans for each kind, written to the shared folder."""
    text = F.col("text")
    digit = text.rlike("[0-9]")
    found = {
        "email": S.matches(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": _keep(S.matches(text, IP, digit & F.contains(text, F.lit("."))), "ip"),
        "card": _keep(S.matches(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")), "card"),
        "phone": _keep(S.matches(text, PHONE, F.contains(text, F.lit("+"))), "phone"),
        "local_phone": S.matches(text, LOCAL_PHONE, text.rlike("[0-9]{3}[.-][0-9]{4}")),
        "national_id": S.matches(text, NATIONAL_ID, text.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}")),
        "veiled_email": S.matches(text, VEILED, text.rlike(r"[\[(](at|AT)[\])]")),
    }
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return materialise(rows.select("doc_id", *[v.alias(k) for k, v in found.items()]), "pii-spans")


def _vote(kind: Column, span: Column) -> Column:
    """Votes of the three labelers as a number 0..26, base 3: 0 no, 1 abstain, 2 yes."""

    def by_kind(table: dict[str, str], value: Column, miss: int) -> Column:
        out = F.lit(1)
        for i, k in enumerate(KINDS):
            out = F.when(kind == i, F.when(value.rlike(table[k]), 2).otherwise(miss)).otherwise(out)
        return out

    strict = {**dict.fromkeys(BASE, "."), "local_phone": r"^\(?[2-9][0-9]{2}\)?[ .-][2-9]", "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)", "veiled_email": "."}
    regex = by_kind(strict, span["hit"], 0)
    names = F.lit(1)
    for i, k in enumerate(KINDS):
        names = F.when(kind == i, F.when(listed(k, span["hit"]), 2).otherwise(0)).otherwise(names)
    around = F.concat_ws(" ", span["before"], span["after"])
    cue = F.when(span["before"].rlike(AGAINST), 0).otherwise(by_kind(CUES, around, 1))
    return regex * 9 + names * 3 + cue


def _shape(span: Column) -> Column:
    """A number 0..11 for length and share of digits."""
    n, d = F.length(span["hit"]), F.length(S.digits(span["hit"]))
    size = F.when(n < 10, 0).when(n < 14, 1).when(n < 20, 2).otherwise(3)
    return size * 3 + F.when(d * 3 < n, 0).when(d * 3 < n * 2, 1).otherwise(2)


def _voted(found: DataFrame) -> DataFrame:
    """All candidates of a row in one array, with vote and shape; added ones that overlap a base span go."""

    def tag(k: str) -> Column:
        def one(s: Column) -> Column:
            rank = F.lit(KINDS.index(k))
            return F.struct(rank.alias("rank"), s["start"].alias("start"), s["end"].alias("end"), _vote(rank, s).alias("vote"), _shape(s).alias("shape"))

        return F.transform(F.col(k), one)

    base = F.concat(*[tag(k) for k in BASE])
    more = F.concat(*[tag(k) for k in ADDED])

    def apart(b: Column) -> Column:
        return F.filter(more, lambda m: ~F.exists(b, lambda x: (x["start"] < m["end"]) & (m["start"] < x["end"])))

    return found.select("doc_id", base.alias("base"), let(base, apart).alias("more"))


def fit(counts: list[tuple[int, int, int, int]], rounds: int = 40) -> dict[tuple, float]:
    """Log-odds terms of the span classifier from (kind, vote, shape, count) rows.

    EM with three categories for each labeler and a prior for each kind; then naive Bayes over kind,
    the three votes and the shape, with the posteriors as soft labels and one pseudo-count each.
    """
    votes = lambda v: (v // 9, v // 3 % 3, v % 3)
    post = {(k, v): min(0.95, max(0.05, sum(votes(v)) / 6)) for k, v, _, _ in counts}
    weight: dict[tuple[int, int], float] = defaultdict(float)
    for k, v, _, n in counts:
        weight[k, v] += n
    for _ in range(rounds):
        prior = defaultdict(lambda: [1.0, 1.0])
        table = defaultdict(lambda: [0.5, 0.5])
        for (k, v), n in weight.items():
            for y, p in enumerate((1 - post[k, v], post[k, v])):
                prior[k][y] += n * p
                for j, c in enumerate(votes(v)):
                    table[j, c][y] += n * p
        total = {j: [sum(table[j, c][y] for c in range(3)) for y in (0, 1)] for j in range(3)}
        for k, v in weight:
            odds = math.log(prior[k][1] / prior[k][0])
            for j, c in enumerate(votes(v)):
                odds += math.log(table[j, c][1] / total[j][1]) - math.log(table[j, c][0] / total[j][0])
            post[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    seen: dict[tuple, list[float]] = defaultdict(lambda: [1.0, 1.0])
    for k, v, s, n in counts:
        for key in (("kind", k), ("shape", s), *((f"vote{j}", c) for j, c in enumerate(votes(v)))):
            for y, p in enumerate((1 - post[k, v], post[k, v])):
                seen[key][y] += n * p
    total_y = [2.0 + sum(n * (post[k, v] if y else 1 - post[k, v]) for k, v, _, n in counts) for y in (0, 1)]
    terms = {key: math.log(b / total_y[1]) - math.log(a / total_y[0]) for key, (a, b) in seen.items()}
    return terms | {("bias", 0): math.log(total_y[1] / total_y[0])}


def _odds(x: Column, terms: dict[tuple, float]) -> Column:
    def of(name: str, value: Column) -> Column:
        out = F.lit(0.0)
        for (n, v), t in sorted(terms.items()):
            if n == name:
                out = F.when(value == v, F.lit(t)).otherwise(out)
        return out

    vote = x["vote"]
    parts = [("kind", x["rank"]), ("shape", x["shape"]), ("vote0", F.floor(vote / 9)), ("vote1", F.floor(vote / 3) % 3), ("vote2", vote % 3)]
    return sum((of(n, v) for n, v in parts), F.lit(float(terms.get(("bias", 0), 0.0))))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and more: arrays of (rank, start, end, vote, shape), added spans as classified.

    ``rank`` indexes ``KINDS``; offsets are code points, the end exclusive. One row for each input row.
    """
    voted = _voted(candidates(docs))
    each = voted.select(F.explode(F.concat("base", "more")).alias("x")).select("x.*")
    rows = each.groupBy("rank", "vote", "shape").count().collect()  # at most 7 x 27 x 12
    terms = fit([(r["rank"], r["vote"], r["shape"], r["count"]) for r in rows])
    return voted.withColumn("more", F.filter("more", lambda x: _odds(x, terms) > 0))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``find``."""
    plain = lambda a: F.transform(a, lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end")))
    count = lambda i: F.size(F.filter("base", lambda s: s["rank"] == i)).cast("long")
    base, every = F.array_sort(plain(F.col("base"))), F.array_sort(plain(F.concat("base", "more")))
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(S.written(base, KINDS), 256).alias("base_sha256"),
        S.written(every, KINDS).alias("spans"),
    )
