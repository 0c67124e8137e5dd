"""Personal data: labelers vote on spans, expectation-maximisation weighs them, a classifier decides.

Base spans (email, ip, card, phone) are found by fixed patterns and always stay. Looser patterns
propose further candidates, such as a card number that a phone number before it swallowed. On
every candidate of the corpus four labelers vote for, against or not at all: a checker of the
format, a gazetteer (top-level domains, issuers, calling codes, reserved networks), the words in
front, and the grouping. Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is per kind, and so how likely each pattern is to be personal data. These
likelihoods train the final classifier, an additive logistic model over the features of a span;
candidates it is sure of are added where they touch no base span.

Built-in functions only: texts are read once, and only counts per pattern (a bounded number)
reach the driver. Positions count code points, ends are exclusive. A null text is empty.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

KINDS = ["email", "ip", "card", "phone"]
SURE = 0.9
ROUNDS, STEPS, RATE = 40, 300, 0.5
CONTEXT = 40
_MARK, _STAND_IN = "\x01", "\x02"

# What each kind looks like (possessive, so that long runs take linear time).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?=(?:[\x20-]?[0-9]){14,19}+(?![\x20-]?[0-9]))[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Where a text may hold the kind at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]++ ?(?:\[dot\]|\(dot\)|\{dot\}|\.) ?[A-Za-z]{2,}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+])(?:(?:\+|00)[1-9][0-9]{0,2}[\x20.-]?)?(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
LOOSE_NEEDS = {"email": r"(?i)[\[({]at[\])}]", "ip": NEEDS["ip"], "card": r"[0-9]{13}|[0-9]{4}[\x20-][0-9]{4}", "phone": r"[0-9]{3}[\x20.-][0-9]{4}"}
_OCTET = r"(?:0++(?![0-9])|0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?))"
IP = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

# The gazetteers and the words of the context labeler.
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|it|nl|eu|uk|us|ca|ch|at|be|pl|se|br|mx|in|jp|cn|ru|au)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[4-9]|6)"
CALLING_CODES = r"^(?:\+|00)(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
RESERVED = r"^(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
WORDS = {
    "email": r"(?:mail|contact|write to|courriel|correo|schreib)",
    "ip": r"(?:\bip\b|address|host|server|client|from|adresse|dirección)",
    "card": r"(?:card|visa|master|credit|debit|payment|paid|carte|karte|tarjeta)",
    "phone": r"(?:tel|phone|call|fax|mobile|cell|handy|móvil|ruf)",
}
AGAINST = r"(?:version|build|isbn|order|invoice|serial|article|section|ticket|ref)\W*$"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit fits: every second digit from the right is doubled."""

    def add(total: Column, digit: Column, at: Column) -> Column:
        twice = digit * 2
        return total + F.when(at % 2 == 0, digit).when(twice > 9, twice - 9).otherwise(twice)

    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.struct(d.cast("int").alias("d"), i.alias("i")))
    return F.aggregate(F.filter(each, lambda x: x.d.isNotNull()), F.lit(0), lambda t, x: add(t, x.d, x.i)) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return found.rlike(IP)
    size = F.length(_digits(found))
    if kind == "card":
        return size.between(14, 19) & _luhn(_digits(found))
    return size.between(10, 15)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, found: Column, before: Column, base: bool) -> list[Column]:
    """Format, gazetteer, context and grouping: 1 for, -1 against, 0 no vote."""
    valid = _valid(kind, found)
    near = F.lower(before)
    context = _vote(near.rlike(WORDS[kind]), near.rlike(AGAINST))
    if kind == "email":
        strict = F.lit(1 if base else 0)
        known, grouped = _vote(found.rlike(DOMAINS), ~found.rlike(DOMAINS)), _vote(found.rlike(r"^[A-Za-z0-9]"), found.rlike(r"^[^A-Za-z0-9]"))
    elif kind == "ip":
        strict = _vote(valid, ~valid)
        known, grouped = _vote(~found.rlike(RESERVED), found.rlike(RESERVED)), _vote(~found.rlike(r"(?:^|\.)0[0-9]"), found.rlike(r"(?:^|\.)0[0-9]"))
    elif kind == "card":
        strict = _vote(valid, ~valid)
        known, grouped = _vote(found.rlike(ISSUERS), ~found.rlike(ISSUERS)), _vote(F.length(_digits(found)).isin(15, 16), F.length(_digits(found)) == 13)
    else:
        strict = _vote(valid, ~valid)
        known, grouped = _vote(found.rlike(CALLING_CODES), found.rlike(r"^(?:\+|00)")), _vote(found.rlike(r"[\x20().-]"), found.rlike(r"[.(][\x20.(]"))
    return [strict, known, context, grouped]


def _starts(lengths: Column) -> Column:
    """Where each part begins. Sums run within blocks of 64, so that many parts take little more than linear time."""
    block = 64
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int")),
        lambda j: F.slice(lengths, j * block + 1, block),
    )
    total = lambda part: F.aggregate(part, F.lit(0), lambda t, x: t + x)
    sums = F.transform(blocks, total)
    ahead = F.transform(sums, lambda _, j: F.when(j == 0, F.lit(0)).otherwise(total(F.slice(sums, 1, j))))
    return F.flatten(
        F.zip_with(
            blocks,
            ahead,
            lambda part, before: F.transform(
                part, lambda _, i: before + F.when(i == 0, F.lit(0)).otherwise(total(F.slice(part, 1, i)))
            ),
        )
    )


_CANDIDATE = "array<struct<start:int,rank:int,end:int,base:boolean,votes:array<int>,shape:string>>"


def _candidates(df: DataFrame, text: str, kind: str, pattern: str, needs: str, base: bool, name: str) -> DataFrame:
    """Add the matches of ``pattern`` as ``name``; texts without what the kind needs are not searched."""
    held = F.contains(F.col(text), F.lit(needs)) if needs == "@" else F.col(text).rlike(needs)
    marked = F.regexp_replace(F.col(text), pattern, f"{_MARK}$0{_MARK}")
    parts, starts = f"__{name}_parts", f"__{name}_starts"
    df = df.withColumn(parts, F.when(held, F.split(marked, _MARK, -1)).otherwise(F.array(F.lit(""))))
    df = df.withColumn(
        starts,
        F.when(F.size(parts) > 1, _starts(F.transform(F.col(parts), lambda p: F.length(p)))).otherwise(F.array(F.lit(0))),
    )
    p, s = F.col(parts), F.col(starts)

    def candidate(i: Column) -> Column:
        found, before = p[i], F.right(p[i - 1], F.lit(CONTEXT))
        shape = F.concat_ws(
            ",",
            F.lit(kind),
            F.concat(F.lit("digits"), F.least(F.length(_digits(found)), F.lit(20))),
            F.when(found.rlike(r"[\x20()-]"), "parted").otherwise("solid"),
            F.when(before.rlike(r"[\x20\x09-\x0D]$|^$"), "free").otherwise("stuck"),
        )
        return F.struct(
            s[i].cast("int").alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            (s[i] + F.length(found)).cast("int").alias("end"),
            (_valid(kind, found) if base else F.lit(False)).alias("base"),
            F.array(*_votes(kind, found, before, base)).alias("votes"),
            shape.alias("shape"),
        )

    some = F.transform(F.sequence(F.lit(1), F.size(p) - 1, F.lit(2)), candidate)
    return df.withColumn(name, F.when(F.size(p) > 1, some).otherwise(F.array()).cast(_CANDIDATE)).drop(parts, starts)


def with_candidates(df: DataFrame, text: str) -> DataFrame:
    """Add ``__spans`` (base) and ``__loose`` (other candidates that touch no base span)."""
    df = df.withColumn("__text", F.translate(F.coalesce(F.col(text), F.lit("")), _MARK, _STAND_IN))
    for kind in KINDS:
        df = _candidates(df, "__text", kind, BASE[kind], NEEDS[kind], True, f"__base_{kind}")
        df = _candidates(df, "__text", kind, LOOSE[kind], LOOSE_NEEDS[kind], False, f"__loose_{kind}")
    every = lambda stem: F.array_sort(F.flatten(F.array(*[F.col(f"__{stem}_{k}") for k in KINDS])))
    df = df.withColumn("__spans", F.filter(every("base"), lambda x: x.base)).withColumn("__all", every("loose"))
    apart = F.filter(F.col("__all"), lambda x: ~F.exists(F.col("__spans"), lambda b: (b.start < x.end) & (x.start < b.end)))
    df = df.withColumn("__loose", F.when(F.size("__all") == 0, F.col("__all")).otherwise(apart))
    return df.drop("__text", "__all", *[f"__{stem}_{k}" for stem in ("base", "loose") for k in KINDS])


def estimate(patterns: dict[tuple[int, tuple[int, ...]], int]) -> dict[tuple[int, tuple[int, ...]], float]:
    """The likelihood of every (kind, votes) by expectation-maximisation over their counts."""
    out = {}
    for rank in {r for r, _ in patterns}:
        counts = {votes: n for (r, votes), n in patterns.items() if r == rank}
        belief = {votes: 0.5 + 0.4 * (sum(votes) > 0) - 0.4 * (sum(votes) < 0) for votes in counts}
        for _ in range(ROUNDS):
            # How often each labeler votes how, for personal data and for the rest; one pseudo-count.
            shares = []
            for true in (1, 0):
                mass = {v: n * (belief[v] if true else 1 - belief[v]) for v, n in counts.items()}
                total = sum(mass.values())
                heard = [defaultdict(float) for _ in next(iter(counts))]
                for votes, m in mass.items():
                    for table, vote in zip(heard, votes):
                        table[vote] += m
                shares.append((total, [{x: (t[x] + 1) / (total + 3) for x in (-1, 0, 1)} for t in heard]))
            everything = shares[0][0] + shares[1][0]
            for votes in counts:
                odds = [
                    math.log((total + 1) / (everything + 2)) + sum(math.log(t[v]) for t, v in zip(tables, votes))
                    for total, tables in shares
                ]
                belief[votes] = 1 / (1 + math.exp(min(50.0, max(-50.0, odds[1] - odds[0]))))
        out |= {(rank, votes): p for votes, p in belief.items()}
    return out


def span_features(shape: str, votes: tuple[int, ...]) -> list[str]:
    kind, *rest = shape.split(",")
    return [kind, *[f"{kind},{x}" for x in rest], *[f"{kind},vote{i}={v}" for i, v in enumerate(votes)]]


def train(rows: list[tuple[str, int, tuple[int, ...], int]], belief: dict) -> dict[str, float]:
    """Weights of the span classifier from (shape, kind, votes, count), by gradient steps on the likelihoods."""
    weights: dict[str, float] = defaultdict(float)
    known = [(span_features(shape, votes), belief[rank, votes], n) for shape, rank, votes, n in rows]
    total: dict[str, int] = defaultdict(int)
    for features, _, n in known:
        for f in features:
            total[f] += n
    for _ in range(STEPS):
        slope: dict[str, float] = defaultdict(float)
        for features, p, n in known:
            guess = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[f] for f in features)))))
            for f in features:
                slope[f] += n * (p - guess)
        for f, s in slope.items():
            weights[f] += RATE * (s / total[f] - 1e-3 * weights[f])
    return dict(weights)


def learn(candidates: DataFrame) -> dict[str, float]:
    """The classifier from all candidates of ``with_candidates``; only counts reach the driver."""
    each = candidates.select(F.explode(F.concat("__spans", "__loose")).alias("x")).select("x.*")
    counted = each.groupBy("shape", "rank", "votes").agg(F.count("*").alias("n")).collect()
    rows = sorted((r["shape"], r["rank"], tuple(r["votes"]), r["n"]) for r in counted)
    patterns: dict = defaultdict(int)
    for _, rank, votes, n in rows:
        patterns[rank, votes] += n
    return train(rows, estimate(patterns))


def with_added(candidates: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Add ``__added``: the loose candidates the classifier is sure of, none over another of its kind."""
    if not weights:
        return candidates.withColumn("__added", F.slice("__loose", 1, 0))
    table = F.from_json(F.lit("{" + ",".join(f'"{k}":{v!r}' for k, v in sorted(weights.items())) + "}"), "map<string,double>")

    def score(x: Column) -> Column:
        parts = F.split(x.shape, ",")
        kind = parts[0]
        names = F.concat(
            F.array(kind),
            F.transform(F.slice(parts, 2, 9), lambda p: F.concat_ws(",", kind, p)),
            F.transform(x.votes, lambda v, i: F.concat(kind, F.lit(",vote"), i.cast("string"), F.lit("="), v.cast("string"))),
        )
        return F.aggregate(names, F.lit(0.0), lambda t, f: t + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))

    limit = math.log(SURE / (1 - SURE))
    # The format must speak for it: a failed check digit is never outvoted.
    sure = F.filter(F.col("__loose"), lambda x: (x.votes[0] >= 0) & (score(x) >= limit))
    return candidates.withColumn("__added", F.when(F.size("__loose") > 0, sure).otherwise(F.col("__loose")))


def _spelled(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x.rank], x.start, x.end)), ",")


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Base spans and added spans of every row.

    ``n_<kind>`` and ``base_sha256`` tell of the base spans, ``spans`` of all, ``n_added`` of the
    others. Spans are sorted by start, then kind. Other columns are not read; repeated rows come
    back as often; an empty table gives no rows.
    """
    # Written once, so that texts are searched once: it holds spans, no text.
    found = cut_lineage(with_candidates(docs.select(key, text), text).drop(text))
    found = with_added(found, learn(found))
    count = lambda k: F.size(F.filter(F.col("__spans"), lambda x: x.rank == KINDS.index(k))).cast("bigint")
    return found.select(
        key,
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_spelled(F.col("__spans")), 256).alias("base_sha256"),
        _spelled(F.array_sort(F.concat("__spans", "__added"))).alias("spans"),
        F.size("__added").cast("bigint").alias("n_added"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets; all rows and columns stay."""
    found = with_candidates(docs, text)
    found = with_added(found, learn(with_candidates(docs.select(text), text)))
    spans = F.array_sort(F.concat("__spans", "__added"))
    found = found.withColumn("__cut", spans)
    cut, whole = F.col("__cut"), F.col(text)
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])

    def piece(x: Column, i: Column) -> Column:
        # From the end of the spans before (they may overlap) to this one, then its kind.
        end = F.when(i == 0, F.lit(0)).otherwise(F.array_max(F.transform(F.slice(cut, 1, i), lambda y: y.end)))
        return F.concat(F.substring(whole, end + 1, F.greatest(x.start - end, F.lit(0))), names[x.rank])

    last = F.array_max(F.transform(cut, lambda y: y.end))
    cleaned = F.concat(F.array_join(F.transform(cut, piece), ""), F.substring(whole, last + 1, F.length(whole)))
    return found.withColumn(text, F.when(F.size(cut) > 0, cleaned).otherwise(whole)).select(*docs.columns)
