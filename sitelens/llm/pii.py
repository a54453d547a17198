"""Personal data by weak supervision, in DataFrame operations only.

1. One scan finds the base kinds (email, ip, card, phone) and further
   candidates: local phone numbers, social security numbers, IBANs, titled
   person names and long bare numbers.  Only the spans and their features are
   written; texts cross no shuffle.
2. Labelers vote on every candidate (for, against, abstain): its pattern,
   check digits and ranges, gazetteers, context words before it, and its
   surroundings.
3. Expectation-maximisation over the counts of vote patterns (a table of
   bounded size, summed by a partial aggregate) estimates how reliable each
   labeler is, and with that the probability that a candidate is personal.
4. A naive Bayes span classifier is trained on these probabilities with the
   features of the spans, and decides which further candidates are added.
   Base spans always stay.

Defined results: a null text is empty (no spans); repeated rows give repeated
results; without candidates nothing is trained or added; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import materialize
from sitelens.llm.spans import SPAN, joined, match_spans, overlaps

#: Base kinds in listed order.  The patterns match what the
#: plain forms match; possessive groups and the look-behind only keep the work
#: linear on long runs.
BASE = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
CARD_GUARD = r"(?:[0-9][\x20-]?){15}[0-9]"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Further candidates: kind -> pattern.
FURTHER = {
    "person": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]++(?:\x20[A-Z][a-z]++)?",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local": r"(?<![0-9+-])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "number": r"(?<![0-9.-])[0-9]{9,19}(?![0-9.-])",
}
KINDS = (*BASE, *FURTHER)

#: Gazetteers.
DOMAINS = "com org net edu gov io co uk de fr es it nl eu us info biz".split()
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 55 61 81 82 86 91".split()
IBAN_COUNTRIES = "AT BE CH CZ DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split()
GIVEN_NAMES = (
    "james mary john anna maria peter paul laura thomas julia david sarah daniel emma michael lisa robert linda jean "
    "pierre marie claire hans klaus greta juan carlos elena jose lucia"
).split()
CUES = (
    "call phone tel telephone mobile fax contact mail email write reach address ssn social security iban account bank "
    "card visa mastercard credit name mr mrs dr patient customer ip host login"
).split()
AGAINST = "version isbn issn order invoice build ticket article part model serial page chapter doi sku".split()

LABELERS = ("pattern", "check", "gazetteer", "context", "place")
#: Characters of context before a span.
CONTEXT = 32


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    size = F.char_length(number)

    def add(acc, i):
        d = F.substring(number, size - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add) % 10 == 0


def _in_range(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+", "0").try_cast("int") <= 255, F.lit(False)))


def _counted(value: Column, low: int, high: int) -> Column:
    n = F.char_length(digits(value))
    return (n >= low) & (n <= high)


def _guarded(guard: Column, spans: Column) -> Column:
    return F.when(guard, spans).otherwise(F.array().cast(SPAN))


def base_columns(text: Column) -> dict[str, Column]:
    """Arrays of spans of the four base kinds."""
    card = F.filter(match_spans(text, CARD), lambda s: _counted(s["value"], 16, 19))
    return {
        "email": _guarded(F.contains(text, F.lit("@")), match_spans(text, EMAIL)),
        "ip": F.filter(match_spans(text, IP), lambda s: _in_range(s["value"])),
        "card": _guarded(text.rlike(CARD_GUARD), F.filter(card, lambda s: luhn(digits(s["value"])))),
        "phone": _guarded(
            F.contains(text, F.lit("+")), F.filter(match_spans(text, PHONE), lambda s: _counted(s["value"], 8, 15))
        ),
    }


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _any_word(text: Column, words: list[str]) -> Column:
    return text.rlike(r"(?<![a-z])(?:" + "|".join(words) + r")(?![a-z])")


def _votes(kind: str, value: Column, before: Column) -> dict[str, Column]:
    """The votes of all labelers on a span of a kind."""
    never = F.lit(False)
    number = digits(value)
    first = F.regexp_extract(value, r"^(?:[A-Za-z]+\.?\x20)?([A-Za-z]+)", 1)
    size = F.char_length(number)
    pattern = {"local": 0, "number": -1}.get(kind, 1)
    check = {
        "card": F.lit(1), "number": _vote((size >= 13) & luhn(number), size >= 1), "phone": _vote((size >= 10) & (size <= 13), never),
        "ip": _vote(~value.rlike(r"^(?:0+|127|255)\."), ~never), "ssn": _vote(~value.rlike(r"^(?:000|666|9)"), ~never),
        "local": _vote((size == 10) & ~number.rlike("^[01]"), ~never),
    }.get(kind, F.lit(0))
    gazetteer = {
        "email": _vote(F.lower(F.element_at(F.split(value, r"\."), -1)).isin(DOMAINS), never),
        "phone": _vote(value.rlike(r"^\+(?:" + "|".join(COUNTRY_CODES) + ")"), ~never),
        "card": _vote(number.rlike("^[3-6]"), ~never), "number": _vote(number.rlike("^[3-6]") & (size >= 13), never),
        "iban": _vote(F.substring(value, 1, 2).isin(IBAN_COUNTRIES), ~never),
        "person": _vote(F.lower(first).isin(GIVEN_NAMES), never),
    }.get(kind, F.lit(0))
    return {
        "pattern": F.lit(pattern), "check": check, "gazetteer": gazetteer,
        "context": _vote(_any_word(before, CUES), _any_word(before, AGAINST)),
        "place": _vote(before.rlike(r"(?:^|[\s(:=,\"'])$"), before.rlike(r"[\w#$/\\-]$")),
    }


def candidates(text: Column, spans: Column, kind: str) -> Column:
    """Spans of a kind with their votes and features."""
    def row(s):
        before = F.lower(F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT))))
        size = F.floor(F.log2(F.char_length(s["value"]))).cast("int")
        return F.struct(
            F.lit(KINDS.index(kind)).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"),
            *[v.cast("int").alias(k) for k, v in _votes(kind, s["value"], before).items()],
            size.alias("size"), F.right(before, F.lit(1)).rlike("[a-z0-9]").alias("glued"),
        )

    return F.transform(spans, row)


def span_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, one array per base kind, and all candidates with their votes."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    own = own.select("doc_id", "text", *[v.alias(k) for k, v in base_columns(text).items()])
    base = F.concat(*BASE)
    own = own.select("*", *[
        F.filter(match_spans(text, p), lambda s: ~overlaps(s, base)).alias(k) for k, p in FURTHER.items()
    ])
    return own.select(
        "doc_id", *BASE, F.concat(*[candidates(text, F.col(k), k) for k in KINDS]).alias("candidates")
    )


def estimate(patterns: DataFrame, rounds: int = 25, tolerance: float = 1e-4) -> tuple[DataFrame, dict]:
    """Dawid-Skene estimates over (votes..., n): the patterns with ``p``, the
    probability that their spans are personal, and the parameters."""
    share = 0.5
    # P(vote | class): labelers start out somewhat better than chance.
    chance = {(k, v, c): (0.6 if v == (1 if c else -1) else 0.2) for k in LABELERS for v in (-1, 0, 1) for c in (0, 1)}

    def posterior():
        odds = F.lit(math.log(share / (1 - share)))
        for k in LABELERS:
            gain = F.lit(0.0)
            for v in (-1, 0, 1):
                gain = F.when(F.col(k) == v, math.log(chance[k, v, 1] / chance[k, v, 0])).otherwise(gain)
            odds = odds + gain
        return F.round(1 / (1 + F.exp(-odds)), 9)

    n = F.col("n")
    for _ in range(rounds):
        p = F.col("p")
        sums = [F.sum(n * p).alias("yes"), F.sum(n * (1 - p)).alias("no")]
        for k in LABELERS:
            for v in (-1, 0, 1):
                hit = F.when(F.col(k) == v, n).otherwise(0)
                sums += [F.sum(hit * p).alias(f"{k}{v}y"), F.sum(hit * (1 - p)).alias(f"{k}{v}n")]
        got = patterns.withColumn("p", posterior()).agg(*sums).first()
        if not got.yes and not got.no:
            break
        new_share = min(0.99, max(0.01, got.yes / (got.yes + got.no)))
        new = {}
        for k in LABELERS:
            for v in (-1, 0, 1):
                new[k, v, 1] = (got[f"{k}{v}y"] + 1) / (got.yes + 3)
                new[k, v, 0] = (got[f"{k}{v}n"] + 1) / (got.no + 3)
        moved = max(abs(new_share - share), *(abs(new[x] - chance[x]) for x in chance))
        share, chance = new_share, new
        if moved < tolerance:
            break
    return patterns.withColumn("p", posterior()), {"share": share, "chance": chance}


def _features(c) -> list[Column]:
    """Feature names of a candidate."""
    col = (lambda name: c[name]) if c is not None else F.col
    return [
        F.concat(F.lit("kind="), col("kind")),
        F.concat(F.lit("size="), col("size").cast("string")),
        F.concat(F.lit("glued="), col("glued").cast("string")),
        *[F.concat(F.lit(f"{k}="), col(k).cast("string")) for k in LABELERS],
    ]


def train_classifier(found: DataFrame) -> dict[str, float]:
    """Feature -> log-odds (with the prior under ""), from all candidates of
    the corpus; a bounded number of features is fetched."""
    spans = found.select(F.inline("candidates"))
    keys = ["kind", "size", "glued", *LABELERS]
    patterns = materialize(spans.groupBy(*keys).agg(F.count("*").cast("double").alias("n")).coalesce(1), "pii-patterns")
    if patterns.isEmpty():
        return {}
    votes = materialize(patterns.groupBy(*LABELERS).agg(F.sum("n").alias("n")).coalesce(1), "pii-votes")
    scored, _ = estimate(votes)
    known = patterns.join(scored.select(*LABELERS, "p"), list(LABELERS))
    weighed = known.select(F.explode(F.array(F.lit(""), *_features(None))).alias("feature"), "n", "p").groupBy("feature").agg(
        F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")
    )
    rows = {r.feature: (r.yes, r.no) for r in weighed.collect()}
    yes, no = rows.pop("")
    out = {"": math.log((yes + 1) / (no + 1))}
    for feature, (a, b) in rows.items():
        out[feature] = round(math.log((a + 1) / (yes + 2)) - math.log((b + 1) / (no + 2)), 9)
    return out


def personal_spans(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, email, ip, card, phone (arrays of
    (start, end, value)), base and spans (arrays of (rank, start, end, kind),
    in order of kind, then start)."""
    found = materialize(span_table(docs, id_col, text_col), "pii-spans")
    weights = train_classifier(found)
    plain = lambda c: F.struct(c["rank"].alias("rank"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))
    base = F.array_sort(F.transform(F.filter("candidates", lambda c: c["rank"] < len(BASE)), plain))
    if weights:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        odds = math.log(threshold / (1 - threshold))

        def accepted(c):
            score = F.aggregate(
                F.array(*_features(c)), F.lit(weights[""]), lambda acc, f: acc + F.coalesce(F.try_element_at(table, f), F.lit(0.0))
            )
            return (c["rank"] >= len(BASE)) & (score >= odds)

        added = F.array_sort(F.transform(F.filter("candidates", accepted), plain))
    else:
        added = F.slice(base, F.lit(1), F.lit(0))
    return found.select("doc_id", *BASE, base.alias("base"), F.concat(base, added).alias("spans"))


def personal_digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, n_added and the joined spans."""
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"), joined(F.col("spans")).alias("spans"),
    )
