"""Secret scans: base patterns plus two character Markov models compared by
log-likelihood ratio, in DataFrame operations only.

One model describes random strings, the other ordinary identifiers; both are
first-order chains over the characters of tokens, trained from labelled
samples.  A token with a letter and at least ``min_length`` characters that no base pattern
touches is a secret when its log-likelihood ratio reaches ``margin`` per
pair of characters.

The default samples are labelled by rule: values of base matches anywhere in
the corpus and ``generated`` hexadecimal / base64 digests are random; all
other tokens of the corpus without a digit are ordinary (tokens with digits
get no label, as unknown secrets are among them).  Training is one pass with a partial
aggregate over pairs of characters (67 x 67 counts), so neither size nor skew
of the corpus matters for its cost; the pair weights are a fixed number of
literals in the scoring expression, which needs no shuffle.

With ``folds`` (the registered query and the pipeline use ``FOLDS``) the
weights do not drift with corpus size either: every distinct token counts
once in both classes, ordinary tokens include ``generated`` names with digits
and the tokens of the corpus that are built like names (``IDENTIFIER``), both
sources weigh the same however large the corpus is, a pair backs off by a
fixed share of its row, and a token is scored by the model of its fold, which
is trained on the tokens of all other folds.  Without folds ordinary tokens
count by occurrence and the back-off is a fixed count.

Defined results: a null text is empty (no spans); repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.spans import SPAN, joined, match_spans, overlaps

#: Kinds in listed order and their patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # all of AKIA[A-Z0-9]+ with 20 characters or more
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
TOKEN = "[A-Za-z0-9+/_=-]"
#: Shortest ordinary token of a training sample.
SAMPLE_LENGTH = 12
#: Folds of the tokens in the registered query and the pipeline.
FOLDS = 4
#: Names with one or two numbers of up to four digits: words of two letters or
#: more, each with a number behind it or not, and numbers between separators.
IDENTIFIER = (
    r"^(?=[^0-9]*[0-9]{1,4}(?:[^0-9]+[0-9]{1,4})?[^0-9]*$)"
    r"(?:(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+)[0-9]{0,4}+|(?<![A-Za-z])[vVxX]?[0-9]{1,4}+|[_/=+-])++$"
)
#: Longest token that is tested for being built like a name.
IDENTIFIER_LENGTH = 128
#: Words of the generated names.
NAME_WORDS = (
    "get set run load user name file path item list count value table key read write open close total node page image "
    "report order client server config handler build test data cache query batch update delete create search format "
    "parser stream buffer socket thread worker session request response message event status service module package "
    "version default local remote source target"
).split()
NAME_NUMBERS = (8, 16, 32, 64, 86, 128, 256, 512, 1024, 2024)


def base_spans(docs: DataFrame, id_col: str, text_col: str, columns: list[str] | None = None) -> DataFrame:
    """doc_id, text, assign, access, hex (arrays of spans with their value)
    and in_<name> of the passed-through columns."""
    own = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *[F.col(c).alias(f"in_{c}") for c in columns or []],
    )
    t = F.col("text")
    return own.select(
        "*",
        F.filter(match_spans(t, ASSIGN, 2), lambda s: F.char_length(s["value"]) >= 6).alias("assign"),
        match_spans(t, ACCESS).alias("access"),
        match_spans(t, HEX).alias("hex"),
    )


def generated_samples(spark, generated: int) -> DataFrame:
    """Random strings made from digests of the numbers below ``generated``."""
    ids = spark.range(generated).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    b64 = F.base64(F.unhex("h"))
    return ids.select(F.explode(F.array("h", F.upper("h"), b64, F.translate(b64, "+/=", "-_"))).alias("value"), F.lit(True).alias("secret"))


def generated_names(spark, generated: int) -> DataFrame:
    """Ordinary names, most with digits, made of ``NAME_WORDS`` picked by
    hashes of the numbers below ``generated``."""
    pick = lambda j, n: F.pmod(F.xxhash64("id", F.lit(j)), F.lit(n)).cast("int")
    words = F.split(F.lit(" ".join(NAME_WORDS)), " ")
    a, b, c, d = (F.get(words, pick(j, len(NAME_WORDS))) for j in range(4))
    digit, two = pick(4, 10).cast("string"), pick(5, 100).cast("string")
    number = F.get(F.array(*[F.lit(str(n)) for n in NAME_NUMBERS]), pick(6, len(NAME_NUMBERS)))
    names = [
        F.concat_ws("_", a, b, c, F.concat(F.lit("v"), digit)), F.concat(a, F.initcap(b), F.initcap(c), F.initcap(d), digit),
        F.concat_ws("_", F.concat(a, number), b, c), F.concat_ws("-", F.concat(a, two), b, c, number),
        F.concat_ws("/", a, b, F.concat(F.lit("v"), digit), c), F.concat(a, F.initcap(b), digit, F.initcap(c)),
        F.concat_ws("-", a, b, c, d), F.upper(F.concat_ws("_", a, b, number)),
        F.concat_ws("-", F.concat(F.lit("x"), number, F.lit("_"), two), a, b), F.concat(a, F.lit("="), b, two, F.lit("/"), c),
    ]
    return spark.range(generated).select(F.explode(F.array(*names)).alias("value"), F.lit(False).alias("secret"))


def corpus_samples(found: DataFrame, names: bool = False) -> DataFrame:
    """(value, secret) of all base matches and of all other tokens without a
    digit; with ``names`` also of those with digits that are built like names."""
    base = F.concat("assign", "access", "hex")
    known = F.transform(base, lambda s: F.struct(s["value"].alias("value"), F.lit(True).alias("secret")))
    token = f"{TOKEN}{{{SAMPLE_LENGTH},}}"
    # Texts without a base match need no positions, only the tokens.
    plain = F.regexp_extract_all("text", F.lit(token), F.lit(0))
    apart = F.transform(
        F.filter(match_spans(F.col("text"), token), lambda s: ~overlaps(s, base)), lambda s: s["value"]
    )
    tokens = F.when(F.size(base) == 0, plain).otherwise(apart)

    def is_ordinary(v):
        plain = ~v.rlike("[0-9]")
        return plain | ((F.char_length(v) <= IDENTIFIER_LENGTH) & v.rlike(IDENTIFIER)) if names else plain

    other = F.transform(F.filter(tokens, is_ordinary), lambda v: F.struct(v.alias("value"), F.lit(False).alias("secret")))
    return found.select(F.inline(F.concat(known, other)))


def pair_counts(samples: DataFrame) -> DataFrame:
    """(secret, pair, n): adjacent character pairs of the samples.  A random
    string counts each of its pairs once however often it occurs, so one
    leaked key in many documents does not become the model; ordinary tokens
    count by occurrence."""
    pairs = F.transform(F.sequence(F.lit(1), F.char_length("value") - 1), lambda i: F.substring(F.col("value"), i, F.lit(2)))
    return (
        samples.filter(F.char_length("value") >= 2)
        .select("secret", F.when(F.col("secret"), F.col("value")).alias("own"), F.explode(pairs).alias("pair"))
        .groupBy("secret", "own", "pair").agg(F.count("*").alias("n"))
        .groupBy("secret", "pair").agg(F.sum(F.when(F.col("secret"), 1).otherwise(F.col("n"))).alias("n"))
    )


def pair_weights(counts: DataFrame, backoff: float = 5.0) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) of every pair, in
    alphabet order (at most 2 x 67 x 67 rows are fetched).  A pair backs off
    to how often its second character follows any other in its class, mixed
    with 5 % of an even share, so a few digits do not decide alone."""
    seen = {(r.secret, r.pair): r.n for r in counts.filter(F.col("pair").rlike(f"^{TOKEN}{{2}}$")).collect()}
    log_p = {}
    for label in (True, False):
        follows = {b: sum(seen.get((label, a + b), 0) for a in ALPHABET) for b in ALPHABET}
        total = sum(follows.values())
        share = {b: 0.05 / len(ALPHABET) + 0.95 * (n / total if total else 1 / len(ALPHABET)) for b, n in follows.items()}
        for a in ALPHABET:
            row = sum(seen.get((label, a + b), 0) for b in ALPHABET)
            for b in ALPHABET:
                log_p[label, a + b] = math.log((seen.get((label, a + b), 0) + backoff * share[b]) / (row + backoff))
    return [log_p[True, a + b] - log_p[False, a + b] for a in ALPHABET for b in ALPHABET]


def fold_of(value: Column, folds: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(folds)).cast("int")


def fold_counts(samples: DataFrame, folds: int) -> DataFrame:
    """(secret, part, fold, pair, n): adjacent character pairs of the distinct
    samples (value, secret, part); a random string counts each of its pairs
    once."""
    pairs = F.transform(F.sequence(F.lit(1), F.char_length("value") - 1), lambda i: F.substring(F.col("value"), i, F.lit(2)))
    return (
        samples.filter(F.char_length("value") >= 2).distinct()
        .select("secret", "part", fold_of(F.col("value"), folds).alias("fold"),
                F.explode(F.when(F.col("secret"), F.array_distinct(pairs)).otherwise(pairs)).alias("pair"))
        .groupBy("secret", "part", "fold", "pair").agg(F.count("*").alias("n"))
    )


def fold_weights(counts: DataFrame, folds: int, share: float = 0.002) -> list[float]:
    """Pair weights of every fold, one behind the other: each from the counts
    of all other folds (at most 2 x parts x folds x 67 x 67 rows are fetched).
    The parts of a class weigh the same in every row they have; ``share`` of a
    row goes to how often the second character follows any other, mixed with
    5 % of an even share."""
    size = len(ALPHABET)
    seen: dict = {True: {}, False: {}}
    for r in counts.filter(F.col("pair").rlike(f"^{TOKEN}{{2}}$")).collect():
        part = seen[r.secret].setdefault(r.part, np.zeros((folds, size, size)))
        part[r.fold, ALPHABET.index(r.pair[0]), ALPHABET.index(r.pair[1])] = r.n

    def log_p(parts, fold):
        tables = [t for part in sorted(parts) if (t := parts[part].sum(axis=0) - parts[part][fold]).any()]
        follows = sum((t.sum(axis=0) / t.sum() for t in tables), np.zeros(size)) / max(1, len(tables))
        back = 0.05 / size + 0.95 * (follows if tables else 1 / size)
        rows = [t.sum(axis=1, keepdims=True) for t in tables]
        known = sum(((r > 0).astype(int) for r in rows), np.zeros((size, 1), int))
        mean = sum((t / np.maximum(r, 1) for t, r in zip(tables, rows)), np.zeros((size, size))) / np.maximum(known, 1)
        return np.log(np.where(known > 0, (1 - share) * mean + share * back, back))

    return [float(w) for k in range(folds) for w in (log_p(seen[True], k) - log_p(seen[False], k)).ravel()]


def ratio(value: Column, weights: Column, folds: int = 0) -> Column:
    """Log-likelihood ratio of a token, per pair of characters."""
    start = fold_of(value, folds) * F.lit(len(ALPHABET) ** 2) if folds else F.lit(0)
    place = lambda i: F.position(F.substring(value, i, F.lit(1)), F.lit(ALPHABET)) - 1
    size = F.lit(len(ALPHABET))
    total = F.aggregate(
        F.sequence(F.lit(1), F.char_length(value) - 1), F.lit(0.0),
        lambda acc, i: acc + F.coalesce(F.get(weights, start + place(i) * size + place(i + 1)), F.lit(0.0)),
    )
    return F.round(total / (F.char_length(value) - 1), 9)


def secret_spans(
    docs: DataFrame,
    samples: DataFrame | None = None,
    min_length: int = 20,
    margin: float = 3.0,
    generated: int = 2000,
    id_col: str = "doc_id",
    text_col: str = "text",
    columns: list[str] | None = None,
    folds: int = 0,
) -> DataFrame:
    """One row per input row: doc_id, assign, access, hex, markov (arrays of
    (start, end, value)), base and spans (ordered arrays of (start, rank, end,
    kind)).  ``samples`` (value, secret) replaces the default training set;
    ``columns`` of the input are passed through as in_<name>; ``folds`` gives
    the models that do not depend on corpus size (0: one model)."""
    found = base_spans(docs, id_col, text_col, columns)
    spark = docs.sparkSession
    if folds:
        part = F.lit(0).alias("part")
        if samples is None:
            samples = corpus_samples(found, names=True).unionByName(generated_samples(spark, generated)).select("*", part)
            samples = samples.unionByName(generated_names(spark, generated).select("*", F.lit(1).alias("part")))
        else:
            samples = samples.select("value", "secret", part)
        weights = fold_weights(fold_counts(samples, folds), folds)
    else:
        if samples is None:
            samples = corpus_samples(found).unionByName(generated_samples(spark, generated))
        weights = pair_weights(pair_counts(samples))
    table = F.split(F.lit(",".join(repr(w) for w in weights)), ",").cast("array<double>")

    base = F.concat("assign", "access", "hex")
    tokens = match_spans(F.col("text"), f"{TOKEN}{{{min_length},}}")
    found = found.withColumn(
        "markov",
        F.filter(
            tokens, lambda s: s["value"].rlike("[A-Za-z]") & ~overlaps(s, base) & (ratio(s["value"], table, folds) >= margin)
        ).cast(SPAN),
    )

    def ranked(kind):
        rank = KINDS.index(kind)
        return F.transform(kind, lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    base = F.concat(*[ranked(k) for k in KINDS[:3]])
    return found.withColumn("base", F.array_sort(base)).withColumn("spans", F.array_sort(F.concat("base", ranked("markov"))))


def secret_digest(found: DataFrame) -> DataFrame:
    """doc_id, counts per kind, base_sha256 and the joined spans."""
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
