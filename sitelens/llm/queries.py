"""Registered queries of the corpus operators (thin digests of their results)
and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import (
    bottom_k,
    bpe_codec,
    bwt_dedup,
    collocations,
    decontaminate,
    pii,
    quality,
    ranked_search,
    secret_scan,
    simhash,
    token_count,
    toxicity,
    unit_dedup,
)
from sitelens.llm.common import documents, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a 13-word window of a benchmark item."""
    found = decontaminate.decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(documents(spark, sf_dir), shingle=4, radius=4)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text under byte_bpe_50k.json."""
    return token_count.token_counts(documents(spark, sf_dir))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text: base patterns and the two Markov models."""
    return secret_scan.secret_digest(secret_scan.secret_spans(documents(spark, sf_dir), folds=secret_scan.FOLDS))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text under byte_bpe_multi_50k.tiktoken, and the bytes decoded from them."""
    return bpe_codec.encode_documents(documents(spark, sf_dir), keep_ids=False)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: base patterns and the weakly supervised classifier."""
    return pii.personal_digest(pii.personal_spans(documents(spark, sf_dir)))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines, sentences and runs of clauses of every document that are removed, and a
    digest of the text that stays."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = unit_dedup.removed_units(docs, windows=True)
    kept = unit_dedup.kept_texts(docs, found)
    spans = F.coalesce("removed", F.array().cast("array<struct<start:int,end:int>>"))
    return kept.select(
        "doc_id", F.size(spans).cast("long").alias("n_removed"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"])).alias("n_chars_removed"),
        F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
        F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base rules and the log-likelihood-ratio verdict of every document."""
    return quality.quality_rules(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document covered by 50-byte strings of smaller documents."""
    return bwt_dedup.dedup_substrings(documents(spark, sf_dir), length=50, keep_text=False)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best collocations of two to four words in every lang."""
    return collocations.collocations(documents(spark, sf_dir), max_words=4, min_count=30, top=2000)


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of word pairs are 80 % alike."""
    return bottom_k.near_duplicates(documents(spark, sf_dir), shingle=2, percent=80, k=64)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked_search.ranked_search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_simhash": op2_simhash,
    "op3_token_counts": op3_token_counts,
    "op4_secrets": op4_secrets,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_pii": op6_pii,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_bwt_dedup": op10_bwt_dedup,
    "op11_collocations": op11_collocations,
    "op12_minhash": op12_minhash,
    "op13_ranked_search": op13_ranked_search,
}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OP1_WORDS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
_OP13_TERMS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": f"""
WITH item AS (SELECT item_id, {_OP1_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(list_slice(w, s, s + 12), ' ') AS k
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {_OP1_WORDS} AS w FROM documents),
cut AS (
  SELECT doc_id, m, s, array_to_string(list_slice(w, s, s + m - 1), ' ') AS k
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s
        FROM doc, (SELECT DISTINCT m FROM win) AS sizes WHERE len(w) >= m)),
hit AS (SELECT doc_id, s, cut.m, item_id FROM cut JOIN win ON cut.m = win.m AND cut.k = win.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hit) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS joined
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN pos ON doc.doc_id = pos.doc_id LEFT JOIN ids ON doc.doc_id = ids.doc_id
""",
    # Bytes as two hexadecimal digits each; p is the 0-based start of a string.
    "op10_bwt_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM n WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
hit AS (SELECT w.doc_id, p FROM w JOIN f ON w.s = f.s WHERE w.doc_id > f.m),
isl AS (
  SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k
  FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM hit)),
spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM isl GROUP BY doc_id, k),
pieces AS (
  SELECT n.doc_id, a, substr(h, 2 * coalesce(lag(b) OVER o, 0) + 1, 2 * (a - coalesce(lag(b) OVER o, 0))) AS piece
  FROM n JOIN spans ON n.doc_id = spans.doc_id WINDOW o AS (PARTITION BY n.doc_id ORDER BY a)),
kept AS (SELECT doc_id, string_agg(piece, '' ORDER BY a) AS head FROM pieces GROUP BY doc_id),
cut AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS e FROM spans GROUP BY doc_id)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(e, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN cut ON n.doc_id = cut.doc_id LEFT JOIN kept ON n.doc_id = kept.doc_id
""",
    "op11_collocations": f"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM t),
g AS (
  SELECT lang, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM w, range(1, 5) AS sizes(m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS c, string_split(phrase, ' ') AS p FROM g GROUP BY lang, m, phrase HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
part AS (
  SELECT lang, array_to_string(list_slice(p, s, s + k - 1), ' ') AS phrase, max(c) AS reach
  FROM (SELECT *, unnest(range(1, m - k + 2)) AS s FROM (SELECT *, unnest(range(2, m)) AS k FROM f)) GROUP BY ALL),
cand AS (SELECT f.* FROM f LEFT JOIN part USING (lang, phrase) WHERE m > 1 AND 100 * coalesce(reach, 0) < 80 * c),
cut AS (
  SELECT lang, m, phrase, c, k, array_to_string(p[:k], ' ') AS h, array_to_string(p[k + 1:], ' ') AS r
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
sc AS (
  SELECT cut.lang, cut.phrase, cut.c AS a, k, x.c AS l, y.c AS r, CAST(2000000 * CAST(cut.c AS HUGEINT) // (x.c + y.c) AS BIGINT) AS score
  FROM cut JOIN f AS x ON cut.lang = x.lang AND h = x.phrase JOIN f AS y ON cut.lang = y.lang AND cut.r = y.phrase),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low WHERE nth = 1)
SELECT rk.lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM rk JOIN n ON rk.lang = n.lang WHERE rank <= 2000
""",
    "op12_minhash": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g
  FROM d),
g AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
link AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM g AS a JOIN g AS b ON a.x = b.x AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT reach.u, link.v FROM reach JOIN link ON reach.v = link.u)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, m AS component_id, s.doc_id = m AS kept
FROM s JOIN (SELECT u, min(v) AS m FROM reach GROUP BY u) ON s.doc_id = u
""",
    "op13_ranked_search": f"""
WITH d AS (SELECT doc_id, {_OP13_TERMS} AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS big_n, sum(len(w)) AS big_l FROM d),
q AS (SELECT item_id, t, count(*) AS reps FROM (SELECT item_id, unnest({_OP13_TERMS}) AS t FROM benchmark) GROUP BY item_id, t),
p AS (
  SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d)
  WHERE t IN (SELECT t FROM q) GROUP BY doc_id, n, t),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
x AS (
  SELECT item_id, doc_id,
         sum(reps * CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT)
             * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + CAST((75 * n * big_n) // big_l AS BIGINT))))) AS score
  FROM q JOIN p ON q.t = p.t JOIN f ON q.t = f.t, s GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rk FROM x WHERE score > 0)
SELECT item_id, CAST(rk AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM r WHERE rk <= 10
""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
