"""Quality rules with cross-document line frequency, in SQL functions only.

A document fails the base rules if it has fewer than 20 words, or if over 30 %
of its words stand in 8-word windows that the text has twice or more. Lines are
normalised (lower case, digits as 0, without punctuation; a line of
punctuation alone is itself) and hashed; a line that more than MAX_LINE_DOCS distinct documents of its host
(here: source) have is removed, and a document that keeps less than half of its
words, or under 20, is rejected as depleted.

Defined results: null text counts as empty, so it fails for want of words;
lines without a word are neither counted nor removed; a line counts once a
document however often it repeats there, and rows of one id are one document;
rows without an id are one document a text; a null host is a host of its own;
each row gets a verdict by its own text and host, repeated rows the same one; an
empty table gives an empty table; other columns of the input don't matter and
are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import materialise, table

SPACES = " \t\n\x0b\f\r"
#: Signs that a normalised line is without.
MARKS = ".,;:!?()[]{}<>|#*$%&/\\\"'`~^_=+-"
WINDOW, MIN_WORDS, MAX_REPEATED = 8, 20, 30
#: A line is boilerplate if more distinct documents of its host have it, however large the host is.
MAX_LINE_DOCS = 20
#: A document is depleted if it keeps a smaller share of its words.
MIN_KEPT_SHARE = 0.5
#: So many ways the rows of one line are spread.
SALTS = 16


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def count_of(text: Column, signs: str) -> Column:
    """Characters of a text that are among signs."""
    return (F.char_length(text) - F.char_length(F.translate(text, signs, ""))).cast("long")


def normal(line: Column) -> Column:
    bare = F.trim(F.translate(F.lower(line), "0123456789" + MARKS, "0000000000"))
    return F.when(bare == "", F.trim(line)).otherwise(bare)


def base_features(df: DataFrame) -> DataFrame:
    """df with the base counts of each row's _text, by array functions within the row."""
    x = df.withColumn("_words", words_of(F.col("_text")))
    x = x.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda s: F.char_length(F.translate(s, SPACES, "")) > 0))
    x = x.withColumn("n_words", F.size("_words").cast("long"))
    x = x.withColumn("_hashes", F.transform("_lines", lambda s: F.xxhash64(s)))
    at = lambda i, k: F.get(F.col("_words"), i + k)
    windows = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))
    x = x.withColumn("_windows", F.when(F.col("n_words") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    # only where some window repeats: windows with their places, those alike side by side
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    x = x.withColumn("_placed", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), placed).otherwise(none))
    near = lambda i, k: F.get(F.col("_placed"), i + k)["h"]
    twice = F.filter("_placed", lambda e, i: e["h"].eqNullSafe(near(i, 1)) | ((i > 0) & e["h"].eqNullSafe(near(i, -1))))
    x = x.withColumn("_starts", F.sort_array(F.transform(twice, lambda e: e["i"])))
    covered = F.aggregate(
        F.transform("_starts", lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_starts"), i + 1) - s, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda acc, n: acc + n,
    )
    return x.withColumns(
        {
            "word_chars": F.char_length(F.translate("_text", SPACES, "")).cast("long"),
            "n_symbols": count_of(F.col("_text"), "#*$%&|<>"),
            "n_dup_lines": (F.size("_hashes") - F.size(F.array_distinct("_hashes"))).cast("long"),
            "n_repeat_words": covered,
        }
    )


def removed_words(rows: DataFrame) -> DataFrame:
    """_key, _host, _text_hash and how many words of one such row stand in lines above the limit; rows has _key, _host and _text."""
    lines = F.filter(F.split("_text", "\n"), lambda s: F.char_length(F.translate(s, SPACES, "")) > 0)
    x = rows.select("_key", "_host", F.xxhash64("_text").alias("_text_hash"), lines.alias("_lines"))
    hashed = x.withColumn("_hashed", F.transform("_lines", lambda s: F.struct(F.xxhash64(normal(s)).alias("h"), F.size(words_of(s)).alias("n")))).drop("_lines")
    hashed = materialise(hashed, "line-hashes")  # read twice, and much smaller than the texts
    # a document is an id, or a text where that is null
    document = F.struct("_key", F.when(F.col("_key").isNull(), F.col("_text_hash")).alias("_text"))
    once = hashed.select("_host", document.alias("_doc"), F.explode(F.array_distinct(F.transform("_hashed", lambda e: e["h"]))).alias("_h"))
    over = once.groupBy("_host", "_h").agg(F.count_distinct("_doc").alias("_docs")).where(F.col("_docs") > MAX_LINE_DOCS)
    over = over.select(F.col("_host").alias("_of"), F.col("_h").alias("_line"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    each = hashed.select("_key", "_text_hash", "_host", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).alias("_salted"), F.posexplode("_hashed").alias("_at", "_e"))
    e, v = each.alias("e"), over.alias("v")
    same = F.col("e._host").eqNullSafe(F.col("v._of")) & (F.col("e._e.h") == F.col("v._line")) & (F.col("e._salted") == F.col("v._salt"))
    # repeated rows have the same lines at the same places: each place counts once
    gone = e.join(v, same).groupBy("_key", "e._host", "_text_hash").agg(F.collect_set(F.struct("_at", F.col("_e.n").alias("n"))).alias("_places"))
    return gone.select("_key", "_host", "_text_hash", F.aggregate("_places", F.lit(0).cast("long"), lambda s, p: s + p["n"]).alias("_gone"))


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """key, the base counts, base_failed, removed_words and kept of each row of docs."""
    rows = docs.select(F.col(key).alias("_key"), F.col(host).alias("_host"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    base = base_features(rows).withColumn("_text_hash", F.xxhash64("_text"))
    b, g = base.alias("b"), removed_words(rows).alias("g")
    x = b.join(g, F.col("b._key").eqNullSafe(F.col("g._key")) & F.col("b._host").eqNullSafe(F.col("g._host")) & (F.col("b._text_hash") == F.col("g._text_hash")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (left < MIN_WORDS) | (left < MIN_KEPT_SHARE * F.col("n_words"))
    x = x.select(F.col("b._key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.least(F.coalesce("_gone", F.lit(0)), F.col("n_words")).cast("long").alias("removed_words"))
    return x.withColumn("kept", ~F.col("base_failed") & ~depleted)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws, t FROM d),
n AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, ws FROM w),
ln AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), md5(t)) AS doc, source, unnest(string_split(t, chr(10))) AS l FROM d),
lw AS (SELECT doc_id, doc, source, l, len(list_filter(regexp_split_to_array(l, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS nw FROM ln),
lk AS (SELECT doc_id, doc, source, l, nw, coalesce(nullif(trim(translate(lower(l), '0123456789' || '{marks}', '0000000000'), ' '), ''), trim(l, ' ')) AS k FROM lw WHERE nw > 0),
dup AS (SELECT doc_id, CAST(count(*) - count(DISTINCT l) AS BIGINT) AS n_dup_lines FROM lk GROUP BY doc_id),
wi AS (SELECT doc_id, unnest(range(1, n_words - 6)) AS i, ws FROM n WHERE n_words >= 8),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS s FROM wi),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, CAST(sum(least(8, coalesce(nx - i, 8))) AS BIGINT) AS n_repeat_words FROM
  (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM rep) GROUP BY doc_id),
lc AS (SELECT source, k, count(DISTINCT doc) AS docs FROM lk GROUP BY source, k),
ov AS (SELECT source, k FROM lc WHERE docs > 20),
gone AS (SELECT lk.doc_id, sum(nw) AS g FROM lk JOIN ov ON lk.source IS NOT DISTINCT FROM ov.source AND lk.k = ov.k GROUP BY lk.doc_id),
x AS (SELECT n.doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  CAST(coalesce(g, 0) AS BIGINT) AS removed_words FROM n LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id)),
y AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM x)
SELECT *, NOT base_failed AND n_words - removed_words >= 20 AND n_words - removed_words >= 0.5 * n_words AS kept FROM y
""".replace("{marks}", MARKS.replace("'", "''"))
