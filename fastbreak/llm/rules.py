"""Quality rules: base counts of a document, and how far it is from its language's references.

Base rules fail a document with fewer than `MIN_WORDS` words or with more than half of its words in
repeated three-word windows. The others are compared with references of their language by the
Jensen-Shannon distance (base 2, so 0 to 1):

* character classes: upper case, digits, white space, sentence marks, the rest, other letters;
* common words: the `COMMON` words found in most documents of the language, and all other words.

A reference is the mean histogram of the language's documents that pass the base rules, over all
documents. A distance counts only from `MIN_CHARS` characters or `GUARD_WORDS` words on; shorter
documents are kept.

Only DataFrame functions: one pass finds the common words, one makes the counts row by row without
a shuffle, and the references are a few rows. Languages are joined by broadcast up to
`BROADCAST_LANGS` of them, by a plain join beyond.

Defined cases: a null text has no words and fails; a null language is a language of its own; a
language with one document is its own reference; repeated rows each get their result; an empty
table gives an empty result; extra columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fastbreak.llm.common import materialize, other_columns_aside, words

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
COMMON = 16
MIN_CHARS, GUARD_WORDS = 200, 100
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.235, 0.295
BROADCAST_LANGS = 10_000

#: Classes counted by pattern: upper case, digits, white space, sentence marks, the rest. Other letters are what is left.
CLASSES = (r"\p{Lu}", r"[0-9]", r"[\x20\x09-\x0D]", r"[.,;:?!'\"()\-]", r"[^\p{L}0-9\x20\x09-\x0D.,;:?!'\"()\-]")
POS_BITS = 20


def lang_key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c), F.lit(""))


def common_words(docs: DataFrame, k: int = COMMON) -> DataFrame:
    """(_q_lang, _q_common): the k words in most documents of each language; ties by code point."""
    seen = docs.select(lang_key(F.col("lang")).alias("_q_lang"), F.explode(F.array_distinct(words(F.col("text")))).alias("w"))
    counts = seen.groupBy("_q_lang", "w").count()
    best = W.partitionBy("_q_lang").orderBy(F.desc("count"), "w")
    top = counts.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("r", "w")))
    return top.groupBy("_q_lang").agg(F.transform(ordered, lambda x: x["w"]).alias("_q_common"))


def n_repeat_words(w: Column) -> Column:
    """Words inside three-word windows that occur at least twice."""
    last = F.size(w) - 3
    at = F.sequence(F.lit(0), last)
    gram = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    hashes = F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    # different hashes are different windows; where some agree, windows are sorted by part of the hash and
    # place in one number and neighbours compared as text; where neighbours agree in that part and differ
    # as text, and where a text is too long for the number, windows are sorted as text
    packed = F.sort_array(F.transform(hashes, lambda h, i: F.shiftleft(h, POS_BITS).bitwiseOR(i.cast("bigint"))))
    sorted_grams = F.sort_array(F.transform(at, lambda i: F.struct(gram(i).alias("g"), i.alias("p"))))
    place = lambda x: x.bitwiseAND(F.lit((1 << POS_BITS) - 1)).cast("int")
    near = lambda x, y: F.coalesce(F.shiftright(x, POS_BITS) == F.shiftright(y, POS_BITS), F.lit(False))
    covered = lambda p: F.size(F.array_distinct(F.flatten(F.transform(p, lambda i: F.array(i, i + 1, i + 2)))))

    bind = lambda a, f: F.get(F.transform(F.array(a), f), F.lit(0))

    def by_hash(s: Column) -> Column:
        """Null if different windows share the part of the hash."""
        again = F.filter(s, lambda x, k: near(x, F.get(s, k - 1)) | near(x, F.get(s, k + 1)))
        return bind(again, lambda a: F.when(~F.exists(F.transform(a, lambda x, k: near(x, F.get(a, k - 1)) & (gram(place(x)) != gram(place(F.get(a, k - 1))))), lambda x: x), covered(F.transform(a, place))))

    def by_text(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False))
        return covered(F.transform(F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1))), lambda x: x["p"]))

    exact = F.coalesce(F.when(last < 1 << POS_BITS, bind(packed, by_hash)), bind(sorted_grams, by_text))
    return F.when(last < 0, 0).when(F.size(F.array_distinct(hashes)) == last + 1, 0).otherwise(exact).cast("bigint")


def features(docs: DataFrame, common: DataFrame, small: bool) -> DataFrame:
    """Base counts and both histograms of every document, as _q_ columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("_q_lang", lang_key(F.col("lang"))).join(F.broadcast(common) if small else common, "_q_lang", "left")
    df = df.withColumn("_q_w", words(F.col("text")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = [F.regexp_count(text, F.lit(c)).cast("bigint") for c in CLASSES]
    df = df.withColumns({"_q_len": F.length(text).cast("bigint"), "_q_lines": lines, "_q_counted": F.array(*counted), "_q_n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint")})
    places = F.filter(F.transform("_q_w", lambda x: F.array_position("_q_common", x)), lambda p: p > 0)
    df = df.withColumn("_q_places", F.coalesce(places, F.array().cast("array<bigint>")))
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    hist = F.transform(F.sequence(F.lit(1), F.greatest(F.coalesce(F.size("_q_common"), F.lit(0)), F.lit(1))), lambda k: F.size(F.filter("_q_places", lambda p: p == k)).cast("bigint"))
    df = df.withColumns(
        {
            "_q_n_words": F.size("_q_w").cast("bigint"),
            "_q_word_chars": F.col("_q_len") - F.get("_q_counted", F.lit(2)),
            "_q_n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("bigint"),
            "_q_n_repeat_words": n_repeat_words(F.col("_q_w")),
            "_q_chars": F.concat("_q_counted", F.array(F.col("_q_len") - total(F.col("_q_counted")))),
            "_q_hist": F.concat(hist, F.array((F.size("_q_w") - F.size("_q_places")).cast("bigint"))),
        }
    )
    failed = (F.col("_q_n_words") < MIN_WORDS) | (100 * F.col("_q_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_q_n_words"))
    return df.withColumn("_q_base_failed", failed).drop("_q_w", "_q_lines", "_q_counted", "_q_places", "_q_common")


def shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: x / total)


def references(featured: DataFrame) -> DataFrame:
    """(_q_lang, _q_char_ref, _q_word_ref): mean histograms over the documents that pass the base rules."""
    good = featured.where(~F.col("_q_base_failed"))
    rows = good.select("_q_lang", F.explode(F.array(
        F.struct(F.lit("_q_char_ref").alias("kind"), shares(F.col("_q_chars"), F.col("_q_len")).alias("h")),
        F.struct(F.lit("_q_word_ref").alias("kind"), shares(F.col("_q_hist"), F.col("_q_n_words")).alias("h")),
    )).alias("x"))
    means = rows.select("_q_lang", "x.kind", F.posexplode("x.h").alias("bin", "share")).groupBy("_q_lang", "kind", "bin").agg(F.avg("share").alias("share"))
    arrays = means.groupBy("_q_lang", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "share"))), lambda x: x["share"]).alias("h"))
    pick = lambda kind: F.first(F.when(F.col("kind") == kind, F.col("h")), ignorenulls=True).alias(kind)
    return arrays.groupBy("_q_lang").agg(pick("_q_char_ref"), pick("_q_word_ref"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def judge(featured: DataFrame, refs: DataFrame, small: bool) -> DataFrame:
    """Adds both distances and _q_kept."""
    df = featured.join(F.broadcast(refs) if small else refs, "_q_lang", "left")
    df = df.withColumns(
        {
            "_q_char_distance": F.when(F.col("_q_len") >= MIN_CHARS, distance(shares(F.col("_q_chars"), F.col("_q_len")), F.col("_q_char_ref"))),
            "_q_word_distance": F.when(F.col("_q_n_words") >= GUARD_WORDS, distance(shares(F.col("_q_hist"), F.col("_q_n_words")), F.col("_q_word_ref"))),
        }
    )
    near = lambda c, most: F.coalesce(F.col(c) <= most, F.lit(True))
    return df.withColumn("_q_kept", ~F.col("_q_base_failed") & near("_q_char_distance", MAX_CHAR_DISTANCE) & near("_q_word_distance", MAX_WORD_DISTANCE))


def learn(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame, bool]:
    """(counts of every document with the columns `keep`, references, whether languages are few)."""
    common = materialize(common_words(docs), "common")
    small = common.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS
    featured = materialize(features(docs, common, small).select(*keep, *(c for c in COLUMNS)), "counts")
    return featured, materialize(references(featured), "references"), small


COLUMNS = ("_q_lang", "_q_len", "_q_n_words", "_q_word_chars", "_q_n_symbols", "_q_n_dup_lines", "_q_n_repeat_words", "_q_chars", "_q_hist", "_q_base_failed")


@other_columns_aside("text", "lang")
def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    # counts are written beside the documents: a filter over them would be pushed below the counting and repeat it
    featured, refs, small = learn(docs, docs.columns)
    return judge(featured, refs, small).where("_q_kept").select(*docs.columns)


def op7_quality_rules(docs: DataFrame) -> DataFrame:
    featured, refs, small = learn(docs.select("doc_id", "text", "lang"), ["doc_id"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judge(featured, refs, small).select("doc_id", *(F.col(f"_q_{c}").alias(c) for c in names))


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS lang, coalesce(text, '') AS t,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
df AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(list_distinct(w)) AS w FROM d) GROUP BY ALL),
common AS (SELECT lang, w, r FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, encode(w)) AS r FROM df) WHERE r <= {COMMON}),
known AS (SELECT lang, max(r) AS k FROM common GROUP BY lang),
pos AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
gram AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM pos),
again AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM gram),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM again WHERE n > 1) GROUP BY rid),
ln AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
base AS (
  SELECT d.rid, doc_id, lang, len(w) AS n_words, length(t) AS len, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         coalesce(ln.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         [{", ".join("len(regexp_extract_all(t, '" + c.replace("'", "''") + "'))" for c in CLASSES)}] AS c
  FROM d LEFT JOIN ln USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, list_concat(c, [len - list_sum(c)]) AS chars, len - c[3] AS word_chars,
             n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base),
tok AS (SELECT rid, r, count(*) AS n FROM (SELECT rid, lang, unnest(w) AS w FROM d) JOIN common USING (lang, w) GROUP BY ALL),
cell AS (
  SELECT b.rid, b.lang, 'w' AS kind, x.r AS bin, coalesce(tok.n, 0) / b.n_words AS share
  FROM b JOIN (SELECT lang, r FROM common) x ON x.lang = b.lang LEFT JOIN tok ON tok.rid = b.rid AND tok.r = x.r WHERE n_words > 0
  UNION ALL
  SELECT b.rid, b.lang, 'w', k + 1, (b.n_words - coalesce(s.n, 0)) / b.n_words
  FROM b JOIN known ON known.lang = b.lang LEFT JOIN (SELECT rid, sum(n) AS n FROM tok GROUP BY rid) s ON s.rid = b.rid WHERE n_words > 0
  UNION ALL
  SELECT rid, lang, 'c', i, chars[i] / len FROM (SELECT *, unnest(range(1, 7)) AS i FROM b) WHERE len > 0),
ref AS (SELECT lang, kind, bin, avg(share) AS q FROM cell WHERE rid IN (SELECT rid FROM b WHERE NOT base_failed) GROUP BY ALL),
dist AS (
  SELECT rid, kind, sqrt(greatest(sum(CASE WHEN share > 0 THEN share * log2(share / ((share + q) / 2)) ELSE 0 END
                             + CASE WHEN q > 0 THEN q * log2(q / ((share + q) / 2)) ELSE 0 END) / 2, 0)) AS x
  FROM cell JOIN ref USING (lang, kind, bin) GROUP BY ALL)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND (len < {MIN_CHARS} OR coalesce(cd.x, 0) <= {MAX_CHAR_DISTANCE}) AND (n_words < {GUARD_WORDS} OR coalesce(wd.x, 0) <= {MAX_WORD_DISTANCE}) AS kept
FROM b LEFT JOIN dist cd ON cd.rid = b.rid AND cd.kind = 'c' LEFT JOIN dist wd ON wd.rid = b.rid AND wd.kind = 'w'
"""
