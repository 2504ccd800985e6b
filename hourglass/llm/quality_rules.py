"""Quality rules: line-first cleaning with built-in column functions only.

Every line of a text is judged on its own (punctuation, navigation, boilerplate);
failing lines are removed, and a document that loses too large a share of its
characters is rejected.  The whole main path is DataFrame expressions: one map
over the rows, no shuffle, so a hot source or key makes no difference.

Defined results: a null or empty text has no words and is rejected by the base
rule; a line without a word is neither judged nor counted; repeated rows are
judged alike; an empty table gives an empty result; other columns are ignored
by :func:`line_quality` and carried unchanged by :func:`clean_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hourglass.llm.common import SPACE

#: A line must hold a sentence end: a final mark, closing quotes, then space or the line's end.
SENTENCE_END = rf"""[.!?…。！？]["'”’»)\]]*([{SPACE}]|\z)"""
#: Words that end in a run of noise marks.
NOISE_TAIL = rf"(!!|[#*$%&<>]{{2,}})([{SPACE}]|\z)"
#: Separators of menus and breadcrumbs, standing alone.
NAV_MARK = rf"(^|[{SPACE}])[|>»•·]+"
#: Phrases of site furniture and licence notices.
BOILERPLATE = (r"(?i)(all rights reserved|licensed under|privacy policy|terms of (use|service)|cookie policy|"
               r"accept cookies|enable javascript|lorem ipsum|subscribe to our|sign up for our|share this page|"
               r"click here to)")
SYMBOLS = r"[#*$%&|<>]"

NOISE_SHARE = 30      # per cent of a line's words with a noise tail
NAV_SHARE = 20        # navigation marks per hundred words of a line
LOST_SHARE = 30       # per cent of a document's line characters that may be removed

PASS, BAD_PUNCTUATION, NAVIGATION, BOILER = 0, 1, 2, 3


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, rf"[{SPACE}]+", -1), "")


def _line_code(line: Column, noise_share: int, nav_share: int) -> Column:
    """The rule a line fails (0: none; lines without a word pass)."""
    n = F.regexp_count(line, F.lit(rf"[^{SPACE}]+"))
    return (F.when(n == 0, F.lit(PASS))
            .when(line.rlike(BOILERPLATE), F.lit(BOILER))
            .when(F.regexp_count(line, F.lit(NAV_MARK)) * 100 > n * nav_share, F.lit(NAVIGATION))
            .when(F.regexp_count(line, F.lit(NOISE_TAIL)) * 100 > n * noise_share, F.lit(BAD_PUNCTUATION))
            .when(~line.rlike(SENTENCE_END), F.lit(BAD_PUNCTUATION))
            .otherwise(F.lit(PASS)))


def with_quality(docs: DataFrame, text_col: str = "text", out: str = "quality", noise_share: int = NOISE_SHARE,
                 nav_share: int = NAV_SHARE, lost_share: int = LOST_SHARE, min_words: int = 50,
                 repeat_share: int = 50) -> DataFrame:
    """``docs`` with one struct column ``out``: counts, verdicts and the cleaned text.

    Steps are separate projections under private names, so that each array is computed once.
    """
    p = "__hourglass_"
    own = docs.columns
    t, w, ln, g, wl, lc, sg, di = (F.col(p + x) for x in ("t", "w", "ln", "g", "wl", "lc", "sg", "di"))
    step = docs.withColumn(p + "t", F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    step = step.withColumns({p + "w": _words(t), p + "ln": F.split(t, "\n", -1)})
    n = F.size(w)
    step = step.withColumns({
        # hashes of the 3-word windows, in order (64 bits: equality within one text only)
        p + "g": F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
                                            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
        .otherwise(F.array().cast("array<bigint>")),
        p + "wl": F.filter(ln, lambda x: x.rlike(rf"[^{SPACE}]")),
        p + "lc": F.transform(ln, lambda x: F.struct(x.alias("line"), _line_code(x, noise_share, nav_share).alias("code"))),
    })
    step = step.withColumn(p + "sg", F.when(
        F.size(F.array_distinct(g)) < F.size(g),
        F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    step = step.withColumn(p + "di", F.filter(
        sg, lambda x, j: ((j > 0) & (F.get(sg, j - 1)["h"] == x["h"])) | (F.get(sg, j + 1)["h"] == x["h"])))
    chars = lambda keep: F.aggregate(
        F.filter(lc, keep), F.lit(0).cast("long"),
        lambda acc, x: acc + F.when(x["line"].rlike(rf"[^{SPACE}]"), F.char_length(x["line"])).otherwise(0))
    failed = lambda code: F.size(F.filter(lc, lambda x: x["code"] == code)).cast("long")
    step = step.withColumns({
        p + "n": n.cast("long"),
        p + "r": F.when(di.isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(F.flatten(
            F.transform(di, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))).cast("long"),
        p + "all": chars(lambda x: F.lit(True)),
        p + "lost": chars(lambda x: x["code"] != PASS),
    })
    c = lambda x: F.col(p + x)
    # The condition is always true.  A projection with it is one that filters are not pushed through: the optimiser
    # would copy the whole expression trees behind a verdict, many times over, into a filter on the scan.
    once = lambda x: F.when(F.monotonically_increasing_id() >= 0, x)
    base = (c("n") < min_words) | (c("r") * 100 > c("n") * repeat_share)
    lost = c("lost") * 100 > c("all") * lost_share
    return step.select(*[F.col(f"`{x}`") for x in own], F.struct(
        c("n").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(wl) - F.size(F.array_distinct(wl))).cast("long").alias("n_dup_lines"),
        c("r").alias("n_repeat_words"), base.alias("base_failed"), once(~base & ~lost).alias("kept"),
        failed(BAD_PUNCTUATION).alias("n_bad_punctuation"), failed(NAVIGATION).alias("n_navigation"),
        failed(BOILER).alias("n_boilerplate"), c("all").alias("line_chars"), c("lost").alias("lost_chars"),
        F.array_join(F.transform(F.filter(lc, lambda x: x["code"] == PASS), lambda x: x["line"]), "\n").alias("cleaned"),
    ).alias(out))


def line_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """One row per document: counts, line-rule tallies, verdicts and the cleaned text."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return with_quality(rows, "text", "quality", **params).select("doc_id", "quality.*")


def clean_documents(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", **params) -> DataFrame:
    """The kept documents with their columns; the text loses its failing lines and ``chars_col`` follows it."""
    q = "__hourglass_quality"
    kept = with_quality(docs, text_col, q, **params).where(F.col(q)["kept"])
    new = {text_col: F.col(q)["cleaned"], chars_col: F.char_length(F.col(q)["cleaned"]).cast("long")}
    return kept.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


# ---------------------------------------------------------------------------------------------------- SQL check

ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^{SPACE}]+') AS w, string_split(t, chr(10)) AS ln FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (
          SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (
            SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1) GROUP BY rid),
l AS (SELECT rid, unnest(ln) AS line FROM w),
lw AS (SELECT rid, line, len(regexp_extract_all(line, '[^{SPACE}]+')) AS n FROM l),
lc AS (SELECT rid, line, n, CASE
         WHEN regexp_matches(line, '{BOILERPLATE}') THEN {BOILER}
         WHEN len(regexp_extract_all(line, '{NAV_MARK}')) * 100 > n * {NAV_SHARE} THEN {NAVIGATION}
         WHEN len(regexp_extract_all(line, '{NOISE_TAIL}')) * 100 > n * {NOISE_SHARE} THEN {BAD_PUNCTUATION}
         WHEN NOT regexp_matches(line, '{SENTENCE_END.replace("'", "''")}') THEN {BAD_PUNCTUATION}
         ELSE {PASS} END AS code FROM lw WHERE n > 0),
la AS (SELECT rid, count(*) - count(DISTINCT line) AS dup, sum(length(line)) AS total,
              coalesce(sum(length(line)) FILTER (code <> {PASS}), 0) AS lost,
              count(*) FILTER (code = {BAD_PUNCTUATION}) AS np, count(*) FILTER (code = {NAVIGATION}) AS nn,
              count(*) FILTER (code = {BOILER}) AS nb FROM lc GROUP BY rid),
f AS (SELECT w.rid, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS n_symbols,
             coalesce(la.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
             coalesce(total, 0) AS line_chars, coalesce(lost, 0) AS lost_chars,
             coalesce(np, 0) AS n_bad_punctuation, coalesce(nn, 0) AS n_navigation, coalesce(nb, 0) AS n_boilerplate
      FROM w LEFT JOIN rep USING (rid) LEFT JOIN la USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (lost_chars * 100 > line_chars * {LOST_SHARE}) AS kept,
       n_bad_punctuation::BIGINT AS n_bad_punctuation, n_navigation::BIGINT AS n_navigation,
       n_boilerplate::BIGINT AS n_boilerplate, line_chars::BIGINT AS line_chars, lost_chars::BIGINT AS lost_chars
FROM b
"""
