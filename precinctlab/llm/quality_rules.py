"""Line-first cleaning with DataFrame functions only.

Each line is held against punctuation, navigation and boilerplate rules; lines
that fail are removed; a document is rejected if it loses too much of its text.

Cases: a null or empty text has no words, fails the base rules and is not kept.
Repeated rows give repeated results, extra columns of ``clean_documents`` pass
through, an empty table gives an empty result.  Long texts are handled whole;
the 8-word windows of a text live in one row, never in a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MAX_LOST = 0.3
#: Marks per word beyond which a line is noise; sentence marks are not counted.
MAX_MARKS_PER_WORD = 0.4
NAVIGATION = r"(?i)^\W*(home|menu|login|log in|sign in|sign up|register|search|next|previous|prev|back|back to top|contact|contact us|about|about us|sitemap|share|tweet|read more|subscribe|skip to content)(\W+(home|menu|login|log in|sign in|sign up|register|search|next|previous|prev|back|back to top|contact|contact us|about|about us|sitemap|share|tweet|read more|subscribe|skip to content))*\W*$"
BOILERPLATE = r"(?i)(all rights reserved|cookie policy|privacy policy|terms of (use|service)|we use cookies|accept (all )?cookies|enable javascript|lorem ipsum|click here to|subscribe to our newsletter|powered by)"


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def line_passes(line: Column) -> Column:
    """The verdict on one line that has a word."""
    spaces = F.length(F.trim(line)) - F.length(F.translate(F.trim(line), " ", ""))
    about_words = spaces + 1
    marks = _count(line, SYMBOLS + "!{}\\^~=_")
    no_sentence = (about_words >= 10) & ~line.rlike(r"[.?!,;:…。，]")
    return ~(
        (marks > MAX_MARKS_PER_WORD * about_words)
        | no_sentence
        | ((_count(line, "|>»·") >= 2) & (about_words <= 12))
        | ((about_words <= 24) & line.rlike(NAVIGATION))
        | ((about_words <= 40) & line.rlike(BOILERPLATE))
    )


def n_repeat_words(words: DataFrame) -> DataFrame:
    """Add ``n_repeat_words`` from columns ``words`` and ``n_words``: words in windows found twice or more.

    Windows are compared by 64-bit hash inside one row.  Only rows with a
    repeated hash sort theirs; the words covered follow from the sorted starts
    of the repeated windows.
    """
    df = words.withColumn("_h", F.when(F.col("n_words") > WINDOW, F.transform(F.sequence(F.lit(1), F.col("n_words").cast("int") - WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))))
    df = df.withColumn("_again", F.coalesce(F.size(F.array_distinct("_h")) < F.size("_h"), F.lit(False))).drop("words")
    df = df.withColumn("_s", F.when(F.col("_again"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    here = lambda j: F.col("_s")[j]["h"]
    twice = lambda j: ((j > 0) & (here(j) == here(j - 1))) | ((j + 1 < F.size("_s")) & (here(j) == here(j + 1)))
    starts = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size("_s") - 1), twice), lambda j: F.col("_s")[j]["i"]))
    df = df.withColumn("_p", F.when(F.col("_again"), starts)).drop("_h", "_s")
    gap = lambda a, k: a + F.least(F.lit(WINDOW), F.col("_p")[k] - F.col("_p")[k - 1]).cast("long")
    covered = F.aggregate(F.sequence(F.lit(1), F.size("_p") - 1), F.lit(WINDOW).cast("long"), gap)
    return df.withColumn("n_repeat_words", F.when(F.col("_again"), covered).otherwise(F.lit(0).cast("long"))).drop("_again", "_p")


def assess(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """All columns of ``docs`` under ``row``, with the base counts, ``clean_text``, ``base_failed`` and ``kept``."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    df = df.withColumn("text", F.coalesce(F.col("row.text"), F.lit("")))
    df = df.withColumn("words", words_of(F.col("text"))).withColumn("lines", F.split("text", "\n", -1))
    df = df.withColumn("word_lines", F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.regexp_replace("text", SPACE, "")).cast("long"),
        "n_symbols": _count(F.col("text"), SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("word_lines") - F.size(F.array_distinct("word_lines"))).cast("long"),
        "clean_text": F.array_join(F.filter("lines", lambda x: ~x.rlike(r"[^\x20\x09-\x0D]") | line_passes(x)), "\n"),
        "had": F.length(F.regexp_replace("text", SPACE, "")),
    })
    df = df.drop("lines", "word_lines", "text")
    df = n_repeat_words(df)
    df = df.withColumn("left", F.length(F.regexp_replace("clean_text", SPACE, "")))
    df = df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    verdict = (F.col("left") > 0) & (F.col("had") - F.col("left") <= F.lit(max_lost) * F.col("had"))
    return df.withColumn("kept", ~F.col("base_failed") & verdict).withColumn("lost_chars", (F.col("had") - F.col("left")).cast("long"))


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: the base counts and verdicts."""
    return assess(docs).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


def clean_documents(docs: DataFrame) -> DataFrame:
    """Kept documents with their failed lines removed, in the columns of ``docs`` (n_chars, if there, follows the text)."""
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    row = F.struct(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])
    # a filter on ``kept`` would be pushed down with all its array expressions written out again; a generator is not
    return assess(docs).select(F.explode_outer(F.when(F.col("kept"), F.array(row))).alias("row")).where("row is not null").select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, string_split(text, chr(10)) AS lines FROM d),
l AS (SELECT *, len(words) AS n_words, list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS wl,
  length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars FROM w),
g AS (SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, n_words - 6)) AS i FROM l WHERE n_words >= 8)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
v AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8))) AS n_repeat_words FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM r) GROUP BY doc_id),
t AS (SELECT l.doc_id, n_words, word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(wl) - len(list_distinct(wl)) AS n_dup_lines, coalesce(v.n_repeat_words, 0) AS n_repeat_words,
  coalesce(list_sum(list_transform(list_filter(wl, lambda x:
    length(regexp_replace(x, '[^#*$%&|<>!{}\\^~=_]', '', 'g')) > 0.4 * (length(trim(x, ' ')) - length(replace(trim(x, ' '), ' ', '')) + 1)
    OR ((length(trim(x, ' ')) - length(replace(trim(x, ' '), ' ', '')) + 1) >= 10 AND NOT regexp_matches(x, '[.?!,;:\x{2026}\x{3002}\x{ff0c}]'))
    OR (length(regexp_replace(x, '[^|>\x{bb}\x{b7}]', '', 'g')) >= 2 AND (length(trim(x, ' ')) - length(replace(trim(x, ' '), ' ', '')) + 1) <= 12)
    OR ((length(trim(x, ' ')) - length(replace(trim(x, ' '), ' ', '')) + 1) <= 24 AND regexp_matches(x, 'NAVIGATION_RULE'))
    OR ((length(trim(x, ' ')) - length(replace(trim(x, ' '), ' ', '')) + 1) <= 40 AND regexp_matches(x, 'BOILERPLATE_RULE'))
  ), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')))), 0) AS lost
  FROM l LEFT JOIN v USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM t)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars > lost AND lost <= 0.3 * word_chars AS kept, CAST(lost AS BIGINT) AS lost_chars
FROM b
""".replace("NAVIGATION_RULE", NAVIGATION).replace("BOILERPLATE_RULE", BOILERPLATE)
