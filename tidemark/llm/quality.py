"""Quality rules by distribution divergence (operator 6); DataFrame expressions only.

Each document's character-class histogram and common-word histogram are compared with references of several languages
by Jensen-Shannon distance (square root of the base-2 divergence, 0 to 1); the nearest language counts. The histograms
of short texts are too coarse, so a guard of least length applies to each rule. Base rules (word count, share of words
in repeated 8-word windows) come first.

Windows are compared by a 64-bit hash of their eight words. Work is linear in the text, but for the sort of the windows
of texts that do repeat some.

Defined cases: a null or blank text has no words, so it fails the base rule; its counts are 0; a text of any length is
judged whole; distances at a limit are kept; repeated rows are judged one by one; columns to carry may have any names; an
empty table gives no rows; a long text in a language without a reference fails the word rule. Words are runs of other
characters than space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space, within the brackets of a regular expression.
WHITE = r" \t-\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

# The references. Shares of the character classes in running text (letters without case distinction,
# digits, white space, sentence punctuation, everything else), and shares of a language's commonest words.
CHAR_CLASSES = ("letters", "digits", "spaces", "points", "others")
POINTS = ".,;:!?'\"()-"
CHAR_REFERENCES = {
    "en": (0.800, 0.005, 0.170, 0.023, 0.002),
    "fr": (0.800, 0.005, 0.165, 0.028, 0.002),
    "de": (0.825, 0.005, 0.145, 0.023, 0.002),
    "es": (0.805, 0.005, 0.165, 0.023, 0.002),
}
WORD_REFERENCES = {
    "en": {"the": 0.060, "of": 0.032, "and": 0.027, "to": 0.025, "a": 0.021, "in": 0.019, "is": 0.011, "that": 0.010},
    "fr": {"de": 0.045, "la": 0.028, "le": 0.022, "et": 0.020, "les": 0.019, "des": 0.016, "en": 0.013, "un": 0.010},
    "de": {"der": 0.032, "die": 0.031, "und": 0.026, "in": 0.016, "den": 0.012, "das": 0.010, "von": 0.010, "zu": 0.009},
    "es": {"de": 0.055, "la": 0.034, "que": 0.029, "el": 0.027, "en": 0.024, "y": 0.023, "los": 0.015, "las": 0.010},
}
#: Distances above these reject, from the least lengths on (code points; words).
CHAR_LIMIT, CHAR_GUARD = 0.15, 100
WORD_LIMIT, WORD_GUARD = 0.275, 200


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{WHITE}]+"), lambda w: w != "")


def paired(hashes: Column, apart: int) -> Column:
    """Hash of each element with the one `apart` places on."""
    n = F.size(hashes) - apart
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, apart + 1, n), lambda x, y: F.xxhash64(x, y))


def with_window_hashes(df: DataFrame) -> DataFrame:
    """Adds windows: a hash of each 8-word window, of pairs, pairs of pairs and so on; no values with fewer words.

    Each step is a column of its own, for an expression that occurs twice within one is worked out twice.
    """
    df = df.withColumn("windows", F.when(F.size("words") >= WINDOW, F.transform("words", lambda w: F.xxhash64(w))))
    for apart in (1, 2, 4):
        df = df.withColumn("windows", paired(F.col("windows"), apart))
    return df


def covered(windows: Column):
    """Words under repeated windows: sort (hash, start), keep starts beside an equal hash, add up what each covers anew."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return placed, lambda p: F.sort_array(F.transform(F.filter(p, lambda e, j: (F.get(p, j - 1)["h"] == e["h"]) | (F.get(p, j + 1)["h"] == e["h"])), lambda e: e["i"]))


def new_words(starts: Column) -> Column:
    return F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("total"), F.lit(-WINDOW).alias("last")),
        lambda s, i: F.struct((s["total"] + F.least(F.lit(WINDOW), i - s["last"]).cast("long")).alias("total"), i.alias("last")),
        lambda s: s["total"],
    )


def distance(p: list[Column], q: tuple[float, ...]) -> Column:
    """Jensen-Shannon distance of the shares p to the reference q."""

    def half(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    return F.sqrt(F.greatest(F.lit(0.0), reduce(lambda x, y: x + y, (half(a, F.lit(b)) + half(F.lit(b), a) for a, b in zip(p, q, strict=True))) / 2))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, carry: list[str] | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, char_distance, word_distance (null under the guard) and kept: one row per row of docs.

    With carry, these columns of docs come along in a struct `carried`.
    """
    text = F.col("text")
    common = sorted({w for ws in WORD_REFERENCES.values() for w in ws})
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), *([F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")] if carry else []))
    more = ["carried"] if carry else []
    d = with_window_hashes(d.withColumn("words", words_of(text)).withColumn("lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WHITE}]"))))
    # words of the references: found by their usual spellings, then lower-cased and rid of points at the end
    spellings = [x + end for w in common for x in (w, w.capitalize()) for end in ("", *".,;:!?")]
    known = F.transform(F.filter("words", lambda w: w.isin(*spellings)), lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))))

    def left_by(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, ""))

    d = d.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        left_by(f"[{WHITE}]+").cast("long").alias("word_chars"),
        (F.length(text) - left_by(f"[{re.escape(SYMBOLS)}]+")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(text).alias("n_all"),
        (F.length(text) - left_by(r"\p{L}+")).alias("n_letters"),
        (F.length(text) - left_by("[0-9]+")).alias("n_digits"),
        (F.length(text) - left_by(f"[{re.escape(POINTS)}]+")).alias("n_points"),
        F.sort_array(known).alias("known"),
        "windows",
        *more,
    )
    placed, starts = covered(F.col("windows"))
    # most texts repeat no window: only the others are sorted
    d = d.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed)).withColumn("starts", F.when(F.col("placed").isNotNull(), starts(F.col("placed"))))
    d = d.withColumn("n_repeat_words", F.coalesce(new_words(F.col("starts")), F.lit(0).cast("long")))
    # counts of each common word: its places in the sorted array are one run
    n = F.col("n_words").cast("double")
    shares = {w: F.when(F.array_position("known", w) > 0, (F.size("known") - F.array_position(F.reverse("known"), w) + 1 - F.array_position("known", w) + 1)).otherwise(F.lit(0)) / F.greatest(n, F.lit(1.0)) for w in common}
    d = d.select("*", *(s.alias(f"w_{w}") for w, s in shares.items()))
    total = F.greatest(F.col("n_all").cast("double"), F.lit(1.0))
    chars = [F.col("n_letters") / total, F.col("n_digits") / total, (F.col("n_all") - F.col("word_chars")) / total, F.col("n_points") / total, (F.col("word_chars") - F.col("n_letters") - F.col("n_digits") - F.col("n_points")) / total]
    char_distance = F.least(*(distance(chars, q) for q in CHAR_REFERENCES.values()))

    def to_language(reference: dict[str, float]) -> Column:
        p = [F.col(f"w_{w}") for w in reference]
        rest = F.lit(1.0) - reduce(lambda a, b: a + b, p)
        return distance([*p, F.greatest(rest, F.lit(0.0))], (*reference.values(), 1.0 - sum(reference.values())))

    word_distance = F.least(*(to_language(r) for r in WORD_REFERENCES.values()))
    d = d.withColumn("char_distance", F.when(F.col("n_all") >= CHAR_GUARD, char_distance)).withColumn("word_distance", F.when(F.col("n_words") >= WORD_GUARD, word_distance))
    d = d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    kept = ~F.col("base_failed") & (F.coalesce("char_distance", F.lit(0.0)) <= char_limit) & (F.coalesce("word_distance", F.lit(0.0)) <= word_limit)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("char_distance", 9).alias("char_distance"), F.round("word_distance", 9).alias("word_distance"), kept.alias("kept"), *more)


def _sql() -> str:
    """The same in DuckDB's SQL; windows are compared as lists of words there."""
    white = r"[ \t-\r]"
    common = sorted({w for ws in WORD_REFERENCES.values() for w in ws})

    def half(a: str, b: str) -> str:
        return f"(CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0.0 END)"

    def dist(ps: list[str], qs) -> str:
        return "sqrt(greatest(0.0, (" + " + ".join(f"{half(p, f'{q!r}::DOUBLE')} + {half(f'{q!r}::DOUBLE', p)}" for p, q in zip(ps, qs, strict=True)) + ") / 2))"

    chars = ", ".join(dist(["c1", "c2", "c3", "c4", "c5"], q) for q in CHAR_REFERENCES.values())
    words = ", ".join(dist([*(f'"w_{w}"' for w in r), "greatest(0.0, 1.0::DOUBLE - (" + " + ".join(f'"w_{w}"' for w in r) + "))"], (*r.values(), 1.0 - sum(r.values()))) for r in WORD_REFERENCES.values())
    spelled = {w: [x + e for x in (w, w.capitalize()) for e in ("", *".,;:!?")] for w in common}
    shares = ", ".join(f"len(list_filter(words, lambda x: x IN ({', '.join(repr(s) for s in spelled[w])})))::DOUBLE / greatest(n_words, 1) AS \"w_{w}\"" for w in common)
    return rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{white}+'), lambda x: x <> '') AS words FROM t),
v AS (SELECT row, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8),
x AS (SELECT row, i, count(*) OVER (PARTITION BY row, words[i:i + 7]) AS n FROM v),
r AS (SELECT row, count(DISTINCT place) AS n FROM (SELECT row, unnest(range(i, i + 8)) AS place FROM x WHERE n > 1) GROUP BY row),
c AS (
  SELECT w.row, doc_id, words, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{white}+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[{re.escape(SYMBOLS)}]+', '', 'g')))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines, length(text) AS n_all,
    length(text) - length(regexp_replace(text, '\pL+', '', 'g')) AS n_letters, length(text) - length(regexp_replace(text, '[0-9]+', '', 'g')) AS n_digits,
    length(text) - length(regexp_replace(text, '[{re.escape(POINTS).replace("'", "''")}]+', '', 'g')) AS n_points, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r ON w.row = r.row),
s AS (
  SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    n_letters::DOUBLE / greatest(n_all, 1) AS c1, n_digits::DOUBLE / greatest(n_all, 1) AS c2, (n_all - word_chars)::DOUBLE / greatest(n_all, 1) AS c3,
    n_points::DOUBLE / greatest(n_all, 1) AS c4, (word_chars - n_letters - n_digits - n_points)::DOUBLE / greatest(n_all, 1) AS c5, {shares}
  FROM c),
d AS (SELECT *, CASE WHEN n_all >= {CHAR_GUARD} THEN least({chars}) END AS cd, CASE WHEN n_words >= {WORD_GUARD} THEN least({words}) END AS wd FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(cd, 9) AS char_distance, round(wd, 9) AS word_distance,
  NOT base_failed AND coalesce(cd, 0) <= {CHAR_LIMIT} AND coalesce(wd, 0) <= {WORD_LIMIT} AS kept
FROM d
"""


SQL = _sql()
