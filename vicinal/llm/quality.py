"""Quality rules from divergence of distributions, in built-in functions only.

Each document has a histogram of character classes and one of the common words
of its language.  Its references are the sums of these over all other documents of
the language.  A document whose Jensen-Shannon distance from a reference exceeds a
limit is rejected, if it is long enough for its histogram to mean anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.llm import shared

#: Frequent words by language.  A language without any is judged by characters alone.
COMMON = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist", "für", "nicht", "auf", "sich", "des", "dem", "ein", "eine", "im", "es"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with", "as", "he", "be", "at", "by", "are", "this"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "es", "lo"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "dans", "est", "par", "pour", "qui", "il", "au", "sur", "pas"),
}
N_COMMON = 20
CLASSES = ("lower", "upper", "digit", "space", "mark", "symbol", "other")
SPACES = r"[\x20\x09-\x0D]+"


def _left(text: Column, others: str) -> Column:
    """The characters of text that ``others``, a pattern of all the rest, doesn't take."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each row: id, key (language with common words, else empty), counts and histograms (arrays of long)."""
    key = F.when(F.col("lang").isin(*COMMON), F.col("lang")).otherwise(F.lit(""))
    lists = F.create_map(*(x for k, v in COMMON.items() for x in (F.lit(k), F.array(*(F.lit(f" {w} ") for w in v)))))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", key.alias("key"), "text", F.array_remove(F.split("text", SPACES), "").alias("words"))
    # A three-word window is named by a 64-bit hash.
    window = "xxhash64(get(words, i), get(words, i + 1), get(words, i + 2))"
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    every = sorted({w for own in COMMON.values() for w in own})
    hits = F.filter("words", lambda w: F.lower(w).isin(*every))
    rows = rows.select(
        "id", "key", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        lines.alias("lines"), F.expr(f"transform(if(size(words) < 3, cast(array() as array<int>), sequence(0, size(words) - 3)), i -> {window})").alias("hashes"),
        F.lower(F.concat(F.lit(" "), F.array_join(hits, "  "), F.lit(" "))).alias("low"), F.length("text").cast("long").alias("chars"),
        F.regexp_replace("text", r"[a-z\x20\x09-\x0D]+", "").alias("signs"), F.try_element_at(lists, F.col("key")).alias("common"),
    )
    # Where windows repeat, they are sorted with their places, which brings equal ones together.
    placed = F.expr("if(size(array_distinct(hashes)) < size(hashes), sort_array(transform(hashes, (h, i) -> struct(h as h, cast(i as bigint) as p))), cast(array() as array<struct<h: bigint, p: bigint>>))")
    rows = rows.select(
        "*", placed.alias("windows"), F.length("signs").cast("long").alias("n_signs"), _left(F.col("signs"), r"[^#*$%&|<>]+").alias("n_symbols"), _left(F.col("signs"), r"[^A-Z]+").alias("upper"),
        _left(F.col("signs"), r"[^0-9]+").alias("digit"), _left(F.col("signs"), r"""[^.,;:!?'"()-]+""").alias("mark"),
    )
    same = "v.h = get(windows, {}).h"
    twice = F.expr(f"filter(windows, (v, i) -> coalesce({same.format('i - 1')}, false) or coalesce({same.format('i + 1')}, false))")
    common = F.array(*(F.expr(f"coalesce((octet_length(low) - octet_length(replace(low, get(common, {k}), ''))) div octet_length(get(common, {k})), 0L)") for k in range(N_COMMON)))
    rows = rows.select(
        "id", "key", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.sort_array(F.transform(twice, lambda v: v["p"])).alias("places"),
        F.array(F.expr("word_chars - n_signs"), "upper", "digit", F.expr("chars - word_chars"), "mark", "n_symbols", F.expr("n_signs - upper - digit - mark - n_symbols")).alias("by_class"), common.alias("by_word"),
    )
    covered = F.expr("aggregate(transform(places, (p, i) -> least(3L, coalesce(p - get(places, i - 1), 3L))), 0L, (s, x) -> s + x)")
    rows = rows.select("id", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "by_class", "by_word")
    rest = F.expr("greatest(0L, n_words - aggregate(by_word, 0L, (s, x) -> s + x))")
    return rows.withColumn("by_word", F.when(F.col("key") != "", F.concat("by_word", F.array(rest))).otherwise(F.expr("cast(array() as array<bigint>)")))


def distance(a: str, b: str) -> Column:
    """Jensen-Shannon distance (base 2) of two array columns of counts; null if either is empty or all zero."""
    total = "nullif(aggregate({0}, 0D, (s, x) -> s + x), 0D)"
    p = f"transform({a}, x -> x / {total.format(a)})"
    q = f"transform({b}, x -> x / {total.format(b)})"
    term = "if(x <= 0D, 0D, x * log2(2D * x / (x + y)))"
    both = f"zip_with({p}, {q}, (x, y) -> {term} + {term.replace('x', '#').replace('y', 'x').replace('#', 'y').replace('y + x', 'x + y')})"
    return F.expr(f"sqrt(abs(0.5D * aggregate({both}, 0D, (s, x) -> s + x)))")


def judge(docs: DataFrame, limit_class: float = 0.3, limit_word: float = 0.25, least_words: int = 50, least_words_common: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts, distances and verdict of every document, one row for each row.

    id_col; n_words; word_chars; n_symbols; n_dup_lines; n_repeat_words;
    base_failed (fewer than 50 words, or more than half of them in three-word
    windows that occur twice); kept (not base_failed and no distance above its
    limit); js_class and js_word (null where the text is shorter than its least
    number of words, and where the language has no other document with any).  A
    null text has no words; a null or unknown language has the reference of all
    such documents, and no common words; null and repeated ids stay as they are, and
    equal rows have equal results; an empty table gives no rows; a very long text is
    read as a whole, its windows told apart by 64-bit hashes; other columns are not
    read, whatever their names.
    """
    rows = shared.cut(measured(docs, id_col, text_col, lang_col))
    # One row for each language that has common words, and one for the others.
    total = [F.array(*(F.sum(F.get(c, F.lit(k)).cast("double")) for k in range(n))).alias(f"all_{c}") for c, n in (("by_class", len(CLASSES)), ("by_word", N_COMMON + 1))]
    reference = rows.groupBy("key").agg(*total)
    both = rows.join(F.broadcast(reference), "key")
    both = both.withColumns({f"all_{c}": F.zip_with(f"all_{c}", c, lambda x, y: x - y) for c in ("by_class", "by_word")}).select(
        "*", F.when(F.col("n_words") >= least_words, distance("by_class", "all_by_class")).alias("js_class"),
        F.when((F.col("n_words") >= least_words_common) & (F.col("key") != ""), distance("by_word", "all_by_word")).alias("js_word"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    near = (F.coalesce("js_class", F.lit(0.0)) <= limit_class) & (F.coalesce("js_word", F.lit(0.0)) <= limit_word)
    return both.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & near).alias("kept"), "js_class", "js_word")
