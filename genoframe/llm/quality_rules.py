"""Line-first cleaning with Spark SQL expressions only.

Rules judge each line on its own: punctuation (it must end as a sentence, a heading or a
quotation does, not in dots that cut it off; not too many symbols or doubled marks),
navigation (fewer than three words, or entries between separators), boilerplate (known
phrases, some of them only in short lines), and whether it stood before in the text.
Failing lines go, and a document that loses too many of its words is rejected.

Defined results: a null text has no words and is not kept; an empty or blank text
likewise; rows are independent of each other, so repeated rows get equal results;
extra columns of the input are not touched and may have any name; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Phrases that mark a line as boilerplate, looked for in the lower-cased line.
BOILERPLATE = ("licensed under", "all rights reserved", "copyright (c)", "terms of use", "terms of service", "privacy policy", "cookie policy", "subscribe to", "click here")
#: Phrases of page furniture, which sentences may have too: they count in lines of up to SHORT_WORDS words.
FURNITURE = ("read more", "sign in", "sign up", "log in", "share this", "follow us", "powered by", "skip to", "add to cart", "enable javascript", "use cookies", "back to top")
SHORT_WORDS = 12
#: What stands between the entries of a navigation line.
SEPARATORS = (" | ", " • ", " · ", " » ", " > ")
#: The characters that a line may end with, and those that are skipped at its end.
TERMINAL = ".!?:;\"'”’»)]。！？"
TRAILING = " \t\x0b\x0c\r"
#: Words a line must have.
LEAST_WORDS = 3
WHITE = r"[\x20\x09-\x0D]"
INK = r"[^\x20\x09-\x0D]"
#: A text with more words than this goes the way that needs no packed positions.
PACKED_WORDS = 1 << 24


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+; a null text has none."""
    text = F.coalesce(text, F.lit(""))
    plain = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")
    return F.filter(F.when(text.rlike(r"[\x09\x0B-\x0D]"), F.split(text, r"[\x20\x09-\x0D]+")).otherwise(plain), lambda w: w != "")


def _covered(positions: Column) -> Column:
    """How many words windows of three at these ascending positions cover."""
    return F.aggregate(
        positions,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3).cast("long"), p - a["last"])).alias("n"), p.cast("long").alias("last")),
        lambda a: a["n"],
    )


def _repeated_exact(w: Column) -> Column:
    """For any text: sorts the windows themselves, each followed by its position."""
    keys = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", w[i], w[i + 1], w[i + 2], F.lpad(i.cast("string"), 10, "0"))))
    window = lambda k: F.substring_index(k, " ", 3)
    twice = lambda s: F.filter(s, lambda k, i: ((i > 0) & (window(F.get(s, i - 1)) == window(k))) | (window(F.coalesce(F.get(s, i + 1), F.lit(""))) == window(k)))
    return let(keys, lambda s: _covered(F.array_sort(F.transform(twice(s), lambda k: F.substring_index(k, " ", -1).cast("long")))))


def repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are compared by a hash with the position in the low bits, sorted as
    longs; where hashes meet, the words decide, and a text in which different
    windows share a hash is sorted by the windows instead.
    """
    mask = (1 << 24) - 1
    keys = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))))
    at = lambda k: k.bitwiseAND(F.lit(mask)).cast("int")

    def same_words(a: Column, b: Column) -> Column:
        i, j = at(a), at(b)
        return (w[i] == w[j]) & (w[i + 1] == w[j + 1]) & (w[i + 2] == w[j + 2])

    def result(s: Column) -> Column:
        meets = F.array_compact(F.transform(s, lambda k, i: F.when(F.shiftright(k.bitwiseXOR(F.get(s, i + 1)), 24) == 0, i)))
        covered = lambda m: F.array_sort(F.array_distinct(F.flatten(F.transform(m, lambda i: F.array(s[i].bitwiseAND(F.lit(mask)), s[i + 1].bitwiseAND(F.lit(mask)))))))
        return let(meets, lambda m: F.when(F.size(m) == 0, F.lit(0).cast("long")).when(F.exists(m, lambda i: ~same_words(s[i], s[i + 1])), F.lit(-1).cast("long")).otherwise(_covered(covered(m))))

    n = F.size(w)
    return F.when(n < 3, F.lit(0).cast("long")).when(n >= PACKED_WORDS, _repeated_exact(w)).otherwise(let(let(keys, result), lambda q: F.when(q >= 0, q).otherwise(_repeated_exact(w))))


def _times(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def _any(text: Column, parts: tuple) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | text.contains(part)
    return out


def _more_words(line: Column, n: int) -> Column:
    """Whether a line has n words or more."""
    return line.rlike(INK + (f"+{WHITE}+{INK}" * (n - 1)))


def line_ends_badly(line: Column) -> Column:
    """Whether a line does not end as a sentence, a heading or a quotation does, or has too few words."""
    bare = F.rtrim(line, F.lit(TRAILING))
    return ~F.contains(F.lit(TERMINAL), F.right(bare, F.lit(1))) | bare.endswith("...") | ~_more_words(line, LEAST_WORDS)


def line_marked(line: Column, max_symbol_ratio: float = 0.1, max_mark_ratio: float = 0.1) -> Column:
    """Whether a line breaks a rule of symbols, doubled marks, separators of navigation or boilerplate."""
    symbols = F.regexp_count(line, F.lit(f"[{SYMBOLS}]"))
    bars = sum((_times(line, x) for x in SEPARATORS), F.lit(0.0))
    lowered = F.lower(line)
    return (
        (symbols > F.greatest(F.lit(2), max_symbol_ratio * F.length(line)))
        | (bars >= 2)
        | (2 * (_times(line, "!!") + _times(line, "??")) > F.greatest(F.lit(2), max_mark_ratio * F.length(line)))
        | _any(lowered, BOILERPLATE)
        | (_any(lowered, FURNITURE) & ~_more_words(line, SHORT_WORDS + 1))
    )


def suspect(text: Column, n_symbols: Column) -> Column:
    """Whether a text has what line_marked() looks for: without it, no line of it is marked."""
    lowered = F.lower(text)
    return (n_symbols >= 2) | _any(text, ("!!", "??", *SEPARATORS[1:4])) | _any(lowered, BOILERPLATE + FURNITURE)


def measured(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_lost: float = 0.5, max_symbol_ratio: float = 0.1) -> DataFrame:
    """One row per document: the counts of its words and lines, what cleaning leaves, and the verdict.

    The rules of line_marked() are evaluated only where the whole text is suspect().
    """
    base = df.select(F.col(id_column).alias("__id"), F.coalesce(F.col(text_column), F.lit("")).alias("__t"))
    base = base.select("__id", "__t", word_array(F.col("__t")).alias("__w"), F.split("__t", "\n").alias("__l"))
    w, text = F.col("__w"), F.col("__t")
    base = base.select(
        "__id", "__t",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.filter(F.col("__l"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__f"),
        repeated_words(w).alias("n_repeat_words"),
    ).withColumn("__d", F.array_distinct("__f"))
    base = base.withColumn("__e", F.filter(F.col("__d"), lambda x: ~line_ends_badly(x)))
    unmarked = F.filter(F.col("__e"), lambda x: ~line_marked(x, max_symbol_ratio))
    base = base.withColumn("__k", F.when(suspect(text, F.col("n_symbols")), unmarked).otherwise(F.col("__e")))
    count = F.aggregate(F.col("__k"), F.lit(0).cast("long"), lambda a, x: a + F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    base = base.withColumn("n_clean_words", F.when(F.size("__k") == F.size("__f"), F.col("n_words")).otherwise(count)).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("n_clean_words") >= (1 - max_lost) * F.col("n_words"))
    return base.select(
        F.col("__id").alias(id_column), "n_words", "word_chars", "n_symbols", (F.size("__f") - F.size("__d")).cast("long").alias("n_dup_lines"),
        "n_repeat_words", "base_failed", kept.alias("kept"), "n_clean_words", F.array_join("__k", "\n").alias("clean_text"),
    )


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return measured(docs).drop("clean_text")


#: The base columns and the verdict in DuckDB's SQL.
OP1_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         row_number() OVER () AS r
  FROM documents),
g AS (SELECT r, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] AS gram
      FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
cover AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(3) AS s(k) GROUP BY r),
f AS (SELECT r, line, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n,
             rtrim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS bare,
             len(regexp_extract_all(line, '[{SYMBOLS}]')) AS symbols,
             {" + ".join(f"(length(line) - length(replace(line, '{x}', ''))) / 3" for x in SEPARATORS)} AS bars,
             (length(line) - length(replace(line, '!!', ''))) / 2 + (length(line) - length(replace(line, '??', ''))) / 2 AS marks
      FROM (SELECT r, unnest(list_distinct(lines)) AS line FROM w)),
k AS (SELECT r, sum(n) AS n FROM f
      WHERE NOT (NOT contains('{TERMINAL.replace("'", "''")}', right(bare, 1)) OR ends_with(bare, '...') OR n < {LEAST_WORDS}
        OR symbols > greatest(2, 0.1 * length(line)) OR bars >= 2 OR 2 * marks > greatest(2, 0.1 * length(line))
        OR {" OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)}
        OR n <= {SHORT_WORDS} AND ({" OR ".join(f"contains(lower(line), '{p}')" for p in FURNITURE)})) GROUP BY r),
b AS (SELECT doc_id, w.r, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[{SYMBOLS}]'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(cover.n, 0)::BIGINT AS n_repeat_words, coalesce(k.n, 0)::BIGINT AS n_clean_words
      FROM w LEFT JOIN cover ON w.r = cover.r LEFT JOIN k ON w.r = k.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_clean_words >= 0.5 * n_words AS kept, n_clean_words
FROM b
"""
