"""Quality rules: per-document counts, and adaptive thresholds from mergeable quantile sketches per language and source.

Everything is DataFrame code. The sketch of a measure in one (language, source) is a histogram over bins of bounded relative
width (the leading BITS bits of the whole-number measure); sketches merge by adding counts, in any order, so partial
aggregation keeps a source with a third of all rows cheap and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

SPACES = r"[\x20\x09-\x0D]+"
BITS = 6
#: measure -> allowance in parts of a thousand beyond the spread, so that a group without any spread has no zero-width fence;
#: each below what the base rules let pass (repeats: 200), so that every measure can reject
MEASURES = {"symbols": 150, "repeats": 100, "dup_lines": 200, "word_length": 3000}
#: How many interquartile spreads beyond the upper quartile a measure may lie.
REACH = 3
#: A threshold is drawn towards that of the language, and a language's towards that of all, by the weight of so many documents.
PRIOR = 5


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def _repeat_words(words: Column) -> Column:
    """Words covered by 5-word windows that occur at least twice in the array."""

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["i"]))

        def length(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(5), F.coalesce(F.get(p, j + 1) - x, F.lit(5)))), F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(pairs, positions), length)

    hashes = let(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(5)])))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(words) < 6, F.lit(0).cast("long")).otherwise(some)


def base_counts(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text; null text has no words. carry: with the row as _row."""
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("_row")] if carry else []
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    text = docs.select(*row, "doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    split = text.select("*", words_of(F.col("text")).alias("_w"))
    return split.select(
        *["_row"][: len(row)], "doc_id", "lang", "source",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w")).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
    )


def measures(counts: DataFrame) -> DataFrame:
    """The counts with base_failed and each measure as a whole number, in parts of a thousand."""
    rate = lambda a, b: F.when(F.col(b) > 0, F.expr(f"{a} * 1000 div {b}")).otherwise(0).cast("long")
    return counts.withColumns(
        {
            "base_failed": (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20),
            "symbols": rate("n_symbols", "n_words"),
            "repeats": rate("n_repeat_words", "n_words"),
            "dup_lines": rate("n_dup_lines", "n_lines"),
            "word_length": rate("word_chars", "n_words"),
        }
    )


def sketch_bin(x: Column) -> Column:
    """The lower edge of x's bin: its BITS leading bits."""
    shift = F.greatest(F.lit(0), F.length(F.bin(x)) - BITS)
    return F.call_function("shiftleft", F.call_function("shiftright", x, shift), shift)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n) over the documents that pass the base rules."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), sketch_bin(F.col(m)).alias("bin")) for m in MEASURES]))
    return measured.where("not base_failed").select("lang", "source", rows.alias("r")).groupBy("lang", "source", "r.measure", "r.bin").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """For each keys and measure: documents, and fence = q75 + REACH * (q75 - q25) + allowance, from merged sketches."""
    group = [*keys, "measure"]
    merged = sketch.groupBy(*group, "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*group)
    ranked = merged.select(*group, "bin", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("docs"))
    at = ranked.groupBy(*group).agg(
        F.max("docs").alias("docs"),
        F.min(F.when(F.col("upto") * 4 >= F.col("docs"), F.col("bin"))).alias("q25"),
        F.min(F.when(F.col("upto") * 4 >= F.col("docs") * 3, F.col("bin"))).alias("q75"),
    )
    allowance = F.expr("case measure " + " ".join(f"when '{m}' then {a}" for m, a in MEASURES.items()) + " end")
    return at.select(*group, "docs", (F.col("q75") + REACH * (F.col("q75") - F.col("q25")) + allowance).cast("long").alias("fence"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row for each (lang, source) with a fence for every measure.

    The fence of n documents counts n times, its language's PRIOR times, and so on upwards: a small group follows its
    language, a large one itself, without a step between.
    """
    own, lang, every = fences(sketch, ["lang", "source"]), fences(sketch, ["lang"]), fences(sketch, [])
    drawn = lambda n, fence, above: F.expr(f"({n} * {fence} + {PRIOR} * {above}) div ({n} + {PRIOR})")
    every = every.select(F.col("measure").alias("em"), F.col("fence").alias("ef"))
    lang = lang.join(every, lang["measure"] == every["em"]).select(F.col("lang").alias("l"), F.col("measure").alias("m"), drawn("docs", "fence", "ef").alias("lf"))
    table = own.join(lang, own["lang"].eqNullSafe(lang["l"]) & (own["measure"] == lang["m"]))
    return table.select("lang", "source", "measure", drawn("docs", "fence", "lf").alias("fence")).groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(f"max_{m}") for m in MEASURES]
    )


def _judged(docs: DataFrame, carry: bool) -> DataFrame:
    """Measures with thresholds and kept; the counting runs once, as its result is written before it is read twice."""
    measured = materialize(measures(base_counts(docs, carry)), "counts")
    limit = materialize(thresholds(sketches(measured)).withColumnsRenamed({"lang": "_l", "source": "_s"}), "limits")
    joined = measured.join(limit, measured["lang"].eqNullSafe(limit["_l"]) & measured["source"].eqNullSafe(limit["_s"]), "left")
    beyond = F.lit(False)
    for m in MEASURES:
        beyond = beyond | F.coalesce(F.col(m) > F.col(f"max_{m}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~beyond)


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the thresholds used, for every row of docs(doc_id, text, lang, source).

    kept is false if base_failed, else true unless a measure lies beyond the threshold of the document's language and
    source. Null lang or source is a group of its own; a group of which no document passes the base rules has no
    thresholds and needs none. Null or blank text fails the base rules. Other columns are not read; repeated rows count
    and come out each time; an empty table gives no rows.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return _judged(docs, False).select("doc_id", *counts, *[f"max_{m}" for m in MEASURES])


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality() keeps, all columns as they were."""
    return _judged(docs, True).where("kept").select("_row.*")
