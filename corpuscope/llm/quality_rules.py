"""Quality rules whose thresholds follow each language and source, from mergeable quantile sketches; DataFrame functions only."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuscope.llm.common import SPACE_WORD, stored
from corpuscope.operators.joins import lookup

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: A document below this many words, or with more than this percentage of repeated ones, fails in any group.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Rules in integers: the least width that a quartile range counts as, and whether values can be too low.
RULES = {
    "word_length": (250, True),  # thousandths of a character per word
    "symbols": (500, False),  # for 10,000 words
    "repeated_words": (1000, False),  # for 10,000 words
    "repeated_lines": (1000, False),  # for 10,000 lines
}


def measure_texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """Counts of each whole text.  Only a text in which two windows of three words have the same hash sorts
    its windows, as texts, to find the places of the equal ones."""
    c = F.col
    given = docs.select(c(id_col).alias("doc_id"), c(lang_col).alias("lang"), c(source_col).alias("source"), F.coalesce(c(text_col), F.lit("")).alias("text"))
    split = given.select(
        "doc_id", "lang", "source", F.array_remove(F.split("text", SPACES), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.rlike(line, F.lit(SPACE_WORD))).alias("lines"),
        F.regexp_count("text", F.lit(SYMBOLS)).alias("n_symbols"), (F.length("text") - F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]"))).alias("word_chars"))
    n = F.size("words")
    places = F.when(n > 2, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    window = lambda i: (F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    told = split.select(
        "doc_id", "lang", "source", "words", "n_symbols", "word_chars", n.alias("n_words"), F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), F.transform(places, lambda i: F.xxhash64(*window(i))).alias("hashes"))
    told = told.select("*", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(
        F.transform(places, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("window"), i.alias("at"))))).alias("windows")).drop("words", "hashes")
    same = lambda x, k: F.get("windows", k)["window"].eqNullSafe(x["window"])
    again = F.filter("windows", lambda x, k: same(x, k + 1) | same(x, k - 1))
    covered = F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2)))))
    whole = lambda name: c(name).cast("long").alias(name)
    return told.select(
        "doc_id", "lang", "source", *map(whole, ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")),
        F.when(c("windows").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"))


def rule_values() -> dict[str, Column]:
    per = lambda scale, x, n: F.floor(F.col(x) * scale / F.greatest(F.col(n), F.lit(1))).cast("long")
    return {
        "word_length": per(1000, "word_chars", "n_words"), "symbols": per(10_000, "n_symbols", "n_words"),
        "repeated_words": per(10_000, "n_repeat_words", "n_words"), "repeated_lines": per(10_000, "n_dup_lines", "n_lines"),
    }


def sketch(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, low, high, n): counts of the buckets that the values fall in.

    A bucket is one number below 64 and a thirty-second of a power of two above, so a quantile is off by
    about three per cent at most.  Counts of buckets add up: sketches of parts, sources and languages merge by a sum."""
    shift = "greatest(0, length(bin(value)) - 6)"
    low = F.expr(f"shiftleft(shiftright(value, {shift}), {shift})")
    return values.withColumn("low", low).withColumn("high", F.expr(f"low + shiftleft(1L, {shift}) - 1")).groupBy(
        *keys, "rule", "low", "high").agg(F.count("*").alias("n"))


def fences(sketches: DataFrame, keys: list[str], spread: float) -> DataFrame:
    """One row for each group of ``keys``: docs, and for each rule least and most."""
    group = Window.partitionBy(*keys, "rule")
    ranked = sketches.select("*", F.sum("n").over(group.orderBy("low")).alias("upto"), F.sum("n").over(group).alias("docs"))
    quartiles = ranked.groupBy(*keys, "rule").agg(
        F.max("docs").alias("docs"), F.min(F.when(F.col("upto") * 4 >= F.col("docs"), F.col("low"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("docs") * 3, F.col("high"))).alias("q3"))
    bounds = []
    for rule, (width, both) in RULES.items():
        reach = F.greatest(F.col("q3") - F.col("q1"), F.lit(width)) * F.lit(float(spread))
        mine = F.col("rule") == rule
        bounds.append(F.max(F.when(mine, F.col("q3") + reach)).alias(f"most_{rule}"))
        if both:
            bounds.append(F.max(F.when(mine, F.col("q1") - reach)).alias(f"least_{rule}"))
    return quartiles.groupBy(*keys).agg(F.max("docs").alias("docs"), *bounds)


def group_fences(values: DataFrame, spread: float, min_docs: int) -> DataFrame:
    """The fences of every (lang_key, source_key): its own, or with fewer than ``min_docs`` documents those of its
    language, or with fewer still those of all documents; each from the merged sketches of what it holds."""
    keys = ["lang_key", "source_key"]
    finest = stored(sketch(values, keys))
    sums = lambda by: finest.groupBy(*by, "rule", "low", "high").agg(F.sum("n").alias("n"))
    own, by_lang = fences(finest, keys, spread), fences(sums(["lang_key"]), ["lang_key"], spread)
    overall = fences(sums([]), [], spread).first()  # one row of numbers
    names = [c for c in own.columns if c not in (*keys, "docs")]
    wider = by_lang.select(F.col("lang_key").alias("of_lang"), F.col("docs").alias("lang_docs"), *(F.col(c).alias(f"lang_{c}") for c in names))
    pick = lambda c: F.when(F.col("docs") >= min_docs, F.col(c)).when(F.col("lang_docs") >= min_docs, F.col(f"lang_{c}")).otherwise(
        F.lit(None if overall is None else overall[c]).cast("double")).alias(c)
    return own.join(wider, F.col("lang_key") == F.col("of_lang")).select(*keys, *map(pick, names))


def judge_documents(docs: DataFrame, spread: float = 4.0, min_docs: int = 200, id_col: str = "doc_id", text_col: str = "text",
                    lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Documents with their counts, ``base_failed`` and ``kept``.

    1. Words, symbols, repeated lines and repeated three-word windows are counted over whole texts.
    2. Documents that no group would keep (fewer than 50 words, or over half of them in repeated windows) fail.
    3. The others fill one quantile sketch for each language, source and rule.
    4. A group's thresholds lie ``spread`` quartile ranges outside its quartiles; a range counts as its
       rule's least width at least, so that a group of near-equal documents keeps small differences.
    5. Thresholds are joined back to the documents (a hot source is salted), and those outside go.

    Null texts have no words and fail; a null language or source is a group of its own; repeated rows
    are documents of their own; an empty table gives no rows; null ids are carried; other columns are not read.
    Result: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, broken (rules outside the thresholds).
    """
    counted = measure_texts(docs, id_col, text_col, lang_col, source_col)
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    counted = stored(counted.select("doc_id", key("lang").alias("lang_key"), key("source").alias("source_key"), "n_words", "word_chars", "n_symbols",
                                    "n_lines", "n_dup_lines", "n_repeat_words", failed.alias("base_failed")))
    values = rule_values()
    stacked = counted.where("not base_failed").select("lang_key", "source_key", F.explode(F.array(
        *(F.struct(F.lit(k).alias("rule"), v.alias("value")) for k, v in values.items()))).alias("x")).select("lang_key", "source_key", "x.*")
    joined = lookup(counted.withColumn("dealt_by", F.hash("doc_id", "n_words", "word_chars")), group_fences(stacked, spread, min_docs), ["lang_key", "source_key"], "dealt_by")
    outside = lambda k: (values[k] > F.col(f"most_{k}")) | ((values[k] < F.col(f"least_{k}")) if RULES[k][1] else F.lit(False))
    broken = F.filter(F.array(*(F.when(outside(k), F.lit(k)) for k in RULES)), lambda x: x.isNotNull())
    return joined.select(
        F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size(broken) == 0)).alias("kept"), F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(broken).alias("broken"))
