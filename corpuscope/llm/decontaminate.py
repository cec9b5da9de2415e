"""Benchmark decontamination by winnowed fingerprints, with DataFrame operations only."""

from pyspark.sql import DataFrame, functions as F

from corpuscope.llm.common import ascii_lower, stored

#: Words of ASCII letters, digits and all characters beyond ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Benchmark fingerprints and windows up to this number are sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Low bits that hold a position beside a hash.
PLACE = 24


def words_of(col):
    return F.array_remove(F.split(ascii_lower(F.coalesce(col, F.lit(""))), SEPARATORS), "")


def let(value, use):
    """``use(value)`` with the value computed once, also where ``use`` builds a lambda over it."""
    return F.transform(F.array(value), use)[0]


def upto(n):
    """0, 1, ... n - 1; no elements for n of 0 or less."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def grams(hashes, n, k: int):
    """Hash of each run of k words, from the hashes of the words."""
    return let(hashes, lambda h: F.transform(upto(n - (k - 1)), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k)))))


def winnowed(kgrams, n, span: int, k: int):
    """Positions of the smallest k-gram hash of every window of ``span`` words, each once.

    Hash and position share one number, so that the least of a few numbers tells the place."""
    low = (1 << PLACE) - 1
    packed = F.transform(kgrams, lambda h, i: F.shiftleft(F.shiftright(h, PLACE), PLACE).bitwiseOR(i.cast("long").bitwiseAND(F.lit(low))))
    width = span - k + 1
    least = lambda a, i: F.least(*(F.get(a, i + j) for j in range(width))) if width > 1 else F.get(a, i)
    return let(packed, lambda a: F.array_distinct(F.transform(
        upto(n - (span - 1)), lambda i: i + F.pmod(least(a, i).bitwiseAND(F.lit(low)) - i, F.lit(1 << PLACE)).cast("int"))))


def runs(words, size):
    """All runs of ``size`` words, each joined by spaces."""
    return let(words, lambda w: F.transform(upto(F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i + 1, size), " ")))


def fingerprints(df: DataFrame, keys: list[str], span: int, k: int, short: list[int]) -> DataFrame:
    """(keys, len, place, print) of a table with ``words``.

    ``len`` is ``span`` for the winnowed k-grams; for each shorter length of ``short`` every run of so
    many words is a print of its own."""
    n = F.size("words")
    hashed = df.select(*keys, n.alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    hashed = hashed.withColumn("kgrams", grams(F.col("hashes"), F.col("n"), k))
    entry = lambda size, i, h: F.struct(F.lit(size).alias("len"), i.alias("place"), h.alias("print"))
    parts = [let(F.col("kgrams"), lambda g: F.transform(winnowed(g, F.col("n"), span, k), lambda i: entry(span, i, F.get(g, i))))]
    at = lambda size: lambda h, i: entry(size, i, h)
    parts += [F.transform(grams(F.col("hashes"), F.col("n"), size), at(size)) for size in short]
    return hashed.select(*keys, F.explode(F.concat(*parts)).alias("p")).select(*keys, "p.len", "p.place", "p.print")


def bounded(df: DataFrame) -> DataFrame:
    """The table with a broadcast hint if a count shows that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def find_contamination(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 6, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Words of ``docs`` inside passages that they share with ``benchmark``.

    A passage is ``span`` consecutive words of an item, or the whole item if it has fewer (but some).
    Both sides keep the smallest k-gram hash of each window of ``span`` words, so every shared passage
    shares a kept hash (winnowing).  Documents with such a hash are extended around it: each run of
    ``span`` words that holds it is compared, word for word, with the passages of the items.  Items
    shorter than ``span`` are met by the hash of their whole length instead.

    A row is known by its id and its text: repeated rows get the same result.  Null texts have no
    words and are not contaminated; null ids are carried; items of null id count as one item and are
    left out of the list; an empty benchmark hits nothing, empty documents give no rows, and other
    columns are not read.  Result: id, n_words, n_hit, n_items, items (sorted as strings), hits (places
    and lengths of the passages), contaminated, print_of_text (xxhash64, tells rows of equal id apart).
    """
    keys = ["doc_id", "print_of_text"]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("print_of_text"), F.col(text_col).alias("text"))
    given = texts.select(*keys, words_of(F.col("text")).alias("words"))
    items = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text_col)).alias("words")).where(F.size("words") > 0)
    n = F.size("words")
    short = sorted(r[0] for r in items.where(n < span).select(n.alias("n")).distinct().collect())  # below span: few

    length = F.least(n, F.lit(span))
    passages = items.select("item_id", "words", length.alias("len")).select(
        "item_id", "len", F.explode(runs(F.col("words"), F.col("len"))).alias("passage")).distinct()
    own = F.when(n < span, n).otherwise(span)
    prints = fingerprints(items.withColumn("own", own), ["own"], span, k, short).where("len = own").select("len", "print").distinct()

    seeds = stored(
        fingerprints(given, keys, span, k, short).join(bounded(prints), ["len", "print"], "left_semi")
        .groupBy(F.col("doc_id").alias("d"), F.col("print_of_text").alias("p")).agg(F.collect_set(F.struct("len", "place")).alias("seeds"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("print_of_text") == F.col("p"))
    last = F.col("n") - span
    starts = F.array_distinct(F.flatten(F.transform("seeds", lambda s: F.when(
        s["len"] == span, F.transform(F.sequence(F.greatest(s["place"] + k - span, F.lit(0)), F.least(s["place"], last)),
                                      lambda i: F.struct(i.alias("start"), s["len"].alias("len")))
    ).otherwise(F.array(F.struct(s["place"].alias("start"), s["len"].alias("len")))))))
    # only documents with a seed move, and only their words are taken apart again
    seeded = texts.join(bounded(seeds.select("d", "p")), same, "left_semi").join(seeds, same).withColumn("words", words_of(F.col("text")))
    extended = seeded.withColumn("n", n).select(
        *keys, "words", F.explode(starts).alias("at"),
    ).select(*keys, "at.start", "at.len", F.array_join(F.slice("words", F.col("at.start") + 1, F.col("at.len")), " ").alias("passage"))
    hits = extended.join(bounded(passages), ["len", "passage"])
    place = F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1))
    found = hits.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.struct("start", "len"))).alias("hits"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
        F.max(F.col("item_id").isNull().cast("int")).alias("unnamed"),
    ).select(F.col("doc_id").alias("d"), F.col("print_of_text").alias("p"), "hits", "items",
             F.size(F.array_distinct(F.flatten(place))).alias("n_hit"), (F.size("items") + F.col("unnamed")).alias("n_items"))
    listed = given.select("doc_id", "print_of_text", n.alias("n_words"))
    return listed.join(found, same, "left").select(
        F.col("doc_id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        "hits", F.col("hits").isNotNull().alias("contaminated"), "print_of_text")
