"""Quality classifier from weak labels: expectation-maximisation over heuristic labellers, then a hashed linear scorer."""

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from corpuscope.llm.common import SPACE_WORD, space_words, stored

BAD, ABSTAIN, GOOD = -1, 0, 1
#: Hashed features of the scorer, and documents that it is fitted on at most.
FEATURES, MAX_TRAIN = 1 << 12, 20_000
#: Tasks that share the sample in each step of the fit.
TRAIN_PARTS = 8
EM_ROUNDS, SMOOTHING = 50, 1.0


def measures(words, text) -> dict:
    """Numbers that the labellers look at; shares of words or of letters."""
    n = F.size(words)
    per_word = lambda x: x / F.greatest(n, F.lit(1))
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))  # regexp_count makes an array of all letters first
    return {
        "n_words": n,
        "symbols": per_word(F.regexp_count(text, F.lit(r"[|*%$&#~^=<>{}\\]"))),
        "capitals": F.regexp_count(text, F.lit(r"\p{Lu}")) / F.greatest(letters, F.lit(1)),
        "stops": per_word(F.regexp_count(text, F.lit("[.!?]"))),
        "variety": per_word(F.size(F.array_distinct(words))),
        "repeats": per_word(F.size(F.filter(
            F.zip_with(words, F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a == b), lambda same: same))),
        "letters": letters / F.greatest(F.length(text), F.lit(1)),
    }


def labellers() -> dict:
    """Overlapping heuristics; each votes bad, good or not at all."""
    vote = lambda bad, good: F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)
    c, long = F.col, F.col("n_words") >= 12
    return {
        "symbols": vote(long & (c("symbols") > 0.3), c("symbols") < 0.05),
        "capitals": vote(long & (c("capitals") > 0.5), c("capitals") < 0.2),
        "stops": vote(long & (c("stops") > 0.8), c("stops").between(0.02, 0.4)),
        "variety": vote(long & (c("variety") < 0.2), c("variety") > 0.5),
        "repeats": vote(long & (c("repeats") > 0.25), c("repeats") < 0.1),
        "letters": vote(long & (c("letters") < 0.55), c("letters") > 0.7),
    }


def estimate(votes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Posterior probability of good quality for each distinct vote pattern.

    ``votes`` is (patterns, labellers), ``counts`` says how many documents voted so.  The labellers
    are independent given the class; a pattern starts as bad when any labeller objects.
    """
    good = np.where((votes == BAD).any(1), 0.05, np.where((votes == GOOD).any(1), 0.95, 0.5))
    for _ in range(EM_ROUNDS):
        logs = []
        for posterior in (1 - good, good):
            weight = counts * posterior
            log = np.log(weight.sum() + SMOOTHING)
            for v in votes.T:
                shares = np.array([weight[v == x].sum() for x in (BAD, ABSTAIN, GOOD)]) + SMOOTHING
                log = log + np.log(shares / shares.sum())[v + 1]
            logs.append(log)
        good = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return good


def shapes(text):
    """Words as classes of characters, with a mark on those that repeat the word before."""
    shaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\p{Ll}+", "a"), r"\p{Lu}+", "A"), r"\p{N}+", "0")
    return space_words(shaped)


def tokens(words, text, repeats):
    """Terms of the scorer: word shapes, and one term for each tenth of words that repeat."""
    return F.concat(shapes(text), F.array_repeat(F.lit("=="), F.floor(repeats * F.size(words)).cast("int")))


def score_quality(docs: DataFrame, threshold: float = 0.5, max_train: int = MAX_TRAIN, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Add ``quality`` (probability of good quality) and ``keep`` to the rows of ``docs``.

    1. Every document gets the votes of all labellers on its whole text.
    2. The counts of all vote patterns (3 to the power of the labellers, at most) go to the driver,
       where expectation-maximisation estimates how far each labeller can be trusted.
    3. A hash of id and text picks about ``max_train`` documents (all, if there are fewer); they train a
       linear scorer on hashed word shapes, each once as good and once as bad, weighted by its posterior.
    4. The scorer, not the votes, decides about all documents.

    Null texts and texts without words get quality 0 and are not kept.  Repeated rows are scored
    alike; an empty table gives no rows; columns of ``docs`` named quality or keep are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = space_words(text)
    rest = [c for c in docs.columns if c not in ("quality", "keep")]
    held = docs.select(F.struct(*rest).alias("row"), text.alias("text"), words.alias("words"))
    judges = labellers()
    measured = held.select("row", "text", "words", *(m.alias(k) for k, m in measures(F.col("words"), F.col("text")).items()))
    voted = measured.where(F.col("text").rlike(SPACE_WORD)).select(F.col(f"row.{id_col}").alias("id"), "text", "words", "repeats", *(v.alias(f"vote_{k}") for k, v in judges.items()))
    names = [f"vote_{k}" for k in judges]
    patterns = voted.groupBy(*names).agg(F.count("*").alias("n")).collect()  # bounded by the labellers
    if not patterns:
        return docs.select(*rest, F.lit(0.0).alias("quality"), F.lit(False).alias("keep"))
    posterior = estimate(np.array([[r[k] for k in names] for r in patterns]), np.array([r["n"] for r in patterns], float))
    schema = ", ".join(f"{k} int" for k in names) + ", good double"
    labels = docs.sparkSession.createDataFrame([(*(int(r[k]) for k in names), float(p)) for r, p in zip(patterns, posterior)], schema)

    hashing = HashingTF(inputCol="tokens", outputCol="counts", numFeatures=FEATURES)
    unit = Normalizer(inputCol="counts", outputCol="features", p=1.0)
    terms = lambda df: unit.transform(hashing.transform(df.withColumn(
        "tokens", tokens(F.col("words"), F.col("text"), F.col("repeats")))))
    share = min(1.0, max_train / sum(r["n"] for r in patterns))
    chosen = F.pmod(F.xxhash64(F.col("id").cast("string"), "text"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    sample = stored(terms(voted.where(chosen).join(F.broadcast(labels), names)).select("features", "good")).repartition(TRAIN_PARTS)  # read by every step of the fit
    both = sample.select("features", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), (F.col("good") + 1e-6).alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (1 - F.col("good") + 1e-6).alias("weight")))).alias("y")).select(
        "features", "y.label", "y.weight")
    model = LogisticRegression(weightCol="weight", maxIter=30, regParam=1e-4).fit(both)

    scored = model.transform(terms(measured))
    quality = F.when(F.col("n_words") > 0, vector_to_array("probability")[1]).otherwise(0.0)
    # one element to explode: a filter on keep would else be moved below the scorer, and all that it reads be computed twice
    return scored.select(*(F.col(f"row.{c}").alias(c) for c in rest), F.explode(F.array(quality)).alias("quality")).withColumn(
        "keep", F.col("quality") >= threshold)
