"""Phrase and figure counts on plain text."""

from pyspark.sql import DataFrame

from corpuscope.functions import html as h
from corpuscope.functions import lexicon as lx
from corpuscope.operators.signals import phrases_in, word_count


def phrase_report(texts: DataFrame, key: str, column: str = "text") -> DataFrame:
    return texts.selectExpr(key, f"{h.squeeze(column)} AS squeezed").selectExpr(
        key,
        f"array_join({phrases_in('lower(squeezed)', lx.VAGUE_PHRASES)}, ' | ') AS vague_phrases",
        f"array_join({phrases_in('lower(squeezed)', lx.SUPERLATIVES)}, ' | ') AS superlatives",
        f"{h.count_matches('squeezed', lx.FACT_PATTERN)} AS facts",
        f"{word_count('squeezed')} AS words",
    )
