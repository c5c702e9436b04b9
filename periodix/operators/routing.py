"""Which result tables a question asks for.

Each table has a description: terms in four languages with weights in tenths.  A
question asks for every table whose terms it matches with ``ENOUGH`` together,
so one question may go to several tables, and words that only hint at one
("first") do not send it there alone.  A term that ends in ``*`` matches words
that begin with it (inflected forms); a term counts once.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

ENOUGH = 10

# --- fixed values: the descriptions (English, Russian, Kazakh, Korean) ---------
DESCRIPTIONS: dict[str, dict[str, int]] = {
    "ranking": {
        "top": 10, "tops": 10, "rank*": 10, "largest": 10, "biggest": 10, "leading": 5, "first": 4,
        "топ": 10, "рейтинг*": 10, "крупнейш*": 10, "лидиру*": 5, "перв*": 4,
        "үздік*": 10, "ірі": 10, "бірінші": 4,
        "상위*": 10, "최대*": 10, "순위*": 10, "가장": 5, "큰": 5,
    },
    "segment": {
        "segment*": 10, "leader*": 10, "smaller": 10, "small": 5,
        "сегмент*": 10, "лидер*": 10, "мелк*": 5,
        "көшбасшы*": 10, "шағын*": 5,
        "부문*": 10, "세그먼트*": 10, "선도*": 10, "소형*": 5,
    },
    "yearly": {
        "market*": 10, "overall": 10, "overview": 10, "total*": 5, "average": 5, "npl": 5,
        "рынок": 10, "рынк*": 10, "обзор*": 10, "средн*": 5,
        "нарық*": 10, "нарығ*": 10, "шолу*": 10, "орташа": 5,
        "시장*": 10, "개요*": 10, "평균*": 5,
    },
}
# -------------------------------------------------------------------------------


def _begins(words: Column, stem: str) -> Column:
    return F.exists(words, lambda w: F.startswith(w, F.lit(stem)))


def score(words: Column, terms: dict[str, int]) -> Column:
    """Summed weights of the terms that match a word."""
    parts = []
    for weight in sorted(set(terms.values())):
        exact = [t for t, w in terms.items() if w == weight and not t.endswith("*")]
        if exact:
            parts.append(F.size(F.array_intersect(words, F.array(*map(F.lit, exact)))) * weight)
    for term, weight in terms.items():
        if term.endswith("*"):
            parts.append(F.when(_begins(words, term[:-1]), weight).otherwise(0))
    return reduce(add, parts)


def asked_tables(words: Column) -> Column:
    """The tables a question's words ask for, by name."""
    hits = [F.when(score(words, terms) >= ENOUGH, F.lit(name)) for name, terms in sorted(DESCRIPTIONS.items())]
    return F.array_compact(F.array(*hits))
