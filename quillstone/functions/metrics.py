"""Ranking metrics over arrays of ids, as columns. Ids are compared without outer white space and case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: The depths at which a ranking is judged.
DEPTHS = (1, 3, 5, 10)


def _norm(ids: Column) -> Column:
    return F.transform(ids, lambda x: F.lower(strip(x)))


def hit(ranked: Column, relevant: Column) -> Column:
    """Whether any relevant id is in the ranking."""
    return F.coalesce(F.arrays_overlap(_norm(ranked), _norm(relevant)), F.lit(False))


def precision_at(ranked: Column, relevant: Column, k: int) -> Column:
    """The share of the first k places, or of as many as there are, that hold a relevant id, repeats counted; 0 without any place."""
    top, rel = F.slice(_norm(ranked), 1, k), _norm(relevant)
    found = F.size(F.filter(top, lambda x: F.array_contains(rel, x)))
    return F.when(F.size(ranked) > 0, found / F.size(top)).otherwise(F.lit(0.0))


def recall_at(ranked: Column, relevant: Column, k: int) -> Column:
    """The share of the different relevant ids among the first k places; 0 if none is relevant."""
    found = F.size(F.array_intersect(F.slice(_norm(ranked), 1, k), _norm(relevant)))
    return F.when(F.size(relevant) > 0, found / F.size(F.array_distinct(_norm(relevant)))).otherwise(F.lit(0.0))


def reciprocal_rank(ranked: Column, relevant: Column) -> Column:
    rel = _norm(relevant)
    places = F.filter(F.transform(_norm(ranked), lambda x, i: F.when(F.array_contains(rel, x), i + 1)), lambda p: p.isNotNull())
    return F.coalesce(F.lit(1.0) / F.array_min(places), F.lit(0.0))


def score_retrieval(ranked: Column, relevant: Column, k: int = 5) -> Column:
    """All of these as a struct, rounded to 4 places; null where either side is empty: not applicable, which isn't 0."""
    parts = [
        hit(ranked, relevant).alias("hit"),
        F.round(precision_at(ranked, relevant, k), 4).alias("precision"),
        F.round(recall_at(ranked, relevant, k), 4).alias("recall"),
        F.round(reciprocal_rank(ranked, relevant), 4).alias("reciprocal_rank"),
        F.size(ranked).alias("n_ranked"),
    ]
    return F.when((F.size(ranked) > 0) & (F.size(relevant) > 0), F.struct(*parts))


def score_row(relevant: Column, ranked: Column, answer_type: Column) -> list[Column]:
    """Columns for a map from relevant ids to grades and a ranking of different ids: first_rel_rank, mrr, hit, recall, all and success
    at each of DEPTHS, and ndcg_10. Success asks for all relevant ids if answer_type is multi_required, else for any."""
    keys = F.map_keys(relevant)
    places = F.filter(F.transform(ranked, lambda x, i: F.when(F.array_contains(keys, x), i + 1)), lambda p: p.isNotNull())
    first = F.array_min(places)
    out = [first.alias("first_rel_rank"), F.coalesce(1.0 / first, F.lit(0.0)).alias("mrr")]
    for k in DEPTHS:
        found = F.size(F.array_intersect(F.slice(ranked, 1, k), keys))
        any_, whole = (found > 0).cast("double"), (found == F.size(keys)).cast("double")
        out += [any_.alias(f"hit_{k}"), (found / F.size(keys)).alias(f"recall_{k}"), whole.alias(f"all_{k}")]
        out.append(F.when(answer_type == "multi_required", whole).otherwise(any_).alias(f"success_{k}"))
    add = lambda s, x: s + x
    gain = lambda grades: F.aggregate(F.transform(F.slice(grades, 1, 10), lambda g, i: g / F.log2(i + 2.0)), F.lit(0.0), add)
    dcg = gain(F.transform(ranked, lambda x: F.coalesce(F.try_element_at(relevant, x), F.lit(0))))
    ideal = gain(F.sort_array(F.map_values(relevant), asc=False))
    return [*out, F.when(ideal > 0, dcg / ideal).otherwise(F.lit(0.0)).alias("ndcg_10")]
