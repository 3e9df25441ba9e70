"""Text analysis for search: one analyser for documents and queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.arrays import let, sorted_runs

TOKEN = r"[\p{L}\p{N}]+"  # fixed value


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def term_counts(terms: Column) -> Column:
    """array<struct(term, tf)> of a token array; counting inside the row needs no shuffle.

    The terms are sorted as they are, and a count is the distance from one run's start to the next: no run is built.
    """

    def counted(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(
            starts,
            lambda b: F.transform(
                b,
                lambda start, j: F.struct(
                    F.get(s, start).alias("term"), (F.coalesce(F.get(b, j + 1), F.size(s)) - start).alias("tf")
                ),
            ),
        )

    none = F.array().cast("array<struct<term:string,tf:int>>")
    return let(F.sort_array(terms), lambda s: F.when(F.size(s) > 0, counted(s)).when(s.isNotNull(), none))


def term_positions(terms: Column) -> Column:
    """array<struct(term, tf, positions)> of a token array; positions count from 0 and rise."""
    items = F.transform(terms, lambda t, i: F.struct(t.alias("term"), i.alias("at")))
    return sorted_runs(
        items,
        "term",
        lambda term, run: F.struct(
            term.alias("term"), F.size(run).alias("tf"), F.transform(run, lambda x: x["at"]).alias("positions")
        ),
    )
