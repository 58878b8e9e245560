"""Sequence metrics: token edit distance, error rate, edit scripts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDITS = T.ArrayType(T.StructType([T.StructField(name, T.StringType()) for name in ("op", "ref", "hyp")]))


def as_letters(tokens: Column, dictionary: Column) -> Column:
    """A string with one character a token, so that string distance is token distance.

    Characters are numbered from 256 by a token's place in the dictionary, which must hold all tokens: up to 55,000.
    """
    return F.array_join(F.transform(tokens, lambda t: F.decode(F.unhex(F.lpad(F.hex(255 + F.array_position(dictionary, t)), 4, "0")), "UTF-16BE")), "")


def token_error_rate(reference: Column, hypothesis: Column) -> Column:
    """:func:`error_rate` of token arrays; the dictionary is that of the two sequences, so no token is unknown."""
    dictionary = F.array_distinct(F.concat(reference, hypothesis))
    return error_rate(as_letters(reference, dictionary), as_letters(hypothesis, dictionary))


def error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over the reference's length; for an empty reference 0 if the hypothesis is empty too, else 1."""
    n = F.length(reference)
    return F.when(n == 0, F.when(F.length(hypothesis) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(reference, hypothesis) / n)


def _script(reference: list[str], hypothesis: list[str]) -> list[dict]:
    n, m = len(reference), len(hypothesis)
    code = {t: i for i, t in enumerate({*reference, *hypothesis})}
    hyp = np.array([code[t] for t in hypothesis], np.int64)
    at = np.arange(m + 1)
    cost = np.empty((n + 1, m + 1), np.int64)
    cost[0] = at
    for i, token in enumerate(reference, 1):
        best = cost[i - 1] + 1
        best[1:] = np.minimum(best[1:], cost[i - 1, :-1] + (hyp != code[token]))
        cost[i] = np.minimum.accumulate(best - at) + at  # insertions: one more for each place to the right
    out, i, j = [], n, m
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (reference[i - 1] != hypothesis[j - 1]):
            i, j = i - 1, j - 1
            if reference[i] != hypothesis[j]:
                out.append({"op": "sub", "ref": reference[i], "hyp": hypothesis[j]})
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
            out.append({"op": "del", "ref": reference[i], "hyp": None})
        else:
            j -= 1
            out.append({"op": "ins", "ref": None, "hyp": hypothesis[j]})
    return out[::-1]


@F.pandas_udf(EDITS)
def edit_script(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Edits that turn a reference into a hypothesis; of equally short scripts substitutions, then deletions, come last first."""
    for reference, hypothesis in pairs:
        yield pd.Series([_script(list(a) if a is not None else [], list(b) if b is not None else []) for a, b in zip(reference, hypothesis, strict=True)])
