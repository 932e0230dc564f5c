"""Scores of motifs of each length, by the weights of the reference (search-api.mjs, rankedMotifs)."""

import math

import pytest
from pyspark.sql import functions as F

from strophic.operators import motifs

NOTES = [0, 2, 1, 4, 3, 6, 5, 7, 2, 4, 0, 5]


@pytest.mark.parametrize("length", range(6, 13))
def test_lengths_have_the_weights_of_the_reference(spark, length):
    steps = [*NOTES[:length], 9, 9, *NOTES[:length]]
    notes = spark.createDataFrame([(1, k, p, 0.75) for k, p in enumerate(steps)], "sid long, pos int, p int, d double")
    best = motifs.ranked_motifs(notes, length, length).filter(F.col("first") == 0).first()
    own = NOTES[:length]
    diversity = 0.55 * len(set(own)) / length + 0.45
    weight = 1.25 if 8 <= length <= 10 else 1.08 if length >= 11 else 0.88
    score = 2 * (1 + 0.18 * (length - 6)) * math.log2(2 + 0.75 * length) * (0.45 + 0.55 * diversity) * weight
    assert (best["count"], best["length"]) == (2, length) and best["score"] == pytest.approx(score, abs=1e-6)
