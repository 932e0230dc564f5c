"""Pairs of a bucket with low estimates reach the exact check."""

import math

import numpy as np
import pyarrow as pa

from strophic.llm import near_duplicates as nd


def test_low_estimate_is_confirmed():
    slots = nd.BANDS * nd.ROWS
    one = np.arange(slots, dtype="<u2")
    other = np.where(np.arange(slots) < 58, one, one + 1000).astype("<u2")  # 58 of 96: 0.604
    batch = pa.RecordBatch.from_arrays([pa.array([5, 5]), pa.array([0, 0]), pa.array([0, 0]), pa.array([1, 2]), pa.array([900, 900]), pa.array([one.tobytes(), other.tobytes()])], names=["key", "c1", "c2", "id", "n", "signature"])
    found = pa.Table.from_batches(list(nd._similar(80)(iter([batch]))))
    assert sorted((found["a"][0].as_py(), found["b"][0].as_py())) == [1, 2]


def test_estimates_lose_less_than_the_bands():
    slots = nd.BANDS * nd.ROWS
    lost = sum(math.comb(slots, k) * 0.8**k * 0.2 ** (slots - k) for k in range(slots + 1) if k / slots < nd.LEAST)
    print("lost", lost, (1 - 0.8**nd.ROWS) ** nd.BANDS)
    assert lost < 1e-7 < (1 - 0.8**nd.ROWS) ** nd.BANDS
