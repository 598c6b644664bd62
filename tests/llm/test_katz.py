"""What the bigram model takes on disk."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from certame.llm import katz
from tests.llm import brute


def test_bigrams_take_few_bytes(spark):
    """Both words of a bigram do not stand beside it in full: that was 16 bytes for each, and 8 for what it changes."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(2000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(500))) for i in range(200)]
    model = brute.Katz(rows, 1, katz.DISCOUNTED)
    held = katz.fit(spark.createDataFrame(rows, "doc_id long, text string")).pairs.agg(F.sum(F.length("found"))).first()[0]
    assert held < 12 * len(model.pairs)
