"""Trained models against plain forms of their training, and on rows kept from them."""

import math
import zlib
from pathlib import Path

import numpy as np
import pytest

from auditlake.llm import quality_classifier as qc

DATA = Path("/root/testdata/sf0.01")


def _plain(examples, s):
    """FTRL-proximal, one weight at a time."""
    z, n = {}, {}
    bias = 1 << s.bits

    def weight(i):
        if abs(z.get(i, 0.0)) <= s.l1:
            return 0.0
        return -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(max(s.epochs, math.ceil(s.min_updates / len(examples)))):
        for found, label in examples:
            x = {bias: 1.0}
            for i in found.tolist():
                x[i] = x.get(i, 0.0) + s.scale / len(found)
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] * x[i] for i in x)))))
            for i in x:
                g = (p - label) * x[i]
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / s.alpha * w[i]
                n[i] = before + g * g
    return {i: weight(i) for i in z}


def test_weights_equal_plain_ftrl():
    s = qc.Settings(bits=10, min_updates=60)
    texts = ["the cat sat on the mat", "BUY NOW BUY NOW", "a dog and a cat", "WIN $$$ 100 NOW", "", "one two three two one"]
    examples = [(qc.places(t, s.bits), k % 2) for k, t in enumerate(texts)]
    want = np.zeros((1 << s.bits) + 1)
    for i, w in _plain(examples, s).items():
        want[i] = w
    assert np.abs(qc.train(examples, s) - want).max() < 1e-9


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_held_out_rows_of_the_labels_table(spark):
    docs, labels = (spark.read.parquet(str(DATA / f"{t}.parquet")) for t in ("documents", "labels"))
    true = {r["doc_id"]: r["quality"] for r in labels.select("doc_id", "quality").collect()}
    rows = [(r["score"], r["predicted"], true[r["doc_id"]]) for r in qc.classify(docs, labels).collect() if r["held_out"] and true.get(r["doc_id"]) in (0, 1)]
    assert all(zlib.crc32(str(i).encode()) % 5 or i in true for i in true)
    good, bad = [x for x, _, y in rows if y == 1], [x for x, _, y in rows if y == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc >= 0.95
    assert sum(p == y for _, p, y in rows) >= 0.9 * len(rows)
