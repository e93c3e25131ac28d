"""Reading levels: calibration, odd inputs."""

from __future__ import annotations

import random

import numpy as np

from leesmaat.llm import langid, reading
from tests.llm.test_pairs import EN, NL


def test_calibration_separates_levels():
    rng = np.random.default_rng(1)
    rows = [(list(np.clip(rng.normal(k, 0.3, 9), 1, 4)), k, 1.0) for k in (1, 2, 3, 4) for _ in range(40)]
    c = reading.calibrate(rows)
    hit = [int((np.append(q, 1.0) @ c).argmax()) + 1 == k for q, k, _ in rows]
    assert np.mean(hit) > 0.95
    flat = reading.calibrate([])
    assert [int((np.append([m] * 9, 1.0) @ flat).argmax()) + 1 for m in (1.1, 2.0, 3.2, 3.9)] == [1, 2, 3, 4]


def test_levels(spark):
    rng = random.Random(6)
    words = {k: [f"{p}woord" for p in (c * k + d for c in "abcdefgh" for d in "xyz")] for k in (1, 2, 3, 4)}
    text = lambda k: NL * 2 + " ".join(rng.choice(words[k]) for _ in range(60))
    rows = [(n, text(n % 4 + 1), "extra") for n in range(80)] + [(100, None, ""), (101, "kort", ""), (102, EN * 8, ""), (103, NL * 8, "")]
    req = spark.createDataFrame(rows, "request_id long, text string, difficulty_level string")
    editors = spark.createDataFrame([(n, n % 4 + 1) for n in range(40)] + [(0, 9), (5, None)], "request_id long, difficulty_level int")
    sentences = spark.createDataFrame([(n, 0, n % 4 + 1, "2024") for n in range(40, 70)] + [(41, 0, 7, "2023"), (None, 0, 1, "2024")], "request_id long, sentence_index int, difficulty_level int, ingested_at string")
    model = langid.fit([(k, t) for k, t in (("nl", NL), ("en", EN)) for _ in range(3)] + [("nl", text(k)) for k in (1, 2, 3, 4)])
    got = {r["request_id"]: r["difficulty_level"] for r in reading.levels(req, editors, sentences, model).collect()}
    assert set(got) == set(range(80)) | {103}
    assert np.mean([got[n] == n % 4 + 1 for n in range(80)]) > 0.95
