"""Plans against a restatement in plain Python."""

from __future__ import annotations

import random

from leesmaat import constants as K
from leesmaat.operators.triggers import COLUMNS, TYPES
from leesmaat.plans import planner

SCHEMA = "doc_id long, sent_idx int, ord int, type string, i int, word string, value double, threshold double"


def random_triggers(seed):
    rng = random.Random(seed)
    rows = []
    for doc in range(3):
        for s in range(rng.randint(1, 6)):
            for n, t in enumerate(TYPES[1:7], 1):
                if rng.random() < 0.4:
                    rows.append((doc, s, n, t, None, None, 1.0, 1.0))
            for w in range(rng.randint(0, 5)):
                rows.append((doc, s, 0, "word_frequency", s * 100 + w, f"w{s}_{w}", 2.0, 3.0))
    return rows


def deal(rows, cap):
    """Per sentence by rank, then one from each sentence in turn."""
    out = []
    for doc in sorted({r[0] for r in rows}):
        queues = {}
        for r in sorted((r for r in rows if r[0] == doc), key=lambda r: (r[1], K.PRIORITY.index(r[3]), r[2], -1 if r[4] is None else r[4])):
            queues.setdefault(r[1], []).append(r)
        picked = []
        while any(queues.values()):
            for s in sorted(queues):
                if queues[s]:
                    picked.append(queues[s].pop(0))
        out += [(doc, k + 1, r[1], r[3], r[4]) for k, r in enumerate(picked[:cap])]
    return sorted(out, key=str)


def test_round_robin(spark):
    for seed in range(4):
        rows = random_triggers(seed)
        got = planner.prioritise(spark.createDataFrame(rows, SCHEMA), 5).select("doc_id", "pick", "sent_idx", "type", "i").collect()
        assert sorted((tuple(r) for r in got), key=str) == deal(rows, 5)


def consolidate(rows, cap):
    out = []
    for doc in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == doc]
        jobs = []
        for s in sorted({r[1] for r in mine}):
            level = [r[3] for r in mine if r[1] == s and r[3] in K.SENTENCE_LEVEL]
            if level:
                jobs.append(("consolidated" if len(level) > 1 else "single", s, len(level), ()))
        jobs = jobs[:cap]
        queues = {s: sorted((r for r in mine if r[1] == s and r[3] == "word_frequency"), key=lambda r: r[4]) for s in sorted({r[1] for r in mine})}
        words = []
        while any(queues.values()):
            words += [queues[s].pop(0) for s in queues if queues[s]]
        words = words[: max(0, cap - len(jobs))]
        for k in range(0, len(words), K.BUNDLE):
            part = words[k : k + K.BUNDLE]
            jobs.append(("wordfreq_bundle", part[0][1], 1, tuple(r[5] for r in part)))
        out += [(doc, n + 1, *j) for n, j in enumerate(jobs)]
    return sorted(out, key=str)


def test_consolidated(spark):
    for seed in range(4):
        rows = random_triggers(seed + 10)
        got = planner.consolidated_jobs(spark.createDataFrame(rows, SCHEMA), 9).collect()
        assert sorted(((r["doc_id"], r["job_idx"], r["kind"], r["sent_idx"], len(r["types"]), tuple(r["words"])) for r in got), key=str) == consolidate(rows, 9)


def test_budget_rounds_half_to_even(spark):
    df = spark.createDataFrame([(n,) for n in (0, 4, 15, 25, 35, 400)], "n long")
    assert [r[0] for r in df.select(planner.budget(df.n)).collect()] == [1, 1, 2, 2, 4, 25]


def test_no_triggers_no_jobs(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert planner.consolidated_jobs(empty, 5).count() == 0 and planner.prioritise(empty, None).count() == 0
    assert COLUMNS[0] == "doc_id"
