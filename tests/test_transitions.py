"""One task with a million events: no group holds more than a chunk, and the result is that of a plain walk."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tillwatch.operators import workflow

EVENTS = 1_000_000


def walk(start, targets):
    """(old, outcome) of each event, one after the other."""
    state, out = start, []
    for target in targets:
        if target not in workflow.TASK_STATUSES:
            out.append((None, "invalid_transition"))
        elif target == state:
            out.append((state, "no_change"))
        elif target in workflow.TRANSITIONS[state]:
            out.append((state, "success"))
            state = target
        else:
            out.append((state, "invalid_transition"))
    return out


def test_a_million_events_of_one_task(spark):
    # 'Completed' ends a task, so it comes once, near the end
    pick = "element_at(array('To Do', 'In Progress', 'Blocked', 'Unassigned', 'To Do', 'In Progress'), CAST(pmod(xxhash64(id), 6) AS INT) + 1)"
    events = spark.range(EVENTS).selectExpr(
        "'T' AS task_id", "id AS event_seq", f"CASE WHEN id = {EVENTS - 5000} THEN 'Completed' WHEN id = 777 THEN 'Nonsense' ELSE {pick} END AS target_status")
    tasks = spark.createDataFrame([("T", "Unassigned")], "task_id string, status string")
    chunks = events.groupBy(F.expr(f"event_seq DIV {workflow.EVENTS_PER_CHUNK}")).count().agg(F.max("count")).first()[0]
    assert chunks <= 1000
    found = workflow.transitions(tasks, events).orderBy("event_seq").toPandas()
    want = walk("Unassigned", events.orderBy("event_seq").toPandas()["target_status"])
    assert len(found) == EVENTS and list(zip(found["old_status"], found["outcome"])) == want


def test_sparse_event_numbers_and_small_groups(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for t, start in enumerate(workflow.TASK_STATUSES):
        numbers = sorted(rng.sample(range(10**15), 40)) if t % 2 else list(range(40))
        targets = [rng.choice(workflow.TASK_STATUSES) for _ in numbers]
        rows += [(f"T{t}", n, x) for n, x in zip(numbers, targets)]
        want |= {(f"T{t}", n): o for n, o in zip(numbers, walk(start, targets))}
    tasks = spark.createDataFrame([(f"T{t}", s) for t, s in enumerate(workflow.TASK_STATUSES)], "task_id string, status string")
    events = spark.createDataFrame(rows, "task_id string, event_seq bigint, target_status string")
    for chunk, fan in ((2, 2), (3, 5), (64, 64)):
        got = {(r["task_id"], r["event_seq"]): (r["old_status"], r["outcome"]) for r in workflow.transitions(tasks, events, chunk, fan).collect()}
        assert got == want
    assert workflow.transitions(tasks, events.limit(0)).count() == 0
