"""A small task graph: plans that use prior results, run in waves with a deadline."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .errors import Refused
from .model import Operation

#: Attempts of a task, retries of all tasks together, tasks at once, seconds for all.
ATTEMPTS, RETRIES, CONCURRENT, DEADLINE_S = 2, 2, 4, 55.0


@dataclass(frozen=True)
class Task:
    name: str
    plan: Operation
    needs_one: bool = False  # the prior result must be exactly one row


def waves(tasks: list[Task]) -> list[list[Task]]:
    """Tasks in dependency order; an unknown or circular prior is refused."""
    left, done, out = list(tasks), set(), []
    while left:
        ready = [t for t in left if t.plan.scope.prior is None or t.plan.scope.prior in done]
        if not ready:
            raise Refused("TASK_CYCLE", ",".join(t.name for t in left))
        out.append(ready)
        done |= {t.name for t in ready}
        left = [t for t in left if t not in ready]
    return out


def run_tasks(spark: SparkSession, tasks: list[Task], build: Callable[[Operation, dict[str, DataFrame]], DataFrame], deadline_s: float = DEADLINE_S) -> dict[str, tuple[str, list]]:
    """name -> (state, rows): done, empty_upstream (nothing to do), upstream_failed, failed or timeout.

    Later tasks join the lazy frames of earlier ones, so no ids pass through the driver; each task runs as a job group
    that the deadline cancels.
    """
    frames: dict[str, DataFrame] = {}
    results: dict[str, tuple[str, list]] = {}
    groups = {t.name: f"task-{uuid.uuid4().hex}" for t in tasks}
    end = time.monotonic() + deadline_s
    retries = threading.Semaphore(RETRIES)

    def one(task: Task) -> tuple[str, list]:
        group = groups[task.name]
        for attempt in range(ATTEMPTS):
            try:
                spark.sparkContext.setJobGroup(group, task.name, interruptOnCancel=True)
                frames[task.name] = build(task.plan, frames)
                return "done", frames[task.name].collect()
            except Refused:
                return "failed", []
            except Exception:
                if attempt + 1 == ATTEMPTS or time.monotonic() > end or not retries.acquire(blocking=False):
                    return "failed", []
        return "failed", []

    with ThreadPoolExecutor(CONCURRENT) as pool:
        for wave in waves(tasks):
            running = {}
            for t in wave:
                state, rows = results.get(t.plan.scope.prior, ("done", [None]))
                if state == "empty_upstream" or (state == "done" and not rows):
                    results[t.name] = ("empty_upstream", [])
                elif state != "done" or (t.needs_one and len(rows) != 1):
                    results[t.name] = ("upstream_failed", [])
                else:
                    running[pool.submit(one, t)] = t
            finished, late = wait(running, timeout=max(0.0, end - time.monotonic()))
            for f in finished:
                results[running[f].name] = f.result()
            for f in late:
                spark.sparkContext.cancelJobGroup(groups[running[f].name])
                results[running[f].name] = ("timeout", [])
    return results
