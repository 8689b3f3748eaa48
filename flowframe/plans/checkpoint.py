"""Checkpoints by job: snapshots as Parquet or JSON with a manifest, and jobs that resume."""

from __future__ import annotations

import copy
import functools
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from flowframe.functions.policy import checkpoint_interval


@dataclass(frozen=True)
class Snapshot:
    job: str
    iteration: int
    kind: str
    at: float
    seconds: float
    reason: str


class CheckpointPolicy:
    """When to save: every max(100, floor(sqrt(total))) iterations, after a time, under pressure, or any of them."""

    def __init__(self, strategy: str = "sqrt_n", total: int | None = None, seconds: float = 300.0, pressed: Callable[[], bool] = lambda: False):
        if strategy not in ("sqrt_n", "time_based", "memory_pressure", "adaptive"):
            raise ValueError(f"unknown strategy {strategy!r}")
        self.strategy, self.total, self.seconds, self.pressed = strategy, total, seconds, pressed
        self.last_iteration, self.last_time = 0, time.monotonic()

    def reason(self, iteration: int) -> str | None:
        if self.strategy in ("sqrt_n", "adaptive") and iteration - self.last_iteration >= checkpoint_interval(self.total):
            return "sqrt_n"
        if self.strategy in ("time_based", "adaptive") and time.monotonic() - self.last_time >= self.seconds:
            return "time_based"
        if self.strategy in ("memory_pressure", "adaptive") and self.pressed():
            return "memory_pressure"
        return None

    def saved(self, iteration: int) -> None:
        self.last_iteration, self.last_time = iteration, time.monotonic()


class CheckpointManager:
    """Snapshots of a job under a folder of any file system Spark reaches; the last ``keep`` stay."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 10):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, job: str, state: DataFrame | dict, iteration: int, reason: str = "manual") -> Snapshot:
        """A frame is saved as Parquet, a dictionary as JSON. The manifest comes last: it makes the snapshot count."""
        began = time.time()
        at = f"{self.folder}/{job}/{iteration:012d}-{uuid.uuid4().hex[:8]}"
        kind = "frame" if isinstance(state, DataFrame) else "state"
        if kind == "frame":
            state.write.parquet(f"{at}/data")
        else:
            self._write(f"{at}/data", json.dumps(state))
        done = Snapshot(job, iteration, kind, began, time.time() - began, reason)
        self._write(f"{at}/manifest", json.dumps(asdict(done)))
        for old in self.list(job)[:-self.keep]:
            self._remove(old[1])
        return done

    def _write(self, path: str, text: str) -> None:
        stream = self._fs(path).create(self._path(path), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def _read(self, path: str) -> str:
        return "\n".join(r.value for r in self.spark.read.text(path, wholetext=True).collect())

    def list(self, job: str) -> list[tuple[Snapshot, str]]:
        """Complete snapshots with their folders, by iteration."""
        base = f"{self.folder}/{job}"
        fs = self._fs(base)
        if not fs.exists(self._path(base)):
            return []
        folders = sorted(str(s.getPath().toString()) for s in fs.listStatus(self._path(base)))
        return [(Snapshot(**json.loads(self._read(f"{f}/manifest"))), f) for f in folders if fs.exists(self._path(f"{f}/manifest"))]

    def restore(self, job: str, iteration: int | None = None) -> tuple[Snapshot, DataFrame | dict] | None:
        """The latest snapshot by iteration, or the one asked for; None if there is none."""
        found = [x for x in self.list(job) if iteration is None or x[0].iteration == iteration]
        if not found:
            return None
        snap, at = found[-1]
        return snap, self.spark.read.parquet(f"{at}/data") if snap.kind == "frame" else json.loads(self._read(f"{at}/data"))

    def _remove(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)

    def delete(self, job: str, iteration: int | None = None) -> int:
        gone = [at for snap, at in self.list(job) if iteration is None or snap.iteration == iteration]
        for at in gone:
            self._remove(at)
        return len(gone)

    def stats(self, job: str) -> dict[str, float]:
        snaps = [s for s, _ in self.list(job)]
        span = snaps[-1].at - snaps[0].at if len(snaps) > 1 else 0.0
        spent = sum(s.seconds for s in snaps)
        return {"count": len(snaps), "seconds": spent, "overhead_percent": 100 * spent / span if span > 0 else 0.0}


def recovery_text(manager: CheckpointManager, job: str) -> str:
    """How to go on with a job, as lines to read and to run."""
    found = manager.list(job)
    if not found:
        return f"job {job!r} has no snapshot under {manager.folder}: start it anew"
    snap = found[-1][0]
    return "\n".join((
        f"# job {job!r}: {len(found)} snapshots, the last after iteration {snap.iteration} ({snap.reason})",
        f"manager = CheckpointManager(spark, {manager.folder!r})",
        f"snapshot, state = manager.restore({job!r})",
        "# go on with iteration snapshot.iteration; functions made by resumable() and auto_checkpoint() do so by themselves"))


def auto_checkpoint(manager: CheckpointManager, job: str, policy: CheckpointPolicy | None = None):
    """A decorator for generator functions ``fn(..., resume=None)`` that yield states.

    Each yielded state (a dictionary or a frame) is passed on; the policy decides which are saved.
    A run that begins with snapshots of its job there is given ``resume``, the latest one's
    (snapshot, state), and counts on from it. The snapshots go when the generator ends by itself.
    """

    def wrap(fn: Callable) -> Callable:
        @functools.wraps(fn)
        def run(*args, **kwargs):
            own, found = policy or CheckpointPolicy(), manager.restore(job)
            at = found[0].iteration if found else 0
            own.saved(at)
            for at, state in enumerate(fn(*args, **kwargs, resume=found), at + 1):
                if why := own.reason(at):
                    manager.save(job, state, at, why)
                    own.saved(at)
                yield state
            manager.delete(job)

        return run

    return wrap


def checkpoint_method(attributes: list[str], manager: str = "checkpoints", policy: CheckpointPolicy | None = None):
    """A decorator for methods that are called again and again: it saves the named attributes of the object.

    The object holds its CheckpointManager in the attribute ``manager`` and may name its job in
    ``job``. The policy counts the calls; restore_attributes() puts the latest snapshot back.
    """

    def wrap(fn: Callable) -> Callable:
        @functools.wraps(fn)
        def run(self, *args, **kwargs):
            own = self.__dict__.setdefault("_checkpoint_policy", policy and copy.copy(policy) or CheckpointPolicy())
            result = fn(self, *args, **kwargs)
            calls = self.__dict__["_checkpoint_calls"] = self.__dict__.get("_checkpoint_calls", 0) + 1
            if why := own.reason(calls):
                getattr(self, manager).save(_job_of(self), {name: getattr(self, name) for name in attributes}, calls, why)
                own.saved(calls)
            return result

        return run

    return wrap


def _job_of(owner: object) -> str:
    return getattr(owner, "job", type(owner).__name__)


def restore_attributes(owner: object, manager: CheckpointManager) -> int:
    """Sets an object's attributes from its latest snapshot; the calls made up to it, 0 if there is none."""
    found = manager.restore(_job_of(owner))
    if not found:
        return 0
    snap, state = found
    vars(owner).update(state, _checkpoint_calls=snap.iteration)
    return snap.iteration


def resumable(manager: CheckpointManager, job: str, policy: CheckpointPolicy | None = None):
    """A decorator for step functions ``fn(state, iteration) -> state``; the run resumes after the last snapshot."""

    def wrap(fn: Callable[[dict, int], dict]) -> Callable[[dict, int], dict]:
        @functools.wraps(fn)
        def run(state: dict, total: int) -> dict:
            own = policy or CheckpointPolicy(total=total)
            start = 0
            if found := manager.restore(job):
                snap, state = found
                start = snap.iteration
                own.saved(start)
            for i in range(start, total):
                state = fn(state, i)
                if why := own.reason(i + 1):
                    manager.save(job, state, i + 1, why)
                    own.saved(i + 1)
            manager.delete(job)
            return state

        return run

    return wrap
