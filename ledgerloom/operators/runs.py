"""Requests: runs, their artifacts and the cache of verified answers, as append-only Parquet folders, one a record."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.errors import Refused
from ..sources.sinks import _exists

STATES = ("completed", "failed", "abstained")
_COLUMNS = "run_id string, artifact_type string, artifact_id string, payload string"


def canonical(payload: dict) -> str:
    """JSON with sorted keys and no spaces; binary floats are refused, as they have no exact text."""
    def check(x):
        if isinstance(x, float):
            raise Refused("BINARY_FLOAT")
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list | tuple) else ():
            check(y)

    check(payload)
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(payload: dict, leave_out: tuple[str, ...] = ()) -> str:
    return hashlib.sha256(canonical({k: v for k, v in payload.items() if k not in leave_out}).encode()).hexdigest()


class Runs:
    """The records of one folder.  A record is written once under a name of its own; the same again is fine, another refused."""

    def __init__(self, spark: SparkSession, path: str, types: tuple[str, ...]) -> None:
        self.spark, self.path, self.types = spark, path, types

    def _once(self, at: str, row: tuple, schema: str, code: str) -> None:
        where = f"{self.path}/{at}"
        if _exists(self.spark, f"{where}/_SUCCESS"):
            if tuple(self.spark.read.schema(schema).parquet(where).first()) != row:
                raise Refused(code, at)
            return
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(where)

    def start(self, run_id: str, request_key: str, dataset_version: str) -> None:
        self._once(f"runs/run={run_id}", (run_id, request_key, dataset_version), "run_id string, request_key string, dataset_version string", "RUN_CONFLICT")

    def finish(self, run_id: str, state: str) -> None:
        """A run that was started ends once, in one of STATES."""
        if state not in STATES:
            raise Refused("RUN_STATE", state)
        if not _exists(self.spark, f"{self.path}/runs/run={run_id}"):
            raise Refused("RUN_UNKNOWN", run_id)
        self._once(f"ends/run={run_id}", (run_id, state), "run_id string, state string", "RUN_FINISHED")

    def append(self, run_id: str, artifact_type: str, payload: dict) -> str:
        """The artifact's id, the content's hash; one artifact of a type a run, none after the run's end."""
        if artifact_type not in self.types:
            raise Refused("ARTIFACT_TYPE_UNKNOWN", artifact_type)
        if not _exists(self.spark, f"{self.path}/runs/run={run_id}"):
            raise Refused("RUN_UNKNOWN", run_id)
        text = canonical(payload)
        name = hashlib.sha256(f"{artifact_type}\0{text}".encode()).hexdigest()
        at = f"artifacts/run={run_id}/type={artifact_type}"
        if _exists(self.spark, f"{self.path}/ends/run={run_id}") and not _exists(self.spark, f"{self.path}/{at}"):
            raise Refused("RUN_FINISHED", run_id)
        self._once(at, (run_id, artifact_type, name, text), _COLUMNS, "ARTIFACT_CONFLICT")
        return name

    def get(self, run_id: str, artifact_type: str) -> dict:
        at = f"{self.path}/artifacts/run={run_id}/type={artifact_type}"
        if not _exists(self.spark, at):
            raise Refused("ARTIFACT_NOT_FOUND", artifact_type)
        row = self.spark.read.schema(_COLUMNS).parquet(at).first()
        if hashlib.sha256(f"{row.artifact_type}\0{row.payload}".encode()).hexdigest() != row.artifact_id:
            raise Refused("ARTIFACT_RESTORE_INVALID", artifact_type)
        return json.loads(row.payload)

    def artifacts(self) -> DataFrame:
        """All artifacts of all runs, as one table."""
        return self.spark.read.option("recursiveFileLookup", True).schema(_COLUMNS).parquet(f"{self.path}/artifacts")

    def cache(self, run_id: str, request_key: str, dataset_version: str, schema_version: str) -> None:
        """Keeps a run's released answer for its request, version and schema, if its hash is its content's and it is verified."""
        answer = self.get(run_id, "released_answer")
        if answer.get("response_hash") != digest(answer, ("response_hash",)):
            raise Refused("RELEASED_ANSWER_INVALID", run_id)
        if self.get(run_id, "verification_report").get("status") != "PASS":
            raise Refused("RELEASE_NOT_VERIFIED", run_id)
        key = hashlib.sha256("\0".join((request_key, dataset_version, schema_version)).encode()).hexdigest()
        self._once(f"cache/{key}", (request_key, dataset_version, schema_version, canonical(answer)), "request_key string, dataset_version string, schema_version string, payload string", "VERIFIED_RELEASE_CACHE_CONFLICT")

    def cached(self, request_key: str, dataset_version: str, schema_version: str) -> dict | None:
        key = hashlib.sha256("\0".join((request_key, dataset_version, schema_version)).encode()).hexdigest()
        if not _exists(self.spark, f"{self.path}/cache/{key}"):
            return None
        answer = json.loads(self.spark.read.parquet(f"{self.path}/cache/{key}").first().payload)
        if answer.get("response_hash") != digest(answer, ("response_hash",)):
            raise Refused("CACHED_RELEASE_INVALID", request_key)
        return answer


def write_report(spark: SparkSession, path: str, report: dict) -> None:
    """A report as one line of JSON; a path that is there is not written over."""
    if _exists(spark, path):
        raise Refused("REPORT_EXISTS", path)
    spark.createDataFrame([(canonical(report),)], "value string").coalesce(1).write.text(path)


def states(runs: DataFrame, ends: DataFrame) -> DataFrame:
    """run_id and state of every run; open until it ends."""
    return runs.join(ends, "run_id", "left").select("run_id", F.coalesce("state", F.lit("open")).alias("state"))
