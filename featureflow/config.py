"""Job configuration: the shapes a deploy or replay request carries."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class InputSpec:
    """One topic: its name, its declared schema and optional inline samples."""

    topic: str
    topic_schema: Any  # list of {"name", "type"} or {"fields": [...]}
    sample: list[dict] | str = field(default_factory=list)  # or a folder of JSON lines


@dataclass(frozen=True)
class KafkaSpec:
    brokers: str
    confluent_api_key: str | None = field(default=None, repr=False)
    confluent_secret: str | None = field(default=None, repr=False)


@dataclass(frozen=True)
class OutputSpec:
    """How a stream is run: output mode and trigger interval."""

    mode: str = "append"
    processing_time: str = "2 seconds"


@dataclass(frozen=True)
class FileSpec:
    """Bound on how old an input file may be ("2d", "7 days", ...)."""

    max_file_age: str = "7d"


@dataclass(frozen=True)
class TableSpec:
    """Primary keys and declared output schema of a feature table."""

    primary_keys: list[str]
    output_schema: Any
    order_by: list[str] | None = None  # newest row wins; see store.FeatureStore


@dataclass(frozen=True)
class JobConfig:
    """Everything one live, replay or archive job needs.

    ``bucket`` is the shared root for archives, feature tables and
    checkpoints; ``run_id`` separates runs that each count batches from 0.
    """

    app_name: str
    bucket: str
    inputs: list[InputSpec]
    table: TableSpec | None = None
    output: OutputSpec = OutputSpec()
    files: FileSpec = FileSpec()
    kafka: KafkaSpec | None = None
    code_version: int = 1
    run_id: str = "run0"
    org: str = "default"
    checkpoint_location: str = "checkpoints"
    assertions: list[dict] | str = field(default_factory=list)  # or a folder of JSON lines

    @classmethod
    def from_request(cls, body: dict[str, Any], bucket: str, **overrides: Any) -> "JobConfig":
        """Build a config from a deploy or replay request body: ``inputs``,
        ``kafka``, ``outputs``, ``table``, optional ``fileinfo``, ``appname``,
        optional ``code_version`` and ``assertions``.  Other keys (for example
        the encoded user code) are ignored."""
        missing = [k for k in ("appname", "inputs") if k not in body]
        if missing:
            raise ValueError(f"request needs {missing}")
        bad = [n for n, i in enumerate(body["inputs"]) if "topic" not in i or "topic_schema" not in i]
        if bad:
            raise ValueError(f"inputs {bad} need 'topic' and 'topic_schema'")
        inputs = [InputSpec(i["topic"], i["topic_schema"], list(i.get("sample") or []))
                  for i in body["inputs"]]
        table = body.get("table")
        kafka = body.get("kafka")
        out = body.get("outputs") or {}
        files = body.get("fileinfo") or {}
        args: dict[str, Any] = dict(
            app_name=body["appname"],
            bucket=bucket,
            inputs=inputs,
            table=TableSpec(table["primary_keys"], table["output_schema"], table.get("order_by")) if table else None,
            output=OutputSpec(**out) if out else OutputSpec(),
            files=FileSpec(**files) if files else FileSpec(),
            kafka=KafkaSpec(**kafka) if kafka else None,
            code_version=int(body.get("code_version", 1)),
            assertions=list(body.get("assertions") or []),
        )
        args.update(overrides)
        return cls(**args)
