"""The signature registry: known AI services, loaded from YAML files."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache
from pathlib import Path

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import schemas

log = logging.getLogger(__name__)

BUNDLED_DIR = str(Path(__file__).parent / "data" / "signatures")


class InvalidSignature(ValueError):
    """A signature document has a missing or wrongly typed field."""


@dataclass(frozen=True)
class DlpPattern:
    id: str
    pattern: str
    severity: str


@dataclass(frozen=True)
class Signature:
    id: str
    name: str
    version: str
    risk_base: int
    domains: tuple[str, ...] = ()
    ip_ranges: tuple[str, ...] = ()
    process_names: tuple[str, ...] = ()
    dlp_patterns: tuple[DlpPattern, ...] = ()
    user_agents: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    privacy_policy_url: str | None = None

    @classmethod
    def from_document(cls, doc: object) -> Signature:
        if not isinstance(doc, dict):
            raise InvalidSignature("a signature must be a mapping")
        http = doc.get("http_patterns", {})
        if not isinstance(http, dict):
            raise InvalidSignature("http_patterns must be a mapping")
        risk_base = doc.get("risk_base")
        if type(risk_base) is not int or not 0 <= risk_base <= 255:
            raise InvalidSignature("risk_base must be an integer from 0 to 255")
        url = doc.get("privacy_policy_url")
        if url is not None and not isinstance(url, str):
            raise InvalidSignature("privacy_policy_url must be text")
        patterns = doc.get("dlp_patterns", [])
        if not isinstance(patterns, list):
            raise InvalidSignature("dlp_patterns must be a list")
        return cls(
            id=_text(doc, "id"),
            name=_text(doc, "name"),
            version=_text(doc, "version"),
            risk_base=risk_base,
            domains=_texts(doc, "domains"),
            ip_ranges=_texts(doc, "ip_ranges"),
            process_names=_texts(doc, "process_names"),
            dlp_patterns=tuple(
                DlpPattern(_text(p, "id"), _text(p, "pattern"), _text(p, "severity"))
                for p in patterns
            ),
            user_agents=_texts(http, "user_agents"),
            tags=_texts(doc, "tags"),
            privacy_policy_url=url,
        )


def _text(doc: object, key: str) -> str:
    value = doc.get(key) if isinstance(doc, dict) else None
    if not isinstance(value, str):
        raise InvalidSignature(f"{key} must be text")
    return value


def _texts(doc: dict, key: str) -> tuple[str, ...]:
    values = doc.get(key, [])
    if not isinstance(values, list) or not all(isinstance(v, str) for v in values):
        raise InvalidSignature(f"{key} must be a list of texts")
    return tuple(values)


def parse_signatures(text: str) -> list[Signature]:
    """All documents of one file; raises InvalidSignature on the first bad one."""
    try:
        documents = list(yaml.safe_load_all(text))
    except yaml.YAMLError as error:
        raise InvalidSignature(f"not YAML: {error}") from error
    return [Signature.from_document(doc) for doc in documents]


@dataclass
class Registry:
    """Signatures by id; a later signature replaces an earlier one of its id."""

    signatures: dict[str, Signature] = field(default_factory=dict)

    @classmethod
    def of(cls, signatures: Iterable[Signature]) -> Registry:
        return cls({sig.id: sig for sig in signatures})

    @classmethod
    def load(cls, directory: str, spark: SparkSession | None = None) -> Registry:
        """Every ``*.yaml`` file of a folder; bad files are skipped with a warning.

        A missing folder gives an empty registry. Pass ``spark`` for a folder
        on cluster storage (any URI Spark can read).
        """
        registry = cls()
        for path, text in _yaml_files(directory, spark):
            try:
                found = parse_signatures(text)
            except InvalidSignature as error:
                log.warning("skipping signature file %s: %s", path, error)
                continue
            registry.signatures.update((sig.id, sig) for sig in found)
        return registry

    @classmethod
    @cache
    def bundled(cls) -> Registry:
        return cls.load(BUNDLED_DIR)

    def get(self, signature_id: str) -> Signature | None:
        return self.signatures.get(signature_id)

    def all(self) -> list[Signature]:
        """Sorted by id: where several match, the smallest id is taken."""
        return sorted(self.signatures.values(), key=lambda sig: sig.id)

    def __len__(self) -> int:
        return len(self.signatures)

    def domains(self) -> dict[str, str]:
        """Domain -> smallest id of the signatures that list it."""
        owners: dict[str, str] = {}
        for sig in self.all():
            for domain in sig.domains:
                owners.setdefault(domain, sig.id)
        return owners

    def process_names(self) -> dict[str, str]:
        """Process name -> smallest id of the signatures that list it."""
        owners: dict[str, str] = {}
        for sig in self.all():
            for name in sig.process_names:
                owners.setdefault(name, sig.id)
        return owners

    def frame(self, spark: SparkSession) -> DataFrame:
        """The registry as a table of SIGNATURE rows."""
        columns = [part.strip().split(" ", 1)[0] for part in schemas.SIGNATURE.split(", ")]
        rows = [
            {
                **{name: getattr(sig, name) for name in columns},
                "dlp_patterns": [vars(p) for p in sig.dlp_patterns],
            }
            for sig in self.all()
        ]
        return local_frame(spark, rows, schemas.SIGNATURE)


def local_frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small driver-side table, sent as Arrow so that Spark knows its size."""
    arrow_schema = _arrow_schema(spark, schema)
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=arrow_schema))


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _yaml_files(directory: str, spark: SparkSession | None) -> Iterator[tuple[str, str]]:
    if spark is None:
        folder = Path(directory)
        for path in sorted(folder.glob("*.yaml")) if folder.is_dir() else []:
            try:
                yield str(path), path.read_text(encoding="utf-8")
            except (OSError, UnicodeDecodeError) as error:
                log.warning("cannot read signature file %s: %s", path, error)
        return
    files = _signature_texts(spark, directory)
    if files is not None:
        for row in files.orderBy("path").toLocalIterator():
            yield row.path, row.text


def _signature_texts(spark: SparkSession, directory: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.text(directory, wholetext=True, pathGlobFilter="*.yaml").select(
            F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
        )
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def lint_signatures(spark: SparkSession, directory: str) -> DataFrame:
    """One ``(path, valid, error, id)`` row per signature file of a folder."""
    texts = spark.read.text(directory, wholetext=True, pathGlobFilter="*.yaml").select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )
    return texts.mapInPandas(_lint_batches, "path string, valid boolean, error string, id string")


def _lint_batches(batches):
    for batch in batches:
        reports = [_lint_one(text) for text in batch["text"]]
        yield batch[["path"]].assign(
            valid=[error is None for error, _ in reports],
            error=[error for error, _ in reports],
            id=[ids for _, ids in reports],
        )


def _lint_one(text: str) -> tuple[str | None, str | None]:
    try:
        return None, ",".join(sig.id for sig in parse_signatures(text))
    except InvalidSignature as error:
        return str(error), None


def signature_list(registry_df: DataFrame) -> DataFrame:
    """Listing sorted by id."""
    return registry_df.select("id", "version", "risk_base", "name").orderBy("id")
