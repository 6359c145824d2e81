"""Content identities."""

from __future__ import annotations

import hashlib
import json
import platform
from importlib import metadata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def canonical(*parts: Column) -> Column:
    """Columns as one string: each with its length in front, nulls apart, so no two rows run together."""
    return F.concat(*(F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts))


def row_fingerprint(*parts: Column) -> Column:
    return F.sha2(canonical(*parts), 256)


def _json(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        value = json.loads(text)
        flat = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    except ValueError:
        return None
    return hashlib.sha256(flat.encode()).hexdigest()


@F.arrow_udf(T.StringType())
def _fingerprint(texts: pa.Array) -> pa.Array:
    return pa.array([_json(t) for t in texts.to_pylist()], pa.string())


def json_fingerprint(payload: Column) -> Column:
    """SHA-256 of a JSON text with sorted keys and no blanks; null for what isn't finite JSON."""
    return _fingerprint(payload)


def verified_artifact(content: Column, etag: Column) -> Column:
    """Whether content has its etag: a SHA-256 of 64 digits, or else the SHA-1 of a blob with its header."""
    header = F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8")
    blob = F.sha1(F.concat(header, F.unhex(F.lit("00")), content))
    return F.when(F.length(etag) == 64, F.sha2(content, 256) == etag).otherwise(blob == etag)


def lock_error(repo: Column, expected_repo: str, kind: Column, expected_kind: str, revision: Column) -> Column:
    """Why a model lock can't be trusted; null if it can."""
    fine = (repo == expected_repo) & (kind == expected_kind) & revision.rlike(r"^[a-f0-9]{40}\z")
    return F.when(~F.coalesce(fine, F.lit(False)), "model_lock_invalid")


def runtime_versions(packages: tuple[str, ...] = ("pyspark", "pyarrow", "numpy")) -> dict[str, Column]:
    """Versions of the running software as literal columns; null for what isn't installed."""

    def version(name):
        try:
            return metadata.version(name)
        except metadata.PackageNotFoundError:
            return None

    return {"python": F.lit(platform.python_version()), **{p: F.lit(version(p)) for p in packages}}
