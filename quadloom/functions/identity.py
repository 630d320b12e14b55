"""Content identity: digests, canonical JSON and redaction of credentials."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that authenticate.
AUTH_PARAMETERS = ("access_token", "apikey", "api_key", "key", "mtsid", "session", "session_id", "token")
REQUEST_VERSION, OUTPUT_VERSION = "quadloom-request-1", "quadloom-output-1"


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def redacted(url: Column) -> Column:
    """The url with the values of authenticating query parameters replaced."""
    query = F.regexp_extract(url, r"^[^?]*\?([^#]*)", 1)
    head = F.regexp_extract(url, r"^[^?]*\?", 0)
    name = lambda p: F.substring_index(p, "=", 1)
    shown = F.array_join(F.transform(F.split(query, "&", -1), lambda p: F.when(F.lower(name(p)).isin(*AUTH_PARAMETERS), F.concat(name(p), F.lit("=<redacted>"))).otherwise(p)), "&")
    rest = F.substring(url, F.length(head) + F.length(query) + 1, F.length(url))
    return F.when(F.contains(url, F.lit("?")), F.concat(head, shown, rest)).otherwise(url)


def redact_text(url: str) -> str:
    head, mark, rest = url.partition("?")
    if not mark:
        return url
    query, hash_, fragment = rest.partition("#")
    shown = [p.partition("=")[0] + "=<redacted>" if p.partition("=")[0].lower() in AUTH_PARAMETERS else p for p in query.split("&")]
    return f"{head}?{'&'.join(shown)}{hash_}{fragment}"


def redact_json(value):
    if isinstance(value, dict):
        return {k: redact_json(v) for k, v in value.items()}
    if isinstance(value, list):
        return [redact_json(v) for v in value]
    return redact_text(value) if isinstance(value, str) else value


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(*parts: str | bytes) -> str:
    return hashlib.sha256(b"\n".join(p if isinstance(p, bytes) else p.encode() for p in parts)).hexdigest()


def request_key(style_digest: Column, z: Column, x: Column, y: Column, size: Column) -> Column:
    from quadloom.functions.tiles import canonical_x

    return sha256(F.concat_ws("\n", F.lit(REQUEST_VERSION), style_digest, F.concat_ws("/", z, canonical_x(x, z), y), size.cast("string")))


def content_key(header: Column, resources: Column) -> Column:
    """Of a header and an array of <kind, identity, digest>, in order of kind and identity."""
    lines = F.transform(F.array_sort(resources), lambda r: F.concat(r["kind"], F.lit(":"), r["identity"], F.lit(":"), r["digest"]))
    return sha256(F.concat_ws("\n", header, F.array_join(lines, "\n")))
