"""Hashes, stable ids and canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# This name and version, and the names and the order of the fields that are hashed below.
#: Name and version of the processor in fingerprints; pass those of another system to match its fingerprints.
PROCESSOR_ID, PROCESSOR_VERSION = "chaptermill.txt-import", "2"

UUID4 = r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
SHA256 = r"^[0-9a-f]{64}\z"


def sha256(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def json(**fields: Column) -> Column:
    """A JSON object of the fields in the order given; control characters escaped in lower case."""
    text = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    for code in [*range(0x0A, 0x0D), *range(0x0E, 0x10), *range(0x1A, 0x20)]:
        upper = f"\\u{code:04X}"
        if upper != upper.lower() and code not in (0x0A, 0x0C):
            text = F.replace(text, F.lit(upper), F.lit("\\u" + f"{code:04x}"))
    return text


def stable_id(namespace: str, source_hash: Column, start: Column, end: Column, content: Column) -> Column:
    """The namespace and 32 hexadecimal digits of the hash of what identifies a range."""
    what = json(namespace=F.lit(namespace), sourceHash=source_hash, startByte=start, endByte=end, content=content)
    return F.concat(F.lit(f"{namespace}-"), F.substring(sha256(what), 1, 32))


def processor_fingerprint(source_hash: Column, encoding: Column, processor: str = PROCESSOR_ID, version: str = PROCESSOR_VERSION) -> Column:
    return sha256(json(fingerprintSchemaVersion=F.lit(1), processorId=F.lit(processor), processorVersion=F.lit(version), sourceHash=source_hash, sourceEncoding=encoding))


def command_hash(**fields: Column) -> Column:
    """Hash of a command's JSON with its keys sorted; null fields are absent."""
    return sha256(json(**dict(sorted(fields.items()))))


def review_fingerprint(previous_revision: Column, command: Column) -> Column:
    return sha256(F.concat_ws(":", previous_revision, command))
