"""Hashes and signed manifests."""

from __future__ import annotations

import hashlib
import hmac
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNER_BYTES = 1024
#: The domain of our own manifests. To verify those of another family of tools, pass its domain.
DOMAIN = b"lumenforge-manifest-v1\0"
# Labels of a manifest's algorithms.
HASH_LABEL, SIGNATURE_LABEL, LEGACY_LABEL = "sha256", "hmac-sha256", "sha256-keyed"


def signing_key(key: str | None = None, key_file: str | None = None, default: bytes | None = None) -> bytes:
    """The key from one of a text and a file (without the line's end); ``default`` where neither is given."""
    if key is not None and key_file is not None:
        raise ValueError("specify only one of a key and a key file")
    if key is not None:
        if not key:
            raise ValueError("the signing key is empty")
        return key.encode()
    if key_file is not None:
        with open(key_file, "rb") as f:
            data = f.read().removesuffix(b"\n").removesuffix(b"\r")
        if not data:
            raise ValueError("the key file is empty")
        return data
    if default is None:
        raise ValueError("missing signing key")
    return default


def payload_sha256(payload: Column) -> Column:
    return F.sha2(payload.cast("binary"), 256)


def hmac_hex(digest: bytes, signer: bytes, key: bytes, domain: bytes = DOMAIN) -> str:
    """HMAC-SHA256 over a domain, the signer with its length, and the payload's hash."""
    return hmac.new(key, domain + struct.pack(">I", len(signer)) + signer + digest, hashlib.sha256).hexdigest()


def _keyed(df: DataFrame, key: bytes) -> DataFrame:
    """Adds the key's pads (``_inner``, ``_outer``) from a broadcast relation of one row, so that plans and logs of them, which
    print literals, never hold the key."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pads = tuple(bytearray(x ^ pad for x in block) for pad in (0x36, 0x5C))
    return df.crossJoin(F.broadcast(df.sparkSession.createDataFrame([pads], "_inner binary, _outer binary")))  # one row


def hmac_column(digest: Column, signer: Column, domain: bytes = DOMAIN) -> Column:
    """`hmac_hex` of columns (digest as hex) beside the pads of `_keyed`: SHA-256 over the outer pad and the SHA-256 over
    the inner pad and the message."""
    size = F.unhex(F.lpad(F.hex(F.octet_length(signer)), 8, "0"))
    message = F.concat("_inner", F.lit(bytearray(domain)), size, signer.cast("binary"), F.unhex(digest))
    return F.sha2(F.concat("_outer", F.unhex(F.sha2(message, 256))), 256)


def sign(payloads: DataFrame, signer: str, key: bytes, payload: str = "payload", domain: bytes = DOMAIN) -> DataFrame:
    """Adds the hash, the signature and their labels, all in generated code."""
    if not 1 <= len(signer.encode()) <= SIGNER_BYTES:
        raise ValueError("signer must have 1 to 1024 bytes")
    if not key:
        raise ValueError("a signing key is needed")
    hashed = payloads.withColumn("payload_sha256", payload_sha256(F.coalesce(F.col(payload).cast("binary"), F.lit(bytearray()))))
    labels = {"payload_hash_algorithm": F.lit(HASH_LABEL), "signature_algorithm": F.lit(SIGNATURE_LABEL), "signer": F.lit(signer)}
    return _keyed(hashed.withColumns(labels), key).withColumn("signature_hex", hmac_column(F.col("payload_sha256"), F.col("signer"), domain)).drop("_inner", "_outer")


def verify(manifests: DataFrame, key: bytes, payload: str = "payload", domain: bytes = DOMAIN) -> DataFrame:
    """Adds ``failure``: the first of shape, labels, hash and signature that does not hold, else null. Manifests without
    columns for the labels count as labelled."""
    now = payload_sha256(F.coalesce(F.col(payload).cast("binary"), F.lit(bytearray())))
    shape = F.col("signature_hex").rlike("^[0-9a-f]{64}$") & F.col("payload_sha256").rlike("^[0-9a-f]{64}$") & (F.octet_length("signer") <= SIGNER_BYTES)
    label = lambda c, d: F.col(c) if c in manifests.columns else F.lit(d)
    hashed, signed = label("payload_hash_algorithm", HASH_LABEL), label("signature_algorithm", SIGNATURE_LABEL)
    known = lambda c, d: F.coalesce(c == d, F.lit(False))
    failure = (
        F.when(~F.coalesce(shape, F.lit(False)), "manifest is malformed")
        .when(~known(hashed, HASH_LABEL), "unsupported payload_hash_algorithm")
        .when(known(signed, LEGACY_LABEL), "legacy sha256-keyed signature is not accepted; re-sign with hmac-sha256")
        .when(~known(signed, SIGNATURE_LABEL), "unsupported signature_algorithm")
        .when(F.col("_now") != F.col("payload_sha256"), "payload hash mismatch")
        .when(~F.coalesce(hmac_column(F.col("_now"), F.col("signer"), domain) == F.col("signature_hex"), F.lit(False)), "signature mismatch")
    )
    return _keyed(manifests.withColumn("_now", now), key).withColumn("failure", failure).drop("_now", "_inner", "_outer")


def stream_sha256(frames: DataFrame, by: str = "stream_id") -> DataFrame:
    """(stream, sha256) over each stream's frames in order: index, metadata with its length, pixel count, pixel bytes.

    ``frames`` has by, frame_index, meta_json and pixels (little-endian float32 bytes). Frames are hashed as they stream
    by; a stream is never held whole.
    """

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, h = None, None
        for b in batches:
            for stream, index, meta, pixels in zip(b[by], b.frame_index, b.meta_json, b.pixels, strict=True):
                if stream != at:
                    if h:
                        yield pd.DataFrame({by: [at], "sha256": [h.hexdigest()]})
                    at, h = stream, hashlib.sha256()
                m = (meta or "").encode()
                h.update(struct.pack("<QI", index, len(m)) + m + struct.pack("<Q", len(pixels) // 12) + pixels)
        if h:
            yield pd.DataFrame({by: [at], "sha256": [h.hexdigest()]})

    cols = frames.select(by, "frame_index", "meta_json", "pixels")
    return cols.repartition(by).sortWithinPartitions(by, "frame_index").mapInPandas(digest, f"{by} string, sha256 string")
