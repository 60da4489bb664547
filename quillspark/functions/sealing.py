"""Sealing of texts and vectors (AES-256-GCM), content tags (HMAC-SHA256) and key wrapping, on Spark's own functions.

Keys are arguments of the expressions and so can show in plans: a deployment has to restrict plan and event logs.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import os
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

PBKDF2_ROUNDS = 600_000
PREFIXES = ("enc:v1:", "enc:v2:")


def hkdf(key: bytes, info: bytes, length: int, salt: bytes = bytes(32)) -> bytes:
    """HKDF with SHA-256 (RFC 5869)."""
    root, out, block = hmac.new(salt, key, hashlib.sha256).digest(), b"", b""
    for i in range(1, -(-length // 32) + 1):
        block = hmac.new(root, block + info + bytes([i]), hashlib.sha256).digest()
        out += block
    return out[:length]


def pin_key(pin: str, salt: bytes) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", pin.encode(), salt, PBKDF2_ROUNDS, 32)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hexadecimal digest of a binary column."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    pad = lambda x: F.lit(bytes(b ^ x for b in key.ljust(64, b"\0")))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message), 256))), 256)


def content_tag(key: bytes, normal_text: Column, book_id: Column) -> Column:
    """A keyed digest of the normalized text and its book, by which equal contents meet."""
    return hmac_sha256(key, F.concat(normal_text.cast("binary"), F.lit(b"\0"), F.coalesce(book_id, F.lit("")).cast("binary")))


def is_sealed(text: Column) -> Column:
    return text.startswith(PREFIXES[0]) | text.startswith(PREFIXES[1])


def seal_text(text: Column, key: bytes, iv: Column, note_id: Column | None = None) -> Column:
    """`enc:v2:` with the note's id as associated data, or `enc:v1:` without. Materialize the ivs first, never twice."""
    whole = F.aes_encrypt(text.cast("binary"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), iv, (note_id if note_id is not None else F.lit("")).cast("binary"))
    return F.concat(F.lit(PREFIXES[note_id is not None]), F.base64(F.substring(whole, 1, 12)), F.lit("."), F.base64(F.substring(whole, 13, 1 << 30)))


def open_text(sealed: Column, key: bytes, note_id: Column) -> Column:
    """The text, or null if the seal does not open."""
    parts = F.split(F.substring(sealed, 8, 1 << 30), r"\.")
    raw = F.concat(*(F.try_to_binary(F.get(parts, F.lit(k)), F.lit("base64")) for k in (0, 1)))
    opened = lambda aad: F.try_aes_decrypt(raw, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), aad.cast("binary")).cast("string")
    return F.when(sealed.startswith(PREFIXES[0]), opened(F.lit(""))).when(sealed.startswith(PREFIXES[1]), opened(note_id))


def readable(text: Column, key: bytes, note_id: Column) -> tuple[Column, Column]:
    """(text, failed): what is not sealed stays; a seal that does not open is null and failed."""
    opened = open_text(text, key, note_id)
    return F.when(is_sealed(text), opened).otherwise(text), F.coalesce(is_sealed(text) & opened.isNull(), F.lit(False))


def seal_bytes(raw: Column, key: bytes, iv: Column, aad: Column) -> Column:
    return F.concat(F.lit(b"\x02"), F.aes_encrypt(raw, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), iv, aad.cast("binary")))


def open_bytes(sealed: Column, key: bytes, aad: Column) -> Column:
    body = F.substring(sealed, 2, 1 << 30)
    return F.when(F.substring(sealed, 1, 1) == F.lit(b"\x02"), F.try_aes_decrypt(body, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), aad.cast("binary")))


@dataclass(frozen=True)
class Blob:
    """A wrapped key in base64, with the salt and iv that opening it takes."""

    wrapped_key: str
    iv: str
    salt: str


class Vault:
    """A master key, wrapped under other keys; sealing itself runs on one row in Spark.

    Keys are wrapped under one derived from a device's secret (`info` keeps this use of the secret apart from others) or,
    for a move to another device, from a PIN. Salts and ivs are drawn anew each time.
    """

    def __init__(self, spark: SparkSession, master: bytes, info: bytes = b""):
        self.spark, self.master, self.info = spark, master, info

    @classmethod
    def generate(cls, spark: SparkSession, info: bytes = b"") -> Vault:
        return cls(spark, os.urandom(32), info)

    def _one(self, column: Column):
        return self.spark.range(1).select(column.alias("x")).first()["x"]

    def wrap(self, key: bytes, iv: bytes) -> str:
        whole = bytes(self._one(F.aes_encrypt(F.lit(self.master), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(iv))))
        return f"{base64.b64encode(whole[:12]).decode()}.{base64.b64encode(whole[12:]).decode()}"

    def _blob(self, key: bytes, salt: bytes, iv: bytes) -> Blob:
        return Blob(self.wrap(key, iv).split(".")[1], base64.b64encode(iv).decode(), base64.b64encode(salt).decode())

    def wrap_with_secret(self, secret: bytes, salt: bytes | None = None, iv: bytes | None = None) -> Blob:
        """Under a device's secret; for another device the same again."""
        salt = salt or os.urandom(32)
        return self._blob(hkdf(secret, self.info, 32, salt), salt, iv or os.urandom(12))

    def wrap_with_pin(self, pin: str, salt: bytes | None = None, iv: bytes | None = None) -> Blob:
        salt = salt or os.urandom(32)
        return self._blob(pin_key(pin, salt), salt, iv or os.urandom(12))

    @classmethod
    def _opened(cls, spark: SparkSession, blob: str, key: bytes) -> bytes | None:
        try:
            raw = b"".join(base64.b64decode(x, validate=True) for x in blob.split("."))
        except ValueError:
            return None
        got = spark.range(1).select(F.try_aes_decrypt(F.lit(raw), F.lit(key), F.lit("GCM")).alias("x")).first()["x"]
        return bytes(got) if got is not None and len(got) == 32 else None

    @classmethod
    def unlock(cls, spark: SparkSession, blobs: list[str], key: bytes) -> Vault | None:
        """From the first blob that the key opens."""
        for blob in blobs:
            if (master := cls._opened(spark, blob, key)) is not None:
                return cls(spark, master)
        return None

    @classmethod
    def unlock_with_secret(cls, spark: SparkSession, blobs: list[Blob], secret: bytes, info: bytes = b"") -> Vault | None:
        """From whichever blob the secret opens; ones that can't be read are passed over."""
        for blob in blobs:
            try:
                key = hkdf(secret, info, 32, base64.b64decode(blob.salt, validate=True))
            except ValueError:
                continue
            if (master := cls._opened(spark, f"{blob.iv}.{blob.wrapped_key}", key)) is not None:
                return cls(spark, master, info)
        return None

    @classmethod
    def redeem_pin_transfer(cls, spark: SparkSession, blob: Blob, pin: str, info: bytes = b"") -> Vault | None:
        """On the new device, from what wrap_with_pin gave on the old one."""
        master = cls._opened(spark, f"{blob.iv}.{blob.wrapped_key}", pin_key(pin, base64.b64decode(blob.salt)))
        return None if master is None else cls(spark, master, info)
