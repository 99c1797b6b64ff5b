"""Hashing, keying, encrypting and decrypting whole columns; the state lives in the header."""

from __future__ import annotations

import os
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crypto
from ..model import EngineError, Marker
from ..sources.table import Table


def _replaced(table: Table, new: dict[int, Column], header) -> Table:
    cells = [new.get(i, F.col("fields")[i]) for i in range(table.header.width)]
    raws = F.array(*(F.lit(None).cast("binary") if i in new else F.col("raws")[i] for i in range(table.header.width)))
    df = table.df.withColumns({"fields": F.array(*cells), "raws": F.when(F.col("raws").isNotNull(), raws)})
    return replace(table, df=df, header=header, load=None, known=table.total() if table.load else table.known)


def _plain(table: Table, columns: list[int]) -> None:
    if not table.header.rows:
        raise EngineError("usage", "without a header there is nowhere to note protection", "沒有標頭，無處記錄保護狀態")
    for c in columns:
        m = table.header.markers()[c]
        if m.kind:
            raise EngineError("protected", f'column "{m.base}" is protected already', f"欄位「{m.base}」已受保護")


def hashed(table: Table, columns: str, secret: bytes | None = None) -> Table:
    """SHA-256 of each cell in hex; with a secret, HMAC-SHA256 under a key derived from it."""
    at = table.header.resolve_list(columns)
    _plain(table, at)
    header, key = table.header, crypto.hmac_key(crypto.check_secret(secret)) if secret is not None else None
    for c in at:
        base = table.header.markers()[c].base
        header = header.marked(c, Marker(base, "hmac", crypto.key_id(key)) if key else Marker(base, "hash"))
    made = {c: (crypto.hmac_hex(F.col("fields")[c], key) if key else crypto.sha256_hex(F.col("fields")[c])).cast("binary") for c in at}
    return _replaced(table, made, header)


def _sealing(key: bytes, base: str):
    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: crypto.encrypt_cell(key, bytes(v), base))

    return run.asNondeterministic()


def _opening(key: bytes, base: str):
    @F.pandas_udf("binary")
    def run(values: pd.Series, records: pd.Series) -> pd.Series:
        return pd.Series([crypto.decrypt_cell(key, bytes(v), base, int(r)) for v, r in zip(values, records, strict=True)], dtype=object)

    return run


def encrypted(table: Table, columns: str, secret: bytes) -> Table:
    at = table.header.resolve_list(columns)
    _plain(table, at)
    crypto.check_secret(secret)
    header, made = table.header, {}
    for c in at:
        base, salt = table.header.markers()[c].base, os.urandom(16)
        key = crypto.derive_key(secret, salt)
        header = header.marked(c, Marker(base, "enc", crypto.key_id(key), salt))
        made[c] = _sealing(key, base)(F.col("fields")[c])
    return _replaced(table, made, header)


def decrypted(table: Table, columns: str, secret: bytes) -> Table:
    """Fingerprints are compared before any cell is touched; a bad tag names its record and column."""
    header, made = table.header, {}
    for c in table.header.resolve_list(columns, encrypted_only=True):
        m = table.header.markers()[c]
        if m.kind != "enc":
            raise EngineError("protected", f'column "{m.base}" is not encrypted', f"欄位「{m.base}」未加密")
        key = crypto.derive_key(secret, m.salt)
        if crypto.key_id(key) != m.key_id:
            raise EngineError("auth", f'column "{m.base}" was encrypted with another key', f"欄位「{m.base}」是以另一把金鑰加密的")
        header = header.marked(c, Marker(m.base))
        made[c] = _opening(key, m.base)(F.col("fields")[c], F.col("record"))
    return _replaced(table, made, header)


def sha256_column(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, crypto.sha256_hex(F.col(column).cast("binary")))
