"""Arrow UDFs of the codecs and ciphers: a batch of blocks at a time, one block per row."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from satchel.functions import cipher, huffman

ENCODED = "metadata binary, payload binary"


def encode_with(codec) -> callable:
    """``codec.compress`` as a UDF from a block to its (metadata, payload).  A null or empty
    block has none."""

    @F.pandas_udf(ENCODED)
    def encode(block: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([codec.compress(b) if b else (None, None) for b in block], columns=["metadata", "payload"])

    return encode


def decode_with(codec) -> callable:
    """``codec.decompress`` as a UDF of metadata, payload and the most bytes to return."""

    @F.pandas_udf("binary")
    def decode(metadata: pd.Series, payload: pd.Series, most: pd.Series) -> pd.Series:
        return pd.Series([codec.decompress(m, p, int(n)) if p is not None else b"" for m, p, n in zip(metadata, payload, most, strict=True)], dtype=object)

    return decode


def huffman_encode(block: Column) -> Column:
    return encode_with(huffman)(block)


def huffman_decode(metadata: Column, payload: Column, most: Column) -> Column:
    return decode_with(huffman)(metadata, payload, most)


def encrypt(data: Column, key: bytes, iv: Column | None = None, cipher=cipher) -> Column:
    """IV and ciphertext under a cipher of ``plans.modes``.  Without a column of IVs each block
    draws its own."""
    if iv is not None:

        @F.pandas_udf("binary")
        def with_iv(block: pd.Series, ivs: pd.Series) -> pd.Series:
            there = block.notna()
            done = cipher.encrypt_many([bytes(b) for b in block[there]], key, [bytes(i) for i in ivs[there]])
            out = pd.Series([None] * len(block), dtype=object)
            out[there.to_numpy()] = [bytes(i) + e for i, e in zip(ivs[there], done, strict=True)]
            return out

        return with_iv(data, iv)

    @F.pandas_udf("binary")
    def drawn(block: pd.Series) -> pd.Series:
        there = block.notna()
        ivs = [os.urandom(16) for _ in range(int(there.sum()))]
        done = cipher.encrypt_many([bytes(b) for b in block[there]], key, ivs)
        out = pd.Series([None] * len(block), dtype=object)
        out[there.to_numpy()] = [i + e for i, e in zip(ivs, done, strict=True)]
        return out

    return drawn.asNondeterministic()(data)


def decrypt(data: Column, key: bytes, cipher=cipher) -> Column:
    @F.pandas_udf("binary")
    def undo(block: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else cipher.decrypt(b, key) for b in block], dtype=object)

    return undo(data)


def key_column(password: Column) -> Column:
    """The key of a password column, by built-in functions."""
    return F.unhex(F.left(F.sha2(F.substring_index(password, "\0", 1).cast("binary"), 256), F.lit(32)))
