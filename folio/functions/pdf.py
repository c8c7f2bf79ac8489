"""The objects of PDF files as text, those inside compressed object streams included."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_STREAM = re.compile(rb"<<((?:(?!endobj)[\s\S])*?/Type\s*/ObjStm\b(?:(?!endobj)[\s\S])*?)>>\s*stream\r?\n")
_LENGTH = re.compile(rb"/Length\s+(\d+)(?!\s+\d+\s+R)")
#: Bytes that one object stream may grow to; a longer one is read to there, and its file marked.
MOST = 64 << 20


def object_text(raw: bytes) -> tuple[str, bool]:
    """(text, whole): a file's bytes one to one as text, without the contents of streams, and what its object streams hold after that."""
    parts, at, whole = [], 0, True
    for m in re.finditer(rb"stream\r?\n", raw):
        if m.start() < at:
            continue
        end = raw.find(b"endstream", m.end())
        if end < 0:
            break
        parts.append(raw[at : m.end()])
        at = end
    parts.append(raw[at:])
    for m in _STREAM.finditer(raw):
        dictionary = m[1]
        length = _LENGTH.search(dictionary)
        end = m.end() + int(length[1]) if length else raw.find(b"endstream", m.end())
        body = raw[m.end() : end if end >= 0 else len(raw)]
        if b"/Filter" in dictionary:
            if not re.search(rb"/Filter\s*\[?\s*/FlateDecode\s*\]?", dictionary):
                whole = False
                continue
            try:
                inflate = zlib.decompressobj()
                body = inflate.decompress(body, MOST)
                whole &= not inflate.unconsumed_tail
            except zlib.error:
                whole = False
                continue
        parts.append(b"\n" + body)
    return b"".join(parts).decode("latin-1"), whole


def objects(content: Column) -> Column:
    """struct<text, whole> of a binary column; whole is false where an object stream could not be read to its end."""

    @F.pandas_udf("text string, whole boolean")
    def read(x):  # noqa: ANN001
        import pandas as pd

        found = [(None, None) if v is None else object_text(bytes(v)) for v in x]
        return pd.DataFrame(found, columns=["text", "whole"])

    return read(content)
