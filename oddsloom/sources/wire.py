"""Binary frames of a message feed: length-prefixed MessagePack, as the public formats describe them."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frames(data: bytes) -> list[bytes]:
    """Messages behind variable-length sizes (seven bits a byte, least first); a cut-off last one is left out."""
    out, at = [], 0
    while at < len(data):
        size = shift = 0
        while at < len(data):
            byte = data[at]
            at += 1
            size |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                break
        if at + size > len(data):
            break
        out.append(data[at : at + size])
        at += size
    return out


#: MessagePack's types of fixed width, and the widths of lengths of text, bytes, lists and maps.
_NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_SIZED = {0xC4: ("bin", ">B"), 0xC5: ("bin", ">H"), 0xC6: ("bin", ">I"), 0xD9: ("str", ">B"), 0xDA: ("str", ">H"), 0xDB: ("str", ">I"), 0xDC: ("list", ">H"), 0xDD: ("list", ">I"), 0xDE: ("map", ">H"), 0xDF: ("map", ">I")}


def unpack(data: bytes, at: int = 0) -> tuple[object, int]:
    """(value, end) of one MessagePack value; raises ValueError on unknown types and cut-off data."""
    if at >= len(data):
        raise ValueError("cut off")
    b = data[at]
    at += 1
    if b < 0x80:
        return b, at
    if b >= 0xE0:
        return b - 256, at
    if b in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[b], at
    try:
        if b in _NUMBERS:
            return struct.unpack_from(_NUMBERS[b], data, at)[0], at + struct.calcsize(_NUMBERS[b])
        if b in _SIZED:
            kind, width = _SIZED[b]
            n = struct.unpack_from(width, data, at)[0]
            at += struct.calcsize(width)
        elif b < 0xC0:
            kind, n = ("map", b & 0x0F) if b < 0x90 else ("list", b & 0x0F) if b < 0xA0 else ("str", b & 0x1F)
        else:
            raise ValueError(f"type {b:#x}")
    except struct.error as e:
        raise ValueError("cut off") from e
    if kind in ("str", "bin"):
        if at + n > len(data):
            raise ValueError("cut off")
        raw = data[at : at + n]
        return (raw.decode("utf-8", "replace") if kind == "str" else raw.hex()), at + n
    items = []
    for _ in range(n * (2 if kind == "map" else 1)):
        value, at = unpack(data, at)
        items.append(value)
    return (items if kind == "list" else {str(k): v for k, v in zip(items[::2], items[1::2])}), at


def messages(files: DataFrame, ident: str, content: str) -> DataFrame:
    """(ident, seq, message): each frame's value as JSON; frames that do not decode are left out. Positional fields and integer prices are
    then native projections: from_json, element_at, price / 100."""
    kind = dict(files.dtypes)[ident]

    def run(batches):
        for b in batches:
            out = []
            for i, c in zip(b["i"], b["c"]):
                for n, f in enumerate(frames(bytes(c))):
                    try:
                        out.append((i, n, json.dumps(unpack(f)[0])))
                    except ValueError:
                        continue
            if out:
                yield pd.DataFrame(out, columns=["i", "seq", "message"])

    return files.select(F.col(ident).alias("i"), F.col(content).alias("c")).where("c IS NOT NULL").mapInPandas(run, f"i {kind}, seq int, message string").withColumnRenamed("i", ident)
