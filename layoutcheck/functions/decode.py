"""Scalars of stream files: as Python on bytes, and the same as Column expressions on binary columns."""

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the stream format: record types and data types by number.
RECORD_TYPES = {
    0x00: "HEADER", 0x01: "BGNLIB", 0x02: "LIBNAME", 0x03: "UNITS", 0x04: "ENDLIB", 0x05: "BGNSTR", 0x06: "STRNAME", 0x07: "ENDSTR",
    0x08: "BOUNDARY", 0x09: "PATH", 0x0A: "SREF", 0x0B: "AREF", 0x0C: "TEXT", 0x0D: "LAYER", 0x0E: "DATATYPE", 0x0F: "WIDTH",
    0x10: "XY", 0x11: "ENDEL", 0x12: "SNAME", 0x13: "COLROW", 0x15: "NODE", 0x1A: "STRANS", 0x1B: "MAG", 0x1C: "ANGLE",
    0x21: "PATHTYPE", 0x2A: "NODETYPE", 0x2D: "BOX", 0x2E: "BOXTYPE", 0x30: "BGNEXTN", 0x31: "ENDEXTN",
}
DATA_TYPES = {0: "no_data", 1: "bit_array", 2: "int16", 3: "int32", 4: "real32", 5: "real64", 6: "ascii_string"}
RECORD_NUMBERS = {name: number for number, name in RECORD_TYPES.items()}
DATA_NUMBERS = {name: number for number, name in DATA_TYPES.items()}


def int16(b: bytes, at: int = 0) -> int:
    return struct.unpack_from(">h", b, at)[0]


def int32(b: bytes, at: int = 0) -> int:
    return struct.unpack_from(">i", b, at)[0]


def real64(b: bytes) -> float:
    """Sign, exponent of 16 in excess 64, 56-bit mantissa. Missing low bytes are 0."""
    raw = int.from_bytes(b[:8].ljust(8, b"\0"), "big")
    mantissa, exponent = raw & ((1 << 56) - 1), (raw >> 56 & 0x7F) - 64
    return (-1.0 if raw >> 63 else 1.0) * mantissa * 16.0 ** (exponent - 14)


def encode_real64(v: float) -> bytes:
    if v == 0:
        return bytes(8)
    exponent, m = 64, abs(v)
    while m >= 1:
        m, exponent = m / 16, exponent + 1
    while m < 1 / 16:
        m, exponent = m * 16, exponent - 1
    return ((int(v < 0) << 63) | (exponent << 56) | round(m * (1 << 56))).to_bytes(8, "big")


def bit_array(b: bytes) -> int:
    """16 bits; bit 0 is the least significant."""
    return struct.unpack_from(">H", b)[0]


def string(b: bytes) -> str:
    """Without one trailing NUL; an empty payload is the empty string."""
    return (b[:-1] if b.endswith(b"\0") else b).decode("latin-1")


DATETIME = ("year", "month", "day", "hour", "minute", "second")


def datetime(b: bytes, at: int = 0) -> dict[str, int]:
    return dict(zip(DATETIME, struct.unpack_from(">6h", b, at)))


def point(b: bytes, at: int = 0) -> tuple[int, int]:
    return struct.unpack_from(">2i", b, at)


def point_count(payload: bytes) -> int:
    return len(payload) // 8


# -- the same on binary columns --------------------------------------------


def _unsigned(c: Column, at: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(c, at + 1, size)), 16, 10).cast("decimal(20,0)")


def int16_col(c: Column, at: int = 0) -> Column:
    v = _unsigned(c, at, 2).cast("int")
    return F.when(v >= 1 << 15, v - (1 << 16)).otherwise(v)


def int32_col(c: Column, at: int = 0) -> Column:
    v = _unsigned(c, at, 4).cast("long")
    return F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v)


def real64_col(c: Column) -> Column:
    c = F.rpad(F.hex(c), 16, "0")
    first = F.conv(F.substring(c, 1, 2), 16, 10).cast("int")
    mantissa = F.conv(F.substring(c, 3, 14), 16, 10).cast("double")
    return F.when(first >= 128, -1.0).otherwise(1.0) * mantissa * F.pow(F.lit(16.0), first % 128 - 64 - 14)


def bit_col(c: Column, i: int) -> Column:
    return F.bit_get(int16_col(c).cast("int"), F.lit(i)) == 1


def string_col(c: Column) -> Column:
    return F.regexp_replace(F.decode(c, "ISO-8859-1"), "\\x00$", "")


def point_col(c: Column, at: int = 0) -> Column:
    return F.struct(int32_col(c, at).alias("x"), int32_col(c, at + 4).alias("y"))


def datetime_col(c: Column, at: int = 0) -> Column:
    return F.struct(*(int16_col(c, at + 2 * i).alias(name) for i, name in enumerate(DATETIME)))


def point_count_col(c: Column) -> Column:
    return F.floor(F.length(c) / 8).cast("int")


def _name_of(code: Column, names: dict[int, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), code)


def record_name(code: Column) -> Column:
    """The record type's name; null for an unknown one."""
    return _name_of(code, RECORD_TYPES)


def data_type_name(code: Column) -> Column:
    return _name_of(code, DATA_TYPES)
