"""Column expressions of the wire format: payload bits, parity, little-endian fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format: (first bit, width) of each payload field.
FIELDS = {"ptype": (0, 2), "chip": (2, 8), "channel": (10, 6), "timestamp": (16, 31), "adc": (48, 8), "downstream": (62, 1), "parity": (63, 1)}
HEADER, WORD = 8, 16


def field(payload: Column, name: str) -> Column:
    """One bit field of a payload that is held as the bit pattern of a BIGINT."""
    first, width = FIELDS[name]
    return F.shiftrightunsigned(payload, first).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def odd_parity(payload: Column) -> Column:
    """Whether the 64 bits hold an odd number of ones, as an accepted word does."""
    return F.bit_count(payload) % 2 == 1


def pack_payload(chip: Column, channel: Column, timestamp: Column, adc: Column, downstream: Column | None = None) -> Column:
    """Payload of a data word with odd parity; null if a field is null or outside of its bits."""
    parts = {"chip": chip, "channel": channel, "timestamp": timestamp, "adc": adc} | ({"downstream": downstream} if downstream is not None else {})
    body, fits = F.lit(0).cast("bigint"), F.lit(True)
    for name, c in parts.items():
        c = c.cast("bigint")
        body = body.bitwiseOR(F.shiftleft(c, FIELDS[name][0]))
        fits = fits & c.between(0, (1 << FIELDS[name][1]) - 1)
    return F.when(fits, body.bitwiseOR(F.shiftleft(((F.bit_count(body) + 1) % 2).cast("bigint"), 63)))


def pack_damaged(chip: Column, channel: Column, timestamp: Column, adc: Column, ptype: Column, downstream: Column, odd: Column) -> Column:
    """Payload of any data word: fields are cut to their bits, nulls are 0, and the parity is odd only where asked."""
    parts = {"ptype": ptype, "chip": chip, "channel": channel, "timestamp": timestamp, "adc": adc, "downstream": downstream}
    body = F.lit(0).cast("bigint")
    for name, c in parts.items():
        first, width = FIELDS[name]
        body = body.bitwiseOR(F.shiftleft(F.coalesce(c.cast("bigint"), F.lit(0)).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")), first))
    return body.bitwiseOR(F.shiftleft(((F.bit_count(body) + odd.cast("int")) % 2).cast("bigint"), 63))


def le_hex(value: Column, size: int) -> Column:
    """Hex digits of an unsigned little-endian number of ``size`` bytes."""
    digits = F.right(F.lpad(F.hex(value.cast("bigint")), 16, "0"), F.lit(2 * size))
    return F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))))


def le_number(data: Column, at: int, size: int) -> Column:
    """Unsigned little-endian number of up to 4 bytes, or the bit pattern of 8, at a byte offset of a BINARY."""
    digits = F.hex(F.substring(data, at + 1, size))
    part = lambda a, b: F.conv(F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(a, b)))), 16, 10).cast("bigint")
    if size <= 4:
        return part(0, size)
    return part(0, 4).bitwiseOR(F.shiftleft(part(4, 8), 32))
