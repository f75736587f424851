"""Ip addresses and networks: IPv4 as BIGINT arithmetic, IPv6 as two BIGINT halves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4_PATTERN = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


def v4_number(text: Column) -> Column:
    """IPv4 text as a number, NULL for anything else."""
    octets = F.split(text, r"\.")
    value = sum((octets[i].cast("bigint") * (256 ** (3 - i)) for i in range(1, 4)), octets[0].cast("bigint") * 256**3)
    return F.when(text.rlike(V4_PATTERN), value)


def v4_text(number: Column) -> Column:
    parts = [F.pmod(F.shiftright(number, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *parts)


def v4_network(number: Column, length: Column) -> Column:
    """Network number of an address: its host bits cleared."""
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.lit(32) - length).cast("int"))
    return number - F.pmod(number, size)


def v4_cidr(text: Column) -> dict[str, Column]:
    """network and length of `a.b.c.d/n` (host bits allowed, n also as net or host mask), NULL for anything else."""
    tail = F.substring_index(text, "/", -1)
    mask = v4_number(tail)

    def mask_length(size: Column) -> Column:
        return F.when(F.bit_count(size) == 1, F.lit(32) - F.bit_count(size - 1))

    length = F.when(tail.rlike(r"^([0-9]|[12][0-9]|3[0-2])$"), tail.cast("int")).otherwise(
        F.coalesce(mask_length(F.lit(1 << 32) - mask), mask_length(mask + 1))
    )
    number = F.when(text.rlike(r"^[^/]+/[^/]+$"), v4_number(F.substring_index(text, "/", 1)))
    return {"network": F.when(length.isNotNull(), v4_network(number, length)), "length": F.when(number.isNotNull(), length)}


_GROUP = "[0-9A-Fa-f]{1,4}"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_V6_FULL = rf"^(?:{_GROUP}:){{6}}(?:{_GROUP}:{_GROUP}|{_V4})$"
_V6_SHORT = rf"^(?:{_GROUP}(?::{_GROUP})*)?::(?:(?:{_GROUP}:)*(?:{_GROUP}|{_V4}))?$"


def _v6_halves(address: Column) -> Column:
    """struct(hi, lo) of IPv6 text without a scope, NULL for anything else."""
    # A dotted end is two groups.
    dotted = v4_number(F.substring_index(address, ":", -1))
    as_groups = F.concat_ws(":", F.hex(F.shiftright(dotted, 16)), F.hex(F.pmod(dotted, F.lit(65536))))
    plain = F.when(
        F.contains(address, F.lit(".")), F.concat(F.regexp_replace(address, r"[^:]*$", ""), as_groups)
    ).otherwise(address)
    whole = address.rlike(_V6_FULL)
    groups = lambda part: F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))
    before, after = groups(F.substring_index(plain, "::", 1)), groups(F.substring_index(plain, "::", -1))
    gap = F.array_repeat(F.lit("0"), (F.lit(8) - F.size(before) - F.size(after)).cast("int"))
    fits = address.rlike(_V6_SHORT) & (F.size(before) + F.size(after) <= 7)
    eight = F.when(whole, F.split(plain, ":")).when(fits, F.concat(before, gap, after))
    digits = F.array_join(F.transform(eight, lambda g: F.lpad(g, 4, "0")), "")
    return F.transform(
        F.array(digits), lambda d: F.when(d.isNotNull(), F.struct(
            F.conv(F.substring(d, 1, 16), 16, -10).cast("bigint").alias("hi"), F.conv(F.substring(d, 17, 16), 16, -10).cast("bigint").alias("lo")
        )),
    )[0]


def _kept_bits(half: Column, bits: Column) -> Column:
    """The first bits of a half of an address, the others cleared."""
    mask = F.call_function("shiftleft", F.lit(-1).cast("bigint"), (F.lit(64) - bits).cast("int"))
    return F.when(bits <= 0, F.lit(0).cast("bigint")).when(bits >= 64, half).otherwise(half.bitwiseAND(mask))


def v6_parts(text: Column | str) -> Column:
    """struct(hi, lo, length): network halves and prefix length of IPv6 text or CIDR (host bits allowed), fields NULL for anything else.

    A scope (`%eth0`) is left out.
    """
    text = F.col(text) if isinstance(text, str) else text
    slashed = F.contains(text, F.lit("/"))
    tail = F.substring_index(text, "/", -1)
    digits = F.when(tail.rlike("^[0-9]+$"), F.regexp_replace(tail, "^0+(?=.)", ""))
    length = F.when(~slashed, F.lit(128)).when(F.length(digits) <= 3, digits.cast("int"))
    single = ~text.rlike("/.*/")
    address = F.regexp_replace(F.substring_index(text, "/", 1), "%[^%]+$", "")

    def networks(found: Column) -> Column:
        known = found["h"].isNotNull() & (found["n"] <= 128) & found["single"]
        return F.struct(
            F.when(known, _kept_bits(found["h"]["hi"], found["n"])).alias("hi"),
            F.when(known, _kept_bits(found["h"]["lo"], found["n"] - 64)).alias("lo"),
            F.when(known, found["n"].cast("bigint")).alias("length"),
        )

    read = F.struct(_v6_halves(address).alias("h"), length.alias("n"), single.alias("single"))
    return F.transform(F.array(read), networks)[0]


def v6_text(hi: Column | str, lo: Column | str) -> Column:
    """Canonical IPv6 text of two halves: lower case, the first longest run of two or more zero groups as `::`, and a dotted end for
    addresses that stand for IPv4."""
    hi, lo = (F.col(h) if isinstance(h, str) else h for h in (hi, lo))
    digits = F.concat(*(F.lpad(F.lower(F.hex(h)), 16, "0") for h in (hi, lo)))
    groups = F.transform(F.array(*(F.lit(4 * k + 1) for k in range(8))), lambda at: F.regexp_replace(F.substr(digits, at, F.lit(4)), "^0{1,3}", ""))

    def shortened(text: Column) -> Column:
        out = text
        for run in range(2, 9):
            first = rf"^(.*?)(?:^|:)0(?::0){{{run - 1}}}(?::|$)(.*)$"
            out = F.when(text.rlike(first), F.regexp_replace(text, first, "$1::$2")).otherwise(out)
        return out

    mapped = (hi == 0) & (F.shiftrightunsigned(lo, 32) == 0xFFFF)
    return F.when(mapped, F.concat(F.lit("::ffff:"), v4_text(F.pmod(lo, F.lit(1 << 32))))).otherwise(
        F.transform(F.array(F.array_join(groups, ":")), shortened)[0]
    )
