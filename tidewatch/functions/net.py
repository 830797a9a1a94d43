"""Address predicates as column expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: one octet 0-255, leading zeros allowed.
OCTET = "(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IPV4_PATTERN = "^" + r"\.".join([OCTET] * 4) + "$"

# Resolver access list and private ranges.
ACCESS_RANGES = ["10.10.10.0/24", "127.0.0.1/32", "192.168.0.0/16"]
PRIVATE_RANGES = ["192.168.0.0/16", "169.254.0.0/16", "172.16.0.0/12", "10.0.0.0/8", "fd00::/8", "fe80::/10"]


def is_ipv4(col: Column) -> Column:
    """Four dotted octets; NULL is not an address."""
    return F.coalesce(col.rlike(IPV4_PATTERN), F.lit(False))


def _octet(low: int, high: int) -> str:
    """Pattern of the octets from low to high, leading zeros allowed."""
    if (low, high) == (0, 255):
        return OCTET
    values = (str(v) for v in range(low, high + 1))
    return "(" + "|".join("0{0,%d}%s" % (3 - len(v), v) for v in values) + ")"


def address_hex(col: Column) -> Column:
    """An address as 8 (IPv4) or 32 (IPv6) lower-case hex digits, NULL if it is none.

    IPv6 may be compressed, end in a dotted IPv4 part and carry a zone (`%eth0`, ignored).
    IPv4-mapped addresses (`::ffff:1.2.3.4`) are the IPv4 address itself. Octets may have
    leading zeros.
    """
    def octets(text: Column) -> Column:
        return F.array_join(F.transform(F.split(text, r"\."), lambda o: F.lpad(F.hex(o.cast("int")), 2, "0")), "")

    text = F.lower(F.substring_index(col, "%", 1))
    tail = F.regexp_extract(text, r":([0-9]+\.[0-9.]+)$", 1)
    digits = octets(tail)
    head = F.substr(text, F.lit(1), F.char_length(text) - F.char_length(tail))
    # the dotted part as two groups
    groups = F.when(tail == "", text).when(tail.rlike(IPV4_PATTERN), F.concat(
        head, F.substr(digits, F.lit(1), F.lit(4)), F.lit(":"), F.substr(digits, F.lit(5), F.lit(4))))
    sides = F.split(groups, "::")

    def words(side: Column) -> Column:
        return F.filter(F.split(side, ":"), lambda w: w != "")

    def padded(ws: Column) -> Column:
        return F.array_join(F.transform(ws, lambda w: F.lpad(w, 4, "0")), "")

    left, right = words(F.get(sides, F.lit(0))), words(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
    n = F.size(left) + F.size(right)
    short = F.size(sides) == 2
    group = "[0-9a-f]{1,4}"
    form = groups.rlike(f"(?i)^({group}(:{group})*)?(::({group}(:{group})*)?)?$") & groups.contains(":")
    whole = F.when(form & F.when(short, n <= 7).otherwise(n == 8), F.concat(
        padded(left), F.repeat(F.lit("0"), (8 - n) * 4), padded(right)))
    six = F.lower(whole)
    mapped = F.when(six.startswith("0" * 20 + "ffff"), F.substr(six, F.lit(25), F.lit(8))).otherwise(six)
    return F.when(is_ipv4(col), F.lower(octets(col))).when(col.contains(":"), mapped)


def prefix_of(digits: Column, length: Column) -> Column:
    """The first `length` bits of an address in hex digits, as a text that tells the families apart."""
    rest = length % 4
    last = F.substr(digits, F.lit(1) + F.floor(length / 4).cast("int"), F.lit(1))
    kept = F.lit("")
    for bits, zeros in ((1, "0000000088888888"), (2, "000044448888cccc"), (3, "0022446688aaccee")):
        kept = F.when(rest == bits, F.translate(last, "0123456789abcdef", zeros)).otherwise(kept)
    family = F.when(F.char_length(digits) == 8, "4:").otherwise("6:")
    return F.concat(family, F.substr(digits, F.lit(1), F.floor(length / 4).cast("int")), kept)


def _range_pattern(text: str) -> str | None:
    """Pattern of the addresses in one CIDR range, None if one on the text cannot tell.

    IPv6 prefixes may be up to 16 bits long, so that the first group decides.
    """
    net = ipaddress.ip_network(text)
    low, high = net.network_address.packed, net.broadcast_address.packed
    if net.version == 4:
        return r"\.".join(_octet(a, b) for a, b in zip(low, high)) + "$"
    if net.prefixlen > 16 or low[0] < 0x10:
        return None
    digits = zip(low[:2].hex(), high[:2].hex())
    return "".join("[" + "0123456789abcdef"[int(a, 16):int(b, 16) + 1] + "]" for a, b in digits) + ":"


def in_cidr(col: Column, ranges: list[str]) -> Column:
    """True if the address lies in one of the configured ranges.

    The ranges are configuration, so they become one pattern: a single pass over the text
    decides, and no join is planned. Longer IPv6 prefixes are compared in hex digits. For
    ranges that are data, see `operators.ranges`.
    """
    patterns = {r: _range_pattern(r) for r in ranges}
    pattern = "(?i)^(" + "|".join(p for p in patterns.values() if p) + ")"
    found = col.rlike(pattern) if any(patterns.values()) else F.lit(False)
    for text in (r for r, p in patterns.items() if not p):
        net = ipaddress.ip_network(text)
        digits = address_hex(col)
        wanted = prefix_of(F.lit(net.network_address.packed.hex()), F.lit(net.prefixlen))
        found = found | (prefix_of(digits, F.lit(net.prefixlen)) == wanted)
    return F.coalesce(found, F.lit(False))


def is_private(col: Column) -> Column:
    return in_cidr(col, PRIVATE_RANGES)
