"""IP addresses as column expressions: parsing and the private-network test."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# Networks that are private, loopback or reserved by the IANA registries.
PRIVATE_V4 = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "240.0.0.0/4",
)
PUBLIC_V4_EXCEPTIONS = ("192.0.0.9/32", "192.0.0.10/32")
PRIVATE_V6 = (
    "::/127",
    "64:ff9b:1::/48",
    "100::/64",
    "2001::/23",
    "2001:db8::/32",
    "2002::/16",
    "3fff::/20",
    "fc00::/7",
    "fe80::/10",
)
PUBLIC_V6_EXCEPTIONS = (
    "2001:1::1/128",
    "2001:1::2/128",
    "2001:3::/32",
    "2001:4:112::/48",
    "2001:20::/28",
    "2001:30::/28",
)
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4_PATTERN = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"
V6_PATTERN = (
    r"^(?=.*:)(?!.*::.*::)(?!:[^:])(?!.*[^:]:$)([0-9A-Fa-f]{0,4}:){1,7}[0-9A-Fa-f]{0,4}$"
)


def v4_number(ip: Column) -> Column:
    """The address as a bigint, NULL when it is not a dotted quad."""
    part = F.split(ip, r"\.")
    number = F.lit(0).cast("bigint")
    for i in range(4):
        number = number * 256 + F.get(part, F.lit(i)).try_cast("bigint")
    return F.when(ip.rlike(V4_PATTERN), number)


def hex_form(ip: Column) -> Column:
    """8 hex digits of an IPv4 or 32 of an IPv6 address; NULL when it is neither."""

    def digits(text: Column, base: int, width: int) -> Column:
        parts = F.filter(F.split(text, r"\." if base == 10 else ":"), lambda g: g != "")
        return F.transform(parts, lambda g: F.lpad(F.lower(F.conv(g, base, 16)), width, "0"))

    head = digits(F.substring_index(ip, "::", 1), 16, 4)
    tail = digits(F.when(F.contains(ip, F.lit("::")), F.substring_index(ip, "::", -1)).otherwise(F.lit("")), 16, 4)
    front, back = F.array_join(head, ""), F.array_join(tail, "")
    joined = F.concat(F.rpad(front, F.lit(32) - F.length(back), "0"), back)
    given = F.length(front) + F.length(back)
    fits = F.when(F.contains(ip, F.lit("::")), given <= 28).otherwise(given == 32)
    return F.when(ip.rlike(V4_PATTERN), F.array_join(digits(ip, 10, 2), "")).when(
        ip.rlike(V6_PATTERN) & fits, joined
    )


def sort_key(ip: Column) -> Column:
    """A text that orders addresses: '4' and 8 hex digits, or '6' and 32; NULL when it is no address.

    An IPv4 address mapped into IPv6 is the IPv4 address.
    """
    digits = F.regexp_replace(hex_form(F.regexp_replace(ip, MAPPED_TEXT, "")), MAPPED_HEX, "$1")
    return F.concat(F.when(F.length(digits) == 8, "4").otherwise("6"), digits)


def number_key(number: Column) -> Column:
    """The same for an IPv4 address given as a number."""
    return F.concat(F.lit("4"), F.lpad(F.lower(F.hex(number.cast("bigint"))), 8, "0"))


def _prefix_pattern(network: str) -> str:
    """A pattern for the hex form of all addresses of a network."""
    net = ipaddress.ip_network(network)
    size = net.max_prefixlen // 4
    text = f"{int(net.network_address):0{size}x}"
    whole, rest = divmod(net.prefixlen, 4)
    pattern = text[:whole]
    if rest:
        first = int(text[whole], 16)
        pattern += "[" + "".join(f"{d:x}" for d in range(first, first + (1 << (4 - rest)))) + "]"
        whole += 1
    return pattern + (f"[0-9a-f]{{{size - whole}}}" if whole < size else "")


def _any_of(networks) -> str:
    return "(" + "|".join(_prefix_pattern(n) for n in networks) + ")$"


MAPPED_HEX = "^0{20}ffff([0-9a-f]{8})$"
MAPPED_TEXT = r"(?i)^::ffff:(?=[0-9]+\.)"
LOCAL_HEX = f"^(?!{_any_of(PUBLIC_V4_EXCEPTIONS + PUBLIC_V6_EXCEPTIONS)}){_any_of(PRIVATE_V4 + PRIVATE_V6)}"


def is_local(ip: Column) -> Column:
    """True for private, loopback, missing and malformed addresses: traffic not worth logging.

    An IPv4 address mapped into IPv6 is judged as the IPv4 address.
    """
    digits = F.regexp_replace(hex_form(F.regexp_replace(ip, MAPPED_TEXT, "")), MAPPED_HEX, "$1")
    return F.coalesce(digits.rlike(LOCAL_HEX), F.lit(True))
