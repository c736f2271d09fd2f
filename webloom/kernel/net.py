"""Which addresses and URLs may be reached."""

from __future__ import annotations

import ipaddress
import re

from webloom.kernel.url import Url, UrlError, parse

#: IPv4 ranges that are refused.
REFUSED_V4 = tuple(
    ipaddress.IPv4Network(n)
    for n in (
        "0.0.0.0/8",
        "10.0.0.0/8",
        "100.64.0.0/10",
        "127.0.0.0/8",
        "169.254.0.0/16",
        "172.16.0.0/12",
        "192.0.0.0/24",
        "192.0.2.0/24",
        "192.168.0.0/16",
        "198.18.0.0/15",
        "198.51.100.0/24",
        "203.0.113.0/24",
        "224.0.0.0/4",
        "240.0.0.0/4",
        "255.255.255.255/32",
    )
)
#: IPv6 ranges that are refused, in this order, and what they are.
REFUSED_V6 = (
    ("::1/128", "is loopback (::1)"),
    ("::/128", "is unspecified (::)"),
    ("fc00::/7", "is unique-local (fc00::/7)"),
    ("fe80::/10", "is link-local (fe80::/10)"),
    ("ff00::/8", "is multicast (ff00::/8)"),
    ("2001:db8::/32", "is documentation (2001:db8::/32)"),
    ("64:ff9b::/96", "is NAT64 (64:ff9b::/96)"),
)
_REFUSED_V6 = tuple((ipaddress.IPv6Network(n), why) for n, why in REFUSED_V6)
_DOTTED = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")


def address_refusal(ip: str) -> str | None:
    """Why an address literal is refused; None if it isn't."""
    if _DOTTED.fullmatch(ip):
        parts = [int(p) for p in ip.split(".")]
        if any(p > 255 for p in parts):
            return "invalid IPv4 literal"
        address = ipaddress.IPv4Address(bytes(parts))
        return f"IPv4 address {ip} is in a reserved/private range" if any(address in n for n in REFUSED_V4) else None
    try:
        v6 = ipaddress.IPv6Address(ip.partition("%")[0])
    except ValueError:
        return f'"{ip}" is not a valid IP literal'
    if v6.ipv4_mapped is not None:
        why = address_refusal(str(v6.ipv4_mapped))
        return f"IPv6 address {ip} maps to {v6.ipv4_mapped}: {why}" if why else None
    return next((f"IPv6 address {ip} {why}" for n, why in _REFUSED_V6 if v6 in n), None)


#: The reason against what isn't a URL.
NO_URL = "URL failed to parse"


def url_refusal(text: str | None, allow_private: bool = False) -> str | None:
    """Why a URL must not be fetched; None if it may."""
    try:
        url = parse(text or "")
    except UrlError:
        return NO_URL
    return refusal(url, allow_private)


def refusal(url: Url, allow_private: bool = False) -> str | None:
    """As url_refusal, of a parsed URL."""
    if url.scheme not in ("http", "https"):
        return f'scheme "{url.scheme}:" is not allowed (only http/https)'
    if allow_private:
        return None
    host = (url.host or "").strip("[]")
    if not host:
        return "URL has no hostname"
    if ":" in host or _DOTTED.fullmatch(host):
        return address_refusal(host)
    name = host.lower().removesuffix(".")
    if name == "localhost" or name.endswith(".localhost"):
        return f'hostname "{host}" resolves to loopback'
    return None


def answers_refusal(host: str, addresses: list[str]) -> str | None:
    """Why a name's addresses are refused: none of them may be."""
    if not addresses:
        return f"DNS: {host} returned no addresses"
    for ip in addresses:
        if why := address_refusal(ip):
            return f"DNS: {host} -> {ip} -- {why}"
    return None


# Ranges

_SIGN = 1 << 64


def _halves(n: int) -> tuple[int, int]:
    """128 bits as two signed longs."""
    return tuple(x - _SIGN if x >> 63 else x for x in (n >> 64, n & _SIGN - 1))


def _numbered(ip: str) -> tuple[int, int]:
    """Family and number of an address; an IPv6 address that maps an IPv4 one is that one. Raises ValueError."""
    address = ipaddress.ip_address(ip.strip().partition("%")[0])
    address = getattr(address, "ipv4_mapped", None) or address
    return address.version, int(address)


def address_number(ip: str) -> dict[str, int]:
    """family, high and low half of an address. IPv4 numbers stand in the upper 32 bits, so that prefixes of both families are masked alike."""
    family, n = _numbered(ip)
    high, low = _halves(n << 96 if family == 4 else n)
    return {"family": family, "high": high, "low": low}


def range_pieces(text: str) -> list[dict[str, int | str]]:
    """The prefixes that make up a range: an address, a network (``/``; bits beyond its length don't count) or two addresses (``-``).

    Each has family, length, high, low, and the width of the whole range as hexadecimal digits that sort like numbers. Raises ValueError.
    """
    if "/" in text:
        network = ipaddress.ip_network(text.strip(), strict=False)
        networks = [network]
    else:
        first, _, last = text.partition("-")
        (family, low), (other, high) = _numbered(first), _numbered(last or first)
        if family != other or low > high:
            raise ValueError(f"{text} is no range of addresses")
        kind = ipaddress.IPv4Address if family == 4 else ipaddress.IPv6Address
        networks = list(ipaddress.summarize_address_range(kind(low), kind(high)))
    width = sum(n.num_addresses for n in networks)
    out = []
    for n in networks:
        number = int(n.network_address)
        high, low = _halves(number << 96 if n.version == 4 else number)
        out.append({"family": n.version, "length": n.prefixlen, "high": high, "low": low, "width": f"{width:033x}"})
    return out
