"""Which texts are IP address literals, decided in Catalyst."""

from pyspark.sql import Column, functions as F

# Address grammar. No leading zeros in IPv4; a scope such as ``%eth0`` may follow IPv6.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DOTTED = OCTET + r"(?:\." + OCTET + r"){3}"
IPV4 = "^" + DOTTED + r"\z"
HEX = r"[0-9a-fA-F]{1,4}"
GROUPS = HEX + "(?::" + HEX + ")*"
IPV6_FULL = "^" + HEX + "(?::" + HEX + r"){7}\z"
IPV6_SHORT = "^(?:" + GROUPS + ")?::(?:" + GROUPS + r")?\z"
SCOPE = r"^([^%/]*)%[^%/]+\z"
IPV4_TAIL = "(?<=:)" + DOTTED + r"\z"


def is_ipv4(host: Column) -> Column:
    return host.rlike(IPV4)


def is_ipv6(host: Column) -> Column:
    """Eight groups, or fewer around one ``::``; the last two groups may be written as an IPv4 address."""
    bare = F.when(host.rlike(SCOPE), F.regexp_extract(host, SCOPE, 1)).otherwise(host)
    groups = F.regexp_replace(bare, IPV4_TAIL, "0:0")
    written = F.size(F.filter(F.split(groups, ":"), lambda part: part != ""))
    return groups.rlike(IPV6_FULL) | (groups.rlike(IPV6_SHORT) & (written <= 7))


def is_host(host: Column) -> Column:
    return F.coalesce(is_ipv4(host) | is_ipv6(host), F.lit(False))
