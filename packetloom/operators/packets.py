"""Packets to feature rows: header fields, cleaning, masking and fixed-length bytes.

Input columns: ``packet`` (captured bytes), ``link_type`` (1 Ethernet, else the packet starts at
its network layer), and whatever else the caller carries along. Everything here is an expression
on the packet, so a scan, these steps and a write form one stage without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.headers import PROTO_TCP, PROTO_UDP, TYPE_ARP, UDP_HEADER, header_fields
from packetloom.functions.octets import FEATURE_BYTES, crop_and_pad, cropped_length, head, hex_text, overwrite_zero

# Flag bits, ports, the UDP fill, and snap lengths.
FIN_SYN_ACK = 0x13
NAME_SERVICE_PORTS = [53, 5353]
UDP_FILL = 12
SNAP_DEFAULT = 222
SNAP_UDP = 170


def dissect(packets: DataFrame) -> DataFrame:
    """Add header columns.

    ``l3`` and ``l4`` are 1-based offsets of the network and transport headers; ``payload_start``
    and ``payload_len`` give the transport payload by the header lengths, without link padding;
    ``trailing`` counts all captured bytes after the transport header. Addresses are hex text.
    """
    fields = packets.withColumn("_h", header_fields(F.col("packet"), F.col("link_type")))
    df = fields.select(*packets.columns, "_h.*")
    v4, v6 = F.col("ip_version") == 4, F.col("ip_version") == 6

    def address(at4: int, at6: int) -> Column:
        p, l3 = F.col("packet"), F.col("l3")
        four, six = F.substring(p, l3 + at4, F.lit(4)), F.substring(p, l3 + at6, F.lit(16))
        return hex_text(F.when(v4, four).when(v6, six))

    return df.withColumns({"ip_src": address(12, 8), "ip_dst": address(16, 24)})


def is_tcp() -> Column:
    return F.coalesce(F.col("proto") == PROTO_TCP, F.lit(False))


def is_udp() -> Column:
    return F.coalesce(F.col("proto") == PROTO_UDP, F.lit(False))


def payload() -> Column:
    """Transport payload bytes of a dissected packet."""
    return F.substring(F.col("packet"), F.col("payload_start"), F.col("payload_len"))


def omitted(flags_from: str = "tcp") -> Column:
    """Control, empty, name-service and address-resolution packets.

    TCP with FIN, SYN or ACK and nothing but padding; UDP without anything behind its header; name
    service; ARP. ``flags_from="ip"`` tests the same bits on the outermost layer with a flags
    field: the IPv4 fragment flags, or TCP's for IPv6.
    """
    if flags_from == "tcp":
        flags = F.col("tcp_flags")
    elif flags_from == "ip":
        flags = F.when(F.col("ip_version") == 4, F.col("ip_df")).otherwise(F.col("tcp_flags")).cast("int")
    else:
        raise ValueError(f"flags_from must be 'tcp' or 'ip', not {flags_from!r}")
    control = is_tcp() & (flags.bitwiseAND(F.lit(FIN_SYN_ACK)) > 0) & (F.col("payload_len") == 0)
    empty = is_udp() & (F.col("trailing") == 0)
    named = F.col("sport").isin(NAME_SERVICE_PORTS) | F.col("dport").isin(NAME_SERVICE_PORTS)
    name_service = (is_tcp() | is_udp()) & named & (F.col("payload_len") > 0)
    return F.coalesce(control, F.lit(False)) | F.coalesce(empty, F.lit(False)) | F.coalesce(
        name_service, F.lit(False)
    ) | F.coalesce(F.col("eth_type") == TYPE_ARP, F.lit(False))


def keep_useful(dissected: DataFrame, flags_from: str = "tcp") -> DataFrame:
    return dissected.where(~omitted(flags_from))


def without_link_header() -> Column:
    """The packet from its network layer on."""
    return F.substring(F.col("packet"), F.col("l3"), F.octet_length("packet"))


def masked_addresses(b: Column, start: Column, ipv6: bool = False) -> Column:
    """Both IPv4 addresses zeroed, given where the network header starts; IPv6 only on request."""
    v4 = overwrite_zero(b, start + 12, 8)
    masked = F.when(F.col("ip_version") == 4, v4)
    if ipv6:
        masked = masked.when(F.col("ip_version") == 6, overwrite_zero(b, start + 8, 32))
    return masked.otherwise(b)


def masked_ports(b: Column, start: Column) -> Column:
    """TCP and UDP ports zeroed, given where the transport header starts."""
    return F.when(is_tcp() | is_udp(), overwrite_zero(b, start, 4)).otherwise(b)


def widened_udp(b: Column, start: Column) -> Column:
    """Twelve zero bytes behind the UDP header, which makes it as long as TCP's."""
    end = start + UDP_HEADER
    wide = F.concat(F.substring(b, F.lit(1), end - 1), F.lit(bytes(UDP_FILL)), F.substring(b, end, F.octet_length(b)))
    return F.when(is_udp(), wide).otherwise(b)


def feature_rows(
    packets: DataFrame,
    label: str = "label",
    carry: list[str] | None = None,
    width: int = FEATURE_BYTES,
    flags_from: str = "tcp",
    widen_udp: bool = False,
    mask_ipv6: bool = False,
) -> DataFrame:
    """Packets to ``(x, feature_len, labels)``; omitted packets give no row."""
    df = keep_useful(dissect(packets), flags_from)
    shift = F.col("l4") - F.col("l3") + 1
    df = df.withColumn("_b", without_link_header())
    df = df.withColumn("_b", masked_ports(masked_addresses(F.col("_b"), F.lit(1), mask_ipv6), shift))
    if widen_udp:
        df = df.withColumn("_b", widened_udp(F.col("_b"), shift))
    return df.select(
        *(carry or []),
        crop_and_pad(F.col("_b"), width).alias("x"),
        cropped_length(F.col("_b"), width).alias("feature_len"),
        F.col(label).alias("labels"),
    )


def snapped(packets: DataFrame, n: int = SNAP_DEFAULT) -> DataFrame:
    """Only the first ``n`` bytes of every packet; the recorded wire length stays."""
    return packets.withColumn("packet", head(F.col("packet"), n))


def with_payload(dissected: DataFrame) -> DataFrame:
    """TCP and UDP packets that carry payload, with ``protocol`` naming which."""
    protocol = F.when(is_tcp(), "TCP").when(is_udp(), "UDP")
    return dissected.withColumn("protocol", protocol).where(F.col("protocol").isNotNull() & (F.col("payload_len") > 0))


def snapped_by_protocol(df: DataFrame, data: str = "packet", protocol: str = "protocol", udp: int = SNAP_UDP) -> DataFrame:
    """UDP packets cut to ``udp`` bytes, TCP packets whole, others dropped."""
    cut = F.when(F.col(protocol) == "UDP", head(F.col(data), udp)).when(F.col(protocol) == "TCP", F.col(data))
    return df.where(F.col(protocol).isin("TCP", "UDP")).withColumn(data, cut)


def dotted(address: str) -> Column:
    """The dotted form of an IPv4 address given as eight hex digits; others stay."""
    octets = [F.conv(F.substring(address, i, 2), 16, 10) for i in (1, 3, 5, 7)]
    return F.when(F.length(address) == 8, F.concat_ws(".", *octets)).otherwise(F.col(address))


def extracted_fields(dissected: DataFrame) -> DataFrame:
    """The field-extract columns of every TCP or UDP packet, without stream number and relative time.

    IPv4 addresses are dotted, others hexadecimal.
    """
    return dissected.where(is_tcp() | is_udp()).select(
        "file_path",
        "frame_no",
        "ts",
        F.when(is_tcp(), "tcp").otherwise("udp").alias("protocol"),
        dotted("ip_src").alias("ip_src"),
        "sport",
        dotted("ip_dst").alias("ip_dst"),
        "dport",
        F.col("wire_len").alias("frame_len"),
        "ip_len",
        hex_text(payload()).alias("payload"),
    )
