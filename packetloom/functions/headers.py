"""Header fields of packets, read for whole Arrow batches at once."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Link and network types, protocol numbers and header sizes.
LINK_ETHERNET = 1
ETHER_HEADER = 14
VLAN_TAG = 4
TYPE_IPV4 = 0x0800
TYPE_ARP = 0x0806
TYPE_VLAN = 0x8100
TYPE_IPV6 = 0x86DD
IPV6_HEADER = 40
PROTO_TCP = 6
PROTO_UDP = 17
UDP_HEADER = 8

# Ethernet with a tag, the longest IPv4 header, and TCP up to its flags.
HEAD_BYTES = ETHER_HEADER + VLAN_TAG + 60 + 14

FIELDS = [
    "eth_type", "l3", "ip_version", "ip_df", "proto", "ip_len", "l4", "sport", "dport", "tcp_flags",
    "payload_start", "payload_len", "trailing",
]


class _Heads:
    """Unsigned integers at per-row offsets of a binary array; absent ones are flagged invalid."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary()).fill_null(b"")  # offsets of 64 bits, whatever the session's types
        starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        self.data = np.append(np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), np.uint8(0))
        self.starts, self.sizes = starts[:-1].astype(np.int64), np.diff(starts)

    def uint(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        value = np.zeros(len(self.starts), np.int64)
        for i in range(n):
            value = value * 256 + self.data[np.minimum(self.starts + at + i, len(self.data) - 1)]
        return value, at + n <= self.sizes


def _fields(head: pa.Array, link_type: pa.Array, length: pa.Array) -> pa.Array:
    heads = _Heads(head)
    ether = link_type.fill_null(LINK_ETHERNET).to_numpy(zero_copy_only=False) == LINK_ETHERNET
    size = length.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    zero = np.zeros(len(head), np.int64)

    eth_type, has_type = heads.uint(zero + ETHER_HEADER - 2, 2)
    has_type &= ether
    tagged = has_type & (eth_type == TYPE_VLAN)
    inner_type, has_inner = heads.uint(zero + ETHER_HEADER + VLAN_TAG - 2, 2)
    eth_type, has_type = np.where(tagged, inner_type, eth_type), has_type & (~tagged | has_inner)
    l3 = np.where(tagged, ETHER_HEADER + VLAN_TAG, np.where(ether, ETHER_HEADER, 0))

    first, has_ip = heads.uint(l3, 1)
    version = first // 16
    has_ip &= (~ether | (has_type & np.isin(eth_type, [TYPE_IPV4, TYPE_IPV6]))) & np.isin(version, [4, 6])
    v4, v6 = has_ip & (version == 4), has_ip & (version == 6)
    fragment, has_fragment = heads.uint(l3 + 6, 2)
    next4, has_next4 = heads.uint(l3 + 9, 1)
    next6, has_next6 = heads.uint(l3 + 6, 1)
    proto = np.where(v4, next4, next6)
    has_proto = (v4 & has_next4 & has_fragment & (fragment % 8192 == 0)) | (v6 & has_next6)
    len4, has_len4 = heads.uint(l3 + 2, 2)
    len6, has_len6 = heads.uint(l3 + 4, 2)
    ip_len, has_len = np.where(v4, len4, len6 + IPV6_HEADER), (v4 & has_len4) | (v6 & has_len6)
    l4 = l3 + np.where(v4, first % 16 * 4, IPV6_HEADER)

    tcp, udp = has_proto & (proto == PROTO_TCP), has_proto & (proto == PROTO_UDP)
    sport, has_sport = heads.uint(l4, 2)
    dport, has_dport = heads.uint(l4 + 2, 2)
    doff, has_doff = heads.uint(l4 + 12, 1)
    tcp_flags, has_flags = heads.uint(l4 + 13, 1)
    start = l4 + np.where(tcp, doff // 16 * 4, UDP_HEADER)
    has_start = (tcp & has_doff) | udp
    trailing = np.maximum(size - start, 0)
    payload_len = np.maximum(np.minimum(l3 + ip_len - start, trailing), 0)

    either = tcp | udp
    columns = [
        (eth_type, has_type), (l3 + 1, None), (version, has_ip), (fragment // 8192, v4 & has_fragment), (proto, has_proto),
        (ip_len, has_len), (l4 + 1, has_ip), (sport, either & has_sport), (dport, either & has_dport), (tcp_flags, tcp & has_flags),
        (start + 1, has_start), (payload_len, has_start & has_len), (trailing, has_start),
    ]
    arrays = [pa.array(v.astype(np.int32), mask=None if ok is None else ~ok) for v, ok in columns]
    return pa.StructArray.from_arrays(arrays, FIELDS)


def header_fields(packet: Column, link_type: Column) -> Column:
    """A struct of ``FIELDS``; offsets are 1-based.

    Only the first bytes of a packet go to Python, its payload stays in the JVM. The function is
    declared non-deterministic so that the optimiser does not evaluate it once per use.
    """
    read = F.arrow_udf(_fields, ", ".join(f"{name} int" for name in FIELDS)).asNondeterministic()
    return read(F.substring(packet, 1, HEAD_BYTES), link_type, F.octet_length(packet))
