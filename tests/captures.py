"""A small writer of packets and capture files for the tests."""

from __future__ import annotations

import os
import struct

ETHER = bytes.fromhex("aabbccddee01aabbccddee02")
SRC, DST = bytes([10, 1, 2, 3]), bytes([192, 168, 7, 9])


def tcp(flags: int, body: bytes = b"", sport: int = 40000, dport: int = 443) -> bytes:
    return struct.pack(">HHIIBBHHH", sport, dport, 7, 0, 0x50, flags, 65535, 0xDEAD, 0) + body


def udp(body: bytes = b"", sport: int = 40000, dport: int = 4500) -> bytes:
    return struct.pack(">HHHH", sport, dport, 8 + len(body), 0xCAFE) + body


def ipv4(inner: bytes, proto: int, df: bool = False, src: bytes = SRC, dst: bytes = DST, options: bytes = b"") -> bytes:
    head = 0x45 + len(options) // 4
    size = 20 + len(options) + len(inner)
    return struct.pack(">BBHHHBBH", head, 0, size, 1, 0x4000 if df else 0, 64, proto, 0xBEEF) + src + dst + options + inner


def ipv6(inner: bytes, proto: int) -> bytes:
    return struct.pack(">IHBB", 0x60000000, len(inner), proto, 64) + bytes(range(16)) + bytes(range(16, 32)) + inner


def ether(inner: bytes, kind: int = 0x0800, vlan: int | None = None) -> bytes:
    tag = b"" if vlan is None else struct.pack(">HH", 0x8100, vlan)
    return ETHER + tag + struct.pack(">H", kind) + inner


def capture(packets: list[bytes], order: str = "<", nano: bool = False, link: int = 1, cut: int = 0) -> bytes:
    """``cut`` bytes are missing from the end of the last record."""
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    data = bytearray(struct.pack(order + "IHHIIII", magic, 2, 4, 0, 0, 262144, link))
    for i, p in enumerate(packets):
        part = (i + 5) * (1000 if nano else 1)
        data += struct.pack(order + "IIII", 1700000000 + i, part, len(p), len(p)) + p
    return bytes(data[: len(data) - cut])


PAYLOAD = bytes(range(256)) + bytes(44)

# name, packet, kept by TCP flags, kept by IP flags
SHAPES = [
    ("tcp payload", ether(ipv4(tcp(0x10, PAYLOAD), 6)), True, True),
    ("syn, DF", ether(ipv4(tcp(0x02), 6, df=True)), False, False),
    ("ack, no DF", ether(ipv4(tcp(0x10), 6)), False, True),
    ("psh only", ether(ipv4(tcp(0x08), 6)), True, True),
    ("ack, padding", ether(ipv4(tcp(0x10), 6, df=True) + bytes(6)), False, False),
    ("long udp", ether(ipv4(udp(bytes(1372)), 17)), True, True),
    ("empty udp", ether(ipv4(udp(), 17)), False, False),
    ("name service", ether(ipv4(udp(b"query", dport=53), 17)), False, False),
    ("arp", ether(bytes(28), 0x0806), False, False),
    ("ipv6 tcp", ether(ipv6(tcp(0x18, b"six"), 6), 0x86DD), True, True),
    ("tagged tcp", ether(ipv4(tcp(0x18, b"tagged"), 6), vlan=5), True, True),
    ("ip options", ether(ipv4(tcp(0x18, b"options"), 6, options=bytes(8))), True, True),
    ("icmp", ether(ipv4(b"\x08\x00ping", 1)), True, True),
    ("runt", ETHER[:9], True, True),
]


def write(root: str, name: str, data: bytes) -> str:
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return path
