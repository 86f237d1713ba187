"""What a decoded candidate is: private keys by their nested lengths, signed tokens by their headers."""

from __future__ import annotations

import base64
import binascii
import json

INTEGER, BIT_STRING, OCTET_STRING, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30
#: Encoded object identifiers.
RSA, EC, DSA = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201"), bytes.fromhex("2a8648ce380401")
EDWARDS = {bytes.fromhex("2b656e"): "x25519", bytes.fromhex("2b656f"): "x448", bytes.fromhex("2b6570"): "ed25519", bytes.fromhex("2b6571"): "ed448"}
ENCRYPTION = bytes.fromhex("2a864886f70d0105")
OPENSSH = b"openssh-key-v1\0"


def decoded(text: str, altchars: bytes | None = None) -> bytes | None:
    """Base64 with or without padding, else None."""
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars, validate=True)
    except (binascii.Error, ValueError):
        return None


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start and end of the content) of the element at a place, if its length is written the shortest way and fits."""
    if at + 2 > end:
        return None
    tag, size, start = data[at], data[at + 1], at + 2
    if tag & 0x1F == 0x1F or size == 0x80:
        return None
    if size > 0x80:
        n = size - 0x80
        if n > 4 or start + n > end or data[start] == 0:
            return None
        size, start = int.from_bytes(data[start : start + n], "big"), start + n
        if size < 0x80:
            return None
    return (tag, start, start + size) if start + size <= end else None


def children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill a content to its last byte, else None."""
    found = []
    while start < end:
        e = element(data, start, end)
        if e is None:
            return None
        found.append(e)
        start = e[2]
    return found


def small(data: bytes, e: tuple[int, int, int]) -> int | None:
    """The value of an integer of one byte."""
    return data[e[1]] if e[0] == INTEGER and e[2] - e[1] == 1 else None


def key_sequence(data: bytes, start: int, end: int) -> str | None:
    """What kind of private key a sequence's content is."""
    parts = children(data, start, end)
    if not parts or len(parts) < 2:
        return None
    tags = [e[0] for e in parts]
    version = small(data, parts[0])
    if version == 0 and tags == [INTEGER] * 9 or version == 1 and tags == [INTEGER] * 9 + [SEQUENCE]:
        return f"rsa-{8 * (parts[1][2] - parts[1][1]) // 64 * 64}"
    if version == 0 and tags == [INTEGER] * 6:
        return "dsa"
    if version == 1 and tags[1] == OCTET_STRING and tags[2:] in ([], [0xA0], [0xA1], [0xA0, 0xA1]) and parts[1][2] - parts[1][1] >= 16:
        return "ec"
    if version in (0, 1) and tags[1:3] == [SEQUENCE, OCTET_STRING] and all(t & 0xC0 == 0x80 for t in tags[3:]):
        return wrapped(data, parts[1], parts[2])
    if tags == [SEQUENCE, OCTET_STRING]:
        inner = children(data, *parts[0][1:])
        if inner and inner[0][0] == OID and data[inner[0][1] : inner[0][2]].startswith(ENCRYPTION) and len(inner) == 2 and inner[1][0] == SEQUENCE and children(data, *inner[1][1:]):
            return "encrypted"
    return None


def wrapped(data: bytes, algorithm: tuple[int, int, int], key: tuple[int, int, int]) -> str | None:
    """A key inside its container must itself be what the container's identifier says."""
    name = children(data, *algorithm[1:])
    if not name or name[0][0] != OID:
        return None
    oid, inside = data[name[0][1] : name[0][2]], element(data, *key[1:])
    if inside is None or inside[2] != key[2]:
        return None
    if oid in (RSA, EC):
        kind = key_sequence(data, *inside[1:]) if inside[0] == SEQUENCE else None
        return kind if kind and kind.startswith("rsa" if oid == RSA else "ec") else None
    if oid == DSA:
        return "dsa" if inside[0] == INTEGER else None
    if oid in EDWARDS and inside[0] == OCTET_STRING and inside[2] - inside[1] in (32, 56, 57):
        return EDWARDS[oid]
    return None


def private_key(data: bytes) -> tuple[str, int] | None:
    """(kind, bytes that it takes) of the private key at the start of data, by nested lengths."""
    e = element(data, 0, len(data))
    kind = key_sequence(data, *e[1:]) if e and e[0] == SEQUENCE else None
    return (kind, e[2]) if kind else None


def openssh_key(data: bytes) -> tuple[str, int] | None:
    """(kind, bytes that it takes): cipher, derivation, its options, a number of public keys, and the private part, each behind its length."""
    if not data.startswith(OPENSSH):
        return None
    at = len(OPENSSH)

    def text() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    cipher, derivation, options = text(), text(), text()
    if not cipher or not derivation or options is None or (cipher == b"none") != (derivation == b"none"):
        return None
    n, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    # each key takes four bytes at least
    if not 1 <= n <= len(data) // 4:
        return None
    for _ in range(n):
        if not text():
            return None
    private = text()
    if not private or cipher == b"none" and (private[:4] != private[4:8] or len(private) % 8):
        return None
    return "openssh" if cipher == b"none" else "openssh-encrypted", at


def signed_token(text: str) -> str | None:
    """The algorithm of three parts joined by dots, if header and claims are JSON objects and there is a signature."""
    head, claims, signature = (decoded(p, b"-_") for p in text.split("."))
    if not head or not claims or not signature:
        return None
    try:
        head, claims = json.loads(head), json.loads(claims)
    except (ValueError, RecursionError):
        return None
    if not isinstance(head, dict) or not isinstance(claims, dict):
        return None
    alg = head.get("alg")
    return alg if isinstance(alg, str) and alg and alg.lower() != "none" else None
