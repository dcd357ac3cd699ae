"""The ciphers of the PDF standard security handler, for files whose user password is empty."""

from __future__ import annotations

import hashlib

# Fixed value: what the standard pads passwords with.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for byte in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(byte ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


def _times(a: int, b: int) -> int:
    """Product in the field of 256 elements modulo x^8 + x^4 + x^3 + x + 1."""
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = a << 1 ^ (0x11B if a & 128 else 0)
        b >>= 1
    return out


def _boxes() -> tuple[bytes, bytes]:
    """The substitution (inverses in the field, then an affine map) and its inverse."""
    box = bytearray(256)
    for x in range(256):
        y = next((y for y in range(256) if _times(x, y) == 1), 0)
        box[x] = 0x63
        for k in range(5):
            box[x] ^= (y << k | y >> (8 - k)) & 255
    back = bytearray(256)
    for x, y in enumerate(box):
        back[y] = x
    return bytes(box), bytes(back)


_TABLES: list = []


def aes_cbc(key: bytes, data: bytes) -> bytes:
    """Deciphered data without its first block, the initial vector, and without padding."""
    if not _TABLES:
        _TABLES.extend([*_boxes(), [bytes(_times(x, k) for x in range(256)) for k in (14, 11, 13, 9)]])
    box, back, (t14, t11, t13, t9) = _TABLES
    n, rounds = len(key) // 4, len(key) // 4 + 6
    w, turn = [key[i : i + 4] for i in range(0, len(key), 4)], 1
    for i in range(n, 4 * (rounds + 1)):
        t = w[-1]
        if i % n == 0:
            t = bytes(box[b] for b in t[1:] + t[:1])
            t, turn = bytes([t[0] ^ turn]) + t[1:], _times(turn, 2)
        elif n > 6 and i % n == 4:
            t = bytes(box[b] for b in t)
        w.append(bytes(a ^ b for a, b in zip(w[i - n], t, strict=True)))
    keys = [b"".join(w[4 * r : 4 * r + 4]) for r in range(rounds + 1)]
    order = [(i - 4 * (i % 4)) % 16 for i in range(16)]  # rows shifted back
    out = bytearray()
    for at in range(16, len(data) - 15, 16):
        state = bytes(a ^ b for a, b in zip(data[at : at + 16], keys[-1], strict=True))
        for r in range(rounds - 1, -1, -1):
            state = bytes(back[state[order[i]]] ^ keys[r][i] for i in range(16))
            if r:
                state = bytes(
                    t14[state[c + k]] ^ t11[state[c + (k + 1) % 4]] ^ t13[state[c + (k + 2) % 4]] ^ t9[state[c + (k + 3) % 4]] for c in range(0, 16, 4) for k in range(4)
                )
        out += bytes(a ^ b for a, b in zip(state, data[at - 16 : at], strict=True))
    return bytes(out[: -out[-1]]) if out and 0 < out[-1] <= 16 else bytes(out)


def file_key(owner: bytes, user: bytes, permissions: int, first_id: bytes, revision: int, size: int, metadata: bool) -> bytes | None:
    """The key of a file whose user password is empty, or None where it isn't."""
    key = hashlib.md5(PAD + owner[:32] + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + first_id + (b"" if metadata or revision < 4 else b"\xff" * 4)).digest()[:size]
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key).digest()[:size]
    if revision < 3:
        return key if rc4(key, PAD) == user[:32] else None
    check = rc4(key, hashlib.md5(PAD + first_id).digest())
    for i in range(1, 20):
        check = rc4(bytes(b ^ i for b in key), check)
    return key if check == user[:16] else None


def object_key(key: bytes, number: int, generation: int, aes: bool) -> bytes:
    return hashlib.md5(key + number.to_bytes(3, "little") + generation.to_bytes(2, "little") + b"sAlT" * aes).digest()[: min(len(key) + 5, 16)]
