"""Ed25519 signatures (RFC 8032) in Python and NumPy, so that executors sign and verify without a library.

`sign` and `verify` take one message. Columns are signed and verified a block at a time: the multiples
of the base point and of the key come from tables, and the additions of a block are array operations.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The curve's field, group order and base point, and the head of a public key in its standard container.
FIELD = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, FIELD - 2, FIELD) % FIELD
ROOT = pow(2, (FIELD - 1) // 4, FIELD)
CONTAINER = bytes.fromhex("302a300506032b6570032100")


def _x(y: int, sign: int) -> int | None:
    """The coordinate that belongs to y, with this last bit; None if y is on no point."""
    xx = (y * y - 1) * pow(D * y * y + 1, FIELD - 2, FIELD) % FIELD
    x = pow(xx, (FIELD + 3) // 8, FIELD)
    if (x * x - xx) % FIELD:
        x = x * ROOT % FIELD
    if (x * x - xx) % FIELD or (x == 0 and sign):
        return None
    return x if x % 2 == sign else FIELD - x


def _add(p: tuple, q: tuple) -> tuple:
    """Sum of two points in extended coordinates."""
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % FIELD, (p[1] + p[0]) * (q[1] + q[0]) % FIELD
    c, d = 2 * p[3] * q[3] * D % FIELD, 2 * p[2] * q[2] % FIELD
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % FIELD, g * h % FIELD, f * g % FIELD, e * h % FIELD


@functools.cache
def _powers() -> list[tuple]:
    """The base point doubled 0 to 255 times."""
    y = 4 * pow(5, FIELD - 2, FIELD) % FIELD
    x = _x(y, 0)
    out = [(x, y, 1, x * y % FIELD)]
    for _ in range(255):
        out.append(_add(out[-1], out[-1]))
    return out


def _times(k: int, p: tuple | None = None) -> tuple:
    """k times a point, or the base point."""
    out, i = (0, 1, 1, 0), 0
    while k:
        if k & 1:
            out = _add(out, p if p is not None else _powers()[i])
        k, i = k >> 1, i + 1
        if p is not None:
            p = _add(p, p)
    return out


def _pack(p: tuple) -> bytes:
    z = pow(p[2], FIELD - 2, FIELD)
    return (p[1] * z % FIELD | (p[0] * z % FIELD & 1) << 255).to_bytes(32, "little")


def _unpack(b: bytes) -> tuple | None:
    y = int.from_bytes(b, "little")
    sign, y = y >> 255, y & ((1 << 255) - 1)
    x = _x(y, sign) if y < FIELD else None
    return None if x is None else (x, y, 1, x * y % FIELD)


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % ORDER


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    return int.from_bytes(h[:32], "little") & ((1 << 254) - 8) | 1 << 254, h[32:]


def public_key(seed: bytes) -> bytes:
    """Public key of a 32-byte seed."""
    return _pack(_times(_secret(seed)[0]))


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _secret(seed)
    key = _pack(_times(a))
    r = _number(prefix, message)
    point = _pack(_times(r))
    return point + ((r + _number(point, key, message) * a) % ORDER).to_bytes(32, "little")


def verify(key: bytes, message: bytes, signature: bytes) -> bool:
    """Whether the signature is the key's over the message; anything malformed isn't."""
    if len(key) != 32 or len(signature) != 64:
        return False
    a, r, s = _unpack(key), _unpack(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= ORDER:
        return False
    left, right = _times(s), _add(r, _times(_number(signature[:32], key, message), a))
    return (left[0] * right[2] - right[0] * left[2]) % FIELD == 0 and (left[1] * right[2] - right[1] * left[2]) % FIELD == 0


# Blocks: a field element is LIMBS signed numbers of about BITS bits, an axis each; 2^(LIMBS * BITS) is FOLD in the field.
LIMBS, BITS, FOLD, BLOCK = 10, 26, 19 << 5, 256
# A scalar is DIGITS digits of WINDOW bits.
WINDOW, DIGITS = 11, 23


def _limbs(values: list[int]) -> np.ndarray:
    """(LIMBS, n) of field elements."""
    raw = np.frombuffer(b"".join(v.to_bytes(40, "little") for v in values), np.uint8).reshape(-1, 40)
    bits = np.unpackbits(raw, axis=1, bitorder="little")[:, : LIMBS * BITS].reshape(-1, LIMBS, BITS)
    return (bits @ (1 << np.arange(BITS, dtype=np.int64))).T


def _ints(limbs: np.ndarray) -> list[int]:
    """The numbers of (LIMBS, n), not reduced."""
    return [a + (b << 52) + (c << 104) + (d << 156) + (e << 208) for a, b, c, d, e in (limbs[::2] + (limbs[1::2] << BITS)).T.tolist()]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products in the field. Limbs below 2^29 in size give sums below 2^62, and limbs below 2^27.2 again."""
    acc, part = np.zeros((2 * LIMBS, *b.shape[1:]), np.int64), np.empty(b.shape, np.int64)
    for i in range(LIMBS):
        np.multiply(b, a[i], out=part)
        acc[i : i + LIMBS] += part
    carry = acc >> BITS
    acc &= (1 << BITS) - 1
    acc[1:] += carry[:-1]
    out = acc[:LIMBS]
    acc[LIMBS:] *= FOLD
    out += acc[LIMBS:]
    carry = out >> BITS
    out &= (1 << BITS) - 1
    out[1:] += carry[:-1]
    out[0] += carry[-1] * FOLD
    return out


def _plus(p: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Points (LIMBS, 4, n), extended, plus table entries (LIMBS, 3, n): y - x, y + x and 2dxy of affine points."""
    x, y, z, t = (p[:, i] for i in range(4))
    m = _product(np.stack([y - x, y + x, t], 1), entry)
    a, b, c, d = m[:, 0], m[:, 1], m[:, 2], 2 * z
    e, f, g, h = b - a, d - c, d + c, b + a
    return _product(np.stack([e, g, f, e], 1), np.stack([f, h, g, h], 1))


def _zero(n: int) -> np.ndarray:
    p = np.zeros((LIMBS, 4, n), np.int64)
    p[0, 1:3] = 1
    return p


def _affine(x: list[int], y: list[int], z: list[int]) -> list[tuple[int, int]]:
    """Points without their denominators, by one inversion for all."""
    before, run = [], 1
    for v in z:
        before.append(run)
        run = run * v % FIELD
    run, out = pow(run, FIELD - 2, FIELD), []
    for i in range(len(z) - 1, -1, -1):
        inv = run * before[i] % FIELD
        run = run * z[i] % FIELD
        out.append((x[i] * inv % FIELD, y[i] * inv % FIELD))
    return out[::-1]


def _entries(points: list[tuple[int, int]]) -> np.ndarray:
    """(LIMBS, 3, n) of affine points."""
    return np.stack([_limbs([(y - x) % FIELD for x, y in points]), _limbs([(y + x) % FIELD for x, y in points]), _limbs([2 * D * x * y % FIELD for x, y in points])], 1)


@functools.lru_cache(4)
def _table(x: int, y: int) -> np.ndarray:
    """(DIGITS, 2^WINDOW, 3 * LIMBS): the entry of every value of every digit, for multiples of an affine point."""
    doubled = [(x, y, 1, x * y % FIELD)]
    for _ in range(DIGITS * WINDOW - 1):
        doubled.append(_add(doubled[-1], doubled[-1]))
    steps = _entries(_affine(*([p[i] for p in doubled] for i in range(3)))).reshape(LIMBS, 3, DIGITS, WINDOW)
    p = _zero(DIGITS).reshape(LIMBS, 4, DIGITS, 1)
    for w in range(WINDOW):
        m = p.shape[3]
        step = np.repeat(steps[..., w], m, axis=2)
        more = _plus(p.reshape(LIMBS, 4, -1), step).reshape(LIMBS, 4, DIGITS, m)
        p = np.concatenate([p, more], axis=3)
    flat = p.reshape(LIMBS, 4, -1)
    e = _entries(_affine(*(_ints(flat[:, i]) for i in range(3))))
    return np.ascontiguousarray(e.reshape(3 * LIMBS, -1).T.reshape(DIGITS, 1 << WINDOW, 3 * LIMBS).astype(np.int32))


def _packed(*terms: tuple[list[int], tuple[int, int]]) -> list[bytes]:
    """The packed sums of multiples of points; a term is a number for each row, below 2^253, and an affine point."""
    out, n = [], len(terms[0][0])
    tables = [_table(*point) for _, point in terms]
    for at in range(0, n, BLOCK):
        p = _zero(min(BLOCK, n - at))
        for (numbers, _), table in zip(terms, tables, strict=True):
            raw = np.frombuffer(b"".join(k.to_bytes(32, "little") for k in numbers[at : at + BLOCK]), np.uint8).reshape(-1, 32)
            digits = np.unpackbits(raw, axis=1, bitorder="little")[:, : DIGITS * WINDOW].reshape(-1, DIGITS, WINDOW) @ (1 << np.arange(WINDOW, dtype=np.int64))
            for i in range(DIGITS):
                p = _plus(p, np.ascontiguousarray(table[i].take(digits[:, i], axis=0).T, np.int64).reshape(LIMBS, 3, -1))
        out += [(y | (x & 1) << 255).to_bytes(32, "little") for x, y in _affine(*(_ints(p[:, i]) for i in range(3)))]
    return out


def sign_all(seed: bytes, messages: list[bytes]) -> list[bytes]:
    """`sign` of every message."""
    a, prefix = _secret(seed)
    key, base = public_key(seed), _powers()[0][:2]
    r = [_number(prefix, m) for m in messages]
    return [p + ((k + _number(p, key, m) * a) % ORDER).to_bytes(32, "little") for p, k, m in zip(_packed((r, base)), r, messages, strict=True)] if r else []


def verify_all(key: bytes, messages: list[bytes], signatures: list[bytes]) -> list[bool]:
    """`verify` of every message and signature.

    A point has one packed form, so the first half of a signature is compared with that of the point it has to be.
    """
    a = _unpack(key) if len(key) == 32 else None
    s = [int.from_bytes(x[32:], "little") for x in signatures]
    rows = [i for i, x in enumerate(signatures) if a is not None and len(x) == 64 and s[i] < ORDER]
    out = [False] * len(signatures)
    if rows:
        h = [_number(signatures[i][:32], key, messages[i]) for i in rows]
        for i, p in zip(rows, _packed(([s[i] for i in rows], _powers()[0][:2]), (h, (FIELD - a[0], a[1]))), strict=True):
            out[i] = p == signatures[i][:32]
    return out


def key_id(key: bytes) -> str:
    """First 16 hex digits of the hash of the public key in its standard container."""
    return hashlib.sha256(CONTAINER + key).hexdigest()[:16]


def signature_column(seed: bytes, message: Column) -> Column:
    """Base64 signatures of a text column; NULL stays NULL."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            rows = s[s.notna()]
            signed = [base64.b64encode(x).decode() for x in sign_all(seed, [m.encode() for m in rows])]
            yield pd.Series(signed, rows.index, dtype=object).reindex(s.index, fill_value=None)

    return run(message)


def verified_column(key: bytes, message: Column, signature: Column) -> Column:
    """Whether base64 signatures belong to a text column; NULL or unreadable ones don't."""

    def raw(s: str) -> bytes:
        try:
            return base64.b64decode(s, validate=True)
        except ValueError:
            return b""

    @F.pandas_udf("boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for m, s in batches:
            rows = m.notna() & s.notna()
            out = rows.to_numpy(bool, copy=True)
            out[out] = verify_all(key, [x.encode() for x in m[rows]], [raw(x) for x in s[rows]])
            yield pd.Series(out)

    return run(message, signature)
