"""Base58 and little-endian byte codecs as Arrow-batched functions."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the base58 alphabet.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_DIGIT = {ch: i for i, ch in enumerate(BASE58)}


def from_base58(text, limit: int = 16384):
    """Bytes of a base58 text, or None when it is empty, too long or has a foreign letter."""
    if not isinstance(text, str) or not 0 < len(text) <= limit:
        return None
    number = 0
    for ch in text:
        digit = _DIGIT.get(ch)
        if digit is None:
            return None
        number = number * 58 + digit
    zeros = len(text) - len(text.lstrip("1"))
    return bytes(zeros) + number.to_bytes((number.bit_length() + 7) // 8, "big")


@lru_cache(1 << 16)
def to_base58(raw: bytes) -> str:
    number = int.from_bytes(raw, "big")
    letters = []
    while number:
        number, digit = divmod(number, 58)
        letters.append(BASE58[digit])
    zeros = len(raw) - len(raw.lstrip(b"\0"))
    return "1" * zeros + "".join(reversed(letters))


_LUT = np.full(256, 255, dtype=np.uint8)
_LUT[[ord(ch) for ch in BASE58]] = np.arange(58, dtype=np.uint8)
_LETTERS = np.frombuffer(BASE58.encode(), dtype=np.uint8)
_STEP, _BIG = 5, np.uint64(58**5)
_MASK, _SHIFT = np.uint64(0xFFFFFFFF), np.uint64(32)
#: Texts worked on together, so that their limbs stay in the cache.
_CHUNK = 4096


def _decode_group(group: list, width: int) -> list:
    """Bytes of texts of at most ``width`` letters, a multiple of five; limbs and digits are kept row by row, least limb first."""
    block = np.frombuffer("".join([t.rjust(width, "1") for t in group]).encode("latin-1", "replace"), dtype=np.uint8)
    d = _LUT[block.reshape(len(group), width)]
    good = (d != 255).all(axis=1).tolist()
    d = np.ascontiguousarray(d.T).astype(np.uint32)
    limbs = np.zeros(((width * 6 + 31) // 32 + 1, len(group)), dtype=np.uint64)
    for n, at in enumerate(range(0, width, _STEP)):
        five = d[at]
        for k in range(1, _STEP):
            five = five * np.uint32(58) + d[at + k]
        carry = five.astype(np.uint64)
        # what is filled so far has at most 30 bits a step
        for k in range(min(len(limbs), (n * 30) // 32 + 1)):
            t = limbs[k] * _BIG + carry
            limbs[k], carry = t & _MASK, t >> _SHIFT
        if (n * 30) // 32 + 1 < len(limbs):
            limbs[(n * 30) // 32 + 1] = carry
    raw = np.ascontiguousarray(limbs[::-1].T).astype(">u4").tobytes()
    size = len(limbs) * 4
    return [bytes(len(t) - len(t.lstrip("1"))) + raw[n * size:(n + 1) * size].lstrip(b"\0") if good[n] else None for n, t in enumerate(group)]


#: Digits of a piece of a long text, whose number has at most 59 bits.
_PIECE = 10


@lru_cache
def _bases(steps: int) -> list[int]:
    """58 to the powers of 10, 20, 40, ..."""
    return [58 ** (_PIECE << k) for k in range(steps)]


def _decode_long(group: list, pieces: int) -> list:
    """Bytes of texts of at most ``pieces`` times ten letters: the numbers of pieces are made together, and joined by pairs."""
    width = pieces * _PIECE
    block = np.frombuffer("".join([t.rjust(width, "1") for t in group]).encode("latin-1", "replace"), dtype=np.uint8)
    d = _LUT[block.reshape(len(group), pieces, _PIECE)]
    good = (d != 255).all(axis=(1, 2)).tolist()
    numbers = np.zeros((len(group), pieces), dtype=np.uint64)
    for k in range(_PIECE):
        numbers = numbers * np.uint64(58) + d[:, :, k]
    out = []
    for t, ok, some in zip(group, good, numbers.tolist()):
        if not ok:
            out.append(None)
            continue
        for base in _bases(pieces.bit_length()):
            if len(some) == 1:
                break
            if len(some) % 2:
                some = [0, *some]
            some = [a * base + b for a, b in zip(some[::2], some[1::2])]
        out.append(bytes(len(t) - len(t.lstrip("1"))) + some[0].to_bytes((some[0].bit_length() + 7) // 8, "big"))
    return out


def _encode_long(group: list, size: int) -> list:
    """Base58 texts of byte strings of one size: each number is halved down to pieces, whose digits are made together."""
    steps = (-(-(size * 138 // 100 + 1) // _PIECE) - 1).bit_length()
    numbers = []
    for raw in group:
        some = [int.from_bytes(raw, "big")]
        for base in reversed(_bases(steps)):
            some = [x for v in some for x in divmod(v, base)]
        numbers.append(some)
    rest = np.array(numbers, dtype=np.uint64)
    digits = np.empty((*rest.shape, _PIECE), dtype=np.uint8)
    for k in range(_PIECE - 1, -1, -1):
        less = rest // np.uint64(58)
        digits[:, :, k] = rest - less * np.uint64(58)
        rest = less
    text = _LETTERS[digits].tobytes().decode()
    width = digits.shape[1] * _PIECE
    return ["1" * (size - len(r.lstrip(b"\0"))) + text[n * width:(n + 1) * width].lstrip("1") for n, r in enumerate(group)]


def decode_batch(texts) -> list:
    """Bytes of many base58 texts. Texts of up to 95 letters are worked on together, five digits a
    step over 32-bit limbs, longer ones by pieces of ten digits; each distinct text is decoded once."""
    found: dict = {}
    short, long = set(), {}
    for t in texts:
        if isinstance(t, str) and 0 < len(t) <= 16384:
            if len(t) <= 95:
                short.add(t)
            else:
                long.setdefault(-(-len(t) // _PIECE), set()).add(t)
    for pieces, group in long.items():
        group = list(group)
        most = max(1, _CHUNK * 10 // pieces)
        for at in range(0, len(group), most):
            some = group[at:at + most]
            found.update(zip(some, _decode_long(some, pieces)))
    for lo, width in ((0, 20), (20, 45), (45, 95)):
        group = [t for t in short if lo < len(t) <= width]
        for at in range(0, len(group), _CHUNK):
            some = group[at:at + _CHUNK]
            found.update(zip(some, _decode_group(some, width)))
    return [found[t] if isinstance(t, str) and t in found else from_base58(t) for t in texts]


def _encode_group(group: list, size: int) -> list:
    """Base58 texts of byte strings of one size; limbs are kept row by row, largest first."""
    words = (size + 3) // 4
    limbs = np.frombuffer(b"".join([r.rjust(words * 4, b"\0") for r in group]), dtype=">u4").reshape(len(group), words)
    limbs = np.ascontiguousarray(limbs.T).astype(np.uint64)
    steps = (size * 138 // 100 + 1 + _STEP - 1) // _STEP
    out = np.empty((steps * _STEP, len(group)), dtype=np.uint8)
    first = 0
    for step in range(steps - 1, -1, -1):
        rest = np.zeros(len(group), dtype=np.uint64)
        for k in range(first, words):
            t = (rest << _SHIFT) | limbs[k]
            limbs[k] = t // _BIG
            rest = t - limbs[k] * _BIG
        # a step takes more than 29 bits off the number
        first = min(words, ((steps - step) * 29) // 32)
        rest = rest.astype(np.uint32)
        for place in range(_STEP - 1, -1, -1):
            less = rest // np.uint32(58)
            out[step * _STEP + place] = rest - less * np.uint32(58)
            rest = less
    text = _LETTERS[np.ascontiguousarray(out.T)].tobytes().decode()
    width = steps * _STEP
    return ["1" * (size - len(r.lstrip(b"\0"))) + text[n * width:(n + 1) * width].lstrip("1") for n, r in enumerate(group)]


def encode_batch(raws) -> list:
    """Base58 texts of many byte strings; those of one length are worked on together."""
    found: dict = {}
    sizes: dict = {}
    for r in raws:
        if r is not None and 0 < len(r) <= 4096:
            sizes.setdefault(len(r), set()).add(bytes(r))
    for size, group in sizes.items():
        group = list(group)
        work, most = (_encode_group, _CHUNK) if size <= 64 else (_encode_long, max(1, _CHUNK * 64 // size))
        for at in range(0, len(group), most):
            some = group[at:at + most]
            found.update(zip(some, work(some, size)))
    return [None if r is None else found[bytes(r)] if bytes(r) in found else to_base58(bytes(r)) for r in raws]


@F.pandas_udf(T.StringType())
def base58_encode(raw: pd.Series) -> pd.Series:
    return pd.Series(encode_batch(list(raw)), dtype=object)


@F.pandas_udf(T.BooleanType())
def valid_key(text: pd.Series) -> pd.Series:
    """True for a base58 text of exactly 32 bytes."""
    return pd.Series([raw is not None and len(raw) == 32 for raw in decode_batch(list(text))])


@F.pandas_udf(T.StringType())
def le_unsigned(raw: pd.Series) -> pd.Series:
    """Little-endian unsigned integer of any width as text."""
    return raw.map(lambda b: None if b is None else str(int.from_bytes(bytes(b), "little")))


def _size_table(most: int = 256) -> tuple[list[int], list[str]]:
    """For texts of 0, 1, ... letters that do not begin with a zero: bytes of the smallest, and the first text that needs one byte more.

    The letters are in the order of their codes, so texts of one length compare as their numbers do.
    """
    sizes, tops = [0], ["~"]
    for letters in range(1, most + 1):
        size = ((58 ** (letters - 1)).bit_length() + 7) // 8
        top = to_base58((1 << 8 * size).to_bytes(size + 1, "big"))
        sizes.append(size)
        tops.append(top if len(top) == letters else "~")
    return sizes, tops


_SIZES = _size_table()


def base58_length(text: str | Column) -> Column:
    """Number of bytes of a base58 text of at most 256 letters, null when it is not one; in columns, the text is not decoded."""
    t = F.col(text) if isinstance(text, str) else text
    body = F.ltrim(t, F.lit("1"))
    letters = F.length(body)
    sizes, tops = _SIZES
    size = F.length(t) - letters + F.get(F.lit(sizes), letters) + (body >= F.get(F.lit(tops), letters)).cast("int")
    return F.when(F.rlike(t, F.lit(rf"\A[{BASE58}]{{1,256}}\z")), size)


def keys_valid(keys: str | Column) -> Column:
    """True when every text of the list is a 32-byte base58 key."""
    return F.coalesce(F.forall(F.col(keys) if isinstance(keys, str) else keys, lambda k: base58_length(k).eqNullSafe(32)), F.lit(False))


def as_lists(like: pa.Array, values: pa.Array) -> pa.Array:
    """The values as lists of the lengths of another list array; its nulls are nulls."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(like), 0).to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values, mask=like.is_null())


def each_distinct(lists: pa.Array, work, kind: pa.DataType) -> pa.Array:
    """The lists with every value replaced by what ``work`` makes of it; it gets the distinct values of the batch."""
    flat = lists.flatten().dictionary_encode()
    return as_lists(lists, pa.array(work(flat.dictionary.to_pylist()), kind).take(flat.indices))


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def base58_decode_all(texts: pa.Array) -> pa.Array:
    return each_distinct(texts, decode_batch, pa.binary())


@F.arrow_udf(T.BinaryType())
def base58_decode(text: pa.Array) -> pa.Array:
    flat = text.dictionary_encode()
    return pa.array(decode_batch(flat.dictionary.to_pylist()), pa.binary()).take(flat.indices)


def le_u64(raw, pos: int):
    """Unsigned little-endian 64-bit integer at a 1-based byte position, inside the JVM."""
    pairs = F.regexp_extract_all(F.hex(F.substring(raw, pos, 8)), F.lit("(..)"), 1)
    return F.conv(F.array_join(F.reverse(pairs), ""), 16, 10).cast("decimal(20,0)")
