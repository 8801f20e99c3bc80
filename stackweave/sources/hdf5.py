"""Image stacks in HDF5 files of the classic layout: the node /images, and numbers beside it, without a library.

Files begin with a superblock of version 0 or 1; groups are symbol tables, objects have headers of version 1, chunks lie in
B-trees. Chunks may be shuffled and deflated. Only the headers and the index of chunks are read ahead; a frame
then reads the chunks that hold it.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the format: messages of object headers, filters.
SPACE, TYPE, LAYOUT, FILTERS, CONTINUED, SYMBOLS = 0x01, 0x03, 0x08, 0x0B, 0x10, 0x11
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3
SIGNATURE = b"\x89HDF\r\n\x1a\n"
NOWHERE = (1 << 64) - 1


def at(f, start: int, n: int) -> bytes:
    f.seek(start)
    raw = f.read(n)
    if len(raw) < n:
        raise ValueError(f"{n} bytes at {start} are beyond the file's end")
    return raw


def messages(f, base: int, header: int) -> list[tuple[int, bytes]]:
    """All messages of an object, continued blocks included."""
    first = at(f, base + header, 16)
    if first[0] != 1:
        raise ValueError("an object header of another version than 1")
    out, blocks, seen = [], [(base + header + 16, struct.unpack_from("<I", first, 8)[0])], set()
    while blocks:
        start, size = blocks.pop(0)
        if start in seen:
            raise ValueError("an object header that continues in itself")
        seen.add(start)
        raw, place = at(f, start, size), 0
        while place + 8 <= len(raw):
            kind, n = struct.unpack_from("<HH", raw, place)
            body = raw[place + 8 : place + 8 + n]
            place += 8 + n
            if kind == CONTINUED:
                offset, length = struct.unpack_from("<QQ", body)
                blocks.append((base + offset, length))
            else:
                out.append((kind, body))
    return out


def tree(f, base: int, node: int, kind: int, key: int) -> list[tuple[bytes, int]]:
    """Keys and places of all leaves below a B-tree's node, in order."""
    head = at(f, base + node, 24)
    if head[:4] != b"TREE" or head[4] != kind:
        raise ValueError("no B-tree where one is named")
    level, used = head[5], struct.unpack_from("<H", head, 6)[0]
    raw = at(f, base + node + 24, used * (key + 8) + key)
    entries = [(raw[k * (key + 8) : k * (key + 8) + key], struct.unpack_from("<Q", raw, k * (key + 8) + key)[0]) for k in range(used)]
    return entries if level == 0 else [leaf for _, child in entries for leaf in tree(f, base, child, kind, key)]


def members(f, base: int, group: int) -> dict[str, int]:
    """The object headers of a group's members by name."""
    table = next((body for kind, body in messages(f, base, group) if kind == SYMBOLS), None)
    if table is None:
        raise ValueError("a group without a symbol table")
    root, heap = struct.unpack_from("<QQ", table)
    size, _, names_at = struct.unpack_from("<QQQ", at(f, base + heap, 32), 8)
    names = at(f, base + names_at, size)
    out = {}
    for _, leaf in tree(f, base, root, 0, 8):
        n = struct.unpack_from("<H", at(f, base + leaf, 8), 6)[0]
        raw = at(f, base + leaf + 8, 40 * n)
        for k in range(n):
            name, header = struct.unpack_from("<QQ", raw, 40 * k)
            out[names[name : names.index(b"\0", name)].decode()] = header
    return out


@dataclass
class Array:
    shape: tuple[int, ...]
    dtype: np.dtype
    base: int
    contiguous: int | None = None
    held: bytes | None = None  # pixels within the header
    chunk: tuple[int, ...] = ()
    chunks: dict[tuple[int, ...], tuple[int, int, int]] = field(default_factory=dict)  # by corner: place, bytes, filters left out
    filters: list[int] = field(default_factory=list)
    slab: tuple[int, np.ndarray] | None = None  # the chunks of the last frame read

    def frame(self, f, k: int) -> np.ndarray:
        """The values at k of the first axis."""
        n = int(np.prod(self.shape[1:]))
        size = n * self.dtype.itemsize
        if self.held is not None:
            return np.frombuffer(self.held, self.dtype)[k * n : (k + 1) * n]
        if not self.chunk:
            if self.contiguous == NOWHERE:  # never written
                return np.zeros(n, self.dtype)
            return np.frombuffer(at(f, self.base + self.contiguous + k * size, size), self.dtype)
        first = k // self.chunk[0] * self.chunk[0]
        if self.slab is None or self.slab[0] != first:
            out = np.zeros((min(self.chunk[0], self.shape[0] - first), *self.shape[1:]), self.dtype)
            for corner in itertools.product(*(range(0, s, c) for s, c in zip(self.shape[1:], self.chunk[1:]))):
                if (first, *corner) in self.chunks:
                    block = self.decoded(f, *self.chunks[(first, *corner)])
                    place = tuple(slice(a, min(a + c, s)) for a, c, s in zip(corner, self.chunk[1:], self.shape[1:]))
                    out[(slice(None), *place)] = block[tuple(slice(0, n) for n in (len(out), *(p.stop - p.start for p in place)))]
            self.slab = (first, out)
        return self.slab[1][k - first].ravel()

    def decoded(self, f, place: int, n: int, left_out: int) -> np.ndarray:
        raw = at(f, self.base + place, n)
        for k, kind in reversed(list(enumerate(self.filters))):
            if left_out >> k & 1:
                continue
            if kind == DEFLATE:
                raw = zlib.decompress(raw)
            elif kind == SHUFFLE:
                raw = np.frombuffer(raw, np.uint8).reshape(self.dtype.itemsize, -1).T.tobytes()
            elif kind == CHECKSUM:
                raw = raw[:-4]
            else:
                raise ValueError(f"a filter of kind {kind}")
        return np.frombuffer(raw, self.dtype).reshape(self.chunk)


def array_of(f, base: int, header: int) -> Array:
    found = dict(messages(f, base, header))
    if not {SPACE, TYPE, LAYOUT} <= found.keys():
        raise ValueError("a node that is no array")
    space, kind, layout = found[SPACE], found[TYPE], found[LAYOUT]
    shape = struct.unpack_from(f"<{space[1]}Q", space, 8 if space[0] == 1 else 4)
    letter = {0: "i" if kind[1] & 8 else "u", 1: "f"}.get(kind[0] & 15)
    if letter is None:
        raise ValueError("values that are no numbers")
    out = Array(shape, np.dtype(f"{'>' if kind[1] & 1 else '<'}{letter}{struct.unpack_from('<I', kind, 4)[0]}"), base)
    if layout[0] != 3:
        raise ValueError("a layout of another version than 3")
    if layout[1] == 0:
        out.held = layout[4 : 4 + struct.unpack_from("<H", layout, 2)[0]]
    elif layout[1] == 1:
        out.contiguous = struct.unpack_from("<Q", layout, 2)[0]
    else:
        rank = layout[2] - 1
        root = struct.unpack_from("<Q", layout, 3)[0]
        out.chunk = struct.unpack_from(f"<{rank}I", layout, 11)
        for key, place in tree(f, base, root, 1, 8 + 8 * (rank + 1)) if root != NOWHERE else []:
            n, left_out = struct.unpack_from("<II", key)
            out.chunks[struct.unpack_from(f"<{rank}Q", key, 8)] = (place, n, left_out)
    if FILTERS in found:
        body = found[FILTERS]
        place = 8 if body[0] == 1 else 2
        for _ in range(body[1]):
            code = struct.unpack_from("<H", body, place)[0]
            named = body[0] == 1 or code >= 256
            length, _, values = struct.unpack_from("<HHH", body, place + 2) if named else (0, *struct.unpack_from("<HH", body, place + 2))
            place += (8 if named else 6) + length + 4 * values + (4 * (values % 2) if body[0] == 1 else 0)
            out.filters.append(code)
    return out


def nodes(f) -> tuple[int, dict[str, int]]:
    """Where addresses count from, and the members of the root."""
    head = at(f, 0, 32)
    if head[:8] != SIGNATURE or head[8] not in (0, 1) or head[13:15] != b"\x08\x08":
        raise ValueError("no HDF5 superblock of version 0 or 1 with 8-byte addresses")
    place = 24 + 4 * head[8]
    base = struct.unpack("<Q", at(f, place, 8))[0]
    return base, members(f, base, struct.unpack("<Q", at(f, place + 40, 8))[0])


def open_images(f) -> tuple[Array, dict[str, float | None]]:
    """The array /images, as a stack of frames, and the numbers beside it."""
    base, found = nodes(f)
    if "images" not in found:
        raise ValueError("no node /images")
    images = array_of(f, base, found["images"])
    if len(images.shape) == 2:
        images.shape = (1, *images.shape)
        images.chunk = (1, *images.chunk) if images.chunk else ()
        images.chunks = {(0, *k): v for k, v in images.chunks.items()}
    if len(images.shape) != 3:
        raise ValueError(f"/images has {len(images.shape)} axes")
    meta: dict[str, float | None] = {}
    for name, node in (("pixelsize", "pixelsize"), ("voltage", "voltage"), ("c3", "C3"), ("detector_pixel", "detectorPixelSize")):
        meta[name] = None
        if node in found:
            one = array_of(f, base, found[node])
            one.shape = one.shape or (1,)
            if all(one.shape):
                meta[name] = float(one.frame(f, 0)[0])
    return images, meta
