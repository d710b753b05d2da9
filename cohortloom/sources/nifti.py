"""NIfTI-1 files as bytes: header fields, orientation and voxels of one file (used inside tasks, one file at a time)."""

from __future__ import annotations

import gzip
import struct

import numpy as np

# Format constants of NIfTI-1.
HEADER_SIZE = 348
DATA_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
MAX_VOXELS = 1 << 27


def _affine(header: bytes, order: str, pixdim: tuple[float, ...]) -> np.ndarray:
    qform, sform = struct.unpack(order + "2h", header[252:256])
    if sform > 0:
        rows = np.array(struct.unpack(order + "12f", header[280:328])).reshape(3, 4)
        return np.vstack([rows, [0, 0, 0, 1]])
    if qform > 0:
        b, c, d, tx, ty, tz = struct.unpack(order + "6f", header[256:280])
        a = np.sqrt(max(0.0, 1.0 - b * b - c * c - d * d))
        rotation = np.array(
            [
                [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
                [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
                [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
            ]
        )
        hand = -1.0 if pixdim[0] < 0 else 1.0
        scaled = rotation * np.array([pixdim[1], pixdim[2], pixdim[3] * hand])
        return np.vstack([np.column_stack([scaled, [tx, ty, tz]]), [0, 0, 0, 1]])
    return np.diag([pixdim[1] or 1.0, pixdim[2] or 1.0, pixdim[3] or 1.0, 1.0])


def decode(content: bytes) -> tuple[np.ndarray, tuple[float, float, float], float]:
    """(volume in z, y, x order with axes toward left-to-right / posterior-to-anterior / inferior-to-superior, spacing in
    z, y, x order, determinant of the affine). Files that are not 3-D, unknown types and truncated data raise."""
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else bytes(content)
    if len(raw) < HEADER_SIZE:
        raise ValueError("file is shorter than a header")
    order = "<" if struct.unpack("<i", raw[:4])[0] == HEADER_SIZE else ">"
    if struct.unpack(order + "i", raw[:4])[0] != HEADER_SIZE:
        raise ValueError("not a NIfTI-1 header")
    dim = struct.unpack(order + "8h", raw[40:56])
    shape = dim[1 : dim[0] + 1]
    if len(shape) > 3 and all(n == 1 for n in shape[3:]):
        shape = shape[:3]
    if len(shape) != 3 or min(shape) < 1:
        raise ValueError(f"expected a 3-D volume, found shape {tuple(shape)}")
    if int(np.prod(shape, dtype=np.int64)) > MAX_VOXELS:
        raise ValueError("volume exceeds the supported grid")
    code = struct.unpack(order + "h", raw[70:72])[0]
    if code not in DATA_TYPES:
        raise ValueError(f"unsupported data type {code}")
    pixdim = struct.unpack(order + "8f", raw[76:108])
    offset, slope, inter = struct.unpack(order + "3f", raw[108:120])
    kind = np.dtype(order + DATA_TYPES[code])
    size = int(np.prod(shape)) * kind.itemsize
    start = int(offset) or 352
    if len(raw) < start + size:
        raise ValueError("voxel data is truncated")
    data = np.frombuffer(raw, kind, int(np.prod(shape)), start).reshape(shape, order="F").astype(np.float64)
    if slope not in (0.0,) and np.isfinite(slope):
        data = data * slope + inter
    affine = _affine(raw, order, pixdim)
    direction = affine[:3, :3]
    spacing = np.sqrt((direction**2).sum(axis=0))
    unit = np.abs(direction / np.maximum(spacing, 1e-12))
    axes, free = [], [0, 1, 2]
    for world in range(3):
        best = max(free, key=lambda a: unit[world, a])
        free.remove(best)
        axes.append(best)
    data = np.transpose(data, axes)
    for world, axis in enumerate(axes):
        if direction[world, axis] < 0:
            data = np.flip(data, world)
    spacing = [float(spacing[a]) for a in axes]
    return np.ascontiguousarray(np.transpose(data, (2, 1, 0))), (spacing[2], spacing[1], spacing[0]), float(np.linalg.det(direction))


def encode(volume: np.ndarray, spacing: tuple[float, float, float]) -> bytes:
    """A float32 NIfTI-1 file (uncompressed) of a z, y, x volume with a diagonal affine."""
    data = np.transpose(np.asarray(volume, dtype="<f4"), (2, 1, 0))
    sz, sy, sx = spacing
    header = bytearray(352)
    struct.pack_into("<i", header, 0, HEADER_SIZE)
    struct.pack_into("<8h", header, 40, 3, *data.shape, 1, 1, 1, 1)
    struct.pack_into("<2h", header, 70, 16, 32)
    struct.pack_into("<8f", header, 76, 1.0, sx, sy, sz, 0, 0, 0, 0)
    struct.pack_into("<3f", header, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<2h", header, 252, 0, 1)
    struct.pack_into("<12f", header, 280, sx, 0, 0, 0, 0, sy, 0, 0, 0, 0, sz, 0)
    header[344:348] = b"n+1\x00"
    return bytes(header) + data.tobytes(order="F")
