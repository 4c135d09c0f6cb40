"""Indices within blocks: surface cells, staggered faces and edges, borders, corner regions, small reductions.

Formulas over columns or SQL (see ``algebra``); block sizes and dimensions are plain numbers.
"""

from __future__ import annotations

from math import prod

from . import keys as K
from .algebra import div, where


def _any(conditions):
    out = None
    for c in conditions:
        out = c if out is None else out | c
    return out


def _all(conditions):
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def cells_on_face(block, d: int) -> int:
    """Cells of a block that touch one of its two faces along axis d."""
    return prod(n for k, n in enumerate(block) if k != d)


def surface_cells(block) -> int:
    """Flat places on a block's surface: a cell counts once for each face that it touches."""
    return 2 * sum(cells_on_face(block, d) for d in range(len(block)))


def surface_place(P, flat, block):
    """(coordinates, face, normal) of a place on the surface: faces in order, within a face the first of its axes fastest."""
    dim = len(block)
    first = [sum(2 * cells_on_face(block, k) for k in range(d)) for d in range(dim)]
    coords, normal, face = [flat * 0] * dim, [flat * 0] * dim, flat * 0
    for d in range(dim):
        size = cells_on_face(block, d)
        for side in (0, 1):
            begin = first[d] + side * size
            here = P.let((flat >= begin) & (flat < begin + size))
            rest = P.let(where(here, flat - begin, flat * 0))
            face = where(here, 2 * d + side, face)
            normal[d] = where(here, 2 * side - 1, normal[d])
            for k in range(dim):
                if k == d:
                    coords[k] = where(here, side * (block[d] - 1), coords[k])
                else:
                    low, rest = rest % block[k], div(rest, block[k])
                    coords[k] = where(here, low, coords[k])
            coords, face, normal = [P.let(c) for c in coords], P.let(face), [P.let(n) for n in normal]
    return coords, face, normal


def face_block(block, d: int) -> tuple[int, ...]:
    """Faces along axis d of a block: one more than cells along it."""
    return tuple(n + (k == d) for k, n in enumerate(block))


def face_offsets(block) -> list[int]:
    """Where the faces of each axis begin in a flat list, and their number at the end."""
    out = [0]
    for d in range(len(block)):
        out.append(out[-1] + prod(face_block(block, d)))
    return out


def face_place(P, flat, block):
    """(coordinates, axis) of a face from its flat index, the first axis fastest."""
    starts = face_offsets(block)
    axis = flat * 0
    coords = [flat * 0] * len(block)
    for d in range(len(block)):
        here = P.let((flat >= starts[d]) & (flat < starts[d + 1]))
        rest = P.let(where(here, flat - starts[d], flat * 0))
        axis = P.let(where(here, d, axis))
        for k, n in enumerate(face_block(block, d)):
            coords[k], rest = P.let(where(here, rest % n, coords[k])), div(rest, n)
    return coords, axis


def reshaped(coords, shift):
    """Coordinates in a block with a halo of ``shift`` cells, from those without (and back with the sign turned)."""
    return [c + s for c, s in zip(coords, shift, strict=True)]


# Borders


def _touching(coords, sizes, axes):
    return [(coords[d] == 0) | (coords[d] == sizes[d]) for d in axes]


def cell_at_domain_border(key, coords, block, brick, dim: int = 2):
    return _any(K.at_domain_border(key, 2 * d + side, brick, dim) & (coords[d] == side * (block[d] - 1)) for d in range(dim) for side in (0, 1))


def face_at_block_border(coords, axis: int, block):
    """Whether a face along ``axis`` lies on the block's border."""
    return _touching(coords, block, (axis,))[0]


def edge_axes(axis: int, dim: int) -> list[int]:
    """The axes across an edge along ``axis`` that the dimension has; an edge of two dimensions stands on the plane (axis 2)."""
    return [d for d in range(dim) if d != axis]


def edge_at_block_border(coords, axis: int, block):
    return _any(_touching(coords, block, edge_axes(axis, len(block))))


def edge_at_domain_border(key, coords, axis: int, block, brick, dim: int = 2):
    return _any(K.at_domain_border(key, 2 * d + side, brick, dim) & (coords[d] == side * block[d]) for d in edge_axes(axis, dim) for side in (0, 1))


def edge_at_surface(coords, axis: int, block, face: int):
    """Whether an edge lies in one face of the block: never if it stands across it."""
    d, side = face // 2, face & 1
    return coords[d] == (side * block[d] if d != axis else -1)


def edge_at_block_edge(coords, axis: int, block, first: int, second: int):
    """Whether an edge lies in two orthogonal faces of the block."""
    return edge_at_surface(coords, axis, block, first) & edge_at_surface(coords, axis, block, second)


# Corner regions and small reductions


def fully_inside(regions):
    """Whether all corners of a cell belong to one region."""
    return _all(r == regions[0] for r in regions[1:])


def overlaps(regions, region):
    """Whether any corner of a cell belongs to a region."""
    return _any(r == region for r in regions)


def arg_min(P, *values):
    """The place of the least of a few values, the first one of equal ones."""
    low, at = values[0], values[0] * 0
    for i, v in enumerate(values[1:], 1):
        less = P.let(v < low)
        low, at = P.let(where(less, v, low)), P.let(where(less, float(i), at))
    return at
