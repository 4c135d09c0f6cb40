"""Faces, edges and corners of a box, by rule: face 2 a + s is side s of axis a; bit a of a corner is its side along axis a; edges stand along z, then x, then y."""

from __future__ import annotations

from itertools import combinations


def opposite(face: int) -> int:
    return face ^ 1


def corner_faces(corner: int, dim: int) -> tuple[int, ...]:
    """The faces that meet in a corner, one for each axis."""
    return tuple(2 * a + (corner >> a & 1) for a in range(dim))


def edge_axis(edge: int) -> int:
    """The axis that an edge runs along: four along z, four along x, four along y."""
    return (2, 0, 1)[edge // 4]


def edge_faces(edge: int) -> tuple[int, int]:
    """The two faces that meet in an edge, the lower axis first."""
    low, high = (a for a in range(3) if a != edge_axis(edge))
    return 2 * low + (edge & 1), 2 * high + (edge >> 1 & 1)


def edges() -> dict[tuple[int, int], int]:
    """Edge by its two faces."""
    return {edge_faces(e): e for e in range(12)}


def face_corners(face: int, dim: int) -> tuple[int, ...]:
    """The corners of a face in ascending order."""
    return tuple(c for c in range(1 << dim) if (c >> face // 2 & 1) == (face & 1))


def edge_corners(edge: int) -> tuple[int, int]:
    a, b = edge_faces(edge)
    return tuple(c for c in face_corners(a, 3) if c in face_corners(b, 3))


def rows() -> list[tuple[str, int, int, int, int]]:
    """(kind, dim, number, face, other face) of all edges, of corners of two dimensions and of pairs of faces that meet in corners of three."""
    out = [("edge", 3, e, *edge_faces(e)) for e in range(12)]
    out += [("corner", 2, c, *corner_faces(c, 2)) for c in range(4)]
    return out + [("corner", 3, c, a, b) for c in range(8) for a, b in combinations(corner_faces(c, 3), 2)]
