"""Packed spatial keys of forests of quadtrees and octrees.

A key holds, from its low bits up: outside flags (one for each axis), level, Morton code of the octant's corner, Morton
code of its tree. Keys are unsigned 64-bit patterns in a BIGINT; ``ordered`` turns them into a BIGINT that sorts as they do.
All functions take and return expressions (see algebra).
"""

from __future__ import annotations

from dataclasses import dataclass

from .algebra import band, bor, bxor, div, integer, long, shl, shr, where


@dataclass(frozen=True)
class Layout:
    """Fixed values of the key layout: bit widths."""

    dim: int
    outside: int
    level: int
    morton: int
    tree: int

    @property
    def max_level(self) -> int:
        return self.morton // self.dim

    @property
    def root(self) -> int:
        """Length of a whole tree in units of the finest level."""
        return 1 << self.max_level

    @property
    def morton_at(self) -> int:
        return self.outside + self.level

    @property
    def tree_at(self) -> int:
        return self.morton_at + self.morton

    @property
    def axis_bits(self) -> int:
        return self.tree // self.dim


LAYOUTS = {2: Layout(2, 2, 6, 44, 12), 3: Layout(3, 3, 4, 42, 15)}
SIGN = -(1 << 63)


def field(key, at: int, width: int):
    return band(shr(key, at), (1 << width) - 1)


def with_field(key, value, at: int, width: int):
    """The key with one bit field set."""
    mask = ((1 << width) - 1) << at
    clear = ~mask
    clear = clear if clear >= SIGN else clear + (1 << 64)
    return bor(band(key, clear), shl(long(value), at))


def toggled(key, bits: int):
    return bxor(key, bits)


def outside_status(key, dim: int = 2):
    return field(key, 0, LAYOUTS[dim].outside)


def level(key, dim: int = 2):
    k = LAYOUTS[dim]
    return integer(field(key, k.outside, k.level))


def morton_octant(key, dim: int = 2):
    k = LAYOUTS[dim]
    return field(key, k.morton_at, k.morton)


def morton_tree(key, dim: int = 2):
    k = LAYOUTS[dim]
    return field(key, k.tree_at, k.tree)


def spread(x, dim: int, bits: int):
    """The low ``bits`` bits of x moved apart to every dim-th place, by halving blocks."""
    block = 1
    while block < bits:
        block *= 2
    x = band(long(x), (1 << bits) - 1)
    while block > 1:
        block //= 2
        mask = sum(((1 << block) - 1) << (dim * block * i) for i in range((bits + block - 1) // block))
        x = band(bor(x, shl(x, (dim - 1) * block)), mask)
    return x


def compact(x, dim: int, bits: int):
    """The inverse of ``spread``."""
    x = band(x, sum(1 << (dim * i) for i in range(bits)))
    block = 1
    while block < bits:
        step = (dim - 1) * block
        block *= 2
        mask = sum(((1 << block) - 1) << (dim * block * i) for i in range((bits + block - 1) // block))
        x = band(bor(x, shr(x, step)), mask)
    return x


def interleave(coords, bits: int):
    out = None
    for d, c in enumerate(coords):
        s = spread(c, len(coords), bits)
        out = s if d == 0 else bor(out, shl(s, d))
    return out


def encode_tree_morton(coords):
    return interleave(coords, LAYOUTS[len(coords)].axis_bits)


def encode_octant_morton(coords):
    return interleave(coords, LAYOUTS[len(coords)].max_level)


def encode_with_tree(tree, coords, level_, outside=0):
    k = LAYOUTS[len(coords)]
    low = bor(shl(long(level_), k.outside), long(outside))
    return bor(bor(shl(long(tree), k.tree_at), shl(encode_octant_morton(coords), k.morton_at)), low)


def encode(tree_coords, coords, level_, outside=0):
    return encode_with_tree(encode_tree_morton(tree_coords), coords, level_, outside)


def tree_coords(key, dim: int = 2):
    k = LAYOUTS[dim]
    return [compact(shr(morton_tree(key, dim), d) if d else morton_tree(key, dim), dim, k.axis_bits) for d in range(dim)]


def octant_coords(key, dim: int = 2):
    k = LAYOUTS[dim]
    return [compact(shr(morton_octant(key, dim), d) if d else morton_octant(key, dim), dim, k.max_level) for d in range(dim)]


def length_of_level(lev, dim: int = 2):
    return shr(long(lev) * 0 + LAYOUTS[dim].root, lev)


def length(key, dim: int = 2):
    return length_of_level(level(key, dim), dim)


def last_offset(key, dim: int = 2):
    return LAYOUTS[dim].root - length(key, dim)


def _child_shift(lev, dim: int):
    k = LAYOUTS[dim]
    return (k.max_level - lev) * dim + k.morton_at


def child_id(key, dim: int = 2):
    return integer(band(shr(key, _child_shift(level(key, dim), dim)), (1 << dim) - 1))


def oldest_brother(key, dim: int = 2):
    """The key with its child bits cleared."""
    return key - shl(long(child_id(key, dim)), _child_shift(level(key, dim), dim))


def father(key, dim: int = 2):
    """The enclosing octant one level up; null at level 0."""
    return where(level(key, dim) > 0, oldest_brother(key, dim) - (1 << LAYOUTS[dim].outside), None)


def family_id(key, dim: int = 2):
    return integer(shr(bxor(key, oldest_brother(key, dim)), _child_shift(level(key, dim), dim)))


def is_first_of_family(key, dim: int = 2):
    return child_id(key, dim) == 0


def eldest_child(key, dim: int = 2):
    return key + (1 << LAYOUTS[dim].outside)


def child(key, i, dim: int = 2):
    down = eldest_child(key, dim)
    return down + shl(long(i), _child_shift(level(key, dim) + 1, dim))


def children(key, dim: int = 2):
    return [child(key, i, dim) for i in range(1 << dim)]


def touching_child(faces) -> int:
    """The smallest child of a finer neighbour that touches through the given faces (2 axis + side); a literal."""
    return sum(((~f & 1) << (f // 2)) for f in faces)


def displacement(faces, dim: int = 2) -> tuple[int, ...]:
    """The direction through one, two or three faces."""
    out = [0] * dim
    for f in faces:
        out[f // 2] = 1 if f & 1 else -1
    return tuple(out)


def _axis_mask(d: int, dim: int) -> int:
    """The Morton bits of an axis, in place."""
    k = LAYOUTS[dim]
    return sum(1 << (k.morton_at + dim * i + d) for i in range(k.max_level))


def _unit(key, d: int, dim: int):
    """The lowest Morton bit of an axis at the key's level, in place."""
    return shl(1, _child_shift(level(key, dim), dim) + d)


def _tree_value(x: int, d: int, dim: int) -> int:
    """A tree coordinate as bits of a tree's Morton code."""
    return sum((x >> i & 1) << (dim * i + d) for i in range(LAYOUTS[dim].axis_bits))


def at_tree_border(key, face: int, dim: int = 2):
    d, mask = face // 2, _axis_mask(face // 2, dim)
    return band(key, mask) == (band(-_unit(key, d, dim), mask) if face & 1 else 0)


def _any(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def at_any_tree_border(key, dim: int = 2):
    return _any([at_tree_border(key, f, dim) for f in range(2 * dim)])


def at_domain_border(key, face: int, brick, dim: int = 2):
    d = face // 2
    t = band(morton_tree(key, dim), _tree_value((1 << LAYOUTS[dim].axis_bits) - 1, d, dim))
    return at_tree_border(key, face, dim) & (t == (_tree_value(brick[d] - 1, d, dim) if face & 1 else 0))


def at_any_domain_border(key, brick, dim: int = 2):
    return _any([at_domain_border(key, f, brick, dim) for f in range(2 * dim)])


def at_tree_faces(key, faces, dim: int = 2):
    """On the tree edge or corner where the faces meet."""
    return _all([at_tree_border(key, f, dim) for f in faces])


def at_any_tree_corner(key, dim: int = 2):
    return _all([at_tree_border(key, 2 * d, dim) | at_tree_border(key, 2 * d + 1, dim) for d in range(dim)])


def outside_normal(key, brick, periodic, dim: int = 2):
    """For each axis -1 or 1 where the key touches a border of the domain that isn't periodic, else 0."""
    return [integer(where(at_domain_border(key, 2 * d, brick, dim), -1, where(at_domain_border(key, 2 * d + 1, brick, dim), 1, 0))) if not periodic[d] else integer(level(key, dim) * 0) for d in range(dim)]


def neighbor(key, direction, brick, periodic, dim: int = 2):
    """The key of the same level in a direction (-1, 0 or 1 for each axis): wraps through trees and bricks, and flips the outside flag of an axis whose border it crosses without being periodic."""
    k = LAYOUTS[dim]
    field_mask = sum(_axis_mask(d, dim) for d in range(dim))
    tree = morton_tree(key, dim)
    moved, keep, new_tree, flips = None, (1 << 64) - 1, tree, 0
    for d, step in enumerate(direction):
        if not step:
            continue
        # Addition on one axis of a Morton code: the other axes' bits are all ones, so carries pass through them.
        mask, unit = _axis_mask(d, dim), _unit(key, d, dim)
        keep &= ~mask
        crosses = at_tree_border(key, 2 * d + (step > 0), dim)
        own = band(key, mask)
        to = band(bor(own, field_mask & ~mask) + unit, mask) if step > 0 else band(own + (1 << k.tree_at) - unit, mask)
        moved = to if moved is None else bor(moved, to)
        tmask = _tree_value((1 << k.axis_bits) - 1, d, dim)
        rest = ((1 << k.tree) - 1) & ~tmask
        t, last = band(tree, tmask), _tree_value(brick[d] - 1, d, dim)
        edge = t == (last if step > 0 else 0)
        onward = band(bor(t, rest) + (1 << d), tmask) if step > 0 else band(t + (1 << k.tree) - (1 << d), tmask)
        new_tree = bor(band(new_tree, ((1 << k.tree) - 1) & ~tmask), where(crosses, where(edge, 0 if step > 0 else last, onward), t))
        if not periodic[d]:
            flips = bor(flips, where(crosses & edge, 1 << d, 0)) if not isinstance(flips, int) else where(crosses & edge, 1 << d, 0)
    keep &= (1 << k.tree_at) - 1
    out = bor(bor(band(key, keep), moved), shl(new_tree, k.tree_at))
    return bxor(out, flips)


def face_neighbor(key, face: int, brick, dim: int = 2):
    """Across a face of a periodic brick."""
    return neighbor(key, displacement([face], dim), brick, [True] * dim, dim)


def corner_neighbor(key, faces, brick, dim: int = 2):
    return neighbor(key, displacement(faces, dim), brick, [True] * dim, dim)


def is_outside(key, dim: int = 2):
    return outside_status(key, dim) != 0


def is_outside_along(key, axis: int, dim: int = 2):
    return band(key, 1 << axis) != 0


def set_outside(key, axis: int):
    return bor(key, 1 << axis)


def reset_outside(key, dim: int = 2):
    return band(key, -(1 << LAYOUTS[dim].outside))


def ordered(key):
    """A signed value that sorts as the unsigned key does."""
    return bxor(key, SIGN)


# Plain Morton codes and the older two-word key


def morton(coords, bits: int = 20):
    return interleave(coords, bits)


def morton_coords(code, dim: int = 2, bits: int = 20):
    return [compact(shr(code, d) if d else code, dim, bits) for d in range(dim)]


def morton_neighbor(code, lev, face: int, dim: int = 2, bits: int = 20):
    """The code across a face at the same level, wrapping within the unit tree of ``bits`` levels."""
    d, whole = face // 2, (1 << (dim * bits)) - 1
    mask = sum(1 << (dim * i + d) for i in range(bits))
    unit = shl(1, (bits - lev) * dim + d)
    own = band(code, mask)
    to = band(bor(own, whole & ~mask) + unit, mask) if face & 1 else band(own + (whole + 1) - unit, mask)
    return bor(band(code, whole & ~mask), to)


def level_tree(lev, tree=0):
    """The second word of the two-word key: level in the low byte, tree above."""
    return bor(shl(long(tree), 8), long(lev))


def swap_bits(x, p: int, q: int):
    differs = band(bxor(shr(x, p), shr(x, q)), 1)
    return bxor(x, bor(shl(differs, p), shl(differs, q)))


def level_size(lev, dim: int = 2):
    """Edge length at a level as a part of the tree's."""
    return 1.0 / shl(long(lev) * 0 + 1, lev)


# Cells of a block, x fastest


def cell_coords(cell, sizes):
    out, rest = [], cell
    for n in sizes[:-1]:
        out.append(rest % n)
        rest = div(rest, n)
    return [*out, rest]


def cell_index(coords, sizes):
    out, stride = coords[0], sizes[0]
    for c, n in zip(coords[1:], sizes[1:], strict=True):
        out, stride = out + c * stride, stride * n
    return out


def shifted_cell(cell, shift, sizes):
    """Index of the cell moved by ``shift``; -1 outside the block."""
    moved = [c + s for c, s in zip(cell_coords(cell, sizes), shift, strict=True)]
    inside = _all([(c >= 0) & (c < n) for c, n in zip(moved, sizes, strict=True)])
    return where(inside, cell_index(moved, sizes), -1)
