"""Sets of materials as bit masks: up to 63 in one BIGINT, or as many as wanted in several words of 63."""

from __future__ import annotations

from .algebra import band, bit_count, bor, bxor, shl, shr, where


def has(mask, material):
    return band(shr(mask, material), 1) == 1


def with_material(mask, material: int):
    return bor(mask, 1 << material)


def without_material(mask, material: int):
    return bxor(bor(mask, 1 << material), 1 << material)


def union(a, b):
    return bor(a, b)


def intersection(a, b):
    return band(a, b)


def count(mask):
    return bit_count(mask)


def index_of(mask, material: int):
    """How many materials of the set come before it; -1 if it isn't in the set."""
    return where(has(mask, material), bit_count(band(mask, (1 << material) - 1)), -1)


def material_at(mask, index, limit: int = 63):
    """The material with ``index`` others of the set before it; -1 if there are fewer."""
    out = None
    for m in range(limit):
        hit = has(mask, m) & (bit_count(band(mask, (1 << m) - 1)) == index)
        out = where(hit, m, -1 if out is None else out)
    return out


def variables(mask, each: int):
    return bit_count(mask) * each


def shifted(one, n):
    return shl(one, n)


# Sets of several words, for more than 63 materials

WORD = 63


def wide_has(words, material: int):
    return has(words[material // WORD], material % WORD)


def wide_with(words, material: int):
    return [with_material(w, material % WORD) if i == material // WORD else w for i, w in enumerate(words)]


def wide_without(words, material: int):
    return [without_material(w, material % WORD) if i == material // WORD else w for i, w in enumerate(words)]


def wide_union(a, b):
    return [union(x, y) for x, y in zip(a, b, strict=True)]


def wide_intersection(a, b):
    return [intersection(x, y) for x, y in zip(a, b, strict=True)]


def wide_count(words):
    out = count(words[0])
    for w in words[1:]:
        out = out + count(w)
    return out


def wide_index_of(words, material: int):
    """How many materials of the set come before it; -1 if it isn't in the set."""
    at = material // WORD
    before = bit_count(band(words[at], (1 << material % WORD) - 1))
    for w in words[:at]:
        before = before + count(w)
    return where(wide_has(words, material), before, -1)
