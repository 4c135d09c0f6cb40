"""Queries of scalar functions over the driver's tables."""

from __future__ import annotations


from ..functions import eos as E
from ..functions import flux as X
from ..functions import geometry as G
from ..functions import keys as K
from ..functions import magnetic as B
from ..functions import materials as M
from ..functions import vof as V
from ..functions.algebra import absolute, integer, long, rounded, where
from ..sources import analytic as A
from ..sources.config import Settings
from ..sources.problems import initial
from .registry import Registry

LINE = ["l_orderkey", "l_linenumber"]
#: Octants made from line items: two dimensions with trees 0..2 x 0..1, three with 0..1 each, at levels 1..7.
KEY2 = {
    "lev": "l_linenumber % 7 + 1",
    "tx": "l_suppkey % 3",
    "ty": "l_suppkey % 2",
    "ox": "(l_orderkey * 7919 + l_partkey) % 128 * 32768",
    "oy": "(l_partkey * 104729 + l_orderkey) % 128 * 32768",
}
KEY3 = {
    "lev": "l_linenumber % 7 + 1",
    "tx": "l_suppkey % 2",
    "ty": "l_partkey % 2",
    "tz": "l_orderkey % 2",
    "ox": "(l_orderkey * 7919 + l_partkey) % 128 * 128",
    "oy": "(l_partkey * 104729 + l_orderkey) % 128 * 128",
    "oz": "(l_partkey + l_orderkey * 31) % 128 * 128",
}
#: Two gas states from line items.
STATES = {
    "r1": "l_quantity / 10.0 + 0.1",
    "u1": "l_discount * 10.0 - 0.5",
    "v1": "l_tax * 5.0",
    "w1": "l_tax - 0.03",
    "p1": "l_extendedprice / 10000.0 + 0.1",
    "r2": "CAST(l_suppkey % 10 AS DOUBLE) / 4.0 + 0.5",
    "u2": "CAST(l_partkey % 7 - 3 AS DOUBLE) / 4.0",
    "v2": "CAST(l_orderkey % 5 AS DOUBLE) / 8.0",
    "w2": "CAST(l_orderkey % 3 AS DOUBLE) / 8.0",
    "p2": "CAST(l_partkey % 9 + 1 AS DOUBLE) / 5.0",
}
FIELDS = {f"{f}{s}": f"CAST({c} % {m} - {o} AS DOUBLE) / 4.0" for s, c, m, o in (("1", "l_partkey", 5, 2), ("2", "l_suppkey", 7, 3)) for f in ("by", "bz")} | {"bx1": "CAST(l_orderkey % 4 + 1 AS DOUBLE) / 4.0", "bx2": "CAST(l_orderkey % 3 + 1 AS DOUBLE) / 4.0"}
UNIT = {"x": "CAST(l_orderkey % 64 AS DOUBLE) / 64.0 + 0.0078125", "y": "CAST(l_partkey % 64 AS DOUBLE) / 64.0 + 0.0078125", "z": "CAST(l_suppkey % 16 AS DOUBLE) / 16.0 + 0.03125"}
PLANES = {"nx": "l_discount * 10.0 - 0.45", "ny": "l_tax * 10.0 - 0.33", "nz": "CAST(l_partkey % 11 - 5 AS DOUBLE) / 7.0", "al": "CAST(l_suppkey % 21 - 10 AS DOUBLE) / 20.0"}


def _key(P, dim: int):
    """A key made from the octant columns, its corner aligned to its level."""
    lev = P.let(integer(P.col("lev")))
    size = P.let(K.length_of_level(lev, dim))
    coords = [P.let(long(P.col(n)) - long(P.col(n)) % size) for n in ("ox", "oy", "oz")[:dim]]
    trees = [long(P.col(n)) for n in ("tx", "ty", "tz")[:dim]]
    return P.let(K.encode(trees, coords, lev))


def add_all(reg: Registry) -> None:
    for dim, inputs, brick in ((2, KEY2, (3, 2)), (3, KEY3, (2, 2, 2))):
        open_, closed = [True] * dim, [False] * dim
        mixed = [True] + [False] * (dim - 1)

        def key_query(name, build, dim=dim, inputs=inputs):
            reg.formula(f"{name}_{dim}d", "lineitem", inputs, LINE, lambda P: build(P, _key(P, dim), dim))

        key_query("k_encode", lambda P, k, d: {"key": k, "sorts": long(K.ordered(k))})
        key_query("k_fields", lambda P, k, d: {"level": K.level(k, d), "morton": K.morton_octant(k, d), "tree": K.morton_tree(k, d), "outside": K.outside_status(k, d), "releveled": K.with_field(k, 3, K.LAYOUTS[d].outside, K.LAYOUTS[d].level), "toggled": K.toggled(k, 1)})
        key_query("k_split", lambda P, k, d: {"tree_morton": K.encode_tree_morton([long(P.col(n)) for n in ("tx", "ty", "tz")[:d]]), "octant_morton": K.encode_octant_morton([long(P.col(n)) for n in ("ox", "oy", "oz")[:d]])})
        key_query("k_decode", lambda P, k, d: {f"t{a}": c for a, c in zip("xyz", K.tree_coords(k, d), strict=False)} | {f"o{a}": c for a, c in zip("xyz", K.octant_coords(k, d), strict=False)})
        key_query("k_length", lambda P, k, d: {"length": K.length(k, d), "last": K.last_offset(k, d)})
        key_query("k_father", lambda P, k, d: {"father": K.father(k, d)})
        key_query("k_child_id", lambda P, k, d: {"child": K.child_id(k, d)})
        key_query("k_family", lambda P, k, d: {"family": K.family_id(k, d), "oldest": K.oldest_brother(k, d), "is_first": K.is_first_of_family(k, d)})
        key_query("k_children", lambda P, k, d: {f"c{i}": c for i, c in enumerate(K.children(k, d))} | {"eldest": K.eldest_child(k, d)})
        key_query("k_touching", lambda P, k, d: {f"f{f}": K.child(k, K.touching_child([f]), d) for f in range(2 * d)} | {"corner": K.child(k, K.touching_child([2 * a for a in range(d)]), d)})
        key_query("k_tree_border", lambda P, k, d: {f"f{f}": K.at_tree_border(k, f, d) for f in range(2 * d)} | {"any_face": K.at_any_tree_border(k, d)})
        key_query("k_domain_border", lambda P, k, d, b=brick: {f"f{f}": K.at_domain_border(k, f, b, d) for f in range(2 * d)} | {"any_face": K.at_any_domain_border(k, b, d)})
        key_query("k_tree_corner", lambda P, k, d: {"low": K.at_tree_faces(k, [2 * a for a in range(d)], d), "edge": K.at_tree_faces(k, [0, 2], d), "any_corner": K.at_any_tree_corner(k, d)})
        key_query("k_outside_normal", lambda P, k, d, b=brick, p=mixed: {f"n{'xyz'[a]}": n for a, n in enumerate(K.outside_normal(k, b, p, d))})
        key_query("k_neighbor", lambda P, k, d, b=brick, o=open_, c=closed: {"right": K.neighbor(k, (1,) + (0,) * (d - 1), b, o, d), "left_closed": K.neighbor(k, (-1,) + (0,) * (d - 1), b, c, d), "diagonal": K.neighbor(k, (1,) * d, b, c, d)})
        key_query("k_face_corner", lambda P, k, d, b=brick: {f"f{f}": K.face_neighbor(k, f, b, d) for f in range(2 * d)} | {"corner": K.corner_neighbor(k, [2 * a + 1 for a in range(d)], b, d)})
        key_query("k_displacement", lambda P, k, d, b=brick, c=closed: {"moved": K.neighbor(k, K.displacement([1, 2], d), b, c, d)})
        key_query("k_outside", lambda P, k, d: {"set": K.set_outside(k, 0), "is_set": K.is_outside(K.set_outside(k, 1), d), "along": K.is_outside_along(K.set_outside(k, 1), 1, d), "reset": K.reset_outside(K.set_outside(k, 1), d)})
        key_query("k_morton", lambda P, k, d: {"code": P.let(K.morton([long(P.col(n)) for n in ("ox", "oy", "oz")[:d]], 24 if d == 2 else 16)), "beyond": K.morton_neighbor(K.morton([long(P.col(n)) for n in ("ox", "oy", "oz")[:d]], 24 if d == 2 else 16), P.col("lev"), 1, d, 24 if d == 2 else 16), "size": K.level_size(P.col("lev"), d)})
        key_query("k_two_words", lambda P, k, d: {"word0": K.morton([long(P.col(n)) for n in ("ox", "oy", "oz")[:d]], 16), "word1": K.level_tree(P.col("lev"), P.col("tx"))})
        key_query("k_swap_bits", lambda P, k, d: {"swapped": K.swap_bits(k, 3, 11)})
        cells = lambda P, d: [long(P.col("tx")), long(P.col("ty")) + 1, long(P.col("lev")) % 4][:d]
        sizes = (4, 4, 4)[:dim]
        key_query("k_cells", lambda P, k, d, s=sizes: {"cell": P.let(K.cell_index(cells(P, d), s)), "i": K.cell_coords(K.cell_index(cells(P, d), s), s)[0], "j": K.cell_coords(K.cell_index(cells(P, d), s), s)[1], "moved": K.shifted_cell(K.cell_index(cells(P, d), s), (1,) + (-1,) * (d - 1), s)})

        named = lambda pre, coords: {f"{pre}{'xyz'[a]}": rounded(c, 9) for a, c in enumerate(coords)}
        key_query("g_vertex", lambda P, k, d: named("v", G.vertex(k, d)) | named("c", G.vertex(k, d, True)))
        key_query("g_outside_vertex", lambda P, k, d, b=brick, c=closed: named("v", G.outside_vertex(P.let(K.neighbor(k, (-1,) + (0,) * (d - 1), b, c, d)), b, d)))
        key_query("g_cell_center", lambda P, k, d, s=sizes: named("c", G.cell_centre(k, cells(P, d), s, d)) | named("k", G.corner(k, cells(P, d), s, 1, d)) | named("f", G.face_centre(k, cells(P, d), 0, s, d)) | named("e", G.edge_centre(k, cells(P, d), 0, s, d)))
        key_query("g_anisotropic", lambda P, k, d: named("f", G.face_centre(k, cells(P, d), 1, (4, 8, 2)[:d], d)) | named("e", G.edge_centre(k, cells(P, d), 1, (4, 8, 2)[:d], d)))
        key_query("g_real_space", lambda P, k, d, s=sizes: named("r", G.real_space(G.cell_centre(k, cells(P, d), s, d), (-1.0, 0.5, 2.0)[:d], 2.5)))
        key_query("g_lengths", lambda P, k, d: {"cell": rounded(G.cell_length(K.level(k, d), 4, d, 2.0), 9), "block": rounded(G.block_length(K.level(k, d), d, 2.0), 9)})

    def unit(name, build, inputs=UNIT):
        reg.formula(name, "lineitem", inputs, LINE, build)

    xy = lambda P: [P.col("x"), P.col("y")]
    xyz = lambda P: [P.col("x"), P.col("y"), P.col("z")]
    unit("g_tangent", lambda P: (lambda r: {"nx": rounded(r[0][0]), "ny": rounded(r[0][1]), "alpha": rounded(r[1])})(G.tangent(xy(P), [-0.25, -0.5], 1.0)))
    unit("g_ring_map", lambda P: {f"r{a}": rounded(c) for a, c in zip("xy", G.polar(xy(P), 0.5, 1.0), strict=True)})
    unit("g_shell_map", lambda P: {f"r{a}": rounded(c) for a, c in zip("xyz", G.cube_to_shell([P.col("x") * 2.0 - 1.0, P.col("y") * 2.0 - 1.0, P.col("z")], 0.5, 1.0), strict=True)})
    unit("g_disk_map", lambda P: {f"r{a}": rounded(c) for a, c in zip("xy", G.square_to_disk([P.col("x") * 2.0 - 1.0, P.col("y") * 2.0 - 1.0]), strict=True)})
    unit("s_analytic", lambda P: {"gauss2": rounded(A.gaussian(xy(P), (0.5, 0.5))), "gauss3": rounded(A.gaussian(xyz(P), (0.4, 0.8, 0.9))), "hat": A.hat(xy(P), (0.5, 0.5), 0.25), "parabola2": rounded(A.parabola(xy(P))), "parabola3": rounded(A.parabola(xyz(P))), "wave": rounded(A.sine_wave(xy(P))), "ramp": rounded(A.ramp(xy(P), 2)), "cosine": rounded(A.squared_cosine(xy(P))), "difference": rounded(A.difference(xy(P), 1))})
    unit("s_riemann_2d", lambda P: {n: rounded(v) for n, v in zip("ruvp", A.quadrants(xy(P), [(1.5, 0.0, 0.0, 1.5), (0.5323, 1.206, 0.0, 0.3), (0.138, 1.206, 1.206, 0.029), (0.5323, 0.0, 1.206, 0.3)]), strict=True)})
    unit("s_sod", lambda P: {n: rounded(v) for n, v in zip("rup", A.sod(P.col("x")), strict=True)})
    for name, given, space in (("shu_osher", "[shu_osher]\nx0 = 0.25", 1), ("woodward", "", 1), ("blast", "[blast]\nradius = 0.3", 3), ("rotor", "", 2)):
        unit(f"s_{name}", lambda P, n=name, g=given, d=space: {f"q_{k}": rounded(v) for k, v in initial(n, Settings(g), xyz(P)[:d]).items()})
    unit("p_fuzzy", lambda P: {"null": absolute(P.col("x") - 0.5) < 1e-12, "clamped": rounded(V.clamp(P.col("x") * 3.0 - 1.0)), "same": absolute(P.col("x") - P.col("y")) < 1e-12})

    # Equations of state
    gas = {k: STATES[k] for k in ("r1", "p1", "u1", "v1")}
    kinds = {
        "ideal": E.IdealGas(1.4),
        "stiffened": E.StiffenedGas(4.4, 0.6),
        "vdw": E.VanDerWaals(1.4, 0.1, 0.05),
        "cochran_chan": E.CochranChan(0.93, 1.134, 0.8192, 1.508, 4.53, 1.42, 0.1),
        "jwl": E.JonesWilkinsLee(0.35, 1.84, 8.545, 0.205, 4.6, 1.35, 0.0),
        "shock_wave": E.ShockWave(1.99, 2.785, 1.2, 0.3, 0.05, 0.0, 0.48, 0.1),
        "shock_wave2": E.ShockWave2(1.99, 2.785, 1.2, 0.3, 1.0, 0.1, 0.05),
        "mg_ideal": E.MieGruneisenIdeal(E.IdealGas(1.4)),
        "mg_stiffened": E.MieGruneisenIdeal(E.StiffenedGas(4.4, 0.6)),
        "mg_vdw": E.MieGruneisenIdeal(E.VanDerWaals(1.4, 0.1, 0.05)),
    }

    def eos_outputs(P, e):
        r, p = P.let(P.col("r1")), P.let(P.col("p1"))
        energy = P.let(e.energy(r, p))
        out = {"energy": rounded(energy), "back": rounded(e.pressure(r, energy)), "specific": rounded(e.energy_specific(r, p)), "from_specific": rounded(e.pressure_specific(r, e.energy_specific(r, p))), "c2": rounded(e.sound_speed_squared(r, p)), "bulk": rounded(e.bulk_modulus(r, p))}
        return out | ({"slope": rounded(e.pressure_slope(r, p))} if isinstance(e, E.ShockWave) else {})

    for name, e in kinds.items():
        reg.formula(f"e_{name}", "lineitem", gas, LINE, lambda P, e=e: eos_outputs(P, e))
    for name, mix in (("ideal_mixture", E.TwoGasMixture(E.IdealGas(1.4), E.IdealGas(1.67))), ("stiffened_mixture", E.TwoGasMixture(E.StiffenedGas(1.4, 0.0), E.StiffenedGas(4.4, 0.6)))):
        reg.formula(f"e_{name}", "lineitem", gas | {"phi": "CAST(l_partkey % 11 AS DOUBLE) / 10.0"}, LINE, lambda P, m=mix: {"p": rounded(m.pressure(P.col("r1"), P.col("p1"), P.col("phi"))), "e": rounded(m.energy_specific(P.col("r1"), P.col("p1"), P.col("phi"))), "c": rounded(m.sound_speed(P.col("r1"), P.col("p1"), P.col("phi")))})
    three = E.GruneisenMixture((E.MieGruneisenIdeal(E.IdealGas(1.4)), E.MieGruneisenIdeal(E.StiffenedGas(4.4, 0.6)), E.CochranChan(0.93, 1.134, 0.8192, 1.508, 4.53, 1.42, 0.1)))

    def mixture(P):
        a0 = P.let(P.col("phi"))
        a1 = P.let((1.0 - a0) * 0.5)
        alphas = [a0, a1, a1]
        parts = [P.let(a * P.col("r1") * f) for a, f in zip(alphas, (1.0, 1.5, 0.8), strict=True)]
        p = P.col("p1")
        return {"gamma": rounded(three.gruneisen(alphas, parts)), "p": rounded(three.pressure(P.col("r1"), p, alphas, parts)), "e": rounded(three.energy(p, alphas, parts)), "c2": rounded(three.sound_speed_squared(P.col("r1"), p, alphas, parts))}

    reg.formula("e_mg_mixture", "lineitem", gas | {"phi": "CAST(l_partkey % 10 AS DOUBLE) / 10.0"}, LINE, mixture)
    reg.formula("e_by_material", "lineitem", gas | {"mat": "l_suppkey % 3"}, LINE, lambda P: {"p": rounded(E.by_material({0: kinds["ideal"], 1: kinds["stiffened"], 2: kinds["jwl"]}, P.col("mat"), "pressure", P.col("r1"), P.col("p1")))})
    reg.formula("e_named", "lineitem", gas, LINE, lambda P: {"c": rounded(E.named("stiffened_gas", gamma=4.4, p_inf=0.6).sound_speed(P.col("r1"), P.col("p1")))})

    # Fluxes
    def state(P, s, three_d=False, fields=False):
        q = {k: P.col(f"{k}{s}") for k in ("r", "u", "v", "p")}
        if three_d:
            q["w"] = P.col(f"w{s}")
        if fields:
            q |= {k: P.col(f"{k}{s}") for k in ("bx", "by", "bz")}
        return q

    out = lambda flux: {f"f_{k}": rounded(v) for k, v in flux.items()}
    flux = lambda name, build, inputs=STATES: reg.formula(name, "lineitem", inputs, LINE, build)
    flux("f_primitive", lambda P: (lambda q, ok: {k: rounded(v) for k, v in q.items()} | {"valid": ok})(*X.primitive(P.col("r1"), P.col("p1"), [P.col("u1"), P.col("v1")])))
    flux("f_primitive_3d", lambda P: (lambda q, ok: {k: rounded(v) for k, v in q.items()} | {"valid": ok})(*X.primitive(P.col("r1"), P.col("p1"), [P.col("u1"), P.col("v1"), P.col("w1")])))
    flux("f_euler_flux", lambda P: {f"x_{k}": rounded(v) for k, v in X.euler_flux(state(P, 1), 0).items()} | {f"y_{k}": rounded(v) for k, v in X.euler_flux(state(P, 1), 1).items()})
    flux("f_euler_flux_3d", lambda P: {f"{a}_{k}": rounded(v) for d, a in enumerate("xyz") for k, v in X.euler_flux(state(P, 1, True), d).items()})
    flux("f_viscous", lambda P: out(X.viscous_flux(state(P, 1), {"ux": P.col("u1"), "uy": P.col("u2"), "vx": P.col("v1"), "vy": P.col("v2")}, 0.1)))
    flux("f_characteristic", lambda P: (lambda w: {f"w_{k}": rounded(v) for k, v in w.items()} | {f"b_{k}": rounded(v) for k, v in X.from_characteristic(state(P, 1), w).items()})({k: P.let(v) for k, v in X.to_characteristic(state(P, 1), state(P, 2)).items()}))
    for kind in X.SOLVERS:
        flux(f"f_{kind}", lambda P, k=kind: out(X.solve(k, P, state(P, 1), state(P, 2))))
        if kind != "approx":
            flux(f"f_{kind}_3d", lambda P, k=kind: out(X.solve(k, P, state(P, 1, True), state(P, 2, True))))
            flux(f"f_{kind}_stiffened", lambda P, k=kind: out(X.solve(k, P, state(P, 1), state(P, 2), eos=E.StiffenedGas(4.4, 0.6))))
    mhd = STATES | FIELDS
    flux("f_mhd_speeds", lambda P: {f"fast_{a}": rounded(X.fast_speed(state(P, 1, True, True), d)) for d, a in enumerate("xyz")} | {"alfven": rounded(X.alfven_speed(state(P, 1, True, True))), "info": rounded(X.info_speed(state(P, 1, True, True)))}, mhd)
    flux("f_mhd_flux", lambda P: out(X.mhd_flux(state(P, 1, True, True))), mhd)
    for kind in B.MHD_SOLVERS:
        flux(f"f_mhd_{kind}", lambda P, k=kind: out(B.solve_mhd(k, P, state(P, 1, True, True), state(P, 2, True, True))), mhd)
    flux("f_mhd_emf", lambda P: {"emf": rounded(X.edge_emf_llf(P, [state(P, 1, True, True), state(P, 2, True, True), state(P, 2, True, True) | {"u": P.col("u1")}, state(P, 1, True, True) | {"v": P.col("v2")}]))}, mhd)
    around = lambda P: [state(P, 1, True, True), state(P, 2, True, True), state(P, 2, True, True) | {"u": P.col("u1")}, state(P, 1, True, True) | {"v": P.col("v2")}]
    for axis, name in enumerate("xyz"):
        flux(f"f_mhd_emf_hlld_{name}", lambda P, a=axis: {"emf": rounded(B.edge_emf_hlld(P, B.edge_states(around(P), a)))}, mhd)
    flux("f_mhd_boris_speeds", lambda P: {"factor": rounded(B.boris_factor(state(P, 1, True, True)))} | {f"fast_{a}": rounded(B.boris_fast_speed(state(P, 1, True, True), d)) for d, a in enumerate("xyz")} | {"info": rounded(B.boris_info_speed(state(P, 1, True, True)))}, mhd)
    for kind in ("rk1", "rk2_ssp", "rk3_ssp"):
        flux(f"f_{kind}", lambda P, k=kind: {"value": rounded(X.advanced(P, P.col("r1"), lambda y: -y * 0.5, 0.1, k))})

    # Interfaces
    plane = lambda name, build, more=None: reg.formula(name, "lineitem", PLANES | (more or {}), LINE, build)
    n2 = lambda P: [P.let(P.col("nx")), P.let(P.col("ny"))]
    n3 = lambda P: [*n2(P), P.let(P.col("nz"))]
    plane("v_area2d", lambda P: {"area": rounded(V.area_below(P, n2(P), P.col("al")))})
    plane("v_volume3d", lambda P: {"volume": rounded(V.volume_below(P, n3(P), P.col("al")))})
    plane("v_box", lambda P: {"area": rounded(V.box_below(P, n2(P), P.col("al"), [0.1, -0.2], [0.6, 0.5])), "volume": rounded(V.box_below(P, n3(P), P.col("al"), [0.1, -0.2, 0.0], [0.6, 0.5, 0.3]))})
    plane("v_line_2d", lambda P: {"alpha": rounded(V.line_for_area(P, n2(P), P.col("part")))}, {"part": "CAST(l_suppkey % 19 + 1 AS DOUBLE) / 20.0"})
    plane("v_plane_3d", lambda P: (lambda a: {"alpha": rounded(a), "back": rounded(V.volume_below(P, n3(P), a))})(V.plane_for_volume(P, n3(P), P.col("part"))), {"part": "CAST(l_suppkey % 19 + 1 AS DOUBLE) / 20.0"})
    nine = {f"f{i}": f"CAST((l_orderkey * {i + 3} + l_partkey) % 11 AS DOUBLE) / 10.0" for i in range(27)}
    reg.formula("v_youngs2d", "lineitem", {k: v for k, v in nine.items() if int(k[1:]) < 9}, LINE, lambda P: {f"n{a}": rounded(c) for a, c in zip("xy", V.youngs(P, [P.col(f"f{i}") for i in range(9)], (0.5, 0.25)), strict=True)})
    reg.formula("v_youngs3d", "lineitem", nine, LINE, lambda P: {f"n{a}": rounded(c) for a, c in zip("xyz", V.youngs(P, [P.col(f"f{i}") for i in range(27)], (0.5, 0.25, 1.0)), strict=True)})
    plane("v_advected", lambda P: {"right": rounded(V.advected(P, P.col("part"), P.col("al"), n2(P), (1.0, 1.0), 0, True, P.col("share"))), "bubble": rounded(V.advected(P, P.col("part"), P.col("al"), [P.col("nx") * 0.0, P.col("nx") * 0.0], (1.0, 1.0), 0, False, P.col("share")))}, {"part": "CAST(l_suppkey % 19 + 1 AS DOUBLE) / 20.0", "share": "CAST(l_partkey % 9 + 1 AS DOUBLE) / 10.0"})
    sets = {"mask": "CAST(l_orderkey * 2654435761 % 1099511627776 AS BIGINT)", "other": "CAST(l_partkey * 40503 % 1099511627776 AS BIGINT)"}
    reg.formula("v_materials", "lineitem", sets, LINE, lambda P: {"both": M.intersection(P.col("mask"), P.col("other")), "either": M.union(P.col("mask"), P.col("other")), "n": long(M.count(P.col("mask"))), "has3": M.has(P.col("mask"), 3), "put3": M.with_material(P.col("mask"), 3), "cut3": M.without_material(P.col("mask"), 3), "index5": long(M.index_of(P.col("mask"), 5)), "second": long(M.material_at(P.col("mask"), 1, 16)), "variables": long(M.variables(P.col("mask"), 4))})
    reg.formula("v_regions", "lineitem", {"region": "l_suppkey % 4"}, LINE, lambda P: {"material": where(P.col("region") == 0, 7, where(P.col("region") == 1, 2, where(P.col("region") == 2, 5, 0)))})
