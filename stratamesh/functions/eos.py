"""Equations of state. Each offers pressure, internal energy and sound speed as formulas of expressions (see algebra)."""

from __future__ import annotations

from dataclasses import dataclass

from .algebra import exp, greatest, power, sqrt, where

#: Volume fractions up to this are taken as absent from a mixture.
LOW_ALPHA = 1e-10


class Eos:
    def pressure(self, rho, energy):
        """From density and energy by volume."""
        raise NotImplementedError

    def energy(self, rho, p):
        """By volume, from density and pressure."""
        raise NotImplementedError

    def sound_speed_squared(self, rho, p):
        raise NotImplementedError

    def pressure_specific(self, rho, e):
        return self.pressure(rho, e * rho)

    def energy_specific(self, rho, p):
        return self.energy(rho, p) / rho

    def sound_speed(self, rho, p):
        return sqrt(self.sound_speed_squared(rho, p))

    def bulk_modulus(self, rho, p):
        return rho * self.sound_speed_squared(rho, p)


@dataclass(frozen=True)
class StiffenedGas(Eos):
    gamma: float = 1.4
    p_inf: float = 0.0

    def pressure(self, rho, energy):
        return energy * (self.gamma - 1) - self.gamma * self.p_inf

    def energy(self, rho, p):
        return (p + self.gamma * self.p_inf) / (self.gamma - 1)

    def sound_speed_squared(self, rho, p):
        return (p + self.p_inf) * self.gamma / rho


class IdealGas(StiffenedGas):
    def __init__(self, gamma: float = 1.4):
        super().__init__(gamma, 0.0)


@dataclass(frozen=True)
class VanDerWaals(Eos):
    gamma: float = 1.4
    a: float = 0.1
    b: float = 0.05

    def pressure(self, rho, energy):
        cohesion = rho * rho * self.a
        return (energy + cohesion) * (self.gamma - 1) / (1.0 - rho * self.b) - cohesion

    def energy(self, rho, p):
        cohesion = rho * rho * self.a
        return (p + cohesion) * (1.0 - rho * self.b) / (self.gamma - 1) - cohesion

    def sound_speed_squared(self, rho, p):
        cohesion = rho * rho * self.a
        return (p * self.gamma + cohesion * (self.gamma - 2) + cohesion * rho * (2 * self.b)) / (rho - rho * rho * self.b)


class MieGruneisen(Eos):
    """p = p_ref + Gamma (rho e - rho e_ref)."""

    def gruneisen(self, rho):
        raise NotImplementedError

    def reference(self, rho):
        """(reference pressure, reference specific energy)."""
        raise NotImplementedError

    def pressure(self, rho, energy):
        p, e = self.reference(rho)
        return p + self.gruneisen(rho) * (energy - rho * e)

    def energy(self, rho, p):
        p0, e = self.reference(rho)
        return (p - p0) / self.gruneisen(rho) + rho * e


@dataclass(frozen=True)
class MieGruneisenIdeal(MieGruneisen):
    """Ideal, stiffened and van der Waals gases in Mie-Gruneisen form."""

    base: Eos = StiffenedGas()

    def gruneisen(self, rho):
        if isinstance(self.base, VanDerWaals):
            return (self.base.gamma - 1) / (1.0 - rho * self.base.b)
        return rho * 0.0 + (self.base.gamma - 1)

    def reference(self, rho):
        if isinstance(self.base, VanDerWaals):
            return rho * rho * -self.base.a, rho * -self.base.a
        return rho * 0.0 - self.base.gamma * self.base.p_inf, rho * 0.0

    def sound_speed_squared(self, rho, p):
        return self.base.sound_speed_squared(rho, p)


@dataclass(frozen=True)
class CochranChan(MieGruneisen):
    Gamma0: float = 1.0
    rho0: float = 1.0
    A1: float = 1.0
    A2: float = 1.0
    E1: float = 2.0
    E2: float = 1.5
    e0: float = 0.0

    def gruneisen(self, rho):
        return rho * 0.0 + self.Gamma0

    def reference(self, rho):
        x = rho / self.rho0
        p = power(x, self.E1) * self.A1 - power(x, self.E2) * self.A2
        term = lambda a, n: (power(x, n - 1) - 1.0) * (a / (self.rho0 * (n - 1)))
        return p, term(self.A1, self.E1) - term(self.A2, self.E2) + self.e0

    def sound_speed_squared(self, rho, p):
        x, g = rho / self.rho0, self.Gamma0 + 1
        return p * g / rho - power(x, self.E1 - 1) * (self.A1 / self.rho0 * (g - self.E1)) + power(x, self.E2 - 1) * (self.A2 / self.rho0 * (g - self.E2))


@dataclass(frozen=True)
class JonesWilkinsLee(MieGruneisen):
    Gamma0: float = 0.3
    rho0: float = 1.0
    A1: float = 5.0
    A2: float = 0.2
    R1: float = 4.0
    R2: float = 1.0
    e0: float = 0.0

    def gruneisen(self, rho):
        return rho * 0.0 + self.Gamma0

    def reference(self, rho):
        v = self.rho0 / rho
        first, second = exp(v * -self.R1), exp(v * -self.R2)
        return first * self.A1 + second * self.A2, (first * (self.A1 / self.R1) + second * (self.A2 / self.R2)) / self.rho0 + self.e0

    def sound_speed_squared(self, rho, p):
        v, g = self.rho0 / rho, self.Gamma0 + 1
        term = lambda a, r: exp(v * -r) * (g - v * r) * a / rho
        return p * g / rho - term(self.A1, self.R1) - term(self.A2, self.R2)


@dataclass(frozen=True)
class ShockWave(MieGruneisen):
    """Reference curve from a Hugoniot with a cubic slope under compression, linear under release."""

    Gamma0: float = 2.0
    rho0: float = 1.0
    c0: float = 2.0
    s1: float = 1.2
    s2: float = 0.1
    s3: float = 0.0
    b: float = 0.5
    e0: float = 0.0

    def _strain(self, rho):
        return 1.0 - self.rho0 / rho

    def gruneisen(self, rho):
        v = self._strain(rho)
        return (1.0 - v) * self.Gamma0 + v * self.b

    def _slope(self, v):
        return v * self.s2 + v * v * self.s3 + self.s1

    def _slope_rise(self, v):
        return v * (2 * self.s2) + v * v * (3 * self.s3) + self.s1

    def reference(self, rho):
        v = self._strain(rho)
        d = 1.0 - self._slope(v) * v
        stiff = self.rho0 * self.c0**2
        p = where(v > 0, v * stiff / (d * d), v * stiff / (1.0 - v))
        return p, where(v > 0, p * v / (2 * self.rho0), 0.0) + self.e0

    def sound_speed_squared(self, rho, p):
        v, g = self._strain(rho), self.gruneisen(rho)
        p0, _ = self.reference(rho)
        excess = (p - p0) / (g * rho)
        d = 1.0 - self._slope(v) * v
        safe = where(v > 0, v, 1.0)
        rise = where(v > 0, p0 * self.rho0 * (-1.0 / safe - self._slope_rise(v) * 2.0 / d), rho * rho * -(self.c0**2))
        shift = where(v > 0, p0 * (-1.0 - v * self._slope_rise(v) / d), 0.0)
        by_volume = rise + (self.rho0 * (self.Gamma0 - self.b) - g * rho) * excess * rho - g * rho * shift
        return (p * g * rho - by_volume) / (rho * rho)

    def pressure_slope(self, rho, e):
        """dp/drho at constant specific energy, from the formulas above on both branches."""
        v, g = self._strain(rho), self.gruneisen(rho)
        dv = self.rho0 / (rho * rho)
        p0, e0 = self.reference(rho)
        d = 1.0 - self._slope(v) * v
        dp = where(v > 0, dv * (self.rho0 * self.c0**2) / (d * d) * (1.0 + v * self._slope_rise(v) * 2.0 / d), rho * 0.0 + self.c0**2)
        de = where(v > 0, (dv * p0 + v * dp) / (2 * self.rho0), 0.0)
        return dp + (g + rho * dv * (self.b - self.Gamma0)) * (e - e0) - rho * g * de


@dataclass(frozen=True)
class ShockWave2(MieGruneisen):
    """Linear Hugoniot slope and a power law for the Gruneisen parameter."""

    Gamma0: float = 2.0
    rho0: float = 1.0
    c0: float = 2.0
    s: float = 1.2
    alpha: float = 1.0
    p0: float = 0.0
    e0: float = 0.0

    def gruneisen(self, rho):
        return power(self.rho0 / rho, self.alpha) * self.Gamma0

    def _curve(self, rho):
        v = 1.0 - self.rho0 / rho
        d = 1.0 - v * self.s
        return v, d, v * (self.rho0 * self.c0**2) / (d * d)

    def reference(self, rho):
        v, _, p = self._curve(rho)
        return p + self.p0, (p + 2 * self.p0) * v / (2 * self.rho0) + self.e0

    def sound_speed_squared(self, rho, p):
        v, d, curve = self._curve(rho)
        g, (p0, _) = self.gruneisen(rho), self.reference(rho)
        rise = (self.rho0 * self.c0) ** 2 / (rho * rho * d * d)
        return (g + (1 - self.alpha)) * (p - p0) / rho + g * p0 / rho + rise - g * rho * ((curve + self.p0) / (rho * rho))


@dataclass(frozen=True)
class TwoGasMixture:
    """Two ideal or stiffened gases at one pressure; phi is the first one's volume fraction."""

    first: StiffenedGas
    second: StiffenedGas
    small_p: float = 1e-10

    def inverse(self, phi):
        return phi / (self.first.gamma - 1) + (1.0 - phi) / (self.second.gamma - 1)

    def stiffness(self, phi):
        part = lambda g: g.gamma * g.p_inf / (g.gamma - 1)
        return (phi * part(self.first) + (1.0 - phi) * part(self.second)) / self.inverse(phi)

    def pressure(self, rho, e, phi):
        return greatest(rho * e / self.inverse(phi) - self.stiffness(phi), self.small_p)

    def energy_specific(self, rho, p, phi):
        return (p + self.stiffness(phi)) * self.inverse(phi) / rho

    def sound_speed(self, rho, p, phi):
        return sqrt((p * (1.0 + 1.0 / self.inverse(phi)) + self.stiffness(phi)) / rho)


@dataclass(frozen=True)
class GruneisenMixture:
    """Any number of Mie-Gruneisen materials: alphas are volume fractions, parts are partial densities."""

    materials: tuple[MieGruneisen, ...]
    small_p: float = 1e-10

    def _sum(self, alphas, parts, term):
        out = None
        for m, a, r in zip(self.materials, alphas, parts, strict=True):
            there = a > LOW_ALPHA
            rho = where(there, r / where(there, a, 1.0), 1.0)
            value = where(there, term(m, a, r, rho), 0.0)
            out = value if out is None else out + value
        return out

    def gruneisen(self, alphas, parts):
        return 1.0 / self._sum(alphas, parts, lambda m, a, r, rho: a / m.gruneisen(rho))

    def pressure(self, rho, e, alphas, parts):
        cold = self._sum(alphas, parts, lambda m, a, r, d: r * m.reference(d)[1] - a * m.reference(d)[0] / m.gruneisen(d))
        return greatest(self.gruneisen(alphas, parts) * (rho * e - cold), self.small_p)

    def energy(self, p, alphas, parts):
        return self._sum(alphas, parts, lambda m, a, r, d: r * m.reference(d)[1] + a * (p - m.reference(d)[0]) / m.gruneisen(d))

    def sound_speed_squared(self, rho, p, alphas, parts):
        """Mass- and Gruneisen-weighted mean of the materials' speeds."""
        weighted = self._sum(alphas, parts, lambda m, a, r, d: r * m.sound_speed_squared(d, p) / m.gruneisen(d))
        return self.gruneisen(alphas, parts) * weighted / rho


def named(kind: str, **parameters) -> Eos:
    """The equation of state of a configuration's name."""
    kinds = {"ideal_gas": IdealGas, "stiffened_gas": StiffenedGas, "van_der_waals": VanDerWaals, "cochran_chan": CochranChan, "jwl": JonesWilkinsLee, "shock_wave": ShockWave, "shock_wave2": ShockWave2}
    if kind.lower() not in kinds:
        raise ValueError(f"unknown equation of state {kind!r}; known: {', '.join(sorted(kinds))}")
    return kinds[kind.lower()](**parameters)


def by_material(eos: dict[int, Eos], material, method: str, *arguments):
    """Dispatch on a material id column: the method of each material's equation of state."""
    out = None
    for i, e in sorted(eos.items(), reverse=True):
        value = getattr(e, method)(*arguments)
        out = value if out is None else where(material == i, value, out)
    return out
