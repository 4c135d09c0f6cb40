"""INI configurations: case-insensitive names, typed getters with defaults, a table of rows."""

from __future__ import annotations

import configparser

from pyspark.sql import DataFrame, SparkSession


class Settings:
    def __init__(self, text: str = ""):
        self.values: dict[tuple[str, str], str] = {}
        parser = configparser.ConfigParser(strict=False, interpolation=None, inline_comment_prefixes=(";", "#"), delimiters=("=", ":"))
        parser.read_string(text)
        for section in parser.sections():
            for name, value in parser.items(section):
                self.values[section.lower(), name.lower()] = value

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Settings:
        """From any file that Spark's readers reach."""
        rows = spark.read.text(path, wholetext=True).collect()
        return cls("\n".join(r.value for r in rows))

    def text(self, section: str, name: str, default: str = "") -> str:
        return self.values.get((section.lower(), name.lower()), default)

    def number(self, section: str, name: str, default: float = 0.0) -> float:
        return float(self.text(section, name, str(default)))

    def integer(self, section: str, name: str, default: int = 0) -> int:
        return int(self.text(section, name, str(default)))

    def flag(self, section: str, name: str, default: bool = False) -> bool:
        found = self.text(section, name, str(default)).strip().lower()
        if found in ("1", "true", "yes", "on"):
            return True
        if found in ("0", "false", "no", "off"):
            return False
        raise ValueError(f"{section}.{name}: {found!r} is no truth value")

    def numbers(self, section: str, name: str, default: list[float] | None = None) -> list[float]:
        found = self.text(section, name)
        return [float(x) for x in found.replace(",", " ").split()] if found else list(default or [])

    def choice(self, section: str, name: str, allowed: tuple[str, ...], default: str) -> str:
        found = self.text(section, name, default).strip().lower()
        if found not in allowed:
            raise ValueError(f"{section}.{name}: {found!r} is none of {', '.join(allowed)}")
        return found

    def put(self, section: str, name: str, value) -> None:
        self.values[section.lower(), name.lower()] = str(value)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s, n, v) for (s, n), v in sorted(self.values.items())], "section string, name string, value string")


BORDERS = ("none", "periodic", "zero_gradient", "wall", "analytical", "custom")


def borders(settings: Settings, dim: int) -> dict[int, str]:
    """The border type of each face from boundary_type_xmin and so on: periodic where none is named, none where the name is unknown."""
    out = {}
    for d in range(dim):
        for side, end in enumerate(("min", "max")):
            named = settings.text("mesh", f"boundary_type_{'xyz'[d]}{end}", "periodic").strip().lower()
            out[2 * d + side] = named if named in BORDERS else "none"
    return out


def gravity(settings: Settings, dim: int) -> tuple[float, ...]:
    """The uniform gravity vector."""
    return tuple(settings.number("gravity", f"uniform_g{a}", 0.0) for a in "xyz"[:dim])


def mesh_config(settings: Settings):
    """The mesh section as a Config; boundary types other than periodic make an axis not periodic."""
    from ..operators.mesh import Config

    dim = settings.integer("mesh", "dim", 2)
    axes, types = "xyz"[:dim], borders(settings, dim)
    return Config(
        dim=dim,
        brick=tuple(settings.integer("mesh", f"nbrick_{a}", 1) for a in axes),
        periodic=tuple(settings.flag("mesh", f"periodic_{a}", True) and types[2 * d] == types[2 * d + 1] == "periodic" for d, a in enumerate(axes)),
        block=tuple(settings.integer("mesh", f"b{a}", 4) for a in axes),
        low=tuple(settings.number("mesh", f"{a}min", 0.0) for a in axes),
        scale=settings.number("mesh", "scaling_factor", 1.0),
        level_min=settings.integer("amr", "level_min", 0),
        level_max=settings.integer("amr", "level_max", 8),
    )
