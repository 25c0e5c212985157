"""Query perturbations on vectors and the random draws behind them.

A draw is a hash of (seed, purpose, id), so it does not depend on row order,
partitioning or engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

Draw = Callable[[str], Column]
Perturbation = Callable[[Column, Draw], Column]


def hash_unit(seed: int, purpose: str, key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def _between(u: Column, lo: float, hi: float) -> Column:
    return F.lit(lo) + F.lit(hi - lo) * u


def _each(vec: Column, params: dict[str, Column], fn: Callable[[Column, Column], Column]) -> Column:
    """Apply ``fn(x, params)`` to every component, with the parameters worked out once per row."""
    row = F.struct(*[c.alias(name) for name, c in params.items()])
    return F.zip_with(vec, F.array_repeat(row, F.size(vec)), fn)


def unchanged(vec: Column, draw: Draw) -> Column:
    return vec


def brightness(vec: Column, draw: Draw) -> Column:
    """Gamma curve, exponent 0.35 to 2.0, sign kept."""
    params = {"gamma": _between(draw("gamma"), 0.35, 2.0)}
    return _each(vec, params, lambda x, p: F.signum(x) * F.pow(F.abs(x), p["gamma"]))


def contrast(vec: Column, draw: Draw) -> Column:
    """Gain 0.5 to 1.6 and offset -50/255 to 50/255, clipped to [-1, 1]."""
    params = {
        "gain": _between(draw("gain"), 0.5, 1.6),
        "offset": (F.floor(draw("offset") * 101) - 50).cast("double") / 255.0,
    }
    low, high = F.lit(-1.0), F.lit(1.0)
    return _each(vec, params, lambda x, p: F.greatest(low, F.least(high, p["gain"] * x + p["offset"])))


def aged(vec: Column, draw: Draw) -> Column:
    """Gain 0.5 to 1.1, then pulled towards the mean by 0.6 to 0.9."""
    params = {
        "gain": _between(draw("fade"), 0.5, 1.1),
        "keep": _between(draw("squeeze"), 0.6, 0.9),
        "mean": F.aggregate(vec, F.lit(0.0), lambda s, x: s + x) / F.size(vec),
    }
    return _each(vec, params, lambda x, p: p["gain"] * ((x - p["mean"]) * p["keep"] + p["mean"]))


REAL: dict[str, Perturbation] = {"aged": aged, "brightness": brightness, "contrast": contrast}


def pick(u: Column, names: list[str]) -> Column:
    """One of ``names``, chosen by a number in [0, 1)."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.floor(u * len(names)).cast("int") + 1)


def any_of(perturbations: dict[str, Perturbation]) -> Perturbation:
    """One of the perturbations, chosen per row."""

    def run(vec: Column, draw: Draw) -> Column:
        out = vec
        chosen = pick(draw("choice"), list(perturbations)) if perturbations else F.lit("")
        for name, fn in perturbations.items():
            out = F.when(chosen == name, fn(vec, draw)).otherwise(out)
        return out

    return run


TRANSFORMS: dict[str, Perturbation] = {"none": unchanged, **REAL, "random": any_of(REAL)}


def registered(registry: dict[str, Perturbation] | None = None) -> dict[str, Perturbation]:
    """The given perturbations, or the built-in ones; ``random`` draws from those given unless it is one of them."""
    if registry is None:
        return TRANSFORMS
    return {"random": any_of({n: f for n, f in registry.items() if n not in ("none", "random")}), **registry}


def resolve(transform: str | list[str], registry: dict[str, Perturbation] | None = None) -> list[str]:
    """The names to run; ``all`` means every entry but ``none`` and ``random``, and an unknown name is an error."""
    known = registered(registry)
    if transform == "all":
        return [n for n in known if n not in ("none", "random")]
    names = [transform] if isinstance(transform, str) else list(transform)
    if unknown := [n for n in names if n not in known]:
        raise KeyError(f"unknown perturbations: {', '.join(unknown)}")
    return names


def perturb(
    df: DataFrame, transform: Column, registry: dict[str, Perturbation] | None = None, seed: int = 42
) -> DataFrame:
    """Replace ``vec`` by the perturbation named in ``transform``, drawing by ``id``; a name that is not known fails the job."""
    out = F.raise_error(F.concat(F.lit("unknown perturbation: "), F.coalesce(transform, F.lit("null")))).cast(df.schema["vec"].dataType)
    for name, fn in registered(registry).items():
        def draw(purpose: str, name: str = name) -> Column:
            return hash_unit(seed, f"{name}|{purpose}", F.col("id"))

        out = F.when(transform == name, fn(F.col("vec"), draw)).otherwise(out)
    return df.withColumn("vec", out)
