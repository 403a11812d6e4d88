"""Purpose-keyed randomness: a draw depends on (seed, purpose, row key) and nothing else.

Two families. ``uniform`` uses xxhash64. ``lcg_uniform`` uses a multiplicative hash in plain
integer arithmetic, for places where another SQL engine has to reproduce the draw.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: multiplier, increment and modulus of the arithmetic draw
MULTIPLIER, INCREMENT, MODULUS = 1103515245, 12345, 2147483648


def purpose_number(seed: int, purpose: str) -> int:
    """A stable integer for (seed, purpose), the same in every engine."""
    import zlib

    return (seed * 1_000_003 + zlib.crc32(purpose.encode())) % MODULUS


def uniform(seed: int, purpose: str, *keys: Column) -> Column:
    """Uniform in [0, 1) with 53 bits."""
    h = F.xxhash64(F.lit(int(seed)), F.lit(purpose), *keys)
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(2**53))


def normal(seed: int, purpose: str, *keys: Column) -> Column:
    """Standard normal by Box and Muller from two independent uniforms."""
    u1 = F.greatest(uniform(seed, purpose + "/r", *keys), F.lit(2.0**-53))
    u2 = uniform(seed, purpose + "/a", *keys)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def lcg_draw(seed: int, purpose: str, key: Column) -> Column:
    """Integer in [0, 2^31) from an integer key by three rounds of the arithmetic hash."""
    x = F.pmod(key.cast("bigint") + F.lit(purpose_number(seed, purpose)), F.lit(MODULUS))
    for _ in range(3):
        x = F.pmod(x * F.lit(MULTIPLIER) + F.lit(INCREMENT), F.lit(MODULUS))
        x = F.pmod(x + F.shiftright(x, 13), F.lit(MODULUS))
    return x


def lcg_uniform(seed: int, purpose: str, key: Column) -> Column:
    return lcg_draw(seed, purpose, key).cast("double") / F.lit(float(MODULUS))


def lcg_draw_sql(seed: int, purpose: str, key: str) -> str:
    """The same draw as SQL text."""
    x = f"(({key}) + {purpose_number(seed, purpose)}) % {MODULUS}"
    for _ in range(3):
        x = f"(({x}) * {MULTIPLIER} + {INCREMENT}) % {MODULUS}"
        x = f"(({x}) + (({x}) >> 13)) % {MODULUS}"
    return f"({x})"


#: a draw for (purpose, keys) that can be ordered by; equal keys draw alike
Draw = Callable[..., Column]


def hashed(seed: int) -> Draw:
    """53 bits from a hash of keys of any type."""
    return lambda purpose, *keys: uniform(seed, purpose, *keys)


def arithmetic(seed: int) -> Draw:
    """31 bits from integer keys below 2^31 that another SQL engine can repeat."""

    def draw(purpose: str, *keys: Column) -> Column:
        key = keys[0]
        for more in keys[1:]:
            key = key * 1009 + more
        return lcg_draw(seed, purpose, key)

    return draw
