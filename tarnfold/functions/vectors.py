"""Column expressions over embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return _dot(a, b)


def norm(v: Column) -> Column:
    return F.sqrt(_dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for null, different lengths or a zero vector."""
    size = norm(a) * norm(b)
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0)
    return F.when(F.coalesce(ok, F.lit(False)), _dot(a, b) / size).otherwise(F.lit(0.0))


def normalize(v: Column) -> Column:
    """Unit length in single precision (the factor is rounded first); a zero vector stays."""

    def scaled(a: Column) -> Column:
        return let(
            norm(a), lambda s: F.when(s > 0, F.transform(a, lambda x: (x * (F.lit(1.0) / s).cast("float")).cast("float"))).otherwise(a)
        )

    return let(v, scaled)


def mock_embedding(text: Column, dim: int = DIM) -> Column:
    """A deterministic unit vector of a text: 16 bits of a hash per dimension (up to 256)."""
    if not 0 < dim <= 256:
        raise ValueError("the mock embedding has 1 to 256 dimensions")

    def entry(j: Column) -> Column:
        u = F.conv(F.substring(F.sha2(F.concat(text, F.lit("#"), F.char(j)), 256), 1, 4), 16, 10).cast("int")
        # 16 bits with a sign: beyond 32767 the numbers are negative.
        return ((F.pmod(u + 32768, F.lit(65536)) - 32768) / F.lit(32768.0)).cast("float")

    return normalize(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), entry))


def cache_key(model: Column | str, text: Column) -> Column:
    """The key of a text's embedding by a model."""
    name = F.lit(model) if isinstance(model, str) else model
    return F.sha2(F.concat(name, F.lit("\x00"), text), 256)
