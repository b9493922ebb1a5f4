"""Batch dense-network scoring (M1-M4, T3): the stress scorer over a feature-vector column.

The networks are tiny (30->50->30->24->12 encoder, 12->12->8->5->5 head), so their weights are shipped with the
task closure (a fixed, bounded size) and every Arrow batch is scored with two NumPy matmuls per layer inside
``mapInPandas``: one Python call per batch, never per row. Weight files of the reference are not part of it;
weights are an argument (tests use seeded ones).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------------------
# Fixed layer sizes of the reference networks.
# ---------------------------------------------------------------------------------------------------------
ENCODER_SIZES = (30, 50, 30, 24, 12)
HEAD_SIZES = (12, 12, 8, 5, 5)
DECODER_SIZES = (12, 24, 30, 50, 30)
# ---------------------------------------------------------------------------------------------------------

Layer = tuple[np.ndarray, np.ndarray]  # (weights out x in, bias out)


def seeded_layers(sizes: Sequence[int], seed: int) -> list[Layer]:
    """Deterministic test weights: multiples of 1/8 in [-0.25, 0.25], biases multiples of 1/256 (exact in
    binary, so SQL oracles agree)."""
    rng = np.random.default_rng(seed)
    layers = []
    for n_in, n_out in zip(sizes[:-1], sizes[1:]):
        w = rng.integers(-2, 3, size=(n_out, n_in)).astype(np.float64) / 8.0
        b = rng.integers(-2, 3, size=n_out).astype(np.float64) / 256.0
        layers.append((w, b))
    return layers


def forward(x: np.ndarray, layers: Sequence[Layer], last: str = "none") -> np.ndarray:
    """ReLU between layers; ``last`` in none / sigmoid after the final layer."""
    h = x
    for i, (w, b) in enumerate(layers):
        h = h @ w.T + b
        if i < len(layers) - 1:
            h = np.maximum(h, 0.0)
    if last == "sigmoid":
        h = 1.0 / (1.0 + np.exp(-h))
    return h


def score_stress(
    df: DataFrame,
    features_col: str | dict[str, str],
    encoder: Sequence[Layer],
    head: Sequence[Layer],
    keep: Sequence[str],
    out: str = "stress_level",
) -> DataFrame:
    """``argmax(head(encoder(x)))`` per row as an int (first index on ties); NULL where x has NULLs.

    ``features_col`` may map several output names to feature columns; all are scored in the same Python pass.
    """
    keep = list(keep)
    targets = {out: features_col} if isinstance(features_col, str) else dict(features_col)
    inputs = list(dict.fromkeys(targets.values()))
    schema = ", ".join(f"{n} {t}" for n, t in df.select(*keep).dtypes)
    schema += "".join(f", {o} int" for o in targets)
    enc = [(w.copy(), b.copy()) for w, b in encoder]
    hd = [(w.copy(), b.copy()) for w, b in head]
    n_in = enc[0][0].shape[1]

    def level(vals: pd.Series) -> np.ndarray:
        ok = vals.map(lambda v: v is not None and len(v) == n_in and not pd.isna(v).any()).to_numpy()
        res = pd.Series(pd.array([None] * len(vals), dtype="Int32"))
        if ok.any():
            x = np.stack([np.asarray(v, dtype=np.float64) for v in vals[ok]])
            probs = forward(forward(x, enc, "none"), hd, "sigmoid")
            res[ok] = np.argmax(probs, axis=1).astype(np.int32)
        return res.to_numpy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            outp = pdf[keep].copy()
            for o, col in targets.items():
                outp[o] = level(pdf[col].reset_index(drop=True))
            yield outp

    return df.select(*keep, *[c for c in inputs if c not in keep]).mapInPandas(run, schema)


def reconstruct(
    df: DataFrame, features_col: str, encoder: Sequence[Layer], decoder: Sequence[Layer], keep: Sequence[str],
    out: str = "reconstruction",
) -> DataFrame:
    """M4: decoder(encoder(x)) as ``array<double>``."""
    keep = list(keep)
    schema = ", ".join(f"{n} {t}" for n, t in df.select(*keep).dtypes) + f", {out} array<double>"
    enc = [(w.copy(), b.copy()) for w, b in encoder]
    dec = [(w.copy(), b.copy()) for w, b in decoder]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            width = enc[0][0].shape[1]
            good = [i for i, v in enumerate(pdf[features_col]) if v is not None and len(v) == width
                    and not np.isnan(np.asarray(v, dtype=np.float64)).any()]
            found: list = [None] * len(pdf)  # a vector that is NULL, of another width or with a NULL has none
            if good:
                x = np.stack([np.asarray(pdf[features_col].iloc[i], dtype=np.float64) for i in good])
                for i, y in zip(good, forward(forward(x, enc, "none"), dec, "none")):
                    found[i] = y
            outp = pdf[keep].copy()
            outp[out] = pd.Series(found, index=outp.index, dtype=object)
            yield outp

    return df.select(*keep, *([] if features_col in keep else [features_col])).mapInPandas(run, schema)


def layers_sql(src: str, keys: Sequence[str], x: str, layers: Sequence[Layer], last: str = "none",
               prefix: str = "layer") -> tuple[list[str], str]:
    """The same network as a chain of DuckDB CTEs, one per layer (oracle side).

    Returns ``(ctes, last_cte_name)``; every CTE has the key columns and the activation list ``h``.
    """
    k = ", ".join(keys)
    ctes = [f"{prefix}0 AS (SELECT {k}, {x} AS h FROM {src})"]
    for i, (w, b) in enumerate(layers):
        rows = "[" + ", ".join("[" + ", ".join(repr(float(v)) for v in r) + "]" for r in w) + "]"
        bias = "[" + ", ".join(repr(float(v)) for v in b) + "]"
        z = f"list_dot_product(h, w) + ({bias})[j]"
        if i < len(layers) - 1:
            act = f"greatest(0.0, {z})"
        elif last == "sigmoid":
            act = f"1.0 / (1.0 + exp(-({z})))"
        else:
            act = z
        ctes.append(f"{prefix}{i + 1} AS (SELECT {k}, list_transform({rows}, lambda w, j: {act}) AS h FROM {prefix}{i})")
    return ctes, f"{prefix}{len(layers)}"
