"""Ordination and networks of a group's distance matrix (bounded by the member sample)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InputError
from ..schemas import KEY

#: Members of a matrix at most.
MOST_MEMBERS = 500


def matrix(rows: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """The complete symmetric matrix of pair rows; anything missing, double or negative is an error."""
    ids = sorted(set(rows["member_a"]) | set(rows["member_b"]))
    n, at = len(ids), {m: i for i, m in enumerate(ids)}
    if n > MOST_MEMBERS:
        raise InputError(f"{n} members; a matrix takes {MOST_MEMBERS}")
    out = np.full((n, n), np.nan)
    np.fill_diagonal(out, 0.0)
    for a, b, d in rows[["member_a", "member_b", "distance"]].itertuples(index=False):
        i, j = at[a], at[b]
        if i == j or not math.isnan(out[i, j]) or not math.isfinite(d) or d < 0:
            raise InputError(f"the pair {a}, {b} is double or has no proper distance")
        out[i, j] = out[j, i] = d
    if np.isnan(out).any():
        raise InputError("the matrix is not complete")
    return ids, out


def ordinate(d: np.ndarray, axes: int = 3) -> tuple[np.ndarray, list[float], float]:
    """Principal coordinates, each axis' share of positive inertia, and the negative share.

    An axis points so that its largest coordinate is positive.
    """
    n = len(d)
    centre = np.eye(n) - 1.0 / n
    values, vectors = np.linalg.eigh(-0.5 * centre @ (d * d) @ centre)
    values, vectors = values[::-1], vectors[:, ::-1]
    least = max(float(np.abs(values).max(initial=0.0)), 1.0) * 1e-12
    keep = np.flatnonzero(values > least)[:axes]
    if not len(keep):
        raise InputError("no axis has positive inertia")
    points = np.zeros((n, axes))
    for k, e in enumerate(keep):
        axis = vectors[:, e] * math.sqrt(values[e])
        points[:, k] = axis if axis[np.argmax(np.abs(axis))] >= 0 else -axis
    whole = values[values > least].sum()
    lost = np.abs(values[values < -least]).sum() / max(np.abs(values).sum(), 1e-300)
    return points, [float(values[e] / whole) for e in keep] + [0.0] * (axes - len(keep)), float(lost)


def fit(exact: np.ndarray, points: np.ndarray) -> tuple[float, float | None]:
    """Normalised stress and correlation of a projection's distances with the exact ones."""
    up = np.triu_indices(len(exact), 1)
    x, y = exact[up], np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1))[up]
    stress = math.sqrt(((x - y) ** 2).sum() / max((x * x).sum(), 1e-300))
    return stress, float(np.corrcoef(x, y)[0, 1]) if x.std() > 0 and y.std() > 0 else None


def quality(retained: float, correlation: float | None, stress: float) -> str:
    """A word for how far a two-axis picture can be trusted."""
    if retained < 0.5 or correlation is None or correlation < 0.7 or stress > 0.3:
        return "POOR"
    return "BETTER" if retained >= 0.75 and correlation >= 0.9 and stress <= 0.15 else "MODERATE"


def pcoa(pairs: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Three coordinates of each member and its group's fit, a group a task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, d = matrix(rows)
        points, shares, lost = ordinate(d)
        s2, c2 = fit(d, points[:, :2])
        s3, c3 = fit(d, points)
        out = pd.DataFrame({"member": ids, "axis_1": points[:, 0], "axis_2": points[:, 1], "axis_3": points[:, 2]})
        for k, v in zip(
            ("share_1", "share_2", "share_3", "negative_share", "stress_2d", "stress_3d", "correlation_2d", "correlation_3d"),
            (*shares, lost, s2, s3, c2, c3), strict=True
        ):
            out[k] = v
        out["projection_quality"] = quality(shares[0] + shares[1], c2, s2)
        for k in reversed(keys):
            out.insert(0, k, rows[k].iloc[0])
        return out

    numbers = ", ".join(
        f"{c} double" for c in (
            "axis_1", "axis_2", "axis_3", "share_1", "share_2", "share_3", "negative_share", "stress_2d", "stress_3d", "correlation_2d",
            "correlation_3d"
        )
    )
    kinds = dict(pairs.dtypes)
    return pairs.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", member string, {numbers}, projection_quality string")


def shepard(pairs: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Of each pair the exact distance and that of its points in two and three axes."""
    axes = ("axis_1", "axis_2", "axis_3")
    rows = pairs.select(*keys, F.col("member_a").cast("string").alias("member_a"), F.col("member_b").cast("string").alias("member_b"), "distance")
    points = pcoa(rows, keys).select(*keys, "member", *axes)
    for end in "ab":
        named = points.select(*keys, F.col("member").alias(f"member_{end}"), *[F.col(c).alias(f"{c}_{end}") for c in axes])
        rows = rows.join(named, [*keys, f"member_{end}"])
    square = [F.pow(F.col(f"{c}_a") - F.col(f"{c}_b"), 2) for c in axes]
    return rows.select(
        *keys, "member_a", "member_b", "distance", F.sqrt(square[0] + square[1]).alias("distance_2d"),
        F.sqrt(square[0] + square[1] + square[2]).alias("distance_3d")
    )


def connected_network(pairs: DataFrame, k: int, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Nearest-neighbour edges of each group and the shortest connectors that join its parts."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        edges = sorted(rows[["distance", "member_a", "member_b"]].itertuples(index=False, name=None))
        near: dict[str, list[tuple[float, str, str, str]]] = {}
        for d, a, b in edges:
            near.setdefault(a, []).append((d, b, a, b))
            near.setdefault(b, []).append((d, a, a, b))
        kept = {(d, a, b) for own in near.values() for d, _, a, b in sorted(own)[:k]}
        root = {m: m for m in near}

        def find(m: str) -> str:
            while root[m] != m:
                root[m] = root[root[m]]
                m = root[m]
            return m

        out = []
        for is_near in (True, False):
            for d, a, b in edges:
                if ((d, a, b) in kept) == is_near:
                    x, y = find(a), find(b)
                    if is_near or x != y:
                        out.append((a, b, d, "NEAREST_NEIGHBOUR" if is_near else "COMPONENT_CONNECTOR"))
                    root[max(x, y)] = min(x, y)
        found = pd.DataFrame(out, columns=["member_a", "member_b", "distance", "edge_type"])
        for c in reversed(keys):
            found.insert(0, c, rows[c].iloc[0])
        return found

    kinds = dict(pairs.dtypes)
    return pairs.groupBy(*keys).applyInPandas(
        run, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", member_a string, member_b string, distance double, edge_type string"
    )
