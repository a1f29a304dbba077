"""Rigid 4x4 matrices as array<double> of 16, row-major, on plain columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LINEAR = (0, 1, 2, 4, 5, 6, 8, 9, 10)  # row-major slots of the 3x3 block
SHIFT = (3, 7, 11)


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(float(high))), F.lit(float(low)))


def linear(matrix: Column | str) -> list[Column]:
    m = _c(matrix)
    return [m[i] for i in LINEAR]


def shift(matrix: Column | str) -> list[Column]:
    m = _c(matrix)
    return [m[i] for i in SHIFT]


def norm(parts: Sequence[Column]) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def held(parts: Sequence[Column]) -> Column:
    """An array that is computed once and read by index.

    Reading entry i of a plain array constructor is folded back into the
    expression of that entry, so a chain of matrix products would grow
    exponentially and leave generated code; a slice keeps the steps apart.
    """
    return F.slice(F.array(*parts), 1, len(parts))


def from_parts(rows9: Sequence[Column], t: Sequence[Column]) -> Column:
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(*rows9[0:3], t[0], *rows9[3:6], t[1], *rows9[6:9], t[2], zero, zero, zero, one)


def apply_point(matrix: Column | str, x: Column, y: Column, z: Column) -> list[Column]:
    m = _c(matrix)
    return [m[r] * x + m[r + 1] * y + m[r + 2] * z + m[r + 3] for r in (0, 4, 8)]


def multiply3(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [
        a[3 * r] * b[c] + a[3 * r + 1] * b[3 + c] + a[3 * r + 2] * b[6 + c]
        for r in range(3)
        for c in range(3)
    ]


def transpose3(a: Sequence[Column]) -> list[Column]:
    return [a[3 * c + r] for r in range(3) for c in range(3)]


def compose(a: Column | str, b: Column | str) -> Column:
    """a @ b for affine matrices whose last row is 0 0 0 1."""
    left, right = _c(a), _c(b)
    rot = multiply3(linear(left), linear(right))
    moved = apply_point(left, *shift(right))
    return F.slice(from_parts(rot, moved), 1, 16)


def det3(r: Sequence[Column]) -> Column:
    return (
        r[0] * (r[4] * r[8] - r[5] * r[7])
        - r[1] * (r[3] * r[8] - r[5] * r[6])
        + r[2] * (r[3] * r[7] - r[4] * r[6])
    )


def det_sign(matrix: Column | str) -> Column:
    return F.signum(det3(linear(matrix))).cast("int")


def invert(matrix: Column | str) -> Column:
    r, t = linear(matrix), shift(matrix)
    d = det3(r)
    adjugate = [
        r[4] * r[8] - r[5] * r[7], r[2] * r[7] - r[1] * r[8], r[1] * r[5] - r[2] * r[4],
        r[5] * r[6] - r[3] * r[8], r[0] * r[8] - r[2] * r[6], r[2] * r[3] - r[0] * r[5],
        r[3] * r[7] - r[4] * r[6], r[1] * r[6] - r[0] * r[7], r[0] * r[4] - r[1] * r[3],
    ]
    inv = [a / d for a in adjugate]
    back = [-(inv[k] * t[0] + inv[k + 1] * t[1] + inv[k + 2] * t[2]) for k in (0, 3, 6)]
    return F.slice(from_parts(inv, back), 1, 16)


def proper_rotation(matrix: Column | str) -> list[Column]:
    """The 3x3 block with the first column negated when it holds a reflection."""
    r = linear(matrix)
    flip = F.when(det3(r) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return [r[i] * flip if i % 3 == 0 else r[i] for i in range(9)]


def trace_angle_deg(p: Sequence[Column], g: Sequence[Column]) -> Column:
    """Angle from the trace of P G^T, clipped; a parity mismatch is not special."""
    dot = sum((p[i] * g[i] for i in range(1, 9)), p[0] * g[0])
    return F.degrees(F.acos(clip((dot - 1.0) / 2.0, -1.0, 1.0)))


def rotation_error_deg(prediction: Column | str, truth: Column | str) -> Column:
    return trace_angle_deg(linear(prediction), linear(truth))


def translation_error(prediction: Column | str, truth: Column | str) -> Column:
    return norm([a - b for a, b in zip(shift(prediction), shift(truth))])


def geodesic_deg(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Angle between two proper rotations, precise near 0 and near 180 degrees."""
    rel = multiply3(transpose3(a), b)
    sine = norm([rel[7] - rel[5], rel[2] - rel[6], rel[3] - rel[1]])
    return F.degrees(F.atan2(sine, rel[0] + rel[4] + rel[8] - 1.0))


def frobenius_gap(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return norm([x - y for x, y in zip(a, b)])


def relative_linear_gap(prediction: Column | str, truth: Column | str) -> Column:
    rel = multiply3(linear(prediction), linear(invert(truth)))
    identity = [F.lit(1.0 if i in (0, 4, 8) else 0.0) for i in range(9)]
    return frobenius_gap(rel, identity)


def balanced_error(translation: Column, rotation: Column) -> Column:
    return 0.5 * (translation / 10.0 + rotation / 5.0)


def contract_violations(matrix: Column | str, tolerance: float = 2e-2) -> Column:
    """How many rules of the rigid-matrix contract a matrix breaks (0 = valid)."""
    m, r = _c(matrix), linear(matrix)
    gram = multiply3(transpose3(r), r)
    off = [F.abs(g - (1.0 if i in (0, 4, 8) else 0.0)) for i, g in enumerate(gram)]
    rules = [
        F.size(m) != 16,
        F.exists(m, lambda v: F.isnan(v) | v.isNull() | (F.abs(v) == float("inf"))),
        (m[12] != 0) | (m[13] != 0) | (m[14] != 0) | (m[15] != 1),
        F.greatest(*off) > tolerance,
        F.abs(F.abs(det3(r)) - 1.0) > tolerance,
    ]
    return sum((F.coalesce(rule, F.lit(True)).cast("int") for rule in rules[1:]),
               F.coalesce(rules[0], F.lit(True)).cast("int"))


def centred_start(rotation9: Sequence[Column], reflect: Column, source, target) -> Column:
    """Prior rotation (reflected when asked) that maps one centroid on the other."""
    flip = F.when(reflect, F.lit(-1.0)).otherwise(F.lit(1.0))
    r = [rotation9[i] * flip if i % 3 == 0 else rotation9[i] for i in range(9)]
    t = [
        target[k] - (r[3 * k] * source[0] + r[3 * k + 1] * source[1] + r[3 * k + 2] * source[2])
        for k in range(3)
    ]
    return from_parts(r, t)


def anchor_offsets(radius: float) -> list[tuple[float, float, float]]:
    out = [(0.0, 0.0, 0.0)]
    for axis in range(3):
        for sign in (1.0, -1.0):
            out.append(tuple(sign * radius if k == axis else 0.0 for k in range(3)))
    return out


def anchor_disagreement(a, b, centre: Sequence[Column], radius: float = 20.0) -> Column:
    """Mean distance of seven anchors (centre and +-radius per axis) under two matrices."""
    total = None
    for off in anchor_offsets(radius):
        at = [c + o for c, o in zip(centre, off)]
        gap = norm([p - q for p, q in zip(apply_point(a, *at), apply_point(b, *at))])
        total = gap if total is None else total + gap
    return total / 7.0


def pair_deviation(upper, lower, prior_rotation: Sequence[Column], prior_shift: Sequence[Column]):
    """Angle and distance of the relative upper/lower pose from the pair prior."""
    rel = multiply3(transpose3(proper_rotation(upper)), proper_rotation(lower))
    angle = geodesic_deg(prior_rotation, rel)
    gap = norm([u - l - p for u, l, p in zip(shift(upper), shift(lower), prior_shift)])
    return angle, gap


def joint_difference(upper, lower):
    """Angle and shift between two poses; infinite when their parity differs."""
    same = det_sign(upper) == det_sign(lower)
    rel = multiply3(transpose3(linear(upper)), linear(lower))
    cosine = clip((rel[0] + rel[4] + rel[8] - 1.0) / 2.0, -1.0, 1.0)
    far = F.lit(float("inf"))
    angle = F.when(same, F.degrees(F.acos(cosine))).otherwise(far)
    gap = F.when(same, norm([u - l for u, l in zip(shift(upper), shift(lower))])).otherwise(far)
    return angle, gap


def axis_angle_matrix(axis: Sequence[Column], angle: Column) -> list[Column]:
    """Rodrigues form of a rotation about a unit axis."""
    x, y, z = axis
    c, s = F.cos(angle), F.sin(angle)
    d = 1.0 - c
    return [
        c + x * x * d, x * y * d - z * s, x * z * d + y * s,
        y * x * d + z * s, c + y * y * d, y * z * d - x * s,
        z * x * d - y * s, z * y * d + x * s, c + z * z * d,
    ]


def encode_key(matrix: Column | str) -> Column:
    """16 comma-separated numbers with six decimals."""
    return F.array_join(F.transform(_c(matrix), lambda v: F.format_string("%.6f", v)), ",")


def decode_key(text: Column | str) -> Column:
    """Inverse of ``encode_key``; null for a wrong count or a non-finite number."""
    parts = F.transform(F.split(_c(text), ","), lambda p: F.trim(p).try_cast("double"))
    bad = F.exists(parts, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when((F.size(parts) == 16) & ~bad, parts)


def fingerprint(matrix: Column | str, digits: int) -> Column:
    """Rounded matrix, half to even, as a hashable text; -0.0 equals 0.0."""
    return F.array_join(
        F.transform(_c(matrix), lambda v: F.format_string(f"%.{digits}f", F.bround(v, digits) + F.lit(0.0))), ","
    )


def signed_permutations() -> list[list[int]]:
    """The 24 proper signed axis permutations, row-major 3x3."""
    from itertools import permutations, product

    out = []
    for order in permutations(range(3)):
        swaps = sum(order[i] > order[j] for i in range(3) for j in range(i + 1, 3))
        for signs in product((1, -1), repeat=3):
            if (-1) ** swaps * signs[0] * signs[1] * signs[2] == 1:
                rows = [0] * 9
                for row, col in enumerate(order):
                    rows[3 * row + col] = signs[row]
                out.append(rows)
    return out
