"""Text keys, defaults and score arithmetic on plain columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def number(value: Column | str, default: float) -> Column:
    """Number from text; null, empty or unreadable becomes the default."""
    return F.coalesce(F.nullif(F.trim(_c(value).cast("string")), F.lit("")).try_cast("double"), F.lit(float(default)))


def opposite_target(target, assignment, jaw) -> Column:
    """True when a target was derived from the other jaw."""
    jaw, assignment = _c(jaw), F.coalesce(_c(assignment), F.lit(""))
    other = F.when(jaw == "upper", "lower").otherwise("upper")
    named = F.contains(_c(target), F.concat(F.lit("axial_"), other, F.lit("_")))
    explicit = assignment.isin("upper", "lower") & (assignment != jaw)
    return F.when(assignment != "", explicit).otherwise(F.coalesce(named, F.lit(False)))


def target_family(mode, target) -> Column:
    text = F.lower(F.concat_ws(" ", _c(mode), _c(target)))
    return F.when(F.contains(text, F.lit("adaptive")), "adaptive").when(
        F.contains(text, F.lit("aggregate")), "aggregate"
    ).otherwise("tracked")


def source_side(variant) -> Column:
    text = F.lower(F.coalesce(_c(variant), F.lit("")))
    return F.when(F.contains(text, F.lit("low")), "low").when(
        F.contains(text, F.lit("high")), "high"
    ).otherwise("full")


def threshold_bucket(threshold, width: int = 100) -> Column:
    """Nearest multiple of ``width``, halves to even."""
    return (F.bround(F.coalesce(_c(threshold), F.lit(0.0)) / float(width)) * width).cast("int")


def evidence_key(view, mode, target, threshold, variant) -> Column:
    return F.struct(
        _c(view).alias("view"),
        target_family(mode, target).alias("family"),
        threshold_bucket(threshold).alias("threshold"),
        source_side(variant).alias("side"),
    )


def quality(selection, fit, p90, coverage) -> list[Column]:
    """Ascending sort keys; missing values sort last, coverage ascends too."""
    return [
        F.coalesce(_c(selection), _c(fit), F.lit(INF)),
        F.coalesce(_c(fit), F.lit(INF)),
        F.coalesce(_c(p90), F.lit(INF)),
        F.coalesce(_c(coverage), F.lit(0.0)),
    ]


def to_target(value, mode: str) -> Column:
    value = _c(value)
    forms = {"log1p": F.log1p(value), "sqrt": F.sqrt(value), "identity": value}
    if mode not in forms:
        raise ValueError(f"unknown target form {mode}")
    return forms[mode]


def from_target(value, mode: str) -> Column:
    value = _c(value)
    floor = F.greatest(value, F.lit(0.0))
    forms = {"log1p": F.expm1(value), "sqrt": floor * floor, "identity": floor}
    if mode not in forms:
        raise ValueError(f"unknown target form {mode}")
    return forms[mode]


def first_reason(gates: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first gate that fails, null when all pass. A gate is the failing condition."""
    chain = None
    for name, failed in gates:
        hit = F.coalesce(failed, F.lit(False))
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain


def mapped(value, table: Mapping[str, object], default: object) -> Column:
    """Fixed text mapping with a default."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.get(F.array(F.create_map(*pairs)), F.lit(0))[_c(value)], F.lit(default))


# Template kind -> teacher, kind -> priority (lower is better).
TEACHER_OF_KIND = {
    "labeled": "exact_template", "exact": "exact_template", "geometry": "geometry_template",
    "threshold": "threshold_template",
}
PRIORITY_OF_KIND = {"labeled": 0, "exact": 1, "geometry": 2, "threshold": 3}


def clip_intensity(hu) -> Column:
    """Clip to -500..3000, shift by -500 and divide by 1000."""
    return (F.greatest(F.least(_c(hu), F.lit(3000.0)), F.lit(-500.0)) - 500.0) / 1000.0


def source_fraction(variant) -> Column:
    """0.25 from ``pca_low_0.25``; 1 when the last part is no number."""
    return F.coalesce(F.substring_index(_c(variant), "_", -1).try_cast("double"), F.lit(1.0))


def stable_seed(text, masked: bool = True) -> Column:
    """First four bytes of the SHA-256 of a text, little-endian."""
    digest = F.sha2(_c(text).cast("string"), 256)
    swapped = F.concat(*[F.substring(digest, start, 2) for start in (7, 5, 3, 1)])
    value = F.conv(swapped, 16, 10).cast("long")
    return value.bitwiseAND(F.lit(0x7FFFFFFF).cast("long")) if masked else value


def hash_draw(text, bound) -> Column:
    """Reproducible draw in 0..bound-1 from a text."""
    return F.pmod(F.conv(F.substring(F.sha2(_c(text), 256), 1, 8), 16, 10).cast("long"), _c(bound))


def hash_unit(text) -> Column:
    """Reproducible number in (0, 1) from a text."""
    return (F.conv(F.substring(F.sha2(_c(text), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def hash_normal(text) -> Column:
    """Reproducible standard normal number from a text (Box-Muller)."""
    text = _c(text)
    radius = F.sqrt(-2.0 * F.log(hash_unit(F.concat(text, F.lit("|r")))))
    return radius * F.cos(2.0 * 3.141592653589793 * hash_unit(F.concat(text, F.lit("|a"))))


def fold_number(label) -> Column:
    """The only integer token of a label; null when there is none or more than one."""
    tokens = F.filter(F.split(_c(label), "_"), lambda t: t.rlike("^[0-9]+$"))
    return F.when(F.size(tokens) == 1, tokens[0].cast("int"))


def show_number(value, digits: int = 3) -> Column:
    number_ = _c(value).try_cast("double") if not isinstance(value, str) else F.col(value).try_cast("double")
    bad = number_.isNull() | F.isnan(number_) | (F.abs(number_) == INF)
    return F.when(bad, F.lit("n/a")).otherwise(F.format_string(f"%.{digits}f", number_))


def model_label(alpha, digits: int = 3) -> Column:
    """0.575 -> a0p575, trailing zeros dropped."""
    text = F.regexp_replace(F.format_string(f"%.{digits}f", _c(alpha)), r"0+$", "")
    return F.concat(F.lit("a"), F.replace(F.regexp_replace(text, r"\.$", ""), F.lit("."), F.lit("p")))


def normal_path(path) -> Column:
    """Lower-case path with forward slashes, no doubled slash and no ``.`` parts."""
    text = F.regexp_replace(F.replace(_c(path), F.lit("\\"), F.lit("/")), r"/(\./)+", "/")
    text = F.regexp_replace(F.regexp_replace(text, r"/{2,}", "/"), r"(?<=.)/$", "")
    return F.lower(text)


def json_or(text, path: str, default: str) -> Column:
    return F.coalesce(F.get_json_object(_c(text), path), F.lit(default))


def config_key(**parts: Column) -> Column:
    """Canonical JSON of a configuration, keys in sorted order."""
    return F.to_json(F.struct(*[parts[name].alias(name) for name in sorted(parts)]))


def prediction_score(confidence, entropy, upper, lower, typical: float = 2200.0) -> Column:
    """Confidence less entropy and less the log distance of both sizes from the typical one."""
    sizes = sum(F.abs(F.log(F.greatest(_c(v), F.lit(1)) / typical)) for v in (upper, lower))
    return _c(confidence) - 0.35 * _c(entropy) - 0.08 * sizes


def agreement(value, limit, scale: float = 1.0) -> Column:
    """exp(-((value / limit / scale)^2) / 2)."""
    ratio = _c(value) / _c(limit) / F.lit(scale)
    return F.exp(-0.5 * ratio * ratio)


def consensus_confidence(disagreement, rank, source, p90, coverage) -> Column:
    """Geometric mean of five falling or saturating terms."""
    product = (
        F.exp(-_c(disagreement) / 2.0) * F.exp(-_c(rank) / 2.0) * F.exp(-_c(source) / 0.6)
        * F.exp(-_c(p90) / 2.0) * F.least(F.lit(1.0), _c(coverage) / 0.6)
    )
    return F.pow(product, F.lit(0.2))


def protocol_parity(nx, ny, nz, spacing) -> Column:
    """-1 for the one acquisition protocol whose exports are mirrored, else 1."""
    hit = (_c(nx) == 266) & (_c(ny) == 266) & (_c(nz) == 200) & (F.abs(_c(spacing) - 0.3) < 1e-6)
    return F.when(hit, -1).otherwise(1)
