"""Column expressions over run metadata: identifiers, codes, controlled-vocabulary parameters, scans, ions and tolerances.

Nothing here needs a session. NULL stands for "unknown" everywhere; NaN is turned into NULL where values enter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

PARAM = "struct<name: string, accession: string, value: struct<integer: bigint, float: double, string: string, boolean: boolean>, unit: string>"

# Terms of the public controlled vocabularies and the keys of native identifiers, in order of priority.
ID_KEYS = ("scan", "scanId", "frame", "cycle", "scan_number", "index", "spectrum")
DISSOCIATION_METHODS = ("MS:1000133", "MS:1000422", "MS:1000598", "MS:1000250", "MS:1000262", "MS:1000435", "MS:1000044", "MS:1002631", "MS:1002678", "MS:1003181")
ION_MOBILITY = ("MS:1002476", "MS:1002477", "MS:1002478", "MS:1002814", "MS:1002816", "MS:1003006", "MS:1003007", "MS:1003153", "MS:1003155", "MS:1003156")
COLLISION_ENERGY, PROFILE, CENTROID = "MS:1000045", "MS:1000128", "MS:1000127"
POSITION_X, POSITION_Y = "IMS:1000050", "IMS:1000051"
CHROMATOGRAM_TYPES = {"MS:1000235": "total ion current", "MS:1000628": "basepeak chromatogram", "MS:1000812": "absorption chromatogram", "MS:1000810": "ion current chromatogram"}
COMPONENTS = {"ION_SOURCE": ("ionsource", "ion_source", "source"), "ANALYZER": ("analyzer", "mass_analyzer"), "DETECTOR": ("detector",)}
PROTON = 1.007276466812


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The number, or NULL if it is NaN or infinite."""
    c = _col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


# ---- identifiers and codes ----


def scan_number(native_id: Column | str) -> Column:
    """The number in a native identifier: of the first key of ID_KEYS that is there; NULL if it is no INT, even if another key's is."""
    found = [F.nullif(F.regexp_extract(_col(native_id), rf"(?:^|\s){key}=(\d+)", 1), F.lit("")) for key in ID_KEYS]
    return F.coalesce(*found).try_cast("int")


def polarity(code: Column | str) -> Column:
    c = _col(code)
    return F.when(c > 0, "POSITIVE").when(c < 0, "NEGATIVE").otherwise("UNKNOWN")


def continuity(term: Column | str) -> Column:
    c = F.trim(_col(term))
    return F.when(c == PROFILE, "PROFILE").when(c == CENTROID, "CENTROID").otherwise("UNKNOWN")


def is_msn(ms_level: Column | str) -> Column:
    return F.coalesce(_col(ms_level), F.lit(0)) > 1


def chromatogram_type_name(term: Column | str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in CHROMATOGRAM_TYPES.items() for x in kv])[_col(term)], F.lit("?"))


def component_type(name: Column | str) -> Column:
    c, out = F.lower(_col(name)), None
    for kind, names in COMPONENTS.items():
        out = (F if out is None else out).when(c.isin(*names), kind)
    return out.otherwise("UNKNOWN")


def mh_plus(mz: Column | str, charge: Column | str, default_charge: int = 2) -> Column:
    """The singly charged mass of an ion; an unknown charge is taken to be the default."""
    z = F.coalesce(_col(charge), F.lit(default_charge))
    return _col(mz) * z - (z - 1) * PROTON


# ---- parameters ----


def first_of(items: Column | str) -> Column:
    """The first element of an array, or NULL."""
    return F.try_element_at(_col(items), F.lit(1))


primary = first_of


def find_param(params: Column | str, accession: str) -> Column:
    """The first parameter with the accession, or NULL."""
    return first_of(F.filter(_col(params), lambda p: p["accession"] == accession))


def has_param(params: Column | str, accession: str) -> Column:
    return F.coalesce(F.exists(_col(params), lambda p: F.coalesce(p["accession"] == accession, F.lit(False))), F.lit(False))


def param_number(param: Column) -> Column:
    """A parameter's value if it is a number, as double."""
    return F.coalesce(param["value"]["integer"].cast("double"), param["value"]["float"])


def param_double(param: Column, default: float) -> Column:
    return F.coalesce(param_number(param), F.lit(float(default)))


def param_text(param: Column) -> Column:
    """A parameter's value for display: the first arm that is set."""
    v = param["value"]
    return F.coalesce(v["integer"].cast("string"), v["float"].cast("string"), v["string"], v["boolean"].cast("string"))


def display_name(params: Column | str, ident: Column | str) -> Column:
    """The first name among the parameters that isn't blank, else the identifier."""
    return F.coalesce(first_of(F.filter(_col(params), lambda p: F.trim(p["name"]) != ""))["name"], _col(ident))


# ---- activation ----


def activation_methods(params: Column | str) -> Column:
    return F.filter(_col(params), lambda p: p["accession"].isin(*DISSOCIATION_METHODS))


def collision_energy(params: Column | str) -> Column:
    """The first collision-energy parameter's value, if it is a finite number."""
    return finite(param_number(find_param(params, COLLISION_ENERGY)))


def activation_summary(params: Column | str) -> Column:
    """"CID + HCD @ 35.0 eV"; "custom" if no method is among the parameters, "(none)" if there are none."""
    params = F.coalesce(_col(params), F.array().cast(f"array<{PARAM}>"))
    methods = activation_methods(params)
    names = F.when(F.size(methods) == 0, "custom").otherwise(F.array_join(F.transform(methods, lambda p: F.coalesce(p["name"], p["accession"])), " + "))
    energy = collision_energy(params)
    return F.when(F.size(params) == 0, "(none)").otherwise(F.concat(names, F.when(energy.isNotNull(), F.format_string(" @ %.1f eV", energy)).otherwise("")))


# ---- scans and ions ----


def _by_priority(params: Column, keep) -> Column:
    """The parameter with an ion-mobility accession that stands first in ION_MOBILITY, among those that keep() accepts."""
    order = F.array(*map(F.lit, ION_MOBILITY))
    ranked = F.transform(F.filter(params, lambda p: p["accession"].isin(*ION_MOBILITY) & keep(p)), lambda p, i: F.struct(F.array_position(order, p["accession"]).alias("place"), i.alias("at"), p["accession"].alias("accession"), param_number(p).alias("number")))
    return F.array_min(ranked)


def ion_mobility_value(params: Column | str) -> Column:
    """Of a scan: by the accessions' priority, the first finite number."""
    return _by_priority(_col(params), lambda p: finite(param_number(p)).isNotNull())["number"]


def ion_mobility_type(params: Column | str) -> Column:
    """Of a scan: the accession of highest priority, whatever its value."""
    return _by_priority(_col(params), lambda p: F.lit(True))["accession"]


def ion_mobility_of_ion(params: Column | str) -> Column:
    """Of a selected ion: the first finite number in the parameters' own order."""
    return finite(param_number(first_of(F.filter(_col(params), lambda p: p["accession"].isin(*ION_MOBILITY) & finite(param_number(p)).isNotNull()))))


def imaging_position(params: Column | str) -> Column:
    """struct(x, y), or NULL unless both are numbers."""
    x, y = (param_number(find_param(params, a)).cast("int") for a in (POSITION_X, POSITION_Y))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def is_valid_position(position: Column | str) -> Column:
    p = _col(position)
    return F.coalesce((p["x"] > 0) & (p["y"] > 0), F.lit(False))


def _param(name: str, accession: Column, integer: Column | None = None, number: Column | None = None) -> Column:
    value = F.struct((F.lit(None) if integer is None else integer).cast("bigint").alias("integer"), (F.lit(None) if number is None else number).cast("double").alias("float"), F.lit(None).cast("string").alias("string"), F.lit(None).cast("boolean").alias("boolean"))
    return F.struct(F.lit(name).alias("name"), accession.cast("string").alias("accession"), value.alias("value"), F.lit(None).cast("string").alias("unit"))


def with_typed_columns(params: Column | str, mobility: Column, mobility_type: Column, x: Column, y: Column) -> Column:
    """A scan's parameters and, where they lack them, parameters made of its typed columns."""
    params = F.coalesce(_col(params), F.array().cast(f"array<{PARAM}>"))
    any_mobility = F.exists(params, lambda p: F.coalesce(p["accession"].isin(*ION_MOBILITY), F.lit(False)))
    kind = F.coalesce(F.nullif(F.trim(mobility_type), F.lit("")), F.lit(ION_MOBILITY[0]))
    more = F.array(
        F.when(~any_mobility & finite(mobility).isNotNull(), _param("ion mobility value", kind, number=mobility)),
        F.when(~has_param(params, POSITION_X) & x.isNotNull(), _param("position x", F.lit(POSITION_X), integer=x)),
        F.when(~has_param(params, POSITION_Y) & y.isNotNull(), _param("position y", F.lit(POSITION_Y), integer=y)),
    )
    return F.concat(params, F.filter(more, lambda p: p.isNotNull()))


def scan_windows(windows: Column | str, lower: str, upper: str) -> Column:
    """Windows (lower, upper) that have both limits."""
    return F.filter(F.transform(_col(windows), lambda w: F.struct(w[lower].cast("double").alias("lower"), w[upper].cast("double").alias("upper"))), lambda w: w["lower"].isNotNull() & w["upper"].isNotNull())


def setting_number(params: Column | str, accession: str, kind: str) -> Column:
    """Of scan settings: the first value with the accession that is, or can be read as, a number of the kind ("int" or "double")."""
    number = lambda p: F.coalesce(param_number(p).try_cast(kind), p["value"]["string"].try_cast(kind))
    return number(first_of(F.filter(_col(params), lambda p: (p["accession"] == accession) & number(p).isNotNull())))


# ---- windows and tolerances ----


def isolation_bounds(target: Column | str, lower_offset: Column | str, upper_offset: Column | str) -> Column:
    """struct(lower, upper); a bound is NULL if either part is."""
    t = _col(target)
    return F.struct((t - _col(lower_offset)).alias("lower"), (t + _col(upper_offset)).alias("upper"))


@dataclass(frozen=True)
class Tolerance:
    """A half-width in m/z: absolute (Da), or relative to the reference (ppm)."""

    value: float
    relative: bool

    def __post_init__(self):
        if not (math.isfinite(self.value) and self.value >= 0):
            raise ValueError("a tolerance is finite and not negative")

    def absolute_at(self, mz: Column | str | float) -> Column:
        mz = F.lit(mz) if isinstance(mz, (int, float)) else _col(mz)
        return F.abs(mz) * self.value / 1e6 if self.relative else F.lit(float(self.value))

    def bounds(self, mz: Column | str | float) -> Column:
        """struct(lo, hi), both inclusive."""
        at = F.lit(mz) if isinstance(mz, (int, float)) else _col(mz)
        return F.struct((at - self.absolute_at(mz)).alias("lo"), (at + self.absolute_at(mz)).alias("hi"))

    def test(self, query: Column | str, reference: Column | str) -> Column:
        return F.abs(_col(query) - _col(reference)) <= self.absolute_at(reference)

    def limits(self, mz: float) -> tuple[float, float]:
        """The bounds of one known target, as numbers: literals are pushed down to the scan."""
        d = abs(mz) * self.value / 1e6 if self.relative else self.value
        return mz - d, mz + d


def ppm(value: float) -> Tolerance:
    return Tolerance(value, True)


def da(value: float) -> Tolerance:
    return Tolerance(value, False)


def spectrum_filter(levels: list[int] | None = None, rt_min: float | None = None, rt_max: float | None = None, ms_level: str = "ms_level", rt: str = "rt") -> Column:
    """Spectra of the levels (none given: any) whose time lies within the inclusive bounds or is unknown."""
    keep = F.lit(True)
    if levels:
        keep = keep & F.coalesce(F.col(ms_level), F.lit(0)).isin(*levels)
    time = finite(rt)
    if rt_min is not None:
        keep = keep & (time.isNull() | (time >= rt_min))
    if rt_max is not None:
        keep = keep & (time.isNull() | (time <= rt_max))
    return keep
