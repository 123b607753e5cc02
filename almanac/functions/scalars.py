"""Scalar column functions (inventory B) and month generators (F1)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from ..operators.patterns import micros

MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August",
               "September", "October", "November", "December")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- text -----------------------------------------------------------------------------


@F.pandas_udf(StringType())
def _nfkd(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKD")


def slug(c: Column | str, unicode: bool = True) -> Column:
    """B1: NFKD, runs of non-alphanumerics to one space, trimmed, lower case; null to ''.

    Accents become a space, as decomposed marks are not alphanumeric.  Only values with a
    non-ASCII character pay for the Arrow round trip; ``unicode=False`` removes it from the plan
    for columns known to be ASCII.
    """
    c = col(c)
    text = c
    if unicode:
        ascii_only = c.isNull() | ~c.rlike(r"[^\x00-\x7F]")
        text = F.when(ascii_only, c).otherwise(_nfkd(F.when(~ascii_only, c)))
    return F.coalesce(F.lower(F.trim(F.regexp_replace(text, r"[^A-Za-z0-9]+", " "))), F.lit(""))


def month_num(c: Column | str) -> Column:
    """B2: English month name to 1..12, null for anything else."""
    pairs = [F.lit(x) for i, m in enumerate(MONTH_NAMES, 1) for x in (m, i)]
    return F.try_element_at(F.create_map(*pairs), col(c))


def var_name(element: Column | str, item: Column | str) -> Column:
    """First letter of the element, underscore, first word of the item."""
    return F.concat(F.substring(col(element), 1, 1), F.lit("_"), F.split_part(col(item), F.lit(" "), F.lit(1)))


def alias_values(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Replace listed values, keep the others."""
    if not mapping:
        return col(c)
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, col(c)), col(c))


def label_key(h: int, thr: float | str | None = None) -> str:
    """Name of a label family member; ``1.8`` and ``thr1.8`` mean the same, 2.0 prints as 2."""
    if thr is None or str(thr).strip() == "":
        return f"Y_{h}"
    return f"Y_{h}_thr{float(str(thr).strip().removeprefix('thr')):g}"


# Wording of the notice classes.
NOTICE_PATTERNS = {
    "one_way": r"one[- ]way",
    "tow_limit": r"tow (size )?(limit|restriction)",
    "closure": r"clos(ed|ure)",
}


def parse_notice(c: Column | str) -> dict[str, Column]:
    """Flags, an intensity score and the mile range found in a notice text."""
    low = F.lower(col(c))
    flags = {k: low.rlike(p).cast("int") for k, p in NOTICE_PATTERNS.items()}
    miles = r"miles? (\d+(?:\.\d+)?)(?: (?:to|-) (\d+(?:\.\d+)?))?"
    lo = F.regexp_extract(low, miles, 1).try_cast("double")
    hi = F.regexp_extract(low, miles, 2).try_cast("double")
    return {
        **flags,
        "intensity": 3 * flags["closure"] + 2 * flags["one_way"] + flags["tow_limit"],
        "mile_lo": lo,
        "mile_hi": F.coalesce(hi, lo),
    }


# --- dates ----------------------------------------------------------------------------


def mk_month(y: Column | str, m: Column | str) -> Column:
    """First day of a month from year and month number."""
    return F.make_date(col(y), col(m), F.lit(1))


def parse_yyyymm(c: Column | str) -> Column:
    """``YYYYMM`` text to the first day of that month."""
    return F.to_date(F.concat(col(c).cast("string"), F.lit("01")), "yyyyMMdd")


def month_of(c: Column | str) -> Column:
    return F.trunc(col(c).cast("date"), "MM")


def months(spark, start: str, end: str) -> DataFrame:
    """month starts from ``start`` to ``end`` (``YYYYMM``) with their ordinal ``t``."""
    seq = F.sequence(parse_yyyymm(F.lit(start)), parse_yyyymm(F.lit(end)), F.expr("interval 1 month"))
    return spark.range(1).select(F.posexplode(seq).alias("t", "month"))


def calendar_columns(c: Column | str, holidays: Sequence[str] = ()) -> dict[str, Column]:
    """Month, day of year, quarter, fiscal quarter (October start), weekday, holiday flag."""
    d = col(c).cast("date")
    return {
        "month_no": F.month(d),
        "day_of_year": F.dayofyear(d),
        "quarter_no": F.quarter(d),
        "fiscal_quarter": F.quarter(F.add_months(d, 3)),
        "iso_weekday": F.weekday(d) + 1,
        "is_holiday": F.date_format(d, "MM-dd").isin(list(holidays)).cast("int"),
    }


# --- numbers --------------------------------------------------------------------------


def clean_num(c: Column | str) -> Column:
    """Numeric coercion; text that is no number, NaN and infinities become null."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(math.inf)), x)


def not_flag(c: Column | str, flag: str) -> Column:
    """Exclude a flag but keep rows without one."""
    return ~col(c).eqNullSafe(F.lit(flag))


def normalise(v: Column | str, month: Column | str, cap: float = math.inf, unit_hours: float = 24.0) -> Column:
    """Clip to [0, cap], divide by the hours of the month, log1p; null stays null."""
    hours = F.lit(float(unit_hours)) * F.dayofmonth(F.last_day(col(month)))
    v = col(v)
    return F.when(v.isNotNull(), F.log1p(F.least(F.greatest(v, F.lit(0.0)), F.lit(float(cap))) / hours))


def masks(v: Column | str) -> dict[str, Column]:
    """Land (missing), quiet (zero) and active (positive) as 0/1."""
    v = col(v)
    one = lambda cond: F.coalesce(cond, F.lit(False)).cast("tinyint")
    return {"land": one(v.isNull()), "quiet": one(v == 0), "active": one(v > 0)}


def signed_log1p(c: Column | str) -> Column:
    """B11."""
    return F.signum(col(c)) * F.log1p(F.abs(col(c)))


def mask_and_fill(cols: Sequence[str], sentinel: float) -> list[Column]:
    """Value with sentinel for null, plus a 0/1 missing indicator ``<name>_missing``."""
    out = []
    for c in cols:
        out += [F.coalesce(F.col(c), F.lit(float(sentinel))).alias(c), F.col(c).isNull().cast("tinyint").alias(f"{c}_missing")]
    return out


def month_enc(c: Column | str, mode: str = "cyclical") -> Column:
    """sin/cos pair of the angle 2*pi*(month-1)/12, or a one-hot array of length 12."""
    m = F.month(col(c))
    if mode == "cyclical":
        a = F.lit(2 * math.pi) * (m - 1) / 12
        return F.array(F.sin(a), F.cos(a))
    if mode == "onehot":
        return F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: (k == m).cast("double"))
    raise ValueError(mode)


def gate(values: Column | str, missing: Column | str, enc: Column | str) -> Column:
    """``[s * (1 - m), m, enc]`` as one array; a missing value contributes 0."""
    kept = F.zip_with(col(values), col(missing), lambda s, m: F.coalesce(s, F.lit(0.0)) * (1 - m))
    as_double = lambda a: F.transform(a, lambda x: x.cast("double"))
    return F.concat(kept, as_double(col(missing)), as_double(col(enc)))


def clamp(p: Column | str, eps: float = 1e-6) -> Column:
    """B15; null stays null (``least`` and ``greatest`` would skip it)."""
    return F.when(col(p).isNotNull(), F.least(F.greatest(col(p), F.lit(eps)), F.lit(1 - eps)))


def logit(p: Column | str, eps: float = 1e-6) -> Column:
    """B15."""
    q = clamp(p, eps)
    return F.ln(q / (1 - q))


def sigmoid(x: Column | str) -> Column:
    """B15."""
    return 1 / (1 + F.exp(-col(x)))


# Fixed value: the multiplier of the stride sample.
STRIDE_STEP = 1000003


def stride_sample(i: Column | str, j: Column | str, k: int) -> Column:
    """Deterministic modular sample of matrix cells; everything for k <= 1."""
    if k <= 1:
        return F.lit(True)
    return F.pmod(col(i).cast("bigint") * STRIDE_STEP + col(j).cast("bigint"), F.lit(k)) == 0


def bce(y: Column | str, p: Column | str, w: Column | float = 1.0) -> Column:
    """Weighted binary cross-entropy on the clamped probability."""
    q = clamp(p)
    w = w if isinstance(w, Column) else F.lit(float(w))
    return -w * (col(y) * F.ln(q) + (1 - col(y)) * F.ln(1 - q))


def focal(y: Column | str, p: Column | str, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Focal loss."""
    q, y = clamp(p), col(y)
    pt = F.when(y == 1, q).otherwise(1 - q)
    a = F.when(y == 1, F.lit(alpha)).otherwise(F.lit(1 - alpha))
    return -a * F.pow(1 - pt, F.lit(gamma)) * F.ln(pt)


def pinball(y: Column | str, q: Column | str, tau: float | Column) -> Column:
    """Pinball loss at level tau."""
    e = col(y) - col(q)  # null on either side gives null in both branches below
    t = tau if isinstance(tau, Column) else F.lit(float(tau))
    return F.greatest(t * e, (t - 1) * e)


def theta(length, conf, snr, state_bias, alpha=0.2, beta=0.02, gamma=0.3, delta=0.5, eta=0.1) -> Column:
    """Context threshold; a missing or zero SNR adds nothing."""
    inv = F.coalesce(F.try_divide(F.lit(1.0), col(snr)), F.lit(0.0))
    return alpha + beta * col(length) + gamma * col(conf) + delta * inv + eta * col(state_bias)


def clearance(ref: Column | str, stage: Column | str) -> Column:
    """Dynamic clearance, reference height minus stage."""
    return col(ref) - col(stage)


def seconds(ts: Column | str) -> Column:
    return micros(ts) / F.lit(1e6)
