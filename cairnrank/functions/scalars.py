"""Scalar expressions: names, ids, keys, bins, masks and scores as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted feature names (upper case, without ``_`` and ``-``) and their ids. Fixed values.
FEATURES = {
    "HBD": 1, "DONOR": 1, "HBA": 2, "ACCEPTOR": 2, "POSIONIZABLE": 3, "POSITIVE": 3, "CATION": 3,
    "NEGIONIZABLE": 4, "NEGATIVE": 4, "ANION": 4, "HYDROPHOBE": 5, "HYDROPHOBIC": 5, "AROMATIC": 6, "AROMATICRING": 6,
}
CONFORMER = r"(?i)^(.+?)[_-]conf[_-]?(\d+)$"


def slugify(c: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 to ``-``, no ``-`` at the ends; null where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s != "", s)


def safe_name(c: Column) -> Column:
    """A file name: unsafe characters to ``_``, none of ``._`` at the ends, ``item`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.when(s == "", "item").otherwise(s)


def contains_han(c: Column) -> Column:
    return c.rlike(r"\p{IsHan}")


def split_conformer(c: Column) -> tuple[Column, Column]:
    """Molecule name and conformer index of a name that ends in ``_conf_N``; else the whole name and 0."""
    name = F.regexp_extract(c, CONFORMER, 1)
    return F.when(name == "", c).otherwise(name), F.when(name == "", 0).otherwise(F.regexp_extract(c, CONFORMER, 2).try_cast("int"))


def feature_type(c: Column) -> Column:
    """Feature id of a name, null if it is none."""
    key = F.upper(F.regexp_replace(c, "[_-]", ""))
    return F.create_map(*[F.lit(x) for kv in FEATURES.items() for x in kv])[key]


def missing_to(c: Column, default: str = "") -> Column:
    """``.`` and ``?`` stand for a missing value."""
    return F.when(c.isin(".", "?"), default).otherwise(c)


def task_id(*parts: Column) -> Column:
    """``DT-`` and the first 16 hex digits of the SHA-256 of the parts joined by ``|``."""
    return F.concat(F.lit("DT-"), F.upper(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)))


def stable_id(prefix: str, *parts: Column) -> Column:
    """A prefix and 12 hex digits that depend on the parts alone."""
    return F.concat(F.lit(f"{prefix}-"), F.upper(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)))


def pair_key(a: Column, b: Column, bin_: Column) -> Column:
    """Two types in order and a distance bin as one number: least << 24 | greatest << 16 | bin."""
    low, high = F.least(a, b).cast("bigint"), F.greatest(a, b).cast("bigint")
    return F.shiftleft(low, 24).bitwiseOR(F.shiftleft(high, 16)).bitwiseOR(bin_.cast("bigint"))


def pair_of(key: Column) -> tuple[Column, Column, Column]:
    return F.shiftrightunsigned(key, 24).bitwiseAND(255), F.shiftrightunsigned(key, 16).bitwiseAND(255), key.bitwiseAND(65535)


def distance_bin(d: Column, width: float) -> Column:
    return F.floor(d / F.lit(width)).cast("bigint")


def bin_range(d: Column, tolerance: Column, width: float, most: float) -> tuple[Column, Column]:
    """First and last bin within a tolerance, widened to whole bins; first > last if there is none."""
    return distance_bin(F.greatest(F.lit(0.0), d - tolerance), width), distance_bin(F.least(F.lit(float(most)), d + tolerance), width)


def mask_of(hits: list[Column]) -> Column:
    """Bit j is set if hit j is true (63 at most)."""
    if not 0 < len(hits) < 64:
        raise ValueError("a mask has 1 to 63 bits")
    out = F.lit(0).cast("bigint")
    for j, h in enumerate(hits):
        out = out.bitwiseOR(F.when(h, F.lit(1 << j).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return out


def quantised(c: Column, origin: Column, scale: int = 100) -> Column:
    """Half-even steps of 1/scale from the origin as smallint; an error beyond its range."""
    q = F.rint((c - origin) * scale)
    return F.when(q.between(-32768, 32767), q).otherwise(F.raise_error(F.lit("coordinate beyond the quantised range"))).cast("smallint")


def dequantised(q: Column, origin: Column, scale: int = 100) -> Column:
    return origin + q / scale


def tanimoto(cross: Column, a: Column, b: Column) -> Column:
    """cross / (a + b - cross), 0 where the denominator isn't positive."""
    d = a + b - cross
    return F.when(d <= 0, 0.0).otherwise(cross / F.when(d > 0, d))


def tversky(cross: Column, query: Column, candidate: Column, alpha: float = 0.95, beta: float = 0.05) -> Column:
    """cross / (alpha query + beta candidate), biased to the query; it may exceed 1."""
    if alpha < 0 or beta < 0 or abs(alpha + beta - 1) > 1e-8:
        raise ValueError("alpha and beta are not negative and sum to one")
    d = alpha * query + beta * candidate
    return F.when(d <= 0, 0.0).otherwise(cross / F.when(d > 0, d))


def angle(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    """Degrees between two vectors, null if one is null in length."""
    cos = (ax * bx + ay * by + az * bz) / F.sqrt((ax * ax + ay * ay + az * az) * (bx * bx + by * by + bz * bz))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def clean_sequence(c: Column) -> Column:
    """Upper case without white space; null unless it is amino acids alone."""
    s = F.upper(F.regexp_replace(c, r"\s+", ""))
    return F.when(s.rlike("^[ACDEFGHIKLMNPQRSTVWY]+$"), s)


def atom_name(c: Column) -> Column:
    """A four-column atom name: short names begin in the second column."""
    return F.when(F.length(c) < 4, F.rpad(F.concat(F.lit(" "), c), 4, " ")).otherwise(c)


def until_nul(c: Column) -> Column:
    """Text of fixed-width bytes, cut at the first NUL."""
    return F.substring_index(F.decode(c, "UTF-8"), "\0", 1)
