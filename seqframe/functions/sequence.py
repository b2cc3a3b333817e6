"""Sequence functions from column to column. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complements of bases, and of IUPAC codes in both cases.
BASES, PAIRED = "ATGC", "TACG"
IUPAC, IUPAC_PAIRED = "ACGTRYSWKMBDHVNacgtryswkmbdhvn", "TGCAYRSWMKVHDBNtgcayrswmkvhdbn"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def complement_of(seq: str) -> str:
    return seq.translate(str.maketrans(BASES, PAIRED))[::-1]


def iupac_complement_of(seq: str) -> str:
    return seq.translate(str.maketrans(IUPAC, IUPAC_PAIRED))[::-1]


def reverse_complement(seq: Column | str) -> Column:
    """Upper-case A, T, G and C are complemented; all else is reversed only."""
    return F.reverse(F.translate(_col(seq), BASES, PAIRED))


def iupac_reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(_col(seq), IUPAC, IUPAC_PAIRED))


def sliced(seq: Column | str, start: Column, end: Column) -> Column:
    """seq[start:end], 0-based and half-open."""
    return F.substring(_col(seq), start + 1, end - start)


def letters(seq: Column | str) -> Column:
    """The characters of a string; none of an empty one."""
    return F.filter(F.split(_col(seq), ""), lambda c: c != "")


def phred(qual: Column | str) -> Column:
    """Quality letters as numbers."""
    return F.transform(letters(qual), lambda c: F.ascii(c) - 33)


def starts(length: Column, width: int | Column) -> Column:
    """0, 1, ... of all windows of that width; none if there is no room."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.when(length >= width, F.sequence(F.lit(0), length - width)).otherwise(F.array().cast("array<int>"))


def let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kmers(seq: Column | str, k: int = 5) -> Column:
    """All overlapping k-mers in order. Letters are split once: substring() would walk
    from the start of the string for each."""
    return let(letters(seq), lambda c: F.transform(starts(F.size(c), k), lambda i: F.array_join(F.slice(c, i + 1, k), "")))


_STEP = 128


def running(sizes: Column) -> Column:
    """The sum of what stands before each element, of a non-empty array, in two levels:
    the cost doesn't grow with the square of the length."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def within(part: Column, before: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(part)), lambda i: before + total(F.slice(part, 1, i - 1)))

    parts = F.transform(F.sequence(F.lit(0), F.size(sizes) - 1, F.lit(_STEP)), lambda k: F.slice(sizes, k + 1, _STEP))
    return let(parts, lambda p: let(F.transform(p, total), lambda sums: F.flatten(F.transform(p, lambda part, k: let(total(F.slice(sums, 1, k)), lambda before: within(part, before))))))


def occurrences(seq: Column | str, motif: Column) -> Column:
    """array<int>: where the motif begins, overlapping ones too. The string is split in
    front of each occurrence; the pieces' lengths add up to the places."""
    pieces = F.split(_col(seq), F.concat(F.lit("(?=\\Q"), motif, F.lit("\\E)")), -1)

    def places(p: Column) -> Column:
        first = F.startswith(_col(seq), motif)  # all pieces but the first begin with an occurrence
        marked = F.transform(running(F.transform(p, lambda x: F.length(x))), lambda at, k: F.when((k > 0) | first, at))
        return F.filter(marked, lambda at: at.isNotNull())

    return let(pieces, places)


def wildcard_similarity(a: Column | str, b: Column | str) -> Column:
    """Share of equal positions among those without * on either side; 0.0 if there are
    none, or if the lengths differ."""
    same = F.length(_col(a)) == F.length(_col(b))
    pairs = F.zip_with(letters(a), letters(b), lambda x, y: F.when((x == "*") | (y == "*"), None).otherwise((x == y).cast("int")))
    known = F.filter(pairs, lambda p: p.isNotNull())
    share = let(known, lambda k: F.try_divide(F.aggregate(k, F.lit(0), lambda s, p: s + p).cast("double"), F.size(k)))
    return F.coalesce(F.when(same, share), F.lit(0.0))


def edit_budget(motif: Column | str, threshold: float) -> Column:
    """int(len * (1 - threshold)) in doubles, as the reference rounds it."""
    return (F.length(_col(motif)) * (F.lit(1.0) - F.lit(float(threshold)))).cast("int")


def exact_edit_budget(motif: Column | str, threshold: float) -> Column:
    """The same without the error of binary fractions."""
    return F.floor(F.round(F.length(_col(motif)) * (F.lit(1.0) - F.lit(float(threshold))), 9)).cast("int")


def token(name: Column | str, position: Column | str, bucket: int = 1) -> Column:
    """name@position, positions in buckets."""
    return F.concat(_col(name), F.lit("@"), F.floor(_col(position) / bucket).cast("string"))


def positional_encoding(position: Column | str, dim: int = 10) -> Column:
    """sin and cos of position by falling frequencies, dim numbers."""
    p = _col(position).cast("double")
    return F.array(*[(F.sin if i % 2 == 0 else F.cos)(p / F.pow(F.lit(10000.0), F.lit((i - i % 2) / dim))) for i in range(dim)])


def position_weight(position: Column, low: Column, high: Column) -> Column:
    """1.0 at the lowest position falling to 0.1 at the highest."""
    return F.lit(1.0) - F.lit(0.9) * (position - low) / F.greatest(high - low, F.lit(1e-6))


def relative_position(position: Column, last: Column) -> Column:
    """position over the read's last one, 0.0 if that is 0."""
    return F.coalesce(F.try_divide(position.cast("double"), last), F.lit(0.0))


def padded(values: Column | str, length: int, fill: Column | None = None) -> Column:
    """Cut or filled up to that length."""
    fill = F.lit(0) if fill is None else fill
    return F.slice(F.concat(_col(values), F.array_repeat(fill, length)), 1, length)


def short_label(name: Column | str) -> Column:
    return F.concat(F.lit("..."), F.right(_col(name), F.lit(8)))


def pair_label(a: Column | str, b: Column | str) -> Column:
    return F.concat(_col(a), F.lit(" → "), _col(b))


def euclidean(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.transform(_col(v), lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def distance(a: Column | str, b: Column | str) -> Column:
    return euclidean(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") - y.cast("double")))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """part of whole in percent, rounded half to even; null if whole is 0."""
    return F.bround(F.try_divide(part.cast("double") * 100.0, whole.cast("double")), digits)
