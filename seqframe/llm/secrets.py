"""Secret scans with multipart credential linking, in DataFrame operations only.

Base findings stand by themselves: assignments to telling names, access identifiers and
long hexadecimal runs. A credential often has several parts of which each alone says
little: who (an identifier or address), what (the secret) and where (an endpoint). Weak
candidates for these are collected too, and are reported only when a complementary part
is in scope, which is `scope` characters to either side: an identifier or an endpoint
with a secret, a weak secret with an identifier or an endpoint. Parts meet in an interval
join by bins of positions, so that neither a long document nor a part that many documents
share makes a large group; the join only asks whether there is a partner.

Positions are code points, ends exclusive. Matches of a kind are leftmost and don't
overlap; none can hold a newline. Null text counts as empty and has no findings. Each
input row gives one output row, repeated rows too. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqframe.llm.common import cut
from seqframe.llm.decontaminate import let

#: Kinds in order, with the pattern and the part of the credential that it is.
#: The patterns of the three base kinds.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "what"),
    "access": (r"AKIA[A-Z0-9]{16,}+", "who"),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}+", "what"),
}
WEAK = {
    "identifier": (r"""(?i)(?<![A-Za-z0-9_])(?:access_?key_?id|access_?id|client_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}+|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++""", "who"),
    "candidate": (r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=-]{20,}+", "what"),
    "endpoint": (r"""(?i)(?<![A-Za-z0-9_+-])[a-z][a-z0-9+-]++://[^\s"'<>]{3,}+|(?<![A-Za-z0-9_])(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{4,}+""", "where"),
}
KINDS = [*BASE, *WEAK]
_STEP = 128
SPAN = "array<struct<start:int,kind:int,end:int>>"


def running(n: Column) -> Column:
    """array<int>: the sum of what stands before each element of a non-empty array. Two levels keep
    it from growing with the square of the array's length."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, x: s + x)

    parts = F.transform(F.sequence(F.lit(0), F.size(n) - 1, F.lit(_STEP)), lambda k: F.slice(n, k + 1, _STEP))

    def inner(p: Column) -> Column:
        return let(
            F.transform(p, total),
            lambda sums: F.flatten(
                F.transform(p, lambda part, k: let(total(F.slice(sums, 1, k)), lambda before: F.transform(F.sequence(F.lit(0), F.size(part) - 1), lambda i: before + total(F.slice(part, 1, i)))))
            ),
        )

    return let(parts, inner)


def furthest(n: Column) -> Column:
    """array<int>: the greatest of each element of a non-empty array and those before it, by
    blocks as in running()."""
    parts = F.transform(F.sequence(F.lit(0), F.size(n) - 1, F.lit(_STEP)), lambda k: F.slice(n, k + 1, _STEP))

    def inner(p: Column) -> Column:
        most = F.transform(p, lambda x: F.array_max(x))
        return let(most, lambda m: F.flatten(F.transform(p, lambda part, k: let(F.array_max(F.slice(m, 1, k)), lambda before: F.transform(part, lambda _, i: F.greatest(before, F.array_max(F.slice(part, 1, i + 1))))))))

    return let(parts, inner)


def spans_of(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """array<struct<start, kind, end>> of the matches that keep() accepts. What split()
    leaves between the matches says where they are."""
    none = F.array().cast(SPAN)

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        sizes = F.transform(found, lambda x: F.length(x))
        starts = let(gaps, lambda g: let(running(F.zip_with(F.slice(g, 1, F.size(found)), sizes, lambda a, b: a + b)), lambda r: F.zip_with(r, F.slice(g, 1, F.size(found)), lambda a, b: a + b)))
        at = F.zip_with(starts, found, lambda s, m: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(m)).alias("end"), m.alias("m")))
        at = F.filter(at, lambda x: keep(x["m"])) if keep else at
        return F.transform(at, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))).cast(SPAN)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))


def _long_value(m: Column) -> Column:
    return F.length(F.regexp_extract(m, BASE["assign"][0], 2)) >= 6


def _mixed(m: Column) -> Column:
    """A candidate has a letter and a digit."""
    return m.rlike("[0-9]") & m.rlike("[A-Za-z]")


_KEEP = {"assign": _long_value, "candidate": _mixed}


def parts(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns: id, h (hash of the text), base, weak: all candidates of each row."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(*[spans_of(t, p, k, _KEEP.get(name)) for k, (name, (p, _)) in enumerate(BASE.items())])
    weak = F.concat(*[spans_of(t, p, len(BASE) + k, _KEEP.get(name)) for k, (name, (p, _)) in enumerate(WEAK.items())])
    return docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("h"), F.array_sort(base).alias("base"), weak.alias("weak"))


def _role(kind: str) -> Column:
    of = {k: role for k, (_, role) in enumerate([*BASE.values(), *WEAK.values()])}
    out = F.lit("what")
    for k, role in of.items():
        out = F.when(F.col(kind) == k, role).otherwise(out)
    return out


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor((F.greatest(end - 1, start)) / width)))


def linked(found: DataFrame, *, scope: int = 256) -> DataFrame:
    """Columns: id, h, extra: of each row's weak candidates those with a partner."""
    weak = found.where(F.size("weak") > 0)
    own = weak.select("id", "h", F.explode("weak").alias("s")).select("id", "h", "s", "s.kind", "s.start", "s.end")
    own = own.withColumn("role", _role("kind")).select("*", _bins(F.col("start") - scope, F.col("end") + scope, 2 * scope).alias("bin"))
    other = weak.select("id", "h", F.explode(F.concat("base", "weak")).alias("s")).select(F.col("id").alias("id2"), F.col("h").alias("h2"), F.col("s.kind").alias("kind2"), F.col("s.start").alias("start2"), F.col("s.end").alias("end2"))
    other = other.withColumn("role2", _role("kind2")).select("id2", "h2", "role2", "start2", "end2", _bins(F.col("start2"), F.col("end2"), 2 * scope).alias("bin2"))
    met = F.expr(f"id <=> id2 and h = h2 and bin = bin2 and start2 < end + {scope} and start < end2 + {scope} and (role = 'what') <> (role2 = 'what')")
    other = other.hint("merge")  # Spark sizes exploded rows like those before, and would broadcast them
    return own.join(other, met, "left_semi").groupBy("id", "h").agg(F.collect_set("s").alias("extra"))


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", scope: int = 256) -> DataFrame:
    """Columns: key, h (hash of the text), spans: array<struct<start, kind, end>>, sorted
    by start, then kind; kind is an index of KINDS."""
    found, _ = cut(parts(docs, key=key, text=text))
    extra = linked(found, scope=scope).withColumnsRenamed({"id": "id2", "h": "h2"})
    out = found.join(extra, F.expr("id <=> id2 and h = h2"), "left")
    spans = F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "extra")))
    return out.select(F.col("id").alias(key), "h", spans.alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    at = [KINDS.index(k) for k in kinds]
    return F.filter(spans, lambda s: s["kind"].isin(at))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch that spans cover replaced by the mark. spans are sorted by start."""

    def cut_at(e: Column) -> Column:
        """e: the furthest end of each span and those before it."""
        pieces = F.transform(spans, lambda s, i: F.when(F.coalesce(F.get(e, i - 1), F.lit(-1)) < s["start"], F.substring(text, F.coalesce(F.get(e, i - 1), F.lit(0)) + 1, s["start"] - F.coalesce(F.get(e, i - 1), F.lit(0)))))
        return F.concat(F.array_join(pieces, mark), F.lit(mark), F.substring(text, F.get(e, F.size(e) - 1) + 1, F.length(text)))

    return F.when(F.size(spans) > 0, let(furthest(F.transform(spans, lambda s: s["end"])), cut_at)).otherwise(text)
