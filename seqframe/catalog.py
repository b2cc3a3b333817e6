"""Every registered query of the engine, with its DuckDB twin where SQL can express it.

The tables hold no sequences, so that reads are derived from documents the same way in
both engines: the letters of the whole text, each mapped to one of A, C, G and T; the
source is the barcode. Matches are the exact matches of five short motifs, in the layout
queries too. Embeddings with their labels stand for feature tables with cluster assignments.
Every query reads its whole tables and whole reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqframe.functions import sequence as S
from seqframe.functions.grams import kmer_totals
from seqframe.operators import cluster, embed, layout, motif, pairs, search, stats
from seqframe.schema import neighbour_rules, primer_rules, queries_df
from seqframe.scratch import shared_dir
from seqframe.sources import fastq, tables
from seqframe.streaming import matches as streaming

MOTIFS = {"Left": "ACGT", "Right": "GATC", "RCLeft": "CTAG", "RCRight": "TACA", "Barcode1": "GGCA"}
NAMES = sorted(MOTIFS)
RULES = [{"start": "Left", "end": "RCRight", "orientation": "direct"}, {"start": "RCLeft", "end": "Left", "orientation": "reverse"}]
PRIMERS = [{"primer": "Right", "distance_min": 0, "distance_max": 40, "orientation": "direct"}, {"primer": "Barcode1", "distance_min": 5, "distance_max": 15, "orientation": "reverse"}]

_ALPHABET, _BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TO_BASE = bytes.maketrans((_ALPHABET + _ALPHABET.upper()).encode(), 2 * _BASES.encode())
_NO_LETTER = bytes(b for b in range(256) if not chr(b).isascii() or not chr(b).isalpha())


def _lettered(table: DataFrame, **names: str) -> DataFrame:
    """The named columns, and seq: the letters of text, of either case, each as a base; bytes that
    are no letters go, so that nothing is left of other characters."""
    rows = table.select(*[F.col(c).alias(n) for n, c in names.items()], "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(len(names)).cast(pa.binary()).to_pylist()
            seq = pa.array([(t or b"").translate(_TO_BASE, _NO_LETTER) for t in text], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], seq], names=[*names, "seq"])

    return rows.mapInArrow(run, ", ".join([*(f"{c.name} {c.dataType.simpleString()}" for c in rows.schema[: len(names)]), "seq string"]))


def reads_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lettered(_table(spark, sf_dir, "documents"), seq_id="doc_id", barcode="source")


def matches_of(spark: SparkSession, sf_dir: str, barcode: bool = False) -> DataFrame:
    return search.exact_matches(reads_of(spark, sf_dir), MOTIFS, keep=("barcode",) if barcode else ())


def features_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("cluster"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))


def _r(c: Column | str, name: str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits).alias(name)


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


_READS = f"""reads AS (SELECT doc_id AS seq_id, source AS barcode,
  translate(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '{_ALPHABET}', '{_BASES}') AS seq FROM documents)"""
_MOTIFS = "motifs(query_name, query_seq, query_idx) AS (VALUES " + ", ".join(f"('{n}', '{s}', {k})" for k, (n, s) in enumerate(MOTIFS.items())) + ")"
_PLACES = "places AS (SELECT seq_id, barcode, seq, unnest(range(length(seq))) AS i FROM reads)"
_MATCHES = f"""{_READS}, {_MOTIFS}, {_PLACES},
matches AS (SELECT seq_id, barcode, query_name, query_idx, CAST(i AS INTEGER) AS position, 4 AS length, 1.0::DOUBLE AS score
  FROM (SELECT seq_id, barcode, i, substring(seq, i + 1, 4) AS w FROM places) JOIN motifs ON w = query_seq)"""
_PAIRS = f"""{_MATCHES},
near AS (SELECT *, lead(query_name) OVER w AS next_name, lead(position) OVER w AS next_position, lead(length) OVER w AS next_length,
  count(*) OVER (PARTITION BY seq_id) AS n_matches FROM matches WINDOW w AS (PARTITION BY seq_id ORDER BY position, query_name, length)),
pairs AS (SELECT *, next_position - (position + length) AS gap, next_position - position AS start_delta FROM near WHERE next_name IS NOT NULL)"""
_PLAIN = f"""{_MATCHES},
near AS (SELECT *, lead(query_name) OVER w AS next_name, lead(position) OVER w AS next_position, lead(length) OVER w AS next_length
  FROM matches WHERE NOT contains(query_name, 'Barcode') WINDOW w AS (PARTITION BY seq_id ORDER BY position, query_name, length)),
pairs AS (SELECT *, next_position - (position + length) AS gap, next_position - position AS start_delta FROM near WHERE next_name IS NOT NULL)"""
_RULES = "rules(query_name, next_name, orientation) AS (VALUES " + ", ".join(f"('{r['start']}', '{r['end']}', '{r['orientation']}')" for r in RULES) + ")"
_FEATURES = "x AS (SELECT vec_id, label AS cluster, list_transform(embedding, lambda e: e::DOUBLE) AS features FROM embeddings), long AS (SELECT vec_id, cluster, unnest(features) AS v, unnest(range(len(features))) AS k FROM x)"
_CENTRES = f"{_FEATURES}, centres AS (SELECT cluster, k, avg(v) AS c FROM long GROUP BY cluster, k), away AS (SELECT l.vec_id, l.cluster, sqrt(sum((v - c) * (v - c))) AS d FROM long l JOIN centres USING (cluster, k) GROUP BY 1, 2)"


# Search


@query(f"WITH {_MATCHES} SELECT seq_id, query_name, position, length, score FROM matches")
def motif_exact(spark, sf_dir):
    return matches_of(spark, sf_dir)


@query(f"""WITH {_MATCHES} SELECT query_name, round(avg(position)) AS avg_pos, median(position) AS median_pos, min(position) AS min_pos,
max(position) AS max_pos, round(stddev_samp(position), 6) AS std_pos, count(*) AS n FROM matches GROUP BY query_name""")
def motif_stats(spark, sf_dir):
    return stats.motif_statistics(matches_of(spark, sf_dir)).withColumn("std_pos", F.round("std_pos", 6))


EDITED = {"M8": "TTATTAGC", "M12": "GATCACGTCTAG"}
_EDITED = "m(query_name, q) AS (VALUES " + ", ".join(f"('{n}', '{q}')" for n, q in EDITED.items()) + ")"


@query(f"""WITH {_READS}, {_EDITED}, b AS (SELECT *, CAST(floor(length(q) * (1.0::DOUBLE - 0.85::DOUBLE)) AS INTEGER) AS k FROM m),
s AS (SELECT seq_id, seq, unnest(range(length(seq))) AS i FROM reads), w AS (SELECT query_name, q, k, unnest(range(length(q) - k, length(q) + k + 1)) AS l FROM b),
c AS (SELECT seq_id, query_name, q, k, i, i + l AS j, levenshtein(substring(seq, i + 1, l), q) AS d FROM s, w WHERE i + l <= length(seq)),
e AS (SELECT *, min(d) OVER (PARTITION BY seq_id, query_name) AS best FROM c WHERE d <= k)
SELECT seq_id, query_name, CAST(min(i) AS INTEGER) AS position, CAST(j - min(i) AS INTEGER) AS length, 1.0::DOUBLE - d::DOUBLE / length(q) AS score FROM e WHERE d = best GROUP BY seq_id, query_name, q, j, d""")
def motif_edit(spark, sf_dir):
    return search.edit_matches(reads_of(spark, sf_dir), EDITED, 0.85)


def _starts(spark, sf_dir, table, size):
    """The first letters of each text, as a table of motifs named after themselves."""
    rows = _lettered(_table(spark, sf_dir, table)).select(F.substring("seq", 1, size).alias("query_name")).where(F.length("query_name") == size).distinct()
    return rows.select("query_name", F.col("query_name").alias("query_seq"), F.xxhash64("query_name").alias("query_idx"))


@query(f"""WITH {_READS}, {_PLACES}, m AS (SELECT DISTINCT substring(seq, 1, 20) AS q FROM reads WHERE length(seq) >= 20)
SELECT seq_id, q AS query_name, CAST(i AS INTEGER) AS position, 20 AS length, 1.0::DOUBLE AS score FROM (SELECT seq_id, i, substring(seq, i + 1, 20) AS q FROM places) JOIN m USING (q)""")
def motif_many_exact(spark, sf_dir):
    """The beginning of every read is a motif: as many motifs as reads."""
    return search.exact_matches(reads_of(spark, sf_dir), _starts(spark, sf_dir, "documents", 20))


@query(f"""WITH {_READS}, {_PLACES}, b AS (SELECT translate(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '{_ALPHABET}', '{_BASES}') AS seq FROM benchmark),
m AS (SELECT DISTINCT substring(seq, 1, 15) AS q FROM b WHERE length(seq) >= 15), p AS (SELECT q, 0 AS off, substring(q, 1, 7) AS w FROM m UNION ALL SELECT q, 7, substring(q, 8, 8) FROM m),
h AS (SELECT seq_id, seq, q, i - off AS diag FROM places JOIN p ON substring(seq, i + 1, 7) = w AND off = 0 UNION SELECT seq_id, seq, q, i - off FROM places JOIN p ON substring(seq, i + 1, 8) = w AND off = 7),
c AS (SELECT DISTINCT seq_id, q, diag + x.s AS i, diag + 15 + y.s AS j, seq FROM h, (VALUES (-1), (0), (1)) x(s), (VALUES (-1), (0), (1)) y(s)),
d AS (SELECT seq_id, q, i, j, levenshtein(substring(seq, i + 1, j - i), q) AS d FROM c WHERE i >= 0 AND j <= length(seq)),
e AS (SELECT *, min(d) OVER (PARTITION BY seq_id, q) AS best FROM d WHERE d <= 1)
SELECT seq_id, q AS query_name, CAST(min(i) AS INTEGER) AS position, CAST(j - min(i) AS INTEGER) AS length, 1.0::DOUBLE - d::DOUBLE / 15 AS score FROM e WHERE d = best GROUP BY seq_id, q, j, d""")
def motif_many_edit(spark, sf_dir):
    """The beginning of every benchmark item is a motif, found with one edit."""
    return search.edit_matches(reads_of(spark, sf_dir), _starts(spark, sf_dir, "benchmark", 15), 0.9)


@query()
def motif_window_apart(spark, sf_dir):
    return search.window_matches(reads_of(spark, sf_dir), {"M10": "ACGTGATCCT"}, 0.7, pick="distance")


@query()
def primer_detected(spark, sf_dir):
    """By read: the primers' hits, and those at or over 60 percent."""
    return search.primer_report(_aligned(spark, sf_dir), 60.0)


@query()
def primer_share(spark, sf_dir):
    return search.primer_summary(_aligned(spark, sf_dir), 60.0)


def _aligned(spark, sf_dir, drawing=False):
    return search.local_alignments(reads_of(spark, sf_dir), {"Left": "ACGTGATCCTAGTACA", "Right": "GATCACGTCTAG"}, drawing=drawing)


@query()
def motif_window(spark, sf_dir):
    return search.window_matches(reads_of(spark, sf_dir), {"M10": "ACGTGATCCT"}, 0.9)


@query()
def primer_alignment(spark, sf_dir):
    return _aligned(spark, sf_dir, drawing=True)


@query("""WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents)
SELECT length(word)::INTEGER AS size, CAST(floor(length(word) * (1.0::DOUBLE - 0.9::DOUBLE)) AS INTEGER) AS budget, count(*) AS n FROM w GROUP BY 1, 2""")
def edit_budget(spark, sf_dir):
    words = _table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    return words.groupBy(F.length("word").alias("size"), S.edit_budget("word", 0.9).alias("budget")).agg(F.count("*").alias("n"))


_TURNED = f"{_READS}, turned AS (SELECT seq_id, seq, reverse(translate(seq, 'ATGC', 'TACG')) AS rc FROM reads)"


@query(f"""WITH {_TURNED}, c AS (SELECT seq_id, unnest(string_split(translate(seq, 'T', '*'), '')) AS a, unnest(string_split(rc, '')) AS b FROM turned WHERE seq <> ''),
s AS (SELECT seq_id, sum((a = b)::INT)::DOUBLE / count(*) AS share FROM c WHERE a <> '*' GROUP BY seq_id)
SELECT seq_id, round(coalesce(share, 0), 9) AS same, 0.0::DOUBLE AS longer FROM turned LEFT JOIN s USING (seq_id)""")
def strand_similarity(spark, sf_dir):
    """Wildcards are skipped; strings of different lengths have nothing in common."""
    rows = reads_of(spark, sf_dir).select("seq_id", F.translate("seq", "T", "*").alias("a"), S.reverse_complement("seq").alias("b"))
    return rows.select("seq_id", _r(S.wildcard_similarity("a", "b"), "same", 9), S.wildcard_similarity("a", F.concat("b", F.lit("A"))).alias("longer"))


@query(f"WITH {_READS} SELECT seq_id, reverse(translate(seq, 'ATGC', 'TACG')) AS rc, length(seq) AS n FROM reads")
def rc_reads(spark, sf_dir):
    return reads_of(spark, sf_dir).select("seq_id", S.reverse_complement("seq").alias("rc"), F.length("seq").cast("bigint").alias("n"))


@query(f"WITH {_READS}, {_PLACES} SELECT kmer, count(*) AS n FROM (SELECT substring(seq, i + 1, 5) AS kmer FROM places WHERE i <= length(seq) - 5) GROUP BY kmer")
def kmer_counts(spark, sf_dir):
    return kmer_totals(reads_of(spark, sf_dir), 5)


@query(f"""WITH {_READS}, {_PLACES} SELECT seq_id, CAST(i AS INTEGER) AS position, CAST((substring(w, 1, 1) = 'A')::INT + (substring(w, 3, 1) = 'G')::INT + (substring(w, 4, 1) = 'T')::INT AS DOUBLE) / 3 AS score
FROM (SELECT seq_id, i, substring(seq, i + 1, 4) AS w FROM places WHERE i <= length(seq) - 4)
WHERE substring(w, 1, 1) = 'A' AND substring(w, 3, 1) = 'G' AND substring(w, 4, 1) = 'T'""")
def wildcard_scan(spark, sf_dir):
    return search.wildcard_scan(reads_of(spark, sf_dir), {"W": "A*GT"}, 0.9).select("seq_id", "position", "score")


@query(f"""WITH {_MATCHES}, g AS (SELECT *, coalesce(CAST(position - lag(position) OVER w > 12 AS INTEGER), 0) AS new FROM matches WINDOW w AS (PARTITION BY seq_id, query_name ORDER BY position)),
i AS (SELECT *, sum(new) OVER (PARTITION BY seq_id, query_name ORDER BY position) AS island FROM g)
SELECT seq_id, query_name, position FROM (SELECT *, row_number() OVER (PARTITION BY seq_id, query_name, island ORDER BY score DESC, position) AS r FROM i) WHERE r = 1""")
def islands_best(spark, sf_dir):
    return search.best_of_islands(matches_of(spark, sf_dir).withColumn("length", F.lit(12))).select("seq_id", "query_name", "position")


# Neighbours, junctions, trimming


@query(f"WITH {_PAIRS} SELECT seq_id, query_name, next_name, position, gap, abs(gap) AS abs_gap, start_delta FROM pairs")
def pair_gaps(spark, sf_dir):
    return pairs.adjacent(matches_of(spark, sf_dir)).select("seq_id", "query_name", "next_name", "position", "gap", "abs_gap", "start_delta")


_PAIR_STATS = f"""WITH {_PAIRS} SELECT query_name AS from_name, next_name AS to_name, count(*) AS n, round(avg(gap), 6) AS mean, round(stddev_pop(gap), 6) AS std,
min(gap) AS min, max(gap) AS max, median(gap) AS median FROM pairs GROUP BY 1, 2"""


def _rounded_pairs(spark, sf_dir):
    return pairs.pair_statistics(matches_of(spark, sf_dir)).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(_PAIR_STATS)
def pair_stats(spark, sf_dir):
    return _rounded_pairs(spark, sf_dir)


@query(f"SELECT * FROM ({_PAIR_STATS}) WHERE min BETWEEN -3 AND 30 AND median BETWEEN 5 AND 66 AND n >= 5")
def pair_stats_glued(spark, sf_dir):
    return stats.ranged(_rounded_pairs(spark, sf_dir), {"min": (-3, 30), "median": (5, 66), "n": (5, 1 << 60)})


@query(f"SELECT from_name, to_name, n FROM ({_PAIR_STATS}) WHERE (from_name, to_name) NOT IN (('Left', 'Right'), ('RCRight', 'RCLeft'))")
def pairs_outside_list(spark, sf_dir):
    listed = spark.createDataFrame([("Left", "Right"), ("RCRight", "RCLeft")], "from_name string, to_name string")
    return pairs.by_pair(_rounded_pairs(spark, sf_dir), listed, keep=False).select("from_name", "to_name", "n")


_FROM_TO = ["Left", "RCLeft", "RCRight", "Right"]


@query(f"""WITH {_PLAIN} SELECT query_name AS from_name, {', '.join(f"coalesce(count(*) FILTER (next_name = '{n}'), 0) AS \"{n}\"" for n in _FROM_TO)} FROM pairs GROUP BY 1""")
def pair_pivot_counts(spark, sf_dir):
    return pairs.count_pivot(pairs.barcode_distances(matches_of(spark, sf_dir, True)), _FROM_TO)


@query(f"""WITH {_PLAIN} SELECT query_name AS from_name, {', '.join(f"round(avg(start_delta) FILTER (next_name = '{n}'), 6) AS \"{n}\"" for n in _FROM_TO)} FROM pairs GROUP BY 1""")
def pair_pivot_mean(spark, sf_dir):
    wide = pairs.distance_pivot(pairs.barcode_distances(matches_of(spark, sf_dir, True)), _FROM_TO)
    return wide.select("from_name", *[_r(n, n) for n in _FROM_TO])


@query(f"WITH {_PLAIN} SELECT barcode, query_name AS from_name, next_name AS to_name, start_delta AS distance FROM pairs")
def barcode_distances(spark, sf_dir):
    return pairs.barcode_distances(matches_of(spark, sf_dir, True))


_JUNCTION = f"WITH {_PAIRS}, {_RULES} SELECT DISTINCT seq_id, {{a}} AS start_pos, {{b}} AS end_pos, orientation FROM pairs JOIN rules USING (query_name, next_name) WHERE n_matches >= 3 AND gap BETWEEN 0 AND 20"


@query(_JUNCTION.format(a="position + length", b="next_position"))
def junction_inner(spark, sf_dir):
    return pairs.junctions(matches_of(spark, sf_dir), neighbour_rules(spark, RULES), 0, 20)


@query(_JUNCTION.format(a="position", b="next_position + next_length"))
def junction_outer(spark, sf_dir):
    return pairs.junctions(matches_of(spark, sf_dir), neighbour_rules(spark, RULES), 0, 20, include=True)


@query(f"""WITH {_PLAIN} SELECT seq_id, position + length AS start_pos, next_position AS end_pos FROM pairs
WHERE abs(gap) >= 3 AND ((query_name = 'RCRight' AND next_name = 'RCLeft') OR (query_name = 'Left' AND next_name = 'Right'))""")
def primer_pairs(spark, sf_dir):
    return pairs.primer_pairs(matches_of(spark, sf_dir), 3)


@query(f"""WITH {_PLAIN} SELECT seq_id, position AS start_pos, next_position + next_length AS end_pos FROM pairs
WHERE abs(gap) >= 3 AND query_name IN ('Left', 'RCRight') AND next_name IN ('Right', 'RCLeft')""")
def primer_pairs_outer(spark, sf_dir):
    return pairs.primer_pairs(matches_of(spark, sf_dir), 3, outer=True)


@query(f"""WITH {_MATCHES}, p(query_name, distance_max, orientation) AS (VALUES ('Right', 40, 'direct'), ('Barcode1', 15, 'reverse')),
c AS (SELECT *, count(*) OVER (PARTITION BY seq_id) AS n FROM matches)
SELECT DISTINCT seq_id, position + length AS start_pos, position + length + distance_max AS end_pos, orientation FROM c JOIN p USING (query_name) WHERE n >= 3""")
def primer_window(spark, sf_dir):
    return pairs.primer_windows(matches_of(spark, sf_dir), primer_rules(spark, PRIMERS))


@query(f"""WITH {_PAIRS}, {_RULES}, r AS (SELECT DISTINCT seq_id, gap, position + length AS a, next_position AS b, orientation FROM pairs JOIN rules USING (query_name, next_name)
WHERE n_matches >= 3 AND gap BETWEEN 0 AND 5) SELECT gap, count(*) AS n_regions, count(DISTINCT seq_id) AS n_reads FROM r GROUP BY gap""")
def junction_sweep(spark, sf_dir):
    return pairs.junction_sweep(matches_of(spark, sf_dir), neighbour_rules(spark, RULES), 5)


@query(f"""WITH {_PAIRS} SELECT seq_id, query_name, position, length FROM pairs WHERE gap >= 25
UNION ALL SELECT seq_id, next_name, next_position, next_length FROM pairs WHERE gap >= 25""")
def adjacent_gap_filter(spark, sf_dir):
    return pairs.gap_filter(matches_of(spark, sf_dir), 25)


@query(f"WITH {_MATCHES}, c AS (SELECT *, count(*) OVER (PARTITION BY seq_id) AS n FROM matches) SELECT seq_id, count(*) AS n FROM c WHERE n >= 40 GROUP BY seq_id")
def enough_matches(spark, sf_dir):
    return pairs.at_least(matches_of(spark, sf_dir), 40).groupBy("seq_id").agg(F.count("*").alias("n"))


@query(f"""WITH {_MATCHES}, s AS (SELECT seq_id, bool_or(query_name = 'Left') AND bool_or(query_name = 'Right') AS direct, bool_or(query_name = 'RCLeft') AND bool_or(query_name = 'RCRight') AS reverse FROM matches GROUP BY seq_id)
SELECT * FROM s WHERE direct OR reverse""")
def valid_reads(spark, sf_dir):
    return pairs.reads_with_all(matches_of(spark, sf_dir), ["Left", "Right"], ["RCLeft", "RCRight"])


@query(f"""WITH {_READS} SELECT seq_id, 'r' || seq_id AS read_id, seq, 'direct' AS orientation FROM reads WHERE seq_id IN (SELECT doc_id FROM labels WHERE quality = 1)
UNION ALL SELECT seq_id, 'r' || seq_id || '_RC', reverse(translate(seq, 'ATGC', 'TACG')), 'reverse' FROM reads WHERE seq_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def select_rc(spark, sf_dir):
    reads = reads_of(spark, sf_dir).select("seq_id", F.concat(F.lit("r"), F.col("seq_id").cast("string")).alias("read_id"), "seq", F.col("seq").alias("qual"))
    labels = _table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "seq_id")
    return pairs.selected_reads(reads, labels.where("quality = 1"), labels.where("toxic = 1"), key="seq_id").drop("qual")


@query(f"""WITH {_PAIRS}, {_RULES}, r AS (SELECT DISTINCT seq_id, position AS a, next_position + next_length AS b, orientation FROM pairs JOIN rules USING (query_name, next_name) WHERE n_matches >= 3 AND gap BETWEEN 0 AND 20)
SELECT seq_id, a AS start_pos, b AS end_pos, CASE WHEN orientation = 'reverse' THEN reverse(translate(substring(seq, a + 1, b - a), 'ATGC', 'TACG')) ELSE substring(seq, a + 1, b - a) END AS seq
FROM r JOIN reads USING (seq_id)""")
def trim(spark, sf_dir):
    regions = pairs.junctions(matches_of(spark, sf_dir), neighbour_rules(spark, RULES), 0, 20, include=True)
    reads = reads_of(spark, sf_dir).withColumn("qual", F.col("seq"))
    return pairs.trimmed(reads, regions, renumber=False).select("seq_id", "start_pos", "end_pos", "seq")


_TRIMMED = f"""WITH {_PAIRS}, {_RULES}, r AS (SELECT DISTINCT seq_id, position AS a, next_position + next_length AS b, orientation FROM pairs JOIN rules USING (query_name, next_name) WHERE n_matches >= 3 AND gap BETWEEN 0 AND 20),
t AS (SELECT seq_id, a AS start_pos, b AS end_pos, CASE WHEN orientation = 'reverse' THEN reverse(translate(substring(seq, a + 1, b - a), 'ATGC', 'TACG')) ELSE substring(seq, a + 1, b - a) END AS seq FROM r JOIN reads USING (seq_id))"""


@query(f"{_TRIMMED} SELECT CAST(row_number() OVER (ORDER BY seq_id, start_pos, end_pos) AS VARCHAR) AS read_id, seq_id, start_pos, end_pos, seq FROM t")
def trim_renumbered(spark, sf_dir):
    regions = pairs.junctions(matches_of(spark, sf_dir), neighbour_rules(spark, RULES), 0, 20, include=True)
    reads = reads_of(spark, sf_dir).withColumn("qual", F.col("seq"))
    return pairs.trimmed(reads, regions).select("read_id", "seq_id", "start_pos", "end_pos", "seq")


@query(f"WITH {_READS} SELECT row_number() OVER (ORDER BY seq_id) - 1 AS rec_no, 'r' || seq_id AS read_id, 'r' || seq_id || ' of ' || coalesce(barcode, 'none') AS description, seq, seq AS qual FROM reads WHERE seq <> ''")
def fastq_round_trip(spark, sf_dir):
    """Reads as the numbered lines of a FASTQ file, and back."""
    reads = reads_of(spark, sf_dir).where("seq <> ''")
    name = F.concat(F.lit("r"), F.col("seq_id").cast("string"))
    numbered = pairs.numbered(reads.select("seq_id", name.alias("read_id"), F.concat(name, F.lit(" of "), F.coalesce("barcode", F.lit("none"))).alias("description"), "seq", F.col("seq").alias("qual")), ["seq_id"], "rec")
    lines = numbered.select("rec", fastq.fastq_line().alias("value")).select("rec", F.posexplode(F.split("value", "\n")).alias("k", "line"))
    return fastq.fastq_records(lines.select(((F.col("rec").cast("long") - 1) * 4 + F.col("k")).alias("no"), "line"))


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/seqframe-{uuid.uuid4().hex}"


_NAMED = f"WITH {_READS}, named AS (SELECT row_number() OVER (ORDER BY seq_id) - 1 AS rec_no, 'r' || seq_id AS read_id, seq FROM reads WHERE seq <> '')"


def _numbered_reads(spark, sf_dir):
    reads = reads_of(spark, sf_dir).where("seq <> ''").select("seq_id", F.concat(F.lit("r"), F.col("seq_id").cast("string")).alias("read_id"), "seq", F.col("seq").alias("qual"))
    return pairs.numbered(reads, ["seq_id"], "n").withColumns({"rec_no": F.col("n").cast("long") - 1, "description": F.col("read_id")})


@query(f"{_NAMED} SELECT rec_no, read_id, read_id AS description, seq, seq AS qual FROM named")
def fastq_files(spark, sf_dir):
    """Reads written as FASTQ and read back, in order."""
    path = _folder(spark)
    fastq.write_fastq(_numbered_reads(spark, sf_dir), path)
    return fastq.read_fastq(spark, path)


@query(f"{_NAMED} SELECT rec_no, read_id AS id, read_id AS description, seq FROM named")
def fasta_files(spark, sf_dir):
    path = _folder(spark)
    fastq.write_fasta(_numbered_reads(spark, sf_dir), path)
    return fastq.read_fasta(spark, path)


@query(f"WITH {_MATCHES} SELECT seq_id::VARCHAR AS seq_id, query_name, position, length::SMALLINT AS length, score::FLOAT AS score FROM matches")
def match_files(spark, sf_dir):
    path = _folder(spark)
    tables.write_matches(matches_of(spark, sf_dir), path)
    return tables.read_matches(spark, path)


@query(f"WITH {_MATCHES} SELECT seq_id, query_name, position, length FROM matches")
def csv_files(spark, sf_dir):
    path = _folder(spark)
    tables.write_csv(matches_of(spark, sf_dir).select("seq_id", "query_name", "position", "length"), path)
    return tables.read_csv(spark, path, "seq_id long, query_name string, position int, length int")


@query(f"WITH {_MATCHES} SELECT query_name, count(*) AS n, min(position) AS first FROM matches GROUP BY 1")
def report_files(spark, sf_dir):
    """Reports are JSON lines."""
    path = _folder(spark)
    found = matches_of(spark, sf_dir).groupBy("query_name").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    tables.write_report(found, path)
    return spark.read.schema("query_name string, n long, first int").json(path)


_LONG_VECTORS = "SELECT vec_id, CAST(k AS INTEGER) AS k, v FROM (SELECT vec_id, unnest({v}) AS v, unnest(range(len(embedding))) AS k FROM embeddings)"


@query(_LONG_VECTORS.format(v="list_transform(embedding, lambda e: e::DOUBLE)"))
def embedding_files(spark, sf_dir):
    """Embeddings as columns e0, e1, ... of Parquet, and as arrays again."""
    path, rows = _folder(spark), features_of(spark, sf_dir)
    size = rows.agg(F.max(F.size("features"))).first()[0] or 0
    tables.write_embeddings(tables.wide(rows, size, key="vec_id"), path)
    return tables.narrow(spark.read.parquet(path), key="vec_id").select("vec_id", F.posexplode("features").alias("k", "v"))


@query(f"SELECT CAST(k AS INTEGER) AS k, v, count(*) AS n FROM ({_LONG_VECTORS.format(v='list_transform(embedding, lambda e: (round(e::DOUBLE, 3) + 0.0::DOUBLE)::FLOAT)')}) GROUP BY 1, 2")
def vector_files(spark, sf_dir):
    """Vectors as lines of text. They have no keys, so that values are counted by place."""
    path = _folder(spark)
    features_of(spark, sf_dir).select(F.concat_ws(", ", F.transform("features", lambda x: (F.round(x, 3) + F.lit(0.0)).cast("string"))).alias("value")).write.text(path)
    return tables.read_vectors(spark, path).select(F.posexplode("features").alias("k", "v")).groupBy("k", "v").agg(F.count("*").alias("n"))


@query("SELECT vec_id, label AS cluster FROM embeddings")
def cluster_files(spark, sf_dir):
    path = _folder(spark)
    tables.write_clusters(features_of(spark, sf_dir), path, key="vec_id")
    return tables.read_csv(spark, f"{path}/csv", "vec_id long, cluster int").join(spark.read.parquet(f"{path}/parquet").select("vec_id", "cluster"), ["vec_id", "cluster"])


@query(f"WITH {_MATCHES} SELECT seq_id, CAST(row_number() OVER (ORDER BY seq_id) AS VARCHAR) AS n FROM (SELECT DISTINCT seq_id FROM matches)")
def distinct_reads(spark, sf_dir):
    """Ids of the reads with matches, and their place in order."""
    return pairs.numbered(matches_of(spark, sf_dir).select("seq_id").distinct(), ["seq_id"], "n").select("seq_id", "n")


@query(f"""WITH {_READS}, n AS (SELECT *, (row_number() OVER (ORDER BY seq_id) - 1) // 100 AS page FROM reads)
SELECT CAST(page AS BIGINT) AS page, count(*) AS n_reads, min(seq_id) AS first_id, max(seq_id) AS last_id, CAST(sum(length(seq)) AS BIGINT) AS bases FROM n GROUP BY page""")
def read_pages(spark, sf_dir):
    """Reads in order, a hundred to a page."""
    rows = pairs.numbered(reads_of(spark, sf_dir).select("seq_id", F.length("seq").alias("n")), ["seq_id"], "at")
    page = F.expr("(cast(at as bigint) - 1) div 100")
    return rows.groupBy(page.alias("page")).agg(F.count("*").alias("n_reads"), F.min("seq_id").alias("first_id"), F.max("seq_id").alias("last_id"), F.sum("n").alias("bases"))


@query(f"WITH {_READS} SELECT seq_id, length(seq)::INTEGER AS n FROM reads ORDER BY length(seq) DESC, seq_id LIMIT 25")
def longest_reads(spark, sf_dir):
    """A report of the 25 longest."""
    return reads_of(spark, sf_dir).select("seq_id", F.length("seq").alias("n")).orderBy(F.desc("n"), "seq_id").limit(25)


@query(f"WITH {_PAIRS} SELECT query_name || ' → ' || next_name AS pair, '...' || right(query_name, 8) AS short, count(*) AS n FROM pairs GROUP BY 1, 2")
def pair_labels(spark, sf_dir):
    rows = pairs.adjacent(matches_of(spark, sf_dir)).select(S.pair_label("query_name", "next_name").alias("pair"), S.short_label("query_name").alias("short"))
    return rows.groupBy("pair", "short").agg(F.count("*").alias("n"))


@query(f"WITH {_MATCHES} SELECT query_name, n, round_even(n * 100.0::DOUBLE / sum(n) OVER (), 1) AS percent FROM (SELECT query_name, count(*) AS n FROM matches GROUP BY 1)")
def motif_percent(spark, sf_dir):
    counts = matches_of(spark, sf_dir).groupBy("query_name").agg(F.count("*").alias("n"))
    return counts.crossJoin(counts.agg(F.sum("n").alias("all"))).select("query_name", "n", S.percent(F.col("n"), F.col("all"), 1).alias("percent"))


# Statistics


@query(f"""WITH {_MATCHES}, n AS (SELECT barcode, count(DISTINCT seq_id) AS n_reads FROM reads GROUP BY barcode)
SELECT m.barcode, query_name, count(*) AS n, round(avg(score), 6) AS avg_score, round(avg(length), 6) AS avg_length, n_reads FROM matches m JOIN n USING (barcode) GROUP BY m.barcode, query_name, n_reads""")
def barcode_stats(spark, sf_dir):
    out = stats.barcode_statistics(matches_of(spark, sf_dir, True), reads_of(spark, sf_dir))
    return out.withColumns({"avg_score": F.round("avg_score", 6), "avg_length": F.round("avg_length", 6)})


@query(f"WITH {_READS} SELECT seq_id, seq FROM (SELECT *, abs((length(seq) - avg(length(seq)) OVER ()) / stddev_pop(length(seq)) OVER ()) AS z FROM reads) WHERE z < 2")
def length_outliers(spark, sf_dir):
    return stats.length_outliers(reads_of(spark, sf_dir)).select("seq_id", "seq")


@query(f"WITH {_READS} SELECT count(*) AS n_reads, min(length(seq)) AS shortest, max(length(seq)) AS longest, CAST(sum(length(seq)) AS BIGINT) AS bases FROM reads")
def length_summary(spark, sf_dir):
    out = stats.length_summary(reads_of(spark, sf_dir))
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("shortest", "longest")})


@query(f"""WITH {_PAIRS} SELECT query_name, count(gap) AS n, round(avg(gap), 6) AS mean, round(stddev_samp(gap), 6) AS std, min(gap) AS min, quantile_cont(gap, 0.25) AS q25, quantile_cont(gap, 0.5) AS q50, quantile_cont(gap, 0.75) AS q75, max(gap) AS max FROM pairs GROUP BY 1""")
def describe(spark, sf_dir):
    out = stats.describe(pairs.adjacent(matches_of(spark, sf_dir)), "gap", ["query_name"])
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(f"""WITH {_PAIRS}, e AS (SELECT min(gap)::DOUBLE AS lo, max(gap)::DOUBLE AS hi FROM pairs)
SELECT CAST(least(floor((gap - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM pairs, e GROUP BY 1""")
def histogram(spark, sf_dir):
    return stats.histogram(pairs.adjacent(matches_of(spark, sf_dir)), "gap", 20)


@query(f"""WITH {_PAIRS}, q AS (SELECT query_name, quantile_cont(gap, 0.25) AS q25, quantile_cont(gap, 0.5) AS q50, quantile_cont(gap, 0.75) AS q75 FROM pairs GROUP BY 1)
SELECT p.query_name, q25, q50, q75, min(gap) FILTER (gap BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS low, max(gap) FILTER (gap BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS high,
count(*) FILTER (gap NOT BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS outliers FROM pairs p JOIN q ON p.query_name = q.query_name GROUP BY ALL""")
def box_stats(spark, sf_dir):
    return stats.box_statistics(pairs.adjacent(matches_of(spark, sf_dir)), "gap", ["query_name"])


def _feature_sql(n: str) -> str:
    at = f"FILTER (query_name = '{n}')"
    return f"round(coalesce(avg(position / w) {at}, 0), 9) AS \"{n}_pos\", round(coalesce(stddev_pop(position / w) {at}, 0), 9) AS \"{n}_std\", round(coalesce(avg(score) {at}, 0), 9) AS \"{n}_score\", round(coalesce(avg(length) {at}, 0), 9) AS \"{n}_len\""


@query(f"WITH {_MATCHES}, w AS (SELECT max(position + length)::DOUBLE AS w FROM matches) SELECT seq_id, {', '.join(map(_feature_sql, NAMES))} FROM matches, w GROUP BY seq_id")
def features(spark, sf_dir):
    out = stats.features(matches_of(spark, sf_dir), NAMES)
    return out.select("seq_id", *[_r(c, c, 9) for c in out.columns if c != "seq_id"])


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 5) AS l_quantity, round((l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER (), 5) AS l_tax FROM lineitem")
def standardized(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    out = stats.standardized(rows, ["l_quantity", "l_tax"])
    return out.select("l_orderkey", "l_linenumber", _r("l_quantity", "l_quantity", 5), _r("l_tax", "l_tax", 5))


@query(f"WITH {_MATCHES} SELECT count(DISTINCT seq_id) AS n_reads, count(DISTINCT query_name) AS n_motifs, count(*) AS n_matches FROM matches")
def distinct_counts(spark, sf_dir):
    return stats.distinct_counts(matches_of(spark, sf_dir))


@query(f"WITH {_MATCHES} SELECT DISTINCT query_name FROM matches")
def distinct_motifs(spark, sf_dir):
    return stats.distinct_motifs(matches_of(spark, sf_dir))


# Embeddings


@query(f"""WITH {_MATCHES} SELECT seq_id, {', '.join(f"coalesce(min(position) FILTER (query_name = '{n}'), 0) AS \"{n}\"" for n in NAMES)} FROM matches GROUP BY seq_id""")
def direct_embedding(spark, sf_dir):
    return embed.direct(matches_of(spark, sf_dir), NAMES)


@query(f"WITH {_MATCHES} SELECT seq_id, string_agg(query_name || '@' || (position // 10), ' ' ORDER BY position, query_name) AS tokens FROM matches GROUP BY seq_id")
def tokens(spark, sf_dir):
    return embed.token_sequences(matches_of(spark, sf_dir), bucket=10).select("seq_id", F.array_join("tokens", " ").alias("tokens"))


@query(f"WITH {_MATCHES} SELECT seq_id, query_name, position, " + ", ".join(f"round({'sin' if i % 2 == 0 else 'cos'}(position / pow(10000.0::DOUBLE, {i - i % 2} / 10.0::DOUBLE)), 6) AS e{i}" for i in range(10)) + " FROM matches")
def pos_encoding(spark, sf_dir):
    rows = matches_of(spark, sf_dir).withColumn("e", S.positional_encoding("position", 10))
    return rows.select("seq_id", "query_name", "position", *[_r(F.col("e")[i], f"e{i}") for i in range(10)])


@query(f"WITH {_MATCHES} SELECT seq_id, query_name, position, 1.0::DOUBLE - 0.9::DOUBLE * (position - min(position) OVER w) / greatest((max(position) OVER w - min(position) OVER w)::DOUBLE, 1e-6::DOUBLE) AS weight FROM matches WINDOW w AS (PARTITION BY seq_id)")
def pos_weight(spark, sf_dir):
    from pyspark.sql import Window

    by = Window.partitionBy("seq_id")
    weight = S.position_weight(F.col("position"), F.min("position").over(by), F.max("position").over(by).cast("double"))
    return matches_of(spark, sf_dir).select("seq_id", "query_name", "position", weight.alias("weight"))


@query(f"WITH {_PAIRS} SELECT seq_id, string_agg(query_name, ',' ORDER BY position, query_name) AS names, string_agg(start_delta, ',' ORDER BY position, query_name) AS distances FROM (SELECT *, next_position - position AS start_delta FROM near) GROUP BY seq_id")
def names_and_distances(spark, sf_dir):
    rows = embed.queries_and_distances(matches_of(spark, sf_dir))
    text = F.array_join(F.transform("distances", lambda d: d.cast("string")), ",")
    return rows.select("seq_id", F.array_join("names", ",").alias("names"), F.when(F.size("distances") > 0, text).alias("distances"))


@query(f"""WITH {_READS}, n AS (SELECT query_name, row_number() OVER (ORDER BY query_name) AS id FROM (SELECT DISTINCT unnest(string_split(seq, '')) AS query_name FROM reads) WHERE query_name <> ''),
c AS (SELECT seq_id, unnest(string_split(seq, '')) AS query_name, unnest(range(length(seq))) AS k FROM reads WHERE seq <> ''),
j AS (SELECT seq_id, string_agg(coalesce(id + 1, 1), ',' ORDER BY k) AS ids FROM c LEFT JOIN n USING (query_name) GROUP BY seq_id)
SELECT seq_id, coalesce(ids, '') AS ids FROM reads LEFT JOIN j USING (seq_id)""")
def vocab_encode(spark, sf_dir):
    return _encoded(spark, sf_dir)[0].select("seq_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


def _encoded(spark, sf_dir):
    reads = reads_of(spark, sf_dir)
    vocabulary = {r["char"]: r["id"] for r in embed.char_vocabulary(reads).collect()}  # one row to a letter
    return embed.encode_chars(reads, vocabulary, None), vocabulary


@query(f"WITH {_READS} SELECT seq_id, seq FROM reads")
def vocab_decode(spark, sf_dir):
    encoded, vocabulary = _encoded(spark, sf_dir)
    return embed.decode_chars(encoded, vocabulary)


@query(f"WITH {_MATCHES} SELECT seq_id, query_name, position, CASE WHEN max(position) OVER w = 0 THEN 0 ELSE position::DOUBLE / max(position) OVER w END AS relative FROM matches WINDOW w AS (PARTITION BY seq_id)")
def relative_positions(spark, sf_dir):
    from pyspark.sql import Window

    last = F.max("position").over(Window.partitionBy("seq_id"))
    return matches_of(spark, sf_dir).select("seq_id", "query_name", "position", S.relative_position(F.col("position"), last).alias("relative"))


@query("SELECT vec_id, CAST(k AS INTEGER) AS k, v FROM (SELECT vec_id, unnest(list_transform(embedding, lambda e: (e::DOUBLE * 3)::FLOAT)) AS v, unnest(range(len(embedding))) AS k FROM embeddings)")
def float_cast(spark, sf_dir):
    rows = features_of(spark, sf_dir).select("vec_id", F.transform("features", lambda x: (x * 3).cast("float")).alias("features"))
    return rows.select("vec_id", F.posexplode("features").alias("k", "v"))


@query(f"""WITH {_READS}, {_PLACES}, c AS (SELECT seq_id, substring(seq, i + 1, 3) AS kmer, count(*) AS n FROM places WHERE i <= length(seq) - 3 GROUP BY 1, 2)
SELECT seq_id, kmer, round(n::DOUBLE / sum(n) OVER (PARTITION BY seq_id), 9) AS share FROM c""")
def kmer_shares(spark, sf_dir):
    return embed.kmer_shares(reads_of(spark, sf_dir), 3).withColumn("share", F.round("share", 9))


@query()
def word2vec_tokens(spark, sf_dir):
    sequences = embed.token_sequences(matches_of(spark, sf_dir), bucket=10)
    return embed.embed_tokens(sequences, embed.word_model(sequences))


def _named(spark, sf_dir):
    matches = matches_of(spark, sf_dir)
    return matches, embed.word_model(embed.name_sequences(matches), size=16)


@query()
def word2vec_names(spark, sf_dir):
    matches, model = _named(spark, sf_dir)
    return embed.embed_tokens(embed.name_sequences(matches), model)


@query()
def positional_embedding(spark, sf_dir):
    return embed.embed_positional(*_named(spark, sf_dir))


@query()
def weighted_embedding(spark, sf_dir):
    return embed.embed_weighted(*_named(spark, sf_dir))


@query()
def kmer_frequencies(spark, sf_dir):
    return embed.kmer_frequencies(reads_of(spark, sf_dir), 3)


@query()
def projected_embedding(spark, sf_dir):
    return embed.projected(matches_of(spark, sf_dir), size=8)


# Motifs

_PWM = f"""{_READS}, long AS (SELECT unnest(range(m)) AS pos, seq FROM reads, (SELECT min(length(seq)) AS m FROM reads)),
counts AS (SELECT pos, base, count(*) FILTER (substring(seq, pos + 1, 1) = base) AS n FROM long, (VALUES ('A'), ('C'), ('G'), ('T')) b(base) GROUP BY pos, base)"""


def _weights(spark, sf_dir):
    return motif.position_weights(reads_of(spark, sf_dir))


@query(f"WITH {_PWM} SELECT CAST(pos AS INTEGER) AS pos, base, n, round(n / (SELECT count(*) FROM reads)::DOUBLE, 9) AS freq FROM counts")
def pwm(spark, sf_dir):
    return _weights(spark, sf_dir).withColumn("freq", F.round("freq", 9))


@query(f"WITH {_PWM} SELECT string_agg(base, '' ORDER BY pos) AS consensus FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY n DESC, base) AS r FROM counts) WHERE r = 1")
def consensus(spark, sf_dir):
    return motif.consensus_sequence(_weights(spark, sf_dir)).select(F.when(F.col("consensus") != "", F.col("consensus")).alias("consensus"))


@query(f"WITH {_PWM} SELECT CAST(pos AS INTEGER) AS pos, base, n FROM (SELECT *, max(n) OVER (PARTITION BY pos) AS top FROM counts) WHERE n > 0.5 * top")
def consensus_sets(spark, sf_dir):
    return motif.consensus_sets(_weights(spark, sf_dir))


@query(f"""WITH {_PWM}, s AS (SELECT pos, base FROM (SELECT *, max(n) OVER (PARTITION BY pos) AS top FROM counts) WHERE n > 0.5 * top)
SELECT a.pos || '_' || a.base AS source, b.pos || '_' || b.base AS target, 1 AS value FROM s a JOIN s b ON b.pos = a.pos + 1""")
def motif_graph(spark, sf_dir):
    return motif.motif_graph(motif.consensus_sets(_weights(spark, sf_dir)))[1]


@query(f"""WITH {_READS}, e AS (SELECT min(length(seq)) AS d FROM reads),
c AS (SELECT k, substring(seq, 1, k) AS motif, substring(seq, 1, k - 1) AS parent, count(*) AS n FROM (SELECT seq, unnest(range(1, d + 1)) AS k FROM reads, e) WHERE substring(seq, k, 1) IN ('A', 'C', 'G', 'T') GROUP BY 1, 2, 3),
ok AS (SELECT k, motif, n FROM (SELECT *, max(n) OVER (PARTITION BY k, parent) AS top FROM c) WHERE n >= top * (1 - 0.1))
SELECT t.motif, t.n FROM ok t JOIN ok p ON p.motif = substring(t.motif, 1, p.k), e WHERE t.k = d GROUP BY t.motif, t.n, d HAVING count(*) = d""")
def motif_tree(spark, sf_dir):
    """As deep as the shortest read is long."""
    reads = reads_of(spark, sf_dir)
    return motif.motif_tree(reads, reads.agg(F.min(F.length("seq"))).first()[0] or 0)


# Streams


@query("""WITH e AS (SELECT user_id, event_type, event_id, epoch_ms(ts) AS ms FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
o AS (SELECT *, lag(ms) OVER w AS prior, lag(event_type) OVER w AS prior_type FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id, event_type)),
s AS (SELECT *, sum(CASE WHEN prior IS NULL OR prior_type = 'purchase' OR ms - prior > 21600000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, event_id, event_type) AS g FROM o),
r AS (SELECT user_id, g, count(*) FILTER (event_type <> 'purchase') AS n, string_agg(event_type, ',' ORDER BY event_id, event_type) FILTER (event_type <> 'purchase') AS names, bool_or(event_type = 'purchase') AS complete, max(ms) AS last_at FROM s GROUP BY user_id, g)
SELECT user_id AS seq_id, n, coalesce(names, '') AS names, complete FROM r WHERE complete OR last_at + 21600000 < (SELECT max(ms) - 3600000 FROM e) OR g < (SELECT max(g) FROM r q WHERE q.user_id = r.user_id)""")
def stream_reads(spark, sf_dir):
    """Events as a stream of matches: users are reads, purchases end them, and six hours without an event do."""
    path = f"{sf_dir}/[e]vents.parquet"  # a pattern may name a file, of which a stream takes no path
    stream = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(path)
    rows = stream.select(F.col("user_id").alias("seq_id"), F.col("event_type").alias("query_name"), F.col("event_id").alias("position"), F.col("ts").cast("timestamp").alias("ts"))
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in streaming.STATE_STORE}
    try:
        for k, v in streaming.STATE_STORE.items():
            spark.conf.set(k, v)
        found = streaming.expiring_reads(rows, late="1 hour", wait=21_600, end="purchase")
        found.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    return spark.read.schema(found.schema).parquet(f"{out}/rows")


# The same over reads that are aligned at a motif: its first 20 letters from each occurrence on

_ALIGNED = f"{_MATCHES}, at_motif AS (SELECT substring(r.seq, position + 1, 20) AS seq FROM matches JOIN reads r USING (seq_id) WHERE query_name = 'Left' AND length(r.seq) >= position + 20)"
_ALIGNED_PWM = f"""{_ALIGNED}, counts AS (SELECT pos, base, count(*) FILTER (substring(seq, pos + 1, 1) = base) AS n FROM (SELECT seq, unnest(range(20)) AS pos FROM at_motif),
(VALUES ('A'), ('C'), ('G'), ('T')) b(base) GROUP BY pos, base)"""
_ALIGNED_SETS = f"{_ALIGNED_PWM}, s AS (SELECT pos, base, n FROM (SELECT *, max(n) OVER (PARTITION BY pos) AS top FROM counts) WHERE n > 0.8 * top)"


def _windows(spark, sf_dir):
    return motif.windows(reads_of(spark, sf_dir), MOTIFS["Left"], 20)


@query(f"WITH {_ALIGNED_PWM} SELECT CAST(pos AS INTEGER) AS pos, base, n, round(n / (SELECT count(*) FROM at_motif)::DOUBLE, 9) AS freq FROM counts")
def pwm_at_motif(spark, sf_dir):
    return motif.position_weights(_windows(spark, sf_dir)).withColumn("freq", F.round("freq", 9))


@query(f"WITH {_ALIGNED_PWM} SELECT string_agg(base, '' ORDER BY pos) AS consensus FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY n DESC, base) AS r FROM counts) WHERE r = 1")
def consensus_at_motif(spark, sf_dir):
    return motif.consensus_sequence(motif.position_counts(_windows(spark, sf_dir)))


@query(f"WITH {_ALIGNED_SETS} SELECT CAST(pos AS INTEGER) AS pos, base, n FROM s")
def consensus_sets_at_motif(spark, sf_dir):
    return motif.consensus_sets(motif.position_counts(_windows(spark, sf_dir)), 0.8)


@query(f"WITH {_ALIGNED_SETS} SELECT a.pos || '_' || a.base AS source, b.pos || '_' || b.base AS target, 1 AS value FROM s a JOIN s b ON b.pos = a.pos + 1")
def motif_graph_at_motif(spark, sf_dir):
    return motif.motif_graph(motif.consensus_sets(motif.position_counts(_windows(spark, sf_dir)), 0.8))[1]


@query(f"""WITH {_ALIGNED}, c AS (SELECT k, substring(seq, 1, k) AS motif, substring(seq, 1, k - 1) AS parent, count(*) AS n FROM (SELECT seq, unnest(range(1, 21)) AS k FROM at_motif) GROUP BY 1, 2, 3),
ok AS (SELECT k, motif, n FROM (SELECT *, max(n) OVER (PARTITION BY k, parent) AS top FROM c) WHERE n >= top * (1 - 0.3))
SELECT t.motif, t.n FROM ok t JOIN ok p ON p.motif = substring(t.motif, 1, p.k) WHERE t.k = 20 GROUP BY t.motif, t.n HAVING count(*) = 20""")
def motif_tree_at_motif(spark, sf_dir):
    return motif.motif_tree(_windows(spark, sf_dir), 20, 0.3)


# Clusters


@query(f"WITH {_FEATURES} SELECT cluster, count(DISTINCT vec_id) AS n_reads FROM x GROUP BY cluster")
def cluster_sizes(spark, sf_dir):
    return stats.cluster_sizes(features_of(spark, sf_dir), "vec_id")


@query(f"WITH {_FEATURES}, s AS (SELECT cluster, count(DISTINCT vec_id) AS n FROM x GROUP BY cluster) SELECT CAST(sum(n) AS BIGINT) AS n_reads, count(*) AS n_clusters, round(avg(n), 6) AS mean_size, max(n) AS max_size FROM s")
def cluster_summary(spark, sf_dir):
    return stats.cluster_summary(features_of(spark, sf_dir), "vec_id").withColumn("mean_size", F.round("mean_size", 6))


@query(f"WITH {_FEATURES}, s AS (SELECT cluster, count(*) AS n FROM x GROUP BY cluster ORDER BY n DESC, cluster LIMIT 3) SELECT vec_id, cluster FROM x WHERE cluster IN (SELECT cluster FROM s)")
def top_clusters(spark, sf_dir):
    return stats.top_clusters(features_of(spark, sf_dir), 3, "vec_id").select("vec_id", "cluster")


@query(f"WITH {_CENTRES} SELECT cluster, round(CASE WHEN count(*) <= 1 THEN 0 ELSE coalesce(avg(d) / nullif(max(d), 0), 0) END, 9) AS diversity FROM away GROUP BY cluster")
def diversity(spark, sf_dir):
    return cluster.diversity(features_of(spark, sf_dir)).withColumn("diversity", F.round("diversity", 9))


@query(f"WITH {_CENTRES} SELECT cluster, arg_min(vec_id, d) AS vec_id FROM away GROUP BY cluster")
def rep_centroid(spark, sf_dir):
    return cluster.nearest_to_centroid(features_of(spark, sf_dir), key="vec_id")


_NEAREST = f"""WITH {_FEATURES}, p AS (SELECT a.vec_id AS i, a.cluster AS ci, b.vec_id AS j, b.cluster AS cj, list_distance(a.features, b.features) AS d FROM x a JOIN x b ON a.vec_id <> b.vec_id)"""


@query(f"{_NEAREST} SELECT round(quantile_cont(d, 0.9), 6) AS p90 FROM (SELECT i, min(d) AS d FROM p GROUP BY i)")
def nn_percentile(spark, sf_dir):
    found = stats.quantile(cluster.neighbours(features_of(spark, sf_dir), 1, key="vec_id"), "distance", 0.9)
    return spark.createDataFrame([(found,)], "p90 double").select(_r("p90", "p90"))


_SILHOUETTE = f"""{_NEAREST}, m AS (SELECT i, ci, cj, avg(d) AS d FROM p GROUP BY 1, 2, 3), n AS (SELECT cluster, count(*) AS n FROM x GROUP BY 1),
s AS (SELECT i, ci, coalesce(max(d) FILTER (ci = cj), 0) AS a, min(d) FILTER (ci <> cj) AS b FROM m GROUP BY 1, 2)
SELECT i AS vec_id, ci AS cluster, round(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM s JOIN n ON ci = cluster"""


@query(_SILHOUETTE)
def silhouette(spark, sf_dir):
    return cluster.silhouettes(features_of(spark, sf_dir), key="vec_id").withColumn("silhouette", F.round("silhouette", 6))


@query(f"SELECT cluster, round(avg(silhouette), 5) AS silhouette FROM ({_SILHOUETTE}) GROUP BY cluster")
def silhouette_by_cluster(spark, sf_dir):
    return cluster.silhouette_by_cluster(features_of(spark, sf_dir), key="vec_id").withColumn("silhouette", F.round("silhouette", 5))


@query(f"""WITH {_CENTRES}, r AS (SELECT cluster, arg_min(vec_id, d) AS rep FROM away GROUP BY cluster), f AS (SELECT rep, features AS g FROM r JOIN x ON rep = vec_id)
SELECT vec_id, arg_min(rep, list_distance(features, g)) AS rep, round(min(list_distance(features, g)), 6) AS distance FROM x, f GROUP BY vec_id""")
def nearest_rep(spark, sf_dir):
    table = features_of(spark, sf_dir)
    reps = table.join(cluster.nearest_to_centroid(table, key="vec_id").select("vec_id"), "vec_id", "left_semi")
    return cluster.nearest_representative(table, reps, key="vec_id").withColumn("distance", F.round("distance", 6))


@query()
def kmeans_clusters(spark, sf_dir):
    return cluster.kmeans(features_of(spark, sf_dir).drop("cluster"), 10, key="vec_id")[0]


@query()
def ward_pipeline(spark, sf_dir):
    return cluster.pipeline(features_of(spark, sf_dir).drop("cluster"), 10, key="vec_id")


@query()
def compressed_reads(spark, sf_dir):
    return cluster.compress_reads(stats.features(matches_of(spark, sf_dir), NAMES), 100)


@query()
def ward_clusters(spark, sf_dir):
    """Ward over all points, by rounds of clusters that are each other's nearest."""
    return cluster.ward_clusters(features_of(spark, sf_dir), 10, key="vec_id")


@query(f"""WITH {_READS}, t AS (SELECT seq_id AS n, barcode, seq, repeat('I', length(seq)) AS qual FROM reads WHERE seq <> '')
SELECT barcode, CAST(n AS VARCHAR) AS read_id, seq, qual FROM t""")
def fastq_many_files(spark, sf_dir):
    """FASTQ files in a folder for each barcode, all read at once by their splits."""
    path = f"{shared_dir(spark)}/many-{uuid.uuid4().hex}"
    rows = reads_of(spark, sf_dir).where("seq <> ''").select("barcode", "seq_id", F.col("seq_id").cast("string").alias("read_id"), F.lit(None).cast("string").alias("description"), "seq", F.expr("repeat('I', length(seq))").alias("qual"))
    rows.select("barcode", fastq.fastq_line().alias("value")).write.partitionBy("barcode").text(path)
    found = fastq.read_fastq_files(spark, f"{path}/*/*.txt", path=True)
    return found.select(F.regexp_extract("path", "barcode=([^/]*)/", 1).alias("barcode"), "read_id", "seq", "qual")


@query()
def kmeans_of_components(spark, sf_dir):
    """k-means after a reduction to principal components."""
    return cluster.kmeans(embed.components(features_of(spark, sf_dir).drop("cluster"), 8), 10, key="vec_id")[0]


@query()
def ward_large_tier(spark, sf_dir):
    """The tier of Ward for many points: Ward on the centres of k-means, labels for all."""
    return cluster.ward_tiered(features_of(spark, sf_dir).drop("cluster"), 10, key="vec_id", large=400)


_EPS = 0.8


@query(f"""WITH RECURSIVE x AS (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS f FROM embeddings), near AS (SELECT a.vec_id AS i, b.vec_id AS j FROM x a JOIN x b ON list_distance(a.f, b.f) <= {_EPS}),
core AS (SELECT i FROM near GROUP BY i HAVING count(*) >= 10), edge AS (SELECT i, j FROM near WHERE i IN (SELECT i FROM core) AND j IN (SELECT i FROM core)),
reach(i, root) AS (SELECT i, i FROM core UNION SELECT e.j, r.root FROM reach r JOIN edge e ON e.i = r.i), root AS (SELECT i, min(root) AS root FROM reach GROUP BY i),
number AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM root)), far AS (SELECT n.i, min(root) AS root FROM near n JOIN root r ON n.j = r.i GROUP BY n.i)
SELECT vec_id, CAST(coalesce(cluster, -1) AS INTEGER) AS cluster FROM x LEFT JOIN (SELECT i, coalesce(r.root, f.root) AS root FROM far f LEFT JOIN root r USING (i)) g ON g.i = vec_id LEFT JOIN number USING (root)""")
def dbscan_clusters(spark, sf_dir):
    return cluster.dbscan_blocks(features_of(spark, sf_dir), _EPS, 10, key="vec_id")


def _method(name: str):
    def run(spark, sf_dir):
        return cluster.cluster(features_of(spark, sf_dir).drop("cluster"), name, 10, key="vec_id")

    run.__name__ = f"{name}_clusters"
    return query()(run)


for _name in ("hdbscan", "birch", "optics", "meanshift", "affinity", "spectral"):
    _method(_name)


@query()
def compressed_clusters(spark, sf_dir):
    return cluster.compress(features_of(spark, sf_dir), 100, key="vec_id")


@query()
def mixture_clusters(spark, sf_dir):
    reduced = embed.components(features_of(spark, sf_dir).drop("cluster"), 4)
    return cluster.mixture(reduced, 3, key="vec_id")


# Layout: reads are rows, sources are clusters


def _clustered(spark, sf_dir):
    found = layout.with_query_index(matches_of(spark, sf_dir), queries_df(spark, MOTIFS))
    return layout.with_clusters(found, reads_of(spark, sf_dir).select("seq_id", F.col("barcode").alias("cluster")))


@query(f"WITH {_MATCHES} SELECT DISTINCT barcode AS cluster, query_name, position, length FROM matches")
def merge_compress(spark, sf_dir):
    return layout.merged(_clustered(spark, sf_dir))


@query(f"WITH {_MATCHES}, c AS (SELECT barcode AS cluster, seq_id, count(*) AS n FROM matches GROUP BY 1, 2) SELECT cluster, seq_id, n FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, seq_id) AS r FROM c) WHERE r = 1")
def rep_most_matches(spark, sf_dir):
    return layout.most_matches(_clustered(spark, sf_dir))


@query(f"WITH {_MATCHES} SELECT barcode AS cluster, min(seq_id) AS seq_id FROM matches GROUP BY 1")
def rep_first(spark, sf_dir):
    return layout.first_read(_clustered(spark, sf_dir).withColumn("rec_no", F.col("seq_id")))


@query(f"WITH {_MATCHES} SELECT barcode AS cluster, seq_id, query_name, position, CAST(dense_rank() OVER (ORDER BY barcode, seq_id) - 1 AS INTEGER) AS row FROM matches")
def row_index(spark, sf_dir):
    return layout.row_index(_clustered(spark, sf_dir)).select("cluster", "seq_id", "query_name", "position", "row")


@query("""WITH f AS (SELECT user_id, min(event_id) AS first FROM events GROUP BY user_id), r AS (SELECT user_id, CAST(row_number() OVER (ORDER BY first, user_id) - 1 AS INTEGER) AS row FROM f)
SELECT user_id AS seq_id, event_type AS query_name, event_id AS position, row FROM events JOIN r USING (user_id)""")
def row_first_seen(spark, sf_dir):
    """Rows in the order in which reads are first seen; events stand for matches, users for reads."""
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("seq_id"), F.col("event_type").alias("query_name"), F.col("event_id").alias("position"))
    return layout.row_index(rows, first="position").select("seq_id", "query_name", "position", "row")


@query(f"""WITH {_MATCHES}, n AS (SELECT barcode, count(DISTINCT seq_id) AS n FROM matches GROUP BY 1 ORDER BY n DESC, barcode LIMIT 2)
SELECT barcode AS cluster, seq_id, query_name, position FROM matches WHERE barcode IN (SELECT barcode FROM n)""")
def thinned_matches(spark, sf_dir):
    """The two largest clusters, with as many reads of each as there are."""
    return layout.thinned(_clustered(spark, sf_dir), clusters=2, reads=1 << 30, most=50).select("cluster", "seq_id", "query_name", "position")


@query()
def kmer_word_vectors(spark, sf_dir):
    """Word vectors of 5-mers, and their means over each read."""
    reads = reads_of(spark, sf_dir)
    model = embed.word_model(embed.kmer_sequences(reads), size=16, rounds=1)
    return embed.embed_kmers(reads, model)


@query(f"""WITH {_READS} SELECT CAST(label AS INTEGER) AS cluster, CAST(seq_id AS VARCHAR) AS read_id, seq FROM reads JOIN embeddings ON vec_id = seq_id WHERE seq <> ''""")
def cluster_fastq(spark, sf_dir):
    """Reads of each cluster as FASTQ in a folder of its own, read back by folder."""
    path = f"{shared_dir(spark)}/clusters-{uuid.uuid4().hex}"
    rows = reads_of(spark, sf_dir).where("seq <> ''").select("seq_id", F.col("seq_id").cast("string").alias("read_id"), F.lit(None).cast("string").alias("description"), "seq", F.expr("repeat('I', length(seq))").alias("qual"))
    fastq.write_cluster_fastq(rows, features_of(spark, sf_dir).select(F.col("vec_id").alias("seq_id"), "cluster"), path)
    found = fastq.read_fastq_files(spark, f"{path}/*/*.txt", path=True)
    return found.select(F.regexp_extract("path", "cluster=([0-9]+)/", 1).cast("int").alias("cluster"), "read_id", "seq")


@query(f"""WITH {_MATCHES}, cells AS (SELECT seq_id, unnest(range(position, position + length)) AS pos, query_idx, position FROM matches)
SELECT seq_id, CAST(pos AS INTEGER) AS pos, query_idx FROM (SELECT *, row_number() OVER (PARTITION BY seq_id, pos ORDER BY position DESC, query_idx DESC) AS r FROM cells) WHERE r = 1""")
def raster(spark, sf_dir):
    return layout.raster(_clustered(spark, sf_dir), None, order=["position", "query_idx"]).select("seq_id", "pos", "query_idx")


@query(f"""WITH {_MATCHES}, p AS (SELECT position + length / 2.0 AS x, seq_id AS y, query_name FROM matches), e AS (SELECT min(x)::DOUBLE x0, max(x)::DOUBLE x1, min(y)::DOUBLE y0, max(y)::DOUBLE y1 FROM p)
SELECT CAST(least(floor((x - x0) / (x1 - x0) * 80), 79) AS INTEGER) AS px, CAST(least(floor((y - y0) / (y1 - y0) * 40), 39) AS INTEGER) AS py, query_name, count(*) AS n FROM p, e GROUP BY 1, 2, 3""")
def density(spark, sf_dir):
    points = matches_of(spark, sf_dir).select((F.col("position") + F.col("length") / 2.0).alias("x"), F.col("seq_id").alias("y"), "query_name")
    return layout.density(points, "x", "y", 80, 40, by=["query_name"])


_ROWED = f"{_MATCHES}, rowed AS (SELECT *, dense_rank() OVER (ORDER BY barcode, seq_id) - 1 AS row FROM matches)"


def _rowed(spark, sf_dir):
    return layout.boxes(layout.row_index(_clustered(spark, sf_dir)))


@query(f"WITH {_ROWED} SELECT seq_id, query_name, position AS x_start, position + length AS x_end, (position + position + length) / 2.0::DOUBLE AS x_mid, row - 0.4::DOUBLE AS y_bottom, row + 0.4::DOUBLE AS y_top FROM rowed")
def raw_layout(spark, sf_dir):
    return _rowed(spark, sf_dir).select("seq_id", "query_name", "x_start", "x_end", "x_mid", "y_bottom", "y_top")


@query(f"WITH {_ROWED} SELECT seq_id, query_name, position, position + k * length / 9.0::DOUBLE AS x FROM (SELECT *, unnest(range(10)) AS k FROM rowed)")
def line_points(spark, sf_dir):
    return layout.line_points(_rowed(spark, sf_dir)).select("seq_id", "query_name", "position", "x")


@query(f"""WITH {_ROWED}, e AS (SELECT max(position + length)::DOUBLE AS x1, max(row)::DOUBLE + 1 AS y1 FROM rowed),
p AS (SELECT query_name, CAST(least(floor(row / y1 * 50), 49) AS INTEGER) AS py, CAST(least(floor(position / x1 * 100), 99) AS INTEGER) AS a, CAST(least(floor((position + length - 1) / x1 * 100), 99) AS INTEGER) AS b FROM rowed, e)
SELECT CAST(px AS INTEGER) AS px, py, query_name, count(*) AS n FROM (SELECT query_name, py, unnest(range(a, b + 1)) AS px FROM p) GROUP BY 1, 2, 3""")
def rectangle_density(spark, sf_dir):
    boxed = _rowed(spark, sf_dir)
    x, y = boxed.agg(F.max("x_end"), F.max("row") + 1).first()
    return layout.rectangle_density(boxed, 100, 50, (0, x or 1, 0, y or 1), by=["query_name"])


_GRID = f"""{_MATCHES}, p AS (SELECT position + length / 2.0 AS x, seq_id AS y FROM matches), ends AS (SELECT min(x)::DOUBLE x0, max(x)::DOUBLE x1, min(y)::DOUBLE y0, max(y)::DOUBLE y1 FROM p),
grid AS (SELECT CAST(least(floor((x - x0) / (x1 - x0) * 80), 79) AS INTEGER) AS px, CAST(least(floor((y - y0) / (y1 - y0) * 40), 39) AS INTEGER) AS py, count(*) AS n FROM p, ends GROUP BY 1, 2)"""


def _grid(spark, sf_dir):
    points = matches_of(spark, sf_dir).select((F.col("position") + F.col("length") / 2.0).alias("x"), F.col("seq_id").alias("y"))
    return layout.density(points, "x", "y", 80, 40)


@query(f"WITH {_GRID} SELECT px, py, n, round(ln(1 + n::DOUBLE) / ln(1 + (max(n) OVER ())::DOUBLE), 9) AS level FROM grid")
def shaded_log(spark, sf_dir):
    return layout.shaded(_grid(spark, sf_dir)).select("px", "py", "n", _r("level", "level", 9))


@query(f"WITH {_GRID}, r AS (SELECT n, round(sum(count(*)) OVER (ORDER BY n)::DOUBLE / sum(count(*)) OVER (), 9) AS level FROM grid GROUP BY n) SELECT px, py, n, level FROM grid JOIN r USING (n)")
def shaded_by_rank(spark, sf_dir):
    return layout.shaded(_grid(spark, sf_dir), "eq_hist").select("px", "py", "n", _r("level", "level", 9))


@query(f"""WITH {_GRID}, o AS (SELECT unnest([-1, 0, 1]) AS d) SELECT CAST(px + a.d AS INTEGER) AS px, CAST(py + b.d AS INTEGER) AS py, max(n) AS n FROM grid, o a, o b WHERE px + a.d >= 0 AND py + b.d >= 0 GROUP BY 1, 2""")
def spread_pixels(spark, sf_dir):
    return layout.spread(_grid(spark, sf_dir), 1)


@query(f"WITH {_MATCHES} SELECT DISTINCT barcode AS cluster, seq_id, query_name, position, length FROM matches WHERE position + length <= 5000")
def dashboard_points(spark, sf_dir):
    """The points of a dashboard left of 5,000, without its cap on their number."""
    return layout.dashboard(_clustered(spark, sf_dir), most=(1 << 31) - 1, upto=5_000)


@query(f"WITH {_MATCHES}, e AS (SELECT seq_id, max(position + length) AS e FROM matches GROUP BY 1) SELECT CAST(trunc(trunc(avg(e)) * 1.1::DOUBLE) AS INTEGER) AS width FROM e")
def mean_width(spark, sf_dir):
    return layout.visual_width(matches_of(spark, sf_dir), mode="mean")


@query(f"""WITH {_MATCHES}, e AS (SELECT seq_id, max(position + length) AS e FROM matches GROUP BY 1) SELECT CAST(max(e) AS INTEGER) AS width FROM e""")
def visual_width(spark, sf_dir):
    return layout.visual_width(matches_of(spark, sf_dir))


@query()
def box_walk(spark, sf_dir):
    return layout.walked_matches(layout.with_query_index(matches_of(spark, sf_dir), queries_df(spark, MOTIFS)), order=["position", "query_idx"])


@query()
def sampled_clusters(spark, sf_dir):
    return layout.compressed(_clustered(spark, sf_dir), "sample", most=10)
