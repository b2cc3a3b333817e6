"""Whole analyses: search, junction extraction, embedding and clustering, primer reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqframe.scratch import settled
from seqframe.operators import cluster, embed, layout, pairs, search, stats
from seqframe.schema import queries_df
from seqframe.sources.fastq import read_fasta, read_fastq, write_fasta, write_fastq

SEARCHES = {"exact": search.exact_matches, "edit": search.edit_matches, "window": search.window_matches}


def find(reads: DataFrame, queries: Mapping[str, str], method: str = "edit", **options) -> DataFrame:
    if method not in SEARCHES:
        raise ValueError(f"no search {method!r}; there are {', '.join(SEARCHES)}")
    return SEARCHES[method](reads, queries, **options)


def register(spark: SparkSession, *, reads: DataFrame, matches: DataFrame, queries: Mapping[str, str], clusters: DataFrame | None = None) -> None:
    """Views reads, matches, queries and clusters, and the table function motif_search."""
    reads.createOrReplaceTempView("reads")
    matches.createOrReplaceTempView("matches")
    queries_df(spark, queries).createOrReplaceTempView("queries")
    if clusters is not None:
        clusters.createOrReplaceTempView("clusters")
    register_functions(spark)


def register_functions(spark: SparkSession) -> None:
    """SQL: SELECT ... FROM reads, LATERAL motif_search(seq, motif, budget)."""

    @F.udtf(returnType="position int, length int, distance int")
    class MotifSearch:
        def eval(self, seq: str, motif: str, budget: int):
            if seq and motif:
                for start, end, distance in search.best_locations([seq], motif, budget)[0]:
                    yield start, end - start, distance

    spark.udtf.register("motif_search", MotifSearch)


def extract_junctions(reads: DataFrame, queries: Mapping[str, str], rules: DataFrame, low: int, high: int, out: str | None = None, *, include: bool = False, method: str = "exact", **options) -> DataFrame:
    """Reads cut to the regions between neighbours that the rules name; also written as
    FASTQ and FASTA below out."""
    found = find(reads.withColumn("seq_id", F.col("rec_no")), queries, method, **options)
    regions = pairs.junctions(found, rules, low, high, include=include).withColumnRenamed("seq_id", "rec_no")
    cut = pairs.trimmed(reads, regions, key="rec_no")
    if out:
        write_fastq(cut.withColumn("description", F.col("read_id")), f"{out}/fastq")
        write_fasta(cut, f"{out}/fasta")
    return cut


def embed_and_cluster(matches: DataFrame, names: list[str], k: int, *, method: str = "direct", key: str = "seq_id", reduce_to: int = 5_000, seed: int = 42) -> DataFrame:
    """key, features, cluster of each read."""
    if method == "direct":
        wide = embed.direct(matches, names, key=key)
        table = wide.select(key, F.array(*[F.col(f"`{n}`").cast("double") for n in names]).alias("features"))
    elif method == "tokens":
        sequences = embed.token_sequences(matches, key=key, bucket=10)
        table = embed.embed_tokens(sequences, embed.word_model(sequences), key=key)
    elif method == "names":
        sequences = embed.name_sequences(matches, key=key)
        table = embed.embed_tokens(sequences, embed.word_model(sequences, size=30, window=5, least=1), key=key)
    elif method == "projected":
        table = embed.projected(matches, key=key)
    else:
        raise ValueError(f"no embedding {method!r}")
    return table.join(cluster.pipeline(table, k, reduce_to=reduce_to, key=key, seed=seed), key)


def grid(matches: DataFrame, names: list[str], embeddings: list[str], methods: list[str], k: int) -> list[dict]:
    """Every embedding with every clustering method; errors become rows."""
    out = []
    for e in embeddings:
        try:
            table = settled(embed_and_cluster(matches, names, k, method=e).select("seq_id", "features"))
        except Exception as error:  # noqa: BLE001  the grid goes on; the row says what happened
            out.append({"embedding": e, "error": str(error)[:200]})
            continue
        out += [{"embedding": e} | row for row in cluster.compared(table, methods, k)]
    return out


def picture(matches: DataFrame, assigned: DataFrame, queries: DataFrame, method: str = "merge") -> DataFrame:
    """The relation behind a cluster picture."""
    rows = layout.with_query_index(layout.with_clusters(matches, assigned), queries)
    return layout.compressed(rows, method)


def primer_analysis(spark: SparkSession, fasta: str, primers: Mapping[str, str], threshold: float = 80.0, *, denominator: str = "primer") -> tuple[DataFrame, DataFrame]:
    """The report by sequence and the summary of a FASTA file."""
    rows = read_fasta(spark, fasta).withColumnRenamed("id", "seq_id")
    aligned = settled(search.local_alignments(rows, primers, denominator=denominator))
    return search.primer_report(aligned, threshold), search.primer_summary(aligned, threshold)


def search_file(spark: SparkSession, fastq: str, queries: Mapping[str, str], threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Matches of a FASTQ file, and statistics by motif."""
    reads = read_fastq(spark, fastq)
    found = find(reads, queries, "edit", threshold=threshold, key="read_id").withColumnRenamed("read_id", "seq_id")
    return found, stats.motif_statistics(found)
