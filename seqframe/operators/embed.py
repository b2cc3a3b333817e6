"""Embeddings of reads: pivots, tokens, word vectors, positional and k-mer variants.

Word vectors come from Spark ML's Word2Vec (skip-gram with hierarchical softmax), so
that they are not comparable number by number with other libraries'. A read's vector
is the mean over the tokens that the vocabulary has, zeros if there are none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, Word2Vec, Word2VecModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqframe.functions.grams import by_slice, counted, kmer_counts, kmer_lists, kmer_totals
from seqframe.functions.sequence import letters, padded, position_weight, positional_encoding, relative_position, token
from seqframe.scratch import small

_TRAINED = 1 << 20  # tokens of a partition that trains word vectors, about
_MOST_PARTS = 128


def direct(matches: DataFrame, names: list[str], *, key: str = "seq_id", fill: int | None = 0) -> DataFrame:
    """The least position of each motif, one column to a motif; fill where there is none."""
    wide = matches.groupBy(key).pivot("query_name", names).agg(F.min("position"))
    return wide if fill is None else wide.fillna(fill)


def token_sequences(matches: DataFrame, *, key: str = "seq_id", bucket: int = 1) -> DataFrame:
    """key, tokens: name@position of each read in the order of position and name."""
    one = F.struct("position", "query_name", token("query_name", "position", bucket).alias("token"))
    return matches.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["token"]).alias("tokens"))


def name_sequences(matches: DataFrame, *, key: str = "seq_id") -> DataFrame:
    one = F.struct("position", "query_name")
    return matches.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["query_name"]).alias("tokens"))


def queries_and_distances(matches: DataFrame, *, key: str = "seq_id") -> DataFrame:
    """key, names, distances: motifs in order, and the start deltas between neighbours."""
    by = Window.partitionBy(key).orderBy("position", "query_name")
    rows = matches.withColumn("__d", F.lead("position").over(by) - F.col("position"))
    one = F.array_sort(F.collect_list(F.struct("position", "query_name", "__d")))
    out = rows.groupBy(key).agg(one.alias("m"))
    return out.select(key, F.transform("m", lambda x: x["query_name"]).alias("names"), F.filter(F.transform("m", lambda x: x["__d"]), lambda d: d.isNotNull()).alias("distances"))


def word_model(sequences: DataFrame, *, size: int = 64, window: int = 6, least: int = 2, rounds: int = 5, seed: int = 42, longest: int = 1 << 20) -> Word2VecModel:
    """Trained on the column tokens. Partitions of about a million tokens train side by side and
    their vectors are averaged after each round, as Spark ML does; up to a million it is one."""
    tokens = sequences.agg(F.sum(F.size("tokens").cast("long"))).first()[0] or 0
    parts = max(1, min(_MOST_PARTS, -(-tokens // _TRAINED)))
    return Word2Vec(inputCol="tokens", outputCol="v", vectorSize=size, windowSize=window, minCount=least, maxIter=rounds, seed=seed, maxSentenceLength=longest, numPartitions=parts).fit(sequences)


def _vectors(model: Word2VecModel) -> DataFrame:
    return model.getVectors().select(F.col("word").alias("__word"), vector_to_array("vector").alias("__v"))


def mean_vectors(rows: DataFrame, size: int, *, key: str, vector: str = "v", weight: Column | None = None) -> DataFrame:
    """key, features: the mean of the vectors of a key, element by element."""
    v = [F.avg(F.col(vector)[k] * (weight if weight is not None else F.lit(1.0))) for k in range(size)]
    return rows.groupBy(key).agg(F.array(*v).alias("features"))


def embed_tokens(sequences: DataFrame, model: Word2VecModel, *, key: str = "seq_id") -> DataFrame:
    """key, features: means over known tokens; zeros for reads without any."""
    size = model.getVectorSize()
    known = sequences.select(key, F.explode("tokens").alias("__word")).join(_vectors(model), "__word")
    means = mean_vectors(known, size, key=key, vector="__v")
    zeros = F.array_repeat(F.lit(0.0), size)
    return sequences.select(key).join(means, key, "left").select(key, F.coalesce("features", zeros).alias("features"))


def embed_positional(matches: DataFrame, model: Word2VecModel, *, key: str = "seq_id", dim: int = 10) -> DataFrame:
    """Means of motif vectors, each followed by its position's encoding."""
    rows = matches.withColumnRenamed("query_name", "__word").join(_vectors(model), "__word")
    rows = rows.withColumn("__v", F.concat("__v", positional_encoding("position", dim)))
    return mean_vectors(rows, model.getVectorSize() + dim, key=key, vector="__v")


def embed_weighted(matches: DataFrame, model: Word2VecModel, *, key: str = "seq_id") -> DataFrame:
    """Means of motif vectors, weighted from 1.0 at the read's first match to 0.1 at its last."""
    by = Window.partitionBy(key)
    rows = matches.withColumn("__w", position_weight(F.col("position"), F.min("position").over(by), F.max("position").over(by)))
    rows = rows.withColumnRenamed("query_name", "__word").join(_vectors(model), "__word")
    return mean_vectors(rows, model.getVectorSize(), key=key, vector="__v", weight=F.col("__w"))


def kmer_sequences(reads: DataFrame, k: int = 5, *, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    return kmer_lists(reads, k, key=key, seq=seq)


def embed_kmers(reads: DataFrame, model: Word2VecModel, k: int = 5, *, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """key, features: the mean of the vectors of all k-mers of a read that the model knows, zeros for
    reads without any. A read's k-mers are counted first, so that each meets its vector once; the
    vectors, which the model holds on the driver, go to every task."""
    size, kind = model.getVectorSize(), reads.select(key).schema[0].dataType.simpleString()
    known = model.getVectors().collect()
    sent = reads.sparkSession.sparkContext.broadcast(({r["word"]: i for i, r in enumerate(known)}, np.array([r["vector"].toArray() for r in known], float).reshape(len(known), size)))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        place, vectors = sent.value
        row, words, n = counted(part.column(1), k)
        at = np.array([place.get(w, -1) for w in words], np.int64)
        row, at, n = (x[at >= 0] for x in (row, at, n))
        sums = [pa.array(np.bincount(row, n * vectors[at, i], part.num_rows).astype(float)) for i in range(size)]  # without any, bincount gives whole numbers
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(np.bincount(row, n, part.num_rows).astype(np.int64)), *sums], names=names)

    names = [key, "__n", *(f"__s{i}" for i in range(size))]
    rows = by_slice(reads, seq, run, f"`{key}` {kind}, __n long, " + ", ".join(f"{c} double" for c in names[2:]), key)
    sums = rows.groupBy(key).agg(F.sum("__n").alias("__n"), *[F.sum(c).alias(c) for c in names[2:]], F.count("*").alias("__rows"))
    means = F.when(F.col("__n") > 0, F.array(*[F.col(c) / F.col("__n") for c in names[2:]])).otherwise(F.array_repeat(F.lit(0.0), size))
    return sums.select(key, means.alias("features"), F.explode(F.sequence(F.lit(1).cast("long"), "__rows"))).select(key, "features")


def kmer_frequencies(reads: DataFrame, k: int = 4, *, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """key, features: k-mer counts over their sum, in a vocabulary of the k-mers present, the most
    frequent first and equals by name; 4**k of them at most. Zeros for reads without any."""
    kind = reads.select(key).schema[0].dataType.simpleString()
    words = kmer_totals(reads, k, seq=seq).orderBy(F.desc("n"), "kmer").limit(4**k).collect()  # a bounded number of rows
    place = {r["kmer"]: i for i, r in enumerate(words)}

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        row, found, n = counted(part.column(1), k)
        at = np.array([place.get(w, -1) for w in found], np.int64)
        counts = np.zeros((part.num_rows, len(place)))
        counts[row[at >= 0], at[at >= 0]] = n[at >= 0]
        counts /= np.maximum(1, counts.sum(axis=1, keepdims=True))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * len(place), pa.int32()), pa.array(counts.ravel()))
        return pa.RecordBatch.from_arrays([part.column(0), flat], names=[key, "features"])

    return by_slice(reads, seq, run, f"`{key}` {kind}, features array<double>", key)


def kmer_shares(reads: DataFrame, k: int = 4, *, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """key, kmer, share: the same as rows, of the k-mers that a read has."""
    counts = kmer_counts(reads, k, key=key, seq=seq).groupBy(key, "kmer").agg(F.sum("n").alias("__n"))
    return counts.select(key, "kmer", (F.col("__n") / F.sum("__n").over(Window.partitionBy(key))).alias("share"))


def projected(matches: DataFrame, *, key: str = "seq_id", length: int = 20, size: int = 30, seed: int = 42) -> DataFrame:
    """A fixed random projection of the first `length` (motif number, relative position)
    pairs of each read: what untrained recurrent or attention layers with a seed give."""
    last = F.max("position").over(Window.partitionBy(key))
    names = matches.select("query_name").distinct()
    index = names.withColumn("__i", F.dense_rank().over(Window.orderBy("query_name")))
    rows = matches.withColumn("__p", relative_position(F.col("position"), last)).join(small(index), "query_name")
    one = F.array_sort(F.collect_list(F.struct("position", "query_name", F.col("__i").cast("double").alias("i"), F.col("__p").alias("p"))))
    flat = rows.groupBy(key).agg(F.flatten(F.transform(one, lambda x: F.array(x["i"], x["p"]))).alias("x"))
    flat = flat.select(key, padded("x", 2 * length, F.lit(0.0)).alias("x"))

    def weight(i: Column, j: int) -> Column:
        return F.pmod(F.xxhash64(i, F.lit(j), F.lit(seed)), F.lit(2_000_001)) / 1_000_000.0 - 1.0

    def unit(j: int) -> Column:
        return F.tanh(F.aggregate(F.transform("x", lambda v, i: v * weight(i, j)), F.lit(0.0), lambda s, v: s + v) / float(length))

    return flat.select(key, F.array(*[unit(j) for j in range(size)]).alias("features"))


def char_vocabulary(reads: DataFrame, *, seq: str = "seq") -> DataFrame:
    """char, id: letters in order from 2 on; 0 is for filling and 1 for the unknown."""
    chars = reads.select(F.explode(letters(seq)).alias("char")).distinct()
    return chars.withColumn("id", F.dense_rank().over(Window.orderBy("char")) + 1)


def encode_chars(reads: DataFrame, vocabulary: dict[str, int], length: int | None, *, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """key, ids: numbers of the letters, filled with 0 or cut to the length; None: as they are."""
    table = F.create_map(*[F.lit(x) for pair in vocabulary.items() for x in pair]) if vocabulary else F.create_map().cast("map<string,int>")
    text = F.col(seq) if length is None else F.substring(F.col(seq), 1, length)
    ids = F.transform(letters(text), lambda c: F.coalesce(F.try_element_at(table, c), F.lit(1)))
    return reads.select(key, (ids if length is None else padded(ids, length)).alias("ids"))


def decode_chars(rows: DataFrame, vocabulary: dict[str, int], *, key: str = "seq_id") -> DataFrame:
    """key, seq: the letters back; unknown numbers as [UNK], filling left out."""
    table = F.create_map(*[F.lit(x) for c, i in vocabulary.items() for x in (i, c)]) if vocabulary else F.create_map().cast("map<int,string>")
    known = F.filter("ids", lambda i: i != 0)
    return rows.select(key, F.array_join(F.transform(known, lambda i: F.coalesce(F.try_element_at(table, i), F.lit("[UNK]"))), "").alias("seq"))


def char_components(encoded: DataFrame, size: int = 16, symbols: int = 6, *, key: str = "seq_id") -> DataFrame:
    """key, features: principal components of one-hot letters, in the place of a trained
    character autoencoder (the best linear one)."""
    hot = F.flatten(F.transform("ids", lambda i: F.transform(F.sequence(F.lit(1), F.lit(symbols)), lambda s: (s == i).cast("double"))))
    rows = encoded.select(key, array_to_vector(hot).alias("x"))
    return PCA(k=size, inputCol="x", outputCol="f").fit(rows).transform(rows).select(key, vector_to_array("f").alias("features"))


def components(table: DataFrame, k: int, *, features: str = "features") -> DataFrame:
    """features reduced to the first k principal components of the centred values."""
    n = table.select(F.size(features)).first()[0]
    means = F.broadcast(table.agg(*[F.avg(F.col(features)[i]).alias(f"__m{i}") for i in range(n)]).select(F.array(*[f"__m{i}" for i in range(n)]).alias("__m")))
    rows = table.crossJoin(means).withColumn("__x", array_to_vector(F.zip_with(features, "__m", lambda a, b: a.cast("double") - b)))
    out = PCA(k=k, inputCol="__x", outputCol="__f").fit(rows).transform(rows)
    return out.withColumn(features, vector_to_array("__f")).drop("__m", "__x", "__f")
