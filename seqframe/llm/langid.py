"""Language identification by a bidirectional gated recurrent network over bytes.

fit() trains on a bounded sample: at most `most` documents, chosen by a hash of their
id with weights that even out the languages (a priority sample: the numbers of documents
say below which priority about twice as many lie, and only these go to a top-k), and from
each at most a few windows at places that the hash chooses too. No language is left out for being rare. predict() reads whole texts: each is cut into windows of `steps` bytes,
every position of every window gets a distribution over the languages, and the
document's is their mean over all positions that belong to letters.

The model has a few thousand numbers and goes to the executors inside the function.
Prediction is one pass over the rows without a shuffle; lang, source and id are no inputs.

Null text, or text without a letter: `und` with score 0. Each input row gives one
output row, repeated rows too. If nothing is labelled there is no language to learn and
all rows get `und`. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqframe.llm.common import kind_of, slices
from seqframe.llm.gru import BiGRU

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes that count: ASCII letters, and all that belongs to other characters.
_COUNTS = np.array([chr(b).isascii() and chr(b).isalpha() or b >= 0x80 for b in range(256)])


def has_letter(text: str) -> bool:
    """Whether there is a character of a Unicode letter category."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def training_rows(docs: DataFrame, *, key: str, text: str, lang: str, where: Column | None, most: int, windows: int, steps: int) -> DataFrame:
    """Columns: lang, part: windows of text of the sample."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = (rows.where(where) if where is not None else rows).select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one number to a language
    if not counts:
        return rows.select("lang", F.col("text").alias("part"))
    weight = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])[F.col("lang")]
    unit = (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    size = F.length("text")
    parts = [F.substring(F.col("text"), (F.pmod(F.xxhash64("id", F.lit(k)), F.greatest(size - steps, F.lit(1))) + 1).cast("int"), F.lit(steps)) for k in range(windows)]
    rows = rows.withColumn("priority", -F.log(unit) * weight).where(F.col("priority") <= cut_off(list(counts.values()), 2 * most))
    rows = rows.select("priority", "id", "lang", F.array(*parts).alias("parts"))
    return rows.orderBy("priority", "id", "lang", "parts").limit(most).select("lang", F.explode("parts").alias("part"))


def cut_off(counts: list[int], most: int) -> float:
    """A priority below which about `most` documents are expected (all, if there are not so
    many). A document of a language with n documents is below t with probability
    1 - exp(-t / n), so that only a bounded number of rows goes on to the top-k."""
    if sum(counts) <= most:
        return float("inf")
    low, high = 0.0, float(most)
    while sum(n * -math.expm1(-high / n) for n in counts) < most:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if sum(n * -math.expm1(-middle / n) for n in counts) >= most else (middle, high)
    return high


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", where: Column | None = None, most: int = 600, windows: int = 6, steps: int = 64, units: int = 8, epochs: int = 5, seed: int = 7) -> dict:
    """The model: languages, network, window length. Learns from the rows that `where`
    leaves and whose lang isn't null. Bound of the sample: most x windows x steps characters."""
    sample = training_rows(docs, key=key, text=text, lang=lang, where=where, most=most, windows=windows, steps=steps).collect()
    sample = sorted({(r["lang"], r["part"]) for r in sample if r["part"]})
    names = sorted({x for x, _ in sample})
    if not names:
        return {"languages": [], "net": None, "steps": steps}
    raw = [p.encode()[:steps] for _, p in sample]
    x = np.stack([np.frombuffer(p.ljust(steps, b"\0"), np.uint8) for p in raw])
    y = np.array([names.index(x) for x, _ in sample])
    net = BiGRU(units, len(names), seed)
    net.fit(x, y, _COUNTS[x].astype(np.float32), epochs=epochs, seed=seed)
    return {"languages": names, "net": net, "steps": steps}


_AT_ONCE = 1024  # windows of a block


def _pooled(net: BiGRU, steps: int, texts: list[bytes]) -> np.ndarray:
    """(texts, classes): sums of the probabilities at letters. Blocks of windows run
    across the texts, so that their number doesn't depend on the texts' lengths."""
    n = np.array([-(-len(t) // steps) for t in texts])
    flat = np.frombuffer(b"".join([t.ljust(k * steps, b"\0") for t, k in zip(texts, n, strict=True)]), np.uint8).reshape(-1, steps)
    owner = np.repeat(np.arange(len(texts)), n)
    total = np.zeros((len(texts), net.classes))
    for k in range(0, len(flat), _AT_ONCE):
        x = np.ascontiguousarray(flat[k : k + _AT_ONCE].T)
        prob = net.label(x)
        counts = _COUNTS[x].astype(np.float32)
        by_window = np.einsum("tcn,tn->nc", prob, counts)
        np.add.at(total, owner[k : k + _AT_ONCE], by_window)
    return total


_TEXTS = 4 << 20  # bytes of texts that are looked at together


def predict(docs: DataFrame, model: dict, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns: key, those of keep, lang_pred string, score double (the pooled probability, 0 to 1)."""
    names, net, steps = model["languages"], model["net"], model["steps"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at, _TEXTS):
            texts = [t.encode() if t and net is not None and has_letter(t) else None for t in part.column(at).to_pylist()]
            known = [t for t in texts if t is not None]
            total = iter(_pooled(net, steps, known) if known else ())
            langs, scores = [], []
            for t in texts:
                p = next(total) if t is not None else None
                if p is None or not p.sum():
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    langs.append(names[int(p.argmax())])
                    scores.append(float(min(1.0, p.max() / p.sum())))
            columns = [*part.columns[:kept], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=names_)

    kept = 1 + len(keep)
    columns_ = [key, *keep] + [text] * (text not in keep)
    at = columns_.index(text)
    types = [*(kind_of(docs, c) for c in columns_[:kept]), "string", "double"]
    names_ = [f"c{i}" for i in range(len(types))]  # keep may have a column called lang_pred
    found = docs.select(*columns_).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names_, types, strict=True)))
    return found.toDF(*columns_[:kept], "lang_pred", "score")
