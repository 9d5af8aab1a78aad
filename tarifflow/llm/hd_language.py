"""Language identification with hyperdimensional profiles.

Every letter has a random +1/-1 vector drawn from its code point.  A letter trigram is
bound as permute(permute(a)) * permute(b) * c, a document is the bundle (sum) of its
trigrams, a language prototype the bundle of its training documents, and a document is
given the language of the prototype with the largest cosine.

Bundling is linear, so a block of documents is its trigram count matrix times the
matrix of trigram vectors.  Training sums one vector per language and task, hence what
is shuffled and broadcast is bounded by (languages x dimensions), whatever the corpus.

Defined results: null texts and texts without a letter are `und` with score 0.  Ties
go to the alphabetically first language.  With no training rows all is `und`.  Training
rows with a null language are left out.  Extra columns are carried through; an input
column named like a result column is replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import crc_bucket, pieces

DIMENSIONS = 1024
SLICE_BYTES, GRAMS, ROWS = 1 << 18, 2048, 128
UNKNOWN = "und"
#: Cosines this close count as equal.
ROUNDING = 1e-6
#: Prototypes are broadcast; more distinct languages than this is an error, not a larger broadcast.
MAX_LANGUAGES = 4096


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            table[c] = True
    return table


@lru_cache(maxsize=65536)
def _letter_vector(code: int, dimensions: int) -> np.ndarray:
    return (np.random.default_rng(code).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1).astype(np.int8)


def bundles(texts: list[str | None], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """(one bundled vector per text, whether it has a letter)."""
    lowered = ["" if t is None else t.lower() for t in texts]
    sizes = np.array([len(t) + 1 for t in lowered], dtype=np.int64)
    codes = np.frombuffer(("\0" + "\0".join(lowered) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.concatenate(([0], np.repeat(np.arange(len(texts)), sizes)))
    letter = _letter_table()[codes]
    has = np.bincount(owner[letter], minlength=len(texts)) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one gap after each word
    keep[0] = True
    codes, owner = np.where(letter, codes, 0)[keep], owner[keep]
    if len(codes) < 3 or not has.any():
        return np.zeros((len(texts), dimensions), np.float32), has
    alphabet, at = np.unique(codes, return_inverse=True)
    k = len(alphabet)
    grams = (at[:-2] * k + at[1:-1]) * k + at[2:]
    real = (codes[1:-1] != 0) | (codes[:-2] != 0) & (codes[2:] != 0)
    real &= (owner[1:-1] == owner[2:]) & ((owner[:-2] == owner[1:-1]) | (codes[:-2] == 0))
    grams, owner = grams[real], owner[1:-1][real]
    if k**3 <= 1 << 22:
        rank = np.zeros(k**3, np.int64)
        rank[grams] = 1
        active = np.flatnonzero(rank)
        rank[active] = np.arange(len(active))
        grams = rank[grams]
    else:
        active, grams = np.unique(grams, return_inverse=True)
    letters = np.stack([_letter_vector(int(c), dimensions) for c in alphabet])
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    out = np.zeros((len(texts), dimensions), np.float32)
    for a in range(0, len(active), GRAMS):
        part = active[a : a + GRAMS]
        vectors = (first[part // (k * k)] * second[part // k % k] * letters[part % k]).astype(np.float32)
        inside = (grams >= a) & (grams < a + len(part))
        for b in range(0, len(texts), ROWS):
            here = inside & (owner >= b) & (owner < b + ROWS) if len(texts) > ROWS else inside
            n = min(ROWS, len(texts) - b)
            counts = np.bincount((owner[here] - b) * len(part) + grams[here] - a, minlength=n * len(part)).reshape(n, len(part))
            out[b : b + n] += counts.astype(np.float32) @ vectors
    return out, has


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes by language, bundled from every row whose language is known."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in pieces(batch, 0, SLICE_BYTES):
                vectors, _ = bundles(piece.column(0).to_pylist(), dimensions)
                langs = np.array(piece.column(1).to_pylist(), dtype=object)
                for name in set(langs):
                    total = vectors[langs == name].sum(axis=0, dtype=np.float64)
                    sums[name] = sums.get(name, 0) + np.rint(total).astype(np.int64)
        for name, vector in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(vector)], names=["lang", "dim", "value"])

    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text, F.col(lang).alias("lang"))
    sums = rows.mapInArrow(run, "lang string, dim int, value bigint").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    found = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("v")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    return {r["lang"]: np.array([x["value"] for x in r["v"]], dtype=np.float64) for r in sorted(found, key=lambda r: r["lang"])}


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", prediction: str = "lang_pred", score: str = "score") -> DataFrame:
    """`df` with the language of each text and its cosine, at least 0."""
    names = sorted(prototypes)
    dimensions = len(prototypes[names[0]]) if names else 1
    unit = np.stack([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-12) for n in names]).astype(np.float32) if names else np.zeros((0, 1), np.float32)
    kept = [f for f in df.schema.fields if f.name not in (prediction, score)]
    schema = T.StructType([*kept, T.StructField(prediction, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches):
        for batch in (p for b in batches for p in pieces(b, b.schema.get_field_index(text), SLICE_BYTES)):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            best, cosine = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if names:
                vectors, has = bundles(texts, dimensions)
                near = vectors @ unit.T / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]
                # the first by name of those that rounding can't tell apart
                top = (near >= near.max(axis=1, keepdims=True) - ROUNDING).argmax(axis=1)
                for k in np.flatnonzero(has):
                    best[k], cosine[k] = names[top[k]], min(1.0, max(0.0, float(near[k, top[k]])))
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(best, pa.string()), pa.array(cosine)], names=schema.names)

    return df.mapInArrow(run, schema)


def held_out(column="doc_id"):
    return F.coalesce(crc_bucket(F.col(column), 4) == 2, F.lit(False))
