"""Near duplicates by circulant MinHash.

A document's set holds its distinct shingles of 5 words, hashed. A first
permutation scatters the hashes over the places 0 to 2 ** 32 - 1, a second one
orders the places; coordinate k of a signature is the least rank in that order
after the places were shifted circularly by k. So two permutations give all
coordinates. Coordinates are cut into bands; documents that share a band are
verified by the exact Jaccard similarity of their whole sets, and verified
links make components, of which the document with the smallest id stays.

Two sets of similarity s share a band with probability
1 - (1 - s ** ROWS) ** BANDS: 0.999992 at 0.85. A set so small that only an
equal one is similar needs no band: equal sets are one class from the start.

Defined results: a document without a word, or null, has an empty set, links
with nothing and is kept; with under 5 words the whole sequence is its one
shingle; repeated rows of an id share a component and are kept alike; a null
id gets the smallest id of its component and goes, or null where there is none
and stays; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import table
from vigil.llm.links import Sets
from vigil.llm.ngram_join import jaccard_components, mixed

#: Words of a shingle, similarity in per cent.
WORDS, LEAST = 5, 85
BANDS, ROWS = 16, 4
SCATTER = np.uint64(0x2545F4914F6CDD1D)


def places(values: np.ndarray) -> np.ndarray:
    """The first permutation, of 64-bit hashes, of which the upper half is the place."""
    return (mixed(values + SCATTER) >> np.uint64(32)).astype(np.uint32)


def ranks(at: np.ndarray) -> np.ndarray:
    """The second permutation, of 32-bit places."""
    x = at ^ (at >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """n coordinates of each of some sets (no empty one), which begin at starts in values."""
    at = places(values)
    return np.stack([np.minimum.reduceat(ranks(at - np.uint32(k)), starts) for k in range(n)], axis=1)


class Bands:
    """Signatures for the join: a 64-bit key for each band of a wanted set."""

    def __init__(self, least: int, bands: int = BANDS, rows: int = ROWS):
        self.least, self.bands, self.rows = least, bands, rows

    def __call__(self, sets: Sets, wanted: np.ndarray) -> Sets:
        values, ends = sets
        sizes = np.diff(ends)
        wanted = wanted & (sizes * 100 >= self.least * (sizes + 1))
        out = np.concatenate(([0], np.cumsum(np.where(wanted, self.bands, 0))))
        if not wanted.any():
            return values[:0], out
        mine = sizes[wanted]
        coordinates = signature(values[np.repeat(wanted, sizes)], np.cumsum(mine) - mine, self.bands * self.rows).astype(np.uint64)
        keys = np.zeros((len(mine), self.bands), np.uint64) + np.arange(self.bands, dtype=np.uint64)
        for k in range(self.rows):
            keys = mixed(keys * SCATTER + coordinates[:, k :: self.rows])
        return keys.reshape(-1), out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, least: int = LEAST, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable by links of similarity least %) and kept of each row."""
    found = jaccard_components(docs, key, text, n, least, lambda: Bands(least, bands, rows))
    return found.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The same by plain SQL, for small tables: all pairs that share a shingle, then reachability.
ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS id, b AS t FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.t),
o AS (SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce((SELECT min(t) FROM r WHERE r.id = w.doc_id), w.doc_id) AS component_id
 FROM w LEFT JOIN n ON n.doc_id = w.doc_id)
SELECT *, doc_id = component_id AS kept FROM o
"""
