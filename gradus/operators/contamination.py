"""Leaks of hidden tests, and overlap of train and evaluation texts."""

from __future__ import annotations

import math
from difflib import SequenceMatcher
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gradus.functions.late import late
from gradus.functions.text import normalize_code, normalize_prose, snippet


def surface(prompt: Column, starter: Column, entry: Column) -> Column:
    return F.concat_ws("\n", *(F.when(x != "", x) for x in (prompt, starter, entry)))


def hidden_leaks(tasks: DataFrame) -> DataFrame:
    """task_id, test_name, surface, snippet of hidden tests whose code is in what a model may see."""
    public = F.array_join(F.transform("public_tests", lambda t: t["code"]), "\n")
    seen = F.array(*(F.named_struct(F.lit("surface"), F.lit(n), F.lit("text"), F.coalesce(normalize_code(x), F.lit(""))) for n, x in (("prompt", F.col("prompt")), ("starter_code", F.coalesce("starter_code", F.lit(""))), ("public_tests", public))))
    tests = tasks.select("task_id", seen.alias("seen"), F.explode("hidden_tests").alias("t"))
    code = normalize_code(F.col("t.code"))
    pairs = tests.select("task_id", F.col("t.name").alias("test_name"), F.col("t.code").alias("code"), code.alias("needle"), F.explode("seen").alias("s"))
    return pairs.where((F.col("needle") != "") & F.contains(F.col("s.text"), F.col("needle"))).select("task_id", "test_name", "s.surface", snippet(F.col("code")).alias("snippet"))


def exact_overlap(train: DataFrame, evals: DataFrame) -> DataFrame:
    """Pairs (id_a, id_b) of equal normalized texts; id, text on both sides. An equi-join."""
    a = train.select(F.col("id").alias("id_a"), normalize_prose(F.col("text")).alias("norm")).where("norm <> ''")
    b = evals.select(F.col("id").alias("id_b"), normalize_prose(F.col("text")).alias("norm")).where("norm <> ''")
    return a.join(b, "norm").select("id_a", "id_b", F.lit("exact_duplicate").alias("kind"), F.lit(1.0).alias("score"))


def _masks(text: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(text):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def _in_order(masks: dict[str, int], size: int, text: str) -> int:
    """Length of the longest common subsequence of text and the text of size letters with masks."""
    full = rest = (1 << size) - 1
    get = masks.get
    for c in text:
        both = rest & get(c, 0)
        rest = (rest + both | rest - both) & full
    return size - rest.bit_count()


@late("double")
def _ratio(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """Matching ratios of at least least, null for others: common letters, then the longest common
    subsequence bound what blocks can match, so most pairs need no matching."""
    (ia, ua), (ib, ub) = pd.factorize(a), pd.factorize(b)
    counts = lambda texts: np.stack([np.bincount(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) & 63, minlength=64) for t in texts]).astype(np.int32)
    out: list[float | None] = [None] * len(a)
    if len(a):
        common = np.minimum(counts(ua)[ia], counts(ub)[ib]).sum(axis=1)
        sizes = np.array([len(t) for t in ua])[ia] + np.array([len(t) for t in ub])[ib]
        ma, mb = [None] * len(ua), [None] * len(ub)
        for k in np.flatnonzero(2.0 * common >= least.to_numpy() * sizes - 1e-6).tolist():
            x, y, low = ua[ia[k]], ub[ib[k]], least.iloc[k]
            (m, at, long, short) = (ma, ia[k], x, y) if len(x) > len(y) else (mb, ib[k], y, x)
            if m[at] is None:
                m[at] = _masks(long)
            if 2.0 * _in_order(m[at], len(long), short) / (len(x) + len(y)) >= low:
                out[k] = SequenceMatcher(None, x, y).ratio()
    return pd.Series(out, dtype="float64")


def near_overlap(train: DataFrame, evals: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Pairs of different normalized texts whose matching ratio, train text first, is at least threshold.

    The ratio is at most twice the shorter length over both, so lengths must be close: texts are
    joined by buckets of the logarithm of length, train texts in three neighbouring ones. Within a
    pair, common letters and the longest common subsequence bound the ratio before it is computed.
    No pair is lost.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    step = -math.log(threshold / (2 - threshold)) if threshold < 1 else 1e-9
    bucket = F.floor(F.log(F.length("norm").cast("double")) / F.lit(max(step, 1e-9))).cast("long")
    a = train.select(F.col("id").alias("id_a"), normalize_prose(F.col("text")).alias("norm")).where("norm <> ''").withColumn("b", F.explode(F.array(bucket - 1, bucket, bucket + 1))).withColumnRenamed("norm", "na")
    b = evals.select(F.col("id").alias("id_b"), normalize_prose(F.col("text")).alias("norm")).where("norm <> ''").withColumn("b", bucket).withColumnRenamed("norm", "nb")
    la, lb = F.length("na"), F.length("nb")
    near = a.join(b, "b").where((F.col("na") != F.col("nb")) & (2 * F.least(la, lb) >= threshold * (la + lb)))
    return near.select("id_a", "id_b", F.lit("near_duplicate").alias("kind"), _ratio("na", "nb", F.lit(threshold)).alias("score")).where(F.col("score") >= threshold)


#: How many of an item's words are its key, bytes of a text that are cut into words at once, and what an item takes in a task besides its text.
_FIRST, _PIECE, _ITEM_BYTES = 4, 1 << 20, 500
#: What normalize_prose keeps of the bytes of a lower-case text; all others part words.
_KEPT = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789_" else 32 for b in range(256))


class _Items:
    """Normalized texts with their places, found by their first words."""

    def __init__(self, texts: list[bytes]):
        self.places: dict[bytes, list[int]] = {}
        self.sizes: dict[int, dict[tuple[bytes, ...], tuple[int, ...]]] = {}  # of texts, by number of words in the key, then by key
        known: dict = {}
        for place, text in enumerate(texts):
            key = tuple(known.setdefault(w, w) for w in text.split(b" ", _FIRST)[:_FIRST])
            self.places.setdefault(b" " + text + b" ", []).append(place)
            of = self.sizes.setdefault(len(key), {})
            some = tuple(sorted({*of.get(key, ()), len(text) + 2}))
            of[key] = known.setdefault(some, some)

    def within(self, text: bytes) -> set[int]:
        """Places of the texts that a lower-case text holds."""
        text, keys, parts, tail, at = text.translate(_KEPT), set(), [], [], 0
        while at < len(text):
            end = text.find(b" ", at + _PIECE)
            end = len(text) if end < 0 else end
            new, at = text[at:end].split(), end
            parts += [b" ".join(new)] if new else []
            words = tail + new
            tail = words[1 - _FIRST :]
            for n, of in self.sizes.items():
                keys |= of.keys() & zip(*(islice(words, i, None) for i in range(n)))
        if not keys:
            return set()
        flat, found = b" ".join([b"", *parts, b""]), set()
        for key in keys:
            start, sizes = b" ".join([b"", *key, b""]), self.sizes[len(key)][key]
            at = flat.find(start)
            while at >= 0:
                for size in sizes:
                    found.update(self.places.get(flat[at : at + size], ()))
                at = flat.find(start, at + 1)
        return found


def _contained_by_scan(docs: DataFrame, it: DataFrame) -> DataFrame:
    """One pass over the documents, without a shuffle; each task holds all items."""
    held = it.select("item_id", F.col("item").cast("binary").alias("item")).toArrow()
    ids = held.column(0).combine_chunks()
    known = docs.sparkSession.sparkContext.broadcast((pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids, _Items(held.column(1).to_pylist())))

    def run(batches):
        ids, all_items = known.value
        for batch in batches:
            rows, places = [], []
            for i, text in enumerate(batch.column(1)):
                if found := all_items.within(text.as_py()):
                    rows += [i] * len(found)
                    places += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), ids.take(pa.array(places, pa.int64()))], names=["id", "item_id"])

    kinds = StructType([StructField("id", docs.schema["id"].dataType), StructField("item_id", it.schema["item_id"].dataType)])
    return docs.where("text is not null").select("id", F.lower("text").cast("binary").alias("text")).mapInArrow(run, kinds)


def contained(docs: DataFrame, items: DataFrame, most_broadcast: int = 500_000, most_bytes: int = 128 << 20) -> DataFrame:
    """Pairs (id, item_id) of documents that hold an item's normalized text.

    An item's first words are its key. If there are at most most_broadcast items and they take at most most_bytes in a
    task, which is counted, tasks hold them all: documents are read once, their runs of words looked up among
    the keys, and texts of an item's size compared where its key is. Beyond that hashes of keys are joined: documents
    are cut into all runs of that many words, once for each length of key, and runs that are no key go before anything
    else is shuffled, by a broadcast of 8 bytes a key for up to most_broadcast items, else by a shuffle join; ids must
    tell documents apart. Containment is checked on what is left, so keys that collide do no harm.
    """
    w = F.split("item", " ")
    it = items.select("item_id", normalize_prose(F.col("text")).alias("item")).where("item <> ''").select("item_id", "item", F.least(F.size(w), F.lit(_FIRST)).alias("k"), F.xxhash64(F.slice(w, 1, _FIRST)).alias("key"))
    sizes = {r["k"]: (r["n"], r["size"]) for r in it.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.octet_length("item") + _ITEM_BYTES).alias("size")).collect()}  # at most _FIRST rows
    keys, small = it.select("key").distinct(), sum(n for n, _ in sizes.values()) <= most_broadcast
    if small and sum(size for _, size in sizes.values()) <= most_bytes:
        return _contained_by_scan(docs, it)
    d = docs.select("id", normalize_prose(F.col("text")).alias("norm")).where("norm <> ''")
    split = d.select("id", F.split("norm", " ").alias("w"))

    def runs_of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1)), lambda i: F.xxhash64(F.slice("w", i, n)))

    runs = F.concat(*(runs_of(n) for n in sorted(sizes) or [1]))
    keyed = split.select("id", F.explode(F.array_distinct(runs)).alias("key")).join(F.broadcast(keys) if small else keys, "key", "left_semi")
    hits = keyed.join(it, "key").select("id", "item_id", "item").distinct()
    return hits.join(d, "id").where(F.contains(F.concat(F.lit(" "), F.col("norm"), F.lit(" ")), F.concat(F.lit(" "), F.col("item"), F.lit(" ")))).select("id", "item_id")


def quality_report(tasks: DataFrame, threshold: float = 0.92, train_splits: tuple[str, ...] = ("train",)) -> dict[str, DataFrame]:
    """Leaks and overlaps of a set of tasks; it passes if both are empty."""
    text = surface(F.col("prompt"), F.col("starter_code"), F.col("entry_point"))
    rows = tasks.select(F.col("task_id").alias("id"), text.alias("text"), "split")
    train, evals = rows.where(F.col("split").isin(*train_splits)), rows.where(~F.col("split").isin(*train_splits))
    return {"leaks": hidden_leaks(tasks), "overlap": exact_overlap(train, evals).unionByName(near_overlap(train, evals, threshold))}
