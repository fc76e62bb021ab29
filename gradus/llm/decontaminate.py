"""Benchmark decontamination: training passages are queries against an index of test items.

Items are indexed by size class; a class of items of at most n words has passages of 2n words
that overlap by half, so how long other items are changes nothing. Each passage is scored by BM25
with block-max WAND: cursors over posting lists, a pivot where the greatest impacts reach the threshold,
and blocks whose own greatest impacts don't reach it are jumped over. All items above the threshold
are retrieved; question and answer of each are then compared with the passage.

Tasks build the index in blocks of bounded size, kept as a table in the shared folder. The tasks that
scan documents read it from there, as many blocks at a time as a bound on memory allows.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import filesystem, keep, small

_WORD = re.compile(r"\w+")
_END = re.compile(r"[.?!]\s+|\n")
_HIT = "item_id long, score double, question_overlap double, answer_overlap double, word_start long"


def split_item(text: str, least: int = 3) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer: the last sentence, or the last third of the
    words if there is no sentence end that leaves both at least three words."""
    for m in reversed(list(_END.finditer(text))):
        q, a = _WORD.findall(text[: m.end()].lower()), _WORD.findall(text[m.end() :].lower())
        if len(q) >= least and len(a) >= least:
            return q, a
    words = _WORD.findall(text.lower())
    cut = max(1, len(words) - max(1, len(words) // 3)) if len(words) > 1 else len(words)
    return words[:cut], words[cut:]


def _grams(words: list[str], width: int) -> set:
    width = min(width, len(words))
    return set(zip(*(words[k:] for k in range(width)), strict=False)) if width else set()


def size_class(words: int) -> int:
    """What passages of items of so many words overlap by: a power of 2, with room for two words more."""
    return max(16, 1 << (words + 1).bit_length())


class Index:
    """Inverted index of items of one size class; each term has its greatest impact in each block of
    items, and in each of at most `most_ranges` ranges of blocks.

    Impacts are shares of what the item would score against itself, so one threshold fits all
    items: a score of 1 means that all of an item's terms are in the passage. Items that share
    their commonest term, which goes with the language, lie in neighbouring blocks, which
    keeps the bounds of blocks near the scores of their items.
    """

    def __init__(self, items: list[tuple[int | None, list[str], list[str]]], frequency: dict[str, int], n_items: int, mean_words: float, threshold: float, k1: float = 1.2, b: float = 0.75, width: int = 3, block: int = 4, most_ranges: int = 256):
        items = sorted(items, key=lambda i: (max((frequency[t], t) for t in i[1] + i[2]), i[0] is not None, i[0] or 0, i[1], i[2]))
        self.ids = [i for i, _, _ in items]
        self.threshold, self.width, self.block = threshold, width, block
        self.longest = size_class(max((len(q) + len(a) for _, q, a in items), default=1))
        self.question = [_grams(q, width) for _, q, _ in items]
        self.answer = [_grams(a, width) for _, _, a in items]
        self.parts = [(q, a) for _, q, a in items]
        self.sizes = [(min(width, len(q)), min(width, len(a))) for _, q, a in items]
        self.term: dict[str, int] = {}
        #: For each term the items that have it, in order, their impacts, its blocks, and its greatest impact in them.
        self.items: list[list[int]] = []
        self.impacts: list[list[float]] = []
        for at, (_, q, a) in enumerate(items):
            tf = Counter(q + a)
            norm = k1 * (1 - b + b * sum(tf.values()) / max(mean_words, 1e-9))
            raw = {t: np.log1p((n_items - frequency[t] + 0.5) / (frequency[t] + 0.5)) * c * (k1 + 1) / (c + norm) for t, c in tf.items()}
            whole = sum(raw.values())
            for t, v in raw.items():
                k = self.term.setdefault(t, len(self.items))
                if k == len(self.items):
                    self.items.append([])
                    self.impacts.append([])
                self.items[k].append(at)
                self.impacts[k].append(float(v / whole))
        self.tops = [self._tops(k, block) for k in range(len(self.items))]
        blocks = len(items) // block + 1
        self.span = block * -(-blocks // most_ranges)
        self.ranges = -(-max(1, len(items)) // self.span)
        tops = [sorted(self._tops(k, self.span).items()) for k in range(len(self.items))]
        self.first = np.cumsum([0, *(len(t) for t in tops)])
        self.top_range = np.array([r for t in tops for r, _ in t], dtype=np.int64)
        self.top = np.array([v for t in tops for _, v in t], dtype=np.float64)

    def _tops(self, k: int, span: int) -> dict[int, float]:
        top: dict[int, float] = {}
        for at, v in zip(self.items[k], self.impacts[k], strict=True):
            top[at // span] = max(v, top.get(at // span, 0.0))
        return top

    def passages(self, terms: np.ndarray, at_once: int = 1 << 20) -> Iterator[tuple[int, list[int], list[int]]]:
        """(start, distinct terms, live ranges) of the passages of a text in which the greatest impacts of some range
        sum up to the threshold; terms has -1 for words that no item has.

        Each occurrence of an item lies in a passage, as they overlap by half. Passages are taken so many
        at a time that no more than at_once bounds are held, however long the text is.
        """
        half = self.longest
        n = max(1, -(-len(terms) // half) - 1)
        step = max(1, at_once // self.ranges)
        for low in range(0, n, step):
            high = min(n, low + step)
            part = terms[low * half : (high + 1) * half if high < n else len(terms)]
            at = np.flatnonzero(part >= 0)
            if not len(at):
                continue
            where = at // half
            # Each word is in the passage that begins in its half, and in the one before.
            passage = np.concatenate([where, where - 1])
            word = np.concatenate([part[at], part[at]])
            inside = (passage >= 0) & (passage < high - low) | (passage == high - low) & (high == n)
            pairs = np.unique(np.minimum(passage[inside], high - low - 1) * len(self.items) + word[inside])
            passage, word = pairs // len(self.items), pairs % len(self.items)
            size = self.first[word + 1] - self.first[word]
            ends = np.cumsum(size)
            flat = np.arange(ends[-1]) + np.repeat(self.first[word] - (ends - size), size)
            bound = np.bincount(np.repeat(passage, size) * self.ranges + self.top_range[flat], weights=self.top[flat], minlength=(high - low) * self.ranges)
            hit = np.flatnonzero(bound >= self.threshold - 1e-9)
            for p in np.unique(hit // self.ranges).tolist():
                live = (hit[np.searchsorted(hit, p * self.ranges) : np.searchsorted(hit, (p + 1) * self.ranges)] - p * self.ranges).tolist()
                yield (low + p) * half, word[np.searchsorted(passage, p) : np.searchsorted(passage, p + 1)].tolist(), live

    def wand(self, terms: list[int], low: int, high: int) -> list[tuple[int, float]]:
        """All items from low to high that score at least the threshold, by block-max WAND.

        cursors hold (item, term, position), in order of items. The pivot is the first cursor up to
        which the terms' greatest impacts reach the threshold; no item before its can.
        """
        least, block, out = self.threshold - 1e-9, self.block, []
        cursors = []
        for t in terms:
            post = self.items[t]
            k = bisect_left(post, low)
            if k < len(post) and post[k] < high:
                cursors.append((post[k], t, k))
        greatest = {t: max(self.impacts[t]) if len(self.impacts[t]) < 8 else self._greatest(t) for _, t, _ in cursors}

        def move(upto: int, item: int) -> None:
            """Advances the first cursors to the first item from item on; those at their end go."""
            moved = []
            for at, t, k in cursors[:upto]:
                if at < item:
                    post = self.items[t]
                    k = bisect_left(post, item, k)
                    at = post[k] if k < len(post) else high
                if at < high:
                    moved.append((at, t, k))
            cursors[:upto] = moved
            cursors.sort()

        cursors.sort()
        while cursors:
            total, pivot = 0.0, -1
            for i, (_, t, _) in enumerate(cursors):
                total += greatest[t]
                if total >= least:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            here = item // block
            if sum(self.tops[t].get(here, 0.0) for _, t, _ in cursors[: pivot + 1]) < least:
                beyond = (here + 1) * block
                move(pivot + 1, min(beyond, cursors[pivot + 1][0]) if pivot + 1 < len(cursors) else beyond)
            elif cursors[0][0] == item:
                score = sum(self.impacts[t][k] for _, t, k in cursors[: pivot + 1])
                if score >= least:
                    out.append((item, score))
                move(pivot + 1, item + 1)
            else:
                move(pivot + 1, item)
        return out

    def _greatest(self, t: int) -> float:
        return float(self.top[self.first[t] : self.first[t + 1]].max())

    def retrieve(self, terms: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(start, item, score) of all items above the threshold, by passage."""
        for start, inside, live in self.passages(terms):
            for r in live:
                for at, score in self.wand(inside, r * self.span, min(len(self.ids), (r + 1) * self.span)):
                    yield start, at, score

    def near(self, at: int, words: list[str], start: int, held: tuple[float, float], least: tuple[float, float]) -> tuple[float, float, bool]:
        """Overlaps of question and answer, and whether the passage holds the item, where one edited word
        can take a part under its share of grams.

        Such a part is aligned word by word with where it must lie by the item's other grams that
        the passage has; its overlap is the share of words found in order. Of a part of two words
        one is enough if the other part is whole.
        """
        low = [k for k in (0, 1) if held[k] < least[k]]
        if any(len(grams := (self.question, self.answer)[k][at]) - self.width >= least[k] * len(grams) or len(self.parts[at][k]) < 2 for k in low):
            return *held, False
        offsets: dict[tuple, list[int]] = {}
        for k, part in enumerate(self.parts[at]):
            w = self.sizes[at][k]
            for i in range(len(part) - w + 1 if w else 0):
                offsets.setdefault(tuple(part[i : i + w]), []).append(i + k * len(self.parts[at][0]))
        begins: Counter = Counter()
        for w in {*self.sizes[at]} - {0}:
            for i in range(start, min(len(words), start + 2 * self.longest) - w + 1):
                begins.update(i - o for o in offsets.get(tuple(words[i : i + w]), ()))
        best = (*held, False)
        for begin, _ in begins.most_common(8):
            now, enough = list(held), True
            for k in low:
                part = self.parts[at][k]
                first = begin + k * len(self.parts[at][0])
                same = _in_order(part, words[max(0, first - 1) : max(0, first + len(part) + 1)])
                now[k] = max(held[k], same / len(part))
                enough &= now[k] >= least[k] or len(part) == 2 and same == 1 and held[1 - k] == 1
            best = max(best, (*now, enough), key=lambda x: (x[2], x[0] + x[1]))
        return best

    def hits(self, words: list[str], terms: np.ndarray, question: float, answer: float) -> list[tuple]:
        """(item_id, score, question overlap, answer overlap, first word) of the items in a text."""
        best: dict[int, tuple] = {}
        grams: dict[int, set] = {}
        now = -1
        for start, at, score in self.retrieve(terms):
            if start != now:
                now, grams = start, {}
            part = words[start : start + 2 * self.longest]
            for w in self.sizes[at]:
                if w not in grams:
                    grams[w] = _grams_of(part, w)
            q, a = (len(have & grams[w]) / len(have) if have else 1.0 for have, w in zip((self.question[at], self.answer[at]), self.sizes[at], strict=True))
            found = q >= question and a >= answer
            if not found:
                q, a, found = self.near(at, words, start, (q, a), (question, answer))
            if found and (at not in best or (q + a, score) > best[at][:2]):
                best[at] = (q + a, score, q, a, start)
        return [(self.ids[at], score, q, a, start) for at, (_, score, q, a, start) in sorted(best.items())]


def _in_order(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _grams_of(words: list[str], width: int) -> set:
    return set(zip(*(words[k:] for k in range(width)), strict=False))


def index(items: DataFrame, threshold: float = 0.5, block_bytes: int = 16 << 20) -> DataFrame:
    """block, bytes and data, an Index of some items of a size class, of about block_bytes of text at most.

    Document frequencies are those of all items. Null texts and texts without words are no items; of
    rows with the same id and text one is used; a null item_id stays null. Blocks are built by
    tasks; the driver gets the sizes of classes only.
    """
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()

    def read(batches):
        for batch in small(batches):
            parts = [split_item(t) for t in batch.column(1).to_pylist()]
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([q for q, _ in parts], kind), pa.array([a for _, a in parts], kind)], names=["item_id", "question", "answer"])

    words = F.concat("question", "answer")
    read_items = rows.mapInArrow(read, "item_id long, question array<string>, answer array<string>").where("size(question) > 0")
    length = F.size(words)
    step = F.greatest(F.lit(16.0), F.pow(F.lit(2.0), F.floor(F.log2(length + F.lit(1.5))) + 1))  # as size_class()
    read_items = keep(read_items.select(F.monotonically_increasing_id().alias("item"), "item_id", "question", "answer", step.cast("long").alias("class")), "items")
    n, mean = read_items.agg(F.count("*"), F.avg(F.size(words))).first()
    text_bytes = F.sum(F.octet_length(F.array_join(words, " ")))
    blocks = {r[0]: 1 + (r[1] or 0) // block_bytes for r in read_items.groupBy("class").agg(text_bytes).collect()}  # a row for each power of 2
    terms = read_items.select("item", F.explode(F.array_distinct(words)).alias("term"))
    counts = terms.groupBy("term").agg(F.count("*").alias("n"))
    known = terms.join(counts, "term").groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias("n"))
    among = F.coalesce(*(F.when(F.col("class") == c, F.lit(b)) for c, b in blocks.items()), F.lit(1))
    block = F.concat_ws("-", F.col("class"), F.pmod(F.xxhash64("item"), among))

    def build(key, frame):
        frequency: dict[str, int] = {}
        for x in frame["n"]:
            frequency.update(x)
        held = [(None if i is None or i != i else int(i), list(q), list(a)) for i, q, a in zip(frame["item_id"].astype(object), frame["question"], frame["answer"], strict=True)]
        data = pickle.dumps(Index(held, frequency, n, mean, threshold))
        return frame.iloc[:1].assign(block=key[0], bytes=len(data), data=data)[["block", "bytes", "data"]]

    named = read_items.join(known, "item").select(block.alias("block"), "item_id", "question", "answer", "n")
    return keep(named.groupBy("block").applyInPandas(build, "block string, bytes long, data binary"), "index")


def _scanner(path: str, groups: list[list[str]], question: float, answer: float):
    """For a task: texts -> for each the hits in all blocks of the index, with one group of blocks in memory at a time."""

    def load(blocks: list[str]) -> tuple[dict[str, int], list[tuple[Index, np.ndarray]]]:
        from pyarrow import fs, parquet

        store, inner = filesystem(path)
        found = []
        for info in sorted(store.get_file_info(fs.FileSelector(inner)), key=lambda i: i.path):
            if info.path.endswith(".parquet"):
                with store.open_input_file(info.path) as f:
                    rows = parquet.ParquetFile(f)
                    for k in range(rows.num_row_groups):
                        names = rows.read_row_group(k, columns=["block"]).column(0).to_pylist()
                        if {*names} & {*blocks}:
                            data = rows.read_row_group(k, columns=["data"]).column(0)
                            found += [pickle.loads(data[i].as_py()) for i, name in enumerate(names) if name in blocks]
        vocabulary: dict[str, int] = {}
        for x in found:
            for t in x.term:
                vocabulary.setdefault(t, len(vocabulary))
        out = []
        for x in found:
            own = np.full(len(vocabulary) + 1, -1, dtype=np.int64)
            own[[vocabulary[t] for t in x.term]] = [*x.term.values()]
            out.append((x, own))
        return vocabulary, out

    held = [load(groups[0])] if len(groups) == 1 else None

    def scan(texts: list[str | None]) -> list[list[tuple]]:
        words = [_WORD.findall(t.lower()) if t else [] for t in texts]
        out: list[list[tuple]] = [[] for _ in texts]
        for k, group in enumerate(groups):
            vocabulary, indexes = held[k] if held else load(group)
            get = vocabulary.get
            for w, hits in zip(words, out, strict=True):
                if w:
                    ids = np.array([get(x, -1) for x in w])
                    for x, own in indexes:
                        hits += x.hits(w, own[ids], question, answer)
        return out

    return scan


def _groups(built: DataFrame, most_bytes: int) -> list[list[str]]:
    """Names of the blocks that fit into most_bytes together; a row a block comes to the driver, without data."""
    groups: list[list[str]] = []
    size = 0
    for name, n in sorted(tuple(r) for r in built.select("block", "bytes").collect()):
        if not groups or size + n > most_bytes:
            groups.append([])
            size = 0
        groups[-1].append(name)
        size += n
    return groups


def contaminated(docs: DataFrame, items: DataFrame, question: float = 0.6, answer: float = 0.6, held_bytes: int = 64 << 20, **kwargs) -> DataFrame:
    """doc_id and item_id of documents that hold a test item, with the BM25 share of the
    passage, the shares of question and answer 3-grams that it holds, and where it starts. For
    parts so short that one edited word takes most of their 3-grams, words in order count.

    Every passage of every whole text, however long, is a query. Null or empty texts hold nothing;
    repeated rows each have their rows in the result; of passages that hold an item equally well the
    first by score is told; an empty table of either kind gives an empty result. A null item_id is
    told as null. Extra columns are not read, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    built = index(items, **kwargs)
    path, groups = built._kept_at, _groups(built, held_bytes)
    if not groups:
        return docs.sparkSession.createDataFrame([], f"doc_id long, {_HIT}")

    def run(batches):
        scan = _scanner(path, groups, question, answer)
        for batch in small(batches, 1024 if len(groups) == 1 else 1 << 16):
            found = [(i, *hit) for i, hits in zip(batch.column(0).to_pylist(), scan(batch.column(1).to_pylist()), strict=True) for hit in hits]
            cols = list(zip(*found, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "word_start"])

    return docs.mapInArrow(run, f"doc_id long, {_HIT}")


def clean(docs: DataFrame, items: DataFrame, question: float = 0.6, answer: float = 0.6, held_bytes: int = 64 << 20, **kwargs) -> DataFrame:
    """The rows of docs, all columns, that hold no test item; no shuffle. Nulls, repeated rows,
    long texts and empty tables as in contaminated(); all columns are kept, whatever their names."""
    built = index(items, **kwargs)
    path, groups = built._kept_at, _groups(built, held_bytes)
    if not groups:
        return docs

    def run(batches, at=docs.columns.index("text")):
        scan = _scanner(path, groups, question, answer)
        for batch in small(batches, 1024 if len(groups) == 1 else 1 << 16):
            yield batch.filter(pa.array([not hits for hits in scan(batch.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
