"""Exact n-gram Jaccard join by partition of the universe (after Deng et al., PVLDB 2015).

Two sets with Jaccard similarity of at least p/q differ in at most (|r|+|s|)(q-p)/(q+p)
elements, H for the sizes of a band. Hashing cuts the universe of shingles into segments; a
segment may be given 1 (its part must be equal) or 2 (equal, or equal after one deletion).
When what is given sums up to more than H, any such pair agrees in a segment: signatures of
these parts find all pairs, and nothing but exact checks follows.

Empty parts would agree everywhere, so they have no signature. What a record's parts can
give is then min(given, size of the part); if that is too little, the record is *thin* and gets
signatures from another hash of the universe as well, up to LEVELS, and finally one for each
shingle. A pair is found at the first level where one of the two isn't thin.

Groups aren't expanded into pairs. Records with equal sets are one node. The rows of a batch that
share a signature are compared with the first of them, which alone goes on to the shuffle; there
the first ones are compared with the smallest. Buckets that still hold more than one component
are compared with a few random members at a time, until few enough pairs of different components
are left to look at each. Every link lies within a component or has been checked, so
components are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.common import Marks, drop_kept, keep, located, marked_rows, small
from gradus.llm.components import components
from gradus.llm.shingles import WordHasher, digest, folded, parity, scramble, shingle_set, words_of

LEVELS = 6
#: What a comparison by sketch needs of a node: size, parity folded to 256 bits, whole parity.
_SKETCH = ("n", "h0", "h1", "h2", "h3", "par")

_ROWS = "file long, at long, row long, doc_id long, k1 long, k2 long, n int, h0 long, h1 long, h2 long, h3 long, par array<long>, sigs array<long>, again array<long>, centers array<long>"
_SETS = "node long, n int, shingles array<long>"


def bands(growth: float = 1.5, largest: int = 1 << 40) -> list[int]:
    """Least sizes of the bands. Growth above q/p, so that partners are at most one band apart."""
    out = [1]
    while out[-1] < largest:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * growth))))
    return out


class Plan:
    """Segments of each band and what they are given: the cheapest by a simple model.

    A band's records write one row for a segment given 1, and one more for each element of the
    part for a segment given 2; n_rows of the band and the chance that an element of a record is
    in an unrelated one too (alike) say how many wrong candidates a choice brings. The model
    only weighs costs; every choice finds all pairs.
    """

    def __init__(self, p: int, q: int, sizes: dict[int, tuple[int, float]], growth: float = 1.5, alike: float = 0.3, candidate_cost: float = 0.002):
        if q >= growth * p:
            raise ValueError("bands must grow by more than q/p")
        self.p, self.q, self.low = p, q, bands(growth)
        self.given = []
        for b in range(len(self.low) - 1):
            high = self.low[b + 1] - 1
            need = 2 * high * (q - p) // (q + p) + 1
            units = need if need == 1 else need + 1 + need // 30
            rows, mean = sizes.get(b, (1, (self.low[b] + high) / 2))
            best = None
            for twos in {0, units // 8, units // 4, units // 2}:
                m = units - twos
                t = mean / m
                wrong = (m - twos) * alike**t + twos * (alike**t + t * alike ** max(t - 1, 0) * (1 - alike))
                cost = m + twos * t + candidate_cost * rows * wrong
                if best is None or cost < best[0]:
                    best = cost, m, twos
            self.given.append(best[1:])
            if high > 1 << 31:
                break

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def most_different(self, n: int, band: int) -> int:
        """By how many elements a set of n differs from a partner, when the larger is in band."""
        partner = min(self.low[band + 1] - 1, n * self.q // self.p)
        return (n + partner) * (self.q - self.p) // (self.q + self.p)

    def signatures(self, s: np.ndarray) -> np.ndarray:
        n = len(s)
        own = self.band(n)
        out = []
        for band in (own, own + 1):
            if band > own and n * self.q // self.p < self.low[band]:
                break
            need = self.most_different(n, band) + 1
            m, twos = self.given[band]
            for level in range(LEVELS):
                x = scramble(s ^ np.uint64((level + 1) * 0x2545F4914F6CDD1D & (2**64 - 1)))
                seg = ((x >> np.uint64(33)) % np.uint64(m)).astype(np.int64)
                with np.errstate(over="ignore"):
                    val = scramble(x + np.uint64(0x632BE59BD9B4E019))
                    size = np.bincount(seg, minlength=m)
                    low = np.bincount(seg, weights=(val & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=m).astype(np.uint64)
                    high = np.bincount(seg, weights=(val >> np.uint64(32)).astype(np.float64), minlength=m).astype(np.uint64)
                    total = (high << np.uint64(32)) + low
                    name = scramble(np.arange(m, dtype=np.uint64) + np.uint64((band * LEVELS + level + 1) << 32))
                    full = size > 0
                    out.append(scramble(total[full] ^ name[full]))
                    if twos:  # the first segments are given 2
                        shorter = (seg < twos) & (size[seg] > 1)
                        out.append(scramble((total[seg] - val)[shorter] ^ name[seg][shorter]))
                gives = int(np.minimum(size, 1).sum() + (size[:twos] > 1).sum())
                if gives >= need:
                    break
            else:
                out.append(scramble(s ^ np.uint64((band + 1) << 40)))
        return np.unique(np.concatenate(out))


def _first_of_batch(sigs: list[np.ndarray | None], rows: np.ndarray) -> tuple[list, list, list]:
    """For each row its signatures that no earlier row of the batch has, the others, and the rows that have them first."""
    some = [i for i, x in enumerate(sigs) if x is not None]
    own, again, centers = [None] * len(sigs), [None] * len(sigs), [None] * len(sigs)
    if not some:
        return own, again, centers
    flat = np.concatenate([sigs[i] for i in some])
    ends = np.cumsum([len(sigs[i]) for i in some])
    _, first, inverse = np.unique(flat, return_index=True, return_inverse=True)
    first = first[inverse]
    is_first = first == np.arange(len(flat))
    owner = rows[np.repeat(some, np.diff(ends, prepend=0))]
    for i, start, end in zip(some, [0, *ends[:-1]], ends, strict=True):
        mine = is_first[start:end]
        own[i] = flat[start:end][mine]
        if not mine.all():
            again[i], centers[i] = flat[start:end][~mine], owner[first[start:end][~mine]]
    return own, again, centers


def _rows(plan: Plan, width: int):
    kinds = (*[pa.int64()] * 6, pa.int32(), *[pa.int64()] * 4, *[pa.list_(pa.int64())] * 4)
    names = [x.split()[0] for x in _ROWS.split(", ")]

    def run(batches):
        hashed, seen = WordHasher(50_000), set()
        for batch in small(batches, 4096):
            k1, k2, n, par, sigs, heads = [], [], [], [], [], []
            for text in (t for k in range(0, batch.num_rows, 512) for t in batch.column(4).slice(k, 512).to_pylist()):
                s = shingle_set(hashed(words_of(text)), width)
                k = digest(s) if len(s) else (0, 0)
                k1.append(k[0])
                k2.append(k[1])
                n.append(len(s))
                par.append(parity(s) if len(s) else None)
                heads.append(folded(par[-1]) if len(s) else np.zeros(4, dtype=np.int64))
                # Copies within a task need no signatures of their own.
                sigs.append(plan.signatures(s).view(np.int64) if len(s) and k not in seen else None)
                seen.add(k)
            lists = _first_of_batch(sigs, batch.column(2).to_numpy())
            made = [pa.array(c, t) for c, t in zip((k1, k2, n, *np.array(heads, dtype=np.int64).reshape(-1, 4).T, par, *lists), kinds[4:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *made], names=names)

    return run


def _sets(source: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, n and shingle set of the nodes in wanted (file, at, value), from a second look at the texts.

    Each task picks its own rows; nothing is broadcast, and only these sets leave it.
    """
    marks = Marks(wanted, "wanted")
    reader = marks.reader()

    def run(batches):
        hashed, pick = WordHasher(50_000), reader()
        for batch in small(batches):
            where, nodes = pick(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            sets = [shingle_set(hashed(words_of(t)), width) for t in batch.column(2).take(pa.array(where)).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "n", "shingles"])

    out = keep(source.select("file", "at", "text").mapInArrow(run, _SETS), "sets")
    marks.drop()
    return out


def _may_link(p: int, q: int):
    """What two sets' sizes and parities allow; columns of _SKETCH, with _a and _b. The folded parities
    come first, as the whole ones are slow to compare."""
    a, b = F.col("n_a"), F.col("n_b")
    x, y = F.col("par_a"), F.col("par_b")

    def halved(z):
        half = (F.size(z) / 2).cast("int")
        return F.zip_with(F.slice(z, 1, half), F.slice(z, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    def bits(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)

    differ = F.when(F.size(x) == F.size(y), bits(x, y)).when(F.size(x) == 2 * F.size(y), bits(halved(x), y)).when(F.size(y) == 2 * F.size(x), bits(x, halved(y))).otherwise(0)
    least = sum((F.bit_count(F.col(f"h{k}_a").bitwiseXOR(F.col(f"h{k}_b"))) for k in range(1, 4)), F.bit_count(F.col("h0_a").bitwiseXOR(F.col("h0_b"))))
    most = ((a + b) * (q - p)).cast("long")
    return (F.least(a, b) * q >= F.greatest(a, b) * p) & (least * (q + p) <= most) & (differ * (q + p) <= most)


def _verified(pairs: DataFrame, source: DataFrame, nodes: DataFrame, p: int, q: int, width: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are alike enough, as edges (u, v)."""
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = _sets(source, nodes.join(ids, "node", "left_semi").select("file", "at", F.col("node").alias("value")), width)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b")), "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    edges = keep(both.where(common * q >= (F.col("n_a") + F.col("n_b") - common) * p).select(F.col("a").alias("u"), F.col("b").alias("v")), "edges")
    drop_kept(sets)
    return edges


def _linked(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Components (id, root) after more edges."""
    return keep(components(edges.union(roots.select(F.col("id").alias("u"), F.col("root").alias("v")))), "roots")


def _side(held: DataFrame, x: str, *more: str) -> DataFrame:
    return held.select("sig", *more, *(F.col(c).alias(f"{c}_{x}" if c != "node" else x) for c in ("node", *_SKETCH, "comp")))


def _close(members: DataFrame, nodes: DataFrame, roots: DataFrame, checked: DataFrame, source: DataFrame, p: int, q: int, width: int, looks: int = 64, pivots: int = 16, most_pivots: int = 64) -> DataFrame:
    """Components once all links between the members (sig, node) of buckets are found.

    Pairs within a component don't matter. While a bucket-wide comparison would look at more
    than looks pairs for each member, all members are compared with some of their bucket, chosen
    by a hash of the node, then with four times as many others: what is alike falls together
    soon. The rest is compared pair by pair, and only pairs whose sizes and parities allow a
    link become rows. checked: pairs (a, b) that needn't be compared again.
    """
    seed, fruitless, nodes_here = 0, False, None
    while True:
        comp = nodes.join(roots, nodes["node"] == roots["id"], "left").select("node", *_SKETCH, F.coalesce("root", "node").alias("comp"))
        named = members.join(comp, "node")
        many = named.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("sig")
        held = keep(named.join(many, "sig", "left_semi"), "held")
        total, inside = held.count(), roots.where("id <> root").count()
        parts = held.groupBy("sig", "comp").agg(F.count("*").cast("double").alias("n"))
        work = parts.groupBy("sig").agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("pairs")).agg(F.sum("pairs")).first()[0] or 0
        last = work <= 2.0 * looks * total or pivots > most_pivots or fruitless
        if last:
            other = _side(held, "b")
        else:
            names = [f"x{k}" for k in range(pivots)]
            picked = held.groupBy("sig").agg(*(F.min_by("node", F.xxhash64("node", F.lit(seed + k))).alias(x) for k, x in enumerate(names)))
            picked = picked.select("sig", F.explode(F.array_distinct(F.array(*names))).alias("node"))
            other = _side(picked.join(comp, "node"), "b")
        pairs = _side(held, "a").join(other, "sig").where((F.col("comp_a") != F.col("comp_b")) & (F.col("a") < F.col("b") if last else F.lit(True)) & _may_link(p, q))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = keep(pairs.join(checked, ["a", "b"], "left_anti"), "pairs")
        edges = None if pairs.isEmpty() else _verified(pairs, source, nodes, p, q, width)
        if edges is not None and not edges.isEmpty():
            roots = _linked(edges, roots)
        if last:
            drop_kept(held, pairs)
            return roots
        nodes_here = nodes_here or held.select("node").distinct().count()
        fruitless = 50 * (roots.where("id <> root").count() - inside) < nodes_here
        checked = keep(checked.union(pairs), "checked")
        members = held.select("sig", "node")
        seed, pivots = seed + pivots, 4 * pivots


def _found(docs: DataFrame, similarity: tuple[int, int], width: int) -> DataFrame:
    """What near_duplicates() returns, with file and at of each row as located() names them."""
    p, q = similarity
    id_at, text_at = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    source = located(docs).select("file", "at", F.col(id_at).cast("long").alias("doc_id"), F.col(text_at).alias("text"))
    # Cost model only: about six bytes a word.
    low = bands()
    guess = F.greatest(F.lit(1), F.floor(F.octet_length("text") / 6))
    band = sum((F.when(guess >= x, 1).otherwise(0) for x in low[1:40]), F.lit(0))
    sizes = {r.band: (r.rows, r.mean) for r in source.where("text is not null").groupBy(band.alias("band")).agg(F.count("*").alias("rows"), F.avg(guess).alias("mean")).collect()}
    plan = Plan(p, q, sizes)

    numbered = source.select("file", "at", F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    rows = keep(numbered.mapInArrow(_rows(plan, width), _ROWS), "rows")
    some = rows.where("n > 0")
    # Of a node's rows the one that counts is the first; all nodes have their parity from it.
    first = some.groupBy("k1", "k2", "n").agg(F.min(F.struct("row", "file", "at", *_SKETCH[1:])).alias("x"), F.min("doc_id").alias("low"))
    nodes = keep(first.select("k1", "k2", "n", F.col("x.row").alias("node"), "x.file", "x.at", *(f"x.{c}" for c in _SKETCH[1:]), "low"), "nodes")
    named_rows = keep(some.where("sigs is not null or again is not null").select("row", "k1", "k2", "n").join(nodes.select("k1", "k2", "n", "node"), ["k1", "k2", "n"]).select("row", "node"), "named")

    in_bucket = Window.partitionBy("sig").orderBy("row")
    hits = some.where("sigs is not null").select(F.explode("sigs").alias("sig"), "row")
    hits = hits.select("sig", "row", F.first("row").over(in_bucket).alias("center")).where("row <> center")
    here = some.where("again is not null").select(F.explode(F.arrays_zip("again", "centers")).alias("x"), "row").select("x.again", "row", "x.centers")
    hits = keep(hits.union(here), "hits")
    plain = keep(rows.select("file", "at", "doc_id", "k1", "k2", "n"), "plain")
    drop_kept(rows)  # signatures are the largest part, and no longer needed

    stars = hits.select("row", "center").distinct()
    stars = stars.join(named_rows.select("row", F.col("node").alias("a")), "row").join(named_rows.select(F.col("row").alias("center"), F.col("node").alias("b")), "center").where("a <> b")
    stars = keep(stars, "stars")
    lean = nodes.select("node", *_SKETCH)
    pairs = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = pairs.join(lean.toDF("a", *(f"{c}_a" for c in _SKETCH)), "a").join(lean.toDF("b", *(f"{c}_b" for c in _SKETCH)), "b")
    pairs = keep(pairs.where(_may_link(p, q)).select("a", "b"), "pairs")
    edges = _verified(pairs, source, nodes, p, q, width)
    roots = keep(components(edges), "roots")

    # Buckets that have not fallen together: one of their comparisons was between components.
    apart = stars.join(roots.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b", "left")
    apart = apart.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("row", "center")
    open_sigs = hits.join(apart, ["row", "center"], "left_semi").select("sig").distinct()
    # Where two rows share a signature they have been compared; three or more have two hits at least.
    open_hits = keep(hits.join(open_sigs, "sig", "left_semi"), "open")
    three = open_hits.groupBy("sig").agg(F.count("*").alias("hits")).where("hits > 1").select("sig")
    wide = open_hits.join(three, "sig", "left_semi")
    members = wide.select("sig", "row").union(wide.select("sig", F.col("center").alias("row"))).join(named_rows, "row").select("sig", "node").distinct()
    members = keep(members, "members")
    drop_kept(hits, stars, open_hits)
    if not members.isEmpty():
        roots = _close(members, nodes, roots, pairs, source, p, q, width)
    drop_kept(members)

    named = nodes.join(roots, nodes["node"] == roots["id"], "left").select("k1", "k2", "n", "low", F.coalesce("root", "node").alias("root"))
    named = keep(named, "named")
    ids = keep(named.groupBy("root").agg(F.min("low").alias("component_id")), "ids")
    named = keep(named.join(ids, "root").select("k1", "k2", "n", "component_id", "root"), "classes")
    linked = plain.where("n > 0").join(named, ["k1", "k2", "n"])
    alone = plain.where("n = 0").withColumn("component_id", F.col("doc_id")).withColumn("root", F.lit(None).cast("long"))
    return linked.union(alone.select(*linked.columns)).withColumn("n_shingles", F.col("n").cast("long"))


def near_duplicates(docs: DataFrame, similarity: tuple[int, int] = (80, 100), width: int = 5) -> DataFrame:
    """doc_id, k1, k2, n_shingles, component_id, root of every row of docs.

    component_id is the smallest doc_id among the rows that links of Jaccard similarity of
    at least similarity (a fraction of integers) between sets of width-word shingles reach. k1
    and k2 together name the set; equal sets are one node, however many rows have it. root numbers
    components within one run (null without words).

    Null or empty texts, and texts without words: n_shingles 0, linked with nothing,
    component_id is the row's own doc_id. Null doc_id: takes part like any row and is
    no component's name unless the component has no other. Repeated rows: each has a row
    in the result. Very long texts are taken whole; a task holds the shingles of one batch. An
    empty table gives an empty result. Extra columns are not read, whatever their names.
    """
    return _found(docs, similarity, width).select("doc_id", "k1", "k2", "n_shingles", "component_id", "root")


def one_of_each(docs: DataFrame, similarity: tuple[int, int] = (80, 100), width: int = 5) -> DataFrame:
    """The rows of docs, all columns, without near duplicates: of each component the row with the
    smallest doc_id stays, one row if that is repeated. Rows without words all stay.

    Ties of doc_id: the row whose place in its file comes first. Null doc_ids come last. Which
    rows stay is looked up where they are read, so no text is shuffled.
    """
    source = docs if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" else keep(docs, "source")
    found = _found(source, similarity, width)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "file", "at")
    first = found.where("n > 0").groupBy("root").agg(F.min(order).alias("k")).select("k.file", "k.at")
    stay = first.union(found.where("n = 0").select("file", "at")).withColumn("value", F.lit(0).cast("long"))
    return marked_rows(source, Marks(stay, "stay"))
