"""Token counts in rollups that deltas maintain.

A rollup is a folder of small tables, one for each committed batch, with signed sums by source,
language and tokenizer version. Sums of sums are the totals, so inserts, deletes and revised
counts are all additions, in any order. A batch takes effect when its commit file appears, which
happens once: a batch that is applied again changes nothing.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer_version")
_TOTALS = "source string, lang string, tokenizer_version string, docs long, tokens long"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE vocabularies of this kind cut texts before merging (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def token_counts(docs: DataFrame, path: str = TOKENIZER, columns: tuple[str, ...] = ("doc_id", "source", "lang")) -> DataFrame:
    """The named columns of docs with tokens, the number of tokens of each whole text (null: 0).

    path names a tiktoken vocabulary on the driver; its ranks, a fixed size, go to the executors.
    """
    with open(path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    picked = docs.select(*columns, F.col("text").alias("__text"))
    fields = picked.schema.fields[:-1]
    names = [f.name for f in fields]

    def run(batches):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, held.value.splitlines())}
        encode = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*names, "tokens"])

    return picked.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "tokens long"]))


def inserted(rows: DataFrame) -> DataFrame:
    """Changes that add rows with the columns of KEYS and tokens."""
    return rows.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.col("tokens").cast("long").alias("tokens"))


def deleted(rows: DataFrame) -> DataFrame:
    """Changes that take rows away which were inserted with these tokens."""
    return rows.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).cast("long").alias("tokens"))


def revised(rows: DataFrame) -> DataFrame:
    """Changes from old_tokens to tokens; the number of documents stays."""
    return rows.select(*KEYS, F.lit(0).cast("long").alias("docs"), (F.col("tokens") - F.col("old_tokens")).cast("long").alias("tokens"))


class Rollup:
    """Totals by source, language and tokenizer version in a folder that all executors share.

    Null keys are groups like any other; null tokens count as 0. Groups whose documents are all
    deleted are left out of the totals.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = lambda *x: spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *x]))
        self._conf = spark._jsc.hadoopConfiguration()

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def batches(self) -> dict[str, dict]:
        """Commits by batch id. Commits that a compaction took up are in its list."""
        fs, folder = self._fs(), self._path("commits")
        if not fs.exists(folder):
            return {}
        lines = self.spark.read.text([f"{self.path}/commits"], pathGlobFilter="*.json").collect()
        return {c["batch"]: c for c in (json.loads(r.value) for r in lines)}

    def _taken(self) -> tuple[list[str], set[str]]:
        """Tables to sum up and ids of the batches that they hold.

        Compactions that ran at once may hold the same batches. The largest counts, then others that share none with
        it; a batch that none of these holds counts by its own table, which is never deleted.
        """
        commits = self.batches()
        held: set[str] = set()
        tables = []
        for b, c in sorted(((b, c) for b, c in commits.items() if "holds" in c), key=lambda x: (-len(x[1]["holds"]), x[0])):
            if not held & {b, *c["holds"]}:
                held |= {b, *c["holds"]}
                tables.append(c["table"])
        tables += [c["table"] for b, c in sorted(commits.items()) if "holds" not in c and b not in held]
        return tables, {*commits, *(b for c in commits.values() for b in c.get("holds", ()))}

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit the changes of a batch; False, and nothing done, if the batch was committed before.

        Changes are summed up by key before they are shuffled. A run that dies before its commit
        leaves a table that no commit names. Of two runs of a batch at once, one commits.
        """
        if batch in self._taken()[1]:
            return False
        return self._commit(batch, changes, {})

    def _commit(self, batch: str, changes: DataFrame, more: dict) -> bool:
        name = f"tables/{uuid.uuid4().hex}"
        sums = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"))
        sums.coalesce(1).write.parquet(f"{self.path}/{name}")
        jvm, fs = self.spark._jvm, self._fs()
        draft = self._path("drafts", uuid.uuid4().hex)
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"batch": batch, "table": name, **more}).encode()))
        out.close()
        fs.mkdirs(self._path("commits"))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri() if self._path().toUri().getScheme() else fs.getUri(), self._conf)
        final = self._path("commits", base64.urlsafe_b64encode(batch.encode()).decode() + ".json")
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, none)  # fails if the commit exists
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        return True

    def totals(self) -> DataFrame:
        tables, _ = self._taken()
        if not tables:
            return self.spark.createDataFrame([], _TOTALS)
        rows = self.spark.read.schema(_TOTALS).parquet(*(f"{self.path}/{t}" for t in tables))
        return rows.groupBy(*KEYS).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def compact(self) -> bool:
        """Sum up all committed batches in one table, whose commit is named after the ids that it holds and lists them."""
        tables, ids = self._taken()
        if len(tables) < 2:
            return False
        rows = self.spark.read.schema(_TOTALS).parquet(*(f"{self.path}/{t}" for t in tables))
        name = hashlib.sha256("\0".join(sorted(ids)).encode()).hexdigest()
        return self._commit(f"compact-{name}", rows, {"holds": sorted(ids)})
