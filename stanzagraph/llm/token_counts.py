"""Token totals that signed deltas keep up to date."""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stanzagraph.llm.common import give_back, per_process, pick, shared_dir, slices, staged
from stanzagraph.llm.packing import WordTokens, readable

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"


def deltas(rows: DataFrame, sign: int, tokenizer: str, tokens: str = "tokens") -> DataFrame:
    """Rows (source, lang, ``tokens``) inserted (sign 1) or deleted (-1) under a tokenizer version."""
    own = pick(rows, source="source", lang="lang", tokens=tokens)
    return own.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("documents"), (F.lit(sign) * F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"))


def revisions(rows: DataFrame, tokenizer: str, before: str, after: str) -> DataFrame:
    """Rows whose counts change from ``before`` to ``after``: no document more or less."""
    own = pick(rows, source="source", lang="lang", before=before, after=after)
    change = F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))
    return own.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(0).cast("long").alias("documents"), change.cast("long").alias("tokens"))


def counter(name: str, path: str) -> tuple[Callable[[pa.StringArray], list[int]], Callable[[], None]]:
    """How a tokenizer's file counts texts, and what a task's end frees: .json of tokenizers, .tiktoken of tiktoken."""
    if path.endswith(".json"):
        words = per_process(("words", path), lambda: WordTokens(path))
        return lambda texts: [len(ids) // 4 for ids in words.encode_all(texts)], words.forget

    def ranks():  # noqa: ANN202
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            made = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=made, special_tokens={})

    encoding = per_process(("ranks", path), ranks)
    return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts.to_pylist()], lambda: give_back(keep=True)


def count_tokens(docs: DataFrame, tokenizers: dict[str, str], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of every row, as they are, and its number of tokens by each tokenizer (name: path of its file).

    Special tokens aren't added, and their strings in a text are counted as the file's
    library does. Null and empty texts have 0 tokens. Very long texts are counted whole.
    """
    keep = keep or []
    names = [f"keep_{i}" for i in range(len(keep))]
    picked = pick(docs, text=text, **dict(zip(names, keep, strict=True))).withColumn("text", F.col("text").cast("binary"))
    fields = ", ".join([*[f"{n} {picked.schema[n].dataType.simpleString()}" for n in names], *[f"count_{i} long" for i in range(len(tokenizers))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = [counter(name, path) for name, path in tokenizers.items()]
        for some in slices(batches, 0):
            texts = readable(some.column(0))
            counts = [pa.array(of(texts), pa.int64()) for of, _ in count]
            yield pa.RecordBatch.from_arrays([*some.columns[1:], *counts], names=[*names, *[f"count_{i}" for i in range(len(count))]])
        for _, free in count:
            free()

    return picked.mapInArrow(run, fields).toDF(*keep, *tokenizers)


class TokenRollup:
    """Totals of documents and tokens by source, language and tokenizer version.

    Every batch of signed deltas is summed and written as a small table of its own. The
    manifest with the highest number says which tables count and which batch ids are in; a
    commit writes its table first and then the next manifest, which is there whole or not
    at all, and which only one of several writers can put under its number: the others
    read the new one and try again. So a batch is in the totals once, whoever commits or
    replays it, and a commit or compaction that is killed changes nothing. Totals are the
    sums over the manifest's tables, in any order of arrival; compact() sums them into one
    table. A manifest holds all batch ids, so it grows with the batches, not with the data.

    Null sources and languages are groups of their own; null counts are 0. Keys that sum
    to no documents and no tokens have no row. Before any batch: no rows. Repeated rows
    count each. Extra columns of deltas are ignored. Sums are made in part before they
    meet, so no key is gathered.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _latest(self) -> tuple[int, dict]:
        """The highest manifest's number and content."""
        root = self._path(f"{self.path}/manifests")
        numbers = [int(s.getPath().getName()) for s in self._fs.listStatus(root) if s.getPath().getName().isdigit()] if self._fs.exists(root) else []
        if not numbers:
            return 0, {"tables": [], "batches": []}
        stream = self._fs.open(self._path(f"{self.path}/manifests/{max(numbers):020d}"))
        try:
            return max(numbers), json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, number: int, content: dict) -> bool:
        """Put a manifest under its number, whole; False if there is one already.

        A local folder needs a hard link for that, since renaming replaces files there;
        elsewhere a file isn't renamed onto another.
        """
        aside, name = self._path(f"{self.path}/aside/{uuid.uuid4().hex}"), self._path(f"{self.path}/manifests/{number:020d}")
        self._fs.mkdirs(name.getParent())
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                files, at = self._jvm.java.nio.file.Files, lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                files.createLink(at(name), at(aside))
                return True
            return self._fs.rename(aside, name)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self._fs.delete(aside, False)

    def batches(self) -> set[str]:
        """Ids of the batches that are in the totals."""
        return set(self._latest()[1]["batches"])

    def _written(self, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/tables/{name}")
        return name

    def commit(self, batch_id: str, rows: DataFrame) -> bool:
        """Add a batch; False if a batch of this id is in already."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        if batch_id in self.batches():
            return False
        own = pick(rows, **{c: c for c in [*KEYS, "documents", "tokens"]})
        name = self._written(own.groupBy(*KEYS).agg(F.sum(F.coalesce("documents", F.lit(0))).alias("documents"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens")))
        while True:
            number, now = self._latest()
            if batch_id in now["batches"]:
                self._fs.delete(self._path(f"{self.path}/tables/{name}"), True)
                return False
            if self._publish(number + 1, {"tables": [*now["tables"], name], "batches": [*now["batches"], batch_id]}):
                return True

    def _sums(self, tables: list[str]) -> DataFrame:
        if not tables:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/tables/{n}" for n in tables])
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).filter("documents <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        return self._sums(self._latest()[1]["tables"])

    def compact(self) -> None:
        """Sum the tables into one; commits may run meanwhile."""
        _, seen = self._latest()
        if len(seen["tables"]) < 2:
            return
        name = self._written(self._sums(seen["tables"]))
        while True:
            number, now = self._latest()
            if not set(seen["tables"]) <= set(now["tables"]):  # another compaction was faster
                self._fs.delete(self._path(f"{self.path}/tables/{name}"), True)
                return
            rest = [t for t in now["tables"] if t not in seen["tables"]]
            if self._publish(number + 1, {"tables": [name, *rest], "batches": now["batches"]}):
                return

    def vacuum(self) -> None:
        """Delete tables and manifests that no longer count. No commit, compaction or reader may run meanwhile."""
        number, now = self._latest()
        for folder, keep in (("tables", set(now["tables"])), ("manifests", {f"{number:020d}"}), ("aside", set())):
            root = self._path(f"{self.path}/{folder}")
            for s in self._fs.listStatus(root) if self._fs.exists(root) else []:
                if s.getPath().getName() not in keep:
                    self._fs.delete(s.getPath(), True)


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under two tokenizer versions; estimates revised; toxic documents deleted; one batch replayed."""
    import public_tokenizers

    words, byte = "word_bpe_49k", "byte_bpe_50k"
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text", lang="lang", source="source", n_chars="n_chars")
    labels = pick(spark.read.parquet(f"{sf_dir}/labels.parquet"), doc_id="doc_id", toxic="toxic")
    counts = count_tokens(docs, {words: public_tokenizers.path(f"{words}.json"), byte: public_tokenizers.path(f"{byte}.tiktoken")}, keep=["doc_id", "source", "lang", "n_chars"])
    rows = staged(counts.withColumn("estimate", F.floor(F.coalesce("n_chars", F.lit(0)) / 4).cast("long")), "counts")
    rollup = TokenRollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("load-words", deltas(rows, 1, words, words))
    rollup.commit("load-bytes", deltas(rows, 1, byte, "estimate"))
    revised = revisions(rows, byte, "estimate", byte)
    rollup.commit("revise-bytes", revised)
    rollup.commit("revise-bytes", revised)  # a replay
    rollup.compact()
    gone = rows.join(labels.filter("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    rollup.commit("delete-toxic", deltas(gone, -1, words, words).union(deltas(gone, -1, byte, byte)))
    return rollup.totals()
