"""Document rules and host verdicts with an empirical beta prior."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stanzagraph.llm.common import give_back, pick, salted_join, slices, staged

SYMBOLS = b"#*$%&|<>"
MEASURES = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: A host is refused if its shrunk rate is this many of the prior's deviations above the prior's mean.
SPREAD = 3.0
#: But up to the first share it never is, since most of its documents are fine, and above the second it always is.
LEAST_REFUSED, MOST_KEPT = 0.3, 0.5
#: Limits of the prior's weight, in documents.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 10000.0


def measure(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a UTF-8 text."""
    words = raw.split()  # bytes.split() parts at exactly \x20 and \x09-\x0d
    spaces = len(raw) - sum(map(len, words))
    chars = len(raw.decode("utf-8", "replace")) - spaces
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines, dup = set(), 0
    for line in raw.split(b"\n"):
        if line in lines:
            dup += bool(line.strip())
        else:
            lines.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    found = Counter(windows) if len(set(windows)) < len(windows) else {}
    covered, upto = 0, 0
    if found:
        for i, w in enumerate(windows):
            if found[w] > 1:
                covered += i + 3 - max(i, upto)
                upto = i + 3
    return len(words), chars, symbols, dup, covered


def measured(docs: DataFrame, doc_id: str, text: str, host: str, carry: list[str]) -> DataFrame:
    """MEASURES of every row, and its columns ``carry`` as carry_0, carry_1 and so on."""
    names = [f"carry_{i}" for i in range(len(carry))]
    picked = pick(docs, doc_id=doc_id, host=host, text=text, **dict(zip(names, carry, strict=True))).withColumn("text", F.col("text").cast("binary"))
    fields = "".join(f", {n} {picked.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 2):
            got = list(zip(*(measure(t or b"") for t in some.column(2).to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *(pa.array(c, pa.int64()) for c in got), *some.columns[3:]], names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *names])
        give_back()

    return picked.mapInArrow(run, MEASURES + fields)


def host_verdicts(rows: DataFrame, spread: float = SPREAD, least: float = LEAST_REFUSED, most: float = MOST_KEPT) -> DataFrame:
    """For each host: n, failures, shrunk_rate and refused, from rows of (host, base_failed).

    The prior is Beta(m k, (1 - m) k): m is the mean of the hosts' failure rates, and k comes
    from their variance less what chance alone gives hosts of their sizes, kept between 1 and
    10000 (10000 also where the rates vary no more than by chance). A host's rate is
    (failures + m k) / (n + k). It is refused if that is ``spread`` deviations of the prior
    above its mean; never up to ``least``, and always above ``most``. Null hosts are one host.
    """
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    rate = F.col("failures") / F.col("n")
    over_all = hosts.agg(F.avg(rate).alias("m"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("v"), F.avg(F.lit(1.0) / F.col("n")).alias("a"))
    noise = F.col("m") * (1 - F.col("m")) * F.col("a")
    between = F.when(F.col("a") < 1, (F.col("v") - noise) / (1 - F.col("a"))).otherwise(0.0)
    k = F.when(F.col("b") > 0, F.least(F.greatest(F.col("m") * (1 - F.col("m")) / F.col("b") - 1, F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT))).otherwise(MOST_WEIGHT)
    limit = F.greatest(F.least(F.col("m") + F.lit(spread) * F.sqrt(F.col("m") * (1 - F.col("m")) / (F.col("k") + 1)), F.lit(most)), F.lit(least))
    prior = over_all.select("m", between.alias("b")).select("m", k.alias("k")).select("m", "k", limit.alias("limit"))
    shrunk = (F.col("failures") + F.col("m") * F.col("k")) / (F.col("n") + F.col("k"))
    return hosts.join(F.broadcast(prior)).select("host", "n", "failures", shrunk.alias("shrunk_rate"), (shrunk > F.col("limit")).alias("refused"))  # the prior is one row


def apply_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", spread: float = SPREAD, least: float = LEAST_REFUSED, most: float = MOST_KEPT, carry: list[str] | None = None) -> DataFrame:
    """Measure every document, judge its host, and say which documents stay.

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word
    windows. kept: not base_failed and the host isn't refused (see host_verdicts).
    host_rate is the host's shrunk rate, host_refused its verdict.

    Null text counts as empty, so it fails. Null hosts are judged together. Very long texts
    are measured whole. Ties: a rate just at the limit isn't refused. Repeated rows
    are measured and returned each. Empty table: no rows. Extra columns are ignored, but
    for those in ``carry``, which are returned as they were. Hosts' counts are summed in part
    before they meet, and a verdict is copied SALTS times so that a hot host's documents,
    also if they are all alike, join in as many tasks.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    carry = carry or []
    rows = staged(measured(docs, doc_id, text, host, carry).withColumn("base_failed", failed), "measures")
    verdicts = host_verdicts(rows, spread, least, most).select("host", "shrunk_rate", "refused")
    joined = salted_join(rows.withColumn("row", F.monotonically_increasing_id()), verdicts, "host", ["row"])
    refused = F.coalesce("refused", F.lit(False))
    out = joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~refused).alias("kept"), F.col("shrunk_rate").alias("host_rate"), refused.alias("host_refused"), *[f"carry_{i}" for i in range(len(carry))])
    return out.toDF(*out.columns[:10], *carry)


def op5_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("host_rate", F.round("host_rate", 9))


OP5_SQL = """
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
         regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]') AS sy
  FROM documents),
li AS (
  SELECT doc_id, count(*) AS n_dup_lines FROM (
    SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS rn
    FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM w))
  WHERE rn > 1 AND regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
wo AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
tr AS (
  SELECT doc_id, i, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3
  FROM wo WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (
  SELECT doc_id, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, w2, w3) > 1 AS r FROM tr),
cov AS (
  SELECT doc_id, i, r OR coalesce(lag(r, 1) OVER o, false) OR coalesce(lag(r, 2) OVER o, false) AS c
  FROM rep WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rw AS (SELECT doc_id, count(*) FILTER (WHERE c) AS n_repeat_words FROM cov GROUP BY 1),
m AS (
  SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(sy) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN li USING (doc_id) LEFT JOIN rw USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::int) AS f FROM b GROUP BY 1),
p AS (SELECT avg(f / n) AS mean, coalesce(var_samp(f / n), 0) AS v, avg(1.0::DOUBLE / n) AS a FROM h),
q AS (SELECT mean, CASE WHEN a < 1 THEN (v - mean * (1 - mean) * a) / (1 - a) ELSE 0 END AS between_hosts FROM p),
k AS (SELECT mean, CASE WHEN between_hosts > 0 THEN least(greatest(mean * (1 - mean) / between_hosts - 1, 1.0), 10000.0) ELSE 10000.0 END AS k FROM q),
v AS (SELECT source, (f + mean * k) / (n + k) AS rate, (f + mean * k) / (n + k) > greatest(least(mean + 3 * sqrt(mean * (1 - mean) / (k + 1)), 0.5), 0.3) AS refused FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT refused AS kept, round(rate, 9) AS host_rate, refused AS host_refused
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
