"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed: its blob is the SHA-256 of its bytes. The ledger, a Parquet table, has a row
for each pair of a blob and a rule version that was scanned, with the spans found. A scan reads one copy of each blob that
lacks a pair, runs the missing rules over its whole text, appends to the ledger, and findings are joined back to every path
that has the blob. A new version of a rule is a new pair, so only that rule runs again.

Texts aren't shuffled unless the rows to leave out (further copies, blobs the ledger has) are too many to broadcast.

Defined results: a null text counts as empty; rows are told apart by where they stand, so repeated doc_ids and null ones
keep a row each; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import bounded, documents, located, released, scratch, stored

#: A private key: from its first line to its END line, whatever stands between but another such line. Where END is missing, over
#: the header lines (Proc-Type and such) and base64 lines that follow, the last of which may be short; a line may end in a
#: written \n, stand in quotes or be indented, as in JSON and source code.
_GAP = r"""(?:\s|\\+[nrt]|["'+>#*|,])"""
_PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----(?:BEGIN|END) )[\s\S])*-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:(?:{_GAP}+[A-Za-z][A-Za-z0-9-]*:\x20[^\r\n\\]*)*(?:{_GAP}+[A-Za-z0-9+/]{{16,}}={{0,2}})+)?(?:{_GAP}+[A-Za-z0-9+/]+(?:={{1,2}}|(?=[\"']?[\x20\t]*(?:[\r\n]|\\+[nr]|\Z))))?)"
)

#: The rules by kind, in the order in which kinds are listed: version, pattern, least length and the group it holds for.
RULES: dict[str, tuple[int, str, int, int]] = {
    "assign": (1, r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    "access": (1, r"AKIA[A-Z0-9]+", 18, 0),
    "hex": (1, r"[0-9a-f]{16,}", 16, 0),
    "jwt": (1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 30, 0),
    "pem": (3, _PEM, 27, 0),
}
BASE = ("assign", "access", "hex")
KINDS = list(RULES)

LEDGER_TYPE = "blob string, kind string, version int, spans array<struct<start:int,stop:int>>"


def find(kind: str, text: str, rules: dict = RULES) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of a kind, without those that are too short, as code points with an exclusive end."""
    _, pattern, least, group = rules[kind]
    return [m.span() for m in re.finditer(pattern, text) if m.end(group) - m.start(group) >= least]


def blob_id(text: F.Column) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class Ledger:
    """The table of scanned pairs at a path. Appends are whole Parquet jobs; a pair that two scans both add is read once."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], LEDGER_TYPE)
        return self.spark.read.schema(LEDGER_TYPE).parquet(self.path)

    def add(self, found: DataFrame) -> None:
        found.write.mode("append").parquet(self.path)


def unseen(blobs: DataFrame, ledger: DataFrame, rules: dict) -> DataFrame:
    """blobs (blob, file, row) that lack a pair, with the kinds that they lack."""
    wanted = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v[0]).alias("version")) for k, v in rules.items()])
    seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))
    left = F.filter(wanted, lambda x: ~F.coalesce(F.array_contains(F.col("seen"), x), F.lit(False)))
    return blobs.join(seen, "blob", "left").withColumn("todo", F.transform(left, lambda x: x.kind)).where(F.size("todo") > 0).drop("seen")


def _scan(rules: dict, pairs: dict[str, list[str]] | None = None):
    kinds = list(rules)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blob, kind, version, spans = [], [], [], []
            todo = batch.column("todo").to_pylist() if "todo" in batch.schema.names else None
            for i, text in enumerate(batch.column("text")):
                text = text.as_py() or ""
                digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
                for k in todo[i] if todo is not None else kinds:
                    blob.append(digest)
                    kind.append(k)
                    version.append(rules[k][0])
                    spans.append([{"start": a, "stop": b} for a, b in find(k, text, rules)])
            made = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
            yield pa.record_batch([pa.array(blob, pa.string()), pa.array(kind, pa.string()), pa.array(version, pa.int32()), pa.array(spans, pa.list_(made))], ["blob", "kind", "version", "spans"])

    return scan


def scan_into(docs: DataFrame, ledger: Ledger, rules: dict = RULES) -> DataFrame:
    """Bring the ledger up to date for docs (located()); return file, row, doc_id, blob of every path."""
    paths = stored(docs.select(F.col("_file").alias("file"), F.col("_row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), blob_id(F.col("text")).alias("blob")), "paths")
    blobs = paths.groupBy("blob").agg(F.min(F.struct("file", "row")).alias("first")).select("blob", "first.file", "first.row")
    todo = stored(unseen(blobs, ledger.read(), rules).select("file", "row", "todo"), "unseen")
    n, total, all_kinds = todo.count(), paths.count(), len(rules)
    whole = todo.where(F.size("todo") == all_kinds)
    texts = docs.select(F.col("_file").alias("file"), F.col("_row").alias("row"), "text")
    if n == whole.count() and n > total - n:
        # Most rows are new blobs: leave out the rest instead
        rest = paths.join(todo, ["file", "row"], "left_anti").select("file", "row")
        fresh = texts.join(bounded(rest, total - n), ["file", "row"], "left_anti").select("text")
    else:
        fresh = texts.join(bounded(todo, n), ["file", "row"]).select("text", "todo")
    ledger.add(fresh.mapInArrow(released(_scan(rules)), LEDGER_TYPE))
    return paths


def findings(paths: DataFrame, ledger: DataFrame, rules: dict = RULES) -> DataFrame:
    """paths with spans, an array of (start, rank of the kind, stop, kind) in order, from the ledger's current rule versions."""
    rank = F.create_map(*[x for i, k in enumerate(rules) for x in (F.lit(k), F.lit(i))])
    current = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v[0]).alias("version")) for k, v in rules.items()])
    found = ledger.where(F.array_contains(current, F.struct("kind", "version"))).where(F.size("spans") > 0).dropDuplicates(["blob", "kind", "version"])
    by_blob = found.select("blob", "kind", F.inline("spans")).groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", rank[F.col("kind")].alias("rank"), "stop", "kind"))).alias("spans"))
    return paths.join(by_blob, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(by_blob.schema["spans"].dataType)))


def redact_secrets(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """docs with each found span replaced by <secret:KIND> (overlapping spans by one) and n_chars, if there is one, counted anew. No row goes."""
    rows = located(docs)
    ledger = ledger or Ledger(docs.sparkSession, scratch(docs.sparkSession, "blob-ledger"))
    found = findings(scan_into(rows, ledger), ledger.read()).where(F.size("spans") > 0)
    found = stored(found.select(F.col("file").alias("_file"), F.col("row").alias("_row"), F.col("spans").alias("_spans")), "secrets")
    # Spans come by start: a running end tells which ones begin a new redaction
    step = F.aggregate(
        "_spans", F.struct(F.lit(0).alias("end"), F.lit("").alias("out")),
        lambda a, s: F.when(s.start >= a.end, F.struct(s.stop.alias("end"), F.concat(a.out, F.substring(F.col("text"), a.end + 1, s.start - a.end), F.lit("<secret:"), s.kind, F.lit(">")).alias("out")))
        .otherwise(F.struct(F.greatest(a.end, s.stop).alias("end"), a.out.alias("out"))),
        lambda a: F.concat(a.out, F.substring(F.col("text"), a.end + 1, F.length("text"))),
    )
    clean = rows.join(bounded(found), ["_file", "_row"], "left").withColumn("_clean", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(step))
    new = {"text": F.col("_clean")} | ({"n_chars": F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("_clean").cast("long"))} if "n_chars" in docs.columns else {})
    return clean.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = Ledger(spark, scratch(spark, "blob-ledger"))
    found = findings(scan_into(located(documents(spark, sf_dir)), ledger), ledger.read())
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.stop)), ",")
    base = F.filter("spans", lambda x: x.kind.isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
