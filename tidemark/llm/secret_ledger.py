"""Secret scans with an incremental ledger of blobs.

A history is rows of (path, version, text). Each text is content-addressed: its blob is the SHA-256 of its UTF-8 bytes, so
a text that many paths and versions hold is one blob. The ledger, a folder of Parquet batches, tells of each blob which
rules it was scanned by, in which version of the rule, and what they found. A scan asks it which pairs of blob and rule
version are new, fetches one text for each such blob, scans it by the missing rules alone and appends a batch; findings of
any history are then a join of its (path, version, blob) with the ledger. A new path, a reverted file or a copied tree costs
no scan, and a changed rule costs one scan of that rule.

A batch becomes visible by Spark's commit or not at all, and pairs that a lost run had committed are not scanned again.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, join_by_weight, map_rows, stored

_SPANS = "array<struct<rule: string, begin: long, end: long>>"
_BATCH = f"blob binary, scanned array<string>, spans {_SPANS}"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: the version counts up when its finder changes. Finders give (begin, end) in code points, in order."""

    name: str
    version: int
    find: Callable[[str], Iterator[tuple[int, int]]] = field(compare=False)
    base: bool = False

    @property
    def mark(self) -> str:
        return f"{self.name}@{self.version}"


# The base patterns, letters of the names in either case of ASCII.
_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
# Patterns of the added rules. Every attempt begins where no other of its run can, or is bounded.
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++")
URL = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@\"'<>]{1,128}:[^\s/@\"'<>]{1,128}@")
PEM_BEGIN, PEM_END = re.compile("-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"), re.compile("-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----")


def find_assign(text: str) -> Iterator[tuple[int, int]]:
    for m in ASSIGN.finditer(text) if ":" in text or "=" in text else ():
        if m.end(1) - m.start(1) >= 6:
            yield m.span()


def find_access(text: str) -> Iterator[tuple[int, int]]:
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= 20:
            yield m.span()


def find_hex(text: str) -> Iterator[tuple[int, int]]:
    for m in HEX.finditer(text):
        yield m.span()


def find_jwt(text: str) -> Iterator[tuple[int, int]]:
    for m in JWT.finditer(text) if "eyJ" in text else ():
        yield m.span()


def find_pem(text: str) -> Iterator[tuple[int, int]]:
    """A private key from its first to its last line; to the end of its first line where no last one follows."""
    at, ends = 0, True
    while m := PEM_BEGIN.search(text, at) if "-----BEGIN " in text else None:
        last = PEM_END.search(text, m.end()) if ends else None
        ends = bool(last)
        at = last.end() if last else m.end()
        yield m.start(), at


def find_url(text: str) -> Iterator[tuple[int, int]]:
    for m in URL.finditer(text) if "://" in text else ():
        yield m.span()


#: In the order in which findings that begin together are listed. Base rules first.
RULES = (Rule("assign", 1, find_assign, True), Rule("access", 1, find_access, True), Rule("hex", 1, find_hex, True), Rule("jwt", 1, find_jwt), Rule("pem", 1, find_pem), Rule("url", 1, find_url))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """blob, scanned (marks of rules) and spans: every committed batch below path; a blob has a row for each batch that scanned it."""
    if not _exists(spark, path):
        return spark.createDataFrame([], _BATCH)
    return spark.read.schema(_BATCH).option("recursiveFileLookup", "true").parquet(path)


def addressed(history: DataFrame, path_col: str = "path", text_col: str = "text", version_col: str | None = "version") -> DataFrame:
    """path, version and blob of every row; a null text counts as empty, which is a blob, too."""
    version = F.col(version_col).cast("long") if version_col else F.lit(None).cast("long")
    return history.select(F.col(path_col).alias("path"), version.alias("version"), F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)).alias("blob"))


def _place(path: str = "path", version: str = "version"):
    """A number that rows of one blob are told apart by."""
    return F.xxhash64(F.col(path).cast("string"), F.col(version))


def scan(history: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, path_col: str = "path", text_col: str = "text", version_col: str | None = "version") -> tuple[DataFrame, DataFrame]:
    """Bring the ledger at `path` up to date with a history; (its addressed rows, its blobs and their copies, the rows that hold each).

    Narrow rows decide: blobs are counted with partial sums, met with the ledger, and the texts of those that miss a rule are
    fetched by a semi-join on (blob, one row's place), so neither a text that all paths hold nor a seen one is moved more
    than once. A text scanned twice (rows equal in path, version and text) is written once.
    """
    spark = history.sparkSession
    bound_batches(spark)
    rows = stored(addressed(history, path_col, text_col, version_col), "secret-versions")
    blobs = stored(rows.groupBy("blob").agg(F.count(F.lit(1)).alias("copies"), F.min(_place()).alias("place")), "secret-blobs")
    wanted = F.array(*(F.lit(r.mark) for r in rules))
    known = ledger(spark, path).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("known"))
    new = blobs.join(known, "blob", "left").select("blob", "place", F.array_except(wanted, F.coalesce("known", F.array().cast("array<string>"))).alias("missing")).filter(F.size("missing") > 0)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    version = F.col(version_col).cast("long") if version_col else F.lit(None).cast("long")
    texts = history.select(F.unhex(F.sha2(text, 256)).alias("blob"), F.xxhash64(F.col(path_col).cast("string"), version).alias("place"), text.alias("text"))
    todo = texts.join(new.hint("shuffle_hash"), ["blob", "place"])

    def make(c: dict) -> dict:
        by = {r.mark: r for r in rules}
        spans = [[{"rule": by[m].name, "begin": b, "end": e} for m in missing for b, e in by[m].find(t)] for t, missing in zip(c["text"], c["missing"], strict=True)]
        return {"blob": c["blob"], "scanned": c["missing"], "spans": spans}

    map_rows(todo.select("blob", "text", "missing"), make, _BATCH).dropDuplicates(["blob"]).write.parquet(f"{path}/{uuid.uuid4().hex}")
    return rows, blobs


def findings(history: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, path_col: str = "path", text_col: str = "text", version_col: str | None = "version") -> DataFrame:
    """path, version, blob and spans (rule, begin, end, by begin, then by the rules' order) of every row, once the ledger at `path` has been brought up to date.

    Only the given rules in their given versions count. Null and empty texts have no spans; repeated rows have equal ones;
    null paths and versions stay; further columns are ignored; an empty history gives no rows.
    """
    rows, blobs = scan(history, path, rules, path_col, text_col, version_col)
    marks = F.array(*(F.lit(r.mark) for r in rules))
    names = {r.name: F.lit(r.mark) for r in rules}
    mark = F.create_map(*(x for n, m in names.items() for x in (F.lit(n), m)))
    rank = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))))
    told = ledger(history.sparkSession, path).filter(F.arrays_overlap("scanned", marks)).join(blobs.select("blob", "copies"), "blob")
    own = F.filter("spans", lambda s: F.array_contains(F.col("scanned"), F.try_element_at(mark, s.rule)))
    ordered = lambda x: F.transform(F.array_sort(F.transform(x, lambda s: F.struct(s.begin.alias("begin"), F.try_element_at(rank, s.rule).alias("rank"), s.end.alias("end"), s.rule.alias("rule")))), lambda s: F.struct(s.rule.alias("rule"), s.begin.alias("begin"), s.end.alias("end")))
    found = told.select("blob", "copies", own.alias("spans")).groupBy("blob").agg(F.max("copies").alias("copies"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    found = stored(found.withColumn("spans", ordered(F.col("spans"))), "secret-findings")
    return join_by_weight(rows, found, "blob", "copies").select("path", "version", "blob", "spans")


def digests(found: DataFrame, id_col: str = "path") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row."""
    base = [r.name for r in RULES if r.base]
    say = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s.rule, s.begin.cast("string"), s.end.cast("string"))), ",")
    count = lambda n: F.size(F.filter("spans", lambda s: s.rule == n)).cast("long").alias(f"n_{n}")
    return found.select(F.col(id_col).cast("long").alias("doc_id"), *map(count, base), F.sha2(say(F.filter("spans", lambda s: s.rule.isin(base))), 256).alias("base_sha256"), say(F.col("spans")).alias("spans"))
