"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text (its blob).  The ledger
is a folder of two Parquet tables: ``scans(blob_id, rules)`` with the rule versions a blob
was scanned by, and ``findings``.  A scan looks only at (blob, rule version) pairs that the
ledger lacks, each blob once however many paths and versions hold it, appends what it found,
and joins the ledger's findings back to all paths.  Findings are appended before scans, and
are read as a set: a scan that broke off in between is simply repeated.

Texts move only where they have to be scanned: a text without any hint of the rules can't hold a secret and is
entered as scanned without being moved, and of the others those travel whose blob the ledger lacks.

Secrets never leave a scan: findings carry their SHA-256.

Nulls: rows without text have no blob and no findings; a null source or doc_id is an empty
part of the path.  Empty texts are a blob without findings.  Very long texts are scanned whole.  Repeated rows are one version, scanned
once.  Ties: of the paths of a blob the smallest lends its text.  Only ``doc_id``, ``source`` and ``text`` are read, so other columns never clash.  An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lexloom.storage import materialize, new_path

from .sides import without


@dataclass(frozen=True)
class Rule:
    """A pattern whose group 1 is the secret; a text has to contain one of the hints (lower case)."""

    name: str
    version: int
    pattern: str
    hints: tuple[str, ...]
    ignore_case: bool = False
    #: the secret has to hold a digit and a letter
    mixed: bool = False

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


FIRST_RULES = (
    Rule("assigned-credential", 1, r"""\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)["']?[ \t]*[=:][ \t]*["']?([A-Za-z0-9+/_-]{16,})""", ("token", "secret", "passw", "key"), True, True),
    Rule("aws-access-key", 1, r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b", ("akia", "asia")),
    Rule("github-token", 1, r"\b(gh[pousr]_[A-Za-z0-9]{36,})\b", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack-token", 1, r"\b(xox[abprs]-[A-Za-z0-9-]{10,})", ("xox",)),
    Rule("google-api-key", 1, r"\b(AIza[0-9A-Za-z_-]{35})", ("aiza",)),
    Rule("live-payment-key", 1, r"\b([sr]k_live_[0-9a-zA-Z]{16,})", ("k_live_",)),
    Rule("json-web-token", 1, r"\b(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", ("eyj",)),
    Rule("private-key", 1, r"(-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----)", ("private key-----",)),
)

#: Keywords at the end of a longer name (DB_PASSWORD, accessToken), which assigned-credential leaves out; a rule of its
#: own, so that its findings are none of that rule's version 1.
RULES = (
    *FIRST_RULES,
    Rule("named-credential", 1, FIRST_RULES[0].pattern.replace(r"\b", r"\B", 1), FIRST_RULES[0].hints, True, True),
)

FINDINGS = "blob_id string, rule string, rule_version int, fingerprint string, n_matches int"
SCANS = "blob_id string, rules array<string>"


def may_hold(low: str, hints: Iterable[str]) -> bool:
    """Whether a lower-cased text holds a hint."""
    return any(h in low for h in hints)


def _hinted(rules: Sequence[Rule]):
    hints = sorted({h for r in rules for h in r.hints})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([may_hold(text.as_py().lower(), hints) for text in batch.column(1)], pa.bool_()))

    return run


def find_secrets(text: str, rules: Sequence[Rule]) -> list[tuple[str, int, str, int]]:
    """(rule, version, fingerprint, matches) of a text."""
    out = []
    low = text.lower()
    for rule in rules:
        if not may_hold(low, rule.hints):
            continue
        found = Counter(m.group(1) for m in re.finditer(rule.pattern, text, re.ASCII | (re.IGNORECASE if rule.ignore_case else 0)))
        for secret, n in found.items():
            if rule.mixed and not (re.search("[0-9]", secret) and re.search("[A-Za-z]", secret)):
                continue
            out.append((rule.name, rule.version, hashlib.sha256(secret.encode()).hexdigest(), n))
    return out


def _scan(rules: Sequence[Rule]):
    by_key = {r.key: r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for blob, text, todo in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                rows += [(blob, *x) for x in find_secrets(text.as_py(), [by_key[k] for k in todo])]
            if rows:
                names, versions, prints, n = zip(*(r[1:] for r in rows), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows]), pa.array(names), pa.array(versions, pa.int32()), pa.array(prints), pa.array(n, pa.int32())],
                    names=["blob_id", "rule", "rule_version", "fingerprint", "n_matches"],
                )

    return run


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as gone:
        if "PATH_NOT_FOUND" not in str(gone):
            raise
        return spark.createDataFrame([], schema)


def blob_id(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def path_of(docs: DataFrame) -> Column:
    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    return F.concat(source, F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def update_ledger(docs: DataFrame, ledger: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Scan what the ledger lacks; returns the blobs of all versions: (doc_id, path, blob_id)."""
    spark = docs.sparkSession
    held = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), path_of(docs).alias("path"), F.col("text").cast("string").alias("text"))
    refs = materialize(held.select("doc_id", "path", blob_id(F.col("text")).alias("blob_id")).distinct(), "secret-refs")
    seen = _read(spark, f"{ledger}/scans", SCANS).groupBy("blob_id").agg(F.flatten(F.collect_set("rules")).alias("rules"))
    keys = F.array(*(F.lit(r.key) for r in rules))
    blobs = refs.groupBy("blob_id").agg(F.min("path").alias("path")).join(seen, "blob_id", "left")
    todo = F.array_except(keys, F.coalesce("rules", F.array().cast("array<string>")))
    blobs = materialize(blobs.select("blob_id", "path", todo.alias("todo")).where(F.size("todo") > 0), "secret-unseen")
    # one row lends its text to all paths of a blob, repeated rows too
    asked = {r[0] for r in blobs.select(F.explode("todo")).distinct().collect()}
    texts = held.select("path", "text").mapInArrow(_hinted([r for r in rules if r.key in asked]), "path string, text string")
    texts = texts.select("path", blob_id(F.col("text")).alias("blob_id"), "text")
    unseen = texts.join(blobs, ["blob_id", "path"]).groupBy("blob_id").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
    unseen.mapInArrow(_scan(rules), FINDINGS).write.mode("append").parquet(f"{ledger}/findings")
    blobs.select("blob_id", F.col("todo").alias("rules")).write.mode("append").parquet(f"{ledger}/scans")
    return refs.select("doc_id", "path", "blob_id")


def secret_scan(docs: DataFrame, ledger: str | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Findings of the given rule versions at all paths: (doc_id, path, blob_id, rule, rule_version, fingerprint, n_matches).

    Without a ledger folder a new one is begun, so every blob is scanned.
    """
    ledger = ledger or new_path(docs.sparkSession, "secret-ledger")
    refs = update_ledger(docs, ledger, rules)
    keys = [r.key for r in rules]
    found = _read(docs.sparkSession, f"{ledger}/findings", FINDINGS).where(F.concat_ws("@", "rule", F.col("rule_version").cast("string")).isin(keys)).distinct()
    return refs.join(found, "blob_id").select("doc_id", "path", "blob_id", "rule", "rule_version", "fingerprint", "n_matches")


def drop_secrets(docs: DataFrame, ledger: str | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Documents without a finding; all columns and other rows stay, those without text too."""
    bad = secret_scan(docs, ledger, rules).select("blob_id").distinct()
    return without(docs, blob_id(docs["text"].cast("string")), bad)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger filled by ``FIRST_RULES`` is brought up to ``RULES``: the second scan looks only at the pairs that are new."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ledger = new_path(spark, "secret-ledger")
    update_ledger(docs, ledger, FIRST_RULES)
    return secret_scan(docs, ledger, RULES)


def _sql() -> str:
    parts = []
    for r in RULES:
        pattern = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT blob_id, '{r.name}' AS rule, {r.version}::INT AS rule_version, unnest(regexp_extract_all(text, '{pattern}', 1, '{'i' if r.ignore_case else 'c'}')) AS secret, {str(r.mixed).upper()} AS mixed FROM b"
        )
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') || '/' || coalesce(doc_id::VARCHAR, '') AS path, text, sha256(text) AS blob_id FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT DISTINCT blob_id, text FROM d
), f AS (
  {" UNION ALL ".join(parts)}
), g AS (
  SELECT blob_id, rule, rule_version, sha256(secret) AS fingerprint, count(*)::INT AS n_matches FROM f
  WHERE NOT mixed OR (regexp_matches(secret, '[0-9]') AND regexp_matches(secret, '[A-Za-z]')) GROUP BY ALL
)
SELECT DISTINCT doc_id, path, blob_id, rule, rule_version, fingerprint, n_matches FROM d JOIN g USING (blob_id)
"""


OP10_SQL = _sql()
