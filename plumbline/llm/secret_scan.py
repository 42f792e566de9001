"""Secret scanning with corpus-wide ownership of each candidate.

A first pass finds candidates in each text. Their hashes are then counted over the corpus by
distinct repository and distinct owner: what many owners carry is a copied example, what one
owner carries looks live.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import carried, column, cut, joined, sliced, text_of

KINDS = ("assign", "access", "hex", "pem", "forge", "chat", "jwt")
#: Found by the base patterns; the others are additions.
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# A run that is too short fails whole, so asking for the full length here finds the same places.
OTHERS = (
    ("access", "AKIA", re.compile(r"AKIA[A-Z0-9]{12,}")),
    ("hex", "", re.compile(r"[0-9a-f]{32,}")),
    ("pem", "-----BEGIN", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")),
    ("forge", "gh", re.compile(r"gh[opusr]_[A-Za-z0-9]{36,}")),
    ("chat", "xox", re.compile(r"xox[abeprs]-[A-Za-z0-9-]{10,}")),
)
JWT = "eyJ"
JWT_RUN, JWT_REST = re.compile(r"[A-Za-z0-9_-]+"), re.compile(r"\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}")
SHORTEST_VALUE = 8
SCANNED = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, _pl_cands array<string>"


def find_jwts(text: str) -> list[tuple[int, int]]:
    """(start, end) of every jwt: at the first eyJ of a run of its characters, whatever stands before it.

    Where that one fails, the others of its run are shorter and fail too, so each run is read from one start only.
    """
    out = []
    at = text.find(JWT)
    while at >= 0:
        end = JWT_RUN.match(text, at).end()
        rest = JWT_REST.match(text, end) if end - at >= len(JWT) + 8 else None
        if rest:
            end = rest.end()
            out.append((at, end))
        at = text.find(JWT, end)
    return out


def find_secrets(text: str) -> list[tuple[int, int, int, str]]:
    """(start, place in KINDS, end, value) of every candidate, in order; offsets are code points."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= SHORTEST_VALUE]
    for k, (_, part, pattern) in enumerate(OTHERS, 1):
        if part in text:
            found += [(m.start(), k, m.end(), m[0]) for m in pattern.finditer(text)]
    found += [(a, KINDS.index("jwt"), b, text[a:b]) for a, b in find_jwts(text)]
    return sorted(found)


def _joined(found) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in found)


def _scan(batches, width: int):
    """Adds SCANNED to the first ``width`` columns; the one after them is the text."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()))
    for batch in sliced(batches):
        out: list[tuple] = []
        for text in batch.column(width).to_pylist():
            found = find_secrets(text)
            base = [x for x in found if x[1] < len(BASE)]
            out.append(
                (*(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found), sorted({hashlib.sha256(x[3].encode()).hexdigest() for x in found}))
            )
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:width], *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], names=[*batch.schema.names[:width], "n_assign", "n_access", "n_hex", "base_sha256", "spans", "_pl_cands"]
        )


def scan_secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), repository: str = "doc_id", owner: str = "source", copied_from: int = 3) -> DataFrame:
    """One row per document: its spans and how its candidates are spread over the corpus.

    Adds n_candidates (distinct values), n_copied (carried by ``copied_from`` owners or more),
    n_owned (by one owner only), widest_owners and widest_repositories (largest counts). Null
    text counts as empty; a null owner or repository counts as an owner or repository of its
    own. Rows that repeat are each returned. An empty table gives an empty one, and columns
    not named in ``keep`` are not returned; one in it that is named as an added one is replaced.
    """
    added = ("n_candidates", "n_copied", "n_owned", "widest_owners", "widest_repositories")
    base = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
    kept = carried(docs, keep, (*base, *added))
    inner = docs.select(*kept.inner, column(repository).cast("string").alias("_pl_repo"), column(owner).cast("string").alias("_pl_owner"), text_of(text).alias("_pl_text"))
    width = len(inner.columns) - 1
    found = cut(inner.mapInArrow(lambda b: _scan(b, width), ", ".join([*kept.schema, "_pl_repo string", "_pl_owner string", SCANNED]))).withColumn("_pl_row", F.monotonically_increasing_id())
    each = found.where(F.size("_pl_cands") > 0).select("_pl_row", "_pl_repo", "_pl_owner", F.explode("_pl_cands").alias("hash"))
    # First by owner, then by hash: a value that a third of all rows carry is summed before it meets, and joined back by broadcast.
    by_pair = each.groupBy("hash", "_pl_owner", "_pl_repo").agg(F.lit(1).alias("one"))
    by_owner = by_pair.groupBy("hash", "_pl_owner").agg(F.count("*").alias("repositories"))
    spread = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    per_row = (
        joined(each.select("_pl_row", "hash"), spread, ["hash"])
        .groupBy("_pl_row")
        .agg(
            F.count("*").alias("n_candidates"), F.count_if(F.col("owners") >= copied_from).alias("n_copied"), F.count_if(F.col("owners") == 1).alias("n_owned"),
            F.max("owners").alias("widest_owners"), F.max("repositories").alias("widest_repositories"),
        )
    )
    own = [c for c in found.columns if c.startswith("_pl_k")]
    return kept.named(found.join(per_row, "_pl_row", "left").select(*own, *base, *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in added)))
