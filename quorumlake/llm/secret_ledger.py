"""Secret scans by an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its content. The ledger has a row for each blob that was ever
scanned, with the rule versions it was scanned by and the spans found; a scan reads only blobs, and of their rules only those,
that the ledger lacks. Findings are then joined back to every path (document) that holds the blob.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEDGER = "blob string, versions array<string>, spans array<struct<rank:int,kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """Matches are leftmost and non-overlapping; those whose group has fewer than `least` characters are dropped.

    any_of: strings one of which is in every match (empty: unknown); texts without them aren't searched.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    either_case: bool = False
    any_of: tuple[str, ...] = ()

    @property
    def version(self) -> str:
        said = repr((self.kind, self.pattern, self.group, self.least, self.either_case))
        return f"{self.kind}-{hashlib.sha256(said.encode()).hexdigest()[:12]}"


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True, (":", "=")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, False, ("AKIA",)),
    Rule("hex", r"[0-9a-f]{32,}"),  # the runs of [0-9a-f]+ that have 32 or more characters
)
ADDED = (
    Rule("pem", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----", any_of=("-----BEGIN ",)),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", any_of=("eyJ",)),
    Rule("url", r"\b[a-z][a-z0-9+.-]*://[^\s:/@]+:([^\s:/@]{8,})@", any_of=("://",)),
)
RULES = BASE + ADDED


def _scan(text: str, rules: list[tuple[int, Rule, re.Pattern]]) -> list[dict]:
    found = []
    for rank, rule, pattern in rules:
        if not rule.any_of or any(x in text for x in rule.any_of):
            for m in pattern.finditer(text):
                if len(m[rule.group]) >= rule.least:
                    found.append({"rank": rank, "kind": rule.kind, "start": m.start(), "end": m.end()})
    return found


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of LEDGER from (blob, text, todo): each text is scanned whole by the rules whose versions are in todo."""

    def run(batches):
        compiled = {r.version: (i, r, re.compile(r.pattern, re.A | (re.I if r.either_case else 0))) for i, r in enumerate(rules)}
        kind = pa.list_(pa.struct([("rank", pa.int32()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            todo = b.column("todo").to_pylist()
            spans = [_scan(t, [compiled[v] for v in vs]) for t, vs in zip(b.column("text").to_pylist(), todo, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("blob"), pa.array(todo, pa.list_(pa.string())), pa.array(spans, kind)], ["blob", "versions", "spans"])

    return blobs.select("blob", "text", "todo").mapInArrow(run, LEDGER)


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, blob, text): a null text is an empty one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("path"), F.sha2(text, 256).alias("blob"), text.alias("text"))


def update(paths: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that the ledger lacks, from versions(): blobs never seen, and seen ones for rules they were not scanned by.

    One path stands for each blob, so a text held by a third of all paths is read once. Append the result to the ledger.
    """
    wanted = F.array(*[F.lit(r.version) for r in rules])
    known = paths.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is None:
        known = known.withColumn("todo", wanted)
    else:
        seen = ledger.select("blob", F.explode("versions").alias("v")).groupBy("blob").agg(F.collect_set("v").alias("seen"))
        known = known.join(seen, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))).drop("seen")
        known = known.filter(F.size("todo") > 0)
    known = known.select(F.col("blob").alias("b"), F.col("path").alias("p"), "todo")
    texts = paths.join(known, F.col("path").eqNullSafe(F.col("p")) & (F.col("blob") == F.col("b")))
    return scan_blobs(texts, rules)


def findings(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, spans) of each row of paths: what the ledger has for its blob by these rules, ordered by start, then rule.

    Ledger rows of older rule versions are passed over. Rows repeated in paths or in the ledger change no spans.
    """
    current = F.array(*[F.lit(r.version) for r in rules])
    rows = ledger.filter(F.arrays_overlap("versions", current) & (F.size("spans") > 0)).select("blob", F.explode("spans").alias("s")).distinct()
    rows = rows.filter(F.col("s.kind").isin([r.kind for r in rules]))
    order = F.transform(F.array_sort(F.collect_list(F.struct("s.start", "s.rank", "s.kind", "s.end"))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    by_blob = rows.groupBy("blob").agg(order.alias("spans"))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return paths.select("path", "blob").join(by_blob, "blob", "left").select("path", F.coalesce("spans", empty).alias("spans"))


def secrets(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, new ledger rows) of docs. Null and empty texts have no spans; no rows give no rows; other columns aren't read."""
    from .shared import cut

    paths = versions(docs, id_col, text_col)
    new = cut(update(paths, ledger))
    return findings(paths, new if ledger is None else ledger.unionByName(new)), new
