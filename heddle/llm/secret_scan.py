"""Secret scans: all rules in one pass over the bytes of each text.

Method. The rules' patterns are compiled by subset construction into one minimal deterministic
automaton (``automaton``), once, on the driver; its transition arrays, some thousand numbers
whatever the input, go to the workers, which run every byte of every text through them once. Each
rule's matches are leftmost and non-overlapping by themselves; a match that is shorter than its
rule asks is dropped after it was matched, so what it covers isn't searched again. Places are code
points, ends exclusive: all patterns are of ASCII, so bytes are turned to code points at the ends.

Rules. ``assign`` (a value of six characters or more behind a keyword), ``access`` and ``hex`` are the
base; the others add spans of token formats that announce themselves, and change none of the base.

Defined cases. A null or empty text has no spans. A very long text is scanned alone, whole, in memory of
its own size. Repeated rows and ids are scanned each; order and ties don't matter. An empty table gives
an empty table. Other columns are carried; ``secrets`` replaces a column of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.automaton import Automaton
from heddle.workspace import ship_package


class Rule(NamedTuple):
    kind: str
    pattern: str
    #: Least characters of the match, or, with ``last``, of the run of a class that ends it.
    least: int
    last: bool = False


# Published formats.
BASE = [
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6, last=True),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]+", 24),
]
MORE = [
    Rule("forge", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("signed", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
]
RULES = BASE + MORE
SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"


class Scanner:
    """text -> (kind, start, end) of its spans, by start and then by the order of rules."""

    def __init__(self, rules: list[Rule]):
        self.rules, self.automaton = rules, Automaton(*zip(*[(r.pattern, r.least, r.last) for r in rules], strict=True))

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        data = text.encode("utf-8", "surrogatepass")
        kept = sorted((start, r, end) for r, start, end in self.automaton.scan(data))
        if kept and len(data) != len(text):
            inside = np.flatnonzero(np.frombuffer(data, "uint8") & 0xC0 == 0x80)
            place = lambda b: b - int(np.searchsorted(inside, b))
            return [(self.rules[r].kind, place(a), place(b)) for a, r, b in kept]
        return [(self.rules[r].kind, a, b) for a, r, b in kept]


def scan_secrets(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` without ``text``, plus ``secrets``: its spans, by start and then by the order of rules."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(rules))  # the arrays of the rules
    others = [c for c in docs.columns if c not in ("text", "secrets")]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = shared.value
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in scan(t.as_py() or "")] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(spans, kind)], names=[*others, "secrets"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema)
    return docs.select(*others, "text").mapInArrow(work, f"{schema}{', ' if others else ''}secrets {SPANS}")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    of = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    base = F.sha2(listed(of(*[r.kind for r in BASE])), 256)
    return scan_secrets(docs).select("doc_id", *counts, base.alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def _sql() -> str:
    """Places of matches from the lengths of the pieces between them."""
    parts = []
    for k, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''").replace(r"\x20", "[ ]")
        size = f"length(regexp_extract(m, '({pattern.replace('[A-Za-z0-9+/_.=-]+', ')([A-Za-z0-9+/_.=-]+)')}', 2))" if rule.last else "length(m)"
        parts.append(
            f"SELECT row, {k} AS k, '{rule.kind}' AS kind, before + len_before AS start, before + len_before + length(m) AS stop FROM ("
            f"SELECT row, m, sum(length(piece)) OVER o AS before, coalesce(sum(length(m)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS len_before FROM ("
            f"SELECT row, unnest(ms) AS m, unnest(pieces[1:len(ms)]) AS piece, generate_subscripts(ms, 1) AS j FROM ("
            f"SELECT row, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS pieces FROM docs)) "
            f"WINDOW o AS (PARTITION BY row ORDER BY j)) WHERE {size} >= {rule.least}"
        )
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    item = "concat_ws(':', kind, start::BIGINT, stop::BIGINT)"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(parts)})
SELECT any_value(doc_id) AS doc_id, {counts},
  sha256(coalesce(string_agg({item}, ',' ORDER BY start, k) FILTER (WHERE kind IN ({base})), '')) AS base_sha256,
  coalesce(string_agg({item}, ',' ORDER BY start, k) FILTER (WHERE kind IS NOT NULL), '') AS spans
FROM docs LEFT JOIN spans USING (row) GROUP BY row
"""


OP13_SQL = _sql()
