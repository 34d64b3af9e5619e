"""Secret scans by a trigram inverted index.

Each rule's regular expression gives a Boolean query of mandatory trigrams. Every Arrow batch is indexed by the
trigrams that some rule names; a rule's query intersects and unites the postings, and only the rows it leaves are
searched with the expression itself. Rules without mandatory trigrams search every row. The index lives and dies with
its batch, so that the corpus is read once and nothing is shuffled.

Cases: null and empty texts have no findings. Texts are searched whole. Repeated rows are reported once each. An empty
table gives an empty result. A null doc_id stays null. Other columns are not read by scan() and pass redact() unchanged, but for n_chars
of the documents that change, if it is of a number or string type. Matches of different rules may overlap; redact() covers their union. A private key is matched
with its body and END line; where that line is missing, to the end of its base64 lines and the word after them. Tokens, values and names have no upper bound on their length; a name's segments joined by "_" and one joined by "-" are part
of the match, and so are all segments after its keyword.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from rankforge.llm.shared import lean, pick
from rankforge.llm.textbytes import each_part
from rankforge.llm.trigrams import Index, candidates, trigram_query, trigrams_of

WS = r"[ \t\r\n]"
LABEL = r"(?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
GAP, BASE64 = r"(?:[ \t\r\n>#*\"',]|\\[nr])", "[0-9A-Za-z+/]"
ARMOUR = rf"(?:{GAP}*(?:Proc-Type|DEK-Info|Version|Comment|Charset|Hash|MessageID):[^\r\n\\]*)*"
# through the END line if no other line of five dashes comes first, else to the end of the base64 lines
KEY_BODY = rf"(?:[^-]*(?:-{{1,4}}[^-]+)*-----END {LABEL}|{ARMOUR}{GAP}*{BASE64}{{16,}}={{0,2}}(?:{GAP}+{BASE64}{{16,}}={{0,2}})*(?:{GAP}+=?{BASE64}+={{0,2}})?)?"
RULES = {
    "aws_access_key": r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA|ANPA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[0-9A-Za-z]{36,}\b",
    "gitlab_token": r"\bglpat-[0-9A-Za-z_-]{20,}",
    "slack_token": r"\bxox[abeprs]-[0-9A-Za-z-]{10,}",
    "google_api_key": r"\bAIza[0-9A-Za-z_-]{35,}",
    "stripe_key": r"\b[rs]k_(?:live|test)_[0-9A-Za-z]{16,}\b",
    "npm_token": r"\bnpm_[0-9A-Za-z]{36}\b",
    "sendgrid_key": r"\bSG\.[0-9A-Za-z_-]{22,}\.[0-9A-Za-z_-]{43,}",
    "twilio_key": r"\bSK[0-9a-f]{32}\b",
    "private_key": rf"-----BEGIN {LABEL}{KEY_BODY}",
    "json_web_token": r"\beyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
    "url_password": r"\b[0-9A-Za-z_]+://[^ \t\r\n/:@]*:[^ \t\r\n/:@]{3,}@",
    "assigned_secret": rf"(?i)\b(?:[0-9a-z]*-)?(?:[0-9a-z]*_)*(?:api[_-]?key|access[_-]?key|auth[_-]?token|token|secret|password|passwd|pwd)(?:[_-][0-9a-z]*)*[\"']?{WS}*(?:=|:|:=|=>){WS}*[\"']?[0-9A-Za-z_+/.=-]{{16,}}[\"']?",
}


class Scanner:
    def __init__(self, rules: dict[str, str]):
        self.patterns = {name: re.compile(pattern, re.ASCII) for name, pattern in rules.items()}
        self.queries = {name: trigram_query(pattern) for name, pattern in rules.items()}
        self.index = Index(set().union(*[trigrams_of(q) for q in self.queries.values()], set()))

    def spans(self, column: pa.Array) -> Iterator[tuple[int, str, str, list[tuple[int, int]]]]:
        """Row, rule, text and character spans, by row of the column and rule."""
        for a, b, data, offsets in each_part(column, 1 << 22):
            postings = self.index.postings(data, offsets)
            texts: dict[int, str] = {}
            for name, pattern in self.patterns.items():
                for i in candidates(self.queries[name], postings, b - a).tolist():
                    if i not in texts:
                        texts[i] = bytes(data[offsets[i] : offsets[i + 1]]).decode()
                    if spans := [m.span() for m in pattern.finditer(texts[i])]:
                        yield a + i, name, texts[i], spans


def _scan(batches: Iterator[pa.RecordBatch], rules: dict[str, str]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(rules)
    for batch in batches:
        at, out = [], []
        for i, name, text, spans in scanner.spans(batch.column("text")):
            for n, (a, b) in enumerate(spans, 1):
                at.append(i)
                out.append((name, n, b - a, hashlib.sha256(text[a:b].encode()).hexdigest()))
        if at:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), *[pa.array(c) for c in zip(*out)]], names=["doc_id", "rule", "occurrence", "secret_chars", "sha256"])


def scan(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """(doc_id, rule, occurrence, secret_chars, sha256): every match, without the secret itself."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return pick(docs, doc_id="doc_id", text="text").mapInArrow(lean(lambda it: _scan(it, rules)), f"doc_id {kind}, rule string, occurrence bigint, secret_chars bigint, sha256 string")


def _redact(batches: Iterator[pa.RecordBatch], rules: dict[str, str], mask: str) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(rules)
    for batch in batches:
        found: dict[int, list] = {}
        for i, _, text, spans in scanner.spans(batch.column("text")):
            found.setdefault(i, [text, []])[1].extend(spans)
        if found:
            new = {}
            for i, (text, spans) in found.items():
                out, end = [], 0
                for a, b in sorted(spans):
                    if a >= end:
                        out += [text[end:a], mask]
                    end = max(end, b)
                new[i] = "".join([*out, text[end:]])
            columns = list(batch.columns)
            for k, name in enumerate(batch.schema.names):
                kind = batch.schema.field(k).type
                if name == "text" or name == "n_chars" and (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_decimal(kind) or pa.types.is_string(kind)):
                    changed = np.zeros(batch.num_rows, dtype=bool)
                    changed[list(new)] = True
                    values = pa.array([new[i] if name == "text" else len(new[i]) for i in sorted(new)])
                    columns[k] = pc.replace_with_mask(columns[k], pa.array(changed), values.cast(kind))
            batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        yield batch


def redact(docs: DataFrame, rules: dict[str, str] = RULES, mask: str = "[secret]") -> DataFrame:
    """docs with every match replaced by `mask`; n_chars follows; documents without a match are untouched."""
    return docs.mapInArrow(lean(lambda it: _redact(it, rules, mask)), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql(name: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"SELECT doc_id, '{name}' AS rule, regexp_extract_all(text, '{quoted}') AS found FROM documents"


ORACLE_SQL = (
    "WITH matches AS (" + " UNION ALL ".join(_sql(*r) for r in RULES.items()) + ") "
    "SELECT doc_id, rule, i AS occurrence, length(found[i]) AS secret_chars, sha256(found[i]) AS sha256 "
    "FROM matches, unnest(range(1, len(found) + 1)) AS t(i)"
)
