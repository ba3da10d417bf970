"""Secret scan with multipart credential linking.

Three strong kinds are always reported. Weak candidates (account names, bare 40-character
keys, endpoints) are everywhere in clean text; they are reported only where the other parts
of a credential stand within the same scope, found by an interval join of the sorted spans
of a text: a name needs a secret, a bare key needs an identifier, an endpoint needs both.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import fresh

#: Code points that may lie between the parts of one credential.
SCOPE = 200
MASK = "[REDACTED]"
SPANS = "array<struct<kind:string,start:int,end:int,weak:boolean>>"

_KEEP = re.IGNORECASE | re.ASCII
# kind: (pattern a text must have, for a fast look; full pattern; group and least length of it)
KINDS = {
    "assign": (
        r"(?i)password|passwd|secret|token|api_?key",
        re.compile(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            _KEEP,
        ),
        (2, 6),
    ),
    "access": ("AKIA", re.compile(r"AKIA[A-Z0-9]+"), (0, 20)),
    "hex": ("[0-9a-f]{24}", re.compile(r"[0-9a-f]{24,}"), (0, 24)),
    "name": (
        r"(?i)user|login|client_?id|account",
        re.compile(
            r"""\b(user(?:_?name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]+)""",
            _KEEP,
        ),
        (2, 3),
    ),
    "key": (
        "[A-Za-z0-9+/]{40}",
        re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])"),
        (0, 40),
    ),
    "endpoint": (
        "://",
        re.compile(r"""(?:https?|ftp|s3|jdbc:[a-z]+)://[A-Za-z0-9.-]+(?::[0-9]+)?""", _KEEP),
        (0, 8),
    ),
}
STRONG = ("assign", "access", "hex")
IDENTIFIERS, SECRETS = ("access", "name"), ("assign", "hex", "key")


def scan(texts: pa.Array, scope: int = SCOPE) -> list[list[tuple[str, int, int, bool]]]:
    """The reported spans of each text by start, then kind as listed; NULL has none."""
    hits = {}
    for kind, (look, _, _) in KINDS.items():
        found = pc.fill_null(pc.match_substring_regex(texts, look), False)
        hits[kind] = found.to_numpy(zero_copy_only=False)
    out: list[list] = [[] for _ in range(len(texts))]
    for at in np.flatnonzero(np.logical_or.reduce(list(hits.values()))):
        out[at] = _linked(texts[at].as_py(), [k for k in KINDS if hits[k][at]], scope)
    return out


def _linked(text: str, kinds: list[str], scope: int) -> list[tuple[str, int, int, bool]]:
    spans = {}
    for kind in kinds:
        _, pattern, (group, least) = KINDS[kind]
        found = [m.span() for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
        if found:
            spans[kind] = np.array(found)
    strong = {k: v for k, v in spans.items() if k in STRONG}
    for kind in [k for k in spans if k not in STRONG]:  # what a strong span covers is reported already
        own = spans[kind]
        for other in strong.values():
            own = own[~_near(own, other, -1)]
        spans[kind] = own
    near = {
        kind: {other: _near(spans[kind], spans[other], scope) for other in spans if other != kind}
        for kind in spans
        if kind not in STRONG
    }
    out = [(k, int(a), int(b), False) for k, v in strong.items() for a, b in v]
    for kind, others in near.items():
        none = np.zeros(len(spans[kind]), bool)
        identifier = np.logical_or.reduce([others.get(o, none) for o in IDENTIFIERS])
        secret = np.logical_or.reduce([others.get(o, none) for o in SECRETS])
        report = {"name": secret, "key": identifier, "endpoint": identifier & secret}[kind]
        out += [(kind, int(a), int(b), True) for a, b in spans[kind][report]]
    order = list(KINDS)
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


def _near(own: np.ndarray, other: np.ndarray, gap: int) -> np.ndarray:
    """Which of `own` have a span of `other` at most `gap` away; -1: overlapping.

    Spans of one kind don't overlap, so that the last one that begins in reach is also the
    one that ends last: one binary search per span, whatever their number.
    """
    if not len(other):
        return np.zeros(len(own), bool)
    last = np.searchsorted(other[:, 0], own[:, 1] + gap, side="right") - 1
    return (last >= 0) & (other[np.maximum(last, 0), 1] >= own[:, 0] - gap)


def find_secrets(
    docs: DataFrame, text_column: str = "text", out_column: str = "secrets", scope: int = SCOPE
) -> DataFrame:
    """`docs` with the array `out_column` of reported spans: kind, start, end, weak.

    Places count code points and the end is exclusive. NULL and empty texts have an empty
    array; every row is kept as it is, repeated ones too. A column of that name is replaced.
    """

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("weak", pa.bool_())])
        found = scan(texts.cast(pa.string()), scope)
        rows = [[dict(zip(("kind", "start", "end", "weak"), s)) for s in one] for one in found]
        return pa.array(rows, type=pa.list_(kind))

    return docs.withColumn(out_column, spans(text_column))


def redact(
    docs: DataFrame, text_column: str = "text", mask: str = MASK, scope: int = SCOPE
) -> DataFrame:
    """`docs` with every reported span of the text replaced by `mask`; overlapping ones by one mask."""

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.string())
        found = scan(texts, scope)
        return pa.array(
            [t.as_py() if not s else _masked(t.as_py(), s, mask) for t, s in zip(texts, found)],
            type=pa.string(),
        )

    return docs.withColumn(text_column, masked(text_column))


def mask_documents(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """`redact` for a documents table: n_chars is counted again where the text changed."""
    old = fresh(docs, "old_text")
    masked = redact(docs.withColumn(old, F.col(text_column)), text_column)
    changed = ~F.col(text_column).eqNullSafe(F.col(old))
    length = F.length(text_column).cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars"))).drop(old)


def _masked(text: str, spans: list, mask: str) -> str:
    parts, done = [], 0
    for _, start, end, _ in spans:
        if start >= done:
            parts += [text[done:start], mask]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256 and spans as kind:start:end lists."""
    name = fresh(docs, "secrets")
    found = find_secrets(docs.select(id_column, text_column), text_column, name)

    def listed(spans: str) -> F.Column:
        return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")

    counts = [
        F.expr(f"cast(size(filter({name}, s -> s.kind = '{k}')) AS long)").alias(f"n_{k}")
        for k in STRONG
    ]
    return found.select(
        F.col(id_column).alias("doc_id"),
        *counts,
        F.sha2(listed(f"filter({name}, s -> NOT s.weak)").cast("binary"), 256).alias("base_sha256"),
        listed(name).alias("spans"),
    )
