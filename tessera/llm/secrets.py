"""Secret scans with one combined deterministic automaton.

All rules are joined in one automaton, by subset construction and minimisation, kept as a transition array; one pass
over the bytes of a slice finds every place where a match of any rule ends. The same rules, compiled backwards, read
from these ends to every place where the match can start. Of each rule's matches in a text those count that a scan
from left to right meets first, each as long as it can be, without overlap; then matches that are too short drop out.
The byte 0xFF, which no UTF-8 text holds, separates the texts of a slice, so no match crosses two texts.

Rules: ``assign``, ``access`` and ``hex`` (the base), and beside them private keys up to their end mark, or while
lines of base64 follow where that is missing (``pem``), tokens with
the prefixes of common providers (``provider``) and signed web tokens (``jwt``). Spans count code points, end
exclusive. Rules are scanned apart: spans of different rules may overlap, and redaction joins them.

No shuffle; the automata are built once in each worker. Defined cases: null texts count as empty, no spans (redaction
leaves them null); null ids are kept; repeated rows are scanned each; a very long text is scanned whole, a slice of its
own; of two spans with the same start the rule that is listed first comes first; other columns stay, whatever their
names (the one that takes the spans is replaced); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import bounded, text_rows
from tessera.llm.automaton import Automaton, alt, chars, compile_rules, opt, repeat, scan, seq, star, starts, word
from tessera.llm.words import text_slices

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "pem", "provider", "jwt")
#: The least bytes of a match (of the value alone for ``assign``).
LEAST = {"assign": 6, "access": 20, "hex": 24, "provider": 20, "jwt": 30}
APART = 0xFF


def some(part):
    """One or more."""
    return seq(part, star(part))


def rules() -> list:
    """The rules in the order of KINDS; ``hex`` alone has its least length in the automaton, as short runs are everywhere."""
    quote, blank, upper = opt(chars("\"'")), star(chars(" ")), chars("A-Z", "0-9")
    key = alt(*[word(w, fold=True) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")])
    value = chars("A-Z", "a-z", "0-9", "+/_.=-")
    dashed = chars("A-Z", "a-z", "0-9", "_-")
    body, other = chars("A-Z", "a-z", "0-9", "+/=", "\r\n\\"), chars("\x00-,", ".-\xfe")
    mark = lambda w: seq(word(f"-----{w} "), star(seq(some(upper), chars(" "))), word("PRIVATE KEY-----"))
    return [
        seq(key, quote, blank, chars(":="), blank, quote, some(value)),
        seq(word("AKIA"), some(upper)),
        seq(repeat(chars("0-9", "a-f"), LEAST["hex"]), star(chars("0-9", "a-f"))),
        seq(mark("BEGIN"), alt(star(body), seq(star(alt(other, seq(chars("-"), other))), mark("END")))),
        seq(alt(seq(word("gh"), chars("opusr"), word("_")), seq(word("xox"), chars("abeoprs"), word("-")), word("AIza"), seq(chars("rs"), word("k_"), alt(word("live"), word("test")), word("_")), word("glpat-")), some(dashed)),
        seq(word("eyJ"), some(alt(dashed, chars(".")))),
    ]


@lru_cache(maxsize=1)
def automata() -> tuple[Automaton, Automaton]:
    """The automaton of all rules, and the one that reads matches backwards."""
    return compile_rules(rules()), compile_rules(rules(), back=True)


def long_enough(kind: str, match: bytes) -> bool:
    if kind == "assign":  # the value follows the sign, blanks and a quote
        match = match[min(match.find(c) % (len(match) + 1) for c in (b":", b"=")) + 1 :].lstrip(b" ")
        match = match[1:] if match[:1] in (b"'", b'"') else match
    if kind == "jwt" and (match.count(b".") < 2 or b".eyJ" not in match):
        return False
    return len(match) >= LEAST.get(kind, 0)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
_SPANS = pa.list_(_SPAN)
SPANS = "array<struct<kind: string, start: long, stop: long>>"


def found(data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """The spans (start byte in the text, rule, end byte) of the texts of a slice that have any, by row."""
    rows = len(offsets) - 1
    apart = np.full(len(data) + rows, APART, np.uint8)
    apart[np.arange(len(data)) + np.repeat(np.arange(rows), np.diff(offsets))] = data
    forward, backward = automata()
    hits, bits = scan(forward, apart)
    ends, kinds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(len(KINDS)):
        own = hits[bits >> k & 1 > 0]
        own = own[np.append(own[1:] != own[:-1] + 1, True)[: len(own)]]  # the last of consecutive ends: the longest
        ends.append(own + 1)
        kinds.append(np.full(len(own), k))
    end, kind = np.concatenate(ends), np.concatenate(kinds)
    match, start = starts(backward, apart, end, kind)
    end, kind = end[match], kind[match]
    by = np.lexsort((-end, start, kind))
    at, out = offsets + np.arange(rows + 1), {}
    doc = np.searchsorted(at, start, "right") - 1
    done: dict[int, int] = {}
    for a, k, b, d in zip(start[by].tolist(), kind[by].tolist(), end[by].tolist(), doc[by].tolist(), strict=True):
        if a >= done.get(k, 0):
            done[k] = b
            if long_enough(KINDS[k], apart[a:b].tobytes()):
                out.setdefault(d, []).append((a - int(at[d]), k, b - int(at[d])))
    return {d: sorted(spans) for d, spans in out.items()}


def in_characters(text: np.ndarray, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of bytes as spans of code points."""
    first = np.flatnonzero((text & 0xC0) != 0x80)
    count = lambda b: int(np.searchsorted(first, b))
    return [(count(a), k, count(b)) for a, k, b in spans]


def finder():
    """An Arrow UDF: the secret spans of each text, by start, then kind."""

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        out: list[list[dict]] = []
        for rows, data, offsets in text_slices(pa.RecordBatch.from_arrays([texts], ["text"])):
            own = found(data, offsets)
            spans_of = lambda d: in_characters(data[offsets[d] : offsets[d + 1]], own[d]) if d in own else ()  # noqa: B023, E731
            out.extend([{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in spans_of(d)] for d in range(rows.num_rows))
        return pa.array(out, type=_SPANS)

    return spans


def secret_spans(documents: DataFrame, text_column: str = "text", into: str = "secrets") -> DataFrame:
    """The documents with a column of spans (kind, start, stop)."""
    return bounded(documents).withColumn(into, finder()(F.col(f"`{text_column}`").cast("string")))


def digest(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    found_ = secret_spans(text_rows(documents, id_column, text_column), "text").select(F.col("id").alias("doc_id"), "secrets")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    join = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    of = lambda kind: F.filter("secrets", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found_.select("doc_id", *counts, F.sha2(join(base).cast("binary"), 256).alias("base_sha256"), join("secrets").alias("spans"))


def redacted(documents: DataFrame, text_column: str = "text", mark: str = "[secret]") -> DataFrame:
    """The documents, all their columns, with every secret's span replaced by a mark."""

    @F.arrow_udf("string")
    def redact(texts: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for rows, data, offsets in text_slices(pa.RecordBatch.from_arrays([texts], ["text"])):
            own, at = found(data, offsets), len(out)
            out.extend(texts.slice(at, rows.num_rows).to_pylist())
            for d, spans in own.items():
                text, end, kept = data[offsets[d] : offsets[d + 1]].tobytes(), 0, []
                for a, _, b in spans:
                    if a >= end:
                        kept += [text[end:a], mark.encode()]
                    end = max(end, b)
                out[at + d] = b"".join([*kept, text[end:]]).decode()
        return pa.array(out, type=pa.string())

    return bounded(documents).withColumn(text_column, redact(F.col(f"`{text_column}`").cast("string")))
