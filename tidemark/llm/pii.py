"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust their scores."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The base kinds' patterns; their order is the order among spans with one start.
BASE = ("email", "ip", "card", "phone")
_LOCAL = "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits fails as a whole or not at all, so only its first digit can begin an address: no run is read twice.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Further kinds, and words (whole, of any case) whose presence nearby makes a span of a kind likelier.
EXTRA = ("iban", "ssn")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_CONTEXT = {
    "email": ("mail", "email", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "telephone", "call", "tel", "mobile"),
    "iban": ("iban", "bank", "account", "transfer"),
    "ssn": ("ssn", "social security", "taxpayer"),
}
_NEARBY = {kind: re.compile(rf"(?<![^\W_])(?:{'|'.join(words)})(?![^\W_])", re.I) for kind, words in _CONTEXT.items()}
_PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4}
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+")


def luhn(digits: str) -> bool:
    """The check digit of payment cards."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check digits of international account numbers (ISO 7064)."""
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What one pattern for the whole address would match, found from each @ outwards."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and (text[start - 1] in _LOCAL or (text[start - 1].isascii() and text[start - 1].isalnum())):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers that pass mod-97: what the pattern proposes, or as much of it up to a space, the longest first."""
    at = 0
    while m := _IBAN.search(text, at):
        end = m.end()
        while end > m.start() and not mod97(text[m.start() : end]):
            end = text.rfind(" ", m.start(), end)
        if end > m.start():
            yield m.start(), end
        at = end if end > m.start() else m.start() + 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, order of the kind, end), leftmost without overlap for each kind; matches that fail their check go."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def extra_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of the further kinds that their checks confirm, in the same form."""
    out = [(s, 4, e) for s, e in _accounts(text)]
    out += [(m.start(), 5, m.end()) for m in _SSN.finditer(text)]
    return sorted(out)


def score(text: str, kind: str, start: int, end: int, window: int = 48) -> float:
    """How likely the span is of its kind: the kind's prior, raised towards 1 by the nearest whole context word within `window`
    code points before or after the span: by half of what is missing right beside it, down to a quarter at the window's end."""
    prior, words = _PRIOR[kind], _NEARBY[kind]
    gaps = [start - m.end() for m in words.finditer(text, max(0, start - window), start + 1) if m.end() <= start]
    gaps += [m.start() - end for m in words.finditer(text, end, end + window + 1) if m.end() <= end + window]
    return prior + (1 - prior) / 2 * (1 - min(gaps) / (2 * window)) if gaps else prior


def find_pii(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_score: float = 0.5) -> DataFrame:
    """Personal data in every whole text: id_col and `found`, an array of (kind, start, end, score).

    Spans are in code points, end exclusive, by start and then kind as listed in BASE + EXTRA. Base spans stay
    whatever their score; spans of further kinds (account numbers that pass mod-97, social security numbers)
    are reported from least_score on, so a bare social security number needs a context word. See score() for what words do.

    A null or empty text has an empty array. Null and repeated ids give a row each; other columns are ignored. Spans of one
    start are ordered by kind. Work grows in proportion to a text's length, whatever it holds. An empty table gives an
    empty result.
    """
    kinds = BASE + EXTRA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1):
                text = x.as_py() or ""
                spans = [(kinds[k], s, e, score(text, kinds[k], s, e)) for s, k, e in sorted(base_spans(text) + extra_spans(text))]
                rows.append([{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in spans if k in BASE or p >= least_score])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, found)], ["id", "found"])

    found = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {dict(docs.dtypes)['id']}, found array<struct<kind: string, start: int, end: int, score: double>>"
    return docs.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redact(text: str, least_score: float = 0.5) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first stands for all."""
    kinds, out, at = BASE + EXTRA, [], 0
    for s, k, e in sorted(base_spans(text) + extra_spans(text)):
        if k < len(BASE) or score(text, kinds[k], s, e) >= least_score:
            if s >= at:
                out += [text[at:s], f"[{kinds[k].upper()}]"]
            at = max(at, e)
    return "".join(out) + text[at:]


def span_digest(found: str = "found", kinds: tuple[str, ...] = BASE, counts: tuple[str, ...] = BASE):
    """Columns over an array of spans: a count for each kind in counts, the base kinds' SHA-256, all spans, their scores
    in the same order, how many there are, and the highest score (0 without a span)."""
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter(found, lambda x: x["kind"].isin(*kinds))
    of = lambda k: F.filter(found, lambda x: x["kind"] == k)
    columns = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in counts]
    columns.append(F.sha2(F.concat_ws(",", F.transform(base, line)).cast("binary"), 256).alias("base_sha256"))
    columns.append(F.concat_ws(",", F.transform(F.col(found), line)).alias("spans"))
    scores = F.transform(F.col(found), lambda x: x["score"])
    columns.append(F.concat_ws(",", F.transform(scores, lambda x: F.round(x, 3).cast("string"))).alias("scores"))
    return [*columns, F.size(found).cast("long").alias("n_found"), F.coalesce(F.array_max(scores), F.lit(0.0)).alias("score")]
