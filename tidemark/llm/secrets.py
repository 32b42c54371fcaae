"""Secrets in texts, with DataFrame functions only: patterns, and parts of one credential that stand near each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize

#: The base kinds, in the order of spans with one start, and the kinds that linking adds.
BASE = ("assign", "access", "hex")
EXTRA = ("identifier", "weak_secret", "endpoint")
# The patterns of the base kinds. An access key's or a hexadecimal run's least length is in its pattern:
# a run that is too short holds no run that is long enough.
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"AKIA[A-Z0-9]{16,}"
_HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
# Parts of a credential that alone say little.
_IDENTIFIER = r"""(?i:\b(?:user(?:name)?|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,})"""
_WEAK = r"""(?i:\b(?:pwd|pass|key|credential|client_?secret|private_?key)["']?\x20*[:=]\x20*["']?[^\s"',;]{6,})"""
_ENDPOINT = r"""(?i:\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|s3)://[^\s"'<>]{4,})"""
_ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "weak_secret": "secret", "endpoint": "endpoint"}


#: Kind -> its pattern, characters one of which each match holds (a cheap test first), a group and its least length.
_RULES = {
    "assign": (_ASSIGN, ("=", ":"), 1, 6),
    "access": (_ACCESS, ("AKIA",), 0, 0),
    "hex": (_HEX, (), 0, 0),
    "identifier": (_IDENTIFIER, ("=", ":"), 0, 0),
    "weak_secret": (_WEAK, ("=", ":"), 0, 0),
    "endpoint": (_ENDPOINT, ("://",), 0, 0),
}
#: Lengths that are added up together.
_BLOCK = 256
_SPANS = "array<struct<start:int,ord:int,kind:string,end:int>>"


def _matches(text: Column, kind: str) -> list[Column]:
    """All matches of a kind, and the lengths of what lies between them; null if there is none."""
    pattern, signs, _, _ = _RULES[kind]
    hit = F.regexp_like(text, F.lit(pattern))
    for k, sign in enumerate(signs):
        here = F.contains(text, F.lit(sign))
        some = here if not k else some | here
    hit = (some & hit) if signs else hit
    found = F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return [found.alias(f"{kind}_found"), F.when(hit, F.transform(F.split(text, pattern, -1), F.length)).alias(f"{kind}_between")]


def _spans(kind: str) -> Column:
    """Array of (start, ord, kind, end) of all matches of a kind, in code points.

    What the pattern splits off and what it matches alternate, so their lengths add up to the places. The sums are
    taken by blocks, so a text with very many matches takes little more than their number.
    """
    pattern, _, group, least = _RULES[kind]
    found, between, order = F.col(f"{kind}_found"), F.col(f"{kind}_between"), (BASE + EXTRA).index(kind)
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  (computed once)
    steps = F.zip_with(between, F.transform(found, F.length), lambda a, b: a + F.coalesce(b, F.lit(0)))
    blocks = lambda s: F.transform(F.sequence(F.lit(0), F.floor(F.size(s) / _BLOCK).cast("int")), lambda b: total(F.slice(s, b * _BLOCK + 1, _BLOCK)))
    sums = lambda s: let(blocks(s), lambda t: F.transform(t, lambda _, b: total(F.slice(t, 1, b))))
    place = lambda s, t, i: F.get(t, F.floor(i / _BLOCK).cast("int")) + total(F.slice(s, i - i % _BLOCK + 1, i % _BLOCK))
    starts = let(steps, lambda s: let(sums(s), lambda t: F.transform(s, lambda _, i: place(s, t, i))))
    spans = F.zip_with(F.zip_with(starts, between, lambda a, b: a + b), found, lambda a, m: F.struct(a.alias("start"), m.alias("match")))
    spans = F.filter(spans, lambda s: s["match"].isNotNull())  # what follows the last match has none
    if group:
        spans = F.filter(spans, lambda s: F.length(F.regexp_extract(s["match"], pattern, group)) >= least)
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), (s["start"] + F.length(s["match"])).alias("end")))
    return F.coalesce(spans.cast(_SPANS), F.array().cast(_SPANS))


def find_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, scope: int = 240, keep: tuple[str, ...] = ()) -> DataFrame:
    """Secrets in every whole text: id_col, `found` (array of (start, ord, kind, end), by start and kind), `keep` columns.

    Base spans (assignments, access keys, long hexadecimal runs) stand for themselves. Further parts of credentials
    (a user or client name, a weakly named secret, an endpoint's address) are candidates only: an interval join of
    all parts of one text reports those whose window of `scope` code points, before or after, holds a part of
    another role, where one of the two is a secret. Parts are joined by the text's key and cells of `scope` code points:
    one side by the cells that a part covers, the other by those that its window does, so a part of any length meets
    all within its window, and a text with many parts isn't expanded into all pairs, only those with a cell in common.

    Places are in code points, end exclusive. A null text counts as empty and has an empty array. Rows that repeat both
    id and text get the same spans; null ids are rows of their own. Other columns are ignored. Spans of one start are ordered
    by kind. Texts are read whole whatever their length. An empty table gives an empty result.
    """
    docs = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    kept = [F.col(f"keep_{c}") for c in keep]
    text = F.col("text")
    rows = docs.select("id", F.xxhash64("text").alias("h"), *[c for k in BASE + EXTRA for c in _matches(text, k)], *kept)
    rows = rows.select("id", "h", F.concat(*map(_spans, BASE)).alias("base"), F.concat(*map(_spans, EXTRA)).alias("weak"), *kept)
    rows = materialize(rows, "secrets")

    role = F.create_map(*[F.lit(x) for pair in _ROLE.items() for x in pair])
    parts = rows.where(F.size("weak") > 0).select("id", "h", F.explode(F.concat("base", "weak")).alias("s")).distinct()
    parts = parts.select("id", "h", "s", role[F.col("s.kind")].alias("role"))
    cells = lambda reach: F.explode(F.sequence(F.floor((F.col("s.start") - reach) / scope), F.floor((F.col("s.end") + reach) / scope)))
    complement = F.expr("x.id <=> y.id and x.h = y.h and x.cell = y.cell and x.role <> y.role and 'secret' in (x.role, y.role)")
    window = (F.col("y.s.start") - F.col("x.s.end") <= scope) & (F.col("x.s.start") - F.col("y.s.end") <= scope)
    weak = parts.where(F.col("s.kind").isin(*EXTRA)).withColumn("cell", cells(0))
    linked = weak.alias("x").join(parts.withColumn("cell", cells(scope)).alias("y"), complement & window, "left_semi")
    linked = linked.groupBy("id", "h").agg(F.collect_set("s").alias("linked"))  # a part is linked in each of its cells
    out = rows.alias("r").join(linked.alias("l"), F.expr("r.id <=> l.id and r.h = l.h"), "left")
    found = F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(_SPANS))))
    return out.select(F.col("r.id").alias(id_col), found.alias("found"), *[F.col(f"keep_{c}").alias(c) for c in keep])


def span_digest(found: str = "found") -> list[Column]:
    """Columns over an array of spans: a count for each base kind, the base spans' SHA-256, and all spans."""
    of = lambda k: F.filter(found, lambda s: s["kind"] == k)
    line = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter(found, lambda s: s["kind"].isin(*BASE))
    return [*[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col(found)).alias("spans")]


def redact(text: str, found: str = "found", mark: str = "[SECRET]") -> Column:
    """The text with each span replaced by mark; spans that overlap are replaced together. No span: the text as it is."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text)))
    return F.when(F.size(found) > 0, F.aggregate(found, start, step, done)).otherwise(F.col(text))
