"""Personal data: fixed patterns, and bootstrapped contextual extraction of identifiers that they miss.

Base spans are found with fixed patterns (email, ip, card, phone). They are the seeds of a bootstrap: the words around
a seed are lexical patterns ("two words before", "one before and one after"), and other identifier-like strings in
the same surroundings are candidate instances. Spark builds the graph of patterns and instances over all texts and
scores it in rounds: a pattern by the mean score of the distinct instances it extracts, an instance by its patterns'
noisy-or, seeds keeping the score 1 for their own kind. Strings that look like an identifier of another kind, or plain
numbers, count against a pattern. An instance that reaches the confidence is a seed of the next round, so patterns that
only found instances share are induced too. All patterns that enough distinct seeds support are promoted. The last pass
adds the candidates that a promoted pattern extracts: by a set on the executors while patterns are few, by a join with the
candidates' surroundings beyond.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import add_columns, bound_batches, cut, texts

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: Promoted patterns that are sent to the executors; more are joined.
SENT = 50_000
#: Distinct seeds that a pattern must extract, and the score that it, or an instance, needs.
SUPPORT = 5
CONFIDENCE = 0.7

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Identifier-like strings that may be personal data in the right surroundings.
_CANDIDATES = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[({] ?at ?[\])}] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[A-Za-z0-9-]{1,63}){1,8}")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![\w.-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.+-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){5,13}(?![\w-])")),
)
_BEFORE = 80  # characters around a string that its context words are taken from
_WORDS = re.compile(r"\S+")

Span = tuple[int, int, int]  # start, number of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Found from each @ outwards, so that a long run without one costs no more than its length."""
    free, at = 0, text.find("@")
    while at >= 0:
        if at > free and (domain := _DOMAIN.match(text, at + 1)):
            start = at
            while start > free and not _NOT_LOCAL.match(text, start - 1):
                start -= 1
            if start < at:
                yield start, 0, domain.end()
                free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and non-overlapping within a kind, by start and kind."""
    spans = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
                spans.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def _disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of (start, end) as intervals that don't meet, by start."""
    found: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if found and start < found[-1][1]:
            found[-1] = found[-1][0], max(end, found[-1][1])
        else:
            found.append((start, end))
    return found


def candidate_spans(text: str, base: list[Span]) -> list[Span]:
    """Identifier-like strings clear of base spans and of each other, the earlier kind first; one sweep for each kind."""
    found: list[Span] = []
    if not ("at" in text and ("[" in text or "(" in text or "{" in text)) and not _DIGIT.search(text):
        return found
    taken = _disjoint([(s, e) for s, _, e in base])
    for kind, (_, pattern) in enumerate(_CANDIDATES):
        place, fresh = 0, []
        for m in pattern.finditer(text):  # by start, and never overlapping
            while place < len(taken) and taken[place][1] <= m.start():
                place += 1
            if place == len(taken) or m.end() <= taken[place][0]:
                fresh.append((m.start(), m.end()))
        found += [(start, kind, end) for start, end in fresh]
        taken = _disjoint(taken + fresh)
    return sorted(found)


def _shape(word: str) -> str:
    return re.sub(r"[0-9]", "0", word.lower())[:40]


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span; none at an edge of the text that lacks the words."""
    before = [_shape(w) for w in text[max(0, start - _BEFORE) : start].split()[-2:]]
    after = [_shape(w) for w in text[end : end + _BEFORE].split()[:1]]
    found = []
    if len(before) == 2:
        found.append(f"{before[0]} {before[1]} _")
    if before and re.search(r"[:=#]$", before[-1]):
        found.append(f"{before[-1]} _")  # a label before the string is a pattern of its own
    if before and after:
        found.append(f"{before[-1]} _ {after[0]}")
    return found


def _occurrences(docs: DataFrame) -> DataFrame:
    """(pattern, kind, value, seed): what each pattern extracts, over all texts."""

    def run(batches):
        for batch in batches:
            patterns, kinds, values, seeds = [], [], [], []
            for text in texts(batch.column(0)):
                base = base_spans(text)
                for spans, seed in ((base, True), (candidate_spans(text, base), False)):
                    for start, kind, end in spans:
                        for pattern in contexts(text, start, end):
                            patterns.append(pattern)
                            kinds.append(KINDS[kind])
                            values.append(text[start:end])
                            seeds.append(seed)
            yield pa.RecordBatch.from_arrays(
                [pa.array(patterns, pa.string()), pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(seeds, pa.bool_())],
                names=["pattern", "kind", "value", "seed"],
            )

    return docs.mapInArrow(run, "pattern string, kind string, value string, seed boolean")


def _on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join exchanged on a hash besides the keys, so that a hot key's rows can be split over tasks."""
    k = F.xxhash64(*keys)
    return left.withColumn("k_", k).join(right.withColumn("k_", k), ["k_", *keys], how).drop("k_")


def learn_patterns(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(kind, pattern): all promoted patterns.

    The graph holds a row for each distinct (pattern, instance). A pattern is scored for each kind of seed it extracts:
    the sum of its instances' scores for that kind over the number of instances it extracts of any kind.
    """
    bound_batches(docs.sparkSession)
    graph = cut(_occurrences(docs.select(F.col(text).alias("text"))).distinct())
    per = graph.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = graph.where("seed").select("kind", "value", F.lit(1.0).alias("worth")).distinct()
    promoted = graph.select("kind", "pattern").limit(0)
    worth = seeds
    for _ in range(rounds):
        drawn = _on(graph.select("pattern", "kind", "value"), worth, ["kind", "value"])
        scored = drawn.groupBy("pattern", "kind").agg(F.count_if(F.col("worth") >= confidence).alias("seeds"), F.sum("worth").alias("gain"))
        scored = scored.where(F.col("seeds") >= support).join(per, "pattern")
        scored = cut(scored.select("pattern", "kind", (F.col("gain") / F.col("n")).alias("score")))
        if scored.isEmpty():
            break
        promoted = promoted.unionByName(scored.where(F.col("score") >= confidence).select("kind", "pattern"))
        # an instance is worth its patterns' noisy-or
        found = _on(graph.where("not seed"), scored.withColumn("score", F.least("score", F.lit(0.99))), ["pattern", "kind"])
        found = found.groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log1p(-F.col("score"))))).alias("worth"))
        worth = cut(seeds.unionByName(found.join(seeds, ["kind", "value"], "left_anti")))
    return cut(promoted.distinct())


def _prepared(df: DataFrame, text: str, patterns: DataFrame) -> tuple[DataFrame, dict[str, frozenset[str]], str | None]:
    """(rows, patterns to send, column of spans that the others add): the last only where patterns are too many to send."""
    bound_batches(df.sparkSession)
    if patterns.limit(SENT + 1).count() <= SENT:
        known = patterns.collect()
        return df, {k: frozenset(r.pattern for r in known if r.kind == k) for k in KINDS}, None
    # the candidates' surroundings meet the patterns in a join, and a text gets its spans back by two hashes of it
    key = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), F.col(text)).alias("h2")]
    placed = df.select(*key, F.col(text).alias("text")).mapInArrow(_placed, "h1 long, h2 long, kind string, pattern string, start int, end int")
    hits = _on(placed, patterns, ["kind", "pattern"]).select("h1", "h2", "kind", "start", "end").distinct()
    hits = hits.groupBy("h1", "h2").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))  # a text's own
    extra = _unused(df, "more")
    hits = hits.select(F.col("h1").alias("h1_"), F.col("h2").alias("h2_"), F.col("more").alias(extra))
    joined = df.join(hits, (key[0] == F.col("h1_")) & (key[1] == F.col("h2_")), "left")
    return joined.select(*(joined[c] for c in df.columns), extra), {k: frozenset() for k in KINDS}, extra


def _unused(df: DataFrame, name: str) -> str:
    while name in {c.lower() for c in df.columns}:
        name += "_"
    return name


def _placed(batches):
    """(h1, h2, kind, pattern, start, end) of the candidates of texts(h1, h2, text)."""
    for batch in batches:
        rows = []
        for h1, h2, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            text = text or ""
            for start, kind, end in candidate_spans(text, base_spans(text)):
                rows += [(h1, h2, KINDS[kind], pattern, start, end) for pattern in contexts(text, start, end)]
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["h1", "h2", "kind", "pattern", "start", "end"])


def find_all(text: str, patterns: dict[str, frozenset[str]]) -> tuple[list[Span], list[Span]]:
    """Base spans, and base spans with those that the promoted patterns add."""
    base = base_spans(text)
    if not any(patterns.values()):
        return base, base
    more = [
        span for span in candidate_spans(text, base) if not patterns[KINDS[span[1]]].isdisjoint(contexts(text, span[0], span[2]))
    ]
    return base, sorted(base + more)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _mapped(df: DataFrame, text: str, patterns: DataFrame, outputs: list[T.StructField], make) -> DataFrame:
    """df with outputs computed by make(text, base spans, all spans) -> a value per output."""
    rows, sent, extra = _prepared(df, text, patterns)
    types = [_ARROW if f.dataType == SPANS else pa.string() for f in outputs]

    def both(x: str, more: list | None) -> tuple[list[Span], list[Span]]:
        base, spans = find_all(x, sent)
        return base, sorted({*spans, *((m["start"], KINDS.index(m["kind"]), m["end"]) for m in more)}) if more else spans

    def run_all():
        def run(column: pa.Array, more: pa.Array | None = None) -> list[pa.Array]:
            joined = more.to_pylist() if more is not None else [None] * len(column)
            made = [make(x, *both(x or "", m)) for x, m in zip(column.to_pylist(), joined, strict=True)]
            return [pa.array([r[i] for r in made], type=t) for i, t in enumerate(types)]

        return run

    if extra is None:
        return add_columns(rows, [text], outputs, run_all)
    return add_columns(rows, [text, extra], outputs, run_all).drop(extra)


def find(df: DataFrame, patterns: DataFrame, text: str = "text", base: str = "base_spans", spans: str = "spans") -> DataFrame:
    """df with the base spans and all spans of each whole text: arrays of (kind, start, end) in code points, end exclusive.

    patterns are those of learn_patterns. Ordered by start, then kind as in `KINDS`. A null or empty text has none. Other
    columns pass through; columns named as the outputs are replaced.
    """

    def make(_, *both):
        return [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in part] for part in both]

    return _mapped(df, text, patterns, [T.StructField(base, SPANS), T.StructField(spans, SPANS)], make)


def redact(df: DataFrame, patterns: DataFrame, text: str = "text") -> DataFrame:
    """df with each span of its texts replaced by its kind in angle brackets; overlapping spans become one, the first's.

    A null text stays null; repeated rows are redacted alike, and texts of any length whole, in time that grows with their
    length. Other columns pass through; the text column moves to the end of the schema.
    """

    def make(x: str | None, _, spans: list[Span]):
        if x is None:
            return [None]
        out, at = [], 0
        for start, kind, end in spans:
            if start >= at:
                out += [x[at:start], f"<{KINDS[kind].upper()}>"]
            at = max(at, end)
        return ["".join([*out, x[at:]])]

    return _mapped(df, text, patterns, [T.StructField(text, T.StringType())], make)
