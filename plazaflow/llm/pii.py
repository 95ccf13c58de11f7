"""Personal data by fixed patterns and bootstrapped contextual extraction.

Fixed patterns find e-mail and IP addresses, card and phone numbers. These are the seeds. Every mention of a seed, and of
any other token or run of digit groups that looks like an identifier, stands in lexical patterns of several grains: the two
words before it, the word before it, the word after it, and its own shape (digits and letters told apart, marks kept).
Patterns and values form a bipartite graph with counts. Spark scores it in turns: a pattern's confidence for a kind is the share of its
mentions that are, as far as known, of that kind; a value's is what its patterns leave certain, of those that are right more often than wrong.
Patterns of high confidence and enough distinct values that are seeds or found with confidence then mark the identifiers that stand in them,
if their characters suit the kind. A shape is judged by seeds alone: values found by one shape would vouch for the next. Seeds stay.

A number that a fixed pattern's own rule refuses (16 to 19 digits that fail Luhn, address parts over 255) suits that kind in no pattern.

Runs join digit groups by up to three spaces, brackets, dots and hyphens, and end at fixed matches. A run with too many
digits for any kind is cut around the card numbers in it. Tokens inside a run are marked only where the run is not.

The graph is aggregated by (pattern, value) before it is shuffled, so a frequent context costs little. Only mentions
travel, no texts. Matching is linear in a text's length.

Null and empty texts have no spans. Every row gives one row, repeated ids included. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, in_batches

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a run of digits is entered at its start only: where that fails, so would each later start in the run
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
# a token is entered at its start only, and read once
_APART = r"\s,;:!?\"'()\[\]{}<>|"
TOKEN = re.compile(rf"(?<![^{_APART}])[^{_APART}0-9@]*+[0-9@][^{_APART}]*+")
# groups are given back whole at a run's end only, so a run is read once
GROUPS = re.compile(r"(?<![\w@.])\+?\(?[0-9]++(?:[\x20().-]{1,3}+[0-9]++)+(?![\w@])")
GROUP = re.compile(r"[0-9]+")
WORDS = re.compile(r"[^\W\d_]+")
#: Stands for the kind of a token that a run of digit groups covers: it is not learnt from.
INSIDE = -1

SCAN = "part int, ordinal long, doc_id long, h1 long, h2 long, base array<struct<kind:int,start:long,end:long>>, mentions array<struct<kind:int,value:string,fits:int,patterns:array<string>,start:long,end:long,run:long>>"
SPAN_T = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
MENTION_T = pa.list_(
    pa.struct([("kind", pa.int32()), ("value", pa.string()), ("fits", pa.int32()), ("patterns", pa.list_(pa.string())), ("start", pa.int64()), ("end", pa.int64()), ("run", pa.int64())])
)
#: What a pattern's text begins with, by grain.
BEFORE_TWO, BEFORE_ONE, AFTER, SHAPE = "2 ", "1 ", "+ ", "= "


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of all fixed matches, by kind and start."""
    out = [(0, s, e) for s, e in emails(text)]
    if not DIGITS.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if len(m[0]) < 64 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(DIGITS.findall(m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def suits(kind: int, value: str) -> bool:
    """Whether a value's characters can be an identifier of the kind, beyond the fixed patterns."""
    if kind == 0:
        return "@" in value and 0 < value.index("@") < len(value) - 1
    if any(c.isalpha() for c in value):
        return False
    digits = "".join(c for c in value if c.isdigit())
    if kind == 1:
        parts = value.split(".")
        return len(parts) == 4 and not any(p.isdigit() and int(p[-19:]) > 255 for p in parts)
    if kind == 2:
        return 12 <= len(digits) <= 19 and (len(digits) < 16 or luhn(digits))
    return 7 <= len(digits) <= 15


def fitting(value: str) -> int:
    """The kinds that a value's characters suit, a bit each."""
    return sum(1 << kind for kind in range(4) if suits(kind, value))


def shape(value: str) -> str:
    """A value with 9 for each digit and one a for each run of letters."""
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"\d", "9", value))


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A span of digit groups without a bracket that has no other."""
    return (start + 1 if text[start] == "(" and ")" not in text[start:end] else start), end


def _pieces(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The spans in a run of digit groups that suit a kind: the run, or the card numbers in it and what is between."""
    if any(suits(k, text[start:end]) for k in range(4)):
        yield _trimmed(text, start, end)
        return
    groups = [(m.start(), m.end()) for m in GROUP.finditer(text, start, end)]
    cards, k = [], 0
    while k < len(groups):
        digits, last = "", k
        while last < len(groups) and len(digits) + groups[last][1] - groups[last][0] <= 19:
            digits += text[slice(*groups[last])]
            last += 1
            if len(digits) >= 16 and luhn(digits):
                cards.append((k, last))
                break
        k = cards[-1][1] if cards and cards[-1][0] == k else k + 1
    if not cards:
        return
    at = 0
    for first, last in [*cards, (len(groups), len(groups))]:
        if at < first:
            a, b = _trimmed(text, start if at == 0 else groups[at][0], groups[first - 1][1])
            if any(suits(k, text[a:b]) for k in range(4)):
                yield a, b
        if first < last:
            yield groups[first][0], groups[last - 1][1]
        at = last


def runs(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Spans of digit groups outside the taken spans (sorted) that suit a kind, in order."""
    at = 0
    for start, end in [*taken, (len(text), len(text))]:
        for m in GROUPS.finditer(text, at, start) if at < start else ():
            yield from _pieces(text, m.start(), m.end())
        at = max(at, end)


class Context:
    """The words around a place in a text, lower-cased and whole, however far; the text is read once."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.words: list[tuple[int, int]] | None = None

    def _place(self, at: int) -> int:
        if self.words is None:
            self.words = [m.span() for m in WORDS.finditer(self.text)]
        return bisect_left(self.words, (at, 0))

    def before(self, start: int) -> str:
        """The two words before."""
        k = self._place(start)
        return " ".join(self.text[a : min(b, start)] for a, b in self.words[max(0, k - 2) : k]).lower()

    def after(self, end: int) -> str:
        k = self._place(end)
        return self.text[slice(*self.words[k])].lower() if k < len(self.words) else ""

    def patterns(self, start: int, end: int) -> list[str]:
        """The patterns that a mention stands in, those without a word left out."""
        two, after = self.before(start), self.after(end)
        grains = [(BEFORE_TWO, two), (BEFORE_ONE, two.split(" ")[-1]), (AFTER, after), (SHAPE, shape(self.text[start:end]))]
        return [grain + text for grain, text in grains if text]


def mention(context: Context, kind: int | None, start: int, end: int, run: int) -> dict:
    value = context.text[start:end]
    return {"kind": kind, "value": value, "fits": fitting(value), "patterns": context.patterns(start, end), "start": start, "end": end, "run": run}


def scan(docs: DataFrame) -> DataFrame:
    """Each row's fixed spans and identifier-like mentions with their contexts; ``docs`` has doc_id, text, h1 and h2."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ordinal = TaskContext.get().partitionId(), 0
        for batch in batches:
            bases, mentions = [], []
            for text in batch.column(1).to_pylist():
                found, context = base_spans(text) if text else [], Context(text or "")
                bases.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
                rows = [mention(context, k, s, e, s) for k, s, e in found]
                taken = sorted((s, e) for _, s, e in found)
                next_taken = next_run = 0
                joined = list(runs(text, taken)) if text and DIGITS.search(text) else []
                rows += [mention(context, None, s, e, s) for s, e in joined]
                for m in TOKEN.finditer(text) if text and (found or DIGITS.search(text) or "@" in text) else ():
                    value = m[0].strip(".-_/\\=+*#$%&")
                    start = m.start() + m[0].find(value) if value else m.start()
                    end = start + len(value)
                    while next_taken < len(taken) and taken[next_taken][1] <= start:
                        next_taken += 1
                    while next_run < len(joined) and joined[next_run][1] <= start:
                        next_run += 1
                    over = joined[next_run] if next_run < len(joined) and joined[next_run][0] < end else None
                    if value and over != (start, end) and not (next_taken < len(taken) and taken[next_taken][0] < end) and fitting(value):
                        rows.append(mention(context, INSIDE if over else None, start, end, over[0] if over else start))
                mentions.append(rows)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array(range(ordinal, ordinal + n), pa.int64()), *(batch.column(i) for i in (0, 2, 3)), pa.array(bases, SPAN_T), pa.array(mentions, MENTION_T)],
                ["part", "ordinal", "doc_id", "h1", "h2", "base", "mentions"],
            )
            ordinal += n

    return in_batches(docs, work, SCAN)


def _fits(kind: str) -> Column:
    """:func:`suits` by the column ``fits``."""
    return F.col("fits").bitwiseAND(F.expr(f"shiftleft(1, {kind})")) != 0


def learn_patterns(mentions: DataFrame, *, rounds: int, min_seeds: int, min_confidence: float) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that the graph of mentions (kind, value, fits, patterns) supports.

    Mentions without a kind begin unknown; after each round a value belongs to a kind to 1 - Π(1 - confidence) over its patterns
    of more than half confidence. In every round all patterns are admitted anew: seeds count, and, but for shapes, values that fit
    and are believed to ``min_confidence``.
    """
    spread = mentions.select("kind", "value", "fits", F.explode("patterns").alias("pattern"))
    edges = durable(spread.groupBy("pattern", "value").agg(F.count("*").alias("n"), F.max("kind").alias("seed"), F.max("fits").alias("fits")))
    sizes = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    seeds = edges.where("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(F.sum("n").cast("double").alias("mass"), F.count("*").alias("seeds"))
    belief = None
    scored = None
    for step in range(rounds):
        mass = seeds
        if belief is not None:
            believed = edges.where(F.col("seed").isNull() & ~F.col("pattern").startswith(SHAPE)).join(belief, "value")
            sure = (F.col("p") >= min_confidence) & _fits("kind")
            more = believed.groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("p")).alias("more"), F.sum(sure.cast("long")).alias("found"))
            zero = lambda c: F.coalesce(c, F.lit(0))
            mass = mass.join(more, ["pattern", "kind"], "full").select("pattern", "kind", (zero("seeds") + zero("found")).alias("seeds"), (zero("mass") + zero("more")).alias("mass"))
        mass = mass.where(F.col("seeds") >= min_seeds)
        scored = durable(mass.join(sizes, "pattern").select("pattern", "kind", "seeds", F.least(F.lit(1.0), F.col("mass") / F.col("total")).alias("confidence")))
        if step < rounds - 1:
            doubt = F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))))
            belief = edges.where("seed is null").join(scored.where("confidence > 0.5"), "pattern").groupBy("value", "kind").agg((1 - doubt).alias("p"))
    return scored.where(F.col("confidence") >= min_confidence)


def discovered(rows: DataFrame, *, rounds: int = 3, min_seeds: int = 5, min_confidence: float = 0.8) -> DataFrame:
    """(part, ordinal, found): the spans of :func:`scan`'s rows that learnt patterns add.

    A pattern is used if at least ``min_seeds`` different values of one kind, seeds or found with confidence, stand in it and its confidence reaches
    ``min_confidence`` after ``rounds`` rounds of scoring.
    """
    mentions = rows.select("part", "ordinal", F.explode("mentions").alias("m")).select("part", "ordinal", "m.*")
    patterns = learn_patterns(mentions.where(f"kind is null or kind <> {INSIDE}"), rounds=rounds, min_seeds=min_seeds, min_confidence=min_confidence)
    fresh = mentions.where(f"kind is null or kind = {INSIDE}").withColumn("inside", F.col("kind").isNotNull()).drop("kind")
    in_patterns = fresh.withColumn("pattern", F.explode("patterns")).drop("patterns")
    new = in_patterns.join(patterns.select("pattern", F.col("kind").alias("k"), "confidence"), "pattern").where(_fits("k"))
    one = new.groupBy("part", "ordinal", "run", "inside", "start", "end").agg(F.max_by("k", F.struct("confidence", -F.col("k"))).alias("kind"))
    span = F.struct("kind", "start", "end")
    whole = F.collect_list(F.when(~F.col("inside"), span))
    of_run = one.groupBy("part", "ordinal", "run").agg(F.when(F.size(whole) > 0, whole).otherwise(F.collect_list(span)).alias("f"))
    return of_run.groupBy("part", "ordinal").agg(F.flatten(F.collect_list("f")).alias("found"))


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **learning: float) -> DataFrame:
    """doc_id, base (fixed spans) and spans (those and discovered ones) per document, sorted by kind number and start."""
    none = F.lit(None).cast("long")
    rows = durable(scan(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), none.alias("h1"), none.alias("h2"))))
    joined = rows.select("part", "ordinal", "doc_id", "base").join(discovered(rows, **learning), ["part", "ordinal"], "left")
    return joined.select("doc_id", "base", F.array_sort(F.when(F.col("found").isNull(), F.col("base")).otherwise(F.concat("base", "found"))).alias("spans"))


def joined_spans(column: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, a count of fixed spans of each kind, base_sha256 and spans from :func:`personal_data`'s rows."""
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined_spans("base").cast("binary"), 256).alias("base_sha256"), joined_spans("spans").alias("spans"))


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each (kind number, start, end) replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, *, broadcast_bytes: int = 8 << 20, **learning: float) -> DataFrame:
    """``docs`` with personal data in ``text`` masked and ``n_chars``, where there is one, counted anew.

    Fixed spans are found where the text is. Discovered ones come by the text itself, known by two 64-bit hashes, as equal
    texts have equal spans: so rows without an id get theirs, and rows that share one only their own. They are broadcast
    if they take ``broadcast_bytes`` at most, else joined by a shuffle; both ways give the same rows. A column may have any name.
    """
    hashes = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    rows = durable(scan(docs.select(F.lit(None).cast("long").alias("doc_id"), "text", hashes[0].alias("h1"), hashes[1].alias("h2"))))
    spans = rows.select("part", "ordinal", "h1", "h2").join(discovered(rows, **learning), ["part", "ordinal"])
    found = durable(spans.groupBy("h1", "h2").agg(F.array_sort(F.max("found")).alias("found")))
    size = found.agg(F.sum(F.lit(32) + 24 * F.size("found"))).first()[0] or 0
    carried = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), hashes[0].alias("h1"), hashes[1].alias("h2"))
    both = carried.join(F.broadcast(found) if size <= broadcast_bytes else found, ["h1", "h2"], "left").select("row", "found")
    names = docs.columns
    column = names.index("text")
    counted = names.index("n_chars") if "n_chars" in names else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            texts, changed = columns[column].to_pylist(), False
            for k, (text, more) in enumerate(zip(texts, batch.column(1).to_pylist(), strict=True)):
                spans = base_spans(text) if text else []
                spans += [(s["kind"], s["start"], s["end"]) for s in more or []]
                if spans:
                    texts[k], changed = mask(text, spans), True
            if changed:
                columns[column] = pa.array(texts, pa.string())
                if counted is not None:
                    columns[counted] = pa.array([None if t is None else len(t) for t in texts], columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return in_batches(both, work, docs.schema)
