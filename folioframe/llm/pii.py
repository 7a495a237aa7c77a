"""Personal data: fixed rules, and contextual patterns bootstrapped from what the rules find.

Matches of the rules are the seeds. The words around seeds, and around further tokens that look like identifiers, are
lexical patterns. Patterns and instances form a bipartite graph that Spark scores in rounds: a pattern is trusted for
a kind by the share of its instances trusted for it, an instance by the patterns it occurs in. Tokens that confident
patterns point to, of a shape that suits the kind, are added to the base spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm import spans as rules
from folioframe.llm.common import count_kind, join_spans, map_texts, stored

# The kinds, in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
SPAN = T.StructType([
    T.StructField("order", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("kind", T.StringType()), T.StructField("end", T.LongType()),
])
OCCURRENCE = T.StructType([
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("run", T.LongType()),
    T.StructField("kind", T.StringType()), T.StructField("instance", T.StringType()), T.StructField("suits", T.ArrayType(T.StringType())),
    T.StructField("patterns", T.ArrayType(T.StringType())),
])
FIELDS = [T.StructField("base", T.ArrayType(SPAN)), T.StructField("occurrences", T.ArrayType(OCCURRENCE))]
# Tokens with an at sign or a digit are looked at, of any length, and `suitable` alone judges their shape.
_MARK = re.compile(r"[\d@]")
_BLANK = re.compile(r"\s")
_JOINED = re.compile(r"[()]?\s[()]?")
_EDGES = ".,;:!?\"'()[]{}<>"
# Longer words and instances are told by a hash.
_SPELLED = 64


def base_spans(text: str) -> list[tuple[str, int, int]]:
    finders = (rules.emails, rules.addresses, rules.cards, rules.phones)
    return [(kind, a, b) for kind, find in zip(KINDS, finders, strict=True) for a, b in find(text)]


def suitable(token: str) -> list[str]:
    """Kinds whose identifiers may look like the token."""
    digits = sum(c.isdigit() for c in token)
    kinds = []
    if "@" in token:
        kinds.append("email")
    if token.count(".") + token.count(":") >= 3 and digits >= 4:
        kinds.append("ip")
    if 12 <= digits <= 19 and not any(map(str.isalpha, token)):
        kinds.append("card")
    if 7 <= digits <= 15 and not any(map(str.isalpha, token)):
        kinds.append("phone")
    return kinds


def key(word: str) -> str:
    """The word, lower-cased, or a hash of it if it is long."""
    lowered = word.lower()
    return lowered if len(word) <= _SPELLED else f"#{xxhash.xxh128_hexdigest(lowered.encode('utf-8', 'surrogatepass'))}"


def patterns(text: str, start: int, end: int, low: int = 0, high: int | None = None) -> list[str]:
    """The word before, the two words before, the word after, and both neighbours, lower-cased; words end at blanks,
    however far those are, and at `low` and `high`."""
    left: list[str] = []
    at = start
    while len(left) < 2 and at > low:
        stop = at
        while stop > low and text[stop - 1].isspace():
            stop -= 1
        at = stop
        while at > low and not text[at - 1].isspace():
            at -= 1
        if at < stop:
            left.insert(0, key(text[at:stop].strip(_EDGES)))
    high, at = len(text) if high is None else high, end
    while at < high and text[at].isspace():
        at += 1
    blank = _BLANK.search(text, at, high)
    right = [key(text[at:blank.start() if blank else high].strip(_EDGES))] if at < high else []
    found = []
    if left:
        found.append(f"L {left[-1]}")
    if len(left) == 2:
        found.append(f"LL {left[0]} {left[1]}")
    if right:
        found.append(f"R {right[0]}")
    if left and right:
        found.append(f"LR {left[-1]} {right[0]}")
    return found


def tokens(text: str) -> list[tuple[int, int]]:
    """Tokens with a digit or an at sign, stripped of marks around them."""
    found, place = [], 0
    while mark := _MARK.search(text, place):
        start = mark.start()
        while start > place and not text[start - 1].isspace():
            start -= 1
        blank = _BLANK.search(text, mark.end())
        place = end = blank.start() if blank else len(text)
        token = text[start:end]
        start += len(token) - len(token.lstrip(_EDGES))
        end -= len(token) - len(token.rstrip(_EDGES))
        if start < end:
            found.append((start, end))
    return found


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
    """Start, end and run of what may be an identifier and touches no base span: tokens, and whole runs of neighbouring
    digit groups with one blank and marks between them. `run` is the start of the run a token stands in."""
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    runs: list[list[tuple[int, int]]] = []
    for start, end in tokens(text):
        before = bisect_left(starts, end)
        if before and reach[before - 1] > start:
            continue
        last = runs[-1][-1] if runs else None
        if last and _JOINED.fullmatch(text, last[1], start) and not any(
                c.isalpha() or c == "@" for a, b in (last, (start, end)) for c in text[a:b]):
            runs[-1].append((start, end))
        else:
            runs.append([(start, end)])
    found = []
    for run in runs:
        first = run[0][0]
        if len(run) > 1 and text[first - 1:first] == "(" and ")" in text[first:run[-1][1]]:
            first -= 1
        found += [(a, b, first) for a, b in run]
        if len(run) > 1:
            found.append((first, run[-1][1], first))
    return found


def scan(texts: list[str]) -> dict[str, list]:
    base, occurrences = [], []
    for text in texts:
        spans = base_spans(text)
        base.append([{"order": KINDS.index(k), "start": a, "kind": k, "end": b} for k, a, b in spans])
        rows = [(a, b, a, k, [k]) for k, a, b in spans]
        rows += [(a, b, r, None, s) for a, b, r in candidates(text, spans) if (s := suitable(text[a:b]))]
        # A context ends where another base span does, so that words in a text without blanks are read once, too.
        begins, ends = sorted(a for _, a, _ in spans), sorted(b for *_, b in spans)
        occurrences.append([{
            "start": a, "end": b, "run": r, "kind": k, "instance": key(text[a:b]), "suits": s,
            "patterns": patterns(text, a, b, ends[i - 1] if (i := bisect_right(ends, a)) else 0,
                                 begins[j] if (j := bisect_left(begins, b)) < len(begins) else len(text)),
        } for a, b, r, k, s in rows])
    return {"base": base, "occurrences": occurrences}


def score_patterns(edges: DataFrame, rounds: int, smoothing: float) -> DataFrame:
    """pattern, kind, confidence, support from the distinct edges (pattern, instance, kind, suits).

    A pattern's confidence for a kind is the sum of its instances' scores for it over their number plus `smoothing`,
    an instance's score 1 for a seed and else 1 - prod(1 - confidence) over its patterns. `support` counts seeds.
    Sums are combined within tasks first; each round is stored.
    """
    sizes = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("instances"))
    seeds = edges.filter(F.col("kind").isNotNull()).select("pattern", "instance", "kind").distinct()
    unknown = edges.filter(F.col("kind").isNull()).select(
        "pattern", "instance", F.explode("suits").alias("kind")).distinct()
    seen = seeds.groupBy("pattern", "kind").agg(F.count(F.lit(1)).cast("double").alias("mass"))
    frame = stored(seen.join(sizes, "pattern").select("pattern", "kind", "mass", "instances"), "pii-patterns")
    scored = frame.select(
        "pattern", "kind", (F.col("mass") / (F.col("instances") + smoothing)).alias("confidence"),
        F.col("mass").alias("support"))
    for _ in range(rounds):
        instances = unknown.join(scored, ["pattern", "kind"]).groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("score"))
        learned = unknown.join(instances, ["instance", "kind"]).groupBy("pattern", "kind").agg(
            F.sum("score").alias("learned"))
        scored = stored(frame.join(learned, ["pattern", "kind"], "left").select(
            "pattern", "kind",
            ((F.col("mass") + F.coalesce("learned", F.lit(0.0))) / (F.col("instances") + smoothing)).alias("confidence"),
            F.col("mass").alias("support")), "pii-patterns")
    return scored


def find(documents: DataFrame, rounds: int = 3, smoothing: float = 3.0, confident: float = 0.6,
         support: int = 4) -> DataFrame:
    """doc_id, base and spans (arrays of structs order, start, kind, end, sorted) and `row`, for every row.

    Whole texts are scanned once, map-side; what later steps need is stored (spans and identifier-shaped tokens with
    their patterns). A pattern adds spans of a kind if its confidence reaches `confident` and at least `support`
    distinct seeds stand behind it. NULL and empty texts have no spans. Rows are told apart by a number given at the
    scan, so NULL ids and repeated rows each give a row. Neighbouring digit groups claimed as one identifier count once,
    as a whole. If patterns claim one token for several kinds, the most
    confident wins, then the first kind listed.
    """
    scanned = map_texts(documents, ["doc_id"], scan, FIELDS)
    table = stored(scanned.withColumn("row", F.monotonically_increasing_id()), "pii-scan")
    seen = table.select("row", F.explode("occurrences").alias("o")).select(
        "row", "o.start", "o.end", "o.run", "o.kind", "o.instance", "o.suits", F.explode("o.patterns").alias("pattern"))
    edges = seen.select("pattern", "instance", "kind", "suits").distinct()
    trusted = score_patterns(edges, rounds, smoothing).filter(
        (F.col("confidence") >= confident) & (F.col("support") >= support))
    claims = seen.filter(F.col("kind").isNull()).select(
        "row", "start", "end", "run", "pattern", F.explode("suits").alias("kind")).join(trusted, ["pattern", "kind"])
    order = F.array_position(F.lit(list(KINDS)), F.col("kind")).cast("int") - 1
    best = claims.withColumn("order", order).groupBy("row", "run", "start", "end").agg(
        F.max_by(F.struct("order", "start", "kind", "end"), F.struct("confidence", -F.col("order"))).alias("span"))
    # Within a run that is claimed whole, that claim stands for those of its tokens.
    whole = best.groupBy("row", "run").agg(F.max("end").alias("reach"), F.min("start").alias("from"),
                                           F.max_by("span", F.col("end") - F.col("start")).alias("widest"),
                                           F.collect_list("span").alias("list"))
    covers = (F.col("widest.start") == F.col("from")) & (F.col("widest.end") == F.col("reach"))
    claimed = whole.select("row", F.when(covers, F.array("widest")).otherwise(F.col("list")).alias("list"))
    # A document's own spans only, so the list is no longer than its text.
    added = claimed.groupBy(F.col("row").alias("added_row")).agg(F.flatten(F.collect_list("list")).alias("added"))
    return table.join(added, F.col("row") == F.col("added_row"), "left").select(
        "doc_id", "row", "base",
        F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(T.ArrayType(SPAN))))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the result of `find`."""
    return found.select(
        "doc_id", *[count_kind("base", k).alias(f"n_{k}") for k in KINDS], F.sha2(join_spans(F.array_sort("base")), 256).alias("base_sha256"),
        join_spans(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
