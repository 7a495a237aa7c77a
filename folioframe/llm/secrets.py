"""Secrets in texts: fixed rules, and a linear-chain conditional random field that tags further tokens.

Tokens are runs of characters between blanks, quotes, brackets and `= : , ;`. Each is tagged O (outside), B (begins a
secret) or I (inside one). The field's features are the token's shape, its neighbours' hashed words, the separators
around it and numbers of the whole text. It learns from tokens that the rules mark, and is decoded by Viterbi.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm import spans as rules
from folioframe.llm.common import discard, map_texts, stored, unit_hash, unused

KINDS = ("assign", "access", "hex")
LEARNED = "crf"
SPAN = T.StructType([
    T.StructField("start", T.LongType()), T.StructField("order", T.IntegerType()),
    T.StructField("kind", T.StringType()), T.StructField("end", T.LongType()),
])
FIELDS = [T.StructField("base", T.ArrayType(SPAN)), T.StructField("learned", T.ArrayType(SPAN))]
SEPARATORS = " \t\n\r\v\f\"'`=:,;()[]{}<>|"
# Width of each feature's range of values; a token has one value of each.
RANGES = {
    "length": 10, "digits": 6, "upper": 6, "lower": 6, "mixture": 8, "changes": 8, "hex": 3, "shape": 512,
    "previous": 1024, "next": 1024, "before": 64, "after": 64, "previous_length": 10, "next_length": 10,
    "text_length": 16, "text_marks": 8,
}
OFFSETS = np.cumsum([0, *RANGES.values()])[:-1]
SIZE = sum(RANGES.values())
WINDOW = 40
NEVER = -1e9


def base_spans(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, end, kind, start and end of the secret itself) of the fixed rules, by start, then kind as listed."""
    found = [(a, b, "assign", c, d) for a, b, c, d in rules.assignments(text)]
    found += [(a, b, "access", a, b) for a, b in rules.access_keys(text)]
    found += [(a, b, "hex", a, b) for a, b in rules.hex_runs(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _classes() -> np.ndarray:
    """Per code point below 256: 0 separator, 1 digit, 2 upper, 3 lower hex letter, 4 other lower, 5 other."""
    table = np.full(257, 5, np.uint8)
    for c in range(256):
        if chr(c).isdigit() and c < 128:
            table[c] = 1
        elif chr(c).isupper():
            table[c] = 2
        elif chr(c) in "abcdef":
            table[c] = 3
        elif chr(c).islower():
            table[c] = 4
    for c in SEPARATORS:
        table[ord(c)] = 0
    return table


CLASSES = _classes()


def tokens(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and feature indexes (tokens x features) of a text's tokens."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = CLASSES[np.minimum(codes, 256)]
    inside = np.concatenate([[False], kinds != 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    n = len(starts)
    index = np.zeros((n, len(RANGES)), np.int32)
    if not n:
        return starts, ends, index
    lengths = ends - starts

    def per_token(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[ends] - sums[starts]

    digit, upper, hexa, low = (per_token(kinds == k) for k in (1, 2, 3, 4))
    changes = per_token(np.concatenate([[False], kinds[1:] != kinds[:-1]])) - (starts > 0)
    begun = np.zeros(len(codes), np.int64)
    begun[starts] = starts
    place = np.arange(len(codes)) - np.maximum.accumulate(begun)
    lowered = np.where((codes >= 65) & (codes < 91), codes + 32, codes).astype(np.uint32)
    spread = (lowered + np.uint32(1)) * (np.uint32(2654435761) * (2 * (place % 61).astype(np.uint32) + np.uint32(1)))
    hashed = np.bitwise_xor.reduceat(spread ^ (spread >> np.uint32(15)), np.stack([starts, ends], 1).ravel()[
        :2 * n - (ends[-1] == len(codes))])[::2]
    word = ((hashed * np.uint32(2246822519)) >> np.uint32(22)).astype(np.int32)
    sized = np.searchsorted([2, 4, 6, 8, 12, 16, 20, 24, 32], lengths, side="right")

    def share(count: np.ndarray) -> np.ndarray:
        return np.where(count == 0, 0, np.where(count == lengths, 5, 1 + np.minimum(3, 4 * count // lengths)))

    kinds_in = (digit > 0) * 1 + (upper > 0) * 2 + (hexa + low > 0) * 4
    odd = lengths - digit - upper - hexa - low > 0
    allhex = np.where(digit + hexa == lengths, 2, np.where(digit + hexa + upper == lengths, 1, 0))
    changed = np.minimum(7, 8 * changes // np.maximum(lengths, 1))
    text_length = np.full(n, min(15, int(np.log2(len(codes) + 1) / 1.5)))
    marks = np.full(n, min(7, int(8 * 20 * (kinds == 0).mean() / 20)))
    columns = (
        sized, share(digit), share(upper), share(hexa + low), kinds_in, changed, allhex,
        (sized * 48 + kinds_in * 6 + odd * 3 + allhex) % 512,
        np.concatenate([[0], word[:-1]]), np.concatenate([word[1:], [0]]),
        np.where(starts > 0, codes[starts - 1] % 64, 63), np.where(ends < len(codes), codes[np.minimum(ends, len(codes) - 1)] % 64, 63),
        np.concatenate([[0], sized[:-1]]), np.concatenate([sized[1:], [0]]), text_length, marks,
    )
    for k, column in enumerate(columns):
        index[:, k] = column
    return starts, ends, index + OFFSETS.astype(np.int32)


@dataclass
class Field:
    weights: np.ndarray      # features x 3 tags (O, B, I)
    transitions: np.ndarray  # from x to
    start: np.ndarray

    def allowed(self) -> tuple[np.ndarray, np.ndarray]:
        """Transitions and starts with the impossible ones (I at the start or after O) ruled out."""
        transitions, start = self.transitions.copy(), self.start.copy()
        transitions[0, 2] = NEVER
        start[2] = NEVER
        return transitions, start


def train(index: np.ndarray, tags: np.ndarray, rounds: int = 60, penalty: float = 1.0) -> Field:
    """Maximum likelihood with an L2 penalty, by Adam over all windows at once.

    `index` is windows x WINDOW x features, `tags` windows x WINDOW, -1 past a window's end. No windows: everything
    stays outside."""
    field = Field(np.zeros((SIZE, 3)), np.zeros((3, 3)), np.zeros(3))
    if not len(tags):
        field.start[0] = 1.0
        return field
    present = tags >= 0
    used, position = np.unique(index[present], return_inverse=True)
    position = position.reshape(-1, index.shape[2]).astype(np.int32)
    flat = np.zeros(index.shape, np.int32)
    flat[present] = position
    length, last = present.sum(axis=1), np.maximum(present.sum(axis=1) - 1, 0)
    rows = np.arange(len(tags))
    weights = np.zeros((len(used), 3))
    parameters = [weights, field.transitions, field.start]
    seen = [np.zeros_like(weights), np.zeros((3, 3)), np.zeros(3)]
    gold = np.eye(3)[np.where(present, tags, 0)] * present[..., None]
    for t, s in zip(tags[:, :-1][present[:, 1:]], tags[:, 1:][present[:, 1:]], strict=True):
        seen[1][t, s] += 1
    seen[2] += gold[:, 0].sum(axis=0)
    moment = [np.zeros_like(p) for p in parameters]
    second = [np.zeros_like(p) for p in parameters]
    for step in range(1, rounds + 1):
        # Feature by feature, which needs no array of all features' weights.
        emission = weights[flat[:, :, 0]]
        for k in range(1, index.shape[2]):
            emission += weights[flat[:, :, k]]
        transitions, start = Field(weights, field.transitions, field.start).allowed()
        forward = np.zeros((len(tags), WINDOW, 3))
        backward = np.zeros_like(forward)
        forward[:, 0] = start + emission[:, 0]
        for t in range(1, WINDOW):
            step_in = forward[:, t - 1, :, None] + transitions
            top = step_in.max(axis=1)
            new = np.log(np.exp(step_in - top[:, None]).sum(axis=1)) + top + emission[:, t]
            forward[:, t] = np.where(present[:, t, None], new, forward[:, t - 1])
        for t in range(WINDOW - 2, -1, -1):
            step_out = transitions + (emission[:, t + 1] + backward[:, t + 1])[:, None, :]
            top = step_out.max(axis=2)
            new = np.log(np.exp(step_out - top[..., None]).sum(axis=2)) + top
            backward[:, t] = np.where(present[:, t + 1, None], new, 0.0)
        ends = forward[rows, last]
        total = np.log(np.exp(ends - ends.max(axis=1, keepdims=True)).sum(axis=1)) + ends.max(axis=1)
        marginal = np.exp(np.minimum(forward + backward - total[:, None, None], 0.0)) * present[..., None]
        pair = np.exp(np.minimum(
            forward[:, :-1, :, None] + transitions + (emission + backward)[:, 1:, None, :] - total[:, None, None, None],
            0.0)) * present[:, 1:, None, None]
        off = (marginal - gold)[present]
        found = penalty * weights
        for k in range(index.shape[2]):
            for tag in range(3):
                found[:, tag] += np.bincount(position[:, k], off[:, tag], len(used))
        gradient = [
            found,
            pair.sum(axis=(0, 1)) - seen[1] + penalty * field.transitions,
            marginal[:, 0].sum(axis=0) - seen[2] + penalty * field.start,
        ]
        for k, (p, g) in enumerate(zip(parameters, gradient, strict=True)):
            moment[k] += 0.1 * (g - moment[k])
            second[k] += 0.01 * (g * g - second[k])
            p -= 0.15 * (moment[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
    field.weights[used] = weights
    return field


def viterbi(field: Field, index: np.ndarray) -> np.ndarray:
    """Best tag of each token of one text.

    A token whose O leads by more than any choice around it can repay is O on every best path. Such tokens cut the
    chain, so only the stretches between them are searched, all of them step by step together.
    """
    transitions, start = field.allowed()
    emission = field.weights[index[:, 0]]
    for k in range(1, index.shape[1]):
        emission = emission + field.weights[index[:, k]]
    n = len(index)
    tags = np.zeros(n, np.int8)
    swing = 6 * max(np.abs(field.transitions).max(), np.abs(field.start).max())
    follow = np.append(np.maximum(emission[1:, 2] - emission[1:, 1], 0.0), 0.0)
    open_ = emission[:, 0] - np.maximum(emission[:, 1], emission[:, 2]) <= swing + follow
    bounds = np.flatnonzero(np.diff(np.concatenate([[0], open_.astype(np.int8), [0]])))
    firsts, stops = bounds[::2], bounds[1::2]
    if not len(firsts):
        return tags
    order = np.argsort(firsts - stops, kind="stable")
    firsts, lengths = firsts[order], (stops - firsts)[order]
    score = np.where((firsts == 0)[:, None], start, transitions[0]) + emission[firsts]
    back = []
    for t in range(1, lengths[0]):
        live = int(np.searchsorted(-lengths, -t, side="left"))
        reach = score[:live, :, None] + transitions
        back.append(reach.argmax(axis=1))
        score[:live] = reach.max(axis=1) + emission[firsts[:live] + t]
    closing = np.where((firsts + lengths == n)[:, None], 0.0, transitions[:, 0])
    tag = (score + closing).argmax(axis=1)
    tags[firsts + lengths - 1] = tag
    for t in range(lengths[0] - 1, 0, -1):
        live = len(back[t - 1])
        tag[:live] = back[t - 1][np.arange(live), tag[:live]]
        tags[firsts[:live] + t - 1] = tag[:live]
    return tags


def learned_spans(field: Field, text: str, base: list[rules.Span], least: int = 8) -> list[rules.Span]:
    """Runs of B I... of at least `least` characters that touch no base span."""
    starts, ends, index = tokens(text)
    if not len(starts):
        return []
    tags = viterbi(field, index)
    found: list[rules.Span] = []
    for i in np.flatnonzero(tags):
        if tags[i] == 1 or not found:
            found.append((int(starts[i]), int(ends[i])))
        else:
            found[-1] = (found[-1][0], int(ends[i]))
    base = sorted(base)
    begins, reach = [a for a, _ in base], list(accumulate((b for _, b in base), max))
    return [(a, b) for a, b in found if b - a >= least
            and not ((k := bisect_left(begins, b)) and reach[k - 1] > a)]


def windows(text: str, picked: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training windows of a text: every marked token lies in one, each around the first marked token that the ones
    before do not hold. A text without any has one window around its first token that holds a digit, or else at a
    place fixed by `picked`."""
    starts, ends, index = tokens(text)
    n = len(starts)
    if not n:
        return []
    tags = np.zeros(n, np.int8)
    for *_, a, b in base_spans(text):
        first, stop = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b, side="left")
        tags[first:stop] = 2
        tags[first:first + 1] = 1
    digits = np.flatnonzero(index[:, 1] != OFFSETS[1])
    marked = np.flatnonzero(tags)
    middles, covered = [], 0
    for place in marked.tolist():
        if place >= covered:
            middles.append(place)
            covered = max(0, min(place - WINDOW // 2, n - WINDOW)) + WINDOW
    if not middles:
        middles = [int(digits[0]) if len(digits) else int(picked * n)]
    lows = [max(0, min(middle - WINDOW // 2, n - WINDOW)) for middle in middles]
    made = [(index[low:low + WINDOW], tags[low:low + WINDOW].copy()) for low in lows]
    for _, marks in made:
        # A window that starts inside a secret begins it: no chain starts with I.
        marks[0] = min(marks[0], 1)
    return made


# Features of a token's surroundings, which a copy of each training window goes without.
CONTEXT = ("shape", "previous", "next", "before", "after", "text_length", "text_marks")


def blurred(index: np.ndarray) -> np.ndarray:
    """The window with its surroundings unknown, so that a secret's own looks are learned too, not only the words it
    was found beside."""
    out = index.copy()
    for name in CONTEXT:
        at = list(RANGES).index(name)
        out[:, at] = OFFSETS[at]
    return out


def fit(documents: DataFrame, fit_rows: int = 12_000) -> Field:
    """Learn from about `fit_rows` windows at most, of about as many texts, both chosen by a hash.

    Of a chosen text every marked token lies in a window, wherever it stands. Windows without a secret or a digit are
    thinned to one in eight. Should the texts' windows be more than `fit_rows`, windows are chosen by a hash of text and
    place. The bound keeps what reaches the driver (a few kilobytes a window) and the fit the same size for any corpus.
    """
    total = documents.count()
    # Equal texts share a hash and are taken or left together, hence distinct rows of the sample only.
    sample = documents.select(F.coalesce("text", F.lit("")).alias("text")).filter(
        unit_hash("text", seed="crf") < fit_rows / max(total, 1)).withColumn("picked", unit_hash("text", seed="place"))
    schema = "index binary, tags binary, key bigint, place int"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, picked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kept += [(w, picked, place) for place, w in enumerate(windows(text, picked))
                         if w[1].any() or picked < 0.125 or (w[0][:, 1] != OFFSETS[1]).any()]
            yield pa.RecordBatch.from_arrays([
                pa.array([w[0].astype(np.int32).tobytes() for w, *_ in kept], pa.binary()),
                pa.array([w[1].tobytes() for w, *_ in kept], pa.binary()),
                pa.array([int(p * (1 << 30)) for _, p, _ in kept], pa.int64()),
                pa.array([k for *_, k in kept], pa.int32())], names=["index", "tags", "key", "place"])

    made = stored(sample.mapInArrow(cut, schema).dropDuplicates(["key", "place", "tags"]), "secrets-windows")
    rows = made.filter(unit_hash("key", "place", seed="window") < fit_rows / max(made.count(), 1)).orderBy(
        "key", "place", "tags").collect()
    discard(made)
    return train(*padded([(np.frombuffer(r["index"], np.int32).reshape(-1, len(RANGES)),
                           np.frombuffer(r["tags"], np.int8)) for r in rows]))


def padded(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows and their blurred copies as two arrays of one length, tags -1 past a window's end."""
    index = np.zeros((2 * len(found), WINDOW, len(RANGES)), np.int32)
    tags = np.full((2 * len(found), WINDOW), -1, np.int8)
    for i, (window, marks) in enumerate(found):
        for k, values in ((i, window), (len(found) + i, blurred(window))):
            index[k, :len(marks)], tags[k, :len(marks)] = values, marks
    return index, tags


def find_in(field: Field, texts: list[str]) -> dict[str, list]:
    base, learned = [], []
    for text in texts:
        fixed = base_spans(text)
        more = learned_spans(field, text, [(a, b) for a, b, *_ in fixed])
        base.append([{"start": a, "order": KINDS.index(k), "kind": k, "end": b} for a, b, k, *_ in fixed])
        learned.append([{"start": a, "order": len(KINDS), "kind": LEARNED, "end": b} for a, b in more])
    return {"base": base, "learned": learned}


def find(documents: DataFrame, keep: list[str], fit_rows: int = 12_000) -> DataFrame:
    """`keep` columns beside `base` and `learned`: arrays of spans (start, order, kind, end) in code points, end
    exclusive, by start.

    Whole texts are read, map-side. A NULL or empty text has no spans. Equal rows give equal results. Columns of
    `keep` named `base` or `learned` are replaced. Learned spans never touch a base span.
    """
    field = fit(documents, fit_rows)
    return map_texts(documents, keep, lambda texts: find_in(field, texts), FIELDS)


def redact_text(text: str, spans: list[rules.Span], mark: str) -> str:
    """`text` with every span, overlapping ones as one, replaced by `mark`."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(documents: DataFrame, mark: str = "<secret>", fit_rows: int = 12_000) -> DataFrame:
    """The rows and columns of `documents` with all secrets found in `text` replaced, and `n_chars` (if there is
    such a column) counted anew. NULL texts stay NULL; every row is kept."""
    field, name = fit(documents, fit_rows), unused(documents.columns, "changed")

    def work(texts: list[str]) -> dict[str, list]:
        out = []
        for text in texts:
            fixed = [(a, b) for a, b, *_ in base_spans(text)]
            found = fixed + learned_spans(field, text, fixed)
            out.append(redact_text(text, found, mark) if found else None)
        return {name: out}

    changed = map_texts(documents, documents.columns, work, [T.StructField(name, T.StringType())])
    text = F.coalesce(name, F.col("text").cast("string"))
    columns = {"text": text.cast(documents.schema["text"].dataType)}
    if "n_chars" in documents.columns:
        columns["n_chars"] = F.when(F.col(name).isNull(), F.col("n_chars")).otherwise(
            F.length(name).cast(documents.schema["n_chars"].dataType))
    return changed.select(*[columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in documents.columns])
