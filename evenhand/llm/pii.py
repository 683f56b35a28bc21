"""Personal data: proposed spans, boosted trees, calibrated thresholds.

Base spans follow fixed patterns and always stay. Beyond them, generators with high
recall propose overlapping spans (address-like, dotted, digit chains and their parts,
long mixed tokens, assigned values); boosted trees judge each from its format and its
context; a threshold per kind, set on held-out rows after isotonic calibration, selects
spans, best first, none overlapping another or a base span.

The trees are fitted on a bounded sample: candidates of about ``fit_docs`` documents in
which a digit or an @ occurs, drawn by hash. Labels come from the corpus: a candidate
that nearly equals a base span, the national part of a base phone, or a value assigned
to a secret's name is private; a fragment of such a span, a short number or a plain word
is not; the rest is left out of the fit. Every document is then read whole, in one pass
without a shuffle; the trees travel as a few kilobytes.

Nulls: a null text is empty, and comes back null from :func:`redact`. Repeated rows give
repeated rows. If the sample has only one class (tiny or empty tables), only base spans
are found. Extra columns are carried in a struct and cannot clash.
"""

import bisect
import hashlib
import itertools
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evenhand.llm.common import portions
from evenhand.session import materialize

KINDS = ("email", "ip", "card", "phone", "secret")

# Base patterns, as the contract gives them; possessive runs keep them linear.
_RUN = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+)?")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

# Generators.
_LOOSE_MAIL = re.compile(
    r"[\w.+-]++(\s?(?:@|\(at\)|\[at\])\s?[\w-]{1,64}(?:\s?(?:\.|\(dot\)|\[dot\])\s?[\w-]{1,64})+)?"
)
_CHAIN = re.compile(r"[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9])+")
_GROUP = re.compile(r"[+(]?[0-9]+\)?")
_COLONS = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Fa-f:])")
_LONG = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
_NAMED = re.compile(
    r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"',;]{6,})"
)
_WORDS = {
    "phone": re.compile(r"(?i)phone|tel|call|mobile|fax"),
    "mail": re.compile(r"(?i)mail|contact"),
    "net": re.compile(r"(?i)\bip\b|host|addr|server"),
    "card": re.compile(r"(?i)card|visa|credit|account"),
    "secret": re.compile(r"(?i)token|secret|passw|key|pwd"),
}
CONTEXT = 24
#: Digits of a proposed chain.
LEAST_DIGITS, MOST_DIGITS = 4, 24

FEATURES = (
    "mail chain dotted colons long named length digits letters upper marks spaces distinct "
    "digit_share groups longest_group plus bracket at dots dashes hexadecimal entropy "
    "after_letter before_letter after_digit before_digit after_mark assigned "
    "w_phone w_mail w_net w_card w_secret"
).split()
_GENERATORS = FEATURES[:6]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start, then kind as listed."""
    found = []
    if "@" in text:
        found += [("email", *m.span()) for m in _RUN.finditer(text) if m[1]]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def proposals(text: str) -> list[tuple[str, str, int, int]]:
    """(generator, kind, start, end); spans overlap freely."""
    out: dict[tuple[str, int, int], str] = {}
    if "@" in text or "(at)" in text or "[at]" in text:
        for m in _LOOSE_MAIL.finditer(text):
            if m[1]:
                out.setdefault(("email", *m.span()), "mail")
    if _DIGIT.search(text):
        for m in _CHAIN.finditer(text):
            # every run of whole groups with so many digits: a bounded number from each group
            groups = [(m.start() + g.start(), m.start() + g.end()) for g in _GROUP.finditer(m[0])]
            sizes = [sum(c.isdigit() for c in text[a:b]) for a, b in groups]
            for i, (a, _) in enumerate(groups):
                digits = 0
                for j in range(i, len(groups)):
                    digits += sizes[j]
                    if digits > MOST_DIGITS:
                        break
                    if digits < LEAST_DIGITS:
                        continue
                    b = groups[j][1]
                    dotted = j - i == 3 and text[a:b].count(".") == 3
                    kind = "ip" if dotted else "card" if digits >= 12 else "phone"
                    out.setdefault((kind, a, b), "dotted" if dotted else "chain")
        for m in _COLONS.finditer(text):
            out.setdefault(("ip", *m.span()), "colons")
        for m in _LONG.finditer(text):
            out.setdefault(("secret", *m.span()), "long")
    if "=" in text or ":" in text:
        for m in _NAMED.finditer(text):
            out[("secret", *m.span(1))] = "named"
    return [(g, *s) for s, g in out.items()]


def features(text: str, generator: str, start: int, end: int) -> list[float]:
    """The row of :data:`FEATURES` of one candidate."""
    s = text[start:end]
    n = len(s)
    digits = sum(c.isdigit() for c in s)
    letters = sum(c.isalpha() for c in s)
    upper = sum(c.isupper() for c in s)
    spaces = sum(c.isspace() for c in s)
    counts = [s.count(c) for c in set(s)]
    groups = re.findall("[0-9]+", s)
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + 1]
    last = before[-1:]
    return [
        *(float(generator == g) for g in _GENERATORS),
        n,
        digits,
        letters,
        upper,
        n - digits - letters - spaces,
        spaces,
        len(counts),
        digits / n,
        len(groups),
        max(map(len, groups), default=0),
        s.startswith("+"),
        s.startswith("("),
        s.count("@"),
        s.count("."),
        s.count("-"),
        all(c in "0123456789abcdefABCDEF" for c in s),
        -sum(c / n * math.log2(c / n) for c in counts),
        after.isalpha(),
        last.isalpha(),
        after.isdigit(),
        last.isdigit(),
        after != "" and not after.isalnum() and not after.isspace(),
        re.search(r"[:=]\s{0,3}[\"']?$", before) is not None,
        *(w.search(before) is not None for w in _WORDS.values()),
    ]


class Taken:
    """Spans in order of their starts, and whether a further one would overlap them."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.spans = sorted(spans, key=lambda s: s[1])
        self.starts = [a for _, a, _ in self.spans]
        self.ends = list(itertools.accumulate((b for _, _, b in self.spans), max))

    def meets(self, a: int, b: int) -> bool:
        k = bisect.bisect_left(self.starts, b)
        return k > 0 and self.ends[k - 1] > a

    def over(self, a: int, b: int):
        """The spans that overlap [a, b)."""
        k = bisect.bisect_left(self.starts, b) - 1
        while k >= 0 and self.ends[k] > a:
            if self.spans[k][2] > a:
                yield self.spans[k]
            k -= 1


def weak_label(text: str, base: Taken, cand: tuple[str, str, int, int]) -> float | None:
    """1 private, 0 not, None undecided, from base spans and plain facts of the text."""
    generator, kind, a, b = cand
    near, inside = False, False
    for k, x, y in base.over(a, b):
        common = min(b, y) - max(a, x)
        whole = max(b, y) - min(a, x)
        # a national part holds most of the digits of its phone
        part_of_phone = k == kind == "phone" and common == b - a and b == y and 4 * common >= 3 * whole
        near |= (common == whole or part_of_phone or (k == kind and 20 * common >= 17 * whole))
        inside = True
    if near or generator == "named":
        return 1.0
    if inside:
        return 0.0
    s = text[a:b]
    digits = sum(c.isdigit() for c in s)
    if generator == "chain":
        return 0.0 if digits < 9 and "(" not in s else None
    if generator == "long":
        return 0.0 if digits == 0 else None
    return None


@dataclass
class Judge:
    """Boosted trees as arrays, with the calibration and the threshold of each kind."""

    trees: list[tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(
        default_factory=list
    )
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))
    least: dict[str, float] = field(default_factory=dict)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for weight, feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                rows = np.flatnonzero(inner)
                node = at[rows]
                at[rows] = np.where(x[rows, feature[node]] <= cut[node], left[node], right[node])
            total += weight * value[at]
        return 1 / (1 + np.exp(-2 * total))

    def chance(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of each row."""
        return np.interp(self.margin(x), *self.steps)

    def spans(self, texts: list[str]) -> list[tuple[list, list]]:
        """(base spans, added spans) of every text."""
        base = [base_spans(t) for t in texts]
        found = [[] for _ in texts]
        if self.trees:
            rows, owners = [], []
            for i, t in enumerate(texts):
                taken = Taken(base[i])
                for c in proposals(t):
                    if not taken.meets(c[2], c[3]):
                        rows.append(features(t, c[0], c[2], c[3]))
                        owners.append((i, c))
            if rows:
                chance = self.chance(np.asarray(rows, float))
                order = sorted(
                    range(len(rows)), key=lambda k: (owners[k][0], -chance[k], owners[k][1][2] - owners[k][1][3], owners[k][1][2:])
                )
                for k in order:
                    i, (_, kind, a, b) = owners[k]
                    if chance[k] < self.least.get(kind, 2.0):
                        continue
                    # spans taken so far do not overlap: only the neighbours can meet this one
                    own = found[i]
                    at = bisect.bisect_left(own, a, key=lambda s: s[1])
                    if (at < len(own) and own[at][1] < b) or (at and own[at - 1][2] > a):
                        continue
                    own.insert(at, (kind, a, b))
        return list(zip(base, found))


def _isotonic(score: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: scores and the calibrated chance at each."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, t in zip(score[order], truth[order]):
        blocks.append([t, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, n2, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + n2, blocks[-1][2], hi]
    xs, ys = [], []
    for t, n, lo, hi in blocks:
        xs += [lo, hi]
        ys += [t / n] * 2
    return np.asarray(xs), np.asarray(ys)


def _arrays(tree, weight: float):
    """One fitted tree as arrays, walked from its root."""
    feature, cut, left, right, value = [], [], [], [], []

    def add(node) -> int:
        k = len(value)
        value.append(float(node.prediction()))
        for x in (feature, left, right):
            x.append(-1)
        cut.append(0.0)
        if "Internal" in node.getClass().getSimpleName():
            feature[k], cut[k] = int(node.split().featureIndex()), float(node.split().threshold())
            left[k] = add(node.leftChild())
            right[k] = add(node.rightChild())
        return k

    add(tree._call_java("rootNode"))
    return (weight, np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value))


def _candidates(docs: DataFrame) -> DataFrame:
    """Kind, features, label and fold of every labelled candidate."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                taken = Taken(base_spans(text))
                fold = int.from_bytes(hashlib.md5(text.encode()).digest()[:4], "little") % 3
                for c in proposals(text):
                    label = weak_label(text, taken, c)
                    if label is not None:
                        x = [float(v) for v in features(text, c[0], c[2], c[3])]
                        rows.append((c[1], x, label, fold))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cols[0], pa.string()),
                    pa.array(cols[1], pa.list_(pa.float64())),
                    pa.array(cols[2], pa.float64()),
                    pa.array(cols[3], pa.int32()),
                ],
                ["kind", "x", "label", "fold"],
            )

    return docs.select("text").mapInArrow(run, "kind string, x array<double>, label double, fold int")


def fit(
    docs: DataFrame,
    fit_docs: int = 3000,
    rounds: int = 20,
    depth: int = 4,
    precision: float = 0.95,
) -> Judge:
    """Fit on the candidates of about ``fit_docs`` documents; calibrate on a third of them.

    ``precision``: least precision, on the held-out third, above a kind's threshold."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    text = F.col("text").cast("string")
    able = docs.select("doc_id", text.alias("text")).where(F.col("text").rlike("[0-9@]"))
    n = able.count()
    share = min(1.0, fit_docs / max(n, 1))
    drawn = able.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = materialize(_candidates(drawn), "pii-candidates")
    train = (
        rows.where("fold <> 0")
        .select("x", "label")
        .repartition(1)
        .sortWithinPartitions("x", "label")
        .select(array_to_vector("x").alias("features"), "label")
    )
    if train.select("label").distinct().count() < 2:
        return Judge()
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=7).fit(train)
    judge = Judge([_arrays(t, w) for t, w in zip(model.trees, model.treeWeights)])
    held = rows.where("fold = 0").orderBy("kind", "x", "label").toPandas()  # of the bounded sample
    if not len(held):
        return judge
    x, truth = np.asarray(held["x"].tolist(), float), held["label"].to_numpy()
    judge.steps = _isotonic(judge.margin(x), truth)
    chance = judge.chance(x)
    for kind in KINDS:
        own = (held["kind"] == kind).to_numpy()
        best = None
        for t in sorted(set(chance[own])):
            taken = own & (chance >= t)
            if t >= 0.5 and truth[taken].mean() >= precision:
                best = t
                break
        if best is not None:
            judge.least[kind] = float(best)
    return judge


def _texts(column) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _join(spans) -> str:
    ordered = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)


def find(docs: DataFrame, judge: Judge, carry: list[str]) -> DataFrame:
    """The carried columns, counts of base spans, and base and all spans as text."""
    kept = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"),
        F.col("text").cast("string").alias("text"),
    )
    row = kept.schema["_row"].dataType.simpleString()
    counts = [f"n_{k}" for k in KINDS[:4]]

    def run(batches):
        for batch in batches:
            found = judge.spans(_texts(batch.column(1)))
            out = [batch.column(0)]
            for k in KINDS[:4]:
                out.append(pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()))
            out.append(pa.array([_join(b) for b, _ in found], pa.string()))
            out.append(pa.array([_join([*b, *m]) for b, m in found], pa.string()))
            yield pa.RecordBatch.from_arrays(out, ["_row", *counts, "base", "spans"])

    return kept.mapInArrow(
        run, f"_row {row}, {', '.join(f'{c} long' for c in counts)}, base string, spans string"
    )


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span (overlapping ones merged) replaced by a tag of its kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, judge: Judge) -> DataFrame:
    """The documents with tags for personal data, and ``n_chars`` set anew if there is one."""
    names = docs.columns
    kept = docs.withColumn("text", F.col("text").cast("string"))
    schema = kept.schema

    def run(batches):
        for batch in portions(batches, lambda b: b.column("text")):
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            found = judge.spans([t or "" for t in texts])
            new = [t if t is None else redacted(t, [*b, *m]) for t, (b, m) in zip(texts, found)]
            yield batch.set_column(at, "text", pa.array(new, pa.string()))

    out = kept.mapInArrow(run, schema)
    if "n_chars" in names:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))
    return out.select(*[f"`{c}`" for c in names])
