"""Secret scans by grammar inference.

Base rules find credentials of three kinds. Their values are labelled examples:
a prefix tree of the examples of a kind is folded into a probabilistic automaton by
merging states whose outgoing frequencies are statistically compatible (the Hoeffding
bound), so that it accepts the format beyond the values seen. Every run of
credential characters in every text is then scored by how much better an
automaton explains it than ordinary words do; runs above the threshold are added
to the spans of the base rules, which always stay.

The automata are fitted on a bounded sample of the labelled values, `EXAMPLES` a kind,
those with the smallest hashes; all else covers all texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgewise.plans.scratch import Scratch

KINDS = ("assign", "access", "hex")
EXAMPLES = 400
#: Significance of the Hoeffding bound: small values merge more.
ALPHA = 0.05
#: Mean log2 likelihood ratio per character, against ordinary words, above which a run is added.
THRESHOLD = 1.0
#: Shortest value that the base rules take, and so the shortest a format can have.
SHORTEST = 8
#: Shorter runs tell how ordinary words look.
ORDINARY = 16
MASK = "[secret]"

# ASCII: no other letter counts as a different case of these
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
NAMES = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = r"[A-Za-z0-9+/_.=-]{%d,}"


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """`(start, end, kind, value)` of the base rules, by start and kind."""
    found = []
    lower = text.lower()
    if any(n in lower for n in NAMES):
        found += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def symbols(value: str) -> str:
    """Character classes: digit, a-f, other lower, A-F, other upper; punctuation as it is."""
    return value.translate(CLASSES)


CLASSES = {ord(c): k for chars, k in (("0123456789", "d"), ("abcdef", "h"), ("ghijklmnopqrstuvwxyz", "l"), ("ABCDEF", "H"), ("GHIJKLMNOPQRSTUVWXYZ", "L")) for c in chars}
ALPHABET = "dhlHL+/_.=-"
#: How many characters a class stands for.
SIZE = {"d": 10, "h": 6, "l": 20, "H": 6, "L": 20}


class Automaton:
    """States with their counts: `ends[s]`, `next[s][symbol] = (state, count)`.

    The alphabet is the kind's own: the characters with which all examples begin stand
    for themselves, and classes that half of the examples mix are one symbol, whose
    characters have the frequencies of the examples.
    """

    def __init__(self, examples: list[str]):
        from collections import Counter
        from os.path import commonprefix

        self.prefix = commonprefix(examples) if len(set(examples)) > 1 else ""
        rest = [symbols(x[len(self.prefix) :]) for x in examples]
        self.group = {c: c for c in ALPHABET}
        for a in ALPHABET:
            for b in ALPHABET:
                if a < b and 2 * sum(a in x and b in x for x in rest) >= len(rest) > 1:
                    old, new = self.group[b], self.group[a]
                    self.group = {c: new if g == old else g for c, g in self.group.items()}
        seen = Counter(c for x in rest for c in x)
        whole = Counter()
        for c, n in seen.items():
            whole[self.group[c]] += n
        # log2 of the share of one character within its symbol
        self.share = {c: math.log2(n / whole[self.group[c]] / SIZE.get(c, 1)) for c, n in seen.items()}
        self.next: list[dict[str, list[int]]] = [{}]
        self.ends = [0]
        for example in sorted(rest):
            state = 0
            for c in map(self.group.__getitem__, example):
                if c not in self.next[state]:
                    self.next.append({})
                    self.ends.append(0)
                    self.next[state][c] = [len(self.ends) - 1, 0]
                step = self.next[state][c]
                step[1] += 1
                state = step[0]
            self.ends[state] += 1

    def passed(self, state: int) -> int:
        return self.ends[state] + sum(n for _, n in self.next[state].values())

    def compatible(self, a: int, b: int, alpha: float) -> bool:
        """Do the two states and their futures have the same frequencies, within the bound?"""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            na, nb = self.passed(a), self.passed(b)
            if not na or not nb:
                continue
            bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if abs(self.ends[a] / na - self.ends[b] / nb) > bound:
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(c, (None, 0)), self.next[b].get(c, (None, 0))
                if abs(x[1] / na - y[1] / nb) > bound:
                    return False
                if x[0] is not None and y[0] is not None and x[0] != y[0]:
                    stack.append((x[0], y[0]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the tree below `b` to the states from `a` on."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.ends[a] += self.ends[b]
            for c, (target, n) in self.next[b].items():
                if c in self.next[a]:
                    self.next[a][c][1] += n
                    stack.append((self.next[a][c][0], target))
                else:
                    self.next[a][c] = [target, n]

    def merge(self, alpha: float = ALPHA) -> "Automaton":
        """Red states are final; each blue child of them is merged into a compatible red one or becomes red."""
        red, order = [0], {0}
        while True:
            blue = [(r, c, s) for r in red for c, (s, _) in sorted(self.next[r].items()) if s not in order]
            if not blue:
                return self.packed(red)
            source, c, state = max(blue, key=lambda x: self.passed(x[2]))
            for other in red:
                if self.compatible(other, state, alpha):
                    self.next[source][c][0] = other
                    self.fold(other, state)
                    break
            else:
                red.append(state)
                order.add(state)

    def packed(self, red: list[int]) -> "Automaton":
        at = {s: i for i, s in enumerate(red)}
        self.ends = [self.ends[s] for s in red]
        self.next = [{c: [at[t], n] for c, (t, n) in self.next[s].items()} for s in red]
        return self

    def score(self, value: str) -> float:
        """log2 likelihood of `value`; -inf outside the format."""
        if not value.startswith(self.prefix):
            return -math.inf
        state, total = 0, 0.0
        for c in symbols(value[len(self.prefix) :]):
            step = self.next[state].get(self.group[c])
            if step is None or c not in self.share:
                return -math.inf
            total += math.log2(step[1] / self.passed(state)) + self.share[c]
            state = step[0]
        ended = self.ends[state]
        return total + math.log2(ended / self.passed(state)) if ended else -math.inf


class Words:
    """Ordinary text: smoothed class bigrams, from counts over all texts."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.pair = {}
        for a in "^" + ALPHABET:
            total = sum(counts.get((a, b), 0) + 1 for b in ALPHABET + "$")
            for b in ALPHABET + "$":
                self.pair[a, b] = math.log2((counts.get((a, b), 0) + 1) / total / SIZE.get(b, 1))

    def score(self, classes: str) -> float:
        return sum(self.pair[p] for p in zip("^" + classes, classes + "$", strict=True))


TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+")


def learn(docs: DataFrame, examples: int = EXAMPLES) -> tuple[dict[str, Automaton], Words, int]:
    """Automata of each kind seen, the model of ordinary words over all texts, the length of the shortest value.

    Words under 16 characters are counted for the latter, per class pair.
    """
    scratch = Scratch(docs.sparkSession, "grammar")

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        for batch in batches:
            rows, pairs = set(), Counter()
            for text in batch["text"]:
                if not isinstance(text, str):
                    continue
                for _, _, kind, value in base_spans(text):
                    rows.add((kind, value))
                words = Counter(w for w in symbols(text.translate(OUTSIDE)).split() if len(w) < ORDINARY)
                for w, n in words.items():
                    for pair in zip("^" + w, w + "$", strict=True):
                        pairs[pair] += n
            yield pd.DataFrame(
                [(k, v, 1) for k, v in rows] + [("pair", a + b, n) for (a, b), n in pairs.items()], columns=["kind", "value", "n"]
            )

    seen = scratch.write(
        docs.select("text").mapInPandas(gather, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    ).df
    chosen = (
        seen.where("kind <> 'pair'")
        .withColumn("_rank", F.row_number().over(Window.partitionBy("kind", F.pmod(F.xxhash64("value"), F.lit(16))).orderBy(F.xxhash64("value", F.lit(1)))))
        .where(F.col("_rank") <= examples)
        .withColumn("_rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("value", F.lit(1)))))
        .where(F.col("_rank") <= examples)
        .select("kind", "value")
        .collect()
    )
    values: dict[str, list[str]] = {}
    for row in chosen:
        values.setdefault(row["kind"], []).append(row["value"])
    # at most 12 x 12 sums
    pairs = {(r["value"][0], r["value"][1]): r["n"] for r in seen.where("kind = 'pair'").collect()}
    shortest = min((len(v) for listed in values.values() for v in listed), default=SHORTEST)
    return {k: Automaton(v).merge() for k, v in sorted(values.items())}, Words(pairs), shortest


class _Outside(dict):
    """Blanks every character that no credential has."""

    def __missing__(self, code: int) -> int | None:
        self[code] = code if chr(code) in TOKEN_CHARS else 32
        return self[code]


TOKEN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
OUTSIDE = _Outside()


class Scanner:
    """Scores every run of credential characters, from the length of the shortest labelled value on."""

    def __init__(self, automata: dict[str, Automaton], words: Words, shortest: int, threshold: float):
        self.automata, self.words, self.threshold = automata, words, threshold
        self.run = re.compile(RUN % max(SHORTEST, shortest))
        self.shortest = max(SHORTEST, shortest)

    def kind(self, value: str) -> str | None:
        """The kind whose format explains the run best, if well enough."""
        best, kind = max(((a.score(value), k) for k, a in self.automata.items()), default=(-math.inf, ""))
        if best == -math.inf:
            return None
        return kind if (best - self.words.score(symbols(value))) / len(value) > self.threshold else None

    def spans(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Base spans and all spans, as `(start, end, kind)`."""
        base = [x[:3] for x in base_spans(text)]
        added = []
        at = 0
        for m in self.run.finditer(text) if self.automata else ():
            # what base spans leave of the run
            low = m.start()
            while at < len(base) and base[at][1] <= low:
                at += 1
            pieces = []
            for a, b, _ in base[at:]:
                if a >= m.end():
                    break
                pieces.append((low, a))
                low = max(low, b)
            for a, b in [*pieces, (low, m.end())]:
                kind = self.kind(text[a:b]) if b - a >= self.shortest else None
                if kind:
                    added.append((a, b, kind))
        return base, sorted(base + added, key=lambda x: (x[0], KINDS.index(x[2])))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = MASK) -> str:
    """`text` with every stretch that spans cover replaced by `mark`."""
    out, at, end = [], 0, 0
    for a, b, _ in spans:
        if a >= end:
            out += [text[at:a], mark]
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, threshold: float = THRESHOLD, examples: int = EXAMPLES) -> DataFrame:
    """Per row of `docs(doc_id, text)`: counts of the base rules, base and all spans, the redacted text.

    Columns doc_id, n_assign, n_access, n_hex, base, spans (`kind:start:end` by start
    and kind, comma-joined; code points, end exclusive), redacted. A null text has no
    spans and stays null; without any labelled value nothing is added to the base
    spans; repeated rows get a row each. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, examples))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(*shared.value, threshold)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                base, spans = scanner.spans(text) if isinstance(text, str) else ([], [])
                counts = [sum(k == kind for _, _, k in base) for kind in KINDS]
                clean = redact(text, spans) if isinstance(text, str) else None
                rows.append((doc_id, *counts, listed(base), listed(spans), clean))
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans", "redacted"]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(
        find,
        "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string, redacted string",
    )


def without_secrets(docs: DataFrame, threshold: float = THRESHOLD, examples: int = EXAMPLES) -> DataFrame:
    """`docs` with the secrets of `text` replaced by `[secret]`; `n_chars`, if there, is counted anew.

    No row is dropped and texts without secrets are unchanged.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, examples))

    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(*shared.value, threshold)
        for batch in texts:
            yield batch.map(lambda t: redact(t, scanner.spans(t)[1]) if isinstance(t, str) else None)

    out = docs.withColumn("text", F.pandas_udf(clean, "string")("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out
