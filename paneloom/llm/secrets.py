"""Secrets: fixed expressions, and probabilistic automata inferred from the credentials they label.

The values that the fixed expressions find are labelled credentials. A bounded
sample of them (`per_kind` distinct values of at most `longest` characters a kind,
taken by hash) becomes one prefix tree per kind, whose statistically compatible
states are merged; the automaton that is left gives every candidate token a format
likelihood. Null and empty texts have no spans; without any labelled credential no
automaton is learned and only the fixed expressions speak.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from paneloom.llm.rows import per_row
from paneloom.llm.spans import Covered

BASE_KINDS = ["assign", "access", "hex"]
KINDS = BASE_KINDS + ["learned"]
SPANS = ArrayType(StructType([
    StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()),
    StructField("value", StringType()), StructField("base", BooleanType()), StructField("score", DoubleType())]))

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}")
_DIGITS = b"0123456789"
_HEX_MARKS = bytes(120 if b in b"0123456789abcdef" else 32 for b in range(256))


def base_spans(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) of the fixed expressions, leftmost and non-overlapping within a kind."""
    if not text:
        return []
    out, low = [], text.lower()
    if any(name in low for name in _NAMES):
        out += [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    if b"x" * 16 in text.encode().translate(_HEX_MARKS):
        out += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return out


def candidates(text: str | None):
    """Tokens of 12 or more characters with a letter and a digit that stand in no address."""
    if not text or len((raw := text.encode()).translate(None, _DIGITS)) == len(raw):
        return
    for m in _RUN.finditer(text):
        token = m[0]
        if text[m.end():m.end() + 1] == "@" or text[m.start() - 1:m.start()] == "@":
            continue
        if any(c.isdigit() for c in token) and any(c.isalpha() for c in token):
            yield m.start(), m.end(), token


def symbols(token: str) -> str:
    """Character classes: digit, hexadecimal and other letters by case, and each sign as itself."""
    return "".join("d" if c.isdigit() else ("h" if c in "abcdef" else "l") if c.islower() else
                   ("H" if c in "ABCDEF" else "U") if c.isupper() else c for c in token)


class Automaton:
    """A deterministic automaton with counts, merged from the prefix tree of a sample (the ALERGIA rule)."""

    def __init__(self, sample: list[str], alpha: float = 0.05):
        self.visits, self.ends, self.next, self.moves = [0], [0], [{}], [Counter()]
        for word in sample:
            self._add(word)
        self._merge(math.sqrt(0.5 * math.log(2 / alpha)))
        own = sorted(self.likelihood(word) for word in sample)
        self.least = own[len(own) // 100] if own else math.inf

    def _add(self, word: str) -> None:
        state = 0
        self.visits[0] += 1
        for c in word:
            if c not in self.next[state]:
                self.next[state][c] = len(self.visits)
                self.visits.append(0), self.ends.append(0), self.next.append({}), self.moves.append(Counter())
            self.moves[state][c] += 1
            state = self.next[state][c]
            self.visits[state] += 1
        self.ends[state] += 1

    def _compatible(self, a: int, b: int, bound: float) -> bool:
        """Hoeffding's bound holds for the ends and every move, here and below."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            width = bound * (self.visits[a] ** -0.5 + self.visits[b] ** -0.5)
            if abs(self.ends[a] / self.visits[a] - self.ends[b] / self.visits[b]) > width:
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                if abs(self.moves[a].get(c, 0) / self.visits[a] - self.moves[b].get(c, 0) / self.visits[b]) > width:
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add a subtree's counts to the state `into` and what follows it."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for c, child in self.next[b].items():
                self.moves[a][c] += self.moves[b][c]
                if c in self.next[a]:
                    todo.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    def _merge(self, bound: float) -> None:
        kept, fringe = [0], [(0, c) for c in sorted(self.next[0])]
        while fringe:
            parent, c = fringe.pop(0)
            state = self.next[parent][c]
            if state in kept:
                continue
            for old in kept:
                if self._compatible(old, state, bound):
                    self.next[parent][c] = old
                    self._fold(old, state)
                    break
            else:
                kept.append(state)
            fringe = [(s, k) for s in kept for k in sorted(self.next[s]) if self.next[s][k] not in kept]
        names = {s: i for i, s in enumerate(kept)}
        self.visits, self.ends, self.moves, self.next = (
            [self.visits[s] for s in kept], [self.ends[s] for s in kept], [dict(self.moves[s]) for s in kept],
            [{c: names[t] for c, t in self.next[s].items()} for s in kept])

    def likelihood(self, word: str) -> float:
        """Mean log2 probability of the symbols and the end; minus infinity where no path leads."""
        state, total = 0, 0.0
        for c in word:
            if c not in self.next[state]:
                return -math.inf
            total += math.log2(self.moves[state][c] / self.visits[state])
            state = self.next[state][c]
        if not self.ends[state]:
            return -math.inf
        return (total + math.log2(self.ends[state] / self.visits[state])) / (len(word) + 1)


class Grammar:
    """One automaton per labelled kind, and the plain frequencies of symbols to hold them against."""

    def __init__(self, labelled: list[tuple[str, str]], plain: dict[str, int]):
        by_kind = defaultdict(list)
        for kind, value in labelled:
            by_kind[kind].append(symbols(value))
        self.automata = {kind: Automaton(sorted(words)) for kind, words in sorted(by_kind.items())}
        total = sum(plain.values())
        self.plain = {c: math.log2(n / total) for c, n in plain.items()}
        self.rare = -math.log2(total + 1)

    def score(self, token: str) -> float:
        """0 to 1: how far the best automaton, at home with the format, beats the plain frequencies."""
        word, best = symbols(token), 0.0
        base = sum(self.plain.get(c, self.rare) for c in word) / (len(word) + 1)
        for automaton in self.automata.values():
            own = automaton.likelihood(word)
            if own >= automaton.least:
                best = max(best, 1 / (1 + 2 ** -min(60.0, (own - base) * (len(word) + 1))))
        return best


def learn(docs: DataFrame, text: str = "text", per_kind: int = 2000, longest: int = 200) -> Grammar:
    """Automata from a bounded hash sample of the corpus's own labelled credentials.

    Distinct values and symbol counts are aggregated in Spark; the driver gets at
    most `per_kind` values of each kind and one count per symbol.
    """
    def start():
        return lambda value: ([{"kind": k, "value": v} for k, _, _, v in base_spans(value)],
                              list(Counter(symbols("".join(t for _, _, t in candidates(value)))).items()))

    found = per_row(docs, [text], {
        "labelled": ArrayType(StructType([StructField("kind", StringType()), StructField("value", StringType())])),
        "plain": ArrayType(StructType([StructField("symbol", StringType()), StructField("n", LongType())]))}, start, keep=[])
    rows = found.where("size(labelled) > 0 or size(plain) > 0").select(F.explode(F.concat(
        F.transform("labelled", lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), F.lit(0).cast("bigint").alias("n"))),
        F.transform("plain", lambda x: F.struct(F.lit("plain").alias("kind"), x["symbol"].alias("value"), x["n"].alias("n"))))).alias("r"))
    counted = rows.select("r.*").where(F.length("value") <= longest).groupBy("kind", "value").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("kind").orderBy(F.md5("value"), "value")
    sample = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_kind).collect()
    return Grammar(sorted((r["kind"], r["value"]) for r in sample if r["kind"] != "plain"),
                   {r["value"]: r["n"] for r in sample if r["kind"] == "plain"})


def secret_spans(text: str | None, grammar: Grammar, least: float = 0.9) -> list[tuple]:
    """Base spans, then candidate tokens outside them whose format the grammar knows."""
    base = base_spans(text)
    out = [(k, s, e, v, True, 1.0) for k, s, e, v in base]
    if grammar.automata:
        held = Covered((s, e) for _, s, e, _ in base)
        for start, end, token in candidates(text):
            if not held.meets(start, end) and (score := grammar.score(token)) >= least:
                out.append(("learned", start, end, token, False, score))
    return out


def redacted(text: str | None, spans: list[tuple], mark: str = "<secret>") -> str | None:
    """The text with every covered run of code points replaced by a mark."""
    if not spans:
        return text
    out, done, covered = [], 0, -1
    for start, end in sorted((s, e) for _, s, e, *_ in spans):
        if start >= covered:
            out += [text[done:start], mark]
        covered = done = max(covered, end)
    return "".join(out) + text[done:]


def find_secrets(docs: DataFrame, grammar: Grammar | None = None, text: str = "text", into: str = "secrets",
                 clean: str | None = None, keep: list[str] | None = None, least: float = 0.9) -> DataFrame:
    """`docs` with the spans of `text` in `into`, and the redacted text in `clean` if that is named."""
    grammar = learn(docs, text) if grammar is None else grammar
    held = docs.sparkSession.sparkContext.broadcast(grammar)
    names = [f.name for f in SPANS.elementType]

    def start():
        known = held.value

        def fn(value):
            spans = secret_spans(value, known, least)
            listed = [dict(zip(names, span)) for span in spans]
            return (listed, redacted(value, spans)) if clean else (listed,)
        return fn

    fields = {into: SPANS, clean: StringType()} if clean else {into: SPANS}
    return per_row(docs, [text], fields, start, keep)
