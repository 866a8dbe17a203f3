"""Secret scans: fixed patterns, plus formats inferred as probabilistic automata from labelled credentials."""

from __future__ import annotations

import hashlib
import math
import re
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from venuekit.session import materialize

# Fixed patterns of the base scan, in the order in which ties are listed, with the least length.
KINDS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}
ORDER = {kind: i for i, kind in enumerate([*KINDS, "format"])}
_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
MAX_CREDENTIALS, MAX_ORDINARY = 1_000, 4_000
ALPHA, MIN_BITS = 0.05, 0.5
_HEX_RUN = re.compile(r"[0-9a-f]{16,}")  # a run is matched whole, so shorter ones need no visit


def symbol_of(ch: str) -> str:
    """Character class in which formats are learned: digit, hex letter, other lower, upper, or the sign itself."""
    if ch.isdigit():
        return "9"
    if "a" <= ch <= "z":
        return "f" if ch <= "f" else "z"
    return "A" if "A" <= ch <= "Z" else ch


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """``(kind, start, end, value)`` of the fixed patterns by start, then kind."""
    found = []
    for kind, (pattern, group, least) in KINDS.items():
        for m in (_HEX_RUN if kind == "hex" else pattern).finditer(text):
            if len(m[group]) >= least:
                found.append((kind, m.start(), m.end(), m[group]))
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]]))


def other_candidates(text: str, spans: list[tuple]) -> list[tuple[str, int, int, str]]:
    """Long tokens with a digit that no base span touches."""
    out = []
    for m in CANDIDATE.finditer(text):
        if any(c.isdigit() for c in m[0]) and not any(s[1] < m.end() and m.start() < s[2] for s in spans):
            out.append(("format", m.start(), m.end(), m[0]))
    return out


def _scan(texts: pd.Series) -> pd.DataFrame:
    names = ("kind", "start", "end", "value")
    rows = []
    for text in texts:
        spans = base_spans(text or "")
        rows.append(([dict(zip(names, s)) for s in spans], [dict(zip(names, s)) for s in other_candidates(text or "", spans)]))
    return pd.DataFrame(rows, columns=["base", "other"])


def infer_automaton(values: list[str], alpha: float = ALPHA) -> list[tuple[int, str, int, float]]:
    """States of the prefix tree merged where their futures agree: ``(state, symbol, next state, probability)``.

    The end of a value is the symbol ``''`` to state -1. States are visited from the root outward; each
    is merged into the first kept state from which it does not differ by the Hoeffding bound in any
    outgoing share, checked down the tree, or else kept.
    """
    out: list[dict[str, int]] = [{}]
    seen, ends, flow = [0], [0], [{}]
    for value in sorted(values):
        state = 0
        seen[0] += 1
        for sym in map(symbol_of, value):
            if sym not in out[state]:
                out[state][sym] = len(out)
                out.append({}), seen.append(0), ends.append(0), flow.append({})
            flow[state][sym] = flow[state].get(sym, 0) + 1
            state = out[state][sym]
            seen[state] += 1
        ends[state] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            if differ(ends[p], seen[p], ends[q], seen[q]):
                return False
            for sym in {*out[p], *out[q]}:
                if differ(flow[p].get(sym, 0), seen[p], flow[q].get(sym, 0), seen[q]):
                    return False
                if sym in out[p] and sym in out[q]:
                    todo.append((out[p][sym], out[q][sym]))
        return True

    def fold(p: int, q: int) -> None:
        """Add the subtree at ``q`` to ``p``."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            seen[p] += seen[q]
            ends[p] += ends[q]
            for sym, child in out[q].items():
                flow[p][sym] = flow[p].get(sym, 0) + flow[q][sym]
                if sym in out[p]:
                    todo.append((out[p][sym], child))
                else:
                    out[p][sym] = child

    kept, waiting = [0], deque((0, s) for s in sorted(out[0]))
    known = {0}
    while waiting:
        parent, sym = waiting.popleft()
        state = out[parent][sym]
        if state in known:
            continue
        home = next((k for k in kept if compatible(k, state)), None)
        if home is None:
            kept.append(state)
            known.add(state)
            waiting.extend((state, s) for s in sorted(out[state]))
        else:
            out[parent][sym] = home
            fold(home, state)
            waiting.extend((home, s) for s in sorted(out[home]) if out[home][s] not in known)
    edges = []
    for state in kept:
        total = seen[state]
        edges += [(state, sym, nxt, flow[state][sym] / total) for sym, nxt in sorted(out[state].items())]
        if ends[state]:
            edges.append((state, "", -1, ends[state] / total))
    return edges


def log_likelihood(value: str, automaton: dict[tuple[int, str], tuple[int, float]], floor: float = 1e-4) -> float:
    """Bits of the value's format; a step that was never seen costs ``floor`` and stays in its state."""
    state, bits = 0, 0.0
    for sym in [*map(symbol_of, value), ""]:
        nxt, p = automaton.get((state, sym), (state, floor))
        bits += math.log2(max(p, floor))
        state = max(nxt, 0)
    return bits


def _sample(values: DataFrame, n: int) -> DataFrame:
    """At most ``n`` distinct values in hash order."""
    return values.distinct().orderBy(F.md5(F.col("value").cast("binary"))).limit(n)


def learn_formats(scanned: DataFrame, max_credentials: int = MAX_CREDENTIALS, max_ordinary: int = MAX_ORDINARY) -> DataFrame:
    """``kind, state, symbol, next, p``: one automaton per kind of labelled credential and one of ordinary tokens.

    The automata are fitted on at most ``max_credentials`` distinct values of each kind and
    ``max_ordinary`` other tokens, the first in hash order; each kind is fitted in a task of its own.
    """
    labelled = scanned.select(F.explode("base").alias("s")).select("s.kind", "s.value")
    parts = [_sample(labelled.filter(F.col("kind") == k), max_credentials) for k in KINDS]
    ordinary = scanned.select(F.explode("other").alias("s")).select(F.lit("ordinary").alias("kind"), "s.value")
    parts.append(_sample(ordinary, max_ordinary))
    sample = parts[0]
    for part in parts[1:]:
        sample = sample.unionByName(part)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        edges = infer_automaton(group["value"].tolist())
        return pd.DataFrame([(group["kind"].iloc[0], *e) for e in edges], columns=["kind", "state", "symbol", "next", "p"])

    return sample.groupBy("kind").applyInPandas(fit, "kind string, state int, symbol string, next int, p double")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bits: float = MIN_BITS) -> DataFrame:
    """``doc_id, base, added`` per document; both are lists of ``(kind, start, end, value)`` in code points.

    Base spans are the fixed patterns' matches. Every other long token with a digit is scored by the
    automata of the labelled credentials: bits per character above the automaton of ordinary tokens.
    From ``min_bits`` on it is added as kind ``format``. The text is read once; the scan's short
    result is stored and serves both the fit and the scoring.

    A null text is empty and has no spans. Repeated rows get equal rows, an empty table gives none, and
    a corpus without credentials adds nothing.
    """
    scan = F.pandas_udf(_scan, f"base {_SPANS}, other {_SPANS}")
    scanned = materialize(docs.select(F.col(id_col).alias("doc_id"), scan(F.col(text_col)).alias("s")).select("doc_id", "s.*"), "scan")
    automata: dict[str, dict] = {}
    for kind, state, symbol, nxt, p in learn_formats(scanned).collect():  # at most the sample's prefix trees
        automata.setdefault(kind, {})[state, symbol] = (nxt, p)
    ordinary = automata.pop("ordinary", {})

    @F.pandas_udf("array<double>")
    def bits(values: pd.Series) -> pd.Series:
        def one(value: str) -> float:
            best = max(log_likelihood(value, a) for a in automata.values())
            return (best - log_likelihood(value, ordinary)) / len(value)

        return values.map(lambda vs: [one(v) for v in vs])

    if not automata:
        return scanned.select("doc_id", "base", F.slice("other", 1, 0).alias("added"))
    scored = scanned.withColumn("_bits", F.when(F.size("other") > 0, bits(F.transform("other", lambda s: s["value"]))))
    likely = F.filter("other", lambda s, i: F.element_at("_bits", i + 1) >= min_bits)
    return scored.select("doc_id", "base", F.when(F.size("other") > 0, likely).otherwise(F.col("other")).alias("added"))


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def by_place(spans: Column) -> Column:
    """Spans ordered by start, then kind as listed."""
    rank = lambda s: F.when(s["kind"] == "assign", 0).when(s["kind"] == "access", 1).when(s["kind"] == "hex", 2).otherwise(3)
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def secret_report(docs: DataFrame, **options) -> DataFrame:
    """Digest of :func:`find_secrets`: counts per kind, hash of the base spans, and all spans."""
    found = find_secrets(docs, **options)
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[of(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(joined_spans(by_place(F.col("base"))).cast("binary"), 256).alias("base_sha256"),
        joined_spans(by_place(F.concat("base", "added"))).alias("spans"),
    )


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with each span replaced by a mark; overlapping spans become one."""
    out, upto = [], 0
    for start, end in sorted(spans):
        if start >= upto:
            out += [text[upto:start], "[SECRET]"]
        upto = max(upto, end)
    return "".join([*out, text[upto:]])


def expected_digest(text: str | None) -> tuple[int, int, int, str]:
    """The digest of one text by the plain patterns, for tests."""
    spans = []
    for kind, (pattern, group, least) in KINDS.items():
        spans += [(kind, m.start(), m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    spans.sort(key=lambda s: (s[1], ORDER[s[0]]))
    n = [sum(s[0] == k for s in spans) for k in KINDS]
    return (*n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())
