"""Rule and signature tables of any size against texts, by an index of strings that matches must hold.

A regular expression over every text for every rule is the cost of a nested-loop join.
Here ``dialect.required`` derives from each pattern a set of strings of which every match
holds one. One gram of each string, 8, 4 or 2 bytes, goes into a table; a task looks up
all grams of its texts with numpy and gets the strings that a text may hold, then those
that it does hold, and only patterns all of whose strings are there are run. Texts are
looked at without case and with each run of white space as one space, so that words with
``\\s+`` between them make one string. Patterns without a string are run on every text,
which nothing spares.

Rules are taken in blocks of at most ``BLOCK`` distinct patterns, one pass over the texts
each, so that what is sent to the tasks has a bound. What matched is joined with the rule
table by a key made of pattern and exceptions: no nested loop, and rules that share a
pattern share its search.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.dialect import folded, required, strip

GRAMS = (8, 4, 2)
BLOCK = 20_000
#: Bytes of a rule table, as JSON, up to which it is broadcast; larger ones are joined by shuffling.
SENT = 16 << 20
CHUNK = 1 << 20
EVIDENCE = 120
FOUND = "array<struct<rule_key:binary,evidence:string,match_count:int>>"
_FLAGS = re.IGNORECASE | re.DOTALL
_BITS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def key(rules: DataFrame) -> Column:
    """What a rule searches for: its pattern and its exceptions."""
    exceptions = F.coalesce("exceptions", F.array().cast("array<string>")) if "exceptions" in rules.columns else F.array().cast("array<string>")
    return F.unhex(F.sha2(F.to_json(F.struct(F.col("pattern").alias("p"), exceptions.alias("e"))), 256))


def compiled(pattern: str | None) -> re.Pattern | None:
    """The pattern as rules have it, without case and with dots for line ends; null if it doesn't compile."""
    try:
        return None if pattern is None else re.compile(pattern, _FLAGS)
    except (re.error, OverflowError, RecursionError):
        return None


def windows(raw: np.ndarray, q: int) -> np.ndarray:
    """The ``q`` bytes from each place on, as one number."""
    n = len(raw) - q + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(q if n > 0 else 0):
        out |= raw[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return out


@dataclass
class Grams:
    """The grams of one size, each with the strings that it stands for."""

    grams: np.ndarray
    first: np.ndarray
    strings: np.ndarray
    bits: np.ndarray

    @staticmethod
    def of(chosen: list[tuple[int, int]]) -> Grams:
        gram = np.array([g for g, _ in chosen], np.uint64)
        order = np.argsort(gram, kind="stable")
        grams, first = np.unique(gram[order], return_index=True)
        bits = np.zeros(1 << _BITS, bool)
        bits[(grams * _MIX) >> np.uint64(64 - _BITS)] = True
        return Grams(grams, np.append(first, len(chosen)), np.array([s for _, s in chosen])[order], bits)

    def places(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a known gram starts, and which."""
        at = np.flatnonzero(self.bits[(window * _MIX) >> np.uint64(64 - _BITS)])
        gram = np.searchsorted(self.grams, window[at])
        ok = self.grams[np.minimum(gram, len(self.grams) - 1)] == window[at]
        return at[ok], gram[ok]


@dataclass
class Index:
    """A block of rules: patterns by number, the strings that lead to them, and those without one."""

    keys: list[bytes]
    patterns: list[str]
    exceptions: list[list[str]]
    strings: list[bytes] = field(default_factory=list)
    rules_of: list[list[int]] = field(default_factory=list)
    tables: dict[int, Grams] = field(default_factory=dict)
    further: list[list[list[bytes]]] = field(default_factory=list)
    apart: list[int] = field(default_factory=list)
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    @staticmethod
    def of(rows: Iterable[tuple[bytes, str, list[str]]]) -> Index:
        """Patterns that don't compile are left out; they find nothing and stop no other."""
        rows = [r for r in rows if compiled(r[1]) is not None]
        index = Index([k for k, _, _ in rows], [p for _, p, _ in rows], [e for _, _, e in rows])
        led: dict[bytes, list[int]] = {}
        for n, pattern in enumerate(index.patterns):
            sets = [[x.lower().encode() for x in s] for s in required(pattern, True)]
            best = sets[0] if sets else [b""]
            index.further.append(sets[1:4])
            if min(map(len, best)) < GRAMS[-1]:
                index.apart.append(n)
                continue
            for s in set(best):
                led.setdefault(s, []).append(n)
        index.strings, index.rules_of = list(led), list(led.values())
        cuts = [(next(q for q in GRAMS if q <= len(s)), s) for s in index.strings]
        count: dict[int, Counter] = {q: Counter() for q in GRAMS}
        every = [[int.from_bytes(s[k : k + q], "little") for k in range(len(s) - q + 1)] for q, s in cuts]
        for (q, _), grams in zip(cuts, every, strict=True):
            count[q].update(set(grams))
        chosen: dict[int, list[tuple[int, int]]] = {}
        for n, ((q, _), grams) in enumerate(zip(cuts, every, strict=True)):
            # the gram that the fewest other strings have, so that a beginning that rules share isn't it
            chosen.setdefault(q, []).append((min(reversed(grams), key=count[q].__getitem__), n))
        index.tables = {q: Grams.of(c) for q, c in chosen.items()}
        return index

    def held(self, raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
        """``(text, rule)`` where a text holds what the rule needs; ``raw`` is the texts' bytes, text k from ``at[k]`` to ``at[k + 1]``."""
        whole = raw.tobytes()
        for q, table in self.tables.items():
            place, gram = table.places(windows(raw, q))
            text = np.searchsorted(at, place, "right") - 1
            inside = place + q <= at[text + 1]
            pairs = np.unique(text[inside] * len(table.grams) + gram[inside])
            for t, g in zip((pairs // len(table.grams)).tolist(), (pairs % len(table.grams)).tolist(), strict=True):
                for s in table.strings[table.first[g] : table.first[g + 1]].tolist():
                    if whole.find(self.strings[s], at[t], at[t + 1]) >= 0:
                        for n in self.rules_of[s]:
                            if all(any(whole.find(x, at[t], at[t + 1]) >= 0 for x in some) for some in self.further[n]):
                                yield t, n


class Searcher:
    """An index with its patterns compiled when first asked for, once for each worker process."""

    def __init__(self, index: Index) -> None:
        self.index, self.ready = index, {}

    def pattern(self, n: int) -> tuple[re.Pattern, list[re.Pattern]]:
        if n not in self.ready:
            self.ready[n] = compiled(self.index.patterns[n]), [c for e in self.index.exceptions[n] if (c := compiled(e)) is not None]
        return self.ready[n]

    def look(self, n: int, text: str) -> dict | None:
        """Evidence and number of matches; none where an exception is in the text."""
        pattern, vetoes = self.pattern(n)
        first = pattern.search(text)
        if first is None or any(v.search(text) for v in vetoes):
            return None
        part = first[min(1, pattern.groups)] or ""
        return {"rule_key": self.index.keys[n], "evidence": part[:EVIDENCE], "match_count": sum(1 for _ in pattern.finditer(text, first.start()))}

    def matches(self, texts: list[str | None], low: list[str | None]) -> list[list[dict]]:
        rules: list[set[int]] = [set() if t is None else set(self.index.apart) for t in texts]
        raw = [b"" if t is None else f" {' '.join(t.split())} ".encode() for t in low]
        first = 0
        while first < len(raw):
            last, size = first, 0
            while last < len(raw) and (last == first or size + len(raw[last]) <= CHUNK):
                size += len(raw[last])
                last += 1
            at = np.concatenate([[0], np.cumsum([len(x) for x in raw[first:last]])])
            for t, n in self.index.held(np.frombuffer(b"".join(raw[first:last]), np.uint8), at):
                rules[first + t].add(n)
            first = last
        return [[m for n in sorted(own) if (m := self.look(n, text)) is not None] for own, text in zip(rules, texts, strict=True)]


#: Of a worker process: the last block it searched for, with what it compiled, by the block's name.
_last: dict[str, Searcher] = {}


def _searcher(index: Index) -> Searcher:
    if index.name not in _last:
        _last.clear()
        _last[index.name] = Searcher(index)
    return _last[index.name]


def _blocks(rules: DataFrame, size: int) -> Iterator[Index]:
    none = F.array().cast("array<string>")
    exceptions = F.coalesce("exceptions", none) if "exceptions" in rules.columns else none
    rows = rules.filter("pattern is not null").select("rule_key", "pattern", exceptions.alias("exceptions")).dropDuplicates(["rule_key"]).toLocalIterator()
    found = iter((bytes(r[0]), r[1], list(r[2])) for r in rows)
    while block := list(itertools.islice(found, size)):
        yield Index.of(block)


def search(texts: DataFrame, index: Index, column: str, blank: bool = True) -> DataFrame:
    """Adds ``column``, what the rules of one block find in ``text``, to each row; ``blank`` texts can be left out."""
    sent = texts.sparkSession.sparkContext.broadcast(index)
    known = F.col("text") if blank else F.when(strip(F.col("text")) != "", F.col("text"))
    low = column + "_low"
    d = texts.withColumns({column: known, low: folded(known)})
    kept = texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = _searcher(sent.value)
        kind = pa.list_(pa.struct([("rule_key", pa.binary()), ("evidence", pa.string()), ("match_count", pa.int32())]))
        for batch in batches:
            found = searcher.matches(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(found, kind)], [*kept, column])

    from pyspark.sql import types as T

    out = T.StructType([*texts.schema.fields, T.StructField(column, T._parse_datatype_string(FOUND))])
    return d.mapInArrow(run, out)


def _is_small(table: DataFrame, most: int = SENT) -> bool:
    size = table.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(F.lit(1).alias("one"), *[c for c in table.columns if c != "rule_key"])))), F.lit(0))).first()[0]
    return size <= most


def match_rules(texts: DataFrame, rules: DataFrame, blank: bool = False, block: int = BLOCK) -> DataFrame:
    """Every text with every rule that it matches: the columns of both, ``evidence`` and ``match_count``.

    ``rules`` need ``pattern``; where they have ``exceptions``, a text with one of them isn't
    matched. A ``scope`` holds against the texts' ``scan_target``, a ``workspace_id`` against
    theirs, where both tables have them. Column names of the two tables must differ but for
    ``workspace_id``, which is the text's in the result. A null text matches nothing, a blank
    one only if asked for. Repeated rules each match.
    """
    keyed = rules.withColumn("rule_key", key(rules))
    own = [c for c in keyed.columns if c != "workspace_id"]
    if "workspace_id" in rules.columns:
        keyed = keyed.withColumnRenamed("workspace_id", "_rule_workspace")
        own.append("_rule_workspace")
    table = keyed.select(*own)
    table = F.broadcast(table) if _is_small(table) else table
    found = None
    for index in _blocks(keyed, block):
        part = search(texts, index, "_found", blank).select(*texts.columns, F.explode("_found").alias("_m")).select(*texts.columns, "_m.*")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = search(texts, Index.of([]), "_found").select(*texts.columns, F.explode("_found").alias("_m")).select(*texts.columns, "_m.*")
    d = found.join(table, "rule_key")
    if "scope" in rules.columns and "scan_target" in texts.columns:
        d = d.filter(F.col("scope").isin("both") | (F.col("scope") == F.col("scan_target")))
    if "workspace_id" in rules.columns and "workspace_id" in texts.columns:
        ours = F.coalesce(F.nullif("_rule_workspace", F.lit("")), F.lit("global"))
        d = d.filter((ours == "global") | (ours == F.col("workspace_id")))
    return d.drop("rule_key", "_rule_workspace")


def match_signatures(texts: DataFrame, entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """The same for the enabled entries of a threat feed; blank texts are searched too."""
    return match_rules(texts, entries.filter("enabled"), True, block)
