"""Detectors: each turns a text into an array of matches, as built-in expressions only.

A match is one struct for all detectors; an absent match is a null that
``array_compact`` drops, so each detector is one projection without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import catalog
from corvane.functions import constants as C
from corvane.functions.dialect import compiles, count_of, double_sum, first_match, folded, found, ignores_case, java_regex, let, quoted, required, strip, words

MATCH = "struct<match_type:string,description:string,evidence:string,confidence:double,weight:int,ref_id:string,redact:boolean,match_count:int>"


def match(kind, description, evidence: Column, confidence, weight, ref=None, redact=None, count=None) -> Column:
    lit = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(
        lit(kind, "string").alias("match_type"),
        lit(description, "string").alias("description"),
        evidence.alias("evidence"),
        lit(confidence, "double").alias("confidence"),
        lit(weight, "int").alias("weight"),
        lit(ref, "string").alias("ref_id"),
        lit(False if redact is None else redact, "boolean").alias("redact"),
        lit(1 if count is None else count, "int").alias("match_count"),
    )


def gathered(parts: Sequence[Column]) -> Column:
    """The matches that are there; none for a null text."""
    return F.coalesce(F.array_compact(F.array(*parts)), F.array().cast(f"array<{MATCH}>")).cast(f"array<{MATCH}>")


_FIELDS = ("match_type", "description", "evidence", "confidence", "weight", "ref_id", "redact", "match_count")


def _match_sql(kind: str, description: str, evidence: str, confidence: float, weight: int) -> str:
    values = (quoted(kind), quoted(description), evidence, f"{confidence}D", str(weight), "CAST(NULL AS STRING)", "false", "1")
    return "named_struct(" + ", ".join(f"'{f}', {v}" for f, v in zip(_FIELDS, values, strict=True)) + ")"


BASE64_RUN = r"(?:[A-Za-z0-9+/]{4}){10,}"


def _guard_sql(name: str, pattern: str, flags: str) -> str:
    """Conjuncts that any match fulfils: strings that the column, folded where case is ignored, must hold,
    or a run of its characters, listed, where a pattern starts with a run of the Base64 alphabet."""
    low = "i" in flags or ignores_case(pattern)
    column = f"{name}_folded" if low else name
    sets = [sorted({x.lower() if low else x for x in s}) for s in required(pattern)[:2]]
    run = f"{column} RLIKE {quoted(java_regex('[A-Za-z0-9+/]{40}'))} AND " if pattern.startswith(BASE64_RUN) else ""
    return run + "".join("(" + " OR ".join(f"contains({column}, {quoted(x)})" for x in s) + ") AND " for s in sets)


def _needs_sql(name: str, pattern: str, flags: str) -> str:
    """All that a match of the pattern needs to be in the column, as ``_guard_sql`` has the first of it."""
    low = "i" in flags or ignores_case(pattern)
    column = f"{name}_folded" if low else name
    sets = [sorted({x.lower() if low else x for x in s}) for s in required(pattern)]
    return " AND ".join("(" + " OR ".join(f"contains({column}, {quoted(x)})" for x in s) + ")" for s in sets) or "true"


def may_find(name: str, signatures: Sequence[Signature]) -> Column:
    """Whether the cheap detectors could find anything but context flooding, measures of weight 2 or less and
    random credentials in column ``name`` or in any beginning of it.

    What is asked holds for a text if it holds for one of its beginnings: strings that a pattern
    needs, and counts that only grow. Of words the last one of a beginning may be cut, which makes
    one more of a kind at most. Needs ``with_folded``.
    """
    text, lim = F.col(name), C.ABUSE
    digit = f"{name} RLIKE '\\\\p{{Nd}}'"
    needs = [_needs_sql(name, p, _pii_flags(d)) + ("" if k in NO_DIGIT else f" AND {digit}") for k, p, d, _ in catalog.PII]
    needs += [_needs_sql(name, p, "") for _, p, _, _ in C.SECRETS]
    needs += [_needs_sql(name, p, "im" if k == "sql_injection" else "i") for k, v in catalog.ABUSE_PATTERNS.items() for p, _ in v]
    needs += [_needs_sql(name, s.pattern, "is") for s in signatures if s.enabled]
    said = F.expr(" OR ".join(f"({n})" for n in dict.fromkeys(needs)))
    w = F.transform(words(F.lower(text)), lambda x: F.xxhash64(x))
    counts = (
        (F.length(text) > lim["length"])
        | text.rlike(r"(?s)(.)\1{%d}" % (lim["char_run"] - 1))
        | let(w, lambda h: has_repeated(h, lim["word"] - 1) | has_repeated(hashed_phrases(h), lim["phrase"] - 1))
        | (F.instr(text, "\x00") > 0)
        | (F.regexp_count(text, F.lit(r"https?://\S+")) > lim["urls"])
        | (nesting_depth(text) > lim["nesting"])
        | (members(text, C.HOMOGLYPHS) >= lim["homoglyphs"])
        | (members(text, C.INVISIBLE) >= lim["invisible"])
        | (F.regexp_count(text, F.lit(r"%[0-9]*[nspxdoufFeEgGaAcS]")) >= lim["formats"])
    )
    return F.coalesce(said | counts, F.lit(True))


def with_folded(d: DataFrame, *names: str) -> DataFrame:
    """Adds ``<name>_folded``, which the pattern searches over column ``name`` ask first."""
    return d.withColumns({f"{n}_folded": folded(F.col(n)) for n in names})


def _search_sql(name: str, kind: str, pattern: str, description: str, confidence: float, weight: int, flags: str, limit: int) -> str:
    """First match of a pattern in column ``name``. Catalogue patterns become one parsed expression:
    thousands of single calls would cost more than the scan of a small table."""
    p = quoted(java_regex(pattern, flags))
    return f"CASE WHEN {_guard_sql(name, pattern, flags)}{name} RLIKE {p} THEN {_match_sql(kind, description, f'substring(regexp_extract({name}, {p}, 0), 1, {limit})', confidence, weight)} END"


def _gathered_sql(parts: Sequence[str]) -> Column:
    return F.expr(f"CAST(coalesce(array_compact(array({', '.join(parts)})), array()) AS array<{MATCH}>)")


def flooding(text: Column, limit: int = 4000) -> Column:
    n = F.length(text)
    said = F.format_string(f"Length: %d chars, limit: {limit}", n)
    return gathered([F.when(n > limit, match("context_flooding", "Input exceeds maximum allowed length for DoS protection", said, 1.0, 4))])


def _pii_flags(description: str) -> str:
    return "is" if "context" in description.lower() else "s"


def pii_confidence(kind: str) -> float:
    return next((c for c, kinds in C.PII_CONFIDENCE.items() if kind in kinds), C.PII_OTHER_CONFIDENCE)


def _group(pattern: str) -> int:
    """1 if the pattern captures something, as findall has it."""
    import re

    return min(1, re.compile(pattern).groups)


#: Kinds that a text without any digit may still have; the others are skipped for such texts.
NO_DIGIT = ("email", "upi_id", "account_number", "mac_address", "ipv6", "blood_group", "gender", "name_with_title", "religion", "caste")


def pii(name: str) -> Column:
    """All patterns in catalogue order over the whole of column ``name``; of equal values (but for case) the first stays."""
    with_digit, without = [], []
    for k, (kind, pattern, description, _) in enumerate(catalog.PII):
        weight = 4 if kind in C.PII_CRITICAL else 3 if kind in C.PII_HIGH else 1
        value = r"regexp_replace(v, '(?U)^\\s+|\\s+$', '')"
        flags = _pii_flags(description)
        found_ = f"regexp_extract_all({name}, {quoted(java_regex(pattern, flags))}, {_group(pattern)})"
        guard = _guard_sql(name, pattern, flags)
        found_ = f"CASE WHEN {guard[:-5]} THEN {found_} ELSE array() END" if guard else found_
        (without if kind in NO_DIGIT else with_digit).append(f"transform({found_}, (v, j) -> named_struct('key', lower({value}), 'at', {k << 20} + j, 'm', {_match_sql(kind, description, value, pii_confidence(kind), weight)}))")
    digits = f"CASE WHEN {name} RLIKE '\\\\p{{Nd}}' THEN flatten(array({', '.join(with_digit)})) ELSE array() END"
    every = F.expr(f"concat({digits}, flatten(array({', '.join(without)})))")
    sorted_ = F.sort_array(F.filter(every, lambda x: x["key"] != ""))
    # a value's first occurrence comes first among its equals
    firsts = F.aggregate(
        sorted_,
        F.struct(F.lit(None).cast("string").alias("last"), F.array().cast(f"array<struct<at:int,m:{MATCH}>>").alias("out")),
        lambda acc, x: F.struct(x["key"].alias("last"), F.when(acc["last"].eqNullSafe(x["key"]), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(x["at"].alias("at"), x["m"].alias("m"))))).alias("out")),
        lambda acc: acc["out"],
    )
    none = F.array().cast(f"array<{MATCH}>")
    return F.coalesce(F.transform(F.sort_array(firsts), lambda x: x["m"]), none).cast(f"array<{MATCH}>")


def secrets(name: str) -> Column:
    text = F.col(name)
    known = _gathered_sql([_search_sql(name, kind, p, f"Possible {kind.replace('_', ' ')}", c, w, "", 80) for kind, p, w, c in C.SECRETS])
    token = F.filter(F.regexp_extract_all(text, F.lit(java_regex("[A-Za-z0-9+/_=-]{20,}")), F.lit(0)), lambda t: (entropy(t) >= 4.5) & t.rlike("[0-9]") & t.rlike("[a-z]") & t.rlike("[A-Z]"))
    random = F.when(F.size(token) > 0, match("high_entropy", "Possible random credential", F.substring(F.get(token, F.lit(0)), 1, 80), 0.6, 1))
    return F.concat(known, gathered([random]))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits over code points: one sort, then the lengths of the runs of equal ones."""
    ordered = F.array_join(F.sort_array(F.split(text, "")), "")
    runs = F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1*"), F.lit(0))

    def within(n: Column) -> Column:
        share = F.transform(runs, lambda run: F.length(run) / n)
        return F.when(n > 0, double_sum(F.transform(share, lambda p: -p * F.log2(p)))).otherwise(0.0)

    return let(F.length(text).cast("double"), within)


def may_be_below(text: Column, bits: float) -> Column:
    """Whether the entropy of a text could be below ``bits``: it is never less than that of a few
    groups of frequent characters with all others taken for one, for which nothing is sorted."""

    def taken(rest: Column, groups: Sequence[str], sizes: list[Column]) -> Column:
        sizes = [*sizes, F.length(rest)]
        if groups:
            return let(F.regexp_replace(rest, f"[{groups[0]}]+", ""), lambda r: taken(r, groups[1:], sizes))
        shares = F.transform(F.array(*[a - b for a, b in zip(sizes, sizes[1:])], sizes[-1]), lambda k: k / F.greatest(sizes[0], F.lit(1)))
        return double_sum(F.transform(shares, lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(0.0))) < bits + 1e-6

    return taken(text, _FREQUENT, [])


_FREQUENT = (" ", "e", "ao", "in", "tr", "sl", "dhu")


def most_frequent(items: Column) -> Column:
    """``n`` and ``item`` of the most frequent item; of equals the one that comes first."""

    def counted(own: Column, ordered: Column, cuts: Column) -> Column:
        runs = F.transform(cuts, lambda i, k: F.struct((F.coalesce(F.get(cuts, k + 1), F.size(own)) - i).alias("n"), F.get(ordered, i).alias("item")))

        def first(all_runs: Column, most: Column) -> Column:
            ties = F.filter(all_runs, lambda r: r["n"] == most)
            return F.array_min(F.transform(ties, lambda r: F.struct(F.array_position(own, r["item"]).alias("at"), r["n"].alias("n"), r["item"].alias("item"))))

        return let(runs, lambda all_runs: let(F.array_max(F.transform(all_runs, lambda r: r["n"])), lambda most: first(all_runs, most)))

    def cut(own: Column, ordered: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return let(starts, lambda cuts: counted(own, ordered, cuts))

    return let(items, lambda own: F.when(F.size(own) > 0, let(F.sort_array(own), lambda ordered: cut(own, ordered))))


def has_repeated(items: Column, times: int) -> Column:
    """Whether some item stands ``times`` times or more; one sort, no counting."""

    def within(ordered: Column) -> Column:
        last = F.size(ordered) - times
        return F.when(last >= 0, F.exists(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.get(ordered, i) == F.get(ordered, i + times - 1))).otherwise(False)

    return let(F.sort_array(items), within)


def phrases(items: Column, n: int = 3) -> Column:
    """Runs of ``n`` items joined by spaces."""

    def within(w: Column) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>"))

    return let(items, within)


def hashed_phrases(hashes: Column, n: int = 3) -> Column:
    """Hashes of runs of ``n`` hashed items: numbers sort far faster than strings."""
    runs = F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)]))
    return F.when(F.size(hashes) >= n, runs).otherwise(F.array().cast("array<bigint>"))


def longest_run(text: Column, least: int) -> Column:
    """Longest run of one character among runs of ``least`` or more, else 0."""
    runs = F.regexp_extract_all(text, F.lit(r"(?s)(.)\1{%d,}" % (least - 1)), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0))


def nesting_depth(text: Column) -> Column:
    """Greatest bracket depth; any closer closes any opener, never below zero."""
    brackets = F.split(F.regexp_replace(text, r"[^()\[\]{}]+", ""), "")
    step = lambda c: F.when(c.isin("(", "[", "{"), 1).when(c == "", 0).otherwise(-1)
    return F.aggregate(
        brackets,
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")),
        lambda a, c: F.struct(F.greatest(a["d"] + step(c), F.lit(0)).alias("d"), F.greatest(a["m"], a["d"] + step(c)).alias("m")),
        lambda a: a["m"],
    )


def special_ratio(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)[\p{L}\p{N}\s]+", "")) / F.length(text)


#: What Python's isdigit takes for a digit.
DIGITS = r"\p{Nd}\u00b2\u00b3\u00b9\u2070\u2074-\u2079\u2080-\u2089"


def digit_ratio(text: Column) -> Column:
    return count_of(text, DIGITS) / F.length(text)


def letters(text: Column) -> Column:
    return count_of(text, r"\p{L}")


def upper_ratio(text: Column) -> Column:
    return count_of(text, r"\p{Lu}") / letters(text)


def kinds(text: Column) -> Column:
    """``special``, ``digits``, ``letters`` and ``upper``: how many code points of a text are in the classes of the
    ratios above. ASCII letters, digits and white space go first, by classes that list their characters
    (Java finds those in one look); the Unicode classes are searched in what is left."""
    left = lambda t, x: F.regexp_replace(t, java_regex(f"[{x}]+"), "")
    less = lambda a, b: F.octet_length(a) - F.octet_length(b)

    def count(no_letters: Column, no_digits: Column, rest: Column) -> Column:
        other = is_ascii(rest)
        return F.struct(
            F.length(F.regexp_replace(rest, r"(?U)[\p{L}\p{N}\s]+", "")).alias("special"),
            (less(no_letters, no_digits) + F.when(other, 0).otherwise(count_of(rest, DIGITS))).alias("digits"),
            (less(text, no_letters) + F.when(other, 0).otherwise(letters(rest))).alias("letters"),
            (less(text, left(text, "A-Z")) + F.when(other, 0).otherwise(count_of(rest, r"\p{Lu}"))).alias("upper"),
        )

    return let(left(text, "A-Za-z"), lambda a: let(left(a, "0-9"), lambda b: let(left(b, r"\t-\r "), lambda c: count(a, b, c))))


def is_ascii(text: Column) -> Column:
    """Whether no code point takes more than one byte: a look at two lengths, no search."""
    return F.octet_length(text) == F.length(text)


def members(text: Column, characters: str) -> Column:
    """How many code points of a text are among a few given ones, none of them ASCII."""
    return F.when(is_ascii(text), 0).otherwise(F.length(text) - F.length(F.translate(text, characters, "")))


def abuse(name: str) -> Column:
    """The measures of column ``name`` in order, then the pattern families."""
    text = F.col(name)
    n = F.length(text)
    lim = C.ABUSE
    w = words(F.lower(text))
    say = F.format_string
    share = lambda name, x, most: F.concat(say(f"{name}: %.1f%%", x * 100), F.lit(f", threshold: {most:.1%}"))
    newlines = F.octet_length(text) - F.octet_length(F.replace(F.replace(text, F.lit("\n")), F.lit("\r")))
    urls, depth = F.regexp_count(text, F.lit(r"https?://\S+")), nesting_depth(text)
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(F.length(x).alias("n"), (i + 1).alias("i"))), lambda x: x["n"] > lim["line"])
    formats = F.regexp_extract_all(text, F.lit(r"%[0-9]*[nspxdoufFeEgGaAcS]"), F.lit(0))
    size = lambda most: say(f"Length: %d chars (~%d tokens), limit: {most}", n, F.floor(n / 4))
    longest = F.regexp_extract_all(text, F.lit(r"(?s)(.)\1{%d,}" % (lim["char_run"] - 1)), F.lit(0))
    most_run = let(longest, lambda runs: F.get(F.filter(runs, lambda r: F.length(r) == F.array_max(F.transform(runs, lambda x: F.length(x)))), F.lit(0)))
    repeated = lambda kind, items: let(most_frequent(items), lambda t: say(f"{kind} '%s' repeated %d times", t["item"], t["n"]))
    first = [
        F.when(n > lim["critical_length"], match("critical_length_overflow", "Input exceeds critical length threshold", size(lim["critical_length"]), 1.0, 4)).when(
            n > lim["length"], match("excessive_length", "Input exceeds maximum allowed length", size(lim["length"]), 1.0, 3)
        ),
        F.when(F.floor(n / 4) > lim["tokens"], match("token_inflation", "Estimated token count exceeds safe limit (API cost attack)", say(f"~%d tokens estimated, limit: {lim['tokens']}", F.floor(n / 4)), 1.0, 3)),
        F.when(
            (n >= lim["char_run"]) & text.rlike(r"(?s)(.)\1{%d}" % (lim["char_run"] - 1)),
            match("char_repetition_attack", "Single character repeated excessively (DoS pattern)", let(most_run, lambda r: say("Char '%s' repeated %d times consecutively", F.substring(r, 1, 1), F.length(r))), 1.0, 3),
        ),
    ]
    repeats = [
        lambda h: F.when(has_repeated(h, lim["word"]), match("word_repetition_attack", "Same word repeated excessively (padding/inflation attack)", repeated("Word", w), 1.0, 3)),
        lambda h: F.when((F.size(h) >= lim["phrase"] + 2) & has_repeated(hashed_phrases(h), lim["phrase"]), match("phrase_repetition_attack", "Repeated phrase detected (prompt stuffing attack)", repeated("Phrase", phrases(w)), 1.0, 3)),
    ]
    # the words are split and hashed once for both; the first word of a phrase is as frequent as the phrase
    none = gathered([F.lit(None).cast(MATCH)])
    often = min(lim["word"], lim["phrase"])
    both = F.when(n >= 2 * min(lim["word"], lim["phrase"] + 2) - 1, let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.when(has_repeated(h, often), gathered([r(h) for r in repeats])).otherwise(none))).otherwise(none)
    later_measures = lambda k: [
        F.when((n >= 50) & may_be_below(text, lim["entropy"]) & (entropy(text) < lim["entropy"]), match("low_entropy_input", "Extremely low entropy — highly repetitive/uniform content", say(f"Shannon entropy: %.3f bits (threshold: {lim['entropy']})", entropy(text)), 1.0, 2)),
        F.when((n >= 20) & (k["special"] / n > lim["special"]), match("special_char_flood", "Abnormally high ratio of special characters", share("Special char ratio", k["special"] / n, lim["special"]), 1.0, 2)),
        F.when((n >= 20) & (k["digits"] / n > lim["digits"]), match("digit_flood", "Abnormally high ratio of digits (possible data exfiltration or obfuscation)", share("Digit ratio", k["digits"] / n, lim["digits"]), 1.0, 2)),
        F.when((k["letters"] >= 20) & (k["upper"] / k["letters"] > lim["upper"]), match("uppercase_flood", "Abnormally high uppercase ratio (screaming/obfuscation attempt)", share("Uppercase ratio", k["upper"] / k["letters"], lim["upper"]), 1.0, 1)),
        F.when(F.instr(text, "\x00") > 0, match("null_byte_injection", "Null bytes detected (possible injection or evasion attempt)", say("Found %d null byte(s)", count_of(text, r"\x00")), 1.0, 4)),
        F.when(newlines > lim["newlines"], match("newline_flood", "Excessive newlines detected (log poisoning or padding attack)", say(f"Found %d newlines, limit: {lim['newlines']}", newlines), 1.0, 2)),
        F.when(
            F.size(lines) > 0,
            match("excessive_line_length", "One or more lines exceed maximum allowed length", F.concat(F.lit("Long lines at positions: ["), F.array_join(F.slice(F.transform(lines, lambda x: x["i"].cast("string")), 1, 5), ", "), F.lit("] (showing first 5)")), 1.0, 2),
        ),
        F.when(urls > lim["urls"], match("url_flood", "Excessive number of URLs (SSRF harvesting or spam)", say(f"Found %d URLs, limit: {lim['urls']}", urls), 1.0, 3)),
        F.when(depth > lim["nesting"], match("deeply_nested_structure", "Deeply nested brackets/braces (ReDoS or parser bomb attempt)", say(f"Max nesting depth: %d, limit: {lim['nesting']}", depth), 1.0, 3)),
        F.when(members(text, C.HOMOGLYPHS) >= lim["homoglyphs"], match("homoglyph_attack", "Unicode homoglyphs/lookalike characters detected (filter evasion)", say("Found %d homoglyph character(s)", members(text, C.HOMOGLYPHS)), 1.0, 3)),
        F.when(members(text, C.INVISIBLE) >= lim["invisible"], match("invisible_char_injection", "Invisible/zero-width characters detected (prompt evasion or steganography)", say("Found %d invisible character(s)", members(text, C.INVISIBLE)), 1.0, 3)),
    ]
    families, later = [], []
    for kind, patterns in catalog.ABUSE_PATTERNS.items():
        flags = "im" if kind == "sql_injection" else "i"
        one = [_search_sql(name, kind, p, d, 1.0, catalog.ABUSE_PATTERN_WEIGHTS[kind], flags, 80) for p, d in patterns]
        (families if kind in ("script_injection", "path_traversal", "encoding_obfuscation") else later).extend([f"coalesce({', '.join(one)})"] if kind == "path_traversal" else one)
    printf = F.when(F.size(formats) >= lim["formats"], match("format_string_attack", "Multiple format string specifiers detected", F.concat(F.lit("Found: ['"), F.array_join(F.slice(formats, 1, 5), "', '"), F.lit("']")), 1.0, 3))
    return F.concat(gathered(first), both, let(kinds(text), lambda k: gathered(later_measures(k))), _gathered_sql(families), gathered([printf]), _gathered_sql(later))


def normalised(text: Column) -> Column:
    """Escaped white space becomes spaces, zero-width characters go, NUL becomes a space."""
    for pattern, by in ((r"(?i)\\x(?:20|09|0a|0d)", " "), (r"(?i)\\u(?:0020|0009|000a|000d)", " "), ("[\u200b\u200c\u200d\ufeff]", ""), ("\x00", " ")):
        if pattern.startswith("(?i)"):
            text = F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, pattern, by)).otherwise(text)
        else:
            text = F.regexp_replace(text, pattern, by)
    return text


def injection(name: str) -> Column:
    """Over column ``name``, which ``normalised`` has made."""
    return _gathered_sql([_search_sql(name, kind, p, d, 0.85, w, "is", 100) for kind, p, d, w in catalog.INJECTION])


def unsafe(name: str) -> Column:
    return _gathered_sql([_search_sql(name, kind, p, d, 0.8, w, "is", 100) for kind, p, d, w in catalog.UNSAFE])


@dataclass(frozen=True)
class Signature:
    """An entry of the threat feed."""

    id: str
    name: str
    pattern: str
    category: str
    severity: str
    scope: str = "both"
    enabled: bool = True


SEED_SIGNATURES = tuple(Signature(*x) for x in C.INTEL)


def intel(text: Column, target: Column, entries: Sequence[Signature] = SEED_SIGNATURES) -> Column:
    parts = []
    for e in entries:
        if e.enabled and compiles(e.pattern):
            weight = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}.get(e.severity.upper(), 3)
            here = F.lit(e.scope == "both") | (target == e.scope)
            parts.append(F.when(here & found(text, e.pattern), match(e.category, e.name, first_match(text, e.pattern, limit=120), 0.93, weight, e.id)))
    return gathered(parts or [F.lit(None).cast(MATCH)])


@dataclass(frozen=True)
class Rule:
    """A user's rule; ``exceptions`` veto it for the whole text."""

    id: str
    name: str
    pattern: str
    severity: str = "LOW"
    threat_type: str = "CUSTOM_RULE"
    scope: str = "both"
    redact: bool = False
    exceptions: tuple[str, ...] = ()
    workspace: str = "global"
    enabled: bool = True
    draft: bool = False
    description: str = ""


def active(rule: Rule, target: Column, workspace: Column) -> Column:
    """In force: enabled, no draft, scope for the target, workspace global or the text's own."""
    if not rule.enabled or rule.draft:
        return F.lit(False)
    return (F.lit(rule.scope == "both") | (target == rule.scope)) & (F.lit(rule.workspace == "global") | (workspace == rule.workspace))


def excepted(rule: Rule, text: Column) -> Column:
    out = F.lit(False)
    for e in rule.exceptions:
        if compiles(e, "is"):
            out = out | found(text, e)
    return out


def custom_rules(text: Column, target: Column, workspace: Column, rules: Sequence[Rule] = ()) -> Column:
    parts = []
    for r in rules:
        if not compiles(r.pattern, "is"):  # a rule that can't be read finds nothing and stops no other
            continue
        weight = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}.get(r.severity.upper(), 1)
        pattern = java_regex(r.pattern, "is")
        every = F.regexp_extract_all(text, F.lit(pattern), F.lit(_group(r.pattern)))
        evidence = F.substring(F.get(every, F.lit(0)), 1, 120)
        base = {4: 0.95, 3: 0.88, 2: 0.8, 1: 0.72}[weight]
        sure = F.when(F.length(evidence) >= 24, F.lit(min(0.98, round(base + 0.03, 2)))).otherwise(F.lit(base))
        hit = active(r, target, workspace) & (strip(text) != "") & text.rlike(pattern) & ~excepted(r, text)
        parts.append(F.when(hit, match(r.threat_type.upper(), r.description or r.name, evidence, sure, weight, r.id, r.redact, F.size(every))))
    return gathered(parts or [F.lit(None).cast(MATCH)])


def redact_pii(text: Column) -> Column:
    """All patterns in order over the text as redacted so far."""
    for _, pattern, description, label in catalog.PII:
        text = F.regexp_replace(text, java_regex(pattern, _pii_flags(description)), label)
    return text


def redact_secrets(text: Column) -> Column:
    for kind, pattern, _, _ in C.SECRETS:
        text = F.regexp_replace(text, java_regex(pattern), "[API_KEY]" if "key" in kind else "[SECRET]")
    return text


def _redaction(rule: Rule, label: str, target: Column, workspace: Column):
    return lambda t: F.when(active(rule, target, workspace) & ~excepted(rule, t), F.regexp_replace(t, java_regex(rule.pattern, "is"), label)).otherwise(t)


def redact_rules(text: Column, target: Column, workspace: Column, rules: Sequence[Rule] = ()) -> Column:
    import re

    for r in rules:
        if r.redact and compiles(r.pattern, "is"):
            label = re.sub(r"[^A-Z0-9]+", "_", r.threat_type.upper()).strip("_") or "CUSTOM_RULE"
            # bound by a one-element array, so that the text so far is computed once for each rule
            step = _redaction(r, f"[{label}]", target, workspace)
            text = F.get(F.transform(F.array(text), step), F.lit(0))
    return text
