"""Columns over report and answer texts. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import taxonomy as tx


def literal(values) -> Column:
    return F.expr(f"cast(array({', '.join(quoted(v) for v in values)}) AS array<string>)")


def cleaned(c) -> Column:
    return F.trim(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")))


def report_text(findings, impression) -> Column:
    """Findings and impression in one text."""
    return F.trim(F.concat_ws(" ", cleaned(findings), cleaned(impression)))


def sentences(text: Column) -> Column:
    """Sentences, cut after full stop or semicolon, white space made single."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.filter(F.transform(F.split(flat, r"(?<=[.;])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def scrubbed_share(text: Column) -> Column:
    """Share of a text's words that hold the scrubbing mark XXXX; 0 without words."""
    words = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: w.contains("XXXX"))) / F.size(words)).otherwise(F.lit(0.0))


def quoted(value: str) -> str:
    """A SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: Column, f) -> Column:
    """f(value) with value computed once, however often f uses it. f: of a Column, or SQL as 'x -> ...'.

    Expressions with a part for each class are SQL texts: one call instead of hundreds to build them.
    """
    if isinstance(f, str):
        return F.get(F.call_function("transform", F.array(value), F.expr(f)), F.lit(0))
    return F.get(F.transform(F.array(value), f), F.lit(0))


def let_sql(name: str, value: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def first_at(text: Column, pattern: str) -> Column:
    """Where the pattern first matches, from 1; 0 if nowhere."""
    return F.regexp_instr(text, F.lit(pattern))


def class_ranks(sentence_array: Column, patterns: dict[str, str] | None = None, negation: str = tx.NEGATION, hedge: str = tx.HEDGE, denied: str = tx.DENIED_AFTER) -> Column:
    """Array of (class, rank), the highest rank of each class over the sentences: 3 affirmed, 2 uncertain, 1 denied, 0 not mentioned.

    A cue counts if it begins before the class's first mention in the sentence; a denial counts also right after it, a hedge
    anywhere after it. Cues are looked for once in a sentence, not once for each class.
    """
    hedged = f"m.maybe > 0 AND (m.maybe < at OR rlike(substr(m.s, at), {quoted(hedge)}))"
    negated = f"(m.no > 0 AND m.no < at) OR rlike(substr(m.s, at), {quoted(f'(?i)^(?:{denied})')})"
    rank = f"CASE WHEN at = 0 THEN 0 WHEN {hedged} THEN 2 WHEN {negated} THEN 1 ELSE 3 END"
    each = (f"named_struct('class', {quoted(c)}, 'rank', coalesce(array_max(transform(ms, m -> {let_sql('at', f'regexp_instr(m.s, {quoted(p)})', rank)})), 0))" for c, p in (patterns or tx.PATTERNS).items())
    marks = f"transform(ss, s -> named_struct('s', s, 'no', regexp_instr(s, {quoted(negation)}), 'maybe', regexp_instr(s, {quoted(hedge)})))"
    return let(sentence_array, f"ss -> {let_sql('ms', marks, f'array({", ".join(each)})')}")


def classes_with(ranks: Column, rank: int) -> Column:
    return F.transform(F.filter(ranks, lambda r: r["rank"] == rank), lambda r: r["class"])


def _matching(text: str, patterns: dict[str, str]) -> str:
    return f"array_compact(array({', '.join(f'CASE WHEN rlike({text}, {quoted(p)}) THEN {quoted(c)} END' for c, p in patterns.items())}))"


def matching(text: Column, patterns: dict[str, str] | None = None) -> Column:
    """Classes whose pattern the text matches, in class order."""
    return let(text, f"t -> {_matching('t', patterns or tx.PATTERNS)}")


def _answer(text: str, negation: bool, patterns: dict[str, str]) -> str:
    # Clauses are parted by two marks, which no pattern crosses, and end before their first negation.
    clauses = f"regexp_replace(lower({text}), {quoted(f'(?i){tx.CLAUSE_END}')}, '\u0001\u0001')"
    said = f"regexp_replace({clauses}, {quoted(tx.NEGATION + '[^\u0001]*')}, '')" if negation else text
    chosen = f"CASE WHEN size(h) > 0 THEN h WHEN rlike({text}, {quoted(f'(?i){tx.NORMAL_ANSWER}')}) THEN array('No Finding') ELSE cast(array() AS array<string>) END"
    return let_sql("h", let_sql("a", said, _matching("a", patterns)), chosen)


def answer_classes(text: Column, negation: bool = True, patterns: dict[str, str] | None = None) -> Column:
    """Classes of a free-text diagnosis, in class order: those that a clause names before its first negation; {No Finding} for a normal one, nothing for blank text."""
    return let(F.coalesce(text, F.lit("")), f"t -> {_answer('t', negation, patterns or tx.PATTERNS)}")


def answers_classes(texts: Column, negation: bool = True, patterns: dict[str, str] | None = None) -> Column:
    """answer_classes of each of an array of texts, in one set."""
    each = F.call_function("transform", F.transform(texts, lambda t: F.coalesce(t, F.lit(""))), F.expr(f"t -> {_answer('t', negation, patterns or tx.PATTERNS)}"))
    return F.array_distinct(F.flatten(each))


def findings_of(classes: Column) -> Column:
    """Without No Finding."""
    return F.filter(classes, lambda c: c != "No Finding")
