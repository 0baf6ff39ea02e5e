"""License detection by ordered signature rules.

A text becomes its words; a rule is a regular expression over them. One pass of a keyword automaton
says which rules can match at all. Where detections overlap, a rule of higher priority keeps its place
and what lies inside it goes: names inside notices, families inside versions, anything inside a denial.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_rules import PHRASES, RULES
from .scratch import bound_batches

# What separates words once A-Z are lower-cased.
_BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
NAME = 4  # priority of a plain name, as the phrases are


@dataclass(frozen=True)
class Rule:
    """``keyword`` stands in every text that ``pattern`` matches; ``{v}`` in a label is the pattern's version; no label denies."""

    priority: int
    label: str
    score: float
    keyword: str
    pattern: str
    always: bool = False


def parsed(text: str) -> list[Rule]:
    """Rules from lines ``priority label score keyword | pattern``; ``-`` is no label, ``_`` a space in a keyword."""
    rules = []
    for line in filter(None, (x.strip() for x in text.splitlines())):
        if line.startswith("#"):
            continue
        head, pattern = line.split(" | ", 1)
        priority, label, score, keyword = head.split()
        rules.append(Rule(int(priority), "" if label == "-" else label, float(score), keyword.replace("_", " "), pattern.strip()))
    return rules


def signature_rules() -> list[Rule]:
    """The library's phrases and rules, in their order."""
    return [Rule(NAME, label, 0.7, phrase, re.escape(phrase), True) for phrase, label in PHRASES] + parsed(RULES)


def words(text: str | None) -> str:
    """A text's words between single spaces, one at either end; one space if it has none."""
    return f" {_BETWEEN.sub(' ', (text or '').translate(_LOWER)).strip(' ')} ".replace("  ", " ")


@dataclass(frozen=True)
class Detection:
    label: str
    priority: int
    rule: int
    first_word: int
    last_word: int
    score: float
    always: bool


class Scanner:
    """Rules compiled once per task."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.patterns = [re.compile(f"(?<= )(?:{r.pattern})(?= )") for r in rules]
        gate: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            gate.setdefault(f" {r.keyword} ", []).append(i)
        self.gate = ahocorasick.Automaton()
        for keyword, of in gate.items():
            self.gate.add_word(keyword, of)
        self.gate.make_automaton()

    def candidates(self, text: str) -> list[int]:
        """Rules whose keyword the text holds, in order."""
        return sorted({i for _, of in self.gate.iter(text) for i in of})

    def matches(self, text: str, i: int):
        """(start, end) and version of every match; phrases may overlap."""
        at, pattern = 0, self.patterns[i]
        while found := pattern.search(text, at):
            version = re.sub(r"(?<=[0-9]) (?=[0-9])", ".", found.groupdict().get("v") or "").replace(" ", "-")
            yield found.start(), found.end(), version
            at = found.start() + 1 if self.rules[i].always else max(found.end(), found.start() + 1)

    def scan(self, text: str) -> list[Detection]:
        """What is left of all detections in ``words`` of a text, by place."""
        found, spaces = [], None
        for i in self.candidates(text):
            rule = self.rules[i]
            for start, end, version in self.matches(text, i):
                spaces = spaces or [m.start() for m in re.finditer(" ", text)]
                first, last = bisect_left(spaces, start) - 1, bisect_left(spaces, end) - 1
                label = rule.label.replace("{v}", version).rstrip("-")
                found.append(Detection(label, rule.priority, i, first, last, rule.score, rule.always))
        return sorted(resolved(found), key=lambda d: (d.first_word, d.last_word, d.rule))


def resolved(found: list[Detection]) -> list[Detection]:
    """Detections, best first, but for those that lie inside one kept before them; phrases always stay."""
    kept, starts, ends = [], [], []  # the outermost intervals kept so far: both starts and ends rise
    for d in sorted(found, key=lambda d: (d.priority, d.first_word - d.last_word, d.rule, d.first_word)):
        at = bisect_right(starts, d.first_word)
        inside = at and ends[at - 1] >= d.last_word
        if not inside or d.always:
            kept.append(d)
        if not inside:
            low, high = bisect_left(starts, d.first_word), bisect_right(ends, d.last_word)
            starts[low:high], ends[low:high] = [d.first_word], [d.last_word]
    return kept


def certainty(found: list[Detection]) -> float:
    """Probability that a text holds a license notice, taking the best detection of every label as independent evidence."""
    best: dict[str, float] = {}
    for d in found:
        if d.label:
            best[d.label] = max(best.get(d.label, 0.0), d.score)
    doubt = 1.0
    for score in best.values():
        doubt *= 1 - score
    return 1 - doubt


_DETECTION = "array<struct<label:string,priority:int,rule:int,first_word:bigint,last_word:bigint,score:double,always:boolean>>"
_ARROW = pa.list_(
    pa.struct(
        [("label", pa.string()), ("priority", pa.int32()), ("rule", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64()), ("always", pa.bool_())]
    )
)


def _scanned(rules: list[Rule], id_type: pa.DataType):
    def run(batches):
        scanner = Scanner(rules)
        for batch in batches:
            sizes, found, scores = [], [], []
            for text in batch.column("text"):
                text = words(text.as_py())
                hits = scanner.scan(text)
                sizes.append(text.count(" ") - 1)
                found.append([vars(h) for h in hits])
                scores.append(certainty(hits))
            arrays = [batch.column("id").cast(id_type), pa.array(sizes, pa.int64()), pa.array(found, _ARROW), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_words", "detections", "score"])

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``id_col, n_words, detections, score`` of every whole text.

    Words are runs of letters, digits and code points beyond ASCII, A-Z lower-cased. ``detections`` come
    by place, with the words they begin and end at (from 0), the rule's number, and ``always`` for
    phrases, which are found at all their places and never suppressed. ``score`` is 0 without any.
    Equal intervals of equal priority: the earlier rule stays. A null or empty text has no words;
    repeated rows and null ids are scanned like others. No rows give no rows. Other columns are
    ignored, whatever their names. One pass, no shuffle.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    bound_batches(docs.sparkSession)
    kind = source.schema["id"].dataType
    ddl = f"id {kind.simpleString()}, n_words bigint, detections {_DETECTION}, score double"
    return source.mapInArrow(_scanned(rules or signature_rules(), to_arrow_type(kind)), ddl).withColumnRenamed("id", id_col)
