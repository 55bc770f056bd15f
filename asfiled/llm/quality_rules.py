"""A cascade of quality rules that stops at the first rule a text fails.

The order of the rules is worked out, not written down: on a sample every rule is timed and its
rejections counted, and rules run by falling rejections per second. A text is kept if no rule
rejects it, so the order changes the time taken and never the verdict.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import append, bounded_batches, schema_of, without

SYMBOLS = "#*$%&|<>"
_NOT_CAPITAL = bytes(b for b in range(256) if not 65 <= b <= 90)
_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")


class Measures:
    """What rules ask of a text; each figure is worked out when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        """Runs of anything but ASCII white space, which is what bytes are split at."""
        return self.text.encode().split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, "\x20\x09\x0a\x0b\x0c\x0d"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_exclamations(self) -> int:
        return self.text.count("!")

    @cached_property
    def n_capitals(self) -> int:
        """Capitals from A to Z."""
        return len(self.text.encode().translate(None, _NOT_CAPITAL))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if _HAS_WORD.search(x)]

    @cached_property
    def n_lines(self) -> int:
        return len(self.lines)

    @cached_property
    def n_dup_lines(self) -> int:
        return self.n_lines - len(set(self.lines))

    @cached_property
    def numbered(self) -> np.ndarray:
        """Each word as the number of its first appearance."""
        seen: dict[bytes, int] = {}
        return np.array([seen.setdefault(w, len(seen)) for w in self.words], np.int64)

    @cached_property
    def n_distinct_words(self) -> int:
        return int(self.numbered.max()) + 1 if self.n_words else 0

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside three-word windows that occur at least twice, the first one included."""
        x, n = self.numbered, self.n_words
        if n < 4:
            return 0
        _, pair = np.unique(x[:-1] * n + x[1:], return_inverse=True)
        _, window, count = np.unique(pair[:-1] * n + x[2:], return_inverse=True,
                                     return_counts=True)
        again = count[window] > 1
        inside = np.zeros(n, bool)
        for shift in range(3):
            inside[shift:n - 2 + shift] |= again
        return int(inside.sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], bool]


#: Whole-number tests, so that SQL decides alike.
BASE_RULES = (
    Rule("too_short", lambda m: m.n_words < 50),
    Rule("repeated_phrases", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
)
STYLE_RULES = (
    Rule("symbols", lambda m: 10 * m.n_symbols > 3 * m.n_words),
    Rule("shouting", lambda m: 10 * m.n_capitals > 3 * m.word_chars),
    Rule("exclamations", lambda m: 10 * m.n_exclamations > 3 * m.n_words),
    Rule("repeated_lines", lambda m: 2 * m.n_dup_lines > m.n_lines),
    Rule("word_length", lambda m: not 2 * m.n_words <= m.word_chars <= 20 * m.n_words),
    Rule("few_words", lambda m: 20 * m.n_distinct_words < m.n_words),
)
RULES = BASE_RULES + STYLE_RULES


def estimate(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int = 2000,
             text: str = "text", seed: int = 5) -> dict[str, tuple[float, float]]:
    """Seconds per text and share of texts rejected, by rule, on about ``sample_rows`` rows.

    Only sums per rule reach the driver. Each rule is timed on a fresh text, so that what rules
    share counts for each of them. Without rows every figure is zero.
    """
    fraction = min(1.0, sample_rows / max(docs.count(), 1))

    def run(batches):
        spent, thrown, rows = [0.0] * len(rules), [0] * len(rules), 0
        for batch in bounded_batches(batches):
            for value in batch.column(0).to_pylist():
                rows += 1
                for i, rule in enumerate(rules):
                    began = time.perf_counter()
                    thrown[i] += rule.rejects(Measures(value))
                    spent[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({
            "rule": [r.name for r in rules], "spent": spent, "thrown": thrown,
            "texts": [rows] * len(rules)})

    sums = (docs.select(text).sample(fraction, seed)
            .mapInArrow(run, "rule string, spent double, thrown long, texts long")
            .groupBy("rule").agg(F.sum("spent").alias("spent"), F.sum("thrown").alias("thrown"),
                                 F.sum("texts").alias("texts")).collect())
    found = {r.rule: (r.spent / max(r.texts, 1), r.thrown / max(r.texts, 1)) for r in sums}
    return {r.name: found.get(r.name, (0.0, 0.0)) for r in rules}


def ordered(rules: tuple[Rule, ...], figures: dict[str, tuple[float, float]]) -> tuple[Rule, ...]:
    """Rules by falling rejections per second; ties keep their order."""
    def worth(rule: Rule) -> float:
        cost, rejected = figures[rule.name]
        return rejected / max(cost, 1e-9)
    return tuple(sorted(rules, key=worth, reverse=True))


def passes(measures: Measures, rules: tuple[Rule, ...]) -> bool:
    return not any(rule.rejects(measures) for rule in rules)


def quality_verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES,
                     report: tuple[str, ...] = (), always: tuple[Rule, ...] = (),
                     sample_rows: int = 2000, text: str = "text") -> DataFrame:
    """``docs`` with ``kept`` and, on request, figures of every text.

    ``report`` names figures of :class:`Measures` that are wanted for every row, also for those a
    rule has thrown out. Rules in ``always`` are asked first and of every row; whether one of them
    rejects is the column ``base_failed`` (there only if ``always`` is given). Columns of ``docs``
    with the names of new ones are replaced.

    A null text counts as an empty one. Each row is judged on its own, so repeated rows get the
    same verdict; a text is read whole, whatever its length. An empty table gives an empty one.
    """
    rest = tuple(r for r in rules if r not in always)
    cascade = ordered(rest, estimate(docs, rest, sample_rows, text))
    made = dict.fromkeys(report, "long")
    made |= {"base_failed": "boolean"} if always else {}
    made["kept"] = "boolean"
    keep = without(docs, list(made))
    source = docs.select(*keep) if text in keep else docs.select(*keep, text)

    def run(batches):
        for batch in bounded_batches(batches):
            columns: dict[str, list] = {name: [] for name in made}
            for value in batch.column(batch.schema.get_field_index(text)).to_pylist():
                m = Measures(value)
                for name in report:
                    columns[name].append(getattr(m, name))
                failed = not passes(m, always)
                if always:
                    columns["base_failed"].append(failed)
                columns["kept"].append(not failed and passes(m, cascade))
            yield append(batch, keep, {
                k: pa.array(v, pa.int64() if made[k] == "long" else pa.bool_())
                for k, v in columns.items()})

    ddl = ", ".join(f"{k} {v}" for k, v in made.items())
    return source.mapInArrow(run, schema_of(source, keep, ddl))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000,
              text: str = "text") -> DataFrame:
    """Rows of ``docs`` that no rule rejects, with the columns they had."""
    judged = quality_verdicts(docs, rules, sample_rows=sample_rows, text=text)
    clash = [c for c in docs.columns if c.lower() == "kept"]
    if clash:  # a column of that name is an input's own and is handed through
        safe = docs.withColumnRenamed(clash[0], "_own_kept")
        return (keep_good(safe, rules, sample_rows, text)
                .withColumnRenamed("_own_kept", clash[0]))
    return judged.filter("kept").select(*docs.columns)
