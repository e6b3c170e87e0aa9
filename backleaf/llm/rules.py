"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

Every rule says of one document whether it must go. On a sample, each rule's cost (seconds a
document) and selectivity (share of documents rejected) are measured; documents then meet the
rules in order of rejection per cost and leave the cascade at the first that rejects them. As a
document is kept only if no rule rejects it, the order changes the cost and never the verdict.

Defined results: a null text counts as empty; an empty text has no words and fails `few_words`;
repeated rows are judged alike and all come back; an empty table gives an empty result; columns
of the input are passed on untouched, first and in their order; one whose name the result needs
gets underscores after its name.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backleaf.llm.common import beside

WHITE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
_CAPITALS = regex.compile(r"\p{Lu}").findall


class Doc:
    """One text with measures that are made once, when a rule first asks."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        """Code points in words."""
        return len(self.text) - sum(map(self.text.count, WHITE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines that hold a word."""
        return [x for x in self.text.split("\n") if x.strip(WHITE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a window of three words which the text holds twice or more."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        times = Counter(windows)
        inside = bytearray(len(w))
        for i, x in enumerate(windows):
            if times[x] > 1:
                inside[i : i + 3] = b"\1\1\1"
        return sum(inside)

    @cached_property
    def n_capitals(self) -> int:
        """Letters of category Lu."""
        return len(_CAPITALS(self.text))


@dataclass(frozen=True)
class Rule:
    """rejects(doc) is true where the document must go."""

    name: str
    rejects: Callable[[Doc], bool]


def few_words(d: Doc) -> bool:
    return d.n_words < 50


def repeated_windows(d: Doc) -> bool:
    return 100 * d.n_repeat_words > 50 * d.n_words


def many_symbols(d: Doc) -> bool:
    return 10 * d.n_symbols > 3 * d.n_words


def repeated_lines(d: Doc) -> bool:
    return 2 * d.n_dup_lines > len(d.lines)


def shouting(d: Doc) -> bool:
    return 10 * d.n_capitals > 4 * d.word_chars


def odd_word_length(d: Doc) -> bool:
    return d.word_chars < 2 * d.n_words or d.word_chars > 15 * d.n_words


def no_words(d: Doc) -> bool:
    return not d.n_words


def repeated_windows_of_many(d: Doc) -> bool:
    """In a text of few words, a sentence said twice is half of it and no sign of junk."""
    return d.n_words >= 50 and repeated_windows(d)


#: Those whose outcome the registered query reports as base_failed.
BASE_RULES = (Rule("few_words", few_words), Rule("repeated_windows", repeated_windows))
MORE_RULES = (
    Rule("many_symbols", many_symbols),
    Rule("repeated_lines", repeated_lines),
    Rule("shouting", shouting),
    Rule("odd_word_length", odd_word_length),
)
#: For filtering: a short text is no bad one, so its length alone does not reject it.
FILTER_RULES = (Rule("no_words", no_words), Rule("repeated_windows_of_many", repeated_windows_of_many), *MORE_RULES)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def estimate(df: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", sample_rows: int = 1000, seed: int = 7) -> dict[str, tuple[float, float]]:
    """For each rule its seconds a document and share rejected, over about sample_rows documents.

    The sample is drawn from the whole table by row; each rule is timed on documents of its own,
    so that measures it shares with another count for both. Sums come back, no texts.
    """
    n = df.count()
    drawn = df.select(F.col(text_col).alias("text")).sample(fraction=min(1.0, 1.2 * sample_rows / max(n, 1)), seed=seed)

    def timed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in rules:
                docs = [Doc(x) for x in batch["text"]]
                began = time.perf_counter()
                gone = sum(map(r.rejects, docs))
                out.append((r.name, len(docs), gone, time.perf_counter() - began))
            yield pd.DataFrame(out, columns=["rule", "n", "gone", "seconds"])

    sums = drawn.mapInPandas(timed, "rule string, n long, gone long, seconds double").groupBy("rule").agg(F.sum("n").alias("n"), F.sum("gone").alias("gone"), F.sum("seconds").alias("seconds"))
    found = {x.rule: (x.seconds / max(x.n, 1), x.gone / max(x.n, 1)) for x in sums.collect()}
    return {r.name: found.get(r.name, (0.0, 0.0)) for r in rules}


def ordered(rules: tuple[Rule, ...], estimates: dict[str, tuple[float, float]]) -> tuple[Rule, ...]:
    """The rules by rejection per cost, best first; ties keep the given order."""
    return tuple(sorted(rules, key=lambda r: -estimates[r.name][1] / max(estimates[r.name][0], 1e-9)))


def apply_rules(
    df: DataFrame,
    rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES,
    text_col: str = "text",
    measured: tuple[Rule, ...] = (),
    keep_text: bool = True,
    sample_rows: int = 1000,
    reason: bool = False,
) -> DataFrame:
    """df with `kept`: false where a rule rejects the text; with `reason` also `rejected_by`, the first rule that does (or null).

    rules: these meet the documents in the order that estimate() finds best. measured: rules that
    are decided for every document before the cascade; if any are given, the columns of MEASURES
    and `base_failed` (one of them rejects) are added as well; measures that a rule of the cascade shares with them
    cost it nothing more. keep_text: whether text_col stays. Which rule comes first depends on measured times, so
    rejected_by may differ between runs where several rules reject; kept never does.
    """
    columns = [*(MEASURES if measured else ()), *(("base_failed",) if measured else ()), "kept", *(("rejected_by",) if reason else ())]
    kinds = {"base_failed": T.BooleanType(), "kept": T.BooleanType(), "rejected_by": T.StringType()}
    kept_fields = [f for f in df.schema.fields if keep_text or f.name != text_col]
    names = beside([f.name for f in kept_fields], columns)
    cascade = ordered(rules, estimate(df, rules, text_col, sample_rows)) if len(rules) > 1 else rules
    schema = T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, kept_fields)] + [T.StructField(c, kinds.get(c, T.LongType())) for c in columns])

    def judged(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            rows: list[tuple] = []
            for text in texts:
                d = Doc(text)
                base = next((r.name for r in measured if r.rejects(d)), None)
                row = (*(getattr(d, m) for m in MEASURES), base is not None) if measured else ()
                by = base or next((r.name for r in cascade if r.rejects(d)), None)
                rows.append((*row, by is None, *((by,) if reason else ())))
            arrays = [batch.column(f.name) for f in kept_fields]
            made = list(zip(*rows)) if rows else [()] * len(columns)
            arrays += [pa.array(x, {"base_failed": pa.bool_(), "kept": pa.bool_(), "rejected_by": pa.string()}.get(c, pa.int64())) for c, x in zip(columns, made)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return df.mapInArrow(judged, schema)
