"""Line-first cleaning: rules on every line, failing lines go, and documents that lose too much text are rejected.

``clean_documents`` adds, per document, the base statistics of the whole text, the line verdicts and the cleaned text.

Line rules, in order; a line takes the first that fits it:

* ``navigation``: at least ``nav_separators`` separators (``|``, ``»``, ``›``, ``•``, ``·``), one per two words or more;
* ``boilerplate``: it holds one of the boilerplate phrases, in any case, and is shorter than ``boilerplate_chars``;
* ``symbols``: at least three words, and over ``marked_share`` of them end in two or more of ``#*$%&!?<>|~^_=+``;
* ``repetition``: at least ``repeat_words`` words, of which fewer than ``distinct_share`` are distinct; a line of over
  ``repeat_span`` words must also have fewer on average over runs of ``repeat_span`` words, or over ``max_repeat_percent``
  of its words in windows that occur twice, as the distinct share of any text falls with its length;
* ``punctuation``: over ``bare_words`` words with no ``.!?:;"')]}…”»。！？`` at the end of the line and fewer than one
  sentence mark (``.!?…。！？``) in every ``bare_words`` words, that is, running text without sentences;
* ``repeated``: at least ``repeated_words`` words and equal to an earlier line.

A document is kept if its base statistics pass and the lines that stay hold at least ``keep_share`` of its word characters.

Defined cases: null text is no text; an empty text, or one without words, fails the base rules; blank lines stay and weigh
nothing; rows are independent, so ties, repeated rows and null ids need no rule; every input column is passed through,
and one whose name an output takes is replaced.  Memory is one batch of texts; no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import pieces

SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\r\x0b\x0c"
_ENDS = tuple(".!?:;\"')]}…”»。！？")
_SENTENCE = re.compile("[.!?…。！？]")
_MARKED = re.compile(rb"[#*$%&!?<>|~^_=+]{2,}$")
_SEPARATORS = re.compile("[|»›•·]")
#: Phrases of pages, not of texts.
BOILERPLATE = ("all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "enable javascript", "accept cookies", "click here", "subscribe to our newsletter", "skip to content", "lorem ipsum", "powered by wordpress", "sign up for", "share on facebook")
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)), re.IGNORECASE)


@dataclass(frozen=True)
class QualityRules:
    """Thresholds of the rules; the defaults are the production values."""

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    nav_separators: int = 3
    boilerplate_chars: int = 400
    marked_share: float = 0.3
    repeat_words: int = 20
    distinct_share: float = 0.25
    repeat_span: int = 100
    bare_words: int = 60
    repeated_words: int = 4
    keep_share: float = 0.5


def repeat_mask(words: list[bytes], width: int) -> np.ndarray:
    """Which words lie in a window of ``width`` words that occurs twice or more."""
    n = len(words) - width + 1
    mask = np.zeros(len(words), dtype=bool)
    if n < 2:
        return mask
    ids = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            key *= np.uint64(0x9E3779B97F4A7C15)
            key += ids[k : k + n]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return mask
    found = np.zeros(n, dtype=bool)
    found[1:] |= same
    found[:-1] |= same
    starts = np.sort(order[found]).tolist()
    # equal keys are a proposal; the words decide
    seen = Counter(tuple(words[i : i + width]) for i in starts)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for i in starts:
        if seen[tuple(words[i : i + width])] > 1:
            edge[i] += 1
            edge[i + width] -= 1
    return np.cumsum(edge[:-1]) > 0


def base_statistics(text: str, rules: QualityRules) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = text.encode().split()
    word_chars = len(text) - sum(map(text.count, _SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    repeated = int(repeat_mask(words, rules.window).sum())
    failed = len(words) < rules.min_words or 100 * repeated > rules.max_repeat_percent * len(words)
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated, failed


def repeats_near_or_far(words: list[bytes], rules: QualityRules) -> bool:
    """Whether few words are distinct within runs of ``repeat_span`` that cover the line, or whole windows come again."""
    n, span = len(words), rules.repeat_span
    if sum(len(set(words[i : i + span])) for i in range(0, n, span)) < rules.distinct_share * n:
        return True
    return 100 * int(repeat_mask(words, rules.window).sum()) > rules.max_repeat_percent * n


def line_fault(line: str, earlier: bool, rules: QualityRules) -> str | None:
    """The rule that a line breaks; ``earlier``: an equal line came before."""
    words = line.encode().split()
    n = len(words)
    if not n:
        return None
    separators = len(_SEPARATORS.findall(line))
    if separators >= rules.nav_separators and 2 * separators >= n - separators:
        return "navigation"
    if len(line) < rules.boilerplate_chars and _BOILERPLATE.search(line):
        return "boilerplate"
    if n >= 3 and sum(1 for w in words if _MARKED.search(w)) > rules.marked_share * n:
        return "symbols"
    if n >= rules.repeat_words and len(set(words)) < rules.distinct_share * n and repeats_near_or_far(words, rules):
        return "repetition"
    if n > rules.bare_words and not line.rstrip(_SPACE).endswith(_ENDS) and len(_SENTENCE.findall(line)) * rules.bare_words < n:
        return "punctuation"
    if earlier and n >= rules.repeated_words:
        return "repeated"
    return None


def judge(text: str, rules: QualityRules) -> tuple:
    """The base statistics, then kept, removed characters, faults by rule, and the cleaned text."""
    base = base_statistics(text, rules)
    kept_lines, seen, faults, removed = [], set(), Counter(), 0
    for line in text.split("\n"):
        fault = line_fault(line, line in seen, rules)
        seen.add(line)
        if fault is None:
            kept_lines.append(line)
        else:
            faults[fault] += 1
            removed += len(line) - sum(map(line.count, _SPACE))
    chars = max(1, base[1])
    kept = not base[-1] and (base[1] - removed) >= rules.keep_share * chars
    return *base, kept, removed, dict(faults), "\n".join(kept_lines)


_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, removed_chars long, line_faults map<string,long>"
_TYPES = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.int64(), pa.map_(pa.string(), pa.int64())]
_NAMES = [x.split(" ")[0] for x in re.sub(r"<[^>]*>", "", _FIELDS).split(", ")]


def clean_documents(documents: DataFrame, rules: QualityRules | None = None, text_col: str = "text", with_text: bool = True, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) with the statistics, the verdict and, ``with_text``, ``clean_text``."""
    rules = rules or QualityRules()
    outputs = [*_NAMES, *(["clean_text"] if with_text else [])]
    taken = {x.lower() for x in outputs} | {"__text"}
    passed = [c for c in (documents.columns if keep is None else keep) if c.lower() not in taken]
    source = documents.select(*[F.col(f"`{c}`") for c in passed], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), _FIELDS, *(["clean_text string"] if with_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [judge(x, rules) for x in batch.column(batch.num_columns - 1).to_pylist()]
            made = [pa.array([list(r[k].items()) if k == 8 else r[k] for r in found], type=t) for k, t in enumerate(_TYPES)]
            if with_text:
                made.append(pa.array([r[9] for r in found], type=pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*passed, *outputs])

    return source.mapInArrow(run, schema)
