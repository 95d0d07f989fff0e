"""Ordered filter chains: the index of the first predicate that fails, in one expression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as X

Rule = tuple[str, Callable[[], Column]]


def flag(name: str) -> Column:
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False))


@dataclass(frozen=True)
class FilterChain:
    """Rules in order. A rule that is null counts as failed."""

    rules: tuple[Rule, ...] = field(default_factory=tuple)

    def __add__(self, other: FilterChain) -> FilterChain:
        return FilterChain(self.rules + other.rules)

    def first_fail(self) -> Column:
        """Index of the first rule that fails, -1 if none; later rules are not evaluated then."""
        out = None
        for k, (_, rule) in enumerate(self.rules):
            failed = ~F.coalesce(rule(), F.lit(False))
            out = F.when(failed, k) if out is None else out.when(failed, k)
        return F.lit(-1) if out is None else out.otherwise(-1)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.first_fail() == -1)

    def histogram(self, df: DataFrame) -> DataFrame:
        """``fail_idx, rule, n`` for every rule, those that never fail first included, and -1 for rows that pass."""
        names = df.sparkSession.createDataFrame([(-1, "passes"), *((k, n) for k, (n, _) in enumerate(self.rules))], "fail_idx int, rule string")
        counts = df.select(self.first_fail().alias("fail_idx")).groupBy("fail_idx").agg(F.count(F.lit(1)).alias("n"))
        return names.join(counts, "fail_idx", "left").select("fail_idx", "rule", F.coalesce("n", F.lit(0)).alias("n"))


def not_flags(*names: str) -> tuple[Rule, ...]:
    return tuple((f"not {n}", lambda n=n: ~flag(n)) for n in names)


def _valid_code() -> Column:
    return (flag("macro") | X.enclosed("code", "{", "}", 1)) & X.enclosed("code", "(", ")", 1)


def _starts_with_name(doc: str, separators: tuple[str, ...]) -> Column:
    low, name = F.lower(F.col(doc)), F.lower(F.col("name"))
    out = F.startswith(low, name)
    for s in separators:
        out = out | F.startswith(low, X.last_part(name, s))
    return out


def _clean_words(doc: str, bad: tuple[str, ...]) -> Column:
    return ~X.contains_any(F.lower(F.col(doc)), bad) & ~F.col(doc).contains("NOTE")


def _word_count(doc: str) -> Column:
    n = F.size(X.words(doc))
    return (n > 2) & (n < 70)


def _short_all(doc: str) -> Column:
    return F.length(F.concat(doc, "code", "context")) < 5000


# Words that a summary may not hold.
BAD_WORDS = ("see", "fixme", "todo", "deprecated")
BAD_SYNTH_WORDS = (*BAD_WORDS, "function is used to", "function is called", "this is intended to")

BODY: Rule = ("code has a body or is a macro", lambda: flag("macro") | X.has_body("code"))

SHARED = FilterChain((
    ("valid code or macro", _valid_code),
    ("code under 5000", lambda: F.length("code") < 5000),
    BODY,
    ("is a function", lambda: ~flag("non_function")),
    ("is no declaration", lambda: ~flag("decl")),
))

TRAIN = FilterChain((
    ("doc under 250", lambda: F.length("doc") < 250),
    ("doc of 3 to 69 words", lambda: _word_count("doc")),
    ("code over 50", lambda: F.length("code") > 50),
    ("code under 4000", lambda: F.length("code") < 4000),
    ("no doxygen", lambda: ~X.contains_any(F.lower("doc"), X.DOXYGEN)),
    BODY,
    ("no four equal characters in a row", lambda: ~X.four_repeated("doc")),
    ("doc does not start with the name", lambda: ~_starts_with_name("doc", (":", "_"))),
    ("no bad words", lambda: _clean_words("doc", BAD_WORDS)),
    *not_flags("system", "macro", "macro_exp", "vendor", "decl"),
    *((f"keyboard characters in {c}", lambda c=c: X.keyboard_or_empty(c)) for c in ("code", "doc", "context")),
    ("doc, code and context under 5000", lambda: _short_all("doc")),
))


def pre_synthesis(use_doc: bool = False, use_context: bool = False) -> FilterChain:
    rules: list[Rule] = [
        ("code over 50", lambda: F.length("code") > 50), ("code under 4000", lambda: F.length("code") < 4000), ("valid code or macro", _valid_code), BODY,
        ("keyboard characters in code", lambda: X.keyboard_or_empty("code")), ("is a function", lambda: ~flag("non_function")),
    ]
    if use_doc:
        rules += [("doc under 800", lambda: F.length("doc") < 800), ("no four equal characters in a row", lambda: ~X.four_repeated("doc")), ("keyboard characters in doc", lambda: X.keyboard_or_empty("doc"))]
    if use_context:
        rules.append(("keyboard characters in context", lambda: X.keyboard_or_empty("context")))
    if use_doc and use_context:
        rules.append(("doc, code and context under 5000", lambda: _short_all("doc")))
    return FilterChain(tuple(rules))


def synth_summary(most_trivial: float = 0.1, most_verbose: float = 0.5, copies: bool = True, metrics: dict[str, Callable[[Column], Column]] | None = None) -> FilterChain:
    """Rules for generated summaries before their context is attached. The defaults are strict; 0.8, 0.9 and no copy rule are the lenient set.

    ``metrics``: a registry as :func:`loomstone.functions.metrics.registry` gives it.  Triviality is read for the columns ``name`` and ``code``.
    """
    metrics = M.METRICS if metrics is None else metrics
    doc = "synth_doc"
    rules: list[Rule] = [
        ("summary under 180", lambda: F.length(doc) < 180), ("summary of 3 to 69 words", lambda: _word_count(doc)), ("does not start with the name", lambda: ~_starts_with_name(doc, (":",))),
        ("no braces", lambda: ~X.contains_any(F.col(doc), ("{", "}"))), ("no doxygen", lambda: ~X.contains_any(F.lower(doc), X.DOXYGEN)), ("no bad words", lambda: _clean_words(doc, BAD_SYNTH_WORDS)),
        ("no four equal characters in a row", lambda: ~X.four_repeated(doc)), ("not trivial", lambda: metrics["Triviality"](F.col(doc)) < most_trivial),
        ("not verbose", lambda: metrics["Verbosity"](F.col(doc)) < most_verbose), ("keyboard characters", lambda: X.keyboard_or_empty(doc)),
    ]
    if copies:
        rules.append(("copies no code", lambda: M.partial_ratio(F.lower(doc), F.lower(X.remove_comments("code"))) < 80))
    return FilterChain(tuple(rules))


TARGET = FilterChain(not_flags("system", "macro", "macro_exp", "vendor", "decl"))
_TARGET_TEXT = FilterChain((("keyboard characters in context", lambda: X.keyboard_or_empty("context")), ("summary, code and context under 5000", lambda: _short_all("synth_doc"))))
STRICT_TARGET = TARGET + _TARGET_TEXT + FilterChain((("names only what code or context name", lambda: F.size(F.array_except(X.variables("synth_doc"), F.array_union(X.variables("code"), X.variables("context")))) == 0),))


def history_target(use_doc: bool = False, keep_share: float = 1.0, seed: int = 0) -> FilterChain:
    """The lenient target rules. Only rows without callees can pass the one before last, a ``keep_share`` of them by a hash of their id."""
    rules: list[Rule] = [
        ("copies no 35 characters of code", lambda: ~X.shares_substring("synth_doc", "code", 35)), ("copies no 60 characters of context", lambda: ~X.shares_substring("synth_doc", "context", 60)),
        ("has no callees, by chance", lambda: (F.size("to") == 0) & (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) / 1e6 <= keep_share)),
    ]
    if use_doc:
        rules.append(("leaks no entity of the reference text", lambda: ~X.leaks_entity("synth_doc", "code", "context", "doc")))
    return TARGET + _TARGET_TEXT + FilterChain(tuple(rules))
