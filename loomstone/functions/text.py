"""String functions over code and documentation, as Column builders.

``(?U)`` makes Java's ``\\s`` and ``\\w`` Unicode-aware.  Nothing here runs Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns and limits that decide results.
EDGE = r"[/\\:*\s]*"
EDGE_QUOTED = r"[/\\:*\s\"']*"
KEYBOARD = r"""[a-zA-Z0-9\s./<>?;:"'`!@#$%^&*()\[\]{}_+=|\\\-~,]"""
PUNCTUATION = r"""[\s*(),;&\[\]\-!=><'`"%:/.]+"""
COMMENT = r"""(?d)/\*[\s\S]*\*/|//.*|"+[\s\S]*"+|'+[\s\S]*'+|`+[\s\S]*`+"""
ANSWER_MARK = r"(Yes|No)\.* *"
DOXYGEN = ("@", "\\return", "\\param", "\\brief", "\\since")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_edges(c: Column | str, edge: str = EDGE) -> Column:
    """Without comment marks and white space at either end."""
    return F.regexp_replace(_col(c), rf"(?U)^{edge}|{edge}\z", "")


def trim_lines(c: Column | str, edge: str = EDGE) -> Column:
    """``trim_edges`` on every line."""
    return F.array_join(F.transform(F.split(_col(c), "\n", -1), lambda x: trim_edges(x, edge)), "\n")


def strip(c: Column | str) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+\z", "")


def collapse_repeats(c: Column | str) -> Column:
    """One space, comma or line feed for a run of it, unless four spaces or line feeds in a row show that the layout matters."""
    c = _col(c)
    return F.when(c.contains("    ") | c.contains("\n\n\n\n"), c).otherwise(F.regexp_replace(c, r"([ ,\n])\1+", "$1"))


def words(c: Column | str) -> Column:
    """Parts between Unicode white space."""
    return F.filter(F.split(_col(c), r"(?U)\s+"), lambda x: x != "")


def enclosed(c: Column | str, left: str = "{", right: str = "}", depth: int = 0) -> Column:
    """Brackets balance, never close too early, and nest at least ``depth`` deep."""
    marks = F.split(F.regexp_replace(_col(c), rf"[^\{left}\{right}]", ""), "")
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("deepest"), F.lit(False).alias("broken"))

    def step(s: Column, x: Column) -> Column:
        now = s["open"] + F.when(x == left, 1).when(x == right, -1).otherwise(0)
        return F.struct(now.alias("open"), F.greatest(s["deepest"], now).alias("deepest"), (s["broken"] | (now < 0)).alias("broken"))

    return F.aggregate(marks, start, step, lambda s: (s["open"] == 0) & ~s["broken"] & (s["deepest"] >= depth))


def has_body(code: Column | str) -> Column:
    """What follows the first brace is not just its closing one. Null counts as failing."""
    return F.coalesce(~F.get(F.split(_col(code), r"\{", -1), F.lit(1)).rlike(r"(?U)^\s*\}"), F.lit(False))


def four_repeated(c: Column | str) -> Column:
    return _col(c).rlike(r"(?s)(.)\1{3}")


def contains_any(c: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def keyboard_or_empty(c: Column | str) -> Column:
    """Empty, or at least one keyboard character (one is enough)."""
    c = _col(c)
    return (F.length(c) == 0) | c.rlike(rf"(?U){KEYBOARD}")


def last_part(name: Column | str, separator: str) -> Column:
    return F.element_at(F.split(_col(name), separator, -1), -1)


def remove_comments(code: Column | str) -> Column:
    """Without comments and quoted parts; the patterns reach from the first opening to the last closing mark."""
    return F.regexp_replace(_col(code), COMMENT, "")


def plain_words(c: Column | str) -> Column:
    """Parts between white space and punctuation."""
    return F.filter(F.split(_col(c), rf"(?U){PUNCTUATION}"), lambda x: x != "")


def variables(c: Column | str) -> Column:
    """Different lower-case words that look like variables: an underscore, no capital, no digit in front, not ``_`` alone."""
    return F.array_distinct(F.filter(plain_words(c), lambda w: w.contains("_") & (w != "_") & ~w.rlike(r"\p{Lu}|^\p{Nd}")))


def parameters(code: Column | str) -> Column:
    """Text between the first ``(`` and the next ``)`` or ``(``; empty without a ``(``."""
    return F.coalesce(F.get(F.split(F.get(F.split(_col(code), r"\(", -1), F.lit(1)), r"\)", -1), F.lit(0)), F.lit(""))


def windows(c: Column, length: int, upto: Column) -> Column:
    """The substrings of ``length`` that start at 0 to ``upto`` - 1."""
    starts = F.when(upto > 0, F.sequence(F.lit(1), upto)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(c, i, F.lit(length)))


def shares_substring(doc: Column | str, ref: Column | str, length: int) -> Column:
    """A substring of ``length`` is in both; the last window of either text is not looked at."""
    doc, ref = _col(doc), _col(ref)
    cut = F.when(F.length(ref) > 0, F.substr(ref, F.lit(1), F.length(ref) - 1)).otherwise("")
    found = F.exists(windows(doc, length, (F.length(doc) - length).cast("int")), lambda w: F.contains(cut, w))
    return F.when((F.length(doc) < length) | (F.length(ref) < length), False).otherwise(found)


def leaks_entity(doc: Column | str, code: Column | str, context: Column | str, truth: Column | str) -> Column:
    """An identifier-like word of ``doc`` is in ``truth`` but neither in code nor context (case ignored there)."""
    seen = F.lower(F.concat(_col(code), _col(context)))
    parts = words(F.regexp_replace(_col(doc), r"(?U)[^\w]", " "))
    like = F.filter(parts, lambda w: (w.contains("_") | w.substr(F.lit(2), F.length(w)).rlike(r"(?U)\p{Lu}")) & (F.length(w) > 3))
    return F.exists(like, lambda w: F.contains(_col(truth), w) & ~F.contains(seen, F.lower(w)))


def drop_name_prefix(doc: Column | str, name: Column | str) -> Column:
    """Without a leading ``name - `` and then ``name: ``."""
    doc, short = _col(doc), last_part(name, ":")
    for mark in (" - ", ": "):
        head = F.concat(short, F.lit(mark))
        doc = F.when(F.startswith(doc, head), strip(F.substr(doc, F.length(head) + 1))).otherwise(doc)
    return doc


def cut_signature(doc: Column | str, code: Column | str) -> Column:
    """Without the first occurrence of the function's head, as its code has it."""
    doc, bare = _col(doc), remove_comments(code)
    head = trim_edges(F.get(F.split(bare, r"\{", -1), F.lit(0)))
    at = F.position(head, doc)
    cut = F.concat(F.substr(doc, F.lit(1), at - 1), F.substr(doc, at + F.length(head)))
    return F.when(bare.contains("{") & (at > 0), cut).otherwise(doc)


def yes_no(response: Column | str) -> Column:
    """The answers ``Yes`` and ``No`` of a response, in order."""
    return F.regexp_extract_all(_col(response), F.lit("(Yes|No)"), F.lit(1))


def answers_with_comments(questions: Column | str, response: Column | str) -> Column:
    """``question, answer, comment`` for each question: its Yes or No, and what its line holds besides.

    As many answers as questions are asked for; a row with another number stops
    the query with an error that tells both.
    """
    said, asked = yes_no(response), _col(questions)
    lines = F.split(F.regexp_replace(_col(response), ANSWER_MARK, ""), "\n", -1)
    wrong = F.concat(F.lit("answers: "), F.size(said).cast("string"), F.lit(", questions: "), F.size(asked).cast("string"))
    rows = F.transform(asked, lambda q, i: F.struct(q.alias("question"), F.get(said, i).alias("answer"), F.get(lines, i).alias("comment")))
    return F.when(F.size(said) == F.size(asked), rows).otherwise(F.raise_error(wrong))


def answers_by_question(questions: Column | str, response: Column | str) -> Column:
    """Map of each question to the response's line at its place; of equal questions the last counts."""
    lines = F.split(_col(response), "\n", -1)
    pairs = F.arrays_zip(_col(questions).alias("q"), F.slice(lines, 1, F.greatest(F.lit(0), F.size(_col(questions)))).alias("a"))
    return F.aggregate(pairs, F.expr("map()").cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["q"]), F.create_map(p["q"], p["a"])))
