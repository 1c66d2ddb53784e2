"""Scalar functions over prompts and responses, as columns.

Patterns carry (?dU), so that `.`, `\\s` and `\\b` mean in Java what they mean for Unicode text elsewhere.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import config as C


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_prompt(text: Column) -> Column:
    """Text that a user wrote: not empty, and not one of the wrapper tags."""
    left = F.regexp_replace(text, r"(?U)^\s+", "")
    return F.coalesce((left != "") & ~reduce(or_, [left.startswith(t) for t in C.WRAPPER_TAGS]), F.lit(False))


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def phrase_count(text: Column) -> Column:
    """Phrases are ASCII, so bytes tell how often one was taken out."""
    low = F.lower(text)

    def count(p: str) -> Column:
        return F.try_divide(F.octet_length(low) - F.octet_length(F.replace(low, F.lit(p), F.lit(""))), F.lit(len(p))).cast("int")

    return reduce(add, [F.when(~F.contains(low, F.lit(p)), 0).otherwise(count(p)) for p in C.PHRASES])


#: What is left in lower case of the letters outside ASCII that a pattern without case takes for i and s.
_LIKE_ASCII = ("\u0131", "\u017f", "\u0307")


def options_count(text: Column) -> Column:
    """A pattern is only tried on texts that hold one of its words, or letters that it may take for theirs."""
    low = F.lower(text)
    plain = (F.length(low) == F.octet_length(low)) | ~has_any(low, _LIKE_ASCII)

    def found(pattern: str, words: tuple[str, ...]) -> Column:
        return F.when(~has_any(low, words) & plain, 0).otherwise(text.rlike(f"(?idU){pattern}").cast("int"))

    return reduce(add, [found(p, w) for p, w in zip(C.OPTION_PATTERNS, C.OPTION_WORDS, strict=True)])


def is_design(prompt: Column) -> Column:
    return prompt.rlike(f"(?idU){C.DESIGN_PATTERN}")


def normalize_prompt(text: Column) -> Column:
    """Tags and runs of white space as one space, trimmed, lower case; null as empty."""
    given = F.coalesce(text, F.lit(""))
    bare = F.when(F.contains(given, F.lit("<")), F.regexp_replace(given, "<[^>]+>", " ")).otherwise(given)
    return F.lower(F.trim(F.regexp_replace(bare, r"(?U)[\s&&[^ ]]\s*| \s+", " ")))  # all but single spaces


def keywords(text: Column, least: int = 4) -> Column:
    """Distinct content words in order of appearance."""
    tokens = F.split(F.regexp_replace(F.lower(text), r"(?U)[^\w\s-]", " "), r"(?U)\s+")
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= least) & ~t.isin(*C.STOPWORDS)))


def label_score(response: Column, wanted: Column, unwanted: Column) -> Column:
    """Laplace ratio of the wanted keywords among those a response holds; 0.5 for an empty response."""
    low = F.lower(response)
    p, n = (F.size(F.filter(k, lambda w: F.contains(low, w))) for k in (wanted, unwanted))
    return F.when(F.coalesce(response, F.lit("")) == "", F.lit(0.5)).otherwise((p + 1) / (p + n + 2))


def task_type(prompt: Column, tools: Column, n_files: Column) -> Column:
    """tools: a map of counts by tool."""
    low = F.lower(prompt)
    used = lambda name: F.coalesce(F.try_element_at(tools, F.lit(name)), F.lit(0)) > 0
    return (
        F.when(n_files > 0, "code-change")
        .when(reduce(or_, [used(t) for t in C.RESEARCH_TOOLS]), "research")
        .when(has_any(low, C.DEBUG_WORDS), "debug")
        .when(has_any(low, C.AUDIT_WORDS), "audit")
        .when(used("Read") & used("Bash"), "exploration")
        .when(has_any(low, C.WRITING_WORDS), "doc-write")
        .otherwise("chat")
    )


def difficulty(duration: Column, s: C.Settings = C.DEFAULTS) -> Column:
    return F.when(duration < s.short_sec, "short").when(duration < s.long_sec, "medium").otherwise("long")


def outcome(duration: Column, tool_calls: Column, text_chars: Column, corrected: Column, s: C.Settings = C.DEFAULTS) -> Column:
    return (
        F.when(corrected, "corrected").when(duration < s.abandoned_sec, "abandoned").when((tool_calls == 0) & (text_chars == 0), "no-op").otherwise("completed")
    )


def cost_ratio(run: Column, truth: Column) -> Column:
    """1 at or under the known cost, falling to 0 at twice it; 0 for a run of no tokens."""
    base = F.coalesce(F.nullif(truth, F.lit(0)), F.lit(1))
    return F.when(F.coalesce(run, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(2.0) - run / base)))


def tool_alignment(run: Column, truth: Column) -> Column:
    ratio = run / F.coalesce(F.nullif(truth, F.lit(0)), F.lit(1))
    return F.when(F.coalesce(run, F.lit(0)) == 0, F.lit(0.0)).when(ratio < 0.5, ratio / 0.5).when(ratio <= 2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - (ratio - 2) / 4))


def search_first(prompt: Column, calls: Column, response: Column) -> Column:
    """Whether the first call that is not a lookup is a search; true for prompts that are not about design."""
    first = F.get(F.filter(calls, lambda t: ~t.isin(*C.LOOKUP_TOOLS)), F.lit(0))
    found = first.isin(*C.SEARCH_TOOLS) | ((first == "Bash") & F.coalesce(response, F.lit("")).rlike(f"(?dU){C.REPO_SEARCH_PATTERN}"))
    return F.when(F.coalesce(is_design(prompt), F.lit(False)), F.coalesce(found, F.lit(False))).otherwise(F.lit(True))


def truncated(text: Column, most: int) -> Column:
    """Head and tail of a long text with a mark between them."""
    cut = F.concat(F.left(text, F.lit(most - 50)), F.lit("\n…[truncated]…\n"), F.right(text, F.lit(50)))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def shown_counts(counts: Column, sign: str = "=", gap: str = ",") -> Column:
    """A map of counts as text, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(e["key"], F.lit(sign), e["value"].cast("string"))), gap)


def judge_value(value: Column) -> Column:
    """A judge's answer as 1 to 5, half to even; null if it is no finite number."""
    number = F.expr("null") if value is None else value.try_cast("double")
    return F.when(F.abs(number) < float("inf"), F.greatest(F.lit(1), F.least(F.lit(5), F.bround(F.least(F.greatest(number, F.lit(-9.0)), F.lit(9.0)), 0).cast("int"))))


def age_days(ts: Column, as_of: Column) -> Column:
    """Whole days between, rounded down."""
    return F.floor(F.timestamp_diff("MICROSECOND", ts, as_of) / F.lit(86_400_000_000)).cast("long")


def recency(age: Column, s: C.Settings = C.DEFAULTS) -> Column:
    return F.when(age <= s.recency_days[0], "recent").when(age <= s.recency_days[1], "mid").otherwise("older")


def project_of(directory: Column, user: str) -> Column:
    """Project name from a session directory's name `-home-<user>-<parts>`."""
    parts = F.filter(F.split(directory, "-"), lambda p: p != "")
    own = (F.get(parts, F.lit(0)) == "home") & (F.get(parts, F.lit(1)) == user)
    rest = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), "/")
    bare = F.regexp_replace(directory, "^-+", "")
    return F.when(own, F.when(rest == "", "workspace").otherwise(rest)).otherwise(F.when(bare == "", "unknown").otherwise(bare))


def hash_order(seed: Column | int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string"), F.lit("|"), key.cast("string")).cast("binary"))


def run_id(ts: Column) -> Column:
    """Name of a run that starts at ts, to the minute."""
    return F.date_format(ts, "yyyy-MM-dd-HHmm")
