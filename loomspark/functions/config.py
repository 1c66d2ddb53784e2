"""Parameters and fixed values of the analytics."""

from __future__ import annotations

from dataclasses import dataclass

# Wrapper tags that make a message no prompt of the user's.
WRAPPER_TAGS = (
    "<command-name>", "<command-message>", "<local-command-stdout>", "<local-command-caveat>", "<command-stdout>",
    "<command-stderr>", "<task-notification>", "<system-reminder>", "<user-prompt-submit-hook>",
)
# Tools by what they do.
EDIT_TOOLS = ("Edit", "Write", "MultiEdit", "NotebookEdit")
RESEARCH_TOOLS = ("WebSearch", "WebFetch", "Tavily", "Linear")
SEARCH_TOOLS = ("WebSearch", "WebFetch", "mcp__claude_ai_Tavily__tavily_search", "Tavily")
LOOKUP_TOOLS = ("Read", "Glob", "Grep")
# Words in a prompt that tell the type of a task, in order of precedence.
DEBUG_WORDS = ("debug", "broken", "error", "fix the", "why is")
AUDIT_WORDS = ("audit", "review", "check", "verify")
WRITING_WORDS = ("write a", "draft", "compose", "essay", "doc")
# Phrases that close too early or hedge.
PHRASES = (
    "feels balanced", "deferred until", "i think the right call", "either approach works", "ultimately your call",
    "let me know if", "to summarize, ", "in summary, ", "tldr:", "tl;dr:",
)
# Wording that offers options instead of a position, and wording of design prompts.
OPTION_PATTERNS = (
    r"\b(option|approach|path|choice)\s*[abc1234]\b",
    r"\b(?:there are|here are)\s+(?:two|three|four|2|3|4)\s+(?:options|approaches|paths|ways)\b",
    r"\bwould you (?:prefer|like|want)\b.*\bor\b",
)
# For each of those patterns, lower-case words of which every match holds one.
OPTION_WORDS = (("option", "approach", "path", "choice"), ("here are",), ("would you",))
DESIGN_PATTERN = r"\b(design|architect|how (?:would|should) (?:we|you)|better idea|what should we build|brainstorm|plan a)\b"
REPO_SEARCH_PATTERN = r"\bgh\s+search\b"
# Words that are no keywords.
STOPWORDS = tuple(
    """
    the a an and or but is are was were be been being have has had do does did will would could should may might must can
    this that these those i you he she it we they my your his her its our their what which who whom where when why how
    to of in on at by for with about from into than then so if as very just more less also only even now still really actually
    thing stuff way ways kind type lot lots first second third next last all any some many much few little other another same such
    make made makes use used uses using get got gets getting go going went come came coming see seen saw look looking looked
    think thinks thinking thought know knew known say said says tell told tells
    """.split()
)
# Paths that no change may touch.
FORBIDDEN = (
    ".git/", ".gitignore", ".credentials.json", ".mcp.json", "settings.json", "settings.local.json", "projects/", "plugins/",
    "statsig/", "ide/", "sessions/", "tasks/", "history.jsonl", "learning/", "file-history/", "paste-cache/", "telemetry/",
    "cache/", "backups/",
)
# Labels of decisions, and the declared strategies.
KEPT = ("kept", "first-real-baseline")
LOST = ("reverted", "held", "deadletter-blocked", "user-reverted")
NOT_RUNS = ("seed", "user-reverted")
NOT_STRATEGIES = ("synthetic-baseline-seed", "user-disapproval")
STRATEGIES = ("rule-rewrite", "hook-tighten", "memory-add", "skill-description-tighten", "rule-reorder")
# The judge's dimensions.
DIMENSIONS = ("position_taking", "task_completion", "search_first", "tool_appropriate", "response_specific")


@dataclass(frozen=True)
class Settings:
    """Thresholds and sizes; every one may be overridden."""

    abandoned_sec: float = 90.0
    short_sec: float = 120.0
    long_sec: float = 600.0
    min_duration_sec: float = 60.0
    min_prompt: int = 20
    max_prompt: int = 4000
    suite_size: int = 40
    seed: int = 42
    recency_weights: tuple[float, ...] = (0.60, 0.30, 0.10)
    recency_days: tuple[int, int] = (30, 90)
    delta_floor: float = 0.02
    judge_floor: float = 0.6
    max_judge_failures: int = 2
    corrections_floor: float = 0.4
    sanity_floor: float = 0.5
    noise_factor: float = 1.5
    replicates: int = 20
    fraction: float = 0.7
    run_budget: float = 2.0


DEFAULTS = Settings()
