"""Parameters and fixed values.

The values in the "fixed values" blocks must equal the behaviour being
matched (names, weights, thresholds, text templates); they are data, not
tuning knobs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Discovery sources, stages and states
# ---------------------------------------------------------------------------
STAGES = ("discovery", "extraction", "canonicalization", "scoring", "generation")

# Legal work-item transitions (from_state, to_state).  Terminal states have
# no outgoing edge.
ALLOWED_TRANSITIONS = (
    ("queued", "processing"),
    ("queued", "failed"),
    ("processing", "completed"),
    ("processing", "failed"),
)

# ---------------------------------------------------------------------------
# Extraction cascades (tier order, source label, confidence)
# ---------------------------------------------------------------------------
TITLE_TIERS = (
    ("title", 1.0),
    ("og:title", 0.8),
    ("twitter:title", 0.75),
    ("jsonld:headline", 0.6),
)
DESCRIPTION_TIERS = (
    ("meta:description", 1.0),
    ("og:description", 0.8),
    ("twitter:description", 0.75),
    ("jsonld:description", 0.6),
)
NO_SOURCE = "none"

# ---------------------------------------------------------------------------
# Link filter and section naming
# ---------------------------------------------------------------------------
NON_CONTENT_SEGMENTS = (
    "login",
    "logout",
    "signup",
    "register",
    "cart",
    "checkout",
    "admin",
    "wp-admin",
    "wp-login",
    "account",
    "search",
)
SECTION_SKIP_SEGMENTS = ("raw", "assets", "static", "_next", "_nuxt", "__")
DEFAULT_EXTENSIONS = ".html,.htm,.txt,.md,"

# ---------------------------------------------------------------------------
# Score weights and rounding
# ---------------------------------------------------------------------------
SCORE_WEIGHTS = {"coverage": 0.4, "confidence": 0.4, "redundancy": 0.2}
SCORE_DIGITS = 4

# ---------------------------------------------------------------------------
# Llms.txt layout
# ---------------------------------------------------------------------------
DOC_INTRO = (
    "> This file provides a structured overview of {host} "
    "for use by large language models and AI assistants. "
    "Each section below groups related pages by topic. "
    "Links include titles and descriptions where available "
    "to help you quickly identify relevant content. "
    "The content is organised into the following sections: "
    "{sections}."
)
DOC_NO_SECTIONS = "various topics"
DOC_TIME_FORMAT = "yyyy-MM-dd HH:mm 'UTC'"
LLMS_LINK = r"\[[^\]]+\]\(([^\)]+)\)"
SITEMAP_NS = "http://www.sitemaps.org/schemas/sitemap/0.9"

# ---------------------------------------------------------------------------
# UI read views
# ---------------------------------------------------------------------------
RECENT_EVENTS = 8
EVENT_VALUE_MAX = 60
EVENT_VALUE_CUT = 57
EVENT_DETAIL_MAX = 80
ARTIFACT_PREVIEW_LINES = 1000
HISTORY_LIMIT = 50
STATUS_STAGE_EVENTS = 5
EXTRACT_EVENT_DESC_MAX = 120
RECENT_WINDOW_HOURS = 24

# Failure class -> HTTP-like code.
FAILURE_CODES = (("invalid_input", 422), ("not_found", 404), ("stage_failure", 500))


@dataclass(frozen=True)
class SpiderBounds:
    """Bounds of the link-graph scan (defaults of the crawler)."""

    max_depth: int = 3
    max_scan_pages: int = 100
    max_index_pages: int = 50
    extensions: str = DEFAULT_EXTENSIONS

    @property
    def extension_set(self) -> tuple[str, ...]:
        return tuple(sorted({e.strip().lower() for e in self.extensions.split(",")}))


@dataclass(frozen=True)
class PipelineParams:
    """Parameters of one batch run over many sites."""

    generated_at: str = "2024-01-31 00:00:00"
    spider: SpiderBounds = field(default_factory=SpiderBounds)
    incremental: bool = False
