"""Settings of the engine; every tunable is a field, and tables of words are fixed values."""

from __future__ import annotations

from dataclasses import dataclass, field

# Texts that leave no information when an element holds nothing else.
JUNK_TEXTS = ("see all", "view all", "view details", "show all", "show more", "download app", "open app", "get the app", "cookie policy", "accept all", "accept cookies", "got it", "skip to content")
DROP_TAGS = ("script", "style", "noscript", "svg", "iframe", "canvas", "nav", "header", "footer", "aside", "form", "button", "select", "option")
BOILERPLATE_CLASSES = ("cookie", "consent", "breadcrumb", "newsletter", "subscribe", "appBanner", "modalFooter")
BOILERPLATE_IDS = ("cookie",)
ROOT_SELECTORS = ("div.layout-main", "div.layout-container", "main", "[role=main]", "div.container div.row div.col-md-8")
SYNONYMS = (
    ("sip", ("systematic investment plan", "monthly investment")),
    ("lock in", ("lock-in", "holding period", "lock-in period")),
    ("ter", ("total expense ratio", "expense ratio")),
    ("exit load", ("exit charge", "redemption charge", "exit penalty")),
    ("riskometer", ("risk level", "risk category", "riskometer level")),
    ("direct plan", ("direct growth", "direct growth plan")),
)
#: BRAND stands for the brand of the settings; an alias with it counts only where there is one.
ALIASES = (
    ("large_cap", ("large cap", "largecap")),
    ("flexi_cap", ("flexi cap", "flexicap", "BRAND equity fund")),
    ("elss", ("elss", "tax saver", "tax saver fund")),
    ("small_cap", ("small cap", "smallcap")),
    ("balanced_advantage", ("balanced advantage", "balanced advantage fund")),
)
# Texts of refusals and of the prompt.
ADVICE_REFUSAL = "I can share public facts about this scheme, but I can't give investment advice or recommendations. Please consult a SEBI-registered investment advisor for guidance."
PERFORMANCE_REFUSAL = "I don't share return or performance figures. Please check the official factsheet for audited performance."
PII_REFUSAL = "I can't help with personal account details. Please remove any account numbers, phone numbers, or email addresses from your question."
OUT_OF_CORPUS = "I couldn't find that in my sources. Please check the official scheme page for the most current information."
DISCLAIMER = "Facts-only. No investment advice."
EDUCATION_LINK = "https://www.investor.gov.in/"
SENTINEL = "I couldn't find that in my sources."
LAST_UPDATED = "Last updated from sources:"


@dataclass(frozen=True)
class Settings:
    """What a deployment may change; the catalogue of schemes (slug, aliases, url) and the brand name are its own."""

    brand: str = ""
    aliases: tuple = ALIASES
    scheme_urls: tuple = ()
    home_url: str = "https://example.com/"
    allowed_schemes: tuple = ("https",)
    allowed_hosts: tuple = ("example.com",)
    http_timeout_s: float = 20.0
    http_retries: int = 2
    http_backoff_s: float = 1.5
    http_delay_s: float = 1.5
    http_agent: str = "groundline/1.0"
    html_types: tuple = ("text/html", "application/xhtml+xml")
    root_selectors: tuple = ROOT_SELECTORS
    min_root_chars: int = 200
    max_heading_level: int = 5
    heading_path_mode: str = "flat"
    overview_heading: str = "Fund overview"
    risk_pattern: str = r"(?i)\brisk\b"
    risk_label: str = "Riskometer level"
    kv_label_chars: int = 30
    interactive_classes: tuple = ("cur-po",)
    embed_model: str = "hashing-384"
    embed_dim: int = 384
    embed_batch: int = 64
    embed_window: int = 512
    chunk_strategy: str = "recursive"
    chunk_size: int = 512
    chunk_overlap: int = 64
    chunk_separators: tuple = ("\n\n", "\n", ". ", " ")
    include_heading: bool = True
    semantic_percentile: float = 85.0
    semantic_buffer: int = 1
    top_k: int = 5
    max_distance: float = 0.57
    gate_aggregation: str = "min"
    context_budget: int = 1800
    dedupe_similarity: float = 0.97
    max_query_chars: int = 4000
    expansion_ratio: float = 2.0
    synonyms: tuple = SYNONYMS
    #: Search a question a second time without the scheme's name, and keep the best of both.
    dual_query: bool = False
    #: What may follow a scheme's name and goes with it.
    scheme_tail: str = r"(?: fund)?(?:\s*-?\s*direct)?(?: plan)?(?:\s*-?\s*growth)?"
    llm_temperature: float = 0.0
    llm_top_p: float = 1.0
    llm_max_tokens: int = 400
    llm_timeout_s: float = 60.0
    llm_attempts: int = 2
    llm_wait_s: float = 0.5
    #: Requests that one task has open at a time.
    llm_parallel: int = 8
    #: Sides of joins are broadcast below this size only.
    broadcast_bytes: int = 32 << 20
    extra: dict = field(default_factory=dict, hash=False)


    def named(self) -> tuple[tuple[str, tuple[str, ...]], ...]:
        """The aliases of each scheme, lower-cased, with the brand in its place."""
        own = lambda a: (a.replace("BRAND", self.brand) if self.brand else None if "BRAND" in a else a)
        return tuple((slug, tuple(x.lower() for x in map(own, names) if x)) for slug, names in self.aliases)


DEFAULT = Settings()
